"""The cheapest of the largest matchings of near points, from the points alone: pairs are found when a search asks for them and never stored."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motiondeck.operators.graph import cells, components
from motiondeck.operators.matching import by_group


#: Pairs that a task remembers (12 bytes each); it finds others anew whenever they are asked for.
KNOWN = 1 << 24


class Near:
    """For each node of one side the nodes of the other within reach, and how far they are, in reaches. A node is an id; one id may have several places."""

    def __init__(self, rows: np.ndarray, row_of: np.ndarray, others: np.ndarray, other_of: np.ndarray, reach: float):
        self.known, self.room = {}, KNOWN
        self.reach, self.several = reach, len(others) != other_of.max(initial=-1) + 1
        order = np.argsort(row_of, kind="stable")
        self.rows, self.starts = rows[order], np.searchsorted(row_of[order], np.arange(row_of.max(initial=-1) + 2))
        box = np.floor(others / reach).astype(np.int64)
        own = np.floor(self.rows / reach).astype(np.int64)
        both = np.concatenate([box, own])
        self.low, self.size = both.min(0) - 1, both.max(0) - both.min(0) + 3
        numbers = self._number(box)
        order = np.argsort(numbers, kind="stable")
        self.places, self.node, self.own = np.ascontiguousarray(others[order].T), other_of[order].astype(np.int32), self._number(own)
        self.cells, first = np.unique(numbers[order], return_index=True)
        self.bounds = np.append(first, len(order))
        # cells that follow one another along the last axis are one run of places
        self.runs = [int(self._number(np.array([[*step, 0]]) + self.low)[0]) for step in product((-1, 0, 1), repeat=others.shape[1] - 1)]

    def _number(self, box: np.ndarray) -> np.ndarray:
        out = np.zeros(len(box), dtype=object if np.prod(self.size.astype(float)) > 2**62 else np.int64)
        for k in range(box.shape[1]):
            out = out * int(self.size[k]) + (box[:, k] - self.low[k])
        return out

    def __call__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        got = self.known.get(i)
        if got is None:
            got = self._found(i, self.reach)
            if len(got[0]) <= self.room:
                self.room -= len(got[0])
                self.known[i] = got
        return got

    def cost(self, i: int, j: int) -> float:
        columns, costs = self._found(i, 1.0)
        return float(costs[np.flatnonzero(columns == j)[0]])

    def _found(self, i: int, unit: float) -> tuple[np.ndarray, np.ndarray]:
        found = [self._of(n, unit) for n in range(self.starts[i], self.starts[i + 1])]
        j, c = found[0] if len(found) == 1 else map(np.concatenate, zip(*found, strict=True))
        if self.several or len(found) > 1:
            order = np.lexsort((c, j))
            j, c = j[order], c[order]
            once = np.append(True, j[1:] != j[:-1])[: len(j)]
            j, c = j[once], c[once]
        return j, c

    def _of(self, n: int, unit: float) -> tuple[np.ndarray, np.ndarray]:
        middle = np.array([self.own[n] + r for r in self.runs])
        a, b = np.searchsorted(self.cells, middle - 1, "left"), np.searchsorted(self.cells, middle + 1, "right")
        parts = [(self.bounds[p], self.bounds[q]) for p, q in zip(a, b, strict=True) if p < q]
        if not parts:
            return np.zeros(0, dtype=np.int32), np.zeros(0)
        place = np.concatenate([self.places[:, p:q] for p, q in parts], axis=1)
        square = 0.0
        for x, y in zip(self.rows[n], place, strict=True):
            square = square + (x - y) ** 2
        cost = np.sqrt(square)
        hit = np.flatnonzero(cost < self.reach)
        return np.concatenate([self.node[p:q] for p, q in parts])[hit], cost[hit] / unit


def near_assignment(near: Callable[[int], tuple[np.ndarray, np.ndarray]], n: int, m: int) -> list[tuple[int, int]]:
    """(row, column) of the cheapest of the largest matchings of n rows and m columns; near(i) gives a row's columns and costs below 1.

    Rows take their best column while they can by lowering its price; what is left over is added along shortest augmenting paths. As in
    ``sparse_assignment`` each row also has an edge to nothing that costs more than all others together. Memory is some numbers a node.
    """
    nothing = float(min(n, m) + 2)
    u, v, mate, owner = np.zeros(n), np.zeros(m), np.full(n, -1), np.full(m, -1)

    free = list(range(n))
    for _ in range(5):
        waiting, free, turns = free[::-1], [], 4 * n
        while waiting:
            i = waiting.pop()
            j, c = near(i)
            r = c - v[j]
            k = int(r.argmin()) if len(r) else -1
            if k < 0 or r[k] >= nothing:
                u[i] = nothing
                continue
            best, to = float(r[k]), int(j[k])
            r[k] = nothing
            u[i] = min(nothing, float(r.min()))
            if u[i] <= best and owner[to] >= 0:  # a tie: another column as near that nobody has
                to = int(next((t for t in j[r <= best] if owner[t] < 0), -1))
                if to < 0:
                    free.append(i)
                    continue
            u[i], before = max(u[i], best), int(owner[to])
            v[to] -= u[i] - best
            owner[to], mate[i] = i, to
            if before >= 0:
                mate[before], turns = -1, turns - 1
                (waiting if turns > 0 else free).append(before)
    # of columns: the length of the path found (front: none once it is final; bar: none is shorter then), the row it comes from
    front, bar, came = np.full(m, np.inf), np.full(m, np.inf), np.full(m, -1)
    for start in free:
        touched, done, at = [], [], []
        i, base, out, last, end = start, 0.0, np.inf, start, -1
        j, c = near(start)
        own = u[start] = min(nothing, float((c - v[j]).min(initial=nothing)))
        while True:
            if base + nothing - own < out:
                out, last = base + nothing - own, i
            d = c - v[j]
            d += base - own
            nearer = np.flatnonzero(d < bar[j])
            j, d = j[nearer], d[nearer]
            bar[j] = front[j] = d
            came[j] = i
            touched.append(j)
            k = int(front.argmin())
            if front[k] > out or front[k] == np.inf:
                base = out
                break
            base, bar[k], front[k] = float(front[k]), -np.inf, np.inf
            i = int(owner[k])
            if i < 0:
                end = k
                break
            done.append(k)
            at.append(base)
            own = float(u[i])
            j, c = near(i)
        u[start] += base
        shut, rise = np.array(done, dtype=int), base - np.array(at)
        u[owner[shut]] += rise
        v[shut] -= rise
        if end < 0:  # nothing is cheapest for one of the rows: it gives its column up
            end, mate[last] = int(mate[last]), -1
        while end >= 0:
            i = int(came[end])
            owner[end], mate[i], end = i, end, -1 if i == start else int(mate[i])
        for j in touched:
            bar[j] = front[j] = np.inf
    return [(i, int(mate[i])) for i in np.flatnonzero(mate >= 0).tolist()]


#: Groups of up to so many points are solved whole; larger ones are first split where cells without neighbours part them.
POINTS = 1 << 17


def match_near(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, left_axes: list[str], right_axes: list[str], reach: float, whole: int = POINTS) -> DataFrame:
    """(keys, left_id, right_id, cost): what ``match`` makes of ``near_pairs``, yet no pair is stored or shuffled: of each group's pairs closer than
    reach as many as possible, each id once a side, and of those the nearest. A task holds the points of a group, or of a part of a
    large one that no chain of neighbouring cells joins to the others, so memory grows with points. Time grows with the pairs of such a part.
    """
    kinds = dict(left.dtypes) | {right_id: dict(right.dtypes)[right_id]}
    kind = kinds[left_id] if kinds[left_id] == kinds[right_id] else "string"
    axes, box, root = ([f"__{n}{i}" for i in range(len(left_axes))] for n in "xcr")

    def side(df: DataFrame, number: int, own: str, places: list[str]) -> DataFrame:
        finite = [F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) for x in axes]
        out = df.select(*keys, F.lit(number).alias("__side"), F.col(own).cast(kind).alias("__id"), *[F.col(c).cast("double").alias(x) for c, x in zip(places, axes, strict=True)])
        return out.where(reduce(and_, [F.col("__id").isNotNull(), *[F.col(k).isNotNull() for k in keys], *finite]))

    def solve(df: pd.DataFrame) -> list[tuple]:
        sides = [df[df["__side"] == s] for s in (0, 1)]
        codes, ids = zip(*[pd.factorize(d["__id"]) for d in sides], strict=True)
        if not all(map(len, ids)):
            return []
        a, b = (0, 1) if len(ids[0]) <= len(ids[1]) else (1, 0)
        near = Near(sides[a][axes].to_numpy(float), codes[a], sides[b][axes].to_numpy(float), codes[b], reach)
        own = [df[k].iloc[0] for k in keys]
        found = [(i, j, near.cost(i, j)) for i, j in near_assignment(near, len(ids[a]), len(ids[b]))]
        return [(*own, ids[0][i], ids[1][j], c) for i, j, c in sorted((i, j, c) if a == 0 else (j, i, c) for i, j, c in found)]

    points = side(left, 0, left_id, left_axes).unionAll(side(right, 1, right_id, right_axes))
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"`{left_id}` {kind}, `{right_id}` {kind}, cost double"])
    count = points.groupBy(*keys).count().where(F.col("count") > whole).drop("count")
    order, parts = ["__side", "__id", *axes], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if count.isEmpty():
        found = by_group(points, keys, order, solve, schema, parts)
    else:
        small = points.join(F.broadcast(count), keys, "left_anti")
        placed = points.join(F.broadcast(count), keys, "left_semi").select("*", *[c.alias(n) for c, n in zip(cells(axes, reach), box, strict=True)])
        some = [placed.where(F.col("__side") == s).select(*keys, *box).distinct() for s in (0, 1)]
        around = F.array(*[F.struct(*[(F.col(c) + d).alias(n) for c, d, n in zip(box, step, root, strict=True)]) for step in product((-1, 0, 1), repeat=len(box))])
        met = some[0].select("*", F.inline(around)).join(some[1].select(*keys, *[F.col(c).alias(r) for c, r in zip(box, root, strict=True)]), [*keys, *root])
        node = lambda names: F.struct(*keys, *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
        roots = components(met.select(node(box).alias("a"), node(root).alias("b")))
        split = placed.withColumn("node", node(box)).join(roots, "node").select(*keys, "__side", "__id", *axes, *[F.col(f"root.c{i}").alias(r) for i, r in enumerate(root)])
        found = by_group(small, keys, order, solve, schema, parts).unionAll(by_group(split, [*keys, *root], order, solve, schema, parts))
    return found.select(*keys, F.col(left_id).cast(kinds[left_id]), F.col(right_id).cast(kinds[right_id]), "cost")
