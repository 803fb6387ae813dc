"""One-to-one matching, overlap suppression, and smoothing kernels that need a group's rows in order.

The candidates are joined, filtered and partitioned by Spark; each kernel sees one frame or one series.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from motiondeck.operators.graph import cells, components, spread
from motiondeck.operators.scratch import written


def assignment(cost: np.ndarray, threshold: float | None = None, allowed: np.ndarray | None = None) -> list[tuple[int, int]]:
    """As many pairs as possible of allowed cells below the threshold, and of those the cheapest: (row, column), by row.

    Shortest augmenting paths with potentials; a cell that is not allowed costs more than all allowed ones together.
    """
    n, m = cost.shape
    if not n or not m:
        return []
    ok = np.isfinite(cost)
    if threshold is not None:
        ok &= cost < threshold
    if allowed is not None:
        ok &= allowed
    if not ok.any():
        return []
    flip = n > m
    c = np.where(ok, cost, 0.0)
    c = np.where(ok, c, 1.0 + 2 * (np.abs(c).max() + 1) * (min(n, m) + 1))
    c = c.T if flip else c
    rows, cols = c.shape
    u, v = np.zeros(rows + 1), np.zeros(cols + 1)
    owner, way = np.zeros(cols + 1, dtype=int), np.zeros(cols + 1, dtype=int)
    for i in range(1, rows + 1):
        owner[0], j = i, 0
        least, used = np.full(cols + 1, np.inf), np.zeros(cols + 1, dtype=bool)
        while True:
            used[j] = True
            free = ~used[1:]
            slack = c[owner[j] - 1] - u[owner[j]] - v[1:]
            better = free & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j
            nxt = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            step = least[nxt]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            j = nxt
            if not owner[j]:
                break
        while j:
            owner[j], j = owner[way[j]], way[j]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, cols + 1) if owner[j]]
    pairs = [(b, a) if flip else (a, b) for a, b in pairs]
    return sorted((int(a), int(b)) for a, b in pairs if ok[a, b])


def sparse_assignment(left: np.ndarray, right: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Edges (by number) of the cheapest of the largest matchings of a graph given by its edges; no matrix is made.

    Left nodes are added one by one along shortest augmenting paths; each also has an edge to nothing that costs more than all others
    together, so a node may give its place up to a cheaper one. A search only visits what it can reach.
    """
    if not len(cost):
        return np.zeros(0, dtype=int)
    names, a = np.unique(left, return_inverse=True)
    others, b = np.unique(right, return_inverse=True)
    n, m = len(names), len(others)
    span = float(cost.max() - cost.min()) or 1.0
    c = ((cost - cost.min()) / span).tolist()
    nothing = float(min(n, m) + 2)
    out: list[list[tuple[int, float, int]]] = [[(m + i, nothing, -1)] for i in range(n)]
    for e, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        out[i].append((j, c[e], e))
    u, v, owner, by, mate = [0.0] * n, [0.0] * (m + n), [-1] * (m + n), [-1] * (m + n), [-1] * n
    for start in range(n):
        dist: dict[int, float] = {}
        came: dict[int, tuple[int, int]] = {}
        heap: list[tuple[float, int]] = []
        done: list[int] = []
        closed: set[int] = set()
        i, base = start, 0.0
        while True:
            for j, w, e in out[i]:
                d = base + w - u[i] - v[j]
                if j not in closed and d < dist.get(j, np.inf):
                    dist[j], came[j] = d, (i, e)
                    heapq.heappush(heap, (d, j))
            while True:
                base, j = heapq.heappop(heap)
                if j not in closed and base <= dist[j]:
                    break
            closed.add(j)
            if owner[j] < 0:
                break
            done.append(j)
            i = owner[j]
        u[start] += base
        for k in done:
            u[owner[k]] += base - dist[k]
            v[k] -= base - dist[k]
        while True:
            i, e = came[j]
            owner[j], by[j], mate[i], j = i, e, j, mate[i]
            if i == start:
                break
    return np.array(sorted(e for e in by[:m] if e >= 0), dtype=int)


def by_group(df: DataFrame, keys: list[str], order: list[str], solve: Callable[[pd.DataFrame], list[tuple]], schema: str, parts: int | None = None) -> DataFrame:
    """The rows that solve makes of each group's rows in order. Tasks stream through sorted partitions and hold a batch and one group, so many
    small groups cost no more than their rows. With parts, for few rows of much work each, there are so many tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last = [], None
        for batch in filter(len, batches):
            own = list(zip(*(_plain(batch[k]) for k in keys), strict=True)) if keys else [()] * len(batch)
            starts = [i for i in range(len(own)) if own[i] != (own[i - 1] if i else last)]
            if not starts:
                held.append(batch)
                continue
            rows = solve(pd.concat([*held, batch.iloc[: starts[0]]], ignore_index=True)) if held else []
            rows += [r for a, b in zip(starts, starts[1:], strict=False) for r in solve(batch.iloc[a:b])]
            held, last = [batch.iloc[starts[-1] :]], own[-1]
            yield pd.DataFrame(rows, columns=columns)
        if held:
            yield pd.DataFrame(solve(pd.concat(held, ignore_index=True)), columns=columns)

    columns = StructType.fromDDL(schema).names
    dealt = df.repartition(*([parts] if parts else []), *keys) if keys else df.coalesce(1)
    return dealt.sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _plain(values: pd.Series) -> list:
    """A column's values with None for what is missing; structs, which come as dictionaries, by their text."""
    return [None if v is None or v != v else str(v) if isinstance(v, (dict, tuple, list, np.ndarray)) else v for v in values.tolist()]


#: Frames of up to so many edges are solved whole; larger ones are first split into connected groups.
WHOLE = 2000


def match(candidates: DataFrame, keys: list[str], left: str, right: str, cost: str = "cost", threshold: float | None = None, whole: int = WHOLE) -> DataFrame:
    """(keys, left, right, cost): of each group's candidate pairs as many as possible, each id once a side, and of those the cheapest.

    Pairs that are absent, of unknown cost or not below the threshold are not allowed. Repeated pairs count once, at their least cost.
    A group with more than ``whole`` pairs falls into its connected groups of pairs, found by Spark, and each of these is solved alone
    by its edges: no dense matrix, and no group is bounded by a task but a connected one.
    """
    kinds = dict(candidates.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, left, right]) + f", `{cost}` double"
    c = F.col(cost).cast("double")
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) & F.col(left).isNotNull() & F.col(right).isNotNull()
    edges = candidates.where(ok & (c < threshold) if threshold is not None else ok).groupBy(*keys, left, right).agg(F.min(c).alias(cost))
    edges = written(edges)
    count = edges.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > whole)
    same = [edges[k].eqNullSafe(count[k]) for k in keys]
    names = [*keys, left, right, cost]

    def solve(df: pd.DataFrame) -> list[tuple]:
        chosen = df.iloc[sparse_assignment(df[left].to_numpy(), df[right].to_numpy(), df[cost].to_numpy(float))]
        return list(chosen[names].astype(object).where(chosen[names].notna(), None).itertuples(index=False, name=None))

    large = edges.join(count, same, "left_semi") if keys else edges.where(F.lit(edges.count() > whole))
    small = edges.join(count, same, "left_anti") if keys else edges.where(F.lit(edges.count() <= whole))
    found = by_group(small.select(*names), keys, [left, right], solve, schema)
    if large.isEmpty():
        return found
    node = lambda side, i: F.struct(*[F.col(k) for k in keys], F.lit(side).alias("__side"), F.col(i).cast("string").alias("__id"))
    linked = large.select("*", node(0, left).alias("a"), node(1, right).alias("b"))
    roots = components(linked.select("a", "b"))
    grouped = linked.join(roots, linked["a"] == roots["node"]).select(*names, "root")
    return found.unionByName(by_group(grouped, ["root"], [left, right], solve, schema))


def hand_candidates(wrists: DataFrame, hands: DataFrame, keys: list[str], reach: float = 100.0) -> DataFrame:
    """Pairs of a wrist (wrist_id, wx, wy, mid_x, mid_y) and a hand (hand_id, hx, hy) closer than reach and nearer to the wrist than to the shoulders' middle."""
    cost = F.sqrt(F.pow(F.col("wx") - F.col("hx"), 2) + F.pow(F.col("wy") - F.col("hy"), 2))
    middle = F.sqrt(F.pow(F.col("mid_x") - F.col("hx"), 2) + F.pow(F.col("mid_y") - F.col("hy"), 2))
    return wrists.join(hands, keys).withColumn("cost", cost).where((F.col("cost") < reach) & (F.coalesce(F.col("cost") < middle, F.lit(True))))


def match_hands(wrists: DataFrame, hands: DataFrame, keys: list[str], reach: float = 100.0) -> DataFrame:
    """(keys, wrist_id, hand_id, cost): the candidates of ``hand_candidates``, one hand a wrist and one wrist a hand, as many and then as near as possible."""
    return match(hand_candidates(wrists, hands, keys, reach), keys, "wrist_id", "hand_id")


def without_overlap(candidates: DataFrame, kept: DataFrame, keys: list[str], near: float = 0.1) -> DataFrame:
    """candidates (cx, cy) with no kept detection of the same group within a distance. Grid cells are joined, not whole groups."""
    k = kept.select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("cx").alias("__cx"), F.col("cy").alias("__cy"))
    k = spread(k, ["__cx", "__cy"], near, ["__i", "__j"])
    close = F.pow(F.col("cx") - F.col("__cx"), 2) + F.pow(F.col("cy") - F.col("__cy"), 2) < near * near
    i, j = cells(["cx", "cy"], near)
    same = [F.col(c) == F.col(f"__{c}") for c in keys]
    return candidates.join(k, [*same, i == F.col("__i"), j == F.col("__j"), close], "left_anti")


def suppress(boxes: np.ndarray, scores: np.ndarray, limit: float, weighted: bool) -> list[tuple[np.ndarray, float, list[int]]]:
    """Greedy clusters by falling score: (values, score, members). boxes may hold more values after x1, y1, x2, y2; a weighted
    cluster's are its members' score-weighted mean, plain if the weights sum to nothing. Sides below 0 are 0."""
    if len(scores) == 1:
        return [(boxes[0], float(scores[0]), [0])]
    left, out = list(np.argsort(-scores, kind="stable")), []
    while left:
        top, some = boxes[left[0], :4], boxes[left][:, :4]
        w = np.clip(np.minimum(top[2:], some[:, 2:]) - np.maximum(top[:2], some[:, :2]), 0, None).prod(1)
        area = np.clip(some[:, 2:] - some[:, :2], 0, None).prod(1)
        union = area[0] + area - w
        close = np.where(union > 0, w / np.where(union > 0, union, 1), 0) > limit
        close[0] = True
        members = [int(i) for i, c in zip(left, close, strict=True) if c]
        weights = scores[members]
        if not (np.isfinite(weights.sum()) and weights.sum() > 0):
            weights = np.ones(len(members))
        out.append((np.average(boxes[members], axis=0, weights=weights) if weighted else boxes[members[0]], float(scores[members[0]]), members))
        left = [i for i, c in zip(left, close, strict=True) if not c]
    return out


def non_maximum_suppression(df: DataFrame, keys: list[str], limit: float = 0.3, weighted: bool = True, also: list[str] = ()) -> DataFrame:
    """(keys, x1, y1, x2, y2, also, score, members) of each group's clusters of overlapping boxes (det_id, x1, y1, x2, y2, score);
    also: columns such as keypoint coordinates that are merged with the boxes. A group is a frame."""
    kinds = dict(df.dtypes)
    values = ["x1", "y1", "x2", "y2", *also]
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + "".join(f", `{c}` double" for c in values) + ", score double, members int"

    def solve(g: pd.DataFrame) -> list[tuple]:
        boxes, scores = g[values].to_numpy(float), g["score"].to_numpy(float)
        own = tuple(_plain(g[k])[0] for k in keys)
        return [(*own, *map(float, b), s, len(m)) for b, s, m in suppress(boxes, scores, limit, weighted)]

    return by_group(df.select(*keys, "det_id", *values, "score"), keys, ["det_id"], solve, schema)


def savgol_coefficients(window: int, order: int, at: int | None = None) -> np.ndarray:
    """Weights of a least-squares polynomial over a window, evaluated at one of its places (the middle)."""
    x = np.arange(window) - (window // 2 if at is None else at)
    return np.linalg.pinv(np.vander(x, order + 1, increasing=True))[0]


def savgol(values: np.ndarray, window: int = 11, order: int = 3) -> np.ndarray:
    """Savitzky-Golay smoothing of one series; the ends are the end windows' polynomials. Inner gaps of up to half a window are
    filled on a line and smoothed, longer ones split the series; a short segment takes the largest odd window that fits it."""
    y = values.astype(float).copy()
    known = np.flatnonzero(np.isfinite(y))
    if not len(known):
        return y
    gaps = np.diff(known) - 1
    for a, g in zip(known[:-1], gaps, strict=True):
        if 0 < g <= max(1, window // 2):
            y[a : a + g + 2] = np.interp(np.arange(g + 2), [0, g + 1], [y[a], y[a + g + 1]])
    ok = np.concatenate([[False], np.isfinite(y), [False]]).astype(int)
    for a, b in zip(np.flatnonzero(np.diff(ok) == 1), np.flatnonzero(np.diff(ok) == -1), strict=True):
        n = b - a
        w = min(window, n if n % 2 else n - 1)
        if w < order + 2:
            continue
        seg, h = y[a:b].copy(), w // 2
        y[a + h : b - h] = np.convolve(seg, savgol_coefficients(w, order)[::-1], "valid")
        for k in range(h):
            y[a + k] = savgol_coefficients(w, order, k) @ seg[:w]
            y[b - 1 - k] = savgol_coefficients(w, order, w - 1 - k) @ seg[-w:]
    y[~np.isfinite(y)] = np.nan
    return y


def savgol_series(df: DataFrame, keys: list[str], order_by: list[str], columns: list[str], window: int = 11, order: int = 3, evidence: dict[str, str] | None = None) -> DataFrame:
    """df with the columns smoothed series by series (as ``savgol`` does it), all other columns as they are.

    evidence: the column that tells whether a coordinate was observed; where it is not a number above 0, or the coordinate is not
    finite, the coordinate is missing. Window functions only: a row sees ``window`` - 1 neighbours on either side and the distances to the
    ends of its gap or segment, so a series of any length streams through its task.
    """
    if window % 2 == 0 or order >= window:
        raise ValueError(f"window must be odd and above the order, got {window} and {order}")
    evidence = evidence or {}
    by = [F.col(c) for c in order_by]
    up = Window.partitionBy(*keys).orderBy(*by)
    down = Window.partitionBy(*keys).orderBy(F.col("__i").desc())
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(Window.unboundedPreceding, -1)
    most = max(1, window // 2)

    def seen(c: str) -> Column:
        v = F.col(c).cast("double")
        ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        if c in evidence:
            e = F.col(evidence[c]).cast("double")
            ok &= F.coalesce(e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")) & (e > 0), F.lit(False))
        return F.when(ok, v)

    at = lambda c: F.when(F.col(f"__v_{c}").isNotNull(), F.struct(F.col("__i").alias("i"), F.col(f"__v_{c}").alias("v")))
    x = df.withColumn("__i", F.row_number().over(up)).withColumns({f"__v_{c}": seen(c) for c in columns})
    x = x.withColumns({f"__p_{c}": F.last(at(c), True).over(before) for c in columns})
    x = x.withColumns({f"__n_{c}": F.last(at(c), True).over(after) for c in columns})

    def filled(c: str) -> Column:
        p, n = F.col(f"__p_{c}"), F.col(f"__n_{c}")
        line = p["v"] + (n["v"] - p["v"]) * (F.col("__i") - p["i"]) / (n["i"] - p["i"])
        return F.coalesce(f"__v_{c}", F.when(n["i"] - p["i"] - 1 <= most, line))

    x = x.withColumns({f"__v_{c}": filled(c) for c in columns}).drop(*[f"__{k}_{c}" for c in columns for k in "pn"])
    gone = lambda c: F.when(F.col(f"__v_{c}").isNull(), F.col("__i"))
    x = x.withColumns({f"__n_{c}": F.min(gone(c)).over(after) for c in columns}).withColumn("__rows", F.max("__i").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    around = F.collect_list(F.struct("__i", *[f"__v_{c}" for c in columns])).over(up.rowsBetween(1 - window, window - 1))
    x = x.withColumns({f"__p_{c}": F.max(gone(c)).over(before) for c in columns}).withColumn("__around", around)
    table = [[[float(a) for a in savgol_coefficients(w, order, k)] for k in range(w)] for w in range(1, window + 1, 2) if w >= order + 2 or w == window]
    weights = F.array(*[F.array(*[F.array(*[F.lit(a) for a in row]) for row in w]) for w in table])
    first = min(len(w) for w in table)

    def smooth(c: str) -> Column:
        start = F.coalesce(F.col(f"__p_{c}"), F.lit(0)) + 1
        n = F.coalesce(F.col(f"__n_{c}"), F.col("__rows") + 1) - start
        w = F.least(F.lit(window), n - F.when(n % 2 == 0, 1).otherwise(0))
        s = F.greatest(start, F.least(F.col("__i") - F.floor(w / 2).cast("int"), start + n - w))
        row = F.get(F.get(weights, ((w - first) / 2).cast("int")), F.col("__i") - s)
        part = F.slice("__around", s - F.col("__around")[0]["__i"] + 1, w)
        total = F.aggregate(F.zip_with(part, row, lambda p, a: p[f"__v_{c}"] * a), F.lit(0.0), lambda a, b: a + b)
        v = F.col(f"__v_{c}")
        return F.when(v.isNotNull() & (w >= first), total).otherwise(v).cast(dict(df.dtypes)[c])

    return x.withColumns({c: smooth(c) for c in columns}).select(*df.columns)


def clamp_joint(points: np.ndarray, proximal: int, joint: int, distal: int, branch: list[int], low: float, high: float) -> tuple[np.ndarray, bool]:
    """Points with the distal branch turned rigidly about a joint so that its angle lies within limits; whether it had to."""
    p = points.copy()
    a, b = p[proximal, :2] - p[joint, :2], p[distal, :2] - p[joint, :2]
    if not np.isfinite([*a, *b]).all() or min(np.hypot(*a), np.hypot(*b)) < 1e-9:
        return p, False
    angle = np.degrees(np.arctan2(a[0] * b[1] - a[1] * b[0], a @ b))
    wanted = np.clip(abs(angle), low, high)
    if abs(wanted - abs(angle)) < 1e-12:
        return p, False
    turn = np.radians((1 if angle >= 0 else -1) * wanted - angle)
    r = np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])
    for i in branch:
        p[i, :2] = p[joint, :2] + r @ (p[i, :2] - p[joint, :2])
    return p, True


def clamp_joints(df: DataFrame, points: str, limits: list[tuple[int, int, int, list[int], float, float]]) -> DataFrame:
    """df with its array of points (structs x, y, z) clamped joint after joint, and the number of ``clamps``. Limits are
    (proximal, joint, distal, branch, least and most degrees); the rule is that of ``clamp_joint``, as one fold over the limits."""
    rules = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(j).alias("j"), F.lit(d).alias("d"), F.array(*[F.lit(k) for k in branch]).alias("branch"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high")) for a, j, d, branch, low, high in limits])

    def let(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def finite(c: Column) -> Column:
        return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))

    def turned(state: Column, rule: Column) -> Column:
        p = state["points"]
        at = lambda k: F.get(p, k)
        arm = lambda k, c: at(rule[k])[c].cast("double") - at(rule["j"])[c].cast("double")
        arms = F.struct(*[arm(k, c).alias(f"{k}{c}") for k in "ad" for c in "xy"])

        def by_arms(v: Column) -> Column:
            known = finite(v["ax"]) & finite(v["ay"]) & finite(v["dx"]) & finite(v["dy"])
            long = F.least(F.hypot(v["ax"], v["ay"]), F.hypot(v["dx"], v["dy"])) >= 1e-9
            angle = F.degrees(F.atan2(v["ax"] * v["dy"] - v["ay"] * v["dx"], v["ax"] * v["dx"] + v["ay"] * v["dy"]))
            return F.when(known & long, angle)

        def by_angle(v: Column) -> Column:
            wanted = F.greatest(rule["low"], F.least(rule["high"], F.abs(v)))
            return F.when(F.abs(wanted - F.abs(v)) >= 1e-12, F.radians(F.when(v >= 0, wanted).otherwise(-wanted) - v))

        def move(turn: Column) -> Column:
            j = at(rule["j"])
            dx, dy = (lambda q: q["x"].cast("double") - j["x"]), (lambda q: q["y"].cast("double") - j["y"])

            def one(q: Column, k: Column) -> Column:
                x = j["x"] + F.cos(turn) * dx(q) - F.sin(turn) * dy(q)
                y = j["y"] + F.sin(turn) * dx(q) + F.cos(turn) * dy(q)
                here = F.array_contains(rule["branch"], k)
                return F.struct(*[(F.when(here, {"x": x, "y": y}[f]).otherwise(q[f]) if f in ("x", "y") else q[f]).cast(kinds[f]).alias(f) for f in kinds])

            moved = F.struct(F.transform(p, one).alias("points"), (state["clamps"] + 1).alias("clamps"))
            return F.when(turn.isNull(), state).otherwise(moved)

        return let(let(let(arms, by_arms), by_angle), move)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema[points].dataType.elementType.fields}
    kind = f"struct<points: {df.schema[points].dataType.simpleString()}, clamps: int>"
    start = F.struct(F.col(points).alias("points"), F.lit(0).alias("clamps")).cast(kind)
    found = df.withColumn("__c", F.aggregate(rules, start, lambda s, r: turned(s, r).cast(kind)))
    return found.withColumns({points: F.col("__c.points"), "clamps": F.col("__c.clamps")}).drop("__c")
