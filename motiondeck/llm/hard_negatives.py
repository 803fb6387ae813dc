"""Hard negatives: rows of another label that score between half and nineteen twentieths of a positive.

A row's vector is floor(256 x) of each component; its score with an anchor is their integer inner product. Every
(anchor, positive) asks for the best different-label rows within the window of scores
``least`` * positive <= 100 * score <= ``most`` * positive.

Inverted multi-index: two codebooks, one a half of the dimensions (k-means in numpy over the ``SAMPLE`` rows of
smallest hash), give each row a cell, the pair of its nearest centroids. Rows are sorted by cell, equal
cells dealt by hash, and written as shards of at most ``SHARD`` rows with the radius of every half-cell. For an
anchor a half-cell's members score at most a.c + |a| r; a heap visits cells by the sum of both
bounds, best first (multi-sequence), and stops once the next sum is below what every window still
needs: the rows it has are then certified. Cells whose least score is above all windows are passed by.
What the sample itself holds gives each search a first floor, so shards without good rows end at once.

The anchors are a fixed share of the rows and come in blocks of ``BLOCK``; each block meets each shard once,
which is the work asked for (all anchors against all rows), never pairs of rows as rows of Spark. Results of
shards are merged by a window over an anchor.

Rows with a null label, a null vector or a null or non-finite component take no part, nor do those with a null vec_id; of
rows that repeat a vec_id the one with the smallest (label, vector) takes part. Shorter vectors are as if filled up with zeros.
An anchor without other rows of its label, or a positive whose window is empty (its score below 0, for instance), returns
nothing. Scores are exact while dimensions times the squared largest component stay below 2^63. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motiondeck.llm.chunks import new_ids, pack, unpack
from motiondeck.llm.common import materialize, shuffle_parts, table

#: Rows that codebooks are fitted on, centroids of a half, rows in a shard, anchors in a block, rows scored at a time.
SAMPLE, CENTROIDS, SHARD, BLOCK, STEP = 4096, 16, 16384, 256, 512


def taking_part(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector of integers) of the rows that take part."""
    x = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    whole = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = x.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & whole)
    x = x.select("vec_id", "label", F.transform("x", lambda v: F.floor(v * 256).cast("bigint")).alias("v"))
    x = x.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    return x.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim), np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    at = np.repeat(np.arange(len(column)), lengths)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def codebook(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Centroids by k-means, begun at evenly spaced rows in the order of their projection on the widest axis."""
    x = x.astype(np.float64)
    if not len(x):
        return np.zeros((1, x.shape[1]))
    order = np.argsort(x[:, int(x.var(axis=0).argmax())] if x.shape[1] else np.zeros(len(x)), kind="stable")
    c = x[order[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]]
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)


class Shard:
    """Rows by cell, and the radius of each half-cell's members about its centroid."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> None:
        half = v.shape[1] // 2
        self.books, self.half = books, half
        parts = (v[:, :half].astype(np.float64), v[:, half:].astype(np.float64))
        cells = [nearest(x, c) for x, c in zip(parts, books, strict=True)]
        code = cells[0] * len(books[1]) + cells[1]
        by = np.lexsort((ids, code))
        self.ids, self.labels, self.v = ids[by], labels[by], v[by]
        self.top = float(np.abs(v).max(initial=0))
        self.doubles = self.v.astype(np.float64)
        self.starts = np.searchsorted(code[by], np.arange(len(books[0]) * len(books[1]) + 1))
        self.radii = []
        for x, c, cell in zip(parts, books, cells, strict=True):
            far = np.zeros(len(c))
            np.maximum.at(far, cell, np.sqrt(((x - c[cell]) ** 2).sum(axis=1)))
            self.radii.append(far)

    def visits(self, anchor: np.ndarray) -> Iterator[tuple[float, float, int, int]]:
        """(most, least, first row, end) of the cells with members, by the most that a member can score.

        Most and least allow for rounding: bounds are loosened by a part in 10^9.
        """
        mids, slack = [], []
        for x, c, r in zip((anchor[: self.half], anchor[self.half :]), self.books, self.radii, strict=True):
            x = x.astype(np.float64)
            mid, room = c @ x, np.sqrt(x @ x) * r
            slop = 1e-9 * (np.abs(mid) + room) + 1e-6
            mids.append(mid)
            slack.append(room + slop)
        order = [np.argsort(-(m + s), kind="stable") for m, s in zip(mids, slack, strict=True)]
        high = [(m + s)[o] for m, s, o in zip(mids, slack, order, strict=True)]
        low = [(m - s)[o] for m, s, o in zip(mids, slack, order, strict=True)]
        n, width = (len(high[0]), len(high[1])), len(self.books[1])
        heap, met = [(-(high[0][0] + high[1][0]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            cell = int(order[0][i]) * width + int(order[1][j])
            a, b = int(self.starts[cell]), int(self.starts[cell + 1])
            if b > a:
                yield -bound, float(low[0][i] + low[1][j]), a, b
            for p, q in ((i + 1, j), (i, j + 1)):
                if p < n[0] and q < n[1] and (p, q) not in met:
                    met.add((p, q))
                    heapq.heappush(heap, (-(high[0][p] + high[1][q]), p, q))

    def search(self, anchor: np.ndarray, anchor_id: int, anchor_label: int, same: bool, windows: list[tuple[int, int]], floors: list[int], k: int) -> list[list[tuple[int, int]]]:
        """For each window (least, most), its first k rows (score, id) of the same or of other labels that reach its floor."""
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        need = [max(lo, floor) for (lo, _), floor in zip(windows, floors, strict=True)]
        top = max((hi for lo, hi in windows if lo <= hi), default=None)
        if top is None:
            return found
        # through doubles where no sum can leave their whole numbers
        exact = self.top * float(np.abs(anchor).max(initial=0)) * max(1, len(anchor)) < 2**53
        spans: list[tuple[int, int]] = []
        size = 0

        def score() -> None:
            nonlocal spans, size
            at = np.concatenate([np.arange(a, b) for a, b in spans])
            spans, size = [], 0
            at = at[((self.labels[at] == anchor_label) == same) & (self.ids[at] != anchor_id)]
            s = (self.doubles[at] @ anchor.astype(np.float64)).astype(np.int64) if exact else self.v[at] @ anchor
            ids = self.ids[at]
            for w, (_, hi) in enumerate(windows):
                ok = (s >= need[w]) & (s <= hi)
                if ok.any():
                    best = found[w] + list(zip((-s[ok]).tolist(), ids[ok].tolist(), strict=True))
                    found[w] = heapq.nsmallest(k, best)
                    if len(found[w]) == k:
                        need[w] = max(need[w], -found[w][-1][0])

        for most, least, a, b in self.visits(anchor):
            if most < min(n for n, (lo, hi) in zip(need, windows, strict=True) if lo <= hi):
                break
            if least > top:
                continue
            spans.append((a, b))
            size += b - a
            if size >= STEP:
                score()
        if spans:
            score()
        return [[(-s, i) for s, i in x] for x in found]


def squeeze(v: np.ndarray) -> bytes:
    """Signed integers, small ones first in size: 0, -1, 1, -2 and so on, packed."""
    v = v.ravel()
    return pack((v << 1) ^ (v >> 63))


def unsqueeze(data: bytes, dim: int) -> np.ndarray:
    z = unpack(data)
    return ((z >> 1) ^ -(z & 1)).reshape(-1, dim) if dim else np.zeros((len(z), 0), np.int64)


_SHARD = "shard bigint, vec_ids array<bigint>, labels array<bigint>, v binary"
_BLOCK = "block bigint, vec_ids array<bigint>, labels array<bigint>, v binary, wanted array<array<bigint>>"


def _packed(dim: int, most: int, number: str, wanted: bool):
    """The rows of a partition in rows of lists, at most ``most`` in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, size = new_ids(), [], 0

        def out(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            cells = [pa.array([next(numbers)], pa.int64()), *(pa.array([t.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("vec_id", "label"))]
            cells.append(pa.array([squeeze(matrix(t.column("v").chunk(0), dim))], pa.binary()))
            names = [number, "vec_ids", "labels", "v"]
            if wanted:
                cells, names = [*cells, pa.array([t.column("wanted").to_pylist()], pa.list_(pa.list_(pa.int64())))], [*names, "wanted"]
            return pa.RecordBatch.from_arrays(cells, names=names)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            while size >= most:
                t = pa.Table.from_batches(held)
                yield out(t.slice(0, most))
                held, size = t.slice(most).to_batches(), size - most
        if size:
            yield out(pa.Table.from_batches(held))

    return run


class Index:
    """The inverted multi-index of all rows: codebooks, the sample they were fitted on, and shards."""

    def __init__(self, rows: DataFrame, *, shard: int = SHARD, block: int = BLOCK, sample: int = SAMPLE, centroids: int = CENTROIDS) -> None:
        self.block = block
        found = rows.agg(F.max(F.size("v")), F.count("*")).first()
        self.dim, count = found[0] or 0, found[1]
        some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().combine_chunks()
        x = matrix(some.column("v").chunk(0), self.dim) if some.num_rows else np.zeros((0, self.dim), np.int64)
        half = self.dim // 2
        self.books = (codebook(x[:, :half], centroids), codebook(x[:, half:], centroids))
        self.sample = (some.column("vec_id").to_numpy(), some.column("label").to_numpy(), x)
        books, dim = self.books, self.dim

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = matrix(batch.column("v"), dim).astype(np.float64)
                code = nearest(v[:, :half], books[0]) * len(books[1]) + nearest(v[:, half:], books[1])
                yield batch.append_column("cell", pa.array(code.astype(np.int32), pa.int32()))

        placed = rows.mapInArrow(cells, "vec_id bigint, label bigint, v array<bigint>, cell int")
        # equal cells are dealt by hash: one cell with a third of the rows is many partitions' work
        placed = placed.repartitionByRange(max(1, -(-count // (2 * shard))), "cell", F.xxhash64("vec_id")).sortWithinPartitions("cell")
        packed = materialize(placed.mapInArrow(_packed(dim, shard, "shard", False), _SHARD))
        #: A block of anchors is sent once to each lane, and meets the lane's few shards there.
        self.lanes = max(shuffle_parts(rows.sparkSession), -(-packed.count() // 4))
        self.shards = packed.withColumn("lane", F.pmod(F.xxhash64("shard"), F.lit(self.lanes)))

    def search(self, anchors: DataFrame, count: int, same: bool, k: int) -> DataFrame:
        """anchors: vec_id, label, v, wanted (least and most of each window in turn). Returns every shard's (anchor_id, window, other_id, score)."""
        dim, books, sample = self.dim, self.books, self.sample

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: tuple[int, Shard | None] = (-1, None)
            some = Shard(*sample, books)
            floors: dict[int, list[list[int]]] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    if row["shard"] != known[0]:
                        known = (row["shard"], Shard(np.array(row["s_ids"], np.int64), np.array(row["s_labels"], np.int64), unsqueeze(row["s_v"], dim), books))
                    v, out = unsqueeze(row["v"], dim), []
                    windows = [list(zip(w[::2], w[1::2], strict=True)) for w in row["wanted"]]
                    if row["block"] not in floors:
                        if len(floors) >= 64:
                            floors.clear()
                        first = [some.search(x, i, lab, same, w, [lo for lo, _ in w], k) for x, i, lab, w in zip(v, row["vec_ids"], row["labels"], windows, strict=True)]
                        floors[row["block"]] = [[f[-1][0] if len(f) == k else lo for f, (lo, _) in zip(fs, w, strict=True)] for fs, w in zip(first, windows, strict=True)]
                    for x, i, lab, w, least in zip(v, row["vec_ids"], row["labels"], windows, floors[row["block"]], strict=True):
                        for n, best in enumerate(known[1].search(x, i, lab, same, w, least, k)):
                            out += [(i, n, other, score) for score, other in best]
                    columns = list(zip(*out, strict=True)) or [[]] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["anchor_id", "window", "other_id", "score"])

        spread = anchors.select("vec_id", "label", "v", "wanted").repartition(max(1, -(-count // (4 * self.block))))
        blocks = materialize(spread.mapInArrow(_packed(dim, self.block, "block", True), _BLOCK))
        sent = blocks.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(self.lanes - 1)).cast("array<bigint>")))
        shards = self.shards.select("lane", "shard", F.col("vec_ids").alias("s_ids"), F.col("labels").alias("s_labels"), F.col("v").alias("s_v"))
        return shards.join(sent.hint("merge"), "lane").mapInArrow(run, "anchor_id bigint, window int, other_id bigint, score bigint")


def first_rows(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each (anchor_id, window) over all shards, with their rank."""
    w = Window.partitionBy("anchor_id", "window").orderBy(F.col("score").desc(), "other_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame, *, anchors_every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, **sizes: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    part = materialize(taking_part(rows))
    index = Index(part, **sizes)
    anchors = part.where(F.col("vec_id") % anchors_every == 0)
    count = anchors.count()
    every = F.array(F.lit(-(2**63) + 1), F.lit(2**63 - 1))
    chosen = materialize(first_rows(index.search(anchors.withColumn("wanted", every), count, True, positives), positives))
    asked = chosen.groupBy("anchor_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda r: window_of(r["score"], least, most))).alias("wanted"))
    asked = anchors.join(asked, anchors["vec_id"] == asked["anchor_id"]).drop("anchor_id")
    found = first_rows(index.search(asked, count, False, negatives), negatives)
    found = found.select("anchor_id", (F.col("window") + 1).alias("nth"), "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    chosen = chosen.select("anchor_id", F.col("rank").alias("nth"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(chosen, ["anchor_id", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def window_of(score: Column, least: int, most: int) -> Column:
    """The least and the most whole score s with least * score <= 100 s <= most * score."""
    whole = lambda c: (c - F.pmod(c, F.lit(100))).cast("bigint")
    return F.array(F.call_function("div", whole(score * least + 99), F.lit(100)), F.call_function("div", whole(score * most), F.lit(100)))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


ORACLE = """
WITH rows_ AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(v AS DOUBLE[]) AS v
    FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY label, v) AS nth FROM rows_) WHERE nth = 1
), met AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM part a JOIN part b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positive AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM met WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
    other_id AS negative_id, positive_score, score AS negative_score
FROM positive p JOIN met n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
