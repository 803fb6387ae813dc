"""Deleted interpolation: a bigram model whose estimates are mixed by context frequency.

    P(w | u) = l2(b) c(u, w) / c(u) + l1(b) c(w) / N + l0(b) / (V + 1)        b: bucket of c(u)

Tokens are the words of a text, A-Z lower-cased, and one end token, which is also the context of the first
word. A bucket is a power of two of the context's count; the first is that of contexts never seen. The
weights of a bucket are those that expectation-maximisation finds for held-out counts: one in
``deleted`` training documents (by hash of doc_id) is deleted from the counts while weights are
learned, and counts again when texts are scored. Each weight has one pseudo-count, so none is zero and
every text has a finite score. For learning alone, probabilities are gathered in cells of a quarter of
a power of two, each with its mean: the table that a bucket is learned from has a bounded size.

How it runs: a pass over the texts turns words into 64-bit hashes and writes chunks of documents
(``CHUNK`` tokens, or one longer document). A chunk sends each distinct word and bigram once, with its
count; hashes are dealt out by range; what a chunk gets back are only the totals that differ from its own
counts. No table of words is broadcast, and a frequent word is one entry a chunk. Only the weights, N and V
reach the driver. Memory: a chunk, a part of ``PART`` keys, one document's tokens.

Null or empty texts are the end token alone. Rows that repeat a doc_id count and are scored each. A null
doc_id is scored (``held_out`` null) but never learned from. Other columns are not read. Without training
documents N = V = 0: base_score and add_one are 0 and score is log10 of what the weights leave to unknown words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motiondeck.llm.chunks import new_ids, pack, sums, unpack
from motiondeck.llm.common import fold, materialize, mix64, shuffle_parts, table

#: Tokens in a chunk, keys in a part, bytes of text hashed at a time.
CHUNK, PART, SLICE = 1 << 20, 1 << 22, 1 << 21
#: Roles of documents: their counts stay, are deleted while weights are learned, or are never learned from.
STAYS, DELETED, SCORED = 0, 1, 2
BUCKETS = 42

_ODD = 0x9E3779B97F4A7C15
END = np.uint64(1)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = mix64((np.arange(256) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90))).astype(np.uint64) + np.uint64(_ODD))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordHash:
    """64-bit hashes of the words of UTF-8 texts: a polynomial in an odd base, taken from running sums."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def words(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, position of its first byte) of every word; ``first`` marks bytes that begin a text."""
        n = len(data)
        if n > len(self.up):
            self.up, self.down = _powers(_ODD, n), _powers(pow(_ODD, -1, 1 << 64), n)
        solid = ~_WHITE[data]
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1] | first[1:]
        ends[:-1] &= ~solid[1:] | first[1:]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * self.up[:n], dtype=np.uint64)])
        return mix64((total[e] - total[s]) * self.down[s] + (e - s).astype(np.uint64)), s

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The word hashes of all texts in turn, and how many each text has. Long texts are cut at white space."""
        column = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        counts, found, at, end = np.zeros(len(column), np.int64), [], int(offsets[0]), int(offsets[-1])
        while at < end:
            stop = min(end, at + SLICE)
            if stop < end:  # back to a text's end or white space, else on to the next
                cut = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
                if cut <= at:
                    white = np.flatnonzero(_WHITE[data[at:stop]])
                    cut = at + int(white[-1]) + 1 if len(white) else self._next_cut(data, offsets, stop, end)
                stop = cut
            first = np.zeros(stop - at, dtype=bool)
            inside = offsets[(offsets >= at) & (offsets < stop)] - at
            first[inside] = True
            hashes, s = self.words(data[at:stop], first)
            found.append(hashes)
            counts += np.bincount(np.searchsorted(offsets, s + at, "right") - 1, minlength=len(counts))[: len(counts)]
            at = stop
        return np.concatenate(found) if found else np.zeros(0, np.uint64), counts

    @staticmethod
    def _next_cut(data: np.ndarray, offsets: np.ndarray, start: int, end: int) -> int:
        limit = int(offsets[np.searchsorted(offsets, start, "left")])
        while start < limit:
            white = np.flatnonzero(_WHITE[data[start : min(limit, start + SLICE)]])
            if len(white):
                return start + int(white[0]) + 1
            start += SLICE
        return min(limit, end)


_CHUNK = "chunk bigint, deleted boolean, ids array<bigint>, roles array<int>, lengths array<bigint>, words binary, tokens binary, n_words bigint, n_tokens bigint, n_learned bigint"
_CHUNK_NAMES = [c.split(" ")[0] for c in _CHUNK.split(", ")]


def _chunk_row(chunk: int, deleted: bool, ids: list, roles: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    stream = np.insert(hashes, np.cumsum(lengths), END)
    lengths = lengths + 1
    words, tokens = np.unique(stream, return_inverse=True)
    learned = int(lengths[roles != SCORED].sum())
    row = [[chunk], [deleted], [ids], [roles.tolist()], [lengths.tolist()], [words.tobytes()], [pack(tokens)], [len(words)], [len(stream)], [learned]]
    kinds = [pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary(), *[pa.int64()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=_CHUNK_NAMES)


def _to_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers, hasher = new_ids(), WordHash()
    held: dict[bool, list] = {False: [], True: []}
    size = {False: 0, True: 0}

    def out(kind: bool) -> pa.RecordBatch:
        parts, held[kind], size[kind] = held[kind], [], 0
        ids = [i for p in parts for i in p[0]]
        return _chunk_row(next(numbers), kind, ids, *(np.concatenate([p[k] for p in parts]) for k in (1, 2, 3)))

    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            hashes, counts = hasher.texts(batch.column("text"))
            roles, ids = batch.column("role").to_numpy(), batch.column("doc_id")
            for kind in (False, True):
                mine = (roles == DELETED) == kind
                if mine.any():
                    held[kind].append((ids.filter(pa.array(mine)).to_pylist(), roles[mine], counts[mine], hashes[np.repeat(mine, counts)]))
                    size[kind] += int(counts[mine].sum()) + int(mine.sum())
                    if size[kind] >= CHUNK:
                        yield out(kind)
    for kind in (False, True):
        if held[kind]:
            yield out(kind)


def to_chunks(docs: DataFrame, *, parts: int = 7, held_out: int = 2, deleted: int = 16) -> DataFrame:
    place = fold(F.col("doc_id"), parts)
    role = F.when(place.isNull() | (place == held_out), SCORED).when(F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(deleted)) == 0, DELETED).otherwise(STAYS)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", role.alias("role")).mapInArrow(_to_chunks, _CHUNK)


class Chunk:
    """A chunk's tokens, distinct words and bigrams (by hash), and how often its own learned documents have them."""

    def __init__(self, row: dict) -> None:
        self.words = np.frombuffer(row["words"], np.uint64)
        self.tokens, self.lengths = unpack(row["tokens"]), np.array(row["lengths"], np.int64)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[:1] = np.searchsorted(self.words, END)  # every text ends with the end token, so it stands before the next
        self.before = before
        codes, self.pairs = np.unique(before * len(self.words) + self.tokens, return_inverse=True)
        left, right = np.divmod(codes, max(1, len(self.words)))
        self.pair_keys = mix64(self.words[left] * np.uint64(_ODD) + self.words[right])
        learned = np.repeat(np.array(row["roles"], np.int64) != SCORED, self.lengths)
        self.own = {1: np.bincount(self.tokens[learned], minlength=len(self.words)), 2: np.bincount(self.pairs[learned], minlength=len(codes))}
        self.keys = {1: self.words, 2: self.pair_keys}

    def dealt(self, order: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
        """(part, numbers of the keys that belong to it), always in the same order."""
        part = ((self.keys[order] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        bounds = np.flatnonzero(np.diff(part[by], prepend=-1))
        for a, b in zip(bounds, [*bounds[1:], len(by)], strict=True):
            yield int(part[by[a]]), by[a:b]


_KEYS = "part bigint, chunk bigint, order int, deleted boolean, keys binary, own binary"
_TOTALS = "chunk bigint, order int, part bigint, deleted boolean, at binary, total binary, stays binary, n_distinct bigint"
_TOTAL_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]


def _batch(columns: list, kinds: list, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split(" ")[0] for c in schema.split(", ")])


def _send(parts: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                for order in (1, 2):
                    rows = [(p * 2 + order - 1, row["chunk"], order, row["deleted"], chunk.keys[order][at].tobytes(), pack(chunk.own[order][at])) for p, at in chunk.dealt(order, parts[order])]
                    yield _batch(list(zip(*rows, strict=True)), [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()], _KEYS)

    return run


def _add_up(rows: pa.Table) -> pa.Table:
    """Totals of one part's keys; each chunk gets those that differ from what it would take for granted."""
    chunk, deleted, part = rows.column("chunk").to_pylist(), rows.column("deleted").to_pylist(), rows.column("part")[0].as_py()
    keys = [np.frombuffer(k.as_py(), np.uint64) for k in rows.column("keys")]
    own = [unpack(x.as_py()) for x in rows.column("own")]
    lengths = np.array([len(k) for k in keys])
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate(own)
    total = np.bincount(where, counts, len(distinct)).astype(np.int64)
    gone = np.bincount(where, counts * np.repeat(np.array(deleted), lengths), len(distinct)).astype(np.int64)
    out, order = [], part % 2 + 1
    for c, d, mine, n, k in zip(chunk, deleted, own, lengths, np.cumsum(lengths) - lengths, strict=True):
        t = total[where[k : k + n]]
        at = np.flatnonzero(t != mine)
        if len(at):
            out.append((c, order, part // 2, d, pack(at), pack(t[at]), pack((total - gone)[where[k : k + n]][at]) if d else None, None))
    out.append((None, order, part // 2, None, None, None, None, int((total > 0).sum())))
    return pa.Table.from_batches([_batch(list(zip(*out, strict=True)), _TOTAL_KINDS, _TOTALS)])


def totals(chunks: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    size = chunks.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    parts = {k: max(shuffle_parts(chunks.sparkSession), -(-(size[k - 1] or 0) // PART)) for k in (1, 2)}
    sent = chunks.mapInArrow(_send(parts), _KEYS)
    return materialize(sent.groupBy("part").applyInArrow(_add_up, _TOTALS)), parts


def _known(row: dict, found: list[dict], parts: dict[int, int], stays: bool) -> tuple[Chunk, np.ndarray, np.ndarray]:
    """The chunk with the counts of its words and bigrams in all learned documents, or in those that stay."""
    chunk = Chunk(row)
    got = {(r["order"], r["part"]): r for r in found}
    counts = {}
    for order in (1, 2):
        counts[order] = np.zeros_like(chunk.own[order]) if stays else chunk.own[order].copy()
        for part, at in chunk.dealt(order, parts[order]):
            if (r := got.get((order, part))) is not None:
                counts[order][at[unpack(r["at"])]] = unpack(r["stays" if stays else "total"])
    return chunk, counts[1], counts[2]


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 more than the whole part of its count's logarithm to base 2."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def _cell(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, 1 - np.floor(4 * np.log2(np.where(p > 0, p, 1))), 0).astype(np.int64)


def estimates(chunk: Chunk, c1: np.ndarray, c2: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, bigram estimate, word estimate) of every token."""
    context = c1[chunk.before]
    return bucket(context), c2[chunk.pairs] / np.maximum(context, 1), c1[chunk.tokens] / max(n, 1)


def _gather(parts: dict[int, int], n: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        codes, all_ = [], []
        for row in left.to_pylist():
            b, f2, f1 = estimates(*_known(row, right.to_pylist(), parts, True), n)
            codes.append((b * 1024 + _cell(f2)) * 1024 + _cell(f1))
            all_.append((f2, f1))
        code, at = np.unique(np.concatenate(codes or [np.zeros(0, np.int64)]), return_inverse=True)
        f2, f1 = (np.concatenate([x[k] for x in all_] or [np.zeros(0)]) for k in (0, 1))
        return pa.table({"bucket": code >> 20, "code": code, "n": np.bincount(at, minlength=len(code)), "s2": np.bincount(at, f2, len(code)), "s1": np.bincount(at, f1, len(code))})

    return run


def expect(n: np.ndarray, parts: np.ndarray, rounds: int = 500, least: float = 1e-9) -> np.ndarray:
    """Mixture weights by expectation-maximisation: parts has a row for each event, seen n times, a column for each estimate.

    Estimates that are zero for all events have no weight; the others have a pseudo-count of one.
    """
    may = parts.max(axis=0, initial=0) > 0
    weights = may / max(1, may.sum())
    for _ in range(rounds):
        share = parts * weights
        share = share / np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
        new = (n @ share + may) / (n.sum() + may.sum())
        if np.abs(new - weights).max() < least:
            return new
        weights = new
    return weights


def _learn(unknown: float):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("code")
        n = cells["n"].to_numpy(float)
        parts = np.column_stack([cells["s2"] / n, cells["s1"] / n, np.full(len(n), unknown)])
        l2, l1, l0 = expect(n, parts)
        return pd.DataFrame({"bucket": [int(cells["bucket"].iloc[0])], "l2": [l2], "l1": [l1], "l0": [l0]})

    return run


@dataclass
class Mixture:
    """``weights[b]``: (bigram, word, uniform) of bucket b; n tokens and v distinct ones learned from."""

    weights: np.ndarray
    n: int
    v: int


def mixture(rows: list, n: int, v: int) -> Mixture:
    """Buckets that no held-out context fell in take the weights of the nearest one below, or above, that has some."""
    weights = np.zeros((BUCKETS, 3))
    learned = sorted((r["bucket"], (r["l2"], r["l1"], r["l0"])) for r in rows)
    seen = [x for x in learned if x[0] > 0]
    unseen = next((w for b, w in learned if b == 0), None)
    if unseen is None:
        unseen = (0.0, 0.5, 0.5) if n else (0.0, 0.0, 1.0)
    weights[0] = unseen
    for b in range(1, BUCKETS):
        near = [w for k, w in seen if k <= b][-1:] or [w for _, w in seen][:1] or [(1 / 3, 1 / 3, 1 / 3)]
        weights[b] = near[0]
    return Mixture(weights, n, v)


_SCORES = "doc_id bigint, role int, n_tokens bigint, n_known bigint, base_score double, score double, add_one double"


def _score(parts: dict[int, int], model: Mixture):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            chunk, c1, c2 = _known(row, right.to_pylist(), parts, False)
            b, f2, f1 = estimates(chunk, c1, c2, model.n)
            w = model.weights[b]
            p = w[:, 0] * f2 + w[:, 1] * f1 + w[:, 2] / (model.v + 1)
            base = np.log10((c1 + 1) / ((model.n + 1) * (model.v + 1)))
            add_one = np.log10((c1 + 1) / (model.n + model.v + 1))
            # sums by text, not differences of running sums: their rounding does not depend on the chunk
            starts = np.cumsum(chunk.lengths) - chunk.lengths
            scores = [np.add.reduceat(x, starts) for x in (base[chunk.tokens], np.log10(p), add_one[chunk.tokens])]
            known = sums((c1 > 0).astype(np.int64)[chunk.tokens], chunk.lengths)
            out.append(pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "role": pa.array(row["roles"], pa.int32()), "n_tokens": chunk.lengths, "n_known": known, "base_score": scores[0], "score": scores[1], "add_one": scores[2]}))
        return pa.concat_tables(out) if out else pa.table({c.split(" ")[0]: pa.array([], k) for c, k in zip(_SCORES.split(", "), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()], strict=True)})

    return run


def score_texts(docs: DataFrame, *, parts: int = 7, held_out: int = 2, deleted: int = 16) -> tuple[DataFrame, Mixture]:
    """Scores of all rows by a model of those whose crc32(doc_id) mod ``parts`` is not ``held_out``, and the model.

    Two plain scores stand beside them: ``add_one`` is that of the add-one estimate, (c + 1) / (N + V + 1), which sums to one over all words and an
    unknown one; ``base_score`` divides by (N + 1)(V + 1) instead.
    """
    chunks = materialize(to_chunks(docs, parts=parts, held_out=held_out, deleted=deleted), keep=True)
    found, dealt = totals(chunks)
    n, n_stays = (x or 0 for x in chunks.agg(F.sum("n_learned"), F.sum(F.when(~F.col("deleted"), F.col("n_learned")))).first())
    v = found.where("chunk is null and order = 1").agg(F.sum("n_distinct")).first()[0] or 0
    found = found.where("chunk is not null").drop("n_distinct")

    def met(keep) -> object:
        return chunks.where(keep).groupBy("chunk").cogroup(found.where(keep).groupBy("chunk"))

    cells = met(F.col("deleted")).applyInArrow(_gather(dealt, n_stays), "bucket bigint, code bigint, n bigint, s2 double, s1 double")
    cells = cells.groupBy("bucket", "code").agg(*[F.sum(c).alias(c) for c in ("n", "s2", "s1")])
    rows = cells.groupBy("bucket").applyInPandas(_learn(1 / (v + 1)), "bucket bigint, l2 double, l1 double, l0 double").collect()
    model = mixture(rows, n, v)
    return met(F.lit(True)).applyInArrow(_score(dealt, model), _SCORES), model


def op11_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, model = score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    held_out = F.when(F.col("doc_id").isNotNull(), fold(F.col("doc_id"), 7) == 2)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("bigint").alias("train_tokens"), F.col("add_one").alias("base_score"), "score")
