"""Best-fit packing: documents into as few sequences of ``capacity`` tokens as best-fit finds.

A document is its token ids and one separator id. Longer ones are cut into pieces of the capacity, the
first piece taking what is over. Hierarchical residual packing: every partition packs its pieces
best-fit, longest first, and emits the bins that are nearly full; the underfull bins become items of the
next round, in an eighth of the partitions, and so on until one partition, or as many as ``most_items``
asks for, is left, which emits all. Ties go to the smaller (doc_id, piece).

Null texts are empty and consist of the separator alone. Rows that repeat a doc_id are packed each. A
piece never changes its length, so every token of every row is in exactly one sequence.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motiondeck.llm.common import materialize, table

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
BIN = "full boolean, fill int, members array<struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint>>"
#: The special tokens that ``byte_bpe_50k.json`` adds to the ranks.
SPECIAL = {"<|endoftext|>": 50256}
_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def encoder(ranks_path: str):
    """The byte-level BPE of a rank file; as in ``byte_bpe_50k.json``, the string of a special token in a text is that token."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: only the first may be shorter than the capacity, if there are more."""
    first = len(ids) % capacity or capacity
    if len(ids) <= capacity:
        return [(0, len(ids))]
    return [(0, first), *((at, capacity) for at in range(first, len(ids), capacity))]


def pieces(docs: DataFrame, *, capacity: int, ranks_path: str, separator: int = 0) -> DataFrame:
    """The pieces of every document, with the crc32 of their little-endian unsigned 32-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path).encode_to_numpy
        for batch in batches:
            out = []
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encode(t or "", allowed_special="all").astype("<u4"), np.array([separator], "<u4"))
                out += [(d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(ids, capacity))]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PIECE)


def best_fit(fills: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, in the order given, goes where the least room that suffices is left."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i, size in enumerate(fills):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
            room -= size
        else:
            b, room = len(bins), capacity - size
            bins.append([i])
        if room > 0:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins


def _round(capacity: int, slack: int):
    """Packs the bins of one partition as items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [(f, m) for batch in batches for f, m in zip(batch.column("fill").to_pylist(), batch.column("members").to_pylist(), strict=True)]
        items.sort(key=lambda x: (-x[0], x[1][0]["doc_id"] is not None, x[1][0]["doc_id"] or 0, x[1][0]["piece"]))
        packed = best_fit([f for f, _ in items], capacity)
        for at in range(0, len(packed), 5000):
            part = packed[at : at + 5000]
            fill = [sum(items[i][0] for i in b) for b in part]
            members = [[m for i in b for m in items[i][1]] for b in part]
            yield pa.RecordBatch.from_arrays([pa.array([f >= capacity - slack for f in fill]), pa.array(fill, pa.int32()), pa.array(members, pa.list_(_MEMBER))], names=["full", "fill", "members"])

    return run


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        members = batch.column("members")
        flat = pa.RecordBatch.from_struct_array(members.flatten())
        counts = np.diff(members.offsets.to_numpy())
        lengths = flat.column("length").to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        first = np.cumsum(counts) - counts
        offset = ends - lengths - np.repeat((ends - lengths)[first] if len(lengths) else ends, counts)
        sequence = np.repeat(batch.column("sequence_id").to_numpy(), counts)
        yield pa.RecordBatch.from_arrays([*flat.columns, pa.array(sequence), pa.array(offset, pa.int64())], names=[*flat.schema.names, "sequence_id", "offset"])


def pack(found: DataFrame, *, capacity: int, slack: int | None = None, fan_in: int = 8, most_items: int = 100_000, first_items: int = 20_000) -> DataFrame:
    """found (pieces) with sequence_id and offset. Bins with at most ``slack`` free tokens leave early."""
    slack = capacity // 128 if slack is None else slack
    alone = found.where(F.col("length") == capacity).select(F.lit(True).alias("full"), F.lit(capacity).alias("fill"), F.array(F.struct(*found.columns)).alias("members"))
    items = found.where(F.col("length") < capacity).select(F.col("length").cast("int").alias("fill"), F.array(F.struct(*found.columns)).alias("members"))
    parts = max(1, -(-items.count() // first_items))
    done = [alone]
    while True:
        bins = materialize(items.repartition(parts).mapInArrow(_round(capacity, slack), BIN))
        left = bins.where("not full")
        n = left.count()
        if parts == 1 or not n:
            done.append(bins)
            break
        fewer = max(1, -(-parts // fan_in), -(-n // most_items))
        if fewer >= parts:
            done.append(bins)
            break
        done.append(bins.where("full"))
        items, parts = left.select("fill", "members"), fewer
    out = done[0]
    for x in done[1:]:
        out = out.unionAll(x)
    numbered = materialize(out.select("members")).withColumn("sequence_id", F.monotonically_increasing_id())
    return numbered.mapInArrow(_laid_out, f"{PIECE}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, *, capacity: int = 2048, ranks_path: str | None = None) -> DataFrame:
    found = pieces(docs, capacity=capacity, ranks_path=ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pack(materialize(found), capacity=capacity)


def op7_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
