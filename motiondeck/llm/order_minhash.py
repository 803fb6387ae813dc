"""Document fingerprints: Order MinHash, in DataFrame functions only.

A text is cut into symbols (runs of up to ``symbol`` characters other than ASCII white space, so a word
or a part of a long one). Every run of ``k`` symbols is a k-mer; equal ones are numbered by occurrence.
The hash of (k-mer, number) puts it on a circle of ``slots`` equal slots. A slot's tuple are the ``tuple_len`` k-mers
that come first from the slot's start on, its own ones or, where it has too few (short texts), those of the slots after it; they are
put in the order they have in the text and hashed: two texts agree in a slot only if the same k-mers come there in the
same order, so the share of agreeing slots falls with edit distance, rearrangements included. All slots come out of one sort of one array.

The fingerprint is the hex of the slots' tuple hashes, in slot order; every text with a symbol has all slots. Null or
white-space-only texts have the empty fingerprint; likeness of two empty ones is 1, of an empty and another 0. Texts with fewer than
k symbols are one k-mer, and of fewer k-mers than ``tuple_len`` the tuple has all. Rows that repeat a doc_id follow one another in the order of a hash of their
text. A null doc_id sorts first. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motiondeck.llm.common import shuffle_parts, table

#: Bits of a packed long that hold a position (67 million symbols); the others hold the hash.
_POS = 26


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << _POS) - 1))


def _high(x: Column) -> Column:
    return F.shiftright(x, _POS)


def _with_pos(h: Column, i: Column) -> Column:
    return h.bitwiseAND(F.lit(-(1 << _POS))).bitwiseOR(i.cast("bigint"))


def _each(n: Column, f) -> Column:
    """f(0), ..., f(n - 1) as an array."""
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), f)


def signature(df: DataFrame, text: str, out: str, *, k: int = 3, symbol: int = 8, slots: int = 64, tuple_len: int = 2) -> DataFrame:
    """df with the array of slot hashes of a text column; a slot's number is in the top bits of its hash."""
    s, h, a, b, c = (f"__{out}_{x}" for x in "shabc")
    shift = 64 - (slots - 1).bit_length()
    df = df.withColumn(s, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]{1," + str(symbol) + "}"), F.lit(0)))
    df = df.withColumn(h, F.transform(s, lambda x: F.xxhash64(x))).drop(s)
    n = F.when(F.size(h) == 0, F.lit(0)).otherwise(F.greatest(F.size(h) - (k - 1), F.lit(1)))
    at = lambda col, i: F.get(F.col(col), i)  # noqa: E731  null beyond the end
    df = df.withColumn(a, F.sort_array(_each(n, lambda i: _with_pos(F.xxhash64(*[at(h, i + j) for j in range(k)]), i)))).drop(h)
    # the number of a k-mer among its equals: a binary search for the start of its run in sorted order
    powers = [1 << p for p in range(_POS - 1, -1, -1)]

    def number(i: Column) -> Column:
        same = lambda j: _high(at(a, j)) == _high(at(a, i))
        run = F.aggregate(F.array(*map(F.lit, powers)), F.lit(0), lambda acc, p: F.when((i - acc - p >= 0) & same(i - acc - p), acc + p).otherwise(acc))
        return F.when((i > 0) & same(i - 1), run).otherwise(0)

    df = df.withColumn(b, F.sort_array(_each(F.size(a), lambda i: _with_pos(F.xxhash64(_high(at(a, i)), number(i)), _low(at(a, i))))))
    slot = lambda x: F.shiftright(x, shift)
    df = df.drop(a).withColumn(c, F.filter(b, lambda x, i: (i < tuple_len) | (slot(x) != slot(F.get(F.col(b), i - tuple_len))))).drop(b)
    size = F.size(c)
    steps = F.array(*[F.lit(1 << p) for p in range((slots * tuple_len).bit_length() - 1, -1, -1)])
    # of the few that are left, how many lie before a slot
    before = lambda x: F.aggregate(steps, F.lit(0), lambda acc, p: F.when((acc + p <= size) & (slot(at(c, acc + p - 1)) < x), acc + p).otherwise(acc))
    turned = lambda y: F.shiftleft(_low(y), 64 - _POS - 1).bitwiseOR(F.shiftrightunsigned(y, _POS + 1))
    members = lambda x: F.transform(F.sequence(F.lit(0), F.least(size, F.lit(tuple_len)) - 1), lambda j: turned(at(c, F.pmod(before(x) + j, size))))
    tuple_hash = lambda x: F.xxhash64(F.transform(F.sort_array(members(x)), lambda y: y.bitwiseAND(F.lit((1 << (64 - _POS - 1)) - 1))))
    whole = F.transform(F.sequence(F.lit(-(slots // 2)), F.lit(slots // 2 - 1)), lambda x: F.shiftleft(x.cast("bigint"), shift).bitwiseOR(F.shiftrightunsigned(tuple_hash(x), 64 - shift)))
    return df.withColumn(out, F.when(size > 0, whole).otherwise(F.array().cast("array<bigint>"))).drop(c)


def likeness(a: Column, b: Column) -> Column:
    """The share of slots that agree, of the slots that the fuller signature has."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def fingerprint(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(docs: DataFrame, columns: list[str], parts: int) -> DataFrame:
    """docs with ``next_<column>`` from the row that follows by doc_id (after the last: the first).

    Rows are dealt to ranges of doc_id, and the first row of each range also goes, as a guest, to the range
    before it, so that each range knows its successor; the very first goes to the last range. The
    rows are shuffled once; only one row a range is gathered.
    """
    at = F.struct(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("h"))
    ids = docs.select(at.alias("__at"))
    cuts = F.array(*[F.lit(f / parts) for f in range(1, max(2, parts))])
    marks = sorted(set(ids.agg(F.percentile_approx("__at.d", cuts, 10000)).first()[0] or [0]))
    bounds = F.split(F.lit(",".join(map(str, marks))), ",").cast("array<bigint>")  # folded into one constant
    steps = F.array(*[F.lit(1 << p) for p in range(len(marks).bit_length() - 1, -1, -1)])
    bucket = F.aggregate(steps, F.lit(0), lambda acc, p: F.when((acc + p <= len(marks)) & (F.get(bounds, acc + p - 1) < F.col("__at.d")), acc + p).otherwise(acc))
    firsts = ids.withColumn("__bucket", bucket).groupBy("__bucket").agg(F.min("__at").alias("__first"))
    firsts = firsts.withColumn("__before", F.coalesce(F.lag("__bucket").over(Window.orderBy("__bucket")), F.max("__bucket").over(Window.partitionBy())))
    keyed = docs.withColumn("__at", at).withColumn("__bucket", bucket).join(F.broadcast(firsts), "__bucket")
    own = F.struct(F.col("__bucket").alias("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("__before").alias("bucket"), F.lit(1).alias("guest"))
    dealt = keyed.withColumn("__to", F.explode(F.when(F.col("__at") == F.col("__first"), F.array(own, guest)).otherwise(F.array(own))))
    w = Window.partitionBy("__to.bucket").orderBy("__to.guest", "__at")
    found = dealt.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
    return found.where("__to.guest = 0").drop("__to", "__at", "__bucket", "__first", "__before")


def fingerprints(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text, n_chars, and the fingerprints of the text and of its edited text, with likenesses."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = 4 * shuffle_parts(docs.sparkSession)
    df = with_next(signature(docs, "text", "own", **options), ["text", "own"], parts)
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    df = df.select("doc_id", "text", F.length("text").cast("bigint").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    df = signature(df, "edited", "other", **options)
    return df.select(
        "doc_id", "text", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents")).drop("text")
