"""Order MinHash against a naive one, and order in short texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from motiondeck.llm import order_minhash


def numbered(text, k=3, symbol=8):
    """The occurrence-numbered k-mers of a text with their positions."""
    symbols = re.findall(r"[^\x20\x09-\x0D]{1,%d}" % symbol, text)
    mers = [tuple(symbols[i : i + k]) for i in range(max(1, len(symbols) - k + 1))] if symbols else []
    seen, out = {}, []
    for i, m in enumerate(mers):
        seen[m] = seen.get(m, 0) + 1
        out.append((m, seen[m] - 1, i))
    return out


def naive(spark, text, slots=64, tuple_len=2):
    """The tuples of k-mers in each slot, found by going round the circle from the slot's start."""
    mers = numbered(text)
    if not mers:
        return [None] * slots
    # the same hashes as the operator's, so that both deal k-mers to the same places
    parts = spark.createDataFrame([(i, list(m), n) for m, n, i in mers], "i int, m array<string>, n int")
    h = F.xxhash64(*[F.when(F.size("m") > j, F.xxhash64(F.get("m", F.lit(j)))) for j in range(3)])
    parts = parts.withColumn("k", F.shiftright(h, 26)).withColumn("x", F.xxhash64("k", "n")).collect()
    ring = sorted((((r.x >> 26) << 26) | r.i, r.i) for r in parts)
    out = []
    for s in range(-(slots // 2), slots // 2):
        start = next((j for j, (x, _) in enumerate(ring) if x >> 58 >= s), 0)
        chosen = [ring[(start + j) % len(ring)][1] for j in range(min(tuple_len, len(ring)))]
        out.append(tuple(mers[i][:2] for i in sorted(chosen)))
    return out


def like(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    df = order_minhash.signature(order_minhash.signature(df, "a", "x"), "b", "y")
    return [r.l for r in df.select(order_minhash.likeness(F.col("x"), F.col("y")).alias("l")).collect()]


def test_likeness_is_that_of_naive_tuples(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(60)}" for _ in range(400)]
    texts = [" ".join(base[:n]) for n in (1, 2, 3, 5, 12, 40, 120, 400)]
    edited = [" ".join(w if rng.random() > 0.15 else "zz" for w in t.split()) for t in texts]
    pairs = [*zip(texts, edited, strict=True), (texts[5], texts[6]), (texts[4], texts[4]), ("", "a"), (texts[3], texts[3] + " end")]
    for (a, b), found in zip(pairs, like(spark, pairs), strict=True):
        one, two = naive(spark, a), naive(spark, b)
        assert found == pytest.approx(sum(x == y for x, y in zip(one, two, strict=True) if x) / 64 if a or b else 1.0), (a[:30], b[:30])


@pytest.mark.parametrize("words", [40, 80, 400])
def test_reversed_blocks_are_unlike(spark, words):
    rng = random.Random(words)
    base = [f"{rng.randrange(10**6)}" for _ in range(words)]
    blocks = [base[i : i + words // 8] for i in range(0, words, words // 8)]
    found = like(spark, [(" ".join(base), " ".join(w for x in reversed(blocks) for w in x)), (" ".join(base), " ".join(base)), (" ".join(base), " ".join(base[:-1]))])
    assert found[0] < 0.2 and found[1] == 1 and found[2] > 0.75


def test_next_rows_whatever_the_ranges(spark):
    rng = random.Random(4)
    rows = [(None if i == 3 else rng.randrange(50), f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    order = [r.text for r in df.orderBy(F.coalesce("doc_id", F.lit(-(1 << 63))), F.xxhash64("text")).collect()]
    expected = dict(zip(order, [*order[1:], order[0]], strict=True))
    for parts in (1, 2, 7, 64):
        assert {r.text: r.next_text for r in order_minhash.with_next(df, ["text"], parts).collect()} == expected
