"""Links between members of shared buckets, and the connected groups that links make.

A candidate table has rows (key, id, ...): two ids are worth comparing when they share a key. Small
buckets are compared pair by pair. A large bucket is not: round by round a hub is
verified against the rest of its bucket, and what links to it leaves the rest; the next hub is one of those that left, or, if none
did, one of the rest; of these the one whose buckets have the most members in all. Whatever members of a bucket are then still in different connected groups are compared with each
other, so no link that would join two groups is missed, while members of one group are not paired
with one another needlessly.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motiondeck.llm.common import materialize

#: Buckets up to this size are compared pair by pair.
SMALL = 32
#: Rounds of hubs before the comparison across groups, which is exact whatever is left.
ROUNDS = 12
#: Bits of the filter that spares a shuffle of contents nobody needs, for few members and at most (16 MB); beyond its size it only spares less.
FILTER_BITS, MOST_BITS = 1 << 23, 1 << 27


def filter_size(members: int) -> int:
    return min(MOST_BITS, max(FILTER_BITS, 1 << (16 * members).bit_length()))


def filter_bits(df: DataFrame, slot: Column, size: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of the slots (0 to size - 1) of df's rows, built by Spark from 64-bit words."""
    words = df.select(slot.cast("int").alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("bits"))
    got = words.toArrow()
    out = np.zeros(size >> 6, dtype=np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return out


def in_filter(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    slots = slots.astype(np.uint64)
    return (bits[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in links (a, b); root is the smallest id of its connected group.

    Alternates large-star and small-star steps (each a minimum by node and a join) until nothing changes.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written out, so that a join on a node with most of the edges can be split
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        edges = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = materialize(edges)
        low = materialize(edges.groupBy("u").agg(F.min("v").alias("m")))
        joined = edges.join(low, "u")
        edges = materialize(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(roots)


def linked(buckets: DataFrame, attributes: list[str], admissible: Callable, prepare: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], fits: Callable | None = None, enough: Callable | None = None, pairwise: int = SMALL, rounds: int = ROUNDS, worth: float = 0.0, once: bool = False) -> DataFrame:
    """Links (a, b) that connect all ids which any chain of verified pairs within buckets connects.

    buckets: distinct (key, id, *attributes) of buckets with two members or more, and ``n``, their size.
    admissible(x, y): a Column from two functions that name the attributes of either side; it may only
    refuse pairs that are linked through no key or are admitted by another one.
    prepare(ids) gets all ids that may be compared (column id, repeats possible) and returns verify;
    verify(pairs) returns the rows (a, b) of pairs that are links.
    fits(x, y): a Column, whether two ids can be a link by their first attribute alone.
    enough(n, x, y): a Column, by their first attribute too, whether two ids that share at most n keys can be a link at all.
    pairwise: buckets up to this size are compared pair by pair at once. Larger ones have a round of hubs, and those over SMALL up to ``rounds``,
    as long as a round links at least the share ``worth`` of the pairs that it verifies. once: pairs across groups are made at the least key they share alone,
    and links within a group may be returned as those of its members to its root.
    """

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select("key", *[F.col(c).alias(f"{prefix}_{c}") for c in ("id", *attributes)])

    ok = admissible(lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}"))

    def pairs_of(left: DataFrame, right: DataFrame, also) -> DataFrame:
        found = side(left, "x").join(side(right, "y"), "key").where(also & ok)
        return found.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()

    small = buckets.where(F.col("n") <= pairwise)
    if enough is None:
        pairs = pairs_of(small, small, F.col("x_id") < F.col("y_id"))
    else:
        can = fits(lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}"))
        met = side(small, "x").join(side(small, "y"), "key").where((F.col("x_id") < F.col("y_id")) & can).withColumn("ok", ok)
        met = met.groupBy(F.col("x_id").alias("a"), F.col("y_id").alias("b")).agg(F.count("*").alias("n"), F.max("ok").alias("ok"), *[F.first(f"{s}_{c}").alias(f"{s}_{c}") for s in "xy" for c in attributes[:1]])
        crowd = materialize(buckets.where(F.col("n") > pairwise).groupBy("id").agg(F.count("*").alias("m")))
        met = met.join(crowd.select(F.col("id").alias("a"), F.col("m").alias("m_a")), "a", "left").join(crowd.select(F.col("id").alias("b"), F.col("m").alias("m_b")), "b", "left")
        most = F.col("n") + F.least(F.coalesce("m_a", F.lit(0)), F.coalesce("m_b", F.lit(0)))
        pairs = met.where("ok").where(enough(most, lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}"))).select("a", "b")
    pairs = materialize(pairs)
    verify = prepare(pairs.select(F.explode(F.array("a", "b")).alias("id")).unionAll(buckets.where(F.col("n") > pairwise).select("id")))
    links = materialize(verify(pairs))
    large = materialize(buckets.where(F.col("n") > pairwise).select("key", "id", *attributes, "n"))
    rest, left = large, None
    if rest.isEmpty():
        return links
    known = links.count() if worth else 0
    seen = None
    # what the others were copied from shares more keys with them than they do with one another
    weight = rest.groupBy("id").agg(F.sum("n").alias("weight"))
    rest = materialize(rest.join(weight, "id"))
    row = F.struct("id", *attributes)
    for _ in range(rounds):
        lot = F.struct(-F.col("weight"), F.xxhash64("id"))  # the same in all buckets
        hub = [F.col("h.id").alias("hub"), *[F.col(f"h.{c}").alias(f"hub_{c}") for c in attributes]]
        if left is None and once:
            # every key has a hub: one sort by key instead of an aggregate and a join
            tried = materialize(rest.withColumn("h", F.min_by(row, lot).over(Window.partitionBy("key"))).select(*rest.columns, *hub))
        else:
            hubs = rest.groupBy("key").agg(F.min_by(row, lot).alias("h"))
            if left is not None:
                others = left.groupBy("key").agg(F.min_by(row, lot).alias("other"))
                hubs = hubs.join(others, "key", "left").select("key", F.coalesce("other", "h").alias("h"))
            tried = materialize(rest.join(hubs.select("key", *hub), "key"))
        pairs = tried.where((F.col("id") != F.col("hub")) & admissible(lambda c: F.col(f"hub_{c}"), F.col))
        pairs = pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        pairs = materialize(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"))
        links = materialize(links.unionAll(verify(pairs)))
        seen = materialize(pairs if seen is None else seen.unionAll(pairs))
        yes = links.select(F.col("a").alias("hub"), F.col("b").alias("id")).unionAll(links.select(F.col("b").alias("hub"), F.col("a").alias("id"))).distinct()
        found = tried.join(yes.withColumn("hit", F.lit(True)), ["hub", "id"], "left").withColumn("hit", F.coalesce("hit", F.col("id") == F.col("hub")))
        found = materialize(found.select("key", "id", *attributes, "n", "weight", "hub", "hit"))
        rest, left = found.where(~F.col("hit") & (F.col("n") > SMALL)).drop("hub", "hit"), found.where("hit and id <> hub").drop("hub", "hit")
        if rest.isEmpty():
            break
        if worth:
            known, before = links.count(), known
            if known - before < worth * pairs.count():
                break
    groups = components(links)
    grouped = large.join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))
    main = grouped.groupBy("key").agg(F.mode("root", deterministic=True).alias("main"), F.count_distinct("root").alias("roots")).where("roots > 1").drop("roots")
    grouped = materialize(grouped.join(main, "key").select("key", "id", *attributes, "root", "main"))
    if grouped.isEmpty():
        return links
    attributes = [*attributes, "root"]
    differ = F.col("x_root") != F.col("y_root")
    if once:
        # a key that two ids of different groups share is a row of both here, and one of the two is odd in it
        grouped = materialize(grouped.join(grouped.groupBy("id").agg(F.collect_set("key").alias("keys")), "id").withColumn("odd", F.col("root") != F.col("main")))
        attributes = [*attributes, "odd", "keys"]
        differ = differ & (~F.col("y_odd") | (F.col("x_id") < F.col("y_id")))
        ok = ok & (F.array_min(F.array_intersect("x_keys", "y_keys")) == F.col("key"))
    odd = grouped.where("root <> main")
    across = pairs_of(odd, grouped, differ)
    across = materialize(across.join(seen, ["a", "b"], "left_anti"))
    if once:
        # the groups are known: each id's link to its root says as much as all links within a group
        links = groups.select(F.col("id").alias("a"), F.col("root").alias("b"))
    return links.unionAll(verify(across))


def sized(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Distinct (key, id, *keep) of keys with two ids or more, with their number n; one shuffle by key."""
    once = rows.repartition("key")
    once = once.groupBy("key", "id").agg(*[F.min(c).alias(c) for c in keep]) if keep else once.select("key", "id").distinct()
    w = Window.partitionBy("key")
    return once.withColumn("n", F.count("*").over(w)).where("n > 1")
