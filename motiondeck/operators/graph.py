"""Neighbours within a reach and connected groups, without comparing all rows of a group with one another."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motiondeck.operators.scratch import written


def cells(axes: list[str], reach: float) -> list[Column]:
    """The grid cell of side ``reach`` that a place is in; NULL where it is unknown."""
    return [F.floor(F.col(a) / reach).cast("bigint") for a in axes]


def spread(df: DataFrame, axes: list[str], reach: float, names: list[str]) -> DataFrame:
    """df once for each cell that places within ``reach`` of its row can be in (``names``)."""
    own = cells(axes, reach)
    around = F.array(*[F.struct(*[(c + d).alias(n) for c, d, n in zip(own, step, names, strict=True)]) for step in product((-1, 0, 1), repeat=len(axes))])
    return df.select("*", F.inline(around))


def near_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_axes: list[str], right_axes: list[str], reach: float) -> DataFrame:
    """Pairs of a row of left and one of right (other column names) with equal keys and a Euclidean distance below ``reach``, as ``cost``.

    Equal keys and cells are joined, so a key with many rows is many small groups.
    """
    names = [f"__cell{i}" for i in range(len(left_axes))]
    a = spread(left, left_axes, reach, names)
    b = right.select("*", *[c.alias(n) for c, n in zip(cells(right_axes, reach), names, strict=True)])
    square = sum((F.pow(F.col(x) - F.col(y), 2) for x, y in zip(left_axes, right_axes, strict=True)), F.lit(0.0))
    return a.join(b, [*keys, *names]).withColumn("cost", F.sqrt(square)).where(F.col("cost") < reach).drop(*names)


def _towards_least(edges: DataFrame, upward: bool) -> DataFrame:
    """Every node's neighbours above it (upward), or below it and itself, joined to the least of its neighbourhood."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    if upward:
        moved = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = both.join(least, "u").where(F.col("v") < F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionAll(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of edges (a, b): root is the least node of the connected group. Nodes may be of any ordered type.

    Steps alternate until nothing changes: some log2(n)^2 at most, each two shuffles of the edges that are left. A node with most
    of the edges is a minimum and a join that adaptive execution can split.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        now = written(_towards_least(written(_towards_least(now, True)), False))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    members = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    alone = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    return members.unionAll(roots).unionAll(alone.join(members.unionAll(roots), "node", "left_anti").distinct())
