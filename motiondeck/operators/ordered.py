"""Operators on ordered series: steps, runs, fills, medians, rates.

``keys`` are the columns of a series, ``order`` those that order it; the order must be total for the result to
be unique. Every operator is one window over (keys, order), so several on the same series share one shuffle and sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from motiondeck.functions.geometry import distance, ratio


def series(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def step_length(w: WindowSpec, x: str, y: str, z: str) -> Column:
    """The distance from the row before; NULL on the first row or if either point is missing."""
    now, before = [F.col(c) for c in (x, y, z)], [F.lag(c).over(w) for c in (x, y, z)]
    return distance(tuple(now), tuple(before))


def running_median(w: WindowSpec, value: Column | str, k: int = 5) -> Column:
    """The median of the k rows around a row, NULLs left out, cut off at the ends."""
    held = F.array_sort(F.collect_list(value).over(w.rowsBetween(-(k // 2), k // 2)))
    n = F.size(held)
    return F.when(n > 0, (F.get(held, F.floor((n - 1) / 2).cast("int")) + F.get(held, F.floor(n / 2).cast("int"))) / 2)


def centred_mean(w: WindowSpec, value: str, k: int = 5) -> Column:
    """The mean of k rows around a row, NULL if one is missing or beyond an end."""
    frame = w.rowsBetween(-(k // 2), k // 2)
    return F.when(F.count(value).over(frame) == k, F.avg(value).over(frame))


def change_speed(w: WindowSpec, value: str, time: str) -> tuple[Column, Column]:
    """(change, change per second) from the row before, 3 decimals; no speed if time does not advance."""
    change, dt = F.col(value) - F.lag(value).over(w), F.col(time) - F.lag(time).over(w)
    return F.round(change, 3), F.round(F.when(dt > 0, change / F.when(dt > 0, dt)), 3)


def with_runs(df: DataFrame, w: WindowSpec, state: Column, out: str = "run") -> DataFrame:
    """df with the number of the row's run of equal states (NULL equals NULL) within its series."""
    df = df.withColumn("__new", F.when(F.row_number().over(w) == 1, 0).when(state.eqNullSafe(F.lag(state).over(w)), 0).otherwise(1))
    return df.withColumn(out, F.sum("__new").over(w)).drop("__new")


def run_lengths(df: DataFrame, keys: list[str], order: list[str], state: Column) -> DataFrame:
    """(keys, run, state, length): the run-length encoding of each series."""
    df = with_runs(df.withColumn("__state", state), series(keys, order), F.col("__state"))
    return df.groupBy(*keys, "run").agg(F.first("__state").alias("state"), F.count("*").alias("length"))


def mean_true_run(df: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """(keys, mean_streak): the mean length of runs where flag holds, 0 if it never does."""
    runs = run_lengths(df, keys, order, flag)
    return runs.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("state"), F.col("length"))), F.lit(0.0)).alias("mean_streak"))


def fill_forward_back(w: WindowSpec, value: str) -> Column:
    """The last known value, before the first known one the first."""
    return F.coalesce(F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing)))


def fill_linear(w: WindowSpec, value: str, position: str) -> Column:
    """Inner gaps filled on the line between their neighbours; ends stay missing."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(position).cast("double").alias("p"), F.col(value).alias("v")))
    a, b = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    span = b["p"] - a["p"]
    return F.when(F.col(value).isNotNull(), F.col(value)).when(span > 0, a["v"] + (b["v"] - a["v"]) * (F.col(position) - a["p"]) / F.when(span > 0, span))


def third_difference(w: WindowSpec, value: str) -> Column:
    return F.col(value) - 3 * F.lag(value, 1).over(w) + 3 * F.lag(value, 2).over(w) - F.lag(value, 3).over(w)


def smoothness(df: DataFrame, keys: list[str], order: list[str], rate: str) -> DataFrame:
    """(keys, n, path, straight, efficiency, normalized_jerk) of series x, y, z sampled at ``rate``; missing points left out."""
    w = series(keys, order)
    df = df.where("x is not null and y is not null and z is not null")
    df = df.withColumn("__step", step_length(w, "x", "y", "z"))
    df = df.withColumn("__jerk", sum(F.pow(third_difference(w, c), 2) for c in "xyz"))
    at = F.struct(*order)
    ends = [F.max_by(c, at) - F.min_by(c, at) for c in "xyz"]
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("__step").alias("path"), F.sum("__jerk").alias("jerk"), F.first(rate).alias("fs"), F.sqrt(sum(e * e for e in ends)).alias("straight"))
    size = (F.col("n") >= 5) & (F.col("fs") > 0) & (F.col("path") >= 1e-10)
    span = (F.col("n") - 1) / F.col("fs")
    jerk = F.sqrt(F.pow(span, 5) / (2 * F.pow("path", 2)) * F.col("jerk") * F.pow("fs", 6) / F.col("fs"))
    return out.select(*keys, "n", "path", "straight", F.when(F.col("n") >= 2, ratio(F.col("path"), F.col("straight"), 1e-10)).alias("efficiency"), F.when(size, jerk).alias("normalized_jerk"))


def frame_rate(df: DataFrame, keys: list[str], order: list[str], time: str = "t", robust: bool = False) -> DataFrame:
    """(keys, n, fs): 1 / median size of the time steps; robust: 1 / mean of positive steps up to 1.5 medians."""
    steps = df.withColumn("__d", F.col(time) - F.lag(time).over(series(keys, order)))
    if not robust:
        found = steps.groupBy(*keys).agg(F.count("*").alias("n"), F.median(F.abs("__d")).alias("d"))
        return found.select(*keys, "n", F.when((F.col("n") >= 4) & (F.col("d") > 0), 1 / F.when(F.col("d") > 0, F.col("d"))).alias("fs"))
    steps = steps.withColumn("__d", F.when(F.col("__d") > 0, F.col("__d")))
    steps = steps.withColumn("__m", F.median("__d").over(Window.partitionBy(*keys)))
    found = steps.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.when(F.col("__d") <= 1.5 * F.col("__m"), F.col("__d"))).alias("d"))
    return found.select(*keys, "n", F.when(F.col("d") > 0, 1 / F.when(F.col("d") > 0, F.col("d"))).alias("fs"))


def jitter(df: DataFrame, keys: list[str], order: list[str], points: str = "points") -> DataFrame:
    """df with ``jitter_px``: the summed xy distance to the last seen points of the same number, 2 decimals.

    ``points`` is an array of structs with x and y, NULL where nothing was seen.
    """
    w = series(keys, order)
    before = F.last(points, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    now = F.col(points)
    moved = F.aggregate(F.zip_with(now, before, lambda a, b: F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))), F.lit(0.0), lambda s, d: s + d)
    return df.withColumn("__before", before).withColumn("jitter_px", F.when(F.size(now) == F.size("__before"), F.round(moved, 2))).drop("__before")


def smoothing_change(raw: Column, smoothed: Column) -> Column:
    """The summed xy distance between two arrays of points, 0 if their numbers differ."""
    moved = F.aggregate(F.zip_with(raw, smoothed, lambda a, b: F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))), F.lit(0.0), lambda s, d: s + d)
    return F.when(F.size(raw) == F.size(smoothed), moved).otherwise(F.lit(0.0))


def timeline_status(detected: Column, carried: Column) -> Column:
    return F.when(carried, "carried").when(detected, "detected").otherwise("missing")


def baseline_deltas(df: DataFrame, keys: list[str], order: list[str], value: str, sd: str, flag_sd: float = 1.0) -> DataFrame:
    """df with baseline, delta, pct_change and flagged, against the first row of each series.

    A first value that is NULL is the baseline all the same. flagged is NULL without a usable baseline deviation.
    """
    w = series(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base, spread = F.first(value).over(w), F.first(sd).over(w)
    df = df.withColumns({"baseline": base, "baseline_sd": spread}).withColumn("delta", F.col(value) - F.col("baseline"))
    pct = 100 * ratio(F.col("delta"), F.abs("baseline"), 1e-12)
    return df.withColumns({"pct_change": pct, "flagged": F.when(F.col("baseline_sd") > 1e-12, F.abs("delta") > flag_sd * F.col("baseline_sd"))})


def carried(w: WindowSpec, value: str, frame: str, most: int) -> tuple[Column, Column]:
    """(value, age): the last known value for up to ``most`` frames after it was seen, and how many frames old it is."""
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col(frame).alias("f"), F.col(value).alias("v")))
    last = F.last(seen, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    age = F.col(frame) - last["f"]
    return F.when(age <= most, last["v"]), F.when(age <= most, age)
