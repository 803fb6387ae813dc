"""Nominal sampling grids, gap evidence, gap-aware trajectory measures, and sliding windows.

A series has rows (keys, order, t, x, y, z) and a rate fs. A row's slot is the nearest multiple of 1 / fs
after the first time of its group; the grid runs from the first slot to the last one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motiondeck.functions.geometry import finite, ratio
from motiondeck.operators.ordered import series

# Fixed values of the window policy.
SLOT_TOLERANCE = 0.25
MIN_COVERAGE = 0.80
MAX_GAP_SEC = 0.10
TOLERANCE = 1e-9
REASONS = ["invalid_timebase", "missing_required_keypoints", "insufficient_observations", "gap_too_long", "insufficient_coverage", "estimator_undefined"]


def half_even(x: Column) -> Column:
    return F.rint(x).cast("bigint")


def sliding_windows(df: DataFrame, keys: list[str], length: float = 1.0, hop: float | None = None, time: str = "t") -> DataFrame:
    """df once for each half-open window [start, start + length) that a row is in.

    Windows of a group start at its first time, a hop (half a length) apart, and the last one ends by
    its last time. Each row goes straight to its few windows; there is no range join.
    """
    hop = hop or length / 2
    whole = Window.partitionBy(*keys)
    df = df.withColumns({"__t0": F.min(time).over(whole), "__t1": F.max(time).over(whole)})
    last = F.floor((F.col("__t1") - F.col("__t0") - length) / hop + 1e-10)
    after = F.col(time) - F.col("__t0")
    lo, hi = F.greatest(F.lit(0), F.floor((after - length) / hop)), F.least(last, F.floor(after / hop) + 1)
    df = df.withColumn("window_idx", F.explode(F.when((last >= 0) & (lo <= hi), F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))))
    start = F.col("__t0") + F.col("window_idx") * hop
    df = df.withColumns({"window_start": start, "window_end": start + length})
    return df.where((F.col(time) >= F.col("window_start")) & (F.col(time) < F.col("window_end"))).drop("__t0", "__t1")


def on_grid(df: DataFrame, keys: list[str], order: list[str], fs: str = "fs", time: str = "t") -> DataFrame:
    """df with ``slot`` and, the same for all rows of a group, ``fault`` (NULL for a sound time base)."""
    w, whole = series(keys, order), Window.partitionBy(*keys)
    sound = finite(F.col(time))  # a time that is no number has no slot
    first = F.first(sound).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    raw = (sound - first) * F.col(fs)
    df = df.withColumn("__raw", raw).withColumn("slot", half_even(F.col("__raw")))
    df = df.withColumns({"__step": F.col(time) - F.lag(time).over(w), "__same": F.col("slot") - F.lag("slot").over(w)})
    ok_time = sound.isNotNull()
    fault = (
        F.when(~F.coalesce(F.max(F.col(fs)).over(whole) > 0, F.lit(False)), "rate")
        .when(F.count("*").over(whole) < 2, "too_few")
        .when(F.count_if(~ok_time).over(whole) > 0, "not_finite")
        .when(F.count_if(F.col("__step") <= 0).over(whole) > 0, "not_increasing")
        .when(F.max(F.abs(F.col("__raw") - F.col("slot"))).over(whole) > SLOT_TOLERANCE, "off_grid")
        .when(F.count_if(F.col("__same") == 0).over(whole) > 0, "collision")
    )
    return df.withColumn("fault", fault).drop("__raw", "__step", "__same")


def evidence(df: DataFrame, keys: list[str], valid: Column, fs: str = "fs", lead: Column | None = None, trail: Column | None = None) -> DataFrame:
    """(keys, evidence of the grid): counts of slots, observed slots, intervals, gaps, and the longest gap.

    Only observed rows are looked at: a gap is what lies between neighbouring observed slots, and ``lead`` and
    ``trail`` slots (the same for all rows of a group) extend the grid at its ends.
    """
    lead, trail = lead if lead is not None else F.lit(0), trail if trail is not None else F.lit(0)
    seen = F.when(valid, F.col("slot"))
    df = df.withColumns({"__seen": seen, "__lead": lead.cast("bigint"), "__trail": trail.cast("bigint")})
    w = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__before", F.last("__seen", True).over(w))
    gap = F.when(F.col("__seen").isNotNull() & F.col("__before").isNotNull(), F.col("__seen") - F.col("__before") - 1)
    inner = df.withColumn("__gap", gap).groupBy(*keys).agg(
        F.first(fs).alias("fs"), F.max("slot").alias("last"), F.min("__seen").alias("lo"), F.max("__seen").alias("hi"), F.count("__seen").alias("n_valid_frames"),
        F.count_if(F.col("__gap") == 0).alias("n_valid_intervals"), F.max("__gap").alias("longest"), F.count_if(F.col("__gap") > 0).alias("gaps"),
        F.first("__lead").alias("lead"), F.first("__trail").alias("trail"),
    )
    total = F.col("last") + 1 + F.col("lead") + F.col("trail")
    head, tail = F.col("lead") + F.col("lo"), F.col("last") - F.col("hi") + F.col("trail")
    none = F.col("n_valid_frames") == 0
    longest = F.when(none, total).otherwise(F.greatest(F.coalesce("longest", F.lit(0)), head, tail))
    gaps = F.when(none, F.lit(1)).otherwise(F.col("gaps") + F.when(head > 0, 1).otherwise(0) + F.when(tail > 0, 1).otherwise(0))
    return inner.select(
        *keys, "fs", total.alias("n_expected_frames"), "n_valid_frames", (total - 1).alias("n_expected_intervals"), "n_valid_intervals",
        (F.col("n_valid_intervals") / F.col("fs")).alias("valid_duration_sec"), longest.alias("longest_gap_frames"), (longest / F.col("fs")).alias("longest_gap_sec"), gaps.alias("n_gaps"),
    )


def padding(df: DataFrame, keys: list[str], fs: str = "fs", time: str = "t") -> tuple[Column, Column]:
    """Slots that a window has before its first row and after its last one."""
    whole = Window.partitionBy(*keys)
    lead = F.greatest(F.lit(0), half_even((F.min(time).over(whole) - F.col("window_start")) * F.col(fs)))
    trail = F.greatest(F.lit(0), half_even((F.col("window_end") - F.max(time).over(whole)) * F.col(fs)) - 1)
    return lead, trail


def trajectory(df: DataFrame, keys: list[str], fs: str = "fs") -> DataFrame:
    """(keys, v_mean, v_peak, efficiency, normalized_jerk, dropout) of points on slots, with gaps left as gaps.

    Differences need the slots before them: a speed two neighbouring ones, a jerk four in a row. The duration in
    the jerk is that of the whole grid; efficiency is NULL if a slot between the first and last point is missing.
    """
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    n_grid = F.max("slot").over(Window.partitionBy(*keys)) + 1
    df = df.withColumn("__grid", n_grid).where(ok)
    w = Window.partitionBy(*keys).orderBy("slot")
    near = lambda k: F.lag("slot", k).over(w) == F.col("slot") - k
    step = F.when(near(1), F.sqrt(sum(F.pow(F.col(c) - F.lag(c).over(w), 2) for c in "xyz")))
    third = lambda c: F.col(c) - 3 * F.lag(c, 1).over(w) + 3 * F.lag(c, 2).over(w) - F.lag(c, 3).over(w)
    df = df.withColumns({"__step": step, "__jerk": F.when(near(3), sum(F.pow(third(c), 2) for c in "xyz"))})
    ends = [F.max_by(c, "slot") - F.min_by(c, "slot") for c in "xyz"]
    out = df.groupBy(*keys).agg(
        F.first(fs).alias("fs"), F.first("__grid").alias("n_grid"), F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"),
        F.avg("__step").alias("mean"), F.max("__step").alias("peak"), F.sum("__step").alias("path"), F.sum("__jerk").alias("jerk"), F.sqrt(sum(e * e for e in ends)).alias("straight"),
    )
    span = (F.col("n_grid") - 1) / F.col("fs")
    moves = (F.col("n_grid") >= 5) & (F.col("path") >= 1e-10)
    jerk = F.sqrt(F.pow(span, 5) / (2 * F.pow("path", 2)) * F.col("jerk") * F.pow("fs", 6) / F.col("fs"))
    unbroken = (F.col("hi") > F.col("lo")) & (F.col("n") == F.col("hi") - F.col("lo") + 1)
    return out.select(
        *keys, (F.col("mean") * F.col("fs")).alias("v_mean"), (F.col("peak") * F.col("fs")).alias("v_peak"),
        F.when(unbroken, ratio(F.col("path"), F.col("straight"), 1e-10)).alias("efficiency"), F.when(moves, jerk).alias("normalized_jerk"),
        ((F.col("n_grid") - F.col("n")) / F.col("n_grid")).alias("dropout"),
    )


def spectral_arc_length(df: DataFrame, values: str, fs: str, out: str, cutoff: float = 10.0) -> DataFrame:
    """df with minus the arc length of the amplitude spectrum of an array of speeds, up to a cutoff frequency.

    A plain Fourier sum over the array: for windows of some tens of samples. NULL below 4 samples, 0 at rest.
    """
    df = df.withColumn("__v", F.filter(values, lambda x: x.isNotNull()))
    df = df.withColumns({"__n": F.size("__v"), "__peak": F.array_max(F.transform("__v", lambda x: F.abs(x)))})
    turn = lambda k, i: F.lit(2 * math.pi) * k * i / F.col("__n")

    def amplitude(k: Column) -> Column:
        add = lambda wave: F.aggregate(F.transform("__v", lambda x, i: x * wave(turn(k, i))), F.lit(0.0), lambda a, x: a + x)
        return F.sqrt(F.pow(add(F.cos), 2) + F.pow(add(F.sin), 2))

    half = F.floor(F.col("__n") / 2).cast("int")
    df = df.withColumn("__s", F.when(F.col("__n") >= 4, F.transform(F.sequence(F.lit(0), half), lambda k: amplitude(k.cast("double")))))
    limit = F.least(F.lit(cutoff), F.col(fs) / 2)
    unit = F.col(fs) / 2 / (F.size("__s") - 1)
    df = df.withColumns({"__top": F.array_max("__s"), "__k": F.floor(limit / unit + 1e-12).cast("int"), "__d": unit / limit})
    step = lambda k: F.sqrt(F.pow(F.col("__d"), 2) + F.pow((F.get("__s", k) - F.get("__s", k - 1)) / F.col("__top"), 2))
    arc = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("__k"))), F.lit(0.0), lambda a, k: a + step(k))
    found = F.when((F.col("__n") < 4) | (F.col(fs) <= 0), None).when(F.col("__peak") < 1e-10, 0.0).when(F.col("__k") >= 1, -arc)
    return df.withColumn(out, found).drop("__v", "__n", "__peak", "__s", "__top", "__k", "__d")


def qc_reason(timebase_ok: Column, valid: Column, intervals: Column, gap_sec: Column, coverage: Column, estimate: Column, min_coverage: float = MIN_COVERAGE, max_gap: float = MAX_GAP_SEC) -> Column:
    """The first cause, in fixed precedence, why a window's metric is not usable; none if there is no cause."""
    return (
        F.when(~timebase_ok, REASONS[0])
        .when(valid == 0, REASONS[1])
        .when((valid < 2) | (intervals < 1), REASONS[2])
        .when(gap_sec > max_gap * (1 + TOLERANCE), REASONS[3])
        .when(coverage < min_coverage * (1 - TOLERANCE), REASONS[4])
        .when(estimate.isNull() | F.isnan(estimate) | (F.abs(estimate) == float("inf")), REASONS[5])
        .otherwise("none")
    )


def guarded_corr(a: str, b: str, least: int = 5) -> Column:
    """Pearson correlation over pairs with both values; NULL below ``least`` pairs or where either does not vary."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    both = F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull())
    spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    return F.when((both >= least) & (spread > 0), F.covar_pop(x, y) / F.when(spread > 0, spread))


def trunk_summaries(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mean, sd and range of trunk measures, and the compensatory pattern index) of each window's rows."""
    df = df.withColumn("__reach", F.greatest("left_reach_raw", "right_reach_raw"))
    stats = []
    for c in ("trunk_lean", "trunk_lean_sagittal", "trunk_lean_lateral", "trunk_rotation", "posture_symmetry"):
        of = c if c == "posture_symmetry" else f"{c}_deg"
        stats += [F.avg(of).alias(f"{c}_mean"), F.stddev_samp(of).alias(f"{c}_sd")]
    spread = (F.max("trunk_lean_deg") - F.min("trunk_lean_deg")).alias("trunk_lean_range")
    return df.groupBy(*keys).agg(guarded_corr("trunk_lean_deg", "__reach").alias("compensatory_pattern_index"), *stats, spread)
