"""Aggregates: per-recording summaries, quality summaries, quantiles, censuses of measurements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motiondeck.functions.geometry import ratio
from motiondeck.operators.ordered import run_lengths
from motiondeck.sources.schema import numeric_features

STATS: dict[str, Callable[[Column | str], Column]] = {"mean": F.avg, "median": F.median, "sd": F.stddev_samp, "min": F.min, "max": F.max}


def per_recording(df: DataFrame, keys: list[str], features: list[str] | None = None, fns: dict[str, Callable] | None = None) -> DataFrame:
    """One row a recording: ``<feature>__<stat>`` of every numeric feature, NULLs left out. ``fns`` may name others."""
    features = features if features is not None else numeric_features(df, keys)
    fns = fns or STATS
    return df.groupBy(*keys).agg(*[f(c).alias(f"{c}__{n}") for c in features for n, f in fns.items()])


def quality_summary(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The quality summary of a metrics table, one row of 28 figures, NULLs left out and rounded by field.

    The mean carry streak looks at runs of carried frames within each recording and person.
    """
    q95 = lambda c: F.percentile(c, 0.95)
    share = lambda c: F.avg((F.col(c) > 0).cast("double"))
    figures = {
        "body_detection_rate": (F.avg("body_detected"), 4), "mean_real_hands_per_frame": (F.avg("n_hands_real"), 2), "pct_frames_synthetic_hands": (share("n_hands_synthetic"), 4), "pct_frames_recrop_hands": (share("n_hands_recrop"), 4),
        "body_vis_median": (F.median("body_vis_mean"), 4), "body_vis_iqr": (F.percentile("body_vis_mean", 0.75) - F.percentile("body_vis_mean", 0.25), 4), "hand_L_flag_median": (F.median("hand_L_flag"), 4), "hand_R_flag_median": (F.median("hand_R_flag"), 4),
        "body_jitter_median": (F.median("body_jitter_px"), 2), "body_jitter_p95": (q95("body_jitter_px"), 2), "hand_L_jitter_median": (F.median("hand_L_jitter_px"), 2), "hand_L_jitter_p95": (q95("hand_L_jitter_px"), 2),
        "hand_R_jitter_median": (F.median("hand_R_jitter_px"), 2), "hand_R_jitter_p95": (q95("hand_R_jitter_px"), 2), "body_smooth_median": (F.median("body_smooth_delta_px"), 2), "hand_L_smooth_median": (F.median("hand_L_smooth_delta_px"), 2),
        "hand_R_smooth_median": (F.median("hand_R_smooth_delta_px"), 2), "body_carry_pct": (F.avg("body_carry"), 4), "bone_correction_mean_px": (F.avg("bone_correction_px"), 2), "pct_frames_angle_clamped": (share("angle_corrections_n"), 4),
        "hand_L_match_mean": (F.avg("hand_arm_match_dist_L"), 2), "hand_R_match_mean": (F.avg("hand_arm_match_dist_R"), 2), "hand_L_match_max": (F.max("hand_arm_match_dist_L"), 2), "hand_R_match_max": (F.max("hand_arm_match_dist_R"), 2),
        "inference_median_ms": (F.median("inference_ms"), 1), "inference_p95_ms": (q95("inference_ms"), 1),
    }
    row = df.agg(F.count("*").alias("n_frames"), *[F.round(c, d).alias(n) for n, (c, d) in figures.items()])
    runs = run_lengths(df, ["video", "person_idx"], order or ["frame_idx"], F.col("body_carry") > 0)
    streak = runs.agg(F.round(F.coalesce(F.avg(F.when(F.col("state"), F.col("length"))), F.lit(0.0)), 1).alias("mean_carry_streak"))
    return row.join(F.broadcast(streak), F.lit(True))  # one row each


def nearest_index_quantiles(df: DataFrame, keys: list[str], value: str, fractions: list[float]) -> DataFrame:
    """(keys, q..): sorted[min(n - 1, floor(fraction * n))] of each group, 4 decimals: neither interpolated nor nearest-rank.

    Equal values are counted before the shuffle, so a window holds distinct values and their running counts in place of the group's rows.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = counted.withColumns({"__upto": upto, "__n": F.sum("__c").over(Window.partitionBy(*keys))})
    place = lambda f: F.least(F.col("__n") - 1, F.floor(F.lit(f) * F.col("__n")))
    return counted.groupBy(*keys).agg(*[F.round(F.min(F.when(F.col("__upto") > place(f), F.col(value))), 4).alias(f"q{round(100 * f)}") for f in fractions])


def null_rates(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    rates = [F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]
    return (df.groupBy(*keys) if keys else df).agg(*rates)


def feature_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, median, sd, min, max, pct_na): one unpivot, one grouped aggregate."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "value")
    return long.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"),
        (100 * F.avg(F.col("value").isNull().cast("double"))).alias("pct_na"),
    )


def variance_rank(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, variance, near_zero) by falling sample variance; near zero is below 1 % of the largest."""
    long = df.select(*columns).unpivot([], columns, "feature", "value").groupBy("feature").agg(F.var_samp("value").alias("variance"))
    top = F.max("variance").over(Window.partitionBy())
    return long.withColumn("near_zero", F.col("variance") < 0.01 * top)


def variable_features(df: DataFrame, columns: list[str], *, least: int = 2, most_na: float = 1.0) -> list[str]:
    """Columns with ``least`` known values, a positive deviation and at most a share of NULLs, from one aggregate."""
    facts = df.agg(*[F.struct(F.count(c).alias("n"), F.stddev_samp(c).alias("sd"), F.avg(F.col(c).isNull().cast("double")).alias("na")).alias(c) for c in columns]).first()
    return [c for c in columns if facts[c].n >= least and (facts[c].sd or 0) > 0 and (facts[c].na or 0) <= most_na]


def median_impute(df: DataFrame, columns: list[str], rest: float = 0.0) -> DataFrame:
    """Rows with any value; NULLs become their column's median, or ``rest`` if the column has none."""
    df = df.dropna("all", subset=columns)
    middle = df.agg(*[F.median(c).alias(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(middle[c]), F.lit(rest)) for c in columns})


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their sample deviation; NULL where nothing varies. Two numbers a column are gathered."""
    facts = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns]).first()
    return df.withColumns({c: (F.col(c) - facts[c].m) / facts[c].s if facts[c].s else F.lit(None).cast("double") for c in columns})


def outliers(df: DataFrame, key: str, columns: list[str], limit: float = 2.0) -> DataFrame:
    """(key, feature, z) beyond the limit."""
    long = z_scores(df.select(key, *columns), columns).unpivot([key], columns, "feature", "z")
    return long.where(F.abs("z") > limit)


def cv(value: str) -> Column:
    """Population deviation over mean; NULL below two values or at no size."""
    return F.when((F.count(value) >= 2) & (F.avg(value) > 1e-9), F.stddev_pop(value) / F.when(F.avg(value) > 1e-9, F.avg(value)))


def temporal_jitter_mm(df: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """(keys, jitter_mm): the median size of second differences over three frames in a row, in millimetres."""
    w = Window.partitionBy(*keys).orderBy(frame)
    contiguous = (F.lag(frame, 1).over(w) == F.col(frame) - 1) & (F.lag(frame, 2).over(w) == F.col(frame) - 2)
    second = F.sqrt(sum(F.pow(F.col(c) - 2 * F.lag(c, 1).over(w) + F.lag(c, 2).over(w), 2) for c in "xyz"))
    return df.withColumn("__s", F.when(contiguous, second)).groupBy(*keys).agg((1000 * F.median("__s")).alias("jitter_mm"))


def grid_coverage(x: Column, y: Column, width: Column, height: Column, cols: int = 8, rows: int = 6) -> Column:
    """The share of a picture's cells that hold a point."""
    cell = lambda v, size, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(v / size * n)))
    known = x.isNotNull() & y.isNotNull()  # greatest and least pass over NULL
    return F.count_distinct(F.when(known, cell(y, height, rows) * cols + cell(x, width, cols))) / F.lit(cols * rows)


def count_parity(counts: Column) -> Column:
    """(max - min) / max of an aggregate of counts: how far cameras' frame counts are apart."""
    return F.when(F.max(counts) > 0, (F.max(counts) - F.min(counts)) / F.when(F.max(counts) > 0, F.max(counts))).otherwise(F.lit(1.0))


def latency_summary(df: DataFrame, warmup: int = 3) -> DataFrame:
    """Warm-up mean, then mean, median, p95 and effective rate of the calls after it (seq, latency_ms)."""
    steady = F.when(F.col("seq") >= warmup, F.col("latency_ms"))
    return df.agg(F.avg(F.when(F.col("seq") < warmup, F.col("latency_ms"))).alias("warmup_mean_ms"), F.avg(steady).alias("mean_ms"), F.median(steady).alias("median_ms"), F.percentile(steady, 0.95).alias("p95_ms"), F.try_divide(F.lit(1000.0), F.avg(steady)).alias("fps"))


def bench_stats(df: DataFrame, group: str, ns: str) -> DataFrame:
    """Per group: min, median, mean, p95 (by rounded index), max, population deviation, throughput; ranked by median."""
    w = Window.partitionBy(group).orderBy(ns)
    df = df.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count("*").over(Window.partitionBy(group))})
    p95 = F.max(F.when(F.col("__i") == F.rint(0.95 * (F.col("__n") - 1)).cast("int"), F.col(ns)))
    return df.groupBy(group).agg(F.min(ns).alias("min_ns"), F.median(ns).alias("median_ns"), F.avg(ns).alias("mean_ns"), p95.alias("p95_ns"), F.max(ns).alias("max_ns"), F.stddev_pop(ns).alias("stdev_ns"), F.try_divide(F.lit(1e9), F.avg(ns)).alias("per_sec"))


def coverage_qa(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per file (frame, t, x, y, confidence): frames, index gaps, longest time gap, share out of the unit square, median step."""
    w = Window.partitionBy(*keys).orderBy("frame")
    df = df.withColumns({"__f": F.col("frame") - F.lag("frame").over(w), "__t": F.col("t") - F.lag("t").over(w), "__s": F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))})
    outside = ~(F.col("x").between(0, 1) & F.col("y").between(0, 1))
    return df.groupBy(*keys).agg(
        F.count_distinct("frame").alias("frames"), F.count_if(F.col("__f") > 1).alias("index_gaps"), F.max("__t").alias("max_gap_sec"), (100 * F.avg(outside.cast("double"))).alias("pct_outside"),
        F.median("__s").alias("median_step"), F.avg((F.col("confidence") > 0).cast("double")).alias("observation_rate"), F.median(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("median_confidence"),
    )


def mobility_verdict(amplitude: Column, speed: Column, rows: Column, amplitude_min: float = 40.0, speed_min: float = 60.0) -> Column:
    """A finger's screen by the amplitude of its flexion and its mean speed, over ``rows`` frames that have both."""
    return F.when(rows < 2, "insufficient valid observations").when((amplitude < amplitude_min) | (speed < speed_min), "finger mobility problem").otherwise("good mobility")


def finger_mobility(df: DataFrame, keys: list[str], flexion: str, speed: str, **limits) -> DataFrame:
    """(keys, n, amplitude, mean_speed, diagnostic) over the rows that have both a flexion and its speed; NULL below two of them."""
    both = F.col(flexion).isNotNull() & F.col(speed).isNotNull()
    seen = df.where(both).groupBy(*keys).agg(F.count("*").alias("n"), (F.max(flexion) - F.min(flexion)).alias("amplitude"), F.avg(F.abs(F.col(speed))).alias("mean_speed"))
    found = df.select(*keys).distinct().join(seen, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    found = found.withColumns({c: F.when(F.col("n") >= 2, F.col(c)) for c in ("amplitude", "mean_speed")})
    return found.withColumn("diagnostic", mobility_verdict(F.col("amplitude"), F.col("mean_speed"), F.col("n"), **limits))


def weighted_centroid(value: str, weight: str) -> Column:
    """sum(w x) / sum(w); the plain mean if all weights are 0."""
    return F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.when(F.sum(weight) != 0, F.sum(weight))), F.avg(value))


def quality_findings(df: DataFrame, keys: list[str], columns: list[str], expected: DataFrame | None = None, most: float = 0.5) -> DataFrame:
    """(keys, feature, finding, value) of what makes a table doubtful: ``missing`` (more than ``most`` of a group's cells), ``constant`` (a column without
    variance over the whole table; keys NULL), ``no_rows`` (expected keys that the table lacks)."""
    cells = lambda make: F.array(*[make(c) for c in columns])
    found = lambda name, c, value: F.struct(F.lit(c).alias("feature"), F.lit(name).alias("finding"), value.cast("double").alias("value"))
    gone = df.groupBy(*keys).agg(cells(lambda c: found("missing", c, F.avg(F.col(c).isNull().cast("double")))).alias("f")).select(*keys, F.inline("f")).where(F.col("value") > most)
    still = df.agg(cells(lambda c: found("constant", c, F.coalesce(F.max(c) - F.min(c), F.lit(0)))).alias("f")).select(*[F.lit(None).cast(dict(df.dtypes)[k]).alias(k) for k in keys], F.inline("f")).where("value = 0")
    out = gone.unionByName(still)
    if expected is not None:
        none = expected.select(*keys).distinct().join(df.select(*keys).distinct(), keys, "left_anti")
        out = out.unionByName(none.select(*keys, F.lit(None).cast("string").alias("feature"), F.lit("no_rows").alias("finding"), F.lit(0.0).alias("value")))
    return out
