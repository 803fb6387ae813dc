"""Movements and their phases: runs of speed, joined over short pauses, split by how the grasp opens and closes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motiondeck.operators.grid import spectral_arc_length
from motiondeck.operators.ordered import fill_forward_back, running_median, series, smoothness, step_length, with_runs


def speeds(df: DataFrame, keys: list[str], order: list[str], fs: str = "fs", k: int = 5) -> DataFrame:
    """df with ``frame`` (1, 2, ... by order) and ``speed``: step times rate, a gap at rest, running median of k."""
    w = series(keys, order)
    df = df.withColumns({"frame": F.row_number().over(w), "__raw": F.coalesce(step_length(w, "x", "y", "z") * F.col(fs), F.lit(0.0))})
    return df.withColumn("speed", running_median(w, "__raw", k)).drop("__raw")


def movements(df: DataFrame, keys: list[str], *, share: float = 0.05, shortest: int = 5, pause: int = 3) -> DataFrame:
    """Rows of df within a movement, with ``movement_idx``. Needs frame and speed.

    Active rows are faster than a share of the series' peak speed. Runs whose start is at most ``pause`` frames after
    the end of the one before are one movement; movements shorter than ``shortest`` frames do not count.
    """
    whole = Window.partitionBy(*keys)
    w = series(keys, ["frame"])
    peak = F.max("speed").over(whole)
    df = df.withColumns({"threshold": peak * share, "__peak": peak})
    active = df.where((F.col("__peak") >= 1e-10) & (F.col("speed") > F.col("threshold")))
    gap = F.col("frame") - F.lag("frame").over(w)
    active = active.withColumn("__m", F.sum(F.when(gap > pause, 1).otherwise(0)).over(w))
    spans = active.groupBy(*keys, "__m").agg(F.min("frame").alias("m_start"), F.max("frame").alias("m_end")).where(F.col("m_end") - F.col("m_start") + 1 >= shortest)
    spans = spans.withColumn("movement_idx", F.row_number().over(Window.partitionBy(*keys).orderBy("m_start"))).drop("__m")
    # each frame of a span, so that the join with the rows is an equality
    frames = spans.withColumn("frame", F.explode(F.sequence("m_start", "m_end")))
    return df.drop("__peak").join(frames, [*keys, "frame"])


def phases(df: DataFrame, keys: list[str], *, aperture: str = "aperture", shortest: int = 3) -> DataFrame:
    """df (rows of movements) with ``phase``: REACH, GRASP, TRANSPORT or RELEASE.

    The aperture is smoothed and filled; where its smoothed change stays below minus (above plus) 5 % of its
    range for ``shortest`` frames, the grasp closes (opens). The first closing run starts GRASP and its end ends it; the
    first opening run after that starts RELEASE; what lies between is TRANSPORT.
    """
    own = [*keys, "movement_idx"]
    w, whole = series(own, ["frame"]), Window.partitionBy(*own)
    df = df.withColumn("__ap", running_median(w, aperture, 3))
    df = df.withColumn("__ap", fill_forward_back(w, "__ap"))
    df = df.withColumn("__d", F.coalesce(F.col("__ap") - F.lag("__ap").over(w), F.lit(0.0)))
    df = df.withColumns({"__d": running_median(w, "__d", 3), "__range": F.max("__ap").over(whole) - F.min("__ap").over(whole), "__n": F.count("*").over(whole), "__end": F.max("frame").over(whole)})
    way = F.when(F.col("__d") < -0.05 * F.col("__range"), -1).when(F.col("__d") > 0.05 * F.col("__range"), 1).otherwise(0)
    df = with_runs(df.withColumn("__way", way), w, F.col("__way"), "__run")
    run = Window.partitionBy(*own, "__run")
    df = df.withColumns({"__a": F.min("frame").over(run), "__b": F.max("frame").over(run)}).withColumn("__long", F.col("__b") - F.col("__a") + 1 >= shortest)
    usable = (F.col("__range") >= 1e-8) & (F.col("__n") >= 2 * shortest)
    df = df.withColumn("__g", F.min(F.when(usable & F.col("__long") & (F.col("__way") == -1), F.struct("__a", "__b"))).over(whole))
    opens = F.min(F.when(F.col("__long") & (F.col("__way") == 1) & (F.col("__a") > F.col("__g.__b")), F.col("__a"))).over(whole)
    df = df.withColumn("__r", opens)
    frame, end = F.col("frame"), F.col("__g.__b")
    phase = (
        F.when(F.col("__g").isNull() | (frame < F.col("__g.__a")), "REACH").when(frame <= end, "GRASP").when(frame >= F.col("__r"), "RELEASE")
        .when(F.col("__r").isNull() | (F.col("__r") - end >= shortest), "TRANSPORT").otherwise("REACH")
    )
    return df.withColumn("phase", phase).drop("__ap", "__d", "__range", "__n", "__end", "__way", "__run", "__a", "__b", "__long", "__g", "__r")


def phase_table(df: DataFrame, keys: list[str], *, time: str = "t", symmetry: str | None = None, fs: str = "fs") -> DataFrame:
    """A row a phase run: its frames, duration, speeds, path, jerk and spectral arc length, and the sums of its movement."""
    own = [*keys, "movement_idx"]
    df = with_runs(df, series(own, ["frame"]), F.col("phase"), "phase_run")
    part = [*own, "phase_run"]
    sym = F.col(symmetry) if symmetry else F.lit(None).cast("double")

    def table(group: list[str], prefix: str) -> DataFrame:
        shape = smoothness(df, group, ["frame"], fs).select(*group, F.col("path").alias(f"{prefix}path"), F.col("efficiency").alias(f"{prefix}eff"), F.col("normalized_jerk").alias(f"{prefix}nj"))
        facts = df.groupBy(*group).agg(
            F.first("phase").alias(f"{prefix}phase"), F.min("frame").alias(f"{prefix}start"), F.max("frame").alias(f"{prefix}end"), (F.max_by(time, "frame") - F.min_by(time, "frame")).alias(f"{prefix}dur"),
            F.max("speed").alias(f"{prefix}peak"), F.avg("speed").alias(f"{prefix}mean"), F.avg(sym).alias(f"{prefix}sym"), F.count_distinct("phase_run").alias(f"{prefix}runs"),
        )
        return facts.join(shape, group, "left")

    # a phase is some tens of frames: its speeds are one array
    held = df.groupBy(*part).agg(F.first(fs).alias("__fs"), F.transform(F.array_sort(F.collect_list(F.struct("frame", "speed"))), lambda x: x["speed"]).alias("__speeds"))
    arcs = spectral_arc_length(held, "__speeds", "__fs", "p_sal").select(*part, "p_sal")
    found = table(part, "p_").join(arcs, part, "left").join(table(own, "m_"), own)
    return found.select(
        *own, F.col("p_phase").alias("phase"), F.col("p_start").alias("start_frame"), F.col("p_end").alias("end_frame"), F.round("p_dur", 4).alias("duration_sec"),
        F.round("p_peak", 6).alias("peak_velocity"), F.round("p_mean", 6).alias("mean_velocity"), F.round(F.coalesce("p_path", F.lit(0.0)), 6).alias("path_length"), F.round("p_nj", 4).alias("smoothness_nj"), F.round("p_sal", 4).alias("smoothness_sal"),
        F.round("p_sym", 4).alias("mean_reach_symmetry"), F.round("m_dur", 4).alias("movement_duration_sec"), F.col("m_runs").cast("int").alias("movement_n_phases"),
        F.round("m_peak", 6).alias("movement_peak_velocity"), F.round(F.coalesce("m_path", F.lit(0.0)), 6).alias("movement_path_length"), F.round("m_eff", 4).alias("movement_efficiency"),
    )


