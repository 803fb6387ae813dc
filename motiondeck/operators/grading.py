"""Grades of measured figures against bands, and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Acceptance bands (metric, warn, fail, direction).
THRESHOLDS = [
    ("calib_reproj_rms_px", 1.0, 2.0, "max"),
    ("fusion_reproj_median_px", 8.0, 12.0, "max"),
    ("fusion_reproj_p95_px", 15.0, 20.0, "max"),
    ("n_views_median", 3.0, 2.0, "min"),
    ("min_tracking_detection_rate", 0.80, 0.50, "min"),
    ("max_low_confidence_fraction", 0.2, 0.4, "max"),
    ("min_fused_frame_fraction", 0.95, 0.80, "min"),
    ("min_trusted_keypoint_fraction", 0.90, 0.75, "min"),
    ("min_triangulation_angle_p05_deg", 2.0, 1.0, "min"),
    ("max_view_rejection_fraction", 0.05, 0.20, "max"),
    ("max_unfused_fraction", 0.1, 0.25, "max"),
    ("max_cheirality_rate", 0.01, 0.05, "max"),
    ("min_throughput_fps", 15.0, 5.0, "min"),
    ("max_bone_length_cv", 0.05, 0.10, "max"),
    ("max_temporal_jitter_mm", 5.0, 15.0, "max"),
    ("max_symmetry_rel_diff", 0.05, 0.10, "max"),
    ("agreement_tolerance_deg", 5.0, 10.0, "max"),
]
CAPTURE_THRESHOLDS = [
    ("min_charuco_detection_rate", 0.30, 0.10, "min"),
    ("min_board_coverage", 0.60, 0.35, "min"),
    ("max_frame_count_disparity", 0.05, 0.20, "max"),
    ("min_subject_detection_rate", 0.80, 0.50, "min"),
]
#: Floors: below them a check fails, there is nothing between.
FLOORS = [("n_views_floor", 2.0, 2.0, "min"), ("charuco_frames_floor", 8.0, 8.0, "min")]
INFORMATIONAL = ["min_throughput_fps", "max_symmetry_rel_diff"]


def bands(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or THRESHOLDS, "metric string, warn double, fail double, direction string")


def severity(value: Column, warn: Column, fail: Column, direction: Column) -> Column:
    """0 pass, 1 warn, 2 fail. What could not be measured warns."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    up = F.when(value <= warn, 0).when(value <= fail, 1).otherwise(2)
    down = F.when(value >= warn, 0).when(value >= fail, 1).otherwise(2)
    return F.when(bad, 1).when(direction == "max", up).otherwise(down)


def grade_name(code: Column) -> Column:
    return F.get(F.array(*map(F.lit, ("PASS", "WARN", "FAIL"))), code)


def grade(measures: DataFrame, limits: DataFrame, informational: list[str] | None = None) -> DataFrame:
    """measures (metric, value, any keys) with severity, grade and informational."""
    found = measures.join(F.broadcast(limits), "metric")
    found = found.withColumn("severity", severity(F.col("value"), F.col("warn"), F.col("fail"), F.col("direction")))
    return found.withColumns({"grade": grade_name(F.col("severity")), "informational": F.col("metric").isin(informational if informational is not None else INFORMATIONAL)})


def verdict(checks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, verdict, checks): the worst grade that is not informational."""
    worst = F.coalesce(F.max(F.when(~F.col("informational"), F.col("severity"))), F.lit(0))
    return checks.groupBy(*keys).agg(grade_name(worst).alias("verdict"), F.count("*").alias("checks"))


def calibration_section(cameras: DataFrame) -> DataFrame:
    """camera, fx, fy, cx, cy and the size of the distortion, by camera name."""
    k = lambda i, j: F.get(F.get("K", F.lit(i)), F.lit(j))
    size = F.sqrt(F.aggregate("distortion", F.lit(0.0), lambda a, x: a + x * x))
    return cameras.select("name", k(0, 0).alias("fx"), k(1, 1).alias("fy"), k(0, 2).alias("cx"), k(1, 2).alias("cy"), size.alias("distortion_norm")).orderBy("name")
