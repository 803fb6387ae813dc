"""Validation and capture reports: sections as one long table of measures (keys, check, metric, value), graded in one pass.

A section is a DataFrame of measures for any number of sessions; ``stacked`` sections make a report. ``metric`` names the band that grades a check
(``grading``). What was not assessed has no row; what was assessed but could not be measured has a NULL value and warns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motiondeck.functions.geometry import ratio
from motiondeck.operators import grading


def _number(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def measures(df: DataFrame, keys: list[str], checks: list[tuple[str, str, Column]], where: dict[str, Column] | None = None) -> DataFrame:
    """A row a check (name, metric, value) of each row of df; where: the condition under which an optional check is made at all."""
    row = lambda name, metric, value: F.struct(F.lit(name).alias("check"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))
    rows = [F.when((where or {}).get(name, F.lit(True)), row(name, metric, value)) for name, metric, value in checks]
    return df.select(*keys, F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))


def stacked(sections: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, sections)


def interval(start: Column, frames: Column, expected: Column, base: int) -> Column:
    """Whether a frame lies in the expected frames of a source that counts from ``base``."""
    return (frames >= start + base) & (frames < start + base + expected)


def tracking(points: DataFrame, cameras: DataFrame, keys: list[str], floor: float = 0.3) -> DataFrame:
    """Per camera: observed, expected and dropped frames, detection rate, share of low confidences.

    points: keys, camera, frame, keypoint, x, y, confidence. cameras: keys, camera, expected_frames, sync_offset, and keypoints (those that
    the layout has; NULL: as many as any frame shows). Frames before the offset or beyond the expected ones do not count; the source counts from 0
    or 1, whichever covers more frames, and if both do from 0 where there is a frame 0. Absent frames count as dropped, their points as undetected.
    """
    known = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    seen = known(F.col("x")) & known(F.col("y")) & known(F.col("confidence")) & (F.col("confidence") > 0)
    frames = points.groupBy(*keys, "camera", "frame").agg(F.count_if(seen).alias("found"), F.count_if(seen & (F.col("confidence") < floor)).alias("low"), F.count_distinct("keypoint").alias("shown"))
    df = cameras.join(frames, [*keys, "camera"], "left").withColumn("sync_offset", F.coalesce("sync_offset", F.lit(0)))
    inside = [interval(F.col("sync_offset"), F.col("frame"), F.col("expected_frames"), b) for b in (0, 1)]
    sums = [
        F.struct(F.count_if(i).alias("observed"), F.coalesce(F.sum(F.when(i, F.col("found"))), F.lit(0)).alias("found"), F.coalesce(F.sum(F.when(i, F.col("low"))), F.lit(0)).alias("low"), F.count_if(i & (F.col("found") > 0)).alias("hit"), F.max(F.when(i, F.col("shown"))).alias("shown"))
        for i in inside
    ]
    zero = F.coalesce(F.max((F.col("frame") == 0).cast("int")), F.lit(0)) == 1
    own = df.groupBy(*keys, "camera").agg(sums[0].alias("a"), sums[1].alias("b"), zero.alias("zero"), F.max("expected_frames").alias("expected_frames"), F.max("keypoints").alias("keypoints"))
    first = (F.col("a.observed") > F.col("b.observed")) | ((F.col("a.observed") == F.col("b.observed")) & F.col("zero"))
    own = own.withColumn("s", F.when(first, F.col("a")).otherwise(F.col("b")))
    slots = F.col("expected_frames") * F.coalesce("keypoints", "s.shown", F.lit(0))
    return own.select(*keys, "camera", F.col("s.observed").alias("observed_frames"), "expected_frames", F.greatest(F.lit(0), F.col("expected_frames") - F.col("s.hit")).alias("dropped_frames"), ratio(F.col("s.found"), slots).alias("detection_rate"), ratio(F.col("s.low"), F.col("s.found")).alias("low_confidence_fraction"))


def expected_fused(cameras: DataFrame, keys: list[str], views: int = 2) -> DataFrame:
    """(keys, expected_frames): how many logical frames ``views`` cameras can show; 0 with fewer cameras."""
    counts = F.reverse(F.array_sort(F.collect_list("expected_frames")))
    return cameras.groupBy(*keys).agg(F.coalesce(F.get(counts, F.lit(views - 1)), F.lit(0)).alias("expected_frames"))


def fusion(fused: DataFrame, expected: DataFrame, keys: list[str], angles: bool = True, candidates: bool = True) -> DataFrame:
    """One row a session over a long fused table: keys, frame, keypoint, x, y, z, reproj_err_px, n_views, cheirality_ok, trusted and, where the
    source has them, triangulation_angle_deg and candidate_n_views. expected: keys, expected_frames.

    Denominators: frames are counted against the expected ones, trusted points against expected frames times active keypoints, unfused points
    against observed frames times active keypoints. A keypoint is active if any frame fused it or had two views to try.
    """
    df = fused.join(expected, keys)
    bases = df.groupBy(*keys).agg(*[F.count_distinct(F.when(interval(F.lit(0), F.col("frame"), F.col("expected_frames"), b), F.col("frame"))).alias(f"n{b}") for b in (0, 1)], F.max((F.col("frame") == 0).cast("int")).alias("zero"))
    base = F.when((F.col("n0") > F.col("n1")) | ((F.col("n0") == F.col("n1")) & (F.col("zero") == 1)), 0).otherwise(1)
    df = df.join(bases.select(*keys, base.alias("base")), keys).where((F.col("expected_frames") <= 0) | interval(F.col("base"), F.col("frame"), F.col("expected_frames"), 0))
    ok = F.coalesce(reduce(Column.__and__, [_number(F.col(c)).isNotNull() for c in "xyz"]), F.lit(False))
    tried = F.coalesce(F.col("candidate_n_views"), F.col("n_views")) if candidates else F.col("n_views")
    of = lambda c: _number(F.col(c).cast("double"))
    eligible = F.col("candidate_n_views") >= 2 if candidates else F.lit(False)
    rejected = F.greatest(F.col("candidate_n_views") - F.col("n_views"), F.lit(0)) if candidates else F.lit(None)
    trusted = F.col("trusted").cast("boolean")
    own = df.groupBy(*keys).agg(
        F.count_distinct("frame").alias("n_frames_fused"), F.max("expected_frames").alias("expected_frames"), F.size(F.collect_set(F.when(ok | (tried >= 2), F.col("keypoint")))).alias("n_active_keypoints"),
        F.count_if(ok).alias("__fused"), F.count_if(ok & trusted).alias("__trusted"), F.count_if(ok & ~(F.col("cheirality_ok").cast("boolean"))).alias("__behind"),
        F.median(of("reproj_err_px")).alias("reproj_err_px_median"), F.percentile(of("reproj_err_px"), 0.95).alias("reproj_err_px_p95"), F.max(of("reproj_err_px")).alias("reproj_err_px_max"),
        F.median(F.when(ok, F.col("n_views"))).alias("n_views_median"), F.coalesce(F.min(F.when(ok, F.col("n_views"))), F.lit(0)).alias("n_views_min"),
        (F.percentile(of("triangulation_angle_deg"), 0.05) if angles else F.lit(None).cast("double")).alias("triangulation_angle_deg_p05"), (F.median(of("triangulation_angle_deg")) if angles else F.lit(None).cast("double")).alias("triangulation_angle_deg_median"),
        (F.median(F.when(eligible, F.col("candidate_n_views"))) if candidates else F.lit(None).cast("double")).alias("candidate_n_views_median"),
        (F.try_divide(F.sum(F.when(eligible, rejected)), F.sum(F.when(eligible, F.col("candidate_n_views")))) if candidates else F.lit(None).cast("double")).alias("view_rejection_fraction"),
    )
    slots = F.col("n_active_keypoints") * F.col("n_frames_fused")
    return own.select(
        *keys, "n_frames_fused", "expected_frames", ratio(F.col("n_frames_fused"), F.col("expected_frames")).alias("fused_frame_fraction"), "n_active_keypoints", ratio(F.col("__trusted"), F.col("n_active_keypoints") * F.col("expected_frames")).alias("trusted_keypoint_fraction"),
        "reproj_err_px_median", "reproj_err_px_p95", "reproj_err_px_max", "n_views_median", "n_views_min", ratio(F.col("__behind"), F.col("__fused")).alias("cheirality_violation_rate"), "triangulation_angle_deg_p05", "triangulation_angle_deg_median",
        "candidate_n_views_median", "view_rejection_fraction", ratio(slots - F.col("__fused"), slots).alias("unfused_keypoint_fraction"), F.lit(angles).alias("triangulation_angle_available"), F.lit(candidates).alias("candidate_views_available"),
    )


def worst_cameras(cameras: DataFrame, keys: list[str], rate: str = "detection_rate", low: str = "low_confidence_fraction") -> DataFrame:
    """(keys, worst_detection_rate, worst_low_confidence_fraction) over the cameras for which they are known."""
    return cameras.groupBy(*keys).agg(F.min(_number(F.col(rate))).alias("worst_detection_rate"), F.max(_number(F.col(low))).alias("worst_low_confidence_fraction"))


def fusion_checks(found: DataFrame, keys: list[str]) -> DataFrame:
    c = F.col
    return measures(found, keys, [
        ("fusion.reproj_err_px_median", "fusion_reproj_median_px", c("reproj_err_px_median")), ("fusion.reproj_err_px_p95", "fusion_reproj_p95_px", c("reproj_err_px_p95")), ("fusion.n_views_median", "n_views_median", c("n_views_median")),
        ("fusion.fused_frame_fraction", "min_fused_frame_fraction", c("fused_frame_fraction")), ("fusion.trusted_keypoint_fraction", "min_trusted_keypoint_fraction", c("trusted_keypoint_fraction")),
        ("fusion.triangulation_angle_deg_p05", "min_triangulation_angle_p05_deg", c("triangulation_angle_deg_p05")), ("fusion.view_rejection_fraction", "max_view_rejection_fraction", c("view_rejection_fraction")),
        ("fusion.n_views_min", "n_views_floor", c("n_views_min")), ("fusion.unfused_keypoint_fraction", "max_unfused_fraction", c("unfused_keypoint_fraction")), ("fusion.cheirality_violation_rate", "max_cheirality_rate", c("cheirality_violation_rate")),
    ], {"fusion.triangulation_angle_deg_p05": c("triangulation_angle_available"), "fusion.view_rejection_fraction": c("candidate_views_available")})


def tracking_checks(cameras: DataFrame, keys: list[str]) -> DataFrame:
    return measures(worst_cameras(cameras, keys), keys, [("tracking.worst_low_confidence_fraction", "max_low_confidence_fraction", F.col("worst_low_confidence_fraction")), ("tracking.worst_detection_rate", "min_tracking_detection_rate", F.col("worst_detection_rate"))])


def session_checks(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Checks of figures a session: reprojection_error_px, mean_bone_length_cv, temporal_jitter_mm, throughput_fps, mean_symmetry_rel_diff."""
    c = F.col
    return measures(sessions, keys, [
        ("calibration.reprojection_error_px", "calib_reproj_rms_px", c("reprojection_error_px")), ("agreement.mean_bone_length_cv", "max_bone_length_cv", c("mean_bone_length_cv")), ("agreement.temporal_jitter_mm", "max_temporal_jitter_mm", c("temporal_jitter_mm")),
        ("timing.throughput_fps", "min_throughput_fps", c("throughput_fps")), ("agreement.mean_symmetry_rel_diff", "max_symmetry_rel_diff", c("mean_symmetry_rel_diff")),
    ])


def baseline_checks(found: DataFrame, keys: list[str]) -> DataFrame:
    """Checks of the errors against a baseline (keys, metric, error): only angles (``_deg``) have a tolerance."""
    return found.where(F.col("metric").endswith("_deg")).select(*keys, F.concat(F.lit("agreement."), "metric").alias("check"), F.lit("agreement_tolerance_deg").alias("metric"), F.col("error").cast("double").alias("value"))


def capture_checks(boards: DataFrame, counts: DataFrame, subjects: DataFrame, sessions: DataFrame, keys: list[str]) -> DataFrame:
    """The checks of a raw capture. boards: keys, camera, detection_rate, coverage, n_detected (none: the board is not assessed). counts: keys,
    camera, frames. subjects: what ``tracking`` gives (none: not assessed). sessions: keys, reprojection_error_px."""
    board = boards.groupBy(*keys).agg(F.min(_number(F.col("coverage"))).alias("coverage"), F.min(_number(F.col("detection_rate"))).alias("rate"), F.min("n_detected").alias("least"))
    many, most = F.count("frames") >= 2, F.max("frames")
    parity = counts.groupBy(*keys).agg(F.when(many & (most > 0), F.try_divide(most - F.min("frames"), most)).alias("disparity"))
    return stacked([
        measures(sessions, keys, [("calibration.reprojection_error_px", "calib_reproj_rms_px", F.col("reprojection_error_px"))]),
        measures(board, keys, [("calibration.worst_board_coverage", "min_board_coverage", F.col("coverage")), ("calibration.worst_charuco_detection_rate", "min_charuco_detection_rate", F.col("rate")), ("calibration.min_charuco_frames", "charuco_frames_floor", F.col("least"))]),
        measures(parity, keys, [("parity.frame_count_disparity", "max_frame_count_disparity", F.col("disparity"))]),
        measures(worst_cameras(subjects, keys), keys, [("subject.worst_detection_rate", "min_subject_detection_rate", F.col("worst_detection_rate")), ("subject.worst_low_confidence_fraction", "max_low_confidence_fraction", F.col("worst_low_confidence_fraction"))]),
    ])


def graded(report: DataFrame, keys: list[str], capture: bool = False) -> DataFrame:
    """The report's checks with grade and informational flag; bands and floors of the report or of the capture gate."""
    limits = [*grading.THRESHOLDS, *grading.FLOORS, *(grading.CAPTURE_THRESHOLDS if capture else [])]
    return grading.grade(report, grading.bands(report.sparkSession, limits), [] if capture else None).select(*keys, "check", "value", "grade", "severity", "informational")


def missing_sections(report: DataFrame, sessions: DataFrame, keys: list[str], sections: list[str]) -> DataFrame:
    """(keys, section): what a session's report does not assess, as rows."""
    there = report.select(*keys, F.substring_index("check", ".", 1).alias("section")).distinct()
    return sessions.select(*keys).distinct().select(*keys, F.explode(F.array(*map(F.lit, sections))).alias("section")).join(there, [*keys, "section"], "left_anti")
