"""Schemas of landmark tables: names, headers, and what a header says about its table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, NumericType, StringType, StructField, StructType

# The keypoint names of the landmark formats.
ARM_KEYPOINTS = [
    "left_shoulder", "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist",
    "left_index_base", "right_index_base", "left_middle_base", "right_middle_base", "left_pinky_base", "right_pinky_base",
]
BODY_KEYPOINTS = [
    "nose", "left_eye_inner", "left_eye", "left_eye_outer", "right_eye_inner", "right_eye", "right_eye_outer",
    "left_ear", "right_ear", "mouth_left", "mouth_right", "left_shoulder", "right_shoulder", "left_elbow",
    "right_elbow", "left_wrist", "right_wrist", "left_pinky", "right_pinky", "left_index", "right_index",
    "left_thumb", "right_thumb", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle",
    "left_heel", "right_heel", "left_foot_index", "right_foot_index",
]
HAND_POINTS = 21
# The nine columns of a world keypoint, in the order of the files.
WORLD_SUFFIXES = ["x_m", "y_m", "z_m", "confidence", "reproj_err_px", "candidate_n_views", "n_views", "cheirality_ok", "triangulation_angle_deg"]
# Bones (label, one end, other end) and the pairs that should be equally long.
BONES = [
    ("left_upper_arm", "arm_left_shoulder", "arm_left_elbow"),
    ("right_upper_arm", "arm_right_shoulder", "arm_right_elbow"),
    ("left_forearm", "arm_left_elbow", "arm_left_wrist"),
    ("right_forearm", "arm_right_elbow", "arm_right_wrist"),
    ("shoulder_width", "arm_left_shoulder", "arm_right_shoulder"),
    ("body_left_upper_arm", "body_left_shoulder", "body_left_elbow"),
    ("body_right_upper_arm", "body_right_shoulder", "body_right_elbow"),
    ("body_left_forearm", "body_left_elbow", "body_left_wrist"),
    ("body_right_forearm", "body_right_elbow", "body_right_wrist"),
    ("body_left_thigh", "body_left_hip", "body_left_knee"),
    ("body_right_thigh", "body_right_hip", "body_right_knee"),
    ("body_left_shank", "body_left_knee", "body_left_ankle"),
    ("body_right_shank", "body_right_knee", "body_right_ankle"),
    ("body_shoulder_width", "body_left_shoulder", "body_right_shoulder"),
    ("body_hip_width", "body_left_hip", "body_right_hip"),
]
SYMMETRIC_BONES = [
    ("left_upper_arm", "right_upper_arm"),
    ("left_forearm", "right_forearm"),
    ("body_left_upper_arm", "body_right_upper_arm"),
    ("body_left_forearm", "body_right_forearm"),
    ("body_left_thigh", "body_right_thigh"),
    ("body_left_shank", "body_right_shank"),
]
# The identity tags that stand last in an artifact.
ARTIFACT_TAGS = [
    "artifact_kind", "source_sha256", "coord_space", "distance_unit", "producer_version", "metric_method_version",
    "qc_policy_version", "metric_qualification", "provenance_class",
]
KEYS = ["video", "frame_idx", "timestamp_sec", "person_idx"]

_KEY_FIELDS = [StructField("video", StringType()), StructField("frame_idx", IntegerType()), StructField("timestamp_sec", DoubleType()), StructField("person_idx", IntegerType())]


def keypoint_columns(mode: str, hand_confidence: bool = True) -> list[tuple[str, list[str]]]:
    """(keypoint, its columns) of a 2D table in order; mode is hands, hands-arms or body."""
    names = {"body": [f"body_{n}" for n in BODY_KEYPOINTS], "hands-arms": [f"arm_{n}" for n in ARM_KEYPOINTS], "hands": []}[mode]
    out = [(n, [f"{n}_{c}" for c in ("x", "y", "z", "vis")]) for n in names]
    coords = ("x", "y", "z", "conf") if hand_confidence else ("x", "y", "z")
    return out + [(f"{s}_hand_{k}", [f"{s}_hand_{k}_{c}" for c in coords]) for s in ("left", "right") for k in range(HAND_POINTS)]


def landmark_schema(mode: str, hand_confidence: bool = True) -> StructType:
    return StructType(_KEY_FIELDS + [StructField(c, DoubleType()) for _, cs in keypoint_columns(mode, hand_confidence) for c in cs])


def world_schema(names: list[str]) -> StructType:
    kinds = dict.fromkeys(("candidate_n_views", "n_views", "cheirality_ok"), IntegerType())
    return StructType(_KEY_FIELDS + [StructField(f"{n}_{s}", kinds.get(s, DoubleType())) for n in names for s in WORLD_SUFFIXES])


def tracking_mode(columns: list[str]) -> str:
    if any(c.startswith("body_") for c in columns):
        return "body"
    return "hands-arms" if any(c.startswith("arm_") for c in columns) else "hands"


def is_world(columns: list[str]) -> bool:
    return any(c.endswith("_x_m") for c in columns)


def coordinate_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if re.search(r"_[xyz]$", c)]


def body_column(mode: str, side: str, keypoint: str, coordinate: str) -> str:
    return f"{'body' if mode == 'body' else 'arm'}_{side}_{keypoint}_{coordinate}"


def hand_column(side: str, point: int, coordinate: str) -> str:
    return f"{side}_hand_{point}_{coordinate}"


def column_or_null(df: DataFrame, name: str) -> Column:
    """The column as double, NULL throughout if the table lacks it."""
    return F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")


def numeric_features(df: DataFrame, but: list[str] | None = None) -> list[str]:
    """Numeric columns that are neither keys nor tags."""
    skip = {*KEYS, *ARTIFACT_TAGS, *(but or [])}
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in skip]


def feature_name_parts(column: Column) -> Column:
    """struct(part, keypoint, coord) of a landmark column name."""
    hand = r"^(left|right)_hand_(\d+)_(x|y|z|vis|conf)$"
    body = r"^(body|arm)_(.+)_(x|y|z|vis|conf)$"
    part = F.when(column.rlike(hand), F.concat(F.regexp_extract(column, hand, 1), F.lit("_hand"))).otherwise(F.regexp_extract(column, body, 1))
    keypoint = F.when(column.rlike(hand), F.regexp_extract(column, hand, 2)).otherwise(F.regexp_extract(column, body, 2))
    return F.struct(part.alias("part"), keypoint.alias("keypoint"), F.regexp_extract(column, r"_(x|y|z|vis|conf)$", 1).alias("coord"))


def keypoint_label(part: Column, index: Column, scheme: str = "arm") -> Column:
    """A readable label: the scheme's name for body points, part and number for hands."""
    names = ARM_KEYPOINTS if scheme == "arm" else BODY_KEYPOINTS
    known = F.array(*map(F.lit, names))
    return F.when((part == "body") & (index < len(names)), F.get(known, index)).otherwise(F.concat_ws("_", part, index.cast("string")))


# Column names of the window table, and below of the quality, phase, metrics and detail tables.
_SIDE_METRICS = ["wrist_sal", "wrist_velocity_mean", "wrist_velocity_peak", "wrist_normalized_jerk", "wrist_movement_efficiency", "fingertip_normalized_jerk"]
BODY_WINDOW_METRICS = [
    "compensatory_pattern_index", "trunk_lean_mean", "trunk_lean_sd", "trunk_lean_range", "trunk_lean_sagittal_mean",
    "trunk_lean_sagittal_sd", "trunk_lean_lateral_mean", "trunk_lean_lateral_sd", "trunk_rotation_mean",
    "trunk_rotation_sd", "posture_symmetry_mean", "posture_symmetry_sd",
]
BILATERAL = ["symmetry_ratio", "dominance_index", "abs_diff"]


def window_schema() -> StructType:
    """Of the window table: keys, six metrics a side, twelve of the body, three comparisons of each metric."""
    names = [f"{s}_{m}" for s in ("left", "right") for m in _SIDE_METRICS] + BODY_WINDOW_METRICS + [f"{m}_{b}" for m in _SIDE_METRICS for b in BILATERAL]
    keys = [StructField("video", StringType()), StructField("person_idx", IntegerType()), StructField("window_start_sec", DoubleType()), StructField("window_end_sec", DoubleType())]
    return StructType(keys + [StructField(n, DoubleType()) for n in names])


def qc_schema() -> StructType:
    return StructType.fromDDL(
        "video string, person_idx int, window_start_sec double, window_end_sec double, metric_id string, source_group string, "
        "n_expected_frames int, n_valid_frames int, frame_coverage double, n_expected_intervals int, n_valid_intervals int, "
        "interval_coverage double, valid_duration_sec double, longest_gap_frames int, longest_gap_sec double, n_gaps int, "
        "required_keypoints string, n_required_keypoints_present int, min_coverage double, max_gap_sec double, qc_status string, qc_reason string"
    )


def phase_schema() -> StructType:
    return StructType.fromDDL(
        "video string, person_idx int, side string, movement_idx int, phase string, start_frame int, end_frame int, duration_sec double, "
        "peak_velocity double, mean_velocity double, path_length double, smoothness_nj double, smoothness_sal double, mean_reach_symmetry double, "
        "movement_duration_sec double, movement_n_phases int, movement_peak_velocity double, movement_path_length double, movement_efficiency double"
    )


def metrics_schema() -> StructType:
    """Of the per-frame metrics table."""
    whole = ["body_detected", "n_hands_real", "n_hands_synthetic", "n_hands_recrop", "angle_corrections_n", "body_carry", "body_carry_frames", "hand_L_carry", "hand_R_carry"]
    names = [
        "body_detected", "body_det_score", "n_hands_real", "n_hands_synthetic", "n_hands_recrop", "body_vis_mean", "body_vis_min", "hand_L_flag", "hand_R_flag",
        "body_jitter_px", "hand_L_jitter_px", "hand_R_jitter_px", "body_smooth_delta_px", "hand_L_smooth_delta_px", "hand_R_smooth_delta_px", "bone_correction_px",
        "angle_corrections_n", "body_carry", "body_carry_frames", "hand_L_carry", "hand_R_carry", "hand_arm_match_dist_L", "hand_arm_match_dist_R", "inference_ms",
    ]
    return StructType(_KEY_FIELDS + [StructField(n, IntegerType() if n in whole else DoubleType()) for n in names])


def detail_schema() -> StructType:
    """Of the per-keypoint detail table."""
    return StructType.fromDDL("frame_idx int, person_idx int, part string, kp_idx int, x_raw double, y_raw double, x_smooth double, y_smooth double, visibility double, jitter_px double")
