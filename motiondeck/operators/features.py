"""From a landmark table to its frame, window, quality and phase tables.

A table is 2D (evidence columns gate its coordinates) or a gated 3D one. Rows of a recording are ordered by frame.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from motiondeck.functions import geometry as g
from motiondeck.functions.text import artifact_tags
from motiondeck.operators import gates, grid, ordered, phases
from motiondeck.sources.schema import BILATERAL, BODY_WINDOW_METRICS, KEYS, body_column, column_or_null, hand_column, is_world, tracking_mode

GROUP = ["video", "person_idx"]
WINDOW = [*GROUP, "window_idx", "window_start", "window_end"]
SIDE_METRICS = {
    "wrist_sal": "wrist", "wrist_velocity_mean": "wrist", "wrist_velocity_peak": "wrist", "wrist_normalized_jerk": "wrist",
    "wrist_movement_efficiency": "wrist", "fingertip_normalized_jerk": "fingertip",
}
FRAME_METRICS = [
    "elbow_angle_deg", "wrist_deviation_deg", "finger_spread_deg", "reach_raw", "reach_norm", "grasp_aperture_thumb_index",
    "grasp_aperture_thumb_pinky", "wrist_displacement", "fingertip_displacement",
]
TRUNK = ["trunk_lean_deg", "trunk_lean_lateral_deg", "trunk_lean_sagittal_deg", "trunk_rotation_deg", "posture_symmetry"]


def gated(df: DataFrame) -> tuple[DataFrame, str, bool]:
    """(the table with unobserved coordinates NULL, its mode, whether it is 3D)."""
    mode, world = tracking_mode(df.columns), is_world(df.columns)
    return (gates.gate_3d(df) if world else gates.gate_2d(df)), mode, world


def _point(df: DataFrame, name) -> g.Point:
    return tuple(column_or_null(df, name(c)) for c in "xyz")


def _points(df: DataFrame, mode: str, side: str) -> dict[str, g.Point]:
    body = lambda k, s=side: _point(df, lambda c: body_column(mode, s, k, c))
    hand = lambda i: _point(df, lambda c: hand_column(side, i, c))
    other = "right" if side == "left" else "left"
    return {
        "shoulder": body("shoulder"), "elbow": body("elbow"), "wrist": body("wrist"), "aim": body("index" if mode == "body" else "middle_base"), "far": body("shoulder", other),
        "hand": hand(0), "thumb": hand(4), "index": hand(8), "pinky": hand(20),
    }


def frame_features(df: DataFrame, mode: str, world: bool = False) -> DataFrame:
    """54 columns a frame: keys, nine features a side, three comparisons of each, five of the trunk."""
    w = ordered.series(GROUP, ["frame_idx"])
    cells = {}
    for side in ("left", "right"):
        p = _points(df, mode, side)
        reach, width = g.distance(p["shoulder"], p["wrist"]), g.distance(p["shoulder"], p["far"])
        moved = lambda q: g.distance(q, tuple(F.lag(c).over(w) for c in q))
        values = [
            g.angle_at_vertex(p["shoulder"], p["elbow"], p["wrist"]), g.angle_at_vertex(p["elbow"], p["wrist"], p["aim"]), g.angle_at_vertex(p["index"], p["hand"], p["pinky"]),
            reach, g.ratio(reach, width, 1e-6), g.distance(p["thumb"], p["index"]), g.distance(p["thumb"], p["pinky"]), moved(p["wrist"]), moved(p["index"]),
        ]
        cells |= {f"{side}_{n}": v for n, v in zip(FRAME_METRICS, values, strict=True)}
    trunk = dict.fromkeys(TRUNK, F.lit(None).cast("double"))
    if mode == "body":
        at = [_point(df, lambda c, s=s, k=k: body_column("body", s, k, c)) for k in ("shoulder", "hip") for s in ("left", "right")]
        trunk |= g.trunk_3d(*at) if world else g.trunk_2d(*at)
    out = df.select(*KEYS, *[c.alias(n) for n, c in cells.items()], *[trunk[n].alias(n) for n in TRUNK])
    pairs = {f"{m}_{b}": c for m in FRAME_METRICS for b, c in g.bilateral(F.col(f"left_{m}"), F.col(f"right_{m}")).items()}
    return out.select(*[c for c in out.columns if c not in TRUNK], *[c.alias(n) for n, c in pairs.items()], *TRUNK)


def with_rate(df: DataFrame) -> DataFrame:
    """df with ``fs`` of its recording and person: 1 over the median size of the time steps, NULL below four rows."""
    step = F.col("timestamp_sec") - F.lag("timestamp_sec").over(ordered.series(GROUP, ["frame_idx"]))
    whole = Window.partitionBy(*GROUP)
    df = df.withColumn("__step", F.abs(step))
    df = df.withColumns({"__m": F.median("__step").over(whole), "__n": F.count("*").over(whole)})
    return df.withColumn("fs", F.when((F.col("__n") >= 4) & (F.col("__m") > 0), 1 / F.when(F.col("__m") > 0, F.col("__m")))).drop("__step", "__m", "__n")


def windowed(df: DataFrame, length: float = 1.0) -> DataFrame:
    """Rows of windows with four rows or more, on their slots, with the window's fault and what it lacks at either end."""
    rows = grid.sliding_windows(with_rate(df).where("fs is not null"), GROUP, length, time="timestamp_sec")
    rows = rows.withColumn("__rows", F.count("*").over(Window.partitionBy(*WINDOW))).where("__rows >= 4").drop("__rows")
    rows = grid.on_grid(rows, WINDOW, ["frame_idx"], time="timestamp_sec")
    lead, trail = grid.padding(rows, WINDOW, time="timestamp_sec")
    return rows.withColumns({"lead": lead, "trail": trail})


def _sources(rows: DataFrame, mode: str) -> DataFrame:
    """(window, side, source, slot, x, y, z, ...) of wrists and fingertips in windows with a sound time base."""
    cells = []
    for side in ("left", "right"):
        p = _points(rows, mode, side)
        cells += [F.struct(F.lit(side).alias("side"), F.lit(s).alias("source"), *[c.alias(n) for n, c in zip("xyz", p[k], strict=True)]) for s, k in (("wrist", "wrist"), ("fingertip", "index"))]
    return rows.where("fault is null").select(*WINDOW, "fs", "slot", "lead", "trail", F.inline(F.array(*cells)))


@F.pandas_udf(DoubleType())
def _sal(steps: pd.Series, n_steps: pd.Series, fs: pd.Series) -> pd.Series:
    """Spectral arc length of the speeds on a grid whose first and last step are known; inner gaps on a line."""
    out = []
    for s, n, rate in zip(steps, n_steps, fs, strict=True):
        at = np.array([x["slot"] for x in s], dtype=float)
        if len(at) < 4 or at.min() != 1 or at.max() != n:
            out.append(None)
            continue
        v = np.interp(np.arange(1, n + 1), at, [x["speed"] for x in s])
        if np.abs(v).max() < 1e-10:
            out.append(0.0)
            continue
        a = np.abs(np.fft.rfft(v / np.abs(v).max()))
        a, f, cut = a / a.max(), np.linspace(0, rate / 2, len(a)), min(10.0, rate / 2)
        keep = f <= cut
        out.append(float(-np.sqrt((np.diff(f[keep]) / cut) ** 2 + np.diff(a[keep]) ** 2).sum()) if keep.sum() >= 2 else None)
    return pd.Series(out, dtype=float)


def _arc_lengths(points: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("slot")
    known = points.withColumn("__grid", F.max("slot").over(Window.partitionBy(*keys))).where("x is not null and y is not null and z is not null")
    step = F.when(F.lag("slot").over(w) == F.col("slot") - 1, F.sqrt(sum(F.pow(F.col(c) - F.lag(c).over(w), 2) for c in "xyz")) * F.col("fs"))
    known = known.withColumn("speed", step)
    held = known.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("speed").isNotNull(), F.struct("slot", "speed")))).alias("steps"), F.first("__grid").alias("n"), F.first("fs").alias("fs"))
    return held.select(*keys, _sal("steps", "n", "fs").alias("sal"))


def window_features(df: DataFrame, mode: str, world: bool = False, length: float = 1.0) -> DataFrame:
    """46 columns a window: keys, six trajectory measures a side, twelve of the body, three comparisons of each measure."""
    rows = windowed(df, length)
    points = _sources(rows, mode)
    keys = [*WINDOW, "side", "source"]
    measured = grid.trajectory(points, keys).join(_arc_lengths(points, keys), keys, "left")
    names = {"sal": "sal", "v_mean": "velocity_mean", "v_peak": "velocity_peak", "normalized_jerk": "normalized_jerk", "efficiency": "movement_efficiency"}
    pick = lambda side, source, c: F.max(F.when((F.col("side") == side) & (F.col("source") == source), F.col(c)))
    sides = [pick(s, "wrist", c).alias(f"{s}_wrist_{n}") for s in ("left", "right") for c, n in names.items()] + [pick(s, "fingertip", "normalized_jerk").alias(f"{s}_fingertip_normalized_jerk") for s in ("left", "right")]
    all_windows = rows.select(*WINDOW).distinct()
    found = all_windows.join(measured.groupBy(*WINDOW).agg(*sides), WINDOW, "left")
    if mode == "body":
        features = frame_features(df, mode, world)
        own = rows.select(*WINDOW, "frame_idx").join(features, [*GROUP, "frame_idx"])
        found = found.join(grid.trunk_summaries(own, WINDOW), WINDOW, "left")
    else:
        found = found.withColumns({c: F.lit(None).cast("double") for c in BODY_WINDOW_METRICS})
    pairs = {f"{m}_{b}": c for m in SIDE_METRICS for b, c in g.bilateral(F.col(f"left_{m}"), F.col(f"right_{m}")).items()}
    keep = [f"{s}_{m}" for s in ("left", "right") for m in SIDE_METRICS]
    bounds = [F.round(f"window_{e}", 4).alias(f"window_{e}_sec") for e in ("start", "end")]
    return found.select(*GROUP, *bounds, *keep, *BODY_WINDOW_METRICS, *[pairs[f"{m}_{b}"].alias(f"{m}_{b}") for m in SIDE_METRICS for b in BILATERAL])


def window_quality(df: DataFrame, mode: str, windows: DataFrame, length: float = 1.0) -> DataFrame:
    """22 columns a window and metric: the evidence of its source and why the metric is not usable, if it is not."""
    rows = windowed(df, length)
    points = _sources(rows, mode)
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    seen = grid.evidence(points, [*WINDOW, "side", "source"], ok, lead=F.col("lead"), trail=F.col("trail")).drop("fs")
    body = "body" if mode == "body" else "arm"
    metrics = [(s, m, src, f"{body}_{s}_wrist" if src == "wrist" else f"{s}_hand_8", 6 * (s == "right") + i) for s in ("left", "right") for i, (m, src) in enumerate(SIDE_METRICS.items())]
    dim = F.broadcast(df.sparkSession.createDataFrame(metrics, "side string, metric string, source string, required_keypoints string, rank int"))
    sound = rows.groupBy(*WINDOW).agg(F.max("fault").isNull().alias("timebase_ok"))
    base = sound.join(dim, F.lit(True)).join(seen, [*WINDOW, "side", "source"], "left")
    base = base.withColumns({"metric_id": F.concat_ws("_", "side", "metric"), "window_start_sec": F.round("window_start", 4), "window_end_sec": F.round("window_end", 4)})
    ids = [f"{s}_{m}" for s in ("left", "right") for m in SIDE_METRICS]
    estimates = windows.select(*GROUP, "window_start_sec", *ids).unpivot([*GROUP, "window_start_sec"], ids, "metric_id", "estimate")
    j = base.join(estimates, [*GROUP, "window_start_sec", "metric_id"], "left")
    j = j.withColumn("frame_coverage", F.col("n_valid_frames") / F.col("n_expected_frames"))
    reason = grid.qc_reason(F.col("timebase_ok"), F.col("n_valid_frames"), F.col("n_valid_intervals"), F.col("longest_gap_sec"), F.col("frame_coverage"), F.col("estimate"))
    j = j.withColumn("qc_reason", reason)
    whole = lambda c: F.col(c).cast("int").alias(c)
    return j.orderBy(*GROUP, "window_start_sec", "rank").select(
        *GROUP, "window_start_sec", "window_end_sec", "metric_id", F.concat_ws("_", "side", "source").alias("source_group"), whole("n_expected_frames"), whole("n_valid_frames"), "frame_coverage",
        whole("n_expected_intervals"), whole("n_valid_intervals"), g.ratio(F.col("n_valid_intervals"), F.col("n_expected_intervals")).alias("interval_coverage"), "valid_duration_sec",
        whole("longest_gap_frames"), "longest_gap_sec", whole("n_gaps"), "required_keypoints", (F.col("n_valid_frames") > 0).cast("int").alias("n_required_keypoints_present"),
        F.lit(grid.MIN_COVERAGE).alias("min_coverage"), F.lit(grid.MAX_GAP_SEC).alias("max_gap_sec"), F.when(F.col("qc_reason") == "none", "pass").otherwise("fail").alias("qc_status"), "qc_reason",
    )


def movement_phases(df: DataFrame, mode: str, world: bool = False) -> DataFrame:
    """A row a phase of each side's movements, with its frames, duration, speeds, path and smoothness."""
    features = frame_features(df, mode, world)
    rows = with_rate(df).where("fs is not null").join(features.select(*GROUP, "frame_idx", "left_grasp_aperture_thumb_index", "right_grasp_aperture_thumb_index", "reach_raw_symmetry_ratio"), [*GROUP, "frame_idx"])
    cells = [F.struct(F.lit(s).alias("side"), *[c.alias(n) for n, c in zip("xyz", _points(rows, mode, s)["wrist"], strict=True)], F.col(f"{s}_grasp_aperture_thumb_index").alias("aperture")) for s in ("left", "right")]
    long = rows.select(*GROUP, "frame_idx", F.col("timestamp_sec").alias("t"), "fs", F.col("reach_raw_symmetry_ratio").alias("symmetry"), F.inline(F.array(*cells)))
    keys = [*GROUP, "side"]
    moving = phases.movements(phases.speeds(long, keys, ["frame_idx"]), keys)
    return phases.phase_table(phases.phases(moving, keys), keys, symmetry="symmetry")


def tables(df: DataFrame, sha256: str = "") -> dict[str, DataFrame]:
    """frames, windows, phases and, for a 3D table, quality; 3D outputs carry their identity tags last."""
    own, mode, world = gated(df)
    out = {"frames": frame_features(own, mode, world), "windows": window_features(own, mode, world), "phases": movement_phases(own, mode, world)}
    if not world:
        return out
    out["quality"] = window_quality(own, mode, out["windows"])
    kinds = {"frames": "frame-instantaneous", "windows": "gap-aware", "phases": "gap-unsafe", "quality": "gap-aware"}
    return {k: v.withColumns(artifact_tags(k, sha256, kinds[k])) for k, v in out.items()}
