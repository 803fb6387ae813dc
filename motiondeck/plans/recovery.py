"""Queries that recover a subject from lost or doubtful detections: whole-body tracks, the fallback ladder, hands on wrists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from motiondeck.catalog import register
from motiondeck.operators import fallback, fusion, grading, matching, report, schemes, tables
from motiondeck.plans.proxies import KPT, SIG, kpt, rounded, sig, table
from motiondeck.streaming import wholebody


def body_frames(spark, sf_dir):
    """Frames of two people: a recording a label, a person a vector, 133 points out of its components, scores out of their size."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda k: F.get("embedding", F.lit(k % 64)).cast("double")
    points = F.array(*[F.struct((at(i) * 100 + (F.col("vec_id") % 2) * 400).alias("x"), (at(3 * i + 1) * 100).alias("y")) for i in range(133)])
    scores = F.array(*[F.least(F.lit(1.0), F.abs(at(5 * i + 2)) * 5) for i in range(133)])
    rows = e.select(F.concat(F.lit("v"), "label").alias("video"), F.floor(F.col("vec_id") / 2).alias("frame"), (F.floor(F.col("vec_id") / 2) / 30).alias("t"), (F.col("vec_id") % 2).alias("person_idx"), points.alias("points"), scores.alias("scores"))
    return wholebody.frames_of(rows, ["video"])


@register("whole_body")
def whole_body(spark, sf_dir):
    """People of the frames tracked, smoothed region by region, carried: a digest of every track's row. A test holds it against brute force."""
    found = wholebody.smooth_frames(body_frames(spark, sf_dir), ["video"])
    total = lambda of: F.aggregate(F.transform("points", of), F.lit(0.0), lambda a, b: a + b)
    return rounded(found.select("video", "frame", "track_id", "person", "age", "misses", total(lambda q: q["x"]).alias("sum_x"), total(lambda q: q["y"]).alias("sum_y"), F.aggregate("scores", F.lit(0.0), lambda a, b: a + b).alias("sum_score")), 4)


_LADDER = f"""WITH {SIG}, e AS (SELECT user_id, event_id // 500 AS frame, event_id, value, k FROM sig),
p AS (SELECT user_id, frame, value AS body FROM e WHERE k >= 40 QUALIFY row_number() OVER (PARTITION BY user_id, frame ORDER BY value DESC, event_id) = 1),
h AS (SELECT user_id, frame, count(*) AS hands FROM e WHERE k % 3 = 0 GROUP BY 1, 2), f AS (SELECT user_id, frame, body, coalesce(hands, 0) AS hands FROM p FULL JOIN h USING (user_id, frame)),
w AS (SELECT *, last_value(CASE WHEN body IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS seen, last_value(body IGNORE NULLS) OVER a AS last, lead(frame) OVER (PARTITION BY user_id ORDER BY frame) AS nxt
FROM f WINDOW a AS (PARTITION BY user_id ORDER BY frame ROWS UNBOUNDED PRECEDING)),
r AS (SELECT user_id, frame, CASE WHEN body IS NOT NULL THEN 'primary' WHEN frame - seen <= 4 THEN 'carried' WHEN hands > 0 THEN 'hands' ELSE 'none' END AS rung, seen, last, false AS made FROM w
UNION ALL SELECT user_id, unnest(range(frame + 1, least(coalesce(nxt - 1, seen + 4), seen + 4) + 1)), 'carried', seen, last, true FROM w WHERE seen IS NOT NULL)
SELECT user_id, frame, rung, CASE WHEN rung IN ('primary', 'carried') THEN round(last, 6) + 0.0 END AS body, rung = 'primary' AS observed, CASE WHEN rung IN ('primary', 'carried') THEN frame - seen END AS age, made FROM r"""


def subject_frames(spark, sf_dir):
    """Frames of 500 events: a user's events with k of 40 and more are bodies, those with k divisible by 3 hands."""
    e = sig(spark, sf_dir).withColumn("frame", F.floor(F.col("event_id") / 500))
    people = e.where("k >= 40").select("user_id", "frame", F.col("event_id").alias("person_idx"), "value")
    return fallback.single_subject(people, e.where("k % 3 = 0"), ["user_id"], "frame", F.col("value"), ["value"])


@register("fallback_ladder", _LADDER)
def fallback_ladder(spark, sf_dir):
    """What stands for each user in every frame: the largest body, one carried for up to four frames, hands, or nothing."""
    found = fallback.ladder(subject_frames(spark, sf_dir), ["user_id"], "frame", 4)
    return rounded(found.withColumn("body", F.col("body.value")))


#: With two wrists and two hands a matching is one pair, or one of two pairs of pairs.
_HANDS = f"""WITH {KPT}, w AS (SELECT vec_id, unnest([0, 1]) AS wrist_id, unnest([p0_x, p1_x]) AS wx, unnest([p0_y, p1_y]) AS wy, (p4_x + p5_x) / 2 AS mx, (p4_y + p5_y) / 2 AS my FROM kpt),
h AS (SELECT vec_id, unnest([0, 1]) AS hand_id, unnest([p2_x, p3_x]) AS hx, unnest([p2_y, p3_y]) AS hy FROM kpt),
c AS (SELECT * FROM (SELECT vec_id, wrist_id, hand_id, sqrt(pow(wx - hx, 2) + pow(wy - hy, 2)) AS cost, sqrt(pow(mx - hx, 2) + pow(my - hy, 2)) AS middle FROM w JOIN h USING (vec_id)) WHERE cost < 0.3 AND cost < middle),
m AS (SELECT vec_id, [hand_id] AS hands, [wrist_id] AS wrists, [cost] AS costs FROM c
UNION ALL SELECT a.vec_id, [a.hand_id, b.hand_id], [a.wrist_id, b.wrist_id], [a.cost, b.cost] FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.wrist_id < b.wrist_id AND a.hand_id <> b.hand_id),
best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY len(costs) DESC, list_sum(costs), wrists, hands) = 1)
SELECT vec_id, wrist_id, hand_id, round(cost, 6) + 0.0 AS cost FROM (SELECT vec_id, unnest(wrists) AS wrist_id, unnest(hands) AS hand_id, unnest(costs) AS cost FROM best)"""


@register("wrist_hand_match", _HANDS)
def wrist_hand_match(spark, sf_dir):
    """Each vector's hands given to its wrists: as many as reach, then as near as possible, one hand a wrist."""
    k = kpt(spark, sf_dir)
    at = lambda key, a, b, i: F.struct(F.lit(i).alias(key), F.col(f"p{a}_x").alias(f"{b}x"), F.col(f"p{a}_y").alias(f"{b}y"))
    mid = [((F.col(f"p4_{c}") + F.col(f"p5_{c}")) / 2).alias(f"mid_{c}") for c in "xy"]
    wrists = k.select("vec_id", *mid, F.inline(F.array(at("wrist_id", 0, "w", 0), at("wrist_id", 1, "w", 1))))
    hands = k.select("vec_id", F.inline(F.array(at("hand_id", 2, "h", 0), at("hand_id", 3, "h", 1))))
    return rounded(matching.match_hands(wrists, hands, ["vec_id"], reach=0.3))


#: Four cameras with bent lenses that look along z.
BENT = {
    "a": {"K": [[900, 0, 640], [0, 900, 360], [0, 0, 1]], "rvec": [0, 0, 0], "tvec": [0, 0, 6], "distortion": [-0.2, 0.05, 0.001, -0.001, 0.0]},
    "b": {"K": [[880, 0, 640], [0, 880, 360], [0, 0, 1]], "rvec": [0, 0.436, 0], "tvec": [-0.8, 0, 6.25], "distortion": [-0.15, 0.02, 0.0, 0.001, 0.0]},
    "c": {"K": [[700, 0, 480], [0, 700, 270], [0, 0, 1]], "rvec": [0, -0.349, 0], "tvec": [0.7, 0, 6.2], "distortion": [0.1, -0.02, 0.0, 0.0, 0.0]},
    "d": {"K": [[820, 0, 600], [0, 820, 340], [0, 0, 1]], "rvec": [0.3, 0.1, 0], "tvec": [0, 0.5, 6.1], "distortion": [0.0]},
}
NOISE_PX = 1.5


def balanced_noise(rig: fusion.Rig, x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Noise (n, views, 2) of one size in every view whose pulls on the point cancel out, so that the point is still the best fit: by
    turns the pull is taken out and the size restored. Where that does not settle there is none."""
    axes = np.eye(3) * 1e-5
    j = np.stack([(rig.pixels(x + a)[0] - rig.pixels(x - a)[0]) / 2e-5 for a in axes], axis=-1)
    inverse = np.linalg.inv(np.einsum("nvki,nvkj->nij", j, j))
    r = start
    for _ in range(200):
        r = r - np.einsum("nvki,nij,njq->nvkq", j, inverse, np.einsum("nvki,nvk->ni", j, r)[..., None])[..., 0]
        r = NOISE_PX * r / np.linalg.norm(r, axis=2, keepdims=True)
    pull = np.abs(np.einsum("nvki,nvk->ni", j, r)).max(axis=1)
    return np.where((pull < 1e-6)[:, None, None], r, 0.0)


def disturbed_views(spark, sf_dir):
    """Five points a vector as four bent cameras see them: of every third point one camera, by hash, sees it somewhere else, and of the
    others every second has noise in all views that leaves it the best fit (``noisy``)."""
    points = kpt(spark, sf_dir).select(F.lit("s").alias("session"), F.col("vec_id").alias("frame"), F.inline(F.array(*[F.struct(F.lit(i).alias("keypoint"), *[F.col(f"p{i}_{c}").alias(c) for c in "xyz"]) for i in range(5)])))
    wrong = (F.col("frame") + F.col("keypoint")) % 3 == 0
    points = points.select("*", F.when(wrong, (F.col("frame") * 7 + F.col("keypoint")) % 4).alias("wrong"), (~wrong & (F.col("frame") % 2 == 0)).alias("noise"), F.xxhash64("frame", "keypoint").alias("seed"))

    @F.pandas_udf("noisy boolean, views array<struct<camera: string, px: double, py: double>>")
    def seen(x: pd.Series, y: pd.Series, z: pd.Series, wrong: pd.Series, noise: pd.Series, seed: pd.Series) -> pd.DataFrame:
        rig, at = fusion.Rig.of(list(BENT.values())), np.column_stack([x, y, z]).astype(float)
        angle = (seed.to_numpy(np.int64).view(np.uint64)[:, None] >> (np.arange(4, dtype=np.uint64) * np.uint64(16))) % np.uint64(65536) / 65536 * 2 * np.pi
        off = balanced_noise(rig, at, np.stack([np.cos(angle), np.sin(angle)], axis=2)) * noise.to_numpy(bool)[:, None, None]
        pixels = rig.pixels(at)[0] + off
        lost = wrong.to_numpy(float, na_value=np.nan)
        for v in range(4):
            pixels[lost == v, v] += (150.0, -90.0)
        return pd.DataFrame({"noisy": np.abs(off).max(axis=(1, 2)) > 0, "views": [[{"camera": c, "px": p, "py": q} for c, (p, q) in zip(BENT, row, strict=True)] for row in pixels.tolist()]})

    found = points.withColumn("s", seen("x", "y", "z", "wrong", "noise", "seed"))
    return found.select("session", "frame", "keypoint", "s.noisy", F.inline("s.views")).withColumn("confidence", F.lit(0.9))


_DISTURBED = f"""WITH {KPT}, p AS (SELECT vec_id AS frame, unnest([0, 1, 2, 3, 4]) AS keypoint, {", ".join(f"unnest([{', '.join(f'p{i}_{c}' for i in range(5))}]) AS {c}" for c in "xyz")} FROM kpt)
SELECT frame, keypoint, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(z, 3) + 0.0 AS z, 4 AS candidate_n_views, CASE WHEN (frame + keypoint) % 3 = 0 THEN 3 ELSE 4 END AS n_views, 1 AS cheirality_ok FROM p"""


@register("fused_disturbed", _DISTURBED)
def fused_disturbed(spark, sf_dir):
    """Views of bent lenses with wrong cameras and noise fused again: the wrong view is out and the points are back."""
    found = fusion.fuse(disturbed_views(spark, sf_dir), BENT)
    return rounded(found.select("frame", "keypoint", "x", "y", "z", "candidate_n_views", "n_views", "cheirality_ok"), 3)


#: Sessions are labels, frames a label's vectors in order, keypoints their 21 points; figures follow from the coordinates.
_FZ = f"""{KPT}, fr AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, vec_id, embedding FROM embeddings JOIN kpt USING (vec_id, label)),
pt AS (SELECT label, frame, vec_id, unnest(range(21)) AS keypoint, unnest([embedding[3 * i + 1] for i in range(21)]) AS px, unnest([embedding[3 * i + 2] for i in range(21)]) AS py, unnest([embedding[3 * i + 3] for i in range(21)]) AS pz FROM fr),
pts AS (SELECT label, frame, keypoint, CAST(px AS DOUBLE) AS px, CAST(py AS DOUBLE) AS py, CAST(pz AS DOUBLE) AS pz, vec_id FROM pt),
ses AS (SELECT label, count(*) + 1 AS expected_frames FROM fr GROUP BY 1),
fz AS (SELECT label, frame, keypoint, abs(px) > 0.02 AS ok, CASE WHEN abs(px) > 0.02 THEN abs(py) * 60 END AS err, 1 + (frame + keypoint) % 3 + CASE WHEN abs(px) > 0.02 THEN 1 ELSE 0 END AS n_views, 2 + (frame + keypoint) % 3 + CASE WHEN keypoint % 5 = 0 THEN 1 ELSE 0 END AS cand,
pz > -0.3 AS front, CASE WHEN abs(px) > 0.02 THEN abs(pz) * 40 END AS angle, abs(px) > 0.02 AND abs(py) * 60 <= 20 AND pz > -0.3 AS trusted FROM pts)"""


def _points(spark, sf_dir):
    """label, frame, keypoint, px, py, pz: the points of a label's vectors, its frames numbered from 0."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("frame"))
    at = lambda i, j: F.get("embedding", F.lit(3 * i + j)).cast("double")
    return e.select("label", "frame", F.inline(F.array(*[F.struct(F.lit(i).alias("keypoint"), *[at(i, j).alias(f"p{c}") for j, c in enumerate("xyz")]) for i in range(21)])))


def fused_points(spark, sf_dir):
    p, ok = _points(spark, sf_dir), F.abs("px") > 0.02
    some = F.col("frame") + F.col("keypoint")
    found = p.select("label", "frame", "keypoint", *[F.when(ok, F.col(f"p{c}")).alias(c) for c in "xyz"], F.when(ok, F.abs("py") * 60).alias("reproj_err_px"), (1 + some % 3 + ok.cast("int")).alias("n_views"), (2 + some % 3 + (F.col("keypoint") % 5 == 0).cast("int")).alias("candidate_n_views"), (F.col("pz") > -0.3).alias("cheirality_ok"), F.when(ok, F.abs("pz") * 40).alias("triangulation_angle_deg"))
    return found.withColumn("trusted", F.col("x").isNotNull() & (F.col("reproj_err_px") <= 20) & F.col("cheirality_ok"))


def rig_cameras(spark, sf_dir):
    """Three cameras a label; the second starts two frames late, the third lasts twelve frames longer."""
    n = table(spark, sf_dir, "embeddings").groupBy("label").agg((F.count("*") + 1).alias("n"))
    return n.select("label", F.inline(F.array(*[F.struct(F.lit(c).alias("camera"), (F.col("n") + 12 * (c == 2) - 2 * (c == 1)).alias("expected_frames"), F.lit(2 * (c == 1)).alias("sync_offset"), F.lit(None if c else 21).cast("bigint").alias("keypoints")) for c in range(3)])))


def camera_points(spark, sf_dir):
    p = _points(spark, sf_dir)
    rows = [F.struct(F.lit(c).alias("camera"), F.when(F.col("px") > -0.25 + 0.05 * c, F.col("px")).alias("x"), F.col("py").alias("y"), F.least(F.lit(1.0), F.abs("pz") * (9 - c)).alias("confidence")) for c in range(3)]
    return p.select("label", "frame", "keypoint", F.inline(F.array(*rows)))


_TRACKING = """cam AS (SELECT label, unnest([0, 1, 2]) AS camera, unnest([expected_frames, expected_frames - 2, expected_frames + 12]) AS expected_frames, unnest([0, 2, 0]) AS sync_offset FROM ses),
seen AS (SELECT label, camera, frame, keypoint, px > -0.25 + 0.05 * camera AND least(1.0, abs(pz) * (9 - camera)) > 0 AS hit, least(1.0, abs(pz) * (9 - camera)) < 0.3 AS low FROM pts, (SELECT unnest([0, 1, 2]) AS camera)),
trk AS (SELECT c.label, c.camera, count(DISTINCT frame) AS observed_frames, any_value(expected_frames) AS expected_frames, greatest(0, any_value(expected_frames) - count(DISTINCT CASE WHEN hit THEN frame END)) AS dropped_frames,
count(*) FILTER (hit) / (any_value(expected_frames) * 21.0) AS detection_rate, count(*) FILTER (hit AND low) / CAST(count(*) FILTER (hit) AS DOUBLE) AS low_confidence_fraction
FROM cam c JOIN seen s ON s.label = c.label AND s.camera = c.camera AND frame >= sync_offset AND frame < sync_offset + expected_frames GROUP BY 1, 2)"""


@register("tracking_section", f"WITH {_FZ}, {_TRACKING} SELECT label, camera, observed_frames, expected_frames, dropped_frames, round(detection_rate, 6) + 0.0 AS detection_rate, round(low_confidence_fraction, 6) + 0.0 AS low_confidence_fraction FROM trk")
def tracking_section(spark, sf_dir):
    """What three cameras a session saw of its points, against the frames that they should have."""
    return rounded(report.tracking(camera_points(spark, sf_dir), rig_cameras(spark, sf_dir), ["label"]))


#: The second largest of the cameras' expected frames.
_FUSION = """fus AS (SELECT f.label, count(DISTINCT frame) AS n_frames_fused, any_value(expected_frames) AS expected_frames, count(DISTINCT CASE WHEN ok OR cand >= 2 THEN keypoint END) AS n_active_keypoints, count(*) FILTER (ok) AS fused, count(*) FILTER (trusted) AS trusted,
count(*) FILTER (ok AND NOT front) AS behind, median(err) AS m, quantile_cont(err, 0.95) AS p95, max(err) AS most, median(CASE WHEN ok THEN n_views END) AS vm, min(CASE WHEN ok THEN n_views END) AS vmin, quantile_cont(angle, 0.05) AS a5, median(angle) AS am,
median(CASE WHEN cand >= 2 THEN cand END) AS cm, sum(CASE WHEN cand >= 2 THEN greatest(cand - n_views, 0) END) / CAST(sum(CASE WHEN cand >= 2 THEN cand END) AS DOUBLE) AS vr FROM fz f JOIN ses USING (label) GROUP BY 1),
fusion AS (SELECT label, n_frames_fused, expected_frames, n_frames_fused / CAST(expected_frames AS DOUBLE) AS fused_frame_fraction, n_active_keypoints, trusted / CAST(n_active_keypoints * expected_frames AS DOUBLE) AS trusted_keypoint_fraction, m AS reproj_err_px_median, p95 AS reproj_err_px_p95, most AS reproj_err_px_max, vm AS n_views_median, vmin AS n_views_min,
behind / CAST(fused AS DOUBLE) AS cheirality_violation_rate, a5 AS triangulation_angle_deg_p05, am AS triangulation_angle_deg_median, cm AS candidate_n_views_median, vr AS view_rejection_fraction, 1 - fused / CAST(n_active_keypoints * n_frames_fused AS DOUBLE) AS unfused_keypoint_fraction FROM fus)"""
_FUSION_FIGURES = ["fused_frame_fraction", "trusted_keypoint_fraction", "reproj_err_px_median", "reproj_err_px_p95", "reproj_err_px_max", "n_views_median", "cheirality_violation_rate", "triangulation_angle_deg_p05", "triangulation_angle_deg_median", "candidate_n_views_median", "view_rejection_fraction", "unfused_keypoint_fraction"]


@register("fusion_section", f"WITH {_FZ}, {_FUSION} SELECT label, n_frames_fused, expected_frames, n_active_keypoints, n_views_min, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _FUSION_FIGURES)} FROM fusion")
def fusion_section(spark, sf_dir):
    """Errors, views, angles, rejections and the fused, trusted and unfused shares of each session's fused points."""
    found = report.fusion(fused_points(spark, sf_dir), report.expected_fused(rig_cameras(spark, sf_dir), ["label"]), ["label"])
    return rounded(found.select("label", "n_frames_fused", "expected_frames", F.col("n_active_keypoints").cast("bigint").alias("n_active_keypoints"), F.col("n_views_min").cast("bigint").alias("n_views_min"), *_FUSION_FIGURES))


def session_figures(spark, sf_dir):
    """Figures that other stages measure, one row a label, out of its first point and number."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda k: F.avg(F.abs(F.get("embedding", F.lit(k)).cast("double")))
    return e.groupBy("label").agg((at(0) * 10).alias("reprojection_error_px"), (at(1) * 0.6).alias("mean_bone_length_cv"), (at(2) * 80).alias("temporal_jitter_mm"), (at(3) * 90).alias("throughput_fps"), (at(4) * 0.7).alias("mean_symmetry_rel_diff"), (at(5) * 60).alias("elbow_angle_deg"), at(6).alias("reach_mm"))


_CHECKS = [
    ("calibration.reprojection_error_px", "figs", "reprojection_error_px", "calib_reproj_rms_px"), ("agreement.mean_bone_length_cv", "figs", "mean_bone_length_cv", "max_bone_length_cv"), ("agreement.temporal_jitter_mm", "figs", "temporal_jitter_mm", "max_temporal_jitter_mm"),
    ("timing.throughput_fps", "figs", "throughput_fps", "min_throughput_fps"), ("agreement.mean_symmetry_rel_diff", "figs", "mean_symmetry_rel_diff", "max_symmetry_rel_diff"), ("agreement.elbow_angle_deg", "figs", "elbow_angle_deg", "agreement_tolerance_deg"),
    ("fusion.reproj_err_px_median", "fusion", "reproj_err_px_median", "fusion_reproj_median_px"), ("fusion.reproj_err_px_p95", "fusion", "reproj_err_px_p95", "fusion_reproj_p95_px"), ("fusion.n_views_median", "fusion", "n_views_median", "n_views_median"),
    ("fusion.fused_frame_fraction", "fusion", "fused_frame_fraction", "min_fused_frame_fraction"), ("fusion.trusted_keypoint_fraction", "fusion", "trusted_keypoint_fraction", "min_trusted_keypoint_fraction"), ("fusion.triangulation_angle_deg_p05", "fusion", "triangulation_angle_deg_p05", "min_triangulation_angle_p05_deg"),
    ("fusion.view_rejection_fraction", "fusion", "view_rejection_fraction", "max_view_rejection_fraction"), ("fusion.n_views_min", "fusion", "n_views_min", "n_views_floor"), ("fusion.unfused_keypoint_fraction", "fusion", "unfused_keypoint_fraction", "max_unfused_fraction"),
    ("fusion.cheirality_violation_rate", "fusion", "cheirality_violation_rate", "max_cheirality_rate"), ("tracking.worst_low_confidence_fraction", "worst", "low", "max_low_confidence_fraction"), ("tracking.worst_detection_rate", "worst", "rate", "min_tracking_detection_rate"),
]
_BANDS = "lim AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {w}, {f}, '{d}')" for m, w, f, d in [*grading.THRESHOLDS, *grading.CAPTURE_THRESHOLDS, *grading.FLOORS]) + ") AS t(metric, warn, fail, direction))"
_FIGS = "figs AS (SELECT label, " + ", ".join(f"avg(abs(CAST(embedding[{i + 1}] AS DOUBLE))) * {k} AS {c}" for i, (c, k) in enumerate([("reprojection_error_px", 10), ("mean_bone_length_cv", 0.6), ("temporal_jitter_mm", 80), ("throughput_fps", 90), ("mean_symmetry_rel_diff", 0.7), ("elbow_angle_deg", 60)])) + " FROM embeddings GROUP BY 1)"


def _graded_sql(checks, info) -> str:
    rows = " UNION ALL ".join(f"SELECT label, '{name}' AS \"check\", '{band}' AS metric, CAST({column} AS DOUBLE) AS value FROM {source}" for name, source, column, band in checks)
    return f"""chk AS ({rows}) SELECT label, "check", round(value, 6) + 0.0 AS value, CASE WHEN value IS NULL THEN 'WARN' WHEN direction = 'max' THEN CASE WHEN value <= warn THEN 'PASS' WHEN value <= fail THEN 'WARN' ELSE 'FAIL' END ELSE CASE WHEN value >= warn THEN 'PASS' WHEN value >= fail THEN 'WARN' ELSE 'FAIL' END END AS grade,
metric IN ({", ".join(f"'{m}'" for m in info)}) AS informational FROM chk JOIN lim USING (metric)"""


_WORST = "worst AS (SELECT label, min(detection_rate) AS rate, max(low_confidence_fraction) AS low FROM trk GROUP BY 1)"


def session_report(spark, sf_dir):
    """All sections of every session's validation report as one table of measures."""
    keys, figures = ["label"], session_figures(spark, sf_dir)
    fused = report.fusion(fused_points(spark, sf_dir), report.expected_fused(rig_cameras(spark, sf_dir), keys), keys)
    errors = figures.select("label", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("error")) for m in ("elbow_angle_deg", "reach_mm")])))
    tracked = report.tracking(camera_points(spark, sf_dir), rig_cameras(spark, sf_dir), keys)
    return report.stacked([report.session_checks(figures, keys), report.fusion_checks(fused, keys), report.tracking_checks(tracked, keys), report.baseline_checks(errors, keys)])


@register("report_grades", f"WITH {_FZ}, {_TRACKING}, {_FUSION}, {_WORST}, {_FIGS}, {_BANDS}, {_graded_sql(_CHECKS, grading.INFORMATIONAL)}")
def report_grades(spark, sf_dir):
    """All checks of every session's report against their bands: 17 bands and the floor of views."""
    return rounded(report.graded(session_report(spark, sf_dir), ["label"]).drop("severity"))


_BOARD = """brd AS (SELECT label, vec_id % 2 AS camera, count(*) AS n, count(*) FILTER (embedding[1] > 0) AS n_detected, count(DISTINCT CASE WHEN embedding[1] > 0 THEN CAST(greatest(0, least(5, floor(abs(CAST(embedding[3] AS DOUBLE)) / 0.5 * 6))) AS INT) * 8 + CAST(greatest(0, least(7, floor(abs(CAST(embedding[2] AS DOUBLE)) / 0.5 * 8))) AS INT) END) / 48.0 AS coverage FROM embeddings GROUP BY 1, 2),
board AS (SELECT label, min(coverage) AS coverage, min(n_detected / CAST(n AS DOUBLE)) AS rate, min(n_detected) AS least FROM brd GROUP BY 1), parity AS (SELECT label, (max(n) - min(n)) / CAST(max(n) AS DOUBLE) AS disparity FROM brd GROUP BY 1 HAVING count(*) > 1)"""
_CAPTURE = [
    ("calibration.reprojection_error_px", "figs", "reprojection_error_px", "calib_reproj_rms_px"), ("calibration.worst_board_coverage", "board", "coverage", "min_board_coverage"), ("calibration.worst_charuco_detection_rate", "board", "rate", "min_charuco_detection_rate"),
    ("calibration.min_charuco_frames", "board", "least", "charuco_frames_floor"), ("parity.frame_count_disparity", "parity", "disparity", "max_frame_count_disparity"), ("subject.worst_detection_rate", "worst", "rate", "min_subject_detection_rate"), ("subject.worst_low_confidence_fraction", "worst", "low", "max_low_confidence_fraction"),
]


@register("capture_grades", f"WITH {_FZ}, {_TRACKING}, {_WORST}, {_FIGS}, {_BANDS}, {_BOARD}, {_graded_sql(_CAPTURE, ['none'])}")
def capture_grades(spark, sf_dir):
    """The capture gate of every session: board coverage and detections of two cameras, parity of frames, the subject's detections."""
    from motiondeck.operators.aggregate import grid_coverage

    e = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 2).alias("camera"), *[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate("abc")])
    hit = F.col("a") > 0
    coverage = grid_coverage(F.when(hit, F.abs("b")), F.when(hit, F.abs("c")), F.lit(0.5), F.lit(0.5))
    boards = e.groupBy("label", "camera").agg(F.count("*").alias("frames"), F.count_if(hit).alias("n_detected"), coverage.alias("coverage")).withColumn("detection_rate", F.col("n_detected") / F.col("frames"))
    subjects = report.tracking(camera_points(spark, sf_dir), rig_cameras(spark, sf_dir), ["label"])
    checks = report.capture_checks(boards, boards.select("label", "camera", "frames"), subjects, session_figures(spark, sf_dir), ["label"])
    return rounded(report.graded(checks, ["label"], capture=True).drop("severity"))


_SCHEMES = {"arms": schemes.ARM, "body": schemes.BODY}
_MAPPED = "SELECT vec_id, " + ", ".join(
    f"round(list_sum(list_transform([{', '.join(map(str, which))}], lambda k, i: i * CAST(embedding[k % 64 + 1] AS DOUBLE) * 100)), 4) + 0.0 AS {name}_x, "
    f"round(list_sum(list_transform([{', '.join(map(str, which))}], lambda k, i: i * least(1.0, abs(CAST(embedding[(5 * k + 2) % 64 + 1] AS DOUBLE)) * 5))), 4) + 0.0 AS {name}_vis"
    for name, which in _SCHEMES.items()
) + ", " + ", ".join(f"list_sum(list_transform(range({start}, {start + 21}), lambda k: least(1.0, abs(CAST(embedding[(5 * k + 2) % 64 + 1] AS DOUBLE)) * 5))) / 21 > 0.5 AS {side}" for side, (start, _) in schemes.HANDS.items()) + " FROM embeddings"


@register("mapped_people", _MAPPED)
def mapped_people(spark, sf_dir):
    """People of 133 points in the arm and the body scheme: sums of places and visibilities weighted by position, and which hands score above a half."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda k: F.get("embedding", F.lit(k % 64)).cast("double")
    people = e.select("vec_id", F.lit(0).alias("person_idx"), F.array(*[F.struct((at(i) * 100).alias("x"), at(3 * i + 1).alias("y")) for i in range(133)]).alias("points"), F.array(*[F.least(F.lit(1.0), F.abs(at(5 * i + 2)) * 5) for i in range(133)]).alias("scores"))
    weigh = lambda c, of: F.aggregate(F.transform(c, lambda p, i: of(p) * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    found = people.select("vec_id", *[tables.hand_present(F.col("scores"), start, least=0.5).alias(side) for side, (start, _) in schemes.HANDS.items()])
    for name in _SCHEMES:
        own = schemes.bodies(people, ["vec_id"], name).select("vec_id", weigh("points", lambda p: p["x"]).alias(f"{name}_x"), weigh("vis", lambda v: v).alias(f"{name}_vis"))
        found = found.join(own, "vec_id")
    return rounded(found, 4)
