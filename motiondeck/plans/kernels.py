"""Queries of numeric kernels and recursive filters over the given tables. Most have no form in SQL; tests hold those against brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from motiondeck.catalog import register
from motiondeck.operators import features, fusion, grid, matching, near
from motiondeck.plans.proxies import KPT, SIG, kpt, rounded, sig, table
from motiondeck.sources.schema import BILATERAL, BODY_WINDOW_METRICS
from motiondeck.streaming import filters, lockstep

#: A rig of three cameras that looks along z.
RIG = {
    "a": {"K": [[900, 0, 640], [0, 900, 360], [0, 0, 1]], "rvec": [0, 0, 0], "tvec": [0, 0, 6], "distortion": [0.0]},
    "b": {"K": [[880, 0, 640], [0, 880, 360], [0, 0, 1]], "rvec": [0, 0.436, 0], "tvec": [-0.8, 0, 6.25], "distortion": [0.0]},
    "c": {"K": [[700, 0, 480], [0, 700, 270], [0, 0, 1]], "rvec": [0, -0.349, 0], "tvec": [0.7, 0, 6.2], "distortion": [0.0]},
}


@register("optimal_match")
def optimal_match(spark, sf_dir):
    """Within each label, which stands for a frame, pairs of an even and an odd vector whose first points are closer than a threshold,
    as many as possible and then as near as possible."""
    d = kpt(spark, sf_dir).select("label", "vec_id", "p0_x", "p0_y", "p0_z")
    a = d.where("vec_id % 2 = 0").select("label", F.col("vec_id").alias("left_id"), *[F.col(f"p0_{c}").alias(f"a{c}") for c in "xyz"])
    b = d.where("vec_id % 2 = 1").select("label", F.col("vec_id").alias("right_id"), *[F.col(f"p0_{c}").alias(c) for c in "xyz"])
    return rounded(near.match_near(a, b, ["label"], "left_id", "right_id", ["ax", "ay", "az"], ["x", "y", "z"], 0.06))


_BOXES = f"WITH RECURSIVE {SIG}, b AS (SELECT user_id, CAST(floor(t / 86400) AS BIGINT) AS day, event_id AS det_id, value % 10 AS x1, CAST(k % 10 AS DOUBLE) AS y1, 0.1 + k / 100 AS score FROM sig)"
#: Boxes have sides of 3, so two meet in (3 - dx)(3 - dy), if both are positive, of 18 less that.
_NMS = f"""{_BOXES}, g AS (SELECT user_id, day, list(struct_pack(s := -score, i := det_id, x := x1, y := y1) ORDER BY score DESC, det_id) AS l FROM b GROUP BY 1, 2),
met AS (SELECT user_id, day, list_filter(l, lambda q: q.i = l[1].i OR greatest(0, 3 - abs(q.x - l[1].x)) * greatest(0, 3 - abs(q.y - l[1].y)) > 0.3 * (18 - greatest(0, 3 - abs(q.x - l[1].x)) * greatest(0, 3 - abs(q.y - l[1].y)))) AS c, l FROM g
UNION ALL SELECT user_id, day, list_filter(r, lambda q: q.i = r[1].i OR greatest(0, 3 - abs(q.x - r[1].x)) * greatest(0, 3 - abs(q.y - r[1].y)) > 0.3 * (18 - greatest(0, 3 - abs(q.x - r[1].x)) * greatest(0, 3 - abs(q.y - r[1].y)))), r
FROM (SELECT user_id, day, list_filter(l, lambda q: NOT list_contains(list_transform(c, lambda z: z.i), q.i)) AS r FROM met) WHERE len(r) > 0),
w AS (SELECT user_id, day, -c[1].s AS score, len(c) AS members, list_sum(list_transform(c, lambda q: -q.s)) AS total, list_sum(list_transform(c, lambda q: -q.s * q.x)) AS sx, list_sum(list_transform(c, lambda q: -q.s * q.y)) AS sy, list_sum(list_transform(c, lambda q: -q.s * (q.x + 3))) AS tx, list_sum(list_transform(c, lambda q: -q.s * (q.y + 3))) AS ty FROM met)
SELECT user_id, day, round(sx / total, 6) + 0.0 AS x1, round(sy / total, 6) + 0.0 AS y1, round(tx / total, 6) + 0.0 AS x2, round(ty / total, 6) + 0.0 AS y2, round(score, 6) + 0.0 AS score, CAST(members AS INT) AS members FROM w"""


@register("weighted_nms", _NMS)
def weighted_nms(spark, sf_dir):
    """Boxes of the events of a user's day, which stands for a frame, merged where they overlap."""
    s = sig(spark, sf_dir)
    x, y = F.col("value") % 10, (F.col("k") % 10).cast("double")
    boxes = s.select("user_id", F.floor(F.col("t") / 86400).cast("bigint").alias("day"), F.col("event_id").alias("det_id"), x.alias("x1"), y.alias("y1"), (x + 3).alias("x2"), (y + 3).alias("y2"), (0.1 + F.col("k") / 100).alias("score"))
    return rounded(matching.non_maximum_suppression(boxes, ["user_id", "day"]))


def _cubic_weights() -> str:
    """SQL list: for each place of a window of 11, the weights that fit a cubic to the window and read it off there."""
    x = np.arange(-5, 6)
    fits = [np.polyfit(x, np.eye(11)[j], 3) for j in range(11)]
    return "[" + ", ".join("[" + ", ".join(repr(float(np.polyval(f, at))) for f in fits) + "]" for at in x) + "]"


@register("savgol", f"""WITH {SIG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i FROM sig), v AS (SELECT user_id, list(value ORDER BY i) AS v, count(*) AS n FROM r GROUP BY 1),
p AS (SELECT event_id, i, v, CAST(least(greatest(i - 5, 0), n - 11) AS BIGINT) AS s FROM r JOIN v USING (user_id)), w AS (SELECT {_cubic_weights()} AS w)
SELECT event_id, round(list_sum(list_transform(list_zip(w[i - s + 1], v[s + 1:s + 11]), lambda z: z[1] * z[2])), 6) + 0.0 AS smooth FROM p, w""")
def savgol(spark, sf_dir):
    """Each user's values in windows of 11 events; no user of the given tables has fewer, and none a missing value."""
    df = sig(spark, sf_dir).select("user_id", "event_id", "t", "value")
    return rounded(matching.savgol_series(df, ["user_id"], ["t", "event_id"], ["value"]).select("event_id", F.col("value").alias("smooth")))


#: One row of a user after the other: what was seen first, the capped step, the speed, the cut-off, the blend.
_EURO = f"""WITH RECURSIVE {SIG}, r AS (SELECT user_id, t / 3600 AS t, value AS x, k / 100 AS y, pow(k / 100, 2) AS w, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM sig),
c AS (SELECT user_id, n, t, x, y, CAST(0.0 AS DOUBLE) AS vx, CAST(0.0 AS DOUBLE) AS vy, w > 0 AS met, CAST(NULL AS DOUBLE) AS speed FROM r WHERE n = 1
UNION ALL SELECT user_id, n, t, px + rx / (rx + 1) * ex * w, py + ry / (ry + 1) * ey * w, ux, uy, met, s2 FROM (
SELECT *, (abs(ux) * 0.5 + cut) * 2 * pi() * dt AS rx, (abs(uy) * 0.5 + cut) * 2 * pi() * dt AS ry FROM (
SELECT *, 0.05 + greatest(0, least(1, (s2 - 2.0) / 8.0)) * 0.25 AS cut FROM (
SELECT *, CASE WHEN speed IS NULL THEN sqrt(ux * ux + uy * uy) * dt ELSE speed + 0.1 * (sqrt(ux * ux + uy * uy) * dt - speed) END AS s2 FROM (
SELECT *, vx + (ex * (a / dt) + vx * (1 - a) - vx) * w AS ux, vy + (ey * (a / dt) + vy * (1 - a) - vy) * w AS uy FROM (
SELECT *, CASE WHEN size > 30 THEN vx * dt + ox * (30 / size) ELSE ox + vx * dt END AS ex, CASE WHEN size > 30 THEN vy * dt + oy * (30 / size) ELSE oy + vy * dt END AS ey, dt / (dt + 1 / (2 * pi())) AS a FROM (
SELECT *, sqrt(ox * ox + oy * oy) AS size FROM (
SELECT *, x - px - vx * dt AS ox, y - py - vy * dt AS oy FROM (
SELECT r.user_id, r.n, r.t, r.x, r.y, r.w, greatest(r.t - c.t, 1e-6) AS dt, CASE WHEN r.w > 0 AND NOT c.met THEN r.x ELSE c.x END AS px, CASE WHEN r.w > 0 AND NOT c.met THEN r.y ELSE c.y END AS py,
CASE WHEN r.w > 0 AND NOT c.met THEN 0.0 ELSE c.vx END AS vx, CASE WHEN r.w > 0 AND NOT c.met THEN 0.0 ELSE c.vy END AS vy, c.met OR r.w > 0 AS met, c.speed FROM c JOIN r ON r.user_id = c.user_id AND r.n = c.n + 1)))))))))
SELECT user_id, round(t, 6) + 0.0 AS t, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM c"""


@register("one_euro", _EURO)
def one_euro(spark, sf_dir):
    df = sig(spark, sf_dir).select("user_id", "event_id", (F.col("t") / 3600).alias("t"), F.col("value").alias("x"), (F.col("k") / 100).alias("y"), (F.col("k") / 100).alias("conf"))
    found = filters.run_grouped(df, ["user_id"], ["t", "event_id"], filters.euro_of(["x", "y"], "t", "conf"), "t double, x double, y double")
    return rounded(found)


_BONES = f"""WITH RECURSIVE {KPT}, r AS (SELECT label, vec_id, sqrt(pow(p1_x - p0_x, 2) + pow(p1_y - p0_y, 2)) AS d, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM kpt),
c AS (SELECT label, vec_id, n, d AS learned, d AS length, CAST(0.0 AS DOUBLE) AS moved FROM r WHERE n = 1
UNION ALL SELECT r.label, r.vec_id, r.n, c.learned + 0.05 * (greatest(0.6 * c.learned, least(1.4 * c.learned, r.d)) - c.learned), CASE WHEN abs(r.d - c.learned) > 0.4 * c.learned THEN c.learned ELSE r.d END, CASE WHEN abs(r.d - c.learned) > 0.4 * c.learned THEN abs(r.d - c.learned) ELSE 0.0 END
FROM c JOIN r ON r.label = c.label AND r.n = c.n + 1)
SELECT label, vec_id, round(learned, 6) + 0.0 AS learned, round(length, 6) + 0.0 AS length, round(moved, 6) + 0.0 AS moved FROM c"""


@register("bone_smoothing", _BONES)
def bone_smoothing(spark, sf_dir):
    """Learned length of one bone from vector to vector of a label."""
    df = kpt(spark, sf_dir).select("label", "vec_id", "p0_x", "p0_y", "p1_x", "p1_y")

    def step(state, row):
        p = np.array([[row["p0_x"], row["p0_y"]], [row["p1_x"], row["p1_y"]]])
        state, q, off = filters.bone_step(state, p, [(0, 1)])
        return state, [(int(row["vec_id"]), float(state.get("0", 0.0)), float(np.hypot(*(q[1] - q[0]))), off)]

    return rounded(filters.run_grouped(df, ["label"], ["vec_id"], step, "vec_id bigint, learned double, length double, moved double"))


@register("track_smoothing")
def track_smoothing(spark, sf_dir):
    """Events of a user as detections in frames of four: tracked, smoothed and carried."""
    dets = sig(spark, sf_dir).select("user_id", F.floor(F.col("event_id") / 400).alias("frame"), "event_id", "value", F.col("k").cast("double").alias("k"))
    return rounded(lockstep.track_points(dets, ["user_id"], "frame", ["event_id", "value", "k"], "value", "k", 30.0, filters.Tracker(reach=30.0)))


@register("detection_smoothing")
def detection_smoothing(spark, sf_dir):
    """Boxes blended from frame to frame of a label, lost ones carried."""
    df = kpt(spark, sf_dir).select("label", "vec_id", "p0_x", "p0_y", "p1_x", "p1_y")

    def step(state, row):
        found = [{"cx": row["p0_x"], "cy": row["p0_y"], "score": 0.9}, {"cx": row["p1_x"] + 1, "cy": row["p1_y"], "score": 0.8}]
        state, out = filters.detection_step(state, found)
        return state, [(int(row["vec_id"]), i, float(d["cx"]), float(d["cy"]), float(d["score"]), int(d["carried"])) for i, d in enumerate(out)]

    return rounded(filters.run_grouped(df, ["label"], ["vec_id"], step, "vec_id bigint, box int, cx double, cy double, score double, carried int"))


@register("source_clock", f"""WITH RECURSIVE {SIG}, r AS (SELECT user_id, event_id, floor(t / 36000) AS media, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS n FROM sig),
c AS (SELECT user_id, event_id, n, media AS clock FROM r WHERE n = 0 UNION ALL SELECT r.user_id, r.event_id, r.n, CASE WHEN r.media > c.clock THEN r.media WHEN r.n / 30.0 > c.clock THEN r.n / 30.0 ELSE c.clock + 1 / 30.0 END FROM c JOIN r ON r.user_id = c.user_id AND r.n = c.n + 1)
SELECT user_id, event_id, round(clock, 6) + 0.0 AS clock FROM c""")
def source_clock(spark, sf_dir):
    """A strictly increasing time of each user's events, from whole hours where they advance."""
    df = sig(spark, sf_dir).select("user_id", "event_id", "t", F.floor(F.col("t") / 36000).cast("double").alias("media"))

    def step(state, row):
        last = None if state is None else state["t"]
        n = 0 if state is None else state["n"] + 1
        t = filters.clock_step(last, row["media"], n, 30.0)
        return {"t": t, "n": n}, [(int(row["event_id"]), t)]

    return rounded(filters.run_grouped(df, ["user_id"], ["t", "event_id"], step, "event_id bigint, clock double"))


def _centre(cam: dict) -> list[float]:
    p = fusion.projection(np.array(cam["K"], float), np.array(cam["rvec"], float), np.array(cam["tvec"], float))
    return (-np.linalg.solve(p[:, :3], p[:, 3])).tolist()


def _rays(one: str, two: str) -> str:
    """SQL of the acute angle between the rays of two cameras."""
    a, b = ([f"({c} - ({v!r}))" for c, v in zip("xyz", _centre(RIG[n]), strict=True)] for n in (one, two))
    dot = lambda p, q: "(" + " + ".join(f"{i} * {j}" for i, j in zip(p, q, strict=True)) + ")"
    return f"degrees(acos(least(1.0, abs({dot(a, b)}) / sqrt({dot(a, a)} * {dot(b, b)}))))"


#: The points themselves are what fusing their exact views has to give back.
_FUSED = f"""WITH {KPT}, p AS (SELECT vec_id AS frame, unnest([{", ".join(f"'p{i}'" for i in range(21))}]) AS keypoint, {", ".join(f"unnest([{', '.join(f'p{i}_{c}' for i in range(21))}]) AS {c}" for c in "xyz")} FROM kpt)
SELECT frame, keypoint, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(z, 4) + 0.0 AS z, 0.0 AS reproj_err_px, CASE WHEN frame % 10 = 0 THEN 2 ELSE 3 END AS candidate_n_views, CASE WHEN frame % 10 = 0 THEN 2 ELSE 3 END AS n_views, 1 AS cheirality_ok,
round(CASE WHEN frame % 10 = 0 THEN {_rays("a", "b")} ELSE greatest({_rays("a", "b")}, {_rays("a", "c")}, {_rays("b", "c")}) END, 4) + 0.0 AS triangulation_angle_deg FROM p"""


@register("triangulate", _FUSED)
def triangulate(spark, sf_dir):
    """All points of the vectors seen by three cameras and fused again: position, error, views, angle."""
    k = kpt(spark, sf_dir)
    pts = k.select(F.lit("s").alias("session"), F.col("vec_id").alias("frame"), F.inline(F.array(*[F.struct(F.lit(f"p{i}").alias("keypoint"), *[F.col(f"p{i}_{c}").alias(c) for c in "xyz"]) for i in range(21)])))
    views = []
    for name, cam in RIG.items():
        p = fusion.projection(np.array(cam["K"], float), np.array(cam["rvec"], float), np.array(cam["tvec"], float))
        h = [sum(float(p[r, j]) * F.col("xyz"[j]) for j in range(3)) + float(p[r, 3]) for r in range(3)]
        lost = (F.col("frame") % 10 == 0) & (F.lit(name) == "c")
        views.append(pts.select("session", "frame", "keypoint", F.lit(name).alias("camera"), F.when(~lost, h[0] / h[2]).alias("px"), F.when(~lost, h[1] / h[2]).alias("py"), F.lit(0.9).alias("confidence")))
    found = fusion.fuse(views[0].unionAll(views[1]).unionAll(views[2]), RIG)
    return rounded(found.drop("session"), 4)


def _hand_table(spark, sf_dir):
    """The vectors as a landmark table: a recording a label, a frame a vector, 21 points of a left hand."""
    from motiondeck.sources.schema import hand_column

    e = kpt(spark, sf_dir)
    w = Window.partitionBy("label").orderBy("vec_id")
    cells = [F.col(f"p{i}_{c}").alias(hand_column("left", i, c)) for i in range(21) for c in "xyz"]
    conf = [F.when(F.col("vec_id") % 9 == 0, 0.0).otherwise(0.9).alias(hand_column("left", i, "conf")) for i in range(21)]
    frame = (F.row_number().over(w) - 1).cast("int")
    df = e.withColumn("frame_idx", frame)
    return df.select(F.concat(F.lit("v"), "label").alias("video"), "frame_idx", (F.col("frame_idx") / 30).alias("timestamp_sec"), F.lit(0).alias("person_idx"), *cells, *conf)


#: The body's points are those of a vector in threes: shoulders, elbows, wrists, index bases, hips, then four of each hand.
_BODY = {f"body_{s}_{k}": 2 * i + (s == "right") for i, k in enumerate(("shoulder", "elbow", "wrist", "index", "hip")) for s in ("left", "right")}
_HAND = {f"{s}_hand_{k}": 10 + 4 * (s == "right") + i for s in ("left", "right") for i, k in enumerate((0, 4, 8, 20))}


def _body_table(spark, sf_dir):
    """The vectors as a 2D body table: a recording a label, a frame a vector, ten points of the body and four of each hand; every ninth
    frame lacks the left wrist, every eleventh the right hand."""
    e, w = kpt(spark, sf_dir), Window.partitionBy("label").orderBy("vec_id")
    df = e.withColumn("frame_idx", (F.row_number().over(w) - 1).cast("int"))
    cells = [F.col(f"p{i}_{c}").alias(f"{n}_{c}") for n, i in (_BODY | _HAND).items() for c in "xyz"]
    lost = lambda n: (F.col("vec_id") % 9 == 0) if n == "body_left_wrist" else (F.col("vec_id") % 11 == 0) if n.startswith("right_hand") else F.lit(False)
    seen = [F.when(lost(n), 0.0).otherwise(0.9).alias(f"{n}_{'conf' if '_hand_' in n else 'vis'}") for n in _BODY | _HAND]
    return df.select(F.concat(F.lit("v"), "label").alias("video"), "frame_idx", (F.col("frame_idx") / 30).alias("timestamp_sec"), F.lit(0).alias("person_idx"), *cells, *seen)


def _frame_sql() -> tuple[str, str]:
    """SQL of the 54 columns: the tables of points ``bt`` and features ``ft``, and what is taken from them."""
    at = lambda n, c: f"{n}_{c}"
    dist = lambda a, b: "sqrt(" + " + ".join(f"pow({at(a, c)} - {at(b, c)}, 2)" for c in "xyz") + ")"
    moved = lambda a: "sqrt(" + " + ".join(f"pow({at(a, c)} - lag({at(a, c)}) OVER w, 2)" for c in "xyz") + ")"
    over = lambda a, b, least: f"CASE WHEN {b} > {least} THEN {a} / {b} END"

    def angle(a: str, b: str, c: str) -> str:
        dot = " + ".join(f"({at(a, k)} - {at(b, k)}) * ({at(c, k)} - {at(b, k)})" for k in "xyz")
        return f"CASE WHEN {dist(a, b)} * {dist(c, b)} > 1e-12 THEN degrees(acos(greatest(-1.0, least(1.0, ({dot}) / ({dist(a, b)} * {dist(c, b)}))))) END"

    cells = {}
    for s, o in (("left", "right"), ("right", "left")):
        b, h = (lambda k, s=s: f"body_{s}_{k}"), (lambda k, s=s: f"{s}_hand_{k}")
        reach = dist(b("shoulder"), b("wrist"))
        values = [angle(b("shoulder"), b("elbow"), b("wrist")), angle(b("elbow"), b("wrist"), b("index")), angle(h(8), h(0), h(20)), reach, over(reach, dist(b("shoulder"), f"body_{o}_shoulder"), "1e-6"), dist(h(4), h(8)), dist(h(4), h(20)), moved(b("wrist")), moved(h(8))]
        cells |= {f"{s}_{n}": v for n, v in zip(features.FRAME_METRICS, values, strict=True)}
    mid = lambda c: f"((body_left_shoulder_{c} + body_right_shoulder_{c}) / 2 - (body_left_hip_{c} + body_right_hip_{c}) / 2)"
    turn = "(atan2(body_right_shoulder_y - body_left_shoulder_y, body_right_shoulder_x - body_left_shoulder_x) - atan2(body_right_hip_y - body_left_hip_y, body_right_hip_x - body_left_hip_x))"
    width = "sqrt(pow(body_right_shoulder_x - body_left_shoulder_x, 2) + pow(body_right_shoulder_y - body_left_shoulder_y, 2))"
    trunk = [f"degrees(atan2(abs({mid('x')}), abs({mid('y')})))", f"degrees(atan2({mid('x')}, -{mid('y')}))", "CAST(NULL AS DOUBLE)", f"degrees(atan2(sin{turn}, cos{turn}))", over("(body_left_shoulder_y - body_right_shoulder_y)", width, "1e-6")]
    cells |= dict(zip(features.TRUNK, trunk, strict=True))
    lost = lambda n: "vec_id % 9 = 0" if n == "body_left_wrist" else "vec_id % 11 = 0" if n.startswith("right_hand") else "false"
    points = ", ".join(f"CASE WHEN NOT ({lost(n)}) THEN p{i}_{c} END AS {n}_{c}" for n, i in (_BODY | _HAND).items() for c in "xyz")
    two = ""
    for m in features.FRAME_METRICS:
        a, b = f"abs(left_{m})", f"abs(right_{m})"
        some = f"{a} + {b} > 1e-12"
        two += f", round(CASE WHEN {some} THEN least({a}, {b}) / greatest({a}, {b}) END, 6) + 0.0 AS {m}_symmetry_ratio, round(CASE WHEN {some} THEN ({b} - {a}) / ({a} + {b}) END, 6) + 0.0 AS {m}_dominance_index, round(abs(right_{m} - left_{m}), 6) + 0.0 AS {m}_abs_diff"
    own = ", ".join(f"{v} AS {n}" for n, v in cells.items())
    kept = ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in cells)
    return f"""{KPT}, bt AS (SELECT 'v' || label AS video, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS frame_idx, {points} FROM kpt),
ft AS (SELECT video, frame_idx, {own} FROM bt WINDOW w AS (PARTITION BY video ORDER BY frame_idx))""", f"""SELECT video, frame_idx, round(frame_idx / 30.0, 6) + 0.0 AS timestamp_sec, 0 AS person_idx, {kept}{two} FROM ft"""


_FT, _FT_ALL = _frame_sql()


def _window_sql() -> tuple[str, str]:
    """SQL of the 46 columns, the tables and what is taken from them: windows of a second, the points of wrists and index tips on their slots, steps, jerks, spectra, trunk sums."""
    key = "video, i, side, source"
    points = " UNION ALL ".join(f"SELECT video, i, slot, fs, '{side}' AS side, '{source}' AS source, {', '.join(f'{name}_{c} AS {c}' for c in 'xyz')} FROM wr" for side in ("left", "right") for source, name in (("wrist", f"body_{side}_wrist"), ("fingertip", f"{side}_hand_8")))
    third = " + ".join(f"pow({c} - 3 * lag({c}, 1) OVER w + 3 * lag({c}, 2) OVER w - lag({c}, 3) OVER w, 2)" for c in "xyz")
    step = "sqrt(" + " + ".join(f"pow({c} - lag({c}) OVER w, 2)" for c in "xyz") + ")"
    ends = "sqrt(" + " + ".join(f"pow(arg_max({c}, slot) - arg_min({c}, slot), 2)" for c in "xyz") + ")"
    names = {"wrist_sal": ("wrist", "sal"), "wrist_velocity_mean": ("wrist", "mean * fs"), "wrist_velocity_peak": ("wrist", "peak * fs"), "wrist_normalized_jerk": ("wrist", "nj"), "wrist_movement_efficiency": ("wrist", "eff"), "fingertip_normalized_jerk": ("fingertip", "nj")}
    sides = ", ".join(f"max(CASE WHEN side = '{side}' AND source = '{source}' THEN {c} END) AS {side}_{n}" for side in ("left", "right") for n, (source, c) in names.items())
    own = ", ".join(f"round({side}_{n}, 4) + 0.0 AS {side}_{n}" for side in ("left", "right") for n in names)
    two = ""
    for n in names:
        a, b = f"abs(left_{n})", f"abs(right_{n})"
        some = f"{a} + {b} > 1e-12"
        two += f", round(CASE WHEN {some} THEN least({a}, {b}) / greatest({a}, {b}) END, 4) + 0.0 AS {n}_symmetry_ratio, round(CASE WHEN {some} THEN ({b} - {a}) / ({a} + {b}) END, 4) + 0.0 AS {n}_dominance_index, round(abs(right_{n} - left_{n}), 4) + 0.0 AS {n}_abs_diff"
    trunk = ", ".join(f"avg({c}{'' if c == 'posture_symmetry' else '_deg'}) AS {c}_mean, stddev_samp({c}{'' if c == 'posture_symmetry' else '_deg'}) AS {c}_sd" for c in ("trunk_lean", "trunk_lean_sagittal", "trunk_lean_lateral", "trunk_rotation", "posture_symmetry"))
    body = ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in BODY_WINDOW_METRICS)
    return f"""WITH {_FT}, tt AS (SELECT *, frame_idx / 30.0 AS t FROM bt), st AS (SELECT *, abs(t - lag(t) OVER (PARTITION BY video ORDER BY frame_idx)) AS step FROM tt),
rt AS (SELECT video, 1 / median(step) AS fs, min(t) AS t0, max(t) AS t1 FROM st GROUP BY 1 HAVING count(*) >= 4),
wk AS (SELECT video, fs, t0, i, t0 + i * 0.5 AS ws, t0 + i * 0.5 + 1.0 AS we FROM rt, LATERAL (SELECT unnest(generate_series(0, CAST(floor((t1 - t0 - 1.0) / 0.5 + 1e-10) AS BIGINT))) AS i) WHERE t1 - t0 >= 1.0 - 1e-10),
wa AS (SELECT tt.*, wk.fs, wk.i, wk.ws, wk.we, count(*) OVER (PARTITION BY wk.video, wk.i) AS n_rows, min(t) OVER (PARTITION BY wk.video, wk.i) AS first FROM tt JOIN wk ON wk.video = tt.video AND t >= ws AND t < we),
wr AS (SELECT *, CAST(round_even((t - first) * fs, 0) AS BIGINT) AS slot FROM wa WHERE n_rows >= 4),
pt AS ({points}), pg AS (SELECT *, max(slot) OVER (PARTITION BY {key}) AS top FROM pt), pk AS (SELECT * FROM pg WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
ps AS (SELECT *, CASE WHEN lag(slot) OVER w = slot - 1 THEN {step} END AS step, CASE WHEN lag(slot, 3) OVER w = slot - 3 THEN {third} END AS jerk FROM pk WINDOW w AS (PARTITION BY {key} ORDER BY slot)),
pm AS (SELECT {key}, any_value(fs) AS fs, any_value(top) + 1 AS n_grid, count(*) AS n, min(slot) AS lo, max(slot) AS hi, avg(step) AS mean, max(step) AS peak, sum(step) AS path, sum(jerk) AS jerk, {ends} AS straight FROM ps GROUP BY {key}),
sk AS (SELECT {key}, any_value(top) AS top, any_value(fs) AS fs FROM ps WHERE step IS NOT NULL GROUP BY {key} HAVING count(*) >= 4 AND min(slot) = 1 AND max(slot) = any_value(top)),
sg AS (SELECT sk.*, slot FROM sk, LATERAL (SELECT unnest(generate_series(1, top)) AS slot)),
sv AS (SELECT sg.*, step * sg.fs AS v FROM sg LEFT JOIN ps ON ps.video = sg.video AND ps.i = sg.i AND ps.side = sg.side AND ps.source = sg.source AND ps.slot = sg.slot),
sn AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN slot END IGNORE NULLS) OVER b AS ps, last_value(v IGNORE NULLS) OVER b AS pv, first_value(CASE WHEN v IS NOT NULL THEN slot END IGNORE NULLS) OVER f AS ns, first_value(v IGNORE NULLS) OVER f AS nv FROM sv
WINDOW b AS (PARTITION BY {key} ORDER BY slot ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY {key} ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
sl AS (SELECT {key}, any_value(top) AS n, any_value(fs) AS fs, list(coalesce(v, pv + (nv - pv) * (slot - ps) / (ns - ps)) ORDER BY slot) AS v FROM sn GROUP BY {key}),
sf AS (SELECT {key}, n, fs, k, list_max(list_transform(v, lambda q: abs(q))) AS top, sqrt(pow(list_sum(list_transform(v, lambda q, j: q * cos(2 * pi() * k * (j - 1) / n))), 2) + pow(list_sum(list_transform(v, lambda q, j: q * sin(2 * pi() * k * (j - 1) / n))), 2)) AS a FROM sl, LATERAL (SELECT unnest(generate_series(0, n // 2)) AS k)),
sr AS (SELECT *, a / max(a) OVER (PARTITION BY {key}) AS r, fs / 2 / (n // 2) AS unit, least(10.0, fs / 2) AS cut FROM sf),
sd AS (SELECT *, r - lag(r) OVER (PARTITION BY {key} ORDER BY k) AS dr FROM sr),
sz AS (SELECT {key}, CASE WHEN any_value(top) < 1e-10 THEN 0.0 ELSE -sum(sqrt(pow(unit / cut, 2) + pow(dr, 2))) FILTER (k >= 1 AND k * unit <= cut) END AS sal FROM sd GROUP BY {key}),
pq AS (SELECT pm.*, sal, CASE WHEN hi > lo AND n = hi - lo + 1 AND straight > 1e-10 THEN path / straight END AS eff, CASE WHEN n_grid >= 5 AND path >= 1e-10 THEN sqrt(pow((n_grid - 1) / fs, 5) / (2 * pow(path, 2)) * jerk * pow(fs, 6) / fs) END AS nj
FROM pm LEFT JOIN sz ON sz.video = pm.video AND sz.i = pm.i AND sz.side = pm.side AND sz.source = pm.source),
pw AS (SELECT video, i, {sides} FROM pq GROUP BY 1, 2),
tw AS (SELECT wr.video, wr.i, any_value(ws) AS ws, any_value(we) AS we, max(trunk_lean_deg) - min(trunk_lean_deg) AS trunk_lean_range, {trunk}, CASE WHEN count(trunk_lean_deg) >= 5 THEN corr(trunk_lean_deg, greatest(left_reach_raw, right_reach_raw)) END AS compensatory_pattern_index FROM wr JOIN ft ON ft.video = wr.video AND ft.frame_idx = wr.frame_idx GROUP BY 1, 2)""", f"""SELECT tw.video, 0 AS person_idx, round(ws, 4) AS window_start_sec, round(we, 4) AS window_end_sec, {own}, {body}{two} FROM tw LEFT JOIN pw ON pw.video = tw.video AND pw.i = tw.i"""


@register("body_frame_table", f"WITH {_FT} {_FT_ALL}")
def body_frame_table(spark, sf_dir):
    """All 54 columns of the frame table of body recordings with both hands."""
    own, mode, world = features.gated(_body_table(spark, sf_dir))
    return rounded(features.frame_features(own, mode, world))


_WT, _WT_ALL = _window_sql()


@register("body_window_table", f"{_WT} {_WT_ALL}")
def body_window_table(spark, sf_dir):
    """The whole window table of the body recordings: wrists, fingertips, trunk and both sides compared."""
    own, mode, world = features.gated(_body_table(spark, sf_dir))
    return rounded(features.window_features(own, mode, world), 4)


def _quality_sql() -> str:
    """SQL of the 22 columns: evidence of every source in every window, and the first cause against each metric."""
    key = "video, i, side, source"
    metrics = ", ".join(f"('{side}', '{m}', '{source}', '{f'body_{side}_wrist' if source == 'wrist' else f'{side}_hand_8'}')" for side in ("left", "right") for m, source in features.SIDE_METRICS.items())
    estimates = " UNION ALL ".join(f"SELECT video, i, '{side}' AS side, '{m}' AS metric, {side}_{m} AS estimate FROM pw" for side in ("left", "right") for m in features.SIDE_METRICS)
    low, gap = f"{grid.MIN_COVERAGE} * (1 - {grid.TOLERANCE})", f"{grid.MAX_GAP_SEC} * (1 + {grid.TOLERANCE})"
    reason = f"CASE WHEN nv = 0 THEN '{grid.REASONS[1]}' WHEN nv < 2 OR ni < 1 THEN '{grid.REASONS[2]}' WHEN longest / fs > {gap} THEN '{grid.REASONS[3]}' WHEN nv / total < {low} THEN '{grid.REASONS[4]}' WHEN estimate IS NULL OR NOT isfinite(estimate) THEN '{grid.REASONS[5]}' ELSE 'none' END"
    return f"""{_WT}, wl AS (SELECT video, i, any_value(ws) AS ws, any_value(we) AS we, CAST(greatest(0, round_even((min(t) - any_value(ws)) * any_value(fs), 0)) AS BIGINT) AS lead, CAST(greatest(0, round_even((any_value(we) - max(t)) * any_value(fs), 0) - 1) AS BIGINT) AS trail FROM wr GROUP BY 1, 2),
e0 AS (SELECT *, CASE WHEN x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL THEN slot END AS seen FROM pt),
e1 AS (SELECT *, seen - last_value(seen IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS gap FROM e0),
e2 AS (SELECT {key}, any_value(fs) AS fs, max(slot) AS last, min(seen) AS lo, max(seen) AS hi, count(seen) AS nv, count(*) FILTER (gap = 0) AS ni, coalesce(max(gap), 0) AS inner_gap, count(*) FILTER (gap > 0) AS gaps FROM e1 GROUP BY {key}),
e3 AS (SELECT e2.*, ws, we, CAST(last + 1 + lead + trail AS DOUBLE) AS total, lead + lo AS head, last - hi + trail AS tail FROM e2 JOIN wl ON wl.video = e2.video AND wl.i = e2.i),
e4 AS (SELECT *, CASE WHEN nv = 0 THEN total ELSE greatest(inner_gap, head, tail) END AS longest, CASE WHEN nv = 0 THEN 1 ELSE gaps + CASE WHEN head > 0 THEN 1 ELSE 0 END + CASE WHEN tail > 0 THEN 1 ELSE 0 END END AS n_gaps FROM e3),
mm AS (SELECT * FROM (VALUES {metrics}) AS m(side, metric, source, required)), est AS ({estimates}),
q AS (SELECT e4.*, mm.metric, mm.required, estimate FROM e4 JOIN mm ON mm.side = e4.side AND mm.source = e4.source LEFT JOIN est ON est.video = e4.video AND est.i = e4.i AND est.side = mm.side AND est.metric = mm.metric)
SELECT video, 0 AS person_idx, round(ws, 4) AS window_start_sec, round(we, 4) AS window_end_sec, side || '_' || metric AS metric_id, side || '_' || source AS source_group, CAST(total AS INT) AS n_expected_frames, CAST(nv AS INT) AS n_valid_frames, round(nv / total, 6) + 0.0 AS frame_coverage,
CAST(total - 1 AS INT) AS n_expected_intervals, CAST(ni AS INT) AS n_valid_intervals, round(CASE WHEN total > 1 THEN ni / (total - 1) END, 6) + 0.0 AS interval_coverage, round(ni / fs, 6) + 0.0 AS valid_duration_sec, CAST(longest AS INT) AS longest_gap_frames, round(longest / fs, 6) + 0.0 AS longest_gap_sec, CAST(n_gaps AS INT) AS n_gaps,
required AS required_keypoints, CAST(nv > 0 AS INT) AS n_required_keypoints_present, CAST({grid.MIN_COVERAGE} AS DOUBLE) AS min_coverage, CAST({grid.MAX_GAP_SEC} AS DOUBLE) AS max_gap_sec, CASE WHEN {reason} = 'none' THEN 'pass' ELSE 'fail' END AS qc_status, {reason} AS qc_reason FROM q"""


@register("body_quality_table", _quality_sql())
def body_quality_table(spark, sf_dir):
    """Twelve rows a window of the body recordings: the evidence behind each metric and why it does not count, if so."""
    own, mode, world = features.gated(_body_table(spark, sf_dir))
    return rounded(features.window_quality(own, mode, features.window_features(own, mode, world)))


#: The left hand's points where they were observed.
_HT = f"{KPT}, ht AS (SELECT 'v' || label AS video, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS frame_idx, " + ", ".join(f"CASE WHEN vec_id % 9 <> 0 THEN p{i}_{c} END AS h{i}_{c}" for i in (0, 4, 8, 20) for c in "xyz") + " FROM kpt)"


def _hand_frame_sql() -> str:
    """SQL of the 54 columns of a table with one hand: spread, apertures and movement of the left one, NULL for all else."""
    dist = lambda a, b: "sqrt(" + " + ".join(f"pow(h{a}_{c} - h{b}_{c}, 2)" for c in "xyz") + ")"
    dot = " + ".join(f"(h8_{c} - h0_{c}) * (h20_{c} - h0_{c})" for c in "xyz")
    known = {
        "left_finger_spread_deg": f"CASE WHEN {dist(8, 0)} * {dist(20, 0)} > 1e-12 THEN degrees(acos(greatest(-1.0, least(1.0, ({dot}) / ({dist(8, 0)} * {dist(20, 0)}))))) END",
        "left_grasp_aperture_thumb_index": dist(4, 8), "left_grasp_aperture_thumb_pinky": dist(4, 20), "left_fingertip_displacement": "sqrt(" + " + ".join(f"pow(h8_{c} - lag(h8_{c}) OVER w, 2)" for c in "xyz") + ")",
    }
    names = [f"{s}_{m}" for s in ("left", "right") for m in features.FRAME_METRICS] + [f"{m}_{k}" for m in features.FRAME_METRICS for k in BILATERAL] + features.TRUNK
    cells = ", ".join(f"round({known[n]}, 6) + 0.0 AS {n}" if n in known else f"CAST(NULL AS DOUBLE) AS {n}" for n in names)
    return f"WITH {_HT} SELECT video, frame_idx, round(frame_idx / 30.0, 6) + 0.0 AS timestamp_sec, 0 AS person_idx, {cells} FROM ht WINDOW w AS (PARTITION BY video ORDER BY frame_idx)"


def _hand_window_sql() -> str:
    """SQL of the 46 columns of a table with one hand: the jerk of its index tip, NULL for all else."""
    third = " + ".join(f"pow({c} - 3 * lag({c}, 1) OVER w + 3 * lag({c}, 2) OVER w - lag({c}, 3) OVER w, 2)" for c in "xyz")
    step = "sqrt(" + " + ".join(f"pow({c} - lag({c}) OVER w, 2)" for c in "xyz") + ")"
    names = [f"{s}_{m}" for s in ("left", "right") for m in features.SIDE_METRICS] + BODY_WINDOW_METRICS + [f"{m}_{k}" for m in features.SIDE_METRICS for k in BILATERAL]
    cells = ", ".join("round(nj, 4) + 0.0 AS left_fingertip_normalized_jerk" if n == "left_fingertip_normalized_jerk" else f"CAST(NULL AS DOUBLE) AS {n}" for n in names)
    return f"""WITH {_HT}, tt AS (SELECT video, frame_idx, h8_x AS x, h8_y AS y, h8_z AS z, frame_idx / 30.0 AS t FROM ht), st AS (SELECT *, abs(t - lag(t) OVER (PARTITION BY video ORDER BY frame_idx)) AS step FROM tt),
rt AS (SELECT video, 1 / median(step) AS fs, min(t) AS t0, max(t) AS t1 FROM st GROUP BY 1 HAVING count(*) >= 4),
wk AS (SELECT video, fs, i, t0 + i * 0.5 AS ws, t0 + i * 0.5 + 1.0 AS we FROM rt, LATERAL (SELECT unnest(generate_series(0, CAST(floor((t1 - t0 - 1.0) / 0.5 + 1e-10) AS BIGINT))) AS i) WHERE t1 - t0 >= 1.0 - 1e-10),
wa AS (SELECT tt.*, wk.fs, wk.i, wk.ws, wk.we, count(*) OVER (PARTITION BY wk.video, wk.i) AS n_rows, min(t) OVER (PARTITION BY wk.video, wk.i) AS first FROM tt JOIN wk ON wk.video = tt.video AND t >= ws AND t < we),
wr AS (SELECT *, CAST(round_even((t - first) * fs, 0) AS BIGINT) AS slot FROM wa WHERE n_rows >= 4), pg AS (SELECT *, max(slot) OVER (PARTITION BY video, i) AS top FROM wr), pk AS (SELECT * FROM pg WHERE x IS NOT NULL),
ps AS (SELECT *, CASE WHEN lag(slot) OVER w = slot - 1 THEN {step} END AS step, CASE WHEN lag(slot, 3) OVER w = slot - 3 THEN {third} END AS jerk FROM pk WINDOW w AS (PARTITION BY video, i ORDER BY slot)),
pm AS (SELECT video, i, any_value(fs) AS fs, any_value(top) + 1 AS n_grid, sum(step) AS path, sum(jerk) AS jerk FROM ps GROUP BY 1, 2),
al AS (SELECT video, i, any_value(ws) AS ws, any_value(we) AS we FROM wr GROUP BY 1, 2)
SELECT al.video, 0 AS person_idx, round(ws, 4) AS window_start_sec, round(we, 4) AS window_end_sec, {cells} FROM al LEFT JOIN (SELECT *, CASE WHEN n_grid >= 5 AND path >= 1e-10 THEN sqrt(pow((n_grid - 1) / fs, 5) / (2 * pow(path, 2)) * jerk * pow(fs, 6) / fs) END AS nj FROM pm) p ON p.video = al.video AND p.i = al.i"""


@register("frame_table", _hand_frame_sql())
def frame_table(spark, sf_dir):
    """The whole frame table of the hand recordings."""
    own, mode, world = features.gated(_hand_table(spark, sf_dir))
    return rounded(features.frame_features(own, mode, world))


@register("window_table", _hand_window_sql())
def window_table(spark, sf_dir):
    """The whole window table of the hand recordings: fingertips only, as there are no wrists."""
    own, mode, world = features.gated(_hand_table(spark, sf_dir))
    return rounded(features.window_features(own, mode, world), 4)


@register("hand_gate", "WITH h AS (SELECT label, vec_id, embedding FROM embeddings) SELECT 'v' || label AS video, count(*) AS n_frames, count(*) FILTER (vec_id % 9 <> 0) AS n_observed, round(avg(CASE WHEN vec_id % 9 <> 0 THEN CAST(embedding[25] AS DOUBLE) END), 6) + 0.0 AS tip_x FROM h GROUP BY label")
def hand_gate(spark, sf_dir):
    own, _, _ = features.gated(_hand_table(spark, sf_dir))
    return rounded(own.groupBy("video").agg(F.count("*").alias("n_frames"), F.count("left_hand_8_x").alias("n_observed"), F.avg("left_hand_8_x").alias("tip_x")))
