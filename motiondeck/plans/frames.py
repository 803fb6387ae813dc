"""Queries of gates, geometry and ordered series."""

from __future__ import annotations

from pyspark.sql import functions as F

from motiondeck.catalog import register
from motiondeck.functions import geometry as g
from motiondeck.operators import aggregate, gates, ordered, tables
from motiondeck.plans.proxies import KPT, ORDER, SIG, TRJ, TRJ_ORDER, kpt, rounded, sig, trj

_R = "round({}, 6) + 0.0 AS {}"


def _cols(**named: str) -> str:
    return ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in named.items())


@register("gate_agg", f"WITH {SIG}, g AS (SELECT user_id, CASE WHEN k > 0 THEN value END AS value FROM sig) SELECT user_id, " + _cols(value__mean="avg(value)", value__median="median(value)", value__sd="stddev_samp(value)", value__min="min(value)", value__max="max(value)") + " FROM g GROUP BY user_id")
def gate_agg(spark, sf_dir):
    df = sig(spark, sf_dir).withColumn("value", gates.observed(F.col("value"), F.col("k")))
    return rounded(aggregate.per_recording(df, ["user_id"], ["value"]))


@register("trust_gate", f"WITH {TRJ}, g AS (SELECT l_suppkey, CASE WHEN l_tax * 300 <= 20 AND round(l_discount * 100) % 7 <> 0 AND l_discount * 100 >= 1 THEN x END AS x, CASE WHEN l_tax * 300 <= 20 AND round(l_discount * 100) % 7 <> 0 AND l_discount * 100 >= 1 THEN y END AS y FROM trj) SELECT l_suppkey, count(*) AS n_rows, count(x) AS n_trusted, " + _cols(x_mean="avg(x)", y_mean="avg(y)") + " FROM g GROUP BY l_suppkey")
def trust_gate(spark, sf_dir):
    df = trj(spark, sf_dir)
    cheirality = (F.round(F.col("l_discount") * 100) % 7 != 0).cast("int")
    df = df.withColumn("ok", gates.trusted(F.col("x"), F.col("y"), F.col("z"), F.col("l_tax") * 300, cheirality, F.col("l_discount") * 100))
    return rounded(df.groupBy("l_suppkey").agg(F.count("*").alias("n_rows"), F.count_if("ok").alias("n_trusted"), F.avg(F.when(F.col("ok"), F.col("x"))).alias("x_mean"), F.avg(F.when(F.col("ok"), F.col("y"))).alias("y_mean")))


def _angle(a: int, b: int, c: int) -> str:
    u = [f"(p{a}_{k} - p{b}_{k})" for k in "xyz"]
    v = [f"(p{c}_{k} - p{b}_{k})" for k in "xyz"]
    dot = " + ".join(f"{p} * {q}" for p, q in zip(u, v, strict=True))
    size = "sqrt(" + " + ".join(f"{p} * {p}" for p in u) + ") * sqrt(" + " + ".join(f"{q} * {q}" for q in v) + ")"
    return f"CASE WHEN {size} > 1e-12 THEN degrees(acos(greatest(-1.0, least(1.0, ({dot}) / ({size}))))) END"


def _dist(a: int, b: int) -> str:
    return "sqrt(" + " + ".join(f"(p{a}_{k} - p{b}_{k}) * (p{a}_{k} - p{b}_{k})" for k in "xyz") + ")"


@register("angle_at_vertex", f"WITH {KPT} SELECT vec_id, " + _cols(angle_0_5_8=_angle(0, 5, 8), angle_0_9_12=_angle(0, 9, 12)) + " FROM kpt")
def angle_at_vertex(spark, sf_dir):
    p = g.point
    return rounded(kpt(spark, sf_dir).select("vec_id", g.angle_at_vertex(p("p0"), p("p5"), p("p8")).alias("angle_0_5_8"), g.angle_at_vertex(p("p0"), p("p9"), p("p12")).alias("angle_0_9_12")))


@register("finger_flexion", f"WITH {KPT} SELECT vec_id, " + ", ".join(f"round((180 - {_angle(s, s + 1, s + 2)}) + (180 - {_angle(s + 1, s + 2, s + 3)}), 2) + 0.0 AS {n}" for n, s in (("thumb", 1), ("index", 5), ("middle", 9), ("ring", 13), ("pinky", 17))) + " FROM kpt")
def finger_flexion(spark, sf_dir):
    p = lambda i: g.point(f"p{i}")
    fingers = (("thumb", 1), ("index", 5), ("middle", 9), ("ring", 13), ("pinky", 17))
    return kpt(spark, sf_dir).select("vec_id", *[(g.finger_flexion(p(s), p(s + 1), p(s + 2), p(s + 3)) + F.lit(0.0)).alias(n) for n, s in fingers])


@register("bilateral_triple", f"WITH {KPT} SELECT vec_id, " + _cols(symmetry_ratio="CASE WHEN abs(p0_x) + abs(p10_x) > 1e-12 THEN least(abs(p0_x), abs(p10_x)) / greatest(abs(p0_x), abs(p10_x)) END", dominance_index="CASE WHEN abs(p0_x) + abs(p10_x) > 1e-12 THEN (abs(p10_x) - abs(p0_x)) / (abs(p0_x) + abs(p10_x)) END", abs_diff="abs(p10_x - p0_x)") + " FROM kpt")
def bilateral_triple(spark, sf_dir):
    return rounded(kpt(spark, sf_dir).select("vec_id", *[c.alias(n) for n, c in g.bilateral(F.col("p0_x"), F.col("p10_x")).items()]))


_MID = "(p0_{0} + p1_{0}) / 2 - (p2_{0} + p3_{0}) / 2"
_TURN = "degrees(atan2(sin({0}), cos({0})))"


@register("trunk_2d", f"WITH {KPT} SELECT vec_id, " + _cols(trunk_lean_deg=f"degrees(atan2(abs({_MID.format('x')}), abs({_MID.format('y')})))", trunk_lean_lateral_deg=f"degrees(atan2({_MID.format('x')}, -({_MID.format('y')})))", trunk_rotation_deg=_TURN.format("atan2(p1_y - p0_y, p1_x - p0_x) - atan2(p3_y - p2_y, p3_x - p2_x)"), posture_symmetry="CASE WHEN sqrt((p1_x - p0_x) * (p1_x - p0_x) + (p1_y - p0_y) * (p1_y - p0_y)) > 1e-6 THEN (p0_y - p1_y) / sqrt((p1_x - p0_x) * (p1_x - p0_x) + (p1_y - p0_y) * (p1_y - p0_y)) END") + " FROM kpt")
def trunk_2d(spark, sf_dir):
    p = g.point
    found = g.trunk_2d(p("p0"), p("p1"), p("p2"), p("p3"))
    return rounded(kpt(spark, sf_dir).select("vec_id", *[c.alias(n) for n, c in found.items() if n != "trunk_lean_sagittal_deg"]))


@register("trunk_3d", f"WITH {KPT} SELECT vec_id, " + _cols(trunk_lean_deg=f"degrees(atan2(sqrt(pow({_MID.format('x')}, 2) + pow({_MID.format('z')}, 2)), -({_MID.format('y')})))", trunk_lean_lateral_deg=f"degrees(atan2({_MID.format('x')}, -({_MID.format('y')})))", trunk_lean_sagittal_deg=f"degrees(atan2({_MID.format('z')}, -({_MID.format('y')})))", trunk_rotation_deg=_TURN.format("atan2(p1_z - p0_z, p1_x - p0_x) - atan2(p3_z - p2_z, p3_x - p2_x)"), posture_symmetry=f"CASE WHEN {_dist(1, 0)} > 1e-6 THEN (p0_y - p1_y) / {_dist(1, 0)} END") + " FROM kpt")
def trunk_3d(spark, sf_dir):
    p = g.point
    return rounded(kpt(spark, sf_dir).select("vec_id", *[c.alias(n) for n, c in g.trunk_3d(p("p0"), p("p1"), p("p2"), p("p3")).items()]))


@register("reach_aperture", f"WITH {KPT} SELECT vec_id, " + _cols(reach_raw=_dist(0, 4), reach_norm=f"CASE WHEN {_dist(0, 1)} > 1e-6 THEN {_dist(0, 4)} / {_dist(0, 1)} END", aperture_thumb_index=_dist(4, 8), aperture_thumb_pinky=_dist(4, 20)) + " FROM kpt")
def reach_aperture(spark, sf_dir):
    p = g.point
    reach = g.distance(p("p0"), p("p4"))
    return rounded(kpt(spark, sf_dir).select("vec_id", reach.alias("reach_raw"), g.ratio(reach, g.distance(p("p0"), p("p1")), 1e-6).alias("reach_norm"), g.distance(p("p4"), p("p8")).alias("aperture_thumb_index"), g.distance(p("p4"), p("p20")).alias("aperture_thumb_pinky")))


_STEP = "sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2))"
_TW = f"WINDOW w AS (PARTITION BY l_suppkey {TRJ_ORDER})"


@register("displacement", f"WITH {TRJ} SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, {_R.format(_STEP, 'step')} FROM trj {_TW}")
def displacement(spark, sf_dir):
    w = ordered.series(["l_suppkey"], ORDER)
    return rounded(trj(spark, sf_dir).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", ordered.step_length(w, "x", "y", "z").alias("step")))


_SW = "WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)"
_KEYS = ["user_id"]
_SORD = ["t", "event_id"]


@register("centred_mean", f"WITH {SIG} SELECT event_id, round(CASE WHEN count(value) OVER f = 5 THEN avg(value) OVER f END, 6) + 0.0 AS ma5 FROM sig WINDOW f AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def centred_mean(spark, sf_dir):
    return rounded(sig(spark, sf_dir).select("event_id", ordered.centred_mean(ordered.series(_KEYS, _SORD), "value").alias("ma5")))


@register("running_median", f"WITH {SIG}, g AS (SELECT *, CASE WHEN k >= 20 THEN value END AS v FROM sig) SELECT event_id, round(median(v) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) + 0.0 AS med5 FROM g")
def running_median(spark, sf_dir):
    df = sig(spark, sf_dir).withColumn("v", F.when(F.col("k") >= 20, F.col("value")))
    return rounded(df.select("event_id", ordered.running_median(ordered.series(_KEYS, _SORD), "v", 5).alias("med5")))


@register("change_speed", f"WITH {SIG} SELECT event_id, round(value - lag(value) OVER w, 3) + 0.0 AS delta, round(CASE WHEN t - lag(t) OVER w > 0 THEN (value - lag(value) OVER w) / ((t - lag(t) OVER w) / 3600.0) END, 3) + 0.0 AS speed FROM sig {_SW}")
def change_speed(spark, sf_dir):
    df = sig(spark, sf_dir)
    w = ordered.series(_KEYS, _SORD)
    dt = F.col("t") - F.lag("t").over(w)
    change = F.col("value") - F.lag("value").over(w)
    delta, _ = ordered.change_speed(w, "value", "t")
    return df.select("event_id", (delta + 0.0).alias("delta"), (F.round(F.when(dt > 0, change / (F.when(dt > 0, dt) / 3600.0)), 3) + 0.0).alias("speed"))


@register("jitter_spikes", f"WITH {SIG}, m AS (SELECT event_type, median(value) AS med FROM sig GROUP BY 1) SELECT event_id, s.event_type, round(value, 6) + 0.0 AS value, value > 3 * med AS spike FROM sig s JOIN m USING (event_type)")
def jitter_spikes(spark, sf_dir):
    df = sig(spark, sf_dir)
    med = df.groupBy("event_type").agg(F.median("value").alias("med"))
    return rounded(df.join(F.broadcast(med), "event_type").select("event_id", "event_type", "value", (F.col("value") > 3 * F.col("med")).alias("spike")))


@register("jitter_heatmap", f"WITH {SIG} SELECT CAST(round_even(event_id / 10.0, 0) * 10 AS BIGINT) AS bin, event_type, round(median(value), 6) + 0.0 AS med FROM sig GROUP BY 1, 2")
def jitter_heatmap(spark, sf_dir):
    df = sig(spark, sf_dir)
    return rounded(df.groupBy((F.bround(F.col("event_id") / 10.0, 0) * 10).cast("bigint").alias("bin"), "event_type").agg(F.median("value").alias("med")))


@register("worst_keypoints", f"WITH {SIG} SELECT user_id, round(median(value), 6) + 0.0 AS med FROM sig GROUP BY 1 ORDER BY med DESC, user_id LIMIT 20")
def worst_keypoints(spark, sf_dir):
    found = rounded(sig(spark, sf_dir).groupBy("user_id").agg(F.median("value").alias("med")))
    return found.orderBy(F.desc("med"), "user_id").limit(20)


_RUNS = f"WITH {SIG}, c AS (SELECT *, event_type = 'error' AS s FROM sig), n AS (SELECT *, CASE WHEN s IS NOT DISTINCT FROM lag(s) OVER w THEN 0 ELSE 1 END AS new FROM c {_SW}), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM n), l AS (SELECT user_id, run, any_value(s) AS state, count(*) AS length FROM r GROUP BY 1, 2) "


@register("run_lengths", _RUNS + "SELECT user_id, CAST(run - 1 AS BIGINT) AS run, state, length FROM l")
def run_lengths(spark, sf_dir):
    return ordered.run_lengths(sig(spark, sf_dir), _KEYS, _SORD, F.col("event_type") == "error").select("user_id", F.col("run").cast("bigint").alias("run"), "state", "length")


@register("carry_streaks", _RUNS + "SELECT user_id, round(coalesce(avg(CASE WHEN state THEN length END), 0.0), 6) + 0.0 AS mean_streak FROM l GROUP BY user_id")
def carry_streaks(spark, sf_dir):
    return rounded(ordered.mean_true_run(sig(spark, sf_dir), _KEYS, _SORD, F.col("event_type") == "error"))


_MASKED = f"WITH {SIG}, m AS (SELECT *, CASE WHEN k >= 40 THEN value END AS v, row_number() OVER w AS pos FROM sig {_SW}) "


@register("fill_forward_back", _MASKED + "SELECT event_id, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) + 0.0 AS filled FROM m")
def fill_forward_back(spark, sf_dir):
    df = sig(spark, sf_dir).withColumn("v", F.when(F.col("k") >= 40, F.col("value")))
    return rounded(df.select("event_id", ordered.fill_forward_back(ordered.series(_KEYS, _SORD), "v").alias("filled")))


@register("fill_linear", _MASKED + ", n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS pa, last_value(v IGNORE NULLS) OVER a AS va, first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pb, first_value(v IGNORE NULLS) OVER b AS vb FROM m WINDOW a AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN pb > pa THEN va + (vb - va) * (pos - pa) / (pb - pa) END, 6) + 0.0 AS filled FROM n")
def fill_linear(spark, sf_dir):
    w = ordered.series(_KEYS, _SORD)
    df = sig(spark, sf_dir).withColumns({"v": F.when(F.col("k") >= 40, F.col("value")), "pos": F.row_number().over(w)})
    return rounded(df.select("event_id", ordered.fill_linear(w, "v", "pos").alias("filled")))


@register("frame_rates", f"WITH {SIG}, d AS (SELECT user_id, t - lag(t) OVER w AS d FROM sig {_SW}), p AS (SELECT user_id, median(CASE WHEN d > 0 THEN d END) AS m, count(*) AS n, median(abs(d)) AS s FROM d GROUP BY 1), r AS (SELECT d.user_id, avg(CASE WHEN d > 0 AND d <= 1.5 * m THEN d END) AS a FROM d JOIN p USING (user_id) GROUP BY 1) SELECT user_id, n, round(CASE WHEN n >= 4 AND s > 0 THEN 3600.0 / s END, 6) + 0.0 AS shipped, round(3600.0 / a, 6) + 0.0 AS robust FROM p JOIN r USING (user_id)")
def frame_rates(spark, sf_dir):
    df = sig(spark, sf_dir)
    a, b = ordered.frame_rate(df, _KEYS, _SORD), ordered.frame_rate(df, _KEYS, _SORD, robust=True)
    j = a.withColumnRenamed("fs", "shipped").join(b.select("user_id", F.col("fs").alias("robust")), "user_id")
    return rounded(j.withColumns({"shipped": F.col("shipped") * 3600.0, "robust": F.col("robust") * 3600.0}))


_D3 = lambda c: f"pow({c} - 3 * lag({c}, 1) OVER w + 3 * lag({c}, 2) OVER w - lag({c}, 3) OVER w, 2)"
_ENDS = " + ".join(f"pow(arg_max({c}, (day, l_orderkey, l_linenumber, l_partkey, y)) - arg_min({c}, (day, l_orderkey, l_linenumber, l_partkey, y)), 2)" for c in "xyz")


@register("smoothness", f"WITH {TRJ}, s AS (SELECT *, {_STEP} AS step, {_D3('x')} + {_D3('y')} + {_D3('z')} AS jerk FROM trj {_TW}), a AS (SELECT l_suppkey, count(*) AS n, sum(step) AS path, sum(jerk) AS jerk, sqrt({_ENDS}) AS straight FROM s GROUP BY 1) SELECT l_suppkey, n, round(path, 4) + 0.0 AS path, round(straight, 4) + 0.0 AS straight, round(CASE WHEN n >= 2 AND straight > 1e-10 THEN path / straight END, 4) + 0.0 AS efficiency, round(CASE WHEN n >= 5 AND path >= 1e-10 THEN sqrt(pow(n - 1, 5) / (2 * pow(path, 2)) * jerk) END, 2) + 0.0 AS normalized_jerk FROM a")
def smoothness(spark, sf_dir):
    found = ordered.smoothness(trj(spark, sf_dir).withColumn("fs", F.lit(1.0)), ["l_suppkey"], ORDER, "fs")
    return found.select("l_suppkey", "n", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("path", 4), ("straight", 4), ("efficiency", 4), ("normalized_jerk", 2))])


@register("unit_range_qa", f"WITH {TRJ}, s AS (SELECT l_suppkey, l_orderkey AS frame, x / 50 AS x, y / 60 AS y, z AS confidence, l_orderkey - lag(l_orderkey) OVER w AS f, sqrt(pow(x / 50 - lag(x / 50) OVER w, 2) + pow(y / 60 - lag(y / 60) OVER w, 2)) AS st FROM (SELECT *, y AS yy FROM trj) q WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, yy)) SELECT l_suppkey, count(DISTINCT frame) AS frames, count(*) FILTER (f > 1) AS index_gaps, round(100 * avg(CASE WHEN x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 THEN 0 ELSE 1 END), 6) + 0.0 AS pct_outside, round(median(CASE WHEN confidence > 0 THEN confidence END), 6) + 0.0 AS median_confidence, round(avg(CASE WHEN confidence > 0 THEN 1 ELSE 0 END), 6) + 0.0 AS observation_rate FROM s GROUP BY 1")
def unit_range_qa(spark, sf_dir):
    df = trj(spark, sf_dir).select("l_suppkey", F.col("l_orderkey").alias("frame"), F.lit(0.0).alias("t"), (F.col("x") / 50).alias("x"), (F.col("y") / 60).alias("y"), F.col("z").alias("confidence"))
    found = aggregate.coverage_qa(df, ["l_suppkey"])
    return rounded(found.select("l_suppkey", "frames", "index_gaps", "pct_outside", "median_confidence", "observation_rate"))


@register("key_trajectory", f"WITH {KPT} SELECT vec_id, u.keypoint, u.axis, round(u.value, 6) + 0.0 AS value FROM kpt, LATERAL (VALUES ('p0', 'x', p0_x), ('p0', 'y', p0_y), ('p4', 'x', p4_x), ('p4', 'y', p4_y), ('p5', 'x', p5_x), ('p5', 'y', p5_y)) AS u(keypoint, axis, value) WHERE u.value IS NOT NULL")
def key_trajectory(spark, sf_dir):
    long = tables.longer(kpt(spark, sf_dir), ["vec_id"], [f"p{i}_{c}" for i in (0, 4, 5) for c in "xy"]).where("value is not null")
    parts = F.split("feature", "_")
    return rounded(long.select("vec_id", F.get(parts, F.lit(0)).alias("keypoint"), F.get(parts, F.lit(1)).alias("axis"), "value"))


@register("timeline_status", f"WITH {SIG} SELECT event_id, CASE WHEN event_type = 'error' THEN 'carried' WHEN k > 50 THEN 'detected' ELSE 'missing' END AS status FROM sig")
def timeline_status(spark, sf_dir):
    return sig(spark, sf_dir).select("event_id", ordered.timeline_status(F.col("k") > 50, F.col("event_type") == "error").alias("status"))
