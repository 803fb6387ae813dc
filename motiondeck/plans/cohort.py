"""Queries of score and session joins, reshapes, geometry kernels and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from motiondeck.catalog import register
from motiondeck.functions import geometry as g
from motiondeck.functions import text
from motiondeck.operators import aggregate, gates, matching, ordered, tables
from motiondeck.plans.proxies import KPT, ORDER, SES, SIG, TRJ, TRJ_ORDER, kpt, rounded, ses, sig, table, trj
from motiondeck.sources import schema


def _r(e: str, name: str, digits: int = 6) -> str:
    return f"round({e}, {digits}) + 0.0 AS {name}"


_RECORDING = "rec AS (SELECT user_id, avg(value) AS value__mean, stddev_samp(value) AS value__sd, avg(k) AS k__mean, 1.0 AS still__mean FROM sig GROUP BY 1)"


def _recordings(spark, sf_dir):
    return sig(spark, sf_dir).groupBy("user_id").agg(F.avg("value").alias("value__mean"), F.stddev_samp("value").alias("value__sd"), F.avg("k").alias("k__mean"), F.lit(1.0).alias("still__mean"))


@register("scores_join", f"WITH {SIG}, {_RECORDING} SELECT user_id, " + ", ".join(_r(c, c) for c in ("value__mean", "value__sd", "k__mean", "c_acctbal")) + " FROM rec JOIN customer ON user_id = c_custkey")
def scores_join(spark, sf_dir):
    """A user's features with the score of the customer of that number; the feature that never varies goes."""
    scores = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    joined, varies = tables.scored(_recordings(spark, sf_dir), scores, "user_id", ["c_acctbal"])
    return rounded(joined.select("user_id", *varies, "c_acctbal"))


@register("longitudinal_table", f"""WITH {SES}, f AS (SELECT l_orderkey AS session, avg(l_quantity) AS quantity, avg(l_extendedprice) AS price FROM lineitem GROUP BY 1),
j AS (SELECT patient, session_date, session, unnest(['quantity', 'price']) AS feature, unnest([quantity, price]) AS value FROM f JOIN ses USING (session))
SELECT patient, session_date, session, feature, {_r('value', 'value')}, CAST(row_number() OVER (PARTITION BY patient, feature ORDER BY session_date, session) AS INT) AS position FROM j""")
def longitudinal_table(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price"))
    joined = tables.dated(f, ses(spark, sf_dir), "session", "patient", "session_date")
    return rounded(tables.longitudinal(tables.longer(joined, ["patient", "session_date", "session"], ["quantity", "price"]), "patient", "session_date", "session"))


@register("score_sessions", f"WITH {SES}, l AS (SELECT c_custkey AS patient, unnest(['balance', 'nation']) AS score_name, unnest([c_acctbal, CAST(c_nationkey AS DOUBLE)]) AS score_value FROM customer) SELECT patient, score_name, {_r('score_value', 'score_value')}, session, session_date FROM l JOIN ses USING (patient)")
def score_sessions(spark, sf_dir):
    scores = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("patient"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    long = tables.longer(scores, ["patient"], ["balance", "nation"]).withColumnsRenamed({"feature": "score_name", "value": "score_value"})
    return rounded(tables.dated(long, ses(spark, sf_dir).select("patient", "session", "session_date"), "patient", "session", "session_date"))


_NAMES = [f"p{i}_{c}" for i in range(1, 21) for c in "xyz"]


@register("top_correlations", f"WITH {KPT}, c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, 'p0_{c}' AS score, corr({n}, p0_{c}) AS rho FROM kpt" for n in _NAMES for c in "xyz") + f") SELECT feature, score, {_r('rho', 'rho')} FROM c WHERE rho IS NOT NULL ORDER BY abs(rho) DESC, feature, score LIMIT 10")
def top_correlations(spark, sf_dir):
    """The ten strongest correlations of points with the first one, out of one aggregate."""
    cells = [F.struct(F.lit(n).alias("feature"), F.lit(f"p0_{c}").alias("score"), F.corr(n, f"p0_{c}").alias("rho")) for n in _NAMES for c in "xyz"]
    found = kpt(spark, sf_dir).agg(F.array(*cells).alias("all")).select(F.inline("all"))
    return rounded(tables.top_pairs(found))


@register("stacked_tables", "SELECT 'c' AS kind, c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL AS size FROM customer UNION ALL SELECT 's', s_suppkey, s_name, s_acctbal, NULL FROM supplier UNION ALL SELECT 'p', p_partkey, p_name, NULL, p_size FROM part")
def stacked_tables(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    p = table(spark, sf_dir, "part").select(F.lit("p").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return tables.stacked([c, s, p])


@register("recoded_parts", "SELECT CASE event_type WHEN 'click' THEN 'Left hand' WHEN 'view' THEN 'Right hand' ELSE event_type END AS part, count(*) AS n FROM events GROUP BY 1")
def recoded_parts(spark, sf_dir):
    label = tables.recode(F.col("event_type"), {"click": "Left hand", "view": "Right hand"})
    return table(spark, sf_dir, "events").groupBy(label.alias("part")).agg(F.count("*").alias("n"))


#: Bones of the vectors' points, in the names of either scheme.
_BONES = [("left_upper_arm", "p0", "p1"), ("right_upper_arm", "p2", "p3"), ("left_forearm", "p1", "p4"), ("right_forearm", "p3", "p5"), ("body_left_forearm", "p6", "p7"), ("body_right_forearm", "p8", "p9"), ("body_left_thigh", "p10", "p11"), ("body_right_thigh", "p12", "p13")]


def _length(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"pow({a}_{c} - {b}_{c}, 2)" for c in "xyz") + ")"


def _rel(left: int, right: int) -> str:
    one, two = _length(*_BONES[left][1:]), _length(*_BONES[right][1:])
    return f"avg(abs({one} - {two}) / (({one} + {two}) / 2))"


@register("symmetry_by_bone", f"WITH {KPT}" + " UNION ALL ".join(f" SELECT label AS grp, '{bone}' AS bone, {_r(_rel(a, b), 'rel_diff')} FROM kpt GROUP BY label" for bone, a, b in (("upper_arm", 0, 1), ("forearm", 4, 5), ("thigh", 6, 7))))
def symmetry_by_bone(spark, sf_dir):
    cells = F.array(*[F.struct(F.lit(f"p{i}").alias("keypoint"), *[F.col(f"p{i}_{c}").alias(c) for c in "xyz"]) for i in range(14)])
    long = kpt(spark, sf_dir).select(F.col("label").alias("grp"), "vec_id", F.inline(cells))
    return rounded(tables.symmetry_by_bone(tables.bone_lengths(long, _BONES, ["grp", "vec_id"]), ["grp"], "vec_id"))


@register("world_frames", f"""WITH {SIG}, u AS (SELECT user_id, event_id, k AS frame, user_id % 80 AS expected FROM sig WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY event_id DESC) = 1),
b AS (SELECT user_id, count(*) FILTER (frame >= 0 AND frame < expected) AS n0, count(*) FILTER (frame >= 1 AND frame < expected + 1) AS n1, count(*) FILTER (frame = 0) AS z FROM u GROUP BY 1),
c AS (SELECT *, CASE WHEN n0 > n1 THEN 0 WHEN n1 > n0 THEN 1 WHEN z > 0 THEN 0 ELSE 1 END AS base FROM b) SELECT user_id, event_id, frame FROM u JOIN c USING (user_id) WHERE expected <= 0 OR frame >= base AND frame < expected + base""")
def world_frames(spark, sf_dir):
    df = sig(spark, sf_dir).where("k is not null").select("user_id", "event_id", F.col("k").alias("frame"), (F.col("user_id") % 80).alias("expected"))
    return tables.world_frames(df, ["user_id"], "frame", "event_id", "expected").drop("expected")


@register("fusable_frames", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, list_reverse_sort(list(n))[2] AS expected FROM c GROUP BY 1")
def fusable_frames(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return tables.fusable_frames(counts, ["user_id"], "n")


@register("shared_corners", "WITH d AS (SELECT DISTINCT l_suppkey AS session, year(l_shipdate) * 12 + month(l_shipdate) AS frame, CAST(round(l_discount * 100) AS INT) AS corner, l_returnflag AS camera FROM lineitem) SELECT session, CAST(frame AS INT) AS frame, a.camera AS camera_a, b.camera AS camera_b, count(*) AS shared FROM d a JOIN d b USING (session, frame, corner) WHERE a.camera < b.camera GROUP BY ALL HAVING count(*) >= 2")
def shared_corners(spark, sf_dir):
    """Months of a supplier in which two return flags share discounts."""
    frame = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("frame")
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("session"), frame, F.round(F.col("l_discount") * 100).cast("int").alias("corner"), F.col("l_returnflag").alias("camera")).distinct()
    return tables.shared_corners(seen, least=2)


@register("wrist_hand_pairs", f"""WITH {KPT}, w AS (SELECT label, vec_id, unnest([0, 1]) AS wrist_id, unnest([p0_x, p1_x]) AS wx, unnest([p0_y, p1_y]) AS wy, (p4_x + p5_x) / 2 AS mx, (p4_y + p5_y) / 2 AS my FROM kpt),
h AS (SELECT vec_id, unnest([0, 1]) AS hand_id, unnest([p2_x, p3_x]) AS hx, unnest([p2_y, p3_y]) AS hy FROM kpt), c AS (SELECT vec_id, wrist_id, hand_id, sqrt(pow(wx - hx, 2) + pow(wy - hy, 2)) AS cost, sqrt(pow(mx - hx, 2) + pow(my - hy, 2)) AS middle FROM w JOIN h USING (vec_id))
SELECT vec_id, wrist_id, hand_id, {_r('cost', 'cost')} FROM c WHERE cost < 0.3 AND cost < middle""")
def wrist_hand_pairs(spark, sf_dir):
    k = kpt(spark, sf_dir)
    at = lambda key, a, b, i: F.struct(F.lit(i).alias(key), F.col(f"p{a}_x").alias(f"{b}x"), F.col(f"p{a}_y").alias(f"{b}y"))
    mid = [((F.col(f"p4_{c}") + F.col(f"p5_{c}")) / 2).alias(f"mid_{c}") for c in "xy"]
    wrists = k.select("vec_id", *mid, F.inline(F.array(at("wrist_id", 0, "w", 0), at("wrist_id", 1, "w", 1))))
    hands = k.select("vec_id", F.inline(F.array(at("hand_id", 2, "h", 0), at("hand_id", 3, "h", 1))))
    return rounded(matching.hand_candidates(wrists, hands, ["vec_id"], reach=0.3).select("vec_id", "wrist_id", "hand_id", "cost"))


@register("hand_confidences", "WITH s AS (SELECT vec_id, list_transform(embedding[1:42], lambda x: abs(CAST(x AS DOUBLE)) * 12) AS s FROM embeddings), h AS (SELECT vec_id, unnest(['left', 'right']) AS side, unnest([s[1:21], s[22:42]]) AS v FROM s) SELECT vec_id, side, round(list_sum(list_transform(v, lambda x: least(1.0, x))), 6) + 0.0 AS total, len(list_filter(v, lambda x: x >= 1)) AS n_full FROM h WHERE list_sum(v) / 21 > 0.1")
def hand_confidences(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 42), lambda x: F.abs(x.cast("double")) * 12).alias("s"))
    known = F.transform("s", lambda x: F.lit(True))
    hands = F.array(*[F.struct(F.lit(side).alias("side"), tables.hand_confidences(F.col("s"), known, start).alias("v")) for side, start in (("left", 0), ("right", 21))])
    found = e.select("vec_id", F.inline(hands)).where("v is not null")
    return rounded(found.select("vec_id", "side", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size(F.filter("v", lambda x: x >= 1)).cast("bigint").alias("n_full")))


@register("remapped_points", "SELECT vec_id, round(list_sum(list_transform([1, 6, 3, 8, 64], lambda i, j: j * CAST(embedding[i] AS DOUBLE))), 6) + 0.0 AS weighted FROM embeddings")
def remapped_points(spark, sf_dir):
    picked = tables.remap_points(F.col("embedding"), [0, 5, 2, 7, 63])
    total = sum((i + 1) * F.get("p", F.lit(i)).cast("double") for i in range(5))
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", picked.alias("p")).select("vec_id", total.alias("weighted")))


_SIDE = {c: (f"CASE WHEN vec_id % 3 <> 0 THEN p0_{c} END", f"CASE WHEN vec_id % 5 <> 0 THEN p1_{c} END") for c in "xy"}


@register("body_anchor", f"WITH {KPT} SELECT vec_id, " + ", ".join(_r(f"coalesce(({a} + {b}) / 2, {a}, {b}, p2_{c})", c) for c, (a, b) in _SIDE.items()) + " FROM kpt")
def body_anchor(spark, sf_dir):
    side = lambda i, m: tuple(F.when(F.col("vec_id") % m != 0, F.col(f"p{i}_{c}")) for c in "xy")
    x, y = g.body_anchor(side(0, 3), side(1, 5), (F.col("p2_x"), F.col("p2_y")))
    return rounded(kpt(spark, sf_dir).select("vec_id", x.alias("x"), y.alias("y")))


@register("curve_kernels", f"WITH {KPT} SELECT vec_id, {_r('1 / (1 + exp(-p0_x * 20))', 'gate')}, {_r('10 * pow(abs(p0_y), 3) - 15 * pow(abs(p0_y), 4) + 6 * pow(abs(p0_y), 5)', 'reach')}, {_r('0.5 * (2 * p1_x + (p2_x - p0_x) * abs(p0_z) + (2 * p0_x - 5 * p1_x + 4 * p2_x - p3_x) * pow(p0_z, 2) + (3 * p1_x - p0_x - 3 * p2_x + p3_x) * pow(abs(p0_z), 3))', 'spline')}, {_r('CASE WHEN p4_x * 1000 BETWEEN 1 AND 240 THEN p4_x * 1000 ELSE 30 END', 'fps')} FROM kpt")
def curve_kernels(spark, sf_dir):
    c = F.col
    return rounded(kpt(spark, sf_dir).select("vec_id", g.sigmoid(c("p0_x") * 20).alias("gate"), g.minimum_jerk(F.abs("p0_y")).alias("reach"), g.catmull_rom([c(f"p{i}_x") for i in range(4)], F.abs("p0_z")).alias("spline"), g.safe_fps(c("p4_x") * 1000).alias("fps")))


@register("crop_mapping", f"WITH {KPT} SELECT vec_id, {_r('(p0_x * 256 - 8) / 0.5', 'x')}, {_r('(p0_y * 256 - 4) / 0.5', 'y')}, {_r('p1_x + (p0_x - 0.5) * 90 * cos(p2_x) - (p0_y - 0.5) * 90 * sin(p2_x)', 'u')}, {_r('p1_y + (p0_x - 0.5) * 90 * sin(p2_x) + (p0_y - 0.5) * 90 * cos(p2_x)', 'v')}, {_r('(vec_id % 16 + 0.5) / 16 + p3_x / 192', 'cx')}, {_r('(vec_id % 9 + 0.5) / 16 + p3_y / 192', 'cy')}, {_r('1 / (1 + exp(-p4_x))', 'score')} FROM kpt")
def crop_mapping(spark, sf_dir):
    c = F.col
    x, y = g.unletterbox(c("p0_x") * 256, c("p0_y") * 256, F.lit(0.5), F.lit(8.0), F.lit(4.0))
    u, v = g.rotated_crop_to_image(c("p0_x") * 224, c("p0_y") * 224, (c("p1_x"), c("p1_y")), F.lit(90.0), c("p2_x"), 224.0)
    cx, cy, score = g.anchor_box(c("vec_id") % 16, c("vec_id") % 9, 16, c("p3_x"), c("p3_y"), 192.0, c("p4_x"))
    return rounded(kpt(spark, sf_dir).select("vec_id", x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v"), cx.alias("cx"), cy.alias("cy"), score.alias("score")))


@register("joint_clamp", f"""WITH {KPT}, a AS (SELECT *, p0_x - p1_x AS ax, p0_y - p1_y AS ay, p2_x - p1_x AS bx, p2_y - p1_y AS v FROM kpt), d AS (SELECT *, degrees(atan2(ax * v - ay * bx, ax * bx + ay * v)) AS angle FROM a),
t AS (SELECT *, least(120.0, greatest(30.0, abs(angle))) AS wanted FROM d), r AS (SELECT *, abs(wanted - abs(angle)) >= 1e-12 AS hit, radians((CASE WHEN angle >= 0 THEN 1 ELSE -1 END) * wanted - angle) AS turn FROM t)
SELECT vec_id, CAST(hit AS INT) AS clamps, {_r('CASE WHEN hit THEN p1_x + cos(turn) * bx - sin(turn) * v ELSE p2_x END', 'x')}, {_r('CASE WHEN hit THEN p1_y + sin(turn) * bx + cos(turn) * v ELSE p2_y END', 'y')} FROM r""")
def joint_clamp(spark, sf_dir):
    """Three points of each vector with the angle at the middle one held between 30 and 120 degrees."""
    pts = F.array(*[F.struct(*[F.col(f"p{i}_{c}").alias(c) for c in "xyz"]) for i in range(3)])
    found = matching.clamp_joints(kpt(spark, sf_dir).select("vec_id", pts.alias("points")), "points", [(0, 1, 2, [2], 30.0, 120.0)])
    last = F.get("points", F.lit(2))
    return rounded(found.select("vec_id", "clamps", last["x"].alias("x"), last["y"].alias("y")))


@register("weighted_centroid", f"WITH {SIG} SELECT user_id, event_type, {_r('coalesce(sum(value * (k // 50)) / nullif(sum(k // 50), 0), avg(value))', 'centre')} FROM sig GROUP BY 1, 2")
def weighted_centroid(spark, sf_dir):
    df = sig(spark, sf_dir).withColumn("w", F.floor(F.col("k") / 50))
    return rounded(df.groupBy("user_id", "event_type").agg(aggregate.weighted_centroid("value", "w").alias("centre")))


@register("latency_summary", f"SELECT {_r('avg(value) FILTER (event_id < 3)', 'warmup_mean_ms')}, {_r('avg(value) FILTER (event_id >= 3)', 'mean_ms')}, {_r('median(value) FILTER (event_id >= 3)', 'median_ms')}, {_r('quantile_cont(value, 0.95) FILTER (event_id >= 3)', 'p95_ms')}, {_r('1000.0 / avg(value) FILTER (event_id >= 3)', 'fps')} FROM events")
def latency_summary(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("value").alias("latency_ms"))
    return rounded(aggregate.latency_summary(df))


@register("baseline_agreement", f"WITH m AS (SELECT event_type AS metric, avg(value) AS value FROM events WHERE event_type <> 'view' GROUP BY 1), b AS (SELECT event_type AS metric, median(value) AS expected FROM events GROUP BY 1) SELECT b.metric, {_r('expected', 'expected')}, {_r('value', 'value')}, {_r('abs(value - expected)', 'abs_error')} FROM b LEFT JOIN m ON b.metric = m.metric")
def baseline_agreement(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "metric")
    measured = e.where("metric <> 'view'").groupBy("metric").agg(F.avg("value").alias("value"))
    return rounded(tables.baseline_agreement(measured, e.groupBy("metric").agg(F.median("value").alias("value"))))


@register("enough_values", f"WITH {SIG}, v AS (SELECT user_id, event_id, CASE WHEN k >= 90 THEN value END AS value FROM sig) SELECT user_id, event_id, {_r('value', 'value')} FROM v QUALIFY count(value) OVER (PARTITION BY user_id) >= 6")
def enough_values(spark, sf_dir):
    df = sig(spark, sf_dir).select("user_id", "event_id", F.when(F.col("k") >= 90, F.col("value")).alias("value"))
    return rounded(tables.enough_values(df, "user_id", "value", least=6))


@register("scope_and_age", f"WITH {SIG} SELECT event_id, {_r('CASE WHEN user_id IN (1, 2, 3, 5, 8) THEN value ELSE 0 END', 'score')} FROM sig WHERE k >= greatest(1, floor(30.0 * (user_id % 20 + 1) * 0.1))")
def scope_and_age(spark, sf_dir):
    """Scores of the tracked set, in tracks (of age k) that are old enough for their frame rate."""
    df = sig(spark, sf_dir).withColumn("score", gates.in_scope(F.col("value"), F.col("user_id"), [1, 2, 3, 5, 8]))
    return rounded(gates.older_than(df, F.lit(30.0) * (F.col("user_id") % 20 + 1), "k").select("event_id", "score"))


@register("spaced_events", f"""WITH {SIG}, r AS (SELECT event_id, row_number() OVER (ORDER BY t, event_id) - 1 AS r, count(*) OVER () AS n FROM sig),
w AS (SELECT DISTINCT CAST(round_even(i * (n - 1) / 199.0, 0) AS BIGINT) AS r FROM (SELECT count(*) AS n FROM sig), LATERAL (SELECT unnest(generate_series(0, 199)) AS i)) SELECT event_id FROM r JOIN w USING (r)""")
def spaced_events(spark, sf_dir):
    """Two hundred events spread evenly over all of them by time."""
    return tables.evenly(sig(spark, sf_dir), ["t", "event_id"], 200, F.floor(F.col("t") / 3600)).select("event_id")


_NAME = "CASE WHEN k % 3 = 0 THEN 'left_hand_' || k || '_x' WHEN k % 3 = 1 THEN 'body_' || event_type || '_vis' ELSE 'other' || k END"


@register("name_parts", f"WITH {SIG}, n AS (SELECT DISTINCT {_NAME} AS name FROM sig WHERE k IS NOT NULL) SELECT name, CASE WHEN name LIKE 'left_hand%' THEN 'left_hand' WHEN name LIKE 'body%' THEN 'body' ELSE '' END AS part, regexp_extract(name, '^(left_hand|body)_(.+)_(x|vis)$', 2) AS keypoint, regexp_extract(name, '_(x|vis)$', 1) AS coord, CASE WHEN name LIKE 'left%' THEN 'left' ELSE 'both' END AS side, regexp_replace(name, '^left_', '') AS feature FROM n")
def name_parts(spark, sf_dir):
    k = F.col("k")
    name = F.when(k % 3 == 0, F.concat(F.lit("left_hand_"), k, F.lit("_x"))).when(k % 3 == 1, F.concat(F.lit("body_"), "event_type", F.lit("_vis"))).otherwise(F.concat(F.lit("other"), k))
    df = sig(spark, sf_dir).where("k is not null").select(name.alias("name")).distinct()
    return df.select("name", schema.feature_name_parts(F.col("name")).alias("p"), text.side_and_feature(F.col("name")).alias("s")).select("name", "p.*", "s.*")


@register("keypoint_labels", f"WITH {SIG} SELECT event_type, k, CASE WHEN event_type = 'click' AND k < {len(schema.BODY_KEYPOINTS)} THEN [" + ", ".join(f"'{n}'" for n in schema.BODY_KEYPOINTS) + "][k + 1] WHEN event_type = 'click' THEN 'body_' || k ELSE event_type || '_' || k END AS label, count(*) AS n FROM sig WHERE k IS NOT NULL GROUP BY ALL")
def keypoint_labels(spark, sf_dir):
    part = tables.recode(F.col("event_type"), {"click": "body"})
    df = sig(spark, sf_dir).where("k is not null").withColumn("label", schema.keypoint_label(part, F.col("k"), "body"))
    return df.groupBy("event_type", "k", "label").agg(F.count("*").alias("n"))


_MOVED = " + ".join(f"sqrt(pow(p{i}_x - lag(p{i}_x) OVER w, 2) + pow(p{i}_y - lag(p{i}_y) OVER w, 2))" for i in range(21))


@register("point_jitter", f"WITH {KPT} SELECT label, vec_id, {_r(_MOVED, 'jitter_px', 2)} FROM kpt WINDOW w AS (PARTITION BY label ORDER BY vec_id)")
def point_jitter(spark, sf_dir):
    """The summed distance of all points of a vector to those of the one before."""
    pts = F.array(*[F.struct(F.col(f"p{i}_x").alias("x"), F.col(f"p{i}_y").alias("y")) for i in range(21)])
    return rounded(ordered.jitter(kpt(spark, sf_dir).select("label", "vec_id", pts.alias("points")), ["label"], ["vec_id"]).select("label", "vec_id", "jitter_px"), 2)


@register("smoothing_change", f"WITH {KPT} SELECT vec_id, {_r('sqrt(pow(p0_x - p1_x, 2) + pow(p0_y - p1_y, 2)) + sqrt(pow(p2_x - p3_x, 2) + pow(p2_y - p3_y, 2))', 'change')} FROM kpt WHERE vec_id % 4 <> 0 UNION ALL SELECT vec_id, 0.0 FROM embeddings WHERE vec_id % 4 = 0")
def smoothing_change(spark, sf_dir):
    at = lambda i: F.struct(F.col(f"p{i}_x").alias("x"), F.col(f"p{i}_y").alias("y"))
    smooth = F.when(F.col("vec_id") % 4 != 0, F.array(at(1), at(3))).otherwise(F.array(at(1)))
    return rounded(kpt(spark, sf_dir).select("vec_id", ordered.smoothing_change(F.array(at(0), at(2)), smooth).alias("change")))


@register("jitter_of_trajectories", f"WITH {TRJ}, o AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey {TRJ_ORDER}) AS i FROM trj), s AS (SELECT l_suppkey, CASE WHEN lag(i, 2) OVER w = i - 2 THEN sqrt(" + " + ".join(f"pow({c} - 2 * lag({c}) OVER w + lag({c}, 2) OVER w, 2)" for c in "xyz") + f") END AS s FROM o WHERE i % 11 <> 0 WINDOW w AS (PARTITION BY l_suppkey ORDER BY i)) SELECT l_suppkey, {_r('1000 * median(s)', 'jitter_mm', 3)} FROM s GROUP BY 1")
def jitter_of_trajectories(spark, sf_dir):
    """The median second difference of a trajectory, over three frames in a row."""
    df = trj(spark, sf_dir).withColumn("i", F.row_number().over(ordered.series(["l_suppkey"], ORDER))).where("i % 11 <> 0")
    return rounded(aggregate.temporal_jitter_mm(df, ["l_suppkey"], "i"), 3)
