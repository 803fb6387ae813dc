"""Queries of grids, sliding windows, quality evidence and movements.

A user's events are sampled at a rate of one in six hours; windows are a day long, half a day apart.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from motiondeck.catalog import register
from motiondeck.functions import geometry as g
from motiondeck.operators import grid, ordered, phases
from motiondeck.plans.proxies import ORDER, SIG, TRJ, TRJ_ORDER, rounded, sig, trj

DAY = 86400.0
FS = 1 / 900.0
_KEYS = ["user_id", "window_idx"]

_WIN = f"""{SIG}, b AS (SELECT user_id, min(t) AS t0, max(t) AS t1 FROM sig GROUP BY 1),
k AS (SELECT user_id, t0, i AS window_idx, t0 + i * 43200.0 AS window_start, t0 + i * 43200.0 + 86400.0 AS window_end FROM b, LATERAL (SELECT unnest(generate_series(0, CAST(floor((t1 - t0 - 86400.0) / 43200.0 + 1e-10) AS BIGINT))) AS i) WHERE t1 - t0 >= 86400.0),
win AS (SELECT s.*, k.window_idx, k.window_start, k.window_end, k.t0 FROM sig s JOIN k ON s.user_id = k.user_id AND s.t >= k.window_start AND s.t < k.window_end)"""


def windows(spark, sf_dir):
    return grid.sliding_windows(sig(spark, sf_dir), ["user_id"], DAY)


@register("sliding_windows", f"WITH {_WIN} SELECT user_id, CAST(window_idx AS BIGINT) AS window_idx, round(any_value(window_start - t0), 4) + 0.0 AS start_after, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS sd, round(max(value) - min(value), 6) + 0.0 AS value_range FROM win GROUP BY user_id, window_idx HAVING count(*) >= 4")
def sliding_windows(spark, sf_dir):
    df = windows(spark, sf_dir)
    found = df.groupBy(*_KEYS).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), (F.max("value") - F.min("value")).alias("value_range"))
    return rounded(found.where("n >= 4").select("user_id", "window_idx", (F.col("window_idx") * (DAY / 2)).alias("start_after"), "n", "mean", "sd", "value_range"))


@register("window_bilateral", f"WITH {_WIN}, m AS (SELECT user_id, window_idx, avg(value) FILTER (event_type = 'click') AS l, avg(value) FILTER (event_type = 'view') AS r FROM win GROUP BY 1, 2) SELECT user_id, CAST(window_idx AS BIGINT) AS window_idx, round(CASE WHEN abs(l) + abs(r) > 1e-12 THEN least(abs(l), abs(r)) / greatest(abs(l), abs(r)) END, 6) + 0.0 AS symmetry_ratio, round(CASE WHEN abs(l) + abs(r) > 1e-12 THEN (abs(r) - abs(l)) / (abs(l) + abs(r)) END, 6) + 0.0 AS dominance_index, round(abs(r - l), 6) + 0.0 AS abs_diff FROM m")
def window_bilateral(spark, sf_dir):
    side = lambda v: F.avg(F.when(F.col("event_type") == v, F.col("value")))
    df = windows(spark, sf_dir).groupBy(*_KEYS).agg(side("click").alias("l"), side("view").alias("r"))
    return rounded(df.select(*_KEYS, *[c.alias(n) for n, c in g.bilateral(F.col("l"), F.col("r")).items()]))


_SLOT = f"""{SIG}, f AS (SELECT user_id, min(t) AS t0 FROM sig GROUP BY 1), c AS (SELECT s.user_id, CAST(round_even((s.t - f.t0) / 21600.0, 0) AS BIGINT) AS slot, max(k) AS k, count(*) AS n FROM sig s JOIN f USING (user_id) GROUP BY 1, 2),
e AS (SELECT user_id, unnest(generate_series(0, max(slot))) AS slot FROM c GROUP BY user_id), v AS (SELECT e.user_id, e.slot, coalesce(k >= 20, false) AS ok FROM e LEFT JOIN c USING (user_id, slot)),
r AS (SELECT *, slot - row_number() OVER (PARTITION BY user_id, ok ORDER BY slot) AS run, ok AND coalesce(lag(ok) OVER (PARTITION BY user_id ORDER BY slot), false) AS pair FROM v),
q AS (SELECT user_id, run, count(*) AS len FROM r WHERE NOT ok GROUP BY 1, 2), gq AS (SELECT user_id, max(len) AS longest, count(*) AS gaps FROM q GROUP BY 1)"""


@register("slot_grid_evidence", f"WITH {_SLOT} SELECT user_id, count(*) AS n_expected_frames, count(*) FILTER (ok) AS n_valid_frames, count(*) - 1 AS n_expected_intervals, count(*) FILTER (pair) AS n_valid_intervals, coalesce(any_value(longest), 0) AS longest_gap_frames, coalesce(any_value(gaps), 0) AS n_gaps, round(count(*) FILTER (pair) * 6.0, 6) + 0.0 AS valid_hours FROM r LEFT JOIN gq USING (user_id) GROUP BY user_id")
def slot_grid_evidence(spark, sf_dir):
    df = sig(spark, sf_dir)
    first = df.groupBy("user_id").agg(F.min("t").alias("t0"))
    slots = df.join(first, "user_id").withColumn("slot", grid.half_even((F.col("t") - F.col("t0")) / 21600.0)).groupBy("user_id", "slot").agg(F.max("k").alias("k")).withColumn("fs", F.lit(1 / 6.0))
    found = grid.evidence(slots, ["user_id"], F.col("k") >= 20)
    return rounded(found.select("user_id", "n_expected_frames", "n_valid_frames", "n_expected_intervals", "n_valid_intervals", "longest_gap_frames", "n_gaps", F.col("valid_duration_sec").alias("valid_hours")))


def _on_quarter_hours(spark, sf_dir):
    """Windows with their rows on quarter hours, one row a slot, and a rate."""
    df = windows(spark, sf_dir)
    lead, trail = F.col("window_start"), F.col("window_end")
    df = df.withColumn("slot", grid.half_even((F.col("t") - lead) * (4 / 3600.0) / 8)).withColumn("last", grid.half_even((trail - lead) * (4 / 3600.0) / 8) - 1)
    slots = df.where("slot <= last").groupBy(*_KEYS, "last", "slot").agg(F.max("k").alias("k"), F.avg("value").alias("value"), F.count("*").alias("rows"))
    return slots.withColumn("fs", F.lit(0.5))


_QC = f"""WITH {_WIN}, c AS (SELECT user_id, window_idx, CAST(round_even((t - window_start) * (4 / 3600.0) / 8, 0) AS BIGINT) AS slot, CAST(round_even(86400.0 * (4 / 3600.0) / 8, 0) AS BIGINT) - 1 AS last, k, value FROM win),
s AS (SELECT user_id, window_idx, last, slot, max(k) AS k, avg(value) AS value FROM c WHERE slot <= last GROUP BY 1, 2, 3, 4),
e AS (SELECT user_id, window_idx, last, unnest(generate_series(0, last)) AS slot FROM s GROUP BY 1, 2, 3), v AS (SELECT e.*, coalesce(k >= 10, false) AS ok FROM e LEFT JOIN s USING (user_id, window_idx, last, slot)),
r AS (SELECT *, slot - row_number() OVER (PARTITION BY user_id, window_idx, ok ORDER BY slot) AS run, ok AND coalesce(lag(ok) OVER (PARTITION BY user_id, window_idx ORDER BY slot), false) AS pair FROM v),
q AS (SELECT user_id, window_idx, max(len) AS longest FROM (SELECT user_id, window_idx, run, count(*) AS len FROM r WHERE NOT ok GROUP BY 1, 2, 3) GROUP BY 1, 2),
a AS (SELECT user_id, window_idx, count(*) AS exp, count(*) FILTER (ok) AS valid, count(*) FILTER (pair) AS ints, coalesce(any_value(longest), 0) AS longest FROM r LEFT JOIN q USING (user_id, window_idx) GROUP BY 1, 2),
est AS (SELECT user_id, window_idx, stddev_samp(value) FILTER (k >= 10) AS estimate FROM s GROUP BY 1, 2)
SELECT user_id, CAST(window_idx AS BIGINT) AS window_idx, exp AS n_expected_frames, valid AS n_valid_frames, round(valid / exp, 6) + 0.0 AS frame_coverage, ints AS n_valid_intervals, longest AS longest_gap_frames, CASE WHEN valid = 0 THEN 'missing_required_keypoints' WHEN valid < 2 OR ints < 1 THEN 'insufficient_observations' WHEN longest / 0.5 > 8 * (1 + 1e-9) THEN 'gap_too_long' WHEN valid / exp < 0.3 * (1 - 1e-9) THEN 'insufficient_coverage' WHEN estimate IS NULL THEN 'estimator_undefined' ELSE 'none' END AS qc_reason, round(estimate, 6) + 0.0 AS estimate FROM a JOIN est USING (user_id, window_idx)"""


@register("window_qc", _QC)
def window_qc(spark, sf_dir):
    slots = _on_quarter_hours(spark, sf_dir)
    top = slots.groupBy(*_KEYS).agg(F.max("slot").alias("__top"))
    lead = F.lit(0)
    trail = F.col("last") - F.col("__top")
    found = grid.evidence(slots.join(top, _KEYS), _KEYS, F.col("k") >= 10, lead=lead, trail=trail)
    estimate = slots.groupBy(*_KEYS).agg(F.stddev_samp(F.when(F.col("k") >= 10, F.col("value"))).alias("estimate"))
    j = found.join(estimate, _KEYS).withColumn("frame_coverage", F.col("n_valid_frames") / F.col("n_expected_frames"))
    reason = grid.qc_reason(F.lit(True), F.col("n_valid_frames"), F.col("n_valid_intervals"), F.col("longest_gap_sec"), F.col("frame_coverage"), F.col("estimate"), 0.3, 8.0)
    return rounded(j.select(*_KEYS, "n_expected_frames", "n_valid_frames", "frame_coverage", "n_valid_intervals", "longest_gap_frames", reason.alias("qc_reason"), "estimate"))


@register("window_corr", f"WITH {_WIN}, g AS (SELECT user_id, window_idx, count(*) AS n, var_pop(value) AS vx, var_pop(k) AS vy, covar_pop(value, k) AS c FROM win WHERE k IS NOT NULL GROUP BY 1, 2) SELECT user_id, CAST(window_idx AS BIGINT) AS window_idx, round(CASE WHEN n >= 5 AND sqrt(vx) * sqrt(vy) > 0 THEN c / nullif(sqrt(vx) * sqrt(vy), 0) END, 6) + 0.0 AS r FROM g")
def window_corr(spark, sf_dir):
    return rounded(windows(spark, sf_dir).groupBy(*_KEYS).agg(grid.guarded_corr("value", "k").alias("r")))


@register("sal_dft", f"""WITH {SIG}, r AS (SELECT *, CAST(floor(t / 864000) AS BIGINT) AS span, row_number() OVER (PARTITION BY user_id, floor(t / 864000) ORDER BY t, event_id) AS i FROM sig), v AS (SELECT user_id, span, list(value ORDER BY i) AS v, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) >= 4),
f AS (SELECT user_id, span, n, k, sqrt(pow(list_sum(list_transform(v, lambda x, j: x * cos(2 * pi() * k * (j - 1) / n))), 2) + pow(list_sum(list_transform(v, lambda x, j: x * sin(2 * pi() * k * (j - 1) / n))), 2)) AS a FROM v, LATERAL (SELECT unnest(generate_series(0, n // 2)) AS k)),
m AS (SELECT user_id, span, max(a) AS top FROM f GROUP BY 1, 2), d AS (SELECT f.user_id, f.span, n, k, a / top AS a, a / top - lag(a / top) OVER (PARTITION BY f.user_id, f.span ORDER BY k) AS da FROM f JOIN m ON f.user_id = m.user_id AND f.span = m.span)
SELECT user_id, span, round(-sum(sqrt(pow(30.0 / 2 / (n // 2) / 10.0, 2) + pow(da, 2))), 6) + 0.0 AS sal FROM d WHERE k >= 1 AND k <= floor(10.0 / (30.0 / 2 / (n // 2)) + 1e-12) GROUP BY user_id, span""")
def sal_dft(spark, sf_dir):
    """Every span of ten days of a user is one series: all rows count, and an array holds one span."""
    held = sig(spark, sf_dir).withColumn("span", F.floor(F.col("t") / 864000)).groupBy("user_id", "span")
    held = held.agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "event_id", "value"))), lambda x: x["value"]).alias("v")).where(F.size("v") >= 4)
    return rounded(grid.spectral_arc_length(held.withColumn("fs", F.lit(30.0)), "v", "fs", "sal").select("user_id", "span", "sal"))


_SPEED = f"""{TRJ}, o AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey {TRJ_ORDER}) AS frame, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)), 0.0) AS raw FROM trj WINDOW w AS (PARTITION BY l_suppkey {TRJ_ORDER})),
s AS (SELECT *, median(raw) OVER (PARTITION BY l_suppkey ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS speed FROM o), p AS (SELECT *, max(speed) OVER (PARTITION BY l_suppkey) AS peak FROM s),
a AS (SELECT *, frame - lag(frame) OVER (PARTITION BY l_suppkey ORDER BY frame) AS gap FROM p WHERE peak >= 1e-10 AND speed > 0.5 * peak), m AS (SELECT *, sum(CASE WHEN gap > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY frame) AS m FROM a),
sp AS (SELECT l_suppkey, m, min(frame) AS m_start, max(frame) AS m_end FROM m GROUP BY 1, 2 HAVING max(frame) - min(frame) + 1 >= 5), mv AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY m_start) AS movement_idx FROM sp)"""


def _movements(spark, sf_dir):
    df = phases.speeds(trj(spark, sf_dir).withColumn("fs", F.lit(1.0)), ["l_suppkey"], ORDER)
    return phases.movements(df, ["l_suppkey"], share=0.5)


@register("movement_runs", f"WITH {_SPEED} SELECT mv.l_suppkey, CAST(movement_idx AS INT) AS movement_idx, CAST(m_start AS INT) AS m_start, CAST(m_end AS INT) AS m_end, round(max(speed), 6) + 0.0 AS peak, round(avg(speed), 6) + 0.0 AS mean FROM mv JOIN s ON s.l_suppkey = mv.l_suppkey AND s.frame BETWEEN m_start AND m_end GROUP BY 1, 2, 3, 4")
def movement_runs(spark, sf_dir):
    found = _movements(spark, sf_dir).groupBy("l_suppkey", "movement_idx", "m_start", "m_end").agg(F.max("speed").alias("peak"), F.avg("speed").alias("mean"))
    return rounded(found)


#: The state machine as islands of frames: closing and opening runs of the smoothed aperture, the first that count, and what lies between.
_PHASES = f"""{_SPEED},
h0 AS (SELECT mv.l_suppkey, CAST(movement_idx AS INT) AS movement_idx, s.frame, x, y, z, speed, median(z) OVER (PARTITION BY mv.l_suppkey, movement_idx ORDER BY s.frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS ap FROM mv JOIN s ON s.l_suppkey = mv.l_suppkey AND s.frame BETWEEN m_start AND m_end),
h1 AS (SELECT *, coalesce(ap - lag(ap) OVER w, 0.0) AS d0, max(ap) OVER m - min(ap) OVER m AS rng, count(*) OVER m AS n FROM h0 WINDOW w AS (PARTITION BY l_suppkey, movement_idx ORDER BY frame), m AS (PARTITION BY l_suppkey, movement_idx)),
h2 AS (SELECT *, median(d0) OVER (PARTITION BY l_suppkey, movement_idx ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS d FROM h1),
h3 AS (SELECT *, CASE WHEN d < -0.05 * rng THEN -1 WHEN d > 0.05 * rng THEN 1 ELSE 0 END AS way FROM h2),
h4 AS (SELECT *, frame - row_number() OVER (PARTITION BY l_suppkey, movement_idx, way ORDER BY frame) AS island FROM h3),
hr AS (SELECT l_suppkey, movement_idx, way, min(frame) AS a, max(frame) AS b, any_value(rng) AS rng, any_value(n) AS n FROM h4 GROUP BY l_suppkey, movement_idx, way, island HAVING max(frame) - min(frame) + 1 >= 3),
hg AS (SELECT l_suppkey, movement_idx, min(a) AS ga, arg_min(b, a) AS gb FROM hr WHERE way = -1 AND rng >= 1e-8 AND n >= 6 GROUP BY 1, 2),
ho AS (SELECT hg.l_suppkey, hg.movement_idx, min(a) AS ra FROM hg JOIN hr ON hr.l_suppkey = hg.l_suppkey AND hr.movement_idx = hg.movement_idx WHERE way = 1 AND a > gb GROUP BY 1, 2),
ph AS (SELECT h4.l_suppkey, h4.movement_idx, frame, x, y, z, speed, CASE WHEN ga IS NULL OR frame < ga THEN 'REACH' WHEN frame <= gb THEN 'GRASP' WHEN frame >= ra THEN 'RELEASE' WHEN ra IS NULL OR ra - gb >= 3 THEN 'TRANSPORT' ELSE 'REACH' END AS phase
FROM h4 LEFT JOIN hg ON hg.l_suppkey = h4.l_suppkey AND hg.movement_idx = h4.movement_idx LEFT JOIN ho ON ho.l_suppkey = h4.l_suppkey AND ho.movement_idx = h4.movement_idx)"""


@register("movement_phases", f"WITH {_PHASES} SELECT l_suppkey, movement_idx, CAST(frame AS INT) AS frame, phase FROM ph")
def movement_phases(spark, sf_dir):
    """The phase of every frame of the movements, with z as the grasp's aperture."""
    return phases.phases(_movements(spark, sf_dir), ["l_suppkey"], aperture="z").select("l_suppkey", "movement_idx", "frame", "phase")


def _shape(group: str, prefix: str) -> str:
    """SQL of path, jerk and facts of groups of frames, a second a frame."""
    w = f"(PARTITION BY {group} ORDER BY frame)"
    third = " + ".join(f"pow({c} - 3 * lag({c}, 1) OVER w + 3 * lag({c}, 2) OVER w - lag({c}, 3) OVER w, 2)" for c in "xyz")
    step = "sqrt(" + " + ".join(f"pow({c} - lag({c}) OVER w, 2)" for c in "xyz") + ")"
    ends = "sqrt(" + " + ".join(f"pow(arg_max({c}, frame) - arg_min({c}, frame), 2)" for c in "xyz") + ")"
    return f"""{prefix}s AS (SELECT *, {step} AS step, {third} AS jerk FROM pr WINDOW w AS {w}),
{prefix}t AS (SELECT {group}, any_value(phase) AS phase, min(frame) AS lo, max(frame) AS hi, count(*) AS n, max(speed) AS peak, avg(speed) AS mean, coalesce(sum(step), 0.0) AS path, sum(jerk) AS jerk, {ends} AS straight, count(DISTINCT phase || CAST(phase_run AS VARCHAR)) AS runs FROM {prefix}s GROUP BY {group})"""


_PHASE_TABLE = f"""WITH {_PHASES}, pr AS (SELECT *, frame - row_number() OVER (PARTITION BY l_suppkey, movement_idx, phase ORDER BY frame) AS phase_run FROM (SELECT * FROM ph) q),
{_shape("l_suppkey, movement_idx, phase, phase_run", "p").replace("any_value(phase) AS phase, ", "")}, {_shape("l_suppkey, movement_idx", "m")},
pv AS (SELECT l_suppkey, movement_idx, phase, phase_run, list(speed ORDER BY frame) AS v, count(*) AS n, max(abs(speed)) AS top FROM pr GROUP BY 1, 2, 3, 4 HAVING count(*) >= 4),
pf AS (SELECT l_suppkey, movement_idx, phase, phase_run, n, top, k, sqrt(pow(list_sum(list_transform(v, lambda q, j: q * cos(2 * pi() * k * (j - 1) / n))), 2) + pow(list_sum(list_transform(v, lambda q, j: q * sin(2 * pi() * k * (j - 1) / n))), 2)) AS a FROM pv, LATERAL (SELECT unnest(generate_series(0, n // 2)) AS k)),
pa AS (SELECT *, a / max(a) OVER (PARTITION BY l_suppkey, movement_idx, phase, phase_run) AS r FROM pf),
pd AS (SELECT *, r - lag(r) OVER (PARTITION BY l_suppkey, movement_idx, phase, phase_run ORDER BY k) AS dr FROM pa),
pz AS (SELECT l_suppkey, movement_idx, phase, phase_run, CASE WHEN any_value(top) < 1e-10 THEN 0.0 ELSE -sum(sqrt(pow(1.0 / (n // 2), 2) + pow(dr, 2))) FILTER (k >= 1) END AS sal FROM pd GROUP BY 1, 2, 3, 4)
SELECT pt.l_suppkey, pt.movement_idx, pt.phase, CAST(pt.lo AS INT) AS start_frame, CAST(pt.hi AS INT) AS end_frame, round(CAST(pt.hi - pt.lo AS DOUBLE), 4) AS duration_sec, round(pt.peak, 6) AS peak_velocity, round(pt.mean, 6) AS mean_velocity, round(pt.path, 6) AS path_length,
round(CASE WHEN pt.n >= 5 AND pt.path >= 1e-10 THEN sqrt(pow(pt.n - 1, 5) / (2 * pow(pt.path, 2)) * pt.jerk) END, 4) AS smoothness_nj, round(sal, 4) AS smoothness_sal, CAST(NULL AS DOUBLE) AS mean_reach_symmetry, round(CAST(mt.hi - mt.lo AS DOUBLE), 4) AS movement_duration_sec, CAST(mt.runs AS INT) AS movement_n_phases,
round(mt.peak, 6) AS movement_peak_velocity, round(mt.path, 6) AS movement_path_length, round(CASE WHEN mt.n >= 2 AND mt.straight > 1e-10 THEN mt.path / mt.straight END, 4) AS movement_efficiency
FROM pt JOIN mt ON mt.l_suppkey = pt.l_suppkey AND mt.movement_idx = pt.movement_idx LEFT JOIN pz ON pz.l_suppkey = pt.l_suppkey AND pz.movement_idx = pt.movement_idx AND pz.phase = pt.phase AND pz.phase_run = pt.phase_run"""


@register("phase_table", _PHASE_TABLE)
def phase_table(spark, sf_dir):
    """Phases of the movements with z as the grasp's aperture: the whole table."""
    df = phases.phases(_movements(spark, sf_dir).withColumn("t", F.col("frame").cast("double")), ["l_suppkey"], aperture="z")
    return phases.phase_table(df, ["l_suppkey"])


@register("trajectory_measures", f"""WITH {TRJ}, o AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey {TRJ_ORDER}) - 1 AS slot FROM trj), n AS (SELECT l_suppkey, max(slot) + 1 AS n_grid FROM o GROUP BY 1), v AS (SELECT o.*, n_grid FROM o JOIN n USING (l_suppkey) WHERE slot % 17 <> 0),
d AS (SELECT *, CASE WHEN lag(slot) OVER w = slot - 1 THEN sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) END AS step FROM v WINDOW w AS (PARTITION BY l_suppkey ORDER BY slot))
SELECT l_suppkey, round(avg(step), 6) + 0.0 AS v_mean, round(max(step), 6) + 0.0 AS v_peak, round((any_value(n_grid) - count(*)) / any_value(n_grid), 6) + 0.0 AS dropout FROM d GROUP BY 1""")
def trajectory_measures(spark, sf_dir):
    w = ordered.series(["l_suppkey"], ORDER)
    df = trj(spark, sf_dir).withColumns({"slot": (F.row_number().over(w) - 1).cast("bigint"), "fs": F.lit(1.0)})
    df = df.withColumns({c: F.when(F.col("slot") % 17 != 0, F.col(c)) for c in "xyz"})
    return rounded(grid.trajectory(df, ["l_suppkey"]).select("l_suppkey", "v_mean", "v_peak", "dropout"))


@register("grid_faults", f"WITH {SIG}, w AS (SELECT user_id, t, event_id, round(t / 3600.0) AS h FROM sig), d AS (SELECT *, h - lag(h) OVER (PARTITION BY user_id ORDER BY t, event_id) AS step FROM w) SELECT user_id, CASE WHEN count(*) < 2 THEN 'too_few' WHEN count(*) FILTER (step <= 0) > 0 THEN 'not_increasing' END AS fault FROM d GROUP BY user_id")
def grid_faults(spark, sf_dir):
    df = sig(spark, sf_dir).withColumns({"h": F.round(F.col("t") / 3600.0), "fs": F.lit(1.0)})
    return grid.on_grid(df, ["user_id"], ["t", "event_id"], time="h").groupBy("user_id").agg(F.max("fault").alias("fault"))
