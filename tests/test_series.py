"""Gates, geometry, ordered series, grids and movements on small analytic inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motiondeck.functions import geometry as g
from motiondeck.operators import gates, grid, ordered, phases
from motiondeck.sources import schema


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} double" for k in values)) if values else spark.range(1)
    return df.select(column.alias("c")).first().c


def test_right_angle_and_no_angle(spark):
    p = lambda *xyz: tuple(F.lit(float(v)) for v in xyz)
    assert one(spark, g.angle_at_vertex(p(1, 0, 0), p(0, 0, 0), p(0, 1, 0))) == pytest.approx(90)
    assert one(spark, g.angle_at_vertex(p(0, 0, 0), p(0, 0, 0), p(0, 1, 0))) is None


def test_trunk_lean_of_a_known_posture(spark):
    p = lambda *xyz: tuple(F.lit(float(v)) for v in xyz)
    lean = g.trunk_3d(p(-0.2, -0.5, 0.2), p(0.2, -0.5, 0.2), p(-0.2, 0, 0), p(0.2, 0, 0))["trunk_lean_deg"]
    assert one(spark, lean) == pytest.approx(math.degrees(math.atan2(0.2, 0.5)))


def test_bilateral_needs_both_sides(spark):
    b = g.bilateral(F.col("l"), F.col("r"))
    assert one(spark, b["symmetry_ratio"], l=1.0, r=2.0) == 0.5
    assert one(spark, b["dominance_index"], l=1.0, r=3.0) == 0.5
    assert one(spark, b["symmetry_ratio"], l=0.0, r=0.0) is None
    assert one(spark, b["symmetry_ratio"], l=None, r=2.0) is None


def test_zero_confidence_is_no_evidence_and_a_missing_column_is_no_gate(spark):
    df = spark.createDataFrame([(0.5, 0.0, 0.7), (0.5, 0.01, 0.7), (0.5, None, float("nan"))], "a_x double, a_vis double, b_x double")
    rows = gates.gate_2d(df).collect()
    assert [r.a_x for r in rows] == [None, 0.5, None]
    assert [r.b_x for r in rows] == [0.7, 0.7, None]


@pytest.mark.parametrize("reproj, chei, angle, kept", [(19.0, 1, 2.0, True), (21.0, 1, 2.0, False), (float("inf"), 1, 2.0, False), (5.0, 0, 2.0, False), (5.0, 1, 0.5, False), (5.0, 1, None, False)])
def test_trust_gate(spark, reproj, chei, angle, kept):
    df = spark.createDataFrame([("v", 0, 0.0, 0, 1.0, 2.0, 3.0, reproj, chei, angle)], "video string, frame_idx int, timestamp_sec double, person_idx int, k_x_m double, k_y_m double, k_z_m double, k_reproj_err_px double, k_cheirality_ok int, k_triangulation_angle_deg double")
    assert (gates.gate_3d(df).first().k_x is not None) == kept
    legacy = df.drop("k_triangulation_angle_deg")
    assert (gates.gate_3d(legacy).first().k_x is not None) == (kept or reproj == 5.0 and chei == 1)


def test_headers_and_modes():
    assert [len(schema.landmark_schema(m)) for m in ("hands", "hands-arms", "body")] == [172, 220, 304]
    assert schema.tracking_mode(["body_nose_x"]) == "body" and schema.tracking_mode(["arm_left_wrist_x"]) == "hands-arms" and schema.tracking_mode(["left_hand_0_x"]) == "hands"
    assert schema.is_world(["a_x_m"]) and not schema.is_world(["a_x"])
    assert (len(schema.window_schema()), len(schema.qc_schema()), len(schema.phase_schema())) == (46, 22, 19)


def _minimum_jerk(n=91, fps=30.0):
    u = np.arange(n) / (n - 1)
    m = 10 * u**3 - 15 * u**4 + 6 * u**5
    return [(0, i, i / fps, float(0.4 * a), float(0.05 * math.sin(math.pi * b)), 0.0) for i, (a, b) in enumerate(zip(m, u, strict=True))]


TRAJECTORY = "k int, i int, t double, x double, y double, z double"


def test_normalized_jerk_of_the_minimum_jerk_profile(spark):
    df = spark.createDataFrame(_minimum_jerk(), TRAJECTORY).withColumn("fs", F.lit(30.0))
    legacy = ordered.smoothness(df, ["k"], ["i"], "fs").first()
    slots = grid.on_grid(df, ["k"], ["i"])
    assert slots.select("fault").distinct().collect()[0].fault is None
    kernel = grid.trajectory(slots, ["k"]).first()
    assert 16.455 < kernel.normalized_jerk < 16.456
    assert kernel.normalized_jerk == pytest.approx(legacy.normalized_jerk) and kernel.efficiency == pytest.approx(legacy.efficiency)


def test_a_gap_in_the_middle_leaves_efficiency_unmeasured_and_speed_inside_its_neighbours(spark):
    rows = [r for r in _minimum_jerk() if r[1] not in (40, 41)]
    df = grid.on_grid(spark.createDataFrame(rows, TRAJECTORY).withColumn("fs", F.lit(30.0)), ["k"], ["i"])
    found = grid.trajectory(df, ["k"]).first()
    assert found.efficiency is None and found.dropout == pytest.approx(2 / 91)
    whole = grid.trajectory(grid.on_grid(spark.createDataFrame(_minimum_jerk(), TRAJECTORY).withColumn("fs", F.lit(30.0)), ["k"], ["i"]), ["k"]).first()
    assert found.v_peak <= whole.v_peak + 1e-12
    e = grid.evidence(df, ["k"], F.lit(True)).first()
    assert (e.n_expected_frames, e.n_valid_frames, e.n_valid_intervals, e.longest_gap_frames, e.n_gaps) == (91, 89, 87, 2, 1)


@pytest.mark.parametrize("times, fault", [([0, 1, 2], None), ([0], "too_few"), ([0, 1, 1], "not_increasing"), ([0, 1.4, 2], "off_grid"), ([0, float("inf"), 2], "not_finite"), ([0, 1.2, 1.3, 2], "off_grid"), ([0, 0.9, 1.1], "collision")])
def test_time_base_faults(spark, times, fault):
    df = spark.createDataFrame([(0, i, float(t)) for i, t in enumerate(times)], "k int, i int, t double").withColumn("fs", F.lit(1.0))
    assert {r.fault for r in grid.on_grid(df, ["k"], ["i"]).collect()} == {fault}


def test_evidence_against_a_plain_count(spark):
    rng = np.random.default_rng(3)
    rows, wanted = [], {}
    for k in range(30):
        ok = rng.random(rng.integers(2, 25)) < 0.6
        lead, trail = int(rng.integers(0, 4)), int(rng.integers(0, 4))
        rows += [(k, s, bool(v), lead, trail) for s, v in enumerate(ok)]
        padded = np.concatenate([np.zeros(lead, bool), ok, np.zeros(trail, bool)])
        runs = [len(x) for x in "".join("1" if v else "0" for v in padded).split("1") if x]
        wanted[k] = (len(padded), int(padded.sum()), int((padded[1:] & padded[:-1]).sum()), max(runs, default=0), len(runs))
    df = spark.createDataFrame(rows, "k int, slot bigint, ok boolean, lead int, trail int").withColumn("fs", F.lit(10.0))
    found = grid.evidence(df, ["k"], F.col("ok"), lead=F.col("lead"), trail=F.col("trail")).collect()
    assert {r.k: (r.n_expected_frames, r.n_valid_frames, r.n_valid_intervals, r.longest_gap_frames, r.n_gaps) for r in found} == wanted


def test_qc_precedence_and_tolerances(spark):
    def reason(ok=True, valid=30, ints=29, gap=0.0, cov=1.0, est=1.0):
        return one(spark, grid.qc_reason(*[F.lit(v) for v in (ok, valid, ints, gap, cov)], F.lit(est).cast("double")))

    assert reason(ok=False, valid=0) == "invalid_timebase" and reason(valid=0, ints=0) == "missing_required_keypoints"
    assert reason(valid=1, ints=0, gap=1.0) == "insufficient_observations" and reason(gap=0.2, cov=0.1) == "gap_too_long"
    assert reason(cov=0.79) == "insufficient_coverage" and reason(est=None) == "estimator_undefined" and reason() == "none"
    assert reason(gap=0.10000000000000009) == "none" and reason(cov=0.8 - 1e-12) == "none"


def test_windows_are_anchored_and_half_open(spark):
    df = spark.createDataFrame([(0, i, 5.0 + i / 4) for i in range(13)], "k int, i int, t double")
    found = grid.sliding_windows(df, ["k"]).groupBy("window_idx").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n")).orderBy("window_idx").collect()
    assert [(r.a, r.b, r.n) for r in found] == [(5.0 + 0.5 * i, 5.75 + 0.5 * i, 4) for i in range(5)]


def test_guarded_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (4.0, 8.0), (5.0, 10.0), (None, 3.0)], "a double, b double")
    assert df.agg(grid.guarded_corr("a", "b").alias("c")).first().c == pytest.approx(1)
    assert df.limit(4).agg(grid.guarded_corr("a", "b").alias("c")).first().c is None
    assert df.withColumn("b", F.lit(1.0)).agg(grid.guarded_corr("a", "b").alias("c")).first().c is None


def test_spectral_arc_length_against_numpy(spark):
    v = [0.0, 0.2, 0.9, 1.0, 0.7, 0.2, 0.1, 0.0, 0.05]
    a = np.abs(np.fft.fft(np.array(v)))[: len(v) // 2 + 1]
    a, f = a / a.max(), np.linspace(0, 15.0, len(v) // 2 + 1)
    keep = f <= 10
    wanted = -np.sqrt((np.diff(f[keep]) / 10) ** 2 + np.diff(a[keep]) ** 2).sum()
    df = spark.createDataFrame([(v, 30.0), ([0.0] * 5, 30.0), ([1.0] * 3, 30.0)], "v array<double>, fs double")
    found = [r.sal for r in grid.spectral_arc_length(df, "v", "fs", "sal").collect()]
    assert found[0] == pytest.approx(wanted) and found[1:] == [0.0, None]


def test_fills_and_runs(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])], "k int, i int, v double")
    w = ordered.series(["k"], ["i"])
    assert [r.f for r in df.select(ordered.fill_forward_back(w, "v").alias("f")).collect()] == [1.0, 1.0, 1.0, 1.0, 4.0, 4.0]
    assert [r.f for r in df.select(ordered.fill_linear(w, "v", "i").alias("f")).collect()] == [None, 1.0, 2.0, 3.0, 4.0, None]
    runs = ordered.run_lengths(df, ["k"], ["i"], F.col("v").isNull()).orderBy("run").collect()
    assert [(r.state, r.length) for r in runs] == [(True, 1), (False, 1), (True, 2), (False, 1), (True, 1)]


def test_jitter_looks_past_frames_without_points(spark):
    p = lambda x: [(x, 0.0)]
    df = spark.createDataFrame([(0, 0, p(0.0)), (0, 1, None), (0, 2, p(3.0)), (0, 3, [(0.0, 0.0), (1.0, 1.0)])], "k int, i int, points array<struct<x:double,y:double>>")
    assert [r.jitter_px for r in ordered.jitter(df, ["k"], ["i"]).orderBy("i").collect()] == [None, None, 3.0, None]


def test_robust_rate_recovers_thirty_hertz(spark):
    df = spark.createDataFrame([(0, i, round(i / 30, 4)) for i in range(60) if i != 20], "k int, i int, t double")
    assert ordered.frame_rate(df, ["k"], ["i"], robust=True).first().fs == pytest.approx(30, abs=0.01)
    assert ordered.frame_rate(df, ["k"], ["i"]).first().fs == pytest.approx(30.03, abs=0.01)


def test_reach_grasp_transport_release(spark):
    aperture = [1.0] * 6 + [0.8, 0.6, 0.4, 0.2] + [0.2] * 6 + [0.4, 0.6, 0.8, 1.0] + [1.0] * 4
    rows, x = [], 0.0
    for i, a in enumerate([1.0] * 5 + aperture + [1.0] * 6):
        x += 0.02 if 5 <= i < 5 + len(aperture) else 0.0
        rows.append((0, i, i / 30, x, 0.0, 0.0, a))
    df = spark.createDataFrame(rows, TRAJECTORY + ", aperture double").withColumn("fs", F.lit(30.0))
    found = phases.phases(phases.movements(phases.speeds(df, ["k"], ["i"]), ["k"]), ["k"])
    table = phases.phase_table(found, ["k"]).orderBy("start_frame").collect()
    assert [r.phase for r in table] == ["REACH", "GRASP", "TRANSPORT", "RELEASE"]
    assert {r.movement_n_phases for r in table} == {4} and all(a.end_frame + 1 == b.start_frame for a, b in zip(table, table[1:], strict=False))


def test_short_movements_and_rest_have_no_phases(spark):
    df = spark.createDataFrame([(0, i, i / 30, 0.0, 0.0, 0.0) for i in range(20)], TRAJECTORY).withColumn("fs", F.lit(30.0))
    assert phases.movements(phases.speeds(df, ["k"], ["i"]), ["k"]).count() == 0


def test_baseline_deltas_keep_a_null_baseline(spark):
    df = spark.createDataFrame([("a", 1, 10.0, 1.0), ("a", 2, 13.0, 1.0), ("b", 1, None, None), ("b", 2, 3.0, 1.0), ("c", 1, 2.0, None), ("c", 2, 9.0, 1.0)], "p string, d int, v double, s double")
    rows = {(r.p, r.d): r for r in ordered.baseline_deltas(df, ["p"], ["d"], "v", "s").collect()}
    assert rows["a", 2].pct_change == pytest.approx(30) and rows["a", 2].flagged is True
    assert rows["b", 2].delta is None and rows["c", 2].delta == 7 and rows["c", 2].flagged is None
