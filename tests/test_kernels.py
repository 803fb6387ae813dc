"""Assignment, suppression, smoothing, fusion and recursive filters against brute force or closed forms."""

import os
from datetime import datetime, timedelta
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motiondeck.operators import fusion, matching, stats
from motiondeck.plans.kernels import RIG
from motiondeck.streaming import filters, lockstep


def brute(cost, limit):
    n, m = cost.shape
    ok = np.isfinite(cost) & (cost < limit)
    best = (0, 0.0)
    wide = max(n, m)
    for p in permutations(range(wide), n) if n <= wide else ():
        cells = [(i, j) for i, j in enumerate(p) if j < m and ok[i, j]]
        best = max(best, (len(cells), -sum(cost[c] for c in cells)))
    return best


@pytest.mark.parametrize("seed", range(25))
def test_assignment_is_largest_then_cheapest(seed):
    rng = np.random.default_rng(seed)
    cost = rng.random((rng.integers(1, 5), rng.integers(1, 5)))
    cost[rng.random(cost.shape) < 0.2] = np.nan
    pairs = matching.assignment(cost, 0.7)
    got = (len(pairs), -sum(cost[p] for p in pairs))
    want = brute(cost, 0.7) if cost.shape[0] <= cost.shape[1] else brute(cost.T, 0.7)
    assert got[0] == want[0] and got[1] == pytest.approx(want[1])


def test_assignment_is_optimal_where_greedy_is_not():
    assert matching.assignment(np.array([[1.0, 2.0], [1.1, 9.0]])) == [(0, 1), (1, 0)]
    assert matching.assignment(np.full((2, 2), np.inf)) == [] and matching.assignment(np.zeros((0, 3))) == []


def test_match_groups(spark):
    df = spark.createDataFrame([("a", 1, 7, 1.0), ("a", 1, 8, 2.0), ("a", 2, 7, 1.1), ("b", 1, 1, 5.0), ("b", 1, 2, None)], "k string, l int, r int, cost double")
    assert {(x.k, x.l, x.r) for x in matching.match(df, ["k"], "l", "r").collect()} == {("a", 1, 8), ("a", 2, 7), ("b", 1, 1)}


def test_weighted_suppression_merges(spark):
    df = spark.createDataFrame([(0, 1, 0.0, 0.0, 2.0, 2.0, 0.9), (0, 2, 0.2, 0.0, 2.2, 2.0, 0.3), (0, 3, 5.0, 5.0, 6.0, 6.0, 0.5)], "k int, det_id int, x1 double, y1 double, x2 double, y2 double, score double")
    rows = matching.non_maximum_suppression(df, ["k"]).orderBy("x1").collect()
    assert [(r.members, r.score) for r in rows] == [(2, 0.9), (1, 0.5)] and rows[0].x1 == pytest.approx(0.05)
    merged = matching.non_maximum_suppression(df.withColumn("px", F.col("x1") * 2), ["k"], also=["px"]).orderBy("x1").first()
    assert merged.px == pytest.approx(0.1)


def test_savgol_keeps_cubics_and_handles_gaps():
    x = np.arange(40.0)
    y = 0.01 * x**3 - x**2 + 3
    assert np.allclose(matching.savgol(y), y)
    short, long = y.copy(), y.copy()
    short[10:13] = np.nan
    long[10:20] = np.nan
    assert np.isfinite(matching.savgol(short)).all() and abs(matching.savgol(short)[11] - y[11]) < 5
    assert np.isnan(matching.savgol(long)[10:20]).all()
    assert np.allclose(np.delete(matching.savgol(long), range(10, 20)), np.delete(y, range(10, 20)))
    assert np.array_equal(matching.savgol(np.array([1.0, 5.0, 2.0])), [1.0, 5.0, 2.0])


def test_clamped_angle_turns_the_branch():
    p = np.array([[0.0, 1, 0], [0, 0, 0], [0.0, 2, 0], [0.0, 3, 0]])
    q, hit = matching.clamp_joint(p, 0, 1, 2, [2, 3], 30.0, 180.0)
    angle = np.degrees(np.arccos(q[2, 1] / 2))
    assert hit and angle == pytest.approx(30) and np.hypot(*q[3, :2]) == pytest.approx(3)
    assert not matching.clamp_joint(np.array([[0.0, 1, 0], [0, 0, 0], [0, -1, 0]]), 0, 1, 2, [2], 30.0, 180.0)[1]


def _views(points, noise=0.0, outlier=None):
    rows = []
    for name, c in RIG.items():
        p = fusion.projection(np.array(c["K"], float), np.array(c["rvec"], float), np.array(c["tvec"], float))
        for i, x in enumerate(points):
            h = p @ np.append(x, 1)
            off = 80.0 if outlier == (name, i) else 0.0
            rows.append(("s", 0, f"p{i}", name, float(h[0] / h[2] + off), float(h[1] / h[2]), 0.9))
    return rows


VIEW = "session string, frame int, keypoint string, camera string, px double, py double, confidence double"


def test_fusion_finds_the_points_and_rejects_an_outlier_view(spark):
    points = np.array([[0.1, 0.2, 0.3], [-0.4, 0.1, 0.0], [0.3, -0.2, 0.5]])
    rows = _views(points, outlier=("c", 1)) + [("s", 0, "alone", "a", 10.0, 10.0, 0.9), ("s", 0, "blind", "a", 10.0, 10.0, 0.0)]
    found = {r.keypoint: r for r in fusion.fuse(spark.createDataFrame(rows, VIEW), RIG).collect()}
    for i, x in enumerate(points):
        assert np.allclose([found[f"p{i}"][c] for c in "xyz"], x, atol=1e-6)
    assert (found["p0"].n_views, found["p1"].n_views, found["p1"].candidate_n_views) == (3, 2, 3)
    assert found["alone"].x is None and found["alone"].candidate_n_views == 1 and found["blind"].candidate_n_views == 0


def test_undistortion_undoes_distortion():
    k, d = np.array([[900.0, 0, 640], [0, 880, 360], [0, 0, 1]]), np.array([-0.2, 0.05, 0.001, -0.002, 0.0])
    xy = np.array([[0.2, -0.1], [0.05, 0.3]])
    px = fusion.distort(xy, d) * [900, 880] + [640, 360]
    assert np.allclose(fusion.undistort(px, k, d), xy * [900, 880] + [640, 360], atol=1e-6)


def test_logical_frames_and_time_preference(spark):
    df = spark.createDataFrame([("s", "a", 0, 5, 2, None), ("s", "b", 1, 3, 0, 7.0), ("s", "c", 2, 3, 0, 8.0), ("s", "a", 0, 1, 2, 1.0), ("s", "b", 1, 9, 0, 1.0)], "session string, camera string, camera_pos int, raw_idx int, sync_offset int, ts double")
    assert [(r.logical_idx, r.cameras, r.ts) for r in fusion.logical_frames(df).collect()] == [(3, 3, 7.0)]
    assert fusion.lock_step(df).agg(F.max("logical_idx").alias("m")).first().m == 3


def test_first_observation_passes_and_no_confidence_holds():
    p = filters.Euro(cap=30.0)
    state, out = filters.euro_step(None, np.array([[1.0, 2.0]]), 0.0, np.array([0.0]), p)
    state, out = filters.euro_step(state, np.array([[500.0, 2.0]]), 0.1, np.array([1.0]), p)
    assert out[0, 0] == 500.0
    again, held = filters.euro_step(state, np.array([[900.0, 9.0]]), 0.2, np.array([0.0]), p)
    assert np.array_equal(held, out) and again["dx"] == state["dx"]
    _, capped = filters.euro_step(state, np.array([[900.0, 2.0]]), 0.2, np.array([1.0]), p)
    assert capped[0, 0] - 500 < 31


def test_tracks_are_born_carried_and_forgotten():
    at = lambda x: [(np.array([[x, 0.0]]), np.array([1.0]))]
    p = filters.Tracker(grace=2)
    state, rows = filters.track_step(None, 0.0, at(0.0), p)
    state, rows = filters.track_step(state, 0.1, at(1.0), p)
    assert rows[0]["track_id"] == 0 and rows[0]["age"] == 2
    state, rows = filters.track_step(state, 0.2, [], p)
    assert (rows[0]["misses"], rows[0]["det"], rows[0]["age"]) == (1, None, 1)
    state, rows = filters.track_step(state, 0.3, [], p)
    state, rows = filters.track_step(state, 0.4, [], p)
    assert rows == []
    _, rows = filters.track_step({"tracks": [], "next": 5}, 0.0, at(0.0) + at(900.0), filters.Tracker(most=1))
    assert [r["track_id"] for r in rows] == [5]


def test_bone_length_survives_an_outlier():
    state, bone = None, [(0, 1)]
    for d in [10.0] * 5 + [100.0] + [10.0] * 2:
        state, q, off = filters.bone_step(state, np.array([[0.0, 0, 1], [d, 0, 2]]), bone)
    assert abs(state["0"] - 10) < 0.4
    long = np.array([[0.0, 0, 1], [16.0, 0, 2]])
    after, q, off = filters.bone_step({"0": 10.0}, long, bone)
    assert q[1, 0] - q[0, 0] == pytest.approx(10) and q[0, 0] == pytest.approx(1.2) and off == pytest.approx(6) and list(q[:, 2]) == [1, 2]
    assert after["0"] == pytest.approx(10.2)  # learns from the clipped length, moves to the one before
    within = np.array([[0.0, 0, 1], [13.0, 0, 2]])
    for state, points, valid in [(None, long, None), ({"0": 10.0}, within, None), ({"0": 10.0}, long, [True, False])]:
        after, q, off = filters.bone_step(state, points, bone, valid=valid)
        assert np.array_equal(q, points) and off == 0
    assert after == {"0": 10.0}


def test_a_lost_detection_moves_on_by_its_last_unblended_step():
    state, _ = filters.detection_step(None, [{"cx": 0.10, "cy": 0.5, "score": 1.0}])
    state, out = filters.detection_step(state, [{"cx": 0.16, "cy": 0.5, "score": 1.0}])
    assert out[0]["cx"] == pytest.approx(0.121)
    _, out = filters.detection_step(state, [])
    assert out[0]["cx"] == pytest.approx(0.121 + 0.06)


def test_suppression_without_weight_is_the_plain_mean():
    boxes = np.array([[0.0, 0, 2, 2, 5], [0.2, 0, 2.2, 2, 7], [3, 3, 2, 4, 1]])
    found = matching.suppress(boxes, np.zeros(3), 0.3, True)
    assert np.allclose(found[0][0], [0.1, 0, 2.1, 2, 6]) and [m for *_, m in found] == [[0, 1], [2]]


def test_detections_are_carried_and_fade():
    state, _ = filters.detection_step(None, [{"cx": 0.5, "cy": 0.5, "score": 1.0}])
    for n in range(3):
        state, out = filters.detection_step(state, [])
        assert out[0]["score"] == pytest.approx(0.7 ** (n + 1))
    assert filters.detection_step(state, [])[1] == []


def test_clock_is_strictly_increasing():
    assert filters.clock_step(None, 2.0, 0, 30.0) == 2.0 and filters.clock_step(2.0, 2.0, 90, 30.0) == 3.0
    assert filters.clock_step(5.0, None, 3, 30.0) == pytest.approx(5 + 1 / 30)


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = [(k, i, i / 30, float(np.sin(i / 5) + k), float(k)) for k in range(3) for i in range(12)]
    df = spark.createDataFrame(rows, "k int, i int, t double, x double, y double")
    step = filters.euro_of(["x", "y"], "t")
    schema = "t double, x double, y double"
    batch = {(r.k, r.t): (r.x, r.y) for r in filters.run_grouped(df, ["k"], ["i"], step, schema).collect()}
    source = tmp_path / "in"
    for part, cond in (("a", "i < 5"), ("b", "i >= 5")):
        df.where(cond).coalesce(1).write.parquet(str(source / part))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(source))
    out = filters.run_stream(stream, ["k"], ["i"], step, schema)
    query = out.writeStream.format("memory").queryName("smoothed").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.k, r.t): (r.x, r.y) for r in spark.table("smoothed").collect()}
    assert got.keys() == batch.keys() and all(np.allclose(got[k], batch[k]) for k in got)


def test_a_task_holds_few_rows_as_objects(spark):
    def step(state, row):
        held = int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
        return None, [(row["i"], held, [{"x": float(k), "y": row["i"] + 0.5} for k in range(300)])]

    df = spark.range(8000).select(F.lit(1).alias("k"), F.col("id").alias("i"))
    found = filters.run_grouped(df, ["k"], ["i"], step, "i bigint, held bigint, p array<struct<x: double, y: double>>")
    got = found.select("i", "held", F.size("p").alias("n"), F.col("p")[7].alias("q")).toPandas()
    assert got.i.tolist() == list(range(8000)) and (got.n == 300).all() and got.q[7999] == (7.0, 7999.5)
    assert got.held.max() - got.held[500] < 150e6  # all rows as objects are over 500 MB


def test_missing_numbers_and_keys_of_grouped_rows(spark):
    df = spark.createDataFrame([(None, 0, None, None, "a"), (None, 1, 2.5, 7, None), (3, 0, None, 1, "b")], "k int, i int, v double, n int, s string")
    step = lambda state, row: ((state or 0) + 1, [(state, row["v"], float(row["n"]), row["s"])])
    got = filters.run_grouped(df, ["k"], ["i"], step, "seen int, v double, n double, s string").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, None, None, None, "a"), (None, 1, 2.5, 7.0, None), (3, None, None, 1.0, "b")], key=str)


def scalar_tracks(rows, p):
    """Rows (key, frame, x, y) tracked frame by frame."""
    out, states, frames = [], {}, {}
    for key, frame, *at in rows:
        frames.setdefault((key, frame), []).append((np.array([[np.nan if v is None else v for v in at]], float), np.array([1.0])))
    for (key, frame), dets in frames.items():
        states[key], found = filters.track_step(states.get(key), frame / 30, dets, p)
        out += [(key, frame, r["track_id"], r["det"], r["age"], r["misses"], *r["points"][0].tolist()) for r in found]
    return out


TRACKED = pa.schema([("k", pa.int32()), ("f", pa.int64()), *[(n, pa.int32()) for n in ("track_id", "det", "age", "misses")], ("x", pa.float64()), ("y", pa.float64())])


@pytest.mark.parametrize("held, costs", [(1 << 20, 1 << 21), (50, 40), (1, 1)])
@pytest.mark.parametrize("seed", range(4))
def test_series_side_by_side_are_those_step_by_step(monkeypatch, seed, held, costs):
    for name, value in (("HELD", held), ("COSTS", costs), ("OUT", 64)):
        monkeypatch.setattr(lockstep, name, value)
    rng = np.random.default_rng(seed)
    p = filters.Tracker(reach=8.0, grace=3, step_cap=4.0, still=seed == 2, euro=filters.Euro(cap=3.0, rest_cutoff=None if seed == 3 else 0.05))
    rows = []
    for key in (None, *range(9)):
        for frame in np.flatnonzero(rng.random(140 if key == 0 else 60) < 0.7).tolist():
            for _ in range(int(rng.integers(1, 12 if key == 4 else 4))):  # whole numbers make ties
                x, y = (float(v) for v in (rng.integers(0, 20, 2) if rng.random() < 0.5 else rng.random(2) * 20))
                rows.append((key, 100 + frame, None if rng.random() < 0.03 else x, y))
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=["k", "f", "x", "y"])
    found = pa.Table.from_batches(lockstep.tracked(["k"], "f", "x", "y", 30.0, p, TRACKED)(iter(table.to_batches(max_chunksize=37))), TRACKED)
    by = lambda r: (-1 if r[0] is None else r[0], *r[1:3])
    got, expected = sorted((tuple(r.values()) for r in found.to_pylist()), key=by), sorted(scalar_tracks(rows, p), key=by)
    assert [r[:6] for r in got] == [r[:6] for r in expected] and any(r[3] is None for r in got)
    assert np.allclose([r[6:] for r in got], [r[6:] for r in expected], rtol=0, atol=1e-9)


def test_many_series_take_few_steps(monkeypatch):
    calls, step = [], lockstep._step
    monkeypatch.setattr(lockstep, "_step", lambda *a: calls.append(1) or step(*a))
    batch = pa.record_batch({"k": np.repeat(np.arange(2000, dtype=np.int32), 30), "f": np.tile(np.arange(30), 2000), "x": np.tile(np.arange(30.0), 2000), "y": np.zeros(60000)})
    found = pa.Table.from_batches(lockstep.tracked(["k"], "f", "x", "y", 30.0, filters.Tracker(reach=30.0), TRACKED)(iter([batch])), TRACKED).to_pandas()
    assert len(found) == 60000 and (found.track_id == 0).all() and found.age.max() == 30 and len(calls) == 30


def test_windowed_monitor(spark, tmp_path):
    from motiondeck.streaming import monitor

    df = spark.createDataFrame([("v", datetime(2024, 1, 1) + timedelta(seconds=i / 4), 1.0 if i % 2 else 0.0) for i in range(16)], "video string, at timestamp, conf double")
    df.write.parquet(str(tmp_path / "in"))
    counts = monitor.windowed_counts(monitor.landmark_stream(spark, str(tmp_path / "in"), df.schema, "parquet"), "video", "at", "conf")
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n_rows").alias("n"), F.sum("n_observed").alias("o")).first().asDict() == {"n": 32, "o": 16}


def test_p_of_a_correlation():
    p = stats.correlation_p.func(pd.Series([0.5, 0.0, 1.0, None]), pd.Series([10, 10, 10, 10]))
    assert p[0] == pytest.approx(0.14111, abs=1e-4) and p[1] == pytest.approx(1) and p[2] == pytest.approx(0) and np.isnan(p[3])


def test_leaf_order_keeps_neighbours_together():
    order = stats.leaf_order(np.array([[0.0], [10.0], [0.1], [10.1]]))
    assert abs(order.index(0) - order.index(2)) == 1 and abs(order.index(1) - order.index(3)) == 1
