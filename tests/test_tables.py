"""Name grammar, census, tables, aggregates, grades, sources."""

import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from motiondeck.functions import text
from motiondeck.operators import aggregate, census, grading, stats, tables
from motiondeck.sources import corpus, landmarks, schema

NAMES = [
    ("3_above_cap_l.mp4", ("ok", 3, "above", "cap", "l", 0, [])),
    ("  07 Left__coini_r.MOV.mov", ("ok", 7, "left", "coin", "r", 0, ["case_folded", "outer_trimmed", "whitespace_collapsed", "underscore_collapsed", "media_suffix_doubled", "task_repaired"])),
    ("_9_right_grass_l (2).avi", ("ok", 9, "right", "glass", "l", 2, ["whitespace_collapsed", "leading_separator_stripped", "repeat_marker", "task_repaired"])),
    ("9_right_cap_.mp4", ("side_missing", None, None, None, None, None, [])),
    ("9_right_cap_l(0).mp4", ("repeat_marker_unrecognized", None, None, None, None, None, [])),
    ("x_right_cap_l.mp4", ("subject_token_nonnumeric", None, None, None, None, None, [])),
    ("9_front_cap_l.mp4", ("view_unknown", None, None, None, None, None, [])),
    ("9_left_spoon_l.mp4", ("task_unknown", None, None, None, None, None, [])),
    ("9_left_cap_z.mp4", ("side_unknown", None, None, None, None, None, [])),
    ("9_left_cap.mp4", ("token_count", None, None, None, None, None, [])),
    ("", ("token_count", None, None, None, None, None, [])),
]


def test_name_grammar(spark):
    df = spark.createDataFrame([(n,) for n, _ in NAMES], "name string")
    for r, (name, (reason, ordinal, view, task, side, repeat, applied)) in zip(text.parse_names(df, "name").collect(), NAMES, strict=True):
        p = r.parse
        assert (p.reason_code, p.subject_ordinal, p.view, p.task, p.side, p.repeat) == (reason, ordinal, view, task, side, repeat), name
        if reason == "ok":
            assert p.applied == applied, name


def test_labels_and_codes(spark):
    row = spark.range(1).select(
        text.capture_id(F.lit(7), F.lit("cap"), F.lit("l")).alias("a"), text.fourcc(F.lit(0x31637661)).alias("b"), text.shape_key(F.lit(1280), F.lit(720), F.lit(30.0), F.lit("avc1"), F.lit(90)).alias("c"),
        text.shape_key(F.lit(1280), F.lit(720), F.lit(29.97), F.lit("avc1"), F.lit(0)).alias("d"), text.stars(F.lit(0.004)).alias("e"), text.safe_component(F.lit("..")).alias("f"), text.extension_class(F.lit("a.MP4")).alias("g"),
        text.printable_path(F.lit("a\n\\b")).alias("h"), text.extension_class(F.lit("a")).alias("i"),
    ).first()
    assert list(row) == ["s07-cap-l", "avc1", "1280x720@30/avc1/rot90", "1280x720@29.97/avc1/rot0", "**", False, ".mp4", "a\\x0a\\\\b", "<none>"]


def test_exclusion_precedence_and_crosscheck(spark):
    reason = census.exclusion_reason(F.col("p"), F.col("e"), F.col("i"), F.col("s"), F.col("r"))
    df = spark.createDataFrame([("a\tb.mp4", False, True, True, True), ("a.mp4", False, False, True, True), ("a.mp4", True, False, True, True), ("a.mp4", True, True, True, True), ("a.mp4", True, True, False, False), ("a.txt", True, True, False, True), ("a.mp4", True, True, False, True)], "p string, e boolean, i boolean, s boolean, r boolean")
    assert [r.x for r in df.select(reason.alias("x")).collect()] == ["control_character_in_path", "broken_symlink", "path_escapes_root", "symlink_within_corpus", "not_a_regular_file", "unsupported_extension", None]
    rows = [("d1", 1, "canonical"), ("d1", 2, "canonical"), ("d2", 3, "canonical"), ("d3", 3, "canonical"), ("d4", 4, "canonical"), ("d1", 1, "excluded")]
    found = census.crosscheck(spark.createDataFrame(rows, "directory string, ordinal int, disposition string")).where("conflict").collect()
    assert sorted(r.directory for r in found) == ["d1", "d1", "d2", "d3"]


def test_family_rates_need_every_member(spark):
    df = spark.createDataFrame([("a", "left", 90, 30.0), ("a", "right", 80, 25.0), ("b", "left", 0, float("nan")), ("b", "above", 0, 30.0)], "id string, view string, frames int, fps double")
    rows = {r.id: r for r in census.families(df, ["id"], view="view", frames="frames", fps="fps").collect()}
    assert (rows["a"].min_fps, rows["a"].fps_spread, rows["b"].min_fps, rows["b"].frame_parity) == (25.0, 5.0, None, 1.0)
    assert rows["a"].frame_parity == pytest.approx(1 / 9)
    flags = spark.range(1).select(census.fact_flags(F.lit(0), F.lit(2), F.lit(float("nan")), F.lit(0), F.lit(45)).alias("f")).first().f
    assert flags == ["dimensions_invalid", "fps_invalid", "frame_count_invalid", "rotation_unexpected"]


def test_multisets(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (2,), (2,)], "x int")
    assert {(r.x, r.side) for r in census.multiset_differences(a, b).collect()} == {(1, "left"), (2, "right")}
    census.require_equal(a, a)
    with pytest.raises(ValueError):
        census.require_equal(a, b)


def test_quantile_by_index(spark):
    df = spark.createDataFrame([(k, float(v)) for k, vs in enumerate([(4, 1, 3, 2), (5, 5, 5, 1, 2, 9)]) for v in vs] + [(0, None)], "k int, v double")
    found = aggregate.nearest_index_quantiles(df, ["k"], "v", [0.0, 0.5, 0.9, 1.0]).orderBy("k").collect()
    assert [(r.q0, r.q50, r.q90, r.q100) for r in found] == [(1.0, 3.0, 4.0, 4.0), (1.0, 5.0, 9.0, 9.0)]


def test_finger_mobility_misses_either_limit(spark):
    rows = [("fine", 0.0, 70.0), ("fine", 50.0, -70.0), ("stiff", 0.0, 70.0), ("stiff", 30.0, 70.0), ("slow", 0.0, 50.0), ("slow", 50.0, 50.0), ("few", 0.0, 70.0), ("few", 90.0, None), ("none", None, 1.0)]
    found = aggregate.finger_mobility(spark.createDataFrame(rows, "k string, flexion double, speed double"), ["k"], "flexion", "speed").collect()
    problem, few = "finger mobility problem", "insufficient valid observations"
    assert {r.k: r.diagnostic for r in found} == {"fine": "good mobility", "stiff": problem, "slow": problem, "few": few, "none": few}
    assert {r.k: r.amplitude for r in found}["few"] is None


def test_interval_of_frames_after_an_offset(spark):
    for frames, kept in [(range(0, 8), [0, 1, 2]), (range(1, 9), [0, 1, 2]), ([3, 4], [0, 1]), ([3, 4, 5], [0, 1, 2])]:
        df = spark.createDataFrame([("a", f, 3, 2) for f in frames], "k string, frame int, expected int, lost int")
        assert sorted(r.frame for r in tables.interval_of_frames(df, ["k"], "frame", "expected", "lost").collect()) == kept


def test_summaries(spark):
    df = spark.createDataFrame([("v", 0, 1.0, "x"), ("v", 1, 3.0, "x"), ("w", 0, None, "x")], "video string, frame_idx int, m double, producer_version string")
    rows = {r.video: r for r in aggregate.per_recording(df, ["video"]).collect()}
    assert set(rows["v"].asDict()) == {"video", "m__mean", "m__median", "m__sd", "m__min", "m__max"} and rows["v"].m__mean == 2 and rows["w"].m__mean is None
    assert aggregate.variable_features(df, ["m"]) == ["m"] and aggregate.variable_features(df, ["m"], least=3) == []
    assert sorted(r.m for r in aggregate.median_impute(df, ["m"]).collect()) == [1.0, 3.0]
    assert df.agg(aggregate.cv("m").alias("c")).first().c == pytest.approx(0.5) and df.limit(1).agg(aggregate.cv("m").alias("c")).first().c is None


def test_temporal_jitter_does_not_bridge_gaps(spark):
    df = spark.createDataFrame([(0, f, float(f * f) / 1000, 0.0, 0.0) for f in (0, 1, 2, 5, 6)], "k int, frame int, x double, y double, z double")
    assert aggregate.temporal_jitter_mm(df, ["k"], "frame").first().jitter_mm == pytest.approx(2.0)


def test_reconcile_compare_and_sides(spark):
    a, b = spark.createDataFrame([("x", 1.0), ("y", 0.0)], "metric string, value double"), spark.createDataFrame([("x", 1.5), ("z", 2.0)], "metric string, value double")
    rows = {r.metric: (r.delta, r.pct) for r in tables.compare_runs(a, b).collect()}
    assert rows == {"x": (0.5, 50.0), "y": (None, None), "z": (None, None)}
    assert {r.metric: r.status for r in tables.reconcile(a, b, ["metric"]).collect()} == {"x": "matched", "y": "left_only", "z": "right_only"}
    hands = spark.createDataFrame([(0, "left", 0.9, 5.0), (0, "right", 0.8, 1.0), (1, "left", 0.3, 1.0), (2, "left", 0.9, 1.0), (2, "left", 0.9, 9.0)], "f int, label string, label_score double, wrist_x double")
    assert sorted((r.f, r.wrist_x, r.side) for r in tables.hand_sides(hands, ["f"]).collect()) == [(0, 1.0, "right"), (0, 5.0, "left"), (1, 1.0, ""), (2, 1.0, "left"), (2, 9.0, "right")]


@pytest.mark.parametrize("frames, kept", [([0, 1, 2, 3], [0, 1, 2]), ([1, 2, 3], [0, 1, 2]), ([1, 2, 5], [0, 1]), ([0, 1, 2], [0, 1, 2])])
def test_frame_base_is_zero_or_one(spark, frames, kept):
    df = spark.createDataFrame([(0, f, 3) for f in frames], "k int, frame int, expected int")
    assert sorted(r.frame for r in tables.interval_of_frames(df, ["k"], "frame", "expected").collect()) == kept


def test_bones(spark):
    df = spark.createDataFrame([(0, "a", 0.0, 0.0, 0.0), (0, "b", 3.0, 4.0, 0.0)], "frame int, keypoint string, x double, y double, z double")
    assert tables.bone_lengths(df, [("ab", "a", "b")], ["frame"]).first().length == 5.0
    assert len(schema.BONES) == 15 and len(schema.SYMMETRIC_BONES) == 6


def test_grades(spark):
    df = spark.createDataFrame([("max_bone_length_cv", 0.05), ("max_cheirality_rate", 0.2), ("min_throughput_fps", 1.0), ("n_views_median", None)], "metric string, value double")
    checks = grading.grade(df, grading.bands(spark))
    assert {r.metric: r.grade for r in checks.collect()} == {"max_bone_length_cv": "PASS", "max_cheirality_rate": "FAIL", "min_throughput_fps": "FAIL", "n_views_median": "WARN"}
    only = checks.where("metric in ('max_bone_length_cv', 'min_throughput_fps')").withColumn("k", F.lit(0))
    assert grading.verdict(only, ["k"]).first().verdict == "PASS" and len(grading.THRESHOLDS) == 17


def test_adjusted_p(spark):
    df = spark.createDataFrame([(0, 0.01), (0, 0.04), (0, 0.03), (0, None)], "k int, p double")
    assert sorted((round(r.p, 2), round(r.p_adjusted, 6)) for r in stats.benjamini_hochberg(df, ["k"], "p").where("p is not null").collect()) == [(0.01, 0.03), (0.03, 0.04), (0.04, 0.04)]


def test_csv_round_trip_and_legacy_presence(spark, tmp_path):
    df = spark.createDataFrame([("v", 0, 0.0, 0, 0.25, None, 0.5, 0.9), ("v", 1, 0.033, 1, 0.5, 0.5, 0.5, 0.0)], "video string, frame_idx int, timestamp_sec double, person_idx int, left_hand_0_x double, left_hand_0_y double, left_hand_0_z double, left_hand_0_conf double")
    landmarks.write_csv(df, str(tmp_path / "t"), order=["frame_idx"])
    back = landmarks.read_csv(spark, str(tmp_path / "t"))
    assert back.dtypes == df.dtypes and sorted(back.collect()) == sorted(df.collect())
    assert [(r.keypoint, r.conf) for r in landmarks.keypoint_long(back).collect()] == [("left_hand_0", 0.9)]
    assert landmarks.keypoint_long(back.drop("left_hand_0_conf")).first().conf == 1.0
    with pytest.raises(ValueError):
        landmarks.keypoint_long(spark.createDataFrame([(1,)], "other int"))


def test_world_wide_is_the_inverse_of_long(spark):
    names = ["a", "b"]
    row = ("v", 0, 0.0, 0) + (1.0, 2.0, 3.0, 0.5, 1.25, 3, 2, 1, 12.0) * 2
    df = spark.createDataFrame([row], schema.world_schema(names))
    wide = landmarks.world_wide(landmarks.world_long(df), names)
    assert [float(x) if isinstance(x, (int, float)) else x for x in wide.first()] == [float(x) if isinstance(x, (int, float)) else x for x in row]


def test_json_cells_and_flattening(spark):
    df = spark.createDataFrame([([1, 2], [3], [("hand", 0.5, 0.9, "left", 0.8, True)])], f"body_track_ages array<int>, hand_track_ages array<int>, detections {landmarks.DETECTIONS}")
    assert landmarks.read_diagnostics(landmarks.diagnostic_rows(df)).collect() == df.collect()
    flat = landmarks.flatten_json(spark.createDataFrame([('{"a": {"b": 1.5, "c": 2}, "d": 3}',)], "j string"), "j")
    assert {r.key: r.value for r in flat.collect()} == {"a.b": 1.5, "a.c": 2.0, "d": 3.0}


def test_corpus_walk_and_tampering(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.mp4").write_bytes(b"12")
    (tmp_path / "a.mp4").write_bytes(b"1")
    os.symlink(tmp_path / "gone", tmp_path / "link.mp4")
    rows = {r.source_path: r for r in corpus.walk(spark, str(tmp_path)).collect()}
    assert list(rows) == ["a.mp4", "d/b.mp4", "link.mp4"] and rows["link.mp4"].symlink and not rows["link.mp4"].exists
    os.unlink(tmp_path / "link.mp4")
    hashes = corpus.content_hashes(spark, str(tmp_path))
    manifest = spark.createDataFrame([(os.path.basename(r.path), r.sha256) for r in hashes.collect()], "name string, sha256 string")
    assert corpus.generation_faults(hashes, manifest).count() == 0
    (tmp_path / "a.mp4").write_bytes(b"2")
    assert [r.name for r in corpus.generation_faults(corpus.content_hashes(spark, str(tmp_path)), manifest).collect()] == ["a.mp4"]


def test_calibration_and_sessions(spark, tmp_path):
    good = {"name": "c1", "resolution": [1280, 720], "K": [[900, 0, 640], [0, 900, 360], [0, 0, 1]], "distortion": [0, 0, 0, 0, 0.5], "rvec": [0, 0, 0], "tvec": [0, 0, 1]}
    (tmp_path / "cal.json").write_text(json.dumps({"cameras": [good]}))
    section = grading.calibration_section(corpus.read_calibration(spark, str(tmp_path / "cal.json"))).first()
    assert (section.fx, section.cy, section.distortion_norm) == (900.0, 360.0, 0.5)
    (tmp_path / "bad.json").write_text(json.dumps({"cameras": [{**good, "K": [[1]]}]}))
    with pytest.raises(Exception, match="bad calibration"):
        corpus.read_calibration(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "s.json").write_text(json.dumps({"format_version": 1, "session_id": "s", "cameras": [{"name": "a", "file": "a.mp4", "sync_offset": 2}, {"name": "..", "file": "../b.mp4"}]}))
    assert [(r.camera, r.sync_offset, r.safe) for r in corpus.read_sessions(spark, str(tmp_path / "s.json")).collect()] == [("a", 2, True), ("..", 0, False)]


def test_parameter_grid(spark):
    grid = corpus.parameter_grid(spark, {"a": [1, 2], "b": ["3"], "unknown": [1]}, {"a": 0, "b": 0.5})
    assert [tuple(r) for r in grid.orderBy("run").collect()] == [(0, True, 0, 0.5), (1, False, 1, 3.0), (2, False, 2, 3.0)]


def test_sources_are_processed_by_a_function(spark):
    df = spark.createDataFrame([("a", 2), ("b", 0)], "video string, n int")
    out = corpus.for_each_source(df, lambda s: [(s["video"], i) for i in range(s["n"])], "video string, frame bigint")
    assert [tuple(r) for r in out.collect()] == [("a", 0), ("a", 1)]


def test_entry_runs(spark, sf_dir):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_metrics_summary(spark):
    assert (len(schema.metrics_schema()), len(schema.detail_schema())) == (28, 10)
    names = [f.name for f in schema.metrics_schema()]
    rows = [tuple({"video": "v", "frame_idx": i, "timestamp_sec": i / 30, "person_idx": 0, "body_carry": int(i in (2, 3, 6)), "body_jitter_px": float(i), "body_detected": int(i != 6)}.get(n) for n in names) for i in range(8)]
    r = aggregate.quality_summary(spark.createDataFrame(rows, schema.metrics_schema())).first()
    assert len(r) == 28 and (r.n_frames, r.body_detection_rate, r.body_jitter_median, r.body_jitter_p95, r.body_carry_pct, r.mean_carry_streak, r.hand_L_match_max) == (8, 0.875, 3.5, 6.65, 0.375, 1.5, None)


def test_registry_families_and_census(spark):
    base = [("a/1_left_cap_l.mp4", 10, 1280, 30.0), ("a/1_right_cap_l.mp4", 20, 1280, 25.0), ("a/1_left_cap_l (1).mp4", 5, 640, 30.0), ("b/odd.mp4", 1, 640, 30.0), ("b/readme.txt", 1, 0, 0.0)]
    df = spark.createDataFrame(base, "source_path string, size_bytes bigint, reported_width int, reported_avg_fps double")
    df = df.withColumns({"reported_height": F.lit(720), "reported_frame_count": F.lit(90), "reported_rotation_deg": F.lit(0), "reported_fourcc": F.lit("avc1"), "content_sha256": F.sha2("source_path", 256), "probe_ok": F.lit(True), "readable": F.lit(True)})
    yes = F.lit(True)
    df = census.dispositions(df.withColumn("exclusion", census.exclusion_reason(F.col("source_path"), yes, yes, ~yes, yes)))
    assets = census.asset_table(df.withColumn("probe_status", F.when(F.col("exclusion").isNull(), "opened").otherwise("skipped")))
    rows = {r.source_path: r for r in assets.collect()}
    assert len(assets.columns) == 24 and list(rows) == sorted(rows) and rows["b/odd.mp4"].disposition == "quarantined" and rows["b/readme.txt"].reason_code == "unsupported_extension"
    captures = census.capture_table(assets)
    c = captures.first()
    assert len(captures.columns) == 20 and (c.capture_id, c.n_assets, c.views, c.view_conflict, c.reported_fps_spread_hz, c.reported_resolution_agree) == ("s01-cap-l", 3, "left|right", True, 5.0, False)
    found = {(r.section, r.key): r.n for r in census.census(assets, captures).collect()}
    assert found["assets", "discovered"] == 5 and found["dispositions", "canonical"] == 3 and found["captures", "with_view_conflict"] == 1 and found["view_coverage", "2"] == 1 and found["captures", "frame_parity_within_5pct"] == 1


def test_report_files(spark, tmp_path):
    from motiondeck.sources import reports

    df = spark.createDataFrame([("max_bone_length_cv", 0.2), ("max_cheirality_rate", float("nan"))], "metric string, value double")
    checks = grading.grade(df, grading.bands(spark)).withColumn("k", F.lit(0))
    reports.write_report(str(tmp_path / "r"), grading.verdict(checks, ["k"]), checks)
    got = json.loads((tmp_path / "r.json").read_text())
    assert got["verdicts"][0]["verdict"] == "FAIL" and {c["metric"]: c["value"] for c in got["checks"]} == {"max_bone_length_cv": 0.2, "max_cheirality_rate": None}
    assert (tmp_path / "r.md").read_text().startswith("# FAIL\n") and sorted(p.name for p in tmp_path.iterdir()) == ["r.json", "r.md"]


def test_values_are_carried_for_a_while(spark):
    from motiondeck.operators import ordered

    df = spark.createDataFrame([(0, i, 1.0 if i == 1 else None) for i in range(5)], "k int, i int, v double")
    v, age = ordered.carried(ordered.series(["k"], ["i"]), "v", "i", 2)
    assert [(r.v, r.a) for r in df.select(v.alias("v"), age.alias("a")).collect()] == [(None, None), (1.0, 0), (1.0, 1), (1.0, 2), (None, None)]
