"""Schemes of points, doubtful tables, smoothed CSVs, and small functions of sources and tables."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motiondeck.functions import geometry as g
from motiondeck.functions import text
from motiondeck.operators import aggregate, fusion, gates, matching, schemes, stats, tables
from motiondeck.sources import corpus, landmarks, reports
from motiondeck.streaming import monitor

PEOPLE = "k int, person_idx int, points array<struct<x: double, y: double>>, scores array<double>"


def people(spark, n=133):
    points = [(float(i), float(i) / 2) for i in range(n)]
    both, left = [0.5] * n, [0.5] * 112 + [0.05] * (n - 112) if n == 133 else [0.5] * n
    odd = [2.0 if i == 91 else 0.5 for i in range(n)]
    bad = [(float("nan"), 1.0) if i == 92 else p for i, p in enumerate(points)]
    return spark.createDataFrame([(0, 0, points, both), (0, 1, points, left), (1, 0, bad, odd)], PEOPLE)


def test_bodies_of_both_schemes(spark):
    df = people(spark)
    arms = schemes.bodies(df, ["k"], "arms").first()
    assert [p.x for p in arms.points] == [5, 6, 7, 8, 9, 10, 96, 117, 100, 121, 108, 129] and arms.points[0].z == 0 and arms.vis == [0.5] * 12
    body = schemes.bodies(df, ["k"], "body").first()
    assert len(body.points) == 33 and [body.points[i].x for i in (0, 1, 6, 10, 17, 22, 29, 32)] == [0, 59, 68, 77, 111, 116, 19, 20]
    assert schemes.bodies(df, ["k"], "hands").count() == 0


def test_layout_of_17_points_has_no_hands(spark):
    df = people(spark, 17)
    arms = schemes.bodies(df, ["k"], "arms", 17).first()
    assert [p.x for p in arms.points] == [5, 6, 7, 8, 9, 10] + [0.0] * 6 and arms.vis == [0.5] * 6 + [0.0] * 6
    body = schemes.bodies(df, ["k"], "body", 17).first()
    assert [i for i, v in enumerate(body.vis) if v] == [0, 2, 5, 7, 8, 11, 12, 13, 14, 15, 16, 23, 24, 25, 26, 27, 28]
    assert schemes.hands(df, ["k"], "body", 17).count() == 0


def test_hands_with_sides_and_wrists(spark):
    rows = schemes.hands(people(spark), ["k"], "body").orderBy("k", "person_idx", "side").collect()
    assert [(r.k, r.person_idx, r.side, r.wrist) for r in rows] == [(0, 0, "left", 15), (0, 0, "right", 16), (0, 1, "left", 15), (1, 0, "left", 15), (1, 0, "right", 16)]
    assert rows[3].confidences[:3] == [1.0, 0.0, 0.5] and [p.x for p in rows[1].points][:2] == [112.0, 113.0] and rows[0].flag == 1.0
    assert {r.wrist for r in schemes.hands(people(spark), ["k"], "arms").collect()} == {4, 5} and {r.wrist for r in schemes.hands(people(spark), ["k"], "hands").collect()} == {None}


def test_doubtful_tables(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0, None), ("a", None, 5.0, None), ("b", 2.0, 5.0, None), ("b", None, 5.0, None), ("b", None, 5.0, None)], "video string, x double, y double, z double")
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "video string")
    found = {tuple(r)[:3] for r in aggregate.quality_findings(df, ["video"], ["x", "y", "z"], expected).collect()}
    assert found == {("a", "z", "missing"), ("b", "x", "missing"), ("b", "z", "missing"), (None, "y", "constant"), (None, "z", "constant"), ("c", None, "no_rows")}


def test_smoothed_csv_has_fixed_formats(spark, tmp_path):
    n = 14
    lines = ["video,frame_idx,timestamp_sec,person_idx,body_nose_x,body_nose_vis,left_hand_0_x,left_hand_0_conf,plain_x"]
    x = [math.sin(i / 3) for i in range(n)]
    for i in reversed(range(n)):
        lines.append(f"v,{i},{i / 30:.4f},0,{1e6 if i == 4 else x[i]},{0 if i == 4 else 1},{'' if i < 12 else 3.5},0.5,{'inf' if i == 2 else i}")
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    landmarks.smooth_csv(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"))
    text_ = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*.csv")))
    header, *rows = [r.split(",") for r in text_.strip().split("\n")]
    assert header == lines[0].split(",") and [r[1] for r in rows] == [str(i) for i in range(n)]
    expected = matching.savgol(np.array([np.nan if i == 4 else v for i, v in enumerate(x)]))
    assert [r[4] for r in rows] == [f"{v:.6f}" for v in expected]
    assert [r[6].strip('"') for r in rows] == [""] * 12 + ["3.500000"] * 2 and rows[4][5] == "0.000000" and rows[2][8] == "2.000000" and rows[0][2] == "0.000000"
    assert landmarks.smooth_landmarks(spark.createDataFrame([("v", 1)], "video string, frame_idx int")).count() == 1


def test_utc_stamps(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert spark.range(1).select(text.utc_stamp(F.timestamp_seconds(F.lit(1_700_000_000))).alias("s")).first().s == "2023-11-14T22:13:20Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_live_tracks_and_samples(spark):
    df = spark.createDataFrame([(1, False, 5), (2, True, 9), (3, False, 1)], "track_id int, carried boolean, age int")
    assert [r.track_id for r in tables.live_tracks(df, 3).collect()] == [1]
    many = spark.range(1000).withColumn("v", F.col("id") * 2)
    one, two = (sorted(r.id for r in tables.hash_sample(many.repartition(n), "id", 50).collect()) for n in (2, 7))
    assert one == two and len(one) == 50 and tables.hash_sample(many, "id", 5000).count() == 1000


def test_frame_rows_are_fractions_of_the_frame(spark):
    df = spark.createDataFrame([("v", 0, 0.0, 0, 200, 100, [(50.0, 25.0, 20.0, 1.5)])], "video string, frame_idx int, timestamp_sec double, person_idx int, frame_w int, frame_h int, points array<struct<x: double, y: double, z: double, vis: double>>")
    row = landmarks.frame_rows(df, ["body_nose"]).first()
    assert (row.body_nose_x, row.body_nose_y, row.body_nose_z, row.body_nose_vis) == (0.25, 0.25, 0.1, 1.0)


def test_landmark_files_leave_out_what_is_derived(spark):
    names = ["a.csv", "a_metrics.csv", "a_clinical_3d.csv", "a.txt", "a_smooth.csv", "a_kp_detail.csv", "clinic.csv"]
    found = spark.createDataFrame([(n,) for n in names], "n string").where(landmarks.landmark_files(F.col("n"))).collect()
    assert [r.n for r in found] == ["a.csv", "clinic.csv"]


def test_json_has_null_for_what_is_not_finite(spark, tmp_path):
    landmarks.write_json(spark.createDataFrame([(1, float("inf")), (2, 0.5)], "i int, x double").coalesce(1), str(tmp_path / "j"))
    rows = [json.loads(line) for p in (tmp_path / "j").glob("part-*") for line in p.read_text().splitlines()]
    assert rows == [{"i": 1, "x": None}, {"i": 2, "x": 0.5}]


def test_templates_have_a_row_a_recording(spark):
    scores, sessions = landmarks.templates(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "video string, frame_idx int"))
    assert scores.columns == ["video", "GRASSP", "UEMS", "SCIM"] and scores.count() == sessions.count() == 2 and sessions.first().patient_id is None


def test_calibration_comes_from_the_most_explicit_place(spark):
    df = spark.createDataFrame([("e", "m", "f"), (None, "m", "f"), (None, None, "f"), (None, None, None)], "e string, m string, f string")
    assert [r.p for r in df.select(corpus.calibration_path(F.col("e"), F.col("m"), F.col("f")).alias("p")).collect()] == ["e", "m", "f", None]


def test_sources_without_products(spark):
    sources, products = spark.createDataFrame([("a",), ("b",)], "stem string"), spark.createDataFrame([("a", "a.csv")], "stem string, path string")
    assert {tuple(r) for r in reports.missing_products(sources, products).collect()} == {("a", "a.csv"), ("b", None)}


def test_one_capture_a_table(spark):
    make = lambda *v: spark.createDataFrame([(x,) for x in v], "video string")
    assert gates.single_capture(make("a", "a")).count() == 2 and gates.single_capture(make()).count() == 0
    for bad in (("a", "b"), ("a", " "), ("a", None)):
        with pytest.raises(ValueError):
            gates.single_capture(make(*bad))


def test_last_row_of_a_frame_wins(spark):
    df = spark.createDataFrame([(1, 0, "old"), (1, 1, "new"), (2, 2, "only")], "frame int, pos int, v string")
    assert {(r.frame, r.v) for r in fusion.last_by_frame(df, ["frame"], "pos").collect()} == {(1, "new"), (2, "only")}


def test_overlap_of_boxes(spark):
    box = lambda *v: [F.lit(float(x)) for x in v]
    row = spark.range(1).select(g.iou(box(0, 0, 2, 2), box(1, 1, 3, 3)).alias("a"), g.iou(box(0, 0, 1, 1), box(2, 2, 3, 3)).alias("b"), g.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)).alias("c")).first()
    assert row.a == pytest.approx(1 / 7) and (row.b, row.c) == (0.0, 0.0)


def test_streamed_rows_land_in_files(spark, tmp_path):
    spark.range(20).withColumn("t", F.timestamp_seconds("id")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = monitor.landmark_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, kind="parquet")
    monitor.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_components_of_columns_that_do_not_vary(spark):
    df = spark.createDataFrame([(float(i), float(-2 * i), 7.0, float(i * i % 5), None if i == 3 else 1.0 * i) for i in range(12)], "a double, b double, c double, d double, e double")
    rows = stats.principal_components(df, ["a", "b", "c", "d"], 4).collect()
    data = np.array([(i, -2 * i, i * i % 5) for i in range(12)], float)
    expected = sorted(np.linalg.eigvalsh(np.corrcoef(data.T)), reverse=True)
    shares = [next(r.share for r in rows if r.component == k) for k in (1, 2, 3, 4)]
    assert np.allclose(shares, [*(np.array(expected) / 3), 0], atol=1e-9) and all(abs(r.loading) < 1e-9 for r in rows if r.feature == "c" and r.component < 3)
    assert stats.principal_components(df.limit(0), ["a", "b"], 2).count() == 0
    assert {r.feature for r in stats.principal_components(df, ["a", "e"], 2).collect()} == {"a", "e"}
