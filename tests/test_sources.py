"""Sinks that survive replays, listing and hashing by tasks, artifacts by kind, manifests with faults."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from motiondeck.sources import corpus, sinks
from motiondeck.sources.schema import detail_schema, metrics_schema


def record(video, frame, person=0, **own):
    row = dict.fromkeys([c.strip().split(" ")[0] for c in ("video, frame_idx, timestamp_sec, person_idx, body, body_raw, body_vis, left, left_raw, right, right_raw, body_detected, body_det_score, n_hands_real, n_hands_synthetic, n_hands_recrop, hand_L_flag, hand_R_flag, bone_correction_px, angle_corrections_n, body_carry, body_carry_frames, hand_L_carry, hand_R_carry, hand_arm_match_dist_L, hand_arm_match_dist_R, inference_ms").split(",")])
    return tuple((row | {"video": video, "frame_idx": frame, "timestamp_sec": frame / 30, "person_idx": person} | own).values())


def points(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


@pytest.fixture
def records(spark):
    rows = [
        record("v", 0, body=points((0, 0), (3, 4)), body_raw=points((0, 1), (3, 4)), body_vis=[0.5, 0.25], body_detected=True, body_det_score=0.98765, hand_L_flag=0.0, hand_R_flag=0.6, inference_ms=12.345, body_carry=False, hand_L_carry=True),
        record("v", 1, left=points((1, 1)), hand_arm_match_dist_L=3.14159),
        record("v", 2, body=points((3, 4), (3, 4)), body_raw=points((3, 4)), body_vis=[1.0, 0.0], left=points((1, 2)), left_raw=points((1, 2))),
        record("v", 3, body=points((3, 4)), body_vis=[]), record("v", 2, person=1, body=points((0, 0))), record("w", 0, body=points((9, 9))),
    ]
    return spark.createDataFrame(rows, sinks.RECORD)


def test_metrics_rows(records):
    found = sinks.metrics_rows(records)
    assert found.schema.names == metrics_schema().names and len(found.columns) == 28
    rows = {(r.video, r.frame_idx, r.person_idx): r for r in found.collect()}
    first, second, third = rows["v", 0, 0], rows["v", 1, 0], rows["v", 2, 0]
    assert (first.body_detected, first.body_det_score, first.body_vis_mean, first.body_vis_min, first.body_jitter_px, first.body_smooth_delta_px) == (1, 0.9876 if first.body_det_score == 0.9876 else 0.9877, 0.375, 0.25, None, 1.0)
    assert (first.hand_L_flag, first.hand_R_flag, first.hand_L_carry, first.hand_R_carry, first.body_carry) == (None, 0.6, 1, None, 0)
    assert (second.body_detected, second.body_vis_mean, second.hand_arm_match_dist_L, second.body_smooth_delta_px) == (0, None, 3.14, 0.0)
    assert (third.body_jitter_px, third.hand_L_jitter_px, third.hand_L_smooth_delta_px, third.body_smooth_delta_px) == (5.0, 1.0, 0.0, 0.0)
    assert rows["v", 3, 0].body_jitter_px is None and rows["v", 2, 1].body_jitter_px is None and rows["v", 3, 0].body_vis_min is None


def test_detail_rows(records):
    found = sinks.detail_rows(records)
    assert found.schema.names == detail_schema().names
    rows = {(r.frame_idx, r.person_idx, r.part, r.kp_idx): r for r in found.where("x_smooth < 9").collect()}
    assert len(rows) == 8 and rows[0, 0, "body", 1].jitter_px is None and rows[0, 0, "body", 0].y_raw == 1.0
    assert (rows[2, 0, "body", 0].jitter_px, rows[2, 0, "body", 1].jitter_px, rows[2, 0, "body", 1].x_raw, rows[2, 0, "body", 0].visibility) == (5.0, 0.0, None, 1.0)
    assert rows[2, 0, "hand_L", 0].jitter_px == 1.0 and rows[2, 0, "hand_L", 0].visibility is None and rows[3, 0, "body", 0].jitter_px == 0.0


def test_a_batch_that_fails_and_runs_again_is_there_once(spark, records, tmp_path):
    for k, some in enumerate([records.where("frame_idx < 2"), records.where("frame_idx >= 2")]):
        some.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del k
    source = lambda: spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    root, failing = str(tmp_path / "out"), [True]

    def make(df):
        def detail():
            if failing[0]:
                raise RuntimeError("after the metrics were written")
            return sinks.detail_rows(df)

        class Lazy(dict):
            def items(self):
                yield "metrics", sinks.metrics_rows(df)
                yield "detail", detail()

        return Lazy()

    with pytest.raises(Exception, match="after the metrics"):
        sinks.append_stream(source(), make, root, str(tmp_path / "state")).awaitTermination(120)
    assert os.path.isdir(f"{root}/metrics/batch=0") and not os.path.isdir(f"{root}/detail/batch=0")
    failing[0] = False
    for _ in range(2):  # the second time there is nothing left to do
        sinks.append_stream(source(), make, root, str(tmp_path / "state")).awaitTermination(120)
    metrics = sinks.read_batches(spark, root, "metrics", metrics_schema())
    assert metrics.count() == records.count() and metrics.select("batch").distinct().count() == 2
    assert sorted(map(tuple, metrics.select("video", "frame_idx", "person_idx").collect())) == sorted(map(tuple, records.select("video", "frame_idx", "person_idx").collect()))
    assert sinks.read_batches(spark, root, "detail", detail_schema()).count() == 9


def test_diagnostics_have_json_cells(spark, records):
    arrays = spark.createDataFrame([("v", 0, [3, 1], [], [])], "video string, frame_idx int, body_track_ages array<int>, hand_track_ages array<int>, detections array<struct<kind:string,det_score:double>>")
    row = sinks.diagnostics(records, arrays).first()
    assert json.loads(row.body_track_ages) == [3, 1] and row.detections == "[]"


# corpora


def tree(root):
    rng = random.Random(1)
    for i in range(400):
        folder = root / "/".join(f"d{rng.randrange(4)}" for _ in range(rng.randrange(4)))
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{i}.csv").write_bytes(os.urandom(rng.randrange(50)))
    (root / "link.csv").symlink_to(root / "nowhere")
    (root / "out.csv").symlink_to("/etc/hostname")
    (root / "skip").mkdir()
    (root / "skip" / "x.csv").write_text("x")
    (root / "big.bin").write_bytes(b"ab" * (3 << 19))


def test_levels_are_the_walk_and_hashes_come_in_chunks(spark, tmp_path):
    tree(tmp_path)
    walked = corpus.walk(spark, str(tmp_path), str(tmp_path / "skip"))
    found = corpus.walk_levels(spark, str(tmp_path), str(tmp_path / "skip"), tasks=3)
    assert sorted(map(str, found.collect())) == sorted(map(str, walked.collect())) and found.count() == 403
    hashed = {r.source_path: r.sha256 for r in corpus.chunked_hashes(found, str(tmp_path), chunk=1000).collect()}
    assert hashed["big.bin"] == hashlib.sha256(b"ab" * (3 << 19)).hexdigest() and hashed["link.csv"] == ""
    assert all(h == hashlib.sha256((tmp_path / p).read_bytes()).hexdigest() for p, h in hashed.items() if p != "link.csv")


def test_artifacts_by_their_ending(spark):
    names = ["a/p1.csv", "a/p1_clinical.csv", "a/p1_clinical_windows.csv", "a/p1_clinical_windows_3d.csv", "a/p1_metrics.csv", "b/p1.csv", "p2_clinical_3d.csv", "a/p1.mp4", "a/p1_movement_phases.csv", "a/p1_kp_detail.csv"]
    files = spark.createDataFrame([(n,) for n in names], "source_path string")
    rows = {(r.folder, r.stem): r for r in corpus.recordings(files).collect()}
    assert set(rows) == {("a", "p1"), ("b", "p1"), ("", "p2")}
    one = rows["a", "p1"]
    assert (one.landmarks, one.clinical, one.clinical_windows, one.clinical_windows_3d, one.clinical_3d) == (names[0], names[1], names[2], names[3], None)
    assert rows["b", "p1"].clinical is None and rows["", "p2"].clinical_3d == "p2_clinical_3d.csv"


def test_every_fault_of_a_manifest_is_a_row(spark, tmp_path):
    camera = {"name": "a", "file": "a.mp4", "sync_offset": 2}
    texts = {
        "good": json.dumps({"format_version": 1, "session_id": "s", "cameras": [camera, {"name": "b"}]}), "old": json.dumps({"cameras": [camera]}), "broken": "{not json", "list": "[1]", "version": json.dumps({"format_version": 2, "cameras": [camera]}),
        "text_version": json.dumps({"format_version": "1", "cameras": [camera]}), "none": json.dumps({"format_version": 1}), "empty": json.dumps({"cameras": []}), "map": json.dumps({"cameras": {"a": 1}}), "sid": json.dumps({"session_id": "../x", "cameras": [camera]}),
        "twice": json.dumps({"cameras": [camera, camera]}), "odd": json.dumps({"cameras": [7, {"file": "x"}, {"name": 3}, {"name": "a/b"}, {"name": "c", "file": "../c.mp4"}, {"name": "d", "sync_offset": "x"}, {"name": ".."}]}),
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows = corpus.manifest_faults(spark, str(tmp_path)).select(F.regexp_extract("file", r"([^/]*)\.json$", 1).alias("f"), "position", "fault").collect()
    found = sorted((r.f, -1 if r.position is None else r.position, r.fault) for r in rows)
    assert found == sorted([
        ("broken", -1, "not_json"), ("list", -1, "not_object"), ("version", -1, "bad_version"), ("text_version", -1, "bad_version"), ("none", -1, "no_cameras"), ("empty", -1, "cameras_not_array"), ("map", -1, "cameras_not_array"),
        ("sid", -1, "bad_session_id"), ("twice", -1, "duplicate_name"), ("odd", 0, "not_object"), ("odd", 1, "name_not_string"), ("odd", 2, "name_not_string"), ("odd", 3, "unsafe_name"), ("odd", 4, "unsafe_file"), ("odd", 5, "bad_offset"), ("odd", 6, "unsafe_name"),
    ])
