"""Sinks of per-frame metrics, per-keypoint details and diagnostics, for tables and for streams.

A stream writes each micro-batch into a folder of its own number (``batch=<id>``), all tables of the batch one after the other; a batch that
is run again after a failure replaces its folders, so nothing is there twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motiondeck.operators.ordered import jitter, smoothing_change
from motiondeck.sources.landmarks import diagnostic_rows
from motiondeck.sources.schema import KEYS, detail_schema, metrics_schema

PARTS = {"body": "body", "hand_L": "left", "hand_R": "right"}
POINTS = "array<struct<x: double, y: double>>"
#: A person's frame as the pipeline leaves it: points in pixels, raw and smoothed, and what the stages report.
RECORD = (
    f"video string, frame_idx int, timestamp_sec double, person_idx int, body {POINTS}, body_raw {POINTS}, body_vis array<double>, left {POINTS}, left_raw {POINTS}, right {POINTS}, right_raw {POINTS}, "
    "body_detected boolean, body_det_score double, n_hands_real int, n_hands_synthetic int, n_hands_recrop int, hand_L_flag double, hand_R_flag double, bone_correction_px double, angle_corrections_n int, "
    "body_carry boolean, body_carry_frames int, hand_L_carry boolean, hand_R_carry boolean, hand_arm_match_dist_L double, hand_arm_match_dist_R double, inference_ms double"
)


def metrics_rows(records: DataFrame) -> DataFrame:
    """The metrics table of records: counts and flags as they are, confidences and figures with the decimals that files have, and each part's
    jitter against the person's last frame that had it with as many points."""
    df = records
    for part, points in PARTS.items():
        df = jitter(df, ["video", "person_idx"], ["frame_idx"], points).withColumnRenamed("jitter_px", f"{part}_jitter_px")
    n = F.size("body_vis")
    some = F.col("body_vis").isNotNull() & (n > 0)
    delta = lambda points: F.when(F.col(points).isNotNull() & F.col(f"{points}_raw").isNotNull(), F.round(smoothing_change(F.col(f"{points}_raw"), F.col(points)), 2))
    made = {
        "timestamp_sec": F.round("timestamp_sec", 4), "body_detected": F.coalesce("body_detected", F.lit(False)).cast("int"), "body_det_score": F.round("body_det_score", 4),
        "body_vis_mean": F.when(some, F.round(F.aggregate("body_vis", F.lit(0.0), lambda a, x: a + x) / n, 4)), "body_vis_min": F.when(some, F.round(F.array_min("body_vis"), 4)),
        "hand_L_flag": F.when(F.col("hand_L_flag") != 0, F.round("hand_L_flag", 4)), "hand_R_flag": F.when(F.col("hand_R_flag") != 0, F.round("hand_R_flag", 4)),
        "body_smooth_delta_px": F.coalesce(delta("body"), F.lit(0.0)), "hand_L_smooth_delta_px": delta("left"), "hand_R_smooth_delta_px": delta("right"), "bone_correction_px": F.round("bone_correction_px", 2),
        "body_carry": F.coalesce("body_carry", F.lit(False)).cast("int"), "hand_L_carry": F.col("hand_L_carry").cast("int"), "hand_R_carry": F.col("hand_R_carry").cast("int"),
        "hand_arm_match_dist_L": F.round("hand_arm_match_dist_L", 2), "hand_arm_match_dist_R": F.round("hand_arm_match_dist_R", 2), "inference_ms": F.round("inference_ms", 2),
    }
    kinds = {f.name: f.dataType for f in metrics_schema()}
    return df.select(*[made.get(c, F.col(c)).cast(k).alias(c) for c, k in kinds.items()])


def detail_rows(records: DataFrame) -> DataFrame:
    """A row a keypoint and part: raw and smoothed place, visibility, and how far the point moved since the person's last frame that had the
    part with at least as many points."""
    w = Window.partitionBy("video", "person_idx").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1)
    df = records.withColumns({f"__{p}": F.last(p, True).over(w) for p in PARTS.values()})

    def cell(part: str, points: str) -> Column:
        vis = F.col("body_vis") if part == "body" else F.lit(None).cast("array<double>")
        whole = F.when(F.size(f"__{points}") >= F.size(points), F.col(f"__{points}"))
        return F.transform(points, lambda p, i: F.struct(F.lit(part).alias("part"), i.alias("kp_idx"), F.get(F.col(f"{points}_raw"), i).alias("raw"), p.alias("p"), F.get(vis, i).alias("vis"), F.get(whole, i).alias("q")))

    cells = [cell(part, points) for part, points in PARTS.items()]
    empty = F.array().cast("array<struct<part: string, kp_idx: int, raw: struct<x: double, y: double>, p: struct<x: double, y: double>, vis: double, q: struct<x: double, y: double>>>")
    rows = df.select("frame_idx", "person_idx", F.explode(F.concat(*[F.coalesce(c, empty) for c in cells])).alias("r"))
    moved = F.hypot(F.col("r.p.x") - F.col("r.q.x"), F.col("r.p.y") - F.col("r.q.y"))
    found = rows.select("frame_idx", "person_idx", "r.part", "r.kp_idx", F.round("r.raw.x", 2).alias("x_raw"), F.round("r.raw.y", 2).alias("y_raw"), F.round("r.p.x", 2).alias("x_smooth"), F.round("r.p.y", 2).alias("y_smooth"), F.round("r.vis", 4).alias("visibility"), F.round(moved, 2).alias("jitter_px"))
    return found.select(*[F.col(f.name).cast(f.dataType) for f in detail_schema()])


def write_batch(tables: dict[str, DataFrame], root: str, batch: int, header: bool = True, kind: str = "csv") -> None:
    """Each table into ``root/<name>/batch=<batch>``, in place of whatever an earlier attempt left there."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", header).option("emptyValue", "").format(kind).save(f"{root}/{name}/batch={batch}")


def append_stream(stream: DataFrame, make: Callable[[DataFrame], dict[str, DataFrame]], root: str, checkpoint: str, kind: str = "csv", each: str | None = None):
    """A running query that writes the tables made of each micro-batch; without ``each`` it takes what is there and ends."""

    def run(df: DataFrame, batch: int) -> None:
        held = df.persist()
        try:
            write_batch(make(held), root, batch, kind=kind)
        finally:
            held.unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=each) if each else writer.trigger(availableNow=True)).start()


def read_batches(spark: SparkSession, root: str, name: str, schema, kind: str = "csv") -> DataFrame:
    """The rows of all batches of a table, with the number of their batch."""
    return spark.read.schema(schema).option("header", True).format(kind).load(f"{root}/{name}")


def diagnostics(records: DataFrame, arrays: DataFrame) -> DataFrame:
    """The diagnostic table of frames: keys of the records and the arrays of their frame as JSON cells."""
    keys = [k for k in KEYS if k != "person_idx"]
    return diagnostic_rows(records.select(*keys).distinct().join(arrays, ["video", "frame_idx"]))
