"""The file census: dispositions, subject cross-check, capture families, histograms and invariants."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from motiondeck.functions.geometry import nominal_duration
from motiondeck.functions.text import capture_id, directory_of, extension_class, parse_names, shape_key


def exclusion_reason(path: Column, exists: Column, inside: Column, symlink: Column, regular: Column, utf8: Column | None = None) -> Column:
    """The first reason, in fixed precedence, why an entry is no corpus file; NULL if it is one."""
    utf8 = utf8 if utf8 is not None else F.lit(True)
    return (
        F.when(path.rlike(r"[\x00-\x1f\x7f]"), "control_character_in_path").when(~utf8, "path_not_utf8").when(~exists, "broken_symlink").when(~inside, "path_escapes_root")
        .when(symlink, "symlink_within_corpus").when(~regular, "not_a_regular_file").when(extension_class(path).isin("<none>", "<unsupported>"), "unsupported_extension")
    )


def dispositions(entries: DataFrame) -> DataFrame:
    """entries (source_path, exclusion, readable, probe_ok) with the parsed name, disposition and reason_code."""
    df = parse_names(entries.withColumn("__name", F.regexp_extract("source_path", r"([^/]*)$", 1)), "__name").drop("__name")
    reason = F.coalesce(F.col("exclusion"), F.when(~F.col("readable"), "read_error"), F.when(~F.col("probe_ok"), "probe_unreadable"))
    disposition = F.when(reason.isNotNull(), "excluded").when(F.col("parse.reason_code") == "ok", "canonical").otherwise("quarantined")
    return df.withColumns({"disposition": disposition, "reason_code": F.coalesce(reason, F.col("parse.reason_code"))})


def crosscheck(df: DataFrame, directory: str = "directory", ordinal: str = "ordinal") -> DataFrame:
    """df with ``conflict``: canonical rows of directories that hold several ordinals or share one with another directory."""
    pairs = df.where("disposition = 'canonical'").select(directory, ordinal).distinct()
    many = pairs.groupBy(directory).agg(F.count("*").alias("n")).where("n > 1").select(directory)
    shared = pairs.groupBy(ordinal).agg(F.count("*").alias("n")).where("n > 1").select(ordinal)
    bad = many.union(pairs.join(shared, ordinal, "left_semi").select(directory)).distinct().withColumn("__bad", F.lit(True))
    return df.join(bad, directory, "left").withColumn("conflict", F.coalesce("__bad", F.lit(False)) & (F.col("disposition") == "canonical")).drop("__bad")


def fact_flags(width: Column, height: Column, fps: Column, frames: Column, rotation: Column) -> Column:
    """Sorted flags of a container's facts that cannot be right."""
    bad_fps = fps.isNull() | F.isnan(fps) | (fps <= 0) | (fps == float("inf"))
    found = F.array(F.when(bad_fps, F.lit("fps_invalid")), F.when(frames <= 0, F.lit("frame_count_invalid")), F.when((width <= 0) | (height <= 0), F.lit("dimensions_invalid")), F.when(~rotation.isin(0, 90, 180, 270), F.lit("rotation_unexpected")))
    return F.array_sort(F.array_compact(found))


def families(df: DataFrame, keys: list[str], *, view: str, frames: str, fps: str) -> DataFrame:
    """Per family: members, distinct views, frame and rate ranges (NULL if any member's rate is unknown), agreement, parity."""
    known = F.count_if(F.col(fps).isNull() | F.isnan(fps) | (F.abs(F.col(fps)) == float("inf"))) == 0
    seconds = nominal_duration(F.col(frames), F.col(fps))
    all_seconds = F.count_if(seconds.isNull()) == 0
    lo, hi = F.min(frames), F.max(frames)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_assets"), F.count_distinct(view).alias("n_views"), lo.alias("min_frames"), hi.alias("max_frames"), F.when(known, F.min(fps)).alias("min_fps"), F.when(known, F.max(fps)).alias("max_fps"),
        F.when(known, F.max(fps) - F.min(fps)).alias("fps_spread"), F.when(all_seconds, F.max(seconds) - F.min(seconds)).alias("duration_spread_s"),
        F.when(hi > 0, (hi - lo) / F.when(hi > 0, hi)).otherwise(F.lit(1.0)).alias("frame_parity"),
    )


def histogram(df: DataFrame, value: Column, vocabulary: list[str] | None = None) -> DataFrame:
    """(value, n); every word of a closed vocabulary appears, with 0 if need be."""
    counts = df.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    if vocabulary is None:
        return counts
    words = df.sparkSession.createDataFrame([(v,) for v in vocabulary], "value string")
    return F.broadcast(words).join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def asset_id(path: Column | str, person: bytes = b"motiondeck-asset") -> Column:
    """A keyed 64-bit digest of a path. ``person`` (at most 16 bytes) keeps the digests of one registry apart from others'."""

    @F.pandas_udf(StringType())
    def digest(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: None if p is None else "a-" + hashlib.blake2b(p.encode("utf-8", "surrogateescape"), digest_size=8, person=person).hexdigest())

    return digest(path)


def multiset_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side without their like in the other, with ``side``; empty if both hold the same rows as often."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def require_equal(a: DataFrame, b: DataFrame) -> None:
    odd = multiset_differences(a, b).limit(3).collect()
    if odd:
        raise ValueError(f"the tables differ: {odd}")


def asset_table(df: DataFrame) -> DataFrame:
    """The published registry, a row an entry by path: what was parsed, what the header says, and what is odd about it.

    df has dispositions' columns, the container's facts, size_bytes and content_sha256. Rows that are excluded have no
    identity; those in quarantine keep the trace of normalisation.
    """
    ok = F.col("disposition") == "canonical"
    part = lambda c: F.when(ok, F.col(f"parse.{c}")).alias(c)
    facts = ["width", "height", "avg_fps", "frame_count", "rotation_deg", "fourcc"]
    reported = [F.col(f"reported_{f}") for f in facts]
    w, h, fps, n, rotation = (F.col(f"reported_{f}") for f in ("width", "height", "avg_fps", "frame_count", "rotation_deg"))
    steps = F.when(F.col("disposition") != "excluded", F.array_join(F.array_sort("parse.applied"), "|")).otherwise("")
    return df.withColumn("asset_id", asset_id("source_path")).orderBy("source_path").select(
        "asset_id", F.when(ok, capture_id(F.col("parse.subject_ordinal"), F.col("parse.task"), F.col("parse.side"))).alias("capture_id"), "disposition", "reason_code", "source_path",
        part("subject_ordinal"), part("view"), part("task"), part("side"), part("repeat"), steps.alias("normalizations"), "size_bytes", "content_sha256", *reported,
        F.round(nominal_duration(n, fps), 4).alias("nominal_duration_s"), F.array_join(fact_flags(w, h, fps, n, rotation), "|").alias("fact_flags"), "probe_status", F.lit("v1").alias("grammar_version"), F.lit("v1").alias("tool_version"),
    )


def capture_table(assets: DataFrame) -> DataFrame:
    """The published families, a row a capture by id, of the canonical assets."""
    fps, n = F.col("reported_avg_fps"), F.col("reported_frame_count")
    seconds = nominal_duration(n, fps)
    known = F.count_if(fps.isNull() | F.isnan(fps) | (F.abs(fps) == float("inf"))) == 0
    timed = F.count_if(seconds.isNull()) == 0
    one = lambda *c: F.count_distinct(F.struct(*c)) == 1
    found = assets.where("disposition = 'canonical'").groupBy("capture_id", "subject_ordinal", "task", "side").agg(
        F.count("*").alias("n_assets"), F.array_join(F.array_sort(F.collect_set("view")), "|").alias("views"), F.count_distinct("view").alias("n_views"), (F.count("*") > F.count_distinct("view")).alias("view_conflict"),
        F.min(n).alias("reported_frame_count_min"), F.max(n).alias("reported_frame_count_max"), F.when(known, F.min(fps)).alias("reported_fps_min"), F.when(known, F.max(fps)).alias("reported_fps_max"),
        F.when(known, F.round(F.max(fps) - F.min(fps), 4)).alias("reported_fps_spread_hz"), F.when(timed, F.round(F.min(seconds), 4)).alias("nominal_duration_min_s"), F.when(timed, F.round(F.max(seconds), 4)).alias("nominal_duration_max_s"),
        F.when(timed, F.round(F.max(seconds) - F.min(seconds), 4)).alias("nominal_duration_spread_s"), one("reported_width", "reported_height").alias("reported_resolution_agree"), one("reported_rotation_deg").alias("reported_rotation_agree"),
    )
    return found.orderBy("capture_id").withColumns({"grammar_version": F.lit("v1"), "tool_version": F.lit("v1")})


def census(assets: DataFrame, captures: DataFrame) -> DataFrame:
    """The aggregate census as (section, key, n): counts, sums and histograms; it names no file and no subject."""
    opened = assets.where("probe_status = 'opened'")
    rows = lambda df, section, value: histogram(df, value).select(F.lit(section).alias("section"), F.col("value").cast("string").alias("key"), F.col("n").cast("double").alias("n"))
    multi = captures.where("n_views > 1")
    parity = F.when(F.col("reported_frame_count_max") > 0, (F.col("reported_frame_count_max") - F.col("reported_frame_count_min")) / F.col("reported_frame_count_max")).otherwise(1.0)
    totals = assets.agg(
        F.count("*").alias("discovered"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("total_bytes"), F.count_distinct(F.when(F.col("content_sha256") != "", F.col("content_sha256"))).alias("distinct_sha256"),
        F.sum(F.when(F.col("probe_status") == "opened", F.greatest("reported_frame_count", F.lit(0)))).alias("reported_frames_total"), F.round(F.sum("nominal_duration_s") / 60, 4).alias("nominal_minutes_total"),
    )
    families_ = captures.agg(F.count("*").alias("total"), F.count_if("view_conflict").alias("with_view_conflict"), F.count_if(F.col("n_views") > 1).alias("multi_view"))
    parities = multi.agg(F.count_if("reported_resolution_agree").alias("same_resolution"), F.count_if(parity <= 0.05).alias("frame_parity_within_5pct"), F.count_if(parity <= 0.20).alias("frame_parity_within_20pct"))
    flat = lambda df, section: df.select(F.lit(section).alias("section"), F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("n")) for c in df.columns])))
    mixing = opened.groupBy(directory_of(F.col("source_path")).alias("d")).agg(F.count_distinct("reported_fourcc").alias("k")).agg(F.count_if(F.col("k") > 1).alias("directories_mixing_codecs"))
    shape = shape_key(F.col("reported_width"), F.col("reported_height"), F.col("reported_avg_fps"), F.col("reported_fourcc"), F.col("reported_rotation_deg"))
    out = flat(totals, "assets")
    for part in (
        rows(assets, "dispositions", F.col("disposition")), rows(assets, "reason_codes", F.col("reason_code")), rows(assets.select(F.explode(F.split("normalizations", r"\|")).alias("s")).where("s <> ''"), "normalization", F.col("s")),
        rows(assets, "extension_case", extension_class(F.col("source_path"))), rows(opened, "shapes", shape), rows(assets.where("disposition = 'canonical'"), "rotation_by_view", F.concat_ws("/", "view", "reported_rotation_deg")),
        rows(captures, "view_coverage", F.col("n_views")), flat(families_, "captures"), flat(parities, "captures"), flat(mixing, "assets"),
    ):
        out = out.unionAll(part)
    return out
