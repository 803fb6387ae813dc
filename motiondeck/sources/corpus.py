"""File corpora, calibrations and session manifests."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motiondeck.functions.text import safe_component

CALIBRATION = "name:string,resolution:array<int>,K:array<array<double>>,distortion:array<double>,rvec:array<double>,tvec:array<double>"
MANIFEST = "format_version int, session_id string, calibration string, cameras array<struct<name:string,file:string,sync_offset:int>>"


def walk(spark: SparkSession, root: str, skip: str | None = None) -> DataFrame:
    """(source_path, exists, inside, symlink, regular, size_bytes) of every entry below a folder that is not a folder.

    Listing is the driver's work, for a corpus of files on its own disk; links are reported, not followed.
    """
    root = os.path.realpath(root)
    rows = []

    def visit(folder: str) -> None:
        for e in sorted(os.scandir(folder), key=lambda e: e.name):
            if skip and os.path.realpath(e.path) == os.path.realpath(skip):
                continue
            if e.is_dir(follow_symlinks=False):
                visit(e.path)
            else:
                target = os.path.realpath(e.path)
                size = None if e.is_symlink() else e.stat().st_size
                rows.append((os.path.relpath(e.path, root).replace(os.sep, "/"), os.path.exists(e.path), os.path.commonpath([root, target]) == root, e.is_symlink(), os.path.isfile(e.path), size))

    visit(root)
    return spark.createDataFrame(rows, "source_path string, exists boolean, inside boolean, symlink boolean, regular boolean, size_bytes bigint")


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, length) of files, read and hashed by the executors."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def walk_levels(spark: SparkSession, root: str, skip: str | None = None, tasks: int = 64) -> DataFrame:
    """What ``walk`` gives, listed by tasks: each level of folders is one job, so a tree with many folders is many tasks' work.

    For a file system that all executors mount. A folder that cannot be read is a row of its own (``regular`` false, no size).
    """
    from motiondeck.operators.scratch import written

    root = os.path.realpath(root)
    gone = os.path.realpath(skip) if skip else None
    schema = "folder string, source_path string, exists boolean, inside boolean, symlink boolean, regular boolean, size_bytes bigint"

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for folder in batch["folder"]:
                try:
                    entries = sorted(os.scandir(folder), key=lambda e: e.name)
                except OSError:
                    rows.append((None, os.path.relpath(folder, root).replace(os.sep, "/"), True, True, False, False, None))
                    continue
                for e in entries:
                    if gone and os.path.realpath(e.path) == gone:
                        continue
                    if e.is_dir(follow_symlinks=False):
                        rows.append((e.path, None, None, None, None, None, None))
                    else:
                        target = os.path.realpath(e.path)
                        size = None if e.is_symlink() else e.stat().st_size
                        rows.append((None, os.path.relpath(e.path, root).replace(os.sep, "/"), os.path.exists(e.path), os.path.commonpath([root, target]) == root, e.is_symlink(), os.path.isfile(e.path), size))
            yield pd.DataFrame(rows, columns=["folder", "source_path", "exists", "inside", "symlink", "regular", "size_bytes"]).astype({"size_bytes": "Int64"})

    found, level = None, spark.createDataFrame([(root,)], "folder string")
    while True:
        listed = written(level.repartition(tasks).mapInPandas(visit, schema))
        files = listed.where("source_path is not null").drop("folder")
        found = files if found is None else found.unionAll(files)
        level = listed.where("folder is not null").select("folder")
        if level.isEmpty():
            return found


def chunked_hashes(files: DataFrame, root: str, chunk: int = 1 << 20) -> DataFrame:
    """files (source_path) with ``sha256``, read by tasks a chunk at a time, so files of any size fit; an unreadable file has an empty hash."""
    kinds = ", ".join(f"`{c}` {k}" for c, k in files.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["source_path"]:
                digest = hashlib.sha256()
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        while part := f.read(chunk):
                            digest.update(part)
                    out.append(digest.hexdigest())
                except OSError:
                    out.append("")
            yield batch.assign(sha256=out)

    return files.mapInPandas(run, f"{kinds}, sha256 string")


#: Endings of the artifacts of a recording, the longest first.
KINDS = {"clinical_windows_3d": "_clinical_windows_3d.csv", "movement_phases_3d": "_movement_phases_3d.csv", "clinical_windows": "_clinical_windows.csv", "movement_phases": "_movement_phases.csv", "clinical_3d": "_clinical_3d.csv", "clinical": "_clinical.csv", "kp_detail": "_kp_detail.csv", "metrics": "_metrics.csv", "smooth": "_smooth.csv"}


def by_kind(files: DataFrame, path: str = "source_path") -> DataFrame:
    """files with ``folder``, ``stem`` and ``kind``: the artifact that a CSV's ending names, else ``landmarks``; other files go."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    kind, stem = F.lit("landmarks"), F.expr(f"regexp_replace(regexp_extract({path}, '([^/]*)$', 1), '\\\\.csv$', '')")
    for k, ending in reversed(KINDS.items()):
        kind, stem = F.when(name.endswith(ending), k).otherwise(kind), F.when(name.endswith(ending), F.substr(name, F.lit(1), F.length(name) - len(ending))).otherwise(stem)
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return files.where(name.endswith(".csv")).withColumns({"folder": folder, "stem": stem, "kind": kind})


def recordings(files: DataFrame, path: str = "source_path") -> DataFrame:
    """A row a recording (folder, stem) with the path of each kind of artifact that it has; repeated ones are one, the first by path."""
    return by_kind(files, path).groupBy("folder", "stem").agg(*[F.min(F.when(F.col("kind") == k, F.col(path))).alias(k) for k in ("landmarks", *reversed(KINDS))])


def manifest_faults(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, fault, detail) of session manifests, whatever is wrong with them: a manifest without faults has no row.

    Faults of the file (position NULL): not_json, not_object, bad_version, no_cameras, cameras_not_array, bad_session_id, duplicate_name. Of a camera:
    not_object, name_not_string, unsafe_name, unsafe_file, bad_offset.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("__text"))
    v = F.try_parse_json("__text")
    get = lambda p, k: F.try_variant_get("__v", p, k)
    kind = lambda p: F.schema_of_variant(F.variant_get("__v", p, "variant"))
    df = text.withColumn("__v", v).withColumns({"__kind": F.when(F.col("__v").isNotNull(), F.schema_of_variant("__v"))})
    whole = F.col("__kind").startswith("OBJECT")
    df = df.withColumns({"__version": F.when(whole, kind("$.format_version")), "__cameras": F.when(whole, kind("$.cameras")), "__sid": F.when(whole, kind("$.session_id"))})
    df = df.withColumn("__list", F.when(F.col("__cameras").startswith("ARRAY"), get("$.cameras", "array<variant>")))
    df = df.withColumn("__names", F.transform("__list", lambda c: F.try_variant_get(c, "$.name", "string")))
    safe = lambda c: F.coalesce(safe_component(c), F.lit(False))
    fault = lambda name, detail=None: F.struct(F.lit(name).alias("fault"), (F.lit(None).cast("string") if detail is None else detail.cast("string")).alias("detail"))
    version = F.col("__version").isNotNull() & ~F.coalesce((F.col("__version") == "BIGINT") & (get("$.format_version", "bigint") == 1), F.lit(False))
    repeated = F.filter("__names", lambda n, i: n.isNotNull() & (F.array_position("__names", n) <= i))
    of_file = F.array(
        F.when(F.col("__v").isNull(), fault("not_json")), F.when(F.col("__v").isNotNull() & ~whole, fault("not_object", F.col("__kind"))), F.when(whole & version, fault("bad_version", F.to_json(F.struct(get("$.format_version", "string").alias("v"))))),
        F.when(whole & F.col("__cameras").isNull(), fault("no_cameras")), F.when(F.col("__cameras").isNotNull() & (F.col("__list").isNull() | (F.size("__list") == 0)), fault("cameras_not_array", F.col("__cameras"))),
        F.when(F.col("__sid").isNotNull() & ~((F.col("__sid") == "STRING") & safe(get("$.session_id", "string"))), fault("bad_session_id", get("$.session_id", "string"))), F.when(F.size(repeated) > 0, fault("duplicate_name", F.get(repeated, F.lit(0)))),
    )
    files = df.select("file", F.lit(None).cast("int").alias("position"), F.inline(F.filter(of_file, lambda f: f.isNotNull())))
    cams = df.select("file", F.posexplode("__list").alias("position", "c"))
    at = lambda p, k: F.try_variant_get("c", p, k)
    ckind = F.schema_of_variant("c")
    cams = cams.withColumns({"__o": ckind.startswith("OBJECT"), "__name": at("$.name", "string"), "__file": at("$.file", "string")})
    cams = cams.withColumns({"__nk": F.when(F.col("__o"), F.schema_of_variant(F.variant_get("c", "$.name", "variant"))), "__ok": F.when(F.col("__o"), F.schema_of_variant(F.variant_get("c", "$.sync_offset", "variant")))})
    text_name = F.coalesce(F.col("__nk") == "STRING", F.lit(False))
    of_camera = F.array(
        F.when(~F.col("__o"), fault("not_object", ckind)), F.when(F.col("__o") & ~text_name, fault("name_not_string", F.col("__nk"))), F.when(text_name & ~safe(F.col("__name")), fault("unsafe_name", F.col("__name"))),
        F.when(F.col("__o") & F.col("__file").rlike(r"(^/|(^|/)\.\.(/|$))"), fault("unsafe_file", F.col("__file"))), F.when(F.col("__ok").isNotNull() & at("$.sync_offset", "bigint").isNull(), fault("bad_offset", at("$.sync_offset", "string"))),
    )
    return files.unionAll(cams.select("file", "position", F.inline(F.filter(of_camera, lambda f: f.isNotNull()))))


def valid_calibration() -> Column:
    """Whether a camera's record has a 3 x 3 matrix with positive focal lengths and complete, finite parts."""
    k = F.col("K")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    square = (F.size(k) == 3) & F.forall(k, lambda r: (F.size(r) == 3) & F.forall(r, number))
    parts = (F.size("rvec") == 3) & (F.size("tvec") == 3) & F.forall("rvec", number) & F.forall("tvec", number) & F.size("distortion").isin(4, 5, 8, 12, 14)
    focal = (F.get(F.get(k, F.lit(0)), F.lit(0)) > 0) & (F.get(F.get(k, F.lit(1)), F.lit(1)) > 0)
    return F.coalesce(square & parts & focal & (F.size("resolution") == 2) & F.forall("resolution", lambda x: x > 0), F.lit(False))


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """A row a camera; fails when read if one is not valid."""
    df = spark.read.schema(f"cameras array<struct<{CALIBRATION}>>").json(path, multiLine=True)
    cameras = df.select(F.inline("cameras"))
    return cameras.withColumn("name", F.when(valid_calibration(), F.col("name")).otherwise(F.raise_error(F.concat(F.lit("bad calibration of camera "), F.coalesce("name", F.lit("?"))))))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, camera_pos, camera, file, sync_offset, calibration, safe) of manifests; other versions are left out."""
    df = spark.read.schema(MANIFEST).json(path, multiLine=True).where("format_version = 1")
    cameras = df.select("session_id", "calibration", F.posexplode("cameras").alias("camera_pos", "c"))
    safe = safe_component(F.col("c.name")) & safe_component(F.col("session_id")) & ~F.col("c.file").rlike(r"(^/|(^|/)\.\.(/|$))")
    return cameras.select("session_id", "camera_pos", F.col("c.name").alias("camera"), F.col("c.file").alias("file"), F.coalesce("c.sync_offset", F.lit(0)).alias("sync_offset"), "calibration", safe.alias("safe"))


def calibration_path(explicit: Column, manifest: Column, found: Column) -> Column:
    """Explicit before the manifest's before one that lies in the folder."""
    return F.coalesce(explicit, manifest, found)


def for_each_source(sources: DataFrame, process, schema: str) -> DataFrame:
    """A user's function over a table of sources: it gets a row as a dictionary and yields result rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for source in b.to_dict("records") for r in process(source)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return sources.mapInPandas(run, schema)


def parameter_grid(spark: SparkSession, sweep: dict[str, list], defaults: dict) -> DataFrame:
    """(run, baseline, each parameter): every combination of the sweep over the defaults, after the defaults alone.

    Names without a default are left out; values take the default's type.
    """
    known = {k: [type(defaults[k])(v) for v in vs] for k, vs in sweep.items() if k in defaults}
    rows = [(0, True, *defaults.values())]
    for n, values in enumerate(product(*known.values()), 1):
        rows.append((n, False, *{**defaults, **dict(zip(known, values, strict=True))}.values()))
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    return spark.createDataFrame(rows, "run bigint, baseline boolean, " + ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in defaults.items()))


def atomic_write(path: str, text: str) -> None:
    """A small text file, seen whole or not at all."""
    with open(f"{path}.part", "w", newline="") as f:
        f.write(text)
    os.replace(f"{path}.part", path)


def generation_faults(published: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, expected, found) of artifacts whose hash is not the manifest's (name, sha256) or that are gone."""
    found = published.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("sha256").alias("found"))
    return manifest.join(found, "name", "left").where("found is null or found <> sha256").select("name", F.col("sha256").alias("expected"), "found")
