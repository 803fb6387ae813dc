"""Readers and writers of landmark, world, metrics and diagnostic tables.

Schemas come from a header by the column-name grammar, never by inference; malformed cells become NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from motiondeck.functions.geometry import finite
from motiondeck.sources.schema import KEYS, WORLD_SUFFIXES, is_world

METRICS_SKIP = r"(metrics|kp_detail|diag|summary|smooth|feature_rank|clinical[_a-z0-9]*|movement_phases[_a-z0-9]*)\.csv$"
DETECTIONS = "array<struct<kind:string,det_score:double,hand_flag:double,handedness:string,handedness_score:double,accepted:boolean>>"


def header_schema(columns: list[str]) -> StructType:
    """Types by the column-name grammar: keys, counts and flags as integers, all else as doubles."""
    whole = ("_n_views", "_candidate_n_views", "_cheirality_ok")
    kind = lambda c: StringType() if c == "video" else IntegerType() if c in ("frame_idx", "person_idx") or c.endswith(whole) else DoubleType()
    return StructType([StructField(c, kind(c)) for c in columns])


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A CSV table with the types its header asks for; NaN, infinite and malformed numbers are NULL."""
    reader = spark.read.option("header", True)
    raw = reader.csv(path)
    wanted = schema or header_schema(raw.columns)
    cell = lambda f: finite(F.col(f.name).try_cast("double")) if isinstance(f.dataType, DoubleType) else F.col(f.name).try_cast(f.dataType)
    return raw.select(*[cell(f).alias(f.name) for f in wanted if f.name in raw.columns])


def keypoint_long(df: DataFrame) -> DataFrame:
    """(keys, keypoint, x, y, z, conf) of a 2D table, the first person only; without an evidence column, presence is evidence."""
    missing = [c for c in KEYS if c not in df.columns]
    if missing or is_world(df.columns):
        raise ValueError(f"not a 2D landmark table: {missing or 'world columns'}")
    names = list(dict.fromkeys(c[:-2] for c in df.columns if c.endswith("_x")))

    def evidence(n: str) -> Column:
        for e in ("vis", "conf"):
            if f"{n}_{e}" in df.columns:
                return F.col(f"{n}_{e}")
        return F.when(F.col(f"{n}_x").isNotNull(), 1.0).otherwise(0.0)

    points = [F.struct(F.lit(n).alias("keypoint"), *[F.col(f"{n}_{c}").alias(c) for c in "xyz"], evidence(n).alias("conf")) for n in names]
    return df.where("coalesce(person_idx, 0) = 0").select(*KEYS, F.inline(F.array(*points)))


def world_long(df: DataFrame) -> DataFrame:
    """(keys, keypoint, x_m, ..., triangulation_angle_deg) of a world table; a diagnostic it lacks is NULL."""
    names = [c[: -len("_x_m")] for c in df.columns if c.endswith("_x_m")]
    cell = lambda n, s: (F.col(f"{n}_{s}") if f"{n}_{s}" in df.columns else F.lit(None)).cast("double").alias(s)
    return df.select(*KEYS, F.inline(F.array(*[F.struct(F.lit(n).alias("keypoint"), *[cell(n, s) for s in WORLD_SUFFIXES]) for n in names])))


def world_wide(long: DataFrame, names: list[str]) -> DataFrame:
    """A row a frame with nine columns a keypoint, rounded as files have them."""
    digits = {"x_m": 6, "y_m": 6, "z_m": 6, "confidence": 4, "reproj_err_px": 3, "triangulation_angle_deg": 3}
    cells = [F.first(F.when(F.col("keypoint") == n, F.round(s, digits[s]) if s in digits else F.col(s)), True).alias(f"{n}_{s}") for n in names for s in WORLD_SUFFIXES]
    return long.groupBy(*KEYS).agg(*cells)


def frame_rows(frames: DataFrame, names: list[str]) -> DataFrame:
    """Wide rows from frames with an array of points in pixels: coordinates over the frame's size (z over its width), 6 decimals."""
    cells = []
    for i, n in enumerate(names):
        p = F.get("points", F.lit(i))
        cells += [F.round(p["x"] / F.col("frame_w"), 6).alias(f"{n}_x"), F.round(p["y"] / F.col("frame_h"), 6).alias(f"{n}_y"), F.round(p["z"] / F.col("frame_w"), 6).alias(f"{n}_z")]
        cells.append(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p["vis"])), 4).alias(f"{n}_vis"))
    return frames.select(*KEYS, *cells)


def diagnostic_rows(df: DataFrame) -> DataFrame:
    """A diagnostic table with its arrays as JSON cells; ``read_diagnostics`` undoes it."""
    return df.withColumns({c: F.to_json(c) for c in ("body_track_ages", "hand_track_ages", "detections")})


def read_diagnostics(df: DataFrame) -> DataFrame:
    return df.withColumns({"body_track_ages": F.from_json("body_track_ages", "array<int>"), "hand_track_ages": F.from_json("hand_track_ages", "array<int>"), "detections": F.from_json("detections", DETECTIONS)})


def landmark_files(names: Column) -> Column:
    """Whether a file name is a landmark table and not something derived from one."""
    return names.rlike(r"\.csv$") & ~names.rlike(METRICS_SKIP)


def write_csv(df: DataFrame, path: str, decimals: int | None = None, order: list[str] | None = None) -> None:
    """One sorted CSV folder; doubles with fixed decimals if asked, NULL as an empty cell."""
    if decimals is not None:
        df = df.select(*[F.when(F.col(f.name).isNotNull(), F.format_string(f"%.{decimals}f", F.col(f.name))).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema])
    df = df.orderBy(*order) if order else df
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; numbers that are not finite are NULL."""
    clean = df.select(*[finite(F.col(f.name)).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema])
    clean.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def flatten_json(df: DataFrame, cell: str) -> DataFrame:
    """(key, value) of a JSON text's scalars, keys dotted, whatever the nesting."""
    schema = df.select(F.schema_of_json_agg(cell)).first()[0] if hasattr(F, "schema_of_json_agg") else df.select(F.expr(f"schema_of_variant_agg(parse_json({cell}))")).first()[0]
    parsed = df.select(F.from_json(cell, schema.replace("OBJECT", "STRUCT")).alias("j"))

    def leaves(kind, path):
        if isinstance(kind, StructType):
            return [x for f in kind for x in leaves(f.dataType, [*path, f.name])]
        return [path]

    paths = leaves(parsed.schema["j"].dataType, [])
    cells = [F.struct(F.lit(".".join(p)).alias("key"), F.col("j." + ".".join(f"`{x}`" for x in p)).cast("double").alias("value")) for p in paths]
    return parsed.select(F.inline(F.array(*cells)))


def templates(recordings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Empty tables to fill in: clinical scores and sessions, a row a recording."""
    videos = recordings.select("video").distinct()
    null = F.lit(None)
    return videos.select("video", *[null.cast("double").alias(c) for c in ("GRASSP", "UEMS", "SCIM")]), videos.select("video", null.cast("string").alias("patient_id"), null.cast("date").alias("session_date"))


def smooth_landmarks(df: DataFrame, window: int = 11, order: int = 3) -> DataFrame:
    """A landmark table with its coordinates smoothed, recording by recording and person by person; a coordinate whose ``_vis`` or ``_conf`` is not above 0
    has no say. All other columns, the evidence too, are as they were."""
    from motiondeck.operators.matching import savgol_series

    coordinates = [c for c in df.columns if c.endswith(("_x", "_y", "_z"))]
    evidence = {c: e for c in coordinates for e in (f"{c[:-2]}_conf", f"{c[:-2]}_vis") if e in df.columns}
    keys = [k for k in ("video", "person_idx") if k in df.columns]
    return savgol_series(df, keys, ["frame_idx"], coordinates, window, order, evidence) if coordinates else df


def smooth_csv(spark: SparkSession, source: str, target: str, window: int = 11, order: int = 3) -> None:
    """A landmark CSV smoothed into another: numbers with six decimals, unknown ones blank, rows by recording, frame and person."""
    df = smooth_landmarks(read_csv(spark, source), window, order)
    write_csv(df, target, 6, [c for c in ("video", "frame_idx", "person_idx") if c in df.columns])
