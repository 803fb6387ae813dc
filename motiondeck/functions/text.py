"""File-name grammar, identifiers and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The closed vocabularies of recording names.
VIEWS = ["above", "left", "right"]
TASKS = ["cap", "coin", "glass", "key", "nut", "peg"]
SIDES = ["l", "r"]
TASK_REPAIRS = {"coini": "coin", "gcap": "cap", "gpeg": "peg", "grass": "glass"}
EXTENSIONS = ["mp4", "avi", "mov", "mkv", "webm", "flv"]

_SUFFIXES = r"(?i)(\.(?:" + "|".join(EXTENSIONS) + r"))+$"
_SUFFIX = r"(?i)\.(?:" + "|".join(EXTENSIONS) + r")(?=(?:\.(?:" + "|".join(EXTENSIONS) + r"))*$)"


def media_stem(name: Column) -> Column:
    """The name without its trailing media suffixes."""
    return F.regexp_replace(name, _SUFFIXES, "")


def media_suffixes(name: Column) -> Column:
    return F.regexp_count(name, F.lit(_SUFFIX))


def extension_class(name: Column) -> Column:
    """The last suffix in lower case if it is a medium's, else ``<unsupported>``, or ``<none>``."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    return F.when(suffix == "", "<none>").when(suffix.isin([f".{e}" for e in EXTENSIONS]), suffix).otherwise("<unsupported>")


def normal_stem(stem: Column) -> Column:
    """struct(stem, applied): lower case, trimmed, white space to one underscore, runs of underscores to one, none in front.

    applied lists, in order, the steps that changed the text.
    """
    steps = [
        ("case_folded", F.lower), ("outer_trimmed", lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), ("whitespace_collapsed", lambda c: F.regexp_replace(c, r"(?U)\s+", "_")),
        ("underscore_collapsed", lambda c: F.regexp_replace(c, "_+", "_")), ("leading_separator_stripped", lambda c: F.regexp_replace(c, "^_+", "")),
    ]
    applied, now = [], stem
    for name, step in steps:
        after = step(now)
        applied.append(F.when(after != now, F.lit(name)))
        now = after
    return F.struct(now.alias("stem"), F.array_compact(F.array(*applied)).alias("applied"))


def repeat_marker(stem: Column) -> Column:
    """struct(stem, repeat): a trailing (k), k > 0, taken off."""
    pattern = r"_?\(([0-9]+)\)$"
    k = F.coalesce(F.regexp_extract(stem, pattern, 1).try_cast("int"), F.lit(0))
    return F.struct(F.when(k > 0, F.regexp_replace(stem, pattern, "")).otherwise(stem).alias("stem"), k.alias("repeat"))


def parse_names(df: DataFrame, name: str, out: str = "parse") -> DataFrame:
    """df with the outcome of the whole grammar for a column of file names: a struct of subject_ordinal, view, task,
    side, repeat, reason_code, task_repair_from and applied.

    Four tokens: ordinal, view, task, side. The first failing rule gives the reason; then the parts are NULL.
    """
    df = df.withColumns({"__doubled": media_suffixes(F.col(name)) > 1, "__plain": normal_stem(media_stem(F.col(name)))})
    df = df.withColumn("__marked", repeat_marker(F.col("__plain.stem")))
    stem, repeat = F.col("__marked.stem"), F.col("__marked.repeat")
    df = df.withColumn("__t", F.when(stem == "", F.array().cast("array<string>")).otherwise(F.split(stem, "_")))
    df = df.withColumn("__four", F.size("__t") == 4)
    repairs = F.create_map(*[F.lit(x) for kv in TASK_REPAIRS.items() for x in kv])
    token = lambda i: F.when(F.col("__four"), F.get("__t", F.lit(i)))
    df = df.withColumn("__task", F.coalesce(repairs[token(2)], token(2)))
    task = F.col("__task")
    reason = (
        F.when((repeat == 0) & stem.endswith(")"), "repeat_marker_unrecognized").when(~F.col("__four"), "token_count")
        .when(~token(0).rlike(r"^[0-9]+$"), "subject_token_nonnumeric").when(~token(1).isin(VIEWS), "view_unknown").when(~task.isin(TASKS), "task_unknown")
        .when(token(3) == "", "side_missing").when(~token(3).isin(SIDES), "side_unknown").otherwise("ok")
    )
    df = df.withColumn("__reason", reason)
    ok = F.col("__reason") == "ok"
    repaired = F.coalesce(task != token(2), F.lit(False)) & (F.col("__reason") != "repeat_marker_unrecognized")
    more = F.array_compact(F.array(F.when(F.col("__doubled"), F.lit("media_suffix_doubled")), F.when(repeat > 0, F.lit("repeat_marker")), F.when(repaired, F.lit("task_repaired"))))
    found = F.struct(
        F.when(ok, token(0).try_cast("int")).alias("subject_ordinal"), F.when(ok, token(1)).alias("view"), F.when(ok, task).alias("task"), F.when(ok, token(3)).alias("side"),
        F.when(ok, repeat).alias("repeat"), F.col("__reason").alias("reason_code"), F.when(repaired, token(2)).otherwise("").alias("task_repair_from"), F.concat("__plain.applied", more).alias("applied"),
    )
    return df.withColumn(out, found).drop("__doubled", "__plain", "__marked", "__t", "__four", "__task", "__reason")


def capture_id(ordinal: Column, task: Column, side: Column) -> Column:
    return F.format_string("s%02d-%s-%s", ordinal, task, side)


def directory_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def safe_component(name: Column) -> Column:
    """Whether a name can be one path component: not empty, no separator, no parent, no control character."""
    return (name != "") & ~name.isin(".", "..") & ~name.rlike(r"[/\\\x00-\x1f\x7f]")


def fourcc(code: Column) -> Column:
    """The four characters of a codec number, low byte first; empty unless all are printable."""
    parts = [F.shiftright(code.cast("bigint"), 8 * i).bitwiseAND(F.lit(255)) for i in range(4)]
    printable = [p.between(33, 126) for p in parts]
    return F.when(printable[0] & printable[1] & printable[2] & printable[3], F.concat(*[F.char(p) for p in parts])).otherwise("")


def shape_key(width: Column, height: Column, fps: Column, code: Column, rotation: Column) -> Column:
    rate = F.regexp_replace(F.round(fps, 3).cast("string"), r"\.0$", "")
    return F.concat(width, F.lit("x"), height, F.lit("@"), rate, F.lit("/"), code, F.lit("/rot"), rotation)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def side_and_feature(name: Column) -> Column:
    side = F.regexp_extract(name, "^(left|right)_", 1)
    return F.struct(F.when(side != "", side).otherwise("both").alias("side"), F.regexp_replace(name, "^(left|right)_", "").alias("feature"))


def printable_path(path: Column) -> Column:
    """The path with backslash and control characters escaped, so that different paths stay different."""
    doubled = F.replace(path, F.lit("\\"), F.lit("\\\\"))
    for c in [*range(0x20), 0x7F]:
        doubled = F.replace(doubled, F.lit(chr(c)), F.lit(f"\\x{c:02x}"))
    return doubled


def artifact_tags(kind: str, sha256: str, qualification: str) -> dict[str, Column]:
    """The nine constant string columns that come last in every metric table."""
    values = [kind, sha256, "world-metric-3d", "m", "v2", "v1", "v2", qualification, "unverified"]
    from motiondeck.sources.schema import ARTIFACT_TAGS

    return {n: F.lit(v) for n, v in zip(ARTIFACT_TAGS, values, strict=True)}


def utc_stamp(at: Column) -> Column:
    """A time stamp as ISO text in UTC to the second, whatever the session's time zone."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
