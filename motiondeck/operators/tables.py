"""Joins, reshapes and set operations over feature, score and session tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motiondeck.sources.schema import SYMMETRIC_BONES


def left_without_collisions(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with right's columns that left has not."""
    return left.join(right.select(*keys, *[c for c in right.columns if c not in left.columns]), keys, "left")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status): matched, left_only or right_only, over distinct keys."""
    a, b = left.select(*keys).distinct().withColumn("__l", F.lit(True)), right.select(*keys).distinct().withColumn("__r", F.lit(True))
    status = F.when(F.col("__l") & F.col("__r"), "matched").when(F.col("__l"), "left_only").otherwise("right_only")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def with_counts(all_keys: DataFrame, counts: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    return all_keys.join(counts, keys, "left").withColumn(count, F.coalesce(count, F.lit(0)))


def mean_with_sd(summary: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, value, value_sd) from ``<feature>__mean`` and ``<feature>__sd`` columns, in one pass."""
    names = [c[: -len("__mean")] for c in summary.columns if c.endswith("__mean")]
    sd = lambda n: F.col(f"{n}__sd") if f"{n}__sd" in summary.columns else F.lit(None)
    cells = [F.struct(F.lit(n).alias("feature"), F.col(f"{n}__mean").cast("double").alias("value"), sd(n).cast("double").alias("value_sd")) for n in names]
    return summary.select(*keys, F.inline(F.array(*cells)))


def longer(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(keys, features, "feature", "value")


def stat_wider(long: DataFrame, keys: list[str], stats: list[str]) -> DataFrame:
    """(keys, feature, a column a stat) from feature__stat names."""
    parts = F.split("feature", "__")
    df = long.withColumns({"stat": F.get(parts, F.lit(1)), "feature": F.get(parts, F.lit(0))})
    return df.groupBy(*keys, "feature").agg(*[F.max(F.when(F.col("stat") == s, F.col("value"))).alias(s) for s in stats])


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, a, b, delta, pct) of two tables (metric, value); percent has one decimal, NULL where a is 0 or missing."""
    j = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric", "full_outer")
    j = j.withColumn("delta", F.col("b") - F.col("a"))
    return j.withColumn("pct", F.when(F.col("a") != 0, F.round(F.col("delta") / F.abs(F.when(F.col("a") != 0, F.col("a"))) * 100, 1)))


def baseline_agreement(measured: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, expected, value, abs_error) of every baseline metric."""
    j = baseline.select("metric", F.col("value").alias("expected")).join(measured.select("metric", "value"), "metric", "left")
    return j.withColumn("abs_error", F.abs(F.col("value") - F.col("expected")))


def top_features(changes: DataFrame, keys: list[str], n: int = 6) -> DataFrame:
    """The n features of widest range a key; ties by name."""
    spread = changes.groupBy(*keys, "feature").agg((F.max("value") - F.min("value")).alias("range")).where("range > 0")
    w = Window.partitionBy(*keys).orderBy(F.col("range").desc(), "feature")
    return spread.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def change_summary(deltas: DataFrame, keys: list[str], session: str) -> DataFrame:
    """(keys, n_sessions, n_flagged, worst_feature, worst_pct): the largest relative change of each key."""
    size = F.when(F.col("pct_change").isNotNull(), F.struct(F.abs("pct_change"), "feature"))
    return deltas.groupBy(*keys).agg(F.count_distinct(session).alias("n_sessions"), F.count_if("flagged").alias("n_flagged"), F.max_by("feature", size).alias("worst_feature"), F.max_by("pct_change", size).alias("worst_pct"))


def enough_values(df: DataFrame, feature: str, value: str, least: int = 2) -> DataFrame:
    """Rows of features with ``least`` finite values."""
    n = F.count(F.when(~F.isnan(value), F.col(value))).over(Window.partitionBy(feature))
    return df.withColumn("__n", n).where(F.col("__n") >= least).drop("__n")


def primary(df: DataFrame, keys: list[str], size: Column, order: str) -> DataFrame:
    """One row a key: the largest, the first of equals."""
    w = Window.partitionBy(*keys).orderBy(size.desc_nulls_last(), order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def oldest_tracks(df: DataFrame, keys: list[str], least_age: int, most: int) -> DataFrame:
    """Up to ``most`` tracks a key, oldest first; ties by id."""
    w = Window.partitionBy(*keys).orderBy(F.col("age").desc(), "track_id")
    return df.where(F.col("age") >= least_age).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def observed_only(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that were not carried, with ``position`` numbered anew from 0."""
    w = Window.partitionBy(*keys).orderBy("position")
    return df.where("not carried").withColumn("position", F.row_number().over(w) - 1)


def evenly(df: DataFrame, order: list[str], most: int, coarse: Column) -> DataFrame:
    """At most ``most`` rows, spaced evenly by rank.

    coarse never falls as the order rises (such as the day of a time): rows are ranked within its values, of which only the counts are put in one order."""
    df = df.withColumn("__c", coarse)
    counts = df.groupBy("__c").agg(F.count("*").alias("__k"))
    before = counts.select(F.col("__c").alias("__b"), (F.sum("__k").over(Window.orderBy("__c")) - F.col("__k")).alias("__before"), F.sum("__k").over(Window.partitionBy()).alias("__all"))
    rank = F.row_number().over(Window.partitionBy("__c").orderBy(*order)) - 1 + F.col("__before")
    ranked = df.join(before, F.col("__c").eqNullSafe(F.col("__b"))).withColumn("__r", rank)
    last, steps = F.col("__all") - 1, max(1, most - 1)
    # row r is wanted if some step i has i * last / steps, to the nearest whole number (halves to the even one), = r
    at = F.col("__r") * steps / last
    hit = (F.rint(F.floor(at) * last / steps) == F.col("__r")) | (F.rint(F.ceil(at) * last / steps) == F.col("__r"))
    few = F.col("__all") <= most
    wanted = few | (F.col("__r") == 0) if most == 1 else few | F.coalesce(hit, F.lit(False))
    return ranked.where(wanted if most > 0 else F.lit(False)).drop("__c", "__b", "__before", "__all", "__r")


def hash_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """``most`` rows by smallest hash of a key: the same ones at every run."""
    return df.orderBy(F.xxhash64(key), key).limit(most)


def interval_of_frames(df: DataFrame, keys: list[str], frame: str, expected: str, offset: str | None = None) -> DataFrame:
    """Rows whose frame is one of the expected ones after ``offset`` discarded ones, for indices that start at 0 or at 1, whichever
    covers more (if equal, 0 if the series has a frame 0); counted from the start of the interval."""
    w = Window.partitionBy(*keys)
    has_zero = F.count_if(F.col(frame) == 0).over(w) > 0
    if offset is not None:
        df = df.withColumns({"__zero": has_zero, frame: F.col(frame) - F.col(offset)})
        has_zero = F.col("__zero")
    f = F.col(frame)
    zero, one = F.count_if((f >= 0) & (f < F.col(expected))).over(w), F.count_if((f >= 1) & (f <= F.col(expected))).over(w)
    base = F.when(zero > one, 0).when(one > zero, 1).when(has_zero, 0).otherwise(1)
    df = df.withColumn("__base", base)
    return df.where((f >= F.col("__base")) & (f < F.col(expected) + F.col("__base"))).withColumn(frame, f - F.col("__base")).drop("__base", "__zero")


def fusable_frames(counts: DataFrame, keys: list[str], n: str, least: int = 2) -> DataFrame:
    """(keys, expected): the least-th largest of the cameras' frame counts."""
    return counts.groupBy(*keys).agg(F.get(F.sort_array(F.collect_list(n), asc=False), F.lit(least - 1)).alias("expected"))


def shared_corners(df: DataFrame, least: int = 6) -> DataFrame:
    """(session, frame, camera_a, camera_b, shared): frames in which two cameras saw ``least`` corners in common."""
    a, b = df.select("session", "frame", "corner", F.col("camera").alias("camera_a")), df.select("session", "frame", "corner", F.col("camera").alias("camera_b"))
    pairs = a.join(b, ["session", "frame", "corner"]).where("camera_a < camera_b")
    return pairs.groupBy("session", "frame", "camera_a", "camera_b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def hand_sides(df: DataFrame, keys: list[str], sure: float = 0.6) -> DataFrame:
    """df (label, label_score, wrist_x) with ``side``: the labels if all are sure and different, blank for a lone unsure
    hand, else by position from left to right."""
    w = Window.partitionBy(*keys)
    n, ok = F.count("*").over(w), F.count_if((F.col("label_score") >= sure) & F.col("label").isNotNull()).over(w)
    df = df.withColumns({"__n": n, "__ok": ok, "__kinds": F.size(F.collect_set("label").over(w)), "__rank": F.row_number().over(w.orderBy("wrist_x"))})
    by_place = F.when(F.col("__rank") == 1, "left").otherwise("right")
    side = F.when((F.col("__ok") == F.col("__n")) & (F.col("__kinds") == F.col("__n")), F.col("label")).when(F.col("__n") == 1, "").otherwise(by_place)
    return df.withColumn("side", side).drop("__n", "__ok", "__kinds", "__rank")


def scored(features: DataFrame, scores: DataFrame, key: str, names: list[str]) -> tuple[DataFrame, list[str]]:
    """Features of recordings that have scores, with these, and which of the features vary among them (three known values, a deviation)."""
    joined = features.join(scores.select(key, *names), key)
    from motiondeck.operators.aggregate import variable_features

    return joined, variable_features(joined, [c for c in features.columns if c != key], least=3, most_na=1.0)


def dated(features: DataFrame, sessions: DataFrame, key: str, patient: str, date: str) -> DataFrame:
    """Features of recordings that have a session, with its patient and date."""
    return features.join(sessions.select(key, patient, date), key)


def longitudinal(long: DataFrame, patient: str, date: str, tie: str) -> DataFrame:
    """long (feature, value) with ``position``, a row's place in its patient's feature by date."""
    return long.withColumn("position", F.row_number().over(Window.partitionBy(patient, "feature").orderBy(date, tie)))


def top_pairs(correlations: DataFrame, n: int = 10, value: str = "rho") -> DataFrame:
    """The n pairs (feature, score) of the largest known correlation by size; ties by name."""
    return correlations.where(F.col(value).isNotNull()).orderBy(F.abs(value).desc(), "feature", "score").limit(n)


def stacked(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables by column name; a column that a table has not is NULL there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def recode(column: Column, labels: dict[str, str]) -> Column:
    """The label of a value, or the value where it has none."""
    found = F.lit(None).cast("string")
    for k, v in labels.items():
        found = F.when(column == k, v).otherwise(found)
    return F.coalesce(found, column)


def symmetry_by_bone(lengths: DataFrame, keys: list[str], frame: str, pairs: list[tuple[str, str]] = SYMMETRIC_BONES) -> DataFrame:
    """(keys, bone, rel_diff): mean |L - R| over their middle, of the frames (of a table label, length) that have both sides.

    A bone named in two schemes takes the pair that is listed last. No join: both sides of a frame meet in one group."""
    sides = F.create_map(*[F.lit(x) for left, right in pairs for i, label in enumerate((left, right)) for x in (label, f"{left}|{i}")])
    df = lengths.withColumn("__s", F.split(F.try_element_at(sides, F.col("label")), r"\|")).where("__s is not null")
    side = lambda i: F.max(F.when(F.col("__s")[1] == i, F.col("length")))
    both = df.groupBy(*keys, frame, F.col("__s")[0].alias("__pair")).agg(side("0").alias("__l"), side("1").alias("__r"))
    mid = (F.col("__l") + F.col("__r")) / 2
    found = both.groupBy(*keys, "__pair").agg(F.avg(F.abs(F.col("__l") - F.col("__r")) / F.when(mid > 1e-9, mid)).alias("rel_diff"), F.count(mid).alias("__n")).where("__n > 0")
    bone = F.replace(F.replace("__pair", F.lit("left_"), F.lit("")), F.lit("body_"), F.lit(""))
    order = F.array_position(F.array(*[F.lit(left) for left, _ in pairs]), F.col("__pair"))
    return found.groupBy(*keys, bone.alias("bone")).agg(F.max_by("rel_diff", order).alias("rel_diff"))


def world_frames(df: DataFrame, keys: list[str], frame: str, position: str, expected: str) -> DataFrame:
    """One row a frame, the last of the source, of the ``expected`` ones that start at 0 or at 1, whichever covers more (if equal, 0 if there
    is a frame 0); indices stay as they are. All frames if none are expected."""
    last = F.row_number().over(Window.partitionBy(*keys, frame).orderBy(F.col(position).desc()))
    df = df.withColumn("__n", last).where("__n = 1").drop("__n")
    w, f, n = Window.partitionBy(*keys), F.col(frame), F.col(expected)
    covers = lambda base: F.count_if((f >= base) & (f < n + base)).over(w)
    base = F.when(covers(0) > covers(1), 0).when(covers(1) > covers(0), 1).when(F.count_if(f == 0).over(w) > 0, 0).otherwise(1)
    b = F.col("__base")
    return df.withColumn("__base", base).where((n <= 0) | (f >= b) & (f < n + b)).drop("__base")


def hand_confidences(scores: Column, known: Column, start: int, count: int = 21) -> Column:
    """The scores of a hand's points between 0 and 1, 0 where a point or its score is unknown; NULL for an absent hand."""
    own = F.zip_with(F.slice(scores, start + 1, count), F.slice(known, start + 1, count), lambda s, k: F.when(k & s.isNotNull() & ~F.isnan(s), F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))).otherwise(F.lit(0.0)))
    return F.when(hand_present(scores, start, count), own)


def remap_points(points: Column, indices: list[int]) -> Column:
    """The points of another scheme, picked by index."""
    return F.transform(F.array(*map(F.lit, indices)), lambda i: F.get(points, i))


def hand_present(scores: Column, start: int, count: int = 21, least: float = 0.1) -> Column:
    """Whether a hand's mean score is above a floor."""
    own = F.slice(scores, start + 1, count)
    return F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / F.lit(count) > least


def bone_lengths(long: DataFrame, bones: list[tuple[str, str, str]], keys: list[str]) -> DataFrame:
    """(keys, label, length) of every bone in every frame of a long table (keypoint, x, y, z)."""
    dim = F.broadcast(long.sparkSession.createDataFrame(bones, "label string, a string, b string"))
    end = lambda side: long.select(*keys, F.col("keypoint").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in "xyz"])
    j = end("a").join(dim, "a").join(end("b"), [*keys, "b"])
    return j.select(*keys, "label", F.sqrt(sum(F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), 2) for c in "xyz")).alias("length"))


def metadata_findings(meta: DataFrame, recordings: DataFrame, key: str, dates: list[str] = (), numbers: list[str] = ()) -> DataFrame:
    """(severity, rule, detail, n) of what is wrong with a table keyed by recording."""
    rows = [
        meta.where(F.coalesce(F.trim(key), F.lit("")) == "").agg(F.lit("error").alias("severity"), F.lit("blank_key").alias("rule"), F.lit(key).alias("detail"), F.count("*").alias("n")),
        meta.groupBy(key).count().where("count > 1").agg(F.lit("error"), F.lit("duplicate_key"), F.lit(key), F.count("*")),
        meta.join(recordings, key, "left_anti").agg(F.lit("warning"), F.lit("extra_key"), F.lit(key), F.count("*")),
        recordings.join(meta, key, "left_anti").agg(F.lit("warning"), F.lit("missing_key"), F.lit(key), F.count("*")),
    ]
    rows += [meta.where(F.col(c).isNotNull() & F.col(c).try_cast("date").isNull()).agg(F.lit("error"), F.lit("bad_date"), F.lit(c), F.count("*")) for c in dates]
    rows += [meta.where(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).agg(F.lit("error"), F.lit("not_numeric"), F.lit(c), F.count("*")) for c in numbers]
    rows += [meta.agg(F.lit("warning"), F.lit("all_missing"), F.lit(c), F.when(F.count(c) == 0, 1).otherwise(0)) for c in numbers]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.where("n > 0")


def live_tracks(df: DataFrame, least_age: int) -> DataFrame:
    """Tracks of several subjects that were detected in their frame and are old enough: carried ghosts and brief ones go."""
    return df.where(~F.col("carried") & (F.col("age") >= least_age))
