"""Queries of joins, aggregates, reshapes, sets, statistics, censuses and grades."""

from __future__ import annotations

from pyspark.sql import functions as F

from motiondeck.catalog import register
from motiondeck.functions import text as names
from motiondeck.operators import aggregate, census, fusion, grading, matching, ordered, stats, tables
from motiondeck.plans.proxies import KPT, SES, SIG, kpt, rounded, ses, sig, table

_SESW = "PARTITION BY patient ORDER BY session_date, session"


@register("session_deltas", f"WITH {SES}, b AS (SELECT *, first_value(value) OVER w AS base, first_value(value / 10) OVER w AS sd FROM ses WINDOW w AS ({_SESW})) SELECT patient, session, round(base, 6) + 0.0 AS baseline, round(value - base, 6) + 0.0 AS delta, round(100 * ((value - base) / abs(base)), 6) + 0.0 AS pct_change, CASE WHEN sd > 1e-12 THEN abs(value - base) > sd END AS flagged FROM b")
def session_deltas(spark, sf_dir):
    df = ses(spark, sf_dir).withColumn("sd", F.col("value") / 10)
    return rounded(ordered.baseline_deltas(df, ["patient"], ["session_date", "session"], "value", "sd").select("patient", "session", "baseline", "delta", "pct_change", "flagged"))


@register("change_summary", f"WITH {SES}, b AS (SELECT *, first_value(value) OVER w AS base FROM ses WINDOW w AS (PARTITION BY patient, feature ORDER BY session_date, session)), d AS (SELECT *, 100 * ((value - base) / abs(base)) AS pct, abs(value - base) > base / 10 AS flagged FROM b) SELECT patient, count(DISTINCT session) AS n_sessions, count(*) FILTER (flagged) AS n_flagged, arg_max(feature, (abs(pct), feature)) AS worst_feature, round(arg_max(pct, (abs(pct), feature)), 6) + 0.0 AS worst_pct FROM d GROUP BY patient")
def change_summary(spark, sf_dir):
    df = ses(spark, sf_dir).withColumn("sd", F.col("value") / 10)
    deltas = ordered.baseline_deltas(df, ["patient", "feature"], ["session_date", "session"], "value", "sd")
    return rounded(tables.change_summary(deltas, ["patient"], "session"))


@register("top_features", f"WITH {SES}, r AS (SELECT patient, priority AS feature, max(value) - min(value) AS range FROM ses GROUP BY 1, 2 HAVING max(value) - min(value) > 0), k AS (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY range DESC, feature) AS rank FROM r) SELECT patient, feature, round(range, 6) + 0.0 AS range, CAST(rank AS INT) AS rank FROM k WHERE rank <= 3")
def top_features(spark, sf_dir):
    df = ses(spark, sf_dir).select("patient", F.col("priority").alias("feature"), "value")
    return rounded(tables.top_features(df, ["patient"], 3).select("patient", "feature", "range", "rank"))


@register("features_join_windows", f"WITH {SIG}, a AS (SELECT user_id, avg(value) AS value__mean, stddev_samp(value) AS value__sd FROM sig GROUP BY 1), b AS (SELECT user_id, avg(k) AS k__mean, count(*) AS n FROM sig WHERE event_type = 'error' GROUP BY 1) SELECT a.user_id, round(value__mean, 6) + 0.0 AS value__mean, round(value__sd, 6) + 0.0 AS value__sd, round(k__mean, 6) + 0.0 AS k__mean, n FROM a LEFT JOIN b USING (user_id)")
def features_join_windows(spark, sf_dir):
    df = sig(spark, sf_dir)
    a = aggregate.per_recording(df, ["user_id"], ["value"], {"mean": F.avg, "sd": F.stddev_samp})
    b = df.where("event_type = 'error'").groupBy("user_id").agg(F.avg("k").alias("k__mean"), F.count("*").alias("n"), F.lit(0).alias("value__mean"))
    return rounded(tables.left_without_collisions(a, b, ["user_id"]))


@register("key_reconcile", "SELECT CAST(coalesce(c_custkey, o_custkey) AS BIGINT) AS key, CASE WHEN c_custkey IS NULL THEN 'right_only' WHEN o_custkey IS NULL THEN 'left_only' ELSE 'matched' END AS status FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal > 0) c FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') o ON c_custkey = o_custkey")
def key_reconcile(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    b = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key"))
    return tables.reconcile(a, b, ["key"])


@register("counts_with_zero", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) USING (c_custkey)")
def counts_with_zero(spark, sf_dir):
    n = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return tables.with_counts(table(spark, sf_dir, "customer").select("c_custkey"), n, ["c_custkey"])


@register("mean_sd_pairs", f"WITH {SES}, a AS (SELECT patient, avg(value) AS m1, stddev_samp(value) AS s1, avg(session) AS m2, stddev_samp(session) AS s2 FROM ses GROUP BY 1) SELECT patient, 'value' AS feature, round(m1, 6) + 0.0 AS value, round(s1, 6) + 0.0 AS value_sd FROM a UNION ALL SELECT patient, 'session', round(m2, 6) + 0.0, round(s2, 6) + 0.0 FROM a")
def mean_sd_pairs(spark, sf_dir):
    wide = aggregate.per_recording(ses(spark, sf_dir), ["patient"], ["value", "session"], {"mean": F.avg, "sd": F.stddev_samp})
    return rounded(tables.mean_with_sd(wide, ["patient"]))


_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("feature_stats", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(v), 4) + 0.0 AS mean, round(median(v), 4) + 0.0 AS median, round(stddev_samp(v), 4) + 0.0 AS sd, round(min(v), 4) + 0.0 AS min, round(max(v), 4) + 0.0 AS max, round(100 * avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS pct_na FROM (SELECT CASE WHEN {c} > 0.02 THEN {c} END AS v FROM lineitem)" for c in _LI))
def feature_stats(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*[F.when(F.col(c) > 0.02, F.col(c)).alias(c) for c in _LI])
    return rounded(aggregate.feature_stats(df, _LI), 4)


@register("stats_long_wide", "SELECT l_returnflag, f AS feature, round(CASE f WHEN 'l_quantity' THEN m1 ELSE m2 END, 4) + 0.0 AS mean, round(CASE f WHEN 'l_quantity' THEN s1 ELSE s2 END, 4) + 0.0 AS max FROM (SELECT l_returnflag, avg(l_quantity) AS m1, max(l_quantity) AS s1, avg(l_tax) AS m2, max(l_tax) AS s2 FROM lineitem GROUP BY 1), (VALUES ('l_quantity'), ('l_tax')) AS v(f)")
def stats_long_wide(spark, sf_dir):
    wide = aggregate.per_recording(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity", "l_tax"], {"mean": F.avg, "max": F.max})
    long = tables.longer(wide, ["l_returnflag"], [c for c in wide.columns if "__" in c])
    return rounded(tables.stat_wider(long, ["l_returnflag"], ["mean", "max"]), 4)


@register("na_rates", "SELECT l_returnflag, round(avg(CASE WHEN l_discount > 0.02 THEN 0.0 ELSE 1.0 END), 6) + 0.0 AS l_discount, round(avg(CASE WHEN l_tax > 0.02 THEN 0.0 ELSE 1.0 END), 6) + 0.0 AS l_tax FROM lineitem GROUP BY 1")
def na_rates(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", *[F.when(F.col(c) > 0.02, F.col(c)).alias(c) for c in ("l_discount", "l_tax")])
    return rounded(aggregate.null_rates(df, ["l_discount", "l_tax"], ["l_returnflag"]))


_SUP = "sup AS (SELECT l_suppkey, avg(l_quantity) AS quantity, avg(l_extendedprice) AS price, avg(l_tax) AS tax FROM lineitem GROUP BY 1)"


def _suppliers(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price"), F.avg("l_tax").alias("tax"))


@register("zscore_outliers", f"WITH {_SUP}, z AS (SELECT l_suppkey, (quantity - avg(quantity) OVER ()) / stddev_samp(quantity) OVER () AS quantity, (price - avg(price) OVER ()) / stddev_samp(price) OVER () AS price, (tax - avg(tax) OVER ()) / stddev_samp(tax) OVER () AS tax FROM sup) SELECT l_suppkey, feature, round(z, 5) + 0.0 AS z FROM (SELECT l_suppkey, 'quantity' AS feature, quantity AS z FROM z UNION ALL SELECT l_suppkey, 'price', price FROM z UNION ALL SELECT l_suppkey, 'tax', tax FROM z) WHERE abs(z) > 2")
def zscore_outliers(spark, sf_dir):
    return rounded(aggregate.outliers(_suppliers(spark, sf_dir), "l_suppkey", ["quantity", "price", "tax"]), 5)


@register("median_impute", "WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0.05 THEN l_discount END AS d, CASE WHEN l_tax > 0.05 THEN l_tax END AS t FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(d, (SELECT median(d) FROM m WHERE d IS NOT NULL OR t IS NOT NULL), 0.0), 6) + 0.0 AS d, round(coalesce(t, (SELECT median(t) FROM m WHERE d IS NOT NULL OR t IS NOT NULL), 0.0), 6) + 0.0 AS t FROM m WHERE d IS NOT NULL OR t IS NOT NULL")
def median_impute(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("d"), F.when(F.col("l_tax") > 0.05, F.col("l_tax")).alias("t"))
    return rounded(aggregate.median_impute(df, ["d", "t"]))


_DIMS = [f"p{i}_{c}" for i in range(4) for c in "xyz"]


@register("variance_rank", f"WITH {KPT}, v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, var_samp({c}) AS variance FROM kpt" for c in _DIMS) + ") SELECT feature, round(variance, 6) + 0.0 AS variance, variance < 0.01 * (SELECT max(variance) FROM v) AS near_zero FROM v")
def variance_rank(spark, sf_dir):
    return rounded(aggregate.variance_rank(kpt(spark, sf_dir), _DIMS))


@register("strongest_correlation", f"WITH {KPT}, r AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM kpt" for i, a in enumerate(_DIMS) for b in _DIMS[i + 1 :]) + ") SELECT feature, round(max(abs(r)), 6) + 0.0 AS max_abs_r FROM (SELECT a AS feature, r FROM r UNION ALL SELECT b, r FROM r) GROUP BY 1")
def strongest_correlation(spark, sf_dir):
    return rounded(stats.strongest_correlation(stats.correlation_matrix(kpt(spark, sf_dir), _DIMS)))


_PAIRS = "prs AS (SELECT c_nationkey AS nation, c_acctbal AS x, coalesce(n, 0) AS y FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey)"
_RANKED = f"{_PAIRS}, rk AS (SELECT *, rank() OVER (PARTITION BY nation ORDER BY x) + (count(*) OVER (PARTITION BY nation, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY nation ORDER BY y) + (count(*) OVER (PARTITION BY nation, y) - 1) / 2 AS ry FROM prs), co AS (SELECT nation, count(*) AS n, CASE WHEN count(*) >= 4 THEN corr(x, y) END AS pearson_r, CASE WHEN count(*) >= 4 THEN corr(rx, ry) END AS spearman_rho FROM rk GROUP BY 1)"


def _correlations(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("y"))
    df = tables.with_counts(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("x")), n, ["c_custkey"], "y")
    return stats.correlations(df, ["nation"])


@register("pearson_spearman", f"WITH {_RANKED} SELECT nation, n, round(pearson_r, 6) + 0.0 AS pearson_r, round(spearman_rho, 6) + 0.0 AS spearman_rho FROM co")
def pearson_spearman(spark, sf_dir):
    return rounded(_correlations(spark, sf_dir))


@register("bh_adjust", f"WITH {_RANKED}, p AS (SELECT nation, exp(-abs(pearson_r) * sqrt(n)) AS p FROM co), q AS (SELECT *, p * count(p) OVER () / row_number() OVER (ORDER BY p) AS q FROM p) SELECT nation, round(p, 6) + 0.0 AS p, CASE WHEN p IS NOT NULL THEN round(least(1.0, min(q) OVER (ORDER BY p DESC, q DESC ROWS UNBOUNDED PRECEDING)), 6) + 0.0 END AS p_adjusted FROM q")
def bh_adjust(spark, sf_dir):
    df = _correlations(spark, sf_dir).select("nation", F.exp(-F.abs("pearson_r") * F.sqrt("n")).alias("p"), F.lit(1).alias("family"))
    return rounded(stats.benjamini_hochberg(df, ["family"], "p").drop("family"))


@register("correlation_p")
def correlation_p(spark, sf_dir):
    """Two-sided p of each nation's correlation; Student's distribution has no SQL function."""
    df = _correlations(spark, sf_dir)
    df = df.withColumn("p", stats.correlation_p("pearson_r", "n"))
    return rounded(df.withColumn("stars", names.stars(F.col("p"))).select("nation", "n", "pearson_r", "p", "stars"))


@register("linear_fit", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0 AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) + 0.0 AS intercept FROM lineitem GROUP BY 1")
def linear_fit(spark, sf_dir):
    slope, intercept = stats.linear_fit("l_quantity", "l_extendedprice")
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(slope.alias("slope"), intercept.alias("intercept")), 4)


@register("pca_loadings")
def pca_loadings(spark, sf_dir):
    return rounded(stats.principal_components(kpt(spark, sf_dir), _DIMS, 3))


#: All 63 coordinates of the points; the sum of the p-th powers of a matrix's eigenvalues is the trace of its p-th power.
_ALL = [f"p{i}_{c}" for i in range(21) for c in "xyz"]
_SPECTRUM = f"""WITH {KPT}, l AS (SELECT vec_id, unnest([{", ".join(f"'{c}'" for c in _ALL)}]) AS f, unnest([{", ".join(_ALL)}]) AS v FROM kpt), z AS (SELECT vec_id, f, (v - avg(v) OVER (PARTITION BY f)) / stddev_pop(v) OVER (PARTITION BY f) AS z FROM l),
c AS (SELECT x.f AS a, y.f AS b, avg(x.z * y.z) AS r FROM z x JOIN z y ON x.vec_id = y.vec_id GROUP BY 1, 2), d AS (SELECT x.a, y.b, sum(x.r * y.r) AS r FROM c x JOIN c y ON x.b = y.a GROUP BY 1, 2)
SELECT 0 AS power, 0.0 AS total UNION ALL SELECT 1, round(sum(r), 4) + 0.0 FROM c WHERE a = b UNION ALL SELECT 2, round(sum(r * r), 4) + 0.0 FROM c UNION ALL SELECT 3, round(sum(c.r * d.r), 4) + 0.0 FROM c JOIN d ON c.a = d.b AND c.b = d.a UNION ALL SELECT 4, round(sum(r * r), 4) + 0.0 FROM d"""


@register("pca_spectrum", _SPECTRUM)
def pca_spectrum(spark, sf_dir):
    """The components of all coordinates held against their correlation matrix: sums of powers of the eigenvalues, and (power 0) the largest of
    |C v - lambda v| over all components of the first four points, which is nothing."""
    k = kpt(spark, sf_dir)
    values = stats.principal_components(k, _ALL, len(_ALL)).select("component", (F.col("share") * len(_ALL)).alias("value")).distinct()
    sums = values.agg(*[F.sum(F.pow("value", F.lit(p))).alias(str(p)) for p in (1, 2, 3, 4)])
    rows = sums.select(F.inline(F.array(*[F.struct(F.lit(p).alias("power"), F.col(str(p)).alias("total")) for p in (1, 2, 3, 4)])))
    some = stats.principal_components(k, _DIMS, len(_DIMS)).withColumn("value", F.col("share") * len(_DIMS))
    pairs = stats.correlation_matrix(k, _DIMS)
    whole = pairs.unionAll(pairs.select("b", "a", "r")).unionAll(spark.createDataFrame([(c, c, 1.0) for c in _DIMS], "a string, b string, r double"))
    turned = some.withColumnRenamed("feature", "b").join(whole, "b").groupBy("component", F.col("a").alias("feature")).agg(F.sum(F.col("loading") * F.col("r")).alias("turned"))
    off = some.join(turned, ["component", "feature"]).agg(F.max(F.abs(F.col("turned") - F.col("value") * F.col("loading"))).alias("total"))
    return rounded(off.select(F.lit(0).alias("power"), "total").unionAll(rows), 4)


_LAST = r"regexp_extract(url, '//[^/]*/([a-z]+)/', 1)"
_NAME = f"page_id % 60 || ' ' || (CASE page_id % 4 WHEN 0 THEN 'above' WHEN 1 THEN 'LEFT' WHEN 2 THEN 'right' ELSE 'front' END) || '__' || (CASE page_id % 5 WHEN 0 THEN 'coini' WHEN 1 THEN 'glass' WHEN 2 THEN 'key' WHEN 3 THEN 'grass' ELSE 'spoon' END) || '_' || (CASE page_id % 3 WHEN 0 THEN 'l' WHEN 1 THEN 'r' ELSE '' END) || (CASE WHEN page_id % 7 = 0 THEN ' (2)' ELSE '' END) || '.mp4' || (CASE WHEN page_id % 6 = 0 THEN '.MP4' ELSE '' END)"


def _names(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    pick = lambda m, *words: F.get(F.array(*map(F.lit, words)), (F.col("page_id") % m).cast("int"))
    tail = F.concat(F.when(F.col("page_id") % 7 == 0, " (2)").otherwise(""), F.lit(".mp4"), F.when(F.col("page_id") % 6 == 0, ".MP4").otherwise(""))
    name = F.concat((F.col("page_id") % 60).cast("string"), F.lit(" "), pick(4, "above", "LEFT", "right", "front"), F.lit("__"), pick(5, "coini", "glass", "key", "grass", "spoon"), F.lit("_"), pick(3, "l", "r", ""), tail)
    return p.select("page_id", "url", name.alias("name"))


_PARSE = f"""nm AS (SELECT page_id, url, {_NAME} AS name FROM pages), st AS (SELECT *, regexp_replace(name, '(\\.(mp4|avi|mov|mkv|webm|flv))+$', '', 'i') AS raw FROM nm),
no AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(trim(lower(raw)), '\\s+', '_', 'g'), '_+', '_', 'g'), '^_+', '') AS stem FROM st),
rp AS (SELECT *, coalesce(TRY_CAST(regexp_extract(stem, '_?\\(([0-9]+)\\)$', 1) AS INT), 0) AS repeat FROM no), rs AS (SELECT *, CASE WHEN repeat > 0 THEN regexp_replace(stem, '_?\\(([0-9]+)\\)$', '') ELSE stem END AS s2 FROM rp),
tk AS (SELECT *, string_split(s2, '_') AS tok FROM rs), fx AS (SELECT *, len(tok) = 4 AS four, CASE tok[3] WHEN 'coini' THEN 'coin' WHEN 'gcap' THEN 'cap' WHEN 'gpeg' THEN 'peg' WHEN 'grass' THEN 'glass' ELSE tok[3] END AS task FROM tk),
gr AS (SELECT *, CASE WHEN repeat = 0 AND s2 LIKE '%)' THEN 'repeat_marker_unrecognized' WHEN NOT four THEN 'token_count' WHEN NOT regexp_full_match(tok[1], '[0-9]+') THEN 'subject_token_nonnumeric' WHEN tok[2] NOT IN ('above', 'left', 'right') THEN 'view_unknown' WHEN task NOT IN ('cap', 'coin', 'glass', 'key', 'nut', 'peg') THEN 'task_unknown' WHEN tok[4] = '' THEN 'side_missing' WHEN tok[4] NOT IN ('l', 'r') THEN 'side_unknown' ELSE 'ok' END AS reason FROM fx)"""


@register("stem_grammar", f"WITH {_PARSE} SELECT page_id, reason AS reason_code, CASE WHEN reason = 'ok' THEN format('s{{:02d}}-{{}}-{{}}', CAST(tok[1] AS INT), task, tok[4]) END AS capture_id, CASE WHEN reason = 'ok' THEN tok[2] END AS view, CASE WHEN reason = 'ok' THEN repeat END AS repeat FROM gr")
def stem_grammar(spark, sf_dir):
    df = names.parse_names(_names(spark, sf_dir), "name", "p")
    return df.select("page_id", "p.reason_code", F.when(F.col("p.reason_code") == "ok", names.capture_id(F.col("p.subject_ordinal"), F.col("p.task"), F.col("p.side"))).alias("capture_id"), "p.view", "p.repeat")


_DISP = f"{_PARSE}, ds AS (SELECT *, CASE WHEN page_id % 11 = 0 THEN 'broken_symlink' WHEN page_id % 13 = 0 THEN 'symlink_within_corpus' WHEN page_id % 17 = 0 THEN 'read_error' ELSE reason END AS reason_code, CASE WHEN page_id % 11 = 0 OR page_id % 13 = 0 OR page_id % 17 = 0 THEN 'excluded' WHEN reason = 'ok' THEN 'canonical' ELSE 'quarantined' END AS disposition FROM gr)"


def _dispositions(spark, sf_dir):
    path = F.concat(F.lit("d"), (F.col("page_id") % 60).cast("string"), F.lit("/"), F.col("name"))
    df = _names(spark, sf_dir).withColumn("source_path", path)
    df = df.withColumn("exclusion", census.exclusion_reason(path, F.col("page_id") % 11 != 0, F.lit(True), F.col("page_id") % 13 == 0, F.lit(True)))
    return census.dispositions(df.withColumns({"readable": F.col("page_id") % 17 != 0, "probe_ok": F.lit(True)}))


@register("disposition_ladder", f"WITH {_DISP} SELECT page_id, disposition, reason_code FROM ds")
def disposition_ladder(spark, sf_dir):
    return _dispositions(spark, sf_dir).select("page_id", "disposition", "reason_code")


@register("reason_histogram", f"WITH {_DISP} SELECT r AS value, count(page_id) AS n FROM (VALUES ('ok'), ('task_unknown'), ('side_missing'), ('view_unknown'), ('token_count'), ('side_unknown')) AS v(r) LEFT JOIN ds ON ds.reason_code = r GROUP BY 1")
def reason_histogram(spark, sf_dir):
    return census.histogram(_dispositions(spark, sf_dir), F.col("reason_code"), ["ok", "task_unknown", "side_missing", "view_unknown", "token_count", "side_unknown"])


@register("asset_ids")
def asset_ids(spark, sf_dir):
    """A keyed digest of every page's address: SQL has no such digest."""
    return table(spark, sf_dir, "pages").select("page_id", census.asset_id("url").alias("asset_id"), names.printable_path(F.col("url")).alias("path"))


@register("crosscheck_quarantine", "WITH p AS (SELECT p_partkey, p_brand AS directory, p_size % 40 AS ordinal, CASE WHEN p_partkey % 400 = 3 THEN 'canonical' ELSE 'excluded' END AS disposition FROM part), d AS (SELECT DISTINCT directory, ordinal FROM p WHERE disposition = 'canonical'), bad AS (SELECT directory FROM d GROUP BY 1 HAVING count(*) > 1 UNION SELECT directory FROM d WHERE ordinal IN (SELECT ordinal FROM d GROUP BY 1 HAVING count(*) > 1)) SELECT p_partkey, disposition = 'canonical' AND directory IN (SELECT directory FROM bad) AS conflict FROM p")
def crosscheck_quarantine(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("directory"), (F.col("p_size") % 40).alias("ordinal"), F.when(F.col("p_partkey") % 400 == 3, "canonical").otherwise("excluded").alias("disposition"))
    return census.crosscheck(df).select("p_partkey", "conflict")


@register("family_census", "SELECT p_brand, p_type, count(*) AS n_assets, count(DISTINCT p_size) AS n_views, min(p_size) AS min_frames, max(p_size) AS max_frames, round(CASE WHEN count(*) FILTER (p_retailprice < 905) = 0 THEN max(p_retailprice) - min(p_retailprice) END, 6) + 0.0 AS fps_spread, round(CASE WHEN max(p_size) > 0 THEN (max(p_size) - min(p_size)) / max(p_size) ELSE 1 END, 6) + 0.0 AS frame_parity FROM part GROUP BY 1, 2")
def family_census(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("fps", F.when(F.col("p_retailprice") >= 905, F.col("p_retailprice")))
    found = census.families(df, ["p_brand", "p_type"], view="p_size", frames="p_size", fps="fps")
    return rounded(found.select("p_brand", "p_type", "n_assets", "n_views", "min_frames", "max_frames", "fps_spread", "frame_parity"))


@register("nearest_rank_quantiles", "WITH s AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1) SELECT l_returnflag, " + ", ".join(f"round(v[CAST(least(len(v) - 1, floor({f} * len(v))) AS BIGINT) + 1], 4) + 0.0 AS q{round(100 * f)}" for f in (0.25, 0.5, 0.75, 0.95)) + " FROM s")
def nearest_rank_quantiles(spark, sf_dir):
    return rounded(aggregate.nearest_index_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.75, 0.95]), 4)


@register("multiset_parity", "SELECT n_regionkey AS key, 'left' AS side FROM (SELECT n_regionkey FROM nation EXCEPT ALL SELECT r_regionkey FROM region) UNION ALL SELECT r_regionkey, 'right' FROM (SELECT r_regionkey FROM region EXCEPT ALL SELECT n_regionkey FROM nation)")
def multiset_parity(spark, sf_dir):
    return census.multiset_differences(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("key")), table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key")))


@register("run_compare", "WITH a AS (SELECT event_type AS metric, avg(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS metric, avg(value) AS v FROM events WHERE event_id % 2 = 1 AND event_type <> 'view' GROUP BY 1) SELECT coalesce(a.metric, b.metric) AS metric, round(a.v, 6) + 0.0 AS a, round(b.v, 6) + 0.0 AS b, round(b.v - a.v, 6) + 0.0 AS delta, round((b.v - a.v) / abs(nullif(a.v, 0)) * 100, 1) + 0.0 AS pct FROM a FULL JOIN b ON a.metric = b.metric")
def run_compare(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    half = lambda c: e.where(c).groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return rounded(tables.compare_runs(half("event_id % 2 = 0"), half("event_id % 2 = 1 AND event_type <> 'view'")))


@register("detection_rates", "SELECT event_type, round(avg(CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) > 30 THEN 1 ELSE 0 END), 6) + 0.0 AS rate, count(*) AS n FROM events GROUP BY 1")
def detection_rates(spark, sf_dir):
    return rounded(sig(spark, sf_dir).groupBy("event_type").agg(F.avg((F.col("k") > 30).cast("int")).alias("rate"), F.count("*").alias("n")))


_VIEWS = "v AS (SELECT user_id AS session, event_type AS camera, event_id // 40 AS raw_idx, CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 ELSE 0 END AS sync_offset, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) > 50 THEN epoch_us(ts) END AS ts, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 ELSE 3 END AS camera_pos, event_id FROM events)"


@register("fused_views", f"WITH {_VIEWS}, l AS (SELECT *, raw_idx - sync_offset AS logical_idx FROM v WHERE raw_idx >= sync_offset) SELECT session, CAST(logical_idx AS BIGINT) AS logical_idx, count(DISTINCT camera) AS cameras, CAST(arg_min(ts, camera_pos * CAST(1000000000 AS BIGINT) + event_id) FILTER (ts IS NOT NULL) AS BIGINT) AS ts FROM l GROUP BY 1, 2 HAVING count(DISTINCT camera) >= 2")
def fused_views(spark, sf_dir):
    s = sig(spark, sf_dir)
    pick = lambda **kv: F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kv.items()])
    df = s.select(
        F.col("user_id").alias("session"), F.col("event_type").alias("camera"), F.floor(F.col("event_id") / 40).alias("raw_idx"), F.coalesce(pick(error=1, click=2), F.lit(0)).alias("sync_offset"),
        F.when(F.col("k") > 50, F.round(F.col("t") * 1e6).cast("bigint")).alias("ts"), (F.coalesce(pick(view=0, click=1, error=2), F.lit(3)) * F.lit(1000000000).cast("bigint") + F.col("event_id")).alias("camera_pos"),
    )
    return fusion.logical_frames(df)


@register("anti_overlap", "WITH d AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS cx, CAST(embedding[2] AS DOUBLE) AS cy FROM embeddings) SELECT vec_id FROM d a WHERE vec_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM d b WHERE b.vec_id % 2 = 1 AND b.label = a.label AND pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2) < 0.1 * 0.1)")
def anti_overlap(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("cx"), F.get("embedding", F.lit(1)).cast("double").alias("cy"))
    return matching.without_overlap(d.where("vec_id % 2 = 0"), d.where("vec_id % 2 = 1"), ["label"]).select("vec_id")


@register("grid_coverage", "SELECT l_suppkey, round(count(DISTINCT CAST(greatest(0, least(5, floor(l_discount / 0.1 * 6))) AS INT) * 8 + CAST(greatest(0, least(7, floor(l_quantity / 50 * 8))) AS INT)) / 48.0, 6) + 0.0 AS coverage FROM lineitem GROUP BY 1")
def grid_coverage(spark, sf_dir):
    c = aggregate.grid_coverage(F.col("l_quantity"), F.col("l_discount"), F.lit(50), F.lit(0.1))
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(c.alias("coverage")))


@register("grade_bands", f"WITH {_SUP}, m AS (SELECT l_suppkey, 'max_bone_length_cv' AS metric, tax AS value FROM sup UNION ALL SELECT l_suppkey, 'min_tracking_detection_rate', quantity / 30 FROM sup), g AS (SELECT *, CASE WHEN metric = 'max_bone_length_cv' THEN CASE WHEN value <= 0.05 THEN 0 WHEN value <= 0.10 THEN 1 ELSE 2 END ELSE CASE WHEN value >= 0.8 THEN 0 WHEN value >= 0.5 THEN 1 ELSE 2 END END AS severity FROM m) SELECT l_suppkey, CASE max(severity) WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARN' ELSE 'FAIL' END AS verdict, count(*) AS checks FROM g GROUP BY 1")
def grade_bands(spark, sf_dir):
    df = _suppliers(spark, sf_dir).select("l_suppkey", F.inline(F.array(F.struct(F.lit("max_bone_length_cv").alias("metric"), F.col("tax").alias("value")), F.struct(F.lit("min_tracking_detection_rate").alias("metric"), (F.col("quantity") / 30).alias("value")))))
    return grading.verdict(grading.grade(df, grading.bands(spark)), ["l_suppkey"])


@register("count_parity", "SELECT c AS nation, round(CASE WHEN max(n) > 0 THEN (max(n) - min(n)) / max(n) ELSE 1 END, 6) + 0.0 AS parity FROM (SELECT c_nationkey AS c, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1")
def count_parity(spark, sf_dir):
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation"), "c_mktsegment").agg(F.count("*").alias("n"))
    return rounded(n.groupBy("nation").agg(aggregate.count_parity(F.col("n")).alias("parity")))


@register("bench_stats", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(min(value), 6) + 0.0 AS min_ns, round(median(value), 6) + 0.0 AS median_ns, round(max(CASE WHEN i = round_even(0.95 * (n - 1), 0) THEN value END), 6) + 0.0 AS p95_ns, round(max(value), 6) + 0.0 AS max_ns, round(stddev_pop(value), 6) + 0.0 AS stdev_ns FROM r GROUP BY 1")
def bench_stats(spark, sf_dir):
    return rounded(aggregate.bench_stats(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", "min_ns", "median_ns", "p95_ns", "max_ns", "stdev_ns"))


@register("frame_interval", "WITH f AS (SELECT l_suppkey, l_linenumber AS frame, 6 AS expected FROM lineitem), c AS (SELECT l_suppkey, count(*) FILTER (frame >= 0 AND frame < 6) AS z, count(*) FILTER (frame >= 1 AND frame <= 6) AS o, count(*) FILTER (frame = 0) AS h FROM f GROUP BY 1) SELECT f.l_suppkey, frame - CASE WHEN z > o THEN 0 WHEN o > z THEN 1 WHEN h > 0 THEN 0 ELSE 1 END AS frame, count(*) AS n FROM f JOIN c USING (l_suppkey) WHERE frame - CASE WHEN z > o THEN 0 WHEN o > z THEN 1 WHEN h > 0 THEN 0 ELSE 1 END BETWEEN 0 AND 5 GROUP BY 1, 2")
def frame_interval(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("frame"), F.lit(6).alias("expected"))
    return tables.interval_of_frames(df, ["l_suppkey"], "frame", "expected").groupBy("l_suppkey", "frame").agg(F.count("*").alias("n"))


@register("primary_rows", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def primary_rows(spark, sf_dir):
    return tables.primary(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey")


@register("oldest_tracks", "SELECT o_custkey, o_orderkey AS track_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders WHERE o_totalprice >= 1000) WHERE rank <= 2")
def oldest_tracks(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("track_id"), F.col("o_totalprice").alias("age"))
    return tables.oldest_tracks(df, ["o_custkey"], 1000, 2).select("o_custkey", "track_id", "rank")


@register("observed_rank", f"WITH {SIG} SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position FROM sig WHERE event_type <> 'error'")
def observed_rank(spark, sf_dir):
    df = sig(spark, sf_dir).select("user_id", "event_id", F.col("event_id").alias("position"), (F.col("event_type") == "error").alias("carried"))
    return tables.observed_only(df, ["user_id"]).select("event_id", F.col("position").cast("bigint").alias("position"))


@register("metadata_findings", "SELECT 'warning' AS severity, 'extra_key' AS rule, 'custkey' AS detail, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) HAVING count(*) > 0 UNION ALL SELECT 'warning', 'missing_key', 'custkey', count(*) FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders) HAVING count(*) > 0 UNION ALL SELECT 'error', 'duplicate_key', 'custkey', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0 UNION ALL SELECT 'error', 'not_numeric', 'o_orderpriority', count(*) FROM orders WHERE TRY_CAST(o_orderpriority AS DOUBLE) IS NULL HAVING count(*) > 0")
def metadata_findings(spark, sf_dir):
    meta = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("custkey"), "o_orderpriority")
    people = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("custkey"))
    return tables.metadata_findings(meta, people, "custkey", numbers=["o_orderpriority"])
