"""Quality rules at host level, in DataFrame functions only.

Each document is held against the base rules. Failures are summed by host (the documents' ``source``;
null is a host of its own), each host's failure rate is shrunk with a beta prior whose two parameters are
fitted to all hosts by moments, and the shrunk rate decides for the host. The verdict is joined back: a
document of a failing host goes even if it passes itself. The prior is fitted from sums over hosts, one
row whatever the number of hosts.

A null text has no words and fails. Repeated rows count each. The prior weighs as much as ``WEAKEST`` documents at least, so a host of
few documents stays near the corpus rate, and at most as an average host, so a host's own documents count against it; with one
host, or hosts that do not differ more than chance, it is that strong. A host fails when its shrunk rate is above twice the corpus rate, but
not below ``BAR[0]`` and in any case above ``BAR[1]``. Without documents there is no host. Columns of other names pass
``apply_rules``; ``host_rate`` and ``kept`` are replaced, as are ``__hash``, ``__win``, ``__twice``, ``__at``, ``__sorted`` and ``__lines`` by ``base_columns``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motiondeck.llm.common import WORD, materialize, table


#: The least weight of the prior, in documents.
WEAKEST = 10.0
#: The lowest and the highest rate above which a host fails.
BAR = (0.25, 0.5)


def _contains(values: Column, x: Column, steps: int = 26) -> Column:
    """Whether sorted array values holds x, by binary search."""
    powers = F.array(*[F.lit(1 << p) for p in range(steps - 1, -1, -1)])
    size = F.size(values)
    last = F.aggregate(powers, F.lit(-1), lambda acc, p: F.when((acc + p < size) & (F.get(values, acc + p) <= x), acc + p).otherwise(acc))
    return F.get(values, last) == x


def base_columns(docs: DataFrame, window: int = 5) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint) and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("__hash", F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    n = F.size("__hash")
    windows = F.transform(
        F.when(n >= window, F.sequence(F.lit(0), n - window)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[F.get(F.col("__hash"), i + j) for j in range(window)]),
    )
    df = df.withColumn("__win", windows)
    df = df.withColumn("__sorted", F.sort_array("__win"))
    df = df.withColumn("__twice", F.filter("__sorted", lambda x, i: (x == F.get(F.col("__sorted"), i + 1)) & ((i == 0) | (x != F.get(F.col("__sorted"), i - 1))))).drop("__sorted")
    repeated = F.filter(F.transform("__win", lambda x, i: F.when(_contains(F.col("__twice"), x), i)), lambda i: i.isNotNull())
    df = df.withColumn("__at", F.when(F.size("__twice") == 0, F.array().cast("array<int>")).otherwise(repeated))
    covered = F.aggregate(F.transform("__at", lambda x, i: F.least(F.lit(window), F.coalesce(F.get(F.col("__at"), i + 1) - x, F.lit(window)))), F.lit(0), lambda acc, x: acc + x)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    df = df.withColumn("__lines", lines)
    df = df.withColumns({
        "n_words": n.cast("bigint"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("bigint"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        "n_repeat_words": covered.cast("bigint"),
    }).drop("__hash", "__win", "__twice", "__at", "__lines")
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def beta_prior(n: float, failed: float, hosts: float, squares: float, rates: float) -> tuple[float, float]:
    """Mean and weight (in documents) of the prior by moments, from sums over hosts.

    squares: sum of n_docs squared; rates: sum of n_failed squared / n_docs. What the hosts' rates vary
    beyond binomial chance is the prior's own variance.
    """
    if not n:
        return 0.0, WEAKEST
    m = failed / n
    over = max(0.0, (rates - failed * m) - (hosts - 1) * m * (1 - m))
    room = (n - squares / n) * m * (1 - m)
    rho = over / room if room > 0 else 0.0
    return m, max(WEAKEST, min(n / hosts, 1 / rho - 1 if rho > 0 else n / hosts))


def host_rates(judged: DataFrame) -> DataFrame:
    """(source, n_docs, n_failed, rate, passes): the shrunk failure rate of every host and whether it is low enough."""
    hosts = materialize(judged.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_failed")))
    n, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    sums = hosts.agg(F.sum(n), F.sum(f), F.count("*"), F.sum(n * n), F.sum(f * f / n)).first()
    mean, weight = beta_prior(*(float(x or 0) for x in sums))
    bar = min(BAR[1], max(BAR[0], 2 * mean))
    return hosts.withColumn("rate", (f + mean * weight) / (n + weight)).withColumn("passes", F.col("rate") <= bar)


def apply_rules(judged: DataFrame) -> DataFrame:
    """judged (source, base_failed and any others) with ``host_rate`` and ``kept``."""
    rates = host_rates(judged.select("source", "base_failed")).select(F.col("source").alias("__of"), F.col("rate").alias("__rate"), "passes")
    found = judged.join(rates.withColumnRenamed("passes", "__passes"), F.col("source").eqNullSafe(F.col("__of")), "left")
    found = found.withColumns({"host_rate": F.col("__rate"), "kept": ~F.col("base_failed") & F.col("__passes")})
    return found.drop("__of", "__rate", "__passes")


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the rules are the work: written once, they serve the hosts and the result
    judged = materialize(base_columns(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"), keep=True)
    return apply_rules(judged).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM docs),
wins AS (SELECT r, unnest(list_transform(range(1, len(ws) - 3), lambda i: struct_pack(i := i, w := array_to_string(ws[i:i + 4], ' '))), recursive := true) FROM words WHERE len(ws) >= 5),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS c FROM wins) WHERE c > 1),
cov AS (SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (
  SELECT r, doc_id, source, len(ws) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN cov USING (r) LEFT JOIN lines USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
hosts AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS f FROM judged GROUP BY source),
sums AS (SELECT sum(n) AS n, sum(f) AS f, count(*) AS hosts, sum(n * n) AS nn, sum(f * f / n) AS ff, sum(f) / sum(n) AS m FROM hosts),
rho AS (SELECT m, CASE WHEN (n - nn / n) * m * (1 - m) > 0 THEN greatest(0, ff - f * m - (hosts - 1) * m * (1 - m)) / ((n - nn / n) * m * (1 - m)) ELSE 0 END AS rho FROM sums),
prior AS (SELECT rho.m, greatest(10, least(n / hosts, CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE n / hosts END)) AS w FROM rho, sums),
rates AS (SELECT source, (f + m * w) / (n + w) <= least(0.5, greatest(0.25, 2 * m)) AS passes FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND passes AS kept
FROM judged JOIN rates ON judged.source IS NOT DISTINCT FROM rates.source
"""
