"""Series, trajectories, keypoints and sessions seen in the given tables: the views that the registered queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ["day", "l_orderkey", "l_linenumber", "l_partkey", "y"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles with a fixed number of decimals, and no minus zero."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes])


def sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, event_type, t, value, k): a series a user, t in seconds, k its evidence."""
    ts = F.col("ts")
    whole = (F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60) * 1000000
    micros = whole + (F.expr("extract(SECOND FROM ts)") * 1000000).cast("bigint")
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (micros / 1e6).alias("t"), "value", k.alias("k"))


SIG = "sig AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS t, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"


def trj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_suppkey, day, ..., x, y, z): a trajectory a supplier, in order of shipment, a second a point."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_suppkey", F.to_date("l_shipdate").alias("day"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"), "l_tax", "l_discount")


TRJ = "trj AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, l_orderkey, l_linenumber, l_partkey, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z, l_tax, l_discount FROM lineitem)"
TRJ_ORDER = "ORDER BY day, l_orderkey, l_linenumber, l_partkey, y"


def kpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, p0_x, p0_y, p0_z, ...): 21 points a vector."""
    e = table(spark, sf_dir, "embeddings")
    cells = [F.get("embedding", F.lit(3 * i + j)).cast("double").alias(f"p{i}_{c}") for i in range(21) for j, c in enumerate("xyz")]
    return e.select("vec_id", "label", *cells)


KPT = "kpt AS (SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{3 * i + j + 1}] AS DOUBLE) AS p{i}_{c}" for i in range(21) for j, c in enumerate("xyz")) + " FROM embeddings)"


def ses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(patient, session_date, session, value, group): a session an order."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("patient"), F.to_date("o_orderdate").alias("session_date"), F.col("o_orderkey").alias("session"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("feature"), F.col("o_orderpriority").alias("priority"))


SES = "ses AS (SELECT o_custkey AS patient, CAST(o_orderdate AS DATE) AS session_date, o_orderkey AS session, o_totalprice AS value, o_orderstatus AS feature, o_orderpriority AS priority FROM orders)"
