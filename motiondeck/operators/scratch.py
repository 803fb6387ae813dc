"""Tables that cut lineage, in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: a lost executor costs no recomputation of what led to it."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
