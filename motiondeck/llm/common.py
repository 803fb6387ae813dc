"""Small helpers that the text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo parts."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def scratch_dir(spark: SparkSession) -> str:
    """A new path below the shared folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent (tests) is a local folder used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the tables written within each open ``temporary`` block.
_OPEN: list[list[str]] = []


def materialize(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor costs no recomputation.

    What was shuffled for it goes once it is written. Within a ``temporary`` block the table goes when the block ends; one that is kept
    goes with the block around that one, if there is any.
    """
    path = scratch_dir(df.sparkSession)
    with _shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    blocks = _OPEN[:-1] if keep else _OPEN
    if blocks:
        blocks[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside are deleted at its end; else they stay until the driver collects its garbage."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, before)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, the tables that were materialised inside and not kept."""
    _OPEN.append([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for path in _OPEN.pop():
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
