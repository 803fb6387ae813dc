"""Every registered query with SQL of its own, held against DuckDB on the smallest tables; the others must run."""

import glob
import math
import os

import duckdb
import pytest

from motiondeck import catalog


def _cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return repr(float(v)) if isinstance(v, float) else str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_oracle(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    found = _rows(df.columns, df.collect())
    cursor = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert found == _rows(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_partitioning_does_not_matter(spark, sf_dir):
    def result():
        return sorted(map(str, catalog.queries()["window_qc"](spark, sf_dir).collect()))

    before = result()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert result() == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
