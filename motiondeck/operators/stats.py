"""Correlation, ranks, multiple testing, principal components, linear fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType



def average_rank(value: str, keys: list[str]) -> Column:
    """The rank of a value in its group, ties sharing the mean of theirs; NULL for NULL."""
    w, same = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys, value)
    return F.when(F.col(value).isNotNull(), F.rank().over(w) + (F.count("*").over(same) - 1) / 2 - F.count_if(F.col(value).isNull()).over(Window.partitionBy(*keys)))


def _pearson(x: str, y: str) -> Column:
    spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    return F.when(spread > 1e-300, F.covar_pop(x, y) / F.when(spread > 1e-300, spread))


def correlations(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y", least: int = 4) -> DataFrame:
    """(keys, n, pearson_r, spearman_rho) over rows with both values; NULL below ``least`` rows."""
    df = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    df = df.withColumns({"__rx": average_rank(x, keys), "__ry": average_rank(y, keys)})
    found = df.groupBy(*keys).agg(F.count("*").alias("n"), _pearson(x, y).alias("pearson_r"), _pearson("__rx", "__ry").alias("spearman_rho"))
    return found.withColumns({c: F.when(F.col("n") >= least, F.col(c)) for c in ("pearson_r", "spearman_rho")})


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation by Student's t with n - 2 degrees of freedom."""
    out = np.full(len(r), np.nan)
    for i, (a, k) in enumerate(zip(r, n, strict=True)):
        if a == a and k > 2:
            out[i] = _beta(k - 2, 1 - min(1.0, a * a))
    return pd.Series(out).replace({np.nan: None}).astype(float)


def _beta(df: float, x: float) -> float:
    """The regularised incomplete beta function at (df / 2, 1 / 2, x), by its continued fraction."""
    from math import exp, lgamma, log

    a, b = df / 2, 0.5
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))

    def fraction(p: float, q: float, z: float) -> float:
        c, d = 1.0, 1 / max(1e-300, 1 - (p + q) * z / (p + 1))
        h = d
        for m in range(1, 500):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 / ((1 + num * d) or 1e-300)
                c = (1 + num / c) or 1e-300
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return h

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str, out: str = "p_adjusted") -> DataFrame:
    """df with adjusted p: the least p * n / rank from the largest p down, at most 1; NULLs count for nothing."""
    known = F.col(p).isNotNull()
    w = Window.partitionBy(*keys, known).orderBy(F.col(p))
    n = F.count(p).over(Window.partitionBy(*keys))
    df = df.withColumn("__q", F.when(known, F.col(p) * n / F.row_number().over(w)))
    down = Window.partitionBy(*keys, known).orderBy(F.col(p).desc(), F.col("__q").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.when(known, F.least(F.lit(1.0), F.min("__q").over(down)))).drop("__q")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of every pair of columns over the rows that hold both, from one aggregate of moments."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    only = lambda c, d: F.when(F.col(d).isNotNull(), F.col(c))
    cells = []
    for a, b in pairs:
        x, y = only(a, b), only(b, a)
        spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
        cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(spread > 1e-300, F.covar_pop(x, y) / F.when(spread > 1e-300, spread)).alias("r")))
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def strongest_correlation(matrix: DataFrame) -> DataFrame:
    """(feature, max_abs_r) from a correlation matrix."""
    both = matrix.select(F.col("a").alias("feature"), "r").unionAll(matrix.select(F.col("b").alias("feature"), "r"))
    return both.groupBy("feature").agg(F.max(F.abs("r")).alias("max_abs_r"))


def linear_fit(x: str, y: str) -> tuple[Column, Column]:
    return F.regr_slope(y, x), F.regr_intercept(y, x)


def principal_components(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """(component, share, feature, loading) of z-scored columns, over the rows that have them all. Spark adds up the moments in a tree; the driver
    holds one matrix of columns by columns. Each component's largest loading is positive."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    whole = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    if whole.isEmpty():
        return df.sparkSession.createDataFrame([], "component int, share double, feature string, loading double")
    rows = VectorAssembler(inputCols=columns, outputCol="__v").transform(whole).select("__v")
    m = Correlation.corr(rows, "__v").first()[0].toArray()
    still = np.isnan(m).sum(axis=0) >= max(1, len(columns) - 1)  # such a column is correlated with none and has no variance
    m = np.where(np.isnan(m), 0.0, m)
    m[still, still] = 0.0
    values, vectors = np.linalg.eigh(m)
    rows = []
    for c, at in enumerate(np.argsort(-values)[:k]):
        v = vectors[:, at] * np.sign(vectors[np.argmax(np.abs(vectors[:, at])), at])
        rows += [(c + 1, float(values[at] / (values.sum() or 1.0)), f, float(x)) for f, x in zip(columns, v, strict=True)]
    return df.sparkSession.createDataFrame(rows, "component int, share double, feature string, loading double")


def leaf_order(matrix: np.ndarray) -> list[int]:
    """The leaves of a complete-linkage tree over rows, for ordering a small table's rows; driver only."""
    groups = {i: [i] for i in range(len(matrix))}
    d = np.sqrt(((matrix[:, None] - matrix[None]) ** 2).sum(-1))
    while len(groups) > 1:
        a, b = min(((i, j) for i in groups for j in groups if i < j), key=lambda p: (max(d[x, y] for x in groups[p[0]] for y in groups[p[1]]), p))
        groups[a] += groups.pop(b)
    return next(iter(groups.values()), [])
