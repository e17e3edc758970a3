"""Least squares on several columns, from sums of products: groups and frames are summed by Spark, small systems solved in batches.

Rows that lack a value are left out.  A system without a unique solution gets the smallest one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


def _products(y: str, xs: list[str], intercept: bool) -> list[Column]:
    """Products of all pairs of (1, xs, y), in the order of an upper triangle; null where a value is missing."""
    whole = F.col(y).isNotNull()
    for x in xs:
        whole = whole & F.col(x).isNotNull()
    z = [*([F.lit(1.0)] if intercept else []), *[F.col(x) for x in xs], F.col(y)]
    return [F.when(whole, a * b) for i, a in enumerate(z) for b in z[i:]]


def _solver(k: int, intercept: bool):
    """Coefficients, sum of squared residuals and share explained of each row's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.triu_indices(k + 1)
        for batch in batches:
            if not len(batch):
                continue
            n = batch["_n"].to_numpy(zero_copy_only=False).astype(float)
            sums = np.array([x if x is not None and None not in x else [np.nan] * len(upper[0]) for x in batch["_sums"].to_pylist()], float)
            full = np.zeros((len(n), k + 1, k + 1))
            full[:, upper[0], upper[1]] = sums
            full = full + np.transpose(np.triu(full, 1), (0, 2, 1))
            known = ~np.isnan(sums).any(axis=1)
            a, b, yy = full[:, :k, :k], full[:, :k, k], full[:, k, k]
            scale = np.sqrt(np.maximum(np.einsum("nii->ni", a), 1e-300))
            coefs = np.full((len(n), k), np.nan)
            if known.any():
                s = scale[known]
                coefs[known] = np.einsum("nij,nj->ni", np.linalg.pinv(a[known] / s[:, :, None] / s[:, None, :], hermitian=True, rcond=1e-12), b[known] / s) / s
            rest = np.maximum(yy - 2 * np.einsum("ni,ni->n", coefs, b) + np.einsum("ni,nij,nj->n", coefs, a, coefs), 0)
            whole = yy - (full[:, 0, k] ** 2 / np.maximum(n, 1) if intercept else 0)
            share = np.where(whole > 0, 1 - rest / np.where(whole > 0, whole, 1), np.nan)
            out = lambda x: pa.array([None if np.isnan(v) else float(v) for v in x], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if np.isnan(c).any() else c.tolist() for c in coefs], pa.list_(pa.float64())), out(rest), out(share)], [*batch.schema.names, "coefs", "rest", "r2"])

    return run


def _solved(df: DataFrame, k: int, intercept: bool) -> DataFrame:
    schema = StructType([*df.schema.fields, StructField("coefs", ArrayType(DoubleType())), StructField("rest", DoubleType()), StructField("r2", DoubleType())])
    return df.mapInArrow(_solver(k, intercept), schema).drop("_sums")


def fit(df: DataFrame, keys: list[str], y: str, xs: list[str], intercept: bool = True) -> DataFrame:
    """keys, _n (rows used), coefs (intercept first), rest (sum of squared residuals) and r2 of y on xs in each group."""
    p = _products(y, xs, intercept)
    sums = df.groupBy(*keys).agg(F.count(p[-1]).alias("_n"), F.array(*[F.sum(x) for x in p]).alias("_sums"))
    return _solved(sums, len(xs) + intercept, intercept)


def rolling_fit(panel: DataFrame, y: str, xs: list[str], n: int, least: int, intercept: bool = True) -> DataFrame:
    """asset, date and the fit of the n rows before each row, with `least` whole ones; null before there are n rows."""
    by = Window.partitionBy("asset").orderBy("date")
    w = by.rowsBetween(-n, -1)
    p = _products(y, xs, intercept)
    enough = (F.count(p[-1]).over(w) >= least) & (F.row_number().over(by) > n)
    sums = panel.select("asset", "date", F.count(p[-1]).over(w).alias("_n"), F.when(enough, F.array(*[F.sum(x).over(w) for x in p])).alias("_sums"))
    return _solved(sums, len(xs) + intercept, intercept)


def idiosyncratic_vol(panel: DataFrame, xs: list[str], n: int = 36) -> DataFrame:
    """Volatility a year of what monthly excess returns keep beyond the xs over the n months before; half of them are needed."""
    f = rolling_fit(panel, "excess", xs, n, n // 2)
    return f.select("asset", "date", (F.sqrt(F.try_divide(F.col("rest"), F.col("_n"))) * F.sqrt(F.lit(12.0))).alias("value"))


def alpha(panel: DataFrame, xs: list[str], n: int = 36) -> DataFrame:
    """Yearly intercept of monthly excess returns on the xs over the n months before."""
    return rolling_fit(panel, "excess", xs, n, n // 2).select("asset", "date", (F.get("coefs", F.lit(0)) * 12).alias("value"))


def attribution(returns: DataFrame, xs: list[str]) -> DataFrame:
    """strategy, months, yearly alpha, r2 and a beta for each of xs, of excess returns on the xs."""
    f = fit(returns, ["strategy"], "excess", xs)
    return f.select("strategy", F.col("_n").alias("months"), (F.get("coefs", F.lit(0)) * 12).alias("alpha"), "r2", *[F.get("coefs", F.lit(k + 1)).alias(f"beta_{x}") for k, x in enumerate(xs)])


def orthogonalize(df: DataFrame, keys: list[str], y: str, xs: list[str], least: int = 20) -> DataFrame:
    """df with residual: y without what the xs explain in its group; groups with fewer than `least` whole rows keep y."""
    f = fit(df, keys, y, xs).select(*keys, "_n", "coefs")
    explained = sum((F.get("coefs", F.lit(k + 1)) * F.col(x) for k, x in enumerate(xs)), F.get("coefs", F.lit(0)))
    return df.join(f, keys, "left").withColumn("residual", F.when(F.coalesce("_n", F.lit(0)) < least, F.col(y)).otherwise(F.col(y) - explained)).drop("_n", "coefs")


def delay(panel: DataFrame, n: int = 60, lags: int = 4) -> DataFrame:
    """How much of what the market and its lags explain the lags add: 1 - r2 of the market alone over r2 of all, over the n rows before; half are needed."""
    by = Window.partitionBy("asset").orderBy("date")
    x = panel
    names = ["mkt", *[f"m{k}" for k in range(1, lags + 1)]]
    for k in range(1, lags + 1):
        x = x.withColumn(f"m{k}", F.lag("mkt", k).over(by))
    x = x.withColumn("mkt", F.when(F.col(f"m{lags}").isNotNull(), F.col("mkt")))
    both = rolling_fit(x, "ret", names, n, n // 2).select("asset", "date", F.col("r2").alias("a")).join(rolling_fit(x, "ret", ["mkt"], n, n // 2).select("asset", "date", F.col("r2").alias("b")), ["asset", "date"])
    return both.select("asset", "date", F.try_divide(F.col("a") - F.col("b"), F.when(F.col("a") > 1e-9, F.col("a"))).alias("value"))
