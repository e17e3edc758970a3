"""Exponential averages: a linear recursion along a key's rows, without a loop over them.

A row's average is the sum of all earlier values, each shrunk once a row.  Rows
are taken in blocks in which the shrinking spans six powers of ten: a running sum
serves a block, and of the blocks before it three are enough for a double's
precision.  All frames share one exchange by the key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ewm(df: DataFrame, x: Column, alpha: float, out: str, *, adjust: bool = False, by: tuple[str, ...] = ("asset",), order: str = "date") -> DataFrame:
    """df with out, the exponential average of x: 1 - alpha of what was, alpha of what is.

    The first value starts it; adjust divides by the sum of weights instead, so that early rows weigh alike.  Rows without a
    value keep the last average and do not count; before the first value it is null.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha lies between 0 and 1")
    keep = 1 - alpha
    rows = max(1, int(math.log(1e6) / -math.log(keep)))
    so_far = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__ewm_x", x.cast("double")).withColumn("__ewm_k", F.count("__ewm_x").over(so_far) - 1)
    df = df.withColumn("__ewm_b", F.floor(F.col("__ewm_k") / rows)).withColumn("__ewm_j", F.col("__ewm_k") - F.col("__ewm_b") * rows)
    weight = F.lit(1.0) if adjust else F.when(F.col("__ewm_k") == 0, 1.0).otherwise(alpha)
    inside = Window.partitionBy(*by, "__ewm_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__ewm_s", F.sum(F.col("__ewm_x") * weight * F.pow(F.lit(keep), -F.col("__ewm_j"))).over(inside) * F.pow(F.lit(keep), F.col("__ewm_j")))
    whole = F.max(F.when((F.col("__ewm_j") == rows - 1) & F.col("__ewm_x").isNotNull(), F.col("__ewm_s")))
    blocks = Window.partitionBy(*by).orderBy("__ewm_b")
    before = sum((F.coalesce(whole.over(blocks.rangeBetween(-m, -m)), F.lit(0.0)) * keep ** (rows * (m - 1)) for m in (1, 2, 3)), F.lit(0.0))
    value = F.col("__ewm_s") + before * F.pow(F.lit(keep), F.col("__ewm_j") + 1)
    if adjust:
        value = value * alpha / (1 - F.pow(F.lit(keep), F.col("__ewm_k") + 1))
    return df.withColumn(out, F.when(F.col("__ewm_k") >= 0, value)).drop("__ewm_x", "__ewm_k", "__ewm_b", "__ewm_j", "__ewm_s")


def wilder(df: DataFrame, x: Column, n: int, out: str, *, by: tuple[str, ...] = ("asset",), order: str = "date") -> DataFrame:
    """df with out: the mean of the first n values, from then on 1/n of the new value and the rest of what was; null before, and where x is not there from its first value on."""
    w = Window.partitionBy(*by).orderBy(order)
    df = df.withColumn("__wilder_v", x.cast("double")).withColumn("__wilder_n", F.count("__wilder_v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seed = F.when(F.col("__wilder_n") == n, F.avg("__wilder_v").over(w.rowsBetween(1 - n, 0))).when(F.col("__wilder_n") > n, F.col("__wilder_v"))
    return ewm(df.withColumn("__wilder_z", seed), F.col("__wilder_z"), 1 / n, out, by=by, order=order).drop("__wilder_v", "__wilder_n", "__wilder_z")


def ewm_sql(rows: str, x: str, alpha: float, out: str, adjust: bool = False, by: str = "asset", order: str = "date") -> str:
    """DuckDB: one running sum over all rows, of values grown by what later rows shrink; for keys of a few hundred rows."""
    keep, weight = repr(1 - alpha), "1" if adjust else f"case when _k = 0 then 1 else {alpha!r} end"
    y = f"sum(_x * ({weight}) * power({keep}, -_k)) over (partition by {by} order by {order}) * power({keep}, _k)"
    if adjust:
        y = f"{y} * {alpha!r} / (1 - power({keep}, _k + 1))"
    return f"select * exclude (_x, _k), {y} as {out} from (select *, ({x})::double as _x, count(({x})) over (partition by {by} order by {order}) - 1 as _k from ({rows}))"
