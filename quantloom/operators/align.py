"""Joins that align tables: by month, by fiscal year, to the nearest date, over many factors, by sector and by named periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import asof_join


def month_align(left: DataFrame, right: DataFrame, values: list[str]) -> DataFrame:
    """left with right's values of the same calendar month; right has a row for each month at most."""
    small = right.select(F.date_trunc("month", "date").alias("_month"), *values)
    return left.withColumn("_month", F.date_trunc("month", "date")).join(F.broadcast(small), "_month").drop("_month")  # a row for each month


def fiscal_year(date: Column) -> Column:
    """The fiscal year that is known at a date: last year's from July on, the one before until June."""
    return F.year(date) - F.when(F.month(date) >= 7, 1).otherwise(2)


def annual_to_monthly(panel: DataFrame, annual: DataFrame) -> DataFrame:
    """panel with the annual values (asset, year, ...) that are known at each date; null where there are none."""
    return panel.withColumn("year", fiscal_year(F.col("date"))).join(annual, ["asset", "year"], "left").drop("year")


def nearest_join(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """left with right's value nearest in time for the same key; of two equally near ones the earlier."""
    stamped = right.select(by, at, F.struct(F.col(at).alias("t"), F.col(value).alias("v")).alias("_x"))
    earlier = asof_join(left, stamped, by, at, ["_x"]).withColumnRenamed("_x", "_before")
    turn = lambda df: df.withColumn("_at", F.col(at)).withColumn(at, F.timestamp_micros(-F.unix_micros(F.col(at).cast("timestamp"))))
    both = asof_join(turn(earlier), turn(stamped).select(by, at, "_x"), by, at, ["_x"]).withColumn(at, F.col("_at")).drop("_at")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap = lambda c: F.abs(micros(f"{c}.t") - micros(at))
    later = F.col("_before").isNull() | (gap("_x") < gap("_before"))
    return both.select(*left.columns, F.when(later & F.col("_x").isNotNull(), F.col("_x.v")).otherwise(F.col("_before.v")).alias(value))


def align_many(tall: DataFrame, n: int) -> DataFrame:
    """The rows of (date, asset) cells that all n factors have a value for."""
    whole = tall.where("signal is not null").groupBy("date", "asset").agg(F.count_distinct("factor").alias("k")).where(F.col("k") == n).select("date", "asset")
    return tall.join(whole, ["date", "asset"], "left_semi")


def outer_align(a: DataFrame, b: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rows that either has; what one is missing is 0."""
    both = a.select(*keys, x).join(b.select(*keys, y), keys, "full")
    return both.select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in (x, y)])


def pairs(panel: DataFrame, x: str) -> DataFrame:
    """date, a, b and both values of each unordered pair of names; for tables of few names: sectors, strategies, indexes."""
    one, two = panel.select("date", F.col("asset").alias("a"), F.col(x).alias("x")), panel.select("date", F.col("asset").alias("b"), F.col(x).alias("y"))
    return one.join(two, "date").where("a < b")


def sector_join(panel: DataFrame, sectors: DataFrame, series: DataFrame) -> DataFrame:
    """panel with its sector and the sector's value on the date."""
    return panel.join(sectors.select("asset", "sector"), "asset").join(series.select("sector", "date", F.col("r").alias("sector_ret")), ["sector", "date"], "left")


def label_periods(dates: DataFrame, periods: list[tuple[str, str, str]]) -> DataFrame:
    """A row for each named period (name, first and last month) that holds the date; periods may overlap."""
    table = dates.sparkSession.createDataFrame(periods, "period string, first string, last string").select("period", F.to_date("first").alias("first"), F.last_day(F.to_date("last")).alias("last"))
    return dates.join(F.broadcast(table), F.col("date").between(F.col("first"), F.col("last"))).drop("first", "last")  # a row for each period
