"""The catalogue of registered queries and their SQL, and the model tables that queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.panels import panel, panel_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None) -> None:
    """A query and its SQL; None where SQL cannot express it."""
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def month(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d, "month")


MONTH = panel_sql("month")


def regions(spark: SparkSession, d: str) -> DataFrame:
    """asset, nation and region: an asset is a supplier."""
    nation = read(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("region"))
    return read(spark, d, "supplier").join(F.broadcast(nation), "s_nationkey").select(F.col("s_suppkey").alias("asset"), F.col("s_nationkey").alias("nation"), "region", "s_acctbal")  # nations are 25


REGIONS = "select s_suppkey as asset, s_nationkey as nation, n_regionkey as region, s_acctbal from supplier join nation on s_nationkey = n_nationkey"


def strategies(spark: SparkSession, d: str) -> DataFrame:
    """strategy, date, r: the monthly mean return of each region's assets."""
    both = month(spark, d).where("ret is not null").join(regions(spark, d), "asset")
    return both.groupBy(F.col("region").alias("strategy"), "date").agg(F.round(F.avg("ret"), 9).alias("r"))


STRATEGIES = f"select region as strategy, date, round(avg(ret), 9) as r from ({MONTH}) join ({REGIONS}) using (asset) where ret is not null group by all"


def market(spark: SparkSession, d: str) -> DataFrame:
    """date, m: the market's monthly return."""
    return month(spark, d).where("mkt is not null").groupBy("date").agg(F.round(F.first("mkt"), 9).alias("m"))


MARKET = f"select date, round(any_value(mkt), 9) as m from ({MONTH}) where mkt is not null group by date"
