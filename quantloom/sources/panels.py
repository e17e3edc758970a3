"""Dense price panels from order lines: an asset is a supplier, a date a month or a week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ("open_", "high", "low", "close", "volume", "trade_count", "vwap")


#: Least days of a step, for the size of a panel.
DAYS = {"week": 7, "month": 28}


def _asset(per: int) -> Column:
    return F.expr(f"cast((l_suppkey + {per - 1}) div {per} as bigint)")


def bars(lines: DataFrame, unit: str, per: int = 1) -> DataFrame:
    """A row for each asset and period with lines; an asset is `per` neighbouring suppliers."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    first = F.struct("l_shipdate", "l_orderkey", "l_linenumber", price.alias("p"))
    return lines.groupBy(_asset(per).alias("asset"), F.to_date(F.date_trunc(unit, "l_shipdate")).alias("date")).agg(
        F.min(first)["p"].alias("open_"), F.max(price).alias("high"), F.min(price).alias("low"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"), F.count("*").cast("double").alias("trade_count"), F.avg(price).alias("vwap")
    )


def densify(facts: DataFrame, step: str, calendar: tuple | None = None) -> DataFrame:
    """A row for each asset and each date from the first to the last; fields are null where facts has none.

    facts has a row for an asset and date at most; calendar gives the first and last date where they are known.  Each
    row fills the dates up to its asset's next one, so that one exchange by asset serves this and later frames.
    """
    low, high = calendar or facts.agg(F.min("date"), F.max("date")).first()
    if low is None:
        return facts
    order = Window.partitionBy("asset").orderBy("date")
    begin = F.when(F.row_number().over(order) == 1, F.lit(low)).otherwise(F.col("date"))
    until = F.coalesce(F.lead("date").over(order), F.expr(f"cast(date '{high}' + interval 1 {step} as date)"))
    spans = facts.withColumn("_from", begin).withColumn("_until", until)
    dates = F.filter(F.sequence("_from", "_until", F.expr(f"interval 1 {step}")), lambda x: x < F.col("_until"))
    fields = [F.when(F.col("_date") == F.col("date"), F.col(c)).alias(c) for c in facts.columns if c not in ("asset", "date")]
    return spans.withColumn("_date", F.explode(dates)).select("asset", F.col("_date").alias("date"), *fields)


def panel(spark: SparkSession, sf_dir: str, unit: str, per: int = 1) -> DataFrame:
    """The dense panel with price (close, gaps filled forward), ret (of price) and mkt, the date's mean return."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return _filled(lines, unit, per, tuple(lines.agg(*_ends(unit)).first()))  # a scan of one column


def sized(spark: SparkSession, sf_dir: str, unit: str, per: int = 1) -> tuple[DataFrame, int]:
    """The panel and about how many rows it has (months count as 28 days), by a scan of two columns; the size serves to deal rows out only."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    low, high, assets = lines.agg(*_ends(unit), F.count_distinct(_asset(per))).first()
    return _filled(lines, unit, per, (low, high)), 0 if low is None else assets * ((high - low).days // DAYS[unit] + 1)


def _ends(unit: str) -> list[Column]:
    return [F.to_date(F.date_trunc(unit, f("l_shipdate"))) for f in (F.min, F.max)]


def _filled(lines: DataFrame, unit: str, per: int, ends: tuple) -> DataFrame:
    dense = densify(bars(lines, unit, per), unit, ends)
    filled = dense.selectExpr("*", "last(close, true) over (partition by asset order by date rows between unbounded preceding and current row) as price")
    moved = filled.selectExpr("*", "price / nullif(lag(price, 1) over (partition by asset order by date), 0) - 1 as ret")
    return moved.selectExpr("*", "avg(ret) over (partition by date) as mkt")


def panel_sql(unit: str, per: int = 1) -> str:
    asset = f"((l_suppkey + {per - 1}) // {per})::bigint"
    return f"""
    select *, avg(ret) over (partition by date) as mkt from (
      select asset, date, open_, high, low, close, volume, trade_count, vwap, filled as price, filled / nullif(lag(filled, 1) over (partition by asset order by date), 0) - 1 as ret from (
        select *, last_value(close ignore nulls) over (partition by asset order by date rows between unbounded preceding and current row) as filled
        from (select asset, date from (select distinct {asset} as asset from lineitem), (select unnest(generate_series((select date_trunc('{unit}', min(l_shipdate)) from lineitem), (select date_trunc('{unit}', max(l_shipdate)) from lineitem), interval 1 {unit}))::date as date))
        left join (
          select {asset} as asset, date_trunc('{unit}', l_shipdate)::date as date, arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice / l_quantity)) as open_, max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low,
                 sum(l_extendedprice) / sum(l_quantity) as close, sum(l_quantity) as volume, count(*)::double as trade_count, avg(l_extendedprice / l_quantity) as vwap
          from lineitem group by 1, 2) using (asset, date)))"""
