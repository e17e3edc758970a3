"""Fits on several columns and annual signals: months' excess returns on the market and differences of regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import cs_rank
from ..operators import align, regression
from .catalog import MONTH, market, month, register, strategies
from .cleaning_queries import RATIOS, ratios
from .risk_queries import RF, rounded

XS = ["mktrf", "smb", "hml", "umd"]


def _factors(spark: SparkSession, d: str) -> DataFrame:
    wide = strategies(spark, d).groupBy("date").pivot("strategy", [0, 1, 2, 3, 4]).agg(F.first("r"))
    return wide.join(market(spark, d), "date").select("date", (F.col("m") - RF).alias("mktrf"), (F.col("0") - F.col("1")).alias("smb"), (F.col("2") - F.col("3")).alias("hml"), (F.col("4") - F.col("0")).alias("umd"))


def _excess(spark: SparkSession, d: str) -> DataFrame:
    return month(spark, d).select("asset", "date", (F.col("ret") - RF).alias("excess")).join(F.broadcast(_factors(spark, d)), "date", "left")  # a row for each month


# systems of three and more unknowns have no SQL here: tests hold them against numpy
register("idiosyncratic_vol", lambda spark, d: rounded(regression.idiosyncratic_vol(_excess(spark, d), XS[:3])), None)
register("factor_alpha", lambda spark, d: rounded(regression.alpha(_excess(spark, d), XS)), None)
register("factor_attribution", lambda spark, d: rounded(regression.attribution(strategies(spark, d).select("strategy", "date", (F.col("r") - RF).alias("excess")).join(_factors(spark, d), "date"), XS)), None)
register("factor_delay", lambda spark, d: rounded(regression.delay(month(spark, d), 36)), None)
_CROSS = ("asset", "date", "round(ret, 9) as y", "round(ln(close * volume), 6) as cap", "round(coalesce(volume, 0), 6) as v")
register(
    "orthogonalized_returns",
    lambda spark, d: rounded(regression.orthogonalize(month(spark, d).selectExpr(*_CROSS), ["date"], "y", ["cap", "v"], 30).select("asset", "date", "residual"), 5),
    f"""with p as (select {', '.join(_CROSS)} from ({MONTH})), w as (select * from p where y is not null and cap is not null), s as (select date, count(*) as n, avg(y) as my, avg(cap) as m1, avg(v) as m2, covar_pop(y, cap) as c1, covar_pop(y, v) as c2, var_pop(cap) as v1, var_pop(v) as v2, covar_pop(cap, v) as c12 from w group by 1),
b as (select *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) as b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) as b2 from s) select asset, p.date, round(case when coalesce(n, 0) < 30 then y else y - my - b1 * (cap - m1) - b2 * (v - m2) end, 5) as residual from p left join b using (date)""",
)

#: Annual signals and whether large values are good.
ANNUAL = {"bm": True, "ep": True, "roe": True, "gpa": True, "ag": False, "turnover": True, "revenue_growth": True, "debt_equity": False, "sp": True, "income_growth": True}


def annual_signal(spark: SparkSession, d: str, field: str, good: bool, least: int = 10) -> DataFrame:
    """asset, date, signal: the field cut at its year's 1 and 99 % quantiles (above 20 values), ranked in its year, known by the fiscal-year rule."""
    r = ratios(spark, d).select("asset", "year", F.round(field, 9).alias("x")).where("x is not null")
    edges = r.groupBy("year").agg(F.percentile("x", F.array(F.lit(0.01), F.lit(0.99))).alias("e"), F.count("*").alias("n"))
    cut = r.join(F.broadcast(edges), "year").where(F.col("n") >= least)  # a row for each year
    cut = cut.withColumn("x", F.round(F.when(F.col("n") > 20, F.greatest(F.least("x", F.element_at("e", 2)), F.element_at("e", 1))).otherwise(F.col("x")), 9))
    ranked = cut.selectExpr("asset", "year", f"round({cs_rank('x', least).replace('partition by date', 'partition by year')}, 9) as s")
    signal = F.col("s") if good else -F.col("s") + F.lit(0.0)
    return align.annual_to_monthly(month(spark, d).select("asset", "date"), ranked.select("asset", "year", signal.alias("signal")))


def annual_sql(field: str, good: bool, least: int = 10) -> str:
    rank = cs_rank("x", least).replace("partition by date", "partition by year")
    return f"""with r as (select asset, year, round({field}, 9) as x from ({RATIOS}) where {field} is not null), e as (select year, quantile_cont(x, 0.01) as lo, quantile_cont(x, 0.99) as hi, count(*) as n from r group by 1), c as (select asset, year, round(case when n > 20 then greatest(least(x, hi), lo) else x end, 9) as x from r join e using (year) where n >= {least}),
s as (select asset, year, round({rank}, 9) as s from c) select p.asset, p.date, {'' if good else '-'}s{'' if good else ' + 0'} as signal from ({MONTH}) p left join s on s.asset = p.asset and s.year = year(p.date) - case when month(p.date) >= 7 then 1 else 2 end"""


for _field, _good in ANNUAL.items():
    register(f"annual_{_field}", lambda spark, d, f=_field, g=_good: annual_signal(spark, d, f, g), annual_sql(_field, _good))


def _quality(spark: SparkSession, d: str) -> DataFrame:
    r = ratios(spark, d).select("asset", "year", *[F.round(c, 9).alias(c) for c in ("roe", "leverage", "ag")]).where("roe is not null and leverage is not null and ag is not null")
    share = lambda c: cs_rank(c, 20).replace("partition by date", "partition by year")
    q = r.selectExpr("asset", "year", *[f"({share(c)} + 1) / 2 as {c}" for c in ("roe", "leverage", "ag")]).selectExpr("asset", "year", "round(0.5 * roe + 0.25 * (1 - leverage) + 0.25 * (1 - ag), 6) as quality")
    return month(spark, d).select("asset", "date", (F.year("date") - 1).alias("year")).join(q, ["asset", "year"], "left").drop("year")


_SHARE = "case when count(*) over (partition by year) >= 20 then (rank() over (partition by year order by {0}) + (count(*) over (partition by year, {0}) - 1) / 2) / count(*) over (partition by year) end"
register("quality_composite", _quality, f"""with r as (select asset, year, round(roe, 9) as roe, round(leverage, 9) as leverage, round(ag, 9) as ag from ({RATIOS}) where roe is not null and leverage is not null and ag is not null),
q as (select asset, year, 0.5 * ({_SHARE.format('roe')}) + 0.25 * (1 - ({_SHARE.format('leverage')})) + 0.25 * (1 - ({_SHARE.format('ag')})) as q from r) select p.asset, p.date, round(q, 6) as quality from ({MONTH}) p left join q on q.asset = p.asset and q.year = year(p.date) - 1""")
