"""Measures of a monthly return series (date, r), a row for each month.  A return of -1 or less ends in equity 0 for good."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROWTH = "case when min({r}){over} <= -1 then 0e0 else exp(sum(case when {r} > -1 then ln(1 + {r}) end){over}) end"
_EQUITY = GROWTH.format(r="r", over=" over (order by date)") + " as equity"
_MEASURES = (
    "count(*) as months",
    f"round({GROWTH.format(r='r', over='')} - 1, 6) as total",
    "round(coalesce(avg(r) / nullif(round(stddev_samp(r), 12), 0) * sqrt(12e0), 0), 5) as sharpe",
    "round(coalesce(avg(r) / nullif(round(stddev_samp(case when r < 0 then r end), 12), 0) * sqrt(12e0), 0), 5) as sortino",
    "round(stddev_samp(r) * sqrt(12e0), 6) as volatility",
    "round(avg(case when r > 0 then 1e0 else 0e0 end), 6) as win_rate",
    "round(avg(case when r > 0 then r end), 6) as avg_win",
    "round(avg(case when r < 0 then r end), 6) as avg_loss",
    "round(sum(case when r > 0 then r end) / nullif(abs(sum(case when r < 0 then r end)), 0), 5) as profit_factor",
    "round(min(r), 6) as worst",
    "round(max(r), 6) as best",
    "round(min(drawdown), 6) as max_drawdown",
)
_DRAWDOWN = "equity / greatest(max(equity) over (order by date), 1e0) - 1 as drawdown"
_YEAR = "over (order by date rows between 11 preceding and current row)"
_ROLLING = f"round(case when count(*) {_YEAR} >= 12 then avg(r) {_YEAR} / nullif(round(stddev_samp(r) {_YEAR}, 12), 0) * sqrt(12e0) end, 5) as sharpe"


def measures(series: DataFrame) -> DataFrame:
    """Total return, ratios, win rate, profit factor and drawdown in one row."""
    return series.selectExpr("date", "r", _EQUITY).selectExpr("r", _DRAWDOWN).selectExpr(*_MEASURES)


def measures_sql(series: str) -> str:
    return f"select {', '.join(_MEASURES)} from (select r, {_DRAWDOWN} from (select date, r, {_EQUITY} from ({series})))"


def yearly(series: DataFrame) -> DataFrame:
    """Compounded return of each year."""
    return series.groupBy(F.year("date").alias("year")).agg(F.expr(f"round({GROWTH.format(r='r', over='')} - 1, 6)").alias("total"), F.count("*").alias("months"))


def yearly_sql(series: str) -> str:
    return f"select year(date)::int as year, round({GROWTH.format(r='r', over='')} - 1, 6) as total, count(*) as months from ({series}) group by 1"


def rolling_sharpe(series: DataFrame) -> DataFrame:
    return series.selectExpr("date", _ROLLING)


def rolling_sharpe_sql(series: str) -> str:
    return f"select date, {_ROLLING} from ({series})"


def drawdown_episodes(series: DataFrame) -> DataFrame:
    """Runs of months below an earlier peak: first month, months, depth."""
    eq = series.selectExpr("date", _EQUITY).selectExpr("date", "round(equity, 9) as equity").selectExpr("date", "equity", "greatest(max(equity) over (order by date), 1e0) as peak")
    return eq.where("equity < peak").groupBy("peak").agg(F.min("date").alias("start"), F.count("*").alias("months"), F.round(F.min("equity") / F.col("peak") - 1, 6).alias("depth")).drop("peak")


def drawdown_episodes_sql(series: str) -> str:
    return f"""select min(date) as start, count(*) as months, round(min(equity) / any_value(peak) - 1, 6) as depth from (
      select date, equity, greatest(max(equity) over (order by date), 1e0) as peak from (select date, round(equity, 9) as equity from (select date, {_EQUITY} from ({series})))) where equity < peak group by peak"""
