"""The audit of the monthly factors, capacity, exponential averages and implied volatilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import wide
from ..functions.normal import normal_cdf_sql
from ..functions.recursion import ewm, ewm_sql, wilder
from ..operators import audit, factors, macro, signals, significance
from ..streaming import indicators, ticks
from .catalog import MONTH, ORACLES, month, register
from .cleaning_queries import CHAIN, chain
from .evaluation_queries import _NW, _STUDY, ICS, NAMES, TALL, _folds, _folds_sql, _study, ics, tall
from .factor_queries import WEEK, week
from .registry import _DAY_BARS, _INDICATORS_SQL, _MOM, _SIGNAL_SQL, _ticks
from .risk_queries import rounded, shown

_WIDE = f"select date, asset, {', '.join(f'max(signal) filter (factor = {n!r}) as {n}' for n in NAMES)} from ({TALL}) group by 1, 2"


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return wide(tall(spark, d), list(NAMES))


def _capacity(spark: SparkSession, d: str) -> DataFrame:
    return audit.capacity(factors.compute(month(spark, d), _MOM, keep=("close", "volume")).selectExpr("date", "asset", "signal", "close * volume as adv"))


_VIF = audit.vif_sql(_WIDE, list(NAMES))
_CHI = f"2 * {normal_cdf_sql('-sqrt(q)')} + sqrt(2 / pi()) * exp(-q / 2) * (sqrt(q) + q * sqrt(q) / 3)"
_AUDIT = f"""with n as (with {_NW} select factor, n, mean, mean / (sd / sqrt(n)) as t_naive, mean / se as t_adjusted from g where n >= 10),
p as (select *, case when n > 10 then 2 * ({normal_cdf_sql('-abs(t_adjusted)')}) end as p from n), r as (select *, row_number() over (order by round(p, 12), factor) as k, count(p) over () as m from p),
j as (select *, least(min(round(p, 12) * m / k) over (order by k desc), 1) as p_adjusted from r), a as (select factor, rho, n_effective, t_effective, ljung_box as q from ({ORACLES['ic_autocorrelation'].replace('round(q, 6)', 'q').replace('round(rho, 6)', 'rho').replace('round(eff, 6)', 'eff').replace('round(mean / (sd / sqrt(eff)), 6)', 'mean / (sd / sqrt(eff))')}))
select factor, n, mean, t_naive, t_adjusted, p, rho, n_effective, t_effective, {_CHI} as ljung_box_p, coalesce({_CHI} < 0.05, abs(rho) > 0.15, false) as autocorrelated, p_adjusted, coalesce(p_adjusted <= 0.05, false) as reject from j left join a using (factor)"""
register("vif", lambda spark, d: rounded(audit.vif(_wide(spark, d), list(NAMES))), f"select factor, round(vif, 6) as vif, concern from ({_VIF})")
register("statistical_audit", lambda spark, d: rounded(audit.audit(ics(spark, d))), f"select factor, n, {shown('mean t_naive t_adjusted p rho n_effective t_effective ljung_box_p')}, autocorrelated, {shown('p_adjusted')}, reject from ({_AUDIT})")
register(
    "audit_summary", lambda spark, d: rounded(audit.summary(audit.audit(ics(spark, d)), audit.vif(_wide(spark, d), list(NAMES)))),
    f"""select count(*) as tested, count(*) filter (p < 0.05) as significant, count(*) filter (reject) as rejected, round(count(*) * 0.05e0, 6) as by_chance, count(*) filter (autocorrelated) as autocorrelated,
    round(median(abs(t_naive) / nullif(abs(t_adjusted), 0)), 6) as inflation, (select count(*) from ({_VIF}) where vif > 5) as high_vif from ({_AUDIT})""",
)
_HELD = f"""select date, median(close * volume) as adv from (select date, signal, asset, close, volume, count(*) over (partition by date) as n, row_number() over (partition by date order by signal desc, asset) as up, row_number() over (partition by date order by signal, asset) as down
from ({_SIGNAL_SQL}) join (select date, asset, close, volume from ({MONTH})) using (date, asset) where signal is not null)
where n >= 40 and (up <= 20 or down <= 20) and date in (select distinct date from ({MONTH}) order by date desc limit 24) group by 1"""
register(
    "capacity", lambda spark, d: rounded(_capacity(spark, d)),
    f"""select level, round(0.1 * adv / 0.0325, 6) as most, round(adv, 6) as median_adv, round(level * 0.0325 / adv, 6) as participation, round(3000 * sqrt(least(level * 0.0325 / adv, 1)), 6) as impact_bps, round(7.2 * sqrt(least(level * 0.0325 / adv, 1)), 6) as cost_a_year, level * 0.0325 / adv < 0.1 as viable
    from (select median(adv) as adv from ({_HELD})), (select unnest([{', '.join(f'{x!r}::double' for x in audit.LEVELS)}]) as level) where adv is not null""",
)
register(
    "ic_histogram", lambda spark, d: rounded(significance.ic_histogram(ics(spark, d))),
    f"""with e as (select factor, ic, min(ic) over (partition by factor) as low, (max(ic) over (partition by factor) - min(ic) over (partition by factor)) / 30 as wide from ({ICS}) where ic is not null),
    b as (select *, least(floor(round((ic - low) / wide, 9)) + 1, 30)::int as bin from e) select factor, bin, round(any_value(low) + (bin - 1) * any_value(wide), 6) as edge, count(*) as n from b group by factor, bin""",
)
register(
    "walk_forward_summary", lambda spark, d: rounded(significance.walk_forward_summary(_study(spark, d), _folds(False)(spark, d))),
    f"""with s as (select *, greatest(5, count(*) over (partition by date) // 5) as k, count(*) over (partition by date) as n, row_number() over (partition by date order by signal desc, asset) as up, row_number() over (partition by date order by signal, asset) as down from ({_STUDY}) where signal is not null and fwd is not null),
    x as (select date, avg(fwd) filter (up <= k) - avg(fwd) filter (down <= k) as x from s where n >= 2 * k group by 1), b as (select * from x join {_folds_sql(False)} using (date)),
    g as (select fold, role, case when count(x) >= 3 and stddev_samp(x) > 0 then avg(x) / stddev_samp(x) * sqrt(12) else 0 end as sharpe from b group by 1, 2), w as (select fold, max(sharpe) filter (role = 'train') as train, max(sharpe) filter (role = 'test') as test from g group by 1)
    select count(*) as folds, round(avg(train), 6) as train, round(avg(test), 6) as test, round(avg(test / train) filter (train > 0), 6) as retention, round((select avg(x) / stddev_samp(x) * sqrt(12) from b where role = 'test'), 6) as pooled, round(case when avg(train) > 0 then 1 - avg(test) / avg(train) end, 6) as decay from w""",
)
register("implied_vol", lambda spark, d: chain(spark, d).select("contract", "underlying", "kind", "mid", "spot", "strike", "dte").transform(signals.implied_vol).select("contract", "underlying", F.round("iv", 6).alias("iv")), f"select contract, underlying, round(iv, 6) as iv from ({signals.implied_vol_sql(CHAIN)})")


def _smiles(spark: SparkSession, d: str) -> DataFrame:
    """Mean implied volatility by underlying, kind and side of the money."""
    iv = signals.implied_vol(chain(spark, d).select("underlying", "kind", "moneyness", "mid", "spot", "strike", "dte"))
    side = F.when(F.col("moneyness") < 0.95, "low").when(F.col("moneyness") > 1.05, "high").otherwise("near")
    return rounded(iv.where("iv is not null").groupBy("underlying", "kind", side.alias("side")).agg(F.avg("iv").alias("iv"), F.count("*").alias("n")))


register("implied_vol_smile", _smiles, f"select underlying, kind, case when moneyness < 0.95 then 'low' when moneyness > 1.05 then 'high' else 'near' end as side, round(avg(iv), 6) as iv, count(*) as n from ({signals.implied_vol_sql(CHAIN)}) where iv is not null group by all")
register(
    "ewm_prices", lambda spark, d: ewm(ewm(week(spark, d), F.col("price"), 2 / 11, "fast"), F.col("price"), 2 / 51, "slow", adjust=True).select("asset", "date", F.round("fast", 4).alias("fast"), F.round("slow", 4).alias("slow")),
    f"select asset, date, round(fast, 4) as fast, round(slow, 4) as slow from ({ewm_sql(ewm_sql(WEEK, 'price', 2 / 11, 'fast'), 'price', 2 / 51, 'slow', True)})",
)


def _rsi(spark: SparkSession, d: str) -> DataFrame:
    change = F.col("price") - F.lag("price").over(Window.partitionBy("asset").orderBy("date"))
    up = wilder(week(spark, d), F.greatest(change, F.lit(0.0) * change), 14, "gain")
    both = wilder(up, F.greatest(-change, F.lit(0.0) * change), 14, "loss")
    return both.select("asset", "date", F.round(F.when(F.round("loss", 9) == 0, 1.0).otherwise(1 - 2 / (1 + F.col("gain") / F.col("loss"))), 6).alias("rsi"))


_CHANGES = f"select asset, date, price - lag(price) over (partition by asset order by date) as c from ({WEEK})"
_COUNTED = f"select *, count(c) over (partition by asset order by date) as n, avg(greatest(c, 0)) over l as g0, avg(greatest(-c, 0)) over l as l0 from ({_CHANGES}) window l as (partition by asset order by date rows between 13 preceding and current row)"
_SMOOTH = lambda x: f"case when n = 14 then {x[1]} when n > 14 and c is not null then {x[0]} end"
_RSI = ewm_sql(ewm_sql(_COUNTED, _SMOOTH(("greatest(c, 0)", "g0")), 1 / 14, "gain"), _SMOOTH(("greatest(-c, 0)", "l0")), 1 / 14, "loss")
register("rsi", _rsi, f"select asset, date, round(case when round(loss, 9) = 0 then 1 else 1 - 2 / (1 + gain / loss) end, 6) as rsi from ({_RSI})")
_TREND_ROWS = f"select *, price - lag(price, 14) over (partition by asset order by date) as moved, greatest(high - low, abs(high - lag(price) over (partition by asset order by date)), abs(low - lag(price) over (partition by asset order by date))) as tr from ({WEEK})"
_TREND = f"""with a as ({ewm_sql(_TREND_ROWS, 'tr', 2 / 15, 'atr', True)}),
s as (select asset, date, round(case when count(price) over f >= 50 then avg(price) over f end, 9) as fast, round(case when count(price) over w >= 200 then avg(price) over w end, 9) as slow,
  round(case when count(tr) over (partition by asset order by date) >= 14 then abs(moved) / (atr * sqrt(14) + 1e-10) end, 9) as strength from a window f as (partition by asset order by date rows between 49 preceding and current row), w as (partition by asset order by date rows between 199 preceding and current row)),
m as (select *, case when count(strength) over y >= 60 then round(median(strength) over y, 9) end as usual from s window y as (partition by asset order by date rows between 251 preceding and current row))
select asset, date, case when fast > slow and strength > usual then 'bull' when fast < slow and strength > usual then 'bear' else 'sideways' end as trend from m"""
register("trend_regime", lambda spark, d: macro.trend_regime(week(spark, d)), _TREND)
_FOLLOW = f"""with e as ({ewm_sql(ewm_sql(WEEK, 'price', 2 / 11, 'fast'), 'price', 2 / 51, 'slow')}),
t as (select asset, date, row_number() over (partition by asset order by date) - 1 as i, case when round(fast - slow, 9) > 0 then 1 when round(fast - slow, 9) < 0 then -1 else 0 end as trend,
  coalesce(volume > case when count(volume) over v >= 20 then avg(volume) over v end, false) as loud from e window v as (partition by asset order by date rows between 19 preceding and current row)),
c as (select *, coalesce(trend <> lag(trend) over (partition by asset order by date), false) as crossed from t),
a as (select asset, date, case when crossed and loud then trend when not crossed and i >= 50 then trend end as taken from c)
select asset, date, coalesce(last_value(taken ignore nulls) over (partition by asset order by date rows between unbounded preceding and current row), 0)::int as signal from a"""
register("trend_follow", lambda spark, d: signals.trend_follow(week(spark, d)), _FOLLOW)


def _five(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars of events, with the hour's range as the quotes."""
    rows = ticks.tick_bars(_ticks(spark, d), "1 hour").selectExpr("symbol", "start", "high", "low", "close", "cast(trade_count as double) as volume", "low as bid", "high as ask")
    return rounded(indicators.five(rows, 5, 3))


_HOURS = f"select symbol, start, high, low, close, volume, case when low > 0 and high > 0 then (high - low) / ((high + low) / 2) end as s, close - lag(close) over (partition by symbol order by start) as c from ({_DAY_BARS})"
_DONE = f"select *, count(c) over (partition by symbol order by start) as n, avg(greatest(c, 0)) over l as g0, avg(greatest(-c, 0)) over l as l0 from ({_HOURS}) window l as (partition by symbol order by start rows between 2 preceding and current row)"
_SMOOTHED = ewm_sql(ewm_sql(_DONE, "case when n = 3 then g0 when n > 3 then greatest(c, 0) end", 1 / 3, "gain", by="symbol", order="start"), "case when n = 3 then l0 when n > 3 then greatest(-c, 0) end", 1 / 3, "loss", by="symbol", order="start")
register(
    "realtime_five", _five,
    f"""select symbol, start, momentum, case when n >= 1 then vwap_deviation end as vwap_deviation, volume_surge, round(case when k >= 5 and q >= 2 then case when sd < 1e-12 then 0 else greatest(least(-(now - usual) / sd / 3, 1), -1) end end, 6) as spread_signal,
    round(case when gain is not null then case when loss = 0 then 1 else 1 - 2 / (1 + gain / loss) end end, 6) as rsi from (
      select symbol, start, n, gain, loss, row_number() over (partition by symbol order by start) as k, count(s) over w as q, avg(s) over w as usual, stddev_pop(s) over w as sd, last_value(s ignore nulls) over w as now
      from ({_SMOOTHED}) window w as (partition by symbol order by start rows between 4 preceding and current row)) join ({_INDICATORS_SQL}) using (symbol, start)""",
)
