"""Sleeves and coin strategies; funds are assets of the weekly panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sleeves
from .catalog import register
from .factor_queries import WEEK, week
from .risk_queries import rounded, shown

TICKERS = {1: "SPY", 2: "GLD", 3: "TLT", 4: "SHY", 5: "EEM", 6: "VNQ", 7: "BTC", 8: "ETH", 9: "SOL"}
COINS = ("BTC", "ETH", "SOL")
#: Sleeves that have a return on enough weeks.
COMBINED = ["safe_haven", "dual_mom_spy", "corr_regime", "vol_regime_gld", "curve_rot", "xasset_mom"]
#: What a coin strategy trades.
_COIN_ROWS = "asset <= 12"


def _sleeves(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*[x for k, v in TICKERS.items() for x in (F.lit(k), F.lit(v))])
    rows = week(spark, d).where(F.col("asset") <= len(TICKERS)).withColumn("ticker", names[F.col("asset").cast("int")])
    return sleeves.sleeves(rows.select("date", "ticker", "price"), rows.where("ticker = 'SPY'").select("date", "open_"), COINS)


def _coins(spark: SparkSession, d: str) -> DataFrame:
    return week(spark, d).where(_COIN_ROWS).select("date", "asset", "price")


_WIDE = f"select date, {', '.join(f'max(price) filter (asset = {k}) as {v}' for k, v in TICKERS.items())}, max(open_) filter (asset = 1) as open_ from ({WEEK}) group by date"
_B = "lag({}, {}) over (order by date)"
_F = "over (order by date rows between {} preceding and current row)"


def _full(x: str, n: int, agg: str) -> str:
    return f"case when count({x}) {_F.format(n - 1)} >= {n} then {agg}({x}) {_F.format(n - 1)} end"


def _rank(x: str, n: int, share: float) -> str:
    return f"case when count({x}) {_F.format(n - 1)} >= {n} then round(quantile_cont({x}, {share}) {_F.format(n - 1)}, 9) end"


_ALL = list(TICKERS.values())
_RETS = ", ".join(f"{k} / nullif({_B.format(k, 1)}, 0) - 1 as r_{k}" for k in _ALL)
_MOMS = ", ".join(f"round({k} / nullif({_B.format(k, n)}, 0) - 1, 9) as m{n}_{k}" for k, n in [("GLD", 120), ("SHY", 120), *[(k, 60) for k in _ALL[:6]]]) + ", " + ", ".join(f"{k} / nullif({_B.format(k, 20)}, 0) - 1 as m20_{k}" for k in COINS)
_ABOVE = "coalesce((m{1}_{0} > 0 and m{1}_{0} > m{1}_SHY)::int, 0)"
_MULTI = ("SPY", "GLD", "TLT", "EEM", "VNQ")
_SLEEVES = f"""with w as ({_WIDE}), a as (select *, row_number() over (order by date) - 1 as i, {_RETS}, {_MOMS} from w),
b as (select *, round(({_full('r_SPY', 20, 'stddev_samp')}) * sqrt(252), 9) as stress, round({_full('r_TLT', 5, 'sum')}, 9) as r5, case when count(r_SPY * r_TLT) {_F.format(59)} >= 60 then round(corr(r_SPY, r_TLT) {_F.format(59)}, 9) end as co, round(({_full('r_GLD', 20, 'stddev_samp')}) * sqrt(252), 9) as gold,
  TLT / nullif(SHY, 0) as curve, round(GLD / ({_full('GLD', 50, 'avg')}) - 1, 9) as over, -(GLD - ({_full('GLD', 20, 'avg')})) / ({_full('GLD', 20, 'stddev_samp')}) as back,
  {', '.join(f"{_ABOVE.format(k, 60)} / nullif(round({_full(f'r_{k}', 60, 'stddev_samp')}, 12), 0) as v_{k}" for k in _MULTI)}, {', '.join(f"round(m20_{k} / nullif(round({_full(f'r_{k}', 20, 'stddev_samp')}, 12), 0), 9) as q_{k}" for k in COINS)} from a),
c as (select *, {_rank('stress', 252, 0.8)} as high, {_rank('gold', 252, 0.5)} as gold_mid, round((r5 - ({_full('r5', 252, 'avg')})) / ({_full('r5', 252, 'stddev_samp')}), 9) as z, round(curve / {_B.format('curve', 60)} - 1, 9) as cm from b),
s as (select *, coalesce((stress > high)::int, 0) as s1, {_ABOVE.format('GLD', 120)} as s2, {_ABOVE.format('SPY', 60)} as s3, case when z < -1.5 then 1 when z > 1.5 then -1 else 0 end as s4, coalesce((co < 0)::int, 0) as s5, coalesce((co > 0.3)::int, 0) as s6,
  case when gold > gold_mid then greatest(least(back, 2), -2) / 2 when over > 0 then 1 else -1 end as s7, coalesce((cm > 0)::int, 0) as s8 from c),
l as (select *, {', '.join(f"{_B.format(f's{k}', 1)} as p{k}" for k in range(1, 9))}, {', '.join(f"{_B.format(f'v_{k}', 1)} as u_{k}" for k in _MULTI)}, {', '.join(f"{_B.format(f'q_{k}', 1)} as g_{k}" for k in COINS)}, {_B.format('SPY', 1)} as before from s),
k as (select *, list_sort(list_filter([{', '.join(f"case when g_{k} is not null and r_{k} is not null then {{'q': g_{k}, 'i': {-i}, 'r': r_{k}}} end" for i, k in enumerate(COINS))}], lambda x: x is not null)) as held, list_filter([{', '.join(f'u_{k} * r_{k}' for k in _MULTI)}], lambda x: x is not null) as many from l)
select date, (1 - p1) * r_SPY + p1 * (r_GLD + r_TLT) / 2 as safe_haven, p2 * r_GLD as dual_mom_gld, p3 * r_SPY as dual_mom_spy, p4 * r_TLT as reversal_tlt, p5 * (0.6 * r_SPY + 0.4 * r_TLT) + p6 * (0.3 * r_SPY + 0.3 * r_GLD + 0.4 * r_SHY) as corr_regime,
  p7 * r_GLD as vol_regime_gld, p8 * r_SPY + (1 - p8) * r_TLT as curve_rot, list_avg(many) as xasset_mom, open_ / nullif(before, 0) - 1 as overnight, case when i >= 60 then case when len(held) < 2 then 0 else held[-1].r - held[1].r end end as coin_xmom from k"""
_MEAN = f"select date, ({' + '.join(COMBINED)}) / {len(COMBINED)} as r from ({_SLEEVES}) where {' and '.join(f'{n} is not null' for n in COMBINED)}"
_PARITY = f"with t as (select * from ({_SLEEVES}) where {' and '.join(f'{n} is not null' for n in COMBINED)}), v as (select {', '.join(f'1 / stddev_samp({n}) as w_{n}' for n in COMBINED)} from t) select date, ({' + '.join(f'{n} * w_{n}' for n in COMBINED)}) / ({' + '.join(f'w_{n}' for n in COMBINED)}) as r from t, v"


def _stats(sql: str) -> str:
    return f"""with r as ({sql}), e as (select *, case when min(r) over (order by date) <= -1 then 0 else exp(sum(case when r > -1 then ln(1 + r) end) over (order by date)) end as e from r), f as (select *, e / max(e) over (order by date) - 1 as fall from e)
    select round(coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0), 6) as sharpe, round(avg(r) * 252, 6) as annual_return, round(stddev_samp(r) * sqrt(252), 6) as annual_vol, round(min(fall), 6) as max_drawdown, round(avg((r > 0)::int), 6) as win_rate, count(*) as n from f having count(*) >= 50"""


register("sleeves", lambda spark, d: rounded(_sleeves(spark, d)), f"select date, {shown(' '.join(sleeves.SLEEVES))} from ({_SLEEVES})")
register("sleeves_equal", lambda spark, d: rounded(sleeves.combine(_sleeves(spark, d), COMBINED)), f"select date, round(r, 6) as r from ({_MEAN})")
register("sleeves_parity", lambda spark, d: rounded(sleeves.combine(_sleeves(spark, d), COMBINED, "risk_parity")), f"select date, round(r, 6) as r from ({_PARITY})")
register("sleeves_statistics", lambda spark, d: rounded(sleeves.statistics(sleeves.combine(_sleeves(spark, d), COMBINED))), _stats(_MEAN))
_P = f"select date, asset, price from ({WEEK}) where {_COIN_ROWS}"
_XS = f"""select date, asset, coalesce(-short / sum(short) over (partition by date), long / sum(long) over (partition by date), 0) as signal from (
  select date, asset, case when k >= 5 and m is not null and up <= 3 then iv end as long, case when k >= 5 and m is not null and down <= 2 then iv end as short from (
    select *, count(m) over (partition by date) as k, row_number() over (partition by date order by m desc nulls last, asset) as up, row_number() over (partition by date order by m nulls last, asset desc) as down from (
      select date, asset, round(price / nullif(lag(price, 20) over w, 0) - 1, 9) as m, 1 / nullif(round(case when count(ret) over f >= 20 then stddev_samp(ret) over f end, 12), 0) as iv
      from (select *, price / nullif(lag(price) over (partition by asset order by date), 0) - 1 as ret from ({_P})) window w as (partition by asset order by date), f as (partition by asset order by date rows between 19 preceding and current row))))"""
_MR = f"select date, asset, case when z < -2 or z > 2 then -z else 0 end as signal from (select date, asset, case when count(price) over f >= 20 then round((price - avg(price) over f) / nullif(round(stddev_samp(price) over f, 12), 0), 9) end as z from ({_P}) window f as (partition by asset order by date rows between 19 preceding and current row))"


def _backtest(signals: str) -> str:
    return f"select date, round(coalesce(sum(x), 0), 9) as r from (select date, lag(signal) over (partition by asset order by date) * ret as x from (select date, asset, price / nullif(lag(price) over (partition by asset order by date), 0) - 1 as ret from ({_P})) left join ({signals}) using (date, asset)) group by date"


_EQUITY = "select date, round(r, 6) as r, round(case when min(r) over (order by date) > -1 then exp(sum(ln(1 + r)) over (order by date)) else 0 end, 4) as equity from ({})"
_SCALE = f"select date, asset, signal * scale as signal from ({_XS}) join (select date, case when vol > 0 then least(0.15 / vol, 2) else 1 end as scale from (select date, round(case when count(r) over f >= 20 then stddev_samp(r) over f end * sqrt(365), 12) as vol from ({_backtest(_XS)}) window f as (order by date rows between 19 preceding and current row))) using (date)"
register("coin_momentum", lambda spark, d: rounded(sleeves.coin_momentum(_coins(spark, d))), f"select date, asset, round(signal, 6) as signal from ({_XS})")
register("coin_mean_reversion", lambda spark, d: rounded(sleeves.mean_reversion(_coins(spark, d))), f"select date, asset, round(signal, 6) as signal from ({_MR})")
register("coin_backtest", lambda spark, d: sleeves.vector_backtest(sleeves.coin_momentum(_coins(spark, d)), _coins(spark, d)).select("date", F.round("r", 6).alias("r"), F.round("equity", 4).alias("equity")), _EQUITY.format(_backtest(_XS)))
register("coin_volatility_target", lambda spark, d: rounded(sleeves.scaled(sleeves.coin_momentum(_coins(spark, d)), _coins(spark, d))), f"select date, asset, round(signal, 6) as signal from ({_SCALE})")
