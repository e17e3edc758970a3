"""Signals by configuration, scaled by regimes; sectors are regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dispatch, factors, macro, portfolio
from ..sources.panels import sized
from . import audit_queries  # noqa: F401  trend_regime comes first
from .catalog import MARKET, MONTH, ORACLES, REGIONS, STRATEGIES, market, month, read, regions, register, strategies
from .evaluation_queries import COLUMNS, TALL, sized_tall, tall
from .factor_queries import WEEK, week
from .registry import _MOM, _SIGNAL_SQL
from .risk_queries import rounded

PAIRS = {"calm_momentum": ("momentum_12_1", "volatility_12m"), "peak_momentum": ("momentum_12_1", "high_52_week"), "tail_peak": ("max_return_12m", "high_52_week"), "downside_peak": ("downside_vol", "high_52_week"), "tail_momentum": ("max_return_12m", "momentum_12_1")}
#: The classic composite's factors, without fundamentals.
PARTS = {"multi_timeframe_momentum": dispatch.CLASSIC["momentum"], "momentum_acceleration": dispatch.CLASSIC["acceleration"], "volatility_12m": dispatch.CLASSIC["volatility"]}
_MEMBERS = {n: factors.MONTHLY[n] for n in PARTS}
_PARTS_SQL = factors.compute_all_sql(MONTH, COLUMNS, _MEMBERS)


def _place(x: str, by: str, least: int = 10) -> str:
    return f"case when {x} is not null and count({x}) over (partition by {by}) >= {least} then 2 * (rank() over (partition by {by} order by {x} nulls last) + (count({x}) over (partition by {by}, {x}) - 1) / 2) / count({x}) over (partition by {by}) - 1 end"


def _rets(spark: SparkSession, d: str) -> DataFrame:
    return month(spark, d).select("date", "asset", F.round("ret", 9).alias("x"))


_RETS = f"select date, asset, round(ret, 9) as x from ({MONTH})"
register("as_signal_rank", lambda spark, d: rounded(dispatch.as_signal(_rets(spark, d), "x")), f"select date, asset, round({_place('x', 'date', 1)}, 6) as signal from ({_RETS})")
register("as_signal_zscore", lambda spark, d: rounded(dispatch.as_signal(_rets(spark, d), "x", "zscore")), f"select date, asset, round(case when z > 3 then 1 when z < -3 then -1 else z / 3 end, 6) as signal from (select date, asset, (x - avg(x) over (partition by date)) / nullif(round(stddev_samp(x) over (partition by date), 12), 0) as z from ({_RETS}))")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    months, size = sized(spark, d, "month")
    return factors.compute_all(months, _MEMBERS, size=size)


_SUM = " + ".join(f"max(signal) filter (factor = '{n}') * {w}" for n, w in PARTS.items())
register("classic_composite", lambda spark, d: rounded(dispatch.composite(_parts(spark, d), PARTS)), f"select date, asset, round({_SUM}, 6) as signal from ({_PARTS_SQL}) group by 1, 2")
_PRODUCTS = " union all ".join(f"select '{n}' as factor, date, asset, round(max(signal) filter (factor = '{a}') * max(signal) filter (factor = '{b}'), 9) as x from ({TALL}) group by 2, 3" for n, (a, b) in PAIRS.items())


def _interactions(spark: SparkSession, d: str) -> DataFrame:
    signals, size = sized_tall(spark, d)
    return rounded(dispatch.interactions(signals, PAIRS, size=size))


register("factor_interactions", _interactions, f"select factor, date, asset, round({_place('x', 'factor, date')}, 6) as signal from ({_PRODUCTS})")
_SCALES = f"""select date, ratio, case when ratio > 1.5 then 0.5 when ratio > 1.2 then 0.75 when ratio < 0.8 then 1.2 else 1 end::double as momentum, case when ratio > 1.5 then 1.1 when ratio < 0.7 then 0.9 else 1 end::double as other from (
  select date, round(v / case when count(v) over w >= 12 then nullif(median(v) over w, 0) end, 9) as ratio from (select date, round(case when count(m) over s >= 6 then stddev_samp(m) over s end * sqrt(12), 9) as v from ({MARKET}) window s as (order by date rows between 5 preceding and current row)) window w as (order by date))"""
register("regime_scales", lambda spark, d: rounded(dispatch.regime_scale(market(spark, d))), f"select date, round(ratio, 6) as ratio, momentum, other from ({_SCALES})")
_MOVED = ("momentum_12_1", "high_52_week")
register(
    "regime_adjusted", lambda spark, d: rounded(dispatch.regime_adjusted(tall(spark, d), market(spark, d), _MOVED)),
    f"select factor, date, asset, round(signal * coalesce(case when factor in {_MOVED!r} then momentum else other end, 1), 6) as signal from ({TALL}) left join ({_SCALES}) using (date)",
)


def _sectors(spark: SparkSession, d: str) -> DataFrame:
    return month(spark, d).join(F.broadcast(regions(spark, d).select("asset", F.col("region").alias("sector"))), "asset").select("date", "asset", "sector", F.round("ret", 9).alias("ret"))


_SECTORS = f"select date, asset, region as sector, round(ret, 9) as ret from ({MONTH}) join ({REGIONS}) using (asset)"
register(
    "sector_strength", lambda spark, d: rounded(dispatch.sector_strength(_sectors(spark, d))),
    f"select date, asset, round({_place('x', 'date')}, 6) as signal from (select date, asset, round(case when count(a) over w >= 20 then sum(a) over w end, 9) as x from (select date, asset, ret - avg(ret) over (partition by date, sector) as a from ({_SECTORS})) window w as (partition by asset order by date rows between 19 preceding and current row))",
)
register(
    "sector_trends", lambda spark, d: rounded(dispatch.sector_trends(strategies(spark, d).withColumnRenamed("strategy", "sector"))),
    f"select sector, date, round({_place('x', 'date', 2)}, 6) as momentum, round({_place('y', 'date', 2)}, 6) as reversion from (select strategy as sector, date, round(case when count(r) over s >= 20 then sum(r) over s end, 9) as x, round(case when count(r) over f >= 5 then -sum(r) over f end, 9) as y from ({STRATEGIES}) window s as (partition by strategy order by date rows between 19 preceding and current row), f as (partition by strategy order by date rows between 4 preceding and current row))",
)
_FILLS = "select l_orderkey, l_linenumber, cast(l_extendedprice as double) / cast(l_quantity as double) as price, cast(l_quantity as double) as quantity, case when l_returnflag = 'R' then 'Sell' else 'Buy' end as side from lineitem"
register(
    "order_fees", lambda spark, d: dispatch.order_fee(read(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "cast(l_extendedprice as double) / cast(l_quantity as double) as price", "cast(l_quantity as double) as quantity", "case when l_returnflag = 'R' then 'Sell' else 'Buy' end as side")).groupBy("side").agg(F.round(F.sum(F.round("fee", 6)), 2).alias("fees"), F.count("*").alias("orders")),
    f"select side, round(sum(round(price * quantity * 3.5e-4 + case when side = 'Sell' then price * quantity * 30e-4 / 252 else 0 end, 6)), 2) as fees, count(*) as orders from ({_FILLS}) group by 1",
)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    rows = factors.compute(month(spark, d), _MOM, keep=("price",))
    return rounded(dispatch.labelled(rows, rows))


_AHEAD = ", ".join(f"lead(price, {k}) over (partition by asset order by date) / nullif(price, 0) - 1 as fwd_{k}" for k in (1, 5, 10))
register(
    "labelled_factors", _labelled,
    f"""with b as (select date, asset, signal, fwd_1, fwd_5, fwd_10 from ({_SIGNAL_SQL}) join (select date, asset, {_AHEAD} from ({MONTH})) using (date, asset) where signal is not null and fwd_1 is not null and fwd_5 is not null and fwd_10 is not null)
    select date, asset, round(signal, 6) as factor, ((row_number() over (partition by date order by signal, asset) - 1) * 5 // count(*) over (partition by date) + 1)::int as bucket, round(fwd_1, 6) as fwd_1, round(fwd_5, 6) as fwd_5, round(fwd_10, 6) as fwd_10 from b""",
)
_AB = f"""select asset, date, case when count(g) over s >= 15 then avg(g) over s end as a, case when count(volume) over s >= 15 then avg(volume) over s end / nullif(case when count(volume) over l >= 40 then avg(volume) over l end, 0) as b
  from (select *, (high - low) / nullif(price, 0) as g from ({WEEK})) window s as (partition by asset order by date rows between 19 preceding and current row), l as (partition by asset order by date rows between 59 preceding and current row)"""
_Z = "case when count({0}) over y >= 60 then ({0} - avg({0}) over y) / (stddev_samp({0}) over y + 1e-10) end"
register(
    "liquidity_regime", lambda spark, d: macro.liquidity_regime(week(spark, d)),
    f"""with s as (select asset, date, round({_Z.format('a')} - {_Z.format('b')}, 9) as score from ({_AB}) window y as (partition by asset order by date rows between 251 preceding and current row)),
    h as (select *, list(score) filter (score is not null) over y as held, count(score) over y as k, count(*) over y as n from s window y as (partition by asset order by date rows between 251 preceding and current row)),
    r as (select *, case when score is not null and k >= 60 then len(list_filter(held, lambda x: x < score)) / (n - 1) end as share from h)
    select asset, date, case when share < 0.3 then 'ample' when share > 0.7 then 'tight' else 'normal' end as liquidity from r""",
)
COMBOS = {
    "peaks": {"momentum_12_1": 0.6, "high_52_week": 0.4}, "calm_peaks": {"momentum_12_1": 0.5, "high_52_week": 0.3, "volatility_12m": -0.2}, "lottery": {"max_return_12m": -1.0}, "defensive": {"volatility_12m": -0.5, "downside_vol": -0.5},
    "all": {"momentum_12_1": 0.3, "volatility_12m": -0.2, "max_return_12m": -0.1, "high_52_week": 0.3, "downside_vol": -0.1}, "timed_peaks": {"momentum_12_1": 0.6, "high_52_week": 0.4},
}
_SUMS = " union all ".join(
    f"select '{n}' as combo, date, asset, round(sum(signal * case factor {' '.join(f'when {f!r} then {w}' for f, w in c.items())} end) / nullif(sum(case when signal is not null then abs(case factor {' '.join(f'when {f!r} then {w}' for f, w in c.items())} end) end), 0), 9) as x from ({TALL}) where factor in ({', '.join(map(repr, c))}) group by 2, 3"
    for n, c in COMBOS.items()
)


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    signals, size = sized_tall(spark, d)
    return rounded(dispatch.catalogue(signals, COMBOS, market(spark, d), ("timed_peaks",), size=size))


register(
    "signal_catalogue", _catalogue,
    f"select combo, date, asset, round(signal * case when combo = 'timed_peaks' then coalesce(momentum, 1) else 1 end, 6) as signal from (select combo, date, asset, {_place('x', 'combo, date')} as signal from ({_SUMS})) left join ({_SCALES}) using (date)",
)
register(
    "regime_history", lambda spark, d: dispatch.regime_history({"trend": macro.trend_regime(week(spark, d)), "liquidity": macro.liquidity_regime(week(spark, d))}, 10),
    f"select asset, date, trend, liquidity from ({ORACLES['trend_regime']}) join ({ORACLES['liquidity_regime']}) using (asset, date) qualify row_number() over (partition by asset order by date desc) <= 10",
)
_EVENTS = f"select date, count(*) * 0.001 / 5 as paid from ({ORACLES['entries_exits']}) group by 1"
register(
    "long_only_replay", lambda spark, d: portfolio.long_only(factors.compute(month(spark, d), _MOM), month(spark, d), 5, 3, 0.001).select("date", F.round("equity", 6).alias("equity"), "names"),
    f"""with s as ({_SIGNAL_SQL}), c as (select date, row_number() over (order by date) - 1 as i from (select distinct date from s where signal is not null)), m as (select date as bought, lead(date) over (order by date) as sold from c where i % 3 = 0),
    h as (select date as bought, asset from s join c using (date) where signal is not null and i % 3 = 0 qualify row_number() over (partition by date order by signal desc, asset) <= 5),
    x as (select h.bought, h.asset, p.date, coalesce(p.ret, 0) as r from h join m using (bought) join ({MONTH}) p on p.asset = h.asset and p.date > h.bought and (sold is null or p.date <= sold)),
    g as (select bought, asset, date, case when min(r) over w <= -1 then 0 else exp(sum(case when r > -1 then ln(1 + r) end) over w) end as g from x window w as (partition by bought, asset order by date)),
    a as (select bought, date, avg(g) as m, count(*) as names from g group by 1, 2), e as (select bought, arg_max(a.m, a.date) * (1 - coalesce(any_value(paid), 0)) as step, coalesce(any_value(paid), 0) as paid from a left join ({_EVENTS}) v on v.date = a.bought group by 1),
    k as (select bought, paid, coalesce(product(step) over (order by bought rows between unbounded preceding and 1 preceding), 1) as carried from e)
    select date, round(carried * (1 - paid) * m, 6) as equity, names from a join k using (bought)""",
)
