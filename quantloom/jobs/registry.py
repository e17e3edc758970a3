"""Registered queries and their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import compound, cs_zscore
from ..operators import evaluate, factors, joins, performance, portfolio, screen
from ..sources.panels import FIELDS, panel, panel_sql
from ..streaming import indicators, ticks
from .catalog import ORACLES, QUERIES, register

FLAGSHIP = "ic_summary_momentum"
COLUMNS = ("asset", "date", *FIELDS, "price", "ret", "mkt")
#: Suppliers that make an asset of the weekly panel: with four, 99.9 % of its cells have a close, so that frames of 20 rows are whole.
PER = 4


def _factor(unit: str, per: int, stages: factors.Stages, spark: SparkSession, d: str) -> DataFrame:
    return factors.compute(panel(spark, d, unit, per), stages)


for _unit, _per, _family in (("month", 1, factors.MONTHLY), ("week", PER, factors.DAILY), ("week", PER, factors.ALPHA), ("week", PER, {f"formula_{k}": v for k, v in factors.FORMULAS.items()})):
    for _name, _stages in _family.items():
        register(f"factor_{_name}", partial(_factor, _unit, _per, _stages), factors.compute_sql(panel_sql(_unit, _per), COLUMNS, factors.SQL_STAGES.get(_name, _stages)))

for _unit in ("month", "week"):
    _show = ["asset", "date", *[f"round({c}, 11) as {c}" for c in (*FIELDS, "ret", "mkt")]]
    register(f"panel_{_unit}", lambda spark, d, unit=_unit, show=_show: panel(spark, d, unit).selectExpr(*show), f"select {', '.join(_show)} from ({panel_sql(_unit)})")

_Z = ["asset", "date", f"round({cs_zscore('ret')}, 6) as z"]
register("cs_zscore", lambda spark, d: panel(spark, d, "month").selectExpr(*_Z), f"select {', '.join(_Z)} from ({panel_sql('month')})")

_MOM = factors.MONTHLY["momentum_12_1"]
_SIGNAL_SQL = factors.compute_sql(panel_sql("month"), COLUMNS, _MOM)


def _study(spark: SparkSession, d: str, lags: tuple[int, ...] = (1,)) -> DataFrame:
    """asset, date, value, signal and the forward returns fwd_L, of one panel."""
    ahead = panel(spark, d, "month").selectExpr("*", *[f"round({compound('ret', k, -k)}, 9) as fwd_{k}" for k in lags])
    return factors.compute(ahead, _MOM, keep=tuple(f"fwd_{k}" for k in lags))


def _study_sql(lags: tuple[int, ...] = (1,)) -> str:
    forward = ", ".join(f"round({compound('ret', k, -k)}, 9) as fwd_{k}" for k in lags)
    return f"select * from ({_SIGNAL_SQL}) join (select asset, date, {forward} from ({panel_sql('month')})) using (asset, date)"


LAGS = (1, 2, 3, 5, 10, 20)
register("ic_series_momentum", lambda spark, d: evaluate.ic_series(_study(spark, d), "fwd_1"), evaluate.ic_series_sql(_study_sql(), "fwd_1"))
register("ic_summary_momentum", lambda spark, d: evaluate.ic_summary(evaluate.ic_series(_study(spark, d), "fwd_1")), evaluate.ic_summary_sql(evaluate.ic_series_sql(_study_sql(), "fwd_1")))
register("ic_decay_momentum", lambda spark, d: evaluate.ic_decay(_study(spark, d, LAGS), LAGS), evaluate.ic_decay_sql(_study_sql(LAGS), LAGS))
register("top_k_momentum", lambda spark, d: evaluate.top_k(_study(spark, d), 10), evaluate.top_k_sql(_study_sql(), 10))
register("quantile_returns_momentum", lambda spark, d: evaluate.quantile_returns(_study(spark, d), "fwd_1", 5), evaluate.quantile_returns_sql(_study_sql(), "fwd_1", 5))
register("market_drawdown", lambda spark, d: evaluate.drawdown(panel(spark, d, "month")), evaluate.drawdown_sql(panel_sql("month")))
register("market_tail_risk", lambda spark, d: evaluate.tail_risk(panel(spark, d, "month")), evaluate.tail_risk_sql(panel_sql("month")))

_WEIGHTS_SQL = portfolio.weights_sql(_SIGNAL_SQL, 3, 3)
_REPLAY_SQL = portfolio.replay_sql(_WEIGHTS_SQL, panel_sql("month"), 0.0015)
_SERIES_SQL = f"select date, net as r from ({_REPLAY_SQL})"


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.target_weights(factors.compute(panel(spark, d, "month"), _MOM), 3, 3)


def _replay(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.replay(_weights(spark, d), panel(spark, d, "month"), 0.0015)


def _series(spark: SparkSession, d: str) -> DataFrame:
    return _replay(spark, d).selectExpr("date", "net as r")


register("target_weights_momentum", _weights, _WEIGHTS_SQL)
register("rebalance_orders_momentum", lambda spark, d: portfolio.rebalance_orders(_weights(spark, d)), portfolio.orders_sql(_WEIGHTS_SQL))
register("replay_momentum", _replay, _REPLAY_SQL)
register("performance_momentum", lambda spark, d: performance.measures(_series(spark, d)), performance.measures_sql(_SERIES_SQL))
register("yearly_momentum", lambda spark, d: performance.yearly(_series(spark, d)), performance.yearly_sql(_SERIES_SQL))
register("rolling_sharpe_momentum", lambda spark, d: performance.rolling_sharpe(_series(spark, d)), performance.rolling_sharpe_sql(_SERIES_SQL))
register("drawdown_episodes_momentum", lambda spark, d: performance.drawdown_episodes(_series(spark, d)), performance.drawdown_episodes_sql(_SERIES_SQL))

_SHORT = f"(select date, sum(greatest(-weight, 0)) as short, 1.3 / count(*) as pos from ({_WEIGHTS_SQL}) group by 1)"
_ADV = "select asset, date, close * volume as adv from ({}) where close is not null"
_RATES = {"fixed": "0.00035", "tiered": "case when pos * 1e6 < 1e4 then 0.002 when pos * 1e6 < 1e5 then 0.001 else 0.0005 end", "default": "0.00104"}
for _model in ("fixed", "tiered", "default", "linear", "sqrt", "full"):
    _each = f"sum(trades * pos * ({_RATES[_model]}))" if _model in _RATES else f"sum(0.00035 * pos + 0.3 * {'least(part, 0.5)' if _model == 'linear' else 'sqrt(least(part, 1))'} * pos + 0.00004 * pos) + any_value(short) * 0.00025"
    register(
        f"rebalance_costs_{_model}",
        lambda spark, d, m=_model: portfolio.rebalance_costs(_weights(spark, d), panel(spark, d, "month").where("close is not null").selectExpr("asset", "date", "close * volume as adv"), m, 1e6).select("date", F.round("cost", 9).alias("cost")),
        f"select date, round({_each}, 9) as cost from (select *, 1e6 * pos / (coalesce(greatest(adv, 1e4), 1e9) + 1e-6) as part from ({portfolio.orders_sql(_WEIGHTS_SQL)}) o left join ({_ADV.format(panel_sql('month'))}) a using (asset, date) join {_SHORT} s using (date)) group by 1",
    )
register("entries_exits", lambda spark, d: portfolio.entries_exits(factors.compute(panel(spark, d, "month"), _MOM), 5, 3), f"""with s as ({_SIGNAL_SQL}), d as (select date, row_number() over (order by date) - 1 as i from (select distinct date from s where signal is not null)), b as (select i, asset from s join d using (date) where signal is not null and i % 3 = 0 qualify row_number() over (partition by date order by signal desc, asset) <= 5),
e as (select i, asset, 'entry' as event from b where (i - 3, asset) not in (select i, asset from b) union all select i + 3, asset, 'exit' from b where (i + 3, asset) not in (select i, asset from b)) select date, asset, event from e join d using (i)""")
register("ma_crossover", lambda spark, d: portfolio.ma_crossover(panel(spark, d, "month"), 3, 12).select("asset", "date", "position", F.round("earned", 9).alias("earned")), f"""with m as (select asset, date, ret, case when count(price) over f >= 3 and count(price) over s >= 12 then (round(avg(price) over f - avg(price) over s, 9) > 0)::int end as above from ({panel_sql('month')}) window f as (partition by asset order by date rows between 2 preceding and current row), s as (partition by asset order by date rows between 11 preceding and current row)),
p as (select *, coalesce(lag(above) over (partition by asset order by date), 0) as position from m) select asset, date, position, round(position * coalesce(ret, 0), 9) as earned from p""")
register("limited_weights", lambda spark, d: portfolio.risk_limits(_weights(spark, d), 0.3, 0.8, 0.5).select("date", "asset", F.round("weight", 9).alias("weight")), f"with c as (select date, asset, greatest(least(weight, 0.3), -0.3) as w from ({_WEIGHTS_SQL})), t as (select *, sum(abs(w)) over (partition by date, w > 0) as t from c) select date, asset, round(w * least(1, case when w > 0 then 0.8 else 0.5 end / t), 9) as weight from t")


def _plan(spark: SparkSession, d: str) -> DataFrame:
    supplier = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("asset"), "s_acctbal")
    prices = supplier.select("asset", (F.abs("s_acctbal") / 1000 + 1).alias("price"))
    return portfolio.order_plan(supplier.where("asset % 3 = 0").select("asset"), supplier.where("asset % 2 = 0").selectExpr("asset", "100 + asset as shares"), prices, 1e5)


register("order_plan", _plan, "with s as (select s_suppkey as asset, floor(100000.0 / (select count(*) from supplier where s_suppkey % 3 = 0) / (abs(s_acctbal) / 1000 + 1) / 100) * 100 as lots from supplier) select asset, 'sell' as side, (100 + asset)::bigint as shares from s where asset % 2 = 0 and asset % 3 <> 0 union all select asset, 'buy', lots::bigint from s where asset % 3 = 0 and asset % 2 <> 0 and lots >= 100")

_FIT = ("count(*) as n", "round(regr_slope(ret, mkt), 6) as beta", "round(regr_intercept(ret, mkt) * 12, 6) as alpha", "round(regr_r2(ret, mkt), 6) as r2")
register("market_attribution", lambda spark, d: panel(spark, d, "month").where("ret is not null and mkt is not null").groupBy("asset").agg(*[F.expr(x) for x in _FIT]), f"select asset, {', '.join(_FIT)} from ({panel_sql('month')}) where ret is not null and mkt is not null group by asset")


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", "user_id as symbol", "ts", "event_type as kind", "value as price")


_TICKS_SQL = "select event_id, user_id as symbol, ts, event_type as kind, value as price from events where ts is not null"
register(
    "tick_bars_hour",
    lambda spark, d: ticks.tick_bars(_ticks(spark, d), "1 hour"),
    f"select symbol, date_trunc('hour', ts) as start, arg_min(price, (ts, event_id)) as open_, max(price) as high, min(price) as low, arg_max(price, (ts, event_id)) as close, round(avg(price), 6) as mean, count(*) as trade_count from ({_TICKS_SQL}) group by 1, 2",
)
register("latest_ticks", lambda spark, d: ticks.latest(_ticks(spark, d)), f"select symbol, kind, ts, event_id, price from ({_TICKS_SQL}) qualify row_number() over (partition by symbol, kind order by ts desc, event_id desc) = 1")
register(
    "tick_sessions",
    lambda spark, d: ticks.sessions(_ticks(spark, d), "6 hours"),
    f"""select symbol, min(ts) as start, max(ts) + interval 6 hour as stop, count(*) as ticks, round(sum(price), 4) as total from (
      select *, sum(fresh) over (partition by symbol order by ts, event_id rows unbounded preceding) as run from (
        select *, case when ts < lag(ts) over (partition by symbol order by ts, event_id) + interval 6 hour then 0 else 1 end as fresh from ({_TICKS_SQL}))) group by symbol, run""",
)


_DAY_BARS = "select user_id as symbol, date_trunc('hour', ts) as start, max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close, count(*)::double as volume from events where ts is not null group by 1, 2"
_WEIGHTS = {"momentum": 0.5, "vwap_deviation": 0.3, "volume_surge": 0.2}


def _indicators(spark: SparkSession, d: str) -> DataFrame:
    bars = ticks.tick_bars(_ticks(spark, d), "1 hour").selectExpr("symbol", "start", "high", "low", "close", "cast(trade_count as double) as volume")
    x = indicators.indicators(bars, 5)
    return x.select("symbol", "start", *[F.round(c, 6).alias(c) for c in _WEIGHTS])


_INDICATORS_SQL = f"""select symbol, start, round(close / nullif(lag(close, 5) over s, 0) - 1, 6) as momentum, round((close - v) / nullif(v, 0), 6) as vwap_deviation, round(volume / case when k >= 4 then u end - 1, 6) as volume_surge from (
  select *, sum((high + low + close) / 3 * volume) over (partition by symbol, start::date order by start) / sum(volume) over (partition by symbol, start::date order by start) as v, count(*) over (partition by symbol order by start rows between 4 preceding and 1 preceding) as k, avg(volume) over (partition by symbol order by start rows between 4 preceding and 1 preceding) as u
  from ({_DAY_BARS})) window s as (partition by symbol order by start)"""
_MEAN_SQL = f"({' + '.join(f'coalesce({c} * {w}, 0)' for c, w in _WEIGHTS.items())}) / nullif({' + '.join(f'case when {c} is null then 0 else {w} end' for c, w in _WEIGHTS.items())}, 0)"
_COMPOSITE_SQL = f"select symbol, start, round(case when m > 1 then 1 when m < -1 then -1 else m end, 9) as composite from (select symbol, start, {_MEAN_SQL} as m from ({_INDICATORS_SQL}))"


def _composite(spark: SparkSession, d: str) -> DataFrame:
    return indicators.composite(_indicators(spark, d), _WEIGHTS).select("symbol", "start", F.round("composite", 9).alias("composite"))


register("realtime_indicators", _indicators, _INDICATORS_SQL)
register("realtime_composite", _composite, _COMPOSITE_SQL)
register("realtime_cross_section", lambda spark, d: indicators.cross_section(_composite(spark, d)).select("symbol", "start", F.round("signal", 6).alias("signal")), f"select symbol, start, round(case when composite is not null and n >= 5 then 2 * p / n - 1 end, 6) as signal from (select *, count(composite) over (partition by start) as n, rank() over (partition by start order by composite nulls last) + (count(composite) over (partition by start, composite) - 1) / 2 as p from ({_COMPOSITE_SQL}))")
register("last_ticks", lambda spark, d: indicators.last_n(_ticks(spark, d), 3), f"select symbol, kind, ts, event_id, price, (row_number() over (partition by symbol, kind order by ts desc, event_id desc))::int as place from ({_TICKS_SQL}) qualify place <= 3")
register("buffer_stats", lambda spark, d: indicators.buffer_stats(_ticks(spark, d), spark.range(0, 200, 2).toDF("symbol")), "select user_id as symbol, event_type as kind, count(*) as n from events where user_id % 2 = 0 and user_id < 200 group by 1, 2")


def _asof(spark: SparkSession, d: str) -> DataFrame:
    every = _ticks(spark, d)
    quotes = every.where("kind = 'signup'").selectExpr("symbol", "ts", "event_id as quote_id", "price as quote")
    return joins.asof_join(every.where("kind = 'purchase'"), quotes, "symbol", "ts", ["quote_id", "quote"])


register(
    "asof_quotes",
    _asof,
    f"""select t.*, q.event_id as quote_id, q.price as quote from (select * from ({_TICKS_SQL}) where kind = 'purchase') t left join (select * from ({_TICKS_SQL}) where kind = 'signup') q on q.symbol = t.symbol and q.ts <= t.ts
    qualify row_number() over (partition by t.event_id order by q.ts desc nulls last, q.event_id desc) = 1""",
)


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey", "o_custkey as customer", "cast(o_orderdate as date) as since", "o_orderpriority as priority")
    lines = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "cast(l_shipdate as date) as shipped")
    facts = lines.join(orders.selectExpr("o_orderkey as l_orderkey", "customer"), "l_orderkey")
    return joins.interval_join(facts, joins.validity(orders, "customer", "since", "o_orderkey"), "customer", "shipped", "since", "until")


register(
    "interval_orders",
    _intervals,
    """with o as (select o_orderkey, o_custkey as customer, o_orderdate::date as since, o_orderpriority as priority from orders),
    v as (select *, coalesce(lead(since) over (partition by customer order by since, o_orderkey) - 1, date '9999-12-31') as until from o)
    select l_orderkey, l_linenumber, l_shipdate::date as shipped, v.* from lineitem join o on l_orderkey = o.o_orderkey join v on v.customer = o.customer and l_shipdate::date between v.since and v.until""",
)

_BLEND = {"momentum_12_1": 0.7, "volatility_12m": 0.2, "max_return_12m": 0.1}


def _tall(spark: SparkSession, d: str) -> DataFrame:
    """The signals of _BLEND, one row for each factor."""
    dense, tall = panel(spark, d, "month"), None
    for name in _BLEND:
        one = factors.compute(dense, factors.MONTHLY[name]).selectExpr("date", "asset", f"'{name}' as factor", "signal")
        tall = one if tall is None else tall.unionByName(one)
    return tall


_TALL_SQL = " union all ".join(f"select date, asset, '{n}' as factor, signal from ({factors.compute_sql(panel_sql('month'), COLUMNS, factors.MONTHLY[n])})" for n in _BLEND)
_SHOWN = ["asset", "date", "round(close, 9) as close"]
_PAIRS = ("date", "asset", "round(ret, 9) as y", "round(volume, 6) as x")
_METRIC = ("asset", "date", "round(volume, 6) as x")
register("universe_filter", lambda spark, d: screen.universe(panel(spark, d, "month"), 5, 0.6).selectExpr(*_SHOWN), f"select {', '.join(_SHOWN)} from ({screen.universe_sql(panel_sql('month'), 5, 0.6)})")
register("winsorized_returns", lambda spark, d: screen.winsorize(panel(spark, d, "month"), "ret", 0.01, 0.99), screen.winsorize_sql(panel_sql("month"), "ret", 0.01, 0.99))
register("masked_momentum", lambda spark, d: screen.masked(factors.compute(panel(spark, d, "month"), _MOM), panel(spark, d, "month"), 0.75), screen.masked_sql(_SIGNAL_SQL, panel_sql("month"), 0.75))
register("blended_signal", lambda spark, d: screen.blend(_tall(spark, d), _BLEND), screen.blend_sql(_TALL_SQL, _BLEND))
register("residual_returns", lambda spark, d: screen.residual(panel(spark, d, "month").selectExpr(*_PAIRS)), screen.residual_sql(f"select {', '.join(_PAIRS)} from ({panel_sql('month')})"))
register("monthly_movers", lambda spark, d: screen.movers(panel(spark, d, "month"), 5), screen.movers_sql(panel_sql("month"), 5))
register("volume_anomalies", lambda spark, d: screen.anomalies(panel(spark, d, "week").selectExpr(*_METRIC)), screen.anomalies_sql(f"select {', '.join(_METRIC)} from ({panel_sql('week')})"))

from . import allocation_queries, audit_queries, cleaning_queries, dispatch_queries, evaluation_queries, factor_queries, learning_queries, regime_queries, regression_queries, risk_queries, signal_queries, simulation_queries, sleeve_queries  # noqa: E402, F401  they register themselves
