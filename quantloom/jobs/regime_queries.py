"""Macro betas, flows and regimes: the market is the weekly mean return, sectors are regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import macro
from .catalog import MONTH, STRATEGIES, month, register, strategies
from .factor_queries import WEEK, week
from .risk_queries import rounded


def _frame(n: int, key: str = "asset", lag: int = 0) -> str:
    return f"over (partition by {key} order by date rows between {n - 1 + lag} preceding and {f'{lag} preceding' if lag else 'current row'})"


def _mean(x: str, n: int, key: str = "asset", least: int | None = None, agg: str = "avg") -> str:
    return f"(case when count({x}) {_frame(n, key)} >= {least or n} then {agg}({x}) {_frame(n, key)} end)"


def _beta(y: str, x: str, n: int) -> str:
    k = max(n // 2, 20)
    return f"(({_mean(f'{x} * {y}', n, least=k)} - {_mean(x, n, least=k)} * {_mean(y, n, least=k)}) / case when round({_mean(x, n, least=k, agg='var_samp')}, 15) <> 0 then {_mean(x, n, least=k, agg='var_samp')} end)"


def _panel(spark: SparkSession, d: str) -> DataFrame:
    """The weekly panel with x, a stand-in for a commodity: the market's squared return."""
    return week(spark, d).withColumn("x", F.col("mkt") * F.col("mkt") * 10)


_P = f"(select *, mkt * mkt * 10 as x from ({WEEK}))"
register("macro_beta", lambda spark, d: rounded(_panel(spark, d).select("asset", "date", macro.rolling_beta("ret", "x", 60).alias("value"))), f"select asset, date, round({_beta('ret', 'x', 60)}, 6) as value from {_P}")
register("commodity_tilt", lambda spark, d: rounded(macro.commodity_tilt(_panel(spark, d))), f"select asset, date, round({_beta('ret', 'x', 60)} * sign({_mean('x', 20)}), 6) as value from {_P}")
register("down_beta", lambda spark, d: rounded(macro.down_beta(_panel(spark, d))), f"select asset, date, round({_beta('ret', 'x', 60)}, 6) as value from (select * replace (case when mkt < 0 then x end as x) from {_P})")
register("vol_tilt", lambda spark, d: rounded(macro.vol_tilt(_panel(spark, d))), f"select asset, date, round(b * case when k >= 60 and v > m then -1 else 1 end, 6) as value from (select asset, date, b, v, count(v) {_frame(252)} as k, quantile_cont(v, 0.5) {_frame(252)} as m from (select asset, date, {_beta('ret', 'mkt', 60)} as b, {_mean('mkt', 20, agg='stddev_samp')} as v from {_P}))")


def _series(spark: SparkSession, d: str) -> DataFrame:
    """series, date, x: each region's monthly mean return."""
    return strategies(spark, d).select(F.col("strategy").alias("series"), "date", F.col("r").alias("x"))


_S = f"(select strategy as series, date, r as x from ({STRATEGIES}))"
register("regime_z", lambda spark, d: rounded(macro.regime_z(_series(spark, d), 3, 36, 12)), f"select series, date, round(case when z > 3 then 3 when z < -3 then -3 else z end / 3, 6) as z from (select series, date, (m - {_mean('m', 36, 'series', 12)}) / nullif({_mean('m', 36, 'series', 12, 'stddev_samp')}, 0) as z from (select *, {_mean('x', 3, 'series')} as m from {_S}))")
register("flow_factor", lambda spark, d: rounded(macro.flow_factor(week(spark, d).withColumn("flow", F.col("volume") * F.signum("ret")), "flow")), f"select asset, date, round(({_mean('flow', 5, least=3)} - {_mean('flow', 20, least=10)}) / nullif(abs({_mean('flow', 20, least=10)}), 0), 6) as value from (select *, volume * sign(ret) as flow from ({WEEK}))")
_THEN = "case when ret >= 0.02 then lead(price, 3) over (partition by asset order by date) / nullif(price, 0) - 1 end"
_LIMIT = f"select asset, date, sum((coalesce(ret, 0) >= 0.02)::int) {_frame(20)} as hits, avg(t) {_frame(20)} as t from (select *, {_THEN} as t from ({WEEK}))"
register("limit_up", lambda spark, d: rounded(macro.limit_up(week(spark, d), 0.02)), f"select asset, date, hits::double as hits, round(t, 6) as \"then\" from ({_LIMIT})")
register("limit_up_leak_free", lambda spark, d: rounded(macro.limit_up(week(spark, d), 0.02, True)), f"select asset, date, hits::double as hits, round(lag(t, 3) over (partition by asset order by date), 6) as \"then\" from ({_LIMIT})")
_NET = "case when asset % 3 = 0 and coalesce(volume, 0) > 100 then volume end"
_SUM = lambda c: " + ".join(f"coalesce(lag({c}, {k}) over (partition by asset order by date), 0) * {0.5 ** (k / 5) / sum(0.5 ** (j / 5) for j in range(20))!r}" for k in range(20))
register("institutional_attention", lambda spark, d: rounded(macro.attention_decay(week(spark, d).selectExpr("asset", "date", f"{_NET} as net")), 5), f"select asset, date, round({_SUM('net')}, 5) as net, round({_SUM('seen')}, 5) as seen from (select asset, date, coalesce({_NET}, 0) as net, case when coalesce({_NET}, 0) <> 0 then 1 else 0 end as seen from ({WEEK}))")


def _market(spark: SparkSession, d: str) -> DataFrame:
    return week(spark, d).where("mkt is not null").groupBy("date").agg(F.round(F.first("mkt"), 9).alias("ret")).withColumn("series", F.lit("market"))


_M = f"(select 'market' as series, date, round(any_value(mkt), 9) as ret from ({WEEK}) where mkt is not null group by date)"
register("vol_regime", lambda spark, d: rounded(macro.vol_regime(_market(spark, d))), f"""select series, date, round(s, 6) as share, case when s is null then 'normal_vol' when s < 0.25 then 'low_vol' when s < 0.75 then 'normal_vol' when s < 0.9 then 'high_vol' else 'extreme_vol' end as label
from (select series, date, case when v is not null and len(l) >= 60 then len(list_filter(l, lambda y: y < v)) / len(l) end as s from (select series, date, v, list(v) filter (v is not null) {_frame(253, 'series')} as l from (select *, {_mean('ret', 20, 'series', agg='stddev_samp')} as v from {_M})))""")
_Z = f"select series, date, (c - {_mean('c', 36, 'series', 12)}) / nullif({_mean('c', 36, 'series', 12, 'stddev_samp')}, 0) as z from (select *, x - lag(x, 6) over (partition by series order by date) as c from {_S})"
register("rate_regime", lambda spark, d: macro.change_z(_series(spark, d), 6, 36, 12).select("series", "date", F.round("z", 6).alias("z"), macro.three_way(F.round("z", 6), 0.8, "falling", "stable", "rising").alias("label")), f"select series, date, round(z, 6) as z, case when round(z, 6) > 0.8 then 'rising' when round(z, 6) < -0.8 then 'falling' else 'stable' end as label from ({_Z})")


def _appetite(spark: SparkSession, d: str) -> DataFrame:
    z = macro.change_z(_series(spark, d).where("series < 2"), 6, 36, 12).groupBy("date").agg(F.round(F.avg("z"), 6).alias("z"))
    return z.withColumn("label", macro.three_way(F.col("z"), 0.5, "risk_off", "neutral", "risk_on"))


_APPETITE = f"select date, z, case when z > 0.5 then 'risk_on' when z < -0.5 then 'risk_off' else 'neutral' end as label from (select date, round(avg(z), 6) as z from ({_Z}) where series < 2 group by 1)"
register("risk_appetite_regime", _appetite, _APPETITE)
register("correlation_regime", lambda spark, d: rounded(macro.correlation_regime(_series(spark, d), 12), 5), f"""with p as (select x.date, x.series as a, y.series as b, x.x as x, y.x as y from {_S} x join {_S} y on x.date = y.date and x.series < y.series), c as (select date, case when count(x) {_frame(12, 'a, b', 1)} >= 12 then corr(x, y) {_frame(12, 'a, b', 1)} end as c from p),
m as (select date, avg(c) as m from c group by 1) select date, round(m, 5) as mean, case when m > 0.6 then 'high_corr' when m < 0.3 then 'low_corr' else 'normal_corr' end as label from m""")
_GRID = ((-0.02, 0.0, 0.02), (20.0, 80.0))
register("sigmoid_grid", lambda spark, d: rounded(macro.sigmoid_grid(_series(spark, d).withColumn("r", F.col("x")), *_GRID)), f"""with l as (select *, lag(x) over (partition by series order by date) as b from {_S}), g as (select l.*, center, steep, 0.2 + 0.8 / (1 + exp(steep * (b - center))) as w from l, (select unnest([-0.02, 0.0, 0.02])::double as center), (select unnest([20.0, 80.0])::double as steep) where b is not null),
s as (select *, w * x as p, sum(w * x) over (partition by series, center, steep order by date) as t from g), m as (select *, t - max(t) over (partition by series, center, steep order by date) as down from s)
select series, center, steep, round(coalesce(avg(p) / nullif(stddev_samp(p), 0) * sqrt(12), 0), 6) as sharpe, round(min(down), 6) as max_drawdown, round(avg(w), 6) as mean_weight from m group by 1, 2, 3""")
register("sigmoid_trend", lambda spark, d: rounded(macro.sigmoid_trend(month(spark, d).selectExpr("asset as series", "date", "price as x"), 12)), f"select series, date, round(2 / (1 + exp(-100 * (x - m) / m)) - 1, 6) as trend from (select asset as series, date, price as x, case when count(price) {_frame(12)} >= 12 then avg(price) {_frame(12)} end as m from ({MONTH}))")
_TABLE = [("risk_on", 0, 0.6), ("risk_on", 1, 0.4), ("neutral", 1, 0.5), ("neutral", 2, 0.5), ("risk_off", 3, 0.3), ("risk_off", 4, 0.7)]


def _regime_backtest(spark: SparkSession, d: str) -> DataFrame:
    table = spark.createDataFrame(_TABLE, "label string, bucket long, w double")
    return rounded(macro.hold_weights(_appetite(spark, d).select("date", "label"), table, strategies(spark, d).select("date", F.col("strategy").cast("long").alias("bucket"), "r"), 3))


register("regime_backtest", _regime_backtest, f"""with a as (select date, label, row_number() over (order by date) - 1 as i from ({_APPETITE})), h as (select x.date, y.label from a x join a y on y.i = x.i // 3 * 3), t(label, bucket, w) as (values {', '.join(map(str, _TABLE))})
select h.date, round(sum(w * r), 6) as r from h join t using (label) join ({STRATEGIES}) s on s.date = h.date and s.strategy = bucket group by 1""")
