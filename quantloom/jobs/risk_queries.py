"""Risk queries: strategies are regions' mean returns, positions are suppliers' balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normal import normal_cdf_sql
from ..operators import anomaly, risk
from .catalog import MARKET, MONTH, REGIONS, STRATEGIES, market, month, read, register, regions, strategies

RF, PLACES = 0.002, 6


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def shown(names: str) -> str:
    """Columns rounded as rounded() does."""
    return ", ".join(f"round({n}, {PLACES}) as {n}" for n in names.split())


_PV = "select *, pv / greatest(max(pv) over (partition by strategy order by date), 1) - 1 as dd from (select *, product(1 + r) over (partition by strategy order by date) as pv from s)"
_METRICS = f"""with s as ({STRATEGIES}), b as ({MARKET}), e as ({_PV}), v as (select strategy, quantile_cont(r, 0.05) as var_95 from s group by 1), c as (select strategy, avg(r) as cvar_95 from s join v using (strategy) where r <= var_95 group by 1),
a as (select strategy, count(r) as months, product(1 + r) - 1 as total, greatest((max(date) - min(date)) / 365.25, 0.01) as years, coalesce(avg(r - {RF}) / nullif(stddev_samp(r - {RF}), 0) * sqrt(12), 0) as sharpe,
  coalesce(avg(r - {RF}) / nullif(stddev_samp(r) filter (r < 0), 0) * sqrt(12), 0) as sortino, min(dd) as max_drawdown, (count(*) filter (r > 0)) / count(r) as win_rate, stddev_samp(r) * sqrt(12) as volatility, avg(r) filter (r > 0) as avg_win, avg(r) filter (r < 0) as avg_loss,
  sum(r) filter (r > 0) / nullif(-sum(r) filter (r < 0), 0) as profit_factor, skewness(r) as skew, kurtosis(r) as kurtosis, coalesce(regr_slope(r, m), 1) as beta, avg(m) as mm, product(1 + m) - 1 as mt, coalesce(avg(r - m) / nullif(stddev_samp(r - m), 0) * sqrt(12), 0) as information_ratio
  from e left join b using (date) group by strategy),
f as (select *, (1 + total) ** (1 / years) - 1 as cagr, (1 + mt) ** (1 / years) - 1 as benchmark_cagr from a)
select strategy, months, {shown("total sharpe sortino max_drawdown win_rate volatility avg_win avg_loss profit_factor skew kurtosis beta information_ratio cagr benchmark_cagr var_95 cvar_95")}, round(cagr - beta * ((1 + mm) ** 12 - 1), 6) as alpha, round(cagr - benchmark_cagr, 6) as excess_return,
  round(coalesce(cagr / nullif(abs(max_drawdown), 0), 0), 6) as calmar, round(avg_win / nullif(abs(avg_loss), 0), 6) as payoff from f join v using (strategy) join c using (strategy)"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.metrics(strategies(spark, d), market(spark, d), RF))


register("strategy_metrics", _metrics, _METRICS)
register("strategy_tail_stats", lambda spark, d: rounded(risk.tail_stats(strategies(spark, d))), f"""with s as ({STRATEGIES}),
q as (select strategy, quantile_cont(r, 0.05) as var_95, quantile_cont(r, 0.01) as var_99 from s group by 1),
c as (select strategy, var_95, var_99, avg(r) filter (r <= var_95) as cvar_95, avg(r) filter (r <= var_99) as cvar_99 from s join q using (strategy) group by all),
runs as (select strategy, max(n) as longest_losses from (select strategy, g, count(*) filter (r < 0) as n from (select *, sum(case when r < 0 then 0 else 1 end) over (partition by strategy order by date) as g from s) group by 1, 2) group by 1)
select strategy, longest_losses::bigint as longest_losses, {shown("skew kurtosis worst best loss_share win_loss var_95 cvar_95 var_99 cvar_99")} from (select strategy, skewness(r) as skew, kurtosis(r) as kurtosis, min(r) as worst, max(r) as best, avg((r < 0)::int) as loss_share, avg(r) filter (r > 0) / abs(avg(r) filter (r < 0)) as win_loss from s group by 1) join c using (strategy) join runs using (strategy)""")
register("deflated_sharpe", lambda spark, d: rounded(risk.deflated_sharpe(strategies(spark, d), 20), 5), f"""with s as ({STRATEGIES}), a as (select strategy, count(r) as n, avg(r) / (stddev_samp(r) + 1e-10) as s, skewness(r) as g, kurtosis(r) as k from s group by 1),
b as (select *, (sqrt(2 * ln(20)) - (ln(pi()) + 0.5772) / (2 * sqrt(2 * ln(20)))) / sqrt(n) as best, sqrt((1 + 0.5 * s ** 2 - g * s + (k + 3) / 4 * s ** 2) / (n - 1)) as spread from a),
z as (select strategy, n, case when n < 12 then 0 else (s - best) / (spread + 1e-10) end as z from b)
select strategy, n, round(z, 5) as z, round({normal_cdf_sql('z')}, 5) as dsr, round(1 - {normal_cdf_sql('z')}, 5) as p from z""")
_VALUES = " union all ".join(f"select strategy, '{n}' as name, {n}::double as value, '{op}' as op, {t}::double as threshold, '{c}' as category from m" for n, op, t, c in risk.GATES)
_CHECKS = f"with m as ({_METRICS}), g as ({_VALUES}) select *, value > threshold as passed from g"
register("gate_check", lambda spark, d: risk.gate_check(_metrics(spark, d)), _CHECKS)
register("gate_summary", lambda spark, d: risk.gate_summary(risk.gate_check(_metrics(spark, d))), f"with x as ({_CHECKS}) select strategy, category, count(*) as gates, count(*) filter (passed) as passed from x group by 1, 2 union all select strategy, null, count(*), count(*) filter (passed) from x group by 1")
register("monthly_returns_table", lambda spark, d: rounded(risk.monthly_table(strategies(spark, d))), f"select strategy, year(date)::int as year, {', '.join(f'round(max(r) filter (month(date) = {k}), 6) as m{k:02d}' for k in range(1, 13))}, round(product(1 + r) - 1, 6) as total from ({STRATEGIES}) group by 1, 2")
register("return_histogram", lambda spark, d: rounded(risk.histogram(strategies(spark, d), 30)), f"""with s as ({STRATEGIES}), e as (select strategy, min(r) as lo, (max(r) - min(r)) / 30 as w from s group by 1),
p as (select strategy, lo, w, least(29, floor((r - lo) / w)::int) as bin from s join e using (strategy)) select strategy, bin::int as bin, round(any_value(lo + bin * w), 6) as edge, count(*) as n from p group by strategy, bin""")
CRISES = [("start", "1995-06-01", "1995-12-01"), ("middle", "1997-10-01", "1999-03-01"), ("late", "2000-01-01", "2000-10-01"), ("overlap", "1998-08-01", "1998-12-01"), ("before", "1980-01-01", "1980-12-01")]
register("crisis_replay", lambda spark, d: rounded(risk.crisis_replay(strategies(spark, d), market(spark, d), CRISES)), f"""with s as ({STRATEGIES}), b as ({MARKET}), c(crisis, a, z) as (values {', '.join(f"('{n}', date '{a}', date '{z}')" for n, a, z in CRISES)}),
i as (select crisis, strategy, date, r, m from s left join b using (date) join c on date_trunc('month', date) between a and z), e as (select *, product(1 + r) over (partition by crisis, strategy order by date) as pv from i), f as (select *, pv / max(pv) over (partition by crisis, strategy order by date) - 1 as dd from e)
select crisis, strategy, round(product(1 + r) - 1, 6) as total, round(product(1 + m) - 1, 6) as benchmark, round(min(dd), 6) as max_drawdown, count(*) as months, round(product(1 + r) - product(1 + m), 6) as excess from f group by 1, 2""")
register("synthetic_shocks", lambda spark, d: rounded(risk.synthetic_shocks(strategies(spark, d))), f"""with s as (select *, row_number() over (partition by strategy order by date) - 1 as k, count(*) over (partition by strategy) // 2 as mid, avg(r) over (partition by strategy) as mu from ({STRATEGIES})),
t as (select strategy, date, 'baseline' as scenario, r from s union all select strategy, date, n, case when k = mid then x else r end from s, (values ('shock -10%', -0.1), ('shock -20%', -0.2), ('shock -30%', -0.3), ('shock -50%', -0.5)) v(n, x) union all select strategy, date, 'spread x2', mu + 2 * (r - mu) from s),
e as (select *, product(1 + r) over (partition by strategy, scenario order by date) as pv from t), f as (select *, pv / max(pv) over (partition by strategy, scenario order by date) - 1 as dd from e)
select strategy, scenario, round(coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(12), 0), 6) as sharpe, round(min(dd), 6) as max_drawdown from f group by 1, 2""")
SCENARIOS = [("flash crash", -0.09, 1), ("credit crisis", -0.5, 350), ("pandemic", -0.34, 23), ("rate shock", -0.25, 190)]
register("scenario_losses", lambda spark, d: rounded(risk.scenario_losses(strategies(spark, d), SCENARIOS)), f"""with s as (select strategy, least(stddev_samp(r) / 0.01, 2) as k from ({STRATEGIES}) group by 1), v(scenario, shock, days) as (values {', '.join(map(str, SCENARIOS))})
select strategy, scenario, round(shock * k, 6) as loss, round(case when days > 1 then shock * k / days * 3 else shock * k end, 6) as worst_day from s, v""")
register("yearly_attribution", lambda spark, d: rounded(risk.yearly_attribution(strategies(spark, d), market(spark, d))), f"select strategy, year(date)::int as year, round(product(1 + r) - 1, 6) as total, round(product(1 + m) - 1, 6) as benchmark, round(product(1 + r - m) - 1, 6) as excess from ({STRATEGIES}) join ({MARKET}) using (date) group by 1, 2")
register("strategy_correlation", lambda spark, d: rounded(risk.strategy_correlation(strategies(spark, d))), f"with s as ({STRATEGIES}) select x.strategy as a, y.strategy as b, round(corr(x.r, y.r), 6) as correlation, count(*) as months from s x join s y on x.date = y.date and x.strategy < y.strategy group by 1, 2")


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return strategies(spark, d).select("strategy").distinct().select("strategy", ((F.col("strategy") + 1) / 15.0).alias("w"))


register("marginal_risk", lambda spark, d: rounded(risk.marginal_risk(strategies(spark, d), _weights(spark, d))), f"""with s as (select *, (strategy + 1) / 15.0 as w from ({STRATEGIES})), d as (select date from s group by 1 having count(*) = (select count(distinct strategy) from s)),
t as (select s.* from s join d using (date)), k as (select x.strategy, y.strategy as o, x.w, y.w as v, covar_samp(x.r, y.r) as c from t x join t y using (date) group by 1, 2, 3, 4), m as (select strategy, w, sum(v * c) as mc from k group by 1, 2), p as (select sum(w * mc) as var from m)
select strategy, round(w * mc / sqrt(var), 6) as contribution, round(w * mc / var, 6) as share, round(vol, 6) as volatility, round(mc / var, 6) as beta from m, p, lateral (select stddev_samp(r) * sqrt(12) as vol from t where t.strategy = m.strategy)""")
register("risk_budget", lambda spark, d: rounded(risk.risk_budget(strategies(spark, d), 0.1)), f"""with s as ({STRATEGIES}), v as (select strategy, 1 / (stddev_samp(r) * sqrt(12)) as i from s group by 1), w as (select strategy, i / sum(i) over () as w from v),
p as (select date, sum(w * r) as p from s join w using (strategy) group by 1), k as (select least(0.1 / (stddev_samp(p) * sqrt(12)), 2) as k from p) select strategy, round(w * k, 6) as weight from w, k""")
register("kelly_fraction", lambda spark, d: rounded(risk.kelly(strategies(spark, d))), f"""with a as (select strategy, avg((r > 0)::int) as p, avg(r) filter (r > 0) / -avg(r) filter (r < 0) as b from ({STRATEGIES}) group by 1) select strategy, round(coalesce(greatest(least((p - (1 - p) / b) / 2, 0.25), 0), 0), 6) as fraction from a""")
register("vol_target_scale", lambda spark, d: rounded(risk.vol_target_scale(strategies(spark, d), 6, 0.1, 0.3, 1.5)), f"select strategy, date, round(case when count(r) over w < 6 or stddev_samp(r) over w * sqrt(12) < 1e-8 then 1 else greatest(least(0.1 / (stddev_samp(r) over w * sqrt(12)), 1.5), 0.3) end, 6) as scale from ({STRATEGIES}) window w as (partition by strategy order by date rows between 6 preceding and 1 preceding)")
_STEPS = ((0.25, 0.25), (0.2, 0.5), (0.1, 0.75))
register("drawdown_scale", lambda spark, d: risk.drawdown_scale(strategies(spark, d), _STEPS), f"with s as ({STRATEGIES}), e as ({_PV}) select strategy, date, case when p < -0.25 then 0.25 when p < -0.2 then 0.5 when p < -0.1 then 0.75 else 1 end::double as scale from (select *, lag(dd) over (partition by strategy order by date) as p from e)")
register("drawdown_check", lambda spark, d: rounded(risk.drawdown_check(strategies(spark, d))), f"with s as ({STRATEGIES}), e as ({_PV}), l as (select strategy, arg_max(dd, date) as x from e group by 1) select strategy, round(x, 6) as drawdown, (case when x < -0.15 then 0.2 when x < -0.08 then 0.5 else 1 end)::double as scale, case when x < -0.15 then 'critical' when x < -0.08 then 'warning' end as level from l")


def _positions(spark: SparkSession, d: str) -> DataFrame:
    """A row for each supplier: an account is a nation, a sector a remainder of the key."""
    r = regions(spark, d).select(F.col("nation").alias("account"), "asset", F.concat(F.lit("sector "), F.col("asset") % 4).alias("sector"), F.element_at(F.array(F.lit("stock"), F.lit("option_long"), F.lit("option_short")), (F.col("asset") % 3 + 1).cast("int")).alias("kind"), F.col("s_acctbal").alias("market_value"))
    total = r.groupBy("account").agg((2 * F.sum(F.abs("market_value"))).alias("equity"))
    return r.join(total, "account")


_POSITIONS = f"select nation as account, asset, 'sector ' || asset % 4 as sector, ['stock', 'option_long', 'option_short'][asset % 3 + 1] as kind, s_acctbal as market_value, 2 * sum(abs(s_acctbal)) over (partition by nation) as equity from ({REGIONS})"
register("position_alerts", lambda spark, d: rounded(risk.position_alerts(_positions(spark, d))), f"select account, asset, round(w, 6) as weight, case when w > 0.2 then 'red' when w > 0.1 then 'orange' else 'yellow' end as level from (select *, abs(market_value) / equity as w from ({_POSITIONS}) where equity > 0) where w > 0.08")
register("sector_alerts", lambda spark, d: rounded(risk.sector_alerts(_positions(spark, d))), f"select account, sector, round(w, 6) as weight, case when w > 0.3 then 'orange' else 'yellow' end as level from (select account, sector, sum(abs(market_value)) / any_value(equity / 2) as w from ({_POSITIONS}) group by 1, 2) where w > 0.25")
_ALL = "select 0 as account, asset, market_value from ({})"
register("correlation_alerts", lambda spark, d: rounded(risk.correlation_alerts(_positions(spark, d).withColumn("account", F.lit(0)), month(spark, d), 10, 0.1)), f"""with p as (select asset from ({_POSITIONS}) order by abs(market_value) desc, asset limit 10), r as (select asset, date, ret from ({MONTH}) join p using (asset) where ret is not null), d as (select date from r group by 1 having count(*) = (select count(*) from p)),
c as (select x.asset as a, y.asset as b, corr(x.ret, y.ret) as c from r x join r y on x.date = y.date and x.asset < y.asset where x.date in (select date from d) group by 1, 2)
select 0 as account, a, b, round(c, 6) as correlation, case when abs(c) > 0.9 then 'red' when abs(c) > 0.8 then 'orange' else 'yellow' end as level from c where abs(c) > 0.1""")
register("position_var", lambda spark, d: rounded(risk.position_var(_positions(spark, d), month(spark, d))), f"select account, asset, round(case when n >= 20 then market_value * q else 0 end, 6) as value_at_risk from ({_POSITIONS}) left join (select asset, quantile_cont(ret, 0.05) as q, count(ret) as n from ({MONTH}) group by 1) using (asset)")


def _options(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").selectExpr("p_size % 7 as account", "p_partkey as asset", "(p_partkey % 21 - 10) / 10.0D as delta", "(p_partkey % 13) / 100.0D as gamma", "-(p_partkey % 17) / 10.0D as theta", "(p_partkey % 11) / 5.0D as vega", "p_partkey % 5 - 2 as quantity", "p_retailprice as underlying_price")


_OPTIONS = "select p_size % 7 as account, p_partkey as asset, (p_partkey % 21 - 10) / 10 as delta, (p_partkey % 13) / 100 as gamma, -(p_partkey % 17) / 10 as theta, (p_partkey % 11) / 5 as vega, p_partkey % 5 - 2 as quantity, p_retailprice as underlying_price from part"
LIMITS = {"delta": (-20.0, 20.0), "gamma": (-1.0, 1.0), "theta": (-50.0, 50.0), "vega": (-3.0, 3.0)}
register("greeks_check", lambda spark, d: rounded(risk.greeks_check(_options(spark, d), LIMITS)), f"""with o as ({_OPTIONS}), t as ({' union all '.join(f"select account, '{g}' as greek, sum({g} * quantity) as value, {a} as lo, {b} as hi from o group by 1" for g, (a, b) in LIMITS.items())})
select account, greek, round(value, 6) as value, case when value < 2 * lo or value > 2 * hi then 'red' when value < lo or value > hi then 'orange' end as level from t""")
register("greek_shock", lambda spark, d: rounded(risk.greek_shock(_options(spark, d))), f"""with p as (select account, asset, delta * quantity * -0.1 * underlying_price as delta_pnl, 0.5 * gamma * quantity * (0.1 * underlying_price) ** 2 as gamma_pnl, vega * quantity * 5 as vega_pnl from ({_OPTIONS}))
select account, asset, round(sum(delta_pnl), 6) as delta_pnl, round(sum(gamma_pnl), 6) as gamma_pnl, round(sum(vega_pnl), 6) as vega_pnl, round(sum(delta_pnl) + sum(gamma_pnl) + sum(vega_pnl), 6) as total_pnl from p group by grouping sets ((account, asset), (account))""")
register("margin_check", lambda spark, d: rounded(risk.margin_check(_positions(spark, d))), f"""with p as (select account, sum(abs(market_value) * case kind when 'option_long' then 1 when 'option_short' then 1.2 else 0.5 end) as margin, any_value(equity) as equity from ({_POSITIONS}) group by 1)
select account, round(margin, 6) as margin, round(margin / equity, 6) as ratio, case when margin / equity > 0.9 then 'call' when margin / equity > 0.7 then 'high' else 'normal' end as state from p""")


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    p = _positions(spark, d)
    one = risk.position_alerts(p).select("account", F.lit("position").alias("source"), F.col("asset").cast("string").alias("target"), "level")
    two = risk.sector_alerts(p).select("account", F.lit("sector").alias("source"), F.col("sector").alias("target"), "level")
    return risk.evaluate(one.where("level <> 'yellow'"), two.where("level = 'orange' and account % 2 = 0"), accounts=p)


register("evaluate_risk", _evaluated, f"""with p as ({_POSITIONS}), a as (select account, 'position' as source, asset::varchar as target, case when abs(market_value) / equity > 0.2 then 'red' else 'orange' end as level from p where abs(market_value) / equity > 0.1
 union all select account, 'sector', sector, 'orange' from p group by account, sector having sum(abs(market_value)) / any_value(equity / 2) > 0.3 and account % 2 = 0),
b as (select * from a union all select distinct account, null, null, 'green' from p where account not in (select account from a)) select *, case level when 'red' then 'reduce' when 'orange' then 'reduce' else 'none' end as action, case level when 'red' then 0.2 when 'orange' then 0.5 else 1 end::double as scale from b""")


def _metric_values(spark: SparkSession, d: str) -> DataFrame:
    e = risk.equity(strategies(spark, d))
    return e.select("strategy", "date", F.round("r", 9).alias("ret"), F.round("drawdown", 9).alias("drawdown")).unpivot(["strategy", "date"], ["ret", "drawdown"], "metric", "x")


_METRIC_VALUES = f"select strategy, date, unnest(['ret', 'drawdown']) as metric, unnest([r, round(dd, 9)]) as x from (with s as ({STRATEGIES}) {_PV})"
register("metric_summary", lambda spark, d: rounded(risk.metric_summary(_metric_values(spark, d))), f"""with v as ({_METRIC_VALUES}), a as (select strategy, metric, arg_max(x, date) as current, avg(x) as mean, stddev_pop(x) as spread, min(x) as low, max(x) as high, count(x) as n from v group by 1, 2)
select strategy, metric, n, {shown("current mean spread low high")}, round(case when spread >= 1e-10 then (current - mean) / spread else 0 end, 6) as z from a""")


WINDOW = 24


def _health(spark: SparkSession, d: str) -> DataFrame:
    """The last date's largest distance, drawdown and shift; no forest has been grown."""
    shifts = anomaly.cusum(_metric_values(spark, d), WINDOW)
    last = shifts.groupBy("strategy").agg(F.max("date").alias("date"))
    now = shifts.join(F.broadcast(last), ["strategy", "date"]).groupBy("strategy").agg(
        F.coalesce(F.max(F.abs("z")), F.lit(0.0)).alias("z"), F.max(F.when(F.col("metric") == "drawdown", F.col("x"))).alias("drawdown"), F.coalesce(F.max(F.greatest("up", "down") / F.col("limit")), F.lit(0.0)).alias("ratio")
    )
    return now.select("strategy", risk.health_score(F.round("z", 6), F.round("drawdown", 6), F.lit(None).cast("double"), F.round("ratio", 6)).alias("health"))


def _health_forest(spark: SparkSession, d: str) -> DataFrame:
    """health_score with the isolation of the last date's return and drawdown among all strategies' dates."""
    values = _metric_values(spark, d)
    wide = values.groupBy("strategy", "date").pivot("metric", ["ret", "drawdown"]).agg(F.first("x"))
    scored = anomaly.isolation_forest(wide, ["ret", "drawdown"]).withColumn("k", F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("date")))).where("k = 1")
    shifts = anomaly.cusum(values, WINDOW).join(scored.select("strategy", "date"), ["strategy", "date"]).groupBy("strategy").agg(F.max(F.abs("z")).alias("z"), F.max(F.greatest("up", "down") / F.col("limit")).alias("ratio"))
    return scored.join(shifts, "strategy").select("strategy", F.round("isolation", 6).alias("isolation"), risk.health_score(F.round("z", 6), F.round("drawdown", 6), F.col("isolation"), F.round("ratio", 6)).alias("health"))


_SHIFTS = anomaly.cusum_sql(_METRIC_VALUES, WINDOW)
register("cusum_shifts", lambda spark, d: rounded(anomaly.cusum(_metric_values(spark, d), WINDOW)), f"select strategy, metric, date, {shown('x z')}, round(\"limit\", 6) as \"limit\", {shown('up down')}, alarm from ({_SHIFTS})")
register("cusum_alerts", lambda spark, d: rounded(anomaly.alerts(anomaly.cusum(_metric_values(spark, d), WINDOW))), f"""select strategy, metric, date, split_part(alarm, ' ', 1) as severity, split_part(alarm, ' ', 2) as direction, round(greatest(up, down), 6) as amount, round("limit", 6) as "limit" from ({_SHIFTS}) where alarm is not null""")
register("isolation_scores", lambda spark, d: rounded(anomaly.isolation_forest(month(spark, d).selectExpr("asset", "date", "round(ret, 9) as ret", "round(volume, 9) as volume", "round(high / low - 1, 9) as span"), ["ret", "volume", "span"])), None)
register("health_score_isolation", _health_forest, None)
register("health_score", _health, f"""with s as ({_SHIFTS}), l as (select strategy, max(date) as date from s group by 1),
w as (select strategy, round(coalesce(max(abs(z)), 0), 6) as z, round(abs(max(x) filter (metric = 'drawdown')), 6) as dd, round(coalesce(max(greatest(up, down) / "limit"), 0), 6) as c from s join l using (strategy, date) group by 1)
select strategy, round(0.3 * (100 - case when z <= 1 then 0 when z <= 2.5 then (z - 1) * 20 when z <= 3.5 then 30 + (z - 2.5) * 30 else least(100, 60 + (z - 3.5) * 20) end)
 + 0.3 * case when dd <= 0.02 then 100 when dd <= 0.08 then 100 - (dd - 0.02) / 0.06 * 40 when dd <= 0.15 then 60 - (dd - 0.08) / 0.07 * 40 else greatest(0, 20 - (dd - 0.15) * 200) end + 0.2 * 100
 + 0.2 * case when c <= 0.5 then 100 - c * 40 when c <= 1 then 80 - (c - 0.5) * 80 else greatest(0, 40 - (c - 1) * 80) end, 1) as health from w""")
