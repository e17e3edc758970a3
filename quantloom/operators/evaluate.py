"""How good a signal is: information coefficients, decay, quantile returns; and the risk of return series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PAIR_RANK = "rank() over (partition by {by} order by {x}) + (count(*) over (partition by {by}, {x}) - 1) / 2e0 as {name}"


def ic_series(study: DataFrame, fwd: str, least: int = 20) -> DataFrame:
    """Spearman correlation of signal and forward return on each date with enough names, on ranks of the overlap."""
    both = study.where(f"signal is not null and {fwd} is not null").selectExpr("date", *[_PAIR_RANK.format(by="date", x=x, name=n) for x, n in (("signal", "a"), (fwd, "b"))])
    return both.groupBy("date").agg(F.round(F.corr("a", "b"), 6).alias("ic"), F.count("*").alias("n")).where(f"n >= {least}")


def ic_series_sql(study: str, fwd: str, least: int = 20) -> str:
    ranks = ", ".join(_PAIR_RANK.format(by="date", x=x, name=n) for x, n in (("signal", "a"), (fwd, "b")))
    return f"select date, round(corr(a, b), 6) as ic, count(*) as n from (select date, {ranks} from ({study}) where signal is not null and {fwd} is not null) group by date having count(*) >= {least}"


_SUMMARY = ("round(avg(ic), 6) as mean_ic", "round(stddev_samp(ic), 6) as std_ic", "round(coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0), 5) as icir", "round(avg(case when ic > 0 then 1e0 when ic is not null then 0e0 end), 6) as positive", "count(ic) as n_dates")


def ic_summary(ics: DataFrame, *keys: str) -> DataFrame:
    return ics.groupBy(*keys).agg(*[F.expr(x) for x in _SUMMARY])


def ic_summary_sql(ics: str, *keys: str) -> str:
    by = f" group by {', '.join(keys)}" if keys else ""
    return f"select {', '.join([*keys, *_SUMMARY])} from ({ics}){by}"


def ic_decay(study: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """The summary for each lag, also of lags without dates: one exchange by (lag, date) serves them all."""
    tall = study.select("date", "signal", F.explode(F.create_map(*[x for k in lags for x in (F.lit(k), F.col(f"fwd_{k}"))])).alias("lag", "fwd")).where("signal is not null and fwd is not null")
    ranks = tall.selectExpr("lag", "date", *[_PAIR_RANK.format(by="lag, date", x=x, name=n) for x, n in (("signal", "a"), ("fwd", "b"))])
    ics = ranks.groupBy("lag", "date").agg(F.round(F.corr("a", "b"), 6).alias("ic"), F.count("*").alias("n")).where("n >= 20")
    wanted = study.sparkSession.createDataFrame([(k,) for k in lags], "lag int")
    return ic_summary(wanted.join(ics, "lag", "left"), "lag")


def ic_decay_sql(study: str, lags: tuple[int, ...]) -> str:
    return " union all ".join(f"select {k} as lag, * from ({ic_summary_sql(ic_series_sql(study, f'fwd_{k}'))})" for k in lags)


_TOP = "row_number() over (partition by date order by signal {way} nulls last, asset) as place"


def top_k(study: DataFrame, k: int) -> DataFrame:
    """The k names with the largest signals of each date; ties go to the smaller asset."""
    return study.where("signal is not null").selectExpr("date", "asset", "signal", _TOP.format(way="desc")).where(f"place <= {k}")


def top_k_sql(study: str, k: int) -> str:
    return f"select * from (select date, asset, signal, {_TOP.format(way='desc')} from ({study}) where signal is not null) where place <= {k}"


def quantile_returns(study: DataFrame, fwd: str, k: int) -> DataFrame:
    """Mean forward return by quantile bucket of the signal: right-closed bins between linear quantiles; dates with fewer than 5k names are left out."""
    both = study.where(f"signal is not null and {fwd} is not null").select("date", "signal", F.col(fwd).alias("fwd"))
    steps = ", ".join(f"{i / k}D" for i in range(1, k))
    edges = both.groupBy("date").agg(F.expr(f"transform(percentile(signal, array({steps})), x -> round(x, 9))").alias("edges"), F.count("*").alias("n")).where(f"n >= {5 * k}")
    placed = both.join(edges, "date").withColumn("bucket", F.expr("size(filter(array_distinct(edges), e -> e < signal)) + 1"))
    return placed.groupBy("date", "bucket").agg(F.round(F.avg("fwd"), 6).alias("mean_ret"), F.count("*").alias("names"))


def quantile_returns_sql(study: str, fwd: str, k: int) -> str:
    steps = ", ".join(str(i / k) for i in range(1, k))
    return f"""with b as (select date, signal, {fwd} as fwd from ({study}) where signal is not null and {fwd} is not null),
    e as (select date, list_transform(quantile_cont(signal, [{steps}]), lambda x: round(x, 9)) as edges from b group by date having count(*) >= {5 * k})
    select date, bucket, round(avg(fwd), 6) as mean_ret, count(*) as names from (select date, fwd, len(list_filter(list_distinct(edges), lambda x: x < signal)) + 1 as bucket from b join e using (date)) group by date, bucket"""


def _market(panel: DataFrame) -> DataFrame:
    """The date-level market series: a few hundred rows."""
    return panel.where("mkt is not null").groupBy("date").agg(F.round(F.first("mkt"), 9).alias("r"))


_MARKET = "select date, round(any_value(mkt), 9) as r from ({}) where mkt is not null group by date"


def drawdown(panel: DataFrame) -> DataFrame:
    """Equity and drawdown of the market; windows without partition run on the date-level series only."""
    eq = _market(panel).selectExpr("date", "exp(sum(ln(1 + r)) over (order by date)) as equity")
    return eq.selectExpr("date", "round(equity, 6) as equity", "round(equity / greatest(max(equity) over (order by date), 1e0) - 1, 6) as drawdown")


def drawdown_sql(panel: str) -> str:
    return f"select date, round(equity, 6) as equity, round(equity / greatest(max(equity) over (order by date), 1e0) - 1, 6) as drawdown from (select date, exp(sum(ln(1 + r)) over (order by date)) as equity from ({_MARKET.format(panel)}))"


def tail_risk(panel: DataFrame) -> DataFrame:
    """Value at risk and expected shortfall of the market at 95 and 99 %."""
    m = _market(panel)
    q = m.agg(*[F.expr(f"percentile(r, {p}D)").alias(f"var_{n}") for p, n in ((0.05, 95), (0.01, 99))])
    return m.join(F.broadcast(q)).groupBy("var_95", "var_99").agg(*[F.round(F.avg(F.when(F.col("r") <= F.col(f"var_{n}"), F.col("r"))), 6).alias(f"cvar_{n}") for n in (95, 99)]).selectExpr("round(var_95, 6) as var_95", "round(var_99, 6) as var_99", "cvar_95", "cvar_99")


def tail_risk_sql(panel: str) -> str:
    return f"with m as ({_MARKET.format(panel)}), q as (select quantile_cont(r, 0.05) as var_95, quantile_cont(r, 0.01) as var_99 from m) select round(var_95, 6) as var_95, round(var_99, 6) as var_99, round(avg(case when r <= var_95 then r end), 6) as cvar_95, round(avg(case when r <= var_99 then r end), 6) as cvar_99 from m, q group by var_95, var_99"
