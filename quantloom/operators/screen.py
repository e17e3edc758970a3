"""Which names count, and how signals are cleaned, blended and freed of others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import cs_place, cs_rank


def universe(panel: DataFrame, least_price: float, least_share: float) -> DataFrame:
    """Rows of assets whose mean close and share of dates with a close are above the floors."""
    keep = panel.groupBy("asset").agg(F.avg("close").alias("mean"), (F.count("close") / F.count("*")).alias("share")).where(F.col("mean").isNotNull() & (F.round("mean", 6) > least_price) & (F.col("share") > least_share))
    return panel.join(keep.select("asset"), "asset", "left_semi")


def universe_sql(panel: str, least_price: float, least_share: float) -> str:
    return f"with p as ({panel}) select * from p where asset in (select asset from p group by asset having round(avg(close), 6) > {least_price} and count(close) / count(*) > {least_share})"


def winsorize(panel: DataFrame, x: str, low: float, high: float, least: int = 20) -> DataFrame:
    """date, asset and x clipped at the date's quantiles; dates with `least` values or fewer stay as they are."""
    edges = panel.groupBy("date").agg(F.expr(f"percentile({x}, array({low}D, {high}D))").alias("edges"), F.count(x).alias("n")).where(f"n > {least}")
    return panel.join(edges, "date", "left").selectExpr("date", "asset", f"round(case when {x} is null then null when edges is null then {x} else greatest(least({x}, edges[1]), edges[0]) end, 9) as {x}")


def winsorize_sql(panel: str, x: str, low: float, high: float, least: int = 20) -> str:
    return f"""with p as ({panel}), e as (select date, quantile_cont({x}, {low}) as lo, quantile_cont({x}, {high}) as hi from p group by date having count({x}) > {least})
    select date, asset, round(case when {x} is null then null when lo is null then {x} else greatest(least({x}, hi), lo) end, 9) as {x} from p left join e using (date)"""


#: Names whose last return is in the date's lowest tenth lose their signal, as do those below the date's volume quantile.
_MASKED = "case when round(volume, 6) >= round({big}, 6) and not coalesce(round(last_ret, 9) < round({fall}, 9), false) then signal end"


def masked(signals: DataFrame, panel: DataFrame, q: float, fall: float = 0.1) -> DataFrame:
    """Signals inside the universe of large names that did not just fall; null outside."""
    past = panel.selectExpr("asset", "date", "volume", "lag(ret) over (partition by asset order by date) as last_ret")
    edges = past.groupBy("date").agg(F.expr(f"percentile(volume, {q}D)").alias("big"), F.expr(f"percentile(last_ret, {fall}D)").alias("fall"))
    return signals.join(past, ["asset", "date"]).join(edges, "date").selectExpr("asset", "date", f"{_MASKED.format(big='big', fall='fall')} as signal")


def masked_sql(signals: str, panel: str, q: float, fall: float = 0.1) -> str:
    return f"""with p as (select asset, date, volume, lag(ret) over (partition by asset order by date) as last_ret from ({panel})),
    e as (select date, quantile_cont(volume, {q}) as big, quantile_cont(last_ret, {fall}) as fall from p group by date)
    select asset, date, {_MASKED.format(big='big', fall='fall')} as signal from ({signals}) join p using (asset, date) join e using (date)"""


def blend(tall: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of the factors that a name has, ranked again; tall has date, asset, factor and signal."""
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])[F.col("factor")]
    mean = tall.where("signal is not null").withColumn("w", w).where("w is not null").groupBy("date", "asset").agg(F.round(F.sum(F.col("w") * F.col("signal")) / F.sum("w"), 6).alias("x"))
    return mean.selectExpr("date", "asset", "x as value", f"round({cs_place('x')}, 9) as signal")


def blend_sql(tall: str, weights: dict[str, float]) -> str:
    w = " ".join(f"when '{k}' then {v}e0" for k, v in weights.items())
    return f"""select date, asset, x as value, round({cs_rank('x')}, 9) as signal from (select date, asset, round(sum(w * signal) / sum(w), 6) as x from (
      select *, case factor {w} end as w from ({tall}) where signal is not null) where w is not null group by date, asset)"""


def residual(pairs: DataFrame, least: int = 20) -> DataFrame:
    """y without what a line in x explains on the date, from the date's sums; dates with fewer pairs pass y through."""
    line = pairs.where("x is not null and y is not null").groupBy("date").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.count("*").alias("n")).where(f"n >= {least}")
    return pairs.join(line, "date", "left").selectExpr("date", "asset", "round(case when b is null then y when x is not null then y - a - b * x end, 6) as residual")


def residual_sql(pairs: str, least: int = 20) -> str:
    return f"""with p as ({pairs}), l as (select date, regr_slope(y, x) as b, regr_intercept(y, x) as a from p where x is not null and y is not null group by date having count(*) >= {least})
    select date, asset, round(case when b is null then y when x is not null then y - a - b * x end, 6) as residual from p left join l using (date)"""


_MOVERS = ("row_number() over (partition by date order by round(ret, 9) desc, asset) as up", "row_number() over (partition by date order by round(ret, 9), asset) as down")


def movers(panel: DataFrame, n: int) -> DataFrame:
    """The n largest gains and losses of each date."""
    return panel.where("ret is not null").selectExpr("date", "asset", "round(ret, 9) as ret", *_MOVERS).where(f"up <= {n} or down <= {n}")


def movers_sql(panel: str, n: int) -> str:
    return f"select * from (select date, asset, round(ret, 9) as ret, {', '.join(_MOVERS)} from ({panel}) where ret is not null) where up <= {n} or down <= {n}"


_SEEN = "over (partition by asset order by date rows between 60 preceding and 1 preceding)"
_Z = f"round(case when count(x) {_SEEN} >= 10 then (x - avg(x) {_SEEN}) / nullif(round(stddev_pop(x) {_SEEN}, 9), 0) end, 5)"
_ALERT = f"case when abs({_Z}) >= 3.5 then 'critical' when abs({_Z}) >= 2.5 then 'warning' end"


def anomalies(metrics: DataFrame) -> DataFrame:
    """Metrics (asset, date, x) far from the mean of the 60 rows before, of which 10 or more have a value."""
    return metrics.selectExpr("asset", "date", "x", f"{_Z} as z", f"{_ALERT} as level").where("level is not null")


def anomalies_sql(metrics: str) -> str:
    return f"select * from (select asset, date, x, {_Z} as z, {_ALERT} as level from ({metrics})) where level is not null"
