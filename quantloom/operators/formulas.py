"""Factors that need ranks, positions or shapes of a frame, and the published formulas that are made of them.

Each takes a dense panel and gives columns asset, date and value; signals are ranks of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import by_asset, correlation, decay_linear, framed, ranks, signed_power, ts_argmax, ts_rank, whole
from ..functions.frames import cs_rank


def cross():
    return Window.partitionBy("date")


def cross_rank(x: str) -> Column:
    """Average-rank share of a date's values, in (0, 1]."""
    place = F.rank().over(cross().orderBy(F.col(x).asc_nulls_last())) + (F.count(x).over(Window.partitionBy("date", x)) - 1) / 2
    return F.when(F.col(x).isNotNull(), F.try_divide(place, F.count(x).over(cross())))


def over(n: int, lag: int = 0):
    return by_asset().rowsBetween(1 - n - lag, -lag)


def rolled(f, x: Column | str, n: int) -> Column:
    """f over n rows that all have x."""
    return F.when(F.count(x).over(over(n)) >= n, f(x).over(over(n)))


def back(x: str, n: int = 1) -> Column:
    return F.lag(x, n).over(by_asset())


def pair_corr(x: str, y: str, n: int, least: int | None = None) -> Column:
    """Correlation of the frame's rows that have both; null where a side does not vary."""
    a, b, w = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y)), over(n)
    va, vb = F.var_pop(a).over(w), F.var_pop(b).over(w)
    moves = (va > 1e-12 * F.avg(a * a).over(w)) & (vb > 1e-12 * F.avg(b * b).over(w))
    return F.when((F.count(a).over(w) >= (least or n)) & moves, F.covar_pop(a, b).over(w) / F.sqrt(va * vb))


def valued(panel: DataFrame, value: Column) -> DataFrame:
    """asset, date and the value to nine digits."""
    return panel.select("asset", "date", F.round(value.cast("double"), 9).alias("value"))


def signalled(values: DataFrame, least: int = 10) -> DataFrame:
    return values.selectExpr("asset", "date", "value", f"round({cs_rank('value', least)}, 9) as signal")


def volume_price_divergence(panel: DataFrame, n: int = 20) -> DataFrame:
    """Rank correlation of price and volume over n rows with enough of both, turned around where the price fell over them."""
    both = F.when(F.col("close").isNotNull() & F.col("volume").isNotNull(), F.struct(F.col("close").alias("a"), F.col("volume").alias("b")))
    f = panel.withColumn("v", framed(both, n)).withColumn("fell", F.try_divide(F.col("close"), back("close", n)) - 1 < 0)
    f = f.withColumn("x", F.transform("v", lambda p: p["a"])).withColumn("y", F.transform("v", lambda p: p["b"]))
    f = f.withColumn("x", ranks(F.col("x"))).withColumn("y", ranks(F.col("y")))
    f = f.withColumn("rho", whole(F.col("v"), max(10, int(0.75 * n)), correlation(F.zip_with("x", "y", lambda x, y: F.struct(x.alias("a"), y.alias("b"))))))
    return valued(f, F.when(F.col("fell"), -F.col("rho")).otherwise(F.col("rho")))


def amihud_persistence(panel: DataFrame, n: int = 20) -> DataFrame:
    """Minus the correlation of illiquidity with its own last value."""
    x = panel.withColumn("x", F.try_divide(F.abs("ret"), F.col("volume") * F.col("close")))
    return valued(x.withColumn("y", back("x")), -pair_corr("x", "y", n, n // 2))


def turnover_rate(panel: DataFrame, shares: DataFrame, n: int = 20) -> DataFrame:
    """Mean of volume over shares outstanding (asset, shares)."""
    x = F.try_divide(F.col("volume"), F.col("shares"))
    both = panel.join(shares, "asset", "left")
    return valued(both, F.when(F.count(x).over(over(n)) >= n // 2, F.avg(x).over(over(n))))


def entropy(panel: DataFrame, n: int = 20, bins: int = 10) -> DataFrame:
    """Minus the entropy in bits of the n returns before, in equal bins from the smallest to the largest; half of them are needed."""
    v, low, high = F.col("v"), F.col("low"), F.col("high")
    f = panel.withColumn("v", framed("ret", n, 1)).withColumn("k", F.row_number().over(by_asset())).withColumn("low", F.array_min("v")).withColumn("high", F.array_max("v"))
    f = f.withColumn("place", F.when(high > low, F.transform(v, lambda y: F.least(F.floor((y - low) / (high - low) * bins), F.lit(bins - 1)).cast("int"))))
    f = f.withColumn("shares", F.transform(F.array(*[F.lit(k) for k in range(bins)]), lambda k: F.size(F.filter("place", lambda y: y == k)) / F.size("v")))
    bits = F.aggregate("shares", F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return valued(f, F.when((F.col("k") > n) & (F.size("v") >= n // 2), F.when(high > low, bits).otherwise(0.0)))


def tail_mean(panel: DataFrame, n: int = 60, q: float = 0.05) -> DataFrame:
    """Mean of the n returns before that don't exceed their q-quantile; half of them are needed."""
    v = F.col("v")
    place = q * (F.size(v) - 1)
    sorted_, at = F.array_sort(v), F.floor(place).cast("int")
    edge = F.get(sorted_, at) + (F.get(sorted_, F.least(at + 1, F.size(v) - 1)) - F.get(sorted_, at)) * (place - at)
    tail = F.filter(v, lambda y: y <= F.col("edge"))
    framed_ = panel.withColumn("v", framed("ret", n, 1)).withColumn("k", F.row_number().over(by_asset())).withColumn("edge", F.when(F.size("v") > 0, edge) + 1e-12)
    return valued(framed_, F.when((F.col("k") > n) & (F.size(v) >= n // 2), F.aggregate(tail, F.lit(0.0), lambda s, y: s + y) / F.size(tail)))


def hurst(panel: DataFrame, n: int = 100) -> DataFrame:
    """ln(range of summed deviations over spread) / ln(rows) - 0.5 of the n returns before; half of them are needed."""
    v, size = F.col("v"), F.size("v")
    mean = F.try_divide(F.aggregate(v, F.lit(0.0), lambda s, y: s + y), size)
    walk = F.aggregate(v, F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(0.0).alias("q")), lambda a, y: F.struct((a["s"] + y - F.col("mean")).alias("s"), F.least(a["lo"], a["s"] + y - F.col("mean")).alias("lo"), F.greatest(a["hi"], a["s"] + y - F.col("mean")).alias("hi"), (a["q"] + (y - F.col("mean")) * (y - F.col("mean"))).alias("q")))
    framed_ = panel.withColumn("v", framed("ret", n, 1)).withColumn("k", F.row_number().over(by_asset())).withColumn("mean", mean).withColumn("w", walk)
    spread = F.sqrt(F.try_divide(F.col("w.q"), F.when(size > 1, size - 1)))
    rs = F.when(spread > 1e-10, (F.col("w.hi") - F.col("w.lo")) / spread)
    return valued(framed_, F.when((F.col("k") > n) & (size >= n // 2) & (rs > 0), F.ln(rs) / F.ln(size) - 0.5))


def _staged(panel: DataFrame, *stages: dict[str, Column]) -> DataFrame:
    for stage in stages:
        panel = panel.withColumns({k: F.round(v.cast("double"), 9) for k, v in stage.items()})
    return panel


def formula_001(p: DataFrame) -> DataFrame:
    spread = rolled(F.stddev_samp, "ret", 20)
    x = _staged(p, {"x": F.when(F.col("ret") < 0, spread).otherwise(F.col("close"))}, {"x": signed_power(F.col("x"), 2.0)}, {"x": ts_argmax("x", 5)}, {"x": cross_rank("x") - 0.5})
    return valued(x, F.col("x"))


def formula_026(p: DataFrame) -> DataFrame:
    x = _staged(p, {"a": ts_rank("volume", 5), "b": ts_rank("high", 5)}, {"x": pair_corr("a", "b", 5)}, {"x": -rolled(F.max, "x", 3)})
    return valued(x, F.col("x"))


def formula_047(p: DataFrame) -> DataFrame:
    x = _staged(p, {"inv": F.try_divide(F.lit(1.0), F.col("close")), "adv": rolled(F.avg, "volume", 20), "hc": F.col("high") - F.col("close"), "h5": rolled(F.avg, "high", 5), "back": F.col("vwap") - back("vwap", 5)})
    x = _staged(x, {"a": cross_rank("inv"), "b": cross_rank("hc"), "c": cross_rank("back")})
    value = F.try_divide(F.col("a") * F.col("volume"), F.col("adv")) * F.try_divide(F.col("high") * F.col("b"), F.col("h5")) - F.col("c")
    return valued(x, value)


def formula_057(p: DataFrame) -> DataFrame:
    x = _staged(p, {"a": ts_argmax("close", 30)}, {"a": cross_rank("a")}, {"a": decay_linear("a", 2)})
    return valued(x, -F.try_divide(F.col("close") - F.col("vwap"), F.when(F.round(F.col("a"), 9) != 0, F.col("a"))))


def formula_060(p: DataFrame) -> DataFrame:
    x = _staged(p, {"a": F.try_divide((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), F.round(F.col("high") - F.col("low"), 9)) * F.col("volume"), "b": ts_argmax("close", 10)})
    x = _staged(x, {"a": cross_rank("a"), "b": cross_rank("b")})
    return valued(x, -(2 * F.col("a") - F.col("b")))


def formula_083(p: DataFrame) -> DataFrame:
    x = _staged(p, {"r": F.try_divide(F.col("high") - F.col("low"), rolled(F.avg, "close", 5))}, {"d": back("r", 2)}, {"d": cross_rank("d"), "v": cross_rank("volume")}, {"v": cross_rank("v")})
    return valued(x, F.round(F.col("d") * F.col("v"), 6))


def formula_084(p: DataFrame) -> DataFrame:
    x = _staged(p, {"a": F.col("vwap") - rolled(F.max, "vwap", 15)}, {"a": ts_rank("a", 20), "b": F.col("close") - back("close", 5)})
    return valued(x, F.round(signed_power(F.col("a"), F.col("b")), 6))


def formula_085(p: DataFrame) -> DataFrame:
    x = _staged(p, {"m": F.col("high") * 0.8767 + F.col("close") * 0.1233, "adv": rolled(F.avg, "volume", 30), "hl": (F.col("high") + F.col("low")) / 2})
    x = _staged(x, {"a": pair_corr("m", "adv", 10), "p": ts_rank("hl", 4), "q": ts_rank("volume", 10)}, {"b": pair_corr("p", "q", 7)}, {"a": cross_rank("a"), "b": cross_rank("b")})
    return valued(x, F.pow("a", "b"))


FORMULAS = {"001": formula_001, "026": formula_026, "047": formula_047, "057": formula_057, "060": formula_060, "083": formula_083, "084": formula_084, "085": formula_085}
