"""Real-time indicators of bars (symbol, start, high, low, close, volume), each row from its symbol's rows up to it.

The batch forms: a stream's bars go through them in foreachBatch over what a symbol's last rows keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.recursion import wilder


def by_symbol():
    return Window.partitionBy("symbol").orderBy("start")


def indicators(bars: DataFrame, n: int = 20) -> DataFrame:
    """bars with momentum (close against n rows before), vwap_deviation (from the day's typical price by volume) and volume_surge (against the mean of the n - 1 rows before); null until there are enough rows."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    day = Window.partitionBy("symbol", F.to_date("start")).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    vwap = F.try_divide(F.sum(typical * F.col("volume")).over(day), F.sum("volume").over(day))
    past = by_symbol().rowsBetween(1 - n, -1)
    usual = F.when(F.count("volume").over(past) >= n - 1, F.avg("volume").over(past))
    return bars.select("*", (F.try_divide(F.col("close"), F.lag("close", n).over(by_symbol())) - 1).alias("momentum"), F.try_divide(F.col("close") - vwap, vwap).alias("vwap_deviation"), (F.try_divide(F.col("volume"), usual) - 1).alias("volume_surge"))


def composite(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """rows with composite: the weighted mean of the indicators that are there, within -1 and 1; null without any."""
    there = lambda c, x: F.when(F.col(c).isNotNull(), x).otherwise(0.0)
    total = sum((there(c, F.col(c) * w) for c, w in weights.items()), F.lit(0.0))
    weight = sum((there(c, F.lit(w)) for c, w in weights.items()), F.lit(0.0))
    mean = F.try_divide(total, weight)
    return rows.withColumn("composite", F.when(mean.isNotNull(), F.greatest(F.least(mean, F.lit(1.0)), F.lit(-1.0))))


def cross_section(rows: DataFrame, least: int = 5) -> DataFrame:
    """symbol, start and the composite's rank among the symbols of that start, -1 to 1, where at least five have one."""
    one = Window.partitionBy("start")
    place = F.rank().over(one.orderBy(F.col("composite").asc_nulls_last())) + (F.count("composite").over(Window.partitionBy("start", "composite")) - 1) / 2
    n = F.count("composite").over(one)
    return rows.select("symbol", "start", F.when(F.col("composite").isNotNull() & (n >= least), 2 * place / n - 1).alias("signal"))


def last_n(ticks: DataFrame, n: int) -> DataFrame:
    """The last n records of each symbol and kind, the newest first."""
    place = F.row_number().over(Window.partitionBy("symbol", "kind").orderBy(F.desc("ts"), F.desc("event_id")))
    return ticks.where("ts is not null").withColumn("place", place).where(F.col("place") <= n)


def buffer_stats(ticks: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Records by symbol and kind, of the subscribed symbols if they are given."""
    kept = ticks if symbols is None else ticks.join(symbols, "symbol", "left_semi")
    return kept.groupBy("symbol", "kind").agg(F.count("*").alias("n"))


def five(bars: DataFrame, n: int = 20, rsi_n: int = 14) -> DataFrame:
    """symbol, start and five indicators of bars (symbol, start, high, low, close, volume, bid, ask), each row from its symbol's rows up to it.

    momentum, vwap_deviation (from the second bar on) and volume_surge as in indicators(); spread_signal: minus a third of the last quoted
    spread's standard score among n bars, half of which need quotes, within -1 and 1; rsi: gains against losses by Wilder's averages, -1 to 1.
    """
    w, last = by_symbol(), by_symbol().rowsBetween(1 - n, 0)
    spread = F.when((F.col("bid") > 0) & (F.col("ask") > 0), (F.col("ask") - F.col("bid")) / ((F.col("ask") + F.col("bid")) / 2))
    change = F.col("close") - F.lag("close").over(w)
    rows = indicators(bars, n).withColumn("_s", spread).withColumn("_up", F.greatest(change, 0 * change)).withColumn("_down", F.greatest(-change, 0 * change)).withColumn("_i", F.row_number().over(w))
    rows = wilder(wilder(rows, F.col("_up"), rsi_n, "_gain", by=("symbol",), order="start"), F.col("_down"), rsi_n, "_loss", by=("symbol",), order="start")
    sd, quoted = F.stddev_pop("_s").over(last), (F.col("_i") >= n) & (F.count("_s").over(last) >= max(n // 2, 1))
    z = (F.last("_s", ignorenulls=True).over(last) - F.avg("_s").over(last)) / sd
    signal = F.when(quoted, F.when(sd < 1e-12, 0.0).otherwise(F.greatest(F.least(-z / 3, F.lit(1.0)), F.lit(-1.0))))
    rsi = F.when(F.col("_loss") == 0, 1.0).otherwise(1 - 2 / (1 + F.col("_gain") / F.col("_loss")))
    return rows.select("symbol", "start", "momentum", F.when(F.col("_i") >= 2, F.col("vwap_deviation")).alias("vwap_deviation"), "volume_surge", signal.alias("spread_signal"), F.when(F.col("_gain").isNotNull(), rsi).alias("rsi"))
