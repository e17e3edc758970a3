"""Bars, latest records and sessions of ticks (event_id, symbol, ts, kind, price); each takes a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(ticks: DataFrame, late: str) -> DataFrame:
    """A stream's ticks without those sent again; ticks later than `late` may be dropped."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def tick_bars(ticks: DataFrame, every: str) -> DataFrame:
    """Open, high, low, close, mean price and count by symbol and time window; ties in time go by event_id."""
    at = F.struct("ts", "event_id")
    return ticks.where("ts is not null").groupBy("symbol", F.window("ts", every).alias("w")).agg(
        F.min_by("price", at).alias("open_"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.round(F.avg("price"), 6).alias("mean"), F.count("*").alias("trade_count")
    ).select("symbol", F.col("w.start").alias("start"), "open_", "high", "low", "close", "mean", "trade_count")


def latest(ticks: DataFrame) -> DataFrame:
    """The last record of each symbol and kind; ties in time go by event_id."""
    return ticks.where("ts is not null").groupBy("symbol", "kind").agg(F.max(F.struct("ts", "event_id", "price")).alias("x")).select("symbol", "kind", "x.ts", "x.event_id", "x.price")


def sessions(ticks: DataFrame, gap: str) -> DataFrame:
    """Runs of a symbol's ticks with pauses shorter than gap."""
    return ticks.where("ts is not null").groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("ticks"), F.round(F.sum("price"), 4).alias("total")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "ticks", "total")
