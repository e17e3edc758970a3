"""Indicators and anomalies of streams, with state by key that outlives a restart; alarms to a sink that a repeated batch doesn't repeat.

State is kept by Spark's state store (RocksDB; see use_state()): a key's last rows and running means, of bounded size
whatever the stream's length.  Each gives the rows that its batch form gives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.anomaly import FLAT, LEAST, THRESHOLD, shift
from .ticks import tick_bars

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = "symbol long, start timestamp, momentum double, vwap_deviation double, volume_surge double, spread_signal double, rsi double, late long"
_BARS = "closes array<double>, volumes array<double>, spreads array<double>, changes long, gain double, loss double, amount double, volume double, last timestamp, late long"
_NEW = ([], [], [], 0, 0.0, 0.0, 0.0, 0.0, None, 0)


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def use_state(spark: SparkSession) -> None:
    """Keyed state with timers needs RocksDB as the session's state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def live_bars(ticks: DataFrame, every: str, late: str) -> DataFrame:
    """A stream's bars by symbol and time window, final once ticks later than `late` are past: late ones within it still count, later ones are dropped, and counted by dropped()."""
    return tick_bars(ticks.withWatermark("ts", late), every)


def dropped(query: StreamingQuery) -> int:
    """Rows that came too late, over the progress that the query remembers."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def _mean(values: list[float]) -> float:
    return sum(values) / len(values)


class _Indicators(StatefulProcessor):
    """A symbol's last bars, the day's amounts and the two averages of changes."""

    def __init__(self, n: int, rsi_n: int, idle: int | None):
        self.n, self.rsi_n, self.idle = n, rsi_n, idle
        self.schema = StructType.fromDDL(_BARS)  # here: workers can't read schemas from text

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getValueState("bars", self.schema)

    def _row(self, key: Any, bar: Any, state: list) -> tuple:
        closes, volumes, spreads, changes, gain, loss, amount, volume, last, late = state
        n, close = self.n, float(bar.close)
        if closes:
            change = close - closes[-1]
            up, down, changes = max(change, 0.0), max(-change, 0.0), changes + 1
            # the first changes are added up, then averaged, then fade
            gain, loss = (gain + up, loss + down) if changes <= self.rsi_n else ((gain * (self.rsi_n - 1) + up) / self.rsi_n, (loss * (self.rsi_n - 1) + down) / self.rsi_n)
            if changes == self.rsi_n:
                gain, loss = gain / self.rsi_n, loss / self.rsi_n
        if last is not None and last.date() != bar.start.date():
            amount = volume = 0.0
        amount, volume = amount + (bar.high + bar.low + close) / 3 * bar.volume, volume + bar.volume
        first = not closes
        quoted = pd.notna(bar.bid) and pd.notna(bar.ask) and bar.bid > 0 and bar.ask > 0
        closes, volumes = [*closes, close][-n - 1 :], [*volumes, float(bar.volume)][-n:]
        spreads = [*spreads, float((bar.ask - bar.bid) / ((bar.ask + bar.bid) / 2)) if quoted else None][-n:]
        momentum = close / closes[0] - 1 if len(closes) > n and closes[0] != 0 else None
        vwap = amount / volume if volume > 0 else 0.0
        deviation = (close - vwap) / vwap if not first and vwap != 0 else None
        usual = _mean(volumes[:-1]) if len(volumes) == n and n > 1 else 0.0
        surge = volumes[-1] / usual - 1 if usual != 0 else None
        spread, known = None, [s for s in spreads if s is not None]
        if len(spreads) == n and len(known) >= max(n // 2, 1):
            mean = _mean(known)
            sd = math.sqrt(_mean([(s - mean) ** 2 for s in known]))
            spread = 0.0 if sd < 1e-12 else min(max(-(known[-1] - mean) / sd / 3, -1.0), 1.0)
        rsi = None if changes < self.rsi_n else 1.0 if loss == 0 else 1 - 2 / (1 + gain / loss)
        state[:] = [closes, volumes, spreads, changes, gain, loss, amount, volume, bar.start.to_pydatetime(), late]
        return (key[0], bar.start, momentum, deviation, surge, spread, rsi, late)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        bars = pd.concat(list(rows)).sort_values(["start", "reset"], kind="stable")
        state = list(self.bars.get()) if self.bars.exists() else list(_NEW)
        state[:3] = [list(x) for x in state[:3]]
        out = []
        for bar in bars.itertuples(index=False):
            if bar.reset:
                state = [*_NEW[:8], None, state[9]]
            elif state[8] is not None and bar.start <= pd.Timestamp(state[8]):
                state[9] += 1  # later than a bar that has been answered
            else:
                out.append(self._row(key, bar, state))
        self.bars.update(tuple(state))
        if self.idle is not None and state[8] is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(pd.Timestamp(state[8]).tz_localize("UTC").timestamp() * 1000) + self.idle * 1000)
        if out:
            yield pd.DataFrame(out, columns=_names(FIELDS))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.bars.clear()  # a symbol that has been silent starts anew
        return iter([])

    def close(self) -> None:
        pass


def live_indicators(bars: DataFrame, n: int = 20, rsi_n: int = 14, idle: int | None = None) -> DataFrame:
    """Five indicators of a stream of bars (symbol, start, high, low, close, volume, bid, ask, reset), a row for each bar as it comes.

    As indicators.five() gives them: momentum, vwap_deviation, volume_surge, spread_signal and rsi; and late, the symbol's
    bars that came after a later one, which are dropped.  A row with reset true forgets its symbol.  idle: seconds after
    which a symbol without bars is forgotten; bars then need a watermark on start.  start is in UTC.
    """
    keyed = bars.select("symbol", "start", *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close", "volume", "bid", "ask")], F.coalesce("reset", F.lit(False)).alias("reset"))
    return keyed.groupBy("symbol").transformWithStateInPandas(_Indicators(n, rsi_n, idle), StructType.fromDDL(FIELDS), "Append", "None" if idle is None else "EventTime")


SHIFTS = "strategy string, metric string, date timestamp, x double, z double, limit double, up double, down double, alarm string"


class _Shifts(StatefulProcessor):
    """A metric's last values and the two sums."""

    def __init__(self, window: int):
        self.window = window
        self.schema = StructType.fromDDL("recent array<double>, up double, down double, last timestamp")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", self.schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        recent, up, down, last = self.seen.get() if self.seen.exists() else ([], 0.0, 0.0, None)
        recent, out = list(recent), []
        for row in pd.concat(list(rows)).sort_values("date", kind="stable").itertuples(index=False):
            if last is not None and row.date <= pd.Timestamp(last):
                continue
            x = None if pd.isna(row.x) else float(row.x)
            recent, z, limit = [*recent, x][-self.window :], None, None
            known, past = (np.array([v for v in part if v is not None]) for part in (recent, recent[:-1]))
            if len(recent) == self.window and len(known) >= LEAST:
                if x is not None and len(past) and past.std() >= FLAT:
                    z = float((x - past.mean()) / past.std())
                limit = THRESHOLD * float(known.std()) if known.std() >= FLAT else None
            shown_up, shown_down, up, down, alarm = shift(up, down, z, limit)
            last = row.date.to_pydatetime()
            out.append((*key, row.date, x, z, limit, shown_up, shown_down, alarm))
        self.seen.update((recent, up, down, last))
        if out:
            yield pd.DataFrame(out, columns=_names(SHIFTS)).astype({c: "float64" for c in ("x", "z", "limit", "up", "down")})

    def close(self) -> None:
        pass


def live_shifts(values: DataFrame, window: int = 60) -> DataFrame:
    """anomaly.cusum() of a stream of metrics (strategy, metric, date, x), a row for each as it comes; a value that is not later than its metric's last one is dropped."""
    keyed = values.select("strategy", "metric", F.col("date").cast("timestamp").alias("date"), F.col("x").cast("double").alias("x"))
    return keyed.groupBy("strategy", "metric").transformWithStateInPandas(_Shifts(window), StructType.fromDDL(SHIFTS), "Append", "None")


def alert_sink(shifts: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that writes a stream's alarms to folder.

    Each batch has a folder of its own, by its number, which a batch that runs again after a failure writes over: no
    alarm is lost or twice there.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.where("alarm is not null").withColumn("severity", F.split("alarm", " ")[0])
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return shifts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def alert_log(spark: SparkSession, folder: str) -> DataFrame:
    """All alarms so far, critical ones first, then by time."""
    return spark.read.schema(SHIFTS + ", severity string, batch long").parquet(folder).orderBy("severity", "date", "strategy", "metric")
