"""Streams give the rows of their batch forms, across batches, restarts, late rows, resets and silence."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import anomaly
from quantloom.sources import tables
from quantloom.streaming import indicators, live

START = datetime.datetime(2024, 1, 1, 9)
BARS = "symbol long, start timestamp, high double, low double, close double, volume double, bid double, ask double, reset boolean"


def bars(n=40):
    rng, out = random.Random(7), []
    for s in range(3):
        close = 50.0 + s
        for k in range(n):
            close = max(1.0, close + rng.gauss(0, 1)) if s else close + 1
            bid = None if rng.random() < 0.2 else close * 0.99
            out.append((s, START + datetime.timedelta(minutes=61 * k + s), close + rng.random(), close - rng.random(), close, float(rng.randint(0, 9) if s else 5), bid, bid and bid + rng.random(), None))
    return out


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def run(stream, out, checkpoint):
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


@pytest.fixture(autouse=True)
def state(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    live.use_state(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def close_to(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:2] == y[:2]
        for u, v in zip(x[2:], y[2:], strict=True):
            assert u == (None if v is None else pytest.approx(v, abs=1e-9)), (x, y)


def test_indicators_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    rows = bars()
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    at = lambda a, b: [r for r in rows if START + datetime.timedelta(hours=a) <= r[1] < START + datetime.timedelta(hours=b)]
    read = lambda: spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(source)
    for a, b in ((0, 3), (3, 11), (11, 12)):
        put(spark, source, at(a, b), BARS)
    run(live.live_indicators(read(), 6, 5), out, checkpoint)
    late = [(1, START + datetime.timedelta(hours=5), 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, None)]
    put(spark, source, at(12, 30) + late, BARS)
    put(spark, source, at(30, 99), BARS)
    run(live.live_indicators(read(), 6, 5), out, checkpoint)  # after a restart
    names = ["symbol", "start", "momentum", "vwap_deviation", "volume_surge", "spread_signal", "rsi"]
    got = spark.read.parquet(out)
    want = indicators.five(spark.createDataFrame(rows, BARS), 6, 5).select(names)
    close_to(sorted(map(tuple, got.select(names).collect())), sorted(map(tuple, want.collect())))
    assert {r["symbol"]: r["late"] for r in got.groupBy("symbol").agg(F.max("late").alias("late")).collect()} == {0: 0, 1: 1, 2: 0}
    whole = want.where("symbol = 0 and rsi is not null")
    assert whole.count() == 35 and whole.where("rsi <> 1").count() == 0  # it only rises


def test_reset_and_silence_start_a_symbol_anew(spark, tmp_path):
    rows = [r for r in bars(30) if r[0] < 2]
    middle = rows[15][1]
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    put(spark, source, [r for r in rows if r[1] <= middle] + [(0, middle + datetime.timedelta(seconds=1), None, None, None, None, None, None, True)], BARS)
    put(spark, source, [r for r in rows if r[1] > middle], BARS)
    run(live.live_indicators(spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(source), 6, 5), out, checkpoint)
    names = ["symbol", "start", "momentum", "vwap_deviation", "volume_surge", "spread_signal", "rsi"]
    parts = [r for r in rows if r[0] == 1], [r for r in rows if r[0] == 0 and r[1] <= middle], [r for r in rows if r[0] == 0 and r[1] > middle]
    want = [tuple(r) for p in parts for r in indicators.five(spark.createDataFrame(p, BARS), 6, 5).select(names).collect()]
    close_to(sorted(map(tuple, spark.read.parquet(out).select(names).collect())), sorted(want))
    # a symbol is forgotten when the watermark passes its silence
    source, out, checkpoint = (f"{tmp_path}/{x}2" for x in ("in", "out", "check"))
    one = lambda s, hours, close: (s, START + datetime.timedelta(hours=hours), close, close, close, 1.0, None, None, None)
    for batch in ([one(0, k, 10.0 + k) for k in range(4)], [one(1, 30, 5.0)], [one(1, 31, 5.0)], [one(1, 32, 5.0)], [one(0, 33, 20.0), one(0, 34, 21.0)]):
        put(spark, source, batch, BARS)
    stream = spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(source).withWatermark("start", "1 minute")
    run(live.live_indicators(stream, 2, 2, idle=3600), out, checkpoint)
    got = {r["start"]: r["momentum"] for r in spark.read.parquet(out).where("symbol = 0").collect()}
    assert got[START + datetime.timedelta(hours=2)] == pytest.approx(0.2) and got[START + datetime.timedelta(hours=34)] is None


def test_shifts_and_their_alarms(spark, tmp_path):
    rng = random.Random(5)
    values = [("s", m, START + datetime.timedelta(days=k), None if k == 7 else rng.gauss(3.0 * (k > 40), 1)) for m in ("a", "b") for k in range(80)]
    schema = "strategy string, metric string, date timestamp, x double"
    source, folder, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "alarms", "check"))
    for a, b in ((0, 5), (5, 50)):
        put(spark, source, [v for v in values if START + datetime.timedelta(days=a) <= v[2] < START + datetime.timedelta(days=b)], schema)
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    live.alert_sink(live.live_shifts(read(), 20), folder, checkpoint).awaitTermination()
    put(spark, source, [v for v in values if v[2] >= START + datetime.timedelta(days=50)] + values[:3], schema)
    live.alert_sink(live.live_shifts(read(), 20), folder, checkpoint).awaitTermination()
    log = live.alert_log(spark, folder).collect()
    want = anomaly.cusum(spark.createDataFrame(values, schema), 20).where("alarm is not null").collect()
    assert len(want) > 2 and sorted((r["metric"], r["date"], r["alarm"], round(r["limit"], 9)) for r in log) == sorted((r["metric"], r["date"], r["alarm"], round(r["limit"], 9)) for r in want)
    assert [r["severity"] for r in log] == sorted(r["severity"] for r in log)


def test_a_batch_that_runs_again_writes_its_alarms_once(spark, tmp_path):
    values = [("s", "a", START + datetime.timedelta(days=k), float(k % 3) + 9.0 * (k > 30)) for k in range(40)]
    schema = "strategy string, metric string, date timestamp, x double"
    put(spark, f"{tmp_path}/in", values, schema)
    for k in range(2):  # two queries that know nothing of each other, as after a lost checkpoint
        live.alert_sink(live.live_shifts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 20), f"{tmp_path}/alarms", f"{tmp_path}/check{k}").awaitTermination()
    log = live.alert_log(spark, f"{tmp_path}/alarms")
    assert log.count() == log.distinct().count() > 0


def test_late_ticks_are_counted(spark, tmp_path):
    schema = "event_id long, symbol long, ts timestamp, kind string, price double"
    tick = lambda i, minute, price: (i, 1, START + datetime.timedelta(minutes=minute), "trade", price)
    for batch in ([tick(1, 0, 5.0), tick(2, 4, 6.0)], [tick(3, 3, 4.0), tick(4, 12, 7.0)], [tick(5, 30, 8.0)], [tick(8, 31, 8.0)], [tick(6, 1, 99.0)], [tick(7, 60, 8.0)]):
        put(spark, f"{tmp_path}/in", batch, schema)
    query = run(live.live_bars(tables.read_ticks_stream(spark, f"{tmp_path}/in", files=1), "10 minutes", "5 minutes"), f"{tmp_path}/out", f"{tmp_path}/check")
    first = spark.read.parquet(f"{tmp_path}/out").where(F.col("start") == F.lit(START)).collect()
    assert [(r["open_"], r["high"], r["low"], r["close"], r["trade_count"]) for r in first] == [(5.0, 6.0, 4.0, 6.0, 3)]  # the late tick within five minutes counts
    assert live.dropped(query) == 1
