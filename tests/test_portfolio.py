"""Joins on time, portfolio replay, performance and ticks: against SQL, by hand, and as streams."""

import datetime as dt

import duckdb
import pytest

from quantloom.jobs.registry import ORACLES, QUERIES
from quantloom.operators import joins, performance, portfolio, screen
from quantloom.streaming import ticks

D = "/root/testdata/sf0.01"


def rows(records, columns):
    tidy = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(tidy(r[c]) for c in sorted(columns)) for r in records), key=repr)


@pytest.mark.parametrize("name", ["replay_momentum", "performance_momentum", "yearly_momentum", "drawdown_episodes_momentum", "rolling_sharpe_momentum", "market_attribution", "tick_bars_hour", "latest_ticks", "tick_sessions", "asof_quotes", "interval_orders", "universe_filter", "winsorized_returns", "masked_momentum", "blended_signal", "residual_returns", "monthly_movers", "volume_anomalies"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "events", "orders"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    wanted = con.sql(ORACLES[name])
    got = QUERIES[name](spark, D)
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got.collect(), wanted.columns) == rows([dict(zip(wanted.columns, r)) for r in wanted.fetchall()], wanted.columns)


def test_asof_carries_over_buckets_and_breaks_ties(spark):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    left = spark.createDataFrame([(1, at(1, 0), "a"), (1, at(1, 5), "b"), (1, at(9, 0), "c"), (2, at(9, 0), "d"), (None, at(9, 0), "e")], "k int, ts timestamp, name string")
    right = spark.createDataFrame([(1, at(1, 5), 1), (1, at(1, 5), 2), (1, at(3, 1), 3), (2, at(9, 1), 4), (None, at(1, 1), 5)], "k int, ts timestamp, v int")
    got = {r["name"]: r["v"] for r in joins.asof_join(left, right, "k", "ts", ["v"]).collect()}
    assert got == {"a": None, "b": 2, "c": 3, "d": None, "e": None}
    assert joins.asof_join(left.limit(0), right, "k", "ts", ["v"]).count() == 0
    assert all(r["v"] is None for r in joins.asof_join(left, right.limit(0), "k", "ts", ["v"]).collect())


def test_orders_and_total_loss(spark):
    day = lambda m: dt.date(2020, m, 1)
    weights = spark.createDataFrame([(day(1), 1, 1.0), (day(1), 2, -1.0), (day(2), 1, -1.0), (day(2), 3, 1.0)], "date date, asset int, weight double")
    got = {(r["date"], r["asset"]): (r["action"], r["trades"]) for r in portfolio.rebalance_orders(weights).collect()}
    assert got == {(day(1), 1): ("LONG", 1), (day(1), 2): ("SHORT", 1), (day(2), 1): ("TO_SHORT", 2), (day(2), 2): ("CLOSE_SHORT", 1), (day(2), 3): ("LONG", 1)}
    panel = spark.createDataFrame([(day(2), 1, -0.9), (day(2), 2, 0.6), (day(3), 1, 0.1), (day(3), 3, None)], "date date, asset int, ret double")
    by = {r["date"]: r for r in portfolio.replay(weights, panel, 0.0).collect()}
    assert by[day(1)]["gross"] == 0.0 and by[day(2)]["net"] == pytest.approx(-1.5) and by[day(3)]["gross"] == pytest.approx(-0.1) and by[day(3)]["equity"] == 0.0
    series = spark.createDataFrame([(day(1), 0.5), (day(2), -1.5), (day(3), 0.2)], "date date, r double")
    assert performance.measures(series).first()["total"] == -1.0


def test_replay_charges_opening_and_keeps_positions(spark):
    day = lambda m: dt.date(2020, m, 1)
    weights = spark.createDataFrame([(day(1), 1, 0.5), (day(1), 2, -0.5), (day(4), 1, 0.5), (day(4), 3, -0.5)], "date date, asset int, weight double")
    panel = spark.createDataFrame([(day(m), a, 0.1 * a) for m in range(1, 6) for a in (1, 2, 3)], "date date, asset int, ret double")
    by = {r["date"].month: r for r in portfolio.replay(weights, panel, 0.01).collect()}
    assert by[1]["trades"] == 2 and by[1]["net"] == pytest.approx(-2 * 1.3 / 2 * 0.01)
    assert [by[m]["gross"] for m in (2, 3, 4)] == pytest.approx([-0.05] * 3) and by[2]["net"] == pytest.approx(-0.05)
    assert by[4]["trades"] == 2 and by[4]["net"] == pytest.approx(-0.05 - 0.013) and by[5]["gross"] == pytest.approx(-0.1)


def test_intervals_without_an_end(spark):
    facts = spark.createDataFrame([(1, dt.date(2150, 5, 1)), (1, dt.date(1999, 1, 1)), (2, dt.date(2000, 1, 1))], "k int, at date")
    periods = spark.createDataFrame([(1, dt.date(2000, 1, 1), dt.date(9999, 12, 31), "a")], "k int, since date, until date, v string")
    assert [(r["k"], r["at"].year, r["v"]) for r in joins.interval_join(facts, periods, "k", "at", "since", "until").collect()] == [(1, 2150, "a")]
    assert joins.interval_join(facts.limit(0), periods, "k", "at", "since", "until").count() == 0


def test_blend_weighs_what_is_there(spark):
    tall = spark.createDataFrame([("d", k, f, v) for k in range(10) for f, v in (("a", float(k)), ("b", None if k == 3 else 1.0), ("other", 9.0))], "date string, asset int, factor string, signal double")
    got = {r["asset"]: r["value"] for r in screen.blend(tall, {"a": 3.0, "b": 1.0}).collect()}
    assert got[3] == pytest.approx(3.0) and got[4] == pytest.approx(13 / 4)


def test_stream_of_bars_equals_the_batch(spark, tmp_path):
    shape = "event_id bigint, symbol bigint, ts timestamp, kind string, price double"
    events = spark.read.parquet(f"{D}/events.parquet").selectExpr("event_id", "user_id as symbol", "ts", "event_type as kind", "value as price")
    source = str(tmp_path / "ticks")
    events.repartition(3).write.parquet(source)
    events.where("event_id < 500").write.mode("append").parquet(source)
    stream = ticks.tick_bars(ticks.once(spark.readStream.schema(shape).parquet(source), "40 days"), "1 hour")
    query = stream.writeStream.format("memory").queryName("hour_bars").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = ticks.tick_bars(events, "1 hour")
    assert rows(spark.table("hour_bars").collect(), batch.columns) == rows(batch.collect(), batch.columns)


def test_long_only_replay_by_hand(spark):
    import datetime
    import random

    from quantloom.operators import portfolio

    rng, days = random.Random(3), [datetime.date(2020, 1, 1) + datetime.timedelta(days=k) for k in range(13)]
    ret = {(k, a): None if rng.random() < 0.1 else round(rng.gauss(0, 0.05), 4) for k in range(13) for a in range(6)}
    signal = {(k, a): None if rng.random() < 0.1 else rng.random() for k in range(13) for a in range(6)}
    panel = spark.createDataFrame([(days[k], a, v) for (k, a), v in ret.items()], "date date, asset long, ret double")
    signals = spark.createDataFrame([(days[k], a, v) for (k, a), v in signal.items()], "date date, asset long, signal double")
    got = {r["date"]: (r["equity"], r["names"]) for r in portfolio.long_only(signals, panel, 2, 4, 0.01).collect()}
    cash, held, worth = 1.0, [], {}
    for k in range(13):
        if held:
            worth = {a: w * (1 + (ret[k, a] or 0)) for a, w in worth.items()}
            cash = sum(worth.values())
            assert got[days[k]] == (pytest.approx(cash, abs=1e-8), 2)
        if k % 4 == 0:
            best = sorted((a for a in range(6) if signal[k, a] is not None), key=lambda a: (-signal[k, a], a))[:2]
            cash *= 1 - 0.01 * (len(set(best) - set(held)) + len(set(held) - set(best))) / 2
            held, worth = best, {a: cash / 2 for a in best}
    assert len(got) == 12
