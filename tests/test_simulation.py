"""The capital-carrying replay against a plain loop, and by hand."""

import datetime
import math
import random

import pytest

from quantloom.operators import simulation
from quantloom.operators.simulation import Config

DAYS = [datetime.date(2020, 1, 1) + datetime.timedelta(days=31 * k) for k in range(24)]


def rows_of(rng, names=14):
    out = []
    for date in DAYS:
        for a in range(names):
            ret = None if rng.random() < 0.1 else round(rng.gauss(0.01, 0.08), 6)
            out.append((date, a, None if rng.random() < 0.1 else round(rng.uniform(-1, 1), 1), ret, ret is not None and rng.random() < 0.9, rng.choice([None, 5e3, 2e5, 1e7]), rng.choice([None, 8.0, 12.0, 20.0])))
    return out


def plain(rows, c):
    """One configuration, date by date, on dictionaries."""
    capital, longs, shorts, history, values, out = c.capital, {}, {}, [], [], []
    for date in DAYS:
        now = {r[1]: r[2:] for r in rows if r[0] == date}
        gross = sum(w * (now[a][1] or 0) for a, w in longs.items()) - sum(w * (now[a][1] or 0) for a, w in shorts.items())
        valid = [a for a, r in now.items() if r[2] and r[0] is not None]
        cost = trades = 0
        if len(valid) >= c.longs + c.shorts:
            score = {a: now[a][0] + c.penalty * ((a in longs) - (a in shorts)) for a in valid}
            high, low = sorted(valid, key=lambda a: (-score[a], a))[: c.longs], sorted(valid, key=lambda a: (score[a], a))[: c.shorts]
            scale = 1.0
            if c.target_volatility and len(history) >= 6:
                last = history[-6:]
                vol = math.sqrt(sum((x - sum(last) / 6) ** 2 for x in last) / 5 * 12)
                scale = min(max(c.target_volatility / vol, 0.3), 1.5) if vol >= 0.01 else 1.0
            if c.drawdown_control and len(values) >= 3:
                fall = values[-1] / max(values) - 1
                scale *= 0.25 if fall < -0.25 else 0.5 if fall < -0.2 else 0.8 if fall < -0.1 else 1
            iv = {a: now[a][4] for a in high if now[a][4] is not None} if c.inverse_volatility else {}
            new_longs = {a: x / sum(iv.values()) * c.long_share * scale for a, x in iv.items()} or {a: c.long_share * scale / c.longs for a in high}
            new_shorts = {a: c.short_share * scale / c.shorts for a in low}
            trades = len(new_longs.keys() - longs.keys()) + len(new_shorts.keys() - shorts.keys()) + sum(now[a][2] for a in longs.keys() - new_longs.keys()) + sum(now[a][2] for a in shorts.keys() - new_shorts.keys())
            mean, (fee, spread, sell) = 1.3 / (len(new_longs) + len(new_shorts)), (c.commission / 1e4, c.spread / 1e4, c.sales_fee / 1e4)
            changed = (longs.keys() ^ new_longs.keys()) | (shorts.keys() ^ new_shorts.keys())
            part = [capital * mean / (1e9 if now[a][3] is None else max(now[a][3], 1e4)) for a in changed]
            cost = {
                "fixed": trades * mean * (fee + spread / 2), "tiered": trades * mean * (0.002 if capital * mean < 1e4 else 0.001 if capital * mean < 1e5 else 0.0005), "default": trades * mean * (0.001 + sell / 2),
                "linear": sum((fee + spread / 2 + sell / 2 + c.impact * min(p, 0.5)) * mean for p in part) + sum(new_shorts.values()) * c.borrow / 12e4,
            }.get(c.cost_model, sum((fee + spread / 2 + sell / 2 + c.impact * min(p, 1) ** 0.5) * mean for p in part) + sum(new_shorts.values()) * c.borrow / 12e4)
            longs, shorts = new_longs, new_shorts
        net = gross - cost
        if longs or shorts or net:
            capital *= 1 + net
            history.append(net)
            values.append(capital)
            out.append((date, gross, cost, capital, trades, len(longs), len(shorts)))
    return out


GRID = [
    Config(f"{model} {k}", longs=3 + k, shorts=2, penalty=p, cost_model=model, capital=capital, target_volatility=v, drawdown_control=bool(k), inverse_volatility=model != "fixed")
    for model in ("fixed", "tiered", "linear", "sqrt", "default") for k, (p, capital, v) in enumerate([(0.0, 1e4, 0.0), (0.25, 1e6, 0.1), (1.5, 1e5, 0.3)])
]


def test_replay_is_what_a_plain_loop_gives(spark):
    rows = rows_of(random.Random(4))
    df = spark.createDataFrame(rows, "date date, asset long, signal double, ret double, tradable boolean, adv double, iv double").repartition(5)
    got = {}
    for r in simulation.replay(df, GRID).collect():
        got.setdefault(r["config"], []).append(r)
    for c in GRID:
        mine = sorted(got[c.name], key=lambda r: r["date"])
        want = plain(rows, c)
        assert [(r["date"], r["trades"], r["longs"], r["shorts"]) for r in mine] == [(w[0], *w[4:]) for w in want], c
        for r, w in zip(mine, want, strict=True):
            assert (r["gross"], r["cost"], r["capital"]) == pytest.approx(w[1:4], rel=1e-9, abs=1e-12)
    assert len({tuple(r["trades"] for r in rs) for rs in got.values()}) > 5


def test_replay_by_hand(spark):
    """Two dates: the first only pays, the second earns what the first bought."""
    rows = [(DAYS[0], 1, 0.9, 0.5, True, None, None), (DAYS[0], 2, -0.9, 0.5, True, None, None), (DAYS[1], 1, 0.0, 0.1, True, None, None), (DAYS[1], 2, 0.2, -0.2, True, None, None)]
    df = spark.createDataFrame(rows, "date date, asset long, signal double, ret double, tradable boolean, adv double, iv double")
    c = [Config(p, longs=1, shorts=1, long_share=1.0, short_share=0.5, penalty=x, cost_model="default", sales_fee=0.0) for p, x in (("free", 0.0), ("sticky", 0.15))]
    got = {(r["config"], r["date"]): r for r in simulation.replay(df, c).collect()}
    assert got["free", DAYS[0]]["net"] == pytest.approx(-2 * 0.65 * 0.001) and got["free", DAYS[0]]["gross"] == 0
    assert got["free", DAYS[1]]["gross"] == pytest.approx(0.1 + 0.1) and got["free", DAYS[1]]["trades"] == 4
    assert got["sticky", DAYS[1]]["trades"] == 0 and got["sticky", DAYS[1]]["net"] == pytest.approx(0.2)
    assert got["sticky", DAYS[1]]["capital"] == pytest.approx(10_000 * (1 - 0.0013) * 1.2)


def test_candidates_are_all_that_a_fold_can_pick(spark):
    rows = rows_of(random.Random(9), names=40)
    df = spark.createDataFrame(rows, "date date, asset long, signal double, ret double, tradable boolean, adv double, iv double")
    c = Config("c", longs=2, shorts=2, penalty=0.4)
    dates = simulation.candidates(df.where(f"date < '{DAYS[4]}'"), 4)
    assert max(len(r["names"]) for r in dates.collect()) < 40
    whole = simulation.replay(df, [c, Config("wide", longs=15, shorts=15)]).where("config = 'c'")
    assert sorted(map(str, whole.collect())) == sorted(map(str, simulation.replay(df, [c]).collect()))


def test_edges(spark):
    df = spark.createDataFrame([], "date date, asset long, signal double, ret double, tradable boolean, adv double, iv double")
    assert simulation.replay(df, [Config("a")]).count() == 0
    with pytest.raises(ValueError):
        simulation.replay(df, [Config("a"), Config("a")])
    with pytest.raises(ValueError):
        Config("b", cost_model="none")
