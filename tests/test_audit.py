"""The audit of factors, recursions, anomalies and implied volatilities against numpy, math and plain loops."""

import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import normal
from quantloom.functions.recursion import ewm, wilder
from quantloom.operators import anomaly, audit, significance, signals

DAY = datetime.date(2020, 1, 1)


def day(k):
    return DAY + datetime.timedelta(days=k)


def test_normal_distribution(spark):
    xs = [-40.0, -9.0, -7.1, -6.0, -3.3, -1.0, -1e-9, 0.0, 0.5, 2.0, 5.9, 7.2, 30.0, 50.0]
    df = spark.createDataFrame([(x,) for x in [*xs, None]], "x double")
    got = {r["x"]: (r["c"], r["t"]) for r in df.selectExpr("x", f"{normal.normal_cdf('x')} as c", f"{normal.two_sided('x')} as t").collect()}
    assert got[None] == (None, None)
    for x in xs:
        assert got[x][0] == pytest.approx(math.erfc(-x / math.sqrt(2)) / 2, rel=1e-9 if abs(x) < 7 else 1e-7, abs=1e-300)
        assert got[x][1] == pytest.approx(math.erfc(abs(x) / math.sqrt(2)), rel=1e-9 if abs(x) < 7 else 1e-7, abs=1e-300)
    for q in (0.1, 1.0, 5.0, 11.07, 40.0):
        # the chi-square tail of five degrees of freedom, by adding up its density
        t = np.linspace(q, q + 200, 2_000_001)
        want = np.trapezoid(t**1.5 * np.exp(-t / 2), t) / (2**2.5 * math.gamma(2.5))
        assert spark.sql(f"select {audit.ljung_box_p(f'{q}D')} as p").first()["p"] == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("alpha", [0.9, 0.3, 2 / 11, 0.01])
def test_exponential_averages(spark, alpha):
    rng = random.Random(3)
    rows = [(a, k, None if (k < 3 and a) or rng.random() < 0.1 * a else rng.gauss(5, 2)) for a in range(2) for k in range(1500 if a == 0 else 90)]
    df = spark.createDataFrame(rows, "asset long, date long, x double").repartition(3)
    both = ewm(ewm(df, F.col("x"), alpha, "plain"), F.col("x"), alpha, "even", adjust=True).toPandas().sort_values(["asset", "date"])
    for _, part in both.groupby("asset"):
        for name, adjust in (("plain", False), ("even", True)):
            want = part["x"].astype(float).ewm(alpha=alpha, adjust=adjust, ignore_na=True).mean()
            assert np.allclose(part[name].astype(float), want, rtol=1e-9, equal_nan=True), (name, alpha)
    assert ewm(df.limit(0), F.col("x"), alpha, "y").count() == 0


def test_wilder_averages(spark):
    rng = random.Random(4)
    x = [None, None, *[rng.uniform(0, 3) for _ in range(60)]]
    got = wilder(spark.createDataFrame([(1, k, v) for k, v in enumerate(x)], "asset long, date long, x double"), F.col("x"), 14, "y").orderBy("date").collect()
    mean = sum(x[2:16]) / 14
    want = [None] * 15 + [mean]
    for v in x[16:]:
        mean = (mean * 13 + v) / 14
        want.append(mean)
    assert [r["y"] for r in got] == [w if w is None else pytest.approx(w, rel=1e-12) for w in want]


def test_variance_inflation(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4)) * [1, 100, 0.01, 1] + [0, 1e6, 5, 0]
    x[:, 3] = 0.8 * x[:, 0] + 0.3 * rng.normal(size=400)
    frame = pd.DataFrame(x, columns=list("abcd"))
    df = spark.createDataFrame(frame).unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double"))
    got = {r["factor"]: (r["vif"], r["concern"]) for r in audit.vif(df, list("abcd")).collect()}
    for i, c in enumerate("abcd"):
        rest = np.column_stack([np.ones(400), np.delete(x, i, axis=1)])
        resid = x[:, i] - rest @ np.linalg.lstsq(rest, x[:, i], rcond=None)[0]
        assert got[c][0] == pytest.approx(((x[:, i] - x[:, i].mean()) ** 2).sum() / (resid**2).sum(), rel=1e-6)
    assert got["a"][1] == ("warning" if 5 < got["a"][0] <= 10 else "severe" if got["a"][0] > 10 else "ok")
    assert {r["concern"] for r in audit.vif(df.limit(3), list("abcd")).collect()} == {"insufficient"}
    twice = df.withColumn("e", F.col("a") * 2 + 1)
    assert all(math.isinf(r["vif"]) for r in audit.vif(twice, ["a", "e"]).collect())


def test_walk_forward_keeps_whole_folds_only(spark):
    dates = spark.createDataFrame([(day(k),) for k in range(80)], "date date")
    got = significance.walk_forward(dates, 36, 12, 12, False).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("date").alias("first")).collect()
    assert {(r["fold"], r["role"]): (r["n"], r["first"]) for r in got} == {(k, role): (36 if role == "train" else 12, day(12 * k + (36 if role == "test" else 0))) for k in range(3) for role in ("train", "test")}
    assert significance.walk_forward(dates.limit(40), 36, 12, 12, False).count() == 0


def test_newey_west_by_hand(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0.02, 0.1, 50)
    got = significance.newey_west(spark.createDataFrame([("f", day(k), float(v)) for k, v in enumerate(x)] + [("g", day(0), 0.1)], "factor string, date date, ic double")).orderBy("factor").collect()
    e, m = x - x.mean(), 3
    s = e @ e + 2 * sum((1 - k / (m + 1)) * (e[k:] @ e[:-k]) for k in range(1, m + 1))
    assert got[0]["t_adjusted"] == pytest.approx(x.mean() / (math.sqrt(s) / 50)) and got[0]["lags"] == m and got[1]["t_adjusted"] is None


def test_cumulative_sums(spark):
    rng = random.Random(6)
    x = [rng.gauss(0, 1) for _ in range(60)] + [rng.gauss(2.5, 1) for _ in range(60)]
    x[30] = None
    df = spark.createDataFrame([("s", m, day(k), v if v is None else v * s) for m, s in (("a", 1.0), ("b", 0.1)) for k, v in enumerate(x)] + [("s", "flat", day(k), 1.0) for k in range(40)], "strategy string, metric string, date date, x double")
    rows = anomaly.cusum(df.repartition(4), 20).collect()
    for metric, scale in (("a", 1.0), ("b", 0.1)):
        mine = sorted((r for r in rows if r["metric"] == metric), key=lambda r: r["date"])
        up = down = 0.0
        for k, r in enumerate(mine):
            window = [v * scale for v in x[max(0, k - 19) : k + 1] if v is not None]
            past = [v * scale for v in x[max(0, k - 19) : k] if v is not None]
            alarm = None
            if k >= 19 and len(window) >= 10:
                if x[k] is not None:
                    z = (x[k] * scale - np.mean(past)) / np.std(past)
                    up, down = max(0, up + z - 0.5), max(0, down - z - 0.5)
                if max(up, down) > 4 * np.std(window):
                    alarm = ("critical" if max(up, down) > 6 * np.std(window) else "warning") + (" up" if up > down else " down")
            assert (r["up"], r["down"], r["alarm"]) == (pytest.approx(up), pytest.approx(down), alarm), k
            if alarm:
                up = down = 0.0
        assert any(r["alarm"] for r in mine)
    assert all(r["alarm"] is None and r["z"] is None for r in rows if r["metric"] == "flat")
    first = anomaly.alerts(anomaly.cusum(df, 20)).collect()
    assert [r["severity"] for r in first] == sorted(r["severity"] for r in first)


def test_isolation_forest(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 3))
    x[:30] += rng.choice([-1, 1], size=(30, 3)) * 7
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(3000, None, 1.0, 1.0)], "id long, a double, b double, c double").repartition(6)
    got = {r["id"]: r["isolation"] for r in anomaly.isolation_forest(df, list("abc")).collect()}
    assert got.pop(3000) is None and got == {r["id"]: r["isolation"] for r in anomaly.isolation_forest(df.repartition(2), list("abc")).where("id < 3000").collect()}
    worst = sorted(got, key=got.get)[:30]
    assert sum(i < 30 for i in worst) >= 28 and 0.03 < sum(v < 0 for v in got.values()) / 3000 < 0.07
    # a tree's path by walking it
    forest = anomaly.Forest(x, trees=5, rows=64)
    for row in x[:20]:
        z, total = (row - forest.mean) / forest.spread, 0.0
        for feature, cut, left, length in forest.trees:
            node = 0
            while feature[node] >= 0:
                node = left[node] + (z[feature[node]] > cut[node])
            total += length[node]
        assert forest.score(row[None])[0] == pytest.approx(2 ** (-total / 5 / anomaly.usual_length(64)))
    small = anomaly.isolation_forest(df.limit(10), list("abc"))
    assert small.where("isolation is not null").count() == 0
    assert anomaly.usual_length(256) == pytest.approx(10.244770920116851)


def test_implied_volatility_round_trip(spark):
    rows = []
    for kind in ("call", "put"):
        for strike in (70.0, 100.0, 140.0):
            for dte in (5, 90, 700):
                for sigma in (0.15, 0.6, 2.0):
                    y = dte / 365
                    d1 = (math.log(100 / strike) + (0.05 + sigma**2 / 2) * y) / (sigma * math.sqrt(y))
                    cdf = lambda v: math.erfc(-v / math.sqrt(2)) / 2
                    price = 100 * cdf(d1) - strike * math.exp(-0.05 * y) * cdf(d1 - sigma * math.sqrt(y))
                    price += 0 if kind == "call" else strike * math.exp(-0.05 * y) - 100
                    if price > 1e-4 + max(0, (100 - strike * math.exp(-0.05 * y)) * (1 if kind == "call" else -1)):
                        rows.append((kind, price, 100.0, strike, dte, sigma))
    df = spark.createDataFrame([*rows, ("call", None, 100.0, 100.0, 30, None), ("call", 1.0, 100.0, 100.0, 0, None), ("call", 99.99, 100.0, 100.0, 30, None)], "kind string, mid double, spot double, strike double, dte int, sigma double")
    got = signals.implied_vol(df).collect()
    assert len(rows) > 40
    for r in got:
        if r["sigma"] is not None:
            assert r["iv"] == pytest.approx(r["sigma"], rel=1e-5)
    rest = [r["iv"] for r in got if r["sigma"] is None]
    assert rest[0] is None and rest[1] is None and rest[2] is None  # no price, no days, beyond both ways


def test_brackets_are_halved_by_all_tasks(spark):
    quotes = spark.range(0, 400, 1, 1).selectExpr("if(id % 2 = 0, 'call', 'put') as kind", "90e0 + id % 30 as strike", "100e0 as spot", "cast(if(id % 50 = 49, null, 20 + id) as int) as dte", "if(id % 40 = 39, null, 4e0 + id % 9) as mid")
    out = signals.implied_vol(quotes)
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # one part before
    plan = out.where("iv is not null")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Filter isnotnull(iv" in plan  # a filter does not halve again
    for r in out.collect():
        if r["mid"] is None or r["dte"] is None:
            assert r["iv"] is None
        elif r["iv"] is not None and 0.011 < r["iv"] < 4.99:
            y, v = r["dte"] / 365, r["iv"]
            d1 = (math.log(r["spot"] / r["strike"]) + (0.05 + v * v / 2) * y) / (v * math.sqrt(y))
            cdf = lambda z: math.erfc(-z / math.sqrt(2)) / 2
            call = r["spot"] * cdf(d1) - r["strike"] * math.exp(-0.05 * y) * cdf(d1 - v * math.sqrt(y))
            price = call if r["kind"] == "call" else call + r["strike"] * math.exp(-0.05 * y) - r["spot"]
            assert price == pytest.approx(r["mid"], abs=1e-9) or v == pytest.approx(r["mid"] / (0.4 * 100 * math.sqrt(y)))


def test_capacity_is_a_median_of_medians(spark):
    rng = random.Random(2)
    rows = [(day(k), a, rng.uniform(-1, 1), None if a % 7 == 0 else rng.uniform(1e4, 1e6)) for k in range(30) for a in range(30 if k else 4)]
    got = audit.capacity(spark.createDataFrame(rows, "date date, asset long, signal double, adv double"), 4, 3).collect()
    medians = []
    for k in range(6, 30):
        mine = sorted((r for r in rows if r[0] == day(k)), key=lambda r: (-r[2], r[1]))
        medians.append(np.median([r[3] for r in mine[:4] + mine[-3:] if r[3] is not None]))
    assert got[0]["median_adv"] == pytest.approx(np.median(medians)) and got[0]["most"] == pytest.approx(0.1 * np.median(medians) * 7 / 1.3)
    assert [r["level"] for r in got] == list(audit.LEVELS)


def test_combinations_join_returns_once(spark):
    rng = np.random.default_rng(8)
    x = pd.DataFrame({"date": np.repeat(np.arange(3), 30), "asset": np.tile(np.arange(30), 3), "fwd": rng.normal(size=90), "a": rng.normal(size=90), "b": rng.normal(size=90)})
    x.loc[rng.random(90) < 0.2, "b"] = np.nan
    tall = x.melt(["date", "asset"], ["a", "b"], "factor", "signal").astype({"signal": object})
    tall["signal"] = tall["signal"].where(tall["signal"].notna(), None)
    df = spark.createDataFrame(tall, "date long, asset long, factor string, signal double")
    forward = spark.createDataFrame(x[["date", "asset", "fwd"]])
    combos = {"b": ("b",), "a+b": ("a", "b")}
    out = significance.best_combinations(df, forward, combos)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and plan.index("Join") > plan.index("Generate explode")  # the join lies below the copies
    got = {r["factor"]: (r["mean_ic"], r["dates"]) for r in out.collect()}
    for name, members in combos.items():
        x["m"] = x[list(members)].mean(axis=1).round(6)
        ics = [round(p["m"].rank().corr(p["fwd"][p["m"].notna()].rank()), 6) for _, p in x.groupby("date") if p["m"].notna().sum() >= 20]
        assert got[name] == (pytest.approx(sum(ics) / len(ics), abs=2e-7), len(ics))
    half = significance.best_combinations(df, forward, {"b": ("b", "missing")}).first()
    assert half["mean_ic"] == got["b"][0]
