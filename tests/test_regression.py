"""Fits against numpy's least squares."""

import datetime as dt

import numpy as np
import pytest

from quantloom.operators import regression


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(9)
    rows = []
    for a in range(3):
        x = rng.normal(0, 0.05, (50, 3))
        y = 0.01 * a + x @ np.array([1.0, -0.5, 0.25]) + rng.normal(0, 0.02, 50)
        for t in range(50):
            rows.append((a, dt.date(2020, 1, 1) + dt.timedelta(t), None if (a + t) % 11 == 0 else float(y[t]), *map(float, x[t])))
    return rows, spark.createDataFrame(rows, "asset int, date date, excess double, a double, b double, c double")


def lstsq(rows):
    known = [r for r in rows if r[2] is not None]
    x, y = np.array([[1, *r[3:]] for r in known]), np.array([r[2] for r in known])
    coef = np.linalg.lstsq(x, y, rcond=None)[0]
    return coef, y - x @ coef, y


def test_groups(table):
    rows, df = table
    for r in regression.fit(df, ["asset"], "excess", ["a", "b", "c"]).collect():
        coef, rest, y = lstsq([x for x in rows if x[0] == r["asset"]])
        assert r["coefs"] == pytest.approx(coef, abs=1e-10) and r["r2"] == pytest.approx(1 - (rest @ rest) / ((y - y.mean()) @ (y - y.mean())))
    got = regression.attribution(df.withColumnRenamed("asset", "strategy"), ["a", "b", "c"]).where("strategy = 1").first()
    coef, _, _ = lstsq([x for x in rows if x[0] == 1])
    assert (got["alpha"], got["beta_a"], got["beta_c"]) == pytest.approx((12 * coef[0], coef[1], coef[3]))
    left = {(r["asset"], r["date"]): r["residual"] for r in regression.orthogonalize(df, ["asset"], "excess", ["a", "b", "c"]).collect()}
    _, rest, _ = lstsq([x for x in rows if x[0] == 2])
    assert [left[2, x[1]] for x in rows if x[0] == 2 and x[2] is not None] == pytest.approx(rest)
    assert regression.fit(df.limit(0), ["asset"], "excess", ["a"]).count() == 0


def test_frames(table):
    rows, df = table
    vol = {(r["asset"], r["date"]): r["value"] for r in regression.idiosyncratic_vol(df, ["a", "b", "c"], 20).collect()}
    alpha = {(r["asset"], r["date"]): r["value"] for r in regression.alpha(df, ["a", "b", "c"], 20).collect()}
    mine = [x for x in rows if x[0] == 1]
    for t in (19, 20, 33, 49):
        coef, rest, y = lstsq(mine[max(0, t - 20) : t])
        if t < 20:
            assert vol[1, mine[t][1]] is None
        else:
            assert vol[1, mine[t][1]] == pytest.approx(np.sqrt(rest @ rest / len(y)) * np.sqrt(12)) and alpha[1, mine[t][1]] == pytest.approx(coef[0] * 12)


def test_columns_that_say_the_same(spark):
    df = spark.createDataFrame([(1, float(i), float(i), 2.0 * i) for i in range(5)], "k int, y double, a double, b double")
    got = regression.fit(df, ["k"], "y", ["a", "b"]).first()
    assert got["r2"] == pytest.approx(1.0) and got["coefs"][1] + 2 * got["coefs"][2] == pytest.approx(1.0)
