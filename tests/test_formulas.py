"""Factors against numpy on whole matrices of dates by assets: nothing is shared with the expressions that Spark runs."""

import numpy as np
import pytest

from quantloom.operators import factors, formulas

T, A = 90, 12


def lag(x, n=1):
    out = np.full_like(x, np.nan)
    if n < len(x):
        out[n:] = x[:-n] if n else x
    return out


def roll(f, n, *xs, least=None):
    """f of the last n rows' whole values, for each cell; nan with fewer than least (all n by default)."""
    out = np.full(xs[0].shape, np.nan)
    for t in range(len(out)):
        for a in range(out.shape[1]):
            v = np.stack([x[max(0, t - n + 1) : t + 1, a] for x in xs])
            v = v[:, ~np.isnan(v).any(axis=0)]
            if v.shape[1] >= (least or n):
                out[t, a] = f(*v)
    return out


def mean(x, n, least=None):
    return roll(np.mean, n, x, least=least)


def total(x, n, least=None):
    return roll(np.sum, n, x, least=least)


def sd(x, n, least=None):
    return roll(lambda v: np.std(v, ddof=1), n, x, least=least)


def corr(x, y, n, least=None):
    return roll(lambda a, b: np.corrcoef(a, b)[0, 1] if np.ptp(a) and np.ptp(b) else np.nan, n, x, y, least=least)


def grown(r, n, skip):
    return roll(lambda v: np.prod(1 + v) - 1, n, lag(r, skip) if skip else r)


def where_known(x, value):
    return np.where(np.isnan(x), np.nan, value)


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(4)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, (T, A)), axis=0))
    high, low = close * (1 + rng.random((T, A)) * 0.02), close * (1 - rng.random((T, A)) * 0.02)
    p = {"open_": low + rng.random((T, A)) * (high - low), "high": high, "low": low, "close": close, "volume": rng.integers(50, 500, (T, A)).astype(float), "vwap": low + rng.random((T, A)) * (high - low), "trade_count": rng.integers(1, 20, (T, A)).astype(float)}
    holes = rng.random((T, A)) < 0.03
    holes[:, 0] = False
    p = {k: np.where(holes, np.nan, v) for k, v in p.items()}
    price = p["close"].copy()
    for t in range(1, T):
        price[t] = np.where(np.isnan(price[t]), price[t - 1], price[t])
    p["price"], p["ret"] = price, price / lag(price) - 1
    p["ret"][40, 3] = -1.0  # a total loss
    p["mkt"] = np.repeat(np.nanmean(p["ret"], axis=1, keepdims=True), A, axis=1) if T else None
    return p


@pytest.fixture(scope="module")
def panel(spark, cells):
    import pandas as pd

    days = pd.date_range("2020-01-01", periods=T)
    frame = pd.DataFrame({"asset": np.tile(np.arange(A), T), "date": np.repeat(days.date, A), **{k: v.ravel() for k, v in cells.items()}})
    df = spark.createDataFrame(frame)
    return df.selectExpr("asset", "cast(date as date) as date", *[f"nullif({c}, double('nan')) as {c}" for c in cells]).cache()


def expected(p):
    c, o, h, lo, v, vw, r, m, price = (p[k] for k in ("close", "open_", "high", "low", "volume", "vwap", "ret", "mkt", "price"))
    place = (c - lo) / (h - lo)
    log = np.log(h / lo)
    gk = mean(0.5 * log**2 - (2 * np.log(2) - 1) * np.log(c / o) ** 2, 20)
    near = np.abs(c % 1 - np.round(c % 1 * 2) / 2) < 0.02
    return {
        "momentum_12_1": grown(r, 12, 1), "momentum_acceleration": grown(r, 3, 1) - grown(r, 3, 4), "multi_timeframe_momentum": sum(w * grown(r, n, 1) for w, n in ((0.25, 12), (0.35, 6), (0.4, 3))) / sd(lag(r), 12),
        "high_52_week": lag(c / roll(np.max, 12, c)), "volatility_12m": sd(lag(r), 12) * np.sqrt(12), "vol_of_vol_12m": sd(sd(lag(r), 12), 12), "downside_vol": sd(lag(where_known(r, np.minimum(r, 0))), 12) * np.sqrt(12),
        "max_return_12m": roll(np.max, 12, lag(r)), "vol_term_structure": sd(lag(r), 3) / sd(lag(r), 12), "vol_momentum": sd(lag(r), 12) / lag(sd(lag(r), 12), 3) - 1,
        "momentum_5d": c / lag(c, 5) - 1, "momentum_20d": c / lag(c, 20) - 1, "momentum_reversal_5d": -total(r, 5), "volume_surge": v / mean(v, 20), "dollar_volume_rank": v * c, "volume_price_trend": total(np.sign(c - lag(c)) * v, 20),
        "vwap_deviation": c / vw - 1, "vwap_reversion": -total(c / vw - 1, 5), "realized_vol_20d": -sd(r, 20, 15) * np.sqrt(252), "vol_breakout": np.abs(r) / mean(np.abs(r), 20), "vol_breakout_hl": (h - lo) / c / mean((h - lo) / c, 20),
        "overnight_gap": o / lag(c) - 1, "amihud_illiquidity": -mean(np.abs(r) / (v * c), 20, 10), "trade_intensity": v / p["trade_count"], "high_low_spread": -(h - lo) / c, "order_flow_imbalance": total(v * (2 * np.clip(place, 0, 1) - 1), 10),
        "realized_spread": mean((2 * c - h - lo) / c, 20), "overnight_return": total(o / lag(c) - 1, 20), "intraday_return": total(c / o - 1, 20), "overnight_intraday_divergence": total(o / lag(c) - c / o, 20), "price_volume_correlation": corr(r, v, 20),
        "volume_autocorrelation": corr(v, lag(v), 20), "abnormal_volume_return": total(where_known(r, np.where(v > 2 * mean(v, 20), r, 0)), 20), "garman_klass_vol": -np.sqrt(np.where(gk >= 0, gk, np.nan)), "parkinson_vol": -np.sqrt(mean(log**2, 20) / (4 * np.log(2))),
        "tick_size_clustering": -mean(np.where(np.isnan(c), 0, near).astype(float), 20), "vol_of_vol": -sd(sd(r, 10), 60), "range_expansion": (h - lo) / mean(h - lo, 20) * (2 * place - 1), "relative_strength_vs_market": total(r - m, 20),
        "higher_highs": total(np.where(h > lag(h), 1.0, 0.0), 20, 10), "lower_lows": -total(np.where(lo < lag(lo), 1.0, 0.0), 20, 10), "price_acceleration": price / lag(price, 5) - 1 - (price / lag(price, 20) - 1) / 4,
        "support_distance": -(c - roll(np.min, 60, lo, least=30)) / c, "resistance_distance": -(roll(np.max, 60, h, least=30) - c) / c, "candlestick_body": np.abs(c - o) / (h - lo), "autocorrelation": corr(r, lag(r), 20, 10),
        "variance_ratio": sd(total(r, 20, 10), 20, 10) ** 2 / (sd(r, 5, 2) ** 2 * 4) - 1, "co_movement": -corr(r, m, 20, 10), "max_return": -roll(np.max, 20, r, least=10), "liquidity_shock": mean(v * c, 5, 2) / mean(v * c, 60, 30),
        "frog_in_pan": np.sign(total(r, 60, 30)) * (mean(where_known(r, (r > 0).astype(float)), 60, 30) - mean(where_known(r, (r < 0).astype(float)), 60, 30)), "correlation_regime": -corr(r, m, 60, 30),
    }


def test_factors_are_what_numpy_says(panel, cells):
    every = factors.MONTHLY | factors.DAILY | factors.ALPHA
    with np.errstate(all="ignore"):
        want = expected(cells)
    got = {n: np.full((T, A), np.nan) for n in want}
    first = panel.agg({"date": "min"}).first()[0]
    for row in factors.compute_all(panel, {n: every[n] for n in want}).select("factor", "asset", "date", "value").collect():
        got[row["factor"]][(row["date"] - first).days, row["asset"]] = np.nan if row["value"] is None else row["value"]
    for name, x in want.items():
        x = np.where(np.isfinite(x), x, np.nan)
        unlike = ~(np.isclose(got[name], x, rtol=1e-6, atol=2e-9) | (np.isnan(got[name]) & np.isnan(x)))
        assert not unlike.any(), (name, np.argwhere(unlike)[:3], got[name][unlike][:3], x[unlike][:3])
        assert np.isfinite(x).sum() > 50, name


def test_total_loss_ends_in_total_loss(panel):
    got = factors.compute(panel, factors.MONTHLY["momentum_12_1"]).where("asset = 3 and date = date '2020-02-20'").first()
    assert got["value"] == -1.0


def test_ranks_in_frames(spark):
    from quantloom.functions.arrays import decay_linear, signed_power, ts_argmax, ts_rank
    from pyspark.sql import functions as F

    x = [3.0, 1.0, 3.0, None, 2.0, 5.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "asset int, date int, x double")
    got = df.select("date", ts_rank("x", 3).alias("r"), ts_argmax("x", 3).alias("a"), decay_linear("x", 3).alias("d"), signed_power(-F.col("x"), 2.0).alias("p")).orderBy("date").collect()
    assert got[2]["r"] == pytest.approx(2.5 / 3) and got[2]["a"] == 0.0 and got[2]["d"] == pytest.approx((3 + 2 + 9) / 6) and got[2]["p"] == -9.0
    assert got[1]["r"] is None and got[3]["r"] is None and got[5]["r"] is None


def test_shapes_of_frames(panel, cells):
    r, first = cells["ret"], panel.agg({"date": "min"}).first()[0]
    at = lambda rows, t, a: next(x["value"] for x in rows if x["asset"] == a and (x["date"] - first).days == t)
    v = r[29:49, 0]
    counts = np.histogram(v, 10)[0] / 20
    assert at(formulas.entropy(panel).collect(), 49, 0) == pytest.approx(sum(p * np.log2(p) for p in counts if p), abs=1e-8)
    v = r[10:70, 0]
    assert at(formulas.tail_mean(panel).collect(), 70, 0) == pytest.approx(v[v <= np.quantile(v, 0.05)].mean(), abs=1e-8)
    price, volume = cells["close"][60:80, 0], cells["volume"][60:80, 0]
    place = lambda x: np.array([(x < y).sum() + ((x == y).sum() + 1) / 2 for y in x])
    rho = np.corrcoef(place(price), place(volume))[0, 1]
    assert at(formulas.volume_price_divergence(panel).collect(), 79, 0) == pytest.approx(-rho if cells["close"][79, 0] < cells["close"][59, 0] else rho, abs=1e-8)
