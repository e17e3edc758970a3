"""Weights from covariances: estimators over a trailing window, constrained optima, hierarchical parity, frontiers.

Spark gives each selected name its trailing returns as an array, by a frame of its asset; a group is one date
with its selected names, a matrix of names by rows that numpy works on as a whole.  Nothing is joined with itself, and
no group grows with the number of assets or of dates.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the window, least rows of an estimate, half-life of weights and shrinkage of the exponential estimate.
LOOKBACK, LEAST, HALF_LIFE, SHRINK = 60, 12, 36, 0.1
#: What a name without a known deviation counts with, and what is added to a covariance's diagonal.
USUAL_DEVIATION, RIDGE = 0.05, 1e-8
#: A name's least and largest weight.
BOX = (0.005, 0.10)
COVARIANCES = ("sample", "shrunk", "exponential", "factor")
METHODS = ("min_variance", "max_sharpe", "risk_parity", "max_diversification", "inverse_volatility", "hierarchical")


def trailing(panel: DataFrame, selected: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """selected (date, asset) with past: the asset's returns on the `lookback` dates before, nulls kept, of a dense panel."""
    before = Window.partitionBy("asset").orderBy("date").rowsBetween(-lookback, -1)
    rows = panel.select("date", "asset", F.collect_list(F.struct(F.col("ret").cast("double").alias("r"))).over(before).alias("past"))
    return rows.join(selected.select("date", "asset"), ["date", "asset"]).select("date", "asset", F.transform("past", lambda x: x["r"]).alias("past"))


def covariance(x: np.ndarray, method: str) -> np.ndarray:
    """The covariance of the columns of x, rows in order of time."""
    n, p = x.shape
    s = np.cov(x, rowvar=False).reshape(p, p)
    if method == "shrunk":
        mean = np.trace(s) / p
        d = x - x.mean(axis=0)
        q = (d**2).sum(axis=1)
        # the squared distance of each row's product from s, without a matrix for each row
        noise = float((q**2).sum() - 2 * np.einsum("ti,ij,tj->", d, s, d) + n * (s**2).sum()) / n**2
        spread = (((s - mean * np.eye(p)) ** 2).sum() + mean**2 * p) / n
        weight = min(max(noise / (spread + 1e-10), 0.0), 1.0)
        return (1 - weight) * s + weight * mean * np.eye(p)
    if method == "exponential":
        w = 2.0 ** (-np.arange(n - 1, -1, -1) / HALF_LIFE)
        w /= w.sum()
        d = x - w @ x
        c = (d * w[:, None]).T @ d
        return (1 - SHRINK) * c + SHRINK * np.trace(c) / p * np.eye(p)
    if method == "factor":
        market = x.mean(axis=1)
        var = market.var()
        beta = (x - x.mean(axis=0)).T @ (market - market.mean()) / (n - 1) / (var + 1e-10)
        return np.outer(beta, beta) * var + np.diag((x - np.outer(market, beta)).var(axis=0))
    if method != "sample":
        raise ValueError(f"no covariance {method}")
    return s


def estimate(past: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names with a return, their covariance and mean returns, of names by rows; with too few whole rows, variances alone."""
    known = ~np.isnan(past).all(axis=1)
    x = past[known].T
    whole = x[~np.isnan(x).any(axis=1)]
    mean = np.array([np.nanmean(c) for c in past[known]]) if known.any() else np.zeros(0)
    if len(whole) < max(LEAST, x.shape[1]) or x.shape[1] < 2:
        counts = (~np.isnan(x)).sum(axis=0)
        sd = np.array([np.nanstd(c, ddof=1) if k > 1 else USUAL_DEVIATION for c, k in zip(x.T, counts, strict=True)])
        return np.flatnonzero(known), np.diag(sd**2), mean
    return np.flatnonzero(known), covariance(whole, method) + RIDGE * np.eye(x.shape[1]), whole.mean(axis=0)


def project(w: np.ndarray, total: float, low: float, high: float) -> np.ndarray:
    """The nearest weights within the box that add up to total."""
    # the sum falls along a line between the shifts at which a weight meets an end of the box
    knots = np.sort(np.concatenate([w - high, w - low]))
    sums = np.clip(w - knots[:, None], low, high).sum(axis=1)
    k = int(np.searchsorted(-sums, -total))
    if k in (0, len(knots)):
        shift = knots[min(k, len(knots) - 1)]
    else:
        fall = sums[k - 1] - sums[k]
        shift = knots[k - 1] + (knots[k] - knots[k - 1]) * ((sums[k - 1] - total) / fall if fall > 0 else 0.0)
    return np.clip(w - shift, low, high)


def descend(value: Callable[[np.ndarray], float], slope: Callable[[np.ndarray], np.ndarray], w: np.ndarray, total: float, box: tuple[float, float], rounds: int = 5_000) -> np.ndarray:
    """Projected gradients with steps that halve until the value falls, and grow again, from w; ends when no step helps."""
    now, step = value(w), 1.0
    for _ in range(rounds):
        g, moved = slope(w), False
        while step > 1e-14:
            new = project(w - step * g, total, *box)
            if (v := value(new)) < now - 1e-4 / step * ((new - w) ** 2).sum() and v < now:
                moved = now - v > 1e-15 * max(abs(now), 1e-12)
                w, now, step = new, v, step * 4
                break
            step /= 2
        if not moved:
            break
        step = min(step, 1e8)
    return w


def feasible(n: int, total: float, box: tuple[float, float]) -> bool:
    return n * box[0] <= total + 1e-12 and n * box[1] >= total - 1e-12


def weights(cov: np.ndarray, mean: np.ndarray, method: str, total: float = 1.0, box: tuple[float, float] = BOX) -> np.ndarray:
    """Weights within the box that add up to total; by inverse deviations where the box allows none, for one name, and as the method inverse_volatility."""
    n = len(cov)
    if n < 2:
        return np.full(n, total / max(n, 1))
    sd = np.sqrt(np.diag(cov))
    inverse = 1 / np.maximum(sd, 1e-8)
    start = np.clip(inverse / inverse.sum() * total, *box)
    start *= total / start.sum()
    if method == "hierarchical":
        return total * hierarchical(cov)
    if method == "inverse_volatility" or not feasible(n, total, box):
        return start
    start = project(start, total, *box)
    scale = float(np.mean(sd**2))  # values near one, whatever the returns' unit
    c = cov / scale
    if method == "min_variance":
        return descend(lambda w: float(w @ c @ w), lambda w: 2 * c @ w, start, total, box)
    if method in ("max_sharpe", "max_diversification"):
        m = (mean if method == "max_sharpe" else sd) / np.sqrt(scale)
        ratio = lambda w: -float(w @ m) / np.sqrt(w @ c @ w + 1e-10)
        slope = lambda w: -(m - (w @ m) / (w @ c @ w + 1e-10) * (c @ w)) / np.sqrt(w @ c @ w + 1e-10)
        return descend(ratio, slope, start, total, box)
    if method == "risk_parity":

        def value(w: np.ndarray) -> float:
            return float(((w * (c @ w) / (w @ c @ w) - total / n) ** 2).sum())

        def slope_of(w: np.ndarray) -> np.ndarray:
            v, cw = w @ c @ w, c @ w
            e = 2 * (w * cw / v - total / n)
            return (e * cw + c @ (e * w)) / v - 2 * (e @ (w * cw)) / v**2 * cw

        return descend(value, slope_of, start, total, box)
    raise ValueError(f"no method {method}")


def hierarchical(cov: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity: names in the order of single-linkage clusters, halved again and again, each half weighed by the other's variance."""
    sd = np.sqrt(np.diag(cov))
    far = np.sqrt(np.clip((1 - cov / np.outer(sd, sd)) / 2, 0, 1))
    apart = np.sqrt(((far[:, None, :] - far[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(apart, np.inf)
    members = {i: [i] for i in range(len(cov))}
    while len(members) > 1:
        keys = list(members)
        a, b = min(((i, j) for k, i in enumerate(keys) for j in keys[k + 1 :]), key=lambda ij: (apart[ij], ij))
        apart[a] = apart[:, a] = np.minimum(apart[a], apart[b])
        apart[a, a] = np.inf
        members[a] += members.pop(b)
    order = next(iter(members.values()))
    w = np.ones(len(cov))

    def variance(part: list[int]) -> float:
        inverse = 1 / np.diag(cov)[part]
        inverse /= inverse.sum()
        return float(inverse @ cov[np.ix_(part, part)] @ inverse)

    todo = [order]
    while todo:
        part = todo.pop()
        if len(part) > 1:
            left, right = part[: len(part) // 2], part[len(part) // 2 :]
            a, b = variance(left), variance(right)
            w[left] *= b / (a + b)
            w[right] *= a / (a + b)
            todo += [left, right]
    return w


def frontier(cov: np.ndarray, mean: np.ndarray, points: int, total: float = 1.0, box: tuple[float, float] = BOX) -> list[tuple[float, float, np.ndarray]]:
    """(return, deviation, weights) from the least variance to the largest return: for each of evenly spaced returns, the least variance, found by what a return is worth."""
    low = weights(cov, mean, "min_variance", total, box)
    if len(cov) < 2 or not feasible(len(cov), total, box):
        return [(float(low @ mean), float(np.sqrt(low @ cov @ low)), low)]
    best = project(mean / max(np.abs(mean).max(), 1e-12) * 1e6, total, *box)
    scale = float(np.mean(np.diag(cov)))
    c, m = cov / scale, mean / np.sqrt(scale)

    def solve(worth: float, start: np.ndarray) -> np.ndarray:
        return descend(lambda w: float(w @ c @ w / 2 - worth * w @ m), lambda w: c @ w - worth * m, start, total, box)

    out, worth, w, top = [(float(low @ mean), float(np.sqrt(low @ cov @ low)), low)], 1e-3, low, float(max(best @ mean, low @ mean))
    for target in np.linspace(low @ mean, top, points)[1:-1]:
        a, far = 0.0, solve(worth, w)
        while far @ mean < target and worth < 1e9:
            a, worth = worth, worth * 4
            far = solve(worth, far)
        b, w = worth, far
        for _ in range(30):
            mid = (a + b) / 2
            w = solve(mid, w)
            a, b = (mid, b) if w @ mean < target else (a, mid)
        out.append((float(w @ mean), float(np.sqrt(w @ cov @ w)), w))
    if points > 1:
        out.append((top, float(np.sqrt(best @ cov @ best)), best))
    return out


def _by_date(rows: DataFrame, run: Callable[[str, list, np.ndarray], list[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by("asset")
        past = table["past"].to_pylist()
        longest = max((len(p) for p in past), default=0)
        # arrays end on the date before: shorter ones start later
        x = np.array([[np.nan] * (longest - len(p)) + [np.nan if r is None else r for r in p] for p in past], float).reshape(len(past), longest)
        out = run(table["date"][0].as_py(), table["asset"].to_pylist(), x)
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)

    return rows.groupBy("date").applyInArrow(group, ddl)


def covariances(rows: DataFrame, methods: tuple[str, ...] = COVARIANCES) -> DataFrame:
    """method, date, a, b (a <= b) and cov, of trailing() rows: names without any return are left out."""
    schema = pa.schema([("method", pa.string()), ("date", pa.date32()), ("a", pa.int64()), ("b", pa.int64()), ("cov", pa.float64())])

    def run(date, assets, x):
        out = []
        for method in methods:
            kept, cov, _ = estimate(x, method)
            out += [(method, date, assets[kept[i]], assets[kept[j]], float(cov[i, j])) for i in range(len(kept)) for j in range(i, len(kept))]
        return out

    return _by_date(rows, run, schema, "method string, date date, a long, b long, cov double")


def optimal_weights(rows: DataFrame, methods: tuple[str, ...] = METHODS, cov_method: str = "shrunk", total: float = 1.0, box: tuple[float, float] = BOX) -> DataFrame:
    """method, date, asset and weight of trailing() rows."""
    schema = pa.schema([("method", pa.string()), ("date", pa.date32()), ("asset", pa.int64()), ("weight", pa.float64())])

    def run(date, assets, x):
        kept, cov, mean = estimate(x, cov_method)
        return [(method, date, assets[k], float(w)) for method in methods for k, w in zip(kept, weights(cov, mean, method, total, box), strict=True)]

    return _by_date(rows, run, schema, "method string, date date, asset long, weight double")


def compare_methods(rows: DataFrame, methods: tuple[str, ...] = METHODS, cov_method: str = "shrunk", total: float = 1.0, box: tuple[float, float] = BOX) -> DataFrame:
    """method, date, the mean return and deviation of its weights, their ratio, the number of names that would do as well alone, and the largest share of risk."""
    schema = pa.schema([("method", pa.string()), ("date", pa.date32()), *[(c, pa.float64()) for c in ("mean", "deviation", "ratio", "effective", "largest_risk")]])

    def run(date, assets, x):
        kept, cov, mean = estimate(x, cov_method)
        out = []
        for method in methods if len(kept) else ():
            w = weights(cov, mean, method, total, box)
            sd = float(np.sqrt(w @ cov @ w))
            out.append((method, date, float(w @ mean), sd, float(w @ mean) / sd if sd > 0 else None, float(w.sum() ** 2 / (w**2).sum()), float((w * (cov @ w)).max() / sd**2) if sd > 0 else None))
        return out

    return _by_date(rows, run, schema, "method string, date date, mean double, deviation double, ratio double, effective double, largest_risk double")


def efficient_frontier(rows: DataFrame, points: int = 10, cov_method: str = "shrunk", total: float = 1.0, box: tuple[float, float] = BOX) -> DataFrame:
    """date, point (from 1), mean and deviation along the frontier of trailing() rows."""
    schema = pa.schema([("date", pa.date32()), ("point", pa.int32()), ("mean", pa.float64()), ("deviation", pa.float64())])

    def run(date, assets, x):
        kept, cov, mean = estimate(x, cov_method)
        return [(date, k + 1, m, s) for k, (m, s, _) in enumerate(frontier(cov, mean, points, total, box))] if len(kept) else []

    return _by_date(rows, run, schema, "date date, point int, mean double, deviation double")


def covariances_sql(panel: str, selected: str, lookback: int = LOOKBACK) -> str:
    """DuckDB: sums over pairs of names, for dates whose windows are long enough."""
    return f"""with c as (select date, row_number() over (order by date) as k from (select distinct date from ({panel}))), x as (select c.k, asset, ret from ({panel}) join c using (date)),
    s as (select date, c.k, asset, count(*) over (partition by date) as p from ({selected}) join c using (date)),
    r as (select s.date, s.k, s.p, s.asset, x.k as t, x.ret from s join x on x.asset = s.asset and x.k between s.k - {lookback} and s.k - 1 where x.ret is not null),
    f as (select date, t, avg(ret) as m from r group by date, t having count(*) = any_value(p)), h as (select r.*, f.m, count(distinct t) over (partition by date) as n, dense_rank() over (partition by date order by t desc) - 1 as age from r join f using (date, t)),
    g as (select *, power(2, -age / {HALF_LIFE}) as w, ret - avg(ret) over (partition by date, asset) as d, ret - sum(ret * power(2, -age / {HALF_LIFE})) over (partition by date, asset) / sum(power(2, -age / {HALF_LIFE})) over (partition by date, asset) as e from h where n >= {LEAST} and n >= p),
    pairs as (select a.date, a.asset as a, b.asset as b, any_value(a.n) as n, any_value(a.p) as p, sum(a.d * b.d) / (any_value(a.n) - 1) as s, sum(a.w * a.e * b.e) / sum(a.w) as ex from g a join g b on a.date = b.date and a.t = b.t group by 1, 2, 3),
    marks as (select date, any_value(n) as n, sum(s) filter (a = b) / any_value(p) as mu, sum(ex) filter (a = b) / any_value(p) as mx, sum(s * s) as ss from pairs group by 1),
    noise as (select u.date, sum((u.d * v.d - q.s) ** 2) / any_value(u.n) ** 2 as gamma from g u join g v on u.date = v.date and u.t = v.t join pairs q on q.date = u.date and q.a = u.asset and q.b = v.asset group by 1),
    shrink as (select m.date, mu, mx, least(greatest(gamma / (ss / n + 1e-10), 0), 1) as z from marks m join noise using (date)),
    beta as (select date, asset, covar_samp(ret, m) / (var_pop(m) + 1e-10) as beta, var_pop(m) as v from g group by 1, 2), own as (select g.date, g.asset, var_pop(ret - beta * m) as o from g join beta using (date, asset) group by 1, 2)
    select method, date, a, b, cov + case when a = b then {RIDGE} else 0 end as cov from (
      select 'sample' as method, date, a, b, s as cov from pairs union all
      select 'shrunk', date, a, b, (1 - z) * s + case when a = b then z * mu else 0 end from pairs join shrink using (date) union all
      select 'exponential', date, a, b, {1 - SHRINK} * ex + case when a = b then {SHRINK} * mx else 0 end from pairs join shrink using (date) union all
      select 'factor', q.date, a, b, x.beta * y.beta * x.v + case when a = b then o else 0 end from pairs q join beta x on x.date = q.date and x.asset = a join beta y on y.date = q.date and y.asset = b left join own on own.date = q.date and own.asset = a) where a <= b"""
