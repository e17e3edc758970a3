"""Sleeves: small strategies over the prices of a few funds, their combination, and strategies over coins with a vector backtest.

Prices are tall: (date, ticker, price).  A sleeve table has a row for each date, so that its frames run over one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .performance import GROWTH

#: Funds that the sleeves need, and those that join the last one where they are there.
FUNDS, MORE = ("SPY", "GLD", "TLT", "SHY"), ("EEM", "VNQ")
SLEEVES = ("safe_haven", "dual_mom_gld", "dual_mom_spy", "reversal_tlt", "corr_regime", "vol_regime_gld", "curve_rot", "xasset_mom", "overnight", "coin_xmom")


def _rows(n: int, lag: int = 0):
    return Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(1 - n - lag, -lag)  # a row for each date


def _lag(x: Column | str, n: int = 1) -> Column:
    return F.lag(x, n).over(Window.partitionBy(F.lit(0)).orderBy("date"))


def _whole(x: str, n: int, agg) -> Column:
    """An aggregate of n rows that all have a value."""
    return F.when(F.count(x).over(_rows(n)) >= n, agg(x).over(_rows(n)))


def _quantile(x: str, n: int, share: float) -> Column:
    """The quantile of n rows that all have a value, between neighbours where it falls between two."""
    held = F.sort_array(F.collect_list(x).over(_rows(n)))  # n numbers for each row
    at = (n - 1) * share
    low, part = int(at), at - int(at)
    value = F.element_at(held, low + 1) if part == 0 else F.element_at(held, low + 1) * (1 - part) + F.element_at(held, low + 2) * part
    return F.when(F.size(held) >= n, value)


def sleeves(prices: DataFrame, opens: DataFrame | None = None, coins: tuple[str, ...] = (), year: int = 252) -> DataFrame:
    """date and the return of each sleeve, null where it has none, of prices of FUNDS, MORE and coins; opens: (date, open_) of SPY.

    A position is taken on the row after its signal.  Rows are periods, `year` of them a year.
    """
    tickers = [*FUNDS, *MORE, *coins]
    wide = prices.groupBy("date").pivot("ticker", tickers).agg(F.first("price"))
    wide = wide.select("date", *[F.col(f"`{t}`").alias(t) for t in tickers])
    if opens is not None:
        wide = wide.join(opens, "date", "left")
    else:
        wide = wide.withColumn("open_", F.lit(None).cast("double"))
    t = wide.select("*", *[(F.try_divide(F.col(f"`{k}`"), _lag(f"`{k}`")) - 1).alias(f"r_{k}") for k in tickers], *[(F.try_divide(F.col(f"`{k}`"), _lag(f"`{k}`", n)) - 1).alias(f"m{n}_{k}") for k, n in [("GLD", 120), ("SHY", 120), *[(k, 60) for k in (*FUNDS, *MORE)], *[(k, 20) for k in coins]]])
    root = F.sqrt(F.lit(float(year)))
    t = t.withColumn("stress", F.round(_whole("r_SPY", 20, F.stddev_samp) * root, 9)).withColumn("r5", F.round(_whole("r_TLT", 5, F.sum), 9)).withColumn("corr", F.when(F.count(F.col("r_SPY") * F.col("r_TLT")).over(_rows(60)) >= 60, F.round(F.corr("r_SPY", "r_TLT").over(_rows(60)), 9)))
    t = t.withColumn("gold", F.round(_whole("r_GLD", 20, F.stddev_samp) * root, 9)).withColumn("curve", F.try_divide(F.col("TLT"), F.col("SHY")))
    t = t.withColumn("high", F.round(_quantile("stress", 252, 0.8), 9)).withColumn("gold_mid", F.round(_quantile("gold", 252, 0.5), 9)).withColumn("z", (F.col("r5") - _whole("r5", 252, F.avg)) / _whole("r5", 252, F.stddev_samp))
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)  # noqa: E731  what is not known is no
    above = lambda k, n: yes((F.round(f"m{n}_{k}", 9) > 0) & (F.round(f"m{n}_{k}", 9) > F.round(f"m{n}_SHY", 9)))
    trend = F.when(F.round(F.col("GLD") / _whole("GLD", 50, F.avg) - 1, 9) > 0, 1.0).otherwise(-1.0)
    back = -(F.col("GLD") - _whole("GLD", 20, F.avg)) / _whole("GLD", 20, F.stddev_samp)
    t = t.withColumn("s_safe", yes(F.col("stress") > F.col("high"))).withColumn("s_gld", above("GLD", 120)).withColumn("s_spy", above("SPY", 60)).withColumn("s_tlt", F.when(F.round("z", 9) < -1.5, 1.0).when(F.round("z", 9) > 1.5, -1.0).otherwise(0.0))
    t = t.withColumn("s_calm", yes(F.col("corr") < 0)).withColumn("s_odd", yes(F.col("corr") > 0.3)).withColumn("s_curve", yes(F.round(F.col("curve") / _lag("curve", 60) - 1, 9) > 0))
    t = t.withColumn("s_gold", F.when(F.col("gold") > F.col("gold_mid"), F.greatest(F.least(back, F.lit(2.0)), F.lit(-2.0)) / 2).otherwise(trend))
    many = []
    for k in ("SPY", "GLD", "TLT", *MORE):
        t = t.withColumn(f"v_{k}", above(k, 60) / F.nullif(F.round(_whole(f"r_{k}", 60, F.stddev_samp), 12), F.lit(0.0)))
        many.append(_lag(f"v_{k}") * F.col(f"r_{k}"))
    known = F.array_compact(F.array(*many))
    mixed = _lag("s_calm") * (0.6 * F.col("r_SPY") + 0.4 * F.col("r_TLT")) + _lag("s_odd") * (0.3 * F.col("r_SPY") + 0.3 * F.col("r_GLD") + 0.4 * F.col("r_SHY"))
    out = [
        ((1 - _lag("s_safe")) * F.col("r_SPY") + _lag("s_safe") * (F.col("r_GLD") + F.col("r_TLT")) / 2).alias("safe_haven"),
        (_lag("s_gld") * F.col("r_GLD")).alias("dual_mom_gld"), (_lag("s_spy") * F.col("r_SPY")).alias("dual_mom_spy"), (_lag("s_tlt") * F.col("r_TLT")).alias("reversal_tlt"), mixed.alias("corr_regime"),
        (_lag("s_gold") * F.col("r_GLD")).alias("vol_regime_gld"), (_lag("s_curve") * F.col("r_SPY") + (1 - _lag("s_curve")) * F.col("r_TLT")).alias("curve_rot"),
        F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), F.size(known)).alias("xasset_mom"), (F.try_divide(F.col("open_"), _lag("SPY")) - 1).alias("overnight"), _coins(coins).alias("coin_xmom"),
    ]
    for k in coins:
        t = t.withColumn(f"q_{k}", F.round(F.col(f"m20_{k}") / F.nullif(F.round(_whole(f"r_{k}", 20, F.stddev_samp), 12), F.lit(0.0)), 9))
    t = t.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)
    return t.select("date", *out)


def _coins(coins: tuple[str, ...]) -> Column:
    """From row 60 on: the mean return of the third with the best momentum for its risk on the row before, less that of the worst; 0 with fewer than two coins."""
    if len(coins) < 2:
        return F.lit(None).cast("double")
    each = F.array_compact(F.array(*[F.when(_lag(f"q_{k}").isNotNull() & F.col(f"r_{k}").isNotNull(), F.struct(_lag(f"q_{k}").alias("q"), F.lit(-i).alias("i"), F.col(f"r_{k}").alias("r"))) for i, k in enumerate(coins)]))
    held = F.array_sort(each)
    n = F.greatest(F.lit(1), F.floor(F.size(held) / 3).cast("int"))
    mean = lambda part: F.aggregate(part, F.lit(0.0), lambda s, x: s + x["r"]) / n
    return F.when(F.col("i") >= 60, F.when(F.size(held) < 2, 0.0).otherwise(mean(F.slice(held, F.size(held) - n + 1, n)) - mean(F.slice(held, F.lit(1), n))))


def combine(table: DataFrame, names: list[str], weighting: str = "equal") -> DataFrame:
    """date and r: the mean of the named columns on dates that have all, or (risk_parity) their sum by one over their deviations."""
    whole = table.where(" and ".join(f"{n} is not null" for n in names))
    if weighting == "equal":
        return whole.select("date", (sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)).alias("r"))
    if weighting != "risk_parity":
        raise ValueError(f"no weighting {weighting}")
    inverse = whole.agg(*[(1 / F.stddev_samp(n)).alias(f"w_{n}") for n in names])
    both = whole.join(F.broadcast(inverse), how="cross")  # one row
    total = sum((F.col(f"w_{n}") for n in names[1:]), F.col(f"w_{names[0]}"))
    return both.select("date", (sum((F.col(n) * F.col(f"w_{n}") for n in names[1:]), F.col(names[0]) * F.col(f"w_{names[0]}")) / total).alias("r"))


def statistics(series: DataFrame, year: int = 252, least: int = 50) -> DataFrame:
    """One row of a series (date, r): ratio, return and deviation a year, deepest fall from a peak, share of gains, rows; a return of -1 or less ends all; none for fewer than `least` rows."""
    order = Window.partitionBy(F.lit(0)).orderBy("date")  # a row for each date
    grown = series.select("r", F.expr(GROWTH.format(r="r", over=" over (order by date)")).alias("e"), "date").withColumn("fall", F.col("e") / F.max("e").over(order) - 1)
    root = F.sqrt(F.lit(float(year)))
    return grown.agg(
        F.coalesce(F.try_divide(F.avg("r"), F.stddev_samp("r")) * root, F.lit(0.0)).alias("sharpe"), (F.avg("r") * year).alias("annual_return"), (F.stddev_samp("r") * root).alias("annual_vol"), F.min("fall").alias("max_drawdown"),
        F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.count("*").alias("n"),
    ).where(F.col("n") >= least)


def coin_momentum(prices: DataFrame, n: int = 20, longs: int = 3, shorts: int = 2) -> DataFrame:
    """date, asset and signal of a dense panel (date, asset, price): the names with the best and the worst momentum, each side by inverse volatility; 0 for the rest. A name on both sides is short."""
    w = Window.partitionBy("asset").orderBy("date")
    ret = prices.withColumn("ret", F.try_divide(F.col("price"), F.lag("price").over(w)) - 1)
    frame = w.rowsBetween(1 - n, 0)
    rows = ret.select("date", "asset", F.round(F.try_divide(F.col("price"), F.lag("price", n).over(w)) - 1, 9).alias("m"), (1 / F.nullif(F.round(F.when(F.count("ret").over(frame) >= n, F.stddev_samp("ret").over(frame)), 12), F.lit(0.0))).alias("iv"))
    one = Window.partitionBy("date")
    placed = rows.withColumn("k", F.count("m").over(one)).withColumn("up", F.when(F.col("m").isNotNull(), F.row_number().over(one.orderBy(F.col("m").desc_nulls_last(), "asset")))).withColumn("down", F.when(F.col("m").isNotNull(), F.row_number().over(one.orderBy(F.col("m").asc_nulls_last(), F.desc("asset")))))
    enough = F.col("k") >= longs + shorts
    long, short = F.when(enough & (F.col("up") <= longs), F.col("iv")), F.when(enough & (F.col("down") <= shorts), F.col("iv"))
    return placed.select("date", "asset", F.coalesce(-short / F.sum(short).over(one), long / F.sum(long).over(one), F.lit(0.0)).alias("signal"))


def mean_reversion(prices: DataFrame, n: int = 20, low: float = -2.0, high: float = 2.0) -> DataFrame:
    """date, asset and signal: minus the price's standard score over n rows where it is outside [low, high], else 0."""
    frame = Window.partitionBy("asset").orderBy("date").rowsBetween(1 - n, 0)
    z = F.round((F.col("price") - F.avg("price").over(frame)) / F.nullif(F.round(F.stddev_samp("price").over(frame), 12), F.lit(0.0)), 9)
    rows = prices.select("date", "asset", F.when(F.count("price").over(frame) >= n, z).alias("z"))
    return rows.select("date", "asset", F.when((F.col("z") < low) | (F.col("z") > high), -F.col("z")).otherwise(0.0).alias("signal"))


def vector_backtest(signals: DataFrame, prices: DataFrame, year: int = 365) -> DataFrame:
    """date, r and equity: each date's returns by the signals of the row before; prices is dense, without a return a name earns nothing."""
    w = Window.partitionBy("asset").orderBy("date")
    both = prices.select("date", "asset", (F.try_divide(F.col("price"), F.lag("price").over(w)) - 1).alias("ret")).join(signals, ["date", "asset"], "left")
    r = both.select("date", (F.lag("signal").over(w) * F.col("ret")).alias("x")).groupBy("date").agg(F.round(F.coalesce(F.sum("x"), F.lit(0.0)), 9).alias("r"))
    return r.select("date", "r", F.when(F.min("r").over(Window.partitionBy(F.lit(0)).orderBy("date")) > -1, F.exp(F.sum(F.log1p("r")).over(Window.partitionBy(F.lit(0)).orderBy("date")))).otherwise(0.0).alias("equity"))  # a row for each date


def scaled(signals: DataFrame, prices: DataFrame, target: float = 0.15, n: int = 20, most: float = 2.0, year: int = 365) -> DataFrame:
    """signals times what brings the portfolio's volatility over n rows to target, at most `most`; 1 where there is none."""
    series = vector_backtest(signals, prices, year)
    vol = F.round(F.when(F.count("r").over(_rows(n)) >= n, F.stddev_samp("r").over(_rows(n))) * F.sqrt(F.lit(float(year))), 12)
    scale = series.select("date", F.when(vol > 0, F.least(F.lit(target) / vol, F.lit(most))).otherwise(1.0).alias("scale"))
    return signals.join(scale, "date").select("date", "asset", (F.col("signal") * F.col("scale")).alias("signal"))
