"""From factors to signals by configuration: composites, interactions, scaling by the market's regime, sectors' strength, labelled tables.

Signals are tall (factor, date, asset, signal); all of a catalogue's entries come from one pass over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import average_rank, dealt, wide

#: The classic composite's weights, what the market's volatility over its usual one does to momentum and to other factors, largest first.
CLASSIC = {"momentum": 0.5, "acceleration": 0.2, "volatility": -0.1, "quality": 0.2}
MOMENTUM_SCALE, OTHER_SCALE = ((1.5, 0.5), (1.2, 0.75)), ((1.5, 1.1),)
CALM_MOMENTUM, CALM_OTHER = (0.8, 1.2), (0.7, 0.9)


def place(x: str, by: tuple[str, ...], least: int = 10):
    """The average rank of x in its group, -1 to 1; null in groups with fewer than `least` values."""
    n = F.count(x).over(Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(F.col(x).isNotNull() & (n >= least), 2 * average_rank(x, *by) / n - 1)


def as_signal(rows: DataFrame, x: str, method: str = "rank") -> DataFrame:
    """date, asset and signal of rows (date, asset, x): the share of names at or below, -1 to 1 (rank), or a third of the standard score within three (zscore)."""
    if method == "rank":
        return rows.select("date", "asset", place(x, ("date",), 1).alias("signal"))
    if method != "zscore":
        raise ValueError(f"no method {method}")
    one = Window.partitionBy("date")
    z = (F.col(x) - F.avg(x).over(one)) / F.nullif(F.round(F.stddev_samp(x).over(one), 12), F.lit(0.0))
    return rows.select("date", "asset", F.when(z.isNotNull(), F.greatest(F.least(z, F.lit(3.0)), F.lit(-3.0)) / 3).alias("signal"))


def composite(tall: DataFrame, weights: dict[str, float], optional: tuple[str, ...] = ()) -> DataFrame:
    """date, asset and signal: the weighted sum of the named factors' signals; null where one is missing, but optional ones count 0 then."""
    total = sum(((F.coalesce(F.col(f), F.lit(0.0)) if f in optional else F.col(f)) * w for f, w in weights.items()), F.lit(0.0))
    return wide(tall, list(weights)).select("date", "asset", total.alias("signal"))


def interactions(tall: DataFrame, pairs: dict[str, tuple[str, str]], least: int = 10, size: int = 0) -> DataFrame:
    """factor (a pair's name), date, asset and signal: the rank of the product of two factors' signals; all pairs from one pivot.  size: about how many dates and assets there are, if known."""
    names = sorted({f for p in pairs.values() for f in p})
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), F.round(F.col(a) * F.col(b), 9).alias("x")) for n, (a, b) in pairs.items()]))
    rows = dealt(wide(tall, names).select("date", "asset", each.alias("e")).select("e.factor", "date", "asset", "e.x"), "factor", "date", size=size * len(pairs))
    return rows.select("factor", "date", "asset", place("x", ("factor", "date"), least).alias("signal"))


def regime_scale(market: DataFrame, rows: int = 6, least: int = 12) -> DataFrame:
    """date, ratio, and the scales of momentum and of other factors: the market's volatility over `rows` months against the median of all so far; 1 where one is not known."""
    order = Window.partitionBy(F.lit(0)).orderBy("date")  # a row for each date
    frame = order.rowsBetween(1 - rows, 0)
    vol = market.select("date", F.round(F.when(F.count("m").over(frame) >= rows, F.stddev_samp("m").over(frame)) * F.sqrt(F.lit(12.0)), 9).alias("v"))
    held = F.sort_array(F.collect_list("v").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.size(held)
    middle = (F.element_at(held, F.floor((n + 1) / 2).cast("int")) + F.element_at(held, F.floor((n + 2) / 2).cast("int"))) / 2
    known = vol.withColumn("usual", F.when(n >= least, F.when(n > 0, middle)))
    ratio = F.round(F.when(F.col("usual") > 0, F.col("v") / F.col("usual")), 9)
    scaled = known.select("date", ratio.alias("ratio"))

    def steps(high: tuple[tuple[float, float], ...], calm: tuple[float, float]):
        out = F.when(F.col("ratio") < calm[0], calm[1]).otherwise(1.0)
        for limit, scale in reversed(high):
            out = F.when(F.col("ratio") > limit, scale).otherwise(out)
        return out

    return scaled.select("date", "ratio", steps(MOMENTUM_SCALE, CALM_MOMENTUM).alias("momentum"), steps(OTHER_SCALE, CALM_OTHER).alias("other"))


def regime_adjusted(tall: DataFrame, market: DataFrame, momentum: tuple[str, ...]) -> DataFrame:
    """tall with each signal scaled by its date's regime: factors named in momentum shrink in wild markets, others grow a little."""
    scale = F.when(F.col("factor").isin(*momentum), F.col("momentum")).otherwise(F.col("other"))
    both = tall.join(F.broadcast(regime_scale(market)), "date", "left")  # a row for each date
    return both.select("factor", "date", "asset", (F.col("signal") * F.coalesce(scale, F.lit(1.0))).alias("signal"))


def sector_strength(rows: DataFrame, n: int = 20, least: int = 10) -> DataFrame:
    """date, asset and signal of rows (date, asset, sector, ret), dense by asset: the rank of n rows' returns above the sector's mean."""
    own = Window.partitionBy("asset").orderBy("date").rowsBetween(1 - n, 0)
    above = rows.withColumn("above", F.col("ret") - F.avg("ret").over(Window.partitionBy("date", "sector")))
    total = above.select("date", "asset", F.round(F.when(F.count("above").over(own) >= n, F.sum("above").over(own)), 9).alias("x"))
    return total.select("date", "asset", place("x", ("date",), least).alias("signal"))


def sector_trends(series: DataFrame, slow: int = 20, fast: int = 5, least: int = 2) -> DataFrame:
    """sector, date, momentum (rank of the sum over `slow` rows) and reversion (rank of minus the sum over `fast`) of series (sector, date, r)."""
    total = lambda k: F.when(F.count("r").over(Window.partitionBy("sector").orderBy("date").rowsBetween(1 - k, 0)) >= k, F.sum("r").over(Window.partitionBy("sector").orderBy("date").rowsBetween(1 - k, 0)))
    rows = series.select("sector", "date", F.round(total(slow), 9).alias("x"), F.round(-total(fast), 9).alias("y"))
    return rows.select("sector", "date", place("x", ("date",), least).alias("momentum"), place("y", ("date",), least).alias("reversion"))


def order_fee(orders: DataFrame, commission: float = 1.0, spread: float = 5.0, borrow: float = 30.0) -> DataFrame:
    """orders (price, quantity, side) with fee: commission, half the spread and, on sales, a day's borrowing, in basis points of the amount (borrowing of a year of 252 days)."""
    amount = F.col("price") * F.abs("quantity")
    return orders.withColumn("fee", amount * (commission + spread / 2) / 1e4 + F.when(F.lower("side") == "sell", amount * borrow / 1e4 / 252).otherwise(0.0))


def labelled(signals: DataFrame, prices: DataFrame, periods: tuple[int, ...] = (1, 5, 10), quantiles: int = 5, most_lost: float = 0.35) -> DataFrame:
    """date, asset, factor, bucket (1 to quantiles, by rank within the date) and the returns over the next periods, of signals (date, asset, signal) that have all of them.

    ValueError, before anything is returned, if more than most_lost of the signals have no returns.  prices: (date, asset, price), dense.
    """
    w = Window.partitionBy("asset").orderBy("date")
    ahead = prices.select("date", "asset", *[(F.try_divide(F.lead("price", k).over(w), F.col("price")) - 1).alias(f"fwd_{k}") for k in periods])
    known = signals.where("signal is not null")
    both = known.join(ahead, ["date", "asset"]).where(" and ".join(f"fwd_{k} is not null" for k in periods))
    have, kept = known.count(), both.count()
    if have and 1 - kept / have > most_lost:
        raise ValueError(f"{1 - kept / have:.1%} of the signals have no returns, {most_lost:.1%} at most may lack them")
    one = Window.partitionBy("date")
    rank = F.row_number().over(one.orderBy("signal", "asset"))
    return both.select("date", "asset", F.col("signal").alias("factor"), (F.floor((rank - 1) * quantiles / F.count("*").over(one)) + 1).cast("int").alias("bucket"), *[f"fwd_{k}" for k in periods])


def catalogue(tall: DataFrame, combos: dict[str, dict[str, float]], market: DataFrame | None = None, wild: tuple[str, ...] = (), least: int = 10, size: int = 0) -> DataFrame:
    """combo, date, asset and signal of all combinations from one pivot: the rank of the weighted sum of the factors that a name has, by their weights; names without any have none.

    Combinations named in wild are then scaled as momentum is by the market's regime (see regime_scale()).  size: about how many dates and assets there are, if known.
    """
    names = sorted({f for w in combos.values() for f in w})

    def mean(weights: dict[str, float]):
        total = sum((F.coalesce(F.col(f), F.lit(0.0)) * w for f, w in weights.items()), F.lit(0.0))
        return F.try_divide(total, sum((F.when(F.col(f).isNotNull(), abs(w)).otherwise(0.0) for f, w in weights.items()), F.lit(0.0)))

    each = F.explode(F.array(*[F.struct(F.lit(n).alias("combo"), F.round(mean(w), 9).alias("x")) for n, w in combos.items()]))
    rows = dealt(wide(tall, names).select("date", "asset", each.alias("e")).select("e.combo", "date", "asset", "e.x"), "combo", "date", size=size * len(combos))
    ranked = rows.select("combo", "date", "asset", place("x", ("combo", "date"), least).alias("signal"))
    if market is None or not wild:
        return ranked
    scale = F.when(F.col("combo").isin(*wild), F.coalesce("momentum", F.lit(1.0))).otherwise(1.0)
    return ranked.join(F.broadcast(regime_scale(market)), "date", "left").select("combo", "date", "asset", (F.col("signal") * scale).alias("signal"))  # a row for each date


def regime_history(labels: dict[str, DataFrame], n: int) -> DataFrame:
    """asset, date and a column for each of labels (asset, date, label as the third column), on the last n dates of each asset that all have."""
    out = None
    for name, table in labels.items():
        part = table.select("asset", "date", F.col(table.columns[2]).alias(name))
        out = part if out is None else out.join(part, ["asset", "date"])
    return out.withColumn("_k", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("date")))).where(F.col("_k") <= n).drop("_k")
