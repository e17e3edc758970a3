"""Betas and tilts on market-wide series, flows and limits of single names, regimes of a market and what they weigh.

Series tables are (series, date, x) or have a row for each date of a market; frames run inside a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.recursion import ewm


def by(key: str = "asset"):
    return Window.partitionBy(key).orderBy("date")


def rows(n: int, key: str = "asset", lag: int = 0):
    return by(key).rowsBetween(1 - n - lag, -lag)


def mean(x: str | Column, n: int, key: str = "asset", least: int | None = None) -> Column:
    return F.when(F.count(x).over(rows(n, key)) >= (least or n), F.avg(x).over(rows(n, key)))


def spread(x: str | Column, n: int, key: str = "asset", least: int | None = None) -> Column:
    return F.when(F.count(x).over(rows(n, key)) >= (least or n), F.stddev_samp(x).over(rows(n, key)))


def rolling_beta(y: str, x: str, n: int) -> Column:
    """Mean of products less product of means, over the sample variance of x; max(n / 2, 20) rows each."""
    least, w = max(n // 2, 20), rows(n)
    xy = F.when(F.count(F.col(x) * F.col(y)).over(w) >= least, F.avg(F.col(x) * F.col(y)).over(w))
    var = F.when(F.count(x).over(w) >= least, F.var_samp(x).over(w))
    return F.try_divide(xy - mean(x, n, least=least) * mean(y, n, least=least), F.when(F.round(var, 15) != 0, var))


def commodity_tilt(panel: DataFrame, n: int = 60, trend: int = 20) -> DataFrame:
    """asset, date, value: the beta on x, by the sign of x's mean over the trend."""
    return panel.select("asset", "date", (rolling_beta("ret", "x", n) * F.signum(mean("x", trend))).alias("value"))


def down_beta(panel: DataFrame, n: int = 60) -> DataFrame:
    """The beta on x over rows on which the market fell."""
    fell = panel.withColumn("x", F.when(F.col("mkt") < 0, F.col("x")))
    return fell.select("asset", "date", rolling_beta("ret", "x", n).alias("value"))


def vol_tilt(panel: DataFrame, n: int = 60) -> DataFrame:
    """The market's beta, turned around where its 20-row spread is above its median of 252 (60 at least)."""
    x = panel.withColumn("v", spread("mkt", 20))
    x = x.withColumn("high", F.when(F.count("v").over(rows(252)) >= 60, F.col("v") > F.percentile("v", F.lit(0.5)).over(rows(252))))
    return x.select("asset", "date", (rolling_beta("ret", "mkt", n) * F.when(F.col("high"), -1.0).otherwise(1.0)).alias("value"))


def regime_z(series: DataFrame, n: int = 20, long: int = 252, least: int = 60) -> DataFrame:
    """series, date, z: the n-row mean of x against its own long mean and spread, cut at 3 and divided by 3."""
    m = series.withColumn("m", mean("x", n, "series"))
    z = F.try_divide(F.col("m") - mean("m", long, "series", least), spread("m", long, "series", least))
    return m.withColumn("z", z).select("series", "date", F.when(F.col("z").isNotNull(), F.greatest(F.least("z", F.lit(3.0)), F.lit(-3.0)) / 3).alias("z"))


def flow_factor(panel: DataFrame, x: str) -> DataFrame:
    """Five-row mean (3 at least) of a flow against its 20-row mean (10 at least), over the size of the latter."""
    five, twenty = mean(x, 5, least=3), mean(x, 20, least=10)
    return panel.select("asset", "date", F.try_divide(five - twenty, F.abs(twenty)).alias("value"))


def limit_up(panel: DataFrame, limit: float, leak_free: bool = False) -> DataFrame:
    """asset, date: rows of 20 with a return at the limit, and the mean return of the three rows from each of them on.

    The latter looks ahead; leak_free moves it back by three rows.
    """
    hit = panel.withColumn("hit", F.when(F.col("ret") >= limit, 1.0).otherwise(0.0)).withColumn("then", F.when(F.col("ret") >= limit, F.try_divide(F.lead("price", 3).over(by()), F.col("price")) - 1))
    found = hit.select("asset", "date", F.sum("hit").over(rows(20)).alias("hits"), F.avg("then").over(rows(20)).alias("then"))
    return found.withColumn("then", F.lag("then", 3).over(by())) if leak_free else found


def attention_decay(events: DataFrame, n: int = 20, half_life: float = 5) -> DataFrame:
    """Sums of net purchases and of occurrences over n rows with weights that halve every half_life rows and add up to 1."""
    raw = [0.5 ** (k / half_life) for k in range(n)]
    term = lambda c: sum((F.coalesce(F.lag(c, k).over(by()), F.lit(0.0)) * (w / sum(raw)) for k, w in enumerate(raw)), F.lit(0.0))
    x = events.withColumn("net", F.coalesce("net", F.lit(0.0))).withColumn("seen", F.when(F.col("net") != 0, 1.0).otherwise(0.0))
    return x.select("asset", "date", term("net").alias("net"), term("seen").alias("seen"))


# Regimes of a market: (series, date, close, high, low, volume, ret).


def vol_regime(market: DataFrame) -> DataFrame:
    """Share of the 253 rows up to this one whose 20-row spread is below it (60 at least): low, normal, high or extreme."""
    v = market.withColumn("v", spread("ret", 20, "series"))
    w = v.withColumn("all", F.collect_list("v").over(rows(253, "series")))
    share = F.when((F.size("all") >= 60) & F.col("v").isNotNull(), F.size(F.filter("all", lambda y: y < F.col("v"))) / F.size("all"))
    label = F.when(share < 0.25, "low_vol").when(share < 0.75, "normal_vol").when(share < 0.9, "high_vol").when(share.isNotNull(), "extreme_vol").otherwise("normal_vol")
    return w.select("series", "date", share.alias("share"), label.alias("label"))


def change_z(series: DataFrame, n: int = 60, long: int = 252, least: int = 60) -> DataFrame:
    """Standard score of x's change over n rows against its long mean and spread."""
    d = series.withColumn("d", F.col("x") - F.lag("x", n).over(by("series")))
    return d.select("series", "date", F.try_divide(F.col("d") - mean("d", long, "series", least), spread("d", long, "series", least)).alias("z"))


def three_way(z: Column, edge: float, low: str, mid: str, high: str) -> Column:
    return F.when(z > edge, high).when(z < -edge, low).otherwise(mid)


def correlation_regime(series: DataFrame, n: int = 20) -> DataFrame:
    """Mean correlation of all pairs of series over the n rows before each date, and its label."""
    a, b = series.select("date", F.col("series").alias("a"), "x"), series.select("date", F.col("series").alias("b"), F.col("x").alias("y"))
    pairs = a.join(b, "date").where("a < b")  # series are few: sectors or indexes
    w = Window.partitionBy("a", "b").orderBy("date").rowsBetween(-n, -1)
    c = pairs.withColumn("c", F.when(F.count("x").over(w) >= n, F.corr("x", "y").over(w)))
    m = c.groupBy("date").agg(F.avg("c").alias("mean"))
    return m.select("date", "mean", F.when(F.col("mean") > 0.6, "high_corr").when(F.col("mean") < 0.3, "low_corr").otherwise("normal_corr").alias("label"))


def sigmoid_weight(x: Column, center: float, steep: float, least: float) -> Column:
    return least + (1 - least) / (1 + F.exp(steep * (x - center)))


def sigmoid_grid(returns: DataFrame, centers: tuple[float, ...], steeps: tuple[float, ...], least: float = 0.2) -> DataFrame:
    """Sharpe ratio, drawdown and mean weight of returns (series, date, r, x) weighted by the last x through each sigmoid of a grid."""
    grid = returns.sparkSession.createDataFrame([(c, s) for c in centers for s in steeps], "center double, steep double")
    lagged = returns.withColumn("before", F.lag("x").over(by("series"))).where("before is not null")
    w = least + (1 - least) / (1 + F.exp(F.col("steep") * (F.col("before") - F.col("center"))))
    tall = lagged.join(F.broadcast(grid)).withColumn("w", w).withColumn("p", F.col("w") * F.col("r"))  # the grid's rows are few
    order = Window.partitionBy("series", "center", "steep").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = tall.withColumn("sum", F.sum("p").over(order)).withColumn("down", F.col("sum") - F.max("sum").over(order))
    return grown.groupBy("series", "center", "steep").agg(F.coalesce(F.try_divide(F.avg("p"), F.stddev_samp("p")) * F.sqrt(F.lit(12.0)), F.lit(0.0)).alias("sharpe"), F.min("down").alias("max_drawdown"), F.avg("w").alias("mean_weight"))


def sigmoid_trend(series: DataFrame, n: int) -> DataFrame:
    """2 / (1 + exp(-deviation)) - 1 of x's relative distance from its n-row mean, in percent."""
    m = mean("x", n, "series")
    return series.select("series", "date", (2 / (1 + F.exp(-100 * F.try_divide(F.col("x") - m, m))) - 1).alias("trend"))


def hold_weights(labels: DataFrame, table: DataFrame, returns: DataFrame, every: int) -> DataFrame:
    """date and the return of the buckets weighted by the labels of the last every-th date: labels (date, label), table (label, bucket, w), returns (date, bucket, r)."""
    one = Window.partitionBy(F.lit(0)).orderBy("date")  # a row for each date
    placed = labels.withColumn("i", F.row_number().over(one) - 1)
    marks = placed.where(F.col("i") % every == 0).select((F.col("i") / every).cast("int").alias("g"), F.col("label").alias("held"))
    held = placed.withColumn("g", F.floor(F.col("i") / every).cast("int")).join(F.broadcast(marks), "g")  # one row for each rebalance
    both = held.join(F.broadcast(table.withColumnRenamed("label", "held")), "held").join(returns, ["date", "bucket"])
    return both.groupBy("date").agg(F.sum(F.col("w") * F.col("r")).alias("r"))


def trend_regime(bars: DataFrame, fast: int = 50, slow: int = 200, n: int = 14, usual: int = 252, least: int = 60) -> DataFrame:
    """asset, date and trend of bars (asset, date, high, low, price): bull or bear where the fast mean is above or below the slow one and the
    move over n rows, against the exponential mean of true ranges, is above its own median; else sideways."""
    w = Window.partitionBy("asset").orderBy("date")
    before = F.lag("price").over(w)
    ranged = bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))).withColumn("moved", F.col("price") - F.lag("price", n).over(w))
    atr = ewm(ranged, F.col("tr"), 2 / (n + 1), "atr", adjust=True)
    mean = lambda k: F.round(F.when(F.count("price").over(w.rowsBetween(1 - k, 0)) >= k, F.avg("price").over(w.rowsBetween(1 - k, 0))), 9)
    enough = F.count("tr").over(w.rowsBetween(Window.unboundedPreceding, 0)) >= n
    rows = atr.select("asset", "date", mean(fast).alias("fast"), mean(slow).alias("slow"), F.round(F.when(enough, F.abs("moved") / (F.col("atr") * n**0.5 + 1e-10)), 9).alias("strength"))
    year = w.rowsBetween(1 - usual, 0)
    held = F.sort_array(F.collect_list("strength").over(year))  # `usual` numbers for each row
    middle = (F.element_at(held, F.floor((F.size(held) + 1) / 2).cast("int")) + F.element_at(held, F.floor((F.size(held) + 2) / 2).cast("int"))) / 2
    strong = F.col("strength") > F.when(F.size(held) >= least, F.round(middle, 9))
    label = F.when(strong & (F.col("fast") > F.col("slow")), "bull").when(strong & (F.col("fast") < F.col("slow")), "bear").otherwise("sideways")
    return rows.select("asset", "date", label.alias("trend"))


def liquidity_regime(bars: DataFrame, year: int = 252) -> DataFrame:
    """asset, date and liquidity of bars (asset, date, high, low, price, volume): ample, normal or tight by where ranges over prices, less volume against its usual, stand among the year's."""
    w = Window.partitionBy("asset").orderBy("date")
    mean = lambda x, n, least: F.when(F.count(x).over(w.rowsBetween(1 - n, 0)) >= least, F.avg(x).over(w.rowsBetween(1 - n, 0)))
    rows = bars.withColumn("range", F.try_divide(F.col("high") - F.col("low"), F.col("price")))
    rows = rows.select("asset", "date", mean("range", 20, 15).alias("a"), F.try_divide(mean("volume", 20, 15), mean("volume", 60, 40)).alias("b"))
    frame = w.rowsBetween(1 - year, 0)
    z = lambda x: F.when(F.count(x).over(frame) >= 60, (F.col(x) - F.avg(x).over(frame)) / (F.stddev_samp(x).over(frame) + 1e-10))
    scored = rows.select("asset", "date", F.round(z("a") - z("b"), 9).alias("score"))
    held = F.collect_list("score").over(frame)  # the year's numbers for each row
    share = F.when(F.col("score").isNotNull() & (F.size(held) >= 60), F.size(F.filter(held, lambda x: x < F.col("score"))) / (F.count("*").over(frame) - 1))
    return scored.withColumn("share", share).select("asset", "date", F.when(F.col("share") < 0.3, "ample").when(F.col("share") > 0.7, "tight").otherwise("normal").alias("liquidity"))
