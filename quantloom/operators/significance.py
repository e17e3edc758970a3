"""How sure a signal's quality is: turnover, autocorrelation, adjusted errors, several tests at once, folds, combinations.

Signals are tall: (factor, date, asset, signal); coefficient series are (factor, date, ic).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import average_rank, dealt, wide


def by_factor():
    return Window.partitionBy("factor").orderBy("date")


def forward_sum(panel: DataFrame, n: int) -> DataFrame:
    """asset, date and the sum of the n returns after it, where all are there."""
    ahead = Window.partitionBy("asset").orderBy("date").rowsBetween(1, n)
    return panel.select("asset", "date", F.when(F.count("ret").over(ahead) >= n, F.sum("ret").over(ahead)).alias("fwd"))


def ic_by_factor(tall: DataFrame, forward: DataFrame | None = None, least: int = 20) -> DataFrame:
    """Rank correlation of each factor with forward returns (date, asset, fwd; without them tall's own fwd) on dates with enough names that have both."""
    known = tall.where("signal is not null")
    both = known.where("fwd is not null") if forward is None else known.join(forward.where("fwd is not null"), ["date", "asset"])
    ranked = both.select("factor", "date", average_rank("signal", "factor", "date").alias("a"), average_rank("fwd", "factor", "date").alias("b"))
    return ranked.groupBy("factor", "date").agg(F.round(F.corr("a", "b"), 6).alias("ic"), F.count("*").alias("n")).where(F.col("n") >= least)


def turnover(tall: DataFrame, n: int) -> DataFrame:
    """factor, date and the share of the n largest names that change against the factor's date before, entering and leaving counted; null for a factor's first date and after dates with fewer than n names."""
    dates = tall.where("signal is not null").groupBy("factor", "date").agg(F.count("*").alias("k"))
    dates = dates.withColumn("place", F.row_number().over(by_factor())).withColumn("full", F.col("k") >= n)
    top = tall.where("signal is not null").withColumn("r", F.row_number().over(Window.partitionBy("factor", "date").orderBy(F.desc("signal"), "asset"))).where(F.col("r") <= n)
    held = top.join(dates.where("full"), ["factor", "date"]).select("factor", "asset", "place")
    stays = held.join(held.select("factor", "asset", (F.col("place") + 1).alias("place")), ["factor", "asset", "place"]).groupBy("factor", "place").agg(F.count("*").alias("stay"))
    before = F.lag("full").over(by_factor())
    return dates.withColumn("before", before).join(stays, ["factor", "place"], "left").where("full and before").select("factor", "date", (1 - F.coalesce("stay", F.lit(0)) / n).alias("turnover"))


def newey_west(ics: DataFrame) -> DataFrame:
    """Mean, naive t and t with a Bartlett-weighted long-run error of m = max(1, whole part of n**(1/3)) lags; null under 10 dates.

    One exchange: a factor's series, a value for each date, is an array whose products with itself some dates on are added up.
    """
    series = ics.where("ic is not null").groupBy("factor").agg(F.count("*").alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("sd"), F.sort_array(F.collect_list(F.struct("date", "ic"))).alias("s"))
    series = series.withColumn("m", F.greatest(F.lit(1), F.floor(F.pow("n", F.lit(1 / 3)) + 1e-9).cast("int"))).withColumn("e", F.expr("transform(s, x -> x.ic - mean)"))
    apart = "aggregate(zip_with(slice(e, 1, size(e) - lag), slice(e, lag + 1, size(e) - lag), (a, b) -> a * b), 0D, (t, p) -> t + p)"
    long_run = f"aggregate(sequence(0, least(m, size(e) - 1)), 0D, (acc, lag) -> acc + case when lag = 0 then 1D else 2 * (1 - lag / (m + 1)) end * {apart})"
    agg = series.withColumn("se", F.expr(f"sqrt({long_run}) / n"))
    enough = F.col("n") >= 10
    return agg.select("factor", "n", F.when(enough, F.col("m")).alias("lags"), F.when(enough, F.col("mean")).alias("mean"), F.when(enough, F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n"))).alias("t_naive"), F.when(enough, F.try_divide(F.col("mean"), F.col("se"))).alias("t_adjusted"))


def autocorrelation(ics: DataFrame, lags: int = 5) -> DataFrame:
    """First autocorrelation, effective number of dates and t with it, Ljung-Box statistic; null under 20 dates."""
    base = ics.where("ic is not null").withColumn("m", F.avg("ic").over(Window.partitionBy("factor")))
    for k in range(1, lags + 1):
        base = base.withColumn(f"p{k}", (F.col("ic") - F.col("m")) * F.lag(F.col("ic") - F.col("m"), k).over(by_factor()))
    base = base.withColumn("before", F.lag("ic").over(by_factor()))
    agg = base.groupBy("factor").agg(F.count("*").alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("sd"), F.corr("ic", "before").alias("rho"), F.sum((F.col("ic") - F.col("m")) * (F.col("ic") - F.col("m"))).alias("v"), *[F.sum(f"p{k}").alias(f"c{k}") for k in range(1, lags + 1)])
    r = lambda k: F.try_divide(F.col(f"c{k}"), F.col("v"))
    q = F.col("n") * (F.col("n") + 2) * sum((r(k) * r(k) / (F.col("n") - k) for k in range(2, lags + 1)), r(1) * r(1) / (F.col("n") - 1))
    eff = F.greatest(F.when(F.abs("rho") < 1, F.col("n") * (1 - F.col("rho")) / (1 + F.col("rho"))).otherwise(F.col("n")), F.lit(2.0))
    enough = F.col("n") >= 20
    return agg.where("n > 6").select("factor", "n", F.when(enough, F.col("rho")).alias("rho"), F.when(enough, eff).alias("n_effective"), F.when(enough, F.try_divide(F.col("mean"), F.col("sd") / F.sqrt(eff))).alias("t_effective"), F.when(enough, q).alias("ljung_box"))


def multiple_tests(tests: DataFrame, method: str, alpha: float = 0.05) -> DataFrame:
    """Tests (factor, p) with adjusted p and whether they are rejected: bonferroni, holm, bh or by; null p stay out.

    Null p are a group of their own: with a join in its place Spark computes the tests twice.
    """
    by = Window.partitionBy(F.isnull("p"))  # a row for each factor
    up = by.orderBy("p", "factor")
    placed = tests.withColumns({"_n": F.count("*").over(by), "_k": F.row_number().over(up)})
    if method == "bonferroni":
        raw = F.col("p") * F.col("_n")
    elif method == "holm":
        raw = F.max(F.col("p") * (F.col("_n") - F.col("_k") + 1)).over(up.rowsBetween(Window.unboundedPreceding, 0))
    else:
        c = F.aggregate(F.sequence(F.lit(1), F.col("_n").cast("int")), F.lit(0.0), lambda s, i: s + 1 / i) if method == "by" else F.lit(1.0)
        raw = F.min(F.col("p") * F.col("_n") / F.col("_k") * c).over(up.rowsBetween(0, Window.unboundedFollowing))
    out = placed.withColumn("p_adjusted", F.when(F.col("p").isNotNull(), F.least(raw, F.lit(1.0)))).drop("_n", "_k")
    return out.withColumn("reject", F.coalesce(F.col("p_adjusted") <= alpha, F.lit(False)))


def factor_ranking(tall: DataFrame, ics: DataFrame, n: int = 20) -> DataFrame:
    """Mean, spread and ratio of each factor's coefficients, share above 0, mean turnover and place by the size of the mean."""
    quality = ics.groupBy("factor").agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"))
    quality = quality.withColumn("ir", F.coalesce(F.try_divide(F.col("mean_ic"), F.col("std_ic")), F.lit(0.0)))
    moved = turnover(tall, n).groupBy("factor").agg(F.avg("turnover").alias("turnover"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.abs(F.round("mean_ic", 9))), "factor"))  # a row for each factor
    return quality.join(moved, "factor", "left").withColumn("place", place)


def rank_autocorrelation(tall: DataFrame, period: int) -> DataFrame:
    """factor, date and the correlation of the cross-section's ranks with those of the same names `period` dates before."""
    ranked = tall.where("signal is not null").select("factor", "date", "asset", average_rank("signal", "factor", "date").alias("r"))
    dates = ranked.select("factor", "date").distinct().withColumn("k", F.row_number().over(by_factor()))
    at = ranked.join(dates, ["factor", "date"])
    before = at.select("factor", "asset", (F.col("k") + period).alias("k"), F.col("r").alias("b"))
    return at.join(before, ["factor", "asset", "k"]).groupBy("factor", "date").agg(F.corr("r", "b").alias("autocorrelation"))


def tear_sheet(buckets: DataFrame) -> DataFrame:
    """Mean and spread of each quantile bucket's returns, and (bucket null) of the last less the first with its Sharpe ratio."""
    by = buckets.groupBy("bucket").agg(F.avg("mean_ret").alias("mean"), F.stddev_pop("mean_ret").alias("spread"), F.count("*").alias("dates"), F.lit(None).cast("double").alias("sharpe"))
    ends = buckets.groupBy("date").agg((F.max_by("mean_ret", "bucket") - F.min_by("mean_ret", "bucket")).alias("x"), F.count("*").alias("k")).where("k > 1")
    long_short = ends.agg(F.lit(None).cast("int").alias("bucket"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread"), F.count("*").alias("dates"), (F.try_divide(F.avg("x"), F.stddev_pop("x")) * F.sqrt(F.lit(12.0))).alias("sharpe"))
    return by.unionByName(long_short)


def regime_ic(ics: DataFrame, labels: DataFrame, least: int = 5) -> DataFrame:
    """Summary of each factor's coefficients by regime (date, regime), and over all (regime null); regimes with few dates are left out."""
    both = ics.join(labels, "date")
    return both.groupingSets([["factor", "regime"], ["factor"]], "factor", "regime").agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.count("*").alias("n")).where(F.col("n") >= least).withColumn("ir", F.coalesce(F.try_divide(F.col("mean_ic"), F.col("std_ic")), F.lit(0.0)))


def fundamental_law(quality: DataFrame, names: float, periods: int) -> DataFrame:
    """Breadth, the information ratio that mean and breadth promise, and how much of it the factor's own ratio reaches."""
    breadth = F.lit(float(names * periods))
    promised = F.col("mean_ic") * F.sqrt(breadth)
    own = F.col("ir") * F.sqrt(F.lit(float(periods)))
    return quality.select("factor", breadth.alias("breadth"), promised.alias("promised"), F.try_divide(own, promised).alias("transfer"))


def walk_forward(dates: DataFrame, train: int, test: int, step: int, expanding: bool) -> DataFrame:
    """fold, role (train or test) and date: windows over the order of dates, as long as a whole test window is left."""
    placed = dates.select("date").distinct().withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)  # a row for each date
    n = placed.count()
    folds = [(k, 0 if expanding else s, s + train, s + train + test) for k, s in enumerate(range(0, n - train - test + 1, step))]
    table = dates.sparkSession.createDataFrame(folds or [(0, 0, 0, 0)], "fold int, start int, cut int, stop int")
    inside = placed.join(F.broadcast(table), (F.col("i") >= F.col("start")) & (F.col("i") < F.col("stop")))  # a row for each fold
    return inside.select("fold", F.when(F.col("i") < F.col("cut"), "train").otherwise("test").alias("role"), "date")


def _long_short(study: DataFrame) -> DataFrame:
    """date and x: the mean of the top fifth (five names at least) less that of the bottom fifth."""
    known = study.where("signal is not null and fwd is not null")
    by = Window.partitionBy("date")
    n = F.count("*").over(by)
    placed = known.withColumn("k", F.greatest(F.lit(5), F.floor(n / 5))).withColumn("up", F.row_number().over(by.orderBy(F.desc("signal"), "asset"))).withColumn("down", F.row_number().over(by.orderBy("signal", "asset"))).withColumn("n", n)
    return placed.where("n >= 2 * k").groupBy("date").agg((F.avg(F.when(F.col("up") <= F.col("k"), F.col("fwd"))) - F.avg(F.when(F.col("down") <= F.col("k"), F.col("fwd")))).alias("x"))


def walk_forward_run(study: DataFrame, folds: DataFrame) -> DataFrame:
    """Sharpe ratio of buying the top fifth and selling the bottom fifth (five names at least) by fold and role."""
    sharpe = F.coalesce(F.try_divide(F.avg("x"), F.stddev_samp("x")) * F.sqrt(F.lit(12.0)), F.lit(0.0))
    wide = _long_short(study).join(folds, "date").groupBy("fold").pivot("role", ["train", "test"]).agg(sharpe)
    return wide.withColumn("retention", F.try_divide(F.col("test"), F.col("train"))).withColumn("decay", 1 - F.try_divide(F.col("test"), F.col("train")))


def walk_forward_summary(study: DataFrame, folds: DataFrame) -> DataFrame:
    """One row: the Sharpe ratio of all test returns together, mean ratios in and out of sample, retention of folds that earn in sample, and decay. A ratio of fewer than three returns is 0."""
    sharpe = lambda: F.when((F.count("x") >= 3) & (F.stddev_samp("x") > 0), F.avg("x") / F.stddev_samp("x") * F.sqrt(F.lit(12.0))).otherwise(0.0)
    both = _long_short(study).join(folds, "date")
    by = both.groupBy("fold", "role").agg(sharpe().alias("sharpe"))
    each = by.groupBy("fold").pivot("role", ["train", "test"]).agg(F.first("sharpe"))
    means = each.agg(F.count("*").alias("folds"), F.avg("train").alias("train"), F.avg("test").alias("test"), F.avg(F.when(F.col("train") > 0, F.col("test") / F.col("train"))).alias("retention"))
    pooled = both.where("role = 'test'").agg(F.when(F.stddev_samp("x") > 0, F.avg("x") / F.stddev_samp("x") * F.sqrt(F.lit(12.0))).otherwise(0.0).alias("pooled"))
    return means.join(pooled, how="cross").withColumn("decay", F.when(F.col("train") > 0, 1 - F.col("test") / F.col("train")))  # one row each


def rolling_ic(ics: DataFrame, n: int) -> DataFrame:
    """Each date's mean coefficient over n dates and the sum so far."""
    last = by_factor().rowsBetween(1 - n, 0)
    return ics.select("factor", "date", F.when(F.count("ic").over(last) >= n, F.avg("ic").over(last)).alias("mean"), F.sum("ic").over(by_factor().rowsBetween(Window.unboundedPreceding, 0)).alias("total"))


def time_split(panel: DataFrame, share: float) -> DataFrame:
    """panel with role: train up to the first date by which the share of rows is reached, test after it."""
    by = panel.groupBy("date").agg(F.count("*").alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy("date")  # a row for each date
    cut = by.withColumn("sofar", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(0))))
    roles = cut.select("date", F.when(F.col("sofar") - F.col("n") < share * F.col("all"), "train").otherwise("test").alias("role"))
    return panel.join(F.broadcast(roles), "date")


def best_combinations(tall: DataFrame, forward: DataFrame, combos: dict[str, tuple[str, ...]], least: int = 20, size: int = 0) -> DataFrame:
    """Mean coefficient of each combination's mean signal (of those that a name has): all combinations from one pivot, joined to forward once.  size: about how many dates and assets there are, if known."""
    names = sorted({f for members in combos.values() for f in members})
    both = wide(tall.where("signal is not null"), names).join(forward.where("fwd is not null"), ["date", "asset"])

    def mean(members: tuple[str, ...]):
        total = reduce(lambda s, f: s + F.coalesce(F.col(f), F.lit(0.0)), members, F.lit(0.0))
        return F.round(F.try_divide(total, reduce(lambda s, f: s + F.col(f).isNotNull().cast("int"), members, F.lit(0))), 6)

    each = F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), mean(members).alias("signal")) for c, members in combos.items()]))
    means = both.select("date", "asset", "fwd", each.alias("e")).select("e.factor", "date", "asset", "e.signal", "fwd").where("signal is not null")
    ics = ic_by_factor(dealt(means, "factor", "date", size=size * len(combos)), least=least)
    exact = F.sum(F.col("ic").cast("decimal(9,6)")).cast("double") / F.count("ic")  # coefficients have six digits: ties of the mean do not hang on the order of sums
    return ics.groupBy("factor").agg(exact.alias("mean_ic"), F.count("*").alias("dates"))


def consensus(scores: DataFrame, names: list[str]) -> DataFrame:
    """factor and the mean of its places by each score, the largest first."""
    one = Window.partitionBy(F.lit(0))  # a row for each factor
    place = lambda c: F.rank().over(one.orderBy(F.desc_nulls_last(c))) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2
    return scores.select("factor", (sum((place(c) for c in names[1:]), place(names[0])) / len(names)).alias("mean_place"))


def ic_histogram(ics: DataFrame, bins: int = 30) -> DataFrame:
    """factor, bin (from 1), its lower edge and the number of coefficients in it: equal bins from the factor's least to its largest, the last one closed."""
    ends = Window.partitionBy("factor")
    low, wide = F.min("ic").over(ends), (F.max("ic").over(ends) - F.min("ic").over(ends)) / bins
    placed = ics.where("ic is not null").select("factor", "ic", low.alias("low"), wide.alias("wide"))
    k = F.when(F.col("wide") > 0, F.least(F.floor(F.round((F.col("ic") - F.col("low")) / F.col("wide"), 9)) + 1, F.lit(bins))).otherwise(1).cast("int")
    return placed.groupBy("factor", k.alias("bin")).agg(F.max("low").alias("low"), F.max("wide").alias("wide"), F.count("*").alias("n")).select("factor", "bin", (F.col("low") + (F.col("bin") - 1) * F.col("wide")).alias("edge"), "n")
