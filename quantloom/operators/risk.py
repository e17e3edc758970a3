"""Risk of strategies and positions: measures by strategy, tails, gates, crises, shocks and limits.

Return tables have a row for each strategy and month: (strategy, date, r).  Windows run inside a strategy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import normal_cdf


def in_order():
    return Window.partitionBy("strategy").orderBy("date")


def so_far():
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def part(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a, b)


def equity(returns: DataFrame) -> DataFrame:
    """returns with equity (from 1) and drawdown from the highest equity so far, the start included."""
    grown = returns.withColumn("equity", F.product(1 + F.col("r")).over(so_far()))
    return grown.withColumn("drawdown", F.col("equity") / F.greatest(F.max("equity").over(so_far()), F.lit(1.0)) - 1)


def sample_skew(x: str) -> Column:
    """Skewness corrected for the sample's size."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: str) -> Column:
    """Excess kurtosis corrected for the sample's size."""
    n = F.count(x)
    return F.when(n > 3, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def tails(returns: DataFrame, *levels: float) -> DataFrame:
    """Value at risk var_NN of each strategy, and cvar_NN, the mean of the returns that don't exceed it."""
    edges = returns.groupBy("strategy").agg(*[F.percentile("r", F.lit(1 - p)).alias(f"var_{round(p * 100)}") for p in levels])
    below = lambda p: F.avg(F.when(F.col("r") <= F.col(f"var_{round(p * 100)}"), F.col("r")))
    return returns.join(edges, "strategy").groupBy("strategy", *[f"var_{round(p * 100)}" for p in levels]).agg(*[below(p).alias(f"cvar_{round(p * 100)}") for p in levels])


def metrics(returns: DataFrame, benchmark: DataFrame, rf: float) -> DataFrame:
    """Measures of each strategy against a benchmark (date, m) and a monthly riskless rate.

    Growth a year over the days between the first and last month; ratios by twelve months a year; strategies of one
    month have null ratios.  Ratios without spread are 0.
    """
    r, excess, over = F.col("r"), F.col("r") - rf, F.col("r") - F.col("m")
    both = equity(returns).join(benchmark, "date", "left")
    agg = both.groupBy("strategy").agg(
        F.count("r").alias("months"), (F.product(1 + r) - 1).alias("total"), F.greatest(F.date_diff(F.max("date"), F.min("date")) / 365.25, F.lit(0.01)).alias("years"),
        F.coalesce(part(F.avg(excess), F.stddev_samp(excess)) * F.sqrt(F.lit(12.0)), F.lit(0.0)).alias("sharpe"),
        F.coalesce(part(F.avg(excess), F.stddev_samp(F.when(r < 0, r))) * F.sqrt(F.lit(12.0)), F.lit(0.0)).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"), F.avg((r > 0).cast("double")).alias("win_rate"), (F.stddev_samp(r) * F.sqrt(F.lit(12.0))).alias("volatility"),
        F.avg(F.when(r > 0, r)).alias("avg_win"), F.avg(F.when(r < 0, r)).alias("avg_loss"), part(F.sum(F.when(r > 0, r)), F.abs(F.sum(F.when(r < 0, r)))).alias("profit_factor"),
        sample_skew("r").alias("skew"), sample_kurtosis("r").alias("kurtosis"),
        F.coalesce(part(F.covar_samp("r", "m"), F.var_samp(F.when(r.isNotNull(), F.col("m")))), F.lit(1.0)).alias("beta"), F.avg("m").alias("m"), (F.product(1 + F.col("m")) - 1).alias("m_total"),
        F.coalesce(part(F.avg(over), F.stddev_samp(over)) * F.sqrt(F.lit(12.0)), F.lit(0.0)).alias("information_ratio"),
    )
    yearly = lambda total: F.pow(1 + F.col(total), 1 / F.col("years")) - 1
    out = agg.withColumn("cagr", yearly("total")).withColumn("benchmark_cagr", yearly("m_total"))
    out = out.withColumn("alpha", F.col("cagr") - F.col("beta") * (F.pow(1 + F.col("m"), F.lit(12)) - 1)).withColumn("excess_return", F.col("cagr") - F.col("benchmark_cagr"))
    out = out.withColumn("calmar", F.coalesce(part(F.col("cagr"), F.abs("max_drawdown")), F.lit(0.0))).withColumn("payoff", part(F.col("avg_win"), F.abs("avg_loss")))
    return out.drop("m", "m_total", "years").join(tails(returns, 0.95), "strategy")


def tail_stats(returns: DataFrame) -> DataFrame:
    """Skewness, kurtosis, tails at 95 and 99 %, extremes, share of losses, ratio of mean win to mean loss, longest run of losses."""
    r = F.col("r")
    run = returns.withColumn("loss", (r < 0).cast("int")).withColumn("run", F.row_number().over(in_order()) - F.sum("loss").over(so_far()))
    longest = run.groupBy("strategy", "run").agg(F.sum("loss").alias("n")).groupBy("strategy").agg(F.max("n").alias("longest_losses"))
    simple = returns.groupBy("strategy").agg(sample_skew("r").alias("skew"), sample_kurtosis("r").alias("kurtosis"), F.min("r").alias("worst"), F.max("r").alias("best"), F.avg((r < 0).cast("double")).alias("loss_share"), part(F.avg(F.when(r > 0, r)), F.abs(F.avg(F.when(r < 0, r)))).alias("win_loss"))
    return simple.join(tails(returns, 0.95, 0.99), "strategy").join(longest, "strategy")


def deflated_sharpe(returns: DataFrame, trials: int) -> DataFrame:
    """The z-score of each strategy's monthly Sharpe ratio against the best of so many trials without skill, the probability of skill
    (dsr) and of as much without it (p); 0, 0.5 and 0.5 under 12 months."""
    agg = returns.groupBy("strategy").agg(F.count("r").alias("n"), (F.avg("r") / (F.stddev_samp("r") + 1e-10)).alias("s"), sample_skew("r").alias("g"), sample_kurtosis("r").alias("k"))
    root = F.sqrt(2 * F.ln(F.lit(float(max(trials, 2)))))
    best = (root - (F.ln(F.pi()) + 0.5772) / (2 * root)) / F.sqrt("n")
    s, g = F.col("s"), F.col("g")
    spread = F.sqrt((1 + 0.5 * s * s - g * s + (F.col("k") + 3) / 4 * s * s) / F.greatest(F.col("n") - 1, F.lit(1)))
    z = agg.select("strategy", "n", F.when(F.col("n") < 12, 0.0).otherwise((s - best) / (spread + 1e-10)).alias("z"))
    return z.withColumn("dsr", F.expr(normal_cdf("z"))).withColumn("p", 1 - F.col("dsr"))


#: The usual gates, as measure, comparison, threshold and category.
GATES = (("sharpe", ">", 1.5, "backtest"), ("max_drawdown", ">", -0.2, "backtest"), ("calmar", ">", 1.0, "backtest"), ("sortino", ">", 2.0, "backtest"), ("win_rate", ">", 0.55, "backtest"))


def gate_check(values: DataFrame, rules=GATES) -> DataFrame:
    """strategy, name, value, threshold, op, category and passed for each rule; values has a column for each measure."""
    table = values.sparkSession.createDataFrame(list(rules), "name string, op string, threshold double, category string")
    names = sorted({r[0] for r in rules})
    tall = values.select("strategy", *[F.col(n).cast("double").alias(n) for n in names]).unpivot(["strategy"], names, "name", "value")
    v, t = F.col("value"), F.col("threshold")
    passed = F.when(F.col("op") == ">", v > t).when(F.col("op") == "<", v < t).when(F.col("op") == ">=", v >= t).when(F.col("op") == "==", v == t).otherwise(F.lit(False))
    return tall.join(F.broadcast(table), "name").withColumn("passed", F.coalesce(passed, F.lit(False)))  # a row for each rule


def gate_summary(checks: DataFrame) -> DataFrame:
    """Gates and passed ones by strategy and category, and over all of a strategy's (category null)."""
    return checks.groupingSets([["strategy", "category"], ["strategy"]], "strategy", "category").agg(F.count("*").alias("gates"), F.count_if("passed").alias("passed"))


def monthly_table(returns: DataFrame) -> DataFrame:
    """A row for each strategy and year: the twelve months' returns and the year's compounded one."""
    by = returns.groupBy("strategy", F.year("date").alias("year"))
    wide = by.pivot("month", list(range(1, 13))) if "month" in returns.columns else returns.withColumn("month", F.month("date")).groupBy("strategy", F.year("date").alias("year")).pivot("month", list(range(1, 13)))
    months = wide.agg(F.first("r")).select("strategy", "year", *[F.col(str(k)).alias(f"m{k:02d}") for k in range(1, 13)])
    return months.join(by.agg((F.product(1 + F.col("r")) - 1).alias("total")), ["strategy", "year"])


def histogram(returns: DataFrame, bins: int) -> DataFrame:
    """strategy, bin (from 0), low edge and count of equal bins from the smallest to the largest return."""
    ends = returns.groupBy("strategy").agg(F.min("r").alias("low"), F.max("r").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    bin_ = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("r") - F.col("low"), width)), F.lit(0))).cast("int")
    return returns.join(ends, "strategy").groupBy("strategy", bin_.alias("bin")).agg(F.first(F.col("low") + bin_ * width).alias("edge"), F.count("*").alias("n"))


def crisis_replay(returns: DataFrame, benchmark: DataFrame, crises: list[tuple[str, str, str]]) -> DataFrame:
    """Compounded return of strategy and benchmark, excess, and drawdown, inside each window of months (both ends belong to it)."""
    windows = returns.sparkSession.createDataFrame(crises, "crisis string, first string, last string").select("crisis", F.to_date("first").alias("first"), F.last_day(F.to_date("last")).alias("last"))
    inside = returns.join(benchmark, "date", "left").join(F.broadcast(windows), F.col("date").between(F.col("first"), F.col("last")))  # a row for each crisis
    order = Window.partitionBy("crisis", "strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = inside.withColumn("equity", F.product(1 + F.col("r")).over(order))
    grown = grown.withColumn("drawdown", F.col("equity") / F.max("equity").over(order) - 1)
    out = grown.groupBy("crisis", "strategy").agg((F.product(1 + F.col("r")) - 1).alias("total"), (F.product(1 + F.col("m")) - 1).alias("benchmark"), F.min("drawdown").alias("max_drawdown"), F.count("*").alias("months"))
    return out.withColumn("excess", F.col("total") - F.col("benchmark"))


def synthetic_shocks(returns: DataFrame, shocks: tuple[float, ...] = (0.0, -0.1, -0.2, -0.3, -0.5)) -> DataFrame:
    """Sharpe ratio and drawdown of each strategy with its middle month replaced by a shock (0: left as it is), and with its spread doubled."""
    whole = Window.partitionBy("strategy")
    placed = returns.withColumn("k", F.row_number().over(in_order()) - 1).withColumn("mid", F.floor(F.count("*").over(whole) / 2)).withColumn("mean", F.avg("r").over(whole))
    cases = [F.struct(F.lit(f"shock {x:+.0%}" if x else "baseline").alias("scenario"), (F.when(F.col("k") == F.col("mid"), F.lit(x)).otherwise(F.col("r")) if x else F.col("r")).alias("r")) for x in shocks]
    cases.append(F.struct(F.lit("spread x2").alias("scenario"), (F.col("mean") + 2 * (F.col("r") - F.col("mean"))).alias("r")))
    tall = placed.select("strategy", "date", F.explode(F.array(*cases)).alias("c")).select("strategy", "date", "c.scenario", "c.r")
    order = Window.partitionBy("strategy", "scenario").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = tall.withColumn("equity", F.product(1 + F.col("r")).over(order))
    grown = grown.withColumn("drawdown", F.col("equity") / F.max("equity").over(order) - 1)
    return grown.groupBy("strategy", "scenario").agg(F.coalesce(part(F.avg("r"), F.stddev_samp("r")) * F.sqrt(F.lit(12.0)), F.lit(0.0)).alias("sharpe"), F.min("drawdown").alias("max_drawdown"))


def scenario_losses(returns: DataFrame, scenarios: list[tuple[str, float, int]]) -> DataFrame:
    """Loss of each strategy in a scenario (name, market shock, days): the shock times volatility over 1 %, twice at most; and its worst day."""
    table = returns.sparkSession.createDataFrame(scenarios, "scenario string, shock double, days int")
    vol = returns.groupBy("strategy").agg(F.coalesce(F.stddev_samp("r"), F.lit(0.01)).alias("vol"))
    loss = F.col("shock") * F.least(F.col("vol") / 0.01, F.lit(2.0))
    return vol.join(F.broadcast(table)).select("strategy", "scenario", loss.alias("loss"), F.when(F.col("days") > 1, loss / F.col("days") * 3).otherwise(loss).alias("worst_day"))  # strategies by scenarios: the report's rows


def yearly_attribution(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Compounded strategy, benchmark and difference by strategy and year, over months that both have."""
    both = returns.join(benchmark, "date").where("r is not null and m is not null")
    grow = lambda x: F.product(1 + x) - 1
    return both.groupBy("strategy", F.year("date").alias("year")).agg(grow(F.col("r")).alias("total"), grow(F.col("m")).alias("benchmark"), grow(F.col("r") - F.col("m")).alias("excess"))


def strategy_correlation(returns: DataFrame) -> DataFrame:
    """Correlation of each pair of strategies over the months that both have."""
    a, b = returns.selectExpr("date", "strategy as a", "r as x"), returns.selectExpr("date", "strategy as b", "r as y")
    return a.join(b, "date").where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("correlation"), F.count("*").alias("months"))


def marginal_risk(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Each strategy's contribution to the volatility of the weighted portfolio, its share, volatility a year and beta to the portfolio.

    Over months that all weighted strategies have.  Covariances with the portfolio stand for the rows of the covariance matrix.
    """
    held = returns.join(weights, "strategy")
    n = weights.count()
    whole = held.withColumn("p", F.sum(F.col("w") * F.col("r")).over(Window.partitionBy("date"))).withColumn("k", F.count("r").over(Window.partitionBy("date"))).where(F.col("k") == n)
    agg = whole.groupBy("strategy").agg(F.first("w").alias("w"), F.covar_samp("r", "p").alias("cov"), F.var_samp("p").alias("var"), (F.stddev_samp("r") * F.sqrt(F.lit(12.0))).alias("volatility"))
    return agg.select("strategy", (F.col("w") * F.col("cov") / F.sqrt("var")).alias("contribution"), (F.col("w") * F.col("cov") / F.col("var")).alias("share"), "volatility", (F.col("cov") / F.col("var")).alias("beta"))


def risk_budget(returns: DataFrame, total: float, periods: int = 12) -> DataFrame:
    """Weights by inverse volatility, scaled so that the portfolio's volatility a year is total, twice at most; equal under 20 dates."""
    vol = returns.groupBy("strategy").agg((F.stddev_samp("r") * F.sqrt(F.lit(float(periods)))).alias("vol"), F.count("r").alias("n"))
    one = Window.partitionBy(F.lit(0))  # a row for each strategy
    filled = vol.withColumn("vol", F.coalesce(F.when(F.col("vol") > 0, F.col("vol")), F.avg(F.when(F.col("vol") > 0, F.col("vol"))).over(one)))
    raw = filled.withColumn("w", 1 / F.col("vol") / F.sum(1 / F.col("vol")).over(one)).withColumn("k", F.count("*").over(one))
    series = returns.join(raw.select("strategy", "w"), "strategy").groupBy("date").agg(F.sum(F.col("w") * F.col("r")).alias("p"))
    scale = series.agg(F.least(F.coalesce(F.try_divide(F.lit(total), F.stddev_samp("p") * F.sqrt(F.lit(float(periods)))), F.lit(1.0)), F.lit(2.0)).alias("scale"))
    return raw.crossJoin(F.broadcast(scale)).select("strategy", F.when(F.col("n") < 20, 1 / F.col("k")).otherwise(F.col("w") * F.coalesce("scale", F.lit(1.0))).alias("weight"))  # one row of scale


def kelly(returns: DataFrame) -> DataFrame:
    """Half the fraction that grows fastest with each strategy's win rate, mean win and mean loss, from 0 to 0.25."""
    r = F.col("r")
    agg = returns.groupBy("strategy").agg(F.avg((r > 0).cast("double")).alias("p"), F.avg(F.when(r > 0, r)).alias("win"), F.abs(F.avg(F.when(r < 0, r))).alias("loss"))
    b = part(F.col("win"), F.col("loss"))
    return agg.select("strategy", F.greatest(F.least(F.coalesce(part(F.col("p") * b - (1 - F.col("p")), b) / 2, F.lit(0.0)), F.lit(0.25)), F.lit(0.0)).alias("fraction"))


def vol_target_scale(returns: DataFrame, n: int, target: float, low: float, high: float, periods: int = 12) -> DataFrame:
    """strategy, date, scale: the target over the volatility a year of the n months before, within bounds; 1 before there are n."""
    past = in_order().rowsBetween(-n, -1)
    vol = F.when(F.count("r").over(past) >= n, F.stddev_samp("r").over(past) * F.sqrt(F.lit(float(periods))))
    return returns.withColumn("v", vol).select("strategy", "date", F.when(F.col("v") >= 1e-8, F.greatest(F.least(target / F.col("v"), F.lit(high)), F.lit(low))).otherwise(1.0).alias("scale"))


def drawdown_scale(returns: DataFrame, steps: tuple[tuple[float, float], ...]) -> DataFrame:
    """strategy, date, scale by the drawdown at the end of the month before; steps: (drawdown beyond, scale), the deepest first."""
    before = F.lag("drawdown").over(in_order())
    scale = F.lit(1.0)
    for depth, x in reversed(steps):
        scale = F.when(before < -depth, x).otherwise(scale)
    return equity(returns).select("strategy", "date", F.coalesce(scale, F.lit(1.0)).alias("scale"))


def drawdown_check(returns: DataFrame, threshold: float = 0.08) -> DataFrame:
    """Each strategy's drawdown at its last month, what exposure it allows (1, 0.5, or 0.2 beyond 15 %) and the alert it raises."""
    last = equity(returns).groupBy("strategy").agg(F.max_by("drawdown", "date").alias("drawdown"))
    d = F.col("drawdown")
    level = F.when(d < -0.15, "critical").when(d < -threshold, "warning")
    return last.select("strategy", "drawdown", F.when(d < -0.15, 0.2).when(d < -threshold, 0.5).otherwise(1.0).alias("scale"), level.alias("level"))


# Positions: (account, asset, sector, kind, market_value), and greeks.


def position_alerts(positions: DataFrame, equity_col: str = "equity") -> DataFrame:
    """Positions above 8 % of their account's equity, with weight and level."""
    w = F.abs("market_value") / F.col(equity_col)
    level = F.when(w > 0.2, "red").when(w > 0.1, "orange").when(w > 0.08, "yellow")
    return positions.where(F.col(equity_col) > 0).select("account", "asset", w.alias("weight"), level.alias("level")).where("level is not null")


def sector_alerts(positions: DataFrame) -> DataFrame:
    """Sectors above a quarter of their account's gross value, with weight and level."""
    by = positions.groupBy("account", F.coalesce("sector", F.lit("unknown")).alias("sector")).agg(F.sum(F.abs("market_value")).alias("gross"))
    w = part(F.col("gross"), F.sum("gross").over(Window.partitionBy("account")))
    level = F.when(w > 0.3, "orange").when(w > 0.25, "yellow")
    return by.select("account", "sector", w.alias("weight"), level.alias("level")).where("level is not null")


def correlation_alerts(positions: DataFrame, returns: DataFrame, top: int = 10, threshold: float = 0.7) -> DataFrame:
    """Pairs among an account's largest positions whose returns correlate beyond the threshold, over dates that all of them have."""
    place = Window.partitionBy("account").orderBy(F.abs("market_value").desc(), "asset")
    largest = positions.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top).select("account", "asset")
    held = returns.select("asset", "date", "ret").where("ret is not null").join(largest, "asset")
    n = largest.groupBy("account").agg(F.count("*").alias("n"))
    whole = held.withColumn("k", F.count("*").over(Window.partitionBy("account", "date"))).join(n, "account").where("k = n")
    a, b = whole.selectExpr("account", "date", "asset as a", "ret as x"), whole.selectExpr("account", "date", "asset as b", "ret as y")
    pairs = a.join(b, ["account", "date"]).where("a < b").groupBy("account", "a", "b").agg(F.corr("x", "y").alias("correlation"))
    c = F.abs("correlation")
    return pairs.where(c > threshold).withColumn("level", F.when(c > 0.9, "red").when(c > 0.8, "orange").otherwise("yellow"))


def position_var(positions: DataFrame, returns: DataFrame, p: float = 0.95) -> DataFrame:
    """Value at risk of each position from its asset's returns; 0 with fewer than 20."""
    q = returns.where("ret is not null").groupBy("asset").agg(F.percentile("ret", F.lit(1 - p)).alias("q"), F.count("*").alias("n"))
    return positions.join(q, "asset", "left").select("account", "asset", F.when(F.col("n") >= 20, F.col("market_value") * F.col("q")).otherwise(0.0).alias("value_at_risk"))


GREEKS = ("delta", "gamma", "theta", "vega")


def greeks_check(options: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Each account's sum of greek times quantity, and its level where it is outside its limits (red beyond twice a limit)."""
    totals = options.groupBy("account").agg(*[F.sum(F.coalesce(g, F.lit(0.0)) * F.col("quantity")).alias(g) for g in GREEKS])
    tall = totals.unpivot(["account"], list(GREEKS), "greek", "value")
    table = options.sparkSession.createDataFrame([(k, float(a), float(b)) for k, (a, b) in limits.items()], "greek string, low double, high double")
    v = F.col("value")
    level = F.when(v < F.col("low"), F.when(v < 2 * F.col("low"), "red").otherwise("orange")).when(v > F.col("high"), F.when(v > 2 * F.col("high"), "red").otherwise("orange"))
    return tall.join(F.broadcast(table), "greek", "left").select("account", "greek", "value", level.alias("level"))  # four rows of limits


def greek_shock(options: DataFrame, shock: float = 0.1) -> DataFrame:
    """Profit of each position, and of each account (asset null), when prices fall by shock and volatilities rise by 50 points times it."""
    q, s = F.col("quantity"), -F.col("underlying_price") * shock
    parts = options.select("account", "asset", (F.col("delta") * q * s).alias("delta_pnl"), (0.5 * F.col("gamma") * q * s * s).alias("gamma_pnl"), (F.col("vega") * q * shock * 50).alias("vega_pnl"))
    out = parts.groupingSets([["account", "asset"], ["account"]], "account", "asset").agg(*[F.sum(c).alias(c) for c in ("delta_pnl", "gamma_pnl", "vega_pnl")])
    return out.withColumn("total_pnl", F.col("delta_pnl") + F.col("gamma_pnl") + F.col("vega_pnl"))


def margin_check(positions: DataFrame, equity_col: str = "equity") -> DataFrame:
    """Each account's margin by kind of position (stock 50 %, bought options in full, sold ones 120 %), its share of equity and state."""
    gross = F.abs("market_value")
    need = gross * F.when(F.col("kind") == "option_long", 1.0).when(F.col("kind") == "option_short", 1.2).otherwise(0.5)
    by = positions.groupBy("account").agg(F.sum(need).alias("margin"), F.first(equity_col).alias("equity"))
    ratio = F.when(F.col("equity") > 0, F.col("margin") / F.col("equity"))
    return by.select("account", "margin", ratio.alias("ratio"), F.when(ratio.isNull() | (ratio > 0.9), "call").when(ratio > 0.7, "high").otherwise("normal").alias("state"))


#: What an alert of each level asks for.
ACTIONS = {"red": ("reduce", 0.2), "orange": ("reduce", 0.5), "yellow": ("watch", 1.0), "green": ("none", 1.0)}


def evaluate(*alerts: DataFrame, accounts: DataFrame) -> DataFrame:
    """All alerts (account, source, target, level) with what they ask for; accounts without one are green."""
    table = accounts.sparkSession.createDataFrame([(k, *v) for k, v in ACTIONS.items()], "level string, action string, scale double")
    found = alerts[0]
    for more in alerts[1:]:
        found = found.unionByName(more)
    calm = accounts.select("account").distinct().join(found.select("account").distinct(), "account", "left_anti").select("account", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target"), F.lit("green").alias("level"))
    return found.unionByName(calm).join(F.broadcast(table), "level")  # four levels


# Metric streams: (strategy, metric, date, x).


def metric_summary(values: DataFrame) -> DataFrame:
    """The last value of each metric, mean, spread, its distance in spreads, extremes and count."""
    agg = values.where("x is not null").groupBy("strategy", "metric").agg(F.max_by("x", "date").alias("current"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread"), F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))
    return agg.withColumn("z", F.coalesce(part(F.col("current") - F.col("mean"), F.when(F.col("spread") >= 1e-10, F.col("spread"))), F.lit(0.0)))


def health_score(z: Column, drawdown: Column, isolation: Column, cusum: Column) -> Column:
    """0 to 100 from the largest distance, the drawdown, the isolation score and the CUSUM ratio, weighted 30, 30, 20 and 20 %."""
    a, d = F.abs(z), F.abs(drawdown)
    away = 100 - F.when(a <= 1, 0.0).when(a <= 2.5, (a - 1) / 1.5 * 30).when(a <= 3.5, 30 + (a - 2.5) * 30).otherwise(F.least(F.lit(100.0), 60 + (a - 3.5) * 20))
    down = F.when(d <= 0.02, 100.0).when(d <= 0.08, 100 - (d - 0.02) / 0.06 * 40).when(d <= 0.15, 60 - (d - 0.08) / 0.07 * 40).otherwise(F.greatest(F.lit(0.0), 20 - (d - 0.15) * 200))
    odd = F.when(isolation >= 0.1, 100.0).when(isolation >= 0, 70 + isolation * 300).when(isolation >= -0.3, 70 + isolation / 0.3 * 70).otherwise(0.0)
    shift = F.when(cusum <= 0.5, 100 - cusum * 40).when(cusum <= 1, 80 - (cusum - 0.5) * 80).otherwise(F.greatest(F.lit(0.0), 40 - (cusum - 1) * 80))
    parts = [(F.when(x.isNotNull(), y), w) for x, y, w in ((a, away, 0.3), (d, down, 0.3), (isolation, odd, 0.2), (cusum, shift, 0.2))]  # what is missing counts as well
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), sum((w * F.coalesce(x, F.lit(100.0)) for x, w in parts), F.lit(0.0)))), 1)
