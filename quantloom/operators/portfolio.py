"""From signals to weights, orders, costs and returns of a portfolio that is set anew each month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .performance import GROWTH

_EQUITY = f"round({GROWTH.format(r='net', over=' over (order by date)')}, 6) as equity"
#: Gross exposure that positions share.
EXPOSURE = 1.3


def target_weights(signals: DataFrame, longs: int, shorts: int) -> DataFrame:
    """Equal weights of the largest (positive) and smallest signals; dates with fewer names than both need have none."""
    places = signals.where("signal is not null").selectExpr("date", "asset", "row_number() over (partition by date order by signal desc, asset) as up", "row_number() over (partition by date order by signal, asset desc) as down", "count(*) over (partition by date) as n")
    return places.where(f"n >= {longs + shorts} and (up <= {longs} or down <= {shorts})").selectExpr("date", "asset", f"case when up <= {longs} then 1e0 / {longs} else -1e0 / {shorts} end as weight")


def held(weights: DataFrame, dates: DataFrame) -> DataFrame:
    """date, asset and before: the weights of the last date with targets before each of dates; positions stay until there are new ones."""
    targets = weights.select("date").distinct().withColumn("set", F.col("date"))
    order = Window.partitionBy(F.lit(0)).orderBy("date")  # a row for each date
    calendar = dates.select("date").union(weights.select("date")).distinct().join(targets, "date", "left")
    calendar = calendar.select("date", F.last("set", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("set"))
    return calendar.join(weights.select(F.col("date").alias("set"), "asset", F.col("weight").alias("before")), "set").drop("set")


def rebalance_orders(weights: DataFrame) -> DataFrame:
    """Positions that open, close or change sides on dates with targets, the first ones included. A change of sides is two trades."""
    dates = weights.select("date").distinct()
    both = weights.join(held(weights, dates), ["date", "asset"], "full")
    action = (
        F.when(F.col("before").isNull(), F.when(F.col("weight") > 0, "LONG").otherwise("SHORT"))
        .when(F.col("weight").isNull(), F.when(F.col("before") > 0, "CLOSE_LONG").otherwise("CLOSE_SHORT"))
        .when(F.col("before") * F.col("weight") < 0, F.when(F.col("weight") > 0, "TO_LONG").otherwise("TO_SHORT"))
    )
    return both.select("date", "asset", action.alias("action"), F.when(action.startswith("TO_"), 2).otherwise(1).cast("long").alias("trades")).where("action is not null")


def replay(weights: DataFrame, panel: DataFrame, rate: float) -> DataFrame:
    """Return before and after costs, and equity, by date, from the first targets on; missing returns count as 0.

    A date earns what the weights set before it earn, then pays for its trades: each costs the rate times the date's
    mean position, which is EXPOSURE over the number of positions.
    """
    earned = held(weights, panel.select("date").distinct()).join(panel.select("date", "asset", "ret"), ["date", "asset"], "left").groupBy("date").agg(F.round(F.sum(F.col("before") * F.coalesce("ret", F.lit(0.0))), 9).alias("gross"))
    trades = rebalance_orders(weights).groupBy("date").agg(F.sum("trades").alias("trades"))
    positions = weights.groupBy("date").agg(F.count("*").alias("positions"))
    paid = positions.join(trades, "date", "left").select("date", F.coalesce("trades", F.lit(0)).alias("trades"), (F.coalesce("trades", F.lit(0)) * EXPOSURE / F.col("positions") * rate).alias("cost"))
    both = earned.join(paid, "date", "full").selectExpr("date", "coalesce(gross, 0e0) as gross", "coalesce(trades, 0) as trades", "coalesce(cost, 0e0) as cost")
    return both.selectExpr("date", "gross", "trades", "round(gross - cost, 9) as net").selectExpr("*", _EQUITY)


#: Cost parameters in shares of a trade: commission, spread, impact, borrowing a year, fee on sales.
COMMISSION, SPREAD, IMPACT, BORROW, SALES_FEE = 1e-4, 5e-4, 0.3, 30e-4, 0.8e-4


def rebalance_costs(weights: DataFrame, volumes: DataFrame, model: str, capital: float) -> DataFrame:
    """date and the cost of its trades as a share of capital, by one of the models fixed, tiered, linear, sqrt, full and default.

    volumes: date, asset and adv, dollars traded a day (1e4 at least; 1e9 where it is unknown).  capital stands for the
    portfolio's value on all dates.  linear, sqrt and full add impact by the share of adv, fees and borrowing.
    """
    orders = rebalance_orders(weights)
    per = weights.groupBy("date").agg((EXPOSURE / F.count("*")).alias("mean_pos"), F.sum(F.when(F.col("weight") < 0, -F.col("weight")).otherwise(0.0)).alias("short"))
    both = orders.join(volumes, ["date", "asset"], "left").join(per, "date")
    pos = F.col("mean_pos")
    if model in ("fixed", "tiered", "default"):
        value = capital * pos
        rate = {"fixed": F.lit(COMMISSION + SPREAD / 2), "tiered": F.when(value < 1e4, 0.002).when(value < 1e5, 0.001).otherwise(0.0005), "default": F.lit(0.001 + SALES_FEE / 2)}[model]
        return both.groupBy("date").agg(F.sum(F.col("trades") * pos * rate).alias("cost"))
    part = capital * pos / (F.coalesce(F.greatest("adv", F.lit(1e4)), F.lit(1e9)) + 1e-6)
    impact = IMPACT * (F.least(part, F.lit(0.5)) if model == "linear" else F.sqrt(F.least(part, F.lit(1.0)))) * pos
    each = (COMMISSION + SPREAD / 2) * pos + impact + SALES_FEE * pos / 2
    return both.groupBy("date").agg((F.sum(each) + F.first("short") * BORROW / 12).alias("cost"))


def entries_exits(signals: DataFrame, n: int, every: int) -> DataFrame:
    """date, asset, event (entry or exit) of the n best names at each every-th date."""
    dates = signals.where("signal is not null").select("date").distinct().withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1).where(F.col("i") % every == 0)  # a row for each date
    best = signals.where("signal is not null").join(F.broadcast(dates), "date").withColumn("k", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("signal"), "asset"))).where(F.col("k") <= n)
    now, then = best.select("i", "asset"), best.select((F.col("i") + every).alias("i"), "asset")
    events = now.join(then, ["i", "asset"], "left_anti").withColumn("event", F.lit("entry")).unionByName(then.join(now, ["i", "asset"], "left_anti").withColumn("event", F.lit("exit")))
    return events.join(F.broadcast(dates), "i").select("date", "asset", "event")


def ma_crossover(panel: DataFrame, fast: int, slow: int) -> DataFrame:
    """asset, date, position and its return: long from the date after the fast mean crosses above the slow one until it crosses below."""
    by = Window.partitionBy("asset").orderBy("date")
    mean = lambda n: F.when(F.count("price").over(by.rowsBetween(1 - n, 0)) >= n, F.avg("price").over(by.rowsBetween(1 - n, 0)))
    x = panel.withColumn("above", (F.round(mean(fast) - mean(slow), 9) > 0).cast("int"))
    position = F.coalesce(F.lag("above").over(by), F.lit(0))
    return x.select("asset", "date", position.alias("position"), (position * F.coalesce("ret", F.lit(0.0))).alias("earned"))


def risk_limits(weights: DataFrame, most: float, long_total: float, short_total: float) -> DataFrame:
    """Weights cut at `most` and scaled so that longs and shorts don't exceed their totals."""
    cut = weights.withColumn("w", F.greatest(F.least("weight", F.lit(most)), F.lit(-most)))
    side = Window.partitionBy("date", F.col("w") > 0)
    total = F.sum(F.abs("w")).over(side)
    return cut.select("date", "asset", (F.col("w") * F.least(F.lit(1.0), F.try_divide(F.when(F.col("w") > 0, F.lit(long_total)).otherwise(F.lit(short_total)), total))).alias("weight"))


def order_plan(targets: DataFrame, positions: DataFrame, prices: DataFrame, capital: float, lot: int = 100) -> DataFrame:
    """asset, side and shares: what is held but no target is sold, targets that aren't held are bought in whole lots."""
    sells = positions.join(targets, "asset", "left_anti").select("asset", F.lit("sell").alias("side"), F.col("shares").cast("long").alias("shares"))
    n = targets.count()
    lots = F.floor(F.try_divide(F.lit(capital / max(n, 1)), F.col("price")) / lot) * lot
    buys = targets.join(positions, "asset", "left_anti").join(prices, "asset").select("asset", F.lit("buy").alias("side"), lots.cast("long").alias("shares")).where(F.col("shares") >= lot)
    return sells.unionByName(buys)


def weights_sql(signals: str, longs: int, shorts: int) -> str:
    return f"""select date, asset, case when up <= {longs} then 1e0 / {longs} else -1e0 / {shorts} end as weight from (
      select date, asset, row_number() over (partition by date order by signal desc, asset) as up, row_number() over (partition by date order by signal, asset desc) as down, count(*) over (partition by date) as n
      from ({signals}) where signal is not null) where n >= {longs + shorts} and (up <= {longs} or down <= {shorts})"""


def held_sql(weights: str, dates: str) -> str:
    return f"select d.date, w.asset, w.weight as before from ({dates}) d join ({weights}) w on w.date = (select max(x.date) from ({weights}) x where x.date < d.date)"


def orders_sql(weights: str) -> str:
    return f"""with w as materialized ({weights}), s as (select date, lag(date) over (order by date) as prev from (select distinct date from w)), h as (select s.date, asset, weight as before from s join w on w.date = s.prev),
    o as (select date, asset, case when before is null and weight > 0 then 'LONG' when before is null then 'SHORT' when weight is null and before > 0 then 'CLOSE_LONG' when weight is null then 'CLOSE_SHORT'
      when before < 0 and weight > 0 then 'TO_LONG' when before > 0 and weight < 0 then 'TO_SHORT' end as action from w full join h using (date, asset))
    select date, asset, action, case when action in ('TO_LONG', 'TO_SHORT') then 2 else 1 end::bigint as trades from o where action is not null"""


def replay_sql(weights: str, panel: str, rate: float) -> str:
    return f"""with w as materialized ({weights}), p as materialized ({panel}), s as (select distinct date from w), c as (select d.date, max(s.date) as prev from (select distinct date from p) d join s on s.date < d.date group by 1),
    g as (select c.date, round(sum(weight * coalesce(ret, 0)), 9) as gross from c join w on w.date = c.prev left join p on p.asset = w.asset and p.date = c.date group by 1),
    t as (select date, count(*) as k, (select coalesce(sum(trades), 0) from ({orders_sql(weights)}) o where o.date = w.date)::bigint as trades from w group by 1),
    n as (select date, coalesce(gross, 0) as gross, coalesce(trades, 0) as trades, round(coalesce(gross, 0) - coalesce(trades * {EXPOSURE}e0 / k * {rate}e0, 0), 9) as net from g full join t using (date))
    select *, {_EQUITY} from n"""


def long_only(signals: DataFrame, panel: DataFrame, n: int, every: int, fee: float) -> DataFrame:
    """date, equity and names of buying the n best names alike at each every-th date with signals and holding them until the next; each
    name that enters or leaves pays fee on its share. Names drift between; a missing return is 0, a return of -1 or less ends a name."""
    events = entries_exits(signals, n, every)
    dates = Window.partitionBy(F.lit(0)).orderBy("date")  # a row for each date
    marked = signals.where("signal is not null").select("date").distinct().withColumn("i", F.row_number().over(dates) - 1).where(F.col("i") % every == 0)
    best = signals.where("signal is not null").join(F.broadcast(marked), "date").withColumn("k", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("signal"), "asset"))).where(F.col("k") <= n)
    held = best.select(F.col("date").alias("bought"), "asset")
    paid = events.groupBy("date").agg((F.count("*") * fee / n).alias("paid"))
    periods = marked.select(F.col("date").alias("bought"), F.lead("date").over(dates).alias("sold"))
    days = panel.select("date", "asset", F.coalesce("ret", F.lit(0.0)).alias("r"))
    inside = held.join(F.broadcast(periods), "bought").join(days, "asset").where("date > bought and (sold is null or date <= sold)")
    grown = inside.withColumn("g", F.expr(GROWTH.format(r="r", over=" over (partition by bought, asset order by date)")))
    mean = grown.groupBy("bought", "date").agg(F.avg("g").alias("m"), F.count("*").alias("names"))
    ends = mean.groupBy("bought").agg(F.max_by("m", "date").alias("whole")).join(paid.withColumnRenamed("date", "bought"), "bought", "left").withColumn("step", F.col("whole") * (1 - F.coalesce("paid", F.lit(0.0))))
    order = Window.partitionBy(F.lit(0)).orderBy("bought")  # a row for each rebalance
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("bought", "paid", F.when(F.coalesce(F.min("step").over(before), F.lit(1.0)) <= 0, 0.0).otherwise(F.exp(F.coalesce(F.sum(F.when(F.col("step") > 0, F.ln("step"))).over(before), F.lit(0.0)))).alias("carried"))
    both = mean.join(F.broadcast(carried), "bought")
    return both.select("date", F.round(F.col("carried") * (1 - F.coalesce("paid", F.lit(0.0))) * F.col("m"), 9).alias("equity"), "names")
