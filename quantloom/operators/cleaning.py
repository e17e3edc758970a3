"""Cleaning and preparing tables: prices, capitalisation, dates, filings, delistings, option symbols, snapshots, corporate actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_date():
    return Window.partitionBy("asset").orderBy("date")


def adjusted_price(price: Column, factor: Column) -> Column:
    """The size of a price over its adjustment factor; a missing or zero factor is 1."""
    return F.abs(price) / F.coalesce(F.nullif(factor, F.lit(0)), F.lit(1))


def market_cap(bars: DataFrame, shares: str, by: str = "month") -> DataFrame:
    """asset, date and cap: the first price of a period times the first number of shares."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("date")))
    return bars.groupBy("asset", F.to_date(F.date_trunc(by, "date")).alias("period")).agg((first("close") * first(shares)).alias("cap"))


def tradable(assets: DataFrame, least_price: float, least_volume: float) -> DataFrame:
    """Assets that may be traded and sold short, have a symbol of five letters at most without marks, and enough price and volume."""
    plain = (F.length("symbol") <= 5) & ~F.col("symbol").rlike(r"[.\-/]")
    return assets.where(F.col("tradable") & F.col("shortable") & plain & (F.col("price") >= least_price) & (F.col("volume") >= least_volume))


def business_month_end(date: Column) -> Column:
    """The last weekday of a date's month."""
    end = F.last_day(date)
    return F.date_sub(end, F.greatest(F.weekday(end) - 4, F.lit(0)))


def fundamental_ratios(filings: DataFrame) -> DataFrame:
    """Filings (asset, year, ni, assets, ceq, sale, gp, price, shares, dltt, dlc) with their ratios; null where a denominator is 0 or negative equity."""
    over = lambda a, b: F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)
    order = Window.partitionBy("asset").orderBy("year")
    growth = lambda c: F.try_divide(F.col(c), F.lag(c).over(order)) - 1
    cap, equity = F.col("price") * F.col("shares"), F.when(F.col("ceq") > 0, F.col("ceq"))
    return filings.select(
        "asset", "year", over("ni", equity).alias("roe"), over("ni", "assets").alias("roa"), over("assets", equity).alias("leverage"), over(equity, cap).alias("bm"), over("ni", cap).alias("ep"), over("gp", "assets").alias("gpa"), over("sale", cap).alias("sp"),
        growth("assets").alias("ag"), over("sale", "assets").alias("turnover"), growth("sale").alias("revenue_growth"), over(F.col("dltt") + F.col("dlc"), equity).alias("debt_equity"), growth("ni").alias("income_growth"),
    )


def latest_per_year(filings: DataFrame, at: str) -> DataFrame:
    """The last filing of each asset and year."""
    place = F.row_number().over(Window.partitionBy("asset", "year").orderBy(F.desc(at), F.desc("filing")))
    return filings.withColumn("_place", place).where("_place = 1").drop("_place")


EXCHANGES = {1: "NYSE", 2: "AMEX", 3: "NASDAQ"}


def latest_name(names: DataFrame) -> DataFrame:
    """Each asset's last name and the name of its exchange (null for other codes)."""
    code = F.create_map(*[F.lit(x) for pair in EXCHANGES.items() for x in pair])
    return names.groupBy("asset").agg(F.max_by(F.struct("name", "exchange"), F.struct("since", "name", "exchange")).alias("x")).select("asset", "x.name", F.try_element_at(code, F.col("x.exchange").cast("int")).alias("exchange"))


def delisting_return(code: Column, ret: Column) -> Column:
    """A missing return on delisting is -30 % for codes 500 to 599, else 0."""
    return F.coalesce(ret, F.when(code.between(500, 599), F.lit(-0.3)).otherwise(F.lit(0.0)))


def apply_delistings(panel: DataFrame, delistings: DataFrame) -> DataFrame:
    """panel with the month's delisting return put in (where ret is missing) or compounded; 0 changes nothing."""
    month = F.to_date(F.date_trunc("month", "date"))
    known = delistings.select("asset", F.to_date(F.date_trunc("month", "date")).alias("_month"), delisting_return(F.col("code"), F.col("dlret")).alias("_out")).where("_out <> 0")
    both = panel.withColumn("_month", month).join(known, ["asset", "_month"], "left")
    ret = F.when(F.col("_out").isNull(), F.col("ret")).otherwise(F.coalesce((1 + F.col("ret")) * (1 + F.col("_out")) - 1, F.col("_out")))
    return both.withColumn("ret", ret).drop("_month", "_out")


def extend_panel(history: DataFrame, newer: DataFrame) -> DataFrame:
    """history and the rows of newer after its last date."""
    last = history.agg(F.max("date").alias("_last"))
    return history.unionByName(newer.join(F.broadcast(last), F.col("_last").isNull() | (F.col("date") > F.col("_last"))).drop("_last"))  # one row


def lookback(panel: DataFrame, n: int) -> DataFrame:
    """The rows of the last n dates."""
    dates = panel.select("date").distinct().orderBy(F.desc("date")).limit(n)
    return panel.join(F.broadcast(dates), "date", "left_semi")  # n dates


OPTION = r"^([A-Z]{1,6})([0-9]{6})([CP])([0-9]{8})$"


def parse_option(symbol: Column) -> Column:
    """underlying, expiry, kind and strike of an option's symbol; null if it is none."""
    part = lambda k: F.regexp_extract(symbol, OPTION, k)
    day = F.try_to_timestamp(part(2), F.lit("yyMMdd")).cast("date")
    fields = F.struct(part(1).alias("underlying"), day.alias("expiry"), F.when(part(3) == "C", "call").otherwise("put").alias("kind"), (part(4).try_cast("double") / 1000).alias("strike"))
    return F.when(symbol.rlike(OPTION) & day.isNotNull(), fields)


def process_chain(quotes: DataFrame, spots: DataFrame, on: Column) -> DataFrame:
    """Option quotes (contract, bid, ask) with mid, moneyness and days to expiry; bad symbols, bids of 0 and expired ones are left out."""
    parsed = quotes.withColumn("o", parse_option(F.col("contract"))).where("o is not null and bid > 0").select("contract", "o.*", "bid", "ask")
    both = parsed.join(spots, "underlying").withColumn("dte", F.date_diff("expiry", on)).where("dte > 0 and spot > 0")
    return both.withColumn("mid", (F.col("bid") + F.col("ask")) / 2).withColumn("moneyness", F.col("strike") / F.col("spot"))


def to_market_symbol(code: Column) -> Column:
    """Six-digit codes with their market: 60 and 68 Shanghai, others Shenzhen; other texts stay."""
    return F.when(code.rlike("^[0-9]{6}$"), F.concat(code, F.when(code.rlike("^6[08]"), F.lit(".XSHG")).otherwise(F.lit(".XSHE")))).otherwise(code)


def from_market_symbol(symbol: Column) -> Column:
    return F.regexp_replace(symbol, r"\.(XSHG|XSHE)$", "")


def average_dollar_volume(panel: DataFrame, n: int = 20) -> DataFrame:
    """asset, date, adv: the mean of volume times price over n rows that all have both."""
    over, x = by_date().rowsBetween(1 - n, 0), F.col("volume") * F.col("close")
    return panel.select("asset", "date", F.when(F.count(x).over(over) >= n, F.avg(x).over(over)).alias("adv"))


def snapshot(trades: DataFrame, quotes: DataFrame, bars: DataFrame) -> DataFrame:
    """A row for each symbol: its last trade, last quote and last daily bar, null where there is none."""
    last = lambda df, cols, name: df.groupBy("symbol").agg(F.max(F.struct("ts", "event_id", *cols)).alias("x")).select("symbol", F.col("x.ts").alias(f"{name}_at"), *[F.col(f"x.{c}").alias(f"{name}_{c}") for c in cols])
    return last(trades, ["price"], "trade").join(last(quotes, ["bid", "ask"], "quote"), "symbol", "full").join(last(bars, ["close"], "bar"), "symbol", "full")


def most_active(bars: DataFrame, n: int) -> DataFrame:
    """The n assets of each date with the most volume."""
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("volume"), "asset"))
    return bars.where("volume is not null").select("date", "asset", "volume", "trade_count", place.alias("place")).where(F.col("place") <= n)


def between_dates(df: DataFrame, start: str | None, end: str | None, at: str = "date") -> DataFrame:
    """The rows from start to end; either may be open."""
    for day, keep in ((start, lambda x: F.col(at) >= x), (end, lambda x: F.col(at) <= x)):
        df = df if day is None else df.where(keep(F.lit(day).cast("date")))
    return df


def adjust_for_actions(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """bars with adj_close: prices before a split over its ratio, and before a dividend less its share of the price.

    actions: asset, ex_date, ratio (new over old shares) and cash.  One pass by asset: each bar carries the factor of
    the actions between it and the bar before, and factors are multiplied from the last bar back.
    """
    events = actions.groupBy("asset", F.col("ex_date").alias("date")).agg(F.product(F.coalesce("ratio", F.lit(1.0))).alias("_ratio"), F.sum(F.coalesce("cash", F.lit(0.0))).alias("_cash"))
    both = bars.join(events, ["asset", "date"], "full")
    ahead = by_date().rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("close", ignorenulls=True).over(ahead)
    factor = F.coalesce((1 - F.coalesce(F.try_divide(F.col("_cash"), before), F.lit(0.0))) / F.col("_ratio"), F.lit(1.0))
    later = by_date().rowsBetween(1, Window.unboundedFollowing)
    found = both.withColumn("_factor", factor).withColumn("_factor", F.coalesce(F.product("_factor").over(later), F.lit(1.0)))
    return found.where("close is not null").select(*bars.columns, (F.col("close") * F.col("_factor")).alias("adj_close"))


def book_summary(books: DataFrame) -> DataFrame:
    """Best bid and ask, middle, relative spread and depth of order books (bids and asks are arrays of price and size)."""
    best = lambda side, f: f(F.transform(side, lambda x: x["price"]))
    depth = lambda side: F.aggregate(side, F.lit(0.0), lambda a, x: a + x["size"])
    bid, ask = best("bids", F.array_max), best("asks", F.array_min)
    return books.select("symbol", "ts", bid.alias("bid"), ask.alias("ask"), ((bid + ask) / 2).alias("mid"), F.try_divide(ask - bid, (bid + ask) / 2).alias("spread"), depth("bids").alias("bid_depth"), depth("asks").alias("ask_depth"))


def default_features(panel: DataFrame, n: int = 20) -> DataFrame:
    """Return, its spread and the price's change over n rows; 0 where they are missing."""
    over = by_date().rowsBetween(1 - n, 0)
    vol = F.when(F.count("ret").over(over) >= n, F.stddev_samp("ret").over(over))
    return panel.select("asset", "date", *[F.coalesce(x, F.lit(0.0)).alias(c) for c, x in (("ret", F.col("ret")), ("vol", vol), ("momentum", F.try_divide(F.col("close"), F.lag("close", n).over(by_date())) - 1))])
