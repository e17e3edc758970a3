"""Signals of news, of screens and of options."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.frames import average_rank, dealt
from ..functions.normal import array_cdf, normal_cdf_sql
from ..functions.recursion import ewm

#: Words of the headline scorer.
POSITIVE = (
    "beat surge rally upgrade growth profit record breakthrough soar bullish outperform raise strong positive approve gain rise expand exceed boost buy recommend innovation deal partnership dividend "
    "buyback acquisition upbeat optimistic recover rebound accelerate impressive robust solid top jump advance improve upside momentum confident success win opportunity breakout high peak"
).split()
NEGATIVE = (
    "miss crash decline downgrade loss warning cut plunge bearish underperform lower weak negative reject fall drop shrink below sell layoff lawsuit recall investigation debt default bankruptcy "
    "fraud slump tumble disappoint concern risk fear volatility uncertainty struggle delay suspend halt probe fine penalty crisis downturn recession inflation overvalued shortfall writedown impairment"
).split()
AMPLIFIERS = "very significantly sharply dramatically massive huge record unprecedented extremely remarkably substantially considerably exceptionally extraordinary intensely".split()
NEGATIONS = "not no never neither nor cannot".split()


def score_headline(text: Column) -> Column:
    """-1 to 1: positive less negative words over all words; a negation turns the next such word around, an amplifier makes it 1.5, other words end both. 0 without words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(False).alias("no"), F.lit(False).alias("more"))

    def step(a: Column, w: Column) -> Column:
        weight = F.when(a["more"], 1.5).otherwise(1.0) * F.when(a["no"], -1.0).otherwise(1.0)
        after = lambda s, no, more: F.struct(s.alias("s"), no.alias("no"), more.alias("more"))
        off = F.lit(False)
        return (
            F.when(w.isin(NEGATIONS), after(a["s"], F.lit(True), a["more"])).when(w.isin(AMPLIFIERS), after(a["s"], a["no"], F.lit(True)))
            .when(w.isin(POSITIVE), after(a["s"] + weight, off, off)).when(w.isin(NEGATIVE), after(a["s"] - weight, off, off)).otherwise(after(a["s"], off, off))
        )

    raw = F.coalesce(F.try_divide(F.aggregate(words, start, step, lambda a: a["s"]), F.size(words)), F.lit(0.0))  # least and greatest skip nulls
    return F.greatest(F.least(raw, F.lit(1.0)), F.lit(-1.0))


def sentiment(news: DataFrame, as_of: Column, hours: float = 24, decay: float = 0.1) -> DataFrame:
    """symbol, sentiment and headlines of the hours before as_of: scores weighted by exp(-decay * age in hours)."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 3.6e9
    known = news.withColumn("age", age).where((F.col("age") >= 0) & (F.col("age") <= hours)).withColumn("w", F.exp(-decay * F.col("age")))
    return known.groupBy("symbol").agg((F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("sentiment"), F.count("*").alias("headlines"), F.count_distinct(F.when(F.col("source") != "", F.col("source"))).alias("sources"))


def share_rank(x: str, by: list[str] | None = None) -> Column:
    """Average-rank share of the group's values as -1 to 1."""
    one = by or [F.lit(0)]
    n = F.count(x).over(Window.partitionBy(*one).orderBy(F.col(x).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(F.col(x).isNotNull(), 2 * average_rank(x, *one) / n - 1)


def ranked_others(x: str, used: Column, by: list[str]) -> Column:
    """Rank of x among the group's used rows if there are two or more; other rows keep x."""
    n = F.count(x).over(Window.partitionBy(*by, used).orderBy(F.col(x).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(used & (n > 1), 2 * average_rank(x, *by, used) / n - 1).otherwise(F.col(x))


def attention(universe: DataFrame, actives: DataFrame) -> DataFrame:
    """universe (date, symbol) with the rank of its place among the date's most active names (date, symbol, place); others are 0."""
    n = actives.groupBy("date").agg(F.count("*").alias("n"))
    raw = universe.join(actives.join(n, "date"), ["date", "symbol"], "left").select("date", "symbol", F.coalesce((F.col("n") - F.col("place") + 1) / F.col("n"), F.lit(0.0)).alias("x"))
    return raw.select("date", "symbol", ranked_others("x", F.col("x") != 0, ["date"]).alias("signal"))


def mover_signal(universe: DataFrame, movers: DataFrame, contrarian: bool = False) -> DataFrame:
    """Ranks of the moves (date, symbol, side, pct) of gainers and losers: with them, or against them with moves above 5 counting 1.5 times; others are 0.

    A name on both sides is a loser for momentum, a gainer against it.
    """
    size = F.abs("pct") * (F.when(F.abs("pct") > 5, 1.5).otherwise(1.0) if contrarian else F.lit(1.0))
    sign = F.when(F.col("side") == "gainer", -1.0 if contrarian else 1.0).otherwise(1.0 if contrarian else -1.0)
    wins = "gainer" if contrarian else "loser"
    one = movers.groupBy("date", "symbol").agg(F.max_by(size * sign, F.struct((F.col("side") == wins).cast("int"), "pct")).alias("x"))
    raw = universe.join(one, ["date", "symbol"], "left").select("date", "symbol", F.coalesce("x", F.lit(0.0)).alias("x"))
    return raw.select("date", "symbol", ranked_others("x", F.col("x") != 0, ["date"]).alias("signal"))


def trade_intensity(universe: DataFrame, actives: DataFrame) -> DataFrame:
    """Ranks of minus trades over volume among the most active; others are 0."""
    x = -F.try_divide(F.col("trade_count"), F.col("volume"))
    raw = universe.join(actives.where("volume > 0"), ["date", "symbol"], "left").select("date", "symbol", x.alias("x"))
    return raw.select("date", "symbol", F.coalesce(F.when(F.count("x").over(Window.partitionBy("date")) > 1, share_rank("x", ["date"])).otherwise(F.col("x")), F.lit(0.0)).alias("signal"))


def persistence(actives: DataFrame, n_days: int) -> DataFrame:
    """symbol and the rank of its days among the last n_days' most active; names of one day are 0."""
    days = actives.select("date").distinct().orderBy(F.desc("date")).limit(n_days)
    recent = actives.join(F.broadcast(days), "date", "left_semi")  # n_days rows
    raw = recent.groupBy("symbol").agg((F.count_distinct("date") / days.count()).alias("x")).withColumn("k", F.lit(0)).withColumn("x", F.when(F.col("x") >= 2 / n_days, F.col("x")).otherwise(0.0))
    return raw.select("symbol", ranked_others("x", F.col("x") > 0, ["k"]).alias("signal"))


def weighted(parts: dict[str, tuple[DataFrame, float]], keys: list[str]) -> DataFrame:
    """keys and signal: the weighted sum of the parts' signals (missing ones 0), ranked by date."""
    tall = None
    for df, w in parts.values():
        one = df.select(*keys, (F.col("signal") * w).alias("x"))
        tall = one if tall is None else tall.unionByName(one)
    total = tall.groupBy(*keys).agg(F.round(F.sum("x"), 9).alias("x"))
    return total.select(*keys, share_rank("x", [k for k in keys if k == "date"]).alias("signal"))


def implied_vol_proxy(mid: Column, spot: Column, dte: Column) -> Column:
    """mid / (0.4 * spot * sqrt(years)); null outside (0, 5]."""
    v = F.try_divide(mid, 0.4 * spot * F.sqrt(F.when(dte > 0, dte) / 365))
    return F.when((v > 0) & (v <= 5), v)


def spread_proxy(bid: Column, ask: Column) -> Column:
    return F.try_divide(ask - bid, (bid + ask) / 2)


def option_measures(chain: DataFrame) -> DataFrame:
    """Volatility at the money, minus the skew of puts over calls, term structure, and put activity over call activity, by underlying."""
    c = chain.withColumn("iv", implied_vol_proxy(F.col("mid"), F.col("spot"), F.col("dte")))
    m, dte, near, put, call = F.col("moneyness"), F.col("dte"), F.col("dte").between(20, 60), F.col("kind") == "put", F.col("kind") == "call"
    mean = lambda when: F.avg(F.when(when, F.col("iv")))
    money = m.between(0.95, 1.05)
    agg = c.groupBy("underlying").agg(mean(money & near).alias("atm_iv"), mean(put & near & m.between(0.88, 0.92)).alias("p"), mean(call & near & m.between(1.08, 1.12)).alias("c"), mean(money & (dte > 5) & (dte < 30)).alias("short"), mean(money & (dte > 60)).alias("long"), F.sum(F.when(put, F.try_divide(F.lit(1.0), F.col("mid")))).alias("puts"), F.sum(F.when(call, F.try_divide(F.lit(1.0), F.col("mid")))).alias("calls"))
    return agg.select("underlying", "atm_iv", (-F.try_divide(F.col("p") - F.col("c"), F.col("c"))).alias("iv_skew"), F.try_divide(F.col("short"), F.col("long")).alias("term_structure"), F.try_divide(F.col("puts"), F.col("calls")).alias("put_call_ratio"))


def iv_rank(history: DataFrame, n: int) -> DataFrame:
    """asset, date and the share of its n values before that are below the value."""
    from ..functions.arrays import framed

    v = framed("iv", n, 1)
    return history.select("asset", "date", F.when(F.col("iv").isNotNull(), F.try_divide(F.size(F.filter(v, lambda y: y < F.col("iv"))), F.size(v))).alias("iv_rank"))


def option_signal(measures: DataFrame) -> DataFrame:
    """Ranks of 0.4 skew, less 0.3 put-call ratio, less 0.3 term structure, each as a standard score; null where one is missing, 0 for a single name."""
    one = Window.partitionBy(F.lit(0))  # a row for each underlying
    z = lambda c: F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(one), F.stddev_samp(c).over(one)), F.lit(0.0)))
    x = measures.select("underlying", F.round(0.4 * z("iv_skew") - 0.3 * z("put_call_ratio") - 0.3 * z("term_structure"), 9).alias("x"))
    return x.select("underlying", F.when(F.count("x").over(one) <= 1, F.when(F.col("x").isNotNull(), 0.0)).otherwise(share_rank("x")).alias("signal"))


#: The bracket of an implied volatility, and how often it is halved: to 1e-14.
LEAST_VOLATILITY, MOST_VOLATILITY, HALVINGS = 0.01, 5.0, 50


def implied_vol(chain: DataFrame, rate: float = 0.05) -> DataFrame:
    """chain (kind, mid, spot, strike, dte) with iv: the volatility at which the price is mid, found by halving a bracket; where mid
    is outside the bracket's prices the proxy, and null where that is none either.

    A quote costs far more than its bytes, so quotes are dealt to all tasks first; each halves the brackets of a batch by arrays, once.
    """

    cdf = array_cdf()

    def halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = lambda c, b=batch: np.asarray(b.column(c).to_numpy(zero_copy_only=False), "float64")
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            mid, spot, strike, dte = (number(c) for c in ("mid", "spot", "strike", "dte"))
            iv = np.full(len(mid), np.nan)
            good = np.flatnonzero((dte > 0) & (mid > 0) & (spot > 0) & (strike > 0) & ((kind == "call") | (kind == "put")))
            with np.errstate(all="ignore"):
                call, m, s, k, y = kind[good] == "call", mid[good], spot[good], strike[good], dte[good] / 365
                root, drift, later = np.sqrt(y), np.log(s / k), k * np.exp(-rate * y)

                def price(v: np.ndarray | float, at: np.ndarray | slice = slice(None)) -> np.ndarray:
                    p = (drift[at] + (rate + v * v / 2) * y[at]) / (v * root[at])
                    value = s[at] * cdf(p) - later[at] * cdf(p - v * root[at])
                    return value + np.where(call[at], 0.0, later[at] - s[at])

                within = (m > price(LEAST_VOLATILITY)) & (m < price(MOST_VOLATILITY))
                proxy = m / (0.4 * s * root)
                found = np.where((proxy > 0) & (proxy <= 5), proxy, np.nan)
                at = np.flatnonzero(within)
                low, high = np.full(len(at), LEAST_VOLATILITY), np.full(len(at), MOST_VOLATILITY)
                for _ in range(HALVINGS):
                    half = (low + high) / 2
                    above = price(half, at) > m[at]
                    low, high = np.where(above, low, half), np.where(above, half, high)
                found[at] = (low + high) / 2
            iv[good] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(iv, mask=np.isnan(iv))], names=[*batch.schema.names, "iv"])

    return dealt(chain).mapInArrow(halved, StructType([*chain.schema.fields, StructField("iv", DoubleType())]))


def implied_vol_sql(chain: str, rate: float = 0.05) -> str:
    """DuckDB: the bracket halved by a recursion over all quotes, on prices by series."""
    d1 = "((ln(spot / strike) + ({r} + {s} * {s} / 2) * y) / ({s} * sqrt(y)))"

    def price(s: str) -> str:
        a = d1.format(r=rate, s=s)
        call = f"(spot * ({normal_cdf_sql(a)}) - strike * exp(-{rate} * y) * ({normal_cdf_sql(f'({a} - {s} * sqrt(y))')}))"
        return f"(case when kind = 'call' then {call} else {call} - spot + strike * exp(-{rate} * y) end)"

    lows, highs = price(f"{LEAST_VOLATILITY}::double"), price(f"{MOST_VOLATILITY}::double")
    mid = price("((low + high) / 2)")
    return f"""with recursive g as (select row_number() over () as id, *, dte / 365 as y, dte > 0 and mid > 0 and spot > 0 and strike > 0 as good from ({chain})),
    f as (select *, case when good then mid > {lows} and mid < {highs} else false end as within from g),
    r as (select id, 0 as k, {LEAST_VOLATILITY}::double as low, {MOST_VOLATILITY}::double as high from f where within
      union all select id, k + 1, case when above then low else (low + high) / 2 end, case when above then (low + high) / 2 else high end
      from (select r.id, k, low, high, {mid} > mid as above from r join f on f.id = r.id where k < {HALVINGS})),
    v as (select id, (low + high) / 2 as sigma from r where k = {HALVINGS})
    select f.* exclude (id, y, good, within), case when within then sigma when good and mid / (0.4 * spot * sqrt(y)) > 0 and mid / (0.4 * spot * sqrt(y)) <= 5 then mid / (0.4 * spot * sqrt(y)) end as iv from f left join v on v.id = f.id"""


def trend_follow(bars: DataFrame, fast: int = 10, slow: int = 50, loud: int = 20, long_only: bool = False) -> DataFrame:
    """asset, date and signal of bars (asset, date, price, volume): the side of two exponential means, taken at a crossing if its volume
    is above the mean of `loud` rows, and on rows without a crossing from row `slow` on; until then, and between, what was taken last, 0 before."""
    w = Window.partitionBy("asset").orderBy("date")
    both = ewm(ewm(bars, F.col("price"), 2 / (fast + 1), "fast"), F.col("price"), 2 / (slow + 1), "slow")
    gap, frame = F.round(F.col("fast") - F.col("slow"), 9), w.rowsBetween(1 - loud, 0)
    rows = both.select("asset", "date", (F.row_number().over(w) - 1).alias("i"), F.when(gap > 0, 1).when(gap < 0, 0 if long_only else -1).otherwise(0).alias("trend"), F.coalesce(F.col("volume") > F.when(F.count("volume").over(frame) >= loud, F.avg("volume").over(frame)), F.lit(False)).alias("loud"))
    crossed = F.coalesce(F.col("trend") != F.lag("trend").over(w), F.lit(False))
    taken = rows.withColumn("crossed", crossed).withColumn("taken", F.when(F.col("crossed") & F.col("loud"), F.col("trend")).when(~F.col("crossed") & (F.col("i") >= slow), F.col("trend")))
    return taken.select("asset", "date", F.coalesce(F.last("taken", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).cast("int").alias("signal"))
