"""Queries of reading, cleaning and aligning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import align, cleaning, joins
from ..sources import tables
from ..sources.panels import bars
from .catalog import MONTH, REGIONS, month, read, register, regions
from .risk_queries import CRISES, rounded

SCHEMA = StructType().add("order_key", "long").add("price", "double").add("status", "string").add("missing", "double").add("comment_length", "integer")
register(
    "conformed_orders",
    lambda spark, d: tables.conform(read(spark, d, "orders").withColumnRenamed("o_orderstatus", "STATUS"), SCHEMA, {"O_ORDERKEY": "order_key", "o_totalprice": "price", "o_orderpriority": "comment_length"}),
    "select o_orderkey as order_key, o_totalprice as price, o_orderstatus as status, null::double as missing, null::int as comment_length from orders",
)
ASSETS = list(range(5))
_WIDE = f"select date, {', '.join(f'avg(ret) filter (asset = {a}) as a{a}' for a in ASSETS)} from ({MONTH}) group by 1"
register("wide_returns", lambda spark, d: rounded(tables.to_wide(month(spark, d), "ret", ASSETS), 9), f"select date, {', '.join(f'round(a{a}, 9) as a{a}' for a in ASSETS)} from ({_WIDE})")
register("long_returns", lambda spark, d: rounded(tables.to_long(tables.to_wide(month(spark, d), "ret", ASSETS), "ret"), 9), f"select date, 'a' || asset as asset, round(ret, 9) as ret from ({MONTH}) where asset < 5 and ret is not null")
_NEWS = "to_json(struct(substring(text, 1, 40) as headline, '2024-01-0' || (doc_id % 9 + 1) || 'T0' || (doc_id % 10) || ':30:00Z' as created_at, source, array('S' || doc_id % 7, 'S' || doc_id % 5) as symbols)) as value"
register(
    "parsed_news",
    lambda spark, d: tables.parse_news(read(spark, d, "documents").selectExpr(_NEWS)).drop("url", "summary"),
    "select substring(text, 1, 40) as headline, ('2024-01-0' || (doc_id % 9 + 1) || ' 0' || (doc_id % 10) || ':30:00')::timestamp as created_at, source, unnest(['S' || doc_id % 7, 'S' || doc_id % 5]) as symbol from documents",
)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem")


register("adjusted_prices", lambda spark, d: _lines(spark, d).select("l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey", F.round(cleaning.adjusted_price(-F.col("l_extendedprice"), F.col("l_discount")), 4).alias("price")), "select l_orderkey, l_linenumber, l_shipdate, l_suppkey, round(l_extendedprice / case when l_discount = 0 or l_discount is null then 1 else l_discount end, 4) as price from lineitem")
register("market_caps", lambda spark, d: rounded(cleaning.market_cap(bars(_lines(spark, d), "day"), "volume"), 4), """with b as (select l_suppkey as asset, l_shipdate::date as date, sum(l_extendedprice) / sum(l_quantity) as close, sum(l_quantity) as volume from lineitem group by 1, 2)
select asset, date_trunc('month', date)::date as period, round(arg_min(close, date) * arg_min(volume, date), 4) as cap from b group by 1, 2""")


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").selectExpr("p_partkey as asset", "case when p_partkey % 11 = 0 then 'A.B' else 'P' || (p_partkey % 30000) end as symbol", "p_size > 5 as tradable", "p_size % 3 <> 0 as shortable", "p_retailprice as price", "cast(p_size as double) * 1000 as volume")


register("tradable_universe", lambda spark, d: cleaning.tradable(_listed(spark, d), 950.0, 10000.0), "select p_partkey as asset, case when p_partkey % 11 = 0 then 'A.B' else 'P' || (p_partkey % 30000) end as symbol, true as tradable, true as shortable, p_retailprice as price, p_size * 1000.0::double as volume from part where p_size > 5 and p_size % 3 <> 0 and p_partkey % 11 <> 0 and len('P' || (p_partkey % 30000)) <= 5 and p_retailprice >= 950 and p_size >= 10")
register("business_month_ends", lambda spark, d: month(spark, d).select("date").distinct().select("date", cleaning.business_month_end(F.col("date")).alias("month_end")), f"select date, (case isodow(last_day(date)) when 6 then last_day(date) - 1 when 7 then last_day(date) - 2 else last_day(date) end)::date as month_end from (select distinct date from ({MONTH}))")


def filings(spark: SparkSession, d: str) -> DataFrame:
    """A filing for each supplier, year and return flag, made of its order lines."""
    x = _lines(spark, d).groupBy(F.col("l_suppkey").alias("asset"), F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("filing"))
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    agg = x.agg(F.max(F.to_date("l_shipdate")).alias("filed"), F.sum(p).alias("sale"), F.sum(p * F.col("l_discount")).alias("gp"), F.sum(p * (F.col("l_discount") - F.col("l_tax"))).alias("ni"), F.sum(p * (1 + F.col("l_tax"))).alias("assets"), F.sum(q).alias("shares"), F.avg(p).alias("price"), F.max(q).alias("dltt"), F.min(q).alias("dlc"))
    return agg.join(read(spark, d, "supplier").select(F.col("s_suppkey").alias("asset"), (10 * F.col("s_acctbal")).alias("ceq")), "asset")


FILINGS = "select l_suppkey as asset, year(l_shipdate)::int as year, l_returnflag as filing, max(l_shipdate)::date as filed, sum(l_extendedprice) as sale, sum(l_extendedprice * l_discount) as gp, sum(l_extendedprice * (l_discount - l_tax)) as ni, sum(l_extendedprice * (1 + l_tax)) as assets, sum(l_quantity) as shares, avg(l_extendedprice) as price, max(l_quantity) as dltt, min(l_quantity) as dlc, any_value(10 * s_acctbal) as ceq from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2, 3"
LATEST = f"select * from ({FILINGS}) qualify row_number() over (partition by asset, year order by filed desc, filing desc) = 1"
register("latest_filings", lambda spark, d: rounded(cleaning.latest_per_year(filings(spark, d), "filed"), 4), f"select asset, year, filing, filed, {', '.join(f'round({c}, 4) as {c}' for c in 'sale gp ni assets shares price dltt dlc ceq'.split())} from ({LATEST})")


def ratios(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.fundamental_ratios(cleaning.latest_per_year(filings(spark, d), "filed"))


RATIO_NAMES = "roe roa leverage bm ep gpa sp ag turnover revenue_growth debt_equity income_growth".split()
RATIOS = f"""with f as ({LATEST}), g as (select *, case when ceq > 0 then ceq end as e, price * shares as cap, lag(assets) over w as a0, lag(sale) over w as sale0, lag(ni) over w as ni0 from f window w as (partition by asset order by year))
select asset, year, ni / e as roe, ni / nullif(assets, 0) as roa, assets / e as leverage, e / nullif(cap, 0) as bm, ni / nullif(cap, 0) as ep, gp / nullif(assets, 0) as gpa, sale / nullif(cap, 0) as sp, assets / nullif(a0, 0) - 1 as ag, sale / nullif(assets, 0) as turnover, sale / nullif(sale0, 0) - 1 as revenue_growth, (dltt + dlc) / e as debt_equity, ni / nullif(ni0, 0) - 1 as income_growth from g"""
register("fundamental_ratios", lambda spark, d: rounded(ratios(spark, d)), f"select asset, year, {', '.join(f'round({c}, 6) as {c}' for c in RATIO_NAMES)} from ({RATIOS})")
register("latest_names", lambda spark, d: cleaning.latest_name(read(spark, d, "orders").selectExpr("o_custkey as asset", "o_clerk as name" if "o_clerk" in read(spark, d, "orders").columns else "o_orderpriority as name", "o_orderkey % 5 as exchange", "o_orderdate as since")), "select asset, name, case ex when 1 then 'NYSE' when 2 then 'AMEX' when 3 then 'NASDAQ' end as exchange from (select o_custkey as asset, o_orderpriority as name, o_orderkey % 5 as ex, o_orderdate from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderpriority desc, o_orderkey % 5 desc) = 1)")


def _delistings(spark: SparkSession, d: str) -> DataFrame:
    r = _lines(spark, d).where("l_returnflag = 'R' and l_linenumber = 1").groupBy(F.col("l_suppkey").alias("asset"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("date"))
    return r.agg((F.min("l_orderkey") % 700).alias("code"), F.when(F.min("l_orderkey") % 3 == 0, F.round(F.avg("l_discount") - 0.05, 6)).alias("dlret"))


_DELISTED = "select l_suppkey as asset, date_trunc('month', l_shipdate)::date as date, min(l_orderkey) % 700 as code, case when min(l_orderkey) % 3 = 0 then round(avg(l_discount) - 0.05, 6) end as dlret from lineitem where l_returnflag = 'R' and l_linenumber = 1 group by 1, 2"
register("delisting_returns", lambda spark, d: _delistings(spark, d).select("asset", "date", cleaning.delisting_return(F.col("code"), F.col("dlret")).alias("out")), f"select asset, date, case when dlret is not null then dlret when code >= 500 and code < 600 then -0.3 else 0 end::double as out from ({_DELISTED})")
register("panel_with_delistings", lambda spark, d: cleaning.apply_delistings(month(spark, d).select("asset", "date", "ret"), _delistings(spark, d)).select("asset", "date", F.round("ret", 9).alias("ret")), f"""with o as (select asset, date, case when dlret is not null then dlret when code between 500 and 599 then -0.3 else 0 end as x from ({_DELISTED}))
select p.asset, p.date, round(case when x is null or x = 0 then ret when ret is null then x else (1 + ret) * (1 + x) - 1 end, 9) as ret from ({MONTH}) p left join o on o.asset = p.asset and o.date = p.date""")
_EXTEND = "asset", "date", "round(close, 9) as close"
register("extended_panel", lambda spark, d: cleaning.extend_panel(month(spark, d).where("date < '2000-01-01' and asset > 2").selectExpr(*_EXTEND), month(spark, d).where("date > '1999-06-01'").selectExpr(*_EXTEND)), f"select asset, date, round(close, 9) as close from ({MONTH}) where date < date '2000-01-01' and asset > 2 or date >= date '2000-01-01'")
register("last_dates", lambda spark, d: cleaning.lookback(month(spark, d).selectExpr(*_EXTEND), 12), f"select asset, date, round(close, 9) as close from ({MONTH}) where date in (select distinct date from ({MONTH}) order by date desc limit 12)")
_CONTRACT = "case when p_partkey % 9 = 0 then 'bad' || p_partkey else chr(65 + cast(p_partkey % 20 as int)) || 'X' || '2' || (4 + p_partkey % 3) || '0' || (1 + p_partkey % 9) || lpad(cast(1 + p_partkey % 31 as string), 2, '0') || case when p_partkey % 2 = 0 then 'C' else 'P' end || lpad(cast(cast(p_retailprice * 1000 as bigint) as string), 8, '0') end as contract"
_CONTRACT_SQL = _CONTRACT.replace("as string", "as varchar").replace("cast(p_retailprice * 1000 as bigint)", "trunc(p_retailprice * 1000)::bigint")


def chain_quotes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").selectExpr("p_partkey", _CONTRACT, "case when p_partkey % 13 = 0 then 0e0 else p_retailprice / 40 end as bid", "p_retailprice / 38 as ask")


def chain(spark: SparkSession, d: str) -> DataFrame:
    quotes = chain_quotes(spark, d)
    spots = read(spark, d, "part").selectExpr("chr(65 + cast(p_partkey % 20 as int)) || 'X' as underlying", "p_retailprice").groupBy("underlying").agg(F.avg("p_retailprice").alias("spot"))
    return cleaning.process_chain(quotes, spots, F.lit("2024-03-15").cast("date"))


_PARSED = f"""select p_partkey, contract, bid, ask, regexp_extract(contract, '^([A-Z]+?)[0-9]', 1) as underlying, try_strptime(regexp_extract(contract, '^[A-Z]+([0-9]{{6}})', 1), '%y%m%d')::date as expiry, case when contract similar to '[A-Z]+[0-9]+C[0-9]+' then 'call' else 'put' end as kind, right(contract, 8)::double / 1000 as strike
from (select p_partkey, {_CONTRACT_SQL}, case when p_partkey % 13 = 0 then 0 else p_retailprice / 40 end as bid, p_retailprice / 38 as ask from part) where contract not like 'bad%' and try_strptime(regexp_extract(contract, '^[A-Z]+([0-9]{{6}})', 1), '%y%m%d') is not null"""
CHAIN = f"select contract, underlying, expiry, kind, strike, bid, ask, spot, (expiry - date '2024-03-15')::int as dte, (bid + ask) / 2 as mid, strike / spot as moneyness from ({_PARSED}) join (select chr((65 + p_partkey % 20)::int) || 'X' as underlying, avg(p_retailprice) as spot from part group by 1) using (underlying) where bid > 0 and expiry > date '2024-03-15'"
register("option_symbols", lambda spark, d: chain_quotes(spark, d).select("p_partkey", "contract", cleaning.parse_option(F.col("contract")).alias("o")).where("o is not null").select("p_partkey", "contract", "o.*"), f"select p_partkey, contract, underlying, expiry, kind, strike from ({_PARSED})")
register("option_chain", lambda spark, d: rounded(chain(spark, d)), f"select contract, underlying, expiry, kind, {', '.join(f'round({c}, 6) as {c}' for c in ('strike', 'bid', 'ask', 'spot', 'mid', 'moneyness'))}, dte from ({CHAIN})")
_CODE = "case when c_custkey % 5 = 0 then 'HK' || c_custkey else lpad(cast((c_custkey * 7919) % 700000 as {}), 6, '0') end"
register("market_symbols", lambda spark, d: read(spark, d, "customer").selectExpr("c_custkey", _CODE.format("string") + " as code").select("c_custkey", cleaning.to_market_symbol(F.col("code")).alias("symbol"), cleaning.from_market_symbol(cleaning.to_market_symbol(F.col("code"))).alias("code")), f"select c_custkey, code || case when c_custkey % 5 = 0 then '' when left(code, 2) in ('60', '68') then '.XSHG' else '.XSHE' end as symbol, code from (select c_custkey, {_CODE.format('varchar')} as code from customer)")
register("average_dollar_volume", lambda spark, d: rounded(cleaning.average_dollar_volume(month(spark, d), 6), 4), f"select asset, date, round(case when count(volume * close) over w >= 6 then avg(volume * close) over w end, 4) as adv from ({MONTH}) window w as (partition by asset order by date rows between 5 preceding and current row)")
_QUOTE = ["user_id as symbol", "ts", "event_id", "value * 0.999D as bid", "value * 1.001D as ask"]
register("snapshots", lambda spark, d: rounded(cleaning.snapshot(read(spark, d, "events").where("event_type = 'purchase' and ts is not null").selectExpr("user_id as symbol", "ts", "event_id", "value as price"), read(spark, d, "events").where("event_type in ('click', 'view') and ts is not null").selectExpr(*_QUOTE), read(spark, d, "events").where("ts is not null").selectExpr("user_id as symbol", "date_trunc('day', ts) as ts", "event_id", "value as close"))), """with l as (select *, row_number() over (partition by user_id, event_type = 'purchase' order by ts desc, event_id desc) as k from events where ts is not null and event_type in ('purchase', 'click', 'view')),
t as (select user_id as symbol, ts as trade_at, value as trade_price from l where k = 1 and event_type = 'purchase'), q as (select user_id as symbol, ts as quote_at, value * 0.999 as quote_bid, value * 1.001 as quote_ask from l where k = 1 and event_type <> 'purchase'),
b as (select user_id as symbol, date_trunc('day', ts) as bar_at, value as bar_close from events where ts is not null qualify row_number() over (partition by user_id order by date_trunc('day', ts) desc, event_id desc) = 1)
select symbol, trade_at, round(trade_price, 6) as trade_price, quote_at, round(quote_bid, 6) as quote_bid, round(quote_ask, 6) as quote_ask, bar_at, round(bar_close, 6) as bar_close from t full join q using (symbol) full join b using (symbol)""")
register("most_active", lambda spark, d: cleaning.most_active(month(spark, d), 5), f"select date, asset, volume, trade_count, place::int as place from (select *, row_number() over (partition by date order by volume desc, asset) as place from ({MONTH}) where volume is not null) where place <= 5")
register("date_window", lambda spark, d: cleaning.between_dates(month(spark, d).selectExpr(*_EXTEND), "1998-03-01", "1999-05-01"), f"select asset, date, round(close, 9) as close from ({MONTH}) where date >= date '1998-03-01' and date <= date '1999-05-01'")


def _actions(spark: SparkSession, d: str) -> DataFrame:
    a = month(spark, d).where("month(date) = 6 and close is not null").selectExpr("asset", "date as ex_date", "case when year(date) % 2 = 0 then 2e0 end as ratio", "round(close * 0.01, 6) as cash")
    return a.unionByName(month(spark, d).where("date = '1999-06-01' and asset % 2 = 0").selectExpr("asset", "date as ex_date", "1.5e0 as ratio", "cast(null as double) as cash"))


register("adjusted_for_actions", lambda spark, d: rounded(cleaning.adjust_for_actions(month(spark, d).select("asset", "date", "close"), _actions(spark, d)), 8), f"""with p as (select asset, date, close, max(date) filter (close is not null) over (partition by asset order by date rows between unbounded preceding and 1 preceding) as last from ({MONTH})),
f as (select p.asset, p.date as ex, (1 - coalesce(round(p.close * 0.01, 6) / q.close, 0)) / ((case when year(p.date) % 2 = 0 then 2 else 1 end) * (case when p.date = date '1999-06-01' and p.asset % 2 = 0 then 1.5 else 1 end)) as k from p left join p q on q.asset = p.asset and q.date = p.last where month(p.date) = 6 and p.close is not null
  union all select asset, date, 1 / 1.5 from p where close is null and date = date '1999-06-01' and asset % 2 = 0)
select p.asset, p.date, round(any_value(close), 8) as close, round(any_value(close) * coalesce(product(k), 1), 8) as adj_close from p left join f on f.asset = p.asset and f.ex > p.date where close is not null group by 1, 2""")


def _books(spark: SparkSession, d: str) -> DataFrame:
    level = lambda sign: F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.struct((F.col("value") * (1 + sign * k / 1000)).alias("price"), (k * (F.col("event_id") % 7 + 1)).cast("double").alias("size")))
    return read(spark, d, "events").where("ts is not null").select(F.col("event_id").alias("symbol"), "ts", level(-1).alias("bids"), level(1).alias("asks"))


register("book_summaries", lambda spark, d: rounded(cleaning.book_summary(_books(spark, d))), """select event_id as symbol, ts, round(greatest(value * 0.999, value * 0.995), 6) as bid, round(least(value * 1.001, value * 1.005), 6) as ask, round((greatest(value * 0.999, value * 0.995) + least(value * 1.001, value * 1.005)) / 2, 6) as mid,
round((least(value * 1.001, value * 1.005) - greatest(value * 0.999, value * 0.995)) / nullif((greatest(value * 0.999, value * 0.995) + least(value * 1.001, value * 1.005)) / 2, 0), 6) as spread, (15 * (event_id % 7 + 1))::double as bid_depth, (15 * (event_id % 7 + 1))::double as ask_depth from events where ts is not null""")
register("default_features", lambda spark, d: rounded(cleaning.default_features(month(spark, d), 6)), f"select asset, date, round(coalesce(ret, 0), 6) as ret, round(coalesce(case when count(ret) over w >= 6 then stddev_samp(ret) over w end, 0), 6) as vol, round(coalesce(close / nullif(lag(close, 6) over (partition by asset order by date), 0) - 1, 0), 6) as momentum from ({MONTH}) window w as (partition by asset order by date rows between 5 preceding and current row)")

_PANEL = ["asset", "date", "round(ret, 9) as ret"]
register("month_aligned", lambda spark, d: align.month_align(read(spark, d, "orders").selectExpr("o_orderkey", "cast(o_orderdate as date) as date"), month(spark, d).where("asset = 1").selectExpr("date", "round(close, 9) as close"), ["close"]), f"select o_orderkey, o_orderdate::date as date, round(close, 9) as close from orders join ({MONTH}) p on p.asset = 1 and year(p.date) = year(o_orderdate) and month(p.date) = month(o_orderdate)")
register("annual_to_monthly", lambda spark, d: align.annual_to_monthly(month(spark, d).select("asset", "date"), rounded(ratios(spark, d)).select("asset", "year", "roe", "bm")), f"select p.asset, p.date, round(roe, 6) as roe, round(bm, 6) as bm from ({MONTH}) p left join ({RATIOS}) r on r.asset = p.asset and r.year = case when month(p.date) < 7 then year(p.date) - 2 else year(p.date) - 1 end")


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").where("ts is not null")
    quotes = e.where("event_type = 'signup'").groupBy(F.col("user_id").alias("symbol"), "ts").agg(F.max("value").alias("quote"))
    return align.nearest_join(e.where("event_type = 'purchase'").selectExpr("event_id", "user_id as symbol", "ts"), quotes, "symbol", "ts", "quote")


register("nearest_quotes", _nearest, """with q as (select user_id as symbol, ts as t, max(value) as quote from events where ts is not null and event_type = 'signup' group by 1, 2)
select event_id, symbol, ts, quote from (select event_id, user_id as symbol, ts from events where ts is not null and event_type = 'purchase') left join q using (symbol) qualify row_number() over (partition by event_id order by abs(epoch_us(t) - epoch_us(ts)) nulls last, t) = 1""")
_FACTORS = "select asset, date, factor, signal from (select asset, date, unnest(['a', 'b', 'c']) as factor, unnest([round(ret, 9), round(volume, 9), round(lag(ret, 6) over (partition by asset order by date), 9)]) as signal from ({}))"
register("aligned_factors", lambda spark, d: align.align_many(month(spark, d).selectExpr("asset", "date", "round(ret, 9) as a", "round(volume, 9) as b", "round(lag(ret, 6) over (partition by asset order by date), 9) as c").unpivot(["asset", "date"], ["a", "b", "c"], "factor", "signal"), 3), f"with t as ({_FACTORS.format(MONTH)}) select t.* from t join (select asset, date from t group by 1, 2 having count(signal) = 3) using (asset, date)")
register("outer_aligned", lambda spark, d: align.outer_align(month(spark, d).where("asset % 3 <> 0 and volume is not null").selectExpr("asset", "date", "volume as x"), month(spark, d).where("asset % 2 = 0 and ret is not null").selectExpr("asset", "date", "round(ret, 9) as y"), ["asset", "date"], "x", "y"), f"with p as ({MONTH}), t as (select asset, date, case when asset % 3 <> 0 then volume end as x, case when asset % 2 = 0 then round(ret, 9) end as y from p) select asset, date, coalesce(x, 0) as x, coalesce(y, 0) as y from t where x is not null or y is not null")


def sectors(spark: SparkSession, d: str) -> DataFrame:
    """sector, date, r: the mean return of each region."""
    both = month(spark, d).where("ret is not null").join(regions(spark, d).select("asset", F.col("region").alias("sector")), "asset")
    return both.groupBy("sector", "date").agg(F.round(F.avg("ret"), 9).alias("r"))


SECTORS = f"select region as sector, date, round(avg(ret), 9) as r from ({MONTH}) join ({REGIONS}) using (asset) where ret is not null group by all"
register("sector_pairs", lambda spark, d: align.pairs(sectors(spark, d).selectExpr("sector as asset", "date", "r"), "r"), f"with s as ({SECTORS}) select date, x.sector as a, y.sector as b, x.r as x, y.r as y from s x join s y using (date) where y.sector > x.sector")
register("sector_returns", lambda spark, d: align.sector_join(month(spark, d).selectExpr(*_PANEL), regions(spark, d).withColumnRenamed("region", "sector"), sectors(spark, d)), f"select asset, date, sector, ret, r as sector_ret from (select asset, date, round(ret, 9) as ret, region as sector from ({MONTH}) join ({REGIONS}) using (asset)) left join ({SECTORS}) using (sector, date)")
register("labelled_periods", lambda spark, d: align.label_periods(month(spark, d).select("date").distinct(), CRISES), f"select date, period from (select distinct date from ({MONTH})) join (values {', '.join(f"('{n}', '{a[:7]}', '{z[:7]}')" for n, a, z in CRISES)}) v(period, a, z) on strftime(date, '%Y-%m') between a and z")


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """Filings with the links (kind and rank filtered) that hold at their date."""
    orders = read(spark, d, "orders").selectExpr("o_orderkey", "o_custkey as asset", "cast(o_orderdate as date) as since", "o_orderstatus as kind", "o_orderkey % 3 as rank")
    links = joins.validity(orders, "asset", "since", "o_orderkey").where("kind in ('O', 'F') and rank < 2")
    facts = read(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey as asset", "cast(l_shipdate as date) as filed")
    return joins.interval_join(facts, links, "asset", "filed", "since", "until").select("l_orderkey", "l_linenumber", "asset", "filed", "o_orderkey", "kind")


register("linked_filings", _linked, """with v as (select o_orderkey, o_custkey as asset, o_orderdate::date as since, o_orderstatus as kind, coalesce(lead(o_orderdate::date) over (partition by o_custkey order by o_orderdate::date, o_orderkey) - 1, date '9999-12-31') as until from orders)
select l_orderkey, l_linenumber, asset, l_shipdate::date as filed, o_orderkey, kind from lineitem join v on v.asset = l_suppkey and l_shipdate::date >= since and l_shipdate::date <= until where kind in ('O', 'F') and o_orderkey % 3 < 2""")
