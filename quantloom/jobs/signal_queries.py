"""News of documents and their sources, screens of the monthly panel, options of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, signals
from .catalog import MONTH, month, read, register
from .cleaning_queries import CHAIN, chain
from .risk_queries import rounded

AS_OF = "2024-01-02 12:00:00"


def _news(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", (F.col("doc_id") % 25).alias("symbol"), F.coalesce("source", F.lit("")).alias("source"), F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") % 48 * 3600000000).alias("created_at"), F.round(signals.score_headline(F.col("text")), 9).alias("score"))


_L = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
#: A word's modifiers are those since the last word that is none: their group is counted, not stepped through.
SCORES = f"""with t as (select doc_id, unnest(w) as w, unnest(range(len(w))) as i, len(w) as n from (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') as w from documents)),
k as (select *, w in {_L(signals.NEGATIONS)} as neg, w not in {_L(signals.NEGATIONS)} and w in {_L(signals.AMPLIFIERS)} as amp from t), g as (select *, count(*) filter (not neg and not amp) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as g from k),
f as (select *, bool_or(neg) over (partition by doc_id, g) as no, bool_or(amp) over (partition by doc_id, g) as more from g),
s as (select doc_id, sum(case when neg or amp then 0 when w in {_L(signals.POSITIVE)} then 1 when w in {_L(signals.NEGATIVE)} then -1 else 0 end * case when no then -1 else 1 end * case when more then 1.5 else 1 end) / any_value(n) as score from f group by 1)
select d.doc_id, d.doc_id % 25 as symbol, coalesce(source, '') as source, timestamp '2024-01-01' + to_hours((d.doc_id % 48)::int) as created_at, round(greatest(least(coalesce(score, 0), 1), -1), 9)::double as score from documents d left join s using (doc_id)"""
register("headline_scores", lambda spark, d: _news(spark, d).select("doc_id", "score"), f"select doc_id, score from ({SCORES})")


def _sentiment(spark: SparkSession, d: str) -> DataFrame:
    return signals.sentiment(_news(spark, d), F.lit(AS_OF).cast("timestamp"))


_SENTIMENT = f"select symbol, sum(w * score) / sum(w) as sentiment, count(*) as headlines, count(distinct nullif(source, '')) as sources from (select *, exp(-0.1 * date_diff('hour', created_at, timestamp '{AS_OF}')) as w from ({SCORES}) where created_at <= timestamp '{AS_OF}' and created_at >= timestamp '{AS_OF}' - interval 24 hour) group by 1"
register("news_sentiment", lambda spark, d: rounded(_sentiment(spark, d)), f"select symbol, round(sentiment, 6) as sentiment, headlines, sources from ({_SENTIMENT})")
_RANK = "2 * (rank() over (order by {0} nulls last) + (count({0}) over (partition by {0}) - 1) / 2) / count({0}) over () - 1"


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_sentiment(spark, d)).select("symbol", *[F.round(signals.share_rank(c), 9).alias(n) for c, n in (("sentiment", "tone"), ("headlines", "volume"), ("sources", "breadth"))])


_RANKED = f"select symbol, {', '.join(f'round({_RANK.format(c)}, 9) as {n}' for c, n in (('sentiment', 'tone'), ('headlines', 'volume'), ('sources', 'breadth')))} from (select symbol, round(sentiment, 6) as sentiment, headlines, sources from ({_SENTIMENT}))"
register("news_signals", _ranked, _RANKED)
register("news_composite", lambda spark, d: signals.weighted({n: (_ranked(spark, d).select("symbol", F.col(n).alias("signal")), w) for n, w in (("tone", 0.5), ("volume", 0.3), ("breadth", 0.2))}, ["symbol"]), f"select symbol, {_RANK.format('x')} as signal from (select symbol, round(0.5 * tone + 0.3 * volume + 0.2 * breadth, 9) as x from ({_RANKED}))")


def _universe(spark: SparkSession, d: str) -> DataFrame:
    return month(spark, d).select("date", F.col("asset").alias("symbol"))


def _actives(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.most_active(month(spark, d), 20).withColumnRenamed("asset", "symbol")


def _movers(spark: SparkSession, d: str) -> DataFrame:
    r = month(spark, d).where("ret is not null").selectExpr("date", "asset as symbol", "round(ret * 100, 6) as pct", "row_number() over (partition by date order by round(ret, 9) desc, asset) as up", "row_number() over (partition by date order by round(ret, 9), asset) as down")
    return r.where("up <= 15").selectExpr("date", "symbol", "'gainer' as side", "pct").unionByName(r.where("down <= 15").selectExpr("date", "symbol", "'loser' as side", "pct"))


_ACTIVES = f"select date, asset as symbol, volume, trade_count, row_number() over (partition by date order by volume desc, asset) as place from ({MONTH}) where volume is not null qualify place <= 20"
_MOVERS = f"with r as (select date, asset as symbol, round(ret * 100, 6) as pct, row_number() over (partition by date order by round(ret, 9) desc, asset) as up, row_number() over (partition by date order by round(ret, 9), asset) as down from ({MONTH}) where ret is not null) select date, symbol, 'gainer' as side, pct from r where up <= 15 union all select date, symbol, 'loser', pct from r where down <= 15"
_U = f"select date, asset as symbol from ({MONTH})"


def _others(raw: str, used: str, keys: str = "date, symbol", by: str = "date") -> str:
    return f"with raw as ({raw}), n as (select *, {used} as used from raw), p as (select *, sum(used::int) over (partition by {by}) as n, rank() over (partition by {by}, used order by x) + (count(*) over (partition by {by}, used, x) - 1) / 2 as p from n) select {keys}, round(case when used and n > 1 then 2 * p / n - 1 else x end, 6) as signal from p"


_ATTENTION = _others(f"select date, symbol, coalesce((n - place + 1) / n, 0) as x from ({_U}) u left join (select *, count(*) over (partition by date) as n from ({_ACTIVES})) a using (date, symbol)", "x <> 0")
_MOVE = lambda sign, wins, k: _others(f"select date, symbol, coalesce(x, 0) as x from ({_U}) u left join (select date, symbol, arg_max(abs(pct) * {k} * case when side = 'gainer' then {sign} else {-sign} end, (side = '{wins}')::int) as x from ({_MOVERS}) group by 1, 2) m using (date, symbol)", "x <> 0")
_MOMENTUM, _CONTRARY = _MOVE(1, "loser", "1"), _MOVE(-1, "gainer", "(case when abs(pct) > 5 then 1.5 else 1 end)")
_INTENSITY = f"with raw as (select date, symbol, -trade_count / nullif(volume, 0) as x from ({_U}) u left join ({_ACTIVES}) a using (date, symbol)), p as (select *, count(x) over (partition by date) as n, rank() over (partition by date order by x nulls last) + (count(x) over (partition by date, x) - 1) / 2 as p from raw) select date, symbol, round(case when x is null then 0 when n > 1 then 2 * p / n - 1 else x end, 6) as signal from p"
_PARTS = {
    "attention": (lambda s, d: signals.attention(_universe(s, d), _actives(s, d)), _ATTENTION, 0.3),
    "mover_momentum": (lambda s, d: signals.mover_signal(_universe(s, d), _movers(s, d)), _MOMENTUM, 0.3),
    "mover_contrarian": (lambda s, d: signals.mover_signal(_universe(s, d), _movers(s, d), True), _CONTRARY, 0.2),
    "trade_intensity": (lambda s, d: signals.trade_intensity(_universe(s, d), _actives(s, d)), _INTENSITY, 0.2),
}
for _name, (_f, _sql, _) in _PARTS.items():
    register(f"screen_{_name}", lambda spark, d, f=_f: rounded(f(spark, d)), _sql)
register("screen_persistence", lambda spark, d: rounded(signals.persistence(_actives(spark, d), 5)), _others(f"select symbol, 0 as k, case when count(distinct date) >= 2 then count(distinct date) / 5 else 0 end as x from ({_ACTIVES}) where date in (select distinct date from ({_ACTIVES}) order by date desc limit 5) group by 1", "x > 0", "symbol", "k"))
_UNION = " union all ".join(f"select date, symbol, signal * {w} as x from ({q})" for _, q, w in _PARTS.values())
register("screen_composite", lambda spark, d: rounded(signals.weighted({n: (rounded(f(spark, d)), w) for n, (f, _, w) in _PARTS.items()}, ["date", "symbol"])), f"with t as (select date, symbol, round(sum(x), 9) as x from ({_UNION}) group by 1, 2) select date, symbol, round(2 * (rank() over (partition by date order by x) + (count(*) over (partition by date, x) - 1) / 2) / count(*) over (partition by date) - 1, 6) as signal from t")
_IV = "case when mid / (0.4 * spot * sqrt(dte / 365)) > 0 and mid / (0.4 * spot * sqrt(dte / 365)) <= 5 then mid / (0.4 * spot * sqrt(dte / 365)) end"
register("implied_vol_proxy", lambda spark, d: chain(spark, d).select("contract", "underlying", F.round(signals.implied_vol_proxy(F.col("mid"), F.col("spot"), F.col("dte")), 6).alias("iv"), F.round(signals.spread_proxy(F.col("bid"), F.col("ask")), 6).alias("spread")), f"select contract, underlying, round({_IV}, 6) as iv, round((ask - bid) / mid, 6) as spread from ({CHAIN})")
_NEAR = "dte between 20 and 600"


def _chain(spark: SparkSession, d: str) -> DataFrame:
    """The chain with days scaled down, so that near and far ones are there."""
    return chain(spark, d).withColumn("dte", (F.col("dte") % 90 + 1))


_SCALED = f"select *, {_IV} as iv from (select * exclude (dte), dte % 90 + 1 as dte from ({CHAIN}))"
_MEASURES = f"""with a as (select underlying, avg(iv) filter (moneyness between 0.95 and 1.05 and dte between 20 and 60) as atm_iv, avg(iv) filter (kind = 'put' and dte between 20 and 60 and moneyness between 0.88 and 0.92) as p, avg(iv) filter (kind = 'call' and dte between 20 and 60 and moneyness between 1.08 and 1.12) as c,
 avg(iv) filter (moneyness between 0.95 and 1.05 and dte > 5 and dte < 30) as s, avg(iv) filter (moneyness between 0.95 and 1.05 and dte > 60) as l, sum(1 / mid) filter (kind = 'put') as puts, sum(1 / mid) filter (kind = 'call') as calls from ({_SCALED}) group by 1)
select underlying, round(atm_iv, 6) as atm_iv, round(-(p - c) / nullif(c, 0), 6) as iv_skew, round(s / nullif(l, 0), 6) as term_structure, round(puts / nullif(calls, 0), 6) as put_call_ratio from a"""
register("option_measures", lambda spark, d: rounded(signals.option_measures(_chain(spark, d))), _MEASURES)
_Z = "case when {0} is not null then coalesce(({0} - avg({0}) over ()) / nullif(stddev_samp({0}) over (), 0), 0) end"
register("option_signal", lambda spark, d: rounded(signals.option_signal(rounded(signals.option_measures(_chain(spark, d)))), 9), f"with x as (select underlying, round(0.4 * {_Z.format('iv_skew')} - 0.3 * {_Z.format('put_call_ratio')} - 0.3 * {_Z.format('term_structure')}, 9) as x from ({_MEASURES})) select underlying, round(case when x is null then null when count(x) over () <= 1 then 0 else {_RANK.format('x')} end, 9) as signal from x")
register("iv_rank", lambda spark, d: rounded(signals.iv_rank(month(spark, d).selectExpr("asset", "date", "round(abs(ret), 9) as iv"), 24)), f"select asset, date, round(case when iv is not null then len(list_filter(v, lambda y: y < iv)) / nullif(len(v), 0) end, 6) as iv_rank from (select asset, date, iv, coalesce(list(iv) filter (iv is not null) over (partition by asset order by date rows between 24 preceding and 1 preceding), []) as v from (select asset, date, round(abs(ret), 9) as iv from ({MONTH})))")
