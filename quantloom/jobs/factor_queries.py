"""Composites of whole families from one pass, and the factors that need ranks, positions or shapes of a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import cs_rank
from ..operators import factors, formulas, screen
from ..sources.panels import FIELDS, panel, panel_sql, sized
from .catalog import register

COLUMNS = ("asset", "date", *FIELDS, "price", "ret", "mkt")
PER = 4
WEEK = panel_sql("week", PER)


def week(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d, "week", PER)


def composite(members: dict[str, factors.Stages]):
    """A query of all members' signals blended with equal weights, and its SQL."""
    weights = dict.fromkeys(members, 1.0)

    def query(spark: SparkSession, d: str) -> DataFrame:
        weeks, size = sized(spark, d, "week", PER)
        return screen.blend(factors.compute_all(weeks, members, size=size), weights)

    return query, screen.blend_sql(factors.compute_all_sql(WEEK, COLUMNS, members), weights)


_ALL = factors.DAILY | factors.ALPHA
for _family, _names in factors.FAMILIES.items():
    register(f"composite_{_family}", *composite({n: _ALL[n] for n in _names}))
_WHOLE = {n: _ALL[n] for f in ("liquidity", "trend", "statistics", "network", "behaviour", "dynamics") for n in factors.FAMILIES[f]}
register("composite_alpha", *composite(_WHOLE))


def _all_monthly(spark: SparkSession, d: str) -> DataFrame:
    months, size = sized(spark, d, "month")
    return factors.compute_all(months, factors.MONTHLY, size=size)


register("all_monthly_factors", _all_monthly, factors.compute_all_sql(panel_sql("month"), COLUMNS, factors.MONTHLY))


# SQL of frames as lists; a frame has the rows' values that are not null.


def _frame(n: int, lag: int = 0) -> str:
    return f"over (partition by asset order by date rows between {n - 1 + lag} preceding and {f'{lag} preceding' if lag else 'current row'})"


def _list(x: str, n: int, lag: int = 0) -> str:
    return f"(list({x}) filter ({x} is not null) {_frame(n, lag)})"


def _rank_in(v: str, x: str, n: int) -> str:
    return f"case when {x} is not null and len({v}) >= {n} then (len(list_filter({v}, lambda y: y < {x})) + (len(list_filter({v}, lambda y: y = {x})) + 1) / 2) / {n} end"


def _argmax(v: str, n: int) -> str:
    return f"case when len({v}) >= {n} then list_position({v}, list_max({v})) - 1 end"


def _roll(agg: str, x: str, n: int) -> str:
    return f"case when count({x}) {_frame(n)} >= {n} then {agg}({x}) {_frame(n)} end"


def _corr(x: str, y: str, n: int, least: int | None = None) -> str:
    a, b = f"case when {y} is not null then {x} end", f"case when {x} is not null then {y} end"
    moves = " and ".join(f"var_pop({c}) {_frame(n)} > 1e-12 * avg({c} * {c}) {_frame(n)}" for c in (a, b))
    return f"case when count({a}) {_frame(n)} >= {least or n} and {moves} then corr({x}, {y}) {_frame(n)} end"


def _cross(x: str) -> str:
    return f"case when {x} is not null then (rank() over (partition by date order by {x} nulls last) + (count(*) over (partition by date, {x}) - 1) / 2) / count({x}) over (partition by date) end"


def _back(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) over (partition by asset order by date)"


def staged_sql(base: str, *stages: dict[str, str]) -> str:
    """Selects inside selects: each stage's columns are rounded, lists are not."""
    q, own = base, []
    for stage in stages:
        cols = ", ".join(f"{x} as {k}" if k.startswith("v_") else f"round(({x})::double, 9) as {k}" for k, x in stage.items())
        gone = [k for k in stage if k in own]
        q = f"select *{f' exclude ({chr(44).join(gone)})' if gone else ''}, {cols} from ({q})"
        own += list(stage)
    return q


def _final(q: str, value: str, signal: bool = True) -> str:
    q = f"select asset, date, round(({value})::double, 9) as value from ({q})"
    return f"select asset, date, value, round({cs_rank('value')}, 9) as signal from ({q})" if signal else q


_SQL = {
    "001": _final(staged_sql(WEEK, {"x": f"case when ret < 0 then {_roll('stddev_samp', 'ret', 20)} else close end"}, {"x": "sign(x) * x * x"}, {"v_x": _list("x", 5)}, {"x": _argmax("v_x", 5)}, {"x": f"{_cross('x')} - 0.5"}), "x"),
    "026": _final(staged_sql(WEEK, {"v_a": _list("volume", 5), "v_b": _list("high", 5)}, {"a": _rank_in("v_a", "volume", 5), "b": _rank_in("v_b", "high", 5)}, {"x": _corr("a", "b", 5)}, {"x": f"-({_roll('max', 'x', 3)})"}), "x"),
    "047": _final(staged_sql(WEEK, {"inv": "1 / nullif(close, 0)", "adv": _roll("avg", "volume", 20), "hc": "high - close", "h5": _roll("avg", "high", 5), "back": f"vwap - {_back('vwap', 5)}"}, {"a": _cross("inv"), "b": _cross("hc"), "c": _cross("back")}), "a * volume / nullif(adv, 0) * (high * b / nullif(h5, 0)) - c"),
    "057": _final(staged_sql(WEEK, {"v_x": _list("close", 30)}, {"a": _argmax("v_x", 30)}, {"a": _cross("a")}, {"a": f"(a * 2 + {_back('a')}) / 3"}), "-(close - vwap) / nullif(a, 0)"),
    "060": _final(staged_sql(WEEK, {"a": "(2 * close - low - high) / nullif(round(high - low, 9), 0) * volume", "v_b": _list("close", 10)}, {"b": _argmax("v_b", 10)}, {"a": _cross("a"), "b": _cross("b")}), "b - 2 * a"),
    "083": _final(staged_sql(WEEK, {"r": f"(high - low) / nullif({_roll('avg', 'close', 5)}, 0)"}, {"d": _back("r", 2)}, {"d": _cross("d"), "v": _cross("volume")}, {"v": _cross("v")}), "round(d * v, 6)"),
    "084": _final(staged_sql(WEEK, {"a": f"vwap - {_roll('max', 'vwap', 15)}", "b": f"close - {_back('close', 5)}"}, {"v_a": _list("a", 20)}, {"a": _rank_in("v_a", "a", 20)}, {"p": "case when a <> 0 or b > 0 then case when b * ln(a) < 300 * ln(10) then pow(a, b) end when b = 0 then 1 end"}), "round(p, 6)"),
    "085": _final(staged_sql(WEEK, {"m": "0.8767 * high + 0.1233 * close", "adv": _roll("avg", "volume", 30), "hl": "(high + low) / 2"}, {"a": _corr("m", "adv", 10), "v_p": _list("hl", 4), "v_q": _list("volume", 10)}, {"p": _rank_in("v_p", "hl", 4), "q": _rank_in("v_q", "volume", 10)}, {"b": _corr("p", "q", 7)}, {"a": _cross("a"), "b": _cross("b")}), "pow(a, b)"),
}
for _name, _f in formulas.FORMULAS.items():
    register(f"factor_formula_{_name}", lambda spark, d, f=_f: formulas.signalled(f(week(spark, d))), _SQL[_name])

_PAIRS = f"select *, {_back('close', 20)} as c20, list({{'a': close, 'b': volume}}) filter (close is not null and volume is not null) {_frame(20)} as v from ({WEEK})"
_RANKED = "list_transform(v, lambda p: len(list_filter(v, lambda q: q.{0} < p.{0})) + (len(list_filter(v, lambda q: q.{0} = p.{0})) + 1) / 2)"
_DIVERGENCE = f"""with f as (select asset, date, close / nullif(c20, 0) - 1 < 0 as fell, len(v) as n, {_RANKED.format('a')} as x, {_RANKED.format('b')} as y from ({_PAIRS})),
u as (select asset, date, fell, n, unnest(x) as x, unnest(y) as y from f where n >= 15), g as (select asset, date, any_value(fell) as fell, case when round(var_pop(x) * var_pop(y) * count(*) * count(*), 18) > 0 then covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) end as rho from u group by 1, 2)
select f.asset, f.date, round(case when g.fell then -rho else rho end, 9) as value from f left join g on g.asset = f.asset and g.date = f.date"""
_SHAPES = {
    "volume_price_divergence": (lambda p: formulas.volume_price_divergence(p), _DIVERGENCE),
    "amihud_persistence": (lambda p: formulas.amihud_persistence(p), _final(staged_sql(WEEK, {"v_x": "abs(ret) / nullif(volume * close, 0)"}, {"v_y": _back("v_x")}), f"-({_corr('v_x', 'v_y', 20, 10)})", False)),
    "entropy": (
        lambda p: formulas.entropy(p),
        f"""with f as (select asset, date, row_number() over (partition by asset order by date) as k, {_list('ret', 20, 1)} as v from ({WEEK})), u as (select asset, date, len(v) as n, list_min(v) as lo, list_max(v) as hi, unnest(v) as y from f where k > 20 and len(v) >= 10),
b as (select asset, date, n, hi > lo as wide, case when hi > lo then least(floor((y - lo) / (hi - lo) * 10), 9) end as bin, count(*) as c from u group by all), g as (select asset, date, case when any_value(wide) then sum(c / n * log2(c / n)) else 0 end as value from b group by 1, 2) select f.asset, f.date, round(value, 9) as value from f left join g on g.asset = f.asset and g.date = f.date""",
    ),
    "tail_risk": (
        lambda p: formulas.tail_mean(p),
        f"with f as (select asset, date, row_number() over (partition by asset order by date) as k, {_list('ret', 60, 1)} as v from ({WEEK})) select asset, date, round(case when k > 60 and len(v) >= 30 then list_avg(list_filter(v, lambda y: y <= list_aggregate(v, 'quantile_cont', 0.05) + 1e-12)) end, 9) as value from f",
    ),
    "hurst_exponent": (
        lambda p: formulas.hurst(p),
        f"""with f as (select asset, date, row_number() over (partition by asset order by date) as k, {_list('ret', 100, 1)} as v from ({WEEK})), u as (select asset, date, len(v) as n, unnest(v) - list_avg(v) as y, unnest(range(len(v))) as i from f where k > 100 and len(v) >= 50),
w as (select asset, date, n, y, sum(y) over (partition by asset, date order by i) as s from u), g as (select asset, date, any_value(n) as n, (max(s) - min(s)) / stddev_samp(y) as rs from w group by 1, 2 having stddev_samp(y) > 1e-10) select f.asset, f.date, round(case when rs > 0 then ln(rs) / ln(n) - 0.5 end, 9) as value from f left join g on g.asset = f.asset and g.date = f.date""",
    ),
}
for _name, (_f, _sql) in _SHAPES.items():
    register(f"factor_{_name}", lambda spark, d, f=_f: formulas.signalled(f(week(spark, d))), f"select asset, date, value, round({cs_rank('value')}, 9) as signal from ({_sql})")


def _turnover(spark: SparkSession, d: str) -> DataFrame:
    shares = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.expr(f"cast((l_suppkey + {PER - 1}) div {PER} as bigint)").alias("asset")).agg(F.sum("l_quantity").alias("shares"))
    return formulas.signalled(formulas.turnover_rate(week(spark, d), shares))


register("factor_turnover_rate", _turnover, f"select asset, date, value, round({cs_rank('value')}, 9) as signal from (select asset, date, round(case when count(volume) {_frame(20)} >= 10 then avg(volume) {_frame(20)} / shares end, 9) as value from ({WEEK}) join (select ((l_suppkey + {PER - 1}) // {PER})::bigint as asset, sum(l_quantity) as shares from lineitem group by 1) using (asset))")
