"""Replays of a portfolio whose capital, holdings and history decide what comes next, for a grid of configurations.

A date's picks depend on what is held (a penalty on turnover favours it), its
costs on the capital so far and its exposure on the returns so far: a fold over
dates, and the same fold for every configuration.  Spark does all that does not
depend on the fold: it ranks the signals of each date, keeps the names that any
configuration could ever pick, packs a date's names into one row and deals a copy
of these rows to each configuration.  A group is one configuration with a row for
each date; configurations run beside each other.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .portfolio import EXPOSURE


@dataclass(frozen=True)
class Config:
    """How a portfolio is replayed; costs in basis points, borrowing by the year."""

    name: str
    longs: int = 20
    shorts: int = 20
    long_share: float = 1.15
    short_share: float = 0.15
    inverse_volatility: bool = True
    penalty: float = 0.25
    cost_model: str = "sqrt"
    commission: float = 1.0
    spread: float = 5.0
    impact: float = 0.3
    borrow: float = 30.0
    sales_fee: float = 0.8
    capital: float = 10_000.0
    target_volatility: float = 0.0
    drawdown_control: bool = False

    def __post_init__(self):
        if self.cost_model not in ("fixed", "tiered", "linear", "sqrt", "full", "default"):
            raise ValueError(f"no cost model {self.cost_model}")
        if self.longs < 1 or self.shorts < 1:
            raise ValueError("a portfolio has long and short names")


#: Rows before a history says something, its bounds, and how drawdowns cut exposure.
VOLATILITY_ROWS, LEAST_SCALE, MOST_SCALE = 6, 0.3, 1.5
DRAWDOWN_ROWS, DRAWDOWN_STEPS = 3, ((0.25, 0.25), (0.20, 0.50), (0.10, 0.80))
#: Dollars traded a day: at least, and where it is unknown.
LEAST_ADV, UNKNOWN_ADV = 1e4, 1e9


def book(panel: DataFrame, signals: DataFrame) -> DataFrame:
    """date, asset, signal, ret, tradable, adv and iv (one over the deviation of twelve returns) of a dense panel and signals of it."""
    frame = "over (partition by asset order by date rows between 11 preceding and current row)"
    rows = panel.selectExpr(
        "date", "asset", "ret", "coalesce(price > 0 and ret is not null, false) as tradable", "case when close is not null then close * volume end as adv",
        f"case when count(ret) {frame} >= 12 then 1 / nullif(round(stddev_samp(ret) {frame}, 12), 0) end as iv",
    )
    return rows.join(signals.select("date", "asset", F.round("signal", 9).alias("signal")), ["date", "asset"], "left")


def target_weights(rows: DataFrame, config: Config) -> DataFrame:
    """date, asset and weight of the tradable names with the largest and the smallest signals: longs by inverse volatility, or
    alike where no name has one, shorts alike and negative; dates with fewer names than both sides need have none."""
    valid = rows.where("tradable and signal is not null").selectExpr(
        "date", "asset", "iv", "row_number() over (partition by date order by signal desc, asset) as up", "row_number() over (partition by date order by signal, asset) as down", "count(*) over (partition by date) as n"
    )
    picked = valid.where(f"n >= {config.longs + config.shorts} and (up <= {config.longs} or down <= {config.shorts})")
    side = Window.partitionBy("date")
    mine = F.when(F.col("up") <= config.longs, F.col("iv"))
    total = F.sum(mine).over(side)
    alike = F.lit(config.long_share / config.longs)
    long_weight = F.when(total.isNotNull(), F.col("iv") / total * config.long_share).otherwise(alike) if config.inverse_volatility else alike
    weighed = picked.withColumn("long", F.when(F.col("up") <= config.longs, long_weight)).withColumn("short", F.when(F.col("down") <= config.shorts, F.lit(-config.short_share / config.shorts)))
    return weighed.select("date", "asset", F.explode(F.array_compact(F.array("long", "short"))).alias("weight"))


def candidates(rows: DataFrame, most: int) -> DataFrame:
    """A row for each date with the names that a fold of `most` positions may pick or hold then, and how many names it could pick from.

    A pick is among the `most` largest or smallest signals of its date, as no more than `most` names are moved by a
    penalty, or was picked before: what counts are the names that are so on some date.
    """
    valid = F.col("tradable") & F.col("signal").isNotNull()
    by = lambda order: F.row_number().over(Window.partitionBy("date", "_valid").orderBy(order, "asset"))
    ranked = rows.withColumn("_valid", valid).withColumn("_up", by(F.desc("signal"))).withColumn("_down", by(F.asc("signal")))
    ranked = ranked.withColumn("_n", F.count(F.when(F.col("_valid"), 1)).over(Window.partitionBy("date")))
    ever = ranked.withColumn("_ever", F.max(F.col("_valid") & (F.least("_up", "_down") <= most)).over(Window.partitionBy("asset")))
    name = F.struct("asset", "signal", "ret", "tradable", "adv", "iv")
    return ever.where("_ever").groupBy("date").agg(F.max("_n").alias("valid"), F.sort_array(F.collect_list(name)).alias("names"))


def _scale(config: Config, returns: list[float], values: list[float], peak: float) -> float:
    scale = 1.0
    if config.target_volatility > 0 and len(returns) >= VOLATILITY_ROWS:
        realized = float(np.std(returns[-VOLATILITY_ROWS:], ddof=1)) * math.sqrt(12)
        if realized >= 0.01:
            scale = min(max(config.target_volatility / realized, LEAST_SCALE), MOST_SCALE)
    if config.drawdown_control and len(values) >= DRAWDOWN_ROWS:
        fall = (values[-1] - peak) / peak
        scale *= next((s for limit, s in DRAWDOWN_STEPS if fall < -limit), 1.0)
    return scale


def rebalance_cost(config: Config, capital: float, turnover: int, changed: list, advs: list[float], positions: int, short_total: float) -> float:
    """The cost of a date's trades as a share of the capital, which decides how large they are against what is traded."""
    mean = EXPOSURE / max(positions, 1)
    commission, spread, fee = config.commission / 1e4, config.spread / 1e4, config.sales_fee / 1e4
    if config.cost_model == "fixed":
        return turnover * mean * (commission + spread / 2)
    if config.cost_model == "tiered":
        value = capital * mean
        return turnover * mean * (0.002 if value < 1e4 else 0.001 if value < 1e5 else 0.0005)
    if config.cost_model == "default":
        return turnover * mean * 0.001 + turnover * mean * fee * 0.5
    cost = short_total * config.borrow / 1e4 / 12
    for adv in advs[: len(changed)]:
        part = max(capital * mean / (adv + 1e-6), 0.0)
        moved = min(part, 0.5) if config.cost_model == "linear" else math.sqrt(min(part, 1.0))
        cost += (commission + spread / 2) * mean + config.impact * moved * mean + fee * mean * 0.5
    return cost


_SERIES = "config string, date date, gross double, cost double, net double, capital double, trades long, longs long, shorts long"


def _fold(configs: dict[str, Config]):
    schema = pa.schema([("config", pa.string()), ("date", pa.date32()), *[(c, pa.float64()) for c in ("gross", "cost", "net", "capital")], *[(c, pa.int64()) for c in ("trades", "longs", "shorts")]])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("date")
        out: list[tuple] = []
        c = configs[table["config"][0].as_py()] if table.num_rows else None
        capital = peak = c.capital if c else 0.0
        longs: dict = {}
        shorts: dict = {}
        returns: list[float] = []
        values: list[float] = []
        for date, valid, names in zip(table["date"].to_pylist(), table["valid"].to_pylist(), table["names"], strict=True):
            flat = names.values
            asset = flat.field("asset").to_pylist()
            place = {a: k for k, a in enumerate(asset)}
            signal, ret, adv, iv = (flat.field(x).to_numpy(zero_copy_only=False).astype(float) for x in ("signal", "ret", "adv", "iv"))
            tradable = flat.field("tradable").to_numpy(zero_copy_only=False).astype(bool)
            earned = lambda held: sum(w * ret[place[a]] for a, w in held.items() if a in place and not math.isnan(ret[place[a]]))  # noqa: E731, B023
            gross, cost, trades = earned(longs) - earned(shorts), 0.0, 0
            if valid >= c.longs + c.shorts:
                pick = np.flatnonzero(tradable & ~np.isnan(signal))
                score = signal[pick] + c.penalty * (np.array([asset[k] in longs for k in pick], float) - np.array([asset[k] in shorts for k in pick], float))
                high, low = pick[np.argsort(-score, kind="stable")][: c.longs], pick[np.argsort(score, kind="stable")][: c.shorts]  # ties go to the smaller asset
                scale = _scale(c, returns, values, peak)
                known = [k for k in high if not math.isnan(iv[k])] if c.inverse_volatility else []
                whole = sum(iv[k] for k in known)
                new_longs = {asset[k]: iv[k] / whole * c.long_share * scale for k in known} if known else {asset[k]: c.long_share * scale / c.longs for k in high}
                new_shorts = {asset[k]: c.short_share * scale / c.shorts for k in low}
                opened = [a for a in new_longs if a not in longs], [a for a in new_shorts if a not in shorts]
                closed = [a for a in longs if a not in new_longs], [a for a in shorts if a not in new_shorts]
                # what can't be traded leaves the book without a trade
                trades = sum(map(len, opened)) + sum(a in place and bool(tradable[place[a]]) for side in closed for a in side)
                changed = sorted({a for side in (*opened, *closed) for a in side})
                traded = [adv[place[a]] if a in place else math.nan for a in changed]
                advs = [UNKNOWN_ADV if math.isnan(x) else max(x, LEAST_ADV) for x in traded]
                cost = rebalance_cost(c, capital, trades, changed, advs, len(new_longs) + len(new_shorts), sum(new_shorts.values()))
                longs, shorts = new_longs, new_shorts
            net = gross - cost
            if longs or shorts or net != 0:
                capital *= 1 + net
                returns.append(net)
                values.append(capital)
                peak = capital if len(values) == 1 else max(peak, capital)
                out.append((c.name, date, gross, cost, net, capital, trades, len(longs), len(shorts)))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)

    return run


def replay(rows: DataFrame, configs: list[Config]) -> DataFrame:
    """For each configuration and each date with positions: return before and after costs, capital, trades, numbers of positions.

    rows are those of book().  A date earns what was held before it, then trades; names without a signal or a return
    can't be picked.  Exposure is scaled by the volatility and the drawdown of the portfolio's own past, where the
    configuration says so.  Configurations need different names (else a ValueError); without rows the result is empty.
    """
    if len({c.name for c in configs}) < len(configs) or not configs:
        raise ValueError("configurations need names of their own")
    dates = candidates(rows, max(c.longs + c.shorts for c in configs))
    dealt = dates.withColumn("config", F.explode(F.array(*[F.lit(c.name) for c in configs])))
    return dealt.groupBy("config").applyInArrow(_fold({c.name: c for c in configs}), _SERIES)


ROUNDED = ("config", "date", "round(gross, 9) as gross", "round(cost, 9) as cost", "round(net, 9) as net", "round(capital, 1) as capital", "trades", "longs", "shorts")

_PEAK = "greatest(max(capital) over (partition by config order by date), first_capital)"
_MEASURES = (
    "config", "count(*) as months", "round(power(max_by(capital, date) / max(first_capital), 1 / greatest(datediff(max(date), min(date)) / 365.25, 0.01)) - 1, 6) as cagr",
    "round(coalesce(avg(net) / nullif(round(stddev_samp(net), 12), 0) * sqrt(12e0), 0), 5) as sharpe", "round(coalesce(avg(net) * 12 / nullif(round(stddev_samp(case when net < 0 then net end), 12) * sqrt(12e0), 0), 0), 5) as sortino",
    "round(min(capital / peak - 1), 6) as max_drawdown", "round(avg(case when net > 0 then 1e0 else 0e0 end), 6) as win_rate", "round(max_by(capital, date), 1) as final_value", "sum(trades) as trades",
    "round(covar_samp(net, m) / nullif(round(var_samp(m), 14), 0), 5) as beta", "avg(m) as mean_m",
)
_ALPHA = ("config", "months", "cagr", "sharpe", "sortino", "max_drawdown", "win_rate", "final_value", "trades", "beta", "round(cagr - coalesce(beta, 1) * (power(1 + mean_m, 12) - 1), 5) as alpha")


def measures(series: DataFrame, market: DataFrame, configs: list[Config]) -> DataFrame:
    """A row for each configuration with positions: growth a year, ratios, drawdown, and alpha and beta against the market (date, m)."""
    first = F.create_map(*[x for c in configs for x in (F.lit(c.name), F.lit(c.capital))])[F.col("config")]
    rows = series.withColumn("first_capital", first).join(market, "date", "left").selectExpr("*", f"{_PEAK} as peak")
    return rows.groupBy("config").agg(*[F.expr(m) for m in _MEASURES[1:]]).selectExpr(*_ALPHA)


def book_sql(panel: str, signals: str) -> str:
    frame = "over (partition by asset order by date rows between 11 preceding and current row)"
    return f"""select p.date, p.asset, ret, coalesce(price > 0 and ret is not null, false) as tradable, case when close is not null then close * volume end as adv,
        case when count(ret) {frame} >= 12 then 1 / nullif(round(stddev_samp(ret) {frame}, 12), 0) end as iv, round(signal, 9) as signal
      from ({panel}) p left join (select date, asset, signal from ({signals})) s using (date, asset)"""


def target_weights_sql(book: str, config: Config) -> str:
    c, mean = config, f"{config.long_share}e0 / {config.longs}"
    weight = f"coalesce(iv / (sum(case when up <= {c.longs} then iv end) over (partition by date)) * {c.long_share}e0, case when sum(case when up <= {c.longs} then iv end) over (partition by date) is null then {mean} end)" if c.inverse_volatility else mean
    return f"""with v as (select *, row_number() over (partition by date order by signal desc, asset) as up, row_number() over (partition by date order by signal, asset) as down, count(*) over (partition by date) as n from ({book}) where tradable and signal is not null),
    w as (select date, asset, up, down, {weight} as long_weight from v where n >= {c.longs + c.shorts} and (up <= {c.longs} or down <= {c.shorts}))
    select date, asset, long_weight as weight from w where up <= {c.longs} and long_weight is not null union all select date, asset, -{c.short_share}e0 / {c.shorts} from w where down <= {c.shorts}"""


def replay_sql(book: str, configs: list[Config]) -> str:
    """DuckDB SQL of replay() on a dense book: one recursion over dates, in which lists by asset stand for rows."""
    values = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v}" if isinstance(v, int) else f"{v!r}::double" for v in asdict(c).values()) + ")" for c in configs)
    dd = " ".join(f"when (capital - peak) / peak < -{limit} then {s}e0" for limit, s in DRAWDOWN_STEPS)
    return f"""
with recursive cfg({', '.join(asdict(configs[0]))}) as (values {values}),
b as ({book}),
d as (
    select row_number() over (order by date) as i, * from (
        select date, list(signal order by asset) as sig, list(ret order by asset) as ret, list(tradable order by asset) as trad, list(case when adv is null then {UNKNOWN_ADV!r} else greatest(adv, {LEAST_ADV}) end order by asset) as adv, list(iv order by asset) as iv
        from b group by date)
),
days as (select *, list_filter(range(1, len(sig) + 1), lambda k: trad[k] and sig[k] is not null) as valid from d),
f as (
    select name as config, 0::bigint as i, null::date as date, 0e0 as gross, 0e0 as cost, 0e0 as net, capital, capital as peak, []::double[] as history, []::struct(k bigint, w double)[] as longs, []::bigint[] as shorts, 0e0 as sw, 0::bigint as trades, false as kept from cfg
    union all
    select config, i, date, gross, cost, net, case when kept then capital * (1 + net) else capital end, case when not kept then peak when len(history) = 0 then capital * (1 + net) else greatest(peak, capital * (1 + net)) end,
        case when kept then list_append(history, net) else history end, new_longs, new_shorts, new_sw, trades, kept
    from (select *, gross - cost as net, len(new_longs) + len(new_shorts) > 0 or gross - cost <> 0 as kept from (
    select *, case when not go then 0
        when cost_model = 'fixed' then trades * mean * (commission / 1e4 + spread / 2e4)
        when cost_model = 'tiered' then trades * mean * (case when capital * mean < 1e4 then 0.002 when capital * mean < 1e5 then 0.001 else 0.0005 end)
        when cost_model = 'default' then trades * mean * (0.001 + sales_fee / 2e4)
        else coalesce(list_sum(list_transform(changed, lambda k: (commission / 1e4 + spread / 2e4) * mean + sales_fee / 2e4 * mean + impact * mean * (
            case when cost_model = 'linear' then least(greatest(capital * mean / (adv[k] + 1e-6), 0), 0.5) else sqrt(least(greatest(capital * mean / (adv[k] + 1e-6), 0), 1)) end))), 0) + new_sw * len(new_shorts) * borrow / 12e4 end as cost
    from (
    select *, case when go then {EXPOSURE} / greatest(len(new_longs) + len(new_shorts), 1) else 0 end as mean, case when go then list_distinct(list_concat(opened, closed)) else [] end as changed,
        case when go then len(opened) + len(list_filter(closed, lambda k: trad[k])) else 0 end::bigint as trades
    from (
    select *, list_concat(list_filter(nk, lambda k: not list_contains(lk, k)), list_filter(new_shorts, lambda k: not list_contains(shorts, k))) as opened,
        list_concat(list_filter(lk, lambda k: not list_contains(nk, k)), list_filter(shorts, lambda k: not list_contains(new_shorts, k))) as closed
    from (
    select *, list_transform(new_longs, lambda x: x.k) as nk, case when go then short_share * scale / n_shorts else sw end as new_sw, case when go then list_transform(low, lambda x: x.k) else shorts end as new_shorts
    from (
    select *, case when not go then longs when inverse_volatility and len(known) > 0 then list_transform(known, lambda x: {{'k': x.k, 'w': iv[x.k] / list_sum(list_transform(known, lambda y: iv[y.k])) * long_share * scale}})
        else list_transform(high, lambda x: {{'k': x.k, 'w': long_share * scale / n_longs}}) end as new_longs
    from (
    select *, list_filter(high, lambda x: iv[x.k] is not null) as known from (
    select *, list_sort(list_transform(valid, lambda k: {{'s': -(sig[k] + penalty * list_contains(lk, k)::int - penalty * list_contains(shorts, k)::int), 'k': k}}))[1:n_longs] as high,
        list_sort(list_transform(valid, lambda k: {{'s': sig[k] + penalty * list_contains(lk, k)::int - penalty * list_contains(shorts, k)::int, 'k': k}}))[1:n_shorts] as low
    from (
    select f.config, days.i, days.date, f.capital, f.peak, f.history, f.longs, f.shorts, f.sw, sig, ret, trad, adv, iv, valid, penalty, c.longs as n_longs, c.shorts as n_shorts, long_share, short_share, inverse_volatility, cost_model, commission, spread, impact, borrow, sales_fee,
        list_transform(f.longs, lambda x: x.k) as lk, len(valid) >= c.longs + c.shorts as go,
        coalesce(list_sum(list_transform(f.longs, lambda x: x.w * coalesce(ret[x.k], 0))), 0) - f.sw * coalesce(list_sum(list_transform(f.shorts, lambda k: coalesce(ret[k], 0))), 0) as gross,
        case when target_volatility > 0 and len(history) >= {VOLATILITY_ROWS} and list_stddev_samp(history[-{VOLATILITY_ROWS}:]) * sqrt(12) >= 0.01 then least(greatest(target_volatility / (list_stddev_samp(history[-{VOLATILITY_ROWS}:]) * sqrt(12)), {LEAST_SCALE}), {MOST_SCALE}) else 1e0 end
            * case when drawdown_control and len(history) >= {DRAWDOWN_ROWS} then case {dd.replace("capital", "f.capital").replace("peak", "f.peak")} else 1e0 end else 1e0 end as scale
    from f join days on days.i = f.i + 1 join cfg c on c.name = f.config
    )))))))))
)
select config, date, gross, cost, net, capital, trades, len(longs)::bigint as longs, len(shorts)::bigint as shorts from f where kept"""


def measures_sql(series: str, market: str, configs: list[Config]) -> str:
    first = " ".join(f"when '{c.name}' then {c.capital!r}" for c in configs)
    body = ", ".join(m.replace("datediff(max(date), min(date))", "datediff('day', min(date), max(date))").replace("sum(trades)", "sum(trades)::bigint").replace("max_by", "arg_max") for m in _MEASURES)
    return f"select {', '.join(_ALPHA)} from (select {body} from (select *, {_PEAK} as peak from (select *, case config {first} end as first_capital from ({series})) left join ({market}) using (date)) group by config)"
