"""Price and volume factors: stages of window expressions, then a cross-section rank.

Each factor is a list of stages; a stage names columns and gives their
expressions, and the last stage gives `value`.  All stages up to the rank are
partitioned by asset, so a factor costs one exchange by asset and one by date.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..functions.frames import back, compound, cs_place, cs_rank, cs_share, dealt, frame, ratio, roll, roll2, roll_corr

Stages = list[dict[str, str]]


def _v(x: str) -> Stages:
    return [{"value": x}]


_PAST = frame(36, 1)
MONTHLY: dict[str, Stages] = {
    "momentum_12_1": _v(compound("ret", 12, 1)),
    "multi_timeframe_momentum": [{"vol": roll("stddev_samp", "ret", 12, 1), "a": compound("ret", 12, 1), "b": compound("ret", 6, 1), "c": compound("ret", 3, 1)}, {"value": f"0.25 * {ratio('a', 'vol')} + 0.35 * {ratio('b', 'vol')} + 0.40 * {ratio('c', 'vol')}"}],
    "momentum_acceleration": _v(f"{compound('ret', 3, 1)} - {compound('ret', 3, 4)}"),
    "high_52_week": [{"r": ratio("close", roll("max", "close", 12))}, {"value": back("r")}],
    "volatility_12m": _v(f"{roll('stddev_samp', 'ret', 12, 1)} * sqrt(12e0)"),
    "vol_of_vol_12m": [{"s": roll("stddev_samp", "ret", 12, 1)}, {"value": roll("stddev_samp", "s", 12)}],
    "downside_vol": [{"d": "least(ret, 0e0)", "r": "ret"}, {"d": "case when r is not null then d end"}, {"value": f"{roll('stddev_samp', 'd', 12, 1)} * sqrt(12e0)"}],
    "max_return_12m": _v(roll("max", "ret", 12, 1)),
    "vol_term_structure": _v(ratio(roll("stddev_samp", "ret", 3, 1), roll("stddev_samp", "ret", 12, 1))),
    "skewness_12m": [{"k": f"count(ret) over {frame(12, 1)}", "g": f"skewness(ret) over {frame(12, 1)}"}, {"value": "round(case when k >= 12 then g * sqrt(132e0) / 10 end, 6)"}],
    "beta_market": [{"c": f"case when count(*) over {_PAST} >= 36 and count(case when mkt is not null then ret end) over {_PAST} >= 18 then covar_samp(ret, mkt) over {_PAST} end", "v": f"var_pop(mkt) over {_PAST}"}, {"value": "c / nullif(case when v >= 1e-10 then v end, 0)"}],
    "vol_momentum": [{"s": roll("stddev_samp", "ret", 12, 1)}, {"value": f"{ratio('s', back('s', 3))} - 1"}],
}

_RANGE = ratio("close - low", "high - low")
#: The last 20 rows before the current one that have a return and a volume.
_WHOLE = "(partition by asset, whole order by date rows between 20 preceding and 1 preceding)"
DAILY: dict[str, Stages] = {
    "momentum_5d": _v(f"{ratio('close', back('close', 5))} - 1"),
    "momentum_20d": _v(f"{ratio('close', back('close', 20))} - 1"),
    "momentum_reversal_5d": _v(f"-{roll('sum', 'ret', 5)}"),
    "volume_surge": _v(ratio("volume", roll("avg", "volume", 20))),
    "dollar_volume_rank": _v("volume * close"),
    "volume_price_trend": [{"x": f"sign(close - {back('close')}) * volume"}, {"value": roll("sum", "x", 20)}],
    "vwap_deviation": _v(ratio("close - vwap", "vwap")),
    "vwap_reversion": [{"x": ratio("close - vwap", "vwap")}, {"value": f"-{roll('sum', 'x', 5)}"}],
    "realized_vol_20d": _v(f"-{roll('stddev_samp', 'ret', 20, least=15)} * sqrt(252e0)"),
    "vol_breakout": [{"x": "abs(ret)"}, {"value": ratio("x", roll("avg", "x", 20))}],
    "vol_breakout_hl": [{"x": ratio("high - low", "close")}, {"value": ratio("x", roll("avg", "x", 20))}],
    "overnight_gap": _v(f"{ratio('open_', back('close'))} - 1"),
    "amihud_illiquidity": [{"x": ratio("abs(ret)", "volume * close")}, {"value": f"-{roll('avg', 'x', 20, least=10)}"}],
    "trade_intensity": _v(ratio("volume", "trade_count")),
    "high_low_spread": _v(f"-{ratio('high - low', 'close')}"),
    "order_flow_imbalance": [{"x": f"volume * (2 * greatest(least({_RANGE}, 1e0), 0e0) - 1)", "r": _RANGE}, {"x": "case when r is not null then x end"}, {"value": roll("sum", "x", 10)}],
    "realized_spread": [{"x": ratio("2 * close - high - low", "close")}, {"value": roll("avg", "x", 20)}],
    "overnight_return": [{"x": f"{ratio('open_', back('close'))} - 1"}, {"value": roll("sum", "x", 20)}],
    "intraday_return": [{"x": f"{ratio('close', 'open_')} - 1"}, {"value": roll("sum", "x", 20)}],
    "overnight_intraday_divergence": [{"x": f"{ratio('open_', back('close'))} - {ratio('close', 'open_')}"}, {"value": roll("sum", "x", 20)}],
    "price_volume_correlation": _v(roll_corr("ret", "volume", 20)),
    "volume_autocorrelation": [{"x": back("volume")}, {"value": roll_corr("volume", "x", 20)}],
    "abnormal_volume_return": [{"m": roll("avg", "volume", 20)}, {"x": "case when ret is null then null when volume > 2 * m then ret else 0e0 end"}, {"value": roll("sum", "x", 20)}],
    "garman_klass_vol": [{"x": f"0.5e0 * power(ln({ratio('high', 'low')}), 2) - (2 * ln(2e0) - 1) * power(ln({ratio('close', 'open_')}), 2)"}, {"m": roll("avg", "x", 20)}, {"value": "case when m >= 0 then 0e0 - sqrt(greatest(m, 0e0)) end"}],
    "tick_size_clustering": [{"c": "round(close, 6) % 1"}, {"x": "case when c < 0.02 or c > 0.98 or abs(c - 0.5) < 0.02 then 1e0 else 0e0 end"}, {"value": f"0e0 - {roll('avg', 'x', 20)}"}],
    "kyle_lambda": [{"whole": "case when ret is not null and volume is not null then 1 else 0 end"}, {"value": f"case when whole = 1 and count(*) over {_WHOLE} >= 20 then 0e0 - covar_pop(abs(ret), volume) over {_WHOLE} / nullif(var_pop(volume) over {_WHOLE}, 0) end"}],
    "parkinson_vol": [{"x": f"power(ln({ratio('high', 'low')}), 2)"}, {"value": f"-sqrt({roll('avg', 'x', 20)} / (4 * ln(2e0)))"}],
    "vol_of_vol": [{"s": roll("stddev_samp", "ret", 10)}, {"value": f"-{roll('stddev_samp', 's', 60)}"}],
    "range_expansion": [{"x": "high - low"}, {"value": f"{ratio('x', roll('avg', 'x', 20))} * ({_RANGE} * 2 - 1)"}],
    "relative_strength_vs_market": [{"x": "ret - mkt"}, {"value": roll("sum", "x", 20)}],
    "beta_adjusted_momentum": [{"c": roll2("covar_samp", "ret", "mkt", 60), "v": roll("var_samp", "mkt", 60)}, {"x": f"ret - {ratio('c', 'v')} * mkt"}, {"value": roll("sum", "x", 60)}],
}

ALPHA: dict[str, Stages] = {
    "liquidity_shock": [{"x": "volume * close"}, {"value": ratio(roll("avg", "x", 5, least=2), roll("avg", "x", 60, least=30))}],
    "higher_highs": [{"p": back("high")}, {"x": "case when high > p then 1e0 else 0e0 end"}, {"value": roll("sum", "x", 20, least=10)}],
    "lower_lows": [{"p": back("low")}, {"x": "case when low < p then 1e0 else 0e0 end"}, {"value": f"-{roll('sum', 'x', 20, least=10)}"}],
    "price_acceleration": _v(f"({ratio('price', back('price', 5))} - 1) - ({ratio('price', back('price', 20))} - 1) * 0.25e0"),
    "support_distance": _v(f"-{ratio('close - ' + roll('min', 'low', 60, least=30), 'close')}"),
    "resistance_distance": _v(f"-{ratio(roll('max', 'high', 60, least=30) + ' - close', 'close')}"),
    "candlestick_body": _v(ratio("abs(close - open_)", "high - low")),
    "autocorrelation": [{"x": back("ret")}, {"value": roll_corr("ret", "x", 20, 10)}],
    "variance_ratio": [{"s": roll("sum", "ret", 20, least=10), "v": roll("var_samp", "ret", 5, least=2)}, {"value": f"{ratio(roll('var_samp', 's', 20, least=10), 'v * 4')} - 1"}],
    "co_movement": _v(f"-{roll_corr('ret', 'mkt', 20, 10)}"),
    "lead_lag": [{"x": "lead(mkt, 1) over (partition by asset order by date)"}, {"value": roll_corr("ret", "x", 20, 10)}],
    "lead_lag_leak_free": [{"x": back("ret")}, {"value": roll_corr("x", "mkt", 20, 10)}],
    "frog_in_pan": [{"u": "case when ret > 0 then 1e0 when ret is not null then 0e0 end", "d": "case when ret < 0 then 1e0 when ret is not null then 0e0 end"}, {"value": f"sign({roll('sum', 'ret', 60, least=30)}) * ({roll('avg', 'u', 60, least=30)} - {roll('avg', 'd', 60, least=30)})"}],
    "max_return": _v(f"-{roll('max', 'ret', 20, least=10)}"),
    "time_series_momentum": _v(roll("sum", "ret", 252, least=126)),
    "momentum_crash_filter": [{"m": roll("sum", "ret", 60, least=30), "k": roll("sum", "mkt", 60, least=30)}, {"value": "m * (1 - 0.5e0 * case when k < -0.10 then 1 else 0 end)"}],
    "commodity_beta": [{"xy": "ret * mkt"}, {"value": ratio(f"{roll('avg', 'xy', 60, least=30)} - {roll('avg', 'ret', 60, least=30)} * {roll('avg', 'mkt', 60, least=30)}", roll("var_samp", "mkt", 60, least=30))}],
    "roll_spread": [{"p": back("ret")}, {"c": roll2("covar_samp", "ret", "p", 20, 10)}, {"value": "case when c is not null then 0e0 - 2 * sqrt(greatest(-c, 0e0)) end"}],
    "correlation_regime": _v(f"-{roll_corr('ret', 'mkt', 60, 30)}"),
}


#: Published formulas on prices and volumes; ranks in them are shares of a date's cross-section.
FORMULAS: dict[str, Stages] = {
    "002": [{"p": back("volume", 2)}, {"a": "round(ln(nullif(volume, 0)) - ln(nullif(p, 0)), 9)", "b": f"round({ratio('close - open_', 'open_')}, 9)"}, {"a": cs_share("a"), "b": cs_share("b")}, {"value": f"0e0 - {roll_corr('a', 'b', 6)}"}],
    "006": _v(f"0e0 - {roll_corr('open_', 'volume', 10)}"),
    "012": [{"d": f"round(close - {back('close')}, 7)", "v": f"volume - {back('volume')}"}, {"value": "0e0 - sign(v) * d"}],
    "033": [{"x": f"round({ratio('open_', 'close')} - 1, 9)"}, {"value": cs_share("x")}],
    "040": [{"s": f"round({roll('stddev_samp', 'high', 10)}, 6)", "c": roll_corr("high", "volume", 10)}, {"value": f"0e0 - {cs_share('s')} * c"}],
    "042": [{"a": "round(vwap - close, 6)", "b": "round(vwap + close, 6)"}, {"value": ratio(cs_share("a"), cs_share("b"))}],
    "044": [{"r": cs_share("volume")}, {"value": f"0e0 - {roll_corr('high', 'r', 5)}"}],
    "053": [{"x": ratio("(close - low) - (high - close)", "round(close - low, 6)")}, {"value": f"round({back('x', 9)} - x, 5)"}],
    "054": _v(f"round(0e0 - {ratio('(low - close) * power(open_, 5)', 'round(low - high, 6) * power(close, 5)')}, 6)"),
    "055": [{"a": roll("min", "low", 12), "b": roll("max", "high", 12)}, {"x": f"round({ratio('close - a', 'b - a')}, 9)", "r": cs_share("volume")}, {"x": cs_share("x")}, {"value": f"0e0 - {roll_corr('x', 'r', 6)}"}],
    "101": _v("round((close - open_) / (high - low + 0.001e0), 6)"),
}


#: Stages whose SQL differs: DuckDB's skewness is corrected for the sample's size already.
SQL_STAGES: dict[str, Stages] = {"skewness_12m": [MONTHLY["skewness_12m"][0], {"value": "round(case when k >= 12 then g end, 6)"}]}


def compute(panel: DataFrame, stages: Stages, least: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """asset, date, value (rounded, so that ties are ties) and signal, its rank in [-1, 1]; and columns to keep."""
    for stage in stages:
        panel = panel.selectExpr(*[c for c in panel.columns if c not in stage], *[f"{x} as {name}" for name, x in stage.items()])
    rounded = panel.selectExpr("asset", "date", *keep, "round(cast(value as double), 9) as value")
    return rounded.selectExpr("asset", "date", *keep, "value", f"round({cs_place('value', least)}, 9) as signal")


def compute_sql(panel_sql: str, columns: tuple[str, ...], stages: Stages, least: int = 10) -> str:
    q, cols = panel_sql, list(columns)
    for stage in stages:
        cols = [c for c in cols if c not in stage]
        q = f"select {', '.join([*cols, *[f'{x} as {name}' for name, x in stage.items()]])} from ({q})"
        cols += list(stage)
    q = f"select asset, date, round(cast(value as double), 9) as value from ({q})"
    return f"select asset, date, value, round({cs_rank('value', least)}, 9) as signal from ({q})"


#: Members of the composites by family, with signs and weights of 1.
FAMILIES: dict[str, tuple[str, ...]] = {
    "daily": ("momentum_5d", "momentum_20d", "momentum_reversal_5d", "volume_surge", "dollar_volume_rank", "volume_price_trend", "vwap_deviation", "vwap_reversion", "realized_vol_20d", "vol_breakout", "vol_breakout_hl", "overnight_gap", "amihud_illiquidity", "trade_intensity", "high_low_spread"),
    "advanced": ("kyle_lambda", "order_flow_imbalance", "realized_spread", "tick_size_clustering", "overnight_return", "intraday_return", "overnight_intraday_divergence", "volume_autocorrelation", "price_volume_correlation", "abnormal_volume_return", "garman_klass_vol", "parkinson_vol", "vol_of_vol", "range_expansion", "relative_strength_vs_market", "beta_adjusted_momentum"),
    "liquidity": ("roll_spread", "liquidity_shock"),
    "trend": ("higher_highs", "lower_lows", "price_acceleration", "support_distance", "resistance_distance", "candlestick_body"),
    "statistics": ("autocorrelation", "variance_ratio"),
    "network": ("co_movement", "lead_lag"),
    "behaviour": ("frog_in_pan", "max_return"),
    "dynamics": ("time_series_momentum", "momentum_crash_filter"),
}


def _own(x: str, name: str, seen: set[str]) -> str:
    """x with the factor's own columns under names that no other factor has."""
    return re.sub(r"\b(" + "|".join(sorted(seen)) + r")\b", rf"{name}__\1", x) if seen else x


def compute_all(panel: DataFrame, members: dict[str, Stages], least: int = 10, keep: tuple[str, ...] = (), size: int = 0) -> DataFrame:
    """factor, asset, date, columns to keep, value and signal of many factors from one pass: stages of equal depth share the frames' one exchange by asset.

    For factors whose stages look along an asset only; ranks take one exchange by factor and date, in parts that follow
    size (about how many rows panel has, if known).
    """
    for depth in range(max(len(s) for s in members.values())):
        more = []
        for name, stages in members.items():
            if depth < len(stages):
                seen = {c for stage in stages[:depth] for c in stage}
                more += [f"{_own(x, name, seen)} as {name}__{c}{'_' if c in seen else ''}" for c, x in stages[depth].items()]
        panel = panel.selectExpr("*", *more)
        again = {f"{name}__{c}" for name, stages in members.items() if depth < len(stages) for c in stages[depth] if any(c in s for s in stages[:depth])}
        panel = panel.drop(*again).withColumnsRenamed({f"{c}_": c for c in again})
    values = {name: f"{name}__value" for name in members}
    tall = panel.selectExpr("asset", "date", *keep, *[f"round(cast({c} as double), 9) as `{n}`" for n, c in values.items()]).unpivot(["asset", "date", *keep], list(values), "factor", "value")
    return dealt(tall, "factor", "date", size=size * len(members)).selectExpr("factor", "asset", "date", *keep, "value", f"round({cs_place('value', least, 'factor, date')}, 9) as signal")


def compute_all_sql(panel_sql: str, columns: tuple[str, ...], members: dict[str, Stages], least: int = 10) -> str:
    each = " union all ".join(f"select '{n}' as factor, * from ({compute_sql('select * from panel', columns, SQL_STAGES.get(n, s), least)})" for n, s in members.items())
    return f"with panel as materialized ({panel_sql}) {each}"
