"""Replays with growing capital, their grids and their sensitivities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import factors, simulation
from ..operators.simulation import Config
from .catalog import MARKET, MONTH, market, month, register
from .registry import _MOM, _SIGNAL_SQL

BASE = Config("base")
#: The levels and changes of the sensitivity tables.
COST_LEVELS = (0.5, 1.0, 2.0, 3.0, 5.0, 10.0)
COSTS = [Config(f"{bps} bps", commission=bps, spread=1.5 * bps) for bps in COST_LEVELS]
PARAMETERS = [
    Config("L20/S20"), Config("L15/S20", longs=15), Config("L30/S20", longs=30), Config("S10", shorts=10), Config("S30", shorts=30),
    Config("long only", longs=20, shorts=1, long_share=1.0, short_share=0.0), Config("130/30", long_share=1.3, short_share=0.3),
]
TRIPLE = [BASE, Config("triple costs", commission=3.0, spread=15.0, impact=0.9, borrow=90.0)]
GRID = [Config(f"{model} {penalty}", cost_model=model, penalty=penalty, capital=1e7) for model in ("fixed", "tiered", "linear", "sqrt", "full", "default") for penalty in (0.0, 0.25)]
SCALED = [Config("volatility", target_volatility=0.1), Config("drawdown", drawdown_control=True), Config("both", target_volatility=0.1, drawdown_control=True, capital=1e8), Config("alike", inverse_volatility=False, target_volatility=0.02, drawdown_control=True)]

BOOK = simulation.book_sql(MONTH, _SIGNAL_SQL)


def _book(spark: SparkSession, d: str) -> DataFrame:
    keep = ("ret", "price", "close", "volume")
    rows = factors.compute(month(spark, d), _MOM, keep=keep)
    return simulation.book(rows, rows)


def _series(configs: list[Config]):
    return lambda spark, d: simulation.replay(_book(spark, d), configs).selectExpr(*simulation.ROUNDED)


def _table(configs: list[Config]):
    return lambda spark, d: simulation.measures(simulation.replay(_book(spark, d), configs), market(spark, d), configs)


def _rounded(sql: str) -> str:
    return f"select {', '.join(simulation.ROUNDED)} from ({sql})"


for _name, _configs in (("replay_capital", [BASE]), ("replay_grid", GRID), ("replay_scaled", SCALED)):
    register(_name, _series(_configs), _rounded(simulation.replay_sql(BOOK, _configs)))
for _name, _configs in (("cost_sensitivity", COSTS), ("parameter_sensitivity", PARAMETERS), ("triple_costs", TRIPLE)):
    register(_name, _table(_configs), simulation.measures_sql(simulation.replay_sql(BOOK, _configs), MARKET, _configs))
register(
    "target_weights_inverse_volatility", lambda spark, d: simulation.target_weights(_book(spark, d), BASE).selectExpr("date", "asset", "round(weight, 9) as weight"),
    f"select date, asset, round(weight, 9) as weight from ({simulation.target_weights_sql(BOOK, BASE)})",
)
