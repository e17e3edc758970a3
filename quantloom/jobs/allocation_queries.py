"""Covariances and constrained weights of the names with the best monthly momentum, twice a year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import allocation, factors
from .catalog import MONTH, month, register
from .registry import _MOM, _SIGNAL_SQL
from .risk_queries import rounded

#: Names of a date: as many as a box of ten per cent each allows, and some.
NAMES = 14
_PLACED = "row_number() over (partition by date order by signal desc, asset)"
_WHEN = "signal is not null and month(date) in (6, 12)"


def _selected(spark: SparkSession, d: str) -> DataFrame:
    return factors.compute(month(spark, d), _MOM).where(_WHEN).selectExpr("date", "asset", f"{_PLACED} as place").where(f"place <= {NAMES}")


def _trailing(spark: SparkSession, d: str) -> DataFrame:
    return allocation.trailing(month(spark, d), _selected(spark, d))


_SELECTED = f"select date, asset from ({_SIGNAL_SQL}) where {_WHEN} qualify {_PLACED} <= {NAMES}"
# dates from 1997 on have windows without gaps for all names; on earlier ones too few rows are whole and variances stand alone
register(
    "covariances", lambda spark, d: rounded(allocation.covariances(_trailing(spark, d)), 9),
    f"""select method, date, a, b, round(cov, 9) as cov from ({allocation.covariances_sql(MONTH, _SELECTED)})""",
)
register("optimal_weights", lambda spark, d: rounded(allocation.optimal_weights(_trailing(spark, d))), None)
register("compare_methods", lambda spark, d: rounded(allocation.compare_methods(_trailing(spark, d))), None)
register("efficient_frontier", lambda spark, d: rounded(allocation.efficient_frontier(_trailing(spark, d), 6)), None)
