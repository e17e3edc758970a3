"""Expressions over panels, as SQL text that DataFrame.selectExpr takes.

A panel has a row for each asset and date; frames count panel dates, so it must
be dense.  An aggregate over n rows is null unless n (or `least`) values are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a part where dealt() knows about how many rows there are.
PART_ROWS = 250_000
#: Parts that a size asks for at most: with more, Spark holds and sorts all that a task writes (spark.shuffle.sort.bypassMergeThreshold).
MOST_PARTS = 200


def frame(n: int, lag: int = 0) -> str:
    """The n rows of the asset that end `lag` rows before the current one (after it, if negative)."""
    first, last = n - 1 + lag, lag
    bound = lambda k: "current row" if k == 0 else f"{k} preceding" if k > 0 else f"{-k} following"
    return f"(partition by asset order by date rows between {bound(first)} and {bound(last)})"


def roll(agg: str, x: str, n: int, lag: int = 0, least: int | None = None) -> str:
    """agg(x) over n rows, where enough of them have x."""
    over = f"over {frame(n, lag)}"
    return f"(case when count({x}) {over} >= {least or n} then {agg}({x}) {over} end)"


def roll2(agg: str, x: str, y: str, n: int, least: int | None = None) -> str:
    """agg(x, y) over n rows, where enough of them have both."""
    over = f"over {frame(n)}"
    return f"(case when count(case when {x} is not null and {y} is not null then 1 end) {over} >= {least or n} then {agg}({x}, {y}) {over} end)"


def roll_corr(x: str, y: str, n: int, least: int | None = None) -> str:
    """Correlation over n rows of the pairs that are whole; null where one side does not vary."""
    over = f"over {frame(n)}"
    a, b = f"case when {y} is not null then {x} end", f"case when {x} is not null then {y} end"
    spread = f"nullif(round(sqrt(var_samp({a}) {over} * var_samp({b}) {over}), 12), 0)"
    return f"(case when count({a}) {over} >= {least or n} then covar_samp({x}, {y}) {over} / {spread} end)"


def product(x: str, over: str) -> str:
    """The product of x over a frame or group: of sizes by logarithms, with signs counted; 0 where one is 0."""
    odd = f"count(case when {x} < 0 then 1 end) {over}"
    return f"(case when count(case when {x} = 0 then 1 end) {over} > 0 then 0e0 else exp(sum(ln(nullif(abs({x}), 0))) {over}) * (1 - 2 * ({odd} % 2)) end)"


def compound(x: str, n: int, lag: int = 0) -> str:
    """Compounded return over n rows that all have one; -1 from a total loss on."""
    over = f"over {frame(n, lag)}"
    return f"(case when count({x}) {over} >= {n} then {product(f'(1 + {x})', over)} - 1 end)"


def back(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) over (partition by asset order by date)"


def ratio(a: str, b: str) -> str:
    """a / b; null where b is 0."""
    return f"(({a}) / nullif({b}, 0))"


def cs_rank(x: str, least: int = 10) -> str:
    """Average-rank percentile in the cross-section of a date, in [-1, 1]; null on dates with fewer than `least` values."""
    n = f"count({x}) over (partition by date)"
    place = f"(rank() over (partition by date order by {x} nulls last) + (count({x}) over (partition by date, {x}) - 1) / 2e0)"
    return f"(case when {x} is not null and {n} >= {least} then 2 * {place} / {n} - 1 end)"


def cs_place(x: str, least: int = 10, by: str = "date") -> str:
    """cs_rank() as Spark takes it with one sort: counts and ranks look at one order of each group, in place of three."""
    w = f"partition by {by} order by {x} nulls last"
    n = f"count({x}) over ({w} rows between unbounded preceding and unbounded following)"
    place = f"(rank() over ({w}) + (count({x}) over ({w} range between current row and current row) - 1) / 2e0)"
    return f"(case when {x} is not null and {n} >= {least} then 2 * {place} / {n} - 1 end)"


def average_rank(x: str, *by: str | Column) -> Column:
    """The average rank of x in its group, nulls last: ties are the rows of one place, so that one sort serves."""
    w = Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last())
    return F.rank().over(w) + (F.count(x).over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2


def dealt(rows: DataFrame, *by: str, size: int = 0) -> DataFrame:
    """rows by group in parts that are not put together again, so that a task's memory is that of its own groups.

    There are as many parts as the session has for an exchange, or one for each PART_ROWS of size (about how many rows
    there are, if known) where that is more, up to MOST_PARTS: till then a task's rows do not grow with the table.
    """
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // PART_ROWS), MOST_PARTS)), *by)


def wide(tall: DataFrame, names: list[str], *by: str, x: str = "signal") -> DataFrame:
    """by (date and asset) and a column for each of names, its x; tall has one x for a name and group at most.

    One aggregate where a pivot takes two, the first with a row for each name and group.
    """
    return tall.groupBy(*(by or ("date", "asset"))).agg(*[F.max(F.when(F.col("factor") == n, F.col(x))).alias(n) for n in names])


def cs_share(x: str) -> str:
    """Average-rank percentile in the cross-section of a date, in (0, 1]; dates may have any number of values."""
    place = f"(rank() over (partition by date order by {x} nulls last) + (count({x}) over (partition by date, {x}) - 1) / 2e0)"
    return f"(case when {x} is not null then {place} / nullif(count({x}) over (partition by date), 0) end)"


def cs_zscore(x: str, least: int = 10, clip: float = 3.0) -> str:
    """Standard score in the cross-section of a date, clipped; 0 where all are equal."""
    over = "over (partition by date)"
    sd = f"stddev_samp({x}) {over}"
    return f"(case when {x} is not null and count({x}) {over} >= {least} then case when {sd} < 1e-10 then 0.0 else greatest(least(({x} - avg({x}) {over}) / nullif({sd}, 0), {clip}), -{clip}) end end)"
