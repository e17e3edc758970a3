"""Joins on time: as-of and validity intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, values: list[str], bucket: str = "day") -> DataFrame:
    """left with the values of right's last row at or before `at` for the same key; null where there is none.

    Windows run in a key's time buckets, so that a key with a large share of all
    rows is spread; what a bucket starts with comes from a row per key and bucket.
    Of right's rows at the same time the one with the largest values counts.
    """
    slot = F.date_trunc(bucket, at)
    known = right.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(by, at, F.struct(*values).alias("_seen"))
    both = left.withColumn("_left", F.lit(1)).unionByName(known, allowMissingColumns=True).withColumn("_slot", slot)
    order = Window.partitionBy(by, "_slot").orderBy(at, F.col("_left").asc_nulls_first(), "_seen").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_last", F.last("_seen", ignorenulls=True).over(order)).where("_left = 1")
    ends = both.groupBy(by, "_slot").agg(F.max(F.when(F.col("_seen").isNotNull(), F.struct(at, "_seen")))["_seen"].alias("_end"))
    earlier = Window.partitionBy(by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(by, "_slot", F.last("_end", ignorenulls=True).over(earlier).alias("_carry")).where("_carry is not null")
    seen = F.coalesce("_last", "_carry")
    return inside.join(carried, [by, "_slot"], "left").select(*left.columns, *[seen[v].alias(v) for v in values])


def validity(facts: DataFrame, key: str, start: str, tie: str) -> DataFrame:
    """facts with `until`, the last day before the key's next row; the end of time for the last one."""
    after = F.lead(start).over(Window.partitionBy(key).orderBy(start, tie))
    return facts.withColumn("until", F.coalesce(F.date_sub(after, 1), F.lit("9999-12-31").cast("date")))


def interval_join(facts: DataFrame, periods: DataFrame, key: str, at: str, start: str, until: str) -> DataFrame:
    """Facts with each period of their key that holds their date; both ends belong to it.

    Years are part of the equality, so a key with many rows is spread over its years.  A period is repeated for the
    years in which facts lie, which are asked for first: an open end costs no more than the facts' span.
    """
    first, last = facts.agg(F.min(F.year(at)), F.max(F.year(at))).first()
    years = F.sequence(F.greatest(F.year(start), F.lit(first)), F.least(F.year(until), F.lit(last)))
    meets = (F.year(start) <= F.lit(last)) & (F.year(until) >= F.lit(first)) if first is not None else F.lit(False)
    spread = periods.where(F.expr(f"{start} <= {until}") & meets).withColumn("_year", F.explode(years))
    return facts.withColumn("_year", F.year(at)).join(spread, [key, "_year"]).where(F.col(at).between(F.col(start), F.col(until))).drop("_year")
