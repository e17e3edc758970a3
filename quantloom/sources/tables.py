"""Reading and writing: names and types made regular at the edge, news, partitioned panels, logs, wide and long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType


def conform(df: DataFrame, schema: StructType, aliases: dict[str, str] | None = None) -> DataFrame:
    """df with schema's columns and types: names are matched whatever their case, by alias too; what can't be cast, NaN and missing columns are null."""
    known = {c.lower(): c for c in df.columns}
    for other, name in (aliases or {}).items():
        if name.lower() not in known and other.lower() in known:
            known[name.lower()] = known[other.lower()]
    out = []
    for f in schema.fields:
        if f.name.lower() not in known:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        x = F.col(f"`{known[f.name.lower()]}`").try_cast(f.dataType)
        out.append((F.when(~F.isnan(x), x) if isinstance(f.dataType, (DoubleType, FloatType)) else x).alias(f.name))
    return df.select(*out)


def read_table(spark: SparkSession, path: str, schema: StructType, aliases: dict[str, str] | None = None, kind: str = "parquet") -> DataFrame:
    """A table of files (parquet, csv with a header, json) in schema's form."""
    reader = spark.read.format(kind)
    return conform((reader.option("header", True) if kind == "csv" else reader).load(path), schema, aliases)


NEWS = "headline string, created_at string, source string, symbols array<string>, url string, summary string"


def parse_news(lines: DataFrame, column: str = "value") -> DataFrame:
    """News items from JSON texts, one row for each symbol; items that are no JSON, or name no symbol, are left out."""
    item = lines.select(F.from_json(F.col(column), NEWS).alias("n")).select("n.*")
    return item.select("headline", F.try_to_timestamp("created_at").alias("created_at"), "source", F.explode("symbols").alias("symbol"), "url", "summary")


def write_panel(panel: DataFrame, path: str) -> None:
    """panel by year and month, assets in ranges, so that a large month is written by several tasks; only the months that it has are replaced."""
    parts = panel.withColumn("year", F.year("date")).withColumn("month", F.month("date"))
    parts.repartitionByRange("year", "month", "asset").write.partitionBy("year", "month").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_ranking(ranking: DataFrame, path: str) -> None:
    """A ranking as one CSV file with six digits; rankings are as short as their list of factors."""
    shown = [F.format_string("%.6f", c).alias(c) if t == "double" else F.col(c) for c, t in ranking.dtypes]
    ranking.select(*shown).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_log(alerts: DataFrame, path: str) -> None:
    """Alerts added to a log of Parquet files."""
    alerts.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def to_wide(panel: DataFrame, field: str, assets: list) -> DataFrame:
    """A row for each date, a column for each of the assets named; several values of a cell are averaged."""
    return panel.groupBy("date").pivot("asset", assets).agg(F.avg(field)).select("date", *[F.col(f"`{a}`").alias(f"a{a}") for a in assets])


def to_long(wide: DataFrame, field: str) -> DataFrame:
    """The rows of a wide table's cells that have a value."""
    return wide.unpivot(["date"], [c for c in wide.columns if c != "date"], "asset", field).where(F.col(field).isNotNull())


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table or query of a database, read in `parts` ranges of a numeric column by as many connections; rows outside low and high are in the first and last."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    return reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).options(**options).load()


#: Ticks as a stream has them.
TICKS = "event_id long, symbol long, ts timestamp, kind string, price double"


def read_ticks_stream(spark: SparkSession, source: str, schema: str = TICKS, kind: str = "parquet", files: int | None = None, **options: str) -> DataFrame:
    """Ticks of a folder that files are added to (or of another source: kind and its options), at most `files` new files a batch."""
    reader = spark.readStream.format(kind).options(**options)
    if kind in ("parquet", "json", "csv", "orc", "text"):
        reader = reader.schema(schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.load(source) if source else reader.load()
