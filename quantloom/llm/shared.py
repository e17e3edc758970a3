"""Small helpers that the text operators have in common."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StructField, StructType

#: The word class of contracts that lower-case A-Z only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a row group of stored tables: a writer holds one in memory.
ROW_GROUP = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; on one machine a temporary one where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Lower the session's rows of an Arrow batch: ten thousand whole texts at a time fill an executor's memory.

    For jobs that own their session; operators don't change settings and work with batches of any size.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """Return unused memory to the system; where the C library can't trim, what Arrow holds is returned."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, for mapInArrow, that gives memory back when a task ends: Spark keeps workers for later tasks, and what idle ones hold adds up."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the shared folder and read them again.

    Unlike checkpoint() the copy is compressed, columns can be pruned, and it can be discarded.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote, once nothing that is still to be computed reads them."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir, to be read in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: str = "text"):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def integer_id(docs: DataFrame, id_col: str) -> Column:
    """The id as a long; TypeError, before any job runs, if it is not a column of integers."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"ids are integers, but {id_col} is {kind.simpleString()}")
    return F.col(f"`{id_col}`").cast("long")


def with_columns(df: DataFrame, run: Callable[[Callable[[str], str]], Callable], new: StructType, keep: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """df through mapInArrow with columns added, whatever the names in df.

    run gets a function from a column's name to its name inside, and gives what
    mapInArrow takes: it yields df's columns by their inside names and the new
    ones.  A new column takes the place of one of its name.
    """
    inside = {c: f"_{k}" for k, c in enumerate(df.columns)}
    plain = df.select(*[F.col(f"`{c}`").alias(n) for c, n in inside.items()])
    fields = [*plain.schema.fields, *[StructField(f"+{f.name}", f.dataType) for f in new.fields]]
    out = plain.mapInArrow(tidy(run(inside.__getitem__)), StructType(fields))
    names = {f.name for f in new.fields}
    return out.select(*[F.col(n).alias(c) for c, n in inside.items() if c not in names], *[F.col(f"`+{f.name}`").alias(f.name) for f in new.fields])


def sampled_ids(ids: DataFrame, n: int) -> DataFrame:
    """At most n distinct values of ids' one column, nulls left out: those with small hashes, about n of them if there are more.

    Rows are dropped by hash before anything is sorted, so that no task sees more than about n rows.
    """
    (name,) = ids.columns
    h = F.pmod(F.xxhash64(name), F.lit(1 << 40))
    share = n / max(ids.count(), n)
    return ids.where(F.col(name).isNotNull() & (h < int(share * (1 << 40)))).distinct().orderBy(h, name).limit(n)


def hot_join(rows: DataFrame, summary: DataFrame, key: str, value: str, total: int, spread: int = 1 << 10) -> DataFrame:
    """rows with the value that summary (key, value, rows) has for their key, null without one; keys with many rows don't meet in a task.

    summary has one row for each key and, in `rows`, how many rows have the key at most; total is the number of rows.
    Keys with more than a ten-thousandth of the rows are at most ten thousand, and are broadcast; their rows are dealt
    at random in the join that serves all other keys.
    """
    limit = max(1_000, total // 10_000)
    hot = summary.where(F.col("rows") > limit).select(F.col(key).alias("_hot"), F.col(value).alias("_near"))
    cold = summary.where(F.col("rows") <= limit).select(F.col(key).alias("_cold"), F.pmod(F.xxhash64(key), F.lit(1)).cast("int").alias("_place"), F.col(value).alias("_far"))  # always 0, but part of the join's key
    near = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    near = near.withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(spread)).cast("int")))
    both = near.join(cold, (F.col(key) == F.col("_cold")) & (F.col("_salt") == F.col("_place")), "left")
    return both.select(*rows.columns, F.coalesce("_near", "_far").alias(value))
