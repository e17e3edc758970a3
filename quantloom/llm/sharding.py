"""Byte-balanced shards by sampled splitters.

Rows are ordered by (a hash of the text, the id), so that equal texts lie side
by side.  A size-weighted sample of keys gives splitters at its quantiles; the
rows between two splitters form a range, ranges that turn out too full are
split again, and running sums inside the ranges turn the order into positions.
Only slim rows (id, size, checksum) are shuffled, by range; the number of ranges
follows the rows, and no range is large: a group of equal texts that fills more
than its share is split by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, integer_id, stored

Splitter = tuple[int, int]
#: Rows that a range should have, and ranges at most: splitters are part of the plan.
RANGE_ROWS, MAX_RANGES = 1_000_000, 4096
#: Sampled keys for each range.
SAMPLE_PER_RANGE = 32


def weighted_sample(rows: DataFrame, n: int, total: int, seed: int) -> list[Splitter]:
    """About n keys, each drawn with a chance that follows its size, in order.

    A row draws an exponential time with its size as rate, from a hash of its key,
    and is drawn if that comes before n / total; total: the bytes of rows.  No
    task needs more than its own rows for that.
    """
    u = (F.pmod(F.xxhash64("key", "id", F.lit(seed)), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))
    drawn = rows.select("key", "id").where(-F.ln(u) / F.col("size") < n / max(total, 1))
    return sorted((r["key"], r["id"]) for r in drawn.collect())


def range_number(splitters: list[Splitter], first: int = 0) -> Column:
    """How many splitters are at or below the row's (key, id), as a balanced tree of comparisons."""
    if not splitters:
        return F.lit(first)
    mid = len(splitters) // 2
    key, row = splitters[mid]
    below = (F.col("key") < F.lit(key)) | ((F.col("key") == F.lit(key)) & (F.col("id") < F.lit(row)))
    return F.when(below, range_number(splitters[:mid], first)).otherwise(range_number(splitters[mid + 1 :], first + mid + 1))


def _quantiles(sample: list[Splitter], parts: int) -> list[Splitter]:
    return sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []


def choose_splitters(rows: DataFrame, n_ranges: int, overfull: float, rounds: int = 6) -> tuple[list[Splitter], list]:
    """Splitters, and (range, rows, bytes) of the ranges that have rows."""
    smallest, sample = -(1 << 63), SAMPLE_PER_RANGE * n_ranges
    total = rows.agg(F.sum("size")).first()[0] or 0
    # at first by key alone, so that equal texts share a range
    splitters = sorted({(key, smallest) for key, _ in _quantiles(weighted_sample(rows, sample, total, 0), n_ranges)})
    for k in range(1, rounds + 1):
        ranged = rows.withColumn("range", range_number(splitters))
        filled = ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).orderBy("range").collect()
        target = total / n_ranges
        full = [r["range"] for r in filled if r["bytes"] > overfull * target and r["n"] > 1]
        if not full or k == rounds:
            break
        inside = sum(r["bytes"] for r in filled if r["range"] in set(full))
        drawn = weighted_sample(ranged.where(F.col("range").isin(full)), sample, inside, k)
        more, edges = set(splitters), [(smallest, smallest), *splitters, (1 << 63, 0)]
        for r in filled:
            if r["range"] in full:
                mine = [x for x in drawn if edges[r["range"]] <= x < edges[r["range"] + 1]]
                more |= set(_quantiles(mine, int(r["bytes"] / target * 2) + 1))
        if len(more) == len(splitters):
            break
        splitters = sorted(more)
    return splitters, filled


def shard_by_bytes(docs: DataFrame, *, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", overfull: float = 2.0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Shard and slot for each row of docs, with nearly equal bytes in the shards.

    size is the text's UTF-8 bytes (null: none) plus 1.  A row goes where the middle of its bytes lies in the order of
    (text hash, id), so that shards differ by two rows' sizes at most, and of the groups of equal texts only those that
    lie across one of the n_shards - 1 borders are divided.  Slots count from 0 without gaps in that order.
    An empty table gives an empty result.  Rows that share an id, or have none, are placed one by one; among rows equal
    in all of (text, id) the order is arbitrary.  Ids are integers (else TypeError).  Other columns are not looked at.
    """
    text = F.col(f"`{text_col}`")
    slim = stored(docs.select(integer_id(docs, id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("key")))
    rows = slim.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n_ranges = min(MAX_RANGES, max(16 * n_shards, rows.count() // range_rows))
    splitters, filled = choose_splitters(rows, n_ranges, overfull)
    total = sum(r["bytes"] for r in filled)
    starts, n_before, b_before = [], 0, 0
    for r in filled:
        starts.append((r["range"], n_before, b_before))
        n_before, b_before = n_before + r["n"], b_before + r["bytes"]
    offsets = rows.sparkSession.createDataFrame(starts, "range int, n_before long, b_before long")
    ordered = Window.partitionBy("range").orderBy("key", "id", "size")
    placed = (
        rows.withColumn("range", range_number(splitters))
        .join(F.broadcast(offsets), "range")  # a row for each range: bounded by MAX_RANGES and what overfull ranges add
        .withColumn("row", F.row_number().over(ordered) - 1 + F.col("n_before"))
        .withColumn("middle", F.sum("size").over(ordered) - F.col("size") / 2 + F.col("b_before"))
    )
    shard = F.least(F.lit(n_shards - 1), F.floor(F.col("middle") * n_shards / F.lit(max(total, 1)))).cast("int")
    placed = stored(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), "row"))
    discard(slim)
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"))


def report(docs: DataFrame) -> DataFrame:
    """Query op3: all documents in shards 0 to 7 of nearly equal bytes."""
    return shard_by_bytes(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
