"""Benchmark decontamination with suffix arrays.

The corpus is the indexed side: each task takes its documents in shards of
bounded size and builds a suffix array of the shard's words.  Every suffix of
every benchmark text is then binary-searched in each shard.  A document never
leaves its task, so that the operator needs no shuffle and a hot source or a
passage that a third of all documents share costs nothing extra.

Suffixes that cannot match are left out of the array: a suffix that matches k
words starts k words of the benchmark's vocabulary in a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import IntegralType

from .shared import tidy
from .textkit import ALNUM_WORDS, Words, slices

#: Bytes of benchmark text that are searched at a time; a larger benchmark takes several passes.
BLOCK_BYTES = 8 << 20


@dataclass
class Queries:
    """Suffixes of a block of benchmark items, as codes of the block's own vocabulary."""

    items: np.ndarray  # item id by item, in ascending order
    vocabulary: np.ndarray  # sorted word hashes; code = place + 1
    codes: np.ndarray  # all items' words, a 0 after each item
    windows: np.ndarray  # distinct windows as fixed-width byte strings
    lengths: np.ndarray  # words of each window
    tops: np.ndarray  # for windows of fewer than `width` words, the largest key that begins with them
    owner_rows: np.ndarray  # window w belongs to owners[owner_rows[w]:owner_rows[w + 1]]
    owners: np.ndarray  # places in items
    starts: np.ndarray  # one start in codes for each owner entry
    width: int


def _keys(codes: np.ndarray, at: np.ndarray, run: np.ndarray, width: int) -> np.ndarray:
    """`width` codes from each place in `at`, 0 beyond `run`, as byte strings that sort like the codes."""
    cols = np.arange(width)
    grid = codes[np.minimum(at[:, None] + cols, len(codes) - 1)]
    grid = np.where(cols < run[:, None], grid, 0).astype(">u4")
    return np.ascontiguousarray(grid).view(f"S{4 * width}").ravel()


def prepare(rows: list[tuple], width: int) -> Queries | None:
    """The block of rows (item id, text), sorted by id; None if no item has a word."""
    if not rows:
        return None
    words = Words(pa.array([r[1] for r in rows], pa.string()), ALNUM_WORDS, lower=True)
    counts = words.counts
    if not len(words):
        return None
    vocabulary, place = np.unique(words.hashes(), return_inverse=True)
    codes = np.zeros(len(place) + len(counts), np.int64)
    item = np.repeat(np.arange(len(counts)), counts)
    codes[np.arange(len(place)) + item] = place + 1
    first = words.rows[:-1] + np.arange(len(counts))
    n_windows = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    owner = np.repeat(np.arange(len(counts)), n_windows)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + first[owner]
    length = np.minimum(counts[owner], width)
    keys = _keys(codes, start, length, width)
    windows, which = np.unique(keys, return_inverse=True)
    order = np.argsort(which, kind="stable")
    lengths = np.zeros(len(windows), np.int64)
    lengths[which] = length
    low = windows[lengths < width]
    grid = np.frombuffer(low.tobytes(), np.uint8).reshape(len(low), 4 * width)
    tops = np.where(np.arange(4 * width) < 4 * lengths[lengths < width][:, None], grid, 255).astype(np.uint8)
    tops = np.ascontiguousarray(tops).view(windows.dtype).ravel()
    ids = np.array([r[0] for r in rows], np.int64 if isinstance(rows[0][0], int) else object)
    return Queries(ids, vocabulary, codes, windows, lengths, tops, np.searchsorted(which[order], np.arange(len(windows) + 1)), owner[order], start[order], width)


def _lookup(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place + 1 of each x, 0 where it is missing."""
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return np.where(sorted_values[at] == x, at + 1, 0)


def search_shard(text: pa.Array, q: Queries) -> dict:
    """All occurrences of the block's windows in one shard of documents.

    A dict of arrays: counts (words by document), codes, at and size (place and
    words of each occurrence), window, doc.
    """
    words = Words(text, ALNUM_WORDS, lower=True)
    counts = words.counts
    doc_of = np.repeat(np.arange(len(counts)), counts)
    codes = np.zeros(len(words) + len(counts) + 1, np.int64)  # a 0 ends each document
    place = np.arange(len(words)) + doc_of
    if len(words):
        codes[place] = _lookup(q.vocabulary, words.hashes())
    zeros = np.flatnonzero(codes == 0)
    keep = np.flatnonzero(codes)
    run = zeros[np.searchsorted(zeros, keep)] - keep
    keep, run = keep[run >= q.lengths.min()], run[run >= q.lengths.min()]
    empty = np.zeros(0, np.int64)
    out = {"counts": counts, "codes": codes, "at": empty, "size": empty, "window": empty, "doc": empty, "first": words.rows[:-1] + np.arange(len(counts))}
    if not len(keep):
        return out
    keys = _keys(codes, keep, np.minimum(run, q.width), q.width)
    order = np.argsort(keys, kind="stable")
    array, suffix = keys[order], keep[order]  # the shard's suffix array
    low = np.searchsorted(array, q.windows)
    high = np.searchsorted(array, q.windows, side="right")
    high[q.lengths < q.width] = np.searchsorted(array, q.tops)  # a short item is a prefix of what it matches
    found = high - low
    window = np.repeat(np.arange(len(found)), found)
    within = np.arange(len(window)) - np.repeat(np.cumsum(found) - found, found)
    at = suffix[low[window] + within]
    return out | {"at": at, "size": q.lengths[window], "window": window, "doc": np.searchsorted(out["first"], at, side="right") - 1}


def _expand(q: Queries, hits: dict) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence and owner entry, for each owner of each occurrence's window."""
    n = np.diff(q.owner_rows)[hits["window"]]
    which = np.repeat(np.arange(len(n)), n)
    entry = q.owner_rows[hits["window"]][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return which, entry


def maximal_matches(q: Queries, hits: dict) -> dict:
    """Occurrences that cannot be extended to the left, each extended to the right as far as words agree."""
    which, entry = _expand(q, hits)
    at, start, size = hits["at"][which], q.starts[entry], hits["size"][which].copy()
    a, b = hits["codes"], q.codes
    maximal = (start == 0) | (at == 0) | (a[at - 1] == 0) | (a[at - 1] != b[start - 1])
    which, entry, at, start, size = (x[maximal] for x in (which, entry, at, start, size))
    live = np.arange(len(at))
    while len(live):
        x, y = at[live] + size[live], start[live] + size[live]
        live = live[(a[x] != 0) & (a[x] == b[np.minimum(y, len(b) - 1)])]
        size[live] += 1
    return {"doc": hits["doc"][which], "item": q.owners[entry], "at": at, "start": start, "size": size}


def _item_type(benchmark: DataFrame, item_col: str) -> str:
    """Integers stay integers, so that ties go to the smaller number; all else is a string."""
    return "long" if isinstance(benchmark.schema[item_col].dataType, IntegralType) else "string"


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, width: int, block_bytes: int) -> Iterator[Queries | None]:
    """The benchmark in blocks of at most about block_bytes, by a hash of the item's id."""
    items = benchmark.select(F.col(f"`{item_col}`").cast(_item_type(benchmark, item_col)).alias("i"), F.col(f"`{text_col}`").alias("t")).where("i is not null and t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k)
        yield prepare([tuple(r) for r in part.orderBy("i", "t").collect()], width)


def match_documents(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of docs, what of the benchmark it holds verbatim.

    Words are runs of letters, digits and non-ASCII characters after lower-casing
    A-Z.  A window is `width` consecutive words of an item; an item of fewer
    words is one window.  Columns: the id, n_words, n_hit (words inside an
    occurrence), items (sorted ids of items with occurring windows), longest
    (words of the longest verbatim match, 0 without one), longest_item and
    longest_at (where it starts, in words).  Item ids that are integers stay so; those
    of any other type are compared and given back as strings.

    Null and empty texts have no words and no hits.  Items without id, text or
    words match nothing; an empty benchmark matches nothing.  Repeated rows are
    judged one by one, and columns besides id and text are not looked at.
    """
    spark, kind = docs.sparkSession, _item_type(benchmark, item_col)
    df = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.lit(None).cast("long").alias("n_words"), F.lit(b"").alias("spans"), F.array().cast(f"array<{kind}>").alias("items"),
        F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("longest"), F.lit(None).cast(kind).alias("longest_item"), F.lit(None).cast("long").alias("longest_at"),
    )
    for q in _blocks(benchmark, item_col, item_text_col, width, block_bytes):
        df = df.mapInArrow(tidy(_searcher(spark.sparkContext.broadcast(q))), df.schema)
    return df.select(F.col("id").alias(id_col), "n_words", "n_hit", "items", "longest", "longest_item", "longest_at")


def _searcher(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = block.value
        for batch in batches:
            for a, b in slices(batch["text"]):
                part = batch.slice(a, b - a)
                yield _merge(part, q)

    return run


def _merge(part: pa.RecordBatch, q: Queries | None) -> pa.RecordBatch:
    """The rows of a shard with one more block's matches."""
    cols = {name: part[name].to_pylist() for name in ("spans", "items", "n_hit", "longest", "longest_item", "longest_at")}
    if q is None:
        n_words = Words(part["text"], ALNUM_WORDS, lower=True).counts
    else:
        hits = search_shard(part["text"], q)
        n_words = hits["counts"]
        by_doc = np.argsort(hits["doc"], kind="stable")
        hit_docs, firsts = np.unique(hits["doc"][by_doc], return_index=True)
        for d, mine in zip(hit_docs, np.split(by_doc, firsts[1:]), strict=True) if len(hit_docs) else ():
            n = int(n_words[d])
            old = np.frombuffer(cols["spans"][d], np.int64).reshape(-1, 2)
            at = np.concatenate([hits["at"][mine] - hits["first"][d], old[:, 0]])
            size = np.concatenate([hits["size"][mine], old[:, 1]])
            depth = np.bincount(at, minlength=n + 1) - np.bincount(at + size, minlength=n + 1)
            inside = np.concatenate([[0], (np.cumsum(depth)[:n] > 0).astype(np.int8), [0]])
            edges = np.flatnonzero(np.diff(inside)).reshape(-1, 2)
            cols["spans"][d] = np.stack([edges[:, 0], edges[:, 1] - edges[:, 0]], axis=1).astype(np.int64).tobytes()
            cols["n_hit"][d] = int((edges[:, 1] - edges[:, 0]).sum())
        once = np.unique(hits["doc"] * len(q.windows) + hits["window"])  # owners are listed once for a document, not for each occurrence
        doc, window = np.divmod(once, max(len(q.windows), 1))
        which, entry = _expand(q, {"window": window})
        for d, i in set(zip(doc[which].tolist(), q.items[q.owners[entry]].tolist(), strict=True)):
            cols["items"][d].append(i)
        m = maximal_matches(q, hits)
        for k in np.lexsort((m["item"], m["at"], -m["size"])) if len(m["doc"]) else ():
            d, size, at, item = int(m["doc"][k]), int(m["size"][k]), int(m["at"][k]), q.items.item(m["item"][k])
            at -= int(hits["first"][d])
            if not cols["longest"][d] or (-size, at, item) < (-cols["longest"][d], cols["longest_at"][d], cols["longest_item"][d]):
                cols["longest"][d], cols["longest_item"][d], cols["longest_at"][d] = size, item, at
    out = {"id": part["id"], "text": part["text"], "n_words": pa.array(n_words, pa.int64())} | {k: pa.array(v, part.schema.field(k).type) for k, v in cols.items()}
    out["items"] = pa.array([sorted(set(x)) for x in cols["items"]], part.schema.field("items").type)
    return pa.RecordBatch.from_arrays([out[f.name] for f in part.schema], schema=part.schema)


def _clean(block, text_at: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = block.value
        for batch in batches:
            for a, b in slices(batch[text_at]):
                part = batch.slice(a, b - a)
                keep = np.ones(len(part), bool)
                keep[search_shard(part[text_at], q)["doc"]] = False
                yield part.filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows whose text holds a benchmark window; all columns, whatever their names, stay.

    Each row is judged by its own text, in the pass that searches it: rows without an id like others, repeated rows
    alike.  Null and empty texts stay, an empty benchmark removes nothing, an empty table stays empty.
    """
    spark = docs.sparkSession
    inside = {c: f"_{k}" for k, c in enumerate(docs.columns)}
    left = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inside.items()])
    for q in _blocks(benchmark, item_col, item_text_col, width, block_bytes):
        if q is not None:
            left = left.mapInArrow(tidy(_clean(spark.sparkContext.broadcast(q), inside[text_col])), left.schema)
    return left.select(*[F.col(n).alias(c) for c, n in inside.items()])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Query op1: one row per document, with a digest of its items, and where its longest match lies: of several the
    first in the document, then the one with the smallest item id; null without a match."""
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return match_documents(docs, benchmark).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest", "longest_item", "longest_at")
