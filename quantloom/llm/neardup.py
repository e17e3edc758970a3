"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A document is the set of its word shingles.  A sketch has T coordinates; in each
round every element throws itself into one hashed coordinate, later rounds visit
coordinate after coordinate, and a coordinate keeps the earliest and smallest
throw, so that all of them fill with few rounds and sets as small as one.
Bands of coordinates make buckets; links are confirmed on full sets.

Documents with equal sets (by a digest of the whole set) are one class, and only
a class's smallest document goes on.  In a bucket, documents are first compared with hubs, not with each
other; then only those not yet joined to the bucket's main component are
compared with the rest, in chunks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, hot_join, integer_id, stored, tidy
from .textkit import SPACE_WORDS, Words, mix, signed, slices, window_hashes

#: Coordinates, and how many of them make a band: at a similarity of 0.8 a pair shares no band with a chance of 5e-6.
COORDINATES, BAND = 240, 6
#: Documents on each side of a block in which the rest of a bucket is compared.
BLOCK = 256
#: Bytes of text that are looked at together.
SLICE_BYTES = 1 << 20
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted in each row, and the rows' offsets."""
    words = Words(text, SPACE_WORDS, lower=True)
    h, counts = words.hashes(), words.counts
    doc = np.repeat(np.arange(len(counts)), counts)
    shingles = window_hashes(h, width)
    inside = doc[: len(shingles)] == doc[width - 1 : width - 1 + len(shingles)]
    found, owner = [shingles[inside]], [doc[: len(shingles)][inside]]
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        found.append(window_hashes(h[words.rows[d] : words.rows[d + 1]], int(counts[d])))
        owner.append(np.array([d]))
    x, doc = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((x, doc))
    x, doc = x[order], doc[order]
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    x, doc = x[first], doc[first]
    return x, np.searchsorted(doc, np.arange(len(counts) + 1))


def sketches(x: np.ndarray, offsets: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """A row of t coordinates for each set; sets without elements keep empty coordinates."""
    n = len(offsets) - 1
    out = np.full((n, t), _NONE, np.uint64)
    sizes = np.diff(offsets)
    active = sizes > 0
    doc = np.repeat(np.arange(n), sizes)
    live_x, live_doc = x, doc
    for k in range(2 * t):
        if not len(live_x):
            break
        g = mix(live_x + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = (np.uint64(k) << np.uint64(54)) | (mix(g) >> np.uint64(10))
        if k < t:
            place = ((g >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
            np.minimum.at(out.reshape(-1), live_doc * t + place.astype(np.int64), value)
        else:
            heads = np.flatnonzero(np.diff(live_doc, prepend=-1))
            who = live_doc[heads]
            out[who, k - t] = np.minimum(out[who, k - t], np.minimum.reduceat(value, heads))
        if k < 8 or k % 16 == 0 or k >= t:
            active &= (out == _NONE).any(axis=1)
            stay = active[live_doc]
            live_x, live_doc = live_x[stay], live_doc[stay]
    return out


def bands(sketch: np.ndarray, band: int = BAND) -> np.ndarray:
    """A key for each band of each sketch."""
    n, t = sketch.shape
    parts = sketch.reshape(n, t // band, band)
    key = np.broadcast_to(np.arange(t // band, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019), (n, t // band)).copy()
    for j in range(band):
        key = mix(key + parts[:, :, j])
    return key


def _sketcher(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"], SLICE_BYTES):
                x, offsets = shingle_sets(batch["text"].slice(a, b - a), width)
                n = np.diff(offsets)
                keys = bands(sketches(x, offsets))
                per_doc = keys.shape[1]
                packed = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * per_doc), pa.array(signed(keys.ravel())))
                whole = pa.array([hashlib.blake2b(x[p:q].data, digest_size=20).digest() if q > p else b"" for p, q in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch["id"].slice(a, b - a), pa.array(n), whole, packed], ["id", "n", "whole", "bands"])

    return run


def _setter(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"], SLICE_BYTES):
                x, offsets = shingle_sets(batch["text"].slice(a, b - a), width)
                yield pa.RecordBatch.from_arrays([batch["id"].slice(a, b - a), pa.array([x[p:q].tobytes() for p, q in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], ["id", "shingles"])

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if not len(a) or not len(b):
        return 0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int((a[at] == b).sum())


def _verifier(parts: int, whole: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = _common(x, y)
                keep.append(whole * both >= parts * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _rest(parts: int, whole: int):
    """Compares the left documents of a block with its members; one link for each left document and component."""

    def run(block: pa.Table) -> pa.Table:
        left, member = (block.filter(pa.compute.equal(block["left"], side)) for side in (True, False))
        out: tuple[list, list] = ([], [])
        if left.num_rows and member.num_rows:
            key = block["key"][0].as_py()
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in member["shingles"]]
            size = np.array([len(s) for s in sets])
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            ids, comp, is_left = member["id"].to_numpy(), member["component"].to_numpy(), member["is_left"].to_numpy()
            keys = np.array(member["bands"].to_pylist(), np.int64)
            for i, c, s, k in zip(left["id"].to_pylist(), left["component"].to_pylist(), left["shingles"], left["bands"].to_pylist(), strict=True):
                s, k = np.frombuffer(s.as_buffer(), np.uint64), np.array(k, np.int64)
                first = k[(keys == k).argmax(axis=1)] == key  # else another bucket compares them
                want = first & (comp != c) & (~is_left | (ids > i)) & (whole * np.minimum(size, len(s)) >= parts * np.maximum(size, len(s)))
                if want.any():
                    use = want[owner]
                    y, who = flat[use], owner[use]
                    at = np.minimum(np.searchsorted(s, y), len(s) - 1)
                    both = np.bincount(who, weights=s[at] == y, minlength=len(sets)).astype(np.int64)
                    linked = np.flatnonzero(want & (whole * both >= parts * (size + len(s) - both)))
                    _, once = np.unique(comp[linked], return_index=True)
                    out[0].extend([i] * len(once))
                    out[1].extend(ids[linked[once]].tolist())
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def group(docs: DataFrame, *, width: int = 5, parts: int = 80, whole: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The id, n_shingles and component_id of each row of docs.

    Documents link when whole * |A and B| >= parts * |A or B| for their sets of
    `width`-word shingles (of the whole sequence, where there are fewer words);
    words are what white space separates, A-Z lower-cased.  component_id is the
    smallest id that links lead to.  Documents without words, null and empty texts
    link with nothing.  Rows that share an id count as one document, rows are given
    back each; rows without an id link with nothing and have no component.  An empty
    table gives an empty result.  Ids are integers (else TypeError).  Other columns
    are not looked at.  A text is held whole by one task, at some fifty times its bytes.
    """
    plain = docs.select(integer_id(docs, id_col).alias("id"), F.col(f"`{text_col}`").alias("text"))
    sketched = stored(plain.mapInArrow(tidy(_sketcher(width)), "id long, n long, whole binary, bands array<long>"))
    known = sketched.where("n > 0 and id is not null")
    classes = known.groupBy("whole").agg(F.min("id").alias("rep"), F.count("*").alias("rows"))
    ranked = stored(hot_join(known.select("id", "n", "whole"), classes, "whole", "rep", known.count()).select("id", "n", "rep"))
    reps = ranked.where("id = rep").select("id").distinct()
    buckets = known.join(reps, "id", "left_semi").select("id", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where("n > 1")
    buckets = stored(buckets.join(shared, "key").select("key", "id", "hub", "n"))
    need = buckets.select("id").distinct()
    sets = stored(plain.where("id is not null").join(need, "id", "left_semi").mapInArrow(tidy(_setter(width)), "id long, shingles binary"))

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
        return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(tidy(_verifier(parts, whole)), "a long, b long")

    # each document with the smallest hub of its buckets
    stars = buckets.where("id <> hub").groupBy("id").agg(F.min("hub").alias("hub")).select(F.col("hub").alias("a"), F.col("id").alias("b"))
    found = components(verified(stars))
    # what is outside a bucket's main component, with a member of that component that differs by bucket
    tagged = buckets.select("key", "id").join(found, buckets["id"] == found["node"], "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mains = tagged.groupBy("key", "component").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id", "key").alias("h"), "id")).alias("one"))
    mains = mains.groupBy("key").agg(F.max(F.struct("n", "component", "one")).alias("top"), F.sum("n").alias("members"), F.count("*").alias("parts")).where("parts > 1")
    mains = mains.select("key", F.col("top.component").alias("main"), F.col("top.one.id").alias("one"), "members", F.col("top.n").alias("joined"))
    second = tagged.join(mains, "key").where("component <> main").select(F.least("id", "one").alias("a"), F.greatest("id", "one").alias("b")).distinct()
    earlier, found = found, components(verified(second), found)
    discard(earlier)
    # the rest, exactly
    tagged = buckets.select("key", "id").join(found, buckets["id"] == found["node"], "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mains = tagged.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("members"), F.count("*").alias("parts")).where("parts > 1")
    mains = mains.select("key", F.col("top.component").alias("main"), F.ceil(F.col("members") / block).alias("wide"), F.ceil((F.col("members") - F.col("top.n")) / block).alias("high"))
    open_ = tagged.join(mains, "key").withColumn("is_left", F.col("component") != F.col("main"))
    keys = known.join(reps, "id", "left_semi").select("id", "bands")
    full = open_.join(sets, "id").join(keys, "id")
    spot = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n))
    cols = ["key", "row", "col", "id", "component", "is_left", "left", "bands", "shingles"]
    lefts = full.where("is_left").withColumn("left", F.lit(True)).withColumn("row", spot("high", 1)).withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1)))
    members = full.withColumn("left", F.lit(False)).withColumn("col", spot("wide", 2)).withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("high") - 1)))
    blocks = lefts.select(cols).unionByName(members.select(cols))
    rest = blocks.groupBy("key", "row", "col").applyInArrow(_rest(parts, whole), "a long, b long")
    earlier, found = found, components(rest, found)
    discard(earlier, buckets, sets)
    grouped = ranked.join(found, ranked["rep"] == found["node"], "left").groupBy("id").agg(F.max("n").alias("n"), F.min(F.coalesce("component", "rep")).alias("component"))
    result = sketched.select("id", "n").join(grouped.select(F.col("id").alias("gid"), "component"), F.col("id") == F.col("gid"), "left")
    return result.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """docs with one document of each component: the one with the smallest id, all its rows. Rows without an id stay,
    an empty table stays empty, all columns stay."""
    gone = group(docs, id_col=id_col, **options).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == gone["_gone"], "left_anti")


def report(docs: DataFrame) -> DataFrame:
    """Query op2: two-word shingles, similarity of 0.8; a row for each row of docs."""
    return group(docs, width=2).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
