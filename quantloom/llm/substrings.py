"""Repeated passages: prefix-partitioned suffix trees and their deep nodes.

A window is `window` consecutive words of a document.  Windows that two documents
share are the suffixes below one node of depth `window` in the corpus's suffix
tree.  The tree is never whole: suffixes are dealt by prefixes of variable
length, and each group's subtree is built by itself.

The prefix of a window is the half window that begins at its anchor: the place
in the window with the smallest half-window hash, which equal windows share.
Prefixes that begin in one document only are dropped.  Others are dealt in groups
that fit in memory, with the words around them: neighbouring windows of one
anchor travel as one segment, once for a chunk of documents that has it several
times.  A prefix with more places than a group can hold is made longer, to the
whole window; below it only the smallest document of each leaf is asked for, which
is a plain aggregate.  In a group the words are compared by 128 bits; nodes of
depth 1, 2, 4 ... come from ranks of pairs, and those of depth `window` from
them.  The windows below a node with several documents are repeats; in a
document, overlapping ones join to its maximal repeats.

Whole copies are set aside first; they would only repeat their original's nodes.
Documents travel once, packed in chunks, and what is found comes back to them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hot_join, integer_id, tidy
from .textkit import OTHER_BASE, SPACE_WORDS, Words, mix, powers, signed, slices, utf8, window_hashes

WINDOW = 50
#: Bytes of text in a chunk; a longer text has a chunk of its own.
CHUNK_BYTES = 2 << 20
#: Bytes of text for each group of prefixes, and places of a prefix that is not made longer.
GROUP_BYTES, GROUP_PLACES = 8 << 20, 20_000
_SALTS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: What is dealt to groups: a segment of `windows` windows, or (windows = 0) the digest of one below a longer prefix; lo and hi are the smallest and largest document of the chunk that has it.
_DEALT = "bucket int, chunk long, at int, windows int, lo long, hi long, body binary"
#: What comes back: from place `at` of a chunk, n windows whose smallest document is `first`.
_FOUND = "chunk long, at int, n int, first long"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, seq = TaskContext.get().partitionId() << 32, 0
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for a, b in slices(batch["text"], CHUNK_BYTES):
            data, offsets = utf8(batch["text"].slice(a, b - a))
            packed = squeeze(pickle.dumps((batch["id"].slice(a, b - a).to_pylist(), offsets, data.tobytes()), 5))
            yield pa.RecordBatch.from_arrays([pa.array([task | seq]), pa.array([packed], pa.binary())], ["chunk", "packed"])
            seq += 1


def _strings(data: bytes, offsets: np.ndarray) -> pa.LargeStringArray:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data))


class Chunk:
    """A chunk's documents and their words."""

    def __init__(self, packed: pa.Scalar):
        self.ids, self.offsets, self.data = pickle.loads(zstandard.ZstdDecompressor().decompress(packed.as_py()))
        self.words = Words(_strings(self.data, self.offsets), SPACE_WORDS, lower=False)
        self.counts = self.words.counts
        self.doc = np.repeat(np.arange(len(self.ids)), self.counts)
        self.known = np.array([i is not None for i in self.ids], bool)
        self.id = np.array([i or 0 for i in self.ids], np.int64)
        self.hashes = self.words.hashes()

    def starts(self, width: int, use: np.ndarray) -> np.ndarray:
        """The words where `width` words of one document start; use: whether a document counts."""
        n = len(self.doc)
        if n < width:
            return np.zeros(0, np.int64)
        return np.flatnonzero((self.doc[: n - width + 1] == self.doc[width - 1 :]) & use[self.doc[: n - width + 1]])

    def digests(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the `width` words from each word on."""
        return window_hashes(self.hashes, width), window_hashes(self.words.hashes(base=OTHER_BASE), width, salt=1)


def anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window, the place of its anchor (of several the first); and the hash of half a window from each word on."""
    half = window // 2
    prefix = window_hashes(hashes, half)
    span = window - half + 1
    if len(prefix) < span:
        return np.zeros(0, np.int64), prefix
    size, low, at = 1, prefix, np.arange(len(prefix))

    def earlier(step: int, n: int):
        right = low[step : step + n] < low[:n]
        return np.where(right, low[step : step + n], low[:n]), np.where(right, at[step : step + n], at[:n])

    while 2 * size <= span:
        low, at = earlier(size, len(low) - size)
        size *= 2
    return earlier(span - size, len(prefix) - span + 1)[1], prefix


def _copies(window: int):
    """A row for each document of a window or more, with hashes of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, packed in zip(batch["chunk"].to_pylist(), batch["packed"], strict=True):
                c = Chunk(packed)
                place = np.arange(len(c.doc)) - np.repeat(c.words.rows[:-1], c.counts)
                keep = np.flatnonzero((c.counts >= window) & c.known)
                sums = [np.diff(np.concatenate([[np.uint64(0)], np.cumsum(mix(c.hashes ^ np.uint64(s)) * powers(s | 1, int(place.max(initial=0)) + 1)[place], dtype=np.uint64)])[c.words.rows]) for s in _SALTS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), chunk)), pa.array(keep.astype(np.int32)), pa.array(c.id[keep]), pa.array(c.counts[keep]), *[pa.array(signed(x[keep])) for x in sums]], ["chunk", "row", "id", "n", "h1", "h2"])

    return run


def _smallest(which: np.ndarray, x: np.ndarray, n: int, op=np.minimum) -> np.ndarray:
    """The smallest x of each group."""
    out = np.full(n, np.iinfo(np.int64).max if op is np.minimum else np.iinfo(np.int64).min)
    op.at(out, which, x)
    return out


def _prefixes(window: int):
    """A chunk's prefixes: hash, places, smallest and largest document. Copies are left out."""

    def run(chunks: pa.Table, copies: pa.Table) -> pa.Table:
        out, chunk = [np.zeros(0, np.int64)] * 4, 0
        if chunks.num_rows:
            c, chunk = Chunk(chunks["packed"][0]), chunks["chunk"][0].as_py()
            use = c.known.copy()
            use[copies["row"].to_numpy()] = False
            at, prefix = anchors(c.hashes, window)
            places = np.unique(at[c.starts(window, use)])
            h, which = np.unique(prefix[places], return_inverse=True)
            ids = c.id[c.doc[places]]
            out = [signed(h), np.bincount(which, minlength=len(h)), _smallest(which, ids, len(h)), _smallest(which, ids, len(h), np.maximum)]
        return pa.table({"h": out[0], "chunk": np.full(len(out[0]), chunk, np.int64), "places": out[1], "lo": out[2], "hi": out[3]})

    return run


def _dealt(bucket, chunk: int, at, windows, lo, hi, body: list[bytes]) -> pa.Table:
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "chunk": pa.array(np.full(len(body), chunk), pa.int64()), "at": pa.array(at, pa.int32()), "windows": pa.array(windows, pa.int32()), "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64()), "body": pa.array(body, pa.binary())})


def _segments(window: int, buckets: int, limit: int):
    """A chunk's windows below prefixes that documents share."""

    def run(chunks: pa.Table, shared: pa.Table) -> pa.Table:
        none: list = []
        empty = _dealt(none, 0, none, none, none, none, none)
        h = shared["h"].drop_null().to_numpy()
        if not chunks.num_rows or not len(h):
            return empty
        c, chunk = Chunk(chunks["packed"][0]), chunks["chunk"][0].as_py()
        use = c.known.copy()
        use[shared["row"].drop_null().to_numpy()] = False
        order = np.argsort(h.view(np.uint64))
        h, long = h.view(np.uint64)[order], (shared["places"].drop_null().to_numpy() > limit)[order]
        at, prefix = anchors(c.hashes, window)
        start = c.starts(window, use)
        place = np.minimum(np.searchsorted(h, prefix[at[start]]), len(h) - 1)
        mine = h[place] == prefix[at[start]]
        start, place = start[mine], place[mine]
        out = [empty]
        deep = start[long[place]]
        if len(deep):  # below a longer prefix: each window once
            both = np.stack([x[deep] for x in c.digests(window)], axis=1)
            body, first, which = np.unique(both, axis=0, return_index=True, return_inverse=True)
            which, ids = which.ravel(), c.id[c.doc[deep]]
            out.append(_dealt((body[:, 0] % np.uint64(buckets)).astype(np.int32), chunk, deep[first], np.zeros(len(first), np.int32), _smallest(which, ids, len(first)), _smallest(which, ids, len(first), np.maximum), [x.tobytes() for x in body]))
        start = start[~long[place]]
        if len(start):  # runs of windows with one anchor
            head = np.flatnonzero((np.diff(start, prepend=-9) != 1) | (np.diff(at[start], prepend=-9) != 0) | (np.diff(c.doc[start], prepend=-9) != 0))
            n = np.diff(np.append(head, len(start)))
            a, b = c.words.starts[start[head]], c.words.ends[start[head] + n + window - 2]
            bodies = [c.data[p:q] for p, q in zip(a.tolist(), b.tolist(), strict=True)]
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(x, len(number)) for x in bodies])
            first = np.unique(which, return_index=True)[1]
            ids = c.id[c.doc[start[head]]]
            where = (prefix[at[start[head[first]]]] % np.uint64(buckets)).astype(np.int32)
            out.append(_dealt(where, chunk, start[head[first]], n[first], _smallest(which, ids, len(first)), _smallest(which, ids, len(first), np.maximum), list(number)))
        return pa.concat_tables(out)

    return run


def word_codes(words: Words) -> np.ndarray:
    """A number for each word, equal for words whose two hashes are equal."""
    one, two = words.hashes(), words.hashes(base=OTHER_BASE)
    _, first, code = np.unique(one, return_index=True, return_inverse=True)
    if (two[first][code] == two).all():
        return code
    return np.unique(np.stack([one, two], axis=1), axis=0, return_inverse=True)[1].ravel()


def nodes_at_depth(codes: np.ndarray, depth: int) -> np.ndarray:
    """The node of this depth above each suffix that is long enough: ranks of pairs, then of pairs of pairs."""
    size, rank, out, done = 1, codes, None, 0
    while True:
        if depth & size:
            out, done = (rank, size) if out is None else (_ranks(out, rank, done), done + size)
        if done == depth:
            return out
        rank, size = _ranks(rank, rank, size), 2 * size


def _ranks(left: np.ndarray, right: np.ndarray, offset: int) -> np.ndarray:
    """Numbers of the pairs (left[i], right[i + offset])."""
    n = min(len(left), len(right) - offset)
    if n <= 0:
        return np.zeros(0, np.int64)
    pair = left[:n].astype(np.int64) * (int(right.max()) + 1) + right[offset : offset + n]
    return np.unique(pair, return_inverse=True)[1]


def _runs(chunk: np.ndarray, at: np.ndarray, first: np.ndarray) -> pa.Table:
    """Neighbouring places with one first document as one row."""
    head = np.flatnonzero((np.diff(chunk, prepend=-1) != 0) | (np.diff(at, prepend=-9) != 1) | (np.diff(first, prepend=-1) != 0)) if len(at) else np.zeros(0, np.int64)
    if len(at):
        head = np.union1d(head, [0])
    return pa.table({"chunk": pa.array(chunk[head], pa.int64()), "at": pa.array(at[head], pa.int32()), "n": pa.array(np.diff(np.append(head, len(at))), pa.int32()), "first": pa.array(first[head], pa.int64())})


def _subtrees(window: int):
    """The group's windows whose node has a smaller document than some document of theirs."""

    def run(group: pa.Table) -> pa.Table:
        group = group.filter(pa.compute.greater(group["windows"], 0)).combine_chunks()
        none = np.zeros(0, np.int64)
        if not group.num_rows:
            return _runs(none, none, none)
        words = Words(group["body"].chunk(0).cast(pa.large_binary()).cast(pa.large_string()), SPACE_WORDS, lower=False)
        node = nodes_at_depth(word_codes(words), window)
        n = group["windows"].to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        mine = node[words.rows[:-1][owner] + within]
        first = _smallest(mine, group["lo"].to_numpy()[owner], len(words))[mine]
        repeat = first < group["hi"].to_numpy()[owner]
        owner, within, first = owner[repeat], within[repeat], first[repeat]
        return _runs(group["chunk"].to_numpy()[owner], group["at"].to_numpy()[owner] + within, first)

    return run


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        deep = batch.filter(pa.compute.equal(batch["windows"], 0))
        yield deep.select(["body", "chunk", "at", "lo", "hi"])


def _cut(window: int):
    def run(chunks: pa.Table, found: pa.Table) -> pa.Table:
        """Each document without the words of its repeated windows; a row -1 - k marks document k as a copy."""
        c = Chunk(chunks["packed"][0])
        total, at = len(c.doc), found["at"].to_numpy().astype(np.int64)
        removed = np.isin(c.doc, -1 - at[at < 0])
        n, first = (found[x].to_numpy()[at >= 0].astype(np.int64) for x in ("n", "first"))
        at = at[at >= 0]
        if len(at):
            samples = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            one, two = c.digests(window)
            order = np.lexsort((np.repeat(first, n), one[samples]))
            samples, first = samples[order], np.repeat(first, n)[order]
            start = c.starts(window, c.known)
            k = np.minimum(np.searchsorted(one[samples], one[start]), len(samples) - 1)  # of equal ones that with the smallest document
            gone = start[(one[samples[k]] == one[start]) & (two[samples[k]] == two[start]) & (c.id[c.doc[start]] > first[k])]
            depth = np.bincount(gone, minlength=total + 1) - np.bincount(gone + window, minlength=total + 1)
            removed |= np.cumsum(depth)[:total] > 0
        n_removed = np.bincount(c.doc, weights=removed, minlength=len(c.ids)).astype(np.int64)
        kept = []
        for k, (a, b) in enumerate(zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist(), strict=True)):
            words = c.data[a:b].split()  # at the same six characters
            if n_removed[k]:
                words = [w for w, r in zip(words, removed[c.words.rows[k] : c.words.rows[k + 1]].tolist(), strict=True) if not r]
            kept.append(b" ".join(words).decode())
        return pa.table({"id": pa.array(c.ids, pa.int64()), "n_words": pa.array(c.counts), "n_removed": pa.array(n_removed), "kept": pa.array(kept, pa.string())})

    return run


def cut_repeats(docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", places: int = GROUP_PLACES) -> DataFrame:
    """The id, n_words, n_removed and kept text of each row of docs.

    A word goes if a window of `window` words that covers it also starts in a
    document with a smaller id.  Words are what white space separates; kept words
    are joined by one space.  Null and empty texts have no words.  Rows without an
    id are neither cut nor a reason to cut; rows that share an id do not cut each
    other, and are given back each.  An empty table gives an empty result.  Ids are
    integers (else TypeError).  Other columns are not looked at.  A text is held
    whole by one task, at some fifty times its bytes.  docs should come from files
    or another source that gives a task the same rows again.
    """
    plain = docs.select(integer_id(docs, id_col).alias("id"), F.col(f"`{text_col}`").alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, rows = size // GROUP_BYTES + 1, size // 8
    chunks = plain.mapInArrow(tidy(_pack), "chunk long, packed binary").repartition("chunk")
    by_chunk = chunks.groupBy("chunk")
    whole = chunks.mapInArrow(tidy(_copies(window)), "chunk long, row int, id long, n long, h1 long, h2 long").select("chunk", "row", "id", F.struct("n", "h1", "h2").alias("whole"))
    original = whole.groupBy("whole").agg(F.min("id").alias("original"), F.max("id").alias("last"), F.count("*").alias("rows")).where("original < last").drop("last")
    copies = hot_join(whole, original, "whole", "original", rows).where("id > original").select("chunk", "row")
    prefixes = by_chunk.cogroup(copies.groupBy("chunk")).applyInArrow(_prefixes(window), "h long, chunk long, places long, lo long, hi long")
    known = prefixes.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("places").alias("places"), F.count("*").alias("rows")).where("lo < hi").select("h", "places", "rows")
    shared = hot_join(prefixes.select("h", "chunk"), known, "h", "places", rows).where("places is not null").select("chunk", "h", "places", F.lit(None).cast("int").alias("row"))
    told = shared.unionByName(copies.select("chunk", F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("places"), "row"))
    # one exchange feeds groups and leaves: both read all its columns
    dealt = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(_segments(window, buckets, places), _DEALT).repartition("bucket")
    nodes = dealt.groupBy("bucket").applyInArrow(_subtrees(window), _FOUND)
    leaves = dealt.mapInArrow(tidy(_leaves), "body binary, chunk long, at int, lo long, hi long")
    first = leaves.groupBy("body").agg(F.min("lo").alias("first"), F.max("hi").alias("last"), F.count("*").alias("rows")).where("first < last").drop("last")
    below = hot_join(leaves.select("body", "chunk", "at", "hi"), first, "body", "first", rows).where("first < hi").select("chunk", "at", F.lit(1).alias("n"), "first")
    found = nodes.unionByName(below).unionByName(copies.select("chunk", (-1 - F.col("row")).alias("at"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("first")))
    result = by_chunk.cogroup(found.groupBy("chunk")).applyInArrow(_cut(window), "id long, n_words long, n_removed long, kept string")
    return result.withColumnRenamed("id", id_col)


def report(docs: DataFrame) -> DataFrame:
    """Query op6; a row for each row of docs."""
    return cut_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
