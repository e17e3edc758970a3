"""Personal data: patterns, and a skip-chain conditional random field around them.

Patterns give the base spans.  The field labels tokens that hold digits or an
at sign: neighbours form a chain, and repeated or similar tokens of a document,
however far apart, share skip edges, so that loopy message passing gives them
one label.  Similar are tokens that are equal without punctuation and case, that
end in the same seven digits (a number with and without its country's code), or
that begin with the same eight of ten or more letters and digits.  Its weights are fitted piecewise on a bounded sample of documents
whose tokens the patterns have labelled: a token that no pattern has found, but that
is like one that was found, teaches nothing, and what is found is evidence when the
field labels a text.  Tokens it labels that no pattern has found become spans of
kind `pii`.  All work is per document: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .shared import sampled_ids, tidy, with_columns
from .textkit import LOWER, SPACE_WORDS, Words, mix, slices

#: The base kinds, in the order of their listing.
KINDS = ("email", "ip", "card", "phone")
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What a text must hold for each kind.
NEEDS = ("@", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"[0-9](?:[ -]?[0-9]){15}", r"\+[0-9]")

EXTRA = "pii"
#: Documents, at most, whose tokens the field's weights are fitted on.
SAMPLE_DOCS = 4_000
#: Bytes of text that are looked at together.
SLICE_BYTES = 1 << 20
MAX_SPIN = 4.0
#: Log odds that a base span adds to the tokens it covers.
EVIDENCE = 10.0
#: Log odds by which a message may still change when rounds end.
TOLERANCE = 1e-3


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def find_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: each domain part with the run of name characters before it."""
    found, free = [], 0
    for m in EMAIL_DOMAIN.finditer(text):
        start = m.start()
        while start > free and EMAIL_LOCAL.match(text, start - 1, start):
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            free = m.end()
    return found


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str, needs: tuple[bool, ...] = (True,) * 4) -> list[tuple[str, int, int]]:
    """The base spans of a text in the order of kinds, then starts."""
    out = [("email", a, b) for a, b in find_emails(text)] if needs[0] else []
    if needs[1]:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split("."))]
    if needs[2]:
        out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if needs[3]:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


@dataclass
class Crf:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    bias: float = -6.0
    chain: float = 0.0  # log odds that neighbours agree
    skip: float = 0.0  # log odds that repeated or similar tokens agree


@dataclass
class Tokens:
    """Candidate tokens of a slice of texts."""

    doc: np.ndarray
    start: np.ndarray  # code points
    end: np.ndarray
    features: np.ndarray
    chain: np.ndarray  # pairs of neighbours
    skip: np.ndarray  # pairs of repeated or similar tokens
    repeats: int  # the first of them are repeats


_CLASS = np.zeros(256, np.int64)  # columns of the counts below
for _k, _chars in enumerate((b"0123456789", b"@", b".", b"-", b"+", b"()", b":/", bytes(range(97, 123)))):
    _CLASS[list(_chars)] = _k + 1
N_FEATURES = 21
_SURE = 0.999999


def _order_hash(byte: np.ndarray, owner: np.ndarray, rank: np.ndarray, n: int, salt: int) -> np.ndarray:
    """For each owner, a hash of its bytes at their ranks."""
    h = np.zeros(n, np.uint64)
    np.add.at(h, owner, mix(byte.astype(np.uint64) + (rank.astype(np.uint64) << np.uint64(8)) + np.uint64(salt << 56)))
    return h


def _keys(byte: np.ndarray, owner: np.ndarray, solid: np.ndarray, digit: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What tokens are alike by, as (tokens, hashes): all letters and digits, the last seven digits, the first eight letters and digits."""
    o, b = owner[solid], byte[solid]
    size = np.bincount(o, minlength=n)
    rank = np.arange(len(o)) - np.repeat(np.cumsum(size) - size, size)
    yield np.flatnonzero(size > 0), _order_hash(b, o, rank, n, 1)[size > 0]
    first = rank < 8
    yield np.flatnonzero(size >= 10), _order_hash(b[first], o[first], rank[first], n, 2)[size >= 10]
    o, b = owner[digit], byte[digit]
    size = np.bincount(o, minlength=n)
    left = np.repeat(np.cumsum(size), size) - 1 - np.arange(len(o))
    last = left < 7
    yield np.flatnonzero(size >= 7), _order_hash(b[last], o[last], left[last], n, 3)[size >= 7]


def _alike(doc: np.ndarray, keys: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Pairs of neighbouring tokens among those of a document with the same hash."""
    who, h = keys
    order = np.lexsort((who, h, doc[who]))
    who, h = who[order], h[order]
    same = np.flatnonzero((h[1:] == h[:-1]) & (doc[who][1:] == doc[who][:-1])) if len(h) > 1 else np.zeros(0, np.int64)
    return np.stack([who[same], who[same + 1]], axis=1)


def tokens(text: pa.Array) -> Tokens:
    """Tokens that hold a digit or an at sign, with the features of their shapes and the field's edges."""
    words = Words(text, SPACE_WORDS, lower=False)
    kind = _CLASS[words.data]
    solid = (kind == 1) | (kind == 2)
    marks = np.concatenate([[0], np.cumsum(solid)])
    pick = np.flatnonzero(marks[words.ends] > marks[words.starts])
    starts, ends = words.starts[pick], words.ends[pick]
    doc = np.searchsorted(words.rows, pick, side="right") - 1
    length = ends - starts
    place = np.repeat(starts, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    owner = np.repeat(np.arange(len(pick)), length)
    counts = np.bincount(owner * 9 + kind[place], minlength=9 * len(pick)).reshape(-1, 9) if len(pick) else np.zeros((0, 9), np.int64)
    digits = counts[:, 1]
    bins = np.stack([digits == 0, (digits >= 1) & (digits <= 3), (digits >= 4) & (digits <= 7), (digits >= 8) & (digits <= 13), (digits >= 14) & (digits <= 19), digits >= 20], axis=1)
    shares = np.stack([counts[:, 2] == 1, counts[:, 3] == 3, counts[:, 3] > 3, counts[:, 4] > 0, counts[:, 5] > 0, counts[:, 6] > 0, counts[:, 7] > 0, counts[:, 8] > 0, counts[:, 8] > digits, counts[:, 0] > 0, (counts[:, 2] == 1) & (counts[:, 3] >= 1)], axis=1)
    near = np.diff(pick, prepend=-9) == 1
    near &= np.diff(doc, prepend=-9) == 0
    after = np.append(near, False)[1:]
    long_run = (digits >= 8) & (counts[:, 8] == 0)
    feats = np.concatenate([bins, shares, near[:, None], after[:, None], long_run[:, None], ((length > 30))[:, None]], axis=1).astype(float)
    chain = np.stack([np.flatnonzero(near) - 1, np.flatnonzero(near)], axis=1)
    byte = LOWER[words.data[place]]
    solid = (kind[place] == 1) | ((byte >= 97) & (byte <= 122)) | (byte >= 128)
    alike = [_alike(doc, h) for h in _keys(byte, owner, solid, kind[place] == 1, len(pick))]
    skip = np.concatenate(alike)
    points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    first = points[words.offsets[:-1]][doc] if len(doc) else np.zeros(0, np.int64)
    return Tokens(doc, points[starts] - first, points[ends] - first, feats, chain, skip, len(alike[0]))


def _groups(skip: np.ndarray, n: int) -> np.ndarray:
    """The smallest token that skip edges lead to, for each token."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[skip[:, 0]], root[skip[:, 1]])
        new = root.copy()
        for side in (0, 1):
            np.minimum.at(new, root[skip[:, side]], low)
            np.minimum.at(new, skip[:, side], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def propagate(unary: np.ndarray, chain: np.ndarray, skip: np.ndarray, crf: Crf, doc: np.ndarray | None = None, limit: int = 1_000) -> np.ndarray:
    """Log odds of each token by damped, synchronous loopy belief propagation on the two kinds of edges.

    Tokens that skip edges join are linked through one node of their group, at a
    strength that makes two such links one skip edge, so that each repeat is two
    links from any other.  A document (doc, of each token; without it all are one)
    is done when none of its own messages changes by TOLERANCE, whatever stands
    beside it.  Edges only ever attract (see fit()), so that a message never falls
    when another rises: documents that have not settled after `limit` rounds start
    again with all messages at their least, from where they can only rise, and so
    must come to rest.
    """
    if not len(chain) + len(skip):
        return unary
    n, root = len(unary), _groups(skip, len(unary))
    many = np.unique(skip)
    _, hub = np.unique(root[many], return_inverse=True)
    stars = np.stack([many, n + hub], axis=1)
    edges = np.concatenate([chain, stars]).reshape(-1, 2).astype(np.int64)
    unary = np.concatenate([unary, np.zeros(hub.max() + 1 if len(hub) else 0)])
    strength = np.concatenate([np.full(len(chain), np.tanh(crf.chain / 2)), np.full(len(stars), np.sqrt(np.tanh(crf.skip / 2)))])
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    strength = np.concatenate([strength, strength])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    home = np.zeros(len(edges), np.int64) if doc is None else doc[edges[:, 0]]  # an edge's first end is a token
    home = np.concatenate([home, home])
    message = np.zeros(len(source))
    live, rounds = np.arange(len(source)), 0
    while len(live):
        belief = unary + np.bincount(target[live], weights=message[live], minlength=len(unary))
        cavity = belief[source[live]] - message[back[live]]
        step = np.arctanh(np.clip(strength[live] * np.tanh(np.clip(cavity, -20, 20) / 2), -_SURE, _SURE)) - 0.5 * message[live]
        message[live] += step
        most = np.zeros(home.max() + 1)
        np.maximum.at(most, home[live], np.abs(step))
        live = live[most[home[live]] >= TOLERANCE]
        rounds += 1
        if rounds == limit:
            message[live] = -2 * np.arctanh(np.minimum(strength[live], _SURE))
    return (unary + np.bincount(target, weights=message, minlength=len(unary)))[:n]


def _needs(text: pa.Array) -> np.ndarray:
    t = text.cast(pa.large_string()).fill_null("")
    return np.stack([pc.match_substring_regex(t, n).to_numpy(zero_copy_only=False) if k else pc.match_substring(t, n).to_numpy(zero_copy_only=False) for k, n in enumerate(NEEDS)], axis=1)


def _base(text: pa.Array) -> list[list[tuple[str, int, int]]]:
    return [base_spans(text[i].as_py(), tuple(n)) if any(n) else [] for i, n in enumerate(_needs(text).tolist())]


def _covered(t: Tokens, spans: list[list[tuple[str, int, int]]]) -> np.ndarray:
    """Tokens that overlap a base span."""
    out = np.zeros(len(t.doc), bool)
    rows = np.searchsorted(t.doc, np.arange(len(spans) + 1))
    for d, found in enumerate(spans):
        for _, a, b in found:
            lo, hi = rows[d], rows[d + 1]
            i, j = lo + np.searchsorted(t.end[lo:hi], a, side="right"), lo + np.searchsorted(t.start[lo:hi], b)
            out[i:j] = True
    return out


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch["text"], SLICE_BYTES):
            text = batch["text"].slice(a, b - a)
            t = tokens(text)
            y = _covered(t, _base(text))
            agree = [[len(e), int((y[e[:, 0]] == y[e[:, 1]]).sum())] for e in (t.chain, t.skip[: t.repeats])]
            unsure = np.zeros(len(y), bool)  # no pattern has found it, but one has found what it is like
            for a, b in ((0, 1), (1, 0)):
                unsure[t.skip[y[t.skip[:, a]], b]] = True
            known = y | ~unsure
            if known.any():
                bits = (t.features[known].astype(np.int64) @ (1 << np.arange(N_FEATURES))) * 2 + y[known]
                u, n = np.unique(bits, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], ["shape", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([-1, -2, -3, -4]), pa.array([agree[0][0], agree[0][1], agree[1][0], agree[1][1]])], ["shape", "n"])


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Crf:
    """Weights from at most sample_docs documents: those with the smallest hashes of their id.

    Rows without an id, null and empty texts teach nothing; rows that share an id count each.  Without a token to
    learn from, and for an empty table, the weights are those of a field that labels nothing.
    """
    ids = sampled_ids(docs.select(F.col(f"`{id_col}`").alias("i")), sample_docs)
    rows = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(ids), "i").select("text")
    # one row for each shape of tokens: a few hundred, and the counts of edges
    shapes = {r["shape"]: r["n"] for r in sorted(rows.mapInArrow(tidy(_labelled), "shape long, n long").groupBy("shape").agg(F.sum("n").alias("n")).collect())}
    edges = [shapes.pop(k, 0) for k in (-1, -2, -3, -4)]
    if not shapes:
        return Crf()
    keys, n = np.array(list(shapes), np.int64), np.array(list(shapes.values()), float)
    y, x = (keys & 1).astype(float), ((keys[:, None] >> (1 + np.arange(N_FEATURES))) & 1).astype(float)
    w, bias = np.zeros(N_FEATURES), 0.0
    m, v = np.zeros(N_FEATURES + 1), np.zeros(N_FEATURES + 1)
    for t in range(1, 401):
        err = (1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30))) - y) * n / n.sum()
        g = np.append(x.T @ err + 1e-4 * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    spins = [float(np.clip(np.log((yes + 1) / (all_ - yes + 1)), 0, MAX_SPIN)) for all_, yes in ((edges[0], edges[1]), (edges[2], edges[3]))]
    return Crf(w, float(bias), *spins)


SPAN = pa.struct({"kind": pa.string(), "start": pa.int64(), "end": pa.int64()})
SPANS = StructType([StructField("spans", ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])))])


def spans_in(text: pa.Array, crf: Crf) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of each text: base spans, then what the field adds."""
    found = _base(text)
    t = tokens(text)
    sure = _covered(t, found)
    odds = propagate(t.features @ crf.weights + crf.bias + EVIDENCE * sure, t.chain, t.skip, crf, t.doc)
    for i in np.flatnonzero((odds > 0) & ~sure):
        found[t.doc[i]].append((EXTRA, int(t.start[i]), int(t.end[i])))
    return found


def find(docs: DataFrame, crf: Crf, *, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns `keep` and `spans`: (kind, start, end) in code points, kinds as listed, then starts.

    Null and empty texts have no spans; repeated rows are searched each; an empty table gives an empty result;
    columns not in keep are dropped, and those in keep may have any names (`spans` is replaced).
    """
    plain = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])])
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def searched(inside):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = inside(text_col)
            for batch in batches:
                for a, b in slices(batch[at], SLICE_BYTES):
                    part = batch.slice(a, b - a)
                    spans = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans_in(part[at], shared.value)]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, pa.list_(SPAN))], [*part.schema.names, "+spans"])

        return run

    found = with_columns(plain, searched, SPANS)
    return found.select(*[F.col(f"`{c}`") for c in keep if c != "spans"], "spans")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in angle brackets; overlapping spans become the first of them."""
    at, pieces = 0, []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if end > at:
            if start >= at:
                pieces += [text[at:start], f"<{kind.upper()}>"]
            at = end
    return "".join([*pieces, text[at:]])


def mask(docs: DataFrame, crf: Crf, *, text_col: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets; overlapping spans become one.

    Null and empty texts stay; repeated rows are masked each; an empty table stays empty; other columns, whatever
    their names, stay as they are.
    """
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def replaced(inside):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = inside(text_col)
            for batch in batches:
                for a, b in slices(batch[at], SLICE_BYTES):
                    part = batch.slice(a, b - a)
                    found = spans_in(part[at], shared.value)
                    texts = part[at].to_pylist()
                    for i, spans in enumerate(found):
                        if spans:
                            texts[i] = masked(texts[i], spans)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, f"+{text_col}"])

        return run

    return with_columns(docs, replaced, StructType([StructField(text_col, StringType())])).select(*[F.col(f"`{c}`") for c in names])


def report(docs: DataFrame) -> DataFrame:
    """Query op5: counts and digests of each document's spans; an empty table gives an empty result."""
    found = find(docs, fit(docs), keep=("doc_id",))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != EXTRA)
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
