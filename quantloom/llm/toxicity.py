"""Toxicity by weak supervision.

Words and word beginnings that go with toxic labels form lexicons; each kind of
entry, by how surely it goes with them, is one voter, and writing habits are
others.  A generative model of the votes, fitted by expectation maximisation to
the counts of vote patterns over the whole corpus, estimates each voter's
accuracy and, by a tree of dependent voters in each class, how they correlate.
Its posterior labels, of labelled and of unlabelled documents, train a linear
classifier on the lexicon entries, which scores all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .shared import sampled_ids, tidy
from .textkit import ALNUM_WORDS, LOWER, Words, mix, signed, slices, utf8

#: Bytes of a word's beginning that count as features of their own, besides the whole word (0).
PREFIXES = (0, 4, 5, 6)
#: Bytes of text that are looked at together; a word has several features.
SLICE_BYTES = 1 << 19
#: Labelled rows, at most, that the lexicon is mined from; the classifier sees these and at most as many unlabelled ones.
MAX_LABELLED = 20_000
#: Share of an entry's labelled documents that must be toxic, with one clean document added; and of a sure entry's.
MIN_PRECISION, SURE = 0.8, 0.95
#: Voters: each kind of entry, sure and less sure; then '!!', mostly upper case, letters drawn out.
LEXICON_VOTERS, HABITS = 2 * len(PREFIXES), 3
VOTERS = LEXICON_VOTERS + HABITS


@dataclass
class Model:
    entries: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes
    voters: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # voter by entry
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pattern_weights: np.ndarray = field(default_factory=lambda: np.zeros(HABITS))
    bias: float = -4.0
    posteriors: np.ndarray = field(default_factory=lambda: np.full(1 << VOTERS, 0.02))
    accuracies: np.ndarray = field(default_factory=lambda: np.full(VOTERS, 0.5))
    correlations: np.ndarray = field(default_factory=lambda: np.eye(VOTERS))


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct (document, feature): document, hash, kind."""
    words = Words(text, ALNUM_WORDS, lower=True)
    doc = np.repeat(np.arange(len(text)), words.counts)
    found = []
    for kind, k in enumerate(PREFIXES):
        use = np.flatnonzero(words.ends - words.starts > k)  # a whole word is no prefix
        h = words.hashes(np.minimum(words.starts + k, words.ends) if k else None)
        h = mix(h[use] + np.uint64(k))
        _, once = np.unique(mix(h + doc[use].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        found.append((doc[use[once]], h[once], np.full(len(once), kind)))
    doc, h, kind = (np.concatenate(x) for x in zip(*found, strict=True))
    return doc, h, kind


def patterns(text: pa.Array) -> np.ndarray:
    """Habits of writing as 0 or 1: any '!!', mostly upper case, a letter four times in a row."""
    bangs = pa.compute.match_substring(text.cast(pa.large_string()).fill_null(""), "!!").to_numpy(zero_copy_only=False)
    data, offsets = utf8(text)
    count = lambda flags, ends: (sums := np.concatenate([[0], np.cumsum(flags)]))[np.minimum(ends, len(flags))] - sums[np.minimum(offsets[:-1], len(flags))]
    letter = (LOWER[data] >= 97) & (LOWER[data] <= 122)
    small = data >= 97
    upper, lower = count(letter & ~small, offsets[1:]), count(letter & small, offsets[1:])
    same = letter[3:] & (data[3:] == data[2:-1]) & (data[2:-1] == data[1:-2]) & (data[1:-2] == data[:-3]) if len(data) > 3 else np.zeros(0, bool)
    drawn = count(same, np.maximum(offsets[1:] - 3, offsets[:-1])) > 0
    return np.stack([bangs.astype(np.int64), (upper > lower).astype(np.int64), drawn.astype(np.int64)], axis=1)


def _hits(h: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Which features are lexicon entries, and their places there."""
    if not len(model.entries) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(model.entries, h), len(model.entries) - 1)
    hit = np.flatnonzero(model.entries[at] == h)
    return hit, at[hit]


def _votes(n: int, doc: np.ndarray, entry: np.ndarray, shout: np.ndarray, model: Model) -> np.ndarray:
    """A bit for each voter that calls the document toxic."""
    grid = np.zeros((n, VOTERS), np.int64)
    grid[doc, model.voters[entry]] = 1
    grid[:, LEXICON_VOTERS:] = shout
    return grid @ (1 << np.arange(VOTERS))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features with their documents and toxic documents, summed by slice."""
    for batch in batches:
        for a, b in slices(batch["text"], SLICE_BYTES):
            part = batch.slice(a, b - a)
            toxic = part["toxic"].to_numpy(zero_copy_only=False).astype(np.int64)
            doc, h, kind = features(part["text"])
            if len(h):
                u, first, inv = np.unique(h, return_index=True, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(u)), pa.array(kind[first]), pa.array(np.bincount(inv)), pa.array(np.bincount(inv, weights=toxic[doc]).astype(np.int64))], ["h", "kind", "n", "n_toxic"])


def mine_lexicon(labelled: DataFrame) -> Model:
    """Features that go with toxic labels, by a likelihood-ratio test that allows for how many were tried.

    labelled has text and toxic; its rows are bounded, and so are the entries.
    """
    total = labelled.agg(F.count("*"), F.sum("toxic")).first()
    n, pos = total[0], total[1] or 0
    if not pos or pos == n:
        return Model()
    counts = labelled.select("text", "toxic").mapInArrow(tidy(_counter), "h long, kind long, n long, n_toxic long").groupBy("h", "kind").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("a"))
    base, a, m = pos / n, F.col("a").cast("double"), F.col("n").cast("double")
    part = lambda x, e: F.when(x > 0, x * F.ln(x / e)).otherwise(0.0)
    g = 2 * (part(a, m * base) + part(m - a, m * (1 - base)))
    tried = counts.agg(F.count("*")).first()[0] or 1
    best = counts.where((a / (m + 1) > max(MIN_PRECISION, (1 + base) / 2)) & (g > 2 * float(np.log(tried)))).select("h", "kind", (a / (m + 1) > SURE).cast("int").alias("sure"))
    rows = np.array([tuple(r) for r in best.collect()], np.int64).reshape(-1, 3)
    h = rows[:, 0].copy().view(np.uint64)
    order = np.argsort(h)
    return Model(entries=h[order], voters=(rows[:, 1] * 2 + rows[:, 2])[order], weights=np.zeros(len(h)))


def _tree(weights: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each vote pattern under the tree of voters that shares most information, and their correlations.

    weights: how often each pattern is seen, pseudo-counts included.
    """
    total = weights.sum()
    one = (weights @ bits + 0.5) / (total + 1)
    both = ((bits * weights[:, None]).T @ bits + 0.25) / (total + 1)
    cells = np.stack([both, one[:, None] - both, one[None, :] - both, 1 - one[:, None] - one[None, :] + both])
    cells = np.clip(cells, 1e-9, 1)
    alone = np.stack([np.outer(one, one), np.outer(one, 1 - one), np.outer(1 - one, one), np.outer(1 - one, 1 - one)])
    info = (cells * np.log(cells / alone)).sum(axis=0)
    corr = (both - np.outer(one, one)) / np.sqrt(np.outer(one * (1 - one), one * (1 - one)))
    np.fill_diagonal(corr, 1)
    log = np.where(bits[:, 0] == 1, np.log(one[0]), np.log(1 - one[0]))
    inside = [0]
    while len(inside) < len(one):  # the voter that says most about one that is already there
        rest = [k for k in range(len(one)) if k not in inside]
        near = info[np.ix_(inside, rest)]
        i, j = np.unravel_index(near.argmax(), near.shape)
        parent, child = inside[i], rest[j]
        yes = np.clip(both[parent, child] / one[parent], 1e-6, 1 - 1e-6)
        no = np.clip((one[child] - both[parent, child]) / (1 - one[parent]), 1e-6, 1 - 1e-6)
        p = np.where(bits[:, parent] == 1, yes, no)
        log += np.log(np.where(bits[:, child] == 1, p, 1 - p))
        inside.append(child)
    return log, corr


def fit_label_model(counts: np.ndarray, seen: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each vote pattern, accuracies, correlations of voters among clean documents.

    counts: documents by pattern; seen: rows [toxic, clean] of labelled ones by pattern, which keep their labels in
    each round and so tie the classes to their meaning.  In each class the voters depend on each other along a tree.
    """
    bits = (np.arange(1 << VOTERS)[:, None] >> np.arange(VOTERS)) & 1
    rest = np.maximum(counts - seen.sum(axis=0), 0)
    prior = (seen[0].sum() + 1) / (seen.sum() + 2)
    post = (seen[0] + prior) / (seen.sum(axis=0) + 1)
    for _ in range(rounds):
        toxic, clean = seen[0] + rest * post, seen[1] + rest * (1 - post)
        (log_toxic, _), (log_clean, corr) = _tree(toxic, bits), _tree(clean, bits)
        prior = float(np.clip(toxic.sum() / max(toxic.sum() + clean.sum(), 1), 1e-3, 0.5))
        post = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + log_toxic - log_clean, -30, 30)))
    rate = [(w @ bits + 0.5) / (w.sum() + 1) for w in (toxic, clean)]
    return post, prior * rate[0] + (1 - prior) * (1 - rate[1]), corr


def _voter(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"], SLICE_BYTES):
                text = batch["text"].slice(a, b - a)
                doc, h, _ = features(text)
                hit, entry = _hits(h, model.value)
                votes = _votes(len(text), doc[hit], entry, patterns(text), model.value)
                u, n = np.unique(votes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], ["votes", "n"])

    return run


def fit_classifier(rows: list, model: Model, steps: int = 300, decay: float = 1e-4) -> None:
    """Logistic regression on posterior labels; rows are (entries, habits, posterior) of the sample."""
    k = len(model.entries)
    doc = np.repeat(np.arange(len(rows)), [len(r[0]) + HABITS for r in rows])
    col = np.concatenate([np.concatenate([r[0], np.arange(k, k + HABITS)]) for r in rows]).astype(np.int64)
    val = np.concatenate([np.concatenate([np.ones(len(r[0])), r[1]]) for r in rows])
    y = np.array([r[2] for r in rows])
    w, bias, m, v = np.zeros(k + HABITS), -2.0, np.zeros(k + HABITS + 1), np.zeros(k + HABITS + 1)
    for t in range(1, steps + 1):  # Adam on the whole sample
        z = np.bincount(doc, weights=val * w[col], minlength=len(rows)) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        g = np.append(np.bincount(col, weights=val * err[doc], minlength=k + HABITS) + decay * w / len(rows) ** 0.5, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    model.weights, model.pattern_weights, model.bias = w[:k], w[k:], float(bias)


def _sampler(model):
    """Entries, habits, votes and label of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"], SLICE_BYTES):
                part = batch.slice(a, b - a)
                doc, h, _ = features(part["text"])
                hit, entry = _hits(h, model.value)
                shout = patterns(part["text"])
                votes = _votes(len(part), doc[hit], entry, shout, model.value)
                by_doc = np.split(entry[np.argsort(doc[hit], kind="stable")], np.cumsum(np.bincount(doc[hit], minlength=len(part)))[:-1])
                yield pa.RecordBatch.from_arrays([pa.array([sorted(x.tolist()) for x in by_doc], pa.list_(pa.int64())), pa.array(shout.tolist(), pa.list_(pa.int64())), pa.array(votes), part["toxic"]], ["entries", "shout", "votes", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from the labelled rows outside the held-out third, and the votes on all of docs.

    Of more than max_labelled such rows, those with the smallest hashes of their id are taken; the classifier also
    learns from the posterior labels of as many documents without a label to learn from, chosen alike.  Equal texts
    count once among the labelled, and are toxic if one of them is.  Rows without an id, null and empty texts teach
    nothing of words.  Without labels of both kinds nothing is learnt and all score low.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taken = known.join(F.broadcast(sampled_ids(known.select("doc_id"), max_labelled)), "doc_id")
    labelled = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    model = mine_lexicon(labelled)
    if not len(model.entries):
        return model
    shared = spark.sparkContext.broadcast(model)
    others = sampled_ids(docs.select("doc_id"), max_labelled).join(F.broadcast(taken.select("doc_id")), "doc_id", "left_anti")
    unlabelled = docs.select("doc_id", "text").join(F.broadcast(others), "doc_id").select("text", F.lit(None).cast("int").alias("toxic"))
    sample = labelled.select("text", "toxic").unionByName(unlabelled).mapInArrow(tidy(_sampler(shared)), "entries array<long>, shout array<long>, votes long, toxic int").collect()
    sample = sorted(sample, key=lambda r: (r["votes"], r["entries"], r["shout"], r["toxic"] is None, r["toxic"]))
    votes = docs.select("text").mapInArrow(tidy(_voter(shared)), "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()  # 2**VOTERS rows at most
    counts, seen = np.zeros(1 << VOTERS), np.zeros((2, 1 << VOTERS))
    counts[[r["votes"] for r in votes]] = [r["n"] for r in votes]
    for r in sample:
        if r["toxic"] is not None:
            seen[1 - r["toxic"], r["votes"]] += 1
    model.posteriors, model.accuracies, model.correlations = fit_label_model(counts, seen)
    fit_classifier([(np.array(r["entries"], np.int64), np.array(r["shout"], float), model.posteriors[r["votes"]]) for r in sample], model)
    return model


def held_out(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def _scored(docs: DataFrame, model: Model, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """docs under names of our own with a column score, and these names."""
    place = {c: f"_{k}" for k, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in place.items()])
    text_at = place[text_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b in slices(batch[text_at], SLICE_BYTES):
                part = batch.slice(a, b - a)
                doc, h, _ = features(part[text_at])
                hit, entry = _hits(h, m)
                z = np.bincount(doc[hit], weights=m.weights[entry], minlength=len(part)) + patterns(part[text_at]) @ m.pattern_weights + m.bias
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*part.schema.names, "score"])

    return plain.mapInArrow(tidy(run), StructType([*plain.schema.fields]).add("score", DoubleType())), place


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs with a column score, in place of one of that name: 0 to 1, higher for toxic.

    Null and empty texts score as texts without words.
    """
    scored, place = _scored(docs, model, text_col)
    return scored.select(*[F.col(name).alias(c) for c, name in place.items() if c != "score"], "score")


def reject(docs: DataFrame, model: Model, threshold: float, *, text_col: str = "text") -> DataFrame:
    """docs that score below the threshold; all columns, whatever their names, stay as they are.

    Null and empty texts score as texts without words; repeated rows go or stay alike; an empty table stays empty.
    """
    scored, place = _scored(docs, model, text_col)
    return scored.where(F.col("score") < threshold).select(*[F.col(name).alias(c) for c, name in place.items()])


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Query op8: score and prediction of each document; a row for each row of docs."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
