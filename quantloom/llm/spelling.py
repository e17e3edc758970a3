"""Spelling variants: words that differ by one letter, found in FM indices over the vocabulary.

Two words at one edit share the first half of the word that is looked up or,
counted from the end, its last half.  So the vocabulary is dealt by halves: each
word goes, as one to be found, where words of its length and of neighbouring
lengths look with their halves, and looks itself where its own halves lead.  A
shard of words is one text with delimiters, and its suffix ranks, with the
letters before them, are the index: a letter takes an interval of ranks to
another, and an interval that ends at delimiters on both sides is a word.

The search scheme has two parts, one for each direction: the last half is matched
exactly from the delimiter on and the search goes on to the left with one error;
for the first half the same is done in the index of the reversed words.  What
comes out of a shard are a word's number of near words and the most frequent of
them: no pairs leave it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, hot_join, stored, tidy

#: Words of the contract, their least length and number of occurrences, and how much more frequent a form is.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, FACTOR = 5, 3, 2
#: One in so many runs of a document loses a letter.
DAMAGE = 97
#: Words of a shard's index, on average, and words that are looked up together.
SHARD_WORDS, TOGETHER = 50_000, 8_000
#: Words that a task counts before it passes their counts on.
COUNTED = 300_000
#: In larger intervals all letters are tried; in smaller ones those that occur.
WIDE = 128
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, added up over many documents."""
    total: Counter[str] = Counter()

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        total.clear()
        return out

    for batch in batches:
        for doc, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
            found = Counter(RUN.findall((text.as_py() or "").encode().translate(_LOWER).decode()))
            start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for run, n in found.items():
                h = zlib.crc32(run.encode(), start)
                if h % DAMAGE == 0:
                    k = h % len(run)
                    run = run[:k] + run[k + 1 :]
                if len(run) >= LEAST_LENGTH:
                    total[run] += n
            if len(total) >= COUNTED:
                yield rows()
    if total:
        yield rows()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n: the words of all texts, with one run in 97 of a document's runs short of a letter, that occur often enough.

    Null texts have no words; a null id reads as an empty one.
    """
    plain = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return plain.mapInArrow(tidy(_counted), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Index:
    """The suffix ranks of distinct, sorted words of Latin-1 letters, and the steps between intervals of them."""

    def __init__(self, words: list[str]):
        self.words = words
        self.text = np.frombuffer(b"\0" + b"\0".join(w.encode("latin-1") for w in words) + b"\0", np.uint8)
        n, ends = len(self.text), np.flatnonzero(self.text == 0)
        self.start = ends[:-1] + 1
        self.length = np.diff(ends) - 1
        rank = self.text.astype(np.int64) + len(ends)
        rank[ends] = np.arange(1, len(ends) + 1) % len(ends)  # a delimiter ranks by the word after it, the last one first
        reach = 1
        while True:  # ranks by one letter, two, four, ...
            after = np.zeros(n, np.int64)
            after[:-reach] = rank[reach:]
            key = rank * np.int64(n + len(ends) + 256) + after
            order = np.argsort(key)
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            if rank[order[-1]] == n - 1:
                break
            reach *= 2
        self.before = self.text[order - 1]  # the letter before each suffix
        by_letter = np.argsort(self.before, kind="stable")
        self.wide = n + 1
        self.places = self.before[by_letter].astype(np.int64) * self.wide + by_letter
        self.letters = np.unique(self.text)[1:].astype(np.int64)

    def step(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes that begin with a letter before those of each interval."""
        return np.searchsorted(self.places, letter * self.wide + low), np.searchsorted(self.places, letter * self.wide + high)

    def letters_before(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, letter) for each letter that may stand before an interval's suffixes, delimiters left out."""
        size = high - low
        wide = np.flatnonzero(size > WIDE)
        narrow = np.flatnonzero(size <= WIDE)
        who = np.repeat(narrow, size[narrow])
        rows = low[who] + np.arange(len(who)) - np.repeat(np.cumsum(size[narrow]) - size[narrow], size[narrow])
        seen = np.unique(who * 256 + self.before[rows])
        who, letter = np.divmod(seen, 256)
        inner = letter > 0
        return np.concatenate([who[inner], np.repeat(wide, len(self.letters))]), np.concatenate([letter[inner], np.tile(self.letters, len(wide))])

    def near(self, queries: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in queries, word) for words at one edit from each query, a word of the index, that end in the query's last `exact` letters."""
        last, length = self.start[queries] + self.length[queries] - 1, self.length[queries]
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(self.words) + 1)
        todo, t = np.arange(len(queries)), 0
        while len(todo := todo[exact[todo] > t]):
            low[todo], high[todo] = self.step(self.text[last[todo] - t].astype(np.int64), low[todo], high[todo])
            t += 1
        # states: the query, how many of its letters are read, the interval; none has an error, or one
        clean = (np.arange(len(queries)), exact.copy(), low, high)
        wrong = tuple(np.zeros(0, np.int64) for _ in range(4))
        found = []
        while len(clean[0]) or len(wrong[0]):
            q, t, low, high = clean
            own = np.where(t < length[q], self.text[last[q] - np.minimum(t, length[q] - 1)], 0).astype(np.int64)
            who, letter = self.letters_before(low, high)
            lo, hi = self.step(letter, low[who], high[who])
            there = lo < hi
            who, letter, lo, hi = who[there], letter[there], lo[there], hi[there]
            more = t < length[q]
            other = (letter != own[who]) & more[who]
            new = [
                (q[who], t[who], lo, hi),  # a letter more
                (q[who][other], t[who][other] + 1, lo[other], hi[other]),  # another letter
                (q[more], t[more] + 1, low[more], high[more]),  # a letter less
            ]
            same = (letter == own[who]) & more[who]
            clean = (q[who][same], t[who][same] + 1, lo[same], hi[same])
            # one letter further for states with an error
            q, t, low, high = wrong
            ended = t == length[q]
            at, _ = self.step(np.zeros(int(ended.sum()), np.int64), low[ended], high[ended])
            _, to = self.step(np.zeros(int(ended.sum()), np.int64), low[ended], high[ended])
            word = to > at
            found.append((q[ended][word], at[word] - 1))
            q, t, low, high = (x[~ended] for x in wrong)
            lo, hi = self.step(self.text[last[q] - t].astype(np.int64), low, high)
            there = lo < hi
            new.append((q[there], t[there] + 1, lo[there], hi[there]))
            wrong = tuple(np.concatenate(x) for x in zip(*new, strict=True))
        q, word = (np.concatenate(x) for x in zip(*found, strict=True))
        pair = np.unique(q * np.int64(len(self.words)) + word)
        return pair // len(self.words), pair % len(self.words)


def near_in_shard(words: list[str], n: np.ndarray, asks: np.ndarray, reverse: bool) -> pa.Table:
    """For words that ask: how many words of the shard are near and share the first half, reverse, or only the last half; and the most frequent of them."""
    spelled = [w[::-1] for w in words] if reverse else words
    order = sorted(range(len(words)), key=spelled.__getitem__)
    words, n, asks = [words[i] for i in order], n[order], asks[order]
    index = Index([spelled[i] for i in order])
    alphabetic = np.empty(len(words), np.int64)
    alphabetic[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    ask = np.flatnonzero(asks)
    half = index.length[ask] // 2
    exact = half if reverse else index.length[ask] - half
    count, best = np.zeros(len(ask), np.int64), np.full(len(ask), -1)
    for a in range(0, len(ask), TOGETHER):
        q, word = index.near(ask[a : a + TOGETHER], exact[a : a + TOGETHER])
        q += a
        if not reverse:  # those with the same first half are found there
            new = np.fromiter((not words[w].startswith(words[i][: len(words[i]) // 2]) for i, w in zip(ask[q].tolist(), word.tolist(), strict=True)), bool, len(q))
            q, word = q[new], word[new]
        count += np.bincount(q, minlength=len(ask))
        by = np.lexsort((alphabetic[word], -n[word], q))
        who, first = np.unique(q[by], return_index=True)
        best[who] = word[by][first]
    none = best < 0
    return pa.table({
        "word": pa.array([words[i] for i in ask], pa.string()), "n": pa.array(n[ask], pa.int64()), "n_near": pa.array(count, pa.int64()),
        "form_n": pa.array(n[best], pa.int64(), mask=none), "form": pa.array([None if i < 0 else words[i] for i in best.tolist()], pa.string()),
    })


def _shard(part: pa.Table) -> pa.Table:
    seen: dict[str, tuple[int, bool]] = {}
    for word, n, asks in zip(part["word"].to_pylist(), part["n"].to_pylist(), part["asks"].to_pylist(), strict=True):
        seen[word] = (n, asks or seen.get(word, (n, False))[1])  # two of a word's halves may lead here
    if not seen:
        return near_in_shard(["-"], np.ones(1, np.int64), np.zeros(1, bool), True)
    n, asks = np.array([x[0] for x in seen.values()]), np.array([x[1] for x in seen.values()])
    return near_in_shard(list(seen), n, asks, part["side"][0].as_py() == 0)


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, n, n_near, best (of its near words the one with the largest n; ties: the first in code-point order) and best_n for each row of words (distinct words of Latin-1 letters and n)."""
    m, word = F.length("word"), F.col("word")
    half = lambda side, size, asks: F.struct(F.lit(side).alias("side"), F.when(F.lit(side) == 0, F.substring(word, F.lit(1), size)).otherwise(F.substring(word, m - size + 1, size)).alias("half"), (size == asks).alias("asks"))
    low = lambda x: F.floor(x / 2).cast("int")
    # the halves that words of this length and its neighbours look with
    first = [half(0, size, low(m)) for size in (low(m - 1), low(m - 1) + 1)]
    last = [half(1, size, m - low(m)) for size in (low(m), low(m) + 1)]
    shards = max(1, -(-2 * words.count() // shard_words))
    dealt = words.select("word", "n", F.explode(F.array(*first, *last)).alias("h")).select("word", "n", "h.side", "h.asks", F.pmod(F.xxhash64("h.side", "h.half"), F.lit(shards)).cast("int").alias("shard"))
    found = dealt.groupBy("side", "shard").applyInArrow(_shard, "word string, n long, n_near long, form_n long, form string")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))))
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n", "n_near", F.col("b.form").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root for each row of forms (word, form): the last form that forms lead to. A word's form is more frequent than it, so that no forms lead back."""
    up = stored(forms.select("word", F.col("form").alias("root")))
    total = up.count()
    while True:
        via = up.select(F.col("word").alias("via"), F.col("root").alias("further"))
        carried = up.groupBy("root").agg(F.count("*").alias("rows"))
        jump = carried.join(via, F.col("root") == F.col("via")).select("root", "further", "rows")
        if jump.isEmpty():
            return up
        up, earlier = stored(hot_join(up, jump, "root", "further", total).select("word", F.coalesce("further", "root").alias("root"))), up
        discard(earlier)


def variants(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """words (distinct words of Latin-1 letters and n) with form, root, n_near and form_n.

    Near words differ by one inserted, deleted or replaced code point.  The form of a word is its most frequent near
    word, if that is at least twice as frequent; root follows forms to the last.  Words without a form are their own
    root.  An empty table gives an empty result.
    """
    near = near_words(words, shard_words)
    is_form = F.col("best_n") >= FACTOR * F.col("n")
    found = stored(near.select("word", F.when(is_form, F.col("best")).alias("form"), "n", "n_near", F.when(is_form, F.col("best_n")).alias("form_n")))
    last = roots(found.where("form is not null")).select(F.col("word").alias("from"), "root")
    return found.join(last, F.col("word") == F.col("from"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    """Query op11: every frequent word of the corpus with its near words' number, its form and root.

    Null, empty and wordless texts give no words, rows count each, an empty table gives an empty result; other columns
    are not looked at.
    """
    return variants(stored(vocabulary(docs)))


def oracle() -> str:
    """DuckDB SQL of op11: near words by what is left without a letter."""
    from .sql import CRC32

    return rf"""
with recursive {CRC32},
runs as (select doc_id, run, count(*) as n from (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) as run from documents) group by doc_id, run),
hexed as (select run, n, hex(encode(concat(coalesce(cast(doc_id as varchar), ''), ':', run))) as x from runs),
bytes as (select run, n, list_transform(range(1, length(x) // 2 + 1), lambda i: cast(16 * (instr('0123456789ABCDEF', substr(x, 2 * i - 1, 1)) - 1) + instr('0123456789ABCDEF', substr(x, 2 * i, 1)) - 1 as bigint)) as b from hexed),
hashed as (select run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, v: xor(c >> 8, entries[cast(xor(c, v) & 255 as bigint) + 1])), 4294967295) as h from bytes, crc_table),
cut as (select case when h % {DAMAGE} = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from hashed),
words as (select word, sum(n)::bigint as n from cut where length(word) >= {LEAST_LENGTH} group by word having sum(n) >= {LEAST_COUNT}),
less as (select word, n, length(word) as m, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
pairs as (
    select a.word, b.word as other from less a join less b on a.i = b.i and a.rest = b.rest and a.m = b.m and a.word <> b.word
    union select a.word, b.word from less a join words b on a.rest = b.word
    union select b.word, a.word from less a join words b on a.rest = b.word
),
ranked as (select p.word, p.other, o.n as other_n, w.n, row_number() over (partition by p.word order by o.n desc, p.other) as place, count(*) over (partition by p.word) as n_near from pairs p join words o on o.word = p.other join words w on w.word = p.word),
forms as (select word, other as form, other_n as form_n from ranked where place = 1 and other_n >= {FACTOR} * n),
path as (select word, form as goal from forms union all select p.word, f.form from path p join forms f on f.word = p.goal),
tips as (select word, goal as root from path where goal not in (select word from forms))
select w.word, f.form, coalesce(e.root, w.word) as root, w.n, coalesce(r.n_near, 0)::bigint as n_near, f.form_n::bigint as form_n
from words w left join forms f on f.word = w.word left join tips e on e.word = w.word left join (select word, n_near from ranked where place = 1) r on r.word = w.word
"""
