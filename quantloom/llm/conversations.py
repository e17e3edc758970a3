"""Repair of conversations: the cheapest edits that make the roles alternate.

A conversation's rows are judged first (blank, repeated, cut off), by columns
that need no text, and its edits are found on those: a shortest path through the
automaton of legal roles whose weights are integers.  High digits of a weight are
the cost, low digits of fixed width the letters of the edits by position, with
zeros after the last, so that the smaller of two integers is the cheaper path
and, of equally cheap ones, the one whose letters come first.  Long
conversations are solved in blocks of rows from the last to the first, in which
a path's later letters stand as one digit, their rank.

The texts then pass once, in order, through the task that has the edits: they
are hashed as they come and none is held.  A conversation's texts meet in one
task, as one digest over them needs, but its memory does not grow with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import tidy

#: What an edit costs; a row that is cut off costs CUT more unless it is deleted.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: Letters by their digits, in the order of ASCII; 0 stands after the last.
LETTERS = " DIKR"
#: Rows of a block.
BLOCK_ROWS = 64
#: Faults of a row as the search sees them.
FINE, SHORT, GONE = 0, 1, 2
#: States of the automaton: nothing yet, after a system row, a user row, an assistant row; conversations end in ENDS.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: Where a row that keeps its role leads, and where a row with a new role, or a new row, leads.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
GIVEN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}


def step(state: int, letter: str, initial: str = "") -> int:
    """The state after an edit."""
    return state if letter == "D" else KEPT[initial][state] if letter == "K" else GIVEN[state]


@lru_cache(1 << 16)
def _block(rows: tuple[tuple[str, int], ...], costs: tuple[int, ...], ranks: tuple[int, ...], last: bool) -> list[tuple[int, str, int]]:
    """The cost, the letters and an integer that orders the letters and what follows, from each state before the rows.

    costs and ranks are those of what follows, by the state after the rows; last: nothing does, but rows may still be added.
    """
    width = 3 * len(rows) + 2 * last  # a row takes one letter, and two at most are added before it
    low = 3 * (width + 1)
    never = 1 << (low + 60)

    def before(weight: int, cost: int, letter: str) -> int:
        high, letters, rank = weight >> low, (weight & ((1 << low) - 1)) >> 3, weight & 7
        return (high + cost) << low | (LETTERS.index(letter) << 3 * (width - 1) | letters >> 3) << 3 | rank

    def added(weights: list[int]) -> list[int]:
        once = [min(w, before(weights[GIVEN[q]], INSERT, "I")) for q, w in enumerate(weights)]
        return [min(w, before(once[GIVEN[q]], INSERT, "I")) for q, w in enumerate(weights)]

    at = [c << low | r if c >= 0 else never for c, r in zip(costs, ranks, strict=True)]
    if last:
        at = added(at)
    for initial, fault in reversed(rows):
        taken = [before(w, DELETE, "D") for w in at]
        if fault != GONE:
            more = CUT * (fault == SHORT)
            for q in range(4):
                taken[q] = min(taken[q], before(at[GIVEN[q]], REROLE + more, "R"))
                if q in KEPT.get(initial, ()):
                    taken[q] = min(taken[q], before(at[KEPT[initial][q]], more, "K"))
        at = added(taken)
    out = []
    for w in at:
        letters, digits = [], (w & ((1 << low) - 1)) >> 3
        for k in range(width - 1, -1, -1):
            if not (d := digits >> 3 * k & 7):
                break
            letters.append(LETTERS[d])
        out.append((w >> low, "".join(letters), w & ((1 << low) - 1)))
    return out


def cheapest(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """The cost and the letters of the cheapest edits of rows (role's initial, fault); of equally cheap ones the first in ASCII order."""
    costs, ranks, base, found = tuple(0 if q in ENDS else -1 for q in range(4)), (0,) * 4, 0, []
    ends = range(len(rows), 0, -BLOCK_ROWS) if rows else (0,)
    for n, end in enumerate(ends):
        block = tuple(rows[max(0, end - BLOCK_ROWS) : end])
        solved = _block(block, costs, ranks, n == 0)
        found.append((block, solved))
        least = min(c for c, _, _ in solved)
        order = sorted({w for _, _, w in solved})
        costs, ranks, base = tuple(c - least for c, _, _ in solved), tuple(order.index(w) for _, _, w in solved), base + least
    state, letters = START, []
    for block, solved in reversed(found):
        letters.append(solved[state][1])
        row = iter(block)
        for letter in solved[state][1]:
            state = step(state, letter) if letter == "I" else step(state, letter, next(row)[0])
    return base + costs[START], "".join(letters)


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text of each row, damaged by crc32(`conv:turn`) % 20: 0 drops it (the row stays, with role and text
    null), 1 empties its text, 2 takes [.!?] from it, 3 repeats it, 4 makes it the user's. Nulls read as one space, except that turn stays null."""
    part = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    how = F.pmod(F.crc32(F.encode(F.concat(part(conv_col), F.lit(":"), part(turn_col)), "utf-8")), F.lit(20))
    df = conversations.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), part(role_col).alias("role"), part(text_col).alias("text"), how.alias("how"))
    role = F.when(F.col("how") == 0, None).when(F.col("how") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("how") == 0, None).when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return df.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("how") == 3, 2).otherwise(1))).alias("again")).drop("again")


def _digest() -> Column:
    """What rows of the same role and text have in common."""
    return F.unhex(F.sha2(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), "utf-8"), 256))


#: The order of a conversation's rows, nulls first: rows of the same turn are told apart by role and text.
_ORDER = ["turn", "role", "digest"]
_FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """(is it the first of its conversation, conversation, values) of each row of a sorted partition."""
    now, any_ = None, False
    for batch in batches:
        values = [batch[c].to_pylist() for c in columns]
        for conv, *rest in zip(batch["conv"].to_pylist(), *values, strict=True):
            first = not any_ or not (conv == now or (conv != conv and now != now))
            now, any_ = conv, True
            yield first, conv, rest


def _emit(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


class _Judged:
    """What a conversation's rows have shown so far: bytes and digests, no texts."""

    def __init__(self, conv):
        self.conv, self.rows, self.seen, self.turns, self.low, self.high = conv, [], set(), 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last_turn = self.last_initial = None

    def add(self, turn, initial, blank, cut, digest) -> None:
        if turn is not None:
            self.turns += turn != self.last_turn
            self.last_turn = self.high = turn
            self.low = turn if self.low is None else self.low
        if self.last_initial is not None:
            self.illegal += self.last_initial + initial not in ("su", "ua", "au")
        self.last_initial = initial
        again, fault = digest in self.seen, FINE
        self.seen.add(digest)
        if blank:
            self.blank, fault = self.blank + 1, GONE
        elif again:
            self.duplicate, fault = self.duplicate + 1, GONE
        elif cut:
            self.truncated, fault = self.truncated + 1, SHORT
        self.rows.append((initial if initial in KEPT else "-", fault))

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *cheapest(self.rows))


def _judge(conv_type: pa.DataType):
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    types = [conv_type, *[pa.int64()] * 6, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for first, conv, (turn, initial, blank, cut, digest) in _groups(batches, ["turn", "initial", "blank", "cut", "digest"]):
            if first:
                if now is not None:
                    out.append(now.result())
                now = _Judged(conv)
                if len(out) >= 1_000:
                    yield _emit(names, types, out)
                    out = []
            if initial is not None:
                now.add(turn, initial, blank, cut, digest)
        if now is not None:
            yield _emit(names, types, [*out, now.result()])

    return run


def audits(rows: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation of damaged() rows."""
    from pyspark.sql.types import StructField, StructType

    light = rows.select(
        "conv", "turn", "role", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"), _digest().alias("digest"),
    )
    kind = rows.schema["conv"].dataType
    schema = StructType([StructField("conv", kind), *StructType.fromDDL(_FOUND).fields])
    return light.repartition("conv").sortWithinPartitions("conv", *_ORDER).mapInArrow(tidy(_judge(to_arrow_type(kind))), schema)


def _hash(conv_type: pa.DataType):
    found = [f.split()[0] for f in _FOUND.split(", ")]
    names, types = ["conv", *found, "repaired_sha256"], [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, digest, at, state, begun = [], None, hashlib.sha256(), 0, START, False

        def put(role: str, text: str) -> None:
            nonlocal begun
            digest.update(f"\n{role}:{text}".encode() if begun else f"{role}:{text}".encode())
            begun = True

        def insert() -> None:
            nonlocal at, state
            while at < len(now[-1]) and now[-1][at] == "I":
                at, state = at + 1, GIVEN[state]
                put(ROLE[state], "")

        def close() -> None:
            if now is not None:
                insert()
                out.append((*now, digest.hexdigest()))

        for first, conv, (role, text, *values) in _groups(batches, ["role", "text", *found]):
            if first:
                close()
                now, digest, at, state, begun = (conv, *values), hashlib.sha256(), 0, START, False
                if len(out) >= 1_000:
                    yield _emit(names, types, out)
                    out = []
            elif role is not None:
                insert()
                letter, at = now[-1][at], at + 1
                state = step(state, letter, role[:1])
                if letter != "D":
                    put(role if letter == "K" else ROLE[state], text)
        close()
        if out:
            yield _emit(names, types, out)

    return run


def repair(rows: DataFrame) -> DataFrame:
    """conv, its faults, the cheapest edits and a digest of the conversation after them, for each conversation of rows (conv,
    turn, role, text); a row without role only says that there is the conversation.

    Rows are taken by turn, nulls first, those of the same turn by role and then by a digest of the text.  A row's
    first fault counts: blank, duplicate (role and text of an earlier row), truncated.  Edits: Keep, Rerole to user or
    assistant, Delete (of blank and repeated rows always), Insert an empty user or assistant row; the result's roles
    are an optional system row and pairs of user and assistant.  A role that begins with another letter, or is
    empty, can't be kept.  Rows without a conversation are one conversation, repeated rows are duplicates, an empty
    table gives an empty result; a conversation without rows has zeros, no letters and the digest of nothing.
    """
    from pyspark.sql.types import StructField, StructType

    kind = rows.schema["conv"].dataType
    found = audits(rows)
    names = [f.name for f in StructType.fromDDL(_FOUND).fields]
    first = found.select("conv", F.lit(0).alias("order"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("digest"), *names)
    texts = rows.where("role is not null").select("conv", F.lit(1).alias("order"), "turn", "role", "text", _digest().alias("digest"), *[F.lit(None).cast(first.schema[n].dataType).alias(n) for n in names])
    schema = StructType([StructField("conv", kind), *StructType.fromDDL(_FOUND).fields, StructField("repaired_sha256", first.schema["audit"].dataType)])
    both = first.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "order", *_ORDER).drop("digest", "turn", "order")
    return both.mapInArrow(tidy(_hash(to_arrow_type(kind))), schema)


def report(conversations: DataFrame) -> DataFrame:
    """Query op12: every conversation of the table after damage and repair. Columns beside conv_id, turn, role and text are not looked at."""
    return repair(damaged(conversations)).withColumnRenamed("conv", "conv_id")


def _insert(s: str) -> str:
    return _edit(s, str(INSERT), "I")


def _edit(s: str, cost: str, letter: str) -> str:
    return f"lpad(cast(cast(left({s}, 9) as bigint) + {cost} as varchar), 9, '0') || substr({s}, 10) || '{letter}'"


def oracle() -> str:
    """DuckDB SQL of op12: paths as strings of nine digits of cost and letters, row by row, for all four states."""
    from .sql import CRC32

    keep = lambda who, s: f"case when initial = '{who}' and fault < 2 then {_edit(s, 'more', 'K')} end"
    give = lambda s: f"case when fault < 2 then {_edit(s, f'{REROLE} + more', 'R')} end"
    gone = lambda s: _edit(s, str(DELETE), "D")
    return rf"""
with recursive {CRC32},
hashed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, concat(coalesce(cast(conv_id as varchar), ' '), ':', coalesce(cast(turn as varchar), ' ')) as word from conversations),
how as (select conv_id, turn, role, text, (select list_reduce(list_prepend(4294967295, list_transform(range(1, len(word) + 1), lambda i: cast(ascii(substr(word, i, 1)) as bigint))), lambda c, b: xor(c >> 8, entries[cast(xor(c, b) & 255 as bigint) + 1])) from crc_table) as c from hashed),
acted as (select conv_id, turn, role, text, xor(c, 4294967295) % 20 as h from how),
dealt as (
    select conv_id, turn, case when h = 4 then 'user' else role end as role, case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
    from (select *, unnest(range(case when h = 3 then 2 else 1 end)) as again from acted where h <> 0)
),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k from dealt),
numbered as (
    select *, row_number() over (partition by conv_id, role, text order by k) > 1 as again,
        not regexp_matches(text, '[^\x20\x09-\x0D]') as is_blank, not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') as is_cut
    from placed
),
judged as (
    select *, left(role, 1) as initial, case when is_blank or again then 2 when is_cut then 1 else 0 end as fault, case when not is_blank and not again and is_cut then {CUT} else 0 end as more,
        lag(left(role, 1)) over (partition by conv_id order by k) || left(role, 1) as pair
    from numbered
),
counts as (
    select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where is_blank) as blank, count(*) filter (where again and not is_blank) as duplicate,
        count(*) filter (where fault = 1) as truncated, count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal
    from judged group by conv_id
),
added as (
    select conv_id, 0::bigint as i, '000000000' as s0, cast(null as varchar) as ss, {_insert("'000000000'")} as su, {_insert(_insert("'000000000'"))} as sa from counts
    union all
    select conv_id, i, s0, ss, su, least(sa, {_insert("su")}) as sa from (
        select conv_id, i, s0, ss, least(su, {_insert("s0")}, {_insert("ss")}, {_insert("sa")}) as su, sa from (
            select r.conv_id, r.k as i, {gone("s0")} as s0, least({gone("ss")}, {keep("s", "s0")}) as ss,
                least({gone("su")}, {keep("u", "s0")}, {keep("u", "ss")}, {keep("u", "sa")}, {give("s0")}, {give("ss")}, {give("sa")}) as su,
                least({gone("sa")}, {keep("a", "su")}, {give("su")}) as sa
            from added a join judged r on a.conv_id is not distinct from r.conv_id and r.k = a.i + 1
        )
    )
),
best as (select c.conv_id, cast(left(least(s0, sa), 9) as bigint) as cost, substr(least(s0, sa), 10) as audit from counts c join added a on a.conv_id is not distinct from c.conv_id and a.i = c.n),
letters as (select conv_id, p, letter, sum((letter <> 'I')::int) over (partition by conv_id order by p) as k from (select conv_id, unnest(range(1, len(audit) + 1)) as p, unnest(string_split(audit, '')) as letter from best where audit <> '')),
result as (
    select l.conv_id, l.p, l.letter, r.role, r.text, r.initial, row_number() over (partition by l.conv_id order by l.p) as place
    from letters l left join judged r on r.conv_id is not distinct from l.conv_id and r.k = l.k and l.letter <> 'I' where l.letter <> 'D'
),
shift as (select conv_id, max(case when place = 1 and letter = 'K' and initial = 's' then 1 else 0 end) as s from result group by conv_id),
told as (
    select t.conv_id, sha256(string_agg(concat(case when letter = 'K' then role when (place - s) % 2 = 1 then 'user' else 'assistant' end, ':', case when letter = 'I' then '' else text end), chr(10) order by p)) as digest
    from result t join shift f on f.conv_id is not distinct from t.conv_id group by t.conv_id
)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
    coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, coalesce(digest, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on c.conv_id is not distinct from o.conv_id left join best b on b.conv_id is not distinct from o.conv_id left join told t on t.conv_id is not distinct from o.conv_id
"""
