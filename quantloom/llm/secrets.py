"""Secrets: patterns, and assignment-aware lexing of source and configuration.

Texts with a line that holds a sensitive word and then an operator are lexed into
names, operators and literals; assignments, with or without a type, give
name-literal pairs.  A name on the right side stands for the constant that its
function or the file gives it, before or after; pieces that stand side by side or are joined by
`+`, names among them, are one literal with several places, in brackets over several lines too.
A call gives what stands after its `or`, and its second argument where the first names something;
elements of XML and block values of YAML are pairs as well.  Other calls, templates and unknown names give no literal.  A literal is
scored by the parts of its target's name and by how random it looks.  All work is
per document: nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pii import SPAN, SPANS, joined
from .shared import with_columns
from .textkit import slices

#: The base kinds, in the order of their listing.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are taken whole, so shorter ones need not be looked at
EXTRA = "literal"

#: Parts of names and how much they say.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "passphrase": 3.0, "passcode": 3.0, "pass": 2.0, "pwd": 2.5, "secret": 3.0, "token": 2.5, "credential": 2.5, "credentials": 2.5, "cred": 2.0, "creds": 2.0,
    "auth": 1.5, "bearer": 2.0, "private": 1.5, "key": 1.5, "apikey": 3.0, "jwt": 2.5, "otp": 2.0, "cookie": 1.5, "webhook": 1.0, "signing": 1.0, "encryption": 1.0, "api": 0.5, "access": 0.5, "signature": 1.0, "salt": 1.5,
}
HARMLESS = {"author": -2.0, "keyboard": -2.0, "name": -1.0, "file": -1.0, "path": -1.0, "url": -1.0, "type": -2.5, "kind": -2.5, "algorithm": -3.0, "alg": -3.0, "algo": -3.0, "mode": -2.0, "scheme": -2.5, "format": -2.5, "version": -2.0, "size": -2.0, "prefix": -1.5, "length": -1.5, "count": -1.5, "public": -1.5, "id": -0.5, "field": -1.0, "header": -1.0, "label": -1.5, "policy": -1.0, "expiry": -1.5, "ttl": -1.5, "max": -1.0, "min": -1.0, "limit": -1.5}
THRESHOLD = 3.5
#: What stands for a secret but is none.
PLACEHOLDER = re.compile(r"(?i)\$\{.*\}|\$\w+|<.*>|\{\{.*\}\}|%\(.*\)s|[x*.#]+|(?:aes|rsa|sha|hmac|hs|rs|es|ps|ecdsa|ed|md|3?des|chacha|pbkdf|bcrypt|scrypt|argon)[-_/]?[0-9]{0,5}[a-z]{0,3}(?:[-_/][a-z0-9]{1,8})*|none|null|nil|true|false|change.?me|example|todo|your\W.*|str|string|int|bytes|any|optional")

#: A sensitive word, its letters together or apart as name_score() joins them, and an operator, a comma or a tag's end after it in its line: all that the lexer could score passes.
SENSITIVE_LINE = "(?i)(" + "|".join("[^A-Za-z0-9\\n]*".join(k) for k in SENSITIVE) + r")[^\n]*[=:,>]"
#: What a text must hold for each kind, and for the lexer.
NEEDS = (r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]", "AKIA", r"[0-9a-f]{24}", SENSITIVE_LINE)

_LEX = re.compile(r"""(?P<quote>\"{3}(?:[^\\]|\\.)*?\"{3}|\'{3}(?:[^\\]|\\.)*?\'{3}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<op>:=|=>|==|!=|<=|>=|[=:])|(?P<plus>\+)|(?P<end>[\n;,{}()\[\]])|(?P<word>[A-Za-z0-9_$.+/~-]+)|(?P<other>[^\s])""", re.S)
#: A line that begins a function, an element of XML, and what stands before another value.
_FUNCTION = re.compile(r"([ \t]*)(?:(?:export|default|public|private|protected|static|async|final|virtual|pub|local)\s+)*(?:def|function|func|fn|sub|proc)\b")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*)(?:\s[^<>]*)?>\s*([^<>\s]+)\s*</\1\s*>")
_OTHERWISE = ("or", "||", "??", "?:")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def name_score(name: str) -> float:
    """The most telling part of a name, half of what the others say, less what speaks against it."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)] + ["".join(parts)]
    best = max((SENSITIVE.get(p, 0.0) for p in [*parts, *joined]), default=0.0)
    others = sum(SENSITIVE.get(p, 0.0) for p in parts) - best
    return best + max(others, 0.0) / 2 + sum(HARMLESS.get(p, 0.0) for p in parts)


def randomness(literal: str) -> float:
    """0 for words, up to 2 for long literals of mixed characters."""
    n = len(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values()) if n else 0.0
    kinds = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(entropy / 4, 1.0) * (n >= 6) + 0.5 * (kinds > 1) + 0.5 * (kinds > 2)


Token = tuple[str, str, int, int]
#: A literal: its characters, the places they come from, whether all were quoted.
Literal = tuple[str, list[tuple[int, int]], bool]


def _inside(token: Token) -> tuple[str, int, int]:
    """What a quoted token holds, and where."""
    _, value, start, end = token
    n = 3 if len(value) >= 6 and value[:3] in ('"""', "'''") else 1
    return value[n:-n], start + n, end - n


def _ends(toks: list[Token]) -> list[int]:
    """For each token that opens a bracket the place of the one that closes it; the number of tokens without one."""
    out, open_ = [len(toks)] * len(toks), []
    for i, t in enumerate(toks):
        if t[1] in ("(", "[", "{"):
            open_.append(i)
        elif t[1] in (")", "]", "}") and open_:
            out[open_.pop()] = i
    return out


def _opening(toks: list[Token], i: int) -> int:
    """The place of the bracket that the one at i closes in its line; -1 without one."""
    depth = 0
    while i >= 0 and toks[i][1] != "\n":
        depth += (toks[i][1] == "]") - (toks[i][1] == "[")
        if not depth:
            return i
        i -= 1
    return -1


def _target(toks: list[Token], i: int) -> str | None:
    """The name that the operator at i gives a value: before it, before its type, or inside its last brackets."""
    j = i - 1
    typed = j  # first token of what may be a type
    if toks[j][1] == "]":
        typed = _opening(toks, j) - 1
    if toks[i][1] == "=" and typed >= 2 and toks[typed][0] == "word" and toks[typed - 1][1] == ":" and toks[typed - 2][0] in ("word", "quote"):
        j = typed - 2
    elif toks[j][1] == "]":
        j -= 1
    return toks[j][1].strip("\"'") if j >= 0 and toks[j][0] in ("word", "quote") else None


def _annotates(toks: list[Token], i: int) -> bool:
    """Whether the colon at i begins a type that an `=` follows in its line."""
    if toks[i][1] != ":" or i + 2 >= len(toks) or toks[i + 1][0] != "word":
        return False
    j = i + 2
    if toks[j][1] == "[":
        while j < len(toks) and toks[j][1] not in ("]", "\n"):
            j += 1
        j += 1
    return j < len(toks) and toks[j][1] == "="


def _value(toks: list[Token], ends: list[int], i: int, known: dict[str, Literal]) -> Literal | None:
    """The literal at i: quoted pieces and known names, side by side or joined by `+`, or one bare word; in brackets over several lines;
    what stands after the `or` of a call or an unknown name. None for other calls, templates and unknown names."""
    parts: list[Literal] = []
    lines = False  # inside brackets
    while i < len(toks):
        while lines and i < len(toks) and toks[i][1] in ("\n", "("):
            i += 1
        if i >= len(toks):
            break
        kind, value, start, end = toks[i]
        after = toks[i + 1] if i + 1 < len(toks) else ("end", "\n", end, end)
        if value == "(" and not parts and kind == "end":
            lines = True
            continue
        if kind == "word" and after[0] == "quote" and after[2] == end and value.lower() in ("r", "b", "u", "f", "br", "rb", "fr", "rf"):
            if "f" in value.lower() and "{" in after[1]:
                return None
            i += 1
            continue
        if kind == "quote":
            inside, a, b = _inside(toks[i])
            parts.append((inside, [(a, b)], True))
        elif kind == "word" and value in known:
            parts.append(known[value])
        elif kind == "word" and "+" in value and all(x in known for x in value.split("+")):
            parts += [known[x] for x in value.split("+")]
        else:
            j = i + 1 if kind == "word" else i
            if kind == "word" and after[1] in ("(", "["):
                j = ends[j] + 1
            said = "".join(t[1] for t in toks[j : j + 2])
            if kind == "word" and not parts and (toks[j][1] if j < len(toks) else "") == "or":
                i = j + 1
                continue
            if kind == "word" and not parts and said in _OTHERWISE:
                i = j + 2
                continue
            if kind != "word" or parts or after[0] == "plus" or after[1] in ("(", "["):
                return None
            parts.append((value, [(start, end)], False))
        while lines and i + 1 < len(toks) and toks[i + 1][1] == "\n":
            i += 1
        after = toks[i + 1] if i + 1 < len(toks) else ("end", "\n", end, end)
        if after[0] == "plus":
            i += 2
        elif after[0] == "quote" and parts[-1][2]:
            i += 1  # side by side
        else:
            break
    if lines and not all(x[2] for x in parts):
        return None
    return ("".join(x[0] for x in parts), [p for x in parts for p in x[1]], all(x[2] for x in parts)) if parts else None


def _scopes(text: str, toks: list[Token]) -> list[int]:
    """For each token the place of the line that began its function; -1 outside functions."""
    starts, ends, at, depth = [], [], -1, 0
    for m in re.finditer(r"[^\n]*\n?", text):
        line = m[0]
        if line.strip():
            indent = len(line) - len(line.lstrip(" \t"))
            if at >= 0 and indent <= depth and line.strip()[0] not in "})]{":
                at = -1
            f = _FUNCTION.match(line)
            if f and (at < 0 or indent <= depth):
                at, depth = m.start(), indent
        starts.append(m.start())
        ends.append(at)
    out, k = [], 0
    for t in toks:
        while k + 1 < len(starts) and starts[k + 1] <= t[2]:
            k += 1
        out.append(ends[k])
    return out


def pairs(text: str) -> list[tuple[str, str, list[tuple[int, int]], bool]]:
    """(name, literal, places, quoted) of each assignment; a copied constant has the places of its literals.

    Constants are collected first, so that one may be used before it is given; a function's own go before the file's.
    """
    toks = [(m.lastgroup, m[0], m.start(), m.end()) for m in _LEX.finditer(text)]
    scope, ends = _scopes(text, toks), _ends(toks)
    given: dict[int, dict[str, Literal]] = {-1: {}}
    out: list[tuple[str, str, list[tuple[int, int]], bool]] = []
    for last in (False, True):
        out = []
        for i in range(1, len(toks) - 1):
            own = given.setdefault(scope[i], {})
            known = own if scope[i] == -1 else given[-1] | own
            kind, value = toks[i][:2]
            if value == "(" and toks[i - 1][0] == "word" and toks[i + 1][0] == "quote" and i + 2 < len(toks) and toks[i + 2][1] == ",":
                second = _value(toks, ends, i + 3, known)  # a default: getenv("NAME", "literal")
                if second and second[2] and second[0]:
                    out.append((_inside(toks[i + 1])[0], *second))
                continue
            if kind != "op" or value not in ("=", ":", ":=", "=>") or _annotates(toks, i):
                continue
            name = _target(toks, i)
            block = value == ":" and i + 3 < len(toks) and toks[i + 1][1] in ("|", ">", "|-", ">-") and toks[i + 2][1] == "\n"
            literal = _value(toks, ends, i + 3 if block else i + 1, known) if name else None
            if literal:
                own[name] = literal
                if literal[0]:
                    out.append((name, *literal))
    for m in _ELEMENT.finditer(text):
        out.append((m[1], m[2], [m.span(2)], True))
    return out


def literal_score(name: str, literal: str, quoted: bool) -> float:
    """How much an assignment looks like a secret's; bare words without a digit may be names."""
    said = name_score(name)
    if said <= 0 or PLACEHOLDER.fullmatch(literal) or len(literal) < 4:
        return 0.0
    return said + randomness(literal) - (0.0 if quoted or any(c.isdigit() for c in literal) else 2.0)


def spans_of(text: str, needs: tuple[bool, ...] = (True,) * 4) -> list[tuple[str, int, int]]:
    """Base spans and added ones, by start, then kind as listed."""
    out = []
    if needs[0]:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if needs[1]:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if needs[2]:
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if needs[3]:
        base = sorted((a, b) for _, a, b in out)
        added = {place for name, literal, places, quoted in pairs(text) if literal_score(name, literal, quoted) >= THRESHOLD for place in places}
        for s, e in sorted(added):
            if not any(a < e and s < b for a, b in base):
                out.append((EXTRA, s, e))
    order = {k: i for i, k in enumerate((*KINDS, EXTRA))}
    return sorted(out, key=lambda x: (x[1], order[x[0]]))


def find(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns `keep` and `spans`: (kind, start, end) in code points, by start, then kind as listed.

    Null and empty texts have no spans; repeated rows are searched each; an empty table gives an empty result;
    columns not in keep are dropped, and those in keep may have any names (`spans` is replaced).
    """
    plain = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])])

    def searched(inside):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = inside(text_col)
            for batch in batches:
                for a, b in slices(batch[at]):
                    part = batch.slice(a, b - a)
                    text = part[at].cast(pa.large_string()).fill_null("")
                    needs = zip(*[pc.match_substring_regex(text, n).to_pylist() for n in NEEDS], strict=True)
                    spans = [[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(text[i].as_py(), n)] if any(n) else [] for i, n in enumerate(needs)]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, pa.list_(SPAN))], [*part.schema.names, "+spans"])

        return run

    found = with_columns(plain, searched, SPANS)
    return found.select(*[F.col(f"`{c}`") for c in keep if c != "spans"], "spans")


def report(docs: DataFrame) -> DataFrame:
    """Query op9: counts and digests of each document's spans; an empty table gives an empty result."""
    found = find(docs, keep=("doc_id",))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != EXTRA)
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
