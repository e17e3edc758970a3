"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each at the end of a path of tags from the
root.  For each path of a page its text and punctuation are added up and divided
by its number of blocks; the two ratios are smoothed along the page, multiplied,
weighed by the share of text outside links, and blocks whose value reaches the
spread of all are content.  What a page says of itself (tags, roles, names of
classes) takes menus, adverts, comments and the like out before, and the element
that holds the content gives what else belongs to it: headings and blocks that
are too short to be told by their ratios.

A page stays in its row: nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import with_columns
from .textkit import slices

#: Tags that run on in the block around them.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Tags without an end.
VOID = frozenset("area base basefont bgsound br col embed hr img input link meta param source track wbr".split())
#: Tags whose content is no markup.
RAW = frozenset("iframe noembed noframes script style textarea title".split())
#: Tags that are never part of an article.
OUTSIDE = frozenset("aside audio button canvas datalist dialog fieldset footer form head iframe menu nav noembed noframes noscript object script select style svg template textarea title video".split())
#: Roles that are never part of an article.
OUTSIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Start tags that end an open paragraph.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: Start tags that end an open tag of the second set, up to one of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
#: Parts of names of classes and ids: what is outside an article, what is unless an article's part is named with it, and an article's parts.
OUTSIDE_NAMES = frozenset(
    "ad ads adbox adsense adslot adunit advert advertisement advertising adverts alert banner blogroll breadcrumb breadcrumbs comment commentlist comments consent cookie cookies copyright "
    "disqus footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination popup promo promoted promotion recommended "
    "recommendations related replies respond share sharebar sharing sidebar sidenav signup skiplink social sponsor sponsored submenu subscribe subscription taboola tagcloud toast toolbar topbar widget widgets".split()
)
PERHAPS_NAMES = frozenset(["header", "legal", "meta", "search", "tags", "top"])
ARTICLE_NAMES = frozenset(["article", "body", "content", "entry", "main", "post", "story", "text"])
#: A name with one of these says what is beside it.
BESIDE = frozenset(["has", "no", "with", "without"])

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<![^\s"'/])(hidden)(?![^\s/>])""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?…、。！，：；？،؟।]")
#: Weights of a block's neighbours, two before to two after.
KERNEL = (0.06, 0.24, 0.4, 0.24, 0.06)


def _outside(tag: str, attributes: dict[str, str], within: bool) -> bool:
    """Does a start tag say that what it holds is outside an article? within: an article or main stands around it."""
    if tag in OUTSIDE or tag == "header" and not within:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in OUTSIDE_ROLES or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("html", "body", "main"):
        return False
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = {p.lower() for p in _NAME_PART.findall(name)}
        if parts & BESIDE:
            continue
        if parts & OUTSIDE_NAMES or parts & PERHAPS_NAMES and not parts & ARTICLE_NAMES and not within:
            return True
    return False


class _Page:
    """Elements and blocks of a page; element 0 is the root."""

    def __init__(self):
        self.parent, self.tag, self.path, self.kind, self.out = [0], [""], [0], [""], [False]
        self.paths: dict[tuple[int, str], int] = {}
        self.text: list[str] = []
        self.at: list[int] = []  # each block's element
        self.linked: list[int] = []  # each block's characters inside links

    def element(self, parent: int, tag: str, attributes: dict[str, str]) -> int:
        label = f"{tag}.{' '.join(sorted(re.sub('[0-9]+', '', attributes['class']).split()))}" if "class" in attributes else tag
        within = bool(self.kind[parent])
        kind = "article" if tag == "article" or attributes.get("role") == "article" else "main" if tag == "main" or attributes.get("role") == "main" or attributes.get("itemprop") == "articleBody" else ""
        self.parent.append(parent)
        self.tag.append(tag)
        self.path.append(self.paths.setdefault((self.path[parent], label), len(self.paths) + 1))
        self.kind.append(kind or self.kind[parent] and "inside")
        self.out.append(self.out[parent] or _outside(tag, attributes, within))
        return len(self.tag) - 1


def read(source: str) -> _Page:
    """The blocks of a page, as far as they may be content; any text is a page."""
    page, stack = _Page(), [0]
    pieces: list[str] = []
    linked = links = 0
    muted: list[str] = []  # inline tags, from one that is outside an article on
    opened: Counter[str] = Counter()  # open elements by tag

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not muted and not page.out[stack[-1]]:
            text = unescape(raw)
            pieces.append(text)
            if links:
                linked += len("".join(text.split()))

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.text.append(text)
                page.at.append(stack[-1])
                page.linked.append(linked)
            pieces.clear()
        linked = 0

    def open_(element: int) -> None:
        stack.append(element)
        opened[page.tag[element]] += 1

    def close(tags: set[str], barrier: set[str] = frozenset()) -> None:
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if page.tag[stack[k]] in tags:
                opened.subtract(page.tag[e] for e in stack[k:])
                del stack[k:]
                return
            if page.tag[stack[k]] in barrier:
                return

    position, end = 0, len(source)
    while position < end:
        m = _TAG.search(source, position) if source.find(">", position) >= 0 or source.find("<!--", position) >= 0 else None
        if m is None:
            tail = re.search(r"<[A-Za-z/!?]", source[position:])  # a tag that the page's end cuts off
            add(source[position : position + tail.start()] if tail else source[position:])
            break
        add(source[position : m.start()])
        position = m.end()
        if m[2] is None:
            continue
        tag, ending = m[2].lower(), m[1]
        if tag in INLINE:
            if ending:
                links = max(0, links - (tag == "a"))
                if tag in muted:
                    del muted[len(muted) - 1 - muted[::-1].index(tag) :]
            else:
                links += tag == "a"
                if tag not in VOID and (muted or m[3] and _outside(tag, _attributes(m[3]), bool(page.kind[stack[-1]]))):
                    muted.append(tag)
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in RAW:  # all of them are outside an article, and none ends a block
            if not ending:
                m = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(source, position)
                position = m.start() if m else end
            continue
        flush()
        links = 0
        muted.clear()
        if ending:
            close({tag})
            continue
        if tag in ENDS_PARAGRAPH:
            close({"p"}, {"button", "td", "th", "table", "caption"})
            if tag[0] == "h" and tag[1:].isdigit():
                close({f"h{k}" for k in range(1, 7)}, {"div", "section", "article", "td", "th", "main", "body"})
        elif tag in ENDS:
            for _ in range(3):
                close(*ENDS[tag])
        if tag in VOID:
            continue
        open_(page.element(stack[-1], tag, _attributes(m[3]) if m[3] else {}))
    flush()
    return page


def _attributes(raw: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def ratios(page: _Page) -> list[float]:
    """Each block's fused value: text and punctuation a block of its path, smoothed along the page, outside links."""
    total: dict[int, list[int]] = {}
    paths = [page.path[e] for e in page.at]
    for path, text, linked in zip(paths, page.text, page.linked, strict=True):
        row = total.setdefault(path, [0, 0, 0, 0])
        row[0] += 1
        row[1] += len(text)
        row[2] += len(_PUNCTUATION.findall(text))
        row[3] += min(linked, len(text))
    by_path = {p: (t / n, (c + 0.1) / n, 1 - k / t) for p, (n, t, c, k) in total.items()}
    rows = [by_path[p] for p in paths]
    out = []
    for i in range(len(rows)):
        weights = [(w, rows[j]) for j, w in zip(range(i - 2, i + 3), KERNEL, strict=True) if 0 <= j < len(rows)]
        whole = sum(w for w, _ in weights)
        long, marks = sum(w * r[0] for w, r in weights) / whole, sum(w * r[1] for w, r in weights) / whole
        out.append(long * marks * rows[i][2])
    return out


def main_blocks(page: _Page) -> list[int]:
    """The blocks of the main text, in the order of the page."""
    n = len(page.text)
    if not n:
        return []
    value = ratios(page)
    mean = sum(value) / n
    spread = math.sqrt(sum((v - mean) ** 2 for v in value) / n)
    by_path: dict[int, list[float]] = {}
    for e, v in zip(page.at, value, strict=True):
        by_path.setdefault(page.path[e], []).append(v)
    chosen = {p for p, v in by_path.items() if sum(v) / len(v) >= min(spread, max(map(lambda x: sum(x) / len(x), by_path.values())))}
    weight = [0.0] * len(page.tag)  # characters of chosen blocks below each element
    size = [0] * len(page.tag)
    title = [False] * len(page.tag)
    for e, text in zip(page.at, page.text, strict=True):
        size[e] += len(text)
        weight[e] += len(text) if page.path[e] in chosen else 0
        title[e] |= page.tag[e] == "h1"
    for e in range(len(page.tag) - 1, 0, -1):  # parents come before their children
        weight[page.parent[e]] += weight[e]
        size[page.parent[e]] += size[e]
        title[page.parent[e]] |= title[e]
    root = _container(page, weight, size, title)
    inside = [False] * len(page.tag)
    inside[root] = True
    for e in range(root + 1, len(page.tag)):
        inside[e] = inside[page.parent[e]]
    keep = [i for i in range(n) if inside[page.at[i]]]
    if page.kind[root] in ("article", "main"):
        return keep
    links = [2 * page.linked[i] > len(page.text[i]) and page.path[page.at[i]] not in chosen for i in range(n)]
    return [i for i in keep if not links[i]]


def _container(page: _Page, weight: list[float], size: list[int], title: list[bool]) -> int:
    """The element that holds the article: one that says so and holds half of what is chosen, or the smallest that holds nearly all of it and its title."""
    said = [e for e in range(1, len(page.tag)) if page.kind[e] in ("article", "main") and not page.out[e] and size[e]]
    articles, mains = ([e for e in said if page.kind[e] == kind] for kind in ("article", "main"))
    half = [e for e in [*articles, *mains] if 2 * weight[e] >= weight[0]]
    if half:
        return half[0]  # the outermost article before the outermost main
    if len(articles) == 1:  # shorter than what stands around it
        return articles[0]
    if mains:
        return mains[0]
    children: dict[int, list[int]] = {}
    for e in range(1, len(page.tag)):
        children.setdefault(page.parent[e], []).append(e)
    at = 0
    while True:
        best = max(children.get(at, ()), key=weight.__getitem__, default=None)
        if best is None or weight[best] < 0.9 * weight[0]:
            break
        at = best
    if page.tag[at] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td"):
        at = page.parent[at]
    while at and not title[at] and title[page.parent[at]] and 4 * (size[page.parent[at]] - size[at]) <= size[at]:
        at = page.parent[at]
    return at


def main_text(source: str | None) -> str:
    """The main text of a page: blocks with white space as one space each, two line feeds between them; empty if there is none."""
    page = read(source or "")
    return "\n\n".join(page.text[i] for i in main_blocks(page))


def extract(pages: DataFrame, *, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with the main text of each page as out_col, which takes the place of a column of that name.

    Null and empty pages, and pages without content, have an empty text; text that is no markup is one block.
    Repeated rows give the same text each, an empty table stays empty, other columns stay whatever their names.
    A page is held whole by one task, at some twenty times its size.
    """

    def run(inside: Callable[[str], str]):
        def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in slices(batch[inside(html_col)]):
                    part = batch.slice(a, b - a)
                    found = pa.array([main_text(x.as_py()) for x in part[inside(html_col)]], pa.string())
                    yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, f"+{out_col}"])

        return texts

    return with_columns(pages, run, StructType([StructField(out_col, StringType())]))


def report(pages: DataFrame) -> DataFrame:
    """Query op13: page_id, url, the main text and its code points, for each row of pages."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
