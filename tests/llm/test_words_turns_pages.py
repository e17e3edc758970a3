"""Spelling variants, conversation repair and page extraction against plain statements of what they should give."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quantloom.llm import conversations, pages, spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(texts):
    n = Counter()
    for i, text in texts:
        for run in spelling.RUN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    form, count = {}, {}
    for w in n:
        found = [v for v in n if near(w, v)]
        count[w] = len(found)
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], count[w], n.get(form[w])) for w in n}


def test_spelling_variants(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("aébÀ÷") for _ in range(rng.randint(4, 9))) for _ in range(160)] + ["color", "colour", "colours", "Colour", "ÀÉÎÕÜ", "àéîõü", "x" * 3000, "x" * 2999]
    texts = [(i, " ".join(rng.choices(words, weights=[1 + k % 9 for k in range(len(words))], k=60)) + "-" * (i % 3)) for i in range(120)]
    texts += [(None, None), (7, ""), (None, "color colour colours 12 _"), (3, texts[3][1]), (3, texts[3][1]), (900, "waaaa " * 3 + "wbaaa " * 8 + "wbbaa " * 20)]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in texts], "doc_id long, text string, word string, n int")
    want = plain_variants(texts)
    for shard in (40, 50_000):
        got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(spelling.vocabulary(docs), shard).collect()}
        assert got == want
    assert any(w[1] != w[0] for w in want.values() if w[0]) and spelling.report(docs).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.report(docs.limit(0)).count() == 0


def test_index_intervals_are_suffix_ranks():
    words = sorted({"banana", "bandana", "nanas", "ananas", "bananas"})
    index = spelling.Index(words)
    for pattern in ("an", "ana", "nanas", "band", "zz"):
        low, high = np.zeros(1, np.int64), np.full(1, len(index.text))
        for c in reversed(pattern):
            low, high = index.step(np.array([ord(c)]), low, high)
        assert high[0] - low[0] == sum(w.startswith(pattern, i) for w in words for i in range(len(w)))


def cheapest(rows):
    """All edits of a few rows, the cheapest and first of them."""
    best = None

    def go(i, state, cost, letters):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and state in conversations.ENDS:
            best = min(best or (cost, letters), (cost, letters))
        if not letters.endswith("II"):
            go(i, conversations.GIVEN[state], cost + 3, letters + "I")
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, state, cost + 4, letters + "D")
            if fault != conversations.GONE:
                more = 3 * (fault == conversations.SHORT)
                go(i + 1, conversations.GIVEN[state], cost + 3 + more, letters + "R")
                if state in conversations.KEPT.get(initial, {}):
                    go(i + 1, conversations.KEPT[initial][state], cost + more, letters + "K")

    go(0, conversations.START, 0, "")
    return best


def test_cheapest_edits(monkeypatch):
    rng = random.Random(1)
    for block in (64, 2, 1):
        monkeypatch.setattr(conversations, "BLOCK_ROWS", block)
        for n in [0, 1, 2, 3, 4, 5] * 12:
            rows = [(rng.choice("suaau-"), rng.choice([0, 0, 0, 1, 2])) for _ in range(n)]
            assert conversations.cheapest(rows) == cheapest(rows)
    monkeypatch.undo()
    rows = [(rng.choice("uuua"), rng.choice([0, 0, 1])) for _ in range(500)]
    whole = conversations.cheapest(rows)
    monkeypatch.setattr(conversations, "BLOCK_ROWS", 7)
    assert conversations.cheapest(rows) == whole and len(conversations.cheapest(rows * 40)[1]) >= 20_000


def plain_repair(table):
    """The contract, row by row."""
    by, out = defaultdict(list), {}
    for conv, turn, role, text in table:
        by[conv]
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h:
            text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
            by[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, judged, counts = set(), [], Counter()
        for _, role, text in rows:
            solid = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            judged.append((role[:1] if role[:1] in list("sua") else "-", {"": 0, "truncated": 1}.get(fault, 2)))
        cost, letters = cheapest(judged)
        turns = {r[0] for r in rows if r[0] is not None}
        state, k, said = conversations.START, 0, []
        for letter in letters:
            role, text = ("", "") if letter == "I" else rows[k][1:]
            k += letter != "I"
            state = conversations.step(state, letter, role[:1])
            if letter != "D":
                said.append(f"{role if letter == 'K' else conversations.ROLE[state]}:{text}")
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"],
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)), cost, letters, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def test_conversation_repair(spark):
    rng = random.Random(3)
    table = [(c, t, rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]), rng.choice(["Yes.", "No!", "well", " \n", None, "a. b", "end. ", "fin?\t", str(t)])) for c in range(60) for t in rng.sample(range(9), rng.randint(1, 5))]
    table += [(None, 1, "user", "Hi."), (None, None, "assistant", "Yo."), (None, None, None, None), (77, 5, "user", "Long. " * 400_000), (77, 5, "user", "Long. " * 400_000)]
    gone = next(c for c in range(100, 200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table.append((gone, 0, "user", "lost"))
    df = spark.createDataFrame([(*r, 1, "x") for r in table], "conv_id long, turn long, role string, text string, conv int, audit string").repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.report(df).collect()}
    assert got == plain_repair(table)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.report(df.limit(0)).count() == 0


ARTICLE = ["A title", "It was a long day, and nobody, not even the postman, came by. So we waited.", "Short.", "Then, at last, the bell rang: once, twice; and the door opened. Who was it?", "• one & two"]
LAYOUTS = {
    "tags": "<html><head><title>x</title><script>var a='<p>no</p>';</script></head><body><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><main><article><header><h1>{0}</h1></header><p>{1}<p>{2}</p><aside><p>Beside, quite long, with commas, and more.</p></aside>"
    "<blockquote>{3}</blockquote><ul><li>{4}</ul><footer>tags</footer></article></main><aside><p>Other news, long enough to look like text, is here.</p></aside><footer>&copy; us, all rights, reserved.</footer>",
    "classes": "<body class='has-sidebar nav-open'><div id=top class='site-header'>Logo</div><div class='main-menu'><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><div class='cookie-notice'>We use cookies, as all do, and more. Accept?</div>"
    "<div class='content-with-sidebar'><div class='post'><h1 class=entry-title>{0}</h1><div class='entry-content'><p>{1}</p><p>{2}</p><div class='adBox'>Buy this, now! Or that.</div><p>{3}</p><div>{4}</div></div></div>"
    "<div class='sidebar'><p>Popular, long, and full of commas, as they are.</p></div></div><div id='comments'><ol class=commentlist><li><p>A reader's long comment, with commas, and full stops. And so on, and on, and on, for ever and ever, until the end of the page, and then some more.</p></li></ol></div>",
    "plain": "<body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>Sport, and more</a></div><div><div><h1>{0}</h1><div><p>{1}</p><p>{2}</p><p>{3}</p><p>{4}</p></div></div></div><div><a href=9>Imprint</a></div></body>",
    "roles": "<body><div role=banner>Top.</div><div role=navigation>Menu, here.</div><div role=main><h1>{0}</h1><p>{1}</p><p>{2}</p><form><label>Name</label><input name=q><button>Send</button></form><p>{3}</p><p style='display: none'>Unseen, but long, text.</p><p>{4}</p></div><div role=contentinfo>End.</div>",
    "comments": "<article><h1>{0}</h1><p>{1}</p><p>{2}</p><p>{3}</p><p>{4}</p></article><section class=comments><article class=comment><p>First, I must say, it is long, and I like it, much more than what I read before, here or elsewhere.</p></article><article class=comment><p>Second, me too, and longer than that, by far, if I may say so, and I may.</p></article></section>",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_page_layouts(layout):
    escaped = [t.replace("&", "&amp;").replace("•", "&#8226;") for t in ARTICLE]
    assert pages.main_text(LAYOUTS[layout].format(*escaped)) == "\n\n".join(ARTICLE)
    spaced = [" \n" + t.replace(" ", "\t \n", 3).replace("e", "<i>e</i>", 1) + " " for t in escaped]
    assert pages.main_text(LAYOUTS[layout].format(*spaced)) == "\n\n".join(ARTICLE)


def test_pages_that_are_odd():
    for source, want in {
        None: "", "": "", "no markup at all": "no markup at all", "<nav>only a menu</nav>": "", "<article><p>a &lt;b&gt; &notit; &#x41;&nbsp;c</p": "a <b> ¬it; A c", "<article><!-- x --><p>one<!-- <p>no</p> --> two<br>three</article>": "one two three",
        "<article><p>x<script>if (a</p>b) {'</scrip'}</script>y</p><style>p{}</style>": "xy", "<article><p title='a>b' class=\"c\">in</p><p hidden>out</p><p>5 < 6 <3</p>": "in\n\n5 < 6 <3", "<article><p>end<a href='": "end",
        "<article><p>See <a href=x>this</a> and <span class=ad>buy</span> that</p><table><tr><td>1<td>2<tr><td>3</table></article>": "See this and that\n\n1\n\n2\n\n3",
    }.items():
        assert pages.main_text(source) == want, source
    long = "<article>" + "<p>word, and word.</p>" * 40_000
    assert pages.main_text(long).count("\n\n") == 39_999
    deep = "<div>" * 3_000 + "<p>text, here.</p>"
    assert pages.main_text(deep) == "text, here."


def test_page_table(spark):
    rows = [(1, "u", LAYOUTS["tags"].format(*ARTICLE), "t"), (None, None, None, None), (3, "u", "", "t"), (1, "u", LAYOUTS["tags"].format(*ARTICLE), "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(pages.report(df).collect(), key=lambda r: r["n_chars"])
    assert [r["text"] for r in got] == ["", "", *["\n\n".join(ARTICLE)] * 2] and got[-1]["n_chars"] == len(got[-1]["text"])
    assert pages.report(df.limit(0)).count() == 0 and pages.report(df).columns == ["page_id", "url", "text", "n_chars"]


def test_given_pages(spark):
    """The pages of the test data have one layout: what its article's tags hold is the main text."""
    import html
    import re

    for page in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        article = page["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert pages.main_text(page["html"]) == "\n\n".join(b for b in blocks if b)
