"""Awkward input for every text operator, and measured quality where no plain statement of the result exists."""

import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from quantloom.llm import bpe, decontaminate, licenses, media, neardup, pii, secrets, sharding, shared, substrings, toxicity

KEPT = "doc_id long, text string"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def few(spark):
    words = " ".join(f"w{i}" for i in range(70))
    rows = [(1, words), (2, words + " tail"), (3, None), (4, ""), (5, "mail a.b@example.org or +1 743 555 3824"), (6, 'password = "S3curePa9!x"'), (7, "Released under the MIT License."), (None, words)]
    return spark.createDataFrame(rows, KEPT)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20, 40)))], "item_id long, text string")


def reports(bench, labels):
    return {
        "op1": lambda d: decontaminate.report(d, bench), "op2": neardup.report, "op4": media.report, "op5": pii.report, "op6": substrings.report,
        "op7": licenses.report, "op8": lambda d: toxicity.report(d, labels), "op9": secrets.report, "op10": bpe.report,
    }


def test_repeated_rows_and_empty_tables(spark, few, bench):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for name, report in reports(bench, labels).items():
        once, twice = Counter(report(few).collect()), Counter(report(few.unionByName(few)).collect())
        assert twice == Counter({r: 2 * n for r, n in once.items()}), name
        assert report(few.limit(0)).count() == 0, name
    assert sharding.report(few.unionByName(few)).count() == 16 and sharding.report(few.limit(0)).count() == 0


def test_texts_longer_than_a_slice(spark, bench):
    body = " ".join(f"x{i % 9973} y{i // 7}" for i in range(250_000))
    text = f"{body} mail a.b@example.org token = \"abcdef123456\" {' '.join(f'w{i}' for i in range(20, 40))}"
    assert len(text) > 2_500_000
    long = spark.createDataFrame([(1, text), (2, text), (3, "short")], KEPT)
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    got = {name: {r["doc_id"]: r for r in report(long).collect()} for name, report in reports(bench, labels).items()}
    assert got["op1"][1]["n_hit"] == 20 and got["op1"][1]["longest"] == 20 and not got["op1"][3]["contaminated"]
    assert got["op1"][1]["longest_at"] == got["op1"][1]["n_words"] - 20 and got["op1"][1]["longest_item"] == 1
    assert got["op2"][2]["component_id"] == 1 and got["op6"][2]["n_removed"] == got["op6"][2]["n_words"] and got["op6"][1]["n_removed"] == 0
    assert got["op4"][1]["payload_bytes"] == -(-len(text) // 64) * 64 and got["op4"][1]["media_sha256"] == got["op4"][2]["media_sha256"]
    assert got["op5"][1]["n_email"] == 1 and got["op9"][1]["n_assign"] == 1 and got["op10"][1]["n_tokens"] > 500_000 and got["op10"][1] == got["op10"][1]
    assert sharding.report(long).count() == 3


def test_ids_are_integers_or_any(spark):
    named = spark.createDataFrame([("a", "one two"), ("b", None)], "doc_id string, text string")
    for operator in (neardup.group, sharding.shard_by_bytes, substrings.cut_repeats):
        with pytest.raises(TypeError):
            operator(named)
    assert {r["doc_id"] for r in media.report(named).collect()} == {r["doc_id"] for r in bpe.report(named).collect()} == {"a", "b"}


def test_rows_without_id_are_judged_by_their_text(spark, bench):
    hit = "so " + " ".join(f"w{i}" for i in range(20, 40))
    rows = spark.createDataFrame([(None, hit), (None, "clean"), (3, "clean"), (3, hit), (None, None)], KEPT)
    assert sorted(map(tuple, decontaminate.decontaminate(rows, bench).collect()), key=repr) == sorted([(3, "clean"), (None, "clean"), (None, None)], key=repr)
    odd = rows.withColumnRenamed("doc_id", "_0").withColumnRenamed("text", "a.b")
    assert decontaminate.decontaminate(odd, bench, text_col="a.b").columns == ["_0", "a.b"]


def test_names_that_clash(spark):
    row = spark.createDataFrame([(1, "mail a.b@example.org", "x", "y")], "doc_id long, text string, spans string, _text string")
    for module in (pii, secrets):
        found = module.find(*([row, pii.Crf()] if module is pii else [row]), keep=("_text", "spans", "doc_id"))
        assert found.columns == ["_text", "doc_id", "spans"] and found.first()["_text"] == "y"
    kept = pii.mask(row, pii.Crf())
    assert kept.columns == row.columns and tuple(kept.first()) == (1, "mail <EMAIL>", "x", "y")
    coded = media.encode(row).selectExpr("doc_id", "media", "'f' as feature", "1 as rgb", "2 as _1")
    assert coded.count() == 1 and media.decode(coded).first()["payload_bytes"] == 64 and media.decode(coded).first()["_1"] == 2
    assert media.decode(spark.createDataFrame([(None,)], "media binary")).first()["rgb"] is None
    import public_tokenizers

    path = str(public_tokenizers.path(VOCABULARY))
    ids = bpe.encode(row, path, public_tokenizers.PATTERN).selectExpr("doc_id", "ids", "'d' as decoded", "3 as `+decoded`")
    assert bytes(bpe.decode(ids, path).first()["decoded"]) == b"mail a.b@example.org"
    with pytest.raises(TypeError):
        bpe.decode(row, path, ids_col="text")


def test_small_blocks_of_words_give_the_same_ids(spark):
    import public_tokenizers

    path = str(public_tokenizers.path(VOCABULARY))
    docs = spark.createDataFrame([(i, " ".join(f"word{k * i % 97}é" for k in range(300))) for i in range(40)], KEPT)
    some = lambda **options: sorted(bpe.encode(docs, path, public_tokenizers.PATTERN, **options).collect())
    assert some() == some(block_bytes=5_000, buckets=3)


def test_long_zero_runs_are_no_error(spark):
    text = "0" * 5000 + ".1.1.1 and 1." + "9" * 6000 + ".1.1"
    got = pii.report(spark.createDataFrame([(1, text)], KEPT)).first()
    assert got["n_ip"] == 1 and got["spans"].startswith("ip:0:5006")


def test_shared_folder_is_never_local_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        shared.shared_folder(Session())


def test_shards_follow_the_law(spark):
    import xxhash

    rows = [(i, f"text {i % 23} " * (i % 7)) for i in range(500)] + [(None, "x"), (7, None)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, KEPT), range_rows=50).collect()
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    key = lambda t: 0 if t is None else signed(xxhash.xxh64(t.encode(), seed=42).intdigest())
    ordered = sorted((key(t), -(1 << 63) if i is None else i, len((t or "").encode()) + 1, i) for i, t in rows)
    total, before, slots, want = sum(r[2] for r in ordered), 0, Counter(), []
    for _, _, size, i in ordered:
        shard = min(7, int((before + size / 2) * 8 // total))
        want.append((i, size, shard, slots[shard]))
        slots[shard] += 1
        before += size
    assert sorted(((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in got), key=repr) == sorted(want, key=repr)


def test_pairs_near_the_threshold_are_found(spark):
    rng, rows, want = random.Random(3), [], {}
    for k in range(150):  # 100 words; 9 or 10 changes apart leave 82 or 80 of 100 two-word shingles, and less for more
        words = [f"p{k}q{i}" for i in range(101)]
        other = list(words)
        for at in rng.sample(range(5, 95, 2), rng.choice((4, 5, 6))):
            other[at] = f"n{k}z{at}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = ({*zip(x, x[1:])} for x in (words, other))
        want[2 * k + 1] = 2 * k if 100 * len(a & b) >= 80 * len(a | b) else 2 * k + 1
    got = {r["doc_id"]: r["component_id"] for r in neardup.group(spark.createDataFrame(rows, KEPT), width=2).collect()}
    assert len(set(got.values())) > 150 and all(got[i] == c for i, c in want.items())


def test_licences_as_files_have_them(spark):
    mit = next(t for k, t in licenses.NOTICES if k == "MIT" and len(t) > 300)
    isc, bsd = next(t for k, t in licenses.NOTICES if k == "ISC"), next(t for k, t in licenses.NOTICES if k == "BSD-3-Clause")

    def wrapped(text, width=72):
        lines, line = [], ""
        for w in text.split():
            if len(line) + len(w) >= width:
                lines, line = [*lines, line], ""
            line = f"{line} {w}".strip()
        return "\n".join([*lines, line])

    texts = [
        "MIT License\n\nCopyright (c) 2020 Some One\n\n" + wrapped(mit), "The MIT License (MIT)\n=====================\n\n" + wrapped(mit.upper(), 60), wrapped(isc, 40), "ISC License\n\nCopyright 2001-2009, A B <a@b.org>\nAll rights reserved.\n\n" + wrapped(isc),
        "Copyright 1999 X\n\n" + "\n\n".join(wrapped(p) for p in bsd.split("\n")), "/* see below */\n\n" + wrapped(mit) + "\n\nint main() {}", "© 2019 me\nnothing else", None, "odd words\nof the caller",
    ]
    got = {r["doc_id"]: r for r in licenses.report(spark.createDataFrame(list(enumerate(texts)), KEPT)).collect()}
    assert [got[i]["license"] for i in range(9)] == ["MIT", "MIT", "ISC", "ISC", "BSD-3-Clause", None, None, None, None]
    assert (got[5]["n_notices"], got[5]["notice_licenses"]) == (1, "MIT")
    own = licenses.known_digests(spark, [("Own", "Odd words!")], ())
    assert licenses.scan(spark.createDataFrame([(1, texts[8])], KEPT), own).first()["notice_licenses"] == "Own"
    blind = own.selectExpr("license", "digest", "cast(null as int) as size")
    assert licenses.scan(spark.createDataFrame([(1, texts[8])], KEPT), blind).first()["notice_licenses"] == "Own"


def test_published_licence_files(spark):
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0"}
    rows = [(k, (folder / f).read_text()) for k, f in enumerate(names) if (folder / f).exists()]
    if not rows:
        pytest.skip("no licence files on this machine")
    got = {r["doc_id"]: r["license"] for r in licenses.report(spark.createDataFrame(rows, KEPT)).collect()}
    assert got == {k: list(names.values())[k] for k, _ in rows}


def test_added_secrets_against_labels():
    rng = random.Random(11)
    value = lambda: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789!%") for _ in range(14))
    true = ['{n}: str = "{v}"', '{n} := "{v}"', 'cfg["{n}"] = "{v}"', "{n}\t= '{v}'", 'base = "{v}"\n{n} = base', '"{n}" : "{v}",', '$c["{n}"] => "{v}"', 'export {n}=r"{v}"', 'a = "{v}"\nb = "{w}"\n{n} = a + b']
    false = ['{n} = load_from_vault("main")', '{n} = os.environ["HOME"]', '{n} = other_variable_name', '{n} = "${{HOME}}"', '{n} = "changeme"', "{n} = None", '{n} = f"{{user}}-{{host}}"', '{n}_count = "12"', '{n}_file = "/etc/a.conf"', 'author = "Jane Q. Public 3rd"', 'keyboard = "dvorak-7"']
    names = ["db_pwd", "privateKey", "auth_credentials", "jwt", "passphrase", "session_cookie_key"]
    right = wrong = missed = 0
    for _ in range(400):
        good = rng.random() < 0.5
        v, w = value(), value()
        text = "import os\n" + rng.choice(true if good else false).format(n=rng.choice(names), v=v, w=w) + "\nprint(1)\n"
        added = {text[a:b] for k, a, b in secrets.spans_of(text) if k == secrets.EXTRA}
        wanted = {x for x in (v, w) if good and x in text}
        right, wrong, missed = right + len(added & wanted), wrong + len(added - wanted), missed + len(wanted - added)
    precision, recall = right / (right + wrong), right / (right + missed)
    assert precision >= 0.95 and recall >= 0.9, (precision, recall)


def test_secrets_in_forms_that_code_has():
    added = lambda t: [t[a:b] for k, a, b in secrets.spans_of(t) if k == secrets.EXTRA]
    one = "Hunter2Secret9"
    for text in [
        f'pwd = """{one}"""', f"pwd = (\n  '{one}'\n)", f'x_credential = get("x") or "{one}"', f'x_credential = cfg.x || "{one}"', f'v = os.getenv("DB_PWD", "{one}")', f"<credential>{one}</credential>",
        f"pwd: |\n  {one}\n", f'pwd = v\nv = "{one}"', f'def h():\n    v = "{one}"\n    pwd = v\n', f'function h() {{\n  const v = "{one}";\n  let pwd = v;\n}}\n', f'pwd = a or b or "{one}"',
    ]:
        assert added(text) == [one], text
    assert added('pwd = "Hunter2" "Secret9"') == added('pwd = (\n "Hunter2"\n + "Secret9")') == ["Hunter2", "Secret9"]
    for text in [
        'encryption_key = "AES-256-GCM"', 'auth_token_type = "Bearer_2A"', f'def g():\n    v = "{one}"\n\ndef h():\n    pwd = v\n', 'signing_key_algorithm = "HS256"', 'pwd = getpass("Pass word 1")', 'pwd = (other_name)', "pwd = a or b",
    ]:
        assert added(text) == [], text
    for odd in ("pwd = " + "(" * 100_000, "pwd = " + "a or " * 50_000, "pwd=f(" * 30_000, 'pwd = """' * 9_999, "<credential>" * 20_000, "def f(\n" * 20_000 + "pwd = x"):
        assert isinstance(secrets.spans_of(odd), list)


def test_added_personal_data_against_labels(spark):
    """Numbers that the patterns find once and miss elsewhere in the document, among numbers that are no personal data."""
    rng, rows, wanted = random.Random(5), [], {}
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    clean = lambda: rng.choice([f"in {rng.randint(1900, 2030)}", f"page {rng.randint(1, 400)}", f"costs ${rng.randint(1, 999)}.{digits(2)}", f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}", f"at {rng.randint(10, 23)}:{rng.randint(10, 59)}", "and some more words", "nothing of note"])
    for i in range(600):
        number = "555" + digits(7)
        bare = rng.choice([number, f"{number[:3]}-{number[3:6]}-{number[6:]}", f"{number[:3]}.{number[3:6]}.{number[6:]}"])
        parts = [f"call +1{number} now", *[clean() for _ in range(rng.randint(3, 9))]]
        wanted[i] = set()
        if i % 2:
            parts.append(f"or {bare} again")
            wanted[i] = {bare}
        rng.shuffle(parts)
        rows.append((i, " ".join(parts)))
    docs = spark.createDataFrame(rows, KEPT)
    right = wrong = missed = 0
    for r in pii.find(docs, pii.fit(docs), keep=("doc_id", "text")).collect():
        added = {r["text"][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == pii.EXTRA}
        right, wrong, missed = right + len(added & wanted[r["doc_id"]]), wrong + len(added - wanted[r["doc_id"]]), missed + len(wanted[r["doc_id"]] - added)
    assert right / max(right + wrong, 1) >= 0.9 and right / (right + missed) >= 0.9, (right, wrong, missed)


def test_label_model_finds_accuracies_and_correlations():
    rng, n = np.random.default_rng(2), 40_000
    toxic = rng.random(n) < 0.1
    hit, false = np.linspace(0.5, 0.9, toxicity.VOTERS), np.linspace(0.02, 0.1, toxicity.VOTERS)
    votes = rng.random((n, toxicity.VOTERS)) < np.where(toxic[:, None], hit, false)
    votes[:, 1] = np.where(rng.random(n) < 0.9, votes[:, 0], votes[:, 1])  # a voter that mostly repeats another
    pattern = votes @ (1 << np.arange(toxicity.VOTERS))
    seen = np.stack([np.bincount(pattern[:400][toxic[:400] == k], minlength=1 << toxicity.VOTERS) for k in (True, False)]).astype(float)
    post, accuracy, corr = toxicity.fit_label_model(np.bincount(pattern, minlength=1 << toxicity.VOTERS).astype(float), seen)
    assert ((post[pattern] > 0.5) == toxic).mean() > 0.98
    assert np.abs(accuracy - (votes == toxic[:, None]).mean(axis=0)).max() < 0.03
    assert corr[0, 1] > 0.7 and np.abs(corr[2:, 2:] - np.eye(toxicity.VOTERS - 2)).max() < 0.1


def test_scores_are_the_classifiers(spark):
    model = toxicity.Model(entries=np.sort(toxicity.features(__import__("pyarrow").array(["vile"]))[1]), voters=np.zeros(1, np.int64), weights=np.array([3.0]), pattern_weights=np.array([1.0, 0.5, 0.25]), bias=-2.0)
    rows = [(1, "a vile thing"), (2, "VILE THINGS!!"), (3, "so vileee"), (4, None), (5, "aaaah"), (6, "vile vile")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, KEPT), model).collect()}
    for i, z in {1: 1.0, 2: -2 + 3 + 1 + 0.5, 3: -2.0, 4: -2.0, 5: -1.75, 6: 1.0}.items():
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z))), i


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


# A plain reader and writer of progressive JPEG, one symbol at a time.


class Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = "".join(f"{b:08b}" for b in data), 0

    def take(self, n):
        self.at += n
        return int(self.bits[self.at - n : self.at] or "0", 2)

    def symbol(self, table):
        code = ""
        while code not in table:
            code += self.bits[self.at]
            self.at += 1
        return table[code]

    def value(self, n):
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def huffman(body):
    table, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(body[length - 1]):
            table[f"{code:0{length}b}"] = body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def read_plainly(image: bytes) -> list[dict]:
    """Coefficients by component and (row, column) of its blocks."""
    at, tables, interval, parts = 2, {}, 0, []
    while image[at + 1] != 0xD9:
        marker, n = image[at + 1], struct.unpack(">H", image[at + 2 : at + 4])[0]
        body, at = image[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xC2:
            high, wide, count = struct.unpack(">HHB", body[1:6])
            parts = [{"h": body[7 + 3 * k] >> 4, "v": body[7 + 3 * k] & 15, "c": {}} for k in range(count)]
            mh, mv = max(p["h"] for p in parts), max(p["v"] for p in parts)
            for p in parts:
                p["mcus"] = -(-wide // (8 * mh)), -(-high // (8 * mv))
                p["used"] = -(-(-(-wide * p["h"] // mh)) // 8), -(-(-(-high * p["v"] // mv)) // 8)
                p["c"] = {(y, x): [0] * 64 for y in range(p["mcus"][1] * p["v"]) for x in range(p["mcus"][0] * p["h"])}
        elif marker == 0xC4:
            while body:
                size = 17 + sum(body[1:17])
                tables[body[0]], body = huffman(body[1:size]), body[size:]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            members, (lo, hi, both) = [(body[1 + 2 * k] - 1, body[2 + 2 * k]) for k in range(body[0])], body[-3:]
            end = at
            while not (image[end] == 0xFF and image[end + 1] != 0 and not 0xD0 <= image[end + 1] <= 0xD7):
                end += 1
            runs, start = [], at
            for k in range(at, end - 1):
                if image[k] == 0xFF and 0xD0 <= image[k + 1] <= 0xD7:
                    runs, start = [*runs, image[start:k]], k + 2
            runs.append(image[start:end])
            if len(members) == 1:
                p = parts[members[0][0]]
                units = [[(0, (y, x))] for y in range(p["used"][1]) for x in range(p["used"][0])]
            else:
                units = [[(i, (my * parts[k]["v"] + y, mx * parts[k]["h"] + x)) for i, (k, _) in enumerate(members) for y in range(parts[k]["v"]) for x in range(parts[k]["h"])] for my in range(parts[0]["mcus"][1]) for mx in range(parts[0]["mcus"][0])]
            step = interval or len(units)
            for r, data in enumerate(runs):
                bits, pred, eob = Bits(data.replace(b"\xff\x00", b"\xff")), [0] * len(members), 0
                for unit in units[r * step : (r + 1) * step]:
                    for i, place in unit:
                        k, t = members[i]
                        c, high, low = parts[k]["c"][place], both >> 4, both & 15
                        if lo == 0 and high:
                            c[0] |= bits.take(1) << low
                        elif lo == 0:
                            pred[i] += bits.value(bits.symbol(tables[t >> 4]))
                            c[0] = pred[i] << low
                        elif not high:
                            eob = first_ac(bits, c, tables[0x10 | t & 15], lo, hi, low, eob)
                        else:
                            eob = refine_ac(bits, c, tables[0x10 | t & 15], lo, hi, low, eob)
            at = end
    return parts


def first_ac(bits, c, table, lo, hi, low, eob):
    k = lo
    if eob:
        return eob - 1
    while k <= hi:
        run, size = divmod(bits.symbol(table), 16)
        if size:
            k += run
            c[k] = bits.value(size) * (1 << low)
        elif run < 15:
            return (1 << run) + bits.take(run) - 1
        else:
            k += 15
        k += 1
    return 0


def refine_ac(bits, c, table, lo, hi, low, eob):
    def correct(k):
        if bits.take(1) and not abs(c[k]) >> low & 1:
            c[k] += (1 << low) if c[k] > 0 else -(1 << low)

    k = lo
    if not eob:
        while k <= hi:
            run, size = divmod(bits.symbol(table), 16)
            new = ((1 << low) if bits.take(1) else -(1 << low)) if size else 0
            if not size and run < 15:
                eob = (1 << run) + bits.take(run)
                break
            while k <= hi:
                if c[k]:
                    correct(k)
                elif run:
                    run -= 1
                else:
                    c[k] = new
                    k += 1
                    break
                k += 1
    if eob:
        for k in range(k, hi + 1):
            if c[k]:
                correct(k)
        eob -= 1
    return eob


def test_a_plain_reader_reads_what_is_written():
    rng = np.random.default_rng(8)
    payloads = [rng.integers(120, 136, 64 * 40, dtype=np.uint8).tobytes(), (np.where(rng.random(64 * 30) < 0.1, rng.integers(0, 256, 64 * 30), 128)).astype(np.uint8).tobytes(), bytes(range(256))]
    for payload, image in zip(payloads, media.encode_payloads(payloads), strict=True):
        blocks = [b for p in read_plainly(image) for _, b in sorted(p["c"].items())]
        assert (np.array(blocks).ravel()[: len(payload)] + 128).astype(np.uint8).tobytes() == payload


def foreign_file(height=21, width=37):
    """4:2:0 with an interleaved DC scan, odd sides, a quantisation table, no restarts and no comment; and its coefficients."""
    rng, segment = random.Random(1), lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    dc = bytes([0, 0, 0, 12] + [0] * 12 + list(range(12)))
    symbols = [s for s in range(256) if s & 15 <= 9]
    ac = bytes([0] * 7 + [len(symbols)] + [0] * 8 + symbols)
    dc_code, ac_code = ({s: code for code, s in huffman(t).items()} for t in (dc, ac))
    across, down = -(-width // 16), -(-height // 16)
    shape = [(2 * down, 2 * across), (down, across), (down, across)]
    blocks = [{(y, x): [rng.randint(-60, 60)] + [rng.choice((0, 0, 0, 1, -2, 7)) for _ in range(63)] for y in range(h) for x in range(w)} for h, w in shape]
    used = [(-(-height // 8), -(-width // 8)), (-(-(-(-height // 2)) // 8), -(-(-(-width // 2)) // 8))]
    for k, part in enumerate(blocks):  # blocks beyond the image have a DC value only
        for (y, x), c in part.items():
            if y >= used[k > 0][0] or x >= used[k > 0][1]:
                c[1:] = [0] * 63

    def number(v):
        n = abs(v).bit_length()
        return n, f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""

    def packed(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    pred, bits = [0, 0, 0], ""
    for my in range(down):
        for mx in range(across):
            for k, (v, h) in enumerate(((2, 2), (1, 1), (1, 1))):
                for y in range(v):
                    for x in range(h):
                        value = blocks[k][my * v + y, mx * h + x][0]
                        n, extra = number(value - pred[k])
                        bits, pred[k] = bits + dc_code[n] + extra, value
    out = b"\xff\xd8" + segment(0xE0, b"any") + segment(0xDB, b"\x00" + bytes(range(1, 65))) + segment(0xC2, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])) + segment(0xC4, b"\x00" + dc + b"\x10" + ac)
    out += segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0])) + packed(bits)
    for k in range(3):
        bits = ""
        for y in range(used[k > 0][0]):
            for x in range(used[k > 0][1]):
                run, c = 0, blocks[k][y, x]
                for v in c[1:]:
                    if not v:
                        run += 1
                        continue
                    while run > 15:
                        bits, run = bits + ac_code[0xF0], run - 16
                    n, extra = number(v)
                    bits, run = bits + ac_code[run << 4 | n] + extra, 0
                if run:
                    bits += ac_code[0]
        out += segment(0xDA, bytes([1, k + 1, 0, 1, 63, 0])) + packed(bits)
    return out + b"\xff\xd9", blocks


def test_files_of_other_writers(spark):
    image, blocks = foreign_file()
    heads, c, rows = media.read_coefficients([image, *media.encode_payloads([bytes(640)])])
    plain = [b for p in read_plainly(image) for _, b in sorted(p["c"].items())]
    assert c[: rows[1]].tolist() == plain == [b for part in blocks for _, b in sorted(part.items())]
    tensor = media.rgb(heads[0], media.samples(heads, c, rows)[: rows[1]])
    assert tensor.shape == (21, 37, 3)
    zigzag = media.ZIGZAG
    wave = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.5) if u == 0 else 1) / 2 for x in range(8)] for u in range(8)])
    planes = []
    for part, (h, w) in zip(blocks, ((4, 6), (2, 3), (2, 3)), strict=True):
        plane = np.zeros((8 * h, 8 * w))
        for (y, x), values in part.items():
            grid = np.zeros(64)
            grid[zigzag] = np.array(values) * np.arange(1, 65)
            plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = wave.T @ grid.reshape(8, 8) @ wave
        planes.append(plane if h == 4 else plane.repeat(2, axis=0).repeat(2, axis=1))
    y, cb, cr = (p[:21, :37] for p in planes)
    want = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2) + 128, 0, 255)
    assert np.abs(tensor - want).max() <= 4
    table = spark.createDataFrame([(bytearray(image),), (None,)], "media binary")
    assert sorted((r["payload"], r["height"], r["width"]) for r in media.decode(table).where("media is not null").collect()) == [(None, 21, 37)]
    with pytest.raises(ValueError):
        media.read_coefficients([image.replace(b"\xff\xc2", b"\xff\xc0")])


def test_crc_of_the_tail(spark):
    got = media.report(spark.createDataFrame([(1, "ab" * 100)], KEPT)).first()
    payload = ("ab" * 100).encode().ljust(256, b"\0")
    assert got["tail_crc32"] == zlib.crc32(payload[-64:]) and got["rgb_bytes"] == 3 * 16 * 16


def test_more_notices_and_short_licenses(spark):
    """Licences as files have them: with title and holder, wrapped, as comments."""
    import textwrap

    texts, wanted = [], []
    for name, text in licenses.NOTICES:
        paragraphs = [textwrap.fill(p, 68) for p in text.split("\n\n")]
        if len(text) > 500 and name in ("0BSD", "Unlicense", "BSL-1.0"):
            title = {"0BSD": "BSD Zero Clause License", "Unlicense": "The Unlicense", "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003"}[name]
            texts.append(f"{title}\n\nCopyright (c) 2020 Some One\n\n" + "\n\n".join(paragraphs) + "\n")
            wanted.append((name, None))
        elif "SPDX" in text or "free software" in text or "Apache" in text:
            texts.append("/*\n" + "\n".join(f" * {x}" for x in paragraphs[0].split("\n")) + "\n *\n * More words.\n */\nint main;\n")
            wanted.append((None, name))
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), licenses.known_digests(spark)).collect()}
    assert len(texts) > 50
    for i, (whole, notice) in enumerate(wanted):
        assert got[i]["license"] == whole and (notice is None or got[i]["notice_licenses"] == notice), (texts[i], got[i])
