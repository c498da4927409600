"""Each operator against a plain version, on a fixture with the cases that its docstring defines."""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.llm import bitslices, decontaminate, graph, lattice, licenses, minhash, mixing, repeats, secret_scan, toxicity, warc

SPACED, PLAIN = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, search_ int, gone_ int, score_ int"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def sample(seed=3, n=60):
    """Documents with copies, near copies, shared passages, secrets, licenses and odd texts."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghiklmnoprstuv") for _ in range(r.randint(2, 7))) for _ in range(400)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage, base = text(70), text(90).split()
    out = []
    for i in range(n):
        t = text(r.choice([3, 20, 80, 200]))
        if i % 5 == 0:
            t = text(10) + " " + passage + "\n" + text(r.randint(0, 30))
        if i % 7 == 0:
            near = list(base)
            near[r.randrange(len(near))] = "changed" + str(i)
            t = " ".join(near)
        if i % 11 == 0:
            t += f'\nToken = "{hashlib.sha1(str(i).encode()).hexdigest()}" AKIA{"Z9" * 9} é\U0001f600 password: ab'
        if i % 13 == 0:
            t += "\nReleased under the MIT License. Under the Apache license, and the General Public License!"
        out.append(t)
    out += [out[1], out[2], None, "", " \t\n", "x", "İstanbul     ſecret=abcdefgh", "a" * 3000, "Lic,ense mit license", " ".join(["again"] * 4000)]
    rows = [(i, t, "en", ["a", "b", None, "c"][i % 4], len(t or ""), 0.5, "k", 1, 2, 3) for i, t in enumerate(out)]
    rows += [rows[0], (None, out[3], "en", None, 1, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return sample()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_text(found, column):
    return {r[column]: r for r in found}


# -- 1 ------------------------------------------------------------------------------------------------------------


def plain_secrets(text):
    found = []
    word = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    for m in re.finditer(word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(1)) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found)


def test_secrets(docs, rows):
    found = by_text(secret_scan.scan(docs).collect(), "doc_id")
    assert secret_scan.scan(docs).count() == len(rows)
    names = ("assign", "access", "hex")
    for doc_id, text, *_ in rows:
        plain = plain_secrets(text or "")
        r = found[doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in plain) for x in range(3))
        listed = [f"{names[k]}:{a}:{b}" for a, k, b in plain]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",")) | {""} and [x for x in r.spans.split(",") if not x.startswith("novel")] == (listed or [""] if not r.n_novel else listed)


@pytest.mark.parametrize("text", ["token=token=abcdef", "token = ab", "apikey:abcdef api_key='abcdef", "AKIAAKIA" + "A" * 11, "AKIA" + "B" * 16, "0" * 23 + " " + "a" * 24, "Secret\t=\tabcdef", 'PASSWD" : "x.y/z+w=', "ſecret=abcdef", "toKen=abcdefg"])
def test_secret_patterns(text):
    assert secret_scan.patterns_in(text) == plain_secrets(text)


def test_novel_secrets():
    key = "q8Zr4Lw0Xv7Tn2Yk9Bd5Hc1J"
    text = f"set the auth header {key} and go on"
    assert [(text[a:b]) for a, _, b in secret_scan.novel_in(text, [])] == [key]
    assert secret_scan.novel_in("set the auth header 00000000-0000-0000-0000-000000000000 and go on", []) == []
    assert secret_scan.novel_in(f"a plain word {key}", []) == []


@pytest.mark.parametrize("name", ["AWS_SECRET_ACCESS_KEY=", "export SESSION_KEY=", "credential=", "pwd=", "--set=auth.signature=", "db.pwd=="])
@pytest.mark.parametrize("value", ["wJalrXUtnF3MI/K7MDQNG/bPxRf1CYzTq8v", "9fK3xQ7bLw2ZtR8vYc5NsD1h", "Zk8vQ2xLr9Tn4Wb7Yc1HdA=="])
def test_assigned_secrets(name, value):
    text = f"plain words before\n{name}{value}\nplain words after"
    assert secret_scan.patterns_in(text) == []
    assert [text[a:b] for a, _, b in secret_scan.novel_in(text, [])] == [value]


def test_assigned_in_rows(spark):
    value = "9fK3xQ7bLw2ZtR8vYc5NsD1h"
    docs = spark.createDataFrame([(1, f"SESSION_KEY={value}"), (2, f"colour_name={value}"), (3, "session_start=2020-01-01T00:00:00Z")], "doc_id long, text string")
    assert {r.doc_id: r.strings for r in secret_scan.scan(docs).collect()} == {1: [value], 2: [], 3: []}
    assert {r.doc_id: r.text for r in secret_scan.without_secrets(docs).collect()}[1] == "SESSION_KEY=<secret>"


def test_runs_after_words_stay_whole():
    run = "q8Zr4Lw0Xv7Tn2Yk9Bd5Hc1J=p3Vs6Mf9Gj2Ka8Qe"
    assert [(a, b) for a, _, b in secret_scan.novel_in(f"auth header {run}", [])] == [(12, 12 + len(run))]


def test_novelty_finds_keys_and_leaves_the_rest(spark):
    """Precision and recall over keys and over what stands in the same places without being one."""
    r = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    names = ["session cookie", "auth header", "bearer", "signature", "private key", "credential"]
    plain = ["getSessionCookieValue2", "user_session_timeout_2", "2020-01-01T00:00:00Z", "00000000-0000-0000-0000-000000000000", "abcabcabcabcabcabc123", "version=1.0.0.version=1.0.0", "aaaaaaaaaaaaaaaaaaaa1"]
    rows, keys = [], set()
    for i in range(600):
        key = "".join(r.choice(letters) for _ in range(r.randint(20, 44))) if i % 2 else r.choice(plain)
        keys |= {i} if i % 2 else set()
        rows.append((i, f"call getSessionCookieValue and user_session_timeout with the {r.choice(names)} {key} here"))
    found = {x.doc_id: x.n_novel for x in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    reported = {i for i, n in found.items() if n}
    precision, recall = len(reported & keys) / len(reported), len(reported & keys) / len(keys)
    print(precision, recall)
    assert recall >= 0.99 and precision >= 0.95


def test_identifiers(spark):
    docs = spark.createDataFrame([("getValue my_name my_name x1_y get_value2",), ("my_name __init__ A_b", ), (None,)], "text string")
    assert secret_scan.identifiers(docs) == "getValue A_b my_name"


def test_spans_are_passed_once():
    text = " ".join(f"token={'k' * 8}{i} auth q8Zr4Lw0Xv7Tn2Yk{i:05d}" for i in range(8000))
    base = secret_scan.patterns_in(text)
    began = time.time()
    assert len(base) == 8000 and len(secret_scan.novel_in(text, base, novelty=2.0)) == 0
    assert time.time() - began < 20


def test_without_secrets(docs, rows, none):
    out = secret_scan.without_secrets(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    for r in out.collect():
        assert not plain_secrets(r.text or "") and (r.text is None) == (dict((x[0], x[1]) for x in rows)[r.doc_id] is None)
    assert secret_scan.scan(none).count() == secret_scan.without_secrets(none).count() == 0


# -- 2 ------------------------------------------------------------------------------------------------------------


def plain_license(text):
    w = PLAIN.findall(lower(text or ""))
    starts, labels = [], set()
    for label, phrase in licenses.PHRASES:
        for i in range(len(w) - len(phrase) + 1):
            if tuple(w[i : i + len(phrase)]) == phrase:
                starts.append(i)
                labels.add(label)
    best, step = 0.0, licenses.WIDTH // 2
    base = set(labels)
    for i in range(0, max(1, len(w)), step):
        block = set(w[i : i + licenses.WIDTH])
        for label, notice in licenses.TEMPLATES:
            t = set(notice.split())
            if len(t & block) >= licenses.THRESHOLD * len(t):
                labels.add(label)
                best = max(best, len(t & block) / len(t))
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if starts else best


def test_licenses(spark, docs, rows, none):
    found = by_text(licenses.scan(docs).collect(), "doc_id")
    for doc_id, text, *_ in rows:
        assert tuple(found[doc_id])[1:8] == plain_license(text)
    assert licenses.scan(none).count() == 0
    r = random.Random(5)
    texts = []
    for i in range(60):
        label, notice = r.choice(licenses.TEMPLATES)
        words = notice.split()
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = "other"
        texts.append(" ".join(["filler"] * r.randint(0, 90) + words + ["more"] * r.randint(0, 40)))
    one = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(one).collect():
        assert tuple(r)[1:8] == plain_license(texts[r.doc_id])


def test_license_scan_is_native(docs):
    plan = licenses.scan(docs)._jdf.queryExecution().toString() + mixing.mix(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- 3 ------------------------------------------------------------------------------------------------------------


def test_warc(spark):
    big, same = "<p>é" * 400, "x" * 1000
    pages = [(1, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", same), (8, "u\nv", same), (8, "u", same), (None, "n", same)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    archives = warc.archive(table, frame=2000, bundle=6000)
    found = warc.records(archives).collect()
    assert len(found) == len(pages)
    for r in found:
        options = [(h or "").encode() for p, _, h in pages if p == r.page_id]
        payload = options[0]
        group = [p for p, _, h in pages if (h or "").encode() == payload and p is not None]
        to = max(group) if len(payload) >= 1000 and r.page_id != max(group) else None
        assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(payload), hashlib.sha1(payload).hexdigest(), to)
        assert r.record_type == ("response" if to is None else "revisit")
        assert bytes(r.payload) == (payload if to is None else b"")
    assert max(len(a.archive) for a in archives.collect()) < 20000 and archives.count() > 1
    for a in archives.collect():
        import zstandard

        whole = zstandard.ZstdDecompressor().stream_reader(bytes(a.archive), read_across_frames=True).read()
        assert whole.count(b"WARC/1.1\r\n") == a.records == len(a["index"])
    every = warc.index(archives).collect()
    assert len({x.record_id for x in every}) == len(pages) and sorted(x.page_id or -1 for x in every) == sorted(p or -1 for p, *_ in pages)
    wanted = warc.index(archives).select("record_id").where("page_id IN (1, 7, 8)")
    some = warc.lookup(archives, wanted).collect()
    assert {x.record_id for x in some} == {x.record_id for x in wanted.collect()}
    assert len(some) == 4 and all(x.headers["WARC-Record-ID"] == f"<{x.record_id}>" and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", x.headers["WARC-Date"]) for x in some)
    assert all(bytes(x.body).startswith(b"HTTP/1.1 200 OK\r\n") and int(x.headers["Content-Length"]) == len(x.body) for x in some)
    assert {x.headers["WARC-Refers-To-Target-URI"] for x in some if x.headers["WARC-Type"] == "revisit"} <= {"u", "uv", ""}
    assert warc.records(warc.archive(table.where("false"))).count() == 0


def test_warc_of_one_payload(spark):
    rows = [(i if i % 9 else None, f"u{i}", "same " * 300 if i % 3 else f"{i} " * 400, 1, "x") for i in range(900)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, digest int, payload string").repartition(5)
    found = warc.records(warc.archive(table)).collect()
    first = max(r[0] for r in rows if r[0] is not None and r[2].startswith("same"))
    assert len(found) == 900 and sum(r.record_type == "revisit" for r in found) == sum(r[2].startswith("same") for r in rows) - 1
    assert {r.refers_to for r in found} == {None, first}


def test_warc_files(spark, tmp_path):
    table = spark.createDataFrame([(i, "u", "text" * i) for i in range(20)], "page_id long, url string, html string")
    archives = warc.archive(table, bundle=300)
    sizes = {r.bundle_id: r.bytes for r in warc.export(archives, f"file://{tmp_path}/out").collect()}
    assert {p.name.removesuffix(".warc.zst"): p.stat().st_size for p in (tmp_path / "out").iterdir()} == sizes
    assert sum(1 for p in (tmp_path / "out").iterdir() for _ in warc.Reader(p.read_bytes()).records()) == 20


# -- 4 ------------------------------------------------------------------------------------------------------------


def plain_contamination(text, items):
    w = PLAIN.findall(lower(text or ""))
    hit, names = set(), set()
    for item, t in items:
        v = PLAIN.findall(lower(t or ""))
        m = min(13, len(v))
        for window in {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if m else ():
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) == window:
                    hit |= set(range(i, i + m))
                    names.add("" if item is None else str(item))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark, docs, rows, none):
    texts = dict((x[0], x[1]) for x in rows)
    part = lambda i, a, b: " ".join((texts[i] or "").split()[a:b])
    items = [(1, part(0, 5, 40)), (2, part(5, 12, 30).upper()), (10, part(7, 0, 13)), (3, part(8, 0, 12)), (4, "x"), (5, None), (6, "..."), (7, part(5, 12, 30)), (None, part(9, 0, 20)), (1, part(0, 5, 40)), (8, "again " * 15)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bytes_ in (1 << 20, 100):
        found = by_text(decontaminate.scan(docs, bench, block_bytes=bytes_, longest=True).collect(), "doc_id")
        for doc_id, text, *_ in rows:
            assert tuple(found[doc_id])[1:6] == plain_contamination(text, items)
    r = found[0]
    assert any(m.item == "1" and m.words >= 30 for m in r.longest)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert sorted((x.doc_id or -1, x.text or "") for x in kept.collect()) == sorted((x[0] or -1, x[1] or "") for x in rows if not plain_contamination(x[1], items)[4])
    assert decontaminate.scan(none, bench).count() == 0 and not any(x.contaminated for x in decontaminate.scan(docs, bench.where("false")).collect())


def test_longest_matches():
    r = random.Random(2)
    for _ in range(60):
        items = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 12)))) for i in range(3)]
        texts = [" ".join(r.choice("abcd") for _ in range(r.randint(0, 30))) for _ in range(4)]
        block = decontaminate.Items([(i, t.encode()) for i, t in items], 4)
        for text, found in zip(texts, decontaminate.searched(block, [t.encode() for t in texts], True), strict=True):
            w = text.split()
            for m in found["longest"]:
                v = dict((str(i), t) for i, t in items)[m["item"]].split()
                assert w[m["start"] : m["start"] + m["words"]] == v[m["item_start"] : m["item_start"] + m["words"]] and m["words"] >= min(4, len(v))
            want = set()
            for i, t in items:
                v = t.split()
                m = min(4, len(v))
                if m and any(w[p : p + m] == v[q : q + m] for p in range(len(w) - m + 1) for q in range(len(v) - m + 1)):
                    want.add(str(i))
            assert set(found["items"]) == want and found["n_words"] == len(w)


def test_repeated_words_cost_no_product():
    block = decontaminate.Items([(1, b"x " * 1000)], 13)
    found = decontaminate.searched(block, [b"x " * 20000, b"y " + b"x " * 12], True)
    assert found[0]["ranges"] == [{"begin": 0, "end": 20000}] and found[0]["longest"] == [{"item": "1", "start": 0, "item_start": 0, "words": 1000}] and not found[1]["items"]


# -- 5 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 3000, "query_bytes": 300, "group_bytes": 5000, "batch": 3}])
def test_topk(spark, sizes):
    r = np.random.default_rng(1)
    v = [(i, [float(x) for x in r.normal(0, 0.3, 6).round(1)], 1) for i in range(300)]
    v += [(300 + i, v[4][1], 1) for i in range(40)] + [(400, None, 1), (401, [None, 1.0, 0.0, 0.0, 0.0, 0.0], 1), (402, [math.nan] * 6, 1), (403, [math.inf] * 6, 1), (450, [0.1, 0.2], 1), (451, [0.5, 1.5], 1), (500, [0.0] * 6, 1), (None, [1.0] * 6, 1)]
    table = spark.createDataFrame(v, "vec_id long, embedding array<float>, label int").repartition(3)
    q = {i: [math.floor(256 * float(np.float32(x))) for x in e] for i, e, _ in v if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    found = defaultdict(list)
    for x in bitslices.search(table.where("vec_id % 10 = 0"), table, 5, "vec_id", "embedding", **sizes).orderBy("query_id", "rank").collect():
        found[x.query_id].append((x.vec_id, x.score))
    for i, e in q.items():
        if i % 10 == 0:
            want = sorted(((sum(a * b for a, b in zip(e, o, strict=True)), -j) for j, o in q.items() if j != i and len(o) == len(e)), reverse=True)[:5]
            assert found.pop(i, []) == [(-j, s) for s, j in want]
    assert not found
    assert bitslices.search(table.where("false"), table, 5, "vec_id", "embedding").count() == 0


@pytest.mark.parametrize(("n", "dimensions", "scale"), [(90, 3, 1e6), (90, 3, 1e12), (70, 3000, 1.0)])
def test_topk_of_any_finite_component(spark, n, dimensions, scale):
    r = np.random.default_rng(7)
    v = [(i, [float(x) for x in r.normal(0, 1, dimensions)]) for i in range(n)]
    for i, x in v[:: 4]:
        x[i % dimensions] = scale * (-1 if i % 8 else 1) if i % 10 else 1.0
    table = spark.createDataFrame(v, "vec_id long, embedding array<double>").repartition(3)
    found = defaultdict(list)
    for x in bitslices.search(table.where("vec_id % 10 = 0"), table, 5, "vec_id", "embedding").orderBy("query_id", "rank").collect():
        found[x.query_id].append((x.vec_id, x.score))
    whole = {i: [math.floor(256 * Fraction(x)) for x in e] for i, e in v}
    for i in range(0, n, 10):
        want = sorted(((sum(a * b for a, b in zip(whole[i], whole[j], strict=True)), -j) for j in whole if j != i), reverse=True)[:5]
        assert found[i] == [(-j, s) for s, j in want]


def test_topk_of_small_and_large(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [300000.0, 1.0]), (3, [3.0, 4.0]), (4, [1e300, 0.0]), (5, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    wide = spark.createDataFrame([(10, [0.004, 0.5]), (11, [2e16, 0.0]), (12, [-2e16, 8.0]), (13, [-3.0, 4.0]), (14, [2e16, 1.0])], "vec_id long, embedding array<double>")
    best = bitslices.search(wide.where("vec_id = 10"), wide, 4, "vec_id", "embedding").collect()
    assert [(r.vec_id, r.score) for r in best] == [(14, 256 * 2 * 10**16 + 128 * 256), (11, 256 * 2 * 10**16), (13, -768 + 128 * 1024), (12, -256 * 2 * 10**16 + 128 * 2048)]
    some = bitslices.search(table.where("vec_id = 1"), table.where("vec_id <> 4"), 2, "vec_id", "embedding").collect()
    assert [(r.vec_id, r.score) for r in some] == [(2, 256 * 300000 * 256 + 512 * 256), (3, 256 * 768 + 512 * 1024)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        bitslices.search(table.where("vec_id = 1"), table, 2, "vec_id", "embedding").collect()


# -- 6 ------------------------------------------------------------------------------------------------------------


def test_toxicity(spark, none):
    r = random.Random(2)
    syllables = ["on", "er", "th", "an", "re", "in", "ou", "ha", "le"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    texts, marks = [], []
    for i in range(1200):
        w = [word() for _ in range(r.choice([5, 40, 200]))]
        bad = i % 6 == 0
        for _ in range(max(2, len(w) // 40) if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(["zubok", "Quaxit", "frizmug"]))
        texts.append((i, " ".join(w), "x"))
        marks.append((i, 1, int(bad)))
    docs = spark.createDataFrame([*texts, (5000, None, "x"), (5001, "", "x"), (None, "th on", "x")], "doc_id long, text string, score_ string").repartition(3)
    labels = spark.createDataFrame([*marks, (7, 1, 0), (8, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    scored = toxicity.scan(docs, model).collect()
    bad = {i for i, _, y in marks if y}
    held = [x for x in scored if x.doc_id is not None and x.doc_id < 1200 and zlib.crc32(str(x.doc_id).encode()) % 3 == 1]
    assert len(held) > 300 and sum((x.score >= 0.7) == (x.doc_id in bad) for x in held) >= 0.98 * len(held)
    assert all(0 <= x.score <= 1 for x in scored) and len(scored) == 1203 and all(x.score < 0.7 for x in scored if not x.text)
    clean = toxicity.clean(docs, labels)
    assert clean.columns == docs.columns and clean.count() == sum(x.score < 0.7 for x in scored)
    assert toxicity.scan(docs.withColumnRenamed("score_", "Score"), model).columns == ["doc_id", "text", "score"]
    # The labels of held-out rows change nothing.
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(toxicity.train(docs, other).weights, model.weights)
    assert toxicity.scan(none.select("doc_id", "text"), model).count() == 0
    assert {x.score for x in toxicity.scan(docs, toxicity.train(docs, labels.where("false"))).collect()} == {0.0}


def plain_words(n, toxic):
    r = random.Random(5)
    syllables = ["on", "er", "th", "an", "re", "in", "ou", "ha", "le"]
    free = [i for i in range(2 * n) if zlib.crc32(str(i).encode()) % 3 != 1][:n]
    bad = set(free[:: n // toxic][:toxic])
    return bad, [(i, " ".join("".join(r.choice(syllables) for _ in range(3)) for _ in range(20)) + (" zubok quaxit frizmug zubok quaxit" if i in bad else ""), int(i in bad)) for i in free]


def test_toxicity_counts_all_rows(spark):
    _, rows = plain_words(60, 20)
    rows = [(i, f"{t} {chr(97 + i % 26)}{chr(97 + i // 26)}qz", y) for i, t, y in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.drop("toxic"), docs.drop("text"))
    assert {int(g) for _, t, _ in rows for g in toxicity.grams(toxicity.symbols(t.encode()))} == set(model.keys.tolist())


@pytest.mark.parametrize("toxic", [1, 2, 3, 5])
def test_toxicity_with_rare_labels(spark, toxic):
    bad, rows = plain_words(300, toxic)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.drop("toxic"), docs.drop("text"))
    score = {r.doc_id: r.score for r in toxicity.scan(docs, model).collect()}
    assert model.weights.any() and min(score[i] for i in bad) > max(x for i, x in score.items() if i not in bad)
    marked = {i for i, x in score.items() if x >= toxicity.THRESHOLD}
    assert bad <= marked and len(marked - bad) <= 0.01 * len(rows)


def test_kneser_ney_against_a_plain_one():
    """Both models by the textbook recursion over dictionaries; each context's probabilities sum to 1."""
    r = np.random.default_rng(0)
    texts = {y: [bytes(r.choice(list(b"abc d"), 60).astype(np.uint8)) for _ in range(12)] for y in (0, 1)}
    runs = {y: Counter(g for t in ts for g in set(toxicity.grams(toxicity.symbols(t)).tolist())) for y, ts in texts.items()}
    split = lambda g: tuple(g >> 6 * i & 63 for i in (3, 2, 1, 0))
    seen = {split(g) for y in runs for g in runs[y]}
    kinds = {3: Counter(g[1:] for g in seen)}
    for n in (2, 1):
        kinds[n] = Counter(g[1:] for g in kinds[n + 1])
    d = toxicity.DISCOUNT

    def shared(g):
        n = len(g)
        if n == 1:
            total = sum(kinds[1].values())
            return max(kinds[1][g] - d, 0) / total + d * len(kinds[1]) / total / toxicity.SYMBOLS
        own = {h: c for h, c in kinds[n].items() if h[:-1] == g[:-1]}
        below = shared(g[1:])
        return max(own.get(g, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * below if own else below

    def of_class(y, g):
        own = {split(h): c for h, c in runs[y].items() if split(h)[:-1] == g[:-1]}
        below = shared(g[1:])
        return max(own.get(g, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * below if own else below

    keys = np.array(sorted(set(runs[0]) | set(runs[1])))
    counts = [np.array([runs[y][k] for k in keys.tolist()], float) for y in (0, 1)]
    found = toxicity.differences(keys, *counts)
    want = [math.log(of_class(1, split(k))) - math.log(of_class(0, split(k))) for k in keys.tolist()]
    assert np.allclose(found, want)
    for context in [split(k)[:-1] for k in keys[::7].tolist()]:
        assert all(math.isclose(sum(of_class(y, (*context, s)) for s in range(64)), 1) for y in (0, 1))


def test_kneser_ney_is_a_distribution():
    r = np.random.default_rng(0)
    text = bytes(r.choice(list(b"abcd efg"), 3000).astype(np.uint8))
    keys, n = np.unique(toxicity.grams(toxicity.symbols(text)).astype(np.int64), return_counts=True)
    half = n // 2
    d = toxicity.differences(keys, n.astype(float), half.astype(float))
    assert np.isfinite(d).all()
    assert np.allclose(toxicity.differences(keys, n.astype(float), n.astype(float)), 0)


# -- 7 ------------------------------------------------------------------------------------------------------------


def plain_components(rows, size, similar=(80, 100)):
    sets = []
    for _, text, *_ in rows:
        w = SPACED.findall(lower(text or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] == rows[j][0] and sets[i] == sets[j]
            common = len(sets[i] & sets[j])
            if None not in (rows[i][0], rows[j][0]) and (same or common and common * similar[1] >= similar[0] * len(sets[i] | sets[j])):
                parent[root(i)] = root(j)
    group = defaultdict(list)
    for i in range(len(rows)):
        group[root(i)].append(i)
    return [(rows[i][0], len(sets[i]), None if rows[i][0] is None else min(rows[j][0] for j in group[root(i)])) for i in range(len(rows))]


@pytest.mark.parametrize(("size", "limits"), [(4, {}), (5, {}), (4, {"block": 3}), (4, {"match": 20})])
def test_minhash(docs, rows, size, limits):
    found = minhash.near_duplicates(docs, size=size, **limits).collect()
    some = lambda x: tuple(-1 if y is None else y for y in x)
    assert sorted(some(tuple(r)[:3]) for r in found) == sorted(map(some, plain_components(rows, size)))
    assert all(r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in found)


def test_minhash_near_the_threshold(spark):
    """Sets at 78 to 82 % similarity, in pairs and in one group: recall is 1, whatever the size of the blocks."""
    r = random.Random(9)
    rows = []
    for i in range(300):
        words = [f"{i}w{k}" for k in range(900)]
        # Of 897 shingles of four words, c changed words far from each other take four each: (897 - 4c) / (897 + 4c).
        changed = list(words)
        for k in r.sample(range(10, 890, 10), (23, 24, 25, 26)[i % 4]):
            changed[k] += "x"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed))]
    base = [f"b{k}" for k in range(300)]
    for i in range(150):
        near = list(base)
        for k in r.sample(range(5, 295, 5), r.choice([3, 5, 8, 9])):
            near[k] = f"v{i}x{k}"
        rows.append((1000 + i, " ".join(near)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(plain_components([(i, t) for i, t in rows], 4))
    for block in (minhash.BLOCK, 40):
        assert sorted(tuple(x)[:3] for x in minhash.near_duplicates(docs, size=4, block=block).collect()) == want
    similar = [(897 - 4 * c) / (897 + 4 * c) for c in (23, 24, 25, 26)]
    assert similar[1] > 0.8 > similar[2]


def test_deduplicated(docs, rows, none):
    kept = minhash.deduplicated(docs)
    want = {i for i, _, c in plain_components(rows, 5) if i == c}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want | {None}
    assert minhash.near_duplicates(none).count() == minhash.deduplicated(none).count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(50)] + [(5000, 5001 + i) for i in range(40)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    found = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in {y for a, b in edges if a != b for y in (a, b)}}


# -- 8 ------------------------------------------------------------------------------------------------------------


def test_lattice(docs, rows, none):
    tokens = [[*lower(t or "").encode().split(), "end"] for _, t, *_ in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows]
    counts = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    found = lattice.scan(docs).collect()
    want = sorted((-1 if i is None else i, h, len(t), sum(counts[w] > 0 for w in t), n) for (i, *_), t, h in zip(rows, tokens, held, strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in found) == want
    base = {i: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t) for (i, *_), t in zip(rows, tokens, strict=True)}
    assert all(math.isclose(r.base_score, base[r.doc_id], rel_tol=1e-9) for r in found)
    # The score of a text is that of its words, each summed over all cuts by the plain recursion.
    vocabulary = lattice.Vocabulary()
    weights = defaultdict(float)
    for piece, log in zip(vocabulary.texts, vocabulary.log, strict=False):
        weights[piece] += math.exp(log)

    @functools.cache
    def plain(word):
        parts = [math.log(weights[word[:i]]) + plain(word[i:]) for i in range(1, min(len(word), vocabulary.longest) + 1) if word[:i] in weights]
        return float(np.logaddexp.reduce(parts)) if word else 0.0

    for (i, *_), t in zip(rows, tokens, strict=True):
        if max(map(len, t)) < 500 and i is not None:
            want = (sum(plain(b" " + w) for w in t[:-1]) + vocabulary.log[-1]) / math.log(10)
            assert math.isclose(next(r.score for r in found if r.doc_id == i), want, rel_tol=1e-9)
    assert lattice.scan(none).count() == 0


def test_lattice_sums_over_all_cuts():
    vocabulary = lattice.Vocabulary()
    weights = defaultdict(float)
    for piece, log in zip(vocabulary.texts, vocabulary.log, strict=False):
        weights[piece] += math.exp(log)

    def plain(word):
        return 1.0 if not word else sum(weights[word[:i]] * plain(word[i:]) for i in range(1, len(word) + 1) if weights.get(word[:i]))

    words = [b"the", b"there", b"\xc3\xa9t\xc3\xa9", b"q#z", b"international"[:9], b"a"]
    assert np.allclose(vocabulary.score(words), [math.log(plain(b" " + w)) for w in words])


def test_lattice_of_long_words(monkeypatch):
    vocabulary = lattice.Vocabulary()
    r = random.Random(1)
    words = ["".join(r.choice(["the", "é", "漢字", "tion", "zq", "0"]) for _ in range(k)).encode() for k in (3, 40, 150, 150)]
    want = vocabulary.score(words)
    monkeypatch.setattr(lattice, "LONG", 5)
    monkeypatch.setattr(lattice, "SEGMENT", 37)
    assert np.allclose(vocabulary.score(words), want)


def test_lattice_learns_from_training_texts(spark, monkeypatch):
    r = random.Random(3)
    # Words that the vocabulary doesn't hold whole, in texts of which one in seven is held out; some hold a word of their own, one a long one.
    stock = ["".join(r.choice("bdgklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(2, 5))) for _ in range(200)]
    rows = [(i, " ".join(r.choices(stock, k=80)) + (f" own{i}" if i % 5 == 0 else "")) for i in range(400)]
    rows.append((1000, "q" * 3000))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lattice.scan(docs, fitted=True).collect()
    assert len(found) == 401 and all(math.isfinite(x.score) for x in found)
    held = [(x.score - x.base_score) / x.n_tokens for x in found if x.held_out and x.doc_id < 1000]
    assert len(held) > 30 and min(held) > -0.3
    plain = {x.doc_id: x.score for x in lattice.scan(docs).collect()}
    assert all(x.score > plain[x.doc_id] for x in found if x.doc_id < 1000)
    # The backward recursion of long words gives the same counts as that of short ones.
    vocabulary, words = lattice.Vocabulary(), [b"kalibo", "漢字the".encode() * 9, b""]
    want = vocabulary.expected(words)
    assert math.isclose(want[-1], 1) and math.isclose(sum(n * len(t) for n, t in zip(want, vocabulary.texts, strict=False)), sum(len(w) + 1 for w in words if w))
    monkeypatch.setattr(lattice, "LONG", 5)
    monkeypatch.setattr(lattice, "SEGMENT", 7)
    assert np.allclose(vocabulary.expected(words), want)
    # Without training words the vocabulary's own weights count.
    alone = spark.createDataFrame([(i, "kalibo the") for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert sorted(x.score for x in lattice.scan(alone, fitted=True).collect()) == sorted(x.score for x in lattice.scan(alone).collect())


# -- 9 ------------------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(1, 2, 3), epochs=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(epochs * sizes[s] for s in full)
        share = {s: left * w[s] / sum(w[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s, t in share.items() if t > epochs * sizes[s]}
        if not over:
            return share | {s: float(epochs * sizes[s]) for s in full}
        full |= over


def test_mixing(spark, docs, rows, none):
    sizes = Counter()
    for _, text, _, source, *_ in rows:
        sizes[source] += len(SPACED.findall(text or ""))
    want, taken = plain_targets(sizes), Counter()
    found = mixing.mix(docs, keep=("source",)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.repeats * r.size + r.part_words
        assert r.part_start is None or 0 <= r.part_start <= r.size - r.part_words
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 3 * math.sqrt(len(rows)) for s in want)
    again = mixing.mix(docs.repartition(5), keep=("source",)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found)) and mixing.mix(none).count() == 0
    assert {r.taken for r in mixing.mix(docs.where("text IS NULL OR text = ''")).collect()} == {0}


def test_mixing_of_null_ids(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("word").alias("text"), F.when(F.col("id") < 1000, "a").otherwise("b").alias("source"))
    found = mixing.mix(docs, keep=("source",))
    for r in found.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 150


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 1000, "c": 5, "d": 0, None: 7}, {"x": 10}, {"a": 3, "b": 3, "c": 3}, {chr(97 + i): i * i + 1 for i in range(20)}])
def test_targets(spark, sizes):
    table = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    assert {r.source: pytest.approx(r.target) for r in mixing.targets(table).collect()} == plain_targets(sizes)


# -- 10 -----------------------------------------------------------------------------------------------------------


def plain_repeats(rows, length):
    words = [SPACED.findall(t or "") for _, t, *_ in rows]
    first = {}
    for (i, *_), w in zip(rows, words, strict=True):
        for p in range(len(w) - length + 1):
            if i is not None:
                g = tuple(w[p : p + length])
                first[g] = min(i, first.get(g, i))
    out = []
    for (i, *_), w in zip(rows, words, strict=True):
        gone = set()
        for p in range(len(w) - length + 1):
            if i is not None and first[tuple(w[p : p + length])] < i:
                gone |= set(range(p, p + length))
        out.append((-1 if i is None else i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out)


@pytest.mark.parametrize(("length", "seed"), [(50, 10), (12, 4), (10, 10)])
def test_repeats(docs, rows, none, length, seed):
    found = repeats.deduplicated(docs, length=length, seed=seed).collect()
    want = plain_repeats(rows, length)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == want
    assert all(r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest() for r in found)
    assert length < 50 or any(x[2] for x in want)
    assert repeats.deduplicated(none).count() == 0


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8, 41])
def test_first_least(width):
    v = np.random.default_rng(width).integers(0, 9, 100).astype(np.uint64)
    assert repeats.first_least(v, width).tolist() == [i + int(np.argmin(v[i : i + width])) for i in range(100 - width + 1)]


# -- pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        docs = stage(spark, docs, sf_dir).persist()
        after = {r.doc_id: tuple(r) for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = (before, after)
    before, after = seen["toxicity"]
    assert set(after.values()) <= set(before) and len(after) >= 0.7 * len(before)
    before, after = seen["near_duplicates"]
    assert set(after) == {i for i, _, c in plain_components(before, 5) if i == c}
    before, after = seen["decontamination"]
    assert set(after) == {r[0] for r in before if not plain_contamination(r[1], bench)[4]}
    before, after = seen["secrets"]
    assert set(after) == {r[0] for r in before} and not any(plain_secrets(r[1] or "") for r in after.values())
    assert all(r[4] == len(r[1]) for r in after.values())
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in mix} == set(after) and all(r.taken <= 3 * r.size for r in mix)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(mix)
