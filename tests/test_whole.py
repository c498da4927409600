"""Queries over all rows of their tables, against plain Python."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from peakloom.functions import assignment
from peakloom.functions import spectra as S
from peakloom.plans import catalog


def rows_of(spark, sf_dir, name):
    return catalog.QUERIES[name](spark, sf_dir).collect()


@pytest.fixture(scope="module")
def spectra(spark, sf_dir):
    """id: (h, c) of every order."""
    found = defaultdict(lambda: ([], []))
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_returnflag", "l_quantity").collect():
        found[r.l_orderkey][r.l_returnflag != "R"].append(float(r.l_quantity))
    return {k: (sorted(h), sorted(c)) for k, (h, c) in found.items()}


def gaussian(peaks, low, high, width, bins=128):
    step = (high - low) / (bins - 1)
    return [sum(step / (math.sqrt(2 * math.pi) * width) * math.exp(-0.5 * ((p - low - i * step) / width) ** 2) for p in peaks) for i in range(bins)]


def greedy(query, candidate, width):
    left, total = list(candidate), 0.0
    for q in query:
        if left:
            near = min(left, key=lambda p: (abs(p - q), p))
            left.remove(near)
            total += math.exp(-((near - q) ** 2) / (2 * width * width))
    return total / max(len(query), len(candidate)) if query and candidate else 0.0


def tolerance(query, memory, most):
    """(matched, score)"""
    left, deltas = dict(enumerate(memory)), []
    for q in query:
        near = [(abs(p - q), -i) for i, p in left.items() if abs(p - q) <= most]
        if near:
            d, i = min(near)
            deltas.append(d)
            del left[-i]
    score = 0.7 * len(deltas) / max(len(query), 1) + (0.3 * max(0.0, 1 - sum(deltas) / len(deltas) / most) if deltas else 0.0)
    return len(deltas), score


def test_gaussian_vector_whole(spark, sf_dir, spectra):
    found = defaultdict(dict)
    for r in rows_of(spark, sf_dir, "spec_gaussian_vector"):
        found[r.id][r.pos] = r.value
    assert set(found) == {k for k, (_, c) in spectra.items() if c}
    for k, v in found.items():
        want = gaussian(spectra[k][1], *S.CARBON)
        assert all(abs(v.get(i, 0) - x) < 2e-6 for i, x in enumerate(want))


def test_vector_rerank_whole(spark, sf_dir, spectra):
    unit = {}
    for k, (_, c) in spectra.items():
        v = gaussian(c, *S.CARBON)
        n = math.sqrt(sum(x * x for x in v))
        unit[k] = [x / n for x in v] if n else v
    found = defaultdict(list)
    for r in sorted(rows_of(spark, sf_dir, "spec_vector_rerank"), key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) == {k for k in spectra if k % 100 == 0}
    for q, got in found.items():
        score = {k: sum(a * b for a, b in zip(unit[q], v, strict=True)) if spectra[k][1] else 0.5 for k, v in unit.items() if k != q}
        best = sorted(score.values(), reverse=True)[:10]
        assert [s for _, s in got] == pytest.approx(best, abs=2e-6)
        assert all(abs(score[k] - s) < 2e-6 for k, s in got) and len({k for k, _ in got}) == 10


def test_greedy_match_whole(spark, sf_dir, spectra):
    found = {r.id: r.score for r in rows_of(spark, sf_dir, "spec_greedy_match")}
    assert found == pytest.approx({k: greedy(h, c, 10.0) for k, (h, c) in spectra.items()}, abs=2e-6)


def test_similarity_of_all(spark, sf_dir, spectra):
    import numpy as np

    found = {r.id: r.score for r in rows_of(spark, sf_dir, "spec_similarity")}
    arrays = {k: [np.array(x, float) for x in (h, c, [p + 0.5 for p in h], [p - 1 for p in c])] for k, (h, c) in spectra.items()}
    assert found == pytest.approx({k: assignment.similarity(*x) for k, x in arrays.items()}, abs=2e-6)


def test_memory_of_all(spark, sf_dir, spectra):
    found = defaultdict(list)
    for r in sorted(rows_of(spark, sf_dir, "memory_recall"), key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.key, r.score))
    assert set(found) == {k for k in spectra if k % 100 == 0}
    for q, got in found.items():
        (h, c), score = spectra[q], {}
        for k, (other_h, other_c) in spectra.items():
            score[k] = 0.15 * (q % 7 == k % 7) + 0.35 * round(tolerance(h, other_h, 0.08)[1], 4) + 0.5 * round(tolerance(c, other_c, 2.0)[1], 4)
        assert [s for _, s in got] == pytest.approx(sorted(score.values(), reverse=True)[:5], abs=2e-4)
        assert all(abs(score[k] - s) < 2e-4 for k, s in got)


def test_flatten_whole(spark, sf_dir, spectra):
    found = {(r.id, r.pos): (r.shift, r.kind) for r in rows_of(spark, sf_dir, "spectrum_flatten")}
    assert found == {(k, i): p for k, (h, c) in spectra.items() for i, p in enumerate([(x, 0) for x in h] + [(x, 1) for x in c])}


@pytest.fixture(scope="module")
def parts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").collect()


def with_later_keys(spark, parts, folder):
    """A folder whose part table has the same parts, and each again with a key later than 300."""
    frame = spark.createDataFrame(parts)
    frame.unionByName(frame.withColumn("p_partkey", frame.p_partkey + 1000)).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_sum_pairs_whole(spark, parts, tmp_path):
    folder = with_later_keys(spark, parts, tmp_path)
    counts = {k: (1 + p.p_size % 9, 2 + k % 11, max(k % 3, 1)) for p in parts for k in (p.p_partkey, p.p_partkey + 1000)}
    want = {(a, b) for a, x in counts.items() for b, y in counts.items() if a < b and tuple(i + j for i, j in zip(x, y, strict=True)) == (10, 16, 3)}
    got = [(r.left_id, r.right_id) for r in rows_of(spark, folder, "formula_sum_pairs")]
    assert sorted(got) == sorted(want) and any(b > 300 for _, b in want)


def test_mask_join_whole(spark, sf_dir, parts):
    own, asked, held = "CNO", {}, defaultdict(set)
    for p in parts:
        k, size = p.p_partkey, p.p_size
        ends, partners = (own[k % 3], own[size % 3]), (own[(k + size) % 3], "CO"[k % 2])
        asked[k] = (p.p_brand, *(o if e == "C" else "*" for e, o in zip(ends, partners, strict=True)))
        for m in ((ends[0], ends[1]), ("*", ends[1]), (ends[0], "*"), ("*", "*")):
            held[(p.p_brand, *m)].add(k)
    want = {(q, k) for q, m in asked.items() for k in held[m] if q != k}
    got = [(r.query_id, r.key_id) for r in rows_of(spark, sf_dir, "frag_mask_join")]
    assert sorted(got) == sorted(want) and any(q % 5 or k % 5 for q, k in want)


def sums(sizes, total, least, most):
    return {c for n in range(least, most + 1) for c in itertools.combinations_with_replacement(sorted(sizes), n) if sum(c) == total}


def test_subset_sums_whole(spark, sf_dir, parts):
    best = defaultdict(float)
    for p in parts:
        best[p.p_size] = max(best[p.p_size], float(p.p_retailprice))
    want = {",".join(map(str, c)): sum(best[k] for k in c) for c in sums([k for k in best if k < 20], 20, 2, 4)}
    assert {r["keys"]: r.score for r in rows_of(spark, sf_dir, "subset_sum_combos")} == pytest.approx(want) and any("13" in k for k in want)


def test_choices_of_all_sizes(spark, sf_dir, parts):
    of = {p.p_partkey: p for p in parts}
    found = rows_of(spark, sf_dir, "subset_sum_choices")
    for r in found:
        sizes = [int(k) for k in r.combo.split("-")]
        assert [of[m].p_size for m in r.members] == sizes and sum(sizes) == 20
        assert len({of[m].p_brand for m in r.members}) == len(r.members)
    assert any(int(k) > 12 for r in found for k in r.combo.split("-"))


def matchings(a, b):
    """Every one-to-one matching of the smaller set into the larger, as pairs of places."""
    if len(a) <= len(b):
        return [list(enumerate(p)) for p in itertools.permutations(range(len(b)), len(a))]
    return [[(i, j) for j, i in pairs] for pairs in matchings(b, a)]


def test_set_match_whole(spark, sf_dir, spectra):
    found = {r.id: r.score for r in rows_of(spark, sf_dir, "spec_set_match")}
    gain = lambda h, c: max(sum(math.exp(-((h[i] - c[j]) ** 2) / 200) for i, j in m) for m in matchings(h, c))
    assert found == pytest.approx({k: gain(h, c) / math.sqrt(len(h) * len(c)) if h and c else 0.0 for k, (h, c) in spectra.items()}, abs=2e-6)


def test_assign_cost_whole(spark, sf_dir, spectra):
    found = {r.id: r for r in rows_of(spark, sf_dir, "spec_assignment")}
    assert set(found) == set(spectra)
    for k, (h, c) in spectra.items():
        r = found[k]
        pairs = [(m["query"], m["predicted"]) for m in r.matched]
        assert r.cost == pytest.approx(min(sum(abs(h[i] - c[j]) for i, j in m) for m in matchings(h, c)), abs=2e-6)
        assert r.cost == pytest.approx(sum(abs(h[i] - c[j]) for i, j in pairs), abs=2e-6) and len(pairs) == min(len(h), len(c))
        assert sorted([i for i, _ in pairs] + r.unmatched) == list(range(len(h))) and sorted([j for _, j in pairs] + r.unused) == list(range(len(c)))


def test_tolerance_whole(spark, sf_dir, spectra):
    found = {r.id: (r.matched, r.total, r.score) for r in rows_of(spark, sf_dir, "spec_tolerance")}
    assert set(found) == set(spectra)
    for k, (h, c) in spectra.items():
        matched, score = tolerance(h, c, 2.0)
        assert found[k][:2] == (matched, len(h)) and found[k][2] == pytest.approx(score, abs=6e-5)


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def test_bm25_batch_whole(spark, sf_dir):
    docs = {d.doc_id: Counter(words(d.text)) for d in read(spark, sf_dir, "documents")}
    df, size = Counter(w for c in docs.values() for w in c), {k: sum(c.values()) for k, c in docs.items()}
    mean, n = sum(size.values()) / len(docs), len(docs)
    found = defaultdict(list)
    for r in sorted(rows_of(spark, sf_dir, "bm25_batch"), key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.doc_id, r.score))
    items = read(spark, sf_dir, "benchmark")
    assert any(len(i.text) > 80 for i in items)
    for i in items:
        scores = defaultdict(float)
        for w in list(dict.fromkeys(words(i.text)))[:1000]:
            idf = max(math.log((n - df[w] + 0.5) / (df[w] + 0.5)), 0) or 1e-6
            for k, c in docs.items():
                if c[w]:
                    scores[k] += idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[k] / mean))
        assert [s for _, s in found[i.item_id]] == pytest.approx(sorted(scores.values(), reverse=True)[:5], abs=2e-6)
        assert all(scores[k] == pytest.approx(s, abs=2e-6) for k, s in found[i.item_id])


def test_session_texts_whole(spark, sf_dir):
    threads = defaultdict(list)
    for r in read(spark, sf_dir, "conversations"):
        threads[r.conv_id].append(r)
    state, last = {}, {}
    for k, turns in threads.items():
        held = {"user": None, "assistant": None}
        for r in sorted(turns, key=lambda r: r.turn):
            if r.text is not None:
                held[r.role] = r.text
            state[k, r.turn] = held["user"], held["assistant"]
        last[k] = len(turns), held["user"], held["assistant"]
    assert any(len(x or "") > 20 for v in state.values() for x in v)
    assert {(r.conv_id, r.turn): (r.asked, r.said) for r in rows_of(spark, sf_dir, "session_state")} == state
    assert {r.conv_id: (r.turns, r.asked, r.said) for r in rows_of(spark, sf_dir, "session_latest")} == last


def test_tanimoto_whole(spark, sf_dir):
    bits = {r.vec_id: {i for i, x in enumerate(r.embedding) if x > 0} for r in read(spark, sf_dir, "embeddings")}
    pairs = {(q, k): (len(a & b), len(a | b)) for q, a in bits.items() if q % 100 == 0 for k, b in bits.items() if k != q}
    want = {p: both / either for p, (both, either) in pairs.items() if either and 2 * both >= either}
    assert {(r.query_id, r.vec_id): r.tanimoto for r in rows_of(spark, sf_dir, "vec_tanimoto")} == pytest.approx(want, abs=2e-6)
    assert any(i >= 32 for b in bits.values() for i in b)


def test_products_in_blocks(spark, monkeypatch):
    """The queries as one matrix or in blocks: the same rows, ties to the smaller id, a query's own row left out."""
    from peakloom.operators import retrieval

    vectors = [(i, [float(i % 3), float(i % 2), 0.25 * (i % 5)], i % 7 != 0) for i in range(60)]
    rows = spark.createDataFrame(vectors, "vec_id long, vector array<double>, has boolean")
    asked = rows.where("vec_id % 9 = 0").selectExpr("vec_id AS query_id", "vector AS query")
    one = {tuple(r) for r in retrieval.product_topk(asked, rows, 0.5, 4).collect()}
    monkeypatch.setattr(retrieval, "SENT_BYTES", 1)
    assert {tuple(r) for r in retrieval.product_topk(asked, rows, 0.5, 4).collect()} == one and len(one) == 7 * 4
    assert retrieval.product_topk(asked.limit(0), rows, 0.5, 4).count() == 0


def test_cases_of_equal_peaks_are_matched_once(spark, monkeypatch):
    """Copies, formulas of queries and none, null peaks: the ranks are those of all cases, and only distinct ones are matched."""
    from peakloom import session
    from peakloom.operators import retrieval

    counts = []

    def counted(rows):
        counts.append(session.stored(rows))
        return counts[-1]

    monkeypatch.setattr(retrieval, "stored", counted)
    peaks = [([1.0, 7.0], [20.0, 31.5]), ([1.0], [20.5, 33.0, 40.0]), ([], [21.0]), (None, [31.0]), ([7.05], None)]
    cases = [(i, ["a", "b", None][i // 5 % 3], *peaks[i % 5]) for i in range(900)]
    asked = [(i, ["a", None, "z", "b"][i % 4], *peaks[i % 5]) for i in range(8)]
    memory = spark.createDataFrame(cases, "key long, formula string, h array<double>, c array<double>").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, asked_formula string, asked_h array<double>, asked_c array<double>")
    one = lambda x, m, t: round(float(retrieval._tolerated(np.array(x or [], float), np.array([m or [np.nan]], float), t)[0]), 4)
    want = set()
    for q, formula, h, c in asked:
        rows = sorted((-round((0.15 if formula is not None and f == formula else 0.0) + 0.35 * one(h, a, 0.08) + 0.5 * one(c, b, 2.0), 6), key) for key, f, a, b in cases)
        want |= {(q, key, -s, n) for n, (s, key) in enumerate(rows[:7], 1)}
    assert {(x.query_id, x.key, x.score, x["rank"]) for x in retrieval.recalled(queries, memory, 7).collect()} == want
    assert counts[1].count() == 15  # five peak sets, for two formulas and for all
