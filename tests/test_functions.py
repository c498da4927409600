from __future__ import annotations

import itertools
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peakloom.functions import assignment, spectra, structures, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def array(values):
    return F.array(*[F.lit(float(v)) for v in values]) if values else F.array().cast("array<double>")


H, PH, C, PC = [7.3, 7.2, 2.3], [7.25, 7.1, 2.36], [138, 129, 21], [137.5, 129.4, 128.2, 21.6]


def test_matching_values(spark):
    assert assignment.set_match(np.array(H), np.array(PH), 1.0) == pytest.approx(0.997322, abs=1e-6)
    assert assignment.set_match(np.array(C, float), np.array(PC), 10.0) == pytest.approx(0.864915, abs=1e-6)
    assert assignment.similarity(*map(np.array, (H, [float(x) for x in C], PH, PC))) == pytest.approx(0.931118, abs=1e-6)
    assert assignment.set_match(np.array([0.0, 10]), np.array([10.0, 20]), 1.0) * 2 == pytest.approx(1.0)
    assert assignment.similarity(np.zeros(0), np.zeros(0), np.ones(1), np.ones(1)) == 0
    assert one(spark, spectra.greedy_match(array(H), array(PH), 1.0)) == pytest.approx(0.992384, abs=1e-6)
    assert one(spark, spectra.greedy_match(array(C), array(PC), 10.0)) == pytest.approx(0.749038, abs=1e-6)
    assert one(spark, spectra.greedy_match(array([]), array(PC), 10.0)) == 0
    m = one(spark, spectra.tolerance_match(array(H), array(PH), 0.08))
    assert (m.matched, m.total, m.mean_delta, m.score) == (2, 3, 0.055, 0.5604)
    m = one(spark, spectra.tolerance_match(array(C), array(PC), 2.0))
    assert (m.matched, m.total, m.mean_delta, m.score) == (3, 3, 0.5, 0.925)
    assert one(spark, spectra.tolerance_match(array([]), array(PC), 2.0)).score == 0


def test_vector_values(spark):
    both = lambda h, c: F.concat(spectra.unit(spectra.gaussian_vector(array(h), *spectra.PROTON)), spectra.unit(spectra.gaussian_vector(array(c), *spectra.CARBON)))
    assert one(spark, spectra.dot(both(H, C), both(PH, PC))) == pytest.approx(1.922152, abs=1e-6)
    assert one(spark, spectra.dot(both(H, C), both(H, C))) == pytest.approx(2.0)
    assert one(spark, spectra.dot(both([], []), both(H, C))) == 0


def test_assignment_is_cheapest():
    r, n = np.random.default_rng(1), random.Random(1)
    for _ in range(200):
        a, b = n.randint(1, 4), n.randint(1, 6)
        q, p = r.normal(size=a), r.normal(size=b)
        small, large = (q, p) if a <= b else (p, q)
        best = min(sum(abs(small[i] - large[k[i]]) for i in range(len(small))) for k in itertools.permutations(range(len(large)), len(small)))
        pairs = assignment.ordered_assignment(q, p)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == min(a, b)
        assert sum(abs(q[i] - p[j]) for i, j in pairs) == pytest.approx(best)
        if a <= b:
            cost = r.normal(size=(a, b))
            at = assignment.cheapest(cost)
            assert cost[np.arange(a), at].sum() == pytest.approx(min(sum(cost[i, k[i]] for i in range(a)) for k in itertools.permutations(range(b), a)))
    assert assignment.ordered_assignment(np.zeros(0), np.ones(2)) == []


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("1.11 (dd, J = 6.9, 2.9 Hz, 6H), 3.19-2.98 (m, 2H)", [1.11] * 6 + [3.085] * 2),
        ("7.26 (s); 2.30 (s, 3H)", [7.26, 2.3, 2.3, 2.3]),
        ("1H NMR δ 5.68 (s, 1H)", [5.68]),
        ("", []),
    ],
)
def test_proton_text(spark, given, want):
    assert one(spark, text.proton_shifts(F.lit(given))) == want


def test_text(spark):
    assert one(spark, text.numeric_shifts(F.lit("5.68 3.19-2.98"))) == [5.68, 3.19, -2.98]
    assert one(spark, text.range_ends(F.lit("5.68 3.19-2.98"))) == [5.68, 3.19, 2.98]
    assert one(spark, text.carbon_shifts(F.lit("138.0, 125.3, 101.25, 21.0"))) == [138.0, 125.3, 101.25, 21.0]
    assert one(spark, text.carbon_shifts(F.lit("13C NMR (101 MHz, CDCl3) δ 138.0, 21.0"))) == [138.0, 21.0]
    assert one(spark, text.labelled_formula(F.lit("Formula: C20H30O3, and C6H6"))) == "C20H30O3"
    assert one(spark, text.answer(F.lit("so <answer> CCO </answer>"))) == "CCO"
    assert one(spark, text.answer(F.lit("Answer: unknown"))) is None
    assert one(spark, text.embedded_json(F.lit('see {"a": 1} there'))) == '{"a": 1}'
    assert one(spark, text.embedded_json(F.lit("see {a there"))) is None
    assert one(spark, text.structures_in(F.lit('[{"smiles": "CCO"}, {"smiles":"C"}, {"smiles":"CCO"}]'))) == ["CCO", "C"]
    call = one(spark, text.tool_call(F.lit('<tool_call>{"name": "find", "arguments": {"k": 1}}</tool_call>')))
    assert (call.action, call.arguments) == ("find", '{"k":1}')
    assert one(spark, text.compact_id(F.lit(" a b/c_ "))) == "a_b_c" and one(spark, text.compact_id(F.lit("//"))) is None
    assert one(spark, text.split_pipe(F.lit(" a | |b"))) == ["a", "b"]
    assert one(spark, text.masked(F.lit("0123456789"))) == "0123...6789"
    assert one(spark, text.versioned_url(F.lit("http://x/"))) == one(spark, text.versioned_url(F.lit("http://x/v1"))) == "http://x/v1"
    assert one(spark, text.structure_tokens(F.lit("C[C@H](Cl)Br%10"))) == ["C", "[C@H]", "(", "Cl", ")", "Br", "%10"]
    assert one(spark, text.number(F.lit("x"))) is None and one(spark, text.number(F.lit(" 2.5 "))) == 2.5


def test_formulas(spark):
    counts = lambda s: spectra.formula_counts(F.lit(s))
    assert one(spark, counts("C20H30O3")) == {"C": 20, "H": 30, "O": 3}
    assert one(spark, counts("CH3CH2Cl")) == {"C": 2, "H": 5, "Cl": 1}
    assert one(spark, spectra.formula_text(F.create_map(F.lit("H"), F.lit(4), F.lit("C"), F.lit(2), F.lit("O"), F.lit(1)))) == "C2H4O"
    assert one(spark, spectra.formula_text(spectra.formula_sum(counts("C2H"), counts("H3O")))) == "C2H4O"
    assert one(spark, spectra.formula_difference(counts("C2H6"), counts("CH6O"))) == {"C": 1, "O": -1}
    assert one(spark, spectra.fits_within(counts("CH3"), counts("C2H6"))) and not one(spark, spectra.fits_within(counts("CN"), counts("C2H6")))
    assert sorted(map(tuple, one(spark, spectra.wildcard_masks(F.array(F.lit("C"), F.lit("N")))))) == [("*", "*"), ("*", "N"), ("C", "*"), ("C", "N")]


@pytest.mark.parametrize("same", [("CCO", "OCC", "C(O)C"), ("CC(=O)Oc1ccccc1C(=O)O", "O=C(O)c1ccccc1OC(C)=O"), ("c1ccncc1", "n1ccccc1"), ("C1CC1C", "CC1CC1"), ("[Na+].[Cl-]", "[Cl-].[Na+]")])
def test_canonical(same):
    forms = {structures.canonical(s) for s in same}
    assert len(forms) == 1 and structures.canonical(forms.pop()) == structures.canonical(same[0])


def test_structures():
    case = "CC(C)C(=O)CC12CCC3C(C)(C)CCCC3(C)C1=CC(=O)O2"
    assert structures.formula_of(case) == structures.formula_of(structures.canonical(case)) == "C20H30O3"
    assert structures.formula_of("c1cc[nH]c1") == "C4H5N" and structures.formula_of("CS(=O)(=O)C") == "C2H6O2S"
    assert [structures.canonical(x) for x in ("C(", "C1CC", "", None, "Xx", "C)")] == [None] * 6
    assert structures.parse("C1CCCCC1C1CCCCCCC1").largest_ring() == 8 and structures.parse("CC").largest_ring() == 0
    for cut in structures.cuts("CC(=O)OCC"):
        others = [c for c in structures.cuts("CC(=O)OCC") if c["ends"] == cut["partners"] and c["partners"] == cut["ends"]]
        assert any(structures.canonical("CC(=O)OCC") in structures.stitch(cut["fragment"], o["fragment"]) for o in others)
    assert structures.cuts("C1CC1") == [] and len(structures.cuts("C1CCC1", rings=True)) == 12
    assert structures.without_atom("CCO", 1) == "C" and structures.with_element("CCO", 2, "N") == structures.canonical("CCN") and structures.with_element("C(C)(C)C", 0, "F") is None


def test_structure_functions(spark):
    rows = spark.createDataFrame([("CCO",), ("bad(",), (None,)], "s string")
    found = rows.select(structures.canonical_udf("s"), structures.formula_udf("s"), F.size(structures.cuts_udf("s"))).collect()
    assert [tuple(r) for r in found] == [(structures.canonical("CCO"), "C2H6O", 4), (None, None, 0), (None, None, 0)]
    a = spark.createDataFrame([([1.0, 5.0], [5.5]), ([], [1.0])], "q array<double>, p array<double>").select(assignment.assignment_udf("q", "p").alias("a")).select("a.*").collect()
    assert a[0].matched[0].query == 1 and a[0].unmatched == [0] and a[0].unused == [] and a[1].unused == [0] and math.isclose(a[0].cost, 0.5)


def test_matches_of_many_rows_at_once():
    """As one by one: empty and null lists, equal peaks, sets above and below the size that the table over subsets takes."""
    r = random.Random(4)
    some = lambda: None if r.random() < 0.05 else [round(r.uniform(0, 50)) / 2 for _ in range(r.choice([0, 1, 2, 3, 6, 7, 8, 10]))]
    left, right = ([some() for _ in range(600)] for _ in range(2))
    kind = pa.list_(pa.float64())
    found = assignment.set_matches(pa.array(left, kind)[7:], pa.array(right, kind)[7:], 3.0)
    assert found == pytest.approx([assignment.set_match(np.array(a or [], float), np.array(b or [], float), 3.0) for a, b in zip(left[7:], right[7:], strict=True)], abs=1e-12)
    wide = pa.array([[float((7 * i + j) % 50) for j in range(6)] for i in range(20_000)], kind)
    began = time.process_time()
    assert len(assignment.set_matches(wide, wide[::-1], 3.0)) == 20_000
    assert time.process_time() - began < 2  # one by one: over 4 s


def test_gaussian_bins_are_those_of_the_vector(spark):
    rows = spark.createDataFrame([(1, [20.0, 21.5, 180.0]), (2, []), (3, None), (4, [None, 500.0]), (5, [0.0])], "id long, c array<double>")
    both = rows.select("id", spectra.gaussian_vector(F.col("c"), *spectra.CARBON).alias("v"), spectra.gaussian_bins(F.col("c"), *spectra.CARBON, 4e-7).alias("b")).collect()
    assert {r.id: [(x.pos, x.x) for x in r.b] for r in both} == {r.id: [(i, x) for i, x in enumerate(r.v) if x >= 4e-7] for r in both}
    assert 20 < len(both[0].b) < 40


def test_a_small_vocabulary_shuffles_no_token(spark, monkeypatch):
    from peakloom.operators import prep

    rows = spark.createDataFrame([(1, ["b", "x", "a", "b"]), (2, []), (3, None), (4, [None, "a"])], "k long, w array<string>").repartition(2)
    vocab = spark.createDataFrame([("a", 4), ("b", 5)], "token string, id int")
    want = {1: [2, 5, 1, 4, 5, 3], 2: [2, 3], 3: [2, 3], 4: [2, 1, 4, 3]}
    found = prep.encoded(rows, "k", "w", vocab)
    assert {r.k: r.ids for r in found.collect()} == want and "Join" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(prep, "SENT_BYTES", 0)
    assert {r.k: r.ids for r in prep.encoded(rows, "k", "w", vocab).collect()} == want
