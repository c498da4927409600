from __future__ import annotations

from pyspark.sql import functions as F

from peakloom import engine
from peakloom.functions import shifts, structures
from peakloom.operators import optimise, prep, rerank, retrieval
from peakloom.sources import sinks


def test_registry(spark):
    e = engine.Engine(spark)

    @e.tool("numbers")
    def numbers(session, n: int, h_shifts: list, formula="x"):
        """Some numbers."""
        return session.range(n).withColumn("f", F.lit(formula)).withColumn("k", F.lit(len(h_shifts)))

    assert e.schema()[0]["parameters"] == {"n": {"type": "integer", "required": True}, "h_shifts": {"type": "array", "required": True}, "formula": {"type": "string", "required": False}}
    rows = e.run("numbers", {"formula": "C", "other": 1}, n=2, hnmr=[1, 2]).collect()
    assert [(r.f, r.k) for r in rows] == [("C", 2)] * 2


def test_plans():
    assert engine.planned({"retrieval_top_k": 5}, "need_bigger_pool")["retrieval_top_k"] == 100
    assert engine.planned({}, "need_opt") == {"need_opt_after_generation": True, "save_pool_file": True}
    assert engine.planned({"a": 1}, None) == {"a": 1}
    assert engine.expanded_query("C6H6", [7.2], [128.0]) == "C6H6 13C alkene aromatic vinylic 1H chemical shift integration coupling"
    assert engine.settings("a: 1\nb:\n  c: true\n  d:\n    - x\n    - 2.5\n# no\ne: 'q'") == {"a": 1, "b": {"c": True, "d": ["x", 2.5]}, "e": "q"}

    def bad(q):
        raise OSError("down")

    found, errors = engine.searched("q", [bad, lambda q: [], lambda q: [{"title": "t", "text": "x" * 1000, "url": "u"}]])
    assert errors == ["bad: down"] and len(found[0]["evidence"]) == 900


def test_executed_plan(spark):
    library = spark.createDataFrame([(i, i % 2, [float(i), 1.0]) for i in range(20)], "vec_id long, bucket int, vector array<double>")
    asked = library.where("vec_id = 3").select(F.col("vec_id").alias("query_id"), "bucket", F.col("vector").alias("query"))
    made = spark.createDataFrame([(3, 5, 2.0), (3, 99, 0.1)], "query_id long, vec_id long, score double")
    rows = engine.executed({"use_denovo": True, "retrieval_top_k": 3, "retrieval_mode": "formula_only"}, asked, library, made).collect()
    assert rows[0].vec_id == 5 and rows[0].score == 2.0 and {tuple(r.sources) for r in rows} >= {("denovo",), ("retrieval",)}


def test_memory(spark):
    schema = "formula string, canonical string, created_at string"
    empty = spark.createDataFrame([], f"key string, {schema}")
    one = engine.remembered(empty, spark.createDataFrame([("C", "x", "1"), ("C", "x", "2"), ("N", "x", "1")], schema))
    two = engine.remembered(one, spark.createDataFrame([("C", "x", "0")], schema))
    assert sorted((r.formula, r.created_at) for r in two.collect()) == [("C", "1"), ("N", "1")]


def test_rerank_finds_the_truth(spark):
    h, c = shifts.rule_based(["CC(=O)OCC"])[0]
    asked = spark.createDataFrame([(1, "C4H8O2", h, c)], "query_id int, formula string, asked_h array<double>, asked_c array<double>")
    rows = [(1, s, 0.5, None, None) for s in ("CCC(=O)OC", "C(C)OC(C)=O", "CCO", "bad(", "CCCC(=O)O", "CCOC(=O)C")]
    candidates = spark.createDataFrame(rows, "query_id int, smiles string, score double, h array<double>, c array<double>")
    found = rerank.rerank(asked, candidates, 10).orderBy("rank").collect()
    assert [r.found for r in found] == ["C4H8O2"] * 3
    assert found[0].canonical == structures.canonical("CC(=O)OCC") and found[0].similarity == 1.0 and found[0].c_match.unmatched == []
    assert rerank.bad_peaks(rerank.rerank(asked, candidates, 10).where("rank = 1"), "asked_c", "c_match", 1.0).first().bad == []
    parts = {r.smiles: r.exact for r in rerank.split_by_formula(candidates.where("query_id = 1"), "C2H6O").collect()}
    assert parts["CCO"] and not parts["CCCC(=O)O"] and "bad(" not in parts


def test_crossover(spark):
    pool = spark.createDataFrame([("CCOC(C)=O", 1.0), ("CCCC(=O)OC", 0.9), ("CCCO", 0.5), ("bad(", 0.1)], "smiles string, score double")
    new = optimise.crossover(pool, "C5H10O2", [1.0, 4.1], [14.0, 60.0, 171.0], rounds=2)
    found = [r.smiles for r in new.collect()]
    assert found and len(set(found)) == len(found)
    assert {structures.formula_of(s) for s in found} == {"C5H10O2"} and not {structures.canonical(r.smiles) for r in pool.collect()} & set(found)
    both = optimise.rerank_input(pool, new, 2, 3)
    assert both.count() == both.select("canonical").distinct().count() <= 5
    assert "C(C)N" in {r.smiles for r in optimise.edits(spark.createDataFrame([("CCO",)], "smiles string")).collect()}


def test_loop():
    asked = []

    def act(plan):
        asked.append(plan)
        return len(asked)

    says = iter([{"verdict": "need_bigger_pool"}, {"verdict": "?"}, {"verdict": "accept", "top_candidate": "CO"}])
    out = engine.looped({"retrieval_top_k": 5}, act, lambda r: next(says), most=5)
    assert out == {"verdict": "accept", "answer": "CO", "result": 3, "iteration": 3}
    assert [p["retrieval_top_k"] for p in asked] == [5, 100, 100]
    out = engine.looped({}, act, lambda r: {"verdict": "need_retry", "top_candidate": "C"}, most=2)
    assert (out["verdict"], out["answer"], out["iteration"]) == ("need_retry", None, 2)


def test_tokens_and_pooling(spark):
    vocab = spark.createDataFrame([("<pad>", 0), ("<unk>", 1), ("<bos>", 2), ("<eos>", 3), ("C", 4), ("O", 5)], "token string, id int")
    rows = spark.createDataFrame([(1, ["C", "C", "O"]), (2, ["C", "N"]), (3, []), (4, None)], "k int, w array<string>")
    ids = prep.encoded(rows, "k", "w", vocab)
    assert {r.k: list(r.ids) for r in ids.collect()} == {1: [2, 4, 4, 5, 3], 2: [2, 4, 1, 3], 3: [2, 3], 4: [2, 3]}
    assert {r.k: list(r.ids) for r in prep.encoded(rows, "k", "w", vocab, begin=None, end=None).collect()}[3] == []
    assert {r.k: r.text for r in prep.decoded(ids, "k", "ids", vocab).collect()} == {1: "CCO", 2: "C<unk>", 3: "", 4: ""}
    late = spark.createDataFrame([(1, [4, 3, 5]), (2, [9, 5])], "k int, ids array<int>")
    assert {r.k: r.text for r in prep.decoded(late, "k", "ids", vocab).collect()} == {1: "C", 2: "<unk>O"}
    some = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]], [False, True]), (2, [[1.0, 2.0], [3.0, 4.0]], [False, False]), (3, [[1.0, 2.0]], [True])], "k int, v array<array<double>>, p array<boolean>")
    assert {r.k: r.x for r in some.select("k", prep.pooled(F.col("v"), F.col("p")).alias("x")).collect()} == {1: [1.0, 2.0], 2: [2.0, 3.0], 3: None}


def test_memory_export(spark, tmp_path):
    cases = spark.createDataFrame([(f"k{i}", "C6H6", [7.2]) for i in range(5)], "key string, formula string, h array<double>")
    assert sinks.memory(cases, str(tmp_path / "m"), most=3) == 3
    rows = spark.read.json(str(tmp_path / "m")).orderBy("key").collect()
    assert [(r.namespace, r.key, r.value.formula) for r in rows] == [("confirmed_cases", f"k{i}", "C6H6") for i in range(3)]
    assert sinks.memory(cases.limit(0), str(tmp_path / "none")) == 0


def test_payload_alternatives(spark):
    results = spark.createDataFrame([(1, [1.0, 0.0], v, key, i, s, n) for n, (v, key, i, s) in enumerate([(1, "a", None, 0.5), (2, "gone", 20, 0.9), (3, " ", 99, 0.8), (4, None, None, 0.7), (5, "e", 10, 0.1)], 1)], "query_id int, query array<double>, vec_id int, db_key string, db_id long, vector_score double, vector_rank int")
    payload = spark.createDataFrame([("a", 10, [1.0, 0.0]), ("b", 20, [0.0, 1.0]), ("e", 30, None)], "key string, id long, embedding array<double>")
    rows = retrieval.embedding_reranked(results, payload, 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score, r.fallback) for r in rows] == [(1, 1.0, False), (3, 0.8, True), (4, 0.7, True), (5, 0.1, True), (2, 0.0, False)]
