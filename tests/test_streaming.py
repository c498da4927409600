from __future__ import annotations

from peakloom.streaming import traces

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def copy(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows.selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(str(tmp_path / "events"))
    return traces.stream(spark, str(tmp_path / "events"), EVENTS), spark.read.parquet(str(tmp_path / "events"))


def test_windows_and_pairs(spark, sf_dir, tmp_path):
    live, done = copy(spark, sf_dir, tmp_path)
    traces.run_once(traces.windows(live), "live_windows", "complete", str(tmp_path / "c1"))
    key = lambda r: (r.start, r.event_type, r.n, round(r.total, 6))
    assert sorted(map(key, spark.table("live_windows").collect())) == sorted(map(key, traces.windows(done).collect()))
    traces.run_once(traces.pairs(live, "user_id", "ts", "event_type", "view", "purchase", "5 hours"), "live_pairs", "append", str(tmp_path / "c2"))
    want = sorted(tuple(r) for r in traces.pairs(done, "user_id", "ts", "event_type", "view", "purchase", "5 hours").collect())
    assert sorted(tuple(r) for r in spark.table("live_pairs").collect()) == want


def test_unique(spark, sf_dir, tmp_path):
    live, done = copy(spark, sf_dir, tmp_path)
    traces.run_once(traces.unique(live, ["event_id"], late="365 days"), "live_unique", "append", str(tmp_path / "c"))
    assert spark.table("live_unique").count() == done.select("event_id").distinct().count() == traces.unique(done, ["event_id"]).count()


def test_session_state(spark, tmp_path):
    rows = [(1, 1, "a", None), (1, 2, None, "x"), (2, 1, None, None), (1, 3, "b", None), (2, 2, "c", "y")]
    schema = "thread long, turn long, asked string, said string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "turns"))
    live = traces.stream(spark, str(tmp_path / "turns"), schema)
    traces.run_once(traces.session_state(live, "thread", ["asked", "said"], "turn"), "live_state", "update", str(tmp_path / "c"))
    want = {tuple(r) for r in traces.latest(spark.createDataFrame(rows, schema), "thread", ["turn"], ["asked", "said"]).collect()}
    assert {tuple(r) for r in spark.table("live_state").collect()} == want == {(1, 3, "b", "x"), (2, 2, "c", "y")}
