"""Threads as a stream hold what the finished table says, and end when they are idle."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from peakloom.streaming import threads, traces

SCHEMA = "conv_id long, turn long, asked string, said string, text string, at timestamp"


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    threads.prepared(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@pytest.mark.parametrize("most", [12, 8])
def test_threads_equal_the_finished_table(spark, sf_dir, tmp_path, store, most):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    asked, said = (F.when(F.col("role") == r, F.col("text")) for r in ("user", "assistant"))
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), asked.alias("asked"), said.alias("said"), "text", F.timestamp_seconds(1_700_000_000 + F.col("turn") * 10).alias("at"))
    copies = rows.unionByName(rows.where("conv_id % 5 = 0").withColumn("turn", F.col("turn") + 100))  # threads longer than what is kept
    copies = copies.unionByName(rows.where("conv_id % 5 = 0").withColumn("turn", F.col("turn") + 200))
    copies.repartition(3).write.parquet(str(tmp_path / "turns"))
    done = spark.read.schema(SCHEMA).parquet(str(tmp_path / "turns"))
    live = threads.threads(traces.stream(spark, str(tmp_path / "turns"), SCHEMA, per_trigger=1), "conv_id", "at", "turn", ["asked", "said"], "text", most, idle="1 day")
    name = f"live_threads_{most}"
    traces.run_once(live, name, "update", str(tmp_path / "c"))
    got = {}
    for r in spark.table(name).where("NOT closed").collect():
        if r.conv_id not in got or r.turns >= got[r.conv_id].turns:
            got[r.conv_id] = r
    want = {r.conv_id: r for r in traces.latest(done, "conv_id", ["turn"], ["asked", "said"]).collect()}
    assert {k: (r.turns, r.asked, r.said) for k, r in got.items()} == {k: (r.turns, r.asked, r.said) for k, r in want.items()}
    last = {}
    for r in sorted(traces.recent(done, "conv_id", ["turn"], most).collect(), key=lambda r: r.turn):
        last.setdefault(r.conv_id, []).append(r.text)
    assert {k: r.recent for k, r in got.items()} == last and max(map(len, last.values())) == most


def test_idle_threads_end(spark, tmp_path, store):
    time = lambda s: f"2024-01-01 {s}"
    batches = [
        [(1, 1, "a", None, "m1", time("00:00:00")), (1, 2, None, "b", "m2", time("00:05:00")), (2, 1, "x", None, "n1", time("00:06:00"))],
        [(3, 1, None, None, "o1", time("05:00:00"))],
        [(1, 3, "c", None, "m3", time("06:00:00")), (4, 1, None, None, None, time("09:30:00"))],
    ]
    path = str(tmp_path / "in")
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, "conv_id long, turn long, asked string, said string, text string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
        live = threads.threads(traces.stream(spark, path, SCHEMA), "conv_id", "at", "turn", ["asked", "said"], "text", 2, idle="1 hour", late="1 minute")
        query = live.writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    rows = [(r.conv_id, r.turns, r.asked, r.said, r.recent) for r in spark.read.parquet(str(tmp_path / "out")).where("closed").collect()]
    assert [r for r in rows if r[0] < 3 and r[4] != ["m3"]] in ([one, two], [two, one]) if (one := (1, 2, "a", "b", ["m1", "m2"])) and (two := (2, 1, "x", None, ["n1"])) else False
    assert (3, 1, None, None, ["o1"]) in rows
    again = [(r.turns, r.asked, r.said, r.recent) for r in spark.read.parquet(str(tmp_path / "out")).where("conv_id = 1 AND recent = array('m3')").collect()]
    assert (1, "c", None, ["m3"]) in again  # a new thread after the end
