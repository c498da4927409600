"""Batches that fail and come again leave the table that one run leaves."""

from __future__ import annotations

import pytest

from peakloom.streaming import merge, traces

SCHEMA = "k long, name string, at long"


def batches():
    return [[(1, "a", 1), (1, "b", 0), (2, "c", 5)], [(1, "late", -9), (3, "d", 2), (None, "no", 0)], [], [(k, f"x{k}", k) for k in range(2, 200)]]


def rows(spark, path):
    return sorted((r.k, r.name, r.at, r.batch) for r in merge.table(spark, path, SCHEMA).collect())


def want():
    held = {}
    for n, batch in enumerate(batches()):
        first = {}
        for k, name, at in batch:
            if k is not None and (k not in first or at < first[k][1]):
                first[k] = (name, at)
        for k, (name, at) in first.items():
            held.setdefault(k, (k, name, at, n))
    return sorted(held.values())


def test_batches_in_order_and_again(spark, tmp_path):
    path, into = str(tmp_path / "t"), merge.merger(str(tmp_path / "t"), ["k"], ["at"], SCHEMA, buckets=8)
    for n, batch in enumerate(batches()):
        into(spark.createDataFrame(batch, SCHEMA), n)
    assert rows(spark, path) == want()
    for n, batch in enumerate(batches()):
        into(spark.createDataFrame(batch[::-1] + [(999, "new", 0)], SCHEMA), n)
    assert rows(spark, path) == want() and merge.committed(spark, path) == [0, 1, 2, 3]


def test_a_failure_between_rows_and_log(spark, tmp_path):
    path = str(tmp_path / "t")

    def fails(n):
        if n in (0, 3):
            raise OSError("lost")

    for n, batch in enumerate(batches()):
        if n in (0, 3):
            with pytest.raises(OSError):
                merge.merger(path, ["k"], ["at"], SCHEMA, 8, fails)(spark.createDataFrame(batch, SCHEMA), n)
            assert all(r[3] != n for r in rows(spark, path))
        merge.merger(path, ["k"], ["at"], SCHEMA, 8)(spark.createDataFrame(batch, SCHEMA), n)
    assert rows(spark, path) == want()


def test_as_the_sink_of_a_stream(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "t")
    for batch in batches():
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    live = traces.stream(spark, source, SCHEMA, per_trigger=1)
    failed = []

    def once(n):
        if n == 1 and not failed:
            failed.append(n)
            raise OSError("lost")

    for _ in range(2):
        query = live.writeStream.foreachBatch(merge.merger(path, ["k"], ["at"], SCHEMA, 8, once)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception as e:
            assert "lost" in str(e)
    keys = [r[0] for r in rows(spark, path)]
    assert len(keys) == len(set(keys)) and set(keys) == {k for b in batches() for k, *_ in b if k is not None}
