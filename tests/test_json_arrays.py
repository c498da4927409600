"""JSON arrays cut into any splits give the rows that the json module gives."""

from __future__ import annotations

import json
import random

import pytest

from peakloom.sources import json_arrays


def things(seed, n):
    r = random.Random(seed)
    odd = ['"', "\\", "}", "{", "[", "]", ",", "\n", "é", "\\\"}", "x", " ", "\U0001f600", '\\\\"']
    word = lambda: "".join(r.choice(odd) for _ in range(r.randint(0, 12)))
    nested = lambda d: {word(): nested(d - 1) for _ in range(r.randint(0, 3))} if d and r.random() < 0.6 else [nested(d - 1) for _ in range(r.randint(0, 2))] if d and r.random() < 0.5 else word()
    return [{"id": i, "name": word(), "more": nested(3)} for i in range(n)]


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def set_to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield set_to
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("size", [37, 400, 10_000_000])
def test_any_split_gives_the_same_objects(spark, tmp_path, small_splits, indent, size):
    files = {"a.json": things(1, 60), "b.json": things(2, 1), "c.json": [], "d.json": things(3, 25)}
    for name, rows in files.items():
        (tmp_path / name).write_text(("﻿ \n" if name == "a.json" else "") + json.dumps(rows, indent=indent, ensure_ascii=name == "a.json") + "\n", encoding="utf-8")
    (tmp_path / "e.json").write_text("")
    small_splits(size)
    found = json_arrays.elements(spark, str(tmp_path))
    got = {}
    for r in found.collect():
        got.setdefault(r.file.rpartition("/")[2], []).append(json.loads(r.value))
    assert {k: sorted(v, key=lambda x: x["id"]) for k, v in got.items()} == {k: v for k, v in files.items() if v}
    if size == 400:
        assert json_arrays._pieces(spark, str(tmp_path)).rdd.getNumPartitions() >= 4


def test_many_splits_without_sending(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(json_arrays, "SENT_SPLITS", 0)
    (tmp_path / "a.json").write_text(json.dumps(things(4, 80)))
    small_splits(211)
    rows = json_arrays.objects(spark, str(tmp_path / "a.json"), "id long, name string").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(x["id"], x["name"]) for x in things(4, 80)]


@pytest.mark.parametrize(("text", "message"), [('[{"a": 1}, {"a": "x', "ends early"), ('[1, {"a": 1}]', "not an array of objects"), ('[{"a": 1}, 2]', "ends early")])
def test_other_files_are_errors(spark, tmp_path, text, message):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match=message):
        json_arrays.elements(spark, str(tmp_path / "a.json")).collect()


def test_splits_come_a_batch_at_a_time():
    """What a split holds is never gathered: its texts are given out with each batch, and only its first says that it begins."""
    import pyarrow as pa

    taken = []

    def batches():
        for names, texts in (([0, 0], ["a", "b"]), ([0, 1], ["c", "d"]), ([1], ["e"])):
            taken.append(len(taken))
            yield pa.RecordBatch.from_pydict({"file": ["f"] * len(names), "split": names, "value": texts})

    found = json_arrays._splits(batches())
    assert next(found) == (("f", 0), True, ["a", "b"]) and taken == [0]
    assert list(found) == [(("f", 0), False, ["c"]), (("f", 1), True, ["d"]), (("f", 1), False, ["e"])]
