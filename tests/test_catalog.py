"""Every query with SQL gives the rows of its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

from peakloom.plans import relations

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(relations.ORACLES))
def test_equals_sql(spark, sf_dir, duck, name):
    frame = relations.QUERIES[name](spark, sf_dir)
    found = duck.execute(relations.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    want = sorted(repr([plain(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in frame.collect()) == want


@pytest.mark.parametrize("name", sorted(set(relations.QUERIES) - set(relations.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert relations.QUERIES[name](spark, sf_dir).count() > 0


def test_approximate_recall(spark):
    sf_dir = "/root/testdata/sf0.01"
    key = lambda r: (r.query_id, r.vec_id)
    exact = {key(r) for r in relations.QUERIES["vec_global_topk"](spark, sf_dir).where("rank <= 5").collect()}
    near = {key(r) for r in relations.QUERIES["vec_ann_probe"](spark, sf_dir).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
