"""Every query with SQL against DuckDB on the smallest tables; the others must run and have stable columns."""

import os

import duckdb
import pytest

from clonoframe.plans import registry

DIR = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def norm(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
    fix = lambda x: 0.0 if isinstance(x, float) and x == 0 else x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x
    return [names[i] for i in order], sorted((tuple(fix(r[i]) for i in order) for r in rows), key=key)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    got = norm([tuple(r) for r in df.collect()], df.columns)
    rel = duck.sql(registry.oracle_sql()[name])
    want = norm(rel.fetchall(), rel.columns)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DIR).collect()
