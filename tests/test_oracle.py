"""Every registered query against SQL of the same meaning, on whole tables."""

import os

import duckdb
import pytest

from forkline.plans import all_queries, oracles

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def test_every_query_is_checked():
    assert set(all_queries()) == set(oracles())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    result = all_queries()[name](spark, SF)
    relation = duck.execute(oracles()[name])
    columns = [d[0] for d in relation.description]
    assert sorted(result.columns) == sorted(columns)
    ours = as_rows(result.columns, [tuple(r) for r in result.collect()])
    assert ours == as_rows(columns, relation.fetchall())
