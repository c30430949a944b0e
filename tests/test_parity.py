"""Every registered query against its SQL twin, over whole tables of the smallest scale."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
from catalog.oracles import ORACLES
from catalog.queries import QUERIES
from conftest import SMALL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
    "boolean": "BOOLEAN", "int": "INTEGER",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    return con


def rounded(values):
    return tuple(round(v, 5) if isinstance(v, float) else v for v in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_twin(spark, duck, name):
    frame = contract.queries()[name](spark, SMALL)
    got = frame.collect()
    answer = duck.execute(contract.oracle_sql()[name])
    kinds = {d[0]: str(d[1]) for d in answer.description}
    assert {c: TYPES[t] for c, t in frame.dtypes} == kinds
    columns = [d[0] for d in answer.description]
    expected = [rounded(r) for r in answer.fetchall()]
    actual = [rounded(r[c] for c in columns) for r in got]
    assert sorted(actual, key=repr) == sorted(expected, key=repr)


def test_entry_is_not_empty(spark):
    assert contract.entry(spark).count() > 0


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
