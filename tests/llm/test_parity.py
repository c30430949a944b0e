"""Corpus queries against their SQL twins, over whole tables."""

from __future__ import annotations

import duckdb
import pytest

from commutelens.llm.queries import ORACLES, QUERIES
from conftest import SMALL

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_twin(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    frame = QUERIES[name](spark, SMALL)
    answer = con.execute(ORACLES[name])
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == sorted(frame.columns)
    got = [tuple(row[c] for c in columns) for row in frame.collect()]
    assert sorted(got, key=repr) == sorted(answer.fetchall(), key=repr)
