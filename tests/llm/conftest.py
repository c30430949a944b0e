from __future__ import annotations

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def documents(spark):
    """documents frame from (doc_id, text) pairs, with the other columns of the table."""

    def build(pairs):
        rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")

    return build
