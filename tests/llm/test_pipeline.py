"""The pipeline against brute-force versions of its stages."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from commutelens.llm import secrets
from conftest import SMALL
from llm.test_decontam import brute as leaks
from llm.test_ngram_join import brute as classes


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    frames = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        frames.append((name, docs))
    return {name: {r.doc_id: r for r in frame.collect()} for name, frame in frames}


def test_quality_rejects_junk_only(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = stages["quality_classifier"]
    good = [i for i in labels if labels[i] == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert len(kept) < len(stages["documents"])


def test_one_of_each_group_stays(stages):
    rows = [(i, r.text) for i, r in stages["quality_classifier"].items()]
    assert set(stages["ngram_jaccard_join"]) == {root for _, _, root in classes(rows, 5, 80)}


def test_leaks_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before = stages["ngram_jaccard_join"]
    found = {d for d, _ in leaks([(i, r.text) for i, r in before.items()], items)}
    assert found and set(stages["benchmark_decontamination"]) == set(before) - found


def test_secrets_are_masked(stages):
    before, after = stages["benchmark_decontamination"], stages["secret_scans"]
    assert set(after) == set(before)
    for i, row in after.items():
        assert not secrets.plain(row.text) and row.n_chars == len(row.text)
        assert secrets.plain(before[i].text) or row.text == before[i].text


def test_token_ids_are_those_of_the_library(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after = stages["secret_scans"], stages["bpe_encoding"]
    assert set(after) == set(before)
    for i, row in after.items():
        assert row.token_ids == library.encode(before[i].text, add_special_tokens=False).ids and row.round_trip


def test_run_is_registered_and_gives_the_last_stage(spark, stages):
    rows = contract.queries()["pipeline"](spark, SMALL).collect()
    assert {r.doc_id: r.token_ids for r in rows} == {i: r.token_ids for i, r in stages["bpe_encoding"].items()}


def test_odd_rows_and_empty_tables(spark, documents, tmp_path):
    odd = documents([(1, None), (2, ""), (3, "token=abcdef123"), (3, "token=abcdef123"), (None, "no id"), (4, "x" * 100_000)])
    for name, docs in (("odd", odd), ("empty", odd.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    kept = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 2), (False, 3), (False, 3), (False, 4), (True, 0)]
    assert all(r.round_trip for r in kept)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_stages_ignore_columns_of_other_tables(spark, documents, tmp_path):
    docs = documents([(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, "password=abcdef123")])
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ("kept_id", "found_id", "score", "spans", "token_ids", "decoded", "node", "n", "item_id", "lead", "words", "size", "round_trip")
    clashing = docs.select("*", *[F.lit("x").alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES:
        plain, extra = (stage(spark, frame, str(tmp_path)) for frame in (docs, clashing))
        assert extra.columns == plain.columns
        assert sorted(map(str, extra.collect())) == sorted(map(str, plain.collect()))


def test_registered_names():
    names = contract.queries()
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_classifier"
    assert {f"op{i}_" for i in range(1, 14)} == {n.split("_")[0] + "_" for n in names if n.startswith("op") and n[2].isdigit()}
