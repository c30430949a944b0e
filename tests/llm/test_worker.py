from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import public_tokenizers

from commutelens.llm import bpe, ngram_join, worker


def test_a_worker_forgets_what_other_operators_kept(monkeypatch):
    """The encoder's words go when the task before had no part in it, and stay from one of its tasks to the next."""
    task = SimpleNamespace(taskAttemptId=lambda: number[0])
    monkeypatch.setattr(worker.TaskContext, "get", classmethod(lambda cls: task))
    path, texts = public_tokenizers.path("byte_bpe_50k.json"), pa.array(["a text of words"])
    kept = lambda: bpe.vocabulary.cache_info().currsize
    number = [1]
    bpe._encode_all(texts, path)
    first = bpe.vocabulary(path)
    for number[0] in (2, 3):
        bpe._encode_all(texts, path)
        assert bpe.vocabulary(path) is first
    number[0] = 4
    list(ngram_join.ngram_sets(["some other text"], 5))
    bpe._encode_all(texts, path)  # both in one task
    number[0] = 5
    list(ngram_join.ngram_sets(["some other text"], 5))
    assert kept()
    number[0] = 6
    list(ngram_join.ngram_sets(["some other text"], 5))
    assert not kept()
    assert bpe._encode_all(texts, path).values.to_pylist()


def test_common_tokens_are_those_that_repeat_in_a_block(spark):
    texts = ["a b c"] * 5 + ["d e f"] * 3 + ["g h i"] + [""] * 2
    params = ngram_join.JoinParams(words=3, cells=1 << 12, block=1 << 10)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    table = ngram_join.common_table(docs, "text", params)
    often = next(ngram_join.ngram_sets(["a b c"], 3))[0] % params.cells
    assert np.flatnonzero(table).tolist() == [often] and table[often] == 3
