from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from commutelens.llm import bpe
from commutelens.llm.queries import op1_bpe
from conftest import SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "\n\n  a", "don't  stop\t\tnow", "<|endoftext|>a<|endoftext|>", "<|endo ftext|>", "日本語 ２０² Ⅷ", "a\x00b\x85 c",
    "-" * 300, "x" * 5000, "ab" * 3000, "été ﬁ ſ 😀​!", " 'S 's'll", "same", "same",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_matches_library_and_round_trips(spark, documents, library):
    docs = documents([*enumerate(ODD), (99, None)]).withColumnRenamed("lang", "decoded_by")
    rows = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    for i, text in enumerate(ODD):
        assert rows[i].token_ids == library.encode(text, add_special_tokens=False).ids
        assert rows[i].decoded == library.decode(rows[i].token_ids, skip_special_tokens=False) == text
        assert rows[i].decoded_by == "en"
    assert rows[99].token_ids == [] and rows[99].decoded == "" and rows[99].text is None


def test_long_texts_are_cut_where_words_start(monkeypatch, library):
    monkeypatch.setattr(bpe, "PIECE_CHARS", 10)
    text = "one two  three\n four-five six's seven eight " * 20
    ids = next(bpe.vocabulary(PATH).encode_all([text]))
    assert memoryview(ids).cast("i").tolist() == library.encode(text, add_special_tokens=False).ids


def test_shared_prefixes_are_branches_of_one_path():
    trie = bpe.Trie()
    trie.insert_sorted([b"an", b"and", b"ant", b"be"])
    assert trie.branches == [(0, b"an"), (2, b"and"), (2, b"ant"), (0, b"be")]


def test_empty_table(documents):
    assert bpe.decode(bpe.encode(documents([]), PATH), PATH).count() == 0


def test_query_over_whole_table(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = op1_bpe(spark, SMALL).collect()
    assert len(got) == len(texts)
    for row in got:
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_a_full_store_keeps_words_in_use(monkeypatch):
    words = bpe.Vocabulary(PATH)
    monkeypatch.setattr(bpe, "WORDS_KEPT", 6)
    first = words.encode_block(["one two three four five"])
    asked, encode = [], words.encode_words
    monkeypatch.setattr(words, "encode_words", lambda fresh: asked.extend(fresh) or encode(fresh))
    assert words.encode_block(["one two six seven"])[0][:8] == first[0][:8]
    assert sorted(asked) == [" seven", " six"] and len(words.known) <= 6 + len(words.special)


def test_a_block_looks_up_its_own_words_only(library):
    class Known(dict):
        def keys(self):
            raise AssertionError("all kept words are listed")

    words, text = bpe.Vocabulary(PATH), "kept words, and some that are not kept"
    words.known = Known(words.encode_words(["kept", " words"]))
    assert memoryview(words.encode_block([text])[0]).cast("i").tolist() == library.encode(text, add_special_tokens=False).ids
