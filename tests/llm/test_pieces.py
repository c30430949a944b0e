from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from commutelens.llm import pieces
from commutelens.llm.queries import op13_sentencepiece
from conftest import SMALL

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "   ", "\n\n  a", "don't  stop\t\tnow", "<s>a</s><unk><0x0A>", "日本語 ２０² Ⅷ ².", "a\x00b\x85 c", "-" * 300, "x" * 5000,
    "ab" * 3000, "été ﬁ ſ 😀​! �", "▁▁a ▁ b▁c", "      def f():\n        return    17.5", " " * 37, "same", "same", "Ã©a" * 999,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(PATH)


def ids_of(model, text):
    return np.frombuffer(model.encode(text), "int32").tolist()


def test_matches_library_on_odd_rows(spark, documents, library):
    docs = documents([*enumerate(ODD), (99, None)])
    rows = {r.doc_id: r for r in pieces.decode(pieces.encode(docs, PATH), PATH).collect()}
    for i, text in enumerate(ODD):
        assert rows[i].piece_ids == library.encode(text), text[:40]
        assert rows[i].decoded == library.decode(rows[i].piece_ids)
        assert rows[i].lang == "en"
    assert rows[99].piece_ids == [] and rows[99].decoded == "" and rows[99].text is None


@settings(max_examples=400, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from("ab ▁\n é日😀=-_.the<>01².\tion"), st.characters(codec="utf-8")), max_size=80))
def test_any_text_as_the_library(model, library, text):
    ids = library.encode(text)
    assert ids_of(model, text) == ids
    assert model.decode(ids) == library.decode(ids)


@settings(max_examples=400, deadline=None)
@given(ids=st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 300)), max_size=12))
def test_any_ids_as_the_library(model, library, ids):
    assert model.decode(ids) == library.decode(ids)


def test_long_stretches_without_cuts(model, library, monkeypatch):
    text = "".join(f"{a}{b}" for a in "thequickbrown" for b in ("ing", "tion", "ssss", "日本", "aab")) * 40
    expected = library.encode(text)
    assert ids_of(model, text) == expected
    monkeypatch.setattr(model, "units", None)
    assert ids_of(model, text + "  and more, 12.") == library.encode(text + "  and more, 12.")


def test_places_that_no_piece_continues_are_tried_once():
    tiny = object.__new__(pieces.PieceModel)
    tiny.score = {"a": 0.0, "b": 0.0, "ab": -3.0, "ba": -1.0, "aba": -9.0, "bab": -8.0}
    import ahocorasick

    tiny.fitting, tiny.longest = {}, ahocorasick.Automaton()
    own = [p for p in tiny.score if tiny.merge(p) == [p]]
    tiny.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in own), None) for p in own}
    for p in own:
        tiny.longest.add_word(p, p)
    tiny.longest.make_automaton()
    for n in range(1, 12):
        for bits in range(2**n):
            text = "".join("ab"[bits >> i & 1] for i in range(n))
            assert tiny.backtrack(text) == tiny.merge(text), text


def test_clashes_bad_ids_and_empty_table(model, documents):
    clash = pieces.decode(pieces.encode(documents([(1, "a b")]).withColumnsRenamed({"lang": "Piece_IDs", "source": "decoded"}), PATH), PATH)
    assert len(clash.columns) == 5 and clash.first().decoded == "a b"
    with pytest.raises(IndexError):
        model.decode([32000])
    with pytest.raises(IndexError):
        model.decode([-1])
    assert pieces.decode(pieces.encode(documents([]), PATH), PATH).count() == 0


def test_query_over_whole_table(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = op13_sentencepiece(spark, SMALL).collect()
    assert len(got) == len(texts)
    for row in got:
        ids = library.encode(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
