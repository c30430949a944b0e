from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from commutelens.llm import lexical
from commutelens.llm.lexical import LexicalParams
from commutelens.llm.terms import word_blocks

DOCS = "doc_id bigint, text string, score int, term string"
ITEMS = "item_id bigint, text string, rank int, doc_id bigint"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k=10):
    docs = [(i, Counter(words(t))) for i, t, *_ in docs]
    n_docs, n_terms = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, t, *_ in items:
        if i is not None:
            asked[i] = min(x for x in (asked.get(i), t) if x is not None) if (asked.get(i), t) != (None, None) else None
    out = []
    for item, text in asked.items():
        scores = []
        for i, c in docs:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms if c else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in words(text)
                if c[t]
            )
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 0, "x") for i, t in docs], DOCS),
        spark.createDataFrame([(i, t, 0, 5) for i, t in items], ITEMS),
    )


@pytest.mark.parametrize("params", [LexicalParams(), LexicalParams(k=3, block=7, step=1.01, focus=1), LexicalParams(k=4, block_terms=40, terms_per_pass=30, step=4.0)])
def test_matches_brute_force(spark, params):
    draw = random.Random(7)
    names = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(draw.choices(names, [1 / (i + 1) for i in range(40)], k=n))
    items = [(i, text(12)) for i in range(9)]
    docs = [(i, text(draw.randint(0, 60))) for i in range(150)]
    docs += [(200 + i, items[i % 9][1] + " " + text(i)) for i in range(20)]
    docs += [(300 - i, "w1 w2 w39 w39") for i in range(25)]  # ties
    got = lexical.search(*frames(spark, docs, items), params=params)
    assert sorted(map(tuple, got.collect())) == brute(docs, items, params.k)


def test_odd_rows(spark):
    docs = [
        (1, None), (2, ""), (3, " .,\x00- "), (4, "Été ÉTÉ été 日本 A-b_c"), (4, "Été ÉTÉ été 日本 A-b_c"), (None, "été rare"), (5, "B2b\x85b2B"), (6, "word " * 30_000 + "rare"),
        (-7, "rare"),
    ]
    items = [(1, "été A b B2B"), (1, "zzz"), (2, None), (3, ""), (None, "été"), (4, "日本 rare rare\x00word"), (5, "nowhere"), (6, "B2b\x85b2B")]
    got = lexical.search(*frames(spark, docs, items), params=LexicalParams(block=2))
    assert sorted(map(tuple, got.collect())) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a")], [(1, "a")])
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in lexical.search(docs, items).collect()] == brute([(1, "a")], [(1, "a")])


def test_buckets_and_coordinates_leave_vectors_out(monkeypatch):
    """Most vectors are bounded away: far fewer are scored exactly than there are."""
    import numpy as np

    scored = []
    exact = lexical.Block._exact
    monkeypatch.setattr(lexical.Block, "_exact", lambda self, rows, gains: scored.append(len(rows)) or exact(self, rows, gains))
    draw = np.random.default_rng(3)
    n, width = 4000, 60
    sizes = draw.integers(1, 20, n)
    terms = np.concatenate([np.sort(draw.choice(width, s, replace=False)) for s in sizes])
    corpus = lexical.Corpus(n, int(sizes.sum()) * 3, np.bincount(terms, minlength=width))
    ends = np.append(0, np.cumsum(sizes))
    block = lexical.Block(np.arange(n), sizes * 3, ends, terms, draw.integers(1, 4, len(terms)), corpus, corpus.weights(), lexical.PARAMS)
    query = lexical.Query(1, np.arange(6), np.ones(6, np.int64), corpus.weights(), 10)
    block.visit(query, np.zeros(width, np.int64))
    assert len(block.cuts) > 3 and len(query.ids) == 10 and sum(scored) < n / 2


def test_long_texts_are_split_between_words():
    text = b"Aa bb,cc " * 50 + "ééé".encode() * 400 + b" end" + b"z" * 2000
    for size in (1, 5, 64, 1000, 10**6):
        assert [w for block in word_blocks(text, size) for w in block] == [w.encode() for w in words(text.decode())]
