from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from commutelens.llm import suffix
from commutelens.llm.queries import op3_suffix_dedup
from commutelens.llm.suffix import SuffixParams
from conftest import SMALL


def brute(rows, length):
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        if i is not None:
            for a in range(len(data) - length + 1):
                s = data[a : a + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        if i is not None:
            for a in range(len(data) - length + 1):
                if first[data[a : a + length]] < i:
                    gone[a : a + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(frame):
    return sorted(
        (
            (r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest())
            for r in frame.collect()
        ),
        key=repr,
    )


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "a", "mississippi"])
@pytest.mark.parametrize("large", [False, True])
def test_suffix_arrays(letters, large, monkeypatch):
    draw = random.Random(letters)
    for size in [1, 2, 3, 7, 50, 400] + [3000] * (not large):
        data = bytes(draw.choice(letters.encode()) for _ in range(size))
        text = np.frombuffer(data, np.uint8).astype(np.int64)
        want = sorted(range(size), key=lambda i: data[i:])
        smaller = suffix._classified(text)
        lms = [i for i in range(1, size) if smaller[i] and not smaller[i - 1]]
        ordered = np.array(sorted(lms, key=lambda i: data[i:]), np.int64)
        induce = suffix._induced_one_by_one if large else suffix._induced_by_bucket
        if size > 1:
            assert induce(text, smaller, ordered, 256).tolist() == want
        assert suffix.suffix_array(text, 256 if large else 128).tolist() == want
        array = np.array(want)
        common = suffix.permuted_prefixes(text.astype(np.uint8), array, 20)
        for a, b in zip(want, want[1:], strict=False):
            n = next((k for k in range(20) if data[a + k : a + k + 1] != data[b + k : b + k + 1] or b + k >= size or a + k >= size), 20)
            assert common[b] >= n and (common[b] == n or max(a, b) + common[b] > size)


def corpus(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdé") for _ in range(draw.randint(1, 6)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(4)]
    rows = []
    for i in range(150):
        parts = [" ".join(word() for _ in range(draw.randint(0, 30)))]
        for _ in range(draw.randint(0, 2)):
            p = draw.choice(passages)
            a = draw.randint(0, 40)
            parts += [p[a : len(p) - draw.randint(0, 40)], word()]
        if rows and draw.random() < 0.2:
            parts = [draw.choice(rows)[1], parts[0]]
        if draw.random() < 0.1:
            parts += ["-" * draw.randint(40, 130)]
        rows.append((i, " ".join(parts)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "params",
    [SuffixParams(), SuffixParams(length=20, gram=8, block=300, frequent=3, bucket_bits=4, shard=200)],
)
def test_matches_brute_force(documents, params):
    rows = [*corpus(6), (900, None), (901, ""), (None, corpus(6)[0][1]), (5, "\0" * 80 + "x" * 70), (3, "\0" * 80), (902, "x" * 69)]
    frame = documents(rows).withColumnRenamed("lang", "mark").withColumnRenamed("source", "anchor")
    assert found(suffix.deduplicate(frame, params=params)) == brute(rows, params.length)


def test_long_texts_come_in_parts(monkeypatch):
    text = ("The quick brown fox %d " * 60 % tuple(range(60))).encode()
    whole = list(suffix.anchors([text], SuffixParams()))
    monkeypatch.setattr(suffix, "_PIECE", 100)
    parts = list(suffix.anchors([b"short", text], SuffixParams()))
    at = lambda runs: {s: int(h) for _, hs, a, b in runs for h, x, y in zip(hs, a, b, strict=True) for s in range(x, y + 1)}
    assert at(parts) == at(whole) and len(at(whole)) == len(text) - 49


def test_empty_table(documents):
    assert suffix.deduplicate(documents([])).count() == 0


def test_query_over_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op3_suffix_dedup(spark, SMALL).collect()]
    assert sorted(got, key=repr) == brute(rows, 50)


def test_shards_are_sorted_without_scans_of_single_letters(monkeypatch):
    """Names of substrings are of many kinds; a scan in Python over them took most of a shard's time."""
    draw = random.Random(3)
    stock = [bytes(draw.choice(b"abcdefghij klmnop") for _ in range(120)) for _ in range(60)]
    segments = [b"".join(draw.choice(stock)[draw.randrange(40) :] for _ in range(draw.randrange(1, 4))) for _ in range(200)]
    docs = np.array([draw.randrange(50) for _ in segments])
    monkeypatch.setattr(suffix, "_induced_one_by_one", None)
    least = {}
    for data, doc in zip(segments, docs.tolist(), strict=True):
        for i in range(len(data) - 49):
            least[data[i : i + 50]] = min(doc, least.get(data[i : i + 50], doc))
    found = {
        (s, i): doc for s, first, last, doc in suffix.covered(segments, docs, 50) for i in range(first, last + 1)
    }
    assert found == {(s, i): least[d[i : i + 50]] for s, d in enumerate(segments) for i in range(len(d) - 49)}


@pytest.mark.parametrize("kinds", [2, 300])
def test_doubling(kinds):
    names = np.random.default_rng(kinds).integers(0, kinds, 2000)
    names[1000:1700] = names[:700]
    whole = names.tolist()
    assert suffix._doubled(names, len(names)).tolist() == sorted(range(2000), key=lambda i: whole[i:])
    some = [whole[i : i + 8] for i in suffix._doubled(names, 8)]
    assert some == sorted(some)
