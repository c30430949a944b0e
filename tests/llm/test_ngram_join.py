from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from commutelens.llm import ngram_join
from commutelens.llm.ngram_join import JoinParams
from commutelens.llm.queries import op6_ngram_join
from conftest import SMALL


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def brute(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is None or j is None or not x or not y:
                continue
            if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    i_, j_ = find(i), find(j)
                    root[max(i_, j_)] = min(i_, j_)
    return sorted(((i, len(x), None if i is None else find(i)) for i, x in sets), key=repr)


def corpus(seed, size):
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefghijklm") + draw.choice("nopqrstuvw")
    passage = [word() for _ in range(12)]
    rows = []
    for i in range(size):
        kind = draw.random()
        if kind < 0.5 or not rows:
            words = [word() for _ in range(draw.choice([0, 1, 2, 3, 8, 20, 45, 80]))]
            if draw.random() < 0.5:
                words += passage
        else:
            words = (draw.choice(rows)[1] or "").split()
            for _ in range(draw.randint(0, 4)):
                if words:
                    words[draw.randrange(len(words))] = word()
            words += [word() for _ in range(draw.choice([0, 0, 1, 5]))]
        rows.append((i, draw.choice([" ", "  ", "\n"]).join(words)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "params", [JoinParams(words=4, percent=85), JoinParams(words=4, percent=70, chunk=3, cells=64, repeats=2)]
)
def test_matches_brute_force(spark, documents, params):
    rows = [*corpus(4, 300), (900, None), (901, ""), (902, "Ab cD"), (903, "aB Cd"), (904, "É é É É x"), (905, "É é É É x")]
    rows += [(None, "no id at all here"), (10, "second text of ten stands here"), (1000, "second text of TEN stands here")]
    frame = documents(rows).withColumnRenamed("lang", "node").withColumnRenamed("source", "n")
    got = ngram_join.classes(frame, params=params).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, params.words, params.percent)


def test_near_copies_in_many_chunks(spark, documents):
    draw = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if draw.random() > 0.02 else f"x{draw.random()}" for w in base)) for i in range(120)]
    params = JoinParams(words=4, percent=85, chunk=10, repeats=3)
    got = ngram_join.classes(documents(rows), params=params).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 4, 85)


def test_long_text_in_pieces(monkeypatch):
    text = "Some words  of\tvarious lengths " * 500
    whole = next(ngram_join.ngram_sets([text], 4))
    monkeypatch.setattr(ngram_join, "_TEXT_BLOCK", 100)
    parts = list(ngram_join.ngram_sets(["a b c d e", text, "a b c d e"], 4))
    assert (parts[1] == whole).all() and len(whole) == len(shingles(text, 4)) and (parts[0] == parts[2]).all()


def test_one_of_each_and_empty_table(documents):
    docs = documents([(3, "a b c d e f g h"), (1, "A b c d e f g h"), (2, ""), (4, ""), (None, "a b c d e f g h")])
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in ngram_join.one_of_each(docs).collect()) == [
        (False, 1), (False, 2), (False, 4), (True, 0),
    ]
    assert ngram_join.classes(documents([])).count() == 0


def test_query_over_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, op6_ngram_join(spark, SMALL).collect()), key=repr) == brute(rows, 4, 85)


def test_columns_named_like_the_join_s_own(documents):
    docs = documents([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")]).withColumnRenamed("lang", "kept_id")
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


@pytest.mark.parametrize("shift", [0, 40, 56])
def test_members_without_a_partner_are_told_by_prefixes(shift):
    draw, params = np.random.default_rng(shift), JoinParams(words=4, percent=85)
    lost = kept = 0
    for _ in range(60):
        sets = [np.unique(draw.integers(0, 1 << 63, draw.integers(1, 60))) for _ in range(8)]
        for i in range(4, 8):
            copy = np.unique(np.where(draw.random(len(sets[i - 4])) < 0.05, draw.integers(0, 1 << 63, len(sets[i - 4])), sets[i - 4]))
            sets[i] = copy if draw.random() < 0.7 else sets[i]
        prefixes = [s[: params.prefix(len(s))] >> shift for s in sets]
        good = ngram_join.may_link(np.array([len(s) for s in sets]), prefixes, params)
        for i, x in enumerate(sets):
            overlaps = [(len(np.intersect1d(x, y)), len(y)) for j, y in enumerate(sets) if j != i]
            similar = any(100 * both >= 85 * (len(x) + size - both) for both, size in overlaps)
            assert good[i] or not similar
            lost, kept = lost + (not good[i]), kept + int(good[i])
    assert shift == 56 or lost > 60 and kept > 60


def test_groups_are_cut_by_the_size_of_their_texts(documents):
    draw = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(w if draw.random() > 0.02 else f"x{draw.random()}" for w in base)) for i in range(40)]
    params = JoinParams(words=4, percent=85, chunk_grams=300, repeats=3)
    assert sorted(map(tuple, ngram_join.classes(documents(rows), params=params).collect()), key=repr) == brute(rows, 4, 85)


def test_worker_that_meets_an_empty_block_first(monkeypatch):
    monkeypatch.setattr(ngram_join, "_powers", {})
    assert [len(s) for s in ngram_join.ngram_sets(["", "", "a b c d e"], 4)] == [0, 0, 2]
    monkeypatch.setattr(ngram_join, "_powers", {})
    assert [len(s) for s in ngram_join.ngram_sets([""], 4)] == [0]


def test_chance_meetings_in_small_groups_send_nothing(spark):
    """A set that shares a few tokens with each of many others is similar to none of them."""
    params = JoinParams()
    meets = [(lead, 100, 300, 2) for lead in range(1, 41)] + [(lead, 200 + lead, 300, 2) for lead in range(1, 41)]
    meets += [(lead, node, 300, 12) for lead in (50, 51) for node in (300, 301)]  # 24 tokens at two leaders
    meets += [(60, node, 300, 12) for node in (302, 303)]
    able = [(i, 300) for i in {x for row in meets for x in row[:2]}]
    routes = ngram_join._routes(
        spark.createDataFrame(meets, "lead long, node long, n long, met long"),
        spark.createDataFrame(able, "doc_id long, n long"),
        params,
    )
    assert sorted(map(tuple, routes.collect())) == [(50, 300, 300), (50, 301, 300)]


@pytest.mark.parametrize("paired", [0, 1, 3, 100])
def test_classes_do_not_depend_on_what_is_a_small_group(spark, paired):
    draw = random.Random(11)
    stock = [" ".join(draw.choice("abcdefghijklmnop") * 2 for _ in range(60)) for _ in range(5)]
    rows = []
    for i in range(90):
        words = draw.choice(stock).split()
        for _ in range(draw.choice([0, 0, 1, 2, 6])):
            words[draw.randrange(len(words))] = draw.choice("qrstuvwxyz") * 2
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    params = JoinParams(paired=paired, chunk=7)
    got = sorted(map(tuple, ngram_join.classes(frame, params=params).collect()), key=repr)
    assert got == brute(rows, params.words, params.percent)


def test_documents_that_share_too_little_with_all_others_are_left(spark):
    # 1 and 2 share 30 tokens at leader 1; 3 to 40 share one each with 1, and 3 leads 41 with one token.
    meets = [(1, 2, 100, 30), *((1, i, 100, 1) for i in range(3, 41)), (3, 41, 100, 1), (50, 2, 100, 1)]
    meets = spark.createDataFrame(meets, "lead bigint, node bigint, n bigint, met bigint")
    able = spark.createDataFrame([(i, 100) for i in range(1, 51)], "doc_id bigint, n bigint")
    rows, kept = ngram_join._able_to_link(meets, able, ngram_join.JoinParams(words=4, percent=85))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert sorted((r.lead, r.node, r.met) for r in rows.collect()) == [(1, 2, 30), (50, 2, 1)]


def edited(draw, base, count, share):
    return [(i, " ".join(w if draw.random() > share else f"x{draw.random()}" for w in base)) for i in range(count)]


@pytest.mark.parametrize("share", [0.015, 0.04])
def test_loose_members_of_many_chunks_find_each_other(documents, share):
    draw = random.Random(21)
    base, params = [f"w{i}" for i in range(60)], JoinParams(words=4, percent=85, chunk=8, repeats=3)
    first = edited(draw, base, 60, share)
    rows = first + [(100 + i, first[draw.randrange(60)][1] + " end") for i in range(20)]
    assert sorted(map(tuple, ngram_join.classes(documents(rows), params=params).collect()), key=repr) == brute(rows, 4, 85)


def test_a_task_holds_two_chunks_however_many_members_stay_loose(spark):
    members = [(1, i % 10, i, f"t{i}", 10) for i in range(2, 202)] + [(300, i % 3, 300 + i, "t", 3) for i in range(1, 7)]
    loose = [(1, i) for i in range(2, 202, 2)] + [(300, 301)]
    met = ngram_join._meeting(
        spark.createDataFrame(members, "lead long, chunk long, node long, text string, chunks long"),
        spark.createDataFrame(loose, "lead long, node long"),
    )
    held = defaultdict(set)
    for r in met.collect():
        assert r.low < r.high and r.chunk in (r.low, r.high) and r.free == ((r.lead, r.node) in set(loose))
        held[r.lead, r.low, r.high].add((r.chunk, r.node))
    assert max(map(len, held.values())) <= 40
    chunk, free = {(m[0], m[2]): m[1] for m in members}, set(loose)
    for lead, node in loose:  # each loose member meets each member of the other chunks
        for (other_lead, other), at in chunk.items():
            if other_lead == lead and at != chunk[lead, node]:
                low, high = sorted([at, chunk[lead, node]])
                assert {(at, other), (chunk[lead, node], node)} <= held[lead, low, high]
    assert sorted(held[300, 0, 1]) == [(0, 303), (0, 306), (1, 301)] and (300, 0, 2) not in held and free


def test_probes_with_a_partner_are_told_by_their_overlaps():
    draw, params = np.random.default_rng(7), JoinParams(words=4, percent=85)
    base = np.unique(draw.integers(0, 1 << 58, 80))
    copies = [np.unique(np.where(draw.random(len(base)) < s, draw.integers(0, 1 << 58, len(base)), base)) for s in draw.random(60) / 5]
    sets = [*copies, np.zeros(0, np.int64), base[:1], base[:1]]
    near = ngram_join.reaching(sets[:30], sets, params)
    for i, x in enumerate(sets[:30]):
        for j, y in enumerate(sets):
            both = len(np.intersect1d(x, y))
            assert near[i, j] == (both > 0 and 100 * both >= 85 * (len(x) + len(y) - both))
    assert ngram_join.reaching(sets[60:], sets[60:], params).tolist() == [[False] * 3, [False, True, True], [False, True, True]]
    assert ngram_join.reaching([], sets, params).shape == (0, 63) and not ngram_join.reaching(sets[60:61], sets[60:61], params).any()
