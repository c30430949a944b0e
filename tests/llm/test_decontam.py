from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import pytest

from commutelens.llm import decontam
from commutelens.llm.queries import op10_decontam
from conftest import SMALL

def words(text):
    """Runs of letters and digits of any script."""
    return re.split(r"[\W_]+", (text or "").lower())


def brute(docs, items, params=decontam.PARAMS):
    """Every document against every item on every diagonal, by the share of equal words alone."""
    found = set()
    for item_id, item in items:
        b = [w for w in words(item) if w]
        if not b:
            continue
        width = min(params.window, len(b))
        for doc_id, text in docs:
            a = words(text)
            places = {w: [i for i, x in enumerate(b) if x == w] for w in set(b)}
            agree = Counter(i - j for i, w in enumerate(a) for j in places.get(w, ()))
            for start in (d for d, n in agree.items() if n >= params.least_share * width):
                equal = [0 <= start + j < len(a) and a[start + j] == b[j] for j in range(len(b))]
                if max(sum(equal[s : s + width]) for s in range(len(b) - width + 1)) >= params.least_share * width:
                    found.add((doc_id, item_id))
    return found


@pytest.fixture
def planted():
    draw = random.Random(2)
    word = lambda: draw.choice("abcdefghij") + draw.choice("klmnop") + draw.choice("qrstu")
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([5, 6, 7, 8, 9, 12, 16, 20, 30, 40, 3, 1, 2, 4, 5, 6, 10, 11, 13, 14, 15])]
    docs = []
    for i in range(120):
        text = [word() for _ in range(draw.randint(0, 60))]
        item = draw.choice(items)[1].split()
        part = item[draw.randint(0, 2) if len(item) > 16 else 0 :]
        for _ in range(draw.randint(0, 4)):
            part[draw.randrange(len(part))] = word()
        if i % 3:
            text[len(text) // 2 : len(text) // 2] = part
        docs.append((i, ", ".join(text).title()))
    return docs, items


def test_matches_brute_force(spark, documents, planted):
    docs, items = planted
    frame = documents([*docs, (500, None), (501, ""), (502, items[7][1]), (502, items[7][1]), (None, items[8][1])])
    frame = frame.withColumnRenamed("lang", "item_id").withColumnRenamed("source", "seed")
    bench = spark.createDataFrame([*items, (90, None), (91, "")], "item_id bigint, text string")
    want = brute([*docs, (502, items[7][1]), (None, items[8][1])], items)
    for params in (decontam.PARAMS, decontam.SeedParams(broadcast_seeds=0)):
        got = decontam.find(frame, bench, params=params).collect()
        assert len(got) == len({(r.doc_id, r.item_id) for r in got})
        assert {(r.doc_id, r.item_id) for r in got} == want
    left = {r.doc_id for r in decontam.clean(frame, bench).collect()}
    assert left == ({i for i, _ in docs} | {500, 501}) - {d for d, _ in want}


def test_empty_tables(spark, documents):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id bigint, text string")
    assert decontam.find(documents([]), bench).count() == 0
    assert decontam.find(documents([(1, "a b c d e f g h i j")]), bench.limit(0)).count() == 0


def test_query_over_whole_table(spark):
    load = lambda name: [tuple(r) for r in spark.read.parquet(f"{SMALL}/{name}.parquet").collect()]
    docs = [(r[0], r[1]) for r in load("documents")]
    frame = op10_decontam(spark, SMALL)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert {(r.doc_id, r.item_id) for r in frame.collect()} == brute(docs, load("benchmark"))


PASSAGE = "don't stop the reader's well known way of asking what isn't said in one long and winding line of words that nobody else wrote down before"


@pytest.mark.parametrize(
    "copy",
    [
        PASSAGE.replace("'", "’"),
        "“" + PASSAGE.replace(" ", "” “") + "”",
        PASSAGE.replace(" ", "\u00a0"),
        PASSAGE.replace(" ", "—"),
        PASSAGE.replace(" ", "–"),
        PASSAGE.replace(" ", " … "),
    ],
)
def test_typographic_signs_part_words(spark, documents, copy):
    bench = spark.createDataFrame([(7, PASSAGE)], "item_id bigint, text string")
    (row,) = decontam.find(documents([(1, f"before it — {copy} — after it")]), bench).collect()
    assert (row.doc_id, row.item_id, row.n_equal, row.best) == (1, 7, row.n_words, 1.0)
    assert row.n_words == len(words(PASSAGE))


def test_cjk_clauses_are_words(spark, documents):
    item = "今天天气很好，我们去公园。他说了什么？没有人知道！明天再来，好不好？"
    bench = spark.createDataFrame([(3, item)], "item_id bigint, text string")
    docs = documents([(1, f"「开始」　{item}结束"), (2, "今天天气很好，结束")])
    assert [(r.doc_id, r.n_words, r.best) for r in decontam.find(docs, bench).collect()] == [(1, 6, 1.0)]


@pytest.mark.parametrize("n", range(1, 17))
def test_every_accepted_replacement_is_found(spark, documents, n):
    item = [f"w{i}" for i in range(n)]
    allowed = [gone for k in range(n + 1) for gone in itertools.combinations(range(n), k) if n - k >= 0.8 * n]
    docs = [(i, "before " + " ".join(f"x{j}" if j in gone else w for j, w in enumerate(item)) + " after") for i, gone in enumerate(allowed)]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    assert {r.doc_id for r in decontam.find(documents([*docs, (-1, "before w x after")]), bench).collect()} == {i for i, _ in docs}


def test_clashing_names_ties_and_very_long_texts(spark, documents):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id bigint, text string")
    item = "one two three four five six seven eight"
    docs = documents([(1, f"{item} {item}"), (2, "far away"), (3, "pad " * 200_000 + item)]).withColumnRenamed("lang", "found_id").withColumnRenamed("source", "FOUND_ID_")
    rows = {r.doc_id: r for r in decontam.find(docs, bench).collect()}
    assert (rows[1].start, rows[1].best) == (0, 1.0) and rows[3].start == 200_000  # equal diagonals: the first
    left = decontam.clean(docs, bench)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [2]
