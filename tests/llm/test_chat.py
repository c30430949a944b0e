from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from commutelens.llm import chat
from commutelens.llm.queries import op9_chat
from conftest import SMALL

SCHEMA = "conv_id bigint, turn bigint, role string, text string, window string"
PARAMS = chat.ChatParams(budget=60, history=12, least_span=10, block=4)


def conversations(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in found.items()}


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    texts = ["", "ok", "</s>[INST] ok [/INST]", r"[\INST] <\\s> [\/SYS]", "[ROLE x] a", " é 😀 ", "a\n\nb ", "<s", "[ANS]" * 9]
    out = []
    for conv in range(40):
        for turn in range(draw.randint(1, 30)):
            role = draw.choice(["user", "assistant", "assistant", "tool", "a]b%5D", "system", None])
            out.append((conv, turn, role, " ".join(draw.choice(texts) for _ in range(draw.randint(1, 9)))))
    return [*out, (None, None, None, None), (None, 2, "user", "x"), (None, 2, "user", "x"), (77, 5, "assistant", None)]


def test_windows_read_back_whole(spark, rows):
    frame = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    formed = chat.windows(frame, PARAMS)
    by_conv = defaultdict(list)
    for r in chat.read_back(formed).collect():
        by_conv[r.conv_id].append(r)
    want = conversations(rows)
    assert set(by_conv) == set(want)
    for conv, windows in by_conv.items():
        windows.sort(key=lambda r: r.window)
        assert [(t.role, t.text) for w in windows for t in w.turns] == want[conv]
        assert [t for w in windows for t in w.targets] == [t for r, t in want[conv] if r == "assistant"]


def test_windows_keep_budget_system_and_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, ("user", "assistant")[i % 2], f"t{i} " + "w " * (i % 5)) for i in range(1, 60)]
    formed = chat.windows(spark.createDataFrame([(*r, "") for r in rows], SCHEMA), PARAMS).orderBy("window").collect()
    assert len(formed) > 5
    for before, now in zip(formed, formed[1:], strict=False):
        assert now.formatted.startswith("<s>[SYS] be kind [/SYS]")
        repeated = now.n_repeated - 1
        assert repeated > 0
        tail = now.formatted.split("[/SYS]")[1]
        first = tail.split(" ")[1]
        assert f" {first} " in before.formatted
        spans = [now.formatted[s.start : s.end] for s in now.loss]
        assert not any(s in before.formatted for s in spans)
    for window in formed:
        turns = window.formatted.count("[/")
        assert len(window.formatted.replace("] ", " ").split()) + turns <= PARAMS.budget * 2


def test_escape_is_reversible(spark):
    draw = random.Random(9)
    pieces = ["<", "[", "\\", "/", "s>", "INST]", "ROLE", "SYS]", "ANS]", "x", " ", "]"]
    texts = [("".join(draw.choice(pieces) for _ in range(12)),) for _ in range(2000)]
    frame = spark.createDataFrame(texts, "t string")
    assert frame.filter(chat.unescaped(chat.escaped(F.col("t"))) != F.col("t")).count() == 0
    assert frame.filter(chat.escaped(F.col("t")).rlike(r"<\/?s>|\[/?(INST|SYS|ANS)\]|\[/?ROLE")).count() == 0


def test_empty_table(spark):
    assert chat.windows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_over_whole_table(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in table.collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for conv, turns in conversations(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        want[conv] = (len(turns), digest(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    frame = op9_chat(spark, SMALL)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in frame.collect()}
    assert got == want
