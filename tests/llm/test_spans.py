from __future__ import annotations

import hashlib
import random
import re

import pytest

from commutelens.llm import pii, secrets
from commutelens.llm.queries import op4_secrets, op8_pii
from conftest import SMALL

RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15),
    "assign": (
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: len(m.group(2)) >= 6,
    ),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
}


def luhn(digits):
    doubled = [int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def expected(text, kinds):
    found = [
        (m.start(), i, m.end(), kind)
        for i, kind in enumerate(kinds)
        for m in re.finditer(RULES[kind][0], text, re.ASCII)
        if RULES[kind][1](m)
    ]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


PIECES = [
    "@", ".", "a", "b9", "-", " ", "+", "1", "255", "256", "4111111111111111", "4111 1111-1111 1111", "12", "(", ")",
    "token", "SECRET", "api_key", "=", ":", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "ff", "ſecret", "é",
    "\n", "x.y", "+1 (974) 555-3436", "10.0.0.1", "_", "/", "passwd:",
]


@pytest.mark.parametrize("seed", range(6))
def test_patterns_match_brute_force(seed):
    draw = random.Random(seed)
    for _ in range(1500):
        text = "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 25)))
        assert [s[:3] for s in pii.find(text) if s[3]] == expected(text, pii.KINDS), text
        base = sorted(secrets.plain(text), key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        assert base == expected(text, secrets.BASE_KINDS), text


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john.doe at example dot com now", "email", "john.doe at example dot com"),
        ("ask john (at) mail.example (dot) org today", "email", "john (at) mail.example (dot) org"),
        ("is jоhn@exаmple.com his", "email", "jоhn@exаmple.com"),
        ("a​b@ex​ample.com", "email", "a​b@ex​ample.com"),
        ("card ４１１１ １１１１ １１１１ １１１１ ok", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("plus four four two zero seven nine four six zero one two three", "phone", None),
        ("at one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
    ],
)
def test_disguises_map_back_to_source(text, kind, found):
    added = [(k, text[s:e]) for k, s, e, base in pii.find(text) if not base]
    assert added == [(kind, found or text)]


@pytest.mark.parametrize("text", ["we met at noon", "looked at example.com", "one two buckle my shoe", "a dot and a dot"])
def test_ordinary_text_has_no_disguised_spans(text):
    assert pii.find(text) == []


def test_long_texts_take_linear_time():
    for text in ("a@" * 100_000, "1" * 300_000, "one two " * 30_000, "a dot " * 30_000, "+1 " * 100_000, "AKIA" * 50_000):
        pii.find(text)
        secrets.plain(text)


def test_markov_finds_random_tokens_and_spares_identifiers(spark):
    models = secrets.train(spark.read.parquet(f"{SMALL}/documents.parquet"))
    kinds = lambda text: [s[0] for s in secrets.find(text, models)]
    assert kinds("x9Kq2LmZ8vWp4RtY7uBn3CxD") == ["markov"]
    assert kinds("my_variable_name_for_item_12 internationalization_2024 2024-01-01T00-00-00Z") == []
    assert kinds("token = x9Kq2LmZ8vWp4RtY7uBn3CxD") == ["assign"]


def test_redaction_and_odd_rows(documents):
    rows = [(1, None), (2, ""), (3, "token=abcdef12 and AKIA" + "A" * 16), (4, "clean"), (4, "clean")]
    docs = documents(rows).withColumnRenamed("lang", "spans_of")
    got = sorted((r.doc_id, r.text) for r in secrets.redact(docs).collect())
    assert got == [(1, None), (2, ""), (3, "[secret] and [secret]"), (4, "clean"), (4, "clean")]
    assert {r.doc_id: len(r.spans) for r in pii.scan(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert secrets.scan(documents([])).count() == 0


@pytest.mark.parametrize(("query", "kinds"), [(op4_secrets, secrets.BASE_KINDS), (op8_pii, pii.KINDS)])
def test_queries_over_whole_table(spark, query, kinds):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = query(spark, SMALL).collect()
    assert len(got) == len(texts)
    for row in got:
        want = expected(texts[row.doc_id], kinds)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in want) for k in kinds]
        assert set(listed.split(",")) <= set(row.spans.split(","))


def key_in_base64(n_bytes):
    """A private key's text as one line of base64, as kubeconfig holds it."""
    import base64

    der = base64.b64encode(random.Random(5).randbytes(n_bytes)).decode()
    lines = [der[i : i + 64] for i in range(0, len(der), 64)]
    pem = "\n".join(["-----BEGIN RSA PRIVATE KEY-----", *lines, "-----END RSA PRIVATE KEY-----", ""])
    return base64.b64encode(pem.encode()).decode()


def test_secrets_of_any_length_are_found(spark, documents):
    models = secrets.train(spark.read.parquet(f"{SMALL}/documents.parquet"))
    markov = lambda text: [text[s:e] for k, s, e, _ in secrets.find(text, models) if k == "markov"]
    key = key_in_base64(1190)
    assert len(key) > 2000
    assert markov(f"users:\n  client-key-data: {key}\n") == [key]
    draw = random.Random(6)
    for size in (60, 512, 513, 5_000, 200_000):
        bearer = "".join(draw.choice(secrets.ALPHABET[:62]) for _ in range(size))
        assert markov(f"Authorization: Bearer {bearer}\nHost: a") == [bearer]
        assert markov(f"see base64, {bearer}") == [bearer]
        assert markov(f"data:application/x-pem-file;base64,{bearer}") == [bearer]
        image = f'<img src="data:image/svg+xml;charset=utf-8;base64,{bearer}">'
        assert markov(image) == ([])
    assert markov("my_variable_name_for_item_12_" * 100) == []
    (row,) = secrets.redact(documents([(1, f"client-key-data: {key}")]), models=models).collect()
    assert row.text == "client-key-data: [secret]"


@pytest.mark.parametrize(
    ("text", "span"),
    [
        ("write to a.b.c.d.e (at) example.com today", "a.b.c.d.e (at) example.com"),
        ("x (at) a.b.c.d.e.f.com", "x (at) a.b.c.d.e.f.com"),
        ("joe(at)mail(dot)example(dot)co(dot)uk(dot)org(dot)net", "joe(at)mail(dot)example(dot)co(dot)uk(dot)org(dot)net"),
        ("a-dot-b-dot-c-dot-d-dot-e-dot-f-at-my-host-dot-example-dot-com", "a-dot-b-dot-c-dot-d-dot-e-dot-f-at-my-host-dot-example-dot-com"),
        ("a_dot_b_at_my_dot_example_dot_com", "a_dot_b_at_my_dot_example_dot_com"),
    ],
)
def test_disguised_addresses_of_any_number_of_parts(text, span):
    assert [text[s:e] for kind, s, e, base in pii.find(text) if kind == "email" and not base] == [span]


def test_disguised_addresses_take_linear_time():
    for text in ("a-dot-" * 20_000 + "at", "a(dot)" * 20_000, "x(at)" + "b.c-" * 20_000, "a_at_" * 20_000):
        pii.find(text)


def test_columns_named_like_results_are_replaced(spark, documents):
    docs = documents([(1, "mail joe (at) example.com")]).withColumnRenamed("lang", "spans")
    for scan in (pii.scan, secrets.scan):
        assert scan(docs).columns == docs.columns and isinstance(scan(docs).first().spans, list)
    assert pii.scan(documents([])).count() == 0
