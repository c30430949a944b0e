"""Secrets in texts: fixed patterns, and character Markov models for what no pattern names.

Two first-order Markov models over characters are compared by log-likelihood ratio: one of random strings, one of
ordinary identifiers. Both are trained from labelled samples by counting transitions in Spark: the values that the
patterns find are samples of random strings, all other runs of token characters are samples of ordinary ones. Counts
cover the whole table; what reaches the driver is one number per pair of characters and label. A run of token
characters that mixes letters and digits, overlaps no pattern's span and scores above a threshold becomes a span of
kind ``markov``, however long it is. Only the content of an embedded image, sound, video or font, told by the ``data:``
URI in front of it, is left alone, at any length as well.

Results: null and empty texts have no spans. With an empty table both models are uniform and add nothing. Repeated
rows and other columns of the input stay as they are;
a column that has the name of a result is replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commutelens.llm.spans import Span, found_in, free_of, in_order, masked
from commutelens.llm.worker import at_work

KINDS = ("assign", "access", "hex", "markov")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Runs of 24 or more are the only ones kept, and shorter runs end where longer ones cannot begin.
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")

#: Characters of tokens; state 0 is the outside of a token.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
_CLASS = np.zeros(256, np.int64)
_CLASS[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, STATES)
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: What stands in front of embedded media; no part of it is longer than ``_MEDIA_REACH``.
_MEDIA = re.compile(r"data:(?:image|audio|video|font)/[A-Za-z0-9.+-]{1,80}(?:;[A-Za-z0-9=._-]{1,60}){0,2};base64,\Z", re.IGNORECASE)
_MEDIA_REACH = 256
_LETTER, _DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")


@dataclass(frozen=True)
class SecretParams:
    #: Ratio in nats from which a token counts as random; per character and in total.
    least_per_char: float = 1.5
    least_total: float = 24.0
    #: Weight of the uniform prior, in transitions per character.
    prior: float = 50.0


PARAMS = SecretParams()


def plain(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]
    return found


def transitions(text: str) -> np.ndarray:
    """Counts of character pairs inside runs of token characters, from and to the outside included."""
    states = _CLASS[np.frombuffer(f" {text} ".encode("utf-8", "replace"), np.uint8)]
    return np.bincount(states[:-1] * STATES + states[1:], minlength=STATES * STATES)


def random_parts(text: str) -> list[str]:
    """Labelled samples of random strings: what the patterns found, without names and quotes."""
    parts = [m.group(2) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 16]
    parts += [m.group() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    parts += [m.group() for m in _LONG_HEX.finditer(text)]
    return parts


@dataclass(frozen=True)
class Models:
    """Log-likelihood ratio of random over ordinary, by (character, next character)."""

    ratio: np.ndarray = field(repr=False)

    def score(self, token: str) -> float:
        states = _CLASS[np.frombuffer(token.encode(), np.uint8)]
        return float(self.ratio[states[:-1], states[1:]].sum())


def train(df: DataFrame, text: str = "text", params: SecretParams = PARAMS) -> Models:
    """Models of the whole table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, STATES * STATES), np.int64)
        for batch in batches:
            at_work("secrets")
            for value in batch.column(0):
                content = value.as_py() or ""
                chosen = transitions(" ".join(random_parts(content)))
                sums[1] += chosen
                sums[0] += np.maximum(transitions(content) - chosen, 0)
        label, pair = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(label), pa.array(pair), pa.array(sums[label, pair])], names=["label", "pair", "n"]
        )

    counted = (
        df.select(F.col(text).alias("text"))
        .mapInArrow(count, "label bigint, pair bigint, n bigint")
        .groupBy("label", "pair")
        .agg(F.sum("n").alias("n"))
    )
    sums = np.zeros((2, STATES * STATES))
    for row in counted.collect():  # at most two rows per pair of characters
        sums[row.label, row.pair] = row.n
    likely = []
    for matrix in sums.reshape(2, STATES, STATES):
        inside = matrix[:, 1:] + params.prior / (STATES - 1)
        likely.append(np.log(inside / inside.sum(axis=1, keepdims=True)))
    return Models(np.pad(likely[1] - likely[0], ((0, 0), (1, 0))))


def find(text: str, models: Models, params: SecretParams = PARAMS) -> list[Span]:
    """All spans by start, then kind."""
    base: list[Span] = [(*span, True) for span in plain(text)]
    is_free, added = free_of(base), []
    for m in _TOKEN.finditer(text):
        token = m.group()
        size = len(token)
        if not (_DIGIT.search(token) and _LETTER.search(token)) or not is_free(*m.span()):
            continue
        if _MEDIA.search(text, max(0, m.start() - _MEDIA_REACH), m.start()):
            continue
        score = models.score(token)
        if score >= params.least_total and score >= params.least_per_char * size:
            added.append(("markov", *m.span(), False))
    return in_order([*base, *added], KINDS)


def scan(
    df: DataFrame, text: str = "text", spans: str = "spans", models: Models | None = None, params: SecretParams = PARAMS
) -> DataFrame:
    """Adds the spans of every text; without given models it trains them on the same table first."""
    chosen = models or train(df, text, params)
    return df.withColumn(spans, found_in(F.col(text), lambda t: find(t, chosen, params)))


def redact(
    df: DataFrame, text: str = "text", models: Models | None = None, params: SecretParams = PARAMS, mask: str = "[secret]"
) -> DataFrame:
    """Replaces every span of a text by the mask; nulls and texts without secrets stay as they are."""
    chosen = models or train(df, text, params)

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        at_work("secrets")
        rows = (x.as_py() for x in texts)
        return pa.array([t and masked(t, find(t, chosen, params), lambda _: mask) for t in rows], pa.string())

    return df.withColumn(text, cleaned(F.col(text)))
