"""Quality classifier by positive-unlabelled learning.

A linear score over standardised text features is fitted to trusted positives and unlabelled web text by minimising the
non-negative unbiased risk with a logistic loss: with class prior p, positives P and unlabelled U,

    p * mean_P loss(+) + max(0, mean_U loss(-) - p * mean_P loss(-))

Where the second term would fall below zero the step goes the other way, which undoes overfitting. The prior is
estimated from trusted labels of both kinds where there are any, and else from scores of positives held out from the
fit, as the share of unlabelled rows that look like them.

Features are shares of characters, words and lines, computed in one pass over a text's bytes; labels, language, source
and ids are never among them. Fitting uses at most ``sample`` positives and ``sample`` unlabelled rows, those with the
smallest hash of their id; scoring covers every row.

Results: null and empty texts have the features of an empty text and a score like any other. Without any positive label
every row scores 0.5. Rows repeated under one id and other columns stay as they are; a column
that has the name of a result is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commutelens.llm.worker import at_work


@dataclass(frozen=True)
class QualityParams:
    #: Bound on rows of either kind that the fit sees.
    sample: int = 20_000
    steps: int = 600
    rate: float = 0.05
    #: Weight of the squared norm, and limit of standardised features, which keeps rare extremes from ruling.
    ridge: float = 1e-3
    clip: float = 8.0


PARAMS = QualityParams()

_KINDS = ("lower", "upper", "digit", "space", "line", "end", "pause", "rare", "high")
_KIND = np.full(256, _KINDS.index("rare"))
for _name, _chars in (
    ("lower", b"abcdefghijklmnopqrstuvwxyz"), ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", b"0123456789"),
    ("space", b" \t\r"), ("line", b"\n"), ("end", b".?"), ("pause", b",;:'-()\""), ("high", bytes(range(128, 256))),
):
    _KIND[np.frombuffer(_chars, np.uint8)] = _KINDS.index(_name)
FEATURES = (*_KINDS, "log_bytes", "word_bytes", "distinct_words", "distinct_lines", "line_bytes", "signs_alone", "top_rare", "repeats")


def features(text: bytes) -> list[float]:
    """Shares and sizes on scales that do not depend on the length of the text, but for its logarithm."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=len(_KINDS))
    words, lines = text.split(), text.split(b"\n")
    size, n = max(len(text), 1), max(len(words), 1)
    rare = counts[_KIND == _KINDS.index("rare")].max()
    return [
        *np.sqrt(kinds / size).tolist(),
        float(np.log1p(len(text))),
        float(np.log1p(sum(map(len, words)) / n)),
        len(set(words)) / n ** 0.9,
        len(set(lines)) / len(lines),
        float(np.log1p(len(text) / len(lines))),
        float(np.sqrt(sum(not w.isalnum() for w in words if len(w) == 1) / n)),
        float(np.sqrt(rare / n)),
        float(np.sqrt(sum(map(eq, words, words[1:])) / n)),
    ]


def feature_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def compute(texts: pa.Array) -> pa.Array:
        at_work("quality")
        return pa.array([features((x.as_py() or "").encode("utf-8", "replace")) for x in texts], pa.list_(pa.float64()))

    return compute(text)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float
    clip: float

    def standard(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -self.clip, self.clip)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        x = self.standard(rows)
        return _sigmoid(np.hstack([x, x**2]) @ self.weights + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float | None, params: QualityParams = PARAMS) -> Model:
    """Non-negative unbiased risk, by full gradient steps with momentum and per-weight rates."""
    scale = unlabelled.std(axis=0)
    model = Model(unlabelled.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), np.zeros(0), 0.0, 0.0, params.clip)
    expand = lambda rows: np.hstack([(x := model.standard(rows)), x**2, np.ones((len(rows), 1))])
    if prior is None:
        prior = estimated_prior(expand(positives), expand(unlabelled), params)
    p, u = expand(positives), expand(unlabelled)
    w = np.zeros(p.shape[1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, params.steps + 1):
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        negative = -np.log1p(-su + 1e-12).mean() + prior * np.log1p(-sp + 1e-12).mean()
        towards = prior * ((sp - 1) @ p) / len(p)
        away = su @ u / len(u) - prior * (sp @ p) / len(p)
        slope = (towards + away if negative >= 0 else -away) + params.ridge * np.r_[w[:-1], 0.0]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w = w - params.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(model.mean, model.scale, w[:-1], float(w[-1]), prior, params.clip)


def estimated_prior(positives: np.ndarray, unlabelled: np.ndarray, params: QualityParams = PARAMS) -> float:
    """Share of positives among unlabelled rows: least ratio, over thresholds, of unlabelled to positive rows above.
    Scores come from a fit of positives against unlabelled rows on every other row, ratios from the rest."""
    x = np.vstack([positives[::2], unlabelled[::2]])
    y = np.r_[np.ones(len(positives[::2])), np.zeros(len(unlabelled[::2]))]
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w = np.zeros(x.shape[1])
    for _ in range(params.steps):
        w -= 0.5 * (((_sigmoid(x @ w) - y) * weight) @ x + params.ridge * w)
    p, u = positives[1::2] @ w, unlabelled[1::2] @ w
    if not len(p) or not len(u):
        return 0.5
    cuts = np.quantile(p, np.linspace(0.0, 0.9, 91))
    ratios = [(u >= c).mean() / max((p >= c).mean(), 1e-9) for c in cuts]
    return float(np.clip(min(ratios), 0.01, 0.99))


def train(
    docs: DataFrame, labels: DataFrame, may_learn: Column, text: str = "text", label: str = "quality",
    params: QualityParams = PARAMS,
) -> Model | None:
    """Model from the labels that ``may_learn`` (on doc_id) allows and the texts of ``docs``; None without positives.

    Conflicting labels of one document do not count.
    """
    trusted = (
        labels.filter(may_learn & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).alias("low"), F.max(label).alias("high"))
        .filter("low = high")
        .select("doc_id", F.col("high").alias("given"))
    )
    texts = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.col(text).alias("text"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]

    def sampled(ids: DataFrame) -> np.ndarray:
        """Features of the chosen rows. Ids are chosen first, so that only their texts are read into features."""
        few = F.broadcast(ids.select("doc_id").distinct().orderBy(*order).limit(params.sample))
        rows = texts.join(few, "doc_id").select(feature_column(F.col("text")).alias("f"), *order).orderBy("f").select("f")
        return np.array([r.f for r in rows.limit(2 * params.sample).collect()]).reshape(-1, len(FEATURES))

    shares = {r.given: r["n"] for r in trusted.groupBy("given").agg(F.count(F.lit(1)).alias("n")).collect()}
    positives = sampled(trusted.filter("given = 1"))
    unlabelled = sampled(texts.filter(may_learn))
    if not len(positives) or not len(unlabelled):
        return None
    prior = shares[1] / (shares[0] + shares[1]) if shares.get(0) and shares.get(1) else None
    return fit(positives, unlabelled, prior, params)


def score(df: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability of good quality."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        at_work("quality")
        rows = [features((x.as_py() or "").encode("utf-8", "replace")) for x in texts]
        return pa.array(model.scores(np.array(rows).reshape(-1, len(FEATURES))))

    return df.withColumn(out, scored(F.col(text)) if model else F.lit(0.5))


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learned from: those outside the held-out third."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1
