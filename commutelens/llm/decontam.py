"""Benchmark decontamination by spaced-seed hashing, with built-in functions only.

Fixed masks select some of several consecutive words and ignore the others: two pairs of neighbours with a gap between
them. Texts that agree on the selected words agree on the hash, whatever stands in the gap, so a passage with replaced
words still shares seeds with its original. Pairs are hashed once and combined for every mask.
Seeds of the benchmark are joined with seeds of the documents; every hit names a document, an item and the diagonal on
which both align. Around it the aligned words are compared one by one: a document is contaminated by an item if some
stretch of ``window`` aligned words (the whole item if it is shorter) agrees in at least ``least_share`` of them.

Masks find every passage that the comparison accepts in items of ``short_below`` words and more. Shorter ones have seeds
of their own: all their words, and all but one where the share allows one to differ. Documents get seeds of those lengths
only if the benchmark has such items.

Words are runs of letters and digits of any script, in lower case.

Results: one row per document and item that contaminates it, with the best diagonal. Null and empty texts match
nothing. Rows repeated under one id count as one document, found if any of them is; a null id is an id like others.
Empty tables give no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commutelens.llm.shared import unused


@dataclass(frozen=True)
class SeedParams:
    #: Distance of the second pair of words from the first, for each mask.
    gaps: tuple[int, ...] = (3, 5)
    window: int = 16
    least_share: float = 0.8
    #: Items of fewer words are sought by all their words, or all but one.
    short_below: int = 7
    #: Benchmark seeds up to which they are broadcast (some 50 MB); beyond it both sides are shuffled.
    broadcast_seeds: int = 1_000_000


PARAMS = SeedParams()


def word_hashes(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(words, lambda w: F.xxhash64(w))


def _masks(lengths: Sequence[int], params: SeedParams) -> list[tuple[int, tuple[int, ...]]]:
    """(length of the items, selected words) of every mask; length 0 stands for all items that are not short."""
    masks = [(0, (0, 1, gap, gap + 1)) for gap in params.gaps]
    for n in lengths:
        chosen = [tuple(range(n))]
        if n > 1 and (n - 1) / n >= params.least_share:
            # Counted from the first selected word, so that an item may begin before the text or end after it.
            chosen += [tuple(i - (left == 0) for i in range(n) if i != left) for left in range(n)]
        masks += [(n, mask) for mask in dict.fromkeys(chosen)]
    return masks


def with_seeds(rows: DataFrame, lengths: Sequence[int] = (), params: SeedParams = PARAMS) -> DataFrame:
    """Turns ``words`` (hashes) into rows of (seed, at, of): ``of`` is the length of the short items that the seed is for,
    or 0. Arrays are shifted against themselves, which leaves seeds that run over the end; they are dropped by their
    place."""

    def shifted(array: Column | str, other: str, by: int) -> Column:
        return F.zip_with(array, F.slice(other, by + 1, F.greatest(F.size(other), F.lit(1))), lambda x, y: F.xxhash64(x, y))

    masks = _masks(lengths, params)
    others = [c for c in rows.columns if c != "words"]
    paired = rows.withColumn("pairs", shifted("words", "words", 1)).withColumn("size", F.size("words"))
    seeds = [shifted("pairs", "pairs", gap) for gap in params.gaps]
    for n, chosen in masks[len(seeds) :]:
        # The mask's own mark with the first word, then one selected word after the other.
        marks = F.array_repeat(F.xxhash64(F.lit(f"{n}: {chosen}")), F.size("words"))
        seed = F.zip_with(marks, "words", lambda x, y: F.xxhash64(x, y))
        for place in chosen[1:]:
            seed = shifted(seed, "words", place)
        seeds.append(seed)
    listed = paired.select(*others, "size", F.posexplode(F.concat(*seeds)).alias("place", "seed"))
    at, mask = F.col("place") % F.col("size"), F.floor(F.col("place") / F.col("size")).cast("int")
    spans = F.array(*[F.lit(chosen[-1] + 1) for _, chosen in masks])
    listed = listed.filter(at + F.get(spans, mask) <= F.col("size"))
    return listed.select(*others, "seed", at.alias("at"), F.get(F.array(*[F.lit(n) for n, _ in masks]), mask).alias("of"))


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    params: SeedParams = PARAMS,
) -> DataFrame:
    """(doc_id, item_id, start, n_words, n_equal, best): where the item starts in the document's words, how many words
    it has and how many agree, and the best share of a window."""
    is_word = F.xxhash64(F.lit(""))
    items = (
        benchmark.select(F.col(item_id).alias("item_id"), word_hashes(F.col(item_text)).alias("words"))
        .withColumn("words", F.filter("words", lambda w: w != is_word))
        .withColumn("n_words", F.size("words"))
        .filter(F.col("n_words") > 0)
    )
    short = F.col("n_words") < params.short_below
    lengths = sorted(r[0] for r in items.filter(short).select("n_words").distinct().collect())  # below short_below
    own = F.when(short, F.col("n_words")).otherwise(0)
    item_seeds = with_seeds(items.select("item_id", "words", own.alias("own")), lengths, params).filter("own = of")
    item_seeds = item_seeds.select("item_id", "seed", F.col("at").alias("item_at"))
    if item_seeds.count() <= params.broadcast_seeds:
        item_seeds = F.broadcast(item_seeds)
    doc_seeds = with_seeds(docs.select(F.col(doc_id).alias("doc_id"), word_hashes(F.col(text)).alias("words")), lengths, params)
    start = (F.col("at") - F.col("item_at")).alias("start")
    hits = doc_seeds.drop("of").join(item_seeds, "seed").select("doc_id", "item_id", start).distinct()
    texts = docs.select(F.col(doc_id).alias("d_id"), F.col(text).alias("d_text"))
    # Words before the document's first one agree with nothing. The document's words are an argument, not a name inside
    # a function of elements, so they are made once.
    missed = F.greatest(-F.col("start"), F.lit(0))
    found = F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("n_words") - missed)
    meant = F.slice("item_words", missed + 1, F.col("n_words"))
    aligned = (
        hits.join(items.withColumnsRenamed({"item_id": "i_id", "words": "item_words"}), F.col("item_id").eqNullSafe(F.col("i_id")))
        .join(texts, F.col("doc_id").eqNullSafe(F.col("d_id")))
        .select("doc_id", "item_id", "start", "n_words", "item_words", word_hashes(F.col("d_text")).alias("words"))
        .select(
            "doc_id",
            "item_id",
            "start",
            "n_words",
            F.concat(F.array_repeat(F.lit(False), missed), F.zip_with(found, meant, lambda a, b: F.coalesce(a == b, F.lit(False)))).alias(
                "equal"
            ),
            F.least(F.lit(params.window), F.col("n_words")).alias("width"),
        )
    )
    agree = F.transform(
        F.sequence(F.lit(0), F.col("n_words") - F.col("width")),
        lambda s: F.size(F.filter(F.slice(F.col("equal"), s + 1, F.col("width")), lambda e: e)),
    )
    scored = aligned.select(
        "doc_id",
        "item_id",
        "start",
        "n_words",
        F.size(F.filter("equal", lambda e: e)).alias("n_equal"),
        (F.array_max(agree) / F.col("width")).alias("best"),
    ).filter(F.col("best") >= params.least_share)
    top = F.max_by(F.struct("start", "n_words", "n_equal", "best"), F.struct("best", "n_equal", -F.col("start")))
    return scored.groupBy("doc_id", "item_id").agg(top.alias("t")).select("doc_id", "item_id", "t.*")


def clean(docs: DataFrame, benchmark: DataFrame, params: SeedParams = PARAMS) -> DataFrame:
    """Documents that no benchmark item contaminates, with all their columns."""
    name = unused(docs, "found_id")
    found = find(docs, benchmark, params=params).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
