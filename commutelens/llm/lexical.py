"""Exact ranked lexical search by norm buckets.

One pass over the texts leaves a sparse vector per document: its length and how often it holds each term of the queries.
The corpus counts that the weights need are aggregations of these vectors. A document's impact vector has, per term, the
saturated frequency times the root of the term's weight; a query's has its own frequency times the same root, so their
product is the score.

A task takes vectors in blocks of bounded size and orders each block by length into buckets of similar norm, longest first.
Every query keeps its k best so far, over all blocks of the task; the k-th is its bound. By Cauchy-Schwarz a bucket whose
longest vector times the query's norm stays below the bound is out, and so are all shorter buckets after it. Inside a
bucket the query's heaviest coordinates are the focus: what a vector has there, plus the norms of both rests, bounds its
score from above. Focus grows while vectors stay in doubt; those that do not fall below the bound are scored again from
frequencies in 64-bit integers. Bounds are floating-point numbers with room for rounding; scores never are. Vectors are not
moved between tasks, which send their k best per query only.

Queries are taken in blocks of bounded size, each against all documents.

Results: N, L and df count every row of the documents, those without an id too, but only rows with an id are returned, and
only scores above 0. Rows repeated under one id are candidates of their own. Null, empty and wordless texts have no terms:
such documents and queries have no result rows. Queries without an id take no part; of several texts under one id the
smallest counts. Equal scores are ordered by ascending id. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commutelens.llm.shared import written
from commutelens.llm.terms import word_blocks


@dataclass(frozen=True)
class LexicalParams:
    k: int = 10
    #: Distinct (query, term) pairs that one pass over the documents serves.
    terms_per_pass: int = 200_000
    #: Vectors, and terms in them, that a task orders at once.
    block: int = 16_384
    block_terms: int = 4_000_000
    #: Ratio of the longest to the shortest norm in a bucket.
    step: float = 1.3
    #: Coordinates in focus at first; doubled while vectors stay in doubt.
    focus: int = 4


PARAMS = LexicalParams()
#: Fixed values of the score: saturation in thousandths, share of length in percent, scale of a frequency.
SATURATION, LENGTH_SHARE, SCALE = 8, 75, 1_000_000_000


@dataclass(frozen=True)
class Corpus:
    """Number of documents with terms, of all terms, and of documents per query term."""

    documents: int
    terms: int
    holding: np.ndarray

    def weights(self) -> np.ndarray:
        most = 2 * self.documents + 2
        return np.array([floor(1000 * log(most / (2 * df + 1))) for df in self.holding.tolist()], np.int64)


def _counted(text: bytes | None) -> Counter:
    terms: Counter = Counter()
    for words in word_blocks(text):
        terms.update(words)
    return terms


def query_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, term, n): how often each query holds each of its terms."""

    @F.arrow_udf("array<struct<term:binary,n:bigint>>")
    def count(texts: pa.Array) -> pa.Array:
        rows = [[{"term": t, "n": n} for t, n in sorted(_counted(x.as_py()).items())] for x in texts]
        return pa.array(rows, pa.list_(pa.struct([("term", pa.binary()), ("n", pa.int64())])))

    known = items.select(F.col(item_id).cast("bigint").alias("item"), F.col(text).cast("binary").alias("text")).filter("item IS NOT NULL")
    return known.groupBy("item").agg(F.min("text").alias("text")).select("item", F.inline(count("text")))


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with terms: its length, and the vocabulary's terms in it."""
    known = vocabulary.keys()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, terms, tfs = [], [], [], []
            for one, value in zip(batch.column(0), batch.column(1), strict=True):
                counts = _counted(value.as_py())
                if counts:
                    held = sorted(vocabulary[t] for t in counts.keys() & known)
                    names = {vocabulary[t]: counts[t] for t in counts.keys() & known}
                    ids.append(one.as_py())
                    lengths.append(sum(counts.values()))
                    terms.append(held)
                    tfs.append([names[t] for t in held])
            columns = [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64())]
            columns += [pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(count, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


def corpus_of(table: DataFrame, size: int) -> Corpus:
    totals = table.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    holding = np.zeros(size, np.int64)
    for row in table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
        holding[row.term] = row.df
    return Corpus(totals.rows, totals.terms, holding)


class Query:
    """A query's coordinates, heaviest first, and the k best documents met so far."""

    def __init__(self, item: int, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, k: int) -> None:
        size = counts * np.sqrt(weights[terms])
        order = np.argsort(-size, kind="stable")
        self.item, self.k = item, k
        self.terms, self.sizes = terms[order], size[order]
        self.gains = (counts * weights[terms])[order]
        #: Norm of what is left after the first coordinates.
        self.rests = np.sqrt(np.append(np.cumsum((self.sizes**2)[::-1])[::-1], 0.0))
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def bound(self) -> int:
        """Least score that still counts: above 0, and no less than the k-th best."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def keep(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.bound
        scores, ids = np.append(self.scores, scores[good]), np.append(self.ids, ids[good])
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[best], ids[best]


class Block:
    """Impact vectors of documents, longest first, cut into buckets of similar norm."""

    def __init__(self, ids, lengths, ends, terms, tfs, corpus: Corpus, weights: np.ndarray, params: LexicalParams) -> None:
        sizes = np.diff(ends)
        owner = np.repeat(np.arange(len(ids)), sizes)
        short = 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths * corpus.documents) // corpus.terms
        impact = (SCALE * tfs) // (1000 * tfs + SATURATION * short[owner])
        coordinate = impact * np.sqrt(weights[terms])
        norms = np.sqrt(np.bincount(owner, coordinate**2, minlength=len(ids)))
        order = np.argsort(-norms, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.params, self.ids, self.norms = params, ids[order], norms[order]
        # Documents as rows, for exact scores.
        by_row = np.argsort(place[owner], kind="stable")
        self.starts = np.append(0, np.cumsum(sizes[order]))
        self.terms, self.impacts = terms[by_row], impact[by_row]
        # Lists of a term's vectors per bucket, for bounds.
        self.cuts = self._cuts()
        bucket = np.searchsorted(self.cuts, place[owner], side="right") - 1
        self.width = len(weights)
        listed = np.lexsort((place[owner], terms, bucket))
        self.lists = (bucket * self.width + terms)[listed]
        self.listed_place, self.listed_size = place[owner][listed], coordinate[listed]

    def _cuts(self) -> np.ndarray:
        """Where buckets begin, and the end; vectors of norm 0 are in none."""
        cuts, end = [0], int(np.searchsorted(-self.norms, 0.0))
        while cuts[-1] < end:
            least = self.norms[cuts[-1]] / self.params.step
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(-self.norms[:end], -least))))
        return np.array(cuts)

    def visit(self, query: Query, gains: np.ndarray) -> None:
        """Lets a query meet every bucket that may hold one of its best; ``gains`` is a scratch row of zeros."""
        gains[query.terms] = query.gains
        for bucket in range(len(self.cuts) - 1):
            if query.rests[0] * self.norms[self.cuts[bucket]] * (1 + 1e-9) < query.bound:
                break
            self._meet(query, bucket, gains)
        gains[query.terms] = 0

    def _meet(self, query: Query, bucket: int, gains: np.ndarray) -> None:
        start, end = self.cuts[bucket], self.cuts[bucket + 1]
        partial, square = np.zeros(end - start), np.zeros(end - start)
        squares, bound = self.norms[start:end] ** 2, query.bound
        spans = np.searchsorted(self.lists, bucket * self.width + np.stack([query.terms, query.terms + 1]))
        at, focus = 0, self.params.focus
        while True:
            for i in range(at, min(at + focus, len(query.terms))):
                listed = slice(spans[0, i], spans[1, i])
                where, size = self.listed_place[listed] - start, self.listed_size[listed]
                partial[where] += query.sizes[i] * size
                square[where] += size**2
            at, focus = min(at + focus, len(query.terms)), 2 * focus
            rest = query.rests[at] * np.sqrt(np.maximum(squares - square, 0.0)) + 1e-6
            doubtful = np.flatnonzero((partial + rest) * (1 + 1e-9) >= bound)
            # Few doubtful vectors cost less to score than to bound again.
            if at == len(query.terms) or 16 * len(doubtful) <= end - start:
                break
        if len(doubtful):
            query.keep(self._exact(start + doubtful, gains), self.ids[start + doubtful])

    def _exact(self, rows: np.ndarray, gains: np.ndarray) -> np.ndarray:
        sizes = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        entry = np.arange(ends[-1]) + np.repeat(self.starts[rows] - (ends - sizes), sizes)
        return np.add.reduceat(gains[self.terms[entry]] * self.impacts[entry], ends - sizes)


def best(table: DataFrame, asked: list[tuple[int, np.ndarray, np.ndarray]], corpus: Corpus, params: LexicalParams) -> DataFrame:
    """(item_id, doc_id, score): each task's k best vectors for every query."""
    weights = corpus.weights()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [Query(item, terms, counts, weights, params.k) for item, terms, counts in asked]
        held: list[pa.RecordBatch] = []
        scratch = np.zeros(len(weights), np.int64)

        def meet() -> None:
            whole = pa.Table.from_batches(held).combine_chunks()
            ids, lengths = (whole.column(c).to_numpy() for c in ("doc_id", "n"))
            terms, tfs = (whole.column(c).combine_chunks() for c in ("terms", "tfs"))
            ends = terms.offsets.to_numpy()
            flat = [x.flatten().to_numpy().astype(np.int64) for x in (terms, tfs)]
            block = Block(ids, lengths, ends - ends[0], *flat, corpus, weights, params)
            for query in queries:
                block.visit(query, scratch)
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, params.block):
                held.append(batch.slice(at, params.block))
                rows, entries = sum(b.num_rows for b in held), sum(len(b.column(2).flatten()) for b in held)
                if rows >= params.block or entries >= params.block_terms:
                    meet()
        if held:
            meet()
        for query in queries:
            if len(query.ids):
                columns = [pa.array([query.item] * len(query.ids), pa.int64()), pa.array(query.ids), pa.array(query.scores)]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])

    sought = table.filter("doc_id IS NOT NULL AND size(terms) > 0")
    return sought.mapInArrow(search, "item_id bigint, doc_id bigint, score bigint")


def search(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", params: LexicalParams = PARAMS
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents for each item."""
    spark = docs.sparkSession
    asked = written(query_terms(items, item_id, item_text), "asked")
    passes = -(-asked.count() // params.terms_per_pass)
    found = spark.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")
    for turn in range(passes):
        rows = asked.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == turn).orderBy("item", "term").collect()
        vocabulary = {term: i for i, term in enumerate(sorted({bytes(r.term) for r in rows}))}
        table = written(vectors(docs, vocabulary, doc_id, text), "vectors")
        by_item: dict[int, list[tuple[int, int]]] = {}
        for row in rows:
            by_item.setdefault(row.item, []).append((vocabulary[bytes(row.term)], row["n"]))
        queries = [(item, *np.array(pairs, np.int64).T) for item, pairs in by_item.items()]
        found = found.unionByName(best(table, queries, corpus_of(table, len(vocabulary)), params))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= params.k).select("item_id", "rank", "doc_id", "score")
