"""Exact top-k inner products over integer vectors by norm-bucketed retrieval.

Vectors are grouped into buckets by length: geometric steps of the norm, each split evenly into parts of bounded size,
so that equal vectors in any number do not meet in one task. The longest vectors of all, a fixed number, give every
query a first lower bound on its k-th best score. Queries then visit every part in blocks. In a part whose longest
norm is m, a vector can reach the bound t of a query of norm n only at a cosine of at least t / (n m). Above 1, the
part is out for this query (length pruning). Close to 1, the coordinate in which the query is largest bounds the same
coordinate of any such vector, and only vectors inside that range stay (coordinate pruning). Otherwise all stay. What
stays is verified by its product in exact arithmetic.

Results: components are floor(scale * x). Vectors that are null, hold a null or non-finite component, or have no id
take no part. Missing trailing components count as zero, so an empty vector scores zero. A query never meets rows of
its own id; rows repeated under one id are separate candidates, a query repeated under one id is asked once, with the
smallest of its vectors. Ties go to the smaller id. Scores beyond 64 bits count as the largest or smallest number of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TopkParams:
    k: int = 10
    scale: int = 1024
    #: Ratio of the longest to the shortest norm in a bucket.
    step: float = 1.05
    #: Vectors in a part (held by a task), in a page of it (scored at once), and among the longest of all.
    part: int = 32768
    page: int = 2048
    longest: int = 2048
    #: Local cosine from which the coordinate test pays.
    coordinate_from: float = 0.6


PARAMS = TopkParams()
_MATCHES = "query_id bigint, vec_id bigint, score bigint"


def _packed(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v: whole numbers as packed doubles, norm) of the rows that take part."""

    @F.arrow_udf("struct<v:binary,norm:double>")
    def pack(vectors: pa.Array) -> pa.Array:
        rows = []
        for x in vectors:
            if not x.is_valid or x.values.null_count:
                rows.append(None)
                continue
            v = np.floor(scale * x.values.to_numpy(zero_copy_only=False).astype(np.float64))
            size = np.abs(v).max(initial=0.0)
            norm = float(size * np.linalg.norm(v / size)) if 0 < size < np.inf else 0.0
            rows.append({"v": v.tobytes(), "norm": norm} if np.isfinite(v).all() else None)
        return pa.array(rows, pa.struct([("v", pa.binary()), ("norm", pa.float64())]))

    packed = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), pack(F.col(vector)).alias("p"))
    return packed.filter(F.col("vec_id").isNotNull() & F.col("p").isNotNull()).select("vec_id", "p.v", "p.norm")


def _matrix(rows: list[bytes]) -> np.ndarray:
    width = max(map(len, rows), default=0) // 8
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        values = np.frombuffer(row)
        out[i, : len(values)] = values
    return out


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers; a matrix product of doubles where it cannot round."""
    width = min(queries.shape[1], vectors.shape[1])
    if not width or not len(queries) or not len(vectors):
        return np.zeros((len(queries), len(vectors)), np.int64)
    queries, vectors = queries[:, :width], vectors[:, :width]
    if np.abs(queries).max() * np.abs(vectors).max() * width < 2**53:
        return (queries @ vectors.T).astype(np.int64)
    exact = np.array([[int(x) for x in q] for q in queries], object) @ np.array([[int(x) for x in v] for v in vectors], object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller id; ids ascend."""
    if len(scores) > k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > limit)
        return np.concatenate([above, np.flatnonzero(scores == limit)[: k - len(above)]])
    return np.arange(len(scores))


class Part:
    """Vectors of similar length, and how a query visits them."""

    def __init__(self, ids: np.ndarray, rows: list[bytes], norms: np.ndarray, params: TopkParams) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.norms, self.params = ids[order], norms[order], params
        self.vectors = _matrix([rows[i] for i in order])
        self.top = float(norms.max(initial=0.0))

    def visit(self, ids: np.ndarray, rows: list[bytes], norms: np.ndarray, bounds: list[int | None]) -> Iterator[tuple]:
        params, queries = self.params, _matrix(rows)
        width = min(queries.shape[1], self.vectors.shape[1])
        whole, picked = [], []
        for i, bound in enumerate(bounds):
            reach = norms[i] * self.top
            cosine = bound / reach if bound is not None and reach else -1.0
            if bound is not None and bound > reach * (1 + 1e-9):
                continue
            (picked if params.coordinate_from <= cosine <= 1 and width else whole).append((i, cosine))
        for at in range(0, len(self.ids), params.page):
            page = slice(at, at + params.page)
            if whole:
                chosen = [i for i, _ in whole]
                for i, scores in zip(chosen, _products(queries[chosen], self.vectors[page]), strict=True):
                    yield from self._kept(ids[i], bounds[i], scores, self.ids[page])
            for i, cosine in picked:
                inside = at + self._inside(queries[i, :width] / norms[i], cosine, page)
                scores = _products(queries[i : i + 1], self.vectors[inside])[0]
                yield from self._kept(ids[i], bounds[i], scores, self.ids[inside])

    def _inside(self, direction: np.ndarray, cosine: float, page: slice) -> np.ndarray:
        """Vectors whose coordinate along the query's largest one is within reach of the local cosine."""
        focus = int(np.argmax(np.abs(direction)))
        angle, slack = np.arccos(np.clip(direction[focus], -1, 1)), np.arccos(min(cosine, 1.0))
        low, high = np.cos(min(np.pi, angle + slack)), np.cos(max(0.0, angle - slack))
        share = self.vectors[page, focus] / np.maximum(self.norms[page], 1e-300)
        return np.flatnonzero((share >= low - 1e-9) & (share <= high + 1e-9))

    def _kept(self, query: int, bound: int | None, scores: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
        others = ids != query
        if bound is not None:
            others &= scores >= bound
        scores, ids = scores[others], ids[others]
        for i in _best(scores, ids, self.params.k):
            yield int(query), int(ids[i]), int(scores[i])


def _with_parts(vectors: DataFrame, params: TopkParams) -> tuple[DataFrame, int]:
    """Adds ``part``: a bucket by norm, split by a hash of id and vector. The number of buckets is bounded by the range
    of doubles, whatever the number of vectors."""
    bucket: Column = F.when(F.col("norm") > 0, F.floor(F.log("norm") / float(np.log(params.step)))).otherwise(-(1 << 30))
    vectors = vectors.withColumn("bucket", bucket.cast("bigint"))
    sizes = sorted((r.bucket, r["n"]) for r in vectors.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect())
    plan, first = [], 0
    for name, n in sizes:
        parts = -(-n * 5 // (params.part * 4))  # hashing is uneven: a quarter of room
        plan.append((name, first, parts))
        first += parts
    layout = vectors.sparkSession.createDataFrame(plan, "bucket bigint, first bigint, parts bigint")
    part = F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))
    return vectors.join(layout, "bucket").select("vec_id", "v", "norm", part.alias("part")), first


def top_k(
    df: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", params: TopkParams = PARAMS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row that ``is_query`` (on the id) selects."""
    vectors = _packed(df, vec_id, vector, params.scale)
    asked = _packed(df.filter(is_query), vec_id, vector, params.scale)
    queries = asked.groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("q")).select("vec_id", "q.v", "q.norm")
    longest = vectors.orderBy(F.desc("norm"), "vec_id").limit(params.longest).collect()
    seeds = ([r.vec_id for r in longest], [bytes(r.v) for r in longest], [r.norm for r in longest])
    placed, parts = _with_parts(vectors, params)

    @F.arrow_udf("bigint")
    def bound_of(ids: pa.Array, rows: pa.Array) -> pa.Array:
        first, bounds = Part(np.array(seeds[0]), seeds[1], np.array(seeds[2]), params), []
        for query, row in zip(ids.to_pylist(), rows.to_pylist(), strict=True):
            scores = _products(_matrix([row]), first.vectors)[0][first.ids != query]
            enough = len(scores) >= params.k
            bounds.append(int(np.partition(scores, len(scores) - params.k)[len(scores) - params.k]) if enough else None)
        return pa.array(bounds, pa.int64())

    visits = queries.withColumn("bound", bound_of("vec_id", "v")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>"))
    )
    meeting = placed.withColumns({"bound": F.lit(None).cast("bigint"), "asks": F.lit(False)}).unionByName(
        visits.withColumn("asks", F.lit(True))
    )

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, part, held = None, None, ([], [], [])
        for batch in batches:
            rows = batch.to_pydict()
            start = 0
            while start < batch.num_rows:
                name, asks = rows["part"][start], rows["asks"][start]
                stop = start
                while stop < batch.num_rows and rows["part"][stop] == name and rows["asks"][stop] == asks:
                    stop += 1
                if name != part:
                    current, part, held = None, name, ([], [], [])
                ids, packed, norms = (rows[c][start:stop] for c in ("vec_id", "v", "norm"))
                if not asks:
                    for column, values in zip(held, (ids, packed, norms), strict=True):
                        column.extend(values)
                else:
                    if current is None:
                        current = Part(np.array(held[0], np.int64), held[1], np.array(held[2], float), params)
                        held = ([], [], [])
                    for at in range(0, len(ids), 512):
                        cut = slice(at, at + 512)
                        bounds = rows["bound"][start:stop][cut]
                        found = [*current.visit(np.array(ids[cut]), packed[cut], np.array(norms[cut]), bounds)]
                        columns = zip(*found, strict=True) if found else ((), (), ())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"]
                        )
                start = stop

    met = meeting.repartition(max(parts, 1), "part").sortWithinPartitions("part", "asks")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = met.mapInArrow(match, _MATCHES).withColumn("rank", rank).filter(F.col("rank") <= params.k)
    return best.select("query_id", "rank", "vec_id", "score")
