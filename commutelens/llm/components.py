"""Connected components of links between ids, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commutelens.llm.shared import written


def _towards_smallest(pairs: DataFrame) -> DataFrame:
    """Adds to each (u, v) the smallest of u and all its v; a hub's rows are joined back rather than collected."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).withColumnRenamed("u", "u_")
    return pairs.join(least, F.col("u") == F.col("u_")).drop("u_")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every id in a link, root being the smallest id it can reach.

    Each round first sends larger neighbours, then smaller ones, to the smallest; the number of rounds grows with the
    logarithm of the longest path. A round's edges are written, so lineage does not grow.
    """
    ends = (F.col(a), F.col(b))
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(*ends).alias("u"), F.least(*ends).alias("v")).distinct()
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _towards_smallest(large)
        edges = written(
            small.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
            .filter("u > v")
            .distinct(),
            "links",
        )
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        seen = now
