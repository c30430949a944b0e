"""Spans found in texts: array<struct<kind, start, end, base>>, offsets in code points, end exclusive."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind, start, end, whether the plain patterns found it
Span = tuple[str, int, int, bool]

SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
)


def found_in(text: Column, find: Callable[[str], list[Span]]) -> Column:
    """Spans of a text column; null and empty texts have none."""

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        rows = [
            [{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in find(t)] if (t := x.as_py()) else []
            for x in texts
        ]
        return pa.array(rows, _ARROW)

    return scan(text)


def in_order(spans: Iterable[Span], kinds: Sequence[str]) -> list[Span]:
    place = {kind: i for i, kind in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[1], place[s[0]], s[2]))


def free_of(spans: Iterable[Span]) -> Callable[[int, int], bool]:
    """Test whether a stretch overlaps none of the spans."""
    starts: list[int] = []
    ends: list[int] = []
    for _, start, end, _ in sorted(spans, key=lambda s: s[1:3]):
        if starts and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)

    def is_free(start: int, end: int) -> bool:
        at = bisect_left(starts, end)
        return at == 0 or ends[at - 1] <= start

    return is_free


def masked(text: str, spans: Iterable[Span], mask: Callable[[str], str]) -> str:
    """Text with spans replaced by a mask of their kind; of overlapping spans the first one's mask stands for all."""
    parts, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            parts += [text[at:start], mask(kind)]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def digest_columns(found: DataFrame, counted: Sequence[str], spans: str = "spans") -> DataFrame:
    """doc_id, n_<kind> of the plain patterns, base_sha256 over them and all spans as text."""

    def listed(rows: Column) -> Column:
        return F.array_join(
            F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
            ",",
        )

    def plain_of(kind: str) -> Column:
        return F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))

    base = F.filter(spans, lambda s: s["base"])
    return found.select(
        "doc_id",
        *[F.size(plain_of(kind)).cast("bigint").alias(f"n_{kind}") for kind in counted],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col(spans)).alias("spans"),
    )
