"""Exact substring deduplication with suffix arrays built by induced sorting.

Every byte of a document that is covered by a string of ``length`` bytes which also starts in a document with a smaller
id is removed. Whole-corpus suffix arrays do not fit a task, so what can match at all is found first and sorted in
shards of bounded size:

1. Every window of ``length`` bytes names one anchor inside it, the gram with the smallest hash. Equal windows name
   equal anchors, so windows can only match where anchors do. Anchors that occur in one document only are dropped.
2. Each anchor has a leader, the smallest document that holds it. Neighbouring anchors with the same leader form a
   segment; segments of a leader go to one shard, equal ones once. A leader with too much text for one shard is split
   by anchor, which keeps equal windows together.
3. A shard's suffix array is built by induced sorting, up to the length asked for: suffixes are classified, the leftmost
   smaller ones are sorted by their substrings (recursively where those are of few kinds, else by doubling ranks), and the
   rest of the array is induced from them in linear time. Common prefixes with the neighbour in the array are computed in
   text order (permuted), up to the same length.
4. Runs of the array that agree in ``length`` bytes are equal windows; the smallest document of a run decides which of
   its occurrences are covered. Covered stretches go back to their documents and are united.

Results: null and empty texts have no bytes. Rows without id keep everything and cover nothing. Rows repeated under one
id do not cover each other. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commutelens.llm.shared import written


@dataclass(frozen=True)
class SuffixParams:
    length: int = 50
    gram: int = 22
    #: Anchors per block of documents; documents of a block that make an anchor frequent in it.
    block: int = 1_000_000
    frequent: int = 8
    #: Lists of anchors are exchanged by this many parts of the hash.
    bucket_bits: int = 12
    #: Bytes of a leader beyond which it is split; shards of small leaders are closed at half of it.
    shard: int = 4 << 20


PARAMS = SuffixParams()

_PIECE = 1 << 19
_FACTOR = 0xD6E8FEB86659FD93
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_OF_BYTE = np.random.default_rng(20240103).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_HASH_BITS = 60


# --- anchors ------------------------------------------------------------------------------------------------------


def _powers(factor: int, size: int) -> np.ndarray:
    table = np.full(size, factor, np.uint64)
    table[0] = 1
    return np.cumprod(table, dtype=np.uint64)


_UP, _DOWN = (_powers(f, _PIECE * 4) for f in (_FACTOR, _INVERSE))


def _mixed(x: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def _named(data: bytes, params: SuffixParams) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchor of every window of a block of bytes. The place of the first smallest gram rides in
    the low bits of what is minimised."""
    codes = np.frombuffer(data, np.uint8)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_OF_BYTE[codes] * _UP[: len(codes)], out=sums[1:])
    grams = len(codes) - params.gram + 1
    hashes = _mixed((sums[params.gram :] - sums[:grams]) * _DOWN[:grams])
    bits = np.uint64(int(grams).bit_length())
    least = (hashes >> bits << bits) | np.arange(grams, dtype=np.uint64)
    width, done = params.length - params.gram + 1, 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    places = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return places, hashes[places] >> np.uint64(64 - _HASH_BITS)


def anchors(texts: Iterable[bytes], params: SuffixParams) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the text, hash, first, last) of runs of windows with one anchor; a long text comes in several parts."""

    def runs(data: bytes, parts: list[tuple[int, int, int, int]]):
        if len(data) < params.length:
            return
        places, hashes = _named(data, params)
        edges = np.flatnonzero(np.diff(places)) + 1
        for number, begin, end, offset in parts:  # windows that start in [begin, end)
            if end > begin:
                firsts = np.concatenate([[begin], edges[np.searchsorted(edges, begin, "right") : np.searchsorted(edges, end)]])
                lasts = np.concatenate([firsts[1:] - 1, [end - 1]])
                yield number, hashes[firsts], firsts - begin + offset, lasts - begin + offset

    held, parts, size = [], [], 0
    for number, text in enumerate(texts):
        if len(text) > _PIECE:
            for at in range(0, len(text) - params.length + 1, _PIECE):
                piece = text[at : at + _PIECE + params.length - 1]
                yield from runs(piece, [(number, 0, len(piece) - params.length + 1, at)])
            continue
        if size + len(text) > _PIECE:
            yield from runs(b"".join(held), parts)
            held, parts, size = [], [], 0
        held.append(text)
        parts.append((number, size, size + len(text) - params.length + 1, 0))
        size += len(text)
    yield from runs(b"".join(held), parts)


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _planes(values: np.ndarray, width: int) -> bytes:
    """Lowest bytes of 64-bit numbers, one plane after the other, which compresses well."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(planes: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def _blocks(batches: Iterator[pa.RecordBatch], params: SuffixParams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, document, frequent) of the distinct pairs of blocks of documents, in order of hash."""
    hashes, docs, size = [], [], 0

    def block():
        h, d = np.concatenate(hashes), np.concatenate(docs)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
        h, d = h[new], d[new]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        counts = np.diff(np.r_[starts, len(h)])
        return h, d, np.repeat(counts >= params.frequent, counts)

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for number, found, _, _ in anchors(_bytes(batch.column(1)), params):
            found = np.unique(found)
            hashes.append(found)
            docs.append(np.full(len(found), ids[number], np.int64))
            size += len(found)
            if size >= params.block:
                yield block()
                hashes, docs, size = [], [], 0
    if hashes:
        yield block()


def _shared_anchors(docs: DataFrame, params: SuffixParams) -> DataFrame:
    """(doc_id, anchor, leader) of anchors in two documents or more.

    Anchors travel as packed lists. One that is frequent within a block sends a single entry, and its documents learn
    the leader by a join, which splits hot keys.
    """
    shift = np.uint64(_HASH_BITS - params.bucket_bits)
    width = -(-(_HASH_BITS - params.bucket_bits) // 8)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, d, frequent in _blocks(batches, params):
            first = np.r_[True, h[1:] != h[:-1]]
            for summary, chosen in ((False, ~frequent), (True, frequent & first)):
                hs, ds = h[chosen], d[chosen].astype(np.uint64)
                names, starts = np.unique(hs >> shift, return_index=True)
                ends = np.r_[starts, len(hs)][1:]
                low = hs & ((np.uint64(1) << shift) - np.uint64(1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names.astype(np.int64)),
                        pa.array([summary] * len(names), pa.bool_()),
                        pa.array([_planes(low[a:b], width) for a, b in zip(starts, ends, strict=True)], pa.binary()),
                        pa.array([_planes(ds[a:b], 8) for a, b in zip(starts, ends, strict=True)], pa.binary()),
                    ],
                    names=["bucket", "summary", "anchors", "docs"],
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def leaders() -> pa.RecordBatch:
            h = np.concatenate([_numbers(r["anchors"], width) for r in held]) | np.uint64(name) << shift
            d = np.concatenate([_numbers(r["docs"], 8) for r in held]).astype(np.int64)
            summary = np.concatenate([np.full(len(r["anchors"]) // width, r["summary"]) for r in held])
            order = np.lexsort((d, h))
            h, d, summary = h[order], d[order], summary[order]
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            counts = np.diff(np.r_[starts, len(h)])
            shared = (d[starts] != d[starts + counts - 1]) | np.logical_or.reduceat(summary, starts)
            leader, chosen = np.repeat(d[starts], counts), np.repeat(shared, counts)
            chosen &= ~summary | np.r_[True, h[1:] != h[:-1]] | np.r_[True, ~summary[:-1]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(d[chosen], mask=summary[chosen]),
                    pa.array(h[chosen].astype(np.int64)),
                    pa.array(leader[chosen]),
                ],
                names=["doc_id", "anchor", "leader"],
            )

        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != name and held:
                    yield leaders()
                    held = []
                name = row["bucket"]
                held.append(row)
        if held:
            yield leaders()

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, d, frequent in _blocks(batches, params):
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[frequent].astype(np.int64)), pa.array(d[frequent])], names=["a", "doc_id"]
            )

    met = (
        docs.select("doc_id", "text")
        .mapInArrow(pack, "bucket bigint, summary boolean, anchors binary, docs binary")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(meet, "doc_id bigint, anchor bigint, leader bigint")
    )
    met = written(met, "anchors")
    told = met.filter("doc_id IS NULL").select("anchor", "leader").distinct()
    hot = docs.select("doc_id", "text").mapInArrow(often, "a bigint, doc_id bigint").join(told, F.col("a") == F.col("anchor"))
    return met.filter("doc_id IS NOT NULL").unionByName(written(hot.select("doc_id", "anchor", "leader"), "hot_anchors"))


# --- suffix arrays ------------------------------------------------------------------------------------------------


def _classified(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the end of the text is smaller than everything."""
    step = np.zeros(len(text), np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    step[-1] = -1
    places = np.where(step != 0, np.arange(len(text)), len(text))
    following = np.minimum.accumulate(places[::-1])[::-1]
    return step[following] > 0


def _induced_by_bucket(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """Suffix array from sorted leftmost smaller suffixes, whole buckets of a small alphabet at a time.

    Upwards, a bucket's larger suffixes are those induced by lower buckets, then those they induce in the same bucket,
    round by round, which is the order in which a scan would write them. Downwards, smaller suffixes follow alike.
    """
    n = len(text)
    # Sorting by radix, as numpy does for one and two bytes.
    text = text.astype(np.uint8 if size <= 1 << 8 else np.uint16 if size <= 1 << 16 else np.int64)

    def spread(sources: np.ndarray, want: bool, waiting: list[list[np.ndarray]]) -> None:
        before = sources[sources > 0] - 1
        before = before[smaller[before] == want]
        keys = text[before]
        order = np.argsort(keys, kind="stable")
        before, keys = before[order], keys[order]
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for part in np.split(before, cuts) if len(before) else ():
            waiting[text[part[0]]].append(part)

    seeds = np.split(lms[np.argsort(text[lms], kind="stable")], np.searchsorted(np.sort(text[lms]), np.arange(1, size)))
    larger: list[list[np.ndarray]] = [[] for _ in range(size)]
    larger[text[n - 1]].append(np.array([n - 1]))  # induced by the end of the text
    lower: list[np.ndarray] = []
    for c in range(size):
        at = 0
        while at < len(larger[c]):
            batch = np.concatenate(larger[c][at:])
            at = len(larger[c])
            spread(batch, False, larger)
        lower.append(np.concatenate(larger[c]) if larger[c] else np.zeros(0, np.int64))
        spread(seeds[c], False, larger)
    upper: list[list[np.ndarray]] = [[] for _ in range(size)]
    out = []
    for c in range(size - 1, -1, -1):
        at = 0
        while at < len(upper[c]):
            batch = np.concatenate(upper[c][at:])
            at = len(upper[c])
            spread(batch, True, upper)
        if upper[c]:
            out.append(np.concatenate(upper[c]))
        out.append(lower[c][::-1])
        spread(lower[c][::-1], True, upper)
    return np.concatenate(out)[::-1]


def _induced_one_by_one(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The same for large alphabets, where buckets hold few suffixes: one scan in either direction."""
    n, t = len(text), text.tolist()
    counts = np.bincount(text, minlength=size)
    ends = np.cumsum(counts).tolist()
    heads = (np.cumsum(counts) - counts).tolist()
    # First character of the suffix one to the left if it is of the kind a scan writes, else -1; n marks an empty place.
    larger_before, smaller_before = np.full(n + 1, -1), np.full(n + 1, -1)
    larger_before[1:n] = np.where(smaller[:-1], -1, text[:-1])
    smaller_before[1:n] = np.where(smaller[:-1], text[:-1], -1)
    array, tails = [n] * n, ends.copy()
    for i in reversed(lms.tolist()):
        tails[t[i]] -= 1
        array[tails[t[i]]] = i
    head = heads[t[n - 1]]
    array[head] = n - 1
    heads[t[n - 1]] = head + 1
    before = larger_before.tolist()
    for i in array:
        c = before[i]
        if c >= 0:
            head = heads[c]
            array[head] = i - 1
            heads[c] = head + 1
    before = smaller_before.tolist()
    for i in reversed(array):
        c = before[i]
        if c >= 0:
            ends[c] = tail = ends[c] - 1
            array[tail] = i - 1
    return np.array(array)


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of a text over a large alphabet in order of their first ``depth`` letters at least: what
    agrees so far is ordered by the rank of what follows, twice as far each time."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    new = np.r_[True, np.diff(names[order]) != 0]
    rank, places, known = np.empty(n, np.int64), np.arange(n), 1
    while True:
        counts = np.diff(np.r_[np.flatnonzero(new), len(places)])
        rank[order[places]] = np.repeat(places[new], counts)
        places = places[np.repeat(counts > 1, counts)]
        if not len(places) or known >= depth:
            return order
        items = order[places]
        after = items + known
        keys = rank[items] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        sorting = np.argsort(keys, kind="stable")
        order[places] = items[sorting]
        new = np.r_[True, np.diff(keys[sorting]) != 0]
        known *= 2


def suffix_array(text: np.ndarray, size: int, depth: int | None = None) -> np.ndarray:
    """Starts of the suffixes of a text over 0 .. size - 1 in order, or in order of their first ``depth`` letters."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    smaller = _classified(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    induced = _induced_by_bucket if size * 64 <= n else _induced_one_by_one
    if len(lms) > 1:
        first = induced(text, smaller, lms, size)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ordered = first[is_lms[first]]
        names = np.empty(n, np.int64)
        names[ordered] = np.cumsum(np.r_[0, _differ(text, smaller, lms, ordered)])
        reduced = names[lms]
        kinds = int(reduced.max()) + 1
        if kinds < len(lms):
            # A name stands for two letters at least.
            depth = len(lms) if depth is None else depth // 2 + 1
            lms = lms[suffix_array(reduced, kinds, depth) if kinds * 64 <= len(lms) else _doubled(reduced, depth)]
        else:
            lms = ordered
    return induced(text, smaller, lms, size)


def _differ(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each leftmost smaller substring differs from the one before it in order."""
    ends = np.r_[lms[1:], len(text) - 1]
    length = np.zeros(len(text), np.int64)
    length[lms] = ends - lms + 1
    a, b = ordered[:-1], ordered[1:]
    differ = length[a] != length[b]
    last = lms[-1]  # its substring runs into the end of the text, which no other does
    differ |= (a == last) | (b == last)
    active = np.flatnonzero(~differ)
    depth = 0
    while len(active):
        x, y = a[active] + depth, b[active] + depth
        unequal = (text[x] != text[y]) | (smaller[x] != smaller[y])
        differ[active[unequal]] = True
        active = active[~unequal]
        depth += 1
        active = active[length[a[active]] > depth]
    return differ


def permuted_prefixes(text: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix, up to ``most``, of every suffix with the one before it in the array; in text order,
    eight bytes at a time."""
    n = len(text)
    before = np.full(n, -1)
    before[array[1:]] = array[:-1]
    padded = np.zeros(n + most + 16, np.uint8)
    padded[:n] = text
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    words = np.ascontiguousarray(words[: n + most + 8]).view("<u8").ravel()
    common = np.zeros(n, np.int64)
    active = np.flatnonzero(before >= 0)
    for depth in range(0, most, 8):
        x, y = words[active + depth], words[before[active] + depth]
        same = x == y
        rest = active[~same]
        odd = (x ^ y)[~same]
        low = odd & (~odd + np.uint64(1))
        common[rest] = depth + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        active = active[same]
        common[active] = depth + 8
    return np.minimum(common, most)


def covered(segments: list[bytes], docs: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(segment, first, last, document): stretches of windows of a segment and the smallest document that any equal
    window of the shard belongs to. ``docs`` has the smallest document of each segment."""
    # A zero byte between segments may also occur in them; windows that reach a border are left out by their place.
    text = np.frombuffer(b"\0".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments])
    begins = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(segments)), sizes + 1)[: len(text)]
    whole = begins[owner] + sizes[owner] - np.arange(len(text)) >= length
    array = suffix_array(text.astype(np.int64), 256, length)
    common = permuted_prefixes(text, array, length)[array]
    run = np.cumsum(common < length) - 1
    least = np.full(run[-1] + 1, np.iinfo(np.int64).max)
    inside = whole[array]
    np.minimum.at(least, run[inside], docs[owner[array[inside]]])
    first = np.empty(len(text), np.int64)
    first[array] = least[run]
    places = np.flatnonzero(whole)
    new = np.r_[True, (np.diff(places) > 1) | (np.diff(owner[places]) != 0) | (np.diff(first[places]) != 0)]
    starts = places[new]
    lasts = np.r_[places[np.flatnonzero(new)[1:] - 1], places[-1]]
    for a, b in zip(starts.tolist(), lasts.tolist(), strict=True):
        s = int(owner[a])
        yield s, a - int(begins[s]), b - int(begins[s]), int(first[a])


# --- distributed --------------------------------------------------------------------------------------------------

_SEGMENT = "leader bigint, part bigint, key_a bigint, key_b bigint, doc_id bigint, mark bigint, at bigint, bytes binary"


def _segments(docs: DataFrame, routes: DataFrame, params: SuffixParams) -> DataFrame:
    """Stretches of documents that follow one leader (and part of it), with a 128-bit fingerprint of their bytes."""
    weight = routes.groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") * (params.length - params.gram) / 2 / params.shard)
    # Written, so that Spark knows how few there are and need not move all routes for them.
    heavy = written(weight.select(F.col("leader").alias("heavy"), parts.alias("parts")).filter("parts > 1"), "heavy")
    listed = (
        routes.join(heavy, F.col("leader") == F.col("heavy"), "left")
        .groupBy(F.col("doc_id").alias("r_id"))
        .agg(
            F.collect_list(
                F.struct("anchor", "leader", F.coalesce(F.pmod("anchor", "parts"), F.lit(0)).cast("bigint").alias("part"))
            ).alias("route")
        )
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts, routed = _bytes(batch.column(2)), batch.column(3)
            rows: list[tuple] = []
            for number, hashes, firsts, lasts in anchors(texts, params):
                route = routed[number].values
                known, lead, part = (route.field(i).to_numpy() for i in range(3))
                order = np.argsort(known, kind="stable")
                places = np.minimum(np.searchsorted(known[order], hashes.astype(np.int64)), len(known) - 1)
                chosen = order[places]
                on = known[chosen] == hashes.astype(np.int64)
                name = np.where(on, lead[chosen], -1), np.where(on, part[chosen], -1)
                new = np.r_[True, (np.diff(name[0]) != 0) | (np.diff(name[1]) != 0) | (np.diff(on) != 0)]
                starts = np.flatnonzero(new)
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(on)], strict=True):
                    if on[a]:
                        at = int(firsts[a])
                        rows.append((int(name[0][a]), int(name[1][a]), ids[number], marks[number], at, texts[number][at : int(lasts[b - 1]) + params.length]))
            columns = [*zip(*rows, strict=True)] if rows else [()] * 6
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["leader", "part", "doc_id", "mark", "at", "bytes"],
            )

    cut_rows = docs.join(listed, F.col("doc_id") == F.col("r_id")).select("doc_id", "mark", "text", "route")
    return cut_rows.mapInArrow(cut, "leader bigint, part bigint, doc_id bigint, mark bigint, at bigint, bytes binary").select(
        "leader", "part", F.xxhash64("bytes").alias("key_a"), F.xxhash64(F.lit(1), "bytes").alias("key_b"), "doc_id", "mark", "at", "bytes"
    )


_KEYS = ["leader", "part", "key_a", "key_b"]


def _covers(segments: DataFrame, params: SuffixParams) -> DataFrame:
    """(leader, part, key_a, key_b, first, last, by): stretches of windows of distinct segments, and the smallest
    document that holds them, where a larger one does too."""
    distinct = segments.groupBy(*_KEYS).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("bytes").alias("bytes"))

    def sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, group = [], 0, None

        def shard() -> pa.RecordBatch:
            low = np.array([r["low"] for r in held], np.int64)
            found = [
                (*(held[s][k] for k in _KEYS), a, b, by)
                for s, a, b, by in covered([r["bytes"] for r in held], low, params.length)
                if by < held[s]["high"]
            ]
            columns = zip(*found, strict=True) if found else [()] * 7
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=[*_KEYS, "first", "last", "by"]
            )

        for batch in batches:
            for row in batch.to_pylist():
                now = (row["leader"], row["part"])
                if now != group and size >= params.shard // 2:
                    yield shard()
                    held, size = [], 0
                group = now
                held.append(row)
                size += len(row["bytes"])
        if held:
            yield shard()

    return (
        distinct.repartition("leader", "part")
        .sortWithinPartitions("leader", "part")
        .mapInArrow(sort_shards, ", ".join(f"{c} bigint" for c in [*_KEYS, "first", "last", "by"]))
    )


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", params: SuffixParams = PARAMS) -> DataFrame:
    """(doc_id, n_bytes, removed array<struct<start, end>>, kept binary) for every row; offsets in bytes."""
    docs = df.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("mark", F.xxhash64("text"))
    able = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= params.length))
    segments = written(_segments(able, _shared_anchors(able, params), params), "segments")
    covers = _covers(segments, params).withColumnsRenamed({k: f"c_{k}" for k in _KEYS})
    spans = (
        segments.drop("bytes")
        .join(covers, [F.col(k) == F.col(f"c_{k}") for k in _KEYS])
        .filter(F.col("by") < F.col("doc_id"))
        .select(
            F.col("doc_id").alias("s_id"),
            F.col("mark").alias("s_mark"),
            F.struct((F.col("at") + F.col("first")).alias("start"), (F.col("at") + F.col("last") + params.length).alias("end")).alias("span"),
        )
        .groupBy("s_id", "s_mark")
        .agg(F.collect_set("span").alias("spans"))
    )

    @F.arrow_udf("struct<removed:array<struct<start:bigint,end:bigint>>,kept:binary>")
    def cut_out(texts: pa.Array, found: pa.Array) -> pa.Array:
        rows = []
        for data, spans_ in zip(_bytes(texts), found.to_pylist(), strict=True):
            united: list[list[int]] = []
            for span in sorted(spans_ or (), key=lambda s: s["start"]):
                if united and span["start"] <= united[-1][1]:
                    united[-1][1] = max(united[-1][1], span["end"])
                else:
                    united.append([span["start"], span["end"]])
            edges = [0, *(e for span in united for e in span), len(data)]
            kept = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
            rows.append({"removed": [{"start": a, "end": b} for a, b in united], "kept": kept})
        span_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.array(rows, pa.struct([("removed", span_kind), ("kept", pa.binary())]))

    joined = docs.join(spans, (F.col("doc_id") == F.col("s_id")) & (F.col("mark") == F.col("s_mark")), "left")
    return joined.select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), cut_out(F.col("text"), F.col("spans")).alias("c")
    ).select("doc_id", "n_bytes", "c.removed", "c.kept")
