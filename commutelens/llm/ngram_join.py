"""N-gram Jaccard join of documents by prefix trees.

A document's n-gram set is a sorted array of tokens. Tokens are ordered the same way everywhere: first by how common
they are, then by hash. Two sets as similar as asked share a token among the first few of either (the prefix), so
documents are candidates only where prefixes meet. Common tokens are those that repeat within a block of documents;
their counts go into a table of fixed size, which makes frequent passages last in every set, whatever the corpus.
With a prefix longer by k - 1 tokens similar sets share at least k tokens of their prefixes (k grows with the set).

A document that shares fewer tokens with all others together than it must with one takes no further part.
Documents that share a prefix token go to the token's leader, the smallest id among them. Most tokens of a group of
copies have the same leader, so a document travels to few leaders rather than once per token. In small groups pairs are
counted first, by numbers alone, and only those that may share k tokens over all leaders meet, at one of them. In large
groups a document stays away from leaders with which it shares fewer than k tokens, unless so many of its tokens are
spread that way that a similar one might be missed, and where no other member is near in size. Prefixes go to the leaders
first: what two of
them share, and the fewer of the tokens behind both, bounds the overlap of the whole sets. Only members that this bound
leaves a partner send their texts. At the leader the sets are stored in a trie by global order. A probe walks it depth first, carrying the overlap counted so far along the path it shares
with the set before, and leaves a subtree when the tokens that remain on either side cannot reach the overlap needed.

Groups are cut into chunks. A chunk is joined with itself and with the leader; members that end up connected to the
leader need no further comparison, as the others of the group are connected to it too or look for their links
themselves. Only members that stay loose in a group of several chunks meet the other chunks, two chunks at a time. Before
a trie is walked, the overlaps of all pairs at hand are counted at once by matrix products, and only probes with a partner
walk it. Links within a chunk are
emitted as a spanning forest, so no group of copies becomes all its pairs. Equal sets are one node from the start.

Results: documents without words have no n-grams and link with nothing; fewer words than n form one n-gram. Rows
without id take no part and have no component. Rows repeated under one id are one document, linked with whatever any of
them is linked with. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commutelens.llm.components import components
from commutelens.llm.shared import unused, written
from commutelens.llm.worker import at_work


@dataclass(frozen=True)
class JoinParams:
    words: int = 5
    #: Least similarity in percent.
    percent: int = 80
    #: Members of a group that are compared at once, and n-grams in them on average.
    chunk: int = 512
    chunk_grams: int = 2_000_000
    #: Cells of the table of common tokens, tokens per block, and repeats in a block that make a token common.
    cells: int = 1 << 18
    block: int = 4_000_000
    repeats: int = 4
    #: Prefixes are longer than they need be for one common token, by a fixed number and a share in percent.
    meet: int = 4
    meet_percent: int = 8
    #: Members of a group whose pairs are counted before any prefix or text is sent.
    paired: int = 32

    def prefix(self, size: int) -> int:
        return min(size, size - -(-self.percent * size // 100) + self.meet + size * self.meet_percent // 100)

    def needed(self, size: int, other: int) -> int:
        """Least overlap of sets of these sizes: percent * union <= 100 * overlap."""
        return -(-self.percent * (size + other) // (100 + self.percent))


PARAMS = JoinParams()

_BITS = 58
_TEXT_BLOCK = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_OF_BYTE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_OF_PLACE = np.random.default_rng(20240102).integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


_powers: dict[str, np.ndarray] = {}


def _power(name: str, factor: int, size: int) -> np.ndarray:
    """1, f, f^2, ... modulo 2^64; kept for the usual block."""
    if name not in _powers or len(_powers[name]) < size:
        table = np.full(max(size, 1), factor, np.uint64)
        table[0] = 1
        table = np.cumprod(table, dtype=np.uint64)
        if size > 4 * _TEXT_BLOCK:
            return table
        _powers[name] = table
    return _powers[name][:size]


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of a block of bytes: a polynomial over the word's bytes, from prefix sums."""
    codes = _LOWER[np.frombuffer(data, np.uint8)]
    space = np.concatenate([[True], _SPACE[codes], [True]])
    starts = np.flatnonzero(space[:-2] & ~space[1:-1])
    ends = np.flatnonzero(~space[1:-1] & space[2:]) + 1
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_OF_BYTE[codes] * _power("up", _FACTOR, len(codes)), out=sums[1:])
    shifted = (sums[ends] - sums[starts]) * _power("down", _INVERSE, len(codes))[starts]
    return starts, _mixed(shifted + (ends - starts).astype(np.uint64))


def _pieces(texts: Iterable[str]) -> Iterator[tuple[bytes, list[int], list[bool]]]:
    """Blocks of bytes with the offsets at which texts begin in them; texts over a block are cut at white space."""
    held, begins, size = [], [], 0
    for text in texts:
        data = text.encode("utf-8", "replace")
        if size and size + len(data) > _TEXT_BLOCK:
            yield b" ".join(held), begins, [True] * len(begins)
            held, begins, size = [], [], 0
        if len(data) > 4 * _TEXT_BLOCK:
            at, first = 0, True
            while at < len(data):
                cut = at + _TEXT_BLOCK
                while cut < len(data) and not _SPACE[data[cut]]:
                    cut += 1
                yield data[at:cut], [0], [first]
                at, first = cut, False
            continue
        held.append(data)
        begins.append(size)
        size += len(data) + 1
    if held:
        yield b" ".join(held), begins, [True] * len(begins)


def _words_of(texts: Iterable[str]) -> Iterator[np.ndarray]:
    """Word hashes of each text."""
    waiting: list[np.ndarray] | None = None
    for data, begins, opens in _pieces(texts):
        starts, hashes = _word_hashes(data)
        cuts = np.searchsorted(starts, begins[1:])
        for part, opened in zip(np.split(hashes, cuts), opens, strict=True):
            if opened and waiting is not None:
                yield np.concatenate(waiting)
                waiting = None
            waiting = [*(waiting or []), part]
    if waiting is not None:
        yield np.concatenate(waiting)


def ngram_sets(texts: Iterable[str], n: int, common: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Sorted distinct tokens of each text: class of commonness in the high bits, hash of the n-gram below."""
    at_work("ngram_join")
    for words in _words_of(texts):
        if len(words) >= n:
            grams = sum(words[i : len(words) - n + 1 + i] * _OF_PLACE[i] for i in range(n))
        elif len(words):
            grams = np.array([(words * _OF_PLACE[: len(words)]).sum() + _OF_PLACE[-1] * np.uint64(len(words))])
        else:
            grams = np.zeros(0, np.uint64)
        tokens = np.unique(_mixed(grams) >> np.uint64(64 - _BITS))
        if common is not None:
            classes = common[(tokens % np.uint64(len(common))).astype(np.int64)].astype(np.uint64)
            tokens = np.sort(tokens | classes << np.uint64(_BITS))
        yield tokens.astype(np.int64)


def common_table(docs: DataFrame, text: str, params: JoinParams) -> np.ndarray:
    """Class of every cell: bits of the number of times that tokens of the cell repeat within blocks of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, held, size = np.zeros(params.cells, np.int64), [], 0

        def flush() -> None:
            if held:
                tokens = np.concatenate(held)
                held.clear()
                tokens.sort()
                # A token repeats if the one so many places on is equal; only such runs are counted, the others are most.
                further = params.repeats - 1
                again = np.flatnonzero(tokens[further:] == tokens[: max(0, len(tokens) - further)])
                often, first = np.unique(tokens[again], return_index=True)
                times = np.searchsorted(tokens, often, "right") - again[first]
                np.add.at(cells, often % params.cells, times)

        for batch in batches:
            for tokens in ngram_sets((x.as_py() or "" for x in batch.column(0)), params.words):
                held.append(tokens)
                size += len(tokens)
                if size >= params.block:
                    flush()
                    size = 0
        flush()
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(cells[used])], names=["cell", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "cell bigint, n bigint")
    table = np.zeros(params.cells, np.uint8)
    for row in counted.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most one row per cell
        table[row.cell] = min(31, int(row.n).bit_length())
    return table


def _signed(docs: DataFrame, text: str, common: np.ndarray, params: JoinParams) -> DataFrame:
    """(doc_id, n, key_a, key_b, prefix): size, 128-bit fingerprint and prefix of each document's set."""
    kind = "struct<n:bigint,key_a:bigint,key_b:bigint,prefix:array<bigint>>"

    @F.arrow_udf(kind)
    def sign(texts: pa.Array) -> pa.Array:
        sizes, first, second, ends, parts = [], [], [], [0], []
        for tokens in ngram_sets((x.as_py() or "" for x in texts), params.words, common):
            spread = _mixed(tokens.astype(np.uint64))
            sizes.append(len(tokens))
            first.append(int(spread.sum().astype(np.int64)))
            second.append(int(_mixed(spread + np.uint64(_FACTOR)).sum().astype(np.int64)))
            parts.append(tokens[: params.prefix(len(tokens))] if len(tokens) else tokens)
            ends.append(ends[-1] + len(parts[-1]))
        prefixes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))
        columns = [pa.array(c, pa.int64()) for c in (sizes, first, second)]
        return pa.StructArray.from_arrays([*columns, prefixes], names=["n", "key_a", "key_b", "prefix"])

    return docs.select("doc_id", sign(F.col(text)).alias("s")).select("doc_id", "s.*")


class TokenTrie:
    """Sets stored by global order. Sorting them puts every subtree in one run; ``shared`` is the depth at which a set
    leaves the path of the one before it."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i8").tobytes())
        self.shared = [0]
        for a, b in zip(self.order, self.order[1:], strict=False):
            m = min(len(sets[a]), len(sets[b]))
            differ = sets[a][:m] != sets[b][:m]
            self.shared.append(int(differ.argmax()) if differ.any() else m)

    def similar(self, probe: np.ndarray, params: JoinParams, wanted: Callable[[int], bool]) -> Iterator[int]:
        """Sets among the wanted ones that are similar to the probe. ``counts[d]`` is the overlap of the probe with the
        current path down to depth d, known down to ``known``."""
        counts = np.zeros(max(map(len, self.sets), default=0) + 1, np.int64)
        known = 0
        for shared, i in zip(self.shared, self.order, strict=True):
            tokens = self.sets[i]
            depth, size = min(shared, known), len(tokens)
            known = depth
            need = params.needed(len(probe), size)
            if need > min(len(probe), size) or not size or not wanted(i):
                continue
            left = len(probe)
            while depth < size and counts[depth] + min(size - depth, left) >= need:
                step = tokens[depth : depth + 128]
                places = np.searchsorted(probe, step)
                found = probe[np.minimum(places, len(probe) - 1)] == step
                counts[depth + 1 : depth + 1 + len(step)] = counts[depth] + np.cumsum(found)
                depth += len(step)
                left = len(probe) - int(places[-1])
            known = depth
            if depth == size and counts[depth] >= need:
                yield i


class Forest:
    def __init__(self, size: int) -> None:
        self.above = list(range(size))

    def root(self, i: int) -> int:
        while self.above[i] != i:
            self.above[i] = i = self.above[self.above[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.above[max(i, j)] = min(i, j)
        return i != j


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of equal key in sorted rows, across batches."""
    now, rows = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for row in batch.slice(at, 64).to_pylist():
                name = tuple(row[k] for k in key)
                if name != now and rows:
                    yield now, rows
                    rows = []
                now = name
                rows.append(row)
    if rows:
        yield now, rows


def may_link(sizes: np.ndarray, prefixes: list[np.ndarray], params: JoinParams) -> np.ndarray:
    """Which members may be similar to another one, judged by prefixes of their sets in global order.

    Tokens are shortened to their leading bits, which keeps the order. Where two prefixes can be told to reach, common
    tokens are counted; what lies behind in either set may be common too. Shortened tokens that fall together only raise
    the bound.
    """
    count, behind = len(sizes), np.iinfo(np.int64).max
    lasts = np.array([behind if len(p) == n else p[-1] for p, n in zip(prefixes, sizes.tolist(), strict=True)])
    reached = np.stack([np.searchsorted(p, lasts) for p in prefixes])
    tokens, place, times = np.unique(np.concatenate(prefixes), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(count), [len(p) for p in prefixes])
    again = times[place] > 1
    owner, place = owner[again], np.unique(place[again], return_inverse=True)[1]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common, width = np.zeros((count, count)), max(1, (1 << 20) // count)
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        part = slice(*np.searchsorted(place, [first, first + width]))
        held = np.zeros((count, width), np.float32)
        np.add.at(held, (owner[part], place[part] - first), 1)
        common += held @ held.T
    rest = sizes[:, None] - reached
    need = -(-params.percent * (sizes[:, None] + sizes) // (100 + params.percent))
    possible = (common + np.minimum(rest, rest.T) >= need) & (need <= np.minimum(sizes[:, None], sizes))
    np.fill_diagonal(possible, False)
    return possible.any(axis=1)


#: Bits of a token that a prefix keeps when it is only used for bounds: 31, so that it is a plain integer.
_SHORTENED = 32


def _with_partners(routes: DataFrame, signed: DataFrame, params: JoinParams) -> DataFrame:
    """(lead, node) of the members of small groups that may be similar to another one of their group."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lead,), rows in _groups(batches, ["lead"]):
            good = may_link(np.array([r["size"] for r in rows]), [np.array(r["prefix"], np.int64) for r in rows], params)
            nodes = {r["node"] for r, one in zip(rows, good.tolist(), strict=True) if one}
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array([lead] * len(nodes), pa.int64()), pa.array(sorted(nodes))], names=["lead", "node"])

    shortened = F.transform("prefix", lambda t: F.shiftright(t, _SHORTENED).cast("int"))
    prefixes = signed.select("doc_id", F.col("n").alias("size"), shortened.alias("prefix"))
    met = prefixes.join(routes.hint("merge"), F.col("node") == F.col("doc_id")).select("lead", "node", "size", "prefix")
    return met.repartition("lead").sortWithinPartitions("lead").mapInArrow(judge, "lead bigint, node bigint")


def reaching(probes: list[np.ndarray], sets: list[np.ndarray], params: JoinParams) -> np.ndarray:
    """Which probes (rows) share enough tokens with which sets (columns), both in global order, to be similar. Counts are
    sums of matrix products over blocks of tokens, so memory does not follow their number."""
    sizes = [np.array([len(s) for s in side], np.int64) for side in (probes, sets)]
    none = [np.zeros(0, np.int64)]
    flat = [np.concatenate([*side, *none]) for side in (probes, sets)]
    tokens = np.intersect1d(*flat)
    found = []
    for side, values in zip(sizes, flat, strict=True):
        place = np.searchsorted(tokens, values)
        known = tokens[np.minimum(place, len(tokens) - 1)] == values if len(tokens) else np.zeros(len(values), bool)
        owner, place = np.repeat(np.arange(len(side)), side)[known], place[known]
        order = np.argsort(place, kind="stable")
        found.append((owner[order], place[order]))
    common, width = np.zeros((len(probes), len(sets)), np.float32), max(1, (1 << 20) // max(1, len(probes), len(sets)))
    for first in range(0, len(tokens), width):
        held = []
        for side, (owner, place) in zip(sizes, found, strict=True):
            part = slice(*np.searchsorted(place, [first, first + width]))
            held.append(np.zeros((len(side), width), np.float32))
            held[-1][owner[part], place[part] - first] = 1
        common += held[0] @ held[1].T
    need = -(-params.percent * (sizes[0][:, None] + sizes[1]) // (100 + params.percent))
    return (common >= need) & (need > 0)


_FOUND = "kind string, a bigint, b bigint"


def _links(found: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["kind", "a", "b"])


def _joined(groups: DataFrame, common: np.ndarray, params: JoinParams) -> DataFrame:
    """Joins chunks of (lead, chunk, role, node, text, chunks): role 0 is the leader, 1 a member. Returns links, and for
    groups of several chunks the members that stay loose."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lead, _), rows in _groups(batches, ["lead", "chunk"]):
            sets = list(ngram_sets((r["text"] or "" for r in rows), params.words, common))
            nodes = [r["node"] for r in rows]
            forest, trie, found = Forest(len(rows)), TokenTrie(sets), []
            at_lead = next((i for i, node in enumerate(nodes) if node == lead), None)
            first_of: dict[int, int] = {}
            for i, node in enumerate(nodes):  # rows of one id are one node
                forest.join(first_of.setdefault(node, i), i)
            # The leader probes first; whatever it gathers is never compared again.
            probes = sorted(range(len(rows)), key=lambda i: (i != at_lead, rows[i]["role"]))
            for first in range(0, len(rows), params.chunk):
                block = probes[first : first + params.chunk]
                near = reaching([sets[i] for i in block], sets, params)
                for i, partners in zip(block, near, strict=True):
                    if at_lead not in (None, i) and forest.root(i) == forest.root(at_lead) or not partners.any():
                        continue
                    for j in trie.similar(sets[i], params, lambda j, i=i, p=partners: p[j] and forest.root(i) != forest.root(j)):
                        if forest.join(i, j):
                            found.append(("link", nodes[i], nodes[j]))
            if rows[0]["chunks"] > 1 and at_lead is not None:
                loose = {nodes[i] for i in range(len(rows)) if forest.root(i) != forest.root(at_lead)}
                found += [("loose", lead, node) for node in loose]
            yield from _links(found)

    return (
        groups.select("lead", "chunk", "role", "node", "text", "chunks")
        .repartition("lead", "chunk")
        .sortWithinPartitions("lead", "chunk", "role")
        .mapInArrow(join, _FOUND)
    )


def _meeting(members: DataFrame, loose: DataFrame) -> DataFrame:
    """(lead, low, high, chunk, node, text, free): members of pairs of chunks that loose ones (``free``) take part in, from
    (lead, chunk, node, text, chunks) and (lead, node).

    Two chunks meet at one place, however many others the group has. A member that is connected to the leader goes only
    where the other chunk has loose ones.
    """
    every = F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)
    told = members.join(loose.withColumn("free", F.lit(True)).hint("merge"), ["lead", "node"], "left")
    touched = told.filter("free").groupBy("lead").agg(F.collect_set("chunk").alias("with_free"))
    met = (
        told.join(touched.hint("merge"), "lead")
        .withColumn("free", F.col("free").isNotNull())
        .withColumn("other", F.explode(F.when(F.col("free"), every).otherwise(F.col("with_free"))))
        .filter("other <> chunk")
    )
    ends = [F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high")]
    return met.select("lead", *ends, "chunk", "node", "text", "free")


def _crossed(meeting: DataFrame, common: np.ndarray, params: JoinParams) -> DataFrame:
    """Links between two chunks that loose members take part in; all others are connected with each other already."""

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, _), rows in _groups(batches, ["lead", "low", "high"]):
            sets = list(ngram_sets((r["text"] or "" for r in rows), params.words, common))
            nodes, free = [r["node"] for r in rows], [r["free"] for r in rows]
            forest, found, first_of = Forest(len(rows)), [], {}
            for i in range(len(rows)):
                forest.join(first_of.setdefault(nodes[i] if free[i] else None, i), i)
            here, there = ([i for i, r in enumerate(rows) if (r["chunk"] == low) == side] for side in (True, False))
            trie = TokenTrie([sets[j] for j in there])
            for first in range(0, len(here), params.chunk):
                block = here[first : first + params.chunk]
                near = reaching([sets[i] for i in block], trie.sets, params)
                for i, partners in zip(block, near, strict=True):
                    if not partners.any():
                        continue
                    for at in trie.similar(sets[i], params, lambda at, i=i, p=partners: p[at] and forest.root(i) != forest.root(there[at])):
                        if forest.join(i, there[at]):
                            found.append(("link", nodes[i], nodes[there[at]]))
            yield from _links(found)

    key = ["lead", "low", "high"]
    return meeting.repartition(*key).sortWithinPartitions(*key).mapInArrow(cross, _FOUND)


def _due(params: JoinParams) -> Column:
    """Tokens of their prefixes that a set of ``n`` and any similar one share at least."""
    partner = F.ceil(F.col("n") * params.percent / 100)
    return F.least(partner, params.meet + F.floor(partner * params.meet_percent / 100))


def _able_to_link(meets: DataFrame, able: DataFrame, params: JoinParams) -> tuple[DataFrame, DataFrame]:
    """Rows of (lead, node, n, met) and of (doc_id, n) without documents that share too few tokens with all others
    together to be similar to any.

    What a document shares with another one lies at a leader: as ``met`` of its own row there, or of the other's row where
    it leads itself. In a large corpus most documents share some tokens with others by accident, each with a few of them.
    """
    own = meets.groupBy("node").agg(F.sum("met").alias("shared"))
    led = meets.groupBy(F.col("lead").alias("node")).agg(F.sum("met").alias("shared"))
    totals = own.unionByName(led).groupBy("node").agg(F.sum("shared").alias("shared"))
    sized = able.join(totals.hint("merge"), F.col("doc_id") == F.col("node")).filter(F.col("shared") >= _due(params))
    kept = written(sized.select("doc_id", "n"), "able")
    rows = meets.join(kept.select(F.col("doc_id").alias("k")).hint("merge"), F.col("node") == F.col("k"), "left_semi")
    return written(rows, "met"), kept


def _routes(meets: DataFrame, able: DataFrame, params: JoinParams) -> DataFrame:
    """Distinct (lead, node, n) that similar documents need to come together, leaders among the nodes.

    Similar sets share at least ``due`` tokens of their prefixes, each at some leader. In small groups pairs near in size
    are counted: what two documents can share in all small groups is the sum of the fewer tokens that either brings there,
    and the large groups add no more than either brings to them. Pairs that reach ``due`` meet at one of their leaders.

    All that other similar pairs share lies in large groups. A row with fewer than ``due`` tokens is weak there. If no
    leader has strong rows of both, all tokens they share are in weak rows, so one of both holds half of its due in weak
    rows. Leaders that such a document touches keep all their rows; elsewhere weak rows go.
    """
    due = _due(params)
    groups = meets.groupBy("lead").agg((F.count(F.lit(1)) <= params.paired).alias("small")).withColumnRenamed("lead", "l")
    rows = meets.join(groups.hint("merge"), F.col("lead") == F.col("l")).drop("l")
    large = rows.filter(~F.col("small"))
    any_number = F.lit(1 << 40)
    # A leader may share any number of tokens with a member of its group.
    heads = able.select(F.col("doc_id").alias("node"), "n").join(groups.hint("merge"), F.col("node") == F.col("l"))
    heads = heads.select(F.col("node").alias("lead"), "node", "n", any_number.alias("met"), "small").distinct()
    everyone = rows.select("lead", "node", "n", "met", "small").unionByName(heads)
    elsewhere = (
        everyone.filter(~F.col("small")).groupBy(F.col("node").alias("e")).agg(F.least(F.sum("met"), any_number).alias("more"))
    )
    paired = everyone.filter("small").withColumn("due", due).join(elsewhere.hint("merge"), F.col("node") == F.col("e"), "left")
    paired = paired.select("lead", "node", "n", "met", "due", F.coalesce("more", F.lit(0)).alias("more"))
    other = paired.select(*[F.col(c).alias("lead" if c == "lead" else f"o_{c}") for c in paired.columns])
    pairs = (
        paired.join(other.hint("merge"), "lead")
        .filter("node < o_node")
        .filter(F.least("n", "o_n") * 100 >= F.greatest("n", "o_n") * params.percent)
        .groupBy("node", "o_node", "n", "o_n", F.greatest("due", "o_due").alias("due"), F.least("more", "o_more").alias("more"))
        .agg(F.sum(F.least("met", "o_met")).alias("met"), F.min("lead").alias("lead"))
        .filter("met + more >= due")
    )
    ends = F.array(*[F.struct(F.col(f"{o}node").alias("node"), F.col(f"{o}n").alias("n")) for o in ("", "o_")])
    judged = large.withColumn("due", due).withColumn("weak", F.col("met") < F.col("due"))
    torn = (
        judged.groupBy("node", "n", "due")
        .agg(F.sum(F.when(F.col("weak"), F.col("met")).otherwise(0)).alias("in_weak"))
        .filter(2 * F.col("in_weak") >= F.col("due"))
        .select(F.col("node").alias("torn"))
        .distinct()
    )
    touched = (
        judged.join(torn, F.col("node") == F.col("torn"))
        .select(F.col("lead").alias("whole"))
        .unionByName(torn.select(F.col("torn").alias("whole")))
        .distinct()
    )
    kept = judged.join(touched, F.col("lead") == F.col("whole"), "left").filter(~F.col("weak") | F.col("whole").isNotNull())
    led = heads.filter(~F.col("small")).join(kept.select("lead").distinct(), "lead", "left_semi")
    whole = kept.select("lead", "node", "n").unionByName(led.select("lead", "node", "n"))
    return whole.unionByName(pairs.select("lead", F.inline(ends)).distinct())


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: JoinParams = PARAMS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: size of its set and the smallest id it is linked with."""
    # Joins with tokens, prefixes and texts are merge joins at every size: what a small table would broadcast grows with it.
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    common = common_table(docs, "text", params)
    signed = written(_signed(docs, "text", common, params), "signed")
    keys = ["key_a", "key_b", "n"]
    able = signed.filter("n > 0 AND doc_id IS NOT NULL")
    nodes = able.groupBy(*keys).agg(F.min("doc_id").alias("node"), F.first("prefix").alias("prefix"))
    tokens = nodes.select("node", "n", F.explode("prefix").alias("token"))
    leads = (
        tokens.groupBy("token")
        .agg(F.min("node").alias("lead"), F.max("node").alias("last"))
        .filter("lead < last")
        .select(F.col("token").alias("t"), "lead")
    )
    meets = written(
        tokens.join(leads.hint("merge"), F.col("token") == F.col("t"))
        .filter("node <> lead")
        .groupBy("lead", "node", "n")
        .agg(F.count(F.lit(1)).alias("met")),
        "meets",
    )
    # A member stays if the next smaller or larger one of its group, the leader included, is near enough in size.
    whole = _routes(*_able_to_link(meets, able.select("doc_id", "n"), params), params)
    by_size = W.partitionBy("lead").orderBy("n", "node")
    near = (F.lag("n").over(by_size) * 100 >= F.col("n") * params.percent) | (
        F.col("n") * 100 >= F.lead("n").over(by_size) * params.percent
    )
    routes = written(whole.withColumn("near", near).filter("near").groupBy("lead", "node").agg(F.max("n").alias("n")), "routes")

    def cut(rows: DataFrame) -> DataFrame:
        parts = F.ceil(F.greatest(F.count(F.lit(1)) / params.chunk, F.sum("n") / params.chunk_grams))
        return rows.groupBy("lead").agg(parts.alias("chunks"), F.bool_or(F.col("node") == F.col("lead")).alias("led"))

    sizes = routes.join(cut(routes).select(F.col("lead").alias("l"), "chunks"), F.col("lead") == F.col("l")).drop("l")
    partners = _with_partners(sizes.filter("chunks = 1").select("lead", "node"), able, params)
    routes = written(
        sizes.filter("chunks = 1").join(partners, ["lead", "node"], "left_semi").unionByName(sizes.filter("chunks > 1")).drop("chunks"), "partners"
    )
    chunks = cut(routes).withColumn("led", F.col("led") | (F.col("chunks") > 1))
    own: Column = F.pmod(F.xxhash64("node"), F.col("chunks"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)
    members = routes.filter("node <> lead").join(chunks.withColumnRenamed("lead", "l"), F.col("lead") == F.col("l")).select(
        "lead", "node", "chunks", F.lit(1).alias("role"), own.alias("chunk")
    )
    # A leader far from all others in size is only needed to tell the loose members of several chunks.
    leaders = chunks.filter("led").select("lead", F.col("lead").alias("node"), "chunks", F.lit(0).alias("role"), F.explode(every).alias("chunk"))
    places = members.unionByName(leaders)
    texts = docs.filter(F.col("doc_id").isNotNull())

    def with_texts(rows: DataFrame) -> DataFrame:
        return texts.join(rows.hint("merge"), F.col("doc_id") == F.col("node")).drop("doc_id")

    # Written, as members of several chunks may go on: texts of the whole table are sent once.
    placed = written(with_texts(places), "placed")
    found = written(_joined(placed, common, params), "found")
    links = found.filter("kind = 'link'").select("a", "b")
    loose = found.filter("kind = 'loose'").select(F.col("a").alias("lead"), F.col("b").alias("node")).distinct()
    if not loose.isEmpty():
        meeting = _meeting(placed.filter("chunks > 1 AND role = 1"), loose)
        crossed = _crossed(meeting, common, params)
        links = links.unionByName(written(crossed.select("a", "b"), "crossed"))
    roots = components(links)
    classed = (
        nodes.select(*[F.col(k).alias(f"n_{k}") for k in keys], "node")
        .join(roots.withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left")
        .select(*[f"n_{k}" for k in keys], F.coalesce("root", "node").alias("component"))
    )
    same = [F.col(k) == F.col(f"n_{k}") for k in keys]
    able_here = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return (
        signed.select("doc_id", *keys)
        .join(classed, [*same], "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(able_here, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        )
    )


def one_of_each(docs: DataFrame, params: JoinParams = PARAMS) -> DataFrame:
    """Keeps, of every group of linked documents, the one with the smallest id; rows without id stay."""
    name = unused(docs, "kept_id")
    kept = classes(docs, params=params).filter("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    single = docs.filter(F.col("doc_id").isNotNull()).join(kept, F.col("doc_id") == F.col(name), "left_semi")
    return single.unionByName(docs.filter(F.col("doc_id").isNull()))
