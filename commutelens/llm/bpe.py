"""Byte-pair encoding and decoding by traversal of a prefix-sharing trie.

The distinct words of a block of documents are inserted into a trie. A depth-first walk gives every node the last
token of the encoding of its prefix; that state depends only on states further up the same path, so a prefix that
many words share is encoded once. A word's encoding is read off by following last tokens back to the root.

A token may follow another one exactly if merging the bytes of both yields the same two tokens again; since an
encoding is valid if and only if all neighbours are, the longest suffix token that is compatible with the state it
leaves behind is the last token of the prefix.

Results: null text encodes to an empty list and decodes to an empty string; so does empty text. Strings of special
tokens inside a text become those tokens. Repeated rows and other columns of the input stay as they are;
a column that has the name of a result is replaced by it.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commutelens.llm.worker import at_work

#: Fixed value: the split pattern of byte-level vocabularies.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same pattern for texts of the characters below; the plain engine is three times as fast.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN_PATTERN = rf" ?[{LETTERS}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+"
NOT_PLAIN = re.compile(rf"[^\x20-\x7e\n{LETTERS}]").search

#: Encodings and judged pairs of tokens kept per Python worker, characters per block of documents, characters of a text
#: split at once. What is kept stays in the worker for whatever stage comes next.
WORDS_KEPT = 200_000
PAIRS_KEPT = 200_000
BLOCK_CHARS = 2_000_000
PIECE_CHARS = 4_000_000


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in vocabulary files: printable bytes stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Trie:
    """Distinct byte strings as branches in depth-first order: a branch leaves the path of the one before it at the
    depth up to which both agree, so every prefix that words share is one node."""

    def __init__(self) -> None:
        self.branches: list[tuple[int, bytes]] = []

    def insert_sorted(self, words: Iterable[bytes]) -> None:
        before = b""
        for word in words:
            shared, top = 0, min(len(before), len(word))
            while shared < top and before[shared] == word[shared]:
                shared += 1
            self.branches.append((shared, word))
            before = word


class Vocabulary:
    """Merges of a byte-level vocabulary file. Inside, ids are 0-255 for bytes and 256 + rank for merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        letters = byte_letters()
        own = {letter: byte for letter, byte in letters.items()}
        self.pieces = [bytes([b]) for b in range(256)]
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        names = [""] * 256
        for letter, byte in letters.items():
            names[byte] = letter
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            token = len(self.pieces)
            if left + right in own:
                raise ValueError(f"two merges make {left + right!r}")
            own[left + right] = token
            names.append(left + right)
            self.halves.append((own[left], own[right]))
            self.joined[own[left], own[right]] = token
            self.pieces.append(self.pieces[own[left]] + self.pieces[own[right]])
        self.public = [model["vocab"][name] for name in names]
        self.packed = [array("i", [token]).tobytes() for token in self.public]
        self.sizes = [len(piece) for piece in self.pieces]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {public: piece for public, piece in zip(self.public, self.pieces, strict=True)}
        self.bytes_of |= {token: text.encode() for text, token in self.special.items()}
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.any_words, self.plain_words = regex.compile(WORD_PATTERN).findall, re.compile(PLAIN_PATTERN).findall
        self.known: dict[str | int, bytes] = {}
        self.allowed: dict[int, bool] = {}
        reached = [True] * 256
        for token in range(256, len(self.pieces)):
            left, right = self.halves[token]
            reached.append(reached[left] and reached[right] and self.compatible(left, right, token))
        # Every prefix of a token, with the tokens that it ends in, longest first.
        own_token = {piece: token for token, piece in enumerate(self.pieces) if reached[token]}
        self.prefixes: dict[bytes, tuple[int, ...]] = {b"": ()}
        for prefix in sorted({p[:i] for p in self.pieces for i in range(1, len(p) + 1)}, key=len):
            shorter = next(prefix[i:] for i in range(1, len(prefix) + 1) if prefix[i:] in self.prefixes)
            own = (own_token[prefix],) if prefix in own_token else ()
            self.prefixes[prefix] = own + self.prefixes[shorter]

    def compatible(self, left: int, right: int, limit: int = 1 << 60) -> bool:
        """Whether merging the bytes of both tokens leaves these two tokens: undoes merges on both sides of the cut,
        latest first, and looks for a merge across it that would have come earlier."""
        joined, halves = self.joined, self.halves
        while True:
            if joined.get((left, right), limit) < limit:
                return False
            if left > right:
                limit = left
                if left < 256:
                    return True
                left = halves[left][1]
            else:
                limit = right + 1
                if right < 256:
                    if left < 256:
                        return True
                    limit = left
                    left = halves[left][1]
                else:
                    right = halves[right][0]

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Encodings as packed 32-bit ids. On the current path, state[d] is the last token of the prefix of length d, and
        start[d] the place from which on it begins some token; that place never moves back as the prefix grows."""
        trie = Trie()
        trie.insert_sorted(sorted({word.encode("utf-8", "surrogatepass") for word in words}))
        ending, sizes, allowed, packed = self.prefixes.get, self.sizes, self.allowed, self.packed
        state, start, found = [-1], [0], {}
        for shared, word in trie.branches:
            del state[shared + 1 :], start[shared + 1 :]
            at = start[shared]
            for depth in range(shared + 1, len(word) + 1):
                while (candidates := ending(word[at:depth])) is None:
                    at += 1
                for token in candidates:  # a single byte fits if nothing longer does
                    rest = depth - sizes[token]
                    if not rest:
                        break
                    key = state[rest] << 32 | token
                    fits = allowed.get(key)
                    if fits is None:
                        fits = allowed[key] = self.compatible(state[rest], token)
                    if fits:
                        break
                state.append(token)
                start.append(at)
            ids, place = [], len(word)
            while place:
                token = state[place]
                ids.append(packed[token])
                place -= sizes[token]
            ids.reverse()
            found[word.decode("utf-8", "surrogatepass")] = b"".join(ids)
        if len(allowed) > PAIRS_KEPT:
            allowed.clear()
        return found

    def pieces_of(self, text: str) -> Iterator[str | int]:
        """Stretches of plain text and ids of special tokens, in order."""
        at = 0
        for match in self.split_special.finditer(text) if self.split_special else ():
            if match.start() > at:
                yield text[at : match.start()]
            yield self.special[match.group()]
            at = match.end()
        if at < len(text):
            yield text[at:]

    def words_of(self, piece: str) -> list[str]:
        return self.any_words(piece) if NOT_PLAIN(piece) else self.plain_words(piece)

    def words(self, text: str) -> Iterator[list[str | int]]:
        """Words of a text, in lists of bounded size. Long stretches are cut before a single space, where the pattern
        always starts a new word."""
        for piece in self.pieces_of(text):
            if isinstance(piece, int):
                yield [piece]
                continue
            at = 0
            while len(piece) - at > PIECE_CHARS:
                cut = regex.compile(r"(?<=\S) (?=\S)").search(piece, at + PIECE_CHARS)
                if not cut:
                    break
                yield self.words_of(piece[at : cut.start()])
                at = cut.start()
            yield self.words_of(piece[at:])

    def encode_block(self, texts: list[str]) -> list[bytes]:
        split = [[*chain.from_iterable(self.words(text))] for text in texts]
        whole = set().union(*split)
        whole.difference_update(self.special.values())
        fresh = whole.difference(self.known)  # unlike "-" on a view of keys, this looks up the words of the block only
        if len(self.known) + len(fresh) > WORDS_KEPT:  # words of this block stay: common ones are among them
            self.known = {word: self.known[word] for word in whole - fresh}
        self.known |= self.encode_words(fresh)
        for token in self.special.values():
            self.known[token] = array("i", [token]).tobytes()
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Packed 32-bit ids of each text."""
        block, size = [], 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= BLOCK_CHARS:
                yield from self.encode_block(block)
                block, size = [], 0
        yield from self.encode_block(block)

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per Python worker."""
    return Vocabulary(path)


def _encode_all(texts: pa.Array, path: str) -> pa.Array:
    ends, ids = array("i", [0]), array("i")
    at_work("bpe", vocabulary.cache_clear)
    for row in vocabulary(path).encode_all(x.as_py() or "" for x in texts):
        ids.frombytes(row)
        ends.append(len(ids))
    return pa.ListArray.from_arrays(np.frombuffer(ends, "int32"), np.frombuffer(ids, "int32"))


def _decode_all(rows: pa.Array, path: str) -> pa.Array:
    at_work("bpe", vocabulary.cache_clear)
    words, offsets, ids = vocabulary(path), rows.offsets.to_pylist(), rows.values.to_numpy()
    known = zip(rows.is_valid().to_pylist(), offsets, offsets[1:])
    return pa.array([words.decode(ids[a:b].tolist()) if valid else "" for valid, a, b in known], pa.string())


def encoded(text: Column | str, path: str) -> Column:
    """Token ids of a text column, array<int>."""
    return F.arrow_udf(lambda texts: _encode_all(texts, path), "array<int>")(text)


def decoded(ids: Column | str, path: str) -> Column:
    """Text of a column of token ids; special tokens are kept, unknown ids raise, broken bytes become U+FFFD."""
    return F.arrow_udf(lambda rows: _decode_all(rows, path), "string")(ids)


def both_ways(text: Column | str, path: str) -> Column:
    """Struct of the token ids of a text column and the text that they decode to. One function, because Spark would run
    the encoder once for the ids and once more below the decoder."""

    def there_and_back(texts: pa.Array) -> pa.Array:
        ids = _encode_all(texts, path)
        return pa.StructArray.from_arrays([ids, _decode_all(ids, path)], ["ids", "decoded"])

    return F.arrow_udf(there_and_back, "struct<ids:array<int>,decoded:string>")(text)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    return df.withColumn(ids, encoded(F.col(text), path))


def decode(df: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    return df.withColumn(text, decoded(F.col(ids), path))
