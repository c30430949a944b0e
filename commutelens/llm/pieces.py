"""SentencePiece encoding and decoding of merge-type models by backtracking.

An encoding is right exactly if every two neighbours are: merging the characters of both must leave these two pieces,
because merges on both sides of a cut that is never crossed do not depend on each other. The encoder therefore walks a
text with the longest piece at every place (one Aho-Corasick run), checks each piece against the one before it by merging
both again, tries the next shorter prefix piece where they do not fit, and gives up a place that no piece continues. A
bitfield remembers such places, so none is tried twice and time stays linear.

Merges take the highest score first and the leftmost among equals; signs outside the vocabulary become byte pieces.

Results: null and empty texts have no ids and decode to an empty string. A text gets the model's dummy prefix; U+2581 in a
text counts as a space, as in the library. Control pieces decode to nothing, the unknown piece to its surface, bytes that
are no UTF-8 to one U+FFFD each; ids outside the model raise. Repeated rows and other columns stay as they are;
a column that has the name of a result is replaced by it.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commutelens.llm.worker import at_work

SPACE = "▁"
NONE = float("-inf")

#: Kept per Python worker: encodings of units, of at most so many characters, and answers on neighbours.
UNITS_KEPT = 400_000
UNIT_CHARS = 64
PAIRS_KEPT = 1_000_000

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceModel:
    """Pieces and scores of a model file, and what encoding derives from them."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        trainer, normal = spec.trainer_spec, spec.normalizer_spec
        kinds = {p.type for p in spec.pieces}
        piece = sentencepiece_model_pb2.ModelProto.SentencePiece
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models with byte pieces and leading spaces are supported")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
            raise ValueError("models that rewrite texts are not supported")
        if kinds & {piece.USER_DEFINED, piece.UNUSED}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.dummy = SPACE if normal.add_dummy_prefix else ""
        self.score = {p.piece: p.score for p in spec.pieces if p.type == piece.NORMAL}
        self.ids: dict[str, bytes] = {}
        self.bytes_of: list[bytes | None] = []
        self.text_of: list[str] = []
        byte_ids = [0] * 256
        for i, p in enumerate(spec.pieces):
            byte = int(p.piece[3:-1], 16) if p.type == piece.BYTE else None
            if byte is not None:
                byte_ids[byte] = i
            if p.type == piece.NORMAL:
                self.ids[p.piece] = array("i", [i]).tobytes()
            self.bytes_of.append(None if byte is None else bytes([byte]))
            shown = {piece.NORMAL: p.piece, piece.UNKNOWN: trainer.unk_surface}
            self.text_of.append(shown.get(p.type, ""))
        self.byte_ids = byte_ids
        self.unknown = {i for i, p in enumerate(spec.pieces) if p.type == piece.UNKNOWN}
        self.control = {i for i, p in enumerate(spec.pieces) if p.type == piece.CONTROL}

        self.fitting: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        own = {p for p in self.score if len(p) == 1 or self.merge(p) == [p]}
        #: The next shorter piece that a piece starts with; its first sign stands last, in the vocabulary or not.
        self.shorter: dict[str, str | None] = {}
        self.longest = ahocorasick.Automaton()
        for p in own:
            self.shorter[p] = next((p[:n] for n in range(len(p) - 1, 0, -1) if n == 1 or p[:n] in own), None)
            self.longest.add_word(p, p)
        self.longest.make_automaton()
        self.units = self._unit_pattern()

    def _unit_pattern(self) -> re.Pattern[str] | None:
        """Stretches of a text that no piece reaches across: spaces with the run of letters, of digits or of other signs
        after them, as far as the model's pieces hold such neighbours. None if pieces mix kinds in another way."""
        signs = set().union(*self.score) - {SPACE}
        kinds = {"letter": {c for c in signs if c.isalpha()}, "digit": {c for c in signs if c.isdecimal()}}

        def kind(sign: str) -> str:
            return "space" if sign == SPACE else next((k for k, held in kinds.items() if sign in held), "other")

        joins = {(kind(a), kind(b)) for p in self.score for a, b in zip(p, p[1:], strict=False)}
        if any(a not in ("space", b) for a, b in joins):
            return None
        sets = {k: "".join(map(re.escape, sorted(held))) for k, held in kinds.items()}
        sets["other"] = "^" + SPACE + "".join(sets.values())
        units = [
            (SPACE + "*" if ("space", k) in joins else "") + f"[{signs}]" + ("+" if (k, k) in joins else "")
            for k, signs in sets.items()
            if signs
        ]
        return re.compile("|".join([*units, SPACE + "+"]))

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by merging its characters, best score first, leftmost first."""
        score, parts = self.score.get, list(text)
        gains = [score(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while gains:
            best = max(gains)
            if best == NONE:
                break
            i = gains.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gains[i]
            if i:
                gains[i - 1] = score(parts[i - 1] + parts[i], NONE)
            if i < len(gains):
                gains[i] = score(parts[i] + parts[i + 1], NONE)
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether merging both pieces again leaves these two."""
        pair = (left, right)
        known = self.fitting.get(pair)
        if known is None:
            if len(self.fitting) >= PAIRS_KEPT:
                self.fitting.clear()
            known = self.fitting[pair] = self.merge(left + right) == [left, right]
        return known

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text of any length, not empty."""
        matches = list(text)
        for end, piece in self.longest.iter(text):  # ends ascend, so the longest piece at a place comes last
            matches[end + 1 - len(piece)] = piece
        shorter, fits, size = self.shorter.get, self.fits, len(text)
        failed = bytearray(size + 1)
        found: list[str] = []
        at, piece = 0, matches[0]
        while at < size:
            while piece is not None:
                end = at + len(piece)
                if not failed[end] and (not found or fits(found[-1], piece)):
                    break
                piece = shorter(piece)
            if piece is None:  # nothing continues this place: shorten the piece that led here
                failed[at] = 1
                piece = found.pop()
                at -= len(piece)
                piece = shorter(piece)
                continue
            found.append(piece)
            at += len(piece)
            piece = matches[at] if at < size else None
        return found

    def _ids_of(self, piece: str) -> bytes:
        known = self.ids.get(piece)
        if known is None:
            known = array("i", [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]).tobytes()
        return known

    def encode_unit(self, unit: str) -> bytes:
        ids = b"".join(map(self._ids_of, self.backtrack(unit)))
        if len(unit) <= UNIT_CHARS:
            if len(self.known) >= UNITS_KEPT:
                self.known.clear()
            self.known[unit] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Packed 32-bit ids."""
        if not text:
            return b""
        text = self.dummy + text.replace(" ", SPACE)
        if self.units is None:
            return self.encode_unit(text)
        known, encode = self.known.get, self.encode_unit
        return b"".join([known(unit) or encode(unit) for unit in self.units.findall(text)])

    def decode(self, ids: Iterable[int]) -> str:
        parts: list[str] = []
        run, at_start = bytearray(), bool(self.dummy)

        def end_run() -> None:
            if run:
                parts.append(run.decode("utf-8", "each_byte"))
                run.clear()

        for i in ids:
            if i < 0:
                raise IndexError(f"no piece has id {i}")
            byte = self.bytes_of[i]
            if byte is not None:
                run += byte
                at_start = False
                continue
            end_run()
            text = self.text_of[i]
            if i not in self.unknown and i not in self.control:
                if at_start and text.startswith(SPACE):
                    text = text[1:]
                text = text.replace(SPACE, " ")
            parts.append(text)
            at_start = at_start and i in self.control
        end_run()
        return "".join(parts)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One per Python worker."""
    return PieceModel(path)


def _encode_all(texts: pa.Array, path: str) -> pa.Array:
    at_work("pieces", model.cache_clear)
    pieces, ends, ids = model(path), array("i", [0]), array("i")
    for text in texts:
        ids.frombytes(pieces.encode(text.as_py()))
        ends.append(len(ids))
    return pa.ListArray.from_arrays(np.frombuffer(ends, "int32"), np.frombuffer(ids, "int32"))


def _decode_all(rows: pa.Array, path: str) -> pa.Array:
    at_work("pieces", model.cache_clear)
    pieces = model(path)
    texts = (pieces.decode(row.values.to_numpy(zero_copy_only=False).tolist()) if row.is_valid else "" for row in rows)
    return pa.array(texts, pa.string())


def encoded(text: Column | str, path: str) -> Column:
    """Ids of a text column, array<int>."""
    return F.arrow_udf(lambda texts: _encode_all(texts, path), "array<int>")(text)


def decoded(ids: Column | str, path: str) -> Column:
    """Text of a column of ids."""
    return F.arrow_udf(lambda rows: _decode_all(rows, path), "string")(ids)


def both_ways(text: Column | str, path: str) -> Column:
    """Struct of the ids of a text column and the text that they decode to. One function, because Spark would run the
    encoder once for the ids and once more below the decoder."""

    def there_and_back(texts: pa.Array) -> pa.Array:
        ids = _encode_all(texts, path)
        return pa.StructArray.from_arrays([ids, _decode_all(ids, path)], ["ids", "decoded"])

    return F.arrow_udf(there_and_back, "struct<ids:array<int>,decoded:string>")(text)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "piece_ids") -> DataFrame:
    return df.withColumn(ids, encoded(F.col(text), path))


def decode(df: DataFrame, path: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    return df.withColumn(text, decoded(F.col(ids), path))
