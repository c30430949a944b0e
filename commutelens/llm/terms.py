"""Words of a text as lower-case byte strings: runs of ASCII letters and digits and of all signs beyond ASCII.

Only A-Z are lower-cased. Null and empty texts have no words. A long text is split in blocks, so that it never stands in
memory as one list of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

BLOCK_BYTES = 4_000_000


def _letter(byte: int) -> int:
    sign = chr(byte)
    return byte if byte > 127 else ord(sign.lower()) if sign.isalnum() else ord(" ")


LETTERS = bytes(map(_letter, range(256)))
SEPARATOR = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def word_blocks(text: bytes | None, block: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Words in order, in lists; a list ends with the word that its last byte stands in."""
    text, at = text or b"", 0
    while at < len(text):
        part = SEPARATOR.search(text, at + block)
        end = part.end() if part else len(text)
        yield text[at:end].translate(LETTERS).split()
        at = end
