"""Numbers of words, keys of lines and word parities of texts."""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np

#: Parity bits of texts under 256 words; twice as many for each doubling of the words, up to BITS << TOP_LEVEL.
BITS, TOP_LEVEL = 128, 5


class _Numbers(dict):
    """Words to numbers; filled as they come."""

    def __init__(self, plain: bool):
        self.plain = plain

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        number = self[word] = zlib.crc32((_DIGITS.sub("0", word) if self.plain else word).encode("utf-8", "surrogatepass"))
        return number


_DIGITS = re.compile(r"\d+")
_NUMBERS, _PLAIN = _Numbers(False), _Numbers(True)


def word_numbers(lines: list[list[str]]) -> np.ndarray:
    """Numbers of the words of all lines in order."""
    return np.fromiter(map(_NUMBERS.__getitem__, chain.from_iterable(lines)), np.uint32)


def line_key(words: list[str]) -> int:
    """A 64-bit key of a line's words, whatever digits they hold. The same in every process, as only whole numbers are hashed."""
    return hash(tuple(map(_PLAIN.__getitem__, words)))


def parities(words: np.ndarray) -> bytes:
    """Bit k: whether the words of class k are odd in number. A word added or taken away changes one bit."""
    size = BITS << min(max(len(words).bit_length() - 8, 0), TOP_LEVEL)
    mixed = words.astype(np.uint32) * np.uint32(0x9E3779B1)
    return np.packbits(np.bincount((mixed >> np.uint32(16)) & np.uint32(size - 1), minlength=size) & 1 == 1).tobytes()
