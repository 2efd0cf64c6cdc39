"""Words of a text as numbers, looked up by chunk.

A word is a run of letters, digits or underscores, lower-cased.  Nearly every chunk
between white space holds one word with marks around it, so chunks are numbered once
and looked up; a text with chunks of several words is read with the pattern instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable

CACHED = 300_000
LONGEST = 64
_NONE, _MANY = -(1 << 62), -(1 << 62) - 1
_MARKS = ".,!?;:\"'()$%&*#|"
_find = re.compile(r"\w+").findall


def words(text: str) -> list[str]:
    return _find(text.lower())


class WordNumbers(dict):
    """``self(text)``: an int64 array with ``number(word)`` for each word in order; numbers above -2**62."""

    def __init__(self, number: Callable[[str], int]) -> None:
        super().__init__()
        self.number = number

    def __missing__(self, chunk: str) -> int:
        bare = chunk.lower().strip(_MARKS)
        found = [bare] if bare.isalnum() else _find(bare)
        value = self.number(found[0]) if len(found) == 1 else _MANY if found else _NONE
        if len(chunk) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
            self[chunk] = value
        return value

    def __call__(self, text: str):
        import numpy as np

        chunks = text.split()
        out = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        if not out.size or out.min() > _NONE:
            return out
        if out.min() == _MANY:
            found = words(text)
            return np.fromiter((self.number(w) for w in found), np.int64, len(found))
        return out[out != _NONE]


def hashed() -> WordNumbers:
    """Words by 62 bits of their hash."""
    import xxhash

    return WordNumbers(lambda w: xxhash.xxh3_64_intdigest(w) >> 2)
