"""Token ids and counts with the public tokenizer files, cached by chunk of text.

Both tokenizers cut a text at its blanks before they merge anything, so a text's
tokens are those of its chunks between blanks, one after the other.  Words repeat,
so each chunk is encoded once and looked up afterwards.  A cache lives as long as its
Python worker, over tasks; it is emptied when it is full and holds no long chunks, which
bounds its memory (about 100 MB).
"""

from __future__ import annotations

import sys
from collections.abc import Callable

CACHED = 400_000  # chunks, and as many words
LONGEST = 64  # characters of a cached chunk


class _Cache(dict):
    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str):
        value = self.encode(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
            self[chunk] = value
        return value


class WordIds:
    """Ids of a word-end BPE file as little-endian unsigned 32-bit numbers.

    White space never reaches a token and always ends a word, so blanks and line
    ends can be cut away first; rarer white space stays inside its chunk.  A word of
    Latin-1 letters is one piece whatever marks follow it, and such letters are lower-cased
    one by one: it goes to the merges directly.  All else goes the file's whole way.
    """

    def __init__(self, path: str) -> None:
        import re
        from array import array

        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        width = {array(c).itemsize: c for c in "LI"}[4]

        def pack(ids: list[int]) -> bytes:
            numbers = array(width, ids)
            if sys.byteorder == "big":
                numbers.byteswap()
            return numbers.tobytes()

        full = _Cache(lambda chunk: pack(whole.encode(chunk, add_special_tokens=False).ids))
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in printable}
        letters |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
        merge, latin = whole.model.tokenize, re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch

        def word(lower: str) -> bytes:
            if not lower.isascii():
                lower = lower.encode().decode("latin-1").translate(letters)
            return pack([t.id for t in merge(lower)])

        words = _Cache(word)

        def encode(chunk: str) -> bytes:
            core = chunk.rstrip(".,!?;:$%&*#|")
            if latin(core):
                ids = words[core.lower()]
                return ids if core == chunk else ids + full[chunk[len(core) :]]
            return full[chunk]

        self._known = _Cache(encode)

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self._known.__getitem__, text.replace("\n", " ").split(" ")))


class ByteCounts:
    """Number of tokens of a byte-level BPE rank file, no special tokens.

    A blank belongs to the word after it, so a chunk is a word with its blank.
    Runs of blanks are one piece of their own: such texts are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        encoding = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self._encode = encoding.encode_ordinary
        self._known = _Cache(lambda chunk: len(self._encode(" " + chunk)))

    def __call__(self, text: str) -> int:
        if "  " in text:
            return len(self._encode(text))
        first, *rest = text.split(" ")
        return len(self._encode(first)) + sum(map(self._known.__getitem__, rest))


def shared(kind: type, path: str) -> Callable:
    """The encoder of a file in this Python process, made at most once."""
    import tokenizers

    # Functions of this package travel by value, so what should outlive a task is kept by an imported module.
    made = tokenizers.__dict__.setdefault("_encoders_of_process", {})
    name = (kind.__name__, path)
    if name not in made:
        made[name] = kind(path)
    return made[name]
