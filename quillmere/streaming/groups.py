"""Rows of one key of a micro-batch, held small and handed on in pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

PIECE = 10_000  # rows of a piece that leaves


class OrderedRows:
    """All rows of a key by (ts, seq): numbers as arrays, texts as Arrow bytes; no Python object for each row."""

    def __init__(self, rows: Iterator[pd.DataFrame], numbers: tuple[str, ...], texts: tuple[str, ...] = ()) -> None:
        held, read = [], {c: [] for c in texts}
        for piece in rows:
            held.append(piece[["ts", "seq", *numbers]])
            for c in texts:
                read[c].append(pa.array(piece[c], pa.large_string(), from_pandas=True))
        frame = pd.concat(held, ignore_index=True)
        held.clear()
        self.numbers = frame.sort_values(["ts", "seq"], kind="stable")
        self.place = self.numbers.index.to_numpy()
        self.texts = {c: pa.concat_arrays(read.pop(c)) for c in texts}

    def pieces(self) -> Iterator[tuple[slice, pd.DataFrame]]:
        """(where it lies, rows in order) of at most ``PIECE`` rows; texts become objects only here."""
        for at in range(0, len(self.place), PIECE):
            cut = slice(at, min(at + PIECE, len(self.place)))
            out = self.numbers.iloc[cut].reset_index(drop=True)
            for c, values in self.texts.items():
                out[c] = pd.Series(np.array(values.take(pa.array(self.place[cut])).to_pylist(), dtype=object), dtype=object)
            yield cut, out
