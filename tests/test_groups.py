"""Large groups of a stream are held small and leave in pieces."""

import numpy as np
import pandas as pd

from quillmere.streaming import gates, groups, state


def frames(rows, n=7):
    return iter([pd.DataFrame(rows[at : at + n]) for at in range(0, len(rows), n)])


class Held:
    """A value state or a map state in a process of its own."""

    def __init__(self):
        self.at = {}

    def get(self):
        return self.at.get(None)

    def update(self, value):
        self.at[None] = value

    def iterator(self):
        return iter(self.at.items())

    def updateValue(self, key, value):
        self.at[key] = value

    def removeKey(self, key):
        del self.at[key]


def test_rows_leave_in_order_and_in_pieces(monkeypatch):
    monkeypatch.setattr(groups, "PIECE", 10)
    start = pd.Timestamp("2024-01-01")
    rows = [{"ts": start + pd.Timedelta(seconds=i * 7 % 31), "seq": i, "n": i / 2, "text": None if i % 5 == 0 else f"é{i}"} for i in range(45)]
    held = groups.OrderedRows(frames(rows), ("n",), ("text",))
    assert not any(t == object for t in held.numbers.dtypes)
    pieces = [p for _, p in held.pieces()]
    want = pd.DataFrame(rows).sort_values(["ts", "seq"], kind="stable")
    assert [len(p) for p in pieces] == [10, 10, 10, 10, 5]
    assert pd.concat(pieces)["seq"].tolist() == want["seq"].tolist() and pd.concat(pieces)["text"].tolist() == want["text"].tolist()


def test_gate_and_cache_answer_in_pieces_as_they_would_at_once(monkeypatch):
    start = pd.Timestamp("2024-01-01")
    rng = np.random.default_rng(3)
    asked = [{"domain": "d", "seq": i, "ts": start + pd.Timedelta(seconds=int(rng.integers(0, 400))), "robots_ok": bool(i % 4), "delay": 20.0} for i in range(200)]
    cached = [{"cache": "c", "key": f"k{rng.integers(0, 9)}", "seq": i, "ts": r["ts"], "value": f"v{i}"} for i, r in enumerate(asked)]
    for make, rows in ((gates._Gate, asked), (lambda: state._LruCache(4, 60_000), cached)):
        answers = []
        for size in (1000, 10):
            monkeypatch.setattr(groups, "PIECE", size)
            processor = make()
            processor.last = processor.entries = Held()
            out = list(processor.handleInputRows((rows[0].get("domain", "c"),), frames(rows), None))
            assert max(map(len, out)) <= size and len(out) == (1 if size == 1000 else 20)
            answers.append((pd.concat(out, ignore_index=True), processor.entries.at))
        pd.testing.assert_frame_equal(*(a[0] for a in answers))
        assert answers[0][1] == answers[1][1] and len(answers[0][0]) == 200
