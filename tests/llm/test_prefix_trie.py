"""The burst trie against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from quillmere.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, head string, depth int, container long"


def plain_trie(rows):
    """Rows of the contract by looking at every prefix of every rebuilt conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), tie, (role, text)))
    own = {c: [t[2] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves = sum(sums[k][0] for k in kids[p]) if kids[p] else 1
        sums[p] = leaves, (len(members[p]) - 1) * words + sum(sums[k][1] for k in kids[p])
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *sums[p],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if rebuilt[c] == p).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def plain(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("most", [1, 12, 60, 10_000])
def test_equals_all_prefixes(spark, most):
    rng = random.Random(most)
    rows = []
    for c in range(0, 300):
        if c % 20 == 0 and c % 3 == 0:
            continue  # some families have no first conversation
        for turn in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((c, turn, rng.choice(["user", None]), rng.choice(["a", "a b", "", None, "ç\x85d e"]), "x", 1, 2))
    rows += [(400 + c, t, "user", f"same {t}", "x", 1, 2) for c in range(40) for t in range(30)]
    rows += [(None, 1, "user", "nobody", "x", 1, 2)]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(4), most)
    assert plain(rows_of(got)) == plain(plain_trie([r[:4] for r in rows]))


def test_nulls_ties_and_repeats(spark):
    rows = [
        (1, None, "user", "first"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (20, 2, None, None),
        (20, 1, "", ""), (21, 5, "user", "long " * 50_000), (22, None, None, None), (23, 9, "user", "q"), (-3, 1, "user", "q"),
    ]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    # Spark's remainder has the sign of the dividend: -3 is of family 0, which has no conversation.
    assert got.filter("depth = 0").first()["n_convs"] == 6
    positive = [r for r in rows if r[0] > 0]
    got = prefix_trie.conversation_trie(spark.createDataFrame(positive, "conv_id long, turn long, role string, text string"))
    assert plain(rows_of(got)) == plain(plain_trie(positive))


def test_empty_table(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_runs_of_ids_join_to_one_digest(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_IDS", 7)
    rows = [(c, 0, "user", "alike") for c in range(1, 101) if zlib.crc32(str(c).encode()) % 4 == 0]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert plain(rows_of(prefix_trie.conversation_trie(df))) == plain(plain_trie(rows))
