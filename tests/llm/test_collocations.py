"""Collocations against plain counting; the trie against a dictionary of paths."""

import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from quillmere.llm import collocations
from quillmere.llm.collocations import double_array

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, lang string, text string, path string, n int, words int"


def plain_collocations(rows, max_words, min_count, top, percent):
    counts, sizes = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, max_words + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    kept = {x: a for x, a in counts.items() if len(x[1]) > 1 and a >= min_count}
    out = []
    for (lang, p), a in kept.items():
        if any(
            m == lang and len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q)))
            for (m, q), b in kept.items()
        ):
            continue
        cuts = [(counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))]
        score, _, (l, r) = min((1_000_000 * a * a // (l * r), k, (l, r)) for k, (l, r) in enumerate(cuts))
        out.append((lang, " ".join(p), a, l, r, sizes[lang], score))
    result = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        result += [(x[0], rank, *x[1:]) for rank, x in enumerate(mine, 1)]
    return sorted(result)


def random_rows(seed, n=300):
    rng = random.Random(seed)
    words = ["The", "the", "a", "ça", "x\x85y", "É", "é", "of", "new-york", "b\x1c", "日本", " z", *(f"w{i}" for i in range(60))]
    marks = [" ", "  ", "\t", ". ", ",", "\n", "\x0b", " ! ", " "]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words[: rng.choice([5, 12, 72])]) + rng.choice(marks) for _ in range(rng.randint(0, 60)))
        rows.append((i, rng.choice(["en", "fr", None, "und", ""]), rng.choice([text, text, text, None, ""]), "x", 1, 2))
    return rows


@pytest.mark.parametrize(("block", "shard", "bits", "max_words"), [(1 << 17, 500_000, 24, 3), (50, 40, 16, 3), (200, 100, 16, 4), (64, 9, 16, 2)])
def test_equals_plain_counting(spark, monkeypatch, block, shard, bits, max_words):
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(collocations, "SHARD", shard)
    monkeypatch.setattr(collocations, "MAX_BITS", bits)
    rows = random_rows(block)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = collocations.collocations(df, max_words, 5, 25, 50)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations([r[1:3] for r in rows], max_words, 5, 25, 50)


def test_odd_texts(spark):
    rows = [(None, "en", "x " * 200_000), (1, "en", "y" * 300_000), (1, "en", "A.b c,d"), (1, "en", "A.b c,d"), (2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert sorted(tuple(r) for r in collocations.collocations(df).collect()) == plain_collocations([r[1:] for r in rows], 3, 10, 2000, 50)
    assert collocations.collocations(spark.createDataFrame([], "doc_id long, lang string, text string")).count() == 0
    bare = spark.createDataFrame([(1, "en", ""), (2, "en", None), (3, "en", ". , ;")], "doc_id long, lang string, text string")
    assert collocations.collocations(bare).count() == 0


def test_trie_takes_just_its_paths():
    rng = random.Random(4)
    for size in (1, 2, 40, 3000):
        letters = [rng.getrandbits(63) + 1 for _ in range(rng.choice([3, 50]))]
        paths = {tuple(rng.choice(letters) for _ in range(rng.randint(2, 4))) for _ in range(size)}
        listed = [b"".join(x.to_bytes(8, "little") for x in p) for p in sorted(paths)]
        words, labels, base, check, accepts = double_array(listed)
        label = {int(w): int(k) for w, k in zip(words, labels, strict=True)}
        prefixes = {p[:k] for p in paths for k in range(1, len(p) + 1)}
        assert len(set(accepts.tolist())) == len(paths) and (check >= 0).sum() == len(prefixes)

        def walk(p):
            s = 0
            for x in p:
                t = int(base[s]) + label[x]
                if not 0 <= t < check.size or check[t] != s:
                    return None
                s = t
            return s

        for p, slot in zip(sorted(paths), accepts.tolist(), strict=True):
            assert walk(p) == slot
        for _ in range(2000):
            p = tuple(rng.choice(letters) for _ in range(rng.randint(1, 4)))
            if all(x in label for x in p):
                assert (walk(p) is not None) == (p in prefixes)
    assert np.all(np.diff(words.astype(np.float64)) > 0)


def test_jobs_do_not_grow_with_tries(spark, monkeypatch):
    df = spark.createDataFrame(random_rows(5), SCHEMA).repartition(4)
    jobs, answers = [], []
    for shard in (1 << 20, 20):
        monkeypatch.setattr(collocations, "SHARD", shard)
        spark.sparkContext.setJobGroup(f"tries-{shard}", "")
        answers.append(sorted(tuple(r) for r in collocations.phrase_counts(df, 3, 2)[1].collect()))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"tries-{shard}")))
    assert answers[0] == answers[1] and len(answers[0]) > 200
    # Adaptive plans may take a job more or less.
    assert jobs[1] <= jobs[0] + 3


def test_what_is_read_at_once_does_not_grow_with_the_blocks_of_a_task(spark, monkeypatch):
    held = []
    monkeypatch.setattr(collocations, "BLOCK", 1000)
    monkeypatch.setattr(collocations, "forget", lambda spark, *paths: held.append((paths, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rng = random.Random(2)
    rows = [(i, "en", " ".join(f"w{rng.randrange(400)}" for _ in range(1000))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1)
    sizes = []
    real = collocations._slots

    def slots(blocks, passed, bits, least):
        sent = blocks.mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), blocks.schema).count()
        sizes.append((blocks.count(), sent, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return real(blocks, passed, bits, least)

    monkeypatch.setattr(collocations, "_slots", slots)
    words, phrases = collocations.phrase_counts(df, 2, 3)
    assert sizes[0][0] == 150 and sizes[0][1] >= 150 / collocations.ROWS and sizes[0][2] == str(collocations.ROWS)
    assert held[0][1] == before == spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    # Rows of words lie between those of codes: no row holds more than its block, and rows are many.
    tables = [pq.read_table(f) for f in Path(held[0][0][0].removeprefix("file:")).glob("*.parquet")]
    for t in tables:
        at = np.flatnonzero(np.asarray(t["codes"].is_valid()))
        assert not at.size or np.all(np.diff(at) > 300)
    assert sum(t["codes"].null_count for t in tables) == sum(t["word"].length() - t["word"].null_count for t in tables) > 150 * 300
    assert words.count() == 400 and phrases.count() > 0


def test_windows_are_folded_as_they_come(monkeypatch):
    rng = np.random.default_rng(1)
    parts = [(rng.integers(0, 4, (50, 3)).astype(np.uint64), rng.integers(1, 9, 50)) for _ in range(20)]
    grid, n = collocations._folded(parts)
    want = Counter()
    for g, k in parts:
        for row, c in zip(g.tolist(), k.tolist(), strict=True):
            want[tuple(row)] += c
    assert {tuple(r): int(c) for r, c in zip(grid.tolist(), n, strict=True)} == want and len(grid) == len(want) == 64
