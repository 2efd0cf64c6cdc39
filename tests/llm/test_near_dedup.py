"""Near duplicates against all pairs, crowds included."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.llm import near_dedup
from quillmere.llm.words import hashed, words


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            row[j + 1], before = (before + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


def plain_runs(text):
    w = words(text)
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def plain_similarity(a, b):
    if not a or not b:
        return 0.0
    c = plain_lcs(a, b)
    return c / (len(a) + len(b) - c)


def text_of(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, share):
    out = []
    for w in text.split():
        k = rng.random()
        out += [] if k < share / 3 else [w, "ins"] if k < share * 2 / 3 else [f"e{rng.randrange(99)}"] if k < share else [w]
    return " ".join(out)


def test_alignment_equals_the_full_table():
    rng = random.Random(3)
    for _ in range(150):
        a = [rng.randrange(30) for _ in range(rng.randrange(0, 70))]
        b = [x for x in a if rng.random() > 0.1] + [rng.randrange(30) for _ in range(rng.randrange(0, 5))]
        want = plain_similarity(a, b)
        got = near_dedup.aligned_similarity(np.array(a, np.uint32), np.array(b, np.uint32))
        assert got == (pytest.approx(want) if want >= 0.8 - 1e-9 else 0.0)


def classes(rows):
    """Connected components of all pairs at 0.8, texts with equal words being one."""
    runs = [plain_runs(t or "") for _, t in rows]
    seqs = [tuple(words(t or "")) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if comp[i] != comp[j] and (seqs[i] == seqs[j] or plain_similarity(runs[i], runs[j]) >= 0.8):
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    return {rows[i][0]: max(r[0] for r, c in zip(rows, comp, strict=True) if c == comp[i]) for i in range(len(rows))}


@pytest.mark.parametrize("small", [2, 32])
def test_classes_equal_all_pairs(spark, small):
    rng = random.Random(8)
    rows = []
    for _ in range(12):
        base = text_of(rng, rng.randrange(40, 160))
        rows += [base] + [edited(rng, base, s) for s in (0.0, 0.01, 0.02, 0.03, 0.1)]
    passage = text_of(rng, 60)
    rows += [passage + " " + text_of(rng, 40) for _ in range(25)]
    crowd = text_of(rng, 150)
    rows += [edited(rng, crowd, 0.015) for _ in range(60)]
    rows += ["", None, "one two", "One, two!", "one two three", "...", "é è"]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame([(i, t, 1, "b") for i, t in rows], "doc_id long, text string, row int, bands string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_groups(docs.repartition(5), small).collect()}
    want = classes(rows)
    assert len(got) == len(rows)
    lost = sum(got[i] != want[i] for i in want)
    assert lost <= len(want) * 0.02, lost
    # nothing that all pairs keep apart is joined
    assert all(want[i] == want[got[i]] for i in want)


def test_rows_with_trouble(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_groups(docs).collect()
    assert sorted((r.doc_id or -1, r.class_id or -1, r.class_size) for r in got) == [
        (-1, -1, 1), (-1, 2, 4), (-1, 2, 4), (2, 2, 4), (2, 2, 4)
    ]
    assert sum(r.kept for r in got) == 2
    assert sorted(r.text or "" for r in near_dedup.drop_near_copies(docs).collect()) == ["", "a b c d e f g"]
    assert near_dedup.near_groups(docs.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (100, 102)]
    got = {r.node: r.comp for r in near_dedup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_bands_read_order_and_length():
    number = hashed()
    runs = near_dedup.runs_of(number("one two three four five six seven eight"))
    assert len(runs) == 4 and len(near_dedup.bands_of(runs)) == near_dedup.SKETCHES // near_dedup.PER_BAND
    assert near_dedup.bands_of(runs) != near_dedup.bands_of(runs[::-1].copy())
    assert len(near_dedup.bands_of(near_dedup.runs_of(number("a")))) == 12 and near_dedup.bands_of(runs[:0]) == []
    long = np.random.default_rng(1).integers(0, 1 << 32, near_dedup._COLUMNS * 2 + 9, np.uint32)
    assert len(set(near_dedup.bands_of(long)) & set(near_dedup.bands_of(long[5:]))) > 9


def test_members_of_few_crowds_are_dealt_too(spark):
    """Texts that share 75 of 100 runs, and pairs above 0.8 whose common bands are all crowded."""
    rng, number = random.Random(12), hashed()
    passage = text_of(rng, 79, 10**6)  # 75 runs

    def bands(text):
        return set(near_dedup.bands_of(near_dedup.runs_of(number(text))))

    crowd = [f"{passage} {text_of(rng, 25, 10**6)}" for _ in range(130)]
    seen = Counter(b for t in crowd for b in bands(t))
    full = {b for b, n in seen.items() if n > near_dedup.SMALL}
    pairs = []
    while len(pairs) < 4:
        more = text_of(rng, 16, 10**6)
        a, b = (f"{passage} {more} {text_of(rng, 9, 10**6)}" for _ in range(2))
        both = bands(a) & bands(b)
        if both and both <= full and min(len(bands(a) & full), len(bands(b) & full)) <= 4:
            pairs.append((a, b))
    texts = crowd + [t for p in pairs for t in p]
    assert all(plain_similarity(plain_runs(a), plain_runs(b)) >= 0.8 for a, b in pairs)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in near_dedup.near_groups(docs).collect()}
    want = {i: i + 1 if i >= len(crowd) and (i - len(crowd)) % 2 == 0 else i for i in range(len(texts))}
    assert got == want


def test_texts_that_hubs_cover(spark):
    """Six of eight shared paragraphs each: every bucket is crowded and the hubs hold all runs of most texts."""
    rng = random.Random(21)
    paragraphs = [text_of(rng, 30, 10**6) for _ in range(8)]
    rows = []
    for pick in combinations(range(8), 6):
        body = " ".join(paragraphs[k] for k in pick)
        rows += [f"{body} {text_of(rng, 3, 10**6)}" for _ in range(11)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in near_dedup.near_groups(docs).collect()}
    assert got == classes(rows)


def test_pairs_inside_the_hub_are_links(spark):
    """Two texts of runs that a longer hub has all of share nothing beyond it, nor a bucket that is not crowded."""
    rng = np.random.default_rng(3)
    hub = rng.integers(0, 1 << 32, 400, np.uint32)
    texts = [hub, *(rng.integers(0, 1 << 32, 100, np.uint32) for _ in range(9)), hub[:100], hub[:95], hub[200:290]]
    level = [(i, 7, len(texts)) for i in range(len(texts))] + [(0, 8, 100)]
    level = spark.createDataFrame(level, "node long, key long, n long").selectExpr("*", "false AS linked", "CAST(null AS bigint) AS parent")
    runs = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in enumerate(texts)], "node long, runs binary")
    assert {tuple(sorted(r)) for r in near_dedup.links(level, runs).collect()} == {(10, 11)}
    star = spark.createDataFrame([(1, i, i > 10) for i in range(10, 13)], "star long, a long, linked boolean").withColumn("covered", F.lit(True))
    assert [tuple(sorted(r)) for r in near_dedup.among_covered(star, runs, 1).collect()] == [(10, 11)]


def test_columns_with_names_of_ours(spark):
    rows = [(i, f"one two three four five six {i // 2}", "a", "b", "c", 1) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __digest string, __id string, __sha string, sha int")
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [rows[i] for i in (1, 3, 5)]
