"""Decontamination against plain BM25 and plain search."""

import random
from collections import Counter

import numpy as np
import pytest

from quillmere.llm import decontamination as d
from quillmere.llm.words import WordNumbers, words


def text_of(rng, n, vocabulary=300):
    return " ".join(f"w{int(rng.random() ** 3 * vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def items():
    rng = random.Random(4)
    return [(i, text_of(rng, rng.randrange(8, 60)) + ". " + text_of(rng, rng.randrange(1, 9)) + ".") for i in range(70)]


def plain_scores(items, terms):
    flats = {i: words(t) for i, t in items}
    n, mean = len(flats), sum(map(len, flats.values())) / len(flats)
    df = Counter(w for f in flats.values() for w in set(f))
    out = {}
    for i, f in flats.items():
        norm = d.K1 * (1 - d.B + d.B * len(f) / mean)
        one = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (d.K1 + 1) / (c + norm) for w, c in Counter(f).items()}
        out[i] = sum(x for w, x in one.items() if w in terms) / sum(one.values())
    return out


def test_pruned_search_loses_nothing(items):
    index, rng = d.Index(items), random.Random(5)
    for threshold in (0.2, 0.5, 0.7):
        for _ in range(60):
            terms = {f"w{int(rng.random() ** 3 * 300)}" for _ in range(rng.randrange(1, index.width))}
            numbers = np.array(sorted(index.vocabulary[t] for t in terms if t in index.vocabulary), np.int64)
            alive = index.bounds(numbers)[0] >= threshold if numbers.size else None
            got = {index.ids[k]: s for k, s in index.above(numbers, alive, threshold)} if numbers.size else {}
            want = {i: s for i, s in plain_scores(items, terms).items() if s >= threshold}
            assert got == pytest.approx(want)


def test_planted_items_are_found_and_others_left_alone(spark, items):
    rng = random.Random(6)
    rows, want = [], set()
    for i in range(150):
        body = [text_of(rng, 60, 5000) for _ in range(rng.randrange(0, 12))]
        if i % 3 == 0:
            k, t = items[i % len(items)]
            t = t.upper() if i % 2 else t.replace(" ", "\n").replace(".", " -- ")
            body.insert(rng.randrange(0, len(body) + 1), t)
            want.add((i, k))
        rows.append((i, "\n".join(body), "x"))
    rows += [(None, items[2][1], "x"), (900, None, "x"), (901, "", "x"), (902, items[3][1] * 2, "x"), (902, items[3][1] * 2, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([*items, items[0], (500, None), (501, "too short"), (None, None)], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in d.contaminations(docs, bench).collect()]
    want |= {(None, 2), (902, 3)}
    assert set(got) == want and got.count((902, 3)) == 2
    clean = d.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _, _ in rows if i is not None and i not in {x for x, _ in want})


def test_long_items_and_shards(spark, monkeypatch, items):
    monkeypatch.setattr(d, "SHARD", 20)
    rng = random.Random(7)
    long = (777, text_of(rng, 900, 4000))
    bench = spark.createDataFrame([*items, long], "item_id long, text string")
    docs = spark.createDataFrame([(1, text_of(rng, 500, 9000) + " " + long[1] + " tail"), (2, text_of(rng, 2000, 9000))], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in d.contaminations(docs, bench).collect()] == [(1, 777)]


def test_a_long_item_does_not_loosen_short_ones(spark, items):
    rng = random.Random(8)
    short = (900, " ".join(f"s{k}" for k in range(20)) + ". " + " ".join(f"t{k}" for k in range(6)) + ".")
    thin = [" ".join(x for w in words(short[1]) for x in (w, text_of(rng, 25, 9000))) for _ in range(6)]
    docs = spark.createDataFrame([*enumerate(thin), (50, text_of(rng, 90, 9000) + " " + short[1])], "doc_id long, text string")
    for more in ([], [(901, text_of(rng, 900, 4000))]):
        bench = spark.createDataFrame([*items, short, *more], "item_id long, text string")
        assert [(r.doc_id, r.item_id) for r in d.contaminations(docs, bench).collect()] == [(50, 900)]


def test_shards_change_no_answer(spark, monkeypatch, items):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        flat = words(items[i][1])
        kept = [w for w in flat if rng.random() > i / 150]  # from whole copies to thinned ones
        rows.append((i, text_of(rng, rng.randrange(0, 80), 5000) + " " + " ".join(kept) + " " + text_of(rng, 30, 5000)))
    docs = spark.createDataFrame([*rows, (60, "say zig zag now")], "doc_id long, text string")
    bench = spark.createDataFrame([*items, (700, "Zig, zag!"), (701, "zag zig")], "item_id long, text string")
    whole = sorted(map(tuple, d.contaminations(docs, bench).collect()))
    monkeypatch.setattr(d, "SHARD", 9)
    dealt = sorted(map(tuple, d.contaminations(docs, bench).collect()))
    assert [x[:2] for x in dealt] == [x[:2] for x in whole] and 10 < len(whole) < 61
    assert [x[2:] for x in dealt] == [pytest.approx(x[2:]) for x in whole]


def test_short_items_come_back_word_by_word(spark):
    rng = random.Random(10)
    short = [(i, " ".join(f"w{rng.randrange(5)}" for _ in range(rng.randrange(1, 5)))) for i in range(40)] + [(40, "w1 ... ?!"), (41, "?!")]
    texts = [(i, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(0, 12)))) for i in range(50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = set()
    for i, t in texts:
        for k, s in short:
            flat, item = words(t), words(s)
            at = [p for p in range(len(flat)) if item and flat[p : p + len(item)] == item]
            want |= {(i, k, at[0])} if at else set()
    bench = spark.createDataFrame(short, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.at) for r in d.contaminations(docs, bench).collect()} == want
    clean = {r.doc_id for r in d.drop_contaminated(docs, bench).collect()}
    assert clean == {i for i, _ in texts} - {i for i, _, _ in want}


def test_empty(spark, items):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert d.contaminations(docs, bench.limit(0)).count() == 0 and d.drop_contaminated(docs, bench.limit(0)).count() == 1
    assert d.contaminations(docs.limit(0), bench).count() == 0


def test_question_and_answer():
    assert d.question_and_answer("One two three four five six. Yes.") == (["one", "two"], ["three", "four", "five", "six", "yes"])
    assert d.question_and_answer("") == ([], []) and d.question_and_answer("a b c")[0] == ["a", "b", "c"]


def test_numbers_of_unusual_chunks():
    number = WordNumbers(lambda w: len(w))
    assert number("| a,b cc").tolist() == [1, 1, 2] and number("| cc").tolist() == [2] and number("").tolist() == []
