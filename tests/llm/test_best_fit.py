"""Best-fit packing against a plain search over open bins, and every document put back together."""

import math
import random
import zlib

import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from quillmere.llm import best_fit
from quillmere.llm.best_fit import OpenBins


def plain_best_fit(sizes, length, places):
    """Bins as lists of item numbers, by looking at every open bin."""
    done, open_bins = [], []
    for k, n in enumerate(sizes):
        fits = [b for b in open_bins if length - b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: length - b[0])
        else:
            if n < length and len(open_bins) >= places:
                fullest = max(open_bins, key=lambda b: b[0])
                open_bins.remove(fullest)
                done.append(fullest)
            b = [0]
            open_bins.append(b)
        b[0] += n
        b.append(k)
        if b[0] == length:
            open_bins.remove(b)
            done.append(b)
    return sorted(b[0] for b in done), sorted(b[0] for b in open_bins)


@pytest.mark.parametrize("places", [1, 3, 20])
def test_bins_fill_like_a_plain_search(places):
    rng = random.Random(places)
    for _ in range(30):
        length = rng.choice([10, 64])
        sizes = [rng.choice([1, length, rng.randint(1, length)]) for _ in range(200)]
        bins, closed = OpenBins(length, places), []
        for k, n in enumerate(sizes):
            closed += bins.put(n, k)
            assert len(bins.rest()) <= places
        fills = [sorted(sum(n for n, _ in b) for b in kind) for kind in (closed, bins.rest())]
        assert tuple(fills) == plain_best_fit(sizes, length, places)
        assert sorted(k for b in closed + bins.rest() for _, k in b) == list(range(len(sizes)))


ROWS = [
    (i, t) for i, t in enumerate([None, "", "a b c", "naïve. façade!", "x" * 300, "word " * 9000, "one two " * 2048, "tail"] * 3)
] + [(None, None), (2, "a b c"), (2, "a b c")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, 2, True) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, length int, part int, open boolean").repartition(5)


@pytest.mark.parametrize(("length", "places"), [(7, 2), (4096, 128)])
def test_every_document_comes_back(docs, length, places):
    model = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    rows = best_fit.pack(docs, length, open_bins=places, merged_tasks=2).collect()
    sequences, by_doc = {}, {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and r["start"] == r["piece"] * length
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= length
    for doc_id, texts in {i: [t for j, t in ROWS if j == i] for i, _ in ROWS}.items():
        ids = [*model.encode(texts[0] or "", add_special_tokens=False).ids, 1]
        whole = b"".join(i.to_bytes(4, "little") for i in ids)
        own = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == sorted(list(range(math.ceil(len(ids) / length))) * len(texts))
        for r in own:
            assert r["ids"] == whole[4 * r["start"] : 4 * (r["start"] + length)]


def test_open_ends_of_tasks_meet(spark):
    docs = spark.createDataFrame([(i, "word " * 500) for i in range(64)], "doc_id long, text string").repartition(16)
    rows = best_fit.pack(docs).collect()
    tokens = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) == math.ceil(len(rows) / (4096 // rows[0]["length"])) and tokens == 64 * 501


def test_checksums_and_empty_table(spark, docs):
    assert best_fit.pieces(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    model = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    ids = [*model.encode("naïve. façade!", add_special_tokens=False).ids, 1]
    want = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
    assert {r["ids_crc32"] for r in best_fit.pieces(docs).filter("doc_id = 3").collect()} == {want}
