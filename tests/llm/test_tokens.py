"""Token counts and packing against the tokenizers themselves."""

import base64
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from tokenizers import Tokenizer

from quillmere.llm import packing, token_counts
from quillmere.llm.tokens import ByteCounts, WordIds

TEXTS = [
    "", "  ", "a  b   c", "İstanbul ΣΑΣ x́y é  a\tb\r\nc it's I'LL don't! ½ ª º ß ÿ 12345 <|endoftext|> a<|endoftext|>b",
    "\x1c\x1d a\x1cb", "x" * 500, " lead", "trail ", "trail  ", "a \n b\n\nc \n", "ŸÀ× ÷é naïve, façade!! Ñ$$$",
    "naïve. naïve, NAÏVE", "日本語 テスト", "word|word #tag", "é", "'s it's", "fine." * 40,
]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (3, TEXTS[3]), (3, TEXTS[3])]


def word_ids(text):
    model = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    return np.asarray(model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def byte_count(text):
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    e = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return len(e.encode_ordinary(text))


def test_cached_encoders_equal_the_tokenizers():
    ids, count = WordIds(public.path("word_bpe_49k.json")), ByteCounts(public.path("byte_bpe_50k.tiktoken"))
    for text in TEXTS:
        assert ids(text) == ids(text) == word_ids(text), text
        assert count(text) == count(text) == byte_count(text), text


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 7) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, docs long").repartition(3)


def test_histogram_answers_every_limit(docs):
    lengths = [byte_count(t or "") for _, t in ROWS]
    hist = token_counts.length_histogram(docs)
    got = {r["n_tokens"]: r for r in hist.collect()}
    assert {k: r["docs"] for k, r in got.items()} == Counter(lengths)
    for k, r in got.items():
        assert r["docs_at_least"] == sum(n >= k for n in lengths)
        assert r["docs_at_most"] == sum(n <= k for n in lengths)
        assert r["tokens_at_least"] == sum(n for n in lengths if n >= k)
        assert r["truncated_tokens"] == sum(min(n, k) for n in lengths)
    for limit in (0, 3, 10**6):
        r = token_counts.total_at_limit(hist, limit).first()
        assert (r["docs_over"], r["tokens_kept"]) == (sum(n > limit for n in lengths), sum(min(n, limit) for n in lengths))
    for q in (0.01, 0.5, 1.0):
        want = sorted(lengths)[max(0, int(np.ceil(q * len(lengths))) - 1)]
        assert token_counts.length_quantile(hist, q).first()["n_tokens"] == want


def test_suffix_sums_cross_blocks(spark):
    rows = [(i, "word " * n) for i, n in enumerate((5, 3000, 5000, 9000))]
    hist = token_counts.length_histogram(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("n_tokens").collect()
    assert [r["docs_at_least"] for r in hist] == [4, 3, 2, 1]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.length_histogram(none).count() == 0
    assert packing.pieces(none).count() == 0


@pytest.mark.parametrize("length", [7, 4096])
def test_pieces_put_every_document_back_together(docs, length):
    rows = packing.pack(docs, length).collect()
    seqs: dict = {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and 0 < r["length"] <= length
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, spans in seqs.items():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at == length or k == max(seqs)
    assert sorted(seqs) == list(range(len(seqs)))
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc_id, pieces in by_doc.items():
        texts = [t or "" for i, t in ROWS if i == doc_id]
        want = [word_ids(t) + (2).to_bytes(4, "little") for t in texts]
        whole = b"".join(p["ids"] for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])))
        assert sum(p["length"] for p in pieces) * 4 == len(whole) == sum(map(len, want))
        if len(texts) == 1:
            assert whole == want[0]
            at = 0
            for p in sorted(pieces, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(want[0]) // 4
                at += p["length"]


def test_checksums(docs):
    whole = {(r["doc_id"], r["start"]): zlib.crc32(r["ids"]) for r in packing.pack(docs).filter("doc_id < 3").collect()}
    got = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in packing.pieces(docs).filter("doc_id < 3").collect()}
    assert got == whole
