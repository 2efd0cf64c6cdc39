"""Benchmark decontamination: BM25 over the test items, block-max pruning, overlap checks.

The test items are the indexed side: an inverted index with BM25 impacts, each divided by
the item's own full score, so that one threshold fits short and long items.  Word counts,
item count and mean length are those of all items, counted by Spark.

Items stand in classes of length, each up to twice as long as its shortest, and in order of
length in blocks of four; every term knows its greatest impact in each block.  Every passage
of every document is a query: for each class, windows that overlap by three quarters, so wide
that an item of the class always lies whole in one of them.  As the threshold is fixed, a
window skips every block whose greatest impacts, summed over its terms, stay below it; these
bounds are sums over quarters of windows, taken for all blocks of a class at once.  Only
blocks that can reach the threshold have their postings read.  Every item above it is
checked: the words of its question and of its answer must come back in order.  Whether a
document repeats an item so depends on the item and the counts, not on its neighbours.

Items of fewer than five words have no use for scores: they are found where all their words
come one after the other, by a trie over term numbers.

Documents are never shuffled.  Indexes are built on the driver for a bounded number of items
and words at a time, and documents meet one such shard after the other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import cut_lineage
from .common import documents
from .words import WordNumbers, words

SHARD = 2_000  # items indexed at once, about; the bounds of 500 blocks and 40,000 terms take 80 MB
SHARD_WORDS = 100_000  # words of the items indexed at once, about; changes no answer, nor does SHARD
BLOCK = 4
_WORDS = 1 << 15  # words whose bounds are summed at once
STEPS = 4  # windows start every quarter of their width
THRESHOLD = 0.7  # of an item's own score
COVER = 0.8  # words of an item, in order
ANSWER_WORDS = 5
MIN_WORDS = 5  # of an item that is scored; shorter ones must come back word by word
K1, B = 1.2, 0.75
HITS = "array<struct<item_id: bigint, score: double, question_overlap: double, answer_overlap: double, at: bigint>>"


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The answer is the last sentence or line, stretched back to at least five words; the rest asks."""
    import re

    parts = [w for p in re.split(r"[.!?\n]+", text) if (w := words(p))]
    flat = [w for p in parts for w in p]
    if not flat:
        return [], []
    cut = min(len(flat) - len(parts[-1]), max(0, len(flat) - ANSWER_WORDS))
    return (flat[:cut], flat[cut:]) if cut else (flat, flat)


def class_of(length: int) -> int:
    """Class of an item's length: lengths from 2 ** (c - 1) to 2 ** c - 1."""
    return length.bit_length()


class Index:
    """BM25 postings of the items of five words or more, by term and block.

    ``figures`` is (number of items, mean length, items with each word) of the whole
    benchmark, by default of ``items``; ``vocabulary`` may be shared by several indexes.
    """

    def __init__(
        self,
        items: list[tuple[int, str]],
        figures: tuple[int, float, dict[str, int]] | None = None,
        vocabulary: dict[str, int] | None = None,
    ) -> None:
        import numpy as np

        parsed = [(i, *question_and_answer(t or "")) for i, t in items]
        parsed = [(i, q, a, q + a if q is not a else q) for i, q, a in parsed]
        parsed = sorted((x for x in parsed if len(x[3]) >= MIN_WORDS), key=lambda x: (len(x[3]), x[3]))
        self.ids = [x[0] for x in parsed]
        self.vocabulary: dict[str, int] = {} if vocabulary is None else vocabulary
        if figures is None:
            counts = Counter(w for x in parsed for w in set(x[3]))
            figures = len(parsed), sum(len(x[3]) for x in parsed) / max(1, len(parsed)), counts
        n, mean, df = figures
        rows, self.questions, self.answers = [], [], []
        for k, (_, q, a, flat) in enumerate(parsed):
            norm = K1 * (1 - B + B * len(flat) / mean)
            impact = {
                w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm)
                for w, c in Counter(flat).items()
            }
            own = sum(impact.values())
            number = {w: self.vocabulary.setdefault(w, len(self.vocabulary)) for w in impact}
            rows += [(number[w], k, v / own) for w, v in impact.items()]
            self.questions.append(np.array([number[w] for w in q]))
            self.answers.append(np.array([number[w] for w in a]))
        # The longest of its class and a quarter still fit in a window.
        longest = (1 << class_of(max((len(x[3]) for x in parsed), default=1))) - 1
        self.width = STEPS * -(-longest // (STEPS - 1))
        v = len(self.vocabulary)
        rows.sort()
        terms = np.array([r[0] for r in rows], np.int64)
        self.item = np.array([r[1] for r in rows], np.int64)
        self.impact = np.array([r[2] for r in rows])
        self.start = np.searchsorted(terms, np.arange(v + 1))
        self.blocks = -(-len(parsed) // BLOCK)
        # The last row belongs to words outside the index, numbered -1.
        self.most = np.zeros((v + 1, self.blocks), np.float32)
        np.maximum.at(self.most, (terms, self.item // BLOCK), np.nextafter(self.impact.astype(np.float32), np.float32(2)))

    def above(self, terms, alive, threshold: float):
        """(item, score) of all items in the ``alive`` blocks that a set of terms scores at or above the threshold."""
        import numpy as np

        posts = np.concatenate([np.arange(self.start[t], self.start[t + 1]) for t in terms])
        posts = posts[alive[self.item[posts] // BLOCK]]
        score = np.bincount(self.item[posts], self.impact[posts])
        return [(int(k), float(score[k])) for k in np.flatnonzero(score >= threshold)]

    def bounds(self, t):
        """Greatest score of each block in each window; windows start every quarter of their width."""
        import numpy as np

        step = self.width // STEPS
        padded = np.full(-(-t.size // step) * step, -1)
        padded[: t.size] = t
        rows = np.sort(padded.reshape(-1, step), 1)
        rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = -1  # a repeated word counts once in a quarter
        take = max(1, _WORDS // step)
        quarter = np.concatenate([self.most[rows[k : k + take]].sum(1) for k in range(0, len(rows), take)])
        out = quarter.copy()
        for j in range(1, STEPS):
            out[:-j] += quarter[j:]
        return out


def in_order(pattern, stretch) -> float:
    """Share of the pattern's words that come in the stretch in the same order."""
    where: dict[int, int] = {}
    for i, x in enumerate(pattern.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = free = (1 << len(pattern)) - 1
    for x in stretch.tolist():
        if (u := where.get(x, 0) & free):
            free = ((free + u) | (free - u)) & full
    return (len(pattern) - free.bit_count()) / len(pattern)


def hits_in(index: Index, t, threshold: float = THRESHOLD, cover: float = COVER) -> list[dict]:
    """The items that a document, as term numbers with -1 for other words, repeats."""
    import numpy as np

    if not t.size or not index.ids:
        return []
    step, found = index.width // STEPS, {}
    alive = index.bounds(t) >= threshold - 1e-4
    for s in np.flatnonzero(alive.any(1)).tolist():
        terms = np.unique(t[s * step : s * step + index.width])
        for k, score in index.above(terms[terms >= 0], alive[s], threshold - 1e-9):
            score = round(score, 9)  # sums of equal windows differ in their last bits
            if k in found and found[k]["score"] >= score:
                continue
            q, a = index.questions[k], index.answers[k]
            room = len(q) + len(a)
            stretch = t[max(0, s * step - room) : s * step + index.width + room]
            asked, answered = in_order(q, stretch), in_order(a, stretch)
            if min(asked, answered) >= cover - 1e-9:
                found[k] = {
                    "item_id": index.ids[k],
                    "score": score,
                    "question_overlap": asked,
                    "answer_overlap": answered,
                    "at": s * step,
                }
    return sorted(found.values(), key=lambda h: (h["item_id"] is None, h["item_id"], h["at"]))


def short_trie(items: list[tuple[int, str]], vocabulary: dict[str, int]) -> dict:
    """Trie of the items of one to four words; ``vocabulary`` must be complete after it."""
    import numpy as np

    edges: dict[tuple[int, int], int] = {}
    accepts: dict[int, list] = {}
    for i, text in items:
        flat = words(text or "")
        if 0 < len(flat) < MIN_WORDS:
            state = 0
            for w in flat:
                state = edges.setdefault((state, vocabulary.setdefault(w, len(vocabulary))), len(edges) + 1)
            accepts.setdefault(state, []).append(i)
    size = len(vocabulary) + 1
    codes = np.array([s * size + t for s, t in edges], np.int64)
    order = np.argsort(codes)
    return {"size": size, "codes": codes[order], "to": np.array(list(edges.values()), np.int64)[order], "accepts": accepts}


def short_hits(short: dict, t) -> list[dict]:
    """The short items whose words all come one after the other, each at its first place."""
    import numpy as np

    found, codes = [], short["codes"]
    if not codes.size:
        return found
    start = np.flatnonzero(t >= 0)
    state, depth = np.zeros(start.size, np.int64), 0
    while start.size:
        code = state * short["size"] + t[start + depth]
        place = np.minimum(np.searchsorted(codes, code), codes.size - 1)
        good = codes[place] == code
        state, start, depth = short["to"][place[good]], start[good], depth + 1
        for x, k in zip(*(y.tolist() for y in np.unique(state, return_index=True)), strict=True):
            found += [
                {"item_id": i, "score": 1.0, "question_overlap": 1.0, "answer_overlap": 1.0, "at": int(start[k])}
                for i in short["accepts"].get(x, ())
            ]
        on = start + depth < t.size
        on[on] = t[start[on] + depth] >= 0
        state, start = state[on], start[on]
    return found


class Shard:
    """Indexes of some items, one for each class of lengths, and a trie of the short ones, over one vocabulary."""

    def __init__(self, items: list[tuple[int, str]], figures: tuple[int, float, dict[str, int]] | None = None) -> None:
        classes: dict[int, list] = {}
        for i, text in items:
            classes.setdefault(class_of(len(words(text or ""))), []).append((i, text))
        self.vocabulary: dict[str, int] = {}
        for _, text in items:
            for w in words(text or ""):
                self.vocabulary.setdefault(w, len(self.vocabulary))
        if figures is None:
            parsed = [words(t or "") for _, t in items]
            full = [x for x in parsed if x]
            figures = len(full), sum(map(len, full)) / max(1, len(full)), Counter(w for x in full for w in set(x))
        built = [Index(part, figures, self.vocabulary) for _, part in sorted(classes.items())]
        self.indexes = [x for x in built if x.ids]
        self.short = short_trie(items, self.vocabulary)


def shards(benchmark: DataFrame) -> Iterator[Shard]:
    """All items with any word, a bounded number at a time, dealt by a hash of the item."""

    @F.pandas_udf("array<string>")
    def words_of(texts: pd.Series) -> pd.Series:
        return texts.map(words)

    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    items = cut_lineage(items.distinct().withColumn("words", words_of("text")), "benchmark-items").filter(F.size("words") > 0)
    n, total = items.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    if not n:
        return
    counted = items.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    counted = cut_lineage(counted, "benchmark-words")
    many = max(-(-n // SHARD), -(-total // SHARD_WORDS))
    for k in range(many):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == k)
        known = part.select(F.explode("words").alias("word")).distinct()
        df = {r["word"]: r["df"] for r in counted.join(known, "word").collect()}  # words of one shard
        rows = sorted(((r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()), key=repr)
        yield Shard(rows, (n, total / n, df))


def hits(docs: DataFrame, shard: Shard, threshold: float = THRESHOLD, cover: float = COVER) -> Column:
    """The items that the column ``text`` repeats, as an array; the indexes go to every worker once."""
    plain = (shard.vocabulary, [{k: v for k, v in vars(x).items() if k != "vocabulary"} for x in shard.indexes], shard.short)
    shared = docs.sparkSession.sparkContext.broadcast(plain)  # plain arrays: executors need no copy of this package

    @F.pandas_udf(HITS)
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary, known, short = shared.value
        indexes = [object.__new__(Index) for _ in known]
        for index, arrays in zip(indexes, known, strict=True):
            vars(index).update(arrays)
        number = WordNumbers(lambda w: vocabulary.get(w, -1))

        def of(text: str) -> list[dict]:
            t = number(text)
            found = short_hits(short, t) + [h for x in indexes for h in hits_in(x, t, threshold, cover)]
            return sorted(found, key=lambda h: (h["item_id"] is None, h["item_id"] or 0, h["at"]))

        for texts in parts:
            yield pd.Series([of(x) for x in texts])

    return find(F.coalesce(F.col("text"), F.lit("")))


def contaminations(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, cover: float = COVER
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, at): a row for each item a document repeats.

    score is the best window's share of the item's BM25 score and ``at`` its first word.

    Null texts count as empty and repeat nothing, nor does an item without a word; an item of
    fewer than five words is repeated where all its words come one after the other, with a score
    of 1, however common the phrase; repeated rows of documents are reported as often as
    they come, repeated items once; of equal windows the first counts; a very long text is searched
    whole, in its own row; null ids are kept; other columns are not read; an empty table of
    documents or items gives no rows.
    """
    out = None
    for shard in shards(benchmark):
        rows = documents(docs)
        part = rows.select("doc_id", F.explode(hits(rows, shard, threshold, cover)).alias("h")).select("doc_id", "h.*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        empty = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, at bigint"
        return docs.sparkSession.createDataFrame([], empty)
    return out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, cover: float = COVER
) -> DataFrame:
    """``docs`` without the rows that repeat a benchmark item; all columns stay as they are."""
    for shard in shards(benchmark):
        docs = docs.filter(F.size(hits(docs, shard, threshold, cover)) == 0)
    return docs
