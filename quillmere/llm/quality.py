"""Quality classifier by positive-unlabelled learning.

Trusted positives are the labelled good texts; everything else that may be learned from is
unlabelled web text, whatever its label.  The share of good texts among the unlabelled (the
class prior) is estimated over all of them: a first model ranks positives against the
unlabelled, and the prior is the least ratio of the two tails of that ranking.  The final
model minimises the non-negative unbiased risk: the unlabelled count as bad, less the prior's
worth of positives, and where that difference falls below zero its gradient is undone.

Features are figures of the text's surface, read from whole texts in Arrow batches.  They are
small, so they are written once; prior, training rows and scores all come from that table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..runtime import cut_lineage
from .common import documents, held_out

TRAINING_ROWS = 20_000  # most positives, and most unlabelled rows, that the model is fitted on
THRESHOLD = 0.3
BINS = 256
NAMES = (
    "upper", "lower", "digit", "stop", "mark", "symbol", "bang", "bar", "blank", "line_end", "wide",
    "words", "word_length", "long_words", "distinct_words", "repeated_lines", "stops_per_word",
    "capital_words", "marked_words", "line_words", "stutter",
)
_PART = 1 << 20


def text_figures(text: str):
    """One number for each of NAMES; all zero for an empty text."""
    import numpy as np

    n = len(text)
    if not n:
        return np.zeros(len(NAMES))
    kinds = np.zeros(10)
    table = _kinds()
    for at in range(0, n, _PART):
        points = np.frombuffer(text[at : at + _PART].encode("utf-32-le", "surrogatepass"), "<u4")
        kinds += np.bincount(table[np.minimum(points, len(table) - 1)], minlength=10)[:10]
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    w = max(1, len(words))
    return np.array(
        [
            *(kinds / n),
            sum(1 for x in words if not x.isascii()) / w,
            np.log1p(len(words)),
            np.log1p(n / w),
            sum(1 for x in words if len(x) > 12) / w,
            len(set(words)) / w,
            1 - sum(map(len, set(lines))) / max(1, sum(map(len, lines))),
            kinds[3] / w,
            sum(1 for x in words if x[0].isupper()) / w,
            sum(1 for x in words if not x[-1].isalnum()) / w,
            np.log1p(w / max(1, len(lines))),
            sum(map(eq, words, words[1:])) / w,
        ]
    )


_KINDS: list = []


def _kinds():
    """Kind of each code point below 0x3000: the first ten names, in order; further ones count as lower."""
    import numpy as np

    if not _KINDS:
        out = np.ones(0x3001, np.int64)
        for i in range(0x3000):
            c = chr(i)
            if c.isupper():
                out[i] = 0
            elif c.isdigit():
                out[i] = 2
            elif c in ".,;:?'\"()-":
                out[i] = 3 if c in ".?" else 4
            elif c == "!":
                out[i] = 6
            elif c == "|":
                out[i] = 7
            elif c in "\n\r":
                out[i] = 9
            elif c.isspace():
                out[i] = 8
            elif not c.isalpha():
                out[i] = 5
        _KINDS.append(out)
    return _KINDS[0]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def figures(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([text_figures(x) for x in part])


def expand(x):
    """Figures centred and scaled are cut at six and joined by their squares."""
    import numpy as np

    x = np.clip(x, -6, 6)
    return np.concatenate([x, x * x], -1)


@dataclass
class Model:
    """A logistic model over expanded figures."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float
    prior: float

    def score(self, x):
        import numpy as np

        z = expand((np.asarray(x, float) - self.mean) / self.scale) @ np.asarray(self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def column(self, f: Column) -> Column:
        """The score as an expression over the array of figures."""
        z, k = F.lit(self.bias), len(self.mean)
        for i in range(k):
            x = F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (f[i] - self.mean[i]) / self.scale[i]))
            z = z + x * self.weights[i] + x * x * self.weights[k + i]
        return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))


def _descend(positive, other, gradient, steps: int = 400, rate: float = 0.05):
    """Adam on (weights, bias) from zero; ``gradient`` maps both scores' logits to their gradients."""
    import numpy as np

    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (positive, other))
    w, m, v = (np.zeros(p.shape[1]) for _ in range(3))
    for t in range(1, steps + 1):
        gp, gu = gradient(p @ w, u @ w)
        g = p.T @ gp + u.T @ gu + 1e-3 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_ranker(positive, unlabelled):
    """Plain logistic regression of positives against the unlabelled, both of weight a half."""
    return _descend(
        positive,
        unlabelled,
        lambda zp, zu: (-_sigmoid(-zp) / (2 * len(zp)), _sigmoid(zu) / (2 * len(zu))),
    )


def fit_nonnegative(positive, unlabelled, prior: float):
    """Logistic weights of least non-negative unbiased risk."""
    import numpy as np

    def gradient(zp, zu):
        bad = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up, uu = -prior * _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
        if bad < 0:
            return -up, -uu
        return -prior * _sigmoid(-zp) / len(zp) + up, uu

    return _descend(positive, unlabelled, gradient)


def prior_of(positive, unlabelled) -> float:
    """Least ratio of the upper tails of two histograms, best bin last, with room for chance.

    Only tails with half of the positives count: the very top holds what the ranking has
    learned by heart.  Without positives or unlabelled rows it is a half.
    """
    import numpy as np

    p, u = np.cumsum(np.asarray(positive, float)[::-1]), np.cumsum(np.asarray(unlabelled, float)[::-1])
    if not p[-1] or not u[-1]:
        return 0.5
    room = np.sqrt(1 / p[-1]) + np.sqrt(1 / u[-1])
    share_p, share_u = p / p[-1], u / u[-1]
    wide = share_p >= 0.5
    best = np.argmin(np.where(wide, (share_u + room) / np.maximum(share_p, 1e-12), np.inf))
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def trusted(labels: DataFrame) -> DataFrame:
    """Ids whose every label says good."""
    return (
        labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.min("quality").alias("lo"))
        .filter("lo = 1")
        .select("doc_id")
    )


def fit(rows: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> Model:
    """Model from a written (doc_id, f) table and (doc_id, quality) labels.

    Learns from rows outside the held-out fifth.  At most about ``training_rows`` positives
    and as many unlabelled rows, picked by a hash of the id, fit the weights; the prior is
    counted over all rows.  Without positives or unlabelled rows every score is a half.
    """
    import numpy as np

    good = trusted(labels).withColumn("good", F.lit(True))
    seen = (
        rows.filter(~held_out(F.col("doc_id")))
        .join(good, "doc_id", "left")
        .select("doc_id", "f", F.coalesce("good", F.lit(False)).alias("good"))
    )
    seen = cut_lineage(seen, "quality-seen")
    counts = {r["good"]: r["n"] for r in seen.groupBy("good").agg(F.count("*").alias("n")).collect()}
    k = len(NAMES)
    if len(counts) < 2:
        return Model([0.0] * k, [1.0] * k, [0.0] * 2 * k, 0.0, 0.5)
    share = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    # Picked rows vary by chance around the bound; the limit only stops a hash gone wrong.
    picked = [
        np.array([r["f"] for r in seen.filter((F.col("good") == g) & (share < training_rows / counts[g])).limit(2 * training_rows).collect()])
        for g in (True, False)
    ]
    if not all(len(x) for x in picked):
        return Model([0.0] * k, [1.0] * k, [0.0] * 2 * k, 0.0, 0.5)
    both = np.concatenate(picked)
    mean, scale = both.mean(0), np.maximum(both.std(0), 1e-6)
    p, u = (expand((x - mean) / scale) for x in picked)
    first = fit_ranker(p, u)
    ranker = Model(mean.tolist(), scale.tolist(), first[:-1].tolist(), float(first[-1]), 0.5)
    ranks = seen.groupBy("good", F.least(F.floor(ranker.column(F.col("f")) * BINS), F.lit(BINS - 1)).alias("bin")).count()
    tails = np.zeros((2, BINS))
    for r in ranks.collect():  # two histograms of 256 bins
        tails[int(r["good"]), int(r["bin"])] = r["count"]
    prior = prior_of(tails[1], tails[0])
    w = fit_nonnegative(p, u, prior)
    return Model(mean.tolist(), scale.tolist(), w[:-1].tolist(), float(w[-1]), prior)


def figure_table(docs: DataFrame) -> DataFrame:
    """(doc_id, f) of every document, written once: about 160 bytes a row."""
    return cut_lineage(documents(docs).select("doc_id", figures("text").alias("f")), "quality-figures")


def scored(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each document.

    Null texts count as empty and are scored like any other; repeated rows get the same
    score; rows with a null id are never learned from as positives; other columns are not
    read; ids whose labels disagree or are null are unlabelled; equal texts have equal scores; a
    very long text is read whole, in its own row; an empty table gives no rows.
    """
    rows = figure_table(docs)
    model = fit(rows, labels, training_rows)
    score = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column(F.col("f")).alias("score"))
    return score.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns stay as they are."""
    model = fit(figure_table(docs), labels, training_rows)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([float(model.score(text_figures(x))) for x in part], dtype="float64")

    return docs.filter(score(F.coalesce(F.col("text"), F.lit(""))) >= THRESHOLD)
