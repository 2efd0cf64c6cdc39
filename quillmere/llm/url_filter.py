"""URL verdicts: rules first, then logistic regression on hashed character n-grams.

The n-grams of host and path are hashed into a vector inside the JVM; a small labelled URL
table trains the model, and scoring is a map without a shuffle.  No Python runs on executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..runtime import cut_lineage

GRAMS = (3, 4)
FEATURES = 1 << 14
MAX_RULES = 1_000


@dataclass(frozen=True)
class Rule:
    """``text`` is a host, a slash and the start of a path; it holds for the host and its subdomains."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.text.split("/", 1)[1] if "/" in self.text else ""


RULES = (
    Rule("net/", "block"),
    Rule("example.net/en/", "allow"),
    Rule("example.com/de/", "block"),
    Rule("org/fr/", "allow"),
)

# Seed words of the labelled table: trades that web corpora leave out, and ordinary subjects.
BLOCKED_WORDS = (
    "casino casinos poker roulette slots jackpot lottery bet bets betting gamble porn xxx adult sex escort webcam viagra cialis"
    " pills pharmacy steroids payday loans spam phish malware warez crack keygen torrent popunder adserver ads track"
    " tracker clicks banner prize win winner wins free freebies freebet cheap cheapest replica farm spammer bonus"
).split()
ALLOWED_WORDS = (
    "news blog docs wiki university library museum science history travel recipes garden music city weather school"
    " council health research journal forum support learn books photo theatre art data maps forest river mountain"
    " the this other author weather nation station motion that other earth north south"
    " paper letter spring summer kitchen bread teacher children doctor engine bridge valley harbour market fashion english polish publisher relationship cushion"
    " theory thermal thunder three thing thousand throne action attention edition fiction nature"
).split()

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty without ``://``; only A-Z of the host are lower-cased."""
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def matched(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; both null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def _grams(mark: str, text: Column) -> list[Column]:
    """All n-grams of a text with its ends marked; neighbours are zipped, so long texts stay linear."""
    edged = F.concat(F.lit("^"), text, F.lit("$"))
    points, out = F.split(edged, ""), []
    for n in GRAMS:
        count = F.greatest(F.length(edged) - (n - 1), F.lit(0))
        zipped = F.arrays_zip(*[F.slice(points, j + 1, count).alias(f"c{j}") for j in range(n)])
        out.append(F.transform(zipped, _joined(mark, n)))
    return out


def _joined(mark: str, n: int):
    return lambda x: F.concat(F.lit(mark), *[x[f"c{j}"] for j in range(n)])


def featured(rows: DataFrame) -> DataFrame:
    """Add ``features``, the hashed n-gram counts of the columns host and path."""
    # One digit is like another: page numbers say nothing about a site.
    grams = F.concat(*(g for x in ("host", "path") for g in _grams(x[0], F.regexp_replace(x, "[0-9]+", "0"))))
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES).transform(
        rows.withColumn("grams", grams)
    ).drop("grams")


def train(labelled: DataFrame):
    """Model from (host, path, label) rows, label 1 for block; None when one of the labels is missing."""
    rows = cut_lineage(labelled.select("host", "path", F.col("label").cast("double").alias("label")), "urls-labelled")
    if rows.select("label").distinct().count() < 2:
        return None
    return LogisticRegression(maxIter=40, regParam=0.0001, standardization=False).fit(
        featured(rows).select("features", "label")
    )


def seed_table(spark: SparkSession) -> DataFrame:
    """The small labelled URL table: (url, label) made from the seed words and a few common forms of urls."""
    rows = []
    for words, label in ((ALLOWED_WORDS, 0.0), (BLOCKED_WORDS, 1.0)):
        for i, w in enumerate(words):
            v = words[(i * 7 + 3) % len(words)]
            for j, name in enumerate((w, f"{w}-{v}", f"{v}-{w}", v + w, w, f"{w}-{v}", f"{v}-{w}", w)):
                sub, top = ("", "www.", "m.", "blog.")[(i + j) % 4], ("com", "org", "net")[(i + j) % 3]
                form = ("{}/", "{}.html", "{}", "page/{}")[(i // 2 + j) % 4].format(i * 37 + j)
                rows.append((f"http://{sub}{name}.example.{top}/{('en', 'de', 'fr', 'es')[(i // 3 + j) % 4]}/{form}", label))
    return spark.createDataFrame(rows, "url string, label double")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score), a row for each page.

    ``labelled`` holds (url, label) rows, label 1 for block; the default is ``seed_table``.
    verdict is the rule's, else block where the score is at least
    a half; without both labels to learn from it is allow, with score 0.

    A null url, or one without ``://``, has an empty host and path and gets the model's
    verdict; a very long url is read whole, as one row; of equally long rules that fit the first
    wins; repeated rows get the same answer; other columns are not read; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumns({"rule": rule, "verdict": verdict})
    h, p = host_and_path(F.col("url"))
    known = labelled if labelled is not None else seed_table(pages.sparkSession)
    examples = known.select(h.alias("host"), p.alias("path"), "label").filter("label IS NOT NULL")
    model = train(examples)
    if model is None:
        scored = ruled.withColumn("block_score", F.lit(0.0))
    else:
        scored = (
            model.transform(featured(ruled))
            .withColumn("block_score", vector_to_array("probability")[1])
            .drop("features", "rawPrediction", "probability", "prediction")
        )
    return scored.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        "block_score",
    )
