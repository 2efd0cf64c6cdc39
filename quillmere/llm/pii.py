"""Personal data by weak supervision.

Strict patterns find the base spans, which always stay.  Looser patterns add candidates.
Labelers vote on every candidate: the strict pattern, a checksum or shape, a gazetteer, the
words before it, and what touches it.  The votes are folded to their distinct combinations,
at most a thousand; expectation-maximisation over these estimates how reliable each labeler
is and how likely each combination is personal data.  With those likelihoods as soft labels
a logistic span classifier is trained on other features of the span, and it decides which
candidates join the base spans.

Everything on executors is column expressions.  Matches come with their places by splitting a
text at the same pattern; repeated groups are possessive, so that long runs need no stack.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import cut_lineage
from .common import documents

# Kinds in their order, and the strict patterns.  A match may only begin where a
# run of its first characters begins, or where the last match ended; that changes no match and
# keeps long runs linear.  Card runs of fewer than 12 digits are no matches to begin with.
KINDS = ("email", "ip", "card", "phone")
_FREE = r"(?:(?<![{0}])|\G)"
STRICT = {
    "email": _FREE.format("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _FREE.format("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": _FREE.format(r"\p{L}0-9._%+-")
    + r"[\p{L}0-9._%+-]++(?:@|\x20?[\[(](?:at|@)[\])]\x20?)[\p{L}0-9-]++(?:(?:\.|\x20?[\[(](?:dot|\.)[\])]\x20?)[\p{L}0-9-]++)++",
    "ip": _FREE.format("0-9") + r"[0-9]++(?:\[?\.\]?[0-9]++){3}+",
    "card": _FREE.format("0-9") + r"[0-9]{4}+(?:[\x20./-][0-9]{4}+){2,3}+(?:[\x20./-]?[0-9]{1,3}+)?",
    "phone": _FREE.format("0-9+(") + r"(?:00[1-9][0-9]?[\x20./-]?)?\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,5}(?![0-9])",
}
TOP_LEVELS = "com org net edu gov info biz io de fr es eu uk us ch at it nl be ca au jp cn".split()
BEFORE = {
    "email": r"(?i)(?:e-?mails?|mailto|contacto?|write|kontakt|courriel|correo)\b[^\n]{0,12}$",
    "ip": r"(?i)(?:\bip|address|adresse|host|server|login|from)\b[^\n]{0,12}$",
    "card": r"(?i)(?:cards?|visa|master\x20?card|amex|credit|kartennummer|karte|carte|tarjeta|payment)\b[^\n]{0,12}$",
    "phone": r"(?i)(?:tel|telefon|tel[eé]fono|t[eé]l[eé]phone|phone|call|mobile|fax|cell|whatsapp)\b[^\n]{0,8}$",
}
CONTEXT = 30
TRAINING_SPANS = 20_000
ACCEPT = 0.9
ROUNDS = 60
LABELERS = ("strict", "shape", "gazetteer", "context", "touching")
SHAPE = 1  # a span that its shape or checksum speaks against never joins
_SPAN = "array<struct<start: bigint, stop: bigint, found: string>>"


def places(text: Column, pattern: str) -> Column:
    """All matches with start and stop, in code points."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    )
    none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), stop.alias("stop"), x["hit"].alias("found"))
        return F.when(x["hit"].isNull(), acc).otherwise(
            F.struct(stop.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))
        )

    return F.aggregate(parts, none, step, lambda acc: acc["out"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _octets(x: Column) -> Column:
    return F.forall(
        F.split(x, r"\."),
        lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")).between(1, 3)
        & (F.try_to_number(F.substring(F.lpad(F.regexp_replace(p, "^0+(?=[0-9])", ""), 3, "0"), 1, 3), F.lit("999")) <= 255),
    )


def _valid(kind: str, found: Column) -> Column:
    n = F.length(_digits(found))
    return {
        "email": F.lit(True),
        "ip": _octets(found),
        "card": n.between(12, 19) & F.call_function("luhn_check", _digits(found)),
        "phone": n.between(9, 15),
    }[kind]


def _none() -> Column:
    return F.array().cast(_SPAN)


def base_spans(text: Column, kind: str) -> Column:
    """Spans of the strict pattern that hold; a text without its telling character is not searched."""
    sign = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))
    return F.when(sign, F.filter(places(text, STRICT[kind]), lambda s: _valid(kind, s["found"]))).otherwise(_none())


def _overlaps(s: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < s["stop"]) & (s["start"] < o["stop"]))


def _vote(yes: Column, no: Column | None = None) -> Column:
    vote = F.when(yes, 1)
    return (vote if no is None else vote.when(no, -1)).otherwise(0)


def _votes(kind: str, s: Column, strict: bool) -> Column:
    found, n = s["found"], F.length(_digits(s["found"]))
    shape = {
        "email": _vote(F.length(found).between(6, 80), F.length(found) > 254),
        "ip": _vote(_octets(F.regexp_replace(found, r"[\[\]]", "")), F.lit(True)),
        "card": _vote(F.call_function("luhn_check", _digits(found)) & n.between(13, 19), F.lit(True)),
        "phone": _vote(n.between(9, 13), ~n.between(9, 15)),
    }[kind]
    gazetteer = {
        "email": _vote(F.lower(F.regexp_extract(found, r"([A-Za-z]+)$", 1)).isin(TOP_LEVELS), F.lit(True)),
        "ip": _vote(~found.rlike(r"^0*(?:0|255)\b"), F.lit(True)),
        "card": _vote(found.rlike("^(?:4|5[1-5]|3[47]|6)"), F.lit(True)),
        "phone": _vote(found.rlike(r"^(?:\+|00)[1-9]")),
    }[kind]
    context = _vote(s["before"].rlike(BEFORE[kind]))
    touching = _vote(
        s["before"].rlike(r"(?:^|[\s:(\"'<,;])$") & s["after"].rlike(r"^(?:$|[\s)\"'>,;.!?%$&*#])"),
        s["before"].rlike(r"[0-9A-Za-z=/_#.-]$") | s["after"].rlike(r"^[0-9A-Za-z/_=]"),
    )
    return F.array(F.lit(1 if strict else 0), shape, gazetteer, context, touching)


def _features(kind: str, s: Column) -> Column:
    found = s["found"]
    n = F.greatest(F.length(found), F.lit(1))
    one = [F.lit(1.0 if k == kind else 0.0) for k in KINDS]
    return F.array(
        *one,
        *(x * (F.length(_digits(found)) / n) for x in one),
        *(x * F.least(n / 20, F.lit(3.0)) for x in one),
        *(x * s["before"].rlike(BEFORE[kind]).cast("double") for x in one),
        found.rlike(r"^\+|^00").cast("double"),
        found.rlike(r"[\[(](?:at|dot)").cast("double"),
        found.rlike(r"[\x20()/-]").cast("double"),
        s["before"].rlike(r"[0-9A-Za-z=/_#.-]$").cast("double"),
        s["after"].rlike("^[0-9A-Za-z/_=]").cast("double"),
        F.call_function("luhn_check", _digits(found)).cast("double"),
    )


def candidates(rows: DataFrame) -> DataFrame:
    """Add the base spans of each kind and, in ``more``, the loose spans that touch none of them.

    Every span of ``all`` carries kind, votes and features; base spans come first.
    """
    text = F.col("text")
    based = rows.withColumns({k: base_spans(text, k) for k in KINDS})
    base = F.concat(*[F.col(k) for k in KINDS])
    worth = text.rlike(r"[0-9@]|[\[(]at[\])]")
    loose = based.withColumn("base", base).withColumns(
        {
            f"loose_{k}": F.when(worth, F.filter(places(text, LOOSE[k]), lambda s: ~_overlaps(s, F.col("base")))).otherwise(_none())
            for k in KINDS
        }
    )

    def dressed(spans: Column, kind: str, strict: bool) -> Column:
        around = F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"),
                s["stop"].alias("stop"),
                s["found"].alias("found"),
                F.substr(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)).cast("int"), F.least(s["start"], F.lit(CONTEXT)).cast("int")).alias("before"),
                F.substr(text, (s["stop"] + 1).cast("int"), F.lit(2)).alias("after"),
            ),
        )
        return F.transform(
            around,
            lambda s: F.struct(
                F.lit(KINDS.index(kind)).alias("kind"),
                F.lit(strict).alias("strict"),
                s["start"].alias("start"),
                s["stop"].alias("stop"),
                _votes(kind, s, strict).alias("votes"),
                _features(kind, s).alias("features"),
            ),
        )

    return loose.select(
        "doc_id",
        F.concat(
            *[dressed(F.col(k), k, True) for k in KINDS], *[dressed(F.col(f"loose_{k}"), k, False) for k in KINDS]
        ).alias("spans"),
    )


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = ROUNDS) -> dict:
    """Likelihood of personal data for each (kind, votes), by expectation-maximisation.

    Each labeler of each kind has its own chances of voting yes, no or nothing on true and on
    false spans; the first guess is the sum of the votes.
    """
    likely = {(k, v): 1 / (1 + math.exp(-sum(v))) for k, v, _ in patterns}
    for _ in range(rounds):
        prior, chance = {}, {}
        for kind in range(len(KINDS)):
            mine = [(v, n, likely[k, v]) for k, v, n in patterns if k == kind]
            total = sum(n for _, n, _ in mine)
            prior[kind] = (1 + sum(n * p for _, n, p in mine)) / (2 + total)
            for j in range(len(LABELERS)):
                for truth in (0, 1):
                    weight = {-1: 1.0, 0: 1.0, 1: 1.0}
                    for v, n, p in mine:
                        weight[v[j]] += n * (p if truth else 1 - p)
                    if truth == 1:
                        weight[1] += 2  # labelers are better than chance to begin with
                    else:
                        weight[-1] += 2
                    whole = sum(weight.values())
                    for vote, x in weight.items():
                        chance[kind, j, truth, vote] = x / whole
        for k, v in likely:
            yes, no = math.log(prior[k]), math.log(1 - prior[k])
            for j, vote in enumerate(v):
                yes += math.log(chance[k, j, 1, vote])
                no += math.log(chance[k, j, 0, vote])
            likely[k, v] = 1 / (1 + math.exp(min(700.0, max(-700.0, no - yes))))
    return likely


def span_classifier(spans: DataFrame) -> tuple[list[float], float] | None:
    """(weights, bias) of the final classifier from written (kind, votes, features) rows; None without spans."""
    folded = spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()  # at most 4 x 3^5 rows
    if not folded:
        return None
    likely = reliabilities(sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in folded))
    soft = spans.sparkSession.createDataFrame(
        [(k, list(v), p) for (k, v), p in sorted(likely.items())], "kind int, votes array<int>, p double"
    )
    share = min(1.0, TRAINING_SPANS / sum(r["n"] for r in folded))
    picked = spans.filter(F.pmod(F.xxhash64("features", "start"), F.lit(1 << 20)) <= share * (1 << 20))
    rows = picked.join(F.broadcast(soft), ["kind", "votes"]).select(array_to_vector("features").alias("features"), "p")
    # Each span counts as personal data with its likelihood and as none with the rest.
    twice = rows.select("features", F.lit(1.0).alias("label"), F.col("p").alias("w")).union(
        rows.select("features", F.lit(0.0), 1 - F.col("p"))
    )
    model = LogisticRegression(maxIter=40, regParam=0.01, weightCol="w").fit(cut_lineage(twice, "pii-training"))
    return model.coefficients.toArray().tolist(), float(model.intercept)


def _accepted(span: Column, model: tuple[list[float], float]) -> Column:
    weights, bias = model
    z = F.lit(bias)
    for i, w in enumerate(weights):
        z = z + span["features"][i] * w
    return z >= math.log(ACCEPT / (1 - ACCEPT))


def _named(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined with commas."""
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    )
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",",
        F.transform(ordered, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))),
    )


def apart(spans: Column) -> Column:
    """Spans by start, kind and stop, each that begins before the last one kept has ended left out."""
    by_start = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), s.alias("whole")))
    )
    none = F.slice(by_start, 1, 0)
    kept = F.aggregate(
        by_start,
        none,
        lambda done, s: F.when(
            (F.size(done) == 0) | (s["start"] >= F.try_element_at(done, F.lit(-1))["stop"]), F.concat(done, F.array(s))
        ).otherwise(done),
    )
    return F.transform(kept, lambda s: s["whole"])


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans), spans an array of struct(kind, strict, start, stop) of base and added spans.

    start and stop count code points, stop exclusive.  Null texts count as empty and have no
    spans; repeated rows get the same answer; null ids stay; other columns are not read.
    Added spans overlap neither base spans nor added ones before them.
    """
    found = cut_lineage(candidates(documents(docs)), "pii-candidates")
    model = span_classifier(found.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.features", "s.start"))
    base = F.filter("spans", lambda s: s["strict"])
    slim = lambda a: F.transform(
        a, lambda s: F.struct(s["kind"].alias("kind"), s["strict"].alias("strict"), s["start"].alias("start"), s["stop"].alias("stop"))
    )
    if model is None:
        return found.select("doc_id", slim(base).alias("spans"))
    more = slim(F.filter("spans", lambda s: ~s["strict"] & (s["votes"][SHAPE] >= 0) & _accepted(s, model)))
    return found.select("doc_id", F.concat(slim(base), apart(more)).alias("spans"))


def _is(kind: int):
    return lambda s: s["kind"] == kind


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): counts and digest of the base spans, all spans as text."""
    base = F.filter("spans", lambda s: s["strict"])
    return find_spans(docs).select(
        "doc_id",
        *[F.size(F.filter(base, _is(i))).cast("bigint").alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_named(base).cast("binary"), 256).alias("base_sha256"),
        _named(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["strict"])).cast("bigint").alias("n_added"),
    )
