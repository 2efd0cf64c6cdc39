"""User rules, relevance, verdicts, rule imports and enrichment routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fields import col, present, truthy
from .dedup import near_dups
from .merge import duplicate_flag, exact_match_flag, with_record_key

# Relevance needs this many characters; each test is worth half.
MIN_RELEVANT_LENGTH = 30
MIN_CONFIDENCE = 0.6

RULE_TYPES = ("regex", "min_length", "blacklist", "unique", "no_exact_match")


@dataclass(frozen=True)
class Rule:
    """One filter rule; ``field='*'`` looks at the whole record."""

    id: int
    field: str
    rule_type: str
    value: str
    condition: str | None = None
    priority: int = 1
    enabled: bool = True


def condition(df: DataFrame, text: str | None) -> Column:
    """``field=x`` terms joined by all-AND or all-OR; unknown terms are false."""
    if not text:
        return F.lit(True)

    def term(part: str) -> Column:
        if part.startswith("field="):
            return present(df, part.split("=")[1].strip())
        return F.lit(False)

    if " AND " in text:
        out = F.lit(True)
        for part in text.split(" AND "):
            out = out & term(part)
        return out
    out = F.lit(False)
    for part in text.split(" OR "):
        out = out | term(part)
    return out


def _failure(df: DataFrame, rule: Rule, flag: str | None) -> tuple[Column, str]:
    """(does the row fail, reason)."""
    if rule.field == "*":
        value, filled = F.to_json(F.struct(*df.columns)), F.lit(True)
    elif rule.field in df.columns:
        value, filled = F.col(rule.field).cast("string"), present(df, rule.field)
    else:
        return F.lit(False), ""
    if rule.rule_type == "regex":
        bad = ~value.rlike(f"(?U)^(?:{rule.value})")
        reason = f"Field '{rule.field}' failed regex: {rule.value}"
    elif rule.rule_type == "min_length":
        bad = F.length(value) < int(rule.value)
        reason = f"Field '{rule.field}' below min length {rule.value}"
    elif rule.rule_type == "blacklist":
        bad = F.lower(value).isin([v.strip().lower() for v in rule.value.split(",")])
        reason = f"Field '{rule.field}' is blacklisted value"
    elif rule.rule_type == "unique":
        bad, reason = F.col(flag), f"Duplicate value for '{rule.field}'"
    elif rule.rule_type == "no_exact_match":
        bad, reason = F.col(flag), "Exact duplicate record"
    else:
        return F.lit(False), ""
    return filled & F.coalesce(bad, F.lit(False)), reason


def apply_rules(
    df: DataFrame, rules: Sequence[Rule], tables: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """First failing rule by (priority, id) decides ``result, reason, rule_id``.

    Rules are configuration: each becomes one branch of a native expression.
    Rules that look into a table become a join against its distinct keys first.
    """
    tables = tables or {}
    base = list(df.columns)
    active = sorted((r for r in rules if r.enabled), key=lambda r: (r.priority, r.id))
    flags: dict[int, str] = {}
    for r in active:
        if r.rule_type == "unique" and r.field in base:
            flags[r.id] = f"__rule_{r.id}"
            seen = (
                tables[r.value]
                .select(F.col(r.field).alias("__v"))
                .filter(F.col("__v").isNotNull())
                .distinct()
            )
            df = (
                df.join(seen, F.col(r.field) == F.col("__v"), "left")
                .withColumn(flags[r.id], F.col("__v").isNotNull())
                .drop("__v")
            )
        elif r.rule_type == "no_exact_match":
            flags[r.id] = f"__rule_{r.id}"
            helpers = [c for c in df.columns if c not in base]
            df = exact_match_flag(df, tables[r.value].drop(*helpers), name=flags[r.id])
    plain = df.select(*base)
    outcome = None
    for r in active:
        fails, reason = _failure(plain, r, flags.get(r.id))
        hit = condition(plain, r.condition) & fails
        row = F.struct(
            F.lit("filtered").alias("result"),
            F.lit(reason).alias("reason"),
            F.lit(r.id).alias("rule_id"),
        )
        outcome = F.when(hit, row) if outcome is None else outcome.when(hit, row)
    passed = F.struct(
        F.lit("allowed").alias("result"),
        F.lit("").alias("reason"),
        F.lit(None).cast("int").alias("rule_id"),
    )
    outcome = passed if outcome is None else outcome.otherwise(passed)
    return df.withColumn("__o", outcome).select(*base, "__o.*")


def relevance_score(text: Column | str, keywords: Sequence[str] = ()) -> Column:
    text = F.coalesce(col(text), F.lit(""))
    score = F.when(F.length(text) >= MIN_RELEVANT_LENGTH, 0.5).otherwise(0.0)
    if keywords:
        hit = F.lit(False)
        low = F.lower(text)
        for word in keywords:
            hit = hit | low.contains(word.lower())
        score = score + F.when(hit, 0.5).otherwise(0.0)
    return score


def relevance(text: Column | str, keywords: Sequence[str] = ()) -> Column:
    """``low`` below one half, else ``high``."""
    return F.when(relevance_score(text, keywords) < 0.5, "low").otherwise("high")


def filter_records(
    df: DataFrame,
    rules: Sequence[Rule],
    target: DataFrame,
    *,
    id_col: str,
    text_col: str,
    key_cols: Sequence[str],
    tables: Mapping[str, DataFrame] | None = None,
    keywords: Sequence[str] = (),
    mode: str = "rules_only",
    order: str | None = None,
    index: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rules, exact duplicates, near duplicates and relevance in one verdict.

    Returns (accepted, quarantine, audit).  Every failing row is quarantined with
    the reason of its first failing stage; ``mode='strict'`` also keeps it out of
    ``accepted``, while ``rules_only`` holds back rule failures alone.
    """
    if mode not in ("rules_only", "strict"):
        raise ValueError("mode is rules_only or strict")
    base = list(df.columns)
    out = apply_rules(df, rules, tables)
    # What needs the text is told before the joins, so that the audit's joins do not move the text.
    known = target.select(*[c for c in target.columns if c in out.columns])
    out = with_record_key(out, known, name="__record").withColumn("relevance", relevance(text_col, keywords))
    out = duplicate_flag(out, target, key_cols, row="__record")
    out = exact_match_flag(out, known, key="__record").withColumn(
        "dedup", F.when(F.col("exact_match"), "duplicate").otherwise(F.col("dedup"))
    ).drop("exact_match")
    near = near_dups(df.filter(truthy(text_col)), id_col, text_col, order or id_col, index=index)
    near = near.filter(~F.col("kept")).select(id_col, "near_dup_of", "similarity")
    out = out.join(near, id_col, "left").withColumn(
        "fuzzy",
        F.when(F.col("near_dup_of").isNotNull(), "near-duplicate").otherwise("not-near-duplicate"),
    )
    stage = (
        F.when(F.col("result") == "filtered", F.col("reason"))
        .when(F.col("dedup") == "duplicate", "duplicate")
        .when(F.col("fuzzy") == "near-duplicate", "near-duplicate")
        .when(F.col("relevance") == "low", "low relevance")
    )
    out = out.withColumn("quarantine_reason", stage)
    verdict = ["result", "reason", "rule_id", "dedup", "fuzzy", "relevance"]
    quarantine = out.filter(F.col("quarantine_reason").isNotNull()).select(
        *base, *verdict, "near_dup_of", "similarity", "quarantine_reason"
    )
    passing = (
        F.col("result") == "allowed" if mode == "rules_only" else F.col("quarantine_reason").isNull()
    )
    accepted = out.filter(passing).select(*base, *verdict)
    audit = out.select(id_col, *verdict, "quarantine_reason")
    return accepted, quarantine, audit


def import_rules(
    df: DataFrame, defaults: Mapping[str, object], required: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Fill defaults; rows without a required value go to the second result.

    A string default naming a column (``'=name'``) copies that column.
    """
    filled = {}
    for name, default in defaults.items():
        fallback = (
            F.col(default[1:])
            if isinstance(default, str) and default.startswith("=")
            else F.lit(default)
        )
        filled[name] = F.coalesce(F.col(name), fallback) if name in df.columns else fallback
    out = df.withColumns(filled)
    good = F.lit(True)
    for name in required:
        good = good & present(df, name)
    tagged = out.withColumn("status", F.when(good, "success").otherwise("failed"))
    return tagged.filter("status = 'success'"), tagged.filter("status = 'failed'")


def whole_word_in(text: Column, word: Column) -> Column:
    """Case-insensitive whole-word test with the word taken literally."""
    quoted = F.concat(F.lit(r"(?iU)\b\Q"), F.replace(word, F.lit(r"\E"), F.lit("")), F.lit(r"\E\b"))
    # The pattern differs by row; only texts that hold the word at all are worth compiling it for.
    held = F.contains(F.lower(text), F.lower(word))
    return F.coalesce(truthy(word) & F.when(held, F.regexp_like(text, quoted)).otherwise(False), F.lit(False))


def route_enrichment(
    df: DataFrame,
    existing: DataFrame | None = None,
    existing_key: Sequence[str] = ("specific_source_url",),
    min_conf: float = MIN_CONFIDENCE,
    language: str | None = None,
) -> DataFrame:
    """Ordered gates give each item one ``outcome``.

    Needs ``specific_source_url, title, description_snippet, entity_name,
    entity_description, extraction_confidence``; ``language`` names a column with
    the detected language (null = undetectable, which passes).
    """
    dup = F.lit(False)
    if existing is not None:
        keys = list(existing_key)
        seen = existing.select(*keys).distinct().withColumn("__seen", F.lit(True))
        df = df.join(seen, keys, "left")
        dup = F.coalesce(F.col("__seen"), F.lit(False))
    text = F.concat_ws(
        " ", F.coalesce("title", F.lit("")), F.coalesce("description_snippet", F.lit(""))
    )
    relevant = whole_word_in(text, F.col("entity_name")) | whole_word_in(
        text, F.col("entity_description")
    )
    foreign = (
        F.coalesce(F.col(language) != "en", F.lit(False)) if language else F.lit(False)
    )
    has_text = truthy("title") | truthy("description_snippet")
    outcome = (
        F.when(~truthy("specific_source_url"), "invalid_schema")
        .when(dup, "duplicate")
        .when(has_text & foreign, "non_english")
        .when(~relevant, "irrelevant")
        .when(F.coalesce("extraction_confidence", F.lit(0.0)) < min_conf, "review")
        .otherwise("inserted")
    )
    return df.withColumn("outcome", outcome).drop("__seen")
