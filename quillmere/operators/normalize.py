"""Raw nested records to one parent table and its child tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.fields import (
    coalesce_fields,
    count_true,
    option_type,
    parse_timestamp_multi,
    present,
    quality_rank,
    ref_type,
    stable_id,
    strip,
    to_string_array,
    truthy,
    with_placeholder,
)

# Fields that make a tool record complete.
TOOL_FIELDS = (
    "website",
    "version",
    "license",
    "categories",
    "tags",
    "supported_os",
    "usage_summary",
    "installation_instructions",
)
# Fields that make a vulnerability record complete.
VULNERABILITY_FIELDS = (
    "cve_id",
    "description",
    "cvss_v3_base_score",
    "references",
    "affected_products",
    "state",
    "date_published",
    "date_updated",
)

# Where each canonical field may come from, first truthy wins.
FIELD_SOURCES = {
    "website": ("official_site_url", "website"),
    "installation_instructions": (
        "installation_instructions",
        "installation_details",
        "install_instructions",
    ),
    "usage_summary": ("usage_summary", "common_use_cases", "usage"),
    "license": ("license", "licence"),
    "version": ("version", "tool_version"),
}
LIST_SOURCES = {
    "categories": (("categories", "category", "tool_categories"), False),
    "tags": (("tags", "tool_tags"), True),
}
PLAIN_FIELDS = (
    "authors_maintainers",
    "source_code_url",
    "binary_download_url",
    "logo_url",
    "data_sensitivity_level",
    "source_url",
    "encryption_key_id",
)
DESCRIPTION_PLACEHOLDER = "No description available"

# Patterns that read missing fields out of free text.
TEXT_PATTERNS = {
    "license": r"(?iU)License[:\s]+([\w\-\.]+)",
    "version": r"(?iU)Version[:\s]+([\w\.\-]+)",
    "supported_os": r"(?iU)(Windows|Linux|macOS|Unix|BSD|Android|iOS)",
    "categories": r"(?iU)Category[:\s]+([\w\s,\-/]+)",
    "tags": r"(?iU)Tags?[:\s]+([\w\s,\-/]+)",
    "usage_summary": r"(?iU)Usage[:\s]+(.+?)(?:\n|$)",
    "installation_instructions": r"(?iU)Install(?:ation)?[:\s]+(.+?)(?:\n|$)",
}
EMPTY_LIST = "array<string>"


def backfill_seen(df: DataFrame, first: str, last: str, now: Column) -> DataFrame:
    """First-seen falls back to last-seen, then now; last-seen to first-seen."""
    filled = F.coalesce(F.col(first), F.col(last), now)
    return df.withColumns({first: filled, last: F.coalesce(F.col(last), filled)})


def _without_nul(c: Column, dtype: T.DataType) -> Column | None:
    """Cleaned column, or None when the type holds no strings at all."""
    if isinstance(dtype, T.StringType):
        return F.translate(c, "\x00", "")
    if isinstance(dtype, T.ArrayType):
        if _without_nul(F.lit(None), dtype.elementType) is None:
            return None
        return F.transform(c, lambda x: _without_nul(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        parts = {f.name: _without_nul(c.getField(f.name), f.dataType) for f in dtype.fields}
        if all(v is None for v in parts.values()):
            return None
        rebuilt = F.struct(
            *[(c.getField(n) if v is None else v).alias(n) for n, v in parts.items()]
        )
        return F.when(c.isNotNull(), rebuilt)
    if isinstance(dtype, T.MapType):
        value = _without_nul(F.lit(None), dtype.valueType)
        if value is None:
            return None
        return F.transform_values(c, lambda _, v: _without_nul(v, dtype.valueType))
    return None


def strip_nul(df: DataFrame) -> DataFrame:
    """Drop NUL characters from every string, also inside lists and structs."""
    cleaned = {}
    for f in df.schema.fields:
        expr = _without_nul(F.col(f"`{f.name}`"), f.dataType)
        if expr is not None:
            cleaned[f.name] = expr
    return df.withColumns(cleaned) if cleaned else df


def explode_children(
    df: DataFrame, key: str, field: str, required: str | None, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per child of a list field; children without ``required`` are dropped.

    Children keep their list position, which orders later merges.
    """
    out = df.select(key, *keep, F.posexplode(field).alias("position", "child"))
    element = df.schema[field].dataType.elementType
    if isinstance(element, T.StructType):
        if required:
            out = out.filter(truthy(F.col("child").getField(required)))
        return out.select(key, *keep, "position", "child.*")
    if required is not None:
        out = out.filter(truthy("child", element))
    return out


def child_counts(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Children per parent and kind; parents without any get zeros.

    Each kind is counted before it meets the parents, so the joins carry one
    row per parent however many children one of them has.
    """
    out = parents.select(key).distinct()
    for kind, child in children.items():
        n = child.groupBy(key).agg(F.count("*").alias(f"n_{kind}"))
        out = out.join(n, key, "left").withColumn(
            f"n_{kind}", F.coalesce(f"n_{kind}", F.lit(0).cast("bigint"))
        )
    return out


def explode_steps(df: DataFrame, key: str, field: str) -> DataFrame:
    """Workflow steps numbered from 1; empty steps vanish but keep their number."""
    out = df.select(
        key,
        F.col(f"{field}.name").alias("workflow"),
        F.posexplode(f"{field}.steps").alias("pos", "step_text"),
    )
    return out.filter(truthy("workflow") & truthy("step_text")).select(
        key, "workflow", (F.col("pos") + 1).alias("step_number"), "step_text"
    )


def infer_option_types(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "type",
        option_type(
            F.col("type"), F.col("name"), F.col("required"), F.col("default"), F.col("example")
        ),
    )


def normalize_links(df: DataFrame, key: str, plain: str, structured: str) -> DataFrame:
    """Links given as bare strings or as structs, in one shape.

    A column holds one type, so the two shapes arrive as two list columns.
    """
    bare = df.select(key, F.explode(plain).alias("link")).select(
        key,
        "link",
        F.lit(None).cast("string").alias("title"),
        F.col(key).cast("string").alias("parent_id"),
    )
    rich = df.select(key, F.explode(structured).alias("l")).select(
        key,
        coalesce_fields("l.link", "l.url").alias("link"),
        F.nullif(F.col("l.title"), F.lit("")).alias("title"),
        F.coalesce("l.parent_id", F.col(key).cast("string")).alias("parent_id"),
    )
    return bare.unionByName(rich)


def _tail_list(text: Column, pattern: str, lower: bool) -> Column:
    return to_string_array(F.regexp_extract(text, pattern, 1), lower=lower)


def enrich_from_text(df: DataFrame, text: str, now: Column, stamp: str | None = None) -> DataFrame:
    """Fill only the missing fields from a record's free text, and say so."""
    body = F.coalesce(F.col(text), F.lit(""))
    found: dict[str, Column] = {}
    for name in ("license", "version"):
        found[name] = F.nullif(F.regexp_extract(body, TEXT_PATTERNS[name], 1), F.lit(""))
    for name in ("usage_summary", "installation_instructions"):
        hit = body.rlike(TEXT_PATTERNS[name])
        found[name] = F.when(hit, strip(F.regexp_extract(body, TEXT_PATTERNS[name], 1)))
    systems = F.regexp_extract_all(body, F.lit(TEXT_PATTERNS["supported_os"]), 1)
    capital = F.transform(
        systems, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))
    )
    found["supported_os"] = F.when(F.size(systems) > 0, F.array_sort(F.array_distinct(capital)))
    for name, lower in (("categories", False), ("tags", True)):
        found[name] = F.when(
            body.rlike(TEXT_PATTERNS[name]), _tail_list(body, TEXT_PATTERNS[name], lower)
        )
    updates, fired = {}, F.lit(False)
    for name, value in found.items():
        missing = ~present(df, name)
        updates[name] = F.when(missing & value.isNotNull(), value).otherwise(F.col(name))
        fired = fired | (missing & value.isNotNull())
    by = coalesce_fields(stamp, F.lit("text_patterns")) if stamp else F.lit("text_patterns")
    updates["last_enriched_by"] = F.when(fired, by)
    updates["last_enriched_at"] = F.when(fired, now)
    return df.withColumns(updates)


def quality_score(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Share of present fields in percent (one decimal) and its rank."""
    n = count_true([present(df, f) for f in fields])
    score = F.round(F.lit(100.0) * n / F.lit(len(fields)), 1)
    return df.withColumn("data_quality_score", score).withColumn(
        "quality_rank", quality_rank("data_quality_score")
    )


def _pick(df: DataFrame, names: Sequence[str]) -> Column:
    have = [F.col(n) for n in names if n in df.columns]
    return coalesce_fields(*have) if have else F.lit(None).cast("string")


def _pick_list(df: DataFrame, names: Sequence[str], lower: bool) -> Column:
    """First truthy candidate decides, whatever its shape."""
    chosen = None
    for n in names:
        if n not in df.columns:
            continue
        value = to_string_array(n, df.schema[n].dataType, lower)
        chosen = (
            F.when(present(df, n), value)
            if chosen is None
            else chosen.when(present(df, n), value)
        )
    empty = F.array().cast(EMPTY_LIST)
    return empty if chosen is None else chosen.otherwise(empty)


def normalize_parent(df: DataFrame, now: Column, carry: Sequence[str] = ()) -> DataFrame:
    """The canonical 22-column parent with enrichment, score and rank."""
    df = strip_nul(df)
    name = F.coalesce(strip("tool_name"), F.lit(""))
    url = F.col("source_url") if "source_url" in df.columns else F.lit(None).cast("string")
    given = F.col("tool_id") if "tool_id" in df.columns else F.lit(None).cast("string")
    made = F.when(name != "", stable_id(name, url, trim_name=False))
    has = lambda f: F.col(f) if f in df.columns else F.lit(None).cast("string")
    seen = {
        "first_seen_timestamp": parse_timestamp_multi(has("first_seen_timestamp"), now),
        "last_updated_timestamp": parse_timestamp_multi(
            has("last_updated_timestamp" if "last_updated_timestamp" in df.columns else "last_updated"),
            now,
        ),
    }
    blank_to_null = lambda c: F.when(strip(c) != "", c)
    columns = {
        "tool_id": coalesce_fields(given, made),
        "tool_name": name,
        "description": with_placeholder(has("description"), DESCRIPTION_PLACEHOLDER),
        **{f: _pick(df, c) for f, c in FIELD_SOURCES.items()},
        **{f: _pick_list(df, c, low) for f, (c, low) in LIST_SOURCES.items()},
        "supported_os": _pick_list(df, ("supported_os",), False),
        **{f: blank_to_null(has(f)) for f in PLAIN_FIELDS},
        "parser_plugin_name": F.coalesce(
            blank_to_null(has("parser_plugin_name")), has("parser_hint")
        ),
        **seen,
        "raw_extracted_data": F.to_json(F.struct(*df.columns)),
        "__text": has("content"),
    }
    parent = df.select(*carry, *[c.alias(n) for n, c in columns.items()])
    parent = backfill_seen(parent, "first_seen_timestamp", "last_updated_timestamp", now)
    parent = enrich_from_text(parent, "__text", now, "parser_plugin_name").drop("__text")
    return quality_score(parent, TOOL_FIELDS)


def normalize_tools(df: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Parent table and every child table the input has a list column for.

    Inputs follow ``schemas.RAW_TOOL``.  All outputs are lazy and share one scan
    when the caller persists the input.
    """
    df = strip_nul(df)
    name = F.coalesce(strip("tool_name"), F.lit(""))
    url = F.col("source_url") if "source_url" in df.columns else F.lit(None).cast("string")
    made = F.when(name != "", stable_id(name, url, trim_name=False))
    given = F.col("tool_id") if "tool_id" in df.columns else F.lit(None).cast("string")
    keyed = df.withColumn("tool_id", coalesce_fields(given, made))
    out = {"tools": normalize_parent(df, now)}
    if "related_vulnerabilities" in df.columns:
        refs = explode_children(keyed, "tool_id", "related_vulnerabilities", None)
        out["related_vulnerabilities"] = refs.filter(F.col("child").isNotNull()).select(
            "tool_id",
            F.col("child").alias("vulnerability_ref"),
            ref_type("child").alias("reference_type"),
        )
    for kind, columns in (
        ("commands", ("name", "description", "syntax")),
        ("modules", ("name", "type", "description")),
    ):
        if kind not in df.columns:
            continue
        child = explode_children(keyed, "tool_id", kind, "name")
        out[kind] = child.select("tool_id", *columns)
        opts = explode_children(
            child.withColumnRenamed("name", "owner"), "tool_id", "options", "name", keep=("owner",)
        )
        opts = opts.withColumn("required", F.coalesce("required", F.lit(False)))
        out[f"{kind[:-1]}_options"] = infer_option_types(opts).drop("position")
        out[f"{kind[:-1]}_examples"] = explode_children(
            child.withColumnRenamed("name", "owner"), "tool_id", "examples", "", keep=("owner",)
        ).select("tool_id", "owner", F.col("child").alias("example"))
    if "practical_examples" in df.columns:
        out["examples"] = explode_children(keyed, "tool_id", "practical_examples", "").select(
            "tool_id", F.col("child").alias("example")
        )
    if "workflows" in df.columns:
        flows = keyed.select("tool_id", F.explode("workflows").alias("workflow_item"))
        out["workflows"] = flows.filter(truthy("workflow_item.name")).select(
            "tool_id", F.col("workflow_item.name").alias("name")
        ).distinct()
        out["workflow_steps"] = explode_steps(flows, "tool_id", "workflow_item")
    if "troubleshooting" in df.columns:
        out["troubleshooting"] = explode_children(
            keyed, "tool_id", "troubleshooting", "issue"
        ).select("tool_id", "issue", "solution")
    if "link_strings" in df.columns and "external_links" in df.columns:
        out["external_links"] = normalize_links(
            keyed, "tool_id", "link_strings", "external_links"
        )
    return out
