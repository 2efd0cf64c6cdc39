"""Column functions for messy nested records: presence, defaults, ids, dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

# The characters a text strip removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Accepted timestamp layouts, tried in this order.
TIMESTAMP_LAYOUTS = (
    "yyyy-M-d'T'H:m:s.SSSSSS'Z'",
    "yyyy-M-d'T'H:m:s'Z'",
    "yyyy-M-d H:m:s",
    "yyyy-M-d",
    "MMMM d, yyyy",
    "MMM d, yyyy",
    "d MMMM yyyy",
    "d MMM yyyy",
)

# Lower bound of each quality rank.
RANK_FLOORS = ((95, "S"), (90, "A"), (80, "B"), (70, "C"), (60, "D"))
LOWEST_RANK = "F"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every whitespace character, not just blanks."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def truthy(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Null, empty string, zero, false and empty list all count as absent.

    ``dtype`` picks the test; strings are assumed when it is omitted.
    """
    c = col(c)
    if isinstance(dtype, T.ArrayType):
        test = F.exists(c, lambda x: truthy(x, dtype.elementType))
    elif isinstance(dtype, T.MapType):
        test = F.size(c) > 0
    elif isinstance(dtype, T.BooleanType):
        test = c
    elif isinstance(dtype, T.NumericType):
        test = c != 0
    elif dtype is None or isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        test = c != ""
    else:
        test = c.isNotNull()
    return F.coalesce(test, F.lit(False))


def present(df: DataFrame, field: str) -> Column:
    """Truthiness of a field of ``df``; a field the table lacks is absent."""
    if field not in df.columns:
        return F.lit(False)
    return truthy(field, df.schema[field].dataType)


def coalesce_fields(*candidates: Column | str) -> Column:
    """First candidate that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in candidates])


def with_placeholder(c: Column | str, text: str) -> Column:
    """``text`` where the field is null or only whitespace."""
    c = col(c)
    return F.when(F.coalesce(strip(c), F.lit("")) == "", F.lit(text)).otherwise(c)


def to_string_array(
    c: Column | str, dtype: T.DataType | None = None, lower: bool = False
) -> Column:
    """Comma text or list to a list of trimmed strings; any other type gives ``[]``."""
    c = col(c)
    clean = (lambda x: F.lower(strip(x))) if lower else strip
    if isinstance(dtype, T.ArrayType):
        kept = F.filter(c, lambda x: truthy(x, dtype.elementType))
        out = F.transform(kept, lambda x: clean(x.cast("string")))
    elif dtype is None or isinstance(dtype, T.StringType):
        parts = F.transform(F.split(c, ",", -1), clean)
        out = F.filter(parts, lambda x: x != "")
    else:
        return F.array().cast("array<string>")
    return F.coalesce(out, F.array().cast("array<string>"))


def parse_timestamp_multi(c: Column | str, now: Column) -> Column:
    """Blank gives null; unreadable text (also the word ``on``) gives ``now``."""
    text = F.regexp_replace(strip(c), r"\s+", " ")
    parsed = F.coalesce(
        *[F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz") for p in TIMESTAMP_LAYOUTS]
    )
    return F.when(F.coalesce(text, F.lit("")) != "", F.coalesce(parsed, now))


def stable_id(name: Column | str, url: Column | str, trim_name: bool = True) -> Column:
    """md5 of the lower-cased name followed by the url."""
    n = F.coalesce(strip(name) if trim_name else col(name), F.lit(""))
    return F.md5(F.concat(F.lower(n), F.coalesce(col(url), F.lit(""))))


def prefixed_id(prefix: str, key: Column | str, length: int) -> Column:
    """Short public id derived from a key, so that a rerun gives the same id.

    ``length`` characters of base 36, at most 11, from 60 bits of a digest.  Two keys of
    n share an id with a chance of about n * n / (2 * 36**length); ``unique_ids`` tells them apart.
    """
    digits = F.conv(F.substring(F.sha2(col(key).cast("string"), 256), 1, 15), 16, 36)
    return F.concat(F.lit(prefix), F.substr(F.lpad(digits, 12, "0"), F.lit(-length)))


def unique_ids(df: DataFrame, prefix: str, key: str, name: str, length: int = 8) -> DataFrame:
    """Add ``prefixed_id`` of a key as ``name``; keys that share one get ``-1``, ``-2`` ... in key order."""
    keys = df.select(key).distinct().withColumn(name, prefixed_id(prefix, key, length))
    shared = keys.groupBy(name).count().filter("count > 1").select(name)
    rank = F.row_number().over(Window.partitionBy(name).orderBy(key)) - 1
    later = keys.join(shared, name, "left_semi").select(key, rank.alias("__n")).filter("__n > 0")
    return (
        df.withColumn(name, prefixed_id(prefix, key, length))
        .join(later, key, "left")
        .withColumn(name, F.concat(name, F.coalesce(F.concat(F.lit("-"), F.col("__n").cast("string")), F.lit(""))))
        .select(*df.columns, name)
    )


def ref_type(c: Column | str) -> Column:
    c = col(c)
    return (
        F.when(c.startswith("CVE-"), "CVE").when(c.startswith("CWE-"), "CWE").otherwise("OTHER")
    )


def option_type(
    kind: Column, name: Column, required: Column, default: Column, example: Column
) -> Column:
    """Infer a missing option type: flag, then variable, then option."""
    bare = (required == F.lit(False)) & ~truthy(default) & ~truthy(example)
    return (
        F.when(kind.isNotNull(), kind)
        .when(F.coalesce(bare, F.lit(False)), "flag")
        .when(name.startswith("<") & name.endswith(">"), "variable")
        .otherwise("option")
    )


def content_hash(c: Column | str) -> Column:
    """sha256 of the trimmed lower-cased content."""
    return F.sha2(F.lower(strip(c)), 256)


def quality_rank(score: Column | str) -> Column:
    score = col(score)
    ladder = F.when(score >= RANK_FLOORS[0][0], RANK_FLOORS[0][1])
    for floor, rank in RANK_FLOORS[1:]:
        ladder = ladder.when(score >= floor, rank)
    return ladder.otherwise(LOWEST_RANK)


def count_true(flags: Sequence[Column]) -> Column:
    total = F.lit(0)
    for flag in flags:
        total = total + flag.cast("int")
    return total


def status_code(c: Column | str) -> Column:
    """``200_js_rendered`` gives 200, ``error_http_404`` gives 404, others 0."""
    c = col(c)
    head = F.regexp_extract(c, r"^([0-9]+)", 1)
    tail = F.regexp_extract(c, r"_([0-9]+)$", 1)
    number = F.when(c.startswith("200"), head).otherwise(tail)
    return F.coalesce(number.try_cast("int"), F.lit(0))
