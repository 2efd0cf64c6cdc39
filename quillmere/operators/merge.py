"""Duplicate flags, upserts with conflict policies, set operations, audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.fields import truthy
from ..runtime import global_row_number

POLICIES = ("overwrite", "keep_first", "keep_old_if_blank", "counter")


def _has_map(kind) -> bool:
    """Maps, also inside other types, cannot be hashed."""
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()


def duplicate_flag(
    df: DataFrame, target: DataFrame, keys: Sequence[str], name: str = "dedup", row: str | None = None
) -> DataFrame:
    """``duplicate`` when any key value already exists in ``target``.

    Each lookup meets a side with one row per distinct key, so no row is ever
    multiplied, however often a value repeats on either side.  ``row`` names a column that tells rows apart,
    so that the others need not be read here.
    """
    hit = F.lit(False)
    for i, key in enumerate(keys):
        seen = (
            target.select(F.col(key).alias(f"__k{i}"))
            .filter(truthy(f"__k{i}", target.schema[key].dataType))
            .distinct()
            .withColumn(f"__h{i}", F.lit(True))
        )
        # Null and blank keys match nothing; each such row gets a salt, so they do not pile up in one task.
        # The salt is a hash of the row, so a task that is run again deals its rows as before.
        told = [row] if row else [c for c in df.columns if not _has_map(df.schema[c].dataType)]
        alone = F.pmod(F.xxhash64(*told), F.lit(1_000_000_000)) + 1
        salt = F.when(truthy(key, df.schema[key].dataType), F.lit(0)).otherwise(alone).cast("int")
        df = (
            df.withColumn(f"__s{i}", salt)
            .join(seen.withColumn("__zero", F.lit(0)), (F.col(key) == F.col(f"__k{i}")) & (F.col(f"__s{i}") == F.col("__zero")), "left")
            .drop(f"__k{i}", f"__s{i}", "__zero")
        )
        hit = hit | F.coalesce(f"__h{i}", F.lit(False))
    flagged = df.withColumn(name, F.when(hit, "duplicate").otherwise("unique"))
    return flagged.drop(*[f"__h{i}" for i in range(len(keys))])


def _record_digest(df: DataFrame, columns: Sequence[str], types: Mapping, null_safe: bool) -> Column:
    """sha256 of the shared columns; null when a null must block equality."""
    record = F.struct(*[F.col(c).cast(types[c]).alias(c) for c in columns])
    digest = F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)
    if null_safe:
        return digest
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return F.when(whole, digest)


def with_record_key(df: DataFrame, target: DataFrame, null_safe: bool = False, name: str = "__d") -> DataFrame:
    """Adds the digest by which ``exact_match_flag`` finds a row of ``df`` in ``target``; null if they share no column."""
    shared = sorted(set(df.columns) & set(target.columns))
    if not shared:
        return df.withColumn(name, F.lit(None).cast("string"))
    types = {c: df.schema[c].dataType for c in shared}
    # A row that cannot match gets a key of its own, so such rows do not pile up.
    alone = F.concat(F.lit("!"), _record_digest(df, shared, types, True))
    return df.withColumn(name, F.coalesce(_record_digest(df, shared, types, null_safe), alone))


def exact_match_flag(
    df: DataFrame, target: DataFrame, null_safe: bool = False, name: str = "exact_match", key: str | None = None
) -> DataFrame:
    """Whole-record match on the columns both tables have.

    Only a digest of the target crosses the network.  ``key`` names a column of ``with_record_key``, which is
    left out of the result; with it the record's own columns are not read here.
    """
    shared = sorted(set(df.columns) & set(target.columns))
    if not shared:
        return df.withColumn(name, F.lit(False)).drop(*([key] if key else []))
    types = {c: df.schema[c].dataType for c in shared}
    seen = (
        target.select(_record_digest(target, shared, types, null_safe).alias("__t"))
        .filter(F.col("__t").isNotNull())
        .distinct()
    )
    probe = df.withColumnRenamed(key, "__d") if key else with_record_key(df, target, null_safe)
    return (
        probe.join(seen, F.col("__d") == F.col("__t"), "left")
        .withColumn(name, F.col("__t").isNotNull())
        .drop("__d", "__t")
    )


def restrict_to(df: DataFrame, target: DataFrame) -> DataFrame:
    """Columns the target has; nested values become key-sorted JSON text."""
    out = []
    for c in [c for c in df.columns if c in set(target.columns)]:
        dtype = df.schema[c].dataType
        if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
            out.append(F.to_json(_sorted_struct(F.col(c), dtype)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def _sorted_struct(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        return F.struct(*[_sorted_struct(c.getField(f.name), f.dataType).alias(f.name) for f in fields])
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _sorted_struct(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(c)))
    return c


def upsert(
    target: DataFrame,
    source: DataFrame,
    key: str | Sequence[str],
    policy: Mapping[str, str] | str = "overwrite",
    order: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Merge ``source`` into ``target`` by key; returns (merged, action counts).

    ``policy`` per non-key column: ``overwrite`` (last arrival wins),
    ``keep_first`` (existing row wins), ``keep_old_if_blank`` (last non-blank
    arrival, else the old value), ``counter`` (old value plus one per arrival).
    ``order`` gives the arrival order of source rows with the same key; the
    default orders them by all their values, so a rerun gives the same table.

    The source is folded per key by mergeable aggregates, so a key that holds a
    large share of the rows is combined before the shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    values = [c for c in target.columns if c not in keys]
    rules = {c: policy if isinstance(policy, str) else policy.get(c, "overwrite") for c in values}
    asked = {policy} if isinstance(policy, str) else set(policy.values())
    unknown = asked - set(POLICIES)
    if unknown:
        raise ValueError(f"unknown merge policy: {sorted(unknown)}")
    in_source = [c for c in values if c in source.columns]
    sort_key = F.struct(*(list(order) or in_source or keys))
    folded = []
    for c in values:
        rule = rules[c]
        if rule == "counter":
            folded.append(F.count("*").alias(f"__s_{c}"))
            continue
        if c not in in_source:
            continue
        if rule == "overwrite":
            value = F.max_by(F.struct(c), sort_key)[c]
        elif rule == "keep_first":
            value = F.min_by(F.struct(c), sort_key)[c]
        else:
            filled = truthy(c, source.schema[c].dataType)
            if isinstance(source.schema[c].dataType, (T.NumericType, T.BooleanType)):
                filled = F.col(c).isNotNull()
            value = F.max_by(F.when(filled, F.col(c)), F.when(filled, sort_key))
        folded.append(value.alias(f"__s_{c}"))
    arrived = source.groupBy(*keys).agg(F.lit(True).alias("__new"), *folded)
    have = target.withColumn("__old", F.lit(True))
    joined = have.join(arrived, keys, "full")
    is_new, is_old = F.col("__new").isNotNull(), F.col("__old").isNotNull()
    out = []
    for c in values:
        rule = rules[c]
        s = F.col(f"__s_{c}")
        dtype = target.schema[c].dataType
        if rule == "counter":
            merged = (F.coalesce(F.col(c), F.lit(0)) + F.coalesce(s, F.lit(0))).cast(dtype)
        elif c not in in_source:
            merged = F.col(c)
        elif rule == "overwrite":
            merged = F.when(is_new, s).otherwise(F.col(c))
        elif rule == "keep_first":
            merged = F.when(is_old, F.col(c)).otherwise(s)
        else:
            merged = F.coalesce(s, F.col(c))
        out.append(merged.cast(dtype).alias(c))
    action = (
        F.when(is_new & is_old, "updated").when(is_new, "inserted").otherwise("unchanged")
    )
    if rules and all(r == "keep_first" for r in rules.values()):
        action = F.when(is_new & ~is_old, "inserted").otherwise("unchanged")
    tagged = joined.select(*keys, *out, action.alias("merge_action"))
    counts = tagged.groupBy("merge_action").agg(F.count("*").alias("n"))
    return tagged, counts


def exclude_seen(df: DataFrame, seen: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``seen``."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(seen.select(*keys).distinct(), keys, "left_anti")


def get_or_create_dim(
    df: DataFrame, dim: DataFrame, name: str, version: str, dim_id: str
) -> tuple[DataFrame, DataFrame]:
    """Attach the dimension id; a stored null version matches every version.

    The either-or match is two equi-joins on pre-grouped sides instead of one
    join with OR.  Returns (df with id, rows to add to the dimension).
    """
    exact = (
        dim.filter(F.col(version).isNotNull())
        .groupBy(name, version)
        .agg(F.min(dim_id).alias("__exact"))
    )
    loose = dim.filter(F.col(version).isNull()).groupBy(name).agg(F.min(dim_id).alias("__loose"))
    wanted = (
        df.select(name, version).distinct()
        .join(exact, [name, version], "left")
        .join(loose, name, "left")
        .withColumn("__found", F.least("__exact", "__loose"))
    )
    top = dim.agg(F.coalesce(F.max(dim_id), F.lit(0))).first()[0]
    fresh = wanted.filter(F.col("__found").isNull()).select(name, version)
    added = global_row_number(
        fresh, [F.col(name).asc_nulls_first(), F.col(version).asc_nulls_first()], dim_id, top + 1
    )
    ids = (
        wanted.filter(F.col("__found").isNotNull())
        .select(name, version, F.col("__found").alias(dim_id))
        .unionByName(added.select(name, version, dim_id))
    )
    ids = ids.toDF("__name", "__version", dim_id)
    cond = F.col(name).eqNullSafe(F.col("__name")) & F.col(version).eqNullSafe(F.col("__version"))
    linked = df.join(ids, cond, "left").select(*df.columns, dim_id)
    return linked, added.select(dim_id, name, version)


def consistency(
    sources: Mapping[str, DataFrame], id_col: str, fields: Sequence[str]
) -> DataFrame:
    """Values that disagree: one row per (id, field, value, source).

    A field conflicts when an id holds more than one distinct non-empty value.
    The result stays long, so no id's values are gathered into one row.
    """
    parts = [
        df.select(
            F.col(id_col), F.lit(name).alias("source"),
            *[F.col(f).cast("string").alias(f) for f in fields],
        )
        for name, df in sources.items()
    ]
    long = (
        union_all(*parts)
        .unpivot([id_col, "source"], list(fields), "field", "value")
        .filter(F.coalesce(F.col("value"), F.lit("")) != "")
        .distinct()
    )
    conflicts = (
        long.select(id_col, "field", "value").distinct()
        .groupBy(id_col, "field").agg(F.count("*").alias("n_values"))
        .filter("n_values > 1")
    )
    return long.join(conflicts, [id_col, "field"])


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def single_active(df: DataFrame, id_col: str, chosen, flag: str = "is_active") -> DataFrame:
    """Exactly the chosen row is active."""
    return df.withColumn(flag, F.coalesce(F.col(id_col) == F.lit(chosen), F.lit(False)))


def change_audit(
    before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]
) -> DataFrame:
    """One row per changed field with its old and new value."""
    b = before.select(key, *[F.col(f).cast("string").alias(f"__b_{f}") for f in fields])
    a = after.select(key, *[F.col(f).cast("string").alias(f"__a_{f}") for f in fields])
    changes = F.array(
        *[
            F.when(
                ~F.col(f"__b_{f}").eqNullSafe(F.col(f"__a_{f}")),
                F.struct(
                    F.lit(f).alias("field"),
                    F.col(f"__b_{f}").alias("old_value"),
                    F.col(f"__a_{f}").alias("new_value"),
                ),
            )
            for f in fields
        ]
    )
    return b.join(a, key).select(key, F.inline(F.filter(changes, lambda x: x.isNotNull())))


def import_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """Successes and failures of an import."""
    return df.agg(
        F.count_if(F.col(status) == "success").alias("success"),
        F.count_if(F.col(status) != "success").alias("failed"),
        F.count("*").alias("total"),
    )


def update_rows(
    target: DataFrame, updates: DataFrame, key: str, allowed: Sequence[str], order: Column | str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Overwrite allow-listed columns where the update gives a value.

    Several updates of one key are folded first: each column takes its last given value by
    ``order``, or its greatest one if no order is known.
    Returns (updated table, update rows whose key is unknown).
    """
    cols = [c for c in allowed if c in updates.columns and c in target.columns]
    by = F.col(order) if isinstance(order, str) else order
    last = [
        (F.max(c) if by is None else F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(by, F.col(c))))).alias(f"__u_{c}")
        for c in cols
    ]
    fresh = updates.groupBy(key).agg(*last) if last else updates.select(key).distinct()
    out = target.join(fresh, key, "left").select(
        *[
            F.coalesce(F.col(f"__u_{c}"), F.col(c)).alias(c) if c in cols else F.col(c)
            for c in target.columns
        ]
    )
    return out, updates.join(target.select(key), key, "left_anti")
