"""Column encryption by policy; keys arrive as arguments, never in code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

DECRYPT_MARKER = "[Decryption Error]"
MODE, PADDING = "GCM", "DEFAULT"


def _lock(c: Column, key: Column) -> Column:
    return F.base64(F.aes_encrypt(c, key, F.lit(MODE), F.lit(PADDING)))


def _open(c: Column, key: Column) -> Column:
    raw = F.try_to_binary(c, F.lit("base64"))
    plain = F.try_aes_decrypt(raw, key, F.lit(MODE), F.lit(PADDING)).cast("string")
    return F.when(c.isNotNull(), F.coalesce(plain, F.lit(DECRYPT_MARKER)))


def _apply(df: DataFrame, cols: Sequence[str], fn) -> DataFrame:
    out = {}
    for name in cols:
        if name not in df.columns:
            continue
        dtype = df.schema[name].dataType
        if isinstance(dtype, T.ArrayType):
            out[name] = F.transform(F.col(name), fn)
        elif isinstance(dtype, T.StringType):
            out[name] = fn(F.col(name))
        else:
            raise TypeError(f"column {name} is not text")
    return df.withColumns(out) if out else df


def encrypt_columns(df: DataFrame, cols: Sequence[str], key: bytes) -> DataFrame:
    """Sensitive text columns (and lists of text) to base64 ciphertext; nulls stay."""
    secret = F.lit(key)
    return _apply(df, cols, lambda c: _lock(c, secret))


def decrypt_columns(df: DataFrame, cols: Sequence[str], key: bytes) -> DataFrame:
    """Inverse of :func:`encrypt_columns`; unreadable values become a marker."""
    secret = F.lit(key)
    return _apply(df, cols, lambda c: _open(c, secret))


def read_settings(df: DataFrame, key: bytes) -> DataFrame:
    """(key, value) with flagged values decrypted."""
    value = F.when(F.coalesce("encrypted", F.lit(False)), _open(F.col("value"), F.lit(key)))
    return df.select("key", value.otherwise(F.col("value")).alias("value"))
