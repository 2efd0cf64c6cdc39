"""What the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..runtime import cut_lineage, scratch_path


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (long) and ``text`` (null counts as empty), without any other column but ``more``."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *more,
    )


def held_out(doc_id: Column) -> Column:
    """The rows no model may learn from: crc32 of the id's digits is a multiple of five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``cut_lineage`` with the table's path, for ``forget``."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def keep_rows(docs: DataFrame, answer: DataFrame) -> DataFrame:
    """The rows of ``docs`` that a written (doc_id, digest, kept) table keeps, all their columns and no others.

    ``digest`` is the SHA-256 of the text (null as empty).  A row stays where its id and
    digest are those of a kept row; rows repeated with the same id and text are folded to the
    one whose columns, as JSON, come first.
    """
    # Columns by number, so that no name of theirs can clash with one made here.
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own_id, own_text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    mine = numbered.select("*", sha256(F.coalesce(own_text, F.lit(""))).alias("sha"), own_id.cast("bigint").alias("id"))
    named = answer.select(F.col("doc_id").alias("of"), F.col("digest").alias("digest"), "kept")
    same = F.col("sha").eqNullSafe(F.col("digest")) & F.col("id").eqNullSafe(F.col("of"))
    rows = mine.join(named.filter("kept").drop("kept"), same, "left_semi")
    twice = cut_lineage(named.groupBy("of", "digest").count().filter("count > 1").drop("count"), "repeats")
    if not twice.isEmpty():
        first = F.min(F.struct(F.to_json(F.struct(*numbered.columns)).alias("j"), F.struct(*numbered.columns).alias("r")))
        folded = rows.join(twice, same, "left_semi").groupBy("id", "sha").agg(first.alias("m")).select("m.r.*")
        rows = rows.join(twice, same, "left_anti").select(*numbered.columns).unionByName(folded)
    return rows.select(*numbered.columns).toDF(*docs.columns)
