"""Sinks for micro-batches: versioned upserts and near-duplicate admission."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import upsert
from ..operators.near_index import NearIndex, admit
from ..runtime import cut_lineage

_DONE = "_SUCCESS"


class VersionedTable:
    """A table kept as ``v=<batch id>`` folders; the newest complete one is current.

    A batch writes a new folder and readers never see a half-written one, so
    replaying a batch after a failure replaces its own folder and nothing else.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        root = self._path(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        ids = [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()]
        return sorted(i for i in ids if self._fs.exists(self._path(f"{self.path}/v={i}/{_DONE}")))

    def read(self, before: int | None = None) -> DataFrame:
        ids = [i for i in self.versions() if before is None or i < before]
        if not ids:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={ids[-1]}")

    def write(self, df: DataFrame, version: int, keep: int = 2) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        for old in self.versions()[:-keep]:
            self._fs.delete(self._path(f"{self.path}/v={old}"), True)


class BucketedTable:
    """A keyed table partitioned by hash bucket; a batch overwrites only the partitions it touches.

    Each row carries the batch that last wrote its bucket, so a replayed batch leaves alone
    what it has written already.  Choose ``buckets`` so that one is a few hundred megabytes.
    Partitions are replaced one by one: read between batches, not during one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str | Sequence[str], buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.keys = [key] if isinstance(key, str) else list(key)
        self.schema = T.StructType.fromDDL(schema)
        self.stored = T.StructType([*self.schema.fields, T.StructField("_batch", T.LongType()), T.StructField("_bucket", T.IntegerType())])
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.stored).parquet(self.path)

    def read(self) -> DataFrame:
        return self._rows().select(*self.schema.fieldNames())

    def merge(self, batch: DataFrame, version: int, fold: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the touched buckets by ``fold(their rows, batch)``."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        written = self._rows().filter(F.col("_batch") >= version).select("_bucket").distinct()
        # At most one number for each bucket.
        todo = [
            r["b"] for r in batch.select(bucket.alias("b")).distinct().join(written, F.col("b") == F.col("_bucket"), "left_anti").collect()
        ]
        if not todo:
            return
        held = self._rows().filter(F.col("_bucket").isin(todo)).select(*self.schema.fieldNames())
        merged = fold(held, batch.filter(bucket.isin(todo))).select(
            *self.schema.fieldNames(), F.lit(version).cast("bigint").alias("_batch"), bucket.alias("_bucket")
        )
        # Written aside first: the plan reads the partitions that it replaces.
        cut_lineage(merged, "buckets").hint("rebalance", "_bucket").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("_bucket").parquet(self.path)


def upsert_sink(
    table: VersionedTable | BucketedTable, key: str | Sequence[str], policy: Mapping[str, str] | str, order: Sequence[str] = ()
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that merges each batch once, also when replayed."""

    def fold(held: DataFrame, batch: DataFrame) -> DataFrame:
        return upsert(held, batch, key, policy, order)[0].drop("merge_action")

    def write(batch: DataFrame, batch_id: int) -> None:
        if isinstance(table, BucketedTable):
            table.merge(batch, batch_id, fold)
        else:
            table.write(fold(table.read(before=batch_id), batch), batch_id)

    return write


def near_dup_sink(
    index: NearIndex, out_path: str, id_col: str, text_col: str, order_col: str
) -> Callable[[DataFrame, int], None]:
    """Admit each batch against the stored fingerprints of earlier ones and against itself.

    A replayed batch overwrites its own verdicts, compares only with earlier batches and
    stores the same rows again, which changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        admit(batch, index, batch_id, out_path, id_col, text_col, order_col)

    return write


def run_resumable(
    stream: DataFrame,
    checkpoint: str,
    path: str | None = None,
    each_batch: Callable[[DataFrame, int], None] | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Process what is there and stop; a rerun goes on where the last one ended."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if name:
        writer = writer.queryName(name)
    if each_batch is not None:
        return writer.foreachBatch(each_batch).start()
    return writer.format("parquet").option("path", path).start()
