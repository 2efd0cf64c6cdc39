"""Session helpers shared by the iterative operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def build_session(app: str = "quillmere", cores: str = "*", **conf: str) -> SparkSession:
    """Local session used by the tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


SCOPE = "quillmere.scratch.scope"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """A folder of its own, below the shared one, for all tables written inside; deleted at the end.

    What reads those tables must have run by then.
    """
    root, outer = scratch_path(spark, "scope"), spark.conf.get(SCOPE, None)
    spark.conf.set(SCOPE, root)
    try:
        yield root
    finally:
        spark.conf.unset(SCOPE) if outer is None else spark.conf.set(SCOPE, outer)
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or the scope's folder below it.

    A machine-local folder is only ever made up in local mode, where the whole
    "cluster" is one process.
    """
    configured = spark.conf.get(SCOPE, None) or spark.conf.get("spark.checkpoint.dir", None) or (
        spark.sparkContext.getConf().get("spark.checkpoint.dir")
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    Survives executor loss, runs the plan once, and lets the planner see the
    real size, so that small sides are broadcast by measurement.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SMALL_PER_CORE = 32 << 20


def spread_small(df: DataFrame) -> DataFrame:
    """Give every core a share of an input too small to be read in parallel.

    A small file is one task however costly each row is.  The planner's own size
    estimate decides, so a large input is left as it was read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL_PER_CORE else df


def global_row_number(
    df: DataFrame, order: Sequence[Column | str], name: str, start: int = 1
) -> DataFrame:
    """Consecutive numbers in ``order`` without a one-task global window.

    Rows are range-partitioned and sorted in place; each partition's offset is
    the sum of the sizes before it.  Only one row per partition is aggregated
    on the way, so the size of that side is the partition count.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ordered = cut_lineage(
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("__mid", F.monotonically_increasing_id())
    )
    part = F.shiftright("__mid", 33)
    sizes = {
        r["p"]: r["n"]
        for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()
    }
    offsets, seen = [], start
    for p in sorted(sizes):
        offsets.append((p, seen))
        seen += sizes[p]
    table = df.sparkSession.createDataFrame(offsets, "__part bigint, __from bigint")
    within = F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ordered.withColumn("__part", part)
        .join(F.broadcast(table), "__part")  # one row per partition
        .withColumn(name, F.col("__from") + within)
        .drop("__mid", "__part", "__from")
    )
