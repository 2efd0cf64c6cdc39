"""A stored index of fingerprints, read only where a batch can have a neighbour.

A fingerprint is stored once for each of ``blocks`` equal blocks of its bits, in a folder for
the block and the first bits of its value.  Two fingerprints that differ in at most d bits differ in at
most d // blocks bits of some block (pigeonhole), so a batch looks up every block value within that
many flips.  A batch therefore opens the folders that its own values reach, and joins them by
equality; what is stored is neither copied again nor keyed again, and the batch alone is
multiplied.  Few blocks mean long keys and more flips: four for millions of fingerprints, two for billions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..runtime import cut_lineage
from .dedup import BITS, MAX_DISTANCE, _bigints, fingerprints, hamming, verdicts


class NearIndex:
    """Fingerprints under ``path``: rows of (entity_id, simhash, batch, place, live) by block value.

    An entity's newest fingerprint counts; an older one is withdrawn by a row that is not live.  Rows
    are only ever appended, and a replayed batch appends the rows that it appended before, which
    changes no answer.
    """

    def __init__(
        self, spark: SparkSession, path: str, max_dist: int = MAX_DISTANCE, blocks: int = 4, prefix_bits: int = 6, id_parts: int = 64
    ) -> None:
        if blocks not in (1, 2, 4, 8):
            raise ValueError("blocks must be 1, 2, 4 or 8")
        self.spark, self.path, self.max_dist, self.blocks = spark, path.rstrip("/"), max_dist, blocks
        self.width, self.prefix_bits, self.id_parts = BITS // blocks, min(prefix_bits, BITS // blocks), id_parts
        row = "entity_id string, simhash bigint, batch bigint, place bigint, live boolean"
        self._tables = {"prints": f"{row}, key bigint, cell int", "ids": f"{row}, part int"}
        for name in self._tables:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromDDL(self._tables[name])).parquet(f"{self.path}/{name}")

    def _keyed(self, rows: DataFrame, flips: tuple[int, ...] = (0,)) -> DataFrame:
        """One row for each block, and each flip of its value: adds ``key`` and ``cell``."""
        mask = -1 if self.width == BITS else (1 << self.width) - 1
        values = F.array(
            *[
                F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("simhash", i * self.width).bitwiseAND(F.lit(mask)).alias("value"))
                for i in range(self.blocks)
            ]
        )
        each = rows.select("*", F.explode(values).alias("b")).select("*", F.explode(_bigints(flips)).alias("flip"))
        keyed = each.withColumn("key", F.col("b.value").bitwiseXOR(F.col("flip")))
        first = F.shiftrightunsigned("key", self.width - self.prefix_bits).cast("int")
        return keyed.withColumn("cell", F.col("b.block") * (1 << self.prefix_bits) + first).drop("b", "flip")

    def stored(self, prints: DataFrame, before: int) -> DataFrame:
        """(h, key, cell, entity_id, simhash, batch, place, live): stored rows with a block value near one of ``prints``."""
        most = self.max_dist // self.blocks
        flips = tuple(sum(1 << i for i in c) for r in range(most + 1) for c in combinations(range(self.width), r))
        probes = cut_lineage(self._keyed(prints.select("simhash").distinct(), flips).withColumnRenamed("simhash", "h"), "probes")
        # At most blocks << prefix_bits numbers; only these folders are opened.
        cells = [r["cell"] for r in probes.select("cell").distinct().collect()]
        held = self._read("prints").filter(F.col("cell").isin(cells) & (F.col("batch") < before))
        return held.join(probes, ["cell", "key"])

    def lookup(self, prints: DataFrame, before: int) -> DataFrame:
        """(h, near): up to two entities within reach of each fingerprint, those stored first, with their distance."""
        met = self.stored(prints, before).withColumn("distance", hamming("h", "simhash")).filter(F.col("distance") <= self.max_dist)
        newest = met.groupBy("h", "entity_id", "simhash").agg(
            F.max_by(F.struct("live", "batch", "place", "distance"), "batch").alias("m")
        )
        # Live fingerprints were admitted apart from each other, so only so many lie near one value.
        listed = F.sort_array(F.collect_list(F.struct("m.batch", "m.place", "entity_id", "m.distance")))
        return newest.filter("m.live").groupBy("h").agg(F.slice(listed, 1, 2).alias("near"))

    def add(self, rows: DataFrame, batch: int) -> None:
        """Store (entity_id, simhash, place) rows of a batch; entities known under another fingerprint move."""
        part = F.pmod(F.xxhash64("entity_id"), F.lit(self.id_parts)).cast("int")
        new = cut_lineage(
            rows.select(
                F.col("entity_id").cast("string").alias("entity_id"), "simhash", F.lit(batch).cast("bigint").alias("batch"),
                F.col("place").cast("bigint").alias("place"), F.lit(True).alias("live"),
            ).withColumn("part", part),
            "prints",
        )
        parts = [r["part"] for r in new.select("part").distinct().collect()]  # at most id_parts numbers
        known = self._read("ids").filter(F.col("part").isin(parts) & (F.col("batch") < batch))
        old = known.join(new.select("part", "entity_id").distinct(), ["part", "entity_id"], "left_semi")
        last = old.groupBy("entity_id").agg(F.max_by(F.struct("simhash", "place"), "batch").alias("o"))
        gone = (
            last.join(new.select("entity_id", F.col("simhash").alias("now")), "entity_id")
            .filter("now <> o.simhash")
            .select(
                "entity_id", "o.simhash", F.lit(batch).cast("bigint").alias("batch"), "o.place", F.lit(False).alias("live")
            )
        )
        changed = cut_lineage(self._keyed(new.drop("part").unionByName(gone)), "prints")
        changed.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.path}/prints")
        new.hint("rebalance", "part").write.mode("append").partitionBy("part").parquet(f"{self.path}/ids")

    def compacted(self, path: str) -> NearIndex:
        """The same index written anew under another path: repeated rows once, few files a folder."""
        for name, column in (("prints", "cell"), ("ids", "part")):
            rows = self._read(name).dropDuplicates().hint("rebalance", column)
            rows.write.mode("overwrite").partitionBy(column).parquet(f"{path.rstrip('/')}/{name}")
        return NearIndex(self.spark, path, self.max_dist, self.blocks, self.prefix_bits, self.id_parts)


def judge(batch: DataFrame, index: NearIndex, batch_id: int, id_col: str, text_col: str, order_col: str) -> DataFrame:
    """Verdicts of ``dedup.near_dups`` for a batch, first against what earlier batches stored.

    A row near a stored fingerprint of another entity is dropped and named after the one stored
    first; the others are judged among themselves in ``order_col``.  A row's own stored
    fingerprint never counts against it.  Rows without text take no part.
    """
    prints = fingerprints(batch, id_col, text_col, order_col)
    hits = cut_lineage(index.lookup(prints, batch_id), "near-hits")
    other = F.get(F.filter("near", lambda x: x["entity_id"] != F.col(id_col).cast("string")), F.lit(0))
    met = prints.join(hits, prints["simhash"] == hits["h"]).withColumn("of", other).filter("of IS NOT NULL")
    dropped = cut_lineage(
        met.select(
            id_col, "ord", "simhash", F.lit(False).alias("kept"), F.col("of.entity_id").alias("near_dup_of"),
            (F.lit(1.0) - F.col("of.distance") / F.lit(float(BITS))).alias("similarity"),
        ),
        "near-met",
    )
    rest = cut_lineage(prints.join(dropped.select("ord"), "ord", "left_anti").select(*prints.columns), "near-rest")
    return verdicts(rest, id_col, index.max_dist).unionByName(dropped.drop("ord"))


def admit(
    batch: DataFrame, index: NearIndex, batch_id: int, out_path: str, id_col: str, text_col: str, order_col: str
) -> DataFrame:
    """Judge a batch, write its verdicts below ``out_path`` and store the fingerprints of its kept rows."""
    path = f"{out_path}/batch={batch_id}"
    found = judge(batch, index, batch_id, id_col, text_col, order_col)
    order = batch.select(id_col, F.col(order_col).cast("bigint").alias("place"))
    found.join(order, id_col).write.mode("overwrite").parquet(path)
    done = batch.sparkSession.read.parquet(path)
    index.add(done.filter("kept").select(F.col(id_col).alias("entity_id"), "simhash", "place"), batch_id)
    return done.drop("place")
