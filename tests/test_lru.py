"""The cache stream over several batches against an ordered dictionary."""

import random
from collections import OrderedDict

import pandas as pd

from quillmere.runtime import ROCKSDB_PROVIDER, scratch_path
from quillmere.streaming import sinks, state


def test_equals_an_ordered_dictionary_over_batches(spark):
    rng, start = random.Random(4), pd.Timestamp("2024-01-01")
    rows, clock = [], 0
    for seq in range(600):
        clock += rng.choice([0, 1, 5, 40])
        rows.append((rng.choice("ab"), f"k{rng.choice([1, 2, 3, rng.randint(1, 12)])}", f"v{seq}", start + pd.Timedelta(seconds=clock), seq))
    want = {}
    caches = {"a": OrderedDict(), "b": OrderedDict()}
    for cache, key, value, ts, seq in rows:
        held = caches[cache]
        if key in held and ts - held[key][1] < pd.Timedelta(seconds=100):
            held.move_to_end(key)
            want[seq] = (held[key][0], True)
        else:
            held[key] = (value, ts)
            held.move_to_end(key)
            if len(held) > 5:
                held.popitem(last=False)
            want[seq] = (value, False)
    root = scratch_path(spark, "lru")
    schema = "cache string, key string, value string, ts timestamp_ntz, seq long"
    for at in range(0, 600, 150):  # a file a batch, oldest first
        spark.createDataFrame([(c, k, v, t.to_pydatetime(), s) for c, k, v, t, s in rows[at : at + 150]], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    out = state.lru_cache(stream, "cache", "key", "value", "ts", "seq", 5, 100)
    sinks.run_resumable(out, f"{root}/checkpoint", f"{root}/out").awaitTermination()
    got = {r["seq"]: (r["value"], r["hit"]) for r in spark.read.parquet(f"{root}/out").select("seq", "value", "hit").collect()}
    assert got == want
    misses = [s for s, (_, hit) in want.items() if not hit]
    assert 100 < len(misses) < 500
