"""The stored fingerprint index against comparing everything with everything."""

import random
from pathlib import Path

import pytest

from quillmere.operators import dedup
from quillmere.operators.near_index import NearIndex, admit
from quillmere.runtime import scratch_path


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def near(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count()


@pytest.mark.parametrize(("blocks", "reach"), [(1, 1), (2, 3), (4, 6), (8, 9)])
def test_lookup_misses_nothing(spark, blocks, reach):
    rng = random.Random(blocks)
    stored = [rng.getrandbits(64) for _ in range(200)]
    asked = [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, reach + 2))) for x in stored[:60]] + stored[:5] + [0]
    index = NearIndex(spark, scratch_path(spark, "ix"), reach, blocks, 3)
    rows = [(str(i), signed(x), i) for i, x in enumerate(stored)]
    index.add(spark.createDataFrame(rows, "entity_id string, simhash long, place long"), 0)
    got = index.lookup(spark.createDataFrame([(signed(x),) for x in asked], "simhash long"), 1).collect()
    want = {}
    for q in set(asked):
        hits = [(i, near(q, x)) for i, x in enumerate(stored) if near(q, x) <= reach]
        if hits:
            want[signed(q)] = [(str(i), d) for i, d in hits[:2]]
    assert {r["h"]: [(e["entity_id"], e["distance"]) for e in r["near"]] for r in got} == want
    assert index.lookup(spark.createDataFrame([(signed(stored[0]),)], "simhash long"), 0).count() == 0


def test_only_reached_folders_are_read(spark):
    rng = random.Random(5)
    index = NearIndex(spark, scratch_path(spark, "ix"), 6, 4, 5)
    rows = [(str(i), signed(rng.getrandbits(64)), i) for i in range(3000)]
    index.add(spark.createDataFrame(rows, "entity_id string, simhash long, place long"), 0)
    one = spark.createDataFrame([(rows[7][1],)], "simhash long")
    assert "PartitionFilters: [cell" in index.stored(one, 1)._jdf.queryExecution().executedPlan().toString()
    # Of each block, the value's own folder and those one flip of its first five bits away.
    firsts = [(rows[7][1] & (1 << 64) - 1) >> 16 * b + 11 & 31 for b in range(4)]
    reached = {b * 32 + (f ^ x) for b, f in enumerate(firsts) for x in (0, 1, 2, 4, 8, 16)}
    for folder in Path(index.path.removeprefix("file:")).glob("prints/cell=*"):
        if int(folder.name[5:]) not in reached:
            for file in folder.glob("*"):
                file.unlink()
            (folder / "part-0.parquet").write_bytes(b"not a table")
    assert index.lookup(one, 1).first()["near"][0]["entity_id"] == "7"
    with pytest.raises(Exception, match="(?s).*Parquet"):
        index._read("prints").agg({"simhash": "max"}).collect()


def loop(batches, reach, print_of):
    """The stored index as a plain loop: {(batch, id): name or None}."""
    stored, out = {}, {}
    for b, rows in enumerate(batches):
        mine, before = [], dict(stored)
        for i, text in rows:
            if not text:
                continue
            h = print_of[text]
            by = [e for e, (g, place) in sorted(before.items(), key=lambda x: x[1][1]) if e != i and near(h, g) <= reach]
            own = [e for e, g in mine if near(h, g) <= reach]
            name = by[0] if by else None
            if name is None and own:
                name = own[0]
            elif name is None:
                mine.append((i, h))
            out[b, i] = name
        for i, h in mine:
            stored[i] = (h, (b, i))
    return out


def test_batches_equal_a_loop_with_updates_and_replays(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(12)]
    pool = base + [t + " extra" for t in base] + [t.replace("w1 ", "w2 ") for t in base] + [None, ""]
    batches = [[(i, rng.choice(pool)) for i in sorted(rng.sample(range(60), 25))] for _ in range(4)]
    texts = sorted({t for b in batches for _, t in b if t})
    prints = dedup.simhash(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text").collect()
    print_of = {texts[r["id"]]: r["simhash"] for r in prints}
    want = loop(batches, 6, print_of)
    root = scratch_path(spark, "ix")
    index, got = NearIndex(spark, f"{root}/index", 6, 4, 3, 4), {}
    for b, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "id long, text string")
        for _ in range(1 + b % 2):  # a replay gives the same verdicts and stores nothing new
            out = admit(df, index, b, f"{root}/out", "id", "text", "id").collect()
        if b == 1:
            index = index.compacted(f"{root}/compact")
        got |= {(b, r["id"]): None if r["kept"] else int(r["near_dup_of"]) for r in out}
    assert got == want
    assert any(n is not None for n in want.values())
