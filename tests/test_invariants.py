"""Literal cases, brute-force checks, skew, and independence of partitioning."""

import random
from datetime import datetime, timedelta
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.functions import fields as f
from quillmere.functions.quantiles import exact_quantiles
from quillmere.operators import crawl_queue, dedup, filters, graph, merge, models, normalize, risk, security, vectors
from quillmere.plans.flows import curate
from quillmere.schemas import RAW_TOOL
from quillmere.streaming import gates, sinks


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def reference_simhash(text):
    votes = [0] * 64
    for token in text.lower().split():
        h = int(md5(token.encode()).hexdigest(), 16)
        for i in range(64):
            votes[i] += 1 if h >> i & 1 else -1
    return signed(sum(1 << i for i in range(64) if votes[i] >= 0))


def greedy(points):
    kept = []
    for i, x in points:
        if not any(bin((x ^ y) & (1 << 64) - 1).count("1") <= 6 for _, y in kept):
            kept.append((i, x))
    return {i for i, _ in kept}


def test_simhash_matches_a_loop(spark):
    texts = ["", " ", "one", "a b a", "Ünï cödé word", "x " * 500, "tie one"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for parts in (1, 4, 37):
        got = {r["id"]: r["simhash"] for r in dedup.simhash(df.repartition(parts), "id", "text").collect()}
        assert got == {i: reference_simhash(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("crowd", [8, 4096])
def test_kept_rows_match_a_loop_when_a_third_are_near_copies(spark, crowd):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    points = set()
    while len(points) < 160:
        x = base
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
            x ^= 1 << b
        points.add(x)
    while len(points) < 480:
        points.add(rng.getrandbits(64))
    rows = [(i, signed(x)) for i, x in enumerate(sorted(points, key=lambda v: v * 2654435761 % 97))]
    nodes = spark.createDataFrame(rows, "ord bigint, h bigint")
    assert {r["ord"] for r in dedup.greedy_kept(nodes, crowd=crowd).collect()} == greedy(rows)


def test_near_dups_names_earliest_kept(spark):
    words = [f"w{i}" for i in range(120)]
    near = [*words[:-1], "changed"]
    df = spark.createDataFrame(
        [(1, " ".join(words)), (2, " ".join(near)), (3, "other text entirely here"), (4, " ".join(words)), (5, ""), (6, None)],
        "id bigint, text string",
    )
    out = {r["id"]: r for r in dedup.near_dups(df, "id", "text", "id").collect()}
    assert set(out) == {1, 2, 3, 4}
    assert out[1]["kept"] and out[3]["kept"] and not out[4]["kept"] and out[4]["near_dup_of"] == "1"
    assert out[4]["similarity"] == 1.0


def test_hamming_pairs_exact(spark):
    rng = random.Random(2)
    left = [(i, signed(rng.getrandbits(64))) for i in range(200)]
    right = [(i, signed((left[i][1] & (1 << 64) - 1) ^ sum(1 << b for b in rng.sample(range(64), i % 10)))) for i in range(200)]
    a = spark.createDataFrame(left, "a int, simhash bigint")
    b = spark.createDataFrame(right, "b int, simhash bigint")
    got = {(r["a"], r["b"]) for r in dedup.hamming_pairs(a, b, "a", "b", crowd=4).collect()}
    want = {(i, j) for i, x in left for j, y in right if bin((x ^ y) & (1 << 64) - 1).count("1") <= 6}
    assert got == want


def test_timestamps(spark):
    now = datetime(2030, 1, 1)
    cases = [
        ("2024-03-05T04:05:06.5Z", datetime(2024, 3, 5, 4, 5, 6, 500000)),
        ("2024-03-05T04:05:06Z", datetime(2024, 3, 5, 4, 5, 6)),
        (" 2024-3-5 4:05:06 ", datetime(2024, 3, 5, 4, 5, 6)),
        ("2024-03-05", datetime(2024, 3, 5)),
        ("March 15, 2023", datetime(2023, 3, 15)),
        ("mar 15, 2023", datetime(2023, 3, 15)),
        ("15 March 2023", datetime(2023, 3, 15)),
        ("15 Mar 2023", datetime(2023, 3, 15)),
        ("on", now), ("junk", now), ("2024-13-45", now), ("  ", None), (None, None),
    ]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, s string")
    stamp = f.parse_timestamp_multi("s", F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))
    got = {r["i"]: r["t"] for r in df.select("i", stamp.alias("t")).collect()}
    assert got == {i: t for i, (_, t) in enumerate(cases)}


def test_ranks_and_codes(spark):
    df = spark.createDataFrame([(s,) for s in (100.0, 95.0, 94.9, 90.0, 80.0, 70.0, 60.0, 59.9)], "s double")
    assert [r[0] for r in df.select(f.quality_rank("s")).collect()] == ["S", "S", "A", "A", "B", "C", "D", "F"]
    df = spark.createDataFrame([(s,) for s in ("200", "200_js_rendered", "error_http_404", "error_timeout", "404")], "s string")
    assert [r[0] for r in df.select(f.status_code("s")).collect()] == [200, 200, 404, 0, 0]


def test_risk_lookups(spark):
    rows = [("SSH", 22, ""), ("telnet", 23, "2.0.1"), ("x", 1, "7-beta"), ("http", 80, "9.9"), ("x", 9200, None)]
    out = risk.risk_lookups(spark.createDataFrame(rows, "service string, port int, version string")).collect()
    assert [(r["service_risk"], r["port_risk"], r["version_risk"]) for r in out] == [
        (0.4, 0.4, 0.5), (0.9, 0.9, 0.8), (0.3, 0.3, 0.7), (0.6, 0.6, 0.4), (0.3, 0.7, 0.5),
    ]


def test_strip_nul_keeps_null_structs(spark):
    df = spark.createDataFrame([("a\x00b", [("c\x00",)], None)], "s string, l array<struct<x:string>>, n struct<y:string>")
    row = normalize.strip_nul(df).first()
    assert (row["s"], row["l"][0]["x"], row["n"]) == ("ab", "c", None)


def test_normalize_children(spark):
    opt = [("-v", None, False, None, None, None), ("<f>", None, True, None, None, None), ("", None, None, None, None, None)]
    cmd = [("scan", "d", "s", opt, ["ex", ""]), (None, "d", "s", [], [])]
    raw = spark.createDataFrame([], RAW_TOOL)
    row = {c: None for c in raw.columns}
    row.update(
        tool_name=" Nm ", source_url="http://x", related_vulnerabilities=["CVE-1", "CWE-2", "z", None], commands=cmd,
        workflows=[("w", ["a", "", "c"])], troubleshooting=[("i", "s"), ("", "t")], link_strings=["http://l"],
        external_links=[(None, "http://u", "", None)], content="License: MIT",
    )
    df = spark.createDataFrame([tuple(row[c] for c in raw.columns)], raw.schema)
    now = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
    out = normalize.normalize_tools(df, now)
    tool = out["tools"].first()
    assert tool["tool_id"] == md5(b"nmhttp://x").hexdigest() and tool["license"] == "MIT"
    assert tool["first_seen_timestamp"] == datetime(2030, 1, 1) == tool["last_updated_timestamp"]
    assert sorted(r["reference_type"] for r in out["related_vulnerabilities"].collect()) == ["CVE", "CWE", "OTHER"]
    assert out["commands"].count() == 1 and out["command_examples"].count() == 1
    assert {r["name"]: r["type"] for r in out["command_options"].collect()} == {"-v": "flag", "<f>": "variable"}
    assert [r["step_number"] for r in out["workflow_steps"].collect()] == [1, 3]
    assert out["troubleshooting"].count() == 1
    assert sorted(r["link"] for r in out["external_links"].collect()) == ["http://l", "http://u"]


def test_upsert_rejects_unknown_policy(spark):
    with pytest.raises(ValueError):
        merge.upsert(spark.range(1), spark.range(1), "id", "wrong")


def test_filter_modes_and_first_failing_stage(spark):
    rows = [
        (1, "a", "good text long enough to pass the length test"), (2, "b", "short"), (3, "a2", None),
        (4, "c", "good text long enough to pass the length test"), (5, "known", "another long text that shares nothing at all"),
    ]
    df = spark.createDataFrame(rows, "id bigint, name string, description string")
    target = spark.createDataFrame([(99, "known")], "id bigint, name string")
    rules = [filters.Rule(7, "description", "min_length", "6")]
    args = dict(id_col="id", text_col="description", key_cols=["id", "name"])
    ok, quarantine, audit = filters.filter_records(df, rules, target, **args)
    reasons = {r["id"]: r["quarantine_reason"] for r in audit.collect()}
    assert reasons == {1: None, 2: "Field 'description' below min length 6", 3: "low relevance", 4: "near-duplicate", 5: "duplicate"}
    assert {r["id"] for r in ok.collect()} == {1, 3, 4, 5} and quarantine.count() == 4
    strict, _, _ = filters.filter_records(df, rules, target, mode="strict", **args)
    assert {r["id"] for r in strict.collect()} == {1}


def test_rule_types_literal(spark):
    df = spark.createDataFrame([(1, "abc", "x"), (2, "xabc", ""), (3, "", None)], "id int, a string, b string")
    rules = [filters.Rule(1, "a", "regex", "ab"), filters.Rule(2, "b", "blacklist", " X , y", condition="field=a AND field=b")]
    out = {r["id"]: (r["result"], r["rule_id"]) for r in filters.apply_rules(df, rules).collect()}
    assert out == {1: ("filtered", 2), 2: ("filtered", 1), 3: ("allowed", None)}


def test_route_enrichment_takes_words_literally(spark):
    df = spark.createDataFrame(
        [(1, "u", "about c++ here", "", "c++", "", 0.6), (2, "u", "aboutx", "", "about", "", 0.9), (3, "u", "About it", None, "about", "", 0.59)],
        "id int, specific_source_url string, title string, description_snippet string, entity_name string, entity_description string, extraction_confidence double",
    )
    out = {r["id"]: r["outcome"] for r in filters.route_enrichment(df).collect()}
    assert out == {1: "irrelevant", 2: "irrelevant", 3: "review"}


def test_frontier_limits(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    walk = lambda **k: {(r["url"], r["depth"]) for r in graph.expand_frontier(edges, seeds, **k).collect()}
    assert walk(max_depth=0) == {("a", 0)}
    assert walk() == {("a", 0), ("b", 1), ("d", 1), ("c", 2)}
    assert walk(max_pages=2) == {("a", 0), ("b", 1)}


def test_quantiles_of_a_hot_group(spark):
    rng = np.random.default_rng(3)
    hot, cold = rng.normal(size=3000).round(3), rng.integers(0, 4, 50).astype(float)
    rows = [("hot", float(x)) for x in hot] + [("cold", float(x)) for x in cold] + [("one", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(13)
    out = {r["k"]: r for r in exact_quantiles(df, "k", "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).collect()}
    for name, data in (("hot", hot), ("cold", cold), ("one", [1.0])):
        want = np.percentile(data, [25, 50, 75])
        assert np.allclose([out[name]["q1"], out[name]["q2"], out[name]["q3"]], want)


def test_streaks_cross_chunks(spark):
    start = datetime(2024, 1, 1)
    rng = random.Random(1)
    rows, want, run = [], [], 0
    for i in range(400):
        ok = rng.random() < 0.05
        run = 0 if ok else run + 1
        rows.append(("u", start + timedelta(hours=3 * i), i, ok))
        want.append(run)
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, i bigint, ok boolean").repartition(7)
    for chunk in ("hour", "day", "month"):
        got = crawl_queue.error_streaks(df, "k", "ts", "i", F.col("ok"), chunk).orderBy("i").collect()
        assert [r["streak"] for r in got] == want


@pytest.mark.parametrize("chunk", [60, 3600, 86400])
def test_rate_gate_batch_matches_a_loop(spark, chunk):
    rng = random.Random(chunk)
    start, rows, t = datetime(2024, 1, 1), [], 0.0
    for i in range(600):
        t += rng.expovariate(1 / 20)
        rows.append(("hot" if i % 3 else f"d{i % 9}", i, start + timedelta(seconds=round(t, 3)), rng.random() < 0.8))
    rows.append(("hot", 9000, start + timedelta(days=9), False))
    rows.append(("hot", 9001, start + timedelta(days=9, seconds=1), True))
    last, want = {}, {}
    for d, i, ts, robots in rows:
        if d in last and ts < last[d] + timedelta(seconds=30):
            want[i] = (False, "crawl_delay", last[d] + timedelta(seconds=30))
        elif robots:
            want[i], last[d] = (True, "allowed", None), ts
        else:
            want[i] = (False, "disallowed_by_robots", None)
    df = spark.createDataFrame(rows, "d string, i bigint, ts timestamp_ntz, ok boolean").repartition(5)
    out = gates.rate_gate_batch(df, "d", "ts", "i", 30.0, "ok", chunk).collect()
    assert {r["seq"]: (r["allowed"], r["reason"], r["restricted_until"]) for r in out} == want


def test_projection_paths_agree(spark):
    d = vectors.make_dictionary(spark, 200, 16, 1)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(0, 1.7, 16)]) for i in range(60)] + [(60, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    whole = vectors.project_topk(df, d, 10).select("vec_id", "rank", "feature_id").orderBy("vec_id", "rank").collect()
    for parts in (1, 37):
        blocks = vectors.project_topk(df.repartition(parts), d.repartition(parts), 10, limit=0)
        assert blocks.select("vec_id", "rank", "feature_id").orderBy("vec_id", "rank").collect() == whole
    full = vectors.rank_topk(vectors.project(df, d), 10).select("vec_id", "rank", "feature_id")
    assert full.orderBy("vec_id", "rank").collect() == whole
    assert [r["feature_id"] for r in whole if r["vec_id"] == 60] == list(range(10))  # all zero: index order


def test_topk_ties():
    ids, vals = vectors._topk(np.array([[1.0, 5.0, 5.0, 2.0, 5.0, 0.0, 2.0, 2.0, 1.0, 0.0]]), np.arange(10), 4)
    assert ids.tolist() == [[1, 2, 4, 3]] and vals.tolist() == [[5.0, 5.0, 5.0, 2.0]]


def test_dictionary_does_not_depend_on_partitions(spark):
    a = vectors.make_dictionary(spark, 20, 4, 9).orderBy("feature_id").collect()
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    try:
        assert vectors.make_dictionary(spark, 20, 4, 9).orderBy("feature_id").collect() == a
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_float_codes(spark):
    values = [1.0, -2.5, 0.0, 3.4028235e38, 1e-45, 0.1, -0.0, 65504.0]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{p} float" for p in vectors.PILLARS))
    row = vectors.svg_path(vectors.glyph(vectors.float_hex(vectors.float_bits(df)))).first()
    want = np.array(values, dtype=np.float32)
    assert row["symbols"] == " ".join(f"{int(b):08X}" for b in want.view(np.uint32))
    assert row["hex_be"] == want.astype(">f4").tobytes().hex()
    import hashlib

    assert row["digest"] == hashlib.sha256(want.astype("<f4").tobytes()).hexdigest()
    lines = row["glyph"].split("\n")
    assert len(lines) == 17 and all(len(x) == 16 for x in lines[:16])
    bits = [[int(b) >> (31 - c) & 1 for c in range(32)] for b in want.view(np.uint32)]
    strokes = row["svg"].count("M ")
    dots = sum(map(sum, bits))
    right = sum(bits[r][c] and bits[r][c + 1] for r in range(8) for c in range(31))
    down = sum(bits[r][c] and bits[r + 1][c] for r in range(7) for c in range(32))
    assert strokes == dots + right + 2 * down


def test_int8_error_is_small(spark):
    d = vectors.make_dictionary(spark, 128, 32, 4)
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 1.7, 32)]) for i in range(20)], "vec_id bigint, embedding array<float>")
    worst = vectors.projection_error(vectors.project(df, d), vectors.project_int8(df, d)).agg(F.max("relative_error")).first()[0]
    assert worst < 1e-2


def test_encryption(spark):
    key = bytes(range(32))
    df = spark.createDataFrame([("a", ["b", None]), (None, None)], "s string, l array<string>")
    locked = security.encrypt_columns(df, ["s", "l"], key)
    assert locked.first()["s"] != "a"
    assert security.decrypt_columns(locked, ["s", "l"], key).collect() == df.collect()
    bad = spark.createDataFrame([("not base64!",)], "s string")
    assert security.decrypt_columns(bad, ["s"], key).first()[0] == security.DECRYPT_MARKER


def test_best_of_n_ties_and_threshold(spark):
    rows = [("p", 0, "", 1.0), ("p", 1, "x", 0.96), ("p", 2, "y", 0.96), ("q", 0, "z", 0.9499), ("r", 0, "w", 0.95)]
    df = spark.createDataFrame(rows, "prompt string, variation int, response string, score double")
    out = {r["prompt"]: r["response"] for r in models.best_of_n(df, "prompt", "score").collect()}
    assert out == {"p": "x", "r": "w"}


def test_curate_end_to_end(spark):
    raw = spark.createDataFrame(
        [(1, "Tool A", "http://a", "a useful description that is long"), (2, "Tool A", "http://a", "arrives later"), (3, "Tool B", "http://b", "tiny")],
        "arrival bigint, tool_name string, source_url string, description string",
    )
    stored = spark.createDataFrame([], "tool_id string, tool_name string, description string")
    now = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
    out = curate(raw, stored, [filters.Rule(1, "description", "min_length", "10")], now, order="arrival")
    assert [r["tool_name"] for r in out.tools.collect()] == ["Tool A"]
    assert out.tools.first()["description"].startswith("a useful")
    assert {r["merge_action"]: r["n"] for r in out.counts.collect()} == {"inserted": 1}
    assert out.audit.count() == 2


def test_bucketed_upsert_replays_and_keeps_other_buckets(spark, tmp_path):
    table = sinks.BucketedTable(spark, str(tmp_path / "t"), "k bigint, v string, n bigint", "k", 4)
    write = sinks.upsert_sink(table, "k", {"v": "keep_old_if_blank", "n": "counter"}, ["i"])
    schema = "k bigint, v string, i bigint"
    first = spark.createDataFrame([(k, f"a{k}", 0) for k in range(20)], schema)
    second = spark.createDataFrame([(3, "", 0), (3, "new", 1), (3, "", 2), (99, "x", 0)], schema)
    write(first, 0)
    write(second, 1)
    write(second, 1)  # a replay changes nothing
    rows = {r["k"]: (r["v"], r["n"]) for r in table.read().collect()}
    assert len(rows) == 21 and rows[3] == ("new", 4) and rows[99] == ("x", 1) and rows[7] == ("a7", 1)
    third = spark.createDataFrame([(3, "newer", 0), (7, "", 1)], schema)
    write(third, 2)
    rows = {r["k"]: (r["v"], r["n"]) for r in table.read().collect()}
    assert len(rows) == 21 and rows[3] == ("newer", 5) and rows[7] == ("a7", 2) and rows[99] == ("x", 1)
