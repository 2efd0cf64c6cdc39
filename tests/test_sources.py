import json
import zipfile

import pytest

from quillmere import schemas
from quillmere.operators.rollup import project_rollup
from quillmere.sources import io

SCAN = """<?xml version="1.0"?>
<nmaprun><host><status state="up"/><address addr="10.0.0.1" addrtype="ipv4"/><address addr="aa:bb" addrtype="mac"/>
<ports><port portid="22" protocol="tcp"><state state="open"/><service name="ssh" version="1.10" product="OpenSSH"/></port>
<port portid="99" protocol="udp"><state state="closed"/></port></ports></host>
<host><status state="down"/><address addr="10.0.0.2" addrtype="ipv4"/></host></nmaprun>"""


def test_json_table(spark, tmp_path):
    schema = "id string, n int"
    assert io.read_json_table(spark, str(tmp_path / "none.json"), schema).count() == 0
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps([{"id": "a", "n": 1}, {"id": "b"}]))
    bad.write_text("[{'id': ")
    rows = sorted(tuple(r) for r in io.read_json_table(spark, str(good), schema).collect())
    assert rows == [("a", 1), ("b", None)]
    assert io.read_json_table(spark, str(bad), schema).count() == 0
    assert io.read_json_dir(spark, str(tmp_path), schema).count() == 2


def test_category_files(spark, tmp_path):
    (tmp_path / "net_scan_1.json").write_text(json.dumps([{"id": "a"}]))
    (tmp_path / "web_1.json").write_text(json.dumps([{"id": "b"}, {"id": "c"}]))
    rows = sorted((r["category"], r["id"]) for r in io.read_category_files(spark, str(tmp_path), "id string").collect())
    assert rows == [("net", "a"), ("web", "b"), ("web", "c")]


def test_archive_first_entry_wins(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "cves.zip", "w") as z:
        z.writestr("b.json", json.dumps([{"cve_id": "CVE-1", "description": "late"}]))
        z.writestr("a.json", json.dumps([{"cve_id": "CVE-1", "description": "first", "severity": "High"}, {"cve_id": "CVE-2"}, {"description": "no id"}]))
        z.writestr("c.json", "not json")
        z.writestr("d.txt", "[]")
    rows = {r["cve_id"]: r for r in io.read_json_archive(spark, str(tmp_path / "cves.zip")).collect()}
    assert set(rows) == {"CVE-1", "CVE-2"}
    assert (rows["CVE-1"]["description"], rows["CVE-1"]["severity"]) == ("first", "High")
    assert (rows["CVE-2"]["severity"], rows["CVE-2"]["affected_os"]) == ("Unknown", "Unknown")


def test_scan_xml(spark, tmp_path):
    (tmp_path / "scan.xml").write_text(SCAN)
    hosts = io.read_scan_xml(spark, str(tmp_path / "scan.xml"))
    by_ip = {r["ip"]: r for r in hosts.collect()}
    assert by_ip["10.0.0.1"]["mac"] == "aa:bb" and by_ip["10.0.0.2"]["status"] == "down"
    assert by_ip["10.0.0.2"]["ports"] == []
    ports = sorted(tuple(r) for r in io.scan_ports(hosts).collect())
    assert ports == [
        ("10.0.0.1", 22, "tcp", "open", "ssh", "1.10", "OpenSSH"),
        ("10.0.0.1", 99, "udp", "closed", "unknown", "", ""),
    ]


def test_project_tree(spark, tmp_path):
    def put(path, text):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)

    put("apps/one/README.md", "hello")
    put("apps/one/big.txt", "x" * 50001)
    put("apps/one/main.py", "pass")
    put("apps/one/sub/deep.md", "deep")
    put("apps/one/.git/notes.md", "hidden")
    put("libs/two/code.rs", "fn")
    tree = {r["path"]: r["content"] for r in io.read_project_tree(spark, str(tmp_path)).collect()}
    assert tree == {
        "apps/one/README.md": "hello",
        "apps/one/big.txt": "[File too large: 50001 bytes]",
        "apps/one/sub/deep.md": "deep",
    }
    rows = project_rollup(io.project_listing(spark, str(tmp_path))).collect()
    by = {(r["type"], r["category"], r["project"]): r for r in rows if r["type"] != "documentation"}
    one, two = by["project", "apps", "one"], by["project", "libs", "two"]
    assert (one["languages"], one["subprojects"], one["n_knowledge"]) == (["Python"], ["sub"], 2)
    assert (two["languages"], two["subprojects"]) == (["Rust"], [])
    assert by["ecosystem", None, None]["n_categories"] == 2
    assert by["ecosystem", None, None]["n_entries"] == sum(r["type"] != "ecosystem" for r in rows)
    assert {r["file"] for r in rows if r["type"] == "documentation"} == {"README.md", "big.txt"}


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    io.write_jdbc(spark.range(50).withColumnRenamed("id", "k"), url, "t", "overwrite", **driver)
    back = io.read_jdbc(spark, url, "t", ("k", 0, 50, 4), **driver)
    assert back.rdd.getNumPartitions() == 4 and back.count() == 50


def test_schemas_parse(spark):
    for name in ("RAW_TOOL", "KNOWLEDGE", "SCAN", "TRAINING_HISTORY", "SETTINGS", "ACTIVITY", "PAGE_SNAPSHOT"):
        assert io.empty(spark, getattr(schemas, name)).count() == 0


def test_left_out_files_are_never_opened(spark, tmp_path):
    """A file longer than the reader may read fails when it is opened; skipped, unwanted and oversized ones are not."""
    skipped = io.SKIPPED_DIRS[0]
    for name, size in {"a/notes.md": 40, f"{skipped}/b.md": 900, f"a/{skipped}/c/d.md": 900, "a/data.bin": 900, "a/.git/e.md": 900, "big.txt": 800}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" * size)
    key = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(key, "100")
    try:
        got = {r["path"]: (r["length"], r["content"]) for r in io.read_project_tree(spark, str(tmp_path), 500).collect()}
        with pytest.raises(Exception, match="maxLength|BINARY_FILE|exceeds"):
            spark.read.format("binaryFile").load(f"{tmp_path}/a/data.bin").select("content").collect()
    finally:
        spark.conf.unset(key)
    assert got == {"a/notes.md": (40, "x" * 40), "big.txt": (800, io.OVERSIZED % 800)}
