"""Readers and writers; every reader takes an explicit schema."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import schemas
from ..functions.fields import truthy

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# What a project listing reads and what it walks past.
KNOWLEDGE_FILES = (
    "README.md", "README", "AGENTS.md", "agents.md", "DEPLOY.md", "deploy.md", "PLAN.md", "plan.md",
    "CHANGELOG.md", "TODO.md", "OVERVIEW.md", "setup.py", "package.json", "Cargo.toml",
    "CMakeLists.txt", "requirements.txt", "pyproject.toml", "pom.xml", ".env.example",
    "docker-compose.yml", "Dockerfile",
)
OVERSIZED = "[File too large: %s bytes]"  # stands for a file over the limit
KNOWLEDGE_ENDINGS = (".md", ".rst", ".txt")
SKIPPED_DIRS = (
    "node_modules", ".git", "__pycache__", ".venv", "venv", ".pytest_cache", ".cache", "build",
    "dist", "target", "obj", "bin", "lib", ".vs", ".idea", ".vscode", "logs", "tmp", "temp",
    "coverage", "htmlcov", "site-packages", "egg-info",
)
MAX_FILE_BYTES = 50_000
# Defaults of a vulnerability entry.
UNKNOWN = "Unknown"
# A port without a service.
NO_SERVICE = "unknown"


def load(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One of the supplied Parquet tables."""
    if name not in TABLES:
        raise KeyError(name)
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def _path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON arrays or objects (whole files) or one object per line; what is unreadable gives no rows."""
    bad = "_unreadable"
    raw = (
        spark.read.schema(f"{schema}, {bad} string")
        .option("multiLine", not lines)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", bad)
        .json(path)
    )
    columns = [c for c in raw.columns if c != bad]
    readable = F.col(bad).isNull()
    for c in columns:  # a record with one odd value still counts
        readable = readable | F.col(c).isNotNull()
    return raw.filter(readable).select(*columns)


def read_json_table(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """A flat-file table; a missing or unreadable file is an empty table.

    ``lines`` reads what :func:`write_table` and :func:`write_jsonl` leave, which
    splits over tasks; a JSON array is one task per file.
    """
    return _json(spark, path, schema, lines) if _path_exists(spark, path) else empty(spark, schema)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Replace (or append to) a whole table."""
    df.write.mode(mode).format(fmt).save(path)


def append_record(
    df: DataFrame, path: str, key: Sequence[str], now: Column, ts: str = "timestamp"
) -> DataFrame:
    """Append rows with an id made from their business key and a default time."""
    stamp = F.coalesce(F.col(ts), now) if ts in df.columns else now
    ident = F.sha2(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in key]), 256)
    out = df.withColumn("id", ident).withColumn(ts, stamp)
    out.write.mode("append").parquet(path)
    return out


def write_jsonl(df: DataFrame, path: str) -> None:
    """Append as JSON lines."""
    df.write.mode("append").json(path)


def export_columns(df: DataFrame, columns: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Only allow-listed columns leave; nested ones as JSON text."""
    refused = [c for c in columns if c not in allowed]
    if refused:
        raise PermissionError(f"columns not allowed: {refused}")
    out = []
    for c in columns:
        kind = df.schema[c].dataType.typeName()
        out.append(F.to_json(c).alias(c) if kind in ("array", "struct", "map") else F.col(c))
    return df.select(*out)


def export_table(
    df: DataFrame, columns: Sequence[str], allowed: Sequence[str], path: str, fmt: str = "csv"
) -> None:
    """CSV with a header, or JSON lines."""
    writer = export_columns(df, columns, allowed).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError("fmt is csv or json")


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition: tuple[str, int, int, int] | None = None,
    **options: str,
) -> DataFrame:
    """Relational table; ``partition=(column, low, high, n)`` reads it in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition:
        column, low, high, n = partition
        reader = (
            reader.option("partitionColumn", column).option("lowerBound", low)
            .option("upperBound", high).option("numPartitions", n)
        )
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").mode(mode).option("url", url).option("dbtable", table).options(**options).save()


def read_json_archive(
    spark: SparkSession, path: str, schema: str = schemas.CVE_ENTRY, key: str = "cve_id"
) -> DataFrame:
    """Zip archives of JSON arrays to rows with defaults; the first entry of a key wins.

    Order is archive path, then member name, then position in the array.  Several small
    archives share a task, as files do; one archive is opened by one task.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return unpack_archives(files, schema, key)


def unpack_archives(files: DataFrame, schema: str = schemas.CVE_ENTRY, key: str = "cve_id") -> DataFrame:
    """As :func:`read_json_archive`, from (path, content) rows.

    Python only unzips, a member at a time; Spark parses the arrays.
    """

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(".json")):
                        text = z.read(name).decode("utf-8", "replace")
                        yield pd.DataFrame({"path": [path], "member": [name], "text": [text]})

    raw = files.mapInPandas(members, "path string, member string, text string")
    parsed = raw.select("path", "member", F.posexplode(F.from_json("text", f"array<struct<{_fields(schema)}>>")).alias("pos", "e"))
    rows = parsed.filter(truthy(F.col(f"e.{key}")))
    first = rows.groupBy(F.col(f"e.{key}").alias("__k")).agg(
        F.min_by("e", F.struct("path", "member", "pos")).alias("e")
    )
    out = first.select("e.*")
    for name in ("severity", "affected_os"):
        if name in out.columns:
            out = out.withColumn(name, F.coalesce(name, F.lit(UNKNOWN)))
    return out


def _fields(schema: str) -> str:
    """``a string, b int`` as the inside of a struct type."""
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema))


def read_scan_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per scanned host with an array of its ports."""
    hosts = spark.read.format("xml").option("rowTag", "host").schema(schemas.SCAN_HOST_XML).load(path)
    by_type = lambda *kinds: F.get(
        F.filter("address", lambda a: a["_addrtype"].isin(list(kinds))), F.lit(0)
    )["_addr"]
    ports = F.transform(
        F.coalesce("ports.port", F.expr("cast(array() as array<struct<_portid:int,_protocol:string,"
                   "state:struct<_state:string>,service:struct<_name:string,_version:string,_product:string>>>)")),
        lambda p: F.struct(
            p["_portid"].alias("port"),
            p["_protocol"].alias("protocol"),
            p["state"]["_state"].alias("state"),
            F.coalesce(p["service"]["_name"], F.lit(NO_SERVICE)).alias("service"),
            F.coalesce(p["service"]["_version"], F.lit("")).alias("version"),
            F.coalesce(p["service"]["_product"], F.lit("")).alias("product"),
        ),
    )
    return hosts.select(
        by_type("ipv4", "ipv6").alias("ip"),
        by_type("mac").alias("mac"),
        F.col("status._state").alias("status"),
        ports.alias("ports"),
    )


def scan_ports(hosts: DataFrame) -> DataFrame:
    """One row per (host, port)."""
    return hosts.select("ip", F.inline("ports"))


def _tree(spark: SparkSession, root: str) -> tuple[DataFrame, Column, Column]:
    """(files, path below ``root``, whether no folder on it is skipped), told by the listing alone.

    Conditions on a file's metadata are settled before any file is opened, so what they
    leave out is never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split(":")[-1].lstrip("/")
    rel = F.regexp_replace("_metadata.file_path", r"^[a-z]+:/*" + base.replace(".", r"\.") + "/", "")
    skipped = "|".join(d.replace(".", r"\.") for d in SKIPPED_DIRS)
    return files, rel, ~rel.rlike(rf"(^|/)({skipped}|\.[^/]*)/")


def read_project_tree(spark: SparkSession, root: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Knowledge files below ``root``; an oversized file becomes a marker and is not read."""
    files, rel, open_folders = _tree(spark, root)
    name = F.col("_metadata.file_name")
    wanted = name.isin(list(KNOWLEDGE_FILES))
    for ending in KNOWLEDGE_ENDINGS:
        wanted = wanted | name.endswith(ending)
    size = F.col("_metadata.file_size")
    listed = files.filter(wanted & open_folders)
    columns = [rel.alias("path"), name.alias("file"), size.alias("length")]
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    small = listed.filter(size <= max_bytes).select(*columns, text.alias("content"))
    large = listed.filter(size > max_bytes).select(*columns, F.format_string(OVERSIZED, size.cast("string")).alias("content"))
    return small.unionByName(large)


def project_listing(spark: SparkSession, root: str) -> DataFrame:
    """(category, project, subproject, file, language, is_knowledge) for roll-ups; no file is read."""
    from ..operators.rollup import code_language

    files, rel, open_folders = _tree(spark, root)
    return (
        files.filter(open_folders)
        .select(F.split(rel, "/").alias("parts"))
        .filter(F.size("parts") >= 3)
        .select(
            F.col("parts")[0].alias("category"),
            F.col("parts")[1].alias("project"),
            F.when(F.size("parts") > 3, F.col("parts")[2]).alias("subproject"),
            F.when(F.size("parts") == 3, F.element_at("parts", -1)).alias("file"),
        )
        .withColumn("language", F.when(F.col("file").isNotNull(), code_language(F.col("file"))))
        .withColumn(
            "is_knowledge",
            F.col("file").isNotNull()
            & (F.col("file").isin(list(KNOWLEDGE_FILES)) | F.col("file").rlike(r"\.(md|rst|txt)$")),
        )
    )


def read_json_dir(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Every ``.json`` of a folder; unreadable files are passed over."""
    return read_json_table(spark, f"{folder.rstrip('/')}/*.json", schema)


def read_category_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Files named ``<category>_*.json`` as rows tagged with their category."""
    rows = read_json_dir(spark, folder, schema)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return rows.withColumn("category", F.regexp_extract(name, r"^(.+?)_.*\.json$", 1)).filter(
        truthy("category")
    )


def read_pages(spark: SparkSession, path: str, streaming: bool = False, per_trigger: int = 100) -> DataFrame:
    """Page snapshots, as a table or as a stream over a landing folder."""
    if not streaming:
        return spark.read.schema(schemas.PAGE_SNAPSHOT).parquet(path)
    return (
        spark.readStream.schema(schemas.PAGE_SNAPSHOT)
        .option("maxFilesPerTrigger", per_trigger)
        .parquet(path)
    )


def stream_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A supplied table as a stream of files."""
    schema = load(spark, base, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(base)
