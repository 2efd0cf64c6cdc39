"""Port and scan risk: lookups, distributions, per-service and per-host rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fields import truthy
from ..functions.quantiles import exact_quantiles

# Base risk per service.
SERVICE_RISK = {
    "ftp": 0.8, "telnet": 0.9, "smtp": 0.7, "http": 0.6, "https": 0.5, "ssh": 0.4,
    "rdp": 0.8, "vnc": 0.8, "mysql": 0.7, "postgresql": 0.7, "mongodb": 0.7,
    "redis": 0.7, "elasticsearch": 0.7,
}
# Base risk per port.
PORT_RISK = {
    21: 0.8, 22: 0.4, 23: 0.9, 25: 0.7, 80: 0.6, 443: 0.5, 3306: 0.7, 3389: 0.8,
    5432: 0.7, 27017: 0.7, 6379: 0.7, 9200: 0.7,
}
DEFAULT_RISK = 0.3
# Version text that raises the risk.
OLD_VERSIONS = ("1.0", "2.0", "3.0", "4.0", "5.0")
UNSTABLE_MARKS = ("dev", "alpha", "beta", "rc")
VERSION_RISK = {"unknown": 0.5, "old": 0.8, "unstable": 0.7, "other": 0.4}


def _lookup(c: Column, table: dict) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(DEFAULT_RISK))


def service_risk(c: Column) -> Column:
    return _lookup(F.lower(c), SERVICE_RISK)


def port_risk(c: Column) -> Column:
    return _lookup(c.cast("int"), PORT_RISK)


def version_risk(c: Column) -> Column:
    old, unstable = F.lit(False), F.lit(False)
    for mark in OLD_VERSIONS:
        old = old | c.contains(mark)
    for mark in UNSTABLE_MARKS:
        unstable = unstable | F.lower(c).contains(mark)
    return (
        F.when(~truthy(c), VERSION_RISK["unknown"])
        .when(old, VERSION_RISK["old"])
        .when(unstable, VERSION_RISK["unstable"])
        .otherwise(VERSION_RISK["other"])
    )


def risk_lookups(df: DataFrame) -> DataFrame:
    """Risk by service, port and version; the 25 constants live in the plan."""
    return df.withColumns(
        {
            "service_risk": service_risk(F.col("service")),
            "port_risk": port_risk(F.col("port")),
            "version_risk": version_risk(F.col("version")),
        }
    )


def high_risk(
    df: DataFrame, threshold: float, inclusive: bool = False, or_anomaly: bool = False
) -> DataFrame:
    score = F.col("risk_score")
    test = score >= threshold if inclusive else score > threshold
    if or_anomaly:
        test = test | F.coalesce("is_anomaly", F.lit(False))
    return df.filter(test)


def scan_summary(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Hosts, ports, open ports, anomalies, mean risk, high-risk count: one scan."""
    return df.agg(
        F.count_distinct("ip").alias("total_hosts"),
        F.count("*").alias("total_ports"),
        F.count_if(F.col("state") == "open").alias("open_ports"),
        F.count_if("is_anomaly").alias("anomalies"),
        F.avg("risk_score").alias("avg_risk"),
        F.count_if(F.col("risk_score") > threshold).alias("high_risk_ports"),
    )


def mean_by(df: DataFrame, key: str, value: str, name: str = "mean") -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias(name))


def host_rollup(df: DataFrame) -> DataFrame:
    """Mean risk and open ports per host."""
    return df.groupBy("ip").agg(
        F.avg("risk_score").alias("mean_risk"),
        F.count_if(F.col("state") == "open").alias("open_ports"),
    )


def count_by(
    df: DataFrame, key: str, null_as: str | None = None, skip_empty: bool = False
) -> DataFrame:
    """Rows per value; nulls stay, are renamed, or blanks are skipped."""
    if skip_empty:
        df = df.filter(truthy(key, df.schema[key].dataType))
    value = F.col(key) if null_as is None else F.coalesce(F.col(key), F.lit(null_as))
    return df.groupBy(value.alias(key)).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over [min, max]; empty bins are present with zero."""
    clean = df.select(F.col(value).cast("double").alias("x")).filter(F.col("x").isNotNull())
    span = clean.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("s")).scalar()
    lo, hi = span["lo"], span["hi"]
    # All values equal: one unit around them, as plotting libraries do.
    lo, hi = F.when(lo == hi, lo - 0.5).otherwise(lo), F.when(lo == hi, hi + 0.5).otherwise(hi)
    width = (hi - lo) / F.lit(float(bins))
    slot = F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)).cast("int")
    counts = clean.groupBy(slot.alias("bin")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = frame.join(counts, "bin", "left")
    return out.select(
        "bin",
        (lo + F.col("bin") * width).alias("lower"),
        (lo + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
    )


def box_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Minimum, quartiles and maximum per group, exact."""
    ends = df.groupBy(key).agg(F.min(value).alias("lowest"), F.max(value).alias("highest"))
    quartiles = exact_quantiles(df, key, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return ends.join(quartiles, key)


def box_stats_approx(df: DataFrame, key: str, value: str, accuracy: int = 10000) -> DataFrame:
    """One-pass variant with a mergeable sketch."""
    q = F.percentile_approx(value, [0.25, 0.5, 0.75], accuracy)
    return df.groupBy(key).agg(
        F.min(value).alias("lowest"), q.alias("q"), F.max(value).alias("highest")
    ).select(
        key, "lowest", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"), "highest",
    )


def version_counts(df: DataFrame) -> DataFrame:
    """Rows per (service, version) with a known version, long form."""
    return df.filter(truthy("version")).groupBy("service", "version").agg(F.count("*").alias("n"))


def incidence(df: DataFrame, row: str, column: str) -> DataFrame:
    """Distinct (row, column) pairs of the sparse incidence matrix."""
    return df.select(row, column).distinct()


def incidence_matrix(df: DataFrame, row: str, column: str, listed: list) -> DataFrame:
    """Wide 0/1 form for a given list of columns."""
    marks = [
        F.max((F.col(column) == F.lit(c)).cast("int")).alias(f"{column}_{c}") for c in listed
    ]
    return df.groupBy(row).agg(*marks)


def anomaly_split(df: DataFrame) -> DataFrame:
    """Normal and anomalous rows: counts and scores."""
    return df.groupBy(F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly")).agg(
        F.count("*").alias("n"),
        F.avg("anomaly_score").alias("mean_score"),
        F.max("anomaly_score").alias("max_score"),
        F.avg("risk_score").alias("mean_risk"),
    )


def top_n(df: DataFrame, by: str, tie: list[str], n: int = 10) -> DataFrame:
    return df.orderBy(F.col(by).desc(), *tie).limit(n)
