"""Project roll-ups, confusion counts, vector statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.quantiles import order_statistics
from ..runtime import cut_lineage

# Language name per source-file ending.
CODE_LANGUAGES = {
    ".py": "Python", ".cpp": "C++", ".c": "C", ".hpp": "C++", ".h": "C/C++",
    ".js": "JavaScript", ".ts": "TypeScript", ".jsx": "React", ".tsx": "React",
    ".java": "Java", ".kt": "Kotlin", ".rs": "Rust", ".go": "Go", ".rb": "Ruby",
    ".php": "PHP", ".cs": "C#", ".swift": "Swift", ".scala": "Scala", ".r": "R",
    ".m": "MATLAB/Objective-C", ".sql": "SQL", ".sh": "Shell", ".ps1": "PowerShell",
    ".bat": "Batch", ".cmake": "CMake", ".make": "Makefile", ".dockerfile": "Docker",
}
MAX_SUBPROJECTS = 10
EPSILON = 1e-8


def code_language(file_name: Column) -> Column:
    """Language of a file by its lower-cased ending, or null."""
    ending = F.lower(F.regexp_extract(file_name, r"(?<=[^.])(\.[^.]*)$", 1))
    pairs = [F.lit(x) for kv in CODE_LANGUAGES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), ending)


def _first_k(df: DataFrame, group: list[str], item: str, k: int, name: str) -> DataFrame:
    """Sorted first ``k`` distinct items per group; only k rows per group are gathered."""
    ranked = (
        df.select(*group, item).distinct()
        .withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(item)))
        .filter(F.col("__r") <= k)
    )
    return ranked.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias(name))


def project_rollup(df: DataFrame) -> DataFrame:
    """Documentation, project, category and master entries of a tree listing, as typed columns.

    ``df(category, project, subproject, file, language, is_knowledge)``: one row for each
    file or folder of a project, unused columns null.  Every entry that the master row
    counts is a row of the result; how entries are worded is left to the caller.
    """
    group = ["category", "project"]
    head = df.groupBy(*group).agg(
        F.array_sort(F.collect_set("language")).alias("languages"),
        F.count_if(F.col("language").isNotNull()).alias("n_code"),
        F.count_if("is_knowledge").alias("n_knowledge"),
    )
    subs = _first_k(df.filter("subproject is not null"), group, "subproject", MAX_SUBPROJECTS, "subprojects")
    projects = cut_lineage(head.join(subs, group, "left"), "projects")
    none = F.array().cast("array<string>")
    cats = projects.groupBy("category").agg(
        F.count("*").alias("n_projects"),
        F.sum("n_code").alias("n_code"),
        F.sum("n_knowledge").alias("n_knowledge"),
        F.lit(1).cast("bigint").alias("n_categories"),
    )
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_projects", "n_code", "n_knowledge", "n_categories")]

    def entry(rows: DataFrame, kind: str) -> DataFrame:
        """One shape for all kinds; what a kind does not have is null."""
        text = ("category", "project", "file")
        lists, counts = ("languages", "subprojects"), ("n_code", "n_knowledge", "n_projects", "n_categories", "n_entries")
        held = lambda c, t: F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c)
        return rows.select(
            F.lit(kind).alias("type"),
            *[held(c, "string") for c in text],
            *[held(c, "array<string>") for c in lists],
            *[held(c, "bigint") for c in counts],
        )

    entries = F.col("n_projects") + F.col("n_knowledge") + F.col("n_categories")
    return (
        entry(df.filter("is_knowledge").select("category", "project", "file"), "documentation")
        .unionByName(entry(projects.withColumn("subprojects", F.coalesce("subprojects", none)), "project"))
        .unionByName(entry(cats.withColumn("n_entries", entries).drop("n_categories"), "category"))
        .unionByName(entry(cats.agg(*totals).withColumn("n_entries", entries), "ecosystem"))
    )


def grouped_levels(df: DataFrame, outer: str, inner: str, measure: str) -> DataFrame:
    """Counts and sums at inner, outer and grand-total level in one pass."""
    return df.rollup(outer, inner).agg(
        F.grouping_id().cast("int").alias("level"),
        F.count("*").alias("n"),
        F.sum(measure).alias("total"),
    )


def confusion(df: DataFrame, probability: str, label: str, threshold: float = 0.5) -> DataFrame:
    """True and false positives and negatives with the accuracy."""
    yes, truth = F.col(probability) >= threshold, F.col(label) == 1
    out = df.agg(
        F.count_if(yes & truth).alias("tp"),
        F.count_if(yes & ~truth).alias("fp"),
        F.count_if(~yes & ~truth).alias("tn"),
        F.count_if(~yes & truth).alias("fn"),
    )
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return out.withColumn("accuracy", F.when(n > 0, (F.col("tp") + F.col("tn")) / n).otherwise(0.0))


def dim_stats(df: DataFrame, vec: str) -> DataFrame:
    """Mean and population deviation (plus a tiny constant) of each dimension."""
    return (
        df.select(F.posexplode(vec).alias("dim", "x"))
        .groupBy("dim")
        .agg(
            F.avg(F.col("x").cast("double")).alias("mean"),
            (F.stddev_pop(F.col("x").cast("double")) + F.lit(EPSILON)).alias("std"),
        )
    )


def mean_median(df: DataFrame, value: str) -> DataFrame:
    """Mean and the upper median (element n div 2 of the sorted values)."""
    keyed = df.select(F.lit(1).alias("g"), F.col(value).alias("x"))
    mid = order_statistics(keyed, "g", "x", {"median": lambda n: F.floor(n / 2)})
    mean = keyed.groupBy("g").agg(F.avg("x").alias("mean"))
    return mean.join(mid, "g").select("mean", "median", "n")


def mean_pairwise_l2(df: DataFrame, vec: str) -> DataFrame:
    """Mean squared distance over all pairs, from per-dimension sums alone."""
    sums = (
        df.select(F.posexplode(vec).alias("dim", "x"))
        .withColumn("x", F.col("x").cast("double"))
        .groupBy("dim")
        .agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    )
    agg = sums.agg(
        F.max("n").alias("n"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s")).alias("s")
    )
    n = F.col("n").cast("double")
    value = F.lit(2.0) * (n * F.col("q") - F.col("s")) / (n * (n - 1))
    return agg.select(F.col("n").alias("n_vectors"), F.when(n > 1, value).alias("mean_l2"))
