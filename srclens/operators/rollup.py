"""Aggregations over findings and call facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srclens.functions.conditions import SEVERITY_WEIGHT, ladder, severity_weight

SEVERITIES = tuple(SEVERITY_WEIGHT)


def severity_summary(findings: DataFrame) -> DataFrame:
    """Findings by severity, every known severity present; ``severity, n``."""
    seeded = findings.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return seeded.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def by_type_with_examples(findings: DataFrame, file: str, order: Sequence[str], example: str, n_examples: int = 3) -> DataFrame:
    """Per type: count, counts by severity, distinct files and the first examples in order.

    Only the first rows of each type are collected.
    """
    place = F.row_number().over(Window.partitionBy("type").orderBy(*order))
    first = (
        findings.withColumn("place", place).where(F.col("place") <= n_examples)
        .groupBy("type").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.col(example).cast("string").alias("x")))), lambda s: s["x"]), ",").alias("examples"))
    )
    counts = findings.groupBy("type").agg(
        F.count("*").alias("n"),
        F.count_distinct(file).alias("n_files"),
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES],
    )
    return counts.join(first, "type")


def by_file(findings: DataFrame, file: str) -> DataFrame:
    """Per file and type: count and the file's total."""
    out = findings.groupBy(file, "type").agg(F.count("*").alias("n"))
    return out.withColumn("total", F.sum("n").over(Window.partitionBy(file)))


def hotspots(findings: DataFrame, file: str, least_total: int = 3, least_score: int = 10, limit: int | None = 10) -> DataFrame:
    """Files by weighted severity: ``file, total, score, top_types, recommendation``; most severe first.

    The three most frequent types (ties by name) choose the recommendation.
    """
    by_type = findings.groupBy(file, "type").agg(F.count("*").alias("n"), F.sum(severity_weight("severity")).alias("w"))
    place = F.row_number().over(Window.partitionBy(file).orderBy(F.desc("n"), "type"))
    out = by_type.withColumn("place", place).groupBy(file).agg(
        F.sum("n").alias("total"),
        F.sum("w").alias("score"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "type")))), lambda x: x["type"]), ","
        ).alias("top_types"),
    )
    out = out.where((F.col("total") >= least_total) | (F.col("score") >= least_score)).withColumn(
        "recommendation", recommendation(F.split("top_types", ","))
    )
    return out.orderBy(F.desc("score"), F.asc(file)).limit(limit) if limit else out


def recommendation(types: Column, rules: Sequence[tuple[str, str]] | None = None, otherwise: str = "review") -> Column:
    """The advice of the first type of the ladder among the given types."""
    rules = rules or (("sql_injection", "parameterise queries"), ("error", "handle errors first"), ("purchase", "audit payments"))
    return ladder([(F.array_contains(types, t), advice) for t, advice in rules], otherwise)


def first_by_key(rows: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in order."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def coverage_ratio(rows: DataFrame, covered: Column, keys: Sequence[str]) -> DataFrame:
    """100 covered / max(total, 1) by group."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(covered).alias("covered"),
        F.round(100.0 * F.count_if(covered) / F.greatest(F.count("*"), F.lit(1)), 4).alias("coverage"),
    )


def call_frequency(calls: DataFrame, method: Sequence[str], caller: str, hot: int = 10, cache_calls: int = 5, cache_callers: int = 2) -> DataFrame:
    """Per method: calls, distinct callers, hot and cacheable flags."""
    return calls.groupBy(*method).agg(
        F.count("*").alias("total_calls"), F.count_distinct(caller).alias("unique_callers")
    ).withColumn("is_hot", F.col("total_calls") >= hot).withColumn(
        "cacheable", (F.col("total_calls") >= cache_calls) & (F.col("unique_callers") >= cache_callers)
    )


def cache_strategy(total_calls: Column, unique_callers: Column, ttl_calls: int = 20, scoped_callers: int = 5) -> Column:
    return ladder([(total_calls >= ttl_calls, "ttl_300"), (unique_callers >= scoped_callers, "request_scoped")], "ttl_60")


def effort_score(sizes: DataFrame, size: str = "effort") -> DataFrame:
    """1 a small, 3 a medium, 7 a large module, and the bucket of the sum."""
    weight = ladder([(F.col(size) == "small", 1), (F.col(size) == "medium", 3), (F.col(size) == "large", 7)], 0)
    return sizes.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("effort_points")).withColumn(
        "bucket",
        ladder([(F.col("effort_points") <= 10, "small"), (F.col("effort_points") <= 25, "medium"), (F.col("effort_points") <= 50, "large")], "very_large"),
    )


def risk_bucket(security: Column, complexity: Column) -> Column:
    return ladder([((security > 10) | (complexity > 300), "high"), ((security > 5) | (complexity > 150), "medium")], "low")


def effort_bucket(lines: Column) -> Column:
    return ladder([(lines > 1000, "large"), (lines > 300, "medium")], "small")


#: What makes a project harder: name, SQL condition on its totals.
COMPLEXITY_FACTORS = (
    ("mixed_pages", "n_mixed > 0.5 * n_files"), ("heavy_database", "n_database > 50"), ("global_state", "n_globals > 20"), ("no_front_controller", "not has_front_controller"),
    ("security_review", "n_security > 10"), ("static_calls", "n_static > 20"), ("singletons", "n_singletons > 5"), ("external_apis", "n_external > 10"),
)


def project_complexity(files: DataFrame, counts: DataFrame, factors: Sequence[tuple[str, str]] = COMPLEXITY_FACTORS) -> DataFrame:
    """One row: totals of ``files`` (``total_lines, is_mixed, cyclomatic_complexity, n_globals``), the columns of the one-row ``counts``, ``mean_complexity``, ``weeks``, ``factors`` and ``level``.

    ``counts`` has ``n_database, n_security, n_static, n_singletons, n_external, has_front_controller``, as the factors ask. Three factors or more are high, one or two medium. Without files all totals are 0.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    totals = files.agg(
        F.count("*").alias("n_files"), total("total_lines").alias("n_lines"), F.count_if("is_mixed").alias("n_mixed"), total("cyclomatic_complexity").alias("n_complexity"), total("n_globals").alias("n_globals")
    )
    one = F.lit(1).alias("_one")
    out = totals.select("*", one).join(counts.select("*", one), "_one").drop("_one")
    found = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in factors]))
    out = out.withColumn("mean_complexity", F.bround(F.col("n_complexity") / F.greatest("n_files", F.lit(1)), 2)).withColumn("weeks", F.greatest(F.lit(1), F.floor(F.col("n_lines") / 2000)).cast("long"))
    return out.withColumn("factors", found).withColumn("level", F.when(F.size("factors") >= 3, "high").when(F.size("factors") >= 1, "medium").otherwise("low"))


def job_summary(segments: DataFrame, path: str = "path") -> DataFrame:
    """One row over ``path, start_line, end_line, has_sql, has_html`` of segments: files, jobs, lines, the longest job, jobs with SQL and with markup, files of more than one job."""
    lines = F.col("end_line") - F.col("start_line") + 1
    by_file = segments.groupBy(path).agg(
        F.count("*").alias("n"), F.sum(lines).alias("lines"), F.max(lines).alias("longest"), F.count_if("has_sql").alias("sql"), F.count_if("has_html").alias("html")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return by_file.agg(
        F.count("*").alias("n_files"), total("n").alias("n_jobs"), total("lines").alias("n_lines"), F.coalesce(F.max("longest"), F.lit(0)).cast("long").alias("longest_job"),
        total("sql").alias("n_with_sql"), total("html").alias("n_with_html"), F.count_if(F.col("n") > 1).alias("n_split_files"),
    )
