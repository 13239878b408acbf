"""Line metrics, running state, scores and classes of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_counts(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Newlines, lines by splitting, lines by reading (no empty tail) and blank lines."""
    body = F.coalesce(text, F.lit(""))
    lines = F.split(body, "\n", -1)
    return texts.select(
        key,
        (F.size(lines) - 1).cast("long").alias("n_newlines"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.when(F.element_at(lines, -1) == "", 1).otherwise(0)).cast("long").alias("n_read_lines"),
        F.size(F.filter(lines, lambda x: F.trim(x) == "")).cast("long").alias("n_blank"),
    )


def inventory(texts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Files, lines and characters by group."""
    body = F.coalesce(text, F.lit(""))
    return texts.groupBy(*keys).agg(
        F.count("*").alias("n_files"),
        F.sum(F.size(F.split(body, "\n", -1))).alias("n_lines"),
        F.sum(F.length(body).cast("long")).alias("n_chars"),
        F.max(F.length(body).cast("long")).alias("longest"),
    )


def running_state(rows: DataFrame, key: str, order: str, opens: Column, closes: Column, name: str = "inside") -> DataFrame:
    """A flag that an opening row sets and a closing row clears, the close read second; rows before any are outside."""
    event = F.when(closes, False).when(opens, True)
    window = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.coalesce(F.last(event, ignorenulls=True).over(window), F.lit(False)))


def complexity(text: str | Column, decisions: Sequence[str]) -> Column:
    """1 and the matches of all decision patterns."""
    out = F.lit(1).cast("long")
    for p in decisions:
        out = out + F.regexp_count(text, F.lit(p)).cast("long")
    return out


def additive_score(terms: Sequence[tuple[Column, float]]) -> Column:
    """The sum of the weights whose condition holds, not below 0."""
    out = F.lit(0.0)
    for condition, weight in terms:
        out = out + F.when(condition, float(weight)).otherwise(0.0)
    return F.greatest(out, F.lit(0.0))


def entry_class(score: Column, n_functions: Column) -> Column:
    """entry from 3 on; include below 1 with a function; other between and below without."""
    return F.when(score >= 3, "entry").when((score < 1) & (n_functions >= 1), "include").otherwise("other")
