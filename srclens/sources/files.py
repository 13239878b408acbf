"""Readers of source trees and artifacts, and the sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srclens.functions.conditions import under_path


def source_files(spark: SparkSession, root: str, glob: str = "*.php", exclude: Sequence[str] = ()) -> DataFrame:
    """``path, content`` of all files below ``root``, one row each; subtrees in ``exclude`` are skipped."""
    found = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    out = found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    for x in exclude:
        out = out.where(~under_path(F.col("path"), x))
    return out


def decoded_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """The same for files of unknown encoding: UTF-8 if the bytes are, else Latin-1."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    utf8 = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return raw.select("path", F.coalesce(utf8, F.decode("content", "ISO-8859-1")).alias("content"))


def json_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole JSON document or array with a declared schema; broken ones have null columns."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def manifests(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """``manifest.json`` of every directory below; broken files are skipped."""
    full = f"{schema}, _corrupt_record STRING"
    found = spark.read.schema(full).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").json(root)
    return found.withColumn("path", F.col("_metadata.file_path")).where("_corrupt_record is null").drop("_corrupt_record")


def ini_sections(lines: DataFrame, path: str = "path", line: str = "line", text: str = "text") -> DataFrame:
    """``path, section, key, value`` of INI-like files such as .gitmodules: every key belongs to the last section before it."""
    header = F.when(F.col(text).rlike(r"^\s*\["), F.regexp_extract(text, r"\[\s*\w*\s*\"?([^\"\]]*)\"?\s*\]", 1))
    section = F.last(header, ignorenulls=True).over(Window.partitionBy(path).orderBy(line).rowsBetween(Window.unboundedPreceding, 0))
    pair = r"^\s*([\w.]+)\s*=\s*(.*?)\s*$"
    return lines.withColumn("section", section).where(F.col(text).rlike(pair)).select(
        path, "section", F.regexp_extract(text, pair, 1).alias("key"), F.regexp_extract(text, pair, 2).alias("value")
    )


def submodule_status(lines: DataFrame, text: str = "text") -> DataFrame:
    """``commit, path, state`` of status lines whose first character is ``-``, ``+``, ``U`` or a space."""
    mark = F.substring(text, 1, 1)
    state = F.when(mark == "-", "uninitialised").when(mark == "+", "modified").when(mark == "U", "conflict").otherwise("current")
    rest = F.split(F.trim(F.substring(text, 2, 10_000)), " ")
    return lines.select(F.get(rest, F.lit(0)).alias("commit"), F.get(rest, F.lit(1)).alias("path"), state.alias("state"))


def compact(cols: Sequence[tuple[str, Column | str]]) -> Column:
    """One delimited string a row: ``L: 12 C: 3``; the first has no label if its name is empty."""
    parts = [F.concat(F.lit(f"{n}: " if n else ""), F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("-"))) for n, c in cols]
    return F.concat_ws(" ", *parts)


def split_write(df: DataFrame, topic: str, topics: Sequence[str], path: str) -> None:
    """One Parquet folder a topic from one pass: rows are partitioned by the topic column."""
    df.where(F.col(topic).isin(*topics)).write.mode("overwrite").partitionBy(topic).parquet(path)


def markdown(df: DataFrame, limit: int = 100) -> str:
    """A Markdown table of at most ``limit`` rows, which is what a report shows."""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]])


def pending(jobs: DataFrame, outputs: DataFrame, key: str, size: str = "size", least: int = 100) -> DataFrame:
    """Jobs without an output of more than ``least`` bytes: an incremental run skips the others."""
    return jobs.join(outputs.where(F.col(size) > least).select(key).distinct(), key, "left_anti")


def phases_to_run(phases: DataFrame, log: DataFrame, skip: Sequence[str] = (), resume_from: str | None = None) -> DataFrame:
    """``phases`` (``place, phase``) that a run has to do: not those skipped, done by their last ``log`` row (``phase, status, at``), or before ``resume_from``.

    The phase to resume from runs again, whatever the log says.
    """
    last = log.groupBy("phase").agg(F.max_by("status", "at").alias("status")).where("status = 'completed'")
    if resume_from is not None:
        last = last.where(F.col("phase") != resume_from)
        start = phases.where(F.col("phase") == resume_from).select(F.min("place").alias("_start"))
        phases = phases.where(F.col("place") >= F.coalesce(start.scalar(), F.lit(0)))
    return phases.where(~F.col("phase").isin(*skip)).join(last, "phase", "left_anti")
