"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.sources.shared import Scratch, numbered, shared_dir, written

__all__ = ["WHITE", "Scratch", "clean_text", "leading_words", "n_words", "numbered", "shared_dir", "table", "where_last", "words", "written"]

#: White space that separates words: \x20 and \x09-\x0D.
WHITE = " \t\n\x0b\f\r"


def clean_text(text: str | Column = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: str | Column = "text") -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; null has none.

    Every separator becomes a plain space first, because a split at one literal
    character needs no regular expression.
    """
    spaced = F.translate(clean_text(text), WHITE, " " * len(WHITE))
    return F.array_remove(F.split(spaced, " "), "")


def where_last(df: DataFrame, condition: Column) -> DataFrame:
    """The rows of ``df`` that meet a condition on its columns, each column being computed once.

    A filter on computed columns would be pushed below their projection and take copies of their
    expressions along, nested ones many times over. A row number keeps it above.
    """
    return df.withColumn("_row", F.monotonically_increasing_id()).where(condition & (F.col("_row") >= 0)).drop("_row")


def leading_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, with its white space as it is."""
    pieces = F.split(F.translate(text, WHITE, " " * len(WHITE)), " ")
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(-1).cast("long").alias("end"))
    found = F.aggregate(
        pieces,
        start,
        lambda a, x: F.struct(
            F.when(a["words"] >= n, a["words"]).otherwise(a["words"] + (x != "").cast("long")).alias("words"),
            F.when(a["words"] >= n, a["end"]).otherwise(a["end"] + 1 + F.length(x)).alias("end"),
        ),
    )
    return F.substring(text, F.lit(1), found["end"].cast("int"))


def n_words(text: str | Column = "text") -> Column:
    return F.size(words(text)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
