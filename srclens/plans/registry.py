"""The registered queries: each name has a Spark callable and, where SQL can express it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a partition that :func:`spread` makes.
SPREAD_ROWS = 1_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function ``(t)`` of a table reader under its name."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


class Tables:
    """Tables of a folder by name: ``t.events``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str, *columns: str | Column) -> DataFrame:
    """``columns`` of rows that are dealt out by ``key`` over partitions of about ``SPREAD_ROWS``, as many as there are rows for.

    A row of a few bytes becomes a text of a kilobyte and hundreds of tokens, so that a small file's one partition would be hours of one task.
    The number of rows is read off the file's footer. Filters stay above the columns, as below the text would be made in the file's one task, and again for each time that they read it.
    """
    dealt = rows.repartition(max(1, -(-rows.count() // SPREAD_ROWS)), key)
    return dealt.select(*columns, F.monotonically_increasing_id().alias("_row")).where("_row >= 0").drop("_row")
