"""Streaming reads of status and event files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srclens.sources.shared import shared_dir


def status_counts(stream: DataFrame, status: str = "status") -> DataFrame:
    """Counts by the leading word of a status (``completed:12`` is completed), for batch or stream."""
    return stream.groupBy(F.regexp_extract(status, r"^(\w+)", 1).alias("state")).agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts in tumbling windows of event time; rows later than ``late`` are dropped by the watermark."""
    return (
        stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), key, "n")
    )


def file_stream(spark: SparkSession, folder: str, glob: str, schema: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", glob).parquet(folder)


def run_once(df: DataFrame, keys: Sequence[str], mode: str = "update") -> DataFrame:
    """Everything available now, driven to its end; the last result of each key as a table.

    Every micro-batch is written to the shared folder by the executors; nothing is gathered in the driver.
    """
    path = f"{shared_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/results/_batch_no={n}")

    query = df.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = T.StructType([*df.schema.fields, T.StructField("_batch", T.IntegerType())])
    found = df.sparkSession.read.schema(schema).parquet(f"{path}/results/*")
    values = [c for c in df.columns if c not in keys]
    return found.groupBy(*keys).agg(*[F.max_by(c, "_batch").alias(c) for c in values]).select(*df.columns)
