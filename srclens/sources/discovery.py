"""What a source tree holds: artifacts with fallback paths, configuration files by name, fields of typed scripts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srclens.functions.conditions import basename, ladder


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """The first path that exists in its file system; null if none does."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return path
    return None


def json_with_fallback(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """The JSON document at the first path that exists, an empty table if none does."""
    path = first_existing(spark, paths)
    if path is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def file_list(spark: SparkSession, root: str) -> DataFrame:
    """``path, length`` of all files below ``root`` that aren't empty; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")


def config_kind(path: Column) -> Column:
    """sql, nginx, apache or htaccess by a file's name and folders, else null."""
    p, name = F.lower(path), F.lower(basename(path))
    return ladder(
        [
            (F.endswith(name, F.lit(".sql")), "sql"), (name.rlike(r"^nginx.*\.conf$") | p.rlike(r"/nginx/(?:.*/)?[^/]*\.conf$"), "nginx"),
            (name.rlike(r"^(?:httpd|vhost|apache.*)\.conf$") | p.rlike(r"/(?:httpd|apache)/(?:.*/)?[^/]*\.conf$"), "apache"), (name == ".htaccess", "htaccess"),
        ]
    )


def discovered(files: DataFrame, path: str = "path") -> DataFrame:
    """``kind, path, n, is_used``: configuration files numbered by path; of SQL and nginx files only the first is used."""
    found = files.select(config_kind(F.col(path)).alias("kind"), F.col(path).alias("path")).where("kind is not null")
    n = F.row_number().over(Window.partitionBy("kind").orderBy("path")).cast("long")
    return found.withColumn("n", n).withColumn("is_used", (F.col("n") == 1) | ~F.col("kind").isin("sql", "nginx"))


def entity_columns(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``table, column`` of ``*.entity.ts`` files: properties after column decorators; the table is the file's name with underscores."""
    own = files.where(F.endswith(path, F.lit(".entity.ts")))
    table = F.replace(F.regexp_replace(basename(path), r"\.entity\.ts$", ""), F.lit("-"), F.lit("_"))
    p = r"@(?:Column|PrimaryColumn|PrimaryGeneratedColumn|CreateDateColumn|UpdateDateColumn)\([^)]*\)\s*(\w+)\s*[?!]?:"
    return own.select(table.alias("table"), F.explode(F.regexp_extract_all(content, F.lit(p), F.lit(1))).alias("column")).distinct()


def dto_fields(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``dto, field`` of ``*.dto.ts`` files in lower case.

    A DTO is also known without ``create_``, ``update_`` and ``_response``, unless another has that name; of several the first by name holds.
    """
    own = files.where(F.endswith(path, F.lit(".dto.ts")))
    name = F.lower(F.replace(F.regexp_replace(basename(path), r"\.dto\.ts$", ""), F.lit("-"), F.lit("_")))
    fields = own.select(name.alias("dto"), F.explode(F.regexp_extract_all(content, F.lit(r"(\w+)\s*[?!]?:"), F.lit(1))).alias("f")).select("dto", F.lower("f").alias("field")).distinct()
    named = own.select(name.alias("dto")).distinct()
    short = named.select("dto", F.regexp_replace("dto", "create_|update_|_response", "").alias("alias")).where("alias <> dto")
    alias = short.groupBy("alias").agg(F.min("dto").alias("dto")).join(named.select(F.col("dto").alias("alias")), "alias", "left_anti")
    return fields.unionByName(fields.join(alias, "dto").select(F.col("alias").alias("dto"), "field"))
