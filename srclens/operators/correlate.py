"""Correlations of files, tables and modules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srclens.functions.conditions import ladder
from srclens.sources.shared import written


def file_tables(accesses: DataFrame, file: str, table: str) -> DataFrame:
    """Distinct ``file, table`` with the table in lower case."""
    return every_access(accesses, file, table).distinct()


def every_access(accesses: DataFrame, file: str, table: str) -> DataFrame:
    """:func:`file_tables` a row an access, for what repeated rows don't change."""
    return accesses.select(F.col(file).alias("file"), F.lower(F.col(table).cast("string")).alias("table"))


def known_tables(mentions: DataFrame, catalogue: DataFrame, table: str = "table") -> DataFrame:
    """Mentions of catalogue tables, compared without case."""
    names = catalogue.select(F.lower(table).alias("_known")).distinct()
    return mentions.join(names, F.lower(F.col(table)) == F.col("_known"), "left_semi")


def co_occurrence(pairs: DataFrame, least_common: int = 2) -> DataFrame:
    """``t1, t2, n_common``: files that hold both tables, for pairs with ``least_common`` or more.

    ``pairs`` is distinct ``file, table``. The self-join is by file, so its size is the
    sum over files of their squared table counts, not of tables squared.
    """
    a, b = pairs.select("file", F.col("table").alias("t1")), pairs.select("file", F.col("table").alias("t2"))
    return (
        a.join(b, "file").where(F.col("t1") < F.col("t2")).groupBy("t1", "t2").agg(F.count("*").alias("n_common"))
        .where(F.col("n_common") >= least_common)
    )


def coupling(pairs: DataFrame, least_common: int = 2) -> DataFrame:
    """Co-occurrence with both tables' file counts, the ratio to the smaller and its strength."""
    pairs = written(pairs.select("file", "table"), "pairs")  # they are read four times
    counts = pairs.groupBy("table").agg(F.count("*").alias("n"))
    out = co_occurrence(pairs, least_common)
    out = out.join(counts.select(F.col("table").alias("t1"), F.col("n").alias("n1")), "t1")
    out = out.join(counts.select(F.col("table").alias("t2"), F.col("n").alias("n2")), "t2")
    ratio = F.col("n_common") / F.least("n1", "n2")
    strength = ladder([(ratio >= 0.8, "tight"), (ratio >= 0.5, "moderate")], "loose")
    return out.select("t1", "t2", "n_common", "n1", "n2", F.round(ratio, 4).alias("ratio"), strength.alias("strength"))


def ownership(accesses: DataFrame, table: str, is_sub: Column, is_write: Column) -> DataFrame:
    """Four flags by side and kind of access, and the class they give: one grouping."""
    sub, write = F.coalesce(is_sub, F.lit(False)), F.coalesce(is_write, F.lit(False))
    out = accesses.groupBy(F.col(table).alias("table")).agg(
        F.bool_or(sub & ~write).alias("sub_reads"),
        F.bool_or(sub & write).alias("sub_writes"),
        F.bool_or(~sub & ~write).alias("main_reads"),
        F.bool_or(~sub & write).alias("main_writes"),
    )
    return out.withColumn(
        "ownership",
        ladder(
            [
                (F.col("sub_writes") & F.col("main_writes"), "shared"),
                (F.col("sub_writes"), "submodule_owned"),
                (F.col("main_writes"), "main_owned"),
                (F.col("sub_reads"), "read_only"),
            ],
            "unknown",
        ),
    )


def shared_tables(uses: DataFrame, table: str, module: str) -> DataFrame:
    """Tables that more than one module uses, with the sorted modules."""
    return (
        uses.select(table, module).distinct().groupBy(table)
        .agg(F.count("*").alias("n_modules"), F.array_join(F.sort_array(F.collect_list(module)), ",").alias("modules"))
        .where(F.col("n_modules") > 1)
    )


def in_degree(edges: DataFrame, src: str, dst: str, limit: int | None = 20) -> DataFrame:
    """Dependents of each target, most first."""
    out = edges.select(src, dst).distinct().groupBy(F.col(dst).alias("node")).agg(F.count("*").alias("n_dependents"))
    return out.orderBy(F.desc("n_dependents"), "node").limit(limit) if limit else out


def roots(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Nodes with dependencies that nothing depends on."""
    return edges.select(F.col(src).alias("node")).distinct().join(edges.select(F.col(dst).alias("node")).distinct(), "node", "left_anti")


def fallback_lookup(rows: DataFrame, tiers: Sequence[tuple[DataFrame, str, str]], value: str, name: str = "resolved") -> DataFrame:
    """The value of the first tier ``(lookup, row key, lookup key)`` that has the row's key; lookups have one row a key.

    ``name_tier`` says which tier it was.
    """
    out = rows
    found = []
    for i, (lookup, key, lookup_key) in enumerate(tiers):
        side = lookup.select(F.col(lookup_key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
        out = out.join(side, F.col(key) == F.col(f"_k{i}"), "left")
        found.append(F.when(F.col(f"_k{i}").isNotNull(), F.struct(F.col(f"_v{i}").alias("v"), F.lit(i + 1).cast("long").alias("tier"))))
    out = out.withColumn("_hit", F.coalesce(*found))
    return out.select(*[F.col(c) for c in rows.columns], F.col("_hit.v").alias(name), F.col("_hit.tier").alias(f"{name}_tier"))


def best_per_group(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The best row of each key by a ranked list of columns."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def contained_passages(texts: DataFrame, passages: DataFrame, key: str, text: str, item: str, passage: str, anchor_words: int = 6) -> DataFrame:
    """``key, item`` of the passages that a text contains.

    Every passage is looked up by an anchor: the hash of words from its inside (its first and last may be cut by what stands around it),
    or of its first characters if it has no more than two words. Hashes of the texts' windows of the anchors' lengths go through
    the join with the key alone; the texts are fetched for the hits, and searched.
    """
    items = passages.select(F.col(item).alias("_item"), F.col(passage).alias("_passage")).where(F.length("_passage") > 0)
    ws = F.split("_passage", " ", -1)
    by_words = F.size(ws) > 2
    n = F.when(by_words, F.least(F.lit(anchor_words), F.size(ws) - 2)).otherwise(F.least(F.lit(3), F.length("_passage")))
    anchor = F.when(by_words, F.array_join(F.slice(ws, F.lit(2), n), " ")).otherwise(F.substring("_passage", F.lit(1), n))
    items = items.select("_item", "_passage", by_words.alias("_words"), n.cast("int").alias("_n"), anchor.alias("_anchor"))
    # A few kinds and lengths, whatever the number of passages.
    kinds = [tuple(r) for r in items.select("_words", "_n").distinct().collect()]
    words = F.split(F.coalesce(F.col(text), F.lit("")), " ", -1)

    def windows(by_words: bool, n: int) -> Column:
        body = F.col("_w") if by_words else F.col("_t")
        size = F.size(body) if by_words else F.length(body)
        piece = lambda i: F.array_join(F.slice(body, i, n), " ") if by_words else F.substring(body, i, F.lit(n))
        found = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.xxhash64(F.lit(by_words), F.lit(n), piece(i)))
        return F.when(size >= n, F.array_distinct(found)).otherwise(F.array().cast("array<bigint>"))

    if not kinds:
        return texts.select(key).crossJoin(passages.select(item).limit(0)).limit(0)
    split = texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t"), words.alias("_w"))
    hashes = split.select(key, F.explode_outer(F.concat(*[windows(*k) for k in sorted(kinds)])).alias("_h"))
    anchors = items.select("_item", F.xxhash64("_words", "_n", "_anchor").alias("_h"))
    hits = hashes.join(anchors, "_h").select(key, "_item").distinct()
    found = texts.select(key, F.col(text).alias("_t")).join(hits, key).join(items.select("_item", "_passage"), "_item")
    return found.where(F.contains("_t", F.col("_passage"))).select(key, F.col("_item").alias(item)).distinct()
