"""Set-based coverage, schema comparison and validators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclens.functions import naming
from srclens.sources.shared import written


def array_coverage(expected: Column, actual: Column) -> list[Column]:
    """Matched, missing and extra counts and the coverage in percent of two arrays as sets."""
    e, a = F.array_distinct(expected), F.array_distinct(actual)
    matched = F.size(F.array_intersect(e, a))
    return [
        matched.cast("long").alias("n_matched"),
        F.size(F.array_except(e, a)).cast("long").alias("n_missing"),
        F.size(F.array_except(a, e)).cast("long").alias("n_extra"),
        F.round(100.0 * matched / F.greatest(F.size(e), F.lit(1)), 4).alias("coverage"),
    ]


def field_coverage(expected: DataFrame, actual: DataFrame, key: Sequence[str], field: str) -> DataFrame:
    """The same for fields in rows: one outer join of the distinct pairs, one grouping."""
    e = expected.select(*key, F.lower(field).alias("_f")).distinct().withColumn("_e", F.lit(1))
    a = actual.select(*key, F.lower(field).alias("_f")).distinct().withColumn("_a", F.lit(1))
    both = e.join(a, [*key, "_f"], "full")
    n = lambda c: F.count_if(c)
    has_e, has_a = F.col("_e").isNotNull(), F.col("_a").isNotNull()
    return both.groupBy(*key).agg(
        n(has_e & has_a).alias("n_matched"),
        n(has_e & ~has_a).alias("n_missing"),
        n(~has_e & has_a).alias("n_extra"),
        F.round(100.0 * n(has_e & has_a) / F.greatest(n(has_e), F.lit(1)), 4).alias("coverage"),
    )


def sync(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """EXCEPT both ways and the intersection of two key sets, in one row each way: ``side, n``."""
    a = left.select(F.col(key).alias("k")).distinct().withColumn("_l", F.lit(True))
    b = right.select(F.col(key).alias("k")).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_l").isNull(), "extra").when(F.col("_r").isNull(), "missing").otherwise("matched")
    return a.join(b, "k", "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


#: Prefixes that a normalised name loses.
NAME_PREFIXES = ("tbl_", "tb_", "t_")
#: Edits that names of the last tier may differ by.
MOST_EDITS = 1


def normal_name(name: Column) -> Column:
    """A name in lower case and snake form, without a prefix of NAME_PREFIXES and in the singular: ``ies`` is y, an ``s`` after another letter than s goes."""
    low = naming.snake(name)
    for p in NAME_PREFIXES:
        low = F.when(F.startswith(low, F.lit(p)) & (F.length(low) > len(p)), F.substring(low, F.lit(len(p) + 1), F.length(low))).otherwise(low)
    return F.when(low.rlike("..ies$"), F.concat(F.substring(low, F.lit(1), F.length(low) - 3), F.lit("y"))).when(low.rlike("[^s]s$"), F.substring(low, F.lit(1), F.length(low) - 1)).otherwise(low)


def deletions(name: Column) -> Column:
    """The name and what is left of it without any one character: two names within one edit share one of these."""
    return F.array_distinct(F.concat(F.array(name), F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))))))


def matched_names(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """``key, other, tier`` for every distinct name of ``left``: its partner in ``right`` and how it was found: 1 equal, 2 equal when normalised, 3 within one
    edit when normalised; null and 0 without one.

    In a tier the partner is the nearest, of ties the first by code point. Tiers are equi-joins: normalised names meet in the texts that deleting a character leaves.
    """
    # Hints: a list of names is a small file, but its deletions are many times its size, and what is broadcast passes through the driver.
    a = written(left.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("_n", normal_name(F.col(key))), "names")
    b = written(right.select(F.col(other)).where(F.col(other).isNotNull()).distinct().withColumn("_m", normal_name(F.col(other))), "names")
    pick = lambda df, tier: df.groupBy(key).agg(F.min(F.struct("_d", F.col(other))).alias("_p")).select(key, F.col(f"_p.{other}").alias(other), F.lit(tier).cast("long").alias("tier"))
    equal = written(pick(a.join(b.hint("merge"), F.col(key) == F.col(other)).withColumn("_d", F.lit(0)), 1), "names-1")
    rest = a.join(equal.hint("merge"), key, "left_anti")
    normal = written(pick(rest.join(b.hint("merge"), F.col("_n") == F.col("_m")).withColumn("_d", F.levenshtein(F.col(key), F.col(other))), 2), "names-2")
    rest = written(rest.join(normal.hint("merge"), key, "left_anti"), "names-rest")
    spread = lambda df, c: df.withColumn("_x", F.explode(deletions(F.col(c))))
    near = spread(rest, "_n").join(spread(b, "_m").hint("merge"), "_x").withColumn("_d", F.levenshtein(F.col("_n"), F.col("_m"))).where(F.col("_d") <= MOST_EDITS)
    near = written(pick(near, 3), "names-3")
    none = rest.join(near.hint("merge"), key, "left_anti").select(key, F.lit(None).cast(b.schema[other].dataType).alias(other), F.lit(0).cast("long").alias("tier"))
    return equal.unionByName(normal).unionByName(near).unionByName(none)


def issues(checks: Sequence[tuple[str, Column]]) -> Column:
    """Names of the checks whose condition fails, in order."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]), lambda x: x.isNotNull())


def required_sections(text: Column, sections: Sequence[str]) -> Column:
    return issues([(s, F.contains(text, F.lit(s))) for s in sections])


def validation_summary(rows: DataFrame, issue_array: str) -> DataFrame:
    """Rows by their set of issues; valid have none."""
    return rows.groupBy(F.when(F.size(issue_array) == 0, F.lit("valid")).otherwise(F.array_join(issue_array, ",")).alias("issues")).agg(F.count("*").alias("n"))
