"""Routes: templates, priorities, conflicts, indexes and conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srclens.sources.shared import numbered


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)


def query_params(url: Column) -> Column:
    """Sorted names of the query parameters."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.array_sort(F.array_distinct(F.regexp_extract_all(query, F.lit(r"([^&=]+)="), F.lit(1))))


def path_template(path: Column) -> Column:
    """A path with whole-number parts as ``:id`` and without a trailing slash; the root is ``/``."""
    # Neighbouring numbers share a slash, which one replacement would consume: so it is only looked at.
    out = F.regexp_replace(path, r"/[0-9]+(?=/|$)", "/:id")
    out = F.regexp_replace(out, "/+$", "")
    return F.when(out == "", "/").otherwise(out)


def template_from_regex(pattern: Column, base: str = "") -> tuple[Column, Column]:
    """``(template, params)`` of a rewrite pattern: capture groups of digits become ``:id``, others ``:paramN``."""
    bare = F.regexp_replace(F.regexp_replace(pattern, r"^\^", ""), r"\$$", "")
    groups = F.regexp_extract_all(bare, F.lit(r"\(([^()]*)\)"), F.lit(1))
    around = F.split(bare, r"\([^()]*\)", -1)
    digits = lambda g: g.rlike(r"^\[0-9\][+*]?$|^\\d[+*]?$")
    params = F.transform(groups, lambda g, i: F.when(digits(g), F.lit("id")).otherwise(F.concat(F.lit("param"), (i + 1).cast("string"))))
    text = F.array_join(F.transform(around, lambda s, i: F.concat(s, F.coalesce(F.concat(F.lit(":"), F.get(params, i)), F.lit("")))), "")
    text = F.regexp_replace(F.concat(F.lit(base + "/"), F.regexp_replace(text, r"[\\?*+]", "")), "/+", "/")
    text = F.regexp_replace(text, "(.)/$", "$1")
    return text, params


def union_by_priority(sources: Sequence[DataFrame], order: Sequence[str]) -> DataFrame:
    """UNION ALL of the sources; each numbers its routes from 0, ties go to the earlier source."""
    out = None
    for rank, df in enumerate(sources):
        one = numbered(df, *[F.col(c).asc() for c in order], name="priority").withColumn("source_rank", F.lit(rank).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out


def partitioned_priority(routes: DataFrame, source: str, order: Sequence[str]) -> DataFrame:
    """The same for sources in one table: routes numbered from 0 within their source."""
    return routes.withColumn("priority", (F.row_number().over(Window.partitionBy(source).orderBy(*order)) - 1).cast("long"))


def conflicts(routes: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """Keys with more than one route, the members in order."""
    return (
        routes.groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.col(member).cast("string"))), ",").alias("members"))
        .where(F.col("n") > 1)
    )


def target_index(routes: DataFrame, target: str, path: str) -> DataFrame:
    """The ordered distinct paths of each target."""
    return routes.groupBy(target).agg(
        F.count("*").alias("n_routes"), F.array_join(F.sort_array(F.collect_set(path)), " ").alias("paths")
    )


def conditions_of_rules(lines: DataFrame, key: str, order: str, is_condition: Column, is_rule: Column) -> DataFrame:
    """Each rule with the conditions since the rule before it: ``key, order, n_conditions``.

    Both conditions and rules are rows of ``lines``; a rule's group is the number of rules before it.
    """
    group = F.coalesce(
        F.sum(F.when(is_rule, 1).otherwise(0)).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    grouped = lines.withColumn("_group", group)
    inside = Window.partitionBy(key, "_group")
    return (
        grouped.withColumn("n_conditions", F.count_if(is_condition).over(inside)).where(is_rule).select(key, order, "n_conditions")
    )


def route_summary(routes: DataFrame, method: str, domain: str) -> DataFrame:
    """Totals by method, by domain and over all in one pass."""
    return routes.groupingSets([[method], [domain], []], method, domain).agg(F.count("*").alias("n"))
