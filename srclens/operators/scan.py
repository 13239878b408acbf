"""Rule scans: every rule against every text, every match one finding.

Rules are independent, so a span may be found by several. The rule set is data
(:class:`Rule` rows, known when the plan is built); each becomes one constant regular expression,
compiled once a task. A text is first searched for what every match of a rule must hold (:func:`literals.required`), which takes no
regular expression, and only then for the rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srclens.functions import literals


#: Rules up to which each is an expression of its own.
UNROLLED = 16


@dataclass(frozen=True)
class Rule:
    rule_id: str
    family: str
    type: str
    severity: str
    pattern: str
    snippet_len: int = 100
    group: int = 0
    #: Whether a match may span lines, which needs the whole text.
    multiline: bool = False


def text_lines(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, line, content``: lines from 1; a text that ends with a newline has an empty last line."""
    return texts.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("at", "content")).select(
        key, (F.col("at") + 1).cast("long").alias("line"), "content"
    )


def _labels(rule: Rule) -> list[Column]:
    return [F.lit(getattr(rule, n)).alias(n) for n in ("rule_id", "family", "type", "severity")]


def may_match(rule: Rule, content: Column, low: Column) -> Column:
    """Whether a rule matches a text, given the text in lower case: the regular expression is run on texts that hold what it needs."""
    hit = content.rlike(rule.pattern)
    needs = [F.contains(low, F.lit(x)) for x in literals.required(rule.pattern)]
    if not needs:
        return hit
    guard = needs[0]
    for x in needs[1:]:
        guard = guard | x
    return guard & hit


def _line_hits(rule: Rule) -> Column:
    found = F.regexp_extract_all("content", F.lit(rule.pattern), F.lit(rule.group))
    return F.when(
        may_match(rule, F.col("content"), F.col("_low")),
        F.transform(found, lambda m, i: F.struct(*_labels(rule), (i + 1).cast("long").alias("in_line"), F.substring(m, 1, rule.snippet_len).alias("snippet"))),
    )


def scan_lines(texts: DataFrame, rules: Sequence[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings of rules that match inside a line: ``key, rule_id, family, type, severity, line, in_line, snippet``.

    Lines are exploded once for all rules and nothing is shuffled. More than ``UNROLLED`` rules stand in the plan as one constant list with what they need, from which
    every line takes the few that may match; fewer are expressions of their own.
    """
    lines = text_lines(texts, key, text).withColumn("_low", F.lower("content"))
    if len(rules) > UNROLLED:
        return _scan_listed(lines, rules, key)
    empty = F.array().cast("array<struct<rule_id:string,family:string,type:string,severity:string,in_line:bigint,snippet:string>>")
    hits = F.concat(*[F.coalesce(_line_hits(r), empty) for r in rules])
    return lines.select(key, "line", F.explode(hits).alias("hit")).select(key, "hit.rule_id", "hit.family", "hit.type", "hit.severity", "line", "hit.in_line", "hit.snippet")


def _scan_listed(lines: DataFrame, rules: Sequence[Rule], key: str) -> DataFrame:
    labels = ("rule_id", "family", "type", "severity")
    known = F.array(*[F.struct(F.array(*[F.lit(x) for x in literals.required(r.pattern)]).cast("array<string>").alias("needs"), F.lit(i).alias("rule")) for i, r in enumerate(rules)])
    own = F.transform(F.filter(known, lambda r: (F.size(r["needs"]) == 0) | F.exists(r["needs"], lambda x: F.contains(F.col("_low"), x))), lambda r: r["rule"])
    facts = F.array(*[F.struct(*_labels(r), F.lit(r.pattern).alias("pattern"), F.lit(r.group).alias("group"), F.lit(r.snippet_len).alias("snippet_len")) for r in rules])
    each = lines.select(key, "line", "content", F.explode(own).alias("_rule")).withColumn("_r", F.get(facts, F.col("_rule")))
    each = each.select(key, "line", *[F.col(f"_r.{x}").alias(x) for x in labels], "_r.snippet_len", F.posexplode(F.regexp_extract_all("content", F.col("_r.pattern"), F.col("_r.group"))).alias("_i", "_m"))
    return each.select(key, *labels, "line", (F.col("_i") + 1).cast("long").alias("in_line"), F.substring("_m", F.lit(1), F.col("snippet_len")).alias("snippet"))


def _pieces(rule: Rule, content: Column) -> Column:
    found = F.regexp_extract_all(content, F.lit(rule.pattern), F.lit(0))
    shown = F.regexp_extract_all(content, F.lit(rule.pattern), F.lit(rule.group))
    around = F.split(content, rule.pattern, -1)
    return F.transform(
        found,
        lambda m, i: F.struct(
            *_labels(rule), (i + 1).cast("long").alias("ordinal"), F.get(around, i).alias("before"), m.alias("match"),
            F.substring(F.get(shown, i), 1, rule.snippet_len).alias("snippet"),
        ),
    )


def scan_texts(texts: DataFrame, rules: Sequence[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings of rules that may span lines, with ``offset`` (characters before the match) and ``ordinal``.

    The text between matches gives offset and line: the pieces around m matches are m + 1, so
    sums over the pieces before a match place it.
    """
    # The texts are read once: the pieces of all rules stand in one array.
    content = F.coalesce(text, F.lit(""))
    fields = "rule_id:string,family:string,type:string,severity:string,ordinal:bigint,before:string,match:string,snippet:string"
    none = F.array().cast(f"array<struct<{fields}>>")
    out = texts.select(key, F.inline(F.concat(*[F.when(may_match(r, content, F.lower(content)), _pieces(r, content)).otherwise(none) for r in rules])))
    newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    order = Window.partitionBy(key, "rule_id").orderBy("ordinal")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    chars = F.sum(F.length("before") + F.length("match")).over(so_far)
    lines = F.sum(newlines(F.col("before")) + newlines(F.col("match"))).over(so_far)
    return (
        out.withColumn("offset", chars - F.length("match"))
        .withColumn("line", lines - newlines(F.col("match")) + 1)
        .drop("before", "match")
    )


def numbered(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """``ordinal``: the finding's place among those of its text and rule, in text order."""
    order = Window.partitionBy(key, "rule_id").orderBy("line", "in_line")
    return findings.withColumn("ordinal", F.row_number().over(order).cast("long"))


def rule_counts(texts: DataFrame, rules: Sequence[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, rule_id, n_matches`` of the rules that match a text, without exploding matches."""
    counts = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.regexp_count(text, F.lit(r.pattern)).cast("long").alias("n_matches")) for r in rules])
    return texts.select(key, F.inline(F.filter(counts, lambda x: x["n_matches"] > 0)))


def merge_by_line(findings: DataFrame, key: str = "doc_id", family: str = "family") -> DataFrame:
    """One finding a line and family, the names of merged ones collected (pagination style)."""
    return findings.groupBy(key, family, "line").agg(
        F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"), F.count("*").alias("n_merged")
    )


def pattern_rollup(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per rule: files with it, matches, sorted distinct severities."""
    return findings.groupBy("family", "rule_id").agg(
        F.count_distinct(key).alias("files_with"), F.count("*").alias("total"), F.max("severity").alias("severity")
    )


def first_output_points(texts: DataFrame, first: Sequence[tuple[str, str]], limit: int = 30, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines with the first kind of ``(kind, pattern)`` that matches, at most ``limit`` a text."""
    kind = F.coalesce(*[F.when(F.col("content").rlike(p), F.lit(k)) for k, p in first])
    hits = text_lines(texts, key, text).withColumn("kind", kind).where(F.col("kind").isNotNull())
    place = F.row_number().over(Window.partitionBy(key).orderBy("line")).cast("long")
    return hits.withColumn("n", place).where(F.col("n") <= limit).select(key, "line", "kind", "n")


def with_flag_from(findings: DataFrame, flag: Column, name: str, key: str = "doc_id") -> DataFrame:
    """A flag of any finding spread to all findings of the text."""
    return findings.withColumn(name, F.coalesce(F.max(flag).over(Window.partitionBy(key)), F.lit(False)))
