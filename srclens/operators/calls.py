"""Call sites, look-ahead and call-point summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a symbol's use is found in a line: kind, what every such line holds, and the pattern with the symbol's name in group 1, member in group 2.
USAGES = (
    ("instantiation", "new", r"new\s+([A-Za-z_]\w*)\s*\("),
    ("static_call", "::", r"([A-Za-z_]\w*+)::([A-Za-z_]\w*)\s*\("),
    ("extends", "extends", r"extends\s+([A-Za-z_]\w*)"),
    ("implements", "implements", r"implements\s+([A-Za-z_]\w*)"),
    ("type_hint", "$", r"[(,]\s*+\??([A-Za-z_]\w*)\s+&?\$"),
)


def class_usages(files: DataFrame, classes: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, line, kind, class_name, member``: uses of the classes ``name``.

    Code is tokenised once into used names, a line by the patterns that it holds something for; they meet the definitions in an equi-join.
    """
    lines = files.select(path, F.posexplode(F.split(content, "\n", -1)).alias("_at", "_line"))
    none = F.array().cast("array<struct<kind:string,class_name:string,member:string>>")

    def hits(kind: str, needs: str, pattern: str) -> Column:
        names = F.regexp_extract_all("_line", F.lit(pattern), F.lit(1))
        members = F.regexp_extract_all("_line", F.lit(pattern), F.lit(2)) if kind == "static_call" else F.transform(names, lambda _: F.lit(None).cast("string"))
        found = F.transform(F.arrays_zip(names.alias("n"), members.alias("m")), lambda x: F.struct(F.lit(kind).alias("kind"), x["n"].alias("class_name"), x["m"].alias("member")))
        return F.when(F.contains("_line", F.lit(needs)), found).otherwise(none)

    any_use = F.lit(False)
    for _, needs, _ in USAGES:
        any_use = any_use | F.contains("_line", F.lit(needs))
    found = F.inline(F.concat(*[hits(*u) for u in USAGES]))
    uses = lines.where(any_use).select(path, (F.col("_at") + 1).cast("long").alias("line"), found)
    return uses.join(classes.select(F.col("name").alias("class_name")).distinct(), "class_name", "left_semi").select(
        path, "line", "kind", "class_name", "member"
    )


def method_calls(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, line, class_name, member``: ``$v->m(`` of variables that the same file makes with ``$v = new C(``."""
    lines = files.select(path, F.posexplode(F.split(content, "\n", -1)).alias("_at", "_line"))
    made = r"\$(\w+)\s*=\s*new\s+([A-Za-z_]\w*)\s*\("
    used = r"\$(\w+)->([A-Za-z_]\w*)\s*\("
    pairs = lambda p, a, b: F.inline(F.arrays_zip(F.regexp_extract_all("_line", F.lit(p), F.lit(1)).alias(a), F.regexp_extract_all("_line", F.lit(p), F.lit(2)).alias(b)))
    makes = lines.select(path, pairs(made, "var", "class_name")).distinct()
    calls = lines.select(path, (F.col("_at") + 1).cast("long").alias("line"), pairs(used, "var", "member"))
    return calls.join(makes, [path, "var"]).select(path, "line", "class_name", "member")


def function_calls(files: DataFrame, functions: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, line, member`` of calls of the functions ``name``; definitions and methods of the name match too."""
    lines = files.select(path, F.posexplode(F.split(content, "\n", -1)).alias("_at", "_line"))
    calls = lines.select(path, (F.col("_at") + 1).cast("long").alias("line"), F.explode(F.regexp_extract_all("_line", F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1))).alias("member"))
    return calls.join(functions.select(F.col("name").alias("member")).distinct(), "member", "left_semi").select(path, "line", "member")


def look_ahead(rows: DataFrame, key: str, order: Sequence[str], opens: Column, wanted: Column, reach: int = 20) -> DataFrame:
    """Opening rows with the number of wanted rows among themselves and the next ``reach`` rows."""
    window = Window.partitionBy(key).orderBy(*order).rowsBetween(0, reach)
    return rows.withColumn("n_ahead", F.count_if(wanted).over(window)).where(opens & (F.col("n_ahead") > 0))


def sequential_batches(calls: DataFrame, method: str, caller: str, order: str, least: int = 3) -> DataFrame:
    """Per method: the first caller, by first call, that calls it ``least`` times or more."""
    by_caller = calls.groupBy(method, caller).agg(F.count("*").alias("n_calls"), F.min(order).alias("first_call"))
    place = F.row_number().over(Window.partitionBy(method).orderBy("first_call", caller))
    return by_caller.where(F.col("n_calls") >= least).withColumn("_n", place).where("_n = 1").drop("_n", "first_call")


def call_point_summary(sources: Sequence[tuple[str, DataFrame]], file: str) -> DataFrame:
    """Per kind: calls and distinct files; the row ``all`` counts distinct files over all kinds."""
    out = None
    for kind, df in sources:
        one = df.select(F.lit(kind).alias("kind"), F.col(file).cast("string").alias("file"))
        out = one if out is None else out.unionByName(one)
    return out.groupingSets([["kind"], []], "kind").agg(F.count("*").alias("n_calls"), F.count_distinct("file").alias("n_files")).select(
        F.coalesce("kind", F.lit("all")).alias("kind"), "n_calls", "n_files"
    )
