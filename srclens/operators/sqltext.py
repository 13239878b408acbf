"""Facts from SQL in texts: verbs, tables, columns, DDL and literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclens.functions.conditions import ladder

_NAME = r"[`\"]?(\w+)[`\"]?"


def operation(query: Column) -> Column:
    """The verb that a query starts with, else OTHER."""
    q = F.upper(F.ltrim(query))
    return ladder([(F.startswith(q, F.lit(v)), v) for v in ("SELECT", "INSERT", "UPDATE", "DELETE", "REPLACE")], "OTHER")


def main_table(query: Column) -> Column:
    """The table that the verb decides: FROM, INTO or UPDATE; lower case, null if none."""
    by = {"SELECT": r"(?i)\bFROM\s+", "INSERT": r"(?i)\bINTO\s+", "UPDATE": r"(?i)\bUPDATE\s+", "DELETE": r"(?i)\bFROM\s+", "REPLACE": r"(?i)\bINTO\s+"}
    op = operation(query)
    return F.lower(F.nullif(ladder([(op == v, F.regexp_extract(query, p + _NAME, 1)) for v, p in by.items()], ""), F.lit("")))


def all_tables(query: Column) -> Column:
    """Every table after FROM, JOIN, INTO or UPDATE, sorted and distinct in lower case."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(query, F.lit(r"(?i)\b(?:FROM|JOIN|INTO|UPDATE)\s+" + _NAME), F.lit(1)), F.lower)))


def columns(query: Column) -> Column:
    """Columns of the select list, insert list, SET and WHERE parts; sorted, distinct, without aliases, prefixes and ``$`` variables."""
    selected = F.regexp_extract(query, r"(?is)^\s*SELECT\s+(?:DISTINCT\s+)?(.*?)\s+FROM\b", 1)
    inserted = F.regexp_extract(query, r"(?is)\bINTO\s+[`\"]?\w+[`\"]?\s*\(([^)]*)\)", 1)
    plain = F.transform(
        F.filter(F.concat(F.split(selected, ","), F.split(inserted, ",")), lambda x: F.trim(x) != ""),
        lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"(?is)\s+(AS\s+)?\w+$", ""), r"^\w+\.", ""),
    )
    changed = F.regexp_extract_all(F.regexp_extract(query, r"(?is)\bSET\s+(.*?)(?:\bWHERE\b|$)", 1), F.lit(r"(\w+)\s*="), F.lit(1))
    asked = F.regexp_extract_all(F.regexp_extract(query, r"(?is)\bWHERE\s+(.*)$", 1), F.lit(r"(?i)(\w+)\s*(?:=|<|>|!=|\bIN\b|\bLIKE\b|\bIS\b)"), F.lit(1))
    found = F.concat(F.transform(plain, lambda x: F.replace(x, F.lit("`"), F.lit(""))), changed, asked)
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, F.lower), lambda x: x.rlike("^[a-z_]\\w*$"))))


def split_at_commas(text: Column) -> Column:
    """Parts of a text at commas outside brackets and quotes, trimmed, empty ones dropped."""
    pieces = F.regexp_extract_all(text, F.lit(r"""(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^'"()\[\]{},]++|."""), F.lit(0))
    state = F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)
        cut = (c == ",") & (s["depth"] == 0)
        return F.struct(
            depth.alias("depth"),
            F.when(cut, F.lit("")).otherwise(F.concat(s["part"], c)).alias("part"),
            F.when(cut, F.concat(s["parts"], F.array(s["part"]))).otherwise(s["parts"]).alias("parts"),
        )

    folded = F.aggregate(pieces, state, step, lambda s: F.concat(s["parts"], F.array(s["part"])))
    return F.filter(F.transform(folded, lambda x: F.trim(x)), lambda x: x != "")


def ddl_columns(files: DataFrame, text: str = "content") -> DataFrame:
    """``table, ordinal, name, data_type, nullable, primary_key, auto_increment`` of CREATE TABLE statements.

    Comments go first; a statement ends at a semicolon, the column list at its last parenthesis.
    """
    bare = F.regexp_replace(F.regexp_replace(text, r"--[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    statements = files.select(F.explode(F.split(bare, ";")).alias("s"))
    head = r"(?is)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?" + _NAME + r"\s*\((.*)\)"
    tables = statements.where(F.col("s").rlike(head)).select(F.regexp_extract("s", head, 1).alias("table"), F.regexp_extract("s", head, 2).alias("body"))
    items = tables.select("table", F.posexplode(split_at_commas(F.regexp_replace("body", r"\s+", " "))).alias("_i", "item"))
    items = items.where(~F.upper("item").rlike(r"^(PRIMARY KEY|UNIQUE KEY|UNIQUE INDEX|UNIQUE \(|KEY|INDEX|CONSTRAINT|FOREIGN KEY|FULLTEXT)(\W|$)"))
    up = F.upper("item")
    return items.select(
        "table",
        (F.col("_i") + 1).cast("long").alias("ordinal"),
        F.regexp_extract("item", "^" + _NAME, 1).alias("name"),
        F.lower(F.regexp_extract("item", r"^\S+\s+(\w+(?:\([^)]*\))?)", 1)).alias("data_type"),
        (~F.contains(up, F.lit("NOT NULL")) & ~F.contains(up, F.lit("PRIMARY KEY"))).alias("nullable"),
        F.contains(up, F.lit("PRIMARY KEY")).alias("primary_key"),
        F.contains(up, F.lit("AUTO_INCREMENT")).alias("auto_increment"),
    )


def sql_literals(text: Column, limit: int = 100) -> Column:
    """Quoted strings that start with a SQL verb: at least 10 characters, cut at 500, at most ``limit``."""
    found = F.regexp_extract_all(text, F.lit(r"""(?is)["']\s*((?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\b[^"']{10,})["']"""), F.lit(1))
    return F.transform(F.slice(found, 1, limit), lambda x: F.substring(x, 1, 500))
