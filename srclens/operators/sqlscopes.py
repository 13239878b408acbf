"""Columns of SQL resolved through aliases, subqueries and common table expressions to the tables that they belong to.

A query is a table of tokens. Parentheses that hold a query of their own are nested ranges, and every verb in one begins a scope, so that the halves of a UNION and
the parts of ``INSERT ... SELECT`` are apart. A qualified column is looked up in its scope and then outwards, one step a round; a plain one belongs to the only table of its scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srclens.operators.intervals import innermost
from srclens.sources.shared import written

_TOKEN = r"""(?s)--[^\n]*|/\*.*?\*/|'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'|`[^`]*`|"[^"]*"|\d[\w.]*|[:$@]?[\p{L}_]\w*|\s+|<>|[<>!]=|\|\||."""
#: Words that are no names. Those of VERBS begin a scope.
VERBS = ("SELECT", "INSERT", "UPDATE", "DELETE", "REPLACE")
WORDS = (
    *VERBS, "FROM", "WHERE", "AND", "OR", "NOT", "IN", "ON", "JOIN", "LEFT", "RIGHT", "INNER", "OUTER", "CROSS", "FULL", "NATURAL", "GROUP", "BY", "ORDER", "HAVING", "LIMIT", "OFFSET", "AS", "DISTINCT", "ALL",
    "CASE", "WHEN", "THEN", "ELSE", "END", "NULL", "IS", "LIKE", "BETWEEN", "EXISTS", "UNION", "INTERSECT", "EXCEPT", "ASC", "DESC", "INTO", "VALUES", "SET", "WITH", "RECURSIVE", "USING", "TRUE", "FALSE", "DEFAULT", "FOR", "IGNORE",
)
#: Words after which a table stands, and those that end the list of tables after FROM.
BEFORE_TABLES = ("FROM", "JOIN", "INTO", "UPDATE")
AFTER_TABLES = ("WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "SET", "ON", "USING", "VALUES", "UNION", "INTERSECT", "EXCEPT", "SELECT")


def tokens(queries: DataFrame, key: str = "id", sql: str = "sql") -> DataFrame:
    """``key, n, offset, line, token, word``: tokens but white space and comments; ``word`` is a keyword in upper case, else null. Keys must differ."""
    breaks = F.length("_t") - F.length(F.replace("_t", F.lit("\n"), F.lit("")))
    found = queries.select(F.col(key).alias(key), F.posexplode_outer(F.regexp_extract_all(F.coalesce(F.col(sql), F.lit("")), F.lit(_TOKEN), F.lit(0))).alias("n", "_t"))
    # Outer, as else a filter on the size would read each text twice. Sums over rows: an array of places that grows by a token would be copied for every token.
    before = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sums = found.select(key, "n", "_t", F.sum(F.length("_t")).over(before).alias("_at"), F.sum(breaks).over(before).alias("_breaks"))
    up = F.upper("_t")
    out = sums.select(key, F.col("n").cast("long").alias("n"), F.coalesce("_at", F.lit(0)).cast("long").alias("offset"), (F.coalesce("_breaks", F.lit(0)) + 1).cast("long").alias("line"), F.col("_t").alias("token"), F.when(up.isin(*WORDS), up).alias("word"))
    return out.where(~F.col("token").rlike(r"^(?s:\s+|--.*|/\*.*)$"))


def _bare(name: Column) -> Column:
    return F.lower(F.when(F.substring(name, 1, 1).isin("`", '"'), F.substring(name, F.lit(2), F.length(name) - 2)).otherwise(name))


def scoped(found: DataFrame, key: str = "id") -> DataFrame:
    """Tokens with the subquery around each (``holder``, where it opens; -1 for none), their ``scope`` (the verb that began it) and what stands near them."""
    order = Window.partitionBy(key).orderBy("n")
    rows = found.withColumn("_w", F.lead("word").over(order))
    move = F.when(F.col("token") == "(", 1).when(F.col("token") == ")", -1).otherwise(0)
    rows = rows.withColumn("_depth", F.coalesce(F.sum(move).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    marks = rows.where(F.col("token").isin("(", ")")).withColumn("_level", F.col("_depth") - (F.col("token") == ")").cast("int"))
    marks = marks.withColumn("_end", F.lead("n").over(Window.partitionBy(key, "_level").orderBy("n")))
    inner = marks.where((F.col("token") == "(") & F.col("_w").isin("SELECT", "WITH")).select(key, F.col("n").alias("opens"), (F.col("n") + 1).alias("_from"), (F.col("_end") - 1).alias("_to"))
    rows = innermost(rows.drop("_w", "_depth"), inner, [key], "n", "_from", "_to", "_r").withColumn("holder", F.coalesce("_r.opens", F.lit(-1))).drop("_r")
    own = Window.partitionBy(key, "holder").orderBy("n")
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = F.col("word").isin(*VERBS) & ~((F.col("word") == "UPDATE") & F.coalesce(F.lag("word").over(own) == "FOR", F.lit(False)))
    near = [F.lag(F.struct("token", "word"), k).over(order).alias(f"b{k}") for k in (1, 2)] + [F.lead(F.struct("token", "word"), k).over(order).alias(f"a{k}") for k in (1, 2, 3, 4)]
    rows = rows.select("*", F.last(F.when(begins, F.col("n")), ignorenulls=True).over(so_far).alias("scope"), F.last(F.when(begins, F.col("word")), ignorenulls=True).over(so_far).alias("verb"), *near)
    clause = F.last(F.when(F.col("word").isin(*BEFORE_TABLES, *AFTER_TABLES), F.col("word")), ignorenulls=True).over(so_far)
    return rows.withColumn("clause", clause)


def _is_name(t: Column) -> Column:
    return F.coalesce(t["token"].rlike(r'^(?:[\p{L}_]\w*|`.*`|".*")$') & t["word"].isNull(), F.lit(False))


def table_references(rows: DataFrame, key: str = "id") -> DataFrame:
    """``key, n, scope, table, alias``: tables and subqueries that scopes read or write, ``table`` null for a subquery or a common table expression."""
    here = F.struct("token", "word")
    starts = F.col("b1.word").isin(*BEFORE_TABLES) | ((F.col("b1.token") == ",") & F.col("clause").isin("FROM", "JOIN"))
    named = rows.where(F.coalesce(starts, F.lit(False)) & _is_name(here))
    dotted = F.coalesce(F.col("a1.token") == ".", F.lit(False))
    table = F.when(dotted, F.col("a2.token")).otherwise(F.col("token"))
    after = lambda k: F.when(dotted, F.col(f"a{k + 2}")).otherwise(F.col(f"a{k}"))
    alias = F.when(F.coalesce(after(1)["word"] == "AS", F.lit(False)), after(2)["token"]).when(_is_name(after(1)), after(1)["token"]).otherwise(table)
    named = named.select(key, "n", "scope", _bare(table).alias("table"), _bare(alias).alias("alias"))
    # A subquery's alias stands after its closing parenthesis, which lies in the scope around it.
    closes = rows.where((F.col("token") == ")") & F.col("clause").isin("FROM", "JOIN"))
    derived = closes.where(_is_name(F.col("a1")) | F.coalesce(F.col("a1.word") == "AS", F.lit(False)))
    derived = derived.select(key, "n", "scope", F.lit(None).cast("string").alias("table"), _bare(F.when(F.col("a1.word") == "AS", F.col("a2.token")).otherwise(F.col("a1.token"))).alias("alias"))
    common = rows.where(_is_name(here) & (F.col("a1.word") == "AS") & (F.col("a2.token") == "(") & (F.col("b1.word").isin("WITH", "RECURSIVE") | (F.col("b1.token") == ",")) & F.col("scope").isNull())
    common = common.select(key, _bare(F.col("token")).alias("table"), F.lit(True).alias("_cte")).distinct()
    named = named.join(common, [key, "table"], "left").select(key, "n", "scope", F.when(F.col("_cte").isNull(), F.col("table")).alias("table"), "alias")
    return named.unionByName(derived).where("scope is not null")


def resolved_columns(queries: DataFrame, key: str = "id", sql: str = "sql") -> DataFrame:
    """``key, offset, line, verb, role, table, column``: every column that a query names. ``role`` is write in the list of INSERT and left of ``=`` after SET, else read.

    ``table`` is null for what subqueries and common table expressions give, for plain names where a scope has several tables or none, and for unknown qualifiers. Names of functions, aliases and ``*`` aren't columns.
    """
    rows = written(scoped(tokens(queries, key, sql), key), "sql-tokens")
    refs = written(table_references(rows, key), "sql-tables")
    here = F.struct("token", "word")
    qualified = _is_name(here) & (F.col("a1.token") == ".") & _is_name(F.col("a2"))
    last = F.coalesce(F.col("b1.token") == ".", F.lit(False))
    ends_value = _is_name(F.col("b1")) | F.coalesce(F.col("b1.token").rlike(r"^(?:\)|\d.*|'.*)$"), F.lit(False)) | F.coalesce(F.col("b1.word").isin("END", "NULL", "TRUE", "FALSE"), F.lit(False))
    is_alias = F.coalesce(F.col("b1.word") == "AS", F.lit(False)) | ends_value
    tables = refs.select(key, "n").withColumn("_is_table", F.lit(True))
    names = rows.where(_is_name(here) & F.col("scope").isNotNull()).join(tables, [key, "n"], "left").where("_is_table is null")
    plain = ~qualified & ~last & ~F.coalesce(F.col("a1.token").isin("(", "."), F.lit(False)) & ~is_alias & ~F.coalesce(F.col("clause").isin(*BEFORE_TABLES) & ~F.col("verb").isin("INSERT", "REPLACE"), F.lit(False))
    qualified = qualified & ~last & ~F.coalesce(F.col("a3.token") == "(", F.lit(False))
    given = F.when(F.col("verb").isin("INSERT", "REPLACE") & (F.col("clause") == "INTO"), "write").when((F.col("clause") == "SET") & F.when(qualified, F.col("a3.token") == "=").otherwise(F.col("a1.token") == "=") & (F.col("b1.token").isin(",") | (F.col("b1.word") == "SET")), "write").otherwise("read")
    names = names.where(plain | qualified).select(
        key, "n", "offset", "line", "verb", "scope", "holder", F.coalesce(given, F.lit("read")).alias("role"), F.when(qualified, _bare(F.col("token"))).alias("qualifier"), _bare(F.when(qualified, F.col("a2.token")).otherwise(F.col("token"))).alias("column")
    )
    # A plain name that the scope gives to a value is that value.
    values = rows.where(_is_name(here) & is_alias & ~F.coalesce(F.col("clause").isin(*BEFORE_TABLES), F.lit(False))).select(key, "scope", _bare(F.col("token")).alias("column")).distinct().withColumn("_value", F.lit(True))
    single = refs.groupBy(key, "scope").agg(F.when(F.count("*") == 1, F.max("table")).alias("table"))
    bare = names.where("qualifier is null").join(values, [key, "scope", "column"], "left").where("_value is null").join(single, [key, "scope"], "left")
    bare = bare.select(key, "offset", "line", "verb", "role", "table", "column")
    # Scopes are left through the parenthesis that opens their subquery.
    outward = rows.where("token = '('").select(key, F.col("n").alias("holder"), F.col("scope").alias("_up"), F.col("holder").alias("_holder"))
    by_alias = refs.groupBy(key, "scope", F.col("alias").alias("qualifier")).agg(F.max("table").alias("table")).withColumn("_known", F.lit(True))
    open_, done = written(names.where("qualifier is not null"), "sql-open"), []
    while True:
        tried = written(open_.join(by_alias, [key, "scope", "qualifier"], "left"), "sql-tried")
        done.append(tried.where("_known is not null or holder < 0"))
        left = tried.where("_known is null and holder >= 0").drop("table", "_known")
        if left.isEmpty():
            break
        open_ = left.join(outward, [key, "holder"]).select(*[c for c in left.columns if c not in ("scope", "holder")], F.col("_up").alias("scope"), F.col("_holder").alias("holder"))
    for df in done:
        bare = bare.unionByName(df.select(key, "offset", "line", "verb", "role", "table", "column"))
    return bare
