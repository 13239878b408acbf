"""Keys, options and column details of DDL, read word by word: a file is a list of words, its statements and their items are stretches of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srclens.operators.sqltext import ddl_columns

#: Comments, strings, quoted names, words and marks of SQL.
_WORD = r"""(?s)--[^\n]*|/\*.*?\*/|'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'|`[^`]*`|"[^"]*"|\[\w+\]|\w+|\S"""


def words(text: Column) -> Column:
    """The words of a text without its comments."""
    return F.filter(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), lambda w: ~F.startswith(w, F.lit("--")) & ~F.startswith(w, F.lit("/*")))


def bare(word: Column) -> Column:
    """A name or string without its quotes."""
    return F.when(F.substring(word, 1, 1).isin("`", '"', "[", "'"), F.substring(word, F.lit(2), F.length(word) - 2)).otherwise(word)


def is_word(word: Column, *any_of: str) -> Column:
    return F.coalesce(F.upper(word).isin(*any_of), F.lit(False))


def place(ws: Column, word: str) -> Column:
    """Where a keyword first stands, from 1; 0 if nowhere."""
    return F.coalesce(F.array_position(F.transform(ws, F.upper), word), F.lit(0)).cast("int")


def after(ws: Column, at: Column) -> Column:
    """What follows the word at a place."""
    return F.slice(ws, at + 1, F.greatest(F.size(ws) - at, F.lit(0)))


def depths(ws: Column) -> Column:
    """The parentheses open before each word, a closing one counted as closed."""
    state = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, w: Column) -> Column:
        at = a["n"] - (w == ")").cast("int")
        return F.struct((at + (w == "(").cast("int")).alias("n"), F.concat(a["out"], F.array(at)).alias("out"))

    return F.aggregate(ws, state, step)["out"]


def parts(ws: Column, mark: str) -> Column:
    """Stretches of words between marks outside of parentheses; empty ones are dropped."""
    state = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("part"), F.array().cast("array<array<string>>").alias("out"))

    def step(a: Column, w: Column) -> Column:
        cut = (w == mark) & (a["n"] == 0)
        return F.struct(
            (a["n"] + (w == "(").cast("int") - (w == ")").cast("int")).alias("n"),
            F.when(cut, F.array().cast("array<string>")).otherwise(F.concat(a["part"], F.array(w))).alias("part"),
            F.when(cut, F.concat(a["out"], F.array(a["part"]))).otherwise(a["out"]).alias("out"),
        )

    folded = F.aggregate(ws, state, step, lambda a: F.concat(a["out"], F.array(a["part"])))
    return F.filter(folded, lambda x: F.size(x) > 0)


def group(ws: Column) -> Column:
    """What the first parentheses hold, their own left out."""
    depth = depths(ws)
    start = F.array_position(ws, "(").cast("int")
    end = F.array_position(F.transform(F.arrays_zip(ws.alias("w"), depth.alias("d")), lambda x, i: (x["w"] == ")") & (x["d"] == 0) & (i >= start)), True).cast("int")
    return F.when((start > 0) & (end > start), F.slice(ws, start + 1, end - start - 1)).otherwise(F.array().cast("array<string>"))


def names(ws: Column) -> Column:
    """The names in a list, without prefix lengths and orders."""
    return F.transform(parts(ws, ","), lambda x: bare(F.get(x, F.lit(0))))


def statements(files: DataFrame, text: str = "content") -> DataFrame:
    """``ws``: the words of each statement."""
    return files.select(F.explode(parts(words(F.col(text)), ";")).alias("ws"))


def _named_table(ws: Column) -> Column:
    """Where the name of the table of a statement stands, the last part of a dotted one."""
    at = place(ws, "TABLE") + 1
    at = at + F.when(is_word(F.get(ws, at - 1), "IF"), F.when(is_word(F.get(ws, at), "NOT"), 3).otherwise(2)).otherwise(0)
    return at + F.when(F.get(ws, at) == ".", 2).otherwise(0)


def created(files: DataFrame, text: str = "content") -> DataFrame:
    """``table, ws``: CREATE TABLE statements from their list of columns on."""
    found = statements(files, text).where(is_word(F.get("ws", F.lit(0)), "CREATE") & place(F.col("ws"), "TABLE").between(2, 4))
    at = _named_table(F.col("ws"))
    return found.select(bare(F.get("ws", at - 1)).alias("table"), after(F.col("ws"), at).alias("ws")).where(F.get("ws", F.lit(0)) == "(")


def items(files: DataFrame, text: str = "content") -> DataFrame:
    """``table, position, ws``: the parts of CREATE TABLE statements at commas outside parentheses."""
    return created(files, text).select("table", F.posexplode(parts(group(F.col("ws")), ",")).alias("position", "ws"))


def _value(ws: Column, *keywords: str) -> Column:
    """What is given for the last of ``keywords``, which follow each other, with or without ``=``."""
    upper = F.transform(ws, F.upper)
    here = lambda i: F.forall(F.array(*[F.get(upper, i + k).eqNullSafe(F.lit(w)) for k, w in enumerate(keywords)]), lambda x: x)
    at = F.coalesce(F.array_position(F.transform(upper, lambda _, i: here(i)), True), F.lit(0))
    rest = after(ws, (at + len(keywords) - 1).cast("int"))
    rest = F.when(F.get(rest, F.lit(0)) == "=", after(rest, F.lit(1))).otherwise(rest)
    return F.when(at > 0, bare(F.get(rest, F.lit(0))))


def table_options(files: DataFrame, text: str = "content") -> DataFrame:
    """``table, engine, charset`` of CREATE TABLE statements; null where the statement says none."""
    found = created(files, text)
    tail = after(F.col("ws"), F.size(group(F.col("ws"))) + 2)
    found = found.select("table", tail.alias("ws"))
    return found.select("table", _value(F.col("ws"), "ENGINE").alias("engine"), F.coalesce(_value(F.col("ws"), "CHARSET"), _value(F.col("ws"), "CHARACTER", "SET")).alias("charset"))


def column_details(files: DataFrame, text: str = "content") -> DataFrame:
    """:func:`ddl_columns` with ``length`` (of a type in parentheses) and ``default`` without quotes."""
    columns = ddl_columns(files, text)
    own = items(files, text).select("table", (F.col("position") + 1).cast("long").alias("ordinal"), F.when(place(F.col("ws"), "DEFAULT") > 0, after(F.col("ws"), place(F.col("ws"), "DEFAULT"))).alias("ws"))
    first, second = F.get("ws", F.lit(0)), F.get("ws", F.lit(1))
    value = F.when(first == "-", F.concat(first, second)).when((second == "(") & ~F.startswith(first, F.lit("'")), F.concat(first, F.lit("("), F.array_join(group(F.col("ws")), ","), F.lit(")"))).otherwise(bare(first))
    return columns.join(own, ["table", "ordinal"]).select(*columns.columns, F.regexp_extract("data_type", r"\((\d+)\)", 1).try_cast("long").alias("length"), F.nullif(value, F.lit("")).alias("default"))


def _constraint(ws: Column) -> Column:
    """An item after its ``CONSTRAINT name``."""
    return F.when(is_word(F.get(ws, F.lit(0)), "CONSTRAINT"), after(ws, F.when(is_word(F.get(ws, F.lit(1)), "FOREIGN", "UNIQUE", "PRIMARY"), 1).otherwise(2))).otherwise(ws)


def indexes(files: DataFrame, text: str = "content") -> DataFrame:
    """``table, name, columns, is_unique``: named ``idx_<table>_<n>`` where the statement gives no name; the primary key is ``PRIMARY``."""
    own = items(files, text).withColumn("ws", _constraint(F.col("ws")))
    first, second = F.get("ws", F.lit(0)), F.get("ws", F.lit(1))
    unique = is_word(first, "UNIQUE")
    at = F.when(is_word(first, "KEY", "INDEX"), 1).when(unique, F.when(is_word(second, "KEY", "INDEX"), 2).otherwise(1))
    found = own.withColumn("_at", at).where("_at is not null").withColumn("_next", F.get("ws", F.col("_at"))).where((F.col("_next") == "(") | (F.get("ws", F.col("_at") + 1) == "("))
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("table").orderBy("position")) - 1)
    name = F.when(F.col("_next") != "(", bare(F.col("_next"))).otherwise(F.concat(F.lit("idx_"), "table", F.lit("_"), F.col("n").cast("string")))
    found = found.select("table", name.alias("name"), names(group(F.col("ws"))).alias("columns"), unique.alias("is_unique"))
    keys = own.where(is_word(first, "PRIMARY") & is_word(second, "KEY")).select("table", F.lit("PRIMARY").alias("name"), names(group(F.col("ws"))).alias("columns"), F.lit(True).alias("is_unique"))
    return found.unionByName(keys)


def foreign_keys(files: DataFrame, text: str = "content") -> DataFrame:
    """``table, name, columns, ref_table, ref_columns, on_delete, on_update`` of CREATE TABLE and of ALTER TABLE on tables that are created.

    The default name is ``fk_<table>_<referenced table>``, the default action NO ACTION.
    """
    inside = items(files, text).select("table", "ws")
    known = inside.select("table").distinct()
    altered = statements(files, text).where(is_word(F.get("ws", F.lit(0)), "ALTER") & is_word(F.get("ws", F.lit(1)), "TABLE"))
    at = _named_table(F.col("ws"))
    altered = altered.select(bare(F.get("ws", at - 1)).alias("table"), F.explode(parts(after(F.col("ws"), at), ",")).alias("ws"))
    altered = altered.where(is_word(F.get("ws", F.lit(0)), "ADD")).select("table", after(F.col("ws"), F.lit(1)).alias("ws")).join(known, "table", "left_semi")
    found = inside.unionByName(altered).where((place(F.col("ws"), "FOREIGN") > 0) & (place(F.col("ws"), "REFERENCES") > 0))
    given = F.when(is_word(F.get("ws", F.lit(0)), "CONSTRAINT") & ~is_word(F.get("ws", F.lit(1)), "FOREIGN"), bare(F.get("ws", F.lit(1))))
    found = found.select("table", given.alias("given"), group(after(F.col("ws"), place(F.col("ws"), "FOREIGN"))).alias("own"), after(F.col("ws"), place(F.col("ws"), "REFERENCES")).alias("ws"))
    dotted = F.get("ws", F.lit(1)) == "."
    found = found.withColumn("ws", F.when(dotted, after(F.col("ws"), F.lit(2))).otherwise(F.col("ws")))
    found = found.withColumn("ref_table", bare(F.get("ws", F.lit(0)))).withColumn("tail", after(F.col("ws"), F.size(group(F.col("ws"))) + 3))

    def action(event: str) -> Column:
        upper = F.transform("tail", F.upper)
        at = F.array_position(F.transform(upper, lambda w, i: (w == "ON") & (F.get(upper, i + 1) == event)), True).cast("int")
        one, two = F.get(upper, at + 1), F.get(upper, at + 2)
        return F.when(at > 0, F.when(one.isin("SET", "NO"), F.concat_ws(" ", one, two)).otherwise(one)).otherwise("NO ACTION")

    return found.select(
        "table", F.coalesce("given", F.concat(F.lit("fk_"), "table", F.lit("_"), "ref_table")).alias("name"), names(F.col("own")).alias("columns"),
        "ref_table", names(group(F.col("ws"))).alias("ref_columns"), F.coalesce(action("DELETE"), F.lit("NO ACTION")).alias("on_delete"), F.coalesce(action("UPDATE"), F.lit("NO ACTION")).alias("on_update"),
    )
