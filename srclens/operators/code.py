"""Structure of code files: functions, classes, parameters, literals and return shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srclens.functions.conditions import ladder
from srclens.operators import lexer
from srclens.operators.lines import complexity
from srclens.operators.sqltext import split_at_commas
from srclens.sources.shared import written

#: The decision patterns that count towards cyclomatic complexity, without case.
DECISIONS = (
    r"(?i)\bif\s*\(",
    r"(?i)\belseif\s*\(",
    r"(?i)\belse\s+if\s*\(",
    r"(?i)\bfor\s*\(",
    r"(?i)\bforeach\s*\(",
    r"(?i)\bwhile\s*\(",
    r"(?i)\bcase\s+",
    r"(?i)\bcatch\s*\(",
    r"(?i)\b\?\s*",
    r"(?i)\?\?",
    r"(?i)\band\b|\bor\b",
    r"(?i)&&|\|\|",
)
#: What may stand before ``function``.
MODIFIERS = ("public", "protected", "private", "static", "abstract", "final")


def token_table(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Code tokens of files with their depth (:mod:`lexer`), written once for what reads them more than once."""
    return written(_deep_tokens(files, path, content), "tokens")


def _deep_tokens(files: DataFrame, path: str, content: str) -> DataFrame:
    return lexer.with_depth(lexer.code_tokens(lexer.tokens(files, path, content)))


def before_heads() -> list[Column]:
    """What :func:`heads` reads of the tokens before a parenthesis."""
    by = Window.partitionBy("path").orderBy("pos")
    back = lambda c, n: F.collect_list(c).over(by.rowsBetween(-n, -1)).alias(f"_{c}s")
    return [back("token", 6), back("pos", 3), back("line", 3), F.lag("kind", 1).over(by).alias("_kind1")]


def heads() -> Column:
    """``struct<name, is_static, starts, line_start>`` at the parenthesis after ``function [&] [name]``, null at other tokens."""
    back = lambda c, k: F.get(f"_{c}s", F.size(f"_{c}s") - k)
    word = lambda k: F.lower(back("token", k)) == "function"
    name_before = F.col("_kind1") == "name"
    # Tokens from the keyword to the parenthesis.
    after = F.when(word(1), 1).when(word(2) & (name_before | (back("token", 1) == "&")), 2).when(word(3) & (back("token", 2) == "&") & name_before, 3)
    after = F.when((F.col("kind") == "mark") & (F.col("token") == "("), after)
    named = F.col("_kind1").eqNullSafe("name") & (after > 1)
    earlier = F.slice(F.reverse("_tokens"), after + 1, F.lit(3))
    modifier = F.transform(earlier, lambda t: F.coalesce(F.lower(t).isin(*MODIFIERS), F.lit(False)))
    is_static = F.exists(F.sequence(F.lit(1), F.lit(3)), lambda i: (F.lower(F.get(earlier, i - 1)) == "static") & F.forall(F.slice(modifier, F.lit(1), i), lambda x: x))
    return F.when(after.isNotNull(), F.struct(F.when(named, back("token", 1)).alias("name"), F.coalesce(is_static, F.lit(False)).alias("is_static"), back("pos", after).alias("starts"), back("line", after).alias("line_start")))


def function_ranges(tokens: DataFrame) -> DataFrame:
    """``path, name, is_static, starts, line_start, opens, closes, body_opens, ends, line_end``: functions by the places of
    their keyword, parentheses and braces; the last three are null without a body, the name is null if there is none.

    On the level of its parentheses a function's brackets go ``( ) { }``; without a body ``;`` comes third, and a nameless one may have ``use ( )`` in between.
    """
    rows = tokens.select("path", "pos", "line", "token", "kind", "depth", *before_heads()).where((F.col("kind") == "mark") & F.col("token").isin(*lexer.OPENING, *lexer.CLOSING, ";"))
    return ranges_of(rows.select("path", "pos", "line", "token", "depth", heads().alias("_f")))


def ranges_of(rows: DataFrame) -> DataFrame:
    """:func:`function_ranges` of brackets and semicolons with their :func:`heads` as ``_f``.

    Rows that have ``_mark``, which tells these from others, all stay, with the range at a function's parenthesis as ``_range``.
    """
    if "_mark" not in rows.columns:
        return ranges_of(rows.withColumn("_mark", F.lit(True))).where("_range is not null").select("path", "_range.*")
    level = F.when(F.col("token").isin(*lexer.CLOSING), F.col("depth") - 1).otherwise(F.col("depth"))
    on = Window.partitionBy("path", "_mark", "_level").orderBy("pos")
    marks = rows.withColumn("_level", level)
    marks = marks.select("*", *[F.lead(F.struct("token", "pos", "line"), k).over(on).alias(f"_a{k}") for k in range(1, 6)])
    brace = F.when(F.col("_a2.token") == "{", F.struct(F.col("_a2").alias("open"), F.col("_a3").alias("close"))).when(
        F.col("_f.name").isNull() & (F.col("_a2.token") == "(") & (F.col("_a4.token") == "{"), F.struct(F.col("_a4").alias("open"), F.col("_a5").alias("close"))
    )
    found = F.struct(
        "_f.*", F.col("pos").alias("opens"), F.col("_a1.pos").alias("closes"), brace["open"]["pos"].alias("body_opens"), brace["close"]["pos"].alias("ends"), brace["close"]["line"].alias("line_end")
    )
    return marks.select(*rows.columns, F.when(F.col("_f").isNotNull(), found).alias("_range"))


def slim(files: DataFrame, more: Column | None = None, columns: Sequence[Column] = (), path: str = "path", content: str = "content", **around) -> DataFrame:
    """``path, k, line, pos, t, depth, _f`` of brackets, semicolons and ``more`` tokens (those of more than one kind are told apart by what they are needed for), with ``columns``.

    ``depth`` is the brackets open before each; ``_f`` is the function's :func:`heads` at its parenthesis. It is one pass over a file's tokens (:func:`lexer.around`), and nothing is shuffled.
    """
    rows = lexer.around(files, path=path, content=content, **around)
    keyword, marks = F.lower("t") == "function", F.col("t").isin(*lexer.OPENING, *lexer.CLOSING, ";")
    near = F.when(keyword, F.struct("k", "pos", "line", "a1", "a2", "a3", "b1", "b2", "b3"))
    kept = rows.where(marks | keyword if more is None else marks | keyword | more).select("path", "k", "line", "pos", "t", near.alias("_near"), *columns)
    move = F.when(F.col("t").isin(*lexer.OPENING), 1).when(F.col("t").isin(*lexer.CLOSING), -1).otherwise(0)
    by = Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deep = kept.select("*", (F.sum(move).over(by) - move).alias("depth"), F.last("_near", ignorenulls=True).over(by).alias("_keyword")).drop("_near")
    return deep.select("*", _head_of("_keyword").alias("_f")).drop("_keyword")


def _head_of(keyword: str) -> Column:
    """:func:`heads` from the last word ``function`` with its neighbours."""
    at, low, no = lambda c: F.col(f"{keyword}.{c}"), lambda c: F.lower(F.col(f"{keyword}.{c}")), F.lit(False)
    is_name = lambda c: at(c).rlike(lexer.NAMED)
    after = F.when(F.col("t") == "(", F.col("k") - at("k"))
    head = (after == 1) | ((after == 2) & ((at("a1") == "&") | is_name("a1"))) | ((after == 3) & (at("a1") == "&") & is_name("a2"))
    modifier, static = lambda c: F.coalesce(low(c).isin(*MODIFIERS), no), lambda c: F.coalesce(low(c) == "static", no)
    is_static = modifier("b1") & (static("b1") | (modifier("b2") & (static("b2") | static("b3"))))
    name = F.when((after == 2) & is_name("a1"), at("a1")).when(after == 3, at("a2"))
    return F.when(head, F.struct(name.alias("name"), is_static.alias("is_static"), at("pos").alias("starts"), at("line").alias("line_start")))


def slim_marks(rows: DataFrame) -> DataFrame:
    """What :func:`ranges_of` reads of :func:`slim` rows."""
    return rows.where(F.col("t").isin(*lexer.OPENING, *lexer.CLOSING, ";")).withColumnRenamed("t", "token")


def functions(files: DataFrame, path: str = "path", content: str = "content", tokens: DataFrame | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """``path, name, params, is_static, line_start, line_end, line_count, cyclomatic_complexity, calls_db, body``.

    Bodies end at the brace that matches their first one, however far away; braces in strings, comments, heredocs and page text don't count. A function
    without a body, or whose brace never closes, ends on the next line by convention, and its text is that of its head. ``body`` is the text from ``function`` to the closing brace.
    """
    if ranges is None:
        ranges = ranges_of(slim_marks(slim(files, path=path, content=content))) if tokens is None else function_ranges(tokens)
    found = ranges.where("name is not null")
    per_file = found.groupBy("path").agg(F.collect_list(F.struct("name", "is_static", "starts", "line_start", "opens", "closes", "ends", "line_end")).alias("_all"))
    texts = files.select(F.col(path).alias("path"), F.col(content).alias("_text"))
    # A text's size isn't seen in the plan, so neither side may be taken for a small one.
    each = per_file.join(texts.hint("merge"), "path").select("path", "_text", F.inline("_all"))
    cut = lambda a, b: F.substring("_text", F.col(a).cast("int") + 1, (b - F.col(a)).cast("int"))
    params = F.substring("_text", F.col("opens").cast("int") + 2, (F.coalesce("closes", F.col("opens") + 1) - F.col("opens") - 1).cast("int"))
    out = each.select(
        "path", "name", split_at_commas(params).alias("params"), "is_static", "line_start", F.coalesce("line_end", F.col("line_start") + 1).alias("line_end"),
        cut("starts", F.coalesce("ends", "closes", "opens") + 1).alias("body"),
    )
    return out.select(
        "path", "name", "params", "is_static", "line_start", "line_end", (F.col("line_end") - F.col("line_start") + 1).alias("line_count"),
        complexity("body", DECISIONS).alias("cyclomatic_complexity"),
        F.col("body").rlike(r"(?i)\b(mysqli?_query|->query\s*\(|->prepare\s*\(|SELECT\s.+\sFROM\b)").alias("calls_db"), "body",
    )


def phpdoc(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, name, params map<string, string>, returns``: types of the comment block directly before a function; the last of a name wins."""
    p = r"(?s)/\*\*((?:[^*]|\*[^/])*)\*/\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(\w+)"
    zipped = F.arrays_zip(*[F.regexp_extract_all(content, F.lit(p), F.lit(i)).alias(n) for i, n in ((1, "doc"), (2, "name"))])
    each = files.select(F.col(path).alias("path"), F.inline(zipped))
    of = lambda k: F.regexp_extract_all("doc", F.lit(r"@param\s+(\S+)\s+\$(\w+)"), F.lit(k))
    pairs = F.arrays_zip(of(2).alias("name"), of(1).alias("type"))
    unique = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["name"] == x["name"]))
    return each.select("path", "name", F.map_from_entries(unique).alias("params"), F.nullif(F.regexp_extract("doc", r"@return\s+(\S+)", 1), F.lit("")).alias("returns"))


def definitions(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, kind, name``: classes, interfaces, traits and functions that start in the first column."""
    kinds = (("class", r"(?m)^\s*(?:abstract\s+|final\s+)*class\s+(\w+)"), ("interface", r"(?m)^\s*interface\s+(\w+)"), ("trait", r"(?m)^\s*trait\s+(\w+)"), ("function", r"(?m)^function\s+&?(\w+)"))
    each = lambda kind, p: F.transform(F.regexp_extract_all(content, F.lit(p), F.lit(1)), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    return files.select(F.col(path).alias("path"), F.inline(F.concat(*[each(*k) for k in kinds]))).distinct()


def classes(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, name, extends, implements``."""
    p = r"class\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([\w\s,\\]+))?"
    each = F.arrays_zip(*[F.regexp_extract_all(content, F.lit(p), F.lit(i)).alias(n) for i, n in ((1, "name"), (2, "ext"), (3, "impl"))])
    return files.select(F.col(path).alias("path"), F.inline(each)).select(
        "path", "name", F.nullif("ext", F.lit("")).alias("extends"), F.filter(F.transform(F.split("impl", ","), lambda x: F.trim(x)), lambda x: x != "").alias("implements")
    )


def singletons(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, class_name``: classes asked for by ``getInstance``, and those of the file that keep a static ``$instance``."""
    asked = F.regexp_extract_all(content, F.lit(r"([A-Za-z_]\w*)::getInstance\s*\("), F.lit(1))
    own = F.when(F.col(content).rlike(r"\bstatic\s+\$_?instance\b"), F.regexp_extract_all(content, F.lit(r"\bclass\s+(\w+)"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    named = F.filter(F.array_distinct(F.concat(asked, own)), lambda n: ~n.isin("self", "parent", "static"))
    return files.select(F.col(path).alias("path"), F.explode(named).alias("class_name"))


def superglobals(content: Column) -> Column:
    """The superglobals that a text mentions, in a fixed order."""
    names = ("$_GET", "$_POST", "$_REQUEST", "$_SESSION", "$_COOKIE", "$_FILES", "$_SERVER", "$_ENV", "$GLOBALS")
    return F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(content, n))


def request_params(content: Column) -> Column:
    """Sorted distinct keys read from GET, POST and REQUEST."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(content, F.lit(r"\$_(?:GET|POST|REQUEST)\[['\"](\w+)['\"]\]"), F.lit(1))))


def session_reads(content: Column) -> Column:
    """Session keys used but never written."""
    used = F.regexp_extract_all(content, F.lit(r"\$_SESSION\[['\"](\w+)['\"]\]"), F.lit(1))
    written = F.regexp_extract_all(content, F.lit(r"\$_SESSION\[['\"](\w+)['\"]\]\s*=[^=]"), F.lit(1))
    return F.array_sort(F.array_except(used, written))


def cookies(content: Column) -> Column:
    """Sorted distinct names of cookies that are read or set."""
    read = F.regexp_extract_all(content, F.lit(r"\$_COOKIE\[['\"](\w+)['\"]\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(read, F.regexp_extract_all(content, F.lit(r"\bsetcookie\s*\(\s*['\"](\w+)['\"]"), F.lit(1)))))


def body_fields(content: Column) -> Column:
    """Sorted distinct fields of a decoded JSON body: as array keys, as properties, or of the decoded value itself."""
    decoded = F.regexp_extract(content, r"\$(\w+)\s*=\s*json_decode\s*\(", 1)
    key = F.when(decoded != "", F.regexp_extract_all(content, F.concat(F.lit(r"\$"), decoded, F.lit(r"\[['\"](\w+)['\"]\]")), F.lit(1)))
    prop = F.when(decoded != "", F.regexp_extract_all(content, F.concat(F.lit(r"\$"), decoded, F.lit(r"->(\w+)\b")), F.lit(1)))
    direct = F.regexp_extract_all(content, F.lit(r"json_decode\s*\([^;]*\)\s*(?:->|\[['\"])(\w+)"), F.lit(1))
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(key, none), F.coalesce(prop, none), direct)))


def value_type(value: Column, key: Column) -> Column:
    """A value's type: cast, function, literal, then the key's name, a variable is mixed, else null."""
    v, k = F.trim(value), F.lower(key)
    return ladder(
        [(v.rlike(r"^\(int\)"), "int"), (v.rlike(r"^\((float|double)\)"), "float"), (v.rlike(r"^\(string\)"), "string"), (v.rlike(r"^\(bool\)"), "bool"), (v.rlike(r"^\(array\)"), "array"),
         (v.rlike(r"^(count|strlen|intval|time|sizeof)\s*\("), "int"), (v.rlike(r"^(floatval|round|number_format)\s*\("), "float"), (v.rlike(r"^(trim|implode|substr|date|sprintf|strtolower|strtoupper)\s*\("), "string"),
         (v.rlike(r"^(isset|empty|is_\w+|in_array)\s*\("), "bool"), (v.rlike(r"(?i)^(true|false)$"), "bool"), (v.rlike(r"(?i)^null$"), "null"), (v.rlike(r"^-?\d+$"), "int"), (v.rlike(r"^-?\d+\.\d+$"), "float"),
         (v.rlike(r"^['\"]"), "string"), (v.rlike(r"^(\[|array\s*\()"), "array"), (k.isin("id", "count", "total", "page", "limit", "offset"), "int"), (k.isin("price", "amount", "cost", "rate"), "float"),
         (k.isin("name", "title", "email", "description"), "string"), (v.rlike(r"^\$"), "mixed")]
    )


def literal(value: Column) -> Column:
    """A PHP literal as ``struct<kind, repr>``: null, bool, int, float, string, array, else raw."""
    v = F.trim(value)
    kind = ladder(
        [(v.rlike(r"(?i)^null$"), "null"), (v.rlike(r"(?i)^(true|false)$"), "bool"), (v.rlike(r"^-?\d+$"), "int"), (v.rlike(r"^-?\d*\.\d+$"), "float"),
         (v.rlike(r"^'[^']*'$|^\"[^\"]*\"$"), "string"), (v.rlike(r"^(\[\s*\]|array\s*\(\s*\))$"), "array")], "raw",
    )
    shown = F.when(kind == "string", F.substring(v, F.lit(2), F.length(v) - 2)).when(kind == "bool", F.lower(v)).when(kind == "array", "[]").otherwise(v)
    return F.struct(kind.alias("kind"), F.when(kind != "null", shown).alias("repr"))
