"""PHP files: findings of the default rules, file metrics, request contracts, uploads and signatures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srclens.functions import rule_sets
from srclens.functions.conditions import ladder
from srclens.operators import code, lines, scan
from srclens.operators.scan import Rule


#: Parts of file names that raise and lower the entry score, and those of include files.
ENTRY_NAMES = ("index", "main", "home", "login", "register")
INCLUDE_NAMES = ("include", "inc", "lib", "func", "class", "config")
INCLUDE_STEMS = ("inc", "include", "lib", "class", "func", "config", "init", "bootstrap")


def findings(files: DataFrame, rules: Sequence[Rule] = rule_sets.ALL, path: str = "path", content: str = "content") -> DataFrame:
    """``path, rule_id, family, type, severity, line, snippet`` of all rules."""
    inside = [r for r in rules if not r.multiline]
    across = [r for r in rules if r.multiline]
    cols = [path, "rule_id", "family", "type", "severity", "line", "snippet"]
    out = []
    if inside:
        out.append(scan.scan_lines(files, inside, path, content).select(*cols))
    if across:
        out.append(scan.scan_texts(files, across, path, content).select(path, "rule_id", "family", "type", "severity", F.col("line").cast("long").alias("line"), "snippet"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def with_lock_and_rollback(found: DataFrame, path: str = "path") -> DataFrame:
    """Transaction findings with whether their file rolls back."""
    return scan.with_flag_from(found.where("family = 'transaction'"), F.col("type") == "rollback", "has_rollback", path)


def pagination(found: DataFrame, path: str = "path") -> DataFrame:
    """Pagination findings merged by line; any sort in a file marks all of its findings."""
    own = found.where("family = 'pagination'")
    sorts = own.where("type = 'sort'").select(path).distinct().withColumn("has_sort", F.lit(True))
    merged = scan.merge_by_line(own.where("type <> 'sort'"), path)
    return merged.join(sorts, path, "left").withColumn("has_sort", F.coalesce("has_sort", F.lit(False)))


def transactions(found: DataFrame, path: str = "path") -> DataFrame:
    """Transaction findings with ``lock_type`` (null for those that don't lock) and whether their file rolls back."""
    kinds = (("for\\s+update", "row"), ("share", "share"), ("tables?", "table"), ("get_lock", "named"), ("flock", "file"), ("sem_acquire", "semaphore"))
    lock = F.when(F.col("type") == "lock", ladder([(F.col("snippet").rlike(f"(?i){p}"), kind) for p, kind in kinds]))
    return with_lock_and_rollback(found, path).withColumn("lock_type", lock)


def events(found: DataFrame) -> DataFrame:
    """Event findings with ``name`` (unknown if none is given) and ``is_producer``."""
    own = found.where("family = 'event'")
    name = F.when(F.col("snippet").rlike(r"^[\w.:/-]+$"), F.col("snippet")).otherwise("unknown")
    return own.withColumn("name", name).withColumn("is_producer", F.col("type").isin(*rule_sets.PRODUCERS))


def http_codes(found: DataFrame, path: str = "path") -> DataFrame:
    """``path, codes``: the sorted distinct HTTP codes that a file answers with."""
    own = found.where((F.col("type") == "http_code") & F.col("snippet").rlike(r"^\d{3}$"))
    return own.groupBy(path).agg(F.array_sort(F.collect_set(F.col("snippet").cast("int"))).alias("codes"))


def rate_limits(found: DataFrame) -> DataFrame:
    """Rate limit findings with ``limit_value`` and ``window_seconds``, integers or null."""
    number = F.regexp_extract("snippet", r"^(\d+)$", 1).try_cast("long")
    own = found.where("family = 'rate_limit'")
    return own.withColumn("limit_value", F.when(F.col("type") == "counter", number)).withColumn("window_seconds", F.when(F.col("type") == "window", number))


def roles(found: DataFrame, path: str = "path") -> DataFrame:
    """``path, roles map<string, array<string>>``: the roles that a file checks, and all permissions under ``default``."""
    own = found.where("type in ('role', 'permission') and snippet rlike '^[A-Za-z][A-Za-z0-9_.]*$'")
    of = lambda t: F.array_sort(F.collect_set(F.when(F.col("type") == t, F.col("snippet"))))
    both = own.groupBy(path).agg(of("role").alias("r"), of("permission").alias("p"))
    empty = F.array().cast("array<string>")
    entries = F.concat(
        F.transform(F.filter("r", lambda x: x != "default"), lambda x: F.struct(x.alias("key"), empty.alias("value"))),
        F.when(F.size("p") > 0, F.array(F.struct(F.lit("default").alias("key"), F.col("p").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:array<string>>>")),
    )
    return both.select(path, F.map_from_entries(entries).alias("roles"))


def log_levels(found: DataFrame) -> DataFrame:
    """Logging findings with ``level`` and ``has_context`` (a variable in the call)."""
    own = found.where("family = 'logging'")
    level = F.coalesce(F.nullif(F.lower(F.regexp_extract("snippet", r"(?i)\b(emergency|alert|critical|error|warning|notice|info|debug)\b", 1)), F.lit("")), F.lit("info"))
    return own.withColumn("level", F.when(F.col("type") == "error_log", "error").otherwise(level)).withColumn("has_context", F.contains("snippet", F.lit("$")))


def config_values(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, line, kind, name, value``: configured names with their values without quotes."""
    at = scan.text_lines(files, path, content)

    def hits(kind: str, pattern: str) -> Column:
        names, values = (F.regexp_extract_all("content", F.lit(pattern), F.lit(k)) for k in (1, 2))
        plain = lambda v: F.regexp_replace(F.trim(v), r"^['\"]|['\"]$", "")
        return F.transform(F.arrays_zip(names.alias("n"), values.alias("v")), lambda x: F.struct(F.lit(kind).alias("kind"), x["n"].alias("name"), plain(x["v"]).alias("value")))

    return at.select(path, "line", F.inline(F.concat(*[hits(*c) for c in rule_sets.CONFIG_VALUES])))


def with_advice(found: DataFrame) -> DataFrame:
    """Security findings with ``description`` and ``recommendation`` of their type."""
    pick = lambda k: ladder([(F.col("type") == t, v[k]) for t, v in rule_sets.ADVICE.items()])
    return found.where("family = 'security'").withColumn("description", pick(0)).withColumn("recommendation", pick(1))


def cache_ttl(content: Column, key: Column) -> Column:
    """The first number after a comma within 200 characters of a cache key, as an integer."""
    near = F.substring(content, F.instr(content, key), F.lit(200))
    return F.nullif(F.regexp_extract(near, r",\s*(\d+)", 1), F.lit("")).try_cast("long")


def file_metrics(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Lines in and outside PHP, complexity and entry score of each file."""
    tagged = scan.text_lines(files, path, content)
    opens, closes = F.col("content").rlike(r"<\?php|<\?="), F.contains("content", F.lit("?>"))
    state = lines.running_state(tagged, path, "line", opens, closes, "in_php")
    comment = F.col("content").rlike(r"^\s*(//|#|/\*|\*)")
    counts = state.groupBy(path).agg(
        F.count("*").alias("total_lines"),
        F.count_if((F.col("in_php") | opens) & ~comment).alias("php_lines"),
        F.count_if(~F.col("in_php") & ~opens & F.col("content").rlike("<[a-zA-Z/]")).alias("html_lines"),
    )
    text = F.col(content)
    own = files.select(
        path, lines.complexity(content, code.DECISIONS).alias("cyclomatic_complexity"), F.regexp_count(content, F.lit(r"\bfunction\s+\w+")).cast("long").alias("n_functions"),
        *[F.contains(text, F.lit(f"$_{n}")).alias(f"_{n}") for n in ("GET", "POST", "REQUEST", "SESSION")], F.startswith(F.ltrim(text), F.lit("<?")).alias("_opens"),
        F.contains(text, F.lit("header(")).alias("_header"), text.rlike("|".join(f"(?:{p})" for _, p in rule_sets.OUTPUT_POINTS)).alias("_output"),
    )
    joined = counts.join(own, path)
    name = F.lower(F.substring_index(path, "/", -1))
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(name, w))
    score = lines.additive_score(
        [(F.col("_GET"), 2), (F.col("_POST"), 2), (F.col("_REQUEST"), 1.5), (F.col("html_lines") > 5, 1), (F.col("_SESSION"), 0.5), (F.col("_opens"), 0.5), (F.col("_header"), 1),
         (~F.col("_output") & (F.col("n_functions") > 3), -2), (has(ENTRY_NAMES), 1.5), (has(INCLUDE_NAMES), -2)]
    )
    joined = joined.withColumn("entry_score", score).drop(*[f"_{n}" for n in ("GET", "POST", "REQUEST", "SESSION", "opens", "header", "output")])
    return joined.withColumn("is_mixed", (F.col("php_lines") > 10) & (F.col("html_lines") > 10)).withColumn("class", lines.entry_class(F.col("entry_score"), F.col("n_functions")))


def is_include_file(path: Column, content: Column) -> Column:
    """Named like an include, or one that only declares: nothing is printed, no page text stands in it and no request is read.

    Strings and comments don't count.
    """
    stem = F.lower(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""))
    named = F.exists(F.array(*[F.lit(w) for w in INCLUDE_STEMS]), lambda w: F.contains(stem, w))
    code_only = F.regexp_replace(content, r"(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+'|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|/\*.*?\*/|(?://|#)[^\n]*", " ")
    word = lambda *names: rf"(?i)(?<![\w$])(?:{'|'.join(names)})(?!\w)"

    def declares(c: Column) -> Column:
        page = F.regexp_replace(c, r"(?s)<\?.*?(?:\?>|\z)", "")
        silent = ~c.rlike(word("echo", "print", "printf", "vprintf", "readfile")) & ~F.contains(c, F.lit("<?=")) & (F.trim(page) == "")
        return c.rlike(word("function", "class", "interface", "trait")) & ~c.rlike(r"(?i)\$_(?:get|post|request)(?!\w)") & silent

    return named | F.get(F.transform(F.array(code_only), declares), F.lit(0))  # a lambda's variable is found once


def api_info(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, methods, content_type, headers``: methods that are checked, else inferred, else GET."""
    text = F.col(content)
    checked = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"REQUEST_METHOD['\"]\]\s*={2,3}\s*['\"](\w+)['\"]"), F.lit(1))))
    inferred = F.filter(F.array(F.when(text.rlike(r"\$_GET\b"), F.lit("GET")), F.when(text.rlike(r"\$_POST\b|php://input"), F.lit("POST"))), lambda x: x.isNotNull())
    methods = F.when(F.size(checked) > 0, checked).when(F.size(inferred) > 0, inferred).otherwise(F.array(F.lit("GET")))
    kind = ladder([(text.rlike(r"application/json|json_encode\s*\("), "json"), (text.rlike("application/xml|text/xml"), "xml"), (text.rlike("<html|<body|<div"), "html")], "text")
    headers = F.slice(F.regexp_extract_all(text, F.lit(r"\bheader\s*\(\s*['\"]([^'\"]+)"), F.lit(1)), 1, 20)
    return files.select(path, methods.alias("methods"), kind.alias("content_type"), headers.alias("headers"))


#: A read of a parameter, what may stand directly before it, and its default, which is only looked at, as it may hold the next read.
_READ = r"\$_(?:GET|POST|REQUEST)\[['\"](\w+)['\"]\]"
_BEFORE = r"(?=[($ief])(?:(\((?:int|float|bool|array)\)|(?:intval|floatval|is_array)\s*\(|(?:isset|empty)\s*\()\s*+)?"
_DEFAULT = r"(?:(?=\s*\?\?\s*([^;,)]+))|)"


def request_contract(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, param, type, required, default`` of every parameter that a file reads.

    A text is searched by constant patterns, once for all of its parameters. A direct use
    makes one required; isset, empty or a default alone don't.
    """
    found = (("before", _BEFORE + _READ, 1), ("param", _READ, 1), ("default", _READ + _DEFAULT, 2))  # the same reads each time
    reads = files.select(path, F.arrays_zip(*[F.regexp_extract_all(F.col(content), F.lit(p), F.lit(i)).alias(n) for n, p, i in found]).alias("_reads"))
    each = reads.select(path, "_reads", F.explode(F.array_sort(F.array_distinct(F.col("_reads.param")))).alias("param"))
    own = each.select(path, "param", F.filter("_reads", lambda x: x["param"] == F.col("param")).alias("_own"))
    words = F.array_distinct(F.transform("_own.before", lambda x: F.regexp_extract(x, r"\w+", 0)))
    facts = own.select(path, "param", words.alias("_b"), F.get(F.filter("_own.default", lambda x: x != ""), F.lit(0)).alias("_d"))
    has = lambda *names: F.arrays_overlap("_b", F.array(*[F.lit(n) for n in names]))
    type_ = ladder(
        [(has("int", "intval"), "int"), (has("float", "floatval"), "float"), (has("bool"), "bool"), (has("array", "is_array"), "array"),
         (F.col("param").rlike(r"(^|_)(id|page|limit|offset|count)$"), "int"), (F.col("param").rlike("email|name|title|search|query"), "string")], "string",
    )
    return facts.select(path, "param", type_.alias("type"), (~has("isset", "empty")).alias("required"), code.literal(F.col("_d")).alias("default"))


def uploads(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, field, checks_type, checks_size, storage, max_size, types`` of every distinct upload field.

    ``max_size`` is the number, or the product of numbers, that the field's size is compared with, the first of several; ``types`` are the quoted types that its
    type is compared with or looked up in, sorted.
    """
    fields = F.array_distinct(F.regexp_extract_all(content, F.lit(r"\$_FILES\[['\"](\w+)['\"]\]"), F.lit(1)))
    each = files.select(path, F.col(content).alias("_c"), F.explode(fields).alias("field"))
    at = lambda key, more="": F.concat(F.lit(r"\$_FILES\[['\"]"), F.col("field"), F.lit(rf"['\"]\]\[['\"]{key}['\"]\]{more}"))
    of = lambda key: F.regexp_like("_c", at(key))
    first = lambda pattern: F.call_function("regexp_extract", F.col("_c"), pattern, F.lit(1))
    storage = F.nullif(F.regexp_extract("_c", r"move_uploaded_file\s*\([^,]+,\s*['\"]?([^'\";)]+)", 1), F.lit(""))
    factors = F.regexp_extract_all(first(at("size", r"\s*(?:>=?|<=?)\s*(\d+(?:\s*\*\s*\d+)*)")), F.lit(r"\d+"), F.lit(0))
    size = F.when(F.size(factors) > 0, F.aggregate(factors, F.lit(1).cast("long"), lambda a, x: a * x.cast("long")))
    listed = first(F.concat(F.lit(r"in_array\s*\(\s*"), at("type", r"\s*,\s*(?:\[|array\s*\()([^\])]*)")))
    compared = F.regexp_extract_all("_c", at("type", r"\s*[!=]=+\s*['\"]([\w./+-]+)['\"]"), F.lit(1))
    types = F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(listed, F.lit(r"['\"]([\w./+-]+)['\"]"), F.lit(1)), compared)))
    return each.select(path, "field", of("type").alias("checks_type"), of("size").alias("checks_size"), storage.alias("storage"), size.alias("max_size"), types.alias("types"))


def parameters(functions: DataFrame) -> DataFrame:
    """``path, name, position, param, type_hint, by_reference, is_optional, default`` of functions' parameters."""
    each = functions.select("path", "name", F.posexplode("params").alias("_i", "p"))
    p = F.col("p")
    return each.select(
        "path", "name", (F.col("_i") + 1).cast("long").alias("position"), F.regexp_extract(p, r"\$(\w+)", 1).alias("param"),
        F.nullif(F.regexp_extract(p, r"^\s*(\??[\w\\|]+)\s+[&.]*\$", 1), F.lit("")).alias("type_hint"), p.rlike(r"&\s*\$").alias("by_reference"),
        F.contains(p, F.lit("=")).alias("is_optional"), F.nullif(F.trim(F.regexp_extract(p, r"=\s*(.*)$", 1)), F.lit("")).alias("default"),
    )


def with_doc_types(parameters: DataFrame, docs: DataFrame) -> DataFrame:
    """Parameters with ``type``: the hint, else the type in the comment block of their function (:func:`code.phpdoc`)."""
    known = docs.select(F.col("path").alias("_p"), F.col("name").alias("_n"), F.explode("params").alias("_param", "_type")).dropDuplicates(["_p", "_n", "_param"])
    out = parameters.join(known, (F.col("path") == F.col("_p")) & (F.col("name") == F.col("_n")) & (F.col("param") == F.col("_param")), "left")
    return out.withColumn("type", F.coalesce("type_hint", "_type")).drop("_p", "_n", "_param", "_type")


def returns(functions: DataFrame, fields: DataFrame) -> DataFrame:
    """``path, name, types, nullable, keys``: distinct inferred types of the returned values in order of the code, and the keys of returned arrays on their first level.

    ``fields`` is :func:`shapes.return_fields` of the same files.
    """
    values = F.regexp_extract_all("body", F.lit(r"\breturn\s+([^;]+);"), F.lit(1))
    types = F.filter(F.array_distinct(F.transform(values, lambda v: F.coalesce(code.value_type(v, F.lit("")), F.lit("mixed")))), lambda x: x.isNotNull())
    typed = functions.select("path", "name", "line_start", F.filter(types, lambda x: x != "null").alias("types"), F.array_contains(types, "null").alias("nullable"))
    out = typed.join(_first_keys(fields), ["path", "name", "line_start"], "left")
    return out.select("path", "name", "types", "nullable", F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))


def _first_keys(fields: DataFrame) -> DataFrame:
    first = fields.groupBy("path", "name", "line_start", F.get("keys", F.lit(0)).alias("key")).agg(F.min("pos").alias("pos"))
    keys = F.transform(F.sort_array(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"])
    return first.groupBy("path", "name", "line_start").agg(keys.alias("keys"))


#: What a body does when it fails: kind, pattern, whether every place counts or only that there is one.
FAILURES = (
    ("exit", r"(?i)\b(?:die|exit)\b", True), ("throw", r"(?i)\bthrow\b", True), ("trigger", r"(?i)\btrigger_error\s*\(", True),
    ("return_false", r"(?i)\breturn\s+false\s*;", False), ("return_null", r"(?i)\breturn\s+null\s*;", False),
)
#: What a body changes beside its result, told once for each kind.
EFFECTS = (
    ("session", r"\$_SESSION\s*\[[^\]]*\]\s*(?:\[[^\]]*\]\s*)*(?:[-+.*/]|\?\?)?=[^=>]"), ("global", r"(?i)\bglobal\s+\$\w+|\$GLOBALS\s*\[[^\]]*\]\s*=[^=>]"), ("cookie", r"(?i)\bset(?:raw)?cookie\s*\("),
    ("file_write", r"(?i)\b(?:file_put_contents|fwrite|fputs|fputcsv)\s*\("), ("file_delete", r"(?i)\b(?:unlink|rmdir)\s*\("), ("file_move", r"(?i)\b(?:rename|copy|move_uploaded_file)\s*\("), ("folder", r"(?i)\bmkdir\s*\("),
)


def without_strings(text: Column) -> Column:
    """Code with its strings and comments blanked."""
    return F.regexp_replace(text, r"(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+'|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|/\*.*?\*/|(?://|#(?!\[))[^\n]*", " ")


def failures(functions: DataFrame) -> DataFrame:
    """``path, name, line_start, kind, n`` of FAILURES in functions' bodies; strings and comments don't count."""
    bare = functions.select("path", "name", "line_start", without_strings(F.col("body")).alias("_b"))
    n = lambda p, every: F.regexp_count("_b", F.lit(p)).cast("long") if every else F.col("_b").rlike(p).cast("long")
    found = F.array(*[F.struct(F.lit(k).alias("kind"), n(p, every).alias("n")) for k, p, every in FAILURES])
    return bare.select("path", "name", "line_start", F.inline(found)).where("n > 0")


def effects(functions: DataFrame) -> DataFrame:
    """``path, name, line_start, kind`` of EFFECTS, one row for each kind that a body has."""
    bare = functions.select("path", "name", "line_start", without_strings(F.col("body")).alias("_b"))
    return bare.select("path", "name", "line_start", F.explode(F.array_compact(F.array(*[F.when(F.col("_b").rlike(p), F.lit(k)) for k, p in EFFECTS]))).alias("kind"))


def type_coverage(functions: DataFrame) -> DataFrame:
    """100 typed / total, where a function has its parameters and its return to type."""
    typed = F.size(F.filter("params", lambda p: p.rlike(r"^\s*\??[\w\\|]+\s+[&.]*\$")))
    return functions.agg(F.round(100.0 * F.coalesce(F.sum(typed), F.lit(0)) / F.greatest(F.coalesce(F.sum(F.size("params") + 1), F.lit(0)), F.lit(1)), 2).alias("type_coverage"))


def include_edges(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``src, dst``: basenames of a file and of what it includes."""
    found = findings(files, rule_sets.INCLUDES, path, content)
    return found.select(F.substring_index(path, "/", -1).alias("src"), F.substring_index("snippet", "/", -1).alias("dst")).distinct()


def main_function(functions: DataFrame, fields: DataFrame) -> DataFrame:
    """One function a file, with ``keys``: most return keys, then a telling name, then the largest with database calls, then the largest.

    ``fields`` is :func:`shapes.return_fields` of the same files.
    """
    named = F.col("name").rlike("^(get|fetch|load|list|index|main)")
    keyed = functions.join(_first_keys(fields), ["path", "name", "line_start"], "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    order = Window.partitionBy("path").orderBy(F.desc(F.size("keys")), named.desc(), F.col("calls_db").desc(), F.desc("line_count"), "line_start")
    return keyed.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
