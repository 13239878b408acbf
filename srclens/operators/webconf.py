"""Routes from server configuration and code: rewrite files, nginx, switch/if/router code and files themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srclens.functions.conditions import ladder
from srclens.operators import code, routes
from srclens.operators.scan import text_lines
from srclens.sources.shared import numbered, written


def rewrite_rules(files: DataFrame, base: str = "", path: str = "path", content: str = "content") -> DataFrame:
    """Routes of .htaccess files: ``path, line, pattern, template, params, target, method, flags, is_redirect, n_conditions, priority``.

    RewriteCond lines belong to the next RewriteRule; a target ``-`` uses them up without a route.
    """
    lines = text_lines(files, path, content)
    rule = r"^\s*RewriteRule\s+(\S+)\s+(\S+)(?:\s+\[([^\]]*)\])?"
    cond = r"^\s*RewriteCond\s+(\S+)\s+(\S+)"
    is_rule, is_cond = F.col("content").rlike(rule), F.col("content").rlike(cond)
    group = F.coalesce(F.sum(is_rule.cast("int")).over(Window.partitionBy(path).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    method = F.when(is_cond & F.contains("content", F.lit("REQUEST_METHOD")), F.regexp_extract("content", r"\b(GET|POST|PUT|PATCH|DELETE)\b", 1))
    inside = Window.partitionBy(path, "_group")
    marked = lines.withColumn("_group", group).withColumn("method", F.max(method).over(inside)).withColumn("n_conditions", F.count_if(is_cond).over(inside))
    found = marked.where(is_rule).select(
        path, "line", F.regexp_extract("content", rule, 1).alias("pattern"), F.regexp_extract("content", rule, 2).alias("target"),
        F.split(F.regexp_extract("content", rule, 3), r"\s*,\s*").alias("flags"), F.coalesce(F.nullif("method", F.lit("")), F.lit("GET")).alias("method"), "n_conditions",
    ).where(F.col("target") != "-")
    template, params = routes.template_from_regex(F.col("pattern"), base)
    found = found.withColumn("template", template).withColumn("params", params).withColumn("is_redirect", F.exists("flags", lambda f: f.rlike("^R(=|$)")))
    found = found.withColumn("target_file", F.regexp_extract("target", r"^/?([^?]+)", 1)).withColumn("query_params", F.regexp_extract_all("target", F.lit(r"[?&]([\w]+)="), F.lit(1)))
    found = found.withColumn("is_api", F.col("template").rlike(r"(?i)/api(/|$)"))
    return found.withColumn("priority", (F.row_number().over(Window.partitionBy(path).orderBy("line")) - 1).cast("long"))


def rewrite_summary(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, n_rules, n_conditions, flags, is_front_controller``: counts of a file and whether a rule sends everything to one index script."""
    rule = r"(?m)^\s*RewriteRule\s+(\S+)\s+(\S+)(?:\s+\[([^\]]*)\])?"
    flags = F.flatten(F.transform(F.regexp_extract_all(content, F.lit(rule), F.lit(3)), lambda f: F.split(f, r"\s*,\s*")))
    names = F.array_sort(F.array_distinct(F.filter(F.transform(flags, lambda f: F.substring_index(f, "=", 1)), lambda f: f != "")))
    return files.select(
        path, F.regexp_count(content, F.lit(rule)).cast("long").alias("n_rules"), F.regexp_count(content, F.lit(r"(?m)^\s*RewriteCond\s")).cast("long").alias("n_conditions"),
        names.alias("flags"), F.col(content).rlike(r"(?m)^\s*RewriteRule\s+\^?(?:\(?\.[*+]\)?\$?|\^?)\s+/?index\.php").alias("is_front_controller"),
    )


def nginx_locations(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, pattern, template, target``: the target is the fastcgi script if there is one, else the last of try_files."""
    p = r"location\s+(?:[~^=*]+\s+)?(\S+)\s*\{([^}]*)\}"
    each = files.select(path, F.inline(F.arrays_zip(F.regexp_extract_all(content, F.lit(p), F.lit(1)).alias("pattern"), F.regexp_extract_all(content, F.lit(p), F.lit(2)).alias("body"))))
    script = F.nullif(F.regexp_extract("body", r"SCRIPT_FILENAME\s+[^;]*?(/[\w/.-]+\.php)", 1), F.lit(""))
    tried = F.nullif(F.regexp_extract("body", r"try_files\s+[^;]*?(/[\w/.-]+)(?:\?[^;\s]*)?\s*;", 1), F.lit(""))
    template, _ = routes.template_from_regex(F.col("pattern"))
    return each.select(path, "pattern", template.alias("template"), F.coalesce(script, tried).alias("target"))


def nginx_rewrites(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, pattern, template, target`` of rewrite lines; those to other sites are dropped."""
    p = r"rewrite\s+(\S+)\s+(\S+?)\s*(?:\s(?:last|break|redirect|permanent))?\s*;"
    each = files.select(path, F.inline(F.arrays_zip(F.regexp_extract_all(content, F.lit(p), F.lit(1)).alias("pattern"), F.regexp_extract_all(content, F.lit(p), F.lit(2)).alias("target"))))
    template, _ = routes.template_from_regex(F.col("pattern"))
    return each.where(~F.col("target").rlike("^https?://")).select(path, "pattern", template.alias("template"), "target")


def code_routes(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, kind, method, route``: cases of a switch over a request value, comparisons with one, and router calls."""
    block = r"switch\s*\(\s*\$_(GET|POST|REQUEST)\[['\"](\w+)['\"]\]\s*\)\s*\{([^}]*)\}"
    zipped = F.arrays_zip(*[F.regexp_extract_all(content, F.lit(block), F.lit(i)).alias(n) for i, n in ((1, "source"), (2, "param"), (3, "body"))])
    post = lambda c: F.when(F.col(c) == "POST", "POST").otherwise("GET")
    cases = files.select(path, F.inline(zipped)).select(path, "source", "param", F.explode(F.regexp_extract_all("body", F.lit(r"case\s+['\"]([\w/-]+)['\"]"), F.lit(1))).alias("value"))
    switch = cases.select(path, F.lit("switch").alias("kind"), post("source").alias("method"), F.concat_ws("/", F.lit(""), "param", "value").alias("route"))
    test = r"\$_(GET|POST|REQUEST)\[['\"](\w+)['\"]\]\s*={2,3}\s*['\"]([\w/-]+)['\"]"
    zipped = F.arrays_zip(*[F.regexp_extract_all(content, F.lit(test), F.lit(i)).alias(n) for i, n in ((1, "source"), (2, "param"), (3, "value"))])
    tests = files.select(path, F.inline(zipped)).select(path, F.lit("if").alias("kind"), post("source").alias("method"), F.concat_ws("/", F.lit(""), "param", "value").alias("route"))
    call = r"(?:->|::)(get|post|put|patch|delete)\s*\(\s*['\"](/[^'\"]*)['\"]"
    zipped = F.arrays_zip(*[F.regexp_extract_all(content, F.lit(call), F.lit(i)).alias(n) for i, n in ((1, "verb"), (2, "route"))])
    router = files.select(path, F.inline(zipped)).select(path, F.lit("router").alias("kind"), F.upper("verb").alias("method"), "route")
    return switch.unionByName(tests).unionByName(router)


def file_routes(files: DataFrame, root: str, path: str = "path", content: str = "content", excluded: str = r"/(vendor|node_modules|tests?|cache)/") -> DataFrame:
    """Files below ``root`` as routes: no include files or excluded folders, ``/index`` is its folder; priorities from 1000."""
    from srclens.operators.php import is_include_file

    own = files.where(F.contains(path, F.lit(root)) & ~F.col(path).rlike(excluded) & ~is_include_file(F.col(path), F.col(content)))
    route = F.regexp_replace(F.regexp_replace(F.substring_index(path, root, -1), r"\.php$", ""), r"/index$", "")
    route = ladder([(route == "", F.lit("/")), (~F.startswith(route, F.lit("/")), F.concat(F.lit("/"), route))], route)
    methods = F.when(F.col(content).rlike(r"\$_POST\b"), F.array(F.lit("GET"), F.lit("POST"))).otherwise(F.array(F.lit("GET")))
    out = own.select(path, route.alias("route"), methods.alias("methods"), code.superglobals(F.col(content)).alias("superglobals")).distinct()
    # Written, as the order's ranges are drawn from a first reading.
    return numbered(written(out, "routes"), F.col("route").asc(), F.col(path).asc(), name="priority").withColumn("priority", 1000 + F.col("priority"))
