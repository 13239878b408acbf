"""Facts brought together: routes and files, modules and tables, contracts, chunks and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclens.functions import derive
from srclens.functions.conditions import basename

#: Marks of SQL and of HTML in a segment, without case.
SQL_MARKS = ("SELECT", "INSERT", "UPDATE", "DELETE", "mysql_query", "mysqli_query", "->query", "->prepare")
HTML_MARKS = ("<html", "<body", "<div", "<form", "<table", "echo\\s+[\"']<", "print\\s+[\"']<")
#: Lines of a job, and above which an entry point is large.
JOB_LINES = 400


def routes_with_files(routes: DataFrame, order: str, method: str = "method", path: str = "path", target: str = "target") -> DataFrame:
    """``route, file``: the basename of each route's target; of routes with one key the last in ``order`` holds."""
    keyed = routes.where(F.coalesce(target, F.lit("")) != "").select(F.concat_ws(" ", F.coalesce(method, F.lit("GET")), path).alias("route"), basename(target).alias("file"), order)
    return keyed.groupBy("route").agg(F.max_by("file", order).alias("file"))


def files_with_routes(routes: DataFrame, order: str, method: str = "method", path: str = "path", target: str = "target") -> DataFrame:
    """``file, n, route``: all routes of each file, numbered in ``order``; a row a route, however many a file has."""
    from pyspark.sql import Window

    keyed = routes.where(F.coalesce(target, F.lit("")) != "").select(basename(target).alias("file"), F.concat_ws(" ", F.coalesce(method, F.lit("GET")), path).alias("route"), order)
    return keyed.select("file", F.row_number().over(Window.partitionBy("file").orderBy(order, "route")).cast("long").alias("n"), "route")


def endpoint_resilience(endpoints: DataFrame, frequency: DataFrame, order: str) -> DataFrame:
    """Endpoints ``pattern, method_name`` with the first frequency row of their name: ``priority, timeout_ms`` and settings.

    ``frequency``: ``name, total_calls, is_hot`` and ``order``. Endpoints without one count no calls.
    """
    first = frequency.groupBy(F.col("name").alias("_name")).agg(F.min_by(F.struct("total_calls", "is_hot"), order).alias("_f"))
    out = endpoints.join(first, F.col("method_name") == F.col("_name"), "left")
    calls, hot = F.coalesce("_f.total_calls", F.lit(0)), F.coalesce("_f.is_hot", F.lit(False))
    out = out.withColumn("priority", derive.endpoint_priority(F.col("method_name"), calls, hot))
    return out.select("pattern", "method_name", "priority", derive.timeout_ms(F.col("priority"), F.lit(False)).alias("timeout_ms"), derive.resilience(F.col("priority"), hot).alias("r")).select("pattern", "method_name", "priority", "timeout_ms", "r.*")


def mapped_calls(calls: DataFrame, mapping: DataFrame) -> DataFrame:
    """Call sites ``class_name, member`` of mapped methods, with the columns of ``mapping`` (``class_name, method, ...``)."""
    return calls.join(mapping.withColumnRenamed("method", "member"), ["class_name", "member"])


def module_pairs(uses: DataFrame, module: str = "module", table: str = "table") -> DataFrame:
    """``a, b, n_shared``: ordered pairs of modules that share tables. ``uses`` is by table, so its size is the sum over tables of their squared module counts."""
    one = uses.select(F.col(module).alias("a"), F.col(table).alias("_t")).distinct()
    return one.join(one.select(F.col("a").alias("b"), "_t"), "_t").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_shared"))


def module_dependencies(uses: DataFrame, rules: Sequence[tuple[str, str]], module: str = "module", table: str = "table") -> DataFrame:
    """``name, needs`` of the rules whose modules share a table."""
    allowed = uses.sparkSession.createDataFrame(list(rules), "name string, needs string")
    pairs = module_pairs(uses, module, table)
    both = pairs.select(F.col("a").alias("name"), F.col("b").alias("needs")).unionByName(pairs.select(F.col("b").alias("name"), F.col("a").alias("needs")))
    return both.join(F.broadcast(allowed), ["name", "needs"], "left_semi")


def database_patterns(found: DataFrame, table: str = "table", operation: str = "type") -> DataFrame:
    """``operation, n, n_tables``: findings and distinct tables by operation, and over all in the row ``all``."""
    op = F.coalesce(F.col(operation), F.lit("unknown"))
    own = found.select(op.alias("operation"), F.nullif(F.col(table), F.lit("")).alias("_t"))
    out = own.groupingSets([["operation"], []], "operation").agg(F.count("*").alias("n"), F.count_distinct("_t").alias("n_tables"))
    return out.select(F.coalesce("operation", F.lit("all")).alias("operation"), "n", "n_tables")


def jobs_needed(lines: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(lines / JOB_LINES)).cast("long")


def chunk_totals(manifests: DataFrame) -> DataFrame:
    """One row ``total_files, total_chunks, total_lines, total_jobs`` of ``total_lines, chunk_count`` rows."""
    return manifests.agg(
        F.count("*").alias("total_files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("total_chunks"),
        F.coalesce(F.sum("total_lines"), F.lit(0)).cast("long").alias("total_lines"), F.coalesce(F.sum(jobs_needed(F.col("total_lines"))), F.lit(0)).cast("long").alias("total_jobs"),
    )


def synthesis_summary(modules: DataFrame) -> DataFrame:
    """One row of totals over ``name, is_microservice, risk, n_routes, n_tables, n_security``; high-risk modules are counted."""
    high = F.col("risk") == "high"
    return modules.agg(
        F.count("*").alias("total_modules"), F.count_if("is_microservice").alias("total_microservices"), F.count_if(~F.col("is_microservice")).alias("total_gateway_modules"),
        F.coalesce(F.sum("n_routes"), F.lit(0)).cast("long").alias("total_routes"), F.coalesce(F.sum("n_tables"), F.lit(0)).cast("long").alias("total_tables"),
        F.coalesce(F.sum("n_security"), F.lit(0)).cast("long").alias("total_security_issues"), F.count_if(high).alias("n_high_risk"),
    )


def ownership_summary(owned: DataFrame) -> DataFrame:
    """One row: tables by ownership, and the complexity: high if any is shared, medium if any is read only, else low."""
    n = lambda kind: F.count_if(F.col("ownership") == kind)
    out = owned.agg(
        F.count("*").alias("n_tables"), n("submodule_owned").alias("n_owned"), n("main_owned").alias("n_main"), n("shared").alias("n_shared"), n("read_only").alias("n_read_only")
    )
    return out.withColumn("complexity", F.when(F.col("n_shared") > 0, "high").when(F.col("n_read_only") > 0, "medium").otherwise("low"))


#: What an ownership class asks for: its place, priority and category.
OWNERSHIP_ADVICE = (("shared", "high", "shared_data"), ("submodule_owned", "medium", "data_migration"), ("read_only", "low", "read_access"))


def ownership_recommendations(owned: DataFrame) -> DataFrame:
    """``priority, category, n_tables, first_table`` of the ownership classes that occur and ask for something."""
    pick = lambda k: F.create_map(*[F.lit(x) for row in OWNERSHIP_ADVICE for x in (row[0], row[k])])[F.col("ownership")]
    known = owned.where(F.col("ownership").isin(*[x[0] for x in OWNERSHIP_ADVICE]))
    return known.groupBy("ownership").agg(F.count("*").alias("n_tables"), F.min("table").alias("first_table")).select(
        pick(1).alias("priority"), pick(2).alias("category"), "n_tables", "first_table"
    )


def contract_summary(contracts: DataFrame) -> DataFrame:
    """One row of counts over ``visibility, is_static, n_callers, effects array<struct<type, table>>`` of called methods; tables are counted once each."""
    called = contracts.where(F.col("n_callers") > 0)
    has = lambda kind: F.count_if(F.exists("effects", lambda e: e["type"] == kind))
    totals = called.agg(
        F.count("*").alias("total_contracts"), F.count_if(F.col("visibility") == "public").alias("public_methods"), F.count_if("is_static").alias("static_methods"),
        has("database_read").alias("with_db_reads"), has("database_write").alias("with_db_writes"), has("session").alias("with_session"),
        F.coalesce(F.sum("n_callers"), F.lit(0)).cast("long").alias("total_callers"),
    )
    tables = called.select(F.inline("effects")).select("type", "table").distinct().where("table is not null")
    n = tables.agg(F.count_if(F.col("type") == "database_read").alias("n_tables_read"), F.count_if(F.col("type") == "database_write").alias("n_tables_written"))
    one = F.lit(1).alias("_one")
    return totals.select("*", one).join(n.select("*", one), "_one").drop("_one")


def segment_flags(text: Column) -> tuple[Column, Column]:
    """``has_sql, has_html`` of a segment of code."""
    return text.rlike("(?i)" + "|".join(SQL_MARKS)).alias("has_sql"), text.rlike("(?i)" + "|".join(HTML_MARKS)).alias("has_html")


def chunk_metadata(chunks: DataFrame, files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Chunks ``path, job, start_line, end_line`` with ``n_lines, functions`` (names that start in the chunk) and flags of the chunk's text."""
    lines = F.slice(F.split(content, "\n", -1), F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int"))
    own = chunks.join(files.select(path, content), path).withColumn("_text", F.array_join(lines, "\n"))
    return own.select(
        path, "job", "start_line", "end_line", (F.col("end_line") - F.col("start_line") + 1).alias("n_lines"),
        F.regexp_extract_all("_text", F.lit(r"function\s+&?(\w+)\s*\("), F.lit(1)).alias("functions"), *segment_flags(F.col("_text")),
        F.col("_text").rlike(r"\$_(?:GET|POST|REQUEST)").alias("is_entry"), F.contains("_text", F.lit("$_SESSION")).alias("has_session"),
    )


def large_entries(files: DataFrame, is_entry: Column, n_lines: str = "n_lines", least: int = JOB_LINES) -> DataFrame:
    """Entry points of more than ``least`` lines."""
    return files.where(is_entry & (F.col(n_lines) > least))


def database_context(owned: DataFrame) -> DataFrame:
    """``table, entity_name, ownership``: entities of owned tables (full) and of shared ones."""
    kind = F.when(F.col("ownership") == "submodule_owned", "full").when(F.col("ownership") == "shared", "shared")
    return owned.withColumn("kind", kind).where("kind is not null").select("table", derive.entity_name(F.col("table")).alias("entity_name"), F.col("kind").alias("ownership"))


def service_context(modules: DataFrame, endpoints: DataFrame, entities: DataFrame) -> DataFrame:
    """``module, service, n_endpoints, n_entities``: a service document's parts brought to one row a module.

    ``modules``: module, path; ``endpoints`` and ``entities`` have ``module``. Lists stay in their tables, so that no row grows with them.
    """
    counts = lambda df, n: df.groupBy("module").agg(F.count("*").alias(n))
    out = modules.join(counts(endpoints, "n_endpoints"), "module", "left").join(counts(entities, "n_entities"), "module", "left")
    return out.select("module", derive.service_name(F.col("path")).alias("service"), F.coalesce("n_endpoints", F.lit(0)).alias("n_endpoints"), F.coalesce("n_entities", F.lit(0)).alias("n_entities"))
