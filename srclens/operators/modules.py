"""Module and service derivations: schema summaries, contracts, metrics, health checks and decisions as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srclens.functions import derive, naming
from srclens.functions.conditions import ladder


def condensed_schema(columns: DataFrame) -> DataFrame:
    """``table, columns``: name and type of each column and the marks that hold; names with a dot or ``$`` and empty tables go."""
    kept = columns.where(~F.col("name").rlike(r"[.$]"))
    marks = F.filter(F.array(F.when(F.col("primary_key"), F.lit("pk")), F.when(~F.col("nullable"), F.lit("required")), F.when(F.col("auto_increment"), F.lit("auto"))), lambda x: x.isNotNull())
    one = F.concat_ws(" ", "name", "data_type", F.array_join(marks, " "))
    return kept.groupBy("table").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", F.rtrim(one).alias("c")))), lambda x: x["c"]).alias("columns"))


def module_slice(summary: DataFrame, tables: DataFrame) -> DataFrame:
    """The summary of the listed tables, with their module; ``tables`` has ``module, table``."""
    return summary.join(tables.select("module", "table").distinct(), "table")


def merged_clusters(clusters: DataFrame, keywords: Mapping[str, str]) -> DataFrame:
    """``cluster, file``: clusters renamed by the first keyword in their name and joined under it."""
    name = ladder([(F.contains(F.lower("cluster"), F.lit(k)), v) for k, v in keywords.items()], F.col("cluster"))
    return clusters.select(name.alias("cluster"), "file").distinct()


def endpoints(contracts: DataFrame) -> DataFrame:
    """``message, request_type, response_type`` beside the other columns of methods, which have ``service, class_name, method`` and ``hint, doc, inferred`` types."""
    result = F.coalesce("hint", "doc", "inferred", F.lit("any"))
    wrapped = F.when(result.rlike(r"\[\]$|^array"), F.lit("{ items, total }")).when(F.lower(result).isin("void", "null"), F.lit("{ success }")).otherwise(F.concat(F.lit("{ data: "), derive.php_type(result), F.lit(" }")))
    request = F.concat(naming.pascal(naming.snake(F.col("method"))), F.lit("Request"))
    kept = [c for c in contracts.columns if c not in ("service", "hint", "doc", "inferred", "message", "request_type", "response_type")]
    return contracts.select(*kept, naming.message_pattern(F.col("service"), F.col("class_name"), F.col("method")).alias("message"), request.alias("request_type"), wrapped.alias("response_type"))


def with_frequency(contracts: DataFrame, frequency: DataFrame) -> DataFrame:
    """Contracts with their calls; functions have a null class, which meets null."""
    f = frequency.select(F.col("class_name").alias("_c"), F.col("name").alias("_n"), "total_calls", "is_hot")
    out = contracts.join(f, F.col("class_name").eqNullSafe(F.col("_c")) & (F.col("method") == F.col("_n")), "left").drop("_c", "_n")
    return out.fillna({"total_calls": 0, "is_hot": False})


def cacheable_reads(frequency: DataFrame, effects: DataFrame, key: str) -> DataFrame:
    """Frequencies of methods without write effects."""
    return frequency.join(effects.where(F.col("effect").isin("database_write", "file_write")).select(key).distinct(), key, "left_anti")


def metric_definitions(frequency: DataFrame, key: str, top: int = 20, hot: int = 10) -> DataFrame:
    """``metric, kind``: counters of the most called methods, histograms of the hottest, four standard metrics."""
    ranked = frequency.orderBy(F.desc("total_calls"), key).limit(top)
    counters = ranked.select(F.concat(F.col(key), F.lit("_calls_total")).alias("metric"), F.lit("counter").alias("kind"))
    timed = frequency.where("is_hot").orderBy(F.desc("total_calls"), key).limit(hot).select(F.concat(F.col(key), F.lit("_seconds")).alias("metric"), F.lit("histogram").alias("kind"))
    standard = frequency.sparkSession.createDataFrame([("requests_total", "counter"), ("errors_total", "counter"), ("request_seconds", "histogram"), ("in_flight", "gauge")], "metric string, kind string")
    return counters.unionByName(timed).unionByName(standard)


def health_checks(tables: DataFrame) -> DataFrame:
    """``name``: memory and disk always, the database if there is any table."""
    always = tables.sparkSession.createDataFrame([("memory",), ("disk",)], "name string")
    return tables.limit(1).select(F.lit("database").alias("name")).unionByName(always)


def migration_checklist(tables: DataFrame, calls: DataFrame) -> DataFrame:
    """``step, name, needs``: fixed steps; the data step stands only if there are tables, the proxy only if there are calls."""
    steps = tables.sparkSession.createDataFrame(
        [(1, "inventory", None, None), (2, "data", "inventory", "tables"), (3, "contract", "inventory", None), (4, "proxy", "contract", "calls"), (5, "service", "contract", None), (6, "switch", "service", None), (7, "cleanup", "switch", None)],
        "step long, name string, needs string, only_if string",
    )
    present = tables.limit(1).select(F.lit("tables").alias("only_if")).unionByName(calls.limit(1).select(F.lit("calls").alias("only_if")))
    return steps.where("only_if is null").drop("only_if").unionByName(steps.join(present, "only_if", "left_semi").select("step", "name", "needs"))


def workspace(modules: DataFrame, first_port: int = 3001, limit: int = 15) -> DataFrame:
    """``module, project, port``: one service a module in order of place."""
    n = F.row_number().over(Window.orderBy("place", "name"))  # of ``limit`` rows
    return modules.orderBy("place", "name").limit(limit).select("place", "name").select(F.col("name").alias("module"), naming.kebab(F.col("name")).alias("project"), (first_port - 1 + n).cast("long").alias("port"))


def replacements(uses: DataFrame, service: Column | str = "service") -> DataFrame:
    """``path, line, old, new`` of call sites, last lines first so that edits don't move earlier ones."""
    client = F.concat(F.lit("$"), naming.camel(F.col(service) if isinstance(service, str) else service), F.lit("Client"))
    new = ladder(
        [
            (F.col("kind") == "static_call", F.concat(client, F.lit("->"), F.coalesce("member", F.lit("")), F.lit("("))),
            (F.col("kind") == "instantiation", client),
            (F.col("kind") == "method_call", F.concat(client, F.lit("->"), F.coalesce("member", F.lit("")), F.lit("("))),
        ],
        F.lit("// handled by the service"),
    )
    old = F.when(F.col("kind") == "static_call", F.concat("class_name", F.lit("::"), "member", F.lit("("))).otherwise(F.coalesce("class_name", "member"))
    return uses.select("path", "line", old.alias("old"), new.alias("new")).orderBy("path", F.desc("line"))


def interactions(endpoint_rows: DataFrame) -> DataFrame:
    """``message, case``: a success of every endpoint, and not_found of those that get something."""
    cases = F.filter(F.array(F.lit("success"), F.when(F.contains(F.lower("method"), F.lit("get")), F.lit("not_found"))), lambda x: x.isNotNull())
    return endpoint_rows.select("message", F.explode(cases).alias("case"))


def interaction_summary(cases: DataFrame) -> DataFrame:
    """``case, n``: interactions by case."""
    return cases.groupBy("case").agg(F.count("*").alias("n"))


def key_decisions(summary: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``decision`` of each ``(SQL condition, decision)`` that holds on a one-row summary."""
    found = F.filter(F.array(*[F.when(F.expr(c), F.lit(d)) for c, d in rules]), lambda x: x.isNotNull())
    return summary.select(F.explode(found).alias("decision"))
