"""Queries over code, DDL and server configuration. The texts are made of table columns, so their facts are known by construction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srclens.functions import conditions, derive, naming, rule_sets
from srclens.operators import calls, code, coverage, ddl, flow, lexer, modules, php, routes, scan, shapes, sqlscopes, sqltext, synthesis, webconf
from srclens.operators.scan import Rule
from srclens.plans import code_texts as texts
from srclens.plans.fact_queries import MODULES
from srclens.plans.fact_queries import modules as module_rows
from srclens.plans.registry import QUERIES, Tables, query
from srclens.sources import discovery, files

S, L = texts.SHAPES.key_sql, texts.LONG
P, D, R, N = texts.PHP.key_sql, texts.DDL.key_sql, texts.REWRITES.key_sql, texts.NGINX.key_sql


def joined(c: str) -> F.Column:
    return F.array_join(c, ",").alias(c)


# Structure of code -----------------------------------------------------------------------------------------------------------------


@query(f"""
SELECT {P} AS path, 'load_' || p_partkey AS name, false AS is_static, CAST(8 AS BIGINT) AS line_start, CAST(13 AS BIGINT) AS line_end, CAST(6 AS BIGINT) AS line_count, CAST(2 + p_size % 4 AS BIGINT) AS cyclomatic_complexity, false AS calls_db FROM part
UNION ALL SELECT {P}, 'find', true, 15, 18, 4, 2, true FROM part""")
def code_functions(t: Tables) -> DataFrame:
    return code.functions(texts.PHP.frame(t)).drop("body", "params")


# Code whose shape follows the key. Line n of the text stands at n up to the long function, then the long function's lines further down.


@query(f"""
WITH p AS (SELECT {S} AS path, p_partkey AS k, p_size AS z, {L} AS n FROM part),
f AS (SELECT path, 'head_' || k AS name, false AS is_static, 2 AS line_start, 2 AS line_end FROM p UNION ALL SELECT path, 'long_' || k, false, 3, 4 + n FROM p
 UNION ALL SELECT path, 'make', true, 8 + n, 8 + n FROM p UNION ALL SELECT path, CASE WHEN z % 3 = 0 THEN 'outer' ELSE 'plain' END, false, 9 + n, 9 + n FROM p UNION ALL SELECT path, 'walk', false, 10 + n, 10 + n FROM p)
SELECT path, name, is_static, CAST(line_start AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end, CAST(line_end - line_start + 1 AS BIGINT) AS line_count FROM f""")
def shape_functions(t: Tables) -> DataFrame:
    return code.functions(texts.SHAPES.frame(t)).select("path", "name", "is_static", "line_start", "line_end", "line_count")


@query(f"""
WITH p AS (SELECT {S} AS path, p_partkey AS k, p_size AS z, {L} AS n FROM part)
SELECT path, CAST(11 + n AS BIGINT) AS n_strings, CAST(2 AS BIGINT) AS n_comments, CAST(3 AS BIGINT) AS n_heredoc, CAST(2 AS BIGINT) AS n_page, CAST(0 AS BIGINT) AS last_depth FROM p""")
def shape_tokens(t: Tables) -> DataFrame:
    """Strings, comments, heredoc lines and page text of each file, and the brackets that are open at its end."""
    found = lexer.with_depth(lexer.tokens(texts.SHAPES.frame(t)))  # only marks of code move the depth
    move = F.when(F.col("token").isin(*lexer.OPENING), 1).when(F.col("token").isin(*lexer.CLOSING), -1).otherwise(0)
    at = F.when(~F.col("kind").isin("space", "comment", "page", "heredoc"), F.col("pos"))
    counts = [F.count_if(F.col("kind") == k).alias(n) for k, n in (("string", "n_strings"), ("comment", "n_comments"), ("heredoc", "n_heredoc"), ("page", "n_page"))]
    return found.groupBy("path").agg(*counts, F.max_by(F.col("depth") + F.when(F.col("kind") == "mark", move).otherwise(0), at).alias("last_depth")).where("last_depth is not null")


@query(f"""
WITH p AS (SELECT {S} AS path, p_partkey AS k, p_size AS z, {L} AS n FROM part),
f AS (SELECT path, 'head_' || k AS name, unnest([{{'k': 'id', 't': 'int'}}, {{'k': 'sub', 't': 'array'}}, {{'k': 'sub.n', 't': 'int'}}, {{'k': 'sub.l' || z % 2, 't': 'array'}}, {{'k': 'sub.l' || z % 2 || '.deep', 't': 'string'}}]) AS x FROM p
 UNION ALL SELECT path, 'make', unnest(list_filter([CASE WHEN z % 2 = 0 THEN {{'k': 'a', 't': 'int'}} END, {{'k': 'b.c', 't': 'int'}}], lambda y: y IS NOT NULL)) FROM p
 UNION ALL SELECT path, CASE WHEN z % 3 = 0 THEN 'outer' ELSE 'plain' END, {{'k': repeat('[].', z % 4) || 'k', 't': 'float'}} FROM p)
SELECT path, name, x.k AS key, x.t AS type FROM f""")
def shape_return_fields(t: Tables) -> DataFrame:
    _, found = shapes.ranges_and_fields(texts.SHAPES.frame(t))
    return found.select("path", "name", F.array_join("keys", ".").alias("key"), "type")


_CALLS = f"""p AS (SELECT {S} AS path, p_partkey AS k, p_size AS z, 10 + {L} AS l FROM part),
c AS (SELECT path, l AS line, 'make' AS name, NULL AS loop, NULL AS loop_line FROM p UNION ALL SELECT path, l, 'more', 'while', l FROM p UNION ALL SELECT path, l, 'load_' || z % 3, 'while', l FROM p
 UNION ALL SELECT path, l, unnest(list_transform(range(z % 4), lambda x: 'save')), 'foreach', l FROM p UNION ALL SELECT path, l, unnest(list_transform(range(z % 5), lambda x: 'log_it')), NULL, NULL FROM p
 UNION ALL SELECT path, l, 'head_' || k, NULL, NULL FROM p UNION ALL SELECT path, l + 1, 'walk', 'for', l + 1 FROM p UNION ALL SELECT path, l - 2, 'count', NULL, NULL FROM p UNION ALL SELECT path, l - 2, 'make', NULL, NULL FROM p)"""


@query(f"WITH {_CALLS} SELECT path, CAST(line AS BIGINT) AS line, name, loop, CAST(loop_line AS BIGINT) AS loop_line FROM c")
def shape_loop_calls(t: Tables) -> DataFrame:
    return flow.file_loop_calls(texts.SHAPES.frame(t)).select("path", "line", "name", "loop", "loop_line")


@query(f"""
WITH {_CALLS}, f AS (SELECT name, path, count(*) AS n, count(loop) AS n_loop FROM c GROUP BY name, path),
g AS (SELECT name, sum(n) AS n_calls, sum(n_loop) AS n_loop, min(path) FILTER (WHERE n_loop > 0) AS loop_path, min(path) FILTER (WHERE n >= 3) AS run_path FROM f GROUP BY name)
SELECT g.name, CASE WHEN g.n_loop > 0 THEN 'loop_calls' ELSE 'sequential_calls' END AS pattern, coalesce(CASE WHEN g.n_loop > 0 THEN loop_path END, run_path) AS path,
 CAST(CASE WHEN g.n_loop > 0 THEN n_calls ELSE f.n END AS BIGINT) AS n_calls, 'bulk' || CASE WHEN g.name LIKE 'load%' THEN 'Load' || substr(g.name, 5) WHEN g.name = 'log_it' THEN 'Log_It' ELSE upper(substr(g.name, 1, 1)) || substr(g.name, 2) END AS bulk_name,
 CASE WHEN g.n_loop > 0 AND n_calls >= 10 THEN 'high' ELSE 'medium' END AS savings
FROM g LEFT JOIN f ON f.name = g.name AND f.path = run_path WHERE g.n_loop > 0 OR run_path IS NOT NULL""")
def shape_batches(t: Tables) -> DataFrame:
    return flow.batch_opportunities(flow.file_loop_calls(texts.SHAPES.frame(t)))


@query(f"""
WITH p AS (SELECT {S} AS path, p_partkey AS k FROM part)
SELECT path || '#' AS caller, path || '#walk' AS callee FROM p UNION ALL SELECT path || '#walk', path || '#head_' || k FROM p UNION ALL SELECT path || '#K' || k || '.make', path || '#K' || k || '.make' FROM p
UNION ALL SELECT p.path || '#walk', q.path || '#K' || q.k || '.make' FROM p JOIN p q ON q.k = p.k % 50""")
def shape_call_graph(t: Tables) -> DataFrame:
    return flow.file_call_graph(texts.SHAPES.frame(t))


_REACH = "(SELECT p_partkey AS a, p_partkey // 2 AS b FROM part UNION ALL SELECT p_partkey, p_partkey + 1 FROM part WHERE p_size % 5 <> 0 UNION ALL SELECT p_partkey, (p_partkey * 7) % 1000 FROM part WHERE p_size % 7 = 1)"


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM {_REACH}), r AS (SELECT p_partkey AS id FROM part WHERE p_size = 7 UNION SELECT e.a FROM e JOIN r ON e.b = r.id)
SELECT id FROM r""")
def reaching_writes(t: Tables) -> DataFrame:
    """Which of the parts, linked like calls, lead to one of size 7."""
    p = t.part.select(F.col("p_partkey").alias("caller"), "p_size")
    edges = p.select("caller", F.floor(F.col("caller") / 2).alias("callee")).unionByName(p.where("p_size % 5 <> 0").select("caller", (F.col("caller") + 1).alias("callee")))
    edges = edges.unionByName(p.where("p_size % 7 = 1").select("caller", (F.col("caller") * 7 % 1000).alias("callee")))
    return flow.reaching(edges, t.part.where("p_size = 7").select(F.col("p_partkey").alias("id")))


@query(f"""
WITH p AS (SELECT * FROM (VALUES (1, 1, 'id', NULL, false, false, NULL), (1, 2, 'opts', 'array', false, true, '[]'), (2, 1, 'id', '?int', false, false, NULL), (2, 2, 'row', NULL, true, false, NULL)) v(f, position, param, type_hint, by_reference, is_optional, "default"))
SELECT {P} AS path, CASE WHEN f = 1 THEN 'load_' || p_partkey ELSE 'find' END AS name, CAST(position AS BIGINT) AS position, param, type_hint, by_reference, is_optional, "default" FROM part, p""")
def code_parameters(t: Tables) -> DataFrame:
    return php.parameters(code.functions(texts.PHP.frame(t)))


@query(f"""
SELECT {P} AS path, 'load_' || p_partkey AS name, 'array' AS types, true AS nullable, 'id,brand' AS keys FROM part UNION ALL SELECT {P}, 'find', 'bool', false, '' FROM part""")
def code_returns(t: Tables) -> DataFrame:
    files = texts.PHP.frame(t)
    ranges, fields = shapes.ranges_and_fields(files)
    found = php.returns(code.functions(files, ranges=ranges), fields)
    return found.select("path", "name", joined("types"), "nullable", joined("keys"))


@query("SELECT round(100.0 * 2 / 6, 2)::DOUBLE AS type_coverage")
def code_type_coverage(t: Tables) -> DataFrame:
    return php.type_coverage(code.functions(texts.PHP.frame(t)))


@query(f"""
SELECT {P} AS path, 'load_' || p_partkey AS name, 'id,brand' AS keys FROM part""")
def code_main_function(t: Tables) -> DataFrame:
    files = texts.PHP.frame(t)
    ranges, fields = shapes.ranges_and_fields(files)
    return php.main_function(code.functions(files, ranges=ranges), fields).select("path", "name", joined("keys"))


@query(f"""
SELECT {P} AS path, 'Part' || p_partkey AS name, 'Base' || p_size % 5 AS extends, 'Countable,Sized' AS implements FROM part""")
def code_classes(t: Tables) -> DataFrame:
    return code.classes(texts.PHP.frame(t)).select("path", "name", "extends", joined("implements"))


@query(f"""
SELECT {P} AS path, 'load_' || p_partkey AS name, 'int' AS id_type, 'array|null' AS opts_type, 'array' AS returns FROM part""")
def code_phpdoc(t: Tables) -> DataFrame:
    return code.phpdoc(texts.PHP.frame(t)).select("path", "name", F.col("params")["id"].alias("id_type"), F.col("params")["opts"].alias("opts_type"), "returns")


@query(f"""
SELECT {P} AS path, 'class' AS kind, 'Part' || p_partkey AS name FROM part UNION ALL SELECT {P}, 'function', 'load_' || p_partkey FROM part""")
def code_definitions(t: Tables) -> DataFrame:
    return code.definitions(texts.PHP.frame(t))


@query(f"""
WITH u AS (SELECT {P} AS path, CAST(20 AS BIGINT) AS line, 'instantiation' AS kind, (p_partkey + 1) % 100 AS k, CAST(NULL AS VARCHAR) AS member FROM part UNION ALL SELECT {P}, 22, 'static_call', p_partkey % 50, 'find' FROM part)
SELECT path, line, kind, 'Part' || k AS class_name, member FROM u WHERE k IN (SELECT p_partkey FROM part)""")
def code_class_usages(t: Tables) -> DataFrame:
    own = texts.PHP.frame(t)
    return calls.class_usages(own, code.classes(own))


@query(f"""
SELECT {P} AS path, CAST(21 AS BIGINT) AS line, 'Part' || (p_partkey + 1) % 100 AS class_name, 'save' AS member FROM part""")
def code_method_calls(t: Tables) -> DataFrame:
    return calls.method_calls(texts.PHP.frame(t))


@query(f"""
SELECT {P} AS path, CAST(8 AS BIGINT) AS line, 'load_' || p_partkey AS member FROM part UNION ALL SELECT {P}, 15, 'find' FROM part UNION ALL SELECT {P}, 22, 'find' FROM part
UNION ALL SELECT {P}, 23, 'load_' || p_partkey % 60 FROM part WHERE p_partkey % 60 IN (SELECT p_partkey FROM part)""")
def code_function_calls(t: Tables) -> DataFrame:
    files = texts.PHP.frame(t)
    return calls.function_calls(files, code.functions(files))


@query(f"""
WITH r AS (SELECT {P} AS path, p_size, unnest([1, 2, 3, 4, 5]) AS k FROM part)
SELECT path, CASE k WHEN 1 THEN 'page' WHEN 2 THEN 'id_' || p_size % 3 WHEN 3 THEN 'q' WHEN 4 THEN 'act' || p_size % 2 ELSE 'mode' END AS param,
  CASE WHEN k <= 2 THEN 'int' ELSE 'string' END AS type, k <> 3 AS required, CASE WHEN k = 1 THEN '1' END AS "default" FROM r""")
def code_request_contract(t: Tables) -> DataFrame:
    found = php.request_contract(texts.PHP.frame(t))
    return found.select("path", "param", "type", "required", F.col("default.repr").alias("default"))


@query(f"""
SELECT {P} AS path, 'user' AS session_reads, '$_GET,$_POST,$_REQUEST,$_SESSION,$_FILES' AS superglobals, 'c' || p_size % 2 AS cookies, 'name' AS body_fields FROM part""")
def code_request_facts(t: Tables) -> DataFrame:
    c, files = F.col("content"), texts.PHP.frame(t)
    facts = (("session_reads", code.session_reads(c)), ("superglobals", code.superglobals(c)), ("cookies", code.cookies(c)), ("body_fields", code.body_fields(c)))
    return files.select("path", *[F.array_join(v, ",").alias(n) for n, v in facts])


@query(f"""
SELECT {P} AS path, 'doc' || p_size % 2 AS field, false AS checks_type, true AS checks_size, 'up/' AS storage, CAST(5 AS BIGINT) AS max_size, '' AS types FROM part""")
def code_uploads(t: Tables) -> DataFrame:
    return php.uploads(texts.PHP.frame(t)).withColumn("types", joined("types"))


_UPLOADS = texts.Corpus(
    "part", "/u/p«p_partkey».php",
    [
        "if ($_FILES['f']['size'] > «p_size» * 1024«CASE WHEN p_partkey % 2 = 0 THEN ' * 1024' ELSE '' END») die();",
        "«CASE p_partkey % 3 WHEN 0 THEN 'if (!in_array($_FILES[\"f\"][\"type\"], [\"image/png\", \"image/gif\"])) die();' WHEN 1 THEN '$ok = $_FILES[\"f\"][\"type\"] === \"text/csv\";' ELSE '' END»",
    ],
)


@query(f"""
SELECT {_UPLOADS.key_sql} AS path, 'f' AS field, p_partkey % 3 < 2 AS checks_type, true AS checks_size, CAST(NULL AS VARCHAR) AS storage, CAST(p_size * 1024 * CASE WHEN p_partkey % 2 = 0 THEN 1024 ELSE 1 END AS BIGINT) AS max_size,
  CASE p_partkey % 3 WHEN 0 THEN 'image/gif,image/png' WHEN 1 THEN 'text/csv' ELSE '' END AS types FROM part""")
def upload_limits(t: Tables) -> DataFrame:
    return php.uploads(_UPLOADS.frame(t)).withColumn("types", joined("types"))


@query(f"""
SELECT {P} AS path, 'GET,POST' AS methods, 'json' AS content_type, 'Content-Type: application/json' AS headers FROM part""")
def code_api_info(t: Tables) -> DataFrame:
    return php.api_info(texts.PHP.frame(t)).select("path", joined("methods"), "content_type", joined("headers"))


@query("SELECT 'p' || p_partkey || '.php' AS src, 'file' || p_size || '.php' AS dst FROM part")
def code_include_edges(t: Tables) -> DataFrame:
    return php.include_edges(texts.PHP.frame(t))


@query(f"""
WITH r AS (SELECT {P} AS path, p_size, unnest([1, 2, 3, 4]) AS k FROM part)
SELECT path, CASE WHEN k <= 2 THEN 'switch' WHEN k = 3 THEN 'if' ELSE 'router' END AS kind, CASE WHEN k = 3 THEN 'GET' ELSE 'POST' END AS method,
  CASE k WHEN 1 THEN '/act' || p_size % 2 || '/add' WHEN 2 THEN '/act' || p_size % 2 || '/del' WHEN 3 THEN '/mode/m' || p_size % 4 ELSE '/items/' || p_size END AS route FROM r""")
def code_routes(t: Tables) -> DataFrame:
    return webconf.code_routes(texts.PHP.frame(t))


@query(f"""
SELECT {P} AS path, '/' || p_brand || '/p' || p_partkey AS route, 'GET,POST' AS methods, '$_GET,$_POST,$_REQUEST,$_SESSION,$_FILES' AS superglobals,
  999 + row_number() OVER (ORDER BY '/' || p_brand || '/p' || p_partkey) AS priority FROM part""")
def code_file_routes(t: Tables) -> DataFrame:
    return webconf.file_routes(texts.PHP.frame(t), "/public").select("path", "route", joined("methods"), joined("superglobals"), "priority")


@query(f"""
SELECT {P} AS path, CAST(34 AS BIGINT) AS total_lines, CAST(0 AS BIGINT) AS html_lines, CAST(2 AS BIGINT) AS n_functions, CAST(7.5 - 0.0 AS DOUBLE) AS entry_score, 'entry' AS class FROM part""")
def code_file_metrics(t: Tables) -> DataFrame:
    return php.file_metrics(texts.PHP.frame(t)).select("path", "total_lines", "html_lines", "n_functions", "entry_score", "class")


@query(f"""
SELECT {P} AS path, CAST(k AS BIGINT) AS job, CAST(CASE k WHEN 1 THEN 13 ELSE 21 END AS BIGINT) AS n_lines, CASE k WHEN 1 THEN 'load_' || p_partkey ELSE 'find' END AS functions, k = 2 AS has_sql, false AS has_html, k = 2 AS is_entry, k = 2 AS has_session
FROM part, (VALUES (1), (2)) v(k)""")
def chunk_metadata(t: Tables) -> DataFrame:
    files = texts.PHP.frame(t)
    bounds = F.array(*[F.struct(F.lit(j).cast("long").alias("job"), F.lit(a).cast("long").alias("start_line"), F.lit(b).cast("long").alias("end_line")) for j, a, b in ((1, 1, 13), (2, 14, 34))])
    found = synthesis.chunk_metadata(files.select("path", F.inline(bounds)), files)
    return found.select("path", "job", "n_lines", joined("functions"), "has_sql", "has_html", "is_entry", "has_session")


# DDL -------------------------------------------------------------------------------------------------------------------------------


@query("""
WITH c AS (SELECT * FROM (VALUES (1, 'id', 'int(11)', false, true, 11), (2, 'name', NULL, true, false, NULL), (3, 'nation_id', 'bigint(20)', false, false, 20), (4, 'kind', 'enum(''a'',''b'')', true, false, NULL)) v(ordinal, name, data_type, nullable, auto_increment, length))
SELECT 't' || s_suppkey AS "table", CAST(ordinal AS BIGINT) AS ordinal, name, coalesce(data_type, 'varchar(' || (10 + s_nationkey) || ')') AS data_type, nullable, false AS primary_key, auto_increment,
  CAST(CASE WHEN name = 'name' THEN 10 + s_nationkey ELSE length END AS BIGINT) AS length, CASE name WHEN 'name' THEN 'n' || s_nationkey WHEN 'kind' THEN 'a' END AS "default" FROM supplier, c""")
def ddl_columns(t: Tables) -> DataFrame:
    return ddl.column_details(texts.DDL.frame(t))


@query("""
SELECT 't' || s_suppkey AS "table", CASE k WHEN 1 THEN 'PRIMARY' WHEN 2 THEN 'uq_' || s_nationkey ELSE 'idx_t' || s_suppkey || '_1' END AS name, CASE k WHEN 1 THEN 'id' WHEN 2 THEN 'name,kind' ELSE 'nation_id' END AS columns, k < 3 AS is_unique
FROM supplier, (VALUES (1), (2), (3)) v(k)""")
def ddl_indexes(t: Tables) -> DataFrame:
    return ddl.indexes(texts.DDL.frame(t)).select("table", "name", joined("columns"), "is_unique")


@query("""
SELECT 't' || s_suppkey AS "table", 'fk_n' AS name, 'nation_id' AS columns, 'nation' AS ref_table, 'id' AS ref_columns, 'CASCADE' AS on_delete, 'NO ACTION' AS on_update FROM supplier
UNION ALL SELECT 't' || s_suppkey, 'fk_t' || s_suppkey || '_kinds', 'kind', 'kinds', 'code', 'NO ACTION', 'SET NULL' FROM supplier""")
def ddl_foreign_keys(t: Tables) -> DataFrame:
    return ddl.foreign_keys(texts.DDL.frame(t)).select("table", "name", joined("columns"), "ref_table", joined("ref_columns"), "on_delete", "on_update")


@query("""SELECT 't' || s_suppkey AS "table", 'InnoDB' AS engine, 'utf8' AS charset FROM supplier""")
def ddl_options(t: Tables) -> DataFrame:
    return ddl.table_options(texts.DDL.frame(t))


@query("""
SELECT 't' || s_suppkey AS "table", 'id int(11) required auto; name varchar(' || (10 + s_nationkey) || '); nation_id bigint(20) required; kind enum(''a'',''b'')' AS columns FROM supplier""")
def schema_condensed(t: Tables) -> DataFrame:
    return modules.condensed_schema(sqltext.ddl_columns(texts.DDL.frame(t))).select("table", F.array_join("columns", "; ").alias("columns"))


# Server configuration --------------------------------------------------------------------------------------------------------------


@query(f"""
SELECT {R} AS path, CAST(CASE k WHEN 1 THEN 3 ELSE 6 END AS BIGINT) AS line, CASE k WHEN 1 THEN '/item' || c_nationkey || '/:id/:param2' ELSE '/api/v' || c_nationkey % 3 || '/list' END AS template, CASE k WHEN 1 THEN 'id,param2' ELSE '' END AS params,
  CASE k WHEN 1 THEN 'POST' ELSE 'GET' END AS method, CAST(CASE k WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS n_conditions, k = 2 AS is_redirect, CASE k WHEN 1 THEN 'item.php' ELSE 'api.php' END AS target_file,
  CASE k WHEN 1 THEN 'id,k' ELSE '' END AS query_params, k = 2 AS is_api, CAST(k - 1 AS BIGINT) AS priority FROM customer, (VALUES (1), (2)) v(k)""")
def rewrite_rules(t: Tables) -> DataFrame:
    found = webconf.rewrite_rules(texts.REWRITES.frame(t))
    return found.select("path", "line", "template", joined("params"), "method", "n_conditions", "is_redirect", "target_file", joined("query_params"), "is_api", "priority")


@query(f"""
SELECT {N} AS path, CASE k WHEN 1 THEN '/api' || c_nationkey ELSE '^/x' || c_nationkey || '/([0-9]+)$' END AS pattern, CASE k WHEN 1 THEN '/api' || c_nationkey ELSE '/x' || c_nationkey || '/:id' END AS template, CASE k WHEN 1 THEN '/index.php' ELSE '/x.php' END AS target
FROM customer, (VALUES (1), (2)) v(k)""")
def nginx_locations(t: Tables) -> DataFrame:
    return webconf.nginx_locations(texts.NGINX.frame(t))


@query(f"""
SELECT {N} AS path, '^/a' || c_nationkey || '/(.*)$' AS pattern, '/a' || c_nationkey || '/:param1' AS template, '/b.php' AS target FROM customer""")
def nginx_rewrites(t: Tables) -> DataFrame:
    return webconf.nginx_rewrites(texts.NGINX.frame(t))


_CONFIGS = "(SELECT CASE c_custkey % 5 WHEN 0 THEN '/a/db' || c_custkey || '.sql' WHEN 1 THEN '/etc/nginx/site' || c_custkey || '.conf' WHEN 2 THEN '/etc/httpd/x' || c_custkey || '.conf' WHEN 3 THEN '/w' || c_custkey || '/.htaccess' ELSE '/w/x' || c_custkey || '.php' END AS path, CASE c_custkey % 5 WHEN 0 THEN 'sql' WHEN 1 THEN 'nginx' WHEN 2 THEN 'apache' WHEN 3 THEN 'htaccess' END AS kind FROM customer)"


@query(f"""
SELECT kind, path, n, n = 1 OR kind NOT IN ('sql', 'nginx') AS is_used FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY path) AS n FROM {_CONFIGS} WHERE kind IS NOT NULL)""")
def config_discovery(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    forms = ["/a/db«c_custkey».sql", "/etc/nginx/site«c_custkey».conf", "/etc/httpd/x«c_custkey».conf", "/w«c_custkey»/.htaccess", "/w/x«c_custkey».php"]
    path = F.coalesce(*[F.when(k % 5 == i, texts.line_column(f)) for i, f in enumerate(forms)])
    return discovery.discovered(t.customer.select(path.alias("path")))


@query("""
SELECT 'part_' || p_partkey AS "table", CASE k WHEN 1 THEN 'id' WHEN 2 THEN 'name' || p_size % 3 ELSE 'created' END AS "column" FROM part, (VALUES (1), (2), (3)) v(k)""")
def entity_columns(t: Tables) -> DataFrame:
    return discovery.entity_columns(texts.ENTITIES.frame(t))


@query("""
SELECT n || p_partkey AS dto, CASE k WHEN 1 THEN 'id' ELSE 'nameof' || p_size % 3 END AS field FROM part, (VALUES ('create_part_'), ('part_')) a(n), (VALUES (1), (2)) v(k)""")
def dto_fields(t: Tables) -> DataFrame:
    return discovery.dto_fields(texts.DTOS.frame(t))


# Rule families ----------------------------------------------------------------------------------------------------------------------


def rule_table(rules: Sequence[Rule]) -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({q(r.rule_id)}, {q(r.type)}, {q(r.severity)}, {q(r.pattern)}, {r.snippet_len}, {r.group})" for r in rules)
    return f"(VALUES {rows}) r(rule_id, type, severity, pattern, snippet_len, grp)"


def hits_sql(rules: Sequence[Rule]) -> str:
    lines = f"(SELECT path, unnest(string_split(content, chr(10))) AS content, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM {texts.SAMPLED})"
    return f"""(SELECT path, rule_id, type, severity, CAST(line AS BIGINT) AS line, coalesce(substring(x, 1, snippet_len), '') AS snippet FROM (
      SELECT path, rule_id, type, severity, line, snippet_len, unnest(CASE grp WHEN 0 THEN regexp_extract_all(content, pattern) ELSE regexp_extract_all(content, pattern, 1) END) AS x
      FROM {lines}, {rule_table(rules)} WHERE regexp_matches(content, pattern)))"""


FAMILIES = {
    "security": rule_sets.SECURITY, "config": rule_sets.CONFIG, "external_api": rule_sets.EXTERNAL_API, "transaction": rule_sets.TRANSACTIONS, "event": rule_sets.EVENTS, "error": rule_sets.ERRORS,
    "pagination": rule_sets.PAGINATION, "cache": rule_sets.CACHE, "rate_limit": rule_sets.RATE_LIMIT, "auth": rule_sets.AUTH, "resilience": rule_sets.RESILIENCE, "logging": rule_sets.LOGGING,
    "database": rule_sets.DATABASE, "include": rule_sets.INCLUDES, "side_effect": rule_sets.SIDE_EFFECTS,
}


def in_lines(rules: Sequence[Rule]) -> list[Rule]:
    return [r for r in rules if not r.multiline]


def family_findings(t: Tables, family: str) -> DataFrame:
    found = scan.scan_lines(texts.sampled(t), in_lines(FAMILIES[family]), "path", "content")
    return found.select("path", "rule_id", "family", "type", "severity", "line", "snippet")


def _register(family: str) -> None:
    def rows(t: Tables) -> DataFrame:
        return family_findings(t, family).drop("family")

    rows.__name__ = f"php_{family}"
    query(f"SELECT * FROM {hits_sql(in_lines(FAMILIES[family]))}")(rows)


for _family in FAMILIES:
    _register(_family)


_ACROSS = [r for r in rule_sets.ALL if r.multiline]


@query(f"""
SELECT path, rule_id, CAST(len(regexp_extract_all(content, pattern)) AS BIGINT) AS n_matches FROM {texts.SAMPLED}, {rule_table(_ACROSS)} WHERE regexp_matches(content, pattern)""")
def php_across_lines(t: Tables) -> DataFrame:
    return php.findings(texts.sampled(t), _ACROSS).groupBy("path", "rule_id").agg(F.count("*").alias("n_matches"))


_ADVICE = " ".join(f"WHEN '{k}' THEN '{v[1]}'".replace("aren't", "aren''t") for k, v in rule_sets.ADVICE.items())


@query(f"""
SELECT type, CASE type {_ADVICE} END AS recommendation, count(*) AS n FROM {hits_sql(rule_sets.SECURITY)} GROUP BY type""")
def security_advice(t: Tables) -> DataFrame:
    return php.with_advice(family_findings(t, "security")).groupBy("type", "recommendation").agg(F.count("*").alias("n"))


@query(f"""
WITH h AS (SELECT * FROM {hits_sql(rule_sets.TRANSACTIONS)})
SELECT path, line, type, CASE WHEN type = 'lock' THEN CASE WHEN snippet ILIKE 'for%' THEN 'row' WHEN snippet ILIKE '%share%' THEN 'share' WHEN snippet ILIKE 'lock%' THEN 'table' WHEN snippet ILIKE 'get_lock%' THEN 'named' WHEN snippet ILIKE 'flock%' THEN 'file' ELSE 'semaphore' END END AS lock_type,
  bool_or(type = 'rollback') OVER (PARTITION BY path) AS has_rollback FROM h""")
def transaction_locks(t: Tables) -> DataFrame:
    return php.transactions(family_findings(t, "transaction")).select("path", "line", "type", "lock_type", "has_rollback")


@query(f"""
SELECT path, line, type, CASE WHEN regexp_full_match(snippet, '[\\w.:/-]+') THEN snippet ELSE 'unknown' END AS name, type IN ({", ".join(f"'{x}'" for x in rule_sets.PRODUCERS)}) AS is_producer FROM {hits_sql(rule_sets.EVENTS)}""")
def event_names(t: Tables) -> DataFrame:
    return php.events(family_findings(t, "event")).select("path", "line", "type", "name", "is_producer")


@query(f"""
SELECT path, string_agg(DISTINCT snippet, ',' ORDER BY snippet) AS codes FROM {hits_sql(rule_sets.ERRORS)} WHERE type = 'http_code' GROUP BY path""")
def http_codes(t: Tables) -> DataFrame:
    return php.http_codes(family_findings(t, "error")).select("path", joined("codes"))


@query(f"""
SELECT path, line, type, CASE WHEN type = 'counter' THEN TRY_CAST(snippet AS BIGINT) END AS limit_value, CASE WHEN type = 'window' THEN TRY_CAST(snippet AS BIGINT) END AS window_seconds FROM {hits_sql(rule_sets.RATE_LIMIT)}""")
def rate_limit_values(t: Tables) -> DataFrame:
    return php.rate_limits(family_findings(t, "rate_limit")).select("path", "line", "type", "limit_value", "window_seconds")


@query(f"""
WITH h AS (SELECT DISTINCT path, type, snippet FROM {hits_sql(rule_sets.AUTH)} WHERE type IN ('role', 'permission'))
SELECT path, snippet AS role, '' AS permissions FROM h WHERE type = 'role'
UNION ALL SELECT path, 'default', string_agg(snippet, ',' ORDER BY snippet) FROM h WHERE type = 'permission' GROUP BY path""")
def auth_roles(t: Tables) -> DataFrame:
    return php.roles(family_findings(t, "auth")).select("path", F.explode("roles").alias("role", "p")).select("path", "role", F.array_join("p", ",").alias("permissions"))


@query(f"""
SELECT path, line, CASE WHEN type = 'error_log' THEN 'error' ELSE coalesce(nullif(lower(regexp_extract(snippet, '(?i)\\b(emergency|alert|critical|error|warning|notice|info|debug)\\b', 1)), ''), 'info') END AS level, contains(snippet, '$') AS has_context FROM {hits_sql(rule_sets.LOGGING)}""")
def log_levels(t: Tables) -> DataFrame:
    return php.log_levels(family_findings(t, "logging")).select("path", "line", "level", "has_context")


@query(f"""
SELECT types, has_sort, count(*) AS n FROM (
  SELECT m.path, m.line, m.types, s.path IS NOT NULL AS has_sort FROM (SELECT path, line, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM {hits_sql(rule_sets.PAGINATION)} WHERE type <> 'sort' GROUP BY path, line) m
  LEFT JOIN (SELECT DISTINCT path FROM {hits_sql(rule_sets.PAGINATION)} WHERE type = 'sort') s ON s.path = m.path) GROUP BY types, has_sort""")
def pagination_lines(t: Tables) -> DataFrame:
    return php.pagination(family_findings(t, "pagination")).groupBy("types", "has_sort").agg(F.count("*").alias("n"))


_VALUES = [("MAX", "define", "5", "define('MAX', 5);"), ("debug", "config_array", "true", "$config['debug'] = true;"), ("db_host", "database_variable", "localhost", "$db_host = 'localhost';"), ("smtp_host", "mail_variable", "mail", "$smtp_host = 'mail';"), ("api_key", "key_variable", "abc", "$api_key = 'abc';"), ("base_url", "path_variable", "/", "$base_url = '/';")]
_VALUE_TABLE = ", ".join("('{}', '{}', '{}', '{}')".format(a, b, c, d.replace("'", "''")) for a, b, c, d in _VALUES)


@query(f"""
WITH l AS (SELECT path, unnest(string_split(content, chr(10))) AS content, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM {texts.SAMPLED})
SELECT path, CAST(line AS BIGINT) AS line, kind, name, value FROM l JOIN (VALUES {_VALUE_TABLE}) v(name, kind, value, text) ON content = text""")
def config_values(t: Tables) -> DataFrame:
    return php.config_values(texts.sampled(t))


@query(f"""
SELECT path, regexp_matches(content, '(?i)SELECT|INSERT|UPDATE|DELETE|mysql_query|mysqli_query|->query|->prepare') AS has_sql, regexp_matches(content, '(?i)<html|<body|<div|<form|<table|echo\\s+["'']<|print\\s+["'']<') AS has_html FROM {texts.SAMPLED}""")
def segment_flags(t: Tables) -> DataFrame:
    return texts.sampled(t).select("path", *synthesis.segment_flags(F.col("content")))


# Synthesis --------------------------------------------------------------------------------------------------------------------------

_ROUTES = "(SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '/p' || page_id % 20 AS path, CASE WHEN page_id % 11 > 0 THEN '/w/f' || page_id % 7 || '.php' END AS target FROM pages)"


def _routes(t: Tables) -> DataFrame:
    k = F.col("page_id")
    target = F.when(k % 11 > 0, texts.line_column("/w/f«page_id % 7».php"))
    return t.pages.select("page_id", F.when(k % 2 == 0, "GET").otherwise("POST").alias("method"), texts.line_column("/p«page_id % 20»").alias("path"), target.alias("target"))


@query(f"""
SELECT method || ' ' || path AS route, 'f' || arg_max(page_id, page_id) % 7 || '.php' AS file FROM {_ROUTES} WHERE target IS NOT NULL GROUP BY method, path""")
def routes_with_files(t: Tables) -> DataFrame:
    return synthesis.routes_with_files(_routes(t), "page_id")


@query(f"""
SELECT 'f' || page_id % 7 || '.php' AS file, row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) AS n, method || ' ' || path AS route FROM {_ROUTES} WHERE target IS NOT NULL""")
def files_with_routes(t: Tables) -> DataFrame:
    return synthesis.files_with_routes(_routes(t), "page_id")


@query("""
WITH f AS (SELECT event_type AS name, user_id, count(*) AS total_calls FROM events GROUP BY 1, 2), e AS (SELECT DISTINCT event_type AS m FROM events UNION ALL SELECT 'login'),
j AS (SELECT m, coalesce(arg_min(total_calls, user_id), 0) AS calls FROM e LEFT JOIN f ON f.name = m GROUP BY m),
p AS (SELECT m, calls, calls > 2 AS hot, CASE WHEN contains(m, 'auth') OR contains(m, 'login') THEN 'critical' WHEN calls > 2 OR calls >= 20 THEN 'high' WHEN calls >= 5 THEN 'normal' ELSE 'low' END AS priority FROM j)
SELECT 'x.' || m AS pattern, m AS method_name, priority, CAST(CASE priority WHEN 'critical' THEN 2500 WHEN 'high' THEN 5000 WHEN 'normal' THEN 7500 ELSE 10000 END AS BIGINT) AS timeout_ms, priority <> 'critical' AS retry_enabled,
  CAST(CASE priority WHEN 'critical' THEN 2 ELSE 3 END AS BIGINT) AS max_attempts, CAST(CASE priority WHEN 'critical' THEN 50 ELSE 100 END AS BIGINT) AS initial_delay_ms, CAST(CASE priority WHEN 'critical' THEN 3 ELSE 5 END AS BIGINT) AS failure_threshold,
  CAST(CASE priority WHEN 'critical' THEN 15000 ELSE 30000 END AS BIGINT) AS breaker_timeout_ms, priority <> 'critical' AS fallback_enabled, CASE WHEN hot THEN 'cache' ELSE 'error' END AS fallback FROM p""")
def endpoint_resilience(t: Tables) -> DataFrame:
    frequency = t.events.groupBy(F.col("event_type").alias("name"), "user_id").agg(F.count("*").alias("total_calls")).withColumn("is_hot", F.col("total_calls") > 2)
    names = t.events.select(F.col("event_type").alias("method_name")).distinct().unionByName(t.region.limit(1).select(F.lit("login").alias("method_name")))
    return synthesis.endpoint_resilience(names.select(F.concat(F.lit("x."), "method_name").alias("pattern"), "method_name"), frequency, "user_id")


@query("""
SELECT event_id, event_type AS class_name, 'm' || user_id % 5 AS member, event_type || '.m' || user_id % 5 AS message FROM events WHERE user_id % 5 < 3 AND event_type <> 'error'""")
def mapped_calls(t: Tables) -> DataFrame:
    sites = t.events.select("event_id", F.col("event_type").alias("class_name"), texts.line_column("m«user_id % 5»").alias("member"))
    mapping = t.events.where("user_id % 5 < 3 and event_type <> 'error'").select(F.col("event_type").alias("class_name"), texts.line_column("m«user_id % 5»").alias("method")).distinct()
    return synthesis.mapped_calls(sites, mapping.withColumn("message", F.concat_ws(".", "class_name", "method"))).select("event_id", "class_name", "member", "message")


_USES = "(SELECT DISTINCT 'N' || s_nationkey AS module, l_partkey AS tab FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"


def _uses(t: Tables) -> DataFrame:
    return t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(texts.line_column("N«s_nationkey»").alias("module"), F.col("l_partkey").alias("table")).distinct()


@query(f"""
SELECT x.module AS a, y.module AS b, count(*) AS n_shared FROM {_USES} x JOIN {_USES} y ON x.tab = y.tab AND x.module < y.module GROUP BY 1, 2""")
def module_pairs(t: Tables) -> DataFrame:
    return synthesis.module_pairs(_uses(t))


_RULES = [(f"N{i}", f"N{(i * 7 + 3) % 25}") for i in range(25)]


@query(f"""
SELECT DISTINCT name, needs FROM (VALUES {", ".join(map(str, _RULES))}) r(name, needs) JOIN {_USES} x ON x.module = name JOIN {_USES} y ON y.module = needs AND x.tab = y.tab WHERE name <> needs""")
def module_dependencies(t: Tables) -> DataFrame:
    return synthesis.module_dependencies(_uses(t), _RULES)


@query("""
SELECT coalesce(event_type, 'all') AS operation, count(*) AS n, count(DISTINCT CASE WHEN user_id % 7 > 0 THEN user_id % 7 END) AS n_tables FROM events GROUP BY GROUPING SETS ((event_type), ())""")
def database_patterns(t: Tables) -> DataFrame:
    table = F.when(F.col("user_id") % 7 > 0, texts.line_column("t«user_id % 7»")).otherwise("")
    return synthesis.database_patterns(t.events.select(table.alias("table"), F.col("event_type").alias("type")))


@query("""
WITH m AS (SELECT len(string_split(text, chr(10))) * 100 AS total_lines, 1 + length(text) // 5000 AS chunk_count FROM documents)
SELECT count(*) AS total_files, CAST(sum(chunk_count) AS BIGINT) AS total_chunks, CAST(sum(total_lines) AS BIGINT) AS total_lines, CAST(sum(greatest(1, (total_lines + 399) // 400)) AS BIGINT) AS total_jobs FROM m""")
def chunk_totals(t: Tables) -> DataFrame:
    rows = t.documents.select((F.size(F.split("text", "\n", -1)) * 100).cast("long").alias("total_lines"), (1 + F.floor(F.length("text") / 5000)).alias("chunk_count"))
    return synthesis.chunk_totals(rows)


@query("""
SELECT doc_id, CAST(len(string_split(text, chr(10))) * 100 AS BIGINT) AS n_lines FROM documents WHERE contains(text, '@') AND len(string_split(text, chr(10))) * 100 > 400""")
def large_entries(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "text", (F.size(F.split("text", "\n", -1)) * 100).cast("long").alias("n_lines"))
    return synthesis.large_entries(rows, F.contains("text", F.lit("@"))).select("doc_id", "n_lines")


@query(f"""
SELECT count(*) AS total_modules, count(*) FILTER (WHERE n_lines > 60) AS total_microservices, count(*) FILTER (WHERE n_lines <= 60) AS total_gateway_modules, CAST(sum(n_lines) AS BIGINT) AS total_routes, CAST(sum(complexity) AS BIGINT) AS total_tables,
  CAST(sum(security) AS BIGINT) AS total_security_issues, count(*) FILTER (WHERE security > 10 OR complexity > 300) AS n_high_risk FROM {MODULES}""")
def synthesis_summary(t: Tables) -> DataFrame:
    from srclens.operators import rollup

    m = module_rows(t).select(
        "name", (F.col("n_lines") > 60).alias("is_microservice"), rollup.risk_bucket(F.col("security"), F.col("complexity")).alias("risk"), F.col("n_lines").alias("n_routes"),
        F.col("complexity").alias("n_tables"), F.col("security").alias("n_security"),
    )
    return synthesis.synthesis_summary(m)


_OWNED = """(SELECT l_partkey, CASE WHEN sw AND mw THEN 'shared' WHEN sw THEN 'submodule_owned' WHEN mw THEN 'main_owned' WHEN sr THEN 'read_only' ELSE 'unknown' END AS ownership FROM (
  SELECT l_partkey, bool_or(l_linestatus = 'O' AND NOT w) AS sr, bool_or(l_linestatus = 'O' AND w) AS sw, bool_or(l_linestatus <> 'O' AND w) AS mw FROM (SELECT *, l_returnflag = 'R' AND l_quantity > 45 AS w FROM lineitem) GROUP BY l_partkey))"""


def _owned(t: Tables) -> DataFrame:
    return QUERIES["ownership_class"](t.spark, t.sf_dir).select(F.concat(F.lit("part_"), F.col("table").cast("string")).alias("table"), "ownership")


@query(f"""
SELECT *, CASE WHEN n_shared > 0 THEN 'high' WHEN n_read_only > 0 THEN 'medium' ELSE 'low' END AS complexity FROM (SELECT count(*) AS n_tables, count(*) FILTER (WHERE ownership = 'submodule_owned') AS n_owned, count(*) FILTER (WHERE ownership = 'main_owned') AS n_main,
  count(*) FILTER (WHERE ownership = 'shared') AS n_shared, count(*) FILTER (WHERE ownership = 'read_only') AS n_read_only FROM {_OWNED})""")
def ownership_summary(t: Tables) -> DataFrame:
    return synthesis.ownership_summary(_owned(t))


@query(f"""
SELECT CASE ownership WHEN 'shared' THEN 'high' WHEN 'submodule_owned' THEN 'medium' ELSE 'low' END AS priority, CASE ownership WHEN 'shared' THEN 'shared_data' WHEN 'submodule_owned' THEN 'data_migration' ELSE 'read_access' END AS category, count(*) AS n_tables, min('part_' || l_partkey) AS first_table
FROM {_OWNED} WHERE ownership IN ('shared', 'submodule_owned', 'read_only') GROUP BY ownership""")
def ownership_recommendations(t: Tables) -> DataFrame:
    return synthesis.ownership_recommendations(_owned(t))


@query(f"""
SELECT 'part_' || l_partkey AS "table", 'Part' || l_partkey AS entity_name, CASE ownership WHEN 'shared' THEN 'shared' ELSE 'full' END AS ownership FROM {_OWNED} WHERE ownership IN ('shared', 'submodule_owned')""")
def database_context(t: Tables) -> DataFrame:
    return synthesis.database_context(_owned(t))


@query("""
SELECT count(*) AS total_contracts, count(*) FILTER (WHERE p_size % 3 = 0) AS public_methods, count(*) FILTER (WHERE p_size % 2 = 0) AS static_methods, count(*) FILTER (WHERE p_size % 4 = 1) AS with_db_reads, count(*) FILTER (WHERE p_size % 4 >= 2) AS with_db_writes,
  count(*) FILTER (WHERE p_size % 4 = 3) AS with_session, CAST(sum(p_partkey % 5) AS BIGINT) AS total_callers, count(DISTINCT CASE WHEN p_size % 4 = 1 THEN p_brand END) AS n_tables_read, count(DISTINCT CASE WHEN p_size % 4 = 2 THEN p_brand END) AS n_tables_written FROM part WHERE p_partkey % 5 > 0""")
def contract_summary(t: Tables) -> DataFrame:
    size = F.col("p_size") % 4
    effect = lambda kind, table: F.struct(F.lit(kind).alias("type"), table.cast("string").alias("table"))
    none = F.lit(None)
    effects = (
        F.when(size == 1, F.array(effect("database_read", F.col("p_brand")))).when(size == 2, F.array(effect("database_write", F.col("p_brand"))))
        .when(size == 3, F.array(effect("database_write", none), effect("session", none))).otherwise(F.array().cast("array<struct<type:string,table:string>>"))
    )
    rows = t.part.select(F.when(F.col("p_size") % 3 == 0, "public").otherwise("private").alias("visibility"), (F.col("p_size") % 2 == 0).alias("is_static"), (F.col("p_partkey") % 5).alias("n_callers"), effects.alias("effects"))
    return synthesis.contract_summary(rows)


@query("""
WITH m AS (SELECT n_name AS module, n_nationkey FROM nation)
SELECT module, lower(module) || '_service' AS service, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_endpoints, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_entities FROM m""")
def service_context(t: Tables) -> DataFrame:
    m = t.nation.select(F.col("n_name").alias("module"), F.concat(F.lit("modules/"), "n_name").alias("path"), "n_nationkey")
    of = lambda df, key: df.join(m, F.col(key) == F.col("n_nationkey")).select("module")
    return synthesis.service_context(m.select("module", "path"), of(t.supplier, "s_nationkey"), of(t.customer, "c_nationkey"))


@query("""
WITH c AS (SELECT c_custkey, c_nationkey, c_custkey % 4 AS k FROM customer)
SELECT c_custkey, 'shop.cart.get_' || c_nationkey AS message, 'Get' || c_nationkey || 'Request' AS request_type, CASE k WHEN 0 THEN '{ items, total }' WHEN 1 THEN '{ success }' WHEN 2 THEN '{ data: number | null }' ELSE '{ data: any }' END AS response_type FROM c""")
def endpoint_types(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 4
    rows = t.customer.select(
        "c_custkey", F.lit("Shop").alias("service"), F.lit("CartService").alias("class_name"), texts.line_column("get_«c_nationkey»").alias("method"),
        F.when(k == 0, "array").alias("hint"), F.when(k == 1, "void").alias("doc"), F.when(k == 2, "?int").alias("inferred"),
    )
    return modules.endpoints(rows).select("c_custkey", "message", "request_type", "response_type")


@query("""
WITH n AS (SELECT p_partkey, lower(p_brand) AS b FROM part)
SELECT p_partkey, 'Part' || p_partkey AS entity_name, 'part_' || p_partkey AS snake, 'part-' || p_partkey AS kebab, 'part' || p_partkey AS camel FROM part""")
def name_forms(t: Tables) -> DataFrame:
    table = texts.line_column("part_«p_partkey»")
    return t.part.select("p_partkey", derive.entity_name(table).alias("entity_name"), naming.snake(table).alias("snake"), naming.kebab(table).alias("kebab"), naming.camel(table).alias("camel"))


@query(f"""
SELECT {P} AS path, CASE WHEN f = 1 THEN 'load_' || p_partkey ELSE 'find' END AS name, param, type FROM part, (VALUES (1, 'id', 'int'), (1, 'opts', 'array'), (2, 'id', '?int'), (2, 'row', NULL)) v(f, param, type)""")
def code_parameter_types(t: Tables) -> DataFrame:
    files = texts.PHP.frame(t)
    return php.with_doc_types(php.parameters(code.functions(files)), code.phpdoc(files)).select("path", "name", "param", "type")


_SINGLE = texts.Corpus("part", "/s/c«p_partkey».php", ["class Keeper«p_size % 4» {", "  private static $«CASE WHEN p_size % 2 = 0 THEN 'instance' ELSE 'other' END»;", "}", "$x = Cache«p_size % 3»::getInstance(); self::getInstance();"])


@query("""
SELECT '/s/c' || p_partkey || '.php' AS path, 'Cache' || p_size % 3 AS class_name FROM part UNION ALL SELECT '/s/c' || p_partkey || '.php', 'Keeper' || p_size % 4 FROM part WHERE p_size % 2 = 0""")
def code_singletons(t: Tables) -> DataFrame:
    return code.singletons(_SINGLE.frame(t))


_FRONT = texts.Corpus("customer", "/w/«c_custkey»/.htaccess", ["RewriteCond %{REQUEST_FILENAME} !-f", "RewriteRule «CASE WHEN c_nationkey % 2 = 0 THEN '^(.*)$' ELSE '^a/(.*)$' END» index.php?q=$1 [QSA,L]", "RewriteRule ^old$ new.php [R=301]"])


@query("""
SELECT '/w/' || c_custkey || '/.htaccess' AS path, CAST(2 AS BIGINT) AS n_rules, CAST(1 AS BIGINT) AS n_conditions, 'L,QSA,R' AS flags, c_nationkey % 2 = 0 AS is_front_controller FROM customer""")
def rewrite_summary(t: Tables) -> DataFrame:
    return webconf.rewrite_summary(_FRONT.frame(t)).select("path", "n_rules", "n_conditions", joined("flags"), "is_front_controller")


_WORDS = {"user": "users", "auth": "auth", "pay": "payments", "cart": "cart"}


@query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'cart' WHEN 1 THEN 'users' WHEN 2 THEN 'payments' WHEN 3 THEN 'core' ELSE 'users' END AS domain FROM customer""")
def domain_of_path(t: Tables) -> DataFrame:
    forms = ["/user/lib/a/my_cart.php", "/x/User-Auth.php", "/auth/b/pa_y/z.php", "/user/a/b/c.php", "/a/users/b.php"]
    path = F.coalesce(*[F.when(F.col("c_custkey") % 5 == i, F.lit(f)) for i, f in enumerate(forms)])
    return t.customer.select("c_custkey", conditions.domain_of_path(path, _WORDS, "core").alias("domain"))


@query("""
WITH p AS (SELECT row_number() OVER (ORDER BY event_type) AS place, event_type AS phase FROM (SELECT DISTINCT event_type FROM events)),
l AS (SELECT event_type AS phase, arg_max(CASE WHEN user_id % 2 = 0 THEN 'completed' ELSE 'failed' END, event_id) AS status FROM events GROUP BY 1)
SELECT phase FROM p WHERE phase <> 'click' AND phase NOT IN (SELECT phase FROM l WHERE status = 'completed')""")
def phases_to_run(t: Tables) -> DataFrame:
    names = t.events.select(F.col("event_type").alias("phase")).distinct()
    log = t.events.select(F.col("event_type").alias("phase"), F.when(F.col("user_id") % 2 == 0, "completed").otherwise("failed").alias("status"), F.col("event_id").alias("at"))
    return files.phases_to_run(names.withColumn("place", F.lit(1)), log, ["click"]).select("phase")


@query("""
SELECT 'success' AS "case", count(*) AS n FROM customer UNION ALL SELECT 'not_found', count(*) FILTER (WHERE c_custkey % 3 = 0) FROM customer""")
def interaction_summary(t: Tables) -> DataFrame:
    rows = t.customer.select(texts.line_column("m.«c_custkey»").alias("message"), F.when(F.col("c_custkey") % 3 == 0, "getAll").otherwise("save").alias("method"))
    return modules.interaction_summary(modules.interactions(rows))


# Operators on rows that other queries don't reach ------------------------------------------------------------------------------------


@query("""
WITH u AS (SELECT 0 AS source_rank, c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT 1, s_suppkey, s_name FROM supplier)
SELECT source_rank::BIGINT AS source_rank, k, name, row_number() OVER (PARTITION BY source_rank ORDER BY name, k) - 1 AS priority FROM u""")
def routes_by_priority(t: Tables) -> DataFrame:
    sources = [t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))]
    return routes.union_by_priority(sources, ["name", "k"]).select("source_rank", "k", "name", "priority")


@query("""
WITH f AS (SELECT p_brand AS c, p_size AS n, count(*) AS total_calls, count(*) >= 3 AS is_hot FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL)
SELECT p_partkey, CAST(coalesce(total_calls, 0) AS BIGINT) AS total_calls, coalesce(is_hot, false) AS is_hot FROM part LEFT JOIN f ON (CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END) IS NOT DISTINCT FROM c AND p_size = n""")
def contract_frequency(t: Tables) -> DataFrame:
    f = t.part.where("p_partkey % 2 = 0").groupBy(F.col("p_brand").alias("class_name"), F.col("p_size").alias("name")).agg(F.count("*").alias("total_calls")).withColumn("is_hot", F.col("total_calls") >= 3)
    contracts = t.part.select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("class_name"), F.col("p_size").alias("method"))
    return modules.with_frequency(contracts, f).select("p_partkey", "total_calls", "is_hot")


@query("""
SELECT o_custkey AS k, count(*) AS total_calls FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) GROUP BY o_custkey""")
def cacheable_read_calls(t: Tables) -> DataFrame:
    effects = t.orders.select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderpriority") == "1-URGENT", "database_write").when(F.col("o_orderpriority") == "2-HIGH", "file_write").otherwise("database_read").alias("effect"))
    return modules.cacheable_reads(t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("total_calls")), effects, "k")


@query("""
WITH f AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT 'u' || user_id || '_calls_total' AS metric, 'counter' AS kind FROM (SELECT * FROM f ORDER BY n DESC, 'u' || user_id LIMIT 20) UNION ALL SELECT 'u' || user_id || '_seconds', 'histogram' FROM (SELECT * FROM f WHERE n >= 5 ORDER BY n DESC, 'u' || user_id LIMIT 10)
UNION ALL SELECT * FROM (VALUES ('requests_total', 'counter'), ('errors_total', 'counter'), ('request_seconds', 'histogram'), ('in_flight', 'gauge'))""")
def metric_rows(t: Tables) -> DataFrame:
    f = t.events.groupBy("user_id").agg(F.count("*").alias("total_calls")).select(F.concat(F.lit("u"), "user_id").alias("k"), "total_calls", (F.col("total_calls") >= 5).alias("is_hot"))
    return modules.metric_definitions(f, "k")


@query("""
SELECT name AS module, lower(replace(replace(name, ' ', '-'), '_', '-')) AS project, CAST(3000 + row_number() OVER (ORDER BY place, name) AS BIGINT) AS port FROM (SELECT n_name AS name, n_regionkey AS place FROM nation ORDER BY n_regionkey, n_name LIMIT 15)""")
def workspace_rows(t: Tables) -> DataFrame:
    return modules.workspace(t.nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("place")))


@query(f"""
WITH u AS (SELECT {P} AS path, 20 AS line, (p_partkey + 1) % 100 AS k, 'Part' || (p_partkey + 1) % 100 AS old, '$shopCartClient' AS new FROM part UNION ALL SELECT {P}, 22, p_partkey % 50, 'Part' || p_partkey % 50 || '::find(', '$shopCartClient->find(' FROM part)
SELECT path, CAST(line AS BIGINT) AS line, old, new FROM u WHERE k IN (SELECT p_partkey FROM part)""")
def code_replacements(t: Tables) -> DataFrame:
    own = texts.PHP.frame(t)
    return modules.replacements(calls.class_usages(own, code.classes(own)).withColumn("service", F.lit("shop_cart")))


@query("""
SELECT DISTINCT CASE WHEN contains(lower(p_type), 'brass') THEN 'metal' WHEN contains(lower(p_type), 'steel') THEN 'metal' WHEN contains(lower(p_type), 'small') THEN 'little' ELSE p_type END AS cluster, p_brand AS file FROM part""")
def clusters_merged(t: Tables) -> DataFrame:
    return modules.merged_clusters(t.part.select(F.col("p_type").alias("cluster"), F.col("p_brand").alias("file")), {"brass": "metal", "steel": "metal", "small": "little"})


@query(f"""
WITH p AS (SELECT {P} AS path, p_size FROM part) SELECT path, 'SELECT id, size FROM part_' || p_size % 3 || ' WHERE id = 1' AS literal FROM p""")
def code_sql_literals(t: Tables) -> DataFrame:
    return texts.PHP.frame(t).select("path", F.explode(sqltext.sql_literals(F.col("content"))).alias("literal"))


@query("""
SELECT o_orderkey, 'shop.' || lower(replace(split_part(o_orderpriority, '-', 2), ' ', '_')) || '_cart.get_' || (o_orderkey % 9) || '_rows' AS message, 'get-' || (o_orderkey % 9) || '-rows' AS plain FROM orders""")
def message_names(t: Tables) -> DataFrame:
    word = F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)))
    made = t.orders.select("o_orderkey", F.concat(F.initcap(F.when(word == "", "").otherwise(word)), F.lit("CartService")).alias("c"), F.concat(F.lit("get_"), F.col("o_orderkey") % 9, F.lit("_rows")).alias("m"))
    return made.select("o_orderkey", naming.message_pattern(F.lit("Shop"), F.col("c"), F.col("m")).alias("message"), naming.kebab_plain(F.col("m")).alias("plain"))


@query("SELECT unnest(CASE WHEN count(*) > 100 THEN ['many', 'some'] WHEN count(*) > 0 THEN ['some'] ELSE [] END) AS decision FROM orders WHERE o_orderpriority = '1-URGENT'")
def decision_rows(t: Tables) -> DataFrame:
    return modules.key_decisions(t.orders.where("o_orderpriority = '1-URGENT'").agg(F.count("*").alias("n")), [("n > 100", "many"), ("n > 0", "some"), ("n = 0", "none")])


_LEFT = "CASE p_partkey % 6 WHEN 0 THEN 'item_' || p_partkey WHEN 1 THEN 'tbl_Item' || p_partkey || 's' WHEN 2 THEN 'category_' || p_partkey WHEN 3 THEN 'itm_' || p_partkey || 'a' WHEN 4 THEN 'T_ORDER_' || p_partkey ELSE 'lonely' || p_partkey || 'xyz' END"
_RIGHT = "CASE p_partkey % 6 WHEN 0 THEN 'item_' || p_partkey WHEN 1 THEN 'item' || p_partkey WHEN 2 THEN 'categories_' || p_partkey WHEN 3 THEN 'item_' || p_partkey || 'a' WHEN 4 THEN 'order_' || p_partkey ELSE 'zz' || p_partkey END"


@query(f"""
WITH a AS (SELECT p_partkey, {_LEFT} AS name, {_RIGHT} AS twin FROM part)
SELECT name, CASE WHEN p_partkey % 6 IN (0, 1, 3, 4) THEN twin END AS partner, CAST(CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 2 ELSE 0 END AS BIGINT) AS tier FROM a""")
def matched_names(t: Tables) -> DataFrame:
    """Names of one table and of another, spelt in other ways; those that differ by more have no partner."""
    return coverage.matched_names(t.part.select(F.expr(_LEFT).alias("name")), t.part.select(F.expr(_RIGHT).alias("partner")), "name", "partner")


_SQL = texts.Corpus(
    "customer", "q«c_custkey»",
    [
        "SELECT u.id_«c_custkey % 3», o.total AS t -- x.y", "FROM users_«c_nationkey» u JOIN shop.orders AS o ON o.uid = u.id",
        "WHERE o.k IN (SELECT x FROM s«c_custkey % 2» WHERE u.z = 'a.b')«CASE WHEN c_custkey % 4 = 0 THEN ' UNION SELECT k, v FROM m' WHEN c_custkey % 4 = 1 THEN ' AND total2 > 1' ELSE '' END»",
    ],
)


@query(f"""
WITH c AS (SELECT {_SQL.key_sql} AS path, c_custkey AS k, 'users_' || c_nationkey AS u FROM customer)
SELECT path, CAST(1 AS BIGINT) AS line, u AS "table", 'id_' || k % 3 AS "column" FROM c UNION ALL SELECT path, 1, 'orders', 'total' FROM c UNION ALL SELECT path, 2, 'orders', 'uid' FROM c UNION ALL SELECT path, 2, u, 'id' FROM c
UNION ALL SELECT path, 3, 'orders', 'k' FROM c UNION ALL SELECT path, 3, 's' || k % 2, 'x' FROM c UNION ALL SELECT path, 3, u, 'z' FROM c UNION ALL SELECT path, 3, 'm', unnest(['k', 'v']) FROM c WHERE k % 4 = 0 UNION ALL SELECT path, 3, NULL, 'total2' FROM c WHERE k % 4 = 1""")
def sql_resolved_columns(t: Tables) -> DataFrame:
    return sqlscopes.resolved_columns(_SQL.frame(t), "path", "content").select("path", "line", "table", "column")


_BODIES = texts.Corpus(
    "part", "/b/p«p_partkey».php",
    [
        "<?php function f«p_partkey»($x) {«repeat(' if ($x) { throw new E(); }', p_size % 4)» // die();",
        "  «CASE p_partkey % 3 WHEN 0 THEN '$_SESSION[\"a\"] = 1; $_SESSION[\"b\"] = 2; return false; return false;' WHEN 1 THEN 'global $g; unlink($x); echo \"mkdir(1)\"; return null;' ELSE 'if ($_SESSION[\"a\"] == 1) { exit; } die(2);' END»",
        "}",
    ],
)


@query(f"""
WITH p AS (SELECT {_BODIES.key_sql} AS path, p_partkey % 3 AS k, p_size % 4 AS z FROM part)
SELECT path, 'throw' AS kind, CAST(z AS BIGINT) AS n FROM p WHERE z > 0 UNION ALL SELECT path, CASE k WHEN 0 THEN 'return_false' WHEN 1 THEN 'return_null' ELSE 'exit' END, CASE WHEN k = 2 THEN 2 ELSE 1 END FROM p""")
def body_failures(t: Tables) -> DataFrame:
    return php.failures(code.functions(_BODIES.frame(t))).select("path", "kind", "n")


@query(f"""
WITH p AS (SELECT {_BODIES.key_sql} AS path, p_partkey % 3 AS k FROM part) SELECT path, unnest(CASE k WHEN 0 THEN ['session'] ELSE ['global', 'file_delete'] END) AS kind FROM p WHERE k < 2""")
def body_effects(t: Tables) -> DataFrame:
    return php.effects(code.functions(_BODIES.frame(t))).select("path", "kind")
