"""Queries over facts: findings, calls, routes, tables and modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srclens.functions import derive, naming
from srclens.functions.conditions import clipped, ladder
from srclens.operators import calls, correlate, coverage, graph, rollup, routes, sqltext
from srclens.plans.registry import Tables, query
from srclens.streaming import status

SEV = "CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' ELSE 'low' END"
WEIGHT = "CASE event_type WHEN 'error' THEN 10 WHEN 'purchase' THEN 5 WHEN 'signup' THEN 2 ELSE 1 END"
PAIRS = "(SELECT DISTINCT o_custkey AS file, lower(p_brand) AS tab FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"
SUPPLY = "(SELECT DISTINCT o_custkey AS file, CAST(s_nationkey AS VARCHAR) AS tab FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"
COUPLED = """
WITH p AS {pairs}, n AS (SELECT tab, count(*) AS n FROM p GROUP BY tab),
c AS (SELECT a.tab AS t1, b.tab AS t2, count(*) AS n_common FROM p a JOIN p b ON a.file = b.file AND a.tab < b.tab GROUP BY a.tab, b.tab HAVING count(*) >= 2)
SELECT t1, t2, n_common, x.n AS n1, y.n AS n2, round(n_common / least(x.n, y.n), 4)::DOUBLE AS ratio,
  CASE WHEN n_common / least(x.n, y.n) >= 0.8 THEN 'tight' WHEN n_common / least(x.n, y.n) >= 0.5 THEN 'moderate' ELSE 'loose' END AS strength
FROM c JOIN n x ON x.tab = t1 JOIN n y ON y.tab = t2"""


def findings(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    severity = ladder([(kind == "error", "critical"), (kind == "purchase", "high"), (kind == "signup", "medium")], "low")
    return t.events.select("event_id", "ts", "user_id", kind.alias("type"), severity.alias("severity"))


def brand_accesses(t: Tables) -> DataFrame:
    joined = t.lineitem.select("l_orderkey", "l_partkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))


def brand_pairs(t: Tables) -> DataFrame:
    return correlate.file_tables(brand_accesses(t), "o_custkey", "p_brand")


def supply_pairs(t: Tables) -> DataFrame:
    joined = t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return correlate.file_tables(joined.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")), "o_custkey", "s_nationkey")


@query(f"""
SELECT s.severity, coalesce(n, 0) AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) s(severity) LEFT JOIN (SELECT {SEV} AS severity, count(*) AS n FROM events GROUP BY 1) USING (severity)""")
def severity_summary(t: Tables) -> DataFrame:
    return rollup.severity_summary(findings(t))


@query(f"""
WITH f AS (SELECT event_type AS type, user_id, event_id, {SEV} AS severity, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS place FROM events)
SELECT type, count(*) AS n, count(DISTINCT user_id) AS n_files, count(*) FILTER (WHERE severity = 'critical') AS n_critical, count(*) FILTER (WHERE severity = 'high') AS n_high,
  count(*) FILTER (WHERE severity = 'medium') AS n_medium, count(*) FILTER (WHERE severity = 'low') AS n_low, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY place) FILTER (WHERE place <= 3) AS examples FROM f GROUP BY type""")
def findings_by_type_examples(t: Tables) -> DataFrame:
    return rollup.by_type_with_examples(findings(t), "user_id", ["ts", "event_id"], "event_id")


@query("""
SELECT user_id, event_type AS type, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY user_id) AS BIGINT) AS total FROM events GROUP BY user_id, event_type""")
def findings_by_file(t: Tables) -> DataFrame:
    return rollup.by_file(findings(t), "user_id")


HOTSPOTS = f"""
WITH b AS (SELECT user_id, event_type AS type, count(*) AS n, sum({WEIGHT}) AS w FROM events GROUP BY user_id, event_type),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, type) AS place FROM b),
h AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS total, CAST(sum(w) AS BIGINT) AS score, string_agg(type, ',' ORDER BY place) FILTER (WHERE place <= 3) AS top_types FROM p GROUP BY user_id)
SELECT *, CASE WHEN list_contains(string_split(top_types, ','), 'sql_injection') THEN 'parameterise queries' WHEN list_contains(string_split(top_types, ','), 'error') THEN 'handle errors first'
  WHEN list_contains(string_split(top_types, ','), 'purchase') THEN 'audit payments' ELSE 'review' END AS recommendation FROM h WHERE total >= 3 OR score >= 10"""


@query(HOTSPOTS + " ORDER BY score DESC, user_id LIMIT 10")
def hotspots_top10(t: Tables) -> DataFrame:
    return rollup.hotspots(findings(t), "user_id")


@query(HOTSPOTS)
def hotspots_all(t: Tables) -> DataFrame:
    return rollup.hotspots(findings(t), "user_id", limit=None)


@query("""
SELECT type, user_id, event_id FROM (SELECT event_type AS type, user_id, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1""")
def first_by_key(t: Tables) -> DataFrame:
    return rollup.first_by_key(findings(t), ["type", "user_id"], ["ts", "event_id"]).select("type", "user_id", "event_id")


@query("""
SELECT host, count(*) AS n_pages, CAST(sum(length(html)) AS BIGINT) AS n_chars, CAST(sum(len(regexp_extract_all(html, '<a '))) AS BIGINT) AS n_links, bool_or(contains(url, '?')) AS any_query,
  CASE WHEN sum(length(html)) > 20000 THEN 'large' WHEN sum(length(html)) > 5000 THEN 'medium' ELSE 'small' END AS size
FROM (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages) GROUP BY host""")
def service_rollup(t: Tables) -> DataFrame:
    out = t.pages.groupBy(routes.url_host(F.col("url")).alias("host")).agg(
        F.count("*").alias("n_pages"), F.sum(F.length("html").cast("long")).alias("n_chars"), F.sum(F.regexp_count("html", F.lit("<a ")).cast("long")).alias("n_links"),
        F.bool_or(F.contains("url", F.lit("?"))).alias("any_query"),
    )
    return out.withColumn("size", ladder([(F.col("n_chars") > 20000, "large"), (F.col("n_chars") > 5000, "medium")], "small"))


PATHS = """(SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages)"""
TEMPLATES = f"""(SELECT *, CASE WHEN regexp_replace(p2, '/+$', '') = '' THEN '/' ELSE regexp_replace(p2, '/+$', '') END AS template
 FROM (SELECT *, rtrim(regexp_replace(regexp_replace(path || '/', '/[0-9]+/', '/:id/', 'g'), '/[0-9]+/', '/:id/', 'g'), '/') AS p2 FROM {PATHS}))"""


def routed(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.pages.select("page_id", routes.url_host(url).alias("host"), routes.path_template(routes.url_path(url)).alias("template"), F.array_join(routes.query_params(url), ",").alias("params"))


@query(f"""
SELECT page_id, host, template, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(q, '([^&=]+)=', 1))), ','), '') AS params FROM {TEMPLATES}""")
def route_template(t: Tables) -> DataFrame:
    return routed(t)


@query(f"""
SELECT page_id, host, template, row_number() OVER (PARTITION BY host ORDER BY template, page_id) - 1 AS priority FROM {TEMPLATES}""")
def route_union_priority(t: Tables) -> DataFrame:
    return routes.partitioned_priority(routed(t).select("page_id", "host", "template"), "host", ["template", "page_id"])


@query(f"""
SELECT host, template, count(*) AS n, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY CAST(page_id AS VARCHAR)) AS members FROM {TEMPLATES} GROUP BY host, template HAVING count(*) > 1""")
def route_conflicts(t: Tables) -> DataFrame:
    return routes.conflicts(routed(t), ["host", "template"], "page_id")


@query(f"""
SELECT host, count(*) AS n_routes, string_agg(DISTINCT template, ' ' ORDER BY template) AS paths FROM {TEMPLATES} GROUP BY host""")
def target_index(t: Tables) -> DataFrame:
    return routes.target_index(routed(t), "host", "template")


@query("""
SELECT grouping(role) AS g_role, role, turn, count(*) AS n FROM conversations GROUP BY GROUPING SETS ((role), (turn), ())""")
def route_summary(t: Tables) -> DataFrame:
    out = routes.route_summary(t.conversations.select("role", "turn"), "role", "turn")
    return out.select(F.when(F.col("role").isNull(), 1).otherwise(0).cast("long").alias("g_role"), "role", "turn", "n")


@query("""
WITH g AS (SELECT *, coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM conversations),
c AS (SELECT conv_id, turn, role, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id, grp) AS n_conditions FROM g)
SELECT conv_id, turn, n_conditions FROM c WHERE role = 'assistant'""")
def route_conditions(t: Tables) -> DataFrame:
    return routes.conditions_of_rules(t.conversations, "conv_id", "turn", F.col("role") == "user", F.col("role") == "assistant")


_QUERY = "CASE p_size % 4 WHEN 0 THEN 'SELECT id, name FROM ' || lower(replace(p_brand, '#', '')) || ' WHERE size = 1' WHEN 1 THEN 'INSERT INTO ' || lower(replace(p_brand, '#', '')) || ' (id, price) VALUES (1, 2)' WHEN 2 THEN 'UPDATE ' || lower(replace(p_brand, '#', '')) || ' SET price = 1, stock = 2 WHERE id = 3' ELSE 'DELETE FROM ' || lower(replace(p_brand, '#', '')) || ' WHERE id = 9' END"


def _queries(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_size", F.expr(_QUERY).alias("q"))


@query(f"""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'INSERT' WHEN 2 THEN 'UPDATE' ELSE 'DELETE' END AS operation, lower(replace(p_brand, '#', '')) AS main_table,
 lower(replace(p_brand, '#', '')) AS tables, substring({_QUERY}, 1, 30) || CASE WHEN length({_QUERY}) > 30 THEN '...' ELSE '' END AS sample FROM part""")
def sql_table_extract(t: Tables) -> DataFrame:
    q = F.col("q")
    return _queries(t).select("p_partkey", sqltext.operation(q).alias("operation"), sqltext.main_table(q).alias("main_table"), F.array_join(sqltext.all_tables(q), ",").alias("tables"), clipped(q, 30).alias("sample"))


@query("""
WITH c AS (SELECT lower(replace(p_brand, '#', '')) AS tab, unnest(CASE p_size % 4 WHEN 0 THEN ['id', 'name', 'size'] WHEN 1 THEN ['id', 'price'] WHEN 2 THEN ['id', 'price', 'stock'] ELSE ['id'] END) AS col FROM part)
SELECT tab AS "table", col AS "column", count(*) AS n_queries FROM c GROUP BY tab, col""")
def schema_infer(t: Tables) -> DataFrame:
    q = F.col("q")
    found = _queries(t).select(sqltext.main_table(q).alias("table"), F.explode(sqltext.columns(q)).alias("column"))
    return found.groupBy("table", "column").agg(F.count("*").alias("n_queries"))


@query("""
WITH c AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'tinyint(1)' WHEN 1 THEN 'TINYINT(4)' WHEN 2 THEN 'bigint(20)' WHEN 3 THEN 'geometry' ELSE 'Decimal(10,2)' END AS type FROM part)
SELECT type, CASE type WHEN 'tinyint(1)' THEN 'boolean' WHEN 'TINYINT(4)' THEN 'tinyint' WHEN 'bigint(20)' THEN 'bigint' WHEN 'geometry' THEN 'varchar' ELSE 'decimal' END AS orm_type,
  CASE type WHEN 'tinyint(1)' THEN 'boolean' WHEN 'TINYINT(4)' THEN 'number' ELSE 'string' END AS script_type, count(*) AS n FROM c GROUP BY type""")
def type_map(t: Tables) -> DataFrame:
    size = F.col("p_size") % 5
    type_ = ladder([(size == 0, "tinyint(1)"), (size == 1, "TINYINT(4)"), (size == 2, "bigint(20)"), (size == 3, "geometry")], "Decimal(10,2)")
    orm, script = derive.sql_type(F.col("type"))
    return t.part.groupBy(type_.alias("type")).agg(F.count("*").alias("n")).select("type", orm.alias("orm_type"), script.alias("script_type"), "n")


@query(f"SELECT CAST(file AS BIGINT) AS file, tab AS \"table\" FROM {PAIRS}")
def file_table_index(t: Tables) -> DataFrame:
    return brand_pairs(t)


@query(f"""
WITH p AS {PAIRS} SELECT a.tab AS t1, b.tab AS t2, count(*) AS n_common FROM p a JOIN p b ON a.file = b.file AND a.tab < b.tab GROUP BY a.tab, b.tab HAVING count(*) >= 2""")
def co_occurrence(t: Tables) -> DataFrame:
    return correlate.co_occurrence(brand_pairs(t))


@query(COUPLED.format(pairs=SUPPLY))
def coupling_strength(t: Tables) -> DataFrame:
    return correlate.coupling(supply_pairs(t))


@query(COUPLED.format(pairs=PAIRS))
def coupling_brands(t: Tables) -> DataFrame:
    return correlate.coupling(brand_pairs(t))


@query(f"""
WITH RECURSIVE e AS (SELECT t1, t2 FROM ({COUPLED.format(pairs=SUPPLY)}) WHERE strength = 'tight'), b AS (SELECT t1 AS x, t2 AS y FROM e UNION SELECT t2, t1 FROM e),
r AS (SELECT x, x AS y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON b.x = r.y)
SELECT x AS node, min(y) AS cluster FROM r GROUP BY x""")
def cluster_components(t: Tables) -> DataFrame:
    return graph.components(correlate.coupling(supply_pairs(t)).where("strength = 'tight'"), "t1", "t2")


MODULES = """(SELECT n_name AS name, n_nationkey, n_regionkey, count(o_orderkey) AS n_lines, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS security, count(DISTINCT c_custkey) AS complexity
 FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"""


def modules(t: Tables) -> DataFrame:
    owned = t.customer.select("c_custkey", "c_nationkey").join(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("c_custkey") == F.col("o_custkey"), "left")
    joined = t.nation.join(owned, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.groupBy(F.col("n_name").alias("name"), "n_nationkey", "n_regionkey").agg(
        F.count("o_orderkey").alias("n_lines"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("security"), F.count_distinct("c_custkey").alias("complexity")
    )


@query(f"""
SELECT name, n_lines, security, complexity, CASE WHEN security > 10 OR complexity > 300 THEN 'high' WHEN security > 5 OR complexity > 150 THEN 'medium' ELSE 'low' END AS risk,
 CASE WHEN n_lines > 1000 THEN 'large' WHEN n_lines > 300 THEN 'medium' ELSE 'small' END AS effort FROM {MODULES}""")
def module_metrics(t: Tables) -> DataFrame:
    out = modules(t).withColumn("risk", rollup.risk_bucket(F.col("security"), F.col("complexity"))).withColumn("effort", rollup.effort_bucket(F.col("n_lines")))
    return out.select("name", "n_lines", "security", "complexity", "risk", "effort")


@query(f"""
SELECT points AS effort_points, CASE WHEN points <= 10 THEN 'small' WHEN points <= 25 THEN 'medium' WHEN points <= 50 THEN 'large' ELSE 'very_large' END AS bucket
FROM (SELECT CAST(sum(CASE WHEN n_lines > 1000 THEN 7 WHEN n_lines > 300 THEN 3 ELSE 1 END) AS BIGINT) AS points FROM {MODULES})""")
def effort_score(t: Tables) -> DataFrame:
    return rollup.effort_score(modules(t).select(rollup.effort_bucket(F.col("n_lines")).alias("effort")))


@query(f"""
WITH h AS (SELECT o_custkey, count(*) AS total FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey)
SELECT n_name AS name, CAST(greatest(coalesce(sum(total), 0), coalesce(max(total), 0)) AS BIGINT) AS security FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN h ON o_custkey = c_custkey GROUP BY n_name""")
def module_hotspots(t: Tables) -> DataFrame:
    hot = t.orders.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("total"))
    files = t.nation.join(t.customer.select("c_custkey", "c_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(hot, F.col("o_custkey") == F.col("c_custkey"), "left")
    zero = F.lit(0).cast("long")
    return files.groupBy(F.col("n_name").alias("name")).agg(F.greatest(F.coalesce(F.sum("total"), zero), F.coalesce(F.max("total"), zero)).alias("security"))


@query("""
WITH u AS (SELECT DISTINCT p_brand, r_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT p_brand, count(*) AS n_modules, string_agg(r_name, ',' ORDER BY r_name) AS modules FROM u GROUP BY p_brand HAVING count(*) > 1""")
def shared_tables(t: Tables) -> DataFrame:
    used = t.lineitem.select("l_partkey", "l_suppkey").distinct().join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    used = used.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return correlate.shared_tables(used, "p_brand", "r_name")


@query("""
SELECT l_suppkey AS node, count(*) AS n_dependents FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) GROUP BY l_suppkey ORDER BY n_dependents DESC, node LIMIT 20""")
def dependency_in_degree(t: Tables) -> DataFrame:
    return correlate.in_degree(t.lineitem, "l_partkey", "l_suppkey")


@query("""
SELECT DISTINCT user_id AS node FROM events WHERE user_id NOT IN (SELECT event_id FROM events WHERE event_id IS NOT NULL AND event_type = 'error')""")
def dependency_roots(t: Tables) -> DataFrame:
    edges = t.events.select("user_id", F.when(F.col("event_type") == "error", F.col("event_id")).alias("target"))
    return correlate.roots(edges, "user_id", "target")


@query("""
WITH RECURSIVE m AS (SELECT name, n_regionkey, n_regionkey + 1 AS priority, CASE WHEN security > 10 OR complexity > 300 THEN 'high' WHEN security > 5 OR complexity > 150 THEN 'medium' ELSE 'low' END AS risk, complexity FROM <MODULES>),
f AS (SELECT n_regionkey, min(name) AS needs FROM m GROUP BY n_regionkey),
d AS (SELECT name, needs FROM m JOIN f USING (n_regionkey) WHERE name <> needs UNION SELECT a.needs, b.needs FROM f a JOIN f b ON a.n_regionkey = (b.n_regionkey + 4) % 5 WHERE a.needs <> b.needs),
n AS (SELECT m.name, priority, risk, complexity, list(needs) FILTER (WHERE needs IS NOT NULL) AS needs FROM m LEFT JOIN d ON d.name = m.name GROUP BY ALL),
s AS (SELECT 0 AS place, CAST(NULL AS VARCHAR) AS name, CAST([] AS VARCHAR[]) AS done
  UNION ALL SELECT place + 1, pick, list_append(done, pick) FROM (
    SELECT s.place, s.done, arg_min(n.name, CASE WHEN len(list_filter(coalesce(n.needs, []), lambda v: NOT list_contains(s.done, v))) = 0 THEN {'a': 0, 'b': n.priority, 'c': 0, 'd': n.name}
      ELSE {'a': 1, 'b': CASE WHEN n.risk <> 'low' THEN 1 ELSE 0 END, 'c': n.complexity, 'd': n.name} END) AS pick
    FROM s JOIN n ON NOT list_contains(s.done, n.name) GROUP BY s.place, s.done) x)
SELECT name, CAST(place AS BIGINT) AS place FROM s WHERE place > 0""".replace("<MODULES>", MODULES))
def migration_order(t: Tables) -> DataFrame:
    m = modules(t)
    rows = m.select("name", (F.col("n_regionkey") + 1).alias("priority"), rollup.risk_bucket(F.col("security"), F.col("complexity")).alias("risk"), "complexity")
    # A nation needs the first nation of its region, and this one the first of the next region: a cycle over regions.
    first = m.groupBy("n_regionkey").agg(F.min("name").alias("needs"))
    inner = m.join(first, "n_regionkey").select("name", "needs")
    across = first.select(F.col("n_regionkey"), F.col("needs").alias("name")).join(first.select(((F.col("n_regionkey") + 4) % 5).alias("n_regionkey"), "needs"), "n_regionkey").select("name", "needs")
    return graph.migration_order(rows, inner.unionByName(across))


@query("""
WITH f AS (SELECT l_partkey, bool_or(l_linestatus = 'O' AND NOT w) AS sub_reads, bool_or(l_linestatus = 'O' AND w) AS sub_writes, bool_or(l_linestatus <> 'O' AND NOT w) AS main_reads, bool_or(l_linestatus <> 'O' AND w) AS main_writes
  FROM (SELECT *, l_returnflag = 'R' AND l_quantity > 45 AS w FROM lineitem) GROUP BY l_partkey)
SELECT l_partkey AS "table", sub_reads, sub_writes, main_reads, main_writes, CASE WHEN sub_writes AND main_writes THEN 'shared' WHEN sub_writes THEN 'submodule_owned' WHEN main_writes THEN 'main_owned' WHEN sub_reads THEN 'read_only' ELSE 'unknown' END AS ownership FROM f""")
def ownership_class(t: Tables) -> DataFrame:
    return correlate.ownership(t.lineitem, "l_partkey", F.col("l_linestatus") == "O", (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45))


@query("""
SELECT user_id, event_type, count(*) AS total_calls, count(DISTINCT CAST(ts AS DATE)) AS unique_callers, count(*) >= 15 AS is_hot, count(*) >= 5 AND count(DISTINCT CAST(ts AS DATE)) >= 2 AS cacheable FROM events GROUP BY user_id, event_type""")
def call_frequency(t: Tables) -> DataFrame:
    return rollup.call_frequency(t.events.withColumn("day", F.to_date("ts")), ["user_id", "event_type"], "day", hot=15)


@query("""
WITH c AS (SELECT event_type, user_id, count(*) AS n_calls, min(event_id) AS first_call FROM events GROUP BY event_type, user_id),
p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY first_call, user_id) AS n FROM c WHERE n_calls >= 3) SELECT event_type, user_id, n_calls FROM p WHERE n = 1""")
def sequential_batch(t: Tables) -> DataFrame:
    return calls.sequential_batches(t.events, "event_type", "user_id", "event_id")


@query("""
WITH w AS (SELECT event_id, user_id, event_type, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) AS n_ahead FROM events)
SELECT event_id, user_id, n_ahead FROM w WHERE event_type = 'error' AND n_ahead > 0""")
def loop_lookahead(t: Tables) -> DataFrame:
    out = calls.look_ahead(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "purchase")
    return out.select("event_id", "user_id", "n_ahead")


@query("""
WITH f AS (SELECT user_id, count(*) AS total_calls, count(DISTINCT event_type) AS unique_callers FROM events GROUP BY user_id), w AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 450)
SELECT user_id, total_calls, unique_callers, CASE WHEN total_calls >= 60 THEN 'ttl_300' WHEN unique_callers >= 5 THEN 'request_scoped' ELSE 'ttl_60' END AS strategy FROM f ANTI JOIN w USING (user_id)""")
def cache_strategy(t: Tables) -> DataFrame:
    freq = t.events.groupBy("user_id").agg(F.count("*").alias("total_calls"), F.count_distinct("event_type").alias("unique_callers"))
    writers = t.events.where("event_type = 'purchase' and value > 450").select("user_id").distinct()
    out = freq.join(writers, "user_id", "left_anti")
    return out.withColumn("strategy", rollup.cache_strategy(F.col("total_calls"), F.col("unique_callers"), ttl_calls=60))


@query("""
WITH f AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY user_id, event_type), g AS (SELECT count(*) AS n_methods, count(*) FILTER (WHERE c >= 15) AS n_hot, count(*) FILTER (WHERE c >= 20) AS n_very_hot, count(*) FILTER (WHERE event_type = 'error') AS n_loops FROM f)
SELECT *, CASE WHEN n_loops >= 1000000 OR n_very_hot >= 3 THEN 'high' WHEN n_loops >= 2 OR n_hot >= 5 THEN 'medium' ELSE 'low' END AS risk FROM g""")
def perf_risk(t: Tables) -> DataFrame:
    c = F.col("total_calls")
    f = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("total_calls"))
    out = f.agg(F.count("*").alias("n_methods"), F.count_if(c >= 15).alias("n_hot"), F.count_if(c >= 20).alias("n_very_hot"), F.count_if(F.col("event_type") == "error").alias("n_loops"))
    return out.withColumn("risk", ladder([((F.col("n_loops") >= 1000000) | (F.col("n_very_hot") >= 3), "high"), ((F.col("n_loops") >= 2) | (F.col("n_hot") >= 5), "medium")], "low"))


@query("""
WITH u AS (SELECT 'event' AS kind, user_id AS f FROM events UNION ALL SELECT 'order', o_custkey FROM orders UNION ALL SELECT 'supply', l_suppkey FROM lineitem)
SELECT kind, count(*) AS n_calls, count(DISTINCT f) AS n_files FROM u GROUP BY kind UNION ALL SELECT 'all', count(*), count(DISTINCT f) FROM u""")
def call_point_summary(t: Tables) -> DataFrame:
    sources = [("event", t.events.select(F.col("user_id").alias("f"))), ("order", t.orders.select(F.col("o_custkey").alias("f"))), ("supply", t.lineitem.select(F.col("l_suppkey").alias("f")))]
    return calls.call_point_summary(sources, "f")


@query("""
SELECT o_orderkey, coalesce(a.v, b.v, c.v) AS handler, CASE WHEN a.k IS NOT NULL THEN 1 WHEN b.k IS NOT NULL THEN 2 WHEN c.k IS NOT NULL THEN 3 END::BIGINT AS handler_tier FROM orders
LEFT JOIN (SELECT s_suppkey AS k, s_name AS v FROM supplier) a ON a.k = o_custkey LEFT JOIN (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_acctbal > 5000) b ON b.k = o_custkey
LEFT JOIN (SELECT n_nationkey AS k, n_name AS v FROM nation) c ON c.k = o_custkey % 50""")
def handler_resolution(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey", (F.col("o_custkey") % 50).alias("slot"))
    tiers = [
        (t.supplier.select("s_suppkey", F.col("s_name").alias("v")), "o_custkey", "s_suppkey"),
        (t.customer.where("c_acctbal > 5000").select("c_custkey", F.col("c_name").alias("v")), "o_custkey", "c_custkey"),
        (t.nation.select("n_nationkey", F.col("n_name").alias("v")), "slot", "n_nationkey"),
    ]
    return correlate.fallback_lookup(o, tiers, "v", "handler").select("o_orderkey", "handler", "handler_tier")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, (l_returnflag = 'R') DESC, l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1""")
def main_function_pick(t: Tables) -> DataFrame:
    order = [F.desc("l_quantity"), (F.col("l_returnflag") == "R").desc(), F.desc("l_extendedprice"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")]
    return correlate.best_per_group(t.lineitem, ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
SELECT CASE WHEN len(x) = 0 THEN 'valid' ELSE array_to_string(x, ',') END AS issues, count(*) AS n FROM
 (SELECT list_filter([CASE WHEN NOT coalesce(bool_or(o_orderstatus = 'P'), false) THEN 'no_pending' END, CASE WHEN NOT coalesce(bool_or(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'), false) THEN 'no_urgent' END], lambda y: y IS NOT NULL) AS x
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) GROUP BY 1""")
def section_validator(t: Tables) -> DataFrame:
    kinds = t.customer.select("c_custkey").join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(
        F.bool_or(F.col("o_orderstatus") == "P").alias("pending"), F.bool_or((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).alias("urgent")
    )
    checked = kinds.select(coverage.issues([("no_pending", F.col("pending")), ("no_urgent", F.col("urgent"))]).alias("x"))
    return coverage.validation_summary(checked, "x")


@query("""
WITH f AS (SELECT event_type, user_id, count(*) AS c, bool_or(value > 400) AS db FROM events GROUP BY event_type, user_id),
p AS (SELECT *, CASE WHEN contains(event_type, 'login') OR contains(event_type, 'auth') THEN 'critical' WHEN c >= 15 THEN 'high' WHEN c >= 5 THEN 'normal' ELSE 'low' END AS priority FROM f)
SELECT event_type, user_id, priority, (CASE priority WHEN 'critical' THEN 2500 WHEN 'high' THEN 5000 WHEN 'normal' THEN 7500 ELSE 10000 END + CASE WHEN coalesce(db, false) THEN 2000 ELSE 0 END)::BIGINT AS timeout_ms,
  (CASE priority WHEN 'critical' THEN 5 WHEN 'low' THEN 1 ELSE 3 END)::BIGINT AS retries FROM p""")
def endpoint_priority_timeout(t: Tables) -> DataFrame:
    f = t.events.groupBy("event_type", "user_id").agg(F.count("*").alias("c"), F.coalesce(F.bool_or(F.col("value") > 400), F.lit(False)).alias("db"))
    f = f.withColumn("priority", derive.endpoint_priority(F.col("event_type"), F.col("c"), F.col("c") >= 15))
    return f.select("event_type", "user_id", "priority", derive.timeout_ms(F.col("priority"), F.col("db")).alias("timeout_ms"), derive.retries(F.col("priority")).alias("retries"))


@query("""
WITH n AS (SELECT DISTINCT p_brand AS name FROM part), w AS (SELECT name, lower(replace(name, '#', '_')) AS plain FROM n)
SELECT name, array_to_string(list_transform(string_split(plain, '_'), lambda x: upper(x[1]) || x[2:]), '') AS pascal, regexp_replace(regexp_replace(replace(name, '#', ''), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g').lower() AS snake FROM w""")
def naming_cases(t: Tables) -> DataFrame:
    name = F.col("name")
    return t.part.select(F.col("p_brand").alias("name")).distinct().select(
        "name", naming.pascal(F.regexp_replace(name, "#", "_")).alias("pascal"), naming.snake(F.regexp_replace(name, "#", "")).alias("snake")
    )


@query("""
WITH c AS (SELECT event_type AS name, CASE WHEN value > 250 THEN 'int' ELSE 'string' END AS type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT name, type, n, CASE WHEN type = 'int' THEN 'number' ELSE 'string' END AS script_type, CASE WHEN type = 'int' THEN '1' ELSE 'example' END AS sample, CASE WHEN type = 'int' THEN 'IsNotEmpty,IsInt' ELSE 'IsNotEmpty,IsString' END AS validators FROM c""")
def derived_fields(t: Tables) -> DataFrame:
    f = t.events.groupBy(F.col("event_type").alias("name"), F.when(F.col("value") > 250, "int").otherwise("string").alias("type")).agg(F.count("*").alias("n"))
    name, type_ = F.col("name"), F.col("type")
    return f.select("name", "type", "n", derive.php_type(type_).alias("script_type"), derive.sample_value(name, type_).alias("sample"), F.array_join(derive.validators(name, type_, F.lit(True)), ",").alias("validators"))


@query("""
WITH r AS (SELECT n_name, CAST(CASE n_name WHEN 'FRANCE' THEN 1 WHEN 'CHINA' THEN 2 ELSE 100 + n_regionkey END AS BIGINT) AS rank_key FROM nation)
SELECT n_name, rank_key, row_number() OVER (ORDER BY rank_key, n_name) AS place FROM r""")
def priority_renumber(t: Tables) -> DataFrame:
    return graph.renumbered(t.nation, ["FRANCE", "CHINA"], "n_name", "n_regionkey").select("n_name", "rank_key", "place")


@query("""
WITH u AS (SELECT o_custkey AS file, lower(p_brand) AS tab FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
c AS (SELECT DISTINCT o_custkey AS file FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT file, min(tab) AS cluster FROM u ANTI JOIN c USING (file) GROUP BY file""")
def leftover_cluster(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("file"))
    return graph.leftover_cluster(correlate.every_access(brand_accesses(t), "o_custkey", "p_brand"), urgent, "file", "table")


@query("""
SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def known_tables(t: Tables) -> DataFrame:
    names = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("table"))
    mentions = t.orders.select("o_custkey", F.col("o_custkey").cast("string").alias("table"))
    return correlate.known_tables(mentions, names).select("o_custkey").distinct()


@query("SELECT event_type AS state, count(*) AS n FROM events GROUP BY event_type")
def status_stream(t: Tables) -> DataFrame:
    stream = status.file_stream(t.spark, t.sf_dir, "events.parquet", t.events.schema)
    return status.run_once(status.status_counts(stream, "event_type"), ["state"])


@query("""
SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def windowed_events(t: Tables) -> DataFrame:
    stream = status.file_stream(t.spark, t.sf_dir, "events.parquet", t.events.schema)
    return status.run_once(status.windowed_counts(stream, "ts", "event_type"), ["window_start", "event_type"])


@query("""
SELECT user_id, n, rank() OVER (ORDER BY n DESC, user_id) AS place FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ORDER BY n DESC, user_id LIMIT 20""")
def top_callers(t: Tables) -> DataFrame:
    # The best 20 are taken first, so the ranking sees 20 rows.
    top = t.events.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "user_id")).cast("long"))


@query("""
WITH f AS (SELECT o_custkey, count(*) AS total_lines, bool_or(o_orderstatus = 'P') AS is_mixed, sum(o_orderkey % 7) AS cyclomatic_complexity, count(DISTINCT o_orderpriority) AS n_globals FROM orders GROUP BY o_custkey),
a AS (SELECT count(*) AS n_files, CAST(sum(total_lines) AS BIGINT) AS n_lines, count(*) FILTER (WHERE is_mixed) AS n_mixed, CAST(sum(cyclomatic_complexity) AS BIGINT) AS n_complexity, CAST(sum(n_globals) AS BIGINT) AS n_globals FROM f),
c AS (SELECT (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS n_database, count(*) FILTER (WHERE p_size = 1) AS n_security, count(*) FILTER (WHERE p_size = 2) AS n_static, count(*) FILTER (WHERE p_size = 3) AS n_singletons, count(*) FILTER (WHERE p_size > 60) AS n_external, bool_or(p_size = 7) AS has_front_controller FROM part),
j AS (SELECT *, round_even(n_complexity / greatest(n_files, 1), 2)::DOUBLE AS mean_complexity, CAST(greatest(1, n_lines // 2000) AS BIGINT) AS weeks,
  list_filter([CASE WHEN n_mixed > 0.5 * n_files THEN 'mixed_pages' END, CASE WHEN n_database > 50 THEN 'heavy_database' END, CASE WHEN n_globals > 20 THEN 'global_state' END, CASE WHEN NOT has_front_controller THEN 'no_front_controller' END, CASE WHEN n_security > 10 THEN 'security_review' END,
    CASE WHEN n_static > 20 THEN 'static_calls' END, CASE WHEN n_singletons > 5 THEN 'singletons' END, CASE WHEN n_external > 10 THEN 'external_apis' END], lambda x: x IS NOT NULL) AS fs FROM a, c)
SELECT * EXCLUDE (fs), array_to_string(fs, ',') AS factors, CASE WHEN len(fs) >= 3 THEN 'high' WHEN len(fs) >= 1 THEN 'medium' ELSE 'low' END AS level FROM j""")
def project_assessment(t: Tables) -> DataFrame:
    files = t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("total_lines"), F.bool_or(F.col("o_orderstatus") == "P").alias("is_mixed"), F.sum(F.col("o_orderkey") % 7).alias("cyclomatic_complexity"), F.count_distinct("o_orderpriority").alias("n_globals")
    )
    size = lambda c: F.count_if(F.expr(f"p_size {c}"))
    own = t.part.agg(size("= 1").alias("n_security"), size("= 2").alias("n_static"), size("= 3").alias("n_singletons"), size("> 60").alias("n_external"), F.bool_or(F.col("p_size") == 7).alias("has_front_controller"), F.lit(1).alias("_k"))
    db = t.lineitem.agg(F.count_if(F.col("l_returnflag") == "R").alias("n_database"), F.lit(1).alias("_k"))
    return rollup.project_complexity(files, own.join(db, "_k").drop("_k")).withColumn("factors", F.array_join("factors", ","))


@query("""
WITH s AS (SELECT o_custkey AS path, o_orderkey % 50 + 1 AS start_line, o_orderkey % 50 + 1 + o_orderkey % 9 AS end_line, o_orderstatus = 'F' AS has_sql, o_orderstatus = 'P' AS has_html FROM orders),
f AS (SELECT path, count(*) AS n, sum(end_line - start_line + 1) AS lines, max(end_line - start_line + 1) AS longest, count(*) FILTER (WHERE has_sql) AS sql, count(*) FILTER (WHERE has_html) AS html FROM s GROUP BY path)
SELECT count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_jobs, CAST(sum(lines) AS BIGINT) AS n_lines, CAST(max(longest) AS BIGINT) AS longest_job, CAST(sum(sql) AS BIGINT) AS n_with_sql, CAST(sum(html) AS BIGINT) AS n_with_html, count(*) FILTER (WHERE n > 1) AS n_split_files FROM f""")
def job_totals(t: Tables) -> DataFrame:
    start = F.col("o_orderkey") % 50 + 1
    return rollup.job_summary(t.orders.select(F.col("o_custkey").alias("path"), start.alias("start_line"), (start + F.col("o_orderkey") % 9).alias("end_line"), (F.col("o_orderstatus") == "F").alias("has_sql"), (F.col("o_orderstatus") == "P").alias("has_html")))
