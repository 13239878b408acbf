"""Micro-fixtures of the operators, with results worked out by hand."""

from pyspark.sql import functions as F

from srclens.functions import derive, naming
from srclens.operators import calls, code, correlate, coverage, graph, lines, rollup, routes, scan, segment, sqltext
from srclens.sources import files


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_line_numbers_and_ordinals(spark):
    texts = spark.createDataFrame([(1, "a\nb\nfoo x\nfoo y"), (2, None), (3, "")], "doc_id long, text string")
    rule = scan.Rule("r", "f", "t", "low", r"foo \w")
    found = scan.numbered(scan.scan_lines(texts, [rule])).select("doc_id", "line", "ordinal", "snippet")
    assert rows(found) == [(1, 3, 1, "foo x"), (1, 4, 2, "foo y")]
    whole = scan.scan_texts(texts, [rule]).select("doc_id", "line", "ordinal", "offset")
    assert rows(whole) == [(1, 3, 1, 4), (1, 4, 2, 10)]


def test_multiline_match_agrees_with_python(spark):
    import re

    text = "One.\nTwo x.\n\nThree.\nFour.\nFive"
    got = rows(scan.scan_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"), [scan.Rule("r", "f", "t", "low", r"\.\n[A-Z]\w+")]).select("offset", "line", "snippet"))
    assert got == [(m.start(), text.count("\n", 0, m.start()) + 1, m[0]) for m in re.finditer(r"\.\n[A-Z]\w+", text)]


def test_line_counts(spark):
    texts = spark.createDataFrame([(1, ""), (2, "a\n"), (3, None)], "doc_id long, text string")
    assert rows(lines.line_counts(texts)) == [(1, 0, 1, 0, 1), (2, 1, 2, 1, 1), (3, 0, 1, 0, 1)]


def test_hotspot_thresholds(spark):
    data = [("a", "x", "critical"), ("a", "y", "low"), ("b", "x", "high"), ("b", "x", "medium"), ("c", "x", "low"), ("c", "x", "low"), ("c", "z", "low"), ("d", "x", None)]
    found = rollup.hotspots(spark.createDataFrame(data, "file string, type string, severity string"), "file", limit=None)
    assert rows(found.select("file", "total", "score")) == [("a", 2, 11), ("c", 3, 3)]


def test_severities_are_seeded(spark):
    empty = spark.createDataFrame([], "severity string")
    assert rows(rollup.severity_summary(empty)) == [("critical", 0), ("high", 0), ("low", 0), ("medium", 0)]


def test_coupling(spark):
    pairs = spark.createDataFrame([("f1", "a"), ("f1", "b"), ("f2", "a"), ("f2", "b"), ("f3", "a"), ("f4", "a"), ("f5", "b")], "file string, table string")
    assert rows(correlate.coupling(pairs)) == [("a", "b", 2, 4, 3, 0.6667, "moderate")]
    assert correlate.coupling(pairs.where("file = 'f1'")).count() == 0


def test_ownership(spark):
    data = [("t1", "sub", True), ("t1", "main", False), ("t2", "sub", True), ("t2", "main", True), ("t3", "sub", False), ("t4", "main", False), ("t5", "sub", False), ("t5", "main", True)]
    found = correlate.ownership(spark.createDataFrame(data, "t string, side string, w boolean"), "t", F.col("side") == "sub", F.col("w"))
    assert rows(found.select("table", "ownership")) == [("t1", "submodule_owned"), ("t2", "shared"), ("t3", "read_only"), ("t4", "unknown"), ("t5", "main_owned")]


def test_fallback_lookup(spark):
    data = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "id int, k1 string, k2 string")
    one, two = spark.createDataFrame([("a", "A")], "k string, v string"), spark.createDataFrame([("x", "X"), ("y", "Y")], "k string, v string")
    found = correlate.fallback_lookup(data, [(one, "k1", "k"), (two, "k2", "k")], "v", "h")
    assert rows(found.select("id", "h", "h_tier")) == [(1, "A", 1), (2, "Y", 2), (3, None, None)]


def test_contained_passages_equal_brute_force(spark):
    passages = [(1, "one two three four five six seven eight nine"), (2, "short one"), (3, "x"), (4, "")]
    texts = [(1, "zero (one two three four five six seven eight nine) ten"), (2, "a short ones x"), (3, None), (4, "two three four five six seven")]
    got = rows(correlate.contained_passages(spark.createDataFrame(texts, "d int, t string"), spark.createDataFrame(passages, "i int, p string"), "d", "t", "i", "p"))
    assert got == sorted((d, i) for d, t in texts for i, p in passages if t and p and p in t)


def test_migration_order(spark):
    m = spark.createDataFrame([("auth", 1, "low", 1), ("users", 2, "low", 1), ("orders", 3, "low", 1), ("cart", 4, "low", 1)], "name string, priority int, risk string, complexity int")
    deps = spark.createDataFrame([("orders", "users"), ("cart", "users")], "name string, needs string")
    assert [r[0] for r in graph.migration_order(m, deps).orderBy("place").collect()] == ["auth", "users", "orders", "cart"]
    m = spark.createDataFrame([("y", 1, "high", 1), ("x", 2, "low", 5)], "name string, priority int, risk string, complexity int")
    deps = spark.createDataFrame([("x", "y"), ("y", "x")], "name string, needs string")
    assert [r[0] for r in graph.migration_order(m, deps).orderBy("place").collect()] == ["x", "y"]


def test_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("e", "d"), ("f", "c")], "x string, y string")
    assert rows(graph.components(edges, "x", "y")) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "a")]


def test_a_long_chain_is_one_component(spark):
    chain = spark.range(10_000).selectExpr("id AS x", "id + 1 AS y")
    assert rows(graph.components(chain, "x", "y").groupBy("cluster").count()) == [(0, 10_001)]


def test_migration_order_equals_steps(spark):
    import random

    r = random.Random(4)
    for n in (1, 6, 14):
        names = [f"m{i}" for i in range(n)]
        m = [(x, r.randrange(3), r.choice(["low", "high"]), r.randrange(4)) for x in names]
        d = [(r.choice(names), r.choice([*names, "unknown"])) for _ in range(2 * n)]
        needs = {x: {b for a, b in d if a == x and b != x and b in names} for x in names}
        by, done = {x[0]: x for x in m}, []
        while len(done) < n:
            left = [x for x in names if x not in done]
            ready = [x for x in left if needs[x] <= set(done)]
            done.append(min(ready, key=lambda x: (by[x][1], x)) if ready else min(left, key=lambda x: (by[x][2] != "low", by[x][3], x)))
        for order in (graph.migration_order, graph._order_by_rounds):
            got = order(spark.createDataFrame(m, "name string, priority int, risk string, complexity int"), spark.createDataFrame(d, "name string, needs string"))
            assert [x["name"] for x in got.orderBy("place").collect()] == done
    none = spark.createDataFrame([], "name string, priority int, risk string, complexity int")
    assert graph.migration_order(none, spark.createDataFrame([], "name string, needs string")).count() == 0


def test_migration_order_of_a_long_chain(spark):
    names = spark.range(5000).selectExpr("lpad(string(id), 5, '0') name", "int(id) priority", "'low' risk", "1 complexity")
    chain = spark.range(4999).selectExpr("lpad(string(id), 5, '0') name", "lpad(string(id + 1), 5, '0') needs")
    got = graph.migration_order(names, chain).orderBy("place").collect()
    assert [int(x["name"]) for x in got] == list(range(4999, -1, -1)) and [x["place"] for x in got] == list(range(1, 5001))


def test_followed_pointers(spark):
    import random

    r = random.Random(2)
    to = {(k, i): r.choice([None, *range(i + 1, min(i + 9, 200))]) if i < 199 else None for k in range(5) for i in range(200)}
    rows_ = [(k, i, x) for (k, i), x in to.items()]
    starts = [(k, r.randrange(20)) for k in range(4)]
    got = {(x["k"], x["place"]): x["at"] for x in graph.followed(spark.createDataFrame(rows_, "k int, at int, to int"), spark.createDataFrame(starts, "k int, at int"), ["k"]).collect()}
    want = {}
    for k, at in starts:
        place = 0
        while at is not None:
            want[k, place] = at
            at, place = to.get((k, at)), place + 1
    assert got == want


def test_segments_by_pointers_equal_the_folds(spark):
    import random

    r = random.Random(8)
    lines = ["function f() {", "}", "", "// note", "$x = 1;", "$yy = 22;", "if (a) {"]
    texts = [(i, chr(10).join(r.choice(lines) for _ in range(r.choice([0, 1, 5, 30, 120, 400])))) for i in range(30)] + [(30, None), (31, chr(10)), (32, "a" + chr(10))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for target, least, reach in ((8, 2, 3), (20, 5, 10), (4, 1, 6)):
        assert rows(segment.fixed_segments(docs, target, least, reach)) == rows(segment.fixed_segments_by_pointers(docs, target, least, reach))
    marks = [(i, k, r.choice("AB")) for i in range(20) for k in sorted(r.sample(range(1, 200), r.choice([0, 3, 60])))]
    n = spark.createDataFrame([(i, r.choice([0, 1, 50, 200])) for i in range(21)], "doc_id long, n long")
    marks = spark.createDataFrame(marks, "doc_id long, line long, kind string").join(n, "doc_id").where("line <= n").drop("n")
    for most, least in ((8, 3), (40, 10), (5, 0)):
        assert rows(segment.boundary_chunks(marks, n, ["A"], most, least)) == rows(segment.boundary_chunks_by_pointers(marks, n, ["A"], most, least))


def test_every_rule_has_a_sample():
    import re

    from srclens.functions import rule_sets
    from srclens.plans import code_texts

    text = chr(10).join(code_texts.SAMPLES)
    for rule in rule_sets.ALL:
        assert re.search(rule.pattern, text), rule
    sizes = {"security": 32, "external_api": 8, "transaction": 13, "event": 18, "error": 10, "pagination": 12, "cache": 20, "rate_limit": 10, "resilience": 16, "logging": 9, "include": 8}
    for family, n in sizes.items():
        assert sum(r.family == family for r in rule_sets.ALL) == n, family


def test_discovery(spark, tmp_path):
    from srclens.sources import discovery

    (tmp_path / "b.json").write_text('{"a": 3}')
    (tmp_path / "x.sql").write_text("SELECT 1")
    paths = [str(tmp_path / "a.json"), str(tmp_path / "b.json")]
    assert discovery.first_existing(spark, paths) == paths[1] and discovery.first_existing(spark, paths[:1]) is None
    assert discovery.json_with_fallback(spark, paths, "a long").first()["a"] == 3 and discovery.json_with_fallback(spark, paths[:1], "a long").count() == 0
    found = discovery.discovered(discovery.file_list(spark, str(tmp_path))).collect()
    assert [(r["kind"], r["is_used"]) for r in found] == [("sql", True)]


def test_route_conditions_and_conflicts(spark):
    kinds = ["c", "c", "r", "r", "c", "x", "r"]  # x is a rule without a target
    data = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "f int, n int, k string")
    found = routes.conditions_of_rules(data, "f", "n", F.col("k") == "c", F.col("k").isin("r", "x"))
    assert rows(found) == [(1, 2, 2), (1, 3, 0), (1, 5, 1), (1, 6, 0)]
    r = spark.createDataFrame([("/a", "GET", 1), ("/a", "GET", 2), ("/a", "POST", 3)], "p string, m string, i int")
    assert rows(routes.conflicts(r, ["p", "m"], "i")) == [("/a", "GET", 2, "1,2")]


def test_templates(spark):
    one = spark.createDataFrame([(r"^item/([0-9]+)/(\w+)$",), ("^$",)], "p string")
    text, params = routes.template_from_regex(F.col("p"))
    assert [tuple(r) for r in one.select(text, params).collect()] == [("/item/:id/:param2", ["id", "param2"]), ("/", [])]
    paths = spark.createDataFrame([("/a/1/2/b/",), ("/",), ("/x1/22",)], "p string")
    assert [r[0] for r in paths.select(routes.path_template(F.col("p"))).collect()] == ["/a/:id/:id/b", "/", "/x1/:id"]


def test_sql_text(spark):
    q = spark.createDataFrame([("UPDATE users SET a=1, b=2 WHERE c=3",), ("SELECT u.id, name AS n FROM Users u JOIN orders o WHERE u.x = 1",), ("DROP x",)], "q string")
    got = [tuple(r) for r in q.select(sqltext.operation(F.col("q")), sqltext.main_table(F.col("q")), sqltext.columns(F.col("q")), sqltext.all_tables(F.col("q"))).collect()]
    assert got[0] == ("UPDATE", "users", ["a", "b", "c"], ["users"])
    assert got[1] == ("SELECT", "users", ["id", "name", "x"], ["orders", "users"])
    assert got[2][:2] == ("OTHER", None)
    parts = spark.createDataFrame([("a(b,c),d",), ("",)], "t string").select(sqltext.split_at_commas(F.col("t")))
    assert [r[0] for r in parts.collect()] == [["a(b,c)", "d"], []]
    ddl = spark.createDataFrame([("CREATE TABLE t (id INT(11) NOT NULL, -- x\n name VARCHAR(10), key_part INT, PRIMARY KEY (id)) ENGINE=X; SELECT 1;",)], "content string")
    assert rows(sqltext.ddl_columns(ddl).select("table", "ordinal", "name", "data_type", "nullable")) == [("t", 1, "id", "int(11)", False), ("t", 2, "name", "varchar(10)", True), ("t", 3, "key_part", "int", True)]


def test_code_structure(spark):
    php = "<?php\nclass A extends B implements C, D {\n  static function go($a, $b = f(1,2)) {\n    if ($a && $b) {\n      return ['id' => 1, 'name' => 'x'];\n    }\n  }\n}\n$v = new A(1);\n$v->go(1);\nA::go(2);\n$_SESSION['u'] = $_SESSION['r'];\n$x = $_GET['page'] ?? 1;\n"
    f = spark.createDataFrame([("a.php", php)], "path string, content string")
    got = code.functions(f).select("name", "is_static", "line_start", "line_end", "cyclomatic_complexity").collect()
    assert [tuple(r) for r in got] == [("go", True, 3, 7, 3)]
    assert [tuple(r) for r in code.classes(f).collect()] == [("a.php", "A", "B", ["C", "D"])]
    one = f.select(code.session_reads(F.col("content")), code.request_params(F.col("content")), code.superglobals(F.col("content"))).first()
    assert one[0] == ["r"] and one[1] == ["page"] and one[2] == ["$_GET", "$_SESSION"]
    classes = spark.createDataFrame([("A",)], "name string")
    assert rows(calls.class_usages(f, classes).select("line", "kind", "member")) == [(9, "instantiation", None), (11, "static_call", "go")]
    assert rows(calls.method_calls(f)) == [("a.php", 10, "A", "go")]


def test_values(spark):
    data = [("(int)$x", "k"), ("count($a)", "k"), ("'s'", "k"), ("1.5", "k"), ("$y", "foo"), ("$y", "price")]
    got = spark.createDataFrame(data, "v string, k string").select(code.value_type(F.col("v"), F.col("k"))).collect()
    assert [r[0] for r in got] == ["int", "int", "string", "float", "mixed", "float"]
    lit = spark.createDataFrame([("null",), ("TRUE",), ("12",), ("'a'",), ("[]",), ("f()",)], "v string").select(code.literal(F.col("v")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in lit] == [("null", None), ("bool", "true"), ("int", "12"), ("string", "a"), ("array", "[]"), ("raw", "f()")]


def test_types_and_names(spark):
    t = spark.createDataFrame([("tinyint(1)",), ("TINYINT(4)",), ("bigint(20)",), ("geometry",)], "t string").select(*derive.sql_type(F.col("t")))
    assert [tuple(r) for r in t.collect()] == [("boolean", "boolean"), ("tinyint", "number"), ("bigint", "string"), ("varchar", "string")]
    p = spark.createDataFrame([("?int",), ("int|string",), ("string[]",), ("Foo",)], "t string").select(derive.php_type(F.col("t")))
    assert [r[0] for r in p.collect()] == ["number | null", "number | string", "string[]", "Foo"]
    n = spark.createDataFrame([("user_name",), ("HTTPServer",), ("getURLFor",)], "n string")
    got = [tuple(r) for r in n.select(naming.pascal(F.col("n")), naming.camel(F.col("n")), naming.snake(F.col("n")), naming.kebab(F.col("n"))).collect()]
    assert got == [("UserName", "userName", "user_name", "user-name"), ("Httpserver", "httpserver", "http_server", "http-server"), ("Geturlfor", "geturlfor", "get_url_for", "get-url-for")]
    e = spark.createDataFrame([("critical", False), ("low", True)], "p string, d boolean").select(derive.timeout_ms(F.col("p"), F.col("d")))
    assert [r[0] for r in e.collect()] == [2500, 12000]


def test_calls(spark):
    rows_ = [("loop", 10)] + [("x", i) for i in range(11, 30)] + [("call", 30), ("call", 31)]
    df = spark.createDataFrame([(1, n, k) for k, n in rows_], "f int, line int, k string")
    assert calls.look_ahead(df, "f", ["line"], F.col("k") == "loop", F.col("k") == "call").first()["n_ahead"] == 1
    one = spark.createDataFrame([("m", "a")] * 10, "m string, c string")
    assert tuple(rollup.call_frequency(one, ["m"], "c").first()) == ("m", 10, 1, True, False)
    s = spark.createDataFrame([(20, 2), (5, 5), (5, 2)], "a int, b int").select(rollup.cache_strategy(F.col("a"), F.col("b")))
    assert [r[0] for r in s.collect()] == ["ttl_300", "request_scoped", "ttl_60"]
    e = spark.createDataFrame([("small",)] * 3 + [("medium",)] * 2 + [("large",)], "effort string")
    assert tuple(rollup.effort_score(e).first()) == (16, "medium")


def test_coverage(spark):
    df = spark.createDataFrame([(["id", "name", "price", "qty"], ["id", "name", "extra"])], "e array<string>, a array<string>")
    assert tuple(df.select(*coverage.array_coverage(F.col("e"), F.col("a"))).first()) == (2, 2, 1, 50.0)


def test_segments(spark):
    plain = "\n".join(f"line {i}" for i in range(410))
    marked = "\n".join("function f() {" if i == 395 else f"line {i}" for i in range(800))
    df = spark.createDataFrame([(1, plain), (2, marked), (3, ""), (4, None)], "doc_id long, text string")
    got = rows(segment.fixed_segments(df))
    assert [r[2:] for r in got if r[0] == 1] == [(1, 400), (401, 410)]
    assert [r[2:] for r in got if r[0] == 2] == [(1, 395), (396, 795), (796, 800)]
    assert not [r for r in got if r[0] in (3, 4)]
    marks = spark.createDataFrame([(1, 2, "FUNCTION"), (1, 60, "FUNCTION"), (1, 70, "CONTROL")], "doc_id long, line long, kind string")
    n = spark.createDataFrame([(1, 120)], "doc_id long, n long")
    assert [r[2:] for r in rows(segment.boundary_chunks(marks, n, ["FUNCTION", "CLASS"]))] == [(1, 59), (60, 120)]


def test_segments_partition_every_text(spark):
    from srclens.plans import catalogue

    for name in ("fixed_segments", "boundary_chunks"):
        last = {}
        for r in catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").orderBy("doc_id", "job").collect():
            assert r["start_line"] == last.get(r["doc_id"], 0) + 1 and r["end_line"] >= r["start_line"]
            last[r["doc_id"]] = r["end_line"]
        assert last


def test_sources(spark, tmp_path):
    (tmp_path / "src/vendor").mkdir(parents=True)
    (tmp_path / "src/a.php").write_text("<?php\n")
    (tmp_path / "src/vendor/b.php").write_text("x")
    (tmp_path / "src/c.txt").write_bytes("é".encode("latin-1"))
    found = files.source_files(spark, str(tmp_path / "src"), exclude=["vendor"])
    assert [r["path"].rsplit("/", 1)[1] for r in found.collect()] == ["a.php"]
    assert [r["content"] for r in files.decoded_files(spark, str(tmp_path / "src"), "*.txt").collect()] == ["é"]
    ini = spark.createDataFrame([("m", i, s) for i, s in enumerate(['[submodule "a"]', " path = x", " url = u", '[submodule "b"]', "path=y"])], "path string, line int, text string")
    assert rows(files.ini_sections(ini)) == [("m", "a", "path", "x"), ("m", "a", "url", "u"), ("m", "b", "path", "y")]
    assert "| 1 |" in files.markdown(spark.createDataFrame([(1,)], "a int"))
