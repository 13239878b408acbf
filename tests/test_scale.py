"""What grows: tasks, pairs and what passes through the driver, seen in plans and in the counts of their operators."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from srclens.operators import calls, code, coverage, flow, lexer, php, shapes, webconf
from srclens.plans import code_queries, code_texts, fact_queries, registry

FILE = "<?php\nfunction walk($a) { $r = ['k' => 1, 'l' => [2]]; for ($i = 0; $i < 3; $i++) f($i); return $r; }\nwalk(1);"


class Seen:
    """Broadcasts and the most rows of an operator in what ran since ``start``."""

    def __init__(self, spark):
        self.store = spark._jsparkSession.sharedState().statusStore()
        self.start = self.store.executionsCount()

    def nodes(self):
        runs = self.store.executionsList()
        for i in range(runs.size()):
            run = runs.apply(i).executionId()
            if run >= self.start:
                nodes = self.store.planGraph(run).allNodes()
                yield from ((run, nodes.apply(j)) for j in range(nodes.size()))

    def broadcasts(self):
        return sum(n.name() == "BroadcastExchange" for _, n in self.nodes())

    def most_rows(self):
        most = 0
        for run, node in self.nodes():
            for k in range(node.metrics().size()):
                metric = node.metrics().apply(k)
                value = self.store.executionMetrics(run).get(metric.accumulatorId())
                if metric.name() == "number of output rows" and value.isDefined():
                    most = max(most, int(value.get().replace(",", "")))
        return most


@pytest.fixture
def files(spark):
    return spark.createDataFrame([(f"/p{i}.php", FILE) for i in range(200)], "path string, content string")


def plan(df):
    return df._jdf.queryExecution().toString()


def test_texts_of_a_small_file_are_dealt_out_before_they_are_made(spark, monkeypatch):
    monkeypatch.setattr(registry, "SPREAD_ROWS", 50)
    t = registry.Tables(spark, "/root/testdata/sf0.001")
    for frame in (code_texts.PHP.frame(t), code_texts.sampled(t)):
        assert frame.rdd.getNumPartitions() == 4
        assert len({r[0] for r in frame.selectExpr("spark_partition_id()").collect()}) > 1
    long = code_texts.PHP.frame(t).where("size(split(content, '\n')) > 3")
    below = long._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert "concat_ws" not in below


def test_texts_and_lines_are_not_broadcast(spark, files):
    found = code.functions(files, tokens=code.token_table(files))
    assert "BroadcastHashJoin" not in plan(found) and "BroadcastHashJoin" not in plan(lexer.tokens(files))
    t = registry.Tables(spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" not in plan(code_queries.shape_tokens(t))


def test_a_line_is_tokenised_once(files):
    """Its expression stands in the two branches of a line, and in no filter below."""
    assert lexer.tokens(files)._jdf.queryExecution().optimizedPlan().toString().count("->|::") == 2


def test_a_name_of_every_file_makes_no_pairs_of_files(spark, files):
    tokens, seen = code.token_table(files), Seen(spark)
    assert flow.call_graph(tokens).count() == 200
    assert seen.most_rows() <= tokens.count()


def test_a_call_leads_to_the_own_files_function_and_else_to_all(spark):
    texts = {"a": "<?php function f() {} f(); g();", "b": "<?php function g() {}", "c": "<?php function g() {} g();"}
    tokens = code.token_table(spark.createDataFrame(list(texts.items()), "path string, content string"))
    assert {tuple(r) for r in flow.call_graph(tokens).collect()} == {("a#", "a#f"), ("a#", "b#g"), ("a#", "c#g"), ("c#", "c#g")}


def test_only_what_returned_arrays_need_carries_its_neighbours(files):
    tokens = code.token_table(files)
    kept = shapes._placed(tokens)
    assert kept.count() < tokens.count() / 3
    got = {(".".join(r.keys), r.type) for r in shapes.return_fields(tokens).where("path = '/p7.php'").collect()}
    assert got == {("k", "int"), ("l", "array")}


def test_no_window_is_read_again_for_each_row(files):
    tokens = code.token_table(files)
    for df in (flow.loops(tokens), shapes._placed(tokens)):
        assert "currentrow$(), unboundedfollowing$()" not in plan(df)
    assert {r.end_line for r in flow.loops(tokens).collect()} == {2}


def test_names_and_their_deletions_are_not_broadcast(spark):
    left = spark.createDataFrame([("item_1",), ("tbl_Items",), ("itm_a",), ("zzz",)], "l string")
    right = spark.createDataFrame([("item_1",), ("item",), ("item_a",)], "r string")
    seen = Seen(spark)
    got = {tuple(r) for r in coverage.matched_names(left, right, "l", "r").collect()}
    assert got == {("item_1", "item_1", 1), ("tbl_Items", "item", 2), ("itm_a", "item_a", 3), ("zzz", None, 0)}
    assert not seen.broadcasts()


def test_tokens_that_are_read_once_are_not_written(files, monkeypatch):
    """Nor do they leave the partitions of their paths: what follows them shuffles no token again."""
    whole = {tuple(r) for r in code.functions(files, tokens=code.token_table(files)).select("path", "name", "line_end", "body").collect()}

    def refused(*_):
        raise AssertionError("tokens written")

    monkeypatch.setattr(code, "written", refused)
    assert {tuple(r) for r in code.functions(files).select("path", "name", "line_end", "body").collect()} == whole
    windows = plan(code.function_ranges(code._deep_tokens(files, "path", "content"))).split("== Physical Plan ==")[1].split("Generate")[0]
    assert windows.count("Window [") == 3 - 1 and windows.count("Exchange") == 1


def test_patterns_of_a_contract_are_constant(spark):
    """Those made of a parameter's name were compiled for every row, many times each."""
    text = "<?php $a = intval( $_GET['n'] ?? $_POST['m'] ?? 7); isset($_GET['k']); $b = $_GET['k'] ?? 'x'; (bool)$_REQUEST['n'];"
    found = php.request_contract(spark.createDataFrame([("a", text), ("b", None), ("a", "empty ($_GET['z'])")], "path string, content string"))
    assert "concat(" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.path, r.param, r.type, r.required, tuple(r.default)) for r in found.collect()}
    assert got == {("a", "n", "int", True, ("raw", "$_POST['m'] ?? 7")), ("a", "m", "string", True, ("int", "7")), ("a", "k", "string", False, ("string", "x")), ("a", "z", "string", False, ("raw", None))}


def test_a_line_is_searched_for_the_uses_that_it_may_hold(spark, files):
    found = calls.class_usages(files, code.classes(files))
    below = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("Contains(_line#" in below and f", {needs})" in below for _, needs, _ in calls.USAGES)
    text = "class A {}\nnew  A(1); B::f(A $a); class C extends A implements A\nf(A\n$x) A::g (2) new\nA()"
    one = spark.createDataFrame([("p", text), ("n", None)], "path string, content string")
    got = sorted((r.line, r.kind, r.member or "") for r in calls.class_usages(one, code.classes(one)).collect() if r.class_name == "A")
    assert got == [(2, "extends", ""), (2, "implements", ""), (2, "instantiation", ""), (2, "type_hint", ""), (4, "static_call", "g")]


def test_a_text_is_made_once_whatever_reads_it(spark):
    t = registry.Tables(spark, "/root/testdata/sf0.001")
    read = code_texts.PHP.frame(t).where("content like '%a%' and length(content) > 3 and content rlike 'b'")
    assert read._jdf.queryExecution().optimizedPlan().toString().count("concat_ws") == 1


def test_routes_are_read_once_for_their_order(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(webconf, "numbered", lambda df, *_, name: seen.append(plan(df)) or df.withColumn(name, F.lit(0)))
    text = "<?php echo 1; if ($_GET['a']) { $_POST['b']; }"
    files = spark.createDataFrame([("/w/public/a.php", text), ("/w/public/b.php", "<?php Function f() {}"), ("/w/public/c.php", "<?php $function = 'function'; // class"), ("/w/public/d.php", None)], "path string, content string")
    got = {(r.route, len(r.methods)) for r in webconf.file_routes(files, "/public").collect()}
    assert got == {("/a", 2), ("/c", 1)}
    assert "regexp_replace" not in seen[0] and "RLIKE" not in seen[0]


def test_lines_that_end_as_they_begin_are_left_out_of_the_folds(spark):
    lines = spark.createDataFrame([(' $x = "{";',), ("a /* b",), ("TXT",)], "l string")
    assert [r[0] is None for r in lines.select(lexer.line_map(F.col("l"))["ends"]).collect()] == [True, False, True]
    assert "maps" not in lexer.chunked(lines.selectExpr("l as path", "l as content")).columns


def test_calls_on_this_need_no_join(spark):
    text = "<?php class A { function f() { $this->g(); $that->g(); A::f(); } function g() {} } class B { function g() {} }"
    tokens = code.token_table(spark.createDataFrame([("p", text)], "path string, content string"))
    assert [r.on_this for r in flow._sites(tokens).orderBy("pos").collect()] == [True, False, False]
    got = {tuple(r) for r in flow.call_graph(tokens).collect()}
    assert got == {("p#A.f", "p#A.g"), ("p#A.f", "p#B.g"), ("p#A.f", "p#A.f")}


def test_ranges_of_functions_are_found_once(spark, monkeypatch):
    """And what is near a token goes on as the few texts that its row needs, not as a struct for each place."""
    found, ranges = [], code.ranges_of
    monkeypatch.setattr(code, "ranges_of", lambda rows: found.append(1) or ranges(rows))
    monkeypatch.setattr(code, "token_table", None)
    assert code_queries.code_main_function(registry.Tables(spark, "/root/testdata/sf0.001")).count() == 200
    assert len(found) == 1
    monkeypatch.undo()
    texts = {"a": "<?php function f() { $a['x'][2][] = 1 + 2; $a['x']->y = 3; $b = ['k' => g(1, 2, 3)]; return $a; }", "b": "<?php $x = 1"}
    tokens = code.token_table(spark.createDataFrame(list(texts.items()), "path string, content string"))
    placed = shapes._placed(tokens)
    got = {(r.what, r.text, None if r.keys is None else tuple(r.keys), r.value) for r in placed.collect() if r.what != "literal"}
    assert got == {("set", "$a", ("x", "2", "[]"), "1+2"), ("set", "$b", (), "['k'=>g(1"), ("key", "k", None, "g(1,2,"), ("return", "$a", None, None), ("set", "$x", (), "1")}
    assert max(len(str(f.dataType)) for f in placed.schema) < 60


def test_a_files_first_table_is_found_without_its_distinct_tables(spark):
    t = registry.Tables(spark, "/root/testdata/sf0.001")
    found = fact_queries.leftover_cluster(t)
    keys = [x.split("]")[0] for x in found._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [")[1:]]
    assert not any("p_brand" in x or "table" in x for x in keys)
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").selectExpr("o_custkey as file")
    want = fact_queries.brand_pairs(t).join(urgent, "file", "left_anti").groupBy("file").agg(F.min("table"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_neighbours_are_those_of_the_token_table(spark, monkeypatch):
    """In a file's row and, for long files, over dealt chunks; the tokens are those of ``tokens`` on texts made of what begins and ends things."""
    rnd = random.Random(7)
    parts = ["<?php ", "?>", "'", '"', "\\", "/*", "*/", "//", "#", "#[", "\n", "\n", "<<<TXT\n", "TXT", "$a", "$", "function", "f_1", " ", "\t", "(", ")", "{", "}", "=>", "->", "?->", "1.5", "é", "=", "&", "\0", "\0a", "€"]
    texts = [(str(i), "".join(rnd.choice(parts) for _ in range(rnd.choice((0, 9, 60))))) for i in range(300)] + [("null", None)]
    some = spark.createDataFrame(texts, "path string, content string")
    by = Window.partitionBy("path").orderBy("pos")
    near = [f("t", n).over(by).alias(f"{x}{n}") for x, f in (("b", F.lag), ("a", F.lead)) for n in (1, 2, 3)]
    after = F.when(F.lead("t").over(by) != "m(", F.collect_list("t").over(by.rowsBetween(1, 5))).alias("after")
    coded = lexer.code_tokens(lexer.tokens(some)).select("path", (F.row_number().over(by) - 1).alias("k"), "line", "pos", lexer.coded().alias("t"))
    want = sorted(map(str, coded.select("*", *near, after).collect()))
    for chunk, least in ((256, 16), (2, 2)):
        monkeypatch.setattr(lexer, "NEAR", least)
        found = lexer.around(some, 5, lambda t, a1: F.when(a1 != "(", 5), chunk=chunk)
        names = ["t", "b1", "b2", "b3", "a1", "a2", "a3"]
        got = found.select("path", "k", "line", "pos", *[lexer.recoded(F.col(c)).alias(c) for c in names], F.transform("after", lexer.recoded).alias("after"))
        assert sorted(map(str, got.collect())) == want


def dealt(spark, monkeypatch, *more):
    """Files whose partitions are known to be by path."""
    monkeypatch.setattr(registry, "SPREAD_ROWS", 50)
    texts = [*((f"/p{i}.php", FILE) for i in range(200)), *((f"/q{i}.php", x) for i, x in enumerate(more))]
    return registry.spread(spark.createDataFrame(texts, "path string, content string"), "path", "path", "content")


def largest_method(spark, df):
    """Bytes of the largest method of the plan's code: from 8,000 on Java doesn't compile one, and it runs slower."""
    text = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(df._jdf.queryExecution().executedPlan())
    return max(int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text))


def test_functions_shuffle_and_sort_no_token_that_they_do_not_need(spark, monkeypatch):
    """Neither are tokens shuffled again, nor does a window see what isn't a bracket, a semicolon or the word function."""
    files = dealt(spark, monkeypatch)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = code.functions(files)
        assert plan(found).split("== Physical Plan ==")[1].count("hashpartitioning") == 2  # those of the files, read twice
        assert largest_method(spark, found) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    ranges = code.slim(files).collect()
    assert {r.t for r in ranges} == {"(", ")", "[", "]", "{", "}", ";", "function"}
    want = {tuple(r) for r in code.function_ranges(code.token_table(files)).collect()}
    assert {tuple(r) for r in code.ranges_of(code.slim_marks(code.slim(files))).collect()} == want


def test_heads_of_functions_are_those_read_back_from_the_parenthesis(spark):
    rnd = random.Random(3)
    parts = ["function", "Function", "&", "f", "static", "public", "final", "(", "(", ")", "{", "}", ";", "use", "$a", "'s'", "function f(", ") {", "static function"]
    texts = [(str(i), "<?php " + " ".join(rnd.choice(parts) for _ in range(40))) for i in range(300)]
    some = spark.createDataFrame(texts, "path string, content string")
    want = sorted(map(str, code.function_ranges(code._deep_tokens(some, "path", "content")).collect()))
    assert len(want) > 300
    assert sorted(map(str, code.ranges_of(code.slim_marks(code.slim(some))).collect())) == want


def test_returned_fields_are_found_in_the_partitions_of_the_files(spark, monkeypatch):
    """One pass, whose tokens aren't shuffled and whose code is compiled, gives what the token table gives."""
    seen = []

    def kept(df, name):
        seen.append((name, plan(df).split("== Physical Plan ==")[1].count("hashpartitioning"), 0 if seen else largest_method(spark, df)))
        return df.localCheckpoint()

    monkeypatch.setattr(shapes, "written", kept)
    files = dealt(spark, monkeypatch, "<?php function f() { $a['x'][2][] = 'b\nc'; return ['k' => \"d\ne\", \"f\n'\" => 2] + $a; }")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranges, found = shapes.ranges_and_fields(files)
        got = sorted(map(str, ranges.collect())), sorted(map(str, found.collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    name, exchanges, largest = seen[0]
    assert name == "placed-tokens" and largest < 8000
    assert exchanges == 1  # that of the files
    tokens = code.token_table(files)
    assert got == (sorted(map(str, code.function_ranges(tokens).collect())), sorted(map(str, shapes.return_fields(tokens).collect())))


@pytest.mark.parametrize("name", ["loop_calls", "call_graph"])
def test_calls_are_found_in_the_partitions_of_the_files(spark, monkeypatch, name):
    """One pass, whose tokens are neither written nor shuffled, gives what the token table gives, on texts made of what it looks at too."""
    seen = []

    def kept(df, name):
        seen.append((name, plan(df).split("== Physical Plan ==")[1].count("hashpartitioning"), 0 if seen else largest_method(spark, df)))
        return df.localCheckpoint()

    rnd = random.Random(11)
    parts = ["for", "foreach", "while", "do", "endfor", "endWhile", "(", ")", "{", "}", ":", ";", "f", "g(", "function f(", "class A", "class", "new", "$this", "->", "::", "?->", "B", "self::g(", "&", "function", "'x\ny'", "[", "]", "interface"]
    texts = ["<?php " + " ".join(rnd.choice(parts) for _ in range(60)) for _ in range(100)]
    files = dealt(spark, monkeypatch, *texts)
    monkeypatch.setattr(flow, "written", kept)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sorted(map(str, getattr(flow, f"file_{name}")(files).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert seen[0][0].startswith("calls-and-") and seen[0][1] == 1 and seen[0][2] < 8000
    assert got == sorted(map(str, getattr(flow, name)(code.token_table(files)).collect()))
