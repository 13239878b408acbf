"""Tokens, brackets, functions, return shapes, loops and call graphs of code against brute force and worked examples."""

import random
import re

import pytest
from pyspark.sql import functions as F

from srclens.operators import code, flow, lexer, shapes
from srclens.operators.intervals import innermost

FILE = "path string, content string"
OPEN_TAG, LABEL, WORD = re.compile(r"<\?(?:php\b|=|(?!xml))"), re.compile(r"<<<[ \t]*['\"]?(\w+)['\"]?[^\S\n]*(?=\n|\Z)"), re.compile(r"[^\S\n]*(\w+)")


def kinds_by_character(text):
    """What each character of a text is in: page, string, comment, heredoc, code, or a line end; one character after another."""
    state, at, label, out = "page" if "<?" in text else "code", 0, None, []

    def take(n, kind):
        nonlocal at
        out.extend("end" if c == "\n" else kind for c in text[at : at + n])
        at += n

    while at < len(text):
        c = text[at]
        if state == "page":
            m = OPEN_TAG.match(text, at)
            take(m.end() - at if m else 1, "page")
            state = "code" if m else state
        elif state == "code":
            if c in "'\"":
                state = c
                take(1, "string")
            elif text.startswith("/*", at):
                state = "block"
                take(2, "comment")
            elif text.startswith("//", at) or (c == "#" and not text.startswith("#[", at)):
                state = "line"
            elif text.startswith("?>", at):
                state = "page"
                take(2, "page")
            elif m := LABEL.match(text, at):
                label, state = m[1], "heredoc"
                take(m.end() - at, "heredoc")
                take(1, "heredoc")
            else:
                take(1, "code")
        elif state == "line":
            if c == "\n" or text.startswith("?>", at):
                state = "code"
            else:
                take(1, "comment")
        elif state in "'\"":
            if c == "\\" and at + 1 < len(text):
                take(2, "string")
                continue
            take(1, "string")
            state = "code" if c == state else state
        elif state == "block":
            if text.startswith("*/", at):
                take(2, "comment")
                state = "code"
            else:
                take(1, "comment")
        else:
            m = WORD.match(text, at)
            if m and m[1] == label:
                take(m.end() - at, "heredoc")
                state = "code"
            else:
                end = text.find("\n", at)
                take((len(text) if end < 0 else end) - at + 1, "heredoc")
    return out


@pytest.mark.parametrize("chunk", [256, 2])
def test_tokens_against_characters(spark, chunk):
    r = random.Random(5)
    parts = ["'", '"', "\\", "/*", "*/", "//", "#", "?>", "<?php ", "<?=", "<?xml", "\n", "\n", "a", "b1", "$x", " ", "{", "}", "(", ")", "[", "]", "<<<EOT\n", "EOT", "EOT;\n", "  EOT", "<<<'X'\n", "X", "=>", "#[", "*", "/", "é"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(120))) for _ in range(200)]
    texts += ["<?php " + t for t in texts[:100]] + ["", "\n", "<?php"]
    found = {}
    for x in lexer.tokens(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], FILE), chunk=chunk).collect():
        found.setdefault(int(x["path"]), []).append(x)
    for i, text in enumerate(texts):
        kinds = ["end" if c == "\n" else None for c in text]
        for x in found.get(i, []):
            assert text[x["pos"] : x["pos"] + len(x["token"])] == x["token"] and text.count("\n", 0, x["pos"]) + 1 == x["line"]
            for k in range(x["pos"], x["pos"] + len(x["token"])):
                assert kinds[k] is None
                kinds[k] = x["kind"] if x["kind"] in ("page", "string", "comment", "heredoc") else "code"
        assert kinds == kinds_by_character(text), text


def test_brackets_against_a_stack(spark):
    r = random.Random(7)
    texts = ["".join(r.choice("(){}[];a ") for _ in range(r.randrange(60))) for _ in range(100)]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], FILE)
    got = {(x["path"], x["opens"]): x["closes"] for x in lexer.brackets(lexer.with_depth(lexer.code_tokens(lexer.tokens(files)))).collect()}
    want = {}
    for i, text in enumerate(texts):
        stack = []
        for k, c in enumerate(text):
            if c in "([{":
                stack.append(k)
                want[str(i), k] = None
            elif c in ")]}" and stack:
                want[str(i), stack.pop()] = k
    assert got == want


def test_innermost_against_brute_force(spark):
    r = random.Random(3)
    ranges, points = [], []

    def fill(key, low, high, depth):
        at = low
        while at < high and depth < 5:
            a = r.randint(at, high)
            b = r.randint(a, high)
            if r.random() < 0.7 and (a, b) != (low, high):
                ranges.append((key, a, b))
                fill(key, a + 1, b - 1, depth + 1)
            at = b + 1

    for key in range(20):
        fill(key, 0, 60, 0)
        points += [(key, r.randint(-2, 62)) for _ in range(30)]
    got = innermost(spark.createDataFrame(points, "k long, at long"), spark.createDataFrame(ranges, "k long, a long, b long"), ["k"], "at", "a", "b").collect()
    assert len(got) == len(points)
    for x in got:
        around = [(b - a, a, b) for k, a, b in ranges if k == x["k"] and a <= x["at"] <= b]
        assert (tuple(x["within"]) if x["within"] else None) == (min(around)[1:] if around else None)


def test_functions(spark):
    long = "<?php\nfunction big() {\n" + "".join(f"  $x{i} = {i}; // }} }}\n" for i in range(700)) + "}\nfunction after() { return 1; }\n"
    other = (
        "<?php\nfunction f($a, $b = [1, 2], $c = array(')')) {\n  echo \"}\";\n  $q = '}';\n  /* } */\n  return 1;\n}\n"
        "abstract class X { abstract protected function g(); final public static function &h(?int $x): ?array { return []; } }\n$z = function ($k) use ($q) { return 2; };"
    )
    files = spark.createDataFrame([("a", long), ("b", other), ("c", None), ("d", "no code"), ("e", "<?php function open() { if (1) {"), ("f", "<?php\n$s = <<<EOT\nfunction no() { }\nEOT;\nfunction yes()\n{\n}\n")], FILE)
    got = {(r["path"], r["name"]): r for r in code.functions(files).collect()}
    assert {k: (r["line_start"], r["line_end"], r["is_static"]) for k, r in got.items()} == {
        ("a", "big"): (2, 703, False), ("a", "after"): (704, 704, False), ("b", "f"): (2, 7, False), ("b", "g"): (8, 9, False), ("b", "h"): (8, 8, True), ("e", "open"): (1, 2, False), ("f", "yes"): (5, 7, False),
    }
    assert got["b", "f"]["params"] == ["$a", "$b = [1, 2]", "$c = array(')')"] and got["a", "after"]["body"] == "function after() { return 1; }"


def test_return_fields(spark):
    text = """<?php
function f() { return ['a' => ['b' => 1], 'c' => 2]; }
function g($x) { if ($x) { return array('k' => array('m' => count($x), 'n' => ['deep' => (int)$y])); } return null; }
function h() { $r = ['old' => 1]; $r = ['id' => 5, 'price' => $p]; $r['name'] = trim($n); $r['sub']['in'] = [1, 'q' => 'z']; $r['rows'][] = ['w' => 1.5]; foo($r['no']); $t['zz'] = 1; return $r; $r['late'] = 1; }
function i($x) { return $x ? ['yes' => true] : ['no' => "}"]; }
function j() { return f(['arg' => 1]); }
function k() { return [['x' => 1], ['x' => 2, 'y' => null]]; }
function l() { $c = function () { return ['closure' => 1]; }; return ['own' => $a['idx'], 'e' => 'a' . 'b']; }
"""
    files = spark.createDataFrame([("a", text), ("b", None), ("c", "<?php function n() { return ['l' => [[[['z' => -5]]]]]; }")], FILE)
    got = [(r["name"], ".".join(r["keys"]), r["type"]) for r in shapes.return_fields(code.token_table(files)).orderBy("path", "line_start", "pos").collect()]
    assert got == [
        ("f", "a", "array"), ("f", "a.b", "int"), ("f", "c", "int"), ("g", "k", "array"), ("g", "k.m", "int"), ("g", "k.n", "array"), ("g", "k.n.deep", "int"),
        ("h", "id", "int"), ("h", "price", "float"), ("h", "name", "string"), ("h", "sub.in", "array"), ("h", "sub.in.q", "string"), ("h", "rows.[]", "array"), ("h", "rows.[].w", "float"),
        ("i", "yes", "bool"), ("i", "no", "string"), ("k", "[].x", "int"), ("k", "[].y", "null"), ("l", "own", "mixed"), ("l", "e", "string"), ("n", "l", "array"), ("n", "l.[].[].[].z", "int"),
    ]


CALLS = """<?php
function top() { helper(1); foreach (rows() as $r) { $db->load($r); if ($r) { while (next2()) step(); outside(); } } done(); }
for ($i = 0; $i < n(); $i++): f($i); foreach ($a as $b): g($b); endforeach; h(); endfor;
do { once(); } while (again());
class C { function m() { $this->k(); self::s(); D::t(); } function k() { write_it(); } static function s() {} }
function helper($x) { $s = 'fake(1)'; top(); }
"""
MORE = "<?php class D { public static function t() { other(); } function other() { new C(); } } function write_it() { } a(); a(); a();"


def test_calls_loops_and_graph(spark):
    tokens = code.token_table(spark.createDataFrame([("a", CALLS), ("b", MORE)], FILE))
    found = flow.loop_calls(tokens)
    loops = {r["name"]: (r["loop"], r["loop_line"]) for r in found.where("path = 'a' and line < 5").collect()}
    assert loops == {
        "helper": (None, None), "rows": ("foreach", 2), "load": ("foreach", 2), "next2": ("while", 2), "step": ("while", 2), "outside": ("foreach", 2), "done": (None, None),
        "n": ("for", 3), "f": ("for", 3), "g": ("foreach", 3), "h": ("for", 3), "once": ("do", 4), "again": ("while", 4),
    }
    batches = {r["name"]: tuple(r)[1:] for r in flow.batch_opportunities(found).collect()}
    assert batches["a"] == ("sequential_calls", "b", 3, "bulkA", "medium") and batches["load"] == ("loop_calls", "a", 1, "bulkLoad", "medium") and "done" not in batches
    assert spark.createDataFrame([("getItems_by2x",)], "n string").select(flow.title(F.col("n"))).first()[0] == "getItems_by2x".title()
    graph = flow.call_graph(tokens)
    assert {tuple(r) for r in graph.collect()} == {
        ("a#C.k", "b#write_it"), ("a#C.m", "a#C.k"), ("a#C.m", "a#C.s"), ("a#C.m", "b#D.t"), ("a#helper", "a#top"), ("a#top", "a#helper"),
    }
    assert {r["id"] for r in flow.reaching(graph, spark.createDataFrame([("b#write_it",)], "id string")).collect()} == {"a#C.k", "a#C.m", "b#write_it"}


@pytest.mark.parametrize(("n", "m", "seed"), [(30, 35, 1), (30, 60, 2), (12, 12, 3)])
def test_reaching_against_search(spark, n, m, seed):
    r = random.Random(seed)
    edges = sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})
    targets = sorted({r.randrange(n) for _ in range(2)})
    want = set(targets)
    while new := {a for a, b in edges if b in want} - want:
        want |= new
    got = flow.reaching(spark.createDataFrame(edges, "caller long, callee long"), spark.createDataFrame([(x,) for x in targets], "id long"))
    assert {x["id"] for x in got.collect()} == want


def test_reaching_along_a_chain(spark):
    edges = spark.range(10_000).selectExpr("id caller", "id + 1 callee")
    assert flow.reaching(edges, spark.createDataFrame([(10_000,)], "id long")).count() == 10_001


def test_required_literals_and_listed_rules(spark, monkeypatch):
    """What a rule needs stands in every match, and rules as a list find what each of them finds as an expression."""
    from srclens.functions import literals, rule_sets
    from srclens.operators import scan
    from srclens.plans import code_texts

    assert literals.required(r"(?i)\bFoo(?:bar|baz)\s*\(x+") == ("fooba",)
    assert literals.required(r"(?:abc|de)f?") == ("abc", "de") and literals.required(r"a|bc") == () and literals.required(r"(?:xy)*") == () and literals.required("éa") == ()
    lines = code_texts.SAMPLES
    for rule in rule_sets.ALL:
        needs = literals.required(rule.pattern)
        for line in lines:
            if needs and re.search(rule.pattern, line):
                assert any(x in line.lower() for x in needs), (rule.pattern, line)
    inside = [r for r in rule_sets.ALL if not r.multiline]
    files = spark.createDataFrame([(str(i), "\n".join(lines[i : i + 9]).swapcase() if i % 5 == 0 else "\n".join(lines[i : i + 9])) for i in range(0, len(lines), 3)] + [("n", None)], FILE)
    listed = sorted(map(tuple, scan.scan_lines(files, inside, "path", "content").collect()))
    monkeypatch.setattr(scan, "UNROLLED", 10_000)
    assert listed == sorted(map(tuple, scan.scan_lines(files, inside, "path", "content").collect())) and len(listed) > 300
