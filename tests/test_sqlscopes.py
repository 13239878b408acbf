"""Columns of SQL through aliases, subqueries, common table expressions and unions."""

from srclens.operators import sqlscopes

CASES = [
    ("SELECT u.id, o.total AS t, name FROM users u JOIN shop.orders AS o ON o.user_id = u.id WHERE u.age > 5 ORDER BY t", [("users", "id"), ("orders", "total"), (None, "name"), ("orders", "user_id"), ("users", "id"), ("users", "age")]),
    ("SELECT a, count(*) n FROM t WHERE b IN (SELECT x FROM s WHERE s.y = t.c AND z = 1) GROUP BY a", [("t", "a"), ("t", "b"), ("s", "x"), ("s", "y"), ("t", "c"), ("s", "z"), ("t", "a")]),
    ("WITH c AS (SELECT id, v FROM base) SELECT c.id, d.w FROM c, other d WHERE c.v = d.v", [("base", "id"), ("base", "v"), (None, "id"), ("other", "w"), (None, "v"), ("other", "v")]),
    ("INSERT INTO t (a, b) SELECT s.x, y FROM s -- from nowhere\n", [("t", "a", "write"), ("t", "b", "write"), ("s", "x"), ("s", "y")]),
    ("UPDATE t SET a = b + 1, t.c = 'x, y' WHERE d = 2", [("t", "a", "write"), ("t", "b"), ("t", "c", "write"), ("t", "d")]),
    ("SELECT q.m FROM (SELECT max(p.v) AS m FROM p) q UNION ALL SELECT r.k FROM r WHERE EXISTS (SELECT 1 FROM w WHERE w.i = (SELECT r.j FROM v))", [(None, "m"), ("p", "v"), ("r", "k"), ("w", "i"), ("r", "j")]),
    ("DELETE FROM t WHERE t.a = 1", [("t", "a")]), (None, []), ("", []), ("nonsense ((", []), ('SELECT `a b`, "C" FROM `My T` x', [("my t", "a b"), ("my t", "c")]),
    ("SELECT x.a FROM t1 x WHERE x.b = (SELECT max(x.c) FROM t2 x)", [("t1", "a"), ("t1", "b"), ("t2", "c")]), ("SELECT nobody.a FROM t", [(None, "a")]),
]


def test_columns_are_resolved(spark):
    queries = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(CASES)], "id long, sql string")
    found = {}
    for r in sqlscopes.resolved_columns(queries).orderBy("id", "offset").collect():
        assert CASES[r["id"]][0][r["offset"] :].lstrip('`"').lower().startswith((r["column"], "u", "o", "s", "t", "c", "d", "q", "p", "r", "w", "x", "n"))
        found.setdefault(r["id"], []).append((r["table"], r["column"], r["role"]))
    assert {i: found.get(i, []) for i in range(len(CASES))} == {i: [(*x, "read")[:3] for x in want] for i, (_, want) in enumerate(CASES)}


def test_tokens_are_placed_without_an_array_that_grows(spark):
    text = "SELECT a,\n  'x\ny' -- c\nFROM t"
    df = sqlscopes.tokens(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, sql string"))
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString().replace("Aggregate", "")
    got = [(r["token"], r["offset"], r["line"]) for r in df.orderBy("n").collect()]
    assert got == [("SELECT", 0, 1), ("a", 7, 1), (",", 8, 1), ("'x\ny'", 12, 2), ("FROM", 23, 4), ("t", 28, 4)]
    many = sqlscopes.tokens(spark.createDataFrame([(1, "SELECT a" + ", a" * 20_000)], "id long, sql string"))
    assert many.selectExpr("max(`offset`)").first()[0] == len("SELECT a") + 3 * 20_000 - 1
