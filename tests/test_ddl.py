"""Keys, options and details of DDL written in many ways; include files by what they do."""

from pyspark.sql import functions as F

from srclens.operators import ddl, php

TEXT = """-- orders; with a comment (and parentheses
CREATE TABLE IF NOT EXISTS `shop`.`orders` (
  id INT(11) NOT NULL AUTO_INCREMENT, /* key; */ note VARCHAR(40) DEFAULT 'a; b, (c)' COMMENT 'it''s',
  total DECIMAL(10,2) DEFAULT -1, made DATETIME DEFAULT NOW(), kind ENUM('x','y') DEFAULT 'x', `key` TEXT,
  PRIMARY KEY (id, kind), UNIQUE (note(10)), UNIQUE INDEX `by_kind` (kind, note(5)), KEY (made), INDEX by_total (total DESC),
  CONSTRAINT fk_user FOREIGN KEY (user_id, shop_id) REFERENCES shop.users (id, shop) ON UPDATE CASCADE ON DELETE SET NULL,
  FOREIGN KEY (kind) REFERENCES kinds(code)
) ENGINE = InnoDB, DEFAULT CHARACTER SET = utf8mb4;
create temporary table t2 (a int) charset latin1;
ALTER TABLE orders ADD COLUMN z INT, ADD CONSTRAINT fk_z FOREIGN KEY (z) REFERENCES zs (id) ON DELETE NO ACTION, ADD FOREIGN KEY (y) REFERENCES ys (id) ON UPDATE RESTRICT;
ALTER TABLE elsewhere ADD FOREIGN KEY (a) REFERENCES b (c);
CREATE INDEX i ON orders (id); SELECT 'CREATE TABLE no (id INT)';
"""


def rows(df):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect())


def test_keys_and_options(spark):
    files = spark.createDataFrame([(TEXT,), (None,), ("",), ("CREATE TABLE broken (id INT",), ("CREATE TABLE",)], "content string")
    assert rows(ddl.indexes(files).where("table = 'orders'")) == [
        ("orders", "PRIMARY", ("id", "kind"), True), ("orders", "by_kind", ("kind", "note"), True), ("orders", "by_total", ("total",), False),
        ("orders", "idx_orders_0", ("note",), True), ("orders", "idx_orders_2", ("made",), False),
    ]
    found = {r["name"]: r for r in ddl.foreign_keys(files).collect()}
    user = found["fk_user"]
    assert (user["columns"], user["ref_table"], user["ref_columns"], user["on_delete"], user["on_update"]) == (["user_id", "shop_id"], "users", ["id", "shop"], "SET NULL", "CASCADE")
    assert set(found) == {"fk_user", "fk_orders_kinds", "fk_z", "fk_orders_ys"} and found["fk_orders_ys"]["on_update"] == "RESTRICT"
    assert rows(ddl.table_options(files)) == [("broken", None, None), ("orders", "InnoDB", "utf8mb4"), ("t2", None, "latin1")]
    text = "CREATE TABLE t (id INT(11), note VARCHAR(40) DEFAULT 'a b', total DECIMAL(10,2) DEFAULT -1, made DATETIME DEFAULT NOW(), kind INT DEFAULT 5 NOT NULL, plain TEXT);"
    details = {r["name"]: (r["length"], r["default"]) for r in ddl.column_details(spark.createDataFrame([(text,)], "content string")).collect()}
    assert details == {"id": (11, None), "note": (40, "a b"), "total": (None, "-1"), "made": (None, "NOW()"), "kind": (None, "5"), "plain": (None, None)}


def test_include_files(spark):
    cases = {
        ("/a/config.php", "<?php echo 1;"): True, ("/a/x.php", "<?php function f() { return 'echo'; } // print"): True, ("/a/x.php", "<?php function f() { echo 1; }"): False,
        ("/a/x.php", "<?php class A { } ?>"): True, ("/a/x.php", "<?php class A { } ?><p>page</p>"): False, ("/a/x.php", "<?php interface B { } $x = $_GET['a'];"): False,
        ("/a/x.php", "<?php $x = 1;"): False, ("/a/x.php", "<?php function f() { } ?><?= 1 ?>"): False, ("/a/x.php", None): None,
    }
    df = spark.createDataFrame([(str(i), p, c) for i, (p, c) in enumerate(cases)], "i string, path string, content string")
    got = {int(r["i"]): r["v"] for r in df.select("i", php.is_include_file(F.col("path"), F.col("content")).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_matched_names_against_all_pairs(spark):
    import random

    from srclens.operators import coverage

    r = random.Random(9)
    name = lambda: r.choice(["", "tbl_", "t_", "T_"]) + "".join(r.choice("aby") for _ in range(r.randint(1, 4))) + r.choice(["", "s", "ies", "_id", "X"])
    left, right = [name() for _ in range(120)] + [None, ""], [name() for _ in range(60)] + [None]
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    normal = {x["n"]: x["m"] for x in frame(left + right, "n").where("n is not null").distinct().select("n", coverage.normal_name(F.col("n")).alias("m")).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, above = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, above[j] + 1, above[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for a in {x for x in left if x is not None}:
        others = {x for x in right if x is not None}
        tiers = (
            [(0, b) for b in others if a == b], [(distance(a, b), b) for b in others if normal[a] == normal[b]],
            [(d, b) for b in others if (d := distance(normal[a], normal[b])) <= 1],
        )
        want[a] = next(((min(t)[1], k) for k, t in enumerate(tiers, 1) if t), (None, 0))
    got = {x["a"]: (x["b"], x["tier"]) for x in coverage.matched_names(frame(left, "a"), frame(right, "b"), "a", "b").collect()}
    assert got == want and {t for _, t in got.values()} == {0, 1, 2, 3}
