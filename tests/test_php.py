"""PHP rules, server configuration and module derivations on small files."""

from pyspark.sql import functions as F

from srclens.functions import rule_sets
from srclens.operators import code, modules, php, shapes, webconf

FILE = """<?php
require_once 'lib/db.php';
define('LIMIT', 5);
function getItems($id, array $opts = []) {
  $r = $db->query("SELECT * FROM items WHERE id = " . $_GET['id'] . " LIMIT 10");
  try { $db->beginTransaction(); } catch (Exception $e) { return null; }
  return ['id' => 1, 'name' => $r];
}
echo $_GET['q'];
$page = $_GET['page'] ?? 1;
$redis->set('items:all', $x, 60);
if (isset($_POST['mode'])) { throw new NotFound('x'); }
move_uploaded_file($_FILES['doc']['tmp_name'], 'up/');
if ($_FILES['doc']['size'] > 5) die('big');
?>
<html><body></body></html>
"""


def files(spark):
    return spark.createDataFrame([("src/index.php", FILE)], "path string, content string")


def test_rules_find_their_lines(spark):
    found = {(r["family"], r["type"], r["line"]) for r in php.findings(files(spark)).collect()}
    for want in [("security", "sql_injection", 5), ("security", "xss", 9), ("config", "define", 3), ("pagination", "limit", 5), ("pagination", "param", 10), ("transaction", "begin", 6), ("error", "throw", 12), ("error", "die", 14), ("cache", "redis", 11), ("resilience", "fallback", 6), ("include", "require_once", 2), ("database", "select", 5)]:
        assert want in found, want
    assert len({r.rule_id for r in rule_sets.ALL}) == len(rule_sets.ALL)
    assert [r["has_rollback"] for r in php.with_lock_and_rollback(php.findings(files(spark))).collect()] == [False]
    assert {(r["line"], r["types"], r["has_sort"]) for r in php.pagination(php.findings(files(spark))).collect()} == {(5, "limit", False), (10, "param", False)}


def test_contracts(spark):
    f = files(spark)
    got = {r["param"]: (r["type"], r["required"], r["default"]) for r in php.request_contract(f).collect()}
    assert got["page"] == ("int", True, ("int", "1")) and got["mode"][1] is False and got["id"][0] == "int"
    assert tuple(php.uploads(f).first()) == ("src/index.php", "doc", False, True, "up/", 5, [])
    more = """$_FILES['a']['name']; if ($_FILES["a"]['size'] >= 2 * 1024 * 1024) {} if (!in_array($_FILES['a']['type'], ['image/png', "image/jpeg"]) || $_FILES['a']['type'] != 'image/gif') {} $_FILES['b']['tmp_name'];"""
    got = {r["field"]: (r["checks_type"], r["checks_size"], r["max_size"], r["types"]) for r in php.uploads(spark.createDataFrame([("x", more)], "path string, content string")).collect()}
    assert got == {"a": (True, True, 2 * 1024 * 1024, ["image/gif", "image/jpeg", "image/png"]), "b": (False, False, None, [])}
    assert php.api_info(f).first()["methods"] == ["GET", "POST"]
    assert f.select(php.cache_ttl(F.col("content"), F.lit("items:all"))).first()[0] == 60
    fns = code.functions(f)
    params = [tuple(r)[2:] for r in php.parameters(fns).orderBy("position").collect()]
    assert params == [(1, "id", None, False, False, None), (2, "opts", "array", False, True, "[]")]
    fields = shapes.return_fields(code.token_table(f))
    r = php.returns(fns, fields).first()
    assert r["types"] == ["array"] and r["nullable"] and r["keys"] == ["id", "name"]
    assert php.type_coverage(fns).first()[0] == 33.33
    assert tuple(php.include_edges(f).first()) == ("index.php", "db.php")
    assert php.main_function(fns, fields).first()["name"] == "getItems"
    m = php.file_metrics(f).first()
    assert m["total_lines"] == 17 and m["html_lines"] == 1 and m["n_functions"] == 1 and m["class"] == "entry"


def test_server_configuration(spark):
    text = "RewriteCond %{REQUEST_METHOD} POST\nRewriteRule ^item/([0-9]+)/(\\w+)$ item.php?id=$1 [L,QSA]\nRewriteCond a b\nRewriteRule x -\nRewriteRule ^old$ new.php [R=301,L]\n"
    got = webconf.rewrite_rules(spark.createDataFrame([("h", text)], "path string, content string")).orderBy("line").collect()
    assert [(r["template"], r["method"], r["n_conditions"], r["is_redirect"], r["priority"]) for r in got] == [("/item/:id/:param2", "POST", 1, False, 0), ("/old", "GET", 0, True, 1)]
    assert got[0]["target_file"] == "item.php" and got[0]["query_params"] == ["id"]
    nginx = "location /api { try_files $uri /index.php?$args; }\nlocation ~ ^/x/([0-9]+)$ { fastcgi_param SCRIPT_FILENAME $root/x.php; }\nrewrite ^/a/(.*)$ /b.php last;\nrewrite ^/c https://other.org/ permanent;"
    n = spark.createDataFrame([("n", nginx)], "path string, content string")
    assert [(r["template"], r["target"]) for r in webconf.nginx_locations(n).collect()] == [("/api", "/index.php"), ("/x/:id", "/x.php")]
    assert [r["target"] for r in webconf.nginx_rewrites(n).collect()] == ["/b.php"]
    php_ = "switch ($_POST['act']) { case 'add': f(); case 'del': g(); }\nif ($_GET['page'] == 'home') {}\n$r->get('/users', 'x');"
    c = webconf.code_routes(spark.createDataFrame([("c", php_)], "path string, content string"))
    assert {tuple(r)[1:] for r in c.collect()} == {("switch", "POST", "/act/add"), ("switch", "POST", "/act/del"), ("if", "GET", "/page/home"), ("router", "GET", "/users")}
    w = spark.createDataFrame([("/w/public/index.php", "<?php echo 1;"), ("/w/public/a/b.php", "<?php echo $_POST['x'];"), ("/w/public/config.php", "")], "path string, content string")
    assert [(r["route"], r["methods"], r["priority"]) for r in webconf.file_routes(w, "/public").orderBy("route").collect()] == [("/", ["GET"], 1000), ("/a/b", ["GET", "POST"], 1001)]


def test_modules(spark):
    cols = spark.createDataFrame([("t", 1, "id", "int", False, True, True), ("t", 2, "a.b", "int", True, False, False), ("t", 3, "n", "text", True, False, False)], "table string, ordinal long, name string, data_type string, nullable boolean, primary_key boolean, auto_increment boolean")
    assert modules.condensed_schema(cols).first()["columns"] == ["id int pk required auto", "n text"]
    contracts = spark.createDataFrame([("Shop", "CartService", "getItems", "array", None, None), ("Shop", None, "save", None, None, "void")], "service string, class_name string, method string, hint string, doc string, inferred string")
    e = {r["method"]: r for r in modules.endpoints(contracts).collect()}
    assert e["getItems"]["message"] == "shop.cart.get_items" and e["getItems"]["response_type"] == "{ items, total }" and e["save"]["response_type"] == "{ success }"
    freq = spark.createDataFrame([(None, "save", 7, True)], "class_name string, name string, total_calls long, is_hot boolean")
    assert {(r["method"], r["total_calls"]) for r in modules.with_frequency(contracts, freq).collect()} == {("getItems", 0), ("save", 7)}
    assert {r["case"] for r in modules.interactions(modules.endpoints(contracts)).where("message like '%get%'").collect()} == {"success", "not_found"}
    some, none = cols.limit(1), cols.limit(0)
    assert modules.health_checks(some).count() == 3 and modules.health_checks(none).count() == 2
    assert modules.migration_checklist(some, none).count() == 6
    assert modules.metric_definitions(freq, "name").count() == 6
    order = spark.createDataFrame([("UserData", 1), ("auth", 2)], "name string, place long")
    assert [tuple(r) for r in modules.workspace(order).orderBy("port").collect()] == [("UserData", "user-data", 3001), ("auth", "auth", 3002)]
    uses = spark.createDataFrame([("p", 3, "static_call", "A", "go", "shop_api"), ("p", 9, "instantiation", "A", None, "shop_api")], "path string, line long, kind string, class_name string, member string, service string")
    assert [(r["line"], r["new"]) for r in modules.replacements(uses).collect()] == [(9, "$shopApiClient"), (3, "$shopApiClient->go(")]
    assert [r[0] for r in modules.key_decisions(spark.sql("select 5 as n, 0 as m"), [("n > 3", "split"), ("m > 0", "share")]).collect()] == ["split"]
    merged = modules.merged_clusters(spark.createDataFrame([("user_x", "f1"), ("my_user", "f2"), ("z", "f3")], "cluster string, file string"), {"user": "users"})
    assert {tuple(r) for r in merged.collect()} == {("users", "f1"), ("users", "f2"), ("z", "f3")}
