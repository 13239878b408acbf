"""Code and configuration texts made of table columns: the same template builds them in Spark and in SQL."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclens.plans.registry import Tables, spread

_VALUE = re.compile("«([^»]*)»")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def line_column(line: str) -> Column:
    """A line in which ``«expression»`` stands for a value of both dialects."""
    parts = [F.expr(f"CAST({x} AS STRING)") if i % 2 else F.lit(x) for i, x in enumerate(_VALUE.split(line)) if x or i % 2]
    return F.concat(*parts) if parts else F.lit("")


def line_sql(line: str) -> str:
    parts = [f"CAST({x} AS VARCHAR)" if i % 2 else _quoted(x) for i, x in enumerate(_VALUE.split(line)) if x or i % 2]
    return " || ".join(parts) if parts else "''"


class Corpus:
    """One text a row of ``table``: ``path, content`` and the key column."""

    def __init__(self, table: str, path: str, lines: Sequence[str]) -> None:
        self.table, self.path, self.lines = table, path, lines

    def frame(self, t: Tables) -> DataFrame:
        rows = getattr(t, self.table).withColumn("path", line_column(self.path))
        return spread(rows, "path", "path", F.concat_ws("\n", *[line_column(x) for x in self.lines]).alias("content"))

    @property
    def key_sql(self) -> str:
        """The path in SQL, for results that are known by construction."""
        return f"({line_sql(self.path)})"

    @property
    def sql(self) -> str:
        content = ", ".join(line_sql(x) for x in self.lines)
        return f"(SELECT {line_sql(self.path)} AS path, concat_ws(chr(10), {content}) AS content FROM {self.table})"


PHP = Corpus(
    "part",
    "/w/public/«p_brand»/p«p_partkey».php",
    [
        "<?php", "namespace App;", "/**", " * @param int $id", " * @param array|null $opts", " * @return array", " */",
        "function load_«p_partkey»($id, array $opts = []) {",
        "  if ($id > 0«repeat(' && $id', p_size % 4)») {",
        "    return ['id' => $id, 'brand' => '«p_brand»'];",
        "  }",
        "  return null;",
        "}",
        "class Part«p_partkey» extends Base«p_size % 5» implements Countable, Sized {",
        "  public static function find(?int $id, &$row) {",
        "    foreach ($row as $k) { mysqli_query($db, \"SELECT id, size FROM part_«p_size % 3» WHERE id = 1\"); }",
        "    return true;",
        "  }",
        "}",
        "$p = new Part«(p_partkey + 1) % 100»(1);",
        "$p->save(2);",
        "Part«p_partkey % 50»::find(3);",
        "load_«p_partkey % 60»(4);",
        "include 'lib/file«p_size».php';",
        "$v = $_GET['page'] ?? 1; $w = (int)$_POST['id_«p_size % 3»'];",
        "if (isset($_REQUEST['q'])) { $z = $_SESSION['user']; }",
        "$_SESSION['cart'] = 1; setcookie('c«p_size % 2»', 'x');",
        "$data = json_decode(file_get_contents('php://input'), true); $n = $data['name'];",
        "switch ($_POST['act«p_size % 2»']) { case 'add': f(); case 'del': g(); }",
        "if ($_GET['mode'] == 'm«p_size % 4»') { }",
        "$router->post('/items/«p_size»', 'x');",
        "move_uploaded_file($_FILES['doc«p_size % 2»']['tmp_name'], 'up/');",
        "if ($_FILES['doc«p_size % 2»']['size'] > 5) { die('big'); }",
        "header('Content-Type: application/json');",
    ],
)
#: Lines of the long function in SHAPES.
LONG = "CASE WHEN p_partkey % 40 = 0 THEN 620 ELSE p_size % 9 END"
#: Code whose shape follows the key: nesting, length, braces in strings, comments, heredocs and page text, loops of every form.
SHAPES = Corpus(
    "part",
    "/v/p«p_partkey».php",
    [
        "<p>{ «p_brand» }</p><?php # function none() {",
        "function head_«p_partkey»($a, $b = [1, 2]) { $s = \"}«repeat('}', p_size % 3)»\"; /* } */ return ['id' => 1, 'sub' => ['n' => «p_size», 'l«p_size % 2»' => array('deep' => 'x')]]; }",
        "function long_«p_partkey»() {«repeat(chr(10) || ' $x = \"{\";', " + LONG + ")»",
        "}",
        "$h = <<<TXT",
        "function no() { «repeat('{', p_size % 4)»",
        "TXT;",
        "class K«p_partkey» { public static function make(?int $id): array { $r = ['a' => 1]; «CASE WHEN p_size % 2 = 0 THEN '' ELSE '$r = [];' END» $r['b']['c'] = count($id); $this->make(2); return $r; } }",
        "function «CASE WHEN p_size % 3 = 0 THEN 'outer' ELSE 'plain' END»() { return «repeat('[', p_size % 4)»['k' => (float)$v]«repeat(']', p_size % 4)»; }",
        "function walk() { K«p_partkey % 50»::make(1); foreach ($rows as $row) { while (more()) { load_«p_size % 3»(); } «repeat('save(); ', p_size % 4)»} «repeat('log_it(); ', p_size % 5)»head_«p_partkey»(); }",
        "for ($i = 0; $i < 3; $i++): walk(); endfor; ?><b>'</b>",
    ],
)
DDL = Corpus(
    "supplier",
    "/db/t«s_suppkey».sql",
    [
        "CREATE TABLE t«s_suppkey» (id INT(11) NOT NULL AUTO_INCREMENT, -- the key, of course;",
        "  name VARCHAR(«10 + s_nationkey») DEFAULT 'n«s_nationkey»',",
        "  nation_id BIGINT(20) NOT NULL, kind ENUM('a','b') DEFAULT 'a',",
        "  PRIMARY KEY (id), UNIQUE KEY uq_«s_nationkey» (name, kind), KEY (nation_id),",
        "  CONSTRAINT fk_n FOREIGN KEY (nation_id) REFERENCES nation (id) ON DELETE CASCADE) ENGINE=InnoDB DEFAULT CHARSET=utf8;",
        "/* later; */ ALTER TABLE t«s_suppkey» ADD FOREIGN KEY (kind) REFERENCES kinds (code) ON UPDATE SET NULL;",
        "ALTER TABLE unknown ADD FOREIGN KEY (a) REFERENCES b (c);",
    ],
)
REWRITES = Corpus(
    "customer",
    "/w/«c_custkey»/.htaccess",
    [
        "RewriteEngine On", "RewriteCond %{REQUEST_METHOD} POST", "RewriteRule ^item«c_nationkey»/([0-9]+)/(\\w+)$ item.php?id=$1&k=$2 [L,QSA]",
        "RewriteCond a b", "RewriteRule ^skip - [L]", "RewriteRule ^api/v«c_nationkey % 3»/list$ api.php [R=301,L]",
    ],
)
NGINX = Corpus(
    "customer",
    "/etc/nginx/c«c_custkey».conf",
    [
        "location /api«c_nationkey» { try_files $uri /index.php?$args; }",
        "location ~ ^/x«c_nationkey»/([0-9]+)$ { fastcgi_param SCRIPT_FILENAME $root/x.php; }",
        "rewrite ^/a«c_nationkey»/(.*)$ /b.php last;",
        "rewrite ^/c https://other.org/ permanent;",
    ],
)
ENTITIES = Corpus(
    "part", "/src/part-«p_partkey».entity.ts",
    ["export class Part {", "  @PrimaryGeneratedColumn()", "  id!: number;", "  @Column({ length: «p_size» })", "  name«p_size % 3»?: string;", "  plain: string;", "  @CreateDateColumn() created: Date;", "}"],
)
DTOS = Corpus("part", "/src/create-part-«p_partkey».dto.ts", ["export class CreatePart { Id!: number;", "  NameOf«p_size % 3»?: string }"])

#: Lines of PHP that the default rules find; every rule finds one at least.
SAMPLES = [
    "$r = mysqli_query($db, $_GET['q']);", "$q = \"SELECT a FROM t WHERE b = \" . $_POST['b'];", "$q = \"SELECT a FROM t WHERE b = {$_GET['b']}\";", "$db->query('SELECT 1 ' . $x);",
    "pg_query($c, $sql);", "$q = \"SELECT a FROM t WHERE name = '\" . $name;", "echo 'a' . $_GET['x'];", "print($_GET['x']);", "<?= $_GET['x'] ?>", "echo $title;", "include($_GET['page']);", "readfile($_GET['f']);",
    "require $file;", "copy($_GET['a'], 'b');", "$h = fopen($name, 'r');", "system('ls ' . $_GET['d']);", "$o = `ls $d`;", "exec('a ' . $b);", "system('b ' . $c);", "passthru('c ' . $d);", "popen('d ' . $e, 'r');",
    "eval($code);", "$o = unserialize($s);", "extract($row);", "$f = create_function('$a', 'return 1;');", "preg_replace('/a/e', 'b', $c);", "assert('$x > 1');", "parse_str($q);", "md5($p);", "sha1($p);", "mt_rand(1, 5);", "mcrypt_encrypt($a);",
    "define('MAX', 5);", "$config['debug'] = true;", "$db_host = 'localhost';", "$smtp_host = 'mail';", "$api_key = 'abc';", "$base_url = '/';", "getenv('HOME');",
    "$c = curl_init('https://a.org/x');", "curl_setopt($c, CURLOPT_URL, 'https://b.org');", "file_get_contents('https://c.org/y');", "fopen('http://d.org', 'r');", "$s = new SoapClient($w);", "$g = new GuzzleHttp\\Client();", "stream_context_create($o);", "fsockopen('e.org', 80);",
    "$db->beginTransaction();", "$db->exec('START TRANSACTION');", "$db->autocommit(false);", "$db->commit();", "$db->exec('COMMIT');", "$db->rollBack();", "$db->exec('SAVEPOINT a');", "$q = 'SELECT a FROM b FOR UPDATE';", "$q = 'SELECT a FROM b LOCK IN SHARE MODE';", "$db->exec('LOCK TABLES b WRITE');", "$q = \"SELECT GET_LOCK('a', 1)\";", "flock($h, LOCK_EX);", "sem_acquire($s);",
    "$ch->basic_publish('jobs');", "$redis->rpush('queue:a', $x);", "Queue::push('Job');", "$ch->basic_consume('jobs');", "$redis->blpop('queue:a', 5);", "$bus->dispatch('user.made');", "do_action('saved');", "$em->addListener('user.made', $f);", "add_action('init', 'f');",
    "pcntl_fork();", "register_shutdown_function('bye');", "fastcgi_finish_request();", "exec('php a.php > /dev/null 2>&1 &');", "curl_multi_init();", "$client->getAsync('/x');", "mail('a@b.org', 's', 'b');", "$m = new PHPMailer();", "$mailer->send();",
    "throw new NotFound('x');", "throw $e;", "throw Failure::of($x);", "die('no');", "exit(1);", "exit;", "trigger_error('bad');", "http_response_code(404);", "header('HTTP/1.1 500 Oops');", "header('Location: /', true, 301);",
    "$q = 'SELECT a FROM b LIMIT 10';", "$q = \"SELECT a FROM b LIMIT \" . $n;", "$q = 'SELECT a FROM b LIMIT 10 OFFSET 20';", "array_slice($a, 0, 5);", "$p = $_GET['page'];", "$p = $_GET['limit'];", "$p = $_GET['offset'];", "$p = $_GET['per_page'];", "$perPage = 10;", "$q = 'SELECT a FROM b ORDER BY c';", "$s = $_GET['sort'];", "usort($a, $f);",
    "$redis->get('k:1');", "$redis->set('k:2', $v, 60);", "$redis->setex('k:3', 60, $v);", "$redis->del('k:4');", "$redis->expire('k:5', 60);", "$redis->incr('k:6');", "$memcache->get('m1');", "$memcache->set('m2', $v, 0, 300);", "$mem->add('m3', $v);", "$mem->delete('m4');",
    "file_get_contents($cacheFile);", "file_put_contents($cacheFile, $x);", "file_exists($cache_path);", "filemtime($cacheFile);", "apc_fetch('a1');", "apcu_store('a2', $v, 60);", "apc_delete('a3');", "apcu_exists('a4');", "$_SESSION['cache_x'] = 1;", "$y = $_SESSION['cache_x'];",
    "$max_attempts = 5;", "$rate_limit = 100;", "if ($request_count > 60) {", "$ip = $_SERVER['REMOTE_ADDR'];", "getenv('HTTP_X_FORWARDED_FOR');", "$blocked_ips[] = $ip;", "if ($t > time() - 3600) {", "$rate_window = 60;", "$throttle = 30;", "usleep(100);",
    "session_start();", "$u = $_SESSION['user_id'];", "session_regenerate_id(true);", "JWT::encode($p, $k);", "JWT::decode($t, $k);", "$h = 'Bearer ' . $t;", "$_SERVER['HTTP_AUTHORIZATION'];", "$_SERVER['HTTP_X_API_KEY'];", "$h = 'X-Api-Key';", "$_SERVER['PHP_AUTH_USER'];", "$_SERVER['PHP_AUTH_PW'];", "$oauth = 1;", "$t = 'access_token';", "$t = 'refresh_token';",
    "if (hasRole('admin')) {", "if (is_role('staff')) {", "if ($_SESSION['role'] == 'boss') {", "if ($u->role === 'chef') {", "$u->can('edit.post');", "has_permission('read.all');", "check_permission('write.all');", "password_hash($p, 1);",
    "$max_retries = 3;", "$retry_count = 2;", "retry(5, $f);", "for ($attempt = 0; $attempt < 4; $attempt++) {", "curl_setopt($c, CURLOPT_TIMEOUT, 30);", "curl_setopt($c, CURLOPT_CONNECTTIMEOUT, 5);", "set_time_limit(60);", "stream_set_timeout($s, 7);", "['timeout' => 15];", "try { f(); } catch (E $e) { return 0; }", "$x = $y ?: $default;", "fallback_value(1);", "$x = $y ?? $default;", "$b = new CircuitBreaker();", "$failure_count = 5;", "if ($is_open) {",
    "error_log('x ' . $y);", "file_put_contents('app.log', $m);", "fwrite($log, $m);", "fopen('app.log', 'a');", "syslog(1, 'm');", "openlog('a', 1, 2);", "$logger->warning('slow', ['t' => $t]);", "log_it(json_encode($a));",
    "$q = 'INSERT INTO a VALUES (1)';", "$q = 'UPDATE a SET b = 1';", "$q = 'DELETE FROM a';", "$db->prepare($q);", "include 'a.php';", "include_once('b.php');", "require 'c.php';", "require_once 'd.php';", "include __DIR__ . '/e.php';", "include_once ROOT . 'f.php';", "require dirname(__FILE__) . '/g.php';", "require_once __DIR__ . '/h.php';",
    "$q = 'SELECT a FROM b JOIN c ON 1';", "$r->fetchAll();", "$repo->findBy('users');", "$q = 'REPLACE INTO a VALUES (1)';", "$q = 'TRUNCATE TABLE a';", "$db->insert('users', $x);", "$db->update('users', $x);", "$db->delete('users');", "global $x;", "unlink($f);", "mkdir('a');", "rename('a', 'b');", "setcookie('a', 'b');",
    "$x = 1;", "// nothing", "}",
]
N_LINES = 12


def sampled(t: Tables) -> DataFrame:
    """Files of ``N_LINES`` sample lines each, all samples in turn."""
    lines = F.array(*[F.lit(x) for x in SAMPLES])
    pick = [F.get(lines, F.expr(f"CAST((p_partkey * {N_LINES} + {j}) % {len(SAMPLES)} AS INT)")) for j in range(N_LINES)]
    return spread(t.part.withColumn("path", line_column("/s/«p_partkey».php")), "path", "path", F.concat_ws("\n", *pick).alias("content"))


_LIST = "[" + ", ".join(map(_quoted, SAMPLES)) + "]"
SAMPLED = "(SELECT '/s/' || p_partkey || '.php' AS path, concat_ws(chr(10), " + ", ".join(f"s[(p_partkey * {N_LINES} + {j}) % {len(SAMPLES)} + 1]" for j in range(N_LINES)) + f") AS content FROM part, (SELECT {_LIST} AS s))"
