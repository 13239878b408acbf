"""Default rules for PHP code, by family; users may give their own lists.

A rule names its family, type and severity; ``group`` is the captured part shown as snippet. Rules are
independent: a span found by two rules gives two findings.
"""

from __future__ import annotations

from srclens.operators.scan import Rule

_REQUEST = r"\$_(?:GET|POST|REQUEST|COOKIE)"


def _rules(family: str, rows: list[tuple], snippet_len: int = 100) -> list[Rule]:
    return [Rule(f"{family}_{i + 1}", family, type_, severity, pattern, snippet_len, group, multiline) for i, (type_, severity, pattern, group, multiline) in enumerate((*r, *(0, False)[len(r) - 3 :]) for r in rows)]


SECURITY = _rules(
    "security",
    [
        ("sql_injection", "critical", rf"(?i)(?:mysqli?_query|->query|->exec)\s*\([^;]*{_REQUEST}"),
        ("sql_injection", "critical", rf"(?i)[\"'](?:SELECT|INSERT|UPDATE|DELETE)\b[^\"';]*[\"']\s*\.\s*{_REQUEST}"),
        ("sql_injection", "critical", rf"(?i)[\"'](?:SELECT|INSERT|UPDATE|DELETE)\b[^\"';]*\{{?{_REQUEST}"),
        ("sql_injection", "critical", r"(?i)(?:mysqli?_query|->query)\s*\([^;]*[\"']\s*\.\s*\$\w+"),
        ("sql_injection", "critical", r"(?i)\b(?:pg_query|mssql_query|odbc_exec)\s*\([^;]*\$\w+"),
        ("sql_injection", "critical", r"(?i)\bWHERE\s+[\w.`]+\s*=\s*['\"]+\s*\.\s*\$\w+"),
        ("xss", "high", rf"(?i)\becho\s+[^;]*{_REQUEST}"),
        ("xss", "high", rf"(?i)\bprint\s*\(?[^;]*{_REQUEST}"),
        ("xss", "high", rf"<\?=\s*{_REQUEST}"),
        ("xss", "high", r"(?i)\becho\s+\$\w+\s*;"),
        ("path_traversal", "critical", rf"(?i)\b(?:include|require)(?:_once)?\s*\(?[^;]*{_REQUEST}"),
        ("path_traversal", "critical", rf"(?i)\b(?:fopen|file_get_contents|readfile|unlink)\s*\([^;]*{_REQUEST}"),
        ("path_traversal", "critical", r"(?i)\b(?:include|require)(?:_once)?\s*\(?\s*\$\w+"),
        ("path_traversal", "critical", rf"(?i)\b(?:file_put_contents|copy|rename|rmdir)\s*\([^;]*{_REQUEST}"),
        ("path_traversal", "critical", r"(?i)\b(?:fopen|readfile)\s*\(\s*\$\w+"),
        ("command_injection", "critical", rf"(?i)\b(?:exec|system|shell_exec|passthru|popen|proc_open)\s*\([^;]*{_REQUEST}"),
        ("command_injection", "critical", r"`[^`]*\$[^`]*`"),
        ("command_injection", "critical", r"(?i)\b(?:shell_)?exec\s*\([^;)]*\$\w+"),
        ("command_injection", "critical", r"(?i)\bsystem\s*\([^;)]*\$\w+"),
        ("command_injection", "critical", r"(?i)\bpassthru\s*\([^;)]*\$\w+"),
        ("command_injection", "critical", r"(?i)\b(?:popen|proc_open)\s*\([^;)]*\$\w+"),
        ("insecure_function", "critical", r"(?i)\beval\s*\("),
        ("insecure_function", "high", r"(?i)\bunserialize\s*\("),
        ("insecure_function", "medium", r"(?i)\bextract\s*\("),
        ("insecure_function", "high", r"(?i)\bcreate_function\s*\("),
        ("insecure_function", "critical", r"(?i)\bpreg_replace\s*\(\s*['\"]/[^/]*/[a-z]*e[a-z]*['\"]"),
        ("insecure_function", "high", r"(?i)\bassert\s*\(\s*['\"$]"),
        ("insecure_function", "medium", r"(?i)\bparse_str\s*\("),
        ("weak_crypto", "medium", r"(?i)\bmd5\s*\("),
        ("weak_crypto", "medium", r"(?i)\bsha1\s*\("),
        ("weak_crypto", "low", r"(?i)\b(?:mt_)?rand\s*\("),
        ("weak_crypto", "high", r"(?i)\bmcrypt_\w+\s*\("),
    ],
)
#: Description and recommendation of each type of security finding.
ADVICE = {
    "sql_injection": ("a query holds values that users send", "bind values as parameters"),
    "xss": ("output holds values that aren't escaped", "escape on output"),
    "path_traversal": ("a file name comes from users or a variable", "check against a list of names"),
    "command_injection": ("a command holds values of a variable", "avoid shells, escape arguments"),
    "insecure_function": ("a function runs or overwrites code and variables", "use a safe replacement"),
    "weak_crypto": ("a hash, cipher or generator is weak", "use current algorithms"),
}
CONFIG = _rules(
    "config",
    [
        ("define", "low", r"(?i)\bdefine\s*\(\s*['\"](\w+)['\"]", 1),
        ("config_array", "low", r"\$config\[['\"](\w+)['\"]\]\s*=", 1),
        ("database_variable", "low", r"\$(db_?(?:host|user|name|pass(?:word)?))\s*=", 1),
        ("mail_variable", "low", r"\$((?:smtp|mail)_\w+)\s*=", 1),
        ("key_variable", "low", r"\$(\w*(?:api_?key|secret|token))\s*=", 1),
        ("path_variable", "low", r"\$((?:base|root|site)_?(?:url|path|dir))\s*=", 1),
        ("environment", "low", r"(?i)\bgetenv\s*\(\s*['\"](\w+)['\"]", 1),
    ],
)
#: Kinds of configuration with the name in group 1 and the value in group 2.
CONFIG_VALUES = (
    ("define", r"(?i)\bdefine\s*\(\s*['\"](\w+)['\"]\s*,\s*([^)]+)\)"),
    ("config_array", r"\$config\[['\"](\w+)['\"]\]\s*=\s*([^;]+);"),
    ("database_variable", r"\$(db_?(?:host|user|name|pass(?:word)?))\s*=\s*([^;]+);"),
    ("mail_variable", r"\$((?:smtp|mail)_\w+)\s*=\s*([^;]+);"),
    ("key_variable", r"\$(\w*(?:api_?key|secret|token))\s*=\s*([^;]+);"),
    ("path_variable", r"\$((?:base|root|site)_?(?:url|path|dir))\s*=\s*([^;]+);"),
)
EXTERNAL_API = _rules(
    "external_api",
    [
        ("curl", "low", r"(?is)\bcurl_init\s*\(\s*(?:['\"]([^'\"]*)['\"])?", 1, True),
        ("curl_url", "low", r"(?i)\bCURLOPT_URL\s*,\s*['\"]?([^'\")]*)", 1),
        ("http_read", "low", r"(?i)\bfile_get_contents\s*\(\s*['\"](https?://[^'\"]+)['\"]", 1),
        ("http_open", "low", r"(?i)\bfopen\s*\(\s*['\"](https?://[^'\"]+)['\"]", 1),
        ("soap", "low", r"(?i)\bnew\s+SoapClient\s*\("),
        ("client", "low", r"(?i)\bnew\s+(?:\\?GuzzleHttp\\)?Client\s*\("),
        ("context", "low", r"(?i)\bstream_context_create\s*\("),
        ("socket", "low", r"(?i)\bp?fsockopen\s*\(\s*['\"]?([\w.:/-]*)", 1),
    ],
    200,
)
TRANSACTIONS = _rules(
    "transaction",
    [
        ("begin", "low", r"(?i)\b(?:beginTransaction|begin_transaction)\s*\("),
        ("begin", "low", r"(?i)\b(?:START\s+TRANSACTION|BEGIN\s+WORK)\b"),
        ("autocommit", "low", r"(?i)\bautocommit\b\W{0,5}(?:false|0)\b"),
        ("commit", "low", r"(?i)\bcommit\s*\("),
        ("commit", "low", r"[\"']\s*COMMIT\b"),
        ("rollback", "low", r"(?i)\broll_?back\s*\(|[\"']\s*ROLLBACK\b"),
        ("savepoint", "low", r"(?i)\bSAVEPOINT\s+\w+"),
        ("lock", "medium", r"(?i)\bFOR\s+UPDATE\b"),
        ("lock", "medium", r"(?i)\bLOCK\s+IN\s+SHARE\s+MODE\b"),
        ("lock", "medium", r"(?i)\bLOCK\s+TABLES?\b"),
        ("lock", "medium", r"(?i)\bGET_LOCK\s*\("),
        ("lock", "medium", r"(?i)\bflock\s*\("),
        ("lock", "medium", r"(?i)\bsem_acquire\s*\("),
    ],
)
EVENTS = _rules(
    "event",
    [
        ("queue_publish", "low", r"(?i)->(?:basic_publish|publish|enqueue)\s*\(\s*['\"]?([\w.:-]*)", 1),
        ("queue_publish", "low", r"(?i)->(?:[lr]push|sendMessage|put)\s*\(\s*['\"]?([\w.:-]*)", 1),
        ("queue_publish", "low", r"(?i)\bQueue::(?:push|later)\s*\(\s*['\"]?([\w.:-]*)", 1),
        ("queue_consume", "low", r"(?i)->(?:basic_consume|consume|subscribe|receiveMessage)\s*\(\s*['\"]?([\w.:-]*)", 1),
        ("queue_consume", "low", r"(?i)->(?:b?[lr]pop|reserve)\s*\(\s*['\"]?([\w.:-]*)", 1),
        ("event_dispatch", "low", r"(?i)->(?:dispatch|fire|trigger|emit)\s*\(\s*['\"]?([\w.:-]*)", 1),
        ("event_dispatch", "low", r"(?i)\b(?:Event::(?:fire|dispatch)|do_action)\s*\(\s*['\"]?([\w.:-]*)", 1),
        ("event_listen", "low", r"(?i)->(?:listen|on|addListener)\s*\(\s*['\"]?([\w.:-]*)", 1),
        ("event_listen", "low", r"(?i)\b(?:Event::listen|add_action)\s*\(\s*['\"]?([\w.:-]*)", 1),
        ("async_fork", "low", r"(?i)\bpcntl_fork\s*\("),
        ("async_shutdown", "low", r"(?i)\bregister_shutdown_function\s*\(\s*['\"]?([\w.:-]*)", 1),
        ("async_request", "low", r"(?i)\bfastcgi_finish_request\s*\("),
        ("async_background", "low", r"(?i)\bexec\s*\([^;]*>\s*/dev/null[^;]*&"),
        ("async_curl", "low", r"(?i)\bcurl_multi_(?:init|exec)\s*\("),
        ("async_promise", "low", r"(?i)->(?:getAsync|postAsync|requestAsync|sendAsync)\s*\("),
        ("email", "low", r"(?i)\bmail\s*\(\s*['\"]?([\w.@-]*)", 1),
        ("email", "low", r"(?i)\bnew\s+(?:\w*\\)*(PHPMailer|Swift_Message|Email)\b", 1),
        ("email", "low", r"(?i)->send(?:Mail)?\s*\("),
    ],
)
#: Event types that send something.
PRODUCERS = ("queue_publish", "event_dispatch", "async_fork", "async_shutdown", "async_request", "async_background", "async_curl", "async_promise", "email")
ERRORS = _rules(
    "error",
    [
        ("throw", "low", r"\bthrow\s+new\s+\\?(\w+)", 1),
        ("throw", "low", r"\bthrow\s+(\$\w+)", 1),
        ("throw", "low", r"\bthrow\s+(\w+)::\w+\s*\(", 1),
        ("die", "medium", r"\bdie\s*\("),
        ("die", "medium", r"\bexit\s*\("),
        ("die", "medium", r"\b(?:die|exit)\s*;"),
        ("trigger", "low", r"\btrigger_error\s*\("),
        ("http_code", "low", r"\bhttp_response_code\s*\(\s*(\d{3})", 1),
        ("http_code", "low", r"\bheader\s*\(\s*['\"]HTTP/[\d.]+\s+(\d{3})", 1),
        ("http_code", "low", r"\bheader\s*\([^;]*,\s*(?:true|false)\s*,\s*(\d{3})", 1),
    ],
)
PAGINATION = _rules(
    "pagination",
    [
        ("limit", "low", r"(?i)\bLIMIT\s+(?:\d+|\$\w+|\{)"),
        ("limit", "low", r"(?i)\bLIMIT\s*[\"']\s*\.\s*\$\w+"),
        ("offset", "low", r"(?i)\bOFFSET\s+(?:\d+|\$\w+|\{)"),
        ("slice", "low", r"(?i)\barray_slice\s*\("),
        ("param", "low", r"\$_(?:GET|POST|REQUEST)\[['\"](page)['\"]\]", 1),
        ("param", "low", r"\$_(?:GET|POST|REQUEST)\[['\"](limit)['\"]\]", 1),
        ("param", "low", r"\$_(?:GET|POST|REQUEST)\[['\"](offset|start)['\"]\]", 1),
        ("param", "low", r"\$_(?:GET|POST|REQUEST)\[['\"](per_page|page_size)['\"]\]", 1),
        ("param", "low", r"(?i)\$(per_?page|page_?size)\b", 1),
        ("sort", "low", r"(?i)\bORDER\s+BY\b"),
        ("sort", "low", r"\$_(?:GET|POST|REQUEST)\[['\"](?:sort|order|sort_by|order_by)['\"]\]"),
        ("sort", "low", r"(?i)\bu?[ak]?r?sort\s*\(\s*\$"),
    ],
)
CACHE = _rules(
    "cache",
    [("redis", "low", rf"(?i)\$redis->{m}\s*\(\s*['\"]?([\w:.-]*)", 1) for m in ("get", "set", "setex", "del", "expire", "incr")]
    + [("memcached", "low", rf"(?i)\$mem\w*->{m}\s*\(\s*['\"]?([\w:.-]*)", 1) for m in ("get", "set", "add", "delete")]
    + [
        ("file", "low", r"(?i)\bfile_get_contents\s*\(\s*[^;)]*cache[^;)]*"),
        ("file", "low", r"(?i)\bfile_put_contents\s*\(\s*[^;)]*cache[^;)]*"),
        ("file", "low", r"(?i)\bfile_exists\s*\(\s*[^;)]*cache[^;)]*"),
        ("file", "low", r"(?i)\bfilemtime\s*\(\s*[^;)]*cache[^;)]*"),
    ]
    + [("apc", "low", rf"(?i)\bapcu?_{m}\s*\(\s*['\"]?([\w:.-]*)", 1) for m in ("fetch", "store", "delete", "exists")]
    + [("session", "low", r"\$_SESSION\[['\"](cache\w*)['\"]\]\s*=[^=]", 1), ("session", "low", r"\$_SESSION\[['\"](cache\w*)['\"]\]", 1)],
    50,
)
RATE_LIMIT = _rules(
    "rate_limit",
    [
        ("counter", "low", r"(?i)max_?attempts\D{0,5}(\d+)", 1), ("counter", "low", r"(?i)rate_?limit\D{0,5}(\d+)", 1), ("counter", "low", r"(?i)(?:request|hit|login)_?count\s*>=?\s*(\d+)", 1),
        ("ip", "low", r"\$_SERVER\[['\"]REMOTE_ADDR['\"]\]"), ("ip", "low", r"HTTP_X_FORWARDED_FOR"), ("ip", "low", r"(?i)\b(?:is_?)?(?:blocked|banned)_?ips?\b"),
        ("window", "low", r"(?i)time\s*\(\s*\)\s*-\s*(\d+)", 1), ("window", "low", r"(?i)(?:rate|limit)_?window\D{0,5}(\d+)", 1), ("window", "low", r"(?i)\bthrottle\w*\D{0,5}(\d*)", 1),
        ("delay", "low", r"(?i)\bu?sleep\s*\("),
    ],
)
AUTH = _rules(
    "auth",
    [
        ("session", "low", r"(?i)\bsession_start\s*\("), ("session", "low", r"\$_SESSION\[['\"](?:user|uid|logged)\w*['\"]\]"), ("session", "low", r"(?i)\bsession_regenerate_id\s*\("),
        ("jwt", "low", r"(?i)\bJWT::encode\s*\("), ("jwt", "low", r"(?i)\bJWT::decode\s*\("), ("jwt", "low", r"(?i)\bBearer\b"), ("jwt", "low", r"(?i)\bHTTP_AUTHORIZATION\b"),
        ("api_key", "low", r"(?i)HTTP_X_API_KEY"), ("api_key", "low", r"(?i)\bapi_?key\b"), ("api_key", "low", r"(?i)\bX-Api-Key\b"),
        ("basic", "low", r"PHP_AUTH_USER"), ("basic", "low", r"PHP_AUTH_PW"), ("oauth", "low", r"(?i)\boauth2?\b"), ("oauth", "low", r"(?i)\baccess_token\b"), ("oauth", "low", r"(?i)\brefresh_token\b"),
        ("role", "low", r"(?i)\bhas_?role\s*\(\s*['\"](\w+)", 1), ("role", "low", r"(?i)\b(?:check|is)_?role\s*\(\s*['\"](\w+)", 1), ("role", "low", r"\$_SESSION\[['\"]role['\"]\]\s*={2,3}\s*['\"](\w+)", 1), ("role", "low", r"(?i)->role\s*={2,3}\s*['\"](\w+)", 1),
        ("permission", "low", r"(?i)\bcan\s*\(\s*['\"]([\w.]+)", 1), ("permission", "low", r"(?i)\bhas_?permission\s*\(\s*['\"]([\w.]+)", 1), ("permission", "low", r"(?i)\bcheck_?permission\s*\(\s*['\"]([\w.]+)", 1),
        ("password", "low", r"(?i)\bpassword_(?:hash|verify)\s*\("),
    ],
)
RESILIENCE = _rules(
    "resilience",
    [
        ("retry", "low", r"(?i)\bmax_?retries\D{0,5}(\d*)", 1), ("retry", "low", r"(?i)\bretry_?count\D{0,5}(\d*)", 1), ("retry", "low", r"(?i)\bretry\s*\(\s*(\d*)", 1), ("retry", "low", r"(?i)\bfor\s*\([^;]*(?:try|attempt)[^;]*;[^;]*<=?\s*(\d+)", 1),
        ("timeout", "low", r"(?i)\bCURLOPT_TIMEOUT(?:_MS)?\D{0,5}(\d+)", 1), ("timeout", "low", r"(?i)\bCURLOPT_CONNECTTIMEOUT(?:_MS)?\D{0,5}(\d+)", 1), ("timeout", "low", r"(?i)\bset_time_limit\s*\(\s*(\d+)", 1), ("timeout", "low", r"(?i)\bstream_set_timeout\D{0,20}(\d+)", 1), ("timeout", "low", r"(?i)['\"]timeout['\"]\s*=>\s*(\d+)", 1),
        ("fallback", "low", r"(?is)catch\s*\([^)]*\)\s*\{[^}]*return\b", 0, True), ("fallback", "low", r"(?i)\?:\s*\$?(?:default|fallback)\w*"), ("fallback", "low", r"(?i)\bfallback\w*\s*\("), ("fallback", "low", r"(?i)\?\?\s*\$?(?:default|fallback)\w*"),
        ("circuit", "low", r"(?i)circuit_?breaker"), ("circuit", "low", r"(?i)\bfailure_?(?:count|threshold)\D{0,5}(\d*)", 1), ("circuit", "low", r"(?i)\b(?:half_?open|is_?open)\b"),
    ],
)
LOGGING = _rules(
    "logging",
    [
        ("error_log", "low", r"\berror_log\s*\([^;]*"), ("error_log", "low", r"\btrigger_error\s*\([^;]*"), ("file", "low", r"(?i)\bfile_put_contents\s*\([^;]*log[^;]*"), ("file", "low", r"(?i)\bfwrite\s*\(\s*\$\w*log[^;]*"),
        ("file", "low", r"(?i)\bfopen\s*\([^;]*\.log[^;]*"), ("syslog", "low", r"\bsyslog\s*\([^;]*"), ("syslog", "low", r"\bopenlog\s*\([^;]*"),
        ("psr3", "low", r"(?i)\$\w*log\w*->(?:emergency|alert|critical|error|warning|notice|info|debug)\s*\([^;]*"), ("structured", "low", r"(?i)\blog\w*\s*\(\s*json_encode\s*\([^;]*"),
    ],
)
DATABASE = _rules("database", [("select", "low", r"(?i)[\"']\s*SELECT\b[^\"']*"), ("insert", "low", r"(?i)[\"']\s*INSERT\s+INTO\b[^\"']*"), ("update", "low", r"(?i)[\"']\s*UPDATE\s+\w+\s+SET\b[^\"']*"), ("delete", "low", r"(?i)[\"']\s*DELETE\s+FROM\b[^\"']*"), ("prepare", "low", r"->prepare\s*\("), ("query", "low", r"\bmysqli?_query\s*\(|->query\s*\(")])
INCLUDES = _rules(
    "include",
    [(kind, "low", rf"\b{kind}\s*\(?\s*['\"]([^'\"]+)['\"]", 1) for kind in ("include", "include_once", "require", "require_once")]
    + [(kind, "low", rf"\b{kind}\s*\(?\s*(?:__DIR__|dirname\s*\(\s*__FILE__\s*\)|[A-Z_]{{3,}})\s*\.\s*['\"]([^'\"]+)['\"]", 1) for kind in ("include", "include_once", "require", "require_once")],
    300,
)
SIDE_EFFECTS = _rules(
    "side_effect",
    [("database_read", "low", r"(?i)[\"']\s*SELECT\b[^\"';]*\bFROM\s+`?(\w+)", 1), ("database_read", "low", r"(?i)\bJOIN\s+`?(\w+)", 1), ("database_read", "low", r"(?i)->(?:fetch|fetchAll|fetch_assoc|fetch_array)\s*\("), ("database_read", "low", r"(?i)->(?:select|find|findBy)\s*\(\s*['\"](\w+)", 1),
     ("database_write", "medium", r"(?i)[\"']\s*INSERT\s+INTO\s+`?(\w+)", 1), ("database_write", "medium", r"(?i)[\"']\s*UPDATE\s+`?(\w+)", 1), ("database_write", "medium", r"(?i)[\"']\s*DELETE\s+FROM\s+`?(\w+)", 1), ("database_write", "medium", r"(?i)[\"']\s*REPLACE\s+INTO\s+`?(\w+)", 1),
     ("database_write", "medium", r"(?i)[\"']\s*TRUNCATE\s+(?:TABLE\s+)?`?(\w+)", 1), ("database_write", "medium", r"(?i)->insert\s*\(\s*['\"](\w+)", 1), ("database_write", "medium", r"(?i)->update\s*\(\s*['\"](\w+)", 1), ("database_write", "medium", r"(?i)->delete\s*\(\s*['\"](\w+)", 1),
     ("session", "low", r"\$_SESSION\[[^\]]+\]\s*=[^=]"), ("global", "low", r"\bglobal\s+\$\w+"),
     ("file_write", "medium", r"\bfwrite\s*\("), ("file_write", "medium", r"\bfile_put_contents\s*\("), ("file_write", "medium", r"\bunlink\s*\("), ("file_write", "medium", r"\bmkdir\s*\("), ("file_write", "medium", r"\brename\s*\("), ("file_write", "medium", r"\bcopy\s*\("),
     ("cookie", "low", r"\bsetcookie\s*\("), ("header", "low", r"\bheader\s*\(")],
)
ALL = (*SECURITY, *CONFIG, *EXTERNAL_API, *TRANSACTIONS, *EVENTS, *ERRORS, *PAGINATION, *CACHE, *RATE_LIMIT, *AUTH, *RESILIENCE, *LOGGING, *DATABASE, *INCLUDES, *SIDE_EFFECTS)
OUTPUT_POINTS = (("php_output", r"\b(?:echo|print|printf)\b|<\?="), ("html_tag", r"<(?:html|body|div|table|form|p|a|span|ul|input)\b"))
