"""Queries over texts: inventory, rule scans, scores, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srclens.functions.conditions import first_keyword, ladder
from srclens.operators import correlate, coverage, lines, rollup, scan, segment
from srclens.plans.registry import Tables, query
from srclens.sources.files import compact

RULES = (
    scan.Rule("address", "contact", "email", "critical", r"@\w+\.\w+"),
    scan.Rule("card", "payment", "card_number", "critical", r"[0-9]{16}"),
    scan.Rule("secret", "credential", "token", "critical", r'token = "[0-9a-f]+"', 40),
    scan.Rule("ip", "network", "address", "high", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    scan.Rule("phone", "contact", "phone", "high", r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    scan.Rule("junk", "markup", "symbols", "medium", r"[#$%&]{3}"),
    scan.Rule("place", "prose", "phrase", "low", r"on\s+\w+", 20),
    scan.Rule("license", "legal", "license", "low", r"[Ll]icen[sc]e"),
)
BREAK = scan.Rule("break", "prose", "line_break", "low", r"\.\n[A-Z]\w+", 30, multiline=True)
_VALUES = ", ".join("('{}','{}','{}','{}','{}',{})".format(r.rule_id, r.family, r.type, r.severity, r.pattern.replace("'", "''"), r.snippet_len) for r in RULES)
RULE_TABLE = f"(VALUES {_VALUES}) r(rule_id, family, type, severity, pattern, snippet_len)"
LINES = "(SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents)"


@query("""
SELECT source, lang, count(*) AS n_files, CAST(sum(len(string_split(coalesce(text, ''), chr(10)))) AS BIGINT) AS n_lines,
  CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars, CAST(max(length(coalesce(text, ''))) AS BIGINT) AS longest
FROM documents GROUP BY source, lang""")
def corpus_inventory(t: Tables) -> DataFrame:
    return lines.inventory(t.documents, ["source", "lang"])


@query("""
SELECT doc_id, CAST(len(l) - 1 AS BIGINT) AS n_newlines, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(l) - CASE WHEN l[len(l)] = '' THEN 1 ELSE 0 END AS BIGINT) AS n_read_lines,
  CAST(len(list_filter(l, lambda x: trim(x) = '')) AS BIGINT) AS n_blank
FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)""")
def line_stats(t: Tables) -> DataFrame:
    return lines.line_counts(t.documents)


@query("""
WITH tags AS (SELECT page_id, unnest(string_split(html, '<')) AS tag, generate_subscripts(string_split(html, '<'), 1) AS pos FROM pages),
marked AS (SELECT *, CASE WHEN starts_with(tag, '/script') THEN false WHEN starts_with(tag, 'script') THEN true END AS event FROM tags),
run AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING), false) AS inside FROM marked)
SELECT page_id, count(*) AS n_tags, count(*) FILTER (WHERE inside) AS n_inside, CAST(sum(length(tag)) FILTER (WHERE inside) AS BIGINT) AS chars_inside FROM run GROUP BY page_id""")
def markup_line_classify(t: Tables) -> DataFrame:
    tags = t.pages.select("page_id", F.posexplode(F.split("html", "<")).alias("pos", "tag"))
    run = lines.running_state(tags, "page_id", "pos", F.startswith("tag", F.lit("script")), F.startswith("tag", F.lit("/script")))
    return run.groupBy("page_id").agg(
        F.count("*").alias("n_tags"), F.count_if("inside").alias("n_inside"), F.sum(F.when(F.col("inside"), F.length("tag").cast("long"))).alias("chars_inside")
    )


@query(f"""
SELECT doc_id, rule_id, CAST(len(regexp_extract_all(text, pattern)) AS BIGINT) AS n_matches
FROM documents, {RULE_TABLE} WHERE regexp_matches(text, pattern)""")
def rule_scan_counts(t: Tables) -> DataFrame:
    return scan.rule_counts(t.documents, RULES)


@query(f"""
WITH hits AS (SELECT doc_id, rule_id, family, type, severity, line, snippet_len, regexp_extract_all(content, pattern) AS m
  FROM {LINES}, {RULE_TABLE} WHERE regexp_matches(content, pattern)),
each AS (SELECT doc_id, rule_id, family, type, severity, CAST(line AS BIGINT) AS line, CAST(unnest(generate_series(1, len(m))) AS BIGINT) AS in_line, snippet_len, unnest(m) AS x FROM hits)
SELECT doc_id, rule_id, family, type, severity, line, in_line, substring(x, 1, snippet_len) AS snippet,
  row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY line, in_line) AS ordinal FROM each""")
def rule_scan_matches(t: Tables) -> DataFrame:
    return scan.numbered(scan.scan_lines(t.documents, RULES))


@query(r"""
WITH p AS (SELECT doc_id, regexp_extract_all(text, '\.\n[A-Z]\w+') AS m, string_split_regex(text, '\.\n[A-Z]\w+') AS s FROM documents WHERE regexp_matches(text, '\.\n[A-Z]\w+')),
e AS (SELECT doc_id, m, s, unnest(generate_series(1, len(m))) AS i FROM p)
SELECT doc_id, 'break' AS rule_id, CAST(i AS BIGINT) AS ordinal, substring(m[i], 1, 30) AS snippet,
  CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS "offset",
  CAST(1 + list_sum(list_transform(s[1:i], lambda x: length(x) - length(replace(x, chr(10), '')))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x) - length(replace(x, chr(10), '')))), 0) AS BIGINT) AS line
FROM e""")
def rule_scan_multiline(t: Tables) -> DataFrame:
    return scan.scan_texts(t.documents, [BREAK]).select("doc_id", "rule_id", "ordinal", "snippet", "offset", "line")


@query(f"""
WITH k AS (SELECT doc_id, line, CASE WHEN regexp_matches(content, '[#$%&]{{3}}') THEN 'symbols' WHEN regexp_matches(content, '[0-9]{{4}}') THEN 'number' END AS kind FROM {LINES}),
n AS (SELECT doc_id, CAST(line AS BIGINT) AS line, kind, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS n FROM k WHERE kind IS NOT NULL)
SELECT * FROM n WHERE n <= 30""")
def output_points_first30(t: Tables) -> DataFrame:
    return scan.first_output_points(t.documents, [("symbols", "[#$%&]{3}"), ("number", "[0-9]{4}")])


@query(f"""
SELECT family, rule_id, count(DISTINCT doc_id) AS files_with, CAST(sum(len(regexp_extract_all(content, pattern))) AS BIGINT) AS total, max(severity) AS severity
FROM {LINES}, {RULE_TABLE} WHERE regexp_matches(content, pattern) GROUP BY family, rule_id""")
def pattern_rollup(t: Tables) -> DataFrame:
    return scan.pattern_rollup(scan.scan_lines(t.documents, RULES))


@query(f"""
SELECT doc_id, family, CAST(line AS BIGINT) AS line, string_agg(DISTINCT type, ',' ORDER BY type) AS types, CAST(sum(len(regexp_extract_all(content, pattern))) AS BIGINT) AS n_merged
FROM {LINES}, {RULE_TABLE} WHERE regexp_matches(content, pattern) AND family <> 'prose' GROUP BY doc_id, family, line""")
def findings_merged_by_line(t: Tables) -> DataFrame:
    return scan.merge_by_line(scan.scan_lines(t.documents, [r for r in RULES if r.family != "prose"]))


@query(f"""
WITH hits AS (SELECT doc_id, rule_id, CAST(sum(len(regexp_extract_all(content, pattern))) AS BIGINT) AS n FROM {LINES}, {RULE_TABLE} WHERE regexp_matches(content, pattern) AND family <> 'prose' GROUP BY doc_id, rule_id)
SELECT *, bool_or(rule_id = 'secret') OVER (PARTITION BY doc_id) AS has_secret FROM hits""")
def findings_with_file_flag(t: Tables) -> DataFrame:
    found = scan.scan_lines(t.documents, [r for r in RULES if r.family != "prose"]).groupBy("doc_id", "rule_id").agg(F.count("*").alias("n"))
    return scan.with_flag_from(found, F.col("rule_id") == "secret", "has_secret")


_CONNECTIVES = (r" and ", r" or ", r" if ", r" the ", r" that ")


@query("""
SELECT doc_id, CAST(1 + len(regexp_extract_all(text, ' and ')) + len(regexp_extract_all(text, ' or ')) + len(regexp_extract_all(text, ' if '))
  + len(regexp_extract_all(text, ' the ')) + len(regexp_extract_all(text, ' that ')) AS BIGINT) AS complexity FROM documents""")
def complexity_score(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", lines.complexity("text", _CONNECTIVES).alias("complexity"))


@query("""
WITH s AS (SELECT doc_id, greatest(0.0::DOUBLE, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 2.0 ELSE 0.0 END + CASE WHEN contains(text, chr(10)) THEN 1.5 ELSE 0.0 END
  + CASE WHEN length(text) > 2000 THEN 1.0 ELSE 0.0 END + CASE WHEN contains(text, '@') THEN 0.5 ELSE 0.0 END + CASE WHEN regexp_matches(text, '[#$%&]{3}') THEN -2.0 ELSE 0.0 END)::DOUBLE AS score,
  CAST(len(regexp_extract_all(text, 'on\\s+\\w+')) AS BIGINT) AS n_functions FROM documents)
SELECT doc_id, score, n_functions, CASE WHEN score >= 3 THEN 'entry' WHEN score < 1 AND n_functions >= 1 THEN 'include' ELSE 'other' END AS class FROM s""".replace("\\\\", "\\"))
def entry_score_split(t: Tables) -> DataFrame:
    text = F.col("text")
    score = lines.additive_score(
        [(text.rlike("[0-9]{4}"), 2), (F.contains(text, F.lit("\n")), 1.5), (F.length(text) > 2000, 1), (F.contains(text, F.lit("@")), 0.5), (text.rlike("[#$%&]{3}"), -2)]
    )
    out = t.documents.select("doc_id", score.alias("score"), F.regexp_count("text", F.lit(r"on\s+\w+")).cast("long").alias("n_functions"))
    return out.withColumn("class", lines.entry_class(F.col("score"), F.col("n_functions")))


@query("""
SELECT d.lang, count(*) AS total, count(l.doc_id) AS covered, round(100.0 * count(l.doc_id) / greatest(count(*), 1), 4)::DOUBLE AS coverage
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY d.lang""")
def coverage_ratio(t: Tables) -> DataFrame:
    labelled = t.labels.select("doc_id", F.lit(True).alias("labelled")).distinct()
    return rollup.coverage_ratio(t.documents.select("doc_id", "lang").join(labelled, "doc_id", "left"), F.col("labelled").isNotNull(), ["lang"])


@query("""
WITH g AS (SELECT count(*) AS n_files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars,
  count(*) FILTER (WHERE regexp_matches(text, '[0-9]{16}')) AS n_cards, count(*) FILTER (WHERE contains(text, '@')) AS n_mail, count(*) FILTER (WHERE length(text) > 10000) AS n_long FROM documents),
f AS (SELECT *, (CASE WHEN n_files > 100 THEN 1 ELSE 0 END + CASE WHEN n_lines > 5000 THEN 1 ELSE 0 END + CASE WHEN n_cards > 0 THEN 1 ELSE 0 END + CASE WHEN n_mail > 1000000 THEN 1 ELSE 0 END)::BIGINT AS n_factors FROM g)
SELECT *, CASE WHEN n_factors >= 3 THEN 'high' WHEN n_factors >= 1 THEN 'medium' ELSE 'low' END AS level, greatest(1, n_lines // 2000)::BIGINT AS weeks, round_even(n_chars / n_files, 2)::DOUBLE AS mean_chars FROM f""")
def project_complexity(t: Tables) -> DataFrame:
    out = t.documents.agg(
        F.count("*").alias("n_files"), F.sum(F.size(F.split("text", "\n", -1)).cast("long")).alias("n_lines"), F.sum(F.length("text").cast("long")).alias("n_chars"),
        F.count_if(F.col("text").rlike("[0-9]{16}")).alias("n_cards"), F.count_if(F.contains("text", F.lit("@"))).alias("n_mail"), F.count_if(F.length("text") > 10000).alias("n_long"),
    )
    factors = [("many_files", F.col("n_files") > 100), ("many_lines", F.col("n_lines") > 5000), ("cards", F.col("n_cards") > 0), ("mail", F.col("n_mail") > 1000000)]
    out = out.withColumn("n_factors", F.size(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in factors]))).cast("long"))
    return out.withColumn("level", ladder([(F.col("n_factors") >= 3, "high"), (F.col("n_factors") >= 1, "medium")], "low")).withColumn(
        "weeks", F.greatest(F.lit(1), F.floor(F.col("n_lines") / 2000)).cast("long")
    ).withColumn("mean_chars", F.bround(F.col("n_chars") / F.col("n_files"), 2))


@query("""
SELECT DISTINCT d.doc_id, b.item_id FROM documents d, benchmark b WHERE length(b.text) > 0 AND contains(d.text, b.text)""")
def call_points_text(t: Tables) -> DataFrame:
    return correlate.contained_passages(t.documents, t.benchmark, "doc_id", "text", "item_id", "text")


@query("""
SELECT d.doc_id, CAST(len(list_intersect(e, a)) AS BIGINT) AS n_matched, CAST(len(e) - len(list_intersect(e, a)) AS BIGINT) AS n_missing, CAST(len(a) - len(list_intersect(e, a)) AS BIGINT) AS n_extra,
  round(100.0 * len(list_intersect(e, a)) / greatest(len(e), 1), 4)::DOUBLE AS coverage
FROM (SELECT doc_id, list_distinct(string_split(substring(text, 1, position(chr(10) IN text || chr(10)) - 1), ' ')) AS e, list_distinct(string_split(replace(text, chr(10), ' '), ' ')) AS a FROM documents) d""")
def first_line_coverage(t: Tables) -> DataFrame:
    first = F.split(F.substring_index("text", "\n", 1), " ")
    every = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    return t.documents.select("doc_id", *coverage.array_coverage(first, every))


@query("""
WITH e AS (SELECT d.lang, lower(unnest(string_split(b.text, ' '))) AS f FROM benchmark b, (SELECT DISTINCT lang FROM documents) d), a AS (SELECT lang, lower(unnest(string_split(replace(text, chr(10), ' '), ' '))) AS f FROM documents),
e1 AS (SELECT DISTINCT * FROM e), a1 AS (SELECT DISTINCT * FROM a), j AS (SELECT coalesce(e1.lang, a1.lang) AS lang, e1.f AS ef, a1.f AS af FROM e1 FULL JOIN a1 ON e1.lang = a1.lang AND e1.f = a1.f)
SELECT lang, count(*) FILTER (WHERE ef IS NOT NULL AND af IS NOT NULL) AS n_matched, count(*) FILTER (WHERE ef IS NOT NULL AND af IS NULL) AS n_missing, count(*) FILTER (WHERE ef IS NULL AND af IS NOT NULL) AS n_extra,
  round(100.0 * count(*) FILTER (WHERE ef IS NOT NULL AND af IS NOT NULL) / greatest(count(*) FILTER (WHERE ef IS NOT NULL), 1), 4)::DOUBLE AS coverage FROM j GROUP BY lang""")
def field_coverage(t: Tables) -> DataFrame:
    # The expected words meet the few languages, not the documents.
    langs = t.documents.select("lang").distinct().agg(F.collect_set("lang").alias("langs"))
    words = t.benchmark.select(F.explode(F.split("text", " ")).alias("f")).withColumn("langs", langs.scalar())
    expected = words.select(F.explode("langs").alias("lang"), "f")
    # A document's words are made distinct before they are exploded.
    actual = t.documents.select("lang", F.explode_outer(F.array_distinct(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "))).alias("f")).where("f is not null")
    return coverage.field_coverage(expected, actual, ["lang"], "f")


@query("""
WITH k AS (SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' ELSE 'matched' END AS side FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id))
SELECT side, count(*) AS n FROM k GROUP BY side""".replace("l.doc_id IS NULL", "l.x IS NULL").replace("d.doc_id IS NULL", "d.x IS NULL").replace("SELECT DISTINCT doc_id FROM documents", "SELECT DISTINCT doc_id, 1 AS x FROM documents").replace("SELECT DISTINCT doc_id FROM labels", "SELECT DISTINCT doc_id, 1 AS x FROM labels"))
def schema_sync(t: Tables) -> DataFrame:
    return coverage.sync(t.documents, t.labels, "doc_id")


_KINDS = "(SELECT doc_id, CAST(line AS BIGINT) AS line, unnest(list_filter([CASE WHEN trim(content) = '' THEN 'BLANK' END, CASE WHEN length(content) < 20 THEN 'SHORT' END, CASE WHEN ends_with(content, '.') THEN 'SENTENCE' END, CASE WHEN regexp_matches(content, '[0-9]{4}') THEN 'NUMBER' END], lambda x: x IS NOT NULL)) AS kind FROM " + LINES + ")"


def _marks(t: Tables) -> DataFrame:
    c = F.col("content")
    kinds = [("BLANK", F.trim(c) == ""), ("SHORT", F.length(c) < 20), ("SENTENCE", F.endswith(c, F.lit("."))), ("NUMBER", c.rlike("[0-9]{4}"))]
    return segment.boundaries(scan.text_lines(t.documents), kinds)


@query(f"SELECT * FROM {_KINDS}")
def boundaries(t: Tables) -> DataFrame:
    return _marks(t)


_CHUNKS = f"""
WITH RECURSIVE k AS (SELECT * FROM {_KINDS}), m AS (SELECT doc_id, line, bool_or(kind IN ('SHORT', 'NUMBER')) AS strong FROM k GROUP BY doc_id, line),
c AS (SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, line AS st FROM m WHERE line > 1 UNION SELECT doc_id, 1 FROM c),
p AS (SELECT b.doc_id, b.st, min(m.line) AS nx FROM b LEFT JOIN m ON m.doc_id = b.doc_id AND ((m.line - b.st > 3 AND m.strong) OR m.line - b.st > 8) GROUP BY b.doc_id, b.st),
r AS (SELECT doc_id, CAST(1 AS BIGINT) AS job, st, nx FROM p WHERE st = 1 UNION ALL SELECT p.doc_id, r.job + 1, p.st, p.nx FROM r JOIN p ON p.doc_id = r.doc_id AND p.st = r.nx)
SELECT doc_id, job, CAST(st AS BIGINT) AS start_line, CAST(coalesce(nx - 1, n) AS BIGINT) AS end_line FROM r JOIN c USING (doc_id)"""


def _n_lines(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n"))


@query(_CHUNKS)
def boundary_chunks(t: Tables) -> DataFrame:
    return segment.boundary_chunks(_marks(t), _n_lines(t), ["SHORT", "NUMBER"], most=8, least=3)


@query(_CHUNKS)
def boundary_chunks_by_pointers(t: Tables) -> DataFrame:
    return segment.boundary_chunks_by_pointers(_marks(t), _n_lines(t), ["SHORT", "NUMBER"], most=8, least=3)


_SEGMENTS = """
WITH RECURSIVE t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents), u AS (SELECT doc_id, CASE WHEN x[-1] = '' THEN x[1:len(x) - 1] ELSE x END AS x FROM t),
l AS (SELECT doc_id, len(x) AS n, unnest(x) AS y, unnest(range(len(x))) AS i FROM u),
s AS (SELECT doc_id, n, i, CASE WHEN length(y) <= 20 THEN 50 WHEN length(y) <= 60 THEN 20 ELSE 0 END AS score FROM l),
o AS (SELECT a.doc_id, a.i AS st, arg_max(b.i, (b.score - abs(b.i - a.i - 8)) * 1000000 - b.i) AS best FROM s a JOIN s b ON b.doc_id = a.doc_id AND b.i >= a.i + 5 AND b.i <= a.i + 11 AND b.score > 0 AND b.score - abs(b.i - a.i - 8) > 0 GROUP BY a.doc_id, a.i),
p AS (SELECT s.doc_id, s.i AS st, s.n, CASE WHEN s.n - s.i <= 8 THEN s.n ELSE coalesce(o.best, s.i + 8) END AS en FROM s LEFT JOIN o ON o.doc_id = s.doc_id AND o.st = s.i),
r AS (SELECT doc_id, CAST(1 AS BIGINT) AS job, st, en, n FROM p WHERE st = 0 UNION ALL SELECT p.doc_id, r.job + 1, p.st, p.en, p.n FROM r JOIN p ON p.doc_id = r.doc_id AND p.st = r.en WHERE r.en < r.n)
SELECT doc_id, job, CAST(st + 1 AS BIGINT) AS start_line, CAST(en AS BIGINT) AS end_line FROM r"""
_SIZES = {"target": 8, "least": 2, "reach": 3, "scores": ((r"^.{0,20}$", 50), (r"^.{0,60}$", 20))}


@query(_SEGMENTS)
def fixed_segments(t: Tables) -> DataFrame:
    return segment.fixed_segments(t.documents, **_SIZES)


@query(_SEGMENTS)
def fixed_segments_by_pointers(t: Tables) -> DataFrame:
    return segment.fixed_segments_by_pointers(t.documents, **_SIZES)


@query("""
SELECT conv_id, turn, role, lag(role) OVER w AS previous, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def segment_neighbours(t: Tables) -> DataFrame:
    return segment.neighbours(t.conversations.select("conv_id", "turn", "role"), "conv_id", "turn", "role")


@query("""
SELECT doc_id, 'src ' || source || ' ' || lang || ' L: ' || CAST(len(string_split(text, chr(10))) AS VARCHAR) || ' C: ' || CAST(length(text) AS VARCHAR) AS summary FROM documents""")
def compact_strings(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.concat(F.lit("src "), compact([("", "source"), ("", "lang"), ("L", F.size(F.split("text", "\n", -1))), ("C", F.length("text"))])).alias("summary"))


@query("""
WITH n AS (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 4 AS job, length(text) AS n_chars FROM documents)
SELECT source, CAST(job AS BIGINT) AS job, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM n GROUP BY source, job""")
def round_robin_jobs(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    jobs = t.documents.select("source", (place % 4).cast("long").alias("job"), F.length("text").cast("long").alias("n_chars"))
    return jobs.groupBy("source", "job").agg(F.count("*").alias("n_files"), F.sum("n_chars").alias("n_chars"))


_DOMAINS = {"STEEL": "metal", "TIN": "metal", "BRASS": "metal", "COPPER": "metal", "PROMO": "sales", "ECONOMY": "sales"}


@query("""
SELECT p_type, count(*) AS n, CASE WHEN contains(p_type, 'STEEL') THEN 'metal' WHEN contains(p_type, 'TIN') THEN 'metal' WHEN contains(p_type, 'BRASS') THEN 'metal' WHEN contains(p_type, 'COPPER') THEN 'metal'
  WHEN contains(p_type, 'PROMO') THEN 'sales' WHEN contains(p_type, 'ECONOMY') THEN 'sales' ELSE 'core' END AS domain FROM part GROUP BY p_type""")
def domain_classify(t: Tables) -> DataFrame:
    return t.part.groupBy("p_type").agg(F.count("*").alias("n")).withColumn("domain", first_keyword(F.col("p_type"), _DOMAINS, "core"))
