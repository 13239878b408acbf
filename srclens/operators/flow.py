"""Calls and what holds them: call sites, loops around them, scopes of functions and classes, and what calls lead to.

All of it is read off the token table (:func:`code.token_table`), in which ranges of code are nested, so that the range around a call is found by a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srclens.operators import code, lexer
from srclens.operators.intervals import innermost
from srclens.sources.shared import Scratch, written

#: Words before a parenthesis that aren't calls.
NO_CALLS = (
    "if", "elseif", "for", "foreach", "while", "switch", "match", "catch", "function", "fn", "array", "list", "isset", "empty", "unset", "use",
    "and", "or", "xor", "return", "echo", "print", "include", "include_once", "require", "require_once", "declare", "exit", "die", "eval", "clone",
)
LOOPS = ("for", "foreach", "while", "do")


def call_sites(tokens: DataFrame) -> DataFrame:
    """``path, pos, line, name, kind, owner``: calls by name. Kinds: function, method (``->``), static (``::``, ``owner`` is what stands before), new."""
    return _sites(tokens).drop("on_this")


def _sites(tokens: DataFrame) -> DataFrame:
    """Call sites with ``on_this``, whether two tokens before them stands ``$this``."""
    by = Window.partitionBy("path").orderBy("pos")
    t = F.struct("token", "kind")
    rows = tokens.select("path", "pos", "line", "token", "kind", *[F.lag(t, k).over(by).alias(f"b{k}") for k in (1, 2)], F.lead(t, 1).over(by).alias("a1"))
    site = _site(F.col("token"), (F.col("kind") == "name") & (F.col("a1.token") == "(") & (F.col("a1.kind") == "mark"), F.col("b1.token"), F.col("b2.token"))
    return rows.select("path", "pos", "line", site.alias("_site")).where("_site is not null").select("path", "pos", "line", "_site.*")


def _site(token: Column, called: Column, b1: Column, b2: Column) -> Column:
    """``struct<name, kind, owner, on_this>`` of a call by name, null if a name before a parenthesis is none."""
    before, no = F.lower(b1), F.lit(False)
    kind = F.when(before.isin("->", "?->"), "method").when(before == "::", "static").when(before == "new", "new").otherwise("function")
    defined = F.coalesce(before == "function", no) | (F.coalesce(before == "&", no) & F.coalesce(F.lower(b2) == "function", no))
    known = ~F.lower(token).isin(*NO_CALLS) | F.coalesce(before.isin("->", "?->", "::"), no)
    return F.when(called & ~defined & known, F.struct(token.alias("name"), kind.alias("kind"), F.when(before == "::", b2).alias("owner"), b2.eqNullSafe("$this").alias("on_this")))


def loops(tokens: DataFrame) -> DataFrame:
    """``path, loop, line, opens, ends, end_line``: loops from their keyword to the end of their body: a brace, a lone statement, or ``endfor`` and the like."""
    low = F.lower("token")
    by = Window.partitionBy("path").orderBy("pos")
    is_name = F.col("kind") == "name"
    rows = tokens.withColumn("_next", F.lead("token").over(by)).withColumn("_before", F.lag("token").over(by))
    head = is_name & low.isin(*LOOPS) & F.col("_next").isin("(", "{") & ~F.coalesce(F.col("_before").isin("->", "?->", "::"), F.lit(False))
    finish = is_name & low.isin("endfor", "endforeach", "endwhile")
    mark = (F.col("kind") == "mark") & F.col("token").isin(*lexer.OPENING, *lexer.CLOSING, ";", ":")
    level = F.when((F.col("kind") == "mark") & F.col("token").isin(*lexer.CLOSING), F.col("depth") - 1).otherwise(F.col("depth"))
    events = rows.where(head | finish | mark).select("path", "pos", "line", low.alias("token"), level.alias("level"), head.alias("head"), finish.alias("finish"))
    on = Window.partitionBy("path", "level").orderBy("pos")
    # Backwards: a frame from a row to the end would be read again for each row.
    after = Window.partitionBy("path", "level").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.struct("token", "pos", "line")
    found = events.select(
        "*", *[F.lead(place, k).over(on).alias(f"a{k}") for k in (1, 2, 3, 4)], F.last(F.when(F.col("token") == ";", place), ignorenulls=True).over(after).alias("semicolon"),
    )
    return _ended(found)


def _ended(found: DataFrame) -> DataFrame:
    """:func:`loops` of heads and ends with the next places of their level, ``a1`` to ``a4``, and the next semicolon."""
    place = F.struct("token", "pos", "line")
    # Loops that a word ends are brackets of their own kind: those of one depth open and end in turn.
    worded = F.col("head") & (F.col("a3.token") == ":")
    word = F.when(F.col("finish"), F.substring("token", 4, 20)).otherwise(F.col("token"))
    pairs = found.where(worded | F.col("finish")).withColumn("_w", word).withColumn("_move", F.when(F.col("finish"), -1).otherwise(1))
    so_far = Window.partitionBy("path", "_w").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pairs = pairs.withColumn("_depth", F.sum("_move").over(so_far) + F.when(F.col("finish"), 1).otherwise(0))
    partner = F.lead(place).over(Window.partitionBy("path", "_w", "_depth").orderBy("pos"))
    pairs = pairs.withColumn("end", partner).where("head")
    # for ( ) { }, do { }, for ( ) statement ;
    braced = F.when((F.col("a1.token") == "{"), F.col("a2")).when(F.col("a3.token") == "{", F.col("a4")).otherwise(F.col("semicolon"))
    plain = found.where(F.col("head") & ~F.coalesce(worded, F.lit(False))).withColumn("end", braced)
    out = plain.select("path", F.col("token").alias("loop"), "line", F.col("pos").alias("opens"), "end").unionByName(pairs.select("path", F.col("token").alias("loop"), "line", F.col("pos").alias("opens"), "end"))
    return out.select("path", "loop", "line", "opens", F.col("end.pos").alias("ends"), F.col("end.line").alias("end_line"))


def loop_calls(tokens: DataFrame) -> DataFrame:
    """Call sites with ``loop`` and ``loop_line`` of the innermost loop around them, null outside of all.

    What a loop's head calls counts as inside: it runs again and again, but for the list of ``foreach``, which this doesn't tell apart.
    """
    return _looped(call_sites(tokens), loops(tokens))


def _looped(sites: DataFrame, around: DataFrame) -> DataFrame:
    found = innermost(sites, around, ["path"], "pos", "opens", "ends", "l")
    return found.select("path", "pos", "line", "name", "kind", "owner", F.col("l.loop").alias("loop"), F.col("l.line").alias("loop_line"))


def file_loop_calls(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """:func:`loop_calls` of files, in one pass over tokens that are neither written nor shuffled: calls and loops are."""
    t, low, named = F.col("t"), F.lower("t"), F.col("t").rlike(lexer.NAMED)
    ending = low.isin("endfor", "endforeach", "endwhile")
    rows = code.slim(files, (t == ":") | (named & ((F.col("a1") == "(") | low.isin(*LOOPS) | ending)), [F.col(c) for c in ("b1", "b2", "a1")], path, content)
    head = named & low.isin(*LOOPS) & F.col("a1").isin("(", "{") & ~F.coalesce(F.col("b1").isin("->", "?->", "::"), F.lit(False))
    level = F.when(t.isin(*lexer.CLOSING), F.col("depth") - 1).otherwise(F.col("depth"))
    site = _site(t, named & (F.col("a1") == "("), F.col("b1"), lexer.shown(F.col("b2")))
    rows = rows.select("path", "pos", "line", low.alias("token"), level.alias("level"), head.alias("head"), (named & ending).alias("finish"), t.isin(*lexer.OPENING, *lexer.CLOSING, ";", ":").alias("_mark"), site.alias("_site"))
    rows = rows.withColumn("_event", F.col("head") | F.col("finish") | F.col("_mark"))
    on = Window.partitionBy("path", "_event", "level").orderBy("pos")
    after = Window.partitionBy("path", "_event", "level").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.struct("token", "pos", "line")
    found = rows.select("*", *[F.lead(place, k).over(on).alias(f"a{k}") for k in (1, 2, 3, 4)]).withColumn("semicolon", F.last(F.when(F.col("token") == ";", place), ignorenulls=True).over(after))
    found = written(found.where("head or finish or _site is not null").drop("_mark", "_event"), "calls-and-loops")
    return _looped(found.where("_site is not null").select("path", "pos", "line", "_site.*").drop("on_this"), _ended(found.where("head or finish").drop("_site")))


def title(name: Column) -> Column:
    """Each run of letters with a capital first and small letters after."""
    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0)), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))), "")


def batch_opportunities(calls: DataFrame, least: int = 3, many: int = 10) -> DataFrame:
    """``name, pattern, path, n_calls, bulk_name, savings``: names called in a loop, and else those that a file calls ``least`` times or more, with the first such file.

    ``calls`` is :func:`loop_calls`. For loops, ``path`` is the first file that has such a call, and ``n_calls`` counts all calls of the name.
    """
    files = calls.groupBy("name", "path").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.count("loop").alias("n_loop"))
    by_name = files.groupBy("name").agg(
        F.sum("n").alias("n_calls"), F.sum("n_loop").alias("n_loop"), F.min(F.when(F.col("n_loop") > 0, F.col("path"))).alias("loop_path"), F.min(F.when(F.col("n") >= least, F.struct("path", "n"))).alias("run")
    )
    in_loop = F.col("n_loop") > 0
    savings = F.when(in_loop & (F.col("n_calls") >= many), "high").otherwise("medium")
    return by_name.where(in_loop | F.col("run").isNotNull()).select(
        "name", F.when(in_loop, "loop_calls").otherwise("sequential_calls").alias("pattern"), F.when(in_loop, F.col("loop_path")).otherwise(F.col("run.path")).alias("path"),
        F.when(in_loop, F.col("n_calls")).otherwise(F.col("run.n")).alias("n_calls"), F.concat(F.lit("bulk"), title(F.col("name"))).alias("bulk_name"), savings.alias("savings"),
    )


def class_ranges(tokens: DataFrame) -> DataFrame:
    """``path, class_name, opens, ends``: bodies of named classes, interfaces and traits."""
    by = Window.partitionBy("path").orderBy("pos")
    rows = tokens.withColumn("_n", F.lead(F.struct("token", "kind")).over(by)).withColumn("_b", F.lag("token").over(by))
    head = (F.col("kind") == "name") & F.lower("token").isin("class", "interface", "trait") & (F.col("_n.kind") == "name") & ~F.coalesce(F.col("_b").isin("::", "->", "?->"), F.lit(False)) & ~F.coalesce(F.lower("_b") == "new", F.lit(False))
    mark = (F.col("kind") == "mark") & F.col("token").isin("{", "}")
    level = F.when(F.col("token") == "}", F.col("depth") - 1).otherwise(F.col("depth"))
    events = rows.where(head | mark).select("path", "pos", level.alias("level"), F.when(head, F.col("_n.token")).alias("class_name"))
    on = Window.partitionBy("path", "level").orderBy("pos")
    found = events.select("*", F.lead("pos", 1).over(on).alias("opens"), F.lead("pos", 2).over(on).alias("ends"))
    return found.where("class_name is not null").select("path", "class_name", "opens", "ends")


def call_graph(tokens: DataFrame) -> DataFrame:
    """``caller, callee`` ids of functions, distinct: ``path#Class.name``, or ``path#name`` outside of classes; what a file calls outside of functions has the caller ``path#``.

    ``self::``, ``static::`` and ``$this->`` lead to the class around the call, ``C::`` to the classes of the name; other methods to every class that has one of their name.
    A plain call leads to its own file's function if there is one, else to all functions of the name. Names that nothing defines have no edge.
    """
    return _graph(code.function_ranges(tokens), class_ranges(tokens), _sites(tokens))


def file_call_graph(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """:func:`call_graph` of files, in one pass over tokens that are neither written nor shuffled: calls and the ranges of functions and classes are."""
    t, low, named, no = F.col("t"), F.lower("t"), F.col("t").rlike(lexer.NAMED), F.lit(False)
    kinds = low.isin("class", "interface", "trait")
    rows = code.slim(files, named & ((F.col("a1") == "(") | kinds), [F.col(c) for c in ("b1", "b2", "a1")], path, content)
    head = named & kinds & F.col("a1").rlike(lexer.NAMED) & ~F.coalesce(F.col("b1").isin("::", "->", "?->"), no) & ~F.coalesce(F.lower("b1") == "new", no)
    site = _site(t, named & (F.col("a1") == "("), F.col("b1"), lexer.shown(F.col("b2")))
    rows = rows.select("path", "pos", "line", t.alias("token"), "depth", "_f", t.isin(*lexer.OPENING, *lexer.CLOSING, ";").alias("_mark"), F.when(head, F.col("a1")).alias("class_name"), site.alias("_site"))
    rows = code.ranges_of(rows)
    level = F.when(F.col("token") == "}", F.col("depth") - 1).otherwise(F.col("depth"))
    rows = rows.withColumn("_level", level).withColumn("_event", F.col("class_name").isNotNull() | F.col("token").isin("{", "}"))
    on = Window.partitionBy("path", "_event", "_level").orderBy("pos")
    rows = rows.select("*", F.lead("pos", 1).over(on).alias("opens"), F.lead("pos", 2).over(on).alias("ends")).where("_site is not null or _range is not null or class_name is not null")
    found = written(rows.select("path", "pos", "line", "_site", "_range", "class_name", "opens", "ends"), "calls-and-scopes")
    sites = found.where("_site is not null").select("path", "pos", "line", "_site.*")
    return _graph(found.where("_range is not null").select("path", "_range.*"), found.where("class_name is not null").select("path", "class_name", "opens", "ends"), sites)


def _graph(ranges: DataFrame, classes: DataFrame, sites: DataFrame) -> DataFrame:
    bodies = ranges.where("ends is not null and name is not null")
    bodies = innermost(bodies, classes, ["path"], "starts", "opens", "ends", "c")
    inner = F.coalesce(F.concat("c.class_name", F.lit(".")), F.lit(""))
    bodies = written(bodies.select("path", "body_opens", "ends", F.lower("name").alias("name"), F.col("c.class_name").alias("class_name"), F.concat("path", F.lit("#"), inner, "name").alias("id")), "bodies")
    sites = sites.where("kind <> 'new'")
    sites = innermost(sites, bodies.select("path", "body_opens", "ends", "id", "class_name"), ["path"], "pos", "body_opens", "ends", "f")
    own = F.col("on_this") | F.lower("owner").isin("self", "static", "parent")
    scope = F.when(F.col("kind") == "function", "").when(F.coalesce(own, F.lit(False)), F.col("f.class_name")).when(F.col("kind") == "static", F.col("owner"))
    sites = sites.select("path", F.coalesce("f.id", F.concat("path", F.lit("#"))).alias("caller"), F.lower("name").alias("name"), scope.alias("scope"))
    sites = written(sites.distinct(), "call-sites")
    defined = bodies.select("name", F.coalesce("class_name", F.lit("")).alias("scope"), F.col("path").alias("at"), F.col("id").alias("callee"))
    # Names of the own file first, so that one that every file defines and calls makes no pairs of files.
    scoped, keys = sites.where("scope is not null"), ["path", "name", "scope"]
    own_names = defined.withColumnRenamed("at", "path")
    near = scoped.join(own_names.hint("merge"), keys).select("caller", "callee")
    far = scoped.join(own_names.select(*keys).distinct().hint("merge"), keys, "left_anti").join(defined.hint("merge"), ["name", "scope"])
    loose = sites.where("scope is null").join(defined.where("scope <> ''").drop("scope"), "name")
    return near.unionByName(far.select("caller", "callee")).unionByName(loose.select("caller", "callee")).distinct()


def reaching(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``id``: everything from which a target can be reached along ``caller, callee``, targets included.

    Where only one way leads on, pointers are doubled until they end at a fork or a target, so a chain of n takes log n rounds and cycles of such nodes
    fall out as what never ends. What is left is searched backwards, a round a step between forks.
    """
    with Scratch(edges.sparkSession) as scratch:
        edges = scratch.written(edges.where("caller <> callee").select("caller", "callee").distinct(), "edges")
        marked = scratch.written(targets.select("id").distinct(), "targets")
        single = edges.groupBy("caller").agg(F.count("*").alias("n"), F.min("callee").alias("to")).where("n = 1").select(F.col("caller").alias("id"), "to").join(marked, "id", "left_anti")
        single = scratch.written(single, "single")
        n = single.count()
        for _ in range(n.bit_length()):
            onward = single.select(F.col("id").alias("to"), F.col("to").alias("_next"))
            single = scratch.written(single.join(onward, "to", "left").select("id", F.coalesce("_next", "to").alias("to")), "single")
        single = scratch.written(single.join(single.select(F.col("id").alias("to")), "to", "left_anti").select("id", "to"), "single")  # without cycles
        forks = edges.groupBy("caller").count().where("count > 1").select("caller")
        short = edges.join(forks, "caller", "left_semi").join(single.select(F.col("id").alias("callee"), "to"), "callee", "left")
        short = scratch.written(short.select("caller", F.coalesce("to", "callee").alias("callee")).distinct(), "short")
        front = marked
        while not front.isEmpty():
            found = short.join(front.select(F.col("id").alias("callee")), "callee", "left_semi").select(F.col("caller").alias("id")).distinct()
            front = scratch.written(found.join(marked, "id", "left_anti"), "front")
            marked = scratch.written(marked.unionByName(front), "marked")
        led = single.join(marked.select(F.col("id").alias("to")), "to", "left_semi").select("id")
        return written(marked.unionByName(led).distinct(), "reaching")
