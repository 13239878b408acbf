"""Segments of long texts: boundaries, boundary-driven chunks and fixed-target segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srclens.operators.graph import followed
from srclens.sources.shared import written

#: Boundary kinds of code lines: name, pattern.
CODE_BOUNDARIES = (
    ("FUNCTION", r"^\s*((public|private|protected|static|abstract|final)\s+)*function\s+\w+"),
    ("CLASS", r"^\s*((abstract|final)\s+)?(class|interface|trait)\s+\w+"),
    ("PHP_OPEN", r"<\?php"),
    ("PHP_CLOSE", r"\?>"),
    ("HTML_STRUCTURE", r"<(html|head|body|form|table|div)\b"),
    ("INCLUDE", r"^\s*(include|require)(_once)?\b"),
    ("CONTROL", r"^\s*(if|for|foreach|while|switch)\s*\("),
)
#: Scores of a line as a place to break before it: pattern, score.
BREAK_SCORES = (
    (r"^\s*((public|private|protected|static|abstract|final)\s+)*(function|class|interface|trait)\s+\w+", 100),
    (r"^\s*\}\s*$", 80),
    (r"^\s*$", 50),
    (r"^\s*(//|#|/\*|\*)", 40),
)


def boundaries(lines: DataFrame, kinds: Sequence[tuple[str, Column]], key: str = "doc_id") -> DataFrame:
    """``key, line, kind`` of every kind that a line is."""
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in kinds]), lambda x: x.isNotNull())
    return lines.select(key, "line", F.explode(found).alias("kind"))


def boundary_chunks(marks: DataFrame, n_lines: DataFrame, strong: Sequence[str], most: int = 400, least: int = 50, key: str = "doc_id") -> DataFrame:
    """``key, job, start, end``: a chunk ends before a strong boundary once it has more than ``least`` lines, before any once it has more than ``most``.

    ``n_lines`` has ``key, n``. The boundaries of one text are folded in order.
    """
    found = marks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line", "kind"))).alias("_marks"))
    state = F.struct(F.lit(1).cast("long").alias("start"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("chunks"))
    strong_kind = lambda m: m["kind"].isin(*strong)

    def step(s: Column, m: Column) -> Column:
        size = m["line"] - s["start"]
        new = (m["line"] > s["start"]) & (((size > least) & strong_kind(m)) | (size > most))
        return F.when(
            new,
            F.struct(m["line"].alias("start"), F.concat(s["chunks"], F.array(F.struct(s["start"].alias("start"), (m["line"] - 1).alias("end")))).alias("chunks")),
        ).otherwise(s)

    folded = n_lines.join(found, key, "left").select(
        key, "n", F.aggregate(F.coalesce("_marks", F.array().cast("array<struct<line:bigint,kind:string>>")), state, step).alias("_s")
    )
    tail = F.when(F.col("_s.start") <= F.col("n"), F.array(F.struct(F.col("_s.start").alias("start"), F.col("n").cast("long").alias("end")))).otherwise(
        F.array().cast("array<struct<start:bigint,end:bigint>>")
    )
    each = folded.select(key, F.posexplode_outer(F.concat("_s.chunks", tail)).alias("_i", "c")).where(F.col("_i").isNotNull())
    return each.select(
        key, (F.col("_i") + 1).cast("long").alias("job"), F.col("c.start").alias("start_line"), F.col("c.end").alias("end_line")
    )


def break_score(line: Column, scores: Sequence[tuple[str, int]] = BREAK_SCORES) -> Column:
    out = F.lit(0)
    for pattern, score in reversed(scores):
        out = F.when(line.rlike(pattern), score).otherwise(out)
    return out


def fixed_segments(
    texts: DataFrame, target: int = 400, least: int = 50, reach: int = 30, scores: Sequence[tuple[str, int]] = BREAK_SCORES, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``key, job, start_line, end_line``: segments of about ``target`` lines, broken at the best line within ``reach`` of it.

    A break before a line scores the line's score less its distance from the target;
    the highest positive score wins, the first of ties, else the target itself. A rest of fewer than ``least`` lines
    still is a segment. Lines are read as by readline: no empty last line. One text is one fold
    over its lines' scores; at most ``ceil(n / (target - reach))`` steps.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    scored = texts.select(key, F.transform(lines, lambda x: break_score(x, scores)).alias("_scores")).withColumn("_n", F.size("_scores"))

    def best(start: Column) -> Column:
        at = start + target
        lo, hi = F.greatest(start + F.lit(least), at - reach), F.least(at + reach, F.col("_n") - 1)
        candidates = F.filter(
            F.transform(
                F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>")),
                lambda i: F.struct((F.get("_scores", i) - F.abs(i - at)).alias("s"), (-i).alias("i"), F.get("_scores", i).alias("raw")),
            ),
            lambda c: (c["raw"] > 0) & (c["s"] > 0),
        )
        return F.when(F.size(candidates) > 0, -F.array_max(candidates)["i"]).otherwise(at)

    steps = F.sequence(F.lit(1), F.greatest(F.ceil(F.col("_n") / F.greatest(F.lit(1), F.lit(min(least, target)))).cast("int"), F.lit(1)))
    state = F.struct(F.lit(0).alias("start"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        end = F.when(F.col("_n") - s["start"] <= target, F.col("_n")).otherwise(best(s["start"]))
        return F.when(s["start"] >= F.col("_n"), s).otherwise(
            F.get(F.transform(F.array(end), lambda e: F.struct(e.alias("start"), F.concat(s["out"], F.array(F.struct((s["start"] + 1).alias("start"), e.alias("end")))).alias("out"))), F.lit(0))
        )

    folded = scored.select(key, F.aggregate(steps, state, step)["out"].alias("_out"))
    # An outer explode: for an inner one a filter on the fold's size would be pushed down and fold everything again.
    each = folded.select(key, F.posexplode_outer("_out").alias("_i", "c")).where(F.col("_i").isNotNull())
    return each.select(
        key, (F.col("_i") + 1).cast("long").alias("job"), F.col("c.start").cast("long").alias("start_line"), F.col("c.end").cast("long").alias("end_line")
    )


def boundary_chunks_by_pointers(marks: DataFrame, n_lines: DataFrame, strong: Sequence[str], most: int = 400, least: int = 50, key: str = "doc_id") -> DataFrame:
    """:func:`boundary_chunks` for texts too long to be folded in a row: every boundary knows the next one that would end a chunk begun at it, and these pointers are followed."""
    lines = marks.groupBy(key, "line").agg(F.bool_or(F.col("kind").isin(*strong)).alias("strong"))
    begins = lines.select(key, F.col("line").alias("at")).where("at > 1").unionByName(n_lines.select(key, F.lit(1).cast("long").alias("at")))
    # A start looks from two places on: for strong boundaries and for any.
    asks = begins.select(key, "at", F.explode(F.array(F.struct((F.col("at") + least + 1).alias("line"), F.lit(True).alias("only")), F.struct((F.col("at") + most + 1).alias("line"), F.lit(False).alias("only")))).alias("_q"))
    asks = asks.select(key, F.col("_q.line").alias("line"), F.col("_q.only").alias("only"), "at", F.lit(None).cast("boolean").alias("strong"), F.lit(0).alias("_order"))
    both = lines.select(key, "line", F.lit(None).cast("boolean").alias("only"), F.lit(None).cast("long").alias("at"), "strong", F.lit(1).alias("_order")).unionByName(asks)
    ahead = Window.partitionBy(key).orderBy("line", "_order").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    after = lambda c: F.first(F.when(c, F.col("line")), ignorenulls=True).over(ahead)
    found = both.withColumn("_to", F.when(F.col("only"), after(F.col("strong"))).otherwise(after(F.col("strong").isNotNull()))).where("at is not null")
    pointers = found.groupBy(key, "at").agg(F.min("_to").alias("to"))
    return _cut(followed(pointers, n_lines.where("n >= 1").select(key, F.lit(1).cast("long").alias("at")), [key]), n_lines, key, 1)


def _cut(way: DataFrame, n_lines: DataFrame, key: str, first: int) -> DataFrame:
    """Segments between the stops of a way, lines counting from ``first``; the last one goes on to the end."""
    following = F.lead("at").over(Window.partitionBy(key).orderBy("place"))
    out = way.withColumn("_next", following).join(n_lines.select(key, "n"), key)
    return out.select(key, (F.col("place") + 1).alias("job"), (F.col("at") + 1 - first).alias("start_line"), F.coalesce(F.col("_next") - first, F.col("n")).cast("long").alias("end_line"))


def fixed_segments_by_pointers(
    texts: DataFrame, target: int = 400, least: int = 50, reach: int = 30, scores: Sequence[tuple[str, int]] = BREAK_SCORES, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """:func:`fixed_segments` for texts too long to be folded in a row: lines that may be broken at offer themselves to the targets within reach, every line
    takes the best offer as its pointer, and the pointers are followed from the first line."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    split = texts.select(key, lines.alias("_lines"))
    n_lines = split.select(key, F.size("_lines").cast("long").alias("n"))
    each = split.select(key, F.size("_lines").alias("n"), F.posexplode("_lines").alias("line", "_text")).select(key, "n", F.col("line").cast("long").alias("line"), break_score(F.col("_text"), scores).alias("score"))
    each = written(each, "scored-lines")
    far = F.least(F.lit(reach), F.col("score") - 1)
    offers = each.where("score > 0").select(key, "line", "score", F.explode(F.sequence(F.col("line") - far, F.col("line") + far)).alias("goal"))
    start = F.col("goal") - target
    offers = offers.where((start >= 0) & (F.col("line") >= start + least))
    best = offers.groupBy(key, start.alias("at")).agg(F.max(F.struct((F.col("score") - F.abs(F.col("line") - F.col("goal"))).alias("s"), (-F.col("line")).alias("l"))).alias("_best"))
    open_ = each.where(F.col("n") - F.col("line") > target).select(key, F.col("line").alias("at"))
    pointers = open_.join(best, [key, "at"], "left").select(key, "at", F.coalesce(-F.col("_best.l"), F.col("at") + target).alias("to"))
    return _cut(followed(pointers, n_lines.where("n > 0").select(key, F.lit(0).cast("long").alias("at")), [key]), n_lines, key, 0)


def neighbours(segments: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The value of the segment before and after."""
    w = Window.partitionBy(key).orderBy(order)
    return segments.withColumn("previous", F.lag(value).over(w)).withColumn("next", F.lead(value).over(w))
