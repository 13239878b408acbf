"""Line dedup: a log-template tree over the lines of all documents.

Fixed-depth parsing: tokens that hold a digit are masked, a line's leaf is its
token count and its first ``depth`` masked tokens. Inside a leaf a position keeps
a token if at least ``min_docs`` of the leaf's lines hold it there, else the position is a
variable field ``<*>``; a line whose constant share is below ``min_constant`` is
its own template. A template found in ``min_docs`` documents or more recurs: its
lines are dropped from every document but the first occurrence (the smallest
``(doc_id, row hash, line number)``), which stays.

Beside that, whole lines can recur, as ``WHOLE_LINES`` has them: equal lines of fewer than
``min_tokens`` tokens, with their digits, found in ``short_docs`` documents, and equal masked lines of
``LONG_TOKENS`` tokens or more, which don't meet by chance, found in ``long_docs``.

Everything is counted by grouping with partial sums: no leaf, line or template is
ever gathered in a task, however many rows share it. Only lines of leaves with at
least ``min_docs`` lines are looked at twice, so running prose costs one hash per line.

Defined results for odd input: a null text stays null and has no lines; lines without a
token always stay, those of fewer than ``min_tokens`` do without ``short_docs``; a line that repeats inside one document counts
once; rows equal in doc_id and text are one document, rows equal in doc_id alone are not; other columns are
carried along; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclens.llm.common import WHITE, clean_text, where_last, written

DEPTH = 3
MIN_TOKENS = 5
MIN_DOCS = 8
MIN_CONSTANT = 0.7
MASK = "<*>"
LONG_TOKENS = 50
#: Parts into which a template's lines are dealt.
SALTS = 32
#: Documents that share a short or a long whole line for it to recur, as the query and the pipeline have it.
WHOLE_LINES = {"short_docs": MIN_DOCS, "long_docs": 2}
#: Kinds of leaves: of the template tree, or of one whole line.
TREE, SHORT, LONG = 0, 1, 2


def spaced(line: Column) -> Column:
    """The line's tokens joined by one space."""
    plain = F.trim(F.translate(line, WHITE, " " * len(WHITE)))
    return F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, " +", " ")).otherwise(plain)


def masked(single: Column) -> Column:
    """A :func:`spaced` line with ``<*>`` for tokens with a digit.

    The expression for digits runs only on lines that have any.
    """
    return F.when(
        single.rlike("[0-9]"), F.regexp_replace(single, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", MASK)
    ).otherwise(single)


def row_key() -> Column:
    """Tells documents apart: rows equal in doc_id and text are one document."""
    return F.xxhash64("doc_id", "text")


def parsed_lines(
    docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, short: bool = False, long: bool = False
) -> DataFrame:
    """``doc_id, row, line_no, masked, kind, leaf, line`` of every line of ``min_tokens`` tokens or more, and of whole lines."""
    lines = docs.select("doc_id", row_key().alias("row"), F.posexplode(F.split(clean_text("text"), "\n")).alias("line_no", "raw"))
    lines = lines.select("doc_id", "row", "line_no", spaced(F.col("raw")).alias("single"))
    n = F.length("single") - F.length(F.translate("single", " ", "")) + 1
    least = F.lit(1 if short else min_tokens)
    lines = where_last(lines.withColumn("n_tokens", n), (F.col("n_tokens") >= least) & (F.col("single") != ""))
    is_short = F.col("n_tokens") < min_tokens
    # A short line stands for itself with its digits; they would be all that tells two of them apart.
    lines = lines.withColumn("masked", F.when(is_short, F.col("single")).otherwise(masked(F.col("single"))))
    lines = lines.withColumn("line", F.xxhash64("masked"))
    leaf = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("leaf"))
    tree = leaf(TREE, F.xxhash64("n_tokens", F.substring_index("masked", " ", depth)))
    own = F.when(is_short, F.array(leaf(SHORT, F.xxhash64("line", F.lit(SHORT)))))
    if long:
        own = own.when(F.col("n_tokens") >= LONG_TOKENS, F.array(tree, leaf(LONG, F.xxhash64("line", F.lit(LONG)))))
    if not short and not long:
        return lines.select("doc_id", "row", "line_no", "masked", tree.alias("at"), "line").select(
            "doc_id", "row", "line_no", "masked", "at.kind", "at.leaf", "line"
        )
    leaves = F.explode(own.otherwise(F.array(tree))).alias("at")
    return lines.select("doc_id", "row", "line_no", "masked", leaves, "line").select(
        "doc_id", "row", "line_no", "masked", "at.kind", "at.leaf", "line"
    )


def least_docs(min_docs: int, short_docs: int | None, long_docs: int | None) -> Column:
    """The documents that a leaf or template of ``kind`` must have to recur."""
    return (
        F.when(F.col("kind") == SHORT, F.lit(short_docs)).when(F.col("kind") == LONG, F.lit(long_docs)).otherwise(F.lit(min_docs))
    )


def line_templates(
    docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS,
    min_constant: float = MIN_CONSTANT, short_docs: int | None = None, long_docs: int | None = None,
) -> DataFrame:
    """``doc_id, row, line_no, kind, template`` (64-bit) of every line in a leaf of as many lines as may recur."""
    lines = parsed_lines(docs, depth, min_tokens, short_docs is not None, long_docs is not None)
    leaves = (
        lines.groupBy("leaf", "kind").agg(F.count("*").alias("n"), F.min("row").alias("lo"), F.max("row").alias("hi"))
        .where((F.col("n") >= least_docs(min_docs, short_docs, long_docs)) & (F.col("lo") != F.col("hi")))
        .select("leaf")
    )
    # Written, so that the join below stands on plain shuffles and a hot leaf's lines can be split.
    leaves = written(leaves, "busy-leaves")
    busy = written(lines.join(leaves.hint("merge"), "leaf", "left_semi"), "busy-lines")
    # One row per different masked line of a busy leaf; its tokens vote with the number of its lines.
    kinds = busy.where(F.col("kind") == TREE).groupBy("leaf", "line").agg(F.count("*").alias("n"), F.min("masked").alias("masked"))
    kinds = written(kinds, "line-kinds")
    tokens = kinds.select("leaf", "line", "n", F.posexplode(F.split("masked", " ")).alias("pos", "token"))
    constant = (
        tokens.groupBy("leaf", "pos", F.xxhash64("token").alias("token")).agg(F.sum("n").alias("votes"))
        .where(F.col("votes") >= min_docs)
        .select("leaf", "pos", "token", F.lit(True).alias("constant"))
    )
    voted = tokens.select("leaf", "line", "pos", F.xxhash64("token").alias("token")).join(
        constant, ["leaf", "pos", "token"], "left"
    )
    templates = voted.groupBy("leaf", "line").agg(
        F.bit_xor(F.xxhash64("pos", F.when(F.col("constant"), F.col("token")))).alias("code"),
        F.count("constant").alias("n_constant"),
        F.count("*").alias("n_tokens"),
    )
    # The leaf holds the token count, so a template needs no more than leaf and code.
    template = F.when(
        F.col("n_constant") >= min_constant * F.col("n_tokens"), F.xxhash64("leaf", "code")
    ).otherwise(F.xxhash64("leaf", "line", F.lit("own")))
    templates = templates.select("line", template.alias("template"))
    # A whole line is its own template, so that its leaf is.
    columns = ["doc_id", "row", "line_no", "kind", "template"]
    whole = busy.where(F.col("kind") != TREE).withColumn("template", F.col("leaf")).select(*columns)
    return busy.where(F.col("kind") == TREE).drop("leaf").join(templates, "line").select(*columns).union(whole)


def repeated_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, short_docs: int | None = None, long_docs: int | None = None, **options
) -> DataFrame:
    """``doc_id, row, line_no, template`` of the lines that go; a line that goes twice has the tree's template."""
    found = line_templates(docs, min_docs=min_docs, short_docs=short_docs, long_docs=long_docs, **options)
    found = written(found, "line-templates")
    recurring = (
        found.groupBy("template", "kind", "doc_id", "row").agg(F.min("line_no").alias("line_no"))
        .groupBy("template", "kind").agg(F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "row", "line_no")).alias("first"))
        .where(F.col("n_docs") >= least_docs(min_docs, short_docs, long_docs))
        .drop("kind")
    )
    # Written and dealt with a salt, so that the lines of a hot template meet it in many tasks.
    recurring = written(recurring, "recurring").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    gone = (
        found.withColumn("salt", F.pmod(F.xxhash64("row", "line_no"), F.lit(SALTS)).cast("int")).join(recurring.hint("merge"), ["template", "salt"])
        .where((F.col("row") != F.col("first.row")) | (F.col("line_no") != F.col("first.line_no")))
        .select("doc_id", "row", "line_no", "kind", "template")
    )
    if long_docs is None:
        return gone.drop("kind")
    return gone.groupBy("doc_id", "row", "line_no").agg(F.min_by("template", "kind").alias("template"))


def rewritten(docs: DataFrame, **options) -> DataFrame:
    """``docs`` held in the struct ``doc``, with the new ``text``, ``n_lines``, ``n_dropped``, ``n_templates``, ``n_dropped_chars``."""
    gone = repeated_lines(docs.select("doc_id", "text"), **options)
    gone = gone.groupBy(F.col("row").alias("gone_row")).agg(
        F.collect_set("line_no").alias("gone"), F.count_distinct("template").alias("n_gone")
    )
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").alias("old"), row_key().alias("row"))
    out = held.join(gone.hint("merge"), F.col("row") == F.col("gone_row"), "left").withColumn("lines", F.split("old", "\n"))
    # Set difference hashes: linear in the lines, unlike a search for each of them.
    keep = F.sort_array(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")))
    out = out.withColumn("keep", F.when(F.col("gone").isNotNull(), keep))
    text = F.when(F.col("keep").isNull(), F.col("old")).otherwise(
        F.array_join(F.transform("keep", lambda i: F.get("lines", i)), "\n")
    )
    n_lines = F.when(F.col("old").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long")
    return out.select(
        "doc",
        text.alias("text"),
        n_lines.alias("n_lines"),
        F.when(F.col("keep").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("keep")).cast("long").alias("n_dropped"),
        F.coalesce("n_gone", F.lit(0)).cast("long").alias("n_templates"),
        F.coalesce(F.length("old") - F.length(text), F.lit(0)).cast("long").alias("n_dropped_chars"),
    )


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``text`` without its repeated lines and with the counts of :func:`rewritten`, which replace columns of their names."""
    new = ["text", "n_lines", "n_dropped", "n_templates", "n_dropped_chars"]
    old = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in new]
    return rewritten(docs, **options).select(*old, *new)


def without_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents with the columns of ``docs`` and their new texts; ``n_chars`` follows the text.

    A document goes only if its repeated lines went and no word is left: all that it
    said stands in the first occurrences of its lines.
    """
    out = rewritten(docs, **options)
    out = where_last(out, (F.col("n_dropped") == 0) | (F.translate("text", WHITE, "") != ""))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("text").cast("long"))}

    def column(c: str) -> Column:
        old = F.col(f"doc.`{c}`")
        return (F.coalesce(new[c], old) if c in new else old).alias(c)

    return out.select(*[column(c) for c in docs.columns])
