"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources, ordered by code point with null last, weigh 3, 1, 2, repeating; they
share 150 % of all words by weight, a target stops at twice its source's size and
the excess is shared again by weight until none is above.

Documents fall by hash into blocks of about ``BLOCK_WORDS`` words of a source, put in a keyed permutation. A
source's target is so many whole passes over its blocks, then a prefix of the permutation
whose last block and document are cut, so about ``floor(target)`` words are taken and no document
more than twice. The block draws of all sources are dealt to output shards of about ``SHARD_WORDS`` words
by a binary tree: each node gives half of its draws to the left child, with counts by source drawn from the
multivariate hypergeometric distribution (a chain of inverse-CDF draws; of many sources, by groups of
``GROUP`` first). A shard then takes the next blocks of each source's permutation, disjoint from other shards', and sorts its rows by a keyed hash.

Sizes and hashes are written once without the texts, and all planning reads these. There are at most ``MAX_BLOCKS`` blocks beside one a source (they grow
with the corpus beyond that), so their table can be broadcast up to that number and texts are shuffled once, to
their shards. All randomness is hashing with ``seed``: reruns agree.

Defined results for odd input: null text has size 0; documents of size 0 are taken 0 times; null is a source of
its own; a source of size 0 has target 0; repeated rows are separate documents, and where the cut falls on a number of equal rows they share what is left evenly, rounded
down; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srclens.llm.common import leading_words, n_words, numbered, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Words of a block, until the corpus has MAX_BLOCKS of them.
BLOCK_WORDS = 1 << 15
MAX_BLOCKS = 1 << 17
#: Words of an output shard, or BLOCKS_A_SHARD blocks if these are more.
SHARD_WORDS = 1 << 23
BLOCKS_A_SHARD = 4
#: Sources whose quotas stand in one array.
GROUP = 1024
#: Rows of a table that is broadcast, of some 200 bytes each (numbers, draws and a source name).
MAX_BROADCAST_ROWS = 1 << 18
SEED = 20240229


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, n_docs, rank, target`` of ``source, size`` rows; one row a source.

    The water level is found by rounds of sums over all sources; only sums come to the driver.
    """
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    found = numbered(found, F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS)).cast("int"))
    found = written(found.withColumn("w", weight).withColumn("cap", (CAP * F.col("source_size")).cast("double")), "sources")
    total = SHARE * (found.agg(F.sum("source_size")).first()[0] or 0)
    level, ratio = 0.0, F.col("cap") / F.col("w")
    while True:
        full, open_weight = found.agg(
            F.coalesce(F.sum(F.when(ratio <= level, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(ratio > level, F.col("w"))), F.lit(0.0))
        ).first()
        higher = (total - full) / open_weight if open_weight else level
        if higher <= level:
            break
        level = higher
    target = F.when(F.col("cap") > 0, F.least(F.col("cap"), F.lit(level) * F.col("w"))).otherwise(0.0)
    return found.select("source", "source_size", "n_docs", "rank", target.alias("target"))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hypergeometric(total: Column, good: Column, sample: Column, u: Column) -> Column:
    """The u-quantile of the number of good items among ``sample`` drawn from ``total``; all double.

    Probabilities follow from their ratios over 12 standard deviations around the mean,
    beyond which less lies than a double can tell.
    """
    mean = sample * good / F.greatest(total, F.lit(1.0))
    var = mean * (1 - good / F.greatest(total, F.lit(1.0))) * (total - sample) / F.greatest(total - 1, F.lit(1.0))
    reach = 12 * F.sqrt(F.greatest(var, F.lit(0.0))) + 2
    lowest, highest = F.greatest(F.lit(0.0), sample - (total - good)), F.least(good, sample)
    lo = F.greatest(lowest, F.floor(mean - reach).cast("double")).cast("long")
    hi = F.least(highest, F.ceil(mean + reach).cast("double")).cast("long")
    ratio = lambda k: (good - k) * (sample - k) / ((k + 1) * F.greatest(total - good - sample + k + 1, F.lit(1.0)))
    start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("cum"), F.lit(-1).cast("long").alias("k"))
    step = lambda level: lambda a, k: F.struct(
        (a["p"] * ratio(k.cast("double"))).alias("p"),
        (a["cum"] + a["p"]).alias("cum"),
        F.when(a["k"] >= 0, a["k"]).when(a["cum"] + a["p"] >= level, k).otherwise(F.lit(-1).cast("long")).alias("k"),
    )
    mass = F.aggregate(F.sequence(lo, hi), start, step(F.lit(float("inf"))))["cum"]
    found = _bound(mass, lambda m: F.aggregate(F.sequence(lo, hi), start, step(u * m))["k"])
    return F.when(found >= 0, found).otherwise(hi)


def _split_step(level: int, seed: int):
    def step(a: Column, q: Column) -> Column:
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "node", "group", F.size(a["out"])), F.lit(1 << 53)) / float(1 << 53)
        return _bound(
            hypergeometric(a["total"], q.cast("double"), a["sample"], u),
            lambda h: F.struct(
                (a["total"] - q).alias("total"),
                (a["sample"] - h).alias("sample"),
                F.concat(a["out"], F.array(h)).alias("out"),
            ),
        )

    return step


def _split(nodes: DataFrame, level: int, seed: int, sample: Column) -> DataFrame:
    """``nodes`` with ``left``: how many of each quota the left child takes, ``sample`` in all."""
    total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q).cast("double")
    start = F.struct(F.col("total").alias("total"), sample.cast("double").alias("sample"), F.array().cast("array<bigint>").alias("out"))
    nodes = nodes.withColumn("total", total)
    return nodes.withColumn("left", F.aggregate("quotas", start, _split_step(level, seed))["out"])


def _children(nodes: DataFrame) -> DataFrame:
    right = F.zip_with("quotas", "left", lambda q, h: q - h)
    child = lambda node, quotas: F.struct(node.alias("node"), quotas.alias("quotas"))
    pair = F.array(child(2 * F.col("node"), F.col("left")), child(2 * F.col("node") + 1, right))
    return nodes.select("group", F.explode(pair).alias("child")).select("child.node", "group", "child.quotas")


def splitting_tree(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """``shard, group, quotas array<long>``: how the rows ``group, quotas`` are dealt to the shards.

    Groups are numbered from 0. Every fifth level is dealt anew, so that no task makes all nodes.
    """
    assert n_shards & (n_shards - 1) == 0, "n_shards must be a power of two"
    nodes = quotas.select(F.lit(0).cast("long").alias("node"), "group", "quotas")
    half = F.floor(F.col("total") / 2)
    one = nodes.select("group").distinct().limit(2).count() < 2
    sums = F.transform(
        F.sort_array(F.collect_list(F.struct("group", F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q).alias("n")))), lambda x: x["n"]
    )
    tops = None if one else nodes.agg(sums.alias("quotas")).select(F.lit(0).cast("long").alias("node"), F.lit(-1).cast("long").alias("group"), "quotas")
    for level in range(n_shards.bit_length() - 1):
        if tops is None:
            nodes = _split(nodes, level, seed, half)
        else:
            tops = written(_split(tops, level, seed, half), "tree-tops")
            taken = tops.select("node", F.posexplode("left").alias("group", "sample"))
            nodes = _split(nodes.join(taken, ["node", "group"]), level, seed, F.col("sample"))
            tops = _children(tops)
        nodes = _children(nodes)
        if level % 5 == 4:
            nodes = written(nodes.repartition("node", "group"), "tree")
    return nodes.withColumnRenamed("node", "shard")


def _joined(left: DataFrame, right: DataFrame, on, n_rows: int) -> DataFrame:
    """Inner join; the right side is broadcast if its rows are few, whatever the left side is."""
    return left.join(F.broadcast(right) if n_rows <= MAX_BROADCAST_ROWS else right.hint("merge"), on)


def power_of_two(x: float) -> int:
    return 1 << max(0, int(-(-x // 1)) - 1).bit_length()


def _keys(seed: int) -> list[Column]:
    """Two hashes of a document; only rows equal in doc_id and text share both."""
    return [F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), F.xxhash64("text", "doc_id").alias("t")]


def mix(docs: DataFrame, n_shards: int | None = None, seed: int = SEED, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` held in the struct ``doc``, with ``size, source_size, target, taken, draws, h, t``.

    ``doc`` has the columns ``keep``, all of them by default.
    ``draws array<struct<p, shard, words>>`` has an entry for every time that words of the
    document are taken; ``taken`` is their sum. Nothing is shuffled but sizes and hashes.
    """
    numbers = written(docs.select("source", n_words("text").alias("size"), *_keys(seed)), "sizes")
    sources = source_targets(numbers)
    n_sources, total, wanted = sources.agg(F.count("*"), F.sum("source_size"), F.sum("target")).first()
    block_words = max(BLOCK_WORDS, (total or 0) / MAX_BLOCKS)
    if n_shards is None:
        n_shards = power_of_two((wanted or 0) / max(SHARD_WORDS, BLOCKS_A_SHARD * block_words))
    plan = sources.select(
        F.col("source").alias("s"), "source_size", "target", "rank", F.floor("target").cast("long").alias("quota"),
        F.greatest(F.ceil(F.col("source_size") / block_words), F.lit(1)).cast("long").alias("n_blocks"),
    )
    block = F.pmod("h", "n_blocks").alias("block")
    null_safe = F.col("source").eqNullSafe(F.col("s"))
    placed = _joined(numbers, plan, null_safe, n_sources).select("rank", block, "size", "h", "t")
    blocks = placed.groupBy("rank", "block").agg(F.sum("size").alias("words")).join(plan.select("rank", "quota", "source_size"), "rank")
    order = Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed), "rank", "block"), "block")
    blocks = (
        blocks.withColumn("pos", F.row_number().over(order) - 1)
        .withColumn("n", F.count("*").over(Window.partitionBy("rank")))
        .withColumn("before", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size"))
        .withColumn("extra", F.least(F.greatest(F.col("rest") - F.col("before"), F.lit(0)), F.col("words")))
        .select("rank", "block", "pos", "n", "passes", "words", "extra")
    )
    blocks = written(blocks, "blocks")
    # The one block of a source that is cut: where in it the words run out. Equal rows are one entry.
    cut_blocks = blocks.where((F.col("extra") > 0) & (F.col("extra") < F.col("words"))).select("rank", "block", "extra")
    inside = _joined(placed, cut_blocks, ["rank", "block"], n_sources).groupBy("rank", "block", "extra", "h", "t").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    upto = F.sum("words").over(Window.partitionBy("rank", "block").orderBy("h", "t"))
    cuts = inside.withColumn("upto", upto).where((F.col("upto") >= F.col("extra")) & (F.col("upto") - F.col("words") < F.col("extra")))
    part = F.floor((F.col("extra") - F.col("upto") + F.col("words")) / F.col("n")).alias("cut_words")
    cuts = written(cuts.select(F.col("rank").alias("r"), F.col("block").alias("cut_block"), F.col("h").alias("cut_h"), F.col("t").alias("cut_t"), part), "cuts")
    # The draws of a source are numbered pass by pass in its permutation, and dealt to the shards by the tree.
    drawn = blocks.groupBy("rank").agg((F.sum("passes") + F.count_if(F.col("extra") > 0)).cast("long").alias("q"))
    by_group = drawn.groupBy((F.col("rank") / GROUP).cast("long").alias("group"))
    quotas = by_group.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "q"))), lambda x: x["q"]).alias("quotas"))
    tree = splitting_tree(written(quotas, "quotas"), n_shards, seed).select("shard", "group", F.posexplode("quotas").alias("k", "q"))
    tree = written(tree.where("q > 0").select("shard", (F.col("group") * GROUP + F.col("k")).alias("rank"), "q"), "tree-leaves")
    end = F.sum("q").over(Window.partitionBy("rank").orderBy("shard"))
    dealt = tree.withColumn("end", end).select("rank", "shard", F.explode(F.sequence(F.col("end") - F.col("q"), F.col("end") - 1)).alias("draw"))
    n_draws = F.col("passes") + (F.col("extra") > 0).cast("long")
    passes = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(CAP).cast("long")), lambda p: p < n_draws)
    of_block = blocks.select("rank", "block", "pos", "n", F.explode(passes).alias("p")).withColumn("draw", F.col("p") * F.col("n") + F.col("pos"))
    shards = of_block.join(dealt, ["rank", "draw"]).groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("p", "shard"))).alias("shards"))
    full = blocks.select(F.col("rank").alias("r"), F.col("block").alias("b"), "passes", ((F.col("extra") > 0) & (F.col("extra") == F.col("words"))).alias("full"))
    full = full.join(shards, (F.col("r") == F.col("rank")) & (F.col("b") == F.col("block")), "left").select("r", "b", "passes", "full", "shards")
    full = written(full, "dealt-blocks")
    # All of this is small, so that the texts meet it where they are.
    plan = plan.join(cuts, F.col("rank") == F.col("r"), "left").drop("r")
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("doc"), "source", n_words("text").alias("size"), *_keys(seed))
    out = _joined(sized, written(plan, "plan"), null_safe, n_sources)
    out = out.withColumn("block", block)
    out = _joined(out, full, (F.col("rank") == F.col("r")) & (F.col("block") == F.col("b")), n_sources + MAX_BLOCKS)
    at, cut_at = F.struct("h", "t"), F.struct(F.col("cut_h").alias("h"), F.col("cut_t").alias("t"))
    cut = (
        F.when(F.col("full"), F.col("size")).when(F.col("block").eqNullSafe(F.col("cut_block")) & (at < cut_at), F.col("size"))
        .when(F.col("block").eqNullSafe(F.col("cut_block")) & (at == cut_at), F.col("cut_words")).otherwise(F.lit(0))
    )
    out = out.withColumn("cut", cut.cast("long"))
    draws = F.transform(
        F.coalesce("shards", F.array().cast("array<struct<p:bigint,shard:bigint>>")),
        lambda x: F.struct(x["p"].alias("p"), x["shard"].alias("shard"), F.when(x["p"] < F.col("passes"), F.col("size")).otherwise(F.col("cut")).alias("words")),
    )
    return out.select(
        "doc", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("cut")).cast("long").alias("taken"),
        F.filter(draws, lambda d: d["words"] > 0).alias("draws"), "h", "t", F.lit(n_shards).alias("n_shards"),
    )


def shuffled_draws(mixed: DataFrame, n_shards: int, seed: int = SEED, all_rows: bool = False) -> DataFrame:
    """A row for every draw of :func:`mix` at its ``position`` in its ``shard``: ``mixed`` with ``p, words, text`` (the words drawn).

    A partition holds one shard in its order. With ``all_rows`` documents that aren't drawn have a row of their own without a shard.
    """
    draw = F.explode_outer("draws") if all_rows else F.explode("draws")
    out = mixed.withColumn("draw", draw)
    words, size = F.col("draw.words"), F.col("size")
    text = F.when(words == size, F.col("doc.text")).when(words > 0, leading_words(F.col("doc.text"), words))
    rest = [c for c in ("_row", "size", "source_size", "target", "h", "t") if c in out.columns]
    columns = [F.col(f"doc.`{c}`").alias(c) for c in mixed.schema["doc"].dataType.names if c != "text"]
    out = out.select(
        F.struct(*columns).alias("doc") if columns else F.lit(None).alias("doc"), *rest, F.col("draw.p").alias("p"), F.col("draw.shard").alias("shard"),
        F.coalesce(words, F.lit(0)).alias("words"), text.alias("text"), F.xxhash64(F.lit(seed + 1), "h", "t", "draw.p").alias("_order"),
    )
    at = F.coalesce("shard", F.pmod("h", F.lit(n_shards))).cast("int")
    out = out.repartitionById(n_shards, at).sortWithinPartitions(F.col("shard").isNull(), "_order")
    return out.withColumn("position", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).drop("_order")


def shard_count(mixed: DataFrame) -> int:
    """The number of shards that :func:`mix` chose, a constant of its plan."""
    row = mixed.select("n_shards").limit(1).collect()
    return row[0][0] if row else 1


def mixed_documents(docs: DataFrame, n_shards: int | None = None, seed: int = SEED) -> DataFrame:
    """The mix itself with the columns of ``docs``: a row for every draw, dealt to its shard and shuffled there.

    A document that is drawn in part has its leading words, and their ``n_chars``.
    """
    mixed = mix(docs, n_shards, seed)
    out = shuffled_draws(mixed, n_shards or shard_count(mixed), seed)
    cut = F.col("words") < F.col("size")
    new = {"text": F.col("text"), "n_chars": F.when(cut, F.length("text").cast("long"))}

    def column(c: str) -> Column:
        old = F.col(f"doc.`{c}`") if c != "text" else F.col("text")
        return (F.coalesce(new[c], old) if c in new else old).alias(c)

    return out.select(*[column(c) for c in docs.columns])
