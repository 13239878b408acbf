"""Quality rules: hashed n-gram log-likelihood ratio of trusted target to raw corpus.

Two multinomials over ``n_buckets`` hashed words and word pairs are counted: one
over all documents that labels mark as good and not toxic and that aren't held out (the
trusted target), one over every document (the raw corpus). A document scores the
mean over its n-grams of ``log p_target - log p_raw``. Weights are fixed-point
integers, so a score doesn't depend on the order of summation and the threshold
decides every document the same way in every run.

The threshold is fitted on every corpus: one in ``HOLD_OUT`` trusted documents is held out of the
target, and with documents labelled bad they show where both kinds part. Only documents that pass the
base rules, and so are left to the ratio, take part.

Defined results for odd input: a null text has no words and fails the base rules;
without any trusted document all weights are 0; without labels of both kinds the threshold is
``THRESHOLD``; a document with labels of both kinds doesn't take part in fitting; repeated rows are judged row by
row; columns besides ``doc_id``, ``text`` are carried along by :func:`keep_good`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclens.llm.common import clean_text, where_last, words, written

#: Size of the hashed n-gram space, which bounds the weight table that every task gets.
N_BUCKETS = 1 << 16
#: Up to so many labelled doc_ids are broadcast; more meet the documents in a sort-merge join.
BROADCAST_IDS = 1 << 18
#: Least mean weight per n-gram, in nats, where labels don't show one.
THRESHOLD = -0.4
#: One in so many labelled documents, by hash of doc_id, stays out of the target and fits the threshold.
HOLD_OUT = 4
#: Scores are counted in so many bins per nat for that.
BINS = 1_000
#: Nats to fixed point.
SCALE = 1_000_000
#: Added to the count of each bucket.
SMOOTHING = 1.0

#: Bits of a sort key that hold the position of a window; longer texts are sorted in pairs.
POSITION_BITS = 26
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"


def base_features(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_w64`` and the base counts in one struct ``_base``.

    Three-word windows are compared as 64-bit hashes ``_h``. Sorting longs made of
    the hash's upper bits and the position brings equal windows together. Where different
    hashes share their upper bits, or positions don't fit, hashes and positions are sorted
    as pairs. A text of n words takes n log n steps, whatever it repeats.
    """
    text = clean_text("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\x0b\f\r", "") != "")
    out = word_hashes(docs).withColumn("_n", F.size("_w64"))
    hashes = F.transform(
        F.slice("_w64", 1, F.greatest(F.col("_n") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("_w64", i + 1), F.get("_w64", i + 2)),
    )
    out = out.withColumn("_h", hashes).withColumn("_lines", lines)
    keys = F.transform("_h", lambda h, i: F.shiftleft(F.shiftright(h, POSITION_BITS), POSITION_BITS).bitwiseOR(i.cast("long")))
    out = out.withColumn("_keys", F.sort_array(keys))
    position = lambda key: key.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")
    near = lambda x, k, d: F.shiftright(F.get("_keys", k + d), POSITION_BITS) == F.shiftright(x, POSITION_BITS)
    same = lambda x, k: F.get("_h", position(F.get("_keys", k + 1))) == F.get("_h", position(x))
    # Neighbours that share the upper bits are equal windows unless two different hashes share them, which long texts may have.
    chance = F.size(F.filter(F.col("_keys"), lambda x, k: near(x, k, 1) & ~same(x, k))) > 0
    again = F.transform(F.filter(F.col("_keys"), lambda x, k: near(x, k, -1) | near(x, k, 1)), position)
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    exact = F.get(
        F.transform(
            F.array(pairs), lambda p: F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]))
        ),
        F.lit(0),
    )
    exact = F.transform(exact, lambda x: x["i"])
    again = F.when(chance | (F.size("_h") >= 1 << POSITION_BITS), exact).otherwise(again)
    out = out.withColumn("_again", F.sort_array(again)).drop("_keys", "_h")
    covered = F.aggregate(
        F.transform(
            "_again",
            lambda i, k: F.least(F.lit(3), F.coalesce(F.get("_again", k + 1) - i, F.lit(3))),
        ),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return out.withColumn(
        "_base",
        F.struct(
            F.col("_n").cast("long").alias("n_words"),
            F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            covered.alias("n_repeat_words"),
        ),
    ).drop("_again", "_lines", "_n")


def word_hashes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_w64``, the 64-bit hashes of the words in order."""
    return docs.withColumn("_w64", F.transform(words("text"), lambda w: F.xxhash64(w)))


def ngram_buckets(n_buckets: int = N_BUCKETS) -> Column:
    """Buckets of all words and all pairs of neighbouring words, from ``_w64``."""
    ones = F.transform("_w64", lambda w: F.pmod(w, F.lit(n_buckets)).cast("int"))
    twos = F.transform(
        F.slice("_w64", 2, F.greatest(F.size("_w64") - 1, F.lit(0))),
        lambda w, i: F.pmod(F.xxhash64(F.get("_w64", i), w), F.lit(n_buckets)).cast("int"),
    )
    return F.concat(ones, twos)


def joinable(ids: DataFrame) -> DataFrame:
    """``ids`` with the hint that their number asks for."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return F.broadcast(ids) if few else ids.hint("merge")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All doc_ids labelled good and not toxic."""
    good = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0) & F.col("doc_id").isNotNull())
    return good.select(F.col("doc_id").alias("trusted_id")).distinct()


def bucket_weights(docs: DataFrame, labels: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """One row ``weights array<int>``: fixed-point log ratio of each bucket.

    Counts cover every document and every trusted one. Only ``n_buckets`` sums per task are shuffled, and texts where trusted ids are too many to be broadcast.
    """
    told = docs.select("doc_id", "text").join(joinable(trusted_ids(labels)), F.col("doc_id") == F.col("trusted_id"), "left")
    grams = (
        word_hashes(told)
        .select(F.col("trusted_id").isNotNull().cast("long").alias("t"), F.explode_outer(ngram_buckets(n_buckets)).alias("b"))
        .where(F.col("b").isNotNull())  # an outer explode computes its array once
        .groupBy("b")
        .agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    )
    every = docs.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("b"))
    row = every.join(grams, "b", "left").fillna(0, ["raw", "target"]).agg(
        F.sum("raw").alias("n_raw"),
        F.sum("target").alias("n_target"),
        F.sort_array(F.collect_list(F.struct("b", "raw", "target"))).alias("cells"),
    )
    # Additive smoothing: a bucket that the target lacks gets a bounded penalty.
    p_raw = lambda x: (x["raw"] + SMOOTHING) / (F.col("n_raw") + SMOOTHING * n_buckets)
    p_target = lambda x: (x["target"] + SMOOTHING) / (F.col("n_target") + SMOOTHING * n_buckets)
    return row.select(
        F.transform(
            "cells",
            lambda x: F.when(F.col("n_target") == 0, F.lit(0)).otherwise(
                F.round((F.log(p_target(x)) - F.log(p_raw(x))) * SCALE).cast("int")
            ),
        ).alias("weights")
    )


def held_out() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HOLD_OUT)) == 0


def fitting_ids(labels: DataFrame) -> DataFrame:
    """``fit_id, good``: all held-out trusted doc_ids and all labelled bad."""
    one = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("lo"), F.max("quality").alias("hi"), F.max("toxic").alias("toxic")
    )
    good = one.where((F.col("lo") == 1) & (F.col("toxic") == 0) & held_out())
    bad = one.where(F.col("hi") == 0)
    return good.select(F.col("doc_id").alias("fit_id"), F.lit(1).alias("good")).union(bad.select("doc_id", F.lit(0)))


def best_cut(bins: list[tuple[int, int, int]]) -> float | None:
    """The threshold that parts ``(bin, good, bad)`` counts best; None without both kinds.

    The share of good ones kept less the share of bad ones kept is largest, and the
    threshold lies halfway between the bins on its sides.
    """
    bins = sorted(bins)
    n_good, n_bad = sum(x[1] for x in bins), sum(x[2] for x in bins)
    if not n_good or not n_bad:
        return None
    best, cut, good, bad = 0, bins[0][0] / BINS, n_good, n_bad
    for (low, g, b), (high, _, _) in zip(bins, bins[1:]):
        good, bad = good - g, bad - b
        gain = good * n_bad - bad * n_good
        if gain > best:
            best, cut = gain, (low + 1 + high) / (2 * BINS)
    return cut


def fitted_threshold(docs: DataFrame, labels: DataFrame, weights: DataFrame, n_buckets: int = N_BUCKETS) -> float:
    """The threshold between both labels; only counts of bins come to the driver, some 10,000 at most."""
    labelled = docs.select("doc_id", "text").join(joinable(fitting_ids(labels)), F.col("doc_id") == F.col("fit_id"))
    judged = where_last(scored(labelled, weights, n_buckets), ~F.col("_failed") & F.col("_llr").isNotNull())
    bins = judged.groupBy(F.floor(F.col("_llr") * BINS).alias("bin")).agg(F.sum("good"), F.sum(1 - F.col("good")))
    cut = best_cut([tuple(x) for x in bins.collect()])
    return THRESHOLD if cut is None else cut


def scored(docs: DataFrame, weights: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """``docs`` with ``_base``, ``_llr`` and ``_failed``.

    The weight table goes to the tasks as a scalar subquery of ``n_buckets``
    integers; no document is shuffled.
    """
    out = base_features(docs).withColumn("_grams", ngram_buckets(n_buckets)).withColumn("_w", weights.scalar())
    total = F.aggregate("_grams", F.lit(0).cast("long"), lambda a, b: a + F.get("_w", b))
    out = out.withColumn("_llr", F.try_divide(total.cast("double"), F.size("_grams") * F.lit(float(SCALE))))
    base = F.col("_base")
    failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
    return out.drop("_grams", "_w", "_w64").withColumn("_failed", failed)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float | None = None, n_buckets: int = N_BUCKETS) -> DataFrame:
    """``docs`` with the struct ``_base`` and ``_llr`` (nats per n-gram), ``_kept``.

    Without a ``threshold`` it is fitted on held-out labels; with one, all trusted documents are counted.
    """
    if threshold is None:
        weights = written(bucket_weights(docs, labels.where(~held_out()), n_buckets), "bucket-weights")
        threshold = fitted_threshold(docs, labels, weights, n_buckets)
    else:
        weights = bucket_weights(docs, labels, n_buckets)
    return scored(docs, weights, n_buckets).withColumn(
        "_kept", ~F.col("_failed") & (F.coalesce("_llr", F.lit(0.0)) >= threshold)
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    held = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return where_last(score_documents(held, labels, **options), F.col("_kept")).select("doc.*")
