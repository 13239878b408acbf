"""The registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.llm import (
    alignment,
    chat_repair,
    gif_media,
    html_cut,
    line_templates,
    mixing,
    ngram_join,
    packing,
    pii_surrogates,
    quality_llr,
    token_trees,
    whitening,
    word_languages,
)
from srclens.llm.common import n_words, table

#: The key of the registered query, which protects nothing: its tables are invented.
TEST_KEY = "key-of-the-invented-tables"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text`` with surrogates, and the kinds of the entities in order; no original is returned."""
    out = pii_surrogates.with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), TEST_KEY)
    return out.select("doc.doc_id", "text", F.size("kinds").cast("long").alias("n_entities"), F.array_join("kinds", ",").alias("kinds"))


def op2_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_llr.score_documents(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", "_base.*", F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"),
        F.round("_llr", 6).alias("llr"),
    )


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_repeated_lines(docs, **line_templates.WHOLE_LINES).select("doc_id", "text", "n_lines", "n_dropped", "n_templates")


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text stored as a grey GIF, whose stored bytes are decoded again."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        gif_media.payload_of(F.col("text")).alias("payload"),
    )
    stored = gif_media.stored_as_gif(docs, "payload", keep=("doc_id", "n_bytes"))
    # The media's digest is taken before decoding, so that the bytes go to Python once more and not back.
    stored = stored.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    read = gif_media.media_columns(stored, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    total = F.aggregate(
        F.transform("frames", lambda f: f["histogram"]),
        F.array_repeat(F.lit(0).cast("long"), 3 * gif_media.BINS),
        lambda a, h: F.zip_with(a, h, lambda x, y: x + y),
    )
    return read.select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256",
        F.array_join(total, ",").alias("feature"), F.size("frames").cast("long").alias("n_frames"),
        F.aggregate("frames", F.lit(0).cast("long"), lambda a, f: a + f["duration_ms"]).alias("duration_ms"),
    )


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix is drawn and shuffled in its shards, texts and all; what it holds of each document is counted there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, keep=("doc_id", "text")).withColumn("_row", F.monotonically_increasing_id())
    drawn = mixing.shuffled_draws(mixed, mixing.shard_count(mixed), all_rows=True)
    place = F.when(F.col("shard").isNotNull(), F.struct("p", "shard", "position"))
    found = drawn.groupBy("_row").agg(
        *[F.first(c).alias(n) for c, n in (("doc.doc_id", "doc_id"), ("size", "size"), ("source_size", "source_size"), ("target", "target"))],
        F.sum(n_words("text")).alias("taken"), F.sort_array(F.collect_list(place)).alias("places"),
    )
    return found.select(
        "doc_id", "size", "source_size", "target", "taken", F.col("places.shard").alias("shards"), F.col("places.position").alias("positions")
    )


def op7_token_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_trees.edit_counts(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_html_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_cut.main_text(table(spark, sf_dir, "pages"))


def op10_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.chat_format(table(spark, sf_dir, "conversations"))


def op11_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_scores(table(spark, sf_dir, "documents"))


def op12_word_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the documents that aren't held out; every document is labelled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = word_languages.fit(docs.where(~F.coalesce(held_out, F.lit(False))))
    found = word_languages.languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


def op13_spectrum_slicing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_quality_llr": op2_quality_llr,
    "op3_line_templates": op3_line_templates,
    "op4_gif_media": op4_gif_media,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_mixing": op6_mixing,
    "op7_token_trees": op7_token_trees,
    "op8_packing": op8_packing,
    "op9_html_cut": op9_html_cut,
    "op10_chat_repair": op10_chat_repair,
    "op11_pair_bitmaps": op11_pair_bitmaps,
    "op12_word_languages": op12_word_languages,
    "op13_spectrum_slicing": op13_spectrum_slicing,
}

#: DuckDB SQL of the queries that SQL can express; the others are tested against brute force.
ORACLES: dict[str, str] = {}
