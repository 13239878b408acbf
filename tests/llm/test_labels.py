"""All labels of op2 count, however many there are."""

from pyspark.sql import functions as F

from srclens.llm import quality_llr


def test_all_labelled_ids_are_counted_and_fitted(spark):
    labels = spark.range(50_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    assert quality_llr.trusted_ids(labels).count() == 25_000
    held = labels.where("quality = 1").where(quality_llr.held_out()).count()
    got = {r.good: r.n for r in quality_llr.fitting_ids(labels).groupBy("good").agg(F.count("*").alias("n")).collect()}
    assert got == {1: held, 0: 25_000} and held > 4_000


def test_many_labels_are_joined_with_the_same_results(spark, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), F.xxhash64("id", i) % F.when(F.col("id") % 3 == 0, 40).otherwise(90)))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    judged = lambda: sorted(tuple(r) for r in quality_llr.score_documents(docs, labels).select("doc_id", "_llr", "_kept").collect())
    few = judged()
    monkeypatch.setattr(quality_llr, "BROADCAST_IDS", 0)
    assert judged() == few and {r[2] for r in few} == {True, False}
