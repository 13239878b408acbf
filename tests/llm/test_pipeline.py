"""The pipeline's stages one after another and on odd tables, and that every registered query runs."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from srclens.llm import queries
from srclens.llm.common import written

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now and now <= before, name
        before = now
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == before


def test_stages_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        assert docs.count() == 0, name


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns of clashing names."""
    r = random.Random(31)
    vocabulary = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").select(F.explode(F.split("text", " ")).alias("w")).where("w rlike '^[a-z]+$'").distinct().orderBy("w").limit(400).collect()]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    same, near = prose(200), prose(300)
    rows = [(i, prose(150), "en", "a", 1) for i in range(30)] + [(30, same, "en", "b", 1)] * 3 + [(31, same, "en", None, 1), (None, same, None, "b", None)]
    rows += [(32, near, "en", "b", 1), (33, near + " more", "en", "c", 1), (33, prose(120), "en", "c", 1), (34, None, None, None, None), (None, None, None, None, None), (35, "", "en", "a", 0), (36, prose(60_000), "en", "c", 1)]
    docs = spark.createDataFrame(rows, DOC)
    for c in ("row", "kept", "size", "doc", "key", "position", "_n", "line"):
        docs = docs.withColumn(c, F.lit("clash"))
    return docs.repartition(5)


def test_quality_stage_of_odd_rows(spark, odd):
    out = STAGES["quality"](spark, odd, SF)
    kept = Counter((r["doc_id"], r["text"]) for r in out.collect())
    given = Counter((r["doc_id"], r["text"]) for r in odd.collect())
    assert out.columns == odd.columns and all(given[k] == n for k, n in kept.items())  # a row's copies share its verdict
    assert not any(len(words(text)) < 50 for _, text in kept)


def test_line_dedup_stage_of_odd_rows(spark, odd):
    out = STAGES["line_dedup"](spark, odd, SF).collect()
    given = Counter((r["doc_id"], r["text"]) for r in odd.collect())
    got = Counter((r["doc_id"], r["text"]) for r in out)
    assert all(given[k] >= n for k, n in got.items())  # no line of these is dropped in part
    # Of equal long lines in several documents the first stays; rows equal in doc_id and text are one document.
    gone = {k for k in given if k not in got}
    same = next(t for i, t in given if i == 30)
    assert gone == {(31, same), (None, same)} or gone == {(30, same), (31, same)}, gone


def test_near_duplicates_stage_of_odd_rows(spark, odd):
    out = STAGES["near_duplicates"](spark, odd, SF)
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    given = {(r["doc_id"], r["text"]) for r in odd.collect()}
    near = next(t for i, t in given if i == 32)
    same = next(t for i, t in given if i == 30)
    want = {k for k in given if k[1] not in (None, same) and k != (33, near + " more")} | {(30, same), (34, None)}
    assert out.columns == odd.columns and got == Counter(want)


def test_mixing_stage_of_odd_rows(spark, odd):
    out = STAGES["mix_sources"](spark, odd, SF).collect()
    size, taken = Counter(), Counter()
    for r in odd.collect():
        size[r["doc_id"], r["text"]] += len(words(r["text"]))
    for r in out:
        text = next(t for i, t in size if i == r["doc_id"] and t is not None and t.startswith(r["text"]))
        taken[r["doc_id"], text] += len(words(r["text"]))
    assert all(n <= 2 * size[k] for k, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 40


def test_packing_stage_of_odd_rows(spark, odd):
    pieces = STAGES["pack"](spark, odd, SF).toPandas()
    assert pieces["doc_id"].isna().any() and pieces.groupby("sequence_id")["length"].sum().max() <= 1024
    null_docs = pieces[pieces["doc_id"].isin([34, 35])]
    assert list(null_docs["doc_tokens"]) == [1, 1]
    assert sum(pieces[pieces["start"] == 0].groupby("doc_id", dropna=False).size()) == odd.count()


def test_run_leaves_no_stage_behind(spark):
    from pathlib import Path

    from srclens.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    assert corpus_pipeline.run(spark, SF).count() > 0
    left = {d.name.rsplit("-", 1)[0] for d in set(folder.iterdir()) - before}
    assert not left & {"quality", "line_dedup", "near_duplicates"}, left


def test_every_query_covers_its_table(spark):
    for name, query in queries.QUERIES.items():
        out = query(spark, SF)
        key = {"op9_html_cut": ("page_id", "pages"), "op10_chat_repair": ("conv_id", "conversations"), "op13_spectrum_slicing": ("vec_id", "embeddings")}.get(name, ("doc_id", "documents"))
        ids = spark.read.parquet(f"{SF}/{key[1]}.parquet").select(key[0]).distinct().count()
        assert out.select(key[0]).distinct().count() == ids, name
