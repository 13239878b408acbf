"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing and packing.

Every stage works on all rows that the stage before kept and returns the columns of
documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from srclens.llm import line_templates, mixing, ngram_join, packing, quality_llr
from srclens.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the likelihood ratio, unchanged.

    Rows are judged one by one, so repeated rows stay or go together; a null or empty text goes; nulls in other columns and extra
    columns don't matter; without labels of both kinds the threshold is the documented constant; an empty table stays empty.
    """
    return quality_llr.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines but their first occurrence, ``n_chars`` following; a row goes only if lines went and no word is left.

    Rows equal in doc_id and text are one document and keep their lines together; ties of the first occurrence go to the smallest doc_id
    (null first), row hash and line number; a null text stays; extra columns are carried along.
    """
    return line_templates.without_repeated_lines(docs, **line_templates.WHOLE_LINES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every class of equal and similar texts: the smallest doc_id (nulls last), then digest and row hash.

    Null texts are one class; wordless texts are alike only if equal; rows that share a doc_id are separate; extra columns are carried along.
    """
    return ngram_join.keep_one_of_each_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every draw of the mix, so that a row may stand twice; one document a source is cut to its leading words.

    A null source is a source of its own; null and wordless texts have size 0 and aren't drawn; equal rows at a cut share it; extra columns are carried along.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; every row is packed once, repeated ones too.

    A null or empty text is one id, the end of document; a null doc_id stays null; other columns aren't read.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Hashing (quality, mixing), line templates, MinHash and tokenising are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table is deleted when the next one's is written; the last one's input stays for its readers."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), name)
        scratch.drop(keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
