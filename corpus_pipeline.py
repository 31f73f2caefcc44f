"""A training-data pipeline of five stages, each by one operator of tidemark.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, saved, table, unused
from tidemark.llm.decontaminate import without_benchmark
from tidemark.llm.lang_id import fit, predict
from tidemark.llm.line_dedup import remove_repeated_lines
from tidemark.llm.ngram_join import without_near_duplicates
from tidemark.llm.packing import pack
from tidemark.session import visible_to_workers


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those rejected go.

    Rejected are null and empty texts, texts without a letter, and texts whose
    language is uncertain or whose n-grams are unusual in it.  Learned from the
    rows that have a label; without any, all go.  Repeated rows fare alike, a
    null doc_id changes nothing, an empty table gives none, and all columns of
    docs stay, whatever their names.
    """
    added = tuple(unused(f"_tidemark_{name}", docs) for name in ("lang", "score", "rejected"))
    return predict(docs, fit(docs), added=added).where(~F.col(added[2])).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand earlier in a run of three; n_chars follows.

    Null and empty texts, texts of fewer than three lines and rows without
    doc_id stay as they are; repeated rows lose nothing to each other.  A text
    that loses all of its lines is empty and stays a document.  An empty table
    gives none, and all columns of docs stay, whatever their names.
    """
    removed = unused("_tidemark_removed", docs)
    cut = remove_repeated_lines(docs, removed_col=removed)
    length = F.when(F.col(removed) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return cut.select(*(length.alias(c) if c == "n_chars" else c for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id.

    Null, empty and blank texts are duplicates of nothing and stay, as do rows
    without doc_id.  Repeated rows of a document that stays all stay.  An empty
    table gives none, and all columns of docs stay, whatever their names.
    """
    return without_near_duplicates(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none, and rows without doc_id stay.  Repeated rows
    fare alike.  With an empty benchmark all stay; an empty table gives none, and
    all columns of docs stay, whatever their names.
    """
    return without_benchmark(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their sequences.

    A null or empty text is packed as its end id alone; repeated rows and rows
    without doc_id are packed each.  An empty table gives no pieces.
    """
    return pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: Language ID and packing can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written before the next begins, and the one before it is deleted then."""
    visible_to_workers(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        before, docs = docs, stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = saved(docs)
            discard(before)
    return docs
