"""A corpus pipeline: toxic documents go, repeated runs of lines go, one of each group of near copies stays, sources are mixed, sequences are packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.llm import linededup, mixing, packing, simhash, toxicity
from gridsift.llm.common import Shelf, table
from gridsift.operators.storage import scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the labels of documents that are still there.

    Null, empty and very long texts, ties, repeated rows, empty tables and other columns: see toxicity.reject. Without labels of both classes all documents stay.
    """
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later copies of repeated runs of lines deleted from their texts, n_chars counted again.

    Null texts stay null (n_chars too), texts whose lines all go become empty; ties, repeated rows, long texts, empty tables and other columns: see linededup.dedup_lines.
    """
    out = linededup.dedup_lines(docs, spans=None)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies. All null and empty texts are one group. Ties, repeated rows, long texts, empty tables and other columns: see simhash.keep_one."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them. Documents without words are not taken. Ties, repeated rows, long texts, empty tables and other columns: see mixing.mixed_documents."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences. Null, empty and very long texts, ties, repeated rows, empty tables and other columns: see packing.pack."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: A trained classifier, suffix ranks and a tokenizer are not expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each stage's result written to the shared folder and read again."""
    shelf, docs = Shelf(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch():  # what the stage wrote on its way goes when its result is there
            docs = shelf.put(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
