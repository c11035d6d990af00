"""Corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), calls one operator on all its predecessor kept, and returns a DataFrame: the columns
of documents, but for the last stage, whose rows are the places of pieces in sequences. Stages handle what their operators
define: null and empty texts, repeated rows, empty tables and further columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm.common import table, written
from tarnlight.llm.line_dedup import without_repeated_lines
from tarnlight.llm.mixing import mixed
from tarnlight.llm.packing import pack_documents
from tarnlight.llm.quality import fitted, kept
from tarnlight.llm.similar import one_of_each_similar

THRESHOLD = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = fitted(docs, table(spark, sf_dir, "labels"))
    return kept(docs, model, THRESHOLD)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go from their texts; every document stays, and n_chars follows its text."""
    cut = without_repeated_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard 0.8 on shingles of five words) stays: that with the least doc_id."""
    return one_of_each_similar(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of the documents in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", lines_stage),
    ("near-dedup", simhash_stage),
    ("source mix", mixing_stage),
    ("packing", packing_stage),
]

#: Models, fingerprints by majority and tokenizers are beyond SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
