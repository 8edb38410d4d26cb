"""The corpus pipeline: toxicity, near copies, repeated passages, mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame whose
rows are written as Parquet and read again as the next stage's ``docs``. All stages but the last return the
columns of ``documents``; the last returns the pieces of the packed sequences.

In every stage a null text counts as empty, texts of any length are worked on whole, rows that repeat are rows like any other, rows without an
id are kept or dropped by their text alone, further columns pass through whatever their names, and no rows give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import mixing, ngram_join, packing, substrings, toxicity
from factloom.llm.spread import column, numbered, ship
from factloom.session import checkpoint_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the compression-distance classifier scores below 0.5; it learns from ``labels``, where ids not in ``docs`` teach nothing.

    Empty and null texts hold nothing toxic and stay; without a labelled row of either kind all rows stay.
    """
    return toxicity.drop_toxic(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group whose five-word shingles have a Jaccard similarity of 0.8 or more, along links.

    Repeated rows are copies of each other: one stays. Texts without a word are like no other and all stay.
    """
    ship(spark)
    return ngram_join.drop_near_copies(docs, n=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 35-word windows that occur elsewhere; ``n_chars`` follows the text.

    A text that loses no word stays as it is, a null one null; one that loses all words stays as an empty row.
    """
    ship(spark)
    cut = substrings.remove_repeats(docs)
    if "n_chars" not in docs.columns:
        return cut
    size = F.length(column(cut, "text")).cast(docs.schema[docs.columns.index("n_chars")].dataType)
    return numbered(cut).withColumn(column(cut, "n_chars"), size).toDF(*cut.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of the sources to their targets takes it: not at all, once or twice.

    Rows without a source are a source of their own; texts without a word weigh nothing and are taken as the draw falls.
    """
    ship(spark)
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of at most 1024; a null or empty text is its end id alone."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("substrings", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Classifier, mixing and packing have no SQL; tests/llm hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stage's rows written below the checkpoint folder and read again."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{folder}/{k}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
