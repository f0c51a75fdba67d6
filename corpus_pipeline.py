"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns the columns of docs, but
for the last, which returns the packed pieces. run() writes each stage's rows as Parquet into the folder that driver
and executors share, and reads them again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from corpusloom.llm.common import materialise, table

#: Tokens that the mixture may hold, as a share of those it is drawn from: room for clean documents to stay.
BUDGET = 1.3


def recognise_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier rejects go."""
    return language_id.keep_recognised(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the longest, then the one with the least doc_id, stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles, the one with the least doc_id stays."""
    return jaccard_join.keep_one(docs, k=5, threshold=80)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says, none to a few times, so that domains reach their target weights."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"), budget=BUDGET)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts as pieces in sequences of the permitted lengths."""
    return packing.pack(docs)


STAGES = [
    ("language id", recognise_language),
    ("exact dedup", drop_copies),
    ("near-duplicate join", drop_near_copies),
    ("mixing", mix_domains),
    ("best-fit packing", pack_sequences),
]

#: Trained models and sequential packing are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage{i}")
    return docs
