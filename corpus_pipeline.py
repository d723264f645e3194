"""From raw documents to packed training sequences, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its caller may write it as Parquet
and hand the reread table to the next.  Stages one to four return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridweave.llm import decontaminate, neardup, packing, quality, toxicity
from gridweave.llm.common import shared_dir, stored, table

#: SQL can express neither the classifiers nor the packing.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality.good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled examples vote toxic go."""
    return toxicity.harmless(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), "true"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays (five words, similarity of 0.8 or more)."""
    return neardup.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest is packed into sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"{at}/stage-{k}")
    return docs
