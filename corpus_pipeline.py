"""The corpus pipeline: quality, exact copies, near copies, packing. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import dedup_exact, minhash, pack, quality
from tidewatch.llm.queries import table, tokenizer_path
from tidewatch.llm.skew import fresh
from tidewatch.runtime import written

#: Score from which the quality stage keeps a document.
KEEP_FROM = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of ``docs`` whose text scores KEEP_FROM or more, learned from the labels of ``sf_dir``; all columns stay.

    Null and empty texts have the share of good labels as their score and stay if that is enough; rows are scored one by
    one, so repeated rows and null ids fare alike; very long texts are scored whole; no column name is taken away. An
    empty table gives an empty table; without labels nothing is known against a row but its score is 0.5, so none stays."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), exclude=quality.held_out())
    name = fresh("score", docs.columns)
    scored = quality.score_quality(docs, model, out_col=name)
    return scored.filter(F.col(name) >= KEEP_FROM).drop(name)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of ``docs`` of each group whose texts are equal but for white space, the longest, then the smallest id;
    all columns stay. Null and empty texts are one group. Rows that share an id, or have none, stay together if one of
    them does. Very long texts are hashed whole. An empty table gives an empty table."""
    return dedup_exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of ``docs`` of each component of texts with a Jaccard of 0.8 or more over five-word shingles, the smallest
    id; all columns stay. Null, empty and blank texts link with nothing and stay; rows that share an id stay together.
    Very long texts are compared on all their shingles. An empty table gives an empty table."""
    return minhash.drop_near_copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: where it stands in which sequence of 1024 tokens. Null and empty texts are their
    end token alone; repeated rows, also without an id, are packed each; long texts are cut into pieces, nothing is left
    out; other columns are ignored. An empty table gives an empty table."""
    return pack.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack_sequences),
]
#: SQL cannot express the quality and packing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
