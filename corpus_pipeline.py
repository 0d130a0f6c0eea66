"""A training-data pipeline over ``documents``: toxic documents go, one of each group of near copies
stays, benchmark items and secrets are removed, and the rest is packed into sequences.

Every stage takes all rows that the one before kept and returns the same columns; the last returns
the pieces of the packed documents. Nulls, empty texts, repeated rows and further columns follow the
rules of the operators: a null text is not toxic, has fingerprint zero (so one document without words
stays), contains nothing, and is packed as one end id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.llm.decontamination import without_contaminated
from logloom.llm.packing import pack_documents
from logloom.llm.secret_scan import redact
from logloom.llm.shared import stage, table
from logloom.llm.simhash import one_of_each_group
from logloom.llm.toxicity import learn, score_text

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose toxicity score is below ``TOXIC``; the model is learnt from these rows."""
    model = learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(score_text(F.col("text"), model)["score"] < TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by SimHash, the one with the least ``doc_id``."""
    return one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that contain no benchmark item."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in ``text`` replaced by their kind; ``n_chars`` follows."""
    masked = redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return masked.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every row in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

# The chain of word models, fingerprints and token ids has no SQL form; tests hold it to brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
