"""The registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontamination, filter_audit as filters, repair
from .chat import conversation_digests, format_conversations, with_probe
from .decontamination import contaminations
from .embeddings import embedding_components
from .filter_audit import filter_audit
from .language import languages
from .multi_index import nearest
from .packing import pack_documents
from .repair import repair_digests
from .scoring import score_texts
from .secret_scan import secrets
from .shared import table
from .sharding import shard_documents
from .simhash import simhash_components
from .toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_components(table(spark, sf_dir, "documents"))


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    return pack_documents(table(spark, sf_dir, "documents"))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, with the offending spans as ``start:end`` in code points."""
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.withColumn("spans", text)


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return languages(table(spark, sf_dir, "documents"))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document; spans as ``kind:start:end`` in code points."""
    found = secrets(table(spark, sf_dir, "documents"))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.withColumn("spans", text)


@query
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document contains."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op2_benchmark_decontamination"] = decontamination.ORACLE


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document."""
    return shard_documents(table(spark, sf_dir, "documents"))


@query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    return score_texts(table(spark, sf_dir, "documents"))


@query
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embedding_components(table(spark, sf_dir, "embeddings"))


@query
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, read back from the formatter's output."""
    return conversation_digests(format_conversations(with_probe(spark, table(spark, sf_dir, "conversations"))))


ORACLES["op7_chat_formatting"] = chat.ORACLE


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How five filters interact in all orders, per language."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op11_filter_audit"] = filters.ORACLE


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of every conversation of the damaged table."""
    return repair_digests(table(spark, sf_dir, "conversations"))


ORACLES["op13_conversation_repair"] = repair.ORACLE


@query
def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    return nearest(table(spark, sf_dir, "embeddings"))
