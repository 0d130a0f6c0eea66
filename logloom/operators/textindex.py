"""A word index of the logs as an ordinary table: (log_id, field, pos, token)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, words
from ..functions.text import term_words
from ..schema import BATCH, own_batch
from ..session import join_dimension, stage
from .filters import SEARCH_FIELDS, any_of

BUCKET = "token_bucket"
# Postings that one task sorts and writes.
TASK_ROWS = 500_000


def token_bucket(token: Column, buckets: int = 256) -> Column:
    """The partition of a token: prefixes of three characters stay together."""
    return F.pmod(F.xxhash64(F.left(token, F.lit(3))), F.lit(buckets)).cast("int")


def build_postings(logs: DataFrame, by_day: bool = False) -> DataFrame:
    """One row per word of app, alias and message. No shuffle: each row yields its own words.
    ``by_day`` adds ``log_date``, so that searches can open the newest days first."""
    day = [F.to_date("timestamp").alias("log_date")] if by_day else []
    fields = F.array(
        *[F.struct(F.lit(f).alias("field"), words(F.coalesce(F.col(f), F.lit(""))).alias("w")) for f in SEARCH_FIELDS]
    )
    return (
        logs.select(*day, F.col("id").alias("log_id"), F.inline(fields))
        .select(*(["log_date"] if by_day else []), "log_id", "field", F.posexplode("w").alias("pos", "token"))
    )


def deal_postings(postings: DataFrame, buckets: int = 256, rows: int = TASK_ROWS) -> DataFrame:
    """The postings with their bucket, dealt so that a task gets about ``rows`` of them, by day first
    if they have ``log_date``.

    The buckets are counted first. One with a common word is dealt by log over as many parts as its
    size needs, smaller ones than a task so that tasks come out even, and there are as many tasks as
    the whole needs.
    """
    keys = [*(["log_date"] if "log_date" in postings.columns else []), BUCKET]
    placed = postings.withColumn(BUCKET, token_bucket(F.col("token"), buckets))
    sizes = stage(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "bucket-sizes")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    parts = join_dimension(placed, sizes.withColumn("_parts", F.ceil(F.col("_n") * 4 / rows)).drop("_n"), keys)
    # A day that is null meets no size
    spread = parts.withColumn("_s", F.pmod(F.xxhash64("log_id"), F.coalesce("_parts", F.lit(8)))).drop("_parts")
    tasks = math.ceil(total / rows)
    dealt = spread.repartition(tasks, *keys, "_s") if tasks > 8 else spread.repartition(*keys, "_s")
    return dealt.select(*postings.columns, BUCKET)


def write_postings(postings: DataFrame, path: str, buckets: int = 256, mode: str = "append") -> None:
    """The index by token bucket, sorted inside its files, so a lookup reads one bucket; by day
    first if the postings have ``log_date``.

    Rows of one bucket go to several tasks (by log), so a common word does not fill one.
    """
    day = ["log_date"] if "log_date" in postings.columns else []
    (
        deal_postings(postings, buckets)
        .withColumn(BATCH, F.lit(own_batch()))
        .sortWithinPartitions(*day, BUCKET, "token")
        .write.mode(mode).partitionBy(*day, BUCKET, BATCH).parquet(path)
    )


def _condition(postings: DataFrame, token: str, prefix: bool, field: str | None, buckets: int) -> Column:
    cond = F.col("token").startswith(token) if prefix else F.col("token") == token
    if field:
        cond = cond & (F.col("field") == field)
    if BUCKET in postings.columns and (not prefix or len(token) >= 3):
        cond = cond & (F.col(BUCKET) == token_bucket(F.lit(token), buckets))
    return cond


def lookup(
    postings: DataFrame, term: str, prefix: bool | None = None, field: str | None = None, buckets: int = 256
) -> DataFrame:
    """Ids of the rows with the term, by the rules of ``has_term``: a term of several words (an
    address) is looked up as a phrase, and a term without words is in no row."""
    if prefix is None:
        prefix = term.endswith("*") or len(term) >= fixed.TERM_PREFIX_MIN_CHARS
    tokens = term_words(term)
    if not tokens:
        return postings.select("log_id").limit(0)
    if len(tokens) > 1:
        return lookup_phrase(postings, term, prefix, field, buckets)
    return postings.filter(_condition(postings, tokens[0], prefix, field, buckets)).select("log_id").distinct()


def lookup_phrase(
    postings: DataFrame,
    phrase: str,
    prefix: bool = False,
    field: str | None = None,
    buckets: int = 256,
) -> DataFrame:
    """Ids of the rows with the phrase's words in a row inside one field."""
    tokens = term_words(phrase)
    last = len(tokens) - 1
    conds = [_condition(postings, w, prefix and i == last, field, buckets) for i, w in enumerate(tokens)]
    # Where the phrase would start if this posting is its i-th word; one start per word it may be
    starts = F.array_compact(
        F.array(*[F.when(c, F.struct((F.col("pos") - i).alias("start"), F.lit(i).alias("i"))) for i, c in enumerate(conds)])
    )
    return (
        postings.filter(any_of(*conds))
        .select("log_id", "field", F.inline(starts))
        .groupBy("log_id", "field", "start")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") == len(tokens))
        .select("log_id")
        .distinct()
    )


def logs_of(logs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of a lookup. The ids are written once, so their size is known before the join."""
    found = stage(ids.withColumnRenamed("log_id", "id"), "lookup")
    return join_dimension(logs, found, ["id"], "left_semi")


def drop_postings(postings: DataFrame, ids: DataFrame) -> DataFrame:
    """The index without deleted rows."""
    return join_dimension(postings, ids.toDF("log_id").distinct(), ["log_id"], "left_anti")
