"""The stored log table: reading, appending, checking rows, sampling its size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import fixed
from ..functions.text import replace_surrogates
from ..operators.ordered import numbered
from ..schema import BATCH, INCIDENTS, LOG_DEFAULTS, LOGS, conform, own_batch, with_log_date
from .stored import finish_changes

TEXT_COLUMNS = ("source_ip", "source_alias", "app_name", "message", "raw")


def read_logs(spark: SparkSession, path: str, include_raw: bool = True) -> DataFrame:
    """The stored rows with checked columns; ``log_date`` stays for partition pruning."""
    stored = spark.read.parquet(path)
    rows = conform(stored, LOGS, LOG_DEFAULTS, fill=False)
    if "log_date" in stored.columns:
        rows = conform_with_date(stored)
    return rows if include_raw else rows.drop("raw")


def conform_with_date(stored: DataFrame) -> DataFrame:
    """The log columns and the partition column, in one projection."""
    schema = T.StructType([*LOGS.fields, T.StructField("log_date", T.DateType())])
    return conform(stored, schema, LOG_DEFAULTS, fill=False)


def assign_ids(rows: DataFrame, after: int, order: list[str] = ("received_at", "seq")) -> DataFrame:
    """``id`` in arrival order, counted on from ``after``, numbered in parallel by ranges of the order."""
    return numbered(rows, list(order), "id").withColumn("id", (F.col("id") + F.lit(after)).cast("long"))


def highest_id(spark: SparkSession, path: str) -> int:
    """The highest stored id (0 for no table); file footers answer it."""
    try:
        top = spark.read.parquet(path).agg(F.max("id")).first()[0]
    except Exception as e:  # the first batch finds no table
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return 0
        raise
    return top or 0


def write_days(rows: DataFrame, path: str, batch: int | None, mode: str = "append", tasks: int = 8) -> None:
    """Writes rows with ``log_date`` in the layout of every stored log table: a folder per day, in it
    one per batch, files sorted by host and time. At most ``tasks`` files per day and batch. Without
    ``batch`` rows keep the one they have."""
    if batch is not None:
        rows = rows.withColumn(BATCH, F.lit(batch).cast("long"))
    (
        rows.repartition("log_date", BATCH, F.pmod(F.xxhash64("id"), F.lit(tasks)))
        .sortWithinPartitions("log_date", BATCH, "source_alias", "timestamp")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("log_date", BATCH)
        .parquet(path)
    )


def append_logs(rows: DataFrame, path: str, order: list[str] = ("received_at", "seq")) -> None:
    """Appends rows by day as a batch of their own. Rows without ids get them in arrival order after
    the stored ones."""
    finish_changes(rows.sparkSession, path)
    if "id" not in rows.columns:
        rows = assign_ids(rows, highest_id(rows.sparkSession, path), list(order))
    write_days(with_log_date(conform(rows, LOGS, LOG_DEFAULTS)), path, own_batch())


def salvage_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be stored, repaired where needed, and the rest with ``problem``.

    Lone surrogates and bytes that are no UTF-8 become U+FFFD, missing texts and codes their
    defaults. A row without arrival time or address cannot be stored.
    """
    fixed_text = {
        c: replace_surrogates(F.make_valid_utf8(F.coalesce(F.col(c), F.lit(""))))
        for c in TEXT_COLUMNS if c in rows.columns
    }
    problem = (
        F.when(F.col("received_at").isNull(), F.lit("no arrival time"))
        .when(F.col("source_ip").isNull(), F.lit("no source address"))
        .when(~F.coalesce(F.col("severity"), F.lit(6)).between(0, 7), F.lit("severity out of range"))
    )
    marked = rows.withColumn("problem", problem)
    good = marked.filter("problem IS NULL").drop("problem").withColumns(
        {
            **fixed_text,
            "severity": F.coalesce("severity", F.lit(6)),
            "facility": F.coalesce("facility", F.lit(1)),
            "timestamp": F.coalesce("timestamp", "received_at"),
        }
    )
    return good, marked.filter("problem IS NOT NULL")


def write_incidents(
    incidents: DataFrame, path: str, sample_chars: int | None = fixed.INCIDENT_SAMPLE_CHARS
) -> None:
    """Appends fired alerts; the sample is cut to its first ``sample_chars`` (None: whole)."""
    rows = incidents
    if sample_chars is not None:
        rows = rows.withColumn("sample_log", F.left("sample_log", F.lit(sample_chars)))
    conform(rows, INCIDENTS).write.mode("append").parquet(path)


def sample_storage(spark: SparkSession, path: str, as_of=None) -> DataFrame:
    """One row: bytes in files, number of files and rows of a stored table."""
    files = (
        spark.read.parquet(path)
        .select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"))
        .groupBy("p")
        .agg(F.max("s").alias("s"), F.count(F.lit(1)).alias("n"))
    )
    at = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    return files.agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("db_size_bytes"),
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_logs_count"),
    ).withColumn("recorded_at", at)
