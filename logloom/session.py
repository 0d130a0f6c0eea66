"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

# A dimension table is broadcast only when it is counted to hold at most this many rows and bytes.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 << 20
# Spark's own choice before a run goes by the size of files. They are packed: ten MB of ids, hosts and
# times can be several hundred MB of rows on the driver. Choices during a run go by the bytes of rows.
BROADCAST_MAX_FILE_BYTES = 256 << 10
BROADCAST_MAX_MEASURED_BYTES = 8 << 20
# Bytes of a batch that goes to a Python worker. A batch is in memory several times, in Java and in Python,
# and with whole texts the usual 10,000 rows are tens of MB.
ARROW_BATCH_BYTES = 4 << 20


def ensure_utc(spark: SparkSession) -> SparkSession:
    """All timestamps of the library are UTC instants; text forms need the session zone UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def bound_broadcasts(spark: SparkSession) -> SparkSession:
    """No table is sent through the driver for the small size of its files alone: Spark joins by
    sorting unless files are tiny, and broadcasts what a shuffle has measured to be small."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": BROADCAST_MAX_FILE_BYTES,
        "spark.sql.adaptive.autoBroadcastJoinThreshold": BROADCAST_MAX_MEASURED_BYTES,
    }
    for name, most in wanted.items():
        now = spark.conf.get(name, None)
        size = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", now.strip().lower()) if now else None
        if size is None or int(size[1]) << (10 * " kmgt".index(size[2] or " ")) > most:
            spark.conf.set(name, str(most))
    return spark


def bound_batches(spark: SparkSession) -> SparkSession:
    """Batches for Python workers are cut by bytes as well as by rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", spark.conf.get(name).strip().lower())
    if size is None or int(size[1]) << (10 * " kmgt".index(size[2] or " ")) > ARROW_BATCH_BYTES:
        spark.conf.set(name, str(ARROW_BATCH_BYTES))
    return spark


# Folders of staged results, newest scope last; the first list is outside any scope.
_STAGED: list[list[tuple[SparkSession, str]]] = [[]]


@lru_cache(maxsize=None)
def _own_folder(application: str) -> str:
    """A folder for local sessions without a shared one, as in tests."""
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a session in one process gets a temporary folder; any other master raises,
    because executors of other machines would not see it.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = _own_folder(spark.sparkContext.applicationId)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """The frame written once to the shared folder and read from there.

    For a result that several later steps read: it is computed once, survives lost executors, and
    its readers take only the columns they need. Inside ``stage_scope`` the folder goes when the
    scope ends.
    """
    path = f"{checkpoint_dir(bound_batches(bound_broadcasts(df.sparkSession)))}/{label}-{uuid.uuid4().hex}"
    _STAGED[-1].append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def stage_scope():
    """Removes, at its end, the folders that ``stage`` wrote inside; use the results before that."""
    _STAGED.append([])
    try:
        yield
    finally:
        for spark, path in _STAGED.pop():
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Whether the table is proven to hold at most ``max_rows`` rows and ``max_bytes`` bytes as JSON
    text (reads no more than that many rows)."""
    some = df.limit(max_rows + 1)
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))), F.lit(0))
    rows, bytes_ = some.agg(F.count(F.lit(1)), size).first()
    return rows <= max_rows and bytes_ <= max_bytes


def small_side(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """The table with a broadcast hint when it is proven small, otherwise unchanged."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def join_dimension(
    facts: DataFrame,
    dim: DataFrame,
    keys: list[str],
    how: str = "left",
    max_rows: int = BROADCAST_MAX_ROWS,
    salts: int = 16,
) -> DataFrame:
    """A fact table joined to a dimension on equal keys without a hot task.

    A dimension proven small is broadcast, so the facts do not move. Otherwise both sides
    shuffle on the keys and a salt: the facts spread each hot key over ``salts`` partitions and
    the dimension is repeated that often; it is never broadcast, however small its files are.
    """
    if is_small(dim, max_rows):
        return facts.join(F.broadcast(dim), keys, how)
    spread = facts.withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int"))
    repeated = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")
