"""Shards of near-equal bytes by sampled splitters; DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from .shared import stage

SHARDS = 16
# Rows per range that are aimed at, bounds of the number of ranges, and samples per range.
RANGE_ROWS = 50_000
RANGES = (64, 4096)
SAMPLES = 16
_BLOCK = 64
_KEY = "struct<key:bigint,uid:bigint>"


def _literal(values: list[tuple[int, int]]) -> Column:
    """Splitters as one constant of the plan."""
    text = json.dumps([{"key": k, "uid": u} for k, u in values])
    return F.from_json(F.lit(text), f"array<{_KEY}>")


def _range_of(key: Column, splitters: list[tuple[int, int]]) -> Column:
    """How many of the sorted splitters are at most ``key``: by blocks, then within one block."""
    if not splitters:
        return F.lit(0)
    below = lambda s: s <= key
    block = F.size(F.filter(_literal(splitters[_BLOCK - 1 :: _BLOCK]), below))
    inside = F.slice(_literal(splitters), block * _BLOCK + 1, F.lit(_BLOCK))
    return block * _BLOCK + F.size(F.filter(inside, below))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row, by the law ``bytes``.

    A row's size is its text's UTF-8 bytes plus one; the bytes of any two shards differ by less than
    the sizes of two rows. Rows are ordered by a hash of the text, then a row number, so copies of
    a text are neighbours. Samples drawn by size give quantile splitters, which cut the order into
    ranges; a range of more than twice the mean size is cut further by row numbers. Sums per
    range, then within each, place every row in the order and so in its shard. A group of copies
    of any size spreads over ranges like other rows. Null texts have size 1 and the checksum of the
    empty text; repeated rows and null ids are each returned; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stage(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "sizes",
    )
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = min(RANGES[1], max(RANGES[0], -(-count // RANGE_ROWS)))
    chance = F.pmod(F.xxhash64("uid", "key"), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.where(chance < F.col("size") * (SAMPLES * ranges / max(total, 1))).select("key", "uid")
    sample = sorted((r[0], r[1]) for r in drawn.collect())  # about SAMPLES x ranges pairs of longs
    splitters = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []
    placed = rows.withColumn("range", _range_of(F.struct("key", "uid"), splitters))
    full = placed.groupBy("range").agg(F.sum("size").alias("n")).where(F.col("n") > 2 * total / ranges)
    cuts = {r[0]: -(-r[1] * ranges // total) for r in full.collect()}
    pieces = F.get(F.from_json(F.lit(json.dumps([cuts.get(k, 1) for k in range(ranges)])), "array<bigint>"), F.col("range"))
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("uid"), pieces))
    cells = placed.groupBy("range", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).selectExpr(
        "range", "piece",
        "sum(bytes) over (order by range, piece) - bytes as bytes_before",
        "sum(n) over (order by range, piece) - n as rows_before",
    )
    within = "over (partition by range, piece order by key, uid)"
    ordered = placed.selectExpr(
        "*", f"sum(size) {within} - size as inner_bytes", f"row_number() {within} - 1 as inner_rows"
    ).join(F.broadcast(cells), ["range", "piece"])  # at most about three cells per range
    ordered = stage(
        ordered.selectExpr(
            "doc_id", "size", "text_crc32", "rows_before + inner_rows as place",
            f"cast(least({shards - 1}, (2 * (bytes_before + inner_bytes) + size) * {shards} div (2 * {max(total, 1)})) as int) as shard",
        ),
        "places",
    )
    first = ordered.groupBy("shard").agg(F.min("place").alias("first"))
    return ordered.join(F.broadcast(first), "shard").select(  # one row per shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files_per_shard: int = 1) -> None:
    """Writes all columns of ``docs`` to folders ``shard=0`` and so on; ``doc_id`` must be unique."""
    places = shard_documents(docs, shards).select("doc_id", "shard", "slot")
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(files_per_shard))
    docs.join(places, "doc_id").repartition("shard", spread).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
