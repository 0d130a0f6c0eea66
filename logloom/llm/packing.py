"""Best-fit decreasing packing of tokenized documents into sequences of a fixed length."""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F
from tokenizers import Tokenizer

from .shared import stage, text_binary

CAPACITY = 2048
END_ID = 0
SPECIAL = "<|endoftext|>"
# Rows numbered in one task; lengths with more rows are numbered in several.
NUMBERED = 100_000


@lru_cache(maxsize=1)
def _encoders(vocabulary: str, ranks: str) -> tuple[Tokenizer, tiktoken.Encoding]:
    pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})
    return Tokenizer.from_file(vocabulary), fast


def encode(text: str, vocabulary: str | None = None, ranks: str | None = None) -> list[int]:
    """The ids of ``tokenizers`` without special tokens added.

    The same vocabulary as ranks gives the same ids three times as fast; a text that spells the
    special token out goes through ``tokenizers`` itself, which takes it as one id.
    """
    path = public_tokenizers.path
    slow, fast = _encoders(vocabulary or path("byte_bpe_50k.json"), ranks or path("byte_bpe_50k.tiktoken"))
    if SPECIAL in text:
        return slow.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document; only the first may be short."""
    first = (length - 1) % capacity + 1
    return [(0, first)] + [(start, capacity) for start in range(first, length, capacity)]


PIECES = "array<struct<piece:int,start:long,length:int,ids_crc32:long>>"


def pieces(text: Column, capacity: int = CAPACITY) -> Column:
    """The pieces of each text's ids (and the end id) as an array of structs."""

    @F.arrow_udf(PIECES)
    def run(texts: pa.Array) -> pa.Array:
        offsets, found = [0], []
        for text in texts:
            ids = np.array([*encode(text.as_buffer().to_pybytes().decode("utf-8", "replace")), END_ID], "<u4")
            for k, (start, length) in enumerate(cut(len(ids), capacity)):
                found.append((k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            offsets.append(len(found))
        columns = np.array(found, np.int64).reshape(-1, 4).T
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64())
        values = pa.StructArray.from_arrays(
            [pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)],
            names=["piece", "start", "length", "ids_crc32"],
        )
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    return run(text_binary(text))


class Capacities:
    """Open bins by remaining capacity, with a segment tree that finds the tightest that fits.

    Bins with equal room are held as ranges of bin numbers, so the tree has one leaf per capacity
    whatever the number of bins.
    """

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = np.zeros(2 * self.leaves, bool)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int) -> None:
        node = self.leaves + room
        self.any[node] = bool(self.ranges[room])
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def push(self, room: int, low: int, high: int) -> None:
        if high > low:
            self.ranges[room].append((low, high))
            self._mark(room)

    def pop(self, room: int) -> tuple[int, int]:
        found = self.ranges[room].pop()
        self._mark(room)
        return found

    def tightest(self, size: int) -> int | None:
        """The least room of an open bin that is at least ``size``."""
        node = self.leaves + size
        if self.any[node]:
            return size
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, ...]], int]:
    """Places ``counts[size]`` items of each size; returns placements and the number of bins.

    A placement ``(size, low, high, bin, each, offset)`` puts the items numbered low to high - 1 of
    that size into the bins from ``bin`` on, ``each`` per bin, the first of a bin at ``offset``. The
    result is that of best-fit decreasing item by item: a bin that took an item stays the
    tightest until it is too full, so equal bins are filled in bulk.
    """
    bins, used, placed = Capacities(capacity), 0, []
    for size in sorted((s for s, n in counts.items() if n > 0), reverse=True):
        at, count = 0, counts[size]
        while at < count:
            room = bins.tightest(size)
            if room is None:
                room, low, high = capacity, used, used + -(-(count - at) // (capacity // size))
                used = high
            else:
                low, high = bins.pop(room)
            each = room // size
            full = min(high - low, (count - at) // each)
            offset = capacity - room
            if full:
                placed.append((size, at, at + full * each, low, each, offset))
                at += full * each
                bins.push(room - each * size, low, low + full)
                low += full
            if at < count and low < high:  # the last bin of this size takes fewer
                left = count - at
                placed.append((size, at, count, low, each, offset))
                at = count
                bins.push(room - left * size, low, low + 1)
                low += 1
            bins.push(room, low, high)
    return placed, used


def _numbered(rows: DataFrame, total: int) -> DataFrame:
    """Rows with ``rank`` from 0 within their ``length``, numbered in parts of bounded size."""
    parts = max(1, -(-total // NUMBERED))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sizes = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sizes.selectExpr(
        "length", "part", "sum(n) over (partition by length order by part) - n as before"
    )
    own = rows.selectExpr(
        "*", "row_number() over (partition by length, part order by doc_id, piece, ids_crc32) - 1 as place"
    )
    return own.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Documents of more than ``capacity`` tokens are cut; a whole piece is a sequence of its own. The
    others are packed best-fit decreasing over the lengths of the whole table: the driver gets one
    count per length (``capacity`` rows at most) and plans which numbers of each length go to which
    bins; rows are then numbered within their length and find their place in the plan by a join on
    the length. Null and empty texts are one piece that holds the end id; repeated rows and
    null ids are packed as they are. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    cuts = docs.select("doc_id", F.inline(pieces(F.col("text"), capacity)))
    cuts = stage(cuts, "pieces")
    counts = {r[0]: r[1] for r in cuts.groupBy("length").count().collect()}
    whole = counts.pop(capacity, 0)
    placed, bins = best_fit_decreasing(counts, capacity)
    fields = "length int, low long, high long, bin long, each long, at long"
    plan = F.broadcast(spark.createDataFrame(placed, fields))  # a few rows per length
    rank = F.col("rank") - F.col("low")
    short = (
        _numbered(cuts.where(F.col("length") < capacity), sum(counts.values()))
        .join(plan, "length").where("rank >= low and rank < high")
        .withColumn("sequence_id", F.col("bin") + F.floor(rank / F.col("each")))
        .withColumn("offset", F.col("at") + rank % F.col("each") * F.col("length"))
    )
    full = (
        _numbered(cuts.where(F.col("length") == capacity), whole)
        .withColumn("sequence_id", F.col("rank") + bins).withColumn("offset", F.lit(0).cast("long"))
    )
    columns = ["doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", "sequence_id", "offset"]
    return short.select(*columns).unionByName(full.select(*columns))


def sequences(packed: DataFrame, docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id`` and ``ids``, the packed token ids, from the result of ``pack_documents``.

    ``doc_id`` must be unique in ``docs``. A sequence holds at most ``capacity`` pieces.
    """

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array([[*encode(t.as_buffer().to_pybytes().decode("utf-8", "replace")), END_ID] for t in texts], pa.list_(pa.int32()))

    tokens = docs.select("doc_id", ids(text_binary(F.col("text"))).alias("all_ids"))
    cut_ids = F.expr("slice(all_ids, cast(start as int) + 1, cast(length as int))")
    return (
        packed.join(tokens, "doc_id").select("sequence_id", F.struct("offset", cut_ids.alias("ids")).alias("part"))
        .groupBy("sequence_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
        .select("sequence_id", F.flatten("parts.ids").alias("ids"))
    )
