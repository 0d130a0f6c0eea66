"""Benchmark items inside documents: MinHash containment search, partitioned by item size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import join_dimension
from .shared import byte_ranges, lower_ascii, slices, stage, text_binary

SHINGLE = 5
CONTAINMENT = 0.8
# Bits of a place in the filter of shingles: it grows with the items from the first to the second.
FILTER_BITS = (20, 23)
# Texts found contaminated that are broadcast at most (their digests, behind a count of rows and bytes).
SMALL_ROWS = 800_000

_BASE = np.uint64(0x2545F4914F6CDD1D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class Text:
    """Some texts: bytes with A-Z in lower case, byte ranges and hashes of the words, first words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Text:
        """Words are runs of letters, digits and non-ASCII bytes; ``offsets`` start at 0."""
        low, inside, n = lower_ascii(data), _WORD[data], len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * _powers(_INVERSE, n + 1)[starts]
        hashes = (hashes ^ (hashes >> np.uint64(32))) * _MIX
        return cls(low, starts, ends, np.searchsorted(starts, offsets, "left"), hashes ^ (hashes >> np.uint64(29)))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of ``width`` words within texts, and the word each begins at."""
        count = len(self.hashes) - width + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        mixed = np.zeros(count, np.uint64)
        for k in range(width):
            mixed = (mixed ^ self.hashes[k : k + count]) * _MIX
            mixed ^= mixed >> np.uint64(31)
        row = np.searchsorted(self.first, np.arange(count), "right") - 1
        inner = np.flatnonzero(np.arange(count) + width <= self.first[row + 1])
        return mixed[inner], inner

    def words(self, begin: int, width: int) -> bytes:
        return b" ".join(self.data[self.starts[k] : self.ends[k]].tobytes() for k in range(begin, begin + width))


def _texts(column: pa.Array) -> Iterator[tuple[int, Text]]:
    """The texts of a binary column, slice by slice, with the first row of each."""
    data, offsets = byte_ranges(column)
    for i, j in slices(offsets):
        yield i, Text.of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


ITEM = "struct<width:int,grams:array<struct<hash:bigint,gram:binary>>>"
_GRAM = pa.struct([("hash", pa.int64()), ("gram", pa.binary())])


def item_shingles(text: Column) -> Column:
    """The distinct shingles of each text, least hash first; a text of fewer words is one shingle."""

    @F.arrow_udf(ITEM)
    def run(texts: pa.Array) -> pa.Array:
        found = []
        for _, part in _texts(texts):
            for row in range(len(part.first) - 1):
                low, high = int(part.first[row]), int(part.first[row + 1])
                width = min(SHINGLE, high - low)
                one = Text(part.data, part.starts[low:high], part.ends[low:high], np.array([0, high - low]), part.hashes[low:high])
                hashes, begins = one.shingles(width) if width else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                grams = {one.words(int(b), width): h for h, b in zip(hashes.view(np.int64).tolist(), begins.tolist(), strict=True)}
                found.append({"width": width, "grams": [{"hash": h, "gram": g} for g, h in sorted(grams.items(), key=lambda x: (x[1], x[0]))]})
        return pa.array(found, pa.struct([("width", pa.int32()), ("grams", pa.list_(_GRAM))]))

    return run(text)


class Filter:
    """Which hashes may belong to a shingle of an item: two bits of a table per width, so its size does
    not grow with the items beyond ``FILTER_BITS``."""

    def __init__(self, bits: int, tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.bits, self.tables = bits, tables

    @classmethod
    def of(cls, shingles: DataFrame) -> Filter:
        """From ``width, hash`` of the shingles of all items; the driver sees places in the tables only."""
        n = shingles.count()
        bits = max(FILTER_BITS[0], min(FILTER_BITS[1], (8 * n).bit_length()))
        tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        mask = (1 << bits) - 1
        for k, place in enumerate((F.shiftrightunsigned("hash", 64 - bits), F.col("hash").bitwiseAND(mask))):
            used = shingles.select("width", place.alias("place")).distinct().toArrow()  # at most 2 ** bits per width
            widths, places = used["width"].to_numpy(), used["place"].to_numpy()
            for width in np.unique(widths).tolist():
                tables.setdefault(width, tuple(np.zeros(1 << bits, bool) for _ in range(2)))[k][places[widths == width]] = True
        return cls(bits, tables)

    def may_hold(self, width: int, hashes: np.ndarray) -> np.ndarray:
        high, low = self.tables[width]
        places = hashes.view(np.int64) & ((1 << self.bits) - 1)
        return high[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)] & low[places]


PROBE = "struct<words:int,hits:array<struct<width:int,hash:bigint,gram:binary>>>"


def probe(text: Column, known: Filter) -> Column:
    """The number of words of each whole text, and those of its shingles that the filter lets pass."""

    @F.arrow_udf(PROBE)
    def run(texts: pa.Array) -> pa.Array:
        words: list[int] = []
        hits: list[list[dict]] = []
        for _, part in _texts(texts):
            words.extend(np.diff(part.first).tolist())
            rows: list[dict[tuple[int, bytes], int]] = [{} for _ in range(len(part.first) - 1)]
            for width in known.tables:
                hashes, begins = part.shingles(width)
                kept = known.may_hold(width, hashes)
                begins, values = begins[kept], hashes[kept].view(np.int64).tolist()
                row = (np.searchsorted(part.first, begins, "right") - 1).tolist()
                for r, b, h in zip(row, begins.tolist(), values, strict=True):
                    rows[r][width, part.words(b, width)] = h
            hits.extend([{"width": w, "hash": h, "gram": g} for (w, g), h in found.items()] for found in rows)
        kind = pa.struct([("width", pa.int32()), ("hash", pa.int64()), ("gram", pa.binary())])
        return pa.StructArray.from_arrays([pa.array(words, pa.int32()), pa.array(hits, pa.list_(kind))], names=["words", "hits"])

    return run(text_binary(text))


def _digest(text: Column) -> Column:
    """Texts are told apart by their SHA-256, so copies of a text are searched once."""
    return F.unhex(F.sha2(text_binary(text), 256))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """``uid, item_id, width, grams, n, need, size_class`` of every distinct item that has a word."""
    items = benchmark.select("item_id", text_binary(F.col("text")).alias("text")).distinct()
    found = items.select("item_id", F.monotonically_increasing_id().alias("uid"), item_shingles(F.col("text")).alias("found"))
    n = F.size("grams")
    return stage(
        found.select("uid", "item_id", "found.*").where(n > 0).withColumns(
            {"n": n, "need": F.ceil(F.lit(CONTAINMENT) * n - 1e-9).cast("int"), "size_class": F.floor(F.log2(n)).cast("int")}
        ),
        "items",
    )


def _pairs(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, digest`` of the documents that hold a shingle of an item, and ``digest, item_id, n, inside`` of
    the items that a text contains.

    An item of n shingles is contained at the threshold t if ``need = ceil(t n)`` of them are in a text. Then at
    least one of any ``n - need + 1`` of them is, also of those with the least hash values: its sketch. The
    sketch's length depends on n, so items are kept by size, in classes that double; a text meets
    the classes that are not larger than itself. A text that holds a value of a sketch is a candidate, and
    its shingles are then compared with the item's, as texts.
    """
    items = benchmark_items(benchmark)
    known = Filter.of(items.select("width", F.explode("grams.hash").alias("hash")).distinct())
    probed = stage(
        docs.select("doc_id", _digest(F.col("text")).alias("digest"), probe(F.col("text"), known).alias("found"))
        .select("doc_id", "digest", "found.*").where(F.size("hits") > 0),
        "probed",
    )
    hits = stage(probed.select("digest", "words", F.inline("hits")).distinct(), "hits")
    sketch = F.slice("grams.hash", 1, F.col("n") - F.col("need") + 1)
    sketches = items.select("uid", "width", "need", "size_class", F.explode(sketch).alias("hash")).distinct()
    room = F.col("words") - F.col("width") + 1  # shingles that the text has room for
    met = join_dimension(hits.withColumn("room", room), stage(sketches, "sketches"), ["width", "hash"], "inner")
    # A class above the next one needs more shingles than the text has room for
    possible = (F.col("size_class") <= F.floor(F.log2("room")) + 1) & (F.col("need") <= F.col("room"))
    candidates = stage(met.where(possible).select("digest", "uid").distinct(), "candidates")
    grams = items.select("uid", "item_id", "width", "n", "need", F.explode("grams.gram").alias("gram"))
    wanted = join_dimension(candidates, grams, ["uid"], "inner")
    contained = (
        wanted.join(hits.select("digest", "width", "gram").distinct(), ["digest", "width", "gram"])
        .groupBy("digest", "uid").agg(F.first("item_id").alias("item_id"), F.first("n").alias("n"), F.first("need").alias("need"), F.count("*").alias("inside"))
        .where(F.col("inside") >= F.col("need"))
    )
    return probed.select("doc_id", "digest"), stage(contained.select("digest", "item_id", "n", "inside"), "contained")


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_contained, containment`` where at least 0.8 of an item's distinct
    shingles of five words are anywhere in a document.

    Words are runs of letters and digits with A-Z in lower case. An item of fewer words is one shingle: an item of
    one word is contained in every document with that word. Null and empty texts, of items or
    documents, contain nothing and are nowhere contained; repeated documents are each returned, an
    item repeated with the same id and text counts once; null ids are kept. Empty tables give an
    empty result. Neither items nor documents pass the driver; tables are broadcast where counted small.
    """
    rows, contained = _pairs(docs, benchmark)
    return join_dimension(rows, contained, ["digest"], "inner", SMALL_ROWS).select(
        "doc_id", F.col("item_id").cast("long").alias("item_id"), F.col("n").alias("n_shingles"),
        F.col("inside").cast("int").alias("n_contained"), (F.col("inside") / F.col("n")).alias("containment"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item."""
    _, contained = _pairs(docs, benchmark)
    bad = stage(contained.select(F.col("digest").alias("_digest")).distinct(), "contaminated")
    return join_dimension(docs.withColumn("_digest", _digest(F.col("text"))), bad, ["_digest"], "left_anti", SMALL_ROWS).select(*docs.columns)


ORACLE = r"""
with upper_lower as (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' u, 'abcdefghijklmnopqrstuvwxyz' l),
docs as (
  select doc_id, regexp_extract_all(translate(text, u, l), '[^\x00-/:-@\[-`{-\x7f]+') w
  from documents, upper_lower),
items as (
  select item_id, regexp_extract_all(translate(text, u, l), '[^\x00-/:-@\[-`{-\x7f]+') w
  from benchmark, upper_lower),
item_grams as (
  select distinct item_id, unnest([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) g from items),
doc_grams as (
  select distinct doc_id, unnest([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) g from docs),
sizes as (select item_id, count(*) n from item_grams group by 1),
hits as (select doc_id, item_id, count(*) k from doc_grams join item_grams using (g) group by all)
select doc_id, item_id, n::int n_shingles, k::int n_contained, k / n containment
from hits join sizes using (item_id) where k >= ceil(0.8 * n - 1e-9)
"""
