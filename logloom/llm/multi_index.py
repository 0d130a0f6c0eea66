"""Nearest neighbours by an inverted multi-index over two vector halves."""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import join_dimension
from .embeddings import _usable
from .shared import stage

NEAREST = 10
# The sample that codebooks and the stop are fitted on: rows, and numbers in all of them.
SAMPLE_ROWS = 16_384
SAMPLE_VALUES = 1 << 22
# Centroids per half are at most this many; below, the root of the number of vectors.
CENTROIDS = 1024
ROUNDS = 8
# Queries of the sample that set the stop, and the share of their neighbours it must reach.
TRIALS = 256
RECALL = 0.97
# Entries of a block, and queries that a task compares with it.
BLOCK = 2048
QUERIES = 4096
# The most frequent sizes of vectors get a codebook; vectors of any other size are one cell.
SIZES = 64
_NO_ID = (1 << 63) - 1


class Codebook:
    """Centroids of both halves of vectors of one size, cell counts, and the share of entries to visit."""

    def __init__(self, sample: np.ndarray, rows: int):
        self.cut = sample.shape[1] // 2
        wanted = max(1, min(CENTROIDS, math.isqrt(rows)))
        self.halves = [_centroids(part, wanted) for part in self._parts(sample)]
        self.share = self._fitted_share(sample)
        self.counts = np.zeros(self.shape, np.int64)

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.halves[0]), len(self.halves[1])

    def _parts(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rows[:, : self.cut], rows[:, self.cut :]

    def distances(self, rows: np.ndarray) -> list[np.ndarray]:
        """Squared distances of both halves to their centroids."""
        return [_squares(part, half) for part, half in zip(self._parts(rows), self.halves, strict=True)]

    def cells(self, rows: np.ndarray) -> np.ndarray:
        first, second = (d.argmin(axis=1) for d in self.distances(rows))
        return first * self.shape[1] + second

    def _fitted_share(self, sample: np.ndarray) -> float:
        """The share of entries, in the order of their cells, that holds ``RECALL`` of the neighbours
        of some sampled rows among the sample. More rows lie closer, so it is enough for all."""
        if len(sample) <= 2 * NEAREST:
            return 1.0
        queries = sample[:: max(1, len(sample) // TRIALS)][:TRIALS]
        cells = self.cells(sample)
        first, second = self.distances(queries)
        places = []
        for q, a, b in zip(queries, first, second, strict=True):
            near = np.argpartition(((sample - q) ** 2).sum(axis=1), NEAREST + 1)[: NEAREST + 1]
            by_cell = (a[:, None] + b[None, :]).ravel()[cells]
            places.extend(np.searchsorted(np.sort(by_cell), by_cell[near], "right"))
        return float(np.quantile(places, RECALL)) / len(sample)

    def visited(self, first: np.ndarray, second: np.ndarray) -> float:
        """The summed distance of the last cell to visit.

        Pairs of centroids are taken by their summed distance from a heap; a pair enters once both pairs
        before it are out. It ends when the cells hold the share to visit, and enough vectors.
        """
        rows, columns = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        a, b, width = first[rows].tolist(), second[columns].tolist(), len(columns)
        counts = self.counts
        wanted = max(NEAREST + 1, math.ceil(self.share * counts.sum()))
        heap, reach, found, last = [(a[0] + b[0], 0, 0)], [0] * len(a), 0, 0.0  # reach: pairs out per row
        while heap and found < wanted:
            last, i, j = heappop(heap)
            found += counts[rows[i], columns[j]]
            reach[i] = j + 1
            if j + 1 < width and (i == 0 or reach[i - 1] > j + 1):
                heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if i + 1 < len(a) and reach[i + 1] == j:
                heappush(heap, (a[i + 1] + b[j], i + 1, j))
        return last


def _squares(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    found = (rows * rows).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2 * rows @ points.T
    return np.maximum(found, 0)


def _centroids(rows: np.ndarray, wanted: int) -> np.ndarray:
    """At most ``wanted`` distinct centroids by k-means, started from rows spread over the sample."""
    points = np.unique(rows[:: max(1, len(rows) // wanted)][:wanted], axis=0)
    for _ in range(ROUNDS):
        near = _squares(rows, points).argmin(axis=1)
        sums = np.zeros_like(points)
        np.add.at(sums, near, rows)
        n = np.bincount(near, minlength=len(points))[:, None]
        points = np.where(n > 0, sums / np.maximum(n, 1), points)
    return points


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    return np.array(vectors.flatten(), float).reshape(-1, size)


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows for the index, where only order counts: extreme values are cut so that squares stay finite."""
    return np.clip(rows, -1e100, 1e100)


def exact_distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, also where squares leave the range of doubles."""
    with np.errstate(over="ignore", under="ignore"):
        gap = rows - query
        found = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        odd = np.flatnonzero(~((found > 1e-140) & (found < 1e150)))
        if len(odd):
            half = rows[odd] / 2 - query / 2
            top = np.abs(half).max(axis=1)
            unit = half / np.where(top > 0, top, 1)[:, None]
            found[odd] = 2 * (top * np.sqrt((unit * unit).sum(axis=1)))
    return found


def fit(classes: DataFrame) -> dict[int, Codebook]:
    """A codebook per size of vector, from a bounded sample taken by a hash of the values.

    The number of sampled rows is ``SAMPLE_ROWS``, or fewer if they hold ``SAMPLE_VALUES`` numbers.
    """
    books = {}
    counts = classes.groupBy("size").count().where(f"size <= {SAMPLE_VALUES}").orderBy(F.desc("count"), "size").limit(SIZES)
    for size, rows in sorted((r[0], r[1]) for r in counts.collect()):
        wanted = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // size))
        drawn = classes.where(F.col("size") == size)
        if rows > 2 * wanted:  # about twice as many by the hash, then exactly so many
            drawn = drawn.where(F.col("k2") < int((2 * wanted / rows - 0.5) * 2**64))
        taken = drawn.select("k2", "k1", "vector").orderBy("k2", "k1").limit(wanted).toArrow()
        sample = _matrix(taken["vector"].combine_chunks(), size)
        if len(sample):
            books[size] = Codebook(_scaled(sample), rows)
    return books


def _by_size(vectors: pa.Array, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield size, at, _matrix(vectors.take(pa.array(at)), size)


def cell_of(books: dict[int, Codebook]):
    """A column function: the cell of each vector; of a size without codebook, one cell for all."""

    @F.arrow_udf("long")
    def run(vectors: pa.Array) -> pa.Array:
        out = np.zeros(len(vectors), np.int64)
        for size, at, rows in _by_size(vectors, np.array([len(v) for v in vectors])):
            if size in books:
                out[at] = books[size].cells(_scaled(rows))
        return pa.array(out)

    return run


def _visits(batches: Iterator[pa.RecordBatch], books: dict[int, Codebook]) -> Iterator[pa.RecordBatch]:
    """The blocks that hold a cell to visit, per query, with the distance of the last cell."""
    layouts = {size: _layout(book.counts) for size, book in books.items()}
    for batch in batches:
        sizes = np.array([len(v) for v in batch.column(1)])
        for size, at, rows in _by_size(batch.column(1), sizes):
            nodes = batch.column(0).take(pa.array(at)).to_pylist()
            out: dict[str, list] = {"node": [], "block": [], "last": [], "vector": []}
            if size in books:
                first, second = books[size].distances(_scaled(rows))
            for k, node in enumerate(nodes):
                last, blocks = 0.0, [0]
                if size in books:
                    last = books[size].visited(first[k], second[k])
                    inside = (first[k][:, None] + second[k][None, :]).ravel() <= last
                    blocks = np.unique(layouts[size][inside & (books[size].counts.ravel() > 0)]).tolist()
                out["node"] += [node] * len(blocks)
                out["block"] += blocks
                out["last"] += [last] * len(blocks)
                out["vector"] += [rows[k].tolist()] * len(blocks)
                if len(out["node"]) >= 4096:
                    yield _visit_batch(size, out)
                    out = {c: [] for c in out}
            yield _visit_batch(size, out)


def _visit_batch(size: int, out: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([size] * len(out["node"]), pa.int32()), pa.array(out["block"], pa.int64()), pa.array(out["node"], pa.int64()),
            pa.array(out["last"], pa.float64()), pa.array(out["vector"], pa.list_(pa.float64())),
        ],
        ["size", "block", "node", "last", "vector"],
    )


def _layout(counts: np.ndarray) -> np.ndarray:
    """The block of each cell: cells in order, about ``BLOCK`` entries to a block."""
    flat = counts.ravel()
    return (np.cumsum(flat) - flat) // BLOCK


def _compare(batches: Iterator[pa.RecordBatch], books: dict[int, Codebook]) -> Iterator[pa.RecordBatch]:
    """The nearest entries of each query within a part of a block: entries come first, queries pass by."""
    key, entries, nodes, least, cells = None, None, None, None, None
    out: dict[str, list] = {"query": [], "node": [], "least": [], "score": []}

    def found() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        made = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))
        for v in out.values():
            v.clear()
        return made

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("size", "block", "part", "slot")), strict=True))
        side = batch.column("side").to_numpy()
        first = 0
        while first < len(keys):
            end = first + 1
            while end < len(keys) and keys[end] == keys[first] and side[end] == side[first]:
                end += 1
            size = keys[first][0]
            some = batch.slice(first, end - first)
            rows = _matrix(some.column("vector"), size)
            if side[first] == 0:
                more = (rows, some.column("node").to_numpy(), some.column("least").to_numpy())
                if keys[first] == key:  # a part's entries may come in several batches
                    entries, nodes, least = (np.concatenate([x, y]) for x, y in zip((entries, nodes, least), more, strict=True))
                else:
                    (entries, nodes, least), key = more, keys[first]
                cells = None
            elif keys[first] == key:
                book = books.get(size)
                if book is not None:
                    cells = book.cells(_scaled(entries)) if cells is None else cells
                    a, b = book.distances(_scaled(rows))
                queries, last = some.column("node").to_pylist(), some.column("last").to_pylist()
                for k, query in enumerate(queries):
                    at = np.arange(len(entries))
                    if book is not None:
                        width = book.shape[1]
                        at = np.flatnonzero(a[k][cells // width] + b[k][cells % width] <= last[k] * (1 + 1e-9))
                    score = exact_distances(entries[at], rows[k])
                    order = np.lexsort((least[at], score))[: NEAREST + 1]
                    out["query"] += [query] * len(order)
                    out["node"] += nodes[at[order]].tolist()
                    out["least"] += least[at[order]].tolist()
                    out["score"] += score[order].tolist()
                if len(out["query"]) >= 10_000:
                    yield found()
            first = end
    yield found()


def nearest(vectors: DataFrame, every: int = 100) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``NEAREST`` rows nearest to each row whose id ``every`` divides.

    Score is the Euclidean distance in double precision; equal ones go to the smaller ``vec_id``, rows
    without id last. Only vectors of equal size have a distance; vectors that are null, empty, zero or
    hold null or non-finite components take no part. A row is no candidate of its own query, other rows
    of its id are; rows that share an id are queries each. Fewer candidates are all returned; an
    empty table gives an empty result; other columns are ignored.

    Equal vectors are one entry of the index, which stands for its ``NEAREST + 1`` least ids, so copies
    neither fill cells nor hide others. Codebooks are fitted on a bounded sample; every vector is
    indexed. The search is approximate by the cells it leaves out: a query visits cells by summed
    centroid distance until they hold the share of entries in which sampled queries had 0.97 of their neighbours.
    Where vectors have structure that is a few cells; the less they have, the more it must read.
    """
    vector = F.col("embedding").cast("array<double>")
    rows = stage(
        vectors.where(_usable(vector)).select(
            F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), F.monotonically_increasing_id().alias("uid")
        )
        .withColumn("k1", F.xxhash64("vector")).withColumn("k2", F.xxhash64(F.lit(1), "vector", F.size("vector"))),
        "vectors",
    )
    asks = (F.col("vec_id") % every == 0) & F.col("vec_id").isNotNull()
    classes = stage(
        rows.groupBy("k1", "k2").agg(
            F.min("uid").alias("node"), F.coalesce(F.min("vec_id"), F.lit(_NO_ID)).alias("least"), F.first("vector").alias("vector"), F.max(asks).alias("asks")
        ).withColumn("size", F.size("vector")),
        "classes",
    )
    books = fit(classes)
    indexed = stage(classes.withColumn("cell", cell_of(books)("vector")), "indexed")
    for size, cell, n in _cell_counts(indexed, books):
        books[size].counts.flat[cell] = n
    blocks = _blocks(vectors.sparkSession, books)
    asked = indexed.where("asks").select("node", "vector")
    visits = stage(asked.mapInArrow(lambda it: _visits(it, books), "size int, block long, node long, last double, vector array<double>"), "visits")
    # Entries of a hot block are repeated per slot of its queries, a hot cell's entries are dealt to parts.
    slots = visits.groupBy("size", "block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("slots"))
    placed = join_dimension(indexed, blocks, ["size", "cell"]).withColumn("block", F.coalesce("block", F.lit(0)))
    held = placed.groupBy("size", "block").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("parts"))
    plan = stage(held.join(slots, ["size", "block"]), "blocks")
    deal = lambda c, n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(c)
    own = lambda c, n, key: F.pmod(F.xxhash64(F.col(key)), F.col(n)).cast("int").alias(c)
    entries = join_dimension(placed, plan, ["size", "block"], "inner").select(
        "size", "block", own("part", "parts", "node"), deal("slot", "slots"), F.lit(0).alias("side"), "node", "least", F.lit(0.0).alias("last"), "vector"
    )
    queries = join_dimension(visits, plan, ["size", "block"], "inner").select(
        "size", "block", deal("part", "parts"), own("slot", "slots", "node"), F.lit(1).alias("side"), "node",
        F.lit(0).cast("long").alias("least"), "last", "vector",
    )
    where = ["size", "block", "part", "slot"]
    dealt = entries.unionByName(queries).repartition(*where).sortWithinPartitions(*where, "side")
    found = stage(dealt.mapInArrow(lambda it: _compare(it, books), "query long, node long, least long, score double"), "found")

    def first(df: DataFrame, keys: str, order: str) -> DataFrame:
        return df.selectExpr("*", f"row_number() over (partition by {keys} order by {order}) as place").where(f"place <= {NEAREST + 1}")

    best = first(found, "query", "score, least, node").select("query", "node", "score")
    members = first(rows.select("k1", "k2", "vec_id", "uid"), "k1, k2", "vec_id nulls last, uid").select("k1", "k2", "vec_id", "uid")
    named = classes.select("k1", "k2", "node").join(members, ["k1", "k2"]).select("node", "vec_id", "uid")
    near = first(best.join(named, "node"), "query", "score, vec_id nulls last, uid")
    lists = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "uid", "score"))).alias("near"))
    asking = rows.where(asks).select("k1", "k2", F.col("vec_id").alias("query_id"), F.col("uid").alias("own"))
    known = lists.join(classes.select(F.col("node").alias("query"), "k1", "k2"), "query").drop("query")
    result = join_dimension(asking, known, ["k1", "k2"], "inner").select(
        "query_id", F.expr(f"posexplode(slice(filter(near, x -> x.uid <> own), 1, {NEAREST}))").alias("rank", "x")
    )
    return result.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _cell_counts(indexed: DataFrame, books: dict[int, Codebook]) -> Iterator[tuple[int, int, int]]:
    """Entries per cell; at most the square of ``CENTROIDS`` rows per codebook, read one by one."""
    counts = indexed.where(F.col("size").isin(list(books))).groupBy("size", "cell").count()
    for row in counts.toLocalIterator():
        yield row[0], row[1], row[2]


def _blocks(spark: SparkSession, books: dict[int, Codebook]) -> DataFrame:
    """``size, cell, block`` of the cells in use."""
    tables = [
        pa.table({"size": pa.array([size] * len(used), pa.int32()), "cell": used, "block": _layout(book.counts)[used]})
        for size, book in books.items()
        for used in [np.flatnonzero(book.counts.ravel())]
    ]
    if not tables:
        return spark.createDataFrame([], "size int, cell long, block long")
    return spark.createDataFrame(pa.concat_tables(tables))
