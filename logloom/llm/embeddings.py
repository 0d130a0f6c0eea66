"""Near-duplicate vectors of equal label by a pivot-permutation index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components
from .shared import stage
from .simhash import _hook

COSINE = 0.93
# Pivots (about twice the root of the number of vectors), nearest pivots that describe a vector,
# and how many of them two candidates share.
PIVOTS = (64, 2048)
NEAREST = 16
SHARED = 4
# Pivots are at least this far apart, so that a large group of copies does not provide them all.
PIVOT_COSINE = 0.8
# Vectors of one inverted list that a task compares with as many others.
BLOCK = 1024


def _usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite and some not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares of extreme values stay in range
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def choose_pivots(classes: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Pivots by dimension, from a sample of about four times as many vectors (taken by a hash)."""
    wanted = min(PIVOTS[1], max(PIVOTS[0], int(2 * math.sqrt(count))))
    share = min(1.0, 4 * wanted / max(count, 1))
    sample = classes.where(F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << 30)) < int(share * (1 << 30))).select("k1", "k2", "vector")
    found: dict[int, list[np.ndarray]] = {}
    for row in sorted(sample.collect(), key=lambda r: (r[0], r[1])):
        unit = _unit(np.array([row[2]], float))[0]
        kept = found.setdefault(len(unit), [])
        if len(kept) < wanted and (not kept or (np.array(kept) @ unit).max() < PIVOT_COSINE):
            kept.append(unit)
    return {size: np.array(kept) for size, kept in found.items()}


def describe(vector: Column, pivots: dict[int, np.ndarray]) -> Column:
    """The nearest pivots of each vector, nearest first; of a size without pivots, one list for all."""

    @F.arrow_udf("array<int>")
    def run(vectors: pa.Array) -> pa.Array:
        out: list[list[int]] = [[0]] * len(vectors)
        sizes = np.array([len(v) for v in vectors], np.int64)
        for size in np.unique(sizes).tolist():
            if size in pivots:
                at = np.flatnonzero(sizes == size)
                units = _unit(np.array(vectors.take(pa.array(at)).flatten(), float).reshape(len(at), size))
                near = np.argsort(-(units @ pivots[size].T), axis=1, kind="stable")[:, :NEAREST]
                for k, row in zip(at.tolist(), near.tolist(), strict=True):
                    out[k] = row
        return pa.array(out, pa.list_(pa.int32()))

    return run(vector)


def _compare(batches: Iterator[pa.RecordBatch], cosine: float, shared: int) -> Iterator[pa.RecordBatch]:
    """Links of each block pair of an inverted list, in a partition sorted by block pair.

    A pair of vectors is compared in the list of the least pivot they share, if they share enough,
    so it is compared once however many lists it meets in. Per vector the number of links, and its
    least linked vector within the block pair, are returned; pairs are not.
    """
    keys = ("label", "size", "pivot", "i", "j")

    def solve(part: pa.Table) -> pa.RecordBatch:
        size, pivot = part["size"][0].as_py(), part["pivot"][0].as_py()
        node, copies = part["node"].to_numpy(), part["n"].to_numpy()
        units = _unit(np.array(part["vector"].combine_chunks().flatten(), float).reshape(len(part), size))
        near = part["near"].combine_chunks()
        width = len(near[0])
        sets = np.array(near.flatten(), np.int64).reshape(len(part), width)
        own = part["i"][0].as_py() == part["j"][0].as_py()
        left = np.flatnonzero(part["side"].to_numpy() == 0)
        right = left if own else np.flatnonzero(part["side"].to_numpy() == 1)
        links, root = np.zeros(len(part), np.int64), np.arange(len(part))
        need = min(shared, width)
        names, ids = np.unique(sets, return_inverse=True)
        member = np.zeros((len(part), len(names)), np.float32)
        np.put_along_axis(member, ids.reshape(sets.shape), 1, axis=1)
        below = int(np.searchsorted(names, pivot))
        for low in range(0, len(left), 256):
            rows = left[low : low + 256]
            count = member[rows] @ member[right].T
            good = (count >= need) & (member[rows, :below] @ member[right, :below].T == 0)
            a, b = np.nonzero(good)
            a, b = rows[a], right[b]
            if own:
                a, b = a[a < b], b[a < b]
            for at in range(0, len(a), 1 << 15):
                x, y = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
                near_ = np.einsum("ij,ij->i", units[x], units[y]) >= cosine
                x, y = x[near_], y[near_]
                links += np.bincount(x, copies[y], len(part)).astype(np.int64)
                links += np.bincount(y, copies[x], len(part)).astype(np.int64)
                _hook(root, x, y)
        linked = np.flatnonzero(links)
        return pa.RecordBatch.from_pydict({"a": node[linked], "b": node[root[linked]], "links": links[linked]})

    rest = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        change = np.zeros(len(held), bool)
        for k in keys:
            values = held[k].combine_chunks().to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        first = [0, *np.flatnonzero(change).tolist()]
        for low, high in zip(first, first[1:], strict=False):
            yield solve(held.slice(low, high - low))
        rest = held.slice(first[-1])
    if rest is not None and len(rest):
        yield solve(rest)


def embedding_components(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Vectors link if their labels (not null) and sizes are equal and their cosine in double precision
    is at least ``cosine``. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing and are kept. ``component_id`` is the least ``vec_id`` reachable; null ids are
    passed over, and a row with a null id is kept only if it stands alone with no id to show: its
    ``kept`` is false. Rows of equal vectors are one class of the index and count with their number.
    An empty table gives an empty result; other columns are ignored.

    The candidate search is approximate: a pair is found if the vectors share ``SHARED`` of their
    ``NEAREST`` nearest pivots (measured recall at the threshold above 0.99). Every vector is
    indexed. As sets that share four of sixteen members share one of the first thirteen in any
    fixed order, only those lists are entered. A list of more than ``BLOCK`` vectors is cut into
    blocks that meet in pairs.
    """
    label, vector = F.col("label").cast("string"), F.col("embedding").cast("array<double>")
    rows = stage(
        vectors.select(
            "vec_id", F.when(F.col("label").isNotNull() & _usable(vector), vector).alias("vector"), label.alias("label"),
            F.monotonically_increasing_id().alias("uid"),
        )
        .withColumn("k1", F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector")))
        .withColumn("k2", F.when(F.col("vector").isNotNull(), F.xxhash64("vector", "label"))),
        "vectors",
    )
    usable = rows.where("vector is not null")
    # Two 64-bit hashes stand for label and values, so that long vectors are not grouping keys.
    classes = stage(
        usable.groupBy("k1", "k2").agg(
            F.count("*").alias("n"), F.min("uid").alias("node"), F.min("vec_id").alias("least"),
            F.first("label").alias("label"), F.first("vector").alias("vector"),
        ),
        "classes",
    )
    pivots = choose_pivots(classes, classes.count())
    entered = NEAREST - SHARED + 1
    described = stage(
        classes.select("node", "n", "label", "vector", F.size("vector").alias("size"), describe(F.col("vector"), pivots).alias("near")), "described"
    )
    entries = described.withColumn("pivot", F.explode(F.slice(F.array_sort("near"), 1, entered)))
    sizes = entries.groupBy("label", "size", "pivot").agg(F.count("*").alias("rows")).where("rows > 1")
    blocks = (
        entries.join(sizes, ["label", "size", "pivot"])
        .withColumn("parts", F.ceil(F.col("rows") / BLOCK).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "label", "size", "pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "n", "vector", "near",
        )
        .repartition("label", "size", "pivot", "i", "j").sortWithinPartitions("label", "size", "pivot", "i", "j")
    )
    found = stage(blocks.mapInArrow(lambda it: _compare(it, cosine, SHARED), "a long, b long, links long"), "found")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    joined = connected_components(found.select("a", "b"))
    own = (
        classes.select("k1", "k2", "n", "node", "least").join(counts, "node", "left").join(joined, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    ids = own.groupBy("component").agg(F.min("least").alias("component_id"))
    own = own.join(ids, "component").select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = usable.select("vec_id", "k1", "k2").join(own, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
