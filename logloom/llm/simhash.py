"""SimHash near-duplicates: fingerprints, and links found by a binary trie joined with itself."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from .components import connected_components
from .shared import stage, text_binary

# Fingerprints of one trie node that a task holds; larger nodes are joined block by block.
BLOCK = 4096
# Node pairs that are split at once, and products of node sizes that are compared directly.
FRONTIER = 1 << 17
LEAF = 16


def fingerprint_of(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: words after lower-casing A-Z, shingles with repeats."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    parts = [joined[s:e] for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    hashes = np.fromiter(map(partial(xxh64_intdigest, seed=seed), parts), np.uint64, len(parts))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(parts), bitorder="little").tobytes(), "little")


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed long (the same 64 bits); null and empty texts give zero."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint_of(t.as_buffer().to_pybytes(), shingle) for t in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return run(text_binary(text))


class TrieJoin:
    """Pairs of sorted 64-bit keys at most ``budget`` bits apart, found by walking a binary trie
    against itself.

    A node is a range of the sorted keys that share their leading bits. Node pairs are split one
    bit at a time; unequal bits use up the budget, and a pair over budget is dropped with all that
    lies below. Few open pairs are held at once: the walk goes depth first in bounded pieces.
    """

    def __init__(self, keys: np.ndarray, budget: int):
        self.keys, self.budget = keys, budget
        self._ones: dict[int, np.ndarray] = {}

    def _middle(self, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
        """Where the keys with this bit set begin in each range."""
        if depth not in self._ones:
            bit = (self.keys >> np.uint64(63 - depth)) & np.uint64(1)
            self._ones[depth] = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        ones = self._ones[depth]
        return high - (ones[high] - ones[low])

    def walk(self, nodes: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``nodes``: rows (a_low, a_high, b_low, b_high); equal ranges are one node against itself."""
        start = np.column_stack([nodes, np.zeros(len(nodes), np.int64)])
        stack = [(start[i : i + FRONTIER], depth) for i in range(0, len(start), FRONTIER)]
        while stack:
            part, depth = stack.pop()
            a0, a1, b0, b1, used = part.T
            own = a0 == b0
            keep = (a1 > a0) & (b1 > b0) & (used <= self.budget) & ~(own & (a1 - a0 < 2))
            small = keep & (((a1 - a0) * (b1 - b0) <= LEAF) | (depth >= 64))
            if small.any():
                yield self._compare(part[small])
            part = part[keep & ~small]
            if not len(part):
                continue
            a0, a1, b0, b1, used = part.T
            am, bm, own = self._middle(a0, a1, depth), self._middle(b0, b1, depth), a0 == b0
            below = np.concatenate(
                [
                    np.column_stack([a0, am, b0, bm, used]),
                    np.column_stack([am, a1, bm, b1, used]),
                    np.column_stack([a0, am, bm, b1, used + 1]),
                    np.column_stack([am, a1, b0, bm, used + 1])[~own],
                ]
            )
            stack += [(below[i : i + FRONTIER], depth + 1) for i in range(0, len(below), FRONTIER)]

    def _compare(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a0, a1, b0, b1, _ = part.T
        wide, total = b1 - b0, (a1 - a0) * (b1 - b0)
        node = np.repeat(np.arange(len(part)), total)
        place = np.arange(len(node)) - np.repeat(np.cumsum(total) - total, total)
        a, b = a0[node] + place // wide[node], b0[node] + place % wide[node]
        near = np.bitwise_count(self.keys[a] ^ self.keys[b]) <= self.budget
        near &= (a0 != b0)[node] | (a < b)
        return a[near], b[near]


def _hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of linked places under their least place."""
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def _links(batches: Iterator[pa.RecordBatch], prefix: int, budget: int, hold: int) -> Iterator[pa.RecordBatch]:
    """Links of the nodes in a sorted partition; whole nodes are gathered up to ``hold`` keys."""

    def solve(held: pa.Table) -> pa.RecordBatch:
        column = {k: held[k].to_numpy() for k in ("turn", "prefix", "i", "j", "side", "key", "fp")}
        change = np.zeros(len(held), bool)
        for k in ("turn", "prefix", "i", "j"):
            change[1:] |= column[k][1:] != column[k][:-1]
        first = np.concatenate([[0], np.flatnonzero(change)])
        last = np.append(first[1:], len(held))
        right = np.concatenate([[0], np.cumsum(column["side"], dtype=np.int64)])
        middle = last - (right[last] - right[first])
        own = column["i"][first] == column["j"][first]
        nodes = np.column_stack([first, np.where(own, last, middle), np.where(own, first, middle), last])
        fp, root = column["fp"], np.arange(len(held))
        for a, b in TrieJoin(column["key"].view(np.uint64), budget).walk(nodes, prefix):
            _hook(root, a, b)
        leaf = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_pydict({"a": fp[leaf], "b": fp[root[leaf]]})

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        rest.append(batch)
        if sum(map(len, rest)) < hold:
            continue
        held = pa.Table.from_batches(rest)
        tail = [held[k].to_numpy() for k in ("turn", "prefix", "i", "j")]
        same = np.logical_and.reduce([x == x[-1] for x in tail])
        cut = len(held) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield solve(held.slice(0, cut))
        rest = held.slice(cut).to_batches()
    if rest and sum(map(len, rest)):
        yield solve(pa.Table.from_batches(rest))


def fingerprint_links(fingerprints: DataFrame, budget: int = 2) -> DataFrame:
    """Links ``a``, ``b`` (columns of longs) that connect all fingerprints of column ``fp`` that are
    at most ``budget`` bits apart. Only a spanning set of each task's links is returned.

    The bits fall into ``budget + 1`` blocks, so two near fingerprints agree in one whole block.
    Each turn brings one block to the front; its value is the trie node at which the walk starts,
    and rows meet by that node alone. Nodes of more than ``BLOCK`` fingerprints are cut into blocks
    that meet in pairs, so no task holds a whole node.
    """
    blocks = budget + 1
    edges = [64 * k // blocks for k in range(blocks)]
    prefix = 64 // blocks
    fp = F.col("fp")
    turned = [
        F.struct(
            F.lit(k).alias("turn"),
            (F.shiftleft(fp, e).bitwiseOR(F.shiftrightunsigned(fp, 64 - e)) if e else fp).alias("key"),
        )
        for k, e in enumerate(edges)
    ]
    rows = (
        fingerprints.where("fp is not null").select("fp").distinct()
        .select("fp", F.inline(F.array(*turned)))
        .withColumn("prefix", F.shiftrightunsigned("key", 64 - prefix))
    )
    sizes = rows.groupBy("turn", "prefix").agg(F.count("*").alias("n")).where("n > 1")
    rows = (
        rows.join(sizes, ["turn", "prefix"])
        .withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "turn", "prefix", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            F.col("key").bitwiseXOR(F.lit(-(1 << 63))).alias("order"), "key", "fp",
        )
        .repartition("turn", "prefix", "i", "j")
        .sortWithinPartitions("turn", "prefix", "i", "j", "side", "order")
    )
    return rows.mapInArrow(lambda it: _links(it, prefix, budget, 1 << 17), "a long, b long")


def simhash_components(docs: DataFrame, budget: int = 2) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Texts: null and empty give fingerprint zero, fewer than three words one shingle of all words.
    Rows link when their fingerprints differ in at most ``budget`` bits; ``component_id`` is the least
    ``doc_id`` reachable (null ids are passed over; null if all are). Repeated rows are each
    returned. An empty table gives an empty result, other columns are ignored.
    """
    slim = stage(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "fingerprints")
    return slim.join(components_by_fingerprint(slim, budget), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def components_by_fingerprint(slim: DataFrame, budget: int = 2) -> DataFrame:
    """``fp``, ``component`` (a fingerprint) and ``component_id`` (least ``doc_id``) per fingerprint."""
    least = slim.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = connected_components(fingerprint_links(slim, budget)).withColumnRenamed("node", "fp")
    own = stage(
        least.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "components"
    )
    ids = own.groupBy("component").agg(F.min("least").alias("component_id"))
    return own.select("fp", "component").join(ids, "component")


def one_of_each_group(docs: DataFrame, budget: int = 2) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the one with the least ``doc_id``.

    A row without id stays only if its group has none with one; of rows with one id in a group one
    stays. Rows that share an id but are not near copies are different documents. All columns are
    kept. The rows are written to the shared folder with a number each, so that the choice holds
    when a task runs again.
    """
    names = [f"_{k}_of_{len(docs.columns)}" for k in ("print", "row")]
    while set(names) & set(docs.columns):
        names = [f"_{n}" for n in names]
    fp, row = names
    held = stage(docs.withColumn(fp, fingerprint(F.col("text"))).withColumn(row, F.monotonically_increasing_id()), "rows")
    slim = held.select("doc_id", F.col(fp).alias("fp"), F.col(row).alias("row"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row").alias("row"))
    chosen = (
        slim.join(components_by_fingerprint(slim, budget).select("fp", "component"), "fp")
        .groupBy("component").agg(F.min(order)["row"].alias(row))
    )
    return held.join(chosen.select(row), row, "left_semi").select(docs.columns)
