"""How document filters interact: a sparse document-term matrix decides, flags are counted in all orders."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import join_dimension
from .shared import slices, stage

FILTERS = "ABCDE"
MIN_WORDS = 200
# Filter B: distinct words in a hundred words; filter C: capital letters in a hundred code points.
MIN_DISTINCT = 50
MAX_CAPITALS = 3
MARKS = "[#$%&*|]"
# Bytes of text of one CSR shard (a longer text is one alone), and words that a task holds before it hands them on.
SLICE_BYTES = 8 << 20
HELD_WORDS = 1 << 20

_ROW = "struct<doc_id:bigint,lang:string,capital:boolean,marked:boolean,digest:binary>"
MATRIX = f"rows array<{_ROW}>, indptr array<bigint>, indices array<bigint>, data array<bigint>"


def codes(words: pa.Array, seed: int, bits: int = 64) -> np.ndarray:
    """The first ``bits`` bits of each word's hash as signed numbers."""
    found = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()), np.uint64, len(words))
    return (found >> np.uint64(64 - bits)).view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of rows of about ``SLICE_BYTES`` of text, with the list of words of each; the text is the last column."""
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        offsets = np.concatenate([[0], np.cumsum(pc.binary_length(text).to_numpy().astype(np.int64))])
        for first, last in slices(offsets, SLICE_BYTES):
            # ASCII white space is what ends a word; words of no length lie beside it at the ends of a text.
            yield batch.slice(first, last - first), pc.ascii_split_whitespace(text.slice(first, last - first))


def _vocabulary(batches: Iterator[pa.RecordBatch], seed: int, bits: int) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        words = held.filter(pc.greater(pc.binary_length(held), 0))
        return pa.RecordBatch.from_arrays([pa.array(codes(words, seed, bits)), words], ["code", "word"])

    held = pa.array([], pa.string())
    for _, words in _slices(batches):
        held = pc.unique(pa.concat_arrays([held, pc.unique(words.flatten()).cast(pa.string())]))
        if len(held) >= HELD_WORDS:
            yield out()
            held = held.slice(0, 0)
    yield out()


def word_dictionary(docs: DataFrame, bits: int = 64) -> tuple[DataFrame, int]:
    """``code, word`` of every distinct word of all texts, and the seed of the codes.

    A word's code is its 64-bit hash, so every task can encode alone and no task holds the
    dictionary. Codes are checked over all words: if two words share one, the next seed is taken.
    """
    texts = docs.select(_text())
    seed = 0
    while True:
        found = texts.mapInArrow(lambda it, s=seed: _vocabulary(it, s, bits), "code long, word string")
        words = stage(found.distinct(), "words")
        if words.groupBy("code").count().where("count > 1").isEmpty():
            return words, seed
        seed += 1


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")


def _shards(batches: Iterator[pa.RecordBatch], seed: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch, words in _slices(batches):
        encoded = words.flatten().dictionary_encode()
        names = encoded.dictionary
        row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy())
        entry = row * len(names) + encoded.indices.to_numpy()
        if (empty := pc.index(names, "").as_py()) >= 0:
            entry = entry[encoded.indices.to_numpy() != empty]
        entry.sort()
        first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])[: len(entry)])
        rows, columns = np.divmod(entry[first], max(len(names), 1))
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        yield pa.RecordBatch.from_arrays(
            [
                one(batch.column(0)), one(pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)))),
                one(pa.array(codes(names, seed, bits)[columns])), one(pa.array(np.diff(first, append=len(entry)))),
            ],
            ["rows", "indptr", "indices", "data"],
        )


def term_matrix(docs: DataFrame, seed: int, bits: int = 64) -> DataFrame:
    """CSR shards of the document-term matrix, each of whole rows of ``docs`` with about ``SLICE_BYTES`` of text.

    Row ``i`` of a shard has the word codes ``indices[indptr[i]:indptr[i + 1]]`` and their counts at
    the same places of ``data``. ``rows`` holds, per row, ``doc_id``, ``lang``, the conditions C
    (``capital``) and D (``marked``), and the SHA-256 of the text.
    """
    text = _text()
    row = F.struct(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        (100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITALS * F.length(text)).alias("capital"),
        text.rlike(MARKS).alias("marked"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )
    return docs.select(row.alias("row"), text).mapInArrow(lambda it: _shards(it, seed, bits), MATRIX)


def matrix_rows(matrix: DataFrame) -> DataFrame:
    """Per matrix row its fields, ``words`` (row sum) and ``distinct`` (entries that are not zero)."""
    sums = F.expr(
        "transform(rows, (r, i) -> struct(r as r, indptr[i + 1] - indptr[i] as distinct, aggregate("
        "slice(data, cast(indptr[i] + 1 as int), cast(indptr[i + 1] - indptr[i] as int)), 0L, (a, x) -> a + x) as words))"
    )
    return matrix.select(F.inline(sums)).select("r.*", "words", "distinct")


def audit(flags: DataFrame) -> DataFrame:
    """The audit of all orders from ``part``, ``mask`` (bit k: fails filter k), ``n``, ``good``, ``toxic``.

    ``flags`` holds one row per part and mask; the result 120 orders of 5 steps per part.
    """
    masks = range(1 << len(FILTERS))
    of = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))  # one entry per mask
    parts = flags.groupBy("part").agg(of.alias("of"))
    zero = "named_struct('n', 0L, 'good', 0L, 'toxic', 0L)"
    dense = parts.select("part", F.expr(f"transform(sequence(0, {masks[-1]}), m -> struct(m as m, coalesce(try_element_at(of, m), {zero}) as c))").alias("cells"))
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            steps.append({"filter_order": "".join(FILTERS[x] for x in order), "step": k + 1, "before": before, "own": 1 << f})
            before |= 1 << f
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,before:int,own:int>>")
    rows = dense.select("part", "cells", F.inline(plan))
    # A failing document is removed by each of its k failing filters in 1 / k of the orders.
    shares = "array(" + ", ".join(str(math.factorial(len(FILTERS)) // max(m.bit_count(), 1)) for m in masks) + ")"

    def total(value: str, keep: str) -> Column:
        return F.expr(f"aggregate(cells, 0L, (a, x) -> a + if({keep}, {value}, 0L))")

    clear, fails = "(x.m & before) = 0", "(x.m & own) <> 0"
    return rows.select(
        "part", "filter_order", "step",
        total("x.c.n", f"{clear} and not {fails}").alias("kept"),
        total("x.c.n", f"{clear} and {fails}").alias("removed"),
        total("x.c.n", f"not {clear} and {fails}").alias("redundant"),
        total("x.c.n", "x.m = own").alias("unique_fails"),
        total("x.c.good", f"{clear} and {fails}").alias("good_lost"),
        total("x.c.toxic", f"{clear} and {fails}").alias("toxic_lost"),
        total(f"x.c.n * get({shares}, x.m)", fails).alias("shapley"),
    )


def filter_flags(docs: DataFrame, labels: DataFrame, bits: int = 64) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by language and by the filters they fail.

    Bit k of ``mask`` is filter k of ``ABCDE``. Texts that are null are empty, a null ``lang`` is the
    part of the empty string. A document fails E if a smaller ``doc_id`` has the same text: rows that
    repeat the least id do not, rows without id neither fail nor make others fail. Every row counts, so
    repeated rows count each; an id with several labels is good (toxic) if one of them says so. Rows
    of a text are counted per id before they meet, so a group of copies of any size is spread.
    """
    _, seed = word_dictionary(docs, bits)
    rows = stage(
        matrix_rows(term_matrix(docs, seed, bits)).select(
            "doc_id", "digest", F.col("lang").alias("part"),
            (
                (F.col("words") < MIN_WORDS).cast("int")
                + 2 * (100 * F.col("distinct") < MIN_DISTINCT * F.col("words")).cast("int")
                + 4 * F.col("capital").cast("int")
                + 8 * F.col("marked").cast("int")
            ).alias("own"),
        ),
        "rows",
    )
    counted = rows.groupBy("doc_id", "digest", "part", "own").agg(F.count("*").alias("n"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    marked = join_dimension(
        counted.join(first, ["doc_id", "digest"], "left").withColumn("copy", F.col("first").isNull() & F.col("doc_id").isNotNull()),
        known.where("doc_id is not null"), ["doc_id"],
    )
    count = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    return marked.groupBy("part", (F.col("own") + 16 * F.col("copy").cast("int")).alias("mask")).agg(
        count("good"), count("toxic"), F.sum("n").alias("n")
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``documents``; an empty table has no parts and so no rows. Other columns are ignored."""
    return audit(filter_flags(docs, labels))


_WORDS = r"list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE = rf"""
with docs as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
known as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
  from labels where doc_id is not null group by doc_id),
worded as (select *, {_WORDS} as words, min(doc_id) over (partition by text) as least from docs),
flagged as (select d.part, coalesce(k.good, 0) as good, coalesce(k.toxic, 0) as toxic,
    (len(words) < {MIN_WORDS})::int + 2 * (100 * len(list_distinct(words)) < {MIN_DISTINCT} * len(words))::int
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(text))::int
    + 8 * regexp_matches(text, '{MARKS}')::int + 16 * coalesce(d.doc_id > least, false)::int as mask
  from worded d left join known k on k.doc_id = d.doc_id),
cells as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic, bit_count(mask) as fails from flagged group by part, mask),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as c, unnest([1, 2, 4, 8, 16]) as b),
orders as (select a.c || b.c || c.c || d.c || e.c as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits
  from letters a, letters b, letters c, letters d, letters e
  where a.b + b.b + c.b + d.b + e.b = 31 and len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps as (select filter_order, step::int as step, bits[step] as f, coalesce(list_sum(bits[1:step - 1]), 0)::int as before
  from orders, unnest([1, 2, 3, 4, 5]) as s(step))
select part, filter_order, step,
  coalesce(sum(n) filter (mask & (before | f) = 0), 0)::bigint as kept,
  coalesce(sum(n) filter (mask & before = 0 and mask & f <> 0), 0)::bigint as removed,
  coalesce(sum(n) filter (mask & before <> 0 and mask & f <> 0), 0)::bigint as redundant,
  coalesce(sum(n) filter (mask = f), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (mask & before = 0 and mask & f <> 0), 0)::bigint as good_lost,
  coalesce(sum(toxic) filter (mask & before = 0 and mask & f <> 0), 0)::bigint as toxic_lost,
  coalesce(sum(n * 120 // greatest(fails, 1)) filter (mask & f <> 0), 0)::bigint as shapley
from cells, steps group by part, filter_order, step
"""
