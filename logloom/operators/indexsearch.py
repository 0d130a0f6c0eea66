"""Search, pages and counts answered from the word index.

The words of a filter are read from their buckets of the index only. Each matching word says which
word or phrase of the filter it may be part of; grouped by row, the filter's AND, OR and NOT are
decided on that short list. The rows themselves are read for the days that hold such rows, newest
first, until a page is full. The index must hold the rows of the store (``fan_out`` feeds both).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from ..session import join_dimension, stage
from .filters import LogFilter, all_of, any_of, matching, none_of, resolve_bound
from .search import after_cursor, decode_cursor, newest_first, page_with_cursor
from .textindex import BUCKET, token_bucket
from .textquery import AllOf, Leaf, NoneOf, Phrase, Term, TextQuery

DAY = "log_date"


def text_of(spec: LogFilter) -> AllOf:
    """The part of a filter that words decide."""
    parts: list[TextQuery] = [*[Term(t) for t in spec.terms], *[Phrase(p) for p in spec.phrases]]
    if spec.not_terms:
        parts.append(NoneOf(*[Term(t) for t in spec.not_terms]))
    return AllOf(*parts, *([spec.text] if spec.text is not None else []))


def rest_of(spec: LogFilter) -> LogFilter:
    """The part of a filter that the rows decide."""
    return replace(spec, terms=[], phrases=[], not_terms=[], text=None)


def _spots(leaves: list[Leaf]) -> list[tuple[int, int, str, bool, tuple[str, ...]]]:
    """Leaf, place in it, word, whether it may be a beginning, and fields of every word looked up."""
    return [
        (k, i, word, leaf.open_end and i == len(leaf.words) - 1, leaf.fields)
        for k, leaf in enumerate(leaves)
        for i, word in enumerate(leaf.words)
    ]


def _bucket_of(word: str, prefix: bool, buckets: int) -> Column | None:
    return None if prefix and len(word) < 3 else token_bucket(F.lit(word), buckets)


def rows_by_words(postings: DataFrame, query: TextQuery, buckets: int = 256) -> DataFrame:
    """Keys (``log_date`` if the index has it, ``log_id``) of the rows that hold some of the words, and
    whether they fulfil the query. One scan of the words' buckets, one shuffle of the postings met."""
    leaves = query.leaves()
    spots = _spots(leaves)
    keys = [c for c in (DAY, "log_id") if c in postings.columns]
    met = [
        (F.col("token").startswith(word) if prefix else F.col("token") == word) & F.col("field").isin(*fields)
        for _, _, word, prefix, fields in spots
    ]
    read = postings
    wanted = [_bucket_of(word, prefix, buckets) for _, _, word, prefix, _ in spots]
    if BUCKET in postings.columns and wanted and all(w is not None for w in wanted):
        read = read.filter(F.col(BUCKET).isin(*wanted))
    hits = [
        F.when(cond, F.struct(F.lit(k).alias("leaf"), (F.col("pos") - i).alias("start"), F.lit(i).alias("i")))
        for cond, (k, i, *_) in zip(met, spots, strict=True)
    ]
    sizes = F.array(*[F.lit(len(leaf.words)) for leaf in leaves])
    return (
        read.filter(any_of(*met))
        .select(*keys, "field", F.inline(F.array_compact(F.array(*hits))))
        .repartition(*keys)
        .groupBy(*keys, "field", "leaf", "start").agg(F.size(F.collect_set("i")).alias("n"))
        .filter(F.col("n") == F.get(sizes, F.col("leaf")))
        .groupBy(*keys).agg(F.collect_set("leaf").alias("found"))
        .select(*keys, _decided(query, leaves).alias("fulfils"))
    )


def _decided(query: TextQuery, leaves: list[Leaf]) -> Column:
    def leaf(x: Leaf) -> Column:
        return F.array_contains("found", leaves.index(x)) if x.words else F.lit(True)

    return query.holds(leaf, lambda c: all_of(*c), lambda c: any_of(*c), lambda c: none_of(*c))


def _by_words(logs: DataFrame, postings: DataFrame, query: TextQuery, buckets: int) -> DataFrame:
    """The rows that fulfil a text query; rows without any of its words are read only if they may."""
    if not any(leaf.words for leaf in query.leaves()):
        return logs if query.true_without_words() else logs.limit(0)
    without = query.true_without_words()
    decided = rows_by_words(postings, query, buckets)
    listed = decided.filter(~F.col("fulfils") if without else F.col("fulfils")).drop("fulfils").withColumnRenamed("log_id", "id")
    on = [c for c in (DAY, "id") if c in listed.columns and c in logs.columns]
    return join_dimension(logs, stage(listed.select(*on), "by-words"), on, "left_anti" if without else "left_semi").select(*logs.columns)


def _days(postings: DataFrame, spec: LogFilter) -> list[dt.date]:
    """The days of the index within a filter's bounds, newest first."""
    as_of = spec.as_of or dt.datetime.now(dt.timezone.utc)
    low, high = (resolve_bound(x, as_of, spec.tz) for x in (spec.start, spec.end))
    found = [r[0] for r in postings.select(DAY).distinct().collect()]
    return sorted((d for d in found if (not low or d >= low.date()) and (not high or d <= high.date())), reverse=True)


def _newest(logs: DataFrame, postings: DataFrame, spec: LogFilter, wanted: int, buckets: int, below: Column | None = None, until: dt.date | None = None) -> DataFrame:
    """The newest rows of a filter, opening days from the newest on, twice as many each time."""
    query, rest = text_of(spec), rest_of(spec)

    def some(rows: DataFrame, words: DataFrame) -> DataFrame:
        found = matching(rows, rest)
        found = found.filter(below) if below is not None else found
        return _by_words(found, words, query, buckets).orderBy(*newest_first())

    if DAY not in postings.columns or DAY not in logs.columns or query.true_without_words():
        return some(logs, postings).limit(wanted)
    days = [d for d in _days(postings, spec) if until is None or d <= until]
    page, held, at, width = logs.limit(0), 0, 0, 1
    while at < len(days) and held < wanted:
        chunk = days[at : at + width]
        bound = F.col(DAY).between(F.lit(chunk[-1]), F.lit(chunk[0]))
        part = stage(some(logs.filter(bound), postings.filter(bound)).limit(wanted - held), "page")
        held += part.count()
        page = page.union(part.select(*logs.columns))
        at, width = at + width, width * 2
    return page


def search_by_index(
    logs: DataFrame, postings: DataFrame, spec: LogFilter, limit: int = 100, offset: int = 0, buckets: int = 256
) -> DataFrame:
    """``search`` with the words of the filter answered by the index."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1 to 1000 and offset not negative")
    page = _newest(logs, postings, spec, offset + limit, buckets).orderBy(*newest_first())
    return (page.offset(offset) if offset else page).limit(limit)


def search_after_by_index(
    logs: DataFrame, postings: DataFrame, spec: LogFilter, cursor: str | tuple[int, int] | None = None, limit: int = 100,
    buckets: int = 256,
) -> DataFrame:
    """``search_after`` with the words of the filter answered by the index."""
    position = decode_cursor(cursor) if isinstance(cursor, str) else cursor
    if position is None:
        return page_with_cursor(_newest(logs, postings, spec, limit + 1, buckets), limit)
    until = (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=position[0])).date()
    return page_with_cursor(_newest(logs, postings, spec, limit + 1, buckets, after_cursor(position), until), limit)


def matching_by_index(logs: DataFrame, postings: DataFrame, spec: LogFilter, buckets: int = 256) -> DataFrame:
    """All rows of a filter, its words answered by the index."""
    return _by_words(matching(logs, rest_of(spec)), postings, text_of(spec), buckets)


def count_by_index(logs: DataFrame, postings: DataFrame, spec: LogFilter, buckets: int = 256) -> DataFrame:
    """The exact number of matching rows. A filter of words alone is counted in the index, without a row read."""
    query, n = text_of(spec), F.count(F.lit(1)).alias("total")
    if rest_of(spec).is_empty() and any(leaf.words for leaf in query.leaves()) and not query.true_without_words():
        return rows_by_words(postings, query, buckets).filter("fulfils").agg(n)
    return matching_by_index(logs, postings, spec, buckets).agg(n)
