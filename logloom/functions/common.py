"""Small Column helpers shared by the function modules."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Whitespace trimmed from both ends of text fields.
BLANKS = " \t\n\r\x0b\x0c"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(BLANKS))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body reads it.

    Without it a fold of n steps that each read their input k times grows to k**n nodes.
    """
    return F.get(F.transform(F.array(value), body), 0)


def lookup(table: dict, key: Column) -> Column:
    """The literal table's value for the key, or null."""
    return F.try_element_at(F.expr(_map_text(tuple(table.items()))), key)


@lru_cache(maxsize=64)
def _map_text(items: tuple) -> str:
    """A literal map as SQL text: one expression to hand over instead of one per entry."""

    def text(v) -> str:
        return str(v) if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"

    return "map(" + ", ".join(text(v) for pair in items for v in pair) + ")"


def group_or_null(c: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, or null (not '') when the pattern does not match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def contains_any(c: Column, needles) -> Column:
    hit = F.lit(False)
    for n in needles:
        hit = hit | c.contains(n)
    return hit
