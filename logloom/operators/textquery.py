"""Words, phrases and their combinations, for a scan of the rows and for a word index alike."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column

from ..functions import fixed
from ..functions.text import term_words
from .filters import FIELD_NAMES, SEARCH_FIELDS, all_of, any_of, has_phrase, has_term, none_of


class TextQuery(ABC):
    """A condition on the words of a row's app, alias and message."""

    @abstractmethod
    def condition(self, live: bool = False) -> Column:
        """The condition as a Column over log rows."""

    @abstractmethod
    def leaves(self) -> list[Leaf]:
        """The words and phrases it is made of."""

    @abstractmethod
    def holds(self, leaf: Callable[[Leaf], Any], every: Callable, some: Callable, none: Callable) -> Any:
        """Its value from that of each leaf, by the given meanings of and, or, and none of."""

    def true_without_words(self) -> bool:
        """Whether rows that hold none of its words fulfil it, so that an index cannot list them."""
        return self.holds(lambda x: not x.words, all, any, lambda found: not any(found))


@dataclass(frozen=True)
class Leaf(TextQuery):
    text: str
    field: str | None = None

    @property
    def words(self) -> list[str]:
        return term_words(self.text)

    @property
    def open_end(self) -> bool:
        """Whether the last word may be the start of a longer one."""
        return False

    @property
    def fields(self) -> tuple[str, ...]:
        return SEARCH_FIELDS if self.field is None else FIELD_NAMES[self.field.lower()]

    def leaves(self) -> list[Leaf]:
        return [self]

    def holds(self, leaf, every, some, none):
        return leaf(self)


@dataclass(frozen=True)
class Term(Leaf):
    """A term by the rules of ``has_term``."""

    @property
    def open_end(self) -> bool:
        return self.text.endswith("*") or len(self.text) >= fixed.TERM_PREFIX_MIN_CHARS

    def condition(self, live: bool = False) -> Column:
        return has_term(self.text, self.field, live)


@dataclass(frozen=True)
class Phrase(Leaf):
    """Words in a row by the rules of ``has_phrase``."""

    prefix: bool = False

    @property
    def open_end(self) -> bool:
        return self.prefix

    def condition(self, live: bool = False) -> Column:
        return has_phrase(self.text, self.field, live, self.prefix)


class _Group(TextQuery):
    def __init__(self, *parts: TextQuery):
        self.parts = parts

    def leaves(self) -> list[Leaf]:
        return list(dict.fromkeys(leaf for part in self.parts for leaf in part.leaves()))


class AllOf(_Group):
    def condition(self, live: bool = False) -> Column:
        return all_of(*[p.condition(live) for p in self.parts])

    def holds(self, leaf, every, some, none):
        return every([p.holds(leaf, every, some, none) for p in self.parts])


class AnyOf(_Group):
    def condition(self, live: bool = False) -> Column:
        return any_of(*[p.condition(live) for p in self.parts])

    def holds(self, leaf, every, some, none):
        return some([p.holds(leaf, every, some, none) for p in self.parts])


class NoneOf(_Group):
    def condition(self, live: bool = False) -> Column:
        return none_of(*[p.condition(live) for p in self.parts])

    def holds(self, leaf, every, some, none):
        return none([p.holds(leaf, every, some, none) for p in self.parts])
