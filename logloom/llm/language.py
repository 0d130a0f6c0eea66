"""Language identification by Bloom filters whose slots hold one bit per language."""

from __future__ import annotations

import pickle
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import join_dimension
from .shared import SLICE_BYTES, id_remainder, slices, stage, text_binary

# Rows of each language that are learnt from, about as many at most (taken by a hash of the id),
# and the longest text among them, in bytes.
SAMPLE_ROWS = 1500
SAMPLE_BYTES = 200_000
SAMPLE_TOTAL = 24 << 20
# Languages of one plane of slots (any number of planes is built); slots; hash functions.
MAX_LANGUAGES = 64
SLOT_BITS = 20
HASHES = 3
# An n-gram belongs to a language if its rate there is at least this share of its highest rate, and
# it was seen this often.
SHARE = 0.4
LEAST = 3

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """The lower-case letter or combining mark of every code point, 32 (between words) for any other;
    and which code points are letters."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    letter = np.zeros(sys.maxunicode + 1, bool)
    for point in range(sys.maxunicode + 1):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 else point
            letter[point] = True
        elif unicodedata.category(char) == "Mn":
            table[point] = point
    return table, letter


def ngrams(points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letter n-grams (three, four and five characters, hashed) of some texts.

    ``points`` are the code points of all texts in turn, ``first`` the n + 1 places where texts begin.
    Returns the n-grams, the text of each, and whether each text has a letter (a combining mark
    alone is none). Every run of characters that are no letters or marks is one space, and texts begin and end with one; n-grams lie
    within a word with its two spaces.
    """
    n = len(first) - 1
    mapped = np.full(len(points) + n + 1, 32, np.uint32)
    row = np.repeat(np.arange(n), np.diff(first))
    table, letter = _letters()
    mapped[np.arange(len(points)) + row + 1] = table[points]
    owner = np.zeros(len(mapped), np.int64)
    owner[np.arange(len(points)) + row + 1] = row
    owner[first[1:] + np.arange(1, n + 1)] = np.arange(n)
    space = mapped == 32
    keep = np.ones(len(mapped), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    mapped, owner, space = mapped[keep].astype(np.uint64), owner[keep], space[keep]
    lettered = np.zeros(n, bool)
    lettered[row[letter[points]]] = True
    found, owners = [], []
    code = mapped.copy()
    for k in range(1, 5):
        code = code[:-1] * np.uint64(0x100000001B3) ^ mapped[k:] * np.uint64(_MIX[3])
        if k < 2:
            continue
        inner = np.zeros(len(code), bool)
        for j in range(1, k):
            inner |= space[j : len(space) - k + j]
        good = ~inner
        found.append((code[good] + np.uint64(k)) * np.uint64(_MIX[0]))
        owners.append(owner[1:][: len(code)][good])
    return np.concatenate(found), np.concatenate(owners), lettered


def code_points(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    decoded = [t.decode("utf-8", "replace") for t in texts]
    first = np.concatenate([[0], np.cumsum([len(t) for t in decoded], dtype=np.int64)]).astype(np.int64)
    return np.frombuffer("".join(decoded).encode("utf-32-le", "surrogatepass"), np.uint32), first


@dataclass
class Filters:
    """Slots of language bits: a language holds an n-gram if its bit is set in all slots hashed to.

    Each ``MAX_LANGUAGES`` languages in turn have an array of slots, a plane.
    """

    languages: list[str]
    slots: list[np.ndarray]
    false_rate: np.ndarray

    @staticmethod
    def places(grams: np.ndarray) -> list[np.ndarray]:
        return [((grams ^ (grams >> np.uint64(29))) * np.uint64(m) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for m in _MIX[1 : 1 + HASHES]]

    @classmethod
    def build(cls, languages: list[str], members: list[np.ndarray]) -> Filters:
        planes, filled = [], []
        for low in range(0, max(len(languages), 1), MAX_LANGUAGES):
            part = members[low : low + MAX_LANGUAGES]
            kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(k).bits >= len(part))
            slots = np.zeros(1 << SLOT_BITS, kind)
            for bit, grams in enumerate(part):
                for place in cls.places(grams):
                    slots[place] |= kind(1 << bit)
            filled += [np.mean((slots >> kind(b)) & kind(1)) for b in range(len(part))]
            planes.append(slots)
        return cls(languages, planes, np.array(filled) ** HASHES)

    def holders(self, grams: np.ndarray, plane: int = 0) -> np.ndarray:
        """The languages of a plane that hold each n-gram, as bits: one AND over its slots answers for all."""
        first, *rest = self.places(grams)
        bits = self.slots[plane][first]
        for place in rest:
            bits = bits & self.slots[plane][place]
        return bits

    def counts(self, grams: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Expected true hits, text x language: hits less the false ones that the fill implies."""
        total = np.bincount(owner, minlength=n)
        out = np.zeros((n, len(self.languages)))
        for k, rate in enumerate(self.false_rate):
            plane, b = divmod(k, MAX_LANGUAGES)
            if not b:
                bits, kind = self.holders(grams, plane), self.slots[plane].dtype.type
            hits = np.bincount(owner, (bits >> kind(b)) & kind(1), n)
            out[:, k] = np.maximum(hits - rate * total, 0) / (1 - rate)
        return out


def _counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of some texts and their counts, gathered slice by slice."""
    grams, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.array([len(t) for t in texts], np.int64))])
    for i, j in slices(offsets):
        new, n = np.unique(ngrams(*code_points(texts[i:j]))[0], return_counts=True)
        grams, at = np.unique(np.concatenate([grams, new]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), len(grams)).astype(np.int64)
    return grams, counts


def fit(texts: dict[str, list[bytes]]) -> Filters:
    """The filters of each language's n-grams, from sample texts per language."""
    languages = sorted(texts)
    seen = []
    for language in languages:
        grams, n = _counted(texts[language])
        seen.append((grams[n >= LEAST], n[n >= LEAST] / max(n.sum(), 1)))
    every = np.unique(np.concatenate([g for g, _ in seen])) if seen else np.zeros(0, np.uint64)
    best = np.zeros(len(every))
    at = [np.searchsorted(every, grams) for grams, _ in seen]
    for place, (_, rate) in zip(at, seen, strict=True):
        best[place] = np.maximum(best[place], rate)
    return Filters.build(languages, [grams[rate >= SHARE * best[place]] for place, (grams, rate) in zip(at, seen, strict=True)])


def sample(docs: DataFrame) -> DataFrame:
    """``lang, text`` of a bounded number of rows of each language whose id is not held out.

    Of the ids drawn, every row is a candidate, but by a hash of the row at most ``SAMPLE_ROWS`` and a quarter
    of each language and ``SAMPLE_TOTAL`` bytes are taken, however often an id repeats.
    """
    known = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder(F.col("doc_id"), 3) != 1)
    )
    sizes = stage(known.groupBy("lang").agg(F.count("*").alias("_rows")), "languages")
    share = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) / float(1 << 30)
    sized = join_dimension(known.where(F.octet_length("text") <= SAMPLE_BYTES), sizes, ["lang"], "inner")
    rows = sized.where(share < F.least(F.lit(1.0), F.lit(SAMPLE_ROWS) / F.col("_rows")))
    # Spark cuts to the limit of each language before the shuffle
    order = Window.partitionBy("lang").orderBy("_place", "doc_id")
    rows = rows.withColumn("_place", F.xxhash64("doc_id", "text")).withColumn("_number", F.row_number().over(order))
    rows = rows.where(F.col("_number") <= SAMPLE_ROWS * 5 // 4).withColumn(
        "_bytes", F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).where(F.col("_bytes") <= SAMPLE_TOTAL)
    return rows.select("lang", text_binary(F.col("text")).alias("text")).unionByName(sizes.select("lang", F.lit(None).cast("binary").alias("text")))


def learn(docs: DataFrame) -> Filters:
    """Filters from the sample of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[bytes]] = {}
        for batch in batches:
            for lang, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                texts.setdefault(lang, []).extend([] if text is None else [text])
        yield pa.RecordBatch.from_pydict({"filters": pa.array([pickle.dumps(fit(texts))], pa.binary())})

    # One task fits the bounded sample, so that the driver holds the finished filters only.
    found = sample(docs).repartition(1).mapInArrow(run, "filters binary").first()
    return pickle.loads(found[0]) if found else fit({})


def predict(text: Column, filters: Filters) -> Column:
    """``lang_pred`` and ``score`` of whole texts."""

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        held: list[bytes] = []

        def flush() -> None:
            if not held:
                return
            points, first = code_points(held)
            grams, owner, lettered = ngrams(points, first)
            counts = filters.counts(grams, owner, len(held)) if filters.languages else np.zeros((len(held), 0))
            total = counts.sum(axis=1)
            for k in range(len(held)):
                if not lettered[k] or not filters.languages:
                    names.append("und")
                    scores.append(0.0)
                else:
                    best = int(counts[k].argmax())
                    names.append(filters.languages[best])
                    scores.append(float(counts[k, best] / total[k]) if total[k] > 0 else 0.0)
            held.clear()

        size = 0
        for text in texts:
            held.append(text.as_buffer().to_pybytes())
            size += len(held[-1])
            if size >= SLICE_BYTES:
                flush()
                size = 0
        flush()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return run(text_binary(text))


def languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.

    ``und`` with score 0 for a null text or one without a letter, and for every text if no row has a
    language to learn from. A text with letters but no known n-gram gets the first language, score 0.
    A null id counts as held out; repeated rows are each returned; an empty table gives an
    empty result.
    """
    found = predict(F.col("text"), learn(docs))
    return docs.select(
        "doc_id", F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(True)).alias("held_out"), found.alias("_found")
    ).select("doc_id", "held_out", "_found.lang_pred", "_found.score")
