"""Secrets by fixed patterns, and by two character Markov models compared on long tokens."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import byte_ranges, slices, text_binary

# Rows whose tokens the models learn from, about as many at most (taken by a hash of the text).
SAMPLE_ROWS = 20_000
# A token is a run of token characters of at least this length; ordinary words teach from a shorter one.
TOKEN_LENGTH = 16
WORD_LENGTH = 8
# A token is a secret if random beats ordinary by this log-likelihood ratio in all and per character.
RATIO = 12.0
RATIO_PER_CHARACTER = 0.5

# The kinds and their patterns; least lengths are of the value, the match and the match.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
ASSIGN_LEAST = 12
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX_LEAST = 16

_SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CLASS = np.full(256, -1, np.int64)
_CLASS[np.frombuffer(_SYMBOLS, np.uint8)] = np.arange(len(_SYMBOLS))
_HEX = np.zeros(256, bool)
_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True
_START = len(_SYMBOLS)


def _runs(member: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of member bytes within rows, of at least ``least`` bytes."""
    edge = np.zeros(len(member) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(member), bool), np.zeros(len(member), bool)
    before[1:], after[:-1] = member[:-1], member[1:]
    starts = np.flatnonzero(member & (~before | edge[:-1]))
    ends = np.flatnonzero(member & (~after | edge[1:])) + 1
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def base_spans(text: bytes, hexes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` in bytes of the fixed kinds; ``hexes`` are the long runs of hex digits.

    A run of hex digits is a match of its pattern, so runs are found without it; shorter matches
    are dropped either way.
    """
    found = [(s, e, 2) for s, e in hexes]
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return found


def _beside(tokens: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of the tokens that no base span covers, of any length; both are passed through once."""
    if not base:
        return tokens
    spans = sorted((a, b) for a, b, _ in base)
    found, k, over = [], 0, 0  # ``over``: the end of the base spans that begin before the place
    for s, e in tokens:
        at = s
        while k < len(spans) and spans[k][0] < e:
            a, b = spans[k]
            at = max(at, over)
            if a > at:
                found.append((at, a))
            over, k = max(over, b), k + 1
        at = max(at, over)
        if at < e:
            found.append((at, e))
    return found


def scan(texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int]]]]:
    """Per text, the base spans and the long tokens, or their parts, beside them, in bytes."""
    offsets = np.concatenate([[0], np.cumsum(np.array([len(t) for t in texts], np.int64))])
    for i, j in slices(offsets):
        data, at = np.frombuffer(b"".join(texts[i:j]), np.uint8), offsets[i : j + 1] - offsets[i]
        hexes: list[list[tuple[int, int]]] = [[] for _ in range(j - i)]
        tokens: list[list[tuple[int, int]]] = [[] for _ in range(j - i)]
        for member, least, into in ((_HEX[data], HEX_LEAST, hexes), (_CLASS[data] >= 0, TOKEN_LENGTH, tokens)):
            starts, ends, rows = _runs(member, at, least)
            for s, e, r in zip((starts - at[rows]).tolist(), (ends - at[rows]).tolist(), rows.tolist(), strict=True):
                into[r].append((s, e))
        for k in range(j - i):
            base = base_spans(texts[i + k], hexes[k])
            yield base, _beside(tokens[k], base)


@dataclass
class Markov:
    """The log-likelihood ratio of each character after another, random over ordinary."""

    ratio: np.ndarray

    @classmethod
    def of(cls, random: np.ndarray, ordinary: np.ndarray) -> Markov:
        """From counts of characters by the one before. A fifth of the random model is uniform, so that
        it allows for alphabets the sample lacks; the ordinary one falls back on single characters."""
        size = len(_SYMBOLS)
        seen = (random + 1e-9) / (random + 1e-9).sum(axis=1, keepdims=True)
        chance = np.where(random.sum(axis=1, keepdims=True) > 0, 0.8 * seen + 0.2 / size, 1 / size)
        alone = (ordinary.sum(axis=0) + 0.05) / (ordinary.sum() + 0.05 * size)
        usual = (ordinary + 5 * alone) / (ordinary.sum(axis=1, keepdims=True) + 5)
        return cls(np.log(chance) - np.log(usual))

    def secret(self, token: bytes) -> bool:
        codes = _CLASS[np.frombuffer(token, np.uint8)]
        total = self.ratio[np.concatenate([[_START], codes[:-1]]), codes].sum()
        return bool(total >= RATIO and total >= RATIO_PER_CHARACTER * len(token))


def _transitions(texts: list[bytes]) -> np.ndarray:
    """Counts (label, character before, character): 1 for values of base spans, 0 for other tokens
    without a digit (those with digits may be random and are left unlabelled)."""
    counts = np.zeros((2, len(_SYMBOLS) + 1, len(_SYMBOLS)), np.int64)
    for text, (base, _) in zip(texts, scan(texts), strict=True):
        taken = np.zeros(len(text) + 1, bool)
        for s, e, kind in base:
            taken[s:e] = True
            value = ASSIGN.match(text[s:e])[2] if kind == 0 else text[s:e]
            codes = _CLASS[np.frombuffer(value, np.uint8)]
            codes = codes[codes >= 0]
            np.add.at(counts[1], (np.concatenate([[_START], codes[:-1]]), codes), 1)
        codes = _CLASS[np.frombuffer(text, np.uint8)]
        starts, ends, _ = _runs((codes >= 0) & ~taken[:-1], np.array([0, len(text)]), WORD_LENGTH)
        digits = np.concatenate([[0], np.cumsum((codes >= 52) & (codes < 62))])
        plain = digits[ends] == digits[starts]
        starts, ends = starts[plain], ends[plain]
        size = ends - starts
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        before = np.where(np.isin(at, starts), _START, codes[at - 1])
        pair = before * len(_SYMBOLS) + codes[at]
        counts[0] += np.bincount(pair, minlength=counts[0].size).reshape(counts[0].shape)
    return counts


def learn(docs: DataFrame) -> Markov:
    """Both models from a bounded sample of rows; the labels are the base patterns' own."""
    texts = docs.select(text_binary(F.col("text")).alias("text"))
    share = min(1.0, SAMPLE_ROWS / max(1, texts.count()))
    chosen = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            data, offsets = byte_ranges(batch.column(0))
            for i, j in slices(offsets):
                part = _transitions([data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)])
                total = part if total is None else total + part
        if total is not None:
            place = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"place": place, "n": total.ravel()[place]})

    counts = np.zeros((2, len(_SYMBOLS) + 1, len(_SYMBOLS)), np.int64)
    for place, n in chosen.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n")).collect():
        counts.ravel()[place] = n
    return Markov.of(counts[1], counts[0])


FOUND = "struct<n_assign:long,n_access:long,n_hex:long,base_sha256:string,spans:array<struct<start:int,end:int,kind:string>>>"


def find_secrets(text: Column, model: Markov) -> Column:
    """Counts, digest of the base spans, and all spans in code points by start, then kind."""

    @F.arrow_udf(FOUND)
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        data, offsets = byte_ranges(texts)
        for i, j in slices(offsets):
            held = [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)]
            for text, (base, tokens) in zip(held, scan(held), strict=True):
                spans = base + [(s, e, 3) for s, e in tokens if model.secret(text[s:e])]
                if spans:
                    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                    spans = sorted((int(points[s]), k, int(points[e])) for s, e, k in spans)
                plain = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans if k < 3)
                n = [sum(k == kind for _, k, _ in spans) for kind in range(3)]
                rows.append(
                    {
                        "n_assign": n[0], "n_access": n[1], "n_hex": n[2],
                        "base_sha256": hashlib.sha256(plain.encode()).hexdigest(),
                        "spans": [{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in spans],
                    }
                )
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
        kinds = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.list_(span))]
        return pa.array(rows, pa.struct(kinds))

    return run(text_binary(text))


def secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row.

    Null texts are empty: no span, and the digest of the empty string. Repeated rows and null ids are
    each returned; an empty table gives an empty result.
    """
    found = find_secrets(F.col("text"), learn(docs))
    return docs.select("doc_id", found.alias("_found")).select("doc_id", "_found.*")


def redact(docs: DataFrame) -> DataFrame:
    """The rows with every secret span of ``text`` replaced by its kind in brackets.

    Spans that overlap are one, named by the first. Null texts stay null; other columns stay.
    """
    model = learn(docs)

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        data, offsets = byte_ranges(texts)
        out = []
        for i, j in slices(offsets):
            held = [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)]
            for text, (base, tokens) in zip(held, scan(held), strict=True):
                spans = sorted([(s, k, e) for s, e, k in base] + [(s, 3, e) for s, e in tokens if model.secret(text[s:e])])
                parts, at, last = [], 0, -1
                for s, k, e in spans:
                    if s >= at or last < 0:
                        parts += [text[at:s], b"[" + KINDS[k].encode() + b"]"]
                    at, last = max(at, e), k
                out.append(b"".join([*parts, text[at:]]).decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    return docs.withColumn("text", F.when(F.col("text").isNotNull(), run(text_binary(F.col("text")))))
