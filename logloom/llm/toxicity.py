"""Toxic spans and document scores by a linear-chain conditional random field with two tags."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import byte_ranges, id_remainder, lower_ascii, slices, text_binary

# Labelled rows that are learnt from, at most about as many of each label (taken by a hash of the
# id), and the longest text among them, in bytes. Words are marked from all of them; the field is
# fitted to the toxic ones and as many others.
SAMPLE_ROWS = {0: 7500, 1: 2500}
SAMPLE_BYTES = 200_000
# A word marks toxic passages if this share of its contexts and of its texts (each as a rate within
# its label) is toxic, and so many are that chance gives this number of false marks.
MARK_SHARE = 0.95
MARK_CHANCE = 0.01

# Bytes of text, texts of a step of the fit, and shares of the pairs of a word and its place that are
# in memory at once.
_SLICE_BYTES = 1 << 18
_STEP_TEXTS = 1000
_SHARES = 8

_LANE = 128
_TABLE_BITS = 18
_AFFIXES = 1 << 18
# Lengths in bytes of the word beginnings that are features; those from the second on may be marks.
_HEADS = (3, 4, 5, 6, 7, 8)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """The words of some texts: byte ranges, hashes, each text's first word, and hashed affixes (word
    beginnings by length, then the last three bytes; 0 where the word is shorter, 32 bits each)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    affixes: np.ndarray

    def buckets(self) -> np.ndarray:
        return self.affixes >> np.uint32(32 - 18)


def _word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = _WORD[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of letters, digits and non-ASCII bytes, A-Z in lower case; ``offsets`` start at 0."""
    low = lower_ascii(data)
    n = len(data)
    starts, ends, first = _word_ranges(data, offsets)
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, first, np.zeros(0, np.uint64), np.zeros((len(_HEADS) + 1, 0), np.uint32))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=sums[1:])
    inverse = _powers(_INVERSE, n)

    def hashed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = (sums[high] - sums[low]) * inverse[low]
        return (x ^ (x >> np.uint64(31))) * _MIX

    affixes = np.zeros((len(_HEADS) + 1, len(starts)), np.uint32)
    for at, k in enumerate(_HEADS):
        keys = (hashed(starts, np.minimum(starts + k, ends)) >> np.uint64(32)) ^ np.uint64(k)
        affixes[at] = np.where(ends - starts >= k, keys, 0)
    affixes[-1] = np.where(ends - starts >= 3, hashed(np.maximum(ends - 3, starts), ends) >> np.uint64(32), 0)
    return Words(starts, ends, first, hashed(starts, ends), affixes)


def find_all(texts: list[bytes]) -> Words:
    """The words of many texts, counted and then found slice by slice; the byte ranges are left out."""
    offsets = np.concatenate([[0], np.cumsum(np.array([len(t) for t in texts], np.int64))])
    none = np.zeros(0, np.int64)
    runs = list(slices(offsets, _SLICE_BYTES))

    def part(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(texts[i:j]), np.uint8), offsets[i : j + 1] - offsets[i]

    counts = np.concatenate([none, *(np.diff(_word_ranges(*part(i, j))[2]) for i, j in runs)])
    first = np.concatenate([[0], np.cumsum(counts)])
    hashes, affixes = np.empty(first[-1], np.uint64), np.empty((len(_HEADS) + 1, first[-1]), np.uint32)
    for i, j in runs:
        words, at = find_words(*part(i, j)), slice(first[i], first[j])
        hashes[at], affixes[:, at] = words.hashes, words.affixes
    return Words(none, none, first, hashes, affixes)


class Chains:
    """Forward and backward sums over many chains at once, exact for any length.

    Chains are cut into lanes of ``_LANE`` words. The product of a lane's 2 x 2 matrices carries the
    sums over the lanes of a chain, then all lanes are walked side by side.
    """

    def __init__(self, first: np.ndarray):
        sizes = np.diff(first)
        self.per = -(-sizes // _LANE)
        self.lane0 = np.concatenate([[0], np.cumsum(self.per)])
        lanes = int(self.lane0[-1])
        chain = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(first[-1] - first[0]) - np.repeat(first[:-1] - first[0], sizes)
        self.at = (place % _LANE) * lanes + self.lane0[chain] + place // _LANE
        self.lanes = lanes

    def _lay(self, values: np.ndarray, fill: float) -> np.ndarray:
        out = np.full(_LANE * self.lanes, fill)
        out[self.at] = values
        return out.reshape(_LANE, self.lanes)

    def marginals(self, emission: np.ndarray, move: np.ndarray, pairs: bool = False):
        """The probability of tag 1 for each word; with ``pairs`` also the expected tag changes.

        A chain starts after a virtual word of tag 0.
        """
        if not self.lanes:
            return (np.zeros(0), np.zeros((2, 2))) if pairs else np.zeros(0)
        weight = self._lay(np.exp(np.clip(emission, -30, 30)), 1.0)
        real = self._lay(np.ones(len(emission)), 0.0).astype(bool)
        (m00, m01), (m10, m11) = move
        product = np.zeros((self.lanes, 2, 2))
        product[:, 0, 0] = product[:, 1, 1] = 1
        for t in range(_LANE):
            keep = real[t]
            if not keep.any():
                break
            a0 = product[:, :, 0] * m00 + product[:, :, 1] * m10
            a1 = (product[:, :, 0] * m01 + product[:, :, 1] * m11) * weight[t][:, None]
            new = np.stack([a0, a1], axis=2)
            new /= new.sum(axis=(1, 2), keepdims=True)
            product = np.where(keep[:, None, None], new, product)
        enter, leave = np.zeros((self.lanes, 2)), np.ones((self.lanes, 2))
        enter[:, 0] = 1
        for k in range(1, int(self.per.max(initial=0))):
            lane = self.lane0[:-1][self.per > k] + k
            step = np.einsum("li,lij->lj", enter[lane - 1], product[lane - 1])
            enter[lane] = step / step.sum(axis=1, keepdims=True)
            lane = self.lane0[1:][self.per > k] - k
            step = np.einsum("lij,lj->li", product[lane], leave[lane])
            leave[lane - 1] = step / step.sum(axis=1, keepdims=True)
        f0, f1 = np.zeros((_LANE + 1, self.lanes)), np.zeros((_LANE + 1, self.lanes))
        f0[0], f1[0] = enter.T
        for t in range(_LANE):
            a0 = f0[t] * m00 + f1[t] * m10
            a1 = (f0[t] * m01 + f1[t] * m11) * weight[t]
            total = a0 + a1
            f0[t + 1], f1[t + 1] = np.where(real[t], a0 / total, f0[t]), np.where(real[t], a1 / total, f1[t])
        b0, b1 = leave.T
        found = np.empty((_LANE, self.lanes))
        moves = np.zeros((2, 2))
        for t in range(_LANE - 1, -1, -1):
            p0, p1 = f0[t + 1] * b0, f1[t + 1] * b1
            found[t] = p1 / (p0 + p1)
            w0, w1 = b0, b1 * weight[t]
            if pairs:
                joint = np.array([[f0[t] * m00 * w0, f0[t] * m01 * w1], [f1[t] * m10 * w0, f1[t] * m11 * w1]])
                moves += np.where(real[t], joint / joint.sum(axis=(0, 1)), 0).sum(axis=2)
            c0, c1 = m00 * w0 + m01 * w1, m10 * w0 + m11 * w1
            total = c0 + c1
            b0, b1 = np.where(real[t], c0 / total, b0), np.where(real[t], c1 / total, b1)
        result = found.ravel()[self.at]
        return (result, moves) if pairs else result


@dataclass
class Model:
    keys: np.ndarray  # hash of the word that owns each slot
    weights: np.ndarray  # slot x (word, word before, word after)
    affixes: np.ndarray  # weight by affix bucket
    bias: float
    move: np.ndarray
    slope: float
    level: float

    def emission(self, words: Words) -> np.ndarray:
        slot = (words.hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        own = np.where((self.keys[slot] == words.hashes)[:, None], self.weights[slot], 0)
        score = self.bias + own[:, 0] + sum(self.affixes[b] for b in words.buckets())
        if len(score) > 1:
            inner = np.ones(len(score), bool)  # words with a word before them in the same text
            inner[words.first[words.first < len(score)]] = False
            score[1:] += np.where(inner[1:], own[:-1, 1], 0)
            score[:-1] += np.where(inner[1:], own[1:, 2], 0)
        return score

    def mass(self, marginals: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The expected number of toxic words per text, words below one half left out."""
        sums = np.concatenate([[0], np.cumsum(np.where(marginals >= 0.5, marginals, 0))])
        return sums[first[1:]] - sums[first[:-1]]

    def score(self, mass: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.level + self.slope * np.log(mass + 0.01))))


def _spread(keys: np.ndarray, units: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per key, the distinct units in toxic texts and those in others."""
    order = np.lexsort((units, keys))
    k, u, y = keys[order], units[order], label[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (u[1:] != u[:-1])
    at = np.flatnonzero(new)
    bad, good = np.maximum.reduceat(y, at), np.maximum.reduceat(1 - y, at)
    names, spot = np.unique(k[at], return_inverse=True)
    return names, np.bincount(spot, bad), np.bincount(spot, good)


def _nearly_all(keys: np.ndarray, units: np.ndarray, label: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys, and whether nearly all their distinct units are toxic; a unit's words have one ``share``,
    and the shares are counted one after the other."""
    parts = []
    for k in range(_SHARES):
        at = np.flatnonzero(share == k)
        if len(at):
            parts.append(_spread(keys[at], units[at], label[at]))
    found, bad, good = (np.concatenate(x) for x in zip(*parts))
    names, spot = np.unique(found, return_inverse=True)
    n_bad, n_good = np.bincount(spot, bad), np.bincount(spot, good)
    rate_bad, rate_good = n_bad / max(n_bad.sum(), 1), n_good / max(n_good.sum(), 1)
    part = rate_bad / np.maximum(rate_bad + rate_good, 1e-300)
    odds = n_bad.sum() / max(n_bad.sum() + n_good.sum(), 1)
    need = np.log(len(names) / MARK_CHANCE) / np.log(1 / min(max(odds, 1e-9), 0.99))
    return names, (n_bad >= need) & (part >= MARK_SHARE)


def _marked(keys: np.ndarray, units: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> np.ndarray:
    (names, by_context), (_, by_text) = (_nearly_all(keys, unit, label, share) for unit, share in units)
    return names[by_context & by_text & (names > 0)]


def _among(keys: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted names, looked up in parts."""
    out = np.zeros(len(keys), bool)
    for low in range(0, len(keys) if len(names) else 0, _SLICE_BYTES):
        part = keys[low : low + _SLICE_BYTES]
        at = np.minimum(np.searchsorted(names, part), len(names) - 1)
        out[low : low + _SLICE_BYTES] = names[at] == part
    return out


def mark_words(words: Words, toxic: np.ndarray) -> np.ndarray:
    """Tags of the words of labelled texts, from the labels of whole texts.

    A word of a toxic text is tagged if the contexts (the words beside it) and the texts of the word,
    or of all words with one of its beginnings, are nearly all toxic. Each context counts once, so
    copies of one text do not make its words toxic.
    """
    if not len(words.hashes):
        return np.zeros(0)
    text = np.repeat(np.arange(len(toxic), dtype=np.int32), np.diff(words.first))
    label = toxic.astype(np.int8)[text]
    context = np.zeros(len(words.hashes), np.uint64)
    context[1:] = words.hashes[:-1] * _BASE
    context[:-1] ^= words.hashes[1:] * _MIX
    units = [(context, (context >> np.uint64(32)).astype(np.uint8) % _SHARES), (text, (text % _SHARES).astype(np.uint8))]
    found = np.zeros(len(label), bool)
    for keys in (words.hashes, *words.affixes[1 : len(_HEADS)]):
        found |= _among(keys, _marked(keys, units, label))
    return (found & (label == 1)).astype(float)


def fit(texts: list[bytes], toxic: list[int], rounds: int = 15, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Learns the field by gradient ascent on its log-likelihood (AdaGrad), then the document score
    from the expected toxic words. Without texts of both labels every score is 0.5 or the one seen."""
    labels = np.asarray(toxic, np.int64)
    every = find_all(texts)
    tags = mark_words(every, labels)
    keep = np.flatnonzero((labels == 1) | (np.cumsum(labels == 0) <= max(labels.sum(), 100)))
    tags = tags[np.repeat(np.isin(np.arange(len(labels)), keep), np.diff(every.first))]
    del every
    words = find_all([texts[k] for k in keep])
    names, word = np.unique(words.hashes, return_inverse=True)
    n = len(word)
    inner = np.ones(n, bool)
    inner[words.first[words.first < n]] = False
    own = np.zeros((len(names), 3))
    affixes, bias, buckets = np.zeros(_AFFIXES), np.array([-4.0]), words.buckets()
    words.hashes, words.affixes = words.hashes[:0], words.affixes[:, :0]
    move = np.log(np.array([[0.98, 0.02], [0.9, 0.1]]))
    runs = [words.first[k : k + _STEP_TEXTS + 1] for k in range(0, len(keep), _STEP_TEXTS)]
    before = np.where(inner, np.roll(tags, 1), 0).astype(int)
    seen = np.array([[np.sum((before == i) & (tags == j)) for j in (0, 1)] for i in (0, 1)], float)
    back, forth = np.flatnonzero(inner) - 1, np.flatnonzero(inner)
    grown = {k: 1e-8 for k in ("own", "affixes", "bias", "move")}

    def step(name: str, value: np.ndarray, slope: np.ndarray) -> None:
        slope = slope - decay * n ** 0.5 * value
        grown[name] = grown[name] + slope**2
        value += rate * slope / np.sqrt(grown[name])

    for _ in range(rounds if n else 0):
        emission = bias[0] + own[word, 0] + sum(affixes[b] for b in buckets)
        emission[forth] += own[word[back], 1]
        emission[back] += own[word[forth], 2]
        miss, moves = tags.copy(), np.zeros((2, 2))
        for first in runs:
            p, some = Chains(first).marginals(emission[first[0] : first[-1]], np.exp(move), pairs=True)
            miss[first[0] : first[-1]] -= p
            moves += some
        size = len(names)
        slope = np.column_stack(
            [
                np.bincount(word, miss, size),
                np.bincount(word[back], miss[forth], size),
                np.bincount(word[forth], miss[back], size),
            ]
        )
        step("own", own, slope)
        step("affixes", affixes, sum(np.bincount(b, miss, _AFFIXES) for b in buckets))
        step("bias", bias, np.array([miss.sum()]))
        step("move", move, seen - moves)
    keys, weights = np.zeros(1 << _TABLE_BITS, np.uint64), np.zeros((1 << _TABLE_BITS, 3))
    for k in np.argsort(np.abs(own).sum(axis=1)):  # the heaviest word of a slot stays
        slot = int(names[k]) >> (64 - _TABLE_BITS)
        keys[slot], weights[slot] = names[k], own[k]
    model = Model(keys, weights.astype(np.float32), affixes.astype(np.float32), float(bias[0]), np.exp(move), 1.0, 0.0)
    mass = np.zeros(len(texts))
    for low in range(0, len(texts), 500):
        part = find_all(texts[low : low + 500])
        mass[low : low + 500] = model.mass(Chains(part.first).marginals(model.emission(part), model.move), part.first)
    x, a, b = np.log(mass + 0.01), 0.0, 0.0
    for _ in range(200):  # logistic regression with a little decay, by Newton steps
        p = 1 / (1 + np.exp(-(a + b * x)))
        w = p * (1 - p)
        slope = np.array([np.sum(labels - p), np.sum((labels - p) * x) - 0.02 * b])
        curve = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.02]])
        change = np.clip(np.linalg.solve(curve, slope), -1, 1)
        a, b = a + change[0], b + change[1]
        if np.abs(change).max() < 1e-9:
            break
    model.level, model.slope = float(a), float(max(b, 0))
    return model


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits the model on a bounded sample of labelled rows whose id is not held out.

    Null ids, labels and texts are passed over.
    """
    known = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & (id_remainder(F.col("doc_id"), 3) != 1)).distinct()
    )
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    limits = F.create_map(*[F.lit(x) for t in (0, 1) for x in (t, min(1.0, SAMPLE_ROWS[t] / max(1, sizes.get(t, 0))))])
    chosen = F.broadcast(known.where(share < limits[F.col("toxic")]))  # about 10,000 ids
    rows = (
        docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES))
        .join(chosen, "doc_id").select("doc_id", "toxic", text_binary(F.col("text")).alias("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [x.to_pydict() for x in batches]
        found = sorted((d, y, t) for x in parts for d, y, t in zip(x["doc_id"], x["toxic"], x["text"], strict=True))
        model = fit([t for _, _, t in found], [y for _, y, _ in found])
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    # One task fits the bounded sample, so that the driver holds the finished model only.
    found = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found[0]) if found else fit([], [])


SCORED = "struct<score:double,toxic_words:double,spans:array<struct<start:int,end:int>>>"


def score_text(text: Column, model: Model) -> Column:
    """Score, expected toxic words, and toxic spans (code points) of whole texts."""

    @F.arrow_udf(SCORED)
    def run(texts: pa.Array) -> pa.Array:
        data, offsets = byte_ranges(texts)
        scores, masses, counts, low, high = [], [], [], [], []
        for i, j in slices(offsets, _SLICE_BYTES):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            words = find_words(part, at)
            p = Chains(words.first).marginals(model.emission(words), model.move)
            mass = model.mass(p, words.first)
            scores.append(model.score(mass))
            masses.append(mass)
            bad = np.flatnonzero(p >= 0.5)
            row = np.searchsorted(words.first, bad, "right") - 1
            joins = np.zeros(len(bad), bool)
            joins[1:] = (np.diff(bad) == 1) & (np.diff(row) == 0)
            head = np.flatnonzero(~joins)
            tail = np.append(head[1:], len(bad))[: len(head)] - 1
            points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
            start = points[at[row[head]]] if len(head) else np.zeros(0, np.int64)
            low.append(points[words.starts[bad[head]]] - start)
            high.append(points[words.ends[bad[tail]]] - start)
            counts.append(np.bincount(row[head], minlength=j - i) if len(head) else np.zeros(j - i, np.int64))
        whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0)
        spans = pa.StructArray.from_arrays([pa.array(whole(x).astype(np.int32)) for x in (low, high)], names=["start", "end"])
        ends = pa.array(np.concatenate([[0], np.cumsum(whole(counts))]).astype(np.int32))
        return pa.StructArray.from_arrays(
            [pa.array(whole(scores)), pa.array(whole(masses)), pa.ListArray.from_arrays(ends, spans)],
            names=["score", "toxic_words", "spans"],
        )

    return run(text_binary(text))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted, toxic_words, spans`` of every row.

    Null and empty texts hold no word and get the score of texts without toxic words. A null id
    counts as held out. Repeated rows are each returned; an empty table gives an empty result;
    without labels every score is that of an untrained model, 0.5.
    """
    found = score_text(F.col("text"), learn(docs, labels))
    return docs.select("doc_id", "text").select(
        "doc_id", F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(True)).alias("held_out"), found.alias("_found")
    ).select(
        "doc_id", "held_out", "_found.score", (F.col("_found.score") >= threshold).cast("int").alias("predicted"),
        "_found.toxic_words", "_found.spans",
    )
