"""Log-probabilities of texts by a weighted backoff automaton over bytes, and a unigram base."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, functions as F

from .shared import byte_ranges, id_remainder, stage, text_binary

ORDER = 6
# A context of the model holds at least this share of all training bytes; 0 keeps every context.
SHARE = 0.0
# Contexts with at least this share of all training bytes go to every task as an automaton, which so
# has 1 / COMMON_SHARE contexts of each length at most. It decides where a probability is looked up, not its value.
COMMON_SHARE = 1e-5
# The n-grams outside the automaton met most often whose probabilities go to every task; all others are joined.
COMMON_GRAMS = 1 << 20
# The most frequent words whose counts go to every task; counts of all others are joined.
COMMON_WORDS = 1 << 18
# Distinct words or n-grams that a task counts before it passes them on.
HELD = 1 << 19
# Bytes that one lane of the traversal walks, and bytes of text that are walked side by side.
_LANE = 2048
_WALK = 8 << 20
_END = 10  # a newline ends a text; white space inside is single spaces


def normal(text: bytes) -> bytes:
    """A-Z in lower case, words joined by single spaces, and the end mark."""
    return b" ".join(text.lower().split()) + b"\n"


def grams_of(data: np.ndarray, first: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each byte, newest byte lowest; before a text there are end marks."""
    codes = np.zeros(len(data), np.uint64)
    place = np.arange(len(data)) - np.repeat(first[:-1], np.diff(first))
    for k in range(order):
        older = np.full(len(data), _END, np.uint64)
        older[k:] = data[: len(data) - k]
        codes |= np.where(place >= k, older, np.uint64(_END)) << np.uint64(8 * k)
    return codes


def grams_at(data: np.ndarray, at: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """The n-grams that end at some bytes; ``place`` counts the bytes before each in its text."""
    codes = np.zeros(len(at), np.uint64)
    for k in range(order):
        codes |= np.where(place >= k, data[np.maximum(at - k, 0)], _END).astype(np.uint64) << np.uint64(8 * k)
    return codes


@dataclass
class Grams:
    """N-grams of the automaton by length: codes of the continuations and their counts."""

    codes: list[np.ndarray]
    counts: list[np.ndarray]


class Automaton:
    """States are the given contexts of up to ``order - 1`` bytes, the empty one first.

    Witten-Bell smoothing: what a state has seen t different bytes follow n times in all gets
    c / (n + t) for a byte seen c times, and the failure arc to the state of the next shorter
    context has the weight t / (n + t). Failure arcs are resolved when the automaton is built, so
    that each step is one look-up of the next state and one of the weight, for classes of bytes:
    bytes never seen share one, and its probability is divided by their number.
    """

    def __init__(self, grams: Grams):
        orders = len(grams.codes)
        seen = np.unique(grams.codes[0]).astype(np.int64) if orders else np.zeros(0, np.int64)
        self.classes = np.full(256, len(seen), np.int64)
        self.classes[seen] = np.arange(len(seen))
        width = len(seen) + 1
        unseen = max(1, 256 - len(seen))
        contexts = [np.zeros(1, np.uint64)]
        for k in range(1, orders):
            contexts.append(np.unique(grams.codes[k] >> np.uint64(8)))
        base = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
        self.states = int(base[-1])
        self.deep = int(base[orders - 1]) if orders else 0  # the first state of a whole context
        chance = np.zeros((self.states, width))
        following = np.zeros((self.states, width), np.int32)

        def state(k: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The state of each context of length k, and whether there is one."""
            if not len(contexts[k]):
                return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
            at = np.minimum(np.searchsorted(contexts[k], codes), len(contexts[k]) - 1)
            return base[k] + at, contexts[k][at] == codes

        self.fallback = np.zeros(self.states, np.int64)
        for k, codes in enumerate(contexts):
            rows = np.arange(base[k], base[k + 1])
            if k:
                self.fallback[rows], _ = state(k - 1, codes & np.uint64((1 << (8 * (k - 1))) - 1))
                low, goto = chance[self.fallback[rows]], following[self.fallback[rows]].copy()
            else:
                low = np.full((1, width), 1 / 256)
                low[:, -1] = unseen / 256
                goto = np.zeros((1, width), np.int32)
            if k < orders:
                grown, counts = grams.codes[k], grams.counts[k]
                own = np.searchsorted(codes, grown >> np.uint64(8))
                column = self.classes[(grown & np.uint64(255)).astype(np.int64)]
                total, kinds = np.bincount(own, counts, len(codes)), np.bincount(own, minlength=len(codes))
                table = low * (kinds / np.maximum(total + kinds, 1))[:, None]
                table[own, column] += counts / (total + kinds)[own]
                if k + 1 < orders:
                    target, kept = state(k + 1, grown)
                    goto[own[kept], column[kept]] = target[kept]
            else:
                table = low
            chance[rows], following[rows] = table, goto
        chance[:, -1] /= unseen
        self.log = np.log10(chance).astype(np.float32)
        self.next = following
        begin = np.zeros(1, np.int64)
        for _ in range(orders):
            begin = self.next[begin, self.classes[_END]].astype(np.int64)
        self.begin, self.order = int(begin[0]), orders

    def walk(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The summed log-probability of each text, left to right, without the bytes whose whole
        context is no state; and the places of these bytes.

        Texts are cut into lanes that are walked side by side. A lane that begins inside a text first
        repeats the ``order`` bytes before it without adding weights; they decide its state.
        """
        sizes = np.diff(first)
        per = -(-sizes // _LANE)
        text = np.repeat(np.arange(len(sizes)), per)
        part = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        low = first[:-1][text] + part * _LANE
        high = np.minimum(low + _LANE, first[1:][text])
        warm = np.where(part > 0, self.order, 0)
        state = np.full(len(text), self.begin, np.int64)
        total = np.zeros(len(text))
        order = np.argsort(-(high - low + warm), kind="stable")
        start, length, skip = (low - warm)[order], (high - low + warm)[order], warm[order]
        state = np.where(skip > 0, 0, state[order])
        symbols = self.classes[data]
        flat_next, flat_log, width = self.next.ravel(), self.log.ravel(), self.next.shape[1]
        active = len(order)
        ends = np.searchsorted(-length, -np.arange(int(length[0]) if active else 0), "left")
        outside = [np.zeros(0, np.int64)]
        for step in range(len(ends)):
            active = int(ends[step])
            at = state[:active] * width + symbols[start[:active] + step]
            inside, counted = state[:active] >= self.deep, skip[:active] <= step if step < self.order else True
            total[:active] += np.where(inside & counted, flat_log[at], 0)
            outside.append(start[np.flatnonzero(~inside & counted)] + step)
            state[:active] = flat_next[at]
        out = np.zeros(len(text))
        out[order] = total
        return np.bincount(text, out, len(sizes)), np.concatenate(outside)


@lru_cache(maxsize=1)
def _automaton(key: int, broadcast: Broadcast) -> Automaton:
    return Automaton(broadcast.value)


@lru_cache(maxsize=1)
def _known(key: int, broadcast: Broadcast) -> dict[bytes, int]:
    table = broadcast.value
    return dict(zip(table["word"].to_pylist(), table["n"].to_pylist(), strict=True))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (``word``) and of full-length n-grams (``gram``), summed per task: ``n`` in
    training texts, and for n-grams ``met`` in all texts, so that each n-gram that is scored has a row."""
    words: Counter[bytes] = Counter()
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n, met = (np.bincount(at, np.concatenate([p[k] for p in parts])).astype(np.int64) for k in (1, 2))
        return codes, n, met

    def of_words() -> pa.RecordBatch:
        n = pa.array(list(words.values()), pa.int64())
        return pa.RecordBatch.from_pydict({"word": pa.array(list(words), pa.binary()), "gram": pa.nulls(len(words), pa.int64()), "n": n, "met": n})

    def of_grams(codes: np.ndarray, n: np.ndarray, met: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"word": pa.nulls(len(codes), pa.binary()), "gram": pa.array(codes.view(np.int64)), "n": pa.array(n), "met": pa.array(met)}
        )

    held: tuple[list[bytes], list[bytes]] = ([], [])  # of training and of held-out texts

    def take() -> None:
        for texts, learnt in zip(held, (True, False), strict=True):
            if texts:
                first = np.concatenate([[0], np.cumsum(np.array([len(t) for t in texts], np.int64))])
                codes, met = np.unique(grams_of(np.frombuffer(b"".join(texts), np.uint8), first, ORDER), return_counts=True)
                parts.append((codes, met if learnt else np.zeros_like(met), met))
                texts.clear()

    size = 0
    for batch in batches:
        data, offsets = byte_ranges(batch.column(0))
        for k, out in enumerate(batch.column(1).to_pylist()):
            text = normal(data[offsets[k] : offsets[k + 1]].tobytes())
            held[out].append(text)
            if not out:
                words.update(text[:-1].split(b" ") if len(text) > 1 else [])
                words[b""] += 1  # the end of a text, counted as a token
            size += len(text)
            if size >= 1 << 20:
                take()
                size = 0
                if sum(len(p[0]) for p in parts) > 4 * HELD:
                    parts[:] = [merged()]
                    if len(parts[0][0]) > 2 * HELD:
                        yield of_grams(*parts.pop())
            if len(words) > HELD:
                yield of_words()
                words.clear()
    take()
    if parts:
        yield of_grams(*merged())
    if words:
        yield of_words()


def _level(grams: DataFrame, k: int) -> DataFrame:
    """Counts of the n-grams of length ``k`` from those of full length, with the context of each."""
    shorter = grams.select(F.col("gram").bitwiseAND((1 << (8 * k)) - 1).alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n"))
    return shorter.withColumn("context", F.shiftrightunsigned("gram", 8))


def train(texts: DataFrame) -> tuple[DataFrame, DataFrame, Grams, int, int]:
    """Counts over all texts (columns ``text``, binary, and ``held_out``): the word counts, the table of
    n-grams with their probabilities, the n-grams of the automaton, and the numbers of tokens and of
    distinct tokens (with the end token)."""
    counts = stage(
        texts.select("text", "held_out").mapInArrow(_counted, "word binary, gram long, n long, met long")
        .groupBy("word", "gram").agg(F.sum("n").alias("n"), F.sum("met").alias("met")),
        "counts",
    )
    words = counts.where("word is not null").select("word", "n")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    full = counts.where("gram is not null").select("gram", "n", "met")
    total = full.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = total * max(SHARE, COMMON_SHARE)
    codes, sums = [], []
    for k in range(1, ORDER + 1):
        shorter = _level(full.where("n > 0"), k)
        kept = shorter.groupBy("context").agg(F.sum("n").alias("total")).where(F.col("total") >= least)
        found = shorter.join(F.broadcast(kept), "context") if k > 1 else shorter  # 1 / COMMON_SHARE contexts at most
        table = found.select("gram", "n").toArrow()
        order = np.argsort(table["gram"].to_numpy())
        codes.append(table["gram"].to_numpy()[order].view(np.uint64))
        sums.append(table["n"].to_numpy()[order].astype(np.float64))
    return words, _chances(full, total * SHARE), Grams(codes, sums), tokens, distinct


def _chances(full: DataFrame, least: float) -> DataFrame:
    """``gram, met, log``: log10 of the probability of the newest byte of every n-gram after the bytes
    before it, by the smoothing of ``Automaton`` with all contexts of at least ``least`` bytes.

    A context has 256 continuations at most, so no key of these joins is large.
    """
    lower = None
    for k in range(1, ORDER + 1):
        level = _level(full, k) if k < ORDER else full.withColumn("context", F.shiftrightunsigned("gram", 8))
        small = F.broadcast if k <= 3 else lambda table: table  # 65,536 contexts and shorter n-grams at most
        sums = level.groupBy("context").agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("kinds"))
        level = level.join(small(sums), "context")
        if lower is None:
            level = level.withColumn("low", F.lit(1 / 256))
        else:
            level = level.withColumn("short", F.col("gram").bitwiseAND((1 << (8 * (k - 1))) - 1)).join(small(lower), "short")
        learnt = (F.col("total") > 0) & (F.lit(k == 1) | (F.col("total") >= least))
        chance = F.when(learnt, (F.col("n") + F.col("kinds") * F.col("low")) / (F.col("total") + F.col("kinds"))).otherwise(F.col("low"))
        lower = level.select(F.col("gram").alias("short"), chance.alias("low"), *(["met"] if k == ORDER else []))
    return stage(lower.select(F.col("short").alias("gram"), "met", F.log10("low").alias("log")), "chances")


def _common_count(counts: DataFrame, n: str, most: int) -> int:
    """The count from which on words or n-grams are common: with it there are ``most`` of them at most."""
    steps = counts.groupBy(F.floor(F.log2(n) * 64).alias("step")).agg(F.count("*").alias("found"), F.min(n).alias("n"))
    least, total = 1 << 62, 0
    for _, found, n in sorted(steps.collect(), reverse=True):
        total += found
        if total > most:
            break
        least = n
    return least


def score_texts(docs: DataFrame, base_pseudo: int = 1) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Rows whose crc32(doc_id) mod 7 is 2 are held out; a null id is held out as well. Null texts are
    empty: one token, the end. Repeated rows are each returned; an empty table gives an empty
    result. If nothing is left to learn from, the automaton gives every byte 1 / 256.

    Word counts of the most frequent words go to the tasks that read the texts. The others, each of
    them rare, are joined by word; their sums come back by row. The model keeps all contexts of the
    training texts: those of ``COMMON_SHARE`` go to every task as an automaton, and so do the
    probabilities of the ``COMMON_GRAMS`` n-grams outside it that are met most often. All other n-grams
    of a text are joined to the table of the model; their sums come back by row as well.
    """
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id", text_binary(F.col("text")).alias("text"),
        F.coalesce(id_remainder(F.col("doc_id"), 7) == 2, F.lit(True)).alias("held_out"),
    )
    words, chances, grams, tokens, distinct = train(rows)
    least, often = _common_count(words, "n", COMMON_WORDS), _common_count(chances, "met", COMMON_GRAMS)
    common = spark.sparkContext.broadcast(words.where(F.col("n") >= least).toArrow())  # COMMON_WORDS rows at most
    model = spark.sparkContext.broadcast(grams)
    table = chances.where(F.col("met") >= often).select("gram", F.col("log").cast("float")).toArrow()  # COMMON_GRAMS rows at most
    order = np.argsort(table["gram"].to_numpy().view(np.uint64))
    looked = spark.sparkContext.broadcast((table["gram"].to_numpy().view(np.uint64)[order], table["log"].to_numpy()[order]))
    key = model._jbroadcast.id() if hasattr(model, "_jbroadcast") else id(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, automaton = _known(key, common), _automaton(key, model)
        logs: dict[int, float] = {}
        place = TaskContext.get().partitionId() << 40
        rare = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))
        often_codes, often_logs = looked.value
        for batch in batches:
            data, offsets = byte_ranges(batch.column(1))
            size = 0
            n_tokens, n_known, sums, others, scores, held, joined = [], [], [], [], [], [], []

            def walk() -> None:
                first = np.concatenate([[0], np.cumsum(np.array([len(t) for t in held], np.int64))])
                data = np.frombuffer(b"".join(held), np.uint8)
                total, places = automaton.walk(data, first)
                text = np.searchsorted(first, places, "right") - 1
                codes = grams_at(data, places, places - first[text], ORDER)
                order = np.lexsort((text, codes))
                codes, text = codes[order], text[order]
                if len(often_codes):
                    at = np.minimum(np.searchsorted(often_codes, codes), len(often_codes) - 1)
                    found = often_codes[at] == codes
                    total += np.bincount(text[found], often_logs[at[found]], len(held))
                    codes, text = codes[~found], text[~found]
                joined.append((codes, text + len(scores)))
                scores.extend(total.tolist())
                held.clear()

            for k in range(len(offsets) - 1):
                text = normal(data[offsets[k] : offsets[k + 1]].tobytes())
                found = text[:-1].split(b" ") if len(text) > 1 else []
                found.append(b"")
                counts = list(map(known.get, found))
                seen = Counter(counts)
                missing = seen.pop(None, 0)
                total = 0.0
                for c, n in seen.items():
                    if c not in logs:
                        logs[c] = math.log10(c + base_pseudo)
                    total += n * logs[c]
                n_tokens.append(len(found))
                n_known.append(len(found) - missing)
                sums.append(total)
                rest = Counter(w for w, c in zip(found, counts, strict=True) if c is None) if missing else {}
                others.append([{"word": w, "n": n} for w, n in rest.items()])
                held.append(text)
                size += len(text)
                if size >= _WALK:
                    walk()
                    size = 0
            if held:
                walk()
            codes, text = (np.concatenate(x) for x in zip(*joined, strict=True))
            order = np.argsort(text, kind="stable")  # within a text by code
            codes, text = codes[order], text[order]
            head = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (text[1:] != text[:-1])])[: len(codes)])
            n = np.diff(np.concatenate([head, [len(codes)]]))
            entries = pa.StructArray.from_arrays([pa.array(codes[head].view(np.int64)), pa.array(n.astype(np.int32))], ["gram", "n"])
            bounds = np.searchsorted(text[head], np.arange(len(batch) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "row": pa.array(range(place, place + len(batch)), pa.int64()), "doc_id": batch.column(0), "held_out": batch.column(2),
                    "n_tokens": pa.array(n_tokens, pa.int64()), "n_common": pa.array(n_known, pa.int64()),
                    "common_sum": pa.array(sums, pa.float64()), "score": pa.array(scores, pa.float64()), "rare": pa.array(others, rare),
                    "joined": pa.ListArray.from_arrays(pa.array(bounds), entries),
                }
            )
            place += len(batch)

    kinds = "row long, doc_id long, held_out boolean, n_tokens long, n_common long, common_sum double, score double, rare array<struct<word:binary,n:int>>, joined array<struct<gram:long,n:int>>"
    scored = stage(rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, kinds), "scored")
    counted = words.where(F.col("n") < least).withColumnRenamed("n", "c")
    rare = (
        scored.select("row", F.inline("rare")).join(counted, "word")
        .groupBy("row").agg(F.sum("n").alias("n_rare"), F.sum(F.col("n") * F.log10((F.col("c") + base_pseudo) / base_pseudo)).alias("rare_sum"))
    )
    seldom = chances.where(F.col("met") < often).select("gram", "log")
    outside = (
        scored.select("row", F.inline("joined")).join(seldom, "gram")
        .groupBy("row").agg(F.sum(F.col("n") * F.col("log")).alias("outside_score"))
    )
    floor = math.log10(base_pseudo) if base_pseudo else 0.0
    missing = (F.col("n_tokens") - F.col("n_common")) * floor
    norm = F.col("n_tokens") * math.log10(tokens + base_pseudo * (distinct + 1))
    return scored.drop("rare", "joined").join(rare, "row", "left").join(outside, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_common") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("common_sum") + missing + F.coalesce("rare_sum", F.lit(0.0)) - norm).alias("base_score"),
        (F.col("score") + F.coalesce("outside_score", F.lit(0.0))).alias("score"),
    )
