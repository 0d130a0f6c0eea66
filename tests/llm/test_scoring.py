"""Base score by plain counts, automaton against recursive backoff, held-out gain, edge rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from logloom.llm import scoring as S
from logloom.llm.queries import QUERIES
from logloom.llm.shared import table


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def held(doc):
    return doc is None or zlib.crc32(str(doc).encode()) % 7 == 2


def plain_base(rows):
    counts = Counter(t for d, text in rows if not held(d) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    score = lambda text: sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(text))
    return {(d, t): (len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n, score(t)) for d, t in rows}


def plain_model(texts, order, share):
    """Witten-Bell over bytes by direct recursion on dictionaries."""
    counts = defaultdict(Counter)
    for text in texts:
        padded = b"\n" * (order - 1) + S.normal(text)
        for i in range(order - 1, len(padded)):
            for k in range(order):
                counts[padded[i - k : i]][padded[i]] += 1
    least = sum(counts[b""].values()) * share
    kinds = len(counts[b""])

    def chance(context, byte):
        seen = counts.get(context)
        low = 1 / 256 if not context else chance(context[1:], byte)
        if seen is None or (context and sum(seen.values()) < least):
            return low
        n, t = sum(seen.values()), len(seen)
        return (seen[byte] + t * low) / (n + t)

    def score(text):
        padded = b"\n" * (order - 1) + S.normal(text)
        return sum(math.log10(chance(padded[i - order + 1 : i], padded[i])) for i in range(order - 1, len(padded)))

    assert kinds
    return score


ODD = [(2, None), (3, ""), (4, " \t\n"), (None, "some Words here"), (5, "ABC abc \x0b abc"), (5, "ABC abc \x0b abc"), (6, "\x00ü\x00"), (7, "word " * 30_000)]


@pytest.mark.parametrize("common, lane, share", [(1 << 18, 2048, 0.0), (3, 7, 0.004)])
def test_scores(spark, monkeypatch, common, lane, share):
    monkeypatch.setattr(S, "COMMON_WORDS", common)
    monkeypatch.setattr(S, "_LANE", lane)
    monkeypatch.setattr(S, "SHARE", share)
    rows = ODD[:-1] + [(i, f"the {i % 7} brown fox number {i} jumps, the End") for i in range(20, 120)]
    if share:
        rows.append(ODD[-1])
    docs = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, n int, word string")
    got = S.score_texts(docs).collect()
    assert len(got) == len(rows)
    base = plain_base(rows)
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(t)
    score = plain_model([(t or "").encode() for d, t in rows if not held(d)], 6, share)
    for r in got:
        text = texts[r.doc_id][0]
        n, known, train, want = base[r.doc_id, text]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), n, known, train)
        assert math.isclose(r.base_score, want, rel_tol=1e-9)
        assert math.isclose(r.score, score((text or "").encode()), rel_tol=1e-4), text
    assert S.score_texts(docs.limit(0)).collect() == []


@pytest.mark.parametrize("share, grams", [(1e-5, 1 << 20), (0.01, 1 << 20), (0.01, 5), (2.0, 0)])
def test_rare_contexts_are_kept(spark, monkeypatch, share, grams):
    """One text of 300,000 bytes does not take the contexts of the others out of the model."""
    monkeypatch.setattr(S, "COMMON_SHARE", share, raising=False)
    monkeypatch.setattr(S, "COMMON_GRAMS", grams, raising=False)
    long = next(i for i in range(200, 300) if not held(i))
    rows = ODD[:-1] + [(i, f"the {i % 7} brown fox number {i} jumps, the End") for i in range(20, 120)] + [(long, "word " * 60_000)]
    score = plain_model([(t or "").encode() for d, t in rows if not held(d)], 6, 0)
    want = sorted((d or -1, round(score((t or "").encode()), 2)) for d, t in rows)
    got = S.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for (d, x), (e, y) in zip(sorted((r.doc_id or -1, r.score) for r in got), want, strict=True):
        assert d == e and math.isclose(x, y, rel_tol=1e-4, abs_tol=0.01), d


def test_every_state_is_a_distribution():
    texts = [S.normal(t) for t in (b"a bc abc", b"aab cab", b"")]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    full = S.grams_of(data, first, 4)
    codes, sums = [], []
    for k in range(1, 5):
        c, n = np.unique(full & np.uint64((1 << (8 * k)) - 1), return_counts=True)
        codes.append(c)
        sums.append(n.astype(float))
    automaton = S.Automaton(S.Grams(codes, sums))
    chance = 10.0 ** automaton.log.astype(float)
    chance[:, -1] *= 256 - (automaton.log.shape[1] - 1)
    assert np.allclose(chance.sum(axis=1), 1, atol=1e-5)


def test_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op10_lm_scoring"](spark, sf).collect()
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    base = plain_base(rows)
    texts = dict(rows)
    for r in got:
        n, known, train, want = base[r.doc_id, texts[r.doc_id]]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train) and math.isclose(r.base_score, want, rel_tol=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
