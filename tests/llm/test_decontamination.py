"""Contained items against a double loop over shingle sets, edge rows, blocks of items."""

import math
import random
import re

import pytest
from compare import connect
from logloom import session
from logloom.llm import decontamination as D
from logloom.llm.queries import QUERIES


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", low)


def grams(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def plain(docs, items):
    out = []
    for item, text in set(items):
        words = plain_words(text)
        n = min(5, len(words))
        want = grams(words, n)
        for doc, other in docs:
            inside = len(want & grams(plain_words(other), n))
            if want and inside >= math.ceil(0.8 * len(want) - 1e-9):
                out.append((doc, item, len(want), inside))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits, small", [((20, 23), 200_000), ((3, 3), -1)])
def test_planted_items(spark, monkeypatch, bits, small):
    """Also with a filter that lets much pass, and with tables that count as large."""
    monkeypatch.setattr(D, "FILTER_BITS", bits)
    if small < 0:
        monkeypatch.setattr(session, "is_small", lambda *_: False)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "don't", "x-y"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([1, 3, 5, 9, 30, 70])))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "!!"), (None, "a b c d e f"), (3, items[3][1]), (3, "other text of one id")]
    docs = [(0, None), (1, ""), (2, " . "), (None, "A b; c\nd e f g")]
    for i in range(3, 40):
        words = some(rng.choice([3, 40, 400]))
        for _ in range(3):
            item = rng.choice(items)[1] or ""
            copy = item.upper().split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = copy
        docs.append((i, " , ".join(words) if i % 2 else " ".join(words)))
    docs += [docs[5], docs[5], (99, ("lang " * 60_000) + (items[4][1] or ""))]
    frame = spark.createDataFrame([(d, t, "i", 1) for d, t in docs], "doc_id long, text string, item_id string, n_shingles int")
    bench = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id int")
    got = D.contaminations(frame, bench).collect()
    want = plain(docs, items)
    assert sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_contained) for r in got), key=str) == want and len(want) > 40
    clean = sorted((r.doc_id for r in D.without_contaminated(frame, bench).collect()), key=str)
    bad = {w[0] for w in want}
    assert clean == sorted((d for d, _ in docs if d not in bad), key=str)
    assert D.contaminations(frame.limit(0), bench).collect() == [] == D.contaminations(frame, bench.limit(0)).collect()


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(map(tuple, QUERIES["op2_benchmark_decontamination"](spark, sf).collect()))
    assert got == sorted(connect(sf).execute(D.ORACLE).fetchall()) and len(got) > 10
