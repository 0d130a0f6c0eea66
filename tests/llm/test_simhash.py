"""SimHash near-dedup against a plain double loop."""

import random

import pytest
import xxhash
from logloom.llm.components import connected_components
from logloom.llm.simhash import fingerprint_links, fingerprint_of, simhash_components
from logloom.llm.shared import table


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def plain_components(rows, budget=2):
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= budget:
                root[find(a)] = find(b)
    least = {}
    for doc, f in rows:
        if doc is not None:
            least[find(f)] = min(least.get(find(f), doc), doc)
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in rows), key=str)


TEXTS = [
    "", None, "one", "One\tTWO", "one two three", "ONE two  three", "one two three four", " \n ", "x " * 3000,
    "ä Ä one two three   four", "copy of this line here", "copy of this line here", "\x00 a b c",
]


def test_fingerprints():
    for text in TEXTS:
        assert fingerprint_of((text or "").encode()) == plain_fingerprint(text)


def test_components_of_texts(spark):
    rows = [(i if i != 4 else None, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (3, TEXTS[3])]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, n int")
    got = sorted(map(tuple, simhash_components(docs).collect()), key=str)
    assert got == plain_components([(d, plain_fingerprint(t)) for d, t in rows])
    assert simhash_components(docs.limit(0)).collect() == []


@pytest.mark.parametrize("block", [4096, 7])
def test_links_of_near_fingerprints(spark, monkeypatch, block):
    monkeypatch.setattr("logloom.llm.simhash.BLOCK", block)
    rng = random.Random(5)
    prints = []
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 9, 40])):
            prints.append(f)
            for bit in rng.sample(range(64), rng.choice([0, 1, 2, 3])):
                f ^= 1 << bit
    rows = list(enumerate(prints))
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in prints], "fp long")
    got = {r.node % (1 << 64): r.component % (1 << 64) for r in connected_components(fingerprint_links(frame)).collect()}
    want = {}
    for d, f, c in plain_components(rows):
        want.setdefault(c, set()).add(int(f, 16))
    have = {}
    for f in set(prints):
        have.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, have.values())) == sorted(map(sorted, want.values()))


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    assert sorted(map(tuple, simhash_components(docs).collect()), key=str) == plain_components(rows)


def test_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(2000, 2400)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(301)) and all(got[i] == 1000 for i in range(2000, 2400))
    assert len(got) == 702
