"""Packing against item-by-item best-fit decreasing, and the read-back of all tokens."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from logloom.llm.packing import best_fit_decreasing, cut, encode, pack_documents, sequences
from logloom.llm.shared import table
from tokenizers import Tokenizer


def plain_bfd(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= s]
        if fits:
            best = min(fits, key=lambda i: rooms[i])
            rooms[best] -= s
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_item_by_item(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 31, 64, 2048])
    sizes = [rng.randint(1, capacity) for _ in range(rng.choice([1, 50, 400]))] + [capacity // 3 + 1] * rng.choice([0, 90])
    counts = {s: sizes.count(s) for s in set(sizes)}
    placed, used = best_fit_decreasing(counts, capacity)
    bins = defaultdict(list)
    seen = defaultdict(list)
    for size, low, high, first, each, offset in placed:
        for rank in range(low, high):
            seen[size].append(rank)
            k = rank - low
            bins[first + k // each].append((offset + k % each * size, size))
    assert {s: sorted(r) for s, r in seen.items()} == {s: list(range(n)) for s, n in counts.items()}
    rooms = []
    for parts in bins.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        rooms.append(capacity - at)
    assert len(bins) == used and sorted(rooms) == plain_bfd(sizes, capacity)


def test_ids_of_random_texts():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    parts = ["the ", "it's", "WE'LL", " 12345", "\n\n", " \t", "\u00a0", "\u0301", "\u00e9", "\u4e2d\u6587", "\U0001f600", "\x00", "\u200d", "<|end", "oftext|>", "<|endoftext|>", "a" * 50, "_-+=", "\u2028", "\ufeff", "\u0130"]
    for _ in range(4000):
        text = "".join(rng.choice([rng.choice(parts), chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xD800), rng.randrange(0xE000, 0x30000)]))]) for _ in range(rng.randrange(30)))
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


def test_cut():
    assert cut(5, 4) == [(0, 1), (1, 4)] and cut(8, 4) == [(0, 4), (4, 4)] and cut(1, 4) == [(0, 1)]


def check(rows, texts, capacity=2048):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc, copies in texts.items():
        want = []
        for text in copies:
            ids = np.array(slow.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
            want += [(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), capacity))]
        assert sorted(want) == sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc])
    return len(by_seq)


def test_edge_rows(spark):
    rows = [(1, "a"), (2, None), (3, ""), (4, "word " * 9000), (4, "word " * 9000), (5, "x<|endoftext|>y"), (None, "b"), (6, "ü\n\n \t z")]
    docs = spark.createDataFrame([(*r, 7, "n") for r in rows], "doc_id long, text string, length int, n string")
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(t)
    check(pack_documents(docs).collect(), texts)
    assert pack_documents(docs.limit(0)).collect() == []
    assert encode("x<|endoftext|>y")[1] == 50256


def test_documents(spark, monkeypatch):
    monkeypatch.setattr("logloom.llm.packing.NUMBERED", 50)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    packed = pack_documents(docs).cache()
    rows = packed.collect()
    texts = {r.doc_id: [r.text] for r in docs.collect()}
    used = check(rows, texts)
    assert used == len(plain_bfd([r.length for r in rows], 2048))
    joined = {r.sequence_id: r.ids for r in sequences(packed, docs).collect()}
    assert len(joined) == used
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows[:300]:
        ids = slow.encode(texts[r.doc_id][0], add_special_tokens=False).ids + [0]
        assert joined[r.sequence_id][r.offset : r.offset + r.length] == ids[r.start : r.start + r.length]
