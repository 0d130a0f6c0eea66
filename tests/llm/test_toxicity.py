"""The chain sums against all tag sequences, spans and scores on planted words, edge rows."""

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from logloom.llm import toxicity as T
from logloom.llm.queries import QUERIES
from logloom.llm.shared import table
from pyspark.sql import functions as F


@pytest.mark.parametrize("lane", [3, 128])
def test_marginals_equal_enumeration(monkeypatch, lane):
    monkeypatch.setattr(T, "_LANE", lane)
    rng = np.random.default_rng(3)
    sizes = [0, 1, 7, 3, 0, 9]
    first = np.concatenate([[0], np.cumsum(sizes)])
    emission, move = rng.normal(size=first[-1]) * 2, np.exp(rng.normal(size=(2, 2)))
    got, moves = T.Chains(first).marginals(emission, move, pairs=True)
    total = np.zeros((2, 2))
    for a, b in itertools.pairwise(first):
        mass, ones, pair = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=b - a):
            w, last, seen = 1.0, 0, np.zeros((2, 2))
            for t, e in zip(tags, emission[a:b]):
                w *= move[last][t] * np.exp(e * t)
                seen[last][t] += 1
                last = t
            mass, ones, pair = mass + w, ones + w * np.array(tags), pair + w * seen
        assert np.allclose(got[a:b], ones / mass)
        total += pair / mass
    assert np.allclose(moves, total)


def test_words_and_hashes():
    texts = ["Ab, aB über", "", "x" * 9 + " ab", "b"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    words = T.find_words(data, offsets)
    assert np.array_equal(T.find_all([t.encode() for t in texts]).affixes, words.affixes)
    assert words.first.tolist() == [0, 3, 3, 5, 6]
    assert [bytes(data[s:e]).decode() for s, e in zip(words.starts, words.ends)] == ["Ab", "aB", "über", "x" * 9, "ab", "b"]
    assert words.hashes[0] == words.hashes[1] == words.hashes[4] and len(set(words.hashes.tolist())) == 4
    assert words.affixes[0, 0] == 0 and words.affixes[1, 3] != 0


def made(n, seed):
    rng = random.Random(seed)
    words = ["one", "two", "three", "four", "five", "sixes", "seven", "über", "nine"]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(3, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(["Grobian", "flegelhaft"]))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_planted_words(spark):
    rows = made(600, 1)
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows] + [(None, "one", "x", 0.1), (9000, None, "x", 0.1), (9001, "", "x", 0.1), (9002, "Grobian! " * 40_000, "x", 0.1), (0, rows[0][1], "x", 0.5)], "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, 1, y, "e") for i, _, y in rows] + [(None, 1, 1, "e"), (9001, 1, None, "e"), (1, 1, 0, "e")], "doc_id long, quality int, toxic int, text string")
    got = T.toxicity(docs, labels).collect()
    assert len(got) == 605
    want = {i: y for i, _, y in rows}
    texts = {i: t for i, t, _ in rows}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.doc_id in want:
            assert r.predicted == want[r.doc_id]
            words = [texts[r.doc_id][s.start : s.end] for s in r.spans]
            assert all(set(w.split()) <= {"Grobian", "flegelhaft"} for w in words) and bool(words) == bool(want[r.doc_id])
    by = {r.doc_id: r for r in got}
    assert by[None].held_out and by[9002].predicted == 1 and by[9000].score == by[9001].score < 0.7
    assert T.toxicity(docs.limit(0), labels).collect() == []
    assert {r.score for r in T.toxicity(docs, labels.limit(0)).collect()} == {0.5}


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op1_toxicity"](spark, sf).join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in got.where("held_out").groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.88 and n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.03
    assert got.where(F.col("score").isNull()).count() == 0


def test_marking_and_finding_words_need_little_memory_per_word():
    rng = np.random.default_rng(5)
    stems = [f"word{k}" for k in range(3000)]
    texts = [" ".join(rng.choice(stems, 300)).encode() for _ in range(800)]
    toxic = np.arange(800) % 4 == 0
    tracemalloc.start()
    words = T.find_all(texts)
    found = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    T.mark_words(words, toxic.astype(np.int64))
    marked = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = len(words.hashes)
    assert found < 120 * n
    assert marked < 120 * n


def test_shares_count_as_one():
    rng = np.random.default_rng(6)
    keys, units = rng.integers(0, 50, 4000).astype(np.uint64), rng.integers(0, 300, 4000).astype(np.uint64)
    label = (units % 3 == 0).astype(np.int8)
    whole = T._nearly_all(keys, units, label, np.zeros(4000, np.uint8))
    parts = T._nearly_all(keys, units, label, (units % T._SHARES).astype(np.uint8))
    for a, b in zip(whole, parts):
        assert np.array_equal(a, b)


def test_batches_for_python_are_bounded_in_bytes(spark, tmp_path):
    spark.createDataFrame([(k, "x" * 1000) for k in range(9000)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes], pa.int64())})

    rows = table(spark, str(tmp_path), "documents").mapInArrow(sizes, "n long").collect()
    assert len(rows) > 1 and max(r[0] for r in rows) < 5 << 20
