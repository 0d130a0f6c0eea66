"""The audit against a walk through every order, the matrix against plain counts, odd rows."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pyarrow as pa
import pytest
from logloom.llm import filter_audit as A


def fails(rows):
    least = {}
    for i, _, text in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, lang, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        found = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and i > least[text],
        }
        yield i, lang or "", {f for f in "ABCDE" if found[f]}


def walk(rows, labels):
    good, toxic = {i for i, q, _ in labels if i is not None and q == 1}, {i for i, _, t in labels if i is not None and t == 1}
    want, rows = {}, list(fails(rows))
    for part in {p for _, p, _ in rows}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = [(i, f) for i, p, f in rows if p == part]
            for k, x in enumerate(order):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                mine = [f for _, p, f in rows if p == part and x in f]
                shapley[x] += len(gone)
                want[part, "".join(order), k + 1] = [
                    len(left), len(gone), len(mine) - len(gone), sum(f == {x} for f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
        for (p, order, k), row in want.items():
            if p == part:
                row.append(shapley[order[k - 1]])
    return {k: tuple(v) for k, v in want.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    pool = [f"word{k}" for k in range(500)]
    texts = ["", None, " \t\n", " ", "A" * 7, "x #", "A B C" + " d" * 300, "same"]
    texts += [" ".join(rng.choices(pool[: rng.choice([3, 90, 500])], k=rng.choice([1, 199, 200, 230]))) for _ in range(60)]
    texts += [t + rng.choice(["", " |", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 5]) for t in texts[8:40]] + ["one\x00two\x85three four\x0b\x0cfive " * 40]
    texts += ["repeated copy"] * 80 + ["y" * 300_000]
    found = [(k, rng.choice(["en", "de", None, ""]), t) for k, t in enumerate(texts)]
    rng.shuffle(found)
    return found + [(None, "en", "same"), (None, "xx", "alone"), (3, "en", "same"), found[0], found[0], (7, "fr", "same")]


def test_every_order(spark, rows):
    labels = [(k, k % 2, k % 3 % 2) for k in range(0, 120, 2)] + [(None, 1, 1), (5, None, 1), (5, 0, 0), (7, None, None)]
    docs = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "doc_id long, lang string, text string, n int, mask int, digest string")
    known = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in A.filter_audit(docs, known).collect()}
    assert got == walk(rows, labels)
    assert A.filter_audit(docs.limit(0), known).collect() == []
    assert len(A.filter_audit(docs.limit(1), known.limit(0)).collect()) == 600


def test_matrix_holds_all_counts(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    words, seed = A.word_dictionary(docs)
    word = {r.code: r.word for r in words.collect()}
    got = []
    shards = A.term_matrix(docs, seed).collect()
    assert len(shards) >= 8
    for s in shards:
        for k, row in enumerate(s.rows):
            at = slice(s.indptr[k], s.indptr[k + 1])
            got.append((row.doc_id, frozenset(zip((word[c] for c in s.indices[at]), s.data[at], strict=True))))
    plain = [(i, frozenset(Counter(re.findall(r"[^\x20\x09-\x0D]+", t or "")).items())) for i, _, t in rows]
    assert Counter(got) == Counter(plain)


def test_codes_that_clash_take_another_seed(spark):
    docs = spark.createDataFrame([(1, "a b c a b"), (2, "c d e")], "doc_id long, text string")
    seeds = set()
    for bits in (3, 4, 5):
        words, seed = A.word_dictionary(docs, bits)
        seeds.add(seed)
        found = {r.code: r.word for r in words.collect()}
        assert sorted(found.values()) == list("abcde")
        for word in "abcde":
            assert found[A.codes(pa.array([word]), seed, bits)[0]] == word
    assert max(seeds) > 0


def test_rows_by_text_group(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = defaultdict(int)
    for r in A.filter_flags(docs, labels).collect():
        got[r.part, r.mask] += r.n
    assert got == Counter((p, sum(1 << "ABCDE".index(x) for x in f)) for _, p, f in fails(rows))


def test_slices_of_any_size():
    texts = pa.array(["", " a  b", "c " * 50, "b", "", "\n"])
    rows = pa.array([{"doc_id": k} for k in range(6)])
    whole = [pa.RecordBatch.from_arrays([rows, texts], ["row", "text"])]
    want = [[], ["a", "b"], ["c"], ["b"], [], []]
    word = {int(A.codes(pa.array([w]), 0)[0]): w for w in "abc"}
    for size in (1, 10, 1000):
        A.SLICE_BYTES, kept = size, A.SLICE_BYTES
        try:
            shards = [s.to_pylist()[0] for s in A._shards(whole, 0, 64)]
        finally:
            A.SLICE_BYTES = kept
        found = [sorted(word[c] for c in s["indices"][a:b]) for s in shards for a, b in zip(s["indptr"], s["indptr"][1:])]
        assert found == want and [r["doc_id"] for s in shards for r in s["rows"]] == list(range(6))
        assert sum(sum(s["data"]) for s in shards) == 53
