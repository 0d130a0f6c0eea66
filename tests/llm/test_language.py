"""N-grams against a plain loop, filters against sets, held-out accuracy, edge rows."""

import numpy as np
from logloom.llm import language as L
from logloom.llm.queries import QUERIES
from logloom.llm.shared import table

TEXTS = ["Ab c, äß!", "", "12 34", "x", "  lange Wörter\n\nhier", "日本語 text", "a" * 5000, "éte"]


def plain_words(text):
    out = "".join(chr(L._letters()[0][ord(c)]) for c in text).split(" ")
    return [f" {w} " for w in out if w]


def test_ngrams_per_text():
    points, first = L.code_points([t.encode() for t in TEXTS])
    grams, owner, lettered = L.ngrams(points, first)
    assert lettered.tolist() == [bool(plain_words(t)) for t in TEXTS]
    seen = {}
    for k, text in enumerate(TEXTS):
        want = [w[i : i + n] for n in (3, 4, 5) for w in plain_words(text) for i in range(len(w) - n + 1)]
        assert (owner == k).sum() == len(want)
        alone = L.ngrams(*L.code_points([text.encode()]))[0]
        assert np.array_equal(np.sort(grams[owner == k]), np.sort(alone))
        for w, g in zip(want, alone.tolist(), strict=True):
            assert seen.setdefault(w, g) == g
    assert len(set(seen.values())) == len(seen)


def test_marks_alone_are_no_letters(spark):
    texts = ["\u0301", "123 \u0301", "a\u0301", "\u0301\u0302 \u0903", "\u00b5", "", "\u4e2d"]
    assert L.ngrams(*L.code_points([t.encode() for t in texts]))[2].tolist() == [False, False, True, False, True, False, True]
    rows = [(k, "some words here", "aa") for k in range(9)] + [(100 + k, t, "aa") for k, t in enumerate(texts)]
    got = {r.doc_id: r.lang_pred for r in L.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[100 + k] for k in (0, 1, 3, 5)] == ["und"] * 4 and got[102] == got[104] == got[106] == "aa"


def test_filters_hold_every_member():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 1 << 63, 60_000).astype(np.uint64)
    members = [grams[:20_000], grams[10_000:30_000], grams[:0]]
    filters = L.Filters.build(["a", "b", "c"], members)
    bits = filters.holders(grams)
    assert (bits[:20_000] & 1).all() and (bits[10_000:30_000] & 2).all() and not (bits & 4).any()
    other = filters.holders(grams[30_000:])
    assert abs((other & 1).mean() - filters.false_rate[0]) < 5e-3
    counts = filters.counts(grams, np.zeros(len(grams), np.int64), 1)
    assert np.allclose(counts[0, :2], 20_000, rtol=0.01) and counts[0, 2] == 0


def test_edge_rows(spark):
    rows = [(i, "the words of one tongue " * 3, "aa", 1) for i in range(30)]
    rows += [(i, "diese sprache klingt anders " * 3, "bb", 1) for i in range(30, 60)]
    odd = [(None, "the words", None, 1), (100, None, "aa", 1), (101, "", "bb", 1), (102, "12 !?", None, 1), (103, "sprache klingt " * 90_000, None, 2), (103, "sprache klingt " * 90_000, None, 2), (104, "ÿŷ", None, 3)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score int")
    got = L.languages(docs).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(r.lang_pred == ("aa" if r.doc_id < 30 else "bb") for r in got if r.doc_id is not None and r.doc_id < 60)
    by = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in got}
    assert by[100] == by[101] == by[102] == ("und", 0) and by[103][0] == "bb" and by[None][0] == "aa" and by[104] == ("aa", 0)
    assert L.languages(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in L.languages(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_any_number_of_languages(spark):
    """130 languages, each of words of its own, fill three planes."""
    def text(k):
        return " ".join(f"{a}{chr(0x4E00 + k)}{b}" for a in "abc" for b in "xyz")

    rows = [(10 * k + i, text(k), f"l{k:03}") for k in range(130) for i in range(10)]
    got = L.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows) and all(r.lang_pred == f"l{r.doc_id // 10:03}" for r in got)


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op4_language_id"](spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    right, all_ = got.where("held_out").selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    assert right / all_ > 0.98


def test_sample_is_bounded_however_often_an_id_repeats(spark, monkeypatch):
    import zlib

    learnt = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, f"text {i}", "aa") for i in learnt] + [(learnt[0], f"copy {k}", "aa") for k in range(3000)] + [(learnt[1], f"{k} " + "x" * 190_000, "bb") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(L, "SAMPLE_ROWS", 80)
    monkeypatch.setattr(L, "SAMPLE_TOTAL", 1 << 20)
    found = L.sample(docs).where("text is not null").collect()
    sizes = {lang: [len(r.text) for r in found if r.lang == lang] for lang in ("aa", "bb")}
    assert len(sizes["aa"]) <= 100 and 0 < sum(sizes["bb"]) <= 1 << 20
    assert len(L.languages(docs).collect()) == len(rows)
