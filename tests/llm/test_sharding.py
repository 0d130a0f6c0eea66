"""Balance, slots and rows of the shards; overfull ranges; plans without Python."""

import random
import zlib
from collections import defaultdict

import pytest
from logloom.llm import sharding as S
from logloom.llm.shared import table


def check(got, texts, shards=16):
    want = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == want
    bytes_, slots = [0] * shards, defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        bytes_[r.shard] += r.size
        slots[r.shard].append(r.slot)
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))
    assert max(bytes_) - min(bytes_) <= 2 * max(s for _, s, _ in want)


@pytest.mark.parametrize("samples", [16, 0.02])
def test_copies_and_odd_rows(spark, monkeypatch, samples):
    monkeypatch.setattr(S, "SAMPLES", samples)
    rng = random.Random(1)
    texts = [(i, "same text") for i in range(900)] + [(i, "x" * rng.randint(0, 400)) for i in range(900, 2000)]
    texts += [(2000, None), (2001, ""), (2002, "ü" * 300), (7, "same text"), (7, "same text")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in texts], "doc_id long, text string, size int, shard int, key int, uid int")
    check(S.shard_documents(docs).collect(), texts)
    assert S.shard_documents(docs.limit(0)).collect() == []
    few = [(1, "a"), (2, None)]
    assert len(S.shard_documents(spark.createDataFrame(few, "doc_id long, text string")).collect()) == 2
    null = spark.createDataFrame([(None, "a")], "doc_id long, text string")
    assert S.shard_documents(null).first().doc_id is None


def test_documents_without_python(spark, folder):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    frame = S.shard_documents(docs)
    check(frame.collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert "Python" not in frame._jdf.queryExecution().toString() and "Arrow" not in frame._jdf.queryExecution().toString()
    S.write_shards(docs, f"{folder}/shards", 4)
    assert spark.read.parquet(f"{folder}/shards").groupBy("shard").count().count() == 4
