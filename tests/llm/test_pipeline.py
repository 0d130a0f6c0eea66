"""The pipeline's stages one by one against brute force, its run, and odd rows."""

from collections import defaultdict

import corpus_pipeline as P
import pytest
from logloom.llm.secret_scan import learn as learn_secrets, scan
from logloom.llm.shared import table
from logloom.llm.simhash import one_of_each_group
from logloom.llm.toxicity import toxicity

from test_decontamination import plain as plain_contained
from test_packing import check as check_packed
from test_secret_scan import plain as plain_secrets
from test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def plain_one_of_each(rows):
    prints = [(k, plain_fingerprint(t)) for k, (_, t) in enumerate(rows)]
    groups = defaultdict(list)
    for k, _, component in plain_components(prints):
        groups[component].append(k)
    return sorted(min(ks, key=lambda k: (rows[k][0] is None, rows[k][0], k)) for ks in groups.values())


def test_stages(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_copies", "decontamination", "secrets", "packing"]
    docs = table(spark, SF, "documents")
    columns = docs.columns
    ids = lambda frame: {r.doc_id: r.text for r in frame.collect()}

    bad = {r.doc_id for r in toxicity(docs, table(spark, SF, "labels")).where("predicted = 1").collect()}
    clean = P.drop_toxic(spark, docs, SF)
    assert clean.columns == columns and set(ids(clean)) == set(ids(docs)) - bad

    rows = sorted(ids(docs).items())
    kept = P.drop_near_copies(spark, docs, SF)
    assert kept.columns == columns and sorted(ids(kept)) == [rows[k][0] for k in plain_one_of_each(rows)]

    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    found = {d for d, *_ in plain_contained(rows, items)}
    left = P.drop_contaminated(spark, docs, SF)
    assert left.columns == columns and found and set(ids(left)) == set(ids(docs)) - found

    masked = P.mask_secrets(spark, docs, SF)
    model, changed = learn_secrets(docs), 0
    for r in masked.collect():
        text = dict(rows)[r.doc_id]
        spans = [tuple(map(int, s.split(":")[1:])) for s in plain_secrets(text)[4]]
        tokens = next(iter(scan([text.encode()])))[1]
        if not any(model.secret(text.encode()[s:e]) for s, e in tokens):
            outside = "".join(c for k, c in enumerate(text) if not any(s <= k < e for s, e in spans))
            for kind in ("assign", "access", "hex"):
                assert r.text.count(f"[{kind}]") <= len(spans)
            stripped = r.text.replace("[assign]", "").replace("[access]", "").replace("[hex]", "")
            assert stripped == outside and r.n_chars == len(r.text)
            changed += bool(spans)
    assert masked.columns == columns and changed


def test_run(spark):
    packed = P.run(spark, SF).collect()
    docs = table(spark, SF, "documents")
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    check_packed(packed, {r.doc_id: [r.text] for r in docs.collect()})
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_odd_rows(spark, tmp_path):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, None), (3, ""), (4, "x y z"), (4, "other words of it"), (None, "lonely text here"), (None, "lonely text here")]
    frame = spark.createDataFrame([(*r, "l", "s", 3, "p", 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, fp string, _row_of_7 int").coalesce(1)
    got = sorted(((r.doc_id, r.text) for r in one_of_each_group(frame).collect()), key=str)
    assert got == sorted((rows[k] for k in plain_one_of_each(rows)), key=str)
    assert one_of_each_group(frame).columns == frame.columns
    frame.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    with_all = {(r.doc_id) for r in P.run(spark, str(tmp_path)).collect()}
    assert with_all == {1, 2, 4, None}
    frame.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert P.run(spark, f"{tmp_path}/none").collect() == []


@pytest.fixture
def tmp_path(folder):
    return folder
