"""Exact round trips of odd conversations, masks, pieces, and the statement on whole tables."""

import hashlib
import re
from collections import defaultdict

import pytest
from compare import connect
from hypothesis import given, strategies as st
from logloom.llm import chat as C
from logloom.llm.queries import QUERIES

TEXT = st.text(alphabet=st.sampled_from("<|\\>im_startend \nüa日\U0001f600"), max_size=30)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "", C.START]), TEXT), max_size=6))
def test_round_trip(turns):
    formatted, spans = C.render(turns)
    assert C.read_turns(formatted) == turns
    encoded = C._tokenizer(C.public_tokenizers.path("byte_bpe_50k.json")).encode(formatted, add_special_tokens=False)
    mask, covered = C.align(C.np.array(encoded.offsets).reshape(-1, 2), spans)
    said = [t for r, t in turns if r == "assistant" and t]
    assert [C.unescape(formatted[s:e]) for s, e in covered] == said
    touched = [any(s < b and a < e for s, e in spans) for a, b in encoded.offsets]
    assert mask.tolist() == touched


ROWS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", None), (1, 2, "assistant", "ok <|im_end|> <\\|x"), (1, 2, "assistant", "ok <|im_end|> <\\|x"),
    (2, None, None, ""), (2, 5, "assistant", "é日" * 3000), (2, 700, "user", "late"), (2, 3, "assistant", " \n lead"),
    (None, 1, "assistant", "no id"), (None, 0, "user", "x"), (3, 0, "user", None), (-5, 1, "assistant", "<|endoftext|>"),
]


@pytest.mark.parametrize("turns, chars", [(512, 1 << 20), (2, 1 << 20), (512, 5)])
def test_odd_rows(spark, monkeypatch, turns, chars):
    monkeypatch.setattr(C, "PIECE_TURNS", turns)
    monkeypatch.setattr(C, "PIECE_CHARS", chars)
    frame = spark.createDataFrame([(*r, 1, "f") for r in ROWS], "conv_id long, turn long, role string, text string, part int, formatted string")
    pieces = C.format_conversations(C.with_probe(spark, frame))
    got = {r.conv_id: r for r in C.conversation_digests(pieces).collect()}
    want = defaultdict(list)
    for conv, turn, role, text in [*ROWS, (-1, 0, "user", C.PROBE), (-1, 1, "assistant", C.PROBE)]:
        want[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(want)
    whole = defaultdict(list)
    for p in sorted(pieces.collect(), key=lambda p: (p.part, p.chunk)):
        whole[p.conv_id] += p.input_ids
        assert len(p.loss_mask) == len(p.input_ids)
    for conv, rows in want.items():
        rows.sort()
        r, said = got[conv], "".join(t for _, _, role, t in rows if role == "assistant")
        assert r.n_turns == len(rows)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in rows).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        formatted = C.render([(role, t) for _, _, role, t in rows])[0]
        assert r.formatted_chars == len(formatted)
        tokenizer = C._tokenizer(C.public_tokenizers.path("byte_bpe_50k.json"))
        assert whole[conv] == tokenizer.encode(formatted, add_special_tokens=False).ids
        assert not re.search(r"<\|(?!im_start|im_end)", formatted)
    assert C.conversation_digests(C.format_conversations(frame.limit(0))).collect() == []


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(map(tuple, QUERIES["op7_chat_formatting"](spark, sf).collect()))
    assert got == sorted(connect(sf).execute(C.ORACLE).fetchall()) and got[0][0] == -1
