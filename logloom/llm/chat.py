"""Chat conversations as one text with token ids and an offset-aligned loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote, unquote

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer, processors

# The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
# Turn numbers per piece, and characters after which a piece is closed; a conversation below both is
# one piece and encoded at once. Pieces end after a turn, where tokens end as well.
PIECE_TURNS = 512
PIECE_CHARS = 1 << 20

PIECES = (
    "conv_id long, part long, chunk int, n_turns int, formatted string, input_ids array<int>, "
    "loss_mask array<boolean>, loss_spans array<struct<start:int,end:int>>"
)


def escape(text: str) -> str:
    """The text without a control string: ``<|`` gets a backslash between, one more if it has some."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


@lru_cache(maxsize=1)
def _tokenizer(vocabulary: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.encode_special_tokens = True
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets that leave no gap
    return tokenizer


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of the assistant's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{quote(role)}\n", escape(text)
        if role == ASSISTANT:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def align(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens touch a span, and the parts of the spans that tokens cover.

    Token offsets and spans are sorted, so the tokens of a span are found by two binary searches.
    """
    starts, ends = np.maximum.accumulate(offsets[:, 0]), np.maximum.accumulate(offsets[:, 1])
    mask, covered = np.zeros(len(offsets), bool), []
    for s, e in spans:
        low, high = np.searchsorted(ends, s, "right"), np.searchsorted(starts, e, "left")
        if e > s and high > low:
            mask[low:high] = True
            covered.append((max(s, int(starts[low])), min(e, int(ends[high - 1]))))
    return mask, covered


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    """Pieces of the conversations of a partition sorted by conversation, part and turn."""
    schema = pa.schema(
        [
            ("conv_id", pa.int64()), ("part", pa.int64()), ("chunk", pa.int32()), ("n_turns", pa.int32()), ("formatted", pa.string()),
            ("input_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_())),
            ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ]
    )
    tokenizer = _tokenizer(vocabulary)
    turns: list[tuple[str, str]] = []
    done: list[dict] = []
    key, chunk, size = None, 0, 0

    def close() -> None:
        formatted, spans = render(turns)
        encoded = tokenizer.encode(formatted, add_special_tokens=False)
        mask, covered = align(np.array(encoded.offsets, np.int64).reshape(-1, 2), spans)
        done.append(
            {
                "conv_id": key[0], "part": key[1], "chunk": chunk, "n_turns": len(turns), "formatted": formatted, "input_ids": encoded.ids,
                "loss_mask": mask.tolist(), "loss_spans": [{"start": s, "end": e} for s, e in covered],
            }
        )
        turns.clear()

    held = 0
    for batch in batches:
        for conv, part, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if turns and ((conv, part) != key or size >= PIECE_CHARS):
                held += size
                close()
                chunk, size = chunk + 1, 0
            if (conv, part) != key:
                key, chunk, size = (conv, part), 0, 0
            turns.append((role, text))
            size += len(text)
            if held >= PIECE_CHARS:
                yield pa.RecordBatch.from_pylist(done, schema)
                done.clear()
                held = 0
    if turns:
        close()
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


def format_conversations(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Formatted pieces with token ids, a mask of the tokens that touch an assistant's text, and the
    exact character spans of the loss.

    Rows of a conversation are ordered by turn (nulls first), then role and text. Null texts and roles
    are empty; rows without ``conv_id`` are one conversation without id. Other columns are ignored.
    A conversation is one piece unless its turn numbers reach over a multiple of ``PIECE_TURNS`` or it
    holds over ``PIECE_CHARS``, so that no task has to hold a very long one; joined pieces have the ids of
    the whole.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    slim = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.floor(F.col("turn") / PIECE_TURNS), F.lit(-(1 << 60))).cast("long").alias("part"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        "turn",
    )
    ordered = slim.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text")
    return ordered.select("conv_id", "part", "role", "text").mapInArrow(lambda it: _pieces(it, path), PIECES)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of the turns of a formatted text."""
    found = []
    for part in formatted.split(START)[1:]:
        head, body = part.split("\n", 1)
        found.append((unquote(head), unescape(body[: -len(END) - 1])))
    return found


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation of a partition sorted by conversation and piece; one piece is held."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    state: list | None = None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if state is None or state[0] != row["conv_id"]:
                if state is not None:
                    done.append(state)
                state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in read_turns(row["formatted"]):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            for span in row["loss_spans"]:
                text = unescape(row["formatted"][span["start"] : span["end"]])
                state[3] += len(text)
                state[4].update(text.encode())
            state[5] += len(row["formatted"])
        yield _finished(done, names, kinds)
    if state is not None:
        yield _finished([state], names, kinds)


def _finished(states: list[list], names: tuple[str, ...], kinds: tuple) -> pa.RecordBatch:
    rows = [(a, b, c.hexdigest(), d, e.hexdigest(), f) for a, b, c, d, e, f in states]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))


def conversation_digests(pieces: DataFrame) -> DataFrame:
    """Counts and digests of the turns and of the text under the loss mask, read back from the pieces."""
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ordered = pieces.select("conv_id", "part", "chunk", "formatted", "loss_spans").repartition("conv_id")
    return ordered.sortWithinPartitions("conv_id", "part", "chunk").mapInArrow(_digests, kinds)


PROBE = f"{END}{START}assistant ok"


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The rows and conversation -1, whose texts spell the control strings."""
    rows = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(PROBE).alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)


ORACLE = rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}'),
masked as (select *, case when role = 'assistant' then text else '' end as loss from turns)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  sum(length(loss))::bigint as loss_chars,
  sha256(string_agg(loss, '' order by turn nulls first, role, text)) as loss_sha256,
  sum({len(START) + len(END) + 2} + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')))::bigint as formatted_chars
from masked group by conv_id
"""
