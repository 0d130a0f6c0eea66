"""Multi-line entries put together from lines, orphan lines attached, replays dropped.

Lines carry ``stream_key``, ``received_at``, ``seq`` (the order of lines inside one stream),
``message``, ``raw`` and ``severity``; other columns are taken from an entry's first line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.common import contains_any, strip
from .ordered import CHUNK, running, time_chunk

# What a continuation line looks like.
_STARTS_ANY_CASE = ("caused by:", "traceback", "goroutine ", "stack backtrace:")
_STARTS = ("at ", "...")
_CHAINED = (
    "during handling of the above exception",
    "the above exception was the direct cause",
    "exception group traceback",
)
EXCEPTION_LINE = (
    r"^(?:[a-zA-Z_]\w*+\.)*+[a-zA-Z_]\w*"
    r"(?:Error|Exception|Warning|Interrupt|Exit|Fault|Notice|Iteration)(?::\s*.*)?$"
)
TRACEBACK_END_LINE = r"^([a-zA-Z_][a-zA-Z0-9_.]*):(?:\s|$)"
_PYTHON_MARKS = ("traceback (most recent call last):", 'file "')


def is_continuation(line: Column) -> Column:
    """Lines that continue an entry whatever it holds."""
    low = F.lower(strip(line))
    out = line.rlike("^[ \t]")
    for s in _STARTS_ANY_CASE:
        out = out | low.startswith(s)
    for s in _STARTS:
        out = out | line.startswith(s)
    out = out | contains_any(low, _CHAINED) | strip(line).rlike(EXCEPTION_LINE)
    return F.coalesce(out, F.lit(False)) & (line != "")


def _ends_traceback(line: Column) -> Column:
    name = F.lower(F.regexp_extract(strip(line), TRACEBACK_END_LINE, 1))
    return strip(line).rlike(TRACEBACK_END_LINE) & ~name.isin(*fixed.SEVERITY_CODES)


def is_conditional(line: Column) -> Column:
    """Lines that continue only an entry that already holds a traceback."""
    return (line == "") | (~is_continuation(line) & _ends_traceback(line))


def has_traceback_mark(line: Column) -> Column:
    low = F.lower(line)
    return low.contains("traceback") | low.contains(_PYTHON_MARKS[1])


@dataclass
class Limits:
    """Limits of one entry; times are arrival times in seconds."""

    lines: int = fixed.ENTRY_MAX_LINES
    bytes: int = fixed.ENTRY_MAX_BYTES
    chars: int = fixed.MAX_TEXT_CHARS
    seconds: float = fixed.ENTRY_MAX_SECONDS
    gap: float | None = fixed.ENTRY_GAP_SECONDS

    @property
    def gap_micros(self) -> int | None:
        return None if self.gap is None else round(self.gap * 1_000_000)

    @property
    def micros(self) -> int:
        return round(self.seconds * 1_000_000)


@dataclass
class EntryFold:
    """The lines of one stream in order, put into entries under the limits.

    ``add`` takes a line with its arrival in microseconds and its kind (``continues``, ``conditional`` with what it needs) and
    returns the entries that it completes.
    """

    limits: Limits
    first: dict | None = None
    messages: list[str] = field(default_factory=list)
    raws: list[str] = field(default_factory=list)
    severity: int = 7
    chars: int = 0
    raw_chars: int = 0
    bytes: int = 0
    start: int = 0
    last: int = 0
    traceback: bool = False
    python: bool = False

    def take(self) -> list[dict]:
        """The open entry, if any, and an empty start."""
        if self.first is None:
            return []
        message = "\n".join(self.messages)
        entry = {
            **self.first,
            "message": message,
            "raw": "\n".join(self.raws),
            "severity": self.severity,
            "line_count": len(self.messages),
        }
        self.__init__(self.limits)
        return [entry] if message.strip() else []

    def expired(self, now: int) -> bool:
        gap = self.limits.gap_micros
        return self.first is not None and (
            (gap is not None and now - self.last > gap) or now - self.start >= self.limits.micros
        )

    def add(self, line: dict, now: int, continues: bool, blank: bool, ends: bool) -> list[dict]:
        out = self.take() if self.expired(now) else []
        joins = continues or (blank and self.traceback) or (ends and self.python)
        if not joins:
            out += self.take()
            if not line["message"].strip():
                return out
        message, raw = line["message"], line["raw"] or ""
        severity = line["severity"]
        cap = self.limits.chars
        if self.first is not None and (
            self.chars + 1 + len(message) > cap or self.raw_chars + 1 + len(raw) > cap
        ):
            severity = min(severity, self.severity)
            out += self.take()
        joiner = 0
        if self.first is None:
            self.first, self.start = line, now
            self.severity = severity
        else:
            joiner = 1
        self.messages.append(message)
        self.raws.append(raw)
        self.severity = min(self.severity, severity)
        self.chars += joiner + len(message)
        self.raw_chars += joiner + len(raw)
        self.bytes += max(len(message.encode()), len(raw.encode()))
        self.last = now
        low = message.lower()
        self.traceback = self.traceback or "traceback" in low
        self.python = self.python or any(m in low for m in _PYTHON_MARKS)
        if len(self.messages) >= self.limits.lines or self.bytes >= self.limits.bytes:
            out += self.take()
        return out


def _fold_lines(lines: DataFrame, keep: list[str], limits: Limits) -> DataFrame:
    """Entries of blocks that need their lines in order: limits or a traceback decide there.

    Blocks arrive sorted in a stream and one entry is held at a time, so a block has no size
    limit.
    """
    fields = [lines.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, EntryFold(limits)
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                here = (row["stream_key"], row["_block"], row["_part"])
                if here != key:
                    out += state.take()
                    key = here
                out += state.add(
                    {c: row[c] for c in keep}, row["_now"], row["_cont"], row["_blank"], row["_ends"]
                )
            yield pd.DataFrame(out, columns=[*keep, "line_count"])
        yield pd.DataFrame(state.take(), columns=[*keep, "line_count"])

    return (
        lines.repartition("stream_key", "_block", "_part")
        .sortWithinPartitions("stream_key", "_block", "_part", "received_at", "seq")
        .mapInPandas(fold, schema + ", line_count int")
    )


def assemble_multiline(
    lines: DataFrame, limits: Limits | None = None, chunk_seconds: int = 60
) -> DataFrame:
    """Entries of the lines, with ``line_count``; blank entries are dropped.

    A line continues the entry before it on its stream when it looks like a continuation and
    follows within the gap. Streams are first cut where an entry certainly starts; the blocks in
    between are independent, so one busy stream spreads over many tasks. Most blocks are joined
    by an aggregate; only those that reach a limit or hold a traceback with lines that depend on
    it are folded line by line.
    """
    limits = limits or Limits()
    keep = lines.columns
    order = ["received_at", "seq"]
    message = F.col("message")
    cut = lines.withColumns(
        {
            CHUNK: time_chunk("received_at", chunk_seconds),
            "_cont": is_continuation(message),
            "_blank": message == "",
            "_mark": has_traceback_mark(message),
            "_now": F.unix_micros("received_at"),
        }
    ).withColumn("_ends", ~F.col("_cont") & _ends_traceback(message))
    if limits.gap is not None:
        cut = running(
            cut, ["stream_key"], order, {"_prev": ("last", F.col("received_at"))}, inclusive=False
        )
        waited = (F.unix_micros("received_at") - F.unix_micros("_prev")) > limits.gap_micros
        late = F.col("_prev").isNull() | waited
    else:
        late = F.lit(False)
    sure_start = late | ~(F.col("_cont") | F.col("_blank") | F.col("_ends"))
    cut = running(
        cut.withColumn("_start", sure_start),
        ["stream_key"],
        order,
        {"_block": ("last", F.when(F.col("_start"), F.col("seq")))},
    ).drop(CHUNK)
    cut = cut.withColumn("_block", F.coalesce("_block", F.lit(-1)))

    in_block = Window.partitionBy("stream_key", "_block")
    cut = cut.withColumn("_tb", F.max("_mark").over(in_block))
    # Without a traceback in the block, conditional lines start a new part of it
    splits = ~F.col("_tb") & (F.col("_blank") | F.col("_ends"))
    part = F.last(F.when(splits, F.col("seq")), ignorenulls=True).over(
        in_block.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    cut = cut.withColumn("_part", F.coalesce(part, F.lit(-1)))
    opens = F.col("_start") | splits
    # A blank line that continues nothing only ends the entry before it
    cut = cut.filter(~(opens & ~F.col("_cont") & (strip(message) == "")))

    group = ["stream_key", "_block", "_part"]
    w = Window.partitionBy(*group)
    size = F.count(F.lit(1)).over(w)
    chars = F.sum(F.length("message") + 1).over(w)
    raw_chars = F.sum(F.length(F.coalesce("raw", F.lit(""))) + 1).over(w)
    octets = F.sum(F.greatest(F.octet_length("message"), F.octet_length("raw"))).over(w)
    span = F.max("_now").over(w) - F.min("_now").over(w)
    depends = F.max(F.col("_tb") & (F.col("_blank") | F.col("_ends"))).over(w)
    hard = (
        (size > limits.lines)
        | (octets >= limits.bytes)
        | (chars > limits.chars + 1)
        | (raw_chars > limits.chars + 1)
        | (span >= limits.micros)
        | depends
    )
    sized = cut.withColumn("_hard", (size > 1) & hard)
    rest = [c for c in keep if c not in ("stream_key", "message", "raw", "severity")]
    place = F.struct("received_at", "seq")

    def joined(c: str) -> Column:
        ordered = F.sort_array(F.collect_list(F.struct("received_at", "seq", F.coalesce(c, F.lit("")).alias("t"))))
        return F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias(c)

    plain = (
        sized.filter(~F.col("_hard"))
        .groupBy(*group)
        .agg(
            F.min_by(F.struct(*rest), place).alias("_first"),
            joined("message"),
            joined("raw"),
            F.min("severity").alias("severity"),
            F.count(F.lit(1)).cast("int").alias("line_count"),
        )
        .select("stream_key", "_first.*", "message", "raw", "severity", "line_count")
        .filter(strip(message) != "")
    )
    folded = _fold_lines(sized.filter("_hard"), keep, limits)
    return plain.select(*keep, "line_count").unionByName(folded)


NAMELESS = ("unknown", "-", "")


def attach_orphan_lines(
    lines: DataFrame, gap: float = fixed.ENTRY_GAP_SECONDS, chunk_seconds: int = 60
) -> DataFrame:
    """Lines without an app (or with an exception name as app) that continue their sender's open
    named entry take over its app, host name and alias, where the columns exist.

    ``stream_key`` becomes ``source_ip:app_name`` of the result.
    """
    app = F.coalesce("app_name", F.lit(""))
    orphan = app.isin(*NAMELESS) | app.rlike(EXCEPTION_LINE)
    text, raw = F.col("message"), F.coalesce("raw", F.col("message"))
    by_message, by_raw = is_continuation(text), is_continuation(raw)
    conditional = is_conditional(text)
    inherited = [c for c in ("app_name", "hostname", "source_alias") if c in lines.columns]
    parent = F.struct(*inherited)
    marked = lines.withColumns(
        {
            "_orphan": orphan,
            "_by_message": by_message,
            "_by_raw": by_raw,
            "_conditional": conditional,
            "_mark": has_traceback_mark(text),
        }
    )
    named = ~F.col("_orphan")
    linked = named | F.col("_by_message") | F.col("_by_raw") | F.col("_conditional")
    seen = running(
        marked,
        ["source_ip"],
        ["received_at", "seq"],
        {
            "_parent": ("last", F.when(named, parent)),
            "_last": ("last", F.when(linked, F.col("received_at"))),
            "_marked": ("last", F.when(F.col("_mark"), F.struct("received_at", "seq"))),
            "_started": (
                "last",
                F.when(named & ~F.col("_by_message"), F.struct("received_at", "seq")),
            ),
        },
        ts="received_at",
        chunk_seconds=chunk_seconds,
        inclusive=False,
    )
    in_time = F.unix_micros("received_at") - F.unix_micros("_last") <= round(gap * 1_000_000)
    in_trace = F.coalesce(F.col("_marked") >= F.col("_started"), F.lit(False))
    continues = F.col("_by_message") | F.col("_by_raw") | (F.col("_conditional") & in_trace)
    joins = F.coalesce(
        F.col("_orphan") & F.col("_parent").isNotNull() & in_time & continues, F.lit(False)
    )
    whole = joins & F.col("_by_raw") & ~F.col("_by_message")
    out = seen.withColumns({"_joins": joins, "_whole": whole})
    changed = {c: F.when(F.col("_joins"), F.col(f"_parent.{c}")).otherwise(F.col(c)) for c in inherited}
    changed["message"] = F.when(F.col("_whole"), F.col("raw")).otherwise(F.col("message"))
    out = out.withColumns(changed)
    stream = F.concat_ws(":", "source_ip", F.coalesce("app_name", F.lit("unknown")))
    rest = [c for c in lines.columns if c != "stream_key"]
    return out.select(*rest, stream.alias("stream_key"))


def drop_replays(
    lines: DataFrame,
    key: str = "container_id",
    ts: str = "ts",
    order: str = "seq",
    chunk_seconds: int = 60,
) -> DataFrame:
    """Lines without those a reconnect delivered again: older than the newest seen, or equal to
    one seen at the same time. Lines without a time stay.

    Repeats are reduced by an aggregate, so any number of copies of one line is no burden.
    """
    timed = lines.filter(F.col(ts).isNotNull()).withColumn(
        CHUNK, F.floor(F.col(order) / 100_000).cast("long")
    )
    seen = running(
        timed, [key], [order], {"_newest": ("max", F.col(ts))}, ts=ts, inclusive=False
    ).drop(CHUNK)
    fresh = seen.filter(F.col("_newest").isNull() | (F.col(ts) >= F.col("_newest")))
    cols = [c for c in lines.columns if c not in (key, ts, "message")]
    once = fresh.groupBy(key, ts, "message").agg(
        F.min_by(F.struct(*cols), F.col(order)).alias("_line")
    )
    kept = once.select(key, ts, "message", "_line.*").select(*lines.columns)
    return kept.unionByName(lines.filter(F.col(ts).isNull()))

