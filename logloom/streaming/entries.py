"""Multi-line entries put together while lines arrive."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.assemble import EntryFold, Limits, _ends_traceback, is_continuation


# Streams share the keyed state of a bucket: calls of state, not lines, take most of the time of short streams.
BUCKETS = 2048


class OpenEntry(StatefulProcessor):
    """The lines of the streams of a bucket in keyed state, by slices of time, and their open entries.

    Frames of lines are put away as they come, in any order. When the watermark has passed a slice, its
    lines are sorted and folded by stream; so what is held in memory is one slice of one bucket, however
    many lines of it a micro-batch brings. An entry left open is given out once the watermark has
    passed its time and no line that may continue it is waiting.
    """

    def __init__(self, keep: list[str], limits: Limits, slice_ms: int):
        self.keep, self.limits, self.slice_ms = keep, limits, slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "fold binary")
        self.parts = handle.getMapState("parts", "slice long", "n int")
        self.lines = handle.getMapState("lines", "slice long, part int", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for number, some in frame.groupby(frame["line_now"] // (self.slice_ms * 1000)):
                at = int(number)
                n = self.parts.getValue((at,))[0] if self.parts.containsKey((at,)) else 0
                self.lines.updateValue((at, n), (pickle.dumps(some),))
                self.parts.updateValue((at,), (n + 1,))
                if n == 0:
                    self.handle.registerTimer((at + 1) * self.slice_ms)
        return iter(())

    def _take_slice(self, at: int) -> list[dict]:
        """The lines of a slice in order; they leave the state."""
        if not self.parts.containsKey((at,)):
            return []
        frames = []
        for part in range(self.parts.getValue((at,))[0]):
            frames.append(pickle.loads(bytes(self.lines.getValue((at, part))[0])))
            self.lines.removeKey((at, part))
        self.parts.removeKey((at,))
        return pd.concat(frames).sort_values(["received_at", "seq"]).to_dict("records")

    def _waiting(self, first: int, last: int) -> bool:
        """Whether one of some slices holds lines."""
        if last - first > 64:
            return any(first <= k[0] <= last for k in self.parts.keys())
        return any(self.parts.containsKey((at,)) for at in range(first, last + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ended = expiredTimerInfo.getExpiryTimeInMs()
        at = ended // self.slice_ms - 1
        folds, out = {}, []
        if known := self.entry.exists():
            folds = pickle.loads(bytes(self.entry.get()[0]))
        for row in self._take_slice(at):
            if row["stream_key"] not in folds:
                folds[row["stream_key"]] = EntryFold(self.limits)
            line = {c: row[c] for c in self.keep}
            out += folds[row["stream_key"]].add(line, row["line_now"], row["line_cont"], row["line_blank"], row["line_ends"])
        passed, waiting = max(ended, timerValues.getCurrentWatermarkInMs()), {}
        for fold in folds.values():
            if fold.first is None:
                continue
            wait = self.limits.micros - (fold.last - fold.start)
            if self.limits.gap is not None:
                wait = min(wait, self.limits.gap_micros)
            due = (fold.last + max(wait, 0)) // 1000 + 1
            last = due // self.slice_ms
            if last not in waiting:
                waiting[last] = self._waiting(at + 1, last)
                if not waiting[last] and (last + 1) * self.slice_ms > passed:
                    self.handle.registerTimer((last + 1) * self.slice_ms)
            if not waiting[last] and due <= passed:
                out += fold.take()
        folds = {stream: fold for stream, fold in folds.items() if fold.first is not None}
        if folds:
            self.entry.update((pickle.dumps(folds),))
        elif known:
            self.entry.clear()
        if out:
            yield pd.DataFrame(out, columns=[*self.keep, "line_count"])

    def close(self) -> None:
        pass


def assemble_stream(
    lines: DataFrame, limits: Limits | None = None, delay: str = "5 seconds", slice_seconds: float = 1.0
) -> DataFrame:
    """Entries of a stream of lines, as ``assemble_multiline`` gives for stored lines.

    Lines may arrive in any order within ``delay``; they are folded by slices of ``slice_seconds`` of their
    arrival time once the watermark has passed them. State is kept by buckets of stream keys. Needs the
    RocksDB state store provider.
    """
    limits = limits or Limits()
    keep = lines.columns
    message = F.col("message")
    flagged = lines.withWatermark("received_at", delay).withColumns(
        {
            "line_cont": is_continuation(message),
            "line_blank": message == "",
            "line_ends": ~is_continuation(message) & _ends_traceback(message),
            "line_now": F.unix_micros("received_at"),
            "line_bucket": F.pmod(F.xxhash64("stream_key"), F.lit(BUCKETS)).cast("int"),
        }
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema)
    return flagged.groupBy("line_bucket").transformWithStateInPandas(
        OpenEntry(keep, limits, max(1, round(slice_seconds * 1000))), schema + ", line_count int", "Append", "EventTime"
    )
