"""The operators over streams: Structured Streaming queries and their batch sinks."""

from .alerts import alert_segments, clamp_event_time, write_alerts
from .entries import assemble_stream
from .jobs import (
    append_batch,
    drop_replays_stream,
    fan_out,
    filter_stream,
    filtered,
    index_batch,
    late_rows_beside,
    mark_stream,
    normalize_stream,
    rate_stream,
    start,
    store_stream,
    stream_ids,
    tail_stream,
    without_replays,
)

__all__ = [n for n in dir() if not n.startswith("_")]
