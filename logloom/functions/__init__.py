"""Columns built from native Spark functions."""

from .lines import clock_text, host_of, project_entry, prompt_line
from .network import extract_ip
from .patterns import wildcard_match
from .redact import redact, redact_table, secret_hits
from .severity import (
    content_severity,
    decode_pri,
    detect_severity,
    severity_code,
    severity_label,
    severity_short,
)
from .structured import structured_data, structured_params
from .text import (
    bytes_text,
    cap_text,
    clean_text,
    display_message,
    fold,
    message_key,
    neutral_fences,
    report_sections,
    sample_text,
    strip_markdown,
    summary_preview,
    words,
)
from .times import (
    container_ts,
    correct_future,
    infer_year,
    normalize_ts,
    parse_epoch,
    parse_iso,
    parse_ts,
    resolve_naive,
)

__all__ = [n for n in dir() if not n.startswith("_")]
