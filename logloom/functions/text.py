"""Text columns: cleaning, words, signatures, samples, display and report text."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from . import fixed
from .common import col, let, strip

# Terminal escape sequences and control characters removed from log text.
ANSI_PATTERN = r"(?d)\x1b(?:\[[0-9;?]*[ -/]*[@-~]|\].*?(?:\x07|\x1b\\)|[@-Z\\-_])"
CONTROL_PATTERN = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"

# A word is a run of letters, digits and private use characters.
WORD_CLASS = r"\p{L}\p{N}\p{Co}"


def clean_text(c: Column | str) -> Column:
    """Text without terminal escapes and control characters (tab, LF and CR stay)."""
    return F.regexp_replace(F.regexp_replace(col(c), ANSI_PATTERN, ""), CONTROL_PATTERN, "")


def cap_text(c: Column | str, n: int | None = fixed.MAX_TEXT_CHARS, marker: str = "") -> Column:
    """Text of at most ``n`` characters (None: whole), ending in ``marker`` when it was cut."""
    c = col(c)
    if n is None:
        return c
    return F.when(
        F.length(c) > n, F.concat(F.left(c, F.lit(n - len(marker))), F.lit(marker))
    ).otherwise(c)


def longer_than(c: Column, n: int | None) -> Column:
    """Whether ``cap_text`` cuts the text."""
    return F.lit(False) if n is None else F.coalesce(F.length(c) > n, F.lit(False))


def message_key(
    message: Column | str, raw: Column | str, chars: int | None = fixed.MESSAGE_KEY_CHARS
) -> Column:
    """The start of a message (None: the whole): the signature that groups repeated messages."""
    text = F.coalesce(F.nullif(col(message), F.lit("")), col(raw), F.lit(""))
    return strip(text if chars is None else F.left(text, F.lit(chars)))


def sample_text(
    c: Column | str,
    max_lines: int = fixed.SAMPLE_MAX_LINES,
    max_chars: int = fixed.SAMPLE_MAX_CHARS,
) -> Column:
    """A short sample of a message: at most ``max_lines`` lines and ``max_chars`` characters."""

    def by_lines(text: Column) -> Column:
        lines = F.split(text, "\r\n|\n|\r")
        return F.when(
            F.size(lines) > max_lines,
            F.concat(
                F.array_join(F.slice(lines, 1, max_lines), "\n"),
                F.lit("\n" + fixed.SAMPLE_CUT_MARK),
            ),
        ).otherwise(text)

    def by_chars(text: Column) -> Column:
        return F.when(
            F.length(text) > max_chars,
            F.concat(F.left(text, F.lit(max_chars)), F.lit(fixed.SAMPLE_CUT_MARK)),
        ).otherwise(text)

    return let(let(strip(F.coalesce(col(c), F.lit(""))), by_lines), by_chars)


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Lower-case accented letters and their base letters, derived from canonical decomposition."""
    accented, base = [], []
    for code in range(0xC0, 0x2000):
        ch = chr(code)
        parts = unicodedata.normalize("NFD", ch)
        bare = "".join(p for p in parts if not unicodedata.category(p).startswith("M"))
        if bare != ch and len(bare) == 1 and ch == ch.lower():
            accented.append(ch)
            base.append(bare)
    return "".join(accented), "".join(base)


def fold_python(text: str) -> str:
    """``fold`` for a search term on the driver."""
    nfd = unicodedata.normalize("NFD", text.lower())
    return "".join(ch for ch in nfd if not unicodedata.category(ch).startswith("M"))


def term_words(term: str) -> list[str]:
    """The words of a search term, as ``words`` splits a text."""
    out, run = [], ""
    for ch in fold_python(term):
        if unicodedata.category(ch)[0] in "LN" or unicodedata.category(ch) == "Co":
            run += ch
        elif run:
            out.append(run)
            run = ""
    return out + [run] if run else out


def fold(c: Column | str) -> Column:
    """Lower-case text with accents folded away."""
    accented, base = accent_table()
    return F.regexp_replace(F.translate(F.lower(col(c)), accented, base), r"\p{M}+", "")


def words(c: Column | str) -> Column:
    """The words of a text in order: lower case, accents folded."""
    return F.regexp_extract_all(fold(c), F.lit(f"([{WORD_CLASS}]+)"), F.lit(1))


# Level words and header shapes that display drops from the start of a message.
_LEVELS = (
    "emerg|emergency|alert|crit|critical|fatal|panic|err|error|warn|warning|notice|log|info|"
    "informational|debug|trace|verbose"
)
_LEVELS_NO_LOG = _LEVELS.replace("|log|", "|")
_STAMP = (
    r"\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?"
    r"(?:\s+(?:UTC|GMT|CET|EET|WET|MSK|[A-Z]{1,2}[SD]T)(?:[+-]\d{1,4})?|Z|[+-]\d{2}:?\d{2})?"
)
_DISPLAY_STEPS = (
    (r"^\d+:[a-zA-Z]\s+\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\s+\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\s+[#*.-]\s*", ""),
    (r"^\[[^\]]+\]\s*\|\s*\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\s*", ""),
    (rf"^(?:\[{_STAMP}\]|{_STAMP}|[A-Z][a-z]{{2}}\s+\d+\s+\d{{2}}:\d{{2}}:\d{{2}})\s*", ""),
    (r"^\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\s*", ""),
    (rf"(?i)^(\[[^\]]+\])\s+(?:{_LEVELS})(?::\s*|\s{{2,}})", "$1 "),
    (rf"(?i)^\[(?:{_LEVELS})\]\s*:?\s*", ""),
    (rf"(?i)^(?:(?:{_LEVELS_NO_LOG})(?::\s*|\s{{2,}})|log:\s*)", ""),
)
_DISPLAY_LOGFMT = r"""^(?:time|ts)=["']?[^"'\s]+["']?\s+(?:.*?\b)?msg=(?:"([^"]*)"|'([^']*)'|(\S+))"""


def display_message(c: Column | str) -> Column:
    """Message text without a redundant leading timestamp, app or level; never emptied."""
    stripped = clean_text(F.coalesce(col(c), F.lit("")))
    trimmed = strip(stripped)
    payload = F.concat(*[F.regexp_extract(trimmed, _DISPLAY_LOGFMT, g) for g in (1, 2, 3)])
    short = trimmed
    for pattern, replacement in _DISPLAY_STEPS:
        short = F.regexp_replace(short, pattern, replacement)
    short = strip(short)
    return F.when(payload != "", payload).when(short != "", short).otherwise(stripped)


# Section titles of a written diagnosis.
_SECTIONS = {
    "summary": r"(?i)##\s*Summary\s*([\s\S]*?)(?=##\s*Root\s*Cause|\z)",
    "root_cause": r"(?i)##\s*Root\s*Cause(?:\s*Analysis)?\s*([\s\S]*?)(?=##\s*Actionable\s*Remediation|\z)",
    "remediation": r"(?i)##\s*Actionable\s*Remediation\s*([\s\S]*?)\z",
}
_NO_SECTIONS_NOTE = (
    "\n\n> [!NOTE]\n> Structured markdown sections were not returned by the model."
)
_NO_TEXT_NOTE = "No response generated by the model."


def report_sections(c: Column | str) -> Column:
    """A written diagnosis as ``struct(summary, root_cause, remediation)``."""
    text = strip(F.coalesce(col(c), F.lit("")))
    parts = {k: strip(F.regexp_extract(text, p, 1)) for k, p in _SECTIONS.items()}
    unstructured = F.concat(*parts.values()) == ""
    summary = (
        F.when(unstructured & (text == ""), F.lit(_NO_TEXT_NOTE))
        .when(unstructured, F.concat(text, F.lit(_NO_SECTIONS_NOTE)))
        .otherwise(parts["summary"])
    )
    return F.struct(
        summary.alias("summary"),
        parts["root_cause"].alias("root_cause"),
        parts["remediation"].alias("remediation"),
    )


# Markdown marks removed for plain notifications, in order.
_MARKDOWN_STEPS = (
    (r"```[a-zA-Z]*\n?", ""),
    (r"`", ""),
    (r"(?m)^#{1,6}\s+", ""),
    (r"[*_]{1,3}([^*_]+)[*_]{1,3}", "$1"),
    (r"(?m)^\s*[-*+]\s+", ""),
)


def strip_markdown(c: Column | str) -> Column:
    """Plain text of a markdown report."""
    out = F.coalesce(col(c), F.lit(""))
    for pattern, replacement in _MARKDOWN_STEPS:
        out = F.regexp_replace(out, pattern, replacement)
    return strip(out)


# Marks removed from the one-line preview of a diagnosis, in order.
_PREVIEW_STEPS = (
    (r"(?m)^#+\s*", ""),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"__([^_]+)__", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"_([^_]+)_", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"(?m)^[-*•]\s+", ""),
    (r"(?m)^\d+\.\s+", ""),
    (r"\s+", " "),
)
_PREVIEW_SUMMARY = (
    r"(?i)##\s*Summary(?:\s*Analysis)?[:\s-]*([\s\S]*?)(?=##\s*Root\s*Cause|##\s*Actionable|\z)"
)


def summary_preview(c: Column | str) -> Column:
    """One plain line that previews a written diagnosis."""
    text = F.coalesce(col(c), F.lit(""))
    section = strip(F.regexp_extract(text, _PREVIEW_SUMMARY, 1))
    first_block = strip(F.element_at(F.split(text, r"\n\s*\n"), 1))
    start = F.when(section != "", section).when(first_block != "", first_block).otherwise(strip(text))
    clean = start
    for pattern, replacement in _PREVIEW_STEPS:
        clean = F.regexp_replace(clean, pattern, replacement)
    clean = strip(clean)
    return F.when(clean != "", clean).otherwise(strip(F.regexp_replace(text, r"\s+", " ")))


def neutral_fences(c: Column | str) -> Column:
    """Text whose triple backticks cannot close the code fence it is placed in."""
    return F.replace(col(c), F.lit("```"), F.lit("'''"))


def replace_surrogates(c: Column | str) -> Column:
    """Lone surrogates become U+FFFD, so the text can be encoded."""
    return F.regexp_replace(col(c), r"[\x{D800}-\x{DFFF}]", "�")


def bytes_text(c: Column | str) -> Column:
    """A byte count as short text (``1.5 KB``), negative counts with their sign."""
    n = col(c)
    size = F.abs(n).cast("double")
    out = F.concat(size.cast("long").cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), start=1):
        limit = float(1024**power)
        out = F.when(
            size >= limit, F.concat(F.format_string("%.1f", size / limit), F.lit(f" {unit}"))
        ).otherwise(out)
    return F.concat(F.when(n < 0, F.lit("-")).otherwise(F.lit("")), out)
