"""Severity columns: names, codes, labels, priority values and detection in text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed
from .common import col, contains_any, let, lookup, strip
from .patterns import required_texts
from .text import clean_text


def severity_of_name(c: Column) -> Column:
    return lookup(fixed.SEVERITY_CODES, F.lower(c))


def severity_code(c: Column | str, strict: bool = False) -> Column:
    """Code 0-7 of a number, digit string or name; otherwise null, or an error when strict."""
    text = F.lower(strip(col(c).cast("string")))
    number = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
    code = F.when(number.between(0, 7), number).otherwise(severity_of_name(text))
    if not strict:
        return code
    failed = F.raise_error(F.concat(F.lit("not a severity: "), text))
    return F.when(text.isNull() | (text == ""), F.lit(None).cast("int")).otherwise(
        F.coalesce(code, failed.cast("int"))
    )


def severity_label(c: Column | str) -> Column:
    """Long lower-case label of a code, 'unknown' for anything else."""
    labels = dict(enumerate(fixed.SEVERITY_LABELS))
    return F.coalesce(lookup(labels, col(c).cast("int")), F.lit("unknown"))


def severity_short(c: Column | str) -> Column:
    """Short upper-case label of a code (``SEV9`` for codes outside 0-7)."""
    code = col(c).cast("int")
    labels = dict(enumerate(fixed.SEVERITY_SHORT))
    return F.coalesce(lookup(labels, code), F.concat(F.lit("SEV"), code.cast("string")))


PRI_PATTERN = r"^<(\d{1,3})>"


def decode_pri(c: Column | str) -> Column:
    """``struct(facility, severity)`` of a leading ``<N>``, or null without one."""
    c = col(c)
    pri = F.when(c.rlike(PRI_PATTERN), F.regexp_extract(c, PRI_PATTERN, 1).cast("int"))
    return F.when(
        pri.isNotNull(),
        F.struct(
            F.floor(pri / 8).cast("int").alias("facility"), (pri % 8).cast("int").alias("severity")
        ),
    )


# Where a level may stand in a line, in the order they are tried.
_LEVEL_SPOTS = (
    r"""\b(?:level|lvl|severity)\s*=\s*["']?([a-zA-Z]+)["']?""",
    r"""["'](?:level|severity)["']\s*:\s*["']([a-zA-Z]+)["']""",
    r"\[\s*([a-zA-Z]+)\s*\]",
    r"(?:^|[\s\]])([a-zA-Z]+):(?:\s|$)",
    (
        r"^(?:[0-9T:.,Z+-]{8,}|\w{3}\s+\d+\s+[0-9:]{8})(?:\s+[0-9:.,Z+-]+)?"
        r"(?:\s+(?:UTC|GMT|CET|EET|WET|MSK|[A-Z]{1,2}[SD]T))?\s+\[?([a-zA-Z]+)\]?\b"
    ),
)


def detect_severity(c: Column | str, chars: int | None = fixed.SEVERITY_HEADER_CHARS) -> Column:
    """Severity that the first ``chars`` characters of a line state (None: the whole line), 6 when
    they state none."""

    def from_header(header: Column) -> Column:
        found = []
        for pattern in _LEVEL_SPOTS:
            needles = required_texts(pattern)
            names = F.regexp_extract_all(header, F.lit(pattern), F.lit(1))
            codes = F.filter(F.transform(names, severity_of_name), lambda x: x.isNotNull())
            first = F.get(codes, 0)
            found.append(F.when(contains_any(header, needles), first) if needles else first)
        return F.coalesce(*found, F.lit(6))

    def from_clean(line: Column) -> Column:
        return (
            F.when(
                line.startswith("Traceback (most recent call last):")
                | line.startswith("Exception:"),
                F.lit(3),
            )
            .when(line.startswith("panic:"), F.lit(2))
            .otherwise(let(line if chars is None else F.left(line, F.lit(chars)), from_header))
        )

    return let(strip(clean_text(F.coalesce(col(c), F.lit("")))), from_clean)


def content_severity(stated: Column, has_level: Column, content: Column) -> Column:
    """Stated severity corrected by the content.

    Without a stated level the content decides; a stated level of 5 or more may only become
    more severe.
    """
    detected = detect_severity(content)
    return (
        F.when(~has_level, detected)
        .when(stated >= 5, F.least(stated, detected))
        .otherwise(stated)
        .cast("int")
    )
