"""Wildcards, globs and rule patterns as Java regular expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from re import _parser as regex_parser

from pyspark.sql import Column, SparkSession, functions as F

from .common import BLANKS, col, strip

_JAVA_SPECIAL = set("\\^$.|?*+()[]{}&-~#")


def quote(text: str) -> str:
    return "".join("\\" + ch if ch in _JAVA_SPECIAL else ch for ch in text)


def glob_to_regex(glob: str) -> str:
    """``*``, ``?`` and ``[...]`` of a glob as a regular expression body."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        close = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            body = glob[i + 1 : close]
            negated = body.startswith("!")
            inner = "".join(
                "\\" + c if c in "\\[]^&" else c for c in (body[1:] if negated else body)
            )
            out.append(f"[{'^' if negated else ''}{inner}]")
            i = close
        else:
            out.append(quote(ch))
        i += 1
    return re.sub(r"(?:\.\*){2,}", ".*", "".join(out))


def is_wild(pattern: str) -> bool:
    return "*" in pattern or "?" in pattern


def split_list(patterns: str | list[str] | None) -> list[str]:
    """Lower-case patterns of a comma list: trimmed, without empty ones and repeats."""
    parts = patterns.split(",") if isinstance(patterns, str) else list(patterns or ())
    clean = [p.strip().lower() for p in parts if p and p.strip()]
    return list(dict.fromkeys(clean))


def exact_keys(patterns: str | list[str] | None) -> list[str] | None:
    """The values a pattern list matches when none is a wildcard; null when empty or wild."""
    parts = split_list(patterns)
    return parts if parts and not any(is_wild(p) for p in parts) else None


def wildcard_match(c: Column | str, patterns: str | list[str] | None) -> Column:
    """Whether the text equals one of the patterns (``*`` and ``?``, any case, blanks trimmed).

    An empty list matches everything; empty text matches only an empty list.
    """
    parts = split_list(patterns)
    if not parts:
        return F.lit(True)
    key = F.lower(strip(col(c)))
    exact = [p for p in parts if not is_wild(p)]
    wild = [p for p in parts if is_wild(p)]
    hit = key.isin(*exact) if exact else F.lit(False)
    if wild:
        hit = hit | key.rlike("(?s)^(?:" + "|".join(glob_to_regex(p) for p in wild) + r")\z")
    return F.coalesce(F.length(col(c)) > 0, F.lit(False)) & F.coalesce(hit, F.lit(False))


@lru_cache(maxsize=4096)
def _java_accepts(pattern: str) -> bool:
    spark = SparkSession.getActiveSession()
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)  # noqa: SLF001
        return True
    except AttributeError:  # no JVM gateway (Spark Connect): judge by the Python dialect
        try:
            re.compile(pattern)
            return True
        except re.error:
            return False
    except Exception:
        return False


def java_regex(pattern: str) -> str | None:
    """A rule's regular expression in Java's dialect, any case, or null when it is not valid."""
    out = re.sub(r"\(\?P<(\w+)>", lambda m: "(?<" + m.group(1).replace("_", "") + ">", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: r"\k<" + m.group(1).replace("_", "") + ">", out)
    out = "(?iuU)" + out.replace(r"\Z", r"\z")
    return out if _java_accepts(out) else None


# Characters that make an alert pattern a regular expression.
META = set("*+?[](){}^$|\\")


def trimmed(pattern: str | None) -> str:
    return (pattern or "").strip(BLANKS)


# Sets of texts longer than this are not worth a test before a pattern.
_TEXTS_MAX = 24


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The set whose shortest text is longer; of equals the smaller set."""
    known = [x for x in (a, b) if x and all(x)]
    return max(known, key=lambda x: (min(map(len, x)), -len(x)), default=None)


def _texts(nodes, before: frozenset[str] = frozenset({""})) -> tuple[set[str] | None, set[str] | None]:
    """All texts that a part of a parsed pattern can match (none if they are too many), and a set
    of texts one of which every match holds; both with what may stand right ``before`` the part."""
    run, complete = set(before), True
    best: set[str] | None = None
    for op, arg in nodes:
        name = str(op)
        whole: set[str] | None = None
        part: set[str] | None = None
        if name == "LITERAL":
            whole = {chr(arg)}
        elif name == "IN" and all(str(k) == "LITERAL" for k, _ in arg):
            whole = {chr(c) for _, c in arg}
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            whole = {""}
        elif name == "SUBPATTERN":
            whole, part = _texts(arg[3])
        elif name == "ATOMIC_GROUP":
            whole, part = _texts(arg)
        elif name == "BRANCH":
            found = [_texts(b) for b in arg[1]]
            if all(w is not None for w, _ in found):
                whole = set().union(*(w for w, _ in found))
            # Alternatives share their first letters, which the parser takes out in front of them
            needed = [_better(*_texts(b, frozenset(run))) for b in arg[1]]
            part = set().union(*needed) if all(needed) else None
        elif "REPEAT" in name:
            low, high, inner = arg
            whole, part = _texts(inner)
            if (int(low), int(high)) == (0, 1) and whole is not None:
                whole, part = whole | {""}, None
            elif (int(low), int(high)) != (1, 1):
                part = _better(whole, part) if int(low) else None
                whole = None
        best = _better(best, part)
        joined = {a + b for a in run for b in whole} if whole is not None else set()
        if whole is not None and len(joined) <= _TEXTS_MAX:
            run = joined
        else:
            best, complete = _better(best, run), False
            run = whole if whole is not None and len(whole) <= _TEXTS_MAX else {""}
    return run if complete else None, _better(best, run)


def any_text(texts: Iterable[str]) -> str:
    """A pattern that matches the longest of some texts at a place, one letter after the other, so that
    a place without any is left after a letter or two."""
    tree: dict = {}
    for text in texts:
        node = tree
        for letter in text:
            node = node.setdefault(letter, {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [re.escape(c) + written(child) for c, child in sorted(node.items()) if c]
        if not ways:
            return ""
        joined = ways[0] if len(ways) == 1 and "" not in node else "(?:" + "|".join(ways) + ")"
        return joined + ("?" if "" in node else "")

    return written(tree)


@lru_cache(maxsize=None)
def required_texts(pattern: str, lower: bool = False) -> tuple[str, ...]:
    """Texts one of which occurs in every match of the pattern; none if it needs no particular text.

    With ``lower`` they are lower-case, for a test on lower-case text.
    """
    _, found = _texts(list(regex_parser.parse(pattern)))
    texts = {t.lower() for t in found or ()} if lower else set(found or ())
    return tuple(sorted(t for t in texts if not any(o != t and o in t for o in texts)))
