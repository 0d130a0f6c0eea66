"""Addresses in messages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .common import col

# Words before an address that name it as the origin.
_NAMED_IP = (
    r"(?i)(?:from|rhost=|client[:=]|source[_-]?ip[:=]|host(?=\s))\s*"
    r"([0-9]{1,3}(?:\.[0-9]{1,3}){3}|[a-fA-F0-9:]{3,})"
)
_ANY_IPV4 = r"\b([0-9]{1,3}(?:\.[0-9]{1,3}){3})\b"

# One octet without leading zeros; IPv6 in full or with one '::'.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_VALID_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_H = "[0-9a-fA-F]{1,4}"
_VALID_IPV6 = (
    rf"^(?=(?:[^:]*:){{2,8}}[^:]*$)(?:{_H}(?::{_H}){{7}}"
    rf"|(?=(?:[0-9a-fA-F]+|::|:){{1,15}}$)(?:{_H}(?::{_H})*)?::(?:{_H}(?::{_H})*)?)$"
)
_LOCAL = r"^(?:127\..*|0\.0\.0\.0|(?:0{0,4}:){1,7}0{0,3}[01]?|::1?)$"


def _valid(ip: Column) -> Column:
    groups = F.size(F.filter(F.split(ip, ":"), lambda g: g != ""))
    return ip.rlike(_VALID_IPV4) | (
        ip.rlike(_VALID_IPV6) & (groups <= F.when(ip.contains("::"), F.lit(7)).otherwise(F.lit(8)))
    )


def extract_ip(c: Column | str, max_chars: int | None = None) -> Column:
    """The origin address a message names: after from/rhost=/client/source ip/host first, then any
    IPv4 address; loopback and unspecified addresses only when there is no other.

    ``max_chars`` limits the search to the start of the message (no limit by default).
    """
    text = col(c) if max_chars is None else F.left(col(c), F.lit(max_chars))
    named = F.filter(F.regexp_extract_all(text, F.lit(_NAMED_IP), F.lit(1)), _valid)
    any_ip = F.filter(F.regexp_extract_all(text, F.lit(_ANY_IPV4), F.lit(1)), _valid)
    first = [F.get(F.filter(ips, lambda x: ~x.rlike(_LOCAL)), 0) for ips in (named, any_ip)]
    return F.coalesce(*first, F.get(named, 0), F.get(any_ip, 0))
