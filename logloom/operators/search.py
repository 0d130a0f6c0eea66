"""Search pages and counts."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..session import join_dimension
from .filters import LogFilter, matching

def newest_first() -> list[Column]:
    return [F.desc("timestamp"), F.desc("id")]


def search(
    logs: DataFrame, spec: LogFilter, limit: int = 100, offset: int = 0
) -> DataFrame:
    """One page of matching rows, newest first, ids deciding ties."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1 to 1000 and offset not negative")
    page = matching(logs, spec).orderBy(*newest_first())
    return (page.offset(offset) if offset else page).limit(limit)


def encode_cursor(ts_micros: int, log_id: int) -> str:
    text = json.dumps([ts_micros, log_id], separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[int, int]:
    try:
        padded = cursor + "=" * (-len(cursor) % 4)
        ts, log_id = json.loads(base64.urlsafe_b64decode(padded))
        if not all(type(x) is int for x in (ts, log_id)):
            raise ValueError
        return ts, log_id
    except (ValueError, TypeError) as e:
        raise ValueError("not a cursor of an earlier page") from e


def after_cursor(cursor: tuple[int, int]) -> Column:
    """Rows below the position; the bound on the time alone reaches the file scan."""
    ts, log_id = F.timestamp_micros(F.lit(cursor[0])), cursor[1]
    return (F.col("timestamp") <= ts) & ((F.col("timestamp") < ts) | (F.col("id") < log_id))


def search_after(
    logs: DataFrame,
    spec: LogFilter,
    cursor: str | tuple[int, int] | None = None,
    limit: int = 100,
) -> DataFrame:
    """The page below a cursor. ``next_cursor`` is set on its last row when more rows follow."""
    found = matching(logs, spec)
    if cursor:
        position = decode_cursor(cursor) if isinstance(cursor, str) else cursor
        found = found.filter(after_cursor(position))
        if "log_date" in logs.columns:
            found = found.filter(F.col("log_date") <= F.to_date(F.timestamp_micros(F.lit(position[0]))))
    return page_with_cursor(found, limit)


def page_with_cursor(found: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` rows; ``next_cursor`` is set on the last when more follow."""
    page = found.orderBy(*newest_first()).limit(limit + 1)
    # limit + 1 rows from here on: numbering them in one task is cheap
    place = F.row_number().over(Window.orderBy(*newest_first()))
    total = F.count(F.lit(1)).over(Window.partitionBy())
    token = F.concat(
        F.lit("["), F.unix_micros("timestamp").cast("string"), F.lit(","),
        F.col("id").cast("string"), F.lit("]"),
    )
    cursor_text = F.rtrim(
        F.translate(F.base64(F.encode(token, "UTF-8")), "+/=", "-_ ")
    )
    return (
        page.withColumns({"_place": place, "_total": total})
        .filter(F.col("_place") <= limit)
        .withColumn(
            "next_cursor",
            F.when((F.col("_place") == limit) & (F.col("_total") > limit), cursor_text),
        )
        .drop("_place", "_total")
    )


def count_logs(logs: DataFrame, spec: LogFilter) -> DataFrame:
    """The exact number of matching rows."""
    return matching(logs, spec).agg(F.count(F.lit(1)).alias("total"))


def ui_count_cap(limit: int, offset: int = 0) -> int:
    return max(fixed.API_COUNT_CAP, offset + limit + 1)


def capped_count(logs: DataFrame, spec: LogFilter, cap: int = fixed.API_COUNT_CAP) -> DataFrame:
    """The number of matching rows up to ``cap``; scanning stops early."""
    some = matching(logs, spec).select(F.lit(1).alias("_x")).limit(cap)
    n = F.count(F.lit(1))
    return some.agg(n.alias("total"), (n >= cap).alias("total_capped"))


def logs_by_ids(logs: DataFrame, ids: DataFrame | list[int]) -> DataFrame:
    """The rows with the given ids in time order."""
    if isinstance(ids, DataFrame):
        picked = join_dimension(logs, ids.toDF("id").distinct(), ["id"], "left_semi")
    else:
        picked = logs.filter(F.col("id").isin(*ids))
    return picked.orderBy("timestamp", "id")
