"""Order-dependent values over groups of any size.

A plain window over a key puts the key's whole history into one task. Here every group is cut
into time chunks: the chunks work in parallel, one small row per chunk is carried over the
group, and both parts are put together. A group that holds most of the table still spreads over
as many tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage

CHUNK = "_chunk"


def time_chunk(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(ts)) / F.lit(seconds * 1_000_000)).cast("long")


def _ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows in ranges of the full order, with a hash of the row behind it, written once; ``_part`` and
    ``_place`` are the range of a row and its place in the order of all."""
    place, tie = "_place", "_tie"
    keys = [*order, tie]
    ranged = (
        df.withColumn(tie, F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]))
        .repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn(place, F.monotonically_increasing_id()).drop(tie)
    )
    return stage(ranged, "ranges").withColumn("_part", F.shiftright(place, 33))


def _with_starts(held: DataFrame, **sizes: Column) -> DataFrame:
    """For each name the sum of its size over all ranges before the row's."""
    sums = held.groupBy("_part").agg(*[F.sum(size).alias(n) for n, size in sizes.items()])
    starts = sums.selectExpr("_part", *[f"sum({n}) over (order by _part) - {n} as {n}" for n in sizes])
    return held.join(F.broadcast(starts), "_part")  # one row per task


def numbered(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """The 1-based position of each row of the whole table, by ``order``; equal rows in any order.

    The rows are cut into ranges of the full order, with a hash of the row behind it, so rows that
    share a time, or all other values, still spread. Each range is numbered where it lies; the sizes
    of the ranges before it, one row per task, are added. The ranges are written once, so that the
    numbers hold when a task runs again.
    """
    mine = _with_starts(_ranges(df, order), _start=F.lit(1))
    number = F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    return mine.withColumn(name, number.cast("long")).drop("_part", "_start", "_place")


def summed(df: DataFrame, order: list[str], size: Column, name: str, number: str) -> DataFrame:
    """The sum of ``size`` over each row and the rows before it in the whole table, and its position, by
    ``order`` as in ``numbered``."""
    held = _ranges(df.withColumn("_size", size), order)
    here = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    mine = _with_starts(held, _start=F.lit(1), _before=F.col("_size")).withColumn("_here", F.sum("_size").over(here))
    place = F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    out = mine.withColumns({name: (F.col("_before") + F.col("_here")).cast("long"), number: place.cast("long")})
    return out.select(*df.columns, name, number)


def latest_in_order(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The latest non-null ``value`` of each row's group up to the row, by ``order``.

    Rows are dealt in ranges of the full order with a hash of the row behind it, so neither a group nor an
    instant of any size is one task. A group that runs over ranges takes over the last value
    of the ranges before, one small row per group and range. ``order`` must tell rows with a value
    from rows that ask at the same instant.
    """
    place, tie, part = "_place", "_tie", "_part"
    full = [*keys, *order, tie]
    ranged = (
        df.withColumn(tie, F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]))
        .repartitionByRange(*full).sortWithinPartitions(*full)
        .withColumn(place, F.monotonically_increasing_id()).drop(tie)
    )
    held = stage(ranged, "ranges").withColumn(part, F.shiftright(place, 33))
    ends = held.groupBy(*keys, part).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(place))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, part, F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    local = Window.partitionBy(*keys, part).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    here = held.withColumn("_here", F.last(value, ignorenulls=True).over(local))
    return here.join(carry, [*keys, part], "left").select(*df.columns, F.coalesce("_here", "_carry").alias(name))


def _join_carry(df: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Chunk rows joined to their summary. The rows are already hashed on these keys by the
    window before, so only the summary moves. Group keys must not be null."""
    return df.join(summary, [*keys, CHUNK], "left")


def ordinal(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    ts: str = "timestamp",
    chunk_seconds: int = 60,
    name: str = "ordinal",
) -> DataFrame:
    """The 1-based position of each row in its group, by ``order`` (which starts with ``ts``)."""
    chunked = df.withColumn(CHUNK, time_chunk(ts, chunk_seconds))
    counts = chunked.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select(
        *keys, CHUNK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    ranked = chunked.withColumn("_rn", F.row_number().over(local))
    return (
        _join_carry(ranked, start, keys)
        .withColumn(name, (F.col("_start") + F.col("_rn")).cast("long"))
        .drop("_rn", "_start", CHUNK)
    )


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, tuple[str, Column]],
    ts: str = "timestamp",
    chunk_seconds: int = 60,
    inclusive: bool = True,
) -> DataFrame:
    """Running values over each group in order.

    ``values`` names each new column with its kind and input: ``last`` (latest non-null value),
    ``max`` or ``sum``; ``total`` is the sum over the whole group. With ``inclusive=False`` a row sees only the rows before it. A frame that
    already has its chunk column keeps it, so calls that follow each other share one shuffle.
    """
    cut = df if CHUNK in df.columns else df.withColumn(CHUNK, time_chunk(ts, chunk_seconds))
    chunked = cut.withColumns({f"_in_{n}": c for n, (_, c) in values.items()})
    position = F.struct(*[F.col(o) for o in order])
    end = 0 if inclusive else -1
    local = (
        Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    whole, carried, here, merged = {}, {}, {}, {}
    for n, (kind, _) in values.items():
        c, s = F.col(f"_in_{n}"), F.col(f"_sum_{n}")
        mine, past = F.col(f"_here_{n}"), F.col(f"_past_{n}")
        if kind == "last":
            whole[n] = F.max_by(c, F.when(c.isNotNull(), position))
            carried[n] = F.last(s, ignorenulls=True).over(before)
            here[n] = F.last(c, ignorenulls=True).over(local)
            merged[n] = F.coalesce(mine, past)
        elif kind == "max":
            whole[n] = F.max(c)
            carried[n] = F.max(s).over(before)
            here[n] = F.max(c).over(local)
            merged[n] = F.greatest(mine, past)
        elif kind == "sum":
            whole[n] = F.sum(c)
            carried[n] = F.sum(s).over(before)
            here[n] = F.sum(c).over(local)
            merged[n] = F.coalesce(mine, F.lit(0)) + F.coalesce(past, F.lit(0))
        elif kind == "total":
            whole[n] = F.sum(c)
            carried[n] = F.sum(s).over(Window.partitionBy(*keys))
            merged[n] = past
        else:
            raise ValueError(f"unknown kind of running value: {kind}")
    summary = (
        chunked.groupBy(*keys, CHUNK)
        .agg(*[w.alias(f"_sum_{n}") for n, w in whole.items()])
        .select(*keys, CHUNK, *[c.alias(f"_past_{n}") for n, c in carried.items()])
    )
    joined = _join_carry(
        chunked.withColumns({f"_here_{n}": c for n, c in here.items()}), summary, keys
    )
    return joined.select(*df.columns, *[m.alias(n) for n, m in merged.items()])
