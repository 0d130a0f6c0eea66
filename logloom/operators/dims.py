"""Host aliases: names for addresses, and their effect on stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from ..functions.common import blank_to_null
from ..session import join_dimension
from .filters import is_container_row


def resolve_alias(
    logs: DataFrame,
    aliases: DataFrame,
    containers: list[str] = (),
    hostname: str = "hostname",
) -> DataFrame:
    """``source_alias`` set from the address: its configured alias, else the sender's own host
    name (unless a container host has that name), else the address."""
    dim = aliases.filter(F.col("alias") != "").groupBy("ip").agg(F.max("alias").alias("_alias"))
    joined = join_dimension(logs, dim.withColumnRenamed("ip", "source_ip"), ["source_ip"])
    taken = [c.lower() for c in {fixed.CONTAINER_SOURCE, *containers}]
    own = F.col(hostname) if hostname in logs.columns else F.lit(None).cast("string")
    usable = (own != "") & ~own.isin("-", "unknown") & ~F.lower(own).isin(*taken)
    # An alias equal to the address names nothing, so the host name still counts
    chosen = F.nullif(F.col("_alias"), F.col("source_ip"))
    alias = F.coalesce(chosen, F.when(usable, own), F.col("source_ip"))
    return joined.withColumn("source_alias", alias).drop("_alias")


def expand_sources(
    wanted: DataFrame, aliases: DataFrame, containers: DataFrame | None = None
) -> DataFrame:
    """Names extended both ways through the aliases: an address adds its alias and the reverse.

    Case does not matter, except that a container host's alias only extends exactly.
    """
    wanted = wanted.toDF("name").filter(F.col("name") != "").distinct()
    pairs = aliases.select(
        F.trim(F.coalesce("ip", F.lit(""))).alias("_ip"),
        F.trim(F.coalesce("alias", F.lit(""))).alias("_alias"),
    )
    both = F.array_distinct(F.filter(F.array("_ip", "_alias"), lambda x: x != ""))
    names = pairs.select(F.explode(both).alias("_key"), both.alias("_names"))
    marked = wanted
    if containers is not None:
        exact = containers.toDF("name").distinct().withColumn("_exact", F.lit(True))
        marked = wanted.join(exact, "name", "left")
    else:
        marked = wanted.withColumn("_exact", F.lit(None).cast("boolean"))
    marked = marked.withColumn("_exact", F.coalesce("_exact", F.lit(False)))
    loose = marked.withColumn("_low", F.lower("name")).join(
        names.withColumn("_low", F.lower("_key")), "_low"
    )
    kept = loose.filter(~F.col("_exact") | (F.col("name") == F.col("_key")))
    return wanted.union(kept.select(F.explode("_names").alias("name"))).distinct()


def flag_container_rows(logs: DataFrame, containers: DataFrame) -> DataFrame:
    """``is_container`` for every row, from the table of container host aliases."""
    names = containers.toDF("source_alias").distinct().withColumn("_hit", F.lit(True))
    flagged = join_dimension(logs, names, ["source_alias"])
    flag = (
        F.col("_hit").isNotNull()
        | (F.col("source_ip") == fixed.CONTAINER_SOURCE)
        | (F.col("source_alias") == fixed.CONTAINER_SOURCE)
    )
    return flagged.withColumn("is_container", F.coalesce(flag, F.lit(False))).drop("_hit")


def backfill_alias(logs: DataFrame, ip: str, alias: str | None, containers: list[str] = ()) -> DataFrame:
    """All rows of an address under a new alias; without one the address is written back.

    Container rows of the same machine stay as they are, unless the address is the container
    source itself.
    """
    target = F.lit(alias if alias else ip)
    hit = F.col("source_ip") == ip
    if ip != fixed.CONTAINER_SOURCE:
        hit = hit & ~is_container_row(list(containers))
    return logs.withColumn(
        "source_alias", F.when(F.coalesce(hit, F.lit(False)), target).otherwise(F.col("source_alias"))
    )


def backfill_app(
    logs: DataFrame,
    raw_name: str,
    display: str,
    source_ip: str = fixed.CONTAINER_SOURCE,
    source_alias: str | None = None,
    containers: list[str] = (),
) -> DataFrame:
    """An app renamed on container rows only (of one container host when its alias is given)."""
    if source_alias:
        scope = F.col("source_alias") == source_alias
    else:
        scope = F.col("source_alias").isin(*sorted({fixed.CONTAINER_SOURCE, *containers}))
    hit = scope & (F.col("source_ip") == source_ip) & (F.col("app_name") == raw_name)
    return logs.withColumn(
        "app_name", F.when(F.coalesce(hit, F.lit(False)), F.lit(display)).otherwise(F.col("app_name"))
    )


def host_notes(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """The notes of the hosts that occur in the rows, one host per row, by name."""
    hosts = rows.select("source_ip", "source_alias").distinct()
    noted = aliases.filter(F.trim("notes") != "")
    by_ip = noted.join(hosts.select(F.col("source_ip").alias("ip")).distinct(), "ip", "left_semi")
    named = hosts.filter(F.col("source_alias") != "")
    by_alias = noted.join(
        named.select(F.col("source_alias").alias("alias")).distinct(), "alias", "left_semi"
    )
    host = F.coalesce(blank_to_null(F.col("alias")), F.col("ip"))
    both = by_ip.unionByName(by_alias).select(host.alias("host"), F.trim("notes").alias("note"))
    return both.groupBy("host").agg(F.max("note").alias("note"))


def notes_text(rows: DataFrame, aliases: DataFrame, max_names: int | None = fixed.HEADER_MAX_NAMES) -> DataFrame:
    """The notes as one text: the bare note when the rows have one host, else a line per host, of the
    first ``max_names`` hosts (None: all)."""
    notes = host_notes(rows, aliases)
    if max_names is not None:
        notes = notes.orderBy("host").limit(max_names)
    hosts = rows.agg(
        F.count_distinct(
            F.coalesce(blank_to_null(F.col("source_alias")), F.col("source_ip"))
        ).alias("n")
    ).scalar()
    line = F.concat(F.lit("- ["), F.col("host"), F.lit("]: "), F.col("note"))
    listed = notes.agg(
        F.count(F.lit(1)).alias("_n"),
        F.max("note").alias("_only"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("host", line.alias("line")))),
                lambda x: x["line"],
            ),
            "\n",
        ).alias("_lines"),
    )
    text = F.when((F.col("_n") == 1) & (hosts <= 1), F.col("_only")).when(
        F.col("_n") > 0, F.col("_lines")
    )
    return listed.select(text.alias("notes"))

