"""Known hosts and apps, and which app runs on which host."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.common import blank_to_null
from ..session import join_dimension, stage


def container_alias_set(current: DataFrame, former: DataFrame) -> DataFrame:
    """Aliases that mark rows as container output: current and former ones."""
    return current.toDF("alias").union(former.toDF("alias")).distinct()


def _clean_aliases(aliases: DataFrame) -> DataFrame:
    """One alias per address (the last in alphabetical order when several are given)."""
    named = aliases.filter((F.col("alias") != "") & (F.col("ip") != ""))
    return named.groupBy("ip").agg(F.max("alias").alias("alias"))


def host_app_pairs(
    logs: DataFrame, aliases: DataFrame, containers: list[str] = ()
) -> DataFrame:
    """Distinct (host, app) pairs under canonical host names; the app may be empty.

    Container rows keep their alias. Other rows take the configured alias of their address,
    else of their alias, else the alias, else the address. The logs are reduced to distinct
    triples first, so the joins see few rows.
    """
    names = sorted({fixed.CONTAINER_SOURCE, *containers})
    triples = logs.select("source_alias", "source_ip", "app_name").distinct()
    known = _clean_aliases(aliases)
    by_ip = known.select(F.col("ip").alias("source_ip"), F.col("alias").alias("_ip_alias"))
    by_alias = known.select(F.col("ip").alias("source_alias"), F.col("alias").alias("_name_alias"))
    joined = join_dimension(
        join_dimension(triples, by_ip, ["source_ip"]), by_alias, ["source_alias"]
    )
    alias, ip = blank_to_null(F.col("source_alias")), blank_to_null(F.col("source_ip"))
    contained = alias.isin(*names) | (ip == fixed.CONTAINER_SOURCE)
    host = F.when(
        F.coalesce(contained, F.lit(False)),
        F.coalesce(alias, F.lit(fixed.CONTAINER_SOURCE)),
    ).otherwise(F.coalesce(F.col("_ip_alias"), F.col("_name_alias"), alias, ip))
    pairs = joined.select(host.alias("host"), F.col("app_name").alias("app"))
    renamed = join_dimension(pairs, known.toDF("host", "_final"), ["host"])
    return (
        renamed.select(F.coalesce("_final", "host").alias("host"), "app")
        .filter(F.col("host").isNotNull())
        .distinct()
    )


def known_hosts(pairs: DataFrame, aliases: DataFrame, configured: DataFrame) -> DataFrame:
    """Observed hosts and configured ones, without addresses that have an alias."""
    hosts = (
        pairs.select("host")
        .unionByName(aliases.select(F.col("alias").alias("host")))
        .unionByName(configured.toDF("host"))
        .filter(F.col("host") != "")
        .distinct()
    )
    renamed = aliases.filter((F.col("alias") != "") & (F.col("alias") != F.col("ip")))
    return hosts.join(renamed.select(F.col("ip").alias("host")), "host", "left_anti")


def _listed(names: DataFrame, kind: str, limit: int | None) -> DataFrame:
    """The first ``limit`` names in order (None: all), and whether there were more."""
    named = names.toDF("name")
    first = named if limit is None else named.orderBy("name").limit(limit + 1)
    gathered = first.agg(F.sort_array(F.collect_list("name")).alias("names"))
    if limit is None:
        return gathered.select(F.lit(kind).alias("kind"), "names", F.lit(False).alias("truncated"))
    return gathered.select(
        F.lit(kind).alias("kind"),
        F.slice("names", 1, limit).alias("names"),
        (F.size("names") > limit).alias("truncated"),
    )


def facets(
    logs: DataFrame,
    aliases: DataFrame,
    containers: list[str] = (),
    limit: int | None = fixed.FACET_LIMIT,
) -> DataFrame:
    """Two rows, hosts and apps: at most ``limit`` names each (None: all) in alphabetical order.

    The logs are scanned once: their distinct triples, few as they are, are written before both
    lists read them.
    """
    triples = stage(logs.select("source_alias", "source_ip", "app_name").distinct(), "triples")
    pairs = host_app_pairs(triples, aliases, containers)
    configured = logs.sparkSession.createDataFrame([(c,) for c in containers], "host string")
    hosts = known_hosts(pairs, aliases, configured)
    apps = pairs.select("app").filter(F.col("app") != "").distinct()
    return _listed(hosts, "hosts", limit).unionByName(_listed(apps, "apps", limit))


def _mapping(pairs: DataFrame, key: str, value: str, limit: int | None) -> DataFrame:
    """Each key with its values in order, at most ``limit`` (None: all).

    The numbering keeps ``limit + 1`` values per key before any list is built; Spark applies it
    on the map side first, so a key with very many values stays small.
    """
    named = pairs.filter((F.col("host") != "") & (F.col("app") != ""))
    if limit is None:
        names = F.sort_array(F.collect_list(value)).alias("names")
        return named.groupBy(F.col(key).alias("name")).agg(names).withColumn("truncated", F.lit(False))
    place = F.row_number().over(Window.partitionBy(key).orderBy(value))
    return (
        named
        .withColumn("_place", place)
        .filter(F.col("_place") <= limit + 1)
        .groupBy(F.col(key).alias("name"))
        .agg(F.sort_array(F.collect_list(value)).alias("_all"))
        .select(
            "name",
            F.slice("_all", 1, limit).alias("names"),
            (F.size("_all") > limit).alias("truncated"),
        )
    )


def host_to_apps(pairs: DataFrame, limit: int | None = fixed.FACET_LIMIT) -> DataFrame:
    return _mapping(pairs, "host", "app", limit)


def app_to_hosts(pairs: DataFrame, limit: int | None = fixed.FACET_LIMIT) -> DataFrame:
    return _mapping(pairs, "app", "host", limit)
