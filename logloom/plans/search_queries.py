"""Search, filters, counts, facets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions import project_entry, wildcard_match
from ..operators import counts, dims, facets, filters, indexsearch, search, textindex
from ..operators.filters import LogFilter
from ..operators.textquery import AllOf, AnyOf, NoneOf, Phrase, Term
from ..schema import with_log_date
from ..session import checkpoint_dir
from .registry import query, us
from .tables import AS_OF, Tables

CONTAINERS = ["host-7", "host-57"]


def _any_field(pattern: str) -> str:
    fields = ("app_name", "source_alias", "message")
    return "(" + " OR ".join(f"regexp_matches(lower({f}), '{pattern}')" for f in fields) + ")"


ERRORS_SPEC = LogFilter(
    terms=["user", "error"], sources=["host-3", "10.0.0.5"], severity_max=3, start="20d",
    container_aliases=CONTAINERS, as_of=AS_OF,
)
ERRORS_SQL = f"""severity <= 3 AND "timestamp" >= TIMESTAMP '2024-01-11'
  AND (source_alias = 'host-3' OR (source_ip IN ('host-3', '10.0.0.5')
       AND source_alias NOT IN ('docker', 'host-7', 'host-57') AND source_ip <> 'docker')
       OR source_alias = '10.0.0.5')
  AND {_any_field('(^|[^a-z0-9])user')} AND {_any_field('(^|[^a-z0-9])error')}"""


@query("logs", f"""SELECT id, epoch_us("timestamp") AS timestamp_us, source_ip, source_alias, app_name,
  severity, message FROM logs WHERE {ERRORS_SQL} ORDER BY "timestamp" DESC, id DESC LIMIT 100""")
def search_newest(t):
    page = search.search(t.logs(), ERRORS_SPEC, limit=100)
    return page.select("id", us("timestamp"), "source_ip", "source_alias", "app_name", "severity", "message")


@query("logs", """SELECT id, epoch_us("timestamp") AS timestamp_us FROM logs WHERE app_name IN ('nginx', 'kernel')
  ORDER BY "timestamp" DESC, id DESC LIMIT 50 OFFSET 25""")
def search_offset(t):
    page = search.search(t.logs(), LogFilter(apps=["nginx", "kernel"]), limit=50, offset=25)
    return page.select("id", us("timestamp"))


@query("logs", """, m AS (SELECT * FROM logs WHERE severity <= 5 AND ("timestamp" < TIMESTAMP '2024-01-20 12:00:00'
    OR ("timestamp" = TIMESTAMP '2024-01-20 12:00:00' AND id < 5000)) ORDER BY "timestamp" DESC, id DESC LIMIT 41),
  r AS (SELECT *, row_number() OVER (ORDER BY "timestamp" DESC, id DESC) AS p, count(*) OVER () AS n FROM m)
  SELECT id, epoch_us("timestamp") AS timestamp_us, CASE WHEN p = 40 AND n > 40 THEN
    rtrim(replace(replace(to_base64(encode('[' || epoch_us("timestamp") || ',' || id || ']')), '+', '-'), '/', '_'), '=')
    END AS next_cursor FROM r WHERE p <= 40""")
def search_after_page(t):
    cursor = search.encode_cursor(1_705_752_000_000_000, 5000)
    page = search.search_after(t.logs(), LogFilter(severity_max=5), cursor, limit=40)
    return page.select("id", us("timestamp"), "next_cursor")


@query("logs", f"SELECT count(*) AS total FROM logs WHERE {ERRORS_SQL}")
def count_matching(t):
    return search.count_logs(t.logs(), ERRORS_SPEC)


@query("logs", """SELECT least(count(*), 1001) AS total, count(*) >= 1001 AS total_capped FROM logs
  WHERE severity <= 6""")
def count_capped(t):
    return search.capped_count(t.logs(), LogFilter(severity_max=6))


@query("logs", """SELECT id FROM logs WHERE
  (regexp_matches(lower(message), '(^|[^a-z0-9])user[^a-z0-9]+1[0-9]*[^a-z0-9]+from')
   AND regexp_matches(lower(message), '(^|[^a-z0-9])user[^a-z0-9]+14[^a-z0-9]+from([^a-z0-9]|$)'))
  AND NOT regexp_matches(lower(source_alias), '(^|[^a-z0-9])docker')
  AND NOT regexp_matches(lower(app_name), '(^|[^a-z0-9])docker')
  AND NOT regexp_matches(lower(message), '(^|[^a-z0-9])docker')""")
def phrase_filter(t):
    cond = filters.all_of(
        filters.has_phrase("user 14 from", field="msg"), filters.none_of(filters.has_term("docker"))
    )
    return t.logs().filter(cond).select("id")


@query("logs", r"""SELECT id FROM logs WHERE
  regexp_matches(lower(source_alias), '(^|[^a-z0-9])host[^a-z0-9]+1([^a-z0-9]|$)')
  OR regexp_matches(lower(message), '(^|[^a-z0-9])192[^a-z0-9]+168[^a-z0-9]+1[^a-z0-9]+7([^a-z0-9]|$)')
  OR regexp_matches(lower(app_name), '(^|[^a-z0-9])cr')""")
def field_terms(t):
    cond = filters.any_of(
        filters.has_phrase("host-1", field="host"),
        filters.has_phrase("192.168.1.7"),
        filters.has_term("cr*", field="app"),
    )
    return t.logs().filter(cond).select("id")


def _indexed(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The derived logs by day, and their word index read back from a shared folder."""
    path = f"{checkpoint_dir(t.spark)}/index-{uuid.uuid4().hex}"
    textindex.write_postings(textindex.build_postings(t.logs(), by_day=True), path, buckets=16)
    return with_log_date(t.logs()), t.spark.read.parquet(path)


@query(same_as="search_newest")
def index_search_newest(t):
    logs, postings = _indexed(t)
    page = indexsearch.search_by_index(logs, postings, ERRORS_SPEC, limit=100, buckets=16)
    return page.select("id", us("timestamp"), "source_ip", "source_alias", "app_name", "severity", "message")


@query(same_as="count_matching")
def index_count_matching(t):
    return indexsearch.count_by_index(*_indexed(t), ERRORS_SPEC, buckets=16)


@query(same_as="phrase_filter")
def index_phrase_filter(t):
    text = AllOf(Phrase("user 14 from", "msg"), NoneOf(Term("docker")))
    return indexsearch.matching_by_index(*_indexed(t), LogFilter(text=text), buckets=16).select("id")


@query(same_as="field_terms")
def index_field_terms(t):
    text = AnyOf(Phrase("host-1", "host"), Phrase("192.168.1.7"), Term("cr*", "app"))
    return indexsearch.matching_by_index(*_indexed(t), LogFilter(text=text), buckets=16).select("id")


@query("logs", """SELECT id, epoch_us("timestamp") AS timestamp_us FROM logs WHERE severity <= 5
  AND NOT (regexp_matches(lower(message), '(^|[^a-z0-9])purch') AND NOT regexp_matches(lower(app_name), '(^|[^a-z0-9])sshd'))
  AND ("timestamp" < TIMESTAMP '2024-01-20 12:00:00' OR ("timestamp" = TIMESTAMP '2024-01-20 12:00:00' AND id < 5000))
  ORDER BY "timestamp" DESC, id DESC LIMIT 40""")
def index_search_after(t):
    """A page below a cursor of rows that lack a word: the index lists the rows to leave out."""
    logs, postings = _indexed(t)
    text = NoneOf(AllOf(Term("purch", "message"), NoneOf(Term("sshd", "app"))))
    cursor = search.encode_cursor(1_705_752_000_000_000, 5000)
    page = indexsearch.search_after_by_index(logs, postings, LogFilter(severity_max=5, text=text), cursor, limit=40, buckets=16)
    return page.select("id", us("timestamp"))


@query("logs", """SELECT id FROM logs WHERE "timestamp" >= TIMESTAMP '2024-01-29 23:00:00'
  AND "timestamp" <= TIMESTAMP '2024-01-30 18:30:00'""")
def time_range_local_day(t):
    cond = filters.time_range("yesterday", "2024-01-30T18:30:00Z", AS_OF, tz="Europe/Berlin")
    return t.logs().filter(cond).select("id")


@query("logs containers", """SELECT id FROM logs SEMI JOIN containers ON source_alias = alias""")
def hosts_in_table(t):
    return filters.in_table(t.logs(), "source_alias", t.containers()).select("id")


@query("logs", """SELECT id FROM logs WHERE (source_alias = 'host-4' OR source_alias = 'docker')
  AND severity <= 6 AND app_name IN ('sshd', 'nginx')""")
def live_filter_rows(t):
    cond = filters.live_filter(6, ["host-4", "docker"], ["sshd", "nginx"], CONTAINERS)
    return t.logs().filter(cond).select("id")


@query("logs", r"""SELECT id, lower(app_name) IN ('cron') OR regexp_matches(lower(app_name), '^(ker.*|.ginx)$') AS app_hit,
  regexp_matches(source_alias, '^host-.$') AS host_hit FROM logs""")
def wildcard_lists(t):
    return t.logs().select(
        "id",
        wildcard_match("app_name", "KER*, cron, ?ginx, cron").alias("app_hit"),
        wildcard_match("source_alias", ["host-?"]).alias("host_hit"),
    )


@query("", """SELECT p_partkey AS id FROM part WHERE NOT (lower(p_name) IN ('part 7') OR
  lower(p_brand) IN ('brand#13') OR p_type IN ('x'))""")
def container_exclusion(t):
    p = t.read("part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("container_name"),
        F.col("p_brand").alias("display_name"), F.col("p_type").alias("container_id"),
    )
    return filters.exclude_containers(p, "Brand#13, part 7").select("id")


@query("logs", """SELECT id, epoch_us("timestamp") AS timestamp_us, source_ip,
  CASE WHEN source_alias = '' THEN source_ip ELSE source_alias END AS source_alias, app_name, severity, message,
  ['emergency','alert','critical','error','warning','notice','info','debug'][severity + 1] AS severity_label
  FROM logs""")
def shown_entries(t):
    return project_entry(t.logs()).withColumn("timestamp", F.unix_micros("timestamp")).withColumnRenamed(
        "timestamp", "timestamp_us"
    )


@query("logs", """SELECT id, epoch_us("timestamp") AS timestamp_us, message FROM logs
  SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') ON id = o_orderkey""")
def rows_by_ids(t):
    ids = t.read("orders").filter(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey")
    return search.logs_by_ids(t.logs(), ids).select("id", us("timestamp"), "message")


@query("logs", """SELECT severity, ['emergency','alert','critical','error','warning','notice','info','debug'][severity + 1]
  AS label, count(*) AS count FROM logs GROUP BY severity""")
def severity_counts(t):
    return counts.count_by_severity(t.logs())


def _top(group: str, limit: int) -> str:
    return f""", g AS (SELECT {group} AS name, count(*) AS count FROM logs GROUP BY 1)
      SELECT name, count, (SELECT CAST(sum(count) AS BIGINT) FROM g) AS total,
        (SELECT count(*) > {limit} FROM g) AS truncated FROM g ORDER BY count DESC, name LIMIT {limit}"""


@query("logs", _top("coalesce(app_name, 'unknown')", 3))
def app_counts(t):
    return counts.count_by_app(t.logs(), limit=3)


@query("logs", _top("coalesce(nullif(source_alias, ''), source_ip, 'unknown')", 100))
def source_counts(t):
    return counts.count_by_source(t.logs(), limit=100)


@query("logs", """SELECT count(*) FILTER (severity <= 3) AS error_count_24h,
  count(*) FILTER (severity <= 3 AND "timestamp" >= TIMESTAMP '2024-01-30 23:00:00') AS error_count_1h,
  count(*) FILTER (severity = 0) AS emergency_24h, count(*) FILTER (severity = 1) AS alert_24h,
  count(*) FILTER (severity = 2) AS critical_24h, count(*) FILTER (severity = 3) AS error_24h,
  count(*) FILTER (severity = 4) AS warning_24h
  FROM logs WHERE severity <= 4 AND "timestamp" >= TIMESTAMP '2024-01-30'""")
def error_figures(t):
    return counts.error_stats(t.logs(), AS_OF)


@query("logs", """SELECT app_name AS name, count(*) AS count FROM logs WHERE severity <= 3
  AND "timestamp" >= TIMESTAMP '2024-01-30' AND app_name <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def worst_apps(t):
    return counts.top_error_apps(t.logs(), AS_OF)


@query("logs", """SELECT coalesce(nullif(source_alias, ''), source_ip, 'unknown') AS name, count(*) AS count FROM logs
  WHERE severity <= 3 AND "timestamp" >= TIMESTAMP '2024-01-30' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def worst_hosts(t):
    return counts.top_error_hosts(t.logs(), AS_OF)


@query("logs", """SELECT 'host' AS kind, coalesce(nullif(source_alias, ''), source_ip) AS name, count(*) AS count
  FROM logs GROUP BY 1, 2 UNION ALL SELECT 'app', app_name, count(*) FROM logs GROUP BY 1, 2""")
def volumes(t):
    return counts.volume_counts(t.logs())


@query("logs", """SELECT epoch_us(time_bucket(INTERVAL '6 hours', received_at, TIMESTAMP '2000-01-01')) AS window_start_us,
  count(*) AS count, round(count(*) / 21600.0, 2) AS rate FROM logs GROUP BY 1""")
def ingest_rates(t):
    rates = counts.ingest_rate(t.logs(), seconds=21_600)
    return rates.select(us("window_start"), "count", "rate")


HOST_APPS = """, named AS (SELECT ip, max(alias) AS alias FROM aliases WHERE alias <> '' GROUP BY ip),
  pairs AS (SELECT DISTINCT CASE WHEN source_alias IN ('docker', 'host-7', 'host-57') OR source_ip = 'docker'
      THEN coalesce(nullif(source_alias, ''), 'docker')
      ELSE coalesce(a.alias, b.alias, nullif(source_alias, ''), source_ip) END AS host, app_name AS app
    FROM logs LEFT JOIN named a ON a.ip = source_ip LEFT JOIN named b ON b.ip = source_alias)"""


@query("logs aliases", HOST_APPS + """, hosts AS (SELECT host AS name FROM pairs UNION SELECT alias FROM aliases
    UNION SELECT unnest(['host-7', 'host-57'])),
  kept AS (SELECT name FROM hosts ANTI JOIN aliases ON name = ip AND ip <> alias),
  apps AS (SELECT DISTINCT app AS name FROM pairs WHERE app <> '')
  SELECT 'hosts' AS kind, array_to_string(list(name ORDER BY name), '|') AS names, count(*) > 500 AS truncated FROM kept
  UNION ALL SELECT 'apps', array_to_string(list(name ORDER BY name), '|'), count(*) > 500 FROM apps""")
def facet_lists(t):
    out = facets.facets(t.logs(), t.aliases(), CONTAINERS)
    return out.select("kind", F.array_join("names", "|").alias("names"), "truncated")


@query("logs aliases", HOST_APPS + """SELECT host AS name, array_to_string(list(app ORDER BY app)[1:3], '|') AS names,
  count(*) > 3 AS truncated FROM pairs WHERE app <> '' GROUP BY host""")
def apps_per_host(t):
    pairs = facets.host_app_pairs(t.logs(), t.aliases(), CONTAINERS)
    return facets.host_to_apps(pairs, limit=3).withColumn("names", F.array_join("names", "|"))


@query("logs aliases", HOST_APPS + """SELECT app AS name, array_to_string(list(host ORDER BY host)[1:500], '|') AS names,
  count(*) > 500 AS truncated FROM pairs WHERE app <> '' GROUP BY app""")
def hosts_per_app(t):
    pairs = facets.host_app_pairs(t.logs(), t.aliases(), CONTAINERS)
    return facets.app_to_hosts(pairs).withColumn("names", F.array_join("names", "|"))


@query("containers", """SELECT alias FROM containers UNION SELECT 'host-' || (s_suppkey % 30) FROM supplier""")
def container_alias_union(t):
    former = t.read("supplier").select(F.concat(F.lit("host-"), (F.col("s_suppkey") % 30).cast("string")))
    return facets.container_alias_set(t.containers(), former)


@query("logs aliases", HOST_APPS + """SELECT name FROM (SELECT host AS name FROM pairs UNION SELECT alias FROM aliases)
  ANTI JOIN aliases ON name = ip AND ip <> alias""")
def hosts_known(t):
    pairs = facets.host_app_pairs(t.logs(), t.aliases(), CONTAINERS)
    none = t.containers().filter(F.lit(False))
    return facets.known_hosts(pairs, t.aliases(), none).select(F.col("host").alias("name"))


@query("logs aliases", """SELECT id, CASE WHEN alias IS NOT NULL THEN alias
    WHEN source_alias NOT IN ('', '-', 'unknown', 'docker', 'host-7') THEN source_alias ELSE source_ip END AS source_alias
  FROM logs LEFT JOIN aliases ON ip = source_ip""")
def resolved_aliases(t):
    logs = t.logs().withColumn("hostname", F.col("source_alias"))
    return dims.resolve_alias(logs, t.aliases(), ["host-7"]).select("id", "source_alias")


@query("aliases", """, wanted AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'SITE-' || n_name
    ELSE '10.0.0.' || n_nationkey END AS name FROM nation),
  exact AS (SELECT 'SITE-' || n_name AS name FROM nation WHERE n_nationkey % 4 = 0)
  SELECT name FROM wanted UNION SELECT unnest([ip, alias]) FROM wanted JOIN aliases
    ON (lower(name) = lower(ip) OR lower(name) = lower(alias))
    WHERE name NOT IN (SELECT name FROM exact) OR name = ip OR name = alias""")
def expanded_sources(t):
    n = t.read("nation")
    key = F.col("n_nationkey")
    site = F.concat(F.lit("SITE-"), F.col("n_name"))
    wanted = n.select(
        F.when(key % 2 == 0, site).otherwise(F.concat(F.lit("10.0.0."), key.cast("string"))).alias("name")
    )
    return dims.expand_sources(wanted, t.aliases(), n.filter(key % 4 == 0).select(site))


@query("logs containers", """SELECT id, source_ip = 'docker' OR source_alias = 'docker'
  OR source_alias IN (SELECT alias FROM containers) AS is_container FROM logs""")
def container_flags(t):
    return dims.flag_container_rows(t.logs(), t.containers()).select("id", "is_container")


@query("logs", """SELECT id, CASE WHEN source_ip = '10.0.0.7' AND source_alias NOT IN ('docker', 'host-7')
  THEN 'edge' ELSE source_alias END AS source_alias FROM logs""")
def alias_backfill(t):
    return dims.backfill_alias(t.logs(), "10.0.0.7", "edge", ["host-7"]).select("id", "source_alias")


@query("logs", """SELECT id, CASE WHEN source_ip = 'docker' AND app_name = 'sshd' AND source_alias IN ('docker', 'host-7')
  THEN 'bastion' ELSE app_name END AS app_name FROM logs""")
def app_backfill(t):
    return dims.backfill_app(t.logs(), "sshd", "bastion", containers=["host-7"]).select("id", "app_name")


@query("logs aliases", """SELECT DISTINCT coalesce(nullif(alias, ''), ip) AS host, trim(notes) AS note FROM aliases
  WHERE trim(notes) <> '' AND (ip IN (SELECT source_ip FROM logs) OR alias IN (SELECT source_alias FROM logs))""")
def notes_of_hosts(t):
    return dims.host_notes(t.logs(), t.aliases())
