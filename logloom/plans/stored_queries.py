"""Stored tables and streams: each query writes derived rows to a fresh shared folder, changes or
streams them, and reads the result back."""

from __future__ import annotations

import datetime as dt
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, functions as F

from .. import streaming
from ..operators import alerts, assemble, counts, dims, maintenance, retention, rules, textindex
from ..operators.filters import LogFilter
from ..schema import INCIDENTS
from ..session import checkpoint_dir, stage
from ..sources import logs as stored, records
from ..sources.stored import Folder
from .incident_queries import ENTRIES, POSTINGS, REPLAYS, SESSION_HITS, repeated_lines
from .registry import query, us
from .rule_queries import DROPPED, FIRED
from .tables import AS_OF, Tables

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Longer than the derived logs last, so that no row is late in whatever order files arrive.
DELAY = "60 days"


def _folder(t: Tables, label: str) -> str:
    return f"{checkpoint_dir(t.spark)}/{label}-{uuid.uuid4().hex}"


def _store(t: Tables) -> str:
    """The derived logs in a stored table: odd ids as two micro-batches of a stream, the others
    appended."""
    path, rows = _folder(t, "store"), t.logs()
    streaming.append_batch(rows.filter("id % 4 = 1"), 0, path)
    streaming.append_batch(rows.filter("id % 4 = 3"), 1, path)
    _repeat(t, path)
    stored.append_logs(rows.filter("id % 2 = 0"), path)
    return path


def _repeat(t: Tables, path: str) -> None:
    """The last micro-batch of ``_store`` once more, as a stream does that starts again."""
    streaming.append_batch(t.logs().filter("id % 4 = 3"), 1, path)


def _back(t: Tables, path: str) -> DataFrame:
    return stored.read_logs(t.spark, path)


@query("logs", """SELECT id, epoch_us("timestamp") AS timestamp_us, source_ip, source_alias, app_name, facility, severity,
  message, raw, CAST("timestamp" AS DATE)::VARCHAR AS log_date FROM logs""")
def stored_logs(t):
    rows = _back(t, _store(t))
    return rows.select(
        "id", us("timestamp"), "source_ip", "source_alias", "app_name", "facility", "severity", "message", "raw",
        F.col("log_date").cast("string").alias("log_date"),
    )


@query("logs", "SELECT count(*) AS total_logs_count FROM logs")
def stored_sample(t):
    return stored.sample_storage(t.spark, _store(t), AS_OF).select("total_logs_count")


@query("logs", """SELECT count(*) AS total_logs_count, true AS bytes_match, true AS files_match FROM logs""")
def stored_sample_sizes(t):
    """Bytes and files of the sample against the listing of the folder."""
    path = _store(t)
    folder = Folder(t.spark, path)
    sizes = [size for day in folder.days() for batch in folder.batches(day) for size, _ in folder.files((day, batch)).values()]
    return stored.sample_storage(t.spark, path, AS_OF).select(
        "total_logs_count", (F.col("db_size_bytes") == sum(sizes)).alias("bytes_match"), (F.col("file_count") == len(sizes)).alias("files_match")
    )


@query("logs", """SELECT id, CAST("timestamp" AS DATE)::VARCHAR AS log_date FROM logs
  WHERE NOT (app_name = 'kernel' AND "timestamp" <= TIMESTAMP '2024-01-12 06:00:00')""")
def stored_after_delete(t):
    path = _store(t)
    retention.delete_stored(t.spark, path, LogFilter(apps=["kernel"], end=dt.datetime(2024, 1, 12, 6), as_of=AS_OF))
    _repeat(t, path)
    return _back(t, path).select("id", F.col("log_date").cast("string").alias("log_date"))


@query("logs", "SELECT id FROM logs ANTI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON id = o_orderkey")
def stored_after_id_delete(t):
    path = _store(t)
    retention.delete_stored_ids(t.spark, path, t.read("orders").filter("o_orderstatus = 'F'").select("o_orderkey"))
    _repeat(t, path)
    return _back(t, path).select("id")


@query("logs", """SELECT id FROM logs WHERE "timestamp" >= TIMESTAMP '2024-01-16 05:00:00'""")
def stored_after_prune(t):
    path = _store(t)
    retention.prune_stored(t.spark, path, 15, AS_OF + dt.timedelta(hours=5))
    _repeat(t, path)
    return _back(t, path).select("id")


@query("logs", """SELECT id, CASE WHEN source_ip = '10.0.0.7' AND source_alias NOT IN ('docker', 'host-7') THEN 'edge'
    ELSE source_alias END AS source_alias, CASE WHEN source_ip = 'docker' AND app_name = 'sshd'
    AND source_alias IN ('docker', 'host-7') THEN 'bastion' ELSE app_name END AS app_name FROM logs""")
def stored_after_backfills(t):
    path = _store(t)
    retention.backfill_stored(t.spark, path, "source_alias", lambda df: dims.backfill_alias(df, "10.0.0.7", "edge", ["host-7"]))
    retention.backfill_stored(t.spark, path, "app_name", lambda df: dims.backfill_app(df, "sshd", "bastion", containers=["host-7"]))
    stored.append_logs(t.logs().limit(0), path)
    _repeat(t, path)
    return _back(t, path).select("id", "source_alias", "app_name")


@query("logs", """SELECT CAST("timestamp" AS DATE)::VARCHAR AS log_date, count(*) AS n,
  CASE WHEN CAST("timestamp" AS DATE) <= DATE '2024-01-20' THEN 1 ELSE 3 END AS batches FROM logs GROUP BY ALL""")
def stored_after_compaction(t):
    path = _store(t)
    retention.compact_days(t.spark, path, dt.date(2024, 1, 20))
    _repeat(t, path)
    rows = t.spark.read.parquet(path)
    return rows.groupBy(F.col("log_date").cast("string").alias("log_date")).agg(
        F.count("*").alias("n"), F.count_distinct("batch_id").cast("int").alias("batches")
    )


@query("logs", """SELECT id, source_alias, CASE WHEN severity <= 3 AND id % 4 = 1 THEN 'urgent' ELSE app_name END AS app_name,
  CASE WHEN "timestamp" < TIMESTAMP '2024-01-20' THEN 'merged' WHEN id % 2 = 0 THEN 'own' ELSE CAST(id % 4 // 2 AS VARCHAR) END AS batch
  FROM logs WHERE "timestamp" >= TIMESTAMP '2024-01-16 05:00:00' AND (severity > 1 OR "timestamp" >= TIMESTAMP '2024-01-25')""")
def stored_after_many_changes(t):
    """All kinds of change one after the other, each followed by the last micro-batch once more."""
    path, spark = _store(t), t.spark
    retention.compact_days(spark, path, dt.date(2024, 1, 17))
    _repeat(t, path)
    retention.delete_stored(spark, path, LogFilter(severity_max=1, end=dt.datetime(2024, 1, 24, 23, 59, 59, 999999), as_of=AS_OF))
    _repeat(t, path)
    urgent = F.when(F.expr("severity <= 3 AND id % 4 = 1"), "urgent").otherwise(F.col("app_name"))
    retention.backfill_stored(spark, path, "app_name", lambda df: df.withColumn("app_name", urgent))
    _repeat(t, path)
    retention.prune_stored(spark, path, 15, AS_OF + dt.timedelta(hours=5))
    _repeat(t, path)
    retention.compact_days(spark, path, dt.date(2024, 1, 19))
    _repeat(t, path)
    batch = F.when(F.col("log_date") < F.lit(dt.date(2024, 1, 20)), "merged").when(F.col("batch_id") < 0, "own")
    return spark.read.parquet(path).select(
        "id", "source_alias", "app_name", batch.otherwise(F.col("batch_id").cast("string")).alias("batch")
    )


@query("incidents", """SELECT sample_log_id, rule_name, epoch_us(triggered_at) AS triggered_at_us, sample_log FROM incidents""")
def stored_incidents(t):
    path = _folder(t, "incidents")
    missing = [f for f in INCIDENTS if f.name not in t.incidents().columns]
    rows = t.incidents().withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else t.incidents()
    stored.write_incidents(rows, path)
    return t.spark.read.parquet(path).select("sample_log_id", "rule_name", us("triggered_at"), "sample_log")


@query("", """SELECT CASE event_id % 3 WHEN 2 THEN NULL ELSE 'u' || user_id END AS message, count(*) AS n,
    CAST(event_id % 3 = 2 AS BOOLEAN) AS bad FROM events GROUP BY ALL""")
def json_files(t):
    """Records read from text files of lines: objects, arrays of one object, and lines that are no JSON."""
    path = _folder(t, "records")
    user = F.concat(F.lit('{"message": "u'), F.col("user_id").cast("string"), F.lit('"}'))
    line = F.when(F.col("event_id") % 3 == 0, user).when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), user, F.lit("]"))).otherwise("no json")
    t.read("events").select(line.alias("value")).write.text(path)
    found = records.read_json_records(t.spark, path)
    return found.groupBy(
        F.try_variant_get("record", "$.message", "string").alias("message"), F.col("bad_text").isNotNull().alias("bad")
    ).agg(F.count("*").alias("n"))


@query("logs", """SELECT id, 'address' AS term FROM logs WHERE regexp_matches(message, '(^|[^0-9a-z])192\\.168\\.1\\.7')
  UNION ALL SELECT id, 'short' FROM logs WHERE regexp_matches(lower(message), '(^|[^0-9a-z])75([^0-9a-z]|$)')
  UNION ALL SELECT id, 'start' FROM logs WHERE regexp_matches(lower(message), '(^|[^0-9a-z])purch')""")
def index_terms(t):
    path = _folder(t, "index")
    textindex.write_postings(textindex.build_postings(t.logs()), path)
    postings = t.spark.read.parquet(path)
    terms = (("address", "192.168.1.7"), ("short", "75"), ("start", "purch"), ("nothing", "?!"))
    found = None
    for name, term in terms:
        part = textindex.lookup(postings, term, field="message").select(F.col("log_id").alias("id"), F.lit(name).alias("term"))
        found = part if found is None else found.unionByName(part)
    return found


@contextmanager
def _stream_settings(t: Tables):
    """Keyed state in RocksDB, and a state partition for each core while a query's streams run."""
    cores = t.spark.sparkContext.defaultParallelism
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.shuffle.partitions": str(max(4, cores))}
    before = {k: t.spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        t.spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            t.spark.conf.set(k, v) if v is not None else t.spark.conf.unset(k)


def _stream(t: Tables, rows: DataFrame, **options) -> DataFrame:
    """The rows as a stream of files."""
    path = _folder(t, "in")
    rows.write.parquet(path)
    return t.spark.readStream.schema(rows.schema).options(**options).parquet(path)


def _with_end(rows: DataFrame, ts: str) -> DataFrame:
    """The rows and, after the last one, a row so late that the watermark passes all others."""
    far = rows.agg(F.max(ts).alias(ts)).select(F.col(ts) + F.expr("interval 200 days"))
    values = {"timestamp": F.col(ts), "received_at": F.col(ts)}
    end = far.toDF(ts).select(*[
        values.get(f.name, F.lit("end") if f.dataType.simpleString() == "string" else F.lit(7)).cast(f.dataType).alias(f.name)
        for f in rows.schema
    ])
    return rows.unionByName(end)


def _run(t: Tables, stream: DataFrame, sink=None) -> DataFrame:
    """Runs a stream over all its files into parquet (or into ``sink``) and reads the result."""
    out, cp = _folder(t, "out"), _folder(t, "cp")
    with _stream_settings(t):
        if sink is not None:
            started = streaming.start(stream, sink, cp, availableNow=True)
        else:
            started = stream.writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(out)
        started.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out) if sink is None else None


@query("logs", """SELECT id, epoch_us(received_at) AS timestamp_us, 'plain' AS format, facility, message AS message FROM
  (SELECT id, received_at, facility, app_name || ': ' || message AS message FROM logs)""")
def streamed_lines(t):
    lines = t.logs().select("id", "received_at", "source_ip", F.col("raw").alias("value"))
    out = _run(t, streaming.normalize_stream(_stream(t, lines), t.aliases()))
    return out.select("id", us("timestamp"), "format", "facility", "message")


@query("logs sessions", DROPPED + SESSION_HITS + """SELECT hit.id, app_name FROM hit LEFT JOIN met ON met.id = hit.id AND p = 1
  WHERE drop_rule_id IS NULL AND session_id IS NULL""")
def streamed_kept_logs(t):
    return _run(t, streaming.filter_stream(_stream(t, t.logs()), t.drop_rules(), t.sessions())).select("id", "app_name")


@query("logs", """SELECT id, epoch_us("timestamp") AS timestamp_us, message FROM logs""")
def streamed_store(t):
    path, cp = _folder(t, "store"), _folder(t, "cp")
    with _stream_settings(t):
        streaming.store_stream(_stream(t, t.logs()), path, cp, availableNow=True).awaitTermination()
    return _back(t, path).select("id", us("timestamp"), "message")


@query("logs", FIRED + "SELECT CAST(rule_id AS BIGINT) AS rule_id, sec AS fire_sec FROM fired")
def streamed_firings(t):
    """All enabled rules over a stream."""
    listed = rules.ordered_rules(t.alert_rules())
    source = _stream(t, _with_end(t.logs(), "timestamp"))
    segments = _run(t, streaming.alert_segments(source, listed, DELAY))
    return alerts.firings(segments).select("rule_id", "fire_sec")


def _held(rows: str) -> str:
    """The rows behind each firing, by their place among ``rows``."""
    return f"""SELECT f.sec AS fire_sec, x.* FROM f JOIN (SELECT rule_id, id, "timestamp", epoch_us("timestamp") // 1000000 AS sec,
      row_number() OVER (PARTITION BY rule_id, epoch_us("timestamp") // 1000000 ORDER BY "timestamp", id) AS p FROM {rows}) x
    ON x.rule_id = f.rule_id AND x.sec BETWEEN f.sec - width AND f.sec
    AND (x.sec < f.sec OR p <= f.place) AND (last_sec IS NULL OR x.sec > last_sec OR (x.sec = last_sec AND p > last_place))"""


@query("logs", FIRED + f""", f AS (SELECT rule_id, sec, place, width, lag(sec) OVER w AS last_sec, lag(place) OVER w AS last_place
    FROM fired JOIN rule USING (rule_id) WINDOW w AS (PARTITION BY rule_id ORDER BY sec)),
  every AS ({_held("matches")}), held AS ({_held("(SELECT * FROM matches WHERE id % 40 <> 0)")}),
  n AS (SELECT rule_id, fire_sec, count(*) AS match_count FROM every GROUP BY ALL),
  h AS (SELECT rule_id, fire_sec, count(*) AS stored, arg_max(id, (epoch_us("timestamp"), id)) AS newest FROM held GROUP BY ALL)
  SELECT CAST(n.rule_id AS BIGINT) AS rule_id, n.fire_sec, match_count, match_count - coalesce(stored, 0) AS missing,
    CASE WHEN n.rule_id <> 6 THEN newest END AS sample_log_id FROM n LEFT JOIN h ON h.rule_id = n.rule_id AND h.fire_sec = n.fire_sec""")
def streamed_incidents(t):
    """Incidents of a stream whose store lacks every fortieth row for good."""
    store, out, table = _folder(t, "store"), _folder(t, "incidents"), t.alert_rules()
    streaming.append_batch(_with_end(t.logs().filter("id % 40 <> 0"), "timestamp"), 0, store)
    source = _stream(t, _with_end(t.logs(), "timestamp"))
    segments = streaming.alert_segments(source, rules.ordered_rules(table), DELAY)
    _run(t, segments, lambda batch, i: streaming.write_alerts(t.spark, batch, i, store, table, out))
    return t.spark.read.parquet(out).select(
        "rule_id", "fire_sec", "match_count", "missing", F.when(F.col("rule_type") != "rate", F.col("sample_log_id")).alias("sample_log_id")
    )


@query("doc_lines", ENTRIES.format(3))
def streamed_entries(t):
    """Entries of a stream with the default gap reached, and a time limit of three lines."""
    lines = _with_end(t.paused_streams(), "received_at")
    out = _run(t, streaming.assemble_stream(_stream(t, lines), assemble.Limits(seconds=0.12), DELAY, slice_seconds=30))
    return out.filter("stream_key <> 'end'").select("stream_key", "seq", "message", "line_count")


@query("logs", REPLAYS)
def streamed_without_old_replays(t):
    """Two micro-batches; the second delivers lines of both again, however old."""
    out, state = _folder(t, "out"), _folder(t, "state")
    keep = lambda rows, i: rows.select("id", "seq").write.mode("overwrite").parquet(f"{out}/batch_id={i}")
    sink = streaming.without_replays(keep, state, "app_name", "ts")
    lines = repeated_lines(t)
    middle = lines.agg(F.expr("max(seq) div 2").alias("m")).first()["m"]
    for number in (0, 1, 1):  # the second is repeated
        sink(lines.filter(F.col("seq") <= middle if number == 0 else F.col("seq") > middle), number)
    return t.spark.read.parquet(out).select("id", "seq")


@query("logs", """, d AS (SELECT id, id % 4 AS batch, CASE WHEN id % 4 > 0 AND id % 9 = 0 THEN "timestamp" - INTERVAL 40 DAY
    WHEN id % 10 = 0 THEN "timestamp" + INTERVAL 9 HOUR ELSE "timestamp" END AS ev, "timestamp" FROM logs),
  c AS (SELECT id, batch, greatest(least(ev, "timestamp" + INTERVAL 300 SECOND), "timestamp" - INTERVAL 1 DAY) AS ev FROM d),
  m AS (SELECT batch, max(max(ev)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM c GROUP BY 1)
  SELECT id, epoch_us(ev) AS timestamp_us, coalesce(ev < newest - INTERVAL 29 DAY, false) AS late FROM c JOIN m USING (batch)""")
def streamed_late_rows(t):
    """Times that are too early or too late are bounded by the arrival; rows behind the mark are kept beside."""
    moved = F.when(F.expr("id % 4 > 0 AND id % 9 = 0"), F.expr("timestamp - interval 40 days")).when(
        F.expr("id % 10 = 0"), F.expr("timestamp + interval 9 hours")
    )
    rows = streaming.clamp_event_time(
        t.logs().withColumns({"received_at": F.col("timestamp"), "timestamp": F.coalesce(moved, "timestamp")})
    )
    out, late, mark = (_folder(t, x) for x in ("out", "late", "mark"))
    keep = lambda batch, i: batch.select("id", "timestamp").write.mode("overwrite").parquet(f"{out}/batch_id={i}")
    sink = streaming.late_rows_beside(keep, late, mark, delay_seconds=29 * 86_400)
    for number in (0, 1, 2, 2, 3):
        sink(rows.filter(F.col("id") % 4 == number), number)
    kinds = ((out, False), (late, True))
    both = [t.spark.read.parquet(p).select("id", us("timestamp"), F.lit(x).alias("late")) for p, x in kinds]
    return both[0].unionByName(both[1])


@query("logs", """SELECT DISTINCT app_name, epoch_us("timestamp") AS timestamp_us, message FROM logs""")
def streamed_without_replays(t):
    twice = t.logs().unionByName(t.logs().filter("id % 10 < 3"))
    out = _run(t, streaming.drop_replays_stream(_stream(t, twice), ("app_name", "timestamp", "message"), "timestamp", DELAY))
    return out.select("app_name", us("timestamp"), "message")


@query("logs", """SELECT epoch_us(time_bucket(INTERVAL '6 hours', received_at, TIMESTAMP '2000-01-01')) AS window_start_us,
  count(*) AS count, round(count(*) / 21600.0, 2) AS rate FROM logs GROUP BY 1""")
def streamed_rates(t):
    source = _stream(t, _with_end(t.logs(), "received_at")).withWatermark("received_at", DELAY)
    out = _run(t, counts.ingest_rate(source, 21_600))
    return out.select(us("window_start"), "count", "rate")


@query("logs", """, w AS (SELECT epoch_us(received_at) // 21600000000 * 21600000000 - unnest([0, 1, 2, 3]) * 21600000000 AS window_start_us FROM logs)
  SELECT window_start_us, count(*) AS count, round(count(*) / 86400.0, 2) AS rate FROM w GROUP BY 1""")
def streamed_sliding_rates(t):
    """Rows per second over a day that moves on by six hours."""
    source = _stream(t, _with_end(t.logs(), "received_at"))
    out = _run(t, streaming.rate_stream(source, 86_400, 21_600, DELAY)).filter("window_start < timestamp '2024-03-01'")
    return out.select(us("window_start"), "count", "rate")


@query("logs sessions", """, many AS (SELECT 's' || i || session_id AS session_id, created_at + to_minutes(i * 7) AS a,
    least(expires_at, coalesce(ended_at, expires_at)) + to_minutes(i * 7) AS b, expires_at + to_minutes(i * 7) AS e, coalesce(target_app, '') AS app,
    coalesce(target_host, '') AS host FROM sessions, unnest(range(0, 60)) AS r(i) WHERE log_handling = 'drop_errors'),
  met AS (SELECT logs.id, session_id, row_number() OVER (PARTITION BY logs.id ORDER BY e DESC, session_id) AS p FROM logs JOIN many
    ON severity <= 3 AND "timestamp" >= a AND "timestamp" < b AND (app = '' OR lower(app_name) LIKE replace(replace(lower(trim(app)), '*', '%'), '?', '_'))
    AND (host = '' OR lower(source_alias) LIKE replace(replace(lower(trim(host)), '*', '%'), '?', '_') OR lower(source_ip) LIKE replace(replace(lower(trim(host)), '*', '%'), '?', '_')))
  SELECT logs.id, session_id FROM logs LEFT JOIN met ON met.id = logs.id AND p = 1""")
def streamed_session_drops(t):
    """A stream of rows and sixty times the sessions, as a table beside it."""
    i = F.explode(F.sequence(F.lit(0), F.lit(59))).alias("i")
    later = lambda c: F.timestamp_micros(F.unix_micros(c) + F.col("i").cast("long") * 420_000_000).alias(c)
    many = t.sessions().select("*", i).select(
        F.concat(F.lit("s"), F.col("i").cast("string"), "session_id").alias("session_id"), "log_handling", "target_app", "target_host",
        later("created_at"), later("expires_at"), later("ended_at"),
    )
    return _run(t, maintenance.maintenance_drops(_stream(t, t.logs()), many)).select("id", "session_id")


@query("logs", "SELECT id FROM logs WHERE severity <= 3 ORDER BY received_at, id LIMIT 700")
def streamed_tail_limited(t):
    """A tail that ends after so many rows, started again after its first batch."""
    source, out, cp = _folder(t, "in"), _folder(t, "tail"), _folder(t, "cp")
    sink = lambda b, i: b.select("id").write.mode("overwrite").parquet(f"{out}/batch_id={i}")
    rows, at = t.logs(), F.unix_micros("received_at")
    middle = rows.agg(F.percentile(at, 0.05)).first()[0]
    for part in (at <= middle, at > middle):
        rows.filter(part).coalesce(1).write.mode("append").parquet(source)
        with _stream_settings(t):
            stream = t.spark.readStream.schema(rows.schema).parquet(source)
            streaming.tail_stream(stream, F.col("severity") <= 3, sink, cp, 700, availableNow=True).awaitTermination()
    return t.spark.read.parquet(out).select("id")


@query("logs", """SELECT id FROM logs WHERE severity <= 3""")
def streamed_tail(t):
    out, cp = _folder(t, "tail"), _folder(t, "cp")
    sink = lambda b, i: b.select("id").write.mode("overwrite").parquet(f"{out}/batch_id={i}")
    with _stream_settings(t):
        streaming.tail_stream(_stream(t, t.logs()), F.col("severity") <= 3, sink, cp, availableNow=True).awaitTermination()
    return t.spark.read.parquet(out).select("id")


@query("logs", POSTINGS + "SELECT field, token, count(*) AS n, CAST(sum(pos) AS BIGINT) AS positions, (SELECT count(*) FROM logs) AS stored FROM p GROUP BY 1, 2")
def streamed_index(t):
    """A stream that is stored and indexed by one sink."""
    store, index = _folder(t, "store"), _folder(t, "index")
    both = streaming.fan_out(lambda b, i: streaming.append_batch(b, i, store), lambda b, i: streaming.index_batch(b, i, index))
    _run(t, _stream(t, t.logs()), both)
    total = stage(_back(t, store).agg(F.count("*").alias("stored")), "stored")
    words = t.spark.read.parquet(index).groupBy("field", "token").agg(F.count("*").alias("n"), F.sum("pos").alias("positions"))
    return words.withColumn("stored", F.lit(total.first()[0]))
