"""Columns of the normalisation jobs over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as L
from ..operators import incidents
from ..sources import records
from ..sources.containers import display_name
from .registry import query, us
from .secret_samples import SAMPLES
from .tables import AS_OF

ANSI = r"\x1b(?:\[[0-9;?]*[ -/]*[@-~]|\].*?(?:\x07|\x1b\\)|[@-Z\\-_])"


@query("", rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(
    chr(27) || '[31m' || text || chr(7) || chr(27) || '[0m', '{ANSI}', '', 'g'),
    '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')) AS clean FROM documents""")
def cleaned_text(t):
    esc = F.char(F.lit(27))
    noisy = F.concat(esc, F.lit("[31m"), "text", F.char(F.lit(7)), esc, F.lit("[0m"))
    return t.read("documents").select("doc_id", F.md5(L.clean_text(noisy)).alias("clean"))


@query("", """SELECT doc_id, CASE WHEN length(text) > 900 THEN left(text, 888) || ' [truncated]' ELSE text END AS text
  FROM documents""")
def capped_text(t):
    return t.read("documents").select("doc_id", L.cap_text("text", 900, " [truncated]").alias("text"))


@query("", """SELECT event_id, CASE WHEN regexp_matches(v, '^[0-9]+$') THEN
    CASE WHEN CAST(v AS BIGINT) BETWEEN 0 AND 7 THEN CAST(v AS INTEGER) END
    ELSE CASE v WHEN 'error' THEN 3 WHEN 'panic' THEN 2 WHEN 'warning' THEN 4 WHEN 'verbose' THEN 7 END END AS code
  FROM (SELECT event_id, CASE event_type WHEN 'click' THEN CAST(event_id % 12 AS VARCHAR) WHEN 'view' THEN 'panic'
    WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'verbose' || (event_id % 2) END AS v FROM events)
  WHERE v <> 'verbose0' UNION ALL SELECT event_id, 7 FROM events WHERE event_type = 'purchase' AND event_id % 2 = 0""")
def severity_codes(t):
    eid = F.col("event_id")
    odd = F.when(eid % 2 == 0, F.lit(" VERBOSE\t")).otherwise(F.lit("verbose1"))
    value = (
        F.when(F.col("event_type") == "click", (eid % 12).cast("string"))
        .when(F.col("event_type") == "view", "Panic")
        .when(F.col("event_type") == "error", "ERROR")
        .when(F.col("event_type") == "signup", "warning")
        .otherwise(odd)
    )
    return t.read("events").select("event_id", L.severity_code(value).alias("code"))


@query("", """SELECT l_orderkey, l_linenumber, coalesce((['emergency','alert','critical','error','warning','notice','info',
  'debug'])[CAST(l_quantity AS INTEGER) % 10 + 1], 'unknown') AS label,
  coalesce((['EMERG','ALERT','CRIT','ERROR','WARN','NOTICE','INFO','DEBUG'])[CAST(l_quantity AS INTEGER) % 10 + 1],
    'SEV' || (CAST(l_quantity AS INTEGER) % 10)) AS short FROM lineitem""")
def severity_labels(t):
    code = F.col("l_quantity").cast("int") % 10
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber", L.severity_label(code).alias("label"), L.severity_short(code).alias("short")
    )


@query("logs", r"""SELECT id, CAST(regexp_extract(raw, '^<(\d{1,3})>', 1) AS INTEGER) // 8 AS facility,
  CAST(regexp_extract(raw, '^<(\d{1,3})>', 1) AS INTEGER) % 8 AS severity FROM logs""")
def decoded_pri(t):
    return t.logs().select("id", L.decode_pri("raw").alias("p")).select("id", "p.facility", "p.severity")


@query("logs", """SELECT id, epoch_us(CASE id % 4 WHEN 0 THEN "timestamp" WHEN 1 THEN date_trunc('second', "timestamp")
  WHEN 2 THEN date_trunc('second', "timestamp") - INTERVAL 2 HOUR ELSE NULL END) AS ts_us FROM logs""")
def parsed_iso(t):
    ts = F.col("timestamp")
    text = (
        F.when(F.col("id") % 4 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(F.col("id") % 4 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("id") % 4 == 2, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0200")))
        .otherwise(F.date_format(ts, "yyyy-13-dd HH:mm"))
    )
    return t.logs().select("id", F.unix_micros(L.parse_iso(text)).alias("ts_us"))


@query("logs", """SELECT id, epoch_us(CASE id % 3 WHEN 0 THEN date_trunc('millisecond', "timestamp")
  WHEN 1 THEN date_trunc('second', "timestamp") ELSE date_trunc('second', "timestamp") END) AS ts_us FROM logs""")
def parsed_header_times(t):
    ts = F.col("timestamp")
    text = (
        F.when(F.col("id") % 3 == 0, F.date_format(ts, "yyyy/MM/dd HH:mm:ss,SSS"))
        .when(F.col("id") % 3 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss 'UTC'"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss 'BST'"))
    )
    return t.logs().select("id", F.unix_micros(L.parse_ts(text, "received_at", "UTC")).alias("ts_us"))


@query("logs", """SELECT id, epoch_us(CASE id % 3 WHEN 0 THEN date_trunc('second', "timestamp")
  WHEN 1 THEN date_trunc('millisecond', "timestamp") END) AS ts_us FROM logs""")
def parsed_epochs(t):
    ts = F.col("timestamp")
    text = (
        F.when(F.col("id") % 3 == 0, F.unix_seconds(ts).cast("string"))
        .when(F.col("id") % 3 == 1, F.unix_millis(ts).cast("string"))
        .otherwise(F.concat(F.unix_seconds(ts).cast("string"), F.lit("0")))
    )
    return t.logs().select("id", F.unix_micros(L.parse_epoch(text)).alias("ts_us"))


@query("logs", """, w AS (SELECT id, received_at, "timestamp" + CASE WHEN id % 2 = 0 THEN INTERVAL 1 HOUR
    ELSE INTERVAL 0 HOUR END AS wall FROM logs)
  SELECT id, epoch_us(CASE WHEN abs(epoch_us(wall) - epoch_us(received_at))
    < abs(epoch_us(wall - INTERVAL 1 HOUR) - epoch_us(received_at)) THEN wall ELSE wall - INTERVAL 1 HOUR END) AS ts_us FROM w""")
def resolved_wall_clocks(t):
    shift = F.when(F.col("id") % 2 == 0, 3_600_000_000).otherwise(0)
    wall = F.timestamp_micros(F.unix_micros("timestamp") + shift)
    ts = L.resolve_naive(wall, F.col("received_at"), "Europe/Berlin")
    return t.logs().select("id", F.unix_micros(ts).alias("ts_us"))


@query("", """SELECT o_orderkey, CASE WHEN m > month(o_orderdate) THEN year(o_orderdate) - 1
  WHEN month(o_orderdate) = 12 AND m = 1 THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END AS year
  FROM (SELECT *, 1 + o_custkey % 12 AS m FROM orders)""")
def inferred_years(t):
    month = 1 + F.col("o_custkey") % 12
    year = L.infer_year(month, F.col("o_orderdate")).cast("long")
    return t.read("orders").select("o_orderkey", year.alias("year"))


@query("logs", """, w AS (SELECT id, received_at, received_at + to_seconds(id * 37 % 20000 - 5000) AS ts,
    (id * 37 % 20000 - 5000) AS ahead FROM logs),
  m AS (SELECT *, ts - to_hours(CAST(round_even(ahead / 3600.0, 0) AS BIGINT)) AS moved FROM w)
  SELECT id, epoch_us(CASE WHEN ahead <= 300 THEN ts WHEN epoch_us(moved) - epoch_us(received_at) > 300000000
    THEN received_at ELSE moved END) AS ts_us FROM m""")
def corrected_futures(t):
    ts = F.timestamp_micros(F.unix_micros("received_at") + (F.col("id") * 37 % 20_000 - 5_000) * 1_000_000)
    return t.logs().select("id", F.unix_micros(L.correct_future(ts, F.col("received_at"))).alias("ts_us"))


@query("logs", """, w AS (SELECT *, CASE WHEN id % 7 = 0 THEN NULL ELSE "timestamp" + to_seconds(id % 400) END AS ts FROM logs)
  SELECT id, epoch_us(CASE WHEN ts IS NULL OR epoch_us(ts) - epoch_us(received_at) > 300000000 THEN received_at ELSE ts END)
    AS ts_us FROM w""")
def normalized_times(t):
    ts = F.when(
        F.col("id") % 7 != 0, F.timestamp_micros(F.unix_micros("timestamp") + (F.col("id") % 400) * 1_000_000)
    )
    return t.logs().select("id", F.unix_micros(L.normalize_ts(ts, F.col("received_at"))).alias("ts_us"))


@query("logs", """SELECT id, CASE WHEN id % 2 = 0 THEN epoch_us("timestamp") END AS ts_us,
  CASE WHEN id % 2 = 0 THEN message ELSE 'x ' || message END AS rest FROM logs""")
def container_times(t):
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'789Z'")
    line = F.concat(F.when(F.col("id") % 2 == 0, stamp).otherwise("x"), F.lit(" "), "message")
    return t.logs().select("id", L.container_ts(line).alias("c")).select("id", us("c.ts", "ts_us"), "c.rest")


@query("", """SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE '' END, ''),
  CASE WHEN p_partkey % 3 = 0 THEN p_type END, nullif(p_name, ''), 'x') AS shown FROM part""")
def display_names(t):
    key = F.col("p_partkey")
    labels = F.create_map(
        F.lit("com.docker.compose.service"), F.when(key % 4 == 0, F.concat(F.lit(" /"), "p_brand")).otherwise("  "),
        F.lit("com.docker.swarm.service.name"), F.when(key % 3 == 0, F.col("p_type")),
    )
    shown = display_name(labels, F.concat(F.lit("/"), "p_name"), key.cast("string"))
    return t.read("part").select("p_partkey", shown.alias("shown"))


@query("logs", """SELECT id, CASE WHEN id % 250 IN (0, 1) THEN '10.9.8.' || (id % 250) ELSE '192.168.1.' || (id % 250) END AS ip
  FROM logs""")
def extracted_ips(t):
    # The first address is invalid, the next local; where the message ends in .0 or .1 another is named
    low = (F.col("id") % 250).isin(0, 1)
    named = F.when(low, F.concat(F.lit(" rhost=10.9.8."), (F.col("id") % 250).cast("string"))).otherwise("")
    text = F.concat(F.lit("client: 300.1.1.1 from 127.0.0.1"), named, F.lit(" "), "message")
    return t.logs().select("id", L.extract_ip(text).alias("ip"))


@query("logs", """SELECT id, trim(left(CASE WHEN id % 5 = 0 THEN raw ELSE message END, 150)) AS key FROM logs""")
def message_keys(t):
    message = F.when(F.col("id") % 5 != 0, F.col("message")).otherwise("")
    return t.logs().select("id", L.message_key(message, "raw").alias("key"))


@query("", r"""SELECT doc_id, CASE WHEN length(s) > 500 THEN left(s, 500) || '... [truncated]' ELSE s END AS sample
  FROM (SELECT doc_id, CASE WHEN len(p) > 5 THEN array_to_string(p[1:5], chr(10)) || chr(10) || '... [truncated]' ELSE x END AS s
    FROM (SELECT doc_id, x, string_split(x, chr(10)) AS p FROM
      (SELECT doc_id, trim(text, E' \t\n\r\x0b\x0c') AS x FROM documents)))""")
def message_samples(t):
    return t.read("documents").select("doc_id", L.sample_text("text").alias("sample"))


@query("logs", """SELECT id, '[' || CASE WHEN hour("timestamp") >= 23 THEN
    strftime("timestamp", '%Y-%m-%d %H:%M:%S') || ' UTC (' || strftime("timestamp" + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S')
    ELSE strftime("timestamp", '%H:%M:%S') || ' UTC (' || strftime("timestamp" + INTERVAL 1 HOUR, '%H:%M:%S') END
    || ' Europe/Berlin)] [' || coalesce(nullif(source_alias, ''), source_ip) || '] [' || app_name || '] ['
    || (['EMERG','ALERT','CRIT','ERROR','WARN','NOTICE','INFO','DEBUG'])[severity + 1] || '] ' || message AS line FROM logs""")
def prompt_lines(t):
    return t.logs().select("id", L.prompt_line("Europe/Berlin", "Europe/Berlin").alias("line"))


@query("", """SELECT conv_id, turn, trim(text, E' \\t\\n\\r\\x0b\\x0c') AS summary, 'disk full' AS root_cause, 'free space' AS remediation
  FROM conversations WHERE trim(text, E' \\t\\n\\r\\x0b\\x0c') <> ''""")
def report_parts(t):
    c = t.read("conversations")
    text = F.concat(
        F.lit("## Summary\n"), "text", F.lit("\n## Root Cause Analysis\ndisk full\n## Actionable Remediation\n free space\n")
    )
    parts = c.select("conv_id", "turn", L.report_sections(text).alias("p")).select("conv_id", "turn", "p.*")
    return parts.filter("summary <> ''")


@query("logs", """SELECT id, array_to_string(regexp_extract_all(lower(message || ' ' || app_name), '[a-z0-9]+'), ' ') AS words FROM logs""")
def split_words(t):
    text = F.concat("message", F.lit(" "), "app_name")
    return t.logs().select("id", F.array_join(L.words(text), " ").alias("words"))


@query("", """SELECT lang, count(*) AS documents, CAST(sum(len(regexp_extract_all(
  lower(strip_accents(text)), '[\\p{L}\\p{N}]+'))) AS BIGINT) AS words FROM documents GROUP BY lang""")
def words_per_language(t):
    return t.read("documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.size(L.words("text"))).alias("words")
    )


TOKEN_SQL = r"""regexp_replace({0}, '((?:access[_-]?token|refresh[_-]?token|auth[_-]?token|session[_-]?token|token)'
  || '(?:\\?[""'']|)\s*[:=]\s*)(?:\\?["'']|)[A-Za-z0-9_\-./+=]{{8,}}(?:\\?["'']|)', '\1[REDACTED]', 'gi')""".replace('[""', '["')


@query("", f"SELECT doc_id, {TOKEN_SQL.format('text')} AS text FROM documents")
def redacted_documents(t):
    return L.redact_table(t.read("documents").select("doc_id", "text"), ["text"])


@query("", r"""SELECT event_id, CASE event_type WHEN 'click' THEN 'Authorization: Bearer [REDACTED]'
  WHEN 'view' THEN 'Set-Cookie: [REDACTED]' WHEN 'purchase' THEN 'postgres://app:[REDACTED]@db/x api_key=[REDACTED] ok'
  WHEN 'signup' THEN 'db_password=[REDACTED] ' || user_id ELSE 'secret: [REDACTED], k ' || props END AS text FROM events""")
def redacted_secrets(t):
    uid = F.col("user_id").cast("string")
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.concat(F.lit("Authorization: Bearer t0k"), uid))
        .when(kind == "view", F.concat(F.lit("Set-Cookie: sid="), uid, F.lit("; path=/")))
        .when(kind == "purchase", F.concat(F.lit("postgres://app:pw"), uid, F.lit("@db/x api_key='"), uid, F.lit("abcdefgh' ok")))
        .when(kind == "signup", F.concat(F.lit("db_password=\"a b "), uid, F.lit("\" "), uid))
        .otherwise(F.concat(F.lit("secret: x"), uid, F.lit(", k "), F.col("props")))
    )
    return t.read("events").select("event_id", L.redact(text).alias("text"))


def _sample_case(values: list[str], number: str = "event_id", which: str = "event_id % 30") -> str:
    """SQL: the sample text of a row, with its number in place of ``#``."""
    ways = " ".join(f"WHEN {k} THEN {_sql_text(v)}" for k, v in enumerate(values))
    return f"replace(CASE {which} {ways} END, '#', CAST({number} AS VARCHAR))"


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _sampled(t):
    """Events, each with the sample of one secret kind."""
    texts = F.array(*[F.lit(text) for _, text, _, _ in SAMPLES])
    text = F.replace(F.get(texts, (F.col("event_id") % 30).cast("int")), F.lit("#"), F.col("event_id").cast("string"))
    return t.read("events").select("event_id", text.alias("text"))


@query("", f"SELECT event_id, {_sample_case([x for _, _, x, _ in SAMPLES])} AS text FROM events")
def redacted_kinds(t):
    """Every secret kind."""
    return _sampled(t).withColumn("text", L.redact("text"))


@query("", "SELECT kind, CAST(count(event_id) AS BIGINT) AS row_count, CAST(count(event_id) AS BIGINT) AS match_count FROM (VALUES "
       + ", ".join(f"('{x}', {k})" for k, (kind, _, _, more) in enumerate(SAMPLES) for x in (kind, *more))
       + ") AS s(kind, k) LEFT JOIN events ON event_id % 30 = k GROUP BY kind")
def secret_kinds_sampled(t):
    """Rows and matches of every kind over the samples."""
    return L.secret_hits(_sampled(t), "text")


@query("", f"""SELECT event_id, 'row ' || event_id AS sample_log, {_sample_case([x for _, _, x, _ in SAMPLES])} AS incident_summary,
  {_sample_case([x for _, _, x, _ in SAMPLES], which="(event_id + 7) % 30")} AS user_context FROM events""")
def redacted_history(t):
    """The free texts of history rows."""
    shifted = F.col("event_id") + 7
    texts = F.array(*[F.lit(text) for _, text, _, _ in SAMPLES])
    other = F.replace(F.get(texts, (shifted % 30).cast("int")), F.lit("#"), F.col("event_id").cast("string"))
    rows = _sampled(t).select(
        "event_id", F.concat(F.lit("row "), F.col("event_id").cast("string")).alias("sample_log"),
        F.col("text").alias("incident_summary"), other.alias("user_context"),
    )
    return incidents.redact_history(rows)


@query()
def secret_kinds(t):
    return L.secret_hits(t.read("documents"), "text")


@query("", """SELECT event_id, event_type || ' done' AS shown FROM events""")
def displayed_messages(t):
    e = t.read("events")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    kind = F.col("event_type")
    line = (
        F.when(kind == "click", F.concat(F.lit("["), stamp, F.lit("] [warn] "), kind, F.lit(" done")))
        .when(kind == "view", F.concat(stamp, F.lit("  INFO   "), kind, F.lit(" done ")))
        .when(kind == "purchase", F.concat(F.lit("1:M 02 Oct 2026 11:47:57.745 # "), kind, F.lit(" done")))
        .when(kind == "signup", F.concat(F.lit("ts=x level=info msg=\""), kind, F.lit(" done\" a=b")))
        .otherwise(F.concat(F.lit("\x1b[31mERROR:\x1b[0m "), kind, F.lit(" done")))
    )
    return e.select("event_id", L.display_message(line).alias("shown"))


@query("", """SELECT event_id, CASE WHEN v < 0 THEN '-' ELSE '' END || CASE WHEN abs(v) >= 1048576 THEN
    printf('%.1f MB', abs(v) / 1048576.0) WHEN abs(v) >= 1024 THEN printf('%.1f KB', abs(v) / 1024.0)
    ELSE abs(v) || ' B' END AS size FROM (SELECT event_id, (event_id % 977) * 2048 - 1024 * (event_id % 3) - 300 AS v FROM events)""")
def byte_texts(t):
    v = (F.col("event_id") % 977) * 2048 - 1024 * (F.col("event_id") % 3) - 300
    return t.read("events").select("event_id", L.bytes_text(v).alias("size"))


@query("", """SELECT event_id, epoch_us(CASE WHEN event_id % 5 = 0 THEN date_trunc('second', ts) WHEN event_id % 5 = 1 THEN ts
    WHEN event_id % 5 = 2 THEN TIMESTAMP '2024-01-31' ELSE date_trunc('millisecond', ts) END) AS ts_us,
  'external' AS source_ip, CASE WHEN event_id % 2 = 0 THEN 'box' || user_id ELSE 'external' END AS source_alias,
  event_type AS app_name, CAST(least(greatest(user_id - 100, 0), 23) AS INTEGER) AS facility,
  CAST(CASE WHEN event_id % 3 = 0 THEN 3 WHEN event_id % 3 = 1 THEN event_id % 8 ELSE 6 END AS INTEGER) AS severity,
  props AS message, props AS raw FROM events""")
def json_records(t):
    """JSON text of every event, parsed and normalised as log records."""
    eid, ts = F.col("event_id"), F.col("ts")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    stamp = (
        F.when(eid % 5 == 0, F.unix_seconds(ts).cast("string"))
        .when(eid % 5 == 1, quoted(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
        .when(eid % 5 == 2, quoted(F.lit("not a time")))
        .otherwise(F.unix_millis(ts).cast("string"))
    )
    level = (
        F.when(eid % 3 == 0, F.lit(',"level":"Error"'))
        .when(eid % 3 == 1, F.concat(F.lit(',"severity":'), (eid % 8).cast("string")))
        .otherwise(F.lit(',"level":"loud"'))
    )
    alias = F.when(
        eid % 2 == 0, F.concat(F.lit(',"source_alias":"box'), F.col("user_id").cast("string"), F.lit('"'))
    ).otherwise("")
    body = F.concat(
        F.lit('{"ts":'), stamp, level, alias, F.lit(',"app":"'), F.col("event_type"), F.lit('","facility":"'),
        (F.col("user_id") - 100).cast("string"), F.lit('","msg":"'), F.replace("props", F.lit('"'), F.lit('\\"')), F.lit('"}'),
    )
    bodies = t.read("events").select("event_id", body.alias("body"))
    found = records.explode_records(bodies).withColumn("received_at", F.lit(AS_OF).cast("timestamp"))
    rows = records.normalize_json_records(found, "received_at", max_age_days=31)
    return rows.select(
        "event_id", us("timestamp", "ts_us"), "source_ip", "source_alias", "app_name", "facility", "severity",
        "message", "raw",
    )


@query("logs", """SELECT id, source_ip = 'docker' AS rejected FROM logs""")
def reserved_identities(t):
    good, bad = records.reserved_identity(t.logs())
    return good.select("id", F.lit(False).alias("rejected")).union(bad.select("id", F.lit(True)))
