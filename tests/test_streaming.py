"""Streams give what the batch operators give on the same rows."""

import datetime as dt
import random

import pytest
from helpers import alert_rule, alert_rules, at, drop_rule, drop_rules, log, logs
from pyspark.sql import functions as F

from logloom import streaming
from logloom.operators import alerts, assemble, filters, rules
from logloom.plans.tables import Tables
from logloom.schema import LOGS


at_seconds = int(at(0).replace(tzinfo=dt.timezone.utc).timestamp())


@pytest.fixture(autouse=True)
def few_tasks(spark):
    """State is kept per partition and every one starts a worker in every batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def write_in_order(df, folder, n, order="id"):
    """The rows as n files, each later in time than the one before."""
    rows = sorted(df.collect(), key=lambda r: r[order])
    step = -(-len(rows) // n)
    for i in range(0, len(rows), step):
        part = df.sparkSession.createDataFrame(rows[i : i + step], df.schema).coalesce(1)
        part.write.mode("append").parquet(f"{folder}/in")
        # the file source reads by modification time
    return f"{folder}/in"


def read_stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(query):
    assert query.awaitTermination(170)
    assert query.exception() is None


def to_table(stream, name, folder):
    finish(
        stream.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", f"{folder}/cp-{name}").trigger(availableNow=True).start()
    )
    return stream.sparkSession.table(name)


def storm(spark, n=3000):
    rnd = random.Random(7)
    rows, t = [], 0.0
    for i in range(n):
        t += rnd.choice([0.0, 0.01, 0.2, 1.5, 9.0])
        rows.append(log(i, t, app_name=rnd.choice(["nginx", "sshd", "cron"]), severity=rnd.randrange(8),
                        message=f"request {rnd.randrange(5)} failed"))
    return logs(spark, *rows, log(n, t + 100_000, severity=7, app_name="end", message="end"))


def test_alerts_equal_batch(spark, folder):
    table = alert_rules(
        spark,
        alert_rule(1, threshold_count=15, window_seconds=60, cooldown_seconds=120, filter_app="ssh*"),
        alert_rule(2, rule_type="rate", threshold_count=1, window_seconds=30, cooldown_seconds=300, filter_severity=6),
        alert_rule(3, rule_type="pattern", match_pattern="request 3", cooldown_seconds=0, filter_severity=2),
    )
    listed = rules.ordered_rules(table)
    df = storm(spark)
    path = write_in_order(df, folder, 3)
    got = to_table(streaming.alert_segments(read_stream(spark, path, LOGS), listed), "seg", folder)
    want = alerts.apply_cooldown(alerts.per_second(rules.match_alert_rules(df, listed)), listed)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert want.filter("first_place IS NOT NULL").select("rule_id").distinct().count() == 3

    got = spark.createDataFrame(got.collect(), got.schema)  # a sink's batch, not its memory table
    store, out = f"{folder}/logs", f"{folder}/incidents"
    early, late = (df.filter(F.col("id") % 2 == k) for k in (0, 1))
    none = got.limit(0)
    streaming.write_alerts(spark, got, 5, store, table, out)  # no store yet: nothing fails, nothing waits
    streaming.append_batch(early.filter("id <> 3000"), 0, store)  # without the last row, nothing is passed
    streaming.write_alerts(spark, none, 6, store, table, out, lag_seconds=1e6)
    part = spark.read.parquet(out)
    batch = alerts.fire_alerts(df, table)
    assert part.count() < batch.count() and part.filter("missing > 0").count() == 0
    streaming.append_batch(late, 1, store)
    for _ in range(2):  # a repeated batch replaces its incidents
        streaming.write_alerts(spark, none, 7, store, table, out, lag_seconds=1e6)
    stored = spark.read.parquet(out)
    assert sorted(stored.select(batch.columns).collect()) == sorted(batch.collect())
    streaming.write_alerts(spark, none, 8, store, table, out)
    assert spark.read.parquet(out).count() == batch.count()


def test_firings_without_their_rows(spark, folder):
    """Rows that are never stored do not hold back the incidents behind them."""
    table = alert_rules(spark, alert_rule(1, threshold_count=2, window_seconds=10, cooldown_seconds=20))
    listed = rules.ordered_rules(table)
    df = logs(spark, *[log(i, s) for i, s in enumerate([0, 1, 100, 101, 200, 201, 300])])
    got = alerts.apply_cooldown(alerts.per_second(rules.match_alert_rules(df, listed)), listed)
    got = spark.createDataFrame(got.collect(), got.schema)
    store, out = f"{folder}/logs", f"{folder}/incidents"
    streaming.append_batch(df.filter("id NOT IN (1, 2, 3, 6)"), 0, store)
    streaming.write_alerts(spark, got, 0, store, table, out)
    rows = sorted((r["fire_sec"] - at_seconds, r["match_count"], r["missing"], r["sample_log_id"]) for r in spark.read.parquet(out).collect())
    assert rows == [(1, 2, 1, 0), (101, 2, 2, None), (201, 2, 0, 5)]


def test_entries_equal_batch(spark, folder):
    rnd = random.Random(3)
    texts = ["start", "  at line", "\tmore", "ValueError: x", "", "Traceback (most recent call last):", "foo: bar", "at x"]
    rows, t = [], 0.0
    for i in range(600):
        t += rnd.choice([0.01, 0.05, 0.1, 0.4])
        text = rnd.choice(texts)
        rows.append((f"s{rnd.randrange(3)}", at(t), i, text, "raw " + text, rnd.randrange(8)))
    rows.append(("end", at(t + 1000), 999, "end", "end", 6))
    schema = "stream_key string, received_at timestamp, seq long, message string, raw string, severity int"
    df = spark.createDataFrame(rows, schema)
    path = write_in_order(df, folder, 3, "seq")
    limits = assemble.Limits(lines=6, seconds=1.0)
    stream = streaming.assemble_stream(read_stream(spark, path, df.schema), limits)
    got = to_table(stream, "entries", folder).filter("stream_key <> 'end'")
    want = assemble.assemble_multiline(df, limits).filter("stream_key <> 'end'")
    assert sorted(got.collect()) == sorted(want.collect())
    assert want.filter("line_count > 1").count() > 20


def test_one_busy_stream_in_slices(spark, folder, monkeypatch):
    """One key with most lines, out of order within files: what is held at once is one slice."""
    rnd = random.Random(9)
    rows, t = [], 0.0
    for i in range(3000):
        t += rnd.choice([0.001, 0.01, 0.02, 0.3])
        rows.append(("hot" if i % 10 else f"s{i % 7}", at(t), i, rnd.choice(["start", "  at x", "  at y", "", "ValueError: z"]), None, i % 8))
    rows.append(("end", at(t + 1000), 9999, "end", "end", 6))
    schema = "stream_key string, received_at timestamp, seq long, message string, raw string, severity int"
    df = spark.createDataFrame(rows, schema)
    path = f"{folder}/in"
    for k in range(3):
        part = [r for r in rows if min(r[2] // 1100, 2) == k]
        rnd.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    limits = assemble.Limits(lines=40, seconds=2.0, bytes=300)
    stream = streaming.assemble_stream(read_stream(spark, path, df.schema), limits, "60 seconds", slice_seconds=0.5)
    got = to_table(stream, "busy", folder).filter("stream_key <> 'end'")
    want = assemble.assemble_multiline(df, limits).filter("stream_key <> 'end'")
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and want.filter("line_count > 2").count() > 50


def test_streams_share_the_state_of_a_bucket(spark, folder, monkeypatch):
    """Many short streams in one bucket, with pauses, over several micro-batches: the entries of the batch."""
    from logloom.streaming import entries

    monkeypatch.setattr(entries, "BUCKETS", 1)
    rnd = random.Random(21)
    rows = []
    for k in range(60):
        t = rnd.uniform(0, 20)
        for i in range(rnd.randrange(1, 12)):
            t += rnd.choice([0.01, 0.1, 0.7, 6.0])
            rows.append((f"s{k}" if k else None, at(t), len(rows), rnd.choice(["start", "  at x", "", "ValueError: z"]), "r", k % 8))
    rows.append(("end", at(1000), 9999, "end", "end", 6))
    schema = "stream_key string, received_at timestamp, seq long, message string, raw string, severity int"
    df = spark.createDataFrame(rows, schema)
    limits = assemble.Limits(lines=5, seconds=2.0)
    source = read_stream(spark, write_in_order(df, folder, 3, "received_at"), df.schema)
    stream = streaming.assemble_stream(source, limits, "30 seconds", slice_seconds=0.5)
    grouped = stream._jdf.queryExecution().logical().toString()
    assert "line_bucket" in grouped
    got = to_table(stream, "shared", folder).filter("stream_key IS NULL OR stream_key <> 'end'")
    want = assemble.assemble_multiline(df.filter("stream_key IS NOT NULL"), limits).filter("stream_key <> 'end'")
    assert sorted(got.filter("stream_key IS NOT NULL").collect()) == sorted(want.collect()) and want.count() > 100
    assert got.filter("stream_key IS NULL").count() > 0


def test_normalize_filter_store_and_index(spark, folder):
    lines = spark.createDataFrame(
        [
            (f"<{8 + i % 8}>Mar 10 12:00:0{i % 10} box{i % 3} app{i % 4}[1]: text {i}", f"10.0.0.{i % 5}", at(i), i)
            for i in range(200)
        ],
        "value string, source_ip string, received_at timestamp, seq long",
    )
    path = write_in_order(lines, folder, 2, "seq")
    aliases = spark.createDataFrame([("10.0.0.1", "gate", "")], "ip string, alias string, notes string")
    dropped = drop_rules(spark, drop_rule(1, app_pattern="app2"), drop_rule(2, message_pattern="text 7"))
    sessions = spark.createDataFrame(
        [("m1", "drop_errors", "app*", "gate", at(50), at(100), None)],
        "session_id string, log_handling string, target_app string, target_host string, created_at timestamp,"
        " expires_at timestamp, ended_at timestamp",
    )

    def shape(df):
        return streaming.filter_stream(streaming.normalize_stream(df, aliases), dropped, sessions)

    stream = shape(read_stream(spark, path, lines.schema))
    store, index, seen = f"{folder}/logs", f"{folder}/index", []
    sink = streaming.fan_out(
        lambda b, i: streaming.append_batch(b, i, store),
        lambda b, i: streaming.index_batch(streaming.stream_ids(b, i), i, index, buckets=8),
        lambda b, i: seen.append(b.count()),
    )
    finish(streaming.start(stream, sink, f"{folder}/cp", availableNow=True))
    got = spark.read.parquet(store)
    want = shape(lines)
    want = spark.createDataFrame(want.collect(), want.schema)  # the plan runs once
    cols = ["timestamp", "source_ip", "source_alias", "app_name", "severity", "message"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())
    assert sum(seen) == want.count() < 200
    in_order = [r["message"] for r in got.orderBy("id").collect()]
    assert in_order == [r["message"] for r in want.orderBy("seq").collect()]
    assert spark.read.parquet(index).select("log_id").distinct().count() == want.count()
    # a repeated batch changes nothing
    first = want.filter("seq < 10")
    streaming.append_batch(first, 0, f"{folder}/again")
    streaming.append_batch(first, 0, f"{folder}/again")
    assert spark.read.parquet(f"{folder}/again").count() == first.count()


def test_replays_rates_and_tail(spark, folder):
    rows = [("c1", at(i), f"m{i}", at(i), i) for i in range(50)]
    lines = spark.createDataFrame(
        rows + rows[20:30], "container_id string, ts timestamp, message string, received_at timestamp, id long"
    )
    path = f"{folder}/lines"
    lines.coalesce(1).write.parquet(path)
    stream = read_stream(spark, path, lines.schema)
    once = to_table(streaming.drop_replays_stream(stream), "once", folder)
    assert once.count() == 50

    rates = to_table(streaming.rate_stream(stream, seconds=5, slide=5), "rates", folder)
    assert {r["rate"] for r in rates.collect()} <= {1.0, 2.0}
    assert rates.count() >= 5

    taken = []
    cond = filters.all_of(F.col("message") != "m3")
    query = streaming.tail_stream(
        stream, cond, lambda b, i: taken.extend(r["message"] for r in b.collect()), f"{folder}/tail",
        max_events=7, availableNow=True,
    )
    query.awaitTermination(100)
    assert len(taken) == 7 and "m3" not in taken


def test_replays_of_any_age(spark, folder):
    rows = [("c1", at(i), f"m{i}", i) for i in range(30)] + [("c2", at(5), f"x{i % 3}", 100 + i) for i in range(9)] + [("c2", None, "no time", 200)]
    schema = "container_id string, ts timestamp, message string, seq long"
    batches = [rows[:20], rows[:20] + rows[20:], [*rows[10:12], ("c2", at(5), "x9", 300), ("c2", at(5), "x1", 301), ("c1", at(40), "new", 302), ("c1", at(39), "older", 303)], [("c3", at(0), "a", 400)] * 2]
    seen = {}
    sink = streaming.without_replays(lambda b, i: seen.__setitem__(i, sorted(r["message"] for r in b.collect())), f"{folder}/state")
    for k, part in enumerate(batches):
        numbered = [(c, t, m, s + 1000 * k) for c, t, m, s in part]
        for _ in range(2):  # every batch is repeated
            sink(spark.createDataFrame(numbered, schema), k)
    assert seen[0] == sorted(f"m{i}" for i in range(20))
    assert seen[1] == sorted([*(f"m{i}" for i in range(20, 30)), "x0", "x1", "x2", "no time"])
    assert seen[2] == ["new", "x9"] and seen[3] == ["a"]


def test_late_rows_are_kept_beside(spark, folder):
    df = logs(spark, log(1, 100), log(2, 95), log(3, 80), log(4, 200), log(5, 189), log(6, 190))
    seen = {}
    sink = streaming.late_rows_beside(lambda b, i: seen.__setitem__(i, sorted(r["id"] for r in b.collect())), f"{folder}/late", f"{folder}/mark")
    for number, part in ((0, "id = 1"), (1, "id IN (2, 3, 4)"), (1, "id IN (2, 3, 4)"), (2, "id IN (5, 6)")):
        sink(df.filter(part), number)
    assert seen == {0: [1], 1: [2, 4], 2: [6]}
    assert sorted(r["id"] for r in spark.read.parquet(f"{folder}/late").collect()) == [3, 5]


def test_rules_are_read_for_every_batch(spark):
    df = logs(spark, log(1, app_name="a"), log(2, app_name="b"))
    none = spark.createDataFrame([], "session_id string, log_handling string, target_app string, target_host string,"
                                 " created_at timestamp, expires_at timestamp, ended_at timestamp")
    tables = iter([drop_rules(spark, drop_rule(1, app_pattern="a")), drop_rules(spark, drop_rule(1, app_pattern="b"))])
    seen = []
    sink = streaming.filtered(lambda b, i: seen.append([r["id"] for r in b.collect()]), lambda: next(tables), lambda: none)
    sink(df, 0)
    sink(df, 1)
    assert seen == [[2], [1]]


def test_clamped_times(spark):
    df = logs(spark, log(1, 0, timestamp=at(-200_000)), log(2, 0, timestamp=at(1000)), log(3, 0, timestamp=at(10)))
    got = {r["id"]: r["timestamp"] for r in streaming.clamp_event_time(df).collect()}
    assert got == {1: at(-86_400), 2: at(300), 3: at(10)}


def test_stream_and_batch_rules_on_given_table(spark, folder):
    t = Tables(spark, "/root/testdata/sf0.001")
    df = t.logs()
    path = write_in_order(df, folder, 3)
    marked = streaming.mark_stream(read_stream(spark, path, df.schema), t.drop_rules(), t.sessions())
    got = to_table(marked.select("id", "drop_rule_id", "session_id"), "marks", folder)
    want = streaming.mark_stream(df, t.drop_rules(), t.sessions()).select("id", "drop_rule_id", "session_id")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
