"""Operators on hand-made rows, against plain Python, and under any partitioning."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from helpers import T0, alert_rule, alert_rules, at, drop_rule, drop_rules, log, logs, rows_moved
from pyspark.sql import functions as F

from logloom import streaming
from logloom.operators import (
    alerts,
    assemble,
    context,
    counts,
    dims,
    facets,
    filters,
    incidents,
    indexsearch,
    maintenance,
    ordered,
    reports,
    retention,
    rules,
    search,
    textindex,
)
from logloom.operators.filters import LogFilter
from logloom.operators.textquery import AllOf, AnyOf, NoneOf, Phrase, Term
from logloom.plans.tables import Tables
from logloom.schema import LOGS
from logloom.sources import logs as stored
from logloom.sources.stored import Folder

UTC = dt.timezone.utc


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_terms_and_phrases(spark):
    df = logs(
        spark,
        log(1, message="Connection reset by peer"), log(2, message="connections"), log(3, app_name="connector"),
        log(4, message="re-connect", source_alias="edge-2"), log(5, message="disk é full", source_ip="10.2.3.4"),
        log(6, message="reset connection"),
    )
    has = lambda *a, **k: ids(df.filter(filters.has_term(*a, **k)))
    assert has("conn") == [1, 2, 3, 4, 6]
    assert has("re") == [4]  # short terms match whole words
    assert has("re*") == [1, 4, 6]
    assert has("connect", field="app") == [3]
    assert has("edge-2") == [4] and has("EDGE", field="host") == [4]
    assert has("E") == [5] and has("10.2.3.4", live=True) == [5] and has("10.2.3.4") == []
    phrase = lambda *a, **k: ids(df.filter(filters.has_phrase(*a, **k)))
    assert phrase("connection reset") == [1] and phrase("connection res") == []
    assert phrase("connection res", prefix=True) == [1]
    assert ids(df.filter(filters.all_of(filters.has_term("conn"), filters.none_of(filters.has_term("reset"))))) == [2, 3, 4]


def test_sources_and_containers(spark):
    df = logs(
        spark, log(1, source_ip="10.0.0.1", source_alias="a"), log(2, source_ip="10.0.0.1", source_alias="box"),
        log(3, source_ip="docker", source_alias="docker"), log(4, source_ip="10.0.0.1", source_alias=""),
    )
    assert ids(df.filter(filters.sources(["10.0.0.1"], ["box"]))) == [1, 4]
    assert ids(df.filter(filters.sources(["box", "docker"], ["box"]))) == [2, 3]
    assert ids(df.filter(filters.log_filter(LogFilter()))) == [1, 2, 3, 4]


def test_delete_needs_criteria_and_keeps_nulls(spark):
    df = logs(spark, log(1), log(2)).withColumn("severity", F.when(F.col("id") == 1, 3))
    with pytest.raises(ValueError):
        retention.delete_logs(df, LogFilter())
    kept, gone = retention.delete_logs(df, LogFilter(severity_max=3))
    assert ids(kept) == [2] and gone.first()[0] == 1
    assert ids(retention.delete_logs(df, LogFilter(), delete_all=True)[0]) == []


def test_pages_walk_the_whole_table(spark):
    rnd = random.Random(1)
    df = logs(spark, *[log(i, rnd.randrange(30)) for i in range(57)])
    want = [r["id"] for r in sorted(df.collect(), key=lambda r: (r["timestamp"], r["id"]), reverse=True)]
    got, cursor = [], None
    while True:
        page = search.search_after(df, LogFilter(), cursor, limit=10).orderBy(*search.newest_first()).collect()
        got += [r["id"] for r in page]
        cursor = page[-1]["next_cursor"]
        if cursor is None:
            break
    assert got == want
    with pytest.raises(ValueError):
        search.decode_cursor("rubbish")


def test_drop_rules_first_match(spark):
    df = logs(
        spark, log(1, app_name="cron"), log(2, app_name="Cron", severity=2), log(3, message="GET /health 200"),
        log(4, message="user=7 done"), log(5, source_alias="lab-1"), log(6, message="other"),
    )
    table = drop_rules(
        spark, drop_rule(1, app_pattern="CRON", severity_threshold=5, display_order=9),
        drop_rule(2, message_pattern="/health*20?", display_order=1),
        drop_rule(3, message_pattern=r"(?P<who>user)=\d", is_regex=True),
        drop_rule(4, message_pattern="(broken", is_regex=True), drop_rule(5, source_pattern="lab-*, x"),
        drop_rule(6, app_pattern="cron", display_order=0, is_enabled=False),
    )
    got = {r["id"]: r["drop_rule_id"] for r in rules.apply_drop_rules(df, table).collect()}
    assert got == {1: 1, 2: None, 3: 2, 4: 3, 5: 5, 6: None}


def test_many_rules_are_sliced(spark):
    df = logs(spark, *[log(i, message=f"word{i} x") for i in range(130)])
    drops = drop_rules(spark, *[drop_rule(i + 1, message_pattern=f"word{i} x") for i in range(120)])
    got = {r["id"]: r["drop_rule_id"] for r in rules.apply_drop_rules(df, drops).collect()}
    assert got == {i: i + 1 if i < 120 else None for i in range(130)}
    table = alert_rules(spark, *[alert_rule(i + 1, match_pattern=f"word{i} x", filter_app="nginx") for i in range(120)])
    plain = sorted((r["id"], r["rule_id"]) for r in rules.match_alert_rules(df, table).collect())
    indexed = sorted((r["id"], r["rule_id"]) for r in rules.match_rules_indexed(df, table).collect())
    assert plain == indexed == [(i, i + 1) for i in range(120)]


def brute_firings(rows, needed, window, cooldown):
    """Row by row: the ids at which a rule fires, and the ids each firing held."""
    held, quiet, out = [], None, []
    for row in sorted(rows, key=lambda r: (r["timestamp"], r["id"])):
        sec = int((row["timestamp"] - dt.datetime(1970, 1, 1)).total_seconds() // 1)
        held = [(s, i) for s, i in held if s >= sec - window] + [(sec, row["id"])]
        if len(held) >= needed and (quiet is None or sec >= quiet):
            out.append((row["id"], sorted(i for _, i in held)))
            held, quiet = [], sec + cooldown
    return out


def storm_rows(n=1500, seed=11):
    rnd = random.Random(seed)
    rows, t = [], 0.0
    for i in range(n):
        t += rnd.choice([0.0, 0.0, 0.002, 0.3, 1.7, 20.0])
        rows.append(log(i, t, app_name=rnd.choice(["a", "a", "b"]), message=rnd.choice(["x 1", "x 2", "y"]),
                        source_alias=rnd.choice(["", "h1"])))
    return rows


@pytest.mark.parametrize("needed,window,cooldown", [(1, 60, 0), (5, 10, 0), (8, 30, 45), (3, 5, 5), (20, 120, 60)])
def test_firings_equal_brute_force(spark, needed, window, cooldown):
    rows = storm_rows()
    df = logs(spark, *rows).repartition(7)
    table = alert_rules(spark, alert_rule(1, threshold_count=needed, window_seconds=window, cooldown_seconds=cooldown))
    listed = rules.ordered_rules(table)
    matches = rules.match_alert_rules(df, listed)
    segments = alerts.apply_cooldown(alerts.per_second(matches), listed)
    held = defaultdict(list)
    last = {}
    for r in alerts.firing_matches(matches, segments).collect():
        key = (r["fire_sec"], r["k"])
        held[key].append(r["id"])
        if r["sec"] == r["fire_sec"] and r["place"] is not None:
            last[key] = max(last.get(key, (0, 0)), (r["place"], r["id"]))
    got = sorted((last[k][1], sorted(v)) for k, v in held.items())
    assert got == sorted(brute_firings(rows, needed, window, cooldown))
    assert alerts.firings(segments).count() == len(got)


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_alerts_do_not_depend_on_partitions(spark, parts):
    table = alert_rules(
        spark, alert_rule(1, threshold_count=6, window_seconds=30, cooldown_seconds=10),
        alert_rule(2, rule_type="rate", threshold_count=1, window_seconds=4, cooldown_seconds=5, filter_app="a"),
    )
    df = logs(spark, *storm_rows()).orderBy(F.rand(parts)).repartition(parts)
    got = sorted(map(str, alerts.fire_alerts(df, table).collect()))
    want = sorted(map(str, alerts.fire_alerts(logs(spark, *storm_rows()).coalesce(1), table).collect()))
    assert got == want and len(got) > 10


def test_incident_of_a_storm(spark):
    rows = [log(i, i * 0.1, app_name="api" if i % 3 else "db", message=f"slow {i % 2}", source_alias="") for i in range(30)]
    table = alert_rules(
        spark, alert_rule(1, name="storm", rule_type="rate", threshold_count=15, window_seconds=2, channel_id=4),
        alert_rule(2, name="few", threshold_count=3, window_seconds=60, cooldown_seconds=600),
    )
    got = {r["rule_id"]: r for r in alerts.fire_alerts(logs(spark, *rows), table).collect()}
    storm, few = got[1], got[2]
    assert storm["trigger_count"] == 30 and storm["channel_id"] == 4 and storm["sample_log_id"] == 29
    assert storm["incident_summary"] == (
        "Log storm detected: 30 logs in 2s (15.0 logs/s).\n\n### Primary Culprits\n- Top Service / App: api (20/30, 67%)\n"
        "- Top Host / Source: 10.0.0.1 (30/30, 100%)\n- Top Pattern: slow 0 (x15, 50%)"
    )
    assert few["trigger_count"] == 3 and few["sample_log_id"] == 2 and few["host"] == "10.0.0.1"
    assert few["incident_summary"] == "Alert triggered with 3 matching event(s)."
    assert few["triggered_at"] == at(0.2)
    timing = {r["rule_id"]: r for r in alerts.rule_timing(alerts.fire_alerts(logs(spark, *rows), table), table).collect()}
    assert timing[2]["suppress_until"] == at(600.2) and timing[2]["trigger_count"] == 1


def test_threshold_count_is_capped_after_a_quiet_time(spark):
    rows = [log(i, i) for i in range(100)]
    table = alert_rules(spark, alert_rule(1, threshold_count=5, window_seconds=60, cooldown_seconds=30))
    got = [r["trigger_count"] for r in alerts.fire_alerts(logs(spark, *rows), table).orderBy("triggered_at").collect()]
    assert got == [5, 6, 6, 6]


def fold_entries(rows, limits):
    """Entries line by line in plain Python, from the library's fold and classifiers."""
    out = []
    for key in sorted({r["stream_key"] for r in rows}):
        fold = assemble.EntryFold(limits)
        for r in sorted((x for x in rows if x["stream_key"] == key), key=lambda x: (x["received_at"], x["seq"])):
            line = {k: r[k] for k in ("stream_key", "received_at", "seq", "message", "raw", "severity")}
            now = round((r["received_at"] - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
            out += fold.add(line, now, r["cont"], r["blank"], r["ends"])
        out += fold.take()
    return sorted((e["stream_key"], e["seq"], e["message"], e["raw"], e["severity"], e["line_count"]) for e in out)


@pytest.mark.parametrize(
    "limits", [assemble.Limits(), assemble.Limits(lines=3), assemble.Limits(chars=30), assemble.Limits(bytes=25, gap=None),
               assemble.Limits(seconds=0.3, gap=1.0)],
)
def test_assembly_equals_line_by_line(spark, limits):
    rnd = random.Random(5)
    texts = ["start", "  at x", "\tmore", "KeyError: 'a'", "", "Traceback (most recent call last):", '  File "a.py"',
             "foo.Bar: baz", "error: no", "Caused by: y", "...", "   ", "été"]
    rows, t = [], 0.0
    for i in range(900):
        t += rnd.choice([0.01, 0.05, 0.15, 0.3])
        text = rnd.choice(texts)
        rows.append((rnd.choice(["a", "a", "a", "b"]), at(t), i, text, "r" + text, rnd.randrange(8)))
    df = spark.createDataFrame(
        rows, "stream_key string, received_at timestamp, seq long, message string, raw string, severity int"
    )
    m = F.col("message")
    flagged = df.withColumns({
        "cont": assemble.is_continuation(m), "blank": m == "",
        "ends": ~assemble.is_continuation(m) & assemble._ends_traceback(m),
    }).collect()
    want = fold_entries(flagged, limits)
    for chunk in (1, 60):
        got = assemble.assemble_multiline(df.repartition(5), limits, chunk_seconds=chunk)
        assert sorted((r["stream_key"], r["seq"], r["message"], r["raw"], r["severity"], r["line_count"]) for r in got.collect()) == want


def test_traceback_is_one_entry(spark):
    text = ["ERROR: job failed", "Traceback (most recent call last):", '  File "a.py", line 1', "", "my.custom: boom",
            "ValueError: x", "INFO: next"]
    df = spark.createDataFrame(
        [("s", at(i * 0.01), i, m, m, 3 if i == 0 else 6) for i, m in enumerate(text)],
        "stream_key string, received_at timestamp, seq long, message string, raw string, severity int",
    )
    got = [r["message"] for r in assemble.assemble_multiline(df).orderBy("seq").collect()]
    assert got == ["\n".join(text[:6]), text[6]]


def test_orphan_lines(spark):
    rows = [
        ("10.0.0.1", at(0), 0, "api", "failed", "failed"), ("10.0.0.1", at(0.05), 1, "unknown", "  at x", "  at x"),
        ("10.0.0.1", at(0.1), 2, "ValueError", "bad", "ValueError: bad"), ("10.0.0.1", at(0.15), 3, "unknown", "plain", "plain"),
        ("10.0.0.1", at(9), 4, "unknown", "  late", "  late"), ("10.0.0.2", at(0.05), 5, "unknown", "  alone", "  alone"),
    ]
    df = spark.createDataFrame(
        rows, "source_ip string, received_at timestamp, seq long, app_name string, message string, raw string"
    )
    got = {r["seq"]: (r["app_name"], r["message"], r["stream_key"]) for r in assemble.attach_orphan_lines(df).collect()}
    assert got[1] == ("api", "  at x", "10.0.0.1:api") and got[2] == ("api", "ValueError: bad", "10.0.0.1:api")
    assert [got[i][0] for i in (3, 4, 5)] == ["unknown"] * 3


def test_replays(spark):
    rnd = random.Random(2)
    rows = [("c", at(rnd.randrange(40)), f"m{rnd.randrange(3)}", i) for i in range(400)] + [("c", None, "no time", 400)]
    df = spark.createDataFrame(rows, "container_id string, ts timestamp, message string, seq long").repartition(3)
    want, newest, seen = [400], None, set()
    for _, ts, m, i in rows[:-1]:
        if newest is not None and (ts < newest or (ts == newest and m in seen)):
            continue
        seen = seen | {m} if ts == newest else {m}
        newest = ts
        want.append(i)
    assert sorted(r["seq"] for r in assemble.drop_replays(df).collect()) == sorted(want)


def test_running_values_on_a_hot_group(spark):
    rnd = random.Random(4)
    rows = [log(i, rnd.randrange(5000), source_ip="hot" if i % 3 else f"h{i % 5}", severity=rnd.randrange(8)) for i in range(600)]
    df = logs(spark, *rows)
    value = F.when(F.col("severity") > 5, F.col("severity"))
    got = ordered.running(
        df, ["source_ip"], ["timestamp", "id"],
        {"last": ("last", value), "top": ("max", F.col("severity")), "sum": ("sum", F.col("severity"))}, inclusive=False,
    )
    state, want = {}, {}
    for r in sorted(rows, key=lambda r: (r["timestamp"], r["id"])):
        last, top, total = state.get(r["source_ip"], (None, None, 0))
        want[r["id"]] = (last, top, total)
        s = r["severity"]
        state[r["source_ip"]] = (s if s > 5 else last, s if top is None else max(top, s), total + s)
    assert {r["id"]: (r["last"], r["top"], r["sum"]) for r in got.collect()} == want


def test_context_equals_brute_force(spark):
    rnd = random.Random(6)
    rows = [log(i, rnd.randrange(4000), source_alias=rnd.choice(["hot", "hot", "b", ""]), app_name=rnd.choice("xy")) for i in range(500)]
    df = logs(spark, *rows)
    targets = spark.createDataFrame([(i,) for i in range(0, 500, 9)], "id long")
    for same_app in (False, True):
        groups = defaultdict(list)
        for r in sorted(rows, key=lambda r: (r["timestamp"], r["id"])):
            groups[(r["source_alias"] or r["source_ip"], r["app_name"] if same_app else "")].append(r["id"])
        want = set()
        for line in groups.values():
            for p, i in enumerate(line):
                if i % 9 == 0:
                    want |= {(i, line[q], q - p) for q in range(max(0, p - 4), min(len(line), p + 5))}
        got = context.log_context(df, targets, n=4, same_app=same_app)
        assert {(r["target_id"], r["id"], r["distance"]) for r in got.collect()} == want
    one = context.context_of(df, df.filter("id = 90").first(), n=4).collect()
    assert [r["id"] for r in one] == [i for _, i, _ in sorted(
        ((r["target_id"], r["id"], r["distance"]) for r in context.log_context(df, targets, n=4).filter("target_id = 90").collect()),
        key=lambda x: x[2])]
    assert context.per_side(1) == 1 and context.per_side(10) == 5


def schedule(spark, **k):
    row = dict(id=1, name="s", enabled=True, recurrence="daily", start_time="01:30", duration_minutes=60, day_of_week=0, day_of_month=31)
    row.update(k)
    return spark.createDataFrame(
        [tuple(row.values())],
        "id long, name string, enabled boolean, recurrence string, start_time string, duration_minutes int, day_of_week int, day_of_month int",
    )


def windows(df, lo, hi, tz="Europe/London"):
    out = maintenance.expand_schedules(df, lo.replace(tzinfo=UTC), hi.replace(tzinfo=UTC), tz).orderBy("window_start")
    return [(r["window_start"], r["window_end"]) for r in out.collect()]


def test_schedules_over_clock_changes(spark):
    d = dt.datetime
    # spring: 01:30 does not exist on 29 March and moves to 02:30 summer time
    spring = windows(schedule(spark), d(2026, 3, 28), d(2026, 3, 31))
    assert spring == [(d(2026, 3, 28, 1, 30), d(2026, 3, 28, 2, 30)), (d(2026, 3, 29, 1, 30), d(2026, 3, 29, 2, 30)),
                      (d(2026, 3, 30, 0, 30), d(2026, 3, 30, 1, 30))]
    # autumn: the first 01:30 of 25 October
    autumn = windows(schedule(spark, duration_minutes=120), d(2026, 10, 25), d(2026, 10, 25, 12))
    assert autumn == [(d(2026, 10, 25, 0, 30), d(2026, 10, 25, 2, 30))]
    monthly = windows(schedule(spark, recurrence="monthly", start_time="23:00", duration_minutes=180), d(2026, 2, 1), d(2026, 4, 1), "UTC")
    assert [w[0] for w in monthly] == [d(2026, 1, 31, 23), d(2026, 2, 28, 23), d(2026, 3, 31, 23)]
    weekly = windows(schedule(spark, recurrence="weekly", day_of_week=7, start_time="99:99"), d(2026, 3, 1), d(2026, 3, 9), "UTC")
    assert [w[0] for w in weekly] == [d(2026, 3, 1, 2), d(2026, 3, 8, 2)]
    assert windows(schedule(spark, enabled=False), d(2026, 3, 1), d(2026, 3, 9)) == []


def test_session_paths_agree(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    pick = lambda n: sorted(map(str, maintenance.maintenance_drops(t.logs(), t.sessions(), compiled=n).select("id", "session_id").collect()))
    assert pick(200) == pick(0)


def test_aliases(spark):
    df = logs(spark, log(1, source_ip="10.0.0.1"), log(2, source_ip="10.0.0.2"), log(3, source_ip="10.0.0.3")).withColumn(
        "hostname", F.when(F.col("id") == 2, "real").when(F.col("id") == 3, "Docker"))
    aliases = spark.createDataFrame([("10.0.0.1", "gate", "edge box")], "ip string, alias string, notes string")
    assert [r["source_alias"] for r in dims.resolve_alias(df, aliases).orderBy("id").collect()] == ["gate", "real", "10.0.0.3"]
    wanted = spark.createDataFrame([("GATE",), ("box",)], "n string")
    more = spark.createDataFrame([("10.0.0.1", "gate", ""), ("10.0.0.9", "Box", "")], "ip string, alias string, notes string")
    exact = spark.createDataFrame([("box",)], "n string")
    assert sorted(r[0] for r in dims.expand_sources(wanted, more, exact).collect()) == ["10.0.0.1", "GATE", "box", "gate"]
    rows = logs(spark, log(1, source_ip="10.0.0.1", source_alias="gate"))
    assert dims.notes_text(rows, aliases).first()[0] == "edge box"
    both = rows.union(logs(spark, log(2, source_ip="x", source_alias="y")))
    assert dims.notes_text(both, aliases).first()[0] == "- [gate]: edge box"


def test_facet_limits(spark):
    df = logs(spark, *[log(i, source_alias=f"h{i:03}", source_ip=f"i{i}", app_name=f"a{i % 4}") for i in range(30)])
    none = spark.createDataFrame([], "ip string, alias string, notes string")
    got = {r["kind"]: r for r in facets.facets(df, none, limit=10).collect()}
    assert got["hosts"]["names"] == [f"h{i:03}" for i in range(10)] and got["hosts"]["truncated"]
    assert got["apps"]["names"] == ["a0", "a1", "a2", "a3"] and not got["apps"]["truncated"]


def test_budget_equals_text_cut(spark):
    """The kept lines are the end of the joined text, cut as a whole text would be."""
    rnd = random.Random(8)
    for longest, budget in ((40, 300), (900, 2000), (5000, 1500), (600, 700)):
        lines = ["x" * rnd.randrange(longest) + str(i) for i in range(25)]
        text, notice = "\n".join(lines), "[... Truncated older logs to fit token budget ...]\n"
        if len(text) <= budget:
            want = text
        else:
            end = text[-(budget - len(notice)):]
            cut = end.find("\n")
            want = end[cut + 1:] if 0 <= cut < 500 else end
        df = spark.createDataFrame([("k", at(i * 40), i, v) for i, v in enumerate(lines)], "g string, timestamp timestamp, id long, line string")
        kept = incidents.newest_within_budget(df, ["g"], ["timestamp", "id"], max_chars=budget).orderBy("id").collect()
        assert "\n".join(r["line"] for r in kept) == want


def test_bundle_is_redacted_and_fenced(spark):
    rows = logs(spark, log(1, 0, message="pwd=abc ``` x"), log(2, 5, message="later")).withColumn("incident_id", F.lit(7))
    got = incidents.bundle_lines(rows).first()
    assert got["bundle"] == (
        "[2026-03-10 12:00:00] [web] [nginx] [INFO] pwd=[REDACTED] ''' x\n[2026-03-10 12:00:05] [web] [nginx] [INFO] later"
    )
    assert got["size_estimate"] == int(len(got["bundle"]) // 3.5 + 50)
    aliases = spark.createDataFrame([("10.0.0.1", "web", "main")], "ip string, alias string, notes string")
    head = incidents.bundle_header(rows, tz="Asia/Tokyo", aliases=aliases).first()
    assert tuple(head) == (7, "web", "nginx", 2, "UTC+09:00", "- [web]: main")


def test_digest_text(spark):
    rows = logs(spark, log(1, severity=2), log(2, severity=3), log(3, app_name="", severity=6), log(4, source_ip="docker", app_name="db", severity=3))
    metrics = spark.createDataFrame([(at(-3600), 1000)], "recorded_at timestamp, db_size_bytes long")
    body = reports.digest_text(rows, metrics, 3048, at(60)).first()[0]
    assert body == (
        "### 24-Hour Analytical Rollup\n- **Total Logs Ingested:** 4\n- **System Storage Delta:** +2.0 KB\n\n"
        "### Top Apps / Hosts with Errors or Above\n- **web**: 2 events (1 crit, 1 error)\n- **db**: 1 error\n\n"
        "### Top Logging Services\n- **nginx**: 2 logs\n- **db**: 1 log\n- **unknown**: 1 log"
    )
    empty = reports.digest_text(rows.limit(0), metrics.limit(0), 5, at(60)).first()[0]
    assert "- No errors or critical events recorded" in empty and "Delta:** 0 B" in empty


def test_system_report(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    as_of = dt.datetime(2024, 1, 31, tzinfo=UTC)
    got = reports.system_metrics(t.logs(), t.incidents(), t.sessions(), t.schedules(), t.metrics(), as_of).collect()
    stats = counts.error_stats(t.logs(), as_of).first()
    assert len(got) == 1 and got[0]["error_count_24h"] == stats["error_count_24h"]
    assert got[0]["log_handling"] in ("drop_errors", "silence_alerts")


def test_index_answers_filters(spark, folder):
    rnd = random.Random(21)
    pool = ["error", "err", "disk", "disk2", "full", "10.0.0.7", "time-out", "é", "timeout", "ok"]
    rows = [log(i, i * 700, app_name=rnd.choice(["disk", "nginx", "cron"]), source_alias=rnd.choice(["web", "", "err-1"]),
                severity=rnd.randrange(8), message=" ".join(rnd.choices(pool, k=rnd.randrange(6)))) for i in range(700)]
    df = logs(spark, *rows).withColumn("log_date", F.to_date("timestamp"))
    path = f"{folder}/index"
    textindex.write_postings(textindex.build_postings(df.filter("id % 3 <> 0"), by_day=True), path, buckets=8)
    streaming.index_batch(df.filter("id % 3 = 0"), 4, path, buckets=8, by_day=True)
    streaming.index_batch(df.filter("id % 3 = 0"), 4, path, buckets=8, by_day=True)
    postings = spark.read.parquet(path)
    texts = [
        Term("e*"), Phrase("time out", prefix=True), Term("10.0.0.7"), Term("?!"), Phrase("error error"),
        AllOf(Term("disk", "msg"), NoneOf(Term("full"), Phrase("disk2 ok"))), AnyOf(Term("é"), AllOf(Term("timeout"), Term("err", "host"))),
        NoneOf(AllOf(Term("error"), NoneOf(Term("disk")))), AllOf(), AnyOf(),
    ]
    specs = [LogFilter(text=x) for x in texts] + [
        LogFilter(terms=["err", "disk"], phrases=["full ok"], as_of=T0), LogFilter(terms=["err"], not_terms=["disk"], severity_max=4, start=at(50_000), end=at(300_000), as_of=T0),
        LogFilter(apps=["cron"], text=AnyOf(Term("disk"), Term("full")), as_of=T0),
    ]
    for k, spec in enumerate(specs):
        want = ids(filters.matching(df, spec))
        assert ids(indexsearch.matching_by_index(df, postings, spec, 8)) == want, spec
        if k % 3 == 0 or not spec.text:
            assert indexsearch.count_by_index(df, postings, spec, 8).first()["total"] == len(want)
            page = search.search(df, spec, limit=15, offset=4).collect()
            assert indexsearch.search_by_index(df, postings, spec, 15, 4, 8).collect() == page
    spec, cursor, seen = LogFilter(terms=["disk"], severity_max=5), None, []
    while True:
        page = indexsearch.search_after_by_index(df, postings, spec, cursor, 150, 8).collect()
        seen += [r["id"] for r in page]
        cursor = page[-1]["next_cursor"]
        if not cursor:
            break
    assert sorted(seen) == ids(filters.matching(df, spec)) and len(seen) > 200


def test_common_words_are_dealt_over_tasks(spark):
    """A task gets a bounded number of postings, however often a word comes."""
    postings = spark.range(4000).selectExpr("id AS log_id", "'message' AS field", "0 AS pos", "if(id % 10 = 0, 'w' || id, 'user') AS token")
    dealt = textindex.deal_postings(postings.union(postings.limit(0)), 16, rows=200).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in dealt.groupBy("task").count().collect()]
    assert sum(sizes) == 4000 and len(sizes) > 10 and max(sizes) <= 800
    assert dealt.filter("token = 'user'").select("token_bucket").distinct().count() == 1


def test_index_keeps_rows_without_a_day(spark, folder):
    df = logs(spark, log(1, message="user a"), log(2, message="user b")).withColumn("timestamp", F.when(F.col("id") == 1, F.col("timestamp")))
    textindex.write_postings(textindex.build_postings(df, by_day=True), f"{folder}/i")
    streaming.index_batch(df, 1, f"{folder}/j", by_day=True)
    for path in ("i", "j"):
        assert ids(textindex.lookup(spark.read.parquet(f"{folder}/{path}"), "user").withColumnRenamed("log_id", "id")) == [1, 2]


def test_one_rule_is_folded_in_many_tasks(spark):
    rnd, t, rows = random.Random(4), 0, []
    for i in range(1500):
        t += rnd.choice([0, 1, 1, 5, 29, 30, 31, 32, 400])
        rows.append(log(i, t))
    df = logs(spark, *rows)
    for window, cooldown in ((30, 0), (10, 30), (30, 31)):
        table = alert_rules(spark, alert_rule(1, threshold_count=3, window_seconds=window, cooldown_seconds=cooldown))
        listed = rules.ordered_rules(table)
        counts_ = alerts.per_second(rules.match_alert_rules(df, listed))
        cut = alerts.quiet_stretches(counts_, listed, 600)
        fold, want = alerts.Fold(3, window, cooldown), []
        for r in sorted(counts_.collect(), key=lambda r: r["sec"]):
            if fired := fold.add(r["sec"], r["n"]):
                want.append((r["sec"], fired[1], fired[2]))
        got = alerts.apply_cooldown(counts_, listed).filter("first_place IS NOT NULL")
        assert sorted((r["fire_sec"], r["first_place"], r["firings"]) for r in got.collect()) == want
        assert cut.select("stretch").distinct().count() > 100 and cut.count() == counts_.count()


def test_incident_index(spark, monkeypatch):
    rnd = random.Random(12)
    rows = [log(i, rnd.choice([rnd.uniform(0, 3000), 900, 900.5]), source_alias=rnd.choice(["web", "db", ""]), app_name=rnd.choice("ab"),
                message=rnd.choice(["ok", "password=secret" + "x" * 30, "```", "y" * rnd.randrange(700)])) for i in range(900)]
    df = logs(spark, *rows)
    spots = [(k, rnd.choice(["web", "db", "10.0.0.1", "gone", None]), at(rnd.choice([rnd.uniform(0, 3000), 900])), rnd.choice([0, None, 30, 400]), rnd.choice("ab")) for k in range(120)]
    inc = spark.createDataFrame(spots, "incident_id long, host string, triggered_at timestamp, window_seconds int, app_name string")
    for same_app in (False, True):
        index = context.incident_index(inc, df, same_app)
        assert index.rows.count() == index.rows.select("id").distinct().count()  # every row is in one interval
        want = {
            (k, r["id"]) for k, host, t, w, app in spots for r in rows
            if (r["source_alias"] or r["source_ip"]) == host and (not same_app or r["app_name"] == app)
            and t - dt.timedelta(seconds=max(w or 0, 60)) <= r["timestamp"] <= t + dt.timedelta(seconds=60)
        }
        got = context.incident_logs(inc, df, same_app)
        assert {(r["incident_id"], r["id"]) for r in got.collect()} == want and got.count() == len(want) > 2000
        for budget in (0, 300, 2000, None):
            by_rows = incidents.bundle_lines(got, max_chars=budget).collect()
            assert sorted(incidents.incident_bundles(index, max_chars=budget).collect()) == sorted(by_rows)
        assert all("secret" not in r["bundle"] for r in by_rows)
        aliases = spark.createDataFrame([("10.0.0.1", "web", " front "), ("10.0.0.9", "db", "back"), ("x", "", "none")], "ip string, alias string, notes string")
        for limit in (None, 1):
            heads = incidents.bundle_header(got, tz="Asia/Tokyo", aliases=aliases, max_names=limit).collect()
            assert sorted(incidents.incident_headers(index, "Asia/Tokyo", aliases, limit).collect(), key=str) == sorted(heads, key=str)
    assert {r["apps"] for r in incidents.bundle_header(context.incident_logs(inc, df), max_names=1).collect()} >= {"a, 1 more"}


def _crowded(spark):
    """1,500 rows of one host within ten minutes, and 600 incidents that hold most of them."""
    df = logs(spark, *[log(i, i * 0.4, message="m" * (i % 7)) for i in range(1500)])
    inc = spark.createDataFrame(
        [(k, "web", at(k), 560) for k in range(600)], "incident_id long, host string, triggered_at timestamp, window_seconds int"
    )
    return df, inc


def test_rows_of_incidents_are_not_moved(spark, monkeypatch):
    """Rows and incidents are shuffled, their pairs are not; blocks that many ask for are copied."""
    df, inc = _crowded(spark)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for runs in (context.BLOCK_RUNS, 50):
            monkeypatch.setattr(context, "BLOCK_RUNS", runs)
            got = context.incident_logs(inc, df).select("incident_id", "id")
            want = {(k, i) for k in range(600) for i in range(1500) if k - 560 <= i * 0.4 <= k + 60}
            assert rows_moved(got) < 100_000 < 400_000 < len(want)
            pairs = [(r["incident_id"], r["id"]) for r in got.collect()]
            assert set(pairs) == want and len(pairs) == len(want)
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_intervals_of_incidents_are_not_moved(spark):
    df, inc = _crowded(spark)
    index = context.incident_index(inc, df)
    held = index.rows.groupBy("place", "interval").agg(F.count("*").alias("n"))
    pairs, counts_ = index.pairs(held), index.pairs(held).groupBy("incident_id").agg(F.sum("n").alias("n"))
    assert rows_moved(counts_) < pairs.count() / 4
    want = {k: sum(k - 560 <= i * 0.4 <= k + 60 for i in range(1500)) for k in range(600)}
    assert {r["incident_id"]: r["n"] for r in counts_.collect()} == want
    assert index.pairs().columns == ["incident_id", "place", "interval"] and index.pairs().count() == pairs.count()


def test_headers_move_names_not_rows(spark):
    df, inc = _crowded(spark)
    index, logs_ = context.incident_index(inc, df), context.incident_logs(inc, df)
    heads = incidents.incident_headers(index)
    assert rows_moved(heads) < logs_.count() / 20
    assert sorted(heads.collect()) == sorted(incidents.bundle_header(logs_).collect())


def test_bundles_do_not_move_lines_of_incidents(spark):
    df, inc = _crowded(spark)
    index, rows = context.incident_index(inc, df), context.incident_logs(inc, df)
    for budget in (400, 20_000, 100_000):
        out = incidents.incident_bundles(index, max_chars=budget)
        assert rows_moved(out) < rows.count() / 20
        assert sorted(out.collect()) == sorted(incidents.bundle_lines(rows, max_chars=budget).collect())


def test_bundles_of_ids_that_come_twice(spark):
    """Incidents that share an id, on one host or on two, share a bundle and its budget."""
    df = logs(spark, *[log(i, i * 3, source_alias="web" if i % 3 else "db") for i in range(200)])
    spots = [(7, "web", 300), (7, "web", 300), (8, "web", 300), (8, "db", 250), (9, "db", 200), (None, "web", 100), (None, "web", 400), (None, "db", 90)]
    inc = spark.createDataFrame([(k, h, at(s), 120) for k, h, s in spots], "incident_id long, host string, triggered_at timestamp, window_seconds int")
    index, rows = context.incident_index(inc, df), context.incident_logs(inc, df)
    for budget in (200, 3000, 100_000):
        got = incidents.incident_bundles(index, max_chars=budget).collect()
        assert sorted(got, key=str) == sorted(incidents.bundle_lines(rows, max_chars=budget).collect(), key=str) and len(got) == 4


def test_newest_rows_of_incidents(spark):
    """Rows that the budget cannot come to stay out before they meet their incidents, and the cut is the same."""
    df, inc = _crowded(spark)
    lines = df.withColumn("line", F.concat("message", F.lit("x" * 30)))
    pick = ["incident_id", "timestamp", "id", "line"]
    every, near = (context.incident_logs(inc, lines, newest=n).select(*pick) for n in (None, ("line", 400)))
    cut = lambda rows: incidents.newest_within_budget(rows, ["incident_id"], ["timestamp", "id"], max_chars=400)
    assert near.count() < every.count() / 20 and rows_moved(cut(near)) < every.count() / 10
    assert sorted(cut(near).collect()) == sorted(cut(every).collect())


def test_budget_that_ends_with_a_line(spark):
    """A group is cut if older lines are left, also where the newest ones take exactly the budget."""
    for older in (0, 1):
        df = spark.createDataFrame([("k", at(i), i, "x" * 99) for i in range(1 - older, 5)], "g string, timestamp timestamp, id long, line string")
        got = incidents.newest_within_budget(df, ["g"], ["timestamp", "id"], max_chars=399)
        assert {r["truncated"] for r in got.collect()} == {bool(older)}


def test_latest_in_order(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("aab"), rnd.randrange(40) if rnd.random() < 0.9 else 7, k, rnd.choice([None, None, k])) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, t int, k long, v long")
    want, last = {}, {}
    for g, _, k, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        last[g] = v if v is not None else last.get(g)
        want[k] = last[g]
    assert {r["k"]: r["x"] for r in ordered.latest_in_order(df, ["g"], ["t", "k"], "v", "x").collect()} == want


def test_store_append_and_rewrite(spark, folder):
    path = f"{folder}/logs"
    rows = logs(spark, *[log(i, i * 30_000, severity=i % 8) for i in range(20)])
    fresh = rows.withColumn("seq", F.col("id")).drop("id")
    stored.append_logs(fresh.filter("seq < 12"), path)
    stored.append_logs(fresh.filter("seq >= 12"), path)
    table = stored.read_logs(spark, path)
    assert ids(table) == list(range(1, 21)) and "log_date" in table.columns
    by_id = [r["timestamp"] for r in table.orderBy("id").collect()]
    assert by_id == sorted(by_id)
    sample = stored.sample_storage(spark, path, T0).first()
    assert sample["total_logs_count"] == 20 and sample["db_size_bytes"] > 0
    days = Counter(r["log_date"] for r in table.collect())
    first = min(days)
    cond = (F.col("log_date") == F.lit(first)) | (F.col("id") == 20)

    def rewrite(c, **bounds):
        return retention.rewrite_days(spark, path, lambda df: df.filter(c), lambda df: df.filter(~c), **bounds)

    assert rewrite(cond, last=first - dt.timedelta(days=1)) == {"touched": 0, "days_rewritten": 0, "days_removed": 0}
    done = rewrite(cond)
    assert done == {"touched": days[first] + 1, "days_rewritten": 0, "days_removed": 2}
    done2 = rewrite(F.col("id") == 5)
    assert done2 == {"touched": 1, "days_rewritten": 1, "days_removed": 0}
    left = stored.read_logs(spark, path)
    assert left.count() == 19 - done["touched"] and not {5, 20} & set(ids(left))
    pruned = retention.prune_logs(left, 1, at(20 * 30_000))
    assert "PartitionFilters: [isnotnull(log_date" in pruned._jdf.queryExecution().toString()


def test_both_writers_share_a_table(spark, folder):
    path = f"{folder}/logs"
    rows = logs(spark, *[log(i, i * 9000, severity=i % 8, source_alias=f"h{i % 3}") for i in range(40)])
    stored.append_logs(rows.filter("id < 15"), path)
    streaming.append_batch(rows.filter("id BETWEEN 15 AND 29"), 0, path)
    streaming.append_batch(rows.filter("id BETWEEN 15 AND 29"), 0, path)
    stored.append_logs(rows.filter("id >= 30"), path)
    assert ids(stored.read_logs(spark, path)) == list(range(40))
    spec = filters.LogFilter(severity_max=2, start=at(50_000), as_of=T0)
    gone = {r["id"] for r in filters.matching(rows, spec).collect()}
    assert retention.delete_stored(spark, path, spec)["touched"] == len(gone) > 5
    assert ids(stored.read_logs(spark, path)) == [i for i in range(40) if i not in gone]
    renamed = retention.backfill_stored(spark, path, "source_alias", lambda df: df.withColumn(
        "source_alias", F.when(F.col("source_alias") == "h1", "new").otherwise(F.col("source_alias"))))
    assert renamed["touched"] == sum(i % 3 == 1 for i in range(40) if i not in gone)
    streaming.append_batch(rows.filter("id < 3").withColumn("id", F.col("id") + 100), 1, path)
    last = max(r["log_date"] for r in stored.read_logs(spark, path).collect())
    assert retention.compact_days(spark, path, last) == 2  # where two writers met, and the day that was added to
    assert len(ids(stored.read_logs(spark, path))) == 43 - len(gone)
    assert retention.prune_stored(spark, path, 1, at(40 * 9000))["days_removed"] >= 2
    kept = retention.prune_logs(rows.filter(~F.col("id").isin(*gone)), 1, at(40 * 9000))
    assert ids(stored.read_logs(spark, path)) == ids(kept)


def test_rows_added_while_rows_are_counted_stay(spark, folder):
    path = f"{folder}/logs"
    rows = logs(spark, *[log(i, i) for i in range(10)])
    stored.append_logs(rows.filter("id < 8"), path)

    def touched(df):
        stored.append_logs(rows.filter("id >= 8"), path)
        return df.filter("id = 3")

    retention.rewrite_days(spark, path, touched, lambda df: df.filter("id <> 3"))
    assert ids(stored.read_logs(spark, path)) == [i for i in range(10) if i != 3]


def test_repeated_batch_stops_a_change(spark, folder):
    path = f"{folder}/logs"
    rows = logs(spark, *[log(i, i) for i in range(10)])
    streaming.append_batch(rows.filter("id < 8"), 0, path)

    def change(df):
        streaming.append_batch(rows, 0, path)
        return df.filter("id <> 3").limit(0)

    with pytest.raises(RuntimeError, match="added"):
        retention.rewrite_days(spark, path, lambda df: df.filter("id = 3"), change)
    assert ids(stored.read_logs(spark, path)) == list(range(10))


def test_rows_added_before_the_swap_stay(spark, folder, monkeypatch):
    path = f"{folder}/logs"
    rows = logs(spark, *[log(i, i) for i in range(10)])
    stored.append_logs(rows.filter("id < 8"), path)
    swap = Folder.swap_out

    def late(self, *args):
        rows.filter("id >= 8").withColumn("log_date", F.to_date("timestamp")).transform(lambda df: stored.write_days(df, path, 7) or df)
        return swap(self, *args)

    monkeypatch.setattr(Folder, "swap_out", late)
    retention.rewrite_days(spark, path, lambda df: df.filter("id = 3"), lambda df: df.filter("id <> 3"))
    assert {i for i in range(10) if i != 3} == set(ids(stored.read_logs(spark, path)))


def test_rows_added_while_others_change_stay(spark, folder):
    path = f"{folder}/logs"
    rows = logs(spark, *[log(i, i) for i in range(10)])
    stored.append_logs(rows.filter("id < 8"), path)

    def change(df):
        stored.append_logs(rows.filter("id >= 8"), path)
        return df.filter("id <> 3")

    retention.rewrite_days(spark, path, lambda df: df.filter("id = 3"), change)
    assert ids(stored.read_logs(spark, path)) == [i for i in range(10) if i != 3]


@pytest.mark.parametrize("parts", [1, 1000])
def test_repeated_batches_after_changes(spark, folder, monkeypatch, parts):
    monkeypatch.setattr(retention, "PAIRS", parts)
    path = f"{folder}/logs"
    rows = logs(spark, *[log(i, i * 9000, severity=i % 8, app_name=f"a{i % 3}") for i in range(40)])
    batches = [rows.filter(F.col("id") % 2 == k) for k in (0, 1)]

    def repeat():
        before = sorted(map(tuple, stored.read_logs(spark, path).collect()))
        for k, batch in enumerate(batches):
            streaming.append_batch(batch, k, path)
        assert sorted(map(tuple, stored.read_logs(spark, path).collect())) == before

    for k, batch in enumerate(batches):
        streaming.append_batch(batch, k, path)
    repeat()
    retention.delete_stored(spark, path, filters.LogFilter(apps=["a1"], as_of=T0))
    repeat()
    retention.delete_stored_ids(spark, path, rows.filter("id IN (2, 3)").select("id"))
    repeat()
    retention.backfill_stored(spark, path, "app_name", lambda df: df.withColumn("app_name", F.lit("b")))
    repeat()
    assert retention.compact_days(spark, path, at(100_000).date()) >= 1
    repeat()
    retention.delete_stored(spark, path, filters.LogFilter(severity_max=0, as_of=T0))
    repeat()
    retention.prune_stored(spark, path, 1, at(40 * 9000))
    repeat()
    left = {r["id"]: r["app_name"] for r in stored.read_logs(spark, path).collect()}
    want = [i for i in range(40) if i % 3 != 1 and i not in (2, 3) and i % 8 and i * 9000 >= 40 * 9000 - 86400]
    assert left == dict.fromkeys(want, "b")
    # a batch with a day that it never had is stored
    streaming.append_batch(logs(spark, log(99, 90 * 86_400)), 1, path)
    assert 99 in ids(stored.read_logs(spark, path))
    # marks of completed batches can go
    Folder(spark, path).forget(1)
    assert not Folder(spark, path).settled(0) and Folder(spark, path).settled(1)


@pytest.mark.parametrize("step", ["commit", "settle", "swap_out", "swap_in", "drop_empty"])
@pytest.mark.parametrize("after", [0, 1])
def test_stopped_change_is_completed(spark, folder, monkeypatch, step, after):
    path = f"{folder}/logs"
    rows = logs(spark, *[log(i, i * 30_000) for i in range(12)])
    streaming.append_batch(rows.filter("id < 9"), 0, path)
    streaming.append_batch(rows.filter("id >= 6 AND id < 9").withColumn("id", F.col("id") + 100), 1, path)
    real, calls = getattr(Folder, step), []

    def stops(self, *args):
        if len(calls) == after:
            raise KeyboardInterrupt
        calls.append(args)
        done = real(self, *args)
        if step == "commit":
            raise KeyboardInterrupt
        return done

    monkeypatch.setattr(Folder, step, stops)
    with pytest.raises(KeyboardInterrupt):
        retention.rewrite_days(spark, path, lambda df: df.filter("id % 5 <> 0"), lambda df: df.filter("id % 5 = 0"))
    monkeypatch.setattr(Folder, step, real)
    stored.append_logs(rows.filter("id >= 9"), path)  # the next writer
    made = step != "commit" or after
    first = [i for i in [*range(9), 106, 107, 108] if i % 5 == 0 or not made]
    assert ids(stored.read_logs(spark, path)) == sorted([*first, 9, 10, 11])
    assert not Folder(spark, path).changes() and not [n for n in Folder(spark, path)._names() if n.startswith("_old-")]


def test_sessions_mean_the_same_however_many(spark):
    rows = [log(i % 4, i * 10, severity=i % 6, app_name=["kernel", " Kernel ", "cron", ""][i % 4], source_alias=["a", "b1", "", "b2"][i % 4]) for i in range(60)]
    df = logs(spark, *rows).withColumn("extra", F.lit(1))
    sessions = spark.createDataFrame(
        [("m1", "drop_errors", "\tker*\n", None, at(0), at(300), None), ("m2", "drop_errors", "", " b? ", at(100), at(500), at(400)),
         ("m3", "silence_alerts", None, None, at(0), at(900), None), ("m4", "drop_errors", None, "a", at(-200_000), at(200), None)],
        "session_id string, log_handling string, target_app string, target_host string, created_at timestamp, expires_at timestamp, ended_at timestamp",
    )
    for frame in (df, df.drop("id")):
        got = [sorted(map(str, maintenance.maintenance_drops(frame, sessions, compiled=n).collect())) for n in (200, 0)]
        assert got[0] == got[1] and len(got[0]) == 60
    assert any("m1" in r for r in got[0]) and any("m2" in r for r in got[0])


def test_compiled_sessions_keep_the_plan_small(spark):
    """A condition per session made plans of hundreds of MB on the driver."""
    sessions = spark.range(2000).selectExpr(
        "'m' || id AS session_id", "'drop_errors' AS log_handling", "'ker*' AS target_app", "CAST(NULL AS string) AS target_host",
        "timestamp_seconds(id) AS created_at", "timestamp_seconds(id + 9) AS expires_at", "CAST(NULL AS timestamp) AS ended_at",
    )
    df = logs(spark, log(1, severity=1, app_name="kernel"))
    out = maintenance.maintenance_drops(df, sessions, compiled=10_000)
    plan = out._jdf.queryExecution().optimizedPlan()
    assert "from_json" not in plan.toString().lower()  # one constant, not parsed again for every row
    assert out._jdf.queryExecution().analyzed().toString().lower().count("ker.*") <= 2000 and plan.toString().count("CASE WHEN") <= 2


def test_file_sizes_alone_broadcast_nothing(spark):
    """Packed files are far smaller than their rows on the driver."""
    from logloom.session import bound_broadcasts, join_dimension, stage

    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    own.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    big = stage(own.range(300_000).selectExpr("id", "'host' AS host", "id div 9 AS n"), "broadcast-test")
    assert own.conf.get("spark.sql.autoBroadcastJoinThreshold") == str(256 << 10)
    assert own.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "-1"  # lower limits stay
    for joined in (big.join(big.withColumnRenamed("n", "m"), ["id", "host"]), join_dimension(big, big.select("id"), ["id"], "left_semi")):
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    assert bound_broadcasts(own).conf.get("spark.sql.autoBroadcastJoinThreshold") == "100k"


def test_many_sessions_are_not_broadcast(spark, monkeypatch):
    """Sessions too many for a broadcast join by sorting, even where Spark takes their files for small."""
    from logloom import session

    monkeypatch.setattr(session.is_small, "__defaults__", (session.BROADCAST_MAX_ROWS, 0))
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    own.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
    sessions = own.range(2000).selectExpr(
        "concat('m', id) AS session_id", "'drop_errors' AS log_handling", "'ker*' AS target_app", "'' AS target_host",
        "timestamp_seconds(1704067200 + id) AS created_at", "timestamp_seconds(1704067200 + id + 18000) AS expires_at",
        "CAST(null AS timestamp) AS ended_at",
    )
    rows = own.range(50).selectExpr(
        "id", "timestamp_seconds(1704067200 + id * 60) AS timestamp", "CAST(id % 8 AS int) AS severity", "'kernel' AS app_name",
        "'' AS source_alias", "'' AS source_ip",
    )
    out = maintenance.maintenance_drops(rows, sessions)
    found = {r["id"]: r["session_id"] for r in out.collect()}
    assert found == {k: f"m{min(k * 60, 1999)}" if k % 8 <= 3 else None for k in range(50)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_salvage(spark):
    df = logs(spark, log(1), log(2)).withColumns({
        "received_at": F.when(F.col("id") == 1, F.col("received_at")),
        "message": F.unhex(F.lit("61ff62")).cast("string"),
        "severity": F.lit(None).cast("int"),
    })
    good, bad = stored.salvage_rows(df)
    assert ids(bad) == [2] and good.first()["severity"] == 6 and good.first()["message"].startswith("a")


def test_write_incidents(spark, folder):
    table = alert_rules(spark, alert_rule(1, threshold_count=2))
    fired = alerts.fire_alerts(logs(spark, log(1, message="z" * 2000), log(2, 1, message="z" * 2000)), table)
    stored.write_incidents(fired, f"{folder}/i")
    row = spark.read.parquet(f"{folder}/i").first()
    assert len(row["sample_log"]) == 1000 and row["trigger_count"] == 2


def test_index_on_disk(spark, folder):
    df = logs(spark, *[log(i, message=f"word{i % 7} two parts", app_name="nginx") for i in range(50)])
    textindex.write_postings(textindex.build_postings(df), f"{folder}/idx", buckets=8)
    p = spark.read.parquet(f"{folder}/idx")
    hits = textindex.lookup(p, "word3", prefix=False, buckets=8)
    assert sorted(r[0] for r in hits.collect()) == list(range(3, 50, 7))
    assert textindex.lookup_phrase(p, "word3 two", field="message", buckets=8).count() == 7
    assert textindex.lookup_phrase(p, "two word3", buckets=8).count() == 0
    found = lambda term, **k: sorted(r[0] for r in textindex.lookup(p, term, buckets=8, **k).collect())
    assert found("word3 two") == list(range(3, 50, 7)) and found("?!") == []
    assert found("wo") == [] and found("wo*") == list(range(50)) and found("word3", field="app_name") == []
    assert "PartitionFilters: [isnotnull(token_bucket" in hits._jdf.queryExecution().toString()


def test_large_dimension_is_not_broadcast(spark):
    from logloom.session import join_dimension

    facts = logs(spark, *[log(i, source_ip="hot" if i % 3 else f"h{i}") for i in range(90)])
    dim = spark.createDataFrame([("hot", 1), ("h3", 2)], "source_ip string, v int")
    small = join_dimension(facts, dim, ["source_ip"])
    large = join_dimension(facts, dim, ["source_ip"], max_rows=1)
    assert sorted(map(str, small.select("id", "v").collect())) == sorted(map(str, large.select("id", "v").collect()))
    semi = join_dimension(facts, dim, ["source_ip"], "left_semi", max_rows=1)
    anti = join_dimension(facts, dim, ["source_ip"], "left_anti", max_rows=1)
    assert semi.count() + anti.count() == 90 and anti.count() == 29


def test_schema_check(spark):
    from logloom.schema import LOG_DEFAULTS, conform

    df = logs(spark, log(1)).drop("facility")
    assert conform(df, LOGS, LOG_DEFAULTS).first()["facility"] == 1
    with pytest.raises(ValueError, match="raw"):
        conform(df.drop("raw"), LOGS, LOG_DEFAULTS)
