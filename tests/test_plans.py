"""Plans: what reaches the files, and where rows move."""

import datetime as dt
import re

import pytest
from helpers import alert_rule, alert_rules, drop_rule, drop_rules, log, logs
from pyspark.sql import functions as F

from logloom.operators import alerts, context, counts, facets, indexsearch, maintenance, rules, search, textindex, textquery
from logloom.operators.filters import LogFilter
from logloom.sources import logs as stored
from logloom.sources.syslog import parse_syslog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range|Single|RoundRobin)", plan(df)))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "logs")
    stored.append_logs(logs(spark, *[log(i, i * 5000, severity=i % 8) for i in range(60)]), path)
    return path


def test_search_prunes_days_columns_and_rows(spark, table):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    spec = LogFilter(severity_max=3, apps=["nginx"], start="7d", log_date=True, as_of=dt.datetime(2026, 3, 14))
    page = search.search(stored.read_logs(spark, table, include_raw=False), spec).select("id", "timestamp", "message")
    text = page._jdf.queryExecution().toString()
    assert "LessThanOrEqual(severity,3)" in text and "EqualTo(app_name,nginx)" in text
    assert re.search(r"PartitionFilters: \[[^\]]*log_date", text)
    read = re.findall(r"ReadSchema: (\S+)", text)[-1]
    assert "raw" not in read and "source_ip" not in read
    assert "TakeOrderedAndProject" in text and shuffles(page) == 0


def test_next_page_pushes_the_cursor(spark, table):
    cursor = search.encode_cursor(1_773_200_000_000_000, 7)
    page = search.search_after(stored.read_logs(spark, table), LogFilter(), cursor)
    assert "LessThanOrEqual(timestamp" in page._jdf.queryExecution().toString()


def test_rules_do_not_move_rows(spark):
    df = logs(spark, log(1))
    assert shuffles(rules.apply_drop_rules(df, drop_rules(spark, drop_rule(1, app_pattern="a*")))) == 0
    assert shuffles(rules.match_alert_rules(df, alert_rules(spark, alert_rule(1)))) == 0
    lines = df.selectExpr("raw AS value", "source_ip", "received_at")
    assert shuffles(parse_syslog(lines)) == 0


def test_groups_shuffle_once_after_partial_counts(spark):
    df = logs(spark, log(1))
    for out in (counts.count_by_app(df), counts.count_by_source(df), counts.count_by_severity(df).groupBy().count()):
        assert "partial_count" in plan(out)
    assert len(re.findall("Exchange hash", plan(counts.count_by_app(df)))) == 1
    assert "WindowGroupLimit" in plan(facets.host_to_apps(facets.host_app_pairs(df, spark.createDataFrame([], "ip string, alias string, notes string"))))
    assert "WindowGroupLimit" in plan(alerts.newest_matches(rules.match_alert_rules(df, alert_rules(spark, alert_rule(1)))))


def test_no_nested_loops(spark):
    df = logs(spark, log(1))
    targets = df.select("id")
    sessions = spark.createDataFrame(
        [], "session_id string, log_handling string, target_app string, target_host string, created_at timestamp,"
        " expires_at timestamp, ended_at timestamp")
    incidents = df.selectExpr("id AS incident_id", "source_alias AS host", "timestamp AS triggered_at", "60 AS window_seconds")
    windows = df.selectExpr("timestamp AS window_start", "received_at AS window_end")
    for out in (
        context.log_context(df, targets, 5), context.incident_logs(incidents, df),
        maintenance.maintenance_drops(df, sessions, compiled=-1),
        maintenance.silence_incidents(incidents, windows),
    ):
        assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)


def test_index_reads_the_buckets_of_its_words(spark, folder):
    df = logs(spark, *[log(i, i * 20_000, message=f"word{i} other") for i in range(30)]).withColumn("log_date", F.to_date("timestamp"))
    textindex.write_postings(textindex.build_postings(df, by_day=True), f"{folder}/index", buckets=32)
    postings = spark.read.parquet(f"{folder}/index")
    query = textquery.AllOf(textquery.Term("word7"), textquery.NoneOf(textquery.Phrase("some other")))
    text = plan(indexsearch.rows_by_words(postings, query, 32))
    wanted = {r[0] for r in postings.filter("left(token, 3) IN ('wor', 'som', 'oth')").select("token_bucket").distinct().collect()}
    read = re.search(r"PartitionFilters: \[.*?token_bucket#\d+ IN \(([0-9,]+)\)", text)
    assert read and wanted <= set(map(int, read[1].split(","))) and len(read[1].split(",")) <= 3
    assert len(re.findall("Exchange hash", text)) == 1


def test_streams_use_all_cores(spark):
    from logloom.plans import stored_queries
    from logloom.plans.tables import Tables

    before = spark.conf.get("spark.sql.shuffle.partitions")
    with stored_queries._stream_settings(Tables(spark, "/root/testdata/sf0.001")):
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) >= spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
