"""Alert rules over stored logs: sliding windows, cooldown, culprits and incidents.

Windows and cooldowns work on whole seconds: a match at second s counts for a window of w
seconds that ends in [s, s + w]. The logs are reduced to one count per rule and second before
anything runs in order, so a log storm costs no more than a quiet day after that point.
"""

from __future__ import annotations

import datetime as dt
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..functions import fixed, redact
from ..functions.common import blank_to_null
from ..functions.text import message_key
from ..session import join_dimension, stage
from .counts import host_group
from .ordered import CHUNK, running
from .rules import match_alert_rules, ordered_rules

SEC = F.unix_seconds


def needed_matches(rule) -> int:
    """Matches inside the window that fire a rule."""
    count = max(1, rule["threshold_count"] or 1)
    window = max(1, rule["window_seconds"] or 1)
    return count * window if rule["rule_type"] == "rate" else count


def rule_settings(rules: list[Row]) -> dict[int, tuple[int, int, int]]:
    """id -> (needed matches, window seconds, cooldown seconds)."""
    return {
        r["id"]: (
            needed_matches(r),
            max(1, r["window_seconds"] or 1),
            max(0, r["cooldown_seconds"] or 0),
        )
        for r in rules
    }


def with_second(matches: DataFrame, ts: str = "timestamp") -> DataFrame:
    return matches.withColumn("sec", SEC(F.col(ts)))


def per_second(matches: DataFrame) -> DataFrame:
    """Matches per rule and second: the parallel part of every window operator."""
    return (
        with_second(matches)
        .groupBy("rule_id", "sec")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _settings_map(values: dict[int, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def window_counts(counts: DataFrame, rules: list[Row], chunk_seconds: int = 86_400) -> DataFrame:
    """Per rule and second: the matches within the rule's window up to that second.

    Matches enter the window in their second and leave it ``window + 1`` seconds later, so the
    count is a running sum of entries and departures: linear in the seconds whatever the window,
    and cut into chunks of time, so a busy rule spreads over many tasks.
    """
    widths = {k: v[1] for k, v in rule_settings(rules).items()}
    if not widths:
        return counts.withColumn("window_count", F.col("n")).limit(0)
    width = F.try_element_at(_settings_map(widths), F.col("rule_id")).cast("long")
    moves = F.array(
        F.struct(F.col("sec").alias("at"), F.col("n").alias("change"), F.col("n").alias("n")),
        F.struct(
            (F.col("sec") + width + 1).alias("at"), (-F.col("n")).alias("change"),
            F.lit(None).cast("long").alias("n"),
        ),
    )
    steps = (
        counts.filter(F.col("rule_id").isin(*widths))
        .select("rule_id", F.inline(moves))
        .groupBy("rule_id", "at")
        .agg(F.sum("change").alias("change"), F.sum("n").alias("n"))
        .withColumn(CHUNK, F.floor(F.col("at") / chunk_seconds))
    )
    summed = running(
        steps, ["rule_id"], ["at"], {"window_count": ("sum", F.col("change"))}, ts="at"
    )
    return summed.filter("n IS NOT NULL").select(
        "rule_id", F.col("at").alias("sec"), "n", "window_count"
    )


def crossing_seconds(matches: DataFrame, rules: list[Row]) -> DataFrame:
    """Seconds in which a rule's window holds enough matches (cooldown not considered)."""
    needed = _settings_map({k: v[0] for k, v in rule_settings(rules).items()})
    counted = window_counts(per_second(matches), rules)
    return counted.withColumn("needed", F.try_element_at(needed, F.col("rule_id"))).filter(
        F.col("window_count") >= F.col("needed")
    )


def _of_type(rules: list[Row], rate: bool) -> list[Row]:
    return [r for r in rules if (r["rule_type"] == "rate") == rate]


def threshold_crossings(matches: DataFrame, rules: list[Row]) -> DataFrame:
    """Matches at which a pattern or threshold rule's window reaches its count."""
    chosen = _of_type(rules, rate=False)
    if not chosen:
        return with_second(matches).withColumn("window_count", F.lit(0).cast("long")).limit(0)
    seconds = crossing_seconds(matches, chosen).select("rule_id", "sec", "window_count")
    rows = with_second(matches).filter(F.col("rule_id").isin(*[r["id"] for r in chosen]))
    return rows.join(seconds, ["rule_id", "sec"])


def rate_crossings(matches: DataFrame, rules: list[Row]) -> DataFrame:
    """Seconds in which a rate rule's window reaches its rate."""
    chosen = _of_type(rules, rate=True)
    return crossing_seconds(matches, chosen).select("rule_id", "sec", "n", "window_count")


class Fold:
    """One rule's window and cooldown, fed with its matches per second in order."""

    def __init__(self, needed: int, window: int, cooldown: int):
        self.needed, self.window, self.cooldown = needed, window, cooldown
        # (second, matches held, matches of that second used up before)
        self.held: deque[tuple[int, int, int]] = deque()
        self.total = 0
        self.quiet_until: int | None = None

    def add(self, sec: int, n: int) -> tuple[list[tuple[int, int, int]], int, int] | None:
        """When the second fires: the earlier seconds of the window with the places used up in
        them and all their matches, the place of the first firing match, and the number of firings."""
        while self.held and self.held[0][0] < sec - self.window:
            self.total -= self.held.popleft()[1]
        quiet = self.quiet_until is not None and sec < self.quiet_until
        if quiet or self.total + n < self.needed:
            self.held.append((sec, n, 0))
            self.total += n
            return None
        members = [(s, used, left + used) for s, left, used in self.held]
        first = max(1, self.needed - self.total)
        more = (n - first) // self.needed if self.cooldown == 0 else 0
        used = first + more * self.needed
        self.held.clear()
        self.total = n - used
        if self.total:
            self.held.append((sec, self.total, used))
        self.quiet_until = sec + self.cooldown
        return members, first, 1 + more


SEGMENTS = (
    "rule_id long, sec long, fire_sec long, used_places long, first_place long, step long,"
    " firings long, matches long"
)
_SEGMENT_NAMES = [f.split()[0] for f in SEGMENTS.split(", ")]


def quiet_stretches(counts: DataFrame, rules: list[Row], chunk_seconds: int = 86_400) -> DataFrame:
    """The counts with ``stretch``: the second at which the rule's state was last surely empty.

    After a pause longer than the window no match is held, and after one as long as the cooldown the
    rule is not quiet, whatever fired before. So what follows such a pause does not depend on what was
    before it. The previous second is carried over chunks of time, one small row each.
    """
    pause = _settings_map({k: max(v[1] + 1, v[2]) for k, v in rule_settings(rules).items()})
    cut = counts.withColumn(CHUNK, F.floor(F.col("sec") / chunk_seconds))
    before = running(cut, ["rule_id"], ["sec"], {"_before": ("last", F.col("sec"))}, ts="sec", inclusive=False)
    alone = F.col("_before").isNull() | (F.col("sec") - F.col("_before") >= F.try_element_at(pause, F.col("rule_id")))
    starts = running(before, ["rule_id"], ["sec"], {"stretch": ("last", F.when(alone, F.col("sec")))}, ts="sec")
    return starts.select("rule_id", "stretch", "sec", "n")


def apply_cooldown(counts: DataFrame, rules: list[Row]) -> DataFrame:
    """When rules fire and which seconds each firing holds, from the matches per rule and second.

    After a firing the window is empty and the rule is quiet for its cooldown. What a firing
    changes decides the next one, so seconds are folded in time order; but only within a stretch
    between pauses that empty the state (``quiet_stretches``), so a rule spreads over as many tasks
    as it has stretches. A stretch passes through its task as a stream of at most one row per second, with
    one window held at a time; a rule that never pauses is one stretch.

    Rows with ``first_place`` are firing seconds: match ``first_place`` of the second fires, then
    every ``step``-th, ``firings`` in all (more than one only without a cooldown). The other rows
    are earlier seconds of the window, without their first ``used_places`` matches. ``matches`` is the
    number of matches in the second.
    """
    settings = rule_settings(rules)
    if not settings:
        return counts.sparkSession.createDataFrame([], SEGMENTS)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out = []
            for rule_id, stretch, sec, n in zip(batch["rule_id"], batch["stretch"], batch["sec"], batch["n"]):
                if (rule_id, stretch) != current:
                    current, state = (rule_id, stretch), Fold(*settings[rule_id])
                fired = state.add(sec, n)
                if fired:
                    members, first, firings_here = fired
                    out += [(rule_id, s, sec, used, None, None, None, total) for s, used, total in members]
                    out.append((rule_id, sec, sec, 0, first, state.needed, firings_here, n))
            yield pd.DataFrame(out, columns=_SEGMENT_NAMES).astype("Int64")

    known = counts.select("rule_id", "sec", "n").filter(F.col("rule_id").isin(*settings))
    return (
        quiet_stretches(known, rules).repartition("rule_id", "stretch")
        .sortWithinPartitions("rule_id", "stretch", "sec")
        .mapInPandas(fold, SEGMENTS)
    )


def firings(segments: DataFrame) -> DataFrame:
    """One row per firing: its second, its number in the second, and the firing match's place."""
    k = F.explode(F.sequence(F.lit(0), F.col("firings") - 1)).alias("k")
    return (
        segments.filter("first_place IS NOT NULL")
        .select("rule_id", F.col("fire_sec"), "first_place", "step", k)
        .select(
            "rule_id", "fire_sec", "k", (F.col("first_place") + F.col("k") * F.col("step")).alias("place")
        )
    )


def firing_sizes(segments: DataFrame) -> DataFrame:
    """``rule_id, fire_sec, k, counted``: the matches behind each firing, as they were counted."""
    own = F.when(F.col("first_place").isNull(), F.col("matches") - F.col("used_places")).otherwise(F.col("first_place"))
    whole = segments.groupBy("rule_id", "fire_sec").agg(
        F.sum(own).alias("_first"), F.max("step").alias("step"), F.max("firings").alias("firings")
    )
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("firings") - 1)).alias("k")
    return whole.filter("firings IS NOT NULL").select("rule_id", "fire_sec", "_first", "step", k).select(
        "rule_id", "fire_sec", "k", F.when(F.col("k") == 0, F.col("_first")).otherwise(F.col("step")).alias("counted")
    )


def placed_matches(matches: DataFrame, seconds: DataFrame) -> DataFrame:
    """The matches of the given (rule, second) pairs with their place in the second.

    The order is (timestamp, id). A second is cut by microsecond and range of ids, the cuts are
    numbered in parallel and offset by the sizes of the cuts before them.
    """
    wanted = seconds.select("rule_id", "sec").distinct()
    chosen = join_dimension(with_second(matches), wanted, ["rule_id", "sec"], "left_semi")
    keys = ["rule_id", "sec", "_us", "_block"]
    cut = chosen.withColumns(
        {"_us": F.unix_micros("timestamp"), "_block": F.floor(F.col("id") / 100_000)}
    )
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = (
        Window.partitionBy("rule_id", "sec")
        .orderBy("_us", "_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = Window.partitionBy(*keys).orderBy("id")
    return (
        cut.withColumn("_rn", F.row_number().over(local))
        .join(starts, keys)
        .withColumn("place", (F.col("_start") + F.col("_rn")).cast("long"))
        .drop("_us", "_block", "_start", "_rn")
    )


def firing_matches(matches: DataFrame, segments: DataFrame) -> DataFrame:
    """Every match that a firing's window held, with the firing (``fire_sec``, ``k``).

    A match belongs to at most one firing. Only firing seconds need the order inside them; all
    other seconds belong to their firing as a whole. A second of a storm may hold many matches, so
    the joins do not hash on it alone; ``segments`` are best written before, as they are counted.
    """
    fire_rows = segments.filter("first_place IS NOT NULL")
    whole = segments.filter("first_place IS NULL AND used_places = 0").select(
        "rule_id", "sec", "fire_sec"
    )
    entire = join_dimension(with_second(matches), whole, ["rule_id", "sec"], "inner").withColumns(
        {"k": F.lit(0).cast("long"), "place": F.lit(None).cast("long")}
    )
    placed = placed_matches(matches, fire_rows)
    last = F.col("first_place") + (F.col("firings") - 1) * F.col("step")
    number = F.when(F.col("place") <= F.col("first_place"), F.lit(0)).otherwise(
        F.ceil((F.col("place") - F.col("first_place")) / F.col("step"))
    )
    fired = (
        join_dimension(placed, fire_rows.drop("used_places", "matches"), ["rule_id", "sec"], "inner")
        .filter(F.col("place") <= last)
        .withColumn("k", number.cast("long"))
        .drop("first_place", "step", "firings")
    )
    rest = segments.filter("first_place IS NULL AND used_places > 0").select(
        "rule_id", "sec", "fire_sec", "used_places"
    )
    leftover = (
        join_dimension(placed, rest, ["rule_id", "sec"], "inner")
        .filter(F.col("place") > F.col("used_places"))
        .withColumn("k", F.lit(0).cast("long"))
        .drop("used_places")
    )
    # Places in earlier seconds of the window do not matter to the firing
    leftover = leftover.withColumn("place", F.lit(None).cast("long"))
    return entire.unionByName(fired).unionByName(leftover)


def culprit_dimensions(key_chars: int | None = fixed.MESSAGE_KEY_CHARS) -> Column:
    """App, host and message key of a row; ``key_chars`` cuts the key (None: the whole message)."""
    app = F.coalesce(blank_to_null(F.col("app_name")), F.lit("unknown"))
    return F.array(
        F.struct(F.lit("app").alias("kind"), app.alias("name")),
        F.struct(F.lit("host").alias("kind"), host_group().alias("name")),
        F.struct(F.lit("message").alias("kind"), message_key("message", "raw", key_chars).alias("name")),
    )


def percent_of(part: Column, whole: Column) -> Column:
    """Rounded percentage; halves go to the even number."""
    return F.bround(part / whole * 100, 0).cast("long")


def culprits(
    held: DataFrame, keys: list[str] = ("rule_id", "fire_sec", "k"), key_chars: int | None = fixed.MESSAGE_KEY_CHARS
) -> DataFrame:
    """Per group: the most frequent app, host and message start with count and percentage.

    Counts are exact; equal counts go to the first name in order.
    """
    keys = list(keys)
    counted = (
        held.select(*keys, F.inline(culprit_dimensions(key_chars)))
        .groupBy(*keys, "kind", "name")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    top = F.min(F.when(F.col("name") != "", F.struct((-F.col("n")).alias("minus"), "name")))
    tops = counted.groupBy(*keys, "kind").agg(top.alias("top"), F.sum("n").alias("total"))

    def of(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("top")))

    wide = tops.groupBy(*keys).agg(
        F.max("total").alias("total"), of("app").alias("_app"), of("host").alias("_host"),
        of("message").alias("_message"),
    )
    out = [F.col(k) for k in keys] + [F.col("total")]
    for kind in ("app", "host", "message"):
        count = -F.col(f"_{kind}.minus")
        out += [
            F.col(f"_{kind}.name").alias(f"top_{kind}"),
            count.alias(f"top_{kind}_count"),
            percent_of(count, F.col("total")).alias(f"top_{kind}_percent"),
        ]
    return wide.select(*out)


def newest_matches(matches: DataFrame, k: int = fixed.NEWEST_MATCHES) -> DataFrame:
    """The newest ``k`` matches of each rule; Spark cuts to ``k`` per rule before the shuffle."""
    place = F.row_number().over(
        Window.partitionBy("rule_id").orderBy(F.desc("timestamp"), F.desc("id"))
    )
    return matches.withColumn("place", place).filter(F.col("place") <= k)


def newest_per_app(matches: DataFrame, keys: list[str] = ("rule_id",)) -> DataFrame:
    """The newest match of each app in each group."""
    app = F.coalesce(blank_to_null(F.col("app_name")), F.lit("unknown"))
    newest = F.max_by(F.struct("id", "timestamp", "message"), F.struct("timestamp", "id"))
    return (
        matches.groupBy(*keys, app.alias("app"))
        .agg(newest.alias("_newest"))
        .select(*keys, "app", "_newest.*")
    )


def measured_rate(total: Column, window_seconds: Column) -> Column:
    return F.round(total / F.greatest(window_seconds.cast("double"), F.lit(1.0)), 1)


def summarize_incident(df: DataFrame) -> DataFrame:
    """``incident_summary`` of firings: the event count, or the storm with its culprits.

    Reads rule_type, trigger_count, window_seconds and the columns of ``culprits``.
    """

    def named(kind: str, missing: str) -> Column:
        count = F.col(f"top_{kind}_count").cast("string")
        pct = F.concat(F.col(f"top_{kind}_percent").cast("string"), F.lit("%)"))
        if kind == "message":
            text = F.concat(redact(F.col("top_message")), F.lit(" (x"), count, F.lit(", "), pct)
        else:
            text = F.concat(
                F.col(f"top_{kind}"), F.lit(" ("), count, F.lit("/"),
                F.col("trigger_count").cast("string"), F.lit(", "), pct,
            )
        return F.coalesce(text, F.lit(missing))

    rate = measured_rate(F.col("trigger_count"), F.col("window_seconds"))
    storm = F.concat(
        F.lit(fixed.STORM_HEAD), F.col("trigger_count").cast("string"), F.lit(" logs in "),
        F.col("window_seconds").cast("string"), F.lit("s ("), F.format_string("%.1f", rate),
        F.lit(fixed.STORM_APP), named("app", "Unknown"),
        F.lit(fixed.STORM_HOST), named("host", "Unknown"),
        F.lit(fixed.STORM_MESSAGE), named("message", "N/A"),
    )
    plain = F.concat(
        F.lit(fixed.PLAIN_HEAD), F.col("trigger_count").cast("string"), F.lit(fixed.PLAIN_END)
    )
    return df.withColumn(
        "incident_summary", F.when(F.col("rule_type") == "rate", storm).otherwise(plain)
    )


def fire_alerts(
    logs: DataFrame, rules: DataFrame, as_of=None, matches: DataFrame | None = None,
    key_chars: int | None = fixed.MESSAGE_KEY_CHARS, sample_chars: int | None = fixed.INCIDENT_SAMPLE_CHARS,
) -> DataFrame:
    """All incidents that the rules would have raised over the stored logs.

    A first pass counts the matches per rule and second; the cooldown is folded over these counts.
    A second pass reads the logs of the firings' time (and days, where rows have a ``log_date``) and
    writes the matches of firing seconds, so what is written does not grow with the storms between
    them. ``matches`` may hold the matches already.
    """
    listed = ordered_rules(rules)
    if as_of is not None:
        logs = logs.filter(F.col("timestamp") <= as_of)
    counted = match_alert_rules(logs, listed) if matches is None else matches
    segments = stage(apply_cooldown(per_second(counted), listed), "segments")
    if matches is None:
        matches = match_alert_rules(of_firing_days(logs, segments), listed)
    return incidents_of(matches, segments, rules, key_chars, sample_chars)


def of_firing_days(logs: DataFrame, segments: DataFrame) -> DataFrame:
    """The rows of the days on which a firing holds a second; days without one are not opened."""
    day = F.floor(F.col("sec") / 86_400).alias("day")
    days = sorted(r[0] for r in segments.select(day).distinct().collect())
    first, last = (days[0], days[-1]) if days else (0, -1)
    low, high = (F.timestamp_seconds(F.lit(d * 86_400)) for d in (first, last + 1))
    rows = logs.filter((F.col("timestamp") >= low) & (F.col("timestamp") < high))
    dates = [dt.date(1970, 1, 1) + dt.timedelta(days=d) for d in days]
    return rows.filter(F.col("log_date").isin(*dates)) if "log_date" in logs.columns else rows


def _in_firing_seconds(matches: DataFrame, segments: DataFrame) -> DataFrame:
    """The matches of the seconds that firings hold, with the columns that incidents need."""
    text = F.coalesce(blank_to_null(F.col("message")), F.col("raw"), F.lit(""))
    seconds = segments.select("rule_id", "sec").distinct()
    rows = join_dimension(with_second(matches), seconds, ["rule_id", "sec"], "left_semi")
    return rows.select(
        "rule_id", "id", "timestamp", "source_ip", "source_alias", "app_name",
        text.alias("message"), F.lit("").alias("raw"),
    )


def incidents_of(
    matches: DataFrame, segments: DataFrame, rules: DataFrame,
    key_chars: int | None = fixed.MESSAGE_KEY_CHARS, sample_chars: int | None = fixed.INCIDENT_SAMPLE_CHARS,
) -> DataFrame:
    """Incidents from matches and the result of ``apply_cooldown``, one for each firing.

    ``match_count`` is the exact number of matches behind a firing, as counted. ``trigger_count`` is the
    stored figure: of threshold rules at most one above the threshold. Samples and culprits come from
    ``matches``; ``missing`` tells how many of those counted are not among them."""
    key = ["rule_id", "fire_sec", "k"]
    listed = ordered_rules(rules)
    settings = rules.filter("is_enabled").select(
        F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), "rule_type", "channel_id",
        F.greatest(F.coalesce("threshold_count", F.lit(1)), F.lit(1)).alias("threshold_count"),
        F.greatest(F.coalesce("window_seconds", F.lit(1)), F.lit(1)).alias("window_seconds"),
    )
    rate_ids = [r["id"] for r in _of_type(listed, rate=True)]
    matches = stage(_in_firing_seconds(matches, segments), "matches")
    # Read three times below, and no larger than the firings
    held = stage(
        firing_matches(matches, segments).withColumn("host", host_group()), "firing-matches"
    )
    newest = F.max_by(
        F.struct("id", "timestamp", "message", "app_name", host_group().alias("host")),
        F.struct("timestamp", "id"),
    )
    base = held.groupBy(*key).agg(
        F.count(F.lit(1)).alias("held_count"),
        F.max(F.when(F.col("sec") == F.col("fire_sec"), F.col("timestamp"))).alias("triggered_at"),
        newest.alias("_newest"),
    )
    storms = held.filter(F.col("rule_id").isin(*rate_ids) if rate_ids else F.lit(False))
    blame = culprits(storms, key_chars=key_chars)
    per_app = newest_per_app(storms, key).select(
        *key, F.col("app").alias("top_app"), F.struct("id", "message").alias("_app_newest")
    )
    blamed = blame.join(per_app, [*key, "top_app"], "left")
    sizes = firing_sizes(segments)
    joined = sizes.join(base, key, "left").join(blamed, key, "left").join(settings, "rule_id")
    rate = F.col("rule_type") == "rate"
    counted = joined.withColumn(
        "trigger_count",
        F.when(rate, F.col("counted")).otherwise(
            F.least(F.col("counted"), F.col("threshold_count") + 1)
        ).cast("long"),
    )
    sample = F.when(rate, F.col("_app_newest.message")).otherwise(F.col("_newest.message"))
    return summarize_incident(counted).select(
        "rule_id",
        "rule_name",
        "rule_type",
        "channel_id",
        F.coalesce("triggered_at", F.timestamp_seconds("fire_sec")).alias("triggered_at"),
        "trigger_count",
        F.col("counted").alias("match_count"),
        (sample if sample_chars is None else F.left(sample, F.lit(sample_chars))).alias("sample_log"),
        F.when(rate, F.col("_app_newest.id")).otherwise(F.col("_newest.id")).alias("sample_log_id"),
        "incident_summary",
        "window_seconds",
        F.when(rate, F.col("top_host")).otherwise(F.col("_newest.host")).alias("host"),
        F.when(rate, F.col("top_app")).otherwise(F.col("_newest.app_name")).alias("app_name"),
        F.when(rate, measured_rate(F.col("trigger_count"), F.col("window_seconds"))).alias("rate"),
        (F.col("counted") - F.coalesce("held_count", F.lit(0))).alias("missing"),
    )


def rule_timing(incidents: DataFrame, rules: DataFrame) -> DataFrame:
    """Per rule: firings so far, the last one, and the end of its cooldown."""
    stats = incidents.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("trigger_count"), F.max("triggered_at").alias("last_triggered_at")
    )
    base = rules.select(
        F.col("id").alias("rule_id"), "name", F.coalesce("cooldown_seconds", F.lit(0)).alias("_quiet")
    )
    quiet_end = F.timestamp_micros(F.unix_micros("last_triggered_at") + F.col("_quiet").cast("long") * 1_000_000
    )
    return base.join(stats, "rule_id", "left").select(
        "rule_id",
        "name",
        F.coalesce("trigger_count", F.lit(0)).alias("trigger_count"),
        "last_triggered_at",
        quiet_end.alias("suppress_until"),
    )
