"""JSON log records: reading, field aliases, defaults and reserved identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed
from ..functions.common import blank_to_null, let, strip
from ..functions.severity import severity_code
from ..functions.text import cap_text, clean_text, longer_than, replace_surrogates
from ..functions.times import parse_epoch, parse_iso
from ..session import join_dimension


def read_json_records(
    spark: SparkSession, path: str, layout: str = "lines", strict: bool = False
) -> DataFrame:
    """Records of JSON files as one variant column ``record`` (and ``bad_text`` for what is none).

    ``lines``: one value per line, files of any size split between tasks. ``document``: each file
    is one array, one object, or lines.
    """
    if layout == "lines":
        bodies = spark.read.text(path).withColumnRenamed("value", "body")
    elif layout == "document":
        bodies = spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")
    else:
        raise ValueError("layout is 'lines' or 'document'")
    return explode_records(bodies, strict)


def _as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def exact_json(text: Column) -> Column:
    """The text as a variant when it is exactly one JSON value, otherwise null.

    The parser stops after the first value and ignores what follows. Inside an array and inside
    an object nothing but the closing bracket may follow, so both readings must succeed.
    """
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))

    def sure(items: Column) -> Column:
        # Only a bracket in the text can end the array early
        whole = (F.size(items) == 1) & (~text.contains("]") | in_object.isNotNull())
        return F.when(whole, F.get(items, 0))

    return let(_as_array(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))), sure)


def explode_records(bodies: DataFrame, strict: bool = False) -> DataFrame:
    """Request bodies as records.

    Objects in an array are taken, other items of it skipped. A line that is no JSON object or
    array is bad: with ``strict`` it is an error, otherwise a row with ``bad_text``.
    """
    text = strip(F.coalesce("body", F.lit("")))
    others = [c for c in bodies.columns if c != "body"]
    # A body is one JSON value when it parses as such; otherwise each of its lines is one
    whole = bodies.select(*others, text.alias("_body")).withColumn("_whole", exact_json(F.col("_body")))
    single = F.col("_whole").isNotNull() & (
        _is_object(F.col("_whole")) | F.col("_body").startswith("[")
    )

    def pair(line: Column, value: Column) -> Column:
        return F.struct(line.alias("_line"), value.alias("_v"))

    split = F.filter(F.transform(F.split("_body", "\r\n|\n|\r"), strip), lambda x: x != "")
    pieces = F.when(single, F.array(pair(F.col("_body"), F.col("_whole")))).otherwise(
        F.transform(split, lambda x: pair(x, exact_json(x)))
    )
    lines = whole.select(*others, F.inline(pieces))
    value = F.col("_v")
    items = F.when(_is_object(value), F.array(value)).when(
        F.col("_line").startswith("["), F.filter(_as_array(value), _is_object)
    )
    lines = lines.withColumn("_items", items)
    if strict:
        failed = F.raise_error(F.concat(F.lit("not a JSON object: "), F.col("_line")))
        good = lines.withColumn("_items", F.coalesce("_items", failed.cast("array<variant>")))
        return good.select(*others, F.explode("_items").alias("record"))
    found = lines.select(
        *others, F.explode_outer("_items").alias("record"),
        F.when(F.col("_items").isNull(), F.col("_line")).alias("bad_text"),
    )
    return found.filter(F.col("record").isNotNull() | F.col("bad_text").isNotNull())


# Fields that records may carry.
FIELDS = (
    "message", "msg", "timestamp", "time", "ts", "source_ip", "source_alias", "app_name", "app",
    "facility", "severity", "level", "raw",
)


# Those whose JSON type decides how they are read.
TYPED = ("timestamp", "time", "ts", "source_ip", "source_alias", "app_name", "app", "facility")


def _with_fields(records: DataFrame) -> DataFrame:
    """Every field read once: its text in ``_t_name``, its JSON type in ``_k_name``."""
    found = records.withColumns(
        {
            **{f"_f_{n}": F.try_variant_get("record", f"$.{n}", "variant") for n in TYPED},
            **{f"_t_{n}": F.try_variant_get("record", f"$.{n}", "string") for n in FIELDS if n not in TYPED},
        }
    )
    return found.withColumns(
        {
            **{f"_t_{n}": F.try_variant_get(f"_f_{n}", "$", "string") for n in TYPED},
            **{f"_k_{n}": F.schema_of_variant(f"_f_{n}") for n in TYPED},
        }
    )


def _type(name: str) -> Column:
    return F.col(f"_k_{name}")


def field_text(name: str) -> Column:
    """A field of the record as text; null when missing or JSON null."""
    return F.col(f"_t_{name}")


def _is_number(name: str) -> Column:
    return F.coalesce(
        _type(name).isin("BIGINT", "DOUBLE", "FLOAT") | _type(name).startswith("DECIMAL"), F.lit(False)
    )


def _truthy(name: str) -> Column:
    """The field's text, null for the empty text, zero and false."""
    text = field_text(name)
    empty = (text == "") | (_is_number(name) & (text.try_cast("double") == 0)) | (
        (_type(name) == "BOOLEAN") & (text == "false")
    )
    return F.when(~empty, text)


def _record_time() -> Column:
    """The record's time: the first of timestamp, time and ts that is given."""
    times = []
    for name in ("timestamp", "time", "ts"):
        text = _truthy(name)
        number = _is_number(name)
        read = F.when(number, parse_epoch(text, True)).otherwise(
            F.coalesce(parse_epoch(text), parse_iso(text))
        )
        usable = F.when(_type(name) != "BOOLEAN", read)
        times.append((text, usable))
    out = F.lit(None).cast("timestamp")
    for text, read in reversed(times):
        out = F.when(text.isNotNull(), read).otherwise(out)
    return out


def normalize_json_records(
    records: DataFrame,
    received_at: Column | str = "received_at",
    aliases: DataFrame | None = None,
    max_age_days: int = 30,
    client_ip: Column | str | None = None,
    max_chars: int | None = fixed.MAX_TEXT_CHARS,
    identity_chars: int | None = fixed.MAX_IDENTITY_CHARS,
) -> DataFrame:
    """Records as log rows without id, with ``reserved`` (why an identity may not be used) and
    ``truncated``: whether message or raw text was cut to ``max_chars`` (None: never). Names are cut
    to ``identity_chars``.

    A time outside [received - ``max_age_days``, received + 300 s] becomes the received time.
    """
    received = F.col(received_at) if isinstance(received_at, str) else received_at
    sender = F.lit("external") if client_ip is None else (
        F.col(client_ip) if isinstance(client_ip, str) else client_ip
    )

    def identity(first: Column, default: Column) -> Column:
        text = F.coalesce(blank_to_null(strip(replace_surrogates(first))), default)
        return cap_text(text, identity_chars)

    def cleaned(text: Column) -> Column:
        return clean_text(replace_surrogates(text))

    def stored(text: Column) -> Column:
        return cap_text(cleaned(text), max_chars)

    said = F.coalesce(field_text("message"), field_text("msg"), F.lit(""))
    message = stored(said)
    ts = _record_time()
    age = F.unix_micros(received) - F.unix_micros(ts)
    in_range = (age <= max_age_days * 86_400_000_000) & (age >= -fixed.MAX_FUTURE_SECONDS * 1_000_000)
    facility = F.when(
        _type("facility").isNull() | (_type("facility") == "VOID"), F.lit(1)
    ).otherwise(
        F.coalesce(
            F.when(_is_number("facility"), field_text("facility").try_cast("double").try_cast("int"))
            .otherwise(strip(field_text("facility")).try_cast("int")),
            F.lit(1),
        )
    )
    level = F.coalesce(field_text("severity"), field_text("level"))
    staged = _with_fields(records).withColumns(
        {
            "_ip": identity(_truthy("source_ip"), sender),
            "_message": message,
            "_ts": ts,
            "_received": received,
        }
    )
    staged = staged.withColumn("source_alias", identity(_truthy("source_alias"), F.col("_ip")))
    reserved = reserved_reason(F.col("_ip"), F.col("source_alias"))
    staged = staged.withColumn("reserved", reserved)
    if aliases is not None:
        dim = aliases.filter(F.col("alias") != "").groupBy("ip").agg(F.max("alias").alias("_alias"))
        staged = join_dimension(staged, dim.withColumnRenamed("ip", "source_alias"), ["source_alias"])
        staged = staged.withColumn("source_alias", F.coalesce("_alias", "source_alias"))
    raw = F.when(field_text("raw").isNotNull(), stored(field_text("raw"))).otherwise(F.col("_message"))
    made = {
        "timestamp": F.when(in_range, F.col("_ts")).otherwise(F.col("_received")),
        "received_at": F.col("_received"),
        "source_ip": F.col("_ip"),
        "source_alias": F.col("source_alias"),
        "app_name": identity(F.coalesce(_truthy("app_name"), _truthy("app")), F.lit("app")),
        "facility": F.least(F.greatest(facility, F.lit(0)), F.lit(23)),
        "severity": F.coalesce(severity_code(level), F.lit(6)).cast("int"),
        "message": F.col("_message"),
        "raw": raw,
        "reserved": F.col("reserved"),
        "truncated": longer_than(cleaned(said), max_chars) | longer_than(cleaned(field_text("raw")), max_chars),
    }
    kept = [c for c in records.columns if c not in made and c not in ("record", "bad_text")]
    return staged.select(*kept, *[c.alias(n) for n, c in made.items()])


def reserved_reason(source_ip: Column, source_alias: Column, own_alias: str | None = None) -> Column:
    """Why a record may not use its identity, or null. Container output has its own collector;
    ``own_alias`` at 127.0.0.1 belongs to the application's own log."""
    ip = F.lower(source_ip)
    container = (ip == fixed.CONTAINER_SOURCE) | ip.startswith(fixed.CONTAINER_SOURCE + ":")
    out = F.when(container, F.lit("reserved for the container collector"))
    if own_alias:
        own = (source_ip == "127.0.0.1") & (F.lower(source_alias) == own_alias.lower())
        out = out.when(own, F.lit("reserved for the application's own log"))
    return out


def reserved_identity(rows: DataFrame, own_alias: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones with the reason in ``reserved``."""
    marked = rows.withColumn(
        "reserved", reserved_reason(F.col("source_ip"), F.col("source_alias"), own_alias)
    )
    return marked.filter("reserved IS NULL").drop("reserved"), marked.filter("reserved IS NOT NULL")
