"""Decoding and validation of keyed bar events; every step is a column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspan.functions.frames import computed_once
from barspan.sources.events import EVENT_SCHEMA, REQUIRED_DECIMALS, SCHEMA_VERSION

_CORRUPT = "_corrupt"
_READ = T.StructType([*EVENT_SCHEMA.fields, T.StructField(_CORRUPT, T.StringType())])
_FIELDS = [f.name for f in EVENT_SCHEMA.fields]
_SIGNED = ("open", "high", "low", "preClose")  # required, any sign


# Error classes and the texts of the rules, as the event contract words them.
def violations(event: str = "event", key: str = "key") -> Column:
    """All broken rules of a decoded event, in contract order."""

    def f(name):
        return F.col(f"{event}.{name}")

    def blank(name):
        return F.when(f(name).isNull() | (F.trim(f(name)) == ""), f"{name} must not be blank")

    def absent(name):
        return F.when(f(name).isNull(), f"{name} must not be null")

    def negative(name):
        return F.coalesce(absent(name), F.when(f(name) < 0, f"{name} must be greater than or equal to zero"))

    rules = [blank("eventId"), blank("traceId"), blank("tsCode"), absent("tradeDate")]
    rules += [absent(n) if n in _SIGNED else negative(n) for n in REQUIRED_DECIMALS]
    rules += [
        blank("source"),
        absent("eventTime"),
        absent("ingestTime"),
        absent("schemaVersion"),
        F.when(f("schemaVersion") != SCHEMA_VERSION, "unsupported schemaVersion"),
        F.when(~F.col(key).eqNullSafe(f("tsCode")) | F.col(key).isNull(), "kafkaKey must equal tsCode"),
    ]
    return F.array_compact(F.array(*rules))


def decode(raw: DataFrame) -> DataFrame:
    """Add ``event`` (null unless strictly decodable) and ``violations``.

    ``from_json`` ignores unknown fields, so the payload's own key list is checked too.
    """
    parsed = F.from_json("payload", _READ, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    out = computed_once(raw, {"_event": parsed, "_keys": F.json_object_keys("payload")})
    unknown = F.size(F.array_except("_keys", F.array(*[F.lit(n) for n in _FIELDS]))) > 0
    repeated = F.size(F.array_distinct("_keys")) != F.size("_keys")
    broken = F.coalesce(
        F.col("payload").isNull() | F.col("_keys").isNull() | unknown | repeated | F.col(f"_event.{_CORRUPT}").isNotNull(),
        F.lit(True),
    )
    out = computed_once(out, {"event": F.when(~broken & F.col("_event").isNotNull(), F.col("_event"))})
    checked = F.when(F.col("event").isNotNull(), violations())
    return computed_once(out.drop("_event", "_keys"), {"violations": checked})


def stream_error() -> Column:
    """Null for a valid event; else JSON_PARSE, then KEY_MISMATCH, then VALIDATION."""
    bad = F.size("violations") > 0
    return (
        F.when(F.col("event").isNull(), "JSON_PARSE")
        .when(bad & ~F.col("key").eqNullSafe(F.col("event.tsCode")), "KEY_MISMATCH")
        .when(bad, "VALIDATION")
    )


def consumer_error() -> Column:
    """The consumer's own precedence: undecodable, unsupported schema, validation."""
    return (
        F.when(F.col("event").isNull(), "deserialization")
        .when(F.col("event.schemaVersion") != SCHEMA_VERSION, "unsupported_schema")
        .when(F.size("violations") > 0, "validation")
    )


def parse(raw: DataFrame) -> DataFrame:
    """Envelope columns plus event, violations and ``error_type``."""
    return computed_once(decode(raw), {"error_type": stream_error()})


def dead_letters(parsed: DataFrame) -> DataFrame:
    """Rejected envelopes with their original coordinates and all reasons."""
    message = F.when(F.col("error_type") == "JSON_PARSE", "invalid event JSON").otherwise(F.concat_ws("; ", "violations"))
    return parsed.where("error_type IS NOT NULL").select(
        "topic", "partition", "offset", "key", "payload", "error_type", message.alias("error_message")
    )


def accepted(parsed: DataFrame) -> DataFrame:
    """Valid events as flat rows, ordered later by (partition, offset)."""
    return parsed.where("error_type IS NULL").select(
        F.col("event.tsCode").alias("ts_code"),
        F.col("event.tradeDate").alias("trade_date"),
        F.col("event.close").alias("close"),
        F.col("event.volume").alias("volume"),
        F.col("event.eventId").alias("event_id"),
        "partition",
        "offset",
    )
