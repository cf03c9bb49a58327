"""Bars as keyed JSON events, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspan.functions.scalars import compact_date

SCHEMA_VERSION = 1
_DEC = T.DecimalType(38, 6)

# Field names of the event contract.
TEXT_FIELDS = ("eventId", "traceId", "tsCode", "source")
REQUIRED_DECIMALS = ("open", "high", "low", "close", "preClose", "volume", "amount")
OPTIONAL_DECIMALS = ("change", "pctChg")

EVENT_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("eventId", "traceId", "tsCode")]
    + [T.StructField("tradeDate", T.DateType())]
    + [T.StructField(n, _DEC) for n in ("open", "high", "low", "close", "preClose", "change", "pctChg", "volume", "amount")]
    + [
        T.StructField("source", T.StringType()),
        T.StructField("eventTime", T.TimestampType()),
        T.StructField("ingestTime", T.TimestampType()),
        T.StructField("schemaVersion", T.IntegerType()),
    ]
)


def daily_events(bars: DataFrame, source: str, trace: str, ingest_time: str) -> DataFrame:
    """One event per bar. Optional inputs that are absent stay null; identities are upper-cased."""
    code = F.upper(F.trim("ts_code"))
    src = F.lit(source.strip().upper())

    def dec(name):
        col = F.col(name) if name in bars.columns else F.lit(None)
        return col.try_cast(_DEC)

    return bars.select(
        F.concat_ws(":", src, code, compact_date("trade_date")).alias("eventId"),
        F.lit(trace.strip()).alias("traceId"),
        code.alias("tsCode"),
        F.col("trade_date").alias("tradeDate"),
        dec("open").alias("open"),
        dec("high").alias("high"),
        dec("low").alias("low"),
        dec("close").alias("close"),
        dec("pre_close").alias("preClose"),
        dec("change").alias("change"),
        dec("pct_chg").alias("pctChg"),
        dec("vol").alias("volume"),
        dec("amount").alias("amount"),
        src.alias("source"),
        # 15:00 at +08:00
        F.timestamp_add("HOUR", F.lit(7), F.col("trade_date").cast("timestamp")).alias("eventTime"),
        F.lit(ingest_time).cast("timestamp").alias("ingestTime"),
        F.lit(SCHEMA_VERSION).alias("schemaVersion"),
    )


def keyed_messages(events: DataFrame, topic: str) -> DataFrame:
    """Kafka-shaped rows (topic, key, value) ready for any keyed sink."""
    return events.select(
        F.lit(topic).alias("topic"), F.col("tsCode").alias("key"), F.to_json(F.struct("*")).alias("value")
    )


def replay(bars: DataFrame, topic: str, start=None, end=None, ts_code: str | None = None, **meta) -> DataFrame:
    """History as messages in (session, code) order: range-partitioned, sorted inside partitions."""
    if start is not None:
        bars = bars.where(F.col("trade_date") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.where(F.col("trade_date") <= F.lit(end).cast("date"))
    if ts_code is not None:
        bars = bars.where(F.col("ts_code") == ts_code)
    events = daily_events(bars, **meta).orderBy("tradeDate", "tsCode")
    return keyed_messages(events, topic)
