"""Event parsing, the keyed indicator window as batch and stream, sinks and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspan.operators.tables import top_rows
from barspan.plans.oracle import code_sql
from barspan.plans.registry import query
from barspan.session import scratch_dir
from barspan.sources import sinks as K
from barspan.streaming import indicators as I
from barspan.streaming import parse as P

KEYS = ["ts_code", "trade_date"]
# Fixed value: the reason that late rows carry.
LATE_REASON = "TRADE_DATE_BEFORE_LATEST"

_MSG = f"""SELECT event_id AS "offset", {code_sql('user_id')} AS code, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k,
    event_type = 'error' AS bad, CAST(ts AS DATE) AS d, value, ts FROM events"""
_MSG2 = """SELECT *, CAST(d - CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END AS DATE) AS trade_date,
    CASE WHEN bad AND k % 4 = 1 THEN 'X' || code ELSE code END AS key,
    CASE WHEN bad AND k % 4 = 0 THEN 'JSON_PARSE' WHEN bad AND k % 4 = 1 THEN 'KEY_MISMATCH'
      WHEN bad AND (k % 4 = 3 OR (k % 4 = 2 AND value > 0)) THEN 'VALIDATION' END AS error_type,
    CASE WHEN bad AND k % 4 = 2 THEN -value ELSE value END AS close, k + 1 AS volume FROM msg"""
_STREAM = {
    "msg": _MSG,
    "msgs": _MSG2,
    "live0": "SELECT *, max(trade_date) OVER (PARTITION BY code ORDER BY \"offset\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM msgs WHERE error_type IS NULL",
    "live": "SELECT * FROM live0 WHERE latest IS NULL OR trade_date >= latest",
    "dayend": "SELECT code, trade_date, arg_max(close, \"offset\") AS c, arg_max(volume, \"offset\") AS v FROM live GROUP BY 1, 2",
    "prior": "SELECT code, trade_date, "
    + ", ".join(f"coalesce(sum(CAST(c AS DECIMAL(24,6))) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND 1 PRECEDING), 0) AS c{n}" for n in (5, 10, 20))
    + ", " + ", ".join(f"coalesce(sum(v) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND 1 PRECEDING), 0) AS v{n}" for n in (5, 10))
    + ", 1 + count(*) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) AS size FROM dayend",
}

_ROWS = """SELECT code AS ts_code, trade_date, "offset", CAST(close AS DOUBLE) AS close, CAST(volume AS DOUBLE) AS volume, size AS window_size,
    CASE WHEN size >= 5 THEN round(CAST(c5 + CAST(close AS DECIMAL(24,6)) AS DOUBLE) / 5, 6) END AS ma5,
    CASE WHEN size >= 10 THEN round(CAST(c10 + CAST(close AS DECIMAL(24,6)) AS DOUBLE) / 10, 6) END AS ma10,
    CASE WHEN size >= 20 THEN round(CAST(c20 + CAST(close AS DECIMAL(24,6)) AS DOUBLE) / 20, 6) END AS ma20,
    CASE WHEN size >= 5 THEN CAST(v5 + volume AS DOUBLE) / 5 END AS vol_ma5,
    CASE WHEN size >= 10 THEN CAST(v10 + volume AS DOUBLE) / 10 END AS vol_ma10,
    CASE WHEN size >= 5 AND v5 + volume <> 0 THEN round(volume / (CAST(v5 + volume AS DOUBLE) / 5), 6) END AS volume_ratio
    FROM live JOIN prior USING (code, trade_date)"""


def _doubles(df, *names):
    return df.select(*[F.col(n) for n in names], *[F.col(m).cast("double").alias(m) for m in ("close", "volume", *I.MEASURES)])


@query(
    "t1_parse_and_validate",
    """SELECT "offset", key, coalesce(error_type, 'VALID') AS outcome, CASE WHEN error_type IS NULL THEN trade_date END AS trade_date FROM msgs""",
    **_STREAM,
)
def _(t):
    p = P.parse(t.messages)
    return p.select(
        "offset", "key", F.coalesce("error_type", F.lit("VALID")).alias("outcome"),
        F.when(F.col("error_type").isNull(), F.col("event.tradeDate")).alias("trade_date"),
    )


@query(
    "f12_all_violations",
    """SELECT "offset", concat_ws('; ', CASE WHEN bad AND k % 4 = 2 AND value > 0 THEN 'close must be greater than or equal to zero' END,
    CASE WHEN bad AND k % 4 = 3 THEN 'source must not be blank' END, CASE WHEN bad AND k % 8 = 7 THEN 'unsupported schemaVersion' END,
    CASE WHEN bad AND k % 4 = 1 THEN 'kafkaKey must equal tsCode' END) AS violations FROM msgs WHERE error_type IS DISTINCT FROM 'JSON_PARSE'""",
    **_STREAM,
)
def _(t):
    d = P.decode(t.messages).where("event IS NOT NULL")
    return d.select("offset", F.concat_ws("; ", "violations").alias("violations"))


@query(
    "t2_consumer_classes",
    """SELECT CASE WHEN error_type = 'JSON_PARSE' THEN 'deserialization' WHEN bad AND k % 8 = 7 THEN 'unsupported_schema'
    WHEN error_type IS NOT NULL THEN 'validation' ELSE 'success' END AS outcome, count(*) AS records FROM msgs GROUP BY 1""",
    **_STREAM,
)
def _(t):
    d = P.decode(t.messages).withColumn("outcome", F.coalesce(P.consumer_error(), F.lit("success")))
    return d.groupBy("outcome").agg(F.count(F.lit(1)).alias("records"))


@query(
    "a15_error_counts",
    "SELECT coalesce(error_type, 'VALID') AS outcome, count(*) AS records, min(\"offset\") AS first_offset, max(\"offset\") AS last_offset FROM msgs GROUP BY 1",
    **_STREAM,
)
def _(t):
    p = P.parse(t.messages)
    return p.groupBy(F.coalesce("error_type", F.lit("VALID")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("records"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset")
    )


@query(
    "a15_streaming_counts",
    """SELECT CASE WHEN error_type = 'JSON_PARSE' THEN 'deserialization' WHEN bad AND k % 8 = 7 THEN 'unsupported_schema'
    WHEN error_type IS NOT NULL THEN 'validation' ELSE 'success' END AS outcome, count(*) AS records, min("offset") AS first_offset, max("offset") AS last_offset FROM msgs GROUP BY 1""",
    **_STREAM,
)
def _(t):
    """Two runs over one checkpoint: the counters go on where they stopped."""
    path, out, checkpoint = _write_messages(t, "counted"), scratch_dir(t.spark, "counters"), scratch_dir(t.spark, "counter-state")
    for _ in range(2):
        I.run_counters(_read_stream(t, path), out, checkpoint)
    return I.counters(t.spark, out)


@query(
    "a15_newest_errors",
    "SELECT \"offset\", key, error_type, position FROM (SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY \"offset\" DESC) AS position FROM msgs WHERE error_type IS NOT NULL) WHERE position <= 100",
    **_STREAM,
)
def _(t):
    dead = P.dead_letters(P.parse(t.messages))
    return top_rows(dead, [F.desc("offset")], 100, ["error_type"]).select("offset", "key", "error_type", "position")


@query(
    "t4_indicator_values",
    """SELECT ts_code, trade_date, close, vol AS volume, CASE WHEN n >= 5 THEN round(c5 / 5, 6) END AS ma5, CASE WHEN n >= 10 THEN round(c10 / 10, 6) END AS ma10,
    CASE WHEN n >= 20 THEN round(c20 / 20, 6) END AS ma20, CASE WHEN n >= 5 THEN round(v5 / 5, 6) END AS vol_ma5, CASE WHEN n >= 10 THEN round(v10 / 10, 6) END AS vol_ma10,
    CASE WHEN n >= 5 AND v5 <> 0 THEN round(vol / (v5 / 5), 6) END AS volume_ratio, least(n, 20) AS window_size, n < 20 AS is_warmup, 'INDICATOR:' || ts_code || ':' || CAST(trade_date AS VARCHAR) || ':v1' AS indicator_id
    FROM (SELECT *, row_number() OVER w AS n, """
    + ", ".join(f"CAST(sum(CAST(close AS DECIMAL(24,6))) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS {n - 1} PRECEDING) AS DOUBLE) AS c{n}" for n in (5, 10, 20))
    + ", " + ", ".join(f"sum(vol) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS {n - 1} PRECEDING) AS v{n}" for n in (5, 10))
    + " FROM bars WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date))",
)
def _(t):
    out = I.indicator_values(t.bars.select(*KEYS, "close", F.col("vol").alias("volume")))
    return _doubles(out, *KEYS, "window_size", "is_warmup", "indicator_id")


@query(
    "f13_indicator_rows_valid",
    """SELECT ts_code, trade_date, CASE dayofweek(trade_date) WHEN 1 THEN false WHEN 2 THEN n < 5 WHEN 3 THEN close = 0 WHEN 4 THEN false ELSE true END AS valid
    FROM (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) AS n FROM bars)""",
)
def _(t):
    """Rows spoilt by weekday: wrong warm-up flag, missing mean, negative close, impossible window; Fridays are sound."""
    day = F.dayofweek("trade_date")
    out = I.indicator_values(t.bars.select(*KEYS, "close", F.col("vol").alias("volume")))
    spoilt = out.withColumns(
        {
            "is_warmup": F.when(day == 2, ~F.col("is_warmup")).otherwise(F.col("is_warmup")),
            "ma5": F.when(day != 3, F.col("ma5")),
            "close": F.when(day == 4, -F.col("close")).otherwise(F.col("close")),
            "window_size": F.when(day == 5, 21).otherwise(F.col("window_size")),
        }
    )
    return spoilt.select(*KEYS, I.valid_indicator().alias("valid"))


@query(
    "t5_late_rows",
    "SELECT \"offset\", code AS ts_code, trade_date, latest AS latest_date, 'TRADE_DATE_BEFORE_LATEST' AS reason FROM live0 WHERE trade_date < latest",
    **_STREAM,
)
def _(t):
    late = I.tag_late(P.accepted(P.parse(t.messages))).where("is_late")
    return late.select("offset", *KEYS, F.col("latest_before").alias("latest_date"), F.lit(LATE_REASON).alias("reason"))


@query("t6_batch_twin", _ROWS, **_STREAM)
def _(t):
    out = I.indicator_twin(P.accepted(P.parse(t.messages)))
    return _doubles(out, *KEYS, "offset", "window_size")


def _write_messages(t, name):
    path = scratch_dir(t.spark, name)
    K.write_in_order(t.messages, path, "offset")
    return path


def _any_order(t, rows, name):
    """Files as their tasks finish; the job itself puts the offsets in order."""
    path = scratch_dir(t.spark, name)
    rows.write.parquet(path)
    return _read_stream(t, path)


def _read_stream(t, path):
    schema = "topic string, partition int, offset long, key string, payload string"
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)


def _run(t, messages):
    out, checkpoint = scratch_dir(t.spark, "stream-out"), scratch_dir(t.spark, "stream-state")
    I.run_ordered_job(messages, out, checkpoint)
    return I.job_output(t.spark, out)


_BODY = "ts_code string, trade_date date, offset long, close decimal(38,6), volume decimal(38,6), latest_date date, window_size int, " + ", ".join(
    f"{m} decimal(38,6)" for m in I.MEASURES
)


def _bodies(rows, tag):
    return rows.where(F.col("tag") == tag).select(F.from_json("value", _BODY).alias("b")).select("b.*")


@query("t3_stateful_stream", _ROWS, **_STREAM)
def _(t):
    rows = _run(t, _any_order(t, t.messages, "messages"))
    return _doubles(_bodies(rows, "main"), *KEYS, "offset", "window_size")


@query(
    "s9_three_outputs",
    """SELECT CASE WHEN error_type IS NOT NULL THEN 'dead' WHEN l.latest > m.trade_date THEN 'late' ELSE 'main' END AS tag, count(*) AS records
    FROM msgs m LEFT JOIN (SELECT "offset", latest FROM live0) l USING ("offset") GROUP BY 1""",
    **_STREAM,
)
def _(t):
    rows = _run(t, _any_order(t, t.messages, "messages"))
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("records"))


@query("s8_keyed_source", 'SELECT \'stock-daily\' AS topic, 0 AS partition, "offset", key FROM msgs', **_STREAM)
def _(t):
    path = _write_messages(t, "source")
    out, checkpoint = scratch_dir(t.spark, "source-out"), scratch_dir(t.spark, "source-state")
    q = (
        _read_stream(t, path).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    schema = "topic string, partition int, offset long, key string, payload string"
    return t.spark.read.schema(schema).parquet(out).select("topic", "partition", "offset", "key")


@query(
    "t7_serving_table",
    "SELECT ts_code, trade_date, \"offset\", ma5, vol_ma5, window_size FROM (SELECT *, row_number() OVER (PARTITION BY ts_code, trade_date ORDER BY \"offset\" DESC) AS k FROM emitted) WHERE k = 1",
    **_STREAM,
    emitted=_ROWS,
)
def _(t):
    out = I.serving_table(I.indicator_twin(P.accepted(P.parse(t.messages))))
    return out.select(*KEYS, "offset", F.col("ma5").cast("double").alias("ma5"), F.col("vol_ma5").cast("double").alias("vol_ma5"), "window_size")


@query(
    "t8_replay_through_stream",
    """SELECT ts_code, trade_date, least(n, 20) AS window_size, CASE WHEN n >= 5 THEN round(c5 / 5, 6) END AS ma5, CASE WHEN n >= 20 THEN round(c20 / 20, 6) END AS ma20
    FROM (SELECT *, row_number() OVER w AS n, CAST(sum(CAST(close AS DECIMAL(24,6))) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS 4 PRECEDING) AS DOUBLE) AS c5,
    CAST(sum(CAST(close AS DECIMAL(24,6))) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS 19 PRECEDING) AS DOUBLE) AS c20
    FROM nbars WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date))""",
)
def _(t):
    from barspan.functions.frames import previous
    from barspan.sources.events import replay

    bars = t.nation_bars.withColumn("pre_close", F.coalesce(previous("close"), F.col("open")))
    m = replay(bars, "stock-daily", source="database", trace="replay", ingest_time="2024-01-01 00:00:00")
    day = F.unix_date(F.to_date(F.get_json_object("value", "$.tradeDate")))
    rows = m.select("topic", F.lit(0).alias("partition"), day.cast("long").alias("offset"), "key", F.col("value").alias("payload"))
    main = _bodies(_run(t, _any_order(t, rows, "replay")), "main")
    return main.select(*KEYS, "window_size", F.col("ma5").cast("double").alias("ma5"), F.col("ma20").cast("double").alias("ma20"))


@query(
    "s13_dual_sink",
    "SELECT unnest(['archive', 'topic', 'combined']) AS destination, (SELECT count(*) FROM events) AS delivered",
)
def _(t):
    base = scratch_dir(t.spark, "dual")
    return K.deliver(t.messages, {"archive": ("parquet", f"{base}/archive"), "topic": ("json", f"{base}/topic")})


@query(
    "s14_snapshot_manifest",
    "SELECT ts_code, count(*) AS rows, min(trade_date) AS first_date, max(trade_date) AS last_date FROM bars GROUP BY 1",
)
def _(t):
    manifest = K.write_snapshot(t.bars, scratch_dir(t.spark, "snapshot"), t.bars.columns)
    return manifest.drop("digest")


_CENTS = ("open", "high", "low", "close", "vol", "amount")
_ROW = """'{"ts_code":"' || ts_code || '","trade_date":"' || trade_date || '\"' || """ + " || ".join(f"""',"{c}":' || CAST(round({c} * 100) AS BIGINT)""" for c in _CENTS) + " || '}'"
_TREE = {
    "hashed": f"SELECT ts_code, trade_date, ts_code || ' ' || year(trade_date) AS leaf, left(ts_code, 3) AS prefix, sha256({_ROW}) AS d FROM bars",
    "leaves": "SELECT leaf, ts_code, prefix, count(*) AS n, min(trade_date) AS a, max(trade_date) AS b, sha256(string_agg(d, '' ORDER BY trade_date)) AS d FROM hashed GROUP BY ALL",
    "codes": "SELECT ts_code, prefix, sum(n) AS n, min(a) AS a, max(b) AS b, sha256(string_agg(d, '' ORDER BY leaf)) AS d FROM leaves GROUP BY ALL",
    "prefixes": "SELECT prefix, sum(n) AS n, sha256(string_agg(d, '' ORDER BY ts_code)) AS d FROM codes GROUP BY ALL",
}


def _digest_tree(bars):
    """Years of an instrument, instruments, instruments of one prefix, everything: prices as whole cents."""
    cents = {c: F.round(F.col(c) * 100).cast("long") for c in _CENTS}
    rows = bars.withColumns({**cents, "leaf": F.concat_ws(" ", "ts_code", F.year("trade_date")), "prefix": F.substring("ts_code", 1, 3)})
    return K.chained_digests(rows, [*KEYS, *_CENTS], ["trade_date"], ["leaf", "ts_code", "prefix"])


@query("q8_dataset_fingerprint", "SELECT ts_code, CAST(n AS BIGINT) AS rows, a AS first_date, b AS last_date, d AS digest FROM codes", **_TREE)
def _(t):
    tree = _digest_tree(t.bars).where("level = 1").select(F.col("node").alias("ts_code"), "rows", "digest")
    spans = t.bars.groupBy("ts_code").agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))
    return tree.join(spans, "ts_code")


@query(
    "q8_digest_tree",
    """SELECT 2 AS level, prefix AS node, CAST(n AS BIGINT) AS rows, d AS digest FROM prefixes UNION ALL
    SELECT 3, '', CAST(sum(n) AS BIGINT), sha256(string_agg(d, '' ORDER BY prefix)) FROM prefixes""",
    **_TREE,
)
def _(t):
    return _digest_tree(t.bars).where("level >= 2")


@query(
    "q8_changed_shards",
    """SELECT leaf AS node, count(*) AS rows_before, count(*) AS rows_after FROM (SELECT ts_code || ' ' || year(trade_date) AS leaf, vol FROM bars)
    GROUP BY 1 HAVING count(*) FILTER (vol > 95) > 0""",
)
def _(t):
    """A second version with another volume on a few days: only the shards that hold one are named."""
    changed = t.bars.withColumn("vol", F.when(F.col("vol") > 95, F.col("vol") + 1).otherwise(F.col("vol")))
    return K.differing_nodes(_digest_tree(t.bars), _digest_tree(changed))
