"""The keyed 20-session indicator window: batch twin, stateful stream, sinks and serving."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Context, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from barspan.functions.frames import by_code
from barspan.functions.scalars import INDICATOR
from barspan.operators.clean import keep_last
from barspan.streaming.parse import accepted, consumer_error, dead_letters, decode, parse

WINDOW = 20
_SUM = T.DecimalType(24, 6)
MEASURES = ["ma5", "ma10", "ma20", "vol_ma5", "vol_ma10", "volume_ratio"]


# -- values -------------------------------------------------------------------------
def _mean(total: Column, n: int) -> Column:
    """Exact decimal sum divided once; /5, /10 and /20 of six decimals are exact before the cast."""
    return (total / F.lit(n).cast(T.DecimalType(2, 0))).cast(INDICATOR)


def _finish(df: DataFrame, close_sums: dict[int, Column], volume_sums: dict[int, Column], size: Column) -> DataFrame:
    out = df.withColumn("window_size", size.cast("int"))
    live = {f"ma{n}": F.when(F.col("window_size") >= n, _mean(s, n)) for n, s in close_sums.items()}
    live |= {f"vol_ma{n}": F.when(F.col("window_size") >= n, _mean(s, n)) for n, s in volume_sums.items()}
    out = out.withColumns(live)
    ratio = F.col("volume").cast(INDICATOR) / F.when(F.col("vol_ma5") != 0, F.col("vol_ma5"))
    return out.withColumns(
        {
            "volume_ratio": ratio.cast(INDICATOR),
            "is_warmup": F.col("window_size") < WINDOW,
            "indicator_id": F.format_string("INDICATOR:%s:%s:v1", "ts_code", F.col("trade_date").cast("string")),
        }
    )


def indicator_values(bars: DataFrame) -> DataFrame:
    """Moving averages and volume ratio of finished bars, six decimals HALF_UP, null while warming up."""
    df = bars.withColumns({"close": F.col("close").cast(_SUM), "volume": F.col("volume").cast(_SUM)})

    def total(col, n):
        return F.sum(col).over(by_code().rowsBetween(-(n - 1), 0))

    size = F.count(F.lit(1)).over(by_code().rowsBetween(-(WINDOW - 1), 0))
    return _finish(
        df, {n: total("close", n) for n in (5, 10, 20)}, {n: total("volume", n) for n in (5, 10)}, size
    )


# -- batch twin ---------------------------------------------------------------------
def tag_late(events: DataFrame, rows_per_bucket: int = 100_000) -> DataFrame:
    """Add ``latest_before``: the newest date among earlier arrivals of the key.

    A running maximum over one hot key would be a single task, so arrivals are cut into
    offset ranges: the maximum before a range comes from one small row per range.
    """
    df = events.withColumn("_bucket", F.floor(F.col("offset") / rows_per_bucket))
    before = Window.partitionBy("ts_code").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        df.groupBy("ts_code", "_bucket")
        .agg(F.max("trade_date").alias("_max"))
        .withColumn("_carry", F.max("_max").over(before))
        .drop("_max")
    )
    inside = Window.partitionBy("ts_code", "_bucket").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max("trade_date").over(inside)
    return (
        df.withColumn("_seen", seen)
        .join(ranges, ["ts_code", "_bucket"])
        .withColumn("latest_before", F.greatest("_seen", "_carry"))
        .withColumn("is_late", F.coalesce(F.col("trade_date") < F.col("latest_before"), F.lit(False)))
        .drop("_bucket", "_seen", "_carry")
    )


def indicator_twin(events: DataFrame) -> DataFrame:
    """What the stream emits, computed as a batch.

    A newer date freezes every earlier one, so an accepted row sees the last version of
    each earlier date and its own values. Dates per key are calendar-bounded.
    """
    live = tag_late(events).where(~F.col("is_late"))
    live = live.withColumns({"close": F.col("close").cast(_SUM), "volume": F.col("volume").cast(_SUM)})
    days = live.groupBy("ts_code", "trade_date").agg(
        F.max_by("close", "offset").alias("_c"), F.max_by("volume", "offset").alias("_v")
    )

    def earlier(n):
        return by_code().rowsBetween(-(n - 1), -1)

    zero = F.lit(0).cast(_SUM)
    sums = {f"_c{n}": F.coalesce(F.sum("_c").over(earlier(n)), zero) for n in (5, 10, 20)}
    sums |= {f"_v{n}": F.coalesce(F.sum("_v").over(earlier(n)), zero) for n in (5, 10)}
    context = days.withColumns({**sums, "_n": F.count(F.lit(1)).over(earlier(WINDOW))}).drop("_c", "_v")
    rows = live.join(context, ["ts_code", "trade_date"])
    out = _finish(
        rows,
        {n: F.col(f"_c{n}") + F.col("close") for n in (5, 10, 20)},
        {n: F.col(f"_v{n}") + F.col("volume") for n in (5, 10)},
        F.col("_n") + 1,
    )
    return out.drop(*sums, "_n", "is_late", "latest_before")


# -- stateful stream ----------------------------------------------------------------
_DECIMAL = T.DecimalType(38, 6)
OUTPUT = T.StructType(
    [
        T.StructField("tag", T.StringType()),
        T.StructField("ts_code", T.StringType()),
        T.StructField("trade_date", T.DateType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("close", _DECIMAL),
        T.StructField("volume", _DECIMAL),
        T.StructField("latest_date", T.DateType()),
        T.StructField("window_size", T.IntegerType()),
        *[T.StructField(m, _DECIMAL) for m in MEASURES],
    ]
)
#: Offsets up to here fit the logical clock, whose microseconds are offsets.
ANY_ORDER = 10**15
_WIDE = Context(prec=60)
_POINTS = "dates array<date>, closes array<string>, volumes array<string>"
#: Held arrivals: one entry for the rows that came together, integers as the bytes of their arrays, decimals joined by commas.
_HELD = "days binary, partitions binary, offsets binary, closes string, volumes string"
_EPOCH_DAY = "datetime64[D]"


def _packed(rows: pd.DataFrame) -> tuple:
    days = rows["trade_date"].to_numpy().astype(_EPOCH_DAY).astype("int64")
    integers = (days, *(rows[c].to_numpy().astype("int64") for c in ("partition", "offset")))
    return *(a.tobytes() for a in integers), *(",".join(map(str, rows[c])) for c in ("close", "volume"))


def _unpacked(entries: list[tuple]) -> pd.DataFrame:
    """The rows of held entries in (partition, offset) order."""
    days, partitions, offsets = (np.concatenate([np.frombuffer(e[i], "int64") for e in entries]) for i in range(3))
    order = np.lexsort((offsets, partitions))
    texts = (np.array([v for e in entries for v in e[i].split(",")], dtype=object) for i in (3, 4))
    columns = (days.astype(_EPOCH_DAY).astype(object), partitions, offsets, *texts)
    return pd.DataFrame({n: c[order] for n, c in zip(("trade_date", "partition", "offset", "close", "volume"), columns)})


def _scaled(values) -> np.ndarray:
    """Decimals as integers of millionths, of any size."""
    return np.array([int(Decimal(v).scaleb(6, _WIDE)) for v in values], dtype=object)


def _half_up(total: np.ndarray, n) -> np.ndarray:
    """Rounded quotient, ties away from zero, in integers."""
    down = (2 * np.abs(total) + n) // (2 * n)
    return np.where(total < 0, -down, down)


def _decimals(values: np.ndarray, known: np.ndarray | None = None) -> list[Decimal | None]:
    return [Decimal(int(v)).scaleb(-6, _WIDE) if known is None or known[i] else None for i, v in enumerate(values)]


def advance(key: str, rows: pd.DataFrame, stored: tuple | None) -> tuple[pd.DataFrame, tuple]:
    """Outputs of a key's next rows, which stand in (partition, offset) order, and its new state.

    Late rows leave the state alone, an equal date replaces the last point, a newer date
    appends and evicts beyond 20. Dates of rows in time never fall, so every window consists of the last
    version of earlier dates and the row itself, and all rows are computed at once from running sums.
    """
    dates = np.array(list(stored[0]) if stored else [], dtype="datetime64[D]")
    closes, volumes = (_scaled(stored[i]) if stored else np.array([], dtype=object) for i in (1, 2))
    day = rows["trade_date"].to_numpy().astype("datetime64[D]")
    newest = np.maximum.accumulate(np.concatenate([dates[-1:], day]))
    before = newest[:-1] if len(dates) else np.concatenate([day[:1], newest[:-1]])
    late = day < before
    live = np.flatnonzero(~late)
    c, v = _scaled(rows["close"]), _scaled(rows["volume"])
    # one point a date: what the state holds, then the last version of each date of this batch
    all_days = np.concatenate([dates, day[live]])
    all_c, all_v = np.concatenate([closes, c[live]]), np.concatenate([volumes, v[live]])
    last = np.append(all_days[1:] != all_days[:-1], True) if len(all_days) else np.zeros(0, bool)
    days, day_c, day_v = all_days[last], all_c[last], all_v[last]
    sum_c, sum_v = (np.concatenate([np.zeros(1, object), np.cumsum(x)]) if len(x) else np.zeros(1, object) for x in (day_c, day_v))
    place = np.searchsorted(days, day[live])  # earlier points, at most the last 19 of them count
    size = np.minimum(place + 1, WINDOW)

    def mean(sums, own, n):
        from_ = np.maximum(place - (n - 1), 0)
        return _half_up(sums[place] - sums[from_] + own, n)

    own_c, own_v = c[live], v[live]
    v5 = mean(sum_v, own_v, 5)
    has_base = (size >= 5) & (v5 != 0)
    ratio = _half_up(own_v * 1_000_000, np.where(has_base, v5, 1))
    means = [(mean(sum_c, own_c, n), size >= n) for n in (5, 10, 20)] + [(v5, size >= 5), (mean(sum_v, own_v, 10), size >= 10), (ratio, has_base)]
    which, n_late = np.concatenate([live, np.flatnonzero(late)]), [None] * int(late.sum())
    kept = rows.iloc[which]
    out = {
        "tag": ["main"] * len(live) + ["late"] * len(n_late), "ts_code": key,
        **{n: kept[n].to_numpy() for n in ("trade_date", "partition", "offset")}, "close": _decimals(c[which]), "volume": _decimals(v[which]),
        "latest_date": np.concatenate([day[live], before[late]]).astype(object), "window_size": pd.array([*size.tolist(), *n_late], dtype="Int32"),
        **{name: _decimals(values, known) + n_late for name, (values, known) in zip(MEASURES, means)},
    }
    state = list(days[-WINDOW:].astype(object)), list(map(str, _decimals(day_c[-WINDOW:]))), list(map(str, _decimals(day_v[-WINDOW:])))
    return pd.DataFrame(out, columns=OUTPUT.names), state


def _clock(offset):
    """Microseconds of the logical clock; the watermark starts at 0 and must be behind offset 0."""
    return offset + 1000


class IndicatorWindow(StatefulProcessor):
    """The window of one key in a value state; with ``hold``, arrivals wait in a list state for their turn.

    A held row has a timer on the logical clock (its offset). The watermark passes it when no row
    with a smaller offset can still come, then all rows up to the watermark leave the list in offset order.
    """

    def __init__(self, hold: bool):
        self.hold = hold

    def init(self, handle) -> None:
        self.handle = handle
        self.points = handle.getValueState("points", _POINTS)
        if self.hold:
            self.held = handle.getListState("held", _HELD)

    def _advance(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        out, state = advance(key[0], rows, self.points.get() if self.points.exists() else None)
        if state[0]:
            self.points.update(state)
        yield out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] == "":  # the closing mark
            for _ in rows:
                pass
            return
        if not self.hold:
            yield from self._advance(key, pd.concat(list(rows)).sort_values(["partition", "offset"]))
            return
        smallest = []
        for new in rows:
            self.held.appendValue(_packed(new))
            smallest.append(int(new["offset"].min()))
        self._wait(min(smallest))

    def _wait(self, offset: int) -> None:
        """One timer a key, just after its smallest held offset."""
        clock = _clock(offset) // 1000 + 1
        due = [int(t) for t in self.handle.listTimers()]
        if not due or clock < min(due):
            for t in due:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(clock)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        rows = _unpacked(list(self.held.get()))
        ready = _clock(rows["offset"]) <= upto * 1000
        rest = rows[~ready]
        if len(rest):
            self.held.put([_packed(rest)])
            self._wait(int(rest["offset"].min()))
        else:
            self.held.clear()
        if ready.any():
            yield from self._advance(key, rows[ready])

    def close(self) -> None:
        pass


def stateful_indicators(events: DataFrame, hold: bool = False) -> DataFrame:
    """Streaming main and late rows, tagged; ``events`` comes from :func:`parse.accepted`.

    Without ``hold`` the rows of a micro-batch are taken in offset order, which is enough for a source that
    delivers a key's offsets in order. With it ``events`` carries a watermark on ``clock`` (:func:`on_clock`).
    """
    columns = ["ts_code", "trade_date", "partition", "offset", "close", "volume"]
    rows = events.select(*columns, "clock") if hold else events.select(*columns)
    return rows.groupBy("ts_code").transformWithStateInPandas(
        statefulProcessor=IndicatorWindow(hold), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime" if hold else "None"
    )


def on_clock(events: DataFrame, marks: DataFrame, disorder: int | None) -> DataFrame:
    """Events and closing marks on one logical clock, whose unit is an offset.

    ``disorder``: by how many offsets a row may come after a greater one; None for any order, then rows
    wait until the stream is closed.
    """
    clock = F.timestamp_micros(_clock(F.col("offset"))).alias("clock")
    real = events.select("*", clock)
    empty = {"offset": F.col("offset"), "ts_code": F.lit("")}  # no valid event has a blank code
    end = marks.select(*[empty.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in events.schema.fields], clock)
    return real.unionByName(end).withWatermark("clock", f"{(ANY_ORDER if disorder is None else disorder) // 1000 + 1} milliseconds")


def read_messages(spark, fmt: str = "kafka", **options) -> DataFrame:
    """Streaming envelopes. Kafka resumes from the checkpoint, else from the earliest offset."""
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        options = {"startingOffsets": "earliest", "maxOffsetsPerTrigger": "1000000", **options}
    df = reader.options(**options).load()
    if fmt != "kafka":
        return df
    return df.select(
        "topic", "partition", "offset", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("payload")
    )


def tagged_stream(messages: DataFrame, marks: DataFrame | None = None, disorder: int | None = None) -> DataFrame:
    """Main, late and dead rows of one query, each with its key and JSON body."""
    parsed = parse(messages)
    events = accepted(parsed)
    live = stateful_indicators(events) if marks is None else stateful_indicators(on_clock(events, marks, disorder), hold=True)
    body = F.to_json(F.struct(*[c for c in OUTPUT.names if c != "tag"]))
    dead = dead_letters(parsed)
    return live.select("tag", F.col("ts_code").alias("key"), "offset", body.alias("value")).unionByName(
        dead.select(F.lit("dead").alias("tag"), "key", "offset", F.to_json(F.struct(*dead.columns)).alias("value"))
    )


_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.numRecentProgressUpdates": "100000",  # every trigger's count of dropped rows
}


def _finish_run(rows: DataFrame, write, checkpoint: str) -> None:
    """Run to the end of the available input with state in RocksDB; rows behind the watermark are an error."""
    conf = rows.sparkSession.conf
    before = {k: conf.get(k) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        conf.set(k, v)
    try:
        query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            conf.set(k, v)
    query.awaitTermination()
    lost = sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    if lost:
        raise ValueError(f"{lost} rows came later than the stated disorder allows")


def run_job(messages: DataFrame, out: str, checkpoint: str) -> None:
    """Run to the end of the available input; replaying a batch overwrites its own folder.

    For sources that deliver the offsets of a key in order.
    """
    _finish_run(tagged_stream(messages), _writer(out), checkpoint)


def _writer(out: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("tag").parquet(f"{out}/batch_id={batch_id}")

    return write


def run_ordered_job(messages: DataFrame, out: str, checkpoint: str, disorder: int | None = None, close: bool = True) -> None:
    """As ``run_job`` for sources whose files arrive in any order: rows wait for their offset's turn.

    ``close``: after the available input a closing mark releases what still waits; the stream then takes
    no further rows. Without it a later call goes on from the checkpoint. Waiting rows are in the state store.
    """
    spark = messages.sparkSession
    folder = f"{checkpoint}-marks"

    def mark(at: list) -> None:
        spark.createDataFrame(at, "offset long").coalesce(1).write.mode("append").parquet(folder)

    mark([])
    marks = spark.readStream.schema("offset long").parquet(folder)
    rows = tagged_stream(messages, marks, disorder)
    _finish_run(rows, _writer(out), checkpoint)
    if close:
        mark([(3 * ANY_ORDER,)])
        _finish_run(tagged_stream(messages, marks, disorder), _writer(out), checkpoint)


def outcome_counts(messages: DataFrame, outcome: Column) -> DataFrame:
    """Running counts per outcome of a decoded stream, for update mode."""
    return messages.groupBy(outcome.alias("outcome")).agg(
        F.count(F.lit(1)).alias("records"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset")
    )


def run_counters(messages: DataFrame, out: str, checkpoint: str) -> None:
    """Consumer outcome counters in update mode: a trigger writes the outcomes it changed, keyed by outcome."""
    decoded = decode(messages).withColumn("_class", F.coalesce(consumer_error(), F.lit("success")))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")  # a replayed trigger replaces its own rows

    query = outcome_counts(decoded, F.col("_class")).writeStream.outputMode("update").foreachBatch(write)
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def counters(spark, out: str) -> DataFrame:
    """The keyed sink's newest row per outcome."""
    schema = "outcome string, records long, first_offset long, last_offset long, batch_id int"
    rows = spark.read.schema(schema).option("basePath", out).parquet(out)
    return keep_last(rows, ["outcome"], ["batch_id"]).drop("batch_id")


_WRITTEN = "tag string, key string, offset long, value string, batch_id int"


def job_output(spark, out: str) -> DataFrame:
    return spark.read.schema(_WRITTEN).option("basePath", out).parquet(out)


# -- serving ------------------------------------------------------------------------
def valid_indicator() -> Column:
    """Row contract of the serving table: nullness follows the window size, six decimals at most."""

    def warm(name, n):
        return (F.col("window_size") < n) == F.col(name).isNull()

    ok = F.col("window_size").between(1, WINDOW) & (F.col("is_warmup") == (F.col("window_size") < WINDOW))
    for name, n in (("ma5", 5), ("ma10", 10), ("ma20", 20), ("vol_ma5", 5), ("vol_ma10", 10)):
        ok = ok & warm(name, n) & F.coalesce(F.col(name) >= 0, F.lit(True))
    ok = ok & F.coalesce(F.col("close") >= 0, F.lit(False)) & F.coalesce(F.col("volume") >= 0, F.lit(False))
    no_base = F.col("vol_ma5").isNull() | (F.col("vol_ma5") == 0)
    return F.coalesce(ok & (no_base == F.col("volume_ratio").isNull()), F.lit(False))


def serving_table(rows: DataFrame) -> DataFrame:
    """Valid rows, newest offset per key: the replacing read of the indicator table."""
    return keep_last(rows.where(valid_indicator()), ["ts_code", "trade_date"], ["offset"])
