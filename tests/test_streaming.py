"""The stateful stream: scenarios, restart, and equality with the batch twin."""

import json

import pytest

from barspan.session import scratch_dir
from barspan.streaming import indicators as I
from barspan.streaming import parse as P

SCHEMA = "topic string, partition int, offset long, key string, payload string"


def message(offset, code, day, close=1.0, volume=10.0, key=None, **change):
    body = dict(
        eventId=f"S:{code}:{day}", traceId="t", tsCode=code, tradeDate=day, open=1, high=1, low=1, close=close, preClose=1,
        volume=volume, amount=1, source="S", eventTime="2024-01-01T15:00:00+08:00", ingestTime="2024-01-01T15:00:00+08:00", schemaVersion=1,
    )
    body.update(change)
    return ("stock-daily", 0, offset, key or code, json.dumps({k: v for k, v in body.items() if v is not ...}))


def days(n):
    return [f"2024-02-{i + 1:02d}" for i in range(n)]


def run(spark, rows, source=None, out=None, checkpoint=None):
    source, out, checkpoint = (p or scratch_dir(spark, n) for p, n in ((source, "src"), (out, "out"), (checkpoint, "chk")))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    I.run_job(spark.readStream.schema(SCHEMA).parquet(source), out, checkpoint)
    tags = {r["tag"]: r["count"] for r in I.job_output(spark, out).groupBy("tag").count().collect()}
    return tags, source, out, checkpoint


def test_valid_and_late_and_dead(spark):
    rows = [message(i, f"{c:06d}.SZ", d) for i, (c, d) in enumerate((c, d) for c in (1, 2) for d in days(20))]
    tags, *_ = run(spark, [*rows, message(40, "000002.SZ", days(20)[-1], close=5.0)])
    assert tags == {"main": 41}
    rows = [message(i, "000001.SZ", d) for i, d in enumerate(days(21))]
    tags, *_ = run(spark, [*rows, message(21, "000001.SZ", days(1)[0])])
    assert tags == {"main": 21, "late": 1}
    tags, *_ = run(spark, [("stock-daily", 0, 0, "k", "{bad"), message(1, "000001.SZ", "2024-02-01", key="other")])
    assert tags == {"dead": 2}


def test_restart_keeps_state_and_matches_twin(spark):
    rows = [message(i, "000001.SZ", d, close=float(i + 1), volume=10.0 * (i + 1)) for i, d in enumerate(days(12))]
    _, source, out, checkpoint = run(spark, rows[:7])
    tags, *_ = run(spark, rows[7:], source, out, checkpoint)
    assert tags == {"main": 12}
    got = {json.loads(r["value"])["offset"]: json.loads(r["value"]) for r in I.job_output(spark, out).collect()}
    assert float(got[9]["ma10"]) == 5.5 and got[9]["window_size"] == 10
    twin = I.indicator_twin(P.accepted(P.parse(spark.createDataFrame(rows, SCHEMA)))).collect()
    for r in twin:
        assert r["window_size"] == got[r["offset"]]["window_size"]
        for m in I.MEASURES:
            assert (r[m] is None) == (m not in got[r["offset"]]) and (r[m] is None or float(r[m]) == float(got[r["offset"]][m]))


@pytest.mark.parametrize(
    ("row", "error"),
    [
        (("t", 0, 0, "000001.SZ", None), "JSON_PARSE"),
        (("t", 0, 0, "000001.SZ", "null"), "JSON_PARSE"),
        (("t", 0, 0, "000001.SZ", '{"eventId": "x"'), "JSON_PARSE"),
        (message(0, "000001.SZ", "2024-02-01", extra=1), "JSON_PARSE"),
        (message(0, "000001.SZ", "2024-02-01", key="x"), "KEY_MISMATCH"),
        (message(0, "000001.SZ", "2024-02-01", source=" "), "VALIDATION"),
        (message(0, "000001.SZ", "2024-02-01", volume=-1), "VALIDATION"),
        (message(0, "000001.SZ", "2024-02-01", open=...), "VALIDATION"),
        (message(0, "000001.SZ", "2024-02-01", schemaVersion=2), "VALIDATION"),
        (message(0, "000001.SZ", "2024-02-01"), None),
    ],
)
def test_error_classes(spark, row, error):
    assert P.parse(spark.createDataFrame([row], SCHEMA)).first()["error_type"] == error


def test_many_files_in_shuffled_finish_order_equal_the_batch_twin(spark, sf_dir, tmp_path):
    """More files than one trigger admits, written by tasks that end in any order."""
    from pyspark.sql import functions as F

    from barspan.plans import streams
    from barspan.sources import sinks as K
    from barspan.sources.adapter import MarketTables
    from barspan.streaming import indicators as I
    from barspan.streaming import parse as P

    t = MarketTables(spark, sf_dir)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = f"file://{tmp_path}/messages"
        K.write_in_order(t.messages, path, "offset")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert len(list((tmp_path / "messages").glob("part-*"))) >= 40
    rows = streams._run(t, streams._read_stream(t, path))
    got = rows.groupBy("tag").count().collect()
    live = I.tag_late(P.accepted(P.parse(t.messages)))
    want = live.groupBy(F.when(F.col("is_late"), "late").otherwise("main").alias("tag")).count().collect()
    assert {r.tag: r["count"] for r in got if r.tag != "dead"} == {r.tag: r["count"] for r in want}


def in_any_order(spark, t, folder, files):
    """Messages in so many files whose times and names say nothing about their offsets."""
    import os
    import random

    from pyspark.sql import functions as F

    rows = t.messages.withColumn("_file", F.floor(F.col("offset") * files / (F.lit(t.events.count()) + 1)))
    rows = rows.orderBy("offset").toPandas()
    order = list(range(files))
    random.Random(3).shuffle(order)
    os.makedirs(folder)
    for rank, k in enumerate(order):
        part = rows[rows["_file"] == k].drop(columns="_file")
        path = f"{folder}/part-{rank:03d}.parquet"
        part.astype({"partition": "int32"}).to_parquet(path, index=False)
        os.utime(path, (1_700_000_000, 1_700_000_000))
    return [f"{folder}/part-{i:03d}.parquet" for i in range(files)]


def test_files_in_any_order_with_a_restart_equal_the_batch_twin(spark, sf_dir, tmp_path):
    """40 files in shuffled order, all with one time, half of them before a restart."""
    import os
    import shutil

    from pyspark.sql import functions as F

    from barspan.sources.adapter import MarketTables

    t = MarketTables(spark, sf_dir)
    files = in_any_order(spark, t, str(tmp_path / "all"), 40)
    os.makedirs(tmp_path / "in")
    source, out, checkpoint = f"file://{tmp_path}/in", scratch_dir(spark, "out"), scratch_dir(spark, "chk")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 3).parquet(source)
    for part, close in ((files[:17], False), (files[17:], True)):
        for f in part:
            shutil.copy(f, tmp_path / "in")
        I.run_ordered_job(stream(), out, checkpoint, close=close)
        if not close:
            assert {r.tag for r in I.job_output(spark, out).select("tag").distinct().collect()} <= {"dead"}
    live = I.tag_late(P.accepted(P.parse(t.messages)))
    rows = I.job_output(spark, out).where("tag <> 'dead'").select("offset", "tag")
    want = live.select("offset", F.when(F.col("is_late"), "late").otherwise("main").alias("tag"))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect()))
    twin = {r.offset: r for r in I.indicator_twin(P.accepted(P.parse(t.messages))).collect()}
    got = [json.loads(r.value) for r in I.job_output(spark, out).where("tag = 'main'").collect()]
    assert len(got) == len(twin)
    for g in got:
        r = twin[g["offset"]]
        assert g["window_size"] == r["window_size"]
        for m in I.MEASURES:
            assert (r[m] is None) == (m not in g) and (r[m] is None or abs(float(r[m]) - float(g[m])) < 1e-9)


def test_stated_disorder_releases_early_and_refuses_later_rows(spark, tmp_path):
    rows = [message(i, "000001.SZ", d, close=float(i + 1)) for i, d in enumerate(days(12))]
    source, out, checkpoint = scratch_dir(spark, "src"), scratch_dir(spark, "out"), scratch_dir(spark, "chk")

    def deliver(some):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    far = [message(5000 + i, "000001.SZ", "2024-03-01") for i in range(2)]
    deliver([rows[3], rows[1], rows[0], rows[2]])
    I.run_ordered_job(stream(), out, checkpoint, disorder=900, close=False)
    assert not I.job_output(spark, out).where("tag = 'main'").count()
    deliver(far)
    I.run_ordered_job(stream(), out, checkpoint, disorder=900, close=False)
    got = [json.loads(r.value) for r in I.job_output(spark, out).where("tag = 'main'").collect()]
    assert sorted((g["offset"], g["window_size"]) for g in got) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    deliver(rows[4:5])
    with pytest.raises(ValueError, match="disorder"):
        I.run_ordered_job(stream(), out, checkpoint, disorder=900, close=False)


def test_wide_decimals_and_many_rows_of_a_date_equal_a_plain_loop():
    import random
    from datetime import date, timedelta
    from decimal import ROUND_HALF_UP, Decimal, localcontext

    import pandas as pd

    rnd = random.Random(4)
    day = date(2024, 1, 1)
    rows = []
    for i in range(400):
        day += timedelta(rnd.choice([0, 0, 1, 1, 1, 3]))
        d = day - timedelta(rnd.choice([0, 0, 0, 0, 5]))
        scale = 10 ** rnd.choice([0, 6, 31])
        rows.append((d, 0, i, Decimal(rnd.randrange(-10**6, 10**6) * scale).scaleb(-6), Decimal(rnd.randrange(0, 50))))
    want, points = [], []
    with localcontext() as ctx:
        ctx.prec = 60
        unit = Decimal("0.000001")
        for d, _, i, c, v in rows:
            if points and d < points[-1][0]:
                want.append((i, "late", points[-1][0], None))
                continue
            if points and points[-1][0] == d:
                points.pop()
            points = [*points, (d, c, v)][-20:]
            mean = lambda k, n: (sum(p[k] for p in points[-n:]) / n).quantize(unit, ROUND_HALF_UP) if len(points) >= n else None
            v5 = mean(2, 5)
            ratio = (v / v5).quantize(unit, ROUND_HALF_UP) if v5 else None
            want.append((i, "main", d, (len(points), mean(1, 5), mean(1, 10), mean(1, 20), v5, mean(2, 10), ratio)))
    got, state = [], None
    at = 0
    while at < len(rows):
        to = at + rnd.randrange(1, 60)
        frame, state = I.advance("k", pd.DataFrame(rows[at:to], columns=["trade_date", "partition", "offset", "close", "volume"]), state)
        for r in frame.itertuples(index=False):
            got.append((r.offset, r.tag, r.latest_date, (r.window_size, *[getattr(r, m) for m in I.MEASURES]) if r.tag == "main" else None))
        at = to
    assert sorted(got, key=lambda r: r[0]) == want


def test_counters_over_two_triggers_and_a_restart_equal_the_batch(spark, sf_dir):
    from pyspark.sql import functions as F

    from barspan.sources.adapter import MarketTables

    t = MarketTables(spark, sf_dir)
    source, out, checkpoint = (scratch_dir(spark, n) for n in ("src", "out", "chk"))
    half = t.events.count() // 2
    for part in (t.messages.where(F.col("offset") < half), t.messages.where(F.col("offset") >= half)):
        part.repartition(2).write.mode("append").parquet(source)
        I.run_counters(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), out, checkpoint)
    got = {tuple(r) for r in I.counters(spark, out).collect()}
    decoded = P.decode(t.messages).withColumn("c", F.coalesce(P.consumer_error(), F.lit("success")))
    assert got == {tuple(r) for r in I.outcome_counts(decoded, F.col("c")).collect()}
    assert spark.read.parquet(out).select("batch_id").distinct().count() >= 2
