"""Literal expected values on tiny frames."""

from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspan.operators import backtest as B
from barspan.operators import clean as C
from barspan.operators import market as M
from barspan.operators import quality as Q
from barspan.operators import sequence as S
from barspan.operators import technical as W
from barspan.streaming import indicators as I


def days(n, start="2024-01-01"):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def bars(spark, rows):
    return spark.createDataFrame(rows, "ts_code string, trade_date date, open double, high double, low double, close double, vol double, amount double")


def test_moving_average_and_warm_up(spark):
    rows = [("000001.SZ", d, 1.0, 1.0, 1.0, float(i + 1), 10.0, 1.0) for i, d in enumerate(days(30))]
    out = bars(spark, rows).withColumns(W.moving_averages((5, 20))).orderBy("trade_date").collect()
    assert [r["ma5"] for r in out[:5]] == [None] * 4 + [3.0]
    assert all(r["ma20"] is None for r in out[:19]) and out[19]["ma20"] == 10.5


def test_null_prefixes_of_recurrences(spark):
    rows = [("000001.SZ", d, 10.0, 11.0 + i % 3, 9.0, 10 + (i % 7) * 0.3, 10.0, 1.0) for i, d in enumerate(days(60))]
    out = W.grouped_features(bars(spark, rows)).orderBy("trade_date").toPandas()
    for name, nulls in {"ema5": 4, "ema26": 25, "macd_dif": 33, "macd_dea": 33, "rsi": 14, "kdj_k": 8, "mass": 0}.items():
        assert out[name].isna().sum() == nulls, name


def test_moments_match_pandas(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    ret = rng.normal(0, 0.02, 200)
    for dialect, n in (("library", 20), ("library", 60)):
        skew, kurt = W.moment_values(ret, n, dialect)
        np.testing.assert_allclose(skew[n - 1 :], pd.Series(ret).rolling(n).skew().to_numpy()[n - 1 :], rtol=1e-8, atol=1e-10)
        np.testing.assert_allclose(kurt[n - 1 :], pd.Series(ret).rolling(n).kurt().to_numpy()[n - 1 :], rtol=1e-7, atol=1e-9)
    skew, kurt = W.moment_values(np.ones(30), 20, "library")
    assert skew[-1] == 0 and kurt[-1] == -3


def test_adjusted_prices(spark):
    price, factor = [10, 10, 5, 5] * 3, [1.0, 1.0, 2.0, 2.0] * 3
    factor = [1.0, 1.0] + [2.0] * 10
    price = [10.0, 10.0] + [5.0] * 10
    d = days(12, "2024-01-02")
    df = bars(spark, [("000001.SZ", x, p, p, p, p, 100.0, p * 10) for x, p in zip(d, price)])
    f = spark.createDataFrame([("000001.SZ", x, y) for x, y in zip(d, factor)], "ts_code string, trade_date date, adj_factor double")
    out = B.adjust_prices(df, f).collect()
    assert all(r["open"] == 10 and r["vwap"] == 10 and r["vol"] == 100 for r in out)
    shorter = B.adjust_prices(df, f.where(F.col("trade_date") < d[6])).where("factor_status = 'OK'")  # later factors change nothing before them
    assert {r["trade_date"]: r["open"] for r in shorter.collect()}.items() <= {r["trade_date"]: r["open"] for r in out}.items()


def ledger(spark, n, change=None, signals=None, fee=0.0, slip=0.0, scale=1.0):
    d = days(n, "2026-06-25")
    price = {i: 12.0 if change is not None and i >= change else 10.0 for i in range(n)}
    rows = [(c, d[i], price[i], price[i]) for c in "ABCDEF" for i in range(n)]
    p = spark.createDataFrame(rows, "ts_code string, trade_date date, open double, close double")
    s = spark.createDataFrame([(c, x, float(6 - k) * scale) for k, c in enumerate("ABCDEF") for x in d], "ts_code string, trade_date date, score double")
    sessions = B.panel_sessions(p)
    plan = B.rebalance_schedule(sessions, 0, 4)
    if signals is not None:
        plan = plan.where(F.col("cycle") <= signals)
    scenario = [("x", fee * 1e4, fee * 1e4, slip * 1e4)]
    return B.cycle_account(p, sessions, B.equal_picks(s, plan, 5), plan, 1000.0, scenario), plan


def final(equity):
    return equity.orderBy(F.desc("trade_date")).first()["equity"]


def test_portfolio_ledgers(spark):
    (equity, _), _ = ledger(spark, 10, change=5, signals=0)
    assert final(equity) == pytest.approx(1200)
    (scaled, _), _ = ledger(spark, 10, change=5, signals=0, scale=10_000)
    assert final(scaled) == pytest.approx(1200)
    (equity, _), plan = ledger(spark, 15, signals=2)
    cycles = [tuple(r) for r in plan.orderBy("cycle").select("entry_ordinal", "exit_ordinal").collect()]
    assert cycles == [(1, 5), (5, 9), (9, 13)]
    (equity, _), _ = ledger(spark, 10, signals=0, fee=0.01)
    assert final(equity) == pytest.approx(1000 / 1.01 * 0.99)
    (equity, cyc), _ = ledger(spark, 10, signals=0, slip=0.01)
    assert final(equity) == pytest.approx(1000 / 1.01 * 0.99)
    assert B.cost_totals(cyc).first()["total_slippage"] > 0
    (equity, _), _ = ledger(spark, 12, signals=1, fee=0.01)
    assert final(equity) == pytest.approx(1000 * (0.99 / 1.01) ** 2)


def test_weighted_account(spark):
    d = days(12, "2025-01-02")
    p = spark.createDataFrame(
        [(c, x, 10.0 if i < 6 else 20.0, 10.0 if i < 6 else 20.0) for c in "AB" for i, x in enumerate(d)], "ts_code string, trade_date date, open double, close double"
    )
    sessions = B.panel_sessions(p)
    plan = B.rebalance_schedule(sessions, 0, 5, 1, None)
    s = p.select("ts_code", "trade_date", F.lit(1.0).alias("score"))
    equity, cyc = B.cycle_account(p, sessions, B.score_weighted_picks(s, plan, 1), plan, 1000.0, [("x", 1000.0, 1000.0, 0.0)])
    start = {r["cycle"]: r["start_cash"] for r in cyc.collect()}
    assert start[1] == pytest.approx(1000 / 1.1 * 2 * 0.9)
    after = {r["trade_date"]: r["equity"] for r in equity.collect()}
    assert after[d[6]] == pytest.approx(1000 / 1.1 * 2 * 0.9 / 1.1)


def test_score_heads(spark):
    rows = [(date(2024, 1, 2), c, *v) for c, v in zip("ABC", [(-3.0, 0.0, 1.0, 0.0), (-2.0, 1.0, 0.0, 1.0), (-1.0, 0.5, 0.5, 0.5)])]
    df = spark.createDataFrame(rows, "trade_date date, ts_code string, ranking double, regression double, classification double, direction double")
    out = M.adjust_scores(df, "nonnegative_variance").orderBy("ts_code").collect()
    assert [r["score"] for r in out] == pytest.approx([0, 7 / 18, 1])
    assert [r["uncertainty"] for r in out] == pytest.approx([2 / 9, 2 / 9, 0])
    flat = M.adjust_scores(df.withColumn("ranking", F.lit(1.0)), "nonnegative_variance")
    assert all(r["score"] == 0 for r in flat.collect())


def test_sequence_windows(spark):
    d = days(100)
    rows = [(f"c{k}", x, float(i), None if i in (70, 99) else (k + 1) / 100) for k in range(10) for i, x in enumerate(d)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date date, f double, label double")
    out = S.sequence_windows(df, ["f"], 60)
    full = S.sequence_windows(df.withColumn("label", F.lit(0.5)), ["f"], 60)
    assert full.select("trade_date").distinct().count() == 41
    assert full.agg(F.min(F.col("window")[59][0]), F.max(F.col("window")[59][0])).first() == (59.0, 99.0)
    assert out.select("trade_date").distinct().count() == 39
    assert out.where(F.col("trade_date") == d[71]).first()["window"][58][0] == 70.0  # an unlabelled day stays as context


def test_indicator_values(spark):
    d = days(21)
    df = spark.createDataFrame([("000001.SZ", x, float(i + 1), 10.0 * (i + 1)) for i, x in enumerate(d)], "ts_code string, trade_date date, close double, volume double")
    out = I.indicator_values(df).orderBy("trade_date").collect()

    def row(i):
        r = out[i - 1]
        return [None if r[m] is None else str(r[m]) for m in I.MEASURES] + [r["window_size"], r["is_warmup"]]

    assert row(1) == [None] * 6 + [1, True]
    assert row(5) == ["3.000000", None, None, "30.000000", None, "1.666667", 5, True]
    assert row(10) == ["8.000000", "5.500000", None, "80.000000", "55.000000", "1.250000", 10, True]
    assert row(20) == ["18.000000", "15.500000", "10.500000", "180.000000", "155.000000", "1.111111", 20, False]
    assert row(21)[2] == "11.500000" and row(21)[6] == 20
    half = spark.sql("SELECT '1.2345675' AS x").select(F.col("x").cast("decimal(38,10)").cast("decimal(38,6)").alias("y")).first()["y"]
    assert str(half) == "1.234568"


def test_weekly_resample(spark):
    rows = [(date(2026, 10, 5) + timedelta(k), o, h, low, c, 100.0 + k, 1000.0 + 10 * k) for k, (o, h, low, c) in enumerate([(10, 11, 9.5, 10.5), (10.5, 12.5, 10, 11), (11, 12, 10.8, 11.6)])]
    rows.append((date(2026, 10, 12), 11.6, 13.0, 11.0, 12.0, 100.0, 1000.0))
    df = bars(spark, [("000001.SZ", d, float(o), float(h), float(low), float(c), v, a) for d, o, h, low, c, v, a in rows])
    first, second = M.resample(df, "week").orderBy("period_start").collect()
    assert (first["period_start"], first["open"], first["close"], first["high"], first["low"]) == (date(2026, 10, 5), 10, 11.6, 12.5, 9.5)
    assert first["pre_close"] == first["open"] and second["pre_close"] == 11.6
    edge = spark.createDataFrame([(date(2026, 1, 1),), (date(2026, 10, 11),)], "d date").select(F.date_trunc("week", "d").cast("date").alias("w"))
    assert [r["w"] for r in edge.collect()] == [date(2025, 12, 29), date(2026, 10, 5)]


def plan_for(spark, missing, codes=("600000.SH", "600001.SH"), start=date(2026, 9, 21), n=14):
    cal = [(start + timedelta(i), int((start + timedelta(i)).weekday() < 5)) for i in range(n)]
    sessions = Q.session_ordinals(spark.createDataFrame(cal, "cal_date date, is_open int"))
    master = spark.createDataFrame([(c, date(2020, 1, 1), None) for c in codes], "ts_code string, list_date date, delist_date date")
    stored = [(c, d) for c in codes for d, o in cal if o and (c, d) not in missing]
    grid = Q.lifetime_grid(master, sessions)
    out = Q.gap_plan(grid, spark.createDataFrame(stored, "ts_code string, trade_date date"), sessions)
    return sorted((r["mode"], r["ts_code"], r["start_date"], r["end_date"]) for r in out.collect())


def test_gap_plan(spark):
    a = "600000.SH"
    d25, d28, d29 = date(2026, 9, 25), date(2026, 9, 28), date(2026, 9, 29)
    assert plan_for(spark, set()) == []
    assert plan_for(spark, {(a, d25), (a, d28), (a, d29)}) == [("stock_range", a, d25, d29)]  # one run across the weekend
    assert plan_for(spark, {(a, d25), (a, d29)}) == [("stock_range", a, d25, d25), ("stock_range", a, d29, d29)]
    whole = plan_for(spark, {(c, d28) for c in (a, "600001.SH")})
    assert whole == [("full_date", None, d28, d28)]
    year = {(a, date(2026, 12, 31)), (a, date(2027, 1, 1))}
    assert len(plan_for(spark, year, start=date(2026, 12, 28))) == 2


def test_clean_order_nulls_before_dedupe(spark):
    cols = "ts_code string, date string, open string, high string, low string, close string, vol string, ingest_seq int"
    rows = [
        ("000001.SZ", "20240102", "1", "2", "1", "1.5", "10", 1),
        ("000001.SZ", "20240102", "1", "2", "1", None, "10", 2),  # null leaves first, so row 1 survives
        ("000001.SZ", "2024-01-03", "1", "2", "1", "1.5", "-1", 3),
        ("1.SZ", "20240102", "1", "2", "1", "1.5", "10", 4),
        ("000001.SZ", "20240104", "3", "2", "1", "1.5", "10", 5),
    ]
    df = spark.createDataFrame(rows, cols)
    assert [r["close"] for r in C.clean_bars(df).collect()] == [1.5]
    report = C.clean_report(df).first().asDict()
    assert report == dict(input_rows=5, bad_code_rows=1, bad_date_rows=0, null_rows=1, duplicate_rows=0, price_anomaly_rows=1, volume_anomaly_rows=1, output_rows=1)


def test_student_tail():
    p = M._student_tail(pd.Series([0.0, 2.0, 12.706, 1.96]), pd.Series([5.0, 10.0, 1.0, 1e6]))
    assert p.tolist() == pytest.approx([1.0, 0.07338803, 0.05, 0.05], abs=2e-5)


def test_overlaps_against_brute_force(spark):
    import random

    rng = random.Random(1)
    base = date(2024, 1, 1)

    def make(n, longest):
        out = []
        for i in range(n):
            a = base + timedelta(rng.randint(0, 200))
            out.append((i, a, a + timedelta(rng.randint(0, longest))))
        return out

    left, right = make(60, 90), make(40, 5)
    l = spark.createDataFrame(left, "l int, left_start date, left_end date")
    r = spark.createDataFrame(right, "r int, right_start date, right_end date")
    got = sorted(map(tuple, Q.overlaps(l, r, 7).select("l", "r").collect()))
    want = sorted((a[0], b[0]) for a in left for b in right if a[1] <= b[2] and a[2] >= b[1])
    assert got == want


def test_scalar_functions(spark):
    from barspan.functions import scalars as X

    codes = [("600000",), ("000001",), ("920001",), ("430001",), (" 300750.sz ",)]
    df = spark.createDataFrame(codes, "c string")
    assert [r[0] for r in df.select(X.normalize_code("c")).collect()] == ["600000.SH", "000001.SZ", "920001.BJ", "430001.BJ", "300750.SZ"]
    assert df.where("c = '920001'").select(X.normalize_code("c", bj_920=False)).first()[0] == "920001.SH"
    idx = spark.createDataFrame([("399001",), ("000300",)], "c string").select(X.index_code("c")).collect()
    assert [r[0] for r in idx] == ["399001.SZ", "000300.SH"]
    days_ = spark.createDataFrame([("20240229",), ("2024-02-29",), ("20240230",), ("x",)], "d string").select(X.session_day("d")).collect()
    assert [r[0] for r in days_] == [date(2024, 2, 29), date(2024, 2, 29), None, None]
    done = spark.sql("SELECT DATE '2024-01-02' AS d, TIMESTAMP '2024-01-02 08:00:00' AS a, TIMESTAMP '2024-01-02 08:00:01' AS b")
    assert tuple(done.select(X.session_completed("d", "a"), X.session_completed("d", "b")).first()) == (False, True)
    image = spark.sql("SELECT 1e17D + 1D AS x, 0.1D AS y").select(X.float32_image("x"), X.float32_image("y", 9)).first()
    assert str(image[0]) == "99999998430674944.000000" and str(image[1]) == "0.100000001"


def test_fingerprint_ignores_order_but_sees_copies(spark):
    from barspan.sources.sinks import fingerprint

    rows = [("A", d, 1.0) for d in days(5)]
    schema = "ts_code string, trade_date date, v double"
    cols = ["ts_code", "trade_date", "v"]
    a = fingerprint(spark.createDataFrame(rows, schema), [], cols).first()
    b = fingerprint(spark.createDataFrame(rows[::-1], schema).repartition(3), [], cols).first()
    c = fingerprint(spark.createDataFrame(rows + rows[:1] * 2, schema), [], cols).first()
    assert a == b and a["digest"] != c["digest"]


def test_feature_store_publish_rollback_and_refusal(spark):
    from barspan.session import scratch_dir
    from barspan.sources.sinks import FeatureStore

    store = FeatureStore(spark, scratch_dir(spark, "store"))
    one = spark.createDataFrame([("A", date(2024, 1, 2), 1.0)], "ts_code string, trade_date date, v double")
    two = one.withColumn("v", F.lit(2.0))
    for name, df in (("b1", one), ("b2", two)):
        store.write(df, name)
        store.publish(df, name)
    assert store.read(one.schema)[0].first()["v"] == 2.0
    assert store.rollback() == "b1" and store.read(one.schema)[0].first()["v"] == 1.0
    store.write(one, "b3")
    with pytest.raises(ValueError, match="failed verification"):
        store.publish(two, "b3")
    _, missing = store.read(one.schema, one.withColumn("ts_code", F.lit("B")))
    assert missing.count() == 1


def test_codes_of_any_key_are_unique_and_valid(spark):
    from barspan.functions.scalars import CODE_PATTERN
    from barspan.sources.adapter import code_of

    keys = [0, 1, 999_999, 1_000_000, 1_000_001, 1_999_999, 10**9, 10**9 + 7, 10**15 + 3, 9 * 10**18]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(code_of("k")).collect()]
    assert len(set(got)) == len(keys)
    df = spark.createDataFrame([(c,) for c in got], "c string")
    assert df.where(F.col("c").rlike(CODE_PATTERN)).count() == len(keys)


def test_clean_keeps_instruments_beyond_a_million(spark):
    from barspan.operators import clean as C
    from barspan.sources.adapter import code_of

    keys = spark.createDataFrame([(k,) for k in (5, 999_999, 1_000_000, 10**9)], "k long")
    feed = keys.select(
        code_of("k").alias("ts_code"), F.lit("20240102").alias("date"), *[F.lit("10").alias(c) for c in ("open", "high", "low", "close", "vol")],
        F.lit(1).cast("decimal(38,0)").alias("ingest_seq"),
    )
    assert C.clean_bars(feed).count() == 4


def test_merges_collapse_repeated_incoming_keys(spark):
    from barspan.operators import tables as P

    old = spark.createDataFrame([("a", 1, 1.0)], "ts_code string, trade_date int, close double")
    new = spark.createDataFrame([("a", 1, 2.0, 1), ("b", 1, 3.0, 1), ("b", 1, 4.0, 2)], "ts_code string, trade_date int, close double, seq int")
    assert sorted(map(tuple, P.insert_ignore(old, new, ["seq"]).collect())) == [("a", 1, 1.0), ("b", 1, 3.0)]
    assert sorted(map(tuple, P.upsert(old, new, ["seq"]).collect())) == [("a", 1, 2.0), ("b", 1, 4.0)]


def test_activation_log_survives_and_refuses_a_taken_step(spark, tmp_path):
    import pytest

    from barspan.sources.sinks import FeatureStore

    store = FeatureStore(spark, f"file://{tmp_path}", ["k"])
    store._activate("one")
    store._activate("two")
    assert store.active() == "two" and store.activations().count() == 2
    store.activations = lambda: spark.createDataFrame([(1, "one")], "step long, build_id string")  # a stale read
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        store._activate("three")


def test_search_lists_the_pool_for_an_empty_query_and_takes_any_number_of_queries(spark):
    from barspan.operators.search import search

    master = spark.createDataFrame(
        [(f"{i:06d}.SZ", f"Firm{i}", "Steel", "North") for i in range(60)], "ts_code string, name string, industry string, region string"
    )
    queries = spark.createDataFrame([(i, "firm7") for i in range(10_050)] + [(-1, "  "), (-2, None), (-3, "stel north")], "query_id long, text string")
    got = search(master, queries)
    assert got.where("query_id = 10049 AND position = 1").first().ts_code == "000007.SZ"
    assert got.where("query_id IN (-1, -2)").count() == 100
    assert got.where("query_id = -3").count() == 50
    assert got.select("query_id").distinct().count() == 10_053


def test_attribution_from_separate_tables_equals_the_single_pass(spark, sf_dir):
    from barspan.plans.quality import _NEW, _OLD
    from barspan.sources.adapter import MarketTables

    t = MarketTables(spark, sf_dir)
    sessions = Q.session_ordinals(t.calendar)
    apart = Q.attribute_sources(
        t.master, sessions, t.bars_where(_OLD), t.bars_where(_NEW), t.valuation, t.factors, t.suspensions, ["close", "vol"]
    )
    once = Q.attribute_facts(t.master, sessions, t.source_facts, t.halts_of(t.source_facts))
    assert apart.exceptAll(once).count() == 0 and once.exceptAll(apart).count() == 0
