"""Bars without taken-apart tags, frames summed up once, grouped passes that work out what is asked, trials ranked once."""

import datetime as dt

import numpy as np
import pytest

from barspan.operators import learning as L
from barspan.operators import quality as Q
from barspan.operators import sequence as S
from barspan.operators import technical as W
from barspan.sources.adapter import MarketTables

BAR = "ts_code string, trade_date date, open double, high double, low double, close double, vol double, amount double"
LINE = "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp, l_discount double, l_tax double, l_returnflag string, l_linestatus string"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lines"))
    day = dt.datetime(2024, 1, 3)
    rows = [
        (7, 1, 1, 1.0, 3.0, day), (7, 1, 1, 1.0, 2.0, day), (9, 2, 1, 1.0, 5.0, day), (9, 2, 1, 1.0, 6.0, day), (8, 1, 1, 1.0, 9.0, day),
        (None, 1, 1, 1.0, 1.0, day), (1, 1, 1, None, 8.0, day), (1, 1, 2, None, 8.0, day), (1, 1, None, 2.0, 8.0, day), (2, 1, 2, 2.0, 8.0, None),
    ]
    spark.createDataFrame([(*r, 0.0, 0.0, "A", "F") for r in rows], LINE).write.parquet(f"{root}/lineitem.parquet")
    return MarketTables(spark, root)


def test_prices_of_repeated_and_null_keys(lines):
    got = {(r.ts_code, r.trade_date): (r.open, r.high, r.low, r.close) for r in lines.bars.collect()}
    code, day = "007919.SZ", dt.date(2024, 1, 3)
    assert got[(code, day)] == (2.0, 9.0, 1.0, 6.0)  # of one tag's lines the least price opens, the greatest closes; a line without a key has no place
    assert got[("015838.SZ", day)] == (None, None, None, None)
    assert got[("015838.SZ", None)] == (4.0,) * 4 and got[(None, day)] == (4.0,) * 4


def test_bars_take_no_tag_apart(lines):
    assert "% 1000000000000" not in _plan(lines.bars) and "% 1000000000000" not in _plan(lines.bars_where("l_linenumber = 1"))


def _panel(spark, n=90, gap=None):
    rng = np.random.default_rng(3)
    rows = []
    for code in ("000001.SZ", "000002.SZ"):
        for i in range(n):
            c = 5.0 if 20 <= i < 35 else float(rng.integers(400, 600)) / 100
            rows.append((code, dt.date(2024, 1, 1) + dt.timedelta(i), c, c + 0.1, c - 0.1, None if i == gap else c, float(rng.integers(1, 50)), 100.0))
    return spark.createDataFrame(rows, BAR)


def test_bollinger_frames_are_summed_once(spark):
    df = _panel(spark)
    plan = _plan(df.withColumns(W._bands()).select(*W.bollinger().values()))
    assert plan.count("stddev_pop(") <= 1 and plan.count("avg(") <= 1


def test_base_features_share_their_frames(spark):
    assert _plan(W.closed_features(_panel(spark))).count("stddev_pop(") <= 1


def test_grouped_pass_works_out_what_is_asked(spark, monkeypatch):
    df = _panel(spark)
    every = {(r.ts_code, r.trade_date): r for r in W.grouped_features(df).collect()}
    for names, prices in ((["rsi"], ["close"]), (["ema5", "ema120"], ["close"]), (["macd_hist"], ["close"]), (["kdj_j"], ["high", "low", "close"]), (["cci88"], ["high", "low", "close"]), (["kurtosis_20d"], ["close"])):
        out = W.grouped_features(df.select(*S.KEY, *prices), names=names)
        assert out.columns == [*S.KEY, *prices, *names]
        for r in out.collect():
            assert [r[n] for n in names] == [every[(r.ts_code, r.trade_date)][n] for n in names]

    def never(*_):
        raise AssertionError("not asked for")

    monkeypatch.setattr(W, "moment_values", never)
    monkeypatch.setattr(W, "cci_values", never)
    import pyarrow as pa

    rows = pa.table({"trade_date": [1, 2, 3], "close": [1.0, 2.0, 3.0]})
    assert W._grouped_columns("library", ["ema5"])(rows).column_names == ["trade_date", "close", "ema5"]


@pytest.mark.parametrize("gap", [None, 40])
def test_families_equal_a_loop_over_windows(spark, gap):
    df, w = _panel(spark, gap=gap), 10
    got = S.features_158(df, (S.trend_family, S.order_family, S.flow_family), (5, w)).where("ts_code = '000002.SZ'").orderBy("trade_date").toPandas()
    c, v = got.close.to_numpy(), got.vol.to_numpy()
    for i in range(len(c)):
        if i < w - 1 or np.isnan(c[i]):
            assert got[f"MA{w}"][i] == got[f"STD{w}"][i] == 0
            continue
        rows = c[i - w + 1 : i + 1]
        known = rows[~np.isnan(rows)]
        near = lambda name, value: np.testing.assert_allclose(got[f"{name}{w}"][i], value, rtol=1e-9, atol=1e-9)  # noqa: B023, E731
        near("MA", known.mean() / c[i])
        near("STD", known.std() / c[i])
        near("RANK", ((known < c[i]).sum() + ((known == c[i]).sum() + 1) / 2) / w)
        near("VMA", v[i - w + 1 : i + 1].mean() / v[i])
        logs = np.log(v[i - w + 1 : i + 1] + 1)[~np.isnan(rows)]
        if len(known) == w:
            slope = np.polyfit(np.arange(w), rows, 1)[0] if known.std() else 0.0
            near("BETA", slope / c[i])
            near("QTLU", np.quantile(rows, 0.8) / c[i])
            near("CORR", np.corrcoef(rows, logs)[0, 1] if known.std() else 0.0)
            near("RSQR", np.corrcoef(rows, np.arange(w))[0, 1] ** 2 if known.std() else 0.0)
        if i >= w and not np.isnan(c[i - w : i + 1]).any():
            step = np.diff(c[i - w : i + 1])
            near("SUMP", step[step > 0].sum() / max(np.abs(step).sum(), 1e-12))
        elif i == w - 1:
            assert got[f"SUMP{w}"][i] == got[f"WVMA{w}"][i] == 0


def test_families_leave_no_long_frames_to_the_window_operator(spark):
    plan = _plan(S.features_158(_panel(spark), (S.trend_family, S.order_family, S.flow_family)))
    assert "specifiedwindowframe(RowFrame, -59" not in plan and "collect_list" not in plan


def test_trials_equal_one_ranking_each(spark):
    rng = np.random.default_rng(5)
    rows = [(f"c{i}", dt.date(2024, 1, 1 + d), float(rng.integers(5)), float(rng.normal()), 1.0, float(rng.integers(4)) if i else None) for d in range(6) for i in range(12)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date date, a double, b double, flat double, label double")
    got = {r.name: r for r in L.trial_metrics(df, ["a", "b", "flat"]).collect()}
    for name in ("a", "b", "flat"):
        want = L.ranking_metrics(df, name).first()
        assert (got[name].defined_dates, got[name].total_dates) == (want.defined_dates, want.total_dates)
        assert got[name].mean_daily_rank_ic == pytest.approx(want.mean_daily_rank_ic) if want.defined_dates else got[name].mean_daily_rank_ic is None


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grid_takes_its_facts_along_without_being_shuffled(spark):
    """Facts outside the calendar or the life, none at all, off sessions, and a member listed twice."""
    day = lambda n: dt.date(2024, 1, n)
    sessions = Q.session_ordinals(spark.createDataFrame([(day(n), int(n not in (6, 7))) for n in range(1, 13)], "cal_date date, is_open int"))
    lives = [("a", day(2), None), ("b", dt.date(2020, 1, 1), day(9)), ("c", day(3), None), ("d", day(30), None), ("e", day(4), None), ("e", day(10), None)]
    master = spark.createDataFrame(lives, "ts_code string, list_date date, delist_date date")
    left = [("a", day(1), 1), ("a", day(4), 2), ("a", day(6), 3), ("a", day(8), 4), ("b", day(2), 5), ("b", day(11), 6), ("e", day(10), 7), (None, day(3), 8), ("a", None, 9)]
    right = [("a", day(4), True), ("a", day(12), True), ("e", day(5), True), ("x", day(5), True)]
    one, two = spark.createDataFrame(left, "ts_code string, trade_date date, v int"), spark.createDataFrame(right, "ts_code string, trade_date date, h boolean")
    got = Q.filled_grid(master, sessions, Q.keyed_facts(one, two))
    want = Q.lifetime_grid(master, sessions).join(one, Q.KEY, "left").join(two, Q.KEY, "left")
    row = ["ts_code", "trade_date", "v", "h"]
    assert sorted(map(str, got.select(*row).collect())) == sorted(map(str, want.select(*row).collect()))
    assert "hashpartitioning(ts_code" in _plan(got) and "trade_date#" not in "".join(x for x in _plan(got).splitlines() if "Exchange hashpartitioning" in x)


def test_grid_queries_do_not_shuffle_their_grid(spark, sf_dir):
    """Below the step that unfolds the days there are exchanges, above it there are none by code and day."""
    from barspan.plans.registry import load_all

    queries, _ = load_all()
    for name in ("j12_expected_key_grid", "q6_missing_inventory"):
        above = _plan(queries[name](spark, sf_dir)).split("Generate explode(sequence(_from")[0]
        assert "Exchange hashpartitioning" not in above, name


def test_purged_split_plans_its_samples_twice(spark, sf_dir):
    from barspan.sources.adapter import MarketTables

    t = MarketTables(spark, sf_dir)
    samples = t.raw("lineitem").selectExpr("cast(l_shipdate as date) trade_date", "cast(l_shipdate as date) + 5 label_target_date", "l_tax label")
    assert _plan(L.purged_split(samples)).count("FileScan") == 2


def test_missing_inventory_adds_up_the_lines_once(spark, sf_dir):
    """Calendar, halts and grid take different columns of the facts: they are written once."""
    from barspan.plans.registry import load_all

    assert "l_tax" not in _plan(load_all()[0]["q6_missing_inventory"](spark, sf_dir))


def test_frozen_scores_read_their_samples_from_one_written_copy(spark, sf_dir):
    from barspan.plans.registry import load_all

    assert "l_shipdate" not in _plan(load_all()[0]["m12_frozen_model_scores"](spark, sf_dir))
