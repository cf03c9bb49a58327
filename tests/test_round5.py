"""Ranks without a sorting aggregate, noise probes without written noise, and arrivals held together."""

from datetime import date, timedelta
from decimal import Decimal
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

DAY = date(2024, 1, 1)


def test_places_of_the_tasks_are_hashed_not_sorted(spark, monkeypatch):
    from barspan.functions import ranks as R

    plans, write = {}, R.cut_lineage

    def record(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(R, "cut_lineage", record)
    rows = [(i % 3, v) for i, v in enumerate([1.0, 2.0, 2.0, None, 2.0, float("nan"), -1.0, 2.0, 2.0, 0.0, 2.0, 5.0] * 20)]
    got = R.positioned(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", partitions=7).where("v IS NOT NULL").collect()
    assert "SortAggregate" not in plans["tasks"] and "HashAggregate" in plans["tasks"]
    key = lambda v: (v != v, v if v == v else 0.0)  # noqa: E731 - NaN stands last
    for r in got:
        group = [key(v) for g, v in rows if g == r.g and v is not None]
        assert (r.less, r.ties, r.n) == (sum(x < key(r.v) for x in group), group.count(key(r.v)), len(group))


def test_probe_passes_write_no_noise_and_deal_large_inputs_evenly(spark, monkeypatch):
    from barspan.operators import models as D

    written, dealt, write, deal = {}, [], D.cut_lineage, D.dealt_evenly

    def record(df, name):
        written[name] = df.columns
        return write(df, name)

    def record_deal(df, key, rows):
        out = deal(df, key, rows)
        dealt.append((out.rdd.getNumPartitions(), out.count() == df.count()))
        return out

    monkeypatch.setattr(D, "cut_lineage", record)
    monkeypatch.setattr(D, "dealt_evenly", record_deal)
    monkeypatch.setattr(D, "ROWS_PER_TASK", 50)
    rows = [(f"{c:06d}.SZ", DAY + timedelta(d), (c * 7 + d) % 11 / 11 - 0.5, (c + d * 3) % 5 / 5.0, d) for c in range(20) for d in range(40)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date date, a double, b double, d int")
    df = df.withColumns({"label": F.col("a") * 2 + F.col("b") / 100, "label_target_date": F.date_add("trade_date", 2), "unused": F.lit("x")}).drop("d")
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = {r.feature: r for r in D.probe_selection(df, ["a", "b"], noise=2, passes=1).collect()}
    assert written["probe"] == ["ts_code", "trade_date", "a", "b", *D.PROBE_TASKS] and set(written) == {"probe"}
    assert dealt == [(34 * 20 // 50 + 1, True)]
    assert set(got) == {"a", "b"} and got["a"].removed_in is None and got["a"].best > got["b"].best
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached


def test_walk_forward_query_writes_its_samples_once_without_other_columns(spark, sf_dir, monkeypatch):
    from barspan.operators import models as D
    from barspan.plans import learning as PL
    from barspan.plans.registry import load_all

    written, seen, write = [], [], PL.cut_lineage
    monkeypatch.setattr(PL, "cut_lineage", lambda df, name: written.append(name) or write(df, name))
    monkeypatch.setattr(D, "walk_forward", lambda samples, features, folds: seen.append(samples.columns) or samples.limit(0))
    load_all()[0]["m8_walk_forward_models"](spark, sf_dir)
    assert written == ["samples"] and "amount" not in seen[0]


class Handle:
    """The state of one key in plain lists."""

    def __init__(self):
        self.value, self.entries, self.timers = None, [], []

    def getValueState(self, name, schema):
        return SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value, update=lambda v: setattr(self, "value", v))

    def getListState(self, name, schema):
        return SimpleNamespace(
            appendValue=self.entries.append, appendList=self.entries.extend, get=lambda: iter(self.entries),
            put=lambda v: setattr(self, "entries", list(v)), clear=lambda: setattr(self, "entries", []),
        )

    def listTimers(self):
        return iter(list(self.timers))

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_rows_that_came_together_are_held_as_one_entry():
    from barspan.streaming import indicators as I

    values = [Decimal("0.000001"), Decimal("-12345678901234567890123456789012.500000"), Decimal("7.000000")]
    rows = [(DAY + timedelta(i // 2 - (3 if i % 7 == 6 else 0)), i % 2, 1000 * i, values[i % 3], Decimal(i % 4)) for i in range(60)]
    frame = lambda some: pd.DataFrame(some, columns=["trade_date", "partition", "offset", "close", "volume"])
    handle, window = Handle(), I.IndicatorWindow(True)
    window.init(handle)
    for part in (rows[40:], rows[:20][::-1], rows[20:40]):
        assert list(window.handleInputRows(("k",), iter([frame(part)]), None)) == []
    assert len(handle.entries) == 3 and handle.timers == [2]
    early = SimpleNamespace(getCurrentWatermarkInMs=lambda: 31)  # offsets up to 30,000
    handle.timers.clear()
    first = list(window.handleExpiredTimer(("k",), early, None))
    late = SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**6)
    assert len(handle.entries) == 1 and handle.timers == [33]
    second = list(window.handleExpiredTimer(("k",), late, None))
    assert not handle.entries
    state, want = None, []
    for part in (rows[:31], rows[31:]):
        out, state = I.advance("k", frame(sorted(part, key=lambda r: r[1:3])), state)
        want.append(out)
    got, want = pd.concat([*first, *second]), pd.concat(want)
    assert got.columns.tolist() == I.OUTPUT.names and len(got) == 60
    for name in I.OUTPUT.names:
        assert [None if pd.isna(v) else v for v in got[name]] == [None if pd.isna(v) else v for v in want[name]], name
    assert handle.value == state
