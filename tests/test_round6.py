from datetime import date, datetime, timedelta
from itertools import groupby

from pyspark.sql import functions as F

from barspan.operators import models as D
from barspan.operators import quality as Q
from barspan.operators import technical as W
from barspan.operators.tables import daily_panel
from barspan.plans.registry import load_all
from barspan.sources.adapter import MarketTables


def test_request_lists_write_words_of_days_and_not_keys(spark, monkeypatch):
    """Null days and methods, repeated keys, days before 1970, tiny tasks; a word holds up to 64 days of a code and method."""
    from barspan.functions import ranks

    written = []

    def record(write):
        def cut(df, name):
            out = write(df, name)
            written.append(out.count())
            return out

        return cut

    for module in (Q, ranks):
        monkeypatch.setattr(module, "cut_lineage", record(module.cut_lineage), raising=False) if hasattr(module, "cut_lineage") else None
    for name, rows in (("WORDS_PER_TASK", 30), ("WORDS_AT_ONCE", 7)):
        monkeypatch.setattr(Q, name, rows, raising=False)
    codes = [f"{k * 7919 % 1000:03d}.S" for k in range(37)]
    rows = [(m, c, date(1969, 11, 20) + timedelta(days=3 * d)) for i, c in enumerate(codes) for m in ("daily", "adj") for d in range(80) if (i * 31 + d * 17 + len(m)) % 5]
    rows += [("daily", "A", None), ("daily", "A", None), ("daily", "B", None), (None, "B", date(1970, 1, 1)), ("adj", None, date(1970, 1, 1)), *rows[:50]]
    got = Q.request_lists(spark.createDataFrame(rows, "method string, ts_code string, trade_date date").repartition(5), capacity=7)
    got = {(r.trade_date, r.method, r.chunk): (r.codes, r.code_list) for r in got.collect()}
    want, key = {}, lambda r: (str(r[2]), str(r[0]))
    for _, same in groupby(sorted({r for r in rows if r[1] is not None}, key=lambda r: (*key(r), r[1])), key):
        same = list(same)
        for k in range(0, len(same), 7):
            want[same[0][2], same[0][0], k // 7] = (len(same[k : k + 7]), ",".join(r[1] for r in same[k : k + 7]))
    assert got == want
    assert max(written) <= len(codes) * 2 * 6 + 3 < len(rows) / 4


def test_request_lists_of_nothing(spark):
    none = spark.createDataFrame([], "method string, ts_code string, trade_date date")
    assert Q.request_lists(none).count() == 0


LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def test_base_features_move_the_lines_once_and_the_bars_once(spark, tmp_path):
    """Null suppliers, dates, prices and taxes, repeated lines, sessions without a finished line, codes with too few sessions."""
    rows = []
    for i in range(900):
        day = datetime(2001, 1, 1) + timedelta(days=i * 13 % 120)
        row = [i, 1, i % 4, i % 7 + 1, float(i % 50 + 1), float(i % 50 + 1) * (10 + i % 9), 0.01, 0.01 * (i % 3), "A", "F" if i % 3 else "O", day]
        for at, every in ((2, 97), (4, 89), (5, 83), (7, 79), (9, 73), (10, 71)):
            if i % every == 5:
                row[at] = None
        if row[2] == 3 and i % 16 != 3:
            row[2] = 1
        rows += [tuple(row)] * (2 if i % 50 == 0 else 1)
    spark.createDataFrame(rows, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    t = MarketTables(spark, str(tmp_path))
    assert sorted(t.valued_bars.collect(), key=str) == sorted(daily_panel(t.bars, t.valuation).collect(), key=str)
    sizes = {r.ts_code: r["count"] for r in t.bars.groupBy("ts_code").count().collect()}
    got = W.base_features(t.valued_bars, min_rows=60).groupBy("ts_code").count().collect()
    kept = {c: n for c, n in sizes.items() if c is not None and n >= 60}
    assert {r.ts_code: r["count"] for r in got} == kept and len(kept) < len(sizes) - 1
    plan = load_all()[0]["w20_all_base_features"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_probe_passes_save_no_forest(spark, monkeypatch):
    """The counted nodes are those of the saved forest."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    df = spark.createDataFrame([(f"{c:06d}", date(2001, 1, 1) + timedelta(d), (c * 7 + d) % 11 / 11.0, (c + d * 3) % 5 / 5.0) for c in range(20) for d in range(40)], "ts_code string, trade_date date, a double, b double")
    df = df.select("*", (F.col("a") > 0.5).cast("int").alias("label_cls"), F.col("b").alias("label_reg"), (F.col("a") > F.col("b")).cast("int").alias("label_dir"))
    saved, write = [], D.scratch_dir
    monkeypatch.setattr(D, "scratch_dir", lambda spark, name: saved.append(name) or write(spark, name))
    D.probe_pass(df, ["a", "b"], 2, 7).collect()
    assert not saved
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    for label, depth in (("label_reg", 3), ("label_dir", 5), ("label_cls", 0)):
        model = RandomForestRegressor(labelCol=label, numTrees=4, maxDepth=depth, seed=1).fit(rows)
        got, want = (sorted((r.feature, r.importance) for r in D.split_counts(nodes, ["a", "b"]).collect()) for nodes in (D.inner_nodes(model), D.saved_nodes(model)))
        assert got == want and (depth == 0) == (sum(n for _, n in got) == 0)
