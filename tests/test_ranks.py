"""Bucketed ranks against brute force, with tiny buckets, ties and one dominant group."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspan.functions import ranks


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = [("hot", f"c{i:04d}", float(rng.randint(0, 150))) for i in range(600)]
    out += [(f"g{i % 20}", f"k{i:04d}", rng.random()) for i in range(600)]
    return out + [("lone", "x", 1.0)]


@pytest.fixture(scope="module", params=[3, 50, 200_000])
def bucket(request):
    return request.param


def test_positions_match_brute_force(spark, rows, bucket):
    df = spark.createDataFrame(rows, "g string, k string, v double")
    got = ranks.value_positions(df, ["g"], "v", bucket).toPandas()
    pdf = pd.DataFrame(rows, columns=["g", "k", "v"])
    want = pdf.groupby(["g", "v"]).size().rename("ties").reset_index()
    want["less"] = want.groupby("g").ties.cumsum() - want.ties
    want["n"] = want.groupby("g").ties.transform("sum")
    cols = ["g", "v", "ties", "less", "n"]
    pd.testing.assert_frame_equal(
        got[cols].sort_values(["g", "v"]).reset_index(drop=True), want[cols].sort_values(["g", "v"]).reset_index(drop=True), check_dtype=False
    )


def test_average_rank_quantile_and_row_order(spark, rows):
    df = spark.createDataFrame(rows, "g string, k string, v double")
    pdf = pd.DataFrame(rows, columns=["g", "k", "v"])
    got = ranks.with_average_rank(df, ["g"], "v", "r").toPandas().set_index(["g", "k"]).r.sort_index()
    want = pdf.assign(r=pdf.groupby("g").v.rank(method="average")).set_index(["g", "k"]).r.sort_index()
    assert (got == want).all()
    q = ranks.group_quantile(df, ["g"], "v", 0.3, "q").toPandas().set_index("g").q.sort_index()
    assert ((q - pdf.groupby("g").v.quantile(0.3).sort_index()).abs() < 1e-12).all()
    order = ranks.row_order(df, ["g"], "v", True, "k", "p").select("g", "k", "p").toPandas().set_index(["g", "k"]).p.sort_index()
    ordered = pdf.sort_values(["g", "v", "k"], ascending=[True, False, True])
    expected = ordered.assign(p=ordered.groupby("g").cumcount() + 1).set_index(["g", "k"]).p.sort_index()
    assert (order == expected).all()


def test_late_tagging_does_not_depend_on_bucket_size(spark):
    from barspan.streaming.indicators import tag_late

    rng = random.Random(3)
    data = [("a" if rng.random() < 0.6 else f"b{i % 4}", f"2024-01-{rng.randint(1, 28):02d}", i) for i in range(400)]
    df = spark.createDataFrame(data, "ts_code string, d string, offset long").withColumn("trade_date", F.to_date("d"))
    flags = [
        sorted(map(tuple, tag_late(df, size).select("offset", "is_late").collect())) for size in (1, 7, 100_000)
    ]
    assert flags[0] == flags[1] == flags[2]
    seen, want = {}, []
    for code, d, i in data:
        want.append((i, code in seen and d < seen[code]))
        seen[code] = max(seen.get(code, d), d)
    assert flags[0] == sorted(want)


def test_constant_sides_have_no_correlation(spark):
    from barspan.functions.frames import safe_corr

    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 2.0), (2, 2.0, 4.0), (2, None, 9.0)], "g int, x double, y double")
    got = {r["g"]: r["c"] for r in df.groupBy("g").agg(safe_corr("x", "y").alias("c")).collect()}
    assert got[1] is None and abs(got[2] - 1) < 1e-12


def test_ties_nulls_and_groups_that_straddle_tasks(spark):
    """A value with most rows lies in many tasks; its ranks come from the small table."""
    rng = random.Random(11)
    data = [("hot" if rng.random() < 0.7 else rng.choice(["b", None]), rng.choice([1.0, 1.0, 1.0, 1.0, 0.0, -0.0, 2.5, float("nan"), None, rng.random()]), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, v double, k int")
    key = lambda v: (1, 0.0) if v != v else (0, v)  # noqa: E731  NaN is largest and equals itself
    groups = {}
    for g, v, _ in data:
        if v is not None:
            groups.setdefault(g, []).append(key(v))
    for partitions in (37, 400):
        got = {r.k: (r.less, r.ties, r.n) for r in ranks.positioned(df, ["g"], "v", partitions=partitions).collect()}
        assert len(got) == len(data)
        for g, v, k in data:
            values = groups[g]
            want = (None, None, None) if v is None else (sum(x < key(v) for x in values), values.count(key(v)), len(values))
            assert got[k] == want, (g, v)
    alone = {r.k: (r.less, r.ties, r.n) for r in ranks.positioned(df.where("g = 'b'"), [], "v", partitions=9).collect()}
    for g, v, k in data:
        if g == "b" and v is not None:
            assert alone[k] == (sum(x < key(v) for x in groups["b"]), groups["b"].count(key(v)), len(groups["b"]))
    assert ranks.positioned(df.limit(0), ["g"], "v").count() == 0
    assert ranks.positioned(df.where("v IS NULL"), [], "v").where("less IS NOT NULL").count() == 0
