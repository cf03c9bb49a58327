"""Overlap joins, split counts, trailing-window fits, search layers, digest trees, publication races, windows."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspan.session import scratch_dir


def test_overlaps_against_all_pairs(spark):
    from barspan.operators.quality import overlaps

    rnd = random.Random(7)
    base = date(1969, 12, 1)

    def spans(n, longest):
        out = []
        for i in range(n):
            a = base + timedelta(rnd.randrange(120))
            out.append((rnd.choice("xyz"), i, a, a + timedelta(rnd.choice([0, 1, rnd.randrange(longest), -1]))))
        return out

    left, right = spans(150, 60), spans(150, 30_000)
    l = spark.createDataFrame(left, "k string, l int, left_start date, left_end date")
    r = spark.createDataFrame(right, "k string, r int, right_start date, right_end date")
    want = sorted((a[0], a[1], b[1]) for a in left for b in right if a[0] == b[0] and a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3])
    assert sorted(map(tuple, overlaps(l, r, on=["k"]).select("k", "l", "r").collect())) == want
    free = sorted((a[1], b[1]) for a in left for b in right if a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3])
    assert sorted(map(tuple, overlaps(l, r.drop("k")).select("l", "r").collect())) == free
    assert overlaps(l.limit(0), r, on=["k"]).count() == 0


def test_split_counts_of_a_fitted_and_saved_forest(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    from barspan.operators.models import saved_nodes, split_counts

    rnd = random.Random(1)
    rows = [(x := rnd.random(), rnd.random(), rnd.random(), 1.0 if x > 0.5 else 0.0) for _ in range(300)]
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, c double, y double"))
    model = RandomForestRegressor(featuresCol="features", labelCol="y", numTrees=4, maxDepth=3, seed=1).fit(df)
    got = {r.feature: r.importance for r in split_counts(saved_nodes(model), ["a", "b", "c"]).collect()}
    text = model.toDebugString
    assert got == {n: text.count(f"If (feature {i} ") for i, n in enumerate("abc")}
    assert sum(got.values()) > 0


def test_window_coefficients_equal_a_fit_per_window(spark):
    from barspan.operators.walkforward import walk_forward_scores, window_coefficients

    rnd = np.random.default_rng(2)
    days = [date(2020, 1, 1) + timedelta(i) for i in range(60)]
    rows = []
    for c in "ABC":
        own = [d for d in days if rnd.random() < 0.9]
        for i, d in enumerate(own):
            x = rnd.normal(size=2) * [1.0, 50.0]
            target = own[i + 5] if i + 5 < len(own) else None
            rows.append((c, d, float(x[0]), float(x[1]) if rnd.random() < 0.95 else None, 7.0, float(x[0] - x[1] / 40 + rnd.normal()) if target else None, target))
    df = spark.createDataFrame(rows, "ts_code string, trade_date date, u double, v double, flat double, label double, label_target_date date")
    sessions = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "trade_date date, ordinal int")
    features = ["u", "v", "flat"]
    fits = window_coefficients(df, features, sessions, 20, 4)
    got = {r.ordinal: r for r in fits.collect()}
    assert sorted(got) == list(range(20, 60, 4))
    at = {d: i for i, d in enumerate(days)}
    for i, r in got.items():
        train = [x for x in rows if x[3] is not None and x[5] is not None and i - 20 <= at[x[1]] < i and at[x[6]] < i]
        z, y = np.array([x[2:5] for x in train]), np.array([x[5] for x in train])
        sd = z.std(0)
        sd[sd == 0] = 1
        s = (z - z.mean(0)) / sd
        w = np.linalg.solve(s.T @ s + np.eye(3), s.T @ (y - y.mean())) / sd
        assert r.rows == len(train)
        np.testing.assert_allclose(r.weights, w, atol=1e-9)
        np.testing.assert_allclose(r.intercept, y.mean() - w @ z.mean(0), atol=1e-9)
    scores = {(r.ts_code, r.trade_date): r.score for r in walk_forward_scores(df, fits, features).collect()}
    for x in rows:
        i = at[x[1]]
        if i in got and x[3] is not None:
            assert scores[x[0], x[1]] == pytest.approx(got[i].intercept + sum(a * b for a, b in zip(got[i].weights, x[2:5])))
    assert len(scores) == sum(at[x[1]] in got and x[3] is not None for x in rows)


def test_search_finds_long_codes_wide_letters_and_single_letters(spark, monkeypatch):
    from barspan.operators import search as S

    rows = [("1234567890.SZ", "Ｐing Ａn ①号 ﬁne", "bank", "south"), ("000002.SZ", "ping ﾊﾞﾝｸ", "bank", "north"), ("600000.SH", "other", None, "zone")]
    master = spark.createDataFrame(rows, "ts_code string, name string, industry string, region string")
    asked = ["1234567890.SZ", "1234567890sz", "ＰＩＮＧ　ＡＮ", "1号", "fine", "バンク", "z", "1234567890123456"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    for size in (20_000, 1):
        monkeypatch.setattr(S, "TEXTS_PER_TASK", size)
        got = {}
        for r in S.search(master, queries).collect():
            got.setdefault(asked[r.query_id], []).append((r.ts_code, r.score))
        assert got["1234567890.SZ"] == got["1234567890sz"] == [("1234567890.SZ", 1000)]
        assert got["ＰＩＮＧ　ＡＮ"][0][0] == "1234567890.SZ"
        assert [c for c, _ in got["1号"]] == ["1234567890.SZ"] and [c for c, _ in got["fine"]][0] == "1234567890.SZ"
        assert [c for c, _ in got["バンク"]] == ["000002.SZ"]
        assert {c for c, _ in got["z"]} == {r[0] for r in rows if "z" in r[0].lower() or "z" in r[3]}
        assert "1234567890123456" not in got


def test_bit_parallel_distance_equals_the_table(spark):
    from barspan.operators.search import _distance

    rnd = random.Random(5)
    words = [("".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9))), "".join(rnd.choice("abcd") for _ in range(rnd.randrange(0, 14)))) for _ in range(300)]

    def plain(token, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(token, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    df = spark.createDataFrame(words, "token string, text string").withColumn("d", _distance(F.col("token"), F.col("text")))
    assert all(r.d == plain(r.token, r.text) for r in df.collect())


def test_two_writers_one_loses(spark):
    from barspan.sources.sinks import FeatureStore, LostRace

    root = scratch_dir(spark, "store")
    one, two = FeatureStore(spark, root), FeatureStore(spark, root)
    df = spark.createDataFrame([("a", date(2024, 1, 1), 1.0)], "ts_code string, trade_date date, v double")
    one.write(df, "b1")
    one.publish(df, "b1")
    for store, name in ((one, "b2"), (two, "b3")):
        store.write(df.withColumn("v", F.lit(2.0)), name)
    seen = one.step()
    assert seen == two.step() == 1
    one.publish(df.withColumn("v", F.lit(2.0)), "b2", seen)
    with pytest.raises(LostRace):
        two.publish(df.withColumn("v", F.lit(2.0)), "b3", seen)
    assert one.active() == "b2" and two.rollback() == "b1" and one.active() == "b1"


def test_digest_tree_names_the_shard_that_differs(spark):
    from barspan.sources.sinks import chained_digests, differing_nodes

    rows = [(i, i // 10, i // 50, f"v{i}") for i in range(200)]
    schema = "k int, shard int, node int, v string"
    tree = lambda r, n: chained_digests(spark.createDataFrame(r, schema).repartition(n), ["k", "v"], ["k"], ["shard", "node"])
    one, same = tree(rows, 3), tree(rows[::-1], 7)
    assert differing_nodes(one, same).count() == 0 and one.where("level = 2").first() == same.where("level = 2").first()
    other = tree([(k, s, n, "x" if k == 123 else v) for k, s, n, v in rows], 5)
    assert [tuple(r) for r in differing_nodes(one, other).collect()] == [("12", 10, 10)]
    assert [r.node for r in differing_nodes(one, other, 1).collect()] == ["2"] and differing_nodes(one, other, 2).count() == 1
    swapped = tree([(k, s, n, rows[k ^ 1][3]) for k, s, n, v in rows], 5)  # the same values in another order
    assert differing_nodes(one, swapped).count() == 20


def test_windows_are_cut_from_the_panel(spark):
    from barspan.operators.sequence import gather_windows, window_index

    rnd = random.Random(2)
    days = [date(2024, 1, 1) + timedelta(i) for i in range(30)]
    rows = [(c, d, rnd.random(), rnd.random() if rnd.random() < 0.97 else None, rnd.random()) for c in ("a", "b", "c") for d in days if rnd.random() < 0.9]
    df = spark.createDataFrame(rows, "ts_code string, trade_date date, x double, y double, label double")
    index = window_index(df, ["x", "y"], 4, minimum=2)
    assert set(index.columns) == {"ts_code", "trade_date", "label", "last_row", "instruments", "relevance", "above_median", "rises"}
    got = {(r.ts_code, r.trade_date): r.window for r in gather_windows(index, df, ["x", "y"], 4).collect()}
    want = {}
    for c in "abc":
        own = sorted(r for r in rows if r[0] == c)
        for i in range(3, len(own)):
            part = own[i - 3 : i + 1]
            if all(r[3] is not None for r in part):
                want[c, own[i][1]] = [[float(np.float32(v)) for v in r[2:4]] for r in part]
    per_day = {}
    for c, d in want:
        per_day[d] = per_day.get(d, 0) + 1
    want = {k: w for k, w in want.items() if per_day[k[1]] >= 2}
    assert got == want and want


def test_places_of_extremes_equal_a_search_per_window():
    from barspan.operators.sequence import _extremes

    rnd = np.random.default_rng(6)
    for n in (1, 2, 4, 5, 6, 33, 61, 200):
        values = rnd.integers(0, 4, n).astype(float)
        for w, place in _extremes(values, (5, 10, 20, 30, 60, 1, 2)).items():
            want = [-1 if i < w - 1 else int(values[i - w + 1 : i + 1].argmax()) + i - w + 1 for i in range(n)]
            assert place.tolist() == want, (n, w)
