import random

import numpy as np
import pyarrow as pa

from barspan.llm.op5_quality import MEASURES, accepted, estimate_prior, fit, measures, quality

DOC, LABEL = "doc_id long, text string, score string", "doc_id long, quality int, toxic int"


def clean(rnd):
    return ". ".join(" ".join(rnd.choice("the of sea wind road light stone river green tall".split()) + rnd.choice(["", "s", "ly", "ing"]) for _ in range(12)).capitalize() for _ in range(5))


def junk(rnd):
    kind = rnd.randrange(3)
    if kind == 0:
        return " | ".join(clean(rnd).split())
    if kind == 1:
        return " ".join([rnd.choice(["buy", "now"])] * 80)
    return " ".join(w + rnd.choice(["###", "&&&"]) for w in clean(rnd).split())


def corpus(n=600):
    rnd = random.Random(4)
    rows = [(i, *((clean(rnd), 1) if rnd.random() < 0.8 else (junk(rnd), 0))) for i in range(n)]
    docs = [(i, t, "x") for i, t, _ in rows] + [(n, None, None), (n + 1, "", "e"), (None, clean(rnd), "no id"), (n + 2, clean(rnd) * 400, "long"), (0, rows[0][1], "x")]
    return docs, [(i, q, 0) for i, _, q in rows if i % 2] + [(None, 1, 0), (2, None, 0), (10**9, 1, 1)], dict((i, q) for i, _, q in rows)


def test_prior_and_held_out_rows(spark):
    docs, labels, truth = corpus()
    got = quality(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL)).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_negative_labels_are_not_used(spark):
    docs, labels, _ = corpus(200)
    d = spark.createDataFrame(docs, DOC)
    flipped = [(i, q if q == 1 else None, t) for i, q, t in labels]
    a = sorted(map(tuple, quality(d, spark.createDataFrame(labels, LABEL)).collect()), key=str)
    b = sorted(map(tuple, quality(d.repartition(3), spark.createDataFrame(flipped, LABEL)).collect()), key=str)
    assert a == b


def test_prior_of_a_known_mixture():
    rnd = np.random.default_rng(0)
    p, n = rnd.normal(2, 1, 4000), rnd.normal(-2, 1, 4000)
    for share in (0.3, 0.8):
        k = int(4000 * share)
        u = np.concatenate([rnd.normal(2, 1, k), n[: 4000 - k]])
        assert abs(estimate_prior(p, u) - share) < 0.05


def test_accepted_keeps_columns_and_tables_without_labels(spark):
    docs, labels, truth = corpus(300)
    d = spark.createDataFrame(docs, DOC)
    out = accepted(d, spark.createDataFrame(labels, LABEL))
    assert out.columns == d.columns
    kept = [r.doc_id for r in out.collect()]
    assert kept.count(0) in (0, 2)
    good = [i for i, q in truth.items() if q]
    assert sum(i in set(kept) for i in good) > 0.97 * len(good)
    none = spark.createDataFrame([], LABEL)
    assert accepted(d, none).count() == len(docs)
    assert {r.score for r in quality(d, none).collect()} == {0.5}
    assert quality(spark.createDataFrame([], DOC), none).count() == 0


def test_measures_of_whole_texts():
    x = measures(pa.array(["a b a b", None, "", "A! | 1 é\n" * 300_000]))
    assert x.shape == (4, len(MEASURES)) and np.isfinite(x).all()
    assert x[0, MEASURES.index("distinct")] == np.log(2) / np.log(4)
    assert not x[1:3].any()


def test_fit_ignores_row_order_of_equal_samples():
    rnd = np.random.default_rng(1)
    p, u = rnd.normal(1, 1, (50, len(MEASURES))), rnd.normal(0, 1, (80, len(MEASURES)))
    a, b = fit(p, u), fit(p.copy(), u.copy())
    assert a[1] == b[1] and np.array_equal(a[0].weights, b[0].weights)
