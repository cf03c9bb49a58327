import math

import numpy as np

from barspan.llm import op12_whitening as op12

VEC = "vec_id long, embedding array<float>, n long, deviation string"


def rotation(rnd, d):
    return np.linalg.qr(rnd.normal(size=(d, d)))[0].astype(np.longdouble)


def test_refinement_reaches_double_precision_from_float32():
    rnd = np.random.default_rng(12)
    spectra = [
        np.linspace(1, 9, 12),
        10.0 ** -np.arange(8),
        np.array([5, 5, 5, 1, 1, 0.5]),  # repeated values: any basis of their space
        np.array([3, 3 - 1e-6, 3 - 2e-6, 3 - 1e-9, 1]),  # a cluster far below float32
        np.array([2, 2 - 1e-12, 1, 1e-9, 0]),
        np.array([4.0]),
        np.zeros(3),
    ]
    for lam in spectra:
        lam = np.sort(np.asarray(lam, np.longdouble))[::-1]
        q = rotation(rnd, len(lam))
        for _ in range(3):
            q = q @ (1.5 * np.eye(len(lam), dtype=np.longdouble) - q.T @ q / 2)
        v = (q * lam) @ q.T
        values, x = op12.refined_eigh((v + v.T) / 2)
        assert np.abs(values - lam).max() < 1e-14 * max(1, lam[0])
        assert np.abs(x.T @ x - np.eye(len(lam))).max() < 1e-15
        assert np.abs(v @ x - x * values).max() < 2e-15 * max(1, float(lam[0]))
        for i in range(len(lam)):
            gap = min((abs(lam[i] - lam[j]) for j in range(len(lam)) if j != i), default=1)
            if gap > 1e-7:  # the matrix itself is rounded at 1e-19
                y = x[:, i] * np.sign(x[:, i] @ q[:, i])
                assert np.abs(y - q[:, i]).max() < 2e-15 + 1e-18 * float(lam[0] / gap)


def brute(rows, k=8):
    """Straight from the definition, in Python integers and a double-precision decomposition."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v) and v]
    n, d = len(kept), len(kept[0][1])
    total = [sum(x[j] for _, x in kept) for j in range(d)]
    x = np.array([x for _, x in kept], float)
    centred = x - np.array(total) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = centred @ vectors[:, :k] / np.sqrt(values[:k])
    deviation = [sum((n * c - s) ** 2 for c, s in zip(xs, total)) for _, xs in kept]
    return [i for i, _ in kept], n, deviation, white, values[:k] / values.sum()


def against(got, rows):
    ids, n, deviation, white, explained = brute(rows)
    by: dict = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
        assert r.n == n and r.identity_error < 1e-9
    sign = {}
    for i, dev, w in zip(ids, deviation, white):
        assert set(by[i]) == set(range(1, len(w) + 1))
        for c in range(len(w)):
            for r in by[i][c + 1]:
                if ids.count(i) == 1:
                    assert r.deviation == dev
                    sign.setdefault(c, np.sign(r.whitened * w[c]))
                    assert abs(r.whitened - sign[c] * w[c]) < 1e-8
                assert abs(r.explained / explained[c] - 1) < 1e-9
    assert len(got) == len(ids) * white.shape[1]


def test_equals_the_definition(spark):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(400, 11)) @ np.diag(np.linspace(0.05, 0.6, 11))
    rows = [(i, v.tolist(), 5, "x") for i, v in enumerate(base)]
    rows += [(0, rows[0][1], 5, "x"), (None, rows[1][1], 5, "x"), (900, None, 5, "x"), (901, [0.1] * 10 + [None], 5, "x"), (902, [float("nan")] * 11, 5, "x"), (903, [float("inf")] + [0.0] * 10, 5, "x")]
    rows += [(i, [0.5] * 11, 5, "x") for i in range(1000, 1200)]  # one common vector
    against(op12.whiten(spark.createDataFrame(rows, VEC).repartition(7)).collect(), rows)


def test_few_rows_equal_rows_and_other_lengths(spark):
    one = spark.createDataFrame([(1, [0.1, 0.2, 0.3], 0, "")], VEC)
    got = op12.whiten(one).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in got] == [(1, c, 1, 0, None, None) for c in (1, 2, 3)]
    line = spark.createDataFrame([(i, [float(i), float(i)], 0, "") for i in range(4)] + [(9, [], 0, ""), (7, [1.0], 0, ""), (8, [3.0], 0, "")], VEC)
    got = sorted(op12.whiten(line).collect(), key=lambda r: (r.n, r.vec_id, r.component))
    assert [(r.vec_id, r.component, r.n) for r in got] == [(7, 1, 2), (8, 1, 2)] + [(i, c, 4) for i in range(4) for c in (1, 2)]
    assert all((r.whitened is None) == (r.n == 4 and r.component == 2) for r in got)
    assert abs(got[0].whitened) == 1 and got[0].whitened == -got[1].whitened
    huge = spark.createDataFrame([(1, [3e38, 1.0], 0, ""), (2, [-3e38, 2.0], 0, ""), (3, [0.0, 5.0], 0, "")], VEC)
    assert [r.deviation for r in op12.whiten(huge).collect()] == [None] * 4 + [2 * r.deviation // 2 for r in op12.whiten(huge).collect()[4:]]
    assert op12.whiten(spark.createDataFrame([], VEC)).count() == 0


def test_registered_query_on_the_table(spark, sf_dir):
    from barspan.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    against(QUERIES["op12_whitening"](spark, sf_dir).collect(), rows)
