import numpy as np

from barspan.llm.op8_neural_partitions import balanced_parts, neighbour_graph, nearest

SCHEMA = "vec_id long, embedding array<float>, part int"


def brute(rows, top=20, every=20):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], np.float64)
    out = []
    for i in np.flatnonzero(ids % every == 0):
        s = (v * v[i]).sum(axis=1)
        c = np.flatnonzero(ids != ids[i])
        c = c[np.lexsort((ids[c], -s[c]))][:top]
        out += [(int(ids[i]), k + 1, int(ids[j]), float(s[j])) for k, j in enumerate(c)]
    return out


def test_small_tables_are_exact(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[40][1]) for i in range(50)]  # ties with row 40
    odd = [(400, None, 0), (None, rows[0][1], 0), (420, [0.0] * 6, 0), (440, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (460, [float("nan")] * 6, 0), (480, [float("inf")] * 6, 0), (500, [1.0], 0), (501, [], 0), (0, rows[0][1], 7)]
    df = spark.createDataFrame([(*r, 0) for r in rows] + odd, SCHEMA)
    assert sorted(map(tuple, nearest(df).collect())) == sorted(brute(rows))
    few = spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(5)], SCHEMA)
    assert [(r.rank, r.vec_id) for r in nearest(few).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert nearest(spark.createDataFrame([(0, [1.0], 0)], SCHEMA)).count() == 0


def test_recall_and_blocks(spark, monkeypatch):
    import barspan.llm.op8_neural_partitions as op

    monkeypatch.setattr(op, "SAMPLE", 2000)
    monkeypatch.setattr(op, "BLOCK", 300)
    monkeypatch.setattr(op, "QUERIES", 40)
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(40, 16))
    rows = [(i, (centres[rnd.integers(40)] + 0.5 * rnd.normal(size=16)).astype(np.float32).tolist()) for i in range(6000)]
    got = nearest(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)).collect()
    want = brute(rows)
    assert len(got) == len(want)
    hit = {(r.query_id, r.vec_id) for r in got} & {(q, v) for q, _, v, _ in want}
    assert len(hit) >= 0.9 * len(want)
    scores = {(q, v): s for q, _, v, s in want}
    assert all(scores.get((r.query_id, r.vec_id), r.score) == r.score for r in got)


def test_parts_are_balanced_and_cut_few_edges():
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(8, 10)) * 3
    x = centres[np.arange(800) % 8] + rnd.normal(size=(800, 10)) * 0.3
    graph = neighbour_graph(x, 10)
    part = balanced_parts(graph, 8)
    assert np.bincount(part, minlength=8).max() <= 106
    assert (part[graph] == part[:, None]).mean() > 0.8
