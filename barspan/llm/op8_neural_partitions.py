"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors is joined to its nearest neighbours (largest inner product);
this graph is cut into parts of nearly equal size with few edges between them: parts are grown
breadth first and refined by moving nodes to the part of most of their neighbours while the
sizes stay within ``SLACK``. A small network learns which parts hold a vector's neighbours. It
puts every vector of the table into its most probable part and routes a query to the several
most probable ones; their vectors are compared with the query exactly, in double precision.

How many parts a query visits is the smallest number that finds ``RECALL`` of the true
neighbours of sample rows that the network was not fitted to, against the whole sample. A query
also visits parts until they hold ``ENOUGH`` vectors, so small tables are searched whole.

Parts may be as large as they are: they are cut into blocks of ``BLOCK`` vectors and of
``QUERIES`` queries, and a task compares one block with the other. Results are merged
by rank.

Vectors that are null or zero, or hold null or non-finite components, and rows without an id
take no part; nor do vectors whose length differs from most. Rows of one id with one vector
count once. Equal scores go to the smaller id. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspan.llm.common import written

SAMPLE = 8192
NEIGHBOURS = 10
#: Vectors of the sample per part.
PER_PART = 256
SLACK = 1.05
RECALL = 0.94
ENOUGH = 400
BLOCK, QUERIES = 4096, 1024
HIDDEN, EPOCHS, RATE = 128, 40, 2e-3


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's ``k`` rows of largest inner product, itself left out."""
    out = np.zeros((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Part of each node: sizes within ``SLACK`` of equal, few edges between parts."""
    n = len(graph)
    edges: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            edges[i].append(j)
            edges[j].append(i)
    room = -(-n // parts)
    part = np.full(n, -1, np.int64)
    order = np.argsort([-len(e) for e in edges], kind="stable").tolist()
    at = 0
    for p in range(parts):  # grow each part from a free node of many edges
        queue, size, head = [], 0, 0
        while size < room:
            if head == len(queue):
                while at < n and part[order[at]] >= 0:
                    at += 1
                if at == n:
                    break
                queue.append(order[at])
            i = queue[head]
            head += 1
            if part[i] >= 0:
                continue
            part[i] = p
            size += 1
            queue += [j for j in edges[i] if part[j] < 0]
    sizes, most = np.bincount(part, minlength=parts), int(room * SLACK) + 1
    for _ in range(rounds):
        moved = 0
        for i in range(n):
            votes = np.bincount(part[edges[i]], minlength=parts)
            votes[sizes >= most] = -1
            best = int(votes.argmax())
            if votes[best] > np.count_nonzero(part[edges[i]] == part[i]):
                sizes[part[i]] -= 1
                sizes[best] += 1
                part[i] = best
                moved += 1
        if moved < n // 200:
            break
    return part


class Router:
    """One hidden layer; gives the probability that a part holds a vector's neighbours."""

    def __init__(self, w1, b1, w2, b2):
        self.layers = (w1, b1, w2, b2)

    @classmethod
    def fit(cls, x: np.ndarray, share: np.ndarray, seed: int = 7) -> Router:
        """``share``: distribution of each row's neighbours over the parts."""
        rnd = np.random.default_rng(seed)
        d, parts = x.shape[1], share.shape[1]
        w = [rnd.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), rnd.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, parts)), np.zeros(parts)]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(EPOCHS):
            order = rnd.permutation(len(x))
            for a in range(0, len(x), 256):
                xb, yb = x[order[a : a + 256]], share[order[a : a + 256]]
                h = np.maximum(xb @ w[0] + w[1], 0)
                p = _softmax(h @ w[2] + w[3])
                out = (p - yb) / len(xb)
                back = (out @ w[2].T) * (h > 0)
                grads = [xb.T @ back + 1e-4 * w[0], back.sum(0), h.T @ out + 1e-4 * w[2], out.sum(0)]
                t += 1
                for i, g in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    w[i] -= RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return cls(*w)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        n = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return _softmax(np.maximum((x / n) @ w1 + b1, 0) @ w2 + b2)


def _softmax(z):
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def learn(x: np.ndarray, top: int = 20) -> tuple[Router, int]:
    """Router and number of parts to visit, from the sample."""
    parts = max(1, len(x) // PER_PART)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    if parts == 1:
        d = x.shape[1]
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 1
    graph = neighbour_graph(x, min(NEIGHBOURS, len(x) - 1))
    part = balanced_parts(graph, parts)
    share = np.zeros((len(x), parts))
    np.add.at(share, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1.0)
    share[np.arange(len(x)), part] += 1
    share /= share.sum(axis=1, keepdims=True)
    test = np.arange(len(x)) % 8 == 0
    router = Router.fit(unit[~test], share[~test])
    home = router.probabilities(x).argmax(axis=1)
    true = neighbour_graph(x, min(top, len(x) - 1))[test]
    rank = np.argsort(np.argsort(-router.probabilities(x[test]), axis=1), axis=1)
    need = rank[np.arange(len(true))[:, None], home[true]]  # when the part of each neighbour is visited
    found = [(need < p).mean() for p in range(1, parts + 1)]
    return router, 1 + int(np.argmax(np.array(found) >= RECALL))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as doubles."""
    v = F.transform("embedding", lambda e: e.cast("double"))
    df = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    df = df.where(finite & F.exists("v", lambda e: e != 0))
    return df.dropDuplicates(["vec_id", "v"])


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def search(vectors: DataFrame, queries: DataFrame, top: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest of ``vectors`` found for each row of ``queries``."""
    spark = vectors.sparkSession
    rows = written(usable(vectors), "vectors")
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if length is None:
        return empty
    rows = rows.where(F.size("v") == length.d)
    asked = usable(queries).where(F.size("v") == length.d)
    total = rows.count()
    part_of_all = int(1.2e6 * SAMPLE / total) + 1
    pick = F.xxhash64("vec_id", F.lit("sample"))
    sample = rows.where(F.pmod(pick, F.lit(1_000_000)) < part_of_all).orderBy(pick, "vec_id", "v").limit(SAMPLE).select("v").collect()
    x = np.array([r.v for r in sample], np.float64)
    # a vector that fills the sample would be all there is to learn from
    router, visits = learn(np.unique(x, axis=0)[np.random.default_rng(1).permutation(len(np.unique(x, axis=0)))], top)

    def place(batches):
        for b in batches:
            if b.num_rows:
                home = router.probabilities(_matrix(b.column("v"))).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(home)], ["vec_id", "v", "part"])

    index = written(rows.mapInArrow(place, "vec_id long, v array<double>, part int"), "ann-index")
    sizes = {r.part: r["count"] for r in index.groupBy("part").count().collect()}  # one number per part
    held = np.array([sizes.get(p, 0) for p in range(router.layers[3].shape[0])])

    def route(batches):
        for b in batches:
            if not b.num_rows:
                continue
            order = np.argsort(-router.probabilities(_matrix(b.column("v"))), axis=1, kind="stable")
            before = np.cumsum(held[order], axis=1) - held[order]
            go = (np.arange(order.shape[1]) < visits) | (before < ENOUGH)
            take, at = np.nonzero(go)
            cols = [b.column("vec_id").take(pa.array(take)), b.column("v").take(pa.array(take)), pa.array(order[take, at].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "v", "part"])

    routed = written(asked.mapInArrow(route, "vec_id long, v array<double>, part int"), "ann-routed")
    sent = {r.part: r["count"] for r in routed.groupBy("part").count().collect()}
    blocks = [(p, -(-int(n) // BLOCK), -(-int(sent.get(p, 0)) // QUERIES)) for p, n in sizes.items() if sent.get(p)]
    if not blocks:
        return empty
    grid = F.broadcast(spark.createDataFrame(blocks, "part int, c_blocks int, q_blocks int"))  # one row per part

    def dealt(df, own, other, side):
        mine = F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int")
        both = df.join(grid, "part").withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        c, q = (mine, F.col("other")) if side == 0 else (F.col("other"), mine)
        return both.select("part", c.cast("int").alias("c"), q.cast("int").alias("q"), F.lit(side).alias("side"), "vec_id", "v")

    met = dealt(index, "c_blocks", "q_blocks", 0).unionByName(dealt(routed, "q_blocks", "c_blocks", 1))
    keys = ["part", "c", "q"]

    def compare(batches):
        from barspan.llm.op9_jaccard import _runs

        for t in _runs(batches, keys):
            side, ids = t.column("side").to_numpy(), t.column("vec_id").to_numpy()
            v = _matrix(t.column("v").combine_chunks())
            c, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            for a in range(0, len(q), 256):
                yield _best(ids[c], v[c], ids[q[a : a + 256]], v[q[a : a + 256]], top)

    found = met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "query_id long, vec_id long, score double")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _best(ids, v, query_ids, queries, top) -> pa.RecordBatch:
    """The ``top`` nearest of a block for each query; near ties are settled by a plain sum of products."""
    near = queries @ v.T if len(v) else np.zeros((len(queries), 0))
    near[query_ids[:, None] == ids[None, :]] = -np.inf
    qs, vs, ss = [], [], []
    for i in range(len(queries)):
        s = near[i]
        valid = np.isfinite(s)
        if valid.sum() > top:
            least = np.partition(s, len(s) - top)[len(s) - top]
            keep = np.flatnonzero(s >= least - 1e-9 * max(1.0, abs(least)))
        else:
            keep = np.flatnonzero(valid)
        exact = (v[keep] * queries[i]).sum(axis=1)
        order = np.lexsort((ids[keep], -exact))[:top]
        qs += [query_ids[i]] * len(order)
        vs.append(ids[keep][order])
        ss.append(exact[order])
    cols = [pa.array(qs, pa.int64()), pa.array(np.concatenate(vs) if vs else [], pa.int64()), pa.array(np.concatenate(ss) if ss else [], pa.float64())]
    return pa.RecordBatch.from_arrays(cols, ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, top: int = 20, every: int = 20) -> DataFrame:
    """Neighbours of the rows whose id ``every`` divides, among all other rows."""
    return search(vectors, vectors.where(F.col("vec_id") % every == 0), top)
