import random
import re

from barspan.llm.op9_jaccard import jaccard_components, keep_one

SCHEMA = "doc_id long, text string"


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [e for j, (e, _) in enumerate(rows) if find(j) == find(i) and e is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows, doc = [], 100
    for _ in range(40):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 4, 6, 12, 40, 120, 300]))]
        for _ in range(rnd.choice([1, 1, 2, 6])):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            rows.append((doc, rnd.choice([" ", "\n", "\t "]).join(w.upper() if rnd.random() < 0.2 else w for w in words)))
            doc -= 1
    base = [rnd.choice(vocab) for _ in range(200)]  # a chain of copies: each near the next only
    for i in range(30):
        base[(i * 7) % 200] = f"own{i}"
        rows.append((1000 + i, " ".join(base)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (None, "w1 w2 w3 w4"), (None, None), (2003, "w1 w2 w3 w4"), (2003, "w1 w2 w3 w4")]
    rows += [(2004, "Größe ÀÉ" * 3), (2005, "größe àé" * 3)]
    return rows


def test_components_equal_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    for k, num in ((3, 90), (5, 80)):
        got = jaccard_components(df, k, num, 100).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, k, num, 100)


def test_small_blocks_and_no_forest_change_nothing(spark, monkeypatch):
    import barspan.llm.op9_jaccard as op

    monkeypatch.setattr(op, "BLOCK", 3)
    monkeypatch.setattr(op, "FORESTS", 0)
    rows = corpus()
    got = op.jaccard_components(spark.createDataFrame(rows, SCHEMA), 3, 90, 100).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 3, 90, 100)


def test_keep_one_keeps_columns_and_blank_rows(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", None), (3, None, "y"), (4, "", "z"), (None, "q r s t u v", "n"), (1, "a b c d e f", "x")]
    out = keep_one(spark.createDataFrame(rows, SCHEMA + ", cls string"))
    assert out.columns == ["doc_id", "text", "cls"]
    assert sorted((r[0] or 0) for r in out.collect()) == [0, 1, 3, 4]


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA), 3, 90, 100).count() == 0


def test_linked_sets_share_a_tile_and_unlinked_ones_hardly():
    import numpy as np

    from barspan.llm.op9_jaccard import tile_keys

    rnd = np.random.default_rng(4)
    for num, den in ((90, 100), (80, 100), (2, 3), (1, 1)):
        shared = 0
        for _ in range(1500):
            n = int(rnd.choice([1, 2, 3, 4, 5, 6, 8, 9, 13, 19, 28, 42, 60, 150, 700]) + rnd.integers(0, 3))
            a = rnd.integers(0, 2**64, n, dtype=np.uint64)
            drop = int(rnd.integers(0, n))
            common, own = a[drop:], rnd.integers(0, 2**64, int(rnd.integers(0, n + 1)), dtype=np.uint64)
            a, b = np.unique(a), np.unique(np.concatenate([common, own]))
            met = bool(set(tile_keys(a, num, den).tolist()) & set(tile_keys(b, num, den).tolist()))
            if den * len(common) >= num * (len(a) + len(b) - len(common)):
                assert met, (num, den, len(a), len(b), len(common))
            other = np.unique(rnd.integers(0, 2**64, len(a) + 20, dtype=np.uint64))
            mine = np.unique(rnd.integers(0, 2**64, len(a) + 20, dtype=np.uint64))
            shared += bool(set(tile_keys(mine, num, den).tolist()) & set(tile_keys(other, num, den).tolist()))
        assert shared < 150


def test_repeated_rows_are_read_once(spark, monkeypatch):
    import barspan.llm.op9_jaccard as op

    counts, write = [], op.written

    def counted(df, name):
        out = write(df, name)
        if name == "sets":
            counts.append(out.count())
        return out

    monkeypatch.setattr(op, "written", counted)
    words = [f"w{i}" for i in range(200)]
    rows = [(None, " ".join(words))] * 30 + [(None, " ".join([*words, "x"]))] * 30 + [(1, " ".join([*words, "x", "y"]))]
    got = op.jaccard_components(spark.createDataFrame(rows, SCHEMA), 3, 90, 100).collect()
    assert len(got) == 61 and {r.component_id for r in got} == {1}
    assert max(counts) <= 3


def test_registered_query_counts_in_longs(spark, sf_dir):
    from barspan.llm.queries import QUERIES

    got = QUERIES["op9_jaccard_components"](spark, sf_dir)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"}
