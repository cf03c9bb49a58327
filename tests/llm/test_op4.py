import hashlib
import math
import random
import re

from barspan.llm.op4_mixing import mix, taken

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute(rows, weights=(5, 2, 1), share=150, epochs=2):
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(words(r[1]) for r in rows if r[3] == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(size.values()) * share / 100
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > epochs * size[s]}
        if not full:
            target.update({s: weight[s] * level for s in open_})
            break
        for s in full:
            target[s] = float(epochs * size[s])
            left -= target[s]
        open_ -= full
    out = []
    for s in names:
        mine = sorted(
            ((hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest(), i) for i, r in enumerate(rows) if r[3] == s)
        )
        at, got = 0, {}
        for _ in range(epochs):
            for _, i in mine:
                n = words(rows[i][1])
                got[i] = got.get(i, 0) + max(0, min(n, math.floor(target[s] + 1e-9) - at))
                at += n
        out += [(rows[i][0], words(rows[i][1]), s, size[s], round(target[s], 6), got[i]) for i in got]
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        src = rnd.choice(["hot"] * 10 + ["b", "Ä", "a", "z", None])
        rows.append((i, rnd.choice([" ", "\n\t", "  "]).join(f"x{rnd.randrange(9)}" for _ in range(rnd.choice([0, 1, 5, 60, 900]))) + rnd.choice(["", " "]), "en", src, 1))
    rows += [(300, None, "en", "b", None), (None, "a b c", None, "tiny", 5), (7, "rep eat", "en", "a", 7), (7, "rep eat", "en", "a", 7), (8, "   x", "e", "b", 1)]
    return rows


def test_taken_equals_brute_force(spark, monkeypatch):
    import barspan.llm.op4_mixing as op

    rows = corpus()
    want = brute(rows)
    for per_range, per_step in ((20_000, 8_000_000), (7, 500)):
        monkeypatch.setattr(op, "ROWS_PER_RANGE", per_range)
        monkeypatch.setattr(op, "WORDS_PER_STEP", per_step)
        df = taken(spark.createDataFrame(rows, SCHEMA).repartition(5))
        got = [(r.doc_id, r["size"], r.source, r.source_size, round(r.target, 6), r.taken) for r in df.collect()]
        assert sorted(got, key=str) == want
    assert all(t <= 2 * n for _, n, _, _, _, t in got)


def test_stream_has_no_gap_and_follows_finish_times(spark):
    from barspan.llm.op4_mixing import schedule

    copies = sorted(schedule(spark.createDataFrame(corpus(), SCHEMA)).where("words > 0").collect(), key=lambda r: r.stream_start)
    at = 0
    for r in copies:
        assert r.stream_start == at
        at += r.words
    assert [r.finish for r in copies if r.finish <= 1] == sorted(r.finish for r in copies if r.finish <= 1)


def test_mix_repeats_and_cuts(spark):
    rows = corpus()
    out = mix(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    by_source = {}
    for r in out.collect():
        by_source[r.source] = by_source.get(r.source, 0) + words(r.text)
    want = {}
    for _, _, s, _, _, t in brute(rows):
        want[s] = want.get(s, 0) + t
    assert by_source == {s: n for s, n in want.items() if n}


def test_mix_stands_in_stream_order(spark):
    from barspan.llm.op4_mixing import schedule

    docs = spark.createDataFrame(corpus(), SCHEMA)
    plan = sorted(schedule(docs).where("words > 0").collect(), key=lambda r: r.stream_start)
    got = mix(docs).collect()
    assert [(r.doc_id, r.source, words(r.text)) for r in got] == [(r.doc_id, r.source, r.words) for r in plan]
    half = {r.source for r in got[: len(got) // 2]}
    assert half | {"tiny"} == {r.source for r in got}  # "tiny" is one document


def test_taken_comes_from_the_stream(spark):
    df = taken(spark.createDataFrame(corpus(), SCHEMA))
    plan = df.select("doc_id", "taken")._jdf.queryExecution().optimizedPlan().toString()
    assert "finish" in plan and "Window" in plan  # the stream's window is not pruned
    rows = df.collect()
    assert all((r.stream_start is None) == (r.taken == 0) for r in rows)


def test_last_step_holds_only_cut_copies(spark):
    from barspan.llm.op4_mixing import schedule

    got = schedule(spark.createDataFrame(corpus(), SCHEMA)).collect()
    late = [r for r in got if r.finish > 1 and r.stream_start is not None]
    assert len(late) <= len({r.source for r in got}) and all(0 < r.words < r["size"] for r in late)
    assert all(r.words == 0 for r in got if r.stream_start is None)


def test_empty_and_blank_tables(spark):
    assert taken(spark.createDataFrame([], SCHEMA)).count() == 0
    assert taken(spark.createDataFrame([(1, None, None, None, None), (2, " ", "x", "s", 1)], SCHEMA)).select("taken").distinct().collect() == [(0,)]
