"""The corpus pipeline, stage by stage, against brute-force versions on a small corpus."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_op4 import brute as brute_mix
from test_op5 import clean, junk
from test_op9 import brute as brute_near

import corpus_pipeline as cp

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(12)
    item = clean(rnd)
    rows, labels = [], []
    for i in range(400):
        good = rnd.random() < 0.8
        text = ". ".join((clean if good else junk)(rnd) for _ in range(rnd.randrange(1, 5)))
        rows.append((i, text, "en", rnd.choice(["big", "big", "big", "b", "c", None]), len(text)))
        if i % 2:
            labels.append((i, int(good), 0))
    for i in range(400, 440):  # near copies: one word changed at the end
        text = rows[rnd.randrange(100)][1] + " again"
        rows.append((i, text, "en", "b", len(text)))
    leak = clean(rnd) + " " + item + " " + clean(rnd)
    rows += [(440, leak, "en", "c", len(leak)), (441, None, None, None, None), (442, "", "en", "b", 0), (0, rows[0][1], "en", rows[0][3], rows[0][4])]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOC).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, dict((d, q) for d, q, _ in labels)


def test_stages(spark, corpus):
    folder, rows, labels = corpus
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "decontamination", "mixture", "token_files"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, folder)
        if name != "token_files":
            assert out.schema.names == docs.schema.names
            docs = cp.written(out, name)
            kept[name] = [tuple(r) for r in docs.collect()]
        else:
            tokens = out.collect()

    first = {r[0] for r in kept["quality"]}
    assert np.mean([(d in first) == bool(q) for d, q in labels.items()]) > 0.9
    assert 440 in first

    # the second stage: one of each group of its own input
    pairs = [(r[0], r[1]) for r in kept["quality"]]
    group = {d: c for d, _, c in brute_near(pairs, 5, 80, 100)}
    wordless = [d for d, t in pairs if not re.search(r"[^\x20\x09-\x0D]", t or "")]
    want = sorted({c for d, c in group.items() if d not in wordless} | set(wordless), key=str)
    assert sorted((r[0] for r in kept["near_duplicates"]), key=str) == want

    assert {r[0] for r in kept["near_duplicates"]} - {r[0] for r in kept["decontamination"]} == {440}

    words = {}
    for r in kept["mixture"]:
        words[r[3]] = words.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        assert r[4] is None or r[4] == len(r[1])
    mixed = {}
    for _, _, s, _, _, t in brute_mix(kept["decontamination"]):
        mixed[s] = mixed.get(s, 0) + t
    assert words == {s: n for s, n in mixed.items() if n}

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, expected = 0, []
    for r in sorted(kept["mixture"], key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, tokens), key=lambda r: r[1]) == expected


def test_run_is_the_stages_and_reruns_agree(spark, corpus):
    folder = corpus[0]
    a = sorted(map(tuple, cp.run(spark, folder).collect()), key=str)
    assert a == sorted(map(tuple, cp.run(spark, folder).collect()), key=str) and len(a) > 300
