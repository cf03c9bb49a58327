import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from barspan.llm import op13_token_alignment as op13

DOC = "doc_id long, text string, n_a long, pair long"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """Every pair of tokens of every whole text compared by its bytes."""
    a_tok, b_tok, symbols = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), op13.byte_of_symbol()
    a_tok.encode_special_tokens = True
    found = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_tok.encode(text or "")
        a_bytes = [bytes(symbols[c] for c in a_tok.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            found.append(([], [], []))
            continue
        spans = []
        for parts in (a_bytes, b_bytes):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            spans.append(out)
        links, j0 = [], 0
        for i, (s, e) in zip(a, spans[0]):
            while spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(b) and spans[1][j][0] < e:
                links.append((i, b[j]))
                j += 1
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, i, j = [], 0, 0
        for c in cuts:
            ga, gb = [], []
            while i < len(a) and spans[0][i][1] <= c:
                ga.append(a[i])
                i += 1
            while j < len(b) and spans[1][j][1] <= c:
                gb.append(b[j])
                j += 1
            groups.append((ga, gb))
        found.append((a, b, [links, groups]))
    count = Counter(p for _, _, g in found if g for p in g[0])
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    rows = []
    for a, b, g in found:
        links, groups = g or ([], [])
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(a), len(b), len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(line.encode()).hexdigest() if a else ""))
    return rows


TEXTS = [
    "Hello world, it's unbelievable!", None, "", " ", "  two  spaces ", "line\nbreaks\n\n and\t tabs \n", "日本語のテキスト 🙂🙃x ünïcödé Ελληνικά Привет",
    "U+2581 ▁ here", "<|endoftext|> <s> </s> <0x0A> [INST]", "a" * 5000, "nbsp  and　 wide\x1c sep   ls", "\u0000nul", "​﻿\U0010ffff", "The the The the",
    "\n", "\nstart", "end \n", "क्षत्रिय ไทย עברית 👩‍👩‍👧", "'s 've'll 12,345.678 $%&*", "é" * 300, "퟿ x",
]


def rows_of(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=str)


def test_equals_all_pairs_by_both_ways_home(spark, monkeypatch):
    rnd = random.Random(13)
    letters = ["a", "the", " ", "  ", "\n", "é", "日", "🙂", "▁" if rnd.random() < 0.5 else "x", "-", "12", " ", "\t", "ing"]
    texts = TEXTS + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(300)] + [" ".join(rnd.choice(["the", "of", "and", "größe", "naïve"]) for _ in range(20_000))]
    rows = [(i, t, 7, 7) for i, t in enumerate(texts)] + [(None, "no id", 7, 7), (0, texts[0], 7, 7)]
    want = sorted(((r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows]))), key=str)
    docs = spark.createDataFrame(rows, DOC)
    assert rows_of(op13.align(docs, A, B)) == want
    monkeypatch.setattr(op13, "CALL_BYTES", 40)
    aligner = op13.Aligner(A, B)
    assert aligner.cuts
    assert rows_of(op13.align(docs, A, B, broadcast_pairs=0, per_salt=3)) == want


def test_whole_texts_where_the_vocabulary_allows_no_cut():
    aligner = op13.Aligner(A, B)
    cut = aligner.align([" " + t for t in TEXTS if t])
    aligner.cuts = False
    whole = aligner.align([" " + t for t in TEXTS if t])
    for k in ("n_a", "n_b", "n_groups", "n_links", "ok"):
        assert cut[k].tolist() == whole[k].tolist()
    assert cut["digest"] == whole["digest"]


def test_what_a_reader_takes_at_once_is_bounded(spark):
    """A row holds the parts of a megabyte of text, a row group and a page a few rows, however many a task writes."""
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 6))) for _ in range(20_000)]
    texts = [" ".join(rnd.choice(words) for _ in range(50_000)) for _ in range(24)]
    sizes = [len(t) + 1 for t in texts]
    docs = spark.createDataFrame([(i, t, 7, 7) for i, t in enumerate(texts)], DOC).coalesce(1)
    bundles = op13._bundles(docs, A, B)
    ids = [d for r in bundles.select("doc_id").collect() for d in [r.doc_id]]
    assert sorted(d for b in ids for d in b) == list(range(24))
    assert max(sum(sizes[d] for d in b) for b in ids) <= 1 << 20
    groups = []
    for name in bundles.inputFiles():
        meta = pq.ParquetFile(name.removeprefix("file:")).metadata
        groups += [meta.row_group(i) for i in range(meta.num_row_groups)]
    assert max(g.total_byte_size for g in groups) <= 6 << 20
    assert sum(g.num_rows for g in groups) == len(ids)


def test_empty_table(spark):
    assert op13.align(spark.createDataFrame([], DOC), A, B).count() == 0


@pytest.mark.parametrize("name", ["op13_token_alignment"])
def test_registered_query(spark, sf_dir, name):
    from barspan.llm.queries import QUERIES

    got = rows_of(QUERIES[name](spark, sf_dir))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert got == sorted(((d.doc_id, *w) for d, w in zip(docs, brute([d.text for d in docs]))), key=str)
