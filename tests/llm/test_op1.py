import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from barspan.llm.op1_token_codes import DacBlock, Encoder, dac_encode, encode_documents, read_codes, tokens_at

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, block int"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def texts():
    rnd = random.Random(9)
    odd = ["", " ", "  ", "a  b", " a", "a ", "a\n b", "a \nb", "x\n", "x\n\t y", "don't I'll 12,5 km", "<|endoftext|> x", "a<|endoftext|>", "é ü ñ　日本 語\x1c z", " x   y", "a\r\n", "!!! ??", "ſK   q"]
    pieces = ["ab", "c'd", "é", "日本", "12", ".", "\n", "\t", " ", "X,", "'s", "\x1c", "<|", "🙂"]
    for _ in range(300):
        odd.append(rnd.choice(["", " "]).join(rnd.choice(pieces) + rnd.choice(["", " ", " ", "  ", "\n"]) for _ in range(rnd.randrange(30))))
    return odd


def test_encoder_equals_the_library(library):
    enc = Encoder(PATH)
    for _ in range(2):
        got = [ids.tolist() for ids in enc.encode(texts())]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts()]


def test_round_trip_and_random_access():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 513, 5000):
        ids = (rnd.integers(0, 2**32, n, dtype=np.uint64) >> rnd.integers(0, 32, n, dtype=np.uint64)).astype("<u4")
        block = DacBlock(dac_encode(ids))
        assert np.array_equal(block.decode(), ids)
        assert [block[i] for i in range(n)] == ids.tolist()


def test_documents_from_the_files(spark, library, monkeypatch, tmp_path):
    import barspan.llm.op1_token_codes as op

    monkeypatch.setattr(op, "BLOCK_TOKENS", 40)
    rows = [(i * 7 % 400, t, i) for i, t in enumerate(texts())] + [(1001, None, 0), (None, "no id", 1), (1002, "q " * 3000, 2), (1002, "q " * 3000, 2)]
    out = encode_documents(spark.createDataFrame(rows, SCHEMA), PATH, str(tmp_path / "codes")).collect()
    ids = {}
    want, at = [], 0
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        x = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        ids.setdefault(d, x)
        at += len(x)
    assert sorted(map(tuple, out), key=lambda r: r[1]) == want
    some = [(d, i) for d in (0, 7, 399, 1001) if d in ids for i in range(len(ids[d]) + 1)]
    got = tokens_at(read_codes(spark, str(tmp_path / "codes")), spark.createDataFrame(some, "doc_id long, i long")).collect()
    assert sorted(map(tuple, got)) == sorted((d, i, ids[d][i]) for d, i in some if i < len(ids[d]))


def test_empty_table(spark):
    assert encode_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0
