import random
import re

import public_tokenizers

from barspan.llm.op6_token_counts import MARK, Automaton, pieces_of, token_counts

DOC = "doc_id long, text string, n_words long"
PATH = public_tokenizers.path("piece_bpe_32k.model")


def greedy(vocab, word):
    text, n = MARK + word, 0
    longest = max(map(len, vocab))
    while text:
        k = next((k for k in range(min(len(text), longest), 0, -1) if text[:k] in vocab), 0)
        if not k:
            return -1
        text, n = text[k:], n + 1
    return n


def test_equals_greedy_longest_match_on_small_vocabularies():
    rnd = random.Random(6)
    for _ in range(60):
        letters = "abc"[: rnd.randrange(1, 4)]
        vocab = {MARK[: rnd.randrange(2)] + "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 6))) for _ in range(rnd.randrange(1, 14))}
        if rnd.random() < 0.7:
            vocab.add(MARK)
        a = Automaton(vocab)
        words = ["".join(rnd.choice(letters + "d" * (rnd.random() < 0.1)) for _ in range(rnd.randrange(1, 90))) for _ in range(60)]
        want = [greedy(vocab, w) for w in words]
        assert [a.count(w) for w in words] == want
        assert a.counts(words).tolist() == want


def test_documents_against_greedy(spark):
    vocab = set(pieces_of(PATH))
    texts = ["Hello world, this is unbelievable!", None, "", " \n", "ünïcödé 日本 🙂x Straße", "a" * 500 + " b", "Case case CASE", "x　y z"] + ["word " * 3000]
    rows = [(i, t, 9) for i, t in enumerate(texts)] + [(None, "no id", 9), (0, texts[0], 9)]
    got = sorted(map(tuple, token_counts(spark.createDataFrame(rows, DOC), PATH).collect()), key=str)
    want = []
    for d, t, _ in rows:
        n = [greedy(vocab, w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        want.append((d, len(n), sum(1 if k < 0 else k for k in n), sum(k < 0 for k in n)))
    assert got == sorted(want, key=str)
    assert token_counts(spark.createDataFrame([], DOC), PATH).count() == 0
