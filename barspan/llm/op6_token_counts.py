"""Word-piece token counts with a linear longest-match automaton.

A word is cut greedily into the longest pieces of a vocabulary. Instead of trying prefixes
again after every piece, the vocabulary's trie gets failure links: when no edge fits, the link
of a node leads to where the longest match goes on, and the node knows how many pieces are
popped on the way. Each character is read once, and since only counts are kept no piece is
ever built. A word with a part that no piece covers is one unknown token.

Pieces that begin a word carry ``mark`` in front; a word is read as ``mark`` + word. Words are
``[^\\x20\\x09-\\x0D]+`` with their case kept. Distinct words of a batch are counted once, in
lockstep over arrays; words longer than ``LOCKSTEP`` characters one by one.

Nulls: a null or empty text has no words and no tokens; a null id is returned. Repeated rows
give repeated rows. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspan.llm.common import modest_batches
from barspan.llm.textops import Words, text_chunks, tidy

LOCKSTEP = 64
MARK = "▁"


def pieces_of(path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece vocabulary: no control, unknown or byte piece."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    return [p.id_to_piece(i) for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]


class Automaton:
    """Trie with failure links and counts of popped pieces; node 0 is the root, -1 no node."""

    def __init__(self, pieces: Iterable[str], mark: str = MARK):
        self.mark = mark
        edges: list[dict[str, int]] = [{}]
        final = [False]
        for piece in pieces:
            at = 0
            for c in piece:
                to = edges[at].get(c)
                if to is None:
                    to = edges[at][c] = len(edges)
                    edges.append({})
                    final.append(False)
                at = to
            final[at] = at != 0
        self.edges = edges
        self.link = [-1] * len(edges)
        self.popped = [0] * len(edges)
        level = [0]
        while level:
            below = []
            for u in level:
                for c, v in edges[u].items():
                    below.append(v)
                    if final[v]:
                        self.link[v], self.popped[v] = 0, 1
                        continue
                    z, n = self.link[u], self.popped[u]
                    while z >= 0 and c not in edges[z]:
                        n += self.popped[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.popped[v] = edges[z][c], n
            level = below
        symbols = sorted({c for e in edges for c in e})
        self._symbol = np.full(0x110001, -1, np.int64)
        self._symbol[[ord(c) for c in symbols]] = np.arange(len(symbols))
        self._width = max(1, len(symbols))
        key = [u * self._width + int(self._symbol[ord(c)]) for u, e in enumerate(edges) for c in e]
        to = [v for e in edges for v in e.values()]
        order = np.argsort(key)
        self._key, self._to = np.append(np.array(key, np.int64)[order], np.iinfo(np.int64).max), np.append(np.array(to, np.int64)[order], -1)
        self._link, self._popped = np.array(self.link), np.array(self.popped)

    def count(self, word: str) -> int:
        """Pieces of one word; -1 if it is unknown."""
        at = n = 0
        for c in self.mark + word:
            while (to := self.edges[at].get(c)) is None:
                if self.link[at] < 0:
                    return -1
                n += self.popped[at]
                at = self.link[at]
            at = to
        while at:
            if self.link[at] < 0:
                return -1
            n += self.popped[at]
            at = self.link[at]
        return n

    def _step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = node * self._width + symbol
        place = np.searchsorted(self._key, key)
        return np.where((symbol >= 0) & (self._key[place] == key), self._to[place], -1)

    def counts(self, words: list[str]) -> np.ndarray:
        """Pieces of each word, -1 if unknown; all words advance one character at a time."""
        out = np.zeros(len(words), np.int64)
        size = np.array([len(w) for w in words], np.int64)
        for i in np.flatnonzero(size > LOCKSTEP).tolist():
            out[i] = self.count(words[i])
        order = np.flatnonzero(size <= LOCKSTEP)
        order = order[np.argsort(-size[order], kind="stable")]
        if not len(order):
            return out
        points = np.frombuffer("".join([self.mark + words[i] for i in order.tolist()]).encode("utf-32-le"), "<u4")
        length = size[order] + len(self.mark)
        begin = np.cumsum(length) - length
        node, n = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)

        def pop(which: np.ndarray) -> np.ndarray:
            """Follow the links of these words; those without one are unknown."""
            live = self._link[node[which]] >= 0
            node[which[~live]] = -1
            which = which[live]
            n[which] += self._popped[node[which]]
            node[which] = self._link[node[which]]
            return which

        for k in range(int(length[0])):
            active = np.flatnonzero(node[: np.searchsorted(-length, -k, side="left")] >= 0)
            symbol = self._symbol[points[begin[active] + k]]
            while len(active):
                to = self._step(node[active], symbol)
                fits = to >= 0
                node[active[fits]] = to[fits]
                rest, symbol = active[~fits], symbol[~fits]
                active = pop(rest)
                symbol = symbol[np.isin(rest, active, assume_unique=True)]
        active = np.flatnonzero(node > 0)
        while len(active):
            active = pop(active)
            active = active[node[active] > 0]
        out[order] = np.where(node < 0, -1, n)
        return out


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every document."""

    def run(batches):
        automaton = Automaton(pieces_of(vocabulary_path))
        for b in batches:
            cols = [np.zeros(0, np.int64)] * 3
            for _, raw, offsets in text_chunks(b.column("text")):
                words = Words(raw, offsets, lower=False)
                if len(words):
                    _, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
                    data = raw.tobytes()
                    spans = zip(words.begin[first].tolist(), words.length[first].tolist())
                    n = automaton.counts([data[a : a + k].decode() for a, k in spans])[inverse]
                else:
                    n = np.zeros(0, np.int64)
                tokens, unknown = np.append(0, np.cumsum(np.where(n < 0, 1, n))), np.append(0, np.cumsum(n < 0))
                new = [np.diff(words.of_doc), np.diff(tokens[words.of_doc]), np.diff(unknown[words.of_doc])]
                cols = [np.concatenate([c, x]) for c, x in zip(cols, new)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c) for c in cols]], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    modest_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(tidy(run), "doc_id long, n_words long, n_tokens long, n_unknown long")
