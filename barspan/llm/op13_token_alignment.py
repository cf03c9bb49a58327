"""Which tokens of two tokenizers cover the same bytes, with corpus-wide link counts.

A is a byte-level vocabulary of the ``tokenizers`` library, B a ``sentencepiece`` model that puts a
space in front; both read space + text. The character offsets of A and the byte spans of B's proto
(``return_type="proto"``, which replaced the immutable proto) give the ends of all tokens that end
with a character. Tokens that share a character, the pieces of a multi-byte character or of a byte
fallback, get their ends from their decoded bytes. Where tokens of both end, a group ends; an A and a
B token whose bytes overlap are linked.

Both tokenizers are blind across some cuts: A's pattern starts anew at the first white space after
another character and at the first punctuation after a letter, and no piece of B holds a space or line
break after another character, nor punctuation after a Latin letter. So a text is cut before each space
or line break that follows a character that is no white space, and before each ASCII punctuation that
follows a Latin letter; every distinct part of a task is aligned once, many parts joined into one call.
If B's vocabulary breaks the rule, whole texts are the parts.

Steps: (1) parts, alignment and the parts of each document, written to the shared folder as bundles;
(2) links counted per bundle, then summed per id pair over the corpus; (3) the sums go back to the
documents of the bundles. Sums of at most ``broadcast_pairs`` pairs are sent to the workers; beyond
that the links of each document are joined with the sums, where a pair that many documents hold is
spread over several tasks.

Nulls: a null or empty text has no tokens; neither has one whose tokens do not spell space + text
(a text with U+2581, for one), nor do its links count. A null id is returned. Repeated rows give
repeated rows and count each. An empty table gives no rows. Texts of any length are read whole. Extra
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspan.llm.common import LARGE_ROWS, written
from barspan.llm.textops import give_back, tidy

#: Characters joined into one call of a tokenizer; both slow down on longer texts.
CALL_BYTES = 1 << 12
#: Aligned parts that a task keeps for its next batches (about 300 bytes each); beyond that it starts anew.
KEPT_PARTS = 200_000
#: Bytes of text of one bundle; a longer document is a bundle of its own. A bundle is a row, and a row is in memory whole.
BUNDLE_BYTES = 1 << 20
#: Sums of more id pairs than this are joined instead of sent to every worker (16 bytes a pair).
BROADCAST_PAIRS = 2_000_000
#: Rows of one pair that meet in one task, in the joined form; more if else over ``HOT_PAIRS`` pairs had several copies.
PER_SALT = 50_000
HOT_PAIRS = 1_000_000

_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: A piece that spans a cut between a Latin letter and ASCII punctuation.
_SPANS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ][!-/:-@\[-`{-~]")
_ASCII_SPACE = np.zeros(256, dtype=bool)
_ASCII_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True

RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
BUNDLE = (
    "doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "doc_end array<int>, part array<int>, link_end array<int>, link array<int>, pair array<long>, pair_n array<long>"
)


def byte_of_symbol() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(0x100 + i): b for i, b in enumerate(rest)}}


class Spelling:
    """Bytes of every id, flat, and the strings the group digest is made of."""

    def __init__(self, pieces: list[bytes]):
        self.length = np.array([len(p) for p in pieces], np.int64)
        self._begin = np.cumsum(self.length) - self.length
        self._flat = np.frombuffer(b"".join(pieces), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        at = np.repeat(self._begin[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self._flat[at]


class Aligner:
    """Both tokenizers and the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = SentencePieceProcessor(model_file=b_path)
        symbols = byte_of_symbol()
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.a_spelt = Spelling([bytes(symbols[c] for c in n) if n is not None and all(c in symbols for c in n) else (n or "").encode() for n in names])
        b_names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_spelt = Spelling([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(b_names)])
        stages = json.loads(self.a.to_str())
        split = stages.get("pre_tokenizer") or {}
        self.cuts = (
            not stages.get("normalizer")
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not any("▁" in p.lstrip("▁") or "\n" in p or " " in p or _SPANS.search(p) for i, p in enumerate(b_names) if not self.b.is_control(i) and not self.b.is_unknown(i) and not self.b.is_byte(i))
        )
        #: Ids as text with what follows them in the digest.
        self._text = {c: [f"{i}{c}" for i in range(max(len(names), len(b_names)))] for c in ",|;"}

    def parts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the parts of the texts begin."""
        begins = offsets[:-1]
        if not self.cuts or len(raw) < 2:
            return np.unique(begins)
        at = np.flatnonzero((raw == 0x20) | (raw == 0x0A))
        at = at[at > 0]
        space = _ASCII_SPACE[raw[at - 1]]
        wide = np.flatnonzero(raw[at - 1] >= 0x80)
        if len(wide):
            one, two, three = (raw[np.maximum(at[wide] - k, 0)].astype(np.int64) for k in (1, 2, 3))
            two = (two << 8) | one
            three = (three << 16) | two
            space[wide] = np.isin(two, [0xC285, 0xC2A0]) | np.isin(three, [0xE19A80, 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]) | ((three >= 0xE28080) & (three <= 0xE2808A))
        starts = np.zeros(len(raw) + 1, bool)
        starts[at[~space]] = True
        latin = _LETTER[raw]
        latin[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        starts[1:-1] |= _PUNCTUATION[raw[1:]] & latin[:-1]
        starts[begins] = True
        return np.flatnonzero(starts[:-1])

    def _ends(self, coarse: np.ndarray, shared: np.ndarray | None, spelt: Spelling, ids: np.ndarray, size: int) -> np.ndarray:
        """Byte ends: the coarse ones, but from decoded bytes within a shared character."""
        ends = coarse
        if shared is not None and shared.any():
            ends = np.where(shared, np.cumsum(spelt.length[ids]), coarse)
        return ends if not len(ends) or ends[-1] == size else np.cumsum(spelt.length[ids])

    def _read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of space + text..., ids and ends of A and B) of a text that begins with a space."""
        raw = np.frombuffer(text.encode(), np.uint8)
        e = self.a.encode(text, add_special_tokens=False)
        a = np.array(e.ids, np.int64)
        if len(raw) == len(text):  # one byte a character: no token shares one
            a_end = self._ends(np.array([o[1] for o in e.offsets], np.int64), None, self.a_spelt, a, len(raw))
        else:
            points = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            place = points[np.array(e.offsets, np.int64).reshape(-1, 2)]
            shared = np.append(place[1:, 0] < place[:-1, 1], False)
            a_end = self._ends(place[:, 1], shared, self.a_spelt, a, len(raw))
        pieces = self.b.encode(text[1:], return_type="proto").pieces
        b = np.array([p.id for p in pieces], np.int64)
        stop = np.array([p.end for p in pieces], np.int64) + 1  # the space in front
        # the pieces of a byte fallback end where their character begins, or share its end
        byte = self.b_spelt.length[b] == 1
        shared = np.append(byte[:-1] & ((stop[:-1] == stop[1:]) | (np.diff(stop) != self.b_spelt.length[b[1:]])), False)[: len(b)]
        b_end = self._ends(stop, shared, self.b_spelt, b, len(raw))
        return raw, a, a_end, b, b_end

    def align(self, texts: list[str]) -> dict:
        """Per text: counts, digest text and links; ``ok`` where both spellings equal the text.

        Each text begins with a space, or is a part of a text (``parts``).
        """
        calls: list[list[int]] = []
        size, now = 0, []
        for i, t in enumerate(texts):
            alone = not self.cuts or t[-1:].isspace() or len(t) >= CALL_BYTES
            if now and (size + len(t) > CALL_BYTES or alone):
                calls.append(now)
                size, now = 0, []
            now.append(i)
            size += len(t)
            if alone:
                calls.append(now)
                size, now = 0, []
        if now:
            calls.append(now)
        out = {k: np.zeros(len(texts), np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
        ok, digest, links = np.zeros(len(texts), bool), [""] * len(texts), []
        calls.reverse()
        while calls:
            which = calls.pop()
            one = self._call([texts[i] for i in which])
            if one is None:
                if len(which) > 1:  # some text does not spell itself: look for it in halves
                    half = len(which) // 2
                    calls += [which[half:], which[:half]]
                continue
            ok[which] = True
            for k in out:
                out[k][which] = one[k]
            links.append(one["links"])
            for i, d in zip(which, one["digest"]):
                digest[i] = d
        return {**out, "ok": ok, "digest": digest, "links": np.concatenate(links) if links else np.zeros(0, np.int64)}

    def _call(self, texts: list[str]) -> dict | None:
        """Several texts in one call; None unless both spellings equal them and cut between them."""
        parts, real = [], []
        for t in texts:  # B drops the space it puts in front of nothing, and punctuation follows a letter
            if self.cuts and (not parts or t[0] not in " \n"):
                parts.append(" x")
                real.append(False)
            parts.append(t)
            real.append(True)
        bounds = np.cumsum([0] + [len(t.encode()) for t in parts])
        raw, a, a_end, b, b_end = self._read("".join(parts))
        for ids, ends, spelt in ((a, a_end, self.a_spelt), (b, b_end, self.b_spelt)):
            got = spelt.join(ids)
            if not np.array_equal(got, raw) or not np.array_equal(ends[np.searchsorted(ends, bounds[1:])], bounds[1:]):
                return None
        one = self._links(a, a_end, b, b_end, bounds)
        keep = np.array(real)
        one["links"] = one["links"][np.repeat(keep, one["n_links"])]
        one["digest"] = [d for d, r in zip(one["digest"], real) if r]
        return {k: v[keep] if k in ("n_a", "n_b", "n_groups", "n_links") else v for k, v in one.items()}

    def _links(self, a, a_end, b, b_end, bounds) -> dict:
        """Groups and links of one call, by part; parts begin and end where tokens of both do."""
        a_begin, b_begin = np.append(0, a_end)[:-1], np.append(0, b_end)[:-1]
        cut = a_end[b_end[np.searchsorted(b_end, a_end)] == a_end]  # both end with the text
        a_group, b_group = np.searchsorted(cut, a_end), np.searchsorted(cut, b_end)
        # B tokens that overlap an A token stand side by side
        first = np.searchsorted(b_end, a_begin, side="right")
        count = np.searchsorted(b_begin, a_end, side="left") - first
        left = np.repeat(np.arange(len(a)), count)
        right = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        links = (a[left] << 32) | b[right]
        a_part, b_part = np.searchsorted(bounds, a_end) - 1, np.searchsorted(bounds, b_end) - 1
        n = len(bounds) - 1
        # digest fragments in the order group, A before B
        tail_a, tail_b = np.append(np.diff(a_group) != 0, True), np.append(np.diff(b_group) != 0, True)
        group = np.concatenate([2 * a_group, 2 * b_group + 1])
        order = np.argsort(group, kind="stable")
        ids = np.concatenate([a, b])[order].tolist()
        kind = np.concatenate([np.where(tail_a, 1, 0), np.where(tail_b, 2, 0)])[order].tolist()
        table = [self._text[","], self._text["|"], self._text[";"]]
        pieces = [table[k][i] for k, i in zip(kind, ids)]
        per_part = np.bincount(a_part, minlength=n) + np.bincount(b_part, minlength=n)
        stop = np.cumsum(per_part).tolist()
        digest = ["".join(pieces[s:t]) for s, t in zip([0, *stop[:-1]], stop)]
        return {
            "n_a": np.bincount(a_part, minlength=n),
            "n_b": np.bincount(b_part, minlength=n),
            "n_groups": np.bincount(np.searchsorted(bounds, cut) - 1, minlength=n),
            "n_links": np.bincount(a_part[left], minlength=n),
            "links": links,
            "digest": digest,
        }


@functools.lru_cache(1)
def loaded(a_path: str, b_path: str) -> Aligner:
    """One per worker process: loading takes about a second."""
    return Aligner(a_path, b_path)


class Kept:
    """Aligned parts of a task, in flat arrays: the place of a part, its counts, digest and links."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self._clear()

    def _clear(self) -> None:
        self._place: dict[str, int] = {}
        self._numbers = {k: np.zeros(0, np.int64) for k in ("ok", "n_a", "n_b", "n_groups", "n_links")}
        self._digest: list[str] = []
        self._links = np.zeros(0, np.int64)

    def align(self, texts: list[str]) -> dict:
        if len(self._place) > KEPT_PARTS:
            self._clear()
        new = [t for t in texts if t not in self._place]
        if new:
            got = self.aligner.align(new)
            self._place.update(zip(new, range(len(self._digest), len(self._digest) + len(new))))
            self._numbers = {k: np.concatenate([v, got[k]]) for k, v in self._numbers.items()}
            self._digest += got["digest"]
            self._links = np.concatenate([self._links, got["links"]])
        at = np.fromiter(map(self._place.__getitem__, texts), np.int64, len(texts))
        out = {k: v[at] for k, v in self._numbers.items()}
        n = out["n_links"]
        first = (np.cumsum(self._numbers["n_links"]) - self._numbers["n_links"])[at]
        links = self._links[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return {**out, "digest": [self._digest[i] for i in at.tolist()], "links": links}


def _spread(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ends."""
    total = np.append(0, np.cumsum(values))[np.append(0, ends)]
    return np.diff(total)


def _bundles(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    schema = pa.schema(
        [(n, pa.list_(t)) for n, t in [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
         ("groups_sha256", pa.string()), ("doc_end", pa.int32()), ("part", pa.int32()), ("link_end", pa.int32()), ("link", pa.int32()), ("pair", pa.int64()), ("pair_n", pa.int64())]]
    )

    def bundle(kept, ids, empty, raw, offsets):
        begins = kept.aligner.parts(raw, offsets)
        spans = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(raw)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
        coded = spans.dictionary_encode()
        part = coded.indices.to_numpy().astype(np.int64)
        got = kept.align(coded.dictionary.to_pylist())
        doc_end = np.searchsorted(begins, offsets[1:])
        bad = (_spread(got["ok"][part] == 0, doc_end) > 0) | empty
        digest, sha, begin = got["digest"], [], 0
        for end, skip in zip(doc_end.tolist(), bad.tolist()):
            sha.append("" if skip else hashlib.sha256("".join([digest[p] for p in part[begin:end].tolist()])[:-1].encode()).hexdigest())
            begin = end
        used = np.repeat(~bad, np.diff(np.append(0, doc_end)))
        sums = [np.where(bad, 0, _spread(got[k][part], doc_end)) for k in ("n_a", "n_b", "n_groups", "n_links")]
        kept_end = np.cumsum(_spread(used, doc_end))
        row = [ids, *sums, sha, kept_end.astype(np.int32), part[used].astype(np.int32), np.cumsum(got["n_links"]).astype(np.int32)]
        pairs, link = np.unique(got["links"], return_inverse=True)
        times = np.repeat(np.bincount(part[used], minlength=len(got["n_links"])), got["n_links"])
        row += [link.astype(np.int32), pairs, np.bincount(link, weights=times, minlength=len(pairs)).astype(np.int64)]
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, f.type.value_type) if not isinstance(v, pa.Array) else v) for v, f in zip(row, schema)], schema=schema
        )

    def run(batches):
        kept = Kept(loaded(a_path, b_path))
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string()).fill_null("")
            empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            texts = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
            n, (_, offs, data) = len(texts), texts.buffers()
            if not n:
                continue
            offsets, raw = np.frombuffer(offs, np.int64, n + 1), np.frombuffer(data, np.uint8)
            at = 0
            while at < n:
                to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + BUNDLE_BYTES, side="right")) - 1))
                yield bundle(kept, batch.column("doc_id").slice(at, to - at), empty[at:to], raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                at = to
                give_back()

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(src.mapInArrow(tidy(run), BUNDLE), "aligned", LARGE_ROWS)


def _rows(batches):
    """Bundles as dictionaries of arrays."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {
                name: (lambda v: v if name in ("doc_id", "groups_sha256") else v.to_numpy())(batch.column(j)[i].values)
                for j, name in enumerate(batch.schema.names)
            }


def pair_counts(bundles: DataFrame) -> DataFrame:
    """(pair, n, top): links of each id pair over the corpus, and whether none of its B id has more."""
    per = bundles.select(F.explode(F.arrays_zip("pair", "pair_n")).alias("x")).select("x.pair", F.col("x.pair_n").alias("n")).where("n > 0")
    sums = written(per.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    top = sums.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
    return sums.withColumn("b", b_id).join(top, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("top"))


def _with_table(bundles: DataFrame, sums: DataFrame) -> DataFrame:
    """Sums sent to every worker; the caller has checked their number."""
    table = sums.toArrow()
    order = np.argsort(table.column("pair").to_numpy())
    held = bundles.sparkSession.sparkContext.broadcast(
        (table.column("pair").to_numpy()[order], table.column("n").to_numpy()[order], table.column("top").to_numpy(zero_copy_only=False)[order])
    )

    def run(batches):
        keys, n, top = held.value
        for b in _rows(batches):
            at = np.searchsorted(keys, b["pair"])
            at[at == len(keys)] = 0
            known = keys[at] == b["pair"] if len(keys) else np.zeros(len(at), bool)  # links of failed texts alone have no sum
            weight, best = np.zeros((2, len(at)), np.int64)
            weight[known], best[known] = n[at[known]], top[at[known]]
            weight, best = (_spread(v[b["link"]], b["link_end"]) for v in (weight, best))
            cols = [b["doc_id"], *[pa.array(b[k]) for k in ("n_a", "n_b", "n_groups", "n_links")]]
            cols += [pa.array(_spread(v[b["part"]], b["doc_end"])) for v in (best, weight)] + [b["groups_sha256"]]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return bundles.drop("pair_n").mapInArrow(tidy(run), RESULT)


def _with_join(bundles: DataFrame, sums: DataFrame, per_salt: int) -> DataFrame:
    """Links of each document joined with the sums; a pair that many documents hold has several copies."""
    keyed = written(bundles.select(F.expr("uuid()").alias("bundle"), "*"), "aligned-keyed", LARGE_ROWS)

    def explode(batches):
        for batch in batches:
            names = batch.schema.names
            ids = batch.column(names.index("bundle")).to_pylist()
            for key, b in zip(ids, _rows([batch.select([x for x in names if x != "bundle"])])):
                size = np.diff(np.append(0, b["link_end"]))
                first = np.append(0, b["link_end"])[:-1]
                for d, (s, t) in enumerate(zip(np.append(0, b["doc_end"])[:-1], b["doc_end"])):
                    part = b["part"][s:t]
                    n = size[part]
                    at = np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    pairs, times = np.unique(b["pair"][b["link"][at]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(pairs), pa.string()), pa.array(np.full(len(pairs), d, np.int32)), pa.array(pairs), pa.array(times)], ["bundle", "place", "pair", "times"])

    links = written(keyed.select("bundle", "doc_end", "part", "link_end", "link", "pair").mapInArrow(tidy(explode), "bundle string, place int, pair long, times long"), "doc-links")
    held = links.groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    salts = F.ceil(F.col("docs") / F.lit(max(per_salt, links.count() // HOT_PAIRS + 1))).cast("int")
    table = sums.join(held, "pair").withColumn("salts", salts)
    hot = table.where("salts > 1").select("pair", "salts")
    spread = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("pair", "salt", "n", "top")
    # sum of docs = number of links, so at most HOT_PAIRS pairs are hot
    salted = links.join(F.broadcast(hot), "pair", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("bundle", "place"), F.col("salts")), F.lit(0)).cast("int"))
    got = salted.join(spread, ["pair", "salt"]).groupBy("bundle", "place").agg(
        F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = keyed.select("bundle", F.posexplode(F.arrays_zip(*cols)).alias("place", "d")).select("bundle", "place", *[F.col("d")[c].alias(c) for c in cols])
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return rows.join(got, ["bundle", "place"], "left").select(*cols[:-1], *zero, "groups_sha256")


def align(docs: DataFrame, a_path: str, b_path: str, broadcast_pairs: int = BROADCAST_PAIRS, per_salt: int = PER_SALT) -> DataFrame:
    """Per document: tokens, groups and links of both tokenizers and the corpus-wide weight of its links."""
    bundles = _bundles(docs, a_path, b_path)
    sums = written(pair_counts(bundles), "pair-tops")
    return _with_table(bundles, sums) if sums.count() <= broadcast_pairs else _with_join(bundles, sums, per_salt)
