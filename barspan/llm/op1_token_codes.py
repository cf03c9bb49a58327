"""Token ids as directly addressable codes, in files ordered by document id.

File format: Parquet rows, one per block of whole documents with about ``BLOCK_TOKENS`` ids
(a longer document is a block of its own): ``part`` and ``block`` (order of the files),
``doc_ids``, ``doc_tokens`` (ids per document) and ``payload``. A payload is little-endian:

* ``b"DAC1"``, u32 number of ids, u32 number of levels;
* per level: u32 chunk bits (8 or 16), u32 entries, the chunks (low bits first), the
  continuation bitmap (bit i: entry i goes on in the next level; bits from the low end,
  padded to 64) and the rank directory (u32: set bits before each ``RANK_BITS`` bits).

Chunk 0 of every id stands in level 0 at the id's own index; the chunk an entry continues
with stands in the next level at the entry's rank among the continued ones. So any id is read
with one look per level and nothing else of the block is decoded.

Nulls and ties: a null text is empty and gives the end id alone; a null id sorts first; rows
of one id follow each other by text. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspan.llm.common import modest_batches, shared_dir
from barspan.llm.textops import mix, powers, tidy

END_ID = 2
BLOCK_TOKENS = 1 << 17
#: Chunk widths of the levels: together 32 bits.
LEVELS = (8, 8, 16)
RANK_BITS = 512
#: Distinct words whose ids a task remembers before it starts anew.
MEMO = 1_000_000
#: Characters of text encoded together.
GROUP_CHARS = 1 << 19

_MAGIC = b"DAC1"
FILE_SCHEMA = "part int, block int, doc_ids array<long>, doc_tokens array<long>, payload binary"


def dac_encode(ids: np.ndarray) -> bytes:
    rest = ids.astype(np.uint32)
    levels = []
    for bits in LEVELS:
        chunk = (rest & np.uint32((1 << bits) - 1)).astype(f"<u{bits // 8}")
        rest = rest >> np.uint32(bits)
        goes_on = rest > 0
        packed = np.packbits(goes_on, bitorder="little").tobytes()
        packed += b"\0" * (-len(packed) % 8)
        inside = np.add.reduceat(goes_on, np.arange(0, len(goes_on), RANK_BITS), dtype=np.uint32) if len(goes_on) else []
        rank = np.concatenate([[0], np.cumsum(inside)[:-1]]) if len(inside) else np.zeros(0)
        levels.append(struct.pack("<II", bits, len(chunk)) + chunk.tobytes() + packed + rank.astype("<u4").tobytes())
        rest = rest[goes_on]
        if not len(rest):
            break
    return b"".join([_MAGIC, struct.pack("<II", len(ids), len(levels)), *levels])


class DacBlock:
    """Reader of a payload; ``block[i]`` touches one entry per level."""

    def __init__(self, payload: bytes):
        if payload[:4] != _MAGIC:
            raise ValueError("not a DAC1 payload")
        self.n, n_levels = struct.unpack_from("<II", payload, 4)
        self._levels, at = [], 12
        for _ in range(n_levels):
            bits, n = struct.unpack_from("<II", payload, at)
            chunk = np.frombuffer(payload, f"<u{bits // 8}", n, at + 8)
            at += 8 + chunk.nbytes
            bitmap = np.frombuffer(payload, np.uint8, -(-n // 64) * 8, at)
            at += bitmap.nbytes
            rank = np.frombuffer(payload, "<u4", -(-n // RANK_BITS), at)
            at += rank.nbytes
            self._levels.append((bits, chunk, bitmap, rank))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for bits, chunk, bitmap, rank in self._levels:
            value |= int(chunk[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            first = i // RANK_BITS
            before = bitmap[first * RANK_BITS // 8 : i >> 3]
            part = int(bitmap[i >> 3]) & ((1 << (i & 7)) - 1)
            i = int(rank[first]) + int(np.bitwise_count(before).sum()) + part.bit_count()
            shift += bits
        return value

    def decode(self) -> np.ndarray:
        """All ids, little-endian 32-bit."""
        out = np.zeros(self.n, "<u4")
        place, shift = np.arange(self.n), 0
        for bits, chunk, bitmap, _ in self._levels:
            out[place] |= chunk.astype(np.uint32) << np.uint32(shift)
            place = place[np.unpackbits(bitmap, count=len(chunk), bitorder="little").astype(bool)]
            shift += bits
        return out


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def _classes() -> np.ndarray:
    """Class of the code points that are split here: 1 letter, 2 number, 3 other, 4 white space, 0 not handled."""
    kind = np.zeros(_TOP + 1, np.uint8)
    for c in [*range(0x21, 0x7F), *range(0xA1, 0x250), *range(0x370, 0x500), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]:
        major = unicodedata.category(chr(c))[0]
        if unicodedata.category(chr(c)) != "Cn":
            kind[c] = {"L": 1, "N": 2}.get(major, 3)
    kind[0x27] = 0  # an apostrophe may begin a contraction
    kind[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0]] = 4
    return kind


_TOP = 0x2060
_KIND = _classes()
_LETTER = mix(np.arange(_TOP + 1, dtype=np.uint64), 11) | np.uint64(1)


class Encoder:
    """Whole texts to ids with the tokenizers library.

    A byte-level vocabulary splits a text into words before it merges bytes. For texts of
    Latin, Greek and Cyrillic script without double white space the split is done here on
    arrays of code points, and the library's model encodes each distinct word once (words are
    told apart by a 64-bit hash and their length). All other texts, and all texts under a
    vocabulary of another kind, go through the library as they are.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        spec = json.loads(self._tok.to_str())
        self._added = [t["content"] for t in spec["added_tokens"]]
        pre = spec["pre_tokenizer"] or {}
        self._split = (
            spec["model"]["type"] == "BPE"
            and not spec["normalizer"]
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
        )
        self._alphabet = byte_alphabet()
        self._model = self._tok.model.tokenize
        self._forget()

    def _forget(self) -> None:
        self._known, self._at, self._n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._pool = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Remember the ids of new words; ``hashes`` ascending."""
        ids: list[int] = []
        sizes = []
        for w in words:
            tokens = self._model(w.encode().decode("latin-1").translate(self._alphabet))
            ids += [t.id for t in tokens]
            sizes.append(len(tokens))
        n = np.array(sizes, np.int64)
        place = np.searchsorted(self._known, hashes)
        self._at = np.insert(self._at, place, len(self._pool) + np.cumsum(n) - n)
        self._n = np.insert(self._n, place, n)
        self._known = np.insert(self._known, place, hashes)
        self._pool = np.concatenate([self._pool, np.array(ids, np.uint32)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        whole = [i for i, t in enumerate(texts) if t and (not self._split or any(a in t for a in self._added))]
        rest = sorted({i for i, t in enumerate(texts) if t} - set(whole))
        if rest:
            points = np.frombuffer("".join([texts[i] for i in rest]).encode("utf-32-le"), "<u4")
            ends = np.cumsum([len(texts[i]) for i in rest])
            starts = np.append(0, ends[:-1])
            kind = _KIND[np.minimum(points, _TOP)]
            blank = kind == 4
            bad = kind == 0
            double = blank[1:] & blank[:-1]
            double[ends[:-1] - 1] = False
            bad[1:] |= double
            odd = np.add.reduceat(bad, starts) > 0
            whole += [i for i, b in zip(rest, odd) if b]
            good = np.flatnonzero(~odd)
            if len(good):
                if odd.any():
                    points = points[np.repeat(~odd, ends - starts)]
                sizes = (ends - starts)[good]
                for i, ids in zip(good, self._words(points, sizes)):
                    out[rest[i]] = ids
        for i, e in zip(whole, self._tok.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.uint32)
        return out

    def _words(self, points: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Ids of the texts whose code points stand one after another."""
        kind = _KIND[points]
        fresh = np.empty(len(points), bool)
        fresh[1:] = (kind[1:] != kind[:-1]) & (points[:-1] != 0x20)
        ends = np.cumsum(sizes)
        fresh[ends - sizes] = True
        begin = np.flatnonzero(fresh)
        length = np.diff(np.append(begin, len(points)))
        place = np.arange(len(points)) - np.repeat(begin, length)
        terms = _LETTER[points] * powers(int(length.max()))[place]
        hashes = mix(np.add.reduceat(terms, begin) + length.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._known) > MEMO:
            self._forget()
        found = np.searchsorted(self._known, distinct)
        new = np.ones(len(distinct), bool)
        inside = found < len(self._known)
        new[inside] = self._known[found[inside]] != distinct[inside]
        if new.any():
            at, n = begin[first[new]], length[first[new]]
            flat = points.tobytes().decode("utf-32-le")
            self._learn(distinct[new], [flat[a : a + k] for a, k in zip(at.tolist(), n.tolist())])
            found = np.searchsorted(self._known, distinct)
        at, n = self._at[found][inverse], self._n[found][inverse]
        total = np.cumsum(n)
        ids = self._pool[np.arange(total[-1]) + np.repeat(at - (total - n), n)]
        of_text = np.append(0, total)[np.searchsorted(begin, np.append(0, ends))]
        return [ids[a:b] for a, b in zip(of_text[:-1], of_text[1:])]


def write_codes(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID) -> None:
    """Encode every text, append ``end_id`` and write the blocks in ascending id order."""
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        block, ids, docs_, counts, held, part = 0, [], [], [], 0, None

        def flush():
            nonlocal block, ids, docs_, counts, held
            row = [[part], [block], [docs_], [counts], [dac_encode(np.concatenate(ids))]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            block, ids, docs_, counts, held = block + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, kinds)], ["part", "block", "doc_ids", "doc_tokens", "payload"]
            )

        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            at = 0
            while at < len(doc_ids):
                group, chars = [], 0
                while at + len(group) < len(doc_ids) and chars < GROUP_CHARS:
                    group.append(texts[at + len(group)].as_py() or "")
                    chars += len(group[-1])
                for d, b in zip(doc_ids[at : at + len(group)], encoder.encode(group)):
                    n = len(b) + 1
                    if held and held + n > BLOCK_TOKENS:
                        yield flush()
                    ids += [b, end]
                    docs_.append(d)
                    counts.append(n)
                    held += n
                at += len(group)
        if docs_:
            yield flush()

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    modest_batches(docs.sparkSession)
    ordered = src.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.withColumn("part", F.spark_partition_id()).mapInArrow(tidy(run), FILE_SCHEMA).write.parquet(path)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def block_starts(blocks: DataFrame) -> DataFrame:
    """(part, block, block_start): ids before each block. One row per file part meets in one task."""
    sizes = blocks.select("part", "block", F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(parts, "part").select(
        "part", "block", (F.col("part_start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("block_start")
    )


def documents_of(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, counts = DacBlock(row["payload"]).decode(), row["doc_tokens"]
                ends = np.cumsum(counts)
                starts = ends - counts
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                n = len(counts)
                cols = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32())]
                cols += [pa.array(v, pa.int64()) for v in (row["doc_ids"], starts, counts, crc)]
                yield pa.RecordBatch.from_arrays(cols, ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = blocks.mapInArrow(tidy(run), "part int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(block_starts(blocks), ["part", "block"]).select(
        "doc_id", (F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def tokens_at(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Random access: ids at (doc_id, i) pairs, read without decoding their blocks.

    Places beyond a document's end give no row; a repeated id gives a row for each of its documents.
    """
    place = blocks.select("part", "block", F.posexplode(F.arrays_zip("doc_ids", "doc_tokens")).alias("k", "d"), "doc_tokens")
    place = place.select(
        "part",
        "block",
        F.col("d.doc_ids").alias("doc_id"),
        F.col("d.doc_tokens").alias("n"),
        F.aggregate(F.slice("doc_tokens", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda a, x: a + x).alias("inside"),
    )
    found = wanted.select("doc_id", F.col("i").cast("long").alias("i")).join(place, "doc_id").where("i >= 0 and i < n")

    def run(key, left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"doc_id": [], "i": [], "token": []}).astype("int64")
        block = DacBlock(bytes(right["payload"].iloc[0]))
        left["token"] = [block[int(p)] for p in left["inside"] + left["i"]]
        return left[["doc_id", "i", "token"]]

    found = found.select(F.col("part").alias("p"), F.col("block").alias("b"), "doc_id", "i", "inside")
    held = blocks.select(F.col("part").alias("p"), F.col("block").alias("b"), "payload")
    return found.groupBy("p", "b").cogroup(held.groupBy("p", "b")).applyInPandas(run, "doc_id long, i long, token long")


def encode_documents(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write the files (to the shared folder unless ``path`` is given) and report what they hold."""
    path = path or shared_dir(docs.sparkSession, "token-codes")
    write_codes(docs, tokenizer_path, path)
    return documents_of(read_codes(docs.sparkSession, path))
