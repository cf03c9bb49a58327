"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array check.

A document's set holds its distinct ``k``-word shingles as 64-bit hashes. Two documents link
when ``den * |A & B| >= num * |A | B|``. Documents with equal sets form one class; classes
are joined like this:

* **Size bands.** Band ``c`` holds the classes of ``EDGES[c] <= n < EDGES[c + 1]`` and, as
  guests, the larger ones that may still link to one of them. A linked pair of a band differs
  in at most ``d`` shingles, so of ``d + 1 + spare`` slices of the hash range more than
  ``spare`` hold the same shingles in both sets. Each slice's content hash is a tile key, but a
  set leaves out its emptiest slices, up to ``spare`` of them and only whole size classes:
  what both leave out is then less than what they share, so no link is lost, and neither an
  empty slice nor a passage that many documents share brings them together.
* **Tiles.** A tile is the set of classes with one key; tiles with the same members are kept
  once. First every member is compared with the tile's hub (its smallest class), which joins
  a large group of copies by a star instead of by its pairs. Only tiles whose members are
  then still in different components are searched pair by pair, in blocks of ``BLOCK``
  classes, so no task holds an unbounded tile.
* **Bitmaps.** A class carries the parity of its hashes in ``8 n`` bits or more. The bits in which two
  bitmaps differ are a lower bound of the symmetric difference, hence an upper bound of the
  overlap; pairs that it rules out are never fetched.
* **Exact check.** Sorted arrays of the surviving pairs are intersected. The first searches
  check a spanning forest of what each tile's bitmaps allow, which is linear in the tile; the
  last one checks every pair that is left between components, so the result has no cap.

Nulls: a null or blank text has an empty set and links with nothing; a row with a null id
takes part and is returned. Repeated rows are returned as often as they come. Extra columns
are ignored. A hash collision of two different sets would need equal 64-bit values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspan.llm.common import components, written
from barspan.llm.textops import Words, mix, shingle_sets, text_chunks, tidy

#: Classes that one task compares with each other.
BLOCK = 4096
#: Searches that check a spanning forest of each tile before the one that checks all pairs left.
FORESTS = 2
#: Bits of a signature: a power of two of at least 8 n, within these bounds.
MIN_BITS, MAX_BITS = 2048, 65_536


def _edges() -> list[int]:
    out = [1]
    while out[-1] < 2**40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


EDGES = np.array(_edges(), dtype=np.int64)


def fingerprint(s: np.ndarray) -> int:
    """Class of a set: order-free, length included."""
    return int(mix(mix(s, 1).sum(keepdims=True) + np.uint64(len(s)), 2).view(np.int64)[0])


def tile_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Content hashes of all slices of a sorted set, in its own band and as a guest below."""
    n = len(s)
    own = int(np.searchsorted(EDGES, n, side="right")) - 1
    out = []
    for band in (own, own - 1):
        if band < 0:
            break
        top = int(EDGES[band + 1]) - 1
        if band < own and num * n > den * top:
            break
        most = (den - num) * top // num
        slices = most + 1 + (max(1, most // 4) if most else 0)
        part = ((s >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)  # rises with s
        bounds = np.searchsorted(part, np.arange(slices + 1, dtype=np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s, 3))])
        content = sums[bounds[1:]] - sums[bounds[:-1]]
        size = np.diff(bounds)
        spare = slices - 1 - (den - num) * min(n, top) // num
        full = np.flatnonzero(size >= np.sort(size)[spare])
        out.append(mix(content[full] + mix(full.astype(np.uint64), 4 + band)))
    return np.concatenate(out).view(np.int64)


def bitmap(s: np.ndarray) -> bytes:
    bits = MIN_BITS
    while bits < min(8 * len(s), MAX_BITS):
        bits *= 2
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for at, raw, offsets in text_chunks(batch.column("text")):
        for i, s in enumerate(shingle_sets(Words(raw, offsets), k)):
            yield at + i, s


def members(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, rid, n, cls, bits): ``rid`` names the text of a row, ``cls`` its set (null: empty)."""

    def run(batches):
        for batch in batches:
            n, cls, bits = [], [], []
            for _, s in _sets(batch, k):
                n.append(len(s))
                cls.append(fingerprint(s) if len(s) else None)
                bits.append(bitmap(s) if len(s) else None)
            cols = [batch.column("doc_id"), batch.column("rid")]
            cols += [pa.array(n, pa.int32()), pa.array(cls, pa.int64()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "rid", "n", "cls", "bits"])

    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).withColumn("rid", _rid())
    return src.mapInArrow(tidy(run), "doc_id long, rid long, n int, cls long, bits binary")


def _rid():
    return F.xxhash64("doc_id", "text")


def _keys(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(key, cls) of every slice; a task gives a class's keys once (again after a million others)."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            key, cls, rows = [], [], 0
            for _, s in _sets(batch, k):
                c = fingerprint(s) if len(s) else None
                if c is None or c in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(c)
                key.append(tile_keys(s, num, den))
                cls.append(np.full(len(key[-1]), c, dtype=np.int64))
                rows += len(key[-1])
                if rows >= 200_000:
                    yield _pairs(key, cls)
                    key, cls, rows = [], [], 0
            if rows:
                yield _pairs(key, cls)

    def _pairs(key, cls):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), pa.array(np.concatenate(cls))], ["key", "cls"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "key long, cls long")


def _arrays(docs: DataFrame, k: int) -> DataFrame:
    """(cls, shingles) of each row, the array as little-endian bytes."""

    def run(batches):
        for batch in batches:
            cls, arr, held = [], [], 0
            for _, s in _sets(batch, k):
                if len(s):
                    cls.append(fingerprint(s))
                    arr.append(s.tobytes())
                    held += s.nbytes
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(arr, pa.binary())], ["cls", "arr"])
                    cls, arr, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(arr, pa.binary())], ["cls", "arr"])

    return docs.select("text").mapInArrow(tidy(run), "cls long, arr binary")


def _tiles(keys: DataFrame) -> DataFrame:
    """(tile, cls, hub, m): tiles of two classes or more, those with equal members once."""
    of_key = Window.partitionBy("key")
    shared = (
        keys.withColumn("hub", F.min("cls").over(of_key))
        .withColumn("top", F.max("cls").over(of_key))
        .where("hub <> top")
        .dropDuplicates(["key", "cls"])
    )
    return (
        shared.withColumn("m", F.count(F.lit(1)).over(of_key))
        .withColumn("tile", F.xxhash64(F.bit_xor(F.xxhash64("cls")).over(of_key), "m", "hub", "top"))
        .select("tile", "cls", "hub", "m")
        .dropDuplicates(["tile", "cls"])
    )


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Parity bitmaps (rows of 64-bit words) folded to ``width`` words."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _stack(blobs: list[bytes]) -> np.ndarray:
    """Bitmaps of several widths as one matrix, folded to the narrowest."""
    width = min(map(len, blobs)) // 8
    return np.concatenate([_fold(np.frombuffer(b, np.uint64)[None, :], width) for b in blobs])


def _may_link(na, nb, differ, num: int, den: int):
    """Whether the overlap's upper bound still allows a link."""
    both = na + nb
    overlap = np.minimum((both - differ) // 2, np.minimum(na, nb))
    return den * overlap >= num * (both - overlap)


def _differ(x: bytes, y: bytes) -> int:
    """Bits in which two parity bitmaps differ, the wider one folded."""
    width = 8 * min(len(x), len(y))
    pair = []
    for blob in (x, y):
        v, bits = int.from_bytes(blob, "little"), 8 * len(blob)
        while bits > width:
            bits //= 2
            v = (v >> bits) ^ (v & ((1 << bits) - 1))
        pair.append(v)
    return (pair[0] ^ pair[1]).bit_count()


def _tile_pairs(side, cls, comp, n, blobs, one_block, num, den, forest):
    """(a, b, more) of one tile, or of two of its blocks.

    ``forest``: a pair that the pairs before it would join anyway is left out, so a tile of
    m classes gives fewer than m pairs, the most alike ones of each class first.
    """
    side, cls, comp, n = (np.array(v, np.int64) for v in (side, cls, comp, n))
    bits = None if len(cls) <= 8 else _stack(blobs)
    root = np.unique(comp, return_inverse=True)[1]
    left, right = (np.arange(len(cls)),) * 2 if one_block else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for i in left:
        j = right[(root[right] != root[i]) & (den * np.minimum(n[right], n[i]) >= num * np.maximum(n[right], n[i]))]
        if one_block:
            j = j[j > i]
        if not len(j):
            continue
        if bits is None:
            differ = np.array([_differ(blobs[i], blobs[x]) for x in j], np.int64)
        else:
            differ = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
        ok = _may_link(n[i], n[j], differ, num, den)
        j, differ = j[ok], differ[ok]
        if not len(j):
            continue
        if not forest:
            for x in j:
                yield int(cls[i]), int(cls[x]), False
            continue
        j = j[np.lexsort((differ, root[j]))]
        best = j[np.append(True, root[j][1:] != root[j][:-1])]
        for x in best:
            yield int(cls[i]), int(cls[x]), len(cls) > 2
        root[np.isin(root, root[best])] = root[i]


def _runs(batches, keys: list[str]):
    """Tables of the rows of one key, from batches sorted by the key; holds one key at a time."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
        cols = [t.column(k).to_numpy() for k in keys]
        fresh = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        at = 0
        for to in fresh.tolist():
            yield t.slice(at, to - at)
            at = to
        rest = t.slice(at)
    if rest is not None and rest.num_rows:
        yield rest


def _search(rows: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """Pairs ``a``, ``b``, ``more`` between different components of a tile that the bitmaps allow.

    ``rows``: tile, left, right (blocks), side, cls, comp, n, bits. ``more``: the tile may have further pairs.
    """
    keys = ["tile", "left", "right"]

    def batch_of(out):
        a, b, more = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(more, pa.bool_())], ["a", "b", "more"])

    def run(batches):
        out = []
        for t in _runs(batches, keys):
            v = t.to_pydict()
            out += _tile_pairs(v["side"], v["cls"], v["comp"], v["n"], v["bits"], v["left"][0] == v["right"][0], num, den, forest)
            if len(out) > 100_000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), "a long, b long, more boolean")


def _bounded(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs with n and bits of both sides whose bitmaps allow a link."""

    def run(batches):
        for b in batches:
            na, nb = b.column("na").to_numpy().astype(np.int64), b.column("nb").to_numpy().astype(np.int64)
            differ = np.empty(len(na), np.int64)
            for i, (x, y) in enumerate(zip(b.column("ba").to_pylist(), b.column("bb").to_pylist())):
                differ[i] = _differ(x, y)
            ok = _may_link(na, nb, differ, num, den)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return pairs.mapInArrow(tidy(run), "a long, b long")


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Exact links among the pairs: the texts of the classes concerned are hashed again."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    rids = classes.join(need, "cls").select("rid").distinct()
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).withColumn("rid", _rid())
    arrays = written(_arrays(texts.join(rids, "rid").dropDuplicates(["rid"]), k), "sets")  # rows alike in id and text once

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("xa"), b.column("xb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(den * common >= num * (len(both) - common))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(arrays.select(F.col("cls").alias("b"), F.col("arr").alias("xb")), "b")
    both = both.join(arrays.select(F.col("cls").alias("a"), F.col("arr").alias("xa")), "a")
    return both.select("a", "b", "xa", "xb").mapInArrow(tidy(run), "a long, b long").distinct()


def _unresolved(tiles: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of the tiles that still hold several components, dealt into blocks."""
    w = Window.partitionBy("tile")
    open_ = (
        tiles.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
        .withColumn("comp", F.coalesce("root", "cls"))
        .withColumn("lo", F.min("comp").over(w))
        .withColumn("hi", F.max("comp").over(w))
        .where("lo <> hi")
    )
    n_blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = open_.join(classes.select("cls", "n", "bits"), "cls").withColumn("blocks", n_blocks)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return dealt.withColumn("other", other).select(
        "tile",
        F.least("block", "other").alias("left"),
        F.greatest("block", "other").alias("right"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"),
        "cls",
        "comp",
        F.col("n").cast("long").alias("n"),
        "bits",
    )


def jaccard_components(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, rid, n_shingles, root, component_id): smallest id reachable by links of ``num / den`` or more."""
    if 3 * num < 2 * den or num > den:
        raise ValueError("bands are laid out for thresholds from 2/3 to 1")
    rows = written(members(docs, k), "members")
    classes = written(
        rows.where("cls is not null")
        .groupBy("cls")
        .agg(F.min("rid").alias("rid"), F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("bits").alias("bits")),
        "classes",
    )
    tiles = written(_tiles(_keys(docs, k, num, den)), "tiles")

    light = classes.select("cls", "n", "bits")
    stars = tiles.where("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()
    stars = stars.join(light.toDF("a", "na", "ba"), "a").join(light.toDF("b", "nb", "bb"), "b")
    links = written(_verify(written(_bounded(stars, num, den), "pairs"), classes, docs, k, num, den), "links")
    labels = components(links)

    for forest in (*[True] * FORESTS, False):
        found = written(_search(_unresolved(tiles, labels, classes), num, den, forest), "pairs")
        pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        total, more = found.agg(F.count(F.lit(1)), F.max("more")).first()
        if total:
            links = written(links.union(_verify(pairs, classes, docs, k, num, den)), "links")
            labels = components(links)
        if not more:
            break
        cut = found.where("more").select(F.col("a").alias("cls")).distinct()
        tiles = tiles.join(tiles.join(cut, "cls", "left_semi").select("tile").distinct(), "tile", "left_semi")

    return _spread(rows, classes, labels)


def _spread(rows: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    rooted = classes.select("cls", "doc_id").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "cls"))
    first = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = rooted.join(first, "root").select("cls", "root", "component_id")
    return rows.join(of_class, "cls", "left").select(
        "doc_id",
        "rid",
        F.col("n").alias("n_shingles"),
        "root",
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Documents with one row of each component: that of the smallest id (a null id comes last).

    Rows without words are all kept.
    """
    found = jaccard_components(docs.select("doc_id", "text"), k, num, den)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))["rid"]
    one = found.where("root is not null").groupBy("root").agg(best.alias("_rid")).select("_rid", F.lit(True).alias("_one"))
    blank = found.where("root is null").select(F.col("rid").alias("_rid"), F.lit(False).alias("_one")).distinct()
    rows = docs.withColumn("_rid", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    again = Window.partitionBy("_rid").orderBy("_rid")
    kept = rows.join(one.union(blank), "_rid").withColumn("_copy", F.row_number().over(again))
    return kept.where("not _one or _copy = 1").select(docs.columns)
