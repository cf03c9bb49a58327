"""Benchmark decontamination by template windows with a check of the slots.

Texts become sequences of tokens (runs of letters or of digits, A-Z folded). In a template the
numbers (digits and number words), the units after a number and the names (capitalised words
inside a sentence) are typed placeholders; neighbouring tokens of one number or one name are
one slot. In a second kind of template a capitalised word that opens a sentence is a name too.
Windows of ``WINDOW`` tokens of documents and benchmark items are joined by hash, as plain tokens
and as both kinds of templates; an item that is shorter than a window in one of these views is a
window there.

Joined windows with the same distance between their places lie on one alignment of a document
with an item. Template windows count only if the alignment's slots are consistent. Every name of
the item stands for one name of the document and the reverse. Numbers and units coincide by
chance, so of their places more than half must fit a mapping in one direction, from the item's
values to the document's or back. So a question with other numbers and names is found, and a
text that merely has the same shape is not. An
alignment is a leak if its windows cover ``MIN_TOKENS`` tokens or half of the item as its view
counts them.

Documents are read once. A Bloom filter of fixed size over the benchmark's windows keeps the
windows of clean text from being shuffled; the join after it is exact.

Nulls: null and empty texts, and items without tokens, match nothing; a null ``doc_id`` or
``item_id`` takes part. Windows with less than half plain tokens are too general and are left
out. Repeated rows give the same result once. Empty tables give none. Extra columns are
ignored, and ``decontaminated`` returns them untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspan.llm.common import written
from barspan.llm.textops import Words, mix, text_chunks, tidy, windows

WINDOW = 8
MIN_TOKENS = 13
#: Bits of the filter that is broadcast: 2 MB.
FILTER_BITS = 1 << 24

# Words that count as numbers and units.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half"
).split()
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles meter meters metre metres mg g kg lb lbs oz pound pounds "
    "gram grams ton tons tonne tonnes ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes "
    "h hr hour hours day days week weeks month months year years mph kmh degree degrees percent cent cents dollar dollars usd "
    "euro euros eur pence watt watts kw volt volts amp amps hz khz mb gb tb"
).split()
PLAIN, NUMBER, NAME, UNIT = 0, 1, 2, 3

_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n:")] = True


def _hash_of(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.unique(Words(raw, np.array([0, len(raw)])).hashes())


_NUMBER_HASHES, _UNIT_HASHES = _hash_of(NUMBER_WORDS), _hash_of(UNITS)
_SLOT = mix(np.arange(4, dtype=np.uint64), 77)


class Tokens:
    """Views of a piece of texts: 0 plain, 1 templates, 2 templates with names that open a sentence."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        kind = _KIND[raw]
        breaks = np.zeros(len(raw), bool)
        breaks[1:] = kind[1:] != kind[:-1]
        words = Words(np.where(kind > 0, raw, 0x20).astype(np.uint8), offsets, breaks)
        self.plain, self.of_doc = words.hashes(), words.of_doc
        n = len(words)
        begin, doc = words.begin, np.repeat(np.arange(len(offsets) - 1), np.diff(words.of_doc))
        stops = np.append(0, np.cumsum(_STOP[raw]))
        opens = np.ones(n, bool)
        opens[1:] = (doc[1:] != doc[:-1]) | (stops[begin[1:]] != stops[begin[:-1]])
        first = raw[begin] if n else np.zeros(0, np.uint8)
        second = raw[np.minimum(begin + 1, len(raw) - 1)] if n else first
        upper = (first >= 65) & (first <= 90)
        titled = upper & (words.length > 1) & ~((second >= 65) & (second <= 90))
        number = ((first >= 48) & (first <= 57)) | np.isin(self.plain, _NUMBER_HASHES)
        follows = np.zeros(n, bool)
        follows[1:] = number[:-1] & (doc[1:] == doc[:-1])
        unit = follows & ~number & np.isin(self.plain, _UNIT_HASHES)
        self.views = [Sequence(self.plain, self.of_doc)]
        for names in (titled & ~opens, titled):
            kinds = np.where(number, NUMBER, np.where(unit, UNIT, np.where(names, NAME, PLAIN))).astype(np.int8)
            fresh = np.ones(n, bool)
            fresh[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == PLAIN) | (kinds[1:] == UNIT) | (doc[1:] != doc[:-1])
            fresh |= opens & (kinds == NAME)
            at = np.flatnonzero(fresh)  # first word of each template token
            place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
            values = np.add.reduceat(mix(self.plain + place.astype(np.uint64)), at) if n else self.plain
            template = np.where(kinds[at] == PLAIN, self.plain[at], _SLOT[kinds[at]])
            self.views.append(Sequence(template, np.searchsorted(at, self.of_doc), kinds[at], values))


class Sequence:
    """Tokens of one view with offsets per document; templates have kinds and values too."""

    def __init__(self, tokens: np.ndarray, of_doc: np.ndarray, kinds: np.ndarray | None = None, values: np.ndarray | None = None):
        self.tokens, self.of_doc, self.kinds, self.values = tokens, of_doc, kinds, values

    def windows(self, view: int, size: int):
        """(place, document, position, hash) arrays."""
        h = windows(self.tokens, size)
        doc = np.repeat(np.arange(len(self.of_doc) - 1), np.diff(self.of_doc))[: len(h)]
        last = np.arange(len(h)) + size - 1
        ok = last < self.of_doc[1:][doc] if len(h) else np.zeros(0, bool)
        if self.kinds is not None:
            slots = np.append(0, np.cumsum(self.kinds != PLAIN))
            inside = slots[last + 1] - slots[np.arange(len(h))]
            ok &= (inside > 0) & (2 * inside <= size)  # without a slot the plain window says the same
        keep = np.flatnonzero(ok)
        return keep, doc[keep], keep - self.of_doc[doc[keep]], mix(h[keep] + np.uint64(size), 90 + view).view(np.int64)

    def slots(self, begin: int, size: int) -> list[dict]:
        if self.kinds is None:
            return []
        inside = begin + np.flatnonzero(self.kinds[begin : begin + size] != PLAIN)
        return [{"kind": int(self.kinds[i]), "value": int(self.values[i].view(np.int64)), "at": int(i - begin)} for i in inside]


_SLOT_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("value", pa.int64()), ("at", pa.int32())]))
_ROW = "key long, id long, view int, size int, h long, pos int, total int, slots array<struct<kind:int,value:long,at:int>>"


def _rows(df: DataFrame, id_col: str, sizes: dict[int, list[int]] | None, member) -> DataFrame:
    """Windows of a table. ``sizes``: those of each view; None: one for each text and view (benchmark side)."""

    def run(batches):
        held = None if member is None else member.value
        for b in batches:
            ids, keys = b.column("id"), b.column("key")
            for first, raw, offsets in text_chunks(b.column("text")):
                t = Tokens(raw, offsets)
                parts: dict[str, list] = {k: [] for k in ("row", "view", "size", "h", "pos", "total", "slots")}
                for view, seq in enumerate(t.views):
                    counts = np.diff(seq.of_doc)
                    own = {min(WINDOW, int(c)) for c in counts if c} if sizes is None else sizes.get(view, ())
                    for size in sorted(own):
                        keep, doc, pos, h = seq.windows(view, size)
                        ok = np.minimum(counts[doc], WINDOW) == size if sizes is None else np.ones(len(h), bool)
                        if held is not None:
                            bit = h.view(np.uint64) & np.uint64(FILTER_BITS - 1)
                            ok = (held[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                        doc, pos, h, keep = doc[ok], pos[ok], h[ok], keep[ok]
                        parts["row"].append(doc)
                        parts["view"].append(np.full(len(h), view, np.int32))
                        parts["size"].append(np.full(len(h), size, np.int32))
                        parts["h"].append(h)
                        parts["pos"].append(pos.astype(np.int32))
                        parts["total"].append(counts[doc].astype(np.int32))
                        parts["slots"] += [seq.slots(int(k), size) for k in keep]
                if not parts["row"]:
                    continue
                row = pa.array(np.concatenate(parts["row"]) + first)
                cols = [keys.take(row), ids.take(row)]
                cols += [pa.array(np.concatenate(parts[k])) for k in ("view", "size", "h", "pos", "total")]
                cols.append(pa.array(parts["slots"], _SLOT_TYPE))
                yield pa.RecordBatch.from_arrays(cols, ["key", "id", "view", "size", "h", "pos", "total", "slots"])

    src = df.select(row_key(id_col).alias("key"), F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(tidy(run), _ROW)


def row_key(id_col: str = "doc_id"):
    return F.xxhash64(F.col(id_col).cast("long"), F.col("text").cast("string"))


def _filter(items: DataFrame) -> np.ndarray:
    """Bloom filter with one bit per window: at most ``FILTER_BITS / 64`` rows come to the driver."""
    bit = F.pmod("h", F.lit(FILTER_BITS))
    words = items.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(h, {FILTER_BITS}) & 63 as int))").alias("m"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.groupBy("w").agg(F.bit_or("m").alias("m")).collect():
        out[r.w] = r.m
    return out.view(np.uint8)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, doc_id, item_id, covered, item_tokens, first_token, last_token, slots, changed) per leaked item.

    ``first_token`` and ``last_token`` are places in the document on its longest alignment, and
    these and ``item_tokens`` count the tokens of that alignment's view;
    ``slots`` counts the item's slot values there and ``changed`` those that the document renames.
    """
    items = written(_rows(benchmark, "item_id", None, None), "benchmark-windows")
    sizes: dict[int, list[int]] = {}
    for r in items.select("view", "size").distinct().collect():  # at most WINDOW values of three views
        sizes.setdefault(r["view"], []).append(r["size"])
    member = docs.sparkSession.sparkContext.broadcast(_filter(items))
    found = _rows(docs, "doc_id", sizes, member)
    other = items.select(
        "view", "size", "h", F.col("id").alias("item_id"), F.col("key").alias("item_key"), F.col("pos").alias("item_pos"),
        F.col("total").alias("item_tokens"), F.col("slots").alias("item_slots"),
    ).distinct()
    hits = found.join(other, ["view", "size", "h"]).withColumn("shift", F.col("pos") - F.col("item_pos"))
    hits = written(hits.select("key", F.col("id").alias("doc_id"), "item_id", "item_key", "view", "shift", "size", "item_pos", "item_tokens", "slots", "item_slots"), "hits")
    line = ["key", "item_key", "view", "shift"]
    pairs = hits.where("view > 0").select(*line, "item_pos", F.explode(F.arrays_zip("slots", "item_slots")).alias("s")).select(
        *line,
        (F.col("item_pos") + F.col("s.slots.at")).alias("place"),
        F.col("s.slots.kind").alias("kind"),
        F.col("s.slots.value").alias("mine"),
        F.col("s.item_slots.value").alias("theirs"),
    )
    cells = pairs.distinct().groupBy(*line, "kind", "mine", "theirs").agg(F.count(F.lit(1)).alias("n"))
    fair = (
        cells.withColumn("of_theirs", F.row_number().over(Window.partitionBy(*line, "kind", "theirs").orderBy(F.desc("n"), "mine")))
        .withColumn("of_mine", F.row_number().over(Window.partitionBy(*line, "kind", "mine").orderBy(F.desc("n"), "theirs")))
        .groupBy(*line, "kind")
        .agg(
            F.count(F.lit(1)).alias("pairs"),
            F.sum("n").alias("places"),
            F.greatest(*[F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)) for c in ("of_theirs", "of_mine")]).alias("fits"),
            F.bool_and((F.col("of_theirs") == 1) & (F.col("of_mine") == 1)).alias("strict"),
            F.sum((F.col("mine") != F.col("theirs")).cast("int")).alias("changed"),
        )
        .groupBy(*line)
        .agg(
            F.bool_and((F.col("kind") != NAME) | F.col("strict")).alias("names"),
            F.sum(F.when(F.col("kind") != NAME, 2 * F.col("fits") - F.col("places"))).alias("margin"),
            F.sum("pairs").alias("slots"),
            F.sum("changed").alias("changed"),
        )
        .withColumn("fair", F.col("names") & (F.coalesce("margin", F.lit(1)) > 0))
        .drop("names", "margin")
    )
    # tokens that the windows of an alignment cover: each adds what its predecessor leaves
    along = Window.partitionBy(*line).orderBy("item_pos")
    steps = hits.select(*line, "doc_id", "item_id", "size", "item_pos", "item_tokens").distinct()
    steps = steps.withColumn("adds", F.least("size", F.coalesce(F.col("item_pos") - F.lag("item_pos").over(along), F.col("size"))))
    lines = steps.groupBy(*line, "doc_id", "item_id", "item_tokens").agg(
        F.sum("adds").alias("covered"), F.min("item_pos").alias("lo"), F.max(F.col("item_pos") + F.col("size") - 1).alias("hi")
    )
    lines = lines.join(fair, line, "left").where("view = 0 or fair")
    lines = lines.where((F.col("covered") >= MIN_TOKENS) | (2 * F.col("covered") >= F.col("item_tokens")))
    best = F.max_by(
        F.struct(
            "covered", "item_tokens", (F.col("lo") + F.col("shift")).alias("first_token"), (F.col("hi") + F.col("shift")).alias("last_token"),
            F.coalesce("slots", F.lit(0)).alias("slots"), F.coalesce("changed", F.lit(0)).alias("changed"),
        ),
        F.struct("covered", -F.col("view"), -F.col("shift")),
    )
    out = lines.groupBy("key", "doc_id", "item_key", "item_id").agg(best.alias("best"))
    return out.select("key", "doc_id", "item_id", "best.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, with all their columns."""
    dirty = leaks(docs, benchmark).select(F.col("key").alias("_leak_key")).distinct()
    rows = docs.withColumn("_leak_key", row_key())
    return rows.join(dirty, "_leak_key", "left_anti").select(docs.columns)
