"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a queue of its documents, shuffled by a digest of id and text and read up to
``epochs`` times. A copy of a document gets a virtual finish time: the words its source has
handed out up to and including it, divided by the source's target. All copies are range-sorted
by that time, which interleaves the sources in proportion to their targets, and the stream is
truncated where the budget, the sum of the targets, is spent (virtual time 1). A copy that a
source is in the middle of at that point hands out its words up to the line, so every source
gives its target to the word. Copies that hand out no word are not numbered. The rows of the
mix stand in the order of the stream.

Targets: sources in code-point order, null last, carry the weights in turn and share
``share_pct`` percent of all words; a target stops at ``epochs`` times its source's size and
the excess is shared again by weight until none is above.

No source meets in one task: a running total is the total of the source's earlier digest
ranges plus a running sum inside one range of about ``ROWS_PER_RANGE`` documents; the
stream is numbered in steps of virtual time in the same way. Texts move once, at the end.

Nulls: a null text has size 0 and nothing is taken of it; a null source is a source of its
own; a null id is an id. Repeated rows are separate documents. An empty table gives an empty
mix. Columns of the table keep their names whatever they are; working columns are ``_mix_*``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspan.llm.common import written

WEIGHTS = (5, 2, 1)
SHARE_PCT = 150
EPOCHS = 2
#: Documents of a source that one task sums up in order.
ROWS_PER_RANGE = 20_000
#: Words of the mixed stream that one task numbers.
WORDS_PER_STEP = 8_000_000

_BLANKS = " \t\n\x0b\f\r"


def size_of(text: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs of a text; null: 0."""
    plain = F.trim(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _BLANKS, " " * len(_BLANKS)))
    return F.when(plain == "", 0).otherwise(F.size(F.split(plain, " +"))).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share_pct: int = SHARE_PCT, epochs: int = EPOCHS) -> DataFrame:
    """Add ``weight`` and ``target`` to one row (source, source_size) per source.

    Ordered by capacity per weight, the sources that stop at their capacity are a prefix and
    the others share what it leaves. The windows hold one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    every = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(
        Window.unboundedPreceding, -1
    )
    open_ = F.col("_cap") > F.col("_level") * F.col("weight")
    return (
        sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn))
        .withColumn("_cap", F.col("source_size") * epochs)
        .withColumn("_left", F.sum("source_size").over(every) * share_pct / 100 - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_level", F.col("_left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
        .withColumn("_line", F.min(F.when(open_, F.struct(F.col("_cap") / F.col("weight"), "_level"))).over(every)["_level"])
        .withColumn("target", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_line") * F.col("weight"), F.col("_cap").cast("double"))))
        .select("source", "source_size", "weight", "target")
    )


def _running(df: DataFrame, part: list[str], order: list[str], value: str, within: str, out: str) -> DataFrame:
    """``out``: sum of ``value`` over the rows before, where range ``within`` of ``part`` comes first in the order."""
    keys = [*part, within]
    earlier = Window.partitionBy(*part).orderBy(within).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_mix_sum"))
    totals = totals.withColumn("_mix_off", F.coalesce(F.sum("_mix_sum").over(earlier), F.lit(0))).drop("_mix_sum")
    totals = totals.toDF(*[f"_mix_k{i}" for i in range(len(keys))], "_mix_off")
    same = [F.col(k).eqNullSafe(F.col(f"_mix_k{i}")) for i, k in enumerate(keys)]
    joined = df.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0))).join(totals, same)
    return joined.withColumn(out, F.col(out) + F.col("_mix_off")).drop("_mix_off", *[f"_mix_k{i}" for i in range(len(keys))])


def schedule(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share_pct: int = SHARE_PCT, epochs: int = EPOCHS) -> DataFrame:
    """One row per copy: row key, size, target, ``epoch``, ``stream_start``, ``words``.

    ``row_key`` is a digest of all columns; ``words`` is what the mix takes of the copy, which is
    the part of it that lies before the end of the stream. A copy outside has no ``stream_start``.
    """
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    rows = written(
        docs.select(
            F.col("doc_id"),
            F.col("source").cast("string").alias("source"),
            row_key(docs).alias("row_key"),
            F.monotonically_increasing_id().alias("row_id"),
            digest.alias("order"),
            size_of().alias("size"),
        ),
        "mix-rows",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_mix_n"))
    share = targets(sizes.drop("_mix_n"), weights, share_pct, epochs).toDF("_mix_s", "source_size", "weight", "target")
    share = share.join(sizes.select(F.col("source").alias("_mix_s2"), "_mix_n"), F.col("_mix_s").eqNullSafe(F.col("_mix_s2")))
    place = F.conv(F.substring("order", 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    rows = rows.join(share.drop("_mix_s2"), F.col("source").eqNullSafe(F.col("_mix_s"))).drop("_mix_s")
    rows = rows.withColumn("_mix_range", F.floor(place * F.ceil(F.col("_mix_n") / ROWS_PER_RANGE)))
    queue = _running(rows, ["source"], ["order", "row_key"], "size", "_mix_range", "_mix_before").drop("_mix_range", "_mix_n")

    start = F.col("_mix_before") + F.col("epoch") * F.col("source_size")
    copies = (
        queue.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .withColumn("_mix_start", start)
        .withColumn("words", F.greatest(F.lit(0), F.least("size", F.floor("target") - F.col("_mix_start"))).cast("long"))
        .withColumn("finish", F.when(F.col("target") > 0, (F.col("_mix_start") + F.col("size")) / F.col("target")).otherwise(F.lit(0.0)))
    )
    copies = written(copies.drop("_mix_before", "_mix_start"), "mix-copies")
    # equal steps of virtual time hold about equal words; the last one holds the copies that the line cuts
    budget = share.agg(F.sum("target")).first()[0] or 0.0
    steps = max(1, round(budget / WORDS_PER_STEP))
    live = copies.where("words > 0").withColumn("_mix_step", F.floor(F.least("finish", F.lit(1.0)) * steps))
    stream = _running(live, [], ["finish", "order", "row_id", "epoch"], "words", "_mix_step", "stream_start").drop("_mix_step")
    whole = F.greatest(F.lit(0.0), F.least(F.col("words").cast("double"), F.ceil(F.lit(budget)) - F.col("stream_start")))
    stream = stream.withColumn("words", whole.cast("long"))
    return stream.unionByName(copies.where("words = 0").withColumn("stream_start", F.lit(None).cast("long")))


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, stream_start) of every row.

    ``stream_start`` is where the row first stands in the mixed stream, in words; null if it does not.
    """
    copies = schedule(docs, **options)
    return (
        copies.groupBy("row_id")
        .agg(
            *[F.first(c).alias(c) for c in ("doc_id", "size", "source", "source_size", "target")],
            F.sum("words").alias("taken"),
            F.min("stream_start").alias("stream_start"),
        )
        .drop("row_id")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents with the columns of ``docs``: a row per copy that is taken, in the order of the stream.

    A copy that the line cuts ends after its last taken word; ``n_chars`` then follows the text.
    """
    plan = schedule(docs, **options).where("words > 0")
    per_row = plan.groupBy("row_key", "row_id").agg(F.collect_list(F.struct("epoch", "words", "size", "stream_start")).alias("_mix_copies"))
    per_row = per_row.withColumn("_mix_nth", F.row_number().over(Window.partitionBy("row_key").orderBy("row_id")))
    per_row = per_row.select(F.col("row_key").alias("_mix_key"), "_mix_nth", "_mix_copies")
    rows = docs.withColumn("_mix_key", row_key(docs))
    rows = rows.withColumn("_mix_nth", F.row_number().over(Window.partitionBy("_mix_key").orderBy("_mix_key")))
    out = rows.join(per_row, ["_mix_key", "_mix_nth"]).withColumn("_mix_copy", F.explode("_mix_copies"))
    cut = F.col("_mix_copy.words") < F.col("_mix_copy.size")
    b = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"
    out = out.withColumn("_mix_pattern", F.concat(F.lit(f"^(?:{b}){{"), F.col("_mix_copy.words"), F.lit("}+")))
    out = out.withColumn("text", F.when(cut, F.expr("regexp_extract(text, _mix_pattern, 0)")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.orderBy("_mix_copy.stream_start").select(docs.columns)
