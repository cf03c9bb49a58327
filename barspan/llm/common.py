"""What the operators share: shared-folder tables, labels, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def modest_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most, so that whole long texts do not fill a Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).lower().rstrip("b") in ("67108864", "64m"):  # untouched default
        spark.conf.set(key, str(8 << 20))


#: For rows of about a megabyte: Parquet's writer looks at what it holds only every 100 rows, and what it holds is one page and one
#: row group, which a reader takes into memory whole. With these it looks at each row and writes groups of 4 MB.
LARGE_ROWS = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: cuts lineage, survives lost executors."""
    modest_batches(df.sparkSession)
    path = shared_dir(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of an undirected graph given as distinct long pairs ``a``, ``b``.

    Alternating large-star and small-star: every edge moves to the smallest neighbour until
    nothing changes; a few rounds for stars and short chains, O(log^2) in the worst case.
    The root is the smallest node. Each round is written to the shared folder.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(low, "a")
        small = down.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = written(small.where("a <> b").distinct(), "cc")
        state = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root"))
    ).distinct()


def learning_rows(docs: DataFrame, chosen: DataFrame | None, bound: int) -> DataFrame:
    """About ``bound`` rows (doc_id, text, pick, columns of ``chosen``) to learn from, never a held-out one.

    ``chosen``: labelled ids, of which a hash takes at most ``bound``; None: a hash of the
    documents decides. The caller cuts its measured rows with ``bounded``. What is broadcast
    holds at most ``bound`` rows.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.where(~held_out()).withColumn("pick", F.xxhash64("doc_id", "text", F.lit("learn")))
    if chosen is None:
        part = int(1.1e6 * bound / max(docs.count(), 1)) + 1
        return src.where(F.pmod("pick", F.lit(1_000_000)) < part)
    ids = chosen.where(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("label_rows"), *[F.max(c).alias(c) for c in chosen.columns if c != "doc_id"]
    )
    ids = ids.orderBy(F.xxhash64("doc_id", F.lit("learn")), "doc_id").limit(bound)
    return src.join(F.broadcast(ids), "doc_id")


def bounded(rows: DataFrame, bound: int) -> list:
    """At most ``bound`` rows on the driver, the same ones on every run."""
    return rows.orderBy("pick").limit(bound).collect()
