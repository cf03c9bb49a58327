"""Batch sinks: dual delivery, snapshots with fingerprints, versioned feature builds."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspan.session import cut_lineage


def deliver(df: DataFrame, targets: dict[str, tuple[str, str]], expected: int | None = None) -> DataFrame:
    """Write to several destinations and report what each one holds afterwards.

    ``targets`` maps a destination to (format, path). The combined result is the minimum.
    A failed destination counts as zero and does not stop the others.
    """
    spark = df.sparkSession
    counts = None
    for name, (fmt, path) in targets.items():
        try:
            df.write.mode("overwrite").format(fmt).save(path)
            stored = spark.read.schema(df.schema).format(fmt).load(path).agg(F.count(F.lit(1)).alias("delivered"))
        except Exception as error:  # noqa: BLE001 - a destination's failure is a result
            stored = spark.range(1).select(F.lit(0).cast("long").alias("delivered"), F.lit(type(error).__name__).alias("error"))
        row = stored.select(F.lit(name).alias("destination"), "delivered")
        counts = row if counts is None else counts.unionByName(row)
    combined = counts.agg(F.lit("combined").alias("destination"), F.min("delivered").alias("delivered"))
    return counts.unionByName(combined)


def write_in_order(df: DataFrame, path: str, order: str) -> None:
    """Parquet files that a file stream admits in the order of a column.

    Files hold ranges of ``order``, and their times rise with the ranges, so a stream that
    takes a few files at a time (oldest first) never sees a later range before an earlier one,
    whichever task finished first. Only file names and times pass through the driver. A store that
    ignores file times is an error.
    """
    df.repartitionByRange(order).sortWithinPartitions(order).write.parquet(path)
    context = df.sparkSession.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(context._jsc.hadoopConfiguration())
    parts = sorted(s.getPath().toString() for s in files.listStatus(place) if s.getPath().getName().startswith("part-"))
    newest = max((s.getModificationTime() for s in files.listStatus(place)), default=0)
    for i, part in enumerate(parts):
        files.setTimes(context._jvm.org.apache.hadoop.fs.Path(part), newest - 1000 * (len(parts) - i), -1)
    kept = {s.getPath().toString(): s.getModificationTime() for s in files.listStatus(place)}
    if any(abs(kept[part] - (newest - 1000 * (len(parts) - i))) >= 1000 for i, part in enumerate(parts)):
        raise ValueError(f"{path}: this store keeps no file times; read it with run_ordered_job, which needs none")


# -- fingerprints -------------------------------------------------------------------
def row_digest(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def _folded(digest: Column) -> list[Column]:
    """Four 60-bit words of every row digest, summed: independent of row order and partitioning.

    A sum, unlike xor, also sees a row that occurs twice. It is not the same value as a
    digest chained over sorted rows.
    """
    words = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    return [F.sum(w).alias(f"_w{i}") for i, w in enumerate(words)]


def fingerprint(df: DataFrame, by: list[str], columns: list[str], date: str = "trade_date") -> DataFrame:
    """Rows, first and last date and an order-free digest per group (or for the whole table)."""
    agg = df.withColumn("_d", row_digest(columns)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), *_folded(F.col("_d"))
    )
    joined = F.concat_ws("-", *[F.col(f"_w{i}").cast("string") for i in range(4)])
    return agg.withColumn("digest", F.sha2(joined, 256)).drop(*[f"_w{i}" for i in range(4)])


def chained_digests(df: DataFrame, columns: list[str], order: list[str], levels: list[str]) -> DataFrame:
    """A tree of ordered digests: (level, node, rows, digest), the root at level ``len(levels)``.

    A leaf holds the rows of one value of ``levels[0]`` and digests their row digests in ``order``; a node
    of the next level digests its children in the order of their names, up to one root. Choose levels
    so that a node has few children and a leaf few rows: these are what one group gathers.
    """
    rows = df.select(*levels, F.struct(*order).alias("_order"), row_digest(columns).alias("_digest"))

    def linked(key):
        children = F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col("_digest").alias("d"))))
        return F.sha2(F.concat_ws("", F.transform(children, lambda c: c["d"])), 256).alias("_digest")

    node = cut_lineage(rows.groupBy(*levels).agg(F.count(F.lit(1)).alias("rows"), linked("_order")), "leaves")
    out = None
    for at in range(len(levels) + 1):
        if at:
            node = node.groupBy(*levels[at:]).agg(F.sum("rows").alias("rows"), linked(levels[at - 1]))
        name = F.col(levels[at]).cast("string") if at < len(levels) else F.lit("")
        part = node.select(F.lit(at).alias("level"), name.alias("node"), "rows", F.col("_digest").alias("digest"))
        out = part if out is None else out.unionByName(part)
    return out


def differing_nodes(one: DataFrame, other: DataFrame, level: int = 0) -> DataFrame:
    """Nodes of a level that two trees do not share, with what each side holds."""
    a = one.where(F.col("level") == level).select("node", F.col("rows").alias("rows_before"), F.col("digest").alias("_a"))
    b = other.where(F.col("level") == level).select("node", F.col("rows").alias("rows_after"), F.col("digest").alias("_b"))
    return a.join(b, "node", "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).drop("_a", "_b")


def write_snapshot(df: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """Parquet split by instrument hash, sorted inside files, with a manifest per instrument."""
    df.repartition("ts_code").sortWithinPartitions("ts_code", "trade_date").write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    return fingerprint(stored, ["ts_code"], columns)


# -- feature store ------------------------------------------------------------------
class LostRace(RuntimeError):
    """Another writer took the step."""


def create_exclusively(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file unless it exists: true for the one writer who made it.

    A local path uses the operating system's exclusive create. Elsewhere the store's create without
    overwrite decides, which is atomic where the store offers that (a name node does).
    """
    context = spark.sparkContext
    jvm, data = context._jvm, bytearray(text.encode())
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(place.getParent())
    try:
        if files.getScheme() == "file":
            options = context._gateway.new_array(jvm.java.nio.file.OpenOption, 2)
            options[0], options[1] = jvm.java.nio.file.StandardOpenOption.CREATE_NEW, jvm.java.nio.file.StandardOpenOption.WRITE
            jvm.java.nio.file.Files.write(jvm.java.nio.file.Path.of(place.toUri().getPath(), context._gateway.new_array(jvm.java.lang.String, 0)), data, options)
            return True
        stream = files.create(place, False)
        stream.write(data)
        stream.close()
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise


class FeatureStore:
    """Builds are partitions ``build_id=<id>``; one pointer row names the active build.

    ``publish`` verifies the stored partition against its source first and appends to the
    activation log, so a rollback is one more row and readers always see one version.
    """

    def __init__(self, spark: SparkSession, root: str, key=("ts_code", "trade_date")):
        self.spark, self.root, self.key = spark, root.rstrip("/"), list(key)

    def write(self, df: DataFrame, build_id: str) -> None:
        df.write.mode("errorifexists").parquet(f"{self.root}/builds/build_id={build_id}")

    def build(self, build_id: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/builds/build_id={build_id}")

    def verify(self, source: DataFrame, build_id: str) -> DataFrame:
        """One row: counts, duplicate keys and digests of source and stored build."""
        stored = self.build(build_id, source.schema)
        keys = stored.groupBy(*self.key).count().agg(F.count(F.when(F.col("count") > 1, 1)).alias("duplicate_keys"))
        a = fingerprint(source, [], source.columns).select(F.col("rows").alias("source_rows"), F.col("digest").alias("_a"))
        b = fingerprint(stored, [], source.columns).select(F.col("rows").alias("stored_rows"), F.col("digest").alias("_b"))
        one = a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").join(keys.withColumn("_k", F.lit(1)), "_k")
        return one.select("source_rows", "stored_rows", "duplicate_keys", (F.col("_a") == F.col("_b")).alias("same_content"))

    def publish(self, source: DataFrame, build_id: str, seen: int | None = None) -> None:
        """Verify a build and make it active, unless another build became active since ``seen``."""
        seen = self.step() if seen is None else seen
        row = self.verify(source, build_id).first()
        if row["source_rows"] != row["stored_rows"] or row["duplicate_keys"] or not row["same_content"]:
            raise ValueError(f"build {build_id} failed verification: {row.asDict()}")
        self._activate(build_id, seen)

    def rollback(self) -> str:
        seen = self.step()
        log = self.activations().orderBy(F.desc("step")).select("build_id").take(2)
        if len(log) < 2:
            raise ValueError("no earlier build to return to")
        self._activate(log[1]["build_id"], seen)
        return log[1]["build_id"]

    def _has_log(self) -> bool:
        """Whether anything was ever activated; an error of the file system is not taken for a no."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/activations")
        return path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path)

    def activations(self) -> DataFrame:
        return self.spark.read.schema("step long, build_id string").json(f"{self.root}/activations")

    def step(self) -> int:
        """The newest step of the activation log, 0 if there is none."""
        return (self.activations().agg(F.max("step")).first()[0] or 0) if self._has_log() else 0

    def _activate(self, build_id: str, seen: int | None = None) -> None:
        """Take the step after the one this writer has seen; if another writer took it, this one loses."""
        seen = self.step() if seen is None else seen
        line = json.dumps({"step": seen + 1, "build_id": build_id}) + "\n"
        if not create_exclusively(self.spark, f"{self.root}/activations/{seen + 1:012d}.json", line):
            raise LostRace(f"step {seen + 1} already exists: another writer took it, {build_id} is not active")

    def active(self) -> str:
        return self.activations().orderBy(F.desc("step")).first()["build_id"]

    def read(self, schema, requested: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The active build pinned once, and the requested keys it lacks."""
        data = self.build(self.active(), schema)
        if requested is None:
            return data, data.select(*self.key).limit(0)
        missing = requested.select(*self.key).distinct().join(data, self.key, "left_anti")
        return data.join(requested.select(*self.key).distinct(), self.key, "left_semi"), missing
