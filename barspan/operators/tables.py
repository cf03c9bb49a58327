"""Panel reads, merge policies and set checks between keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspan.operators.clean import keep_last

KEY = ["ts_code", "trade_date"]


def between(df: DataFrame, start=None, end=None, column: str = "trade_date") -> DataFrame:
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end).cast("date"))
    return df


def daily_panel(bars: DataFrame, valuation: DataFrame, codes: DataFrame | None = None, start=None, end=None) -> DataFrame:
    """Bars LEFT JOIN valuation on the shared key, optionally for a pool and a date range."""
    bars = between(bars, start, end)
    if codes is not None:
        bars = bars.join(codes.select("ts_code").distinct(), "ts_code", "left_semi")
    return bars.join(between(valuation, start, end), KEY, "left")


def market_history(panel: DataFrame, limit: int = 2500) -> DataFrame:
    """Every instrument's history with its size checked against ``limit``."""
    sizes = panel.groupBy("ts_code").agg(F.count(F.lit(1)).alias("history_rows"))
    return panel.join(sizes, "ts_code").withColumn("within_limit", F.col("history_rows") <= limit)


def with_names(bars: DataFrame, master: DataFrame) -> DataFrame:
    return bars.join(master.select("ts_code", "name"), "ts_code", "left")


def latest_snapshot(members: DataFrame, as_of=None, group=("group_type", "group_code")) -> DataFrame:
    """Members of each group's newest snapshot (not later than ``as_of``)."""
    known = members if as_of is None else members.where(F.col("as_of_date") <= F.lit(as_of).cast("date"))
    newest = known.groupBy(*group).agg(F.max("as_of_date").alias("as_of_date"))
    return known.join(newest, [*group, "as_of_date"], "left_semi")


def resolve_pool(members: DataFrame, master: DataFrame, sectors: list[str], indexes: list[str]) -> DataFrame:
    """Codes of the named industries and of the newest snapshots of the named indexes."""
    by_industry = master.where(F.col("industry").isin(sectors)).select("ts_code")
    by_index = latest_snapshot(members.where(F.col("group_code").isin(indexes))).select("ts_code")
    return by_industry.unionByName(by_index).distinct()


def source_join(bars: DataFrame, valuation: DataFrame, master: DataFrame) -> DataFrame:
    """Three-way read for a feature build; a missing counterpart is reported per row."""
    v = valuation.withColumn("_v", F.lit(True))
    m = master.select("ts_code", "name", "industry", F.lit(True).alias("_m"))
    status = F.when(F.col("_m").isNull(), "MISSING_MASTER").when(F.col("_v").isNull(), "MISSING_VALUATION").otherwise("OK")
    return bars.join(v, KEY, "left").join(m, "ts_code", "left").withColumn("source_status", status).drop("_v", "_m")


def insert_ignore(existing: DataFrame, incoming: DataFrame, order: list, key=KEY) -> DataFrame:
    """First write wins, also among incoming rows of one key: ``order`` is their arrival.

    Arrival columns that ``existing`` lacks are dropped.
    """
    fresh = top_rows(incoming, order, 1, list(key)).select(existing.columns)
    return existing.unionByName(fresh.join(existing, list(key), "left_anti"))


def upsert(existing: DataFrame, incoming: DataFrame, order: list[str], key=KEY) -> DataFrame:
    """Last write wins, also among incoming rows of one key: ``order`` is their arrival."""
    fresh = keep_last(incoming, list(key), order).select(existing.columns)
    return fresh.unionByName(existing.join(fresh, list(key), "left_anti"))


def replace_snapshot(existing: DataFrame, incoming: DataFrame, group=("group_type", "group_code", "as_of_date")) -> DataFrame:
    """Delete every stored row of an incoming (group, date), then insert the new rows."""
    touched = incoming.select(*group).distinct()
    return existing.join(touched, list(group), "left_anti").unionByName(incoming)


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def diff(old: DataFrame, new: DataFrame, columns: list[str], key=KEY) -> DataFrame:
    """Per key: ONLY_OLD, ONLY_NEW, CONFLICT or EQUAL at stored precision, with differing columns."""
    a = old.select(*key, *[F.col(c).alias(f"old_{c}") for c in columns], F.lit(True).alias("_a"))
    b = new.select(*key, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("_b"))
    changed = F.array_compact(
        F.array(*[F.when(~_same(F.col(f"old_{c}"), F.col(f"new_{c}")), F.lit(c)) for c in columns])
    )
    both = a.join(b, list(key), "full_outer").withColumn(
        "changed", F.when(F.col("_a") & F.col("_b"), changed).otherwise(F.array().cast("array<string>"))
    )
    status = (
        F.when(F.col("_b").isNull(), "ONLY_OLD")
        .when(F.col("_a").isNull(), "ONLY_NEW")
        .when(F.size("changed") > 0, "CONFLICT")
        .otherwise("EQUAL")
    )
    return both.select(*key, status.alias("status"), F.concat_ws(",", "changed").alias("changed"))


def insert_only(existing: DataFrame, incoming: DataFrame, columns: list[str], order: list) -> tuple[DataFrame, DataFrame]:
    """Merged table and a report: inserted, already present, conflicts (stored value wins)."""
    merged = insert_ignore(existing, incoming, order)
    d = diff(existing, top_rows(incoming, order, 1, list(KEY)), columns).where("status <> 'ONLY_OLD'")
    report = d.agg(
        F.count(F.when(F.col("status") == "ONLY_NEW", 1)).alias("inserted"),
        F.count(F.when(F.col("status") != "ONLY_NEW", 1)).alias("already_present"),
        F.count(F.when(F.col("status") == "CONFLICT", 1)).alias("conflicts"),
    )
    return merged, report


def backfill(panel: DataFrame, cache: DataFrame, column: str, key=KEY) -> DataFrame:
    """Take ``column`` from the cache only where the panel has no value."""
    c = cache.select(*key, F.col(column).alias("_cached"))
    return panel.join(c, list(key), "left").withColumn(column, F.coalesce(column, "_cached")).drop("_cached")


def newest_version(df: DataFrame, version: str = "version", key=KEY) -> DataFrame:
    """Replacing-merge read: the row with the highest version per key."""
    return keep_last(df, list(key), [version])


def key_difference(left: DataFrame, right: DataFrame, key=KEY) -> DataFrame:
    """Keys present on one side only; empty means equal key sets."""
    a = left.select(*key).distinct().withColumn("_a", F.lit(1))
    b = right.select(*key).distinct().withColumn("_b", F.lit(1))
    return (
        a.join(b, list(key), "full_outer")
        .where("_a IS NULL OR _b IS NULL")
        .select(*key, F.when(F.col("_a").isNull(), "RIGHT_ONLY").otherwise("LEFT_ONLY").alias("side"))
    )


def unique_keys(df: DataFrame, key=KEY) -> DataFrame:
    """Contract check in one pass: null keys and duplicated keys."""
    nulls = F.when(F.greatest(*[F.col(c).isNull() for c in key]), F.col("n"))
    counted = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(nulls), F.lit(0)).alias("null_keys"),
        F.count(F.when(F.col("n") > 1, 1)).alias("duplicated_keys"),
    )


def one_to_one(df: DataFrame, key=KEY) -> DataFrame:
    """Raise before a join would fan out."""
    row = unique_keys(df, key).first()
    if row["null_keys"] or row["duplicated_keys"]:
        raise ValueError(f"key {list(key)} is not unique: {row.asDict()}")
    return df


def top_rows(df: DataFrame, order, n: int, per: list[str]) -> DataFrame:
    """First ``n`` rows per group with a 1-based position; Spark limits each group map-side."""
    w = Window.partitionBy(*per).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)
