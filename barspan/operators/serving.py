"""Read-side queries: market overview, series, snapshots, reconciliation, published results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspan.operators.tables import top_rows

KEY = ["ts_code", "trade_date"]


def on_latest(df: DataFrame) -> DataFrame:
    """Rows of the newest stored session; the date is a one-row scalar."""
    return df.where(F.col("trade_date") == df.agg(F.max("trade_date").alias("d")).select("d").scalar())


def overview(day: DataFrame) -> DataFrame:
    c = F.col("pct_chg")
    return day.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(c > 0, 1)).alias("up"),
        F.count(F.when(c < 0, 1)).alias("down"),
        F.count(F.when(c == 0, 1)).alias("flat"),
        F.round(F.avg(c), 4).alias("avg_change"),
        F.round(F.sum("amount"), 2).alias("total_amount"),
    )


def industry_changes(day: DataFrame, master: DataFrame) -> DataFrame:
    """Average change per industry, best first; blank industries are left out."""
    named = master.where(F.trim(F.coalesce("industry", F.lit(""))) != "").select("ts_code", "industry")
    return (
        day.join(named, "ts_code")
        .groupBy("industry")
        .agg(F.round(F.avg("pct_chg"), 4).alias("avg_change"), F.count(F.lit(1)).alias("members"))
        .orderBy(F.desc("avg_change"), "industry")
    )


def movers(day: DataFrame, n: int = 10) -> DataFrame:
    """Top and bottom ``n`` by change, ties by code."""
    known = day.where(F.col("pct_chg").isNotNull()).select(*KEY, "close", "pct_chg")
    up = top_rows(known.withColumn("side", F.lit("gainers")), [F.desc("pct_chg"), F.asc("ts_code")], n, ["side"])
    down = top_rows(known.withColumn("side", F.lit("losers")), [F.asc("pct_chg"), F.asc("ts_code")], n, ["side"])
    return up.unionByName(down)


def latest_series(df: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` rows of every instrument, ascending."""
    return top_rows(df, [F.desc("trade_date")], n, ["ts_code"]).drop("position").orderBy(*KEY)


def latest_row(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "ts_code"]
    newest = F.max_by(F.struct(*rest), "trade_date")
    return df.groupBy("ts_code").agg(newest.alias("r")).select("ts_code", "r.*")


def published_results(df: DataFrame, n: int = 100) -> DataFrame:
    """Newest results per (code, type); rows whose JSON cannot be read are skipped."""
    good = df.where(F.json_object_keys("payload").isNotNull())
    return top_rows(good, [F.desc("published_at"), F.desc("result_id")], n, ["ts_code", "result_type"])


def reconcile(counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row of stage counts (one per ``keys``) -> the five checks and the overall verdict.

    A store that was not exercised (null count) leaves the verdict to the message side.
    """

    def check(name, expected, actual, exercised=None):
        same = F.when(F.col(expected) == F.expr(actual), "PASS").otherwise("FAIL")
        status = same if exercised is None else F.when(F.col(exercised).isNull(), "NOT_EXERCISED").otherwise(same)
        return F.struct(F.lit(name).alias("check"), status.alias("status"))

    with_zero = counts.withColumn("zero", F.lit(0).cast("long"))
    checks = [
        check("stored rows equal collected rows", "collected", "stored", "stored"),
        check("deliveries account for collected rows", "collected", "delivered + failed"),
        check("no delivery failures", "zero", "failed"),
        check("delivered equals consumed plus isolated", "delivered", "consumed + isolated"),
        check("dead letters equal isolated", "isolated", "dead"),
    ]
    rows = with_zero.withColumn("_c", F.array(*checks))
    first = F.col("_c")[0]["status"]
    rest = F.when(F.forall(F.slice("_c", 2, 4), lambda c: c["status"] == "PASS"), "PASS").otherwise("FAIL")
    overall = F.when(first == "NOT_EXERCISED", rest).when(first == rest, first).otherwise("PARTIAL")
    return rows.withColumn("overall", overall).select(*keys, "overall", F.explode("_c").alias("c")).select(*keys, "overall", "c.*")
