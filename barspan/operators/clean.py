"""Cleaning, universe filters and missing-value policy for daily bars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspan.functions.scalars import (
    CODE_PATTERN,
    EXCLUDED_PREFIXES,
    finite,
    normalize_code,
    price_anomaly,
    session_day,
)

KEY = ["ts_code", "trade_date"]
REQUIRED = ["open", "high", "low", "close", "vol"]
NUMERIC = [*REQUIRED, "amount", "change", "pct_chg", "pre_close", "turnover_rate"]

# Column names of the Chinese provider and accepted date aliases.
PROVIDER_NAMES = {
    "日期": "trade_date",
    "开盘": "open",
    "收盘": "close",
    "最高": "high",
    "最低": "low",
    "成交量": "vol",
    "成交额": "amount",
    "涨跌额": "change",
    "涨跌幅": "pct_chg",
    "昨收": "pre_close",
    "换手率": "turnover_rate",
}
DATE_ALIASES = ("date", "datetime", "Date", "DateTime")
STANDARD_COLUMNS = [
    "ts_code", "trade_date", "open", "high", "low", "close",
    "pre_close", "change", "pct_chg", "vol", "amount", "turnover_rate",
]


def standard_names(df: DataFrame) -> DataFrame:
    df = df.withColumnsRenamed(PROVIDER_NAMES)
    if "trade_date" not in df.columns:
        for alias in DATE_ALIASES:
            if alias in df.columns:
                return df.withColumnRenamed(alias, "trade_date")
    return df


def _typed(df: DataFrame) -> DataFrame:
    """Standard names, parsed dates, numbers by tolerant cast; nothing is dropped yet."""
    df = standard_names(df)
    casts = {c: F.col(c).try_cast("double") for c in NUMERIC if c in df.columns}
    if dict(df.dtypes)["trade_date"] == "string":
        casts["trade_date"] = session_day("trade_date")
    plain = [c for c in df.columns if c not in casts]
    # behind a generator, so that no later filter parses the text again
    once = F.inline(F.array(F.struct(*[e.alias(c) for c, e in casts.items()])))
    return df.select(*plain, once)


def first_reject() -> Column:
    """Why a typed row leaves before the keyed dedupe; null if it stays."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) for c in REQUIRED])
    return (
        F.when(~F.coalesce(F.col("ts_code").rlike(CODE_PATTERN), F.lit(False)), "BAD_CODE")
        .when(F.col("trade_date").isNull(), "BAD_DATE")
        .when(missing, "NULL_VALUE")
    )


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last row per key in arrival order.

    The ``= 1`` filter on a row number lets Spark keep one row per key on the map side,
    so a key with very many copies never travels or sorts as a whole.
    """
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def clean_bars(df: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """Names, code check, dates, numbers, null drop, keep-last, price then volume anomalies."""
    kept = _typed(df).where(first_reject().isNull())
    kept = keep_last(kept, KEY, [order])
    return kept.where(~price_anomaly()).where(~(F.col("vol") < 0)).drop(order)


def clean_report(df: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """One row: rows in, rows lost per step, rows out. Copies of a key collapse map-side."""
    reason = first_reject()
    flag = F.when(price_anomaly(), 2).when(F.col("vol") < 0, 1).otherwise(0)
    typed = _typed(df).withColumn("_reason", reason)
    keyed = typed.groupBy(
        "_reason", *[F.when(F.col("_reason").isNull(), F.col(c)).alias(c) for c in KEY]
    ).agg(F.count(F.lit(1)).alias("rows"), F.max_by(flag, order).alias("flag"))
    stays = F.col("_reason").isNull()

    def lost(name):
        return F.coalesce(F.sum(F.when(F.col("_reason") == name, F.col("rows"))), F.lit(0))

    def last_flag(n):
        return F.count(F.when(stays & (F.col("flag") == n), 1))

    return keyed.agg(
        F.sum("rows").alias("input_rows"),
        lost("BAD_CODE").alias("bad_code_rows"),
        lost("BAD_DATE").alias("bad_date_rows"),
        lost("NULL_VALUE").alias("null_rows"),
        F.coalesce(F.sum(F.when(stays, F.col("rows") - 1)), F.lit(0)).alias("duplicate_rows"),
        last_flag(2).alias("price_anomaly_rows"),
        last_flag(1).alias("volume_anomaly_rows"),
        last_flag(0).alias("output_rows"),
    )


def drop_missing(df: DataFrame) -> DataFrame:
    return df.na.drop(how="any")


def fill_missing(df: DataFrame, numeric: list[str], categorical: list[str], dp: int | None = None) -> DataFrame:
    """Column mean (rounded to ``dp`` if given) for numbers, most frequent value (smallest on ties) for categories."""
    fills = {}
    means = df.agg(*[(F.avg(c) if dp is None else F.round(F.avg(c), dp)).alias(c) for c in numeric])
    for c in numeric:
        fills[c] = F.coalesce(F.col(c), means.select(c).scalar())
    for c in categorical:
        top = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(1)
        fills[c] = F.coalesce(F.col(c), top.select(c).scalar())
    return df.withColumns(fills)


def derived_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c.startswith(("return_", "future_", "log_"))]


def winsorise(df: DataFrame, columns: list[str] | None = None, k: float = 3.0) -> DataFrame:
    """Clip columns to mean ± k sample deviations of the whole table."""
    columns = derived_columns(df.columns) if columns is None else columns
    stats = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]
    )
    out = {}
    for c in columns:
        m, s = stats.select(f"m_{c}").scalar(), stats.select(f"s_{c}").scalar()
        clipped = F.least(F.greatest(F.col(c), m - s * k), m + s * k)
        out[c] = F.when(F.col(c).isNotNull(), clipped)
    return df.withColumns(out)


def universe(master: DataFrame) -> DataFrame:
    """Drop Beijing-board codes and special-treatment names; a missing name is kept."""
    beijing = F.col("ts_code").rlike(f"^({'|'.join(EXCLUDED_PREFIXES)})")
    special = F.coalesce(F.col("name").rlike("ST|st"), F.lit(False))
    return master.where(~beijing & ~special)


def validate_and_clean(df: DataFrame) -> DataFrame:
    """Required columns present, infinities become null."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    numeric = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: finite(c) for c in numeric})


def enough_history(df: DataFrame, rows: int = 60) -> DataFrame:
    """Instruments with at least ``rows`` sessions."""
    codes = df.groupBy("ts_code").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= rows)
    return df.join(codes, "ts_code", "left_semi")


# Columns that must never reach a model.
LABEL_COLUMNS = ("future_return_1d", "future_return_5d", "future_direction_1d", "future_direction_5d", "label")
IDENTITY_COLUMNS = (
    "ts_code", "trade_date", "日期", "股票名称", "name", "symbol", "instrument", "is_val", "label_target_date",
)


def safe_features(candidates: list[str], present: list[str] | None = None) -> list[str]:
    blocked = {*LABEL_COLUMNS, *IDENTITY_COLUMNS}
    return [c for c in candidates if c not in blocked and (present is None or c in present)]


def finite_rows(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows usable for inference: features finite; an unknown label never removes a row."""
    ok = reduce(lambda a, b: a & b, [finite(c).isNotNull() for c in features])
    return df.where(ok)


def normalize_provider(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Provider frame -> standard columns with code and previous close from the change rate."""
    df = standard_names(df).withColumn("ts_code", normalize_code(symbol))
    df = df.withColumn("trade_date", F.col("trade_date").cast("date"))
    if {"close", "pct_chg"} <= set(df.columns):
        derived = F.round(F.col("close") / (1 + F.col("pct_chg") / 100), 2)
        known = F.col("pre_close") if "pre_close" in df.columns else F.lit(None).cast("double")
        df = df.withColumn("pre_close", F.when(F.col("pct_chg") != 0, derived).otherwise(known))
    absent = [c for c in STANDARD_COLUMNS if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("double") for c in absent}).select(*STANDARD_COLUMNS)
