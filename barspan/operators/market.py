"""Cross-section context, labels, selection, and per-instrument statistics.

Anything grouped by date or by (date, industry) is an aggregation joined back on its key
or a bucketed rank, never a window over the whole cross-section of a date.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspan.functions.frames import by_code, following, nonzero, safe_corr
from barspan.functions.ranks import group_quantile, row_order, with_average_rank
from barspan.operators.tables import top_rows

KEY = ["ts_code", "trade_date"]
YEAR = 252


def _per_day(df: DataFrame) -> DataFrame:
    """Marks a one-row-per-session table (bounded by the calendar) for broadcast."""
    return F.broadcast(df)


# -- context and labels -------------------------------------------------------------
def market_context(df: DataFrame) -> DataFrame:
    """Market and industry means, differences, ratio and z-scores of return and volatility."""
    r, v = F.col("return_1d"), F.col("volatility_20d")
    day = df.groupBy("trade_date").agg(F.avg(r).alias("market_return"), F.avg(v).alias("market_volatility_20d"))
    group = (
        df.where(F.col("industry").isNotNull())
        .groupBy("trade_date", "industry")
        .agg(
            F.avg(r).alias("industry_return"),
            F.stddev_samp(r).alias("_sr"),
            F.avg(v).alias("_mv"),
            F.stddev_samp(v).alias("_sv"),
        )
    )
    out = df.join(_per_day(day), "trade_date").join(group, ["trade_date", "industry"], "left")
    return out.withColumns(
        {
            "return_vs_market": r - F.col("market_return"),
            "return_vs_industry": r - F.col("industry_return"),
            "volatility_vs_market": v / nonzero("market_volatility_20d"),
            "return_zscore_industry": (r - F.col("industry_return")) / nonzero("_sr"),
            "volatility_zscore_industry": (v - F.col("_mv")) / nonzero("_sv"),
        }
    ).drop("_sr", "_mv", "_sv")


def forward_label(df: DataFrame, horizon: int = 5) -> DataFrame:
    """Return over the next ``horizon`` stored rows and the date it is realised on."""
    if horizon < 1:
        raise ValueError("horizon must be positive")
    return df.withColumns(
        {
            "label": following("close", horizon) / F.col("close") - 1,
            "label_target_date": following("trade_date", horizon),
        }
    )


def probe_labels(df: DataFrame) -> DataFrame:
    """Above the day's median, the raw label, and its sign; an unknown label gives 0."""
    median = group_quantile(df, ["trade_date"], "label", 0.5, "_median")
    out = df.join(_per_day(median), "trade_date", "left")
    return out.withColumns(
        {
            "label_cls": F.when(F.col("label") > F.col("_median"), 1).otherwise(0),
            "label_reg": F.col("label").cast("float"),
            "label_dir": F.when(F.col("label") > 0, 1).otherwise(0),
        }
    ).drop("_median")


def centred_rank_label(df: DataFrame, label: str = "label") -> DataFrame:
    ranked = with_average_rank(df.where(F.col(label).isNotNull()), ["trade_date"], label, "_rank", "_n")
    return ranked.withColumn("rank_label", (F.col("_rank") - 0.5) / F.col("_n") - 0.5).drop("_rank", "_n")


# -- selection ----------------------------------------------------------------------
def top_n(scores: DataFrame, n: int, score: str = "score") -> DataFrame:
    """Best ``n`` per session: score descending, code ascending."""
    return top_rows(scores, [F.desc(score), F.asc("ts_code")], n, ["trade_date"])


def full_ranking(scores: DataFrame, score: str = "score") -> DataFrame:
    """Exact position of every instrument of a session, as a distributed rank."""
    return row_order(scores, ["trade_date"], score, True, "ts_code", "position").drop("n")


def positive_weights(scores: DataFrame, n: int, score: str = "score") -> DataFrame:
    picked = top_n(scores, n, score).where(F.col(score) > 0)
    total = F.sum(score).over(Window.partitionBy("trade_date"))  # at most n rows a session
    return picked.withColumn("weight", F.col(score) / total)


def softmax_weights(picked: DataFrame, score: str = "score", temperature: float = 0.5) -> DataFrame:
    """For an already selected top list; ``picked`` holds a bounded number of rows a session."""
    e = F.exp(F.col(score) / temperature)
    return picked.withColumn("weight", e / (F.sum(e).over(Window.partitionBy("trade_date")) + 1e-12))


SCORE_POLICIES = ("legacy_variance", "nonnegative_variance")


def adjust_scores(df: DataFrame, policy: str = "legacy_variance") -> DataFrame:
    """Discount the ranking head by the disagreement of the three other, min-max normalised heads."""
    if policy not in SCORE_POLICIES:
        raise ValueError(f"unknown policy {policy}")
    heads = ["regression", "classification", "direction"]
    cols = heads + ["ranking"]
    day = df.groupBy("trade_date").agg(
        *[F.min(c).alias(f"_lo_{c}") for c in cols], *[F.max(c).alias(f"_hi_{c}") for c in cols]
    )

    def unit(c):
        width = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        return F.when(width < 1e-9, F.lit(0.0)).otherwise((F.col(c) - F.col(f"_lo_{c}")) / width)

    u = [unit(c) for c in heads]
    mean = (u[0] + u[1] + u[2]) / 3
    variance = ((u[0] - mean) ** 2 + (u[1] - mean) ** 2 + (u[2] - mean) ** 2) / 3
    base = F.col("ranking") if policy == "legacy_variance" else unit("ranking")
    out = df.join(_per_day(day), "trade_date")
    return out.withColumns({"uncertainty": variance, "score": base * (1 - variance)}).select(
        *df.columns, "uncertainty", "score"
    )


# -- curves and runs ----------------------------------------------------------------
def drawdown_curve(df: DataFrame, value: str = "close") -> DataFrame:
    """Drawdown from the running peak, with the first date of that peak."""
    upto = by_code().rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max(F.struct(F.col(value).alias("v"), (-F.unix_date("trade_date")).alias("d"))).over(upto)
    out = df.withColumn("_peak", peak)
    return out.withColumns(
        {
            "drawdown": F.col(value) / F.col("_peak.v") - 1,
            "peak_date": F.date_from_unix_date(-F.col("_peak.d")),
            "cumulative_return": F.col(value) / F.first(value).over(upto) - 1,
        }
    ).drop("_peak")


def worst_drawdown(curve: DataFrame) -> DataFrame:
    """Deepest trough per instrument and the peak before it."""
    first_worst = F.struct("drawdown", "trade_date", "peak_date")
    return curve.groupBy("ts_code").agg(F.min(first_worst).alias("w")).select(
        "ts_code",
        F.col("w.drawdown").alias("max_drawdown"),
        F.col("w.peak_date").alias("peak_date"),
        F.col("w.trade_date").alias("trough_date"),
    )


def session_runs(keys: DataFrame, sessions: DataFrame, split_years: bool = False) -> DataFrame:
    """Maximal runs of consecutive sessions per instrument (optionally cut at year ends)."""
    w = Window.partitionBy("ts_code").orderBy("ordinal")
    rows = keys.join(F.broadcast(sessions), "trade_date").withColumn(
        "_island", F.col("ordinal") - F.row_number().over(w)
    )
    if split_years:
        rows = rows.withColumn("_year", F.year("trade_date"))
    by = ["ts_code", "_island"] + (["_year"] if split_years else [])
    return (
        rows.groupBy(*by)
        .agg(
            F.min("trade_date").alias("start_date"),
            F.max("trade_date").alias("end_date"),
            F.count(F.lit(1)).alias("sessions"),
        )
        .drop("_island", "_year")
    )


def recent_trend(df: DataFrame, rows: int = 60) -> DataFrame:
    """Linear fit over the last ``rows`` closes: slope in % of the mean, R², direction."""
    last = top_rows(df, [F.desc("trade_date")], rows, ["ts_code"])
    x = -F.col("position").cast("double")
    fit = last.groupBy("ts_code").agg(
        F.count(F.lit(1)).alias("rows"),
        (F.regr_slope("close", x) / F.avg("close") * 100).alias("slope_pct"),
        F.regr_r2("close", x).alias("r_squared"),
    )
    s = F.col("slope_pct")
    return fit.withColumn("direction", F.when(s > 0.05, "up").when(s < -0.05, "down").otherwise("flat"))


# -- statistics ---------------------------------------------------------------------
def describe(df: DataFrame, value: str, by: str = "ts_code") -> DataFrame:
    """Count, mean, deviation, quartiles and bias-corrected moments of each instrument's series."""
    x, n = F.col(value), F.count(value)
    g1, g2 = F.skewness(x), F.kurtosis(x)
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        df.groupBy(by)
        .agg(
            n.alias("count"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"),
            q.alias("_q"),
            F.max(x).alias("max"),
            F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
            F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("kurtosis"),
        )
        .withColumns({"q25": F.col("_q")[0], "q50": F.col("_q")[1], "q75": F.col("_q")[2]})
        .drop("_q")
    )


def _student_tail(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t by the continued fraction of the incomplete beta."""

    def one(tv, v):
        if tv is None or math.isnan(tv) or v <= 0:
            return float("nan")
        x, a, b = v / (v + tv * tv), v / 2, 0.5
        if x <= 0 or x >= 1:
            return 0.0 if x <= 0 else 1.0
        swap = x >= (a + 1) / (a + b + 2)
        if swap:
            x, a, b = 1 - x, b, a
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
        f = d
        for m in range(1, 300):
            for num in (
                m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
            ):
                d, c = 1 / (1 + num * d), 1 + num / c
                f *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return 1 - front * f if swap else front * f

    return pd.Series([one(a, b) for a, b in zip(t, dof)])


def trend(df: DataFrame, value: str = "close", alpha: float = 0.05) -> DataFrame:
    """OLS of the value on its row ordinal: slope, R², p-value, direction, significance.

    The p-value runs on the aggregated rows only, one per instrument.
    """
    rows = df.withColumn("_x", F.row_number().over(by_code()).cast("double"))
    fit = rows.groupBy("ts_code").agg(
        F.count(value).alias("n"),
        F.regr_slope(value, "_x").alias("slope"),
        F.regr_r2(value, "_x").alias("r_squared"),
    )
    dof = F.col("n") - 2
    t = F.sqrt(F.col("r_squared") * dof / (1 - F.col("r_squared")))
    tail = F.pandas_udf(_student_tail, "double")
    return fit.withColumn("p_value", tail(t, dof.cast("double"))).withColumns(
        {
            "direction": F.when(F.col("slope") > 0, "up").otherwise("down"),
            "significant": F.col("p_value") < alpha,
        }
    )


def risk_metrics(df: DataFrame, ret: str, risk_free: float = 0.03) -> DataFrame:
    """Annual return and volatility from daily returns, Sharpe, and the deepest drawdown."""
    upto = by_code().rowsBetween(Window.unboundedPreceding, 0)
    wealth = df.withColumn("_wealth", F.exp(F.sum(F.log1p(ret)).over(upto)))
    curve = wealth.withColumn("_dd", F.col("_wealth") / F.max("_wealth").over(upto) - 1)
    annual = F.pow(1 + F.avg(ret), YEAR) - 1
    vol = F.stddev_samp(ret) * YEAR**0.5
    return curve.groupBy("ts_code").agg(
        annual.alias("annual_return"),
        vol.alias("annual_volatility"),
        ((annual - risk_free) / F.when(vol != 0, vol)).alias("sharpe_ratio"),
        F.min("_dd").alias("max_drawdown"),
    )


def return_metrics(df: DataFrame, ret: str, by: str = "ts_code", risk_free: float = 0.03) -> DataFrame:
    """Compounded metrics of a realised return series; the curve starts at 1 before day one."""
    upto = Window.partitionBy(by).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    wealth = df.withColumn("_wealth", F.exp(F.sum(F.log1p(ret)).over(upto)))
    peak = F.greatest(F.max("_wealth").over(upto), F.lit(1.0))
    curve = wealth.withColumn("_dd", F.col("_wealth") / peak - 1)
    n, r = F.count(ret), F.col(ret)
    annual = F.exp(F.sum(F.log1p(r)) * YEAR / n) - 1
    vol = F.when(n > 1, F.stddev_samp(r) * YEAR**0.5).otherwise(0.0)
    win, loss = F.avg(F.when(r > 0, r)), F.avg(F.when(r < 0, -r))
    return curve.groupBy(by).agg(
        annual.alias("annual_return"),
        vol.alias("annual_volatility"),
        F.coalesce((annual - risk_free) / F.when(vol != 0, vol), F.lit(0.0)).alias("sharpe_ratio"),
        F.least(F.min("_dd"), F.lit(0.0)).alias("max_drawdown"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.coalesce(win / loss, F.lit(0.0)).alias("profit_loss_ratio"),
    )


def monthly_pivot(df: DataFrame, ret: str, by: str = "ts_code") -> DataFrame:
    """Summed (not compounded) returns, one row per year, twelve month columns, 0 if absent."""
    months = list(range(1, 13))
    wide = (
        df.withColumns({"year": F.year("trade_date"), "_m": F.month("trade_date")})
        .groupBy(by, "year")
        .pivot("_m", months)
        .agg(F.sum(ret))
    )
    return wide.select(by, "year", *[F.coalesce(F.col(str(m)), F.lit(0.0)).alias(f"m{m:02d}") for m in months])


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations in long form, from one aggregation."""
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(*[safe_corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs) if a < b])
    index = {frozenset(p): str(i) for i, p in enumerate(pairs) if p[0] < p[1]}
    cells = [
        F.struct(
            F.lit(a).alias("feature_a"),
            F.lit(b).alias("feature_b"),
            (F.lit(1.0) if a == b else F.col(index[frozenset((a, b))])).alias("correlation"),
        )
        for a, b in pairs
    ]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def histogram(df: DataFrame, value: str, bins: int = 24, by: str = "ts_code") -> DataFrame:
    """Equal bins per instrument; the last bin is closed and empty bins are kept."""
    x = F.col(value)
    live = df.where(x.isNotNull())
    span = live.groupBy(by).agg(
        F.min(x).alias("lo"), ((F.max(x) - F.min(x)) / bins).alias("width"), F.avg(x).alias("mu"), F.stddev_pop(x).alias("sigma")
    )
    slot = F.least(F.floor(F.try_divide(x - F.col("lo"), F.col("width"))), F.lit(bins - 1)).cast("int")
    counted = live.join(span, by).withColumn("bin", F.coalesce(slot, F.lit(0))).groupBy(by, "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counted, [by, "bin"], "left").select(
        by, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("lower"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"), "mu", "sigma",
    )


def resample(df: DataFrame, period: str) -> DataFrame:
    """Week (Monday key), month or year bars with change against the previous period's close."""
    if period not in ("week", "month", "year"):
        raise ValueError(f"unknown period {period}")
    label = F.date_trunc(period, "trade_date").cast("date")
    w = Window.partitionBy("ts_code").orderBy("period_start")
    bars = df.groupBy("ts_code", label.alias("period_start")).agg(
        F.max("trade_date").alias("trade_date"),
        F.min_by("open", "trade_date").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "trade_date").alias("close"),
        F.sum(F.coalesce("vol", F.lit(0.0))).alias("vol"),
        F.sum(F.coalesce("amount", F.lit(0.0))).alias("amount"),
    )
    pre = F.coalesce(F.lag("close").over(w), F.col("open"))
    return bars.withColumn("pre_close", pre).withColumn("pct_chg", F.round((F.col("close") / nonzero("pre_close") - 1) * 100, 2))
