"""Splits, purging, scaling, metrics and models.

Split boundaries come from a ranking of distinct dates (one row per session), never from
ordering the samples themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspan.functions.frames import safe_corr
from barspan.functions.ranks import average_rank, average_ranks, long_form, position_quantile, positioned, row_order, with_average_rank
from barspan.functions.scalars import finite
from barspan.operators.clean import safe_features
from barspan.operators.tables import top_rows

KEY = ["ts_code", "trade_date"]


# -- splits -------------------------------------------------------------------------
def date_index(df: DataFrame, date: str = "trade_date") -> DataFrame:
    """Distinct dates with a 0-based index and their number: a calendar-bounded table."""
    days = df.select(date).distinct()
    w = Window.orderBy(date)
    return days.withColumns({"day_index": F.row_number().over(w) - 1, "days": F.count(F.lit(1)).over(Window.partitionBy())})


def _date_splits(df: DataFrame, train: float, val: float) -> DataFrame:
    """(trade_date, split) of the distinct dates: one row per session."""
    days, i = date_index(df), F.col("day_index")
    a, b = F.floor(F.col("days") * F.lit(train)), F.floor(F.col("days") * F.lit(train + val))
    split = F.when(i < a, "train").when(i < b, "val").otherwise("test")
    return days.select("trade_date", split.alias("split"))


def whole_date_split(df: DataFrame, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """``split`` in train/val/test by date; a date never falls into two sets."""
    return df.join(F.broadcast(_date_splits(df, train, val)), "trade_date")


def purged_split(samples: DataFrame, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """A label must be realised before the next split starts, else the sample is ``purged``.

    The splits' first dates come from the table of dates, so the samples are read for it once.
    """
    known = samples.where("label IS NOT NULL AND label_target_date IS NOT NULL")
    days = _date_splits(known, train, val)

    def first(split):
        return F.min(F.when(F.col("split") == split, F.col("trade_date"))).over(Window.partitionBy())  # one row per session

    days = days.withColumns({"_val": first("val"), "_test": first("test")})
    df = known.join(F.broadcast(days), "trade_date")
    target = F.col("label_target_date")
    touches = F.when(F.col("split") == "train", target >= F.col("_val")).when(F.col("split") == "val", target >= F.col("_test"))
    return df.withColumn("split", F.when(F.coalesce(touches, F.lit(False)), "purged").otherwise(F.col("split"))).drop("_val", "_test")


def split_summary(samples: DataFrame) -> DataFrame:
    return samples.groupBy("split").agg(
        F.count(F.lit(1)).alias("count"),
        F.min("trade_date").alias("signal_start"),
        F.max("trade_date").alias("signal_end"),
        F.max("label_target_date").alias("label_end"),
    )


def expanding_folds(rows: DataFrame, folds: int = 3, size: int = 100, minimum: int = 300) -> DataFrame:
    """Per instrument and fold: evaluation span, purged training count, rows purged.

    ``rows`` carry ``usable`` (features and label present) and ``target_date``. The last row
    is unlabelled, so the folds end one row before it.
    """
    w = Window.partitionBy("ts_code")
    numbered = rows.withColumns(
        {"_i": F.row_number().over(w.orderBy("trade_date")) - 1, "_n": F.count(F.lit(1)).over(w)}
    ).where(F.col("_n") > folds * size)
    each = numbered.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    begin = F.col("_n") - folds * size - 1 + F.col("fold") * size
    inside = (F.col("_i") >= begin) & (F.col("_i") < begin + size)
    each = each.withColumns({"_eval": inside, "_start": F.min(F.when(inside, F.col("trade_date"))).over(Window.partitionBy("ts_code", "fold"))})
    earlier = F.col("usable") & (F.col("trade_date") < F.col("_start"))
    train = earlier & (F.col("target_date") < F.col("_start"))
    out = each.groupBy("ts_code", "fold").agg(
        F.min("_start").alias("eval_start"),
        F.max(F.when(F.col("_eval"), F.col("trade_date"))).alias("eval_end"),
        F.count(F.when(F.col("_eval"), 1)).alias("eval_rows"),
        F.count(F.when(train, 1)).alias("train_rows"),
        (F.count(F.when(earlier, 1)) - F.count(F.when(train, 1))).alias("purged_rows"),
    )
    return out.withColumn("enough", F.col("train_rows") >= minimum)


def nested_validation(samples: DataFrame, early: float = 0.6) -> DataFrame:
    """Split the validation dates into an early part (purged at the cut) and a comparison part."""
    val = samples.where("split = 'val'")
    days = date_index(val)
    cut = days.where(F.col("day_index") == F.floor(F.col("days") * F.lit(early))).select("trade_date").scalar()
    phase = F.when(F.col("trade_date") >= cut, "compare").when(F.col("label_target_date") < cut, "early")
    return samples.where("split IN ('train', 'val')").withColumn(
        "phase", F.when(F.col("split") == "train", "train").otherwise(F.coalesce(phase, F.lit("purged")))
    )


def probe_split(samples: DataFrame, ratio: float = 0.9) -> DataFrame:
    known = samples.where("label IS NOT NULL AND label_target_date IS NOT NULL")
    days = date_index(known)
    cut = days.where(F.col("day_index") == F.floor(F.col("days") * F.lit(ratio))).select("trade_date").scalar()
    part = F.when(F.col("trade_date") >= cut, "val").when(F.col("label_target_date") < cut, "train").otherwise("purged")
    return known.withColumn("split", part)


def month_holdout(df: DataFrame, month) -> DataFrame:
    """Rows before a calendar month and rows inside it."""
    first = F.trunc(F.lit(month).cast("date"), "month")
    part = F.when(F.col("trade_date") < first, "before").when(F.col("trade_date") < F.add_months(first, 1), "month")
    return df.withColumn("split", part).where(F.col("split").isNotNull())


def row_split(rows: DataFrame, a: float = 0.6, b: float = 0.8) -> DataFrame:
    """Single-instrument bands by row index with strict target purge; the last row is ``latest``.

    Boundaries are fixed before features or labels filter any row.
    """
    w = Window.partitionBy("ts_code")
    n = F.count(F.lit(1)).over(w)
    df = rows.withColumns({"_i": F.row_number().over(w.orderBy("trade_date")) - 1, "_n": n})

    def first(q):
        return F.min(F.when(F.col("_i") == F.floor(F.col("_n") * F.lit(q)), F.col("trade_date"))).over(w)

    df = df.withColumns({"_val": first(a), "_test": first(b)})
    d, target = F.col("trade_date"), F.col("target_date")
    labelled = F.col("usable") & target.isNotNull()
    part = (
        F.when(F.col("featured") & (F.col("_i") == F.col("_n") - 1), "latest")
        .when(labelled & (d >= F.col("_test")), "test")
        .when(labelled & (d >= F.col("_val")) & (target < F.col("_test")), "val")
        .when(labelled & (d < F.col("_val")) & (target < F.col("_val")), "train")
    )
    return df.withColumn("split", part).where(F.col("split").isNotNull()).drop("_i", "_n", "_val", "_test")


def unseen(df: DataFrame, seen_through) -> DataFrame:
    return df.where(F.col("trade_date") > F.lit(seen_through).cast("date"))


def boundary_context(df: DataFrame, boundary) -> DataFrame:
    """Keep every row as window context; null the labels that touch the validation boundary."""
    cut = F.lit(boundary).cast("date")
    mature = finite("label").isNotNull() & F.col("label_target_date").isNotNull()
    train = mature & (F.col("trade_date") < cut) & (F.col("label_target_date") < cut)
    val = mature & (F.col("trade_date") >= cut)
    phase = F.when(train, "train").when(val, "val").otherwise("context")
    return df.withColumns({"phase": phase, "label": F.when(train | val, F.col("label"))})


def boundary_summary(df: DataFrame, boundary, tail: int = 5) -> DataFrame:
    """Mature rows and last dates per phase, and whether exactly the last sessions are unlabelled."""
    ctx = boundary_context(df.withColumn("_known", finite("label").isNotNull()), boundary)

    def last(phase, col):
        return F.max(F.when(F.col("phase") == phase, F.col(col)))

    days = date_index(df)
    start = days.where(F.col("day_index") == F.col("days") - tail).select("trade_date").scalar()
    late = F.col("trade_date") >= start
    return ctx.agg(
        F.count(F.when(F.col("phase") == "train", 1)).alias("train_rows"),
        F.count(F.when(F.col("phase") == "val", 1)).alias("validation_rows"),
        last("train", "trade_date").alias("train_signal_end"),
        last("train", "label_target_date").alias("train_target_end"),
        last("val", "trade_date").alias("validation_signal_end"),
        last("val", "label_target_date").alias("validation_target_end"),
        F.count(F.when(late & F.col("_known"), 1)).alias("labelled_in_tail"),
        F.count(F.when(~late & ~F.col("_known"), 1)).alias("unlabelled_before_tail"),
    )


# -- scaling and assembly -----------------------------------------------------------
def impute_train_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill with the training median; a column without training values gets 0."""
    tall = long_form(df.where("split = 'train'"), [], columns)
    medians = position_quantile(positioned(tall, ["measure"], "value"), ["measure"], "value", 0.5, "m")
    row = medians.agg(*[F.max(F.when(F.col("measure") == i, F.col("m"))).alias(c) for i, c in enumerate(columns)])
    return df.withColumns({c: F.coalesce(F.col(c), row.select(c).scalar(), F.lit(0.0)) for c in columns})


def scale_on_train(df: DataFrame, columns: list[str], kind: str = "standard") -> DataFrame:
    """Standard (population deviation) or min-max scaling with training statistics only."""
    if kind not in ("standard", "minmax"):
        raise ValueError(f"unknown scaler {kind}")
    train = df.where("split = 'train'")
    a, b = (F.avg, F.stddev_pop) if kind == "standard" else (F.min, F.max)
    stats = train.agg(*[a(c).alias(f"a_{c}") for c in columns], *[b(c).alias(f"b_{c}") for c in columns])
    out = {}
    for c in columns:
        lo, hi = stats.select(f"a_{c}").scalar(), stats.select(f"b_{c}").scalar()
        width = hi if kind == "standard" else hi - lo
        out[c] = (F.col(c) - lo) / F.when(width == 0, F.lit(1.0)).otherwise(width)
    return df.withColumns(out)


def assemble(df: DataFrame, candidates: list[str], target: str) -> DataFrame:
    """Leak-free features and target per split, rows with any undefined value dropped."""
    features = safe_features(candidates, df.columns)
    clean = df.withColumns({c: finite(c) for c in [*features, target]})
    usable = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*features, target]])
    return whole_date_split(clean).where(usable).select(*KEY, "split", *features, target)


# -- metrics ------------------------------------------------------------------------
def regression_metrics(df: DataFrame, by: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """RMSE, MAE and R²; R² is null for a constant target."""
    e, y = F.col(actual) - F.col(predicted), F.col(actual)
    total = F.var_pop(y) * F.count(y)
    return (
        df.where(y.isNotNull() & F.col(predicted).isNotNull())
        .groupBy(*by)
        .agg(
            F.sqrt(F.avg(e * e)).alias("rmse"),
            F.avg(F.abs(e)).alias("mae"),
            F.when(F.min(y) < F.max(y), 1 - F.sum(e * e) / total).alias("r2"),
        )
    )


def classification_metrics(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 and AUC of ``probability`` against ``label``.

    AUC is the rank sum of the positives, from distributed average ranks.
    """
    hit, y = F.col("probability") > threshold, F.col("label") == 1
    counts = df.agg(
        F.count(F.when(hit & y, 1)).alias("tp"),
        F.count(F.when(hit & ~y, 1)).alias("fp"),
        F.count(F.when(~hit & y, 1)).alias("fn"),
        F.count(F.when(~hit & ~y, 1)).alias("tn"),
    )
    mass = df.groupBy("probability").agg(F.count(F.lit(1)).alias("_count"), F.sum("label").alias("_p"))
    placed = positioned(mass, [], "probability", weight="_count")
    rank_sum = placed.agg(F.sum(F.col("_p") * average_rank()).alias("s"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, n = tp + fn, fp + tn
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, p)
    return counts.withColumns(
        {
            "accuracy": (tp + tn) / (p + n),
            "precision": precision,
            "recall": recall,
            "f1": F.try_divide(2 * precision * recall, precision + recall),
            "auc": F.try_divide(rank_sum.select("s").scalar() - p * (p + 1) / 2, p * n),
        }
    )


def weighted_f1(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Multi-class accuracy and support-weighted F1 from one confusion table."""
    cells = df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("_n"))  # classes squared
    same = F.when(F.col(actual) == F.col(predicted), F.col("_n")).otherwise(0)
    rows = cells.groupBy(F.col(actual).alias("_c")).agg(F.sum("_n").alias("support"), F.sum(same).alias("tp"))
    cols = cells.groupBy(F.col(predicted).alias("_c")).agg(F.sum("_n").alias("called"))
    each = rows.join(cols, "_c", "left").na.fill(0, ["called"])
    f1 = 2 * F.col("tp") / (F.col("support") + F.col("called"))
    total = F.sum("support")
    return each.agg(
        total.alias("rows"), (F.sum("tp") / total).alias("accuracy"), (F.sum(f1 * F.col("support")) / total).alias("weighted_f1")
    )


def daily_rank_ic(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Spearman correlation per date; null where either side is constant.

    Rounded to twelve decimals, so that an exactly zero correlation has no random sign.
    """
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(*KEY, score, label)
    ranked = average_ranks(known, KEY, "trade_date", [score, label])
    a, b = F.col(f"{score}_rank"), F.col(f"{label}_rank")
    live = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return ranked.groupBy("trade_date").agg(F.count(F.lit(1)).alias("rows"), F.when(live, F.round(safe_corr(a, b), 12)).alias("rank_ic"))


def ranking_metrics(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    ic = daily_rank_ic(df, score, label).agg(
        F.avg("rank_ic").alias("mean_daily_rank_ic"),
        F.count("rank_ic").alias("defined_dates"),
        F.count(F.lit(1)).alias("total_dates"),
        (F.count(F.when(F.col("rank_ic") > 0, 1)) / F.nullif(F.count("rank_ic"), F.lit(0))).alias("positive_daily_fraction"),
    )
    e = F.col(score) - F.col(label)
    rmse = df.agg(F.sqrt(F.avg(e * e)).alias("r")).select("r").scalar()
    return ic.withColumn("rmse", rmse)


def trial_metrics(df: DataFrame, scores: list[str], label: str = "label") -> DataFrame:
    """(name, mean_daily_rank_ic, defined_dates, total_dates) of several scores over the rows that have them all.

    The label is ranked once. The scores are ranked together, each row taking the label's rank along, so the
    correlations are sums per date and nothing is joined back on the keys.
    """
    known = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*scores, label]]))
    known = known.select("trade_date", F.hash("ts_code").alias("_row"), *scores, label)  # the hash keeps equal rows apart
    placed = with_average_rank(known, ["trade_date"], label, "_label_rank")
    ranked = positioned(long_form(placed, ["trade_date", "_row", "_label_rank"], scores), ["trade_date", "measure"], "value")
    a, b = average_rank(), F.col("_label_rank")
    live = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    day = ranked.groupBy("trade_date", "measure").agg(F.when(live, F.round(safe_corr(a, b), 12)).alias("rank_ic"))
    name = F.get(F.array(*map(F.lit, scores)), F.col("measure"))
    return day.groupBy(name.alias("name")).agg(
        F.avg("rank_ic").alias("mean_daily_rank_ic"), F.count("rank_ic").alias("defined_dates"), F.count(F.lit(1)).alias("total_dates")
    )


def decile_diagnostics(df: DataFrame) -> DataFrame:
    """Per date: matched rows, mean label of the top and bottom decile by score, and of all."""
    matched = df.where("label IS NOT NULL")
    placed = row_order(matched, ["trade_date"], "score", True, "ts_code", "position")
    k = F.greatest(F.floor(F.col("n") / 10), F.lit(1))
    top, bottom = F.col("position") <= k, F.col("position") > F.col("n") - k
    day = placed.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("matched_rows"),
        F.avg(F.when(top, F.col("label"))).alias("top_decile_mean"),
        F.avg(F.when(bottom, F.col("label"))).alias("bottom_decile_mean"),
        F.avg("label").alias("universe_mean"),
    )
    scored = df.groupBy("trade_date").agg(F.count(F.lit(1)).alias("scored_rows"))
    return scored.join(day, "trade_date", "left")


def score_summary(df: DataFrame) -> DataFrame:
    """Coverage, RMSE against zero prediction, and sign agreement over matched rows."""
    y, p = F.col("label"), F.col("score")
    return df.agg(
        F.count(F.lit(1)).alias("scored_rows"),
        F.count(y).alias("matched_rows"),
        F.sqrt(F.avg((p - y) * (p - y))).alias("rmse"),
        F.sqrt(F.avg(y * y)).alias("zero_rmse"),
        F.avg(F.when(y.isNotNull(), (F.signum(p) == F.signum(y)).cast("double"))).alias("direction_accuracy"),
    )


def _top_mean(df: DataFrame, score: str, k: int, alias: str) -> DataFrame:
    best = top_rows(df, [F.desc(score), F.asc("ts_code")], k, ["trade_date"])
    return best.groupBy("trade_date").agg(F.avg("label").alias(alias))


def top_k_returns(df: DataFrame, k: int = 5) -> DataFrame:
    """Daily mean label of the raw, adjusted and momentum top ``k`` against equal weight."""
    known = df.where("label IS NOT NULL")
    day = known.groupBy("trade_date").agg(F.count(F.lit(1)).alias("rows"), F.avg("label").alias("equal_weight"))
    out = day.where(F.col("rows") >= k)
    for score in ("raw", "adjusted", "momentum"):
        out = out.join(F.broadcast(_top_mean(known, score, k, f"{score}_top")), "trade_date")  # one row per session
    return out.withColumns(
        {"raw_excess": F.col("raw_top") - F.col("equal_weight"), "adjusted_excess": F.col("adjusted_top") - F.col("equal_weight")}
    )


def top_k_quality(df: DataFrame, k: int = 5) -> DataFrame:
    """Predicted, best and random top-``k`` label sums per date, with ratios and a final score."""
    known = df.where("label IS NOT NULL")
    day = known.groupBy("trade_date").agg(F.count(F.lit(1)).alias("rows"), (F.avg("label") * k).alias("random_sum"))
    pred = _top_mean(known, "score", k, "_p").withColumn("pred_sum", F.col("_p") * k).drop("_p")
    best = _top_mean(known, "label", k, "_b").withColumn("max_sum", F.col("_b") * k).drop("_b")
    out = day.where(F.col("rows") >= k).join(F.broadcast(pred), "trade_date").join(F.broadcast(best), "trade_date")
    p, m, r = F.col("pred_sum"), F.col("max_sum"), F.col("random_sum")
    live = F.abs(m) > 1e-9
    return out.withColumns(
        {
            "ratio_pred": F.when(live, p / (m + 1e-12)).otherwise(0.0),
            "ratio_random": F.when(live, r / (m + 1e-12)).otherwise(0.0),
            "final_score": F.when(F.abs(m - r) > 1e-6, (p - r) / (m - r + 1e-12)).otherwise(0.0),
        }
    )


def aggregate_seeds(daily: DataFrame) -> DataFrame:
    """Mean over dates inside a seed, then mean, deviation and range over seeds per mode."""
    per_seed = daily.groupBy("seed", "mode").agg(F.avg("value").alias("v"))
    return per_seed.groupBy("mode").agg(
        F.count(F.lit(1)).alias("seeds"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )


def paired_modes(daily: DataFrame, left: str, right: str) -> DataFrame:
    """Per seed: mean of mode ``left`` minus mean of mode ``right``."""

    def mean(mode):
        return F.avg(F.when(F.col("mode") == mode, F.col("value")))

    return daily.groupBy("seed").agg((mean(left) - mean(right)).alias("difference"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("rows"))
    every = Window.partitionBy()  # one row per class
    return counts.withColumn("weight", F.sum("rows").over(every) / (F.count(F.lit(1)).over(every) * F.col("rows")))


def importance_list(features: DataFrame, importances: DataFrame) -> DataFrame:
    """Every feature with its importance, 0 if the model never used it; best first, then name."""
    out = features.join(importances, "feature", "left").withColumn("importance", F.coalesce("importance", F.lit(0.0)))
    return out.orderBy(F.desc("importance"), "feature")


def beats_noise(importances: DataFrame) -> DataFrame:
    """Keep a feature if any task ranks it above that task's best noise column."""
    bar = importances.where("is_noise").groupBy("task").agg(F.max("importance").alias("threshold"))
    real = importances.where("NOT is_noise").join(F.broadcast(bar), "task")  # one row per task
    return real.groupBy("feature").agg(
        F.max((F.col("importance") > F.col("threshold")).cast("int")).alias("keep"), F.max("importance").alias("best")
    )


def probability_signal(p: Column, threshold: float = 0.55) -> Column:
    if not 0.5 < threshold < 1:
        raise ValueError("threshold must lie between 0.5 and 1")
    return F.when(p > threshold, 1).when(p < 1 - threshold, -1).otherwise(0)


def select_trial(trials: DataFrame, control: str) -> DataFrame:
    """Largest mean IC, ties by name; qualified only if it beats the control on all dates."""
    base = trials.where(F.col("name") == control).select(F.col("mean_daily_rank_ic").alias("b")).select("b").scalar()
    best = trials.where("mean_daily_rank_ic IS NOT NULL").orderBy(F.desc("mean_daily_rank_ic"), "name").limit(1)
    ok = (
        (F.col("name") != control)
        & (F.col("mean_daily_rank_ic") > 0)
        & (F.col("mean_daily_rank_ic") > base)
        & (F.col("defined_dates") == F.col("total_dates"))
    )
    return best.withColumn("qualified", F.coalesce(ok, F.lit(False)))
