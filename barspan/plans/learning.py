"""Splits, purges, scaling, metrics and model jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspan.functions.frames import change, following, rolling
from barspan.functions.scalars import return_class
from barspan.operators import learning as L
from barspan.operators import market as M
from barspan.operators import models as D
from barspan.operators import quality as Q
from barspan.operators import sequence as S
from barspan.plans.oracle import R
from barspan.plans.registry import query, rounded
from barspan.plans.sequence import _LAB
from barspan.plans.technical import K, OVER, win
from barspan.session import cut_lineage

FEATURES = ["ret", "bias5", "vr"]


def _samples(t, bars=None):
    """Features and a five-row label for every bar."""
    bars = t.bars if bars is None else bars
    df = M.forward_label(bars.withColumn("ret", change("close")))
    ma5, v5 = rolling(F.avg, "close", 5), rolling(F.avg, "vol", 5)
    return df.withColumns({"bias5": F.col("close") / ma5 - 1, "vr": F.col("vol") / v5})


_SAM = f"""SELECT *, lead(close, 5) {OVER} / close - 1 AS label, lead(trade_date, 5) {OVER} AS target, close / {win('avg(close)', 5, 'close')} - 1 AS bias5,
    vol / {win('avg(vol)', 5, 'vol')} AS vr FROM rets"""
_IDX = "SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM {})"
_CUT = "CASE WHEN i < floor(n * 0.6::DOUBLE) THEN 'train' WHEN i < floor(n * 0.8::DOUBLE) THEN 'val' ELSE 'test' END"


@query("m1_whole_date_split", f"SELECT ts_code, trade_date, {_CUT} AS split FROM bars JOIN idx USING (trade_date)", idx=_IDX.format("bars"))
def _(t):
    return L.whole_date_split(t.bars).select(*K, "split")


_PURGED = {
    "sam": _SAM,
    "known": "SELECT * FROM sam WHERE label IS NOT NULL",
    "kidx": _IDX.format("known"),
    "cut0": f"SELECT known.*, {_CUT} AS split0 FROM known JOIN kidx USING (trade_date)",
    "cuts": """SELECT *, CASE WHEN split0 = 'train' AND target >= (SELECT min(trade_date) FROM cut0 WHERE split0 = 'val') THEN 'purged'
      WHEN split0 = 'val' AND target >= (SELECT min(trade_date) FROM cut0 WHERE split0 = 'test') THEN 'purged' ELSE split0 END AS split FROM cut0""",
}


@query("m2_purged_samples", f"SELECT ts_code, trade_date, target AS label_target_date, {R('label', 'label')}, split FROM cuts", **_PURGED)
def _(t):
    return rounded(L.purged_split(_samples(t)).select(*K, "label_target_date", "label", "split"))


@query("m2_split_summary", "SELECT split, count(*) AS count, min(trade_date) AS signal_start, max(trade_date) AS signal_end, max(target) AS label_end FROM cuts GROUP BY 1", **_PURGED)
def _(t):
    return L.split_summary(L.purged_split(_samples(t)))


@query(
    "m3_expanding_folds",
    """SELECT ts_code, fold, min(st) AS eval_start, max(trade_date) FILTER (ev) AS eval_end, count(*) FILTER (ev) AS eval_rows, count(*) FILTER (usable AND trade_date < st AND target < st) AS train_rows,
    count(*) FILTER (usable AND trade_date < st) - count(*) FILTER (usable AND trade_date < st AND target < st) AS purged_rows, count(*) FILTER (usable AND trade_date < st AND target < st) >= 300 AS enough
    FROM (SELECT *, min(trade_date) FILTER (ev) OVER (PARTITION BY ts_code, fold) AS st FROM
      (SELECT *, i >= n - 301 + fold * 100 AND i < n - 201 + fold * 100 AS ev FROM
        (SELECT ts_code, trade_date, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY ts_code) AS n, lead(trade_date) OVER w AS target,
          row_number() OVER w >= 60 AND lead(close) OVER w IS NOT NULL AS usable FROM nbars WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date)),
        (SELECT unnest([0, 1, 2]) AS fold) WHERE n > 300)) GROUP BY 1, 2""",
)
def _(t):
    ma60 = rolling(F.avg, "close", 60)
    rows = t.nation_bars.select(
        *K, following("trade_date").alias("target_date"),
        (ma60.isNotNull() & change("close", 10).isNotNull() & following("close").isNotNull()).alias("usable"),
    )
    return L.expanding_folds(rows)


@query(
    "m4_nested_validation",
    """SELECT phase, count(*) AS rows, min(trade_date) AS first_date, max(trade_date) AS last_date FROM (SELECT *, CASE WHEN split = 'train' THEN 'train' WHEN trade_date >= cut THEN 'compare'
    WHEN target < cut THEN 'early' ELSE 'purged' END AS phase FROM cuts, (SELECT trade_date AS cut FROM vidx WHERE i = floor(n * 0.6::DOUBLE)) WHERE split IN ('train', 'val')) GROUP BY 1""",
    **_PURGED,
    valrows="SELECT * FROM cuts WHERE split = 'val'",
    vidx=_IDX.format("valrows"),
)
def _(t):
    out = L.nested_validation(L.purged_split(_samples(t)))
    return out.groupBy("phase").agg(F.count(F.lit(1)).alias("rows"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


@query(
    "m5_probe_split",
    """SELECT ts_code, trade_date, CASE WHEN trade_date >= cut THEN 'val' WHEN target < cut THEN 'train' ELSE 'purged' END AS split
    FROM known, (SELECT trade_date AS cut FROM kidx WHERE i = floor(n * 0.9::DOUBLE))""",
    **_PURGED,
)
def _(t):
    return L.probe_split(_samples(t)).select(*K, "split")


_TRAINED = {**_PURGED, "trainset": "SELECT * FROM cuts WHERE split = 'train'"}


@query(
    "m6_standard_scaling",
    f"SELECT ts_code, trade_date, {R('(ret - m) / s', 'ret', 5)} FROM (SELECT ts_code, trade_date, coalesce(ret, (SELECT median(ret) FROM trainset), 0) AS ret FROM cuts), (SELECT avg(coalesce(ret, (SELECT median(ret) FROM trainset), 0)) AS m, stddev_pop(coalesce(ret, (SELECT median(ret) FROM trainset), 0)) AS s FROM trainset)",
    **_TRAINED,
)
def _(t):
    df = L.impute_train_median(L.purged_split(_samples(t)), ["ret"])
    return rounded(L.scale_on_train(df, ["ret"]).select(*K, "ret"), 5)


@query(
    "m6_min_max_scaling",
    f"SELECT ts_code, trade_date, {R('(close - a) / (b - a)', 'close')}, {R('(vol - c) / (d - c)', 'vol')} FROM cuts, (SELECT min(close) AS a, max(close) AS b, min(vol) AS c, max(vol) AS d FROM trainset)",
    **_TRAINED,
)
def _(t):
    return rounded(L.scale_on_train(L.purged_split(_samples(t)), ["close", "vol"], "minmax").select(*K, "close", "vol"))


@query(
    "m7_assembled_samples",
    f"SELECT ts_code, trade_date, {_CUT} AS split, {R('ret', 'ret')}, {R('bias5', 'bias5')}, {R('vr', 'vr')}, {R('label', 'label')} FROM sam JOIN idx USING (trade_date) WHERE ret IS NOT NULL AND bias5 IS NOT NULL AND vr IS NOT NULL AND label IS NOT NULL",
    sam=_SAM,
    idx=_IDX.format("bars"),
)
def _(t):
    wanted = ["label_target_date", "ts_code", *FEATURES, "future_return_5d"]  # identities and labels are dropped
    return rounded(L.assemble(_samples(t), wanted, "label"))


@query("f10_leakage_guard", "SELECT ts_code, trade_date, close, vol FROM bars")
def _(t):
    from barspan.operators.clean import safe_features

    df = M.forward_label(t.bars.select(*K, "close", "vol"))
    return df.select(*K, *safe_features(df.columns))


@query(
    "m14_boundary_context",
    f"""SELECT ts_code, trade_date, phase, {R("CASE WHEN phase <> 'context' THEN label END", 'label')} FROM (SELECT *, CASE WHEN label IS NOT NULL AND trade_date < DATE '2000-07-01' AND label_target_date < DATE '2000-07-01' THEN 'train'
    WHEN label IS NOT NULL AND trade_date >= DATE '2000-07-01' THEN 'val' ELSE 'context' END AS phase FROM lab)""",
    lab=_LAB,
)
def _(t):
    return rounded(L.boundary_context(S.open_to_open_label(t.bars), "2000-07-01").select(*K, "phase", "label"))


@query(
    "m15_boundary_summary",
    """SELECT count(*) FILTER (tr) AS train_rows, count(*) FILTER (va) AS validation_rows, max(trade_date) FILTER (tr) AS train_signal_end, max(label_target_date) FILTER (tr) AS train_target_end,
    max(trade_date) FILTER (va) AS validation_signal_end, max(label_target_date) FILTER (va) AS validation_target_end, count(*) FILTER (late AND label IS NOT NULL) AS labelled_in_tail,
    count(*) FILTER (NOT late AND label IS NULL) AS unlabelled_before_tail FROM (SELECT *, label IS NOT NULL AND trade_date < DATE '2000-07-01' AND label_target_date < DATE '2000-07-01' AS tr,
    label IS NOT NULL AND trade_date >= DATE '2000-07-01' AS va, trade_date >= (SELECT trade_date FROM idx WHERE i = n - 5) AS late FROM rlab)""",
    rlab=_LAB.replace("FROM rets", "FROM rrets").replace("FROM bars", "FROM rbars"),
    idx=_IDX.format("rbars"),
)
def _(t):
    return L.boundary_summary(S.open_to_open_label(t.region_bars), "2000-07-01")


@query("m16_month_holdout", "SELECT ts_code, trade_date, CASE WHEN trade_date < DATE '2000-03-01' THEN 'before' ELSE 'month' END AS split FROM bars WHERE trade_date < DATE '2000-04-01'")
def _(t):
    return L.month_holdout(t.bars, "2000-03-15").select(*K, "split")


@query(
    "m17_sample_matrix",
    """SELECT split, count(*) AS count, min(trade_date) AS signal_start, max(trade_date) AS signal_end, max(target) AS label_end FROM mcuts GROUP BY 1""",
    qual="""SELECT b.ts_code, b.trade_date, s2.trade_date AS target, c.close / b.close - 1 AS label FROM (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) - 1 AS age FROM bars) b
      JOIN master m ON m.ts_code = b.ts_code JOIN sessions s1 ON s1.trade_date = b.trade_date JOIN sessions s2 ON s2.ordinal = s1.ordinal + 5 JOIN bars c ON c.ts_code = b.ts_code AND c.trade_date = s2.trade_date
      WHERE age >= 120 AND b.trade_date <= DATE '2001-06-29' AND s2.trade_date <= DATE '2001-06-29' AND b.trade_date >= list_date AND (delist_date IS NULL OR (b.trade_date < delist_date AND s2.trade_date < delist_date))""",
    qidx=_IDX.format("qual"),
    mcut0=f"SELECT qual.*, {_CUT} AS split0 FROM qual JOIN qidx USING (trade_date)",
    mcuts=_PURGED["cuts"].replace("cut0", "mcut0"),
)
def _(t):
    q = Q.qualify_samples(t.master, Q.session_ordinals(t.calendar), t.bars, Q.halt_days(t.suspensions).where("full_day"), "2001-06-29")
    eligible = q.where("reason IS NULL").withColumnRenamed("target_date", "label_target_date")
    eligible = cut_lineage(eligible.select("trade_date", "label_target_date", "label"), "eligible")  # the split reads it twice
    return L.split_summary(L.purged_split(eligible))


@query(
    "m18_row_split",
    """SELECT ts_code, trade_date, split FROM (SELECT *, CASE WHEN n60 AND i = n - 1 THEN 'latest' WHEN n60 AND target IS NOT NULL AND trade_date >= ts THEN 'test'
    WHEN n60 AND target IS NOT NULL AND trade_date >= vs AND target < ts THEN 'val' WHEN n60 AND target IS NOT NULL AND trade_date < vs AND target < vs THEN 'train' END AS split FROM
    (SELECT *, min(trade_date) FILTER (i = floor(n * 0.6::DOUBLE)) OVER (PARTITION BY ts_code) AS vs, min(trade_date) FILTER (i = floor(n * 0.8::DOUBLE)) OVER (PARTITION BY ts_code) AS ts FROM
    (SELECT ts_code, trade_date, rn - 1 AS i, count(*) OVER (PARTITION BY ts_code) AS n, rn >= 60 AS n60, lead(trade_date) OVER (PARTITION BY ts_code ORDER BY trade_date) AS target FROM rets))) WHERE split IS NOT NULL""",
)
def _(t):
    ready = rolling(F.avg, "close", 60).isNotNull() & change("close", 10).isNotNull()
    rows = t.bars.select(*K, following("trade_date").alias("target_date"), ready.alias("featured"), (ready & following("close").isNotNull()).alias("usable"))
    return L.row_split(rows).select(*K, "split")


# -- metrics ------------------------------------------------------------------------
_PRED = {"pred": f"SELECT ts_code, trade_date, lead(close) {OVER} / close - 1 AS actual, ret / 10 AS predicted FROM rets"}


@query(
    "a17_regression_metrics",
    f"""SELECT ts_code, {R('sqrt(avg(pow(actual - predicted, 2)))', 'rmse')}, {R('avg(abs(actual - predicted))', 'mae')},
    {R('CASE WHEN min(actual) < max(actual) THEN 1 - sum(pow(actual - predicted, 2)) / (var_pop(actual) * count(*)) END', 'r2')} FROM pred WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY 1""",
    **_PRED,
)
def _(t):
    df = t.bars.select(*K, (following("close") / F.col("close") - 1).alias("actual"), (change("close") / 10).alias("predicted"))
    return rounded(L.regression_metrics(df, ["ts_code"]))


_PROB = {
    "prob": f"SELECT ts_code, trade_date, (close - low) / (high - low + 1e-12::DOUBLE) AS p, CASE WHEN lead(close) {OVER} > close THEN 1 ELSE 0 END AS y, lead(close) {OVER} IS NOT NULL AS ok FROM bars",
    "scored": "SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM prob WHERE ok",
}


def _prob(t):
    p = (F.col("close") - F.col("low")) / (F.col("high") - F.col("low") + 1e-12)
    nxt = following("close")
    return t.bars.select(*K, p.alias("probability"), F.when(nxt.isNotNull(), (nxt > F.col("close")).cast("int")).alias("label")).where("label IS NOT NULL")


@query(
    "a18_classification_metrics",
    f"""SELECT tp, fp, fn, tn, {R('(tp + tn) / (tp + fp + fn + tn)', 'accuracy')}, {R('tp / (tp + fp)', 'precision')}, {R('tp / (tp + fn)', 'recall')},
    {R('2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn))', 'f1')}, {R('(s - (tp + fn) * (tp + fn + 1) / 2) / ((tp + fn) * (fp + tn))', 'auc')}
    FROM (SELECT count(*) FILTER (p > 0.5 AND y = 1) AS tp, count(*) FILTER (p > 0.5 AND y = 0) AS fp, count(*) FILTER (p <= 0.5 AND y = 1) AS fn, count(*) FILTER (p <= 0.5 AND y = 0) AS tn, sum(r) FILTER (y = 1) AS s FROM scored)""",
    **_PROB,
)
def _(t):
    return rounded(L.classification_metrics(_prob(t)))


_CLS = "CASE WHEN {0} < -0.03 THEN 0 WHEN {0} < -0.01 THEN 1 WHEN {0} < 0.01 THEN 2 WHEN {0} < 0.03 THEN 3 WHEN {0} IS NOT NULL THEN 4 END"
_TWOCLS = {"cls": f"SELECT {_CLS.format('actual')} AS a, {_CLS.format('predicted')} AS p FROM pred WHERE actual IS NOT NULL AND predicted IS NOT NULL", **_PRED}


@query(
    "a18_weighted_f1",
    f"""SELECT CAST(sum(support) AS BIGINT) AS rows, {R('sum(tp) / sum(support)', 'accuracy')}, {R('sum(2 * tp / (support + called) * support) / sum(support)', 'weighted_f1')} FROM
    (SELECT a, count(*) AS support, count(*) FILTER (a = p) AS tp, (SELECT count(*) FROM cls c WHERE c.p = cls.a) AS called FROM cls GROUP BY a)""",
    **_TWOCLS,
)
def _(t):
    df = t.bars.select((following("close") / F.col("close") - 1).alias("x"), (change("close") / 10).alias("z"))
    df = df.where("x IS NOT NULL AND z IS NOT NULL").select(return_class("x").alias("a"), return_class("z").alias("p"))
    return rounded(L.weighted_f1(df, "a", "p"))


_RANKS = {
    "sam": _SAM,
    "pool": "SELECT ts_code, trade_date, ret AS score, label FROM sam WHERE ret IS NOT NULL AND label IS NOT NULL",
    "ranks": """SELECT *, rank() OVER (PARTITION BY trade_date ORDER BY score) + (count(*) OVER (PARTITION BY trade_date, score) - 1) / 2 AS rs,
      rank() OVER (PARTITION BY trade_date ORDER BY label) + (count(*) OVER (PARTITION BY trade_date, label) - 1) / 2 AS rl FROM pool""",
    "ics": "SELECT trade_date, count(*) AS rows, CASE WHEN min(rs) < max(rs) AND min(rl) < max(rl) THEN round(corr(rs, rl), 12) END AS ic FROM ranks GROUP BY 1",
}


def _pool(t):
    return _samples(t).where("ret IS NOT NULL AND label IS NOT NULL").select(*K, F.col("ret").alias("score"), "label", "close", "vol")


@query("a19_daily_rank_ic", f"SELECT trade_date, rows, {R('ic', 'rank_ic')} FROM ics", **_RANKS)
def _(t):
    return rounded(L.daily_rank_ic(_pool(t)))


@query(
    "a19_ranking_metrics",
    f"SELECT {R('avg(ic)', 'mean_daily_rank_ic')}, count(ic) AS defined_dates, count(*) AS total_dates, {R('count(*) FILTER (ic > 0) / count(ic)', 'positive_daily_fraction')}, {R('(SELECT sqrt(avg(pow(score - label, 2))) FROM pool)', 'rmse')} FROM ics",
    **_RANKS,
)
def _(t):
    return rounded(L.ranking_metrics(_pool(t)))


_DIAG = {
    "diag": """SELECT b.ts_code, b.trade_date, b.ret AS score, c.close / b.close - 1 AS label FROM (SELECT * FROM rets WHERE ret IS NOT NULL) b JOIN sessions s1 USING (trade_date)
      LEFT JOIN sessions s2 ON s2.ordinal = s1.ordinal + 5 LEFT JOIN bars c ON c.ts_code = b.ts_code AND c.trade_date = s2.trade_date""",
    "placed": "SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, ts_code) AS p, count(*) OVER (PARTITION BY trade_date) AS n FROM diag WHERE label IS NOT NULL",
}


def _diag(t):
    rows = t.bars.withColumn("score", change("close")).where("score IS NOT NULL").select(*K, "score", "close")
    rows = Q.target_session(rows, Q.session_ordinals(t.calendar), 5)
    later = t.bars.select("ts_code", F.col("trade_date").alias("target_date"), F.col("close").alias("c"))
    return rows.join(later, ["ts_code", "target_date"], "left").select(*K, "score", (F.col("c") / F.col("close") - 1).alias("label"))


@query(
    "a20_decile_diagnostics",
    f"""SELECT d.trade_date, scored_rows, matched_rows, {R('a', 'top_decile_mean')}, {R('b', 'bottom_decile_mean')}, {R('u', 'universe_mean')} FROM (SELECT trade_date, count(*) AS scored_rows FROM diag GROUP BY 1) d LEFT JOIN
    (SELECT trade_date, count(*) AS matched_rows, avg(label) FILTER (p <= greatest(n // 10, 1)) AS a, avg(label) FILTER (p > n - greatest(n // 10, 1)) AS b, avg(label) AS u FROM placed GROUP BY 1) USING (trade_date)""",
    **_DIAG,
)
def _(t):
    return rounded(L.decile_diagnostics(_diag(t)))


@query(
    "a20_score_summary",
    f"""SELECT count(*) AS scored_rows, count(label) AS matched_rows, {R('sqrt(avg(pow(score - label, 2)))', 'rmse')}, {R('sqrt(avg(label * label))', 'zero_rmse')},
    {R('avg(CASE WHEN label IS NOT NULL THEN CASE WHEN sign(score) = sign(label) THEN 1.0 ELSE 0.0 END END)', 'direction_accuracy')} FROM diag""",
    **_DIAG,
)
def _(t):
    return rounded(L.score_summary(_diag(t)))


def _topm(score, alias):
    return f"(SELECT trade_date, avg(label) AS {alias} FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY {score} DESC, ts_code) AS p FROM top0) WHERE p <= 5 GROUP BY 1)"


_TOP = {"sam": _SAM, "top0": "SELECT ts_code, trade_date, ret AS raw, ret * (1 - 1 / vol) AS adjusted, bias5 AS momentum, label FROM sam WHERE ret IS NOT NULL AND bias5 IS NOT NULL AND label IS NOT NULL"}


def _tops(t):
    df = _samples(t).where("ret IS NOT NULL AND bias5 IS NOT NULL AND label IS NOT NULL")
    return df.select(*K, F.col("ret").alias("raw"), (F.col("ret") * (1 - 1 / F.col("vol"))).alias("adjusted"), F.col("bias5").alias("momentum"), "label")


@query(
    "a21_top_k_returns",
    f"""SELECT trade_date, rows, {R('eq', 'equal_weight')}, {R('a', 'raw_top')}, {R('b', 'adjusted_top')}, {R('c', 'momentum_top')}, {R('a - eq', 'raw_excess')}, {R('b - eq', 'adjusted_excess')} FROM
    (SELECT trade_date, count(*) AS rows, avg(label) AS eq FROM top0 GROUP BY 1 HAVING count(*) >= 5) JOIN {_topm('raw', 'a')} USING (trade_date) JOIN {_topm('adjusted', 'b')} USING (trade_date) JOIN {_topm('momentum', 'c')} USING (trade_date)""",
    **_TOP,
)
def _(t):
    return rounded(L.top_k_returns(_tops(t)))


@query(
    "a22_top_k_quality",
    f"""SELECT trade_date, rows, {R('r', 'random_sum', 5)}, {R('p', 'pred_sum', 5)}, {R('m', 'max_sum', 5)}, {R('CASE WHEN abs(m) > 1e-9 THEN p / (m + 1e-12) ELSE 0 END', 'ratio_pred', 4)},
    {R('CASE WHEN abs(m) > 1e-9 THEN r / (m + 1e-12) ELSE 0 END', 'ratio_random', 4)}, {R('CASE WHEN abs(m - r) > 1e-6 THEN (p - r) / (m - r + 1e-12) ELSE 0 END', 'final_score', 4)} FROM
    (SELECT trade_date, count(*) AS rows, avg(label) * 5 AS r FROM top0 GROUP BY 1 HAVING count(*) >= 5) JOIN (SELECT trade_date, a * 5 AS p FROM {_topm('raw', 'a')}) USING (trade_date)
    JOIN (SELECT trade_date, b * 5 AS m FROM {_topm('label', 'b')}) USING (trade_date)""",
    **_TOP,
)
def _(t):
    df = _tops(t).withColumnRenamed("raw", "score").drop("adjusted", "momentum")
    return rounded(L.top_k_quality(df), 4, random_sum=5, pred_sum=5, max_sum=5)


_SEEDS = {"daily": "SELECT l_linenumber % 3 AS seed, l_returnflag AS mode, trade_date, avg(l_discount - l_tax) AS value FROM ticks GROUP BY 1, 2, 3"}


def _daily(t):
    return (
        t.lines()
        .groupBy((F.col("l_linenumber") % 3).alias("seed"), F.col("l_returnflag").alias("mode"), "trade_date")
        .agg(F.avg(F.col("l_discount") - F.col("l_tax")).alias("value"))
    )


@query(
    "a23_seed_statistics",
    f"SELECT mode, count(*) AS seeds, {R('avg(v)', 'mean')}, {R('stddev_samp(v)', 'std')}, {R('min(v)', 'min')}, {R('max(v)', 'max')} FROM (SELECT seed, mode, avg(value) AS v FROM daily GROUP BY 1, 2) GROUP BY 1",
    **_SEEDS,
)
def _(t):
    return rounded(L.aggregate_seeds(_daily(t)))


@query(
    "a23_paired_modes",
    f"""SELECT seed, {R("avg(value) FILTER (mode = 'A') - avg(value) FILTER (mode = 'R')", "difference")} FROM daily GROUP BY 1""",
    **_SEEDS,
)
def _(t):
    return rounded(L.paired_modes(_daily(t), "A", "R"))


@query(
    "a25_class_balance",
    f"SELECT c AS class, count(*) AS rows, {R('(SELECT count(*) FROM cl WHERE c IS NOT NULL) / ((SELECT count(DISTINCT c) FROM cl) * count(*))', 'weight')} FROM cl WHERE c IS NOT NULL GROUP BY 1",
    cl=f"SELECT {_CLS.format('ret')} AS c FROM rets",
)
def _(t):
    return rounded(L.class_balance(t.bars.select(return_class(change("close")).alias("c")), "c"))


_IMP = {"imp": """SELECT l_returnflag AS task, CASE WHEN l_linenumber <= 5 THEN 'f' || l_linenumber ELSE 'noise_' || l_linenumber END AS feature, l_linenumber > 5 AS is_noise, CAST(count(*) AS DOUBLE) AS importance FROM ticks GROUP BY 1, 2, 3"""}


def _importances(t):
    n = F.col("l_linenumber")
    name = F.when(n <= 5, F.concat(F.lit("f"), n)).otherwise(F.concat(F.lit("noise_"), n))
    return (
        t.lines()
        .groupBy(F.col("l_returnflag").alias("task"), name.alias("feature"), (n > 5).alias("is_noise"))
        .agg(F.count(F.lit(1)).cast("double").alias("importance"))
    )


@query(
    "m10_noise_probe_rule",
    "SELECT feature, max(CASE WHEN importance > threshold THEN 1 ELSE 0 END) AS keep, max(importance) AS best FROM imp JOIN (SELECT task, max(importance) AS threshold FROM imp WHERE is_noise GROUP BY 1) USING (task) WHERE NOT is_noise GROUP BY 1",
    **_IMP,
)
def _(t):
    return L.beats_noise(_importances(t))


@query(
    "m10_split_counts",
    """SELECT f.name AS feature, CAST(coalesce(n, 0) AS DOUBLE) AS importance FROM (VALUES ('a', 0), ('b', 1), ('c', 2), ('d', 3), ('unused', 4)) f(name, i)
    LEFT JOIN (SELECT l_partkey % 4 AS i, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1) USING (i)""",
)
def _(t):
    """The lines as the nodes of a forest: an order is a tree, its first three lines are inner nodes."""
    split = F.struct((F.col("l_partkey") % 4).cast("int").alias("featureIndex"))
    node = F.struct(F.when(F.col("l_linenumber") <= 3, 2 * F.col("l_linenumber")).otherwise(-1).cast("int").alias("leftChild"), split.alias("split"))
    return D.split_counts(t.raw("lineitem").select(F.col("l_orderkey").alias("treeID"), node.alias("nodeData")), ["a", "b", "c", "d", "unused"])


@query(
    "a27_importance_list",
    "SELECT feature, coalesce(importance, 0) AS importance FROM (SELECT DISTINCT feature FROM imp) LEFT JOIN (SELECT feature, importance FROM imp WHERE task = 'A' AND NOT is_noise) USING (feature)",
    **_IMP,
)
def _(t):
    imp = _importances(t)
    return L.importance_list(imp.select("feature").distinct(), imp.where("task = 'A' AND NOT is_noise").select("feature", "importance"))


@query("m11_probability_signal", "SELECT ts_code, trade_date, CASE WHEN p > 0.55 THEN 1 WHEN p < 1 - 0.55::DOUBLE THEN -1 ELSE 0 END AS signal FROM prob WHERE ok", **_PROB)
def _(t):
    return _prob(t).select(*K, L.probability_signal(F.col("probability")).alias("signal"))


_TRIALS = {
    "sam": _SAM,
    "tr0": "SELECT trade_date, ts_code, label, unnest(['control', 'reversal', 'volume', 'bias']) AS name, unnest([ret, -ret, vol, bias5]) AS score FROM sam WHERE ret IS NOT NULL AND bias5 IS NOT NULL AND label IS NOT NULL",
    "tr1": """SELECT *, rank() OVER (PARTITION BY name, trade_date ORDER BY score) + (count(*) OVER (PARTITION BY name, trade_date, score) - 1) / 2 AS rs,
      rank() OVER (PARTITION BY name, trade_date ORDER BY label) + (count(*) OVER (PARTITION BY name, trade_date, label) - 1) / 2 AS rl FROM tr0""",
    "tr2": "SELECT name, trade_date, CASE WHEN min(rs) < max(rs) AND min(rl) < max(rl) THEN round(corr(rs, rl), 12) END AS ic FROM tr1 GROUP BY 1, 2",
    "tr3": "SELECT name, avg(ic) AS m, count(ic) AS defined_dates, count(*) AS total_dates FROM tr2 GROUP BY 1",
}


@query(
    "m13_trial_selection",
    f"SELECT name, {R('m', 'mean_daily_rank_ic')}, defined_dates, total_dates, name <> 'control' AND m > 0 AND m > (SELECT m FROM tr3 WHERE name = 'control') AND defined_dates = total_dates AS qualified FROM tr3 WHERE m IS NOT NULL ORDER BY m DESC, name LIMIT 1",
    **_TRIALS,
)
def _(t):
    df = _samples(t).where("ret IS NOT NULL AND bias5 IS NOT NULL AND label IS NOT NULL")
    df = df.select(*K, "label", F.col("ret").alias("control"), (-F.col("ret")).alias("reversal"), F.col("vol").alias("volume"), F.col("bias5").alias("bias"))
    trials = L.trial_metrics(df, ["control", "reversal", "volume", "bias"])
    return rounded(L.select_trial(cut_lineage(trials, "trials"), "control"))


# -- models -------------------------------------------------------------------------
def _kept_samples(t):
    """The samples' key, features and label, written once: a fit reads them many times."""
    return cut_lineage(_samples(t).select(*K, *FEATURES, "label", "label_target_date"), "samples")


@query("m8_walk_forward_models")
def _(t):
    samples = _kept_samples(t)
    return rounded(D.walk_forward(samples, FEATURES, D.session_folds(samples)))


@query("m9_ranking_regression")
def _(t):
    return rounded(D.ranking_regression(L.purged_split(_kept_samples(t)), FEATURES))


@query("m10_noise_probe_fit")
def _(t):
    return rounded(D.probe_selection(_kept_samples(t), FEATURES))


@query("m12_frozen_model_scores")
def _(t):
    df = _kept_samples(t).na.drop(subset=FEATURES)
    train = df.where("label IS NOT NULL AND label_target_date < DATE '2000-07-01'")
    return rounded(D.score_frozen(train, df, FEATURES))
