"""Market context, labels, selection and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspan.functions.frames import change, rolling
from barspan.operators import market as M
from barspan.operators import technical as W
from barspan.operators.quality import session_ordinals
from barspan.operators.tables import daily_panel
from barspan.plans.oracle import R
from barspan.plans.registry import query, rounded
from barspan.plans.technical import K, OVER, win

ANNUAL = 252**0.5


def _returns(t):
    return t.bars.withColumn("ret", change("close"))


def _scores(t):
    """Scores of an observed session: its own return, where one exists."""
    return _returns(t).where("ret IS NOT NULL").select(*K, F.col("ret").alias("score"), "close", "vol")


_CTX = f"SELECT r.*, {win('stddev_samp(ret)', 20, 'ret')} * sqrt(252) AS v FROM rets r"


@query(
    "w32_market_context",
    f"""SELECT ts_code, trade_date, {R('mr', 'market_return')}, {R('mv', 'market_volatility_20d')}, {R('ret - mr', 'return_vs_market')},
    {R('ir', 'industry_return')}, {R('ret - ir', 'return_vs_industry')}, {R('v / nullif(mv, 0)', 'volatility_vs_market')},
    {R('(ret - ir) / nullif(sr, 0)', 'return_zscore_industry', 5)}, {R('(v - iv) / nullif(sv, 0)', 'volatility_zscore_industry', 5)} FROM
    (SELECT x.*, avg(ret) OVER d AS mr, avg(v) OVER d AS mv, CASE WHEN industry IS NOT NULL THEN avg(ret) OVER i END AS ir, CASE WHEN industry IS NOT NULL THEN stddev_samp(ret) OVER i END AS sr,
     CASE WHEN industry IS NOT NULL THEN avg(v) OVER i END AS iv, CASE WHEN industry IS NOT NULL THEN stddev_samp(v) OVER i END AS sv
     FROM ctx x JOIN (SELECT ts_code, industry FROM master) USING (ts_code)
     WINDOW d AS (PARTITION BY trade_date), i AS (PARTITION BY trade_date, industry))""",
    ctx=_CTX,
)
def _(t):
    df = t.bars.withColumn("return_1d", change("close"))
    df = df.withColumn("volatility_20d", rolling(F.stddev_samp, "return_1d", 20) * ANNUAL)
    out = M.market_context(df.join(t.master.select("ts_code", "industry"), "ts_code"))
    names = ["market_return", "market_volatility_20d", "return_vs_market", "industry_return", "return_vs_industry",
             "volatility_vs_market", "return_zscore_industry", "volatility_zscore_industry"]
    return rounded(out.select(*K, *names), 6, return_zscore_industry=5, volatility_zscore_industry=5)


@query(
    "w33_forward_label",
    f"SELECT ts_code, trade_date, {R(f'lead(close, 5) {OVER} / close - 1', 'label')}, lead(trade_date, 5) {OVER} AS label_target_date FROM bars",
)
def _(t):
    return rounded(M.forward_label(t.bars).select(*K, "label", "label_target_date"))


_L5 = f"SELECT ts_code, trade_date, lead(close, 5) {OVER} / close - 1 AS label FROM bars"


@query(
    "w34_probe_labels",
    f"""SELECT ts_code, trade_date, CASE WHEN label > median(label) OVER (PARTITION BY trade_date) THEN 1 ELSE 0 END AS label_cls,
    {R('CAST(label AS FLOAT)', 'label_reg', 3)}, CASE WHEN label > 0 THEN 1 ELSE 0 END AS label_dir FROM l5""",
    l5=_L5,
)
def _(t):
    out = M.probe_labels(M.forward_label(t.bars))
    return out.select(*K, "label_cls", (F.round(F.col("label_reg").cast("double"), 3) + F.lit(0.0)).alias("label_reg"), "label_dir")


@query(
    "w35_centred_rank_label",
    f"""SELECT ts_code, trade_date, {R('(rank() OVER (PARTITION BY trade_date ORDER BY label) + (count(*) OVER (PARTITION BY trade_date, label) - 1) / 2 - 0.5) / count(*) OVER (PARTITION BY trade_date) - 0.5', 'rank_label')}
    FROM l5 WHERE label IS NOT NULL""",
    l5=_L5,
)
def _(t):
    return rounded(M.centred_rank_label(M.forward_label(t.bars)).select(*K, "rank_label"))


_SCORES = {"scores": "SELECT ts_code, trade_date, ret AS score, close, vol FROM rets WHERE ret IS NOT NULL"}
_TOPS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, ts_code) AS position FROM scores)"


@query("w36_top_ten", f"SELECT ts_code, trade_date, {R('score', 'score')}, position FROM ({_TOPS}) WHERE position <= 10", **_SCORES)
def _(t):
    return rounded(M.top_n(_scores(t), 10).select(*K, "score", "position"))


@query("w36_full_ranking", f"SELECT ts_code, trade_date, {R('score', 'score')}, position FROM ({_TOPS})", **_SCORES)
def _(t):
    return rounded(M.full_ranking(_scores(t)).select(*K, "score", "position"))


@query(
    "w37_positive_weights",
    f"SELECT ts_code, trade_date, position, {R('score / sum(score) OVER (PARTITION BY trade_date)', 'weight')} FROM ({_TOPS}) WHERE position <= 10 AND score > 0",
    **_SCORES,
)
def _(t):
    return rounded(M.positive_weights(_scores(t), 10).select(*K, "position", "weight"))


@query(
    "w38_softmax_weights",
    f"SELECT ts_code, trade_date, position, {R('exp(score / 0.5) / (sum(exp(score / 0.5)) OVER (PARTITION BY trade_date) + 1e-12)', 'weight')} FROM ({_TOPS}) WHERE position <= 5",
    scores="SELECT ts_code, trade_date, (close - low) / (high - low + 1e-12) AS score FROM bars",
)
def _(t):
    s = t.bars.withColumn("score", (F.col("close") - F.col("low")) / (F.col("high") - F.col("low") + 1e-12))
    return rounded(M.softmax_weights(M.top_n(s, 5)).select(*K, "position", "weight"))


_HEADS = """SELECT ts_code, trade_date, ret AS ranking, close AS regression, vol AS classification, high - low AS direction FROM rets WHERE ret IS NOT NULL"""


def _unit(c):
    return f"CASE WHEN max({c}) OVER d - min({c}) OVER d < 1e-9 THEN 0 ELSE ({c} - min({c}) OVER d) / (max({c}) OVER d - min({c}) OVER d) END"


for _policy, _base in (("legacy_variance", "ranking"), ("nonnegative_variance", "ur")):

    @query(
        f"w39_score_adjustment_{_policy}",
        f"""SELECT ts_code, trade_date, {R('var', 'uncertainty')}, {R(f'{_base} * (1 - var)', 'score')} FROM
        (SELECT *, (pow(a - (a + b + c) / 3, 2) + pow(b - (a + b + c) / 3, 2) + pow(c - (a + b + c) / 3, 2)) / 3 AS var FROM
        (SELECT *, {_unit('regression')} AS a, {_unit('classification')} AS b, {_unit('direction')} AS c, {_unit('ranking')} AS ur FROM heads WINDOW d AS (PARTITION BY trade_date)))""",
        heads=_HEADS,
    )
    def _(t, policy=_policy):
        h = _returns(t).where("ret IS NOT NULL").select(
            *K, F.col("ret").alias("ranking"), F.col("close").alias("regression"), F.col("vol").alias("classification"),
            (F.col("high") - F.col("low")).alias("direction"),
        )
        return rounded(M.adjust_scores(h, policy).select(*K, "uncertainty", "score"))


_CURVE = f"""SELECT ts_code, trade_date, close / max(close) OVER w - 1 AS dd, arg_max(trade_date, close) OVER w AS peak_date, close / first_value(close) OVER w - 1 AS cum
    FROM bars WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date)"""


@query("w40_drawdown_curve", f"SELECT ts_code, trade_date, {R('dd', 'drawdown')}, peak_date, {R('cum', 'cumulative_return')} FROM curve", curve=_CURVE)
def _(t):
    return rounded(M.drawdown_curve(t.bars).select(*K, "drawdown", "peak_date", "cumulative_return"))


@query(
    "w40_worst_drawdown",
    f"SELECT ts_code, {R('dd', 'max_drawdown')}, peak_date, trade_date AS trough_date FROM (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY dd, trade_date) AS k FROM curve) WHERE k = 1",
    curve=_CURVE,
)
def _(t):
    return rounded(M.worst_drawdown(M.drawdown_curve(t.bars)))


@query(
    "w41_session_runs",
    """SELECT ts_code, min(trade_date) AS start_date, max(trade_date) AS end_date, count(*) AS sessions FROM
    (SELECT ts_code, trade_date, ordinal - row_number() OVER (PARTITION BY ts_code ORDER BY ordinal) AS g FROM bars JOIN sessions USING (trade_date)) GROUP BY ts_code, g""",
)
def _(t):
    return M.session_runs(t.bars.select(*K), session_ordinals(t.calendar))


@query(
    "w42_recent_trend",
    f"""SELECT ts_code, rows, {R('p', 'slope_pct', 4)}, {R('r2', 'r_squared', 4)}, CASE WHEN p > 0.05 THEN 'up' WHEN p < -0.05 THEN 'down' ELSE 'flat' END AS direction FROM
    (SELECT ts_code, count(*) AS rows, regr_slope(close, rn) / avg(close) * 100 AS p, regr_r2(close, rn) AS r2 FROM
    (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) AS back FROM rets) WHERE back <= 60 GROUP BY 1)""",
)
def _(t):
    return rounded(M.recent_trend(t.bars), 4)


# -- statistics ---------------------------------------------------------------------
@query(
    "a6_descriptive_statistics",
    f"""SELECT ts_code, count(ret) AS count, {R('avg(ret)', 'mean')}, {R('stddev_samp(ret)', 'std')}, {R('min(ret)', 'min')}, {R('quantile_cont(ret, 0.25)', 'q25')},
    {R('quantile_cont(ret, 0.5)', 'q50')}, {R('quantile_cont(ret, 0.75)', 'q75')}, {R('max(ret)', 'max')}, {R('skewness(ret)', 'skewness', 4)}, {R('kurtosis(ret)', 'kurtosis', 4)} FROM rets GROUP BY 1""",
)
def _(t):
    return rounded(M.describe(_returns(t), "ret"), 6, skewness=4, kurtosis=4)


@query(
    "a7_trend",
    f"SELECT ts_code, count(*) AS n, {R('regr_slope(close, rn)', 'slope', 5)}, {R('regr_r2(close, rn)', 'r_squared')}, CASE WHEN regr_slope(close, rn) > 0 THEN 'up' ELSE 'down' END AS direction FROM rets GROUP BY 1",
)
def _(t):
    return rounded(M.trend(t.bars).select("ts_code", "n", "slope", "r_squared", "direction"), 6, slope=5)


@query("a7_trend_significance")
def _(t):
    return rounded(M.trend(t.bars).select("ts_code", "n", "p_value", "significant"))


_SMALL = {"small": f"SELECT ts_code, trade_date, ret * 0.01 AS r FROM rets WHERE ret IS NOT NULL",
          "wealth": "SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY ts_code ORDER BY trade_date)) AS w FROM small",
          "falls": "SELECT *, w / max(w) OVER (PARTITION BY ts_code ORDER BY trade_date) - 1 AS dd, w / greatest(1, max(w) OVER (PARTITION BY ts_code ORDER BY trade_date)) - 1 AS dd1 FROM wealth"}


def _small(t):
    """Returns of an account with one percent invested: keeps annualised figures readable."""
    return _returns(t).where("ret IS NOT NULL").select(*K, (F.col("ret") * 0.01).alias("r"))


@query(
    "a8_risk_metrics",
    f"""SELECT ts_code, {R('pow(1 + avg(r), 252) - 1', 'annual_return', 4)}, {R('stddev_samp(r) * sqrt(252)', 'annual_volatility')},
    {R('(pow(1 + avg(r), 252) - 1 - 0.03) / (stddev_samp(r) * sqrt(252))', 'sharpe_ratio', 4)}, {R('min(dd)', 'max_drawdown')} FROM falls GROUP BY 1""",
    **_SMALL,
)
def _(t):
    return rounded(M.risk_metrics(_small(t), "r"), 4, annual_volatility=6, max_drawdown=6)


@query(
    "a9_return_metrics",
    f"""SELECT ts_code, {R('exp(sum(ln(1 + r)) * 252 / count(*)) - 1', 'annual_return', 4)}, {R('stddev_samp(r) * sqrt(252)', 'annual_volatility')},
    {R('(exp(sum(ln(1 + r)) * 252 / count(*)) - 1.03) / (stddev_samp(r) * sqrt(252))', 'sharpe_ratio', 4)}, {R('least(min(dd1), 0)', 'max_drawdown')},
    {R('avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END)', 'win_rate')}, {R('avg(r) FILTER (r > 0) / avg(-r) FILTER (r < 0)', 'profit_loss_ratio')} FROM falls GROUP BY 1""",
    **_SMALL,
)
def _(t):
    return rounded(M.return_metrics(_small(t), "r"), 6, annual_return=4, sharpe_ratio=4)


@query(
    "a10_monthly_pivot",
    "SELECT ts_code, year(trade_date) AS year, "
    + ", ".join(R(f"coalesce(sum(r) FILTER (month(trade_date) = {m}), 0)", f"m{m:02d}") for m in range(1, 13))
    + " FROM small GROUP BY 1, 2",
    **_SMALL,
)
def _(t):
    return rounded(M.monthly_pivot(_small(t), "r"))


_FEATS = ["return_1d", "bias20", "volume_ratio", "volatility_20d", "turnover_rate_5", "log_return"]


@query(
    "a11_correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {R('1.0' if a == b else f'(SELECT corr({a}, {b}) FROM feats)', 'correlation')}"
        for a in _FEATS
        for b in _FEATS
    ),
    feats=f"""SELECT ret AS return_1d, ln(close / pre_close) AS log_return, (close - {win('avg(close)', 20, 'close')}) / {win('avg(close)', 20, 'close')} * 100 AS bias20,
    vol / {win('avg(vol)', 5, 'vol')} AS volume_ratio, {win('stddev_samp(ret)', 20, 'ret')} * sqrt(252) AS volatility_20d,
    {win('avg(turnover_rate)', 5, 'turnover_rate')} AS turnover_rate_5 FROM rets LEFT JOIN (SELECT ts_code, trade_date, turnover_rate FROM valuation) USING (ts_code, trade_date)""",
)
def _(t):
    p = daily_panel(t.bars, t.valuation).withColumns(W._steps())
    p = p.withColumns({**W.returns(), **W.moving_averages((20,)), **W.volume(), **W.risk(windows=(20,)), **W.turnover()}).withColumns(W.bias((20,)))
    return rounded(M.correlation_matrix(p, _FEATS))


def _hist(bins):
    return f"""SELECT g.ts_code, g.bin, {R('lo + g.bin * width', 'lower')}, coalesce(c, 0) AS count, {R('mu', 'mu')}, {R('sigma', 'sigma')} FROM
    (SELECT span.*, unnest(range({bins})) AS bin FROM span) g LEFT JOIN
    (SELECT ts_code, coalesce(least(floor((ret - lo) / nullif(width, 0)), {bins - 1}), 0) AS bin, count(*) AS c FROM rets JOIN span USING (ts_code) WHERE ret IS NOT NULL GROUP BY 1, 2) h
    ON g.ts_code = h.ts_code AND g.bin = h.bin"""


for _bins in (24, 50):

    @query(
        f"a12_histogram_{_bins}_bins",
        _hist(_bins),
        span=f"SELECT ts_code, min(ret) AS lo, (max(ret) - min(ret)) / {_bins} AS width, avg(ret) AS mu, stddev_pop(ret) AS sigma FROM rets WHERE ret IS NOT NULL GROUP BY 1",
    )
    def _(t, bins=_bins):
        return rounded(M.histogram(_returns(t), "ret", bins))


for _period in ("week", "month", "year"):

    @query(
        f"a13_resample_{_period}",
        f"""SELECT ts_code, period_start, trade_date, open, high, low, close, vol, {R('amount', 'amount', 2)}, coalesce(lag(close) OVER w, open) AS pre_close,
        {R('(close / coalesce(lag(close) OVER w, open) - 1) * 100', 'pct_chg', 2)} FROM
        (SELECT ts_code, CAST(date_trunc('{_period}', trade_date) AS DATE) AS period_start, max(trade_date) AS trade_date, arg_min(open, trade_date) AS open,
        max(high) AS high, min(low) AS low, arg_max(close, trade_date) AS close, sum(vol) AS vol, sum(amount) AS amount FROM bars GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY ts_code ORDER BY period_start)""",
    )
    def _(t, period=_period):
        df = M.resample(t.bars, period)
        return df.withColumns({"amount": F.round("amount", 2), "pct_chg": F.col("pct_chg") + F.lit(0.0)})
