"""Sequence-model features, windows and eligibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspan.operators import sequence as S
from barspan.operators.tables import daily_panel
from barspan.plans.oracle import R
from barspan.plans.registry import query, rounded
from barspan.plans.technical import K, OVER, _MACD_REC, _SEQ, _SEQ2, _WILDER, _ema_sql, lag, win

E = "1e-12::DOUBLE"


def zf(expr, alias, dp=6):
    return R(f"coalesce(CASE WHEN isfinite({expr}) THEN {expr} END, 0)", alias, dp)


_39 = ["sma_5", "sma_20", "volume_change", "obv", "volume_ma_5", "volume_ma_20", "volume_ratio", "kdj_k", "kdj_d", "kdj_j",
       "boll_std", "volatility_10", "volatility_20", "return_1", "return_5", "return_10",
       "high_low_spread", "open_close_spread", "high_close_spread", "low_close_spread"]


@query(
    "w21_sequence_39_frames",
    "SELECT ts_code, trade_date, "
    + ", ".join(
        zf(e, n, 4 if n in ("boll_std",) else 6)
        for n, e in {
            "sma_5": win("avg(close)", 5, "close"), "sma_20": win("avg(close)", 20, "close"), "volume_change": f"(vol / {lag('vol')} - 1)",
            "obv": "obv", "volume_ma_5": win("avg(vol)", 5, "vol"), "volume_ma_20": win("avg(vol)", 20, "vol"),
            "volume_ratio": f"({win('avg(vol)', 5, 'vol')} / {win('avg(vol)', 20, 'vol')})", "kdj_k": "(CASE WHEN sd IS NOT NULL THEN sk END)", "kdj_d": "sd",
            "kdj_j": "(3 * sk - 2 * sd)", "boll_std": win("stddev_pop(close)", 20, "close"),
            "volatility_10": win("stddev_samp(ret)", 10, "ret"), "volatility_20": win("stddev_samp(ret)", 20, "ret"),
            "return_1": "ret", "return_5": f"(close / {lag('close', 5)} - 1)", "return_10": f"(close / {lag('close', 10)} - 1)",
            "high_low_spread": "(high - low)", "open_close_spread": "(open - close)", "high_close_spread": "(high - close)", "low_close_spread": "(low - close)",
        }.items()
    )
    + f""" FROM (SELECT *, {win('avg(sk)', 3, 'sk')} AS sd FROM (SELECT *, {win('avg(fk)', 3, 'fk')} AS sk,
      sum(CASE WHEN pre_close IS NULL THEN vol ELSE sign(close - pre_close) * vol END) {OVER} AS obv FROM
      (SELECT *, CASE WHEN hh = ll THEN 0 ELSE (close - ll) / (hh - ll) * 100 END AS fk FROM
      (SELECT *, {win('max(high)', 9, 'high')} AS hh, {win('min(low)', 9, 'low')} AS ll FROM rets))))""",
)
def _(t):
    return rounded(S.features_39(t.bars).select(*K, *_39), 6, boll_std=4)


_ATR = {
    "seq0": _SEQ,
    "seq1": _SEQ2,
    "trs": "SELECT *, CASE WHEN pre_close IS NULL THEN NULL ELSE greatest(high - low, abs(high - pre_close), abs(low - pre_close)) END AS tr FROM seq1",
    "trm": f"SELECT *, {win('avg(tr)', 14, 'tr')} AS mtr FROM trs",
}


@query(
    "w21_sequence_39_recurrences",
    f"""SELECT rec.ts_code, rec.trade_date, {zf('e12', 'ema_12', 5)}, {zf('e26', 'ema_26', 5)}, {zf('e60', 'ema_60', 5)},
    {zf('(CASE WHEN dea IS NOT NULL THEN dif END)', 'macd', 4)}, {zf('dea', 'macd_signal', 4)}, {zf('a', 'atr_14', 4)},
    {zf('(CASE WHEN u + d = 0 THEN 0 ELSE 100 * u / (u + d) END)', 'rsi')}
    FROM rec JOIN sig USING (ts_code, trade_date) JOIN wil USING (ts_code, trade_date)""",
    **_ATR,
    difs=_MACD_REC["difs"].replace("FROM rec", "FROM mac"),
    sig=_MACD_REC["sig"],
    mac=_MACD_REC["rec"].replace("FROM rec r", "FROM mac r"),
    wil=_WILDER["rec"].replace("FROM rec r", "FROM wil r"),
    rec="SELECT ts_code, trade_date, rn, " + ", ".join(f"CAST(NULL AS DOUBLE) AS e{n}" for n in (12, 26, 60))
    + ", CAST(NULL AS DOUBLE) AS a FROM trm WHERE rn = 1 UNION ALL SELECT b.ts_code, b.trade_date, b.rn, "
    + ", ".join(_ema_sql(n) for n in (12, 26, 60))
    + ", CASE WHEN b.rn = 15 THEN b.mtr WHEN b.rn > 15 THEN (r.a * 13 + b.tr) / 14 END AS a"
    + " FROM rec r JOIN trm b ON b.ts_code = r.ts_code AND b.rn = r.rn + 1",
)
def _(t):
    df = S.features_39(t.bars).select(*K, *S._GROUP_39)
    return rounded(df, 4, rsi=6, ema_12=5, ema_26=5, ema_60=5)


_PW = f"(PARTITION BY ts_code ORDER BY trade_date)"


@query(
    "w21_decayed_deviation",
    f"""SELECT ts_code, trade_date, {R(f'CASE WHEN count(ret) OVER {_PW} >= 252 THEN sqrt(greatest((s2 / s0 - (s1 / s0) * (s1 / s0)) * (s0 * s0) / (s0 * s0 - ww), 0)) ELSE 0 END', 'daily_standard_deviation')}
    FROM (SELECT *, sum(w) OVER {_PW} AS s0, sum(w * ret) OVER {_PW} AS s1, sum(w * ret * ret) OVER {_PW} AS s2, sum(w * w) OVER {_PW} AS ww
    FROM (SELECT *, CASE WHEN ret IS NOT NULL THEN pow(2.0, rn / 42.0) END AS w FROM rets))""",
)
def _(t):
    from barspan.functions.frames import change

    df = S._with_decayed_deviation(t.bars.withColumn("r", change("close")), "r", "daily_standard_deviation")
    return rounded(S.zero_filled(df, ["daily_standard_deviation"]).select(*K, "daily_standard_deviation"))


@query(
    "w22_candle_shapes",
    f"""SELECT ts_code, trade_date, {R(f'(close - open) / (open + {E})', 'KMID')}, {R(f'(high - low) / (open + {E})', 'KLEN')},
    {R(f'(close - open) / (high - low + {E})', 'KMID2')}, {R(f'(high - greatest(open, close)) / (open + {E})', 'KUP')},
    {R(f'(high - greatest(open, close)) / (high - low + {E})', 'KUP2')}, {R(f'(least(open, close) - low) / (open + {E})', 'KLOW')},
    {R(f'(least(open, close) - low) / (high - low + {E})', 'KLOW2')}, {R(f'(2 * close - high - low) / (open + {E})', 'KSFT')},
    {R(f'(2 * close - high - low) / (high - low + {E})', 'KSFT2')}, {R(f'open / (close + {E})', 'OPEN0')}, {R(f'high / (close + {E})', 'HIGH0')},
    {R(f'low / (close + {E})', 'LOW0')}, {R(f'amount / (vol + {E}) / (close + {E})', 'VWAP0')} FROM bars""",
)
def _(t):
    return rounded(t.bars.select(*K, *[c.alias(n) for n, c in S.candle_shapes().items()]))


_W = S.WINDOWS
_BASE = f"""SELECT *, CAST(rn AS DOUBLE) AS n, ln(vol + 1) AS logv, coalesce(close / pre_close, 0) AS cr,
    coalesce(ln(vol / ({lag('vol')} + {E}) + 1), 0) AS vr, CASE WHEN close > pre_close THEN 1.0 ELSE 0.0 END AS up,
    CASE WHEN close < pre_close THEN 1.0 ELSE 0.0 END AS dn, greatest(close - pre_close, CASE WHEN rn = 1 THEN NULL ELSE 0 END) + (close - pre_close) * 0 AS gain,
    greatest(pre_close - close, 0) + (close - pre_close) * 0 AS loss, greatest(vol - {lag('vol')}, 0) + {lag('vol')} * 0 AS vgain,
    greatest({lag('vol')} - vol, 0) + {lag('vol')} * 0 AS vloss, abs(ret) * vol AS wret FROM rets"""


def _family(family, names, dp=6):
    def run(t):
        df = S.features_158(t.bars, (family,))
        return rounded(df.select(*K, *[f"{n}{w}" for n in names for w in _W]), dp)

    return run


query(
    "w23_trend_family",
    "SELECT ts_code, trade_date, "
    + ", ".join(
        f"{zf(f'({lag('close', w)} / (close + {E}))', f'ROC{w}')}, {zf(f'({win('avg(close)', w, 'close')} / (close + {E}))', f'MA{w}')},"
        f"{zf(f'({win('stddev_pop(close)', w, 'close')} / (close + {E}))', f'STD{w}')},"
        f"{zf(f'({win('regr_slope(close, n)', w, 'close')} / (close + {E}))', f'BETA{w}')},"
        f"{zf(f'(CASE WHEN {win('max(close)', w, 'close')} > {win('min(close)', w, 'close')} THEN pow({win('corr(close, n)', w, 'close')}, 2) END)', f'RSQR{w}')},"
        f"{zf(f'((close - ({win('regr_slope(close, n)', w, 'close')} * n + {win('regr_intercept(close, n)', w, 'close')})) / (close + {E}))', f'RESI{w}', 5)}"
        for w in _W
    )
    + " FROM base",
    base=_BASE,
)(lambda t: rounded(S.features_158(t.bars, (S.trend_family,)).select(*K, *[f"{n}{w}" for n in ("ROC", "MA", "STD", "BETA", "RSQR", "RESI") for w in _W]), 6, **{f"RESI{w}": 5 for w in _W}))


query(
    "w23_range_family",
    "SELECT ts_code, trade_date, "
    + ", ".join(
        f"{zf(f'(mx{w} / (close + {E}))', f'MAX{w}')}, {zf(f'(mn{w} / (close + {E}))', f'MIN{w}')},"
        f"{zf(f'((close - mn{w}) / (mx{w} - mn{w} + {E}))', f'RSV{w}')},"
        f"{zf(f'((list_position(hs{w}, mx{w}) - 1) / {w})', f'IMAX{w}')}, {zf(f'((list_position(ls{w}, mn{w}) - 1) / {w})', f'IMIN{w}')},"
        f"{zf(f'((list_position(hs{w}, mx{w}) - list_position(ls{w}, mn{w})) / {w})', f'IMXD{w}')}"
        for w in _W
    )
    + " FROM (SELECT *, "
    + ", ".join(
        f"{win('max(high)', w, 'high')} AS mx{w}, {win('min(low)', w, 'low')} AS mn{w}, {win('list(high)', w, 'high')} AS hs{w}, {win('list(low)', w, 'low')} AS ls{w}"
        for w in _W
    )
    + " FROM bars)",
)(_family(S.range_family, ("MAX", "MIN", "RSV", "IMAX", "IMIN", "IMXD")))


query(
    "w23_order_family",
    "SELECT ts_code, trade_date, "
    + ", ".join(
        f"{zf(f'({win('quantile_cont(close, 0.8)', w, 'close')} / (close + {E}))', f'QTLU{w}')},"
        f"{zf(f'({win('quantile_cont(close, 0.2)', w, 'close')} / (close + {E}))', f'QTLD{w}')},"
        f"{zf(f'((len(list_filter(cs{w}, lambda x: x < close)) + (len(list_filter(cs{w}, lambda x: x = close)) + 1) / 2) / {w})', f'RANK{w}')}"
        for w in _W
    )
    + " FROM (SELECT *, " + ", ".join(f"{win('list(close)', w, 'close')} AS cs{w}" for w in _W) + " FROM bars)",
)(_family(S.order_family, ("QTLU", "QTLD", "RANK")))


def _share(g, l, w, op):
    a, b = win(f"sum({g})", w, g), win(f"sum({l})", w, l)
    return f"(({op.format(a=a, b=b)}) / ({a} + {b} + {E}))"


query(
    "w23_flow_family",
    "SELECT ts_code, trade_date, "
    + ", ".join(
        f"{zf(win('corr(close, logv)', w, 'close'), f'CORR{w}', 5)}, {zf(win('corr(cr, vr)', w, 'cr'), f'CORD{w}', 5)},"
        f"{zf(win('avg(up)', w, 'up'), f'CNTP{w}')}, {zf(win('avg(dn)', w, 'dn'), f'CNTN{w}')},"
        f"{zf(f'({win('avg(up)', w, 'up')} - {win('avg(dn)', w, 'dn')})', f'CNTD{w}')},"
        f"{zf(_share('gain', 'loss', w, '{a}'), f'SUMP{w}')}, {zf(_share('gain', 'loss', w, '{b}'), f'SUMN{w}')}, {zf(_share('gain', 'loss', w, '{a} - {b}'), f'SUMD{w}')},"
        f"{zf(_share('vgain', 'vloss', w, '{a}'), f'VSUMP{w}')}, {zf(_share('vgain', 'vloss', w, '{b}'), f'VSUMN{w}')}, {zf(_share('vgain', 'vloss', w, '{a} - {b}'), f'VSUMD{w}')},"
        f"{zf(f'({win('avg(vol)', w, 'vol')} / (vol + {E}))', f'VMA{w}')}, {zf(f'({win('stddev_pop(vol)', w, 'vol')} / (vol + {E}))', f'VSTD{w}')},"
        f"{zf(f'({win('stddev_samp(wret)', w, 'wret')} / ({win('avg(wret)', w, 'wret')} + {E}))', f'WVMA{w}')}"
        for w in _W
    )
    + " FROM base",
    base=_BASE,
)(lambda t: rounded(
    S.features_158(t.bars, (S.flow_family,)).select(*K, *[f"{n}{w}" for n in ("CORR", "CORD", "CNTP", "CNTN", "CNTD", "SUMP", "SUMN", "SUMD", "VSUMP", "VSUMN", "VSUMD", "VMA", "VSTD", "WVMA") for w in _W]),
    6, **{f"{n}{w}": 5 for n in ("CORR", "CORD") for w in _W},
))


# -- cross section ------------------------------------------------------------------
_NORM = f"""SELECT p.*, (close - pc) / (pc + {E}) * 100 AS pct_chg, (high - low) / (pc + {E}) * 100 AS amplitude, close - pc AS change
    FROM (SELECT *, lag(close) {OVER} AS pc FROM panel) p"""


def _rank(c):
    return f"(CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY trade_date ORDER BY {c}) + (count(*) OVER (PARTITION BY trade_date, {c}) - 1) / 2 END)"


@query("w25_normalised_panel", f"SELECT ts_code, trade_date, {R('change', 'change')}, {R('pct_chg', 'pct_chg', 5)}, {R('amplitude', 'amplitude', 5)} FROM norm", norm=_NORM)
def _(t):
    return rounded(S.normalize_panel(t.bars).select(*K, "change", "pct_chg", "amplitude"), 5, change=6)


_LIVE = "CASE WHEN size >= 10 THEN coalesce({}, 0) ELSE 0 END"


@query(
    "w24_cross_section",
    "SELECT * REPLACE (CASE WHEN cs_relative_amplitude >= 100000 THEN round(cs_relative_amplitude, -6) ELSE cs_relative_amplitude END AS cs_relative_amplitude) FROM (SELECT ts_code, trade_date, "
    + ", ".join(
        R(_LIVE.format(e), n)
        for n, e in {
            "cs_return_pct": "r1 / size", "cs_volume_pct": "r2 / size", "cs_turnover_pct": "r3 / size", "cs_amplitude_pct": "r4 / size",
            "cs_excess_return": "pct_chg - m", "cs_price_deviation": f"(close - mc) / (mc + {E})", "cs_price_pct": "r5 / size",
            "cs_relative_amplitude": f"amplitude / (ma + {E})",
        }.items()
    )
    + f""" FROM (SELECT *, count(*) OVER d AS size, avg(pct_chg) OVER d AS m, median(close) OVER d AS mc, median(amplitude) OVER d AS ma,
    {_rank('pct_chg')} AS r1, {_rank('vol')} AS r2, {_rank('turnover_rate')} AS r3, {_rank('amplitude')} AS r4, {_rank('close')} AS r5
    FROM ready WINDOW d AS (PARTITION BY trade_date)))""",
    norm=_NORM,
    ready="SELECT * FROM norm WHERE pct_chg IS NOT NULL",
)
def _(t):
    p = S.normalize_panel(daily_panel(t.bars, t.valuation)).where("pct_chg IS NOT NULL")
    df = rounded(S.cross_section(p).select(*K, *S.CROSS_SECTION))
    x = F.col("cs_relative_amplitude")  # huge where the median amplitude is zero
    return df.withColumn("cs_relative_amplitude", F.when(x >= 100000, F.round(x, -6)).otherwise(x))


# -- labels and windows -------------------------------------------------------------
_LAB = f"""SELECT ts_code, trade_date, open, close, ret, rn, CASE WHEN lead(open) {OVER} > 1e-4 THEN (lead(open, 5) {OVER} - lead(open) {OVER}) / (lead(open) {OVER} + {E}) END AS label,
    lead(trade_date, 5) {OVER} AS label_target_date, trade_date >= (SELECT CAST(max(trade_date) - INTERVAL 2 MONTH AS DATE) FROM bars) AS is_val FROM rets"""


@query("w26_open_to_open_label", f"SELECT ts_code, trade_date, {R('label', 'label')}, label_target_date, is_val FROM lab", lab=_LAB)
def _(t):
    return rounded(S.open_to_open_label(t.bars).select(*K, "label", "label_target_date", "is_val"))


_ELIG = "SELECT ts_code, trade_date, label FROM lab WHERE rn > 20 AND label IS NOT NULL"
_KEPT = "SELECT * FROM elig WHERE trade_date IN (SELECT trade_date FROM elig GROUP BY 1 HAVING count(*) >= 10)"


@query(
    "w27_sequence_windows",
    f"""SELECT k.ts_code, k.trade_date, {R('label', 'label')}, count(*) OVER d AS instruments,
    rank() OVER (PARTITION BY k.trade_date ORDER BY label) + (count(*) OVER (PARTITION BY k.trade_date, label) - 1) / 2 AS relevance,
    CASE WHEN label > median(label) OVER d THEN 1 ELSE 0 END AS above_median, CASE WHEN label > 0 THEN 1 ELSE 0 END AS rises,
    20 AS window_rows, {R('first_ret', 'first_return', 4)}, {R('last_ret', 'last_return', 4)}
    FROM kept k JOIN (SELECT ts_code, trade_date, CAST(lag(ret, 19) {OVER} AS FLOAT) AS first_ret, CAST(ret AS FLOAT) AS last_ret FROM rets) USING (ts_code, trade_date)
    WINDOW d AS (PARTITION BY k.trade_date)""",
    lab=_LAB,
    elig=_ELIG,
    kept=_KEPT,
)
def _(t):
    from barspan.functions.frames import change

    df = S.open_to_open_label(t.bars).withColumn("ret", change("close"))
    out = S.sequence_windows(df, ["ret"], 20)
    return rounded(
        out.select(
            *K, "label", "instruments", "relevance", "above_median", "rises", F.size("window").alias("window_rows"),
            F.col("window")[0][0].cast("double").alias("first_return"), F.col("window")[19][0].cast("double").alias("last_return"),
        ), 4, label=6, relevance=1,
    )


@query(
    "w28_common_session_windows",
    """SELECT trade_date, count(*) FILTER (rn >= 10 AND s - fs = 9 AND g = 10) AS aligned, count(*) FILTER (rn >= 10 AND s - fs = 9 AND g = 10) = (SELECT count(DISTINCT ts_code) FROM nbars) AS complete
    FROM (SELECT *, min(s) OVER w AS fs, count(close) OVER w AS g, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) AS rn
      FROM nbars JOIN (SELECT trade_date, dense_rank() OVER (ORDER BY trade_date) AS s FROM (SELECT DISTINCT trade_date FROM nbars)) USING (trade_date)
      WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date ROWS 9 PRECEDING)) WHERE s >= 10 GROUP BY 1""",
)
def _(t):
    return S.common_session_windows(t.nation_bars, ["close"], 10)


@query(
    "w28a_window_eligibility",
    """SELECT ts_code, coalesce(a, 0) AS train_dates, coalesce(b, 0) AS validation_dates, coalesce(a, 0) > 0 AND coalesce(b, 0) > 0 AS covered
    FROM (SELECT DISTINCT ts_code FROM bars) LEFT JOIN (SELECT ts_code, count(*) FILTER (trade_date < DATE '2000-01-01') AS a,
    count(*) FILTER (trade_date >= DATE '2000-01-01') AS b FROM kept GROUP BY 1) USING (ts_code)""",
    lab=_LAB,
    elig=_ELIG,
    kept=_KEPT,
)
def _(t):
    from barspan.functions.frames import change

    df = S.open_to_open_label(t.bars).withColumn("ret", change("close"))
    return S.window_eligibility(df, ["ret"], 20, "2000-01-01")
