"""Base technical features: closed forms against window SQL, recurrences against recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspan.operators import technical as W
from barspan.operators.tables import daily_panel
from barspan.plans.oracle import R
from barspan.plans.registry import query, rounded

K = ["ts_code", "trade_date"]
OVER = "OVER (PARTITION BY ts_code ORDER BY trade_date)"


def win(agg: str, n: int, col: str) -> str:
    """Rolling aggregate that is null until ``n`` non-null values exist."""
    f = f"(PARTITION BY ts_code ORDER BY trade_date ROWS {n - 1} PRECEDING)"
    return f"(CASE WHEN count({col}) OVER {f} >= {n} THEN {agg} OVER {f} END)"


def lag(col: str, n: int = 1) -> str:
    return f"lag({col}, {n}) {OVER}"


def _with(t, columns):
    return rounded(t.bars.select(*K, *[c.alias(n) for n, c in columns.items()]))


def _grouped(t, names, prices=("close",), dialect="library"):
    return W.grouped_features(t.bars.select(*K, *prices), dialect, names).select(*K, *names)


def _stepped(t, columns, dp=6):
    return rounded(t.bars.withColumns(W._steps()).select(*K, *[c.alias(n) for n, c in columns.items()]), dp)


@query(
    "w1_returns",
    f"""SELECT ts_code, trade_date, {R('ret', 'return_1d')}, {R(f"close / {lag('close', 5)} - 1", 'return_5d')},
    {R(f"close / {lag('close', 10)} - 1", 'return_10d')}, {R('ln(close / pre_close)', 'log_return')} FROM rets""",
)
def _(t):
    return _with(t, W.returns())


def _lead(n):
    return f"(lead(close, {n}) {OVER} / close - 1)"


@query(
    "w2_future_returns",
    "SELECT ts_code, trade_date, "
    + ", ".join(
        f"{R(_lead(n), f'future_return_{n}d')}, CASE WHEN {_lead(n)} > 0 THEN 1.0 WHEN {_lead(n)} <= 0 THEN 0.0 END AS future_direction_{n}d"
        for n in (1, 5)
    )
    + " FROM bars",
)
def _(t):
    return _with(t, W.future_returns())


@query(
    "w3_moving_averages",
    "SELECT ts_code, trade_date, " + ", ".join(R(win("avg(close)", n, "close"), f"ma{n}") for n in (5, 10, 20, 60)) + " FROM bars",
)
def _(t):
    return _with(t, W.moving_averages())


_MID, _DEV = win("avg(close)", 20, "close"), win("stddev_pop(close)", 20, "close")


@query(
    "w7_bollinger",
    f"""SELECT ts_code, trade_date, {R(_MID, 'bb_middle')}, {R(f'{_MID} + 2 * {_DEV}', 'bb_upper', 4)},
    {R(f'{_MID} - 2 * {_DEV}', 'bb_lower', 4)}, {R(f'4 * {_DEV} / nullif({_MID}, 0)', 'bb_width')} FROM bars""",
)
def _(t):
    df = t.bars.withColumns(W._bands()).select(*K, *[c.alias(n) for n, c in W.bollinger().items()])
    return rounded(df, 4, bb_width=6, bb_middle=6)


@query(
    "w9_volume_averages",
    f"""SELECT ts_code, trade_date, {R(win('avg(vol)', 5, 'vol'), 'vol_ma5')}, {R(win('avg(vol)', 10, 'vol'), 'vol_ma10')},
    {R(f"vol / nullif({win('avg(vol)', 5, 'vol')}, 0)", 'volume_ratio')} FROM bars""",
)
def _(t):
    return _with(t, W.volume())


_FLOWS = {
    "tps": f"SELECT *, (high + low + close) / 3 AS tp, lag((high + low + close) / 3) {OVER} AS ptp FROM bars",
    "flows": """SELECT *, CASE WHEN ptp IS NULL THEN NULL WHEN tp > ptp THEN tp * vol ELSE 0.0 END AS up,
        CASE WHEN ptp IS NULL THEN NULL WHEN tp < ptp THEN tp * vol ELSE 0.0 END AS down FROM tps""",
}


@query(
    "w10_money_flow",
    f"""SELECT ts_code, trade_date, {R('CASE WHEN u + d < 1 THEN 0 ELSE 100 * u / (u + d) END', 'mfi14')} FROM
    (SELECT *, {win('sum(up)', 14, 'up')} AS u, {win('sum(down)', 14, 'down')} AS d FROM flows)""",
    **_FLOWS,
)
def _(t):
    return _stepped(t, W.money_flow())


@query(
    "w11_turnover_averages",
    "SELECT ts_code, trade_date, "
    + ", ".join(R(win("avg(turnover_rate)", n, "turnover_rate"), f"turnover_rate_{n}") for n in (5, 60, 120))
    + " FROM panel",
)
def _(t):
    p = daily_panel(t.bars, t.valuation)
    return rounded(p.select(*K, *[c.alias(n) for n, c in W.turnover().items()]))


_MOODS = {
    "moods": f"""SELECT *, high - {lag('low')} AS bu, {lag('close')} - low AS bd, high - open AS au, open - low AS ad,
        greatest(high - ({lag('high')} + {lag('low')}) / 2, CASE WHEN {lag('high')} IS NULL THEN NULL ELSE 0 END) AS cu,
        ({lag('high')} + {lag('low')}) / 2 - low AS cd0 FROM bars""",
    "moods2": "SELECT *, CASE WHEN cd0 IS NULL THEN NULL ELSE greatest(cd0, 0) END AS cd, CASE WHEN cd0 IS NULL THEN NULL ELSE cu END AS cu2 FROM moods",
}


def _mood(up, down, n):
    return f"coalesce({win(f'sum({up})', n, up)} / nullif({win(f'sum({down})', n, down)}, 0) * 100, 0)"


def _R6(expr, alias):
    """Ratios of near-zero sums are huge: six decimals, or none from 100000 on."""
    return f"CASE WHEN abs({expr}) >= 100000 THEN round({expr}, 0) ELSE round({expr}, 6) + CAST(0 AS DOUBLE) END AS {alias}"


def _coarse(df):
    big = {c: F.when(F.abs(c) >= 100000, F.round(c, 0)).otherwise(F.col(c)) for c in ("br", "ar", "cr20") if c in df.columns}
    return df.withColumns(big)


@query(
    "w12_emotion",
    f"SELECT ts_code, trade_date, {_R6(_mood('bu', 'bd', 26), 'br')}, {_R6(_mood('au', 'ad', 26), 'ar')} FROM moods",
    **_MOODS,
)
def _(t):
    return _coarse(_stepped(t, W.emotion(), 6))


@query(
    "w18_cr20",
    f"SELECT ts_code, trade_date, {R(_mood('cu2', 'cd', 20), 'cr20', 4)} FROM moods2",
    **_MOODS,
)
def _(t):
    return _stepped(t, W.cr(), 4)


@query(
    "w13_volatility",
    "SELECT ts_code, trade_date, "
    + ", ".join(R(f"{win('stddev_samp(ret)', n, 'ret')} * sqrt(252)", f"volatility_{n}d") for n in (20, 60, 120))
    + " FROM rets",
)
def _(t):
    return _stepped(t, W.risk())


@query(
    "w14_rolling_moments",
    "SELECT ts_code, trade_date, "
    + ", ".join(
        f"{R(win('skewness(ret)', n, 'ret'), f'skewness_{n}d', 4)}, {R(win('kurtosis(ret)', n, 'ret'), f'kurtosis_{n}d', 4)}"
        for n in (20, 60, 120)
    )
    + " FROM rets",
)
def _(t):
    return rounded(_grouped(t, [c for c in W.GROUPED if c.startswith(("skew", "kurt"))]), 4)


@query(
    "w15_aroon",
    f"""SELECT ts_code, trade_date, {R('(25 - (list_position(list_reverse(hs), list_max(hs)) - 1)) * 4.0', 'arron_up_25')},
    {R('(25 - (list_position(list_reverse(ls), list_min(ls)) - 1)) * 4.0', 'arron_down_25')} FROM
    (SELECT ts_code, trade_date, {win('list(high)', 26, 'high')} AS hs, {win('list(low)', 26, 'low')} AS ls FROM bars)""",
)
def _(t):
    df = t.bars.withColumns(W._aroon_frames())
    return rounded(df.select(*K, *[c.alias(n) for n, c in W.aroon().items()]))


@query(
    "w17_bias_and_cci",
    "SELECT ts_code, trade_date, "
    + ", ".join(R(f"(close - m{n}) / nullif(m{n}, 0) * 100", f"bias{n}") for n in (5, 10, 20, 60))
    + ", "
    + ", ".join(
        R(f"CASE WHEN d{n} = 0 THEN 0 ELSE (tp - t{n}) / (0.015 * d{n}) END", f"cci{n}", 4) for n in (10, 15, 20, 88)
    )
    + " FROM (SELECT *, "
    + ", ".join(f"list_sum(list_transform(l{n}, lambda x: abs(x - t{n}))) / {n} AS d{n}" for n in (10, 15, 20, 88))
    + " FROM (SELECT *, "
    + ", ".join(f"{win('avg(close)', n, 'close')} AS m{n}" for n in (5, 10, 20, 60))
    + ", "
    + ", ".join(f"{win('list(tp)', n, 'tp')} AS l{n}, {win('avg(tp)', n, 'tp')} AS t{n}" for n in (10, 15, 20, 88))
    + " FROM tps))",
    **_FLOWS,
)
def _(t):
    names = [f"cci{n}" for n in W.CCI_WINDOWS]
    df = t.bars.withColumns(W.moving_averages()).withColumns(W.bias()).select(*K, "high", "low", "close", *W.bias())
    return rounded(W.grouped_features(df, names=names).select(*K, *W.bias(), *names), 6, **{c: 4 for c in names})


# -- recurrences --------------------------------------------------------------------
_SPANS = (5, 10, 20, 26, 60, 120, 13)


def _ema_sql(n, x="close"):
    return f"CASE WHEN b.rn = {n} THEN b.m{n} WHEN b.rn > {n} THEN r.e{n} + (b.{x} - r.e{n}) * (2.0::DOUBLE / {n + 1}) END AS e{n}"


_SEQ = (
    "SELECT *, "
    + ", ".join(f"{win('avg(close)', n, 'close')} AS m{n}" for n in (*_SPANS, 12))
    + ", greatest(close - pre_close, 0) AS up, greatest(pre_close - close, 0) AS dn,"
    + f" (close - {win('min(low)', 9, 'low')}) / nullif({win('max(high)', 9, 'high')} - {win('min(low)', 9, 'low')}, 0) * 100 AS rsv"
    + " FROM rets"
)
_SEQ2 = f"SELECT *, {win('avg(up)', 14, 'up')} AS mu, {win('avg(dn)', 14, 'dn')} AS md FROM seq0"


@query(
    "w4_ema",
    "SELECT ts_code, trade_date, " + ", ".join(R(f"e{n}", f"ema{n}", 5) for n in _SPANS[:6]) + " FROM rec",
    seq0=_SEQ,
    rec="SELECT ts_code, trade_date, rn, " + ", ".join(f"CAST(NULL AS DOUBLE) AS e{n}" for n in _SPANS) + " FROM seq0 WHERE rn = 1"
    + " UNION ALL SELECT b.ts_code, b.trade_date, b.rn, " + ", ".join(_ema_sql(n) for n in _SPANS)
    + " FROM rec r JOIN seq0 b ON b.ts_code = r.ts_code AND b.rn = r.rn + 1",
)
def _(t):
    return rounded(_grouped(t, [f"ema{n}" for n in W.EMA_SPANS]), 5)


_MACD_REC = {
    "seq0": _SEQ,
    "rec": """SELECT ts_code, trade_date, rn, close, CAST(NULL AS DOUBLE) AS f, CAST(NULL AS DOUBLE) AS s FROM seq0 WHERE rn = 1
      UNION ALL SELECT b.ts_code, b.trade_date, b.rn, b.close,
      CASE WHEN b.rn = 26 THEN b.m12 WHEN b.rn > 26 THEN r.f + (b.close - r.f) * (2.0::DOUBLE / 13) END,
      CASE WHEN b.rn = 26 THEN b.m26 WHEN b.rn > 26 THEN r.s + (b.close - r.s) * (2.0::DOUBLE / 27) END
      FROM rec r JOIN seq0 b ON b.ts_code = r.ts_code AND b.rn = r.rn + 1""",
    "difs": "SELECT ts_code, trade_date, rn, f - s AS dif, avg(f - s) OVER (PARTITION BY ts_code ORDER BY rn ROWS 8 PRECEDING) AS m9 FROM rec",
    "sig": """SELECT ts_code, trade_date, rn, dif, CAST(NULL AS DOUBLE) AS dea FROM difs WHERE rn = 1
      UNION ALL SELECT b.ts_code, b.trade_date, b.rn, b.dif,
      CASE WHEN b.rn = 34 THEN b.m9 WHEN b.rn > 34 THEN r.dea + (b.dif - r.dea) * 0.2::DOUBLE END
      FROM sig r JOIN difs b ON b.ts_code = r.ts_code AND b.rn = r.rn + 1""",
}


@query(
    "w5_macd",
    f"""SELECT ts_code, trade_date, {R('CASE WHEN dea IS NOT NULL THEN dif END', 'macd_dif', 4)}, {R('dea', 'macd_dea', 4)},
    {R('dif - dea', 'macd_hist', 4)} FROM sig""",
    **_MACD_REC,
)
def _(t):
    return rounded(_grouped(t, ["macd_dif", "macd_dea", "macd_hist"]), 4)


_WILDER = {
    "seq0": _SEQ,
    "seq1": _SEQ2,
    "rec": """SELECT ts_code, trade_date, rn, CAST(NULL AS DOUBLE) AS u, CAST(NULL AS DOUBLE) AS d, CAST(NULL AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS dd FROM seq1 WHERE rn = 1
      UNION ALL SELECT b.ts_code, b.trade_date, b.rn,
      CASE WHEN b.rn = 15 THEN b.mu WHEN b.rn > 15 THEN (r.u * 13 + b.up) / 14 END,
      CASE WHEN b.rn = 15 THEN b.md WHEN b.rn > 15 THEN (r.d * 13 + b.dn) / 14 END,
      CASE WHEN b.rn = 9 THEN b.rsv WHEN b.rn > 9 THEN r.k * 2 / 3 + b.rsv / 3 END,
      CASE WHEN b.rn = 9 THEN b.rsv WHEN b.rn > 9 THEN r.dd * 2 / 3 + (r.k * 2 / 3 + b.rsv / 3) / 3 END
      FROM rec r JOIN seq1 b ON b.ts_code = r.ts_code AND b.rn = r.rn + 1""",
}


@query("w6_rsi", f"SELECT ts_code, trade_date, {R('CASE WHEN u + d = 0 THEN 0 ELSE 100 * u / (u + d) END', 'rsi')} FROM rec", **_WILDER)
def _(t):
    return rounded(_grouped(t, ["rsi"]))


@query(
    "w8_kdj",
    f"SELECT ts_code, trade_date, {R('k', 'kdj_k')}, {R('dd', 'kdj_d')}, {R('3 * k - 2 * dd', 'kdj_j')} FROM rec",
    **_WILDER,
)
def _(t):
    return rounded(_grouped(t, ["kdj_k", "kdj_d", "kdj_j"], ("high", "low", "close")))


@query(
    "w16_bull_and_bear_power",
    f"""SELECT rec.ts_code, rec.trade_date, {R('(low - e13) / close', 'bear_power')}, {R('(high - e13) / close', 'bull_power')}
    FROM rec JOIN bars USING (ts_code, trade_date)""",
    seq0=_SEQ,
    rec="SELECT ts_code, trade_date, rn, CAST(NULL AS DOUBLE) AS e13 FROM seq0 WHERE rn = 1"
    + f" UNION ALL SELECT b.ts_code, b.trade_date, b.rn, {_ema_sql(13)}"
    + " FROM rec r JOIN seq0 b ON b.ts_code = r.ts_code AND b.rn = r.rn + 1",
)
def _(t):
    return rounded(_grouped(t, ["bear_power", "bull_power"], ("high", "low", "close")))


@query(
    "w18_mass",
    f"SELECT ts_code, trade_date, {R('coalesce(' + win('sum(ratio)', 25, 'ratio') + ', 0)', 'mass')} FROM (SELECT ts_code, trade_date, a / nullif(b, 0) AS ratio FROM rec)",
    rec="""SELECT ts_code, trade_date, rn, high - low AS a, high - low AS b FROM rets WHERE rn = 1
      UNION ALL SELECT b.ts_code, b.trade_date, b.rn, r.a + (b.high - b.low - r.a) * 0.2::DOUBLE,
      r.b + (r.a + (b.high - b.low - r.a) * 0.2::DOUBLE - r.b) * (2.0::DOUBLE / 26)
      FROM rec r JOIN rets b ON b.ts_code = r.ts_code AND b.rn = r.rn + 1""",
)
def _(t):
    return rounded(_grouped(t, ["mass"], ("high", "low", "close")))


@query(
    "w19_cross_signals",
    f"""SELECT ts_code, trade_date, CASE WHEN a > b AND pa <= pb THEN 1 ELSE 0 END AS golden_cross,
    CASE WHEN a < b AND pa >= pb THEN 1 ELSE 0 END AS death_cross FROM
    (SELECT *, {lag('a')} AS pa, {lag('b')} AS pb FROM
    (SELECT ts_code, trade_date, {win('avg(close)', 5, 'close')} AS a, {win('avg(close)', 10, 'close')} AS b FROM bars))""",
)
def _(t):
    return t.bars.withColumns(W.moving_averages((5, 10))).withColumns(W.crosses()).select(*K, "golden_cross", "death_cross")


@query(
    "w19_macd_and_rsi_signals",
    f"""SELECT ts_code, trade_date, CASE WHEN dif > dea AND {lag('dif')} <= {lag('dea')} THEN 1 ELSE 0 END AS macd_golden_cross,
    CASE WHEN rsi < 30 THEN 1 ELSE 0 END AS rsi_oversold, CASE WHEN rsi > 70 THEN 1 ELSE 0 END AS rsi_overbought FROM
    (SELECT ts_code, trade_date, CASE WHEN dea IS NOT NULL THEN dif END AS dif, dea FROM sig)
    JOIN (SELECT ts_code, trade_date, CASE WHEN u + d = 0 THEN 0 ELSE 100 * u / (u + d) END AS rsi FROM wil) USING (ts_code, trade_date)""",
    **_MACD_REC,
    seq1=_SEQ2,
    wil=_WILDER["rec"].replace("FROM rec r", "FROM wil r"),
)
def _(t):
    return W.base_features(t.bars).select(*K, "macd_golden_cross", "rsi_oversold", "rsi_overbought")


@query("w20_all_base_features")
def _(t):
    return rounded(W.base_features(t.valued_bars, min_rows=60), 6)


# -- the second dialect -------------------------------------------------------------
def _fv(n, src="close"):
    return f"r.e{n} + (b.{src} - r.e{n}) * (2.0::DOUBLE / {n + 1})"


_FV = (5, 10, 20, 26, 60, 120, 12, 13)
_FV_REC = {
    "seq0": _SEQ,
    "rec": "SELECT ts_code, trade_date, rn, " + ", ".join(f"close AS e{n}" for n in _FV)
    + ", 50.0::DOUBLE AS k, 50.0::DOUBLE AS d, high - low AS a, high - low AS g FROM seq0 WHERE rn = 1 UNION ALL SELECT b.ts_code, b.trade_date, b.rn, "
    + ", ".join(f"{_fv(n)} AS e{n}" for n in _FV)
    + """, CASE WHEN b.rn >= 9 THEN r.k * 2 / 3 + coalesce(b.rsv, 50) / 3 ELSE 50 END,
      CASE WHEN b.rn >= 9 THEN r.d * 2 / 3 + (r.k * 2 / 3 + coalesce(b.rsv, 50) / 3) / 3 ELSE 50 END,
      r.a + (b.high - b.low - r.a) * 0.2::DOUBLE, r.g + (r.a + (b.high - b.low - r.a) * 0.2::DOUBLE - r.g) * 0.2::DOUBLE
      FROM rec r JOIN seq0 b ON b.ts_code = r.ts_code AND b.rn = r.rn + 1""",
    "difs": "SELECT ts_code, trade_date, rn, e12 - e26 AS dif FROM rec",
    "sig": """SELECT ts_code, trade_date, rn, dif, dif AS dea FROM difs WHERE rn = 1
      UNION ALL SELECT b.ts_code, b.trade_date, b.rn, b.dif, r.dea + (b.dif - r.dea) * 0.2::DOUBLE
      FROM sig r JOIN difs b ON b.ts_code = r.ts_code AND b.rn = r.rn + 1""",
}


@query(
    "w20_first_value_recurrences",
    "SELECT rec.ts_code, rec.trade_date, " + ", ".join(R(f"e{n}", f"ema{n}", 4) for n in _FV[:6])
    + f""", {R('dif', 'macd_dif', 4)}, {R('dea', 'macd_dea', 4)}, {R('2 * (dif - dea)', 'macd_hist', 4)},
    {R('CASE WHEN rec.rn >= 9 THEN k END', 'kdj_k', 4)}, {R('CASE WHEN rec.rn >= 9 THEN d END', 'kdj_d', 4)}, {R('CASE WHEN rec.rn >= 9 THEN 3 * k - 2 * d END', 'kdj_j', 4)},
    {R('low - e13', 'bear_power', 4)}, {R('high - e13', 'bull_power', 4)}, {R('mass', 'mass', 4)}
    FROM rec JOIN sig USING (ts_code, trade_date) JOIN bars USING (ts_code, trade_date)
    JOIN (SELECT ts_code, trade_date, {win('sum(q)', 25, 'q')} AS mass FROM (SELECT ts_code, trade_date, coalesce(a / nullif(g, 0), 0) AS q FROM rec)) USING (ts_code, trade_date)""",
    **_FV_REC,
)
def _(t):
    names = [c for c in W.GROUPED if c not in ("rsi", "macd_golden_cross") and not c.startswith(("skew", "kurt", "cci"))]
    return rounded(_grouped(t, names, ("high", "low", "close"), "first_value"), 4)


@query(
    "w20_first_value_frames",
    f"""SELECT ts_code, trade_date, {R(win('sum(turnover_rate)', 5, 'turnover_rate'), 'turnover_rate_5', 4)},
    {_R6('br', 'br')}, {_R6('ar', 'ar')}, {_R6('br * 0.92', 'cr20')}, {R("nullif(v, 0) * sqrt(252)", 'volatility_20d', 4)},
    {R('(25 - (list_position(list_reverse(hs), list_max(hs)) - 1)) * 4.0', 'arron_up_25', 4)},
    {R('(25 - (list_position(list_reverse(ls), list_min(ls)) - 1)) * 4.0', 'arron_down_25', 4)} FROM
    (SELECT *, {win('sum(hu)', 26, 'hu')} / nullif({win('sum(hd)', 26, 'hd')}, 0) * 100 AS br,
     {win('sum(au)', 26, 'au')} / nullif({win('sum(ad)', 26, 'ad')}, 0) * 100 AS ar, {win('stddev_pop(ret)', 20, 'ret')} AS v,
     {win('list(high)', 25, 'high')} AS hs, {win('list(low)', 25, 'low')} AS ls FROM
    (SELECT r.*, turnover_rate, greatest(r.high - coalesce(pre_close, r.close), 0) AS hu, greatest(coalesce(pre_close, r.close) - r.low, 0) AS hd,
     r.high - r.open AS au, r.open - r.low AS ad FROM rets r LEFT JOIN valuation USING (ts_code, trade_date)))""",
)
def _(t):
    df = W.closed_features(daily_panel(t.bars, t.valuation), "first_value")
    names = ["turnover_rate_5", "br", "ar", "cr20", "volatility_20d", "arron_up_25", "arron_down_25"]
    return _coarse(rounded(df.select(*K, *names), 4, br=6, ar=6, cr20=6))
