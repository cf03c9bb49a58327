"""Schedules, adjusted prices, portfolios and accounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspan.functions.frames import change, previous
from barspan.operators import backtest as B
from barspan.operators import learning as L
from barspan.operators import quality as Q
from barspan.operators.market import forward_label
from barspan.operators.walkforward import walk_forward_scores, window_coefficients
from barspan.plans.oracle import R
from barspan.plans.registry import query, rounded
from barspan.plans.technical import K, OVER
from barspan.session import cut_lineage


def _regions(t) -> DataFrame:
    """The dense panel, written once: accounts read it several times."""
    return cut_lineage(t.region_bars, "regions")


def _nations(t) -> DataFrame:
    return cut_lineage(t.nation_bars, "nations")


def price_limits(bars: DataFrame) -> DataFrame:
    """Daily limits: half and one and a half times the previous close, widened to hold the open."""
    pc = previous("close")
    return bars.select(
        "ts_code",
        "trade_date",
        F.when(pc.isNotNull(), F.greatest(pc * 1.5, F.col("open"))).alias("up_limit"),
        F.when(pc.isNotNull(), F.least(pc * 0.5, F.col("open"))).alias("down_limit"),
    )


@query(
    "b9_adjusted_prices",
    f"""SELECT ts_code, trade_date, {R('open * m', 'open', 7)}, {R('close * m', 'close', 7)}, {R('CASE WHEN vol = 0 THEN 0 ELSE amount * 10 / vol * m END', 'vwap', 7)}, vol, amount, {R('m', 'multiplier')}
    , CASE WHEN m IS NULL THEN 'MISSING_FACTOR' ELSE 'OK' END AS factor_status
    FROM (SELECT b.*, adj_factor / first_value(adj_factor IGNORE NULLS) {OVER} AS m FROM bars b LEFT JOIN factors USING (ts_code, trade_date))""",
)
def _(t):
    out = B.adjust_prices(t.bars, t.factors)
    return rounded(out.select(*K, "open", "close", "vwap", "vol", "amount", "multiplier", "factor_status"), 7, multiplier=6, amount=2)


_SES = {"rs": "SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS o FROM (SELECT DISTINCT trade_date FROM rbars)"}
_PLAN = {
    **_SES,
    "plan": """SELECT (a.o - 1) // 4 AS cycle, a.trade_date AS signal_date, b.trade_date AS entry_date, c.trade_date AS exit_date, b.o AS eo, c.o AS xo FROM rs a
      JOIN rs b ON b.o = a.o + 1 JOIN rs c ON c.o = a.o + 5 WHERE a.o >= 1 AND (a.o - 1) % 4 = 0""",
}


@query("b10_rebalance_schedule", "SELECT cycle, signal_date, entry_date, exit_date FROM plan", **_PLAN)
def _(t):
    plan = B.rebalance_schedule(B.panel_sessions(_regions(t)), 1, 4)
    return plan.select("cycle", "signal_date", "entry_date", "exit_date")


_COSTS = "(VALUES ('gross', 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), ('fee3', 0.0003, 0.0003, 0.0), ('fee3_slip5', 0.0003, 0.0003, 0.0005), ('fee3_slip10', 0.0003, 0.0003, 0.001)) k(scenario, bf, sf, sl)"
_PORT = {
    **_PLAN,
    "costs": f"SELECT * FROM {_COSTS}",
    "picks": """SELECT cycle, ts_code, 0.5 AS w FROM (SELECT cycle, ts_code, row_number() OVER (PARTITION BY cycle ORDER BY ret DESC, ts_code) AS p FROM rrets JOIN plan ON signal_date = trade_date) WHERE p <= 2""",
    "legs": """SELECT scenario, p.cycle, p.ts_code, entry_date, exit_date, eo, xo, w / ((1 + bf) * e.open * (1 + sl)) AS u, x.open * (1 - sl) * (1 - sf) AS pr, e.open AS eopen, x.open AS xopen, bf, sf, sl
      FROM picks p JOIN plan USING (cycle) JOIN rbars e ON e.ts_code = p.ts_code AND e.trade_date = entry_date JOIN rbars x ON x.ts_code = p.ts_code AND x.trade_date = exit_date CROSS JOIN costs""",
    "grow": "SELECT scenario, cycle, sum(u * pr) AS g FROM legs GROUP BY 1, 2",
    "cash": "SELECT scenario, cycle, g, 1000000 * exp(coalesce(sum(ln(g)) OVER (PARTITION BY scenario ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS st FROM grow",
    "eq": """SELECT l.scenario, l.cycle, s.trade_date, any_value(st) * sum(u * b.close) AS equity FROM legs l JOIN rs s ON s.o >= eo AND s.o < xo JOIN rbars b ON b.ts_code = l.ts_code AND b.trade_date = s.trade_date
      JOIN cash c ON c.scenario = l.scenario AND c.cycle = l.cycle GROUP BY 1, 2, 3
      UNION ALL SELECT c.scenario, c.cycle, p.exit_date, st * g FROM cash c JOIN plan p USING (cycle) WHERE cycle = (SELECT max(cycle) FROM plan)""",
}


def _portfolio(t, score=None, start=1):
    prices = _regions(t)
    sessions = cut_lineage(B.panel_sessions(prices), "sessions")
    plan = B.rebalance_schedule(sessions, start, 4)
    scores = prices.withColumn("score", change("close") if score is None else score)
    return B.cycle_account(prices, sessions, B.equal_picks(scores.select(*K, "score"), plan, 2), plan)


@query("b2_portfolio_equity", f"SELECT scenario, cycle, trade_date, {R('ln(equity)', 'log_equity', 5)} FROM eq", **_PORT)
def _(t):
    equity, _ = _portfolio(t)
    return rounded(equity.select("scenario", "cycle", "trade_date", F.log("equity").alias("log_equity")), 5)


@query("b4_scenario_cycles", f"SELECT scenario, cycle, {R('g', 'growth')}, {R('ln(st)', 'log_start', 5)} FROM cash", **_PORT)
def _(t):
    _, cycles = _portfolio(t)
    return rounded(cycles.select("scenario", "cycle", "growth", F.log("start_cash").alias("log_start")), 6, log_start=5)


@query(
    "b3_portfolio_metrics",
    f"""SELECT scenario, count(*) AS days, {R('ln(arg_max(equity, trade_date))', 'log_final', 5)}, {R('min(dd)', 'max_drawdown', 5)}, arg_min(trade_date, (dd, trade_date)) AS drawdown_trough_date, arg_min(pk, (dd, trade_date)) AS drawdown_peak_date
    FROM (SELECT *, equity / max(equity) OVER w - 1 AS dd, arg_max(trade_date, equity) OVER w AS pk FROM eq WINDOW w AS (PARTITION BY scenario ORDER BY trade_date)) GROUP BY 1""",
    **_PORT,
)
def _(t):
    m = B.equity_metrics(_portfolio(t)[0])
    return rounded(m.select("scenario", "days", F.log("final_equity").alias("log_final"), "max_drawdown", "drawdown_peak_date", "drawdown_trough_date"), 5)


@query(
    "b3_monthly_returns",
    f"""SELECT scenario, month, {R('ln(e / coalesce(lag(e) OVER (PARTITION BY scenario ORDER BY month), 1000000))', 'log_return', 5)} FROM
    (SELECT scenario, CAST(date_trunc('month', trade_date) AS DATE) AS month, arg_max(equity, trade_date) AS e FROM eq GROUP BY 1, 2)""",
    **_PORT,
)
def _(t):
    m = B.monthly_returns(_portfolio(t)[0])
    return rounded(m.select("scenario", "month", F.log(F.col("return") + 1).alias("log_return")), 5)


@query(
    "b3_cost_totals",
    f"""SELECT scenario, count(*) AS cycles, {R('coalesce(ln(nullif(sum(st * fees), 0)), 0)', 'log_fees', 4)}, {R('coalesce(ln(nullif(sum(st * slips), 0)), 0)', 'log_slippage', 4)}, {R('ln(sum(st * traded))', 'log_notional', 4)} FROM cash JOIN
    (SELECT scenario, cycle, sum(u * eopen * (1 + sl) * bf + u * xopen * (1 - sl) * sf) AS fees, sum(u * eopen * sl + u * xopen * sl) AS slips, sum(u * eopen * (1 + sl) + u * xopen * (1 - sl)) AS traded FROM legs GROUP BY 1, 2) USING (scenario, cycle) GROUP BY 1""",
    **_PORT,
)
def _(t):
    c = B.cost_totals(_portfolio(t)[1])

    def ln(name):
        return F.coalesce(F.log(F.nullif(F.col(name), F.lit(0.0))), F.lit(0.0))

    return rounded(c.select("scenario", "cycles", ln("total_fees").alias("log_fees"), ln("total_slippage").alias("log_slippage"), ln("traded_notional").alias("log_notional")), 4)


@query(
    "b3_turnover",
    f"""SELECT scenario, trade_date, {R('ln(opening)', 'log_opening', 5)}, {R('(buy + sell) / opening', 'two_sided_turnover')}, {R('(buy + sell) / opening / 2', 'one_sided_turnover')}
    FROM (SELECT scenario, d AS trade_date, sum(buy) AS buy, sum(sell) AS sell, coalesce(max(op), max(purse)) AS opening FROM tov GROUP BY 1, 2)""",
    **_PORT,
    tov="""SELECT scenario, entry_date AS d, any_value(st) * sum(u * eopen * (1 + sl)) AS buy, 0 AS sell, NULL AS op, any_value(st) AS purse FROM legs JOIN cash USING (scenario, cycle) GROUP BY scenario, cycle, entry_date
      UNION ALL SELECT scenario, exit_date, 0, any_value(st) * sum(u * xopen * (1 - sl)), any_value(st) * sum(u * xopen), NULL FROM legs JOIN cash USING (scenario, cycle) GROUP BY scenario, cycle, exit_date""",
)
def _(t):
    out = B.turnover(_portfolio(t)[1])
    return rounded(out.select("scenario", "trade_date", F.log("opening_equity").alias("log_opening"), "two_sided_turnover", "one_sided_turnover"), 6, log_opening=5)


_WACC = {
    **_SES,
    "costs": f"SELECT * FROM {_COSTS}",
    "last": "SELECT max(o) AS m FROM rs",
    "plan": """SELECT (a.o - 1) // 5 AS cycle, a.trade_date AS signal_date, b.trade_date AS entry_date, c.trade_date AS exit_date, b.o AS eo, coalesce(c.o - 1, (SELECT m FROM last)) AS xo FROM rs a
      JOIN rs b ON b.o = a.o + 1 LEFT JOIN rs c ON c.o = a.o + 6 WHERE a.o >= 1 AND (a.o - 1) % 5 = 0""",
    "sel": """SELECT cycle, ts_code, ret / sum(ret) OVER (PARTITION BY cycle) AS w FROM (SELECT cycle, ts_code, ret, row_number() OVER (PARTITION BY cycle ORDER BY ret DESC, ts_code) AS p FROM rrets JOIN plan ON signal_date = trade_date) WHERE p <= 3 AND ret > 0""",
    "picks": "SELECT 'strategy' AS book, * FROM sel UNION ALL SELECT 'benchmark', cycle, ts_code, 1.0 / (SELECT count(DISTINCT ts_code) FROM rbars) FROM rrets JOIN plan ON signal_date = trade_date",
    "legs": """SELECT book, scenario, p.cycle, p.ts_code, eo, xo, exit_date, w, w / ((1 + bf) * e.open * (1 + sl)) AS u, x.open * (1 - sl) * (1 - sf) AS pr
      FROM picks p JOIN plan USING (cycle) JOIN rbars e ON e.ts_code = p.ts_code AND e.trade_date = entry_date LEFT JOIN rbars x ON x.ts_code = p.ts_code AND x.trade_date = exit_date CROSS JOIN costs""",
    "grow": """SELECT book, scenario, plan.cycle, plan.eo, plan.xo, coalesce(inv, 0) AS inv, CASE WHEN plan.exit_date IS NOT NULL THEN 1 - coalesce(inv, 0) + coalesce(back, 0) END AS g FROM plan CROSS JOIN costs CROSS JOIN (SELECT unnest(['strategy', 'benchmark']) AS book)
      LEFT JOIN (SELECT book, scenario, cycle, sum(w) AS inv, sum(u * pr) AS back FROM legs GROUP BY 1, 2, 3) USING (book, scenario, cycle)""",
    "cash": "SELECT *, 1000000 * exp(coalesce(sum(ln(g)) OVER (PARTITION BY book, scenario ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS st FROM grow",
    "eq": """SELECT c.book, c.scenario, s.trade_date, st * (1 - inv + coalesce(worth, 0)) AS equity FROM cash c JOIN rs s ON s.o >= c.eo AND s.o <= c.xo LEFT JOIN
      (SELECT l.book, l.scenario, l.cycle, b.trade_date, sum(u * b.close) AS worth FROM legs l JOIN rs s ON s.o >= eo AND s.o <= xo JOIN rbars b ON b.ts_code = l.ts_code AND b.trade_date = s.trade_date GROUP BY 1, 2, 3, 4) h
      ON h.book = c.book AND h.scenario = c.scenario AND h.cycle = c.cycle AND h.trade_date = s.trade_date""",
}


def _weighted(t, scores=None, start=1):
    prices = _regions(t)
    sessions = cut_lineage(B.panel_sessions(prices), "sessions")
    plan = B.rebalance_schedule(sessions, start, 5, 1, None)
    scores = prices.withColumn("score", change("close")).select(*K, "score") if scores is None else scores
    strategy, _ = B.cycle_account(prices, sessions, B.score_weighted_picks(scores, plan, 3), plan)
    benchmark, _ = B.cycle_account(prices, sessions, B.pool_picks(prices, plan), plan)
    return strategy, benchmark


@query("b5_weighted_account", f"SELECT book, scenario, trade_date, {R('ln(equity)', 'log_equity', 5)} FROM eq", **_WACC)
def _(t):
    a, b = _weighted(t)
    both = a.withColumn("book", F.lit("strategy")).unionByName(b.withColumn("book", F.lit("benchmark")))
    return rounded(both.select("book", "scenario", "trade_date", F.log("equity").alias("log_equity")), 5)


_LOG_EXCESS = R("ln(max(e) FILTER (book = 'strategy') / max(e) FILTER (book <> 'strategy'))", "log_excess", 4)


@query(
    "b5_excess_return",
    f"SELECT scenario, {_LOG_EXCESS} FROM (SELECT book, scenario, arg_max(equity, trade_date) AS e FROM eq GROUP BY 1, 2) GROUP BY 1",
    **_WACC,
)
def _(t):
    a, b = _weighted(t)
    x = B.equity_metrics(a).select("scenario", F.col("final_equity").alias("s"))
    y = B.equity_metrics(b).select("scenario", F.col("final_equity").alias("b"))
    return rounded(x.join(y, "scenario").select("scenario", F.log(F.col("s") / F.col("b")).alias("log_excess")), 4)


@query("a26_results_over_seeds")
def _(t):
    """Seeds are the three possible phases of the schedule; policies are two scores."""
    prices = _regions(t)
    sessions = cut_lineage(B.panel_sessions(prices), "sessions")
    scored = prices.withColumns({"raw": change("close"), "range": (F.col("high") - F.col("low")) / F.col("close")})
    rows = None
    for seed in (1, 2, 3):
        plan = B.rebalance_schedule(sessions, seed, 4)
        zero = prices.select(*K, F.lit(0.0).alias("score"))
        pool = prices.select("ts_code").distinct().count()
        bench = B.equity_metrics(B.cycle_account(prices, sessions, B.equal_picks(zero, plan, pool), plan)[0])
        bench = cut_lineage(bench.select("scenario", F.log1p("total_return").alias("benchmark_return")), "benchmark")
        for policy in ("raw", "range"):
            picks = B.equal_picks(scored.select(*K, F.col(policy).alias("score")), plan, 2)
            m = B.equity_metrics(B.cycle_account(prices, sessions, picks, plan)[0]).join(bench, "scenario")
            m = m.select("scenario", "benchmark_return", F.log1p("total_return").alias("total_return"), F.lit(policy).alias("policy"), F.lit(seed).alias("seed"))
            m = cut_lineage(m, "seed")
            rows = m if rows is None else rows.unionByName(m)
    return rounded(B.aggregate_results(rows), 4)


_SIG = f"SELECT *, lag(sig) {OVER} AS prev FROM (SELECT ts_code, trade_date, open, close, rn, CASE WHEN (close - low) / (high - low + 1e-12::DOUBLE) > 0.55 THEN 1 WHEN (close - low) / (high - low + 1e-12::DOUBLE) < 1 - 0.55::DOUBLE THEN -1 ELSE 0 END AS sig FROM rets)"
_BUY = "b.prev = 1 AND r.pos = 0 AND floor(r.cash * 0.95::DOUBLE / (b.open * (1 + 0.001::DOUBLE) * (1 + 0.0003::DOUBLE))) > 0"
_SELL = "b.prev = -1 AND r.pos > 0 AND r.held >= 1"
_SHARES = "floor(r.cash * 0.95::DOUBLE / (b.open * (1 + 0.001::DOUBLE) * (1 + 0.0003::DOUBLE)))"


_REC = f"""SELECT ts_code, trade_date, rn, close, 1000000.0::DOUBLE AS cash, 0.0::DOUBLE AS pos, 0 AS held FROM sig WHERE rn = 1 UNION ALL
      SELECT b.ts_code, b.trade_date, b.rn, b.close,
      CASE WHEN {_BUY} THEN r.cash - {_SHARES} * (b.open * (1 + 0.001::DOUBLE)) * (1 + 0.0003::DOUBLE) WHEN {_SELL} THEN r.cash + r.pos * (b.open * (1 - 0.001::DOUBLE)) * (1 - 0.0003::DOUBLE) ELSE r.cash END,
      CASE WHEN {_BUY} THEN {_SHARES} WHEN {_SELL} THEN 0 ELSE r.pos END,
      CASE WHEN {_BUY} THEN 1 WHEN {_SELL} THEN 0 WHEN r.pos > 0 THEN r.held + 1 ELSE r.held END
      FROM rec r JOIN sig b ON b.ts_code = r.ts_code AND b.rn = r.rn + 1"""


@query(
    "b1_signal_backtest",
    f"SELECT ts_code, trade_date, {R('ln(cash + pos * close)', 'log_equity')}, pos > 0 AS invested FROM rec",
    sig=_SIG,
    rec=_REC,
)
def _(t):
    p = (F.col("close") - F.col("low")) / (F.col("high") - F.col("low") + 1e-12)
    out = B.signal_backtest(t.bars.withColumn("signal", L.probability_signal(p)))
    return rounded(out.select(*K, F.log("equity").alias("log_equity"), (F.col("position") > 0).alias("invested")))


def _signalled(t):
    p = (F.col("close") - F.col("low")) / (F.col("high") - F.col("low") + 1e-12)
    return B.signal_backtest(t.bars.withColumn("signal", L.probability_signal(p)))


_MOVES = f"SELECT rec.*, lag(pos) {OVER} AS was, lag(trade_date) {OVER} AS signal_date FROM rec"


@query(
    "b1_trades",
    f"""SELECT m.ts_code, m.trade_date, signal_date, CASE WHEN m.pos > 0 THEN 'BUY' ELSE 'SELL' END AS action, {R('ln(CASE WHEN m.pos > 0 THEN m.pos ELSE was END)', 'log_shares')},
    {R('b.open * CASE WHEN m.pos > 0 THEN 1 + 0.001::DOUBLE ELSE 1 - 0.001::DOUBLE END', 'price')}, {R('ln(abs(m.cash - c.cash))', 'log_amount', 5)}
    FROM moved m JOIN bars b USING (ts_code, trade_date) JOIN rec c ON c.ts_code = m.ts_code AND c.rn = m.rn - 1 WHERE m.pos <> was""",
    sig=_SIG,
    rec=_REC,
    moved=_MOVES,
)
def _(t):
    out = B.signal_trades(_signalled(t))
    return rounded(out.select(*K, "signal_date", "action", F.log("shares").alias("log_shares"), "price", F.log("cash_amount").alias("log_amount")), 6, log_amount=5)


@query(
    "b1_metrics",
    f"""SELECT ts_code, count(*) AS sessions, CAST(count(*) FILTER (pos > 0 AND coalesce(was, 0) = 0) AS BIGINT) AS total_trades, {R('ln(arg_max(e, trade_date))', 'log_final')}, {R('min(dd)', 'max_drawdown')}, {R('avg(r)', 'mean_daily_return')}
    FROM (SELECT *, e / greatest(1000000, max(e) {OVER}) - 1 AS dd, e / coalesce(lag(e) {OVER}, 1000000) - 1 AS r FROM (SELECT *, cash + pos * close AS e FROM moved)) GROUP BY 1""",
    sig=_SIG,
    rec=_REC,
    moved=_MOVES,
)
def _(t):
    m = B.signal_metrics(_signalled(t))
    return rounded(m.select("ts_code", "sessions", "total_trades", F.log("final_equity").alias("log_final"), "max_drawdown", "mean_daily_return"))


# -- market account -----------------------------------------------------------------
def _markets(bars, calendar, slips):
    """Nations as instruments, one copy per slippage: a session without a quote is a proven halt."""
    sessions = cut_lineage(Q.session_ordinals(calendar), "sessions")
    factors = bars.select(*K, (1 + F.floor(F.year("trade_date") - 1995) / 10).alias("adj_factor"))
    lives = bars.groupBy("ts_code").agg(F.min("trade_date").alias("list_date")).withColumn("delist_date", F.lit(None).cast("date"))
    halts = Q.missing_keys(Q.lifetime_grid(lives, sessions), bars)
    limits = price_limits(bars).select(
        *K, F.coalesce("up_limit", F.lit(1e9)).alias("up_limit"), F.coalesce("down_limit", F.lit(0.01)).alias("down_limit")
    )
    days = [B.market_days(bars, factors, limits, sessions, halts, x).withColumn("slip", F.lit(float(x))) for x in slips]
    return cut_lineage(reduce(DataFrame.unionByName, days), "market"), sessions


def _market(bars, calendar, slip):
    days, sessions = _markets(bars, calendar, [slip])
    return days.drop("slip"), sessions


_FILLS = {
    "nr": f"SELECT *, lag(close) {OVER} AS pc FROM nbars",
    "lim": "SELECT *, CASE WHEN pc IS NULL THEN 1e9 ELSE greatest(pc * 1.5, open) END AS up, CASE WHEN pc IS NULL THEN 0.01 ELSE least(pc * 0.5, open) END AS dn FROM nr",
    "lives": "SELECT ts_code, min(trade_date) AS a FROM nbars GROUP BY 1",
}


def _block(edge, price):
    return f"""CASE WHEN open IS NULL THEN 'SUSPENDED' WHEN vol <= 0 THEN 'NO_VOLUME_OR_SUSPENDED' WHEN open < dn OR open > up THEN 'QUOTE_OUTSIDE_LIMITS' WHEN {edge}
      WHEN {price} < low OR {price} > high OR {price} < dn OR {price} > up THEN 'SLIPPAGE_OUTSIDE_RANGE' END"""


@query(
    "b7_fill_table",
    f"""SELECT l.ts_code, s.trade_date, {_block("open >= up THEN 'UP_LIMIT'", 'open * (1 + 0.001::DOUBLE)')} AS buy_block, {_block("open <= dn THEN 'DOWN_LIMIT'", 'open * (1 - 0.001::DOUBLE)')} AS sell_block,
    {R("close * (1 + floor(year(s.trade_date) - 1995) / 10)", 'mark', 4)} FROM lives l JOIN sessions s ON s.trade_date >= a LEFT JOIN lim USING (ts_code, trade_date)""",
    **_FILLS,
)
def _(t):
    days, _ = _market(_nations(t), t.calendar, 0.001)
    return rounded(days.select(*K, "buy_block", "sell_block", "mark"), 4)


_WALK = ["ret", "range", "place"]
WINDOW_DAYS, WINDOW_STEP = 365, 5


def _walk(t):
    """The panel with its features, and the fits of every rebalance over the trailing window."""
    prices = _regions(t)
    df = forward_label(prices.withColumn("ret", change("close")))
    df = df.withColumns({"range": (F.col("high") - F.col("low")) / F.col("close"), "place": (F.col("close") - F.col("low")) / (F.col("high") - F.col("low") + 1e-12)})
    ready = cut_lineage(df.na.drop(subset=_WALK), "walk")
    sessions = cut_lineage(B.panel_sessions(prices), "sessions")
    return ready, cut_lineage(window_coefficients(ready, _WALK, sessions, WINDOW_DAYS, WINDOW_STEP), "fits")


_FITS = {
    **_SES,
    "wsam": f"""SELECT b.ts_code, b.trade_date, s.o AS d, t.o AS t, ret AS x1, (high - low) / close AS x2, (close - low) / (high - low + 1e-12::DOUBLE) AS x3, y FROM
      (SELECT *, lead(close, 5) {OVER} / close - 1 AS y, lead(trade_date, 5) {OVER} AS target FROM rrets) b JOIN rs s USING (trade_date) LEFT JOIN rs t ON t.trade_date = target WHERE ret IS NOT NULL""",
    "wsig": f"SELECT trade_date, o FROM rs WHERE o >= {WINDOW_DAYS} AND (o - {WINDOW_DAYS}) % {WINDOW_STEP} = 0",
    "wmom": f"""SELECT wsig.trade_date, wsig.o, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, stddev_pop(x3) AS s3,
      covar_pop(x1, x2) AS c12, covar_pop(x1, x3) AS c13, covar_pop(x2, x3) AS c23, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, covar_pop(x3, y) AS c3
      FROM wsig JOIN wsam ON d >= wsig.o - {WINDOW_DAYS} AND d < wsig.o AND wsam.t < wsig.o WHERE y IS NOT NULL GROUP BY 1, 2""",
    # the scaled system is symmetric with n + 1 on the diagonal: Cramer's rule
    "wsys": "SELECT *, n + 1.0::DOUBLE AS k, n * c12 / (s1 * s2) AS a, n * c13 / (s1 * s3) AS b, n * c23 / (s2 * s3) AS c, n * c1 / s1 AS u, n * c2 / s2 AS v, n * c3 / s3 AS w FROM wmom",
    "wdet": """SELECT *, k * (k * k - c * c) - a * (a * k - b * c) + b * (a * c - b * k) AS det, u * (k * k - c * c) - a * (v * k - c * w) + b * (v * c - k * w) AS d1,
      k * (v * k - c * w) - u * (a * k - b * c) + b * (a * w - b * v) AS d2, k * (k * w - v * c) - a * (a * w - v * b) + u * (a * c - k * b) AS d3 FROM wsys""",
    "wfit": "SELECT trade_date, o, n, d1 / det / s1 AS w1, d2 / det / s2 AS w2, d3 / det / s3 AS w3, my - d1 / det / s1 * m1 - d2 / det / s2 * m2 - d3 / det / s3 * m3 AS w0 FROM wdet",
    "wscore": "SELECT ts_code, trade_date, w0 + w1 * x1 + w2 * x2 + w3 * x3 AS score FROM wsam JOIN wfit USING (trade_date)",
}


@query("b6_window_coefficients", f"SELECT trade_date, n AS rows, {R('w0', 'intercept', 8)}, {R('w1', 'w1')}, {R('w2', 'w2')}, {R('w3', 'w3')} FROM wfit", **_FITS)
def _(t):
    fits = _walk(t)[1]
    return rounded(fits.select("trade_date", "rows", "intercept", *[F.get("weights", F.lit(i)).alias(f"w{i + 1}") for i in range(3)]), 6, intercept=8)


_WALK_ACCOUNT = {
    **_FITS,
    **{k: v for k, v in _WACC.items() if k != "rs"},
    "plan": f"""SELECT (a.o - {WINDOW_DAYS}) // 5 AS cycle, a.trade_date AS signal_date, b.trade_date AS entry_date, c.trade_date AS exit_date, b.o AS eo, coalesce(c.o - 1, (SELECT m FROM last)) AS xo FROM rs a
      JOIN rs b ON b.o = a.o + 1 LEFT JOIN rs c ON c.o = a.o + 6 WHERE a.o >= {WINDOW_DAYS} AND (a.o - {WINDOW_DAYS}) % 5 = 0""",
    "sel": """SELECT cycle, ts_code, score / sum(score) OVER (PARTITION BY cycle) AS w FROM (SELECT cycle, ts_code, score, row_number() OVER (PARTITION BY cycle ORDER BY score DESC, ts_code) AS p FROM wscore JOIN plan ON signal_date = trade_date) WHERE p <= 3 AND score > 0""",
    "picks": "SELECT 'strategy' AS book, * FROM sel",
}


@query(
    "b6_walk_forward_account",
    f"""SELECT scenario, count(*) AS days, {R('ln(arg_max(equity, trade_date))', 'log_final', 5)}, {R('min(dd)', 'max_drawdown', 5)}
    FROM (SELECT *, equity / max(equity) OVER (PARTITION BY scenario ORDER BY trade_date) - 1 AS dd FROM eq WHERE book = 'strategy') GROUP BY 1""",
    **_WALK_ACCOUNT,
)
def _(t):
    """Scores of a fit over the trailing window at every rebalance, traded as the weighted account."""
    ready, fits = _walk(t)
    strategy, _ = _weighted(t, walk_forward_scores(ready, fits, _WALK), WINDOW_DAYS)
    m = B.equity_metrics(strategy)
    return rounded(m.select("scenario", "days", F.log("final_equity").alias("log_final"), "max_drawdown"), 5)
