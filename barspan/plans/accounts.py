"""Market accounts: equity, lots, trades and metrics of several books in one job.

The oracle walks an instrument's tries and an account's cycles with recursive SQL: cash before
cycle j is the initial amount plus, for each earlier cycle, its budget times what a unit of it has brought in
by then.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from barspan.functions.frames import change
from barspan.operators import backtest as B
from barspan.plans.backtests import _FILLS, _block, _markets, _nations
from barspan.plans.oracle import R
from barspan.plans.registry import query, rounded
from barspan.plans.technical import K

ONE = [B.Account("fee3_slip10/strategy", 0.0003, 0.001, 5)]
BOOKS = [
    B.Account(f"{name}/{book}", fee, slip, top)
    for name, fee, slip in (("gross", 0.0, 0.0), ("fee3", 0.0003, 0.0), ("fee3_slip10", 0.0003, 0.001))
    for book, top in (("strategy", 5), ("benchmark", None))
]
#: A threshold on the entry score leaves slots in cash; few slots and a whole pool.
CHOSEN = [B.Account("positive", 0.0003, 0.001, 5, 0.0), B.Account("jumps", 0.001, 0.0, 3, 0.5), B.Account("pool", 0.0003, 0.001, None, 0.1)]


def _number(v) -> str:
    return "NULL" if v is None else str(v)


def _ctes(accounts) -> dict[str, str]:
    rows = ", ".join(f"('{a.account}', {a.fee}::DOUBLE, {a.slip}::DOUBLE, {_number(a.top_n)}::INTEGER, {_number(a.score_min)}::DOUBLE)" for a in accounts)
    return {
        **_FILLS,
        "cfg": f"SELECT * FROM (VALUES {rows}) x(account, fee, slip, top, smin)",
        "mdays": f"""SELECT slip, l.ts_code, s.trade_date, s.ordinal, {_block("open >= up THEN 'UP_LIMIT'", 'open * (1 + slip)')} AS bb, {_block("open <= dn THEN 'DOWN_LIMIT'", 'open * (1 - slip)')} AS sb,
            open * (1 + slip) * f AS bp, open * (1 - slip) * f AS sp, close * f AS mark, open * f AS omark
          FROM lives l JOIN sessions s ON s.trade_date >= a CROSS JOIN (SELECT DISTINCT slip FROM cfg) LEFT JOIN (SELECT *, 1 + floor(year(trade_date) - 1995) / 10 AS f FROM lim) USING (ts_code, trade_date)""",
        "fin": "SELECT max(ordinal) AS m FROM mdays",
        "mplan": "SELECT (ordinal - 1) // 5 AS cycle, trade_date AS signal_date, ordinal + 1 AS eo, ordinal + 6 AS xo FROM sessions WHERE (ordinal - 1) % 5 = 0 AND ordinal + 6 <= (SELECT m FROM fin)",
        "ranked": "SELECT cycle, eo, xo, ts_code, score, row_number() OVER (PARTITION BY cycle ORDER BY score DESC, ts_code) AS rk FROM (SELECT ts_code, trade_date, close / pc - 1 AS score FROM nr WHERE pc IS NOT NULL) JOIN mplan ON trade_date = signal_date",
        "wanted": """SELECT account, fee, slip, cycle, eo, xo, ts_code, CASE WHEN top IS NULL THEN count(*) OVER (PARTITION BY account, cycle) ELSE top END AS slots
          FROM ranked CROSS JOIN cfg WHERE (top IS NULL OR rk <= top) AND (smin IS NULL OR score >= smin)""",
        "exits": "SELECT slip, ts_code, ordinal AS so, sp FROM mdays WHERE sb IS NULL",
        "entries": "SELECT slip, ts_code, ordinal AS eo, bp, bb FROM mdays",
        "tried": """SELECT w.*, bp, bb, bp IS NOT NULL AND bb IS NULL AS fills, coalesce(so, 2147483647) AS until, so, sp, row_number() OVER (PARTITION BY w.account, w.ts_code ORDER BY cycle) AS k
          FROM wanted w LEFT JOIN entries USING (slip, ts_code, eo) ASOF LEFT JOIN exits x ON x.slip = w.slip AND x.ts_code = w.ts_code AND w.xo <= x.so""",
        "walk": """SELECT account, ts_code, k, CASE WHEN fills THEN until ELSE -1 END AS busy, CASE WHEN fills THEN 'LOT' ELSE 'UNFILLED' END AS outcome FROM tried WHERE k = 1 UNION ALL
          SELECT t.account, t.ts_code, t.k, CASE WHEN t.eo >= walk.busy AND t.fills THEN t.until ELSE walk.busy END, CASE WHEN t.eo < walk.busy THEN 'OPEN' WHEN t.fills THEN 'LOT' ELSE 'UNFILLED' END
          FROM walk JOIN tried t ON t.account = walk.account AND t.ts_code = walk.ts_code AND t.k = walk.k + 1""",
        "lots": "SELECT t.*, sp / bp * (1 - fee) / (1 + fee) AS g FROM tried t JOIN walk USING (account, ts_code, k) WHERE outcome = 'LOT'",
        "coef": """SELECT account, cycle, list(c ORDER BY i) AS cs FROM (SELECT cfg.account, j.cycle, i.cycle AS i, coalesce(sum(CASE WHEN l.so <= j.eo THEN l.g END), 0) - count(l.ts_code) AS c
          FROM cfg CROSS JOIN mplan j JOIN mplan i ON i.cycle < j.cycle LEFT JOIN lots l ON l.account = cfg.account AND l.cycle = i.cycle GROUP BY 1, 2, 3) GROUP BY 1, 2""",
        "slot_counts": "SELECT cfg.account, mplan.cycle, coalesce(max(slots), 0) AS n FROM cfg CROSS JOIN mplan LEFT JOIN wanted ON wanted.account = cfg.account AND wanted.cycle = mplan.cycle GROUP BY 1, 2",
        "purse": """SELECT account, cycle, [CASE WHEN n > 0 THEN 1000000.0::DOUBLE / n ELSE 0 END] AS bs FROM slot_counts WHERE cycle = 0 UNION ALL
          SELECT purse.account, s.cycle, list_append(purse.bs, CASE WHEN n > 0 AND 1000000.0::DOUBLE + list_inner_product(purse.bs, c.cs) > 1e-9 * list_max(purse.bs) THEN (1000000.0::DOUBLE + list_inner_product(purse.bs, c.cs)) / n ELSE 0 END)
          FROM purse JOIN slot_counts s ON s.account = purse.account AND s.cycle = purse.cycle + 1 JOIN coef c ON c.account = s.account AND c.cycle = s.cycle""",
        "paid": "SELECT l.*, bs[-1] AS b FROM lots l JOIN purse USING (account, cycle)",
        "held": """SELECT p.*, d.ordinal, mark, omark, last_value(mark IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS now, last_value(mark IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
          FROM paid p JOIN mdays d ON d.slip = p.slip AND d.ts_code = p.ts_code AND d.ordinal BETWEEN p.eo AND p.until WINDOW w AS (PARTITION BY p.account, p.ts_code, p.cycle ORDER BY d.ordinal)""",
        "worth": """SELECT account, ordinal, sum(CASE WHEN ordinal < until THEN b * coalesce(now, bp) / bp / (1 + fee) END) AS v, sum(CASE WHEN ordinal > eo THEN b * coalesce(omark, before, bp) / bp / (1 + fee) END) AS ov,
            count(CASE WHEN ordinal < until AND mark IS NULL THEN 1 END) AS stale FROM held GROUP BY 1, 2""",
        "moves": """SELECT account, ordinal, sum(m) AS m, sum(n) AS n, sum(f) AS f, count(*) AS trades FROM (SELECT account, eo AS ordinal, -b AS m, b / (1 + fee) AS n, b - b / (1 + fee) AS f FROM paid UNION ALL
          SELECT account, so, b * g, b * sp / bp / (1 + fee), b * sp / bp / (1 + fee) * fee FROM paid WHERE so IS NOT NULL) GROUP BY 1, 2""",
        "eqd": """SELECT cfg.account, s.trade_date, s.ordinal, 1000000 + sum(coalesce(m, 0)) OVER w AS cash, 1000000 + sum(coalesce(m, 0)) OVER w + coalesce(v, 0) AS equity, coalesce(stale, 0) AS stale, coalesce(n, 0) AS n, coalesce(f, 0) AS f, coalesce(ov, 0) AS ov
          FROM cfg CROSS JOIN sessions s LEFT JOIN moves ON moves.account = cfg.account AND moves.ordinal = s.ordinal LEFT JOIN worth ON worth.account = cfg.account AND worth.ordinal = s.ordinal WHERE s.ordinal <= (SELECT m FROM fin)
          WINDOW w AS (PARTITION BY cfg.account ORDER BY s.ordinal)""",
        "turned": "SELECT *, n / (coalesce(lag(cash) OVER w, 1000000) + ov) / 2 AS turnover, least(0, equity / greatest(1000000, max(equity) OVER w) - 1) AS dd FROM eqd WINDOW w AS (PARTITION BY account ORDER BY ordinal)",
    }


def _run(t, accounts):
    bars = _nations(t)
    days, sessions = _markets(bars, t.calendar, sorted({a.slip for a in accounts}))
    scores = bars.select(*K, change("close").alias("score")).where("score IS NOT NULL")
    return B.market_accounts(days, scores, sessions, accounts)


@query("b7_account_equity", f"SELECT trade_date, {R('ln(equity)', 'log_equity')}, stale AS stale_positions FROM eqd", **_ctes(ONE))
def _(t):
    e = _run(t, ONE)["equity"]
    return rounded(e.select("trade_date", F.log("equity").alias("log_equity"), "stale_positions"))


@query(
    "b7_account_lots",
    """SELECT l.cycle, l.ts_code, e.trade_date AS entry_date, x.trade_date AS exit_date, CASE WHEN so IS NULL THEN 'STILL_HELD' ELSE 'SELL' END AS ending, CAST(until AS INTEGER) AS end_ordinal
    FROM lots l JOIN sessions e ON e.ordinal = eo JOIN sessions x ON x.ordinal = xo""",
    **_ctes(ONE),
)
def _(t):
    return _run(t, ONE)["lots"].select("cycle", "ts_code", "entry_date", "exit_date", "ending", "end_ordinal")


@query(
    "b7_account_trades",
    f"""SELECT * FROM (SELECT cycle, ts_code, 'BUY' AS action, e.trade_date, {R('ln(b / (1 + fee))', 'log_notional')}, {R('bp', 'price')} FROM paid JOIN sessions e ON e.ordinal = eo WHERE b > 0 UNION ALL
    SELECT cycle, ts_code, 'SELL', e.trade_date, {R('ln(b / (1 + fee) * sp / bp)', 'log_notional')}, {R('sp', 'price')} FROM paid JOIN sessions e ON e.ordinal = so WHERE b > 0)""",
    **_ctes(ONE),
)
def _(t):
    got = _run(t, ONE)["trades"]
    days = t.calendar.where("is_open = 1").select(F.col("cal_date").alias("trade_date"))
    sessions = B.panel_sessions(days).withColumn("ordinal", F.col("ordinal") + 1)
    out = got.join(F.broadcast(sessions), "ordinal")  # one row per session
    return rounded(out.select("cycle", "ts_code", "action", "trade_date", F.log("notional").alias("log_notional"), "price"))


_METRICS = f"""SELECT account, {R('ln(arg_max(equity, ordinal))', 'log_final', 5)}, {R('min(dd)', 'max_drawdown', 5)}, {R('coalesce(ln(nullif(sum(f), 0)), 0)', 'log_fees', 5)}, {R('ln(sum(n))', 'log_notional', 5)}, {R('sum(turnover)', 'turnover', 4)}, count(*) FILTER (stale > 0) AS stale_days,
    any_value(c.lots) AS lots, any_value(c.trades) AS n_trades, any_value(c.held) AS open_positions, any_value(c.blocked) AS blocked_sells, any_value(u.misses) AS unfilled_buys, any_value(c.blocked + u.misses) AS unfilled_orders, 'READY' AS status
    FROM turned JOIN (SELECT account, count(*) AS lots, CAST(count(*) FILTER (b > 0) + count(so) FILTER (b > 0) AS BIGINT) AS trades, count(*) - count(so) AS held, CAST(sum(greatest(0, least(until, (SELECT m + 1 FROM fin)) - xo)) AS BIGINT) AS blocked FROM paid GROUP BY 1) c USING (account)
    JOIN (SELECT account, count(*) FILTER (outcome <> 'LOT') AS misses FROM walk GROUP BY 1) u USING (account) GROUP BY account"""


def _metrics(got):
    m = B.accounts_metrics(got)
    log_fees = F.coalesce(F.log(F.nullif(F.col("total_fees"), F.lit(0.0))), F.lit(0.0))
    out = m.select(
        "account", F.log("final_equity").alias("log_final"), "max_drawdown", log_fees.alias("log_fees"), F.log("traded_notional").alias("log_notional"), F.col("summed_one_sided_turnover").alias("turnover"),
        "stale_days", "lots", "n_trades", "open_positions", "blocked_sells", "unfilled_buys", "unfilled_orders", "status",
    )
    return rounded(out, 5, turnover=4)


@query("b7_account_metrics", _METRICS, **_ctes(CHOSEN))
def _(t):
    return _metrics(_run(t, CHOSEN))


@query("b8_strategy_and_benchmark", f"SELECT * EXCLUDE account, split_part(account, '/', 1) AS scenario, split_part(account, '/', 2) AS book FROM ({_METRICS})", **_ctes(BOOKS))
def _(t):
    parts = F.split("account", "/")
    return _metrics(_run(t, BOOKS)).withColumns({"scenario": parts[0], "book": parts[1]}).drop("account")
