"""Shared CTEs for the oracle SQL. ``sql(body)`` prepends those the body names."""

from __future__ import annotations

import re


def code_sql(k: str) -> str:
    digits = (
        f"(CASE WHEN {k} >= 1000000 THEN CAST({k} // 1000000 AS VARCHAR) ELSE '' END"
        f" || lpad(CAST({k} % 1000000 * 7919 % 1000000 AS VARCHAR), 6, '0'))"
    )
    return (
        f"({digits} || CASE WHEN left({digits}, 1) IN ('4', '8') OR left({digits}, 3) = '920' THEN '.BJ'"
        f" WHEN left({digits}, 1) IN ('6', '9') THEN '.SH' ELSE '.SZ' END)"
    )


def day_sql(ts: str) -> str:
    return (
        f"CAST(CAST({ts} AS DATE) + CASE dayofweek(CAST({ts} AS DATE)) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END AS DATE)"
    )


def R(expr: str, alias: str, dp: int = 6) -> str:
    """Rounded output column without a negative zero."""
    return f"round(CAST({expr} AS DOUBLE), {dp}) + CAST(0 AS DOUBLE) AS {alias}"


_BAR_COLS = (
    "arg_min(px, tag) / 1e2 AS open, max(px) / 1e2 AS high, min(px) / 1e2 AS low, "
    "arg_max(px, tag) / 1e2 AS close, sum(l_quantity) AS vol, CAST(sum(cents) AS BIGINT) / 100 AS amount"
)

CTES: dict[str, str] = {
    "ticks": f"""SELECT *, {code_sql('l_suppkey')} AS ts_code, {day_sql('l_shipdate')} AS trade_date,
        CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) AS px,
        CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS cents,
        CAST(l_orderkey * 8 + l_linenumber AS HUGEINT) * 1000000000000
          + CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) AS tag
        FROM lineitem""",
    "geo": """SELECT s_suppkey, s_name, s_acctbal, n_name, r_name FROM supplier
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "bars": f"SELECT ts_code, trade_date, {_BAR_COLS} FROM ticks GROUP BY 1, 2",
    "nbars": f"SELECT n_name AS ts_code, trade_date, {_BAR_COLS} FROM ticks JOIN geo ON l_suppkey = s_suppkey GROUP BY 1, 2",
    "rall": f"SELECT r_name AS ts_code, trade_date, {_BAR_COLS} FROM ticks JOIN geo ON l_suppkey = s_suppkey GROUP BY 1, 2",
    "rbars": """SELECT * FROM rall WHERE trade_date IN (SELECT trade_date FROM rall GROUP BY 1
        HAVING count(*) = (SELECT count(DISTINCT ts_code) FROM rall))""",
    "master": f"""SELECT {code_sql('s_suppkey')} AS ts_code, s_name AS name,
        CASE WHEN s_acctbal % 10 >= 1 THEN n_name END AS industry, r_name AS region,
        CAST(DATE '1994-12-01' + CAST(floor(abs(s_acctbal) / 20) AS INTEGER) AS DATE) AS list_date,
        CASE WHEN s_acctbal > 9000 THEN CAST(DATE '2000-01-03' + CAST(floor(s_acctbal / 50) AS INTEGER) AS DATE) END AS delist_date
        FROM geo""",
    "calendar": """SELECT cal_date, CASE WHEN dayofweek(cal_date) IN (0, 6) THEN 0 ELSE 1 END AS is_open FROM (
        SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS cal_date
        FROM (SELECT min(trade_date) AS a, max(trade_date) AS b FROM ticks))""",
    "sessions": "SELECT cal_date AS trade_date, row_number() OVER (ORDER BY cal_date) AS ordinal FROM calendar WHERE is_open = 1",
    "valuation": """SELECT ts_code, trade_date, sum(l_quantity) / 10 AS turnover_rate,
        CASE WHEN max(l_tax) > 0 THEN min(px) / 1e2 / (1 + max(l_tax) * 100) END AS pe,
        min(px) / 1e2 / 1000 AS pb, CAST(sum(cents) AS BIGINT) / 100 * 12 AS total_mv
        FROM ticks WHERE l_linestatus = 'F' GROUP BY 1, 2""",
    "factors": "SELECT ts_code, trade_date, 1 + max(l_discount) AS adj_factor FROM ticks WHERE l_discount > 0 GROUP BY 1, 2",
    "constituents": """SELECT 'INDEX' AS group_type, r_name AS group_code, ts_code,
        CAST(date_trunc('quarter', trade_date) AS DATE) AS as_of_date, sum(l_quantity) AS weight
        FROM ticks JOIN geo ON l_suppkey = s_suppkey WHERE l_returnflag = 'A' GROUP BY ALL""",
    "suspensions": f"""SELECT ts_code, {day_sql('trade_date + 1')} AS trade_date,
        CASE WHEN l_linenumber = 7 THEN 'R' ELSE 'S' END AS suspend_type,
        CASE WHEN l_linenumber = 1 THEN '09:30-11:30' WHEN l_linenumber = 2 THEN '13:00-15:00' END AS suspend_timing
        FROM ticks WHERE l_returnflag = 'R'""",
    "panel": """SELECT b.*, v.turnover_rate, v.pe, v.pb, v.total_mv FROM bars b
        LEFT JOIN valuation v USING (ts_code, trade_date)""",
    "rets": """SELECT *, lag(close) OVER w AS pre_close, close / lag(close) OVER w - 1 AS ret,
        row_number() OVER w AS rn FROM bars WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date)""",
    "rrets": """SELECT *, lag(close) OVER w AS pre_close, close / lag(close) OVER w - 1 AS ret,
        row_number() OVER w AS rn FROM rbars WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date)""",
}


def sql(body: str, **extra: str) -> str:
    """``body`` with every named CTE (and the extra ones) it depends on in front."""
    pool = {**CTES, **extra}
    names = "|".join(map(re.escape, pool))
    order: list[str] = []

    def need(text: str, me: str = "") -> None:
        for name in dict.fromkeys(re.findall(rf"\b({names})\b(?!\s*\()", text)):
            if name != me and name not in order:
                need(pool[name], name)
                if name not in order:
                    order.append(name)

    need(body)
    if not order:
        return body
    recursive = "RECURSIVE " if any(re.search(rf"\b{n}\b", pool[n]) and "UNION ALL" in pool[n] for n in order) else ""
    return "WITH " + recursive + ",\n".join(f"{n} AS MATERIALIZED ({pool[n]})" for n in order) + "\n" + body
