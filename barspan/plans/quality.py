"""Contracts, calendars, coverage, attribution, plans and readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspan.functions import scalars as X
from barspan.operators import clean as C
from barspan.operators import market as M
from barspan.operators import quality as Q
from barspan.operators import sequence as S
from barspan.operators import tables as P
from barspan.plans.ingest import _CLEAN, _NEW, _OLD, _TWO
from barspan.plans.oracle import R, day_sql
from barspan.plans.registry import query, rounded
from barspan.plans.sequence import _LAB
from barspan.plans.technical import K
from barspan.session import cut_lineage, scratch_dir
from barspan.sources.adapter import code_of, trade_date
from barspan.sources.sinks import FeatureStore
from barspan.streaming import indicators as I


def _sessions(t):
    return Q.session_ordinals(t.calendar)


@query(
    "q1_unique_keys",
    """SELECT count(*) AS rows, count(*) FILTER (l_suppkey IS NULL OR trade_date IS NULL) AS null_keys,
    (SELECT count(*) FROM (SELECT 1 FROM ticks GROUP BY l_suppkey, trade_date HAVING count(*) > 1)) AS duplicated_keys FROM ticks""",
)
def _(t):
    return P.unique_keys(t.lines(), ("l_suppkey", "trade_date"))


@query(
    "q2_ohlcv_validity",
    """SELECT ts_code, trade_date, open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= greatest(open, low, close) AND low <= least(open, high, close) AND vol >= 0 AS valid
    FROM tagged WHERE reason IS NULL""",
    **_CLEAN,
)
def _(t):
    typed = C._typed(t.feed).where(C.first_reject().isNull())
    return typed.select(*K, X.ohlcv_valid().alias("valid"))


_DONE = "SELECT trade_date FROM sessions WHERE CAST(trade_date AS TIMESTAMP) + INTERVAL 8 HOUR < TIMESTAMP '2001-10-31 09:00:00'"


@query(
    "q3_complete_session_cutoff",
    """SELECT max(trade_date) AS target_trade_date, max(trade_date) FILTER (n = 5) AS data_cutoff,
    (SELECT CASE WHEN coalesce(n, 0) <> 5 THEN 'INCOMPLETE_DAILY' END FROM day_counts ORDER BY trade_date DESC LIMIT 1) AS fallback_reason
    FROM day_counts""",
    done=_DONE,
    day_counts="SELECT trade_date, n FROM done LEFT JOIN (SELECT trade_date, count(*) AS n FROM rall GROUP BY 1) USING (trade_date)",
)
def _(t):
    return Q.select_cutoff(t.calendar, t._grouped_bars("r_name"), "2001-10-31 09:00:00")


@query(
    "q13_calendar_gaps",
    "SELECT cal_date FROM calendar WHERE cal_date NOT IN (SELECT trade_date FROM ticks)",
)
def _(t):
    return Q.missing_days(t.lines().select(F.col("trade_date").alias("cal_date")).distinct())


@query("q13_session_list", "SELECT trade_date, ordinal FROM sessions")
def _(t):
    return _sessions(t)


@query(
    "j8_calendar_offset_join",
    f"""SELECT b.ts_code, b.trade_date, s2.trade_date AS target_date, {R('c.close / b.close - 1', 'label')} FROM bars b JOIN sessions s1 USING (trade_date)
    LEFT JOIN sessions s2 ON s2.ordinal = s1.ordinal + 5 LEFT JOIN bars c ON c.ts_code = b.ts_code AND c.trade_date = s2.trade_date""",
)
def _(t):
    rows = Q.target_session(t.bars.select(*K, "close"), _sessions(t), 5)
    later = t.bars.select("ts_code", F.col("trade_date").alias("target_date"), F.col("close").alias("c"))
    out = rows.join(later, ["ts_code", "target_date"], "left")
    return rounded(out.select(*K, "target_date", (F.col("c") / F.col("close") - 1).alias("label")))


_GRID = """SELECT ts_code, s.trade_date FROM master JOIN sessions s ON s.trade_date >= list_date AND (delist_date IS NULL OR s.trade_date < delist_date)"""
_G = {"grid": _GRID}


@query("j9_lifecycle_sessions", "SELECT ts_code, count(*) AS sessions, min(trade_date) AS first_session, max(trade_date) AS last_session FROM grid GROUP BY 1", **_G)
def _(t):
    g = Q.lifetime_grid(t.master, _sessions(t))
    return g.groupBy("ts_code").agg(
        F.count(F.lit(1)).alias("sessions"), F.min("trade_date").alias("first_session"), F.max("trade_date").alias("last_session")
    )


@query(
    "j12_expected_key_grid",
    "SELECT g.ts_code, g.trade_date, b.close IS NOT NULL AS has_bar, v.total_mv IS NOT NULL AS has_valuation FROM grid g LEFT JOIN bars b USING (ts_code, trade_date) LEFT JOIN valuation v USING (ts_code, trade_date)",
    **_G,
)
def _(t):
    g = Q.filled_grid(t.master, _sessions(t), t.expected_facts)
    return g.select(*K, F.col("close").isNotNull().alias("has_bar"), F.col("total_mv").isNotNull().alias("has_valuation"))


_RUNS = """SELECT ts_code, min(trade_date) AS start_date, max(trade_date) AS end_date, count(*) AS sessions FROM
    (SELECT ts_code, trade_date, ordinal - row_number() OVER (PARTITION BY ts_code ORDER BY ordinal) AS g FROM nbars JOIN sessions USING (trade_date)) GROUP BY ts_code, g"""


@query(
    "j7_interval_overlap",
    """SELECT r.ts_code, r.start_date AS left_start, r.end_date AS left_end, q.as_of_date AS right_start, CAST(q.as_of_date + INTERVAL 45 DAY AS DATE) AS right_end
    FROM runs r JOIN (SELECT DISTINCT as_of_date FROM constituents) q ON r.start_date <= CAST(q.as_of_date + INTERVAL 45 DAY AS DATE) AND r.end_date >= q.as_of_date""",
    runs=_RUNS,
)
def _(t):
    runs = M.session_runs(t.nation_bars.select(*K), _sessions(t))
    left = runs.select("ts_code", F.col("start_date").alias("left_start"), F.col("end_date").alias("left_end"))
    quarters = t.constituents.select(F.col("as_of_date").alias("right_start")).distinct()
    return Q.overlaps(left, quarters.withColumn("right_end", F.date_add("right_start", 45)))


@query(
    "j7_overlap_by_instrument",
    """SELECT l.ts_code, l.a AS left_start, l.b AS left_end, r.a AS right_start, r.b AS right_end FROM life l JOIN spells r ON r.ts_code = l.ts_code AND l.a <= r.b AND l.b >= r.a""",
    life="SELECT ts_code, list_date AS a, coalesce(delist_date, DATE '2100-01-01') AS b FROM master",
    spells="SELECT ts_code, trade_date AS a, CAST(trade_date + 3 AS DATE) AS b FROM (SELECT DISTINCT ts_code, trade_date FROM suspensions)",
)
def _(t):
    """Halt spells of four days against the instrument's life, which may span a century."""
    end = F.coalesce("delist_date", F.lit("2100-01-01").cast("date"))
    life = t.master.select("ts_code", F.col("list_date").alias("left_start"), end.alias("left_end"))
    spells = t.suspensions.select("ts_code", F.col("trade_date").alias("right_start")).distinct()
    return Q.overlaps(life, spells.withColumn("right_end", F.date_add("right_start", 3)), on=["ts_code"])


# -- attribution --------------------------------------------------------------------
_HALT = {
    "kinds": "SELECT DISTINCT * FROM suspensions",
    "halts": """SELECT ts_code, trade_date, bool_and(suspend_type = 'S' AND suspend_timing IS NULL) AS full_day,
      bool_or(suspend_type = 'S') AND bool_and(suspend_type <> 'S' OR suspend_timing IS NOT NULL)
        AND NOT (bool_or(suspend_timing = '09:30-11:30' AND suspend_type = 'S') IS TRUE AND bool_or(suspend_timing = '13:00-15:00' AND suspend_type = 'S') IS TRUE) AS intraday_only,
      bool_or(suspend_type = 'S') AND bool_or(suspend_type = 'R') AS mixed FROM kinds GROUP BY 1, 2""",
}
_STATUS = {
    **_TWO,
    **_HALT,
    "origins": """SELECT ts_code, trade_date, CASE WHEN a.close IS NULL THEN 'DATABASE_ROW' WHEN s.close IS NULL THEN 'PROVIDER_ROW'
      WHEN a.close = s.close AND a.vol = s.vol THEN 'PROVIDER_VERIFIED_EXISTING' ELSE 'SOURCE_CONFLICT' END AS origin
      FROM stored s FULL JOIN arriving a USING (ts_code, trade_date)""",
    "attr0": """SELECT m.ts_code, s.trade_date, s.trade_date < list_date AS early, origin, coalesce(full_day, false) AS full_day, coalesce(mixed, false) AS mixed,
      coalesce(intraday_only, false) AND coalesce(origin IN ('PROVIDER_ROW', 'PROVIDER_VERIFIED_EXISTING'), false) AS confirmed, v.total_mv IS NOT NULL AS basic, pe, f.adj_factor IS NOT NULL AS factor
      FROM master m CROSS JOIN sessions s LEFT JOIN origins o ON o.ts_code = m.ts_code AND o.trade_date = s.trade_date
      LEFT JOIN halts h ON h.ts_code = m.ts_code AND h.trade_date = s.trade_date
      LEFT JOIN valuation v ON v.ts_code = m.ts_code AND v.trade_date = s.trade_date LEFT JOIN factors f ON f.ts_code = m.ts_code AND f.trade_date = s.trade_date""",
    "attr": """SELECT ts_code, trade_date, CASE WHEN early THEN 'PRE_LISTING' WHEN (mixed AND NOT confirmed) OR (full_day AND origin IS NOT NULL) THEN 'SOURCE_CONFLICT'
      WHEN origin IS NOT NULL THEN origin WHEN full_day THEN 'FULL_DAY_SUSPENSION' ELSE 'UNRESOLVED_MISSING' END AS daily_status,
      CASE WHEN basic THEN 'DATABASE_ROW' WHEN early THEN 'PRE_LISTING' ELSE 'MISSING_BASIC_ROW' END AS basic_status,
      CASE WHEN early THEN 'PRE_LISTING' WHEN factor THEN 'PROVIDER_ROW' ELSE 'MISSING_FACTOR' END AS factor_status,
      CASE WHEN NOT basic THEN 'NO_ROW' WHEN pe IS NOT NULL THEN 'VALUE' ELSE 'DATABASE_NULL_UNVERIFIED' END AS pe_status FROM attr0""",
    "inventory": """SELECT unnest(list_filter([CASE WHEN daily_status = 'UNRESOLVED_MISSING' THEN 'daily' END, CASE WHEN daily_status = 'UNRESOLVED_MISSING' THEN 'suspend_d' END,
      CASE WHEN basic_status = 'MISSING_BASIC_ROW' AND daily_status NOT IN ('PRE_LISTING', 'FULL_DAY_SUSPENSION', 'UNRESOLVED_MISSING', 'SOURCE_CONFLICT') THEN 'daily_basic' END,
      CASE WHEN factor_status = 'MISSING_FACTOR' THEN 'adj_factor' END], lambda x: x IS NOT NULL)) AS method, ts_code, trade_date FROM attr""",
}


def _status(t):
    facts = cut_lineage(t.source_facts, "facts")  # one aggregation for the calendar, the halts and the grid, which take different columns
    return Q.attribute_facts(t.master, Q.session_ordinals(t.calendar_of(facts)), facts, t.halts_of(facts))


@query("x9_halt_days", "SELECT * FROM halts", **_HALT)
def _(t):
    return Q.halt_days(t.suspensions)


@query("q5_source_attribution", "SELECT * FROM attr", **_STATUS)
def _(t):
    return _status(t)


@query(
    "q5_valuation_attribution",
    """SELECT ts_code, trade_date, basic_status, CASE WHEN spx IS NULL AND ppx IS NULL THEN 'NO_ROW' WHEN basic_status = 'SOURCE_CONFLICT' THEN 'SOURCE_CONFLICT'
      WHEN CASE WHEN spx IS NOT NULL THEN st ELSE pt END > 0 THEN 'VALUE' WHEN basic_status IN ('PROVIDER_ROW', 'PROVIDER_VERIFIED_EXISTING') THEN 'PROVIDER_NULL' ELSE 'DATABASE_NULL_UNVERIFIED' END AS pe_status
    FROM (SELECT *, CASE WHEN spx IS NOT NULL AND ppx IS NULL THEN 'DATABASE_ROW' WHEN ppx IS NOT NULL AND spx IS NULL THEN 'PROVIDER_ROW'
        WHEN spx = ppx AND (CASE WHEN st > 0 THEN st END) IS NOT DISTINCT FROM (CASE WHEN pt > 0 THEN pt END) THEN 'PROVIDER_VERIFIED_EXISTING' WHEN spx IS NOT NULL THEN 'SOURCE_CONFLICT'
        WHEN trade_date < list_date THEN 'PRE_LISTING' ELSE 'MISSING_BASIC_ROW' END AS basic_status
      FROM (SELECT m.ts_code, s.trade_date, list_date FROM master m CROSS JOIN sessions s) LEFT JOIN vals USING (ts_code, trade_date))""",
    vals="""SELECT ts_code, trade_date, min(px) FILTER (l_returnflag IN ('A', 'N')) AS spx, max(l_tax) FILTER (l_returnflag IN ('A', 'N')) AS st,
      min(px) FILTER (l_returnflag IN ('N', 'R')) AS ppx, max(l_tax) FILTER (l_returnflag IN ('N', 'R')) AS pt FROM ticks WHERE l_linestatus = 'F' GROUP BY 1, 2""",
)
def _(t):
    return Q.attribute_valuation(t.master, _sessions(t), t.valuation_facts)


@query("a14_status_counts", "SELECT daily_status, basic_status, factor_status, pe_status, count(*) AS keys FROM attr GROUP BY ALL", **_STATUS)
def _(t):
    cols = ["daily_status", "basic_status", "factor_status", "pe_status"]
    return _status(t).groupBy(*cols).agg(F.count(F.lit(1)).alias("keys"))


@query("q6_missing_inventory", "SELECT * FROM inventory", **_STATUS)
def _(t):
    return Q.missing_inventory(_status(t))


@query(
    "q23_request_lists",
    """SELECT trade_date, method, 0 AS chunk, count(*) AS codes, string_agg(ts_code, ',' ORDER BY ts_code) AS code_list FROM inventory GROUP BY 1, 2""",
    **_STATUS,
)
def _(t):
    return Q.request_lists(Q.missing_inventory(_status(t)))


@query(
    "q7_gap_plan",
    """SELECT 'full_date' AS mode, CAST(NULL AS VARCHAR) AS ts_code, trade_date AS start_date, trade_date AS end_date, keys FROM whole UNION ALL
    SELECT 'stock_range', ts_code, min(trade_date), max(trade_date), count(*) FROM
    (SELECT a.ts_code, a.trade_date, ordinal - row_number() OVER (PARTITION BY a.ts_code ORDER BY ordinal) AS g FROM absent a JOIN sessions USING (trade_date) WHERE trade_date NOT IN (SELECT trade_date FROM whole))
    GROUP BY ts_code, g, year(trade_date)""",
    **_G,
    absent="SELECT * FROM grid WHERE (ts_code, trade_date) NOT IN (SELECT (ts_code, trade_date) FROM valuation)",
    whole="""SELECT trade_date, count(*) AS keys FROM absent WHERE trade_date NOT IN (SELECT trade_date FROM valuation WHERE (ts_code, trade_date) IN (SELECT (ts_code, trade_date) FROM grid))
      GROUP BY 1 HAVING count(*) < 6000""",
)
def _(t):
    return Q.gap_plan(Q.lifetime_grid(t.master, _sessions(t)), t.valuation, _sessions(t))


_REQUESTS = """SELECT 'stock_range' AS mode, ts_code, min(trade_date) AS start_date, max(trade_date) AS end_date, count(*) AS keys FROM
    (SELECT a.ts_code, a.trade_date, ordinal - row_number() OVER (PARTITION BY a.ts_code ORDER BY ordinal) AS g FROM absent a JOIN sessions USING (trade_date) WHERE trade_date NOT IN (SELECT trade_date FROM whole))
    GROUP BY ts_code, g, year(trade_date)"""
_DAILY = {
    **_G,
    **_HALT,
    "absent": "SELECT * FROM grid WHERE (ts_code, trade_date) NOT IN (SELECT (ts_code, trade_date) FROM bars) AND (ts_code, trade_date) NOT IN (SELECT (ts_code, trade_date) FROM halts WHERE full_day)",
    "whole": """SELECT trade_date, count(*) AS keys FROM absent WHERE trade_date NOT IN (SELECT trade_date FROM bars WHERE (ts_code, trade_date) IN (SELECT (ts_code, trade_date) FROM grid))
      GROUP BY 1 HAVING count(*) < 6000""",
}


@query(
    "q7_daily_gap_plan",
    f"SELECT 'full_date' AS mode, CAST(NULL AS VARCHAR) AS ts_code, trade_date AS start_date, trade_date AS end_date, keys FROM whole UNION ALL {_REQUESTS}",
    **_DAILY,
)
def _(t):
    """Gaps of the bars themselves; days of a proven halt are not asked for."""
    full = Q.halt_days(t.suspensions).where("full_day")
    return Q.gap_plan(Q.lifetime_grid(t.master, _sessions(t)), t.bars.select(*K), _sessions(t), full)


@query(
    "q7_registered_pool_plan",
    _REQUESTS,
    **{
        **_DAILY,
        "pool": "SELECT g.ts_code, g.trade_date FROM grid g JOIN (SELECT ts_code AS c FROM master WHERE region = 'ASIA') ON c = g.ts_code",
        "absent": _DAILY["absent"].replace("FROM grid WHERE", "FROM pool WHERE"),
        "whole": "SELECT trade_date FROM sessions WHERE ordinal < 0",
    },
)
def _(t):
    """The same for a registered pool: ranges only, even on days on which nothing is stored."""
    full = Q.halt_days(t.suspensions).where("full_day")
    grid = Q.lifetime_grid(t.master.where("region = 'ASIA'"), _sessions(t))
    return Q.gap_plan(grid, t.bars.select(*K), _sessions(t), full, registered_pool=True)


@query(
    "q9_pool_coverage",
    """SELECT ts_code, count(*) FILTER (e) AS eligible_sessions, count(*) FILTER (e AND b) AS daily_rows, count(*) FILTER (e AND b AND v) AS daily_basic_rows,
    count(*) FILTER (e AND NOT b AND NOT h) AS unresolved_no_quote, count(*) FILTER (e AND NOT b AND h) AS verified_no_quote, count(*) FILTER (b AND NOT e) AS out_of_period_rows,
    min(trade_date) FILTER (e AND b) AS stored_first, max(trade_date) FILTER (e AND b) AS stored_last,
    CASE WHEN count(*) FILTER (e) = 0 THEN 'NO_APPLICABLE_SESSIONS' WHEN count(*) FILTER (e AND NOT b AND NOT h) > 0 OR count(*) FILTER (e AND b AND NOT v) > 0 OR count(*) FILTER (b AND NOT e) > 0
      THEN 'NEEDS_CHECK' ELSE 'ROW_COVERED' END AS status,
    coalesce(array_to_string(list_slice(list(CAST(trade_date AS VARCHAR) ORDER BY trade_date) FILTER (e AND NOT b AND NOT h), 1, 5), ','), '') AS gap_sample
    FROM (SELECT ts_code, trade_date, g.x IS NOT NULL AS e, b.x IS NOT NULL AS b, v.x IS NOT NULL AS v, h.x IS NOT NULL AS h FROM
      (SELECT *, 1 AS x FROM grid) g FULL JOIN (SELECT ts_code, trade_date, 1 AS x FROM bars) b USING (ts_code, trade_date)
      LEFT JOIN (SELECT ts_code, trade_date, 1 AS x FROM valuation) v USING (ts_code, trade_date)
      LEFT JOIN (SELECT ts_code, trade_date, 1 AS x FROM halts WHERE full_day) h USING (ts_code, trade_date)) GROUP BY 1""",
    **_G,
    **_HALT,
)
def _(t):
    full = Q.halt_days(t.suspensions).where("full_day")
    return Q.pool_coverage(t.master, _sessions(t), t.bars, t.valuation, full)


@query(
    "q10_sample_qualification",
    """SELECT ts_code, trade_date, target_date, reason, CASE WHEN reason IS NULL THEN round(tc / close - 1, 6) END AS label FROM (
      SELECT *, CASE WHEN trade_date < list_date THEN 'PRE_LISTING' WHEN trade_date >= delist_date THEN 'POST_DELISTING' WHEN close IS NULL AND halted THEN 'SUSPENDED'
        WHEN close IS NULL THEN 'UNEXPLAINED_QUOTE_GAP' WHEN age < 120 THEN 'WARMUP' WHEN target_date IS NULL OR target_date > DATE '2001-06-29' THEN 'UNMATURED_LABEL'
        WHEN target_date < list_date OR target_date >= delist_date THEN 'TARGET_INACTIVE' WHEN tc IS NULL THEN 'TARGET_SUSPENDED' END AS reason FROM (
      SELECT m.ts_code, s.trade_date, s2.trade_date AS target_date, list_date, delist_date, b.close, age, c.close AS tc, h.full_day IS NOT NULL AS halted
      FROM master m CROSS JOIN sessions s LEFT JOIN sessions s2 ON s2.ordinal = s.ordinal + 5
      LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) - 1 AS age FROM bars) b ON b.ts_code = m.ts_code AND b.trade_date = s.trade_date
      LEFT JOIN bars c ON c.ts_code = m.ts_code AND c.trade_date = s2.trade_date
      LEFT JOIN (SELECT * FROM halts WHERE full_day) h ON h.ts_code = m.ts_code AND h.trade_date = s.trade_date WHERE s.trade_date <= DATE '2001-06-29'))""",
    **_HALT,
)
def _(t):
    full = Q.halt_days(t.suspensions).where("full_day")
    return rounded(Q.qualify_samples(t.master, _sessions(t), t.bars, full, "2001-06-29"))


@query(
    "q11_readiness",
    """SELECT ts_code, profile, expected, observed, potential AS potential_samples, CASE WHEN issues = '' THEN potential ELSE 0 END AS mature_samples,
    array_to_string(list_sort(list_filter([m1, m2, m3, CASE WHEN (CASE WHEN issues = '' THEN potential ELSE 0 END) < mature THEN 'INSUFFICIENT_WARMUP_HISTORY' END], lambda x: x IS NOT NULL)), ',') AS reasons,
    issues = '' AND potential >= mature AS data_ready FROM (
      SELECT *, greatest(observed - warmup - sequence + 2 - horizon, 0) AS potential, concat(m1, m2, m3) AS issues FROM (
      SELECT *, CASE WHEN observed < expected THEN 'MISSING_SESSIONS' END AS m1, CASE WHEN nv AND no_valuation > 0 THEN 'MISSING_REQUIRED_FIELDS' END AS m2,
        CASE WHEN nf AND no_factor > 0 THEN 'MISSING_FACTORS' END AS m3 FROM
      (SELECT g.ts_code, count(*) AS expected, count(b.close) AS observed, count(*) FILTER (b.close IS NOT NULL AND v.total_mv IS NULL) AS no_valuation, count(*) FILTER (f.adj_factor IS NULL) AS no_factor
        FROM life g LEFT JOIN bars b USING (ts_code, trade_date) LEFT JOIN valuation v USING (ts_code, trade_date) LEFT JOIN factors f USING (ts_code, trade_date) GROUP BY 1),
      (VALUES ('single', 60, 1, 60, 1, false, false), ('ranking', 120, 1, 365, 5, true, false), ('sequence', 253, 60, 60, 5, false, true)) p(profile, warmup, sequence, mature, horizon, nv, nf)))""",
    life="SELECT ts_code, s.trade_date FROM master JOIN sessions s ON s.trade_date >= list_date",
)
def _(t):
    return Q.readiness(t.master, _sessions(t), t.bars, t.valuation, t.factors)


@query(
    "q12_execution_readiness",
    """SELECT 'adj_factor' AS kind, ts_code, trade_date FROM bars WHERE (ts_code, trade_date) NOT IN (SELECT (ts_code, trade_date) FROM factors) UNION ALL
    SELECT 'stk_limit', ts_code, trade_date FROM rets WHERE pre_close IS NULL""",
)
def _(t):
    from barspan.plans.backtests import price_limits

    return Q.execution_gaps(t.bars, t.factors, price_limits(t.bars).where("up_limit IS NOT NULL"))


@query(
    "q14_prefix_immutability",
    """SELECT CASE WHEN a.close IS NULL THEN 'ONLY_OLD' WHEN s.close IS NULL THEN 'ONLY_NEW' WHEN a.close = s.close THEN 'EQUAL' ELSE 'CONFLICT' END AS status, count(*) AS keys
    FROM (SELECT * FROM stored WHERE trade_date <= DATE '1999-12-31') s FULL JOIN (SELECT * FROM bars WHERE trade_date <= DATE '1999-12-31') a USING (ts_code, trade_date) GROUP BY 1""",
    **_TWO,
)
def _(t):
    frozen = t.bars_where(_OLD, end="1999-12-31")
    current = t.bars_between(end="1999-12-31")
    return P.diff(frozen, current, ["close"]).groupBy("status").agg(F.count(F.lit(1)).alias("keys"))


@query("q15_published_build", "SELECT ts_code, trade_date, close, vol FROM bars")
def _(t):
    store = FeatureStore(t.spark, scratch_dir(t.spark, "store"))
    first = t.bars_where(_OLD).select(*K, "close", "vol")
    store.write(first, "b1")
    store.publish(first, "b1")
    second = t.bars.select(*K, "close", "vol")
    store.write(second, "b2")
    store.publish(second, "b2")
    return store.read(second.schema)[0]


@query("q16_verified_read", "SELECT ts_code, trade_date, vol FROM bars WHERE (ts_code, trade_date) IN (SELECT (ts_code, trade_date) FROM factors)")
def _(t):
    store = FeatureStore(t.spark, scratch_dir(t.spark, "store"))
    rows = t.bars.select(*K, "vol")
    store.write(rows, "b1")
    store.publish(rows, "b1")
    return store.read(rows.schema, t.factors)[0]


@query(
    "q17_incremental_append",
    """SELECT ts_code, trade_date, CASE WHEN n >= 20 THEN round(c20 / 20, 6) END AS ma20 FROM (SELECT *, row_number() OVER w AS n,
    CAST(sum(CAST(close AS DECIMAL(24,6))) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS 19 PRECEDING) AS DOUBLE) AS c20 FROM bars WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date))
    WHERE trade_date > DATE '2000-06-30'""",
)
def _(t):
    full = I.indicator_values(t.bars.select(*K, "close", F.col("vol").alias("volume")))
    return Q.append_after(full, "2000-06-30").select(*K, F.col("ma20").cast("double").alias("ma20"))


@query(
    "q18_retry_ledger",
    """SELECT o_orderpriority AS source, count(*) AS tasks, count(*) FILTER (o_orderstatus = 'F') AS already_done,
    count(*) FILTER (o_orderstatus <> 'F' AND o_custkey % 7 < 5) AS to_retry, count(*) FILTER (o_orderstatus <> 'F' AND o_custkey % 7 >= 5) AS skipped_max_retry FROM orders GROUP BY 1""",
)
def _(t):
    tasks = t.raw("orders").select(
        F.col("o_orderpriority").alias("source"),
        F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("PARTIAL_SUCCESS").alias("status"),
        (F.col("o_custkey") % 7).alias("retry_count"),
    )
    return Q.retry_ledger(tasks)


@query(
    "q19_market_roster",
    r"""SELECT ts_code, list_date, delist_date FROM master WHERE regexp_full_match(ts_code, '6[08][0-9]{4,}\.SH|(0[0-9]|30)[0-9]{4,}\.SZ')
    AND list_date <= DATE '2000-06-30' AND (delist_date IS NULL OR delist_date > DATE '2000-06-30')""",
)
def _(t):
    day = F.lit("2000-06-30").cast("date")
    alive = (F.col("list_date") <= day) & (F.col("delist_date").isNull() | (F.col("delist_date") > day))
    return t.master.where(X.is_a_share("ts_code") & alive).select("ts_code", "list_date", "delist_date")


@query(
    "q20_publication_class",
    f"""SELECT o_orderkey, o.d AS trade_date, s2.trade_date AS entry_date, CASE WHEN published < CAST(s2.trade_date AS TIMESTAMP) + INTERVAL 1 HOUR THEN 'PROSPECTIVE_CANDIDATE' ELSE 'LATE_DIAGNOSTIC' END AS status
    FROM (SELECT o_orderkey, {day_sql('o_orderdate')} AS d, CAST({day_sql('o_orderdate')} AS TIMESTAMP) + INTERVAL 8 HOUR + to_hours(o_custkey % 36) AS published FROM orders) o
    JOIN sessions s1 ON s1.trade_date = o.d JOIN sessions s2 ON s2.ordinal = s1.ordinal + 1""",
)
def _(t):
    day = trade_date("o_orderdate")
    hours = F.lit(8) + F.col("o_custkey") % 36
    signals = t.raw("orders").select(
        "o_orderkey", day.alias("trade_date"), F.timestamp_add("HOUR", hours.cast("int"), day.cast("timestamp")).alias("published_at")
    )
    return Q.publication_class(signals, _sessions(t)).select("o_orderkey", "trade_date", "entry_date", "status")


_NEWEST = "SELECT * FROM constituents WHERE (group_code, as_of_date) IN (SELECT (group_code, max(as_of_date)) FROM constituents GROUP BY group_code)"


@query(
    "q21_frozen_universe",
    "SELECT group_code, ts_code, as_of_date, weight, row_number() OVER (PARTITION BY group_code ORDER BY ts_code) - 1 AS member_id FROM newest",
    newest=_NEWEST,
)
def _(t):
    return Q.frozen_universe(t.constituents).select("group_code", "ts_code", "as_of_date", "weight", "member_id")


@query(
    "q22_continuity",
    """SELECT ts_code, count(*) AS stored, count(*) FILTER (ordinal IS NULL) AS off_calendar, max(ordinal) - min(ordinal) + 1 AS expected,
    count(*) = max(ordinal) - min(ordinal) + 1 AS continuous, count(*) BETWEEN 300 AND 2500 AS enough FROM nbars LEFT JOIN sessions USING (trade_date) GROUP BY 1""",
)
def _(t):
    return Q.continuity(t.nation_bars, _sessions(t))


@query(
    "q24_evidence_merge",
    """SELECT ts_code, trade_date, count(*) AS copies, CASE WHEN min(l_discount) = max(l_discount) THEN min(l_discount) END AS l_discount,
    CASE WHEN min(l_discount) = max(l_discount) THEN 'MERGED' ELSE 'CONFLICT' END AS status FROM ticks GROUP BY 1, 2""",
)
def _(t):
    return Q.merge_evidence(t.lines().withColumn("ts_code", code_of("l_suppkey")), "l_discount")


@query(
    "q25_full_halt_days",
    """SELECT ts_code, trade_date FROM halts WHERE full_day AND (ts_code, trade_date) IN (SELECT (ts_code, trade_date) FROM grid)
    UNION SELECT ts_code, trade_date FROM valuation WHERE pe IS NULL""",
    **_G,
    **_HALT,
)
def _(t):
    queried = Q.lifetime_grid(t.master, _sessions(t))
    return Q.full_halt_days(t.suspensions, queried, t.valuation.where("pe IS NULL"))


@query(
    "q27_evidence_requests",
    """SELECT trade_date, count(*) AS codes, CASE WHEN count(*) < 100 THEN string_agg(ts_code, ',' ORDER BY ts_code) END AS code_list, CASE WHEN count(*) >= 100 THEN 'market' ELSE 'codes' END AS mode
    FROM bars WHERE (ts_code, trade_date) NOT IN (SELECT (ts_code, trade_date) FROM factors) GROUP BY 1""",
)
def _(t):
    return Q.evidence_requests(t.bars, t.factors)


@query("q28_year_segments", "SELECT ts_code, year(trade_date) AS year, min(trade_date) AS first_date, max(trade_date) AS last_date, count(*) AS sessions FROM bars GROUP BY 1, 2")
def _(t):
    return Q.year_segments(t.bars)


@query(
    "q29_coverage_from_ranges",
    "SELECT trade_date, coalesce(n, 0) AS eligible FROM sessions LEFT JOIN (SELECT trade_date, count(*) AS n FROM bars GROUP BY 1) USING (trade_date)",
)
def _(t):
    runs = M.session_runs(t.bars.select(*K), _sessions(t))
    return Q.eligible_counts_from_ranges(runs, _sessions(t))


@query(
    "q30_pool_catalogue",
    r"""SELECT 'industry' AS kind, industry AS code, count(*) AS members, CAST(NULL AS DATE) AS snapshot FROM master
    WHERE industry IS NOT NULL AND regexp_full_match(ts_code, '6[08][0-9]{4,}\.SH|(0[0-9]|30)[0-9]{4,}\.SZ') GROUP BY 2
    UNION ALL SELECT 'index', group_code, count(*), max(as_of_date) FROM newest GROUP BY 2""",
    newest=_NEWEST,
)
def _(t):
    shares = t.master.where(X.is_a_share("ts_code") & F.col("industry").isNotNull())
    a = shares.groupBy(F.lit("industry").alias("kind"), F.col("industry").alias("code")).agg(
        F.count(F.lit(1)).alias("members"), F.lit(None).cast("date").alias("snapshot")
    )
    b = P.latest_snapshot(t.constituents).groupBy(F.lit("index").alias("kind"), F.col("group_code").alias("code")).agg(
        F.count(F.lit(1)).alias("members"), F.max("as_of_date").alias("snapshot")
    )
    return a.unionByName(b)


_STORED_LAB = _LAB.replace("FROM rets", "FROM (SELECT *, lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date) AS pre_close, 0 AS ret, 0 AS rn FROM stored)")


@query(
    "q31_label_audit",
    """SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS compared,
    count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL AND NOT coalesce(abs(b.label - a.label) <= 1e-12 + 1e-9 * abs(b.label) OR (a.label IS NULL AND b.label IS NULL), false)) AS label_mismatches,
    count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL AND a.label_target_date IS DISTINCT FROM b.label_target_date) AS target_mismatches,
    count(*) FILTER (a.k IS NULL OR b.k IS NULL) AS unmatched
    FROM (SELECT *, 1 AS k FROM slab) a FULL JOIN (SELECT *, 1 AS k FROM lab) b USING (ts_code, trade_date)""",
    **_TWO,
    lab=_LAB,
    slab=_STORED_LAB,
)
def _(t):
    return Q.label_audit(S.open_to_open_label(t.bars_where(_OLD)), S.open_to_open_label(t.bars))
