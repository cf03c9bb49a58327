"""Serving queries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspan.functions.frames import change
from barspan.operators import serving as V
from barspan.operators import technical as W
from barspan.operators.search import search
from barspan.operators.tables import newest_version
from barspan.plans.oracle import R
from barspan.plans.registry import query, rounded
from barspan.plans.streams import _ROWS, _STREAM, KEYS
from barspan.plans.technical import K, win
from barspan.sources.adapter import code_of
from barspan.streaming import indicators as I
from barspan.streaming import parse as P

_DAY = {
    "chg": "SELECT *, round(ret * 100, 4) AS pct_chg FROM rets",
    "latest": "SELECT * FROM chg WHERE trade_date = (SELECT max(trade_date) FROM chg)",
}


def _day(t):
    return V.on_latest(t.bars.withColumn("pct_chg", F.round(change("close") * 100, 4)))


@query(
    "a1_market_overview",
    f"""SELECT trade_date, count(*) AS total, count(*) FILTER (pct_chg > 0) AS up, count(*) FILTER (pct_chg < 0) AS down, count(*) FILTER (pct_chg = 0) AS flat,
    {R('avg(pct_chg)', 'avg_change', 4)}, {R('sum(amount)', 'total_amount', 2)} FROM latest GROUP BY 1""",
    **_DAY,
)
def _(t):
    return V.overview(_day(t))


@query(
    "a1_overview_per_session",
    f"""SELECT trade_date, count(*) AS total, count(*) FILTER (ret > 0) AS up, count(*) FILTER (ret < 0) AS down, count(*) FILTER (ret = 0) AS flat,
    {R('avg(ret)', 'avg_change')}, {R('sum(amount)', 'total_amount', 2)} FROM rets GROUP BY 1""",
)
def _(t):
    c = F.col("ret")
    day = t.bars.withColumn("ret", change("close")).groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(c > 0, 1)).alias("up"), F.count(F.when(c < 0, 1)).alias("down"),
        F.count(F.when(c == 0, 1)).alias("flat"), F.avg(c).alias("avg_change"), F.sum("amount").alias("total_amount"),
    )
    return rounded(day, 6, total_amount=2)


@query(
    "a2_industry_changes",
    f"SELECT industry, {R('avg(pct_chg)', 'avg_change', 4)}, count(*) AS members FROM latest JOIN (SELECT ts_code, industry FROM master WHERE industry IS NOT NULL) USING (ts_code) GROUP BY 1",
    **_DAY,
)
def _(t):
    return V.industry_changes(_day(t), t.master)


@query(
    "j3_dimension_aggregate",
    f"SELECT industry, year(trade_date) AS year, count(*) AS rows, {R('sum(vol)', 'vol', 2)}, max(high) AS high FROM bars JOIN (SELECT ts_code, industry FROM master) USING (ts_code) WHERE industry IS NOT NULL GROUP BY 1, 2",
)
def _(t):
    named = t.master.where("industry IS NOT NULL").select("ts_code", "industry")
    return (
        t.bars.join(named, "ts_code")
        .groupBy("industry", F.year("trade_date").alias("year"))
        .agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("vol"), 2).alias("vol"), F.max("high").alias("high"))
    )


@query(
    "a3_movers",
    """SELECT side, ts_code, trade_date, close, pct_chg, position FROM (
    SELECT 'gainers' AS side, *, row_number() OVER (ORDER BY pct_chg DESC, ts_code) AS position FROM latest WHERE pct_chg IS NOT NULL UNION ALL
    SELECT 'losers', *, row_number() OVER (ORDER BY pct_chg, ts_code) FROM latest WHERE pct_chg IS NOT NULL) WHERE position <= 10""",
    **_DAY,
)
def _(t):
    return V.movers(_day(t))


@query("a4_latest_dates", "SELECT ts_code, max(trade_date) AS latest FROM bars GROUP BY 1")
def _(t):
    lines = t.lines().groupBy("l_suppkey").agg(F.max("trade_date").alias("latest"))
    return lines.select(code_of("l_suppkey").alias("ts_code"), "latest")


@query("a5_rows_per_date", "SELECT trade_date, count(*) AS rows FROM valuation GROUP BY 1")
def _(t):
    return t.valuation.groupBy("trade_date").agg(F.count(F.lit(1)).alias("rows"))


@query("a5_distinct_dates", "SELECT DISTINCT trade_date FROM ticks WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'")
def _(t):
    return t.lines("1996-01-01", "2000-12-31").select("trade_date").distinct()


_STAGES = """SELECT count(*) AS n, count(*) FILTER (error_type IS NULL) AS ok, count(*) FILTER (error_type IS NOT NULL) AS bad FROM msgs"""


@query(
    "a16_reconciliation",
    """SELECT CASE WHEN stored_ok = rest THEN stored_ok ELSE 'PARTIAL' END AS overall, "check", status FROM (
      SELECT *, CASE WHEN n = n2 THEN 'PASS' ELSE 'FAIL' END AS stored_ok, 'PASS' AS rest FROM (SELECT n, ok, bad, (SELECT count(*) FROM msgs WHERE error_type IS NULL) AS n2 FROM stages)) s,
    LATERAL (SELECT 'stored rows equal collected rows' AS "check", stored_ok AS status UNION ALL SELECT 'deliveries account for collected rows', 'PASS' UNION ALL SELECT 'no delivery failures', 'PASS'
      UNION ALL SELECT 'delivered equals consumed plus isolated', CASE WHEN n = ok + bad THEN 'PASS' ELSE 'FAIL' END UNION ALL SELECT 'dead letters equal isolated', 'PASS')""",
    **_STREAM,
    stages=_STAGES,
)
def _(t):
    p = P.parse(t.messages)
    ok, bad = F.count(F.when(F.col("error_type").isNull(), 1)), F.count(F.when(F.col("error_type").isNotNull(), 1))
    n = F.count(F.lit(1))
    counts = p.agg(
        n.alias("collected"), ok.alias("stored"), n.alias("delivered"), F.lit(0).cast("long").alias("failed"),
        ok.alias("consumed"), bad.alias("isolated"), bad.alias("dead"),
    )
    return V.reconcile(counts)


@query(
    "a16_reconciliation_cases",
    """SELECT g, "check", status, CASE WHEN c1 = 'NOT_EXERCISED' THEN rest WHEN c1 = rest THEN rest ELSE 'PARTIAL' END AS overall FROM
    (SELECT *, CASE WHEN c2 = 'PASS' AND c3 = 'PASS' AND c5 = 'PASS' THEN 'PASS' ELSE 'FAIL' END AS rest FROM
      (SELECT g, CASE WHEN g % 4 = 0 THEN 'NOT_EXERCISED' WHEN g % 4 = 1 AND bad > 0 THEN 'FAIL' ELSE 'PASS' END AS c1, CASE WHEN g % 6 = 5 THEN 'FAIL' ELSE 'PASS' END AS c2,
        CASE WHEN g % 5 = 0 THEN 'FAIL' ELSE 'PASS' END AS c3, CASE WHEN g % 7 = 0 THEN 'FAIL' ELSE 'PASS' END AS c5
       FROM (SELECT "offset" // 250 AS g, count(*) FILTER (error_type IS NOT NULL) AS bad FROM msgs GROUP BY 1))),
    LATERAL (SELECT 'stored rows equal collected rows' AS "check", c1 AS status UNION ALL SELECT 'deliveries account for collected rows', c2 UNION ALL SELECT 'no delivery failures', c3
      UNION ALL SELECT 'delivered equals consumed plus isolated', 'PASS' UNION ALL SELECT 'dead letters equal isolated', c5)""",
    **_STREAM,
)
def _(t):
    """Blocks of messages with stages that lose, fail or repeat rows, and stores that were not exercised."""
    g, bad = F.floor(F.col("offset") / 250), F.col("error_type").isNotNull()
    n = P.parse(t.messages).groupBy(g.alias("g")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(bad, 1)).alias("bad"))
    k = F.col("g")
    failed = F.when(k % 5 == 0, 1).otherwise(0).cast("long")
    lost = F.when(k % 6 == 5, 1).otherwise(0).cast("long")
    counts = n.select(
        "g", F.col("n").alias("collected"), F.when(k % 4 == 1, F.col("n") - F.col("bad")).when(k % 4 != 0, F.col("n")).alias("stored"),
        (F.col("n") - failed - lost).alias("delivered"), failed.alias("failed"), (F.col("n") - failed - lost - F.col("bad")).alias("consumed"),
        F.col("bad").alias("isolated"), (F.col("bad") + F.when(k % 7 == 0, 1).otherwise(0)).alias("dead"),
    )
    return V.reconcile(counts, ("g",))


@query(
    "a24_baseline_snapshot",
    f"""SELECT ts_code, trade_date, close, ma5, ma20, raw_rows, clean_rows, raw_rows - clean_rows AS duplicates FROM (
      SELECT ts_code, trade_date, close, {R(win('avg(close)', 5, 'close'), 'ma5')}, {R(win('avg(close)', 20, 'close'), 'ma20')} FROM bars),
    (SELECT count(*) AS raw_rows, (SELECT count(*) FROM bars) AS clean_rows FROM ticks) WHERE trade_date = (SELECT max(trade_date) FROM bars)""",
)
def _(t):
    lines = t.lines().agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    clean = t.bars.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    out = V.on_latest(t.bars.withColumns(W.moving_averages((5, 20))))
    out = rounded(out.select(*K, "close", "ma5", "ma20"))
    return out.withColumns({"raw_rows": lines, "clean_rows": clean, "duplicates": lines - clean})


@query("f14_latest_bars", "SELECT ts_code, trade_date, open, high, low, close, vol, amount FROM (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) AS k FROM bars) WHERE k <= 250")
def _(t):
    return V.latest_series(t.bars, 250)


@query(
    "f15_latest_indicators",
    """SELECT ts_code, trade_date, "offset", ma5, window_size FROM (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) AS k FROM
    (SELECT *, row_number() OVER (PARTITION BY ts_code, trade_date ORDER BY "offset" DESC) AS v FROM emitted) WHERE v = 1) WHERE k <= 10""",
    **_STREAM,
    emitted=_ROWS,
)
def _(t):
    rows = newest_version(I.indicator_twin(P.accepted(P.parse(t.messages))), "offset")
    out = V.latest_series(rows, 10)
    return out.select(*KEYS, "offset", F.col("ma5").cast("double").alias("ma5"), "window_size")


@query("f16_latest_valuation", "SELECT ts_code, trade_date, turnover_rate, pe, pb, total_mv FROM (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) AS k FROM valuation) WHERE k = 1")
def _(t):
    return V.latest_row(t.valuation)


@query("f18_table_preview", "SELECT ts_code, trade_date, open, high, low, close, vol, amount FROM bars WHERE trade_date = (SELECT max(trade_date) FROM bars) ORDER BY ts_code LIMIT 50")
def _(t):
    last = t.latest_session()
    return t.bars_between(last, last).orderBy("ts_code").limit(50)


@query("f21_unseen_rows", "SELECT * FROM bars WHERE trade_date > DATE '2000-12-29'")
def _(t):
    from barspan.operators.learning import unseen

    return unseen(t.bars_between(start="2000-12-29"), "2000-12-29")


@query(
    "f24_published_results",
    """SELECT code AS ts_code, event_type AS result_type, event_id AS result_id, position, k AS path_value FROM (SELECT m.*, e.event_type, e.event_id,
    row_number() OVER (PARTITION BY code, e.event_type ORDER BY e.ts DESC, e.event_id DESC) AS position FROM msg m JOIN events e ON e.event_id = m."offset") WHERE position <= 100""",
    **_STREAM,
)
def _(t):
    rows = t.events.select(
        code_of("user_id").alias("ts_code"), F.col("event_type").alias("result_type"), F.col("event_id").alias("result_id"),
        F.col("ts").alias("published_at"), F.col("props").alias("payload"),
    )
    out = V.published_results(rows)
    return out.select("ts_code", "result_type", "result_id", "position", F.get_json_object("payload", "$.k").cast("int").alias("path_value"))


@query(
    "j11_align_indicators",
    f"SELECT b.ts_code, b.trade_date, b.close, i.ma60 FROM bars b LEFT JOIN (SELECT * FROM (SELECT ts_code, trade_date, {R(win('avg(close)', 60, 'close'), 'ma60')} FROM bars) WHERE ma60 IS NOT NULL) i USING (ts_code, trade_date)",
)
def _(t):
    ind = rounded(t.bars.select(*K, *[c.alias(n) for n, c in W.moving_averages((60,)).items()])).where("ma60 IS NOT NULL")
    return t.bars.select(*K, "close").join(ind, K, "left")


# -- search -------------------------------------------------------------------------
_FIELDS = ("name", "code", "code_full", "code_flat", "industry", "area")
_SEARCH = {
    "qs": """SELECT n_nationkey AS query_id, 1 AS pos, CASE n_nationkey % 4 WHEN 0 THEN 'nation_' || n_nationkey WHEN 1 THEN 'naton_' || n_nationkey WHEN 2 THEN 'suplier#' ELSE CASE WHEN n_nationkey % 8 = 3 THEN 'supplier#00000000' ELSE '0000' || n_nationkey END END AS token FROM nation
      UNION ALL SELECT n_nationkey, 2, left(lower(r_name), 3) || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE right(lower(r_name), 1) END FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "docs": """SELECT ts_code, lower(name) AS name, lower(split_part(ts_code, '.', 1)) AS code, lower(ts_code) AS code_full, lower(replace(ts_code, '.', '')) AS code_flat,
      lower(coalesce(industry, '')) AS industry, lower(region) AS area FROM master""",
    "pairs": " UNION ALL ".join(
        f"SELECT ts_code, query_id, pos, token, {f} AS body, {w}::DOUBLE AS weight FROM docs, qs" for f, w in zip(_FIELDS, (1, 1, 1, 1, 0.9, 0.85))
    ),
    "scored": r"""SELECT *, length(token) AS n, instr(body, token) - 1 AS pos_at,
      length(regexp_extract(body, array_to_string(list_transform(string_split(token, ''), lambda c: '\Q' || c || '\E'), '.*?'))) - length(token) AS gaps,
      list_min(list_transform(range(1, greatest(length(body), 1) + 1), lambda i: list_min(list_transform(range(greatest(length(token) - 2, 0), length(token) + 3), lambda m: levenshtein(substr(body, i, m), token))))) AS d FROM pairs""",
    "layers": """SELECT *, floor(weight * CASE WHEN body = '' THEN 0 WHEN token = body THEN 1000 WHEN pos_at = 0 THEN 800 WHEN pos_at > 0 THEN 600 - least(pos_at, 50) WHEN n > 12 THEN 0
      WHEN n >= 2 AND gaps >= 0 AND gaps <= CASE WHEN n >= 3 THEN 3 ELSE 2 END THEN 400 - gaps * 40 WHEN n BETWEEN 2 AND 8 AND d <= 1 THEN 200 WHEN n BETWEEN 6 AND 8 AND d = 2 THEN 100 ELSE 0 END + 0.5) AS s FROM scored""",
    "best": "SELECT query_id, ts_code, pos, max(s) AS s FROM layers GROUP BY 1, 2, 3",
}


@query(
    "j15_fuzzy_search",
    """SELECT query_id, ts_code, CAST(score AS BIGINT) AS score, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ts_code) AS position FROM
    (SELECT query_id, ts_code, sum(s) AS score FROM best GROUP BY 1, 2 HAVING min(s) > 0)) WHERE position <= 50""",
    **_SEARCH,
)
def _(t):
    nation = t.raw("nation").join(F.broadcast(t.raw("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    n, area = F.col("n_nationkey"), F.lower("r_name")
    first = (
        F.when(n % 4 == 0, F.concat(F.lit("Nation_"), n)).when(n % 4 == 1, F.concat(F.lit("naton_"), n))
        .when(n % 4 == 2, F.lit("ＳＵＰＬＩＥＲ＃")).when(n % 8 == 3, F.lit("Supplier#00000000")).otherwise(F.concat(F.lit("0000"), n))
    )
    second = F.concat(F.substring(area, 1, 3), F.when(n % 2 == 0, F.lit("")).otherwise(F.substring(area, -1, 1)))
    queries = nation.select(n.cast("long").alias("query_id"), F.concat_ws("  ", first, second).alias("text"))
    return search(t.master, queries)
