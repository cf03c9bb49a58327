"""Value rules: codes, session days, clocks, digests and decoding as queries of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspan.functions import scalars as X
from barspan.plans.oracle import R
from barspan.plans.registry import query, rounded
from barspan.plans.streams import _STREAM
from barspan.sources import sinks as K
from barspan.streaming import parse as P

_DIGITS = "lpad(CAST({0} % 1000000 * 7919 % 1000000 AS VARCHAR), 6, '0')".format("s_suppkey")


@query(
    "x1_code_normalisation",
    f"""SELECT s_suppkey, d || CASE WHEN left(d, 1) IN ('4', '8') OR left(d, 3) = '920' THEN '.BJ' WHEN left(d, 1) IN ('6', '9') THEN '.SH' ELSE '.SZ' END AS code,
    d || CASE WHEN left(d, 1) IN ('4', '8') THEN '.BJ' WHEN left(d, 1) IN ('6', '9') THEN '.SH' ELSE '.SZ' END AS code_without_920
    FROM (SELECT s_suppkey, {_DIGITS} AS d FROM supplier)""",
)
def _(t):
    raw = F.concat(F.lit(" "), F.lpad((F.col("s_suppkey") % 1_000_000 * 7919 % 1_000_000).cast("string"), 6, "0"))
    return t.raw("supplier").select("s_suppkey", X.normalize_code(raw).alias("code"), X.normalize_code(raw, bj_920=False).alias("code_without_920"))


@query(
    "x2_index_code",
    """SELECT p_partkey, d || CASE WHEN left(d, 3) = '399' THEN '.SZ' ELSE '.SH' END AS code
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '399' ELSE '000' END || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS d FROM part)""",
)
def _(t):
    k = F.col("p_partkey")
    return t.raw("part").select(k, X.index_code(F.concat(F.when(k % 2 == 0, "399").otherwise("000"), F.lpad((k % 1000).cast("string"), 3, "0"))).alias("code"))


@query(
    "x5_session_day",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1, 4) THEN CAST(o_orderdate AS DATE) END AS day, strftime(CAST(o_orderdate AS DATE), '%Y%m%d') AS compact FROM orders""",
)
def _(t):
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 5
    text = (
        F.when(k == 0, F.date_format(day, "yyyyMMdd")).when(k == 1, F.date_format(day, "yyyy-MM-dd")).when(k == 2, F.date_format(day, "yyyy/MM/dd"))
        .when(k == 3, F.date_format(day, "yyyy1399")).otherwise(F.concat(F.lit(" "), F.date_format(day, "yyyyMMdd"), F.lit(" ")))
    )
    return t.raw("orders").select("o_orderkey", X.session_day(text).alias("day"), X.compact_date(day).alias("compact"))


@query("x6_session_completed", "SELECT event_id, CAST(ts AS DATE) + INTERVAL 8 HOUR < ts AS completed FROM events")
def _(t):
    return t.events.select("event_id", X.session_completed(F.to_date("ts"), F.col("ts")).alias("completed"))


@query(
    "x7_row_digest",
    """SELECT o_orderkey, sha256('{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":' || CAST(to_json(o_orderstatus) AS VARCHAR)
    || ',"o_orderpriority":' || CAST(to_json(o_orderpriority) AS VARCHAR) || '}') AS digest FROM orders""",
)
def _(t):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    return t.raw("orders").select("o_orderkey", K.row_digest(columns).alias("digest"))


_ORDER_ROW = """'{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":' || CAST(to_json(o_orderstatus) AS VARCHAR) || '}'"""


@query(
    "x7_chained_digest",
    """SELECT 0 AS level, CAST(a AS VARCHAR) AS node, n AS rows, d AS digest FROM x7a UNION ALL SELECT 1, CAST(b AS VARCHAR), CAST(n AS BIGINT), d FROM x7b
    UNION ALL SELECT 2, '', CAST(sum(n) AS BIGINT), sha256(string_agg(d, '' ORDER BY b)) FROM x7b""",
    x7a=f"SELECT o_orderkey // 4000 AS a, o_orderkey // 4000000 AS b, count(*) AS n, sha256(string_agg(sha256({_ORDER_ROW}), '' ORDER BY o_orderkey)) AS d FROM orders GROUP BY 1, 2",
    x7b="SELECT b, sum(n) AS n, sha256(string_agg(d, '' ORDER BY a)) AS d FROM x7a GROUP BY 1",
)
def _(t):
    """Orders in shards of 4,000 keys, a thousand shards to a node, one root."""
    k = F.col("o_orderkey")
    rows = t.raw("orders").withColumns({"shard": F.floor(k / 4000), "node": F.floor(k / 4_000_000)})
    return K.chained_digests(rows, ["o_orderkey", "o_custkey", "o_orderstatus"], ["o_orderkey"], ["shard", "node"])


@query("x8_strict_decode", 'SELECT "offset", error_type IS DISTINCT FROM \'JSON_PARSE\' AS decodable FROM msgs', **_STREAM)
def _(t):
    return P.decode(t.messages).select("offset", F.col("event").isNotNull().alias("decodable"))


@query("x11_adjusted_vwap", f"SELECT ts_code, trade_date, {R('CASE WHEN vol = 0 THEN 0 ELSE amount * 10 / vol * 1.5 END', 'vwap')} FROM bars")
def _(t):
    return rounded(t.bars.select("ts_code", "trade_date", X.adjusted_vwap("amount", "vol", F.lit(1.5)).alias("vwap")))
