"""Reads, merges, cleaning and joins of keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspan.functions import scalars as X
from barspan.functions.frames import change, previous
from barspan.operators import clean as C
from barspan.operators import tables as P
from barspan.plans.oracle import R
from barspan.plans.registry import query, rounded
from barspan.sources import events as E

BAR = ["open", "high", "low", "close", "vol", "amount"]


# -- reads ------------------------------------------------------------------------
@query("s1_read_panel", "SELECT * FROM panel")
def _(t):
    return P.daily_panel(t.bars, t.valuation)


@query(
    "s2_read_instrument_histories",
    "SELECT *, count(*) OVER (PARTITION BY ts_code) AS history_rows, count(*) OVER (PARTITION BY ts_code) <= 2500 AS within_limit FROM panel",
)
def _(t):
    return P.market_history(P.daily_panel(t.bars, t.valuation))


@query("s3_bars_with_names", "SELECT bars.*, name FROM bars LEFT JOIN master USING (ts_code)")
def _(t):
    return P.with_names(t.bars, t.master)


@query(
    "s4_latest_group_snapshot",
    """SELECT c.* FROM constituents c JOIN (SELECT group_type, group_code, max(as_of_date) AS as_of_date
    FROM constituents GROUP BY 1, 2) USING (group_type, group_code, as_of_date)""",
)
def _(t):
    return P.latest_snapshot(t.constituents)


@query("s5_master_table", "SELECT * FROM master")
def _(t):
    return t.master


@query(
    "s6_replay_messages",
    """SELECT 'stock-daily' AS topic, ts_code AS key, 'DATABASE:' || ts_code || ':' || strftime(trade_date, '%Y%m%d') AS event_id,
    strftime(trade_date, '%Y-%m-%d') AS trade_date, close, vol AS volume, 1 AS schema_version FROM bars""",
)
def _(t):
    m = E.replay(t.bars, "stock-daily", source="database", trace="replay", ingest_time="2024-01-01 00:00:00")
    j = F.from_json("value", E.EVENT_SCHEMA)
    return m.withColumn("j", j).select(
        "topic",
        "key",
        F.col("j.eventId").alias("event_id"),
        F.col("j.tradeDate").cast("string").alias("trade_date"),
        F.col("j.close").cast("double").alias("close"),
        F.col("j.volume").cast("double").alias("volume"),
        F.col("j.schemaVersion").alias("schema_version"),
    )


@query(
    "s7_three_way_source",
    """SELECT p.*, name, industry, CASE WHEN name IS NULL THEN 'MISSING_MASTER' WHEN total_mv IS NULL THEN 'MISSING_VALUATION'
    ELSE 'OK' END AS source_status FROM panel p LEFT JOIN (SELECT ts_code, name, industry FROM master) m USING (ts_code)""",
)
def _(t):
    return P.source_join(t.bars, t.valuation, t.master)


# -- merge policies -----------------------------------------------------------------
_OLD, _NEW = "l_returnflag IN ('A', 'N')", "l_returnflag = 'R'"
_BARS_OF = (
    "SELECT ts_code, trade_date, arg_min(px, tag) / 1e2 AS open, max(px) / 1e2 AS high, min(px) / 1e2 AS low,"
    " arg_max(px, tag) / 1e2 AS close, sum(l_quantity) AS vol, CAST(sum(cents) AS BIGINT) / 100 AS amount FROM ticks WHERE {} GROUP BY 1, 2"
)
_TWO = {"stored": _BARS_OF.format(_OLD), "arriving": _BARS_OF.format(_NEW)}
# two deliveries in one batch: many keys come in both, with different values
_AGAIN = "l_linenumber <= 2"
_BATCH = {
    **_TWO,
    "batch": f"SELECT *, 1 AS delivery FROM arriving UNION ALL SELECT *, 2 AS delivery FROM ({_BARS_OF.format(_AGAIN)})",
    "of_key": """SELECT *, row_number() OVER (PARTITION BY ts_code, trade_date ORDER BY delivery) AS nth,
      row_number() OVER (PARTITION BY ts_code, trade_date ORDER BY delivery DESC) AS from_last FROM batch""",
    "first_rows": "SELECT * EXCLUDE (delivery, nth, from_last) FROM of_key WHERE nth = 1",
    "last_rows": "SELECT * EXCLUDE (delivery, nth, from_last) FROM of_key WHERE from_last = 1",
}


def _deliveries(t):
    return t.bars_where(_NEW).withColumn("delivery", F.lit(1)).unionByName(t.bars_where(_AGAIN).withColumn("delivery", F.lit(2)))


@query(
    "s10_insert_ignore",
    "SELECT * FROM stored UNION ALL SELECT * FROM first_rows WHERE (ts_code, trade_date) NOT IN (SELECT (ts_code, trade_date) FROM stored)",
    **_BATCH,
)
def _(t):
    return P.insert_ignore(t.bars_where(_OLD), _deliveries(t), ["delivery"])


@query(
    "s11_upsert",
    "SELECT * FROM last_rows UNION ALL SELECT * FROM stored WHERE (ts_code, trade_date) NOT IN (SELECT (ts_code, trade_date) FROM last_rows)",
    **_BATCH,
)
def _(t):
    return P.upsert(t.bars_where(_OLD), _deliveries(t), ["delivery"])


@query(
    "s12_replace_snapshot",
    """SELECT * FROM constituents WHERE (group_code, as_of_date) NOT IN (SELECT (group_code, as_of_date) FROM fresh)
    UNION ALL SELECT * FROM fresh""",
    fresh="""SELECT group_type, group_code, ts_code, CAST(as_of_date AS DATE) AS as_of_date, weight * 2 AS weight
    FROM constituents WHERE month(as_of_date) = 1""",
)
def _(t):
    fresh = t.constituents.where("month(as_of_date) = 1").withColumn("weight", F.col("weight") * 2)
    return P.replace_snapshot(t.constituents, fresh)


@query(
    "w31_insert_only_with_conflicts",
    """SELECT count(*) FILTER (s.ts_code IS NULL) AS inserted, count(*) FILTER (s.ts_code IS NOT NULL) AS already_present,
    count(*) FILTER (s.ts_code IS NOT NULL AND (a.close IS DISTINCT FROM s.close OR a.vol IS DISTINCT FROM s.vol)) AS conflicts
    FROM first_rows a LEFT JOIN stored s USING (ts_code, trade_date)""",
    **_BATCH,
)
def _(t):
    return P.insert_only(t.bars_where(_OLD), _deliveries(t), ["close", "vol"], ["delivery"])[1]


@query(
    "q4_typed_table_diff",
    """SELECT ts_code, trade_date, CASE WHEN a.c IS NULL THEN 'ONLY_OLD' WHEN s.c IS NULL THEN 'ONLY_NEW'
      WHEN a.c = s.c AND a.v = s.v THEN 'EQUAL' ELSE 'CONFLICT' END AS status,
      CASE WHEN a.c IS NULL OR s.c IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.c <> s.c THEN 'close' END, CASE WHEN a.v <> s.v THEN 'vol' END) END AS changed
    FROM (SELECT ts_code, trade_date, CAST(CAST(close AS VARCHAR) AS DECIMAL(20,2)) AS c, CAST(vol AS DECIMAL(24,4)) AS v FROM stored) s
    FULL JOIN (SELECT ts_code, trade_date, CAST(CAST(close AS VARCHAR) AS DECIMAL(20,2)) AS c, CAST(vol AS DECIMAL(24,4)) AS v FROM arriving) a USING (ts_code, trade_date)""",
    **_TWO,
)
def _(t):
    def typed(df):
        return df.select("ts_code", "trade_date", X.rescale("close", 20, 2).alias("close"), X.rescale("vol", 24, 4).alias("vol"))

    return P.diff(typed(t.bars_where(_OLD)), typed(t.bars_where(_NEW)), ["close", "vol"])


@query(
    "w30_newest_version",
    "SELECT ts_code, trade_date, max(tag) AS version, arg_max(px, tag) / 1e2 AS price, arg_max(l_quantity, tag) AS vol FROM ticks GROUP BY 1, 2",
)
def _(t):
    from barspan.sources.adapter import code_of

    rows = t.lines().select(
        code_of("l_suppkey").alias("ts_code"), "trade_date", F.col("tag").alias("version"),
        (F.col("px") / 1e2).alias("price"), F.col("l_quantity").alias("vol"),
    )
    return P.newest_version(rows)


# -- cleaning -----------------------------------------------------------------------
_FEED = """SELECT CASE WHEN l_linenumber = 7 THEN left(ts_code, 6) ELSE ts_code END AS ts_code,
    CASE WHEN l_linenumber = 6 AND l_returnflag = 'N' THEN NULL ELSE trade_date END AS trade_date,
    CASE WHEN l_linenumber = 5 AND l_returnflag = 'A' THEN NULL ELSE px / 1e2 END AS open,
    CASE WHEN l_linenumber = 4 AND l_returnflag = 'R' THEN px / 1e2 * 0.99::DOUBLE * 0.9::DOUBLE ELSE px / 1e2 * 1.01::DOUBLE END AS high,
    px / 1e2 * 0.99::DOUBLE AS low, px / 1e2 * (1 + (l_discount - l_tax) / 100) AS close,
    CASE WHEN l_linenumber = 3 AND l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS vol, tag FROM ticks"""
_TAGGED = r"""SELECT *, CASE WHEN NOT regexp_full_match(ts_code, '[0-9]{6,}\.(SZ|SH|BJ)') THEN 'BAD_CODE'
    WHEN trade_date IS NULL THEN 'BAD_DATE' WHEN open IS NULL THEN 'NULL_VALUE' END AS reason FROM feed"""
_LAST = """SELECT *, row_number() OVER (PARTITION BY ts_code, trade_date ORDER BY tag DESC) AS rn,
    close <= 0 OR high < low OR open < low OR open > high AS bad_price, vol < 0 AS bad_vol FROM tagged WHERE reason IS NULL"""
_CLEAN = {"feed": _FEED, "tagged": _TAGGED, "ranked": _LAST}


@query(
    "f1_clean_bars",
    f"""SELECT ts_code, trade_date, open, high, low, close, vol
    FROM ranked WHERE rn = 1 AND NOT bad_price AND NOT bad_vol""",
    **_CLEAN,
)
def _(t):
    return C.clean_bars(t.feed)


@query(
    "f2_code_format",
    r"""SELECT ts_code, regexp_full_match(ts_code, '[0-9]{6,}\.(SZ|SH|BJ)') AS valid, count(*) AS rows FROM feed GROUP BY 1""",
    **_CLEAN,
)
def _(t):
    counted = t.feed.groupBy("ts_code").agg(F.count(F.lit(1)).alias("rows"))
    return counted.withColumn("valid", F.col("ts_code").rlike(X.CODE_PATTERN))


@query(
    "f3_price_anomalies",
    """SELECT ts_code, trade_date, open, high, low, close
    FROM tagged WHERE reason IS NULL AND (close <= 0 OR high < low OR open < low OR open > high)""",
    **_CLEAN,
)
def _(t):
    typed = C._typed(t.feed)
    return typed.where(C.first_reject().isNull() & X.price_anomaly()).select("ts_code", "trade_date", *BAR[:4])


@query("f4_volume_anomalies", "SELECT ts_code, trade_date, vol FROM tagged WHERE reason IS NULL AND vol < 0", **_CLEAN)
def _(t):
    typed = C._typed(t.feed)
    return typed.where(C.first_reject().isNull() & (F.col("vol") < 0)).select("ts_code", "trade_date", "vol")


@query(
    "f5_clean_report",
    """SELECT (SELECT count(*) FROM tagged) AS input_rows, (SELECT count(*) FROM tagged WHERE reason = 'BAD_CODE') AS bad_code_rows,
    (SELECT count(*) FROM tagged WHERE reason = 'BAD_DATE') AS bad_date_rows, (SELECT count(*) FROM tagged WHERE reason = 'NULL_VALUE') AS null_rows,
    (SELECT count(*) FROM ranked WHERE rn > 1) AS duplicate_rows, (SELECT count(*) FROM ranked WHERE rn = 1 AND bad_price) AS price_anomaly_rows,
    (SELECT count(*) FROM ranked WHERE rn = 1 AND NOT bad_price AND bad_vol) AS volume_anomaly_rows,
    (SELECT count(*) FROM ranked WHERE rn = 1 AND NOT bad_price AND NOT bad_vol) AS output_rows""",
    **_CLEAN,
)
def _(t):
    return C.clean_report(t.feed)


@query(
    "w29_keep_last",
    "SELECT ts_code, trade_date, open, close, vol FROM ranked WHERE rn = 1",
    **_CLEAN,
)
def _(t):
    typed = C._typed(t.feed).where(C.first_reject().isNull())
    return C.keep_last(typed, P.KEY, ["ingest_seq"]).select("ts_code", "trade_date", "open", "close", "vol")


@query("f6_drop_missing", "SELECT * FROM panel WHERE turnover_rate IS NOT NULL AND pe IS NOT NULL")
def _(t):
    return C.drop_missing(P.daily_panel(t.bars, t.valuation))


@query(
    "f6_fill_missing",
    f"""SELECT ts_code, trade_date, coalesce(pe, round((SELECT avg(pe) FROM panel), 4)) AS pe,
    coalesce(turnover_rate, round((SELECT avg(turnover_rate) FROM panel), 4)) AS turnover_rate,
    coalesce(industry, (SELECT industry FROM panel JOIN master USING (ts_code) WHERE industry IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS industry
    FROM panel JOIN master USING (ts_code)""",
)
def _(t):
    df = P.daily_panel(t.bars, t.valuation).join(t.master.select("ts_code", "industry"), "ts_code")
    df = df.select("ts_code", "trade_date", "pe", "turnover_rate", "industry")
    return C.fill_missing(df, ["pe", "turnover_rate"], ["industry"], dp=4)


@query(
    "f7_winsorise",
    f"""SELECT ts_code, trade_date, {R('CASE WHEN ret IS NOT NULL THEN least(greatest(ret, m - 3 * s), m + 3 * s) END', 'return_1d')},
    {R('CASE WHEN lr IS NOT NULL THEN least(greatest(lr, lm - 3 * ls), lm + 3 * ls) END', 'log_return')}
    FROM (SELECT *, ln(close / pre_close) AS lr FROM rets),
    (SELECT avg(ret) AS m, stddev_samp(ret) AS s, avg(ln(close / pre_close)) AS lm, stddev_samp(ln(close / pre_close)) AS ls FROM rets)""",
)
def _(t):
    df = t.bars.select(
        "ts_code", "trade_date", change("close").alias("return_1d"), F.log(F.col("close") / previous("close")).alias("log_return")
    )
    return rounded(C.winsorise(df))


@query("f8_universe", "SELECT * FROM master WHERE left(ts_code, 1) NOT IN ('8', '4') AND NOT regexp_matches(coalesce(name, ''), 'ST|st')")
def _(t):
    return C.universe(t.master)


@query(
    "f9_infinite_to_null",
    f"SELECT ts_code, trade_date, open, high, low, close, vol, {R('CASE WHEN high > low THEN (close - low) / (high - low) END', 'position', 6)} FROM bars",
)
def _(t):
    ratio = F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low"))
    df = t.bars.withColumn("position", F.coalesce(ratio, F.lit(float("inf")))).drop("amount")
    return rounded(C.validate_and_clean(df))


@query("f11_minimum_history", "SELECT * FROM bars WHERE ts_code IN (SELECT ts_code FROM bars GROUP BY 1 HAVING count(*) >= 60)")
def _(t):
    return C.enough_history(t.bars)


@query("f17_instruments_with_bars", "SELECT ts_code, name, industry FROM master WHERE ts_code IN (SELECT ts_code FROM bars) ORDER BY ts_code")
def _(t):
    listed = t.master.join(t.bars.select("ts_code").distinct(), "ts_code", "left_semi")
    return listed.select("ts_code", "name", "industry").orderBy("ts_code")


@query(
    "f19_a_share_test",
    r"""SELECT ts_code, regexp_full_match(ts_code, '6[08][0-9]{4,}\.SH|(0[0-9]|30)[0-9]{4,}\.SZ') AS a_share FROM master""",
)
def _(t):
    return t.master.select("ts_code", X.is_a_share("ts_code").alias("a_share"))


@query(
    "f20_finite_features",
    f"""SELECT ts_code, trade_date, {R('ret', 'return_1d')}, {R('f', 'future_return_1d')} FROM
    (SELECT *, lead(close) OVER (PARTITION BY ts_code ORDER BY trade_date) / close - 1 AS f FROM rets) WHERE ret IS NOT NULL""",
)
def _(t):
    from barspan.functions.frames import following

    df = t.bars.select(
        "ts_code", "trade_date", change("close").alias("return_1d"), (following("close") / F.col("close") - 1).alias("future_return_1d")
    )
    return rounded(C.finite_rows(df, ["return_1d"]))


@query(
    "f23_resolve_pool",
    """SELECT ts_code FROM master WHERE industry IN ('NATION_1', 'NATION_2') UNION
    SELECT ts_code FROM constituents WHERE group_code = 'ASIA' AND as_of_date = (SELECT max(as_of_date) FROM constituents WHERE group_code = 'ASIA')""",
)
def _(t):
    return P.resolve_pool(t.constituents, t.master, ["NATION_1", "NATION_2"], ["ASIA"]).orderBy("ts_code")


@query(
    "s15_provider_normalisation",
    f"""SELECT ts_code, trade_date, {R('CASE WHEN pct <> 0 THEN floor(close / (1 + pct / 100) * 100 + 0.5) / 100 END', 'pre_close', 2)}, close,
    CAST(NULL AS DOUBLE) AS turnover_rate FROM (SELECT *, CASE WHEN rn > 1 THEN round(ret * 100, 3) END AS pct FROM rets)""",
)
def _(t):
    raw = t.bars.select(
        F.substring("ts_code", 1, 6).alias("symbol"),
        F.date_format("trade_date", "yyyy-MM-dd").alias("日期"),
        F.col("open").alias("开盘"),
        F.col("close").alias("收盘"),
        F.round(change("close") * 100, 3).alias("涨跌幅"),
    )
    out = C.normalize_provider(raw)
    return out.select("ts_code", "trade_date", "pre_close", "close", "turnover_rate")


@query(
    "s16_event_projection",
    """SELECT 'FEED:' || ts_code || ':' || strftime(trade_date, '%Y%m%d') AS event_id, ts_code, trade_date, close, vol AS volume,
    strftime(trade_date, '%Y-%m-%d') || ' 07:00:00' AS event_time_utc, pre_close IS NULL AS first_session FROM rets""",
)
def _(t):
    bars = t.bars.withColumn("pre_close", previous("close"))
    e = E.daily_events(bars, source=" feed ", trace="t-1", ingest_time="2024-01-01 00:00:00")
    return e.select(
        F.col("eventId").alias("event_id"), F.col("tsCode").alias("ts_code"), F.col("tradeDate").alias("trade_date"),
        F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"),
        F.date_format("eventTime", "yyyy-MM-dd HH:mm:ss").alias("event_time_utc"), F.col("preClose").isNull().alias("first_session"),
    )


# -- joins --------------------------------------------------------------------------
@query("j1_left_join_one_to_one", "SELECT b.*, adj_factor FROM bars b LEFT JOIN factors USING (ts_code, trade_date)")
def _(t):
    return t.bars.join(t.factors, P.KEY, "left")


@query("j2_inner_join_one_to_one", "SELECT b.*, adj_factor FROM bars b JOIN factors USING (ts_code, trade_date)")
def _(t):
    return t.bars.join(t.factors, P.KEY)


@query("j4_semi_join", "SELECT * FROM bars WHERE (ts_code, trade_date) IN (SELECT (ts_code, trade_date) FROM factors)")
def _(t):
    return t.bars.join(t.factors, P.KEY, "left_semi")


@query(
    "j5_anti_join_union",
    "SELECT ts_code, trade_date, close, 'new' AS origin FROM arriving UNION ALL SELECT ts_code, trade_date, close, 'old' FROM stored WHERE (ts_code, trade_date) NOT IN (SELECT (ts_code, trade_date) FROM arriving)",
    **_TWO,
)
def _(t):
    cols = ["ts_code", "trade_date", "close"]
    old = t.bars_where(_OLD).select(*cols, F.lit("old").alias("origin"))
    new = t.bars_where(_NEW).select(*cols, F.lit("new").alias("origin"))
    return P.upsert(old, new, ["origin"])


@query(
    "j6_as_of_snapshot",
    """SELECT c.* FROM constituents c JOIN (SELECT group_code, max(as_of_date) AS as_of_date FROM constituents
    WHERE as_of_date <= DATE '1999-05-15' GROUP BY 1) USING (group_code, as_of_date)""",
)
def _(t):
    return P.latest_snapshot(t.constituents, "1999-05-15")


@query(
    "j10_null_only_backfill",
    """SELECT b.ts_code, b.trade_date, b.close, coalesce(pe, c.v) AS pe FROM panel b LEFT JOIN
    (SELECT ts_code, trade_date, adj_factor * 10 AS v FROM factors) c USING (ts_code, trade_date)""",
)
def _(t):
    cache = t.factors.select(*P.KEY, (F.col("adj_factor") * 10).alias("pe"))
    panel = P.daily_panel(t.bars, t.valuation).select(*P.KEY, "close", "pe")
    return P.backfill(panel, cache, "pe")


@query("j13_union_panels", "SELECT *, 'stored' AS part FROM stored UNION ALL SELECT *, 'arriving' AS part FROM arriving", **_TWO)
def _(t):
    a = t.bars_where(_OLD).withColumn("part", F.lit("stored"))
    return a.unionByName(t.bars_where(_NEW).withColumn("part", F.lit("arriving")))


@query(
    "j14_key_set_equality",
    """SELECT ts_code, trade_date, CASE WHEN v.total_mv IS NULL THEN 'LEFT_ONLY' ELSE 'RIGHT_ONLY' END AS side
    FROM (SELECT ts_code, trade_date, close FROM bars) b FULL JOIN valuation v USING (ts_code, trade_date)
    WHERE b.close IS NULL OR v.total_mv IS NULL""",
)
def _(t):
    return P.key_difference(t.bars, t.valuation)


# -- scalar functions on whole tables -----------------------------------------------
@query(
    "x3_rescale_half_up",
    """SELECT ts_code, trade_date, CAST(CAST(CAST(close AS VARCHAR) AS DECIMAL(12,2)) AS DOUBLE) AS close, close * 1000000 >= 10000000000 AS overflow FROM bars""",
)
def _(t):
    return t.bars.select(
        *P.KEY,
        X.rescale("close", 12, 2).cast("double").alias("close"),
        X.overflows(F.col("close") * 1000000, 12, 2).alias("overflow"),
    )


@query("x4_float32_image", "SELECT ts_code, trade_date, CAST(CAST(CAST(CAST(close AS FLOAT) AS DOUBLE) AS DECIMAL(38,6)) AS DOUBLE) AS image, CAST(CAST(CAST(close AS FLOAT) AS DOUBLE) AS DECIMAL(38,6)) = CAST(close AS DECIMAL(38,6)) AS same FROM bars")
def _(t):
    image = X.float32_image("close")
    return t.bars.select(*P.KEY, image.cast("double").alias("image"), (image == X.rescale("close", 38, 6)).alias("same"))


@query(
    "x10_return_classes",
    "SELECT ts_code, trade_date, CASE WHEN ret < -0.03 THEN 0 WHEN ret < -0.01 THEN 1 WHEN ret < 0.01 THEN 2 WHEN ret < 0.03 THEN 3 WHEN ret IS NOT NULL THEN 4 END AS class FROM rets",
)
def _(t):
    return t.bars.select(*P.KEY, X.return_class(change("close")).alias("class"))
