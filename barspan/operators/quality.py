"""Calendars, lifecycles, coverage, attribution, gap planning and readiness.

Calendar tables hold one row per day and are broadcast; grids of expected keys come from
exploding each member's own lifetime and an equi-join with the open days. Where a grid takes
facts along, the stored rows of a code stand in order and each fills the days up to the next,
so the grid itself is neither shuffled nor sorted (``filled_grid``).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspan.functions.ranks import value_positions
from barspan.functions.scalars import ohlcv_valid, positive, session_completed
from barspan.operators.market import session_runs
from barspan.operators.tables import diff
from barspan.session import cut_lineage

KEY = ["ts_code", "trade_date"]

# Request capacity of the provider and the market-wide threshold.
CAPACITY = 6000
MARKET_WIDE = 100


# -- calendar -----------------------------------------------------------------------
def session_ordinals(calendar: DataFrame) -> DataFrame:
    """Open days with a 1-based ordinal. One row per calendar day, so the single sort is bounded."""
    w = Window.orderBy("cal_date")
    opened = calendar.where("is_open = 1")
    return opened.select(F.col("cal_date").alias("trade_date"), F.row_number().over(w).alias("ordinal"))


def missing_days(calendar: DataFrame, day: str = "cal_date") -> DataFrame:
    """Days a calendar lacks between its first and last row."""
    span = calendar.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    every = span.select(F.explode(F.sequence("a", "b")).alias(day))
    return every.join(calendar.select(day).distinct(), day, "left_anti")


def target_session(rows: DataFrame, sessions: DataFrame, offset: int, alias: str = "target_date") -> DataFrame:
    """The session ``offset`` places after each row's session on the calendar, not the next stored row."""
    later = sessions.select((F.col("ordinal") - offset).alias("ordinal"), F.col("trade_date").alias(alias))
    pairs = sessions.join(later, "ordinal", "left").drop("ordinal")
    return rows.join(F.broadcast(pairs), "trade_date", "left")


def complete_sessions(bars: DataFrame) -> DataFrame:
    """Sessions on which every instrument of the panel has a bar; one row per session."""
    size = bars.agg(F.count_distinct("ts_code").alias("n"))
    per_day = bars.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"))
    return per_day.where(F.col("n") == size.select("n").scalar()).select("trade_date")


def select_cutoff(calendar: DataFrame, bars: DataFrame, as_of, factors: DataFrame | None = None) -> DataFrame:
    """Latest finished session, and the latest finished one complete for the whole pool.

    The reason says what was incomplete on the target session when falling back.
    """
    now = F.lit(as_of).cast("timestamp")
    done = session_ordinals(calendar).where(session_completed("trade_date", now)).select("trade_date")
    pool = bars.agg(F.count_distinct("ts_code").alias("n")).select("n").scalar()
    daily = bars.where(ohlcv_valid()).groupBy("trade_date").agg(F.count(F.lit(1)).alias("d"))
    days = done.join(daily, "trade_date", "left")
    if factors is not None:
        f = factors.where(positive("adj_factor")).join(bars.select("ts_code").distinct(), "ts_code", "left_semi")
        days = days.join(f.groupBy("trade_date").agg(F.count(F.lit(1)).alias("f")), "trade_date", "left")
    else:
        days = days.withColumn("f", F.col("d"))
    daily_ok, factor_ok = F.coalesce(F.col("d") == pool, F.lit(False)), F.coalesce(F.col("f") == pool, F.lit(False))
    why = F.when(~daily_ok, "INCOMPLETE_DAILY").when(~factor_ok, "INCOMPLETE_FACTORS")
    out = days.agg(
        F.max("trade_date").alias("target_trade_date"),
        F.max(F.when(daily_ok & factor_ok, F.col("trade_date"))).alias("data_cutoff"),
        F.max_by(why, "trade_date").alias("fallback_reason"),
    )
    return out


# -- lifecycles ---------------------------------------------------------------------
def _lives(master: DataFrame, sessions: DataFrame, floor=None) -> DataFrame:
    """Members with the first and last day of [max(list, floor), delist) inside the calendar, ``_a`` and ``_b``."""
    span = sessions.agg(F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    first = F.greatest(F.col("list_date"), lo if floor is None else F.greatest(lo, F.lit(floor).cast("date")))
    last = F.least(F.date_sub("delist_date", 1), hi)
    return master.withColumns({"_a": first, "_b": last}).where(F.col("_a") <= F.col("_b"))


def lifetime_grid(master: DataFrame, sessions: DataFrame, floor=None) -> DataFrame:
    """One row per member and open session in [max(list, floor), delist)."""
    lives = _lives(master, sessions, floor)
    days = lives.select("ts_code", F.explode(F.sequence("_a", "_b")).alias("trade_date"))
    return days.join(F.broadcast(sessions.select("trade_date")), "trade_date", "left_semi")


def keyed_facts(*sources: DataFrame) -> DataFrame:
    """One row per (code, day) with the columns of all ``sources``, null where a source has no row.

    The sources move together and once, by code: a code has at most a row per day of each.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources).where(F.col("ts_code").isNotNull())
    return rows.repartition("ts_code").groupBy(*KEY).agg(*[F.max(c).alias(c) for c in rows.columns if c not in KEY])


def filled_grid(master: DataFrame, sessions: DataFrame, facts: DataFrame, floor=None) -> DataFrame:
    """``lifetime_grid`` with the member's columns and, where a day has a row in ``facts``, that row's columns.

    A stored row stands for its own day and the days without a row up to the next one, a code's first row also
    for the days before it, a member without any for its whole life. What moves are members and facts.
    """
    names = [c for c in facts.columns if c not in KEY]
    known = facts.select("ts_code", F.col("trade_date").alias("_day"), *names).where("_day IS NOT NULL")
    w = Window.partitionBy("ts_code").orderBy("_day")  # at most one row per calendar day
    stored = known.withColumns({"_first": F.row_number().over(w) == 1, "_next": F.lead("_day").over(w)})
    rows = _lives(master, sessions, floor).join(stored, "ts_code", "left")
    start = F.when(F.coalesce("_first", F.lit(True)), F.col("_a")).otherwise(F.greatest("_a", "_day"))
    until = F.least("_b", F.greatest("_day", F.date_sub("_next", 1)))
    end = F.when(F.col("_next").isNull(), F.col("_b")).otherwise(until)
    spans = rows.withColumns({"_from": start, "_to": end}).where(F.col("_from") <= F.col("_to"))
    days = spans.withColumn("trade_date", F.explode(F.sequence("_from", "_to")))
    own = F.col("trade_date") == F.col("_day")
    days = days.join(F.broadcast(sessions.select("trade_date")), "trade_date", "left_semi")
    return days.select(*master.columns, "trade_date", *[F.when(own, F.col(c)).alias(c) for c in names])


def inactive_reason(day: Column) -> Column:
    return F.when(day < F.col("list_date"), "PRE_LISTING").when(day >= F.col("delist_date"), "POST_DELISTING")


def _pieces(first: Column, last: Column) -> Column:
    """The fewest dyadic blocks (level, index) of days that make up ``first`` to ``last``: two a level at most."""
    none = F.array().cast("array<struct<level:int,block:int>>")
    start = F.struct(first.alias("a"), (last + 1).alias("b"), none.alias("out"))

    def step(acc, level):
        a, b = acc["a"], acc["b"]
        odd_a, odd_b = (a < b) & (a % 2 == 1), (a + a % 2 < b) & (b % 2 == 1)
        low = F.when(odd_a, F.array(F.struct(level.alias("level"), a.alias("block")))).otherwise(none)
        high = F.when(odd_b, F.array(F.struct(level.alias("level"), (b - 1).alias("block")))).otherwise(none)
        go = a < b
        return F.struct(
            F.when(go, F.shiftright(a + a % 2, 1)).otherwise(a).alias("a"),
            F.when(go, F.shiftright(b - b % 2, 1)).otherwise(b).alias("b"),
            F.concat(acc["out"], low, high).alias("out"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(_LEVELS)), start, step, lambda acc: acc["out"])


#: Days since the year 1, so that blocks count from 0, fit so many binary digits.
_EPOCH, _LEVELS = 719_162, 22


def _starts_inside(spans: DataFrame, points: DataFrame, on: list[str], first: Column, last: Column, point: Column) -> DataFrame:
    """Spans joined with the points from ``first`` to ``last``: one equality join, one match per pair.

    A span is cut into disjoint dyadic blocks and a point names every block above it, up to the largest
    block any span uses; so a point meets a span exactly once, and only if it lies inside.
    """
    cut = spans.where(first <= last).withColumn("_p", F.explode(_pieces(first + _EPOCH, last + _EPOCH))).select("*", "_p.level", "_p.block").drop("_p")
    top = cut.agg(F.coalesce(F.max("level"), F.lit(0)).alias("m")).select("m").scalar()
    named = points.withColumn("level", F.explode(F.sequence(F.lit(0), top)))
    named = named.withColumn("block", F.floor((point + _EPOCH) / F.pow(F.lit(2.0), F.col("level"))).cast("int"))
    return cut.join(named, [*on, "level", "block"]).drop("level", "block")


def overlaps(left: DataFrame, right: DataFrame, days: int | None = None, on: list[str] | tuple = ()) -> DataFrame:
    """Interval-overlap join, with equality on ``on``: no pair is formed that is not a result.

    ``days`` was the width of the buckets of an earlier form and has no effect.
    Two closed intervals overlap either because the right one starts inside the left one, or
    because the left one starts after the right one's start and inside it; never both.
    """
    on = list(on)
    a, b, c, d = (F.unix_date(n) for n in ("left_start", "left_end", "right_start", "right_end"))
    sound = F.col("right_start") <= F.col("right_end")
    one = _starts_inside(left, right.where(sound), on, a, b, c)
    two = _starts_inside(right, left.where(F.col("left_start") <= F.col("left_end")), on, c + 1, d, a)
    return one.unionByName(two.select(one.columns))


# -- suspensions and attribution ----------------------------------------------------
def _minutes(text: Column, at: int) -> Column:
    return F.substring(text, at, 2).cast("int") * 60 + F.substring(text, at + 3, 2).cast("int")


def _covered(stops: Column, first: int, last: int) -> Column:
    """Do the sorted intervals, merged where they touch, cover [first, last]?"""

    def reach(acc, s):
        return F.when((s["a"] <= acc) & (s["b"] > acc), s["b"]).otherwise(acc)

    return F.aggregate(stops, F.lit(first), reach) >= last


def halt_days(events: DataFrame) -> DataFrame:
    """Per (code, day): full-day halt, intraday-only halt, and S/R ambiguity.

    Copies of an event collapse first; the distinct timings of one day are few.
    """
    kinds = events.select(*KEY, "suspend_type", "suspend_timing").distinct()
    t = F.col("suspend_timing")
    precise = t.rlike("^[0-9]{2}:[0-5][0-9]-[0-9]{2}:[0-5][0-9]$") & (
        (_minutes(t, 1) >= 570) & (_minutes(t, 1) < _minutes(t, 7)) & (_minutes(t, 7) <= 900)
    )
    stop = F.col("suspend_type") == "S"
    day = kinds.groupBy(*KEY).agg(
        F.bool_and(stop & t.isNull()).alias("full_day"),
        F.bool_or(stop).alias("_s"),
        F.bool_or(~stop).alias("_r"),
        F.bool_and(~stop | F.coalesce(precise, F.lit(False))).alias("_precise"),
        F.sort_array(
            F.collect_set(F.when(stop & precise, F.struct(_minutes(t, 1).alias("a"), _minutes(t, 7).alias("b"))))
        ).alias("_stops"),
    )
    whole = _covered(F.col("_stops"), 570, 690) & _covered(F.col("_stops"), 780, 900)
    return day.select(
        *KEY,
        "full_day",
        (F.col("_s") & F.col("_precise") & ~whole).alias("intraday_only"),
        (F.col("_s") & F.col("_r")).alias("mixed"),
    )


def attribute_sources(
    master: DataFrame,
    sessions: DataFrame,
    stored: DataFrame,
    provider: DataFrame,
    valuation: DataFrame,
    factors: DataFrame,
    halts: DataFrame,
    columns: list[str],
) -> DataFrame:
    """Where every (code, session) of the grid comes from, for bars, valuation, factor and pe."""
    origin = diff(stored, provider, columns).select(
        *KEY,
        F.when(F.col("status") == "ONLY_OLD", "DATABASE_ROW")
        .when(F.col("status") == "ONLY_NEW", "PROVIDER_ROW")
        .when(F.col("status") == "CONFLICT", "SOURCE_CONFLICT")
        .otherwise("PROVIDER_VERIFIED_EXISTING")
        .alias("origin"),
    )
    facts = (
        origin.join(valuation.select(*KEY, "pe", F.lit(True).alias("basic")), KEY, "full")
        .join(factors.select(*KEY, F.lit(True).alias("factor")), KEY, "full")
    )
    return attribute_facts(master, sessions, facts, halts)


def attribute_facts(master: DataFrame, sessions: DataFrame, facts: DataFrame, halts: DataFrame) -> DataFrame:
    """Status of every (code, session): ``facts`` has ``origin``, ``basic``, ``pe`` and ``factor`` per key, null where absent."""
    facts = facts.select(*KEY, "origin", "pe", F.col("basic").alias("_basic"), F.col("factor").alias("_factor"))
    rows = filled_grid(_whole_lives(master, "list_date"), sessions, keyed_facts(facts, halt_days(halts)))
    early = F.col("trade_date") < F.col("_list_date")
    full, mixed = F.coalesce("full_day", F.lit(False)), F.coalesce("mixed", F.lit(False))
    quoted = F.col("origin").isNotNull()
    confirmed = F.coalesce("intraday_only", F.lit(False)) & F.col("origin").isin("PROVIDER_ROW", "PROVIDER_VERIFIED_EXISTING")
    clash = (mixed & ~F.coalesce(confirmed, F.lit(False))) | (full & quoted)
    daily = (
        F.when(early, "PRE_LISTING")
        .when(clash, "SOURCE_CONFLICT")
        .when(quoted, F.col("origin"))
        .when(full, "FULL_DAY_SUSPENSION")
        .otherwise("UNRESOLVED_MISSING")
    )
    basic = F.when(F.col("_basic"), "DATABASE_ROW").when(early, "PRE_LISTING").otherwise("MISSING_BASIC_ROW")
    factor = F.when(early, "PRE_LISTING").when(F.col("_factor"), "PROVIDER_ROW").otherwise("MISSING_FACTOR")
    pe = F.when(F.col("_basic").isNull(), "NO_ROW").when(F.col("pe").isNotNull(), "VALUE").otherwise("DATABASE_NULL_UNVERIFIED")
    return rows.select(
        *KEY, daily.alias("daily_status"), basic.alias("basic_status"), factor.alias("factor_status"), pe.alias("pe_status")
    )


def _whole_lives(master: DataFrame, *columns: str) -> DataFrame:
    """Members that are asked for on every session, each with its own ``columns`` under a leading underscore."""
    every = master.select("ts_code", F.lit("1900-01-01").cast("date").alias("list_date"), F.lit(None).cast("date").alias("delist_date"))
    return every.join(master.select("ts_code", *[F.col(c).alias(f"_{c}") for c in columns]), "ts_code")


def attribute_valuation(master: DataFrame, sessions: DataFrame, facts: DataFrame) -> DataFrame:
    """Where each valuation row comes from, and what a missing ratio means.

    ``facts``: per key the store's ``s_pb``, ``s_pe`` and the provider's ``p_pb``, ``p_pe``; a side without a
    row has a null ``pb``. A row of both sides is verified if all values agree, and a conflict otherwise;
    the store's row is the one in force.
    """
    rows = filled_grid(_whole_lives(master, "list_date"), sessions, facts)
    stored, given = F.col("s_pb").isNotNull(), F.col("p_pb").isNotNull()
    same = F.col("s_pb").eqNullSafe(F.col("p_pb")) & F.col("s_pe").eqNullSafe(F.col("p_pe"))
    origin = (
        F.when(stored & ~given, "DATABASE_ROW")
        .when(given & ~stored, "PROVIDER_ROW")
        .when(stored & given & same, "PROVIDER_VERIFIED_EXISTING")
        .when(stored & given, "SOURCE_CONFLICT")
        .when(F.col("trade_date") < F.col("_list_date"), "PRE_LISTING")
        .otherwise("MISSING_BASIC_ROW")
    )
    pe = F.when(stored, F.col("s_pe")).otherwise(F.col("p_pe"))
    ratio = (
        F.when(~stored & ~given, "NO_ROW")
        .when(F.col("basic_status") == "SOURCE_CONFLICT", "SOURCE_CONFLICT")
        .when(pe.isNotNull(), "VALUE")
        .when(F.col("basic_status").isin("PROVIDER_ROW", "PROVIDER_VERIFIED_EXISTING"), "PROVIDER_NULL")
        .otherwise("DATABASE_NULL_UNVERIFIED")
    )
    return rows.withColumn("basic_status", origin).select(*KEY, "basic_status", ratio.alias("pe_status"))


def missing_inventory(status: DataFrame) -> DataFrame:
    """Missing keys per source: one row per (method, code, day)."""
    basic = (F.col("basic_status") == "MISSING_BASIC_ROW") & ~F.col("daily_status").isin(
        "PRE_LISTING", "FULL_DAY_SUSPENSION", "UNRESOLVED_MISSING", "SOURCE_CONFLICT"
    )
    kinds = F.array_compact(
        F.array(
            F.when(F.col("daily_status") == "UNRESOLVED_MISSING", "daily"),
            F.when(F.col("daily_status") == "UNRESOLVED_MISSING", "suspend_d"),
            F.when(basic, "daily_basic"),
            F.when(F.col("factor_status") == "MISSING_FACTOR", "adj_factor"),
        )
    )
    return status.select(F.explode(kinds).alias("method"), *KEY)


# -- plans --------------------------------------------------------------------------
def missing_keys(grid: DataFrame, stored: DataFrame) -> DataFrame:
    return grid.join(stored.select(*KEY), KEY, "left_anti")


def gap_plan(grid: DataFrame, stored: DataFrame, sessions: DataFrame, excluded: DataFrame | None = None, registered_pool: bool = False) -> DataFrame:
    """Missing-only requests.

    ``excluded``: keys proven to have no quote, which are not asked for. A registered pool is part of a
    market, so it is never asked for by a full-date request.

    A day on which no eligible key is stored becomes one full-date request (below the
    provider's capacity); every other gap is a run of consecutive sessions of one code,
    cut at year ends.
    """
    absent = missing_keys(grid, stored)
    if excluded is not None:
        absent = absent.join(excluded.select(*KEY).distinct(), KEY, "left_anti")
    present = stored.join(grid, KEY, "left_semi").select("trade_date").distinct()
    per_day = absent.groupBy("trade_date").agg(F.count(F.lit(1)).alias("keys"))
    whole = per_day.where((F.col("keys") < CAPACITY) & F.lit(not registered_pool)).join(F.broadcast(present), "trade_date", "left_anti")
    full = whole.select(
        F.lit("full_date").alias("mode"), F.lit(None).cast("string").alias("ts_code"),
        F.col("trade_date").alias("start_date"), F.col("trade_date").alias("end_date"), F.col("keys"),
    )
    rest = absent.join(F.broadcast(whole.select("trade_date")), "trade_date", "left_anti")
    runs = session_runs(rest, sessions, split_years=True)
    return full.unionByName(
        runs.select(F.lit("stock_range").alias("mode"), "ts_code", "start_date", "end_date", F.col("sessions").alias("keys"))
    )


#: Words of 64 days that a task of ``request_lists`` is dealt, and that it turns into lists at once.
WORDS_PER_TASK, WORDS_AT_ONCE = 200_000, 100_000
_NO_DAY = -(1 << 40)


def _day_lists(batches):
    """Words sorted by code, turned about: per day and method the codes, in order, as pieces numbered by task and ``seq``."""

    def turned(rows: pa.Table, seq: int) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        method, code = (rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("method", "ts_code"))
        word, bits = (rows.column(c).combine_chunks() for c in ("word", "bits"))
        dayless = word.is_null().to_numpy(zero_copy_only=False)
        flags = np.unpackbits(bits.fill_null(1).to_numpy().astype("<i8").view(np.uint8), bitorder="little")
        at = np.flatnonzero(flags)
        row, day = at >> 6, at & 63
        day = np.where(dayless[row], _NO_DAY, word.fill_null(0).to_numpy().astype(np.int64)[row] * 64 + day)
        days, day = np.unique(day, return_inverse=True)
        methods, codes = len(method.dictionary), len(code.dictionary)
        key = (day * methods + method.indices.to_numpy()[row]) * codes + code.indices.to_numpy()[row]  # codes count in their order
        key.sort()
        group, which = np.divmod(key, codes)
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        of = group[starts]
        date = days[of // methods]
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)), pa.int32()), code.dictionary.take(pa.array(which)))
        n, task = len(starts), rows.column("task")[0].as_py()
        return pa.RecordBatch.from_arrays(
            [pa.array(np.where(date == _NO_DAY, 0, date).astype(np.int32), mask=date == _NO_DAY).cast(pa.date32()), method.dictionary.take(pa.array(of % methods)), pa.array([task] * n, pa.int32()), pa.array([seq] * n, pa.int32()), lists],
            ["trade_date", "method", "task", "seq", "piece"],
        )

    held, size, seq = [], 0, 0
    for batch in batches:
        held, size = [*held, batch], size + batch.num_rows
        if size >= WORDS_AT_ONCE:
            yield turned(pa.Table.from_batches(held), seq)
            held, size, seq = [], 0, seq + 1
    if size:
        yield turned(pa.Table.from_batches(held), seq)


def request_lists(inventory: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Code lists per day and method, in chunks of the provider's capacity.

    The days of a code and method are first gathered as bits, 64 to a word, where the code's rows stand; repeated keys fall
    together. Words, not keys, are written and dealt out by code. A task then lists the codes of each day it
    has in pieces, and a running count over the pieces of a day says where a chunk ends, so no day collects an unbounded list.
    """
    day = F.unix_date("trade_date")
    words = inventory.where(F.col("ts_code").isNotNull()).groupBy("method", "ts_code", F.shiftright(day, 6).alias("word"))
    words = cut_lineage(words.agg(F.bit_or(F.expr("shiftleft(1L, unix_date(trade_date) & 63)")).alias("bits")), "days")
    dealt = words.repartitionByRange(words.count() // WORDS_PER_TASK + 1, "ts_code").sortWithinPartitions("ts_code").withColumn("task", F.spark_partition_id())
    kinds = {f.name: f.dataType.simpleString() for f in inventory.schema.fields}
    pieces = dealt.mapInArrow(_day_lists, f"trade_date date, method {kinds['method']}, task int, seq int, piece array<{kinds['ts_code']}>")
    before = Window.partitionBy("trade_date", "method").orderBy("task", "seq").rowsBetween(Window.unboundedPreceding, -1)  # rows are pieces
    pieces = pieces.withColumns({"_n": F.size("piece"), "_at": F.coalesce(F.sum(F.size("piece")).over(before), F.lit(0))})
    last = F.floor((F.col("_at") + F.col("_n") - 1) / capacity).cast("int")
    cut = pieces.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("_at") / capacity).cast("int"), last)))
    start = F.greatest(F.col("chunk").cast("long") * capacity - F.col("_at"), F.lit(0))
    end = F.least((F.col("chunk").cast("long") + 1) * capacity - F.col("_at"), F.col("_n"))
    own = F.slice("piece", (start + 1).cast("int"), (end - start).cast("int"))
    chunks = cut.select("trade_date", "method", "chunk", (end - start).alias("_n"), F.struct("task", "seq", own.alias("piece")).alias("_p")).groupBy("trade_date", "method", "chunk")
    out = chunks.agg(F.sum("_n").alias("codes"), F.sort_array(F.collect_list("_p")).alias("_p"))
    return out.select("trade_date", "method", "chunk", "codes", F.concat_ws(",", F.flatten(F.col("_p.piece"))).alias("code_list"))


def evidence_requests(required: DataFrame, known: DataFrame, wide: int = MARKET_WIDE) -> DataFrame:
    """Per day the keys still unknown; from ``wide`` codes on, one market-wide request."""
    absent = required.select(*KEY).join(known.select(*KEY), KEY, "left_anti")
    sizes = absent.groupBy("trade_date").agg(F.count(F.lit(1)).alias("codes"))
    short = sizes.where(F.col("codes") < wide)
    lists = (
        absent.join(F.broadcast(short.select("trade_date")), "trade_date", "left_semi")
        .groupBy("trade_date")
        .agg(F.concat_ws(",", F.sort_array(F.collect_list("ts_code"))).alias("code_list"))  # fewer than ``wide``
    )
    mode = F.when(F.col("codes") >= wide, "market").otherwise("codes")
    return sizes.join(lists, "trade_date", "left").withColumn("mode", mode)


def year_segments(keys: DataFrame) -> DataFrame:
    return keys.groupBy("ts_code", F.year("trade_date").alias("year")).agg(
        F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), F.count(F.lit(1)).alias("sessions")
    )


def merge_evidence(rows: DataFrame, value: str) -> DataFrame:
    """Identical repeats collapse to one value; differing values of a key are a conflict."""
    merged = rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("copies"), F.min(value).alias("_lo"), F.max(value).alias("_hi")
    )
    same = F.col("_lo").eqNullSafe(F.col("_hi"))
    return merged.select(
        *KEY, "copies", F.when(same, F.col("_lo")).alias(value), F.when(same, "MERGED").otherwise("CONFLICT").alias("status")
    )


def full_halt_days(events: DataFrame, queried: DataFrame, reviews: DataFrame) -> DataFrame:
    """Days proven fully halted: asked for that single day, every event S without timing; plus reviews."""
    proven = halt_days(events).where("full_day").select(*KEY).join(queried.select(*KEY), KEY, "left_semi")
    return proven.unionByName(reviews.select(*KEY)).distinct()


# -- coverage -----------------------------------------------------------------------
def pool_coverage(master: DataFrame, sessions: DataFrame, bars: DataFrame, valuation: DataFrame, halts: DataFrame, gaps: int = 5) -> DataFrame:
    """Eligible, stored, halted and unresolved sessions per instrument, with the first gaps."""
    grid = lifetime_grid(master, sessions).withColumn("_e", F.lit(1))
    stored = bars.select(*KEY, F.lit(1).alias("_b"))
    basic = valuation.select(*KEY, F.lit(1).alias("_v"))
    still = halts.select(*KEY).distinct().withColumn("_h", F.lit(1))
    rows = grid.join(stored, KEY, "full_outer").join(basic, KEY, "left").join(still, KEY, "left")
    live, quoted = F.col("_e").isNotNull(), F.col("_b").isNotNull()
    unresolved = live & ~quoted & F.col("_h").isNull()

    def count(c):
        return F.count(F.when(c, 1))

    summary = rows.groupBy("ts_code").agg(
        count(live).alias("eligible_sessions"),
        count(live & quoted).alias("daily_rows"),
        count(live & quoted & F.col("_v").isNotNull()).alias("daily_basic_rows"),
        count(unresolved).alias("unresolved_no_quote"),
        count(live & ~quoted & F.col("_h").isNotNull()).alias("verified_no_quote"),
        count(quoted & ~live).alias("out_of_period_rows"),
        F.min(F.when(live & quoted, F.col("trade_date"))).alias("stored_first"),
        F.max(F.when(live & quoted, F.col("trade_date"))).alias("stored_last"),
        # at most one entry per session of one instrument
        F.slice(F.sort_array(F.collect_list(F.when(unresolved, F.col("trade_date").cast("string")))), 1, gaps).alias("_gaps"),
    )
    bad = (F.col("unresolved_no_quote") > 0) | (F.col("daily_rows") > F.col("daily_basic_rows")) | (F.col("out_of_period_rows") > 0)
    status = F.when(F.col("eligible_sessions") == 0, "NO_APPLICABLE_SESSIONS").when(bad, "NEEDS_CHECK").otherwise("ROW_COVERED")
    return summary.withColumns({"status": status, "gap_sample": F.concat_ws(",", "_gaps")}).drop("_gaps")


def continuity(bars: DataFrame, sessions: DataFrame, least: int = 300, most: int = 2500) -> DataFrame:
    """Stored sessions against every open session between first and last."""
    rows = bars.join(F.broadcast(sessions), "trade_date", "left")
    out = rows.groupBy("ts_code").agg(
        F.count(F.lit(1)).alias("stored"),
        F.count(F.when(F.col("ordinal").isNull(), 1)).alias("off_calendar"),
        (F.max("ordinal") - F.min("ordinal") + 1).alias("expected"),
    )
    ok = (F.col("stored") == F.col("expected")) & (F.col("off_calendar") == 0)
    return out.withColumns({"continuous": ok, "enough": F.col("stored").between(least, most)})


def eligible_counts_from_ranges(ranges: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rebuild per-session counts from ranges by a sweep of +1/-1 boundary events."""
    by_day = sessions.select(F.col("trade_date"), "ordinal")
    up = ranges.groupBy(F.col("start_date").alias("trade_date")).agg(F.count(F.lit(1)).alias("_up"))
    down = ranges.groupBy(F.col("end_date").alias("trade_date")).agg(F.count(F.lit(1)).alias("_down"))
    rows = by_day.join(up, "trade_date", "left").join(down, "trade_date", "left").na.fill(0, ["_up", "_down"])
    w = Window.orderBy("ordinal")  # one row per session
    opened = F.sum("_up").over(w)
    closed = F.sum("_down").over(w) - F.col("_down")
    return rows.select("trade_date", (opened - closed).alias("eligible"))


# -- samples and readiness ----------------------------------------------------------
def qualify_samples(master: DataFrame, sessions: DataFrame, bars: DataFrame, halts: DataFrame, end, warmup: int = 120, horizon: int = 5) -> DataFrame:
    """One reason or one sample per (member, requested session).

    The label is the exact ``horizon``-th calendar session. A missing quote without a
    proven halt is reported as UNEXPLAINED_QUOTE_GAP instead of being skipped.
    """
    w = Window.partitionBy("ts_code").orderBy("trade_date")
    quotes = bars.select(*KEY, "close", F.lit(1).alias("_bar"))
    facts = keyed_facts(quotes, halts.select(*KEY, F.lit(True).alias("_halt"))).withColumn("_age", F.sum("_bar").over(w) - 1)
    placed = facts.join(F.broadcast(sessions.select("trade_date", "ordinal")), "trade_date")  # one row per calendar day
    later = Window.partitionBy("ts_code").orderBy("ordinal").rangeBetween(horizon, horizon)
    facts = placed.withColumn("target_close", F.max("close").over(later)).drop("_bar", "ordinal")
    rows = filled_grid(_whole_lives(master, "list_date", "delist_date"), sessions, facts).where(F.col("trade_date") <= F.lit(end).cast("date"))
    rows = rows.withColumns({"list_date": F.col("_list_date"), "delist_date": F.col("_delist_date")})
    rows = target_session(rows, sessions, horizon)
    quoted, target = F.col("close").isNotNull(), F.col("target_date")
    reason = F.coalesce(
        inactive_reason(F.col("trade_date")),
        F.when(~quoted & F.col("_halt"), "SUSPENDED"),
        F.when(~quoted, "UNEXPLAINED_QUOTE_GAP"),
        F.when(F.col("_age") < warmup, "WARMUP"),
        F.when(target.isNull() | (target > F.lit(end).cast("date")), "UNMATURED_LABEL"),
        F.when(inactive_reason(target).isNotNull(), "TARGET_INACTIVE"),
        F.when(F.col("target_close").isNull(), "TARGET_SUSPENDED"),
    )
    out = rows.withColumn("reason", reason)
    label = F.when(F.col("reason").isNull(), F.col("target_close") / F.col("close") - 1)
    return out.select(*KEY, "target_date", "reason", label.alias("label"))


# Data requirements per strategy profile.
PROFILES = [
    ("single", 60, 1, 60, 1, False, False),
    ("ranking", 120, 1, 365, 5, True, False),
    ("sequence", 253, 60, 60, 5, False, True),
]
_PROFILE = ("profile", "warmup", "sequence", "mature", "horizon", "needs_valuation", "needs_factors")


def readiness(master: DataFrame, sessions: DataFrame, bars: DataFrame, valuation: DataFrame, factors: DataFrame) -> DataFrame:
    """Conservative data readiness per instrument and strategy profile."""
    grid = lifetime_grid(master.withColumn("delist_date", F.lit(None).cast("date")), sessions)
    v = valuation.select(*KEY, F.lit(True).alias("_v"))
    f = factors.where(positive("adj_factor")).select(*KEY, F.lit(True).alias("_f"))
    rows = grid.join(bars.withColumn("_ok", ohlcv_valid()), KEY, "left").join(v, KEY, "left").join(f, KEY, "left")
    stored = F.col("_ok").isNotNull()
    facts = rows.groupBy("ts_code").agg(
        F.count(F.lit(1)).alias("expected"),
        F.count(F.when(stored, 1)).alias("observed"),
        F.count(F.when(stored & ~F.col("_ok"), 1)).alias("invalid"),
        F.count(F.when(stored & F.col("_v").isNull(), 1)).alias("no_valuation"),
        F.count(F.when(F.col("_f").isNull(), 1)).alias("no_factor"),
    )
    every = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(_PROFILE, p)]) for p in PROFILES])
    both = facts.withColumn("_p", F.explode(every)).select(*facts.columns, "_p.*")
    issues = F.array_compact(
        F.array(
            F.when(F.col("observed") < F.col("expected"), "MISSING_SESSIONS"),
            F.when(F.col("invalid") > 0, "INVALID_DAILY"),
            F.when(F.col("needs_valuation") & (F.col("no_valuation") > 0), "MISSING_REQUIRED_FIELDS"),
            F.when(F.col("needs_factors") & (F.col("no_factor") > 0), "MISSING_FACTORS"),
        )
    )
    potential = F.greatest(F.col("observed") - F.col("warmup") - F.col("sequence") + 2 - F.col("horizon"), F.lit(0))
    out = both.withColumns({"_i": issues, "potential_samples": potential})
    usable = F.when(F.size("_i") == 0, F.col("potential_samples")).otherwise(0)
    out = out.withColumn("mature_samples", usable)
    short = F.when(F.col("mature_samples") < F.col("mature"), "INSUFFICIENT_WARMUP_HISTORY")
    reasons = F.concat_ws(",", F.array_sort(F.array_compact(F.array_append("_i", short))))
    return out.select(
        "ts_code", "profile", "expected", "observed", "potential_samples", "mature_samples", reasons.alias("reasons"),
        (reasons == "").alias("data_ready"),
    )


def execution_gaps(prices: DataFrame, factors: DataFrame, limits: DataFrame) -> DataFrame:
    """Bars that lack a positive factor or a positive pair of limits."""
    rows = prices.select(*KEY).join(factors, KEY, "left").join(limits, KEY, "left")
    kinds = F.array_compact(
        F.array(
            F.when(~positive("adj_factor"), "adj_factor"),
            F.when(~(positive("up_limit") & positive("down_limit")), "stk_limit"),
        )
    )
    return rows.select(F.explode(kinds).alias("kind"), *KEY)


def retry_ledger(tasks: DataFrame, max_retry: int = 5) -> DataFrame:
    """Per source: failed work, what may be retried, what has used its attempts. Successes are skipped."""
    failed = F.col("status").isin("FAILED", "PARTIAL_SUCCESS")
    spent = F.col("retry_count") >= max_retry

    def count(c):
        return F.count(F.when(c, 1))

    return tasks.groupBy("source").agg(
        F.count(F.lit(1)).alias("tasks"),
        count(F.col("status") == "SUCCESS").alias("already_done"),
        count(failed & ~spent).alias("to_retry"),
        count(failed & spent).alias("skipped_max_retry"),
    )


def publication_class(published: DataFrame, sessions: DataFrame) -> DataFrame:
    """PROSPECTIVE_CANDIDATE before 09:00 (+08:00) of the next session, else LATE_DIAGNOSTIC."""
    rows = target_session(published, sessions, 1, "entry_date").where(F.col("entry_date").isNotNull())
    deadline = F.timestamp_add("HOUR", F.lit(1), F.col("entry_date").cast("timestamp"))  # 01:00 UTC
    status = F.when(F.col("published_at") < deadline, "PROSPECTIVE_CANDIDATE").otherwise("LATE_DIAGNOSTIC")
    return rows.withColumn("status", status)


def frozen_universe(members: DataFrame, group: str = "group_code") -> DataFrame:
    """Members of the newest snapshot per group with 0-based ids in code order."""
    from barspan.operators.tables import latest_snapshot

    newest = latest_snapshot(members)
    ids = value_positions(newest, [group], "ts_code").select(group, "ts_code", F.col("less").alias("member_id"))
    return newest.join(ids, [group, "ts_code"])


def label_audit(stored: DataFrame, recomputed: DataFrame, rtol: float = 1e-9, atol: float = 1e-12) -> DataFrame:
    """Rows compared, label mismatches beyond tolerance, target-date mismatches, unmatched keys."""
    a = stored.select(*KEY, F.col("label").alias("_l"), F.col("label_target_date").alias("_t"), F.lit(1).alias("_a"))
    both = recomputed.select(*KEY, "label", "label_target_date", F.lit(1).alias("_b")).join(a, KEY, "full_outer")
    paired = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    close = (F.abs(F.col("label") - F.col("_l")) <= atol + rtol * F.abs(F.col("label"))) | (
        F.col("label").isNull() & F.col("_l").isNull()
    )
    return both.agg(
        F.count(F.when(paired, 1)).alias("compared"),
        F.count(F.when(paired & ~F.coalesce(close, F.lit(False)), 1)).alias("label_mismatches"),
        F.count(F.when(paired & ~F.col("_t").eqNullSafe(F.col("label_target_date")), 1)).alias("target_mismatches"),
        F.count(F.when(~paired, 1)).alias("unmatched"),
    )


def append_after(full: DataFrame, cached_max) -> DataFrame:
    """Rows to append to a cache that ends on ``cached_max``; ``full`` was computed on whole history."""
    return full.where(F.col("trade_date") > F.lit(cached_max).cast("date"))
