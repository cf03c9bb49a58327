"""Sequence-model inputs: the 39 and 158 feature sets, cross-section features, windows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barspan.functions.frames import by_code, change, following, last_rows, previous, rolling
from barspan.functions.ranks import average_rank, position_quantile, positioned, ranked_measures
from barspan.functions.scalars import finite
from barspan.operators.technical import _mean_seeded, ema_values, macd_values, rsi_values
from barspan.session import cut_lineage

EPS = 1e-12
WINDOWS = (5, 10, 20, 30, 60)
KEY = ["ts_code", "trade_date"]

# Feature names of the 39 set beyond the eight market columns.
SET_39 = [
    "sma_5", "sma_20", "ema_12", "ema_26", "rsi", "macd", "macd_signal", "volume_change", "obv",
    "volume_ma_5", "volume_ma_20", "volume_ratio", "kdj_k", "kdj_d", "kdj_j", "boll_mid", "boll_std",
    "atr_14", "ema_60", "volatility_10", "volatility_20", "return_1", "return_5", "return_10",
    "high_low_spread", "open_close_spread", "high_close_spread", "low_close_spread", "daily_standard_deviation",
]
CROSS_SECTION = [
    "cs_return_pct", "cs_volume_pct", "cs_turnover_pct", "cs_amplitude_pct",
    "cs_excess_return", "cs_price_deviation", "cs_price_pct", "cs_relative_amplitude",
]


def zero_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null, NaN and infinite features become 0."""
    return df.withColumns({c: F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)) for c in columns})


def normalize_panel(df: DataFrame) -> DataFrame:
    """Change, change rate and amplitude against the previous close."""
    pc = previous("close")
    return df.withColumns(
        {
            "change": F.col("close") - pc,
            "pct_chg": (F.col("close") - pc) / (pc + EPS) * 100,
            "amplitude": (F.col("high") - F.col("low")) / (pc + EPS) * 100,
        }
    )


# -- 39 set -------------------------------------------------------------------------
def _running(agg, col) -> Column:
    return agg(col).over(by_code().rowsBetween(Window.unboundedPreceding, 0))


def _with_decayed_deviation(df: DataFrame, col: str, out: str, half_life: float = 42, min_rows: int = 252) -> DataFrame:
    """Bias-corrected exponentially weighted deviation from running weighted sums.

    Row ``i`` weighs ``2^(i / half_life)``; the common factor cancels, so plain running
    sums are enough and the weights stay far below overflow for any real calendar.
    """
    w = F.pow(F.lit(2.0), F.row_number().over(by_code()) / F.lit(half_life))
    df = df.withColumn("_w", F.when(F.col(col).isNotNull(), w))
    s0, s1 = _running(F.sum, F.col("_w")), _running(F.sum, F.col("_w") * F.col(col))
    s2, ww = _running(F.sum, F.col("_w") * F.col(col) * F.col(col)), _running(F.sum, F.col("_w") * F.col("_w"))
    variance = (s2 / s0 - (s1 / s0) * (s1 / s0)) * (s0 * s0) / (s0 * s0 - ww)
    enough = _running(F.count, F.col(col)) >= min_rows
    return df.withColumn(out, F.when(enough, F.sqrt(F.greatest(variance, F.lit(0.0))))).drop("_w")


def _stochastic(n: int = 9, smooth: int = 3) -> dict[str, Column]:
    low, high = rolling(F.min, "low", n), rolling(F.max, "high", n)
    return {"_fast_k": F.when(high == low, F.lit(0.0)).otherwise((F.col("close") - low) / (high - low) * 100)}


def _group_39(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("trade_date")
    c, h, low = (rows[n].to_numpy() for n in ("close", "high", "low"))
    pc = np.r_[np.nan, c[:-1]]
    true_range = np.fmax(h - low, np.fmax(np.abs(h - pc), np.abs(low - pc)))
    dif, dea, _ = macd_values(c, "library")
    new = {
        "ema_12": ema_values(c, 12, "library"),
        "ema_26": ema_values(c, 26, "library"),
        "ema_60": ema_values(c, 60, "library"),
        "macd": dif,
        "macd_signal": dea,
        "rsi": rsi_values(c, "library"),
        "atr_14": _mean_seeded(true_range, 14, 1 / 14, 1),
    }
    for name, values in new.items():
        rows = rows.append_column(name, pa.array(values, from_pandas=True))
    return rows


_GROUP_39 = ["ema_12", "ema_26", "ema_60", "macd", "macd_signal", "rsi", "atr_14"]


def features_39(df: DataFrame, swapped_bands: bool = False) -> DataFrame:
    """The 39 set, zero-filled.

    ``swapped_bands`` reproduces stored models whose band triple was unpacked in the
    wrong order: ``boll_mid`` then holds the upper band and ``boll_std`` is negative.
    """
    c, h, low, o, v = (F.col(n) for n in ("close", "high", "low", "open", "vol"))
    mid, dev = rolling(F.avg, "close", 20), rolling(F.stddev_pop, "close", 20)
    step = F.when(previous("close").isNull(), v).otherwise(F.signum(c - previous("close")) * v)
    staged = df.withColumns(
        {
            "return_1": change("close"),
            "return_5": change("close", 5),
            "return_10": change("close", 10),
            "volume_change": change("vol"),
            "_obv_step": step,
            "sma_5": rolling(F.avg, "close", 5),
            "sma_20": mid,
            "boll_mid": mid + 2 * dev if swapped_bands else mid,
            "boll_std": -dev if swapped_bands else dev,
            "volume_ma_5": rolling(F.avg, "vol", 5),
            "volume_ma_20": rolling(F.avg, "vol", 20),
            "high_low_spread": h - low,
            "open_close_spread": o - c,
            "high_close_spread": h - c,
            "low_close_spread": low - c,
            **_stochastic(),
        }
    )
    staged = staged.withColumns(
        {
            "obv": _running(F.sum, F.col("_obv_step")),
            "volume_ratio": F.try_divide("volume_ma_5", "volume_ma_20"),
            "volatility_10": rolling(F.stddev_samp, "return_1", 10),
            "volatility_20": rolling(F.stddev_samp, "return_1", 20),
            "_slow_k": rolling(F.avg, "_fast_k", 3),
        }
    )
    slow_d = rolling(F.avg, "_slow_k", 3)
    staged = staged.withColumns({"kdj_d": slow_d, "kdj_k": F.when(slow_d.isNotNull(), F.col("_slow_k"))})
    staged = staged.withColumn("kdj_j", 3 * F.col("kdj_k") - 2 * F.col("kdj_d"))
    staged = _with_decayed_deviation(staged, "return_1", "daily_standard_deviation")
    staged = staged.drop("_obv_step", "_fast_k", "_slow_k")
    schema = T.StructType(staged.schema.fields + [T.StructField(n, T.DoubleType()) for n in _GROUP_39])
    out = staged.groupBy("ts_code").applyInArrow(_group_39, schema)
    return zero_filled(out, SET_39).select(*df.columns, *SET_39)


# -- 158 set ------------------------------------------------------------------------
def candle_shapes() -> dict[str, Column]:
    o, h, low, c = (F.col(n) for n in ("open", "high", "low", "close"))
    body_top, body_low, span = F.greatest(o, c), F.least(o, c), h - low + EPS
    vwap = F.col("amount") / (F.col("vol") + EPS)
    return {
        "KMID": (c - o) / (o + EPS),
        "KLEN": (h - low) / (o + EPS),
        "KMID2": (c - o) / span,
        "KUP": (h - body_top) / (o + EPS),
        "KUP2": (h - body_top) / span,
        "KLOW": (body_low - low) / (o + EPS),
        "KLOW2": (body_low - low) / span,
        "KSFT": (2 * c - h - low) / (o + EPS),
        "KSFT2": (2 * c - h - low) / span,
        "OPEN0": o / (c + EPS),
        "HIGH0": h / (c + EPS),
        "LOW0": low / (c + EPS),
        "VWAP0": vwap / (c + EPS),
    }


def _steps() -> dict[str, Column]:
    c, v = F.col("close"), F.col("vol")
    pc, pv = previous("close"), previous("vol")
    move, flow = c - pc, v - pv
    return {
        "_n": F.row_number().over(by_code()).cast("double"),
        "_logv": F.log(v + 1),
        "_cr": F.coalesce(c / pc, F.lit(0.0)),
        "_vr": F.coalesce(F.log(v / (pv + EPS) + 1), F.lit(0.0)),
        "_up": F.when(c > pc, 1.0).otherwise(0.0),
        "_dn": F.when(c < pc, 1.0).otherwise(0.0),
        "_gain": F.greatest(move, F.lit(0.0) + move * 0),
        "_loss": F.greatest(-move, F.lit(0.0) + move * 0),
        "_vgain": F.greatest(flow, F.lit(0.0) + flow * 0),
        "_vloss": F.greatest(-flow, F.lit(0.0) + flow * 0),
        "_wret": F.abs(c / pc - 1) * v,
    }


class Frame:
    """The last ``w`` rows of every row of one instrument, from its ``w``-th row on, for several columns at once.

    Nulls are NaN and take no part. Values are shifted by one of the frame's own before they are summed, so a constant
    frame has exactly no deviation. Every result has a row per column.
    """

    def __init__(self, values: np.ndarray, w: int):
        self.rows = np.lib.stride_tricks.sliding_window_view(values, w, axis=1)
        self.whole = not np.isnan(values).any()
        if self.whole:
            self.n = np.full(self.rows.shape[:2], float(w))
            self.shift = self.rows[..., 0]
            moved = self.rows - self.shift[..., None]
            low = np.einsum("kij->ki", moved) / w
            moved -= low[..., None]
        else:
            self.known = ~np.isnan(self.rows)
            self.n = self.known.sum(2).astype(float)
            self.shift = np.where(self.known, self.rows, -np.inf).max(2)
            moved = np.where(self.known, self.rows - self.shift[..., None], 0.0)
            low = moved.sum(2) / self.n
            moved = np.where(self.known, moved - low[..., None], 0.0)
        self.mean, self.dev = self.shift + low, moved
        self.squares = np.einsum("kij,kij->ki", self.dev, self.dev)
        self.deviation = np.sqrt(self.squares / self.n)

    def sample_deviation(self, k: int) -> np.ndarray:
        return np.sqrt(self.squares[k] / np.where(self.n[k] > 1, self.n[k] - 1, np.nan))

    def correlation(self, a: int, b: int) -> np.ndarray:
        """Population covariance of the pairs of two columns over both deviations; NaN where a side is constant."""
        if self.whole:
            covariance = np.einsum("ij,ij->i", self.dev[a], self.dev[b]) / self.n[a]
        else:
            both = self.known[a] & self.known[b]
            n = both.sum(1)
            x, y = np.where(both, self.dev[a], 0.0), np.where(both, self.dev[b], 0.0)
            covariance = (np.einsum("ij,ij->i", x, y) - x.sum(1) * y.sum(1) / n) / n
        scale = self.deviation[a] * self.deviation[b]
        return covariance / np.where(scale == 0, np.nan, scale)


def _sums(values: np.ndarray, w: int) -> np.ndarray:
    """Sums of each column over the last ``w`` rows, without nulls; NaN where there are only nulls."""
    rows = np.lib.stride_tricks.sliding_window_view(values, w, axis=1)
    if not np.isnan(values).any():
        return np.einsum("kij->ki", rows)
    known = ~np.isnan(rows)
    return np.where(known.any(2), np.where(known, rows, 0.0).sum(2), np.nan)


def _lagged(values: np.ndarray, n: int) -> np.ndarray:
    return np.r_[np.full(min(n, len(values)), np.nan), values[:-n]]


def trend_family(rows: dict[str, np.ndarray], w: int) -> dict[str, np.ndarray]:
    """ROC, MA, STD and the regression trio on the last ``w`` closes."""
    c = rows["close"]
    now, f = c[w - 1 :], Frame(c[None], w)
    unit = now + EPS
    # least squares on 0..w-1: the x moments are constants of the window length
    x, sxx = np.arange(w) - (w - 1) / 2, w * (w * w - 1) / 12
    mean, dev = f.mean[0], f.deviation[0]
    if f.whole:
        sxy = np.einsum("ij,j->i", f.dev[0], x)
    else:  # absent values add nothing, the mean stands for all rows
        held = np.where(f.known[0], f.rows[0], 0.0)
        sxy = held @ x + (np.arange(len(held)) + (w + 1) / 2) * (held.sum(1) - mean * w)
    slope = sxy / sxx
    share = slope * slope * sxx / np.where(dev > 0, dev * dev * w, np.nan)
    return {
        f"ROC{w}": _lagged(c, w)[w - 1 :] / unit,
        f"MA{w}": mean / unit,
        f"STD{w}": dev / unit,
        f"BETA{w}": slope / unit,
        f"RSQR{w}": np.where(share > 1, 1.0, share),
        f"RESI{w}": (now - (mean + slope * ((w - 1) / 2))) / unit,
    }


def _extremes(values: np.ndarray, windows) -> dict[int, np.ndarray]:
    """Per window length the first place of the largest value among the last rows, for all lengths in one sweep.

    Places of the maximum over 1, 2, 4... rows are doubled; a window is two such blocks that overlap.
    Rows without a full window keep place -1.
    """
    n = len(values)
    best, out, size = np.arange(n), {}, 1
    for w in sorted(windows):
        while 2 * size <= w and n > size:
            later, earlier = best[size:], best[:-size]
            best = np.concatenate([best[:size], np.where(values[later] > values[earlier], later, earlier)])
            size *= 2
        place = np.full(n, -1, np.int64)
        if n >= w:
            late, early = best[w - 1 :], best[size - 1 : n - w + size]
            place[w - 1 :] = np.where(values[late] > values[early], late, early)
        out[w] = place
    return out


def _range_group(windows):
    def per_code(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("trade_date")
        for column, sign, name in (("high", 1.0, "_mx"), ("low", -1.0, "_mn")):
            values = rows[column].to_numpy().astype(np.float64)
            for w, place in _extremes(sign * values, windows).items():
                known = place >= 0
                rows = rows.append_column(f"{name}{w}", pa.array(np.where(known, values[place], 0.0), mask=~known))
                rows = rows.append_column(f"{name}_at{w}", pa.array(place + 1.0, mask=~known))
        return rows

    return per_code


def with_extremes(df: DataFrame, windows) -> DataFrame:
    """Highest high and lowest low of the last rows with their first places (from 1), for every window length.

    One pass over each instrument's rows, at most one per session.
    """
    names = [f"{n}{w}" for n in ("_mx", "_mx_at", "_mn", "_mn_at") for w in windows]
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"{n}{e}{w}", T.DoubleType()) for n in ("_mx", "_mn") for w in sorted(windows) for e in ("", "_at")]])
    return df.groupBy("ts_code").applyInArrow(_range_group(windows), schema).select(*df.columns, *names)


def range_family(w: int) -> dict[str, Column]:
    """Extremes, their first places, and the place of the close between them; needs ``with_extremes``."""
    unit, c, n = F.col("close") + EPS, F.col("close"), F.col("_n")
    top, bottom, at_top, at_bottom = (F.col(f"{x}{w}") for x in ("_mx", "_mn", "_mx_at", "_mn_at"))
    first = n - (w - 1)
    return {
        f"MAX{w}": top / unit,
        f"MIN{w}": bottom / unit,
        f"RSV{w}": (c - bottom) / (top - bottom + EPS),
        f"IMAX{w}": (at_top - first) / w,
        f"IMIN{w}": (at_bottom - first) / w,
        f"IMXD{w}": (at_top - at_bottom) / w,
    }


def order_family(rows: dict[str, np.ndarray], w: int) -> dict[str, np.ndarray]:
    """Quantiles of, and average-rank share in, the last ``w`` closes (at most 60 values a row)."""
    c = rows["close"]
    now, seen = c[w - 1 :], np.lib.stride_tricks.sliding_window_view(c, w)
    ordered, unit = np.sort(seen, axis=1), now + EPS  # nulls stand last

    def quantile(q: float) -> np.ndarray:
        lo = int((w - 1) * q)
        a, b = ordered[:, lo], ordered[:, min(lo + 1, w - 1)]
        return a + (b - a) * ((w - 1) * q - lo)

    less, ties = (seen < now[:, None]).sum(1), (seen == now[:, None]).sum(1)
    return {f"QTLU{w}": quantile(0.8) / unit, f"QTLD{w}": quantile(0.2) / unit, f"RANK{w}": (less + (ties + 1) / 2) / w}


def flow_family(rows: dict[str, np.ndarray], w: int) -> dict[str, np.ndarray]:
    """Correlations, counts of rises, and shares of gains in price and volume."""
    late = np.arange(len(rows["vol"]) - w + 1) > 0  # the first row has no step: frames of steps are full one row later
    first = lambda c: np.r_[0.0, rows[c][1:]]
    f = Frame(np.stack([rows["vol"], rows["close"], rows["_logv"], rows["_cr"], rows["_vr"], first("_wret")]), w)
    up, dn, gain, loss, vgain, vloss = _sums(np.stack([rows["_up"], rows["_dn"], *map(first, ("_gain", "_loss", "_vgain", "_vloss"))]), w)
    unit = rows["vol"][w - 1 :] + EPS
    out = {
        # a constant window has no correlation: null here, 0 after the fill
        f"CORR{w}": f.correlation(1, 2),
        f"CORD{w}": f.correlation(3, 4),
        f"CNTP{w}": up / w,
        f"CNTN{w}": dn / w,
        f"CNTD{w}": up / w - dn / w,
    }
    for tag, g, s in (("SUM", gain, loss), ("VSUM", vgain, vloss)):
        both = np.where(late, g + s + EPS, np.nan)
        out |= {f"{tag}P{w}": g / both, f"{tag}N{w}": s / both, f"{tag}D{w}": (g - s) / both}
    out |= {
        f"VMA{w}": f.mean[0] / unit,
        f"VSTD{w}": f.deviation[0] / unit,
        f"WVMA{w}": np.where(late, f.sample_deviation(5) / (f.mean[5] + EPS), np.nan),
    }
    return out


#: What a family reads of an instrument's rows.
NEEDS = {trend_family: ("close",), order_family: ("close",), flow_family: ("close", "vol", "_logv", "_cr", "_vr", "_up", "_dn", "_gain", "_loss", "_vgain", "_vloss", "_wret")}


def _family_names(family: Callable, windows) -> list[str]:
    blank = {c: np.zeros(max(windows)) for c in NEEDS[family]}
    with np.errstate(all="ignore"):
        return [n for w in windows for n in family(blank, w)]


def _family_group(families, windows, names: list[str]):
    fields = {k: pa.field(k, pa.float64(), nullable=False) for k in names}

    def per_code(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("trade_date", "ascending")], null_placement="at_start"))
        n, out = rows.num_rows, {}
        with np.errstate(all="ignore"):
            for family in families:
                own = {c: rows[c].to_numpy().astype(np.float64) for c in NEEDS[family]}
                for w in (w for w in windows if w <= n):
                    out |= family(own, w)
        for k in names:
            v = np.zeros(n)
            if k in out:
                v[n - len(out[k]) :] = np.where(np.isfinite(out[k]), out[k], 0.0)
            rows = rows.append_column(fields[k], pa.array(v))
        return rows

    return per_code


def with_families(df: DataFrame, families, windows) -> DataFrame:
    """Adds the columns of trend, order and flow families, zero-filled: one pass over each instrument's rows, at most one per session."""
    names = [n for family in families for n in _family_names(family, windows)]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType(), False) for n in names]])
    return df.groupBy("ts_code").applyInArrow(_family_group(families, windows, names), schema)


FAMILIES = (trend_family, range_family, order_family, flow_family)


def features_158(df: DataFrame, families=FAMILIES, windows=WINDOWS) -> DataFrame:
    """Candle shapes plus the windowed families, in grouped passes over the same partitioning."""
    keep = df.columns
    out = df.withColumns(_steps())
    grouped = [f for f in families if f in NEEDS]
    if grouped:
        used = {c for f in grouped for c in NEEDS[f]}
        out = with_families(out.drop(*[c for c in _steps() if c not in used and c != "_n"]), grouped, windows)
    if range_family in families:
        out = with_extremes(out, windows)
        out = out.withColumns(reduce(lambda a, b: a | b, (range_family(w) for w in windows)))
    names, ready = list(candle_shapes()), set()
    for family in families:
        own = _family_names(family, windows) if family in NEEDS else list(reduce(lambda a, b: a | b, (range_family(w) for w in windows)))
        ready |= set(own) if family in NEEDS else set()
        names += own
    return zero_filled(out.withColumns(candle_shapes()), [n for n in names if n not in ready]).select(*keep, *names)


# -- cross section ------------------------------------------------------------------
def cross_section(df: DataFrame, minimum: int = 10) -> DataFrame:
    """Keys and eight per-date features; dates with fewer than ``minimum`` instruments stay 0.

    Ranks and medians go through the bucketed positions, averages through a map-side
    combined aggregation, so no task ever holds a whole date.
    """
    measures = ["pct_chg", "vol", "turnover_rate", "amplitude", "close"]
    wide, pos = ranked_measures(df, KEY, "trade_date", measures)
    day = wide.groupBy("trade_date").agg(F.count(F.lit(1)).alias("_size"), F.avg("pct_chg").alias("_mean"))
    centred = {c: measures.index(c) for c in ("close", "amplitude")}
    pos = pos.where(F.col("measure").isin(list(centred.values())))
    middle = position_quantile(pos, ["trade_date", "measure"], "value", 0.5, "_mid")
    middle = middle.groupBy("trade_date").agg(
        *[F.max(F.when(F.col("measure") == i, F.col("_mid"))).alias(f"_mid_{c}") for c, i in centred.items()]
    )
    # one row per session: at most one per calendar day
    joined = wide.join(F.broadcast(day.join(middle, "trade_date", "left")), "trade_date", "left")
    raw = {
        "cs_return_pct": F.col("pct_chg_rank") / F.col("_size"),
        "cs_volume_pct": F.col("vol_rank") / F.col("_size"),
        "cs_turnover_pct": F.col("turnover_rate_rank") / F.col("_size"),
        "cs_amplitude_pct": F.col("amplitude_rank") / F.col("_size"),
        "cs_excess_return": F.col("pct_chg") - F.col("_mean"),
        "cs_price_deviation": (F.col("close") - F.col("_mid_close")) / (F.col("_mid_close") + EPS),
        "cs_price_pct": F.col("close_rank") / F.col("_size"),
        "cs_relative_amplitude": F.col("amplitude") / (F.col("_mid_amplitude") + EPS),
    }
    live = F.col("_size") >= minimum
    out = {n: F.when(live, F.coalesce(finite(e), F.lit(0.0))).otherwise(F.lit(0.0)) for n, e in raw.items()}
    return joined.select(*KEY, *[e.alias(n) for n, e in out.items()])


# -- labels and windows -------------------------------------------------------------
def open_to_open_label(df: DataFrame) -> DataFrame:
    """Return from the next open to the fifth open, its target date, and the validation flag."""
    nxt, fifth = following("open"), following("open", 5)
    last = df.agg(F.max("trade_date").alias("d")).select(F.add_months("d", -2)).scalar()
    return df.withColumns(
        {
            "label": F.when(nxt > 1e-4, (fifth - nxt) / (nxt + EPS)),
            "label_target_date": following("trade_date", 5),
            "is_val": F.col("trade_date") >= last,
        }
    )


def window_index(df: DataFrame, features: list[str], length: int, minimum: int = 10) -> DataFrame:
    """Which windows there are: one small row per instrument-date that owns ``length`` finite rows and a finite label.

    Dates keep only if at least ``minimum`` instruments qualify. Relevance counts down
    from the best label; two binary labels compare with the date's median and with zero. A window is named by
    its last row (``last_row``, from 0 within the instrument), so an index grows with the panel and not with the length.
    """
    w = last_rows(length)
    ok = reduce(lambda a, b: a & b, [finite(c).isNotNull() for c in features])
    rows = df.withColumn("_ok", F.when(ok, 1).otherwise(0)).withColumns({"_good": F.sum("_ok").over(w), "last_row": F.row_number().over(by_code()) - 1})
    eligible = cut_lineage(rows.where((F.col("_good") == length) & finite("label").isNotNull()).select(*KEY, "label", "last_row"), "eligible")
    sizes = eligible.groupBy("trade_date").agg(F.count(F.lit(1)).alias("instruments")).where(F.col("instruments") >= minimum)
    kept = eligible.join(F.broadcast(sizes), "trade_date")  # one row per session
    pos = positioned(kept, ["trade_date"], "label")
    median = position_quantile(pos, ["trade_date"], "label", 0.5, "median_label")
    marked = pos.join(F.broadcast(median), "trade_date")  # one row per session
    return marked.select(
        *KEY,
        "label",
        "last_row",
        "instruments",
        average_rank().alias("relevance"),
        (F.col("label") > F.col("median_label")).cast("int").alias("above_median"),
        (F.col("label") > 0).cast("int").alias("rises"),
    )


def _gather(features: list[str], length: int, schema: pa.Schema):
    def per_code(index: pa.Table, panel: pa.Table) -> pa.Table:
        panel = panel.sort_by("trade_date")
        values = np.column_stack([panel[c].to_numpy().astype(np.float32) for c in features])
        rows = index["last_row"].to_numpy()[:, None] + np.arange(1 - length, 1)
        flat = pa.array(values[rows].ravel())
        steps = pa.FixedSizeListArray.from_arrays(flat, len(features)).cast(pa.list_(pa.float32()))
        windows = pa.FixedSizeListArray.from_arrays(steps, length).cast(pa.list_(pa.list_(pa.float32())))
        return index.append_column("window", windows).select(schema.names)

    return per_code


def gather_windows(index: DataFrame, df: DataFrame, features: list[str], length: int) -> DataFrame:
    """The indexed windows as arrays, cut out of the panel when they are read.

    Panel and index meet per instrument; a window is copied only into the rows that are handed on.
    """
    panel = df.select(*KEY, *[F.col(c).cast("float").alias(c) for c in features])
    out = T.StructType([*index.schema.fields, T.StructField("window", T.ArrayType(T.ArrayType(T.FloatType())))])
    gather = _gather(features, length, to_arrow_schema(out))
    return index.groupBy("ts_code").cogroup(panel.groupBy("ts_code")).applyInArrow(gather, out)


def sequence_windows(df: DataFrame, features: list[str], length: int, minimum: int = 10) -> DataFrame:
    """``window_index`` with the windows themselves."""
    return gather_windows(window_index(df, features, length, minimum), df, features, length).drop("last_row")


def common_session_windows(df: DataFrame, features: list[str], length: int) -> DataFrame:
    """Sessions whose last ``length`` sessions are complete for **every** instrument."""
    sessions = df.select("trade_date").distinct()
    numbered = sessions.withColumn("session", F.row_number().over(Window.orderBy("trade_date")))  # calendar-bounded
    w = last_rows(length)
    ok = reduce(lambda a, b: a & b, [finite(c).isNotNull() for c in features])
    rows = df.join(F.broadcast(numbered), "trade_date").withColumn("_ok", F.when(ok, 1).otherwise(0))
    rows = rows.withColumns({"_good": F.sum("_ok").over(w), "_first": F.min("session").over(w), "_rows": F.count("session").over(w)})
    aligned = (F.col("_good") == length) & (F.col("session") - F.col("_first") == length - 1)
    pool = df.agg(F.count_distinct("ts_code").alias("n")).select("n").scalar()
    per_day = rows.groupBy("trade_date", "session").agg(F.count(F.when(aligned, 1)).alias("aligned"))
    return per_day.where(F.col("session") >= length).select(
        "trade_date", "aligned", (F.col("aligned") == pool).alias("complete")
    )


def window_eligibility(df: DataFrame, features: list[str], length: int, boundary, minimum: int = 10) -> DataFrame:
    """Per instrument: does it join a date with enough eligible peers in train and in validation?"""
    w = last_rows(length)
    ok = reduce(lambda a, b: a & b, [finite(c).isNotNull() for c in features])
    rows = df.withColumn("_ok", F.when(ok, 1).otherwise(0)).withColumn("_good", F.sum("_ok").over(w))
    eligible = rows.where((F.col("_good") == length) & finite("label").isNotNull()).select(*KEY)
    dates = eligible.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= minimum)
    phase = F.when(F.col("trade_date") < F.lit(boundary).cast("date"), "train").otherwise("validation")
    seen = eligible.join(F.broadcast(dates), "trade_date", "left_semi").withColumn("phase", phase)
    hits = seen.groupBy("ts_code").agg(
        F.count(F.when(F.col("phase") == "train", 1)).alias("train_dates"),
        F.count(F.when(F.col("phase") == "validation", 1)).alias("validation_dates"),
    )
    members = df.select("ts_code").distinct()
    out = members.join(hits, "ts_code", "left").na.fill(0, ["train_dates", "validation_dates"])
    return out.withColumn("covered", (F.col("train_dates") > 0) & (F.col("validation_dates") > 0))
