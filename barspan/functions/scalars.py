"""Column expressions shared by the jobs. All stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Identity and event formats the data contract prescribes.
# The contract's codes have six digits; wider bodies are allowed so that any number of instruments has codes.
CODE_PATTERN = r"^[0-9]{6,}\.(SZ|SH|BJ)$"
EXCLUDED_PREFIXES = ("8", "4")
PRICE = T.DecimalType(20, 6)
AMOUNT = T.DecimalType(24, 4)
INDICATOR = T.DecimalType(38, 6)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_code(code, bj_920: bool = True) -> Column:
    """Digits -> code with exchange suffix; a code that has a suffix is only cleaned."""
    text = F.upper(F.trim(_c(code)))
    beijing = text.rlike("^[48]")
    if bj_920:
        beijing = beijing | text.startswith("920")
    suffix = F.when(beijing, ".BJ").when(text.rlike("^[69]"), ".SH").otherwise(".SZ")
    return F.when(text.contains("."), text).otherwise(F.concat(text, suffix))


def index_code(code) -> Column:
    text = F.trim(_c(code))
    return F.when(text.contains("."), text).otherwise(
        F.concat(text, F.when(text.startswith("399"), ".SZ").otherwise(".SH"))
    )


def is_a_share(code) -> Column:
    """Shanghai 60/68 and Shenzhen 0/30 boards, exchange suffix in agreement."""
    return F.coalesce(_c(code).rlike(r"^(6[08][0-9]{4,}\.SH|(0[0-9]|30)[0-9]{4,}\.SZ)$"), F.lit(False))


def rescale(col, precision: int, scale: int) -> Column:
    """HALF_UP to the declared type; out of range becomes null (check with ``overflows``)."""
    return _c(col).try_cast(T.DecimalType(precision, scale))


def overflows(col, precision: int, scale: int) -> Column:
    return _c(col).isNotNull() & rescale(col, precision, scale).isNull()


def float32_image(col, scale: int = 6) -> Column:
    """The decimal a binary32 store would hold for this value."""
    return _c(col).cast("float").cast("double").cast(T.DecimalType(38, scale))


def compact_date(col) -> Column:
    return F.date_format(_c(col), "yyyyMMdd")


def session_day(text) -> Column:
    """``yyyyMMdd`` or ISO text -> date; anything else is null."""
    t = F.trim(_c(text))
    dashed = F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2))
    return F.when(t.rlike("^[0-9]{8}$"), dashed.try_cast("date")).when(
        t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), t.try_cast("date")
    )


def session_completed(day, as_of) -> Column:
    """A session counts only strictly after 16:00 at +08:00, i.e. 08:00 UTC."""
    return F.timestamp_add("HOUR", F.lit(8), _c(day).cast("timestamp")) < _c(as_of)


def return_class(ret) -> Column:
    """Five left-closed classes with cuts at -3 %, -1 %, 1 % and 3 %."""
    r = _c(ret)
    return (
        F.when(r < -0.03, 0).when(r < -0.01, 1).when(r < 0.01, 2).when(r < 0.03, 3).when(r.isNotNull(), 4)
    )


def finite(col) -> Column:
    """The value, or null for NaN and infinities (and no negative zero)."""
    c = _c(col)
    ok = ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.when(ok, c + F.lit(0.0))


def positive(col) -> Column:
    return F.coalesce(_c(col) > 0, F.lit(False))


def price_anomaly() -> Column:
    o, h, low, c = (F.col(n) for n in ("open", "high", "low", "close"))
    return (c <= 0) | (h < low) | (o < low) | (o > h)


def ohlcv_valid() -> Column:
    """Finite, positive prices, non-negative volume, high and low bound the rest."""
    prices = [finite(n) for n in ("open", "high", "low", "close")]
    ok = F.lit(True)
    for p in prices:
        ok = ok & (p > 0)
    o, h, low, c = prices
    ok = ok & (h >= F.greatest(o, low, c)) & (low <= F.least(o, h, c)) & (finite("vol") >= 0)
    return F.coalesce(ok, F.lit(False))


def adjusted_vwap(amount, vol, multiplier) -> Column:
    """amount (thousands) and vol (lots) -> price per share in the adjusted regime; 0 without volume."""
    a, v, m = _c(amount), _c(vol), _c(multiplier)
    return F.when(v == 0, F.lit(0.0)).otherwise(a * 10 / v * m)
