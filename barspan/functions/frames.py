"""Row frames over one instrument.

``(ts_code, trade_date)`` is unique in every panel, so a ``ts_code`` partition holds at
most one row per calendar day however large the market data behind it is: the daily bar
aggregation has already collapsed a hot instrument before a frame sees it.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

KEY = ("ts_code", "trade_date")


def by_code():
    return Window.partitionBy("ts_code").orderBy("trade_date")


def last_rows(n: int):
    return by_code().rowsBetween(-(n - 1), 0)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def rolling(agg, col, n: int) -> Column:
    """``agg`` over the last ``n`` rows, null while fewer than ``n`` values exist."""
    c, w = _c(col), last_rows(n)
    return F.when(F.count(c).over(w) >= n, agg(c).over(w))


def rolling_list(col, n: int) -> Column:
    """The last ``n`` values in session order; null until the frame is full."""
    c, w = _c(col), last_rows(n)
    return F.when(F.count(c).over(w) >= n, F.collect_list(c).over(w))


def previous(col, n: int = 1) -> Column:
    return F.lag(_c(col), n).over(by_code())


def following(col, n: int = 1) -> Column:
    return F.lead(_c(col), n).over(by_code())


def change(col, n: int = 1) -> Column:
    return F.try_divide(_c(col), previous(col, n)) - 1


def safe_corr(x, y) -> Column:
    """Pairwise-complete Pearson correlation; null (never an error) where a side is constant."""
    x, y = _c(x), _c(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def nonzero(col) -> Column:
    c = _c(col)
    return F.when(c != 0, c)


def computed_once(df, columns: dict[str, Column]):
    """Add columns behind a generator.

    Spark would otherwise inline an expensive expression into every later filter and
    projection that mentions it; a generator's output is computed once per row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
