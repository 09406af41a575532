"""Price-change and label column expressions.

Rules used throughout:
* NaN becomes NULL at the source (``nan_to_null``) because Spark orders NaN above
  every number, so ``abs(NaN) >= t`` would be TRUE; Python says False.
* Every division is ``try_divide`` (ANSI mode raises on ``/ 0``).
* Offsets are *trading rows* of a series, taken with ``lead``/``lag`` over a window
  partitioned by symbol; never calendar days.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (reference defaults).
SIG_THRESHOLD_TREND = 1.0        # significant / trend threshold, percent
SIG_THRESHOLD_STOCK_TABLE = 2.0  # significance used by the stock table
MULTICLASS_THRESHOLD = 1.0       # up / down / flat threshold, percent
INSIG_THRESHOLD = 0.05           # insignificance threshold, percent
BUFFER_LOWER = 0.2               # rows with LOWER < |change| < UPPER are dropped
BUFFER_UPPER = 0.7
# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def series_window(key: str = "symbol", order: str = "date") -> WindowSpec:
    """W(sym): one price series per key, in date order."""
    return Window.partitionBy(key).orderBy(order)


def nan_to_null(c) -> Column:
    c = _col(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def change_next_open(open_col="open", w: WindowSpec | None = None) -> Column:
    """L1: (next open - open) / open * 100; NULL on the newest row."""
    w = w or series_window()
    o = _col(open_col)
    return F.try_divide(F.lead(o, 1).over(w) - o, o) * F.lit(100.0)


def change_next_close(close_col="close", w: WindowSpec | None = None) -> Column:
    """L2: (1 - next close / close) * -100.

    The reference shifts the close column and then divides the shifted column
    by its own shift, so the oldest row of a series is NULL as well as the
    newest one (no next close).
    """
    w = w or series_window()
    c = _col(close_col)
    has_older = F.lag(F.lit(1), 1).over(w).isNotNull()
    cur = F.when(has_older, c)
    return (F.lit(1.0) - F.try_divide(F.lead(c, 1).over(w), cur)) * F.lit(-100.0)


def change_intraday(open_col="open", close_col="close") -> Column:
    """L3: (close / open - 1) * 100."""
    return (F.try_divide(_col(close_col), _col(open_col)) - F.lit(1.0)) * F.lit(100.0)


def significant(x, threshold: float = SIG_THRESHOLD_TREND) -> Column:
    """L4: 1 if |x| >= threshold else 0 (NULL/NaN -> 0)."""
    x = nan_to_null(x)
    return F.when(F.abs(x) >= F.lit(threshold), F.lit(1)).otherwise(F.lit(0))


def insignificant(x, threshold: float = INSIG_THRESHOLD) -> Column:
    """1 if |x| <= threshold else 0 (NULL/NaN -> 0)."""
    x = nan_to_null(x)
    return F.when(F.abs(x) <= F.lit(threshold), F.lit(1)).otherwise(F.lit(0))


def direction_multiclass(x, threshold: float = MULTICLASS_THRESHOLD) -> Column:
    """+1 / -1 when |x| >= threshold, else 0 (NULL -> 0)."""
    x = nan_to_null(x)
    return (F.when((F.abs(x) >= F.lit(threshold)) & (x > 0), F.lit(1))
             .when(F.abs(x) >= F.lit(threshold), F.lit(-1))
             .otherwise(F.lit(0)))


def trend(x, threshold: float = SIG_THRESHOLD_TREND) -> Column:
    """1 up, 0 down when |x| >= threshold; NULL below it."""
    x = nan_to_null(x)
    return F.when(F.abs(x) >= F.lit(threshold), (x > 0).cast("int"))


def outside_buffer(x, lower: float = BUFFER_LOWER, upper: float = BUFFER_UPPER) -> Column:
    """L8 predicate: keep rows *not* strictly inside (lower, upper) in absolute value."""
    a = F.abs(nan_to_null(x))
    return F.coalesce(~((a > F.lit(lower)) & (a < F.lit(upper))), F.lit(True))


def label_remap(label) -> Column:
    """Label 0 becomes -1."""
    lab = _col(label)
    return F.when(lab == 0, F.lit(-1)).otherwise(lab)


def nan_to_zero(arr) -> Column:
    """NaN / NULL elements of a history array become 0.0."""
    return F.transform(_col(arr), lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))


def direction_from_price(pred_change) -> Column:
    """>0 -> 1, <=0 -> 0, NULL/NaN -> -1."""
    x = nan_to_null(pred_change)
    return F.when(x > 0, F.lit(1)).when(x <= 0, F.lit(0)).otherwise(F.lit(-1))


def slice_history(changes, n: int, include_today: bool = False) -> Column:
    """``n`` history values; with today's change first when ``include_today``.

    ``changes`` is ``array(today, prev_1, ..., prev_20)``.
    """
    start = 1 if include_today else 2
    length = n + 1 if include_today else n
    return F.slice(_col(changes), start, length)


def lags(c, n: int, w: WindowSpec, default=None, start: int = 1) -> Column:
    """``array(lag(c, start), ..., lag(c, start+n-1))`` over ``w``."""
    c = _col(c)
    items = []
    for i in range(start, start + n):
        v = c if i == 0 else F.lag(c, i).over(w)
        items.append(v if default is None else F.coalesce(v, F.lit(default)))
    return F.array(*items)
