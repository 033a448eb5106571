"""Range, membership and class filters.

Filters are plain column predicates so Catalyst pushes them to the parquet scan. The float32 window
(P3) is not pushable as written (the column is cast), so a redundant, slightly wider double
predicate is added in front of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventframe.constants import LOAD_WINDOW, SELECT_WINDOW

__all__ = ["window_half_open", "window_closed_f32", "window_closed", "gather"]


def window_half_open(df: DataFrame, col: str = "dimuon_mass", window=SELECT_WINDOW) -> DataFrame:
    """``lo <= m < hi`` (curation). NaN and null are dropped."""
    lo, hi = window
    return df.where((F.col(col) >= F.lit(lo)) & (F.col(col) < F.lit(hi)))


def window_closed_f32(df: DataFrame, col: str = "dimuon_mass", window=LOAD_WINDOW) -> DataFrame:
    """``lo <= float32(m) <= hi`` (loading). 135.0000001 is kept because it rounds to 135.0.

    The leading double predicate is wider than half a float32 ulp at the window ends, so it never
    removes a row the float32 test keeps, and it is the part that reaches ``PushedFilters``.
    """
    lo, hi = window
    margin = max(abs(lo), abs(hi)) * 2.0**-22
    m = F.col(col)
    return df.where(
        (m >= F.lit(lo - margin)) & (m <= F.lit(hi + margin))
        & (m.cast("float") >= F.lit(lo).cast("float")) & (m.cast("float") <= F.lit(hi).cast("float"))
    )


def window_closed(df: DataFrame, col: str, window) -> DataFrame:
    """Closed double window used as a safety clamp."""
    lo, hi = window
    return df.where((F.col(col) >= F.lit(lo)) & (F.col(col) <= F.lit(hi)))


def gather(df: DataFrame, positions: DataFrame, keys=("y", "idx")) -> DataFrame:
    """P10: positional gather. Inner equi-join on the computed row index, so repeated positions give
    repeated rows, like ``take(indices)``. Both sides are shuffled on the keys (or the positions side is
    broadcast by AQE when it is small)."""
    return positions.join(df, on=list(keys), how="inner")
