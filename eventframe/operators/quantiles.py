"""Exact quantiles by bracket selection (A5, A15, A17), without sorting or shuffling the column.

1. One pass counts the numbers and takes a mergeable quantile sketch (``percentile_approx``). For every
   rank that is asked for, two neighbouring points of the sketch's grid bracket it.
2. One counting pass cuts the column at these points: a bracket is the open interval between two points, and every
   point is an interval of its own, so a value that holds a third of all rows is settled by its count.
3. Brackets that still hold over ``limit`` rows are sketched and cut again; each round makes them about
   ``GRID`` times smaller.
4. Only the rows inside the remaining brackets are sorted, at most ``limit`` for each.

Every pass is a scan with map-side aggregation: what is shuffled are sketches, counts by bracket, and at last the
brackets' own rows, keyed by bracket and never by value. The counts are exact, so the sketch's error decides
only how many rows a bracket holds.
"""

from __future__ import annotations

import bisect
import math
from typing import Iterable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["exact_quantiles", "select_ranks"]

#: Points of a sketch's grid, and its accuracy (rank error of one row in so many).
GRID = 1000
ACCURACY = 10_000
#: Rows of a bracket that are sorted.
LIMIT = 1 << 16


def _pieces(rows: DataFrame, points: list[float]) -> DataFrame:
    """Add ``_piece``: with n points, piece 2i is the open interval below point i (2n above the last), piece 2i + 1 the
    point itself."""
    if not points:
        return rows.withColumn("_piece", F.lit(0))
    splits, labels = [-math.inf], []
    for i, p in enumerate(points):
        if p > splits[-1]:  # else the point before is the next smaller number: nothing lies between
            splits.append(p)
            labels.append(2 * i)
        splits.append(math.nextafter(p, math.inf))
        labels.append(2 * i + 1)
    if splits[-1] != math.inf:
        splits.append(math.inf)
        labels.append(2 * len(points))
    out = Bucketizer(splits=splits, inputCol="_v", outputCol="_cut").transform(rows)
    return out.withColumn("_piece", F.get(F.array(*map(F.lit, labels)), F.col("_cut").cast("int"))).drop("_cut")


def select_ranks(rows: DataFrame, ranks: Iterable[int], n: int, limit: int = LIMIT) -> dict[int, float]:
    """The values at 0-based ``ranks`` of the column ``_v`` (finite doubles) of ``rows``, which has ``n`` rows."""
    todo, found = sorted(set(ranks)), {}
    points: list[float] = []
    sizes = {0: n}  # rows of each piece
    while todo:
        starts, total = [], 0
        for piece in range(2 * len(points) + 1):
            starts.append(total)
            total += sizes.get(piece, 0)
        where = {r: bisect.bisect_right(starts, r) - 1 for r in todo}
        for r in todo:
            while sizes.get(where[r], 0) == 0:  # empty pieces start where the next one does
                where[r] -= 1
        found |= {r: points[p // 2] for r, p in where.items() if p % 2}
        todo = [r for r in todo if r not in found]
        wanted = sorted({where[r] for r in todo})
        large = [p for p in wanted if sizes[p] > limit]
        if not large:
            break
        inside = _pieces(rows, points).where(F.col("_piece").isin(large))
        grid = F.percentile_approx("_v", [i / GRID for i in range(GRID + 1)], ACCURACY)
        sketch = {r["_piece"]: r["g"] for r in inside.groupBy("_piece").agg(grid.alias("g")).collect()}
        new = set(points)
        for p in large:
            for r in (r for r in todo if where[r] == p):
                at = (r - starts[p]) / sizes[p] * GRID
                new |= {sketch[p][i] for i in (max(0, math.floor(at) - 1), min(GRID, math.ceil(at) + 1))}
        points = sorted(p for p in new if math.isfinite(p))
        counts = _pieces(rows, points).groupBy("_piece").agg(F.count(F.lit(1)).alias("c"))
        sizes = {r["_piece"]: r["c"] for r in counts.collect()}  # twice the points at most
    if todo:
        held = _pieces(rows, points).where(F.col("_piece").isin(wanted))
        sorted_ = held.groupBy("_piece").agg(F.sort_array(F.collect_list("_v")).alias("s"))  # up to ``limit`` values each
        asked = {p: [r - starts[p] for r in todo if where[r] == p] for p in wanted}
        at = F.create_map(*[x for p, own in asked.items() for x in (F.lit(p), F.array(*map(F.lit, own)))])
        got = sorted_.select("_piece", F.transform(at[F.col("_piece")], lambda i: F.get("s", i)).alias("v")).collect()
        found |= {i + starts[r["_piece"]]: v for r in got for i, v in zip(asked[r["_piece"]], r["v"])}
    return found


def exact_quantiles(df: DataFrame, value_col: str, probs: Iterable[float], limit: int = LIMIT) -> DataFrame:
    """A5: exact quantiles with linear interpolation (numpy's default method): ``qi, q, value``.

    For probability q and n values, position (n-1)q lies between ranks lo = floor and hi = lo + 1; the result is
    ``v[lo] + (pos - lo) * (v[hi] - v[lo])``. Nulls don't count; with any NaN every quantile is NaN, as in numpy;
    without values ``value`` is null. ``df`` is read once for the counts and about twice for each factor of
    ``GRID`` that a bracket exceeds ``limit`` rows, so callers keep an expensive input.
    """
    probs = [float(q) for q in probs]
    rows = df.select(F.col(value_col).cast("double").alias("_v")).where("_v is not null")
    count = lambda c: F.count(F.when(c, 1))
    n, nans, low, high = rows.agg(F.count(F.lit(1)), count(F.isnan("_v")), count(F.col("_v") == -math.inf), count(F.col("_v") == math.inf)).first()
    if nans or not n:
        values = [math.nan if nans else None] * len(probs)
    else:
        pos = [(n - 1) * q for q in probs]
        need = [(math.floor(p), min(math.floor(p) + 1, n - 1)) for p in pos]
        ranks = {r for pair in need for r in pair}
        v = {r: -math.inf if r < low else math.inf for r in ranks}
        if finite := {r - low for r in ranks if low <= r < n - high}:
            some = rows.where(F.abs("_v") < math.inf) if low or high else rows
            v |= {r + low: x for r, x in select_ranks(some, finite, n - low - high, limit).items()}
        values = [v[lo] + (p - lo) * (v[hi] - v[lo]) if p > lo else v[lo] for p, (lo, hi) in zip(pos, need)]
    return df.sparkSession.createDataFrame(list(zip(range(len(probs)), probs, values)), "qi int, q double, value double")
