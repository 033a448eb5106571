"""Equal-frequency mass bins.

Exact quantiles come from :func:`quantiles.exact_quantiles` (distinct values pre-aggregated, ranks by a
two-level prefix sum, only the needed ranks looked up). Edges are a bounded list (sum of K+1 over the
candidates) collected once and used as literal arrays; histograms for all candidates are one
aggregate keyed by bin, whose partial counts are all that moves.

Bin conventions (kept distinct on purpose):
- counting (A7): ``[e_i, e_i+1)``, last bin closed, i.e. ``#(edges <= m) - 1`` clamped to K-1;
- labels (A9): float32 masses against float32 edges, ``#(edges < m) - 1`` clamped to 0..K-1.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventframe.constants import CANDIDATE_K, LOAD_WINDOW, MIN_BIN_COUNT
from eventframe.operators.filters import window_closed
from eventframe.operators.quantiles import exact_quantiles

__all__ = [
    "equal_freq_edges",
    "collect_edges",
    "edge_histogram",
    "choose_k",
    "fit_mass_bins",
    "assign_mass_bins",
    "count_bin",
    "label_bin",
]


def _ks(candidate_k: Sequence[int]) -> list[int]:
    return sorted({int(k) for k in candidate_k})  # O3


def equal_freq_edges(masses: DataFrame, col: str = "mass", window=LOAD_WINDOW,
                     candidate_k: Sequence[int] = CANDIDATE_K) -> DataFrame:
    """A5 + A6 + O6: ``K, b, edge`` with ``edge_b = quantile(b/K)`` and the ends clamped to the window.

    Masses are first clamped to the closed window (P4); an empty window raises.
    """
    lo, hi = window
    m = window_closed(masses.select(F.col(col).cast("double").alias("m")), "m", window)
    ks = _ks(candidate_k)
    grid = [(k, b) for k in ks for b in range(k + 1)]
    probs = sorted({b / k for k, b in grid})
    q = exact_quantiles(m, "m", probs)
    q = q.withColumn(
        "value", F.coalesce("value", F.raise_error(F.lit("no value inside the binning window")))
    )
    g = F.array(*[F.struct(F.lit(k).alias("K"), F.lit(b).alias("b"), F.lit(b / k).alias("q")) for k, b in grid])
    gdf = masses.sparkSession.range(1).select(F.inline(g))
    e = gdf.join(F.broadcast(q.select("q", "value")), "q")
    edge = (
        F.when(F.col("b") == 0, F.lit(lo)).when(F.col("b") == F.col("K"), F.lit(hi)).otherwise(F.col("value"))
    )
    return e.select("K", "b", edge.alias("edge"))


def collect_edges(edges: DataFrame) -> dict[int, list[float]]:
    """The edge table is bounded by the candidate list; bring it to the driver as literals."""
    out: dict[int, list[float]] = {}
    for r in sorted(edges.collect(), key=lambda r: (r["K"], r["b"])):
        out.setdefault(int(r["K"]), []).append(float(r["edge"]))
    return out


def _count(m, edges, cond):
    """Number of edges satisfying ``cond``, unrolled over the (bounded) edge list."""
    lits = [e if not isinstance(e, (int, float)) else F.lit(float(e)) for e in edges]
    total = None
    for e in lits:
        term = F.when(cond(e), F.lit(1)).otherwise(F.lit(0))
        total = term if total is None else total + term
    return total


def count_bin(m, edges: list[float]):
    """A7 bin (right-open, last closed): ``#(edges <= m) - 1`` clamped to K-1."""
    k = len(edges) - 1
    return F.least(_count(m, edges, lambda e: e <= m) - 1, F.lit(k - 1))


def label_bin(m, edges: list[float]):
    """A9 bin on float32 values: ``#(edges < m) - 1`` clamped to 0..K-1 (left-open bins, lo in bin 0)."""
    k = len(edges) - 1
    mf = m.cast("float")
    return F.greatest(F.lit(0), F.least(F.lit(k - 1), _count(mf, [F.lit(float(e)).cast("float") for e in edges],
                                                             lambda e: e < mf) - 1))


def edge_histogram(masses: DataFrame, edges: dict[int, list[float]], col: str = "mass",
                   window=LOAD_WINDOW) -> DataFrame:
    """A7 for every candidate at once: ``K, b, n`` with empty bins kept as 0."""
    m = window_closed(masses.select(F.col(col).cast("double").alias("m")), "m", window)
    per_k = F.array(*[F.struct(F.lit(k).alias("K"), count_bin(F.col("m"), e).alias("b")) for k, e in edges.items()])
    h = m.select(F.inline(per_k)).groupBy("K", "b").agg(F.count(F.lit(1)).alias("n"))  # partial counts: K x b rows a task
    grid = F.array(*[F.struct(F.lit(k).alias("K"), F.lit(b).alias("b")) for k, e in edges.items()
                     for b in range(len(e) - 1)])
    g = masses.sparkSession.range(1).select(F.inline(grid))
    return g.join(h, ["K", "b"], "left").select("K", "b", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def choose_k(hist: DataFrame, candidate_k: Sequence[int] = CANDIDATE_K, min_bin_count=MIN_BIN_COUNT) -> int:
    """The largest candidate K >= 2 whose smallest bin holds at least ``min_bin_count`` rows;
    else the smallest candidate (K < 2 allowed there). ``min_bin_count`` may be a Column."""
    thr = min_bin_count if not isinstance(min_bin_count, int) else F.lit(min_bin_count)
    ok = hist.groupBy("K").agg(F.min("n").alias("mn")).where((F.col("K") >= 2) & (F.col("mn") >= thr))
    best = ok.agg(F.max("K")).first()[0]
    return int(best) if best is not None else _ks(candidate_k)[0]


def fit_mass_bins(masses: DataFrame, col: str = "mass", window=LOAD_WINDOW, candidate_k: Sequence[int] = CANDIDATE_K,
                  min_bin_count=MIN_BIN_COUNT) -> tuple[int, list[float]]:
    """The whole fit: edges for every candidate, counts, the chosen K and its float32 edges."""
    edges = collect_edges(equal_freq_edges(masses, col, window, candidate_k))
    k = choose_k(edge_histogram(masses, edges, col, window), candidate_k, min_bin_count)
    return k, [float(np.float32(e)) for e in edges[k]]


def assign_mass_bins(df: DataFrame, edges: list[float], col: str = "dimuon_mass", out: str = "mass_bin") -> DataFrame:
    """Bin labels for training rows from the chosen float32 edges."""
    return df.withColumn(out, label_bin(F.col(col), edges))
