"""Evaluation metrics over a scored table ``(y, p array<double>, mass, ...)``.

Design for scale:
- every metric is an aggregate with map-side partial aggregation, or a prefix sum over *distinct
  scores* (rows are first aggregated by score, so ties and hot values collapse);
- AUC, ROC points and the trapezoid area come from per-score counts and a two-level prefix sum of
  negatives/positives (no window over all rows of a class, no lag over the curve);
- quantile thresholds/edges are exact (:func:`quantiles.exact_quantiles`) and come back as a few
  literals; histograms keep empty bins through a left join from the (bounded) bin grid.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventframe.constants import CORR_GUARD, N_HIST_BINS, N_SCORE_BINS, PURITY_QUANTILE
from eventframe.functions.scalar import argmax
from eventframe.operators.ordering import prefix_aggregate
from eventframe.operators.quantiles import exact_quantiles

__all__ = [
    "with_prediction",
    "accuracy",
    "confusion_matrix",
    "class_scores",
    "auc_ovr",
    "roc_points",
    "roc_trapezoid",
    "top_quantile_purity",
    "pearson_guarded",
    "score_bin_edges",
    "score_bins",
    "score_bin_mass_hist",
]


def with_prediction(scored: DataFrame, p_col: str = "p", out: str = "pred") -> DataFrame:
    """M3 applied to the probability array."""
    return scored.withColumn(out, argmax(F.col(p_col)))


def accuracy(scored: DataFrame, group_by: Sequence[str] = (), y_col: str = "y", pred_col: str = "pred") -> DataFrame:
    """A10: mean of ``y == pred`` (0.0 on empty input) and the row count."""
    g = list(group_by)
    hit = (F.col(y_col) == F.col(pred_col)).cast("double")
    agg = [F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"), F.count(F.lit(1)).alias("n")]
    return scored.groupBy(*g).agg(*agg) if g else scored.agg(*agg)


def confusion_matrix(scored: DataFrame, n_classes: int = 3, y_col: str = "y", pred_col: str = "pred") -> DataFrame:
    """Dense ``n_classes x n_classes`` counts, zero cells kept."""
    counts = scored.groupBy(F.col(y_col).alias("y"), F.col(pred_col).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    grid = F.array(*[F.struct(F.lit(a).alias("y"), F.lit(b).alias("pred")) for a in range(n_classes)
                     for b in range(n_classes)])
    g = scored.sparkSession.range(1).select(F.inline(grid))
    return g.join(counts, ["y", "pred"], "left").select("y", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def usable_score(s: Column) -> Column:
    """``s``; null and NaN raise an error instead of a rank."""
    return F.when(s.isNotNull() & ~F.isnan(s), s).otherwise(F.raise_error(F.lit("a score is null or NaN")))


def class_scores(scored: DataFrame, n_classes: int = 3, group_by: Sequence[str] = (), y_col: str = "y",
                 p_col: str = "p") -> DataFrame:
    """Per (group, class, distinct score): positives ``P`` and negatives ``N`` (one-vs-rest). A null or NaN score
    is an error, as it can't be ranked."""
    g = list(group_by)
    arr = F.array(*[
        F.struct(F.lit(c).alias("c"), usable_score(F.col(p_col)[c]).alias("s"), (F.col(y_col) == c).cast("long").alias("pos"))
        for c in range(n_classes)
    ])
    ex = scored.select(*g, F.inline(arr))
    return ex.groupBy(*g, "c", "s").agg(
        F.sum("pos").cast("double").alias("P"), F.sum(F.lit(1) - F.col("pos")).cast("double").alias("N")
    )


def _with_below(cs: DataFrame, group_by: Sequence[str]) -> DataFrame:
    """Add ``P_below``/``N_below``: counts at strictly lower scores (two-level prefix sum)."""
    return prefix_aggregate(
        cs, list(group_by) + ["c"], ["s"], F.col("s"),
        {"P_below": ("sum", F.col("P")), "N_below": ("sum", F.col("N"))},
    )


def auc_ovr(scored: DataFrame, n_classes: int = 3, group_by: Sequence[str] = (), y_col: str = "y",
            p_col: str = "p") -> DataFrame:
    """One-vs-rest AUC per class (ties count half): ``sum(P*(N_below + N/2)) / (P_tot*N_tot)``.

    Null (the original's NaN) when a class is absent or is the only class. Numerators are sums of
    half-integers, so the value does not depend on summation order.
    """
    g = list(group_by)
    b = _with_below(class_scores(scored, n_classes, g, y_col, p_col), g)
    a = b.groupBy(*g, "c").agg(
        F.sum(F.col("P") * (F.col("N_below") + F.col("N") / 2)).alias("num"),
        F.sum("P").alias("Pt"), F.sum("N").alias("Nt"),
    )
    auc = F.when((F.col("Pt") > 0) & (F.col("Nt") > 0), F.col("num") / (F.col("Pt") * F.col("Nt")))
    return a.select(*g, F.col("c").alias("class"), auc.alias("auc"))


def roc_points(scored: DataFrame, n_classes: int = 3, y_col: str = "y", p_col: str = "p") -> DataFrame:
    """``class, threshold, fpr, tpr`` for every distinct score plus the (0, 0) start point
    (threshold null); degenerate classes are skipped."""
    b = _with_below(class_scores(scored, n_classes, (), y_col, p_col), ())
    tot = b.groupBy("c").agg(F.sum("P").alias("Pt"), F.sum("N").alias("Nt")).where("Pt > 0 AND Nt > 0")
    j = b.join(F.broadcast(tot), "c")  # one row per class
    pts = j.select(
        F.col("c").alias("class"), F.col("s").alias("threshold"),
        ((F.col("Nt") - F.col("N_below")) / F.col("Nt")).alias("fpr"),
        ((F.col("Pt") - F.col("P_below")) / F.col("Pt")).alias("tpr"),
    )
    start = tot.select(F.col("c").alias("class"), F.lit(None).cast("double").alias("threshold"),
                       F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def roc_trapezoid(scored: DataFrame, n_classes: int = 3, y_col: str = "y", p_col: str = "p") -> DataFrame:
    """Trapezoid area under the ROC points. Each distinct score is one segment whose left end is
    the neighbouring point, known locally from the counts: area = sum(N*(2*tp - P)) / (2*Pt*Nt)."""
    b = _with_below(class_scores(scored, n_classes, (), y_col, p_col), ())
    tot = b.groupBy("c").agg(F.sum("P").alias("Pt"), F.sum("N").alias("Nt")).where("Pt > 0 AND Nt > 0")
    j = b.join(F.broadcast(tot), "c")
    tp = F.col("Pt") - F.col("P_below")
    seg = F.col("N") * (F.lit(2) * tp - F.col("P"))
    a = j.groupBy("c").agg(F.sum(seg).alias("num"), F.first("Pt").alias("Pt"), F.first("Nt").alias("Nt"))
    return a.select(F.col("c").alias("class"), (F.col("num") / (F.lit(2) * F.col("Pt") * F.col("Nt"))).alias("auc_trapz"))


def top_quantile_purity(scored: DataFrame, cls: int = 1, q: float = PURITY_QUANTILE, y_col: str = "y",
                        p_col: str = "p") -> DataFrame:
    """A15 + P8 + P9: threshold = exact ``quantile(p[cls], q)``; purity = share of class ``cls`` among
    rows with ``p[cls] >= threshold`` (null when nothing is selected)."""
    s = scored.select(usable_score(F.col(p_col)[cls]).alias("s"), F.col(y_col).alias("y"))
    thr = exact_quantiles(s, "s", [q]).first()["value"]
    if thr is None:
        return scored.sparkSession.range(1).select(
            F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("long").alias("n_selected"),
            F.lit(None).cast("double").alias("purity"))
    sel = s.where(F.col("s") >= F.lit(thr))
    return sel.agg(
        F.lit(thr).alias("threshold"), F.count(F.lit(1)).alias("n_selected"),
        F.avg((F.col("y") == cls).cast("double")).alias("purity"),
    )


def pearson_guarded(df: DataFrame, s_col: str = "s", m_col: str = "mass", guard: float = CORR_GUARD) -> DataFrame:
    """A16 + A24: population std of both columns, min/max of the score, and Pearson r that is null
    when either std is below ``guard``; empty input raises. Uses ``covar_pop / (sd*sd)`` rather than
    ``corr`` so a constant column does not hit a division error under ANSI mode."""
    s, m = F.col(s_col), F.col(m_col)
    a = df.agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop(s).alias("std_s"), F.stddev_pop(m).alias("std_m"),
        F.min(s).alias("min_s"), F.max(s).alias("max_s"), F.covar_pop(s, m).alias("cov"),
    )
    r = F.when((F.col("std_s") < guard) | (F.col("std_m") < guard), F.lit(None).cast("double")).otherwise(
        F.col("cov") / (F.col("std_s") * F.col("std_m")))
    n = F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("No rows provided for the correlation.")))
    return a.select(n.alias("n"), "std_s", "std_m", "min_s", "max_s", r.alias("r"))


def score_bin_edges(df: DataFrame, s_col: str = "s", n_bins: int = N_SCORE_BINS) -> list[float]:
    """A17 edges: exact quantiles at ``linspace(0, 1, n_bins + 1)`` with the ends set to min and max
    (a bounded list of ``n_bins + 1`` literals)."""
    q = exact_quantiles(df.select(s_col), s_col, [i / n_bins for i in range(n_bins + 1)])
    vals = [r["value"] for r in sorted(q.collect(), key=lambda r: r["qi"])]
    if vals[0] is None:
        raise ValueError("No rows to bin.")
    mm = df.agg(F.min(s_col), F.max(s_col)).first()
    vals[0], vals[-1] = float(mm[0]), float(mm[1])
    return [float(v) for v in vals]


def _score_bin(s, edges: list[float]):
    """Bins ``[lo, hi)`` with the last closed: count of inner edges <= s (duplicates give empty bins)."""
    total = F.lit(0)
    for e in edges[1:-1]:
        total = total + F.when(F.lit(e) <= s, F.lit(1)).otherwise(F.lit(0))
    return total


def score_bins(df: DataFrame, edges: list[float], s_col: str = "s") -> DataFrame:
    """``bin, lo, hi, n`` for every score bin (empty bins kept)."""
    k = len(edges) - 1
    c = df.groupBy(_score_bin(F.col(s_col), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(edges[i]).alias("lo"), F.lit(edges[i + 1]).alias("hi"))
                     for i in range(k)])
    g = df.sparkSession.range(1).select(F.inline(grid))
    return g.join(c, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def score_bin_mass_hist(df: DataFrame, edges: list[float], s_col: str = "s", m_col: str = "mass",
                        n_hist: int = N_HIST_BINS) -> DataFrame:
    """Per score bin, an ``n_hist``-bin equal-width histogram of mass over that bin's own
    min..max (numpy's rules: last bin closed; a constant bin widens by 0.5 each side; an empty bin
    uses 0..1). Returns ``bin, h, n`` for every (bin, h), zeros kept."""
    k = len(edges) - 1
    d = df.select(_score_bin(F.col(s_col), edges).alias("bin"), F.col(m_col).alias("m"))
    rng = d.groupBy("bin").agg(F.min("m").alias("mn"), F.max("m").alias("mx"))
    rng = rng.select(
        "bin",
        F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
        F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"),
    )
    j = d.join(F.broadcast(rng), "bin")  # at most k rows
    lo, hi, m = F.col("lo"), F.col("hi"), F.col("m")
    step = (hi - lo) / n_hist

    def edge(i):
        return F.when(i >= n_hist, hi).otherwise(i * step + lo)

    i0 = F.floor((m - lo) / (hi - lo) * n_hist)
    i0 = F.when(i0 == n_hist, F.lit(n_hist - 1)).otherwise(i0)
    i1 = F.when(m < edge(i0), i0 - 1).otherwise(i0)
    i2 = F.when((i1 != n_hist - 1) & (m >= edge(i1 + 1)), i1 + 1).otherwise(i1)
    c = j.select("bin", i2.cast("int").alias("h")).groupBy("bin", "h").agg(F.count(F.lit(1)).alias("n"))
    grid = F.array(*[F.struct(F.lit(b).alias("bin"), F.lit(h).alias("h")) for b in range(k) for h in range(n_hist)])
    g = df.sparkSession.range(1).select(F.inline(grid))
    return g.join(c, ["bin", "h"], "left").select("bin", "h", F.coalesce("n", F.lit(0)).alias("n"))
