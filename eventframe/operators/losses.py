"""Losses and batch averaging (A19-A22, M2-M3 helpers)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventframe.constants import EVAL_BATCH

__all__ = ["cross_entropy", "logsumexp", "batch_mean", "split_position"]


def logsumexp(z, n: int | None = None) -> Column:
    z = F.col(z) if isinstance(z, str) else z
    if n is not None:  # unrolled, no lambda
        mx = F.greatest(*[z[i] for i in range(n)]) if n > 1 else z[0]
        tot = F.exp(z[0] - mx)
        for i in range(1, n):
            tot = tot + F.exp(z[i] - mx)
        return mx + F.ln(tot)
    mx = F.array_max(z)
    return mx + F.ln(F.aggregate(F.transform(z, lambda v: F.exp(v - mx)), F.lit(0.0), lambda a, v: a + v))


def cross_entropy(z, label, n: int | None = None) -> Column:
    """A19 per row: ``logsumexp(z) - z[label]`` (stable). ``label`` is a 0-based int column; a known
    class count ``n`` unrolls the expression."""
    z = F.col(z) if isinstance(z, str) else z
    label = F.col(label) if isinstance(label, str) else label
    return logsumexp(z, n) - F.element_at(z, label + 1)


def split_position(idx_col: str, folds: Sequence[int], n_folds: int) -> Column:
    """Dense position of a row inside its class's split subset, in index order, without a window:
    a split made of folds F holds ``idx = n_folds*t + f``, so the position is ``t*|F| + rank(f in F)``."""
    fs = sorted(int(f) for f in folds)
    rank = F.array_position(F.array(*[F.lit(f) for f in fs]), F.pmod(F.col(idx_col), F.lit(n_folds)).cast("int")) - 1
    return (F.floor(F.col(idx_col) / n_folds) * len(fs) + rank).cast("long")


def batch_mean(df: DataFrame, value_col: str, gid_col: str = "gid", group_by: Sequence[str] = (),
               batch: int = EVAL_BATCH) -> DataFrame:
    """The unweighted mean of per-batch means over batches of ``batch`` consecutive rows (by
    ``gid``, the position in class-ordered concatenation), next to the row-weighted mean."""
    g = list(group_by)
    per = df.groupBy(*g, F.floor(F.col(gid_col) / batch).alias("batch")).agg(
        F.avg(value_col).alias("bm"), F.sum(value_col).alias("bs"), F.count(F.lit(1)).alias("bn"))
    return per.groupBy(*g).agg(
        F.avg("bm").alias("loss_mean_of_batches"),
        (F.sum("bs") / F.sum("bn")).alias("loss_row_weighted"),
        F.count(F.lit(1)).alias("n_batches"),
        F.sum("bn").alias("n"),
    )
