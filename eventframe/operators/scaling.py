"""Masked feature scaling (A1-A3).

The fit is one aggregate over (feature, value) pairs of valid tokens, grouped by the 16 feature
indices, with map-side partial aggregation: a tiny shuffle regardless of data size. (One
``posexplode`` keeps a single reference to the feature array in the plan; 32 separate ``x[i]``
aggregates let the optimizer copy the token-building expression into each of them.) The fitted parameters are 32 numbers;
applying them is one unrolled arithmetic expression per feature (no join, no lambda, no Python).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventframe.constants import STD_FLOOR, X_DIM

__all__ = ["fit_masked_scaler", "scaler_params", "apply_scaler", "scaled_array"]


def fit_masked_scaler(tokens: DataFrame, x_col: str = "x", valid_col: str = "valid") -> DataFrame:
    """A1 + A2: per feature mean and population std over valid tokens.

    Structural zeros (CLS and muon zeros in jet slots, etc.) count, as in the original fit. An
    empty input gives mean 0 and std 1. Returns ``feature int, mean double, std double`` (16 rows).
    """
    v = tokens.where(F.col(valid_col) == 1).select(F.posexplode(F.col(x_col)).alias("feature", "v"))
    agg = v.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    grid = F.array(*[F.lit(i) for i in range(X_DIM)])
    feats = tokens.sparkSession.range(1).select(F.explode(grid).alias("feature"))
    out = feats.join(agg, "feature", "left").select(
        F.col("feature").cast("int").alias("feature"),
        F.coalesce(F.col("mean"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.col("std"), F.lit(0.0)).alias("std"),
    )
    return out.select(
        "feature", "mean", F.when(F.col("std") < F.lit(STD_FLOOR), F.lit(1.0)).otherwise(F.col("std")).alias("std")
    )


def scaler_params(scaler: DataFrame) -> tuple[list[float], list[float]]:
    """Collect the 16-row parameter table (32 numbers) in feature order."""
    rows = sorted(scaler.collect(), key=lambda r: r["feature"])
    return [float(r["mean"]) for r in rows], [float(r["std"]) for r in rows]


def apply_scaler(df: DataFrame, mean: list[float], std: list[float], x_col: str = "x", out: str = "x") -> DataFrame:
    """A3: ``(x - mean) / std`` for every token, padding included (padding moves to -mean/std)."""
    x = F.col(x_col)
    return df.withColumn(out, scaled_array(x, mean, std))


def scaled_array(x, mean: list[float], std: list[float]):
    """Elementwise ``(x[i] - mean[i]) / std[i]`` unrolled over the fixed width (plain expressions)."""
    return F.array(*[(x[i] - F.lit(m)) / F.lit(s) for i, (m, s) in enumerate(zip(mean, std))])
