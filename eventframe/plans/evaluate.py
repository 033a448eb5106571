"""Evaluation plans (M6, M7) over a scored table ``(event_id, y, p, mass, ...)``.

The scored table should be persisted by the caller when several metrics read it; every metric is
a distributed aggregate and only the final handful of numbers reach the driver.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventframe.constants import N_FOLDS, SPLIT_FOLDS
from eventframe.functions.scalar import softmax
from eventframe.operators.losses import batch_mean, cross_entropy, split_position
from eventframe.operators.metrics import (
    accuracy,
    auc_ovr,
    pearson_guarded,
    top_quantile_purity,
    with_prediction,
)
from eventframe.operators.splits import class_counts

__all__ = ["fixture_logits", "score_from_logits", "with_split_gid", "evaluation_report", "epoch_evaluation"]


def fixture_logits() -> F.Column:
    """Fixed three-class logits for the driver-table fixture (a stand-in for a trained model)."""
    return F.array(F.col("MET_pt") / 200, F.col("mu1_pt") / 20, F.col("njets_nominal") / 3)


def score_from_logits(df: DataFrame, z_col: str = "z", n_classes: int = 3) -> DataFrame:
    """M2: ``p = softmax(z)``."""
    return df.withColumn("p", softmax(F.col(z_col), n_classes))


def with_split_gid(df: DataFrame, split: str, spec=None, n_folds: int = N_FOLDS) -> DataFrame:
    """R11 for one split: position in the class-ordered concatenation of the split's rows."""
    spec = spec or SPLIT_FOLDS
    d = df.withColumn("_pos", split_position("idx", spec[split], n_folds))
    offs = class_counts(d).select("y", "class_offset")
    return d.join(F.broadcast(offs), "y").withColumn("gid", F.col("class_offset") + F.col("_pos")).drop(
        "class_offset", "_pos")


def evaluation_report(spark: SparkSession, scored: DataFrame, dy_class: int = 2, vbf_class: int = 1) -> DataFrame:
    """M6: one row with accuracy, per-class AUC, top-decile VBF purity, DY score-mass Pearson r and
    the number of test rows. Each metric gives (name, value) rows; the report is one aggregate over their union, so
    all of it is a single plan (only the purity's threshold and the AUC's bucket bounds are found before)."""
    sp = with_prediction(scored)

    def named(df: DataFrame, **cols: str) -> DataFrame:
        return df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value")) for n, c in cols.items()])))

    dy = sp.where(F.col("y") == dy_class).select((F.lit(1.0) - F.col("p")[dy_class]).alias("s"), "mass")
    values = (
        named(accuracy(sp), accuracy="accuracy", n="n")
        .unionByName(auc_ovr(sp).select(F.concat(F.lit("auc_"), F.col("class")).alias("name"), F.col("auc").alias("value")))
        .unionByName(named(top_quantile_purity(sp, cls=vbf_class), purity="purity"))
        .unionByName(named(pearson_guarded(dy), r="r"))
    )
    one = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    return values.agg(
        one("accuracy").alias("test_accuracy"), *[one(f"auc_{c}").alias(f"auc_{c}") for c in range(3)],
        one("purity").alias("vbf_purity_top10pct"), one("r").alias("dy_mass_sculpting_pearson_r"), one("n").cast("long").alias("n_test"))


def epoch_evaluation(scored: DataFrame, group_by: Sequence[str] = ("epoch",)) -> DataFrame:
    """M7: per group (epoch): mean-of-batch-means cross-entropy (A21 over ``gid``), accuracy, AUC
    per class. ``scored`` carries ``z`` (logits), ``p``, ``y`` and ``gid``."""
    g = list(group_by)
    sp = with_prediction(scored).withColumn("ce", cross_entropy("z", "y", 3))
    loss = batch_mean(sp, "ce", "gid", g).select(*g, F.col("loss_mean_of_batches").alias("loss"))
    acc = accuracy(sp, g).select(*g, "accuracy")
    auc = auc_ovr(sp, 3, g).groupBy(*g).pivot("class", [0, 1, 2]).agg(F.first("auc"))
    auc = auc.select(*g, *[F.col(str(c)).alias(f"auc_{c}") for c in range(3)])
    return loss.join(acc, g).join(auc, g)
