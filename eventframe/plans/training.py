"""Model training re-aimed at Spark ML (M4, M5).

The original trains a transformer on one machine. Here the table side stays the same (tokens ->
masked scaling -> flattened features, balanced classes) and the learner is Spark ML's multinomial
logistic regression, whose gradient steps are distributed tree aggregates. Class balance uses
per-class weights from the 3-row class count table instead of resampling.

Both fits have a small L2 penalty, so their optimum is unique although some features are constant or add up to others,
and :func:`score_equations` tells from the rows how far the coefficients are from it.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["token_features", "balanced_weights", "fit_classifier", "predict_proba", "fit_mass_probe", "score_equations"]

#: The L2 penalty, and the relative change of the loss at which the solver stops.
PENALTY, CLOSE = 1e-2, 1e-7


def token_features(df: DataFrame, tokens_col: str = "tokens", x_col: str = "x", out: str = "features",
                   n_tokens: int = 7) -> DataFrame:
    """Flatten the 7 x 16 token features (scaled x) into one ML vector."""
    flat = F.flatten(F.transform(F.slice(tokens_col, 1, n_tokens), lambda t: t[x_col]))
    return df.withColumn(out, array_to_vector(flat))


def balanced_weights(df: DataFrame, label_col: str = "y", out: str = "w") -> DataFrame:
    """Weight ``n_total / (n_classes * n_class)`` per row (broadcast of one row per class)."""
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_nc"))
    tot = c.agg(F.sum("_nc").alias("_nt"), F.count(F.lit(1)).alias("_k")).first()
    w = c.select(label_col, (F.lit(float(tot["_nt"])) / (F.lit(float(tot["_k"])) * F.col("_nc"))).alias(out))
    return df.join(F.broadcast(w), label_col)


def fit_classifier(train: DataFrame, label_col: str = "y", features: str = "features", weight_col: str | None = "w",
                   max_iter: int = 500, reg: float = PENALTY) -> LogisticRegressionModel:
    """M4: multinomial logistic regression on the flattened, scaled token features."""
    lr = LogisticRegression(featuresCol=features, labelCol=label_col, family="multinomial", maxIter=max_iter,
                            regParam=reg, standardization=False, tol=CLOSE)
    if weight_col:
        lr = lr.setWeightCol(weight_col)
    return lr.fit(train.withColumn(label_col, F.col(label_col).cast("double")))


def predict_proba(model: LogisticRegressionModel, df: DataFrame, out: str = "p") -> DataFrame:
    """Class probabilities as ``array<double>`` (the scored-table shape used by the metrics)."""
    pr = model.transform(df)
    return pr.withColumn(out, vector_to_array(F.col(model.getProbabilityCol()))).drop(
        model.getProbabilityCol(), model.getRawPredictionCol(), model.getPredictionCol())


def fit_mass_probe(train: DataFrame, bin_col: str = "mass_bin", features: str = "features",
                   max_iter: int = 500, reg: float = PENALTY) -> LogisticRegressionModel:
    """M5: a mass-leakage probe: predict the mass bin (A9 labels) from the same features. A loss near
    ``ln K`` means the features carry little mass information."""
    lr = LogisticRegression(featuresCol=features, labelCol=bin_col, family="multinomial", maxIter=max_iter,
                            regParam=reg, standardization=False, tol=CLOSE)
    return lr.fit(train.withColumn(bin_col, F.col(bin_col).cast("double")))


def score_equations(model: LogisticRegressionModel, train: DataFrame, label_col: str = "y", features: str = "features",
                    weight_col: str | None = None) -> DataFrame:
    """``class, feature, observed, residual`` per class and feature (feature -1 is the intercept).

    At the optimum of the penalised likelihood the weighted mean of a feature over the rows of a class (``observed``) equals
    its mean weighted by the class's probability, plus the penalty times the coefficient; ``residual`` is the
    difference, that is the gradient's entry. One aggregate with map-side combine, of classes x features rows.
    """
    k, coef = model.numClasses, model.coefficientMatrix.toArray()
    w = F.col(weight_col) if weight_col else F.lit(1.0)
    d = predict_proba(model, train.withColumn(label_col, F.col(label_col).cast("double")))
    x = F.concat(F.array(F.lit(1.0)), vector_to_array(F.col(features)))
    d = d.select(w.alias("w"), F.col(label_col).cast("int").alias("y"), "p", F.posexplode(x).alias("f", "x"))
    sums = [F.sum(F.col("w") * F.col("x") * F.when(F.col("y") == c, 1.0).otherwise(0.0)).alias(f"o{c}") for c in range(k)]
    sums += [F.sum(F.col("w") * F.col("x") * F.col("p")[c]).alias(f"e{c}") for c in range(k)]
    a = d.groupBy("f").agg(F.sum("w").alias("n"), *sums)
    rows = F.array(*[F.struct(F.lit(c).alias("class"), (F.col(f"o{c}") / F.col("n")).alias("observed"),
                              (F.col(f"e{c}") / F.col("n")).alias("expected")) for c in range(k)])
    penalty = model.getRegParam() * coef
    table = F.array(*[F.array(F.lit(0.0), *map(F.lit, row.tolist())) for row in penalty])
    a = a.select((F.col("f") - 1).alias("feature"), F.inline(rows))
    pull = table[F.col("class")][F.col("feature") + 1]
    return a.select("class", "feature", "observed", (F.col("expected") - F.col("observed") + pull).alias("residual"))
