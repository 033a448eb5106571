"""Distributed batch inference (M1) with ``predict_batch_udf``.

The user supplies ``make_predict_fn`` (called once per Python worker, so model weights load once);
Spark feeds it Arrow batches of ``batch_size`` rows. This is the only Python on the data path.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from eventframe.constants import EVAL_BATCH, TOKEN_TYPES, X_DIM
from eventframe.operators.scaling import scaled_array

__all__ = ["batch_predict", "event_tensors", "masked_sum_predict_fn", "score_events", "score_table", "softmax_head_predict_fn"]

N_TOKENS = len(TOKEN_TYPES)
#: A model's inputs for one event: features, kinematics (pt, eta, phi, mass) and mask of its tokens.
TENSORS = {"x": [N_TOKENS, X_DIM], "v": [N_TOKENS, 4], "m": [N_TOKENS]}


def softmax_head_predict_fn(n_classes: int = 3) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A fixed stand-in model: class ``c``'s logit is the sum of the inputs ``c``, ``c + n_classes``, ...
    (float64), so that every input counts."""

    def make():
        def predict(x: np.ndarray) -> np.ndarray:
            x = np.asarray(x, dtype=np.float64)
            z = np.stack([x[:, c::n_classes].sum(axis=1) for c in range(n_classes)], axis=1)
            z = z - z.max(axis=1, keepdims=True)
            e = np.exp(z)
            return e / e.sum(axis=1, keepdims=True)

        return predict

    return make


def batch_predict(make_predict_fn, input_dim: int, batch_size: int = EVAL_BATCH) -> Callable[..., Column]:
    """M1: a column function ``f(features_array) -> array<double>`` backed by ``predict_batch_udf``."""
    return predict_batch_udf(
        make_predict_fn,
        return_type=ArrayType(DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[[input_dim]],
    )


def score_table(df: DataFrame, features: str, make_predict_fn, input_dim: int, out: str = "p",
                batch_size: int = EVAL_BATCH) -> DataFrame:
    """Add ``out`` = model probabilities for every row (the scored table of the evaluation plan)."""
    f = batch_predict(make_predict_fn, input_dim, batch_size)
    return df.withColumn(out, f(df[features]))


def event_tensors(events: DataFrame, mean: list[float] | None = None, std: list[float] | None = None,
                  tokens: str = "tokens") -> DataFrame:
    """Add the inputs ``x`` (7 x 16, row by row), ``v`` (7 x 4) and ``m`` (7) of a model as flat arrays of doubles,
    from the token array of each event; with a scaler's ``mean`` and ``std`` the features are scaled (A3), padding
    included. Plain expressions over the fixed widths: no explode, no shuffle."""
    t = F.col(tokens)
    x = lambda k: t[k]["x"] if mean is None else scaled_array(t[k]["x"], mean, std)
    v = [t[k][f] for k in range(N_TOKENS) for f in ("pt", "eta", "phi", "mass")]
    return events.select("*", F.concat(*map(x, range(N_TOKENS))).alias("x"), F.array(*v).alias("v"),
                         F.array(*[t[k]["valid"].cast("double") for k in range(N_TOKENS)]).alias("m"))


def score_events(events: DataFrame, make_predict_fn, keep: tuple[str, ...] = ("event_id", "y", "dimuon_mass"), out: str = "p",
                 batch_size: int = EVAL_BATCH) -> DataFrame:
    """M1: ``keep`` and the class probabilities of every event of a frame with :func:`event_tensors`. The predict
    function gets three arrays per batch, shaped (n, 7, 16), (n, 7, 4) and (n, 7); only they cross to Python."""
    f = predict_batch_udf(make_predict_fn, return_type=ArrayType(DoubleType()), batch_size=batch_size,
                          input_tensor_shapes=list(TENSORS.values()))
    return events.select(*keep, f("x", "v", "m").alias(out))


def masked_sum_predict_fn(n_classes: int = 3) -> Callable[[], Callable[..., np.ndarray]]:
    """A fixed stand-in model over the three tensors: class ``c``'s logit sums the features ``c``, ``c + n_classes``, ...
    and a hundredth of kinematic number ``c`` over the tokens that the mask keeps."""

    def make():
        def predict(x: np.ndarray, v: np.ndarray, m: np.ndarray) -> np.ndarray:
            x, v, m = (np.asarray(a, dtype=np.float64) for a in (x, v, m))
            z = np.stack([((x[:, :, c::n_classes].sum(axis=2) + 0.01 * v[:, :, c]) * m).sum(axis=1) for c in range(n_classes)], axis=1)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return predict

    return make
