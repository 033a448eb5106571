"""Fits against the equations of their optimum, the AUC map, and history commits that run again."""

import json

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from eventframe.plans.training import PENALTY, balanced_weights, fit_classifier, score_equations
from eventframe.sources.artifacts import HISTORY_SCHEMA, commit_history, read_committed_history, read_metrics, write_history, write_metrics


@pytest.fixture(scope="module")
def train(spark):
    r = np.random.default_rng(4)
    y = r.integers(0, 3, 600)
    # a constant feature, one twice and one that tells a class apart
    x = np.column_stack([r.normal(size=600) + y, np.ones(600), r.normal(size=600), (y == 2) * 1.0])
    x = np.column_stack([x, x[:, 0]])
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, x)], "y int, x array<double>")
    return balanced_weights(df.select("y", array_to_vector("x").alias("features"))), y, x


def test_residual_is_the_gradient_and_vanishes_at_the_optimum(train):
    df, y, x = train
    model = fit_classifier(df)
    got = {(r["class"], r["feature"]): r for r in score_equations(model, df, weight_col="w").collect()}
    assert len(got) == 3 * 6
    assert max(abs(r["residual"]) for r in got.values()) < 1e-4
    w = 600 / (3 * np.bincount(y))[y]
    for c in range(3):
        assert got[c, -1]["observed"] == pytest.approx(1 / 3)
        for j in range(5):
            assert got[c, j]["observed"] == pytest.approx((w * x[:, j] * (y == c)).sum() / w.sum())
    early = fit_classifier(df, max_iter=1)
    far = {(r["class"], r["feature"]): r["residual"] for r in score_equations(early, df, weight_col="w").collect()}
    z = x @ early.coefficientMatrix.toArray().T + early.interceptVector.toArray()
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    want = (w[:, None] * (p - np.eye(3)[y])).T @ x / w.sum() + PENALTY * early.coefficientMatrix.toArray()
    assert np.allclose([[far[c, j] for j in range(5)] for c in range(3)], want) and np.abs(want).max() > 1e-3


def test_auc_is_a_map_by_class(spark, tmp_path):
    report = spark.createDataFrame([(0.5, 0.7, None, 0.9, 0.25, None, 10)], "test_accuracy double, auc_0 double, auc_1 double, auc_2 double, "
                                   "vbf_purity_top10pct double, dy_mass_sculpting_pearson_r double, n_test long")
    write_metrics(report, str(tmp_path / "m"))
    (line,) = spark.read.text(str(tmp_path / "m")).collect()
    doc = json.loads(line[0])
    assert doc["test_auc_ovr"] == {"0": 0.7, "1": None, "2": 0.9} and "auc_0" not in doc
    assert read_metrics(spark, str(tmp_path / "m")).select(*report.columns).collect() == report.collect()


def records(spark, rows):
    return spark.createDataFrame(rows, "run_id string, part string, epoch long, loss double")


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    inbox, path = str(tmp_path / "in"), str(tmp_path / "history")
    stream = lambda: spark.readStream.schema(HISTORY_SCHEMA).json(inbox)
    table = lambda: sorted((r["run_id"], r["part"], r["epoch"], r["loss"]) for r in read_committed_history(spark, path).collect())
    write_history(records(spark, [("a", "train", 0, 1.0), ("a", "val", 0, 2.0), ("a", "train", 1, 0.9)]), inbox)
    commit_history(stream(), path)
    first = table()
    assert first == [("a", "train", 0, 1.0), ("a", "train", 1, 0.9), ("a", "val", 0, 2.0)]
    commit_history(stream(), path)  # nothing new
    assert table() == first
    # the same micro-batch once more, as after a failure between writing and committing
    write_history(records(spark, [("a", "train", 0, 1.0), ("a", "val", 0, 2.0), ("a", "train", 1, 0.9)]), f"{path}/commit=0", mode="overwrite")
    assert table() == first
    # an epoch that is trained again, and the rest of another run
    write_history(records(spark, [("a", "train", 1, 0.5), ("b", "train", 0, None)]), inbox)
    commit_history(stream(), path)
    assert table() == [("a", "train", 0, 1.0), ("a", "train", 1, 0.5), ("a", "val", 0, 2.0), ("b", "train", 0, None)]


def test_maps_come_back(spark, tmp_path):
    inbox, path = str(tmp_path / "in"), str(tmp_path / "history")
    rows = records(spark, [("a", "val", 0, 1.0)]).withColumn("auc_ovr", F.create_map(F.lit("0"), F.lit(0.5), F.lit("1"), F.lit(0.75)))
    write_history(rows, inbox)
    commit_history(spark.readStream.schema(HISTORY_SCHEMA).json(inbox), path)
    assert read_committed_history(spark, path).first()["auc_ovr"] == {"0": 0.5, "1": 0.75}
