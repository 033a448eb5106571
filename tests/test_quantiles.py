"""Bracket selection against numpy, and the plan's shuffles."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventframe.operators import quantiles
from eventframe.operators.metrics import auc_ovr, top_quantile_purity
from eventframe.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.001, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1.0]


def column(kind):
    r = random.Random(11)
    if kind == "hot":  # one value holds a third of all rows, others are close to it
        return [0.5] * 2000 + [0.5 + r.choice([-1, 1]) * r.random() * 1e-9 for _ in range(3000)] + [r.random() for _ in range(1000)]
    if kind == "wide":
        return [math.exp(r.gauss(0, 30)) * r.choice([-1, 1]) for _ in range(5000)]
    if kind == "neighbours":  # numbers next to each other, so that nothing lies between two cuts
        return [math.nextafter(1.0, 2.0) if r.random() < 0.3 else 1.0 for _ in range(3000)] + [0.0, -0.0] * 500
    return [float(r.randrange(40)) for _ in range(4000)]


@pytest.mark.parametrize("kind", ["hot", "wide", "neighbours", "ties"])
@pytest.mark.parametrize("limit", [5, 1 << 16])
def test_against_numpy(spark, kind, limit, monkeypatch):
    monkeypatch.setattr(quantiles, "GRID", 10)
    v = column(kind)
    df = spark.createDataFrame([(x,) for x in v] + [(None,)] * 700, "v double").repartition(5)
    got = [r["value"] for r in exact_quantiles(df, "v", PROBS, limit).orderBy("qi").collect()]
    assert got == pytest.approx(np.quantile(v, PROBS).tolist(), rel=1e-15, abs=0)


def test_nan_infinity_and_nothing(spark):
    q = lambda v: [r["value"] for r in exact_quantiles(spark.createDataFrame([(x,) for x in v], "v double"), "v", [0.0, 0.5, 1.0], 2).collect()]
    assert q([math.inf, 1.0, 2.0, -math.inf, 3.0]) == [-math.inf, 2.0, math.inf]
    assert all(map(math.isnan, q([1.0, math.nan, 2.0])))
    assert q([None, None]) == [None, None, None]
    assert q([None, 4.0]) == [4.0, 4.0, 4.0]


def test_nothing_is_shuffled_by_value(spark):
    rows = spark.range(200_000).select(F.rand(3).alias("_v"))
    piece = quantiles._pieces(rows, [0.25, 0.5])
    plan = piece.where("_piece = 2").groupBy("_piece").agg(F.sort_array(F.collect_list("_v")))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_piece" in plan and "hashpartitioning(_v" not in plan
    counts = piece.groupBy("_piece").count()._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in counts


def test_a_null_or_nan_score_is_an_error(spark):
    rows = [(0, [0.5, 0.3, 0.2]), (1, [0.2, 0.6, 0.2]), (2, [0.1, 0.2, 0.7])]
    frame = lambda more: spark.createDataFrame(rows + more, "y int, p array<double>")
    assert [r["auc"] for r in auc_ovr(frame([])).collect()] == [1.0, 1.0, 1.0]
    for bad in (None, [math.nan, 0.5, 0.5], [0.2, None, 0.8]):
        with pytest.raises(Exception, match="null or NaN"):
            auc_ovr(frame([(0, bad)])).collect()
    with pytest.raises(Exception, match="null or NaN"):
        top_quantile_purity(frame([(1, None)])).collect()
