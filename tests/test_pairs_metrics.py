import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventframe.functions.scalar import argmax, softmax, wrap_dphi
from eventframe.operators.metrics import (
    accuracy,
    auc_ovr,
    confusion_matrix,
    pearson_guarded,
    roc_points,
    roc_trapezoid,
    score_bin_edges,
    score_bin_mass_hist,
    score_bins,
    top_quantile_purity,
    with_prediction,
)
from eventframe.operators.pairs import pairs_long
from eventframe.operators.tokens import build_tokens
from tests.helpers import close, event_frame, event_row, jet


def test_pairs_properties(spark):
    rows = [event_row(1, njets_nominal=2.0, mu1_phi=3.1, mu2_phi=-3.1, **jet(1, mass=7.0), **jet(2, pt=55.0)),
            event_row(2, njets_nominal=0.0, mu1_phi=math.pi / 2, mu2_phi=-math.pi / 2)]
    p = pairs_long(build_tokens(event_frame(spark, rows))).collect()
    assert len(p) == 2 * 49
    d = {(r.event_id, r.i, r.j): r for r in p}
    for i in range(7):
        for j in range(7):
            a, b = d[(1, i, j)], d[(1, j, i)]
            assert close(a.deta, -b.deta) and close(a.log_pt_ratio, -b.log_pt_ratio, 1e-12)
    # wrap: 3.1 - (-3.1) = 6.2 -> 6.2 - 2pi
    assert close(math.asin(d[(1, 1, 2)].sin_dphi), 6.2 - 2 * math.pi, 1e-9)
    assert close(d[(1, 1, 1)].log_dr, math.log(1e-6))  # identical tokens
    # pair of a valid jet with itself has twice its mass; only jet-jet pairs carry log m_jj
    assert close(d[(1, 3, 3)].mij, 14.0, 1e-9) and close(d[(1, 3, 3)].log_mjj, math.log(14.0), 1e-9)
    assert d[(1, 1, 3)].log_mjj == 0.0 and d[(1, 1, 2)].log_mjj == 0.0
    keys = pairs_long(build_tokens(event_frame(spark, rows)), valid_keys_only=True).where("event_id = 2").count()
    assert keys == 7 * 3  # CLS and two muons are the only valid keys without jets


def test_wrap_exact_pi(spark):
    df = spark.createDataFrame([(math.pi,), (-math.pi,), (0.0,)], "d double")
    got = [r.w for r in df.select(wrap_dphi("d").alias("w")).collect()]
    assert got[0] == -math.pi and got[1] == -math.pi and got[2] == 0.0


def test_softmax_argmax(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0],), ([1000.0, 0.0, -5.0],)], "z array<double>")
    r = df.select(softmax("z").alias("p"), softmax("z", 3).alias("q"), argmax("z").alias("a")).collect()
    assert close(sum(r[0].p), 1.0) and r[0].p == r[0].q and r[0].a == 1  # first index on ties
    assert close(r[1].p[0], 1.0) and r[1].a == 0


def _scored(spark, rows):
    return spark.createDataFrame(rows, "y int, p array<double>, mass double")


def _brute_auc(ys, ss, c):
    pos = [s for y, s in zip(ys, ss) if y == c]
    neg = [s for y, s in zip(ys, ss) if y != c]
    if not pos or not neg:
        return None
    tot = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg)
    return tot / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def scored_rows():
    rnd = random.Random(11)
    rows = []
    for _ in range(400):
        y = rnd.choice([0, 1, 2])
        p = [round(rnd.random(), 1) for _ in range(3)]  # heavy ties
        rows.append((y, p, 110 + rnd.random() * 30))
    return rows


def test_auc_roc_trapezoid(spark, scored_rows):
    df = _scored(spark, scored_rows)
    auc = {r["class"]: r.auc for r in auc_ovr(df).collect()}
    trap = {r["class"]: r.auc_trapz for r in roc_trapezoid(df).collect()}
    ys = [r[0] for r in scored_rows]
    for c in range(3):
        want = _brute_auc(ys, [r[1][c] for r in scored_rows], c)
        assert close(auc[c], want, 1e-12) and close(trap[c], want, 1e-12)
    pts = roc_points(df).where("class = 0").collect()
    assert len(pts) == len({r[1][0] for r in scored_rows}) + 1
    assert max(p.fpr for p in pts) == 1.0 and max(p.tpr for p in pts) == 1.0


def test_auc_degenerate(spark, scored_rows):
    df = _scored(spark, [r for r in scored_rows if r[0] != 1])
    auc = {r["class"]: r.auc for r in auc_ovr(df).collect()}
    assert auc[1] is None and auc[0] is not None
    assert roc_points(df).where("class = 1").count() == 0


def test_accuracy_confusion(spark, scored_rows):
    df = with_prediction(_scored(spark, scored_rows))
    acc = accuracy(df).first()
    preds = [int(np.argmax(r[1])) for r in scored_rows]
    assert close(acc.accuracy, np.mean([p == r[0] for p, r in zip(preds, scored_rows)]))
    cm = confusion_matrix(df).collect()
    assert len(cm) == 9 and sum(r.n for r in cm) == 400
    empty = accuracy(df.where(F.lit(False))).first()
    assert empty.accuracy == 0.0 and empty.n == 0


def test_top_decile_purity_ties(spark, scored_rows):
    df = _scored(spark, scored_rows)
    r = top_quantile_purity(df, cls=1).first()
    p1 = np.array([x[1][1] for x in scored_rows])
    thr = np.quantile(p1, 0.9)
    sel = p1 >= thr
    assert close(r.threshold, thr) and r.n_selected == int(sel.sum())
    assert close(r.purity, float(np.mean(np.array([x[0] for x in scored_rows])[sel] == 1)))


def test_pearson_guard(spark):
    df = spark.createDataFrame([(0.5, 120.0 + i) for i in range(10)], "s double, mass double")
    assert pearson_guarded(df).first().r is None
    df2 = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(10)], "s double, mass double")
    assert close(pearson_guarded(df2).first().r, 1.0)
    with pytest.raises(Exception, match="No rows"):
        pearson_guarded(df2.where(F.lit(False))).collect()


def test_score_bins_and_hist_match_numpy(spark):
    rnd = random.Random(5)
    rows = [(round(rnd.random(), 1), 110 + 30 * rnd.random()) for _ in range(300)] + [(1.0, 125.0)]
    df = spark.createDataFrame(rows, "s double, mass double")
    edges = score_bin_edges(df)
    s = np.array([r[0] for r in rows])
    m = np.array([r[1] for r in rows])
    want = np.quantile(s, np.linspace(0, 1, 7))
    want[0], want[-1] = s.min(), s.max()
    assert np.allclose(edges, want)
    bins = {r.bin: r.n for r in score_bins(df, edges).collect()}
    hist = {(r.bin, r.h): r.n for r in score_bin_mass_hist(df, edges).collect()}
    for i in range(6):
        lo, hi = want[i], want[i + 1]
        sel = (s >= lo) & (s < hi) if i < 5 else (s >= lo) & (s <= hi)
        assert bins[i] == int(sel.sum())
        h = np.histogram(m[sel], bins=40)[0] if sel.any() else np.zeros(40, int)
        assert [hist[(i, k)] for k in range(40)] == h.tolist()


def test_auc_matches_spark_ml_evaluator(spark, scored_rows):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector

    df = _scored(spark, scored_rows)
    ours = {r["class"]: r.auc for r in auc_ovr(df).collect()}
    ev = BinaryClassificationEvaluator(rawPredictionCol="raw", labelCol="label", metricName="areaUnderROC", numBins=0)
    for c in range(3):
        d = df.select((F.col("y") == c).cast("double").alias("label"),
                      array_to_vector(F.array(-F.col("p")[c], F.col("p")[c])).alias("raw"))
        assert close(ev.evaluate(d), ours[c], 1e-12)
