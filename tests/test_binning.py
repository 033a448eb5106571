import numpy as np
import pytest
from pyspark.sql import functions as F

from eventframe.operators.binning import (
    assign_mass_bins,
    choose_k,
    collect_edges,
    count_bin,
    edge_histogram,
    equal_freq_edges,
    label_bin,
)


@pytest.fixture(scope="module")
def masses(spark):
    m = np.random.default_rng(3).uniform(115, 135, 1200)
    return spark.createDataFrame([(float(x),) for x in m], "mass double"), m


def test_edges_and_histogram_match_numpy(masses):
    df, m = masses
    edges = collect_edges(equal_freq_edges(df, candidate_k=[4, 6]))
    for k in (4, 6):
        want = np.quantile(np.sort(m), np.linspace(0, 1, k + 1))
        want[0], want[-1] = 115.0, 135.0
        assert np.allclose(edges[k], want, rtol=0, atol=1e-9)
    h = {(r.K, r.b): r.n for r in edge_histogram(df, edges).collect()}
    for k in (4, 6):
        counts = np.histogram(m, bins=np.array(edges[k]))[0]
        assert [h[(k, b)] for b in range(k)] == counts.tolist()


def test_choose_k_and_fallback(masses):
    df, _ = masses
    ks = [1, 4, 6, 30]
    edges = collect_edges(equal_freq_edges(df, candidate_k=ks))
    hist = edge_histogram(df, edges)
    assert choose_k(hist, ks, min_bin_count=150) == 6  # 30 bins of 40 fail; K=1 never chosen in search
    assert choose_k(hist, ks, min_bin_count=10**6) == 1  # fallback: smallest candidate, even K < 2
    assert edges[1] == [115.0, 135.0]


def test_edge_conventions(spark):
    edges = [115.0, 120.0, 130.0, 135.0]
    df = spark.createDataFrame([(115.0,), (120.0,), (125.0,), (130.0,), (135.0,)], "m double")
    r = df.select("m", count_bin(F.col("m"), edges).alias("c"), label_bin(F.col("m"), edges).alias("l")).collect()
    got = {x.m: (x.c, x.l) for x in r}
    assert got[120.0] == (1, 0)  # inner edge: count bin is the upper one, label bin the lower one
    assert got[115.0] == (0, 0) and got[135.0] == (2, 2) and got[130.0] == (2, 1)


def test_label_bin_uses_float32(spark):
    df = spark.createDataFrame([(120.0000001,)], "dimuon_mass double")
    assert assign_mass_bins(df, [115.0, 120.0, 135.0]).first().mass_bin == 0  # rounds to 120.0f


def test_constant_masses(spark):
    df = spark.createDataFrame([(125.0,)] * 20, "mass double")
    edges = collect_edges(equal_freq_edges(df, candidate_k=[4]))
    assert edges[4] == [115.0, 125.0, 125.0, 125.0, 135.0]
    h = {r.b: r.n for r in edge_histogram(df, edges).collect()}
    assert [h[b] for b in range(4)] == np.histogram(np.full(20, 125.0), bins=np.array(edges[4]))[0].tolist()


def test_empty_window_raises(spark):
    df = spark.createDataFrame([(100.0,)], "mass double")
    with pytest.raises(Exception, match="no value inside the binning window"):
        equal_freq_edges(df, candidate_k=[2]).collect()
