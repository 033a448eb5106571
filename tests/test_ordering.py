import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventframe.operators.ordering import dense_index, prefix_aggregate, top_n_by_key
from eventframe.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def keyed(spark):
    rnd = random.Random(7)
    rows = []
    # class 0 holds most rows (skew), keys unique per class and sparse
    for c, n in [(0, 3000), (1, 200), (2, 17)]:
        keys = rnd.sample(range(10**7), n)
        rows += [(c, k, rnd.choice([0.5, 1.0, 1.5, rnd.random()])) for k in keys]
    return spark.createDataFrame(rows, "y int, k long, v double"), rows


@pytest.mark.parametrize("width", [1 << 20, 1000, None])
def test_dense_index_matches_global_rank(keyed, width):
    df, rows = keyed
    got = {(r.y, r.k): r.idx for r in dense_index(df, ["y"], "k", bucket_width=width).collect()}
    for c in (0, 1, 2):
        ks = sorted(k for y, k, _ in rows if y == c)
        assert [got[(c, k)] for k in ks] == list(range(len(ks)))


def test_prefix_min_and_sum(keyed):
    df, rows = keyed
    out = prefix_aggregate(df, ["y"], ["k"], F.col("k"), {"s": ("sum", F.col("v")), "m": ("min", F.col("v"))},
                           n_buckets=5).collect()
    got = {(r.y, r.k): (r.s, r.m) for r in out}
    for c in (0, 1):
        pts = sorted((k, v) for y, k, v in rows if y == c)
        run_s, run_m = 0.0, None
        for k, v in pts:
            s, m = got[(c, k)]
            assert abs(s - run_s) < 1e-6 and m == run_m
            run_s += v
            run_m = v if run_m is None else min(run_m, v)


def test_prefix_inclusive(keyed):
    df, rows = keyed
    out = prefix_aggregate(df, ["y"], ["k"], F.col("k"), {"n": ("sum", F.lit(1))}, inclusive=True,
                           bucket_width=100000).where("y = 2").collect()
    assert sorted(r.n for r in out) == list(range(1, 18))


@pytest.mark.parametrize("vals", [
    [float(x) for x in np.random.default_rng(1).normal(125, 3, 2001)],
    [1.0] * 50 + [2.0] * 3 + [3.0],
    [7.0] * 10,
    [4.0],
])
def test_exact_quantiles_match_numpy(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "m double")
    probs = [i / 15 for i in range(16)] + [0.9]
    got = {r.qi: r.value for r in exact_quantiles(df, "m", probs, limit=7).collect()}
    want = np.quantile(np.array(vals), probs)
    for i, w in enumerate(want):
        assert abs(got[i] - w) <= 1e-9 * max(1.0, abs(w))


def test_exact_quantiles_empty(spark):
    df = spark.createDataFrame([], "m double")
    assert [r.value for r in exact_quantiles(df, "m", [0.5]).collect()] == [None]


def test_top_n_by_key_matches_sort(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), i, "%05x" % rnd.randrange(16**5) + "%027x" % i) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, id long, h string")
    got = {(r.g, r.id) for r in top_n_by_key(df, ["g"], "h", 1234, tie="id", prefix_digits=2).collect()}
    want = set()
    for g in "ab":
        want |= {(g, i) for _, i, _ in sorted((h, i, g) for gg, i, h in rows if gg == g)[:1234]}
    assert got == want
    short = top_n_by_key(df, ["g"], "h", 10**6, tie="id").count()
    assert short == 5000
