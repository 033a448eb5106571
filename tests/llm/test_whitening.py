"""Whitening against numpy on all rows at once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventframe.llm import whitening as W
from eventframe.llm.common import table

EMB = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], EMB).repartition(parts)


def numpy_version(vectors):
    x = np.floor(256 * np.array(vectors, np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    a = (n * fit - s) / n
    _, sigma, vt = np.linalg.svd(a, full_matrices=False)
    e = sigma ** 2 / n
    deviation = ((n * x - s).astype(object) ** 2).sum(1)
    return n, deviation, e, ((n * x - s) / n) @ vt.T / np.sqrt(e), e / e.sum()


def check(got, rows):
    ids, vectors = zip(*rows)
    n, deviation, e, z, share = numpy_version(vectors)
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(by_id) == set(ids)
    signs = None
    for i, vec in enumerate(ids):
        own = by_id[vec]
        assert sorted(own) == [1, 2, 3, 4]
        mine = np.array([own[c]["whitened"] for c in (1, 2, 3, 4)])
        if signs is None and (np.abs(z[i, :4]) > 1e-3).all():
            signs = np.sign(mine * z[i, :4])
        if signs is not None:
            assert np.allclose(mine, z[i, :4] * signs, rtol=1e-6, atol=1e-6)
        for c in own.values():
            assert c["n"] == n and c["deviation"] == (deviation[i] if deviation[i] < 1 << 63 else None) and c["identity_error"] < 1e-9
            assert c["explained"] == pytest.approx(share[c["component"] - 1], rel=1e-9)


def test_given_embeddings(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, "/root/testdata/sf0.001", "embeddings").collect()]
    got = W.op12_whitening(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check(got.collect(), rows)


def test_unusable_repeated_and_ill_conditioned_vectors(spark, tmp_path):
    r = random.Random(2)
    # scales from 30,000 down to one step of 1/256, and directions that nearly coincide
    rows = []
    for i in range(300):
        a, b = r.gauss(0, 30_000), r.gauss(0, 40)
        rows.append((i, [a, a + b, b * 3 + r.gauss(0, 1), r.gauss(0, 0.02), r.gauss(0, 900), 7.0]))
    rows += [(1000 + i, rows[0][1]) for i in range(150)]
    bad = [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5)]
    frame(spark, rows + bad).withColumn("x", F.lit("clash")).withColumn("n", F.lit(1)).write.parquet(f"{tmp_path}/embeddings.parquet")
    check(W.op12_whitening(spark, str(tmp_path)).collect(), rows)


def test_small_components_keep_their_digits(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1e6), r.gauss(0, 0.5), r.gauss(0, 0.2), r.gauss(0, 0.1)]) for i in range(400)]
    got = W.whiten(frame(spark, rows)).collect()
    share = numpy_version([v for _, v in rows])[4]
    assert got[0]["explained"] == pytest.approx(share.tolist(), rel=1e-4)
    assert got[0]["identity_error"] < 1e-4


def test_fewer_directions_than_components(spark):
    two = [(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.0]), (None, [1.0, 2.0, 3.0])]
    got = W.whiten(frame(spark, two)).collect()
    assert len(got) == 3
    for r in got:
        assert abs(r["z"][0]) == pytest.approx(1) and r["z"][1:] == [None, None] and r["explained"] == [pytest.approx(1), 0, 0]
        assert r["n"] == 2 and r["identity_error"] < 1e-12
    alone = W.whiten(frame(spark, [(1, [1.0, 2.0])] * 2)).collect()
    assert [(r["z"], r["explained"], r["deviation"], r["n"], r["identity_error"]) for r in alone] == [([None, None], [None, None], 0, 1, None)] * 2


def test_short_vectors_and_large_entries(spark):
    rows = [(1, [1.0]), (2, [1.0, 0.0]), (3, []), (4, [0.5, 1e30]), (5, [2.0, -1e30])]
    got = {r["vec_id"]: r for r in W.whiten(frame(spark, rows)).collect()}
    assert got[1]["x"] == got[2]["x"] == [256, 0] and got[3]["x"] == [0, 0] and got[4]["x"] == [128, 1 << 53]
    assert got[1]["n"] == 4 and got[4]["deviation"] is None


def test_nothing_left(spark):
    assert W.whiten(frame(spark, [(1, None), (2, [None])])).count() == 0
    (row,) = W.whiten(frame(spark, [(1, [])])).collect()
    assert (row["n"], row["z"], row["identity_error"]) == (1, [], None)


def test_every_task_sends_one_small_matrix(spark):
    rows = frame(spark, [(i, [float(i), float(i * i % 7)]) for i in range(500)], 8)
    p, r = W.cholesky_qr(lambda m: W._gram(W.quantised(rows), 500, W._sums(W.quantised(rows), 2)[1], m)[0], 500, 2)
    assert p.shape == (2, 2) and np.allclose(np.tril(r, -1), 0)
