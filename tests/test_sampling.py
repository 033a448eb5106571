import hashlib

import pytest
from pyspark.sql import functions as F

from eventframe.operators.sampling import (
    balanced_batches,
    balanced_sample,
    class_pool_sizes,
    sample_exact_n,
    steps_for_batch,
)


@pytest.fixture(scope="module")
def pool(spark):
    rows = [(c, c * 1000 + i) for c, n in [(0, 40), (1, 7), (2, 25)] for i in range(n)]
    return spark.createDataFrame(rows, "y int, event_id long")


def _md5(*p):
    return hashlib.md5(":".join(map(str, p)).encode()).hexdigest()


def test_sample_exact_n_is_md5_order(pool):
    got = {r.event_id for r in sample_exact_n(pool, 10, 42, ("y",)).collect()}
    want = set()
    for c, n in [(0, 40), (1, 7), (2, 25)]:
        ids = [c * 1000 + i for i in range(n)]
        want |= set(sorted(ids, key=lambda e: (_md5(42, e), e))[:10])
    assert got == want  # class 1 is short and is kept whole


def test_balanced_batches_counts_and_distinct(pool):
    k, steps = 10, 4
    b = balanced_batches(pool, k, steps, seed=5).collect()
    assert len(b) == 3 * k * steps
    for s in range(steps):
        for c in (0, 2):  # pools >= k: distinct rows within a step
            ids = [r.event_id for r in b if r.step == s and r.y == c]
            assert len(ids) == k and len(set(ids)) == k
        ids1 = [r.event_id for r in b if r.step == s and r.y == 1]
        assert len(ids1) == k and set(ids1) <= {1000 + i for i in range(7)}  # with replacement
    # step 0 of a large pool is the first k rows in md5(seed:id) order
    first = sorted((r.event_id for r in b if r.step == 0 and r.y == 0))
    want = sorted(sorted(range(40), key=lambda e: (_md5(5, e), e))[:k])
    assert first == want


def test_balanced_sample_default_k_is_smallest_pool(pool):
    b = balanced_sample(pool, seed=1).groupBy("y").count().collect()
    assert sorted((r.y, r["count"]) for r in b) == [(0, 7), (1, 7), (2, 7)]


def test_deterministic(pool):
    a = sorted(tuple(r) for r in balanced_batches(pool, 8, 2, seed=9).select("step", "y", "draw", "event_id").collect())
    b = sorted(tuple(r) for r in balanced_batches(pool, 8, 2, seed=9).select("step", "y", "draw", "event_id").collect())
    assert a == b


def test_empty_pool_raises(pool):
    with pytest.raises(Exception, match="no rows to draw from in class 1"):
        class_pool_sizes(pool.where("y <> 1")).collect()


def test_steps_for_batch():
    assert steps_for_batch(100, 30) == (10, 10)
    with pytest.raises(ValueError):
        steps_for_batch(100, 2)
