"""Row index by blocks of keys, and the report as one plan."""

import random

import pytest
from pyspark.sql import functions as F

from eventframe.operators import ordering
from eventframe.operators.ordering import block_index
from eventframe.operators.splits import row_index
from eventframe.plans.evaluate import evaluation_report

KEYS = [0, 63, 64, 127, 128, -1, -64, -65, 2**40, 2**62 + 1, 2**62, -(2**62)]


def _rows():
    rnd = random.Random(3)
    return [(0, k) for k in rnd.sample(range(5000), 3000)] + [(1, k) for k in KEYS] + [(2, 7)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_positions_equal_the_global_rank(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(ordering, "MAX_BROADCAST_BLOCKS", 0)
    rows = _rows() + [(1, None), (None, 4)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "y int, k long").withColumn("n", F.lit("wide"))
    got = {(r.y, r.k): r.idx for r in block_index(df, ["y"], "k").collect()}
    want = {(y, k): i for y in (0, 1, 2) for i, k in enumerate(sorted(k for c, k in _rows() if c == y))}
    assert got == want


def test_rows_are_neither_kept_nor_moved(spark):
    df = spark.createDataFrame(_rows(), "y int, k long").withColumn("wide", F.rand(1))
    out = row_index(df, "k")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan and "BroadcastHashJoin" in plan
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "wide" in line]
    assert out.columns == ["y", "k", "wide", "idx"]


def test_repeated_keys_are_an_error_and_nothing_stays_nothing(spark):
    df = spark.createDataFrame([(0, 5), (0, 5)], "y int, k long")
    with pytest.raises(Exception, match="repeats"):
        block_index(df, ["y"], "k").collect()
    assert block_index(df.where("k < 0"), ["y"], "k").collect() == []
    assert [r.idx for r in row_index(df.select("y", F.col("k").cast("double") + F.rand(2)).toDF("y", "k"), "k").collect()] in ([0, 1], [1, 0])


def test_report_of_one_plan(spark):
    rows = [(0, [.5, .3, .2], 120.0), (1, [.2, .6, .2], 121.0), (2, [.1, .2, .7], 124.0), (2, [.4, .35, .25], 119.0)]
    r = evaluation_report(spark, spark.createDataFrame(rows, "y int, p array<double>, mass double")).first()
    assert (r.test_accuracy, r.n_test, r.auc_0, r.auc_1, r.auc_2, r.vbf_purity_top10pct) == (0.75, 4, 1.0, 1.0, 1.0, 1.0)
    assert r.dy_mass_sculpting_pearson_r == pytest.approx(-1.0)
    one = evaluation_report(spark, spark.createDataFrame([x for x in rows if x[0] != 1], "y int, p array<double>, mass double")).first()
    assert one.auc_1 is None and one.n_test == 3


def test_nothing_stays_cached(spark, keyed_history):
    from eventframe.operators.history import early_stopping
    from eventframe.operators.metrics import auc_ovr

    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    early_stopping(keyed_history).collect()
    auc_ovr(spark.createDataFrame([(0, [.5, .3, .2]), (1, [.2, .6, .2])], "y int, p array<double>")).collect()
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


@pytest.fixture
def keyed_history(spark):
    return spark.createDataFrame([(r, e, 1.0 / (e + 1)) for r in (0, 1) for e in range(6)], "run int, epoch int, loss double")
