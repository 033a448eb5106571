import random

import pytest
from pyspark.sql import functions as F

from eventframe.operators.history import (
    best_epoch,
    early_stopping,
    epoch_means,
    lambda_schedule,
    truncate_at_stop,
)
from tests.helpers import early_stopping_fold

# Recorded validation losses of the two original training runs (fixed values: the first stops at epoch 11,
# the second was cut off after 9 epochs).
RUN_B = [1.1527840852737428, 1.0057486176490784, 0.9078383564949035, 0.8879964828491211, 0.9133458256721496,
         0.9631796240806579, 0.9809940576553344, 0.9642379403114318, 0.9402443170547485, 0.9240949869155883,
         0.9164877295494079, 0.9119309544563293]
RUN_A = [1.035325860977173, 0.9805044889450073, 0.9440384984016419, 0.935847818851471, 0.9411207556724548,
         0.9441806554794312, 0.9303261518478394, 0.9233871340751648, 0.9340652585029602]


def _hist(spark, series):
    rows = [(run, e, float(v)) for run, vals in series.items() for e, v in enumerate(vals)]
    return spark.createDataFrame(rows, "run long, epoch long, loss double")


def test_recorded_runs(spark):
    h = _hist(spark, {1: RUN_B, 2: RUN_A})
    for fn in (early_stopping, early_stopping_fold):
        r = {x.run: x for x in fn(h).collect()}
        assert (r[1].best_epoch, r[1].stop_epoch, r[1].epochs_run) == (3, 11, 12)
        assert r[1].best_loss == RUN_B[3]
        assert (r[2].best_epoch, r[2].stop_epoch, r[2].epochs_run) == (7, None, 9)


def test_min_delta_is_strict(spark):
    h = _hist(spark, {1: [1.0, 1.0 - 1e-4, 0.5]})
    r = early_stopping(h, patience=1).first()
    assert (r.best_epoch, r.stop_epoch) == (0, 1)  # an improvement of exactly min_delta is not a best


def test_scalable_matches_fold(spark):
    rnd = random.Random(2)
    series = {}
    for run in range(40):
        n = rnd.randint(1, 60)
        kind = run % 4
        if kind == 0:
            vals = [1.0 - 0.00005 * i for i in range(n)]  # slow steady decrease below min_delta
        elif kind == 1:
            vals = [1.0 - 0.01 * i for i in range(n)]  # every epoch a new best
        elif kind == 2:
            vals = [round(rnd.random(), 2) for _ in range(n)]
        else:
            vals = [0.5] * n
        series[run] = vals
    h = _hist(spark, series)
    for pat, md in [(8, 1e-4), (3, 0.0), (1, 0.05)]:
        a = sorted(tuple(r) for r in early_stopping(h, pat, md).collect())
        b = sorted(tuple(r) for r in early_stopping_fold(h, pat, md).collect())
        assert a == b


def test_nan_losses(spark):
    nan = float("nan")
    h = _hist(spark, {1: [nan, 1.0, 0.9, 0.8], 2: [1.0, nan, 0.9, nan, 0.95, 0.2], 3: [nan], 4: [0.5, nan, nan, 0.4]})
    out = {r.run: r for r in early_stopping(h, patience=2).collect()}
    assert [(out[i].best_epoch, out[i].stop_epoch, out[i].epochs_run) for i in (1, 2, 3, 4)] == [(0, 2, 3), (2, 4, 5), (0, None, 1), (0, 2, 3)]
    for pat in (1, 2, 3):
        a = {r.run: r[1:3] + r[4:] for r in early_stopping(h, pat).collect()}
        assert a == {r.run: r[1:3] + r[4:] for r in early_stopping_fold(h, pat).collect()}
    best = {r.run: r.best_epoch for r in best_epoch(h).collect()}
    assert best == {1: 0, 2: 5, 3: 0, 4: 3}


def test_best_epoch_ties_and_truncation(spark):
    h = _hist(spark, {1: [1.0, 0.8, 0.8, 0.9], 2: RUN_B})
    r = {x.run: x for x in best_epoch(h).collect()}
    assert r[1].best_epoch == 2 and r[1].best_loss == 0.8  # ties become the new best
    kept = truncate_at_stop(h, early_stopping(h)).groupBy("run").count().collect()
    assert {x.run: x["count"] for x in kept} == {1: 4, 2: 12}


def test_lambda_schedule(spark):
    df = spark.range(7).select(F.col("id").alias("epoch"))
    got = [r.l for r in df.select(lambda_schedule("epoch").alias("l")).orderBy("epoch").collect()]
    assert [round(x, 12) for x in got] == [0.1, 0.2, 0.3, 0.4, 0.5, 0.5, 0.5]
    assert df.select(lambda_schedule("epoch", 0.5, 0).alias("l")).first().l == 0.5


def test_epoch_means_empty_epoch(spark):
    df = spark.createDataFrame([(1, 0, 1.0, True), (1, 0, 3.0, True), (1, 1, 9.0, False)],
                               "run long, epoch long, loss double, ok boolean")
    r = {x.epoch: x for x in epoch_means(df, ["run", "epoch"], ok=F.col("ok")).collect()}
    assert r[0].loss == 2.0 and r[0].steps == 2 and r[1].loss is None and r[1].steps == 0


def test_streaming_monitor_matches_batch(spark, tmp_out):
    from eventframe.streaming import early_stop_monitor

    series = {1: RUN_B, 2: RUN_A, 3: [0.5] * 12}
    h = _hist(spark, series)
    src = tmp_out + "/hist"
    for e in range(12):  # one file per epoch: the stream sees epochs arrive over several batches
        h.where(F.col("epoch") == e).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(h.schema).option("maxFilesPerTrigger", 3).parquet(src)
    q = (early_stop_monitor(stream).writeStream.format("memory").queryName("es_out").outputMode("append")
         .option("checkpointLocation", tmp_out + "/ckpt").start())
    q.processAllAvailable()
    q.stop()
    out = spark.sql("SELECT * FROM es_out").collect()
    stops = {r.run: r.epoch for r in out if r.should_stop}
    batch = {r.run: r for r in early_stopping(h).collect()}
    assert stops == {k: v.stop_epoch for k, v in batch.items() if v.stop_epoch is not None}
    seen = {}
    for r in out:
        seen[r.run] = max(seen.get(r.run, -1), r.epoch)
    assert {k: v + 1 for k, v in seen.items()} == {k: v.epochs_run for k, v in batch.items()}
