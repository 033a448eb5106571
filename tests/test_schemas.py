"""Files and sources with different columns, and the run history's null losses."""

import pytest
from pyspark.sql import functions as F

from eventframe.operators.history import best_epoch, early_stopping
from eventframe.plans.curation import run_curation
from eventframe.sources.parquet import read_event_files


def write(spark, path, columns, n=10):
    spark.range(n).select(F.col("id").alias("event_id"), F.lit(125.0).alias("dimuon_mass"),
                          *[(F.col("id") * 1.5).alias(c) for c in columns]).coalesce(1).write.parquet(str(path))
    return str(path)


@pytest.mark.parametrize("order", [(0, 1), (1, 0)])
def test_columns_of_all_files_are_kept(spark, tmp_path, order):
    files = [write(spark, tmp_path / "a.parquet", []), write(spark, tmp_path / "b.parquet", ["weight"])]
    df = read_event_files(spark, [files[i] for i in order], None)
    assert df.where("weight is not null").count() == 10 and df.where("weight is null").count() == 10
    out = str(tmp_path / "out")
    run_curation(spark, {"s": [files[i] for i in order]}, out)
    back = spark.read.parquet(out)
    assert back.count() == 20 and back.where("weight is not null").count() == 10


def test_each_source_keeps_its_own_schema(spark, tmp_path):
    plain, heavy = write(spark, tmp_path / "a.parquet", []), write(spark, tmp_path / "b.parquet", ["weight"], 12)
    none = write(spark, tmp_path / "c.parquet", ["weight", "other"], 0)
    out = str(tmp_path / "out")
    n = {r["source"]: r["n"] for r in run_curation(spark, {"a": [plain], "b": [heavy], "c": [none]}, out, n_keep=11).collect()}
    assert n == {"a": 10, "b": 11, "c": 0}
    columns = lambda s: set(spark.read.parquet(f"{out}/source={s}").columns)
    assert columns("a") == {"event_id", "dimuon_mass"}
    assert columns("b") == {"event_id", "dimuon_mass", "weight"}
    assert columns("c") == {"event_id", "dimuon_mass", "weight", "other"}


def test_equal_stems_are_an_error(spark, tmp_path):
    files = [write(spark, tmp_path / d / "s.parquet", []) for d in ("x", "y")]
    with pytest.raises(ValueError, match="one name"):
        run_curation(spark, files, str(tmp_path / "out"))


def test_a_run_that_begins_with_a_null_loss_stays(spark):
    hist = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.5), (2, 0, None), (2, 1, 0.5), (3, 0, 0.4), (3, 1, None), (3, 2, 0.1)], "run int, epoch long, loss double")
    got = {r["run"]: (r["n_epochs"], r["best_epoch"], r["epochs_run"]) for r in early_stopping(hist).collect()}
    assert got == {1: (2, 1, 2), 2: (2, 0, 2), 3: (3, 2, 3)}  # nothing improves on a NaN
    assert {r["run"]: r["best_epoch"] for r in best_epoch(hist).collect()} == {1: 1, 2: 0, 3: 2}
