import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from eventframe.operators.splits import file_order_key, row_index
from eventframe.plans.curation import output_name, run_curation
from eventframe.plans.prepare import events_from_files, split_events
from eventframe.plans.queries import QUERIES
from eventframe.sources.artifacts import read_bins, read_scaler, write_bins, write_parquet, write_scaler
from eventframe.sources.parquet import check_files_exist, read_event_files
from tests.conftest import SF_SMALL
from tests.helpers import event_frame, event_row


def _write(spark, path, ids, mass=125.0, y=0):
    event_frame(spark, [event_row(i, y=y, dimuon_mass=mass + (i % 7)) for i in ids]).drop("y", "event_id") \
        .withColumn("tag", F.lit(1)).coalesce(1).write.parquet(path)


def test_file_order_follows_list_not_path(spark, tmp_out):
    a, b = tmp_out + "/a.parquet", tmp_out + "/b.parquet"
    _write(spark, a, range(5))
    _write(spark, b, range(100, 103))
    df = read_event_files(spark, [b, a])  # list order is the reverse of path order
    ords = df.groupBy("file_ord").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.file_ord: r.n for r in ords} == {0: 3, 1: 5}
    idx = row_index(df.withColumn("y", F.lit(0)).withColumn("_ord", file_order_key()), "_ord").collect()
    got = sorted((r.idx, r.file_ord, r.row_index) for r in idx)
    assert [(f, r) for _, f, r in got] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (1, 3), (1, 4)]


def test_missing_files_all_reported(spark, tmp_out):
    with pytest.raises(FileNotFoundError) as e:
        check_files_exist(spark, [tmp_out + "/x.parquet", tmp_out + "/y.parquet"])
    assert "x.parquet" in str(e.value) and "y.parquet" in str(e.value)


def test_events_from_files_folds_per_class(spark, tmp_out):
    paths = {}
    for name, y in [("ggH", 0), ("VBF", 1), ("DY", 2)]:
        p = tmp_out + f"/{name}.parquet"
        _write(spark, p, range(y * 10, y * 10 + 9), y=y)
        paths[name] = [p]
    sp = split_events(events_from_files(spark, paths))
    c = {(r.y, r.split): r["count"] for r in sp.groupBy("y", "split").count().collect()}
    assert c[(0, "train")] == 5 and c[(0, "val")] == 2 and c[(0, "test")] == 2


def test_empty_sink_keeps_schema(spark, tmp_out):
    df = spark.createDataFrame([(1, 2.0)], "a long, b double").where(F.lit(False))
    write_parquet(df, tmp_out + "/e")
    back = spark.read.parquet(tmp_out + "/e")
    assert back.count() == 0 and [f.name for f in back.schema.fields] == ["a", "b"]


def test_scaler_and_bins_roundtrip(spark, tmp_out):
    sc = spark.createDataFrame([(i, float(i), 1.0 + i) for i in range(16)], "feature int, mean double, std double")
    write_scaler(sc, tmp_out + "/s")
    back = sorted(tuple(r) for r in read_scaler(spark, tmp_out + "/s").collect())
    assert back == sorted(tuple(r) for r in sc.collect())
    write_bins(3, [115.0, 120.0, 130.0, 135.0], spark, tmp_out + "/b")
    assert [r.edge for r in read_bins(spark, tmp_out + "/b").orderBy("b").collect()] == [115.0, 120.0, 130.0, 135.0]


def test_curation_job(spark, tmp_out):
    big, small, none = tmp_out + "/big.parquet", tmp_out + "/small.parquet", tmp_out + "/none.parquet"
    _write(spark, big, range(50))
    _write(spark, small, range(3))
    _write(spark, none, range(4), mass=150.0)
    out = tmp_out + "/curated"
    counts = run_curation(spark, {"big": [big], "small": [small], "none": [none]}, out, n_keep=10, seed=42)
    assert {r.source: r.n for r in counts.collect()} == {"big": 10, "small": 3, "none": 0}
    assert os.path.isdir(out + "/source=none")  # empty source: readable output with the schema
    assert output_name("/x/ggh_merged.parquet") == "ggh_merged_hpeak_10k"


def test_curation_keeps_numeric_names_and_all_columns(spark, tmp_out):
    _write(spark, tmp_out + "/2017.parquet", range(20))
    _write(spark, tmp_out + "/2018.parquet", range(30))
    out = tmp_out + "/curated"
    counts = run_curation(spark, {"2017": [tmp_out + "/2017.parquet"], "2018": [tmp_out + "/2018.parquet"]}, out, n_keep=10)
    assert {r.source: r.n for r in counts.collect()} == {"2017": 10, "2018": 10}
    back = spark.read.parquet(out + "/source=2018")
    assert back.count() == 10 and sorted(back.columns) == sorted(spark.read.parquet(tmp_out + "/2018.parquet").columns)
    assert "tag" in back.columns
    named = run_curation(spark, [tmp_out + "/2017.parquet"], tmp_out + "/by_file", n_keep=5)
    assert [tuple(r) for r in named.collect()] == [("2017_hpeak_10k", 5)]


def test_curation_without_survivors(spark, tmp_out):
    _write(spark, tmp_out + "/a.parquet", range(4), mass=150.0)
    out = tmp_out + "/curated"
    counts = run_curation(spark, {"a=1/x": [tmp_out + "/a.parquet"]}, out)
    assert [tuple(r) for r in counts.collect()] == [("a=1/x", 0)]
    back = spark.read.parquet(out)
    assert back.count() == 0 and "tag" in back.columns and "file_block" not in back.columns


def test_files_listed_twice_and_many_ordinals(spark, tmp_out):
    _write(spark, tmp_out + "/a.parquet", range(3))
    _write(spark, tmp_out + "/b.parquet", range(2))
    a, b = tmp_out + "/a.parquet", tmp_out + "/b.parquet"
    rows = read_event_files(spark, [a, b, a], columns=None).groupBy("file_ord").count().collect()
    assert {r.file_ord: r["count"] for r in rows} == {0: 3, 1: 2, 2: 3}
    keys = spark.createDataFrame([(0, 65536, 7), (1, 0, 7), (0, 2**24 - 1, 2**36 - 1)], "y int, file_ord int, row_index long")
    ids = [r[0] for r in keys.select(F.col("y").cast("long") * F.lit(1 << 60) + file_order_key()).collect()]
    assert len(set(ids)) == 3
    with pytest.raises(Exception, match="too large"):
        spark.createDataFrame([(2**24, 0)], "file_ord int, row_index long").select(file_order_key()).collect()


def test_entry_contract(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 16 and df.columns == ["feature", "mean", "std"]
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and set(QUERIES) - set(sql) == {"train_lr", "mass_leakage_probe"}


@pytest.mark.parametrize("name", ["masked_scaler", "fold_split_counts", "auc_ovr", "early_stopping", "pair_valid_keys"])
def test_oracle_agreement_small(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF_SMALL)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    cols = sorted(sdf.columns)
    assert cols == sorted(ocols)
    a = sorted(tuple(r[c] for c in cols) for r in sdf.collect())
    b = sorted(tuple(dict(zip(ocols, r))[c] for c in cols) for r in res.fetchall())
    assert a == b


def test_history_documents_reader(spark, tmp_out):
    import json

    from eventframe.sources.artifacts import read_history_documents

    doc = {
        "train": [{"epoch": 0, "loss": 3.9, "loss_cls": 1.2, "loss_adv": 2.7, "lambda_grl": 0.1, "steps": 1},
                  {"epoch": 1, "loss": 3.8, "loss_cls": 1.1, "loss_adv": 2.7, "lambda_grl": 0.2, "steps": 1}],
        "val": [{"loss": 1.15, "accuracy": 0.4, "auc_ovr": {"0": 0.6, "1": 0.7, "2": 0.65}, "epoch": 0},
                {"loss": 1.0, "accuracy": 0.5, "auc_ovr": {"0": 0.61, "1": 0.72, "2": 0.66}, "epoch": 1}],
    }
    for run in ("r1", "r2"):
        os.makedirs(f"{tmp_out}/runs/{run}")
        with open(f"{tmp_out}/runs/{run}/history.json", "w") as f:
            json.dump(doc, f, indent=2)
    h = read_history_documents(spark, f"{tmp_out}/runs/*/history.json")
    rows = h.collect()
    assert len(rows) == 8 and {r.run_id for r in rows} == {"r1", "r2"}
    v = [r for r in rows if r.part == "val" and r.epoch == 1 and r.run_id == "r1"][0]
    assert v.loss == 1.0 and v.auc_ovr["1"] == 0.72


def test_file_row_index_many_splits(spark, tmp_out):
    from eventframe.operators.filters import window_closed_f32
    from eventframe.operators.splits import file_row_index

    paths = []
    for k, n in enumerate([3000, 5000, 1000]):
        p = f"{tmp_out}/f{k}.parquet"
        rows = [event_row(k * 10000 + i, dimuon_mass=100.0 + (i * 37 % 50)) for i in range(n)]
        event_frame(spark, rows).coalesce(1).write.option("parquet.block.size", 16384).parquet(p)
        paths.append(p)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")  # several splits per file
    try:
        order = [paths[2], paths[0], paths[1]]
        df = read_event_files(spark, order, columns=["dimuon_mass"])
        assert df.select("file_block").distinct().count() > 3
        w = window_closed_f32(df.withColumn("y", F.lit(0)))
        got = sorted((r.idx, r.file_ord, r.row_index) for r in file_row_index(w).collect())
        want = sorted((r.file_ord, r.row_index) for r in w.collect())
        assert [(f, ri) for _, f, ri in got] == want and [i for i, _, _ in got] == list(range(len(want)))
        with pytest.raises(Exception, match="not contiguous"):
            file_row_index(w.repartition(7)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fold_sizes_balanced(spark):
    from eventframe.plans.prepare import events_from_tables, split_events

    sp = split_events(events_from_tables(spark, SF_SMALL))
    c = sp.groupBy("y", "fold").count().collect()
    for y in (0, 1, 2):
        n = [r["count"] for r in c if r.y == y]
        assert len(n) == 4 and max(n) - min(n) <= 1
    idx = sp.groupBy("y").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.lo == 0 and r.hi == r.n - 1 for r in idx)
