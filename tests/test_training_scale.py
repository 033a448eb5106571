"""Events, tokens and features are built once, however many classes, elements and steps read them."""

from datetime import datetime

from pyspark.sql import functions as F

from eventframe.operators.scaling import apply_scaler, scaler_params
from eventframe.operators.tokens import build_tokens, tokens_long
from eventframe.plans import queries as Q
from tests.helpers import close, event_frame, event_row, jet


def _tables(spark, folder, n=60):
    """Orders of one to seven lines, over all classes, with masses inside and outside the window."""
    at = datetime(2020, 1, 1)
    orders = [(i, i % 50, "FPO"[i % 3], 100000.0 + 5000.0 * (i % 59)) for i in range(n)]
    lines = [(i, i + j, j, j, 1.0 + j, 1000.0 + 37 * i + j, 0.01 * (j % 10), 0.01 * (j % 9), "AN"[j % 2], "O", at)
             for i in range(n) for j in range(1, 2 + i % 7)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(
        f"{folder}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                                 "l_linestatus string, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_labelled_union_builds_the_events_once(spark, tmp_out):
    out = Q.QUERIES["labelled_union"](spark, _tables(spark, tmp_out))
    rows = {r.event_id: (r.y, r.source, r.dimuon_mass) for r in out.collect()}
    names = ["ggH", "VBF", "DY"]
    assert rows == {i: (i % 3, names[i % 3], round(105 + (100000.0 + 5000.0 * (i % 59)) / 12500, 6))
                    for i in range(60) if 1 + i % 7 >= 2}
    # three branches that each build the view would split the cores, and each task would hold several times the rows
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_features_refer_to_the_tokens_once(spark, monkeypatch, tmp_out):
    rows = [event_row(i, y=i % 3, dimuon_mass=116.0 + i, njets_nominal=float(i % 3), **jet(1, pt=10.0 + i), **jet(2, eta=0.1 * i))
            for i in range(12)]
    sp = event_frame(spark, rows).withColumns({"split": F.lit("train"), "idx": F.col("event_id"), "fold": F.lit(0)})
    plans, write = {}, Q.written

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(Q, "written", watched)
    got = {r.event_id: list(r.features) for r in Q._features(sp).collect()}
    mean, std = scaler_params(Q.scaler_of(sp))
    want: dict = {}
    for r in apply_scaler(tokens_long(build_tokens(sp)), mean, std).orderBy("event_id", "tok").collect():
        want.setdefault(r.event_id, []).extend(r.x)
    assert got.keys() == want.keys() and all(len(got[k]) == 112 and all(map(close, got[k], want[k])) for k in want)
    assert plans["features"].count("transform(") <= 3 and plans["features"].count("mu1_pt") < 20


def test_probe_builds_the_events_once(spark, monkeypatch, tmp_out):
    folder, calls, build = _tables(spark, tmp_out), [], Q.events_from_tables
    monkeypatch.setattr(Q, "events_from_tables", lambda *a: calls.append(a) or build(*a))
    monkeypatch.setattr(Q, "MIN_BIN_COUNT", 1)
    out = {r.event_id for r in Q._probe_rows(spark, folder)[1].collect()}
    assert len(calls) == 1
    assert out == {i for i in range(60) if i % 7 and 115 <= 105 + (100000.0 + 5000.0 * (i % 59)) / 12500 <= 135}
