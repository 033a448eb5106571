"""Plan-shape checks: the properties the scale design relies on stay true."""

from pyspark.sql import functions as F

from eventframe.operators.filters import window_closed_f32
from eventframe.operators.pairs import pairs_long
from eventframe.operators.scaling import fit_masked_scaler
from eventframe.operators.splits import file_row_index
from eventframe.operators.tokens import build_tokens, tokens_long
from eventframe.sources.parquet import read_event_files
from tests.helpers import event_frame, event_row, jet


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _events(spark, tmp_out):
    p = tmp_out + "/ev.parquet"
    rows = [event_row(i, dimuon_mass=110.0 + i % 30, njets_nominal=2.0, **jet(1), **jet(2)) for i in range(200)]
    event_frame(spark, rows).drop("y").write.parquet(p)
    return read_event_files(spark, [p]).withColumn("y", F.lit(0))


def test_pairs_have_no_exchange(spark, tmp_out):
    ev = window_closed_f32(_events(spark, tmp_out))
    plan = _plan(pairs_long(build_tokens(ev.drop("file_ord", "file_block").withColumn("event_id", F.col("row_index")))))
    # the only join is the scan's own with the small table of file ordinals
    assert plan.replace("BroadcastExchange", "").count("Exchange") == 0 and "SortMergeJoin" not in plan and "Generate" in plan


def test_file_row_index_does_not_shuffle_rows(spark, tmp_out):
    ev = window_closed_f32(_events(spark, tmp_out))
    plan = _plan(file_row_index(ev))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert "PushedFilters: [IsNotNull(dimuon_mass), GreaterThanOrEqual(dimuon_mass" in plan


def test_scaler_fit_is_partially_aggregated(spark, tmp_out):
    ev = _events(spark, tmp_out)
    sc = fit_masked_scaler(tokens_long(build_tokens(ev.withColumn("event_id", F.col("row_index")))))
    sc.collect()
    plan = sc._jdf.queryExecution().executedPlan().toString()
    assert "partial_avg" in plan or "partial_stddev_pop" in plan
