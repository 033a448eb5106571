import math

import pytest
from pyspark.sql import functions as F

from eventframe.operators.filters import window_closed_f32, window_half_open
from eventframe.operators.scaling import apply_scaler, fit_masked_scaler, scaler_params
from eventframe.operators.tokens import build_tokens, tokens_long
from tests.helpers import INF, NAN, close, event_frame, event_row, jet


def _tokens(spark, rows, drop=()):
    df = event_frame(spark, rows, drop)
    t = tokens_long(build_tokens(df), keep=("event_id",)).collect()
    return {(r["event_id"], r["tok"]): r for r in t}


def test_mass_windows(spark):
    rows = [event_row(i, dimuon_mass=m) for i, m in enumerate([115.0, 135.0, 135.0000001, NAN, 114.9999, 134.99])]
    rows.append(event_row(99, dimuon_mass=None))
    df = event_frame(spark, rows)
    closed = {r.event_id for r in window_closed_f32(df).collect()}
    assert closed == {0, 1, 2, 5}  # 135.0000001 rounds to 135.0f; NaN and null dropped
    half = {r.event_id for r in window_half_open(df).collect()}
    assert half == {0, 5}


def test_closed_window_predicate_is_pushed(spark, tmp_out):
    df = event_frame(spark, [event_row(i, dimuon_mass=110.0 + i) for i in range(30)])
    df.write.parquet(tmp_out + "/ev")
    plan = window_closed_f32(spark.read.parquet(tmp_out + "/ev"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(dimuon_mass" in plan


def test_jet_gates(spark):
    rows = [
        event_row(1, njets_nominal=0.0, **jet(1)),  # njets gate closes
        event_row(2, njets_nominal=2.0, **jet(1), **jet(2)),
        event_row(3, njets_nominal=9.0, **jet(1), **jet(2), **jet(3), **jet(4)),  # njets > 4
        event_row(4, njets_nominal=2.0, **jet(1, phi=NAN), **jet(2)),  # NaN phi -> padding
        event_row(5, njets_nominal=1.0, **jet(1), **jet(2)),  # jet2 filled but njets=1 -> padding
        event_row(6, njets_nominal=1.0, **jet(1, pt=INF)),  # inf counts as missing
        event_row(7, njets_nominal=1.9, **jet(1, qgl=NAN)),  # truncation to 1; qgl NaN -> 0
    ]
    t = _tokens(spark, rows)
    assert [t[(1, k)]["valid"] for k in range(7)] == [1, 1, 1, 0, 0, 0, 0]
    assert [t[(2, k)]["valid"] for k in range(3, 7)] == [1, 1, 0, 0]
    assert [t[(3, k)]["valid"] for k in range(3, 7)] == [1, 1, 1, 1]
    assert t[(3, 0)]["x"][14] == 9.0  # raw njets stays in slot 14
    assert [t[(4, k)]["valid"] for k in range(3, 5)] == [0, 1]
    assert [t[(5, k)]["valid"] for k in range(3, 5)] == [1, 0]
    assert t[(6, 3)]["valid"] == 0
    assert t[(7, 3)]["valid"] == 1 and t[(7, 3)]["x"][8] == 0.0 and t[(7, 4)]["valid"] == 0
    pad = t[(1, 3)]
    assert pad["pt"] == 0.0 and all(v == 0.0 for v in pad["x"])
    assert [t[(2, k)]["type"] for k in range(7)] == [0, 1, 1, 2, 2, 2, 2]


def test_feature_slots(spark):
    r = event_row(1, njets_nominal=1.0, **jet(1, pt=20.0, eta=1.5, phi=0.3, mass=0.0, qgl=0.7))
    t = _tokens(spark, [r])
    cls, mu1, j1 = t[(1, 0)]["x"], t[(1, 1)]["x"], t[(1, 3)]["x"]
    assert close(cls[11], math.log(50.0)) and close(cls[12], math.sin(0.5)) and close(cls[13], math.cos(0.5))
    assert cls[14] == 1.0 and cls[15] == 3.0 and cls[0] == 0.0
    assert close(mu1[0], math.log(40.0)) and close(mu1[2], math.sin(1.0)) and close(mu1[5], math.log(0.10566))
    assert close(j1[4], math.log(1e-6))  # mass 0 -> log floor
    assert j1[8] == 0.7 and j1[5] == 0.0


def test_negative_mass_and_nan_muon(spark):
    r = event_row(1, mu1_mass=-1.0, mu2_phi=NAN)
    t = _tokens(spark, [r])
    assert close(t[(1, 1)]["x"][4], math.log(1e-6))
    assert math.isnan(t[(1, 2)]["x"][2])  # muons are not finite-checked (NaN flows into x)


def test_absent_jet_columns_and_null(spark):
    drop = [c for c in event_row(0) if c.startswith("jet3") or c.startswith("jet4")]
    r = event_row(1, njets_nominal=4.0, **jet(1), **jet(2, pt=None))
    t = _tokens(spark, [r], drop=drop)
    assert [t[(1, k)]["valid"] for k in range(3, 7)] == [1, 0, 0, 0]


def test_njets_null_raises(spark):
    df = event_frame(spark, [event_row(1, njets_nominal=None)])
    with pytest.raises(Exception, match="njets_nominal"):
        build_tokens(df).collect()


def test_scaler_floor_and_structural_zeros(spark):
    rows = [event_row(i, njets_nominal=1.0, **jet(1, qgl=0.1 * i)) for i in range(1, 5)]
    df = tokens_long(build_tokens(event_frame(spark, rows)), keep=("event_id",))
    sc = {r.feature: r for r in fit_masked_scaler(df).collect()}
    assert sc[6].mean == 0.0 and sc[6].std == 1.0  # reserved slot: std floor
    # qgl slot: 4 valid jets with 0.1..0.4 plus 12 structural zeros (CLS + 2 muons per event)
    vals = [0.1, 0.2, 0.3, 0.4] + [0.0] * 12
    m = sum(vals) / 16
    assert close(sc[8].mean, m)
    assert close(sc[8].std, math.sqrt(sum((v - m) ** 2 for v in vals) / 16))
    mean, std = scaler_params(fit_masked_scaler(df))
    out = apply_scaler(df, mean, std, out="xs").where("tok = 5").first()  # padding token
    assert close(out.xs[8], -mean[8] / std[8])


def test_scaler_empty_input(spark):
    df = tokens_long(build_tokens(event_frame(spark, [event_row(1)])), keep=("event_id",))
    sc = fit_masked_scaler(df.where(F.lit(False))).collect()
    assert len(sc) == 16 and all(r.mean == 0.0 and r.std == 1.0 for r in sc)
