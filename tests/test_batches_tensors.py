"""Independent batches from keyed bijections, and scoring on three tensors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventframe.functions.bijection import keyed_position
from eventframe.operators.sampling import independent_batches, write_batches
from eventframe.operators.tokens import build_tokens
from eventframe.plans.scoring import event_tensors, masked_sum_predict_fn, score_events

from helpers import event_frame, event_row, jet


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 101, 1000])
def test_keyed_position_is_a_permutation(spark, n):
    rows = spark.range(n).select(*[keyed_position(F.col("id"), F.lit(n), F.lit(s)).alias(f"s{s}") for s in range(3)]).collect()
    for s in range(3):
        assert sorted(r[s] for r in rows) == list(range(n))
    if n > 100:
        assert len({tuple(r[s] for r in rows) for s in range(3)}) == 3
        assert abs(np.corrcoef(range(n), [r[0] for r in rows])[0, 1]) < 0.2


@pytest.fixture(scope="module")
def pool(spark):
    rows = [(c, c * 1000 + i) for c, n in [(0, 60), (1, 7), (2, 25)] for i in range(n)]
    return spark.createDataFrame(rows, "y int, event_id long")


def test_draws_are_distinct_within_a_step_and_independent_between_steps(pool):
    b = independent_batches(pool, 60, 5, steps=40).collect()
    assert len(b) == 60 * 40
    first = {}
    for s in range(40):
        own = [r for r in b if r["step"] == s]
        assert sorted(r["pos"] for r in own) == list(range(60))
        for y, n in ((0, 60), (1, 7), (2, 25)):
            ids = [r["event_id"] for r in own if r["y"] == y]
            assert len(ids) == 20 and set(ids) <= {y * 1000 + i for i in range(n)}
            if n >= 20:
                assert len(set(ids)) == 20
        first[s] = frozenset(r["event_id"] for r in own if r["y"] == 0)
    # two independent thirds of 60 rows share about 20/3; consecutive slices of one permutation would share none
    shared = [len(first[s] & first[s + 1]) for s in range(39)]
    assert 4 < np.mean(shared) < 9.5 and len(set(first.values())) == 40
    again = independent_batches(pool, 60, 5, steps=40).collect()
    assert sorted(map(tuple, b)) == sorted(map(tuple, again))


def test_batches_are_written_in_order(spark, pool, tmp_path):
    write_batches(independent_batches(pool, 30, 1), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b")).select("step", "pos", "_metadata.file_name", "_metadata.row_index").collect()
    back.sort(key=lambda r: (r["file_name"], r["row_index"]))
    assert [(r["step"], r["pos"]) for r in back] == sorted((r["step"], r["pos"]) for r in back)


def test_small_batches_and_empty_classes_are_errors(pool):
    with pytest.raises(ValueError):
        independent_batches(pool, 2, 1)
    with pytest.raises(Exception, match="class 1"):
        independent_batches(pool.where("y <> 1"), 30, 1).collect()


def test_tensors_and_scores(spark):
    rows = [event_row(1, njets_nominal=2.0, **jet(1), **jet(2, pt=33.0)), event_row(2, y=2), event_row(3, njets_nominal=1.0, **jet(1, pt=float("nan")))]
    ev = build_tokens(event_frame(spark, rows))
    mean, std = [0.1 * i for i in range(16)], [1.0 + i for i in range(16)]
    seen = {r["event_id"]: r for r in event_tensors(ev, mean, std).select("event_id", "tokens", "x", "v", "m").collect()}
    got = {r["event_id"]: r["p"] for r in score_events(event_tensors(ev, mean, std), masked_sum_predict_fn(3), batch_size=2).collect()}
    for i, r in seen.items():
        x = (np.array([t["x"] for t in r["tokens"]]) - mean) / std
        v = np.array([[t["pt"], t["eta"], t["phi"], t["mass"]] for t in r["tokens"]])
        m = np.array([t["valid"] for t in r["tokens"]], float)
        assert np.allclose(np.array(r["x"]).reshape(7, 16), x) and np.allclose(np.array(r["v"]).reshape(7, 4), v) and r["m"] == m.tolist()
        z = np.array([((x[:, c::3].sum(1) + 0.01 * v[:, c]) * m).sum() for c in range(3)])
        assert np.allclose(got[i], np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    assert seen[3]["m"] == [1, 1, 1, 0, 0, 0, 0]
    plain = event_tensors(ev).first()
    assert plain["x"][:16] == plain["tokens"][0]["x"]
