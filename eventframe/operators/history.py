"""Sequence operators over run histories ``(run, epoch, loss)``.

Early stopping (W1) is a sequential fold, but its result has structure that parallelises:
- every "new best" epoch is a strict running-minimum record of the run (with ``min_delta >= 0``);
- from a best at record r the next best is the earliest record whose loss is below
  ``loss_r - min_delta``; because record losses fall with time, that is a prefix *minimum of epochs*
  over records sorted by loss (one two-level prefix aggregate);
- the chain of bests from the run's first epoch is then found by pointer doubling
  (``log2(chain length)`` rounds of equi-joins, lineage cut with ``checkpoint``);
- training stops at ``u + patience`` for the first best ``u`` whose successor is further than
  ``patience`` epochs away.
No step collects a run into one task, so a run that holds a third of all rows is still spread out.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from eventframe.constants import LAMBDA_MAX, MIN_DELTA, PATIENCE, WARMUP_EPOCHS
from eventframe.functions.scalar import nan_if_null
from eventframe.operators.ordering import ID_BUCKET, dense_index, prefix_aggregate
from eventframe.session import ensure_checkpoint_dir, written

#: Parts into which a run's rows are dealt when they meet its stop.
STOP_SALTS = 32

__all__ = [
    "history_from_events",
    "early_stopping",
    "best_epoch",
    "lambda_schedule",
    "truncate_at_stop",
    "drop_heavy",
    "epoch_means",
]


def history_from_events(events: DataFrame) -> DataFrame:
    """Fixture mapping: run = ``user_id``, epoch = position of the event in ``ts`` order inside the
    run (two-level dense index, micro-second key, ties by ``event_id``), loss = ``value``."""
    e = events.select(F.col("user_id").alias("run"), micros(events, "ts").alias("_t"), F.col("event_id").alias("_e"),
                      F.col("value").alias("loss"), "event_type")
    return prefix_aggregate(e, ["run"], ["_t", "_e"], F.col("_t"), {"epoch": ("sum", F.lit(1).cast("long"))}).drop("_t", "_e")


def micros(df: DataFrame, c: str) -> Column:
    """Microseconds since the epoch, time-zone free for ``TIMESTAMP_NTZ`` columns."""
    if isinstance(df.schema[c].dataType, TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{c}`)")
    return F.unix_micros(F.col(c))


def _ckpt(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the session's shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _before() -> dict:
    """Prefix aggregates over ``pos``: the smallest loss so far, and whether the run began with NaN, which
    is the largest value in Spark's order but never improved on."""
    return {"pm": ("min", F.col("loss")), "nan_first": ("max", F.when((F.col("pos") == 0) & F.isnan("loss"), 1).otherwise(0))}


def early_stopping(hist: DataFrame, patience: int = PATIENCE, min_delta: float = MIN_DELTA,
                   run_col: str = "run", epoch_col: str = "epoch", loss_col: str = "loss") -> DataFrame:
    """W1 + W4 per run: ``run, n_epochs, best_epoch, best_loss, stop_epoch, epochs_run``.

    A best is updated iff ``loss < best - min_delta`` (strict); ``stop_epoch`` is the epoch where the
    count of epochs without improvement reaches ``patience`` (null when training never stops). A NaN
    loss (null counts as NaN) is never better, and a NaN first loss stays the best, as nothing is below it;
    ``epochs_run`` is the number of epochs that exist after the stop (W4). Epochs are counted by
    their position in ``epoch`` order.
    """
    if min_delta < 0:
        raise ValueError("min_delta must be >= 0")
    h = hist.select(F.col(run_col).alias("run"), F.col(epoch_col).alias("epoch"), nan_if_null(loss_col).alias("loss"))
    h = dense_index(h, ["run"], "epoch", out="pos")
    h = written(h, "history")
    runs = h.groupBy("run").agg(F.count(F.lit(1)).alias("n_epochs"))
    # 1. running-minimum records (candidates for a new best)
    pm = prefix_aggregate(h, ["run"], ["pos"], F.col("pos"), _before(), bucket_width=ID_BUCKET)
    better = (F.col("loss") < F.col("pm")) & (F.col("nan_first") == 0)
    rec = _ckpt(pm.where((F.col("pos") == 0) | better).select("run", "pos", "epoch", "loss"))
    # 2. successor of each record: earliest record with loss < loss_r - min_delta
    items = rec.select("run", F.col("loss").alias("v"), F.lit(1).alias("kind"), F.col("pos").alias("t"),
                       F.lit(None).cast("long").alias("owner"))
    asks = rec.select("run", (F.col("loss") - F.lit(min_delta)).alias("v"), F.lit(0).alias("kind"),
                      F.lit(None).cast("long").alias("t"), F.col("pos").alias("owner"))
    u = prefix_aggregate(items.unionByName(asks), ["run"], ["v", "kind", "t", "owner"], F.col("v"),
                         {"nxt": ("min", F.col("t"))})
    j0 = _ckpt(u.where(F.col("kind") == 0).select("run", F.col("owner").alias("node"), "nxt"))
    # 3. chain from the first epoch by pointer doubling: S <- S u J(S); J <- J o J
    s = _ckpt(rec.where(F.col("pos") == 0).select("run", F.col("pos").alias("node")))
    j = j0
    while True:
        step = s.join(j, ["run", "node"]).where(F.col("nxt").isNotNull()).select("run", F.col("nxt").alias("node"))
        s = _ckpt(s.unionByName(step).distinct())
        a, b = j.alias("a"), j.alias("b")
        j = _ckpt(
            a.join(b, (F.col("a.run") == F.col("b.run")) & (F.col("a.nxt") == F.col("b.node")), "left")
            .select(F.col("a.run").alias("run"), F.col("a.node").alias("node"), F.col("b.nxt").alias("nxt"))
        )
        if j.where(F.col("nxt").isNotNull()).limit(1).count() == 0:
            break
    # 4. stop: first best whose successor is more than `patience` epochs away
    bests = s.join(j0, ["run", "node"]).join(runs, "run")
    gap_ok = F.col("nxt").isNull() | (F.col("nxt") > F.col("node") + patience)
    fits = F.col("node") + patience <= F.col("n_epochs") - 1
    stops = bests.where(gap_ok & fits).groupBy("run").agg(F.min("node").alias("stop_best"))
    last = bests.groupBy("run").agg(F.max("node").alias("last_best"))
    out = runs.join(last, "run").join(stops, "run", "left")
    best_pos = F.coalesce(F.col("stop_best"), F.col("last_best"))
    out = out.select("run", "n_epochs", best_pos.alias("best_pos"),
                     (F.col("stop_best") + patience).alias("stop_pos"))
    pos_epoch = h.select("run", "pos", "epoch", "loss")
    out = out.join(pos_epoch.select("run", F.col("pos").alias("best_pos"), F.col("epoch").alias("best_epoch"),
                                    F.col("loss").alias("best_loss")), ["run", "best_pos"])
    out = out.join(pos_epoch.select("run", F.col("pos").alias("stop_pos"), F.col("epoch").alias("stop_epoch")),
                   ["run", "stop_pos"], "left")
    return out.select(
        F.col("run").alias(run_col), "n_epochs", "best_epoch", "best_loss", "stop_epoch",
        F.coalesce(F.col("stop_pos") + 1, F.col("n_epochs")).alias("epochs_run"),
    )


def best_epoch(hist: DataFrame, run_col: str = "run", epoch_col: str = "epoch", loss_col: str = "loss") -> DataFrame:
    """Without early stopping an epoch is best iff ``loss <= min(previous losses)`` (ties win, NaN as in W1);
    returns the last such epoch per run and its loss."""
    h = hist.select(F.col(run_col).alias("run"), F.col(epoch_col).alias("epoch"), nan_if_null(loss_col).alias("loss"))
    h = dense_index(h, ["run"], "epoch", out="pos")
    pm = prefix_aggregate(h, ["run"], ["pos"], F.col("pos"), _before(), bucket_width=ID_BUCKET)
    b = pm.where((F.col("pos") == 0) | ((F.col("loss") <= F.col("pm")) & (F.col("nan_first") == 0)))
    return b.groupBy("run").agg(F.max("epoch").alias("best_epoch"), F.max_by("loss", "epoch").alias("best_loss")) \
        .withColumnRenamed("run", run_col)


def lambda_schedule(epoch, lambda_max: float = LAMBDA_MAX, warmup: int = WARMUP_EPOCHS) -> Column:
    """``lambda_max * min(1, (epoch + 1) / warmup)``; constant ``lambda_max`` when warmup <= 0."""
    e = F.col(epoch) if isinstance(epoch, str) else epoch
    if warmup <= 0:
        return F.lit(float(lambda_max))
    return F.lit(float(lambda_max)) * F.least(F.lit(1.0), (e + 1).cast("double") / F.lit(float(warmup)))


def truncate_at_stop(hist: DataFrame, stops: DataFrame, run_col: str = "run", epoch_col: str = "epoch") -> DataFrame:
    """Epochs after the stopping epoch do not exist."""
    salt = F.pmod(F.xxhash64(epoch_col), F.lit(STOP_SALTS)).alias("_salt")  # a run may hold a third of all rows
    s = stops.select(run_col, "stop_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(STOP_SALTS - 1).cast("long"))).alias("_salt"))
    return hist.select("*", salt).join(s, [run_col, "_salt"], "left").where(
        F.col("stop_epoch").isNull() | (F.col(epoch_col) <= F.col("stop_epoch"))).drop("stop_epoch", "_salt")


def drop_heavy(df: DataFrame, heavy: Sequence[str] = ("y_true", "proba", "masses")) -> DataFrame:
    """History rows keep summaries only."""
    return df.drop(*[c for c in heavy if c in df.columns])


def epoch_means(steps: DataFrame, group_by: Sequence[str], losses: Sequence[str] = ("loss",), ok: Column | None = None) -> DataFrame:
    """Mean of each step loss (total, class and adversary, as far as recorded) and the step count per
    (run, epoch); a mean is null (the original's NaN) when an epoch has no step. ``ok`` marks rows that
    count as steps."""
    ok = ok if ok is not None else F.lit(True)
    return steps.groupBy(*group_by).agg(
        *[F.avg(F.when(ok, F.col(c))).alias(c) for c in losses], F.count(F.when(ok, 1)).alias("steps"))
