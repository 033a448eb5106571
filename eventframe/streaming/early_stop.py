"""Early stopping as a stateful streaming operator (W1 applied online, as the original does per epoch).

Validation losses arrive as a stream of ``(run, epoch, loss)`` records (e.g. history lines appended
by training jobs). ``applyInPandasWithState`` keeps O(1) state per run (best, best epoch, bad-epoch
count, stopped flag, last epoch seen) in the checkpointed state store, so a restarted query resumes
exactly; each micro-batch only sees its own new rows. Epochs at or before the last one seen, and
epochs after a stop, are ignored (W4).
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from eventframe.constants import MIN_DELTA, PATIENCE

__all__ = ["early_stop_monitor", "OUTPUT_SCHEMA", "STATE_SCHEMA"]

OUTPUT_SCHEMA = ("run long, epoch long, loss double, is_best boolean, best double, best_epoch long, "
                 "num_bad int, should_stop boolean")
STATE_SCHEMA = "best double, best_epoch long, num_bad int, stopped boolean, last_epoch long"


def _updater(patience: int, min_delta: float):
    def update(key, pdfs: Iterator[pd.DataFrame], state):
        if state.exists:
            best, best_epoch, bad, stopped, last = state.get
        else:
            best, best_epoch, bad, stopped, last = None, None, 0, False, -1
        frames = [p for p in pdfs if len(p)]
        out = []
        if frames:
            batch = pd.concat(frames).sort_values("epoch", kind="stable")
            for epoch, loss in zip(batch["epoch"].tolist(), batch["loss"].tolist()):
                if stopped or epoch <= last:
                    continue
                last = epoch
                is_best = best is None or loss < best - min_delta
                if is_best:
                    best, best_epoch, bad = loss, epoch, 0
                else:
                    bad += 1
                    stopped = bad >= patience
                out.append((key[0], epoch, loss, is_best, best, best_epoch, bad, stopped))
        state.update((best, best_epoch, bad, stopped, last))
        cols = ["run", "epoch", "loss", "is_best", "best", "best_epoch", "num_bad", "should_stop"]
        yield pd.DataFrame(out, columns=cols)

    return update


def early_stop_monitor(stream: DataFrame, patience: int = PATIENCE, min_delta: float = MIN_DELTA,
                       run_col: str = "run", epoch_col: str = "epoch", loss_col: str = "loss") -> DataFrame:
    """Streaming W1: one output row per accepted epoch with the early-stopping decision."""
    s = stream.selectExpr(f"CAST({run_col} AS BIGINT) AS run", f"CAST({epoch_col} AS BIGINT) AS epoch",
                          f"CAST({loss_col} AS DOUBLE) AS loss")
    return s.groupBy("run").applyInPandasWithState(
        _updater(patience, min_delta), OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )
