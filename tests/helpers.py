"""Small literal event frames for unit tests (FIXTURES.md F3)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from eventframe.constants import EVENT_COLUMNS

NAN = float("nan")
INF = float("inf")

BASE = {
    "MET_pt": 50.0, "MET_phi": 0.5,
    "mu1_pt": 40.0, "mu1_eta": 0.1, "mu1_phi": 1.0, "mu1_mass": 0.10566,
    "mu2_pt": 30.0, "mu2_eta": -0.2, "mu2_phi": -2.0, "mu2_mass": 0.10566,
    "dimuon_mass": 125.0, "dimuon_pt_log": 3.0, "njets_nominal": 0.0,
}


def event_row(event_id: int, y: int = 0, **over):
    r = {c: BASE.get(c, NAN) for c in EVENT_COLUMNS}
    r.update(over)
    return {"event_id": event_id, "y": y, **r}


def event_frame(spark, rows, drop=()):
    cols = ["event_id", "y"] + [c for c in EVENT_COLUMNS if c not in drop]
    fields = [StructField("event_id", LongType()), StructField("y", IntegerType())] + [
        StructField(c, DoubleType()) for c in cols[2:]
    ]
    data = [tuple(r.get(c) for c in cols) for r in rows]
    return spark.createDataFrame(data, StructType(fields))


def jet(j, pt=20.0, eta=1.0, phi=0.3, mass=5.0, qgl=0.5):
    return {f"jet{j}_pt_nominal": pt, f"jet{j}_eta_nominal": eta, f"jet{j}_phi_nominal": phi,
            f"jet{j}_mass_nominal": mass, f"jet{j}_qgl_nominal": qgl}


def close(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) and math.isnan(a):
        return isinstance(b, float) and math.isnan(b)
    return abs(a - b) <= tol * max(1.0, abs(a), abs(b))


def early_stopping_fold(hist: DataFrame, patience: int = 8, min_delta: float = 1e-4) -> DataFrame:
    """W1 as the literal sequential fold over the sorted list of a run."""
    s = hist.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("epoch", "loss"))).alias("xs"))
    init = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("long").alias("best_epoch"),
                    F.lit(0).alias("bad"), F.lit(None).cast("long").alias("stop"), F.lit(0).alias("n"))

    def merge(acc: Column, x: Column) -> Column:
        below = (x["loss"] < acc["best"] - F.lit(min_delta)) & ~F.isnan(acc["best"])  # nothing is below NaN
        better = acc["best"].isNull() | below
        upd = F.struct(x["loss"].alias("best"), x["epoch"].cast("long").alias("best_epoch"), F.lit(0).alias("bad"),
                       F.lit(None).cast("long").alias("stop"), (acc["n"] + 1).alias("n"))
        bad = F.struct(acc["best"].alias("best"), acc["best_epoch"].alias("best_epoch"), (acc["bad"] + 1).alias("bad"),
                       F.when(acc["bad"] + 1 >= patience, x["epoch"].cast("long")).alias("stop"),
                       (acc["n"] + 1).alias("n"))
        return F.when(acc["stop"].isNotNull(), acc).otherwise(F.when(better, upd).otherwise(bad))

    r = s.select("run", F.size("xs").alias("n_epochs"), F.aggregate("xs", init, merge).alias("st"))
    return r.select("run", "n_epochs", F.col("st.best_epoch").alias("best_epoch"), F.col("st.best").alias("best_loss"),
                    F.col("st.stop").alias("stop_epoch"), F.col("st.n").cast("long").alias("epochs_run"))
