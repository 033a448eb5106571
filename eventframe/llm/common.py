"""Helpers shared by the corpus operators: table access, lineage cuts, joins with hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventframe.session import scratch_dir

#: ``broadcast_hot`` broadcasts keys holding more than this share of all rows, hence below 1,000 rows.
HOT_SHARE = 1e-3
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Rows reach Python tasks in batches of a few megabytes (Spark's own bound, 64 MB, is held several times at once: by
    the executor, by Arrow and as Python objects); a longer row is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores after it as it takes to be none of the columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below ``spark.checkpoint.dir`` and read it back: a lineage cut that survives
    the loss of any executor, since the files are in the folder that all of them share."""
    bounded(df.sparkSession)
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_hot(left: DataFrame, right: DataFrame, key: str | list[str], size: str) -> DataFrame:
    """Inner join of ``left`` with ``right`` (one row per non-null ``key``; ``size`` counts the key's rows
    in ``left``).

    Keys with over ``HOT_SHARE`` of all rows number below ``1 / HOT_SHARE``, so only they are broadcast and
    their rows stay where they are; all other rows meet in a shuffled join in which no key is large.
    """
    total = right.agg(F.sum(size)).first()[0] or 0
    hot = F.broadcast(right.where(F.col(size) > F.lit(total * HOT_SHARE)))
    cold = right.where(F.col(size) <= F.lit(total * HOT_SHARE))
    keys = [key] if isinstance(key, str) else key
    rest = left.join(hot.select(*keys), key, "left_anti").join(cold, key)
    return left.join(hot, key).unionByName(rest)


def by_batches(fn: Callable[..., dict[str, Any]], schema: pa.Schema, *columns: str):
    """A ``mapInArrow`` function: ``fn`` gets the named columns of each batch as Arrow arrays, cut to about
    16 MB of text, and returns the output columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(*(part.column(c) for c in columns))
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in ((f, out[f.name]) for f in schema)],
                    schema=schema)

    return run


def slices(batch: pa.RecordBatch, target: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``target`` bytes each (a longer row is a piece of its own)."""
    rows = max(1, int(batch.num_rows * target / max(batch.nbytes, 1)))
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive codes."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = out * np.uint64(0x100000001B3) + codes[j:j + n]
    return mix64(out)
