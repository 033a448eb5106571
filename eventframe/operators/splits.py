"""Row index, folds, named splits, per-class counts and global ids.

The index is a dense per-class position in a stated total order (file ordinal then row index for
files, or event id). It is computed with the block index or the two-level prefix sum in :mod:`ordering`,
never with a window that ranks a whole class in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from eventframe.constants import N_FOLDS, SPLIT_FOLDS
from eventframe.operators.ordering import block_index, dense_index
from eventframe.session import scratch_dir

#: File splits up to which their offsets are broadcast (about 50 bytes each).
MAX_BROADCAST_SPLITS = 1_000_000

__all__ = [
    "row_index",
    "file_row_index",
    "assign_folds",
    "assign_splits",
    "class_counts",
    "global_ids",
    "file_order_key",
]


def file_order_key(file_ord_col: str = "file_ord", row_index_col: str = "row_index"):
    """Numeric order key = file ordinal * 2^36 + row index inside the file (unique, list order): 2^24
    files of 2^36 rows, which leaves the top bits of an event id for the class."""
    file_ord, row = F.col(file_ord_col).cast("long"), F.col(row_index_col).cast("long")
    fits = (file_ord < F.lit(1 << 24)) & (row < F.lit(1 << 36))
    return F.when(fits, file_ord * F.lit(1 << 36) + row).otherwise(F.raise_error(F.lit("file ordinal or row index too large for one key")))


def row_index(df: DataFrame, order_col: str, partition_by=("y",), out: str = "idx") -> DataFrame:
    """Dense 0-based position after filtering, per class, in ``order_col`` order. Integral keys are indexed by
    blocks without moving the rows (:func:`ordering.block_index`), others by the two-level prefix sum."""
    if isinstance(df.schema[order_col].dataType, IntegralType):
        return block_index(df, list(partition_by), order_col, out)
    return dense_index(df, list(partition_by), order_col, out)


def file_row_index(df: DataFrame, partition_by=("y",), out: str = "idx") -> DataFrame:
    """R1 for frames read with :func:`read_event_files` (after row-wise filters/projections only):
    the dense per-class position in file-list order *without shuffling the rows*.

    A file split is read by one task, in row order, so after the filters its surviving rows get
    consecutive ``monotonically_increasing_id`` values. Pass 1 counts survivors per split (one row per
    ~128 MB split) and takes their first id; a prefix sum over splits in (file ordinal, split start)
    order gives each split's offset; pass 2 adds ``offset + id - first_id``. Both passes are checked: ids
    of a split that are not contiguous in pass 1 (the frame was shuffled before), or a row of pass 2
    whose id lies outside its split's range (the scan was packed into other tasks), raise an error
    instead of giving wrong indices. The split table is written once to the shared folder and broadcast
    up to ``MAX_BROADCAST_SPLITS`` rows.
    """
    part = list(partition_by)
    d = df.withColumn("_mid", F.monotonically_increasing_id())
    seg_keys = part + ["file_ord", "file_block"]
    seg = d.groupBy(*seg_keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"), F.max("_mid").alias("_m1"))
    w = Window.partitionBy(*part).orderBy("file_ord", "file_block").rowsBetween(Window.unboundedPreceding, -1)
    ok = F.col("_m1") - F.col("_m0") + 1 == F.col("_n")
    offs = seg.select(
        *seg_keys,
        F.when(ok, F.col("_m0")).otherwise(F.raise_error(F.lit("rows of a file split are not contiguous; "
                                                               "index the scan before any shuffle"))).alias("_m0"),
        "_n", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"),
    )
    path = scratch_dir(df.sparkSession, "split-offsets")
    offs.write.parquet(path)
    offs = df.sparkSession.read.schema(offs.schema).parquet(path)
    if offs.count() <= MAX_BROADCAST_SPLITS:
        offs = F.broadcast(offs)
    at = F.col("_mid") - F.col("_m0")
    at = F.when((at >= 0) & (at < F.col("_n")), at).otherwise(F.raise_error(F.lit("the scan was split differently in the second pass; retry")))
    return d.join(offs, seg_keys).withColumn(out, (F.col("_off") + at).cast("long")).drop("_mid", "_m0", "_n", "_off")


def assign_folds(df: DataFrame, n_folds: int = N_FOLDS, idx_col: str = "idx", out: str = "fold") -> DataFrame:
    """R2: ``fold = idx mod n_folds``."""
    return df.withColumn(out, F.pmod(F.col(idx_col), F.lit(n_folds)).cast("int"))


def assign_splits(df: DataFrame, spec: dict | None = None, fold_col: str = "fold", out: str = "split") -> DataFrame:
    """Named splits; a fold may belong to several splits or none, so this is an explode over the
    names of the splits whose fold list contains the row's fold (map-side, no join, no shuffle)."""
    spec = spec or SPLIT_FOLDS
    names = F.array(*[F.when(F.col(fold_col).isin([int(f) for f in folds]), F.lit(name))
                      for name, folds in spec.items()])
    return df.select("*", F.explode(F.array_compact(names)).alias(out))


def class_counts(df: DataFrame, label_col: str = "y") -> DataFrame:
    """A4 + O7: rows per class, the total, and the exclusive running offset in class order.

    The aggregate has one row per class, so the window below runs over a handful of rows.
    """
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(label_col).rowsBetween(Window.unboundedPreceding, -1)
    wa = Window.partitionBy(F.lit(0))
    return c.select(
        label_col,
        "n",
        F.coalesce(F.sum("n").over(w), F.lit(0)).alias("class_offset"),
        F.sum("n").over(wa).alias("n_total"),
    )


def global_ids(df: DataFrame, label_col: str = "y", idx_col: str = "idx", out: str = "gid") -> DataFrame:
    """Disjoint id ranges per class: ``gid = offset(class) + idx``."""
    offs = class_counts(df, label_col).select(label_col, "class_offset")
    return df.join(F.broadcast(offs), on=label_col).withColumn(out, F.col("class_offset") + F.col(idx_col)).drop("class_offset")
