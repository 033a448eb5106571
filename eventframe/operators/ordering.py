"""Order-dependent building blocks without single-task windows.

A window with ``orderBy`` but a low-cardinality (or no) ``partitionBy`` ranks a whole class in one
task. Every order-dependent operator here is a *two-level* prefix aggregate instead:

1. a numeric bucket key that is non-decreasing in the row order is cut into ranges at approximate
   quantiles (the cut points are a bounded list of literals, so both passes see the same buckets);
2. each bucket is aggregated (small table: partitions x buckets) and prefix-aggregated over buckets;
3. inside a bucket an ordinary window adds the local prefix; the window's hash exchange on
   ``(partition, bucket)`` is reused by the join that adds the bucket offset.

Results are exact; only the bucket *sizes* depend on the approximation. Used by the dense row index
(R1), rank-sum AUC and ROC points (A12-A14), exact-N samples (R4, R6)
and permutation draws (R10).
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventframe.functions.scalar import col_
from eventframe.session import scratch_dir, written

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def default_buckets(df: DataFrame) -> int:
    """Four buckets per shuffle partition: bucket size tracks the cluster's partition sizing."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    return max(4, 4 * n)


def add_range_bucket(df: DataFrame, key, n_buckets: int | None = None, out: str = "_b") -> DataFrame:
    """Add ``out`` = index of the key's range among approximate-quantile cut points.

    The cut points are computed once (one distributed pass, bounded list of ``n_buckets - 1``
    numbers) and applied as literals with a binary search, so repeated use gives the same buckets.
    """
    n_buckets = n_buckets or default_buckets(df)
    tmp = df.withColumn("_bk", col_(key).cast("double"))
    cuts: list[float] = []
    if n_buckets > 1:
        probs = [i / n_buckets for i in range(1, n_buckets)]
        cuts = tmp.approxQuantile("_bk", probs, 1.0 / (4 * n_buckets))
    inner = sorted({c for c in cuts if c is not None and math.isfinite(c)})
    if not inner:
        inner = [0.0]
    splits = [float("-inf")] + inner + [float("inf")]
    b = Bucketizer(splits=splits, inputCol="_bk", outputCol="_bd", handleInvalid="keep")
    return b.transform(tmp).withColumn(out, F.col("_bd").cast("int")).drop("_bk", "_bd")


def add_width_bucket(df: DataFrame, key, width: int, out: str = "_b") -> DataFrame:
    """Add ``out = floor(key / width)``: no data pass. For a key that is unique inside a partition
    (ids, row indices, positions) a bucket holds at most ``width`` rows of that partition; for a
    uniform hash key buckets are balanced."""
    return df.withColumn(out, F.floor(col_(key) / F.lit(int(width))))


def prefix_aggregate(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: Sequence,
    bucket_key,
    aggs: dict[str, tuple[str, Column]],
    *,
    inclusive: bool = False,
    n_buckets: int | None = None,
    bucket_width: int | None = None,
    keep_bucket: bool = False,
    cache_input: bool = True,
) -> DataFrame:
    """Add one column per ``aggs`` entry: the running ``sum``/``min``/``max`` over rows that come
    before the row (``inclusive`` adds the row itself) inside ``partition_by`` in ``order_by``.

    ``bucket_key`` must be numeric and non-decreasing along ``order_by`` within a partition; rows
    must be totally ordered by ``order_by`` (add a tie-break). ``partition_by`` should be low
    cardinality (classes, runs): the bucket table has one row per (partition, bucket).

    Buckets are ranges of ``bucket_key``: fixed ``bucket_width`` ranges when the key's shape is known
    (integral ids, positions, uniform hashes: no extra pass), otherwise approximate-quantile ranges
    (one extra pass over the input, balanced for any distribution).
    """
    part = list(partition_by)
    if bucket_width:
        b = add_width_bucket(df, bucket_key, bucket_width)
    else:
        b = add_range_bucket(df, bucket_key, n_buckets)
    keys = part + ["_b"]
    if cache_input:
        # two passes are inherent (bucket totals, then rows); write the input once instead of
        # recomputing its whole upstream plan for the second pass
        b = written(b, "buckets")
    # bucket totals (map-side partial aggregation) and their exclusive prefix over buckets
    tot = b.groupBy(*keys).agg(*[_AGG[fn](expr).alias(f"_t_{name}") for name, (fn, expr) in aggs.items()])
    wb = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(
        *keys, *[_AGG[fn](F.col(f"_t_{name}")).over(wb).alias(f"_o_{name}") for name, (fn, _) in aggs.items()]
    )
    # local prefix inside a bucket; its exchange on (partition, bucket) also serves the join
    hi = 0 if inclusive else -1
    wl = Window.partitionBy(*keys).orderBy(*[col_(c) for c in order_by]).rowsBetween(Window.unboundedPreceding, hi)
    local = b.select("*", *[_AGG[fn](expr).over(wl).alias(f"_l_{name}") for name, (fn, expr) in aggs.items()])
    out = local.join(offs, on=keys, how="inner")
    cols = []
    for name, (fn, _) in aggs.items():
        o, l_ = F.col(f"_o_{name}"), F.col(f"_l_{name}")
        if fn == "sum":
            cols.append((F.coalesce(o, F.lit(0)) + F.coalesce(l_, F.lit(0))).alias(name))
        elif fn == "min":
            cols.append(F.least(o, l_).alias(name))
        else:
            cols.append(F.greatest(o, l_).alias(name))
    drop = [f"_o_{n}" for n in aggs] + [f"_l_{n}" for n in aggs]
    res = out.select("*", *cols).drop(*drop)
    return res if keep_bucket else res.drop("_b")


ID_BUCKET = 1 << 20  # rows per bucket at most, for unique integral keys


def dense_index(df: DataFrame, partition_by: Sequence[str], order_col: str, out: str = "idx",
                bucket_width: int | None = ID_BUCKET) -> DataFrame:
    """0-based position of each row inside ``partition_by`` ordered by the unique numeric
    ``order_col`` (e.g. event id, or file ordinal * 2^40 + row index).

    With an integral unique key the default fixed-width buckets hold at most 2^20 rows each and need
    no extra pass; pass ``bucket_width=None`` for keys of unknown density (approximate ranges)."""
    return prefix_aggregate(
        df, partition_by, [order_col], F.col(order_col), {out: ("sum", F.lit(1).cast("long"))},
        bucket_width=bucket_width,
    )


#: Blocks up to which a position index is broadcast (about 100 bytes each; up to 64 rows of the frame a block).
MAX_BROADCAST_BLOCKS = 1 << 20


def block_index(df: DataFrame, partition_by: Sequence[str], order_col: str, out: str = "idx") -> DataFrame:
    """R1 for a unique integral key, without ranking or keeping the rows: 0-based position inside ``partition_by``.

    The frame's keys alone are reduced to one row per class and block of 64 keys: a 64-bit mask of the keys that
    are there. Blocks get the number of rows before them by a prefix sum, and a row's position is that number plus
    the mask's bits below its own. The index is written to the shared folder; up to ``MAX_BROADCAST_BLOCKS`` blocks
    it is broadcast, so the rows stay where they are, beyond that they are shuffled once by class and block.

    A key that repeats inside its class, or that only the second pass sees, is an error; rows without a key or class
    are left out. Other columns may have any names but those that begin with an underscore and are used here.
    """
    part = list(partition_by)
    key = F.col(order_col).cast("long")
    block, low = F.shiftright(key, 6), key.bitwiseAND(F.lit(63)).cast("int")
    rows = df.where(F.col(order_col).isNotNull()).dropna(subset=part) if part else df.where(F.col(order_col).isNotNull())
    narrow = rows.select(*part, block.alias("_blk"), F.call_function("shiftleft", F.lit(1).cast("long"), low).alias("_bit"))
    blocks = narrow.groupBy(*part, "_blk").agg(F.bit_or("_bit").alias("_mask"), F.count(F.lit(1)).alias("_n"))
    once = F.when(F.bit_count("_mask") == F.col("_n"), F.col("_n")).otherwise(F.raise_error(F.lit("a key of the row index repeats")))
    path = scratch_dir(df.sparkSession, "position-index")
    blocks.withColumn("_n", once).write.parquet(path)
    blocks = df.sparkSession.read.schema(blocks.schema).parquet(path)
    index = prefix_aggregate(blocks, part, ["_blk"], F.col("_blk"), {"_off": ("sum", F.col("_n"))}, bucket_width=ID_BUCKET,
                             cache_input=False).drop("_n")
    if blocks.count() <= MAX_BROADCAST_BLOCKS:
        index = F.broadcast(index)
    found = rows.withColumn("_blk", block).join(index, part + ["_blk"], "left")
    below = F.call_function("shiftleft", F.lit(-1).cast("long"), low)
    known = F.coalesce(F.col("_mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), low)), F.lit(0)) != 0
    at = F.col("_off") + F.bit_count(F.col("_mask").bitwiseAND(F.bitwise_not(below)))
    at = F.when(known, at).otherwise(F.raise_error(F.lit("the frame gave other keys in the second pass")))
    return found.withColumn(out, at.cast("long")).select(*df.columns, out)


def top_n_by_key(
    df: DataFrame, partition_by: Sequence[str], key_hex: str, n, tie: str, prefix_digits: int = 5
) -> DataFrame:
    """Exact ``row_number() over (partition by P order by key_hex, tie) <= n`` without ranking a whole
    partition in one task.

    ``key_hex`` is a lowercase hex string (e.g. md5). Rows are counted per (P, first
    ``prefix_digits`` hex digits) with map-side partial aggregation; a prefix sum over that small
    table finds, per group, the boundary prefix that holds the n-th row. One row per group (the
    boundary prefix and how many of its rows are needed) is broadcast; rows before the boundary are
    kept as they are and only rows up to the boundary are ranked (a window over the kept rows, whose
    number is about ``n`` per group). Groups shorter than ``n`` are kept whole.
    ``n`` is an int or the name of a column holding the per-group limit. ``partition_by`` must be
    low cardinality (sources, classes): the broadcast has one row per group.
    """
    part = list(partition_by)
    ncol = F.lit(n) if isinstance(n, int) else F.col(n)
    d = df.withColumn("_hb", F.substring(F.col(key_hex), 1, prefix_digits))
    cnt = d.groupBy(*part, "_hb").agg(F.count(F.lit(1)).alias("_c"), F.first(ncol).alias("_n"))
    w = Window.partitionBy(*part).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    cum = cnt.select("*", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_before"))
    edge = cum.where((F.col("_before") < F.col("_n")) & (F.col("_before") + F.col("_c") >= F.col("_n"))).select(
        *part, F.col("_hb").alias("_edge"), (F.col("_n") - F.col("_before")).alias("_need")
    )
    j = d.join(F.broadcast(edge), on=part, how="left").where(F.col("_edge").isNull() | (F.col("_hb") <= F.col("_edge")))
    we = Window.partitionBy(*part, "_hb").orderBy(F.col(key_hex), F.col(tie))
    ranked = j.withColumn("_rn", F.row_number().over(we))
    keep = F.col("_edge").isNull() | (F.col("_hb") < F.col("_edge")) | (F.col("_rn") <= F.col("_need"))
    return ranked.where(keep).drop("_hb", "_edge", "_need", "_rn")
