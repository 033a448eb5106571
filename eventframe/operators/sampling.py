"""Deterministic sampling.

The original draws with an unseeded RNG; here every draw is a function of an explicit seed through
md5, so results are reproducible and identical in any engine with md5. Nothing is collected: exact-N
selection uses :func:`ordering.top_n_by_key` (only one boundary bucket per group is ranked), draws
are generated with ``spark.range`` and matched to rows by an equi-join on ``(y, rank)``.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventframe.constants import LABELS
from eventframe.functions.bijection import keyed_position
from eventframe.functions.scalar import hash_int, hash_key
from eventframe.operators.ordering import prefix_aggregate, top_n_by_key
from eventframe.sources.artifacts import write_parquet

__all__ = [
    "sample_exact_n",
    "class_pool_sizes",
    "permutation_rank",
    "balanced_batches",
    "balanced_sample",
    "balanced_steps",
    "independent_batches",
    "steps_for_batch",
    "write_batches",
]


def sample_exact_n(df: DataFrame, n: int, seed: int, partition_by: Sequence[str] = ("source",),
                   key: str = "event_id") -> DataFrame:
    """R4 + R5: exactly ``n`` rows per group without replacement (all rows when the group is short),
    chosen by ``md5(seed:key)`` order. Row order is restored by the caller with ``orderBy(_ord)`` (O2)."""
    d = df.withColumn("_h", hash_key(F.lit(seed), F.col(key)))
    return top_n_by_key(d, list(partition_by), "_h", int(n), tie=key).drop("_h")


def class_pool_sizes(pool: DataFrame, label_col: str = "y", labels: Sequence[int] | None = None) -> DataFrame:
    """Pool size per class *including* empty classes (left join from the label list), with R12's
    empty-pool error raised inside the plan."""
    labels = list(labels) if labels is not None else sorted(LABELS.values())
    counts = pool.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    lab = pool.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in labels])).alias(label_col))
    out = lab.join(counts, label_col, "left").select(label_col, F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn(
        "n",
        F.when(F.col("n") > 0, F.col("n")).otherwise(
            F.raise_error(F.concat(F.lit("no rows to draw from in class "), F.col(label_col).cast("string")))
        ),
    )


HASH_BUCKET = 1 << 28  # 2^20 equal ranges of the uniform 48-bit hash


def permutation_rank(pool: DataFrame, seed: int, label_col: str = "y", key: str = "event_id",
                     out: str = "rank") -> DataFrame:
    """Dense 0-based position of each row inside its class in ``md5(seed:key)`` order (a seeded
    permutation), computed with the two-level prefix sum (no class-wide window)."""
    d = pool.withColumn("_h", hash_key(F.lit(seed), F.col(key)))
    d = d.withColumn("_hi", F.conv(F.substring("_h", 1, 12), 16, 10).cast("long"))
    return prefix_aggregate(
        d, [label_col], [F.col("_hi"), F.col("_h"), F.col(key)], F.col("_hi"),
        {out: ("sum", F.lit(1).cast("long"))}, bucket_width=HASH_BUCKET,
    ).drop("_h", "_hi")


def steps_for_batch(max_pool: int, batch_size: int) -> tuple[int, int]:
    """``k = batch // 3`` rows per class, ``steps = ceil(3 * max_pool / batch)``."""
    k = batch_size // 3
    if k < 1:
        raise ValueError("a balanced batch needs at least one row of each of the three classes")
    return k, int(math.ceil(3 * max_pool / batch_size))


def balanced_batches(pool: DataFrame, k: int, steps: int, seed: int, label_col: str = "y",
                     key: str = "event_id", labels: Sequence[int] | None = None) -> DataFrame:
    """R6-R8 + R10 + R12: for each step, ``k`` rows from every class pool.

    A class with at least ``k`` rows contributes ``k`` distinct rows per step: consecutive positions
    ``(step*k + j) mod n`` of its seeded permutation, so step 0 is the first ``k`` rows in md5 order.
    A shorter class is drawn with replacement: position ``md5int(seed:step:y:j) mod n`` (R7).
    Draws come from ``spark.range`` (distributed, O(output)); rows are matched by an equi-join on
    ``(class, rank)``. ``shuffle_key`` gives the in-batch order (R8).

    Returns ``step, y, draw, <pool columns>, shuffle_key``.
    """
    labels = list(labels) if labels is not None else sorted(LABELS.values())
    spark = pool.sparkSession
    sizes = class_pool_sizes(pool, label_col, labels)
    per_class = int(steps) * int(k)
    lab_arr = F.array(*[F.lit(c) for c in labels])
    draws = spark.range(per_class * len(labels)).select(
        lab_arr[(F.col("id") / per_class).cast("int")].alias(label_col),
        (F.pmod(F.col("id"), F.lit(per_class)) / k).cast("long").alias("step"),
        F.pmod(F.col("id"), F.lit(k)).alias("draw"),
    )
    draws = draws.join(F.broadcast(sizes), label_col)  # one row per class: bounded
    target = F.when(
        F.col("n") >= F.lit(k), F.pmod(F.col("step") * F.lit(k) + F.col("draw"), F.col("n"))
    ).otherwise(F.pmod(hash_int(F.lit(seed), F.col("step"), F.col(label_col), F.col("draw")), F.col("n")))
    draws = draws.select(label_col, "step", "draw", target.alias("rank"))
    ranked = permutation_rank(pool, seed, label_col, key)
    out = draws.join(ranked, [label_col, "rank"], "inner")
    return out.withColumn(
        "shuffle_key", hash_key(F.lit(seed), F.col("step"), F.col(label_col), F.col("draw"))
    ).drop("rank")


def balanced_sample(pool: DataFrame, seed: int, k: int | None = None, label_col: str = "y",
                    key: str = "event_id") -> DataFrame:
    """R6 + R9: one balanced batch; ``k`` defaults to the smallest class pool (a 3-row aggregate)."""
    if k is None:
        k = int(class_pool_sizes(pool, label_col).agg(F.min("n")).first()[0])
    return balanced_batches(pool, k, 1, seed, label_col, key)


def balanced_steps(pool: DataFrame, batch_size: int, seed: int, label_col: str = "y",
                   key: str = "event_id") -> DataFrame:
    """``ceil(3*max/batch)`` balanced batches of ``batch // 3`` rows per class."""
    mx = int(class_pool_sizes(pool, label_col).agg(F.max("n")).first()[0])
    k, steps = steps_for_batch(mx, batch_size)
    return balanced_batches(pool, k, steps, seed, label_col, key)


def independent_batches(pool: DataFrame, batch_size: int, seed: int, steps: int | None = None, label_col: str = "y",
                        key: str = "event_id", labels: Sequence[int] | None = None) -> DataFrame:
    """R6-R8 + R10: batches of ``batch_size // 3`` rows per class, each drawn independently of the others and in a
    shuffled order.

    The pool is ranked once. Step ``s`` draws from a class with at least ``k`` rows the ranks that a permutation of its own
    (:func:`keyed_position`, key ``seed, s, class``) gives to 0..k-1: distinct within the step, independent between
    steps, and computed for each draw alone, so no step ranks or reads the pool again. A shorter class is drawn with
    replacement. ``pos``, the place in the batch, is another such permutation of the batch's rows: no sort.
    ``steps`` is ``ceil(3 * largest pool / batch_size)`` unless given.

    Returns ``step, pos, y, draw, <pool columns>``.
    """
    labels = list(labels) if labels is not None else sorted(LABELS.values())
    sizes = class_pool_sizes(pool, label_col, labels)
    k, all_steps = steps_for_batch(int(sizes.agg(F.max("n")).first()[0]), batch_size)
    steps = all_steps if steps is None else steps
    per_step = k * len(labels)
    seed_, step, y = F.lit(seed), F.col("step"), F.col(label_col)
    draws = pool.sparkSession.range(steps * per_step).select(
        F.expr(f"id div {per_step}").alias("step"), (F.col("id") % per_step).alias("row"))
    draws = draws.select("step", "row", F.array(*map(F.lit, labels))[F.expr(f"cast(row div {k} as int)")].alias(label_col), (F.col("row") % k).alias("draw"))
    draws = draws.join(F.broadcast(sizes), label_col)  # one row per class
    rank = F.when(F.col("n") >= k, keyed_position(F.col("draw"), F.greatest("n", F.lit(k)), seed_, step, y)).otherwise(
        hash_int(seed_, step, y, F.col("draw")) % F.col("n"))
    pos = keyed_position(F.col("row"), F.lit(per_step), seed_, step, F.lit("order"))
    draws = draws.select("step", pos.alias("pos"), label_col, "draw", rank.alias("rank"))
    return draws.join(permutation_rank(pool, seed, label_col, key), [label_col, "rank"]).drop("rank")


def write_batches(batches: DataFrame, path: str) -> None:
    """Parquet files that hold the batches one after another, each in its shuffled order."""
    write_parquet(batches.repartitionByRange("step", "pos").sortWithinPartitions("step", "pos"), path)
