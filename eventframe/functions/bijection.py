"""A keyed bijection of 0..n-1: a permutation that is computed at any position, without ranking."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventframe.functions.scalar import hash_int

#: Steps of the cycle walk. A step leaves 0..n-1 with a chance below 1 / sqrt(n), and at most sqrt(n) do so in a row.
WALK = 32


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def keyed_position(x: Column, n: Column, *key) -> Column:
    """The image of ``x`` (0 <= x < n) under the permutation of 0..n-1 that ``key`` names.

    Four unbalanced Feistel rounds over the grid of ``a = ceil(sqrt(n))`` by ``b = ceil(n / a)`` places, each adding a
    hash (:func:`hash_int`) of one coordinate to the other. The grid has fewer than ``a`` places beyond ``n``; from those the
    permutation is applied again until it is back below ``n``, which keeps it a bijection.
    """
    n = n.cast("long")
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def once(v: Column) -> Column:
        left, right = ((v - v % b) / b).cast("long"), v % b
        add = lambda to, of, i, size: (to + hash_int(*key, F.lit(i), of)) % size
        return _let(add(left, right, 1, a), lambda l1: _let(add(right, l1, 2, b), lambda r1: _let(
            add(l1, r1, 3, a), lambda l2: l2 * b + add(r1, l2, 4, b))))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(x.cast("long")),
                         lambda at, _: F.when(at < n, at).otherwise(once(at)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a cycle walk did not end")))
