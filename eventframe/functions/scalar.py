"""Column-expression helpers (O5, O6, O8, T8, P7, J3, M2, M3 and hashing).

All helpers return ``pyspark.sql.Column`` built from JVM functions, so they stay inside
whole-stage code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventframe.constants import EPS

__all__ = [
    "col_",
    "safe_log",
    "is_finite",
    "nan_to_zero",
    "wrap_dphi",
    "softmax",
    "argmax",
    "hash_key",
    "hash_int",
    "nan_if_null",
    "rnd",
]


def col_(c) -> Column:
    """Column name -> column; numbers -> literal; columns pass through."""
    if isinstance(c, str):
        return F.col(c)
    if isinstance(c, (bool, int, float)):
        return F.lit(c)
    return c


def nan_if_null(c) -> Column:
    """S2 for one column: parquet null becomes NaN (what a numpy conversion does)."""
    return F.coalesce(col_(c).cast("double"), F.lit(float("nan")))


def safe_log(c, eps: float = EPS) -> Column:
    """``log(max(x, eps))``; NaN stays NaN (``greatest`` keeps NaN, ``ln`` keeps NaN)."""
    return F.ln(F.greatest(col_(c), F.lit(eps)))


def is_finite(*cols) -> Column:
    """True iff every column is finite (false for null, NaN and +/-inf)."""
    out = None
    for c in cols:
        term = F.coalesce(F.abs(col_(c)) < F.lit(float("inf")), F.lit(False))
        out = term if out is None else (out & term)
    return out


def nan_to_zero(c) -> Column:
    """T5: value if finite, else 0."""
    return F.when(is_finite(c), col_(c)).otherwise(F.lit(0.0))


def wrap_dphi(d) -> Column:
    """Floor-modulo wrap ``(d + pi) mod 2pi - pi`` into [-pi, pi)."""
    return F.pmod(col_(d) + F.lit(math.pi), F.lit(2.0 * math.pi)) - F.lit(math.pi)


def softmax(z, n: int | None = None) -> Column:
    """M2: numerically stable softmax over an array column; with a known length ``n`` it is unrolled
    into plain expressions (no lambda)."""
    z = col_(z)
    if n is not None:
        mx = F.greatest(*[z[i] for i in range(n)]) if n > 1 else z[0]
        ex = [F.exp(z[i] - mx) for i in range(n)]
        tot = ex[0]
        for e in ex[1:]:
            tot = tot + e
        return F.array(*[e / tot for e in ex])
    mx = F.array_max(z)
    ex = F.transform(z, lambda v: F.exp(v - mx))
    tot = F.aggregate(ex, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(ex, lambda v: v / tot)


def argmax(p) -> Column:
    """M3: 0-based index of the maximum; the first index wins on ties."""
    p = col_(p)
    return (F.array_position(p, F.array_max(p)) - F.lit(1)).cast("int")


def hash_key(*parts) -> Column:
    """Deterministic 32-hex-digit key ``md5(p1:p2:...)``; identical in any engine with md5."""
    return F.md5(F.concat_ws(":", *[col_(p).cast("string") for p in parts]))


def hash_int(*parts) -> Column:
    """48-bit non-negative integer from the first 12 hex digits of :func:`hash_key`."""
    return F.conv(F.substring(hash_key(*parts), 1, 12), 16, 10).cast("bigint")


def rnd(c, digits: int = 6) -> Column:
    """Round for cross-engine comparison (past the data's own digits)."""
    return F.round(col_(c), digits)
