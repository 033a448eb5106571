"""Tokenisation: one wide event row -> 7 tokens with features, 4-vector and mask.

The token array is built with column expressions only (no Python per row):
``tokens: array<struct<tok,type,valid,pt,eta,phi,mass,x: array<double>(16)>>``.
``tokens_long`` turns it into one row per token with ``inline`` (map-side, no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventframe.constants import EVENT_COLUMNS, MAX_JETS, TOKEN_TYPES, X_DIM
from eventframe.functions.scalar import is_finite, nan_if_null, nan_to_zero, safe_log

__all__ = ["normalise_events", "ensure_event_columns", "build_tokens", "tokens_long", "TOKEN_FIELDS"]

TOKEN_FIELDS = ["tok", "type", "valid", "pt", "eta", "phi", "mass", "x"]


def normalise_events(df: DataFrame) -> DataFrame:
    """S2 + T11: every event column as double, parquet null -> NaN, absent jet columns -> NaN.

    ``njets_nominal`` must be finite: null/NaN raise a clear error instead of a cast overflow (T10).
    """
    present = set(df.columns)
    cols = []
    for c in EVENT_COLUMNS:
        if c in present:
            cols.append(nan_if_null(c).alias(c))
        elif c.startswith("jet"):
            cols.append(F.lit(float("nan")).alias(c))
        else:
            raise ValueError(f"event column {c!r} is missing")
    others = [F.col(c) for c in df.columns if c not in set(EVENT_COLUMNS)]
    out = df.select(*others, *cols)
    nj = F.col("njets_nominal")
    return out.withColumn(
        "njets_nominal",
        F.when(is_finite(nj), nj).otherwise(F.raise_error(F.lit("njets_nominal is null, NaN or infinite"))),
    )


def ensure_event_columns(df: DataFrame) -> DataFrame:
    """T11 only: add absent jet columns as NaN; present columns are left untouched."""
    present = set(df.columns)
    missing = [c for c in EVENT_COLUMNS if c not in present]
    bad = [c for c in missing if not c.startswith("jet")]
    if bad:
        raise ValueError(f"event columns missing: {bad}")
    return df.select("*", *[F.lit(float("nan")).alias(c) for c in missing]) if missing else df


def _v(name: str) -> Column:
    """S2 applied inline: the column as double with null -> NaN.

    Normalising inside the token expressions (instead of a separate projection that re-aliases 33
    columns) keeps Catalyst's constraint propagation linear; the aliasing form makes optimisation of
    a later filter blow up.
    """
    return nan_if_null(F.col(name))


def _njets() -> Column:
    nj = _v("njets_nominal")
    return F.when(is_finite(nj), nj).otherwise(F.raise_error(F.lit("njets_nominal is null, NaN or infinite")))


def _zero() -> Column:
    return F.lit(0.0)


def _x(slots: dict[int, Column]) -> Column:
    return F.array(*[slots.get(i, _zero()).cast("double") for i in range(X_DIM)])


def _token(tok: int, valid, pt, eta, phi, mass, x: Column) -> Column:
    return F.struct(
        F.lit(tok).alias("tok"),
        F.lit(TOKEN_TYPES[tok]).alias("type"),
        valid.cast("int").alias("valid"),
        pt.cast("double").alias("pt"),
        eta.cast("double").alias("eta"),
        phi.cast("double").alias("phi"),
        mass.cast("double").alias("mass"),
        x.alias("x"),
    )


def _common(pt, eta, phi, mass) -> dict[int, Column]:
    """Slots 0-4 for valid non-CLS tokens."""
    return {0: safe_log(pt), 1: eta, 2: F.sin(phi), 3: F.cos(phi), 4: safe_log(mass)}


_EXPR_CACHE: dict[int, Column] = {}


def build_tokens(df: DataFrame) -> DataFrame:
    """Add ``tokens`` (7 structs) to a wide event frame (raw or normalised columns)."""
    df = ensure_event_columns(df)
    # the unresolved expression is the same for every frame: build it (about a thousand JVM calls)
    # once per SparkContext
    key = id(df.sparkSession.sparkContext)
    if key not in _EXPR_CACHE:
        _EXPR_CACHE.clear()
        _EXPR_CACHE[key] = token_array()
    return df.withColumn("tokens", _EXPR_CACHE[key])


def token_array() -> Column:
    """The ``array<struct>`` expression of the 7 tokens over the wide event columns."""
    c = _v
    cls = _token(
        0, F.lit(1), _zero(), _zero(), _zero(), _zero(),
        _x({
            11: safe_log(c("MET_pt")),
            12: F.sin(c("MET_phi")),
            13: F.cos(c("MET_phi")),
            14: _njets(),
            15: c("dimuon_pt_log"),
        }),
    )
    toks = [cls]
    for m in (1, 2):  # T3 + T7: muons are always valid and never finite-checked
        pt, eta, phi, mass = (c(f"mu{m}_{f}") for f in ("pt", "eta", "phi", "mass"))
        slots = _common(pt, eta, phi, mass)
        slots[5] = safe_log(mass)
        toks.append(_token(m, F.lit(1), pt, eta, phi, mass, _x(slots)))
    nj = _njets().cast("int")  # T10: truncation, raw value stays in slot 14
    for j in range(1, MAX_JETS + 1):  # T4 + T5
        pt, eta, phi, mass, qgl = (c(f"jet{j}_{f}_nominal") for f in ("pt", "eta", "phi", "mass", "qgl"))
        ok = (nj >= j) & is_finite(pt, eta, phi, mass)
        slots = _common(pt, eta, phi, mass)
        slots[8] = nan_to_zero(qgl)
        valid_tok = _token(2 + j, F.lit(1), pt, eta, phi, mass, _x(slots))
        pad_tok = _token(2 + j, F.lit(0), _zero(), _zero(), _zero(), _zero(), _x({}))
        toks.append(F.when(ok, valid_tok).otherwise(pad_tok))
    return F.array(*toks)


def token_kinematics() -> list[dict[str, Column]]:
    """``type, valid, pt, eta, phi, mass`` of the 7 tokens over the wide columns, without the features:
    one condition per field, so that a consumer of some fields carries no others along."""
    zero = {f: _zero() for f in ("pt", "eta", "phi", "mass")}
    out = [{"type": F.lit(TOKEN_TYPES[0]), "valid": F.lit(1), **zero}]
    for m in (1, 2):
        own = {f: _v(f"mu{m}_{f}").cast("double") for f in zero}
        out.append({"type": F.lit(TOKEN_TYPES[m]), "valid": F.lit(1), **own})
    nj = _njets().cast("int")
    for j in range(1, MAX_JETS + 1):
        own = {f: _v(f"jet{j}_{f}_nominal").cast("double") for f in zero}
        ok = (nj >= j) & is_finite(*own.values())
        out.append({"type": F.lit(TOKEN_TYPES[2 + j]), "valid": F.when(ok, F.lit(1)).otherwise(F.lit(0)),
                    **{f: F.when(ok, c).otherwise(_zero()) for f, c in own.items()}})
    return out


def tokens_long(df: DataFrame, keep=("event_id",)) -> DataFrame:
    """T1 long form: one row per (event, token) carrying ``keep`` columns."""
    return df.select(*keep, F.inline("tokens"))
