"""Pair features inside one event.

All N x N ordered pairs of an event's tokens (i = j, padding and CLS included) come from two
``posexplode`` generators over the event's own token array: 7 rows per event, then 7 x 7. The work
stays within each event's row, so there is no shuffle and no join, and every feature is a plain
column expression (no lambda functions), so the stage stays in whole-stage code generation.
Cartesian components (E, px, py, pz) are computed once per token (J7), not once per pair.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventframe.constants import EPS, N_TOKENS, TYPE_JET
from eventframe.operators.tokens import token_kinematics

__all__ = ["with_cartesian", "with_event_cartesian", "pairs_long", "PAIR_FEATURES"]

PAIR_FEATURES = ["deta", "sin_dphi", "cos_dphi", "log_dr", "log_pt_ratio", "log_mjj"]  # J10 order


def _cart(t: Column) -> Column:
    """(pt, eta, phi, m) -> (E, px, py, pz) with ``E = sqrt(max(m^2 + p^2, 0))``."""
    px = t["pt"] * F.cos(t["phi"])
    py = t["pt"] * F.sin(t["phi"])
    pz = t["pt"] * F.sinh(t["eta"])
    p2 = px * px + py * py + pz * pz
    e = F.sqrt(F.greatest(t["mass"] * t["mass"] + p2, F.lit(0.0)))
    return F.struct(
        t["type"].alias("type"), t["valid"].alias("valid"), t["pt"].alias("pt"), t["eta"].alias("eta"),
        t["phi"].alias("phi"), e.alias("E"), px.alias("px"), py.alias("py"), pz.alias("pz"),
    )


def with_cartesian(df: DataFrame, tokens_col: str = "tokens", out: str = "p4", n_tokens: int = N_TOKENS) -> DataFrame:
    """Per-token kinematics, unrolled over the fixed token count."""
    t = F.col(tokens_col)
    return df.withColumn(out, F.array(*[_cart(t[k]) for k in range(n_tokens)]))


def with_event_cartesian(df: DataFrame, out: str = "p4") -> DataFrame:
    """Per-token kinematics straight from the wide event columns: pairs need none of the 16 features, and
    without them the generated code of the stage stays small. The components of a token are one lambda over
    the 7 tokens: unrolled, they outgrow the largest method that Java compiles."""
    tokens = F.array(*[F.struct(*[c.alias(n) for n, c in t.items()]) for t in token_kinematics()])
    return df.withColumn(out, F.transform(tokens, _cart))


def _features(a: Column, b: Column) -> list[Column]:
    deta = a["eta"] - b["eta"]  # J2
    dphi = F.pmod(a["phi"] - b["phi"] + F.lit(math.pi), F.lit(2.0 * math.pi)) - F.lit(math.pi)  # J3
    dr = F.sqrt(F.greatest(deta * deta + dphi * dphi, F.lit(0.0)))
    lpr = F.ln(F.greatest(a["pt"] + F.lit(EPS), F.lit(EPS))) - F.ln(F.greatest(b["pt"] + F.lit(EPS), F.lit(EPS)))
    et, xt, yt, zt = a["E"] + b["E"], a["px"] + b["px"], a["py"] + b["py"], a["pz"] + b["pz"]
    mij = F.sqrt(F.greatest(et * et - (xt * xt + yt * yt + zt * zt), F.lit(0.0)))  # J8
    jj = (a["type"] == TYPE_JET) & (b["type"] == TYPE_JET)
    return [
        a["valid"].alias("valid_i"), b["valid"].alias("valid_j"),
        deta.alias("deta"), F.sin(dphi).alias("sin_dphi"), F.cos(dphi).alias("cos_dphi"),  # J4
        F.ln(F.greatest(dr, F.lit(EPS))).alias("log_dr"),  # J5
        lpr.alias("log_pt_ratio"),  # J6
        F.when(jj, F.ln(F.greatest(mij, F.lit(EPS)))).otherwise(F.lit(0.0)).alias("log_mjj"),  # J9
        mij.alias("mij"),
    ]


def pairs_long(df: DataFrame, keep=("event_id",), tokens_col: str = "tokens", valid_keys_only: bool = False) -> DataFrame:
    """J1-J10 in long form ``keep..., i, j, valid_i, valid_j, <6 features>, mij`` (i major, j minor);
    J11 with ``valid_keys_only`` keeps only pairs whose key token is valid. A frame that has ``p4`` (see
    :func:`with_event_cartesian`) needs no tokens."""
    keep = list(keep)
    t = (df if "p4" in df.columns else with_cartesian(df, tokens_col)).select(*keep, "p4")
    q = t.select(*keep, "p4", F.posexplode("p4").alias("i", "a"))
    p = q.select(*keep, "i", "a", F.posexplode("p4").alias("j", "b"))
    if valid_keys_only:
        p = p.where(F.col("b")["valid"] == 1)
    return p.select(*keep, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"),
                    *_features(F.col("a"), F.col("b")))
