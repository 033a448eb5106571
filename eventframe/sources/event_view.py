"""Event table built from the driver's TPC-H style tables (the fixture in FIXTURES.md F4).

The driver data has no event parquet, so an event is an order: its line items ranked by price give
two muons (ranks 1-2) and up to four jets (ranks 3-6); ``njets_nominal`` = lines - 2 and may exceed
4; the class comes from ``o_orderstatus``. The same relation is written once with the DataFrame API
(:func:`event_view`) and once as SQL text (:data:`EVENT_VIEW_SQL`) for the DuckDB oracle.

Plan shape: one hash exchange of ``lineitem`` on ``l_orderkey`` feeds the per-order window, the
per-order aggregate and the join with ``orders`` (all keyed on the order key), so no further shuffle of
the large side is needed; ``orders`` is shuffled (or broadcast by AQE when small) on the same key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventframe.constants import MAX_JETS

# Fixed fixture values (stated plainly, together):
# muon mass 0.10566; phi missing above tax 0.075; qgl missing for return flag 'A';
# eta = (discount - 0.05) * 50; phi = (tax - 0.04) * 78; mass = price / 10000; qgl = discount * 10;
# dimuon_mass = 105 + totalprice / 12500; MET_pt = totalprice / 2000;
# MET_phi = (custkey % 628) / 100 - 3.14; dimuon_pt_log = ln(1 + totalprice / 5000);
# class: status 'F' -> 0, 'P' -> 1, otherwise 2.
MUON_MASS = 0.10566

_TIE_BREAK = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus", "l_shipdate"]


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as candidate objects, ranked by price inside their order."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_orderkey", "event_id")
    # partition on the renamed key so the later per-event aggregate reuses this exchange
    w = Window.partitionBy("event_id").orderBy(F.col("l_extendedprice").desc(), *_TIE_BREAK)
    return li.select(
        "event_id",
        F.row_number().over(w).alias("rk"),
        F.col("l_quantity").alias("pt"),
        ((F.col("l_discount") - F.lit(0.05)) * 50).alias("eta"),
        F.when(F.col("l_tax") > F.lit(0.075), F.lit(None).cast("double"))
        .otherwise((F.col("l_tax") - F.lit(0.04)) * 78)
        .alias("phi"),
        (F.col("l_extendedprice") / 10000).alias("mass"),
        F.when(F.col("l_returnflag") == "A", F.lit(None).cast("double"))
        .otherwise(F.col("l_discount") * 10)
        .alias("qgl"),
    )


def _at(rank: int, field: str):
    return F.max(F.when(F.col("rk") == rank, F.col(field)))


def event_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide event rows: ``event_id, y`` plus the 33 event columns (see FIXTURES.md F1)."""
    lines = event_lines(spark, sf_dir)
    aggs = [(F.count(F.lit(1)) - 2).alias("njets_nominal")]
    for m in (1, 2):
        aggs += [
            _at(m, "pt").alias(f"mu{m}_pt"),
            _at(m, "eta").alias(f"mu{m}_eta"),
            F.coalesce(_at(m, "phi"), F.lit(0.0)).alias(f"mu{m}_phi"),
            F.lit(MUON_MASS).alias(f"mu{m}_mass"),
        ]
    for j in range(1, MAX_JETS + 1):
        rk = j + 2
        aggs += [_at(rk, f).alias(f"jet{j}_{f}_nominal") for f in ("pt", "eta", "phi", "mass", "qgl")]
    wide = lines.groupBy("event_id").agg(*aggs, F.count(F.lit(1)).alias("_n")).where("_n >= 2").drop("_n")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"
    )
    ev = wide.join(orders, wide.event_id == orders.o_orderkey)
    return ev.select(
        *[F.col(c) for c in wide.columns],
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2).alias("y"),
        (F.lit(105) + F.col("o_totalprice") / 12500).alias("dimuon_mass"),
        (F.col("o_totalprice") / 2000).alias("MET_pt"),
        ((F.col("o_custkey") % 628).cast("double") / 100 - F.lit(3.14)).alias("MET_phi"),
        F.ln(F.lit(1) + F.col("o_totalprice") / 5000).alias("dimuon_pt_log"),
    )


def _jet_sql(j: int) -> str:
    rk = j + 2
    return ", ".join(
        f"max(CASE WHEN rk={rk} THEN {f} END) AS jet{j}_{f}_nominal" for f in ("pt", "eta", "phi", "mass", "qgl")
    )


EVENT_VIEW_SQL = f"""
v_line AS (
  SELECT l_orderkey AS event_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey,
             l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rk,
         l_quantity AS pt,
         (l_discount - CAST(0.05 AS DOUBLE)) * 50 AS eta,
         CASE WHEN l_tax > CAST(0.075 AS DOUBLE) THEN NULL ELSE (l_tax - CAST(0.04 AS DOUBLE)) * 78 END AS phi,
         l_extendedprice / 10000 AS mass,
         CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_discount * 10 END AS qgl
  FROM lineitem),
v_wide AS (
  SELECT event_id, count(*) - 2 AS njets_nominal,
    max(CASE WHEN rk=1 THEN pt END) AS mu1_pt, max(CASE WHEN rk=1 THEN eta END) AS mu1_eta,
    coalesce(max(CASE WHEN rk=1 THEN phi END), CAST(0 AS DOUBLE)) AS mu1_phi, CAST(0.10566 AS DOUBLE) AS mu1_mass,
    max(CASE WHEN rk=2 THEN pt END) AS mu2_pt, max(CASE WHEN rk=2 THEN eta END) AS mu2_eta,
    coalesce(max(CASE WHEN rk=2 THEN phi END), CAST(0 AS DOUBLE)) AS mu2_phi, CAST(0.10566 AS DOUBLE) AS mu2_mass,
    {_jet_sql(1)},
    {_jet_sql(2)},
    {_jet_sql(3)},
    {_jet_sql(4)}
  FROM v_line GROUP BY event_id HAVING count(*) >= 2),
v_event AS (
  SELECT w.*, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS y,
         105 + o_totalprice / 12500 AS dimuon_mass, o_totalprice / 2000 AS MET_pt,
         CAST(o_custkey % 628 AS DOUBLE) / 100 - CAST(3.14 AS DOUBLE) AS MET_phi,
         ln(1 + o_totalprice / 5000) AS dimuon_pt_log
  FROM v_wide w JOIN orders o ON w.event_id = o.o_orderkey)"""
