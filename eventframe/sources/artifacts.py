"""Artefact sinks and sources.

Artefacts are small parameter tables (16 scaler rows, K+1 edges, one metrics row) or append-only
history records. They are written with Spark's writers to a shared path (never a machine-local
folder) and read back with a declared schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
)

__all__ = [
    "write_parquet",
    "write_scaler",
    "read_scaler",
    "write_bins",
    "read_bins",
    "write_metrics",
    "read_metrics",
    "write_history",
    "read_history",
    "read_history_documents",
    "commit_history",
    "read_committed_history",
    "HISTORY_DOC_SCHEMA",
]

SCALER_SCHEMA = StructType([StructField("mean", ArrayType(DoubleType())), StructField("std", ArrayType(DoubleType()))])
BINS_SCHEMA = StructType([StructField("edges", ArrayType(DoubleType())), StructField("K", IntegerType())])
METRICS_SCHEMA = ("test_accuracy double, test_auc_ovr map<string,double>, vbf_purity_top10pct double, "
                  "dy_mass_sculpting_pearson_r double, n_test long")
HISTORY_SCHEMA = StructType([
    StructField("run_id", StringType()), StructField("part", StringType()), StructField("epoch", LongType()),
    StructField("loss", DoubleType()), StructField("loss_cls", DoubleType()), StructField("loss_adv", DoubleType()),
    StructField("lambda_grl", DoubleType()), StructField("steps", LongType()), StructField("accuracy", DoubleType()),
    StructField("auc_ovr", MapType(StringType(), DoubleType())),
])
_TRAIN_ENTRY = StructType([
    StructField("epoch", LongType()), StructField("loss", DoubleType()), StructField("loss_cls", DoubleType()),
    StructField("loss_adv", DoubleType()), StructField("lambda_grl", DoubleType()), StructField("steps", LongType()),
])
_VAL_ENTRY = StructType([
    StructField("epoch", LongType()), StructField("loss", DoubleType()), StructField("accuracy", DoubleType()),
    StructField("auc_ovr", MapType(StringType(), DoubleType())),
])
HISTORY_DOC_SCHEMA = StructType([
    StructField("train", ArrayType(_TRAIN_ENTRY)), StructField("val", ArrayType(_VAL_ENTRY)),
])


def write_parquet(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite") -> None:
    """Parquet sink; an empty result still leaves a readable dataset with its schema."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_scaler(scaler: DataFrame, path: str) -> None:
    """S7 sink: the 16-row ``feature, mean, std`` table as one JSON object ``{mean: [16], std: [16]}``."""
    doc = scaler.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("feature", "mean"))), lambda s: s["mean"]).alias("mean"),
        F.transform(F.array_sort(F.collect_list(F.struct("feature", "std"))), lambda s: s["std"]).alias("std"),
    )
    doc.coalesce(1).write.mode("overwrite").json(path)


def read_scaler(spark: SparkSession, path: str) -> DataFrame:
    """S7 source: back to ``feature, mean, std`` rows."""
    d = spark.read.schema(SCALER_SCHEMA).json(path)
    return d.select(F.posexplode(F.arrays_zip("mean", "std")).alias("feature", "ms")).select(
        F.col("feature").cast("int").alias("feature"), F.col("ms.mean").alias("mean"), F.col("ms.std").alias("std"))


def write_bins(k: int, edges: list[float], spark: SparkSession, path: str) -> None:
    """S8 sink: ``{edges: [K+1], K}``."""
    spark.createDataFrame([(list(map(float, edges)), int(k))], BINS_SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """S8 source: ``K, b, edge`` rows (evaluation needs only K)."""
    d = spark.read.schema(BINS_SCHEMA).json(path)
    return d.select("K", F.posexplode("edges").alias("b", "edge"))


def write_metrics(report: DataFrame, path: str) -> None:
    """The one-row evaluation report as JSON; its columns ``auc_<class>`` become the map ``test_auc_ovr``."""
    by_class = [c for c in report.columns if c.startswith("auc_")]
    aucs = F.create_map(*[x for c in by_class for x in (F.lit(c.removeprefix("auc_")), F.col(c))])
    report.select(*[c for c in report.columns if c not in by_class], aucs.alias("test_auc_ovr")).coalesce(1).write.mode(
        "overwrite").option("ignoreNullFields", "false").json(path)


def read_metrics(spark: SparkSession, path: str, classes=(0, 1, 2)) -> DataFrame:
    """S9 source: the report with a column ``auc_<class>`` for each class of the map."""
    doc = spark.read.schema(METRICS_SCHEMA).json(path)
    return doc.select("*", *[F.col("test_auc_ovr")[str(c)].alias(f"auc_{c}") for c in classes]).drop("test_auc_ovr")


def write_history(records: DataFrame, path: str, mode: str = "append") -> None:
    """S10 sink: one JSON line per (run, part, epoch) record. Appending per epoch replaces rewriting
    a whole document; nothing is gathered per run. Columns not in the history schema are dropped (W5)."""
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in records.columns
            else F.lit(None).cast(f.dataType).alias(f.name) for f in HISTORY_SCHEMA.fields]
    records.select(*cols).write.mode(mode).json(path)


def commit_history(records: DataFrame, path: str) -> None:
    """S10 sink for a stream of history records: every micro-batch is one folder ``commit=<batch>``, so a batch that is run
    again after a failure replaces itself, and a record that comes again in a later batch replaces the earlier one for
    its (run, part, epoch) when read. Runs over all records that are there; the stream's checkpoint lies in ``path``."""

    def commit(batch: DataFrame, number: int) -> None:
        write_history(batch, f"{path}/commit={number}", mode="overwrite")

    records.writeStream.foreachBatch(commit).option("checkpointLocation", f"{path}/_checkpoint").trigger(
        availableNow=True).start().awaitTermination()


def read_committed_history(spark: SparkSession, path: str) -> DataFrame:
    """S10 source for :func:`commit_history`: the record of the last commit for every (run, part, epoch); of several in one
    commit the greatest."""
    every = spark.read.schema(StructType([*HISTORY_SCHEMA.fields, StructField("commit", LongType())])).json(path)
    keys = ["run_id", "part", "epoch"]
    rest = [c for c in HISTORY_SCHEMA.names if c not in keys]
    # a map can't be compared, so it comes along as its sorted entries
    plain = F.struct("commit", *[F.array_sort(F.map_entries(c)).alias(c) if c == "auc_ovr" else F.col(c) for c in rest])
    last = every.groupBy(*keys).agg(F.max(plain).alias("r"))
    return last.select(*keys, *[F.map_from_entries(f"r.{c}").alias(c) if c == "auc_ovr" else F.col(f"r.{c}") for c in rest])


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """S10 source for :func:`write_history` output."""
    return spark.read.schema(HISTORY_SCHEMA).json(path)


def read_history_documents(spark: SparkSession, paths) -> DataFrame:
    """S10 source for per-run documents ``{train: [...], val: [...]}`` (one multi-line JSON file per
    run directory): flattened to the history record table, ``run_id`` = parent directory name."""
    d = spark.read.schema(HISTORY_DOC_SCHEMA).option("multiLine", True).json(paths)
    d = d.withColumn("run_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    tr = d.select("run_id", F.inline("train")).withColumn("part", F.lit("train"))
    va = d.select("run_id", F.inline("val")).withColumn("part", F.lit("val"))
    return tr.unionByName(va, allowMissingColumns=True).select(*[f.name for f in HISTORY_SCHEMA.fields])
