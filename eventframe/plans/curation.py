"""Curation job (S6): per source, keep events in the half-open mass window and exactly N of them
(all when short), chosen by a seeded hash, in their original order; one output per source.

One lazy plan covers all sources of the same columns: a scan with a ``source`` column, the pushed-down
window, the exact-N selection (:func:`sampling.sample_exact_n`) and a ``partitionBy('source')`` write. Sources
with other columns are another plan, so that each output has its own source's columns and no others. The
output is sorted by (source, original position) so each source's files keep the input order (O2).
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventframe.constants import SELECT_N_KEEP, SELECT_SEED, SELECT_WINDOW
from eventframe.operators.filters import window_half_open
from eventframe.operators.sampling import sample_exact_n
from eventframe.operators.splits import file_order_key
from eventframe.sources.artifacts import write_parquet
from eventframe.sources.parquet import check_files_exist, read_event_files

__all__ = ["curate", "curated_sources", "run_curation", "write_curated", "output_name"]


def output_name(path: str, suffix: str = "_hpeak_10k") -> str:
    """Output stem: input file stem + suffix (the original's naming)."""
    stem = path.rstrip("/").split("/")[-1]
    return (stem[: -len(".parquet")] if stem.endswith(".parquet") else stem) + suffix


def curate(df: DataFrame, n_keep: int = SELECT_N_KEEP, seed: int = SELECT_SEED, window=SELECT_WINDOW,
           source_col: str = "source", key: str = "_ord") -> DataFrame:
    """P2 + R4 + R5 for any frame with a source column and a unique order key."""
    return sample_exact_n(window_half_open(df, window=window), n_keep, seed, (source_col,), key=key)


def curated_sources(spark: SparkSession, sources: Mapping[str, Sequence[str]], n_keep: int = SELECT_N_KEEP,
                    seed: int = SELECT_SEED, window=SELECT_WINDOW, columns=None) -> DataFrame:
    """The curated rows of every source with ``source`` and ``_ord`` (file ordinal, row index);
    ``columns=None`` keeps every input column."""
    check_files_exist(spark, [p for ps in sources.values() for p in ps])
    parts = []
    for name, paths in sources.items():
        d = read_event_files(spark, paths, columns, check=False)
        if clash := {"source", "_ord"} & set(d.columns):
            raise ValueError(f"input columns clash with helper columns: {sorted(clash)}")
        parts.append(d.withColumn("source", F.lit(name)).withColumn("_ord", file_order_key()))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p, allowMissingColumns=True)
    return curate(df, n_keep, seed, window)


def run_curation(spark: SparkSession, sources: Mapping[str, Sequence[str]] | Sequence[str], out_dir: str,
                 n_keep: int = SELECT_N_KEEP, seed: int = SELECT_SEED, window=SELECT_WINDOW, columns=None) -> DataFrame:
    """Write ``out_dir/source=<name>/`` parquet per source; returns ``source, n`` for every source.

    ``sources`` maps names to file lists; a plain list of files makes each file a source named by
    :func:`output_name`.
    """
    if not isinstance(sources, Mapping):
        named: dict[str, list[str]] = {}
        for p in sources:
            named.setdefault(output_name(p), []).append(p)
        if same := {n: ps for n, ps in named.items() if len(ps) > 1}:
            raise ValueError(f"several files would be written under one name, give a mapping of names instead: {same}")
        sources = named
    check_files_exist(spark, [p for ps in sources.values() for p in ps])
    groups: dict[tuple, dict[str, Sequence[str]]] = {}
    for name, paths in sources.items():  # the footers only
        schema = read_event_files(spark, paths, columns, check=False).schema
        groups.setdefault(tuple((f.name, f.dataType.simpleString()) for f in schema), {})[name] = paths
    counts = None
    for own in groups.values():
        cur = curated_sources(spark, own, n_keep, seed, window, columns).drop("file_ord", "file_block", "row_index")
        n = write_curated(spark, cur, list(own), out_dir, mode="append" if counts is not None else "overwrite")
        counts = n if counts is None else counts.unionByName(n)
    return counts


#: Characters that Spark escapes in the folder name of a partition value.
_ESCAPED = set('"#%\'*/:=?\\{[]^') | {chr(i) for i in range(32)} | {chr(127)}


def _folder(name: str) -> str:
    return "source=" + "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in name)


def write_curated(spark: SparkSession, cur: DataFrame, sources: Sequence[str], out_dir: str, mode: str = "overwrite") -> DataFrame:
    """S5 + S6 + O2: one output per source in original order; an empty source gets a schema-only file. ``mode`` is for
    the whole folder: sources of several schemas are appended one schema after another.

    Counts come from the written rows read back with the known schema (``source`` stays a string
    whatever it looks like), and a source's folder is only added to if it has no rows.
    """
    out = cur.repartitionByRange("source", "_ord").sortWithinPartitions("source", "_ord")
    data = out.drop("_ord")
    write_parquet(data, out_dir, partition_by=["source"], mode=mode)
    back = spark.read.schema(data.schema).parquet(out_dir).where(F.col("source").isin(list(sources)))
    counts = {r["source"]: r["n"] for r in back.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    for name in sources:  # one row per source
        if not counts.get(name):
            empty = spark.createDataFrame([], data.drop("source").schema)
            write_parquet(empty, f"{out_dir.rstrip('/')}/{_folder(name)}", mode="append")
    return spark.createDataFrame([(n, counts.get(n, 0)) for n in sources], "source string, n long")
