"""Parquet event sources (S1-S4, S6 input side).

``read_event_files`` reads a list of files as one dataset *in list order*: the file ordinal comes from
the caller's list (not from path sorting) and the row position from ``_metadata.row_index``, so the
per-class row index (R1) reproduces the original concatenation order without any single-task step.
Column pruning and filter pushdown are left to Catalyst (the projection is explicit, filters are
plain predicates on scan columns).
"""

from __future__ import annotations

from typing import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventframe.constants import EVENT_COLUMNS, LABELS

#: Files up to which their ordinals are broadcast (16 bytes each).
MAX_BROADCAST_FILES = 2_000_000

__all__ = [
    "missing_paths",
    "check_files_exist",
    "expand_files",
    "read_event_files",
    "label_and_union",
    "read_labelled_sources",
]


def _fs_path(spark: SparkSession, p: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(p)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, path


def missing_paths(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """All paths that do not exist (Hadoop FS API, so object stores work too). Paths that share a folder
    are looked up in one listing of it."""
    paths = list(paths)
    by_folder: dict[str, list[str]] = {}
    for p in paths:
        by_folder.setdefault(p.rstrip("/").rpartition("/")[0], []).append(p)
    gone: set[str] = set()
    for folder, own in by_folder.items():
        if len(own) == 1 or not folder:
            gone.update(p for p in own for fs, path in [_fs_path(spark, p)] if not fs.exists(path))
            continue
        fs, path = _fs_path(spark, folder)
        names = {st.getPath().getName() for st in fs.listStatus(path)} if fs.exists(path) else set()
        gone.update(p for p in own if p.rstrip("/").rpartition("/")[2] not in names)
    return [p for p in paths if p in gone]


def check_files_exist(spark: SparkSession, paths: Iterable[str]) -> None:
    """S3: one error naming *every* missing input (Spark's own error names only the first)."""
    miss = missing_paths(spark, paths)
    if miss:
        raise FileNotFoundError("missing input files:\n" + "\n".join(f"  - {m}" for m in miss))


def expand_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Qualified file list in the given order; a directory expands to its parquet parts sorted by name."""
    out: list[str] = []
    for p in paths:
        fs, path = _fs_path(spark, p)
        q = fs.makeQualified(path)
        if fs.getFileStatus(q).isDirectory():
            parts = sorted(
                str(s.getPath().toString())
                for s in fs.listStatus(q)
                if s.isFile() and s.getPath().getName().endswith(".parquet")
            )
            out.extend(parts)
        else:
            out.append(str(q.toString()))
    return out


def read_event_files(
    spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = EVENT_COLUMNS, check: bool = True
) -> DataFrame:
    """Multi-file parquet scan with projection, plus ``file_ord``, ``file_block`` and
    ``row_index``. ``columns=None`` keeps every column of the files.

    ``file_ord`` is the position of the file in ``paths`` (after directory expansion); ``file_block``
    is the start offset of the file split a row was read from (identifies the scan segment). A file
    listed more than once is read once per listing. Files need not have the same columns: the schemas of all
    footers are merged, and a column is null in the rows of files without it; a column whose types
    can't be merged is an error.
    """
    if check:
        check_files_exist(spark, paths)
    scans: list[dict[str, int]] = []  # one scan per repetition of a file
    times: dict[str, int] = {}
    for i, f in enumerate(expand_files(spark, paths)):
        k = times[f] = times.get(f, -1) + 1
        if k == len(scans):
            scans.append({})
        scans[k][f] = i
    parts = [_scan(spark, ords, columns) for ords in scans]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _scan(spark: SparkSession, ords: dict[str, int], columns: Sequence[str] | None) -> DataFrame:
    """One scan of distinct files. Ordinals come from a small table keyed by a hash of the path (16
    bytes a file), broadcast up to ``MAX_BROADCAST_FILES``; the hashes are checked for clashes."""
    df = spark.read.option("mergeSchema", "true").parquet(*ords)
    keep = df.columns if columns is None else [c for c in columns if c in set(df.columns)]
    clash = {"file_ord", "file_block", "row_index", "_path"} & set(keep)
    if clash:
        raise ValueError(f"input columns clash with helper columns: {sorted(clash)}")
    rows = df.select(*keep, F.xxhash64("_metadata.file_path").alias("_path"),
                     F.col("_metadata.file_block_start").alias("file_block"), F.col("_metadata.row_index").alias("row_index"))
    table = spark.createDataFrame(list(ords.items()), "path string, file_ord int").select(
        F.xxhash64("path").alias("_path"), "file_ord")
    if table.select("_path").distinct().count() < len(ords):
        raise ValueError("two file paths have the same hash; read them in separate calls")
    if len(ords) <= MAX_BROADCAST_FILES:
        table = F.broadcast(table)
    return rows.join(table, "_path").select(*keep, "file_ord", "file_block", "row_index")


def read_labelled_sources(
    spark: SparkSession, files_by_class: Mapping[str, Sequence[str]], columns: Sequence[str] | None = EVENT_COLUMNS
) -> DataFrame:
    """S4 + O4: one scan per class group tagged with its class id, concatenated in class order
    (ggH, VBF, DY). All missing files across all classes are reported together (S3)."""
    check_files_exist(spark, [p for ps in files_by_class.values() for p in ps])
    frames = {name: read_event_files(spark, ps, columns, check=False) for name, ps in files_by_class.items()}
    return label_and_union(frames)


def label_and_union(frames: Mapping[str, DataFrame]) -> DataFrame:
    """S4 + O4: tag each class group with its class id and source name, concatenate in class order."""
    parts = []
    for name in sorted(frames, key=lambda k: LABELS[k]):
        d = frames[name]
        parts.append(d.withColumn("y", F.lit(LABELS[name])).withColumn("source", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
