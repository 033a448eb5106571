"""Preparation plan: scan -> window -> per-class index -> folds -> splits -> tokens.

Two inputs share the same downstream plan:
- event files listed per class (``from_files``): order key = file ordinal * 2^36 + row index;
- the fixture view over the driver tables (``from_tables``): order key = event id.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventframe.operators.filters import window_closed_f32
from eventframe.operators.splits import assign_folds, assign_splits, file_order_key, file_row_index, row_index
from eventframe.operators.tokens import build_tokens, tokens_long
from eventframe.sources.event_view import event_view
from eventframe.sources.parquet import read_labelled_sources

__all__ = ["events_from_tables", "events_from_files", "split_events", "split_tokens"]


def events_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide events from the driver tables with ``_ord = event_id`` (S2 happens inside the tokens)."""
    return event_view(spark, sf_dir).withColumn("_ord", F.col("event_id"))


def events_from_files(spark: SparkSession, files_by_class: Mapping[str, Sequence[str]]) -> DataFrame:
    """Wide events from labelled parquet files with ``_ord`` in list order and an ``event_id`` that
    is unique across files."""
    raw = read_labelled_sources(spark, files_by_class)
    key = file_order_key()
    return raw.withColumn("_ord", key).withColumn(
        "event_id", F.col("y").cast("long") * F.lit(1 << 60) + key
    )


def split_events(events: DataFrame, window_filter=window_closed_f32) -> DataFrame:
    """P3 + R1 + R2 + R3: filtered events with ``idx``, ``fold`` and ``split``.

    Events straight from files (``file_block`` present) are indexed split-wise without a shuffle;
    other frames use the two-level prefix sum over ``_ord``.
    """
    w = window_filter(events)
    if "file_block" in w.columns:
        idx = file_row_index(w, ("y",))
    else:
        idx = row_index(w, "_ord", ("y",))
    return assign_splits(assign_folds(idx))


def split_tokens(split_df: DataFrame, keep=("event_id", "y", "idx", "fold", "split", "dimuon_mass")) -> DataFrame:
    """T1-T11 in long form for already split events."""
    return tokens_long(build_tokens(split_df), keep=keep)
