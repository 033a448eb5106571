"""Suffix-array deduplication: bytes covered by a 200-byte string that also starts elsewhere are removed.

Texts are cut into pieces that bring equal 200-byte strings together (see ``repeats``), and each task sorts
the suffixes of a memory-sized group of pieces in two stages. Suffixes smaller than their successor are
sorted directly. All others follow from them: a scan over the buckets of first bytes, smallest first, puts
the suffix before each one scanned to the end of its bucket's first part. The common prefixes of neighbours
in the array, counted up to the length asked for, tell which strings occur more than once.

Matches lie within one document's bytes; overlapping ones count, within one document too, and all are judged
on the input.

Defined cases: null texts are empty; texts shorter than the length keep all bytes; rows with equal text,
whatever their identifier (null as well), repeat each other; an empty table gives no rows; extra columns
don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventframe.llm.common import by_batches, cut, mix64, table
from eventframe.llm.repeats import LARGE, TARGET, Shape, covered, find, with_spans

LENGTH = 200
_CODES = mix64(np.arange(256, dtype=np.uint64))
_SHIFT = bytes((i + 1) % 256 for i in range(256))  # UTF-8 has no byte 255; 0 is then free to end a piece


def coder(text: str):
    raw = text.encode("utf-8", "surrogatepass")
    return _CODES[np.frombuffer(raw, np.uint8)], lambda a, b: raw[a:b]


def _cuts(content: bytes):
    n = np.arange(len(content))
    return n, n + 1


def two_stage(text: bytes, ends: np.ndarray) -> np.ndarray:
    """The suffix array of pieces laid end to end, each closed by a byte 0 at ``ends``; a suffix ends with its
    piece, and equal ones are in order of place."""
    s = np.frombuffer(text, np.uint8)
    n = len(s)
    step = np.append(np.sign(np.diff(s.astype(np.int16))), 1)
    step[ends] = 1
    known = np.where(step != 0, np.arange(n), n)  # within a run of one byte the next change decides
    up = step[np.minimum.accumulate(known[::-1])[::-1]] > 0
    # stage 1: the suffixes smaller than their successor
    close = np.repeat(ends, np.diff(np.append(-1, ends)))
    small = np.flatnonzero(up)
    order = sorted(range(len(small)), key=[text[a:b] for a, b in zip(small.tolist(), (close[small] + 1).tolist())].__getitem__)
    small = small[order]
    first = np.searchsorted(s[small], np.arange(257))  # sorted by first byte as well
    # stage 2: the others, bucket by bucket
    out: list[np.ndarray] = []
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    for c in range(256):
        part = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        bucket = [part]
        while len(part):  # a suffix after the same byte stays in this bucket
            part = part[part > 0] - 1
            part = part[(s[part] == c) & ~up[part]]
            bucket.append(part)
        whole = np.concatenate([*bucket, small[first[c]:first[c + 1]]])
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[s[before] > c]
        if len(before):
            before = before[np.argsort(s[before], kind="stable")]
            change = np.flatnonzero(np.diff(s[before])) + 1
            for group in np.split(before, change):
                waiting[s[group[0]]].append(group)
    return np.concatenate(out)


def common_prefixes(text: bytes, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it, counted up to ``most``; the suffixes
    have at least ``most`` bytes."""
    padded = np.frombuffer(text + bytes(8), np.uint8)
    words = np.ndarray((len(text) + 1,), np.uint64, padded.data, 0, (1,))  # the eight bytes from each place
    out = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for at in range(0, most, 8):
        differ = words[order[alive] + at] ^ words[order[alive - 1] + at]
        # the lowest byte that differs is the first one
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, (np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64))
        out[alive] += same
        alive = alive[differ == 0]
    return np.minimum(out, most)


def equal_strings(length: int):
    """Class numbers of the ``length``-byte strings that start at the first ``windows`` places of each piece."""

    def classes(contents: list[bytes], windows: np.ndarray) -> np.ndarray:
        text = b"".join(c.translate(_SHIFT) + b"\0" for c in contents)
        size = np.fromiter(map(len, contents), np.int64, len(contents)) + 1
        start = np.cumsum(size) - size
        order = two_stage(text, start + size - 1)
        place = np.arange(len(text)) - np.repeat(start, size)
        valid = place < np.repeat(windows, size)
        order = order[valid[order]]
        label = np.cumsum(common_prefixes(text, order, length) < length) - 1
        out = np.empty(len(text), np.int64)
        out[order] = label
        return out[valid]

    return classes


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, large: int = LARGE, target: int = TARGET) -> DataFrame:
    """``(doc_id, text, spans)`` per row: ``spans`` has ``(at, n)``, ``n`` places from byte ``at`` on at which
    a string of ``length`` bytes starts that also starts elsewhere (null: none)."""
    found = find(docs, doc_id, text, coder, Shape.of(length), _cuts, equal_strings(length), "bytes", large, target)
    return with_spans(docs, doc_id, text, cut(found.select("id", "row", "at", "n"), "spans"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, large: int = LARGE, target: int = TARGET) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` per row; ``kept`` is the rest of the bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(ids, texts, found):
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for text, some in zip(texts, found):
            raw = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
            gone = covered(len(raw), some.as_py(), length)
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            out["kept"].append(raw[~gone].tobytes())
        return {"doc_id": ids, **out}

    rows = repeated(docs, doc_id, text, length, large, target)
    return rows.mapInArrow(by_batches(run, schema, "doc_id", "text", "spans"), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the digest of the bytes that it keeps."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
