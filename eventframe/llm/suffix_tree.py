"""Substring deduplication with suffix trees of words: repeated 50-word windows keep their first document.

Texts are cut into pieces that bring equal windows together (see ``repeats``); a task gets memory-sized
groups of them and builds the suffix trees of their words top down. The suffixes are split by prefixes of
growing length: eight more words at a time, then the rest, and only where a prefix is still shared. The
nodes as deep as a window are its maximal repeats: all their suffixes start with the same window, and the
node has the smallest identifier below it. A branch with one suffix is a leaf and is not followed.

A word is removed if a window that covers it also starts in a document with a smaller identifier; windows
are judged on the input.

Defined cases: null and empty texts have no words; texts shorter than a window keep all words; a null
identifier counts as larger than any other, two of them as equal; rows with the same identifier don't remove
each other's words; an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventframe.llm.common import by_batches, cut, table
from eventframe.llm.repeats import LARGE, NO_ID, TARGET, Shape, covered, find, with_spans

WINDOW = 50
#: Words by which a prefix grows, and words whose hash a task remembers.
_GROW, _KEPT = 8, 500_000


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than space and the five ASCII control spaces."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class Coder:
    """Hashes of words, remembered; a range of words as bytes is the words joined by one space."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str):
        own = words(text)
        if len(self.known) > _KEPT:
            self.known.clear()
        known = self.known
        codes = np.fromiter((known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in own), np.uint64, len(own))
        return codes, lambda a, b: b" ".join(own[a:b])


def _cuts(content: bytes):
    size = np.array([len(w) for w in content.split(b" ")])
    begin = np.cumsum(size + 1) - size - 1
    return begin, begin + size


def _numbers(*columns: np.ndarray) -> np.ndarray:
    """A number for each distinct row of small non-negative numbers."""
    out = columns[0]
    for c in columns[1:]:
        out = np.unique(out * np.int64(c.max(initial=0) + 1) + c, return_inverse=True)[1]
    return out


def equal_windows(width: int):
    """Class numbers of the ``width``-word windows that start at the first ``windows`` words of each piece."""

    def classes(contents: list[bytes], windows: np.ndarray) -> np.ndarray:
        split = [c.split(b" ") for c in contents]
        size = np.fromiter(map(len, split), np.int64, len(split))
        start = np.cumsum(size) - size
        ids: dict[bytes, int] = {}
        word = np.fromiter((ids.setdefault(w, len(ids)) for s in split for w in s), np.int64, int(size.sum()))
        total = len(word)
        # a number for the next one, two, four and eight words of each place (past the end: of fewer)
        steps = {1: word}
        reach = 1
        while reach < min(_GROW, width):
            ahead = np.zeros(total, np.int64)
            ahead[:total - reach] = steps[reach][reach:] + 1
            steps[2 * reach] = _numbers(steps[reach], ahead)
            reach *= 2
        place = np.arange(total) - np.repeat(start, size)
        root = np.flatnonzero(place < np.repeat(windows, size))  # one suffix per window
        node = np.zeros(len(root), np.int64)
        open_, depth = np.arange(len(root)), 0  # suffixes whose prefix of ``depth`` words is shared
        used = 1
        while depth < width and len(open_):
            grow = max(k for k in steps if k <= width - depth)
            child = _numbers(node[open_], steps[grow][root[open_] + depth])
            child = np.unique(child, return_inverse=True)[1]
            node[open_] = used + child
            shared = np.bincount(child)[child] > 1
            used += int(child.max()) + 1
            open_, depth = open_[shared], depth + grow
            # numbers of inner nodes start over, so that products of numbers stay small
            node[open_] = np.unique(node[open_], return_inverse=True)[1] + used
            used += len(open_)
        return np.unique(node, return_inverse=True)[1]

    return classes


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW, large: int = LARGE, target: int = TARGET) -> DataFrame:
    """``(doc_id, text, spans)`` per row: ``spans`` has ``(at, n)``, ``n`` windows from word ``at`` on that
    also start in a document with a smaller identifier (null: none)."""
    found = find(docs, doc_id, text, Coder(), Shape.of(width), _cuts, equal_windows(width), "words", large, target)
    later = found.where(F.col("least") < F.coalesce("id", F.lit(NO_ID)))
    return with_spans(docs, doc_id, text, cut(later.select("id", "row", "at", "n"), "spans"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW, large: int = LARGE, target: int = TARGET) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` per row; ``kept`` is the rest of the words."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(ids, texts, found):
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": []}
        for text, some in zip(texts, found):
            own = words(text.as_py())
            gone = covered(len(own), some.as_py(), width)
            out["n_words"].append(len(own))
            out["n_removed"].append(int(gone.sum()))
            out["kept"].append(b" ".join(w for w, g in zip(own, gone.tolist()) if not g).decode("utf-8", "surrogatepass"))
        return {"doc_id": ids, **out}

    rows = repeated(docs, doc_id, text, width, large, target)
    return rows.mapInArrow(by_batches(run, schema, "doc_id", "text", "spans"), "doc_id long, n_words long, n_removed long, kept string")


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the digest of the words that it keeps."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
windows AS (
  SELECT doc_id, unnest(range(0, greatest(len(words) - 49, 0))) AS pos, words FROM w),
hashed AS (
  SELECT doc_id, pos, md5(array_to_string(words[(pos + 1):(pos + 50)], ' ')) AS h FROM windows),
least_id AS (SELECT h, min(doc_id) AS first_id FROM hashed GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS place
  FROM hashed JOIN least_id USING (h) WHERE first_id < doc_id),
marked AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
each_word AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS place FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept
  FROM each_word ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN marked USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
