"""SimHash near-duplicates: fingerprints of word shingles and a self-join of binary tries.

Two fingerprints that differ in at most ``k`` bits agree on one of ``k + 1`` blocks of bits. For each block
the fingerprint is rotated so that the block leads; the rotated values form a binary trie whose subtries
below a block value are spread over tasks. A subtrie is joined with itself by walking pairs of nodes
together, adding up the bits in which their paths differ; a pair beyond the budget is dropped with all below
it. Links of a subtrie leave it as a forest, components follow over all subtries.

Equal fingerprints are one node, so copies are never expanded into pairs; a fingerprint has a bounded number
of others within ``k`` bits, which bounds the pairs of nodes of a dense subtrie in proportion to its size.

Defined cases: a null or empty text has no words and fingerprint zero, linked like any other; fewer words
than a shingle: the whole sequence is the shingle; rows with a null identifier get a fingerprint, link
nothing and have a null component; repeated rows give one output row each; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventframe.llm.common import broadcast_hot, by_batches, cut, table
from eventframe.llm.components import components

#: Shingles whose bits are counted at once (64 bytes each).
_AT_ONCE = 1 << 17
#: Node pairs that are walked at once.
_PAIRS = 1 << 20


def shingles(text: str | None, width: int) -> Iterator[bytes]:
    """The text's word shingles in order, repeats included (``bytes`` methods treat only ASCII letters and
    the six ASCII white-space characters specially)."""
    words = (text or "").encode().lower().split()
    if not words:
        return iter(())
    if len(words) < width:
        return iter([b" ".join(words)])
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    return (whole[a:b] for a, b in zip(starts[:n].tolist(), ends[width - 1:].tolist()))


def fingerprint(text: str | None, width: int = 3) -> int:
    """Bit ``i`` is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles(text, width)), np.uint64)
    sums = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), _AT_ONCE):
        part = hashes[lo:lo + _AT_ONCE]
        sums += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(sums * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp)`` per row, ``fp`` as a signed 64-bit integer."""

    def fps(ids, texts):
        values = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts))
        return {"doc_id": ids, "fp": values.view(np.int64)}

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    return docs.mapInArrow(by_batches(fps, schema, "doc_id", "text"), "doc_id long, fp long")


def trie_pairs(values: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a sorted array of distinct 64-bit values within ``budget`` bits of each other and
    equal in their first ``depth`` bits.

    A trie node is a range of the sorted array; the walk goes down pair by pair, both sides at the same
    depth, and splits each node where its next bit turns to one.
    """
    cuts = np.flatnonzero(np.diff(values >> np.uint64(64 - depth))) + 1 if depth else np.empty(0, np.int64)
    lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(values)]])
    todo = [(depth, np.stack([lo, hi, lo, hi, np.zeros_like(lo)]).astype(np.int64))]
    found: list[np.ndarray] = []
    while todo:
        at, pairs = todo.pop()
        alo, ahi, blo, bhi, bits = pairs
        single = (ahi - alo == 1) & (bhi - blo == 1)
        a, b = alo[single & (alo != blo)], blo[single & (alo != blo)]
        near = np.bitwise_count(values[a] ^ values[b]) <= budget
        found.append(np.stack([a[near], b[near]]))
        pairs = pairs[:, ~single]
        if not pairs.shape[1]:
            continue
        if pairs.shape[1] > _PAIRS:
            half = pairs.shape[1] // 2
            todo += [(at, pairs[:, :half]), (at, pairs[:, half:])]
            continue
        alo, ahi, blo, bhi, bits = pairs
        bit = np.uint64(63 - at)
        middle = lambda lo: np.searchsorted(values, ((values[lo] >> bit) | np.uint64(1)) << bit)
        amid, bmid = np.clip(middle(alo), alo, ahi), np.clip(middle(blo), blo, bhi)
        other = alo != blo
        below = np.concatenate([
            np.stack([alo, amid, blo, bmid, bits]), np.stack([amid, ahi, bmid, bhi, bits]),
            np.stack([alo, amid, bmid, bhi, bits + 1]),
            np.stack([amid, ahi, blo, bmid, bits + 1])[:, other]], axis=1)
        alive = (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= budget)
        todo.append((at + 1, below[:, alive]))
    return tuple(np.concatenate(found, axis=1))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest reachable index of each of ``n`` nodes over the links ``a - b``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _widths(blocks: int) -> list[tuple[int, int]]:
    """(start, width) of each block, from the top bit."""
    ends = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def links(nodes: DataFrame, budget: int = 2) -> DataFrame:
    """``nodes(fp, node)``, distinct ``fp`` -> ``(a, b)``: a forest of the links within ``budget`` bits."""
    spans = _widths(budget + 1)
    turned = F.array(*(F.struct(F.lit(i).alias("block"), (F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", 64 - s)) if s else F.col("fp")).alias("turned"))
                       for i, (s, _) in enumerate(spans)))
    rows = nodes.select("node", F.explode(turned).alias("t")).select("node", "t.*")
    lead = F.lit(None).cast("long")
    for i, (_, w) in enumerate(spans):
        lead = F.when(F.col("block") == i, F.shiftrightunsigned("turned", 64 - w)).otherwise(lead)
    rows = rows.withColumn("lead", lead)
    rows = rows.repartition("block", "lead").sortWithinPartitions("block", "lead", "turned")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def join(block: int, turned: np.ndarray, node: np.ndarray):
        values = turned.view(np.uint64)
        order = np.argsort(values)
        values, node = values[order], node[order]
        a, b = trie_pairs(values, spans[block][1], budget)
        label = forest(len(values), a, b)
        own = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[label[own]])], schema=schema)

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("block", "lead", "turned", "node")))
            if sum(len(h[0]) for h in held) < 50_000:
                continue
            cols = [np.concatenate(c) for c in zip(*held)]
            change = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
            if len(change):  # all but the last subtrie are complete
                yield from each(*(c[:change[-1]] for c in cols))
                cols = [c[change[-1]:] for c in cols]
            held = [tuple(cols)]
        if held:
            yield from each(*(np.concatenate(c) for c in zip(*held)))

    def each(block, lead, turned, node):
        for i in np.unique(block):
            yield join(int(i), turned[block == i], node[block == i])

    return rows.mapInArrow(run, "a long, b long")


def near_dups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, budget: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id, group_size)`` per row; ``group_size`` counts the rows with the same
    fingerprint."""
    rows = cut(fingerprints(docs, doc_id, text, width), "simhash")
    nodes = cut(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("size")), "nodes")
    found = components(links(nodes.select("fp", "node"), budget))
    nodes = nodes.join(found, "node", "left").select("fp", "size", F.coalesce("component", "node").alias("component_id"))
    out = broadcast_hot(rows.where("doc_id is not null"), cut(nodes, "classes"), "fp", "size")
    none = rows.where("doc_id is null").select("fp", "doc_id", F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(none).withColumnRenamed("size", "group_size")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, budget: int = 2) -> DataFrame:
    """The rows of ``docs`` whose identifier is their group's smallest (rows without identifier stay)."""
    gone = near_dups(docs, doc_id, text, width, budget).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = cut(gone, "near-dups")
    return docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its fingerprint and component."""
    found = near_dups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")
