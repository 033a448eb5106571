"""Exact n-gram Jaccard join in the metric space of shingle sets (distance 1 - intersection / union).

Equal sets are one node. Two bounds hold for any two sets within distance ``r``: they share at least
``(1 - r)`` of either's shingles, and by the triangle inequality their distances to any third set differ by
at most ``r``.

1. *Nodes that can have a partner.* Of each set the shingles with the smallest hashes (``r`` of it and a tenth
   more) are looked up in all others; two sets within ``r`` share a tenth of their shingles there or so. What remains
   is the crowd. The hashes travel in blocks, one for each batch of documents and range of hashes, each hash once per batch.
2. *Voronoi rounds.* Pivots are drawn from the crowd: the most central node of each large bucket of equal
   minimum hashes, the buckets' least size falling with each round, and of two linked pivots only one. Every node gets its exact distance to all
   pivots within ``2 r``; the nearest within ``r`` is its region, and the nodes beyond up to ``2 r`` are the documents at
   the region's boundary, replicated into it. A node at distance ``t`` from a pivot has all its
   partners in the window up to ``t + r``; once everything in that window is in the node's own component, no
   link of it can change the result and it leaves. All others, and those that no pivot reached, go into the
   next round with more pivots.
3. *The last round.* All nodes that are left are pivots, and those of different components are joined exactly
   within ``r``.

Distances come from an index over shingles, rarest first: sets within a distance share one of the first, so
shingles that many documents have hardly ever lead a search; every candidate's distance is then computed
on whole sets. Links go into components (large-star, small-star).

Shingles are 64-bit hashes of their words; two different shingles of one pair of documents being equal in
it has a chance of about 1 in 10**13.

Defined cases: a null or empty text, or white space only, has no set and links to nothing; with fewer words
than a shingle the whole sequence is the only shingle; very long texts are taken whole; repeated rows give
a row each, and rows that share an identifier are one document; rows with a null identifier get their set's size,
link to nothing and have a null component; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventframe.llm.common import broadcast_hot, by_batches, cut, slices, table, window_hashes
from eventframe.llm.components import components

#: Least size of a round's buckets: the crowd's size over this, over its square, and so on.
FACTOR = 16
#: Buckets under this size give no pivots of their own; their nodes meet in the last round.
SMALL = 4
#: Pivots whose shingles number up to this are broadcast (16 bytes each).
_BROADCAST = 1 << 19
#: Up to so many nodes of the crowd are broadcast to find their texts (40 bytes each); more are joined in a shuffle.
_FEW = 1 << 20
#: In a block of hashes, the owner of those that several sets of the batch have; also the most rows of a batch.
_ANY = (1 << 16) - 1
_BLOCK = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("hashes", "owners", "rids", "keys", "given", "counts"))])
_BLOCK_DDL = "part int, hashes binary, owners binary, rids binary, keys binary, given binary, counts binary"


def shared(n: int | Column, percent: int) -> int | Column:
    """How many shingles a set of ``n`` shares at least with any set of that similarity: ceil(n * percent / 100)."""
    if isinstance(n, int):
        return (n * percent + 99) // 100
    return F.ceil(n * percent / 100).cast("int")


def shingle_hashes(text: bytes | None, width: int, known: dict[bytes, int]) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    words = (text or b"").lower().split()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return np.unique(window_hashes(codes, min(width, len(codes)))) if len(codes) else codes


def lowest(n: int, percent: int) -> int:
    """Length of the prefix by hash: what two sets may differ in, and a tenth."""
    return min(n, n - shared(n, percent) + max(1, -(-n // 10)))


def sets(docs: DataFrame, width: int, percent: int | None) -> DataFrame:
    """``(doc_id, n, k1, k2, h)`` per row: the set's size, a 128-bit key of it, and its hashes in order: those of
    the prefix, or all with no ``percent``."""

    def rows(ids, texts):
        known: dict[bytes, int] = {}
        n, key, parts = [], [], []
        for t in texts:
            h = shingle_hashes(t.as_py(), width, known)
            if len(known) > 1 << 20:
                known.clear()
            n.append(len(h))
            key.append(np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64))
            parts.append(h if percent is None else h[:lowest(len(h), percent)])
        flat = np.concatenate([*parts, np.empty(0, np.uint64)]).view(np.int64)
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        keys = np.array(key, np.int64).reshape(-1, 2)
        return {"doc_id": ids, "n": pa.array(n, pa.int32()), "k1": keys[:, 0], "k2": keys[:, 1],
                "h": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}

    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("h", pa.list_(pa.int64()))])
    return docs.mapInArrow(by_batches(rows, schema, "doc_id", "text"), "doc_id long, n int, k1 long, k2 long, h array<long>")


def _send(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Blocks of hashes by range: of each batch every set once and every hash once. A hash that several sets of the
    batch have is credited to them here, and goes out with the owner ``_ANY``."""
    for batch in batches:
        for part in slices(batch, 32 << 20):
            for lo in range(0, part.num_rows, _ANY):
                yield _blocks(part.slice(lo, _ANY), bits)


def _blocks(part: pa.RecordBatch, bits: int) -> pa.RecordBatch:
    keys, rids = part.column("k1").to_numpy(), part.column("rid").to_numpy()
    lists = part.column("h")
    _, first = np.unique(keys, return_index=True)
    once = np.zeros(len(keys), bool)
    once[first] = True
    owner = np.repeat(np.arange(len(keys)), np.diff(lists.offsets.to_numpy()))
    hashes = lists.flatten().to_numpy().view(np.uint64)[once[owner]]
    owner = owner[once[owner]]
    order = np.argsort(hashes)
    hashes, owner = hashes[order], owner[order]
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(hashes) else np.empty(0, bool)
    size = np.diff(np.append(np.flatnonzero(new), len(hashes)))
    several = np.repeat(size > 1, size)
    credit = np.bincount(owner[several], minlength=len(keys))
    owner = np.where(several, _ANY, owner)[new].astype(np.uint16)
    hashes = hashes[new]
    ends = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange(1 << bits), side="right") if bits else np.array([len(hashes)])
    out: dict[str, list] = {c: [] for c in _BLOCK.names}
    for p, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
        given = np.flatnonzero(credit) if p == 0 else np.empty(0, np.int64)
        own = np.unique(owner[a:b])
        own = own[own != _ANY].astype(np.int64)
        place = np.full(_ANY + 1, _ANY, np.uint16)
        place[own] = np.arange(len(own))
        if b > a or len(given):
            for c, x in zip(_BLOCK.names, (p, hashes[a:b], place[owner[a:b]], rids[own], keys[own], rids[given], credit[given])):
                out[c].append(x if c == "part" else x.tobytes())
    return pa.RecordBatch.from_pydict(out, schema=_BLOCK)


def _gather(group: pa.Table) -> pa.Table:
    """How many hashes of a range each sent row shares with another set."""
    blocks = group.to_pylist()
    read = lambda name, kind: [np.frombuffer(x[name], kind) for x in blocks]
    rids, keys, places = read("rids", np.int64), read("keys", np.int64), read("owners", np.uint16)
    hashes = np.concatenate(read("hashes", np.uint64))
    any_ = np.concatenate([p == _ANY for p in places])
    start = np.cumsum([0, *map(len, rids)])
    owner = np.concatenate([p.astype(np.int64) + at for p, at in zip(places, start)])
    rids, keys = np.concatenate(rids), np.concatenate(keys)
    order = np.argsort(hashes)
    hashes, any_, owner = hashes[order], any_[order], owner[order]
    credit = np.zeros(len(rids), np.int64)
    if len(hashes):
        new = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        own = np.where(any_, 0, owner)
        key = keys[own] if len(keys) else own
        top, low = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        least = np.minimum.reduceat(np.where(any_, top, key), new)
        most = np.maximum.reduceat(np.where(any_, low, key), new)
        shared_ = np.logical_or.reduceat(any_, new) | (least < most)
        held = np.repeat(shared_, np.diff(np.append(new, len(hashes)))) & ~any_
        credit = np.bincount(owner[held], minlength=len(rids))
    given, count = read("given", np.int64), read("counts", np.int64)
    return pa.table({"rid": np.concatenate([rids[credit > 0], *given]), "k": np.concatenate([credit[credit > 0], *count])})


def crowd_of(rows: DataFrame, percent: int, block: int = 1 << 21) -> DataFrame:
    """``(rid)`` of the sets that share enough of their prefix with others to be within reach of one, by the row
    that came first among the equal ones of its batch; ``block`` hashes or so make one range."""
    total = rows.agg(F.sum(F.size("h"))).first()[0] or 0
    bits = max(3, (total // block).bit_length())
    sent = rows.select("rid", "k1", "h").mapInArrow(lambda batches: _send(batches, bits), _BLOCK_DDL)
    credit = sent.groupBy("part").applyInArrow(_gather, "rid long, k long").groupBy("rid").agg(F.sum("k").alias("k"))
    # the other set has at least percent of this one's shingles, so its prefix has that share of the tenth
    need = F.greatest(F.lit(1), F.ceil(F.col("n") * percent / 1000))
    return rows.select("rid", "n").join(credit, "rid").where(F.col("k") >= need).select("rid")


def small_side(df: DataFrame) -> DataFrame:
    """``df``, which is narrow and written, as the broadcast side of a join while it has few rows."""
    return F.broadcast(df) if df.count() <= _FEW else df


def first_ones(n: Column, percent: int) -> Column:
    """How many of a set's shingles, in any order common to all sets, hold one that it shares with a similar set."""
    return n - shared(n, percent) + 1


def alive(crowd: DataFrame, percent: int) -> DataFrame:
    """The nodes without those that have too many shingles of their own for any partner; as such a node's shingles
    no longer count for others, this goes on until hardly any more leave."""
    while True:
        size = crowd.count()
        rows = crowd.select("node", "n", F.explode("h").alias("s"))
        often = rows.groupBy("s").agg(F.count("*").alias("c")).where("c > 1").select("s")
        held = rows.select("node", "s").join(often, "s", "left_semi").groupBy("node").agg(F.count("*").alias("k"))
        crowd = cut(crowd.join(held, "node").where(F.col("k") >= shared(F.col("n"), percent)).drop("k"), "crowd-sets")
        if crowd.count() * 20 >= size * 19:
            return crowd


def index_of(crowd: DataFrame, percent: int) -> DataFrame:
    """``(node, n, s, rank, density)``: each set's first shingles, rarest first, as far as similarity ``percent`` needs
    them, without those that no other set has; ``density`` is the mean number of sets that have one of its own."""
    rows = crowd.select("node", "n", F.explode("h").alias("s"))
    often = rows.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    listed = rows.join(often, "s")
    own = Window.partitionBy("node")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("c", "s"))
    listed = listed.select("node", "n", "s", place.alias("rank"), (F.sum("c").over(own) / F.col("n")).alias("density"))
    return listed.where(F.col("rank") <= first_ones(F.col("n"), percent))


def distances(left: DataFrame, pivots: DataFrame, index: DataFrame, crowd: DataFrame, percent: int, class_of: DataFrame | None = None) -> DataFrame:
    """``(node, pivot, i, u)``: sizes of intersection and union of all pairs with similarity ``percent`` or more; with
    ``class_of(node, component)`` only of pairs of different components, each pair once."""
    index = index.where(F.col("rank") <= first_ones(F.col("n"), percent))
    pivots = small_side(pivots.select("node"))
    ours = index.join(left.select("node"), "node", "left_semi").select("node", "n", "s", "rank")
    theirs = cut(index.join(pivots, "node", "left_semi").select(F.col("node").alias("pivot"), F.col("n").alias("m"), "s", F.col("rank").alias("place")), "pivot-index")
    arrays = crowd.join(pivots, "node", "left_semi").select(F.col("node").alias("pivot"), F.col("h").alias("g"))
    near = (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)
    # at the first shingle that two sets share, what follows it must be enough for their intersection
    near &= (F.least(F.col("n") - F.col("rank"), F.col("m") - F.col("place")) + 1) * (100 + percent) >= (F.col("n") + F.col("m")) * percent
    other = F.col("node") != F.col("pivot")
    if class_of is not None:
        own = ours.join(class_of, "node", "left").select("node", "n", "s", "rank", F.coalesce("component", "node").alias("x"))
        ours, theirs = own, cut(own.select(F.col("node").alias("pivot"), F.col("n").alias("m"), "s", F.col("rank").alias("place"), F.col("x").alias("y")), "pivot-index")
        other = (F.col("node") < F.col("pivot")) & (F.col("x") != F.col("y"))
    if (arrays.agg(F.sum(F.size("g"))).first()[0] or 0) <= _BROADCAST:
        theirs, arrays = F.broadcast(theirs), F.broadcast(arrays)
    pairs = cut(ours.join(theirs, "s").where(near & other).select("node", "pivot").distinct(), "pairs")
    pairs = crowd.select("node", "h").join(small_side(pairs), "node").join(arrays, "pivot")
    i = F.size(F.array_intersect("h", "g"))
    pairs = pairs.select("node", "pivot", i.alias("i"), (F.size("h") + F.size("g") - i).alias("u"))
    return cut(pairs.where(F.col("i") * 100 >= F.col("u") * percent), "distances")


def pivots_of(left: DataFrame, index: DataFrame, crowd: DataFrame, percent: int, least: int, seed: int) -> DataFrame:
    """``(node)``: the most central node of each bucket of equal minimum hashes with ``least`` nodes or more; of two
    that are linked only the more central."""
    # the smallest of the shingles that others have too; the most central set has the most common ones
    own = index.join(left.select("node"), "node", "left_semi").groupBy("node").agg(
        F.min(F.xxhash64(F.lit(seed), F.col("s"))).alias("bucket"), F.first("density").alias("density"))
    best = own.groupBy("bucket").agg(F.count("*").alias("size"), F.max(F.struct(F.col("density"), (-F.col("node")).alias("less"))).alias("best"))
    some = cut(best.where(F.col("size") >= least).select((-F.col("best.less")).alias("node"), "best.density").distinct(), "pivots")
    close = distances(some, some, index, crowd, percent).where("node < pivot").select("node", "pivot").join(some.withColumnRenamed("density", "d"), "node")
    close = close.join(some.select(F.col("node").alias("pivot"), F.col("density").alias("e")), "pivot")
    lesser = close.select(F.when(F.col("d") >= F.col("e"), F.col("pivot")).otherwise(F.col("node")).alias("node"))
    return cut(some.select("node").join(lesser, "node", "left_anti"), "pivots")


def links(crowd: DataFrame, percent: int = 80, factor: int = FACTOR, small: int = SMALL) -> DataFrame:
    """``crowd(node, n, h)`` -> ``(a, b)``: links of similarity ``percent`` or more that connect what all of them
    connect. Lists no link between nodes that others join already."""
    reach = max(1, 2 * percent - 100)
    crowd = alive(crowd, percent)
    index = cut(index_of(crowd, reach), "index")
    left = cut(crowd.select("node"), "left")
    size, step = left.count(), 0
    linked = left.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
    class_of = left.select("node", F.col("node").alias("component")).where("false")
    least = size // factor
    while least >= small and not left.isEmpty():
        found = distances(left, pivots_of(left, index, crowd, percent, least, step), index, crowd, reach)
        step, least = step + 1, least // factor
        new = found.where(F.col("i") * 100 >= F.col("u") * percent).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        linked = cut(linked.unionByName(new).distinct(), "links")
        class_of = cut(components(linked), "classes")
        left = cut(_unsettled(left, found, class_of, percent), "left")
    rest = distances(left, left, index, crowd, percent, class_of).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    return linked.unionByName(rest)


def _unsettled(left: DataFrame, found: DataFrame, class_of: DataFrame, percent: int) -> DataFrame:
    """The nodes that no pivot within distance settles: none is near, or each one's window reaches a document of
    another component."""
    named = lambda c: class_of.select(F.col("node").alias(c), F.col("component").alias(f"{c}_class"))
    far = F.lit(1) - F.col("i") / F.col("u")
    pairs = found.select("node", "pivot", far.alias("d"), (F.col("i") * 100 >= F.col("u") * percent).alias("linked"))
    pairs = pairs.join(named("node"), "node", "left").join(named("pivot"), "pivot", "left")
    strange = ~F.col("linked") & (F.coalesce("node_class", "node") != F.coalesce("pivot_class", "pivot"))
    gap = pairs.groupBy("pivot").agg(F.min(F.when(strange, F.col("d"))).alias("gap"))
    window = F.col("d") + F.lit(1 - percent / 100) + F.lit(1e-9)
    done = pairs.where("linked").join(gap, "pivot").where(F.col("gap").isNull() | (window < F.col("gap"))).select("node")
    # a pivot's own window is the distance itself
    own = gap.where(F.col("gap").isNull() | (F.col("gap") > 1 - percent / 100 + 1e-9)).select(F.col("pivot").alias("node"))
    return left.join(done.unionByName(own).distinct(), "node", "left_anti")


def near_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80,
               factor: int = FACTOR, small: int = SMALL) -> DataFrame:
    """``(doc_id, n_shingles, component_id, group_size)`` per row; ``group_size`` counts the rows of the same set."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    rows = cut(sets(docs, width, percent).withColumn("rid", F.monotonically_increasing_id()), "shingle-sets")
    able = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    narrow = rows.where(able).select("rid", "doc_id", "n", "k1", "k2")
    nodes = cut(narrow.groupBy("k1", "k2").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("size")), "nodes")
    # a set's first row is the first of its batch too
    crowd = nodes.join(crowd_of(rows.where(able), percent).withColumnRenamed("rid", "node"), "node", "left_semi")
    crowd = cut(crowd.select(F.col("least").alias("doc_id"), "node", F.col("k1").alias("j1"), F.col("k2").alias("j2")), "crowd")
    # while the crowd is small, its texts are found without moving any
    own = docs.join(small_side(crowd.select("doc_id")), "doc_id", "left_semi")
    own = sets(own, width, None).drop("n").join(small_side(crowd), "doc_id").where("k1 = j1 and k2 = j2")
    if not narrow.groupBy("doc_id").count().where("count > 1").isEmpty():  # equal rows
        own = own.dropDuplicates(["node"])
    own = own.select("node", F.size("h").alias("n"), "h")
    edges = links(cut(own, "crowd-sets"), percent, factor, small)
    found = components(edges.unionByName(_same_document(narrow, nodes)))
    classes = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = cut(classes, "classes")
    # the smallest identifier of each component that has several sets
    several = classes.groupBy("component").agg(F.count("*").alias("c"), F.min("least").alias("component_id")).where("c > 1").drop("c")
    classes = classes.join(several, "component", "left").select("k1", "k2", "size", F.coalesce("component_id", "least").alias("component_id"))
    out = broadcast_hot(narrow.drop("rid"), cut(classes, "named-classes"), ["k1", "k2"], "size")
    none = rows.where(~able).select("doc_id", "n", "k1", "k2", F.lit(None).cast("long").alias("size"), F.col("doc_id").alias("component_id"))
    return out.unionByName(none).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("size").alias("group_size"))


def _same_document(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(a, b)`` that join the different sets of rows with one identifier."""
    twice = rows.groupBy("doc_id").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo <> hi").select("doc_id")
    own = cut(rows.join(twice, "doc_id", "left_semi").select("doc_id", "k1", "k2").distinct(), "several-sets")
    own = own.join(nodes.select("k1", "k2", "node"), ["k1", "k2"])
    return own.join(own.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b")


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its component of links of similarity 0.8 or more."""
    return near_texts(table(spark, sf_dir, "documents"))
