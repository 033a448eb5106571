"""What the two repeat finders share: cutting sequences into pieces so that equal windows meet.

A window is a run of ``window`` consecutive elements (bytes or words). Its anchor is the run of ``gram``
elements in it with the smallest hash, the leftmost of equal ones; equal windows have equal anchors at equal
places. Consecutive windows with the same occurrence of their anchor form a piece, so a piece has at most
``window - gram + 1`` windows, all different, and equal windows are always in two pieces under one anchor.

Three passes read the texts. The first counts anchors; those that occur once can't be in a repeat. The
second lists the other pieces, without their text, told by a bitmap of fixed size (a false hit only costs its
piece). Equal pieces are one: they are counted before they meet, and where they are alone under their anchor
the count decides. The third pass sends the text of the rest, told by another bitmap, once per task. Anchors
with very many different pieces are given to ``split_large``, which deals their windows out one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventframe.llm.common import broadcast_hot, cut, mix64

#: Elements that are worked on at once, and the bits of a place among them.
_AT_ONCE, _PLACE = 1 << 19, 21
#: Bits of an anchor that address the bitmap (16 MB).
_BITS = 27
#: Pieces whose text a task remembers to have sent.
_SENT = 200_000
#: Different pieces of an anchor up to which one task compares them, and the bytes compared at once.
LARGE, TARGET = 50_000, 1 << 20
#: Stands for a missing identifier: larger than any.
NO_ID = 2**63 - 1
RUN = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("id", pa.int64())])
#: Class numbers of all windows of some pieces: (contents, windows of each) -> one number per window.
Equal = Callable[[list[bytes], np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Shape:
    """Lengths in elements; ``gram`` is a power of two."""

    window: int
    gram: int

    @classmethod
    def of(cls, window: int) -> Shape:
        """Grams of about a third of the window: long ones are seldom equal by chance, however much text
        there is, and anchors stay tens of elements apart."""
        return cls(window, 1 << max(0, (window // 3).bit_length() - 1))


def anchors(codes: np.ndarray, first: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor) of the pieces of sequences laid end to end; ``first``: where each begins, and
    the end. A window lies within one sequence."""
    wide = shape.window - shape.gram + 1
    if len(codes) < shape.window:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    grams, size, factor = codes, 1, np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while size < shape.gram:
            grams = grams[:-size] * factor + grams[size:]
            size, factor = 2 * size, factor * factor
    grams = mix64(grams)
    mask = np.uint64((1 << _PLACE) - 1)
    least, size = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64), 1
    while 2 * size <= wide:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < wide:
        least = np.minimum(least[:size - wide], least[wide - size:])
    place = least & mask
    valid = np.arange(len(place)) + shape.window <= np.repeat(first[1:], np.diff(first))[:len(place)]
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    start = np.flatnonzero(begin)
    count = np.cumsum(valid)
    windows = np.diff(np.append(count[start] - 1, count[-1]))
    return start, windows, grams[place[start].astype(np.int64)]


def buffers(lengths: list[int], shape: Shape) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray]]:
    """Groups of segments (row, from, to) with about ``_AT_ONCE`` elements, and where each begins. Longer
    rows are cut into segments that overlap by one window less one, so that each window is in one of them."""
    held: list[tuple[int, int, int]] = []
    total = 0
    step = _AT_ONCE - shape.window + 1
    for row, n in enumerate(lengths):
        if n < shape.window:
            continue
        for lo in range(0, n - shape.window + 1, step):
            hi = min(n, lo + _AT_ONCE)
            if held and total + hi - lo > _AT_ONCE:
                yield held, np.concatenate([[0], np.cumsum([b - a for _, a, b in held])])
                held, total = [], 0
            held.append((row, lo, hi))
            total += hi - lo
    if held:
        yield held, np.concatenate([[0], np.cumsum([b - a for _, a, b in held])])


#: A coder turns a text into (codes of its elements, a function from an element range to its bytes).
Coder = Callable[[str], tuple[np.ndarray, Callable[[int, int], bytes]]]


def _found(texts: list[str | None], coder: Coder, shape: Shape):
    """(row, start in the row, windows, anchor, bytes of a range) of each buffer's pieces."""
    coded = [coder(t or "") for t in texts]
    for held, first in buffers([len(c) for c, _ in coded], shape):
        codes = np.concatenate([coded[r][0][a:b] for r, a, b in held])
        start, windows, anchor = anchors(codes, first, shape)
        segment = np.searchsorted(first, start, side="right") - 1
        rows = np.array([r for r, _, _ in held])[segment]
        yield rows, start - first[segment] + np.array([a for _, a, _ in held])[segment], windows, anchor, coded


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Pieces of a batch with about four MB of text."""
    rows = max(1, int(batch.num_rows * (4 << 20) / max(batch.nbytes, 1)))
    for lo in range(0, batch.num_rows, rows):
        part = batch.slice(lo, rows)
        yield part, part.column(column).to_pylist()


def anchor_counts(docs: DataFrame, text: str, coder: Coder, shape: Shape) -> DataFrame:
    """``(anchor, n)``: the anchors that lead more than one piece."""
    schema = pa.schema([("anchor", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            for _, texts in _parts(batch, 0):
                for _, _, _, anchor, _ in _found(texts, coder, shape):
                    values, n = np.unique(anchor, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], schema=schema)

    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "anchor long, n long")
    return found.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")


def bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """A bitmap of fixed size with the bits of all values of a 64-bit column set, eight to a byte."""
    bit = F.shiftrightunsigned(key, 64 - _BITS) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros(1 << (_BITS - 3), np.uint8)
    for part, bits in parts.toLocalIterator():
        out[(part - 1) * 4096:(part - 1) * 4096 + len(bits)] = np.frombuffer(bytes(bits), np.uint8)
    return out


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The indexes of the keys whose bit is set."""
    place = keys >> np.uint64(64 - _BITS)
    return np.flatnonzero(bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1)


def row_key(text: str) -> Column:
    """Tells rows with the same identifier apart by their text; rows equal in both have equal repeats."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _hashed(texts: list[str | None], coder: Coder, shape: Shape, bits: np.ndarray):
    """(row, start, windows, anchor, hash of the content, content) of the pieces whose anchor's bit is set."""
    for rows, start, windows, anchor, coded in _found(texts, coder, shape):
        use = _marked(bits, anchor)
        rows, start, windows, anchor = rows[use], start[use], windows[use], anchor[use]
        content = [coded[r][1](s, s + n - 1 + shape.window) for r, s, n in zip(rows.tolist(), start.tolist(), windows.tolist())]
        yield rows, start, windows, anchor, np.fromiter(map(xxhash.xxh64_intdigest, content, anchor.tolist()), np.uint64, len(content)), content


def pieces(docs: DataFrame, doc_id: str, text: str, coder: Coder, shape: Shape, bits) -> DataFrame:
    """``(id, row, start, windows, anchor, piece)``: the pieces under anchors that occur twice; ``piece`` is a
    hash of the content."""
    schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()),
                        ("anchor", pa.int64()), ("piece", pa.int64())])

    def run(batches):
        for batch in batches:
            for part, texts in _parts(batch, 2):
                for rows, start, windows, anchor, piece, _ in _hashed(texts, coder, shape, bits.value):
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).take(at), part.column(1).take(at), pa.array(start), pa.array(windows, pa.int32()),
                        pa.array(anchor.view(np.int64)), pa.array(piece.view(np.int64))], schema=schema)

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), row_key(text).alias("row"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, row long, start long, windows int, anchor long, piece long")


def contents(docs: DataFrame, text: str, coder: Coder, shape: Shape, bits, wanted) -> DataFrame:
    """``(anchor, piece, content)`` of the pieces whose own bit is set in ``wanted``, at least once each; a task
    sends a piece once, as long as it remembers it."""
    schema = pa.schema([("anchor", pa.int64()), ("piece", pa.int64()), ("content", pa.binary())])

    def run(batches):
        sent: set[int] = set()
        for batch in batches:
            for _, texts in _parts(batch, 0):
                for _, _, _, anchor, piece, content in _hashed(texts, coder, shape, bits.value):
                    use = [i for i in _marked(wanted.value, piece).tolist() if (h := int(piece[i])) not in sent and not sent.add(h)]
                    if len(sent) > _SENT:
                        sent.clear()
                    yield pa.RecordBatch.from_arrays([
                        pa.array(anchor[use].view(np.int64)), pa.array(piece[use].view(np.int64)), pa.array([content[i] for i in use], pa.binary())], schema=schema)

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "anchor long, piece long, content binary")


def find(docs: DataFrame, doc_id: str, text: str, coder: Coder, shape: Shape, cuts: Callable[[bytes], tuple[np.ndarray, np.ndarray]],
         equal: Equal, name: str, large: int = LARGE, target: int = TARGET) -> DataFrame:
    """``(id, row, at, n, least)``: for each text the runs of ``n`` windows from element ``at`` on that occur
    more than once, with the smallest identifier of their occurrences (``NO_ID`` for null)."""
    broadcast = docs.sparkSession.sparkContext.broadcast
    repeated = cut(anchor_counts(docs, text, coder, shape), name + "-anchors")
    bits = broadcast(bitmap(repeated, "anchor"))
    found = cut(pieces(docs, doc_id, text, coder, shape, bits), name + "-pieces")
    whole = found.groupBy("anchor", "piece").agg(
        F.min("windows").alias("windows"), F.count("*").alias("size"), F.min(F.coalesce("id", F.lit(NO_ID))).alias("id"))
    whole = cut(whole, name + "-distinct")
    per_anchor = whole.groupBy("anchor").agg(F.count("*").alias("pieces"), F.sum("size").alias("all")).where("`all` > 1")
    grouped = cut(whole.join(per_anchor.select("anchor", "pieces"), "anchor"), name + "-grouped")
    several = grouped.where("pieces > 1")
    wanted = broadcast(bitmap(several, "piece"))
    runs = repeated_runs(grouped, contents(docs, text, coder, shape, bits, wanted), shape, cuts, equal, name, large, target)
    return spans(found, runs, grouped)


def repeated_runs(grouped: DataFrame, texts: DataFrame, shape: Shape, cuts: Callable[[bytes], tuple[np.ndarray, np.ndarray]],
                  equal: Equal, name: str, large: int = LARGE, target: int = TARGET) -> DataFrame:
    """``(anchor, piece, runs)``: per piece the runs ``(at, n, id)`` of windows that occur more than once,
    ``id`` being the smallest identifier of their occurrences.

    ``grouped(anchor, piece, windows, size, id, pieces)`` has one row per piece, ``pieces`` being the number
    under its anchor; ``texts`` has the contents where that is over one. ``equal`` finds the equal windows
    of a memory-sized group of anchors. Anchors with over ``large`` pieces go another way: each of their
    windows is a row keyed by its own hash, whose counts meet with map-side combine, so that no task gets
    such a group. ``cuts`` gives where a content's elements begin and end.
    """
    alone = grouped.where("pieces = 1").select("anchor", "piece", F.array(F.struct(F.lit(0).alias("at"), F.col("windows").alias("n"), "id")).alias("runs"))
    none = F.lit(None)
    several = grouped.where((F.col("pieces") > 1) & (F.col("pieces") <= large)).select("anchor", "piece", "windows", "size", "id", none.cast("binary").alias("content"))
    some = several.unionByName(texts.select("anchor", "piece", none.cast("int").alias("windows"), none.cast("long").alias("size"), none.cast("long").alias("id"), "content"))
    some = some.repartition("anchor").sortWithinPartitions("anchor")
    schema = pa.schema([("anchor", pa.int64()), ("piece", pa.int64()), ("runs", pa.list_(RUN))])
    some = some.mapInArrow(in_groups(lambda rows: _runs(rows, equal, schema), target), "anchor long, piece long, runs array<struct<at:int,n:int,id:long>>")
    out = alone.unionByName(some)
    many = grouped.where(F.col("pieces") > large)
    if many.isEmpty():
        return out
    return out.unionByName(split_large(cut(many.join(texts.dropDuplicates(["anchor", "piece"]), ["anchor", "piece"]), name + "-large"), shape, cuts))


def _joined(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The rows that count a piece, each with the content that another row brought."""
    counted = rows.filter(rows.column("size").is_valid())
    brought = rows.filter(rows.column("content").is_valid())
    at = dict(zip(brought.column("piece").to_pylist(), range(brought.num_rows)))
    order = pa.array([at[p] for p in counted.column("piece").to_pylist()], pa.int64())
    return counted.set_column(counted.schema.get_field_index("content"), "content", brought.column("content").take(order))


def _runs(rows: pa.RecordBatch, equal: Equal, schema: pa.Schema) -> pa.RecordBatch:
    """The runs of the pieces of some anchors. ``equal`` names the class of each window."""
    rows = _joined(rows)
    if not rows.num_rows:
        return pa.RecordBatch.from_pylist([], schema=schema)
    windows = rows.column("windows").to_numpy().astype(np.int64)
    piece = np.repeat(np.arange(len(windows)), windows)
    at = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    label = equal(rows.column("content").to_pylist(), windows)
    size, least = np.zeros(label.max() + 1, np.int64), np.full(label.max() + 1, NO_ID)
    np.add.at(size, label, rows.column("size").to_numpy()[piece])
    np.minimum.at(least, label, rows.column("id").to_numpy()[piece])
    use = size[label] > 1
    piece, at, least = piece[use], at[use], least[label[use]]
    begin = np.ones(len(piece), bool)
    begin[1:] = (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])
    first = np.flatnonzero(begin)
    runs = pa.StructArray.from_arrays([pa.array(at[first], pa.int32()), pa.array(np.diff(np.append(first, len(piece))), pa.int32()), pa.array(least[first])], fields=list(RUN))
    owner, counts = np.unique(piece[first], return_counts=True)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), runs)
    return pa.RecordBatch.from_arrays([rows.column("anchor").take(pa.array(owner)), rows.column("piece").take(pa.array(owner)), lists], schema=schema)


def split_large(many: DataFrame, shape: Shape, cuts: Callable[[bytes], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The runs of pieces under large anchors, by the 128-bit hash of each window."""
    schema = pa.schema([("anchor", pa.int64()), ("piece", pa.int64()), ("at", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("size", pa.int64()), ("id", pa.int64())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                begin, end = cuts(row["content"])
                raw = [xxhash.xxh128_digest(row["content"][begin[i]:end[i + shape.window - 1]]) for i in range(row["windows"])]
                both = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
                n = len(raw)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["anchor"]] * n, pa.int64()), pa.array([row["piece"]] * n, pa.int64()), pa.array(range(n), pa.int32()),
                    pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array([row["size"]] * n, pa.int64()), pa.array([row["id"]] * n, pa.int64())], schema=schema)

    each = many.mapInArrow(run, "anchor long, piece long, at int, h1 long, h2 long, size long, id long")
    each = cut(each, "windows")
    total = each.groupBy("h1", "h2").agg(F.sum("size").alias("all"), F.min("id").alias("least")).where("`all` > 1")
    runs = each.join(total, ["h1", "h2"]).groupBy("anchor", "piece").agg(
        F.sort_array(F.collect_list(F.struct("at", F.lit(1).alias("n"), F.col("least").alias("id")))).alias("runs"))
    return runs.select("anchor", "piece", "runs")


def spans(found: DataFrame, runs: DataFrame, grouped: DataFrame) -> DataFrame:
    """``(id, row, at, n, least)``: per occurrence of a piece, the runs of its windows that are repeated."""
    sized = runs.join(grouped.select("anchor", "piece", "size"), ["anchor", "piece"])
    joined = broadcast_hot(found.select("id", "row", "start", "anchor", "piece"), cut(sized, "runs"), ["anchor", "piece"], "size")
    return joined.select("id", "row", "start", F.explode("runs").alias("r")).select(
        "id", "row", (F.col("start") + F.col("r.at")).alias("at"), F.col("r.n").alias("n"), F.col("r.id").alias("least"))


def with_spans(docs: DataFrame, doc_id: str, text: str, found: DataFrame) -> DataFrame:
    """``(doc_id, text, spans)`` per row of ``docs``: the spans ``(at, n)`` of ``found(id, row, at, n)``."""
    per_row = found.groupBy("id", "row").agg(F.array_distinct(F.collect_list(F.struct("at", "n"))).alias("spans"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), row_key(text).alias("_row"))
    return rows.join(per_row, rows["doc_id"].eqNullSafe(per_row["id"]) & (rows["_row"] == per_row["row"]), "left").select("doc_id", "text", "spans")


def covered(n: int, spans: list[dict] | None, window: int) -> np.ndarray:
    """Which of ``n`` elements the windows of the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        edge[s["at"]] += 1
        edge[s["at"] + s["n"] - 1 + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def in_groups(work: Callable[[pa.RecordBatch], pa.RecordBatch], target: int):
    """A ``mapInArrow`` function over rows sorted by anchor: gathers whole anchors with about ``target``
    bytes and hands them to ``work``."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < target:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            anchor = whole.column("anchor").to_numpy()
            change = np.flatnonzero(np.diff(anchor)) + 1
            if len(change):
                yield from pieces_of(whole.slice(0, int(change[-1])))
                whole = whole.slice(int(change[-1]))
            held, size = [whole], whole.nbytes if whole.num_rows else 0
        if held and (rows := pa.Table.from_batches(held).combine_chunks().to_batches()):
            yield from pieces_of(rows[0])

    def pieces_of(rows: pa.RecordBatch):
        anchor = rows.column("anchor").to_numpy()
        begin = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1, [len(anchor)]])
        per = max(1, int(rows.num_rows * target / max(rows.nbytes, 1)))
        lo = 0
        while lo < len(anchor):  # whole anchors, about ``target`` bytes
            hi = int(begin[np.searchsorted(begin, min(lo + per, len(anchor)))])
            yield work(rows.slice(lo, hi - lo))
            lo = hi

    return run
