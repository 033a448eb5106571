"""Class-based bigram scores with classes from exchange clustering.

Tokens are words with A-Z lowered, then one end token per text, before which every text also starts. Counts
of all training words are gathered in Spark. The words of the frequency list are put into classes by exchange:
given the counts of class pairs, each word's gain in likelihood from any other class is worked out from how
often each class precedes and follows it; a part of the words at a time, words move to the best one and the
counts are taken anew. If the likelihood falls, the move is undone and the parts are made smaller; it ends once
a turn over all words adds less than ``RISE`` of the rise so far. All other training words then get the class
that suits the classes of the listed words around them best; one without listed neighbours, and a word that
was never seen, gets the class of most words below the list (else: in the list) with a like ending. The
probability of a word is that of its class after the class before (smoothed with the classes' own frequency)
times that of the word in its class (``ALPHA`` added to each count, and one unseen word for each class).

All words of a batch of texts are found and hashed together (``words``). The training texts are written once as numbers of
their words, words below the list as symbols by their last bytes. A turn of the exchange is one pass over them: each task counts class pairs, and the classes around the words
that may move, in arrays of bounded size, and blocks of words add up those arrays. A few tasks then move the words,
frequent ones first, each with its own moves taken into the class pairs. Classes, class pairs and the frequency list are the model, bounded, and are broadcast. Words below
the list, an unbounded number, meet their counts and classes in shuffled joins, in scoring once for each piece of some
documents. With ``clustered`` given, only
so many words are exchanged and all others have a class by their last bytes.

Defined cases: null and empty texts are one end token; rows with a null identifier are scored and held out;
repeated rows are scored each and count each in training; without training rows all counts are 0; an empty
table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventframe.llm.common import by_batches, cut, slices, table
from eventframe.llm.words import words as words_of

CLASSES, SHAPES, RISE, ALPHA = 48, 16, 1e-3, 0.5
#: Words at most whose counts and classes are broadcast (about 20 bytes each).
FREQUENT = 1 << 18
#: The smallest parts in which words move are one of so many.
_PARTS = 32
#: Words that a task may hold before it sends their sums on.
_KEPT = 1 << 20
#: Bytes of text whose words are found at once, and whose scores are one row until the classes of unlisted words are known.
_AT_ONCE, _PIECE = 1 << 18, 2 << 20
#: Symbols at least in a run of the encoded texts (longer texts are one run).
_RUN = 1 << 16
#: Counts of classes around words that a task holds at most (4 bytes each).
_CELLS = 1 << 24
#: Counts around a word below this have their part of the likelihood looked up.
_FEW = 8
#: Tasks that move words at the same time; words of a lot have one part of so many of the text.
_MOVERS, _LOTS = 8, 512
#: Tasks that add up the counts of a turn.
_ADDERS = 24
_END = b" end"  # no word has a space


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), _END]


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 1, F.lit(True))


def key(word: bytes) -> int:
    """A word's 64-bit key as a signed number."""
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def shape(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word[-2:], 1) % SHAPES


@cache
def _shapes() -> np.ndarray:
    """The shape by a word's last two bytes, as ``words`` numbers them."""
    return np.array([shape(bytes([x & 255, x >> 8])) for x in range(1 << 16)] + [shape(bytes([x])) for x in range(256)], np.int8)


def sequence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, shapes, tokens of each text) of all tokens of the texts, one text after the other."""
    keys, last, many = words_of(texts)
    at = np.arange(len(keys)) + np.repeat(np.arange(len(many)), many)  # an end follows each text's words
    out = np.full(len(keys) + len(many), key(_END), np.int64), np.full(len(keys) + len(many), shape(_END), np.int8)
    out[0][at], out[1][at] = keys, _shapes()[last]
    return *out, many + 1


def _texts(batches):
    """The texts of each batch's first column, some at a time."""
    for batch in batches:
        for part in slices(batch, _AT_ONCE):
            yield part.column(0)


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, shape, n)`` over the column ``text``; a task adds up its words before they move."""
    schema = pa.schema([("word", pa.int64()), ("shape", pa.int32()), ("n", pa.int64())])

    def summed(held: list):
        n, word, of = map(np.concatenate, zip(*held))
        order = np.argsort(word)
        word, of, n = word[order], of[order], n[order]
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        return np.add.reduceat(n, first), word[first], of[first]

    def out(held: list):
        n, word, of = summed(held)
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(of, pa.int32()), pa.array(n)], schema=schema)

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        for part in _texts(batches):
            word, of, _ = sequence(part)
            held.append(summed([(np.ones(len(word), np.int64), word, of)]))
            if sum(len(h[0]) for h in held) > 2 * _KEPT:
                held = [summed(held)]
                if len(held[0][0]) > _KEPT:
                    yield out(held)
                    held = []
        if held:
            yield out(held)

    return texts.mapInArrow(run, "word long, shape int, n long").groupBy("word", "shape").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, Column]:
    """(words, counts, whether a row of ``counts`` is listed): all words with as high a count as lets at most
    ``most`` in, by falling count; if more share the highest, the first of them by key."""
    # different counts are few: k of them take at least k * k / 2 words of text
    sizes = counts.groupBy("n").agg(F.count("*").alias("words")).toPandas().sort_values("n", ascending=False)
    fits = sizes[sizes["words"].cumsum() <= most]
    if len(fits) or not len(sizes):
        listed = F.col("n") >= (int(fits["n"].iloc[-1]) if len(fits) else 0)
    else:
        first = counts.where(F.col("n") == int(sizes["n"].iloc[0])).orderBy("word").limit(most)
        listed = (F.col("n") == int(sizes["n"].iloc[0])) & (F.col("word") <= (first.agg(F.max("word")).first()[0]))
    top = counts.where(listed).select("word", "n").toPandas().sort_values(["n", "word"], ascending=[False, True])
    return top["word"].to_numpy(np.int64), top["n"].to_numpy(np.int64), listed


class Lookup:
    """Numbers of words by their keys: their place in the frequency list, or -1. Keys are hashes, so their first bits lead
    to a few sorted ones."""

    def __init__(self, words: np.ndarray):
        self.order = np.argsort(words, kind="stable")
        self.sorted = words[self.order]
        self.shift = np.uint64(64 - max(4, (2 * len(words)).bit_length()))
        first = np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift
        # signed keys in order are the unsigned ones with the first bit turned
        self.head = np.append(np.searchsorted(self.sorted, (first ^ np.uint64(1 << 63)).view(np.int64)), len(words)).astype(np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        top = ((keys.view(np.uint64) ^ np.uint64(1 << 63)) >> self.shift).view(np.int64)
        at, stop = self.head[top], self.head[top + 1]
        out = np.full(len(keys), -1, np.int64)
        live = np.flatnonzero(at < stop)
        while len(live):
            here = at[live]
            hit = self.sorted[here] == keys[live]
            out[live[hit]] = self.order[here[hit]]
            at[live] += 1
            live = live[~hit & (here + 1 < stop[live])]
        return out

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, numbers or ``-1 - shape``, tokens of each text) of all tokens of the texts."""
        keys, shapes, many = sequence(texts)
        found = self(keys)
        return keys, np.where(found < 0, -1 - shapes.astype(np.int64), found), many


def symbols(numbers: np.ndarray, shapes: np.ndarray, clustered: int) -> np.ndarray:
    """Clustered words by their number, others by ``clustered`` plus their shape; ``shapes`` has those of the
    frequency list."""
    return np.where(numbers < 0, clustered - 1 - numbers, np.where(numbers < clustered, numbers, clustered + shapes[np.maximum(numbers, 0)] if len(shapes) else 0))


def encoded(texts: DataFrame, words, shapes, clustered: int) -> DataFrame:
    """``(tokens)``: the symbols of all texts, one text after the other, as runs of 32-bit numbers. Each run ends with
    the end of a text, so the symbol before its first is its last."""
    schema = pa.schema([("tokens", pa.binary())])

    def out(held: list[np.ndarray]):
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], schema=schema)

    def run(batches):
        lookup, held, many = Lookup(words.value), [], 0
        for part in _texts(batches):
            held.append(symbols(lookup.numbers(part)[1], shapes.value, clustered).astype(np.int32))
            many += len(held[-1])
            if many >= _RUN:
                yield out(held)
                held, many = [], 0
        if held:
            yield out(held)

    return texts.mapInArrow(run, "tokens binary")


def _nlogn(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(pairs: np.ndarray) -> float:
    """The part of the class bigram likelihood that depends on the classes."""
    return float(_nlogn(pairs).sum() - _nlogn(pairs.sum(0)).sum() - _nlogn(pairs.sum(1)).sum())


def best_classes(now: np.ndarray, before: np.ndarray, after: np.ndarray, pairs: np.ndarray, classes: int) -> np.ndarray:
    """The class in which each word fits best: rows of ``before`` and ``after`` count the classes around it,
    ``pairs`` all class pairs, the word in class ``now``."""
    pairs, before, after = (x.astype(np.float64) for x in (pairs, before, after))
    own = np.flatnonzero(now < classes)
    into, out_of = pairs.sum(0)[:classes] - after[:, :classes], pairs.sum(1)[:classes] - before[:, :classes]
    n, m = before.sum(1, keepdims=True), after.sum(1, keepdims=True)
    into[own, now[own]] -= n[own, 0]
    out_of[own, now[own]] -= m[own, 0]
    into, out_of = np.maximum(into, 0), np.maximum(out_of, 0)
    gain = _nlogn(into) - _nlogn(into + n) + _nlogn(out_of) - _nlogn(out_of + m)
    for around, other, cells in ((after, before, pairs[:classes].T), (before, after, pairs[:, :classes])):
        # most counts around a word are small: what they add is looked up
        few = np.stack([_nlogn(cells + k) - _nlogn(cells) for k in range(_FEW)])
        rows, beside = np.nonzero(around)
        for lo in range(0, len(rows), 20_000):
            r, j = rows[lo:lo + 20_000], beside[lo:lo + 20_000]
            count = around[r, j]
            rise = few[np.minimum(count, _FEW - 1).astype(np.int64), j]
            at = np.flatnonzero(count >= _FEW)
            rise[at] = _added(cells[j[at]], count[at, None])
            at = np.flatnonzero(now[r] < classes)  # the counts without the word itself
            rise[at, now[r[at]]] = _added(cells[j[at], now[r[at]]] - count[at], count[at])
            at = np.flatnonzero(now[r] == j)
            there = cells[j[at]] - other[r[at], :classes]
            there[np.arange(len(at)), j[at]] -= count[at]
            rise[at] = _added(there, count[at, None])
            first = np.append(0, np.flatnonzero(np.diff(r)) + 1)
            gain[r[first]] += np.add.reduceat(rise, first)
    best = gain.argmax(1)
    rows = np.arange(len(now))
    stay = own[gain[own, best[own]] <= gain[own, now[own]] + 1e-9]
    best[stay] = now[stay]
    return best


def _added(there: np.ndarray, count: np.ndarray) -> np.ndarray:
    there = np.maximum(there, 0)
    return _nlogn(there + count) - _nlogn(there)


def place(around: DataFrame, counts: np.ndarray, classes: int) -> DataFrame:
    """``(word, class, n)`` of the classes around words, ``(word, code, n)``: the best class of each word (``n`` null), and
    without a word the counts ``n`` of class pairs (first times all classes plus second, as ``class``) that this makes."""
    schema = pa.schema([("word", pa.int64()), ("class", pa.int32()), ("n", pa.int64())])
    total = len(counts)

    def out(word, of, n):
        none = pa.nulls(len(of), pa.int64())
        return pa.RecordBatch.from_arrays([none if word is None else pa.array(word), pa.array(of, pa.int32()), none if n is None else pa.array(n)], schema=schema)

    def run(batches):
        held, pairs = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)], np.zeros(total * total, np.int64)

        def move(word, code, n):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            for lo in range(0, len(first), 4_000):
                rows = len(first[lo:lo + 4_000])
                a, b = first[lo], first[lo + 4_000] if lo + 4_000 < len(first) else len(word)
                row = np.repeat(np.arange(rows), np.diff(np.append(first[lo:lo + 4_000], b)))
                side, of = np.divmod(code[a:b], total)
                sides = np.bincount((side * rows + row) * total + of, n[a:b], 2 * rows * total).reshape(2, rows, total)
                best = best_classes(np.full(rows, total), sides[0], sides[1], counts, classes)
                np.add.at(pairs, np.where(side == 0, of * total + best[row], best[row] * total + of), n[a:b])
                yield out(word[first[lo:lo + 4_000]], best, None)

        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy().astype(np.int64)]) for i, h in enumerate(held)]
            end = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if end:  # the last word may go on in the next batch
                yield from move(*(h[:end] for h in held))
                held = [h[end:] for h in held]
        if len(held[0]):
            yield from move(*held)
        at = np.flatnonzero(pairs)
        yield out(None, at, pairs[at])

    rows = around.select(F.col("word").cast("long").alias("word"), F.col("code").cast("int").alias("code"), F.col("n").cast("long").alias("n"))
    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word long, class int, n long")


_BLOCKS = pa.schema([("block", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])


def _block(b: int, sums: np.ndarray) -> pa.RecordBatch:
    """A row of the cells that aren't 0; the counts are as narrow as their highest lets them be."""
    at = np.flatnonzero(sums)
    counts = sums[at]
    counts = counts.astype(np.min_scalar_type(counts.max(initial=0)))
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((b, at.astype(np.uint16).tobytes(), counts.tobytes()), _BLOCKS)], schema=_BLOCKS)


def _counts(cells: np.ndarray, counts) -> np.ndarray:
    """The counts of a row, whose width shows from the number of its cells."""
    return np.frombuffer(counts, f"u{len(counts) // max(1, len(cells)) or 1}")


def _cells(batches):
    """``(block, cells, counts)`` of each row."""
    for batch in batches:
        for b, cells, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            cells = np.frombuffer(cells.as_buffer(), np.uint16)
            yield b, cells, _counts(cells, memoryview(counts.as_buffer()))


def look(runs: DataFrame, of: np.ndarray, clustered: int, total: int, parts: int, part: int) -> tuple[np.ndarray, DataFrame]:
    """(counts of class pairs, ``(block, cells, counts)``): one pass over the symbols. A block has the counts of the
    classes before and after each of some hundred words; words go to ``parts`` parts in turn, and only those of one
    are counted. A task adds up its own counts, at most ``2 * total`` for each word of the part, before they move."""
    shared = runs.sparkSession.sparkContext.broadcast(of)
    wide = 2 * total
    size = (1 << 16) // wide * wide
    words = max(clustered - part + parts - 1, 0) // parts

    def count(batches):
        of, one = shared.value, np.int32(1)  # of the sums' own type: others are added ten times slower
        around, pairs = np.zeros(-(-words * wide // size) * size, np.int32), np.zeros(total * total, np.int64)
        for batch in batches:
            for run in batch.column(0):
                s = np.frombuffer(run.as_buffer(), np.int32)
                c = of[s]
                before = np.append(c[-1:], c[:-1])
                pairs += np.bincount(before * total + c, minlength=total * total)
                at = np.flatnonzero((s & (parts - 1) == part) & (s < clustered))  # parts double, so they are a power of 2
                row = (s[at] // parts).astype(np.int64) * wide
                np.add.at(around, row + before[at], one)
                np.add.at(around, row + total + np.append(c[1:], c[:1])[at], one)
        yield _block(-1, pairs)
        blocks = around.reshape(-1, size)
        for b in np.flatnonzero(blocks.any(1)).tolist():
            yield _block(b, blocks[b])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b, cells, counts in _cells(batches):
            if b not in sums:
                sums[b] = np.zeros(total * total if b < 0 else size, np.int64)
            sums[b][cells] += counts.astype(np.int64)  # the cells of a row are different
        for b in sums:
            yield _block(b, sums[b])

    schema = "block int, cells binary, counts binary"
    # blocks are bounded in number, so a bounded number of tasks adds them up
    found = cut(runs.mapInArrow(count, schema).repartition("block").coalesce(_ADDERS).mapInArrow(add, schema), "contexts")
    pairs = np.zeros(total * total, np.int64)
    for r in found.where("block = -1").collect():  # one row, or none of an empty table
        cells = np.frombuffer(bytes(r["cells"]), np.uint16)
        pairs[cells] = _counts(cells, bytes(r["counts"]))
    shared.unpersist()
    return pairs.reshape(total, total), found.where("block >= 0")


def exchanged(blocks: DataFrame, of: np.ndarray, pairs: np.ndarray, classes: int, clustered: int, parts: int, part: int) -> np.ndarray:
    """``of`` with the words of the blocks in their best classes. A task takes its words from frequent to rare, few at a
    time by their share of the text, and each lot meets the class pairs as the lots before it have left them."""
    shared = blocks.sparkSession.sparkContext.broadcast((of, pairs))
    schema = pa.schema([("word", pa.int64()), ("class", pa.int32())])
    total = len(pairs)
    size = (1 << 16) // (2 * total)

    def move(batches):
        of, pairs = shared.value
        pairs = pairs.copy()
        lot = pairs.sum() // _LOTS + 1
        for b, cells, counts in _cells(batches):
            words = (b * size + np.arange(size)) * parts + part
            words = words[words < clustered]
            sides = np.zeros(size * 2 * total, np.int64)
            sides[cells] = counts
            sides = sides.reshape(size, 2, total)[:len(words)]
            now = of[words]
            best = now.copy()
            mass = np.cumsum(sides[:, 0].sum(1))
            ends = np.unique(np.append(np.flatnonzero(np.diff(mass // lot)) + 1, len(words)))
            for lo, hi in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
                before, after = sides[lo:hi, 0], sides[lo:hi, 1]
                best[lo:hi] = best_classes(now[lo:hi], before, after, pairs, classes)
                at = np.flatnonzero(best[lo:hi] != now[lo:hi])
                for sign, to in ((-1, now[lo:hi][at]), (1, best[lo:hi][at])):
                    np.add.at(pairs, to, sign * after[at])
                    np.add.at(pairs.T, to, sign * before[at])
                pairs = np.maximum(pairs, 0)  # a word's own pairs with words of its class are met twice
            at = np.flatnonzero(best != now)
            yield pa.RecordBatch.from_arrays([pa.array(words[at], pa.int64()), pa.array(best[at], pa.int32())], schema=schema)

    dealt = blocks.repartition(_MOVERS, F.col("block") % _MOVERS).coalesce(_MOVERS).sortWithinPartitions("block")
    moved = dealt.mapInArrow(move, "word long, class int").toPandas()  # at most one row per word of the part
    shared.unpersist()
    of = of.copy()
    of[moved["word"].to_numpy(np.int64)] = moved["class"].to_numpy(np.int64)
    return of


def exchange(runs: DataFrame, clustered: int, classes: int = CLASSES, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(class of each symbol, counts of class pairs). Symbols from ``clustered`` on keep a class each; without
    ``rounds``, words move until the likelihood stops rising."""
    total = classes + SHAPES
    best = np.concatenate([np.arange(clustered) % classes, classes + np.arange(SHAPES)])
    parts, part, turn = 2, 0, 0
    while clustered * 2 * total > parts * _CELLS:
        parts *= 2
    most_parts = max(parts, _PARTS)
    counts, blocks = look(runs, best, clustered, total, parts, 0)
    start = before = most = likelihood(counts)
    while clustered and (rounds is None or turn < rounds):
        of = exchanged(blocks, best, counts, classes, clustered, parts, part)
        turn, part = turn + 1, part + 1
        new, ahead = look(runs, of, clustered, total, parts, part % parts)
        value = likelihood(new)
        if value >= most:
            best, counts, most, blocks = of, new, value, ahead
        elif parts < most_parts:
            parts, part, before = 2 * parts, 0, most
            blocks = look(runs, best, clustered, total, parts, 0)[1]
        else:
            blocks = look(runs, best, clustered, total, parts, part % parts)[1]
        if part == parts:
            if most - before <= RISE * (most - start):
                break
            part, before = 0, most
    return best, counts


@dataclass
class Model:
    """Frequent words with their counts, classes, and the logarithms that scores add up."""

    words: np.ndarray
    counts: np.ndarray
    shapes: np.ndarray
    clustered: int
    of: np.ndarray  # class of each symbol
    steps: np.ndarray  # log10 of class after class
    mass: np.ndarray  # log10 of each class's total with the smoothing
    tokens: int
    distinct: int
    rest: DataFrame | None = None  # (word, n, class): the words that aren't listed


def _loose(numbers: np.ndarray) -> np.ndarray:
    """Where the second of neighbours is of which at least one isn't listed. The token before a text's first is the end of
    the text before, which is like its own."""
    listed = numbers >= 0
    return np.flatnonzero(~(listed & np.append(listed[-1:], listed[:-1])))


def loose_pairs(texts: DataFrame, words, shapes, of, total: int) -> DataFrame:
    """``(word, code, other, n)``: neighbours of which at least one isn't listed. If one is, ``code`` is the class of the
    listed one, plus the number of classes if it comes second; if none is, ``other`` is the second's key. A task adds up
    its own, so rows may be alike."""
    schema = pa.schema([("word", pa.int64()), ("code", pa.int32()), ("other", pa.int64()), ("n", pa.int64())])

    def out(held):
        word, code, other = map(np.concatenate, zip(*held))
        order = np.lexsort((code, other, word))
        word, code, other = word[order], code[order], other[order]
        first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (code[1:] != code[:-1]) | (other[1:] != other[:-1])))
        n = np.diff(np.append(first, len(word)))
        word, code, other = word[first], code[first], other[first]
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(code, mask=code < 0), pa.array(other, mask=code >= 0), pa.array(n)], schema=schema)

    def run(batches):
        lookup, held = Lookup(words.value), []
        for part in _texts(batches):
            keys, numbers, _ = lookup.numbers(part)
            own = of.value[symbols(numbers, shapes.value, len(words.value))]
            b = _loose(numbers)
            a = b - 1
            here, there = numbers[a] >= 0, numbers[b] >= 0  # at most one of them
            code = np.where(here, own[a], np.where(there, own[b] + total, -1)).astype(np.int32)
            held.append((np.where(here, keys[b], keys[a]), code, np.where(here | there, 0, keys[b])))
            if sum(len(h[0]) for h in held) > _KEPT // 2:
                yield out(held)
                held = []
        if sum(len(h[0]) for h in held):
            yield out(held)

    return texts.mapInArrow(run, "word long, code int, other long, n long")


def _meet(rows: DataFrame, words: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join with a table that grows with the words below the list: both sides are shuffled, at any size. Spark guesses
    sizes from files and kinds of columns, and takes an exploded list for one value, so by itself it may broadcast
    millions of words from the driver."""
    return rows.join(words.hint("merge"), key, how)


def place_rest(texts: DataFrame, rest: DataFrame, words, shapes, of: np.ndarray, pairs: np.ndarray, classes: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(rest with classes, the class of unseen words by shape, counts of class pairs of all words)."""
    sc, total = texts.sparkSession.sparkContext, len(pairs)
    unseen = of[-SHAPES:].copy()
    if not len(words.value):
        return rest.withColumn("class", F.col("shape") + classes), unseen, pairs
    listed = np.zeros((SHAPES, classes), np.int64)
    np.add.at(listed, (shapes.value, of[:-SHAPES]), 1)
    unseen = np.where(listed.any(1), listed.argmax(1), listed.sum(0).argmax())
    if rest.isEmpty():
        return rest.withColumn("class", F.col("shape") + classes), unseen, pairs
    loose = cut(loose_pairs(texts, words, shapes, sc.broadcast(of), total), "loose-pairs")
    near = cut(place(loose.where("code is not null"), pairs, classes), "near")
    placed = cut(_meet(rest, near.where("word is not null").select("word", "class"), "word", "left"), "placed")
    for r in placed.where("class is not null").groupBy("shape", "class").agg(F.count("*").alias("n")).groupBy("shape").agg(
            F.max(F.struct("n", (-F.col("class")).alias("neg"))).alias("most")).select("shape", (-F.col("most.neg")).alias("class")).collect():
        unseen[r["shape"]] = r["class"]
    by_shape = F.array(*(F.lit(int(c)) for c in unseen))
    rest = cut(placed.withColumn("class", F.coalesce("class", by_shape[F.col("shape")])), "rest")
    out = np.zeros_like(pairs)
    out[:classes, :classes] = pairs[:classes, :classes]
    for r in near.where("word is null").groupBy("class").agg(F.sum("n").alias("n")).collect():  # at most all pairs of classes
        out[divmod(r["class"], total)] += r["n"]
    both = loose.where("code is null").select("word", "other", "n")
    for side in ("word", "other"):
        both = _meet(both, rest.select(F.col("word").alias(side), F.col("class").alias("class_" + side)), side)
    for r in both.groupBy("class_word", "class_other").agg(F.sum("n").alias("n")).collect():
        out[r["class_word"], r["class_other"]] += r["n"]
    return rest, unseen, out


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = FREQUENT, clustered: int | None = None,
        classes: int = CLASSES, rounds: int | None = None) -> Model:
    """Learn from the rows that aren't held out."""
    spark = docs.sparkSession
    texts = docs.where(~held_out(doc_id)).select(F.col(text).cast("string").alias("text"))
    counts = cut(word_counts(texts), "words")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words, number, listed = frequent(counts, most)
    by_word = counts.where(listed).select("word", "shape").toPandas().set_index("word")["shape"]  # at most ``most`` rows
    shapes = by_word.reindex(words).to_numpy(np.int64) if len(words) else np.empty(0, np.int64)
    every = clustered is None
    clustered = len(words) if every else min(clustered, len(words))
    sent = spark.sparkContext.broadcast(words), spark.sparkContext.broadcast(shapes)
    of, class_pairs = exchange(cut(encoded(texts, *sent, clustered), "symbols"), clustered, classes, rounds)
    rest = counts.where(~listed).select("word", "shape", "n")
    if every:
        rest, unseen, class_pairs = place_rest(texts, rest, *sent, of, class_pairs, classes)
        of = np.concatenate([of[:clustered], unseen])
    else:
        rest = rest.withColumn("class", F.col("shape") + classes)
    # totals and distinct words by class
    total, kinds = np.zeros(classes + SHAPES), np.zeros(classes + SHAPES)
    own = of[symbols(np.arange(len(words)), shapes, clustered)]
    np.add.at(total, own, number)
    np.add.at(kinds, own, 1)
    for r in rest.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        total[r["class"]] += r["n"]
        kinds[r["class"]] += r["v"]
    own = (total + ALPHA) / (total + ALPHA).sum()
    weight = len(own)
    steps = (class_pairs + weight * own) / (class_pairs.sum(1, keepdims=True) + weight)
    mass = np.log10(total + ALPHA * (kinds + 1))
    return Model(words, number, shapes, clustered, of, np.log10(steps), mass, int(n), int(v), rest.select("word", "n", "class"))


#: Documents whose scores wait for the classes of unlisted words: sums of each, then its neighbours of which one isn't
#: listed, as places among ``words`` (or -1) and classes, and the classes that the words have if training had none.
_PIECES = pa.schema([("doc_id", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())),
                     ("score", pa.list_(pa.float64())), ("pairs", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("unseen", pa.binary()),
                     ("a", pa.binary()), ("b", pa.binary()), ("ca", pa.binary()), ("cb", pa.binary())])


def _sums(values: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The sums of so many values each, in order."""
    return np.bincount(np.repeat(np.arange(len(many)), many), values, len(many))


def _piece(ids: pa.Array, texts: pa.Array, m: Model, lookup: Lookup, logs: np.ndarray) -> pa.RecordBatch:
    """The row of ``_PIECES`` of some documents."""
    keys, numbers, many = lookup.numbers(texts)
    of = m.of[symbols(numbers, m.shapes, m.clustered)]
    often, prior = numbers >= 0, np.append(of[-1:], of[:-1])
    both = often & np.append(often[-1:], often[:-1])
    counted = _sums(np.where(often, logs[np.maximum(numbers, 0)] if len(logs) else 0.0, 0.0), many)
    value = np.where(both, m.steps[prior, of], 0.0) - np.where(often, m.mass[of], 0.0)
    second = _loose(numbers)
    rare = np.flatnonzero(~often)
    words, first = np.unique(keys[rare], return_index=True)
    place = np.full(len(keys), -1, np.int32)
    place[rare] = np.searchsorted(words, keys[rare])
    loose = np.zeros(len(keys), np.int64)
    loose[second] = 1
    done = {"doc_id": ids, "n_tokens": many, "known": _sums(often, many).astype(np.int64), "base": counted - many * np.log10(m.tokens + ALPHA * (m.distinct + 1)),
            "score": counted + _sums(value, many), "pairs": _sums(loose, many).astype(np.int64), "words": words, "unseen": of[rare[first]].astype(np.int16),
            "a": place[second - 1], "b": place[second], "ca": prior[second].astype(np.int16), "cb": of[second].astype(np.int16)}
    return pa.RecordBatch.from_arrays(
        [pa.array([x.tobytes()], f.type) if pa.types.is_binary(f.type) else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, f.type.value_type))
         for f, x in ((f, done[f.name]) for f in _PIECES)], schema=_PIECES)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row."""
    rest, model = model.rest, Model(**{**vars(model), "rest": None})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def begin(batches):
        m = shared.value
        lookup, logs = Lookup(m.words), np.log10(m.counts + ALPHA)
        for batch in batches:
            for part in slices(batch, _PIECE):
                yield _piece(part.column(0), part.column(1), m, lookup, logs)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.mapInArrow(begin, "doc_id array<long>, n_tokens array<long>, known array<long>, base array<double>, score array<double>, pairs array<long>, "
                                  "words array<long>, unseen binary, a binary, b binary, ca binary, cb binary")
    rows = cut(rows.withColumn("piece", F.monotonically_increasing_id()), "scored")
    found = _meet(rows.select("piece", F.explode("words").alias("word")), rest, "word").groupBy("piece").agg(F.collect_list(F.struct("word", "class", "n")).alias("found"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    steps, mass = model.steps, model.mass

    def end(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                flat = {f.name: row.column(f.name).flatten().to_numpy() for f in _PIECES if pa.types.is_list(f.type) and f.name != "doc_id"}
                of, n, seen = np.frombuffer(row.column("unseen")[0].as_py(), np.int16).astype(np.int64), np.zeros(len(flat["words"])), np.zeros(len(flat["words"]), bool)
                if row.column("found").null_count == 0:
                    word, class_, times = (x.to_numpy() for x in row.column("found").flatten().flatten())
                    at = np.searchsorted(flat["words"], word)
                    of[at], n[at], seen[at] = class_, times, True
                a, b = (np.frombuffer(row.column(c)[0].as_py(), np.int32) for c in "ab")
                ca, cb = (np.frombuffer(row.column(c)[0].as_py(), np.int16).astype(np.int64) for c in ("ca", "cb"))
                here = b >= 0
                if len(of):
                    ca, cb = np.where(a >= 0, of[a], ca), np.where(here, of[b], cb)
                    log, seen = np.where(here, np.log10(n + ALPHA)[b], 0.0), here & seen[b]
                else:
                    log, seen = np.zeros(0), np.zeros(0, bool)
                more = _sums(log, flat["pairs"])
                rise = _sums(steps[ca, cb] + log - np.where(here, mass[cb], 0.0), flat["pairs"])
                yield pa.RecordBatch.from_arrays(
                    [row.column("doc_id").flatten(), pa.array(flat["n_tokens"]), pa.array(flat["known"] + _sums(seen, flat["pairs"]).astype(np.int64)),
                     pa.array(flat["base"] + more), pa.array(flat["score"] + rise)], schema=schema)

    out = _meet(rows, found, "piece", "left").mapInArrow(end, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op10_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, scored by a model of four fifths of them, with its perplexity."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs))
    return found.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
