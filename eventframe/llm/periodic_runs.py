"""Periodic runs of words: recursive frequency splitting, then a scan of lags.

A run is a stretch of consecutive words with smallest period ``q`` and at least ``max(6, 4 * q)`` words that
no neighbouring word extends. So every word of a run occurs at least four times in it. Splitting: a word that
occurs under four times in its segment can be in no run there, so it splits the segment; the parts are
counted anew until nothing splits. Scan: what is left is searched for lags. For periods from ``2**t`` to
below ``2**(t + 1)``, equal runs of ``2**(t + 1)`` words are numbered (each scale from the one before); two
neighbouring places of one number at such a distance lie in a repetition of exactly that smallest period, which
is then extended word by word to both sides. Each scale costs one sort, so a segment of ``m`` words takes
about ``m log(m)**2`` steps, not ``m * m / 4`` comparisons.

Every text is handled whole in one task, beside others in batches of a few MB; no rows are shuffled. A text
takes about 100 bytes of memory for each of its words while it is scanned.

Defined cases: a null or empty text, or one of white space only, has no words and no run; words are bytes
between ``[\\x20\\x09-\\x0D]``, compared as they are; repeated rows, null identifiers and ties give one row
each; an empty table gives none; other columns of the input are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventframe.llm.common import slices, table

#: A run has at least this many words and this many periods.
WORDS, TIMES = 6, 4
#: Rounds of splitting over all texts of a batch at once; segments that still split go on one by one.
_ROUNDS = 8
_BATCH = 4 << 20
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.binary())])


def _pieces(pos: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, as indices into ``pos``, of stretches of neighbouring positions of one segment."""
    if not len(pos):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lo = np.flatnonzero(np.concatenate([[True], (np.diff(pos) != 1) | (np.diff(seg) != 0)]))
    return lo, np.append(lo[1:], len(pos))


def split(codes: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """The segments (from, to) of at least ``WORDS`` words in which every word occurs ``TIMES`` times or more.

    ``codes`` are the words of texts one after another, ``starts`` the places where a text starts.
    """
    pos = np.arange(len(codes))
    seg = np.searchsorted(starts, pos, side="right")
    base = int(codes.max()) + 1 if len(codes) else 1
    done: list[tuple[int, int]] = []
    for _ in range(_ROUNDS):
        if not len(pos):
            return done
        _, which, count = np.unique(seg * base + codes[pos], return_inverse=True, return_counts=True)
        rare = count[which] < TIMES
        splits = np.zeros(int(seg[-1]) + 1, bool)
        splits[seg[rare]] = True
        stable = ~splits[seg]
        done += _spans(pos[stable], seg[stable])
        keep = ~rare & ~stable
        pos, seg = pos[keep], seg[keep]
        lo, hi = _pieces(pos, seg)
        long = hi - lo >= WORDS
        seg = np.repeat(np.arange(len(lo)), hi - lo)
        inside = np.repeat(long, hi - lo)
        pos, seg = pos[inside], seg[inside]
    for a, b in _spans(pos, seg):
        done += _settle(codes, a, b)
    return done


def _spans(pos: np.ndarray, seg: np.ndarray) -> list[tuple[int, int]]:
    lo, hi = _pieces(pos, seg)
    return [(a, b) for a, b in zip(pos[lo].tolist(), (pos[hi - 1] + 1).tolist()) if b - a >= WORDS]


def _settle(codes: np.ndarray, start: int, end: int) -> Iterator[tuple[int, int]]:
    """``split`` of one segment by a list of open parts. After a split the longest part looks only at the words
    that it lost, the others at all of theirs, so a word is looked at about log(length) times."""
    order = np.argsort(codes[start:end], kind="stable") + start
    words, first = np.unique(codes[order], return_index=True)
    places = dict(zip(words.tolist(), (p.tolist() for p in np.split(order, first[1:]))))
    open_ = [(start, end, set(places))]
    while open_:
        a, b, check = open_.pop()
        cuts: list[int] = []
        for w in check:
            p = places[w]
            i = bisect_left(p, a)
            few = p[i:i + TIMES]
            if few and (len(few) < TIMES or few[-1] >= b):
                cuts += [x for x in few if x < b]
        if not cuts:
            yield a, b
            continue
        ends = [a - 1, *sorted(cuts), b]
        parts = [(x + 1, y) for x, y in zip(ends, ends[1:]) if y - x > WORDS]
        longest = max(parts, key=lambda s: s[1] - s[0], default=None)
        for part in parts:
            rest = [codes[a:part[0]], codes[part[1]:b]] if part == longest else [codes[part[0]:part[1]]]
            open_.append((*part, set(np.concatenate(rest).tolist())))


def scan(codes: np.ndarray, segments: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs within ``segments``."""
    found = []
    segments = sorted(segments)
    number = codes
    width, period = 1, 1
    while segments := [s for s in segments if s[1] - s[0] >= max(WORDS, TIMES * period)]:
        # ``number[i]`` names the ``width`` words from i on; put two of them together
        at = np.concatenate([np.arange(a, b - 2 * width + 1) for a, b in segments])
        pair = number[at].astype(np.int64) * (int(number.max()) + 1) + number[at + width]
        order = np.argsort(pair, kind="stable")
        same = np.diff(pair[order]) == 0
        here, there = at[order[:-1]][same], at[order[1:]][same]
        gap = there - here
        fits = (gap >= period) & (gap < 2 * period)
        here, gap = here[fits], gap[fits]
        order_here = np.lexsort((here, gap))
        here, gap = here[order_here], gap[order_here]
        block = np.concatenate([[True], (np.diff(here) != 1) | (np.diff(gap) != 0)]) if len(here) else np.empty(0, bool)
        limits = np.array([a for a, _ in segments])
        for i, q in zip(here[block].tolist(), gap[block].tolist()):
            lo, hi = segments[int(np.searchsorted(limits, i, side="right")) - 1]
            start = i - _agree(codes[lo:i][::-1], codes[lo + q:i + q][::-1])
            end = i + q + _agree(codes[i:hi - q], codes[i + q:hi])
            if end - start >= max(WORDS, TIMES * q):
                found.append((start, end - start, q))
        number = np.zeros(len(codes), np.int64)
        number[at[order]] = np.concatenate([[0], np.cumsum(~same)])
        width, period = 2 * width, 2 * period
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the first entries of two arrays agree."""
    n, step, at = len(a), 64, 0
    while at < n:
        differ = np.flatnonzero(a[at:at + step] != b[at:at + step])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return n


def _batch(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    known: dict[bytes, int] = {}
    words = [(t.as_py() or b"").split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for own in words:
        for w in own:
            if w not in known:
                known[w] = len(known)
    codes = np.fromiter((known[w] for own in words for w in own), np.int64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    runs = scan(codes, split(codes, starts))
    gone = np.zeros(len(codes) + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    starts_of = np.array([r[0] for r in runs], np.int64)
    # a text without words starts where the next one does: the last text that starts there holds the run
    owner = np.searchsorted(starts, starts_of, side="right") - 1
    has = np.bincount(owner, minlength=len(words)) if len(runs) else np.zeros(len(words), np.int64)
    kept = [b" ".join(own) if not n else b" ".join([w for w, g in zip(own, gone[s:s + len(own)].tolist()) if not g])
            for own, n, s in zip(words, has.tolist(), starts.tolist())]
    flat = np.array(runs, np.int64).reshape(-1, 3)
    flat[:, 0] -= starts[owner] if len(runs) else 0
    rows = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(_RUN))
    offsets = pa.array(np.concatenate([[0], np.cumsum(has)]).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(sizes), pa.ListArray.from_arrays(offsets, rows, type=pa.list_(_RUN)), pa.array(kept, pa.binary())], schema=_SCHEMA)


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` per row: ``runs`` is an array of ``(start, length, period)`` by start,
    then period; ``collapsed`` the words, as binary and joined by one space, without those that any run contains
    after its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, _BATCH):
                yield _batch(part.column("doc_id"), part.column("text"))

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")


def _repeated(text: Column, h: Column) -> Column:
    """The contract's text with a tail that repeats: every word i >= a becomes word a + (i - a) % p."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size(words), F.floor(h / 10)
    a = (g % F.nullif(n, F.lit(0))).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    return F.coalesce(F.concat_ws(" ", F.slice(words, F.lit(1), a), tail), text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every row of ``documents``, with the digests of its contract."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    text = F.when(F.col("h") % 10 == 0, _repeated(F.col("text"), F.col("h"))).otherwise(F.col("text"))
    found = periodic_runs(docs.select("doc_id", text.alias("text")))
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    found = found.select("*", F.array_min(order).alias("best"), F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).alias("lines"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"), F.expr("(1000 * -best.l) div best.p").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
