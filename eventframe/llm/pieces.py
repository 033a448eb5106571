"""SentencePiece byte-pair encoding with seeded merge-dropout, and lossless decoding.

The merges come from a public model file: two neighbouring symbols may merge if their join is a piece, the
best score first, the leftmost of equal ones. Every candidate is skipped for good with probability
``dropout``, decided by a keyed hash of the seed, the document and its place there; a skipped merge
leaves the shorter pieces, and pieces joined with a new neighbour are new candidates. Without dropout the
result is the library's own.

Candidates never reach over a change from other characters to a space, so a text is encoded in chunks (a
word with the spaces before it). Every occurrence has a key of its own, from the seed, the document's identifier
and the number of the chunk in the text. What a task remembers of a chunk are its pieces without dropout and the
candidates met on the way; only an occurrence that skips none of them reuses the pieces. Chunks of up to
``_SHORT`` characters advance together, one merge each at a time; longer ones use an agenda (a heap).

Characters without a piece, and a literal U+2581 (which stands for a space in pieces), become byte pieces;
decoding joins the pieces' bytes and takes the one space off the front that encoding had put there, so
every text comes back as it was.

Defined cases: null and empty texts have no pieces and decode to an empty text; a null identifier counts as
0 for the key; repeated rows give equal pieces; an empty table gives none; extra columns don't matter.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventframe.llm.common import bounded, by_batches, mix64, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 7
#: Chunks up to this length are segmented together.
_SHORT = 32
#: Segmentations that a task remembers.
_KEPT = 300_000
_NONE = np.iinfo(np.int32).max


@dataclass
class Vocabulary:
    """Tables of a model, small enough to broadcast: bounded by its number of pieces."""

    text: list[bytes]  # each piece as it decodes, a space for U+2581
    single: dict[str, int]
    keys: np.ndarray  # left id * size + right id of each possible merge, sorted
    joined: np.ndarray
    rank: np.ndarray  # lower is earlier; equal scores have equal ranks
    byte0: int

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        text, ids, score = [], {}, np.zeros(size)
        byte0 = model.piece_to_id("<0x00>")
        for i in range(size):
            piece = model.id_to_piece(i).replace("▁", " ")
            score[i] = model.get_score(i)
            if model.is_byte(i):
                text.append(bytes([i - byte0]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                text.append(b"")
            else:
                if re.search("[^ ] ", piece):
                    raise ValueError("a piece has a space after another character: chunks would cut it")
                text.append(piece.encode())
                ids[piece] = i
        rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)
        pairs = [(ids[p[:k]] * size + ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        pairs.sort()
        joined = np.array([i for _, i in pairs], np.int32)
        single = {p: i for p, i in ids.items() if len(p) == 1}
        return cls(text, single, np.array([k for k, _ in pairs], np.int64), joined, rank[joined], byte0)

    def apart(self) -> str:
        """White-space and marks that are in no longer piece, hence chunks of their own."""
        long = "".join(t.decode() for t in self.text[self.byte0 + 256:] if len(t.decode()) > 1)
        return "".join(c for c in "\n\t\r\x0b\x0c▁" if c not in long)


class Segmenter:
    """Segments chunks and remembers their pieces without dropout, with all candidates met."""

    def __init__(self, vocabulary: Vocabulary, dropout: float, seed: int):
        self.v, self.seed, self.size = vocabulary, seed, len(vocabulary.text)
        self.limit = np.uint64(min(max(dropout, 0.0), 1.0) * (2**64 - 2**11))
        self.single = np.full(0x110000, -1, np.int32)
        for c, i in vocabulary.single.items():
            self.single[ord(c)] = i
        self.single[0x2581] = -1
        apart = re.escape(vocabulary.apart())
        self.chunk = re.compile(f" *[^ {apart}]+| +|[{apart}]" if apart else " *[^ ]+| +")
        self.merge = dict(zip(vocabulary.keys.tolist(), zip(vocabulary.rank.tolist(), vocabulary.joined.tolist())))
        self._index(vocabulary.keys)
        self.bytes_at = np.concatenate([[0], np.cumsum([len(t) for t in vocabulary.text])])
        self.bytes = np.frombuffer(b"".join(vocabulary.text), np.uint8)
        self._forget()

    def _index(self, keys: np.ndarray) -> None:
        """An open hash table of the merges' keys, an eighth full: ``slot_key``, ``slot_place``."""
        self.bits = np.uint64(64 - max(3, (8 * len(keys)).bit_length()))
        self.slot_key = np.full(1 << int(64 - self.bits), -1, np.int64)
        self.slot_place = np.zeros(len(self.slot_key), np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.slot_key[slot] < 0
            self.slot_key[slot[free]], self.slot_place[slot[free]] = keys[left[free]], left[free]
            lost = self.slot_key[slot] != keys[left]
            left, slot = left[lost], (slot[lost] + 1) & (len(self.slot_key) - 1)

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).view(np.int64)

    def _find(self, pair: np.ndarray) -> np.ndarray:
        """The place of each pair of symbols among the merges, or -1."""
        slot = self._slot(pair)
        at = self.slot_key[slot]
        out = np.where(at == pair, self.slot_place[slot], -1)
        open_ = np.flatnonzero((at != pair) & (at >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.slot_key) - 1)
            at = self.slot_key[slot[open_]]
            hit = at == pair[open_]
            out[open_[hit]] = self.slot_place[slot[open_[hit]]]
            open_ = open_[~hit & (at >= 0)]
        return out

    def _forget(self):
        self.at: dict[str, int] = {}
        self.ids, self.start, self.length = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.met, self.met_start, self.met_length = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[str | None], variants: list[int], at_once: int = 1 << 18) -> list[np.ndarray]:
        """The piece ids of each text, by the key of each, found for about ``at_once`` characters at a time."""
        out: list[np.ndarray] = []
        part = np.cumsum([len(t or "") for t in texts]) // at_once if texts else np.empty(0, int)
        ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for a, b in zip([0, *ends], ends):
            chunks = [self.chunk.findall(" " + t) if t else [] for t in texts[a:b]]
            if len(self.at) > _KEPT:
                self._forget()
            if new := set().union(*chunks).difference(self.at):
                self._add(sorted(new, key=len))
            many = np.array([len(c) for c in chunks], np.int64)
            every = [c for own in chunks for c in own]
            index = np.fromiter(map(self.at.__getitem__, every), np.int64, len(every))
            start, length = self.start[index], self.length[index]
            ids = self.ids
            if self.limit and len(every):
                of = np.array([xxhash.xxh64_intdigest((int(v) & (2**64 - 1)).to_bytes(8, "little"), self.seed & (2**64 - 1)) for v in variants[a:b]], np.uint64)
                key = mix64(np.repeat(of, many) ^ mix64(_ranges(np.zeros(len(many), np.int64), many).astype(np.uint64)))
                again = self._any_skipped(index, key)
                fresh, first, length[again] = self._segment([every[i] for i in again.tolist()], key[again])
                start[again] = len(ids) + first
                ids = np.concatenate([ids, fresh])
            flat = ids[_ranges(start, length)]
            size = np.append(0, np.cumsum(length))[np.append(0, np.cumsum(many))]
            out += [flat[x:y] for x, y in zip(size[:-1].tolist(), size[1:].tolist())]
        return out

    def _any_skipped(self, index: np.ndarray, key: np.ndarray, at_once: int = 1 << 15) -> np.ndarray:
        """The occurrences (of the chunks ``index``) that skip a candidate met without dropout."""
        out = []
        for lo in range(0, len(index), at_once):
            i = index[lo:lo + at_once]
            many = self.met_length[i]
            row = np.repeat(np.arange(len(i)), many)
            skip = mix64(key[lo + row] ^ self.met[_ranges(self.met_start[i], many)]) < self.limit
            out.append(lo + np.unique(row[skip]))
        return np.concatenate(out)

    def _segment(self, chunks: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths) of occurrences with a key each."""
        ids, done = [np.empty(0, np.int32)], 0
        start, length = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(size, kind="stable")
        short = order[size[order] <= _SHORT]
        slow = order[size[order] > _SHORT].tolist()
        for lo in range(0, len(short), 20_000):
            at = short[lo:lo + 20_000]
            unknown = self._unknown([chunks[i] for i in at.tolist()])
            slow += at[unknown].tolist()
            at = at[~unknown]
            if len(at):
                found, many = self._together([chunks[i] for i in at.tolist()], keys[at])
                start[at], length[at] = done + np.cumsum(many) - many, many
                ids.append(found)
                done += len(found)
        for i in slow:
            ids.append(self._agenda(chunks[i], keys[i]))
            start[i], length[i] = done, len(ids[-1])
            done += len(ids[-1])
        return np.concatenate(ids), start, length

    def _unknown(self, chunks: list[str]) -> np.ndarray:
        """Whether a chunk has a character without a piece."""
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        missing = np.flatnonzero(self.single[codes] < 0)
        out = np.zeros(len(chunks), bool)
        if len(missing):
            ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
            out[np.searchsorted(ends, missing, side="right")] = True
        return out

    def _add(self, new: list[str]) -> None:
        plain, other = [], []
        for c in new:
            (plain if len(c) <= _SHORT else other).append(c)
        for lo in range(0, len(plain), 20_000):
            part = plain[lo:lo + 20_000]
            unknown = self._unknown(part)
            other += [c for c, u in zip(part, unknown) if u]
            good = [c for c, u in zip(part, unknown) if not u]
            if good:
                met: list[tuple[np.ndarray, np.ndarray]] = []
                ids, length = self._together(good, None, met)
                row, place = (np.concatenate(x) for x in zip(*met))
                self._keep(good, ids, length, place[np.argsort(row, kind="stable")], np.bincount(row, minlength=len(good)))
        if other:
            met_all: list[list[int]] = [[] for _ in other]
            ids = [self._agenda(c, None, m) for c, m in zip(other, met_all)]
            self._keep(other, np.concatenate(ids), np.array([len(i) for i in ids], np.int64),
                       np.array([p for m in met_all for p in m], np.uint64), np.array([len(m) for m in met_all], np.int64))

    def _keep(self, names: list[str], ids: np.ndarray, length: np.ndarray, met: np.ndarray, many: np.ndarray) -> None:
        base = len(self.length)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, ids])
        self.met_start = np.concatenate([self.met_start, len(self.met) + np.cumsum(many) - many])
        self.met_length = np.concatenate([self.met_length, many])
        self.met = np.concatenate([self.met, mix64(met)])
        self.at.update(zip(names, range(base, base + len(names))))

    def _key(self, chunk: str, variant: int) -> int:
        return xxhash.xxh64_intdigest(chunk.encode("utf-8", "surrogatepass"), self.seed * 1_000_003 + variant)

    @staticmethod
    def _place(left, middle, end):
        """A number for the merge of [left, middle) and [middle, end); arrays or numbers."""
        return np.asarray(left, np.uint64) << np.uint64(42) ^ np.asarray(middle, np.uint64) << np.uint64(21) ^ np.asarray(end, np.uint64)

    def _skipped(self, key, left, middle, end):
        """Whether the merge of [left, middle) and [middle, end) is dropped; arrays or numbers."""
        return mix64(np.atleast_1d(key ^ mix64(np.atleast_1d(self._place(left, middle, end))))) < self.limit

    def together(self, chunks: list[str], variant: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of short chunks whose characters all have a piece, keyed by chunk and variant."""
        return self._together(chunks, np.fromiter((self._key(c, variant) for c in chunks), np.uint64, len(chunks)))

    def _together(self, chunks: list[str], key: np.ndarray | None, met: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths), one merge of each chunk at a time; without keys nothing is skipped and ``met`` gets
        (row, place) of all candidates."""
        n, size = len(chunks), np.fromiter(map(len, chunks), np.int64, len(chunks))
        width = int(size.max())
        here = (np.arange(width) < size[:, None]).ravel()
        start = np.arange(n) * width  # symbols are addressed by row * width + place
        stop = start + size
        symbol = np.full(n * width, -1, np.int32)
        symbol[here] = self.single[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        after, before = np.arange(1, n * width + 1), np.arange(-1, n * width - 1)  # ``stop`` after the last symbol
        rank, join = np.full(n * width, _NONE, np.int32), np.zeros(n * width, np.int32)

        def renew(row, at):
            """The candidate of the symbols at ``at`` and after it."""
            rank[at] = _NONE
            middle = after[at]
            inside = np.flatnonzero(middle < stop[row])
            row, at, middle = row[inside], at[inside], middle[inside]
            place = self._find(symbol[at].astype(np.int64) * self.size + symbol[middle])
            can = np.flatnonzero(place >= 0)
            row, at, middle, place = row[can], at[can], middle[can], place[can]
            spot = [x - start[row] for x in (at, middle, after[middle])]
            if met is not None:
                met.append((row, self._place(*spot)))
            if self.limit and key is not None:
                can = np.flatnonzero(~self._skipped(key[row], *spot))
                at, place = at[can], place[can]
            rank[at], join[at] = self.v.rank[place], self.v.joined[place]

        first = np.flatnonzero(here)
        renew(first // width, first)
        rows, ranks = np.arange(n), rank.reshape(n, width)
        while len(rows):
            best = (ranks if len(rows) == n else ranks[rows]).argmin(1) + start[rows]
            go = np.flatnonzero(rank[best] < _NONE)
            rows, best = rows[go], best[go]
            gone = after[best]
            symbol[best] = join[best]
            symbol[gone], rank[gone] = -1, _NONE
            then = after[gone]
            after[best] = then
            more = np.flatnonzero(then < stop[rows])
            before[then[more]] = best[more]
            prior = before[best]
            old = np.flatnonzero(prior >= start[rows])
            renew(np.concatenate([rows, rows[old]]), np.concatenate([best, prior[old]]))
        return symbol[symbol >= 0], (symbol.reshape(n, width) >= 0).sum(1)

    def agenda(self, chunk: str, variant: int) -> np.ndarray:
        """The ids of any chunk, keyed by chunk and variant."""
        return self._agenda(chunk, np.uint64(self._key(chunk, variant)))

    def _agenda(self, chunk: str, key: np.uint64 | None, met: list | None = None) -> np.ndarray:
        """The ids of any chunk, by a heap of candidates; without a key as in ``_together``."""
        symbol = [int(self.single[ord(c)]) for c in chunk]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(at: int) -> None:
            middle = after[at]
            if middle >= n or symbol[at] < 0 or symbol[middle] < 0:
                return
            found = self.merge.get(symbol[at] * self.size + symbol[middle])
            if found and met is not None:
                met.append(int(self._place(at, middle, after[middle])))
            if found and not (self.limit and key is not None and self._skipped(key, at, middle, after[middle])[0]):
                heapq.heappush(heap, (found[0], at, middle, after[middle], found[1]))

        for i in range(n):
            offer(i)
        dead = [False] * n
        while heap:
            _, at, middle, end, join = heapq.heappop(heap)
            if dead[at] or dead[middle] or after[at] != middle or after[middle] != end:
                continue
            symbol[at], dead[middle], after[at] = join, True, end
            if end < n:
                before[end] = at
            offer(at)
            if before[at] >= 0:
                offer(before[at])
        out: list[int] = []
        for c, s, d in zip(chunk, symbol, dead):
            if not d:
                out += [s] if s >= 0 else [self.v.byte0 + b for b in c.encode("utf-8", "surrogatepass")]
        return np.array(out, np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids."""
        start = self.bytes_at[ids]
        raw = self.bytes[_ranges(start, self.bytes_at[ids + 1] - start)].tobytes()
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indexes of all ranges ``start .. start + length``, one after the other."""
    shift = np.repeat(start - (np.cumsum(length) - length), length)
    return np.arange(len(shift)) + shift


def _document(doc_id: str, seed: int):
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), F.lit(seed))


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, dropout: float = DROPOUT,
           seed: int = SEED) -> DataFrame:
    """``(doc_id, ids, lossless)`` per row; ``lossless``: decoding the ids gives the text again."""
    bounded(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("lossless", pa.bool_())])
    state: list[Segmenter] = []

    def run(ids, texts, keys):
        if not state:
            state.append(Segmenter(vocabulary.value, dropout, seed))
        texts = [t or "" for t in texts.to_pylist()]
        found = state[0].encode(texts, keys.to_pylist())
        flat = np.concatenate(found) if found else np.empty(0, np.int32)
        ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        return {"doc_id": ids, "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                "lossless": [state[0].decode(f) == t for f, t in zip(found, texts)]}

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), _document(doc_id, seed).alias("key"))
    return rows.mapInArrow(by_batches(run, schema, "doc_id", "text", "key"), "doc_id long, ids array<int>, lossless boolean")


def decode(rows: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``rows`` with the ``text`` that their ids decode to (null ids: an empty text)."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    state: list[Segmenter] = []

    @F.pandas_udf("string")
    def run(x):
        if not state:
            state.append(Segmenter(vocabulary.value, 0.0, 0))
        return x.map(lambda i: state[0].decode(np.asarray(i if i is not None else [], np.int32)))

    return rows.withColumn("text", run(ids))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` encoded with dropout and decoded again."""
    found = encode(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("ids").alias("n_pieces"), "ids", "lossless")
