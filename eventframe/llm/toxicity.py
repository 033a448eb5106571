"""Toxicity with a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The kernel of two strings sums, over the subsequences of three letters that they share, a factor of
``DECAY`` for every position that the subsequence spans in either: letters with something in between still
count, only less, so that gapped and padded insults stay close to the plain ones. It is normalised to
[0, 1] and sharpened by a power. Where fewer than three quarters of a landmark's distinct letters occur in a
string, its value counts as zero.

A text is a bag of strings: its words, the beginnings of words, and runs of letters that stand alone joined
to one string. A landmark's feature is its largest kernel value over the bag; the inverse root of the
landmarks' own kernel matrix turns the features into Nyström coordinates, on which Spark ML trains the
machine. The score is the logistic function of its margin.

Only the fit uses a sample: at most ``MOST`` labelled rows of each class, by a hash of the identifier. Every
text is scored over all its words. Labels train; language, source and identifier are never features.

Defined cases: null and empty texts have the features zero; rows with a null identifier are scored and count
as held out; null labels are left out, of repeated ones the largest holds; without training rows of both
classes every score is the share of toxic ones (0 if there are none); an empty table gives no rows; extra
columns don't matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventframe.llm.common import by_batches, cut, table

#: Labelled rows of each class that the fit may use.
MOST = 5_000
LANDMARKS, DECAY, POWER, LETTERS = 64, 0.6, 3, 0.75
#: Strings longer than this are cut into pieces that overlap by half.
LONGEST = 24
#: Strings whose features a task remembers.
_KEPT = 200_000
_STEEP = 4.0
_EDGES = re.compile(r"^\W+|\W+$")


def strings(word: str) -> list[str]:
    """The strings that stand for a word: itself between marks, and its first four and five letters."""
    core = word if word.isalnum() else _EDGES.sub("", word)
    if not core:
        return []
    if len(core) > LONGEST:
        step = LONGEST // 2
        return [core[i:i + LONGEST] for i in range(0, len(core) - step, step)]
    out = ["^" + core + "$"]
    if len(core) > 4:
        out.append("^" + core[:4])
    if len(core) > 5:
        out.append("^" + core[:5])
    return out


def bag(text: str | None) -> set[str]:
    """The distinct words of a text, and each run of three or more single letters, marks between them left out, as
    one word."""
    words = (text or "").lower().split()
    out, run = set(words), []
    for at in [i for i, w in enumerate(words) if len(w) == 1 and w.isalnum()]:
        if run and any(c.isalnum() for w in words[run[-1] + 1:at] for c in w):
            if len(run) > 2:
                out.add("".join(words[i] for i in run))
            run = []
        run.append(at)
    if len(run) > 2:
        out.add("".join(words[i] for i in run))
    return out


def _padded(items: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(byte codes by row, lengths)."""
    raw = [s.encode() for s in items]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    out = np.full((len(raw), max(1, size.max(initial=1))), pad, np.int16)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
    return out, size


def _letters(codes: np.ndarray) -> np.ndarray:
    """A 64-bit set of each row's bytes, the marks left out."""
    bit = np.where((codes >= 97) & (codes <= 122), codes - 97, 26 + codes % 37).astype(np.uint64)
    use = (codes > 0) & (codes != ord("^")) & (codes != ord("$"))
    return np.bitwise_or.reduce(np.where(use, np.uint64(1) << bit, np.uint64(0)), axis=1)


def kernel(s: np.ndarray, t: np.ndarray, n: int = 3, decay: float = DECAY) -> np.ndarray:
    """The subsequence kernel of each row of ``s`` with the same row of ``t`` (codes, padded differently).

    ``part[i]`` holds, for the part of ``s`` read so far and each prefix of ``t``, the weight of shared
    subsequences of length ``i`` that run to the ends of both.
    """
    rows, width = t.shape
    reach = np.tril(decay ** np.subtract.outer(np.arange(width), np.arange(width)).clip(0)).T.astype(np.float32)
    part = [np.ones((rows, width + 1), np.float32)] + [np.zeros((rows, width + 1), np.float32) for _ in range(n - 1)]
    total = np.zeros(rows, np.float32)
    square = np.float32(decay * decay)
    for p in range(s.shape[1]):
        same = (s[:, p:p + 1] == t) * square
        total += (part[n - 1][:, :-1] * same).sum(1)
        for i in range(n - 1, 0, -1):
            part[i] *= np.float32(decay)
            part[i][:, 1:] += (part[i - 1][:, :-1] * same) @ reach
    return total


@dataclass
class Landmarks:
    """The landmark strings with what the features need of them."""

    names: list[str]

    def __post_init__(self):
        self.codes, _ = _padded(self.names, -1)
        self.sets = _letters(np.maximum(self.codes, 0))
        self.need = np.ceil(LETTERS * np.bitwise_count(self.sets)).astype(np.int64)
        self.own = kernel(_padded(self.names, -2)[0], self.codes)

    def features(self, items: list[str]) -> np.ndarray:
        """The sharpened normalised kernel of each string with each landmark."""
        out = np.zeros((len(items), len(self.names)), np.float32)
        if not items:
            return out
        codes, size = _padded(items, -2)
        sets = _letters(np.maximum(codes, 0))
        row, col = np.nonzero(np.bitwise_count(sets[:, None] & self.sets) >= self.need)
        if not len(row):
            return out
        used = np.unique(row)
        own = np.zeros(len(items), np.float32)
        used = used[np.argsort(size[used], kind="stable")]
        for lo in range(0, len(used), 20_000):
            part = used[lo:lo + 20_000]
            wide = size[part].max()
            own[part] = kernel(codes[part, :wide], np.where(codes[part, :wide] == -2, -1, codes[part, :wide]))
        order = np.argsort(size[row], kind="stable")
        for lo in range(0, len(order), 20_000):
            r, c = row[order[lo:lo + 20_000]], col[order[lo:lo + 20_000]]
            value = kernel(codes[r, :size[r].max()], self.codes[c])
            norm = np.sqrt(own[r] * self.own[c])
            out[r, c] = np.where(norm > 0, value / np.maximum(norm, 1e-12), 0) ** POWER
        return out


class Bags:
    """Features of texts; the words' features are remembered within a task."""

    def __init__(self, marks: Landmarks):
        self.marks = marks
        self.at: dict[str, int] = {}
        self.rows = [np.zeros((1, len(marks.names)), np.float32)]  # row 0: no landmark is near

    def texts(self, texts: list[str | None], at_once: int = 2 << 20) -> np.ndarray:
        """The features of each text, found for about ``at_once`` characters at a time."""
        part = np.cumsum([len(t or "") for t in texts]) // at_once if texts else np.empty(0, int)
        ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        found = [self._some(texts[a:b]) for a, b in zip([0, *ends], ends)]
        return np.concatenate(found) if found else np.zeros((0, len(self.marks.names)), np.float32)

    def _some(self, texts: list[str | None]) -> np.ndarray:
        bags = [bag(t) for t in texts]
        if len(self.at) > _KEPT:
            self.__init__(self.marks)
        new = list(set().union(*bags).difference(self.at))
        self._add(new)
        self.rows = [np.concatenate(self.rows)]
        known, at = self.rows[0], self.at
        out = np.zeros((len(texts), len(self.marks.names)), np.float32)
        for i, words in enumerate(bags):
            if near := [k for k in map(at.__getitem__, words) if k]:
                out[i] = known[near].max(0)
        return out

    def _add(self, new: list[str]) -> None:
        of: dict[str, int] = {}
        word_of, item_of = [], []
        for i, w in enumerate(new):
            for s in strings(w):
                word_of.append(i)
                item_of.append(of.setdefault(s, len(of)))
        values = np.zeros((len(new), len(self.marks.names)), np.float32)
        items = self.marks.features(list(of))
        near = items.any(1)
        word_of, item_of = np.array(word_of, np.int64), np.array(item_of, np.int64)
        if len(item_of):
            use = near[item_of]
            np.maximum.at(values, word_of[use], items[item_of[use]])
        active = np.flatnonzero(values.any(1))
        start = sum(map(len, self.rows))
        self.at.update(dict.fromkeys(new, 0))
        self.at.update((new[i], start + j) for j, i in enumerate(active.tolist()))
        self.rows.append(values[active])


@dataclass
class Model:
    """Landmarks, the Nyström map and the machine's weights; without landmarks, a constant score."""

    marks: Landmarks | None
    weights: np.ndarray
    bias: float
    share: float = 0.0

    def margins(self, features: np.ndarray) -> np.ndarray:
        return features @ self.weights + self.bias


def _featured(rows: DataFrame, marks: Landmarks) -> DataFrame:
    """``(id, label, x)`` with the raw features of each text."""
    schema = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("x", pa.list_(pa.float64()))])
    state: list[Bags] = []

    def run(ids, labels, texts):
        if not state:
            state.append(Bags(marks))
        return {"id": ids, "label": labels, "x": pa.array([list(map(float, x)) for x in state[0].texts(texts.to_pylist())], schema.field("x").type)}

    return rows.mapInArrow(by_batches(run, schema, "id", "label", "text"), "id long, label int, x array<double>")


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, label, text)``: up to ``most`` rows of each class that aren't held out, by a hash of the id."""
    known = (labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("label"))
             .where("id is not null and label is not null and crc32(cast(id as string)) % 5 <> 0").groupBy("id").agg(F.max("label").alias("label")))
    here = docs.select(F.col(doc_id).cast("long").alias("id")).distinct()  # ids without a text would use up the bound
    known = cut(known.join(here, "id", "left_semi"), "labels")
    pick = [known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(most) for c in (0, 1)]
    pick = F.broadcast(pick[0].unionByName(pick[1]))  # at most 2 x most rows
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return cut(rows.join(pick, "id").select("id", "label", "text"), "training")


def choose(rows: DataFrame, count: int = LANDMARKS) -> list[str]:
    """Landmarks: the strings whose presence tells most about the label, none close to an earlier one."""

    def run(labels, texts):
        out = [(c, s) for c, t in zip(labels.to_pylist(), texts.to_pylist()) for s in set().union(*(strings(w) for w in bag(t)), ())]
        return {"label": [c for c, _ in out], "item": [s for _, s in out]}

    schema = pa.schema([("label", pa.int32()), ("item", pa.string())])
    seen = rows.mapInArrow(by_batches(run, schema, "label", "text"), "label int, item string")
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    a, b = F.sum("label"), F.sum(1 - F.col("label"))
    counts = seen.groupBy("item").agg(a.alias("a"), b.alias("b")).where("a + b > 1 and length(item) > 4")
    told = F.col("a") * F.log((F.col("a") + 0.5) / (F.col("b") + 0.5) * (size[0] + 1) / (size[1] + 1))
    top = counts.where("a > 0").withColumn("told", told).orderBy(F.desc("told"), "item").limit(8 * count)
    names = [r["item"] for r in top.collect()]
    if not names:
        return []
    like = Landmarks(names).features(names)
    chosen: list[int] = []
    for i in range(len(names)):
        if len(chosen) < count and not (like[i, chosen] > 0.8).any():
            chosen.append(i)
    return [names[i] for i in chosen]


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Train on labelled rows that aren't held out."""
    rows = training_rows(docs, labels, most, doc_id, text)
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = size.get(1, 0) / max(1, sum(size.values()))
    names = choose(rows) if size.get(0) and size.get(1) else []
    if not names:
        return Model(None, np.zeros(0), 0.0, share)
    marks = Landmarks(names)
    like = marks.features(names).astype(np.float64)
    value, vector = np.linalg.eigh((like + like.T) / 2)
    keep = value > 1e-3
    nystrom = (vector[:, keep] / np.sqrt(value[keep])) @ vector[:, keep].T
    m = len(names)
    x = [F.aggregate(F.zip_with("x", F.array(*map(F.lit, map(float, nystrom[:, j]))), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for j in range(m)]
    train = cut(_featured(rows, marks), "features").select("label", F.array(*x).alias("z"))
    weight = F.when(F.col("label") == 1, sum(size.values()) / (2 * size[1])).otherwise(sum(size.values()) / (2 * size[0]))
    train = cut(train.select(F.col("label").cast("double").alias("label"), weight.alias("weight"), "z"), "nystrom")
    train = train.select("label", "weight", array_to_vector("z").alias("features")).persist()
    machine = LinearSVC(weightCol="weight", regParam=1e-3, maxIter=60, standardization=False).fit(train)
    train.unpersist()
    return Model(marks, nystrom @ machine.coefficients.toArray(), float(machine.intercept), share)


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)`` per row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if model.marks is None:
        return rows.select("doc_id", F.lit(float(model.share)).alias("score"))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    state: list[Bags] = []

    def run(ids, texts):
        if not state:
            state.append(Bags(model.marks))
        margin = model.margins(state[0].texts(texts.to_pylist()).astype(np.float64))
        return {"doc_id": ids, "score": 1 / (1 + np.exp(-np.clip(_STEEP * margin, -500, 500)))}

    return rows.mapInArrow(by_batches(run, schema, "doc_id", "text"), "doc_id long, score double")


def judge(docs: DataFrame, labels: DataFrame, most: int = MOST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``."""
    found = scores(docs, fit(docs, labels, most, doc_id, text), doc_id, text)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, most: int = MOST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't judged toxic; rows that share an identifier are told apart by text."""
    model = fit(docs, labels, most, doc_id, text)
    if model.marks is None:
        return docs if model.share < 0.5 else docs.limit(0)
    state: list[Bags] = []
    at = docs.columns.index(text)

    def run(batches):
        if not state:
            state.append(Bags(model.marks))
        for batch in batches:
            margin = model.margins(state[0].texts(batch.column(at).to_pylist()).astype(np.float64))
            yield batch.filter(pa.array(margin < 0))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, scored by a model of ``labels``."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
