"""Benchmark decontamination by question templates.

Words become template tokens: numbers, names (capitalised inside a sentence) and units (after a number)
turn into typed placeholders, other words into their lower-case letters and digits. A currency sign at a number
belongs to it. A capitalised word at a sentence's start may be a name or not: windows over one are taken in both
readings, and the second counts where the first finds nothing. Windows of five tokens
of all documents are hash-joined with the windows of the benchmark. Per document and item, the windows are
taken as one run (same shift between the two texts) and over all shifts; an item leaks if at least 0.8 of
its windows are there and its slots are filled consistently: each value of the item is replaced by one
value throughout, and different names or units by different ones (numbers may come to be equal). A question with
other numbers or names is thus found, a chance mix of fragments is not.

Before the join a bitmap of fixed size, set from all benchmark windows, keeps document windows that can't
match from being shuffled; it drops no match. Windows with fewer than two plain words say nothing about a
text and are not used on either side. Items without a usable window, short ones above all, are searched for as
a whole where ``short`` is set: their words, lower-case and without marks at their edges, must stand in a text one
after the other, at least three of them. Their first three words are looked up like a window.

Defined cases: null and empty texts match nothing, nor do texts shorter than a window but for short items; very
long texts are handled whole; items without a usable window are searched for only with ``short`` and from three
words on; rows sharing an identifier (or having none) are judged together; repeated
items count once; an empty benchmark leaks nowhere; extra columns don't matter.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventframe.llm.common import by_batches, cut, table, window_hashes

WIDTH, SHARE, PLAIN = 5, 0.8, 2
#: Words from which an item is searched for as a whole.
SHORT = 3
#: Bits of the window hash that address the bitmap.
_BITS = 22
#: Benchmark windows up to which their table is broadcast (about 200 bytes each).
_SMALL = 100_000
#: Distinct words whose tokens a task remembers.
_WORDS = 300_000

UNITS = frozenset(
    "m cm mm km inch inches foot feet ft yard yards mile miles g kg mg gram grams kilogram kilograms ton tons lb lbs "
    "pound pounds oz ounce ounces l ml litre litres liter liters gallon gallons s sec second seconds min minute "
    "minutes h hr hour hours day days week weeks month months year years percent % degree degrees °c °f dollar "
    "dollars cent cents euro euros € $ £ mph kmh km/h m/s hz khz mhz ghz w kw mw v a j kj cal kcal n pa kpa".split())
_NUMBER = re.compile(r"[+-]?[€$£]?[+-]?\.?\d[\d.,:/]*[€$£]?")
_QUANTITY = re.compile(r"[+-]?[€$£]?\d[\d.,:/]*([^\W\d]+|%|°[cf])")
_NUM, _NAME, _UNIT = (xxhash.xxh64_intdigest(x) for x in ("<number>", "<name>", "<unit>"))
_EDGES = re.compile(r"^[^\w%€$£°]+|[^\w%€$£°]+$")


class Tokens(dict):
    """The number of each word, given at its first use, and by number the template token: codes by context,
    kinds, and whether the word ends a sentence."""

    def __init__(self):
        # by word: codes at a sentence's start, inside, after a number; kinds likewise, and whether it ends one
        self.codes, self.kinds = array("Q"), array("b")

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        core = text.rstrip(".,;:!?")
        if letters := core.isalpha():
            low = core.lower()
        else:
            core = _EDGES.sub("", text)
            low = core.lower()
        if not letters and (_NUMBER.fullmatch(core) or (m := _QUANTITY.fullmatch(low)) and m[1] in UNITS):
            codes, kinds = (_NUM, _NUM, _NUM), (1, 1, 1)
        else:
            plain = xxhash.xxh64_intdigest(low, 1)
            name = core[:1].isupper() and len(core) > 1
            unit = low in UNITS
            codes = (plain, _NAME if name else plain, _UNIT if unit else _NAME if name else plain)
            kinds = (0, 2 * name, 3 if unit else 2 * name)
        self.codes.extend(codes)
        self.kinds.extend((*kinds, text[-1:] in ".!?" if letters else text.rstrip("\"')]»”").endswith((".", "!", "?"))))
        self[word] = len(self)
        return len(self) - 1

    def template(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(codes, kinds) of a text's words; kind 0 is a plain word. Capitalised words at a sentence's start are
        plain in the first reading and names in the second."""
        index = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        by_code = np.frombuffer(self.codes, np.uint64).reshape(-1, 3)
        by_kind = np.frombuffer(self.kinds, np.int8).reshape(-1, 4)
        codes, kinds = by_code[index, 1], by_kind[index, 1]
        after = np.flatnonzero(kinds[:-1] == 1) + 1
        codes[after], kinds[after] = by_code[index[after], 2], by_kind[index[after], 2]
        first = np.append(0, np.flatnonzero(by_kind[index[:-1], 3]) + 1)
        out = []
        for reading in (0, 1):
            codes[first], kinds[first] = by_code[index[first], reading], by_kind[index[first], reading]
            out.append((codes.copy(), kinds.copy()))
        return out


def windows(df: DataFrame, key: str, text: str, bitmap=None, width: int = WIDTH, plain: int = PLAIN) -> DataFrame:
    """``(key, pos, reading, hash, slots)``: the usable windows; ``slots`` has a placeholder's word, null elsewhere.
    Those of reading 1 are there where it differs from reading 0."""
    schema = pa.schema([("key", pa.int64()), ("pos", pa.int32()), ("reading", pa.int32()), ("hash", pa.int64()), ("slots", pa.list_(pa.string()))])
    tokens: list[Tokens] = []

    def find(keys, texts):
        if not tokens or len(tokens[0]) > _WORDS:
            tokens[:] = [Tokens()]
        out: dict[str, list] = {"key": [], "pos": [], "reading": [], "hash": [], "slots": []}
        for key, text in zip(keys.to_pylist(), texts):
            words = (text.as_py() or "").encode().split()
            if len(words) < width:
                continue
            before = None
            for reading, (codes, kinds) in enumerate(tokens[0].template(words)):
                hashes = window_hashes(codes, width)
                use = np.ones(len(hashes), bool) if before is None else hashes != before
                before = hashes
                if bitmap is not None:
                    use &= bitmap.value[hashes >> np.uint64(64 - _BITS)]
                at = np.flatnonzero(use)
                if not len(at):
                    continue
                for p in at[sum(kinds[at + j] == 0 for j in range(width)) >= plain].tolist():
                    out["key"].append(key)
                    out["pos"].append(p)
                    out["reading"].append(reading)
                    out["hash"].append(int(hashes[p].view(np.int64)))
                    out["slots"].append([words[p + j].decode("utf-8", "replace").lower() if kinds[p + j] else None for j in range(width)])
        return {n: pa.array(v, schema.field(n).type) for n, v in out.items()}

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(by_batches(find, schema, "key", "text"), "key long, pos int, reading int, hash long, slots array<string>")


def benchmark_windows(benchmark: DataFrame, key: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``(hash, item_id, at, values, total)``: an item's distinct windows, each at its first place, in both readings."""
    both = cut(windows(benchmark.where(F.col(key).isNotNull()), key, text, width=width).withColumnRenamed("key", "item_id"), "item-windows")
    rows = both.where("reading = 0").groupBy("item_id", "hash").agg(F.min(F.struct("pos", "slots")).alias("first"))
    rows = rows.select("item_id", "hash", F.col("first.pos").alias("at"), F.col("first.slots").alias("values"))
    total = rows.groupBy("item_id").agg(F.count("*").alias("total"))
    other = both.where("reading = 1").select("item_id", "hash", F.col("pos").alias("at"), F.col("slots").alias("values")).distinct()
    other = other.join(rows.select("item_id", "at"), ["item_id", "at"], "left_semi").select(rows.columns)
    return rows.unionByName(other).join(total, "item_id").select("hash", "item_id", "at", "values", "total")


def bare_words(text: str | None) -> list[str]:
    """Lower-case words without marks at their edges; words of marks alone are left out."""
    return [w for w in (_EDGES.sub("", w).lower() for w in (text or "").split()) if w]


def starts(df: DataFrame, key: str, text: str, size: int, whole: bool, bitmap=None) -> DataFrame:
    """``(key, hash, words)``: the hash of each three words and the up to ``size`` bare words from there on, each with
    a space behind; ``whole`` takes the text's start alone, with all its words."""
    schema = pa.schema([("key", pa.int64()), ("hash", pa.int64()), ("words", pa.string())])

    def find(keys, texts):
        rows = []
        for key, text in zip(keys.to_pylist(), texts):
            words = bare_words(text.as_py())
            if len(words) < SHORT:
                continue
            codes = np.fromiter((xxhash.xxh64_intdigest(w, 2) for w in words), np.uint64, len(words))
            hashes = window_hashes(codes, SHORT)
            at = [0] if whole else range(len(hashes)) if bitmap is None else np.flatnonzero(bitmap.value[hashes >> np.uint64(64 - _BITS)]).tolist()
            rows += {(key, int(hashes[p].view(np.int64)), " ".join(words if whole else words[p:p + size]) + " ") for p in at}
        return {n: pa.array([r[i] for r in rows], schema.field(n).type) for i, n in enumerate(schema.names)}

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(by_batches(find, schema, "key", "text"), "key long, hash long, words string")


def bitmap_of(known: DataFrame) -> np.ndarray:
    """The places of the column ``hash``: at most 2^22 of them, whatever the benchmark's size."""
    bitmap = np.zeros(1 << _BITS, np.bool_)
    places = known.select(F.shiftrightunsigned("hash", 64 - _BITS).alias("p")).distinct().toPandas()["p"]
    bitmap[places.to_numpy(np.int64)] = True
    return bitmap


def short_leaks(docs: DataFrame, benchmark: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame | None:
    """Like ``leaks``, for the items that ``known`` has no window of; None if there are no such items."""
    spark = docs.sparkSession
    rest = benchmark.where(F.col("item_id").isNotNull()).join(known.select("item_id").distinct(), "item_id", "left_anti")
    items = cut(starts(rest, "item_id", "text", 0, True).withColumnRenamed("key", "item_id").distinct(), "short-items")
    size = items.agg(F.max(F.size(F.split("words", " ")) - 1)).first()[0]
    if size is None:
        return None
    found = starts(docs, doc_id, text, size, False, spark.sparkContext.broadcast(bitmap_of(items)))
    items = items.withColumnRenamed("words", "item")
    if items.count() <= _SMALL:
        items = F.broadcast(items)
    hits = found.join(items, "hash").where(F.startswith("words", "item")).select(F.col("key").alias("doc_id"), "item_id").distinct()
    return hits.select("doc_id", "item_id", F.lit(1.0).alias("coverage"), F.lit(False).alias("changed"))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE, short: bool = False) -> DataFrame:
    """``(doc_id, item_id, coverage, changed)`` per leaked item; ``changed`` if slots have other values. ``short`` also
    searches for the items without a usable window."""
    known = cut(benchmark_windows(benchmark), "benchmark")
    found = template_leaks(docs, known, doc_id, text, share)
    more = short_leaks(docs, benchmark, known, doc_id, text) if short else None
    return found if more is None else found.unionByName(more)


def template_leaks(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """``leaks`` for the items with windows in ``known``."""
    spark = docs.sparkSession
    found = windows(docs, doc_id, text, spark.sparkContext.broadcast(bitmap_of(known)))
    if known.count() <= _SMALL:
        known = F.broadcast(known)
    pairs = cut(found.join(known, "hash").select(F.col("key").alias("doc_id"), "item_id", "at", "reading", (F.col("pos") - F.col("at")).alias("shift"),
                                                  "total", F.arrays_zip(F.col("values").alias("was"), F.col("slots").alias("now")).alias("pair")), "template-hits")
    first = F.min("reading").over(Window.partitionBy("doc_id", "item_id", "at", "shift"))
    pairs = pairs.withColumn("first", first).where("reading = first").drop("reading", "first")
    runs = pairs.withColumn("shift", F.explode(F.array("shift", F.lit(None).cast("int"))))
    group = ["doc_id", "item_id", "shift"]
    cover = runs.groupBy(group).agg((F.size(F.collect_set("at")) / F.max("total")).alias("coverage")).where(F.col("coverage") >= share)
    filled = runs.select(*group, F.explode("pair").alias("s")).where("s.was is not null")
    filled = filled.groupBy(*group, "s.was", "s.now").agg(F.count("*").alias("n"))
    # side 0: what a value of the item became; side 1: what a name or unit of the text was in the item
    sides = [F.struct(F.lit(side).alias("side"), F.col(a).alias("key"), F.col(b).alias("value")) for side, a, b in ((0, "was", "now"), (1, "now", "was"))]
    sided = filled.select(*group, "n", F.inline(F.array(*sides))).where("side = 0 or not key rlike '[0-9]'")
    value = sided.groupBy(*group, "side", "key").agg(F.max(F.struct("n", "value")).alias("most"), F.sum("n").alias("n"))
    changed = (F.col("side") == 0) & (F.col("most.value") != F.col("key"))
    slots = value.groupBy(group).agg(F.min(F.col("most.n") / F.col("n")).alias("agree"), F.max(changed).alias("changed"))
    same = [cover[c].eqNullSafe(slots[c]) for c in group]
    judged = cover.join(slots, same[0] & same[1] & same[2], "left").where((F.coalesce("agree", F.lit(1.0)) >= share))
    return judged.select(cover["doc_id"], cover["item_id"], "coverage", F.coalesce("changed", F.lit(False)).alias("changed")).groupBy("doc_id", "item_id").agg(
        F.max("coverage").alias("coverage"), F.min("changed").alias("changed"))


def judge(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE, short: bool = False) -> DataFrame:
    """``(doc_id, contaminated, item_ids, coverage, changed_item_ids)`` for every row of ``docs``."""
    found = leaks(docs, benchmark, doc_id, text, share, short).groupBy("doc_id").agg(
        F.sort_array(F.collect_list("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"),
        F.sort_array(F.collect_list(F.when(F.col("changed"), F.col("item_id")))).alias("changed_item_ids"))
    found = cut(found.withColumnRenamed("doc_id", "_id"), "leaks")
    none = F.array().cast("array<long>")
    ids = docs.select(F.col(doc_id).alias("doc_id"))
    return ids.join(found, ids["doc_id"].eqNullSafe(found["_id"]), "left").select(
        "doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("changed_item_ids", none).alias("changed_item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` in which no item leaks."""
    found = cut(leaks(docs, benchmark, doc_id, text, share).select(F.col("doc_id").alias("_leaks_in")).distinct(), "leaks")
    return docs.join(found, docs[doc_id].eqNullSafe(found["_leaks_in"]), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, judged against ``benchmark``."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True)
