"""The n-gram Jaccard join against all pairs of documents."""

import random

import pytest
from pyspark.sql import functions as F

from eventframe.llm import jaccard_join as J
from eventframe.llm.common import table

from helpers_llm import corpus, frame


def shingle_set(text, width=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, percent=80):
    """(doc_id, set size, smallest linked identifier) by comparing every pair."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    label = {i: i for i, _ in sets if i is not None}
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x]
             if a is not None and b is not None and s and 100 * len(s & t) >= percent * len(s | t)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(((i, len(s), None if i is None else label[i]) for i, s in sets), key=key)


def ours(docs, **options):
    key = lambda r: tuple((x is None, x) for x in r)
    got = J.near_texts(docs, **options).select("doc_id", "n_shingles", "component_id").collect()
    return sorted(map(tuple, got), key=key)


def chains(seed, n, words=60):
    """Families whose members drift apart word by word, so that windows of one component reach another's."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    boiler = [r.choice(vocabulary) for _ in range(40)]
    out, own = [], None
    for i in range(n):
        if own is None or r.random() < 0.08:
            own = [r.choice(vocabulary) for _ in range(words)] + boiler
        else:
            own = list(own)
            for _ in range(r.choice([1, 1, 2, 3])):
                own[r.randrange(words)] = r.choice(vocabulary)
        out.append((i * 7 % n if n % 7 else i, " ".join(own)))
    return out


@pytest.mark.parametrize("rounds", [(32, 16), (3, 2)])
def test_corpus_against_brute_force(spark, rounds):
    rows = corpus(4, 120)
    assert ours(frame(spark, rows), factor=rounds[0], small=rounds[1]) == brute(rows)


@pytest.mark.parametrize("rounds", [(32, 16), (2, 2), (4, 3)])
def test_drifting_families(spark, rounds):
    rows = chains(rounds[0], 150)
    want = brute(rows)
    assert 4 < len({c for *_, c in want}) < 100
    assert ours(frame(spark, rows), factor=rounds[0], small=rounds[1]) == want


def test_one_large_group_settles_without_pairs(spark):
    r = random.Random(9)
    base = [f"b{i}" for i in range(80)]
    rows = [(0, " ".join(base))]
    for i in range(1, 240):
        own = list(base)
        own[r.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(own)))
    crowd = spark.createDataFrame([(i, len(h), [int(x) for x in h.view("int64")]) for i, h in
                                   ((i, J.shingle_hashes(t.encode(), 5, {})) for i, t in rows)], "node long, n int, h array<long>")
    edges = J.links(crowd, 80, 4, 2)
    assert edges.count() < 4 * 240  # all pairs would be 28,680
    assert ours(frame(spark, rows), factor=4, small=2) == brute(rows)


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "Solo"), (5, "solo"), (6, "a b c d"), (7, "A b\nc  d"), (8, "a b c d e"),
            (None, "a b c d"), (None, None), (9, "solo"), (9, "a b c d"), (10, "x " * 3000), (11, "x " * 4000), (-3, "solo"), (12, None), (8, "a b c d e")]
    docs = frame(spark, rows).withColumn("h", F.lit(1)).withColumn("node", F.lit("n")).withColumn("K1", F.lit(None))
    assert ours(docs) == brute(rows)
    assert J.near_texts(docs.where("false")).count() == 0


def test_exactly_at_the_threshold(spark):
    # 40 of 50 shingles in common are a link, 39 of 50 none
    one, two = [f"w{i}" for i in range(54)], [f"v{i}" for i in range(54)]
    rows = [(1, " ".join(one)), (2, " ".join(one[:44])), (3, " ".join(two)), (4, " ".join(two[:43]))]
    want = brute(rows)
    assert [c for *_, c in want] == [1, 1, 3, 4]
    assert ours(frame(spark, rows)) == want


def test_crowd_is_the_same_for_any_blocks(spark, monkeypatch):
    rows = [(i, t) for i, t in corpus(7, 90) if t]
    want = None
    for parts, block in ((1, 1 << 21), (7, 40)):
        docs = frame(spark, rows, parts).selectExpr("doc_id", "cast(text as binary) text")
        sets = J.sets(docs, 5, 80).where("n > 0").withColumn("rid", F.monotonically_increasing_id()).cache()
        crowd = sets.join(J.crowd_of(sets, 80, block), "rid").select("k1", "k2").distinct()
        got = {tuple(r) for r in crowd.collect()}
        flat = sets.dropDuplicates(["k1", "k2"]).select("k1", "k2", "n", F.explode("h").alias("s"))
        often = flat.groupBy("s").count().where("count > 1")
        plain = flat.join(often, "s").groupBy("k1", "k2", "n").count().where("count >= greatest(1, ceil(n * 80 / 1000))")
        assert got == {(r["k1"], r["k2"]) for r in plain.collect()} and got
        assert want is None or want == got
        want = got


def test_given_documents(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    got = J.op13_jaccard_join(spark, "/root/testdata/sf0.001")
    assert got.columns[:3] == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == brute(rows)
