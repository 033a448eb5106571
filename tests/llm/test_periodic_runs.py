"""Periodic runs of words against brute force."""

import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventframe.llm.common import table
from eventframe.llm import periodic_runs as P

from helpers_llm import frame


def brute(words):
    """Every stretch with a period, by comparing each word with the one a lag before."""
    n, found = len(words), []
    for q in range(1, n // P.TIMES + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            own = words[i:i + length]
            if length >= max(P.WORDS, P.TIMES * q) and not any(own[d:] == own[:-d] for d in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def ours(texts):
    out = P._batch(pa.array(range(len(texts))), pa.array(texts, pa.binary())).to_pylist()
    return [([(r["start"], r["length"], r["period"]) for r in o["runs"]], o["collapsed"], o["n_words"]) for o in out]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(
    st.lists(st.sampled_from("abcd"), max_size=40),
    st.tuples(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=9), st.integers(1, 9)).map(lambda t: t[0] * t[1])), max_size=6))
def test_against_brute_force(parts):
    texts = [" ".join(p).encode() for p in parts] + [" ".join(w for p in parts for w in p).encode()]
    for t, (runs, kept, n) in zip(texts, ours(texts)):
        words = t.split()
        assert n == len(words)
        assert runs == brute(words)
        assert kept == collapse(words, runs)


def test_splitting_one_by_one_gives_the_same_segments():
    r = random.Random(3)
    for _ in range(200):
        codes = np.array([r.choice([1, 1, 1, 2, 2, 3, 4, 5, 6]) for _ in range(r.randint(1, 90))])
        rounds = [s for s in sorted(P.split(codes, np.array([0])))]
        assert rounds == sorted(s for s in P._settle(codes, 0, len(codes)) if s[1] - s[0] >= P.WORDS)


def test_many_rounds_of_splitting():
    # each word stands three times beside the next one and once more further out, so parts split one after another
    words = []
    for k in range(200):
        words = [f"w{k}", *words, f"w{k}", f"w{k}", *([f"w{k}"] if k % 2 else [])]
    (runs, _, _), = ours([" ".join(words).encode()])
    assert runs == brute(words)


def test_long_texts_take_time_in_proportion():
    r = random.Random(1)
    block = [r.choice("abcdefghij") for _ in range(20_000)]
    texts = [" ".join(block * 5).encode(), b"a " * 200_000, " ".join(r.choice("ab") for _ in range(100_000)).encode()]
    t0 = time.time()
    out = ours(texts)
    assert time.time() - t0 < 20
    assert (0, 100_000, 20_000) in out[0][0]
    assert out[1][0] == [(0, 200_000, 1)] and out[1][1] == b"a"


def awkward():
    r = random.Random(5)
    words = lambda n: [r.choice(["on", "the", "é", "ß", "run,", "A"]) for _ in range(n)]
    rows = [(i, r.choice([" ", "\n", " \t "]).join(words(r.choice([0, 3, 30, 200])) + words(r.randint(1, 4)) * r.randint(0, 9))) for i in range(80)]
    return [*rows, (81, None), (82, ""), (83, " \n "), (None, "a a a a a a a"), (5, "b b b b b b"), (5, "b b b b b b"), (-7, "x y " * 8)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(collapse(words, runs)))


def test_query_against_brute_force(spark, tmp_path):
    rows = awkward()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = P.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((expected(*r) for r in rows), key=key)


def test_query_on_the_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = sorted(expected(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if len(r["text"] or "") < 4000)
    ids = {w[0] for w in want}
    got = sorted(tuple(r) for r in P.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect() if r["doc_id"] in ids)
    assert [g[1:] for g in got] == [w[1:] for w in want]


@pytest.mark.parametrize("extra", ["runs", "h", "text_", "DOC_ID_"])
def test_clashing_columns_and_empty_tables(spark, extra):
    from pyspark.sql import functions as F

    docs = frame(spark, [(1, "a a a a a a a b")]).withColumn(extra, F.lit("x"))
    (row,) = P.periodic_runs(docs).collect()
    assert row["runs"] == [(0, 7, 1)] and bytes(row["collapsed"]) == b"a b"
    assert P.periodic_runs(docs.where("false")).count() == 0
