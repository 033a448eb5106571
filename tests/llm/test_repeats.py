import hashlib
import random

import numpy as np
import pytest
from helpers_llm import DOCS, corpus, frame

from eventframe.llm import repeats, suffix_array, suffix_tree


def _remove_bytes(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, b in raw:
        for k in range(len(b) - length + 1):
            seen[b[k:k + length]] = seen.get(b[k:k + length], 0) + 1
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        spans = sum(g and not p for g, p in zip(gone, b"\0" + bytes(gone)))
        out.append((str(i), len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out)


def _remove_words(rows, width):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    order = lambda i: 2**63 - 1 if i is None else i
    for i, w in split:
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            least[key] = min(least.get(key, 2**63 - 1), order(i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if least[tuple(w[k:k + width])] < order(i):
                gone[k:k + width] = [True] * width
        out.append((str(i), len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out)


AWKWARD = [(500, "ab" * 300), (501, "x" * 900), (502, "one two " * 90), (503, "a" * 450 + " " + "a" * 120), (None, "ab" * 300), (None, "one two " * 90),
           (504, "\0" * 260), (505, "ü" * 210 + "ß")]


@pytest.mark.parametrize("length, large, target", [(200, 50_000, 4 << 20), (40, 50_000, 3_000), (7, 2, 500)])
def test_bytes_match_brute_force(spark, length, large, target):
    rows = corpus(3, n=50, passage=90) + AWKWARD + corpus(3, n=50)[:4]
    docs = frame(spark, rows).selectExpr("*", "1 as id", "2 as row", "3 as start", "4 as content", "5 as spans")
    out = suffix_array.remove_repeats(docs, length=length, large=large, target=target).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out) == _remove_bytes(rows, length)


@pytest.mark.parametrize("width, large, target", [(50, 50_000, 4 << 20), (12, 50_000, 3_000), (5, 2, 500)])
def test_words_match_brute_force(spark, width, large, target):
    rows = corpus(4, n=50, passage=90) + AWKWARD + corpus(4, n=50)[:4]
    docs = frame(spark, rows).selectExpr("*", "1 as id", "2 as row", "3 as start", "4 as content", "5 as spans")
    out = suffix_tree.remove_repeats(docs, width=width, large=large, target=target).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in out) == _remove_words(rows, width)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert suffix_array.remove_repeats(none).collect() == [] and suffix_tree.remove_repeats(none).collect() == []


def test_long_rows_are_cut_without_losing_windows(monkeypatch):
    monkeypatch.setattr(repeats, "_AT_ONCE", 300)
    shape = repeats.Shape(50, 8)
    r = np.random.default_rng(0)
    codes = r.integers(0, 5, 2_000).astype(np.uint64)
    covered = []
    for held, first in repeats.buffers([2_000, 10, 80], shape):
        joined = np.concatenate([codes[a:b] for _, a, b in held])
        start, windows, _ = repeats.anchors(joined, first, shape)
        at = np.searchsorted(first, start, side="right") - 1
        for s, n, k in zip(start, windows, at):
            row, a, _ = held[k]
            covered += [(row, s - first[k] + a + i) for i in range(n)]
    assert sorted(covered) == [(0, i) for i in range(1_951)] + [(2, i) for i in range(31)]


def test_equal_windows_have_equal_anchors():
    r = random.Random(2)
    shape = repeats.Shape(30, 4)
    base = [r.randint(0, 3) for _ in range(200)]
    texts = [base[:150], base[20:], [9] * 5 + base[60:120]]
    seen = {}
    for t in texts:
        codes = np.array(t, np.uint64)
        start, windows, anchor = repeats.anchors(codes, np.array([0, len(t)]), shape)
        for s, n, a in zip(start, windows, anchor):
            for i in range(n):
                assert seen.setdefault(tuple(t[s + i:s + i + 30]), a) == a


def test_two_stage_order_and_prefixes():
    r = random.Random(3)
    for _ in range(60):
        parts = [bytes(r.choice(b"ab\0c"[:r.randint(1, 4)]) for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 6))]
        text = b"".join(p.translate(bytes((i + 1) % 256 for i in range(256))) + b"\0" for p in parts)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        order = suffix_array.two_stage(text, ends)
        close = [int(ends[np.searchsorted(ends, i)]) + 1 for i in range(len(text))]
        assert order.tolist() == sorted(range(len(text)), key=lambda i: (text[i:close[i]], i))
        long = np.array([i for i in order if close[i] - i > 10], int)
        common = suffix_array.common_prefixes(text, long, 10)
        want = [next((k for k in range(10) if text[a + k] != text[b + k]), 10) for a, b in zip(long[1:], long)]
        assert common[1:].tolist() == want


def test_digests(spark, tmp_path):
    rows = corpus(6, n=30, passage=120)
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    want = {r[0]: r for r in _remove_words(rows, 50)}
    for r in suffix_tree.op4_suffix_tree(spark, str(tmp_path)).collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == (*want[str(r.doc_id)][1:3], hashlib.sha256(want[str(r.doc_id)][3].encode()).hexdigest())
    want = {r[0]: r for r in _remove_bytes(rows, 200)}
    for r in suffix_array.op7_suffix_array(spark, str(tmp_path)).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (*want[str(r.doc_id)][1:4], hashlib.sha256(want[str(r.doc_id)][4]).hexdigest())
