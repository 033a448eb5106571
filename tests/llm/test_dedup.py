import hashlib
import re

import numpy as np
import pytest
import xxhash
from helpers_llm import DOCS, corpus, frame

from eventframe.llm import exact_dedup, simhash
from eventframe.llm.components import components


def _norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def test_exact_groups_match_brute_force(spark):
    rows = corpus(1)
    out = {r.doc_id: r for r in exact_dedup.dedup(frame(spark, rows)).collect()}
    assert len(out) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(_norm(t), []).append(i)
    for t, ids in groups.items():
        for i in ids:
            r = out[i]
            assert (r.keep_id, r.group_size, r.kept) == (min(ids), len(ids), i == min(ids))
            assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_ties_null_ids_and_extra_columns(spark):
    rows = [(7, "a b"), (7, "a  b"), (None, "a\nb"), (None, "z"), (3, None), (2, "")]
    docs = frame(spark, rows).selectExpr("*", "'x' as digest", "1 as keep", "2 as size", "doc_id as id", "7 as _id", "8 as _digest")
    out = exact_dedup.dedup(docs).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in out) == sorted(
        [("7", "7", 3), ("7", "7", 3), ("None", "7", 3), ("None", "None", 1), ("3", "2", 2), ("2", "2", 2)])
    assert sum(r.kept for r in out if r.keep_id == 7) == 1
    left = exact_dedup.keep_first(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "7", "None"]


def test_exact_empty_table(spark):
    assert exact_dedup.dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_state_spans_micro_batches(spark, tmp_out):
    for i, part in enumerate(([(1, "d1"), (5, "d2")], [(0, "d1"), (9, "d3")], [(4, "d1")])):
        spark.createDataFrame([(a, d, 10 * i) for a, d in part], "id long, digest string, locator long").coalesce(1).write.mode("append").parquet(tmp_out + "/f")
    schema = spark.read.parquet(tmp_out + "/f").schema
    out = exact_dedup.stream_state(spark, tmp_out + "/f", schema, batches=3)
    assert {r.digest: (r.keep.id, r["size"]) for r in out.collect()} == {"d1": (0, 3), "d2": (5, 1), "d3": (9, 1)}


def test_unequal_texts_under_one_digest_are_split(spark, monkeypatch):
    from pyspark.sql import functions as F

    from eventframe.llm import exact_dedup as e
    real = F.sha2
    monkeypatch.setattr(e.F, "sha2", lambda c, n: F.lit("0" * 64))
    out = e.dedup(frame(spark, [(1, "a"), (2, "b"), (3, "a"), (4, "b")])).collect()
    monkeypatch.setattr(e.F, "sha2", real)
    assert {r.doc_id: r.keep_id for r in out} == {1: 1, 2: 2, 3: 1, 4: 2}


def _fp(text, width=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def _classes(fps, budget):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for x in ids:
        for y in ids:
            if x < y and bin(fps[x] ^ fps[y]).count("1") <= budget:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("budget", [0, 2, 6])
def test_simhash_matches_brute_force(spark, budget):
    rows = corpus(2, n=80)
    out = {r.doc_id: r for r in simhash.near_dups(frame(spark, rows), budget=budget).collect()}
    fps = {i: _fp(t) for i, t in rows}
    assert {i: r.fp % 2**64 for i, r in out.items()} == fps
    assert {i: r.component_id for i, r in out.items()} == _classes(fps, budget)


def test_simhash_edge_cases(spark):
    docs = frame(spark, [(1, "a b c d"), (1, "a b c d"), (None, "x"), (2, None), (4, "A  B\tc d")]).selectExpr("*", "1 as fp", "2 as node", "3 as _gone")
    out = simhash.near_dups(docs).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in out) == [("1", "1"), ("1", "1"), ("2", "2"), ("4", "1"), ("None", "None")]
    assert sorted(str(r.doc_id) for r in simhash.keep_first(docs).collect()) == ["1", "1", "2", "None"]
    assert simhash.near_dups(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("depth", [0, 21])
def test_trie_pairs_dense_ball(depth):
    r = np.random.default_rng(0)
    values = np.unique(np.concatenate([(np.uint64(1) << r.integers(0, 40, 300).astype(np.uint64)) | (np.uint64(1) << r.integers(0, 40, 300).astype(np.uint64)), r.integers(0, 2**63, 200, dtype=np.uint64)]))
    a, b = simhash.trie_pairs(values, depth, 2)
    got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    lead = values >> np.uint64(64 - depth) if depth else values * 0
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if lead[i] == lead[j] and int(values[i] ^ values[j]).bit_count() <= 2}
    assert got == want and len(a) == len(want)


def test_components_long_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(200, 400)] + [(7, 7)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(200, 400)}
