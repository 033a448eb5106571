"""Short benchmark items, two-way slots, and texts of a megabyte."""

import base64
import time

import pytest

from eventframe.llm import decontaminate, exact_dedup, secrets, simhash

ITEMS = [(1, "Who wrote Hamlet?"), (2, "Early today Anna gave the red ball to Bob and later Anna took the same red ball from Bob again."),
         (3, "Yes."), (4, "7 8 9 10 11 12"), (5, None)]


def _found(spark, texts, **kw):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = decontaminate.judge(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), **kw)
    return {r.doc_id: r.item_ids for r in out.collect()}


def test_short_items_are_found_whole_and_names_stay_apart(spark):
    texts = ["Well, who wrote Hamlet then?", "who wrote the play Hamlet", "Yes. No.", None, "", "one 7 8 9 10 11 12.", "7 8 9 10 11",
             ITEMS[1][1].replace("Anna", "Carl").replace("Bob", "Dora"), ITEMS[1][1].replace("Anna", "Carl").replace("Bob", "Carl"),
             "who wrote hamlet " * 3]
    assert _found(spark, texts, short=True) == {0: [1], 1: [], 2: [], 3: [], 4: [], 5: [4], 6: [], 7: [2], 8: [], 9: [1]}
    assert _found(spark, texts[:2]) == {0: [], 1: []}


@pytest.mark.parametrize("part", ["card", "visa ", "iban", "IBAN DE00AAAA1111", "eyJ", "eyJ.", "token", "secret ="])
def test_secrets_in_a_megabyte_of_one_keyword(part):
    text = part * (1_000_000 // len(part)) + "\ncard 4111 1111 1111 1111"
    start = time.process_time()
    spans = secrets.find(text, secrets.automaton())
    assert time.process_time() - start < 3
    assert ("card", len(text) - 19, len(text)) in spans


def test_secrets_of_nested_headers():
    header = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    good, deep = header('{"alg":"none"}') + ".eyJ4.x", header('{"a":' + "[" * 2900) + ".eyJ4.x"
    spans = secrets.find(f"{deep} {good}", secrets.automaton())
    assert [s for s in spans if s[0] == "jwt"] == [("jwt", len(deep) + 1, len(deep) + 1 + len(good))]


def test_long_texts_are_read_to_their_end(spark):
    long = "word soup " * 100_000
    docs = spark.createDataFrame([(1, long + "end one"), (2, long + "end two"), (3, long + " end  one")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup.dedup(docs).collect()} == {1: 1, 2: 2, 3: 1}
    prints = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.near_dups(docs).collect()}
    assert prints[1] == prints[3] == simhash.fingerprint(long + "end one") & (1 << 64) - 1
    texts = [long + "who wrote hamlet", long]
    assert _found(spark, texts, short=True) == {0: [1], 1: []}
