import random

import pytest
from helpers_llm import DOCS
from test_dedup import _classes, _fp, _norm

import corpus_pipeline
from eventframe.llm import pieces

ITEM = "The keeper of the old lighthouse counted every ship that passed the reef before the storm broke over the bay."


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with planted cases, a benchmark and labels, as a folder of tables."""
    r = random.Random(11)
    words = ["".join(r.choice("aeioutrnslmdp") for _ in range(r.randint(2, 8))) for _ in range(400)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    texts = {}
    for i in range(240):
        own = say(r.randint(60, 160))
        if i % 5 == 0:
            own.insert(r.randint(0, len(own)), r.choice(["grumblefox", "snarkhat"]))
        texts[i] = " ".join(own)
    clean = [i for i in texts if i % 5]
    texts[300] = texts[clean[0]].replace(" ", "  ")  # exact copies
    texts[301] = "\n" .join(texts[clean[1]].split(" "))
    texts[302] = " ".join([*texts[clean[2]].split(), "end"])  # may be a near copy
    texts[303] = " ".join(say(40) + [ITEM] + say(30))  # leaks
    texts[304] = None
    texts[305] = ""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    place = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(place + "/documents.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(place + "/benchmark.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i in range(240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(place + "/labels.parquet")
    return place, texts


def test_run_matches_brute_force(spark, tables):
    place, texts = tables
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, place).collect()}
    # toxicity by the planted words, exact copies, near copies by brute force, the leak
    left = {i: t for i, t in texts.items() if not any(w in (t or "") for w in ("grumblefox", "snarkhat"))}
    first = {}
    for i in sorted(left):
        first.setdefault(_norm(left[i]), i)
    left = {i: left[i] for i in first.values()}
    classes = _classes({i: _fp(t) for i, t in left.items()}, 2)
    left = {i: t for i, t in left.items() if classes[i] == i and i != 303}
    assert sorted(out) == sorted(left)
    decoder = pieces.Segmenter(pieces.Vocabulary.load(), 0.0, 0)
    for i, row in out.items():
        assert row.lossless and decoder.decode(pieces.np.array(row.ids, pieces.np.int32)) == (left[i] or "")


def test_stages_keep_the_columns(spark, tables):
    place, texts = tables
    docs = spark.read.parquet(place + "/documents.parquet").withColumns({"extra": pieces.F.lit(1), "key": pieces.F.lit("x")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, place)
        assert out.columns == docs.columns and 0 < out.count() <= len(texts), name
        none = stage(spark, docs.where("false"), place)
        assert none.columns == docs.columns and none.count() == 0, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "sentencepiece"]
