"""Small documents with the awkward cases, and brute-force versions shared by the tests."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


def frame(spark, rows, parts=3):
    """Documents from (doc_id, text) pairs."""
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


def corpus(seed=0, n=60, vocabulary=400, passage=70):
    """(doc_id, text): random documents, copies, near copies, shared passages, nulls and empties."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéñ ßfghiklmnoprstu".replace(" ", "")) for _ in range(r.randint(1, 8)))
    words = [word() for _ in range(vocabulary)]
    shared = [r.choice(words) for _ in range(passage)]
    out = []
    for i in range(n):
        kind = r.random()
        if kind < 0.1 and out:
            text = r.choice(out)[1]
        elif kind < 0.25 and out and (base := r.choice(out)[1]):
            own = base.split(" ")
            own[r.randrange(len(own))] = word()
            text = " ".join(own)
        else:
            own = [r.choice(words) for _ in range(r.choice([0, 1, 3, 40, 120, 300]))]
            if r.random() < 0.3:
                at = r.randint(0, len(own))
                own[at:at] = shared[r.randint(0, 10):]
            text = r.choice([" ", "  ", "\n"]).join(own)
        out.append((i * 3 % n if n % 3 else i, text))
    return [*out, (n + 1, None), (n + 2, ""), (n + 3, " \n\t "), (n + 4, None), (n + 5, "Solo"), (n + 6, "solo")]
