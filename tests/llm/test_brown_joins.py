"""Tables that grow with the words below the list are never sent to the driver and broadcast, whatever size Spark guesses."""

from __future__ import annotations

import random

from helpers_llm import frame

from eventframe.llm import brown_lm


def test_unlisted_words_are_not_broadcast(spark, monkeypatch):
    r = random.Random(7)
    common = [f"w{i}" for i in range(8)]
    rows = [(i, " ".join(f"{r.choice(common)} rare{r.randrange(400)}x rare{r.randrange(400)}y" for _ in range(20))) for i in range(40)]
    docs = frame(spark, rows)
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    kind, cut = type(docs), brown_lm.cut
    collect = kind.collect

    def collected(df):
        plans.append(plan(df))
        found = collect(df)
        plans.append(plan(df))  # with what changed as it ran
        return found

    monkeypatch.setattr(kind, "collect", collected)
    monkeypatch.setattr(brown_lm, "cut", lambda df, name: plans.append(plan(df)) or cut(df, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        out = brown_lm.score(docs, brown_lm.fit(docs, most=10, classes=3, rounds=1)).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(out) == len(rows) and any(x.n_known == x.n_tokens for x in out)
    joins = [p for p in plans if "Join" in p]
    assert len(joins) >= 4  # classes, pairs of two such words, scores
    assert not [p for p in joins if "Broadcast" in p]
