import math
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from helpers_llm import DOCS, corpus, frame

from eventframe.llm import brown_lm, decontaminate, pieces, toxicity

ITEMS = [(0, "Anna sold 12 apples to Bob for 30 dollars on a sunny market day. How many apples are left if Bob had 50 apples before Bob came?"),
         (1, "A train leaves the old station at 7 and travels 120 km before the next stop in the valley near the river."),
         (2, "too short"), (3, None), (None, "a row without identifier is not searched for in any of the documents here")]
OTHER = ITEMS[0][1].replace("Anna", "Carla").replace("Bob", "Dieter").replace("12", "17").replace("30", "95").replace("50", "80")
MIXED = ITEMS[0][1].replace("if Bob", "if Egon")  # one value in two ways


CASES = [
    (ITEMS[0][1], [0], []), ("Some words first. " + OTHER + " Some words after.", [0], [0]), (MIXED, [], []),
    (ITEMS[0][1] + "\n" + OTHER + " " + ITEMS[1][1].upper().lower(), [0, 1], []), (ITEMS[1][1].replace("7", "9").replace("120 km", "64 miles"), [1], [1]),
    (" ".join(ITEMS[1][1].split()[:12]), [], []), ("too short", [], []), ("", [], []), (None, [], []), ("clean words only here in this text", [], [])]


def test_templates(spark):
    rows = [(i, t) for i, (t, _, _) in enumerate(CASES)] + [(None, CASES[0][0]), (4, CASES[4][0])]  # the last one is a repeated row
    docs = frame(spark, rows).selectExpr("*", "1 as key", "2 as hash", "3 as item_id", "4 as slots")
    bench = spark.createDataFrame(ITEMS + ITEMS[:1], "item_id long, text string")
    out = decontaminate.judge(docs, bench).collect()
    got = {r.doc_id: (r.item_ids, r.changed_item_ids, r.contaminated) for r in out}
    assert len(out) == len(rows) and got.pop(None) == ([0], [], True)
    assert got == {i: (items, changed, bool(items)) for i, (_, items, changed) in enumerate(CASES)}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [i for i, c in enumerate(CASES) if not c[1]]


def test_templates_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, [(1, "a b c d e f g"), (1, "a b c d e f g")])
    assert [r.contaminated for r in decontaminate.judge(docs, bench).collect()] == [False, False]
    assert decontaminate.judge(spark.createDataFrame([], DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []


def test_planted_items_against_brute_force(spark):
    r = random.Random(0)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(500)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(16, 50))).capitalize() + ".") for i in range(12)]
    docs, want = [], {}
    for i in range(60):
        own = [r.choice(words) for _ in range(r.randint(0, 200))]
        here = r.sample(items, r.choice([0, 0, 1, 2]))
        for _, t in here:
            at = r.randint(0, len(own))
            own[at:at] = [t] if r.random() < 0.7 else [" ".join(t.split()[:len(t.split()) // 2])]
        docs.append((i, " ".join(own)))
        want[i] = sorted(k for k, t in items if t in docs[-1][1])
    out = decontaminate.judge(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: r.item_ids for r in out} == want


# ---- pieces

VOCABULARY = pieces.Vocabulary.load()
SAMPLES = ["", " ", "   ", "Hello world", "  a  b \n\n c\t", "日本語 x é ﬁ ① 🙂", "a▁b ▁", "x" * 200 + "yz" * 50, "\0\x01", "The end.\r\nNext  line", "ààà ́"]


def test_no_dropout_equals_the_library():
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [t for t in SAMPLES if "▁" not in t] + [t or "" for _, t in corpus(7, 20)]
    s = pieces.Segmenter(VOCABULARY, 0.0, 1)
    for t, ids in zip(texts, s.encode(texts, [0] * len(texts))):
        assert ids.tolist() == model.encode(t), t


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_lossless_and_both_ways_agree(dropout):
    s = pieces.Segmenter(VOCABULARY, dropout, 5)
    texts = SAMPLES + [t or "" for _, t in corpus(8, 20)]
    for v in (0, 3):
        for t, ids in zip(texts, s.encode(texts, [v] * len(texts))):
            assert s.decode(ids) == t
    chunks = sorted({c for t in texts for c in s.chunk.findall(" " + t) if len(c) <= 32 and all(s.single[ord(x)] >= 0 for x in c)})
    ids, length = s.together(chunks, 3)
    for part, c in zip(np.split(ids, np.cumsum(length)[:-1]), chunks):
        assert part.tolist() == s.agenda(c, 3).tolist()


def test_dropout_varies_by_seed_and_variant_only():
    text = ["international misunderstanding of tokenization " * 5]
    run = lambda seed, v: pieces.Segmenter(VOCABULARY, 0.3, seed).encode(text, [v])[0].tolist()
    assert run(1, 0) == run(1, 0) and run(1, 0) != run(2, 0) and run(1, 0) != run(1, 1)
    assert len(run(1, 0)) > len(pieces.Segmenter(VOCABULARY, 0.0, 1).encode(text, [0])[0])


def test_pieces_frame(spark):
    rows = [*enumerate(SAMPLES), (None, "null id"), (3, "Hello world"), (99, None)]
    docs = frame(spark, rows).selectExpr("*", "1 as ids", "2 as key", "3 as lossless")
    out = pieces.encode(docs)
    back = pieces.decode(out).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in rows)
    assert all(r.lossless for r in back)
    assert len({tuple(r.ids) for r in back if r.doc_id == 3}) == 1
    assert pieces.encode(spark.createDataFrame([], DOCS)).collect() == []


# ---- toxicity

def _kernel(s, t, n, decay):
    from itertools import combinations
    total = 0.0
    for i in combinations(range(len(s)), n):
        for j in combinations(range(len(t)), n):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_matches_all_subsequences():
    r = random.Random(1)
    a = ["".join(r.choice("abc") for _ in range(r.randint(1, 8))) for _ in range(40)]
    b = ["".join(r.choice("abc") for _ in range(r.randint(1, 8))) for _ in range(40)]
    got = toxicity.kernel(toxicity._padded(a, -2)[0], toxicity._padded(b, -1)[0])
    assert np.allclose(got, [_kernel(x, y, 3, toxicity.DECAY) for x, y in zip(a, b)], rtol=1e-4)
    same = toxicity.Landmarks(["^idiot$"]).features(["^idiot$", "^id-io.t$", "^idixot$", "^table$", ""])[:, 0]
    assert same[0] == pytest.approx(1, abs=1e-4) and same[1] > 0.1 and same[2] > 0.2 and same[3] == same[4] == 0


def _labelled(n=600):
    r = random.Random(4)
    words = ["".join(r.choice("aeioutrnslmdp") for _ in range(r.randint(2, 8))) for _ in range(300)]
    bad = ["grumblefox", "snarkhat", "zibblewurm"]
    rows, labels = [], []
    for i in range(n):
        own = [r.choice(words) for _ in range(r.randint(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            w = r.choice(bad)
            k = r.randint(2, len(w) - 2)
            own.insert(r.randint(0, len(own)), w if r.random() < 0.7 else w[:k] + r.choice(".-x") + w[k:])
        rows.append((i, " ".join(own)))
        labels.append((i, 0, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = _labelled()
    extra = [(None, "grumblefox"), (10_000, None), (10_001, ""), (10_002, "g r u m b l e f o x"), (10_002, "g r u m b l e f o x")]
    lab = spark.createDataFrame([*labels, (0, 0, 1), (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows + extra).selectExpr("*", "1 as label", "2 as x", "3 as toxic")
    out = toxicity.judge(docs, lab).collect()
    assert len(out) == len(rows) + len(extra)
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert len(held) > 80 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    by = {r.doc_id: r for r in out if r.doc_id not in truth}
    assert by[None].predicted == 1 and by[10_000].predicted == by[10_001].predicted == 0 and by[10_002].predicted == 1
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in out)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, [(1, "a"), (2, None)])
    assert [r.score for r in toxicity.judge(docs, none).collect()] == [0.0, 0.0]
    assert toxicity.clean(docs, none).count() == 2
    assert toxicity.judge(spark.createDataFrame([], DOCS), none).collect() == []


# ---- class bigrams

def test_brown_scores_match_brute_force(spark):
    rows = [*corpus(9, 60, vocabulary=80), (None, "a b"), (77, "unseen-word-zz zz"), (77, "unseen-word-zz zz")]
    docs = frame(spark, rows).selectExpr("*", "1 as word", "2 as n", "3 as row")
    model = brown_lm.fit(docs, most=40, clustered=20, classes=4, rounds=3)
    assert len(model.words) <= 40 and model.clustered == 20
    out = brown_lm.score(docs, model).collect()
    count = {}
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    for i, t in rows:
        if train(i):
            for w in brown_lm.tokens(t):
                count[w] = count.get(w, 0) + 1
    total, distinct = sum(count.values()), len(count)
    number = {int(w): k for k, w in enumerate(model.words)}
    cls = lambda w: int(model.of[number[brown_lm.key(w)]]) if number.get(brown_lm.key(w), 99) < 20 else 4 + brown_lm.shape(w)
    sizes = len(model.mass)
    pairs, mass, kinds = np.zeros((sizes, sizes)), np.zeros(sizes), np.zeros(sizes)
    for i, t in rows:
        if train(i):
            own = brown_lm.tokens(t)
            for a, b in zip([own[-1], *own], own):
                pairs[cls(a), cls(b)] += 1
    for w, n in count.items():
        mass[cls(w)] += n
        kinds[cls(w)] += 1
    own_share = (mass + 0.5) / (mass + 0.5).sum()
    want = []
    for i, t in rows:
        own = brown_lm.tokens(t)
        base = sum(math.log10((count.get(w, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        value = 0.0
        for a, b in zip([own[-1], *own], own):
            ca, cb = cls(a), cls(b)
            value += math.log10((pairs[ca, cb] + sizes * own_share[cb]) / (pairs[ca].sum() + sizes))
            value += math.log10((count.get(b, 0) + 0.5) / (mass[cb] + 0.5 * (kinds[cb] + 1)))
        want.append((str(i), not train(i), len(own), sum(w in count for w in own), total, round(base, 6), round(value, 6)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in out]
    assert sorted(got) == sorted(want)


def test_exchange_finds_planted_classes(spark):
    r = random.Random(5)
    names, verbs = [f"name{i}" for i in range(12)], [f"verb{i}" for i in range(12)]
    rows = [(i, " ".join(r.choice(names) + " " + r.choice(verbs) for _ in range(60))) for i in range(60)]
    model = brown_lm.fit(frame(spark, rows), most=100, clustered=25, classes=3, rounds=8)
    of = {int(w): int(model.of[k]) for k, w in enumerate(model.words[:25])}
    name, verb = ({of[brown_lm.key(w.encode())] for w in g} for g in (names, verbs))
    assert len(name) <= 2 and len(verb) <= 2 and not name & verb


def test_brown_without_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    docs = frame(spark, [(held, "a b"), (None, None)])
    out = brown_lm.score(docs, brown_lm.fit(docs)).collect()
    assert all(r.train_tokens == r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in out)
    none = spark.createDataFrame([], DOCS)
    assert brown_lm.score(none, brown_lm.fit(none)).collect() == []


def test_every_training_word_is_clustered(spark):
    """Words far down the frequency list, and words below it, follow their neighbours' classes."""
    r = random.Random(6)
    names, verbs = [f"n{i}x" for i in range(1500)], [f"v{i}x" for i in range(1500)]
    rows = [(i, " ".join(r.choice(names) + " " + r.choice(verbs) for _ in range(150))) for i in range(250)]
    rows += [(1000 + i, f"rare{i}a {r.choice(verbs)} {r.choice(names)} rare{i}b") for i in range(60)]
    docs = frame(spark, rows)
    model = brown_lm.fit(docs, most=3001, classes=3)
    assert len(model.words) <= 3001 and model.clustered == len(model.words) > 1024 and (model.of < 3).all()
    kind = {brown_lm.key(w.encode()): w[0] for w in names + verbs}
    of = {int(w): int(c) for w, c in zip(model.words, model.of)}
    rest = {x.word: x for x in model.rest.collect()}
    assert rest and all(x["class"] < 3 for x in rest.values())
    of.update((w, x["class"]) for w, x in rest.items())
    count = {k: [sum(of[w] == c for w in of if kind.get(w) == k) for c in range(3)] for k in "nv"}
    assert all(max(c) > 0.6 * sum(c) for c in count.values()), count
    assert max(range(3), key=count["n"].__getitem__) != max(range(3), key=count["v"].__getitem__)
    trained = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    assert len(of) == len({w for _, t in trained for w in brown_lm.tokens(t)})
    # the transitions behind the scores hold every pair of neighbours
    pairs = np.zeros((len(model.mass),) * 2)
    for _, t in trained:
        c = [of[brown_lm.key(w)] for w in brown_lm.tokens(t)]
        np.add.at(pairs, ([c[-1], *c[:-1]], c), 1)
    seen = [x for x in brown_lm.score(docs, model).collect() if not x.held_out]
    total = np.zeros(len(model.mass))
    kinds = np.zeros(len(model.mass))
    words = {}
    for _, t in trained:
        for w in brown_lm.tokens(t):
            words[w] = words.get(w, 0) + 1
    for w, n in words.items():
        total[of[brown_lm.key(w)]] += n
        kinds[of[brown_lm.key(w)]] += 1
    share = (total + 0.5) / (total + 0.5).sum()
    steps = np.log10((pairs + len(share) * share) / (pairs.sum(1, keepdims=True) + len(share)))
    text = dict(rows)
    for x in seen[::20]:
        own = brown_lm.tokens(text[x.doc_id])
        c = [of[brown_lm.key(w)] for w in own]
        want = sum(steps[a, b] for a, b in zip([c[-1], *c], c)) + sum(math.log10((words[w] + 0.5) / (total[k] + 0.5 * (kinds[k] + 1))) for w, k in zip(own, c))
        assert x.score == pytest.approx(want) and x.n_known == len(own)


def test_frequency_list_with_high_and_equal_counts(spark):
    high = spark.createDataFrame([(i, 0, 200_000 + i) for i in range(20)], "word long, shape int, n long")
    words, counts, _ = brown_lm.frequent(high, 8)
    assert words.tolist() == list(range(19, 11, -1)) and counts[0] == 200_019
    equal = spark.createDataFrame([(i, 0, 3) for i in range(20)], "word long, shape int, n long")
    words, _, listed = brown_lm.frequent(equal, 8)
    assert words.tolist() == list(range(8)) and equal.where(~listed).count() == 12
