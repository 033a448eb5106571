import numpy as np
import pyarrow as pa
import pytest
from helpers_llm import corpus

from eventframe.llm import brown_lm, words

TEXTS = ["", "a b", " x\n\ty ", None, "ab", "cd", "É ÀB ß x \x1c\x85 z", "  ", " ".join("q" * i + "Z" for i in range(70)), "AbC" * 11, None, *(t for _, t in corpus(3, 20))]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("a, b", [(0, len(TEXTS)), (3, 9), (0, 1), (3, 4), (0, 0)])
def test_words_of_a_batch_are_those_of_each_text(kind, a, b):
    """Also over Arrow slices, and words that end where the next text begins."""
    own = [brown_lm.tokens(t) for t in TEXTS[a:b]]
    keys, last, many = words.words(pa.array(TEXTS, kind).slice(a, b - a))
    assert many.tolist() == [len(w) - 1 for w in own]
    assert keys.tolist() == [brown_lm.key(w) for o in own for w in o[:-1]]
    assert brown_lm._shapes()[last].tolist() == [brown_lm.shape(w) for o in own for w in o[:-1]]
    keys, shapes, many = brown_lm.sequence(pa.array(TEXTS, kind).slice(a, b - a))
    assert many.tolist() == list(map(len, own)) and keys.tolist() == [brown_lm.key(w) for o in own for w in o]
    assert shapes.tolist() == [brown_lm.shape(w) for o in own for w in o]


def test_places_of_words_in_a_list():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(-2**63, 2**63 - 1, 3000))
    listed = r.permutation(np.append(keys[::2], [keys[1], 2**63 - 1, -2**63]))
    at = {k: i for i, k in enumerate(listed.tolist())}
    asked = np.concatenate([keys, listed, keys + 1])
    assert brown_lm.Lookup(listed)(asked).tolist() == [at.get(k, -1) for k in asked.tolist()]
    assert brown_lm.Lookup(np.empty(0, np.int64))(keys).tolist() == [-1] * len(keys)


@pytest.mark.parametrize("most", [0, 1, 255, 256, 70_000, 2**33])
def test_blocks_keep_their_counts(most):
    sums = np.array([0, most, 0, 3, 0])
    (b, cells, counts), = brown_lm._cells([brown_lm._block(4, sums)])
    back = np.zeros(5, np.int64)
    back[cells] = counts
    assert b == 4 and back.tolist() == sums.tolist()
