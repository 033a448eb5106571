import numpy as np
from helpers_llm import frame

from eventframe.llm import pieces

VOCABULARY = pieces.Vocabulary.load()
WORD = " misunderstanding"


def _by_place(s, text, variant):
    """Each occurrence segmented anew by the heap, with its own key."""
    import xxhash
    of = np.uint64(xxhash.xxh64_intdigest((variant & (2**64 - 1)).to_bytes(8, "little"), s.seed))
    out = []
    for i, c in enumerate(s.chunk.findall(" " + text)):
        out += s._agenda(c, pieces.mix64(np.atleast_1d(of ^ pieces.mix64(np.array([i], np.uint64))))[0]).tolist()
    return out


def test_occurrences_vary_within_a_document_and_match_the_heap():
    s = pieces.Segmenter(VOCABULARY, 0.1, 7)
    text = (WORD * 300 + " the cat 日本語 " + "x" * 50 + " ☃").strip()
    for variant in (3, -5):
        ids = s.encode([text, "other words", text], [variant, 1, variant])
        assert ids[0].tolist() == ids[2].tolist() == _by_place(s, text, variant)
        assert s.decode(ids[0]) == text
    forms = set()
    for variant in range(40):
        forms.add(tuple(s.encode(["a" + WORD * 2], [variant])[0].tolist()))
    assert len(forms) > 8  # more than the eight keys there once were
    kept = s.encode([text], [3])[0].tolist()
    plain = pieces.Segmenter(VOCABULARY, 0.0, 7).encode([WORD[1:]], [0])[0].tolist()
    whole = sum(kept[i:i + len(plain)] == plain for i in range(len(kept)))
    assert 0 < whole < 300  # some occurrences are cut, some are not


def test_documents_have_keys_of_their_own(spark):
    rows = [(i, (WORD * 5).strip()) for i in range(60)]
    assert len({tuple(r.ids) for r in pieces.encode(frame(spark, rows)).collect()}) > 8
