import numpy as np

from eventframe.llm import toxicity


def test_insult_after_240_spaced_letters():
    bags = toxicity.Bags(toxicity.Landmarks(["grumblefox"]))
    calm = "s e a " * 100
    found = bags.texts([calm, calm + " ".join("grumblefox"), " ".join("grumblefox") + " " + calm])[:, 0]
    assert found[0] == 0 and found[1] > 1e-3 and found[2] > 1e-3


def test_end_of_a_long_word_in_a_wide_script():
    end = "悪口雑言罵"
    bags = toxicity.Bags(toxicity.Landmarks([end]))
    for size in (17, 22, 24, 31):
        word = "".join(chr(0x3042 + i % 40) for i in range(size - len(end)))
        found = bags.texts([word + "".join(map(chr, range(0x3042, 0x3042 + len(end)))), word + end])[:, 0]
        assert found[1] > 2 * found[0] and found[1] > 1e-3, size
    wide = toxicity._padded(["\U0001f600" * 24], -1)
    assert wide[1].tolist() == [96] and not np.any(wide[0] == -1)


def test_letters_with_marks_between():
    assert "grumble" in toxicity.bag("so g . r . u *** m - b . l . e it is")
    assert toxicity.bag("g . r and u . m") == {"g", ".", "r", "and", "u", "m"}
    bags = toxicity.Bags(toxicity.Landmarks(["^grumble$"]))
    found = bags.texts([" . ".join("grumble"), "grumble"])[:, 0]
    assert found[0] == found[1] > 0.9
