import pytest
from helpers_llm import frame

from eventframe.llm import decontaminate

ITEMS = [(0, "Anna has 3 red apples. Bob has 4 green pears. Carl eats 2 of them. How many are left for Anna and Bob?"),
         (1, "The shop sells a coat for $15 and a hat for €20. A scarf costs 30€ there. Is the sum below $90.50?")]


def _judge(spark, rows):
    out = decontaminate.judge(frame(spark, rows), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    return {r.doc_id: (r.item_ids, r.changed_item_ids) for r in out}


def test_names_at_sentence_starts_and_currency(spark):
    names = ITEMS[0][1].replace("Anna", "Dora").replace("Bob", "Egon").replace("Carl", "Fritz")
    money = ITEMS[1][1].replace("$15", "$25").replace("€20", "€35").replace("30€", "45€").replace("$90.50", "$99.75")
    got = _judge(spark, [(0, names), (1, "Words before. " + money + " Words after."), (2, ITEMS[0][1]), (3, ITEMS[1][1])])
    assert got == {0: ([0], [0]), 1: ([1], [1]), 2: ([0], []), 3: ([1], [])}


@pytest.mark.parametrize("word", ["$15", "$15.", "€20", "20€", "£3.50,", "($1,000)", "-$4", "$.50"])
def test_amounts_are_numbers(word):
    tokens = decontaminate.Tokens()
    codes, kinds = tokens.template([b"costs", word.encode(), b"today"])[0]
    assert kinds.tolist() == [0, 1, 0] and int(codes[1]) == decontaminate._NUM
