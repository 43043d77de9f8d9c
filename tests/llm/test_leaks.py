import random

from tessellum.llm import leaks


def test_filter_loses_no_copy_with_long_added_words():
    rng = random.Random(5)

    def word(least, most):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(least, most)))

    rule, lost = leaks.Rule(), 0
    for _ in range(300):
        item = [word(3, 8) for _ in range(15)]
        copy = list(item)
        for k in rng.sample(range(1, 14), 2):
            copy[k] = word(3, 20)
        for _ in range(6):
            copy.insert(rng.randrange(1, len(copy)), word(9, 30))
        text = [word(3, 8) for _ in range(rng.randint(0, 200))] + copy + [word(3, 8) for _ in range(rng.randint(0, 200))]
        assert leaks.matches(item, text, rule)
        lost += leaks.Items([(1, " ".join(item))], rule).found(text) != [1]
    assert lost == 0


def test_blocks_of_items_do_not_change_answers(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    passages = [(n, " ".join(rng.choices(words, k=25))) for n in range(20)] + [(20, None), (21, "too short")]
    docs = [(n, " ".join(rng.choices(words, k=80)) + " " + passages[n % 20][1] + " " + passages[(n * 3) % 20][1][:60]) for n in range(30)]
    docs += [(30, None), (31, ""), (31, docs[0][1])]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(*r, "x") for r in passages], "item_id long, passage string, text string")
    got = [sorted(map(tuple, leaks.find(d, "doc_id", "text", items, "item_id", "passage", max_bytes=m).collect())) for m in (10**6, 900)]
    assert got[0] == got[1] and {(n, n % 20) for n in range(30)} <= set(got[0]) and (31, 0) in got[0]
    assert leaks.find(d, "doc_id", "text", items.where("item_id < 0"), "item_id", "passage").count() == 0


def test_long_tags_are_no_words():
    href = "https://a.example/" + "x" * 500
    assert leaks.normal_words(f'one <a href="{href}" title=\'a b\'>two</a> three') == ["one", "two", "three"]
    assert leaks.normal_words("a < b and c <d " + "e " * 200 + "> f")[:4] == ["a", "b", "and", "c"]
