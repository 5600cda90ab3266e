from shelfspark.llm import leak


def shares(items, text):
    return dict(leak.Index([(i, leak.tokens(t)) for i, t in items]).search(text))


def test_short_items_inside_longer_documents():
    text = "they saw that the quick otter swam away before the long cold winter came"
    got = shares([(1, "quick otter"), (2, "otter"), (3, "the slow otter"), (4, "quick otter swam away")], text)
    assert got == {1: 1.0, 2: 1.0, 4: 1.0}
    assert shares([(1, "quick otter swam away")], "quick otter swam away") == {1: 1.0}
    # a third of an item of 6, 9 and 12 words is 2, 3 and 4 words
    for n in (6, 9, 12):
        words = [f"w{k}" for k in range(n)]
        text = "a b " + " ".join(words[2 : 2 + n // 3]) + " c d e f g"
        assert shares([(1, " ".join(words))], text)[1] >= leak.THIRD
    assert shares([(1, "a b c d e f")], "") == {}
