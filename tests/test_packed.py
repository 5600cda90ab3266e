import pytest

from shelfspark.operators.packed import Model, blocks, chunks, shape, tidy, unpack, weighed

LISTS = [f"Alpha{c}, Beta{c}; Gamma{c}, Delta{c}" for c in "abcdefgh"] + [f"Ann{c} Bell{c}" for c in "abcdefgh"] + [f'"Wood{c}, Ada"' for c in "abcdefgh"] + [f"Stone{c}, B." for c in "abcdefgh"]


def run(spark, rows):
    df = spark.createDataFrame([(k, a, w, t, "clash") for k, (a, w, t) in enumerate(rows)], "import_id bigint, author string, keywords string, tags string, field string")
    out = {}
    for r in unpack(df).collect():
        out.setdefault((r.import_id, r.field), []).append((r.pos, r.val))
    return {k: [v for _, v in sorted(x)] for k, x in out.items()}


def test_all_forms(spark):
    rows = [(a, None, None) for a in LISTS] + [
        ("Stone, B., Wood, C. & Alder, D.", 'a; b;; "x; y" | {p, q}\tthe "odd" one', "#one#two three #four"),
        ("Ann Bell, Bob Hill and Cy Dale", "R&D, TCP/IP, left / right /", '["one", "two words"]'),
        ("{Society for This and That} and Alpha, Beta", '"say ""hi"" now", \'s, t\'', "q&a; x/y"),
        (None, "", "  "),
        ("", " ; , ", ",,"),
        *[("Ann Bell", "R&D; TCP/IP; supply and demand", "q&a")] * 5,
    ]
    got = run(spark, rows)
    at = len(LISTS)
    assert got[at, "author"] == ["Stone, B.", "Wood, C.", "Alder, D."]
    assert got[at, "keywords"] == ["a", "b", "x; y", "p, q", 'the "odd" one']
    assert got[at, "tags"] == ["one", "two three", "four"]
    assert got[at + 1, "author"] == ["Ann Bell", "Bob Hill", "Cy Dale"]
    assert got[at + 1, "keywords"] == ["R&D", "TCP/IP", "left", "right"]
    assert got[at + 1, "tags"] == ["one", "two words"]
    assert got[at + 2, "author"] == ["Society for This and That", "Alpha, Beta"]
    assert got[at + 2, "keywords"] == ['say "hi" now', "s, t"]
    assert not any(k[0] in (at + 3, at + 4) for k in got)
    assert got[at + 5, "keywords"] == ["R&D", "TCP/IP", "supply and demand"]


def test_long_repeated_and_empty(spark):
    long = "; ".join(["word"] * 20_000)
    got = run(spark, [(None, long, None), (None, "word; word", None), (None, "word; word", None)])
    assert len(got[0, "keywords"]) == 20_000 and got[1, "keywords"] == got[2, "keywords"] == ["word", "word"]
    assert run(spark, []) == {}


@pytest.mark.parametrize("text,want", [('"a b"', "a b"), ("{x}", "x"), ("#tag", "tag"), ('"say ""x"""', 'say "x"'), ("'q'", "q"), ("plain", "plain"), ("", "")])
def test_tidy(text, want):
    assert tidy(text) == want


def test_chunks_keep_spans():
    cs, seps = chunks('"a, b"; c', "keywords")
    assert [c[2] for c in cs] == [True, False] and seps == ["h"]


def test_a_known_value_of_many_chunks_stays_whole(spark):
    office = "Office of Research, Training, Records, Archives and Maps"
    names = [(a, None, None) for a in LISTS]
    got = run(spark, [*names, *[("{" + office + "}", None, None)] * 6, (office, None, None), (f"Stone, B. and {office}", None, None)])
    at = len(LISTS) + 6
    assert got[at, "author"] == [office] and got[at + 1, "author"] == ["Stone, B.", office]
    keys = [(None, "a/b/c/d/e/f", None)] * 4 + [(None, "x; a/b/c/d/e/f", None)]
    assert run(spark, keys)[4, "keywords"] == ["x", "a/b/c/d/e/f"]


def test_rare_values_reach_the_last_step(spark):
    """With a model that holds nearly no value, those met twice still come by a join."""
    office = "Board of Rivers, Roads, Mines, Docks and Parks"
    rows = [(a, None, None) for a in LISTS * 3] + [("{" + office + "}", None, None)] * 3 + [(office, None, None)]
    df = spark.createDataFrame([(k, a, w, t) for k, (a, w, t) in enumerate(rows)], "import_id bigint, author string, keywords string, tags string")
    got = [r.val for r in unpack(df, theta=0.04).where(f"import_id = {len(rows) - 1}").collect()]
    assert got == [office]


def test_joined_shapes_are_shapes_of_joins():
    s = "van Dyk, A. B. and Stone & Sons, 9 Hill/Vale"
    cs, seps, spans = blocks(s, "author")
    model = Model({}, {}, {}, {"author": 9})
    model.shapes = {("author", shape(s[cs[i][0] : cs[j - 1][1]])): 0.1 for i in range(len(cs)) for j in range(i + 1, len(cs) + 1)}
    for i, j, v, x, _ in weighed(s, "author", cs, seps, *spans[0], model):
        assert v == s[cs[i][0] : cs[j - 1][1]] and x == shape(v)
