"""Small cases of each operator: nulls, blanks, very long texts, ties, repeated rows, empty tables, clashing extra columns, brute force."""

import datetime
import itertools
import random
import re
import time
from collections import Counter

import pytest

from shelfspark.llm import formatting, leak, mixing, names, near, residue, survivor

D = lambda n: datetime.datetime(2020, 1, n)

# problem 1
MEMBER = "group_id bigint, member_id bigint, doi string, abstract string, journal string, pages string, origin string, modified timestamp_ntz, field string, state string"
ORIGINS = [("good", 5), ("same", 5), ("bad", 1), (None, 9)]


def survive(spark, rows, **kw):
    m = spark.createDataFrame([(*r, "clash", "clash") for r in rows], MEMBER)
    return {(r.group_id, r.field): r.member_id for r in survivor.survivors(m, spark.createDataFrame(ORIGINS, "origin string, trust int"), **kw).collect()}


def test_survivor_order(spark):
    a, j = "A full sentence of text.", "Journal of Applied Botany"
    rows = [
        (1, 1, "10.1234/abc", a, j, "1--9", "bad", D(9)), (1, 2, "doi:10.1234/ABC", a + " More.", j, "pp. 1-9", "good", D(1)), (1, 3, "10.1234/abc", a, j, "1–9", "same", D(1)),
        (2, 4, "10.1234/x9", None, "J. Appl. Bot.", "9--1", None, D(1)), (2, 4, "10.1234/x9", None, "J. Appl. Bot.", "9--1", None, D(1)), (2, 5, "10.1234/x", "Cut off here...", "Various", "5--5", None, D(2)),
        (3, 6, None, None, None, None, None, None), (4, 7, "", " ", "", "", "good", D(1)),
        (5, 8, "10.1234/only", a, j, "1--2", None, None), (5, 9, "10.1234/only", a, j, "1--2", "unheard", D(3)),
    ]
    got = survive(spark, rows)
    assert [got[1, f] for f in ("doi", "abstract", "journal", "pages")] == [2, 2, 2, 2]
    assert got[2, "doi"] == 4 and not any((2, f) in got for f in ("abstract", "journal", "pages"))
    assert not any(k[0] in (3, 4) for k in got)
    assert got[5, "doi"] in (8, 9)


def test_currency_without_time(spark):
    """Where dashes are always replaced by double dashes, a value in double dashes without a time is the later one."""
    rows = [(g, 2 * g, None, None, None, "1-9", "good", D(1)) for g in range(10, 30)] + [(g, 2 * g + 1, None, None, None, "1--9", "good", D(5)) for g in range(10, 30)]
    rows += [(99, 900, None, None, None, "1-9", "good", D(8)), (99, 901, None, None, None, "1--9", "good", None)]
    rows += [(98, 800, None, None, None, "1--9", "good", D(8)), (98, 801, None, None, None, "1-9", "good", None)]
    got = survive(spark, rows)
    assert got[99, "pages"] == 901 and got[98, "pages"] == 800


def test_states_without_times(spark):
    """Three states follow one another; then a cycle, states never compared, and times that contradict the order."""
    forms = {"a": "1-9", "b": "1--9", "c": "1–9", "d": "1 - 9", "e": "1 -- 9"}  # d and e are never seen with a time beside others
    rows = []
    for g in range(10, 30):
        rows += [(g, 10 * g, None, None, None, forms["a"], "good", D(1)), (g, 10 * g + 1, None, None, None, forms["b"], "good", D(5))]
    for g in range(30, 50):
        rows += [(g, 10 * g, None, None, None, forms["b"], "good", D(1)), (g, 10 * g + 1, None, None, None, forms["c"], "good", D(5))]
    cases = {
        1000: (["a", "c", "b"], 1),  # a < b < c, a < c by transitivity only
        1001: (["d", "a"], 0), 1002: (["e", "d"], 0),  # nothing known: the smallest id
        1003: (["b", "d", "a"], 0),  # b after a, d incomparable: the smallest id of b and d
    }
    for g, (states, _) in cases.items():
        rows += [(g, 10 * g + k, None, None, None, forms[x], "good", None) for k, x in enumerate(states)]
    # a value of state b without time lies between a later a and an earlier c: one place in the order, the latest time survives
    rows += [(1004, 10040, None, None, None, forms["c"], "good", D(1)), (1004, 10041, None, None, None, forms["b"], "good", None), (1004, 10042, None, None, None, forms["a"], "good", D(9))]
    got = survive(spark, rows)
    assert {g: got[g, "pages"] - 10 * g for g in cases} == {g: k for g, (_, k) in cases.items()}
    assert got[1004, "pages"] == 10042


def test_precedence():
    p = survivor.precedence([("f", "a", "b", 15), ("f", "b", "c", 15), ("f", "c", "a", 15), ("f", "c", "d", 15), ("f", "x", "y", 2), ("f", "u", "v", 50), ("f", "v", "u", 40), ("g", "a", "b", 90), ("g", "b", "a", 20)])
    assert p == {("f", "a", "d"), ("f", "b", "d"), ("f", "c", "d"), ("g", "a", "b")}  # a, b, c are a cycle
    nodes = [("a", None, 1), ("b", None, 2), ("c", None, 3)]
    assert survivor.latest("f", nodes, {("f", "a", "b"), ("f", "a", "c"), ("f", "b", "c")}) == 2
    assert survivor.latest("f", nodes, {("f", "a", "b")}) == 1 and survivor.latest("f", nodes, set()) == 0
    assert survivor.latest("f", [("a", 5, 9), ("b", 5, 4), ("c", 3, 1)], set()) == 1


def test_survivor_stock_text_long_and_empty(spark):
    stock = "This record has a text that many groups share."
    rows = [(g, g, None, stock, None, None, "good", D(1)) for g in range(1, 8)] + [(50, 50, None, "word " * 50_000 + "end.", None, None, "good", D(1))]
    assert survive(spark, rows) == {(50, "abstract"): 50}
    assert survive(spark, []) == {}


# problem 2 and 4
ENTRY = "row_id bigint, entry_key string, title string, author string, abstract string, pub_year int, doi string, keywords array<string>, custom map<string,string>, added timestamp_ntz, modified timestamp_ntz, cid string, node string, text string, h bigint"


def entries(spark, rows):
    return spark.createDataFrame([(*r, None, None, "clash", "clash", "clash", 1) for r in rows], ENTRY)


def entry(i, title, author="A B", abstract=None, year=2000, doi=None, keywords=None, custom=None, key="k"):
    return (i, key, title, author, abstract, year, doi, keywords, custom)


def bag(r):
    return Counter(re.sub(r"[^\w\s]|_", " ", " ".join(str(x) for x in (r[2], r[3], r[4], r[5]) if x is not None).lower()).split())


def similarity(x, y):
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both) if x or y else 0


def test_near_against_brute_force(spark):
    rnd = random.Random(5)
    vocab = [f"word{k}" for k in range(400)]
    rows = []
    for w in range(150):
        base = [rnd.choice(vocab) for _ in range(40)]
        for v in range(rnd.choice([1, 1, 2, 4])):
            text = list(base)
            for _ in range(rnd.randint(0, 9) if v else 0):
                k = rnd.randrange(len(text))
                text[k] = rnd.choice(vocab)
            if v and rnd.random() < 0.3:
                text = text[20:] + text[:20]
            rows.append(entry(len(rows), f"title {w}", f"author {w}", " ".join(text), 1990 + w % 9, key=f"k{len(rows)}"))
    bags = [bag(r) for r in rows]
    want = {(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if similarity(bags[a], bags[b]) >= 0.7 and rows[a][4] != rows[b][4]}
    got = [tuple(r) for r in near.near_pairs(entries(spark, rows)).select("row_id_a", "row_id_b").collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(want & set(got)) >= 0.98 * len(want)


def test_near_large_nodes_are_exact(spark):
    """Forty slightly different records stay together at every level: with tiny nodes they are compared in blocks."""
    base = [f"w{k}" for k in range(60)]
    rows = [entry(i, " ".join([*base, f"x{i}"]), key=f"k{i}") for i in range(40)]
    _, sets = near.classes(entries(spark, rows), "row_id", ("title", "author", "abstract", "pub_year"))
    got = near.similar_classes(sets, 0.7, limit=4, max_depth=2)
    assert got.count() == 40 * 39 // 2


def test_near_edges(spark):
    long = " ".join(f"w{k % 5000}" for k in range(60_000))
    rows = [
        entry(1, None, None, None, None), entry(2, "", "", "", None), entry(3, "One two three four five six", key="a"), entry(4, "one TWO; three four five six", key="a"), entry(5, "six five four three two one", key="b"),
        entry(6, long, key="l1"), entry(7, long + " extra", key="l2"), entry(8, "A study of nine common words in one title, Part I", key="p1"), entry(9, "A study of nine common words in one title, Part II", key="p2"),
    ]
    got = {tuple(r) for r in near.near_pairs(entries(spark, rows)).select("row_id_a", "row_id_b").collect()}
    assert got == {(3, 5), (4, 5), (6, 7)}
    assert near.near_pairs(entries(spark, [])).count() == 0
    c = {r.row_id: (r.class_id, r.n_links) for r in near.near_classes(entries(spark, rows)).collect()}
    assert 1 not in c and c[3] == c[4] == c[5] == (3, 0) and c[6] == (6, 1) and c[8][1] == 1


def test_formatting_runs(spark):
    rows = [
        entry(1, "A {T}itle", doi="https://doi.x/10.1/AB", keywords=["x", "Y"], custom={"a": "1", "b": "2"}), entry(2, "a title.", doi="10.1/ab", keywords=["y ", "X"], custom={"b": "2", "a": "1"}),
        entry(3, "a title", doi="10.1/ac", keywords=["x", "y"], custom={"a": "1", "b": "2"}), entry(4, None, None, None, None), entry(5, "", " ", "", None), entry(6, "Long " * 100_000), entry(7, "LONG " * 100_000),
    ] + [entry(k, "hot copy", key="hot") for k in range(100, 400)]
    member, reps = formatting.runs(entries(spark, rows).repartition(7))
    assert {r.rep: r.copies for r in reps.collect()} == {1: 2, 3: 1, 4: 2, 6: 2, 100: 300}
    assert {tuple(r) for r in formatting.pairs(member, reps).where("row_id_b < 100").select("row_id_a", "row_id_b").collect()} == {(1, 2), (4, 5), (6, 7)}
    member, reps = formatting.runs(entries(spark, []))
    assert reps.count() == 0 and formatting.pairs(member, reps).count() == 0


def test_runs_cross_partitions(spark):
    """The copies of one record lie in several range partitions and still make one run."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [entry(k, "same", key="hot") for k in range(2000)] + [entry(5000 + k, f"other {k}") for k in range(50)]
        _, reps = formatting.runs(entries(spark, rows))
        assert {r.rep: r.copies for r in reps.where("copies > 1").collect()} == {0: 2000} and reps.count() == 51
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# problem 5
def entities(spark, texts):
    df = spark.createDataFrame([(k, t, 1 + (k == 0), None, "clash", "clash") for k, t in enumerate(texts)], "name_id bigint, person_name string, n_author int, n_editor int, kind string, family string")
    out = {}
    for r in names.entities(df).collect():
        out.setdefault(r.entity, set()).add(texts[r.name_id])
    return {frozenset(v) for v in out.values()}


def test_names_link(spark):
    common = [f"{s}, {g}" for s in ("Aldergate", "Birchwood", "Cedarholm", "Dunmorrow") for g in ("Katherine", "Edward", "Oksana")]
    person = ["Tarnovik, Katherine B.", "Katherine Tarnovik", "TARNOVIK, K.", "Tarnovik Katherine", "Tarnoivk, Katherine", "Kathy B. Tarnovik", "Dr. Katherine Tarnóvik", "Tarnovik, Kahterine"]
    other = ["Tarnovik, Oksana", "O. Tarnovik"]
    org = ["Institute for Botany and Indexing, Ravelinford", "INSTITUTE FOR INDEXING AND BOTANY, RAVELINFORD", "Inst. Bota. & Index., Ravelinford", "The Ravelinford Institute of Botany & Indexing", "IBI Ravelinford"]
    got = entities(spark, common + person + other + org + ["Centre for Botany and Indexing, Ravelinwick", None, " "])
    assert frozenset(person) in got and frozenset(other) in got and frozenset(org) in got
    assert frozenset(["Aldergate, Edward"]) in got


def test_names_edges(spark):
    assert entities(spark, []) == set()
    assert entities(spark, ["Ash, Katherine", "Ash, Katherine"]) == {frozenset(["Ash, Katherine"])}
    long = "Very " * 5000 + "Long, Katherine"
    assert frozenset([long]) in entities(spark, [long, "Short, Katherine"])
    assert names.near("abcd", "abdc") == 1 and names.near("abcd", "abxx") == 2 and names.near("abc", "abcd") == 1 and names.near("a", "a") == 0


# problem 8
ITEM = "item_id bigint, text string, doc_id string, share double"
DOC = "doc_id bigint, text string, item_id string, share string"
LEAD = "Read the passage and answer:"


def passage(seed, n=60):
    rnd = random.Random(seed)
    return " ".join(rnd.choice("amber birch cedar delta ember fjord grove heath islet jetty knoll ledge marsh north ocean ridge shore tidal upper vale".split()) + str(rnd.randrange(60)) for _ in range(n))


def find(spark, docs, items):
    d = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], DOC)
    q = spark.createDataFrame([(i, t, "clash", 0.5) for i, t in items], ITEM)
    return {(r.doc_id, r.item_id) for r in leak.leaks(d, q).collect()}


def test_leaks(spark):
    items = [(k, f"{LEAD} {passage(k)}.") for k in range(6)] + [(7, None), (8, "")]
    w0, w1, w2 = passage(0).split(), passage(1).split(), passage(2).split()
    hidden = "intro words here. " + " ".join(w0[:30]).upper().replace(" ", ",\n") + " and so on " + passage(99, 3000)
    edited = " ".join("changed" if k % 12 == 5 else w for k, w in enumerate(w1))
    wrapped = " ".join(w2[30:] + w2[:30]).replace("amber", "am-\nber")
    docs = [(1, hidden), (2, edited), (3, wrapped), (4, " ".join(w0[:12])), (5, LEAD), (6, None), (7, "  "), (8, passage(99, 20_000)), (9, hidden)]
    assert find(spark, docs, items) == {(1, 0), (2, 1), (3, 2), (9, 0)}
    assert find(spark, [], items) == set() and find(spark, docs, []) == set()


def most_held(item, doc):
    """The share of an item's words that five-word sequences of one place of a document cover; plain loops."""
    n, best = len(item), 0
    places = {}
    for i in range(n - 4):
        places.setdefault(tuple(item[i : i + 5]), []).append(i)
    hits = [(d, i) for d in range(len(doc) - 4) for i in places.get(tuple(doc[d : d + 5]), ())]
    held = [(d, i + k) for d, i in hits for k in range(5)]
    at = sorted({d for d, _ in hits})
    for x, y in zip(at, at[1:]):  # neighbours in the document, about as far apart in the item
        held += [(y, w) for d, i in hits if d == x for e, j in hits if e == y and 0 < j - i - 5 <= leak.GAP and abs(j - i - y + x) <= leak.GAP and y - x > 1 for w in range(i + 5, j)]
    for lo in at:
        best = max(best, len({w for d, w in held if lo <= d <= lo + 2 * n}))
    return best / n


def test_leaks_against_brute_force(spark, data):
    """Every item against every document, without numbers, sketches or windows of set sizes."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/eval_items.parquet").collect()]
    leads = Counter(" ".join(leak.opening(t)) for _, t in items)
    want = {}
    for i, t in items:
        lead = leak.opening(t)
        words = leak.tokens(t)
        words = words[len(lead) :] if lead and leads[" ".join(lead)] >= 3 else words
        for d, text in docs:
            if text and (share := most_held(words, leak.tokens(text))) >= leak.THIRD:
                want[d, i] = share
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    q = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.share for r in leak.leaks(d, q).collect()}
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want)
    assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_most_covered_against_brute_force():
    rnd = random.Random(3)
    for _ in range(200):
        item = [rnd.choice("abcd") + str(rnd.randrange(rnd.choice([1, 3, 9]))) for _ in range(rnd.randint(15, 40))]
        doc = [rnd.choice(item) if rnd.random() < 0.1 else "z" for _ in range(40)]
        for _ in range(rnd.randint(0, 8)):
            a = rnd.randrange(len(item))
            k = rnd.randrange(len(doc))
            doc[k:k] = item[a : a + rnd.randint(3, 20)]
        got = dict(leak.Index([(1, item)]).search(" ".join(doc)))
        assert got.get(1, 0.0) == pytest.approx(most_held(item, doc))


def test_repetitive_and_many_items(spark):
    began = time.perf_counter()
    assert dict(leak.Index([(1, ["same"] * 400)]).search("same " * 3000)) == {1: 1.0}
    assert time.perf_counter() - began < 0.1
    # an instruction of any length, and items in blocks of a few words each
    lead = "Read this " + "very " * 120 + "carefully:"
    items = [(k, f"{lead} {passage(k)}") for k in range(5)]
    docs = [(1, lead + " nothing else is here"), (2, passage(3)), (3, lead + " " + passage(4))]
    for block in (1, 100, 10_000):
        d = spark.createDataFrame(docs, "doc_id bigint, text string")
        q = spark.createDataFrame(items, "item_id bigint, text string")
        assert {(r.doc_id, r.item_id) for r in leak.leaks(d, q, block=block).collect()} == {(2, 3), (3, 4)}


# problem 9
def mix(spark, docs, targets, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, entry_key string, n_tokens string, uses string")
    t = spark.createDataFrame(targets, "source string, weight double, max_repeats int")
    m = mixing.mixture(d, t, **kw)
    return m.collect(), {r.source: r for r in mixing.report(m, t).collect()}


def test_mixture(spark):
    rnd = random.Random(1)
    docs = [(k, "some words " * rnd.randint(5, 60), rnd.choice(["en", "de", None]), rnd.choice(["Big ", "big", "big", "big", "small", "none", None]), None, "clash", "clash") for k in range(3000)]
    docs += [(9001, None, "en", "big", None, None, None), (9002, "  ", "en", "big", None, None, None)]
    rows, rep = mix(spark, docs, [("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 2)])
    assert abs(rep["big"].actual_share - 2 / 3) < 0.01 and abs(rep["small"].actual_share - 1 / 3) < 0.01 and rep["absent"].tokens == 0
    assert rep["big"].most_used <= 1 and rep["small"].most_used <= 3 and {r.source for r in rows} == {"big", "small"}
    assert len({r.doc_id for r in rows}) == len(rows)
    assert mix(spark, [], [("big", 1.0, 1)])[0] == []


def test_counts_do_not_depend_on_slices():
    import base64

    import tiktoken

    with open(mixing.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=mixing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(8)
    text = "".join(rnd.choice(["word", " it's", "  two", "\n\n", " 12", "\t", "... ", "é", "   ", "x" * 30]) for _ in range(4000))
    whole = len(enc.encode_ordinary(text))
    for size in (1, 7, 50, 999, 10**6):
        got = list(mixing.slices(text, size))
        assert "".join(got) == text and sum(len(enc.encode_ordinary(x)) for x in got) == whole
    assert list(mixing.slices("", 5)) == [""]


def test_rake_meets_margins():
    cells = [("a", "en", "x", 100), ("a", "de", "x", 50), ("b", "en", "y", 400), ("b", "de", "x", 30)]
    uses = mixing.rake(cells, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 1}, 200)
    by = Counter()
    for c, u in zip(cells, uses):
        by[c[0]] += u * c[3]
        assert u <= {"a": 2, "b": 1}[c[0]] + 1e-9
    assert by["a"] == pytest.approx(100) and by["b"] == pytest.approx(100)


# problem 10
BAD = [
    "Dear {{first_name}}, the volume is ready.", "Title: __TITLE__\nYear: %YEAR%", "Real text about rivers. Error 503: backend did not answer while loading the page.", "asdf asdf asdf asdf qwer qwer zxcv", "Lorem ipsum dolor sit amet, olim alba.",
    "Status 404 Not Found\nThe requested scan could not be found on x.example", "Please enable JavaScript to continue.", "Bitte aktivieren Sie JavaScript, um die Seite zu sehen.", "Il faut activer JavaScript pour afficher la page.", "Debe activar JavaScript para continuar.", "Your session has expired. Log in again.", "foo bar foo bar foo bar foo bar foo bar", "A good text.\n\nTODO: write summary",
]
GOOD = [
    "Typographers still use the filler text that opens with 'lorem ipsum' to judge a page.", "The survey asked whether readers block JavaScript; 48 percent did.", "Page not found was the commonest complaint in the help desk log.", "For each $x$ in $S_{i}$ we let $a_{k}$ denote the index; [sic] marks errors.",
    "@article{k2001, title = {{A braced title}}, year = 2001} More text.", "The manual explains that a mark such as {{title}} stands for the record's value.", "Of 774 addresses, 37 percent answered with a 404 error page.", "Errors fell by 20 percent once this had been done.", "", "   ",
]


def test_residue(spark):
    docs = [(k, t, "clash", "clash") for k, t in enumerate(BAD + GOOD + [None])] + [(500, BAD[0], "", ""), (600, "plain words of a long text. " * 40_000, "", ""), (601, "plain words of a long text. " * 40_000 + "{{title}}", "", "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, share string, kinds string")
    got = {r.doc_id for r in residue.residue(df).collect()}
    assert got == {*range(len(BAD)), 500, 601}
    assert residue.residue(df.limit(0)).count() == 0
    assert residue.residue(df.where("doc_id = 600")).count() == 0


def test_learned_filler(spark):
    docs = [(k, "Lorem ipsum dolor sit amet glubo frenti glubo parnis frenti.") for k in range(6)] + [(50, "Glubo parnis frenti glubo parnis frenti glubo."), (51, "A quiet text on rivers and lakes.")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {"glubo", "frenti", "parnis"} <= set(residue.filler_words(df))
    assert {r.doc_id for r in residue.residue(df).collect()} == {0, 1, 2, 3, 4, 5, 50}
