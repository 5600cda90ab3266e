"""Small tests of predicates, the query language, text functions, sources, quality rules and streams."""

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import udfs as U
from shelfspark.operators import quality as Q
from shelfspark.operators import querylang as L
from shelfspark.operators.predicates import Leaf, Node, Query, compile_tree
from shelfspark.sources import bibliography as B

ROWS = [(1, "Alpha", 2000), (2, "beta", None), (3, None, 1990), (4, "", 0)]
LEAVES = [Leaf("title", "=", None), Leaf("title", "!=", "Alpha"), Leaf("title", "contains", "A"), Leaf("year", ">", 1995), Leaf("year", "<=", 1990), Leaf("title", "in", ["beta", "x"]), Leaf("title", "not_in", ["beta"]), Leaf("title", "matches", "^A"), Leaf("title", ">", 3)]


def meaning(x, row, dialect):
    """A row-wise reading of the dialects."""
    if isinstance(x, Node):
        kids = [meaning(k, row, dialect) for k in x.children]
        if x.kind == "not":
            return not (kids[0] if dialect == "repo" else all(kids)) if kids else dialect == "entry"
        return (all(kids) if x.kind == "and" else any(kids)) if kids else True
    v = dict(zip(("row_id", "title", "year"), row))[x.field]
    if dialect == "spec":
        ok = v not in (None, 0, "")
        ops = {"=": lambda: v == x.value, "!=": lambda: v != x.value, "contains": lambda: ok and x.value in v, "in": lambda: v in x.value, ">": lambda: ok and v > x.value, "<=": lambda: ok and v <= x.value}
        return ops.get(x.op, lambda: True)()
    if v is None:
        return dialect == "entry" and x.op == "=" and x.value is None
    if x.op in (">", "<=") and isinstance(v, str) != isinstance(x.value, str):
        return False
    import re

    ops = {"=": lambda: v == x.value, "!=": lambda: v != x.value, "contains": lambda: x.value.lower() in str(v).lower(), "in": lambda: v in x.value, "not_in": lambda: v not in x.value, "matches": lambda: dialect == "entry" and bool(re.search(x.value, v)), ">": lambda: v > x.value, "<=": lambda: v <= x.value}
    return ops[x.op]()


@pytest.mark.parametrize("dialect", ["entry", "repo", "spec"])
def test_dialects(spark, dialect):
    df = spark.createDataFrame(ROWS, "row_id int, title string, year int")
    trees = [x for x in LEAVES if dialect != "spec" or x.op not in (">",) or x.field == "year"]
    if dialect != "spec":
        trees = trees + [Node("not", (x,)) for x in LEAVES] + [Node("or", (LEAVES[0], LEAVES[3])), Node("not", (LEAVES[1], LEAVES[3])), Node("and"), Node("not")]
    for t in trees:
        if dialect == "spec" and t.op in ("not_in", "matches"):
            continue
        got = {r.row_id for r in df.where(compile_tree(t, dialect)).collect()}
        assert got == {r[0] for r in ROWS if meaning(t, r, dialect)}, t


def test_pushdown(spark, data):
    df = spark.read.parquet(f"{data}/entries.parquet").where(Query().where("entry_type", "=", "book").where("pub_year", ">=", 2000).column()).select("row_id")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(entry_type,book)" in plan and "GreaterThanOrEqual(pub_year,2000)" in plan and "abstract" not in plan


@pytest.mark.parametrize("text,want", [
    ("", L.Term("")), ("deep", L.Term("deep")), ("deep learning^2", L.Bool("AND", (L.Term("deep", 2.0), L.Term("learning", 2.0)))), ('"a b"~3^2', L.Phrase("a b", 3, 2.0)),
    ("kri*", L.Wildcard("kri*")), ("krig~1", L.Fuzzy("krig", 1)), ("krig~", L.Fuzzy("krig", 2)), ("year:[1990 TO *}", L.Range("year", 1990, None, True, False)), ("year:2001..2003", L.Range("year", 2001, 2003)),
    ("title:deep", L.Fielded("title", L.Term("deep"))), ("a AND b OR c", L.Bool("AND", (L.Term("a"), L.Bool("OR", (L.Term("b"), L.Term("c")))))), ("NOT x", L.Bool("NOT", (L.Term("x"),))), ("x not y", L.Bool("NOT", (L.Term("x"), L.Term("y")))),
])
def test_parse(text, want):
    assert L.parse(text) == want


def test_rewrites():
    q = L.parse("deep AND nets")
    assert L.relaxed(q, 1) == L.Bool("OR", q.parts)
    assert "deep~1" in str(L.relaxed(q, 2)) and "nets*" in str(L.relaxed(q, 3))
    assert L.terms(L.parse("a NOT b")) == ["a"] and L.complexity(L.parse('title:"a b"')) == 3
    assert L.with_synonyms(L.Term("ml"), {"ml": ["learning"]}) == L.Bool("OR", (L.Term("ml"), L.Term("learning", 0.8)))
    assert L.with_spelling(L.Term("nett"), lambda w: ["net", "nets", "not"]) == L.Bool("OR", (L.Term("nett"), L.Term("net", 0.7), L.Term("nets", 0.7)))
    assert L.with_fields(L.parse("title:x"), {"title": {"title": 1.0, "abstract": 0.5}}).parts[1] == L.Fielded("abstract", L.Term("x", 0.5))
    assert L.problems(L.parse("foo:x"), {"title"}) == ["unknown field foo"] and str(L.parse("year:[1 TO 2]")) == "year:[1 TO 2]"


@pytest.mark.parametrize("name,want", [
    ("Donald E. Knuth", (["Donald", "E."], [], ["Knuth"], [])), ("van der Berg, Jan", (["Jan"], ["van", "der"], ["Berg"], [])), ("Ludwig van Beethoven", (["Ludwig"], ["van"], ["Beethoven"], [])),
    ("King, Jr., Martin", (["Martin"], [], ["King"], ["Jr."])), ("{The Group}", ([], [], ["{The Group}"], [])), ("", ([], [], [], [])),
])
def test_names(name, want):
    assert U.split_name(name) == want


def test_text_functions():
    assert U.name_pattern("van der Berg, Jan", "{ff }{vv }{ll}{, jj}") == "Jan van der Berg" and U.initials("Jean-Paul Karl") == "J.-P. K."
    assert U.change_case("The {DNA} Of Things: A Tale", "t") == "The {DNA} of things: A tale" and U.change_case("Ab {C}", "u") == "AB {C}"
    assert [U.porter(w) for w in ("caresses", "ponies", "relational", "hopping", "agreed", "happy", "adjustable")] == ["caress", "poni", "relat", "hop", "agre", "happi", "adjust"]
    assert U.sort_form("Ünïted {\\em States}") == "United States" or U.sort_form("Ünïted").startswith("Un")
    assert U.spans("Deep nets are deeper", ["deep"]) == [(0, 4, 1.5)] and U.spans("deeper", ["deep"]) == [(0, 4, 1.0)]
    text, start = U.snippet("x" * 300 + " deep nets", U.spans("x" * 300 + " deep nets", ["deep"]), 60)
    assert "deep" in text and start > 0


def test_bibtex():
    key, kind, fields, error = B.parse_bibtex('@Article{k1, title = {A {B {C}} d}, year = 2001, note = "x" # y, author={A and B}}')
    assert (key, kind, error) == ("k1", "article", None) and fields == {"title": "A {B {C}} d", "year": "2001", "note": "xy", "author": "A and B"}
    assert B.parse_bibtex("nothing")[3] == "no entry" and B.parse_bibtex("@a{k, t = {open")[3]
    assert B.parse_string_definition('@string{jan = "January"}') == ("jan", "January") and B.expand_strings('JAN # " x"', {"jan": "January"}) == "January x"
    assert [B.sniff("a.bib", ""), B.sniff("x", "@book{a,"), B.sniff("x", "TY  - BOOK"), B.sniff("x", "[{}]"), B.sniff("x", "?")] == ["bibtex", "bibtex", "ris", "json", "unknown"]


def test_ris():
    key, kind, fields, error = B.parse_ris("TY  - JOUR\nAU  - Doe, J.\nAU  - Roe, K.\nTI  - The great title\nSP  - 3\nEP  - 9\nPY  - 2001/02\nSN  - 1234-5678\nKW  - a\nKW  - b\n")
    assert (key, kind, error) == ("doe_2001_great", "article", None)
    assert fields["pages"] == "3--9" and fields["issn"] == "1234-5678" and fields["author"] == "Doe, J. and Roe, K." and fields["keywords"] == "a, b"
    assert B.parse_ris("AU  - x")[3] == "no type"


def test_read_files(spark, tmp_path):
    (tmp_path / "a.bib").write_text("@comment{x}\n@string{a = {b}}\n@book{k1,\n title = {T},\n}\n\n@misc{k2, year = 1999}\n")
    got = {r.key: r.type for r in B.read_bibtex(spark, str(tmp_path / "a.bib")).collect()}
    assert got == {"k1": "book", "k2": "misc"}
    (tmp_path / "a.json").write_text('{"entries": [{"key": "k", "title": "t"}, {"title": "u"}]}')
    got = B.read_json(spark, str(tmp_path / "a.json")).collect()
    assert [(r.key, r.type, r.error) for r in got] == [("k", "misc", None), (None, "misc", "no key")]
    B.write_csv(spark.createDataFrame([("a", ["x", "y"])], "key string, keywords array<string>"), str(tmp_path / "csv"), ["key", "keywords"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().keywords == "x; y"


def test_check_digits(spark):
    df = spark.createDataFrame([("0306406152", "9780306406157", "03784371"), ("0306406153", "9780306406158", "03784372"), ("x", "", "1")], "a string, b string, c string")
    got = [tuple(r) for r in df.select(Q.isbn10_ok(F.col("a")), Q.isbn13_ok(F.col("b")), F.coalesce(Q.issn_ok(F.col("c")), F.lit(False))).collect()]
    assert got == [(True, True, True), (False, False, False), (False, False, False)]


def test_citations_of_nulls(spark, data):
    from shelfspark.catalog.records import records
    from shelfspark.functions import citations as X

    r = records(spark, data).limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("key", "type") else f.name for f in records(spark, data).schema])
    assert r.select(X.apa().alias("a"), X.ris().alias("b"), X.bibtex().alias("c")).first().a == "."


def test_streams(spark, data, tmp_path):
    from shelfspark.streaming import log as G

    folder = tmp_path / "log"
    spark.read.parquet(f"{data}/library_events.parquet").repartition(3).write.parquet(str(folder))
    q = G.keep_index(G.read_log(spark, str(folder)), str(tmp_path / "index"), str(tmp_path / "state"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "index")).select("batch").distinct().count() == 3
    q = G.windowed_counts(G.read_log(spark, str(folder), 3)).writeStream.outputMode("update").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] > 0
    q = G.progress(G.read_log(spark, str(folder), 3)).writeStream.outputMode("complete").format("memory").queryName("progress").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("progress").count() > 0


def test_stage_dir_is_the_shared_one(spark):
    from shelfspark.plans import cut, discard
    from shelfspark.plans.session import SETTING, stage_dir

    named = spark.sparkContext.getConf().get(SETTING, None)
    assert stage_dir(spark) == named.rstrip("/") if named else stage_dir(spark).startswith("file:")
    df = cut(spark.range(5).toDF("x"))
    assert df.count() == 5
    discard(df)
