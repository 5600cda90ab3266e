"""Stores and commands on small tables, against plain Python where SQL does not check them."""

import textwrap

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import engine, stores
from shelfspark.sources import bibliography as B


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_free_keys(spark):
    letters = [f"full{chr(c)}" for c in range(97, 123)]
    known = ["a", "aa", "ab", "ad", "b", "full", *letters, "full_1", "full_2", "full_4", "n1", "n1a", "x"]
    many = ["many", *[f"many{chr(c)}" for c in range(97, 123)], *[f"many_{k}" for k in range(1, 1500)]]
    k = table(spark, [(x,) for x in known + many], "key string")
    ask = table(spark, [(x,) for x in ("a", "b", "full", "n1", "many")], "key string")
    got = {r.key: r.free_key for r in stores.free_keys(ask, k, "_", 1, None, "").collect()}
    assert got == {"a": "ac", "b": "ba", "full": "full_3", "n1": "n1b", "many": "many_1500"}
    few = {r.key: r.free_key for r in stores.free_keys(ask, k, "_", 1, 99, "late").collect()}
    assert few["many"] == "many_late" and few["full"] == "full_3"
    dense = table(spark, [("q",), *[(f"q{chr(c)}",) for c in range(97, 123)], ("q2",), ("q3",)], "key string")
    assert stores.free_keys(dense.limit(1), dense, "", 2, 99, "late").first().free_key == "q4"
    assert stores.free_keys(k.limit(0), k, "_", 1, None, "").count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_corrections_against_brute_force(spark):
    words = ["comet", "comte", "otter", "oter", "ottre", "kriging", "krigin", "børge", "borge", "é", "river", "rivver", "rover"]
    df = table(spark, [(w, 1 + k % 4) for k, w in enumerate(words)], "term string, df int")
    got = {r.term: (r.suggestion, r.distance) for r in stores.corrections(df, df).collect()}
    count = {w: 1 + k % 4 for k, w in enumerate(words)}
    want = {}
    for w in words:
        near = sorted((edits(w, v), -count[v], v) for v in words if v != w and edits(w, v) <= 2)
        if near:
            want[w] = (near[0][2], near[0][0])
    assert got == want


def test_versions_and_scopes(spark):
    v = stores.Versions(spark)
    one, two = table(spark, [(1,)], "x int"), table(spark, [(2,), (3,)], "x int")
    v.write(one)
    v.begin()
    v.write(two)
    assert v.read().count() == 1  # not yet
    v.end(commit=False)
    assert v.read().count() == 1
    v.begin()
    v.begin()
    v.write(two)
    v.end()
    assert v.read().count() == 1
    v.end()
    assert v.read().count() == 2


def test_bulk_create_is_atomic(spark):
    cols = "row_id bigint, key string, type string, title string, author string, journal string, year int, booktitle string, publisher string, school string, institution string, editor string, volume string, number string, pages string, month string, doi string, url string, abstract string, keywords array<string>, tags array<string>"
    row = lambda i, key, title: (i, key, "misc", title, "A B", None, 2000, *[None] * 12, [], [])
    store, good, bad = table(spark, [row(1, "k1", "One")], cols), table(spark, [row(2, "k2", "Two")], cols), table(spark, [row(3, "", "Three"), row(4, "k4", "Four")], cols)
    keys = lambda df: sorted(r.key for r in df.collect())
    assert keys(stores.bulk_create(store, good, True)) == ["k1", "k2"]
    assert keys(stores.bulk_create(store, bad, True)) == ["k1"]
    assert keys(stores.bulk_create(store, bad, False)) == ["k1", "k4"]
    assert keys(stores.bulk_create(store, store, True)) == ["k1"]  # a known key is a fault


def test_wrapped_against_textwrap(spark):
    texts = ["word " * 60, "a" * 100 + " tail of the text", "short", "many different words of several lengths go over lines " * 9, "x" * 70 + " " + "y" * 71]
    got = [r.v for r in table(spark, [(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(stores.wrapped(F.col("t")).alias("v")).collect()]
    assert got == ["\n      ".join(textwrap.wrap(t, 70, break_long_words=False, break_on_hyphens=False)) for t in texts]


def test_reading(spark):
    rows = [("été".encode("latin-1"),), ("été".encode(),), (b"\xef\xbb\xbfplain",), (b"",), (None,)]
    assert [r.v for r in table(spark, rows, "b binary").select(B.decoded(F.col("b")).alias("v")).collect()] == ["été", "été", "plain", "", None]
    rows = [('@string{ab = "A, {B} C"}',), ("@STRING( x-y = {v} )",), ("@book{k, title = {x}}",), (None,)]
    got = [r.v and (r.v.name, r.v.value) for r in table(spark, rows, "t string").select(B.definition(F.col("t")).alias("v")).collect()]
    assert got == [("ab", "A, {B} C"), ("x-y", "v"), None, None]
    rows = [("a.bib", "{}"), ("a", "  @book{k,"), ("a", "TY  - JOUR"), ("a.txt", " [1]"), ("a", "x"), ("b.CSV", None), ("b", None)]
    assert [r.v for r in table(spark, rows, "n string, t string").select(B.sniffed(F.col("n"), F.col("t")).alias("v")).collect()] == ["bibtex", "bibtex", "ris", "json", "unknown", "csv", "unknown"]
    got = B.parse_ris("TY  - JOUR\nJA  - Short J.\nLA  - en\nN1  - a note\nTI  - T\nER  - ")[2]
    assert got["journal"] == "Short J." and got["language"] == "en" and got["note"] == "a note"


def test_copies_differ_by_lists_and_maps(spark):
    cols = "key string, keywords array<string>, custom map<string,string>"
    a = table(spark, [("x", ["p"], {"a": "1", "b": "2"}), ("y", ["q"], {})], cols)
    same = table(spark, [("x", ["p"], {"b": "2", "a": "1"}), ("y", ["q"], {})], cols)
    other = table(spark, [("x", ["p", "r"], {"a": "1", "b": "2"}), ("y", ["q"], {"c": "3"})], cols)
    assert B.verify_copy(a, same).first().changed == 0 and B.verify_copy(a, other).first().changed == 2


def test_fields_and_collections(spark):
    fields = {f["name"]: f for f in engine.configured({"title": {"boost": 3.0}, "shelf": {"kind": "keyword"}})}
    assert len(fields) == 31 and fields["title"]["boost"] == 3.0 and fields["title"]["analyzer"] == "stemming" and not fields["doi"]["analyzed"] and fields["shelf"]["kind"] == "keyword"
    with pytest.raises(ValueError):
        engine.configured({"x": {"kind": "none"}})
    assert engine.analyzer_for("journal") == "keyword" and engine.analyzer_for("anything") == "standard" and engine.FIELD_EXPANSION["author"]["editor"] == 0.7
    assert engine.build_collection(" A ", entry_keys=["x", "y", "x"])["entry_keys"] == ["x", "y"] and engine.build_collection("B", query="year:2000")["entry_keys"] is None
    for bad in (lambda: engine.build_collection(" "), lambda: engine.build_collection("C", entry_keys=["x"], query="q")):
        with pytest.raises(ValueError):
            bad()


def test_braces_close_in_order(spark):
    rows = [("a {b} c", True), ("{a", False), ("a}: {b", False), ("{{x}{y}}", True), (None, True), ("", True), ("}", False)]
    got = [r.v for r in table(spark, [(k, t) for k, (t, _) in enumerate(rows)], "k int, t string").orderBy("k").select(B.closes_braces(["t"]).alias("v")).collect()]
    assert got == [v for _, v in rows]
