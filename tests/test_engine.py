import pytest

from shelfspark.catalog.records import records
from shelfspark.operators import engine as E
from shelfspark.operators import querylang as L


def test_service(spark, data):
    s = E.Service(records(spark, data)).with_synonyms({"thesauri": ["lexicons"]}).with_field("title", {"title": 1.0})
    r = s.search("thesauri", limit=5000, offset=-3)
    both = r.matches.count()
    assert both == E.Service(records(spark, data)).search("thesauri OR lexicons").matches.count()
    assert r.page.count() == min(both, 1000) and r.facets.where("field = 'type'").groupBy().sum("n").first()[0] == both
    ranked = E.Service(records(spark, data)).with_ranker("bm25").search("the").page.select("score").collect()
    assert ranked == sorted(ranked, reverse=True)


def test_suggestions(spark, data):
    s = E.Service(records(spark, data))
    assert s.suggestions("title:deep", 4) == ["deep"]
    assert s.suggestions("deep AND nets", 0, ["deeps"]) == ["deeps", "(deep OR nets)"]
    assert s.suggestions("deep", 50) == []
    got = E.ranked_suggestions(L.parse("author:nett"), {"nett": "net"}, {"nett": ["mesh"]}, E.FIELD_EXPANSION)
    assert [c for _, c in got] == [0.8, 0.7, 0.6]


def test_pages():
    p = E.Page(45, 20, 20)
    assert (p.current, p.pages, p.has_more, p.has_previous) == (2, 3, True, True)


def test_small_parts():
    assert E.expand_text("machine learning nets", {"machine learning": ["ml"]}) == "(machine learning OR ml) nets" and E.expand_text("ML", {"machine learning": ["ml"]}) == "(ML OR machine learning)"
    assert E.tree_rows({"a": {"b": None}}) == [("a", None), ("b", "a")]
    assert E.guarded_update({"title": "x"}) == {"title": "x"} and E.analyzer_for("doi") == "keyword" and E.analyzer_for("x") == "standard"
    with pytest.raises(ValueError):
        E.guarded_update({"key": "x"})
    assert "| a | b | c | 1 |" in E.report([("a", "b", "c", 1)]) and "<td>&lt;a&gt;</td>" in E.report([("<a>", "b", "c", 1)], "html")


def test_guards(spark, data):
    from shelfspark.catalog.structured import patch, smart_filter

    with pytest.raises(ValueError):
        smart_filter("year", "contains", 3)
    with pytest.raises(ValueError):
        smart_filter("year", "~", 3)
    with pytest.raises(ValueError):
        patch(records(spark, data), [{"op": "remove", "path": "/key"}])
