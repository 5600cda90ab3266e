import datetime

from shelfspark.catalog import quality

T0 = datetime.datetime(2020, 1, 1)
TEXTS = "entry_key entry_type title author editor journal booktitle publisher school institution volume issue_no pages pub_month doi url abstract".split()
SCHEMA = "row_id bigint, " + ", ".join(f"{c} string" for c in TEXTS) + ", pub_year int, keywords array<string>, tags array<string>, custom map<string,string>, added timestamp, modified timestamp"


def row(k, **v):
    got = {"row_id": k, "entry_type": "misc", "added": T0, "modified": T0, **v}
    names = ["row_id", *TEXTS, "pub_year", "keywords", "tags", "custom", "added", "modified"]
    return tuple(got.get(n) for n in names)


def test_same_work_without_a_shared_doi(spark, tmp_path):
    work = {"author": "Ito, Aya", "pub_year": 2001}
    rows = [
        row(1, entry_key="a", title="The Comet", doi="10.1/x", **work),
        row(2, entry_key="b", title="Comet", **work),
        row(3, entry_key="b", title="comet!", doi="10.1/y", **work),
        row(4, entry_key="c", title="Otter", doi="https://doi.org/10.1/X", **work),
        row(5, entry_key="d", title="Comet", author="Ito, Aya"),  # no year
        row(6, entry_key="e", title="Comet", author="Ito, Aya"),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/entries.parquet")
    got = {(r.row_id, r.field, r.severity, r.others) for r in quality.QUERIES["ddp12_all_warnings"](spark, str(tmp_path)).collect()}
    assert got == {(1, "doi", "warning", 1), (4, "doi", "warning", 1), (1, "", "info", 2), (2, "", "info", 1), (3, "", "info", 1)}
    keys = {(r.field, r.key) for r in quality.QUERIES["ddp13_warning_keys"](spark, str(tmp_path)).collect()}
    assert keys == {("doi", "a"), ("doi", "c"), ("", "a"), ("", "b")}
    counts = {(r.rule, r.severity): r.n for r in quality.QUERIES["val21_all_duplicates"](spark, str(tmp_path)).collect()}
    assert counts["duplicate doi", "warning"] == 2 and counts["possible duplicate", "info"] == 3
