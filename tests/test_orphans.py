import datetime

from shelfspark.operators.orphans import orphan_references, orphan_report

T = lambda d: datetime.datetime(2020, 1, d)
REF = "src string, ref_id string, entry_key string, ts timestamp_ntz, is_parent int, code string"


def build(spark, refs, parents, removals):
    r = spark.createDataFrame([(*x, 1, "clash") for x in refs], REF)
    return orphan_references(r, spark.createDataFrame(parents, "entry_key string, since timestamp_ntz"), spark.createDataFrame(removals, "entry_key string, ts timestamp_ntz"))


def test_kinds(spark):
    refs = [("e", "1", "a", T(5)), ("e", "2", "late", T(5)), ("e", "3", "gone", T(5)), ("e", "4", "gone", T(2)), ("e", "5", "never", T(5)), ("e", "6", None, T(5)), ("e", "5", "never", T(6)), ("e", "7", "late", T(20)), ("e", "8", "never", None)]
    parents = [("a", T(1)), ("late", T(10)), ("late", T(12)), (None, T(1)), ("other", None)]
    got = {(r.ref_id, r.entry_key, r.kind, r.period) for r in build(spark, refs, parents, [("gone", T(3)), (None, T(1))]).collect()}
    assert got == {("2", "late", "late", "2020-01"), ("3", "gone", "deleted", "2020-01"), ("5", "never", "missing", "2020-01"), ("8", "never", "missing", None)}


def test_brute_force(spark):
    import random

    rnd = random.Random(3)
    keys = [f"k{n}" for n in range(200)]
    parents = [(k, T(rnd.randint(1, 28))) for k in keys if rnd.random() < 0.7]
    removals = [(k, T(rnd.randint(1, 28))) for k in keys if rnd.random() < 0.2]
    refs = [("e", str(n), rnd.choice(keys + ["hot"] * 60), T(rnd.randint(1, 28))) for n in range(600)]
    since, gone = dict(parents), dict(removals)
    want = set()
    for _, i, k, t in refs:
        if k in since:
            kind = "late" if t < since[k] else None
        elif k in gone:
            kind = "deleted" if gone[k] < t else None
        else:
            kind = "missing"
        if kind:
            want.add((i, k, kind))
    got = build(spark, refs, parents, removals)
    assert {(r.ref_id, r.entry_key, r.kind) for r in got.collect()} == want
    assert sum(r.n_refs for r in orphan_report(got).collect()) == len(want)


def test_empty(spark):
    assert build(spark, [], [], []).count() == 0
    assert build(spark, [("e", "1", "a", T(5))], [], []).count() == 1
    assert build(spark, [], [("a", T(1))], []).count() == 0
