import datetime
import random

import pytest

from shelfspark.operators.hierarchy import _scan, descendants, hierarchy, walk

SCHEMA = "id string, coll_name string, parent_id string, modified timestamp_ntz, root string, depth int"
T0 = datetime.datetime(2020, 1, 1)


def brute(parents):
    """parents: id -> parent or None."""
    out = {}
    for x in parents:
        seen, v = [], x
        while v is not None and v not in seen:
            seen.append(v)
            p = parents.get(v)
            v = p if p in parents else None
        if v is None:
            out[x] = (seen[-1], len(seen) - 1)
        else:
            out[x] = (min(seen[seen.index(v):]), -1)
    return out


def rows(parents):
    return [(k, f" name  of {k} ", v, T0, "clash", 7) for k, v in parents.items()]


def run(spark, data, **kw):
    return hierarchy(spark.createDataFrame(data, SCHEMA), **kw)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    ids = [f"n{k:03d}" for k in range(80)]
    parents = {x: rnd.choice([None, "absent", *ids[: max(1, k)], *ids[:3], rnd.choice(ids)]) for k, x in enumerate(ids)}
    want = brute(parents)
    for most in (100_000, 2):  # in one task, and too large for one
        for paths in (True, False):
            got = {r.id: (r.root_id, r.depth) for r in run(spark, rows(parents), max_component=most, paths=paths).collect()}
            assert got == want


def test_paths_and_descendants(spark):
    tree = run(spark, rows({"a": None, "b": "a", "c": "b", "d": "a"})).cache()
    got = {r.id: list(r.path) for r in tree.collect()}
    assert got["c"] == ["name of a", "name of b", "name of c"]
    pairs = {(r.ancestor_id, r.descendant_id, r.distance) for r in descendants(tree).collect()}
    assert pairs == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1)}
    big = {r.id: list(r.path) for r in run(spark, rows({"a": None, "b": "a", "c": "b", "d": "a"}), max_component=1).collect()}
    assert big == got


def test_long_chain(spark):
    n = 300
    parents = {f"{k:05d}": f"{k - 1:05d}" if k else None for k in range(n)}
    got = {r.id: r.depth for r in run(spark, rows(parents), max_component=10).collect()}
    assert got[f"{n - 1:05d}"] == n - 1


def test_chain_of_many_nodes():
    """A chain is walked without its paths, and its paths are never all held."""
    n = 100_000
    cid = [f"{k:06d}" for k in range(n)]
    got = {k: d for k, _, d, *_ in walk(cid, [None, *cid[:-1]], cid, cid, False)}
    assert len(got) == n and all(got[k] == k for k in range(0, n, 999))
    for k, _, depth, _, path, ids in walk(cid[:2000], [None, *cid[:1999]], cid[:2000], cid[:2000], True):
        assert len(path) == depth + 1 and ids[-1] == cid[k]


def test_components_across_batches():
    """Components that go over several batches, and rows that come out in several frames."""
    import pandas as pd

    rows = [(f"r{c}", f"r{c}" if k == 0 else f"r{c}n{k}", None if k == 0 else (f"r{c}" if k < 3 else f"r{c}n{k - 1}"), f"R{c}N{k}", "n") for c in range(9) for k in range(7)]
    batches = [pd.DataFrame(rows[a : a + 5], columns=["root", "cid", "parent", "id", "name"]) for a in range(0, len(rows), 5)]
    out = pd.concat(_scan(True, at_once=20)(iter(batches)))
    assert len(out) == 63 and set(out.root_id) == {f"R{c}N0" for c in range(9)} and sorted(out.depth) == sorted([0, 1, 1, 2, 3, 4, 5] * 9)
    assert len(list(_scan(False)(iter(batches)))[0].columns) == 4


def test_spellings_ties_nulls(spark):
    data = [
        ("x1", None, None, T0, None, None),
        ("y1", None, " X1 ", T0, None, None),
        ("z1", "z", "{Collection:Y1}".replace("{Collection:", "collection:").replace("}", ""), T0, None, None),
        ("z1", "z", None, T0 - datetime.timedelta(1), None, None),  # older row
        ("w1", "w", "", None, None, None),
        ("w1", "w", "", None, None, None),  # repeated
        (None, "lost", "x1", T0, None, None),
        ("s1", "self", "s1", T0, None, None),
    ]
    got = {r.id: (r.root_id, r.depth, r.in_loop) for r in run(spark, data).collect()}
    assert got == {"x1": ("x1", 0, False), "y1": ("x1", 1, False), "z1": ("x1", 2, False), "w1": ("w1", 0, False), "s1": ("s1", -1, True)}


def test_empty(spark):
    assert run(spark, []).count() == 0


def test_paths_in_and_below_loops(spark):
    parents = {"a": "c", "b": "a", "c": "b", "d": "b", "e": "d", "f": "f", "r": None, "s": "r"}
    for most in (100_000, 1):  # in one task, and too large for one
        tree = run(spark, rows(parents), max_component=most).cache()
        got = {r.id: "".join(r.path_ids) for r in tree.collect()}
        assert got == {"a": "bca", "b": "cab", "c": "abc", "d": "cabd", "e": "cabde", "f": "f", "r": "r", "s": "rs"}
        assert {r.id: [n[-1] for n in r.path] for r in tree.collect()} == {k: list(v) for k, v in got.items()}
        pairs = {(r.ancestor_id, r.descendant_id) for r in descendants(tree).collect()}
        assert pairs == {(x, y) for x in "abc" for y in "abcde" if x != y} | {("d", "e"), ("r", "s")}


def test_every_collection_has_a_path(spark, data):
    from shelfspark.catalog import problems

    ids = {r.id for r in problems.p3_found(spark, data).collect()}
    assert {r.id for r in problems.p3_paths(spark, data).collect()} == ids
    looped = {r.id for r in problems.p3_found(spark, data).where("depth < 0").collect()}
    assert {r.id for r in problems.p3_loop_members(spark, data).collect()} == looped
