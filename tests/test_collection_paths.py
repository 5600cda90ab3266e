import datetime

from shelfspark.catalog import rest

T0 = datetime.datetime(2020, 1, 1)
SCHEMA = "id string, coll_name string, parent_id string, modified timestamp"
LONG = "0a1b2c3d-0a1b-0a1b-0a1b-0a1b2c3d4e5f"


def test_paths_and_listing_of_all_collections(spark, tmp_path):
    rows = [
        (LONG, "A", None, T0),
        ("b", "B", "{" + LONG.replace("-", "") + "}", T0),
        ("c", "C", "urn:uuid:b", T0),
        ("0z", "D", " ", T0),
        ("l1", "L", "l2", T0),
        ("l2", "M", "l1", T0),
        ("l3", "N", "l2", T0),
        ("me", "S", "me", T0),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/collections.parquet")
    got = {r.id: r.path for r in rest.QUERIES["join17_parent_paths"](spark, str(tmp_path)).collect()}
    assert got == {LONG: "A", "b": "A > B", "c": "A > B > C", "0z": "D", "l1": "M > L", "l2": "L > M", "l3": "L > M > N", "me": "S"}
    tree = sorted((r.place, r.id, r.name, r.parent, r.depth) for r in rest.QUERIES["wf10_collection_tree"](spark, str(tmp_path)).collect())
    assert tree == [
        (1, LONG, "A", None, 0), (2, "b", "B", LONG, 1), (3, "c", "C", "b", 2), (4, "0z", "D", None, 0),
        (5, "l2", "M", "l1", -1), (6, "l3", "N", "l2", -1), (7, "l1", "L", "l2", -1), (8, "me", "S", "me", -1),
    ]
