import itertools

from shelfspark.llm import near

TITLE = "A survey of comets and otters in the long cold winters of the north and of the south"


def test_only_different_parts_are_kept_apart(spark):
    titles = [TITLE, f"{TITLE}, Part II", f"Part II: {TITLE}", f"{TITLE}, Part 2", f"{TITLE}, Part III"]
    schema = "row_id bigint, title string, author string, abstract string, pub_year int"
    df = spark.createDataFrame([(k, t, "Ito, Aya", "", 2001) for k, t in enumerate(titles)], schema)
    got = {tuple(r) for r in near.near_pairs(df).select("row_id_a", "row_id_b").collect()}
    assert got == set(itertools.combinations(range(5), 2)) - {(1, 4), (3, 4)}
