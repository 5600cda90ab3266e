from pyspark.sql import functions as F

from shelfspark.functions.udfs import marked


def test_the_whole_of_a_long_text_is_marked(spark):
    long = "otter " + "word " * 4000 + "otter"
    df = spark.createDataFrame([(long,), ("word " * 4000,)], "x string")
    got = [r.y for r in df.select(marked(["otter"], (), None)(F.col("x")).alias("y")).collect()]
    assert got == [long.replace("otter", "<mark>otter</mark>"), "word " * 4000]


def test_whole_field_queries_mark_long_abstracts(spark, tmp_path):
    from test_duplicate_warnings import SCHEMA, row

    from shelfspark.catalog import rest

    body = "word " * 4000
    spark.createDataFrame([row(1, abstract=f"otter drawn from {body}otter drawn from")], SCHEMA).write.parquet(f"{tmp_path}/entries.parquet")
    for name, hit in (("hl03_terms", "otter"), ("hl04_phrases", "drawn from"), ("hl06_merged", "otter")):
        value = rest.QUERIES[name](spark, str(tmp_path)).collect()[0].value
        assert value.count(f"<mark>{hit}</mark>") == 2 and body in value
