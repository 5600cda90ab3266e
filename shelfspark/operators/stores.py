"""Stores and commands on them: upserts, versions, transactions, free keys, spelling over a vocabulary, collections."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.session import stage_dir
from . import quality as Q

TYPES = ("article", "book", "booklet", "conference", "inbook", "incollection", "inproceedings", "manual", "mastersthesis", "misc", "phdthesis", "proceedings", "techreport", "unpublished", "online", "dataset", "software", "thesis", "report")


def upsert(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Rows of ``new`` take the place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


class Versions:
    """A table in numbered versions; only committed ones are read, so an unfinished write or a rollback leaves no trace."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.committed, self.open = spark, f"{stage_dir(spark)}/versions-{uuid.uuid4().hex}", [], []

    def read(self, number: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={number or self.committed[-1]}")

    def begin(self) -> None:
        """Scopes nest; the outermost decides."""
        self.open.append(len(self.committed))

    def write(self, df: DataFrame) -> int:
        number = max(self.committed, default=0) + len(self.open) + 1
        df.write.mode("overwrite").parquet(f"{self.path}/version={number}")
        self.pending = number
        if not self.open:
            self.committed.append(number)
        return number

    def end(self, commit: bool = True) -> None:
        self.open.pop()
        if not self.open and commit:
            self.committed.append(self.pending)


def bulk_create(store: DataFrame, new: DataFrame, atomic: bool) -> DataFrame:
    """The store after a bulk creation; if it is atomic, one faulty or known record leaves the store as it was."""
    severity = Q.with_severity(new).where("errors = 0").select("row_id")
    good = new.join(severity, "row_id", "left_semi").join(store.select("key"), "key", "left_anti")
    if not atomic:
        return store.unionByName(good)
    counts = new.agg(F.count(F.lit(1)).alias("n")).crossJoin(good.agg(F.count(F.lit(1)).alias("ok")))  # one row each
    whole = counts.select((F.col("n") == F.col("ok")).alias("whole"))
    return store.unionByName(good.join(whole.where("whole"), F.lit(True), "left_semi"))


def first_gap(base: DataFrame, taken: DataFrame) -> DataFrame:
    """(key, gap): the smallest number from 1 on that is not among the taken ones (key, n), however many there are."""
    n = taken.distinct().withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("n")))
    run = n.where("n = at").groupBy("key").agg(F.count(F.lit(1)).alias("run"))
    return base.join(run, "key", "left").select("key", (F.coalesce("run", F.lit(0)) + 1).alias("gap"))


def free_keys(keys: DataFrame, known: DataFrame, joint: str, first: int, last: int | None, otherwise: str) -> DataFrame:
    """
    (key, free_key): key+a to key+z, then key+joint+number from ``first`` on; beyond ``last``, if there is one, key_otherwise.
    The suffixes in use are found by splitting the known keys, so no candidates are made.
    """
    letters = known.where(r"key rlike '.[a-z]$'").select(F.expr("left(key, length(key) - 1)").alias("key"), F.expr("right(key, 1)").alias("x"))
    used = keys.join(letters, "key").groupBy("key").agg(F.array_sort(F.collect_set("x")).alias("used"))  # at most 26
    free = F.array_min(F.array_except(F.array(*[F.lit(chr(c)) for c in range(97, 123)]), F.coalesce("used", F.array().cast("array<string>"))))
    # every way of taking a number off the end: a key that ends in digits itself is a base as well
    digits = F.length(F.regexp_extract("key", r"(\d+)$", 1))
    cut_off = known.select("key", F.explode(F.sequence(F.lit(1), F.greatest(digits, F.lit(1)))).alias("k")).where("k <= length(regexp_extract(key, '([0-9]+)$', 1))")
    numbered = cut_off.select(F.expr(f"left(key, length(key) - k - {len(joint)})").alias("key"), F.expr(f"substring(key, length(key) - k - {len(joint)} + 1, {len(joint)})").alias("j"), F.expr("right(key, k)").alias("d"))
    numbered = numbered.where((F.col("j") == joint) & (F.col("d").substr(1, 1) != "0")).select("key", (F.col("d").cast("decimal(38,0)") - (first - 1)).alias("n")).where("n >= 1")
    gaps = first_gap(keys, numbered).select("key", (F.col("gap") + (first - 1)).alias("number"))
    number = F.concat("key", F.lit(joint), F.col("number").cast("string"))
    fallback = F.concat("key", F.lit("_" + otherwise))
    number = number if last is None else F.when(F.col("number") <= last, number).otherwise(fallback)
    return keys.join(used, "key", "left").join(gaps, "key").select("key", F.coalesce(F.concat("key", free), number).alias("free_key"))


def deletions(c: Column) -> Column:
    """The word and all that is left of it with one or two letters taken out."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.length(w))))
    return F.array_distinct(F.concat(F.array(c), one(c), F.flatten(F.transform(one(c), one))))


def corrections(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, suggestion, distance): the nearest word of (term, df) within two edits, of equally near ones the most frequent; words meet on deletions, so nothing is compared with the whole vocabulary."""
    left = words.select(F.col("term").alias("w"), F.explode(deletions(F.col("term"))).alias("d"))
    right = vocabulary.select(F.col("term").alias("v"), "df", F.explode(deletions(F.col("term"))).alias("d"))
    near = left.join(right, "d").where("w != v").select("w", "v", "df").distinct().withColumn("distance", F.levenshtein("w", "v")).where("distance <= 2")
    best = near.groupBy("w").agg(F.min(F.struct("distance", (-F.col("df")).alias("n"), "v")).alias("b"))
    return best.select(F.col("w").alias("term"), F.col("b.v").alias("suggestion"), F.col("b.distance").cast("bigint").alias("distance"))


def from_json(c: Column) -> Column:
    """A record of a JSON text: lists to arrays, types by their names, unknown ones misc."""
    x = F.from_json(c, "key string, type string, title string, year int, keywords array<string>")
    kind = F.lower(F.trim(x["type"]))
    return F.struct(x["key"].alias("key"), F.when(kind.isin(*TYPES), kind).otherwise("misc").alias("type"), x["title"].alias("title"), x["year"].alias("year"), F.coalesce(x["keywords"], F.array().cast("array<string>")).alias("keywords"))


def create_collections(store: DataFrame, names: DataFrame) -> DataFrame:
    """(name, created): a collection is made for each name that is not blank and not there yet."""
    have = store.select(F.lower(F.trim("coll_name")).alias("n")).where("n != ''").distinct().withColumn("there", F.lit(True))
    want = names.withColumn("n", F.lower(F.trim("name")))
    return want.join(have, "n", "left").select("name", (F.coalesce(F.col("n") != "", F.lit(False)) & F.col("there").isNull()).alias("created"))


def delete_collections(store: DataFrame, gone: DataFrame) -> DataFrame:
    """The store without the named ids; children of a deleted collection become roots."""
    ids = gone.select(F.col("id").alias("g")).withColumn("gone", F.lit(True))
    left = store.join(gone.select("id"), "id", "left_anti")
    return left.join(ids, F.lower(F.trim("parent_id")) == F.col("g"), "left").withColumn("parent_id", F.when(F.col("gone").isNull(), F.col("parent_id"))).drop("g", "gone")


def wrapped(c: Column, width: int = 70, indent: str = "      ") -> Column:
    """Lines of at most ``width`` letters; a longer word keeps a line of its own."""
    line = rf"(\S{{{width + 1},}}|.{{1,{width}}})(?:\s+|$)"
    return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), line, f"$1\n{indent}"), r"\s+$", "")


def keyword_rows(df: DataFrame, tag: str) -> DataFrame:
    """Tags with one more, each once."""
    return df.withColumn("tags", F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit(tag))))


def document(df: DataFrame) -> DataFrame:
    """What is indexed of a record: analysed fields, authors as a list, all text, and what is known of it."""
    text = F.concat_ws(" ", *[T.filled(F.col(c)) for c in ("title", "author", "abstract", "journal")])
    return df.select(
        "row_id", "key", "year", F.lower(text).alias("content"), F.coalesce(F.array_join(T.tokens(F.col("title")), " "), F.lit("")).alias("title_terms"), F.coalesce(F.array_join(T.tokens(F.col("abstract")), " "), F.lit("")).alias("abstract_terms"),
        F.array_join(T.people(F.col("author")), "; ").alias("author_list"), F.length(text).cast("bigint").alias("text_length"),
        sum((T.filled(F.col(c)).isNotNull().cast("bigint") for c in ("title", "author", "abstract", "journal", "doi", "pages")), F.lit(0).cast("bigint")).alias("field_count"),
    )
