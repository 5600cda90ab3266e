"""The record view of the test tables, and the same view as a SQL prefix for the checks.

``records`` holds all rows of entries under the usual field names.  crossref is derived: a
part of a book refers to the first book of its publisher, or to a key nobody has.  isbn and
issn are derived from the row id, so that valid and invalid check digits both occur.
``metadata``, ``notes`` and ``sessions`` are read off the event log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import read_table

FIELDS = "row_id key type title author editor journal booktitle publisher school institution volume number pages year month doi url abstract keywords tags custom added modified".split()


def records(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "entries")
    rename = {"entry_key": "key", "entry_type": "type", "issue_no": "number", "pub_year": "year", "pub_month": "month"}
    return e.withColumnsRenamed(rename).withColumn("type", F.lower("type")).select(*FIELDS)


def by_key(spark: SparkSession, d: str) -> DataFrame:
    """One record for each key: the first row."""
    r = records(spark, d)
    first = r.groupBy("key").agg(F.min("row_id").alias("row_id"))
    return r.join(first.select("row_id"), "row_id", "left_semi")


def with_crossref(spark: SparkSession, d: str) -> DataFrame:
    r = by_key(spark, d)
    books = r.where("type = 'book' and publisher != ''").groupBy("publisher").agg(F.min("key").alias("book"))
    part = F.col("type").isin("inbook", "incollection", "inproceedings") & (F.col("publisher") != "")
    # a publisher has one first book, so this side holds one row each
    return r.join(books, "publisher", "left").withColumn("crossref", F.when(part, F.coalesce("book", F.concat(F.lit("absent:"), "publisher")))).drop("book")


def with_numbers(spark: SparkSession, d: str) -> DataFrame:
    pad = F.lpad(F.col("row_id").cast("string"), 9, "0")
    last = (F.col("row_id") % 10).cast("string")
    return records(spark, d).select(
        "*", F.concat(F.lit("978"), pad, last).alias("isbn13"), F.concat(pad, last).alias("isbn10"),
        F.concat(F.lpad((F.col("row_id") % 10000).cast("string"), 4, "0"), F.lit("-"), F.lpad((F.col("row_id") % 1000).cast("string"), 3, "0"), last).alias("issn"),
    )


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events once each, with canonical type and key."""
    e = read_table(spark, d, "library_events")
    one = e.groupBy("event_id").agg(F.min_by(F.struct("event_type", "event_ts", "entry_key", "event_data"), "received").alias("v"), F.min("received").alias("received"))
    return one.select("event_id", F.upper("v.event_type").alias("event_type"), F.col("v.event_ts").alias("event_ts"), "received", F.nullif(F.lower(F.trim("v.entry_key")), F.lit("")).alias("entry_key"), F.col("v.event_data").alias("event_data"))


def metadata(spark: SparkSession, d: str) -> DataFrame:
    """(entry_key, rating, read_status, read_date, importance, notes_count, tags) from the log."""
    e = events(spark, d).where("entry_key is not null")
    n = lambda t: F.count_if(F.col("event_type") == t)
    g = e.groupBy("entry_key").agg(n("METADATA_UPDATED").alias("m"), n("NOTE_ADDED").alias("na"), n("NOTE_DELETED").alias("nd"), F.max("event_ts").alias("last"), F.collect_set(F.get_json_object("event_data", "$.actor")).alias("tags"))
    return g.select(
        "entry_key", (F.col("m") % 6).cast("int").alias("rating"), F.when(F.col("m") == 0, "unread").when(F.col("m") < 3, "reading").otherwise("read").alias("read_status"),
        F.when(F.col("m") >= 3, F.col("last")).alias("read_date"), F.when(F.col("na") > 3, "high").otherwise("normal").alias("importance"), F.greatest(F.lit(0), F.col("na") - F.col("nd")).alias("notes_count"), F.array_sort("tags").alias("tags"),
    )


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Versions of notes: each actor keeps one note on an entry, and every note event is a version of it."""
    from pyspark.sql import Window

    e = events(spark, d).where("entry_key is not null and event_type in ('NOTE_ADDED', 'NOTE_UPDATED')").withColumn("actor", F.get_json_object("event_data", "$.actor"))
    w = Window.partitionBy("entry_key", "actor").orderBy("event_ts", "event_id")
    return e.select(F.concat_ws("/", "entry_key", "actor").alias("note_id"), "entry_key", F.col("actor").alias("note_type"), "event_ts", F.concat_ws(" ", F.lower("event_type"), "event_data").alias("content"), F.row_number().over(w).cast("bigint").alias("version"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Reading sessions: minutes and pages from the ids of update events."""
    e = events(spark, d).where("entry_key is not null and event_type = 'ENTRY_UPDATED'")
    return e.select("event_id", "entry_key", "event_ts", (F.col("event_id") % 90 + 1).alias("minutes"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 40).alias("pages"))


def collections(spark: SparkSession, d: str) -> DataFrame:
    """The current row of each collection."""
    c = read_table(spark, d, "collections")
    cur = c.groupBy("id").agg(F.max(F.struct("modified", "entry_keys", "coll_name", "coll_query", "parent_id", "description", "color")).alias("v"))
    return cur.select("id", "v.*")


SQL_RECORDS = """WITH r AS (SELECT row_id, entry_key AS key, lower(entry_type) AS type, title, author, editor, journal, booktitle, publisher, school, institution, volume,
  issue_no AS number, pages, pub_year AS year, pub_month AS month, doi, url, abstract, keywords, tags, custom, added, modified FROM entries),
k AS (SELECT * FROM r WHERE row_id IN (SELECT min(row_id) FROM r GROUP BY key)),
b AS (SELECT publisher AS p, min(key) AS book FROM k WHERE type = 'book' AND publisher <> '' GROUP BY 1),
x AS (SELECT k.*, CASE WHEN type IN ('inbook', 'incollection', 'inproceedings') AND publisher <> '' THEN coalesce(book, 'absent:' || publisher) END AS crossref FROM k LEFT JOIN b ON k.publisher = b.p),
ev AS (SELECT event_id, upper(event_type) AS event_type, event_ts, received, nullif(lower(trim(entry_key)), '') AS entry_key, event_data, event_data ->> '$.actor' AS actor
  FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY received) AS rn FROM library_events) WHERE rn = 1),
meta AS (SELECT entry_key, CAST(m % 6 AS INT) AS rating, CASE WHEN m = 0 THEN 'unread' WHEN m < 3 THEN 'reading' ELSE 'read' END AS read_status, CASE WHEN m >= 3 THEN last END AS read_date,
  CASE WHEN na > 3 THEN 'high' ELSE 'normal' END AS importance, greatest(0, na - nd) AS notes_count, list_sort(tags) AS tags FROM (
  SELECT entry_key, count(*) FILTER (event_type = 'METADATA_UPDATED') AS m, count(*) FILTER (event_type = 'NOTE_ADDED') AS na, count(*) FILTER (event_type = 'NOTE_DELETED') AS nd, max(event_ts) AS last, list(DISTINCT actor) FILTER (actor IS NOT NULL) AS tags
  FROM ev WHERE entry_key IS NOT NULL GROUP BY 1)),
note AS (SELECT concat_ws('/', entry_key, actor) AS note_id, entry_key, actor AS note_type, event_ts, concat_ws(' ', lower(event_type), event_data) AS content,
  row_number() OVER (PARTITION BY entry_key, actor ORDER BY event_ts, event_id) AS version FROM ev WHERE entry_key IS NOT NULL AND event_type IN ('NOTE_ADDED', 'NOTE_UPDATED')),
sess AS (SELECT event_id, entry_key, event_ts, event_id % 90 + 1 AS minutes, CASE WHEN event_id % 4 <> 0 THEN event_id % 40 END AS pages FROM ev WHERE entry_key IS NOT NULL AND event_type = 'ENTRY_UPDATED'),
coll AS (SELECT id, modified, entry_keys, coll_name, coll_query, parent_id, description, color FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY modified DESC, entry_keys DESC NULLS LAST, coll_name DESC NULLS LAST, coll_query DESC NULLS LAST, parent_id DESC NULLS LAST) AS rn FROM collections) WHERE rn = 1)
"""
