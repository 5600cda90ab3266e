"""Joins, aggregations, windows and set operations over records, collections, notes and the event log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relations as J
from ..operators.windows import global_rank
from .records import SQL_RECORDS as R
from .records import by_key, collections, events, metadata, notes, records, sessions, with_crossref
from .registry import Catalog

C = Catalog()
QUERIES, SQL = C.QUERIES, C.SQL
add = C.add
n_ = lambda: F.count(F.lit(1)).alias("n")
tags = lambda *t: F.array(*[F.lit(x) for x in t])

# joins
add("join01_crossref", lambda s, d: J.resolve_crossref(with_crossref(s, d)).where("found").select("key", "booktitle", "editor", "month", "volume"), R + """SELECT c.key, CASE WHEN p.type IN ('book', 'proceedings') AND c.type LIKE 'in%' THEN coalesce(nullif(c.booktitle, ''), p.title) ELSE c.booktitle END AS booktitle,
  coalesce(nullif(c.editor, ''), p.editor) AS editor, coalesce(nullif(c.month, ''), p.month) AS month, coalesce(nullif(c.volume, ''), p.volume) AS volume FROM x c JOIN x p ON c.crossref = p.key AND c.key <> p.key""")
add("join02_dangling", lambda s, d: _dangling(s, d), R + "SELECT key, crossref FROM x WHERE crossref IS NOT NULL AND crossref NOT IN (SELECT key FROM x)")
add("join03_compatible", lambda s, d: _compatible(s, d), R + "SELECT c.key, c.type, p.type AS parent_type FROM x c JOIN x p ON c.crossref = p.key WHERE NOT coalesce((c.type = 'inbook' AND p.type = 'book') OR (c.type = 'incollection' AND p.type IN ('book', 'proceedings')) OR (c.type = 'inproceedings' AND p.type = 'proceedings'), false)")
add("join04_order", lambda s, d: _order(s, d), R + "SELECT c.key FROM x c LEFT JOIN x p ON c.crossref = p.key WHERE c.crossref IS NOT NULL AND (p.key IS NULL OR p.row_id < c.row_id)")
add("join05_referenced", lambda s, d: _referenced(s, d), R + "SELECT key FROM x WHERE key IN (SELECT crossref FROM x)")
add("join06_hydrate", lambda s, d: _hydrate(s, d), R + "SELECT e.entry_key, k.title FROM (SELECT DISTINCT entry_key FROM ev WHERE event_type = 'ENTRY_CREATED' AND entry_key IS NOT NULL) e JOIN k ON lower(trim(k.key)) = e.entry_key")
add("join07_metadata", lambda s, d: _with_meta(s, d), R + "SELECT k.key, coalesce(m.rating, 0) AS rating, coalesce(m.read_status, 'unread') AS read_status, coalesce(m.notes_count, 0) AS notes_count FROM k LEFT JOIN meta m ON lower(trim(k.key)) = m.entry_key")
add("join08_members", lambda s, d: _members(s, d).select("id", "pos", "key", "title"), R + "SELECT c.id, CAST(c.pos AS BIGINT) AS pos, k.key, k.title FROM (SELECT id, unnest(entry_keys) AS m, unnest(range(len(entry_keys))) AS pos FROM coll) c JOIN k ON lower(trim(k.key)) = lower(trim(c.m))")
add("join09_containing", lambda s, d: collections(s, d).select("id", F.explode(F.array_distinct("entry_keys")).alias("key")).groupBy("key").agg(n_()), R + "SELECT key, count(*) AS n FROM (SELECT DISTINCT id, unnest(entry_keys) AS key FROM coll) GROUP BY 1")
add("join10_existence_split", lambda s, d: _split(s, d), R + "SELECT id, count(*) FILTER (found) AS added, count(*) FILTER (NOT found) AS absent FROM (SELECT id, m IN (SELECT key FROM k) AS found FROM (SELECT DISTINCT id, unnest(entry_keys) AS m FROM coll WHERE entry_keys IS NOT NULL) WHERE m IS NOT NULL) GROUP BY 1")
add("join11_key_diff", lambda s, d: _diff(s, d), R + "SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT key FROM k WHERE year < 2010) a FULL JOIN (SELECT key FROM k WHERE year > 2000) b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL")
add("join12_year_band", lambda s, d: _band(s, d), R + "SELECT a.row_id AS a, b.row_id AS b FROM r a JOIN r b ON lower(trim(a.title)) = lower(trim(b.title)) AND a.author = b.author AND a.row_id < b.row_id AND abs(a.year - b.year) BETWEEN 1 AND 1")
add("join14_children", lambda s, d: collections(s, d).where("parent_id is not null").groupBy("parent_id").agg(n_()), R + "SELECT parent_id, count(*) AS n FROM coll WHERE parent_id IS NOT NULL GROUP BY 1")
add("join15_delete_children", lambda s, d: _prune(s, d), R + "SELECT id FROM coll WHERE id NOT IN (SELECT id FROM coll WHERE coll_name = 'Misc.') AND (parent_id IS NULL OR parent_id NOT IN (SELECT id FROM coll WHERE coll_name = 'Misc.'))")


def _dangling(s, d):
    x = with_crossref(s, d)
    return x.where("crossref is not null").join(x.select(F.col("key").alias("crossref")), "crossref", "left_anti").select("key", "crossref")


def _compatible(s, d):
    x = with_crossref(s, d)
    p = x.select(F.col("key").alias("crossref"), F.col("type").alias("parent_type"))
    ok = ((F.col("type") == "inbook") & (F.col("parent_type") == "book")) | ((F.col("type") == "incollection") & F.col("parent_type").isin("book", "proceedings")) | ((F.col("type") == "inproceedings") & (F.col("parent_type") == "proceedings"))
    return x.join(p, "crossref").where(~F.coalesce(ok, F.lit(False))).select("key", "type", "parent_type")


def _order(s, d):
    x = with_crossref(s, d)
    p = x.select(F.col("key").alias("crossref"), F.col("row_id").alias("p"))
    return x.where("crossref is not null").join(p, "crossref", "left").where("p is null or p < row_id").select("key")


def _referenced(s, d):
    x = with_crossref(s, d)
    return x.join(x.select(F.col("crossref").alias("key")), "key", "left_semi").select("key")


def _hydrate(s, d):
    hits = events(s, d).where("event_type = 'ENTRY_CREATED' and entry_key is not null").select("entry_key").distinct()
    return hits.join(by_key(s, d).select(F.lower(F.trim("key")).alias("entry_key"), "title"), "entry_key")


def _with_meta(s, d):
    k = by_key(s, d).select("key", F.lower(F.trim("key")).alias("entry_key"))
    return k.join(metadata(s, d), "entry_key", "left").select("key", F.coalesce("rating", F.lit(0)).alias("rating"), F.coalesce("read_status", F.lit("unread")).alias("read_status"), F.coalesce("notes_count", F.lit(0)).cast("bigint").alias("notes_count"))


def _members(s, d):
    m = collections(s, d).select("id", F.posexplode("entry_keys").alias("pos", "m")).select("id", F.col("pos").cast("bigint").alias("pos"), F.lower(F.trim("m")).alias("k"))
    return m.join(by_key(s, d).select("key", "title", "type", F.lower(F.trim("key")).alias("k")), "k")


def _split(s, d):
    m = collections(s, d).select("id", F.explode("entry_keys").alias("key")).where("key is not null").distinct()
    k = by_key(s, d).select("key", F.lit(True).alias("found"))
    return m.join(k, "key", "left").groupBy("id").agg(F.count_if("found").alias("added"), F.count_if(F.col("found").isNull()).alias("absent"))


def _diff(s, d):
    k = by_key(s, d)
    a = k.where("year < 2010").select("key", F.lit(1).alias("a"))
    b = k.where("year > 2000").select("key", F.lit(1).alias("b"))
    return a.join(b, "key", "full").where("a is null or b is null").select("key", F.when(F.col("b").isNull(), "missing").otherwise("extra").alias("side"))


def _band(s, d):
    """Equal title and author, years one apart: an equi-join on (title, author, year), the other side shifted by a year."""
    r = records(s, d).where("title is not null and author is not null and year is not null").select("row_id", F.lower(F.trim("title")).alias("t"), "author", "year")
    b = r.select(F.col("row_id").alias("b"), "t", "author", F.explode(F.array(F.col("year") - 1, F.col("year") + 1)).alias("year"))
    return r.withColumnRenamed("row_id", "a").join(b, ["t", "author", "year"]).where("a < b").select("a", "b")


def _prune(s, d):
    c = collections(s, d)
    gone = c.where("coll_name = 'Misc.'").select("id")
    return c.join(gone, "id", "left_anti").join(gone.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("id")


# aggregations
add("agg01_statistics", lambda s, d: records(s, d).groupingSets([["type"], ["year"], []], "type", "year").agg(n_(), F.grouping_id().alias("g")).where("g = 3 or g = 1 or (g = 2 and year > 0)").select("type", "year", "n"), R + "SELECT type, CAST(NULL AS INT) AS year, count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT NULL, year, count(*) FROM r WHERE year > 0 GROUP BY 2 UNION ALL SELECT NULL, NULL, count(*) FROM r")
add("agg02_by_type_year", lambda s, d: records(s, d).groupBy("type", "year").agg(n_()).orderBy(F.desc("n"), "type", "year"), R + "SELECT type, year, count(*) AS n FROM r GROUP BY ALL")
add("agg03_collections", lambda s, d: collections(s, d).agg(n_(), F.count_if(F.col("coll_query").isNull()).alias("manual"), F.count("coll_query").alias("smart"), F.max(F.size("entry_keys")).cast("bigint").alias("largest"), F.round(F.avg(F.when(F.size("entry_keys") > 0, F.size("entry_keys"))), 4).alias("mean")), R + "SELECT count(*) AS n, count(*) FILTER (coll_query IS NULL) AS manual, count(coll_query) AS smart, max(len(entry_keys)) AS largest, round(avg(len(entry_keys)) FILTER (len(entry_keys) > 0), 4) AS mean FROM coll")
add("agg04_crossref_counts", lambda s, d: with_crossref(s, d).where("crossref is not null").groupBy("crossref").agg(n_()).where("n >= 2"), R + "SELECT crossref, count(*) AS n FROM x WHERE crossref IS NOT NULL GROUP BY 1 HAVING count(*) >= 2")
add("agg05_tags", lambda s, d: records(s, d).select(F.explode("tags").alias("tag")).groupBy("tag").agg(n_()).orderBy(F.desc("n"), "tag"), R + "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM r) GROUP BY 1")
add("agg06_terms_facet", lambda s, d: records(s, d).where("journal != ''").groupBy("journal").agg(n_()).where("n >= 2").orderBy(F.desc("n"), "journal").limit(20), R + "SELECT journal, count(*) AS n FROM r WHERE journal <> '' GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, journal LIMIT 20")
_RANGE = lambda: F.when(F.col("year") < 1970, "early").when(F.col("year") < 1990, "middle").when(F.col("year") < 2010, "late").when(F.col("year") < 2100, "recent")
add("agg07_range_facet", lambda s, d: records(s, d).groupBy(_RANGE().alias("bucket")).agg(n_()).where("bucket is not null"), R + "SELECT CASE WHEN year < 1970 THEN 'early' WHEN year < 1990 THEN 'middle' WHEN year < 2010 THEN 'late' WHEN year < 2100 THEN 'recent' END AS bucket, count(*) AS n FROM r WHERE year < 2100 GROUP BY 1")
add("agg08_date_histogram", lambda s, d: events(s, d).groupBy(F.date_format("event_ts", "yyyy-MM").alias("month")).agg(n_()).orderBy("month"), R + "SELECT strftime(event_ts, '%Y-%m') AS month, count(*) AS n FROM ev GROUP BY 1")
add("agg09_facet_values", lambda s, d: records(s, d).select(F.explode("keywords").alias("value")).where("value != ''").groupBy("value").agg(n_()), R + "SELECT value, count(*) AS n FROM (SELECT unnest(keywords) AS value FROM r) WHERE value <> '' GROUP BY 1")


def top_facets(df, fields, most=10):
    """Top values of several fields in one pass: the columns are turned into rows, counted, and ranked within the field."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("x.*").where("value != ''")
    w = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    return long.groupBy("field", "value").agg(n_()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("field", "value", "n")


_FACETS = " UNION ALL ".join(f"SELECT '{f}' AS field, CAST({f} AS VARCHAR) AS value, count(*) AS n FROM r WHERE CAST({f} AS VARCHAR) <> '' GROUP BY 2" for f in ("type", "year", "journal", "publisher"))
add("agg10_top_facets", lambda s, d: top_facets(records(s, d), ["type", "year", "journal", "publisher"]), R + f"SELECT field, value, n FROM ({_FACETS}) QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) <= 10")
add("agg12_merge_facets", lambda s, d: top_facets(records(s, d).where("year < 2000"), ["type"]).unionByName(top_facets(records(s, d).where("year >= 2000"), ["type"])).groupBy("field", "value").agg(F.sum("n").alias("n")), R + "SELECT 'type' AS field, type AS value, CAST(sum(n) AS BIGINT) AS n FROM (SELECT type, n FROM (SELECT type, count(*) AS n FROM r WHERE year < 2000 GROUP BY 1 ORDER BY n DESC, type LIMIT 10) UNION ALL SELECT type, n FROM (SELECT type, count(*) AS n FROM r WHERE year >= 2000 GROUP BY 1 ORDER BY n DESC, type LIMIT 10)) GROUP BY 2")
add("agg17_simple_duplicates", lambda s, d: records(s, d).groupBy(F.lower(F.trim("title")).alias("t"), F.lower(F.trim("author")).alias("a")).agg(n_(), F.min("row_id").alias("first")).where("n > 1").select("first", "n"), R + "SELECT min(row_id) AS first, count(*) AS n FROM r GROUP BY lower(trim(title)), lower(trim(author)) HAVING count(*) > 1")
add("agg18_reading_stats", lambda s, d: sessions(s, d).groupBy("entry_key").agg(n_(), F.sum("minutes").alias("minutes"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.round(F.avg("minutes"), 4).alias("mean_minutes"), F.round(F.sum(F.coalesce("pages", F.lit(0))) / F.count(F.lit(1)), 4).alias("mean_pages")), R + "SELECT entry_key, count(*) AS n, CAST(sum(minutes) AS BIGINT) AS minutes, CAST(coalesce(sum(pages), 0) AS BIGINT) AS pages, round(avg(minutes), 4) AS mean_minutes, round(sum(coalesce(pages, 0)) / count(*), 4) AS mean_pages FROM sess GROUP BY 1")
add("agg19_percentage", lambda s, d: sessions(s, d).select("event_id", F.when((F.col("pages") > 0) & (F.col("minutes") > 0), F.round(F.col("pages") / F.col("minutes") * 100, 4)).otherwise(0.0).alias("percentage")), R + "SELECT event_id, CASE WHEN pages > 0 AND minutes > 0 THEN round(pages / minutes * 100, 4) ELSE 0.0 END AS percentage FROM sess")
add("agg20_keywords", lambda s, d: _top_words(s, d), R + "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]+')) AS word FROM r) WHERE length(word) > 3 GROUP BY 1 ORDER BY n DESC, word LIMIT 30")
add("agg21_rates", lambda s, d: events(s, d).agg(n_(), F.round(F.count("entry_key") * 100 / F.count(F.lit(1)), 2).alias("keyed_rate"), F.round(F.avg(F.unix_micros(F.col("received").cast("timestamp")) - F.unix_micros(F.col("event_ts").cast("timestamp"))) / 1e6, 1).alias("mean_lag")), R + "SELECT count(*) AS n, round(count(entry_key) * 100 / count(*), 2) AS keyed_rate, round(avg(epoch_us(received) - epoch_us(event_ts)) / 1e6, 1) AS mean_lag FROM ev")
add("agg22_step_summary", lambda s, d: events(s, d).groupBy(F.split_part("event_type", F.lit("_"), F.lit(1)).alias("step")).agg(n_(), F.count_if(F.col("event_type").endswith("DELETED")).alias("deleted")), R + "SELECT split_part(event_type, '_', 1) AS step, count(*) AS n, count(*) FILTER (event_type LIKE '%DELETED') AS deleted FROM ev GROUP BY 1")
add("agg24_ranges", lambda s, d: records(s, d).agg(F.min("year").alias("lo"), F.max("year").alias("hi")), R + "SELECT min(year) AS lo, max(year) AS hi FROM r")
add("agg25_index_statistics", lambda s, d: records(s, d).select("row_id", F.explode_outer(T.tokens(F.col("title"))).alias("term")).agg(F.countDistinct("row_id").alias("docs"), F.countDistinct("term").alias("terms")), R + "SELECT (SELECT count(*) FROM r) AS docs, count(DISTINCT term) AS terms FROM (SELECT unnest(regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]+')) AS term FROM r)")
add("agg26_counts_per_table", lambda s, d: by_key(s, d).select(F.lit("records").alias("what")).unionByName(collections(s, d).select(F.lit("collections").alias("what"))).unionByName(metadata(s, d).select(F.lit("metadata").alias("what"))).unionByName(notes(s, d).select(F.lit("notes").alias("what"))).groupBy("what").agg(n_()), R + "SELECT 'records' AS what, count(*) AS n FROM k UNION ALL SELECT 'collections', count(*) FROM coll UNION ALL SELECT 'metadata', count(*) FROM meta UNION ALL SELECT 'notes', count(*) FROM note")
add("agg27_cube", lambda s, d: records(s, d).cube("type", "publisher").agg(n_(), F.grouping_id().alias("g")).select("type", "publisher", "n", "g"), R + "SELECT type, publisher, count(*) AS n, CAST(grouping(type, publisher) AS BIGINT) AS g FROM r GROUP BY CUBE (type, publisher)")


def _top_words(s, d):
    return records(s, d).select(F.explode(T.tokens(F.col("title"))).alias("word")).where("length(word) > 3").groupBy("word").agg(n_()).orderBy(F.desc("n"), "word").limit(30)


# windows
_LABEL = lambda: F.concat(F.upper(F.substring(F.regexp_replace(T.last_name(F.trim(F.substring_index("author", " and ", 1))), r"[^A-Za-z]", ""), 1, 3)), F.lpad((F.col("year") % 100).cast("string"), 2, "0"))
_SLABEL = r"upper(substr(regexp_replace(CASE WHEN contains(a, ',') THEN trim(split_part(a, ',', 1)) ELSE regexp_extract(trim(a), '(\S+)$', 1) END, '[^A-Za-z]', '', 'g'), 1, 3)) || lpad(CAST(year % 100 AS VARCHAR), 2, '0')"
add("win01_alpha_labels", lambda s, d: records(s, d).where("author != '' and year is not null").select("row_id", _LABEL().alias("base")).withColumn("rn", F.row_number().over(Window.partitionBy("base").orderBy("row_id"))).select("row_id", F.concat("base", F.when((F.col("rn") > 1) & (F.col("rn") <= 26), F.expr("char(96 + rn - 1)")).otherwise("")).alias("label")), R + f"SELECT row_id, base || CASE WHEN rn BETWEEN 2 AND 26 THEN chr(CAST(96 + rn - 1 AS INT)) ELSE '' END AS label FROM (SELECT row_id, base, row_number() OVER (PARTITION BY base ORDER BY row_id) AS rn FROM (SELECT row_id, {_SLABEL} AS base FROM (SELECT row_id, year, trim(split_part(author, ' and ', 1)) AS a FROM r WHERE author <> '' AND year IS NOT NULL)))")
add("win02_numeric_labels", lambda s, d: global_rank(records(s, d).groupBy("key").agg(F.min("row_id").alias("row_id")), ["row_id"], "label").select("key", "label"), R + "SELECT key, row_number() OVER (ORDER BY row_id) AS label FROM k")
add("win03_latest_notes", lambda s, d: notes(s, d).groupBy("note_id").agg(F.max("version").alias("version"), F.max_by("content", "version").alias("content")), R + "SELECT note_id, version, content FROM note QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY version DESC) = 1")
add("win03b_note_history", lambda s, d: notes(s, d).where("note_type = 'ana'").select("note_id", "version", "event_ts").orderBy("note_id", "version"), R + "SELECT note_id, version, event_ts FROM note WHERE note_type = 'ana'")
add("win04_next_version", lambda s, d: notes(s, d).groupBy("note_id").agg((F.max("version") + 1).alias("next")), R + "SELECT note_id, max(version) + 1 AS next FROM note GROUP BY 1")
_W = lambda: Window.partitionBy("key").orderBy("row_id")
add("win05_skip", lambda s, d: records(s, d).withColumn("rn", F.row_number().over(_W())).where("rn = 1").select("row_id", "key"), R + "SELECT min(row_id) AS row_id, key FROM r GROUP BY key")
add("win05b_overwrite", lambda s, d: records(s, d).groupBy("key").agg(F.max("row_id").alias("row_id")), R + "SELECT max(row_id) AS row_id, key FROM r GROUP BY key")
add("win05c_rename", lambda s, d: records(s, d).withColumn("rn", F.row_number().over(_W())).select("row_id", F.concat("key", F.when(F.col("rn") > 1, F.concat(F.lit("_"), (F.col("rn") - 1).cast("string"))).otherwise("")).alias("key")), R + "SELECT row_id, key || CASE WHEN rn > 1 THEN '_' || (rn - 1) ELSE '' END AS key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY row_id) AS rn FROM r)")
add("win05d_merge", lambda s, d: records(s, d).groupBy("key").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("row_id"))).alias(c) for c in ("doi", "abstract", "url")]), R + "SELECT key, " + ", ".join(f"arg_max({c}, row_id) AS {c}" for c in ("doi", "abstract", "url")) + " FROM r GROUP BY key")
add("win06_first_of_union", lambda s, d: _union_first(s, d), R + "SELECT key, min(src) AS src FROM (SELECT key, 1 AS src FROM k WHERE year > 2000 UNION ALL SELECT key, 2 FROM k WHERE type = 'book') GROUP BY 1")
add("win07_year_islands", lambda s, d: _islands(s, d), R + "SELECT min(row_id) AS first, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY t, a ORDER BY year, row_id) AS island FROM (SELECT row_id, year, lower(trim(title)) AS t, author AS a, year - lag(year) OVER (PARTITION BY lower(trim(title)), author ORDER BY year, row_id) > 1 AS gap FROM r WHERE year IS NOT NULL AND author IS NOT NULL)) GROUP BY t, a, island HAVING count(*) > 1")
add("win08_page_of_results", lambda s, d: global_rank(records(s, d).where("type = 'book'").select("row_id", "year"), ["year", "row_id"]).where("place between 11 and 20").select("row_id", "place"), R + "SELECT row_id, row_number() OVER (ORDER BY year NULLS FIRST, row_id) AS place FROM r WHERE type = 'book' QUALIFY place BETWEEN 11 AND 20")
add("win11_event_history", lambda s, d: events(s, d).where("event_type = 'ENTRY_DELETED'").orderBy(F.desc("event_ts"), F.desc("event_id")).limit(100).select("event_id", "event_ts"), R + "SELECT event_id, event_ts FROM ev WHERE event_type = 'ENTRY_DELETED' ORDER BY event_ts DESC, event_id DESC LIMIT 100")


def _union_first(s, d):
    k = by_key(s, d)
    both = k.where("year > 2000").select("key", F.lit(1).alias("src")).unionByName(k.where("type = 'book'").select("key", F.lit(2).alias("src")))
    return both.groupBy("key").agg(F.min("src").alias("src"))


def _islands(s, d):
    r = records(s, d).where("year is not null and author is not null").select("row_id", "year", F.lower(F.trim("title")).alias("t"), F.col("author").alias("a"))
    return J.year_islands(r, ["t", "a"], "year", 1).groupBy("t", "a", "island").agg(F.min("row_id").alias("first"), n_()).where("n > 1").select("first", "n")


# sets
add("set01_all_tags", lambda s, d: records(s, d).where(F.array_contains("tags", "thesis") & F.array_contains("tags", "survey")).select("row_id"), R + "SELECT row_id FROM r WHERE list_has_all(tags, ['thesis', 'survey'])")
add("set01b_any_tag", lambda s, d: records(s, d).where(F.arrays_overlap("tags", tags("thesis", "survey"))).select("row_id"), R + "SELECT row_id FROM r WHERE list_has_any(tags, ['thesis', 'survey'])")
add("set02_by_tag", lambda s, d: records(s, d).where(F.array_contains("tags", "toread")).select("row_id"), R + "SELECT row_id FROM r WHERE list_contains(tags, 'toread')")
_join = lambda c: F.array_join(F.array_sort(c), "|")
add("set03_rename_tag", lambda s, d: records(s, d).select("row_id", _join(J.rename_tag(F.col("tags"), "toread", "seminar")).alias("tags")), R + "SELECT row_id, array_to_string(list_sort(list_distinct(list_transform(tags, lambda t: CASE WHEN t = 'toread' THEN 'seminar' ELSE t END))), '|') AS tags FROM r")
add("set04_merge_tags", lambda s, d: records(s, d).select("row_id", _join(J.merge_tags(F.col("tags"), ["toread", "to check"], "queue")).alias("tags")), R + "SELECT row_id, array_to_string(list_sort(CASE WHEN list_has_any(tags, ['toread', 'to check']) THEN list_append(list_distinct(list_filter(tags, lambda t: t NOT IN ('toread', 'to check'))), 'queue') ELSE tags END), '|') AS tags FROM r")
add("set05_add_remove", lambda s, d: records(s, d).select("row_id", _join(F.array_except(F.array_union("tags", tags("new")), tags("thesis"))).alias("tags")), R + "SELECT row_id, array_to_string(list_sort(list_distinct(list_filter(list_append(tags, 'new'), lambda t: t <> 'thesis'))), '|') AS tags FROM r")
add("set06_note_tags", lambda s, d: notes(s, d).groupBy("entry_key").agg(_join(F.array_union(F.array_except(F.collect_set("note_type"), tags("ana")), tags("checked"))).alias("tags")), R + "SELECT entry_key, array_to_string(list_sort(list_append(list_filter(list(DISTINCT note_type), lambda t: t <> 'ana'), 'checked')), '|') AS tags FROM note GROUP BY 1")
add("set08_merge_collections", lambda s, d: collections(s, d).where("entry_keys is not null").select("coll_name", F.explode("entry_keys").alias("k")).groupBy("coll_name").agg(F.countDistinct("k").alias("n")), R + "SELECT coll_name, count(DISTINCT k) AS n FROM (SELECT coll_name, unnest(entry_keys) AS k FROM coll) GROUP BY 1")
add("set09_add_entries", lambda s, d: collections(s, d).where("entry_keys is not null").select("id", F.size(F.array_union("entry_keys", tags("a", "a", "b"))).cast("bigint").alias("n")), R + "SELECT id, len(list_distinct(list_concat(entry_keys, ['a', 'b']))) + CAST(len(list_filter(entry_keys, lambda x: x IS NULL)) > 0 AS INT) AS n FROM coll WHERE entry_keys IS NOT NULL")
add("set10_remove_entries", lambda s, d: collections(s, d).where("entry_keys is not null").select("id", F.size(F.filter("entry_keys", lambda x: ~x.startswith("a"))).cast("bigint").alias("n")), R + "SELECT id, len(list_filter(entry_keys, lambda x: NOT starts_with(x, 'a'))) AS n FROM coll WHERE entry_keys IS NOT NULL")
add("set11_guarded_add", lambda s, d: collections(s, d).select("id", F.when(F.col("coll_query").isNotNull(), "smart").otherwise("added").alias("outcome")), R + "SELECT id, CASE WHEN coll_query IS NOT NULL THEN 'smart' ELSE 'added' END AS outcome FROM coll")
add("set12_union_values", lambda s, d: records(s, d).select("key", F.explode("keywords").alias("k")).groupBy("key").agg(F.countDistinct("k").alias("n")), R + "SELECT key, count(DISTINCT k) AS n FROM (SELECT key, unnest(keywords) AS k FROM r) GROUP BY 1")
add("set12b_common_values", lambda s, d: _common(s, d), R + "SELECT k.key, t.tag FROM (SELECT key, count(*) AS n FROM r GROUP BY 1) k JOIN (SELECT key, tag, count(DISTINCT row_id) AS m FROM (SELECT key, row_id, unnest(tags) AS tag FROM r) GROUP BY ALL) t ON k.key = t.key AND k.n = t.m")
add("set14_union_hits", lambda s, d: records(s, d).where("year = 2000").select("key").union(records(s, d).where("type = 'misc'").select("key")).distinct(), R + "SELECT DISTINCT key FROM r WHERE year = 2000 OR type = 'misc'")
add("set15_difference", lambda s, d: records(s, d).where("year < 2000").select("key").subtract(records(s, d).where("type = 'article'").select("key")), R + "SELECT key FROM r WHERE year < 2000 EXCEPT SELECT key FROM r WHERE type = 'article'")


def _common(s, d):
    r = records(s, d)
    size = r.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    held = r.select("key", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("key", "tag").agg(F.count(F.lit(1)).alias("m"))
    return held.join(size, "key").where("m = n").select("key", "tag")


# side tables
add("crud05_all_collections", lambda s, d: collections(s, d).select("id", "coll_name", "coll_query"), R + "SELECT id, coll_name, coll_query FROM coll")
add("crud06_smart", lambda s, d: collections(s, d).where("coll_query is not null").select("id"), R + "SELECT id FROM coll WHERE coll_query IS NOT NULL")
add("crud07_by_name", lambda s, d: collections(s, d).where("coll_name = 'Reading list'").select("id"), R + "SELECT id FROM coll WHERE coll_name = 'Reading list'")
add("crud08_entry_count", lambda s, d: collections(s, d).select("id", F.coalesce(F.size("entry_keys"), F.lit(0)).cast("bigint").alias("n")).withColumn("n", F.greatest("n", F.lit(0))), R + "SELECT id, coalesce(len(entry_keys), 0) AS n FROM coll")
add("crud10_is_member", lambda s, d: collections(s, d).select("id", F.coalesce(F.array_contains("entry_keys", "Muszekot2017_sleep_005em"), F.lit(False)).alias("is_in")), R + "SELECT id, coalesce(list_contains(entry_keys, 'Muszekot2017_sleep_005em'), false) AS is_in FROM coll")
add("crud12_rename", lambda s, d: collections(s, d).select("id", F.when(F.col("coll_name") == "Misc.", "Miscellany").otherwise(F.col("coll_name")).alias("coll_name")), R + "SELECT id, CASE WHEN coll_name = 'Misc.' THEN 'Miscellany' ELSE coll_name END AS coll_name FROM coll")
add("crud03_orphan_metadata", lambda s, d: metadata(s, d).join(by_key(s, d).select(F.lower(F.trim("key")).alias("entry_key")), "entry_key", "left_anti").select("entry_key"), R + "SELECT entry_key FROM meta WHERE entry_key NOT IN (SELECT lower(trim(key)) FROM k)")
add("crud15_metadata", lambda s, d: metadata(s, d).select("entry_key", "rating", "read_status", "read_date", F.array_join("tags", "|").alias("tags")), R + "SELECT entry_key, rating, read_status, read_date, array_to_string(tags, '|') AS tags FROM meta")
add("crud16_metadata_delete", lambda s, d: metadata(s, d).where("importance != 'high'").select("entry_key"), R + "SELECT entry_key FROM meta WHERE importance <> 'high'")
add("crud17_tag_index", lambda s, d: metadata(s, d).select("entry_key", F.explode("tags").alias("tag")).groupBy("tag").agg(n_()), R + "SELECT tag, count(*) AS n FROM (SELECT entry_key, unnest(tags) AS tag FROM meta) GROUP BY 1")
add("crud18_note_counts", lambda s, d: metadata(s, d).groupBy("notes_count").agg(n_()).select(F.col("notes_count").cast("bigint").alias("notes_count"), "n"), R + "SELECT notes_count, count(*) AS n FROM meta GROUP BY 1")
add("crud19_notes_of_entry", lambda s, d: notes(s, d).groupBy("entry_key").agg(n_(), F.min("event_ts").alias("first")), R + "SELECT entry_key, count(*) AS n, min(event_ts) AS first FROM note GROUP BY 1")
add("crud22_notes_by_type", lambda s, d: notes(s, d).where("note_type = 'web'").select("note_id", "version"), R + "SELECT note_id, version FROM note WHERE note_type = 'web'")
add("crud21_delete_note", lambda s, d: notes(s, d).where("note_type != 'web'").groupBy("note_type").agg(n_()), R + "SELECT note_type, count(*) AS n FROM note WHERE note_type <> 'web' GROUP BY 1")
add("crud24_sessions", lambda s, d: sessions(s, d).select("event_id", "entry_key", "minutes", "pages"), R + "SELECT event_id, entry_key, minutes, pages FROM sess")
add("crud40_case_blind", lambda s, d: records(s, d).select(F.explode("custom").alias("k", "v")).groupBy(F.lower("k").alias("k")).agg(n_()), R + "SELECT lower(k) AS k, count(*) AS n FROM (SELECT unnest(map_keys(custom)) AS k FROM r) GROUP BY 1")
add("srch46_notes_search", lambda s, d: notes(s, d).where(F.lower("content").contains("abstract") & (F.col("note_type") == "bo")).select("note_id", "version"), R + "SELECT note_id, version FROM note WHERE lower(content) LIKE '%abstract%' AND note_type = 'bo'")
add("srch48_collections_search", lambda s, d: collections(s, d).where(F.lower("coll_name").contains("thes") | F.lower("description").contains("drone")).select("id"), R + "SELECT id FROM coll WHERE coalesce(lower(coll_name) LIKE '%thes%', false) OR coalesce(lower(description) LIKE '%drone%', false)")
add("srch49_notes_with_entries", lambda s, d: notes(s, d).where(F.lower("content").contains("pages")).join(by_key(s, d).select(F.lower(F.trim("key")).alias("entry_key"), "title"), "entry_key").select("note_id", "version", "title", F.substring("content", 1, 100).alias("preview")), R + "SELECT n.note_id, n.version, k.title, substr(n.content, 1, 100) AS preview FROM note n JOIN k ON lower(trim(k.key)) = n.entry_key WHERE lower(n.content) LIKE '%pages%'")
add("wf07_progress", lambda s, d: _progress(s, d), R + "SELECT entry_key, min(event_ts) FILTER (event_type = 'ENTRY_CREATED') AS started, min(event_ts) FILTER (event_type = 'METADATA_UPDATED') AS finished FROM ev WHERE entry_key IS NOT NULL GROUP BY 1")
add("wf06_bulk_set", lambda s, d: metadata(s, d).select("entry_key", F.when(F.col("rating") >= 4, "read").otherwise(F.col("read_status")).alias("read_status")), R + "SELECT entry_key, CASE WHEN rating >= 4 THEN 'read' ELSE read_status END AS read_status FROM meta")
add("wf09_move", lambda s, d: collections(s, d).select("id", F.when(F.col("coll_name") == "Thesis", F.lit(None)).otherwise(F.col("parent_id")).alias("parent_id")), R + "SELECT id, CASE WHEN coll_name = 'Thesis' THEN NULL ELSE parent_id END AS parent_id FROM coll")
add("evt03_changes", lambda s, d: events(s, d).where("event_type like 'ENTRY_%' and entry_key is not null").groupBy("entry_key").agg(F.max_by("event_type", F.struct("event_ts", "event_id")).alias("last_event"), n_()), R + "SELECT entry_key, arg_max(event_type, (event_ts, event_id)) AS last_event, count(*) AS n FROM ev WHERE event_type LIKE 'ENTRY_%' AND entry_key IS NOT NULL GROUP BY 1")


def _progress(s, d):
    at = lambda t: F.min(F.when(F.col("event_type") == t, F.col("event_ts")))
    return events(s, d).where("entry_key is not null").groupBy("entry_key").agg(at("ENTRY_CREATED").alias("started"), at("METADATA_UPDATED").alias("finished"))
