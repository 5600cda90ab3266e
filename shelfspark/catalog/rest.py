"""The remaining surface: stores, formatters, labels, pairwise suggestions, rules, facades."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import citations as X
from ..functions import text as T
from ..operators import engine as E
from ..operators import quality as Q
from ..operators import relations as J
from ..operators import search as S
from ..operators.hierarchy import hierarchy
from ..operators.windows import global_rank
from ..plans import read_table
from ..plans.session import stage_dir
from ..sources import bibliography as B
from .problems import _ALL
from .quality import _TAY
from .records import SQL_RECORDS as R
from .records import by_key, collections, events, metadata, notes, records, sessions
from .registry import Catalog
from .search import _POST, RK, _has

C = Catalog()
QUERIES, SQL = C.QUERIES, C.SQL
add = C.add
n_ = lambda: F.count(F.lit(1)).alias("n")


def _store(s, df, write, read):
    path = f"{stage_dir(s)}/store-{uuid.uuid4().hex}"
    write(df, path)
    return read(path)


# stores and formats
add("src14_many_files", lambda s, d: _store(s, by_key(s, d), lambda df, p: (B.write_text(df.where("year < 2000"), X.bibtex(), p + "/a"), B.write_text(df.where("year >= 2000"), X.bibtex(), p + "/b")), lambda p: B.read_bibtex(s, [p + "/a", p + "/b"])).groupBy("type").agg(n_()), R + "SELECT type, count(*) AS n FROM k WHERE year IS NOT NULL GROUP BY 1")
add("src19_json_source", lambda s, d: _store(s, by_key(s, d).select("key", "type", "title"), lambda df, p: df.select(F.concat(F.lit('{"entries":['), F.to_json(F.struct("key", "type", "title")), F.lit("]}")).alias("value")).write.text(p), lambda p: s.read.text(p).select(F.explode(F.from_json(F.get_json_object("value", "$.entries"), "array<map<string,string>>")).alias("m"))).select(F.col("m")["key"].alias("key"), F.col("m")["type"].alias("type")), R + "SELECT key, type FROM k")
add("src27_csv_format", lambda s, d: records(s, d).select("row_id", F.to_csv(F.struct("key", "type", F.col("year").cast("string").alias("year")), {"sep": ";", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("line")), R + "SELECT row_id, concat_ws(';', key, type, coalesce(CAST(year AS VARCHAR), '')) AS line FROM r")
add("src30_json_format", lambda s, d: S.search(records(s, d), "kriging").select("row_id", F.get_json_object(F.to_json(F.struct("key", "title")), "$.key").alias("key")), RK + f"SELECT row_id, key FROM rk WHERE {_has('kriging')}")
add("src29b_yaml_lines", lambda s, d: records(s, d).select("row_id", F.split(X.yaml(), "\n")[0].alias("line")), R + "SELECT row_id, '- key: \"' || replace(replace(key, '\\', '\\\\'), '\"', '\\\"') || '\"' AS line FROM r")

# keys, documents, paths
add("prj07_auto_key", lambda s, d: records(s, d).where("author != '' and title != ''").select("row_id", F.concat(F.lower(F.regexp_replace(T.unaccent(T.last_name(F.trim(F.substring_index("author", " and ", 1)))), "[^A-Za-z]", "")), F.coalesce(F.col("year").cast("string"), F.lit("")), F.coalesce(F.try_element_at(F.filter(T.tokens(F.col("title")), lambda w: ~w.isin("a", "an", "the")), F.lit(1)), F.lit(""))).alias("new_key")))
add("join13_parent_names", lambda s, d: _parents(s, d), R + "SELECT c.id, p.coll_name AS parent_name FROM coll c JOIN coll p ON lower(trim(c.parent_id)) = p.id")
add("join17_parent_paths", lambda s, d: hierarchy(read_table(s, d, "collections")).select("id", F.array_join("path", " > ").alias("path")), _ALL + "SELECT id, path FROM every")
add("agg11_search_facets", lambda s, d: E.Service(records(s, d)).search("kriging").facets, RK + " , hit AS (SELECT * FROM rk WHERE " + _has("kriging") + ") " + " UNION ALL ".join(f"SELECT '{f}' AS field, CAST({f} AS VARCHAR) AS value, count(*) AS n FROM hit WHERE CAST({f} AS VARCHAR) <> '' GROUP BY 2" for f in ("type", "year", "journal")))
add("srt09_alpha_key", lambda s, d: records(s, d).where("author != ''").select("row_id", F.regexp_extract("key", r"^(.*?)(\d{2,4})", 1).alias("stem"), F.regexp_extract("key", r"^(.*?)(\d{2,4})", 2).alias("digits")), R + r"SELECT row_id, regexp_extract(key, '^(.*?)(\d{2,4})', 1) AS stem, regexp_extract(key, '^(.*?)(\d{2,4})', 2) AS digits FROM r WHERE author <> ''")
add("srt11_index_top", lambda s, d: S.simple_index(S.postings(S.searchable(records(s, d))), "otter comet").orderBy(F.desc("score"), "row_id").limit(20).select("row_id"), _POST + "SELECT row_id FROM post WHERE term IN ('otter', 'comet') GROUP BY 1 ORDER BY sum(tf) / 2 DESC, row_id LIMIT 20")
add("set07_collection_tags", lambda s, d: collections(s, d).select("id", F.array_join(F.array_sort(F.array_except(F.array_union(F.array(F.coalesce("color", F.lit("none"))), F.array(F.lit("new"))), F.array(F.lit("teal")))), "|").alias("tags")), R + "SELECT id, array_to_string(list_sort(list_filter(list_distinct([coalesce(color, 'none'), 'new']), lambda t: t <> 'teal')), '|') AS tags FROM coll")


def _parents(s, d):
    c = collections(s, d)
    p = c.select(F.col("id").alias("p"), F.col("coll_name").alias("parent_name"))
    return c.select("id", F.lower(F.trim("parent_id")).alias("p")).join(p, "p").select("id", "parent_name")


# search facades
add("srch26_field_union", lambda s, d: S.search(records(s, d), "title:comet OR abstract:comet", True).select("row_id"), RK + "SELECT row_id FROM rk WHERE list_contains(regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]+'), 'comet') OR coalesce(list_contains(regexp_extract_all(lower(abstract), '[\\p{L}\\p{N}_]+'), 'comet'), false)")
add("srch28_bm25_rank", lambda s, d: _bm25(s, d), _POST + ", dl AS (SELECT row_id, sum(len) AS len FROM (SELECT DISTINCT row_id, field, len FROM post) GROUP BY 1), q AS (SELECT term, row_id, sum(tf) AS tf FROM post WHERE term IN ('comet', 'otter') GROUP BY ALL), dfq AS (SELECT term, count(*) AS df FROM q GROUP BY 1) SELECT q.row_id, round(sum(ln(((SELECT count(*) FROM dl) - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl.len / (SELECT avg(len) FROM dl)))), 6) AS score FROM q JOIN dfq USING (term) JOIN dl USING (row_id) GROUP BY 1")
add("srch31_store_index", lambda s, d: S.simple_index(S.postings(S.searchable(records(s, d))), "kriging", "abstract").select("row_id"), _POST + "SELECT row_id FROM post WHERE term = 'kriging' AND field = 'abstract'")
add("srch41_field_rewrite", lambda s, d: S.searchable(records(s, d)).where(S.evaluate(E.L.with_fields(E.L.parse("title:\"of the\""), E.FIELD_EXPANSION))[0]).select("row_id"), RK + "SELECT row_id FROM rk WHERE contains(lower(title), 'of the') OR coalesce(contains(lower(abstract), 'of the'), false)")
add("srch43_relaxed_prefix", lambda s, d: S.searchable(records(s, d)).where(S.evaluate(E.L.relaxed(E.L.parse("krig"), 3))[0]).select("row_id"), RK + f"SELECT row_id FROM rk WHERE {_has('krig')} OR " + " OR ".join(f"coalesce(regexp_matches({f}, '(?i)krig.*'), false)" for f in S.FIELDS))
add("srch47_quotes", lambda s, d: notes(s, d).where(F.lower("content").contains("title") & F.col("note_type").isin("ana", "chen")).select("note_id", "version"), R + "SELECT note_id, version FROM note WHERE contains(lower(content), 'title') AND note_type IN ('ana', 'chen')")
add("rank08_weights", lambda s, d: records(s, d).select("row_id", sum((F.when(T.term_count(F.col(f), "otter") > 0, F.lit(S.WEIGHTS[f])).otherwise(0.0) for f in ("title", "abstract", "author", "journal")), F.lit(0.0)).alias("weight")).where("weight > 0").select("row_id", F.round("weight", 4).alias("weight")), R + "SELECT row_id, round(w, 4) AS weight FROM (SELECT row_id, " + " + ".join(f"CASE WHEN contains(lower({f}), 'otter') THEN {S.WEIGHTS[f]} ELSE 0.0 END" for f in ("title", "abstract", "author", "journal")) + " AS w FROM r) WHERE w > 0")
add("crud29_suggest", lambda s, d: S.suggest(records(s, d), "tow", "title", 8), R + "SELECT DISTINCT title FROM r WHERE lower(title) LIKE 'tow%' ORDER BY title LIMIT 8")


def _bm25(s, d):
    """BM25 over postings with true frequencies: the query's postings meet one length a document."""
    p = S.postings(S.searchable(records(s, d)))
    length = p.groupBy("row_id", "field").agg(F.first("len").alias("len")).groupBy("row_id").agg(F.sum("len").alias("len"))
    stats = {"n": length.agg(F.count(F.lit(1))).scalar(), "mean": length.agg(F.avg("len")).scalar()}
    q = p.where(F.col("term").isin("comet", "otter")).groupBy("term", "row_id").agg(F.sum("tf").alias("tf"))
    df = q.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    one = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1) * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("mean")))
    return q.join(df, "term").join(length, "row_id").withColumns(stats).groupBy("row_id").agg(F.round(F.sum(one), 6).alias("score"))


# text
add("str15_normal_title", lambda s, d: records(s, d).select("row_id", T.normal_text(F.col("title")).alias("title")), _TAY + "SELECT row_id, split_part(tay_key, '|', 1) AS title FROM dk")
add("str16_normal_authors", lambda s, d: records(s, d).select("row_id", T.normal_people(F.col("author")).alias("people")), _TAY + "SELECT r.row_id, coalesce(au.people, '') AS people FROM r LEFT JOIN au USING (row_id)")
add("str17_key_counts", lambda s, d: Q.duplicate_keys(records(s, d)).groupBy("tay_key").agg(n_()).where("n > 1"), _TAY + "SELECT tay_key, count(*) AS n FROM dk GROUP BY 1 HAVING count(*) > 1")
add("str26_month_names", lambda s, d: records(s, d).select("row_id", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _MONTHS.items() for x in kv]), F.lower("month")), F.col("month")).alias("month")), R + "SELECT row_id, CASE lower(month) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {"jan": "January", "feb": "February", "mar": "March", "apr": "April", "jun": "June", "jul": "July", "aug": "August", "sep": "September", "oct": "October", "nov": "November", "dec": "December"}.items()) + " ELSE month END AS month FROM r")
_MONTHS = {"jan": "January", "feb": "February", "mar": "March", "apr": "April", "jun": "June", "jul": "July", "aug": "August", "sep": "September", "oct": "October", "nov": "November", "dec": "December"}



def _u():
    from ..functions import udfs

    return udfs


for _name, _words, _phrases, _most in (("hl03_terms", ["otter"], (), None), ("hl04_phrases", [], ("drawn from",), None), ("hl06_merged", ["otter", "otters"], ("otter",), None), ("hl07_snippet", ["otter"], (), 80), ("hl09_best", ["otter", "comet"], (), 120)):
    add(_name, lambda s, d, w=_words, p=_phrases, m=_most: records(s, d).where("abstract is not null").select("row_id", _u().marked(w, p, m)(F.col("abstract")).alias("value")))
add("hl08_tags", lambda s, d: records(s, d).select("row_id", S.highlight(F.col("title"), ["the"], "em").alias("title")), R + "SELECT row_id, regexp_replace(title, '(?i)the', '<em>the</em>', 'g') AS title FROM r")

# duplicates and policies
add("ddp03_tolerance", lambda s, d: _tolerant(s, d), _TAY + "SELECT min(row_id) AS first, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY year, row_id) AS island FROM (SELECT r.row_id, r.year, regexp_replace(tay_key, '[|][^|]*$', '') AS g, r.year - lag(r.year) OVER (PARTITION BY regexp_replace(tay_key, '[|][^|]*$', '') ORDER BY r.year, r.row_id) > 1 AS gap FROM dk JOIN r USING (row_id) WHERE r.year IS NOT NULL)) GROUP BY g, island HAVING count(*) > 1")
add("ddp08_field_agreement", lambda s, d: _agree(s, d), R + "SELECT key, CASE WHEN f = 0 THEN 0.5 ELSE round(e / f, 6) END AS confidence FROM (SELECT a.key, " + " + ".join(f"CAST(coalesce(a.{c} = b.{c}, false) AS INT)" for c in ("title", "author", "journal", "pages", "doi")) + " AS e, " + " + ".join(f"CAST(a.{c} IS NOT NULL AND b.{c} IS NOT NULL AS INT)" for c in ("title", "author", "journal", "pages", "doi")) + " AS f FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY row_id) = 1) a JOIN (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY row_id) = 2) b ON a.key = b.key)")


def _tolerant(s, d):
    r = records(s, d).where("year is not null")
    g = r.select("row_id", "year", F.concat_ws("|", T.normal_text(F.col("title")), T.normal_people(F.col("author"))).alias("g"))
    return J.year_islands(g, ["g"], "year", 1).groupBy("g", "island").agg(F.min("row_id").alias("first"), n_()).where("n > 1").select("first", "n")



def _agree(s, d):
    """Share of equal fields of the first two records of a key: both found by aggregates, joined by row id."""
    r = records(s, d)
    one = r.groupBy("key").agg(F.min("row_id").alias("r1"))
    two = r.join(one, "key").where("row_id > r1").groupBy("key", "r1").agg(F.min("row_id").alias("r2"))
    cols = ("title", "author", "journal", "pages", "doi")
    a = r.select(F.col("row_id").alias("r1"), *[F.col(c).alias("a_" + c) for c in cols])
    b = r.select(F.col("row_id").alias("r2"), *[F.col(c).alias("b_" + c) for c in cols])
    e = sum((F.coalesce(F.col("a_" + c) == F.col("b_" + c), F.lit(False)).cast("int") for c in cols), F.lit(0))
    f = sum(((F.col("a_" + c).isNotNull() & F.col("b_" + c).isNotNull()).cast("int") for c in cols), F.lit(0))
    return two.join(a, "r1").join(b, "r2").select("key", e.alias("e"), f.alias("f")).select("key", F.when(F.col("f") == 0, 0.5).otherwise(F.round(F.col("e") / F.col("f"), 6)).alias("confidence"))




# side tables
add("crud09_list", lambda s, d: collections(s, d).where("coll_name is not null").orderBy("coll_name", "id").select("coll_name", "id"), R + "SELECT coll_name, id FROM coll WHERE coll_name IS NOT NULL")
add("crud11_entries", lambda s, d: collections(s, d).select("id", F.posexplode("entry_keys").alias("pos", "k")).select("id", F.col("pos").cast("bigint").alias("pos"), "k"), R + "SELECT id, unnest(range(len(entry_keys))) AS pos, unnest(entry_keys) AS k FROM coll")
add("crud20_first_versions", lambda s, d: notes(s, d).where("version = 1").select("note_id", "event_ts"), R + "SELECT note_id, event_ts FROM note WHERE version = 1")
add("crud23_quotes", lambda s, d: notes(s, d).where("note_type = 'importer'").select("note_id", "version", "event_ts").orderBy("event_ts"), R + "SELECT note_id, version, event_ts FROM note WHERE note_type = 'importer'")
add("crud25_migrate_all", lambda s, d: metadata(s, d).select(F.lit("metadata").alias("what")).unionByName(sessions(s, d).select(F.lit("sessions").alias("what"))).unionByName(events(s, d).select(F.lit("events").alias("what"))).groupBy("what").agg(n_()), R + "SELECT 'metadata' AS what, count(*) AS n FROM meta UNION ALL SELECT 'sessions', count(*) FROM sess UNION ALL SELECT 'events', count(*) FROM ev")
add("crud26_verified_copy", lambda s, d: _store(s, by_key(s, d), lambda df, p: df.write.parquet(p), lambda p: B.verify_copy(by_key(s, d), s.read.parquet(p).where("year is null or year > 1900"))), R + "SELECT count(*) FILTER (year <= 1900) AS missing, 0 AS extra, 0 AS changed FROM k")
add("crud27_rebuild", lambda s, d: S.postings(S.searchable(by_key(s, d))).agg(F.countDistinct("row_id").alias("docs")), R + r"SELECT count(*) AS docs FROM k WHERE regexp_matches(concat_ws(' ', title, author, abstract, journal, array_to_string(keywords, ' ')), '[\p{L}\p{N}_]')")
add("crud42_single_entry", lambda s, d: _store(s, by_key(s, d).where("type = 'misc'"), lambda df, p: B.write_text(df, X.bibtex(), p), lambda p: B.read_bibtex(s, p)).select("key", "type"), R + "SELECT trim(key) AS key, type FROM k WHERE type = 'misc'")
add("wf10_collection_tree", lambda s, d: _listed(s, d), _ALL + "SELECT row_number() OVER (ORDER BY path_ids) AS place, every.id, l.name, p.id AS parent, depth FROM every JOIN link l ON l.id = every.id LEFT JOIN link p ON p.cid = l.parent")


def _listed(s, d):
    """All collections in depth-first order, siblings by id: a path of ids sorts right after those it begins with.

    A loop has no top, so each of its members is listed with what hangs below it.
    """
    t = hierarchy(read_table(s, d, "collections"))
    parent = F.when(F.size("path_ids") > 1, F.try_element_at("path_ids", F.lit(-2))).when(F.col("in_loop"), F.col("id"))
    return global_rank(t.select("id", F.element_at("path", -1).alias("name"), parent.alias("parent"), "depth", "path_ids"), ["path_ids"]).drop("path_ids")
