"""Scans, structured predicates, projections and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.predicates import Leaf, Node, Query, Spec, compile_tree, leaf, parse_export
from .records import SQL_RECORDS as R
from .records import by_key, collections, metadata, records, with_numbers
from .registry import Catalog

C = Catalog()
QUERIES, SQL = C.QUERIES, C.SQL
ids = lambda df: df.select("row_id")
REF = "TIMESTAMP '2024-01-01 00:00:00'"
LAST = "regexp_extract(journal, '([A-Za-z]+)$', 1)"
KEY3 = "(SELECT min(key) FROM r UNION ALL SELECT max(key) FROM r)"


def _where(name, query, condition, dialect="entry"):
    C.add(name, lambda s, d: ids(records(s, d).where(query.column(dialect))), R + f"SELECT row_id FROM r WHERE {condition}")


# scans
C.add("src01_scan", lambda s, d: records(s, d).select("row_id", "key", "type", "title", "year"), R + "SELECT row_id, key, type, title, year FROM r")
C.add("src02_lookup", lambda s, d: by_key(s, d).where("key like 'Gosbavan%'").select("key", "title"), R + "SELECT key, title FROM k WHERE key LIKE 'Gosbavan%'")
C.add("src03_exists", lambda s, d: records(s, d).agg((F.count_if(F.col("key") == "hollowmere2015index:zzzzz") > 0).alias("found")), R + "SELECT count(*) FILTER (key = 'hollowmere2015index:zzzzz') > 0 AS found FROM r")
C.add("src04_count", lambda s, d: records(s, d).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("n_keys")), R + "SELECT count(*) AS n, count(DISTINCT key) AS n_keys FROM r")
C.add("src05_upsert", lambda s, d: _upsert(s, d), R + "SELECT key, title FROM k WHERE type <> 'misc' UNION ALL SELECT key, upper(title) AS title FROM k WHERE type = 'misc'")
C.add("src06_delete", lambda s, d: by_key(s, d).where("type != 'misc'").select("key"), R + "SELECT key FROM k WHERE type <> 'misc'")
C.add("src07_keyed_export", lambda s, d: _keyed(s, d), R + "SELECT c.id, CAST(c.pos AS BIGINT) AS pos, k.key FROM (SELECT id, unnest(entry_keys) AS m, unnest(range(len(entry_keys))) AS pos FROM coll) c JOIN k ON k.key = c.m")
C.add("src16_point_fields", lambda s, d: records(s, d).where("year = 2001").select("row_id", "doi", "url"), R + "SELECT row_id, doi, url FROM r WHERE year = 2001")


def _upsert(s, d):
    old = by_key(s, d).select("key", "type", "title")
    new = old.where("type = 'misc'").select("key", "type", F.upper("title").alias("title"))
    return old.join(new.select("key"), "key", "left_anti").unionByName(new).select("key", "title")


def _keyed(s, d):
    want = collections(s, d).select("id", F.posexplode("entry_keys").alias("pos", "key"))
    return want.join(by_key(s, d).select("key"), "key").select("id", F.col("pos").cast("bigint").alias("pos"), "key")


# dialect A
_where("qry01_null_rule", Query().where("doi", "=", None).or_where("abstract", "!=", "x"), "doi IS NULL OR abstract <> 'x'")
_where("qry02_equality", Query().where("type", "=", "article").where("journal", "!=", "Letters on Applied Pedagogy"), "type = 'article' AND journal <> 'Letters on Applied Pedagogy'")
_where("qry03_ranges", Query().where("year", ">", 1990).where("year", "<=", 2005).or_where("title", ">", 5), "(year > 1990 AND year <= 2005) OR false")
_where("qry04_substrings", Query().where("title", "contains", "ALLOY").or_where("author", "starts_with", "sam").or_where("pages", "ends_with", "99"), "lower(title) LIKE '%alloy%' OR lower(author) LIKE 'sam%' OR lower(pages) LIKE '%99'")
_where("qry05_membership", Query().where("type", "in", ["book", "misc"]).where("pages", "not_in", ["1--2"]), "type IN ('book', 'misc') AND pages NOT IN ('1--2')")
_where("qry06_pattern", Query().where("title", "matches", "^[A-Z][a-z]+ (of|and) "), "regexp_matches(title, '^[A-Z][a-z]+ (of|and) ')")
_where("qry07_trees", Query().where_not("journal", "contains", "applied").where("year", ">=", 2000), "NOT coalesce(lower(journal) LIKE '%applied%', false) AND year >= 2000")
_where("qry07b_empty", Query(), "true")
_where("qry08_builder", Query().where("volume", "=", "12").where("number", "!=", None), "volume = '12' AND number IS NOT NULL")
_where("qry09_sugar", Query().where_type("article").where_year_range(1995, 1999).where_author_contains("katherine").where_title_contains("of"), "type = 'article' AND year BETWEEN 1995 AND 1999 AND lower(author) LIKE '%katherine%' AND lower(title) LIKE '%of%'")
_where("qry10_has_doi", Query().where_has_doi(), "doi IS NOT NULL")
_where("qry11_or_where", Query().where("type", "=", "book").where("year", ">", 2010).or_where("type", "=", "misc").where("year", "<", 1970), "(type = 'book' AND year > 2010) OR type = 'misc' OR year < 1970")
_where("qry12_where_not", Query().where_not("publisher", "=", "Verlag Steinhuhn"), "NOT coalesce(publisher = 'Verlag Steinhuhn', false)")
_where("qry13_filter", Query().where("school", "!=", None), "school IS NOT NULL")
C.add("qry14_recent", lambda s, d: ids(records(s, d).where(F.col("added") >= F.expr(f"{REF.replace('TIMESTAMP', 'TIMESTAMP_NTZ')} - INTERVAL 365 DAYS"))), R + f"SELECT row_id FROM r WHERE added >= {REF} - INTERVAL 365 DAYS")
C.add("qry15_unread", lambda s, d: _unread(s, d), R + "SELECT k.key FROM k LEFT JOIN meta m ON lower(trim(k.key)) = m.entry_key WHERE coalesce(m.read_status, 'unread') = 'unread'")


def _unread(s, d):
    m = metadata(s, d).select("entry_key", "read_status")
    k = by_key(s, d).select("key", F.lower(F.trim("key")).alias("entry_key"))
    return k.join(m, "entry_key", "left").where("coalesce(read_status, 'unread') = 'unread'").select("key")


# dialect B
def _spec(name, spec, condition, tail="", cols="row_id"):
    C.add(name, lambda s, d: spec.run(records(s, d)).select(*cols.split(", ")), R + f"SELECT {cols} FROM r WHERE {condition}{tail}")


_spec("qry16_spec_nulls", Spec().where("journal", "!=", "Journal of Applied Pedagogy").where("year", ">", 1900).where("title", "contains", "of"), "journal IS DISTINCT FROM 'Journal of Applied Pedagogy' AND year > 1900 AND contains(title, 'of')")
_spec("qry16b_spec_unknown", Spec().where("journal", "~", "x").where("abstract", "=", None), "abstract IS NULL")
_spec("qry17_spec_in", Spec().where_in("type", ["article", "book"]).where("volume", ">=", "5"), "type IN ('article', 'book') AND volume >= '5' AND volume <> ''")
_spec("qry18_find_by", Spec().where("year", ">=", 2005).where("year", "<=", 2020).where("journal", "contains", "Applied").order_by("year", True).order_by("title").offset(5).limit(50), "year BETWEEN 2005 AND 2020 AND contains(journal, 'Applied')", " ORDER BY year DESC NULLS LAST, title NULLS LAST, row_id LIMIT 50 OFFSET 5", "row_id, year, title")
_where("qry19_repo_dialect", Query().where("doi", "!=", "x").where_not("journal", "=", "x").where("title", "contains", "and"), "doi <> 'x' AND NOT coalesce(journal = 'x', false) AND lower(title) LIKE '%and%'", "repo")
_NOT2 = Node("not", (Leaf("type", "=", "book"), Leaf("year", ">", 2000)))
C.add("qry20_repo_not", lambda s, d: ids(records(s, d).where(compile_tree(_NOT2, "repo"))), R + "SELECT row_id FROM r WHERE NOT coalesce(type = 'book', false)")
C.add("qry20b_entry_not", lambda s, d: ids(records(s, d).where(compile_tree(_NOT2, "entry"))), R + "SELECT row_id FROM r WHERE NOT coalesce(type = 'book' AND year > 2000, false)")
C.add("qry21_by_type_year", lambda s, d: ids(records(s, d).where((F.col("type") == "techreport") & (F.col("year") == 1999))), R + "SELECT row_id FROM r WHERE type = 'techreport' AND year = 1999")
C.add("qry22_by_author", lambda s, d: ids(records(s, d).where(leaf(Leaf("author", "contains", "Balfukir")))), R + "SELECT row_id FROM r WHERE lower(author) LIKE '%balfukir%'")
C.add("qry23_export_language", lambda s, d: ids(records(s, d).where(parse_export("year:1990..1995") & parse_export("journal:bulletin"))), R + "SELECT row_id FROM r WHERE year BETWEEN 1990 AND 1995 AND lower(journal) LIKE '%bulletin%'")
C.add("qry23b_export_bare", lambda s, d: ids(records(s, d).where(parse_export("kriging"))), R + "SELECT row_id FROM r WHERE lower(title) LIKE '%kriging%' OR lower(author) LIKE '%kriging%'")
C.add("qry23c_export_number", lambda s, d: ids(records(s, d).where(parse_export("volume:10..12"))), R + "SELECT row_id FROM r WHERE TRY_CAST(volume AS INT) BETWEEN 10 AND 12")
C.add("qry24_export_filters", lambda s, d: ids(records(s, d).where((F.col("type") == "article") & F.col("year").between(2000, 2010) & F.arrays_overlap("tags", F.array(F.lit("thesis"), F.lit("survey"))))), R + "SELECT row_id FROM r WHERE type = 'article' AND year BETWEEN 2000 AND 2010 AND list_has_any(tags, ['thesis', 'survey'])")
_spec("qry25_list", Spec().where("type", "=", "phdthesis").order_by("year", True).limit(40).offset(10), "type = 'phdthesis'", " ORDER BY year DESC NULLS LAST, row_id LIMIT 40 OFFSET 10")
C.add("qry26_pushdown", lambda s, d: records(s, d).where((F.col("type") == "book") & (F.col("year") == 2016) & F.col("author").ilike("%an%")).select("row_id", "key"), R + "SELECT row_id, key FROM r WHERE type = 'book' AND year = 2016 AND author ILIKE '%an%'")
C.add("qry27_find_options", lambda s, d: _find(s, d), R + "SELECT k.key FROM k JOIN meta m ON lower(trim(k.key)) = m.entry_key WHERE type = 'article' AND doi IS NOT NULL AND rating >= 1 AND read_status <> 'unread'")


def _find(s, d):
    k = by_key(s, d).where("type = 'article' and doi is not null").select("key", F.lower(F.trim("key")).alias("entry_key"))
    return k.join(metadata(s, d).where("rating >= 1 and read_status != 'unread'").select("entry_key"), "entry_key").select("key")


C.add("qry28_hit_filter", lambda s, d: ids(records(s, d).where(F.col("type").isin("article", "inbook") & (F.col("journal") == "Letters on Applied Robotics"))), R + "SELECT row_id FROM r WHERE type IN ('article', 'inbook') AND journal = 'Letters on Applied Robotics'")
C.add("qry29_field_terms", lambda s, d: ids(records(s, d).where(F.col("publisher").isin("Verlag Steinhuhn", "Quillmoor Academic"))), R + "SELECT row_id FROM r WHERE publisher IN ('Verlag Steinhuhn', 'Quillmoor Academic')")
C.add("qry30_facet_selection", lambda s, d: ids(records(s, d).where(F.arrays_overlap("keywords", F.array(F.lit("peer review"), F.lit("R&D"))) & F.col("type").isin("article", "book"))), R + "SELECT row_id FROM r WHERE list_has_any(keywords, ['peer review', 'R&D']) AND type IN ('article', 'book')")
C.add("qry32_smart_filter", lambda s, d: ids(records(s, d).where(smart_filter("title", "contains", "archives") & smart_filter("year", ">=", 1980))), R + "SELECT row_id FROM r WHERE lower(title) LIKE '%archives%' AND year >= 1980")


def smart_filter(name, op, value):
    """Conditions of a smart collection: known operators only, and no substrings of numbers."""
    if op not in ("=", "!=", ">", ">=", "<", "<=", "contains", "in"):
        raise ValueError(f"operator {op} is not allowed in a smart collection")
    if op == "contains" and isinstance(value, (int, float)):
        raise ValueError("a number holds no substring")
    return leaf(Leaf(name, op, value))


# projections
C.add("prj01_authors", lambda s, d: records(s, d).select("row_id", F.size(T.people(F.col("author"))).cast("bigint").alias("n"), F.array_join(T.people(F.col("author")), "; ").alias("names")),
      R + r"SELECT row_id, len(p) AS n, array_to_string(p, '; ') AS names FROM (SELECT row_id, list_filter(list_transform(regexp_split_to_array(coalesce(author, ''), '\s+and\s+'), lambda x: trim(x)), lambda x: x <> '') AS p FROM r)")
C.add("prj02_editors", lambda s, d: records(s, d).where("editor != ''").select("row_id", F.explode(T.people(F.col("editor"))).alias("name")), R + r"SELECT row_id, name FROM (SELECT row_id, trim(unnest(regexp_split_to_array(editor, '\s+and\s+'))) AS name FROM r WHERE editor <> '') WHERE name <> ''")
_TEXT = ["title", "author", "editor", "journal", "booktitle", "publisher", "school", "institution", "abstract"]
C.add("prj03_search_text", lambda s, d: records(s, d).select("row_id", F.md5(F.lower(F.concat_ws(" ", *[T.filled(F.col(c)) for c in _TEXT], F.col("year").cast("string"), F.array_join("keywords", " "), F.array_join("tags", " "), "type"))).alias("digest")),
      R + "SELECT row_id, md5(lower(concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in _TEXT) + ", CAST(year AS VARCHAR), array_to_string(keywords, ' '), array_to_string(tags, ' '), type))) AS digest FROM r")
C.add("prj04_to_map", lambda s, d: records(s, d).select("row_id", F.size(F.filter(F.array(*[F.col(c) for c in _TEXT]), lambda x: x.isNotNull())).cast("bigint").alias("n_fields")), R + "SELECT row_id, " + " + ".join(f"CAST({c} IS NOT NULL AS BIGINT)" for c in _TEXT) + " AS n_fields FROM r")
_VENUE = ("coalesce(CASE lower(trim({c})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.VENUES.items()) + r" END, CASE WHEN len(regexp_split_to_array(lower(trim({c})), '\s+')) > 1 THEN substr(array_to_string(list_transform(list_filter(regexp_split_to_array(lower(trim({c})), '\s+'), lambda w: length(w) > 2), lambda w: w[1:1]), ''), 1, 6) ELSE substr(lower(trim({c})), 1, 6) END)")
C.add("prj06_venue", lambda s, d: records(s, d).where("journal != ''").select("row_id", T.venue_abbreviation(F.col("journal")).alias("venue")), R + f"SELECT row_id, {_VENUE.format(c='journal')} AS venue FROM r WHERE journal <> ''")
_LAST = r"regexp_replace(CASE WHEN contains(a, ',') THEN trim(split_part(a, ',', 1)) ELSE regexp_extract(trim(a), '(\S+)$', 1) END, '[^\p{L}\p{N}_]', '', 'g')"
_SAN = r"regexp_replace(regexp_replace(substr(regexp_replace({x}, '[^\p{{L}}\p{{N}}_\-:]', '_', 'g'), 1, 50), '_+', '_', 'g'), '^_+|_+$', '', 'g')"


def first_last(c):
    return F.regexp_replace(T.last_name(F.trim(F.substring_index(c, " and ", 1))), r"[^\p{L}\p{N}_]", "")


C.add("prj08_author_year", lambda s, d: records(s, d).where("author != '' and year is not null").select("row_id", T.sanitize_key(F.concat_ws("_", F.lower(first_last(F.col("author"))), F.col("year").cast("string"))).alias("new_key")),
      R + f"SELECT row_id, {_SAN.format(x='concat_ws(chr(95), lower(' + _LAST + '), CAST(year AS VARCHAR))')} AS new_key FROM (SELECT row_id, year, trim(split_part(author, ' and ', 1)) AS a FROM r WHERE author <> '' AND year IS NOT NULL)")
_STOP = ("the", "a", "an", "of", "in", "on", "at", "to", "for")


def title_words(c, stop=()):
    return F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(*stop) if stop else F.length(w) > 3)


C.add("prj09_author_title_year", lambda s, d: records(s, d).where("author != '' and year is not null").select("row_id", T.sanitize_key(F.concat_ws("_", F.lower(first_last(F.col("author"))), F.nullif(F.regexp_replace(F.try_element_at(title_words(F.col("title"), _STOP), F.lit(1)), r"[^\p{L}\p{N}_]", ""), F.lit("")), F.col("year").cast("string"))).alias("new_key")),
      R + "SELECT row_id, " + _SAN.format(x="concat_ws(chr(95), lower(" + _LAST + r"), nullif(regexp_replace(list_filter(regexp_split_to_array(lower(trim(title)), '\s+'), lambda w: length(w) > 3 AND w NOT IN ('the','a','an','of','in','on','at','to','for'))[1], '[^\p{L}\p{N}_]', '', 'g'), ''), CAST(year AS VARCHAR))") + " AS new_key FROM (SELECT row_id, title, year, trim(split_part(author, ' and ', 1)) AS a FROM r WHERE author <> '' AND year IS NOT NULL)")
C.add("prj10_title_year", lambda s, d: records(s, d).where("title != '' and year is not null").select("row_id", T.sanitize_key(F.concat_ws("_", F.array_join(F.transform(F.slice(title_words(F.col("title")), 1, 3), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", "")), "_"), F.col("year").cast("string"))).alias("new_key")),
      R + "SELECT row_id, " + _SAN.format(x=r"concat_ws(chr(95), array_to_string(list_transform(list_filter(regexp_split_to_array(lower(trim(title)), '\s+'), lambda w: length(w) > 3)[1:3], lambda w: regexp_replace(w, '[^\p{L}\p{N}_]', '', 'g')), '_'), CAST(year AS VARCHAR))") + " AS new_key FROM r WHERE title <> '' AND year IS NOT NULL")
C.add("prj11_numeric_key", lambda s, d: records(s, d).select("row_id", F.concat_ws("_", "type", F.date_format("added", "yyyyMMddHHmmss")).alias("new_key")), R + "SELECT row_id, type || '_' || strftime(added, '%Y%m%d%H%M%S') AS new_key FROM r")
C.add("prj12_sanitize", lambda s, d: records(s, d).select("row_id", T.sanitize_key(F.col("title")).alias("safe")), R + "SELECT row_id, " + _SAN.format(x="title") + " AS safe FROM r")



C.add("prj15_derived", lambda s, d: records(s, d).select("row_id", F.expr("try_cast(split_part(volume, '-', 1) as int)").alias("volume_int"), F.expr("try_cast(split_part(number, '-', 1) as int)").alias("number_int"), F.size("keywords").alias("n_keywords")), R + "SELECT row_id, TRY_CAST(split_part(volume, '-', 1) AS INT) AS volume_int, TRY_CAST(split_part(number, '-', 1) AS INT) AS number_int, len(keywords) AS n_keywords FROM r")
C.add("prj16_doc_metadata", lambda s, d: records(s, d).select("row_id", sum((F.coalesce(F.length(c), F.lit(0)) for c in ("title", "author", "abstract", "journal")), F.lit(0)).cast("bigint").alias("text_length")), R + "SELECT row_id, coalesce(length(title), 0) + coalesce(length(author), 0) + coalesce(length(abstract), 0) + coalesce(length(journal), 0) AS text_length FROM r")
C.add("prj17_validate_doc", lambda s, d: records(s, d).select("row_id", F.size(F.array_compact(F.array(F.when(T.filled(F.col("key")).isNull(), "key"), F.when(T.filled(F.col("type")).isNull(), "type"), F.when(F.col("year").isNull(), "year"), F.when(T.filled(F.col("title")).isNull(), "title")))).cast("bigint").alias("n_faults")), R + "SELECT row_id, CAST(nullif(key, '') IS NULL AS BIGINT) + CAST(nullif(type, '') IS NULL AS BIGINT) + CAST(year IS NULL AS BIGINT) + CAST(nullif(title, '') IS NULL AS BIGINT) AS n_faults FROM r")
C.add("prj18_pipeline_counts", lambda s, d: records(s, d).groupBy((F.col("year").isNotNull() & (F.col("title") != "")).alias("ok")).agg(F.count(F.lit(1)).alias("n")), R + "SELECT year IS NOT NULL AND title <> '' AS ok, count(*) AS n FROM r GROUP BY 1")
C.add("prj19_template", lambda s, d: records(s, d).select("row_id", F.concat(F.coalesce(T.filled(F.col("title")), F.lit("[Missing: title]")), F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("[Missing: year]")), F.lit(") "), F.coalesce(F.try_element_at(T.people(F.col("author")), F.lit(1)), F.lit("")), F.lit(" "), F.size(T.people(F.col("author"))).cast("string")).alias("line")),
      R + r"SELECT row_id, coalesce(nullif(title, ''), '[Missing: title]') || ' (' || coalesce(CAST(year AS VARCHAR), '[Missing: year]') || ') ' || coalesce(p[1], '') || ' ' || len(p) AS line FROM (SELECT row_id, title, year, list_filter(list_transform(regexp_split_to_array(coalesce(author, ''), '\s+and\s+'), lambda x: trim(x)), lambda x: x <> '') AS p FROM r)")


def cleaned(df):
    squeezed = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
    title = squeezed(F.col("title"))
    return df.select("row_id", F.concat(F.upper(F.substring(title, 1, 1)), F.substr(title, F.lit(2))).alias("title"), squeezed(F.col("author")).alias("author"), F.regexp_replace("pages", r"(\d+)-(\d+)", "$1--$2").alias("pages"))


_CLEAN = r"SELECT row_id, upper(substr(t, 1, 1)) || substr(t, 2) AS title, regexp_replace(trim(author), '\s+', ' ', 'g') AS author, regexp_replace(pages, '(\d+)-(\d+)', '\1--\2', 'g') AS pages FROM (SELECT *, regexp_replace(trim(title), '\s+', ' ', 'g') AS t FROM r)"
C.add("prj20_clean", lambda s, d: cleaned(records(s, d)), R + _CLEAN)
C.add("prj20b_clean_counts", lambda s, d: _clean_counts(s, d), R + f"SELECT count(*) FILTER (c.title <> r.title) AS titles, count(*) FILTER (c.author <> r.author) AS authors, count(*) FILTER (c.pages <> r.pages) AS pages FROM r JOIN ({_CLEAN}) c USING (row_id)")


def _clean_counts(s, d):
    r = records(s, d)
    c = cleaned(r).select("row_id", *[F.col(x).alias("new_" + x) for x in ("title", "author", "pages")])
    return r.join(c, "row_id").agg(*[F.count_if(F.col(x) != F.col("new_" + x)).alias(x if x == "pages" else x + "s") for x in ("title", "author", "pages")])


C.add("prj21_rename_fields", lambda s, d: records(s, d).select("row_id", F.coalesce("booktitle", "journal").alias("container")), R + "SELECT row_id, coalesce(booktitle, journal) AS container FROM r")
_MAP = {"phdthesis": "thesis", "mastersthesis": "thesis", "techreport": "report"}
C.add("prj22_retype", lambda s, d: records(s, d).select("row_id", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _MAP.items() for x in kv]), F.col("type")), F.col("type")).alias("type")), R + "SELECT row_id, CASE type WHEN 'phdthesis' THEN 'thesis' WHEN 'mastersthesis' THEN 'thesis' WHEN 'techreport' THEN 'report' ELSE type END AS type FROM r")
C.add("prj23_fill_required", lambda s, d: records(s, d).where("type = 'article'").select("row_id", F.coalesce(T.filled(F.col("author")), F.lit("Unknown")).alias("author"), F.coalesce(T.filled(F.col("journal")), F.lit("Unknown")).alias("journal")), R + "SELECT row_id, coalesce(nullif(author, ''), 'Unknown') AS author, coalesce(nullif(journal, ''), 'Unknown') AS journal FROM r WHERE type = 'article'")
C.add("prj25_changes", lambda s, d: _changes(s, d), R + f"SELECT row_id, field, old, new FROM (SELECT r.row_id, unnest(['title', 'author', 'pages']) AS field, unnest([r.title, r.author, r.pages]) AS old, unnest([c.title, c.author, c.pages]) AS new FROM r JOIN ({_CLEAN}) c USING (row_id)) WHERE old IS DISTINCT FROM new")


def _changes(s, d):
    r = records(s, d)
    c = cleaned(r).select("row_id", *[F.col(x).alias("new_" + x) for x in ("title", "author", "pages")])
    rows = F.array(*[F.struct(F.lit(x).alias("field"), F.col(x).alias("old"), F.col("new_" + x).alias("new")) for x in ("title", "author", "pages")])
    return r.join(c, "row_id").select("row_id", F.explode(rows).alias("x")).select("row_id", "x.*").where("not (old <=> new)")


def patch(df, patches):
    """add, replace and remove of single fields."""
    for p in patches:
        name = p["path"].strip("/")
        if name in ("key", "added"):
            raise ValueError(f"{name} is protected")
        df = df.withColumn(name, F.lit(None).cast(dict(df.dtypes).get(name, "string")) if p["op"] == "remove" else F.lit(p["value"]))
    return df


C.add("prj26_patch", lambda s, d: patch(records(s, d), [{"op": "replace", "path": "/journal", "value": "J"}, {"op": "remove", "path": "/url"}]).select("row_id", "journal", "url"), R + "SELECT row_id, 'J' AS journal, CAST(NULL AS VARCHAR) AS url FROM r")

# sorts
C.add("srt01_multi_key", lambda s, d: records(s, d).select("row_id", "type", "year").orderBy(F.col("type").asc_nulls_last(), F.col("year").desc_nulls_last(), "row_id"), R + "SELECT row_id, type, year FROM r ORDER BY type, year DESC NULLS LAST, row_id")
C.add("srt02_recent", lambda s, d: records(s, d).orderBy(F.desc("added"), "row_id").limit(25).select("row_id", "added"), R + "SELECT row_id, added FROM r ORDER BY added DESC, row_id LIMIT 25")
C.add("srt03_export_sort", lambda s, d: _ranked(records(s, d), F.lower(F.coalesce("journal", F.lit("")))), R + "SELECT row_id, row_number() OVER (ORDER BY lower(coalesce(journal, '')), row_id) AS place FROM r")


def _ranked(df, *keys):
    """Places in a global order: range partitions first, offsets of partitions second, so no task sorts all rows."""
    from ..operators.windows import global_rank

    return global_rank(df.select("row_id", *[k.alias(f"k{i}") for i, k in enumerate(keys)]), [f"k{i}" for i in range(len(keys))] + ["row_id"]).select("row_id", "place")


_TK = "regexp_replace(lower(title), '^(the |a |an )', '')"
_AK = r"CASE WHEN contains(author, ',') THEN lower(trim(split_part(author, ',', 1))) ELSE coalesce(regexp_extract(lower(trim(author)), '(\S+)$', 1) || '|' || lower(trim(author)), '') END"
title_key = lambda c: F.regexp_replace(F.lower(c), "^(the |a |an )", "")
author_key = lambda c: F.when(c.contains(","), F.lower(F.trim(F.substring_index(c, ",", 1)))).otherwise(F.coalesce(F.concat(F.regexp_extract(F.lower(F.trim(c)), r"(\S+)$", 1), F.lit("|"), F.lower(F.trim(c))), F.lit("")))
C.add("srt04_by_date", lambda s, d: _ranked(records(s, d), F.coalesce("year", F.lit(9999))), R + "SELECT row_id, row_number() OVER (ORDER BY coalesce(year, 9999), row_id) AS place FROM r")
C.add("srt05_title_key", lambda s, d: records(s, d).select("row_id", title_key(F.col("title")).alias("sort_key")), R + f"SELECT row_id, {_TK} AS sort_key FROM r")
C.add("srt06_author_key", lambda s, d: records(s, d).select("row_id", author_key(F.col("author")).alias("sort_key")), R + f"SELECT row_id, {_AK} AS sort_key FROM r")
C.add("srt07_global_page", lambda s, d: records(s, d).orderBy(F.col("year").desc_nulls_last(), "title", "row_id").offset(20).limit(20).select("row_id"), R + "SELECT row_id FROM r ORDER BY year DESC NULLS LAST, title, row_id LIMIT 20 OFFSET 20")
C.add("srt13_by_size", lambda s, d: records(s, d).groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(30), R + "SELECT key, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, key LIMIT 30")
C.add("srt14_collections_by_name", lambda s, d: collections(s, d).orderBy("coll_name", "id").select("id", "coll_name"), R + "SELECT id, coll_name FROM coll ORDER BY coll_name, id")
C.add("srt15_pages", lambda s, d: records(s, d).agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / 20).alias("total_pages")), R + "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM r")
C.add("crud37_build", lambda s, d: with_numbers(s, d).select("row_id", F.map_concat(F.map_from_entries(F.array(F.struct(F.lit("isbn"), F.col("isbn13")))), F.coalesce("custom", F.create_map().cast("map<string,string>"))).alias("m")).select("row_id", F.size(F.map_keys("m")).cast("bigint").alias("n")), R + "SELECT row_id, 1 + coalesce(cardinality(custom), 0) AS n FROM r")
C.add("crud41_braces", lambda s, d: records(s, d).select("row_id", F.concat(F.lit("{"), "title", F.lit("}")).alias("title")), R + "SELECT row_id, '{' || title || '}' AS title FROM r")
