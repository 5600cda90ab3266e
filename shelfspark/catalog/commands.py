"""Stores, commands and workflows that give the records they leave behind."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import citations as X
from ..functions import text as T
from ..operators import engine as E
from ..operators import quality as Q
from ..operators import search as S
from ..operators import stores as O
from ..operators.index import Index
from ..operators.windows import global_rank
from ..plans.session import stage_dir
from ..sources import bibliography as B
from .formats import _BIB, _RIS, _f
from .quality import _FIRST, _LONG, _MERGED, _NF, _TAY, ISSUES
from .records import SQL_RECORDS as R
from .records import by_key, collections, records
from .registry import Catalog
from .rest import _listed
from .rest import SQL as _REST
from .search import _POST, RK, TOK, _has, _score

C = Catalog()
QUERIES, SQL = C.QUERIES, C.SQL
add = C.add
n_ = lambda: F.count(F.lit(1)).alias("n")


def _place(s, what):
    return f"{stage_dir(s)}/{what}-{uuid.uuid4().hex}"


# stores
_SCALARS = "row_id key type title author editor journal booktitle publisher school institution volume number pages year month doi url abstract added modified".split()
_PAIRS = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _json_store(s, d):
    path, k = _place(s, "json"), by_key(s, d)
    k.write.option("timestampNTZFormat", _STAMP).json(path)
    back = s.read.schema(k.schema).option("timestampNTZFormat", _STAMP).json(path)
    return back.select(*_SCALARS, F.array_join("keywords", "|").alias("keywords"), F.array_join("tags", "|").alias("tags"), _PAIRS(F.col("custom")).alias("custom"))


add("src08_json_store", _json_store, R + "SELECT " + ", ".join(_SCALARS) + ", array_to_string(keywords, '|') AS keywords, array_to_string(tags, '|') AS tags, array_to_string(list_sort(list_transform(map_entries(custom), lambda e: e.key || '=' || e.value)), '|') AS custom FROM k")


def _restored(s, d):
    v, k = O.Versions(s), by_key(s, d).select("key", "title", "year")
    first = v.write(k)
    second = v.write(k.where("year > 2000").withColumn("title", F.upper("title")))
    third = v.write(v.read(first))  # the backup comes back as the newest version
    out = None
    for n in (first, second, third):
        part = v.read(n).select(F.lit(n).alias("version"), "key", "title", "year")
        out = part if out is None else out.unionByName(part)
    return out


add("src09_versions", _restored, R + "SELECT 1 AS version, key, title, year FROM k UNION ALL SELECT 2, key, upper(title), year FROM k WHERE year > 2000 UNION ALL SELECT 3, key, title, year FROM k")


def _snapshot(s, d):
    base = by_key(s, d).select("key", "type", "title")
    changed = O.upsert(base.where("type != 'misc'"), base.where("type = 'book'").withColumn("title", F.upper("title")))
    return base.select(F.lit("rolled back").alias("state"), "key", "title").unionByName(changed.select(F.lit("committed").alias("state"), "key", "title"))


add("src10_snapshot", _snapshot, R + "SELECT 'rolled back' AS state, key, title FROM k UNION ALL SELECT 'committed', key, CASE WHEN type = 'book' THEN upper(title) ELSE title END FROM k WHERE type <> 'misc'")
add("src11_upsert_store", lambda s, d: _latest(s, d), R + "SELECT key, row_id, title, author, year FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY row_id DESC) AS rn FROM r) WHERE rn = 1")


def _latest(s, d):
    r = records(s, d)
    last = r.join(r.groupBy("key").agg(F.max("row_id").alias("row_id")).select("row_id"), "row_id", "left_semi")
    return O.upsert(by_key(s, d), last).select("key", "row_id", "title", "author", "year")


def _nested(s, d):
    """A scope in a scope: the inner end changes nothing, a rollback leaves the old rows, the outer commit shows the new ones."""
    v, k = O.Versions(s), by_key(s, d).select("key", "type")
    v.write(k.where("type = 'book'"))
    seen = []
    v.begin()
    v.begin()
    v.write(k)
    v.end()
    seen.append(("inside", v.read()))
    v.end(commit=False)
    seen.append(("rolled back", v.read()))
    v.begin()
    v.write(k)
    v.end()
    seen.append(("committed", v.read()))
    out = None
    for step, df in seen:
        part = df.select(F.lit(step).alias("step"), "key", "type")
        out = part if out is None else out.unionByName(part)
    return out


add("crud02_transaction", _nested, R + "SELECT step, key, type FROM k, (VALUES ('inside'), ('rolled back'), ('committed')) t(step) WHERE step = 'committed' OR type = 'book'")

# sources and sinks
_LATIN = r"(?s)^[\x00-\xFF]*$"
add("src18_encoding", lambda s, d: records(s, d).select("row_id", B.decoded(F.when((F.col("row_id") % 2 == 1) & F.col("title").rlike(_LATIN), F.encode("title", "ISO-8859-1")).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("title", "UTF-8")))).alias("title")), R + "SELECT row_id, title FROM r")
_ODD = lambda: F.col("row_id") % 5
add("src20_sniff", lambda s, d: records(s, d).select("row_id", B.sniffed(F.when(_ODD() == 4, "list.csv").otherwise("list.txt"), F.when(_ODD() == 0, X.bibtex()).when(_ODD() == 1, X.ris()).when(_ODD() == 2, F.to_json(F.struct("key", "title"))).otherwise(F.col("title"))).alias("format")),
    R + r"SELECT row_id, CASE row_id % 5 WHEN 0 THEN 'bibtex' WHEN 1 THEN 'ris' WHEN 2 THEN 'json' WHEN 4 THEN 'csv' ELSE CASE WHEN regexp_matches(title, '^\s*[\[{]') THEN 'json' ELSE 'unknown' END END AS format FROM r")
add("src22_bibtex_sink", lambda s, d: _written(s, d), R + f"SELECT key, md5({_BIB}) AS digest FROM k")


def _written(s, d):
    """The sink's own files, read as plain text: nothing is escaped and the fields keep their order."""
    path = _place(s, "bib")
    by_key(s, d).select(F.concat(X.bibtex(), F.lit("\u0001")).alias("value")).write.option("lineSep", "\u0002").text(path)
    text = s.read.option("lineSep", "\u0002").text(path).select(F.regexp_replace("value", "\u0001$", "").alias("t"))
    return text.select(F.regexp_extract("t", r"^@[^{]*\{(.*),", 1).alias("key"), F.md5("t").alias("digest"))


_WRAP = r"regexp_replace(regexp_replace(trim(regexp_replace({c}, '\s+', ' ', 'g')), '(\S{{71,}}|.{{1,70}})(?:\s+|$)', '\1' || chr(10) || '      ', 'g'), '\s+$', '')"
add("str29_wrap", lambda s, d: records(s, d).where("abstract != ''").select("row_id", O.wrapped(F.col("abstract")).alias("lines")), R + "SELECT row_id, " + _WRAP.format(c="abstract") + " AS lines FROM r WHERE abstract <> ''")
add("src24_wrapped_ris", lambda s, d: records(s, d).select("row_id", F.regexp_replace(X.ris(), "ER  - $", F.lit("")).alias("head"), F.when(F.col("abstract") != "", F.concat(F.lit("AB  - "), O.wrapped(F.col("abstract")))).alias("ab")).select("row_id", F.concat_ws("\n", F.regexp_replace("head", r"\n$", ""), "ab", F.lit("ER  - ")).alias("ris")),
    R + f"SELECT row_id, concat_ws(chr(10), regexp_replace(ris, '\\nER  - $', ''), 'AB  - ' || {_WRAP.format(c=chr(110) + 'ullif(abstract, ' + chr(39) * 2 + ')')}, 'ER  - ') AS ris FROM (SELECT *, {_RIS} AS ris FROM r)")
add("src29_yaml_sink", lambda s, d: records(s, d).select("row_id", X.yaml().alias("yaml")))
_DEF = lambda: F.concat(F.lit("@string{ j"), F.col("row_id").cast("string"), F.lit(' = "'), F.col("journal"), F.lit('" }'))
add("str27_definitions", lambda s, d: records(s, d).where("journal != ''").select("row_id", B.definition(_DEF()).alias("x")).select("row_id", "x.name", "x.value"), R + "SELECT row_id, 'j' || row_id AS name, journal AS value FROM r WHERE journal <> ''")

# documents and records
add("prj14_document", lambda s, d: O.document(records(s, d)), R + rf"""SELECT row_id, key, year, lower(t) AS content, array_to_string({TOK('title')}, ' ') AS title_terms, array_to_string({TOK('abstract')}, ' ') AS abstract_terms,
  array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(author, ''), '\s+and\s+'), lambda x: trim(x)), lambda x: x <> ''), '; ') AS author_list, length(t) AS text_length,
  {' + '.join(f"CAST(nullif({c}, '') IS NOT NULL AS BIGINT)" for c in ('title', 'author', 'abstract', 'journal', 'doi', 'pages'))} AS field_count
  FROM (SELECT *, concat_ws(' ', nullif(title, ''), nullif(author, ''), nullif(abstract, ''), nullif(journal, '')) AS t FROM r)""")
add("prj24_upgrade", lambda s, d: records(s, d).select("row_id", "key", "type", "title", F.map_concat(F.coalesce("custom", F.create_map().cast("map<string,string>")), F.create_map(F.lit("format_version"), F.lit("2.0"))).alias("m")).select("row_id", "key", "type", "title", _PAIRS(F.col("m")).alias("custom")),
    R + "SELECT row_id, key, type, title, array_to_string(list_sort(list_append(list_transform(map_entries(coalesce(custom, MAP {})), lambda e: e.key || '=' || e.value), 'format_version=2.0')), '|') AS custom FROM r")
add("crud39_from_map", lambda s, d: records(s, d).select("row_id", O.from_json(F.to_json(F.struct("key", F.when(F.col("row_id") % 9 == 0, "web page").otherwise(F.upper("type")).alias("type"), "title", "year", "keywords"))).alias("m")).select("row_id", "m.key", "m.type", "m.title", "m.year", F.array_join("m.keywords", "|").alias("keywords")),
    R + f"SELECT row_id, key, CASE WHEN row_id % 9 = 0 OR type NOT IN {O.TYPES} THEN 'misc' ELSE type END AS type, title, year, coalesce(array_to_string(keywords, '|'), '') AS keywords FROM r")
_A, _Z = "chr(CAST(96 + i AS INT))", "range(1, 27) t(i)"
add("prj13_free_key", lambda s, d: O.free_keys(by_key(s, d).select("key"), by_key(s, d).select("key"), "", 2, 99, "20240101000000"),
    R + f"SELECT key, coalesce((SELECT key || min({_A}) FROM {_Z} WHERE key || {_A} NOT IN (SELECT key FROM k)), (SELECT key || min(i) FROM range(2, 100) t(i) WHERE key || i NOT IN (SELECT key FROM k)), key || '_20240101000000') AS free_key FROM k")
add("pol08_unique_keys", lambda s, d: O.free_keys(by_key(s, d).select("key"), by_key(s, d).select("key"), "_", 1, None, ""),
    R + f"SELECT key, coalesce((SELECT key || min({_A}) FROM {_Z} WHERE key || {_A} NOT IN (SELECT key FROM k)), (SELECT key || '_' || min(i) FROM range(1, 2000) t(i) WHERE key || '_' || i NOT IN (SELECT key FROM k))) AS free_key FROM k")

# merging and commands
add("pol05_merge_command", lambda s, d: Q.merge_groups(records(s, d).withColumn("g", F.col("key")), "g").where("n > 1").select("g", "key", "title", "abstract", "publisher", "doi", "n").unionByName(records(s, d).join(records(s, d).groupBy("key").agg(n_()).where("n = 1").select("key"), "key", "left_semi").select(F.col("key").alias("g"), "key", "title", "abstract", "publisher", "doi", F.lit(1).cast("bigint").alias("n"))),
    _MERGED + "SELECT g, key, title, abstract, publisher, doi, n FROM mg")
add("pol06_auto_merge", lambda s, d: Q.merge_groups(records(s, d).withColumn("g", T.title_author_year(F.col("title"), F.col("author"), F.col("year"))), "g").select("key", "doi", "title", "journal", "n"),
    _TAY.rstrip() + f", mt AS (SELECT g, arg_min(key, (-({_NF}), added, row_id)) AS key, {_FIRST('doi')}, {_LONG('title')}, {_LONG('journal')}, count(*) AS n FROM (SELECT r.*, dk.tay_key AS g FROM r JOIN dk USING (row_id)) GROUP BY g) SELECT key, doi, title, journal, n FROM mt")


def _bulk(s, d):
    store, new = by_key(s, d).where("year < 2015"), by_key(s, d).where("year >= 2015")
    one = lambda name, n, atomic: O.bulk_create(store, n, atomic).select(F.lit(name).alias("run"), "key", "title")
    clean = new.join(Q.with_severity(new).where("errors = 0").select("row_id"), "row_id", "left_semi")
    return one("one by one", new, False).unionByName(one("atomic", new, True)).unionByName(one("atomic, all sound", clean, True))


_GOOD = "year >= 2015 AND row_id NOT IN (SELECT row_id FROM iss WHERE severity = 'error')"
add("pol11_atomic", _bulk, ISSUES + f"SELECT 'one by one' AS run, key, title FROM k WHERE year < 2015 OR ({_GOOD}) UNION ALL SELECT 'atomic, all sound', key, title FROM k WHERE year < 2015 OR ({_GOOD}) UNION ALL "
    "SELECT 'atomic', key, title FROM k WHERE year < 2015 OR (year >= 2015 AND (SELECT count(*) FROM k WHERE year >= 2015 AND row_id IN (SELECT row_id FROM iss WHERE severity = 'error')) = 0)")


def _updated(s, d):
    """Changes field by field: a null takes the field away, an unknown key makes a record."""
    k = by_key(s, d).select("key", "title", "pages")
    t = by_key(s, d)
    changes = t.where("type = 'online'").select("key", F.lit("pages").alias("field"), F.lit(None).cast("string").alias("value")).unionByName(t.where("type = 'book'").select("key", F.lit("title").alias("field"), F.upper("title").alias("value"))).unionByName(t.where("type = 'misc'").select(F.concat(F.lit("new:"), "key").alias("key"), F.lit("title").alias("field"), F.col("title").alias("value")))
    wide = changes.groupBy("key").agg(*[F.max(F.when(F.col("field") == f, F.struct(F.col("value").alias("v")))).alias("c_" + f) for f in ("title", "pages")])
    new = lambda f: F.when(F.col("c_" + f).isNotNull(), F.col("c_" + f)["v"]).otherwise(F.col(f)).alias(f)
    return k.join(wide, "key", "full").select("key", new("title"), new("pages"))


add("pol12_update", _updated, R + "SELECT key, CASE WHEN type = 'book' THEN upper(title) ELSE title END AS title, CASE WHEN type = 'online' THEN NULL ELSE pages END AS pages FROM k UNION ALL SELECT 'new:' || key, title, NULL FROM k WHERE type = 'misc'")
add("pol16_post_import", lambda s, d: O.keyword_rows(records(s, d), "imported").select("row_id", F.array_join(F.array_sort("tags"), "|").alias("tags")), R + "SELECT row_id, array_to_string(list_sort(list_distinct(list_append(coalesce(tags, []), 'imported'))), '|') AS tags FROM r")
add("pol17_import_collection", lambda s, d: _joined(s, d), R + "SELECT id, pos, m FROM (SELECT id, unnest(range(len(entry_keys))) AS pos, unnest(entry_keys) AS m FROM coll) UNION ALL SELECT 'imported', row_number() OVER (ORDER BY key) - 1, key FROM k WHERE year >= 2015")


def _joined(s, d):
    """Collections with the keys of an import in one more: places come from a global order."""
    old = collections(s, d).select("id", F.posexplode("entry_keys").alias("pos", "m"))
    new = global_rank(by_key(s, d).where("year >= 2015").select("key"), ["key"])
    return old.select("id", F.col("pos").cast("bigint").alias("pos"), "m").unionByName(new.select(F.lit("imported").alias("id"), (F.col("place") - 1).alias("pos"), F.col("key").alias("m")))


_SUGGEST = ("title", "author", "journal", "abstract", "doi")


def _hints(s, d):
    """Field by field for the first two records of a key: the only value, the longer one, or none where they agree."""
    r = records(s, d)
    one = r.groupBy("key").agg(F.min("row_id").alias("r1"))
    two = r.join(one, "key").where("row_id > r1").groupBy("key", "r1").agg(F.min("row_id").alias("r2"))
    side = lambda n, p: r.select(F.col("row_id").alias(n), *[T.filled(F.col(c)).alias(p + c) for c in _SUGGEST])
    both = two.join(side("r1", "a_"), "r1").join(side("r2", "b_"), "r2")
    hint = lambda a, b: F.when(a.eqNullSafe(b), "same").when(a.isNull(), "second only").when(b.isNull(), "first only").when(F.length(a) >= F.length(b), "first").otherwise("second")
    return both.select("key", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), hint(F.col("a_" + c), F.col("b_" + c)).alias("hint")) for c in _SUGGEST])).alias("x")).select("key", "x.field", "x.hint")


_SIDES = ", ".join(f"nullif({c}, '') AS {c}" for c in _SUGGEST)
add("ddp06_suggestions", _hints, R + f", o AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY row_id) AS rn, {_SIDES} FROM r) SELECT key, field, CASE WHEN x IS NOT DISTINCT FROM y THEN 'same' WHEN x IS NULL THEN 'second only' WHEN y IS NULL THEN 'first only' WHEN length(x) >= length(y) THEN 'first' ELSE 'second' END AS hint FROM ("
    + " UNION ALL ".join(f"SELECT a.key, '{c}' AS field, a.{c} AS x, b.{c} AS y FROM o a JOIN o b ON a.key = b.key AND a.rn = 1 AND b.rn = 2" for c in _SUGGEST) + ")")
_RULE = [(1, 2, 0.95, "merge"), (2, 3, 0.8, "ask"), (3, 2, 0.85, "tag")]


def _ruled(s, d):
    """The first rule whose size and confidence a group reaches; the rules are a small table that is joined."""
    rules = s.createDataFrame(_RULE, "ord int, least_n int, least double, action string")
    g = Q.duplicate_groups(records(s, d))
    hit = g.join(rules, (F.col("n") >= F.col("least_n")) & (F.col("confidence") >= F.col("least")))
    won = hit.groupBy("first", "n", "confidence").agg(F.min_by("action", "ord").alias("action"))
    return g.join(won, ["first", "n", "confidence"], "left").select("first", "n", "confidence", F.coalesce("action", F.lit("none")).alias("action"))


_CASE = "CASE WHEN confidence >= 0.95 THEN 'merge' WHEN n >= 3 AND confidence >= 0.8 THEN 'ask' WHEN confidence >= 0.85 THEN 'tag' ELSE 'none' END"
add("ddp10_rules", _ruled, _TAY + f"SELECT first, n, confidence, {_CASE} AS action FROM grp")

_BACK = [n for n in X.FIELDS if n != "month"]


def _closed(n):
    """The braces of a value fold away, nine levels deep."""
    x = f"regexp_replace(coalesce({_f(n)}, ''), '[^{{}}]', '', 'g')"
    for _ in range(9):
        x = f"replace({x}, '{{}}', '')"
    return f"{x} = ''"


_CLOSED = " AND ".join(map(_closed, _BACK))


# workflows
def _imported(s, d):
    path = _place(s, "import")
    B.write_text(by_key(s, d).where(B.closes_braces(_BACK)), X.bibtex(), path)  # the format cannot hold other values
    got = B.read_bibtex(s, path).select("key", "type", F.col("fields")["title"].alias("title"), F.col("fields")["year"].try_cast("int").alias("year"))
    ok = (F.coalesce(F.col("title"), F.lit("")) != "") & (F.coalesce(F.col("year"), F.lit(0)) > 0)
    there = by_key(s, d).where("type = 'book'").select(F.trim("key").alias("key")).distinct().withColumn("there", F.lit(True))
    return got.join(there, "key", "left").select("key", "type", "year", F.when(~ok, "invalid").when(F.col("there"), "skipped").otherwise("imported").alias("outcome"))


add("wf01_import", _imported, R + "SELECT trim(key) AS key, type, nullif(year, 0) AS year, CASE WHEN NOT coalesce(trim(title) <> '' AND year > 0, false) THEN 'invalid' WHEN trim(key) IN (SELECT trim(key) FROM k WHERE type = 'book') THEN 'skipped' ELSE 'imported' END AS outcome FROM k WHERE " + _CLOSED)
add("wf03_deduplicate", lambda s, d: _deduplicated(s, d), _TAY.rstrip() + f", g AS (SELECT r.*, dk.tay_key AS g FROM r JOIN dk USING (row_id)), big AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1) SELECT 'merged' AS how, arg_min(key, (-({_NF}), added, row_id)) AS key, {_LONG('title')} FROM g WHERE g IN (SELECT g FROM big) GROUP BY g UNION ALL SELECT 'kept', key, title FROM g WHERE g NOT IN (SELECT g FROM big)")


def _deduplicated(s, d):
    """The records after an automatic run: one for each group of title, authors and year, all others as they are."""
    r = records(s, d).withColumn("g", T.title_author_year(F.col("title"), F.col("author"), F.col("year")))
    big = r.groupBy("g").agg(n_()).where("n > 1").select("g")
    merged = Q.merge_groups(r.join(big, "g", "left_semi"), "g").select(F.lit("merged").alias("how"), "key", "title")
    return merged.unionByName(r.join(big, "g", "left_anti").select(F.lit("kept").alias("how"), "key", "title"))


_TYPE = {"phdthesis": "thesis", "mastersthesis": "thesis", "techreport": "report"}
add("wf04_migrate", lambda s, d: records(s, d).select("row_id", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _TYPE.items() for x in kv]), F.col("type")), F.col("type")).alias("type"), F.coalesce(T.filled(F.col("author")), F.lit("Unknown")).alias("author"), F.col("journal").alias("container"), "title", F.lit("2.0").alias("format_version")),
    R + "SELECT row_id, CASE type WHEN 'phdthesis' THEN 'thesis' WHEN 'mastersthesis' THEN 'thesis' WHEN 'techreport' THEN 'report' ELSE type END AS type, coalesce(nullif(author, ''), 'Unknown') AS author, journal AS container, title, '2.0' AS format_version FROM r")
add("wf08_collection_tree", _listed, _REST["wf10_collection_tree"])

# collections
add("crud04_save_collection", lambda s, d: O.upsert(collections(s, d).select("id", "coll_name", "color"), collections(s, d).where("coll_name is null").select("id", F.lit("(unnamed)").alias("coll_name"), "color"), "id"), R + "SELECT id, coalesce(coll_name, '(unnamed)') AS coll_name, color FROM coll")
add("crud13_delete", lambda s, d: O.delete_collections(collections(s, d).select("id", "coll_name", "parent_id"), collections(s, d).where("coll_query is not null").select("id")), R + "SELECT id, coll_name, CASE WHEN lower(trim(parent_id)) IN (SELECT id FROM coll WHERE coll_query IS NOT NULL) THEN NULL ELSE parent_id END AS parent_id FROM coll WHERE coll_query IS NULL")
add("crud14_create", lambda s, d: O.create_collections(collections(s, d), records(s, d).select(F.col("publisher").alias("name")).unionByName(collections(s, d).select(F.col("coll_name").alias("name"))).distinct()),
    R + "SELECT name, coalesce(trim(name) <> '', false) AND coalesce(lower(trim(name)) NOT IN (SELECT lower(trim(coll_name)) FROM coll WHERE trim(coll_name) <> ''), true) AS created FROM (SELECT publisher AS name FROM r UNION SELECT coll_name FROM coll)")
add("crud38_builder", lambda s, d: E.smart_collections(records(s, d), "type"), R + "SELECT 'type:' || type AS coll_query, 'All of ' || type AS coll_name, count(*) AS n, min(added) AS created FROM r GROUP BY type")
add("crud28_index_facade", lambda s, d: S.postings(S.searchable(records(s, d).where("type != 'misc'"))).groupBy("field").agg(F.countDistinct("row_id").alias("docs"), F.countDistinct("term").alias("terms"), F.count(F.lit(1)).alias("postings")), _POST + "SELECT field, count(DISTINCT row_id) AS docs, count(DISTINCT term) AS terms, count(*) AS postings FROM post WHERE row_id IN (SELECT row_id FROM r WHERE type <> 'misc') GROUP BY 1")
add("crud36_batches", lambda s, d: global_rank(records(s, d).select("row_id", "key"), ["row_id"]).groupBy(F.floor((F.col("place") - 1) / 100).alias("batch")).agg(n_(), F.min("row_id").alias("first"), F.max_by("key", "row_id").alias("last_key")), R + "SELECT CAST(floor((place - 1) / 100) AS BIGINT) AS batch, count(*) AS n, min(row_id) AS first, arg_max(key, row_id) AS last_key FROM (SELECT *, row_number() OVER (ORDER BY row_id) AS place FROM r) GROUP BY 1")
add("fmt09_report_rows", lambda s, d: Q.issues(records(s, d)).groupBy("rule", "severity").agg(n_()).select(F.format_string("| %s | %s | %d |", "rule", "severity", "n").alias("markdown"), F.format_string("<tr><td>%s</td><td>%s</td><td>%d</td></tr>", "rule", "severity", "n").alias("html")),
    ISSUES + "SELECT '| ' || rule || ' | ' || severity || ' | ' || n || ' |' AS markdown, '<tr><td>' || rule || '</td><td>' || severity || '</td><td>' || n || '</td></tr>' AS html FROM (SELECT rule, severity, count(*) AS n FROM iss GROUP BY ALL)")

# words
_STOP = ", ".join(f"'{w}'" for w in S.STOPWORDS)
add("str07_analyzers", lambda s, d: records(s, d).select("row_id", F.array_join(T.tokens(F.col("title")), " ").alias("simple"), F.array_join(F.filter(T.tokens(F.col("title")), lambda w: ~w.isin(*S.STOPWORDS)), " ").alias("standard"), F.lower(F.trim("title")).alias("keyword")),
    R + f"SELECT row_id, array_to_string({TOK('title')}, ' ') AS simple, array_to_string(list_filter({TOK('title')}, lambda w: w NOT IN ({_STOP})), ' ') AS standard, lower(trim(title)) AS keyword FROM r")
_SYN = [("comet", "asteroid"), ("thesaurus", "lexicon"), ("glossary", "lexicon"), ("archive", "repository")]


def _synonyms(s, d):
    """Synonyms of the words of all titles, either way round: the table is joined twice."""
    t = s.createDataFrame(_SYN, "a string, b string")
    both = t.unionByName(t.select(F.col("b").alias("a"), F.col("a").alias("b")))
    words = records(s, d).select(F.explode(F.array_distinct(T.tokens(F.col("title")))).alias("term")).groupBy("term").agg(n_())
    return words.join(both, F.col("term") == F.col("a")).select("term", F.col("b").alias("synonym"), "n")


add("str12_synonyms", _synonyms, R + f"SELECT term, synonym, count(*) AS n FROM (SELECT unnest(list_distinct({TOK('title')})) AS term FROM r) JOIN (SELECT a, b AS synonym FROM (VALUES {', '.join(map(str, _SYN))}) t(a, b) UNION ALL SELECT b, a FROM (VALUES {', '.join(map(str, _SYN))}) t(a, b)) s ON term = a GROUP BY ALL")


def _spelling(s, d):
    df = S.postings(S.searchable(records(s, d))).groupBy("term").agg(F.countDistinct("row_id").alias("df")).where("length(term) > 3")
    return O.corrections(df.where("df = 1"), df.where("df > 1"))


add("str13_spell_check", _spelling)  # no SQL: levenshtein counts bytes there
_WILD = ("archiv*", "te?t*", "*graph*")
add("hl05_wildcards", lambda s, d: records(s, d).select("row_id", S.highlight_wildcards(F.col("title"), _WILD).alias("title")), R + r"SELECT row_id, regexp_replace(title, '(?i)\b(archiv\w*|te\wt\w*|\w*graph\w*)\b', '<mark>\1</mark>', 'g') AS title FROM r")


# the kept index
def _kept(s, d):
    """An index of the older records, kept up with the newer ones, with changed books, and with papers that came and went."""
    r = records(s, d)
    index = Index(s, _place(s, "index")).update(r.where("year < 2015 or year is null").withColumn("title", F.when(F.col("type") == "book", F.lit("archives archives")).otherwise(F.col("title"))))
    index = index.update(r.where("year >= 2015 or type = 'book'"))
    return index.update(None, r.where("type = 'misc'"))


_SEEK = {"srch50_kept_index": ("archives OR kriging", "({a} OR {k})", "CASE WHEN {a} THEN {sa} ELSE 0.0 END + CASE WHEN {k} THEN {sk} ELSE 0.0 END"), "srch51_kept_and": ("kriging NOT future", "{k} AND NOT {f}", "{sk}")}
for _name, (_text, _hit, _sum) in _SEEK.items():
    _parts = {"a": _has("archives"), "k": _has("kriging"), "f": _has("future"), "sa": _score("archives"), "sk": _score("kriging")}
    add(_name, lambda s, d, t=_text: _kept(s, d).search(t).select("row_id", F.round("score", 6).alias("score")), RK + f"SELECT row_id, round({_sum.format(**_parts)}, 6) AS score FROM rk WHERE type <> 'misc' AND {_hit.format(**_parts)}")
add("srch52_index_terms", lambda s, d: _kept(s, d).terms(["otter", "comet"]).groupBy("term", "field").agg(F.countDistinct("row_id").alias("docs"), F.sum("tf").alias("tf")), _POST + "SELECT term, field, count(DISTINCT row_id) AS docs, CAST(sum(tf) AS BIGINT) AS tf FROM post WHERE term IN ('otter', 'comet') AND row_id IN (SELECT row_id FROM r WHERE type <> 'misc') GROUP BY ALL")
_BOOST = "CASE field " + " ".join(f"WHEN '{f}' THEN {b}" for f, b in S.BOOSTS.items()) + " ELSE 0.8 END"
add("srch36_similar", lambda s, d: S.similar(S.postings(S.searchable(records(s, d))), records(s, d).where("row_id = 100")), _POST.rstrip() + f", own AS (SELECT DISTINCT unnest({TOK("concat_ws(' ', title, substr(abstract, 1, 200), array_to_string(keywords, ' '))")}) AS term FROM r WHERE row_id = 100) SELECT row_id, score FROM (SELECT row_id, round(sum({_BOOST} * tf / (tf + 1.2 * (0.25 + 0.75 * len / 100.0))), 6) AS score FROM post JOIN own USING (term) WHERE row_id <> 100 GROUP BY 1) WHERE score >= 0.7 ORDER BY score DESC, row_id LIMIT 25")
for _name, _words, _most, _long in (("win09_clusters", ["otter", "comet", "kriging"], 60, False), ("win10_windows", ["future", "otter"], 100, True)):
    add(_name, lambda s, d, w=_words, m=_most, b=_long: records(s, d).where("abstract is not null").select("row_id", _clusters(w, m, b)(F.col("abstract")).alias("x")).select("row_id", "x.*"))


def _clusters(words, most, by_length):
    from ..functions import udfs

    return udfs.clusters(words, (), most, by_length)


_KEYS = ("name", "kind", "boost", "indexed", "stored", "analyzed", "analyzer")
add("str11_fields", lambda s, d: s.createDataFrame([tuple(f[k] for k in _KEYS) for f in E.configured()], "name string, kind string, boost double, indexed boolean, stored boolean, analyzed boolean, analyzer string"))


# the search service as a whole
def _service(s, d):
    """Hits of the page, the total, facets over all matches: parsed, widened by synonyms, ranked, counted."""
    got = E.Service(records(s, d)).with_synonyms({"archives": ["repositories"]}).search("archives OR kriging")
    hits = got.page.select(F.lit("hit").alias("part"), F.col("row_id").cast("string").alias("name"), F.round("score", 6).alias("amount"))
    total = got.matches.agg(F.count(F.lit(1)).cast("double").alias("amount")).select(F.lit("total").alias("part"), F.lit("").alias("name"), "amount")
    facets = got.facets.select(F.lit("facet").alias("part"), F.concat("field", F.lit("="), "value").alias("name"), F.col("n").cast("double").alias("amount"))
    return hits.unionByName(total).unionByName(facets)


_WIDE = f"(CASE WHEN {_has('archives')} THEN {_score('archives')} ELSE 0.0 END + CASE WHEN {_has('repositories')} THEN 0.8 * {_score('repositories')} ELSE 0.0 END + CASE WHEN {_has('kriging')} THEN {_score('kriging')} ELSE 0.0 END)"
add("srch37_engine", _service, RK.rstrip() + f", hit AS (SELECT *, round({_WIDE}, 6) AS score FROM rk WHERE {_has('archives')} OR {_has('repositories')} OR {_has('kriging')}) "
    "SELECT 'hit' AS part, CAST(row_id AS VARCHAR) AS name, CAST(score AS DOUBLE) AS amount FROM (SELECT row_id, score FROM hit ORDER BY score DESC, row_id LIMIT 20) UNION ALL SELECT 'total', '', count(*) FROM hit"
    + "".join(f" UNION ALL SELECT 'facet', '{f}=' || CAST({f} AS VARCHAR), count(*) FROM hit WHERE CAST({f} AS VARCHAR) <> '' GROUP BY 2" for f in ("type", "year", "journal")))


def _suggested(s, d):
    """What the service proposes where a query finds little: at most five matches are counted."""
    service, text = E.Service(records(s, d)), "title:comet AND kriging"
    n = service.matches(service.parsed(text)).limit(5).count()
    return s.createDataFrame([(x,) for x in service.suggestions(text, n)], "suggestion string")


add("srch38_with_suggestions", _suggested, RK + f"SELECT suggestion FROM (VALUES ('(title:comet OR kriging)', 3), ('comet kriging', 5)) t(suggestion, most), (SELECT count(*) AS n FROM rk WHERE {_has('comet')} AND {_has('kriging')}) WHERE n < most")

# queries as they are read: text, printed again, complexity, words, fields
_READ = [
    ("graph", "graph", 1, "graph", ""), ("graph AND theory", "(graph AND theory)", 2, "graph theory", ""), ("a OR b NOT c", "(a OR b NOT c)", 3, "a b", ""), ("title:otter", "title:otter", 2, "otter", "title"),
    ("year:[2000 TO 2010]", "year:[2000 TO 2010]", 2, "", "year"), ("year:{2000 TO 2010}", "year:{2000 TO 2010}", 2, "", "year"), ('"drawn from"~2', '"drawn from"~2', 2, "drawn from", ""), ("krig*", "krig*", 3, "", ""),
    ("kriging~1", "kriging~1", 5, "kriging", ""), ("otter^2.5", "otter^2.5", 1, "otter", ""), ("two words", "(two AND words)", 2, "two words", ""),
]


def _read_queries(s, d):
    L = E.L
    rows = [(t, str(q), L.complexity(q), " ".join(L.terms(q)), " ".join(L.fields(q))) for t in (r[0] for r in _READ) for q in (L.parse(t),)]
    return s.createDataFrame(rows, "text string, printed string, complexity int, words string, fields string")


add("srch01_parsed", _read_queries, "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(repr(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in _READ) + ") t(text, printed, complexity, words, fields)")

# a file of entries, read back field by field
_FLAT = r"trim(regexp_replace({c}, '[\s\pZ]+', ' ', 'g'))"


def _read_back(s, d):
    path = _place(s, "bibtex")
    B.write_text(by_key(s, d).where(B.closes_braces(_BACK)), X.bibtex(), path)  # the format cannot hold other values
    return B.read_bibtex(s, path).select("key", "type", *[F.col("fields")[n].alias(n) for n in _BACK])


add("src12_read_bibtex", _read_back, R + "SELECT trim(key) AS key, type, " + ", ".join(_FLAT.format(c=f"CAST({_f(n)} AS VARCHAR)") + f" AS {n}" for n in _BACK) + f" FROM k WHERE {_CLOSED}")
