"""Validation, duplicates, merging and conflict policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import quality as Q
from .records import SQL_RECORDS as R
from .records import by_key, collections, records, with_crossref, with_numbers
from .registry import Catalog

C = Catalog()
QUERIES, SQL = C.QUERIES, C.SQL
add = C.add
_R = R.rstrip() + ",\n"


def _case(field, rule, severity, condition):
    return f"SELECT row_id, key, '{field}' AS field, '{rule}' AS rule, '{severity}' AS severity FROM r WHERE {condition}"


_HAS = lambda f: f"nullif({f}, '') IS NOT NULL" if f != "year" else "coalesce(year, 0) <> 0"
_COLS = {"author", "editor", "title", "journal", "booktitle", "publisher", "school", "institution", "year", "url", "pages"}
_RULES = [_case("key", "empty", "error", "coalesce(key, '') = ''"), _case("key", "characters", "error", f"key <> '' AND NOT regexp_matches(key, '{Q.KEY_FORM}')"), _case("key", "too long", "warning", f"length(key) > 250 AND regexp_matches(key, '{Q.KEY_FORM}')")]
for _spec in sorted({x for xs in Q.REQUIRED.values() for x in xs}):
    _types = ", ".join(f"'{t}'" for t, xs in Q.REQUIRED.items() if _spec in xs)
    _any = " OR ".join(_HAS(f) for f in _spec.split("|") if f in _COLS) or "false"
    _RULES.append(_case(_spec, "required", "error", f"type IN ({_types}) AND NOT ({_any})"))
_RULES += [
    _case("year", "far past", "warning", "year < 1000"), _case("year", "far future", "warning", "year > 2029"),
    _case("month", "format", "warning", "lower(month) NOT IN (" + ", ".join(f"'{m}'" for m in Q.MONTHS) + ") AND month <> ''"),
    _case("pages", "format", "warning", f"pages <> '' AND NOT regexp_matches(pages, '{Q.PAGE_FORMS}')"), _case("pages", "single dash", "info", f"regexp_matches(pages, '{Q.PAGE_FORMS}') AND contains(pages, '-') AND NOT contains(pages, '--')"),
    _case("doi", "format", "warning", rf"doi <> '' AND NOT regexp_matches(regexp_replace(regexp_replace(regexp_replace(doi, '^https://doi\.org/', ''), '^http://doi\.org/', ''), '^doi:', ''), '{Q.DOI_FORM}')"),
]
_URL = r"regexp_matches(url, '(?i)^https?://([^/?#:]*\.[^/?#:]*|localhost|\d+)(:[^/?#]*)?([/?#]|$)')"
_RULES += [_case("url", "format", "warning", f"url <> '' AND NOT {_URL}"), _case("url", "not secure", "warning", f"{_URL} AND lower(url) LIKE 'http:%'")]
for _f in ("author", "editor"):
    _RULES += [_case(_f, "empty", "warning", f"trim({_f}) = ''"), _case(_f, "ends with comma", "warning", f"trim({_f}) LIKE '%,'"), _case(_f, "empty name", "warning", f"{_f} LIKE '% and and %'"), _case(_f, "et al.", "info", f"lower({_f}) LIKE '%et al.%'")]
_RULES += [_case("abstract", "too long", "warning", "length(abstract) > 5000"), _case("", "volume without journal", "warning", "(volume <> '' OR number <> '') AND coalesce(journal, '') = ''"), _case("", "pages without container", "info", "pages <> '' AND coalesce(journal, '') = '' AND coalesce(booktitle, '') = ''")]
ISSUES = _R + "iss AS (" + " UNION ALL ".join(_RULES) + ")\n"


def _some(name, fields, rules=None):
    cond = "field IN (" + ", ".join(f"'{f}'" for f in fields) + ")" + (" AND rule IN (" + ", ".join(f"'{r}'" for r in rules) + ")" if rules else "")
    add(name, lambda s, d: Q.issues(records(s, d)).where(F.col("field").isin(fields) & (F.col("rule").isin(rules) if rules else F.lit(True))), ISSUES + f"SELECT * FROM iss WHERE {cond}")


_some("val01_key", ["key"])
_some("val02_required", sorted({x for xs in Q.REQUIRED.values() for x in xs}), ["required"])
_some("val03_year", ["year"], ["far past", "far future"])
_some("val04_month", ["month"])
_some("val05_pages", ["pages"], ["format", "single dash"])
_some("val06_doi", ["doi"])
_some("val11_url", ["url"], ["format", "not secure"])
_some("val12_names", ["author", "editor"], ["empty", "ends with comma", "empty name", "et al."])
_some("val13_abstract", ["abstract"])
_some("val15_consistency", [""])
_D = lambda c, i: f"TRY_CAST(substr({c}, {i}, 1) AS INT)"
add("val07_isbn10", lambda s, d: with_numbers(s, d).select("row_id", Q.isbn10_ok(F.col("isbn10")).alias("ok")), R + "SELECT row_id, (" + " + ".join(f"{11 - i} * {_D('i', i)}" for i in range(1, 11)) + ") % 11 = 0 AS ok FROM (SELECT row_id, lpad(CAST(row_id AS VARCHAR), 9, '0') || (row_id % 10) AS i FROM r)")
add("val08_isbn13", lambda s, d: with_numbers(s, d).select("row_id", Q.isbn13_ok(F.col("isbn13")).alias("ok")), R + "SELECT row_id, (" + " + ".join(f"{1 if i % 2 else 3} * {_D('i', i)}" for i in range(1, 14)) + ") % 10 = 0 AS ok FROM (SELECT row_id, '978' || lpad(CAST(row_id AS VARCHAR), 9, '0') || (row_id % 10) AS i FROM r)")
add("val09_isbn_dispatch", lambda s, d: Q.issues(with_numbers(s, d).withColumn("isbn", F.concat(F.lit("978-"), F.substring("isbn13", 4, 10)))).where("field = 'isbn'").select("row_id", "rule"), R + "SELECT row_id, 'check digit' AS rule FROM (SELECT row_id, '978' || lpad(CAST(row_id AS VARCHAR), 9, '0') || (row_id % 10) AS i FROM r) WHERE (" + " + ".join(f"{1 if i % 2 else 3} * {_D('i', i)}" for i in range(1, 14)) + ") % 10 <> 0 UNION ALL SELECT row_id, 'unusual type' FROM r WHERE type NOT IN ('book', 'inbook', 'incollection', 'proceedings')")
add("val10_issn", lambda s, d: with_numbers(s, d).select("row_id", Q.issn_ok(F.replace("issn", F.lit("-"), F.lit(""))).alias("ok")), R + "SELECT row_id, substr(i, 8, 1) = CASE t WHEN 0 THEN '0' WHEN 1 THEN 'X' ELSE CAST(11 - t AS VARCHAR) END AS ok FROM (SELECT row_id, i, (" + " + ".join(f"{9 - i} * {_D('i', i)}" for i in range(1, 8)) + ") % 11 AS t FROM (SELECT row_id, lpad(CAST(row_id % 10000 AS VARCHAR), 4, '0') || lpad(CAST(row_id % 1000 AS VARCHAR), 3, '0') || (row_id % 10) AS i FROM r))")
add("val14_crossref", lambda s, d: _crossref(s, d), R + "SELECT c.key, CASE WHEN p.key IS NULL THEN 'missing' ELSE 'present' END AS state FROM x c LEFT JOIN x p ON c.crossref = p.key WHERE c.crossref IS NOT NULL")
add("val16_all", lambda s, d: Q.issues(records(s, d)), ISSUES + "SELECT * FROM iss")
add("val17_with_duplicates", lambda s, d: _validated(s, d), ISSUES.rstrip() + ", dk AS (SELECT row_id, " + r"nullif(regexp_replace(lower(trim(coalesce(doi, ''))), '^(https?://doi\.org/|https?://dx\.doi\.org/|doi:)', ''), '')" + " AS k FROM r) SELECT rule, count(*) AS n FROM (SELECT rule FROM iss UNION ALL SELECT 'duplicate doi' FROM dk WHERE k IN (SELECT k FROM dk GROUP BY 1 HAVING count(*) > 1)) GROUP BY 1")
add("val18_severity", lambda s, d: Q.issues(records(s, d)).where("severity != 'info'").groupBy("severity", "field").agg(F.count(F.lit(1)).alias("n")), ISSUES + "SELECT severity, field, count(*) AS n FROM iss WHERE severity <> 'info' GROUP BY ALL")
add("val19_value_checks", lambda s, d: records(s, d).select("row_id", F.col("key").rlike(Q.KEY_FORM).alias("key_ok"), F.col("type").isin(*Q.REQUIRED, "misc").alias("type_ok"), F.col("year").between(1000, 2100).alias("year_ok"), F.col("url").rlike(r"^https?://[^\s/]+\.[^\s]+$").alias("url_ok")), R + f"SELECT row_id, regexp_matches(key, '{Q.KEY_FORM}') AS key_ok, type IN (" + ", ".join(f"'{t}'" for t in [*Q.REQUIRED, 'misc']) + r") AS type_ok, year BETWEEN 1000 AND 2100 AS year_ok, regexp_matches(url, '^https?://[^\s/]+\.[^\s]+$') AS url_ok FROM r")
add("val20_key_policy", lambda s, d: records(s, d).select("row_id", F.when(F.length("key") > 50, "too long").when(~F.col("key").rlike(r"^[\w\-:]+$"), "characters").otherwise("ok").alias("verdict")), R + r"SELECT row_id, CASE WHEN length(key) > 50 THEN 'too long' WHEN NOT regexp_matches(key, '^[\w\-:]+$') THEN 'characters' ELSE 'ok' END AS verdict FROM r")
add("agg13_metrics", lambda s, d: Q.metrics(records(s, d)), ISSUES + "SELECT count(*) AS total, count(*) FILTER (e = 0) AS valid, CAST(sum(e) AS BIGINT) AS errors, CAST(sum(w) AS BIGINT) AS warnings, round_even(count(*) FILTER (e = 0) / count(*) * 100, 2) AS score FROM (SELECT r.row_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM r LEFT JOIN iss USING (row_id) GROUP BY 1)")
add("agg14_batch", lambda s, d: Q.with_severity(records(s, d)).agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("errors") > 0).alias("with_errors"), F.count_if(F.col("warnings") > 0).alias("with_warnings")), ISSUES + "SELECT (SELECT count(*) FROM r) AS checked, count(DISTINCT row_id) FILTER (severity = 'error') AS with_errors, count(DISTINCT row_id) FILTER (severity = 'warning') AS with_warnings FROM iss")
add("agg15_per_entry", lambda s, d: Q.with_severity(records(s, d)).select("row_id", "errors", "warnings", "infos"), ISSUES + "SELECT r.row_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM r LEFT JOIN iss USING (row_id) GROUP BY 1")
add("agg16_report", lambda s, d: Q.issues(records(s, d)).groupBy("field", "rule", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("example")), ISSUES + "SELECT field, rule, severity, count(*) AS n, min(row_id) AS example FROM iss GROUP BY ALL")
add("crud01_import_verdict", lambda s, d: Q.with_severity(by_key(s, d)).select("key", (F.col("errors") == 0).alias("ok")), ISSUES + "SELECT key, row_id NOT IN (SELECT row_id FROM iss WHERE severity = 'error') AS ok FROM k")
add("crud43_consistency", lambda s, d: _consistency(s, d), R + "SELECT (SELECT count(*) FROM (SELECT 1 FROM r GROUP BY lower(trim(title)), lower(trim(author)) HAVING count(*) > 1)) AS duplicate_groups, (SELECT count(*) FROM x WHERE crossref IS NOT NULL AND crossref NOT IN (SELECT key FROM x)) AS dangling")


def _crossref(s, d):
    x = with_crossref(s, d)
    p = x.select(F.col("key").alias("crossref"), F.lit("present").alias("state"))
    return x.where("crossref is not null").join(p, "crossref", "left").select("key", F.coalesce("state", F.lit("missing")).alias("state"))


def _validated(s, d):
    r = records(s, d)
    k = Q.duplicate_keys(r).where("doi_key is not null")
    twice = k.groupBy("doi_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("n")
    dup = twice.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).where("n > 0").select(F.lit("duplicate doi").alias("rule"), "n")
    return Q.issues(r).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).unionByName(dup)


def _consistency(s, d):
    g = records(s, d).groupBy(F.lower(F.trim("title")).alias("t"), F.lower(F.trim("author")).alias("a")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("duplicate_groups"))
    x = with_crossref(s, d)
    m = x.where("crossref is not null").join(x.select(F.col("key").alias("crossref")), "crossref", "left_anti").agg(F.count(F.lit(1)).alias("dangling"))
    return s.range(1).select(g.scalar().alias("duplicate_groups"), m.scalar().alias("dangling"))


# duplicates
_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '\{{?\\(la)?tex\}}?', ' latex ', 'g'), '\\[a-z]+\*?(\s*\{{\}})?', ' ', 'g'), '[{{}}]', '', 'g')), '\b(the|a|an)\b', '', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_SUF = ", ".join(f"'{x}'" for x in T.SUFFIXES)
_SURNAME = rf"CASE WHEN contains(a, ',') THEN trim(split_part(a, ',', 1)) ELSE coalesce(list_filter(regexp_split_to_array(a, '\s+'), lambda w: w NOT IN ({_SUF}) AND length(w) > 1)[-1], regexp_split_to_array(a, '\s+')[-1]) END"
_TAY = _R + rf"""pp AS (SELECT row_id, trim(unnest(regexp_split_to_array(coalesce(author, ''), '\s+and\s+'))) AS a FROM r),
sn AS (SELECT row_id, {_NORM.format(c='x')} AS s FROM (SELECT row_id, {_SURNAME} AS x FROM pp WHERE a <> '')),
au AS (SELECT row_id, string_agg(s, ' ' ORDER BY s) AS people FROM sn WHERE s <> '' GROUP BY 1),
dk AS (SELECT r.row_id, r.key, nullif(regexp_replace(lower(trim(coalesce(doi, ''))), '^(https?://doi\.org/|https?://dx\.doi\.org/|doi:)', ''), '') AS doi_key,
  {_NORM.format(c='title')} || '|' || coalesce(people, '') || '|' || coalesce(CAST(year AS VARCHAR), 'None') AS tay_key FROM r LEFT JOIN au USING (row_id)),
gg AS (SELECT list_sort(list(row_id)) AS m, CASE WHEN count(DISTINCT tay_key) = 1 THEN 1.0 ELSE 0.95 END AS c FROM dk WHERE doi_key IS NOT NULL GROUP BY doi_key HAVING count(*) > 1
  UNION ALL SELECT list_sort(list(row_id)), CASE WHEN count(DISTINCT doi_key) = 1 AND count(doi_key) = count(*) THEN 0.9 ELSE 0.8 END FROM dk GROUP BY tay_key HAVING count(*) > 1),
grp AS (SELECT m[1] AS first, len(m) AS n, CAST(max(c) AS DOUBLE) AS confidence FROM gg GROUP BY m)
"""
add("ddp01_keys", lambda s, d: Q.duplicate_keys(records(s, d)).select("row_id", "doi_key", "tay_key"), _TAY + "SELECT row_id, doi_key, tay_key FROM dk")
add("ddp02_groups", lambda s, d: Q.duplicate_groups(records(s, d)).select("first", "n"), _TAY + "SELECT first, n FROM grp")
add("ddp04_confidence", lambda s, d: Q.duplicate_groups(records(s, d)), _TAY + "SELECT * FROM grp")
add("ddp05_warnings", lambda s, d: _warnings(s, d), _TAY + "SELECT row_id, count(*) OVER (PARTITION BY doi_key) - 1 AS others FROM dk WHERE doi_key IS NOT NULL QUALIFY others > 0")
add("ddp07_detect", lambda s, d: Q.duplicate_groups(records(s, d)).where("confidence >= 0.85"), _TAY + "SELECT * FROM grp WHERE confidence >= 0.85")
add("ddp09_action", lambda s, d: Q.duplicate_groups(records(s, d)).select("first", F.when(F.col("confidence") >= 0.95, "merge").when(F.col("confidence") >= 0.85, "review").otherwise("skip").alias("action")), _TAY + "SELECT first, CASE WHEN confidence >= 0.95 THEN 'merge' WHEN confidence >= 0.85 THEN 'review' ELSE 'skip' END AS action FROM grp")
add("agg23_dedupe_summary", lambda s, d: Q.duplicate_groups(records(s, d)).agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") - 1).alias("surplus")), _TAY + "SELECT count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS surplus FROM grp")
add("ddp11_import_probe", lambda s, d: _probe(s, d), R + r"SELECT n.row_id FROM (SELECT row_id, regexp_replace(lower(trim(doi)), '^(https?://doi\.org/|https?://dx\.doi\.org/|doi:)', '') AS k FROM r WHERE year >= 2015 AND doi <> '') n WHERE k IN (SELECT regexp_replace(lower(trim(doi)), '^(https?://doi\.org/|https?://dx\.doi\.org/|doi:)', '') FROM r WHERE year < 2015 AND doi <> '')")

_ALIKE = _TAY.rstrip() + """,
al AS (SELECT row_id, key, 'doi' AS field, 'warning' AS severity, doi_key AS shared FROM dk WHERE doi_key IS NOT NULL
  UNION ALL SELECT row_id, key, '', 'info', tay_key FROM dk WHERE row_id IN (SELECT row_id FROM r WHERE title <> '' AND author <> '' AND year <> 0)),
wn AS (SELECT row_id, key, field, severity, shared, count(*) OVER (PARTITION BY field, shared) - count(*) OVER (PARTITION BY field, shared, key) AS others FROM al QUALIFY others > 0)
"""
add("ddp12_all_warnings", lambda s, d: _alike(s, d), _ALIKE + "SELECT row_id, key, field, severity, shared, others FROM wn")
add("ddp13_warning_keys", lambda s, d: _alike(s, d).select("field", "shared", "key").distinct(), _ALIKE + "SELECT DISTINCT field, shared, key FROM wn")
add("val21_all_duplicates", lambda s, d: _validated_all(s, d), _ALIKE.rstrip() + ", iss AS (" + " UNION ALL ".join(_RULES) + ") SELECT rule, severity, count(*) AS n FROM (SELECT rule, severity FROM iss UNION ALL SELECT CASE field WHEN 'doi' THEN 'duplicate doi' ELSE 'possible duplicate' END, severity FROM wn) GROUP BY ALL")


def _alike(s, d):
    """Records sharing a doi (warning) or title, authors and year (info) with records of another key, and how many those are.

    The other keys are those of the same ``shared`` value in ``ddp13_warning_keys``: named once for each value, not once for each pair.
    """
    r = records(s, d)
    whole = r.where("title != '' and author != '' and year != 0")
    k = Q.duplicate_keys(r).where("doi_key is not null").select("row_id", "key", F.lit("doi").alias("field"), F.lit("warning").alias("severity"), F.col("doi_key").alias("shared")).unionByName(
        Q.duplicate_keys(whole).select("row_id", "key", F.lit("").alias("field"), F.lit("info").alias("severity"), F.col("tay_key").alias("shared"))
    )
    own = k.groupBy("field", "shared", "key").agg(F.count(F.lit(1)).alias("own"))
    total = own.groupBy("field", "shared").agg(F.sum("own").alias("total"))
    others = own.join(total, ["field", "shared"]).where("total > own").select(F.col("field").alias("f"), F.col("shared").alias("v"), F.col("key").alias("k"), (F.col("total") - F.col("own")).alias("others"))
    on = (F.col("field") == F.col("f")) & (F.col("shared") == F.col("v")) & F.col("key").eqNullSafe(F.col("k"))
    return k.join(others, on).select("row_id", "key", "field", "severity", "shared", "others")


def _validated_all(s, d):
    dup = _alike(s, d).select(F.when(F.col("field") == "doi", "duplicate doi").otherwise("possible duplicate").alias("rule"), "severity")
    return Q.issues(records(s, d)).select("rule", "severity").unionByName(dup).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


def _warnings(s, d):
    """Counts of the other records with one's doi: aggregated first and joined back, so a hot doi is no hot window."""
    k = Q.duplicate_keys(records(s, d)).where("doi_key is not null")
    n = k.groupBy("doi_key").agg((F.count(F.lit(1)) - 1).alias("others")).where("others > 0")
    return k.join(n, "doi_key").select("row_id", "others")


def _probe(s, d):
    r = records(s, d).where("doi != ''").withColumn("k", T.normal_doi(F.col("doi")))
    return r.where("year >= 2015").join(r.where("year < 2015").select("k"), "k", "left_semi").select("row_id")


# merging
_ORD = "added, row_id"
_FIRST = lambda c: f"arg_min({c}, (added, row_id)) FILTER ({c} IS NOT NULL) AS {c}"
_LONG = lambda c: f"arg_min({c}, (-length({c}), added, row_id)) FILTER ({c} IS NOT NULL) AS {c}"
_NF = " + ".join(f"CAST(nullif({c}, '') IS NOT NULL AS INT)" for c in ("title", "author", "journal", "doi", "abstract", "pages", "url", "publisher"))
_MERGED = _R + f"""mg AS (SELECT key AS g, arg_min(key, (-({_NF}), added, row_id)) AS key, {_FIRST('doi')}, {_FIRST('year')}, {_LONG('title')}, {_LONG('journal')}, {_LONG('publisher')}, {_LONG('abstract')}, {_LONG('pages')},
  min(list_min(nums)) AS lo, max(list_max(nums)) AS hi, count(*) AS n, max(modified) AS modified
  FROM (SELECT *, list_filter(list_transform(string_split(regexp_replace(pages, '--|,', '-', 'g'), '-'), lambda x: TRY_CAST(trim(x) AS INT)), lambda x: x IS NOT NULL) AS nums FROM r) GROUP BY g)
"""
add("pol01_strategies", lambda s, d: Q.merge_groups(records(s, d).withColumn("g", F.col("key")), "g").select("g", "doi", "title", "journal"), _MERGED + "SELECT g, doi, title, journal FROM mg")
add("pol02_merge", lambda s, d: Q.merge_groups(records(s, d).withColumn("g", F.col("key")), "g").select("g", "year", "publisher", "pages", "n", "modified"), _MERGED + "SELECT g, year, publisher, CASE WHEN lo IS NULL THEN pages WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '--' || hi END AS pages, n, modified FROM mg")
add("pol03_target_key", lambda s, d: Q.merge_groups(records(s, d).withColumn("g", F.lower("title")), "g").select("g", "key"), R + f"SELECT lower(title) AS g, arg_min(key, (-({_NF}), added, row_id)) AS key FROM r GROUP BY 1")
add("pol04_fixups", lambda s, d: records(s, d).select("row_id", F.coalesce(T.filled(F.col("author")), T.filled(F.col("editor"))).alias("author")), R + "SELECT row_id, coalesce(nullif(author, ''), nullif(editor, '')) AS author FROM r")
add("str31_pages", lambda s, d: Q.merge_groups(records(s, d).withColumn("g", F.col("journal")).where("g != ''"), "g").select("g", "pages"), R + "SELECT g, CASE WHEN lo IS NULL THEN pages WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '--' || hi END AS pages FROM (SELECT journal AS g, " + _LONG("pages") + ", min(list_min(nums)) AS lo, max(list_max(nums)) AS hi FROM (SELECT *, list_filter(list_transform(string_split(regexp_replace(pages, '--|,', '-', 'g'), '-'), lambda x: TRY_CAST(trim(x) AS INT)), lambda x: x IS NOT NULL) AS nums FROM r WHERE journal <> '') GROUP BY 1)")
_LN = r"lower(CASE WHEN contains(name, ',') THEN trim(split_part(name, ',', 1)) ELSE regexp_extract(trim(name), '(\S+)$', 1) END)"
add("str30_authors", lambda s, d: Q.smart_authors(records(s, d), "key"), R + f"SELECT key, string_agg(name, ' and ' ORDER BY seen) AS author FROM (SELECT key, {_LN} AS last, min((added, row_id, pos)) AS seen, arg_min(name, (-length(name), added, row_id, pos)) AS name FROM (SELECT key, added, row_id, trim(unnest(string_split(author, ' and '))) AS name, unnest(range(len(string_split(author, ' and ')))) AS pos FROM r WHERE author <> '') WHERE name <> '' GROUP BY ALL) GROUP BY 1")
for _s in ("skip", "replace", "rename", "merge", "ask"):
    _out = f"'{_s}'" if _s != "ask" else "CASE WHEN n.doi = o.doi THEN 'skip' WHEN lower(n.title) = lower(o.title) THEN 'merge' ELSE 'rename' END"
    add(f"pol07_{_s}", lambda s, d, st=_s: Q.conflict(records(s, d).where("year >= 2010").select("key", "title", "doi"), by_key(s, d).where("type = 'article'"), st), R + f"SELECT n.key, CASE WHEN o.key IS NULL THEN 'create' ELSE {_out} END AS outcome FROM (SELECT key, title, doi FROM r WHERE year >= 2010) n LEFT JOIN (SELECT * FROM k WHERE type = 'article') o ON n.key = o.key")
add("pol09_update_existing", lambda s, d: _update(s, d), R + "SELECT k.key, coalesce(n.url, k.url) AS url, coalesce(n.doi, k.doi) AS doi FROM k LEFT JOIN (SELECT key, max(url) AS url, max(doi) AS doi FROM r GROUP BY 1) n ON k.key = n.key")
add("pol10_create", lambda s, d: _create(s, d), ISSUES + "SELECT k.key FROM k WHERE year >= 2015 AND key NOT IN (SELECT key FROM r WHERE year < 2015) AND row_id NOT IN (SELECT row_id FROM iss WHERE severity = 'error')")
add("pol13_cascade", lambda s, d: _cascade(s, d), R + "SELECT id, count(*) FILTER (m IS NOT NULL AND m NOT IN (SELECT lower(trim(key)) FROM k WHERE type = 'misc')) AS n FROM (SELECT id, lower(trim(unnest(CASE WHEN len(entry_keys) = 0 THEN [NULL] ELSE entry_keys END))) AS m FROM coll WHERE entry_keys IS NOT NULL) GROUP BY 1")
add("pol14_postconditions", lambda s, d: Q.merge_groups(records(s, d).withColumn("g", F.col("key")), "g").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("sources")), R + "SELECT count(DISTINCT key) AS kept, count(*) AS sources FROM r")


def _update(s, d):
    n = records(s, d).groupBy("key").agg(F.max("url").alias("nu"), F.max("doi").alias("nd"))
    return by_key(s, d).join(n, "key", "left").select("key", F.coalesce("nu", "url").alias("url"), F.coalesce("nd", "doi").alias("doi"))


def _create(s, d):
    new = by_key(s, d).where("year >= 2015").join(records(s, d).where("year < 2015").select("key"), "key", "left_anti")
    return new.join(Q.with_severity(new).where("errors = 0").select("row_id"), "row_id", "left_semi").select("key")


def _cascade(s, d):
    m = collections(s, d).where("entry_keys is not null").select("id", F.explode_outer("entry_keys").alias("k")).withColumn("k", F.lower(F.trim("k")))
    gone = by_key(s, d).where("type = 'misc'").select(F.lower(F.trim("key")).alias("k"), F.lit(True).alias("gone"))
    return m.join(gone, "k", "left").groupBy("id").agg(F.count_if(F.col("k").isNotNull() & F.col("gone").isNull()).alias("n"))
