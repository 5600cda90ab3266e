"""Text search, ranking, text functions and highlighting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import querylang as L
from ..operators import search as S
from .records import SQL_RECORDS as R
from .records import records
from .registry import Catalog

C = Catalog()
QUERIES, SQL = C.QUERIES, C.SQL
add = C.add
_R = R.rstrip() + ",\n"
W = r"'[\p{L}\p{N}_]+'"
RK = _R + "rk AS (SELECT *, array_to_string(keywords, ' ') AS keywords_text FROM r)\n"
TOK = lambda f: f"coalesce(regexp_extract_all(lower({f}), {W}), [])"


def _has(term):
    return "(" + " OR ".join(f"list_contains({TOK(f)}, '{term.lower()}')" for f in S.FIELDS) + ")"


def _tf(f, term):
    return f"coalesce((length(lower({f})) - length(replace(lower({f}), '{term.lower()}', ''))) / {len(term)}, 0)"


def _wc(f):
    return rf"len(list_filter(regexp_split_to_array(coalesce({f}, ''), '\s+'), lambda w: w <> ''))"


def _score(term, fields=S.FIELDS):
    return "(" + " + ".join(f"CASE WHEN {_tf(f, term)} > 0 THEN {S.BOOSTS.get(f, 0.8)} * {_tf(f, term)} / ({_tf(f, term)} + 1.2 * (0.25 + 0.75 * {_wc(f)} / 100.0)) ELSE 0.0 END" for f in fields) + ")"


def _q(name, text, match, score, strict=False):
    add(name, lambda s, d: S.search(records(s, d), text, strict).select("row_id", F.round("score", 6).alias("score")), RK + f"SELECT row_id, round({score}, 6) AS score FROM rk WHERE {match}")


_like = lambda t: "(" + " OR ".join(f"coalesce(contains(lower({f}), '{t}'), false)" for f in S.FIELDS) + ")"
_likes = lambda t, fs=S.FIELDS: "(" + " + ".join(f"CASE WHEN contains(lower({f}), '{t}') THEN {S.BOOSTS.get(f, 0.8)} ELSE 0.0 END" for f in fs) + ")"
_q("srch13_term", "kriging", _has("kriging"), _score("kriging"))
_q("srch14_terms_score", "neural tokenizer", f"{_has('neural')} AND {_has('tokenizer')}", f"{_score('neural')} + {_score('tokenizer')}")
_q("srch15_field_boost", "author:katherine", _has("katherine"), _score("katherine", ["author"]))
_q("srch15b_field_strict", "title:glacier", f"list_contains({TOK('title')}, 'glacier')", _score("glacier", ["title"]), True)
_q("srch16_phrase", '"earlier accounts of"', _like("earlier accounts of"), _likes("earlier accounts of"))
_wild = lambda p: "(" + " OR ".join(f"coalesce(regexp_matches({f}, '(?i){p}'), false)" for f in S.FIELDS) + ")"
_q("srch17_wildcard", "tokeni?er*", _wild("tokeni.er.*"), "(" + " + ".join(f"CASE WHEN regexp_matches({f}, '(?i)tokeni.er.*') THEN {S.BOOSTS.get(f, 0.8)} ELSE 0.0 END" for f in S.FIELDS) + ")")
_fz = lambda f: f"len(list_filter({TOK(f)}, lambda t: levenshtein(t, 'krigin') <= 1)) > 0"
_q("srch18_fuzzy", "krigin~1", "(" + " OR ".join(_fz(f) for f in S.FIELDS) + ")", "(" + " + ".join(f"CASE WHEN {_fz(f)} THEN {S.BOOSTS.get(f, 0.8)} ELSE 0.0 END" for f in S.FIELDS) + ")")
_q("srch19_range", "year:[1990 TO 1999}", "year >= 1990 AND year < 1999", "1.0")
_q("srch19b_open_range", "volume:[90 TO *]", "TRY_CAST(volume AS DOUBLE) >= 90", "1.0")
_q("srch20_dots", "year:2001..2003", "year BETWEEN 2001 AND 2003", "1.0")
_q("srch21_and", "comet AND otter", f"{_has('comet')} AND {_has('otter')}", f"{_score('comet')} + {_score('otter')}")
_q("srch22_or", "stemming OR kriging", f"({_has('stemming')} OR {_has('kriging')})", f"(CASE WHEN {_has('stemming')} THEN {_score('stemming')} ELSE 0.0 END + CASE WHEN {_has('kriging')} THEN {_score('kriging')} ELSE 0.0 END)")
_q("srch23_not", "stemming NOT kriging", f"{_has('stemming')} AND NOT {_has('kriging')}", _score("stemming"))
_q("srch25_complement", "NOT future", f"NOT {_has('future')}", "1.0")
_q("srch27_boosted", "kriging^2.5", _has("kriging"), f"2.5 * {_score('kriging')}")
_q("set13_nested", "comet AND otter OR glacier", f"{_has('comet')} AND ({_has('otter')} OR {_has('glacier')})", f"{_score('comet')} + CASE WHEN {_has('otter')} THEN {_score('otter')} ELSE 0.0 END + CASE WHEN {_has('glacier')} THEN {_score('glacier')} ELSE 0.0 END")
add("srch24_field_substrings", lambda s, d: _substrings(s, d), RK + "SELECT row_id, sum_ AS score FROM (SELECT row_id, CASE WHEN contains(lower(title), 'otter') THEN 2.0 ELSE 0.0 END + CASE WHEN contains(lower(journal), 'applied') THEN 1.0 ELSE 0.0 END AS sum_ FROM rk) WHERE sum_ > 0")
_POST = _R + "lg AS (" + " UNION ALL ".join(f"SELECT row_id, '{f}' AS field, {TOK(f if f != 'keywords_text' else 'array_to_string(keywords, chr(32))')} AS ts FROM r" for f in S.FIELDS) + "),\npost AS (SELECT term, field, row_id, count(*) AS tf, any_value(len) AS len FROM (SELECT row_id, field, len(ts) AS len, unnest(ts) AS term FROM lg) GROUP BY ALL)\n"
_post = lambda s, d: S.postings(S.searchable(records(s, d)))
add("srch29_simple_index", lambda s, d: S.simple_index(_post(s, d), "neural kriging otter").select("row_id", F.round("score", 6).alias("score")), _POST + "SELECT row_id, round(sum(tf) / 3, 6) AS score FROM post WHERE term IN ('neural', 'kriging', 'otter') GROUP BY 1")
add("srch30_index_field", lambda s, d: S.simple_index(_post(s, d), "comet", "title").select("row_id", F.round("score", 6).alias("score")), _POST + "SELECT row_id, round(sum(tf), 6) AS score FROM post WHERE term = 'comet' AND field = 'title' GROUP BY 1")
add("srch32_postings", lambda s, d: _post(s, d).groupBy("term").agg(F.countDistinct("row_id").alias("df"), F.sum("tf").alias("cf")), _POST + "SELECT term, count(DISTINCT row_id) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY 1")
add("srch33_suggest", lambda s, d: S.suggest(records(s, d), "why", "title", 15), R + "SELECT DISTINCT title FROM r WHERE lower(title) LIKE 'why%' ORDER BY title LIMIT 15")
add("srch34_suggest_near", lambda s, d: records(s, d).select(F.explode(T.tokens(F.col("title"))).alias("term")).where(F.col("term").startswith("krig") | (F.levenshtein(F.col("term"), F.lit("stemmin"), 2) >= 0)).distinct(), R + f"SELECT DISTINCT term FROM (SELECT unnest({TOK('title')}) AS term FROM r) WHERE starts_with(term, 'krig') OR levenshtein(term, 'stemmin') <= 2")
add("srch35_more_like", lambda s, d: S.more_like(_post(s, d), 10), _POST + ", dfq AS (SELECT term, count(DISTINCT row_id) AS df FROM post GROUP BY 1), own AS (SELECT term, sum(tf) AS o FROM post WHERE row_id = 10 GROUP BY 1) SELECT p.row_id, round(sum(o * ln((SELECT count(DISTINCT row_id) FROM post) / df) * p.tf), 6) AS score FROM post p JOIN own USING (term) JOIN dfq USING (term) WHERE p.row_id <> 10 GROUP BY 1 ORDER BY score DESC, row_id LIMIT 10")
add("srch42_spelling", lambda s, d: _near_words(s, d), R + f"SELECT word, max(term) AS term FROM (SELECT w.word, t.term, row_number() OVER (PARTITION BY w.word ORDER BY levenshtein(w.word, t.term), t.df DESC, t.term) AS rn FROM (SELECT unnest(['krigng', 'glacer', 'tokeniser']) AS word) w JOIN (SELECT term, count(*) AS df FROM (SELECT unnest({TOK('title')}) AS term FROM r) GROUP BY 1) t ON levenshtein(w.word, t.term) <= 2) WHERE rn = 1 GROUP BY 1")
add("qry31_score_threshold", lambda s, d: S.search(records(s, d), "kriging").where("round(score, 6) >= 1.5").select("row_id"), RK + f"SELECT row_id FROM rk WHERE {_has('kriging')} AND round({_score('kriging')}, 6) >= 1.5")
add("srt10_top_k", lambda s, d: S.search(records(s, d), "kriging").orderBy(F.desc(F.round("score", 6)), "row_id").offset(5).limit(10).select("row_id"), RK + f"SELECT row_id FROM rk WHERE {_has('kriging')} ORDER BY round({_score('kriging')}, 6) DESC, row_id LIMIT 10 OFFSET 5")
add("srt12_top_facets", lambda s, d: S.search(records(s, d), "kriging").groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(5), RK + f"SELECT type, count(*) AS n FROM rk WHERE {_has('kriging')} GROUP BY 1 ORDER BY n DESC, type LIMIT 5")


def _substrings(s, d):
    score = F.when(F.lower("title").contains("otter"), 2.0).otherwise(0.0) + F.when(F.lower("journal").contains("applied"), 1.0).otherwise(0.0)
    return records(s, d).select("row_id", score.alias("score")).where("score > 0")


def _near_words(s, d):
    """The nearest vocabulary word of each misspelt one; the asked words are few and stand in the plan."""
    vocab = records(s, d).select(F.explode(T.tokens(F.col("title"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    asked = F.array(*[F.lit(w) for w in ("krigng", "glacer", "tokeniser")])
    near = vocab.select("term", "df", F.explode(asked).alias("word")).withColumn("off", F.levenshtein("word", "term", 2)).where("off >= 0")
    return near.groupBy("word").agg(F.min_by("term", F.struct("off", -F.col("df"), "term")).alias("term"))


# ranking
def _bm(term, f, k1=1.2, b=0.75):
    n = "(SELECT count(*) FROM r)"
    df = f"greatest(1, CASE WHEN {n} < 10 THEN 1 ELSE floor({n} * {0.5 if term in S.STOPWORDS else 0.2 if len(term) <= 3 else 0.1}) END)"
    tf, ln = _tf(f, term), _wc(f)
    return f"CASE WHEN {tf} > 0 THEN {S.WEIGHTS[f]} * ln(({n} - {df} + 0.5) / ({df} + 0.5)) * ({tf} * {k1 + 1}) / ({tf} + {k1} * ({1 - b} + {b} * {ln} / {float(S.LENGTHS[f])})) ELSE 0.0 END"


def _ti(term, f):
    n = "(SELECT count(*) FROM r)"
    return f"CASE WHEN {_tf(f, term)} > 0 THEN {S.WEIGHTS[f]} * {_tf(f, term)} / {_wc(f)} * ln({n} / greatest(1, floor({n} * 0.1))) ELSE 0.0 END"


add("rank01_formula", lambda s, d: _formula(s, d), _POST + ", xx AS (SELECT row_id, tf, len, (SELECT count(DISTINCT row_id) FROM post WHERE term = 'kriging' AND field = 'title') AS df, (SELECT count(*) FROM r) AS n, (SELECT avg(len) FROM (SELECT row_id, any_value(len) AS len FROM post WHERE field = 'title' GROUP BY 1)) AS mean FROM post WHERE term = 'kriging' AND field = 'title') SELECT row_id, round(ln((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)), 6) AS score FROM xx")
add("rank02_bm25", lambda s, d: S.rank(records(s, d), ["kriging", "otter"]).where("score != 0").select("row_id", F.round("score", 6).alias("score")), RK + "SELECT row_id, round(score, 6) AS score FROM (SELECT row_id, " + " + ".join(_bm(t, f) for t in ("kriging", "otter") for f in ("title", "abstract", "keywords_text")) + " AS score FROM rk) WHERE score <> 0")
add("rank04_tfidf", lambda s, d: S.rank(records(s, d), ["kriging"], "tfidf").where("score != 0").select("row_id", F.round("score", 6).alias("score")), RK + "SELECT row_id, round(score, 6) AS score FROM (SELECT row_id, " + " + ".join(_ti("kriging", f) for f in ("title", "abstract")) + " AS score FROM rk) WHERE score <> 0")
add("rank03_tfidf_formula", lambda s, d: _post(s, d).where("term = 'otter' and field = 'abstract'").select("row_id", F.round(S.tfidf(F.col("tf"), F.lit(100), F.lit(1000), F.col("len")), 6).alias("score")), _POST + "SELECT row_id, round(tf / len * ln(1000 / 100), 6) AS score FROM post WHERE term = 'otter' AND field = 'abstract'")
add("rank05_boosted", lambda s, d: S.search(records(s, d), "kriging").select("row_id", F.round(F.col("score") * F.when(F.col("type") == "article", 2.0).otherwise(1.0), 6).alias("score")), RK + f"SELECT row_id, round({_score('kriging')} * CASE WHEN type = 'article' THEN 2.0 ELSE 1.0 END, 6) AS score FROM rk WHERE {_has('kriging')}")
add("rank06_recency", lambda s, d: S.search(records(s, d), "kriging").select("row_id", F.round(S.recency(F.col("score"), F.col("added"), F.lit("2024-06-01").cast("date")), 6).alias("score")), RK + f"SELECT row_id, round({_score('kriging')} * pow(0.9, date_diff('day', CAST(added AS DATE), DATE '2024-06-01') / 365.25), 6) AS score FROM rk WHERE {_has('kriging')}")
add("rank07_compound", lambda s, d: S.search(records(s, d), "kriging").select("row_id", F.round(0.7 * F.col("score") + 0.3 * F.when(F.col("year") > 2000, 1.0).otherwise(0.0), 6).alias("score")), RK + f"SELECT row_id, round(0.7 * {_score('kriging')} + 0.3 * CASE WHEN year > 2000 THEN 1.0 ELSE 0.0 END, 6) AS score FROM rk WHERE {_has('kriging')}")
add("rank09_document_frequency", lambda s, d: _post(s, d).where(F.col("term").isin("kriging", "otter", "the")).groupBy("term").agg(F.countDistinct("row_id").alias("df")), _POST + "SELECT term, count(DISTINCT row_id) AS df FROM post WHERE term IN ('kriging', 'otter', 'the') GROUP BY 1")
add("rank10_global_page", lambda s, d: S.rank(records(s, d), ["kriging"]).orderBy(F.desc(F.round("score", 6)), "row_id").limit(10).select("row_id"), RK + "SELECT row_id FROM rk ORDER BY round(" + " + ".join(_bm("kriging", f) for f in ("title", "abstract", "keywords_text")) + ", 6) DESC, row_id LIMIT 10")
add("rank11_clamp", lambda s, d: S.rank(records(s, d), ["the"]).select("row_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), "score")), 6).alias("score")), RK + "SELECT row_id, round(greatest(0.0, least(100.0, " + " + ".join(_bm("the", f) for f in ("title", "abstract", "keywords_text")) + ")), 6) AS score FROM rk")


def _formula(s, d):
    p = _post(s, d).where("field = 'title'")
    mean = p.groupBy("row_id").agg(F.first("len").alias("len")).agg(F.avg("len").alias("mean"))
    own = p.where("term = 'kriging'")
    one = {"df": own.agg(F.countDistinct("row_id")).scalar(), "mean": mean.scalar(), "n": records(s, d).agg(F.count(F.lit(1))).scalar()}
    return own.withColumns(one).select("row_id", F.round(S.bm25(F.col("tf"), F.col("df"), F.col("len"), F.col("mean"), F.col("n")), 6).alias("score"))


# text functions
add("str02_tokens", lambda s, d: records(s, d).select("row_id", F.array_join(T.tokens(F.col("title")), " ").alias("tokens")), R + f"SELECT row_id, array_to_string(regexp_extract_all(lower(title), {W}), ' ') AS tokens FROM r")
add("str03_accents", lambda s, d: records(s, d).select("row_id", T.unaccent(F.col("author")).alias("author")), R + f"SELECT row_id, translate(author, '{T.ACCENTED}', '{T.PLAIN}') AS author FROM r")
add("str04_camel", lambda s, d: records(s, d).select("row_id", T.camel_split(F.col("key")).alias("words")), R + "SELECT row_id, regexp_replace(regexp_replace(key, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g') AS words FROM r")
add("str06_ngrams", lambda s, d: records(s, d).select(F.explode(T.tokens(F.col("title"))).alias("w")).distinct().select(F.explode(T.ngrams(F.col("w"), 3)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")), R + f"SELECT gram, count(*) AS n FROM (SELECT CASE WHEN length(w) <= 3 THEN w ELSE substr(w, CAST(i AS INT), 3) END AS gram FROM (SELECT w, unnest(range(1, greatest(length(w) - 2, 1) + 1)) AS i FROM (SELECT DISTINCT unnest({TOK('title')}) AS w FROM r))) GROUP BY 1")
add("str08_keyword_analyzer", lambda s, d: records(s, d).select("row_id", F.lower(F.trim("journal")).alias("token")), R + "SELECT row_id, lower(trim(journal)) AS token FROM r")
add("str09_author_analyzer", lambda s, d: records(s, d).where("author != ''").select("row_id", F.explode(F.array_distinct(F.filter(F.transform(F.split("author", " and |,"), lambda x: F.lower(F.trim(F.regexp_replace(x, "[{}.]", "")))), lambda x: x != ""))).alias("part")), R + "SELECT DISTINCT row_id, part FROM (SELECT row_id, lower(trim(regexp_replace(unnest(regexp_split_to_array(author, ' and |,')), '[{}.]', '', 'g'))) AS part FROM r WHERE author <> '') WHERE part <> ''")
add("str14_doi", lambda s, d: records(s, d).select("row_id", T.normal_doi(F.col("doi")).alias("doi")), R + r"SELECT row_id, regexp_replace(lower(trim(doi)), '^(https?://doi\.org/|https?://dx\.doi\.org/|doi:)', '') AS doi FROM r")
add("str23_protect", lambda s, d: records(s, d).select("row_id", T.protect(F.col("title"), ["Editorial", "Preface"]).alias("title")), R + r"SELECT row_id, regexp_replace(regexp_replace(title, '(?i)\bEditorial\b', '{Editorial}', 'g'), '(?i)\bPreface\b', '{Preface}', 'g') AS title FROM r")
_ESC = "title"
for _a, _b in T.ESCAPES:
    _ESC = f"replace({_ESC}, '{_a}', '{_b}')"
add("str24_escape", lambda s, d: records(s, d).select("row_id", T.escape_tex(F.col("title")).alias("title")), R + f"SELECT row_id, {_ESC} AS title FROM r")
add("str25_unescape", lambda s, d: records(s, d).select("row_id", T.unescape_tex(F.concat("publisher", F.lit(r" \& \% \_"))).alias("publisher")), R + r"SELECT row_id, publisher || ' & % _' AS publisher FROM r")
add("str28_alpha_label", lambda s, d: _alpha(s, d), R + r"SELECT row_id, CASE WHEN len(l) = 1 THEN substr(l[1], 1, 3) WHEN len(l) <= 3 THEN array_to_string(list_transform(l, lambda x: x[1:1]), '') ELSE array_to_string(list_transform(l[1:3], lambda x: x[1:1]), '') || '+' END || lpad(CAST(year % 100 AS VARCHAR), 2, '0') AS label FROM (SELECT row_id, year, list_transform(list_filter(list_transform(regexp_split_to_array(author, '\s+and\s+'), lambda x: trim(x)), lambda x: x <> ''), lambda a: regexp_replace(CASE WHEN contains(a, ',') THEN trim(split_part(a, ',', 1)) ELSE regexp_extract(trim(a), '(\S+)$', 1) END, '[^A-Za-z]', '', 'g')) AS l FROM r WHERE trim(author) <> '' AND year IS NOT NULL)")


def _alpha(s, d):
    names = F.transform(T.people(F.col("author")), lambda a: F.regexp_replace(T.last_name(a), "[^A-Za-z]", ""))
    first = lambda xs: F.array_join(F.transform(xs, lambda x: F.substring(x, 1, 1)), "")
    r = records(s, d).where("trim(author) != '' and year is not null").withColumn("l", names)
    body = F.when(F.size("l") == 1, F.substring(F.element_at("l", 1), 1, 3)).when(F.size("l") <= 3, first(F.col("l"))).otherwise(F.concat(first(F.slice("l", 1, 3)), F.lit("+")))
    return r.select("row_id", F.concat(body, F.lpad((F.col("year") % 100).cast("string"), 2, "0")).alias("label"))


def _udf(name, column, run):
    """Queries over Arrow functions, which SQL cannot express; the functions are tested by themselves."""
    add(name, lambda s, d: records(s, d).where(F.col(column).isNotNull()).select("row_id", run().alias("value")))


def _u():
    from ..functions import udfs

    return udfs


_udf("str01_analyze", "title", lambda: F.array_join(_u().stems(F.filter(T.tokens(T.unaccent(T.camel_split(F.col("title")))), lambda w: F.length(w).between(2, 50) & ~w.isin(*S.STOPWORDS))), " "))
_udf("str05_stem", "title", lambda: F.array_join(_u().stems(T.tokens(F.col("title"))), " "))
def _person(name, run):
    """Queries over Arrow functions on each name of the author field."""
    add(name, lambda s, d: records(s, d).select("row_id", F.posexplode(T.people(F.col("author"))).alias("pos", "name")).select("row_id", "pos", run(F.col("name")).alias("value")))


_person("str18_parse_name", lambda c: _u().parse_name(c)["last"])
_person("str19_name_pattern", lambda c: _u().format_names("{ff }{vv }{ll}{, jj}")(c))
_person("str20_abbreviate", lambda c: _u().abbreviate(F.array_join(_u().parse_name(c)["first"], " ")))
_udf("str21_title_case", "title", lambda: _u().recase("t")(F.col("title")))
_udf("str22_purify", "title", lambda: _u().purify(F.col("title")))
_udf("hl02_snippets", "abstract", lambda: _u().marked(["kriging", "otter"], ("earlier accounts",))(F.col("abstract")))
_udf("srt08_plain_key", "title", lambda: F.concat_ws(" ", _u().purify(T.last_name(F.substring_index("author", " and ", 1))), F.coalesce(F.col("year").cast("string"), F.lit("9999")), _u().purify(F.col("title"))))
_udf("prj05_citation_key", "author", lambda: F.concat(F.lower(F.regexp_replace(T.unaccent(F.array_join(F.concat(_u().parse_name(F.substring_index("author", " and ", 1))["von"], _u().parse_name(F.substring_index("author", " and ", 1))["last"]), "")), "[^A-Za-z0-9]", "")), F.coalesce(F.col("year").cast("string"), F.lit(""))))
add("hl01_highlight", lambda s, d: records(s, d).select("row_id", S.highlight(F.col("title"), ["otter", "kriging"]).alias("title")), R + "SELECT row_id, regexp_replace(regexp_replace(title, '(?i)otter', '<mark>otter</mark>', 'g'), '(?i)kriging', '<mark>kriging</mark>', 'g') AS title FROM r")
add("hl10_snippet", lambda s, d: records(s, d).where(F.lower("abstract").contains("kriging")).select("row_id", F.substr("abstract", F.greatest(F.lit(1), F.instr(F.lower("abstract"), F.lit("kriging")) - 40), F.lit(100)).alias("piece")), R + "SELECT row_id, substr(abstract, greatest(1, strpos(lower(abstract), 'kriging') - 40), 100) AS piece FROM r WHERE contains(lower(abstract), 'kriging')")
add("srch39_expanded", lambda s, d: _expanded(s, d), RK + f"SELECT row_id FROM rk WHERE {_has('thesauri')} OR {_has('lexicons')}")


def _expanded(s, d):
    q = L.with_synonyms(L.parse("thesauri"), {"thesauri": ["lexicons"]})
    hit, _ = S.evaluate(q)
    return S.searchable(records(s, d)).where(hit).select("row_id")
