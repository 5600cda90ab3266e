"""Record validation, duplicate groups and merge policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, normal_doi, title_author_year

#: Fixed table of required fields by type; ``a|b`` asks for either.
REQUIRED = {
    "article": ("author", "title", "journal", "year"), "book": ("author|editor", "title", "publisher", "year"), "booklet": ("title",),
    "inbook": ("author|editor", "title", "chapter|pages", "publisher", "year"), "incollection": ("author", "title", "booktitle", "publisher", "year"),
    "inproceedings": ("author", "title", "booktitle", "year"), "conference": ("author", "title", "booktitle", "year"), "manual": ("title",),
    "mastersthesis": ("author", "title", "school", "year"), "phdthesis": ("author", "title", "school", "year"), "proceedings": ("title", "year"),
    "techreport": ("author", "title", "institution", "year"), "unpublished": ("author", "title", "note"), "online": ("author|editor", "title", "url", "year"),
    "dataset": ("author", "title", "publisher|howpublished", "year"),
}
#: Fixed month vocabulary.
MONTHS = (
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "11", "12",
    "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december",
)
#: Fixed page forms.
PAGE_FORMS = r"^(\d+|\d+--?\d+|[A-Z]\d+--?[A-Z]\d+|\d+(,\s*\d+)+|\d+--?\d+(,\s*\d+--?\d+)*)$"
KEY_FORM = r"^[a-zA-Z0-9][a-zA-Z0-9_\-:]*$"
DOI_FORM = r"^10\.\d{4,}/\S+$"
BOOKISH = ("book", "inbook", "incollection", "proceedings")


def issue(field: str, rule: str, severity: str) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))


def isbn10_ok(c: Column) -> Column:
    digit = lambda i: F.when(F.substring(c, i, 1) == "X", F.lit(10)).otherwise(F.substring(c, i, 1).try_cast("int"))
    total = sum((digit(i) * (11 - i) for i in range(1, 11)), F.lit(0))
    return c.rlike(r"^\d{9}[\dX]$") & (total % 11 == 0)


def isbn13_ok(c: Column) -> Column:
    total = sum((F.substring(c, i, 1).try_cast("int") * (1 if i % 2 else 3) for i in range(1, 14)), F.lit(0))
    return c.rlike(r"^\d{13}$") & (total % 10 == 0)


def issn_ok(c: Column) -> Column:
    rest = sum((F.substring(c, i, 1).try_cast("int") * (9 - i) for i in range(1, 8)), F.lit(0)) % 11
    check = F.when(rest == 0, "0").when(rest == 1, "X").otherwise((11 - rest).cast("string"))
    return c.rlike(r"^\d{7}[\dX]$") & (F.substring(c, 8, 1) == check)


def _names(name: str) -> list[Column]:
    c = F.col(name)
    blank = c.isNotNull() & (F.trim(c) == "")
    text = c.isNotNull() & ~blank
    return [
        F.when(blank, issue(name, "empty", "warning")), F.when(text & F.trim(c).endswith(","), issue(name, "ends with comma", "warning")),
        F.when(text & c.contains(" and and "), issue(name, "empty name", "warning")), F.when(text & F.lower(c).contains("et al."), issue(name, "et al.", "info")),
    ]


def rules(columns: set[str], ref_year: int) -> list[Column]:
    """All rules as nullable issue structs; a rule on a column the records lack is left out."""
    has = lambda f: filled(F.col(f)).isNotNull() if f != "year" else F.col("year").isNotNull() & (F.col("year") != 0)
    known = lambda spec: [f for f in spec.split("|") if f in columns]
    out = [
        F.when(filled(F.col("key")).isNull(), issue("key", "empty", "error")), F.when(filled(F.col("key")).isNotNull() & ~F.col("key").rlike(KEY_FORM), issue("key", "characters", "error")),
        F.when(F.col("key").rlike(KEY_FORM) & (F.length("key") > 250), issue("key", "too long", "warning")),
    ]
    for spec in sorted({s for specs in REQUIRED.values() for s in specs}):
        types = [t for t, specs in REQUIRED.items() if spec in specs]
        present = F.lit(False)
        for f in known(spec):
            present = present | has(f)
        out.append(F.when(F.col("type").isin(types) & ~present, issue(spec, "required", "error")))
    year, pages, doi, url = F.col("year"), filled(F.col("pages")), filled(F.col("doi")), filled(F.col("url"))
    out += [F.when(year < 1000, issue("year", "far past", "warning")), F.when(year > ref_year + 5, issue("year", "far future", "warning"))]
    out += [F.when(~F.lower(filled(F.col("month"))).isin(*MONTHS), issue("month", "format", "warning"))]
    out += [F.when(~pages.rlike(PAGE_FORMS), issue("pages", "format", "warning")), F.when(pages.rlike(PAGE_FORMS) & pages.contains("-") & ~pages.contains("--"), issue("pages", "single dash", "info"))]
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(doi, "^https://doi\\.org/", ""), "^http://doi\\.org/", ""), "^doi:", "")
    out += [F.when(~bare.rlike(DOI_FORM), issue("doi", "format", "warning"))]
    good_url = url.rlike(r"^(?i)https?://([^/?#:]*\.[^/?#:]*|localhost|\d+)(:[^/?#]*)?([/?#]|$)")
    out += [F.when(~good_url, issue("url", "format", "warning")), F.when(good_url & F.lower(url).startswith("http:"), issue("url", "not secure", "warning"))]
    out += _names("author") + _names("editor")
    out += [F.when(F.length("abstract") > 5000, issue("abstract", "too long", "warning"))]
    no = lambda f: filled(F.col(f)).isNull()
    out += [F.when((~no("volume") | ~no("number")) & no("journal"), issue("", "volume without journal", "warning")), F.when(pages.isNotNull() & no("journal") & no("booktitle"), issue("", "pages without container", "info"))]
    if "isbn" in columns:
        isbn = F.upper(F.regexp_replace(filled(F.col("isbn")), "[- ]", ""))
        ok = F.when(F.length(isbn) == 10, isbn10_ok(isbn)).when(F.length(isbn) == 13, isbn13_ok(isbn)).otherwise(F.lit(False))
        out += [F.when(isbn.isNotNull() & ~ok, issue("isbn", "check digit", "warning")), F.when(isbn.isNotNull() & ~F.col("type").isin(*BOOKISH), issue("isbn", "unusual type", "info"))]
    if "issn" in columns:
        issn = F.upper(F.replace(filled(F.col("issn")), F.lit("-"), F.lit("")))
        out += [F.when(issn.isNotNull() & ~issn_ok(issn), issue("issn", "check digit", "warning")), F.when(issn.isNotNull() & ~F.col("type").isin("article", "proceedings"), issue("issn", "unusual type", "info"))]
    return out


def issues(df: DataFrame, ref_year: int = 2024) -> DataFrame:
    """One row per issue: (row_id, key, field, rule, severity); one narrow pass over the records."""
    found = F.array_compact(F.array(*rules(set(df.columns), ref_year)))
    return df.select("row_id", "key", F.explode(found).alias("x")).select("row_id", "key", "x.*")


def with_severity(df: DataFrame, ref_year: int = 2024) -> DataFrame:
    """Counts of issues by severity for each record."""
    found = F.array_compact(F.array(*rules(set(df.columns), ref_year)))
    n = lambda s: F.size(F.filter("found", lambda x: x["severity"] == s)).cast("bigint").alias(s + "s")
    return df.select("row_id", "key", found.alias("found")).select("row_id", "key", n("error"), n("warning"), n("info"))


def metrics(df: DataFrame, ref_year: int = 2024) -> DataFrame:
    s = with_severity(df, ref_year)
    m = s.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("errors") == 0).alias("valid"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"))
    return m.withColumn("score", F.when(F.col("total") > 0, F.bround(F.col("valid") / F.col("total") * 100, 2)).otherwise(100.0))


def duplicate_keys(df: DataFrame) -> DataFrame:
    """The two blocking keys of each record: normalised doi, and title|authors|year."""
    return df.select("row_id", "key", F.nullif(normal_doi(F.coalesce("doi", F.lit(""))), F.lit("")).alias("doi_key"), title_author_year(F.col("title"), F.col("author"), F.col("year")).alias("tay_key"))


def duplicate_groups(df: DataFrame) -> DataFrame:
    """(first, n, confidence): groups by doi, and by title, authors and year; a set of records found both ways is one group.

    Members are summarised by count, minimum and an order-free hash, so no group is collected.
    """
    k = duplicate_keys(df)
    summary = [F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"), F.bit_xor(F.xxhash64("row_id")).alias("members")]
    doi = k.where("doi_key is not null").groupBy("doi_key").agg(*summary, F.countDistinct("tay_key").alias("other")).where("n > 1").select("n", "first", "members", F.lit("doi").alias("by"), "other")
    tay = k.groupBy("tay_key").agg(*summary, F.countDistinct("doi_key").alias("other"), F.count("doi_key").alias("with_doi")).where("n > 1").select("n", "first", "members", F.lit("tay").alias("by"), F.when(F.col("with_doi") < F.col("n"), F.lit(2)).otherwise(F.col("other")).alias("other"))
    score = F.max(F.when(F.col("by") == "doi", F.when(F.col("other") == 1, 1.0).otherwise(0.95)).otherwise(F.when(F.col("other") == 1, 0.9).otherwise(0.8)))
    return doi.unionByName(tay).groupBy("n", "first", "members").agg(F.round(score, 2).alias("confidence")).select("first", "n", "confidence")


def merge_groups(df: DataFrame, group: str) -> DataFrame:
    """One merged record for each group by the field rules: first doi and year, longest texts, united lists, span of pages.

    Ties go to the record added first; all rules are aggregates, so a group of any size is folded on the map side.
    """
    order = F.struct("added", "row_id")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    longest = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(-F.length(c), "added", "row_id"))).alias(c)
    numbers = F.filter(F.transform(F.split(F.regexp_replace("pages", "--|,", "-"), "-"), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())
    n_fields = sum((filled(F.col(c)).isNotNull().cast("int") for c in ("title", "author", "journal", "doi", "abstract", "pages", "url", "publisher")), F.lit(0))
    out = df.withColumn("nums", numbers).groupBy(group).agg(
        F.min_by("key", F.struct(-n_fields, "added", "row_id")).alias("key"), first("doi"), first("year"), longest("title"), longest("journal"), longest("publisher"), longest("abstract"),
        F.min(F.array_min("nums")).alias("lo"), F.max(F.array_max("nums")).alias("hi"), longest("pages"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("keywords")))).alias("keywords"),
        F.min("added").alias("added"), F.max("modified").alias("modified"), F.count(F.lit(1)).alias("n"),
    )
    pages = F.when(F.col("lo").isNull(), F.col("pages")).when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat(F.col("lo").cast("string"), F.lit("--"), F.col("hi").cast("string")))
    return out.withColumn("pages", pages).drop("lo", "hi")


def smart_authors(df: DataFrame, group: str) -> DataFrame:
    """Authors of a group joined: one name for each last name, the longest, in order of first sight."""
    from ..functions.text import last_name

    a = df.where("author != ''").select(group, "added", "row_id", F.posexplode(F.transform(F.split("author", " and "), lambda x: F.trim(x))).alias("pos", "name")).where("name != ''")
    seen = F.struct("added", "row_id", "pos")
    per = a.groupBy(group, F.lower(last_name(F.col("name"))).alias("last")).agg(F.min(seen).alias("seen"), F.min_by("name", F.struct(-F.length("name"), "added", "row_id", "pos")).alias("name"))
    return per.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seen", "name"))), lambda x: x["name"]), " and ").alias("author"))


def conflict(new: DataFrame, old: DataFrame, strategy: str) -> DataFrame:
    """Outcome for each new record that meets an old one of the same key."""
    met = new.select("key", F.col("title").alias("nt"), F.col("doi").alias("nd")).join(old.select("key", F.col("title").alias("ot"), F.col("doi").alias("od"), F.lit(True).alias("met")), "key", "left")
    asked = F.when(F.col("nd") == F.col("od"), "skip").when(F.lower("nt") == F.lower("ot"), "merge").otherwise("rename")
    outcome = {"skip": F.lit("skip"), "replace": F.lit("replace"), "rename": F.lit("rename"), "merge": F.lit("merge"), "fail": F.lit("fail"), "ask": asked}[strategy]
    return met.select("key", F.when(F.col("met"), outcome).otherwise("create").alias("outcome"))
