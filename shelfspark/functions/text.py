"""Text expressions that stay in the JVM, and the Arrow functions for what expressions cannot say."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
#: Prefixes of a doi that are dropped, first match only.
DOI_PREFIXES = r"^(https?://doi\.org/|https?://dx\.doi\.org/|doi:)"
WORD = r"[\p{L}\p{N}_]+"
#: Fixed words dropped from titles when they are compared.
ARTICLES = r"\b(the|a|an)\b"
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v", "phd", "md", "Jr", "Sr", "II", "III", "IV", "V", "PhD", "MD")
#: Fixed abbreviations of venues.
VENUES = {
    "neural information processing systems": "neurips", "neurips": "neurips", "international conference on machine learning": "icml", "icml": "icml",
    "computer vision and pattern recognition": "cvpr", "cvpr": "cvpr", "nature": "nature", "science": "science", "proceedings of the national academy of sciences": "pnas", "pnas": "pnas",
}


def filled(c: Column) -> Column:
    """Null where null or empty; blanks are kept as they are."""
    return F.nullif(c, F.lit(""))


def unaccent(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def term_count(c: Column, term: str) -> Column:
    """Non-overlapping occurrences of a substring, ignoring case."""
    low = F.lower(c)
    return F.coalesce((F.length(low) - F.length(F.replace(low, F.lit(term.lower()), F.lit("")))) / F.lit(len(term)), F.lit(0)).cast("bigint")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))


def people(c: Column) -> Column:
    """Names of an author or editor field; ``\\&`` and blanks around are kept out of the way."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\s+and\s+"), lambda x: F.trim(x)), lambda x: x != "")


def last_name(name: Column) -> Column:
    """Before the comma, else the last word."""
    return F.when(name.contains(","), F.trim(F.substring_index(name, ",", 1))).otherwise(F.element_at(F.split(F.trim(name), r"\s+"), -1))


def normal_doi(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(c)), DOI_PREFIXES, "")


def normal_text(c: Column) -> Column:
    """Lower case, no TeX commands, braces, accents, articles or punctuation, single blanks."""
    x = F.lower(F.coalesce(c, F.lit("")))
    x = F.regexp_replace(x, r"\{?\\(la)?tex\}?", " latex ")
    x = F.regexp_replace(F.regexp_replace(x, r"\\[a-z]+\*?(\s*\{\})?", " "), r"[{}]", "")
    x = F.regexp_replace(unaccent(x), ARTICLES, "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def normal_people(c: Column) -> Column:
    """Last names in order of the alphabet; suffixes and one-letter words are passed over."""

    def surname(a: Column) -> Column:
        ws = F.split(a, r"\s+")
        good = F.filter(ws, lambda w: ~w.isin(*SUFFIXES) & (F.length(w) > 1))
        return F.when(a.contains(","), F.trim(F.substring_index(a, ",", 1))).otherwise(F.coalesce(F.try_element_at(good, F.lit(-1)), F.element_at(ws, -1)))

    return F.array_join(F.array_sort(F.filter(F.transform(people(c), lambda a: normal_text(surname(a))), lambda x: x != "")), " ")


def title_author_year(title: Column, author: Column, year: Column) -> Column:
    return F.concat_ws("|", normal_text(title), normal_people(author), F.coalesce(year.cast("string"), F.lit("None")))


def venue_abbreviation(c: Column) -> Column:
    low = F.lower(F.trim(c))
    table = F.create_map(*[F.lit(x) for kv in VENUES.items() for x in kv])
    ws = F.split(low, r"\s+")
    initials = F.substring(F.array_join(F.transform(F.filter(ws, lambda w: F.length(w) > 2), lambda w: F.substring(w, 1, 1)), ""), 1, 6)
    return F.coalesce(F.try_element_at(table, low), F.when(F.size(ws) > 1, initials).otherwise(F.substring(low, 1, 6)))


def sanitize_key(c: Column, most: int = 50) -> Column:
    x = F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}_\-:]", "_"), 1, most)
    return F.regexp_replace(F.regexp_replace(x, "_+", "_"), "^_+|_+$", "")


def camel_split(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"([a-z])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")


def ngrams(word: Column, n: int) -> Column:
    """Character n-grams; a word not longer than n stands for itself."""
    return F.when(F.length(word) <= n, F.array(word)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(n))))


#: Fixed order of escapes, the backslash first.
ESCAPES = (("\\", "\\textbackslash{}"), ("$", "\\$"), ("&", "\\&"), ("#", "\\#"), ("_", "\\_"), ("%", "\\%"), ("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}"))


def escape_tex(c: Column) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape_tex(c: Column) -> Column:
    for raw, safe in ESCAPES[1:] + ESCAPES[:1]:
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def protect(c: Column, words: list[str]) -> Column:
    """Whole words in braces, whatever their case."""
    for w in words:
        c = F.regexp_replace(c, rf"(?i)\b{w}\b", "{" + w + "}")
    return c


def strip_accents(s):
    """General accent stripping, for use in Arrow functions."""
    return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
