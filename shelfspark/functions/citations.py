"""Citations as expressions: every style is one Column over the record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import filled

f = lambda name: filled(F.col(name)) if name != "year" else F.when(F.col("year") != 0, F.col("year").cast("string"))


def _dash(c: Column) -> Column:
    return F.replace(c, F.lit("--"), F.lit("-"))


def _and(*parts) -> Column:
    """Concatenation that is null where a part is null."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _names(author: Column) -> Column:
    return F.transform(F.split(author, " and "), lambda a: F.trim(a))


def _initials(first: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(F.trim(first), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))), " ")


def _inverted(a: Column) -> Column:
    """``Last, F. M.`` from either order."""
    ws = F.split(a, r"\s+")
    head = F.trim(F.substring_index(a, ",", 1))
    tail = F.trim(F.regexp_replace(a, "^[^,]*,", ""))
    plain = F.when(F.size(ws) > 1, F.concat(F.element_at(ws, -1), F.lit(", "), _initials(F.array_join(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(1))), " ")))).otherwise(a)
    return F.when(a.contains(","), F.when(tail != "", F.concat(head, F.lit(", "), _initials(tail))).otherwise(head)).otherwise(plain)


def apa_names(author: Column) -> Column:
    xs = F.transform(_names(author), _inverted)
    n = F.size(xs)
    return F.when(n == 1, F.element_at(xs, 1)).otherwise(F.concat(F.array_join(F.slice(xs, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", & "), F.element_at(xs, -1)))


def few_names(author: Column, most: int) -> Column:
    """First name and, beyond ``most`` people, et al."""
    xs = _names(author)
    return F.when(F.size(xs) > most, F.concat(F.element_at(xs, 1), F.lit(", et al"))).otherwise(F.array_join(xs, ", and "))


def _stop(c: Column) -> Column:
    return F.when(c.endswith("."), c).otherwise(F.concat(c, F.lit(".")))


def _book() -> Column:
    return F.col("type") == "book"


def apa() -> Column:
    title = F.when(_book(), _and("*", f("title"), "*.")).otherwise(_and(f("title"), "."))
    volume = F.concat(f("volume"), F.coalesce(_and("(", f("number"), ")"), F.lit("")))
    numbers = F.nullif(F.concat_ws(", ", volume, _dash(f("pages"))), F.lit(""))
    kind = F.when(F.col("type") == "phdthesis", "Doctoral dissertation").when(F.col("type") == "mastersthesis", "Master's thesis")
    source = (
        F.when(F.col("type") == "article", F.nullif(F.concat_ws(" ", _and("*", f("journal"), "*."), _and(numbers, ".")), F.lit("")))
        .when(_book(), _and(f("publisher"), "."))
        .when(F.col("type") == "inproceedings", F.nullif(F.concat_ws(" ", _and("In *", f("booktitle"), "*."), _and("(pp. ", _dash(f("pages")), ").")), F.lit("")))
        .when(kind.isNotNull(), F.concat(F.lit("["), F.concat_ws(", ", kind, f("school")), F.lit("].")))
    )
    link = F.coalesce(_and("https://doi.org/", f("doi")), f("url"))
    return _stop(F.concat_ws(" ", apa_names(f("author")), _and("(", f("year"), ")."), title, source, link))


def mla() -> Column:
    title = F.when(_book(), _and("*", f("title"), "*")).otherwise(_and('"', f("title"), '"'))
    volume = F.concat(_and("vol. ", f("volume")), F.coalesce(_and(", no. ", f("number")), F.lit("")))
    pages = _and("pp. ", _dash(f("pages")))
    source = (
        F.when(F.col("type") == "article", F.concat_ws(". ", _and("*", f("journal"), "*"), volume, f("year"), pages))
        .when(_book(), F.concat(f("publisher"), F.coalesce(_and(", ", f("year")), F.lit(""))))
        .when(F.col("type") == "inproceedings", F.concat_ws(". ", _and("*", f("booktitle"), "*"), f("publisher"), f("year"), pages))
    )
    return _stop(F.concat_ws(". ", few_names(f("author"), 2), title, F.nullif(source, F.lit(""))))


def chicago() -> Column:
    title = F.when(_book(), _and("*", f("title"), "*")).otherwise(_and('"', f("title"), '."'))
    volume = F.concat(f("volume"), F.coalesce(_and(", no. ", f("number")), F.lit("")), F.coalesce(_and(" (", f("year"), ")"), F.lit("")))
    source = F.when(F.col("type") == "article", F.concat_ws(". ", _and("*", f("journal"), "*"), volume, _dash(f("pages")))).when(_book(), F.concat_ws(", ", f("publisher"), f("year")))
    return _stop(F.concat_ws(". ", few_names(f("author"), 3), title, F.nullif(source, F.lit(""))))


def ieee() -> Column:
    return _stop(F.concat_ws(", ", few_names(f("author"), 3), _and('"', f("title"), '"'), f("journal"), _and("vol. ", f("volume")), _and("no. ", f("number")), _and("pp. ", _dash(f("pages"))), f("year")))


FIELDS = ("author", "title", "journal", "booktitle", "publisher", "school", "institution", "volume", "number", "pages", "year", "month", "doi", "url", "abstract")


def bibtex(escape=None) -> Column:
    val = lambda n: escape(f(n)) if escape and n not in ("url", "doi", "year", "month") else f(n)
    lines = [_and(f"  {n} = {{", val(n), "},") if n != "month" else _and("  month = ", f(n), ",") for n in FIELDS]
    return F.concat_ws("\n", _and("@", F.col("type"), "{", F.col("key"), ","), *lines, F.lit("}"))


RIS_TYPES = {"article": "JOUR", "book": "BOOK", "inproceedings": "CPAPER", "incollection": "CHAP", "inbook": "CHAP", "phdthesis": "THES", "mastersthesis": "THES", "techreport": "RPRT", "online": "ELEC", "dataset": "DATA"}


def ris() -> Column:
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RIS_TYPES.items() for x in kv]), F.col("type")), F.lit("GEN"))
    people = F.nullif(F.array_join(F.transform(_names(f("author")), lambda a: F.concat(F.lit("AU  - "), a)), "\n"), F.lit(""))
    span = F.split(F.regexp_replace(f("pages"), "-+", "-"), "-")
    pages = F.concat_ws("\n", _and("SP  - ", F.trim(F.element_at(span, 1))), F.when(F.size(span) > 1, _and("EP  - ", F.trim(F.element_at(span, 2)))))
    return F.concat_ws("\n", _and("TY  - ", kind), people, _and("TI  - ", f("title")), _and("JO  - ", f("journal")), _and("PB  - ", f("publisher")), _and("VL  - ", f("volume")), _and("IS  - ", f("number")), F.nullif(pages, F.lit("")), _and("PY  - ", f("year")), _and("DO  - ", f("doi")), _and("UR  - ", f("url")), F.lit("ER  - "))


def markdown() -> Column:
    return F.concat_ws("\n", _and("### ", f("title")), _and("- **Authors:** ", f("author")), _and("- **Year:** ", f("year")), _and("- **Journal:** ", f("journal")), _and("- **DOI:** ", f("doi")))


def markdown_row() -> Column:
    cell = lambda n: F.coalesce(F.replace(f(n), F.lit("|"), F.lit("\\|")), F.lit(""))
    return F.concat(F.lit("| "), F.concat_ws(" | ", F.col("key"), cell("type"), cell("author"), cell("title"), cell("year")), F.lit(" |"))


def yaml() -> Column:
    q = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.concat_ws("\n", _and("- key: ", q(F.col("key"))), *[_and(f"  {n}: ", q(f(n)) if n != "year" else f(n)) for n in FIELDS])
