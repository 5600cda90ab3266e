"""Reading and writing bibliography formats.

Large files are read by line groups: a record ends at a fixed mark, so text is split by the
reader (``lineSep``) and every record is parsed by itself in Arrow batches; no file is held
by one task unless its format forces it (a JSON array).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "key string, type string, fields map<string,string>, error string"
#: Fixed tags of the RIS format.
RIS_TAGS = {
    "TI": "title", "T1": "title", "JO": "journal", "JF": "journal", "T2": "booktitle", "PB": "publisher", "VL": "volume", "IS": "number", "PY": "year", "Y1": "year", "DO": "doi", "UR": "url", "AB": "abstract", "N2": "abstract", "SN": "serial", "SP": "start", "EP": "end", "CY": "address", "ET": "edition", "T3": "series",
    "JA": "journal", "LA": "language", "BN": "isbn", "N1": "note", "M1": "note", "M3": "note",
}
RIS_PEOPLE = {"AU": "author", "A1": "author", "A2": "editor", "A3": "editor", "ED": "editor"}
RIS_KINDS = {"JOUR": "article", "BOOK": "book", "CHAP": "incollection", "CONF": "inproceedings", "CPAPER": "inproceedings", "THES": "phdthesis", "RPRT": "techreport", "ELEC": "online", "DATA": "dataset", "UNPB": "unpublished"}


def parse_bibtex(text: str) -> tuple[str | None, str | None, dict, str | None]:
    """(key, type, fields, error) of one entry; braces nest to any depth."""
    m = re.match(r"\s*@(\w+)\s*[{(]\s*([^,\s]*)\s*,", text)
    if not m:
        return None, None, {}, "no entry"
    kind, key, pos, out = m[1].lower(), m[2], m.end(), {}
    while True:
        m = re.compile(r"[\s,]*([\w-]+)\s*=\s*").match(text, pos)
        if not m:
            break
        name, pos, parts = m[1].lower(), m.end(), []
        while pos < len(text):
            c = text[pos]
            if c in "{\"":
                depth, k = 0, pos
                while k < len(text):
                    if text[k] == "\\":
                        k += 2
                        continue
                    depth += (text[k] == "{") - (text[k] == "}")
                    if depth == 0 and (c == "{" or (k > pos and text[k] == '"')):
                        break
                    k += 1
                else:
                    return key, kind, out, f"field {name} does not end"
                parts.append(text[pos + 1 : k])
                pos = k + 1
            else:
                w = re.compile(r"[^\s,#}]+").match(text, pos)
                if not w:
                    break
                parts.append(w[0])
                pos = w.end()
            more = re.compile(r"\s*#\s*").match(text, pos)
            if not more:
                break
            pos = more.end()
        out[name] = re.sub(r"\s+", " ", "".join(parts)).strip()
    return key, kind, out, None if key else "no key"


def expand_strings(value: str, table: dict[str, str]) -> str:
    """``@string`` names joined by ``#``, whatever their case."""
    low = {k.lower(): v for k, v in table.items()}
    return "".join(low.get(p.strip().lower(), p.strip().strip('"{}')) for p in value.split("#"))


def parse_string_definition(text: str) -> tuple[str, str] | None:
    m = re.match(r"\s*@string\s*[{(]\s*([\w-]+)\s*=\s*[\"{](.*)[\"}]\s*[})]\s*$", text, re.S | re.I)
    return (m[1], m[2]) if m else None


def parse_ris(text: str) -> tuple[str | None, str | None, dict, str | None]:
    out: dict = {}
    people: dict[str, list[str]] = {}
    words: list[str] = []
    kind = None
    for line in text.splitlines():
        m = re.match(r"^\s*([A-Z][A-Z0-9])\s{1,2}-\s?(.*)$", line)
        if not m:
            continue
        tag, v = m[1], m[2].strip()
        if tag == "TY":
            kind = RIS_KINDS.get(v, "misc")
        elif tag in RIS_PEOPLE and v:
            people.setdefault(RIS_PEOPLE[tag], []).append(v)
        elif tag == "KW" and v:
            words.append(v)
        elif tag in RIS_TAGS and v:
            out.setdefault(RIS_TAGS[tag], v)
    if kind is None:
        return None, None, {}, "no type"
    start, end, serial = out.pop("start", None), out.pop("end", None), out.pop("serial", None)
    if start:
        out["pages"] = f"{start}--{end}" if end else start
    if serial:
        out["isbn" if kind in ("book", "incollection") else "issn"] = serial
    year = re.search(r"\d{4}", out.pop("year", ""))
    if year:
        out["year"] = year[0]
    out.update({k: " and ".join(v) for k, v in people.items()})
    if words:
        out["keywords"] = ", ".join(words)
    first = people.get("author", [""])[0]
    last = first.split(",")[0] if "," in first else (first.split() or [""])[-1]
    word = next((w for w in re.findall(r"\w+", out.get("title", "")) if len(w) > 3), "")
    return "_".join(x for x in (re.sub(r"\W", "", last).lower(), out.get("year", ""), word.lower()) if x), kind, out, None


def _parsed(lines: DataFrame, parse) -> DataFrame:
    def run(batches):
        import pandas as pd

        for pdf in batches:
            got = [parse(t) for t in pdf["value"]]
            yield pd.DataFrame({"key": [g[0] for g in got], "type": [g[1] for g in got], "fields": [g[2] for g in got], "error": [g[3] for g in got]})

    return lines.mapInPandas(run, RECORD)


def read_bibtex(spark: SparkSession, path) -> DataFrame:
    """Entries of BibTeX files; the reader splits at line ends followed by ``@``, comments and string definitions are left out."""
    lines = spark.read.option("lineSep", "\n@").text(path).select(F.when(F.col("value").rlike(r"^\s*@"), F.col("value")).otherwise(F.concat(F.lit("@"), "value")).alias("value"))
    return _parsed(lines.where(r"value rlike '^\\s*@\\w+\\s*[{(]' and not value rlike '(?i)^\\s*@(comment|string|preamble)'"), parse_bibtex)


def read_ris(spark: SparkSession, path, encoding: str = "UTF-8") -> DataFrame:
    lines = spark.read.option("lineSep", "\nER  -").text(path).where("value rlike 'TY\\\\s{1,2}-'")
    return _parsed(lines, parse_ris)


def read_json(spark: SparkSession, path) -> DataFrame:
    """A list of entries, or an object with ``entries``; rows of unknown type carry an error."""
    raw = spark.read.option("multiLine", True).text(path, wholetext=True)
    body = F.coalesce(F.get_json_object("value", "$.entries"), F.col("value"))
    each = raw.select(F.explode(F.from_json(body, "array<map<string,string>>")).alias("fields"))
    kind = F.lower(F.coalesce(F.col("fields")["type"], F.lit("misc")))
    return each.select(F.col("fields")["key"].alias("key"), kind.alias("type"), "fields", F.when(F.col("fields")["key"].isNull(), "no key").alias("error"))


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 where they are that, with or without a mark at the beginning, else Latin-1."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), F.regexp_replace(text, "^\ufeff", "")).otherwise(F.decode(content, "ISO-8859-1"))


def definition(c: Column) -> Column:
    """(name, value) of an ``@string`` definition."""
    form = r"(?is)^\s*@string\s*[{(]\s*([\w-]+)\s*=\s*[\"{](.*)[\"}]\s*[})]\s*$"
    return F.when(c.rlike(form), F.struct(F.regexp_extract(c, form, 1).alias("name"), F.regexp_extract(c, form, 2).alias("value")))


def sniffed(name: Column, content: Column) -> Column:
    """Format by extension, else by the first letters of the content."""
    ext, head = F.lower(F.regexp_extract(name, r"\.(\w+)$", 1)), F.substring(content, 1, 1000)
    by_name = F.try_element_at(F.create_map(*[F.lit(x) for x in ("bib", "bibtex", "ris", "ris", "json", "json", "csv", "csv")]), ext)
    return F.coalesce(by_name, F.when(head.rlike(r"^\s*@\w+\s*\{"), "bibtex").when(head.rlike(r"^\s*TY\s{1,2}-"), "ris").when(head.rlike(r"^\s*[\[{]"), "json").otherwise("unknown"))


def sniff(name: str, head: str) -> str:
    """Format by extension, else by the first letters of the content."""
    for ext, kind in ((".bib", "bibtex"), (".ris", "ris"), (".json", "json"), (".csv", "csv")):
        if name.lower().endswith(ext):
            return kind
    head = head[:1000].lstrip()
    return "bibtex" if re.match(r"@\w+\s*\{", head) else "ris" if re.match(r"TY\s{1,2}-", head) else "json" if head[:1] in "[{" else "unknown"


def resolve_keys(df: DataFrame, strategy: str, order: str = "ord") -> DataFrame:
    """Repeated keys within an import: skip keeps the first, overwrite the last, rename numbers them."""
    from pyspark.sql import Window

    if strategy == "skip":
        return df.join(df.groupBy("key").agg(F.min(order).alias(order)).select(order), order, "left_semi")
    if strategy == "overwrite":
        return df.join(df.groupBy("key").agg(F.max(order).alias(order)).select(order), order, "left_semi")
    n = F.row_number().over(Window.partitionBy("key").orderBy(order))
    return df.withColumn("n", n).withColumn("key", F.concat("key", F.when(F.col("n") > 1, F.concat(F.lit("_"), (F.col("n") - 1).cast("string"))).otherwise(""))).drop("n")


def closes_braces(fields: list[str]) -> Column:
    """Whether all values close the braces they open; a value that does not would swallow the fields after it."""
    step = lambda at, c: F.when((at < 0) | ((c == "}") & (at == 0)), -1).otherwise(at + F.when(c == "{", 1).when(c == "}", -1).otherwise(0))
    ends = lambda n: F.aggregate(F.split(F.regexp_replace(F.coalesce(F.col(n).cast("string"), F.lit("")), "[^{}]", ""), ""), F.lit(0), step)
    return F.array_max(F.transform(F.array(*[ends(n) for n in fields]), lambda x: F.abs(x))) == 0


def write_text(df: DataFrame, column, path: str) -> None:
    """One formatted record after another, in as many files as there are partitions."""
    df.select(column.alias("value")).write.option("lineSep", "\n\n").text(path)


def write_csv(df: DataFrame, path: str, fields: list[str], sep: str = ",", quote: str = '"') -> None:
    kinds = dict(df.dtypes)
    flat = [F.array_join(c, "; ").alias(c) if kinds[c].startswith("array") else F.col(c) for c in fields]
    df.select(*flat).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("sep", sep).option("quote", quote).csv(path)


def verify_copy(source: DataFrame, target: DataFrame, key: str = "key") -> DataFrame:
    """(missing, extra, changed) counts between two stores, by one full join of row digests."""
    plain = lambda c, kind: F.array_sort(F.map_entries(c)).cast("string") if kind.startswith("map") else F.col(c).cast("string")
    digest = lambda df, n: df.select(key, F.xxhash64(*[plain(c, dict(df.dtypes)[c]) for c in sorted(df.columns)]).alias(n))
    j = digest(source, "a").join(digest(target, "b"), key, "full")
    return j.agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"), F.count_if(F.col("a") != F.col("b")).alias("changed"))
