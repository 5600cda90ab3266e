"""Text search: queries compiled to plans over records or over a postings table, ranking, suggestions.

Ranking and totals are taken over all matches before a page is cut.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import querylang as L

#: Fixed boosts of the term score; other fields 0.8.
BOOSTS = {"title": 2.0, "author": 1.5, "keywords_text": 1.2, "abstract": 1.0, "journal": 1.0, "note": 0.5}
#: Fixed weights of the ranker.
WEIGHTS = {"title": 2.0, "abstract": 1.0, "keywords_text": 1.5, "author": 1.2, "journal": 0.8, "booktitle": 0.8, "note": 0.5}
#: Fixed mean lengths the ranker assumes.
LENGTHS = {"title": 10, "abstract": 100, "keywords_text": 5}
STOPWORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at")
FIELDS = ["title", "author", "abstract", "journal", "keywords_text"]


def searchable(df: DataFrame) -> DataFrame:
    return df.withColumn("keywords_text", F.array_join("keywords", " "))


def postings(df: DataFrame, fields: list[str] = FIELDS, key: str = "row_id") -> DataFrame:
    """(term, field, row_id, tf, len): one narrow expansion and one partial aggregation."""
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), T.tokens(F.col(f)).alias("ts")) for f in fields])).alias("x")).select(key, "x.*")
    return long.select(key, "field", F.size("ts").alias("len"), F.explode("ts").alias("term")).groupBy("term", "field", key).agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))


def has_word(term: str, fields: list[str]) -> Column:
    """Whether the word stands in any field, as a whole token."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.array_contains(T.tokens(F.col(f)), term.lower()), F.lit(False)) for f in fields])


def term_score(term: str, fields: list[str]) -> Column:
    """Sum over fields of boost * tf / (tf + 1.2 * (0.25 + 0.75 * length / 100))."""

    def one(f):
        tf = T.term_count(F.col(f), term)
        return F.when(tf > 0, F.lit(BOOSTS.get(f, 0.8)) * tf / (tf + 1.2 * (0.25 + 0.75 * T.word_count(F.col(f)) / 100.0))).otherwise(0.0)

    return reduce(lambda a, b: a + b, [one(f) for f in fields])


def evaluate(q, fields: list[str] = FIELDS, strict: bool = False) -> tuple[Column, Column]:
    """(matches, score) of a parsed query; with ``strict`` a field query matches in its field only."""
    no, zero = F.lit(False), F.lit(0.0)
    if isinstance(q, L.Term):
        return (has_word(q.text, fields if strict else FIELDS), term_score(q.text, fields) * q.boost) if q.text else (no, zero)
    if isinstance(q, L.Phrase):
        hit = [F.coalesce(F.lower(F.col(f)).contains(q.text.lower()), no) for f in fields]
        return reduce(lambda a, b: a | b, hit), reduce(lambda a, b: a + b, [F.when(h, BOOSTS.get(f, 0.8)).otherwise(0.0) for f, h in zip(fields, hit)]) * q.boost
    if isinstance(q, L.Wildcard):
        p = "(?i)" + q.pattern.replace("*", ".*").replace("?", ".")
        hit = [F.coalesce(F.col(f).rlike(p), no) for f in fields]
        return reduce(lambda a, b: a | b, hit), reduce(lambda a, b: a + b, [F.when(h, BOOSTS.get(f, 0.8)).otherwise(0.0) for f, h in zip(fields, hit)]) * q.boost
    if isinstance(q, L.Fuzzy):
        near = lambda f: F.exists(T.tokens(F.coalesce(F.col(f), F.lit(""))), lambda t: F.levenshtein(t, F.lit(q.text.lower()), q.edits) >= 0)
        hit = [near(f) for f in fields]
        return reduce(lambda a, b: a | b, hit), reduce(lambda a, b: a + b, [F.when(h, BOOSTS.get(f, 0.8)).otherwise(0.0) for f, h in zip(fields, hit)]) * q.boost
    if isinstance(q, L.Range):
        c = F.col(q.field).cast("string").try_cast("double")
        ok = c.isNotNull()
        for v, inside, up in ((q.low, q.low_in, True), (q.high, q.high_in, False)):
            if isinstance(v, (int, float)):
                ok = ok & ((c >= v if inside else c > v) if up else (c <= v if inside else c < v))
        return F.coalesce(ok, no), F.when(ok, 1.0 * q.boost).otherwise(0.0)
    if isinstance(q, L.Fielded):
        name = "keywords_text" if q.field == "keywords" else q.field
        return evaluate(q.query, [name], strict)
    parts = [evaluate(p, fields, strict) for p in q.parts]
    if q.op == "NOT":
        return (~parts[0][0], F.lit(1.0)) if len(parts) == 1 else (parts[0][0] & ~parts[1][0], parts[0][1])
    both = reduce((lambda a, b: a & b) if q.op == "AND" else (lambda a, b: a | b), [m for m, _ in parts])
    return both, reduce(lambda a, b: a + b, [F.when(m, s).otherwise(0.0) for m, s in parts])


def search(df: DataFrame, text: str, strict: bool = False) -> DataFrame:
    """All matches with their score."""
    hit, score = evaluate(L.parse(text), strict=strict)
    return searchable(df).where(hit).withColumn("score", score)


def bm25(tf: Column, df: Column, length: Column, mean: Column, total: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    up, down = total - df + 0.5, df + 0.5
    idf = F.when((up <= 0) | (down <= 0), 0.0).otherwise(F.log(F.greatest(up, F.lit(1e-9)) / F.greatest(down, F.lit(1e-9))))
    den = tf + k1 * (1 - b + b * length / F.when(mean <= 0, 1.0).otherwise(mean))
    return idf * F.when(den <= 0, 0.0).otherwise(tf * (k1 + 1) / den)


def tfidf(tf: Column, df: Column, total: Column, length: Column) -> Column:
    return F.when(length > 0, tf / length).otherwise(0.0) * F.when(df > 0, F.log(total / F.when(df > 0, df))).otherwise(0.0)


def guessed_df(term: str, total: Column) -> Column:
    share = 0.5 if term in STOPWORDS else 0.2 if len(term) <= 3 else 0.1
    few = (total - 1) if term in STOPWORDS else F.lit(1)
    return F.greatest(F.lit(1), F.when(total < 10, few).otherwise(F.floor(total * share)))


def rank(df: DataFrame, words: list[str], how: str = "bm25") -> DataFrame:
    """Ranks all rows by field-weighted bm25 or tf-idf of the words, with the frequencies the heuristic assumes."""
    total = df.agg(F.count(F.lit(1)).alias("n_docs"))
    out = searchable(df).withColumn("n_docs", total.scalar())
    score = F.lit(0.0)
    for w in words:
        w = w.lower()
        dfreq = guessed_df(w, F.col("n_docs"))
        for f in ("title", "abstract", "keywords_text") if how == "bm25" else ("title", "abstract"):
            tf, length = T.term_count(F.col(f), w), T.word_count(F.col(f))
            one = bm25(tf, dfreq, length, F.lit(float(LENGTHS[f])), F.col("n_docs")) if how == "bm25" else tfidf(tf, dfreq, F.col("n_docs"), length)
            score = score + F.when(tf > 0, one * WEIGHTS[f]).otherwise(0.0)
    return out.withColumn("score", score)


def recency(score: Column, added: Column, ref: Column, decay: float = 0.1) -> Column:
    return score * F.pow(F.lit(1 - decay), F.datediff(ref, added) / 365.25)


def simple_index(post: DataFrame, text: str, field: str | None = None) -> DataFrame:
    """OR of tokens; the score is the sum of frequencies over the number of query tokens."""
    ts = [t.lower() for t in re.findall(r"\w+", text)]
    p = post.where(F.col("term").isin(ts)) if field is None else post.where(F.col("term").isin(ts) & (F.col("field") == field))
    return p.groupBy("row_id").agg((F.sum("tf") / max(1, len(ts))).alias("score"))


def suggest(df: DataFrame, prefix: str, field: str = "title", limit: int = 10) -> DataFrame:
    return df.where(F.lower(F.col(field)).startswith(prefix.lower())).select(field).distinct().orderBy(field).limit(limit)


def more_like(post: DataFrame, row: int, limit: int = 10) -> DataFrame:
    """Records sharing the rarest terms of one record: tf-idf over the postings, no pair of records is formed but with the one asked for."""
    n = post.agg(F.countDistinct("row_id").alias("n")).scalar()
    freq = post.groupBy("term").agg(F.countDistinct("row_id").alias("df"))
    own = post.where(F.col("row_id") == row).groupBy("term").agg(F.sum("tf").alias("own")).join(freq, "term").withColumn("n", n)
    weight = own.select("term", (F.col("own") * F.log(F.col("n") / F.col("df"))).alias("w"))
    return post.where(F.col("row_id") != row).join(weight, "term").groupBy("row_id").agg(F.round(F.sum(F.col("w") * F.col("tf")), 6).alias("score")).orderBy(F.desc("score"), "row_id").limit(limit)


def highlight(c: Column, words: list[str], tag: str = "mark") -> Column:
    for w in words:
        c = F.regexp_replace(c, "(?i)" + re.escape(w), f"<{tag}>{w}</{tag}>")
    return c


def highlight_wildcards(c: Column, patterns: tuple[str, ...], tag: str = "mark") -> Column:
    """Words that match a pattern of letters, ``*`` and ``?``, in tags; the first pattern that fits takes the word."""
    form = "|".join("".join(r"\w*" if x == "*" else r"\w" if x == "?" else re.escape(x) for x in p) for p in patterns)
    return F.regexp_replace(c, rf"(?i)\b({form})\b", f"<{tag}>$1</{tag}>")


def similar(post: DataFrame, record: DataFrame, limit: int = 25, least: float = 0.7) -> DataFrame:
    """Other records by the words of one record's title, the first 200 letters of its abstract, and its keywords; the score is cut before the limit."""
    text = F.concat_ws(" ", "title", F.substring("abstract", 1, 200), F.array_join("keywords", " "))
    words = record.select("row_id", F.explode(F.array_distinct(T.tokens(text))).alias("term"))
    boost = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BOOSTS.items() for x in kv]), F.col("field")), F.lit(0.8))
    one = boost * F.col("tf") / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / 100.0))
    hits = post.join(words.withColumnRenamed("row_id", "own"), "term").where("row_id != own").groupBy("row_id").agg(F.round(F.sum(one), 6).alias("score"))
    return hits.where(F.col("score") >= least).orderBy(F.desc("score"), "row_id").limit(limit)
