"""Mixing sources to target weights (problem 9).

Method: iterative proportional fitting.  Documents are counted by source, language and topic
in tokens of a public tokenizer.  The token weights of these cells are raked in turn to the
language, topic and source marginals, the source last, under the cap on repeats, until the
source shares hold.  Documents are then drawn with the calibrated expected number of uses of
their cell: the whole part always, the rest by systematic sampling within the source, in order
of size, so that the drawn tokens meet each source's target as closely as whole
documents allow.

Scale: tokenizing is one narrow scan whose result is staged.  Cells are bounded by the named
sources times ``languages`` times ``topics``, rarer values becoming 'other', so the raking
itself works on a few thousand numbers.  The running totals of systematic sampling are taken
in two levels over salted size classes, so a source with a third or more of all
rows is spread over many tasks.

Defined results
* source names are compared trimmed and in lower case; sources without a target, and null
  sources, are left out, as are null and blank texts
* a null language is 'und', a null topic 'none'
* a target whose source has no tokens gets none; the remaining targets are scaled up
* the total is ``fraction`` of the largest total that all caps allow, or ``total_tokens`` if that is less
* an empty table gives an empty result; extra columns are ignored
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import cut

SALTS = 16  # at least; with more than ROWS_A_SALT documents a salt, more
ROWS_A_SALT = 500_000
CLASSES = 8  # size classes for each doubling of the length
#: How text is cut before the vocabulary applies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
BEFORE_BLANK = re.compile(r"\S(?=\s)")
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def slices(text: str, size: int = 200_000):
    """Pieces of about ``size`` letters, cut only before blanks, where the pre-tokeniser always cuts: counts are those of the whole text."""
    a = 0
    while len(text) - a > size:
        m = BEFORE_BLANK.search(text, a + size - 1)
        if not m:
            break
        yield text[a : m.end()]
        a = m.end()
    yield text[a:]


def count_tokens(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` with the text replaced by ``n_tokens``, counted over whole texts."""
    keep = [c for c in docs.columns if c != text]
    fields = [f for f in docs.schema if f.name != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens bigint"

    def scan(batches):
        import base64

        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            out = pdf[keep].copy()
            out["n_tokens"] = [sum(len(enc.encode_ordinary(x)) for x in slices(t)) for t in pdf[text]]
            yield out

    return docs.mapInPandas(scan, schema)


def rake(cells, source_share: dict, caps: dict, total: float, rounds: int = 200, tolerance: float = 1e-10):
    """
    Expected uses of each cell.  cells: [(source, lang, topic, tokens)].
    Language and topic marginals are those of the cells, scaled to the total; the source marginal is the target.
    """
    import numpy as np

    tokens = np.array([c[3] for c in cells], dtype=float)
    cap = np.array([caps[c[0]] for c in cells], dtype=float)
    axes = []
    for k in (1, 2, 0):
        names = sorted({c[k] for c in cells})
        at = np.array([names.index(c[k]) for c in cells])
        mass = np.array([source_share[n] for n in names]) * total if k == 0 else np.bincount(at, weights=tokens) / tokens.sum() * total
        axes.append((at, mass))
    uses = np.full(len(cells), total / tokens.sum())
    for _ in range(rounds):
        before = uses.copy()
        for at, mass in axes:
            now = np.bincount(at, weights=uses * tokens, minlength=len(mass))
            uses = uses * (mass / np.maximum(now, 1e-300))[at]
            uses = np.minimum(uses, cap)
        # what the caps take from a source goes to its other cells
        at, mass = axes[2]
        for _ in range(len(cells)):
            lack = mass - np.bincount(at, weights=uses * tokens, minlength=len(mass))
            free = uses < cap * (1 - 1e-12)
            room = np.bincount(at, weights=np.where(free, uses * tokens, 0), minlength=len(mass))
            if not ((lack > 1e-9 * mass) & (room > 0)).any():
                break
            grow = np.where((lack > 0) & (room > 0), 1 + lack / np.maximum(room, 1e-300), 1.0)
            uses = np.where(free, np.minimum(uses * grow[at], cap), uses)
        if np.abs(uses - before).max() <= tolerance * max(1.0, uses.max()):
            break
    return uses


def mixture(docs: DataFrame, targets: DataFrame, topics: DataFrame | None = None, id: str = "doc_id", fraction: float = 0.8, total_tokens: float | None = None, languages: int = 24, top_topics: int = 64, seed: int = 7, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, uses): the drawn documents and how often each is used.  topics: (entry_key, topic), one row per key."""
    clean = F.lower(F.trim("source"))
    want = targets.where("source is not null").groupBy(clean.alias("source")).agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("cap"))
    rows = docs.where("text rlike '[^\\\\s]'").select(F.col(id).alias("doc_id"), clean.alias("source"), F.coalesce(F.lower(F.trim("lang")), F.lit("und")).alias("lang"), "entry_key", "text")
    rows = rows.join(want.select("source"), "source", "left_semi")
    counted = count_tokens(rows, "text", tokenizer)
    if topics is not None:
        counted = counted.join(topics, "entry_key", "left").withColumn("topic", F.coalesce("topic", F.lit("none")))
    else:
        counted = counted.withColumn("topic", F.lit("none"))
    counted = cut(counted.select("doc_id", "source", "lang", "topic", "n_tokens").where("n_tokens > 0"))
    top = {}
    for k, most in (("lang", languages), ("topic", top_topics)):
        top[k] = [r[0] for r in counted.groupBy(k).agg(F.sum("n_tokens").alias("n")).orderBy(F.desc("n"), k).limit(most).collect()]
    celled = counted.select("doc_id", "source", *[F.when(F.col(k).isin(top[k] or ["none"]), F.col(k)).otherwise("other").alias(k) for k in top], "n_tokens")
    # at most named sources x (languages + 1) x (topics + 1) cells
    cells = [tuple(r) for r in celled.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("n")).orderBy("source", "lang", "topic").collect()]
    plan = {r.source: (r.weight, r.cap) for r in want.collect()}
    have: dict[str, int] = {}
    for s, _, _, n in cells:
        have[s] = have.get(s, 0) + n
    weight = sum(plan[s][0] for s in have) or 1.0
    share = {s: plan[s][0] / weight for s in have}
    caps = {s: plan[s][1] for s in have}
    spark = docs.sparkSession
    schema = "source string, lang string, topic string, uses double"
    if cells:
        most = min(caps[s] * have[s] / share[s] for s in have if share[s] > 0)
        total = fraction * most if total_tokens is None else min(most, total_tokens)
        uses = rake(cells, share, caps, total)
        table = spark.createDataFrame([(c[0], c[1], c[2], float(u)) for c, u in zip(cells, uses)], schema)
    else:
        table = spark.createDataFrame([], schema)
    salts = max(SALTS, -(-counted.count() // ROWS_A_SALT))
    return _draw(celled.join(table, ["source", "lang", "topic"]), salts, seed)


def _draw(rows: DataFrame, salts: int, seed: int) -> DataFrame:
    """
    Systematic sampling of the fractional uses within the source, in order of size, so that the drawn
    tokens miss their target by about one document.  Size classes are salted into buckets: running
    totals are taken over buckets first, then inside each; the number of salts follows the rows, so a
    bucket stays small however large its source is.
    """
    x = rows.select("doc_id", "source", "lang", "topic", "n_tokens", F.floor("uses").alias("whole"), (F.col("uses") - F.floor("uses")).alias("part"), F.xxhash64("doc_id", F.lit(seed)).alias("h"))
    size_class = F.floor(F.log2("n_tokens") * CLASSES).cast("bigint")
    x = x.withColumn("bucket", size_class * salts + F.pmod(F.col("h"), F.lit(salts)))
    mass = cut(x.groupBy("source", "bucket").agg(F.sum("part").alias("sum")))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    start = mass.select("source", "bucket", before.alias("start"))
    inside = F.sum("part").over(Window.partitionBy("source", "bucket").orderBy("n_tokens", "h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    y = x.withColumn("to", inside).join(start, ["source", "bucket"])
    begin = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1_000_000)) / 1_000_000  # where the steps of a source begin
    hi = F.col("start") + F.col("to") + begin
    lo = hi - F.col("part")
    drawn = (F.floor(hi) - F.floor(lo)).cast("bigint")
    return y.select("doc_id", "source", "lang", "topic", "n_tokens", (F.col("whole") + drawn).cast("bigint").alias("uses")).where("uses > 0")


def report(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual shares of tokens by source, with the uses of its documents."""
    clean = F.lower(F.trim("source"))
    want = targets.where("source is not null").groupBy(clean.alias("source")).agg(F.sum("weight").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("uses").alias("most_used"))
    whole = got.agg(F.sum("tokens").alias("all")).scalar()
    return want.join(got, "source", "left").withColumn("all", whole).select(
        "source", "target_share", F.round(F.coalesce(F.col("tokens"), F.lit(0)) / F.col("all"), 6).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_used", F.lit(0)).alias("most_used"), "max_repeats"
    )
