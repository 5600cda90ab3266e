"""A kept index: postings in files by buckets of terms, read only where a query's terms are, and kept up by generations.

Each build or update writes a generation: the postings of its records and, for every record it
adds, changes or removes, a line in ``docs``.  A posting holds as long as no later generation
names its record.  Nothing is rewritten, so an update costs what it changes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import querylang as L
from . import search as S

BUCKETS = 64


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class Index:
    def __init__(self, spark: SparkSession, path: str, generation: int = 0):
        self.spark, self.path, self.generation = spark, path, generation

    def update(self, changed: DataFrame | None = None, removed: DataFrame | None = None) -> Index:
        """Adds or replaces records, and removes ids (row_id); gives the index of the next generation."""
        g = self.generation + 1
        ids = [x.select("row_id") for x in (changed, removed) if x is not None]
        reduce(DataFrame.unionByName, ids).distinct().withColumn("generation", F.lit(g)).write.mode("overwrite").parquet(f"{self.path}/docs/g={g}")
        if changed is not None:
            df = S.searchable(changed)
            parts = F.array(*[F.struct(F.lit(f).alias("field"), T.tokens(F.col(f)).alias("ts"), T.word_count(F.col(f)).alias("words")) for f in S.FIELDS])
            long = df.select("row_id", F.explode(parts).alias("x")).select("row_id", "x.field", "x.words", F.explode("x.ts").alias("term"))
            post = long.groupBy("term", "field", "row_id").agg(F.count(F.lit(1)).alias("tf"), F.first("words").alias("words")).withColumn("generation", F.lit(g)).withColumn("bucket", _bucket(F.col("term")))
            # files sorted by term, so that their statistics leave out what a query does not ask for
            post.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/g={g}")
        return Index(self.spark, self.path, g)

    def docs(self) -> DataFrame:
        """(row_id, latest): the generation that last named each record."""
        return self.spark.read.option("basePath", f"{self.path}/docs").parquet(*[f"{self.path}/docs/g={g}" for g in range(1, self.generation + 1)]).groupBy("row_id").agg(F.max("generation").alias("latest"))

    def terms(self, words: list[str]) -> DataFrame:
        """Valid postings of the words: buckets are pruned as partitions, terms by the files' statistics."""
        import os

        words = sorted({w.lower() for w in words})
        schema = "term string, field string, row_id bigint, tf bigint, words int, generation int, g int, bucket int"
        p = self.spark.read.schema(schema).option("basePath", os.path.join(self.path, "postings")).parquet(f"{self.path}/postings")
        numbers = [r[0] for r in self.spark.createDataFrame([(w,) for w in words], "w string").select(_bucket(F.col("w"))).distinct().collect()]  # of the query's words
        hit = p.where(F.col("bucket").isin(numbers) & F.col("term").isin(words) & (F.col("g") <= self.generation))
        return hit.join(self.docs(), "row_id").where("generation = latest").select("term", "field", "row_id", "tf", "words")

    def search(self, text: str) -> DataFrame:
        """(row_id, score) of queries of words, fields, AND, OR and AND NOT; other forms need the records (``search.search``)."""
        q = L.parse(text)
        nodes: list[tuple[str, tuple[str, ...], float]] = []

        def walk(q, fields) -> tuple:
            """(matches, score) as columns over the aggregates of one record."""
            if isinstance(q, L.Term):
                nodes.append((q.text.lower(), fields, q.boost))
                k = len(nodes) - 1
                return F.col(f"h{k}"), F.col(f"s{k}")
            if isinstance(q, L.Fielded):
                return walk(q.query, ("keywords_text" if q.field == "keywords" else q.field,))
            if isinstance(q, L.Bool) and not (q.op == "NOT" and len(q.parts) == 1):
                parts = [walk(p, fields) for p in q.parts]
                if q.op == "NOT":
                    return parts[0][0] & ~parts[1][0], parts[0][1]
                both = reduce((lambda a, b: a & b) if q.op == "AND" else (lambda a, b: a | b), [m for m, _ in parts])
                return both, reduce(lambda a, b: a + b, [F.when(m, s).otherwise(0.0) for m, s in parts])
            raise ValueError(f"not a query of words: {text}")

        hit, score = walk(q, tuple(S.FIELDS))
        aggs = []
        for k, (w, fields, boost) in enumerate(nodes):
            here = F.col("term") == w
            one = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in S.BOOSTS.items() for x in kv]), F.col("field")), F.lit(0.8)) * F.col("tf") / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("words") / 100.0))
            aggs += [F.bool_or(here).alias(f"h{k}"), F.sum(F.when(here & F.col("field").isin(*fields), one * boost).otherwise(0.0)).alias(f"s{k}")]
        rows = self.terms([w for w, _, _ in nodes]).groupBy("row_id").agg(*aggs)
        return rows.where(hit).select("row_id", score.alias("score"))
