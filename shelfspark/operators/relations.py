"""Joins between records, collections, tags and their side tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled

INHERITED = ("title", "publisher", "year", "editor", "month", "volume", "number", "url", "institution")


def resolve_crossref(df: DataFrame) -> DataFrame:
    """Fields a record inherits from the one it refers to, one level deep; its own values win, and booktitle comes from the parent's title."""
    parent = df.select(F.col("key").alias("crossref"), F.lit(True).alias("found"), *[F.col(c).alias("p_" + c) for c in (*INHERITED, "type")])
    j = df.join(parent, "crossref", "left").where("crossref is null or crossref != key")
    own = lambda c: F.coalesce(filled(F.col(c)) if c != "year" else F.col(c), F.col("p_" + c))
    booktitle = F.when(F.col("p_type").isin("book", "proceedings") & F.col("type").startswith("in"), F.coalesce(filled(F.col("booktitle")), F.col("p_title"))).otherwise(F.col("booktitle"))
    keep = [c for c in df.columns if c not in INHERITED and c != "booktitle"]
    return j.select(*keep, booktitle.alias("booktitle"), *[(own(c) if c != "title" else F.col("title")).alias(c) for c in INHERITED], F.coalesce("found", F.lit(False)).alias("found"))


def year_islands(df: DataFrame, group: list[str], year: str, tolerance: int) -> DataFrame:
    """Records of one group whose years lie within ``tolerance`` of a neighbour share an island."""
    w = Window.partitionBy(*group).orderBy(year, "row_id")
    gap = F.col(year) - F.lag(year).over(w) > tolerance
    return df.withColumn("island", F.sum(F.when(gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def rename_tag(tags, old: str, new: str):
    return F.array_distinct(F.transform(tags, lambda t: F.when(t == old, F.lit(new)).otherwise(t)))


def merge_tags(tags, sources: list[str], target: str):
    src = F.array(*[F.lit(t) for t in sources])
    return F.when(F.arrays_overlap(tags, src), F.array_union(F.array_except(tags, src), F.array(F.lit(target)))).otherwise(tags)
