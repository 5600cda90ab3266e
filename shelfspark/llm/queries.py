"""Queries of the problems on training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import read_table
from . import formatting, leak, mixing, names, near, residue, survivor
from .sql import SURVIVE


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(read_table(spark, d, "merge_candidates"), read_table(spark, d, "origins"))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return survivor.records(read_table(spark, d, "merge_candidates"), read_table(spark, d, "origins"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near.near_pairs(read_table(spark, d, "entries"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return near.near_classes(read_table(spark, d, "entries"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting.pairs(*formatting.runs(read_table(spark, d, "entries")))


def p4_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return formatting.runs(read_table(spark, d, "entries"))[1].select(F.col("rep").alias("row_id"), "copies")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(read_table(spark, d, "name_forms"))


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling with the smallest name id of its entity."""
    return names.entities(read_table(spark, d, "name_forms"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the number of documents that hold them and the largest share held."""
    found = leak.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.max("share"), 4).alias("max_share"))


def _topics(spark: SparkSession, d: str) -> DataFrame:
    """Discipline of the serial an entry appeared in, one row per key."""
    e = read_table(spark, d, "entries").select("entry_key", F.element_at(F.split(F.trim("journal"), r"\s+"), -1).alias("topic")).where("topic != '' and entry_key is not null")
    return e.groupBy("entry_key").agg(F.min("topic").alias("topic"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"), _topics(spark, d))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(p9_mixture(spark, d), read_table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(read_table(spark, d, "documents")).select("doc_id")


def p10_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each kind of residue excludes, and the mean share of their text."""
    found = residue.residue(read_table(spark, d, "documents"))
    return found.groupBy("kinds").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("share"), 4).alias("mean_share"))


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p2_found, p2_classes, p4_found, p4_collapsed, p5_found, p5_entities, p8_found, p8_report, p9_mixture, p9_report, p10_found, p10_kinds)}

_SQ = r"coalesce(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g'), '')"
_PLAIN = "entry_key entry_type title author editor journal booktitle publisher school institution volume issue_no pages pub_month url abstract".split()
_CANON = (
    "WITH canon AS (SELECT row_id, concat_ws(chr(1), "
    + ", ".join(_SQ.format(c=c) for c in _PLAIN)
    + ", coalesce(CAST(pub_year AS VARCHAR), ''), "
    + _SQ.format(c=r"regexp_replace(lower(doi), '^\s*(https?://[^/\s]+/|doi:\s*|urn:doi:\s*)', '')")
    + "".join(", coalesce(array_to_string(list_sort(list_transform({c}, lambda x: {x})), '|'), '')".format(c=c, x=_SQ.format(c="x")) for c in ("keywords", "tags"))
    + ", coalesce(array_to_string(list_sort(list_transform(map_entries(custom), lambda x: {k} || '=' || {v})), '|'), '')".format(k=_SQ.format(c="x.key"), v=_SQ.format(c="x.value"))
    + ") AS k FROM entries)"
)

SQL = {
    "p1_found": SURVIVE + " SELECT * FROM won",
    "p1_records": SURVIVE + " SELECT g.group_id, " + ", ".join(f"(SELECT m.{f} FROM won w JOIN m ON m.member_id = w.member_id WHERE w.group_id = g.group_id AND w.field = '{f}') AS {f}" for f in survivor.FIELDS) + " FROM (SELECT DISTINCT group_id FROM m) g",
    "p4_found": _CANON + " SELECT a.row_id AS row_id_a, b.row_id AS row_id_b FROM canon a JOIN canon b ON a.k = b.k AND a.row_id < b.row_id",
    "p4_collapsed": _CANON + " SELECT min(row_id) AS row_id, count(*) AS copies FROM canon GROUP BY k",
}
