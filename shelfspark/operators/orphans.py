"""References to records that do not exist (problem 6).

Method: all distinct keys, of parents and of references, are range-partitioned and sorted
once, which gives every key an order-preserving integer.  The integers of the parents are
compressed into contiguous runs.  A reference is matched as-of to the preceding run start;
beyond the run's end there is no parent.  References are reduced to distinct keys before
any of this, so one key holding a third of all rows weighs as much as any other, and only
the rows whose key is suspect are looked at again.

Defined results
* a null or blank key is no reference; keys are compared trimmed and in lower case
* a reference met in several rows (redelivery) is reported once, by its earliest time
* a reference without time is reported as missing or deleted only by the existence of
  the key, with a null period
* empty tables give an empty result; extra columns are ignored
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import cut

REFERENCE = "src string, ref_id string, entry_key string, ts timestamp_ntz"


def canonical_key(c: Column) -> Column:
    x = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(F.length(x) > 0, x)


def key_runs(parents: DataFrame, others: DataFrame, key: str = "entry_key") -> DataFrame:
    """Codes of all distinct keys with a flag for parents: (entry_key, code, pid, is_parent), sorted within ``pid``."""
    both = parents.select(key, F.lit(True).alias("is_parent")).unionByName(others.select(key, F.lit(False).alias("is_parent")))
    one = both.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("is_parent").alias("is_parent"))
    coded = one.repartitionByRange(key).sortWithinPartitions(key).select(key, "is_parent", F.monotonically_increasing_id().alias("code"), F.spark_partition_id().alias("pid"))
    return cut(coded)


def beyond_runs(coded: DataFrame, key: str = "entry_key") -> DataFrame:
    """Keys that lie in no run of parents.  Runs are cut at range partitions, so the as-of match stays inside one."""
    w = Window.partitionBy("pid").orderBy("code")
    parents = coded.where("is_parent").select("pid", "code", (F.col("code") - F.row_number().over(w)).alias("island"))
    runs = parents.groupBy("pid", "island").agg(F.min("code").alias("run_start"), F.max("code").alias("run_end"))
    line = runs.select("pid", F.col("run_start").alias("code"), "run_end", F.lit(None).cast("string").alias(key), F.lit(0).alias("side")).unionByName(
        coded.where("not is_parent").select("pid", "code", F.lit(None).cast("bigint").alias("run_end"), key, F.lit(1).alias("side"))
    )
    as_of = F.last("run_end", ignorenulls=True).over(Window.partitionBy("pid").orderBy("code", "side").rowsBetween(Window.unboundedPreceding, 0))
    return line.withColumn("end", as_of).where((F.col("side") == 1) & (F.col("end").isNull() | (F.col("code") > F.col("end")))).select(key)


def orphan_references(references: DataFrame, parents: DataFrame, removals: DataFrame) -> DataFrame:
    """
    references: (src, ref_id, entry_key, ts), canonical keys
    parents:    (entry_key, since), one or more rows per key
    removals:   (entry_key, ts), deletions seen in the log
    returns (src, ref_id, entry_key, kind, period)
    """
    ref_keys = references.where("entry_key is not null").groupBy("entry_key").agg(F.min("ts").alias("first_ref"))
    have = parents.where("entry_key is not null").groupBy("entry_key").agg(F.min("since").alias("since"))
    gone = removals.where("entry_key is not null").groupBy("entry_key").agg(F.min("ts").alias("removed"))
    absent = beyond_runs(key_runs(have, ref_keys))
    suspect = (
        absent.join(gone, "entry_key", "left").select("entry_key", F.lit(None).cast("timestamp_ntz").alias("since"), "removed", F.lit(True).alias("absent"))
    ).unionByName(
        have.join(ref_keys, "entry_key").where("first_ref < since").select("entry_key", "since", F.lit(None).cast("timestamp_ntz").alias("removed"), F.lit(False).alias("absent"))
    )
    suspect = cut(suspect)
    kind = (
        F.when(~F.col("absent") & (F.col("ts") < F.col("since")), "late")
        .when(F.col("absent") & (F.col("removed") < F.col("ts")), "deleted")
        .when(F.col("absent") & F.col("removed").isNull(), "missing")
    )
    hit = references.join(suspect, "entry_key").withColumn("kind", kind).where("kind is not null")
    return hit.groupBy("src", "ref_id", "entry_key").agg(F.coalesce(F.min_by("kind", "ts"), F.max("kind")).alias("kind"), F.date_format(F.min("ts"), "yyyy-MM").alias("period"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table and period."""
    return orphans.groupBy("src", "period", "kind").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("entry_key").alias("n_keys"))
