"""Duplicates hidden by formatting differences (problem 4).

Method: every record becomes one canonical string.  Canonical records are range-partitioned
on (64-bit hash of the string, row id) and sorted inside the partitions by Spark's external
sort; a scan then compares the full strings of adjacent rows and emits one run for each
distinct record with its exact count.  Because the row id takes part in the range bounds, a
record with a third of all rows as copies is spread over many partitions; only the first
and last run of each partition, at most two a partition, are compared across borders.

Defined results
* null, empty and punctuation-only values are equal
* the representative is the smallest row id of a run; its count covers all copies
* texts of any length are compared whole, never by hash alone
* an empty table gives an empty result; extra columns take part in the comparison unless named in ``skip``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import cut

PUNCTUATION = r"[^\p{L}\p{N}\p{M}]+"
RESOLVER = r"^\s*(https?://[^/\s]+/|doi:\s*|urn:doi:\s*)"


def squeeze(c: Column) -> Column:
    """Letters, digits and marks only, in lower case."""
    return F.regexp_replace(F.lower(c), PUNCTUATION, "")


def canonical_field(name: str, kind: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.array_sort(F.transform(c, lambda x: F.coalesce(squeeze(x.cast("string")), F.lit("")))), "|")
    if isinstance(kind, T.MapType):
        pair = lambda e: F.concat(squeeze(e["key"].cast("string")), F.lit("="), F.coalesce(squeeze(e["value"].cast("string")), F.lit("")))
        return F.array_join(F.array_sort(F.transform(F.map_entries(c), pair)), "|")
    if name == "doi":
        c = F.regexp_replace(F.lower(c), RESOLVER, "")
    return squeeze(c.cast("string"))


def canonical_record(df: DataFrame, skip: tuple[str, ...] = ("row_id", "added", "modified")) -> Column:
    """One string for all compared columns; fields are kept apart by a mark no canonical value holds."""
    return F.concat_ws("\u0001", *[F.coalesce(canonical_field(f.name, f.dataType), F.lit("")) for f in df.schema if f.name not in skip])


def _scan(batches):
    """Adjacent runs of equal records: a row (row_id, local, null, null) for each record and a row (null, local, copies, text) for each run."""
    import numpy as np
    import pandas as pd

    held = None  # the run under way: [hash, text, first row id, copies]
    first = True
    for pdf in batches:
        if not len(pdf):
            continue
        h, text, ids = pdf["h"].to_numpy(), pdf["text"].to_numpy(dtype=object), pdf["row_id"].to_numpy()
        n = len(ids)
        new = np.ones(n, bool)
        same = h[1:] == h[:-1]
        new[1:] = ~same
        for k in np.flatnonzero(same):  # equal hashes: the full strings decide
            new[k + 1] = text[k + 1] != text[k]
        new[0] = held is None or h[0] != held[0] or text[0] != held[1]
        starts = np.flatnonzero(new)
        local = np.empty(n, dtype=np.int64)
        at = np.searchsorted(starts, np.arange(n), side="right") - 1
        local[:] = np.where(at >= 0, ids[starts[np.maximum(at, 0)]] if len(starts) else 0, held[2] if held else 0)
        runs = []
        lead = starts[0] if len(starts) else n
        if held is not None:
            held[3] += int(lead)
        for j, s in enumerate(starts):
            if held is not None:
                runs.append((held[2], held[3], held[1] if first else None))
                first = False
            e = starts[j + 1] if j + 1 < len(starts) else n
            held = [h[s], text[s], int(ids[s]), int(e - s)]
        yield pd.DataFrame({"row_id": pd.array(ids, dtype="Int64"), "local": local, "copies": pd.array([None] * n, dtype="Int64"), "text": [None] * n})
        if runs:
            yield pd.DataFrame({"row_id": pd.array([None] * len(runs), dtype="Int64"), "local": [r[0] for r in runs], "copies": pd.array([r[1] for r in runs], dtype="Int64"), "text": [r[2] for r in runs]})
    if held is not None:
        yield pd.DataFrame({"row_id": pd.array([None], dtype="Int64"), "local": [held[2]], "copies": pd.array([held[3]], dtype="Int64"), "text": [held[1]]})


def runs(df: DataFrame, id: str = "row_id", skip: tuple[str, ...] = ("row_id", "added", "modified")) -> tuple[DataFrame, DataFrame]:
    """(membership (row_id, rep), representatives (rep, copies)) of all records."""
    text = canonical_record(df, skip)
    keyed = df.select(F.col(id).cast("bigint").alias("row_id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    ranged = keyed.repartitionByRange("h", "row_id").sortWithinPartitions("h", "text", "row_id")
    scanned = cut(ranged.mapInPandas(_scan, "row_id bigint, local bigint, copies bigint, text string"))
    found = scanned.where("row_id is null")
    # runs at partition borders: at most two for each partition
    border = found.where("text is not null")
    joined = border.groupBy("text").agg(F.min("local").alias("rep"), F.collect_set("local").alias("locals")).where(F.size("locals") > 1)
    moved = cut(joined.select("rep", F.explode("locals").alias("local")))
    member = scanned.where("row_id is not null").select("row_id", "local").join(moved, "local", "left").select("row_id", F.coalesce("rep", "local").alias("rep"))
    reps = found.select("local", "copies").join(moved, "local", "left").groupBy(F.coalesce("rep", "local").alias("rep")).agg(F.sum("copies").alias("copies"))
    return member, reps


def pairs(member: DataFrame, reps: DataFrame) -> DataFrame:
    """All pairs within the groups, as problem 4 asks for them."""
    group = member.join(reps.where("copies > 1").select("rep"), "rep", "left_semi")
    a, b = group.select("rep", F.col("row_id").alias("row_id_a")), group.select("rep", F.col("row_id").alias("row_id_b"))
    return a.join(b, "rep").where("row_id_a < row_id_b").select("row_id_a", "row_id_b")
