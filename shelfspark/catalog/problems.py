"""Queries of the general problems 3, 6 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import descendants, hierarchy
from ..operators.orphans import canonical_key, orphan_references, orphan_report
from ..operators.packed import unpack
from ..plans import read_table


def _tree(spark: SparkSession, d: str, paths: bool = True) -> DataFrame:
    return hierarchy(read_table(spark, d, "collections"), paths=paths)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d, False).select("id", "root_id", "depth")


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every collection; the path in and below a loop begins with the whole loop."""
    return _tree(spark, d).select("id", "root_id", "depth", "in_loop", F.array_join("path", " > ").alias("path"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every collection under each of its ancestors; in a loop each member is under each other."""
    return descendants(_tree(spark, d))


def p3_loops(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d, False).where("depth < 0").groupBy("root_id").agg(
        F.count_if("in_loop").alias("n_members"), F.count_if(~F.col("in_loop")).alias("n_below")
    )


def p3_loop_members(spark: SparkSession, d: str) -> DataFrame:
    """The collections ``p3_loops`` counts, by name."""
    return _tree(spark, d, False).where("depth < 0").select("root_id", "id", "in_loop")


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    events = read_table(spark, d, "library_events").select("event_id", F.upper("event_type").alias("kind"), "event_ts", canonical_key(F.col("entry_key")).alias("entry_key"))
    coll = read_table(spark, d, "collections").groupBy("id").agg(F.max(F.struct("modified", "entry_keys")).alias("v"))
    member = coll.select("id", F.col("v.modified").alias("ts"), F.explode("v.entry_keys").alias("k")).select(
        F.lit("collections").alias("src"), F.col("id").alias("ref_id"), canonical_key(F.col("k")).alias("entry_key"), "ts"
    )
    refs = events.select(F.lit("library_events").alias("src"), F.col("event_id").cast("string").alias("ref_id"), "entry_key", F.col("event_ts").alias("ts")).unionByName(member)
    parents = read_table(spark, d, "entries").select(canonical_key(F.col("entry_key")).alias("entry_key"), F.col("added").alias("since"))
    removals = events.where("kind = 'ENTRY_DELETED'").select("entry_key", F.col("event_ts").alias("ts"))
    return refs.where("entry_key is not null"), parents, removals


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(*_references(spark, d))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(p6_found(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return unpack(read_table(spark, d, "import_rows"))


def p7_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """How often each unpacked value occurs in its field."""
    return p7_found(spark, d).groupBy("field", "val").agg(F.count(F.lit(1)).alias("n_values"), F.countDistinct("import_id").alias("n_rows"))


QUERIES = {f.__name__: f for f in (p3_found, p3_paths, p3_descendants, p3_loops, p3_loop_members, p6_found, p6_report, p7_found, p7_frequencies)}

_CLEAN = r"regexp_replace(regexp_replace(lower(regexp_replace({c}, '^[\s{{(]+|[\s}})]+$', '', 'g')), '^(urn:uuid:|collection:)[\s{{(]*', ''), '^([0-9a-f]{{8}})([0-9a-f]{{4}})([0-9a-f]{{4}})([0-9a-f]{{4}})([0-9a-f]{{12}})$', '\1-\2-\3-\4-\5')"

_TREE = f"""
WITH RECURSIVE raw AS (
  SELECT {_CLEAN.format(c='id')} AS cid, id, nullif({_CLEAN.format(c='parent_id')}, '') AS parent,
         trim(regexp_replace(coll_name, '\\s+', ' ', 'g')) AS name, modified FROM collections),
cur AS (SELECT cid, id, parent, name FROM (
  SELECT *, row_number() OVER (PARTITION BY cid ORDER BY modified DESC, parent DESC NULLS LAST, name DESC NULLS LAST, id DESC) AS rn FROM raw) WHERE rn = 1),
link AS (SELECT c.cid, c.id, p.cid AS parent, coalesce(c.name, '') AS name FROM cur c LEFT JOIN cur p ON c.parent = p.cid),
tree AS (
  SELECT cid, id, id AS root_id, CAST(0 AS BIGINT) AS depth, name AS path, [id] AS path_ids FROM link WHERE parent IS NULL
  UNION ALL
  SELECT l.cid, l.id, t.root_id, t.depth + 1, t.path || ' > ' || l.name, list_append(t.path_ids, l.id) FROM link l JOIN tree t ON l.parent = t.cid),
looped AS (SELECT * FROM link WHERE cid NOT IN (SELECT cid FROM tree)),
walk AS (
  SELECT cid, parent AS cur_id, 1 AS n FROM looped
  UNION ALL
  SELECT w.cid, l.parent, n + 1 FROM walk w JOIN looped l ON w.cur_id = l.cid WHERE n < (SELECT count(*) FROM looped)),
ringed AS (SELECT DISTINCT cid FROM walk WHERE cur_id = cid),
low AS (SELECT w.cid, min(l.id) AS root_id FROM walk w JOIN ringed r ON w.cur_id = r.cid JOIN link l ON l.cid = w.cur_id GROUP BY 1)
"""

_ALL = _TREE.rstrip() + """,
up AS (
  SELECT l.cid, l.id, l.parent, [l.cid] AS seen, l.name AS path, [l.id] AS path_ids FROM looped l
  UNION ALL
  SELECT u.cid, u.id, p.parent, list_append(u.seen, p.cid), p.name || ' > ' || u.path, list_prepend(p.id, u.path_ids) FROM up u JOIN looped p ON p.cid = u.parent WHERE NOT list_contains(u.seen, p.cid)),
every AS (
  SELECT id, root_id, depth, false AS in_loop, path, path_ids FROM tree
  UNION ALL
  SELECT u.id, low.root_id, -1, u.cid IN (SELECT cid FROM ringed), u.path, u.path_ids FROM up u JOIN low ON low.cid = u.cid QUALIFY row_number() OVER (PARTITION BY u.cid ORDER BY len(u.path_ids) DESC) = 1)
"""

_REFS = r"""
WITH ev AS (SELECT CAST(event_id AS VARCHAR) AS ref_id, upper(event_type) AS kind, event_ts AS ts,
                   lower(regexp_replace(entry_key, '^\s+|\s+$', '', 'g')) AS entry_key FROM library_events),
cur AS (SELECT id, modified, entry_keys FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY modified DESC, entry_keys DESC NULLS LAST) AS rn FROM collections) WHERE rn = 1),
refs AS (
  SELECT 'library_events' AS src, ref_id, entry_key, min(ts) AS ts FROM ev WHERE entry_key <> '' GROUP BY ALL
  UNION ALL
  SELECT 'collections', id, k, min(modified) FROM (SELECT id, modified, lower(regexp_replace(unnest(entry_keys), '^\s+|\s+$', '', 'g')) AS k FROM cur) WHERE k <> '' GROUP BY ALL),
have AS (SELECT lower(regexp_replace(entry_key, '^\s+|\s+$', '', 'g')) AS entry_key, min(added) AS since FROM entries GROUP BY 1),
gone AS (SELECT entry_key, min(ts) AS removed FROM ev WHERE kind = 'ENTRY_DELETED' GROUP BY 1),
found AS (
  SELECT r.src, r.ref_id, r.entry_key,
         CASE WHEN h.entry_key IS NOT NULL THEN CASE WHEN r.ts < h.since THEN 'late' END
              WHEN g.removed < r.ts THEN 'deleted' WHEN g.removed IS NULL THEN 'missing' END AS kind,
         strftime(r.ts, '%Y-%m') AS period
  FROM refs r LEFT JOIN have h ON r.entry_key = h.entry_key LEFT JOIN gone g ON r.entry_key = g.entry_key)
"""

SQL = {
    "p3_found": _TREE + "SELECT id, root_id, depth FROM tree UNION ALL SELECT l.id, low.root_id, CAST(-1 AS BIGINT) FROM looped l JOIN low ON l.cid = low.cid",
    "p3_loops": _TREE + "SELECT low.root_id, count(r.cid) AS n_members, count(*) - count(r.cid) AS n_below FROM looped l JOIN low ON l.cid = low.cid LEFT JOIN ringed r ON r.cid = l.cid GROUP BY 1",
    "p3_paths": _ALL + "SELECT id, root_id, depth, in_loop, path FROM every",
    "p3_descendants": _ALL + "SELECT a AS ancestor_id, id AS descendant_id, CAST(n - k AS BIGINT) AS distance FROM (SELECT id, len(path_ids) AS n, unnest(path_ids[1:-2]) AS a, unnest(range(1, len(path_ids))) AS k FROM every)",
    "p3_loop_members": _ALL + "SELECT root_id, id, in_loop FROM every WHERE depth < 0",
    "p6_found": _REFS + "SELECT * FROM found WHERE kind IS NOT NULL",
    "p6_report": _REFS + "SELECT src, period, kind, count(*) AS n_refs, count(DISTINCT entry_key) AS n_keys FROM found WHERE kind IS NOT NULL GROUP BY ALL",
}
