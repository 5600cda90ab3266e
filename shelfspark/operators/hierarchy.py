"""Parent-child rows to full hierarchies (problem 3).

Method: components of the parent graph by pointer doubling, each component co-located,
an iterative depth-first walk with node colouring inside it, one component after the other.
A component larger than ``max_component`` never enters one task: its depths and roots are
those of the doubling rounds and its paths come from further ones, all distributed joins, so
a tree holding a third of all rows is neither collected nor dropped.  Either way gives the
same rows.  A hot parent is the unique side of each join, so adaptive execution may split
the rows that point at it.  Paths are made only where asked for and streamed, as their
length adds up to the square of a chain's.

Defined results
* a parent that is null, blank or names no row: the row is its own root at depth 0
* several rows with one id: the one modified last holds; on equal times the greatest
  (parent, name) pair
* a null id is no node and is left out
* rows in a loop, or whose ancestors run into one: root is the smallest id of the loop,
  depth is -1, ``in_loop`` tells the two apart; the path of a loop node is the whole loop,
  from its farthest ancestor down to the node, and the path of a node below goes on from
  that of the loop node it hangs under, whatever the size of the component
* an empty table gives an empty result; extra columns are ignored
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import cut, discard

OUT = "id string, root_id string, depth bigint, in_loop boolean, path array<string>, path_ids array<string>"


def canonical_id(c: Column) -> Column:
    """One spelling of an id: no case, blanks, braces or scheme prefix; null where nothing is left."""
    x = F.lower(F.regexp_replace(c, r"^[\s{(]+|[\s})]+$", ""))
    x = F.regexp_replace(x, r"^(urn:uuid:|collection:)[\s{(]*", "")
    bare = x.rlike("^[0-9a-f]{32}$")
    x = F.when(bare, F.regexp_replace(x, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).otherwise(x)
    return F.when(F.length(x) > 0, x)


def current_nodes(rows: DataFrame, id: str, parent: str, name: str, modified: str) -> DataFrame:
    """One row per id: the last modified; partial aggregation keeps a hot id small."""
    r = rows.select(
        canonical_id(F.col(id)).alias("cid"),
        F.struct(
            F.col(modified).alias("m"),
            canonical_id(F.col(parent)).alias("parent"),
            F.trim(F.regexp_replace(F.col(name), r"\s+", " ")).alias("name"),
            F.col(id).alias("id"),
        ).alias("v"),
    ).where("cid is not null")
    best = r.groupBy("cid").agg(F.max("v").alias("v"))
    return best.select("cid", F.col("v.id").alias("id"), F.col("v.parent").alias("parent"), F.col("v.name").alias("name"))


def _linked(nodes: DataFrame) -> DataFrame:
    """Parents that name no row become null."""
    known = nodes.select(F.col("cid").alias("parent"), F.lit(True).alias("known"))
    return nodes.join(known, "parent", "left").select("cid", "id", F.when(F.col("known"), F.col("parent")).alias("parent"), "name")


def _double(links: DataFrame) -> DataFrame:
    """(cid, root, depth, looped, in_loop) of every node by pointer doubling; finished nodes are written once and only looked up afterwards."""
    state = cut(
        links.select(
            "cid",
            F.coalesce("parent", "cid").alias("ptr"),
            F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("dist"),
            F.col("parent").isNull().alias("done"),
        )
    )
    finished, active = state.where("done"), state.where("not done")
    left = active.count()
    while left:
        step = finished.unionByName(active).select(F.col("cid").alias("ptr"), F.col("ptr").alias("p2"), F.col("dist").alias("d2"), F.col("done").alias("k2"))
        nxt = cut(active.join(step, "ptr").select("cid", F.col("p2").alias("ptr"), (F.col("dist") + F.col("d2")).alias("dist"), F.col("k2").alias("done")))
        finished, active, before = finished.unionByName(nxt.where("done")), nxt.where("not done"), left
        left = active.count()
        # where an acyclic node is still under way, one of its ancestors finishes in each round
        if left == before:
            break
    done = finished.select("cid", F.col("ptr").alias("root"), F.col("dist").alias("depth"), F.lit(False).alias("looped"), F.lit(False).alias("in_loop"))
    if not left:
        return done
    rest = cut(links.join(active.select("cid"), "cid", "left_semi").select("cid", F.col("parent").alias("ptr"), F.col("cid").alias("low")))
    for _ in range(math.ceil(math.log2(left + 1)) + 1):
        step = rest.select(F.col("cid").alias("ptr"), F.col("ptr").alias("p2"), F.col("low").alias("l2"))
        nxt = cut(rest.join(step, "ptr").select("cid", F.col("p2").alias("ptr"), F.least("low", "l2").alias("low")))
        discard(rest)
        rest = nxt
    # after so many steps every pointer lies on its loop, and ``low`` of a loop node covers the whole loop
    low = rest.select(F.col("cid").alias("ptr"), F.col("low").alias("root"))
    # and the nodes that are pointed at are just the loop nodes
    ring = rest.select(F.col("ptr").alias("cid")).distinct().withColumn("in_loop", F.lit(True))
    looped = rest.select("cid", "ptr").join(low, "ptr").join(ring, "cid", "left").select(
        "cid", "root", F.lit(-1).cast("bigint").alias("depth"), F.lit(True).alias("looped"), F.coalesce("in_loop", F.lit(False)).alias("in_loop")
    )
    return done.unionByName(looped)


def walk(cid: list, parent: list, ids: list, names: list, paths: bool):
    """
    Iterative depth-first walk of whole components; white 0, grey 1, black 2.  Yields (node, root, depth, in loop,
    path, path_ids) with numbers of nodes, the paths None unless asked for; only the path under way is held.
    """
    n = len(cid)
    at = {c: k for k, c in enumerate(cid)}
    up = [-1 if p is None else at[p] for p in parent]
    kids: list[list[int]] = [[] for _ in range(n)]
    for k, p in enumerate(up):
        if p >= 0:
            kids[p].append(k)
    colour = bytearray(n)

    def descend(start, root, depth, line, in_loop=False):
        """``start`` and the nodes below it; a grey node met again is the back edge of a loop, already named."""
        trail = list(line)

        def row(node, steps):
            here = ([names[x] for x in trail], [ids[x] for x in trail]) if paths else (None, None)
            return node, root, -1 if depth < 0 else depth + steps, in_loop and node == start, *here

        colour[start] = 1
        yield row(start, 0)
        stack = [(start, iter(kids[start]))]
        while stack:
            node, rest = stack[-1]
            k = next((k for k in rest if colour[k] == 0), None)
            if k is None:
                colour[node] = 2
                stack.pop()
                if stack:
                    trail.pop()
            else:
                colour[k] = 1
                trail.append(k)
                yield row(k, len(stack))
                stack.append((k, iter(kids[k])))

    for k in range(n):
        if up[k] < 0:
            yield from descend(k, k, 0, [k])
    for k in range(n):
        if colour[k] == 0:  # white after all roots: in a loop or below one
            trail, v = [], k
            while colour[v] == 0:
                colour[v] = 1
                trail.append(v)
                v = up[v]
            ring = trail[trail.index(v):]
            root = min(ring, key=cid.__getitem__)
            for x in trail:
                colour[x] = 0
            for x in ring:
                colour[x] = 1
            for j, x in enumerate(ring):  # from the farthest ancestor down to the node itself
                yield from descend(x, root, -1, [ring[(j + s) % len(ring)] for s in range(len(ring) - 1, -1, -1)] if paths else [], True)


def _scan(paths: bool, at_once: int = 1_000_000):
    """Rows sorted by component to ``OUT``, one component after the other."""

    def run(batches):
        import pandas as pd

        rows: list = []
        size = 0
        held: list = []

        def frame():
            nonlocal size
            out = pd.DataFrame(rows, columns=["id", "root_id", "depth", "in_loop", "path", "path_ids"]).astype({"depth": "int64", "in_loop": "bool"})
            rows.clear()
            size = 0
            return out if paths else out[["id", "root_id", "depth", "in_loop"]]

        def finish():
            nonlocal size
            cid, parent, ids, names = zip(*held)
            for k, root, depth, looped, path, path_ids in walk(cid, parent, ids, names, paths):
                rows.append((ids[k], ids[root], depth, looped, path, path_ids))
                size += 1 + (2 * len(path) if paths else 0)
                if size > at_once:
                    yield frame()
            held.clear()

        now = None
        for pdf in batches:
            for root, c, p, i, name in zip(pdf["root"], pdf["cid"], pdf["parent"], pdf["id"], pdf["name"]):
                if root != now and held:
                    yield from finish()
                now = root
                held.append((c, p if isinstance(p, str) else None, i, name if isinstance(name, str) else ""))
        if held:
            yield from finish()
        yield frame()

    return run


def _climb(state: DataFrame) -> DataFrame:
    """Path pieces (cid, top, ptr, path, path_ids) doubled until no pointer is left; ``top`` is the node the path begins with."""
    state = cut(state)
    while state.where("ptr is not null").limit(1).count():
        step = state.select(F.col("cid").alias("ptr"), F.col("ptr").alias("p2"), F.col("top").alias("t2"), F.col("path").alias("n2"), F.col("path_ids").alias("i2"))
        nxt = cut(
            state.where("ptr is not null").join(step, "ptr")
            .select("cid", F.col("t2").alias("top"), F.col("p2").alias("ptr"), F.concat("n2", "path").alias("path"), F.concat("i2", "path_ids").alias("path_ids"))
            .unionByName(state.where("ptr is null"))
        )
        discard(state)
        state = nxt
    return state


def _rings(ring: DataFrame) -> DataFrame:
    """(top, n_ring, i_ring): the whole loop of every loop node, ending with the parent of the node."""
    open_at_root = F.when(F.col("cid") != F.col("root"), F.col("parent"))
    climbed = _climb(_pieces(ring, open_at_root))
    # the longest path from the root of the loop names all of it; a loop node's place is the length of its own
    whole = climbed.groupBy("top").agg(F.max_by(F.struct("path", "path_ids"), F.size("path")).alias("w"))
    k = F.col("k")
    turned = lambda c: F.concat(F.slice(c, k + 1, F.size(c)), F.slice(c, F.lit(1), k - 1))
    return climbed.select("cid", "top", F.size("path").alias("k")).join(whole, "top").select(
        F.col("cid").alias("top"), turned(F.col("w.path")).alias("n_ring"), turned(F.col("w.path_ids")).alias("i_ring")
    )


def _pieces(nodes: DataFrame, ptr: Column) -> DataFrame:
    return nodes.select("cid", F.col("cid").alias("top"), ptr.alias("ptr"), F.array(F.coalesce("name", F.lit(""))).alias("path"), F.array("id").alias("path_ids"))


def _large(big: DataFrame, shape: DataFrame) -> DataFrame:
    """Paths of components too large for one task, by doubling of path pieces."""
    state = _climb(_pieces(big, F.when(~F.col("in_loop"), F.col("parent"))))
    ring = big.where("in_loop")
    if ring.limit(1).count():
        none = F.array().cast("array<string>")
        state = state.join(_rings(ring), "top", "left").select(
            "cid", F.concat(F.coalesce("n_ring", none), "path").alias("path"), F.concat(F.coalesce("i_ring", none), "path_ids").alias("path_ids")
        )
    return state.join(shape, "cid").select("id", F.col("root_name").alias("root_id"), "depth", "in_loop", "path", "path_ids")


def hierarchy(rows: DataFrame, id: str = "id", parent: str = "parent_id", name: str = "coll_name", modified: str = "modified", paths: bool = True, max_component: int = 100_000) -> DataFrame:
    """One row per node: ``OUT``, without ``path`` and ``path_ids`` unless asked for.  ``path`` runs from the root down to the node itself."""
    links = cut(_linked(current_nodes(rows, id, parent, name, modified)))
    shape = cut(_double(links))
    sizes = cut(shape.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > max_component))
    placed = links.join(shape, "cid")
    small = placed.join(sizes, "root", "left_anti").select("root", "cid", "id", "parent", "name")
    out = small.repartition("root").sortWithinPartitions("root", "cid").mapInPandas(_scan(paths), OUT if paths else OUT[: OUT.index(", path ")])
    if sizes.limit(1).count():
        big = placed.join(sizes, "root", "left_semi")
        roots = links.select(F.col("cid").alias("root"), F.col("id").alias("root_name"))
        named = big.join(roots, "root").select("cid", "id", "root_name", "depth", "in_loop")
        if paths:
            big = cut(big)
            out = out.unionByName(_large(big, named))
        else:
            out = out.unionByName(named.select("id", F.col("root_name").alias("root_id"), "depth", "in_loop"))
    return out


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance): every node under each of its ancestors, a narrow expansion of ``path_ids``."""
    n = F.size("path_ids")
    return tree.select(F.col("id").alias("descendant_id"), F.posexplode(F.slice("path_ids", 1, n - 1)).alias("k", "ancestor_id"), n.alias("n")).select(
        "ancestor_id", "descendant_id", (F.col("n") - 1 - F.col("k")).cast("bigint").alias("distance")
    )
