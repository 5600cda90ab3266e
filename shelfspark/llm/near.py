"""Near-duplicate records with small edits (problem 2).

Method: chosen-path set similarity join.  The words of a record, counted with repeats, form
a set.  In each of several independent trees a record starts at the root and goes on to the
children named by those of its minwise tokens whose hash, together with the path so far,
falls under a threshold; alike records choose the same tokens and meet again.  Nodes of at
most ``limit`` records are compared exhaustively, larger ones branch again; a node that stays
large at ``max_depth`` is compared in blocks, exhaustively.  Candidates pass a 128-bit sketch
(four deviations below the expected agreement, in the blocks too, so about 4e-5 of the pairs
right at the threshold are found by no tree) and are then verified on the whole sets.

Scale: records with one bag of words are one class, so copies, even a third of all rows,
weigh as one record.  Paths are a narrow, vectorised expansion; what is shuffled is 32 bytes
for each (node, class), sorted by node and scanned, so no node is ever collected.  Trees begin
at a depth where nodes are still somewhat large, because a pair that meets early is compared
early: that needs fewer trees for the same recall.

Defined results
* similarity is the Jaccard similarity of bags (multisets) of words, threshold 0.7 unless given
* records without any word are alike to none
* links hold between different wordings or word orders; equal wordings are one class
* a pair is dropped only where both titles end in the number of a part and the numbers differ
* nulls count as empty; texts of any length are taken whole
* an empty table gives an empty result; extra columns are ignored
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import cut, discard
from .formatting import PUNCTUATION, canonical_record

COORDS = 64
SKETCH = 128
NODE = "node bigint, cid bigint, s0 bigint, s1 bigint"


def words(*columns: str) -> Column:
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    return F.array_remove(F.split(F.regexp_replace(text, PUNCTUATION, " "), " "), "")


def _mix(x):
    """The finaliser of splitmix64 on arrays of uint64."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bag(batches):
    """Word hashes to a set of (word, occurrence) hashes with its minwise tokens and sketch."""
    import numpy as np
    import pandas as pd

    golden = np.uint64(0x9E3779B97F4A7C15)
    # the words are mixed, so one odd factor a place makes a minwise hash
    factors = (_mix(np.arange(1, COORDS + SKETCH + 1, dtype=np.uint64) * golden) | np.uint64(1))[:, None]
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for pdf in batches:
        elems, tokens, sketch = [], [], np.zeros((len(pdf), 2), dtype=np.int64)
        for row, ws in enumerate(pdf["ws"]):
            w, n = np.unique(np.asarray(ws, dtype=np.int64).view(np.uint64), return_counts=True)
            if n.max(initial=1) > 1:
                w = np.repeat(w, n)
                w = _mix(w + (np.arange(len(w), dtype=np.uint64) - np.repeat(np.cumsum(n) - n, n).astype(np.uint64)) * golden)
            else:
                w = _mix(w)
            mins = (w[None, :4096] * factors).min(axis=1)
            for a in range(4096, len(w), 4096):  # long texts in slices
                mins = np.minimum(mins, (w[None, a : a + 4096] * factors).min(axis=1))
            low = _mix(mins[COORDS:]) & np.uint64(1)
            sketch[row] = np.array([(low[:64] * bits).sum(), (low[64:] * bits).sum()], dtype=np.uint64).view(np.int64)
            elems.append(np.sort(w.view(np.int64)))
            tokens.append((mins[:COORDS] >> np.uint64(32)).astype(np.uint32).view(np.int32))
        yield pd.DataFrame({"cid": pdf["cid"], "elems": elems, "tokens": tokens, "s0": sketch[:, 0], "s1": sketch[:, 1]})


def _expand(trees: int, depth: int, lam: float, from_root: bool):
    """Children of nodes: of all roots down to ``depth``, or of the given nodes one level down."""

    def run(batches):
        import numpy as np
        import pandas as pd

        bar = np.uint64(int(2**64 / (lam * COORDS)) - 1)
        place = _mix(np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))[None, :]
        for pdf in batches:
            if not len(pdf):
                continue
            token = _mix(np.vstack(pdf["tokens"].to_numpy()).view(np.uint32).astype(np.uint64) ^ place)
            for part in range(0, len(pdf), 2000):
                tok = token[part : part + 2000]
                rows = np.arange(len(tok))
                starts = [_mix(np.full(len(rows), t + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for t in range(trees)] if from_root else [pdf["node"].to_numpy()[part : part + 2000].view(np.uint64)]
                for node in starts:
                    at = rows
                    for _ in range(depth):
                        child = _mix(tok[at] ^ node[:, None])
                        r, c = np.nonzero(_mix(child ^ np.uint64(0xA0761D6478BD642F)) < bar)
                        at, node = at[r], child[r, c]
                    if len(at):
                        yield pd.DataFrame({"node": node.view(np.int64), **{k: pdf[k].to_numpy()[part + at] for k in ("cid", "s0", "s1")}})

    return run


def _compare(limit: int, least: int):
    """Scan of (node, cid, s0, s1) sorted by node: candidate pairs of small nodes, (null, a, b, null); rows of large ones as they are."""

    def run(batches):
        import numpy as np
        import pandas as pd

        def pairs_of(size, place, cid, s0, s1):
            found = []
            at = np.arange(len(cid))
            for k in range(1, limit):
                at = at[place[at] + k < size[at]]
                if not len(at):
                    break
                x = np.bitwise_count((s0[at] ^ s0[at + k]).view(np.uint64)).astype(np.int16) + np.bitwise_count((s1[at] ^ s1[at + k]).view(np.uint64))  # of signed numbers it would count the bits of the absolute value
                i = at[x <= SKETCH - least]
                if len(i):
                    found.append((np.minimum(cid[i], cid[i + k]), np.maximum(cid[i], cid[i + k])))
            if found:
                ab = np.unique(np.stack([np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]), axis=1)
                ab = ab[:, ab[0] != ab[1]]
                yield pd.DataFrame({"node": pd.array([None] * ab.shape[1], dtype="Int64"), "cid": ab[0], "s0": ab[1], "s1": pd.array([None] * ab.shape[1], dtype="Int64")})

        def work(cols, last):
            """Handles all complete nodes of ``cols``; returns what has to wait for the next batch."""
            node = cols[0]
            cutoff = len(node) if last else np.searchsorted(node, node[-1], side="left")
            done, rest = [c[:cutoff] for c in cols], [c[cutoff:] for c in cols]
            n = done[0]
            if len(n):
                first = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
                size = np.diff(np.r_[first, len(n)])
                per = np.repeat(size, size)
                few = (per > 1) & (per <= limit)
                place = np.arange(len(n)) - np.repeat(first, size)
                yield from pairs_of(*[c[few] for c in (per, place, *done[1:])])
                many = per > limit
                if many.any():
                    yield pd.DataFrame({"node": pd.array(n[many], dtype="Int64"), "cid": done[1][many], "s0": done[2][many], "s1": pd.array(done[3][many], dtype="Int64")})
            return rest

        held, through = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            cols = [pdf[k].to_numpy() for k in ("node", "cid", "s0", "s1")]
            if through is not None:  # a large node under way goes through without being held
                stop = np.searchsorted(cols[0], through, side="right")
                if stop:
                    yield pd.DataFrame({"node": pd.array(cols[0][:stop], dtype="Int64"), "cid": cols[1][:stop], "s0": cols[2][:stop], "s1": pd.array(cols[3][:stop], dtype="Int64")})
                cols = [c[stop:] for c in cols]
                if not len(cols[0]):
                    continue
                through = None
            if held is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols)]
            held = yield from work(cols, False)
            if len(held[0]) > limit:
                through = held[0][0]
                yield pd.DataFrame({"node": pd.array(held[0], dtype="Int64"), "cid": held[1], "s0": held[2], "s1": pd.array(held[3], dtype="Int64")})
                held = None
            elif not len(held[0]):
                held = None
        if held is not None:
            yield from work(held, True)

    return run


def classes(df: DataFrame, id: str, columns: tuple[str, ...], record: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """
    Members (row_id, cid, p4, word_order) of all rows with words, and classes (cid, elems, tokens, s0, s1), both staged.
    A class is one bag of words; ``cid`` is its smallest row id.
    """
    w = words(*columns)
    rows = df.select(F.col(id).cast("bigint").alias("row_id"), w.alias("w"), (F.xxhash64(record) if record is not None else F.lit(0).cast("bigint")).alias("p4")).where(F.size("w") > 0)
    small = cut(rows.select("row_id", "p4", F.md5(F.array_join(F.sort_array("w"), " ")).alias("bag"), F.xxhash64("w").alias("word_order")))
    cid = small.groupBy("bag").agg(F.min("row_id").alias("cid"))
    member = cut(small.join(cid, "bag").select("row_id", "cid", "p4", "word_order"))
    discard(small)
    # words are carried only for the first record of each bag
    first = rows.select(F.col("row_id").alias("cid"), F.transform("w", lambda x: F.xxhash64(x)).alias("ws")).join(member.where("row_id = cid").select("cid"), "cid", "left_semi")
    sets = cut(first.mapInPandas(_bag, "cid bigint, elems array<bigint>, tokens array<int>, s0 bigint, s1 bigint"))
    return member, sets


def similar_classes(sets: DataFrame, threshold: float = 0.7, lam: float = 0.65, trees: int = 14, limit: int = 512, max_depth: int = 12) -> DataFrame:
    """(cid_a, cid_b, similarity) of all classes at least ``threshold`` alike."""
    total = sets.count()
    least = math.floor(SKETCH * ((1 + threshold) / 2) - 4 * math.sqrt(SKETCH * (1 + threshold) / 2 * (1 - threshold) / 2))
    depth = max(1, math.floor(math.log(max(total / limit, 1)) / math.log(8)))
    nodes = sets.select("cid", "tokens", "s0", "s1").mapInPandas(_expand(trees, depth, lam, True), NODE)
    found, staged = [], []
    while True:
        scanned = cut(nodes.repartition("node").sortWithinPartitions("node").mapInPandas(_compare(limit, least), NODE))
        staged.append(scanned)
        found.append(scanned.where("node is null").select(F.col("cid").alias("a"), F.col("s0").alias("b")))
        large = scanned.where("node is not null")
        if depth >= max_depth or not large.limit(1).count():
            break
        depth += 1
        nodes = large.join(sets.select("cid", "tokens"), "cid").mapInPandas(_expand(1, 1, lam, False), NODE)
    if depth >= max_depth:
        found.append(_blocks(large, limit, least))
    cand = found[0]
    for f in found[1:]:
        cand = cand.unionByName(f)
    cand = cut(cand.distinct())
    left = sets.select(F.col("cid").alias("a"), F.col("elems").alias("ea"))
    right = sets.select(F.col("cid").alias("b"), F.col("elems").alias("eb"))
    both = F.size(F.array_intersect("ea", "eb"))
    sim = both / (F.size("ea") + F.size("eb") - both)
    links = cut(
        cand.join(left, "a").join(right, "b").select(F.col("a").alias("cid_a"), F.col("b").alias("cid_b"), sim.alias("similarity")).where(F.col("similarity") >= threshold)
    )
    discard(*staged, cand)
    return links


def _blocks(large: DataFrame, limit: int, least: int) -> DataFrame:
    """Nodes that stay large: all sketches compared, block against block, so no task holds a whole node."""
    k = large.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / (8 * limit)).cast("int").alias("k"))
    x = large.join(k, "node").withColumn("i", F.pmod(F.xxhash64("cid"), F.col("k").cast("bigint")).cast("int"))
    a = x.withColumn("j", F.explode(F.sequence(F.col("i"), F.col("k") - 1))).select("node", "i", "j", F.col("cid").alias("ca"), F.col("s0").alias("a0"), F.col("s1").alias("a1"))
    b = x.withColumnRenamed("i", "j").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j")))).select("node", "i", "j", F.col("cid").alias("cb"), F.col("s0").alias("b0"), F.col("s1").alias("b1"))
    apart = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    return a.join(b, ["node", "i", "j"]).where((F.col("ca") != F.col("cb")) & (apart <= SKETCH - least)).select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))


def _roman(n: int) -> str:
    out = ""
    for v, r in ((10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out, n = out + r * (n // v), n % v
    return out


ROMAN = {_roman(n): str(n) for n in range(1, 40)}  # all that is written with i, v and x


def designator(title: Column) -> Column:
    """The number of the part or volume a title ends with, in plain digits; null where it names none."""
    x = F.regexp_extract(F.lower(title), r"\b(?:part|teil|partie|parte|vol|volume|band|no)\W+([ivx]+|\d+)\W*$", 1)
    table = F.create_map(*[F.lit(v) for kv in ROMAN.items() for v in kv])
    return F.when(x != "", F.coalesce(F.try_element_at(table, x), F.regexp_replace(x, r"^0+(?=\d)", "")))


def near_pairs(df: DataFrame, id: str = "row_id", columns: tuple[str, ...] = ("title", "author", "abstract", "pub_year"), title: str = "title", threshold: float = 0.7, skip: tuple[str, ...] = ("row_id", "added", "modified")) -> DataFrame:
    """(row_id_a, row_id_b): rows of one work in different wording or word order; rows that differ in formatting only are left out."""
    member, sets = classes(df, id, columns, canonical_record(df, skip))
    links = similar_classes(sets, threshold)
    discard(sets)
    part = df.select(F.col(id).cast("bigint").alias("row_id"), designator(F.col(title)).alias("part"))
    member = member.join(part, "row_id")
    a = member.select(F.col("cid").alias("cid_a"), F.col("row_id").alias("ra"), F.col("p4").alias("pa"), F.col("part").alias("ta"))
    b = member.select(F.col("cid").alias("cid_b"), F.col("row_id").alias("rb"), F.col("p4").alias("pb"), F.col("part").alias("tb"))
    across = links.select("cid_a", "cid_b").join(a, "cid_a").join(b, "cid_b")
    # one bag in several word orders: the orders are paired first, their rows after that
    orders = member.groupBy("cid", "word_order").agg(F.count(F.lit(1)).alias("n"))
    o1, o2 = orders.select("cid", F.col("word_order").alias("o1")), orders.select("cid", F.col("word_order").alias("o2"))
    within = (
        o1.join(o2, "cid").where("o1 < o2")
        .join(member.select("cid", F.col("word_order").alias("o1"), F.col("row_id").alias("ra"), F.col("p4").alias("pa"), F.col("part").alias("ta")), ["cid", "o1"])
        .join(member.select("cid", F.col("word_order").alias("o2"), F.col("row_id").alias("rb"), F.col("p4").alias("pb"), F.col("part").alias("tb")), ["cid", "o2"])
    )
    cols = ["ra", "rb", "pa", "pb", "ta", "tb"]
    both = across.select(*cols).unionByName(within.select(*cols))
    both = both.where((F.col("pa") != F.col("pb")) & ~F.coalesce(F.col("ta") != F.col("tb"), F.lit(False)))
    return both.select(F.least("ra", "rb").alias("row_id_a"), F.greatest("ra", "rb").alias("row_id_b"))


def near_classes(df: DataFrame, id: str = "row_id", columns: tuple[str, ...] = ("title", "author", "abstract", "pub_year"), threshold: float = 0.7) -> DataFrame:
    """One row per record: (row_id, class_id, n_links), the links of its class to other classes."""
    member, sets = classes(df, id, columns)
    links = similar_classes(sets, threshold)
    discard(sets)
    ends = links.select(F.col("cid_a").alias("class_id")).unionByName(links.select(F.col("cid_b").alias("class_id"))).groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    return member.select("row_id", F.col("cid").alias("class_id")).join(ends, "class_id", "left").select("row_id", "class_id", F.coalesce("n", F.lit(0)).alias("n_links"))
