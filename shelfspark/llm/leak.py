"""Evaluation texts leaking into training text (problem 8).

Method: size-partitioned MinHash containment search.  Word sequences (shingles of five words)
get exact numbers from the words of the items, so a shingle of a document that no item holds
is recognised at once and left out.  Items are partitioned by length; what is left of a
document is cut into overlapping windows of the length of each partition, so that a short item
inside a long document is compared with a text of its own size.  A window whose minwise
shingles meet one of an item's in any of ``PERMUTATIONS`` places is a candidate, which is then
verified by exact shingle containment: the item's words covered by shared shingles, in one
place of the document, over the item's length.

An opening sentence that many items share is an instruction and set aside; which sentences
these are is counted over all items, whatever their length.

Scale: the items are a stated query set, searched against all rows in blocks of ``block``
words, so the driver holds one block at a time and what is broadcast is bounded by that
parameter.  The corpus is read in one narrow scan for each block and never shuffled;
documents are not grouped, so no key can be hot.  Verification is linear in the words of the
document and of the item, however repetitive they are.

Defined results
* case, punctuation, line breaks, hyphenation and sentence order do not matter
* a gap of at most ``GAP`` changed words between two shingles counts as covered where the document has a like gap
* null and blank texts leak nothing; an item shorter than a shingle is searched as a whole, and
  one whose third is shorter by word sequences of that length, both exactly and without sketches
* repeated documents are each reported; an empty table gives an empty result; extra columns are ignored
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import cut, discard

SHINGLE = 5
PERMUTATIONS = 128
GAP = 4
THIRD = 1 / 3
#: Words of documents looked up at once.
AT_ONCE = 1_000_000
HYPHEN = re.compile(r"(?<=\w)[-‐‑­]\s*(?:>\s*)?(?=\w)")
WORD = re.compile(r"[^\W_]+")
LEAD = re.compile(r"\s*(\S+\s.*?[.?!:])\s+(?=\S)", re.S)
#: How longer sequences are put together from shorter ones.
LADDER = {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (4, 1)}


def tokens(text: str) -> list[str]:
    return WORD.findall(HYPHEN.sub("", text.lower()))


def opening(text: str) -> list[str]:
    """Words of the first sentence where more follows."""
    m = LEAD.match(text)
    return tokens(m.group(1)) if m else []


def reach(length: int) -> int:
    """Words in a shingle for an item of that length: never more than what has to be found of it."""
    return length if length < SHINGLE else min(SHINGLE, -(-length // 3))


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bridge(size: int, early: list[int], late: list[int], step: int) -> list[int]:
    """Item words between two shingles that lie ``step`` words apart in a document and about as far in the item."""
    out: set[int] = set()
    for i in early:
        k = bisect_right(late, i + size)
        while k < len(late) and late[k] - i - size <= GAP:
            if abs(late[k] - i - step) <= GAP:
                out.update(range(i + size, late[k]))
            k += 1
    return sorted(out)


def most_covered(length: int, size: int, starts: list, at: list[int], what: list[int], span: int) -> int:
    """
    The largest number of an item's words that shared shingles, and the short gaps between neighbouring ones, cover within ``span`` words of a document.
    starts: the item places of each shingle; at, what: places in the document, in order, and the shingle there.
    A shingle leaves the window only where it is farther than ``span`` from its next place, so all steps together are linear.
    """
    number: dict = {}
    words: list[list[int]] = []  # of shingles and of bridges between two of them
    seen: list[tuple[int, int]] = []
    before = None
    for d, s in zip(at, what):
        if before is not None and 1 < d - before[0] <= size + 2 * GAP:
            key = (before[1], s, d - before[0])
            if key not in number:
                number[key] = len(words)
                words.append(_bridge(size, starts[before[1]], starts[s], d - before[0]))
            if words[number[key]]:
                seen.append((d, number[key]))
        if s not in number:
            number[s] = len(words)
            words.append(sorted({w for i in starts[s] for w in range(i, i + size)}))
        seen.append((d, number[s]))
        before = (d, s)
    times, cover = [0] * len(words), [0] * length
    total = best = lo = 0
    for d, s in seen:
        times[s] += 1
        if times[s] == 1:
            for w in words[s]:
                total += not cover[w]
                cover[w] += 1
        while d - seen[lo][0] > span:
            s = seen[lo][1]
            times[s] -= 1
            if not times[s]:
                for w in words[s]:
                    cover[w] -= 1
                    total -= not cover[w]
            lo += 1
        best = max(best, total)
    return best


class Index:
    """Items of one block: exact numbers of their word sequences, minwise keys by size partition, and the places of their shingles."""

    def __init__(self, items: list[tuple[int, list[str]]], permutations: int = PERMUTATIONS):
        import numpy as np

        self.ids = [i for i, _ in items]
        self.lengths = [len(w) for _, w in items]
        self.sizes = [reach(n) for n in self.lengths]
        self.number: dict[str, int] = {}
        flat: list[int] = []
        first = []
        for _, words in items:
            first.append(len(flat))
            flat.extend(self.number.setdefault(w, len(self.number)) for w in words)
            flat.append(-1)
        ids = np.array(flat, dtype=np.int64)
        self.tables, memo = {1: np.arange(len(self.number))}, {1: ids}
        wanted = {k for k in self.sizes if k}
        for k in (2, 3, 4, 5):
            if any(k in (w, *LADDER.get(w, ()), *(x for y in LADDER.get(w, ()) for x in LADDER.get(y, ()))) for w in wanted):
                known, code = self._codes(memo, k)
                self.tables[k] = np.unique(code[known])
                memo[k] = self._ranks(memo, k)
        self.seeds = _mix(np.arange(1, permutations + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.shingles, self.starts = [], []  # of each item: its shingles in order of number, and their places
        parts: dict[int, list] = {}
        self.owners: dict[int, dict[int, list[int]]] = {}
        for n, (a, length, size) in enumerate(zip(first, self.lengths, self.sizes)):
            own = memo[size][a : a + length - size + 1] if size else np.zeros(0, dtype=np.int64)
            unique, back = np.unique(own, return_inverse=True)
            places: list[list[int]] = [[] for _ in unique]
            for place, u in enumerate(back.tolist()):
                places[u].append(place)
            self.shingles.append(unique)
            self.starts.append(places)
            if size == SHINGLE:
                parts.setdefault(max(16, 1 << (length - 1).bit_length()), []).append((self._keys(self._hashed(unique).min(axis=1)), n))
            else:
                for u in unique.tolist():
                    self.owners.setdefault(size, {}).setdefault(u, []).append(n)
        self.parts = []
        for size, got in sorted(parts.items()):
            keys = np.concatenate([k for k, _ in got])
            owner = np.repeat([n for _, n in got], permutations)
            order = np.argsort(keys, kind="stable")
            self.parts.append((size, keys[order], owner[order]))

    def _codes(self, memo: dict, k: int):
        import numpy as np

        a, b = LADDER[k]
        n = max(0, len(memo[1]) - k + 1)
        left, right = memo[a][:n], memo[b][a : a + n]
        return (left >= 0) & (right >= 0), left * np.int64(max(1, len(self.tables[b]))) + right

    def _ranks(self, memo: dict, k: int):
        """The number of the sequence of ``k`` words at each place, -1 where no item holds it."""
        import numpy as np

        if k not in memo:
            for x in LADDER[k]:
                memo[x] = self._ranks(memo, x)
            known, code = self._codes(memo, k)
            table, out = self.tables[k], np.full(len(code), -1, dtype=np.int64)
            if len(table):
                at = np.flatnonzero(known)
                r = np.searchsorted(table, code[at])
                r[r == len(table)] = 0
                ok = table[r] == code[at]
                out[at[ok]] = r[ok]
            memo[k] = out
        return memo[k]

    def _hashed(self, ranks):
        """Hashes of shingles, one row for each permutation."""
        import numpy as np

        return _mix(_mix((ranks + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :] ^ self.seeds[:, None])

    def _keys(self, low):
        """The place is mixed into a minwise shingle, so one sorted array serves all places."""
        return _mix(low ^ (self.seeds >> 7 if low.ndim == 1 else (self.seeds >> 7)[:, None]))

    def _candidates(self, at, ranks) -> set[int]:
        """Items one of whose minwise shingles is minwise in a window of their size."""
        import numpy as np

        found: set[int] = set()
        mixed = self._hashed(ranks)
        for size, keys, owner in self.parts:
            cell = at // (size // 2)  # windows of two cells overlap by half
            start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            low = np.minimum.reduceat(mixed, start, axis=1)
            cell = cell[start]
            beside = cell[1:] == cell[:-1] + 1
            low = np.concatenate([low, np.minimum(low[:, :-1], low[:, 1:])[:, beside]], axis=1)
            k = self._keys(low).ravel()
            left, right = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
            for a, b in zip(left[right > left].tolist(), right[right > left].tolist()):
                found.update(owner[a:b].tolist())
        return found

    def _share(self, n: int, at, ranks) -> float:
        """The share of an item's words covered by shared shingles in one place."""
        import numpy as np

        mine = self.shingles[n]
        k = np.searchsorted(mine, ranks)
        k[k == len(mine)] = 0
        ok = mine[k] == ranks
        return most_covered(self.lengths[n], self.sizes[n], self.starts[n], at[ok].tolist(), k[ok].tolist(), 2 * self.lengths[n]) / self.lengths[n]

    def look(self, texts: list[list[str]]) -> list[tuple[int, int, float]]:
        """(number of the text, item id, share) of texts given as words."""
        import numpy as np

        get = self.number.get
        flat: list[int] = []
        first = []
        for words in texts:
            first.append(len(flat))
            flat.extend([get(w, -1) for w in words])
            flat.append(-1)
        memo = {1: np.array(flat, dtype=np.int64)}
        out = []
        for size in ([SHINGLE] if self.parts else []) + sorted(self.owners):
            ranks = self._ranks(memo, size)
            at = np.flatnonzero(ranks >= 0)
            if not len(at):
                continue
            ranks = ranks[at]
            doc = np.searchsorted(first, at, "right") - 1
            edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                d = int(doc[a])
                here, what = at[a:b] - first[d], ranks[a:b]
                if size == SHINGLE:
                    cand = self._candidates(here, what)
                else:
                    own = self.owners[size]
                    cand = {n for u in set(what.tolist()) for n in own.get(u, ())}
                out.extend((d, self.ids[n], self._share(n, here, what)) for n in cand)
        return out

    def search(self, text: str) -> list[tuple[int, float]]:
        return [(i, s) for _, i, s in self.look([tokens(text)])]


def query_words(items: DataFrame, item_id: str, text: str, shared_by: int = 3) -> DataFrame:
    """(id, ws): the words of each item without an opening sentence that at least ``shared_by`` items have."""
    kind = dict(items.dtypes)[item_id]

    def scan(batches):
        import pandas as pd

        for pdf in batches:
            lead = [opening(t) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "ws": [tokens(t) for t in pdf["text"]], "lead": [" ".join(x) for x in lead], "n": pd.Series([len(x) for x in lead], dtype="int32")})

    words = items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).where("text is not null").mapInPandas(scan, f"id {kind}, ws array<string>, lead string, n int").where("size(ws) > 0")
    leads = words.where("n > 0 and size(ws) > n").groupBy("lead").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= shared_by).withColumn("drop", F.lit(True))
    rest = F.when(F.col("drop") & (F.size("ws") > F.col("n")), F.slice("ws", F.col("n") + 1, F.size("ws"))).otherwise(F.col("ws"))
    return words.join(leads.select("lead", "drop"), "lead", "left").select("id", rest.alias("ws"))


def _blocks(words: DataFrame, most: int):
    """Items in blocks of at least one item and else at most ``most`` words; only one block is held at a time."""
    block, n = [], 0
    for r in words.toLocalIterator():
        if block and n + len(r.ws) > most:
            yield block
            block, n = [], 0
        block.append((r.id, list(r.ws)))
        n += len(r.ws)
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, id: str = "doc_id", item_id: str = "item_id", text: str = "text", least: float = THIRD, block: int = 500_000) -> DataFrame:
    """(doc_id, item_id, share): documents that hold at least ``least`` of an item; ``block`` is the number of item words broadcast at once."""
    spark = docs.sparkSession
    schema = f"{id} {dict(docs.dtypes)[id]}, {item_id} {dict(items.dtypes)[item_id]}, share double"
    staged = cut(query_words(items, item_id, text))
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).where("text is not null")
    out = spark.createDataFrame([], schema)
    for k, part in enumerate(_blocks(staged, block)):
        shared = spark.sparkContext.broadcast(part)

        def scan(batches, shared=shared):
            import pandas as pd

            index = Index(shared.value)

            def found(ids, texts):
                got = [(ids[d], i, s) for d, i, s in index.look(texts) if s >= least]
                # typed, because an empty list would become numbers
                return pd.DataFrame({id: pd.Series([g[0] for g in got], dtype=object), item_id: pd.Series([g[1] for g in got], dtype=object), "share": pd.Series([g[2] for g in got], dtype="float64")})

            ids, texts, n = [], [], 0
            for pdf in batches:
                for i, t in zip(pdf["id"].tolist(), pdf["text"]):
                    words = tokens(t)
                    ids.append(i)
                    texts.append(words)
                    n += len(words)
                    if n > AT_ONCE:
                        yield found(ids, texts)
                        ids, texts, n = [], [], 0
            yield found(ids, texts)

        found = rows.mapInPandas(scan, schema)
        out = found if not k else out.unionByName(found)
    discard(staged)
    return out
