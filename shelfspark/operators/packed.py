"""Several values packed in one field (problem 7).

Method: expectation-maximisation segmentation.  A field is cut into chunks at every place
that might separate values; quoted, braced and bracketed spans are atomic.  Some separators
are certain, others (a comma between names, ``and``, ``&``, a tight slash) only may be.
What stands between two certain separators is a block; a lattice holds the ways of joining
its chunks.  The E-step runs forward-backward over the lattices of all rows, the M-step
re-estimates the frequencies of values and of value shapes from the whole column, until they
no longer change, and in the end Viterbi picks the likeliest segmentation.

Scale: equal fields are counted before any of it, so a pass sees each field once, and fields
without uncertain separators are counted once only.  A pass is one narrow scan with a map-side
combiner and a small aggregation.  Values and shapes with a relative frequency of at least
``theta`` are broadcast, of which there are at most ``1/theta`` whatever the input
(pigeonhole); rarer values that were met at least twice come to the fields that may hold them
by an equi-join before the last step.  Rows are never grouped, so no key can be hot.

Defined results
* null, blank and separator-only fields give no row
* positions count real values from 1; repeated values keep their own rows
* texts of any length are segmented whole; a value may join any number of chunks, more than
  ``NEAR`` of them where the value or its shape is known from elsewhere in the column
* an empty table gives an empty result; extra columns are ignored
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import cut

#: Chunks that are joined without the value or shape being known; more never outweigh their prior then.
NEAR = 2
WORD_COST = math.log(1e-4)
#: Prior by number of chunks in a value: two are common (family name, given name), more are rare; each further one is a hundred times rarer.
PARTS = lambda n: max(0, n - 2) * math.log(1e-2)
#: Probability of a shape that was not seen, by number of chunks.
UNSEEN = (0.0, 1e-6, 1e-7, 1e-15)
HARD = ";；|\n\r\t、，·¦•"
ALWAYS = {"author": HARD.replace("，", ""), "keywords": HARD + ",", "tags": HARD + ","}
MAYBE = re.compile(r"[,，&/]|\s(?:and|AND|And|et|und|y)\s")
MAYBE_WORD = re.compile(r"\s(and|AND|And|et|und|y)\s")
CLOSERS = {'"': '"', "'": "'", "{": "}", "“": "”", "„": "“", "«": "»", "‘": "’", "[": "]"}


def _closing(s: str, k: int, ends: str) -> int:
    """Index of the mark that closes the span opened at ``k``, or -1: it must be followed by a separator or the end."""
    mark, n, depth = CLOSERS[s[k]], len(s), 0
    j = k + 1
    while j < n:
        c = s[j]
        if c == s[k] and mark != s[k]:
            depth += 1
        elif c == mark:
            if depth:
                depth -= 1
            elif mark == '"' and s[j + 1 : j + 2] == '"':
                j += 1
            else:
                rest = s[j + 1 :].lstrip(" ")
                if not rest or rest[0] in ends or MAYBE_WORD.match(s[j + 1 :]) or (rest[0] in "/&#" and (s[j + 1 : j + 2] == " " or rest[0] != "/")):
                    return j
                if mark == "}":
                    return -1
        j += 1
    return -1


def chunks(s: str, field: str) -> tuple[list[tuple[int, int, bool]], list[str]]:
    """([(start, end, atomic)], separators between them): 'h' is certain, any other mark is not."""
    hard = ALWAYS[field]
    ends = hard + ",/&" + ("#" if field == "tags" else "")
    out: list[tuple[int, int, bool]] = []
    seps: list[str] = []
    n, k, start, sep, atomic = len(s), 0, None, "", False
    last = 0
    signed = s.lstrip().startswith("#")

    def close(end):
        nonlocal start, sep
        if start is not None:
            while end > start and s[end - 1].isspace():
                end -= 1
            if end > start:
                if out:
                    seps.append(sep or "h")
                out.append((start, end, atomic))
                sep = ""
        start = None

    def mark(kind):
        nonlocal sep
        rank = "hand/&,"  # 'h' outranks all; a word or & outranks the comma before it
        if not sep or kind == "h" or (sep == "," and kind != ","):
            sep = kind if kind in rank else "h"

    while k < n:
        c = s[k]
        if start is None:
            if c.isspace() and c not in hard and not (out and MAYBE_WORD.match(s, k)):
                k += 1
                continue
            if c in CLOSERS:
                j = _closing(s, k, ends)
                if j > 0:
                    start, atomic = k, True
                    close(j + 1)
                    k = last = j + 1
                    continue
        kind = ""
        width = 1
        if c in hard:
            kind = "h"
        elif c == "," or (c == "，" and field == "author"):
            kind = ","
        elif c == "/":
            left, right = s[k - 1 : k], s[k + 1 : k + 2]
            kind = "h" if not left or not right or left.isspace() or right.isspace() else "/"
        elif c == "&":
            spaced = s[k - 1 : k].isspace() or s[k + 1 : k + 2].isspace() or k == last
            kind = "&" if spaced else ""
        elif c == "#" and field == "tags" and s[k + 1 : k + 2].strip() and (start is None or signed or s[k - 1].isspace()):
            kind = "h" if start is not None else ""
            width = 0
        elif c.isspace() or k == last:
            m = MAYBE_WORD.match(s, k) or (MAYBE_WORD.match(" " + s[k : k + 5]) if k == last and start is None else None)
            if m:
                kind, width = "a", len(m.group(1)) + (1 if c.isspace() else 0)
        if kind:
            if start is None and kind == "a" and not out:
                kind = ""
            else:
                close(k)
                if out:
                    mark(kind)
                k += width
                last = k
                if width == 0:
                    start, atomic = k, False
                    k += 1
                continue
        if start is None:
            start, atomic = k, False
        if c == '"':  # a quotation inside a value stays whole
            j = s.find('"', k + 1)
            if j > 0 and not any(x in s[k:j] for x in "\n;|"):
                k = j
        k += 1
    close(n)
    return out, seps


@lru_cache(1 << 17)
def tidy(v: str) -> str:
    """A value without surrounding blanks, enclosing marks and tag signs."""
    v = v.strip()
    while len(v) > 1 and v[0] in CLOSERS and v[-1] == CLOSERS[v[0]] and (v[0] != '"' or not re.search(r'(?<!")"(?!")', v[1:-1].replace('""', ""))):
        quote = v[0]
        v = v[1:-1]
        if quote == '"':
            v = v.replace('""', '"')
        v = v.strip()
    return v.lstrip("#").strip() if v.startswith("#") else v


def unwrap(s: str | None) -> str:
    s = (s or "").strip(" ")
    t = s.strip()
    return t[1:-1] if len(t) > 1 and t[0] == "[" and t[-1] == "]" else s


@lru_cache(1 << 17)
def shape(v: str) -> str:
    """Coarse form of a value: capitalised words W, initials I, other words w, numbers 9, marks as they are."""
    v = re.sub(r"\b\w\.(\s*\w\.)*", "I", v)
    v = re.sub(r"\b(and|AND|And|et|und|y)\b", "+", v)
    v = re.sub(r"[^\W\d_][\w'’\-]*", lambda m: "I" if m.group() == "I" else "W" if m.group()[0].isupper() else "w", v)
    v = re.sub(r"\d+", "9", v)
    return re.sub(r"\s+", " ", v)


class Model:
    """Value and shape frequencies and how often each uncertain separator separates; ``long`` is the largest number of chunks of a known value or shape."""

    def __init__(self, values: dict, shapes: dict, splits: dict, long: dict | None = None, exact: float = 0.5):
        self.values, self.shapes, self.splits, self.long, self.exact = values, shapes, splits, long or {}, exact
        self.cuts: dict = {}
        self.seen: dict = {}
        self.held: dict = {}
        for (f, v), p in values.items():
            self.held.setdefault(f, {})[v] = math.log(exact * p)

    def tables(self) -> tuple:
        return self.values, self.shapes, self.splits, self.long

    def of_shape(self, field: str, x: str, parts: int) -> float:
        key = (field, x, parts)
        got = self.seen.get(key)
        if got is None:
            got = math.log((1 - self.exact) * (self.shapes.get((field, x), 0.0) + UNSEEN[min(parts, 3)])) + PARTS(parts)
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[key] = got
        return got

    def apart_from(self, other: "Model") -> float:
        """The largest change of a split, or of the shares of shapes of a field all together."""
        moved: dict = {}
        for k in {*self.shapes, *other.shapes}:
            moved[k[0]] = moved.get(k[0], 0.0) + abs(self.shapes.get(k, 0.0) - other.shapes.get(k, 0.0)) / 2
        splits = [abs(self.splits.get(k, 0.7) - other.splits.get(k, 0.7)) for k in {*self.splits, *other.splits}]
        return max([*moved.values(), *splits], default=0.0)

    def split(self, field: str, sep: str) -> tuple[float, float]:
        """Logarithms of the probabilities that a separator separates, and that it does not."""
        got = self.cuts.get((field, sep))
        if got is None:
            p = min(max(self.splits.get((field, sep), 0.7), 0.02), 0.98)
            got = self.cuts[field, sep] = (math.log(p), math.log(1 - p))
        return got


def blocks(s: str, field: str):
    """[(first chunk, end)] of the spans between certain separators, with the chunks and separators."""
    cs, seps = chunks(s, field)
    starts = [0, *(k + 1 for k, x in enumerate(seps) if x == "h")] if cs else []
    return cs, seps, list(zip(starts, [*starts[1:], len(cs)]))


def apart(s: str, field: str, cs: list, i: int, j: int) -> bool:
    """Whether a value that begins with chunk ``i`` ends before chunk ``j``, because one of them is atomic."""
    return cs[i][2] or (cs[j][2] and (field != "author" or s[cs[j][0]] in "\"'{"))


def weighed(s: str, field: str, cs: list, seps: list, a: int, b: int, model: Model, rare: dict | None = None) -> list[tuple[int, int, str, str, float]]:
    """The lattice of a block: (i, j, value, shape, log score) of the chunks i..j-1 that may be one value."""
    held, cuts = model.held.get(field, {}), [model.split(field, x) for x in seps[a : b - 1]]
    own = [tidy(s[x:y]) for x, y, _ in cs[a:b]]
    form = [shape(v) for v in own]
    cost = [WORD_COST * (v.count(" ") + 1) for v in own]
    far = max(NEAR, model.long.get(field, 0), *(len(MAYBE.findall(v)) + 1 for v in rare or ()))
    out = []
    for i in range(a, b):
        x, w, kept = form[i - a], cost[i - a], 0.0
        for j in range(i + 1, min(b, i + far) + 1):
            v = own[i - a]
            if j > i + 1:
                if apart(s, field, cs, i, j - 1):
                    break
                v = tidy(s[cs[i][0] : cs[j - 1][1]])
                x += shape(s[cs[j - 2][1] : cs[j - 1][0]]) + form[j - 1 - a]
                w += cost[j - 1 - a]
                kept += cuts[j - 2 - a][1]
                if j - i > NEAR and v not in held and (field, x) not in model.shapes and v not in (rare or ()):
                    continue
            q = model.of_shape(field, x, j - i) + w
            p = held.get(v)
            if p is None and rare and v in rare:
                p = math.log(model.exact * rare[v])
            if p is not None:
                q = max(q, p + PARTS(j - i))
            out.append((i, j, v, x, q + kept + (cuts[j - 1 - a][0] if j < b else 0.0)))
    return out


def best(s: str, field: str, model: Model, rare: dict | None = None) -> list[str]:
    """Viterbi segmentation."""
    cs, seps, spans = blocks(s, field)
    out = []
    for a, b in spans:
        if b == a + 1:
            out.append(tidy(s[cs[a][0] : cs[a][1]]))
            continue
        top = {a: 0.0}
        back: dict = {}
        for i, j, v, _, w in weighed(s, field, cs, seps, a, b, model, rare):
            if top[i] + w > top.get(j, -math.inf):
                top[j], back[j] = top[i] + w, (i, v)
        got = []
        while b > a:
            b, v = back[b]
            got.append(v)
        out.extend(reversed(got))
    return [v for v in out if v]


def expected(s: str, field: str, n: float, model: Model | None, into: dict) -> None:
    """Adds the expected counts of a field met ``n`` times to ``into``; without a model, those of values that certain separators bound."""
    cs, seps, spans = blocks(s, field)

    def count(kind, x, p):
        key = (field, kind, x)
        into[key] = into.get(key, 0.0) + p * n

    def add(a, b):
        if a < b:
            a, b = b, a
        return a if b == -math.inf else a + math.log1p(math.exp(b - a))

    for a, b in spans:
        if b == a + 1 or model is None:
            # of names only single chunks are certain; in other fields an uncertain sign is first taken as part of its value
            if (b == a + 1 or field != "author") and not (b > a + 1 and any(c[2] for c in cs[a:b])):
                v = tidy(s[cs[a][0] : cs[b - 1][1]])
                if v:
                    count("v", v, 1.0)
                    count("s", shape(v), 1.0)
            continue
        edges = weighed(s, field, cs, seps, a, b, model)
        fwd, bwd = [-math.inf] * (b - a + 1), [-math.inf] * (b - a + 1)
        fwd[0] = bwd[-1] = 0.0
        for i, j, _, _, w in edges:
            fwd[j - a] = add(fwd[j - a], fwd[i - a] + w)
        for i, j, _, _, w in reversed(edges):
            bwd[i - a] = add(bwd[i - a], bwd[j - a] + w)
        for i, j, v, x, w in edges:
            p = math.exp(fwd[i - a] + w + bwd[j - a] - fwd[-1])
            if p < 1e-3 or not v:
                continue
            count("v", v, p)
            count("s", x, p)
            for k in range(i, j - 1):
                count("n", seps[k], p)
            if j < b:
                count("y", seps[j - 1], p)


def _doubtful():
    """Fields that may hold an uncertain separator; the counts of all others never change."""
    word = r"\s(and|AND|And|et|und|y)\s"
    return F.when(F.col("field") == "author", F.col("packed").rlike(r"[,，&/]|" + word)).otherwise(F.col("packed").rlike(r"[&/]|" + word))


def _e_step(rows: DataFrame, model: Model | None) -> DataFrame:
    """(field, kind, val, n): expected counts over (field, packed, times)."""
    shared = rows.sparkSession.sparkContext.broadcast(model and model.tables())

    def scan(batches):
        import pandas as pd

        m = shared.value and Model(*shared.value)
        into: dict = {}

        def flush():
            keys = list(into)
            frame = pd.DataFrame([(*k, into[k]) for k in keys], columns=["field", "kind", "val", "n"]).astype({"n": "float64"})
            into.clear()
            return frame

        for pdf in batches:
            for field, s, times in zip(pdf["field"], pdf["packed"], pdf["times"].tolist()):
                expected(unwrap(s), field, times, m, into)
            if len(into) > 200_000:
                yield flush()
        yield flush()

    return rows.mapInPandas(scan, "field string, kind string, val string, n double").groupBy("field", "kind", "val").agg(F.sum("n").alias("n"))


def _m_step(counts: DataFrame, theta: float) -> tuple[Model, DataFrame]:
    """The model of the counts, and the values too rare for the model with their frequencies."""
    got = cut(counts.groupBy("field", "kind", "val").agg(F.sum("n").alias("n")))
    totals = {(r.field, r.kind): r.n for r in got.groupBy("field", "kind").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return Model({}, {}, {}), got.select("field", "val", F.col("n").alias("p"))
    amount = lambda of: F.coalesce(*[F.when((F.col("field") == f) & (F.col("kind") == k), F.lit(of(n))) for (f, k), n in totals.items()])
    often = F.col("n") >= amount(lambda n: theta * n)
    met = (F.col("n") > 1.5) | (F.col("kind") != "v")
    kept = got.where(often & met).collect()  # at most 1/theta per field and kind
    rare = got.where("kind = 'v'").where(~often & met).select("field", "val", (F.col("n") / amount(lambda n: n)).alias("p"))
    table: dict = {"v": {}, "s": {}, "y": {}, "n": {}}
    for r in kept:
        table[r.kind][(r.field, r.val)] = r.n
    values = {k: n / totals[(k[0], "v")] for k, n in table["v"].items()}
    shapes = {k: n / totals[(k[0], "s")] for k, n in table["s"].items()}
    splits = {k: (table["y"].get(k, 0) + 1) / (table["y"].get(k, 0) + table["n"].get(k, 0) + 2) for k in {*table["y"], *table["n"]}}
    long: dict = {}
    for f, v in [*values, *shapes]:
        if len(MAYBE.findall(v.replace("+", "&"))) >= NEAR:
            long[f] = max(long.get(f, 0), len(chunks(v.replace("+", "&"), f)[0]))
    return Model(values, shapes, splits, long), rare


def _rare_values(rows: DataFrame, id: str, rare: DataFrame) -> DataFrame:
    """``rows`` with the rare values, and their frequencies, that they may hold: (id, field, packed, vals, ps)."""
    kind = dict(rows.dtypes)[id]
    far = (rare.agg(F.max(F.regexp_count("val", F.lit(MAYBE.pattern)))).first()[0] or 0) + 1  # chunks of the longest

    def spans(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for i, field, s in zip(pdf[id].tolist(), pdf["field"], pdf["packed"]):
                s = unwrap(s)
                cs, _, found = blocks(s, field)
                out.extend((i, field, v) for v in {tidy(s[cs[x][0] : cs[y - 1][1]]) for a, b in found if b > a + 1 for x in range(a, b) for y in range(x + 1, min(b, x + far) + 1)})
            yield pd.DataFrame({id: pd.Series([o[0] for o in out], dtype=object), "field": pd.Series([o[1] for o in out], dtype=object), "val": pd.Series([o[2] for o in out], dtype=object)})

    held = rows.mapInPandas(spans, f"{id} {kind}, field string, val string").join(rare, ["field", "val"])
    return held.groupBy(id, "field").agg(F.collect_list("val").alias("vals"), F.collect_list("p").alias("ps"))


def unpack(rows: DataFrame, id: str = "import_id", fields: tuple[str, ...] = ("author", "keywords", "tags"), rounds: int = 20, tolerance: float = 1e-2, theta: float = 1e-5) -> DataFrame:
    """(id, field, pos, val): one row per packed value."""
    long = rows.select(id, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("packed")) for f in fields])).alias("x")).select(id, "x.field", "x.packed")
    long = long.where("packed rlike '[^\\\\s]'")
    counted = long.groupBy("field", "packed").agg(F.count(F.lit(1)).alias("times"))
    settled = cut(_e_step(counted.where(~_doubtful()), None))
    open_rows = cut(counted.where(_doubtful()))
    model, before = None, None
    for _ in range(rounds):
        model, rare = _m_step(_e_step(open_rows, model).unionByName(settled), theta)
        if before is not None and before.apart_from(model) <= tolerance:
            break
        before = model
    kind = dict(rows.dtypes)[id]
    shared = rows.sparkSession.sparkContext.broadcast(model.tables())

    def decode(batches):
        import pandas as pd

        m = Model(*shared.value)
        for pdf in batches:
            ids, names, pos, val = [], [], [], []
            for i, field, s, vs, ps in zip(pdf[id], pdf["field"], pdf["packed"], pdf["vals"], pdf["ps"]):
                for k, v in enumerate(best(unwrap(s), field, m, dict(zip(vs, ps)) if vs is not None else None), 1):
                    ids.append(i)
                    names.append(field)
                    pos.append(k)
                    val.append(v)
            text = {"dtype": object}  # an empty list would become numbers
            yield pd.DataFrame({id: pd.Series(ids, dtype=pdf[id].dtype), "field": pd.Series(names, **text), "pos": pd.Series(pos, dtype="int64"), "val": pd.Series(val, **text)})

    extra = _rare_values(long.where(_doubtful()), id, rare)
    return long.join(extra, [id, "field"], "left").mapInPandas(decode, f"{id} {kind}, field string, pos bigint, val string")
