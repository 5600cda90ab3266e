"""Best representative of each duplicate group (problem 1).

Method: currency reasoning.  Each value gets a soundness verdict and a state, the style it is
written in.  From the timestamped members the precedence of states is learned: in how many
groups the last sight of one state lies before the first sight of another.  A transition that
prevails makes an edge between states; cycles are contracted and the rest is closed
transitively, which gives a strict partial order of states.  Within a group and field the sound
values of the most trusted origin are partially ordered: two timestamped values by their times,
a value without time against any other by the order of their states.  Where times and states
contradict each other, the values on such a cycle are one place in the order.  A topologically
latest value survives; of several, undetermined among themselves, one with the latest time,
then the one with the smallest member id.

Scale: soundness is decided in one scan whose result is staged.  Members are reduced to two
candidates for each (group, field, trust, state) on the map side, of which there are few, so a
group holding a third of all rows is never collected.  States are made from a few fixed styles
(``_state``), at most ``STATES`` a field, so the learned order is small whatever the input.

Defined results
* a missing, blank, stand-in, cut, abbreviated, garbled or malformed value never survives;
  a field without any sound value gives no row
* a value is cut when it ends or begins with an omission mark, and a doi also when it is a
  proper prefix of another doi of its group
* an abstract met in at least ``repeats`` groups is a stand-in
* an origin that is null or not in the origins table ranks below all others
* repeated members change nothing; an empty table gives an empty result; extra columns are ignored
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import cut

STATES = 40  # lengths are counted in doublings, words up to nine
FIELDS = ("doi", "abstract", "journal", "pages")
OMISSION = r"(\.\.\.|…|\[\.\.\.\]|\[…\]|\((more|truncated|continued|cut|abridged)\)|\[(more|truncated|continued)\])"
#: Words and phrases that stand in for a value.
STAND_IN = r"^\W*$|^\W*(none|null|nil|n/?a|n\.a\.|tbd|tba|tbc|todo|unknown|unbekannt|inconnu|desconocid[oa]|missing|fehlt|various|various authors|diverse|divers|varios|see (the )?(paper|article|text|above)|(unknown|various) (journal|title)|journal|title|abstract|no abstract|not available|not given|in press|forthcoming|to appear|pending|doi pending|untitled|s\.n\.|k\.a\.|<p>\W*</p>)\W*$"
NOT_GIVEN = r"\b(not (yet )?(given|supplied|available|provided|recorded|known)|unavailable|missing|will be added|to be added|to follow|no abstract|nicht vorhanden|kein(e)? (abstract|zusammenfassung)|non disponible|pas de résumé|no disponible|sin resumen)\b"
PAGES = r"^(?:pp?\.?\s*|s\.\s*|seiten?\s*|pages?\s*)?[a-z]?(\d+)\s*(?:-{1,3}|[‐-―−])\s*[a-z]?(\d+)\s*\.?$"
#: Usual short forms of the first words of serial titles.
HEADS = r"^(j|z|ann|arch|bull|rev|lett|let|proc|trans|mag|mem|rep|stud|jahrb|zeitschr|int|amer|am|brit|eur)\.?\s"
FUNCTION_WORDS = ("of", "in", "on", "and", "for", "the", "a", "an", "to", "de", "der", "die", "das", "des", "du", "la", "le", "les", "et", "und", "für", "y", "en", "el", "los", "las")


def bare_doi(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(c)), r"^(https?://[^/\s]+/|doi:\s*)", "")


def _sound(field: str, c: Column) -> Column:
    """What a value shows by itself."""
    t = F.trim(c)
    low = F.lower(t)
    if field == "doi":
        d = bare_doi(c)
        balanced = F.length(F.regexp_replace(d, r"[^(]", "")) == F.length(F.regexp_replace(d, r"[^)]", ""))
        return d.rlike(r"^10\.\d{4,9}/\S*[\p{L}\p{N}]\S*$") & ~d.rlike(OMISSION + r"|�|\?$|/x+$") & balanced
    if field == "pages":
        first, last = F.regexp_extract(low, PAGES, 1), F.regexp_extract(low, PAGES, 2)
        big = lambda x: F.when(F.length(x).between(1, 38), x.cast("decimal(38,0)"))
        return low.rlike(PAGES) & (big(first) < big(last))
    plain = ~low.rlike(STAND_IN) & ~low.rlike(NOT_GIVEN) & ~t.rlike(r"�|[\x00-\x08]|Ã.|â€") & ~t.rlike(r"^\s*(\.\.\.|…|\[)") & ~low.rlike(OMISSION + r"[\s.]*$")
    if field == "abstract":
        return plain & t.rlike(r"[.!?。][\"'”’)\]]*$") & t.rlike(r"\s")
    acronym = t.rlike(r"^[\p{Lu}&]{2,6}$")
    dotted = t.rlike(r"\p{L}\.(\s|$)")
    return plain & ~acronym & ~dotted & ~low.rlike(HEADS) & t.rlike(r"^[\p{Lu}\p{N}]") & t.rlike(r"\p{L}{2}")


def _state(field: str, c: Column) -> Column:
    t = F.trim(c)
    if field == "doi":
        form = F.when(F.lower(t).rlike("^https?:"), "url").when(F.lower(t).rlike("^doi:"), "doi").otherwise("bare")
        return F.concat(form, F.when(t.rlike(r"\p{Lu}"), " upper").otherwise(" lower"))
    if field == "pages":
        return F.concat(F.when(F.lower(t).rlike("^[a-z]"), "word ").otherwise(""), F.when(t.contains("--"), "double").when(t.contains("-"), "single").otherwise("dash"), F.when(t.rlike(r"\d\s+\D*\s+\d"), " spaced").otherwise(""))
    if field == "abstract":
        return F.concat(F.lit("length "), F.floor(F.log2(F.length(t) + 1)).cast("string"))
    return F.concat(F.lit("words "), F.least(F.size(F.split(t, r"\s+")), F.lit(9)).cast("string"))


def sound_values(members: DataFrame, origins: DataFrame) -> DataFrame:
    """Values sound by themselves, one row each: (group_id, field, member_id, trust, modified, state, value, key)."""
    trust = origins.where("origin is not null").groupBy("origin").agg(F.max("trust").alias("trust"))
    rows = members.select("group_id", "member_id", *FIELDS, "origin", "modified").join(trust, "origin", "left")
    key = {"doi": bare_doi(F.col("doi")), "abstract": F.md5(F.lower(F.trim("abstract"))), "journal": F.col("journal"), "pages": F.lit("")}
    one = lambda f: F.when(_sound(f, F.col(f)), F.struct(F.lit(f).alias("field"), _state(f, F.col(f)).alias("state"), F.col(f).alias("value"), key[f].alias("key")))
    long = rows.select("group_id", "member_id", F.coalesce("trust", F.lit(-2147483648)).alias("trust"), "modified", F.explode(F.array(*map(one, FIELDS))).alias("x")).where("x is not null")
    return long.select("group_id", "member_id", "trust", "modified", "x.field", "x.state", "x.value", "x.key")


def _cut_dois(values: DataFrame) -> DataFrame:
    """(group_id, key) of dois that go on in another member: an equi-join on prefixes, no pairs within a group."""
    d = values.where("field = 'doi'").select("group_id", "key").distinct()
    ends = F.sequence(F.instr("key", "/") + 1, F.greatest(F.length("key") - 1, F.instr("key", "/") + 1))
    prefix = d.select("group_id", F.length("key").alias("n"), F.explode(F.transform(ends, lambda k: F.substring(F.col("key"), F.lit(1), k))).alias("p")).where("length(p) < n")
    return d.join(prefix.select("group_id", F.col("p").alias("key")).distinct(), ["group_id", "key"], "left_semi")


def _short_journals(values: DataFrame, ratio: float = 2.0) -> DataFrame:
    """Journal names with a word that is the beginning of a much more frequent word of the column."""
    names = values.where("field = 'journal'").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    word = names.select("key", "n", F.explode(F.array_distinct(F.split(F.lower("key"), r"[^\p{L}\p{M}]+"))).alias("w")).where((F.col("w") != "") & ~F.col("w").isin(*FUNCTION_WORDS))
    freq = word.groupBy("w").agg(F.sum("n").alias("n"))
    longer = (
        freq.where("length(w) > 1")
        .select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda k: F.substring(F.col("w"), F.lit(1), k))).alias("w"))
        .groupBy("w").agg(F.max("n").alias("most"))
    )
    short = freq.join(longer, "w").where(F.col("most") >= ratio * F.col("n")).select("w")
    return word.join(short, "w", "left_semi").select("key").distinct()


def _repeated_abstracts(values: DataFrame, repeats: int) -> DataFrame:
    """Digests of abstracts that many groups share."""
    a = values.where("field = 'abstract'").select("key", "group_id").distinct()
    return a.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= repeats).select("key")


def candidates(members: DataFrame, origins: DataFrame, repeats: int = 5) -> DataFrame:
    """Sound values, also in the light of all others: (group_id, field, member_id, trust, modified, state, value)."""
    values = cut(sound_values(members, origins))
    any_group = F.lit(None).cast(values.schema["group_id"].dataType)
    unsound = (
        _cut_dois(values).select(F.lit("doi").alias("field"), "group_id", "key")
        .unionByName(_short_journals(values).select(F.lit("journal").alias("field"), any_group.alias("group_id"), "key"))
        .unionByName(_repeated_abstracts(values, repeats).select(F.lit("abstract").alias("field"), any_group.alias("group_id"), "key"))
    )
    here = F.when(F.col("field") == "doi", F.col("group_id"))
    marked = values.withColumn("g", here).join(unsound.select("field", F.col("group_id").alias("g2"), F.col("key").alias("k2")).withColumnRenamed("field", "f2"), (F.col("field") == F.col("f2")) & (F.col("key") == F.col("k2")) & F.col("g").eqNullSafe(F.col("g2")), "left_anti")
    return marked.drop("g", "key")


def transitions(best: DataFrame) -> DataFrame:
    """(field, early, late, n): the groups in which one state was last seen before another was first seen."""
    seen = best.where("first_ts is not null").groupBy("group_id", "field", "state").agg(F.min("first_ts").alias("lo"), F.max("last_ts").alias("hi"))
    a = seen.select("group_id", "field", F.col("state").alias("early"), F.col("hi").alias("a_hi"))
    b = seen.select("group_id", "field", F.col("state").alias("late"), F.col("lo").alias("b_lo"))
    return a.join(b, ["group_id", "field"]).where("early != late and a_hi < b_lo").groupBy("field", "early", "late").agg(F.count(F.lit(1)).alias("n"))


def reachable(edges: dict) -> dict:
    """node -> all nodes that a path leads to."""
    out = {}
    for x in {*edges, *(y for ys in edges.values() for y in ys)}:
        seen, todo = set(), list(edges.get(x, ()))
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo.extend(edges.get(y, ()))
        out[x] = seen
    return out


def precedence(counts: list[tuple[str, str, str, int]], ratio: float = 2.0, deviations: float = 3.0) -> set[tuple[str, str, str]]:
    """
    (field, early, late) of the strict partial order: transitions at least ``ratio`` times as frequent as their reverse and
    by ``deviations`` more than chance would make them, with cycles contracted, closed transitively.
    """
    n = {(f, a, b): k for f, a, b, k in counts}
    edges: dict = {}
    for (f, a, b), k in n.items():
        back = n.get((f, b, a), 0)
        if k >= ratio * back and k - back >= deviations * math.sqrt(k + back):
            edges.setdefault((f, a), []).append((f, b))
    to = reachable(edges)
    return {(x[0], x[1], y[1]) for x, ys in to.items() for y in ys if x not in to.get(y, ())}


def latest(field: str, nodes: list[tuple], order: set) -> int:
    """
    Index of the topologically latest of [(state, time or None, member_id)]: nothing comes after it but
    what it comes after itself.  Of several, the latest time, then the smallest member id.
    """
    edges = {
        i: [j for j, (t, v, _) in enumerate(nodes) if i != j and ((u < v) if u is not None and v is not None else (field, s, t) in order)]
        for i, (s, u, _) in enumerate(nodes)
    }
    to = reachable(edges)
    last = [i for i in range(len(nodes)) if all(i in to.get(j, ()) for j in to.get(i, ()))]
    timed = [nodes[i][1] for i in last if nodes[i][1] is not None]
    top = [i for i in last if nodes[i][1] == (max(timed) if timed else None)]
    return min(top, key=lambda i: nodes[i][2])


def survivors(members: DataFrame, origins: DataFrame, repeats: int = 5, with_value: bool = False) -> DataFrame:
    """(group_id, field, member_id[, value]): the member whose value survives."""
    value = F.col("value") if with_value else F.lit(None).cast("string")
    timed = F.struct(F.col("modified").alias("ts"), (-F.col("member_id")).alias("m"), value.alias("value"))
    best = cut(
        candidates(members, origins, repeats).groupBy("group_id", "field", "trust", "state").agg(
            F.max(F.when(F.col("modified").isNotNull(), timed)).alias("timed"),
            F.max(F.when(F.col("modified").isNull(), timed)).alias("loose"),
            F.min("modified").alias("first_ts"), F.max("modified").alias("last_ts"),
        )
    )
    order = precedence([tuple(r) for r in transitions(best).select("field", "early", "late", "n").collect()])  # at most STATES squared a field
    nodes = F.filter(F.array("timed", "loose"), lambda x: x.isNotNull())
    level = best.repartition("group_id", "field").select("group_id", "field", "trust", F.transform(nodes, lambda x: F.struct(F.col("state").alias("state"), x["ts"].alias("ts"), x["m"].alias("m"), x["value"].alias("value"))).alias("nodes"))
    # at most two values for each state of a field
    level = level.groupBy("group_id", "field", "trust").agg(F.flatten(F.collect_list("nodes")).alias("nodes"))
    top = level.groupBy("group_id", "field").agg(F.max_by("nodes", "trust").alias("nodes"))
    # times alone make a chain, whose end is its maximum; all others are sorted topologically
    open_ = F.exists("nodes", lambda x: x["ts"].isNull()) & (F.size("nodes") > 1)
    end = F.array_max(F.transform("nodes", lambda x: F.struct(x["ts"].alias("ts"), x["m"].alias("m"), x["value"].alias("value"))))
    chain = top.where(~open_).select("group_id", "field", (-end["m"]).alias("member_id"), end["value"].alias("value"))
    kinds = dict(members.dtypes)
    shared = members.sparkSession.sparkContext.broadcast(order)

    def sort(batches):
        import pandas as pd

        for pdf in batches:
            won = []
            for field, ns in zip(pdf["field"], pdf["nodes"]):
                won.append(ns[latest(field, [(x["state"], x["ts"], -x["m"]) for x in ns], shared.value)])
            yield pd.DataFrame({"group_id": pdf["group_id"], "field": pdf["field"], "member_id": pd.Series([-w["m"] for w in won], dtype="int64"), "value": pd.Series([w["value"] for w in won], dtype=object)})

    sorted_ = top.where(open_).mapInPandas(sort, f"group_id {kinds['group_id']}, field string, member_id bigint, value string")
    out = chain.unionByName(sorted_)
    return out if with_value else out.drop("value")


def records(members: DataFrame, origins: DataFrame, repeats: int = 5) -> DataFrame:
    """One surviving record for each group, field by field; groups without any sound value keep a row of nulls."""
    won = survivors(members, origins, repeats, with_value=True)
    built = won.groupBy("group_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS])
    return members.select("group_id").distinct().join(built, "group_id", "left")
