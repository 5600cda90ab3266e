"""Variant spellings of names typed by people (problem 5).

Method: noisy-channel attribution.  A spelling is parsed into family name, given name and
initials, or, for an organisation, into kind, subjects and place.  Equal parses are one
unit whose frequency is its prior.  The channel says by which distortions a unit may come from
another one nearby: typos, an initial or a lost middle initial, a nickname, a swapped order, a
short form, an acronym.  How likely each distortion is, is estimated from the column itself:
attachments weighted by their posteriors give expected counts of distortions, these give new
likelihoods, until they no longer change.  Each unit is attached to the candidate of maximum
posterior, and what these attachments connect is one entity.

Candidate canonical forms rank by frequency among forms equally full; a fuller form comes
first, because an initial or a name without its middle initial fits several people and would
join them.

Given names are recognised, and their typos and nicknames put right, with a vocabulary
learned from the whole column; a name enters it with a relative frequency of at least
``THETA``, so at most ``1/THETA`` names are broadcast.

Scale: candidates meet by equi-join, after equal parses are merged, so a name that holds a
third of all rows is one unit.  People meet on deletion neighbourhoods of the family name with
the initial of the given name; organisations on those of the place together with their kind,
the beginning of one subject and the first letters of the others, so the organisations of one
place are not compared with each other all through.

Defined results
* null and blank names are linked to none; letter case, accents, order, titles and spacing do not matter
* units with different middle initials or different full given names are different people
* an initial that fits several people goes to the likeliest one; ties go to the smallest name id
* an empty table gives an empty result; extra columns are ignored
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import cut, discard

THETA = 1e-5
PARTICLES = {"von", "van", "der", "den", "de", "da", "di", "del", "della", "du", "la", "le", "ter", "ten", "dos", "das", "do", "zu", "zur", "af", "av", "bin", "ibn", "al", "el"}
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "sir", "rev", "ing", "dipl", "phd", "md"}
SUFFIXES = {"jr", "sr", "ii", "iii", "iv", "junior", "senior"}
#: Kinds of organisations and their short forms.
KINDS = {
    "institute": "institute", "institut": "institute", "instituto": "institute", "inst": "institute", "centre": "centre", "center": "centre", "centro": "centre", "ctr": "centre", "cent": "centre", "society": "society", "soc": "society", "societe": "society", "sociedad": "society",
    "laboratory": "laboratory", "lab": "laboratory", "labs": "laboratory", "laboratoire": "laboratory", "department": "department", "dept": "department", "dep": "department", "university": "university", "univ": "university", "universitat": "university", "universite": "university", "universidad": "university",
    "college": "college", "coll": "college", "academy": "academy", "acad": "academy", "association": "association", "assoc": "association", "foundation": "foundation", "council": "council", "school": "school", "group": "group", "office": "office", "museum": "museum", "library": "library", "agency": "agency", "bureau": "bureau", "faculty": "faculty", "fac": "faculty",
}
GLUE = {"for", "of", "and", "the", "fur", "und", "et", "de", "la", "y", "in", "on"}
#: Common short forms of given names.
NICKNAMES = {
    "ned": "edward", "ed": "edward", "eddie": "edward", "ted": "theodore", "teddy": "theodore", "theo": "theodore", "paco": "francisco", "pancho": "francisco", "nacho": "ignacio", "dora": "dorothea", "dot": "dorothea", "peggy": "margaret", "meg": "margaret", "maggie": "margaret", "greta": "margaret",
    "sue": "susanna", "susie": "susanna", "andy": "andrew", "drew": "andrew", "fred": "frederick", "freddie": "frederick", "kate": "katherine", "katie": "katherine", "kathy": "katherine", "kit": "christopher", "chris": "christopher", "bob": "robert", "rob": "robert", "bobby": "robert", "bert": "robert",
    "bill": "william", "will": "william", "billy": "william", "liam": "william", "dick": "richard", "rick": "richard", "rich": "richard", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lisa": "elizabeth", "tom": "thomas", "tommy": "thomas", "mike": "michael", "mick": "michael",
    "alex": "alexander", "sasha": "alexander", "xander": "alexander", "nick": "nicholas", "nico": "nicholas", "sam": "samuel", "ben": "benjamin", "benny": "benjamin", "pat": "patricia", "patty": "patricia", "trish": "patricia", "jen": "jennifer", "jenny": "jennifer", "becky": "rebecca", "becca": "rebecca",
    "deb": "deborah", "debbie": "deborah", "len": "leonard", "lenny": "leonard", "leo": "leonard", "hans": "johannes", "jan": "johannes", "johann": "johannes", "beppe": "giuseppe", "pino": "giuseppe", "gabi": "gabriela", "gaby": "gabriela", "pepe": "jose", "jim": "james", "jimmy": "james", "joe": "joseph", "jack": "john",
    "tony": "anthony", "steve": "steven", "dave": "david", "dan": "daniel", "danny": "daniel", "matt": "matthew", "greg": "gregory", "tim": "timothy", "ron": "ronald", "don": "donald", "ken": "kenneth", "larry": "lawrence", "harry": "henry", "hank": "henry", "charlie": "charles", "chuck": "charles", "wolf": "wolfgang", "uli": "ulrike",
    "joss": "joaquin", "quino": "joaquin", "misha": "mikhail", "mitya": "dmitri", "dima": "dmitri", "vicky": "victoria", "tina": "christina", "ana": "anna", "nan": "anne", "nell": "eleanor", "sally": "sarah", "molly": "mary", "polly": "mary", "lottie": "charlotte", "gus": "augustus", "max": "maximilian", "val": "valentina", "lex": "alexander", "ros": "rosalind", "lutz": "ludwig", "mandy": "amanda", "cathy": "katherine", "frank": "francisco", "cisco": "francisco", "fran": "francisco",
}
FOLD = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ı": "i", "’": "'", "`": "'"})


def fold(s: str) -> str:
    s = s.lower().translate(FOLD)
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def near(a: str, b: str) -> int:
    """0 equal, 1 one edit apart (insertion, deletion, substitution or transposition), 2 farther."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return 2
    k = 0
    while k < min(la, lb) and a[k] == b[k]:
        k += 1
    if la == lb:
        if a[k + 1 :] == b[k + 1 :]:
            return 1
        return 1 if a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :] else 2
    if la < lb:
        a, b = b, a
    return 1 if a[k + 1 :] == b[k:] else 2


def deletions(s: str) -> list[str]:
    return list({s, *(s[:k] + s[k + 1 :] for k in range(len(s)))})


def is_organisation(name: str, given: dict | None = None) -> bool:
    """Whether a name holds a kind of organisation or is an acronym with a place; a tail known as a given name is none."""
    words = re.findall(r"[^\W\d_]+", fold(name))
    if any(w in KINDS for w in words):
        return True
    m = re.match(r"^\s*[A-Z][a-z]?[A-Z]{1,4}(,?)\s+([^\W\d_]{8,})\s*$", name)
    return bool(m) and not (m.group(1) and (given is None or fold(m.group(2)) in given))


def organisation(name: str) -> tuple[str, str, str, str]:
    """(place, kind, subjects in order, acronym)."""
    f = fold(name).replace("&", " and ")
    m = re.match(r"^\s*([A-Z][a-z]?[A-Z]{1,4}),?\s+([^\W\d_]{4,})\s*$", name)
    if m and not (fold(m.group(1)) in KINDS and len(m.group(1)) > 3) and fold(m.group(2)) not in KINDS:
        return fold(m.group(2)), "", "", "".join(c for c in m.group(1) if c.isupper()).lower()
    head, _, tail = f.rpartition(",")
    words = re.findall(r"[^\W\d_]+", head or f)
    place = "".join(re.findall(r"[^\W\d_]+", tail)) if head else ""
    at = next((k for k, w in enumerate(words) if w in KINDS), None)
    kind = KINDS[words[at]] if at is not None else ""
    if not place and at:
        place = "".join(w for w in words[:at] if w not in GLUE)
        words = words[at:]
    elif not place and len(words) > 1:
        place, words = words[-1], words[:-1]
    subjects = sorted(w for k, w in enumerate(words) if w not in GLUE and KINDS.get(w) != kind)
    return place, kind, " ".join(subjects), ""


def person(name: str, given: dict) -> tuple[str, str, str]:
    """(family name, full given name or '', initials of all given names)."""
    f = fold(name)
    head, comma, tail = f.partition(",")
    if comma and tail.strip(" .") in SUFFIXES:
        head, comma, tail = f[: f.rfind(",")].partition(",")

    def split(x):
        out = []
        for w in re.findall(r"[^\W\d_']+(?:['-][^\W\d_]+)*\.?", x):
            bare = w.rstrip(".")
            if bare in TITLES or bare in SUFFIXES or bare in PARTICLES:
                continue
            out.append((bare, w.endswith(".")))
        return out

    if comma:
        sur, giv = split(head), split(tail)
        if not sur:
            sur, giv = giv, []
    else:
        ws = split(head)
        if not ws:
            return "", "", ""
        first = [w for w in ws if len(w[0]) == 1]
        full = [w for w in ws if len(w[0]) > 1]
        if not full:
            return "".join(w for w, _ in ws), "", ""
        if len(ws[-1][0]) == 1 and len(ws[0][0]) > 1 and len(full) <= 3 and (len(full) == 1 or not given.get(ws[0][0])):
            sur, giv = full, first
        elif len(ws[0][0]) == 1:
            sur, giv = full, first
        elif len(full) > 1:
            g = lambda w: given.get(w, 0.0) + max((given.get(x, 0.0) * 0.1 for x in (NICKNAMES.get(w), _corrected(w, given)) if x), default=0.0)
            last = full[-1][0]
            if g(last) > g(full[0][0]):
                sur, giv = full[:-1], [full[-1], *first]
            else:
                sur, giv = full[1:], [full[0], *first]
        else:
            sur, giv = full, first
    family = "".join(re.sub(r"[^\w]", "", w) for w, _ in sur)
    names = [w for w, _ in giv]
    full_given = next((w for w in names if len(w) > 1), "") if names and len(names[0]) > 1 else ""
    return family, full_given.replace("-", ""), "".join(w[0] for w in names)


def _corrected(w: str, given: dict) -> str | None:
    """The vocabulary name of which a rarer word is a typo."""
    if len(w) < 3:
        return None
    own = given.get(w, 0.0)
    best, top = None, own * 5
    for d in deletions(w):
        for x in given.get(("del", d), ()):
            if given[x] > top and near(w, x) == 1:
                best, top = x, given[x]
    return best


def with_neighbours(given: dict) -> dict:
    out: dict = dict(given)
    for w in given:
        if len(w) >= 4:
            for d in deletions(w):
                out.setdefault(("del", d), []).append(w)
    return out


def vocabulary(names: DataFrame) -> dict:
    """Relative frequencies of given names, learned from names written with a comma; at most 1/THETA of them."""

    def scan(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for s in pdf["s"]:
                head, comma, tail = fold(s).partition(",")
                if comma and not is_organisation(s):
                    for w in re.findall(r"[^\W\d_]+", tail)[:1]:
                        if len(w) > 1 and w not in SUFFIXES and w not in PARTICLES:
                            out.append((w, "".join(re.findall(r"[^\W\d_]+", head))[:40]))
            yield pd.DataFrame(out, columns=["w", "family"])

    seen = names.select(F.col("person_name").alias("s")).where("s is not null").mapInPandas(scan, "w string, family string").distinct()
    count = cut(seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    total = count.agg(F.sum("n")).first()[0] or 0
    kept = {r.w: r.n / total for r in count.where(F.col("n") >= max(2, THETA * total)).collect()} if total else {}
    discard(count)
    return kept


UNIT = "name_id bigint, kind string, family string, given string, initials string, raw string, n bigint"


def parse(names: DataFrame, given: dict) -> DataFrame:
    shared = names.sparkSession.sparkContext.broadcast(given)

    def scan(batches):
        import pandas as pd

        vocab = with_neighbours(shared.value)
        for pdf in batches:
            out = []
            for i, s, n in zip(pdf["name_id"], pdf["s"], pdf["n"]):
                if is_organisation(s, vocab):
                    place, kind, subjects, acronym = organisation(s)
                    out.append((i, "o", place, subjects, kind, acronym, n))
                else:
                    family, g, initials = person(s, vocab)
                    raw = g
                    if g:
                        fixed = _corrected(g, vocab)
                        g = NICKNAMES.get(g, g) if not fixed else fixed
                        g = NICKNAMES.get(g, g)
                    out.append((i, "p", family, g, initials[1:], raw or initials[:1], n))
            yield pd.DataFrame(out, columns=["name_id", "kind", "family", "given", "initials", "raw", "n"])

    rows = names.select(F.col("name_id").cast("bigint").alias("name_id"), F.col("person_name").alias("s"), (F.coalesce("n_author", F.lit(0)) + F.coalesce("n_editor", F.lit(0)) + 1).cast("bigint").alias("n"))
    return rows.where("s rlike '\\\\p{L}'").mapInPandas(scan, UNIT).where("family != ''")


#: Distortions and the likelihoods that their estimation begins with.
START = {"typo": 0.02, "initial": 0.13, "middle": 0.37, "short": 0.37, "acronym": 0.05}


def channel(x: tuple, c: tuple) -> dict | None:
    """How often each distortion makes unit ``x`` of ``c``; None where it can't be.  Units: (kind, family, given, initials, raw)."""
    if x[0] != c[0]:
        return None
    away = near(x[1], c[1])
    if away > 1 or (away and min(len(x[1]), len(c[1])) < 5):
        return None
    n = dict.fromkeys(START, 0)
    n["typo"] = away
    if x[0] == "o":
        return _org_channel(x, c, n)
    gx, gc = x[2], c[2]
    if gx and gc:
        if gx != gc:
            close = min(near(a, b) for a in {gx, x[4]} for b in {gc, c[4]})
            if away or close > 1 or min(len(gx), len(gc)) < 3 or max(len(gx), len(gc)) < 4:
                return None
            n["typo"] += 1
    elif gx or gc:
        full, short = (x, c) if gx else (c, x)
        if (away and len(short[1]) < 7) or not short[4] or short[4] not in (full[2][:1], full[4][:1]):
            return None
        n["initial"] += 1
    else:
        if (away and len(x[1]) < 7) or x[4] != c[4]:
            return None
    mx, mc = x[3], c[3]
    if mx != mc:
        if mx and mc and not (mx.startswith(mc) or mc.startswith(mx)):
            return None
        n["middle"] += 1
    return n


def _org_channel(x: tuple, c: tuple, n: dict) -> dict | None:
    """Organisations: the kind and each subject must agree, be a short form, or be a typo; an acronym must spell them."""
    if x[4] or c[4]:
        if x[4] and c[4]:
            return n if sorted(x[4]) == sorted(c[4]) else None
        full, acronym = (c, x[4]) if x[4] else (x, c[4])
        n["acronym"] += 1
        return n if {"".join(sorted(set(acronym)))} & spelled(full[3], full[2]) else None
    if x[3] and c[3] and x[3] != c[3]:
        return None
    a, b = x[2].split(), c[2].split()
    if len(a) != len(b):
        return None
    left = list(b)
    for s in a:
        hit = next((t for t in left if t == s), None) or next((t for t in left if len(min(s, t, key=len)) >= 2 and (t.startswith(s) or s.startswith(t))), None) or next((t for t in left if near(s, t) == 1), None)
        if hit is None:
            return None
        left.remove(hit)
        if hit != s:
            n["short" if hit.startswith(s) or s.startswith(hit) else "typo"] += 1
    return n


def spelled(kind: str, subjects: str) -> set[str]:
    """The letters an acronym of an organisation may have: with the kind, or without it."""
    letters = sorted([kind[:1], *(s[:1] for s in subjects.split())])
    return {"".join(sorted(set(letters))), "".join(sorted(set(letters[1:])))}


def _org_blocks(place: str, kind: str, subjects: str, acronym: str) -> set[str]:
    """What an organisation has in common with each spelling of it, short of typos in the first letters of two subjects."""
    if acronym:
        return {"a" + "".join(sorted(set(acronym)))}
    words = subjects.split()
    out = {"a" + x for x in spelled(kind, subjects)}
    if not words:
        return out | {"k" + kind, "n"}
    for k, w in enumerate(words):
        others = "".join(sorted(x[:1] for j, x in enumerate(words) if j != k))
        for begin in {w[:2], w[:1] + w[2:3], w[1:3]}:  # one edit in the first letters leaves one of these
            out.update({f"k{kind}|{begin}|{others}", f"n|{begin}|{others}"})
    return out


def _keys(batches):
    """(unit, block, complete): units of a block meet, but not two complete ones: those with a kind, in a block without it, and whole names, in a block of acronyms."""
    import pandas as pd

    for pdf in batches:
        out = []
        for u, kind, family, given, initials, raw in zip(*(pdf[c].tolist() for c in ("unit", "kind", "family", "given", "initials", "raw"))):
            near_by = deletions(family) if len(family) >= 5 else [family]
            if kind == "o":
                found = _org_blocks(family, initials, given, raw)
                out.extend((u, f"o{d}|{x}", initials != "" if x[0] == "n" else x[0] == "a" and raw == "") for d in near_by for x in found)
                continue
            out.extend((u, f"p{f}|{d}", False) for d in near_by for f in {given[:1], raw[:1]} - {""} or {""})
            if len(given) >= 3:
                out.extend((u, f"g{family}|{d}", False) for d in {*deletions(given), *deletions(raw)})
        yield pd.DataFrame(out, columns=["unit", "block", "complete"]).astype({"unit": "int64", "complete": "bool"})


def likelihoods(scored: DataFrame, rounds: int = 8, tolerance: float = 0.01) -> dict[str, float]:
    """Likelihood of each distortion: its expected number in an attachment, each weighted by its posterior."""
    p = dict(START)
    for _ in range(rounds):
        w = scored.where("up").withColumn("p", F.exp(weight(p)))
        z = w.groupBy("x").agg(F.sum("p").alias("z"), *[F.sum(F.col("p") * F.col(k)).alias(k) for k in p])
        got = z.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(k) / F.col("z")).alias(k) for k in p]).first()
        new = {k: min(0.5, max(1e-4, ((got[k] or 0.0) + START[k]) / (got["n"] + 1))) for k in p}
        done = all(abs(new[k] - p[k]) <= tolerance * p[k] for k in p)
        p = new
        if done:
            break
    return p


def weight(p: dict[str, float]):
    """Log of prior and likelihood of a candidate."""
    import math

    return F.log(F.col("n").cast("double")) + sum((F.col(k) * math.log(p[k]) for k in p), F.lit(0.0))


def attach(units: DataFrame) -> DataFrame:
    """(unit, target, posterior): the maximum-posterior canonical form of each unit that has one, and its twins."""
    keyed = units.mapInPandas(_keys, "unit bigint, block string, complete boolean")
    side = lambda p: keyed.select("block", F.col("unit").alias(p), F.col("complete").alias("k" + p))
    pairs = side("x").join(side("c"), "block").where("x != c and not (kx and kc)").select("x", "c").distinct()
    cols = ["unit", "kind", "family", "given", "initials", "raw", "n"]
    # fuller spellings first, then the more frequent: only these can be canonical for a unit
    rank = F.struct(
        (((F.col("kind") == "p") & (F.col("given") != "")) | ((F.col("kind") == "o") & (F.col("raw") == ""))).cast("int").alias("full"),
        F.length("initials").alias("more"), F.col("n"), (-F.col("unit")).alias("u"),
    )
    ranked = units.select(*cols, rank.alias("rank"))
    px = ranked.select(F.col("unit").alias("x"), F.struct(*cols[1:]).alias("fx"), F.col("rank").alias("rx"))
    pc = ranked.select(F.col("unit").alias("c"), F.struct(*cols[1:]).alias("fc"), F.col("rank").alias("rc"))
    both = pairs.join(px, "x").join(pc, "c").select("x", "c", "fx", "fc", (F.col("rc") > F.col("rx")).alias("up"))

    def score(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for x, c, fx, fc, up in zip(pdf["x"], pdf["c"], pdf["fx"], pdf["fc"], pdf["up"]):
                # people whose given names and initials agree differ by a typo only: linked whichever form is the canonical one
                twin = fx["kind"] == "p" and fx["given"] != "" and fx["given"] == fc["given"] and fx["initials"] == fc["initials"]
                if not up and not twin and (fx["family"] == fc["family"] or fc["n"] < fx["n"]):
                    continue
                tx, tc = (tuple(f[k] for k in ("kind", "family", "given", "initials", "raw")) for f in (fx, fc))
                made = channel(tx, tc)
                if made is not None:
                    out.append((x, c, bool(up), twin and bool(up), fc["n"], *made.values()))
            yield pd.DataFrame(out, columns=["x", "c", "up", "twin", "n", *START]).astype({"x": "int64", "c": "int64", "up": "bool", "twin": "bool", "n": "int64", **dict.fromkeys(START, "int32")})

    scored = cut(both.mapInPandas(score, "x bigint, c bigint, up boolean, twin boolean, n bigint, " + ", ".join(f"{k} int" for k in START)))
    scored = scored.withColumn("w", weight(likelihoods(scored)))
    # a fuller form comes first; a typo in the family name may also be told by a plainer form that is as frequent
    top = scored.groupBy("x").agg(F.max(F.struct("up", "w", (-F.col("c")).alias("m"))).alias("b"), F.sum(F.when(F.col("up"), F.exp("w"))).alias("zu"), F.sum(F.exp("w")).alias("z"))
    best = top.select(F.col("x").alias("unit"), (-F.col("b.m")).alias("target"), (F.exp("b.w") / F.when(F.col("b.up"), F.col("zu")).otherwise(F.col("z"))).alias("posterior"))
    return best.unionByName(scored.where("twin").select(F.col("x").alias("unit"), F.col("c").alias("target"), F.lit(1.0).alias("posterior")))


def entities(names: DataFrame) -> DataFrame:
    """(name_id, entity): ``entity`` is the smallest name id among the spellings of the entity."""
    parsed = cut(parse(names, vocabulary(names)))
    key = ["kind", "family", "given", "initials", "raw"]
    units = cut(parsed.groupBy(*key).agg(F.sum("n").alias("n"), F.min("name_id").alias("unit")))
    links = attach(units).select("unit", "target")
    edge = cut(links.unionByName(links.select(F.col("target").alias("unit"), F.col("unit").alias("target"))).distinct())
    # entities are small, so the smallest unit of each spreads in a few rounds; only linked units take part
    state = cut(edge.select("unit").distinct().withColumn("root", F.col("unit")))
    while True:
        seen = edge.join(state.select(F.col("unit").alias("target"), F.col("root").alias("r2")), "target").groupBy("unit").agg(F.min("r2").alias("r2"))
        nxt = cut(state.join(seen, "unit").select("unit", F.least("root", "r2").alias("root"), (F.col("r2") < F.col("root")).alias("moved")))
        more = nxt.where("moved").limit(1).count()
        discard(state)
        state = nxt
        if not more:
            break
    return parsed.join(units.select(*key, "unit"), key).join(state.select("unit", "root"), "unit", "left").select("name_id", F.coalesce("root", "unit").alias("entity"))


def variant_pairs(names: DataFrame) -> DataFrame:
    """All pairs of spellings of one entity, as problem 5 asks for them."""
    e = cut(entities(names))
    a, b = e.select("entity", F.col("name_id").alias("name_id_a")), e.select("entity", F.col("name_id").alias("name_id_b"))
    return a.join(b, "entity").where("name_id_a < name_id_b").select("name_id_a", "name_id_b")
