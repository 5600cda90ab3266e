"""Arrow functions for what expressions cannot say: name parsing, sort keys, title case, stems, highlights."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = T.StructType([T.StructField(k, T.ArrayType(T.StringType())) for k in ("first", "von", "last", "jr")])

JR = {"jr", "sr", "ii", "iii", "iv", "jr.", "sr."}


def split_name(name: str) -> tuple[list[str], list[str], list[str], list[str]]:
    """(first, von, last, jr) of a BibTeX name with none, one or two commas; braces hold a word together."""
    parts, depth, word = [[]], 0, ""
    for ch in name.replace("~", " ") + " ":
        depth += (ch == "{") - (ch == "}")
        if depth <= 0 and (ch.isspace() or ch == ","):
            if word:
                parts[-1].append(word)
                word = ""
            if ch == ",":
                parts.append([])
        else:
            word += ch
    small = lambda w: w[:1].islower()
    if len(parts) == 1:
        ws = parts[0]
        at = next((k for k, w in enumerate(ws[:-1]) if small(w)), None)
        if at is None:
            return ws[:-1], [], ws[-1:], []
        end = at
        while end < len(ws) - 1 and small(ws[end]):
            end += 1
        return ws[:at], ws[at:end], ws[end:], []
    ws = parts[0]
    cut = max((k + 1 for k, w in enumerate(ws[:-1]) if small(w)), default=0)
    first = parts[-1]
    return first, ws[:cut], ws[cut:], parts[1] if len(parts) > 2 else []


@F.pandas_udf(NAME)
def parse_name(s: pd.Series) -> pd.DataFrame:
    got = [split_name(x) if isinstance(x, str) else ([], [], [], []) for x in s]
    return pd.DataFrame({k: [g[i] for g in got] for i, k in enumerate(("first", "von", "last", "jr"))})


def initials(first: str) -> str:
    return " ".join("-".join(p[0] + "." for p in w.split("-") if p) for w in first.split())


@F.pandas_udf(T.StringType())
def abbreviate(s: pd.Series) -> pd.Series:
    return s.map(lambda x: initials(x) if isinstance(x, str) else None)


def name_pattern(name: str, pattern: str) -> str:
    """``{ff }{vv }{ll}{, jj}``: doubled letters stand for full parts, single ones for initials; an empty part drops its group."""
    parts = dict(zip("fvlj", split_name(name)))

    def group(m):
        body = m.group(1)
        k = re.search(r"(ff|f|vv|v|ll|l|jj|j)", body)
        words = parts[k.group()[0]] if k else []
        if not k or not words:
            return ""
        text = " ".join(words) if len(k.group()) == 2 else " ".join(w[0] + "." for w in words)
        return body.replace(k.group(), text, 1)

    return re.sub(r"\{([^}]*)\}", group, pattern)


def format_names(pattern: str):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: name_pattern(x, pattern) if isinstance(x, str) else None)

    return run


def sort_form(x: str) -> str:
    """Letters and digits for sorting: accents folded, TeX commands and other marks dropped."""
    x = x.replace("\\ss", "ss").replace("\\o", "o").replace("\\l", "l").replace("ß", "ss").replace("ø", "o").replace("æ", "ae").replace("œ", "oe").replace("Ø", "O")
    x = re.sub(r"\\[a-zA-Z]+\s*|\\.", "", x)
    x = "".join(c for c in unicodedata.normalize("NFKD", x) if ord(c) < 128)
    return re.sub(r"\s+", " ", re.sub(r"[^A-Za-z0-9\s]", "", x.replace("-", " ").replace("~", " "))).strip()


@F.pandas_udf(T.StringType())
def purify(s: pd.Series) -> pd.Series:
    return s.map(lambda x: sort_form(x) if isinstance(x, str) else None)


def change_case(title: str, mode: str) -> str:
    """t: lower case but for the first letter and what follows a colon; l and u: all lower or upper.  Braced text is kept."""
    out, depth, fresh = [], 0, True
    for k, ch in enumerate(title):
        if ch == "{":
            depth += 1
        elif ch == "}":
            depth -= 1
        elif depth == 0:
            if mode == "u":
                ch = ch.upper()
            elif mode == "l" or not fresh:
                ch = ch.lower()
        if not ch.isspace() and ch not in "{}":
            fresh = ch == ":" and mode == "t"
        out.append(ch)
    return "".join(out)


def recase(mode: str):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: change_case(x, mode) if isinstance(x, str) else None)

    return run

#: Endings of the published Porter stemmer.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def porter(w: str) -> str:
    """The stemmer published by M. F. Porter, 1980."""
    vowel = lambda i: w[i] in "aeiou" or (w[i] == "y" and i > 0 and w[i - 1] not in "aeiou")

    def shape(s):
        return re.sub(r"(.)\1+", r"\1", "".join("v" if (c in "aeiou" or (c == "y" and i > 0 and s[i - 1] not in "aeiou")) else "c" for i, c in enumerate(s)))

    m = lambda s: shape(s).count("vc")
    has = lambda s: "v" in shape(s)
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and shape(s[-1]) == "c"
    cvc = lambda s: len(s) > 2 and "".join("v" if (c in "aeiou" or (c == "y" and i > 0 and s[i - 1] not in "aeiou")) else "c" for i, c in enumerate(s))[-3:] == "cvc" and s[-1] not in "wxy"
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    elif w.endswith("ed") and has(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and has(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif m(w) == 1 and cvc(w):
            w += "e"
    if w.endswith("y") and has(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for a, b in sorted(table.items(), key=lambda r: -len(r[0])):
            if w.endswith(a):
                w = w[: -len(a)] + b if m(w[: -len(a)]) > 0 else w
                break
    for a in sorted(STEP4, key=lambda x: -len(x)):
        if w.endswith(a):
            s = w[: -len(a)]
            if m(s) > 1 and (a != "ion" or s[-1:] in "st"):
                w = s
            break
    if w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and m(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(s: pd.Series) -> pd.Series:
    return s.map(lambda ws: [porter(w) if len(w) > 3 else w for w in ws] if ws is not None else None)


def spans(text: str, words: list[str], phrases: tuple[str, ...] = ()) -> list[tuple[int, int, float]]:
    """Merged highlights: whole words 1.5, parts of words 1.0, phrases 2.0."""
    low, found = text.lower(), []
    for p in phrases:
        k = low.find(p.lower())
        while k >= 0:
            found.append((k, k + len(p), 2.0))
            k = low.find(p.lower(), k + 1)
    for w in words:
        whole = [(m.start(), m.end(), 1.5) for m in re.finditer(rf"\b{re.escape(w.lower())}\b", low)]
        found += whole or [(m.start(), m.end(), 1.0) for m in re.finditer(re.escape(w.lower()), low)]
    out: list[tuple[int, int, float]] = []
    for a, b, s in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), max(s, out[-1][2]))
        else:
            out.append((a, b, s))
    return out


def snippet(text: str, found: list[tuple[int, int, float]], most: int = 200) -> tuple[str, int]:
    """The stretch of at most ``most`` letters with the highest score, and where it starts."""
    if not found:
        return text[:most], 0
    best, top = 0, -1.0
    for k, (a, _, _) in enumerate(found):
        score = sum(s for x, y, s in found[k:] if y - a <= most)
        if score > top:
            best, top = a, score
    start = max(0, best - max(0, (most - (found[0][1] - found[0][0])) // 4))
    return text[start : start + most], start


def marked(words: list[str], phrases: tuple[str, ...] = (), most: int | None = 200, tag: str = "mark"):
    """Hits in tags, in the best stretch of ``most`` letters or, without a limit, in the whole text."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            if not isinstance(x, str):
                return None
            piece, start = (x, 0) if most is None else snippet(x, spans(x, words, phrases), most)
            out = piece
            for a, b, _ in reversed(spans(piece, words, phrases)):
                out = out[:a] + f"<{tag}>" + out[a:b] + f"</{tag}>" + out[b:]
            return ("..." if start else "") + out + ("..." if start + len(piece) < len(x) else "")

        return s.map(one)

    return run


def cluster(found: list[tuple[int, int, float]], most: int) -> tuple[int, int, float] | None:
    """(from, to, score) of the highlights that lie within ``most`` letters and score most together; the first of equals."""
    best, lo, total = None, 0, 0.0
    found = [f for f in sorted(found) if f[1] - f[0] <= most]
    for a, b, s in found:
        total += s
        while b - found[lo][0] > most:
            total -= found[lo][2]
            lo += 1
        if best is None or total > best[2] + 1e-9:
            best = (found[lo][0], b, total)
    return best


def window(places: list[tuple[int, int]], most: int) -> tuple[int, int, float] | None:
    """(from, to, score) of the term places within ``most`` letters whose number and length count most: 1 a place and 0.1 a letter."""
    return cluster([(a, a + n, 1.0 + 0.1 * n) for a, n in places], most)


SPAN = "start int, stop int, score double"


def clusters(words: list[str], phrases: tuple[str, ...] = (), most: int = 200, by_length: bool = False):
    """The best cluster of highlights of a text, or the best window of term places."""

    @F.pandas_udf(SPAN)
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for x in s:
            found = spans(x, words, phrases) if isinstance(x, str) else []
            out.append((window([(a, b - a) for a, b, _ in found], most) if by_length else cluster(found, most)) or (None, None, None))
        return pd.DataFrame(out, columns=["start", "stop", "score"]).astype({"start": "Int32", "stop": "Int32", "score": "float64"})

    return run
