"""Template residue and error-page text (problem 10).

Method: a multi-pattern automaton holds phrases of error messages, filler and script notices in
several languages, and the opening signs of template marks.  It runs over a text once.  Where
it hit, the segment (a sentence or line, or what follows from a capital letter that begins a
message in the midst of one) is taken as words and matched with the automaton of whole
phrases; the share of its words that phrases cover decides whether the segment is residue.  An
unfilled mark leaves a hole in its segment, so it makes all of it residue.  Keyboard walks and
words repeated over and over cover themselves.  A document is excluded when residue segments
cover at least ``document_share`` of it.

The default ``document_share`` of 0 excludes a document for any residue segment, because
residue among real text counts too; the share is reported, so a caller may ask for more.

What only speaks of such texts does not count: a phrase or mark in quotation marks, in
formulas or bibliographic notation, or directly before or after words that name it as an
example ("such as", "stands for"); a phrase that is a small part of its sentence does not
cover it.

Filler words beyond the known ones are learned from the whole collection: words that often
occur in documents with two or more known filler words.  A word is kept only if at least ``THETA`` of
those documents hold it, which bounds the broadcast lexicon by their words per ``THETA``.

Scale: two narrow scans and one small aggregation; no document is grouped with another.

Defined results
* null and blank texts are never excluded
* whole texts of any length are scanned, marks and quotations of any length are known; repeated documents are judged alike
* an empty table gives an empty result; extra columns are ignored
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cache
from http import HTTPStatus
from itertools import product
from operator import eq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import cut, discard

THETA = 0.02
SEGMENT_SHARE = 0.4
NOISE_SHARE = 0.3

# Template marks: what they begin with, and the whole mark from there.
FIELD = r"(?i:name|title|date|year|author|editor|journal|publisher|place|pages?|volume|number|doi|isbn|issn|url|abstract|text|key|address|e?mail|phone|company|insert|your|here|add|enter|citation|summary|subject|topic|titel|datum|jahr|autor|auteur|nom|titre|ann[ée]e|nombre|t[ií]tulo|fecha|nome|titolo|data|anno)"
MARKS = {
    "{{": [r"(?<!\{)\{\{\s?[A-Za-z_][\w. ]*\}\}(?!\})"],
    "{": [r"(?<![\w{}_^\\$#])\{[a-z]+(?:_[a-z]+)+\}", r"(?<![\w{}_^\\$#])\{\d\}"],
    "${": [r"\$\{[A-Za-z_][\w.]*\}"],
    "#{": [r"#\{[A-Za-z_][\w.]*\}"],
    "<<": [r"<<[A-Za-z_][\w.]*>>"],
    "[[": [r"\[\[[A-Za-z][\w .]*\]\]"],
    "@@": [r"@@[A-Za-z_][\w.]*@@"],
    "%": [r"%[A-Z][A-Z_]{2,}%"],
    "__": [r"(?<!\w)__[A-Z][A-Z_]*__(?!\w)"],
    "<%": [r"<%=?\s*[\w.]+\s*%>"],
    "<": [rf"<(?=[^<>]*\b{FIELD}\b)(?:[A-Z]{{3,}}(?: [A-Z]+)*|(?:[a-z]+ )+(?:here|name|title|date|text))>", rf"<{FIELD}>(?<=[A-Z]>)"],
    "[": [rf"\[(?=[^\[\]]*\b{FIELD}\b)(?:[A-Z]+(?: [A-Z]+)*|(?:add|insert|enter|your|type)\b[\w ]+|[\w ]+ (?:here|name|to be inserted))\]"],
    "todo": [r"\bTODO\b:? ?\w[\w ]+"],
    "fixme": [r"\bFIXME\b:? ?\w[\w ]+"],
    "xxx": [r"(?<!X)X{3,} \([\w ]+\)"],
}


def _all(*parts: str) -> list[str]:
    """Every way of putting one of each part together; the alternatives of a part are divided by a bar."""
    return [" ".join(" ".join(x).split()) for x in product(*(p.split("|") for p in parts))]


# Phrases are words in lower case; #code is a number from 400 to 599, # any other number, #path an address or file, #fault the name of a program error.
ERRORS = [
    *_all("error|http|status|status code|http error|error code|fehler|fehlercode|erreur|errore|erro|fout|estado|stato", "#code"),
    *[f"#code {x.phrase.lower().replace('-', ' ')}" for x in HTTPStatus if x.value >= 400], *_all("#code", "error|page not found"),
    *[x.phrase.lower() for x in HTTPStatus if x.value in (404, 429, 500, 502, 503, 504)],
    *_all("page|file|record|item|document|resource|title|entry", "not found|could not be found|cannot be found|was not found"), *_all("could not be found on|cannot be served on", "#path"),
    *_all("seite|datensatz|katalogeintrag|eintrag|dokument|titel|datei", "nicht gefunden|wurde nicht gefunden"), *_all("page|fiche|notice|document|ressource", "introuvable|non trouvée|non trouvé"),
    *_all("página|ficha|registro|documento|recurso", "no encontrada|no encontrado"), *_all("pagina|scheda|documento|risorsa", "non trovata|non trovato"), *_all("página|documento|registro", "não encontrada|não encontrado"), "pagina niet gevonden",
    *_all("interner serverfehler|erreur interne du serveur|error interno del servidor|errore interno del server|erro interno do servidor|interne serverfout"),
    *_all("access|permission", "denied"), *_all("zugriff verweigert|accès refusé|acceso denegado|accesso negato|acesso negado|toegang geweigerd"),
    *_all("gateway|proxy|fatal|server|application|database|internal", "error"), "bad response", *_all("the server at #path", "|closed the connection|is down|returned|refused|did not answer|reset the connection"),
    *_all("unhandled exception|exception in thread|traceback most recent call last|#fault|stack trace|segmentation fault|core dumped"), *_all("in #path", "on line #|line #"), "#path line #",
    *_all("has sent|have sent|", "too many requests"), *_all("automated access", "was|has been", "detected"),
    *_all("session|login|link|token", "has expired|expired|timed out|has timed out|is no longer valid"), *_all("sitzung ist abgelaufen|session a expiré|sesión ha caducado|sessione è scaduta|sessão expirou"),
    *_all("hit a snag|did not work|went wrong|broke|failed", "on our", "server|side|end"), *_all("something|etwas", "went wrong|ist schiefgelaufen"),
    *_all("download|transfer|upload|request|login|import|export|loading", "failed|aborted"), *_all("cannot open", "file|page|record|database|the file|the page"),
    *_all("we", "failed to|were unable to|could not", "retrieve|load|open|find|display|fetch|process"), *_all("you are looking for|you requested|you were looking for", "has been|does not|no longer|is no longer|cannot|could not|was"),
    "nothing here", *_all("you", "lack permission|do not have permission"),
    *_all("this|the requested", "item|page|title|volume|record|scan|abstract|entry|document|file|resource|full text", "has been|was", "moved|deleted|renamed|removed|withdrawn"),
    *_all("retry in #", "minutes|seconds|hours"), "try again later", *_all("später erneut versuchen|réessayez plus tard|inténtelo más tarde|riprova più tardi"), *_all("request id|incident id|reference id", "#|#path"),
    *_all("connection|upstream|backend|service", "timed out|did not answer|was reset|was refused|failed", "while", "loading|opening|fetching|reading"),
]
NEAR_ERRORS = [
    *_all("critical|warning|fatal|severe|sorry|hmm|oops|reading|#path|code #|code #code|return to the|if this continues|write to the help desk|under this address|unknown table|out of memory|could not be read|is damaged|is empty|on our|while loading|while opening|while fetching|while reading"),
    *_all("this|the|the requested|your", "page|item|record|document|file|title|full text|address|request"), *_all("your address", "has sent"), *_all("is", "invalid|missing|damaged|empty"), "an invalid response", "your request", "no item", "in #path",
]
SCRIPT = _all("java script|javascript|js|scripts|script|scripting|client side scripts|client side scripting|client side javascript|skripte|skripts|les scripts|los scripts|gli script")
DEMANDS = [
    *_all("enable|activate|allow|switch on|turn on|unblock|require|requires|required|need|needs|relies on|depends on|works only with|can run|does not support|has switched off|has disabled|blocks"),
    *_all("cannot", "start|run|work|load|open", "without"), *_all("is|are", "disabled|blocked|switched off|turned off|required|not enabled|off"),
    *_all("aktivieren|erlauben|einschalten|schalten|zulassen|benötigt|erfordert|deaktiviert|ausgeschaltet|blockiert"), *_all("activer|activez|autoriser|autorisez|nécessite|requiert|désactivé|désactivés|ne prend pas en charge|bloque"),
    *_all("activar|active|habilitar|habilite|permita|permitir|requiere|necesita|desactivado|no admite"), *_all("attivare|attiva|attivi|attivate|abilitare|abilita|abiliti|abilitate|consentire|consenta|richiede|necessita|disattivato|disabilitato"),
    *_all("ativar|ative|habilitar|requer|precisa|desativado|inschakelen|schakel|activeer|vereist|uitgeschakeld"),
]
NEAR_SCRIPT = [
    *_all("please|kindly|bitte|veuillez|merci de|merci d|il faut|vous devez|debe|por favor|si prega di|per favore|dovete|occorre|is nodig|sie|if nothing appears|if nothing happens|check that|without|and cookies|and reload|for this page|here|cannot|which|um|ein"),
    *_all("you", "must|need to|have to"), *_all("this|the|our", "page|site|catalogue|reader|viewer|application|app|website|service|library"), *_all("|in", "your browser"), *_all("in ihrem browser|ihr browser|dans votre navigateur|votre navigateur|en su navegador|su navegador|nel browser|il browser|no seu navegador"),
    *_all("to", "continue|see|view|display|open|use|read|proceed"), *_all("pour", "afficher|continuer|voir|consulter"), *_all("para", "ver|continuar|consultar|mostrar"), *_all("per", "continuare|visualizzare|vedere|aprire"), *_all("zu", "sehen|öffnen|nutzen|lesen"), "fortzufahren",
]
FILLER = _all(
    "lorem ipsum|dolor sit amet|consectetur adipiscing|texte de remplissage|faux texte|texte d exemple|beispieltext|platzhaltertext|blindtext|mustertext|texto de relleno|texto de ejemplo|texto de prueba|texto simulado|testo di prova|testo segnaposto|texto fictício|"
    "placeholder paragraph|placeholder text|replace before publishing|dummy text for|this is dummy text|sample abstract text|sample text goes here|text goes here|your text here|insert text here"
)
NEAR_FILLER = _all("bitte ersetzen|à remplacer|por sustituir|da sostituire|this is|das ist|ceci est|esto es|questo è|ein|un|the|here|goes here|replace|please replace|for the abstract|only")
LATIN = {"lorem", "ipsum", "dolor", "amet", "consectetur", "adipiscing", "elit", "eiusmod", "tempor", "incididunt", "labore", "magna", "aliqua", "veniam", "nostrud", "exercitation", "ullamco", "laboris", "aliquip", "commodo", "consequat"}
ROWS = ("qwertyuiop", "asdfghjkl", "asdfghjklö", "zxcvbnm", "qwertzuiop", "yxcvbnm", "azertyuiop", "qsdfghjklm", "wxcvbn")
#: Words that may stand before a message and belong to it.
LEADING = {"the", "this", "your", "a", "please", "sorry", "hmm", "we", "you", "our", "bitte", "die", "der", "das", "la", "le", "les", "el", "il", "votre", "su", "ihre", "veuillez", "that", "if", "no"}
#: Words that name what stands directly after, or before, them as an example or a term.
NAMING = re.compile(r"(?:\b(?:such as|like|e\.g\.|i\.e\.|namely|called|named|wie|etwa|namens|z\.\s?B\.|comme|telle? que|par exemple|como|por ejemplo|come|ad esempio)|(?<![\w-])(?:mark|word|term|phrase|string|symbol|notation|syntax|placeholder|variable|message|token)s?)\W{0,2}$", re.I)
NAMED = re.compile(r"\W{0,2}\s*(?:stands? for|(?:is|are|gets) replaced|expands? to|means|denotes?|represents?|refers to|steht für|bedeutet|wird ersetzt|signifie|désigne|est remplacé|significa|representa|se sustituye)\b", re.I)
QUOTED = re.compile(r"(?<!\w)'[^'\n]+'(?!\w)|\"[^\"\n]+\"|“[^”\n]+”|„[^“\n]+“|«[^»\n]+»|`[^`\n]+`")
FORMAL = re.compile(r"\$(?![{])[^$\n]+\$(?![{])|\\\w+\{[^}\n]*\}|=\s*\{\{[^}\n]*\}\}")
RECORD = re.compile(r"@\w+\{")
SEGMENT_END = re.compile(r"\n|[.!?] ")
PIECE = re.compile(r"(?P<path>(?:\w+:/)?/[\w./?=&%-]+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}\b(?:/\S*)?)|(?P<fault>\b[A-Z]\w*[a-z](?:Error|Exception)\b)|(?P<number>\b\d[\w]*)|[^\W\d_]+")


@cache
def _tables():
    """The automaton of anchors and that of whole phrases; built once in a worker."""
    import ahocorasick

    phrases = ahocorasick.Automaton()
    role: dict[str, set] = {}
    for kind, part, group in (("error", "core", ERRORS), ("error", "near", NEAR_ERRORS), ("script", "object", SCRIPT), ("script", "demand", DEMANDS), ("script", "near", NEAR_SCRIPT), ("filler", "core", FILLER), ("filler", "near", NEAR_FILLER)):
        for x in group:
            role.setdefault(f" {x} ", set()).add((kind, part))
    for x, roles in role.items():
        phrases.add_word(x, (x.count(" ") - 1, tuple(roles)))
    phrases.make_automaton()
    anchors = ahocorasick.Automaton()
    seek: dict[str, list] = {a: [re.compile(p) for p in ps] for a, ps in MARKS.items()}
    for x in [*ERRORS, *SCRIPT, *FILLER]:  # a phrase is looked for where its longest word stands
        word = max((w for w in x.split() if w[0] != "#"), key=len, default="")
        if word:
            seek.setdefault(word, [])
    for a in ("error", "exception", " line "):  # the names of program errors, and places in files
        seek.setdefault(a, [])
    for a, ps in seek.items():
        anchors.add_word(a, ("mark" if ps else "phrase", a, ps))
    for r in {x for row in ROWS for x in (row, row[::-1])}:
        for k in range(len(r) - 3):
            if not anchors.exists(r[k : k + 4]):
                anchors.add_word(r[k : k + 4], ("walk", r[k : k + 4], []))
    anchors.make_automaton()
    return anchors, phrases


def _with_words(lexicon: frozenset):
    """The automaton of filler words, each between marks that are no letters."""
    import ahocorasick

    words = ahocorasick.Automaton()
    for w in lexicon | LATIN:
        words.add_word(w, len(w))
    words.make_automaton()
    return words


def _walk_word(w: str) -> bool:
    return len(w) >= 4 and any(w in r or w[::-1] in r for r in ROWS)


def _walks(low: str) -> list[tuple[int, int]]:
    """Runs of at least two keyboard walks."""
    out, run = [], []
    for m in [*re.finditer(r"[^\W\d_]+", low), None]:
        if m and (_walk_word(m.group()) or m.group() in ("qwerty", "qwertz", "azerty")):
            run.append(m.span())
            continue
        if len(run) >= 2:
            out.append((run[0][0], run[-1][1]))
        run = []
    return out


def _loops(low: str) -> list[tuple[int, int]]:
    """Spans of one to three words said at least four times in a row."""
    ws = low.split()
    if not any(sum(map(eq, ws[u:], ws)) >= 3 * u for u in (1, 2, 3)):
        return []
    found = [(m.group(), m.span()) for m in re.finditer(r"[^\W\d_]+", low)]
    out = []
    for u in (1, 2, 3):
        run = 0
        for k in range(u, len(found) + 1):
            if k < len(found) and found[k][0] == found[k - u][0]:
                run += 1
                continue
            if run >= 3 * u:
                out.append((found[k - u - run][1][0], found[k - 1][1][1]))
            run = 0
    return out


def _runs(low: str, words) -> list[tuple[int, int]]:
    """Spans of at least five filler words with at most two others between neighbours."""
    out, run, n = [], None, 0
    for end, length in words.iter(low):
        a, b = end - length + 1, end + 1
        if (a and low[a - 1].isalpha()) or low[b : b + 1].isalpha():
            continue
        if run is not None and len(low[run[1] : a].split()) <= 3:
            run, n = (run[0], b), n + 1
        else:
            if n >= 5:
                out.append(run)
            run, n = (a, b), 1
    return [*out, run] if n >= 5 else out


class Spans:
    """Spans that do not overlap, in order: the earlier and longer ones of those given."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for a, b in sorted(spans, key=lambda x: (x[0], -x[1])):
            if not self.ends or a >= self.ends[-1]:
                self.starts.append(a)
                self.ends.append(b)

    def around(self, a: int, b: int) -> bool:
        k = bisect_right(self.starts, a) - 1
        return k >= 0 and b <= self.ends[k]


def _records(text: str) -> list[tuple[int, int]]:
    """Bibliographic records from their sign to the brace that closes them."""
    out, end = [], 0
    for m in RECORD.finditer(text):
        if m.start() < end:
            continue
        depth, k = 1, m.end()
        while depth and k < len(text):
            depth += (text[k] == "{") - (text[k] == "}")
            k += 1
        if not depth:
            out.append((m.start(), k))
            end = k
    return out


def _kinds_of(text: str, a: int, b: int, hidden: Spans, phrases) -> list[tuple[str, int, int]]:
    """Residue (kind, from, to) among the words of one segment."""
    words, spans = [], []
    for m in PIECE.finditer(text, a, b):
        if hidden.around(*m.span()):
            words.append("#quoted")
        elif m.lastgroup == "number":
            words.append("#code" if re.fullmatch(r"[45]\d\d", m.group()) else "#")
        else:
            words.append("#" + m.lastgroup if m.lastgroup else m.group().lower())
        spans.append(m.span())
    line = " " + " ".join(words) + " "
    place, n = {}, 0
    for k, c in enumerate(line):
        if c == " ":
            place[k] = n
            n += 1
    hits = []
    for end, (length, roles) in phrases.iter(line):
        first = place[end] - length
        hits.extend((first, first + length, kind, part) for kind, part in roles)
    out = []
    for kind in {h[2] for h in hits if h[3] != "near"}:
        mine = [h for h in hits if h[2] == kind]
        core = [h for h in mine if h[3] in ("core", "object")]
        if not core or (kind == "script" and not any(h[3] == "demand" for h in mine)):
            continue
        # a message that begins with a capital in the midst of a sentence begins a segment of its own
        start = 0
        for f, _, _, part in sorted(mine):
            while f and words[f - 1] in LEADING:
                f -= 1
                if text[spans[f][0]].isupper():
                    break
            if f > start and (text[spans[f][0]].isupper() or words[f] == "#code") and not any(h[0] < f for h in core):
                start = f
        covered = set()
        for f, t, _, _ in mine:
            covered.update(range(max(f, start), t))
        # what stands before a colon is the message, the rest explains it
        head = next((k + 1 for k in range(start, len(words) - 1) if ":" in text[spans[k][1] : spans[k + 1][0]]), None)
        whole = head is not None and covered >= set(range(start, head)) and any(start <= h[0] < head for h in core)
        if whole or len(covered) >= SEGMENT_SHARE * (len(words) - start):
            out.append((kind, spans[start][0], b))
    return out


def judge(text: str | None, words, document_share: float = 0.0) -> tuple[bool, float, str]:
    """(excluded, share of the document that residue covers, kinds found)."""
    if text is None or not text.strip():
        return False, 0.0, ""
    low = text.lower()
    if len(low) != len(text):  # a few letters change length in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    anchors, phrases = _tables()
    marks, places, walk = [], [], False
    for end, (sort, anchor, patterns) in anchors.iter(low):
        if sort == "walk":
            walk = True
        elif sort == "phrase":
            if not low[end + 1 : end + 2].isalpha():
                places.append(end)
        else:
            at = end - len(anchor) + 1
            marks.extend(m for p in patterns if (m := p.match(text, at)))
    found = [("noise", a, b) for a, b in (_walks(low) if walk else [])] + [("noise", a, b) for a, b in _loops(low)]
    if sum(b - a for _, a, b in found) < min(20, NOISE_SHARE * len(low)):
        found = []
    found += [("filler", a, b) for a, b in _runs(low, words)]
    if marks or places:
        hidden = Spans([m.span() for p in (FORMAL, QUOTED) for m in p.finditer(text)] + (_records(text) if "@" in text else []))
        starts = [0, *(m.end() for m in SEGMENT_END.finditer(text)), len(text) + 1]

        def segment(at: int) -> tuple[int, int]:
            """The sentence or line around a place."""
            k = bisect_right(starts, at)
            return starts[k - 1], min(starts[k], len(text))

        for m in marks:
            a, b = m.span()
            if not hidden.around(a, b) and not NAMING.search(text, max(0, a - 40), a) and not NAMED.match(text, b):
                found.append(("mark", *segment(a)))
        for a, b in dict.fromkeys(map(segment, places)):
            found += _kinds_of(text, a, b, hidden, phrases)
    if not found:
        return False, 0.0, ""
    covered, end = 0, 0
    for _, a, b in sorted(found, key=lambda x: x[1:]):
        covered += max(0, b - max(a, end))
        end = max(end, b)
    share = min(1.0, covered / len(text.strip()))
    return share >= document_share, share, " ".join(sorted({k for k, _, _ in found}))


def filler_words(docs: DataFrame, text: str = "text") -> list[str]:
    """Words of which at least a third of the documents are documents with known filler words, counted over the whole collection."""
    low = F.lower(F.col(text))
    tokens = F.array_distinct(F.split(low, r"[^\p{L}]+"))
    known = F.array(*[F.lit(w) for w in sorted(LATIN)])
    # words are taken apart only where a known one may stand
    maybe = docs.where(low.rlike("|".join(sorted(LATIN)))).where(~low.rlike(r"['\"“„«]\s*lorem ipsum"))
    opened = cut(maybe.select(tokens.alias("ts")).where(F.size(F.array_intersect("ts", known)) >= 2))
    total = opened.count()
    if not total:
        return []
    inside = opened.select(F.explode("ts").alias("w")).where("length(w) > 2").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    few = {r.w: r.n for r in inside.where(F.col("n") >= max(2, THETA * total)).collect()}  # at most (words of a filler text)/THETA
    discard(opened)
    asked = F.array(*[F.lit(w) for w in sorted(few)])
    near = docs.where(low.rlike("|".join(sorted(few)))).select(F.explode(F.array_intersect(tokens, asked)).alias("w"))
    everywhere = {r.w: r.n for r in near.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(w for w, n in few.items() if 3 * n >= everywhere.get(w, n))


def residue(docs: DataFrame, id: str = "doc_id", text: str = "text", document_share: float = 0.0) -> DataFrame:
    """(id, share, kinds) of the documents to exclude."""
    lexicon = docs.sparkSession.sparkContext.broadcast(filler_words(docs, text))
    kind = dict(docs.dtypes)[id]

    def scan(batches):
        import pandas as pd

        words = _with_words(frozenset(lexicon.value))
        for pdf in batches:
            out = [(i, *got[1:]) for i, t in zip(pdf["id"], pdf["text"]) if (got := judge(t, words, document_share))[0]]
            # typed, because an empty list would become numbers
            yield pd.DataFrame({id: pd.Series([o[0] for o in out], dtype=pdf["id"].dtype), "share": pd.Series([o[1] for o in out], dtype="float64"), "kinds": pd.Series([o[2] for o in out], dtype=object)})

    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).where("text is not null").mapInPandas(scan, f"{id} {kind}, share double, kinds string")
