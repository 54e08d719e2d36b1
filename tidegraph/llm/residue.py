"""Template residue and error-page text, found from trusted cases outward by SimHash.

1. Texts are normalised (case, digits, hexadecimal numbers and blanks) and exact copies collapse to
   one representative, so that a page sent a million times is one row from there on.
2. Trusted labels: a text with an unfilled placeholder or filler anywhere, or one all of whose
   sentences are an error message, a notice, its tail, or a site's menu and title.
3. Representatives get a SimHash of their five-word shingles, and an entry for each shingle of
   their prefix: the rarest of the corpus, so many that two texts of the least similarity share one.
   The entries are partitioned by shingle, so no near pair is left out. Unlabelled
   representatives of a like number of shingles meet labelled residue there, are verified by Hamming distance and by
   the shingle similarity of the texts, and take the label over. New ones go on to their neighbours
   until none is new: the labels run through the connected components of residue, whose
   pairs are never listed: only a labelled and an unlabelled text are compared.
4. An exact check on the text itself ends it. A page like a notice is one if the sentences it has of its own
   are few, and each holds words of notices or varies one of the other page. A page like one with a
   placeholder or filler takes the label over if it has the filler too, or signs of a blank in the placeholder's place:
   the same letter filled in is no residue.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.session import cut, hint_small, table

#: Words of a shingle, least shingle similarity, most differing bits of 64 (at the least similarity about 10 differ).
SHINGLE, SIMILAR, MOST_BITS = 5, 0.8, 28
#: Buckets of shingle hashes whose counts order the shingles: 2 MB, whatever the input.
BUCKETS = 1 << 18
#: Tables and bits of a key of sampled bits. They miss near pairs at the least similarity and only sort texts roughly.
TABLES, KEY_BITS = 32, 16
#: Most words of its own of a near notice, as a share of all; least share of words of a sentence that varies another.
OWN_SHARE, VARIES = 0.25, 0.5
#: Rows of labelled keys up to which they're sent to all tasks.
SMALL_ROWS = 200_000

#: The notations of unfilled placeholders, as regular expressions.
PLACEHOLDERS = (
    r"\{\{\s?[\w.]+\s?\}\}",
    r"\{%\s?[\w.]+\s?%\}",
    r"[$#]\{[\w.]+\}",
    r"<%=?\s?[\w.]+\s?%>",
    r"«[\w. ]+»",
    r"<<[\w. ]+>>",
    r"\[\[[\w. ]+\]\]",
    r"@@[\w.]+@@",
    r"(?<![\w%])%[A-Z][A-Z_.]{2,}%",
    r"(?<!\w)__[A-Z][A-Z_.]{2,}__",
    r"(?<![\w{])\{\d\}(?![\w}])",
    r"(?<![\w%])%[sd](?![\w-])",
    r"\[(?:INSERT|INSERTAR|INSERER|EINFÜGEN)[^\]\n]*\]",
    r"<(?:insert|enter|your)\s[^>\n]*>",
    r"\[[A-Z ]*TO BE (?:ADDED|FILLED|COMPLETED|DETERMINED)[^\]\n]*\]",
    r"\((?:name|title|address|date) of (?:the )?[a-z]+\)(?!\w)",
    r"\[(?:enter|insert|your|fill in) [^\]\n]+\]",
    r"(?<!\w)XX/XX/(?:20XX|XXXX|XX)(?!\w)",
    r"\[[A-Z]\w*(?:[. ][A-Z]\w*){0,3}\]",
)
#: Text that stands in for text to come.
FILLERS = (
    r"(?i)(?:^|[\n.!?:])\s*lorem ipsum,?(?:\s+[a-z]+){3}",
    r"(?i)\b(?:sample|your|example) text (?:goes )?here\b",
    r"(?i)\b(?:body|dummy) copy to follow\b|\bthis is (?:dummy|placeholder|sample) (?:copy|text)\b",
    r"(?i)\bclick (?:here )?to add (?:text|title|subtitle)\b",
    r"(?i)\breplace this (?:paragraph|text|sentence) with your own\b",
    r"(?i)\bplaceholder (?:paragraph|text)\.",
    r"(?i)\bquick filler so that\b",
    r"(?i)\btexto de (?:ejemplo|relleno)\.|\bsustituya este texto\b",
    r"(?i)\b(?:blindtext|beispieltext)\b|\btexte (?:factice|d'exemple)\b",
    r"(?i)\bcoming soon\. content for this (?:section|page) is under construction\b",
    r"(?im)^[ \t]*[asdfjkl;]{2,}(?:[ \t]+[asdfjkl;]+){3,}[ \t]*$",
    r"(?i)\b([a-z]{2,20}+(?:\s[a-z]{2,20}+)?)(?:\s\1){5}\b",
)
#: Beginnings of the words of pseudo-Latin filler.
LATIN = (
    "accu", "adip", "aene", "alia", "aliq", "amet", "anim", "ante", "apte", "arcu", "auct", "augu", "aute", "bibe", "blan", "cill", "class", "comm", "condi", "cong",
    "conse", "conub", "conv", "cras", "cubil", "culp", "cupid", "curab", "curs", "dapi", "deser", "diam", "dict", "digni", "dole", "dolo", "done", "duis", "effic", "eges",
    "eius", "eleif", "elem", "elit", "enim", "erat", "eros", "esse", "etia", "euis", "exce", "exer", "facil", "fame", "fauc", "feli", "ferm", "feug", "fini", "fring",
    "fugi", "fusce", "grav", "habit", "hend", "iacul", "imperd", "incid", "inte", "interd", "ipsu", "irur", "jus", "labo", "lacin", "lacus", "laor", "lect", "leo",
    "libe", "ligul", "lobo", "lore", "luct", "maec", "magna", "magni", "male", "mass", "matt", "mauri", "maxim", "metu", "mini", "moles", "moll", "montes", "morb",
    "nasc", "natoq", "neque", "nibh", "nisi", "nisl", "nost", "null", "nunc", "nunq", "occae", "odio", "offic", "orci", "orna", "pari", "parturi", "pell", "phare",
    "phase", "plac", "porta", "portt", "porto", "posu", "potent", "praes", "preti", "primis", "proid", "proin", "pulv", "puru", "quam", "quis", "repreh", "rhonc", "ridic",
    "risu", "rutr", "sagit", "sapi", "scele", "sed", "semp", "senec", "sint", "sodal", "sollic", "sunt", "suscip", "suspend", "tell", "temp", "tinc", "torto", "tris",
    "turp", "ulla", "ullam", "ultri", "urna", "varius", "vehic", "vel", "vene", "veni", "vesti", "vesto", "vita", "vive", "volut", "vulp",
)
_LATIN_WORD = "(?:" + "|".join(f"{a}(?:{'|'.join(w[1:] for w in LATIN if w[0] == a)})" for a in sorted({w[0] for w in LATIN})) + ")[a-z]*"
#: Least words, and share of such ones, of a sentence of filler.
LATIN_WORDS, LATIN_SHARE = 4, 0.6
_ANY = "|".join(f"(?:{p})" for p in PLACEHOLDERS)

#: The reasons of HTTP's status lines.
_REASONS = (
    r"(?:bad request|unauthori[sz]ed|payment required|forbidden|(?:page )?not found|method not allowed|not acceptable|request time-?out|conflict|gone|length required|payload too large|"
    r"uri too long|unsupported media type|too many requests|internal server error|server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)"
)
_SCRIPTS = r"(?:java ?scripts?|js|scripts?|scripting|script support|cookies|(?:a )?(?:newer|modern|supported) browser|cookies and (?:script support|scripts?|scripting|javascript|js))"
_SORRY = r"(?:(?:oops|whoops|uh-?oh|sorry|we(?:'re| are) sorry|our apologies)[,.!:]* (?:but )?)?"
_IT = r"(?:the|this|your|our|that|it)"
_THING = r"(?:page|file|document|record|request|site|view|content|resource|item|map|address|url)"
_WHERE = r"(?:(?:the|this|our|your) )?(?:document viewer|viewer|map|portal|application|app|site|website|library|page|archive|service|browser|dashboard)"
#: Sentences of error pages and notices, whole.
NOTICES = (
    rf"(?:sorry,? )?(?:we (?:could not|cannot|can't|couldn't|were unable to|are unable to)|unable to|failed to|cannot|could not|{_IT} server (?:was|is) (?:not able|unable) to) "
    rf"\w+ {_IT} \w+(?: at this time| right now| because it does not exist|: ?\w[\w ]{{0,20}})?(?: \(code \d+\))?",
    rf"{_IT} (?:requested )?{_THING} (?:(?:failed|was unable) to load|(?:is|was|has been) (?:no longer|not) (?:on this server|available|found|here)|could not be (?:found|loaded|displayed|opened)|does not exist|(?:has|have) been (?:moved|removed|deleted))(?: (?:on|from) this server)?",
    rf"{_SORRY}{_IT} (?:requested )?{_THING} (?:that )?you (?:requested|are looking for|were looking for|have requested|are trying to (?:reach|view|open)) .{{0,60}}",
    rf"{_SORRY}something (?:has gone|went) (?:badly |terribly )?wrong(?: (?:(?:on|at|with) (?:our|the|this|your) (?:side|end|server|page|request|site)|here|while .{{0,40}}|when .{{0,40}}|[-–—] .{{0,40}}))?|{_SORRY}(?:an?|there was an?|there has been an?) (?:unexpected |unknown |internal |application |server )*(?:error|problem)(?: has)?(?: occurred| happened)?(?: .{{0,60}})?",
    rf"{_SORRY}{_IT} (?:requested )?{_THING} (?:cannot|can't|can not|couldn't|could not) be (?:found|reached|loaded|displayed|opened|shown)(?: .{{0,40}})?",
    r"(?:warning|notice|deprecated|strict standards|syntax error|template error|render(?:ing)? error):? .{0,160}\b(?:on|at) line \d+.{0,20}|undefined (?:variable|index|offset|property|array key|method|constant|function)\b.{0,120}",
    r"oops|whoops|uh-?oh",
    rf"(?:http |error |status )*[45]\d\d(?: ?[-:–] ?| )?(?:error )?{_REASONS}?",
    rf"{_REASONS}|access denied|connection (?:timed out|refused|reset)",
    r"(?:fatal|application|parse|runtime|system|server) error:? .{0,120}|traceback \(most recent call last\):?|file \".*\", line \d+.*|\w*(?:error|exception): ?\S.{0,60}",
    r"access denied\.?|you do not have (?:permission|access) to \w+ (?:the|this|that) \w+",
    r"your session has (?:expired|timed out)|(?:the )?(?:database )?connection could not be (?:made|established)",
    r"(?:we are|the site is|this site is) (?:currently )?down for .{0,40}maintenance.{0,50}|(?:the )?(?:site|service) is temporarily (?:down|unavailable)",
    r"checking your browser before you continue|please wait(?: while .{0,60})?|loading ?\.{0,3}",
    rf"(?:please )?(?:enable|activate|allow|turn on|switch on|use) {_SCRIPTS}(?: (?:and|or) .{{0,60}})?(?: (?:to|for|in) .{{0,60}})?",
    rf"(?:if nothing happens, )?(?:allow|enable) {_SCRIPTS} for this \w+",
    rf"(?:you need to|you must|please) (?:enable|allow|activate|turn on|switch on) {_SCRIPTS}(?: .{{0,60}})?",
    rf"{_WHERE} (?:requires?|needs?|depends on|relies on|works only with|only works with|will not (?:run|work|load|start) without|does not (?:run|work) without|cannot (?:run|work|start) without) {_SCRIPTS}"
    r"(?: to be (?:switched|turned) on| to (?:run|work))?(?: ?[-–—;,] ?(?:enable|switch|turn) (?:it|them) on? ?.{0,30}| ?[-–—] enable it to go on)?(?:; see help)?",
    rf"{_SCRIPTS} (?:is|are) (?:disabled|turned off|switched off|off|blocked|required|needed)(?: .{{0,40}})?",
    rf"{_WHERE} cannot (?:work|run|start) without (?:it|them)",
    r"your browser is out of date or blocks scripts; .{0,60}|your browser (?:does not support|is not supported|blocks) .{0,60}",
    rf"we use cookies|accept cookies(?: and (?:enable|allow) {_SCRIPTS})?(?: to .{{0,40}})?",
    rf"cookies must be (?:on|enabled|allowed)",
    r"página no encontrada|la página .{0,40}no (?:existe|se encuentra).{0,30}|acceso denegado|active? (?:el )?javascript.{0,60}|habilite (?:el )?javascript.{0,60}",
    r"seite nicht gefunden|(?:diese|die) seite (?:existiert|wurde) nicht.{0,40}|bitte aktivieren sie javascript.{0,60}|zugriff verweigert",
    r"p[áa]gina (?:não encontrada|non trovata|niet gevonden)|erro interno.{0,40}|errore interno.{0,40}",
    r"page (?:introuvable|non trouvée)|la page .{0,40}(?:n'existe|introuvable).{0,40}|(?:veuillez )?activer? (?:le )?javascript.{0,60}|accès refusé",
)
#: What stands beside them.
TAILS = (
    r"(?:please )?(?:try|sign in|log in|reload|refresh|contact|go back|search|return|change|turn|see|check|click|enable|allow) ?.{0,80}",
    r"(?:request|incident|reference|error|ref|code|id|ray id|trace id)[ :#]+[\w-]+(?: (?:was|has been) (?:logged|recorded|reported))?",
    r"this (?:takes|may take|can take) .{0,40}|vuelva al inicio|zurück.{0,30}|retour.{0,40}|inténtelo.{0,40}|veuillez.{0,50}",
    rf"(?:and )?disable any ad ?blockers?|if nothing happens, .{{0,60}}",
    r"(?:our|the) (?:team|staff|engineers?|developers?|administrators?|support|webmaster) (?:has|have|was|were) (?:already )?been (?:told|notified|informed|alerted).{0,40}|(?:our|the) (?:team|staff|engineers?) (?:is|are) (?:working on|looking into) it",
    rf"{_IT} (?:{_THING} )?(?:may|might|could) have (?:been )?(?:moved|removed|deleted|renamed|expired).{{0,60}}|we apologi[sz]e for .{{0,60}}|sorry for .{{0,60}}",
)
_NOTICE, _TAIL = (re.compile("|".join(f"(?:{p})" for p in x), re.I) for x in (NOTICES, TAILS))
_LATIN = re.compile(_LATIN_WORD)
_CHROME = re.compile(r"(?:menu|home|skip to (?:main )?content|search|contact|about|login|sign in|navigation|toggle navigation|inicio|accueil|startseite)", re.I)
#: In lower case, what every notice, placeholder and filler holds some of. They're looked for as
#: they stand, which costs far less than the expressions; a text without any needs no closer look.
NOTICE_HINTS = (
    "script", "cookie", "browser", "js", "error", "exception", "traceback", "unable", "failed", "not able", "could not", "cannot", "can't", "couldn't",
    "not found", "no longer", "not exist", "denied", "forbidden", "unavailable", "expired", "maintenance", "loading", "connection", "gateway", "encontrad",
    "gefunden", "introuvable", "permission", "please wait", "removed", "no existe", "n'existe", "existiert nicht", "timed out", "timeout", "denegado",
    "verweigert", "refus", "trouv", "unauthori", "bad request", "too many", "gone", "conflict", "too large", "too long", "not allowed", "not acceptable",
    "not implemented", "required", "unsupported", "temporarily", "time-out", "moved", "deleted", "looking for", "not available", "page you", "is not here", "http",
    "no se encuentra", "wurde nicht", "you requested", "you are looking", "you were looking", "down for", "seite nicht", "checking your", "not on this", "not here", "without it", "without them", "do not have access", '", line ',
    "sorry", "oops", "uh-oh", "uhoh", "went wrong", "on line ", "at line ", "undefined", "a problem", "can not be", "não encontrada", "non trovata", "niet gevonden", "erro ", "trying to",
)
#: Of the hints, those that prose seldom has: a sentence that holds one can be of a notice.
NOTICE_WORDS = (
    "javascript", "java script", "cookie", "browser", "traceback", "exception", "unable to", "could not be", "not found", "does not exist", "access denied", "forbidden",
    "unavailable", "session", "timed out", "timeout", "gateway", "bad request", "encontrad", "no se encuentra", "nicht gefunden", "introuvable", "this page", "this server", "ad blocker",
)
FILLER_HINTS = (
    "lorem ipsum", "text here", "goes here", "copy to follow", "is dummy", "is placeholder", "is sample", "to add", "with your own", "placeholder",
    "quick filler", "texto de", "sustituya este", "blindtext", "beispieltext", "texte factice", "texte d'exemple", "coming soon",
)
_STATUS = r"(?<![\w.,$])[45]\d\d(?![\w.,%])"
#: Signs of a blank, in place of a placeholder.
_BLANK = re.compile(r"[\[\]{}<>«»~|\\^…]|_{2,}|@@|(?<!\w)@|\.{3,}|X{2,}")
_MARKS = r"[{<«]|@@|__|\[\[|\[[A-Zeify]|%[A-Zsd]|\((?:name|title|address|date) |XX/"


def _automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for w in words:
        out.add_word(w)
    out.make_automaton()
    return out


@lru_cache(maxsize=1)
def _finders() -> tuple:
    """Made once per Python worker: automata of the hints, and the expressions."""
    return (
        _automaton(NOTICE_HINTS), _automaton(FILLER_HINTS), re.compile(_STATUS), re.compile(_MARKS), re.compile(_ANY),
        [re.compile(f) for f in FILLERS[:-2]], re.compile(FILLERS[-2]), re.compile(FILLERS[-1]),
    )


@lru_cache(maxsize=4096)
def sentence_kind(s: str) -> str:
    """``notice``, ``tail``, ``chrome`` or ``content``."""
    s = " ".join(s.split()).strip(" .!*")
    if not s or _CHROME.fullmatch(s) or (s.count("|") and all(len(p.split()) <= 3 for p in s.split("|"))):
        return "chrome"
    if _NOTICE.fullmatch(s):
        return "notice"
    if _TAIL.fullmatch(s):
        return "tail"
    return "content"


def sentences(text: str) -> list[str]:
    out: list[str] = []
    for line in text.splitlines():
        out += re.split(r"(?<=[.!?])\s+", line.strip())
    return [s for s in out if s.strip()]


def is_latin(text: str) -> bool:
    """Whether a sentence of the text is pseudo-Latin filler."""
    for s in sentences(text):
        words = re.findall(r"[^\W\d_]+", s.lower())
        if len(words) >= LATIN_WORDS and sum(bool(_LATIN.fullmatch(w)) for w in words) >= LATIN_SHARE * len(words):
            return True
    return False


def is_title(s: str) -> bool:
    return len(s.split()) <= 6 and s[-1:] not in ".!?;:," and not re.search(r"\d", s) and bool(re.match(r"[^\W\d_]", s))


def is_notice(text: str) -> bool:
    """Whether the text is a message or notice and nothing else but menu, title and tail."""
    if _NOTICE.fullmatch(" ".join(text.split()).strip(" .!*")):
        return True
    kinds = []
    lines = [x for x in (line.strip() for line in text.splitlines()) if x]
    for i, line in enumerate(lines):
        for s in re.split(r"(?<=[.!?])\s+", line):
            kind = sentence_kind(s)
            if kind == "content" and i == 0 and len(lines) > 1 and is_title(line):
                kind = "chrome"
            kinds.append(kind)
            if kind == "content":
                return False
    return "notice" in kinds


def hinted(text: str) -> bool:
    """Whether the text can be a notice: one pass over it for all hints."""
    notice, status = _finders()[0], _finders()[2]
    return next(notice.iter(text.lower()), None) is not None or status.search(text) is not None


def marked(text: str, words: list[str]) -> bool:
    """A placeholder or filler anywhere in the text. words: those of the text, in lower case."""
    _, hints, _, marks, placeholder, fillers, keys, repeated = _finders()
    if marks.search(text) and placeholder.search(text):
        return True
    if next(hints.iter(text.lower()), None) is not None and any(f.search(text) for f in fillers):
        return True
    if keys.search(text):
        return True
    # Words that follow themselves, or the one before, can be repeated ones; three in a row of Latin look, filler.
    if sum(a == b for a, b in zip(words, words[1:], strict=False)) >= 5 or sum(a == b for a, b in zip(words, words[2:], strict=False)) >= 9:
        if repeated.search(text):
            return True
    return "111" in "".join(map(_latin_word, words)) and is_latin(text)


@lru_cache(maxsize=1 << 16)
def _latin_word(w: str) -> str:
    return "1" if _LATIN.fullmatch(w) else "0"


_WORD, _HEX = re.compile(r"[^\W_]+"), re.compile(r"(?<!\w)(?=[a-f]*\d)[0-9a-f]{5,}(?!\w)|\d+")
_DIGITS = str.maketrans("123456789", "000000000")


def normal_words(text: str, hint: bool) -> list[str]:
    """The words in lower case; numbers masked, in texts that may be notices also hexadecimal ones."""
    lower = text.lower()
    return _WORD.findall(_HEX.sub("0", lower) if hint else lower.translate(_DIGITS))


def normal(text: str) -> str:
    return " ".join(normal_words(text, hinted(text)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every shingle. A text of fewer words is one shingle."""
    words = [t.split() for t in texts]
    known: dict[str, int] = {}
    flat = np.fromiter((known.setdefault(w, zlib.crc32(w.encode()) | (len(w) << 32)) for ws in words for w in ws), np.uint64)
    flat = _mix(flat)
    count = np.array([len(w) for w in words], np.int64)
    n = np.where(count == 0, 0, np.maximum(1, count - SHINGLE + 1))
    owner = np.repeat(np.arange(len(texts)), n)
    first = np.repeat(np.cumsum(count) - count, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    last = np.repeat(np.cumsum(count), n)
    h = np.zeros(len(first), np.uint64)
    for k in range(SHINGLE):
        at = first + k
        inside = at < last
        w = np.where(inside, flat[np.minimum(at, max(len(flat) - 1, 0))] if len(flat) else 0, np.uint64(0))
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w)
    return h, owner


def simhash(texts: list[str]) -> np.ndarray:
    h, owner = shingle_hashes(texts)
    out = np.zeros(len(texts), np.uint64)
    # In blocks of shingles, so that a very long text doesn't need 64 bytes a shingle at once.
    sums = np.zeros((len(texts), 64), np.int64)
    for a in range(0, len(h), 1 << 16):
        part, own = h[a : a + (1 << 16)], owner[a : a + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        total = np.add.reduceat(bits, starts, axis=0)
        size = np.diff(np.r_[starts, len(own)])
        sums[own[starts]] += 2 * total - size[:, None]
    for b in range(64):
        out |= (sums[:, b] > 0).astype(np.uint64) << np.uint64(b)
    return out


def table_bits() -> list[list[int]]:
    """Which bits each table's key samples: fixed by a seed."""
    rng = np.random.default_rng(20240229)
    return [sorted(rng.choice(64, KEY_BITS, replace=False).tolist()) for _ in range(TABLES)]


def keys_of(signature: np.ndarray) -> np.ndarray:
    """(texts, TABLES) int32 keys; the table's number is in the upper bits."""
    out = np.empty((len(signature), TABLES), np.int32)
    for t, bits in enumerate(table_bits()):
        key = np.zeros(len(signature), np.int64)
        for i, b in enumerate(bits):
            key |= ((signature >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
        out[:, t] = key | (t << KEY_BITS)
    return out


SIGNED = "h long, n int, signature long, keys array<long>"


def prefixes(texts: list[str], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's first shingles, and its number of different ones. Two texts of at least
    ``SIMILAR`` have one in common: of n, as many as can be missing from the other, and one more. This holds for
    every order that is one for all texts; the rarest come first, by ``counts`` of the buckets of their hashes, so that
    sentences which many texts share bring none together."""
    h, owner = shingle_hashes(texts)
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    sets = [np.unique(h[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    if counts is not None:
        sets = [x[np.argsort(counts[x & np.uint64(BUCKETS - 1)], kind="stable")] for x in sets]
    size = np.array([len(x) for x in sets], np.int32)
    return [x[: len(x) - int(np.ceil(SIMILAR * len(x) - 1e-9)) + 1] for x in sets], size


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all shingles of a partition, how many fall into each bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        h, _ = shingle_hashes(b["normal"].to_pylist())
        total += np.bincount((h & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """How many shingles of all texts fall into each of ``BUCKETS`` buckets: as long a list at every size of the input."""
    rows = texts.select("normal").mapInArrow(_counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def similarity(a: str, b: str) -> float:
    """Jaccard similarity of the shingle sets."""
    x, y = (set(shingle_hashes([t])[0].tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


@F.pandas_udf(T.FloatType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float32")


def _own(text: str) -> list[str]:
    """The content sentences, words only."""
    return [w for t in sentences(text) if sentence_kind(t) == "content" and not is_title(t) and (w := _words(t))]


def _words(s: str) -> str:
    return " ".join(re.sub(r"\d+|[^\w\s']", " ", s.lower()).split())


def _share(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y) if x or y else 1.0


def still_notice(text: str, origin: str) -> bool:
    """Whether what ``text`` has and the notice ``origin`` lacks is of a notice too: few words, in
    sentences with the vocabulary or a placeholder, or that vary a sentence of ``origin``."""
    theirs = {w for t in sentences(origin) if (w := _words(t))}
    mine = [w for w in _own(text) if w not in theirs]
    if sum(len(w.split()) for w in mine) > OWN_SHARE * len(text.split()):
        return False
    return all(any(h in w for h in NOTICE_WORDS) or any(_share(w, t) >= VARIES for t in theirs) for w in mine)


def spots(text: str) -> str:
    """JSON of where a text's placeholders stand (words before, words after) and its fillers (a sentence)."""
    out: list[list[str]] = []
    for m in re.finditer(_ANY, text):
        out.append([" ".join(text[: m.start()].split()[-3:]), " ".join(text[m.end() :].split()[:3])])
    for t in sentences(text):
        if any(re.search(f, t) for f in FILLERS) or is_latin(t):
            out.append([_words(t)])
    return json.dumps(out)


def still_marked(text: str, mark: str) -> bool:
    """Whether one of the spots is still unfilled in ``text``."""
    flat = " ".join(text.split())
    for spot in json.loads(mark):
        if len(spot) == 1:
            if any(_share(_words(t), spot[0]) >= VARIES for t in sentences(text)):
                return True
        elif any(spot):
            before, after = (re.escape(x) for x in spot)
            start = before or "^"
            m = re.search(rf"{start}\s?(\S+(?: \S+){{0,5}}?)\s?{after}" if after else rf"{start}\s?(\S+)$", flat)
            if m and _BLANK.search(m[1]):
                return True
    return False


@F.pandas_udf(T.StringType())
def _mark(texts: pd.Series, notices: pd.Series) -> pd.Series:
    return pd.Series(["" if n else spots(t) for t, n in zip(texts, notices, strict=True)], dtype="object")


@F.pandas_udf(T.BooleanType())
def _still(text: pd.Series, origin: pd.Series, mark: pd.Series) -> pd.Series:
    """Whether ``text`` is residue as the text is that the label came from. mark: "" for a notice, else its spots."""
    return pd.Series([still_marked(a, m) if m else still_notice(a, b) for a, b, m in zip(text, origin, mark, strict=True)], dtype="bool")


def _signing(counts: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["normal"].to_pylist()
            s, (keys, n) = simhash(texts), prefixes(texts, counts.value)
            ends = np.cumsum([0, *(len(k) for k in keys)])
            flat = np.concatenate([*keys, np.empty(0, np.uint64)]).view(np.int64)
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([b["h"], pa.array(n, pa.int32()), pa.array(s.view(np.int64)), listed], names=["h", "n", "signature", "keys"])

    return signed


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text -> key, marked, notice, h, n, normal, text: one pass over each text. h: of its words and mark. n: a text has
    at least so many different shingles, as each word but the last four begins one. Blank texts are left out."""
    for b in batches:
        keep, out = [], []
        for i, t in enumerate(b["text"].to_pylist()):
            if t is None or not t.strip():
                continue
            hint = hinted(t)
            words = normal_words(t, hint)
            mark, flat = marked(t, words), " ".join(words)
            keep.append(i)
            out.append((mark, hint and is_notice(t), xxhash.xxh64_intdigest(flat, int(mark)) - (1 << 63), max(1, len(set(words)) - (SHINGLE - 1)), flat))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kept = b.take(pa.array(keep, pa.int32()))
        kinds = (pa.bool_(), pa.bool_(), pa.int64(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([kept["key"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), kept["text"]], names=["key", "marked", "notice", "h", "n", "normal", "text"])


def residue(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, reason): the rows that are residue; reason is ``marked``, ``notice`` or ``near``.

    Null, empty and blank texts aren't residue. Repeated rows give one row per distinct key and
    reason. Extra columns are dropped; an empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    schema = T.StructType([T.StructField("key", base.schema["key"].dataType), *T._parse_datatype_string("marked boolean, notice boolean, h long, n int, normal string, text string").fields])
    rows = cut(base.mapInArrow(_labelled, schema))
    # One representative of all copies. A page label holds for all of them. Signed ones have their number of shingles.
    reps = cut(
        rows.where(F.col("normal") != "")
        .groupBy("h")
        .agg(F.bool_or("notice").alias("page"), F.bool_or("marked").alias("spot"), F.min(F.struct("normal", "text")).alias("t"), F.min("n").alias("n"))
        .select("h", "page", "spot", "t.normal", "t.text", "n")
    )
    counts = spark.sparkContext.broadcast(shingle_counts(reps))
    sign = _signing(counts)
    texts = reps.select("h", "normal", "text")
    first = reps.where(F.col("page") | F.col("spot"))
    front = cut(first.select("h", "n", "normal").mapInArrow(sign, SIGNED))
    marks = cut(first.select("h", _mark("text", "page").alias("mark")))
    signed, reach, taken = None, 0, None
    while True:
        # Only texts of a size that can be near to a labelled one need a signature; as labels reach
        # larger texts, so do the signatures.
        largest = front.agg(F.max("n")).first()[0] or 0
        if largest / SIMILAR > reach:
            further = reps.where(~F.col("page") & ~F.col("spot") & (F.col("n") > reach) & (F.col("n") <= largest / SIMILAR)).select("h", "n", "normal").mapInArrow(sign, SIGNED)
            signed, reach = cut(further if signed is None else signed.unionByName(further)), largest / SIMILAR
        if signed is None:
            break
        entries = front.select(F.col("h").alias("from"), F.col("signature").alias("s2"), F.col("n").alias("m"), F.explode("keys").alias("k"))
        known = (signed if taken is None else signed.join(taken, "h", "left_anti")).select("h", "n", "signature", F.explode("keys").alias("k"))
        near = (
            known.join(hint_small(entries, SMALL_ROWS), "k")
            .where((F.col("n") >= SIMILAR * F.col("m")) & (F.col("m") >= SIMILAR * F.col("n")))
            .where(F.bit_count(F.col("signature").bitwiseXOR(F.col("s2"))) <= MOST_BITS)
            .select("h", "from")
            .distinct()
        )
        verified = (
            near.join(texts, "h")
            .join(texts.select(F.col("h").alias("from"), F.col("normal").alias("n2"), F.col("text").alias("t2")), "from")
            .join(marks.withColumnRenamed("h", "from"), "from")
            .where((_similarity("normal", "n2") >= SIMILAR) & _still("text", "t2", "mark"))
        )
        # What a page carries on: being a notice comes first.
        new = cut(verified.groupBy("h").agg(F.min("mark").alias("mark")))
        if new.isEmpty():
            break
        marks, new = new, new.select("h")
        taken = new if taken is None else cut(taken.unionByName(new))
        front = cut(signed.join(new, "h", "left_semi"))
    pages = reps.where("page").select("h", F.lit("notice").alias("reason"))
    if taken is not None:
        pages = pages.unionByName(taken.select("h", F.lit("near").alias("reason")))
    found = rows.where("marked").select("key", F.lit("marked").alias("reason")).unionByName(
        rows.where(~F.col("marked")).join(pages, "h").select("key", "reason")
    )
    return found.distinct().withColumnRenamed("key", key)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are template residue, filler, error pages or notices."""
    return residue(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id").distinct()


def p10_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without them, each with its number of characters."""
    docs = table(spark, sf_dir, "documents")
    return docs.join(p10_found(spark, sf_dir), "doc_id", "left_anti").select("doc_id", F.length("text").alias("n_chars"))


QUERIES = {"p10_found": p10_found, "p10_kept": p10_kept}
#: Neither SimHash nor the grammar of notices is SQL; the tests have fixtures and a brute-force version.
ORACLE: dict[str, str] = {}
