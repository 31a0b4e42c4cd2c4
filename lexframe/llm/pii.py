"""Personal information inside free text: found, scored, and replaced by typed placeholders.

Regular expressions propose spans, checksum validators (Luhn, mod-97, mod-23, the mod-11 of 18-digit
numbers) confirm them, and context words near a span adjust its score; a span counts from
``THRESHOLD`` on. A number that fails the check of its kind is none, unless a label right before it
calls it one. Names are the matter of ``names``. Of overlapping spans the one of the stronger kind
wins (email, address, id, phone, name), then the longer. Positions are code points, zero-based, end
exclusive. Whole texts are read, and whatever begins a span is followed to its real edge.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm import names as nm
from lexframe.llm.names import Names

KINDS = ("email", "address", "id", "phone", "name")
THRESHOLD = 0.5
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
NUMBER_WORDS = "zero oh one two three four five six seven eight nine"
_S = r"[\s.\-‐‑–−－．]"  # one separator inside a number
_EDGE = r"(?![A-Za-z0-9\d])(?![\-‐‑–−－./／]\d)"
_PHONES = [
    (re.compile(p + _EDGE), score, local)
    for p, score, local in (
        (rf"[+＋]\d{{1,3}}{_S}?(?:[(（]\d{{1,4}}[)）])?(?:{_S}?\d{{1,11}}){{1,6}}", 0.7, False),
        (rf"[0０]{{2}}{_S}?(?![0０]{{2}})\d{{2}}(?:{_S}\d{{1,6}}){{2,5}}", 0.7, False),
        (rf"[(（]\d{{2,5}}[)）]{_S}?\d{{3,4}}{_S}\d{{4}}", 0.7, False),
        (rf"[8８]{_S}?[(（]\d{{3}}[)）]{_S}?\d{{3}}{_S}\d{{2}}{_S}\d{{2}}", 0.7, False),
        (rf"[8８]{_S}\d{{3}}{_S}\d{{3}}{_S}\d{{2}}{_S}\d{{2}}", 0.7, False),
        (rf"(?:[1１]{_S})?\d{{3}}{_S}\d{{3}}{_S}\d{{4}}", 0.7, False),
        (rf"[0０]\d(?:{_S}\d{{2}}){{4}}", 0.7, False),
        (rf"[0０]\d{{1,2}}{_S}\d{{4}}{_S}\d{{4}}", 0.7, False),
        (r"[0０]\d{1,2}[/／]\d{5,6}[\-‐‑–−－]\d{1,4}", 0.7, False),
        (rf"[0０]\d{{2}}{_S}\d{{5}}{_S}\d{{3}}", 0.7, False),
        (rf"[0０]\d{{2,4}}{_S}\d{{6}}", 0.6, False),
        (rf"[0０]\d{{2}}{_S}\d{{8}}", 0.6, False),
        (rf"\d{{3}}{_S}\d{{3}}{_S}\d{{3}}", 0.5, False),
        (r"\d{3}[\-‐‑–−－]\d{4}", 0.5, True),
        (r"\d{9,11}", 0.25, False),
    )
]
_IDS = [
    (re.compile(p + _EDGE), score, check)
    for p, score, check in (
        (r"[A-Za-z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Da-d]", 0.6, None),
        (r"[A-Za-z]{2}\d{2}(?:\s?[A-Za-z0-9]{4}){2,7}(?:\s?[A-Za-z0-9]{1,3})?", 0.2, "iban"),
        (r"[XYZxyz]\d{8}", 0.6, None),
        (r"[A-Za-z]\d{2}[A-Za-z]\d{5}", 0.6, None),
        (r"\d{3}[\s\-‐‑–]\d{2}[\s\-‐‑–]\d{4}", 0.6, None),
        (r"\d{3}\.\d{3}\.\d{3}-\d{2}", 0.6, None),
        (r"\d\s\d{2}\s\d{2}\s\d{2}\s\d{3}\s\d{3}\s\d{2}", 0.6, "nir"),
        (r"\d{17}[\dXx]", 0.5, "han"),
        (r"\d{8}-?[A-Za-z]", 0.5, "dni"),
        (r"\d{2}\s\d{2}\s\d{6}", 0.6, None),
        (r"\d{4}\s\d{4}\s\d{4}(?:\s\d{4})?", 0.4, "luhn"),
        (r"\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{1,7}", 0.3, "luhn"),
        (r"\d{9}", 0.25, None),
    )
]
_ID_WORDS = re.compile(
    r"national id|passport|passnummer|identity|\bid\b|\bnumber\b|sheet|reviewer|ausweis|identit[éy]|identidad|паспорт|身分証|番号|身份证|证件|iban|konto|account|karte|carte|tarjeta|ssn|social security|tax|steuer|\bnif\b|\bdni\b", re.I
)
# A label right before a number: it is one, whatever its check says.
_ID_LABEL = re.compile(
    r"(?:national id|\bid|identity (?:number|card)|passport|ausweis(?:nummer)?|carte d['’]identité|identidad|\bdni|\bnif|\biban|паспорт|身分証番号|身份证号码?|证件号|ssn|social security(?: number)?|tax (?:id|number))"
    r"(?:\s?(?:no|nr|nº|n°|№|number|nummer|is|ist|est|es)\b)?[.:：]?\s{0,2}$", re.I
)
_PHONE_WORDS = re.compile(r"\btel|tél|тел|phone|telefon|ring\b|\bcall\b|llamar|appeler|anrufen|звон|電話|または|电话|拨打|\bfax|mobile|handy|evenings|abends|number|wrote|correo|courriel|почта", re.I)
_ADDRESS_WORDS = re.compile(r"lives? at|address|moved|visited|write to|proof|\bsend|wohn|anschrift|adresse|habite|vivo|vive|dirección|адрес|прислать|住所|地址|寄", re.I)
_WS = r"[\s ]"
_ADDRESS = [
    re.compile(p, re.I)
    for p in (
        rf"\d(?<![A-Za-z0-9.].)\d*(?:[-–]\d+)?[a-z]?,?{_WS}+(?:[^\W\d_]+{_WS}+){{1,3}}?(?:street|st|road|rd\.|rd|lane|close|terrace|hill|row|avenue|ave)(?![A-Za-zÀ-ɏ0-9])(?:,{_WS}(?:apt|flat|unit){_WS}\d+[a-z]?)?",
        rf"(?:straße|strasse|str\.|weg|gasse|platz|allee){_WS}\d+(?:[-–]\d+)?(?:{_WS}?[a-z](?![^\W_]))?",
        rf"(?-i:[aizAIZİı])(?<![^\W_].)(?:(?<=[ai])m|(?<=a)n der|(?<=z)um){_WS}[^\W\d_]+{_WS}\d+(?:{_WS}?[a-z](?![^\W_]))?(?![\d-])",
        rf"\d(?<![A-Za-z0-9.].)\d*(?:[-–]\d+)?[a-z]?(?:{_WS}(?:bis|ter|quater))?,?{_WS}(?:rue|avenue|av\.|boulevard|bd|chemin|place|impasse|allée|quai){_WS}(?:(?:de la|des|du|de|le|la){_WS}|[dl]['’])*[^\W\d_]+(?:[-'’][^\W\d_]+)*",
        rf"(?<![^\W_])(?:c/|calle|avda\.?|avenida|plaza|paseo){_WS}(?:(?:de la|del|de){_WS})?[^\W\d_]+,?{_WS}(?:(?:nº|n\.º|núm\.){_WS}?)?\d+[a-z]?(?:,{_WS}\d+º(?:{_WS}[^\W\d_](?![^\W_]))?)?",
        rf"(?<![^\W_])(?:ул\.|улица|пер\.|переулок|просп\.|проспект|наб\.|бульвар){_WS}[^\W\d_]+,{_WS}(?:(?:д\.|дом){_WS})?\d+[а-я]?(?:,{_WS}(?:корп\.|стр\.){_WS}?\d+)?(?:,{_WS}кв\.{_WS}?\d+)?",
        r"[一-鿿]+?[市区町村郡][一-鿿]*?\d+(?:丁目\d+(?:[\-－‐–]\d+)*|番地(?:\d+号)?|(?:[\-－‐–]\d+)+)",
        r"[一-鿿]{2}(?:路|街|巷|大道|胡同)\d+(?:弄\d+)?号(?:\d+单元)?(?:\d+室)?",
    )
]
_EN, _DE = _ADDRESS[:2]
_EN_LEAD = re.compile(rf"(?:(?<![A-Za-z])(?:flat|apt|apartment|unit){_WS}\d+[a-z]?,?{_WS}+)?(?:(?<![A-Za-z])no\.?{_WS}?)?$", re.I)
_SMALL_START = re.compile(r"(?:im|zum|an der)\s")
_NO_ADDRESS = re.compile(
    rf"(?:am|an der|im|zum){_WS}(?:[^\W\d_]+{_WS}\d{{4}}|(?:jahre?|januar|februar|märz|april|mai|juni|juli|august|september|oktober|november|dezember|eintrag|sinne?|beispiel|band|heft|kapitel|abschnitt|absatz|artikel|"
    rf"punkt|teil|satz|vers|fall|alter|wert|index|register|bedeutung|seite|zeile|stelle|nummer|karte|kasten|fach){_WS}\d)", re.I
)
# What must stand in a text (in lower case) for each of the forms above to be looked for.
_STREET_WORDS = (
    ("st", "rd", "road", "lane", "close", "terrace", "hill", "row", "ave"), ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee"), ("am ", "an der ", "im ", "zum ", "am\xa0", "im\xa0", "zum\xa0"),
    ("rue", "avenue", "av.", "boulevard", "bd", "chemin", "place", "impasse", "allée", "quai"), ("c/", "calle", "avda", "avenida", "plaza", "paseo"), ("ул.", "улица", "пер.", "переулок", "просп", "наб.", "бульвар"), ("市", "区", "町", "村", "郡"), ("号",),
)
_DOT = r"\s?[\[(](?:dot|DOT|Dot)[\])]\s?|\s(?:dot|DOT|Dot)\s"
_UNSEEN = "\u200b-\u200d\u2060\ufeff\xad"
_DOMAIN = re.compile(rf"[{_UNSEEN}]*[A-Za-z0-9-]+(?:(?:\.[{_UNSEEN}]*|{_DOT})[A-Za-z0-9-]+)+")
_SIGN = re.compile(r"\s?[@＠]\s?")
_WRITTEN_SIGN = re.compile(r"\s?[\[(]\s?at\s?[\])]\s?|\s+at\s+", re.I)
_CJK = re.compile("[぀-ヿ㐀-鿿]")
# The part before the sign, read backwards from it.
_LOCAL_BACK = re.compile(rf"(?:[A-Za-z0-9_%+\-.{_UNSEEN}]|\s(?:tod|TOD|toD)\s|\s?[\])](?:tod|TOD|toD)[\[(]\s?)*")
_DIGITS = re.compile(r"\d+")
# Where six digits or more stand together; nothing shorter is a phone or identity number. Dates are stepped over.
_CLUSTER = re.compile(r"\d(?:\d{3}-\d\d-\d\d(?!\d)|(?:[\s.\-‐‑–−－．/／()（）]{0,3}\d){5,}|\d[A-Za-z]\d{5})")
_DATE = re.compile(r"\d{4}-\d\d-\d\d")
_TAIL = re.compile(r"(?:['’\-‐‑][^\W\d_]+)*")
_IBAN_AT = re.compile(r"\d\d(?<=[A-Za-z]{2}..)(?<![A-Za-z0-9]....)(?= ?[A-Za-z0-9]{4})")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.I)


_lexicons: dict[int, tuple] = {}


def _automaton(names: Names | None):  # noqa: ANN202
    """One pass over a text in lower case finds all fixed words: cues of names, number words, known names and particles."""
    held = _lexicons.get(id(names))
    if held is None or held[0] is not names:
        import ahocorasick

        auto = ahocorasick.Automaton()
        if names is not None:
            for w in {*names.given, *names.family}:
                auto.add_word(w, ("word", len(w), None))
            for w in nm.PARTICLES:
                auto.add_word(w, ("particle", len(w), None))
        for w in NUMBER_WORDS.split():
            auto.add_word(w, ("digit", len(w), None))
        for w, v in nm.BEFORE.items():
            auto.add_word(w, ("before", len(w), (*v, w in nm.CLOSING)))
        for w, v in nm.AFTER.items():
            auto.add_word(w, ("after", len(w), v))
        auto.make_automaton()
        if len(_lexicons) > 8:
            _lexicons.clear()
        held = _lexicons[id(names)] = (names, auto)
    return held[1]


@lru_cache(maxsize=4)
def _families(words: frozenset):  # noqa: ANN202
    import ahocorasick

    auto = ahocorasick.Automaton()
    for w in words:
        auto.add_word(w, len(w))
    auto.make_automaton()
    return auto if words else None


def cues(text: str, names: Names | None) -> tuple[dict, dict, list[tuple[int, int]], str, list[tuple[int, int]]]:
    """Cues of names by where they end and by where they begin, number words, the text in lower case (letter by letter), known words."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    before: dict[int, tuple[float, bool, bool]] = {}
    after: dict[int, float] = {}
    digits, words, particles = [], {}, []
    for end, (kind, n, value) in _automaton(names).iter(low):
        a, b = end - n + 1, end + 1
        if kind == "before":
            if a == 0 or not low[a].isalnum() or not low[a - 1].isalnum():
                before[b] = max(before.get(b, value), value)
        elif kind == "after":
            after[a] = max(after.get(a, 0.0), value)
        elif (a == 0 or not low[a - 1].isalnum() or low[a - 1] >= "぀") and (b == len(low) or not low[b].isalnum() or low[b] >= "぀"):
            if kind == "digit":
                digits.append((a, b))
            elif kind == "particle":  # of interest only before what may be a name
                particles.append((a, b))
            elif text[a] == low[a]:  # in lower case: the whole token around it
                while a > 1 and low[a - 1] in "-'’" and low[a - 2].isalpha():
                    a -= 1
                    while a > 0 and low[a - 1].isalpha():
                        a -= 1
                m = _TAIL.match(low, b)
                words[a] = max(words.get(a, 0), m.end())
    near = set(words)
    for a, b in reversed(particles):
        behind = text[b : b + 3].lstrip()
        if behind[:1].isupper() or b + 1 in near or b + 2 in near:
            words[a] = max(words.get(a, 0), b)
            near.add(a)
    return before, after, digits, low, list(words.items())


def luhn(digits: str) -> bool:
    """Whether a digit string passes the Luhn check."""
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    """Whether an account number (country, check digits, rest) passes the mod-97 check."""
    moved = text[4:] + text[:4]
    return text.isalnum() and text.isascii() and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def valid(kind: str | None, text: str) -> bool | None:
    """Whether a span passes the check of its kind; None where there is no check."""
    bare = re.sub(r"[\s\-‐‑–.]", "", text)
    if kind == "luhn":
        digits = "".join(str(int(c)) for c in bare)
        return luhn(digits) if len(digits) >= 13 else None
    if kind == "iban":
        return 15 <= len(bare) <= 34 and mod97(bare.upper())
    if kind == "nir":
        return 97 - int(bare[:13]) % 97 == int(bare[13:])
    if kind == "dni":
        return "TRWAGMYFPDXBNJZSQVHLCKE"[int(bare[:8]) % 23] == bare[8].upper()  # fixed value of the public rule
    if kind == "han":
        return "10X98765432"[sum(int(c) * (2 ** (17 - n) % 11) for n, c in enumerate(bare[:17])) % 11] == bare[17].upper()
    return None


def _near(words: re.Pattern, text: str, start: int, end: int, back: int = 48, ahead: int = 24) -> int:
    """Distance of the nearest context word before the span, or after it; a large number if there is none."""
    best = 1000
    for m in words.finditer(text, max(0, start - back), start):
        best = start - m.end()
    if (m := words.search(text, end, end + ahead)) is not None:
        best = min(best, m.start() - end + 8)
    return best


def _numbers(text: str, spans: list[tuple[float, int, int, str]]) -> None:
    """Phones and identity numbers, from every run of digits that starts a number."""
    skip = 0
    for at in _IBAN_AT.finditer(text):  # the longest valid account number, or all of a labelled one
        m = _IBAN.match(text, at.start() - 2)
        if not m:
            continue
        words = [m.end(), *(m.start() + n for n in range(len(m[0]) - 1, 14, -1) if not m[0][n].isalnum() or not m[0][n - 1].isalnum())]
        end = next((e for e in words if valid("iban", text[m.start() : e].rstrip())), None)
        if end or re.search(r"iban[.:：]?\s{0,2}$", text[max(0, m.start() - 8) : m.start()], re.I):
            spans.append((0.9, m.start(), m.start() + len(text[m.start() : end or m.end()].rstrip()), "id"))
    taken = [(a, b) for _, a, b, kind in spans if kind == "id"]
    runs = (run for c in _CLUSTER.finditer(text) if not _DATE.fullmatch(c[0]) for run in _DIGITS.finditer(text, c.start(), c.end()))
    for run in runs:
        p = run.start()
        if p < skip or any(a <= p < b for a, b in taken):
            continue
        before = text[p - 1 : p]
        if before and (before in "./=#@:_" or (before in "-–－" and text[p - 2 : p - 1].isalnum())):
            if not (before == "=" and text[p - 6 : p].lower() == "phone=") and not (before in "./" and not text[p - 2 : p - 1].isalnum()):
                continue
        best: tuple[float, int, int, str] | None = None
        failed = 0
        starts = [p]
        for k in (1, 2, 3):  # letters that belong to an identity number
            if p >= k and text[p - k].isascii() and text[p - k].isalpha() and all(c.isascii() and (c.isalpha() or c == " ") for c in text[p - k : p]):
                if p == k or not (text[p - k - 1].isascii() and text[p - k - 1].isalnum()):
                    starts.append(p - k)
        glued = before.isascii() and before.isalpha()
        for at in starts:
            if at == p and glued:
                continue
            for pattern, base, check in _IDS:
                if (text[at].isdigit()) == pattern.pattern.startswith("[") or not (m := pattern.match(text, at)):
                    continue
                ok = valid(check, m[0])
                if ok is False and not _ID_LABEL.search(text, max(0, at - 40), at):
                    failed = max(failed, m.end())
                    continue
                score = base + (0.3 if ok else 0)
                d, e = _near(_ID_WORDS, text, at, m.end(), 90), _near(_PHONE_WORDS, text, at, m.end())
                score += (0.35 if d < 1000 and d <= e else 0) - (0.15 if e < d and base < 0.5 else 0)
                if score >= THRESHOLD and (best is None or (m.end() - at, score) > (best[2] - best[1], best[0])):
                    best = (score, at, m.end(), "id")
        if not glued:
            at = p
            if text[p - 1 : p] in ("+", "＋", "(", "（") and p:
                at = p - 1
            for q in dict.fromkeys((at, p)):
                hit = False
                for pattern, base, local in _PHONES:
                    m = pattern.match(text, q)
                    if not m or not 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                        continue
                    d, e = _near(_PHONE_WORDS, text, q, m.end()), _near(_ID_WORDS, text, q, m.end())
                    score = base + (0.35 if d < 1000 and d <= e else 0) - (0.15 if e < d and base < 0.5 else 0)
                    if local and d == 1000 and not m[0].startswith("555"):
                        score -= 0.3
                    if score >= THRESHOLD and (best is None or (m.end() - q, score) > (best[2] - best[1], best[0])):
                        best = (score, q, m.end(), "phone")
                        hit = True
                if hit:
                    break
        if best:
            spans.append(best)
            skip = best[2]
        else:
            skip = max(skip, failed)  # what is no number of its kind as a whole is none in part


def _emails(text: str, low: str, spans: list[tuple[float, int, int, str]]) -> None:
    back, signs, p = None, [], -1
    for c in "@＠":
        while (p := text.find(c, p + 1)) >= 0:
            signs.append(_SIGN.match(text, p - 1 if p and text[p - 1].isspace() else p))
    if "dot" in low or "(at" in low or "[at" in low or "( at" in low or "[ at" in low:
        signs += _WRITTEN_SIGN.finditer(text)
    for sign in signs:
        domain = _DOMAIN.match(text, sign.end())
        if not domain:
            continue
        end, found = domain.end(), domain[0]
        if sign[0].strip().lower() == "at" and not re.search(r"\bdot\b", found, re.I):
            continue
        tail = re.split(r"[.\s\])]", found)[-1]
        letters = re.match("[A-Za-z]*", tail)[0]  # the last label is letters; what is glued to it isn't part of it
        if len(letters) < 2:
            continue
        back = text[::-1] if back is None else back
        n = _LOCAL_BACK.match(back, len(text) - sign.start()).end()
        start = len(text) - n
        while start < sign.start() and not (text[start].isascii() and text[start].isalnum()):
            start += 1
        if start < sign.start():
            spans.append((0.9, start, end - len(tail) + len(letters), "email"))


def _addresses(text: str, low: str, spans: list[tuple[float, int, int, str]]) -> None:
    for pattern, words in zip(_ADDRESS, _STREET_WORDS):
        for word in words:
            if word in low:
                break
        else:
            continue
        for m in pattern.finditer(text):
            start, end = m.span()
            if pattern is _EN and (lead := _EN_LEAD.search(text[max(0, start - 24) : start])):
                start -= len(lead[0])
            if pattern is _DE:
                while start > 0 and text[start - 1].isalpha():
                    start -= 1
                if start == m.start() or text[start - 1 : start].isalnum():
                    continue
            if _NO_ADDRESS.match(text, start, end) or _DATE.search(text, start, end):
                continue
            score = 0.55 + (0.3 if _near(_ADDRESS_WORDS, text, start, end, 60) < 1000 else 0)
            if _SMALL_START.match(text, start):  # "im Bestand 5": inside a sentence only beside a word for addresses
                score -= 0.3
            spans.append((score, start, end, "address"))


def find_spans(text: str | None, names: Names = Names()) -> list[tuple[int, int, str, float]]:  # noqa: B008
    """(start, end, kind, score) of every span, in order and without overlaps. Null and blank texts have none."""
    if not text:
        return []
    before, after, digit_words, low, words = cues(text, names)
    spans: list[tuple[float, int, int, str]] = []
    _emails(text, low, spans)
    has_digit = _DIGITS.search(text) is not None
    if has_digit:
        _addresses(text, low, spans)
        _numbers(text, spans)
    run: list[tuple[int, int]] = []
    for a, b in [*digit_words, (len(text) + 9, len(text) + 9)]:
        if run and not (a - run[-1][1] <= 2 and not text[run[-1][1] : a].strip(" -\n")):
            if len(run) >= 6:
                spans.append((0.8, run[0][0], run[-1][1], "phone"))
            run = []
        run.append((a, b))
    t = nm.Tokens(text, names, words, [(a, b) for s, a, b, _ in spans if s >= THRESHOLD])
    spans += [(s, a, b, "name") for s, a, b in nm.spans(text, t, before, after, frozenset(a for _, a, _, k in spans if k == "address"))]
    if not text.isascii() and _CJK.search(text):
        auto = _families(names.han_family)
        hits: dict[int, int] = {}
        for end, n in auto.iter(text) if auto else ():
            hits[end - n + 1] = max(hits.get(end - n + 1, 0), end + 1)
        spans += [(s, a, b, "name") for s, a, b in nm.han_spans(text, names, sorted(hits.items()))]
    rank = {k: n for n, k in enumerate(KINDS)}
    out: list[tuple[int, int, str, float]] = []  # in order of position, without overlaps
    for score, a, b, kind in sorted((s for s in spans if s[0] >= THRESHOLD), key=lambda s: (rank[s[3]], s[1] - s[2], s[1])):
        i = bisect_left(out, (a,))
        if (i == 0 or out[i - 1][1] <= a) and (i == len(out) or out[i][0] >= b):
            out.insert(i, (a, b, kind, score))
    return out


def learn(docs: DataFrame, common: Names = Names(), sample: int | None = None) -> Names:  # noqa: B008
    """The names that a collection teaches (see ``names.learn``), to be given to ``found`` and ``redacted``."""
    return nm.learn(docs, cues, common, sample)


def redact(text: str | None, names: Names = Names()) -> str | None:  # noqa: B008
    """The text with each span replaced by its placeholder and all else unchanged; null stays null."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind, _ in find_spans(text, names):
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, text[at:]])


def found(docs: DataFrame, names: Names = Names()) -> DataFrame:  # noqa: B008
    """doc_id, kind, start_pos, end_pos, score: one row per span of every text, whole texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for doc, text in zip(ids, batch.column(1).to_pylist()):
                rows += [(doc, kind, a, b, score) for a, b, kind, score in find_spans(text, names)]
            cols = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["doc_id", "kind", "start_pos", "end_pos", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, kind string, start_pos int, end_pos int, score double")


def redacted(docs: DataFrame, names: Names = Names()) -> DataFrame:  # noqa: B008
    """doc_id and text with placeholders: one row per row of ``docs``; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([redact(t, names) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, text string")
