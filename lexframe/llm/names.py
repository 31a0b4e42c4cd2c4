"""Person names in free text: by their shape, by the words around them, and by what the collection teaches.

A name is one of a few forms (given and family name, initials and family name, family name first with
a comma, one of them alone). Words that are known as names, capitals, and cue words before and after
add up to a score. No list of the names of a collection is kept here: ``learn`` reads them off
the places where any text says that a name stands (forms of address, closings, labels, verbs of saying), and
counts how often the same words stand elsewhere. So a name met once beside a cue is found everywhere,
also in lower case, and a word that is mostly a plain word or a place is not.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexframe.session import stored

# Common given names, of public statistics of births; surnames common in Chinese and Japanese.
COMMON_GIVEN = (
    "james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark donald steven paul andrew joshua kenneth kevin brian george edward ronald timothy jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott brandon "
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty margaret sandra ashley kimberly emily donna michelle carol amanda melissa deborah stephanie rebecca sharon laura cynthia kathleen amy angela anna emma olivia "
    "hans peter klaus wolfgang jürgen günter stefan andreas otto karl heinz ursula monika petra sabine renate helga brigitte ingrid jean pierre michel philippe alain nathalie isabelle sylvie catherine françoise louis antoine camille "
    "antonio josé manuel francisco juan javier carlos miguel luis pedro carmen maría ana isabel dolores pilar teresa lucía giuseppe giovanni marco "
    "ivan dmitri sergei alexei vladimir olga tatiana natalia svetlana иван дмитрий сергей алексей владимир ольга татьяна наталья светлана мария анна елена "
    "hiroshi takashi kenji akira yuki haruka sakura wei ming mohammed ahmed ali fatima aisha omar priya raj"
)
COMMON_HAN = "王 李 张 張 刘 劉 陈 陳 杨 楊 赵 趙 黄 黃 周 吴 吳 徐 孙 孫 胡 朱 高 林 何 郭 马 馬 罗 羅 梁 宋 郑 鄭 谢 謝 韩 韓 唐 冯 馮 于 董 萧 程 曹 袁 邓 鄧 许 許 傅 沈 曾 彭 吕 蒋 蔡 魏 叶 杜 褚 欧阳 司马 上官 诸葛 佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 斎藤 清水 山崎"

# English words that are names too: beside another name or a cue only.
WORD_NAMES = frozenset(
    "amber april art august autumn bill bishop brook carol chase cherry christian clay cliff crystal daisy dale dawn dean drew earl faith fern ford frank gene ginger glen grace grant guy hazel heather holly hope iris ivy jack jasmine jay jean joy june lance laurel lily mark may melody miles "
    "misty nick olive opal pat patience pearl penny pierce piper poppy ray reed rich robin rod rose ruby rusty sandy sage sky stone sue summer sunny susan victor viola violet wade ward will winter "
    "baker bell berry black brown bush butler carpenter carter cook cooper cross day field fields fisher forest fox gold gray green hall hill hunter king knight lake lane little long marsh mason miller moon moore morning noble page park parker parsons pope porter potter price rice rivers rock sharp shepherd short singer small smith snow speaker stone strong sweet taylor tree walker wall waters weaver west white wise wolf wood woods wright young".split()
)

# Where a name stands: after these (how sure that is; whether one word is enough) and before those.
BEFORE = {
    **dict.fromkeys(("dear ", "mr ", "mr. ", "mrs ", "mrs. ", "ms ", "ms. ", "dr ", "dr. ", "prof. ", "professor ", "frau ", "herr ", "herrn ", "mme ", "mlle ", "madame ", "monsieur ", "sra. ", "sr. ", "señor ", "señora ", "doña ", "don "), (0.4, True)),
    **dict.fromkeys(("liebe ", "lieber ", "chère ", "cher ", "estimado ", "estimada ", "querido ", "querida ", "уважаемый ", "уважаемая ", "дорогой ", "дорогая "), (0.4, True)),
    **dict.fromkeys(("wishes, ", "regards, ", "yours, ", "sincerely, ", "faithfully, ", "grüßen ", "grüßen, ", "cordialement, ", "saludo, ", "saludos, ", "atentamente, ", "уважением, ", "wishes,\n", "regards,\n", "yours,\n", "grüßen\n", "cordialement,\n", "saludo,\n", "уважением,\n"), (0.4, True)),
    **dict.fromkeys(("name: ", "name ", "name is ", "named ", "heißt ", "s'appelle ", "se llama ", "зовут ", "from: ", "to: ", "signed: ", "author: ", "speaker: ", "speaker, ", "interviewer: ", "reviewer: ", "reader: ", "editor: ", "contact: ", "contributor: ", "reviewer|", 'name": "', 'author": "', 'contributor": "', "sheet: ", "im auftrag von ", "au nom de ", "en nombre de ", "от имени ", "владелец ", "владелица ", "氏名", "姓名", "署名"), (0.4, True)),
    **dict.fromkeys(("signed by ", "written by ", "read by ", "noticed by ", "sent by ", "told by ", "then by ", "according to ", "agree with ", "spoke to ", "spoke with ", "ask for ", "talk to ", "mother, ", "father, ", "sister, ", "brother, ", "unterschrieben von ", "geschrieben von ", "laut ", "firmado por ", "según ", "escrito por ", "signé par ", "selon ", "señaló ", "dijo ", "enseñó ", "указал ", "указала ", "сказал ", "сказала ", "написал ", "написала ", "слышал от ", "слышала от "), (0.4, True)),
}
# Words before a name that say little by themselves.
WEAK = frozenset("by to from for of with visited von an bei mit de à a con por от к у".split())
# After a closing the next sentence often begins without a full stop before it.
CLOSING = frozenset(w for w in BEFORE if re.match(r"(?:wishes|regards|yours|sincerely|faithfully|grüßen|cordialement|saludos?|atentamente|уважением)", w))
AFTER = {
    **dict.fromkeys((': "', ": «", ": „", ": “", " said ", " says ", " wrote ", " writes ", " told ", " asked ", " thinks ", " explained ", " replied ", " signed ", " will sign", " lives ", ", lives ", " lived ", ", thank you", ", never said", " recorded ", " and recorded ", " pointed out", ", passport", ", born ", " <", " sagte ", " sagt ", " schrieb ", " schreibt ", " wohnt ", " meint ", " hat die", ", qui ", " qui ", " a dit ", " dit ", " écrit ", " habite ", " dijo ", " dice ", " escribió ", " vive ", " en su carta", " сказал", " пишет", " написал", " живёт", " живет"), 0.4),
    **dict.fromkeys(("様", "さん", "氏", "先生", "女士", "小姐", "告诉", "指出", "写道", "说", "收", "から", "は言", "によ"), 0.4),
}
HAN_BEFORE = re.compile(r"(?:氏名|姓名|名前|担当|署名)[:：]?\s*$|(?:[ぁ-ヿ]|由|据|向|与|和|跟|给|请|是|、|，|。|:|：|\d|^|\n|」|”|》)$")
HAN_LABEL = re.compile(r"(?:氏名|姓名|名前|署名)[:：]?\s*$")
HAN_AFTER = re.compile(r"様|さん|氏(?!名)|先生|女士|小姐|告诉|指出|写道|收|から(?:聞|の)")
HAN_NONE = re.compile("[者员部家人们們生師师客省市县区路街号館]$|^(?:有人|大家|朋友|同学|同事|妈妈|爸爸|编辑|报告|研究|皆|各位|我们|他们|她们|此外|文章|评论|词条|本人|这|那)")
PARTICLES = frozenset("von van der den ter de del della di da du la dos af".split())
# Capitalized words that are no part of a name: pronouns, articles, prepositions, conjunctions, forms of address, days and months.
PLAIN = frozenset(
    "a an he she it they we you i who one nobody everyone everybody someone somebody no some any each every this that these those my your his her our their its if when while where what which whoever as at by for from in on of to until during between "
    "and or but so then there here since because although though before after near according sir madam editor editors reader readers colleague colleagues friend friends team all the dear dr mr mrs ms prof best kind yours wishes regards please thank thanks "
    "der die das den dem des ein eine einen einem im in am an auf bei mit nach von vor zu zur zum und oder aber wenn weil dass wer was wie wo er sie es wir ihr ich man niemand jemand frau herr herrn sehr freundlichen grüßen bitte als unter "
    "le la les un une des du de il elle ils elles on nous vous je qui que quoi dans sur sous avec pour par mais ou et si ce cette c personne mme mlle m chère cher madame monsieur celui près "
    "el los las una uno unos se su sus lo ella ellos ellas yo nadie alguien con sin por para pero o y si como cuando don doña sra sr estimado estimada señor señora "
    "в на и а но с со от к ко о об у из за по до для не он она они мы вы я это как что кто где когда никто тот та то те "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december "
    "cordialement saludo saludos atentamente sincerely faithfully quien quienes wer celui celle ceux кто тот whoever everybody someone "
    "montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz mai juni juli oktober dezember tel phone fax mail email".split()
) - WORD_NAMES

_L = r"[^\W\d_぀-ヿ㐀-鿿]"
_UP = "A-ZÀ-ÖØ-ÞΑ-ΩЀ-ЯŁŚŠŽČĆÐŞİĞĐ"
_CAP = re.compile(rf"[{_UP}](?<!{_L}.){_L}*(?:['’\-‐‑]{_L}+)*")
_LOW = re.compile("[a-zß-öø-ÿа-яё]{2,}")
_GAP = re.compile(r"[ \xa0\u2002-\u200a]{1,2}|[ \xa0]?\n")
_DOT_GAP = re.compile(r"\.[ \xa0\u2002-\u200a]{0,2}")
_COMMA_GAP = re.compile(r",[ \xa0]{0,2}")
_HYPHEN = re.compile(r"['’\-‐‑]")
_HAN = re.compile("[㐀-鿿]")
_HAN_TITLE = re.compile("(?:様|先生|女士|小姐)$")
_INITIALS = re.compile(rf"{_L}\.")
_ENDS = frozenset(".!?:;»”\"\n|…")


@dataclass(frozen=True)
class Names:
    """What is known of names: a parameter. Weights of words in lower case as given and family names; words that are plain; parts of Han names."""

    given: dict = field(default_factory=lambda: {w: 0.3 if w in WORD_NAMES else 0.4 for w in COMMON_GIVEN.split()})
    family: dict = field(default_factory=dict)
    plain: frozenset = frozenset()
    han_family: frozenset = frozenset(COMMON_HAN.split())
    han_given: frozenset = frozenset()


def _weight(known: dict, low: str) -> float:
    """The weight of a word (in lower case) in one role; of a compound that of its best part."""
    if low in known:
        return known[low]
    if low.isalpha():
        return 0.0
    return max((known.get(p, 0.0) for p in _HYPHEN.split(low) if len(p) > 1), default=0.0)


def _lead(text: str, a: int) -> tuple[int, int]:
    """Where the initials right before a stand."""
    start = a
    while True:
        b = start
        while b > 0 and text[b - 1] in " \xa0" and start - b < 2:
            b -= 1
        if b >= 2 and text[b - 1] == "." and text[b - 2].isalpha() and (b == 2 or not text[b - 3].isalnum()):
            start = b - 2
        else:
            return start, a


_judgements: dict[int, tuple[Names, dict]] = {}


def _judged(names: Names) -> dict:
    """What ``_judge`` said of words so far; forgotten now and then."""
    held = _judgements.get(id(names))
    if held is None or held[0] is not names or len(held[1]) > 100_000:
        if len(_judgements) > 8:
            _judgements.clear()
        held = _judgements[id(names)] = (names, {})
    return held[1]


def _judge(w: str, names: Names) -> tuple[str, float, float]:
    """The role that a word may have (I only before a full stop), its weights as a given and as a family name."""
    low = w.lower()
    g, f = _weight(names.given, low), _weight(names.family, low)
    if len(w) == 1:
        return "I", g, f
    if low in PARTICLES and (not w[0].isupper() or w.isupper()):
        return "P", g, f
    return "N" if g or f or w[0].isupper() and low not in PLAIN and low not in names.plain else "", g, f


class Tokens:
    """The words of a text that may be part of a name: those with a capital, known ones in any case, and particles between."""

    def __init__(self, text: str, names: Names, low_hits: list[tuple[int, int]], blocked: list[tuple[int, int]] = ()) -> None:
        self.text = text
        found = [(m.start(), m.end(), m[0]) for m in _CAP.finditer(text)]
        more = {}
        if low_hits:
            caps = {a for a, _, _ in found}
            more = {a: (a, b, text[a:b]) for a, b in low_hits if a not in caps}
        for a in [*(x[0] for x in found), *more]:  # initials in lower case before a known name
            dot = a - 1 if a > 1 and text[a - 1] == "." else a - 2 if a > 2 and text[a - 2] == "." and text[a - 1] in " \xa0" else 0
            if dot and text[dot - 1].isalpha() and (dot == 1 or not text[dot - 2].isalnum()):
                for m in _INITIALS.finditer(text, *_lead(text, a)):
                    more.setdefault(m.start(), (m.start(), m.start() + 1, m[0][0]))
        if more:
            found = sorted({**more, **{x[0]: x for x in found}}.values())
        if blocked:
            first, last = min(blocked)[0], max(y for _, y in blocked)
            found = [t for t in found if t[1] <= first or t[0] >= last or not any(x < t[1] and t[0] < y for x, y in blocked)]
        judged = _judged(names)
        self.all, self.roles, self.given, self.family = found, [], [], []
        for _, b, w in found:
            seen = judged.get(w)
            if seen is None:
                seen = judged[w] = _judge(w, names)
            role, g, f = seen
            self.roles.append(role if role != "I" or text[b : b + 1] == "." else "")
            self.given.append(g)
            self.family.append(f)

    def role(self, i: int) -> str:
        """I: an initial, P: a particle, N: a name or what has the shape of one, '': no part of a name."""
        return self.roles[i] if i < len(self.roles) else ""

    def next_to(self, i: int, gap: re.Pattern) -> bool:
        """Whether token i + 1 follows token i with nothing but such a gap between."""
        return i + 1 < len(self.all) and gap.fullmatch(self.text, self.all[i][1], self.all[i + 1][0]) is not None

    def initials(self, i: int) -> int:
        """The first token after the initials that begin at i."""
        while self.role(i) == "I" and self.next_to(i, _DOT_GAP):
            i += 1
        return i

    def particles(self, i: int) -> int:
        while self.role(i) == "P" and self.next_to(i, _GAP):
            i += 1
        return i

    def opens(self, i: int) -> bool:
        """Whether token i begins a sentence, a line or a quotation."""
        before = self.text[max(0, self.all[i][0] - 3) : self.all[i][0]].rstrip(" \xa0")
        return not before or before[-1] in _ENDS

    def readings(self, i: int) -> Iterator[tuple[str, int, int, list[tuple[int, str]]]]:
        """The names that may begin at token i: form, first and last token, and the tokens with their roles (g, f)."""
        first = self.role(i)
        if first == "I":
            j = self.particles(self.initials(i))
            if j > i and self.role(j) == "N":
                yield "initials", i, j, [(j, "f")]
            return
        k = self.particles(i)
        if self.role(k) != "N":
            return
        if self.next_to(k, _COMMA_GAP):
            if self.role(k + 1) == "I":
                j = k + 1
                while self.role(j + 1) == "I" and self.next_to(j, _DOT_GAP):
                    j += 1
                yield "turned", i, j, [(k, "f")]
            elif self.role(k + 1) == "N":
                last = k + 1
                if self.next_to(last, _GAP) and self.role(last + 1) == "I":
                    last += 1
                yield "turned", i, last, [(k, "f"), (k + 1, "g")]
        if k == i and self.next_to(k, _GAP):
            j = self.particles(self.initials(k + 1))
            if self.role(j) == "N":
                yield "full", i, j, [(k, "g"), (j, "f")]
        yield "one", i, k, [(k, "")]

    def weigh(self, form: str, parts: list[tuple[int, str]]) -> tuple[float, bool]:
        """The score of a reading without its surroundings, and whether every part is known."""
        ws, sure, upper = [], True, True
        if len({self.all[i][2][0].isupper() for i, _ in parts}) > 1:
            return -1.0, False
        for i, role in parts:
            g, f = self.given[i], self.family[i]
            own = max(g, f) if not role else g if role == "g" else f
            if role and not own:
                own = max(g, f) * 0.7  # the other role: family name first, or a name of both sorts
            cap = self.all[i][2][0].isupper()
            sure &= own > 0
            upper &= cap or own >= 0.5
            ws.append((own if own >= 0.4 or cap else own / 3) if own else (0.1 if cap else -1.0))
        if min(ws) < 0:
            return -1.0, False
        score = max(ws) + (0.25 if form != "one" and upper else 0)
        if form == "turned" and len(parts) > 1 and max(ws) < 0.5:
            score -= 0.3  # "Rose, Lily": a list, unless something says otherwise
        return score, sure


def _cue(t: Tokens, i: int, before: dict[int, tuple[float, bool, bool]]) -> tuple[float, bool, bool]:
    """The cue that ends where token i begins: how sure, whether one word is enough, whether it is a closing."""
    a = t.all[i][0]
    hit = before.get(a) or (before.get(a - 1) if t.text[a - 1 : a] in ('"', "„", "«", "“", " ", "'") else None)
    if hit:
        return hit
    start = max(0, a - 12)
    word = t.text[start:a].rstrip().rpartition(" ")[2].lower() if t.text[a - 1 : a] in (" ", "\n", "\xa0") else ""
    return (0.2, False, False) if word in WEAK or a and t.text[a - 1] == "\n" else (0.0, False, False)


def spans(text: str, t: Tokens, before: dict[int, tuple[float, bool, bool]], after: dict[int, float], streets: frozenset = frozenset()) -> list[tuple[float, int, int]]:
    """(score, start, end) of the names in alphabetic script. before: cues by where they end; after: cues by where they begin; streets: where addresses begin."""
    out, i, n = [], 0, len(t.all)
    while i < n:
        a, b, _ = t.all[i]
        if not t.roles[i] or not (t.given[i] or t.family[i] or a in before or b in after or i + 1 < n and t.all[i + 1][0] - b <= 3 or a - 1 in before):
            i += 1
            continue
        best, cue = None, None
        for form, first, last, parts in t.readings(i):
            score, sure = t.weigh(form, parts)
            if score < 0:
                continue
            if cue is None:
                cue = _cue(t, i, before)
            start, end = t.all[first][0], t.all[last][1]
            if t.role(last) == "I":
                end += 1
            behind = after.get(end, 0.0)
            if streets and any(text.startswith(gap, end) and end + len(gap) in streets for gap in (", ", " at ")):
                behind = max(behind, 0.4)
            head = parts[0][0]
            if t.role(first) == "P":  # a particle, or the preposition of the sentence
                if t.given[head] > t.family[head] or not (start in before or t.opens(first) or not text[start - 1].isspace() or text[start - 2 : start - 1] in ",;:|/" or _cue(t, i, before)[0] > 0):
                    continue
            told = (cue[0] if cue[1] or form != "one" else 0.0) + behind
            if form == "one":
                w = t.all[head][2]
                if not sure and (w.isupper() or t.opens(head) and not cue[1]):
                    score -= 0.2  # an abbreviation, or the first word of a sentence
            elif not sure:
                tail = parts[-1][0]
                if form == "full" and cue[2] and re.compile(r"[ \n][a-zß-öø-ÿа-яё]").match(text, end):
                    continue  # "Best wishes, Selias Cards from ...": the second word begins a sentence
                if told < 0.4 and t.given[head if form == "full" else tail] < 0.4:
                    score -= 0.2  # one part of the two is known, and not as a given name: the other may be a word of the sentence
                if last > head + 1 and form == "full" and not t.given[head] and cue[0] < 0.4 and any(t.role(x) == "P" for x in range(head + 1, last)):
                    continue  # "Mehrzahl von Dösbu"
            if t.all[head][2][0] < "\u0370" < "\u0400" <= t.all[parts[-1][0]][2][0]:
                continue  # two scripts
            score += told
            rank = (sure or form == "full" and t.given[head] >= 0.4, form != "one", end - start)  # a given name takes a family name that nobody knows
            if score >= 0.5 and (best is None or rank > best[0]):
                best = (rank, score, start, end, last)
        if best:
            _, score, start, end, last = best
            out.append((score, start, end))
            i = last + 1
        else:
            i += 1
    return out


def han_spans(text: str, names: Names, hits: list[tuple[int, int]]) -> list[tuple[float, int, int]]:
    """(score, start, end) of names in Han script. hits: places of known family names; a label or an honorific is enough for others."""
    out, done = [], 0
    for m in HAN_AFTER.finditer(text):  # whatever stands between a boundary and an honorific
        p = m.start()
        a = p
        while a > 0 and p - a < 9 and ("㐀" <= text[a - 1] <= "鿿" or text[a - 1] in "々 　\xa0"):
            a -= 1
        run = text[a:p].strip(" 　\xa0")
        a = p - len(text[a:p].lstrip(" 　\xa0"))
        if run[:1] and run[0] in "由据向与和跟给请是对":
            a, run = a + 1, run[1:]
        if 2 <= len(run.replace("　", "").replace(" ", "")) <= 5 and HAN_BEFORE.search(text[max(0, a - 6) : a]) and not HAN_NONE.search(run) and not _HAN_TITLE.search(run):
            out.append((0.52, a, p if text[p - 1] not in " 　\xa0" else p - 1))
    for m in re.finditer(r"(?:氏名|姓名|署名)[:：]?\s*([㐀-鿿々]{1,4}(?:[ 　\xa0][㐀-鿿々]{1,3})?)(?=[。，、,.;；\n]|$)", text):
        out.append((0.6, m.start(1), m.end(1)))
    for a, b in hits:
        if a < done:
            continue
        end = b
        gap = text[b : b + 1] in (" ", "　", "\xa0") and bool(text[b : b + 1])
        for n in (3, 2, 1):
            own = text[b + gap : b + gap + n]
            if len(own) == n and own in names.han_given:
                end = b + gap + n
                break
        known = end > b
        if not known:  # a given name that nobody has met, as far as the next boundary
            m = re.compile(r"[ 　\xa0]?[㐀-鿿々]{1,2}?(?=様|さん|氏(?!名)|先生|女士|小姐|告诉|指出|写道|收|から聞|[。，、]|$)").match(text, b)
            if m and (HAN_LABEL.search(text[max(0, a - 6) : a]) or HAN_AFTER.match(text, m.end())):
                end = m.end()
        cue = (HAN_BEFORE.search(text[max(0, a - 6) : a]) is not None) + (HAN_AFTER.match(text, end) is not None) + (HAN_LABEL.search(text[max(0, a - 6) : a]) is not None)
        score = (0.3 if end - a > 1 else 0.1) + (0.1 if known else 0) + 0.15 * min(cue, 3) + (0.15 if HAN_AFTER.match(text, end) or HAN_LABEL.search(text[max(0, a - 6) : a]) else 0)
        if score >= 0.5:
            out.append((score, a, end))
            done = end
    return out


# ---------------------------------------------------------------- learning


_SHAPE = Names(given={}, han_family=frozenset())
_CLOSED = re.compile(r"[ \n][a-zß-öø-ÿа-яё]")


def places(texts: list[str]) -> Counter:
    """How often words stand with a capital (c) and in lower case (l) in texts that have capitals: (sort, word) with a count.

    No word goes across a space, so what stands between spaces is counted first and each such piece is read once.
    """
    pieces: Counter = Counter()
    for text in texts:
        if not text.islower():
            pieces.update(text.split())
    out: Counter = Counter()
    for piece, n in pieces.items():
        for w in _LOW.findall(piece):
            out["l", w] += n
        if piece.islower():
            continue
        for w in _CAP.findall(piece):
            low = w.lower()
            if len(w) > 1 and w[0].isupper() and low not in PLAIN and not (low in PARTICLES and w.isupper()):
                for x in _HYPHEN.split(low):
                    if len(x) > 1:
                        out["c", x] += n
    return out


def _told(text: str, before: dict, after: dict) -> bool:
    """Whether a capital may stand beside a cue."""
    for p in before:
        if text[p : p + 1].isupper() or text[p + 1 : p + 2].isupper():
            return True
    for p in after:
        piece = text[max(0, p - 40) : p].split()
        if piece and (len(piece[-1]) == 40 or not piece[-1].islower()):
            return True
    return False


def evidence(text: str, cues) -> Counter:  # noqa: ANN001
    """What the cues of one text say of names: (sort, word) with a count.

    Sorts: g, f: a given or family name of a full name beside a cue; 1: one name alone after a cue;
    h: a Han name between boundaries; s: family and given name of one, with the space between.
    """
    out: Counter = Counter()
    before, after, _, low, _ = cues(text, None)
    if text != low and _told(text, before, after):
        t = Tokens(text, _SHAPE, [])
        n = len(t.all)
        for i, (a, _, w) in enumerate(t.all):
            if t.roles[i] != "N" or not (a in before or a - 1 in before or i + 1 < n and t.all[i + 1][1] in after):
                continue
            cue = _cue(t, i, before)
            for form, _, last, parts in t.readings(i):
                end = t.all[last][1]
                closing = cue[2] and form == "full" and _CLOSED.match(text, end)
                if closing or form == "turned" or not (cue[0] >= 0.4 or form == "full" and not t.opens(i) and last == i + 1 and after.get(end, 0) >= 0.4):
                    continue
                if form == "one":
                    if cue[1]:
                        out["1", w.lower()] += 1
                    continue
                if form == "full":
                    out["g", w.lower()] += 1
                for x in _HYPHEN.split(t.all[parts[-1][0]][2].lower()):
                    out["f", x] += len(x) > 1
                break
    if not text.isascii() and _HAN.search(text):
        for _, a, b in han_spans(text, _SHAPE, []):
            run = text[a:b]
            out["h", re.sub("[ 　\xa0]", "", run)] += 1
            parts = re.split("[ 　\xa0]", run)
            if len(parts) == 2:
                out["s", "|".join(parts)] += 1
    return out


def learn(docs: DataFrame, cues, common: Names = Names(), sample: int | None = None) -> Names:  # noqa: ANN001, B008
    """The names that a collection teaches, added to ``common``, for use on its documents: every one of them is read and every count kept.

    Counts are added up, weighed and compared where they are; the driver gets the names alone. Plain words are those that
    the collection has with a capital too, as nothing asks for others. Without documents it is ``common``.
    sample: fitted on about so many documents only, drawn by a hash of their text. No query asks for that.
    """
    own = docs.select("text").where(F.col("text").isNotNull() & (F.col("text") != ""))
    if sample is not None and (n := docs.count()) > sample:
        own = own.where(F.pmod(F.xxhash64("text"), F.lit(-(-n // sample))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            total = places(texts)
            for text in texts:
                total.update(evidence(text, cues))
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(total.values()), pa.int64())], names=["sort", "word", "n"])

    by = own.mapInArrow(run, "sort string, word string, n bigint").groupBy("word").agg(*[F.sum(F.when(F.col("sort") == s, F.col("n")).otherwise(0)).alias(f"n_{s}") for s in "gf1clhs"])
    by = stored(by)
    known, spaced = weighed(by).collect(), by.where("n_s > 0").select("word").collect()
    return taught(known, spaced, parted(by.where("n_h > 0")).collect(), common)


def weighed(by: DataFrame) -> DataFrame:
    """word, given, family, plain of the words that are one of these: weights from counts.

    A word that stands beside cues in a good part of its places is a name, in a small part one that may also be something else.
    """
    told = F.col("n_g") + F.col("n_f") + F.col("n_1")
    share, plainly = told / F.greatest("n_c", told), F.col("n_l") / (F.col("n_l") + F.col("n_c") + told)
    weight = F.when(F.col("word").isin(*WORD_NAMES), 0.3).when((share >= 0.15) & (plainly <= 0.2) & (told >= 3), 0.6).when(share >= 0.02, 0.3).otherwise(0.0)
    weight = F.when((told >= 2) & ~F.col("word").isin(*PARTICLES, *(PLAIN - WORD_NAMES)), weight).otherwise(0.0)
    g, f = F.col("n_g"), F.col("n_f")
    return by.select(
        "word",
        F.when(((g > 0) | (f == 0)) & (g * 4 >= f), weight).otherwise(0.0).alias("given"),
        F.when(((f > 0) | (g == 0)) & (f * 4 >= g), weight).otherwise(0.0).alias("family"),
        ((F.col("n_l") >= 2) & (F.col("n_l") > 4 * told) & (F.col("n_c") > 0)).alias("plain"),
    ).where("given > 0 OR family > 0 OR plain")


def parted(whole: DataFrame) -> DataFrame:
    """first, n, good, next: what may be the family names of Han names, how many rests follow each, which of these follow others too, and how they begin."""
    parts = whole.select("word", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).where("length(word) - k BETWEEN 1 AND 3")
    parts = parts.selectExpr("substring(word, 1, k) AS first", "substring(word, k + 1) AS rest")
    parts = parts.withColumn("often", F.count(F.lit(1)).over(Window.partitionBy("rest")) >= 2)
    return parts.groupBy("first").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("often"), F.col("rest"))).alias("good"), F.collect_set(F.substring("rest", 1, 1)).alias("next")
    ).where("n >= 3")


def taught(known: list, spaced: list, parts: list, common: Names) -> Names:
    """The rows of ``weighed``, Han names written with a space, and the rows of ``parted``, added to ``common``."""
    given, family = dict(common.given), dict(common.family)
    for r in known:
        for words, weight in ((given, r["given"]), (family, r["family"])):
            if weight:
                words[r["word"]] = max(words.get(r["word"], 0), weight)
    heads, tails = set(common.han_family), set(common.han_given)
    for r in spaced:
        f, _, g = r["word"].partition("|")
        heads.add(f)
        tails.add(g)
    size = {r["first"]: r["n"] for r in parts}
    for r in parts:
        if len(r["good"]) >= 3 and not any(size.get(r["first"] + c, 0) >= r["n"] for c in r["next"]):
            heads.add(r["first"])
            tails |= set(r["good"])
    plain = {r["word"] for r in known if r["plain"]}
    return Names(given, family, frozenset(plain - set(given) - set(family)), frozenset(heads), frozenset(tails))
