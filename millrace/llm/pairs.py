"""Defective question and answer pairs (problem 1).

Method, by defect:

* ``copies_query``: the answer's words walk through a suffix automaton of the query; the words that lie
  in copied runs are the copied coverage. Nothing but the question: nearly all words are covered.
* ``refusal``: an automaton of word stems with roles runs over each sentence; roles that meet (somebody who speaks, a
  negation, an act of answering or knowing; the matter and what lies outside; sources and what they fail to say) make it one
  that declines, others a courtesy or a referral. An answer that declines in one sentence at least and says nothing else
  in any is a refusal, unless ``has_sufficient_context`` is false.
* ``truncated``: a delimiter stack finds brackets and quotations left open; an end without closing
  punctuation is whole only for short values, source lines, and list items. The last item of a list
  without full stops, and a number before the last full stop, are compared with how sentences of the whole table end:
  word runs at ends and in mid-sentence are counted over all rows into 64-bit hashes, and the answers that
  ask for them meet the counts in an equi-join; nothing is broadcast.
* ``other_language``: stopwords and letters vote for a language in each sentence; the answer's language
  is that of most characters.
* ``empty``: nothing remains after invisible characters and marks go, or only a placeholder.

An answer has one defect at most; the order is empty, refusal, copies_query, other_language, truncated.

Defined cases: a null answer is empty; a null or blank query has no words to copy and no language, so
only the other defects can be found; rows repeated under one id count once; a null id is left out;
``has_sufficient_context`` null counts as true. The work is per row except for the counts, the join of the few
answers that ask for them, and one aggregation by id after the rows are cut to those found.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.runtime import checkpoint, spread

#: Occurrences from which a word run tells something, and pieces of the answers that ask for one run.
LEAST = 4
PIECES = 16
#: Longest word run whose ends are counted.
END_WORDS = 4
COPIED = 0.8
#: Share of sentence ends among a run's occurrences from which a text may end with it.
WELL = 0.15

# Placeholders that stand for no answer.
PLACEHOLDERS = {"", "na", "n a", "none", "null", "nil", "nan", "empty", "no answer", "no response", "blank", "tbd", "tba", "todo", "unknown", "undefined", "not available", "missing", "void", "xxx", "test", "sans objet", "aucune réponse", "néant", "vide", "sin respuesta", "ninguna", "vacío", "keine antwort", "keine angabe", "leer", "k a", "لا يوجد", "لا جواب", "فارغ", "no data", "no output", "placeholder", "answer", "answer here", "lorem ipsum", "s o", "pending", "error"}

# Word beginnings by which a sentence shows who speaks, a negation, an act of answering or knowing, what
# lies outside, the speaker's own field, a refusal in one word, sources, and what sources fail to do. A stem that ends
# in a space is a whole word.
FRAMES = {
    "en": {
        "sorry": " i m sorry | i am sorry | sorry but ", "who": " i | we | me | my | us | our | assistant ",
        "no": " not | no | never | cannot | t | unable | nothing | neither | impossible | nor | keep me from | keeps me from | prevent| forbid| bar me ",
        "say": " answer| help| say| tell | comment| provid| give | giving | advis| advice | know | assist| judge | share | respond| repl| discuss| guess| speak| offer| information | opinion| guidance | comply | find any| find the answer| find what| found any| anything useful ",
        "out": " outside | beyond | exceed| out of scope | not within ", "own": " i | my | our | me ",
        "refuse": " declin| refus| must pass | have to pass | refrain| abstain",
        "source": " source| passage| document| material| text| extract| excerpt| context ",
        "lack": " say| allow| let | enough | suffic| support| permit| cover| contain| mention| answer| address| tell ",
        "refer": " please | kindly | contact | ask | asking | turn to | check with | speak to | talk to | consult ", "to": " manager | inspector| specialist| professional| expert| authorit| supervisor| person | team | officer | office | doctor | adviser | advisor | staff | colleague",
    },
    "fr": {
        "sorry": " désolé| je regrette ", "who": " je | j | nous | m | me | moi | mon | ma | mes | notre ",
        "no": " pas | rien | aucun| impossible | jamais | ni | incapable | point | empêch| interdi",
        "say": " répon| dire | aider | renseign| conseil| avis | prononc| sais | savoir | donner | fourni| trouvé d| rien trouv| inform| parler | orient| éclair",
        "out": " dépass| hors d| en dehors | au delà | excède ", "own": " mon | ma | mes | notre | nos | moi | me ",
        "refuse": " décline| décliner | abstien| abstenir | refuse ",
        "source": " extrait| document| source| texte| passage| élément",
        "lack": " permet| suffi| disent | dit | contien| mention| parle| indiqu| répond",
        "refer": " veuillez | merci de | adressez| consultez | demandez | demander | contactez | voyez avec ", "to": " spécialiste| personne | responsable| expert| inspect| autorité| service | professionnel| médecin | équipe | collègue",
    },
    "es": {
        "sorry": " lo siento ", "who": " me | mi | mis | yo | puedo | podemos | podría | sé | tengo | dispongo | encontré | encontrado | estoy | prefiero | conozco | logro ",
        "no": " no | nada | ning| sin | imposible | incapaz | tampoco | nunca | impide| impiden | prohíb",
        "say": " respond| decir| ayudar| orient| opin| informa| aconsej| consej| saber | sé | útil | contest| asesor| coment| hablar | respuesta",
        "out": " fuera de | más allá | excede | ajeno | ajena | rebasa ", "own": " mi | mis | me | nuestr",
        "refuse": " declin| absten| rehús| rehus",
        "source": " texto| documento| fuente| extracto| pasaje| material",
        "lack": " permit| basta| dice| contien| mencion| indic| suficien| respond| aclar",
        "refer": " consulte | pregunte | por favor | diríjase | acuda | contacte | hable con ", "to": " especialista| persona | responsable| experto | inspector| autoridad| servicio | profesional| médico | equipo | colega",
    },
    "de": {
        "sorry": " tut mir leid ", "who": " ich | mir | mich | mein| wir | uns | unser",
        "no": " nicht | kein| nichts | nie | unmöglich | außerstande | weder | hinder| untersag| verbiet",
        "say": " sagen | beantwort| antwort| auskunft | äußer| helf| weiterhelf| wissen | weiß | rat | raten | berat| brauchbares | informat| stellung | angaben | beurteil| mitteil| empfehl| dazu vor | hierzu nichts vor | liegt mir ",
        "out": " außerhalb | übersteig| jenseits ", "own": " mein| unser| mir ",
        "refuse": " ablehn| lehne | passen | enthalte mich ",
        "source": " auszüg| quelle| text| dokument| unterlage| material",
        "lack": " reich| sagen | enthalt| genüg| erwähn| erlaub| ausreich| beantwort| hergeb| geben ",
        "refer": " bitte | fragen | wenden | kontaktieren | sprechen ", "to": " fachkraft | person | verantwortlich| leitung | behörde| experte| fachmann | fachleute | amt | arzt | team | kolleg| stelle ",
    },
    "ar": {
        "sorry": " آسف | أعتذر ", "who": " لي | لدي | أستطيع | يمكنني | أجد | أملك | أعرف | أعلم | يسعني | علي | عندي | أقدر | بوسعي | أنا | أفضل ",
        "no": " لا | لم | لن | ليس| لست | غير | يتعذر | تعذر | عدم | أعجز | يستحيل | تمنع| يمنع",
        "say": " الإجاب| إجاب| قول | إفاد| معلوم| الرأي | رأي | مساعد| الرد | أجيب | مفيد| أقول | جواب | الجواب | نصيح| التعليق | إبداء ",
        "out": " خارج | يتجاوز | تتجاوز ", "own": " مهمتي | نطاقي | اختصاصي | صلاحيا| عملي | دوري | مجالي ",
        "refuse": " أعتذر عن | أمتنع | أرفض ",
        "source": " النصوص | المصادر | الوثائق | المقتطف| المستند| المراجع ",
        "lack": " تسمح | تكفي | تذكر | تقول | تتضمن | تحتوي | كافي| تجيب ",
        "refer": " يرجى | اسأل | راجع | استشر | تواصل | سؤال | الرجوع ", "to": " مختص| شخص | مدير | خبير | مفتش| السلطة | الجهة | المسؤول | طبيب | الفريق | مدرب ",
    },
}

# Greetings, thanks, apologies and other words that say nothing on the matter.
COURTESIES = """
good question|thank you|thanks for|hello|hi there|good morning|apologies|sorry|unfortunately|regrettably|rephrase|try later|try again|try asking|to be honest|happy to help
bonjour|merci|malheureusement|à vrai dire|désolée|bonne question|reformul|essayez plus tard|réessayez
gracias|disculpe|lamentablemente|hola|buena pregunta|reformul|inténtelo|intente|la verdad|por desgracia
danke|verzeihung|leider|ehrlich gesagt|versuchen sie|gute frage|guten tag|entschuldigung
شكرا|عذرا|المعذرة|للأسف|في الحقيقة|حاول|مرحبا|سؤال جيد
"""  # fmt: skip

# Frequent function words by language.
STOPWORDS = {
    "en": "the of and to in is was were with for on at by from that this it be are an as or not no than had has have which who what when where how why we our must should may can do does before after if there their people into its been any only while because since but although until above below within each",
    "fr": "le les des du un une et est dans pour que qui sur par au aux avec ne pas plus sont été a ont ce cette ces il elle on ou où se sa son ses leur l d qu n s avant après pendant peut faut comme si sans entre vers aussi doit rien quand quelle quel combien de la en faire trouve avez vous nous peu cette dès chez leurs toutes tous depuis montre doivent",
    "es": "el los las del un una y en es que por para con no se su sus al lo más como fue fueron ha han o si sin sobre entre hasta desde cuando antes después durante debe puede nadie había esta este hay qué cómo cuánto quién cuál de la porque aunque varios cada ni",
    "de": "der die das den dem des ein eine einen einem einer und ist im in zu mit von auf für nicht sich auch es an werden wird wurde wurden sind war hat haben bei nach aus am zum zur vor über unter darf muss soll kann wenn dass ob wer was wie warum welche niemand als so oder nur bis ohne um keine jede",
    "ar": "من في على إلى عن مع هذا هذه ذلك التي الذي أن إن كان كل قبل بعد لا ما أو ثم إذا عند حتى بين غير كم كيف ماذا لماذا هل متى يجب دون فوق تحت",
}
_LETTERS = {"es": "ñ¿¡", "de": "ßäöü", "fr": "èêçœùûîïëâà"}

#: Characters between a negation and what it negates.
NEAR = 60
STEP, _APART, _MASK = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, (1 << 64) - 1
_BESIDE = ".,;:!?؟،()[]«»\"'"
_MARKS = re.compile(r"[^\w]+")
_WORDY, _ARABIC, _SPECIAL = re.compile(r"[^\W_]"), re.compile("[\u0600-ۿ]"), re.compile(f"[{''.join(_LETTERS.values())}]")
_SENTENCE = re.compile(r"(?<=[.!?؟])\s+|\n+|(?<=[:;])\s+")
_ITEM = re.compile(r"\s*(?:[-*•–·]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+")
_SOURCE = re.compile(r"(?:\n|^|(?<=[.!?؟»\"\]])\s)\s*\(?(?:source|sources|quelle|quellen|fuente|fuentes|المصدر|المصادر|ref|référence|reference|referencia|see|siehe|voir|véase)\b\s*[:：.][^\n]{0,80}\Z", re.I)
_CITED = re.compile(r"(?:\s*[\[(]\s*\d+(?:\s*[,;–-]\s*\d+)*\s*[\])])+\s*\Z")
_OPEN, _CLOSE = "([{«„“", ")]}»“”"
_PAIR = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“"}
_UNIT = re.compile(r"[\W_]*(?:[<>≤≥~±]?\s*[-+]?\d[\d.,/:–-]*\s*)(?:[^\W\d]{0,12}|°\s?[CFK]|%|‰)?(?:\s?[/²³][^\W\d]{0,4})?[.!]?\s*\Z|[A-Z]{1,3}[/-]?\d[\d/-]*\Z")


def bare(text: str) -> str:
    """Words only: lower case, every other character a space."""
    plain = text if text.isascii() else unicodedata.normalize("NFKC", text)
    return _MARKS.sub(" ", plain.lower()).replace("_", " ").strip()


@functools.cache
def _automaton():
    """Aho-Corasick automaton of all stems and courtesies, with their languages and roles."""
    import ahocorasick

    roles: dict[str, list[tuple[str, str]]] = {}
    for lang, frame in FRAMES.items():
        for role, stems in frame.items():
            for stem in stems.split("|"):
                roles.setdefault(stem, []).append((lang, role))
    for phrase in COURTESIES.replace("\n", "|").split("|"):
        if phrase.strip():
            roles.setdefault(f" {phrase.strip()}", []).append(("", "polite"))
    a = ahocorasick.Automaton()
    for stem, found in roles.items():
        a.add_word(stem, (len(stem), found))
    a.make_automaton()
    return a


@functools.cache
def _votes() -> dict[str, dict[str, float]]:
    """Word to its vote by language; a word of several languages counts less for each."""
    of: dict[str, list[str]] = {}
    for lang, ws in STOPWORDS.items():
        for w in set(ws.split()):
            of.setdefault(w, []).append(lang)
    return {w: {x: 1 / len(ls) ** 2 for x in ls} for w, ls in of.items()}


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    if _WORDY.search(answer):  # something is said, if it is no placeholder among marks
        return (len(answer) < 100 or len(_MARKS.sub("", answer)) < 100) and bare(answer) in PLACEHOLDERS
    visible = "".join(c for c in answer if unicodedata.category(c)[0] not in "CZ")
    return bare(visible) == "" and not any(unicodedata.category(c)[0] in "LN" for c in visible) or bare(answer) in PLACEHOLDERS


def _speech(sentence: str) -> str | None:
    """``declines`` or ``polite`` if a sentence (words only, a space at both ends) does nothing else.

    It declines if one who speaks negates an act of answering or knowing, puts the matter outside the own field or
    refuses in one word, or if sources fail to say; it is polite if it holds a courtesy or refers to somebody.
    """
    at: dict[tuple[str, str], list[int]] = {}
    for end, (n, roles) in _automaton().iter(sentence):
        for role in roles:
            at.setdefault(role, []).append(end - n + 1)
    if not at:
        return None
    near = lambda x, ys: any(abs(x - y) <= NEAR for y in ys)
    for lang in FRAMES:
        who, no, say, out, own, refuse, source, lack, sorry = (at.get((lang, r), ()) for r in ("who", "no", "say", "out", "own", "refuse", "source", "lack", "sorry"))
        if sorry or out and own or who and refuse:
            return "declines"
        if who and any(near(x, say) and near(x, who) for x in no) or source and any(near(x, lack) for x in no):
            return "declines"
    if ("", "polite") in at or any((lang, "refer") in at and (lang, "to") in at for lang in FRAMES) and not any(map(str.isdigit, sentence)):
        return "polite"
    return None


def is_refusal(answer: str) -> bool:
    declined = False
    for sentence in re.split(r"(?<=[.!?؟])\s+|\n+", answer.strip()):
        words = bare(sentence)
        if not words:
            continue
        kind = _speech(f" {words} ")
        if kind is None:
            return False
        declined |= kind == "declines"
    return declined


class SuffixAutomaton:
    """Suffix automaton of a word sequence."""

    def __init__(self, tokens: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for t in tokens:
            cur = self._state(self.length[last] + 1, {}, 0)
            p = last
            while p >= 0 and t not in self.next[p]:
                self.next[p][t] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][t]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
                    while p >= 0 and self.next[p].get(t) == q:
                        self.next[p][t] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def _state(self, length: int, step: dict, link: int) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def covered(self, tokens: list[str], least: int = 2) -> int:
        """Words of ``tokens`` inside runs of at least ``least`` words that stand in the sequence too."""
        state = length = total = 0
        until = -1  # words before this position are counted
        for i, t in enumerate(tokens):
            while state and t not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if t in self.next[state]:
                state = self.next[state][t]
                length += 1
            if length >= least:
                start = max(until, i - length + 1)
                total += i + 1 - start
                until = i + 1
        return total


@functools.lru_cache(maxsize=4096)
def _prompt(query: str) -> tuple[SuffixAutomaton, int]:
    tokens = bare(query).split()
    return SuffixAutomaton(tokens), len(tokens)


# Words that only announce the question.
_ANNOUNCE = re.compile(r"^[\s\"'«»„“”>*\-#]*(?:(?:you asked|your question(?: was)?|the question(?: is| was)?|question|q|query|vous avez demandé|votre question|usted preguntó|preguntó|su pregunta|pregunta|sie fragten|sie haben gefragt|ihre frage|frage|سألت|سؤالك|السؤال|سؤال)\s*[:：\-–]\s*)+", re.I)


def copies(answer: str, query: str | None) -> bool:
    if not query:
        return False
    automaton, n = _prompt(query)
    tokens = bare(_ANNOUNCE.sub("", answer)).split()
    if n < 2 or not tokens:
        return False
    return len(tokens) >= min(3, n) and automaton.covered(tokens) >= COPIED * len(tokens)


def language(text: str) -> dict[str, float]:
    """Votes by language."""
    got: dict[str, float] = {}
    marks: dict[str, int] = {}
    votes = _votes()
    plain = text.isascii()
    arabic = 0 if plain else len(_ARABIC.findall(text))
    if arabic and arabic * 2 > sum(map(str.isalpha, text)):
        return {"ar": float(arabic)}
    for w in bare(text).split():
        for lang, v in votes.get(w, {}).items():
            got[lang] = got.get(lang, 0) + v
    for letter in () if plain else _SPECIAL.findall(text.lower()):
        marks[letter] = marks.get(letter, 0) + 1
    for lang, letters in _LETTERS.items():
        if n := sum(marks.get(c, 0) for c in letters) if marks else 0:
            got[lang] = got.get(lang, 0) + min(2.0, 0.4 * n)
    return got


def languages(text: str) -> dict[str, float]:
    """Characters by language, each sentence counted for the language of most votes; undecided sentences count for none."""
    by: dict[str, float] = {}
    for sentence in _SENTENCE.split(text):
        got = sorted(language(sentence).items(), key=lambda x: -x[1])
        if got and (len(got) == 1 or got[0][1] > got[1][1]):
            by[got[0][0]] = by.get(got[0][0], 0) + len(sentence)
    return by


@functools.lru_cache(maxsize=4096)
def _asked_in(query: str) -> str | None:
    by = languages(query)
    return max(by, key=by.get) if by else None


def other_language(answer: str, query: str | None) -> bool:
    asked = query and _asked_in(query)
    if not asked:
        return False
    by = languages(answer)
    said = max(by, key=by.get) if by else None
    return said is not None and said != asked and by[said] > by.get(asked, 0)


def _shape(word: str) -> str:
    """A word as the end statistics see it: digits as 0, codes and capitalised words as their pattern."""
    w = re.sub(r"\d+", "0", word)
    if any(c.isdigit() for c in word):
        return re.sub(r"[^\W\d_]+", "A", w)
    return w


def _sentences(text: str) -> list[list[str]]:
    return [s.split() for s in re.split(r"(?<=[.!?؟])\s+|\n+", text)]


_hashes: dict[str, int] = {}


def _hash(word: str) -> int:
    """64 bits of a word's shape."""
    h = _hashes.get(word)
    if h is None:
        if len(_hashes) > 500_000:
            _hashes.clear()
        h = _hashes[word] = xxhash.xxh3_64_intdigest(_shape(word.strip(_BESIDE)))
    return h


def _runs(hashes: list[int]) -> list[int]:
    """Hashes of the word runs that end at the last of these words, longest first."""
    out, acc = [], 0
    for n, h in enumerate(reversed(hashes[-END_WORDS:])):
        acc = (acc + h * pow(STEP, n, 1 << 64)) & _MASK
        run = (acc + n * _APART) & _MASK
        out.append(run - (1 << 64) if run >> 63 else run)
    return out[::-1]


def end_counts(answers: Iterator[str], piece: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Word runs (hashed) of closed sentences, and how often each ends a sentence and stands within one; in pieces of some words."""
    codes: list[int] = []
    sizes: list[int] = []

    def counted() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, n = np.array(codes, np.uint64), np.array(sizes)
        last = np.zeros(len(w), bool)
        last[np.cumsum(n) - 1] = True
        place = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
        acc, runs, ends = np.zeros(len(w), np.uint64), [], []
        for k in range(END_WORDS):
            shifted = np.concatenate((np.zeros(k, np.uint64), w[: len(w) - k]))
            acc = acc + shifted * np.uint64(pow(STEP, k, 1 << 64))
            runs.append((acc + np.uint64(k * _APART & _MASK))[place >= k])
            ends.append(last[place >= k])
        keys, inverse = np.unique(np.concatenate(runs).view(np.int64), return_inverse=True)
        end = np.bincount(inverse, np.concatenate(ends), len(keys)).astype(np.int64)
        return keys, end, np.bincount(inverse, minlength=len(keys)) - end

    for text in answers:
        for ws in _sentences(text):
            if len(ws) >= 4 and ws[-1][-1] in ".!?؟":
                codes += map(_hash, ws)
                sizes.append(len(ws))
        if len(codes) > piece:
            yield counted()
            codes.clear(), sizes.clear()
    if codes:
        yield counted()


class Question(NamedTuple):
    """What the counts of word runs must tell about an answer's end: ``runs`` longest first."""

    about: str
    runs: list[int]


def answered(q: Question, counts: dict[int, tuple[int, int]]) -> bool:
    """Whether the answer breaks off, by how often each run ends a sentence and stands within one (absent: not ``LEAST`` times).

    The longest run known decides. A closing whole number was cut at its decimal sign if after the same words decimals
    stand far more often, and within sentences.
    """
    if q.about == "end":
        e, m = next((counts[r] for r in q.runs if r in counts), (0, 1))
        return e < WELL * (e + m)
    half = len(q.runs) // 2
    for a, b in zip(q.runs[:half], q.runs[half:]):
        (e, m), (f, n) = counts.get(a, (0, 0)), counts.get(b, (0, 0))
        if e + m + f + n:
            return f + n > e + m and f < WELL * (f + n)
    return False


def _at_end(words: list[str]) -> Question:
    return Question("end", _runs([_hash(w) for w in words[-END_WORDS:]]))


def _at_number(words: list[str]) -> Question:
    before = [_hash(w) for w in words[-END_WORDS:-1]]
    # a number without a word before it tells nothing
    whole, decimal = (_runs([*before, xxhash.xxh3_64_intdigest(x)])[:-1] for x in (_shape(words[-1].strip(_BESIDE)), _shape(words[-1].strip(_BESIDE)) + ".0"))
    return Question("number", whole + decimal)


def is_truncated(answer: str) -> bool | Question:
    """Whether an answer breaks off, or what the counts must tell for it."""
    text = answer.strip().strip("\u200b\ufeff\u2060")
    if _UNIT.match(text):
        return False
    body = _SOURCE.sub("", text).rstrip()
    if body != text and not body:
        return False
    body = _CITED.sub("", body).rstrip() or body
    stack: list[str] = []
    for c in body:
        if c == "\n" and stack and stack[-1] == "list":
            stack.pop()
        if c in "([{«„":
            stack.append(c)
        elif c in ")]}»":
            if stack and stack[-1] == _PAIR.get(c):
                stack.pop()
        elif c == "“":
            if stack and stack[-1] == "„":
                stack.pop()
            else:
                stack.append(c)
        elif c == "”" and stack and stack[-1] in "“„":
            stack.pop()
    if stack or body.count('"') % 2:
        return True
    core = body.rstrip("\"'»”“)]} \u200f\u200e*_")
    if not core:
        return False
    last = core[-1]
    lines = [x for x in body.split("\n") if x.strip()]
    item = _ITEM.match(lines[-1]) if lines else None
    if last in "…" or core.endswith("..") or last in ",;:،؛-–—/&+=(":
        return True
    if len(lines) > 1 and re.fullmatch(r"\s*(?:[-*•–·]|\(?\d{1,3}[.)]?)\s*", lines[-1]):
        return True  # an item's mark without the item
    if last in ".!?؟。":
        words = core.split()
        if len(words) > 3 and re.fullmatch(r"[-+]?\d+[.]", words[-1]):
            return _at_number(words)
        return False
    words = (lines[-1][item.end() :] if item else core).split()
    if not words:
        return True
    if item:
        items = [x for x in lines if _ITEM.match(x)]
        others = [x.rstrip() for x in items[:-1]]
        if others and all(x[-1] in ".!?؟" for x in others):
            return True  # the other items have a full stop, this one has none
        return _at_end(words)
    if body != text and len(lines) == 1:
        return _at_end(words)
    return True


def defect(answer: str | None, query: str | None, sufficient: bool | None) -> str | Question | None:
    """The defect of one pair, None, or the question that tells whether it is ``truncated``."""
    if is_empty(answer):
        return "empty"
    if is_refusal(answer):
        return None if sufficient is False else "refusal"
    if copies(answer, query):
        return "copies_query"
    if other_language(answer, query):
        return "other_language"
    cut = is_truncated(answer)
    return cut if isinstance(cut, Question) else "truncated" if cut else None


def broken_pairs(df: DataFrame, id_col: str = "answer_id", answer: str = "answer", query: str = "query", context: str = "has_sufficient_context") -> DataFrame:
    """``(id_col, defect)``, one row per defective answer."""
    rows = df.select(F.col(id_col).alias("__id"), F.col(answer).cast("string").alias("__a"), F.col(query).cast("string").alias("__q"), F.col(context).cast("boolean").alias("__c")).where(F.col(id_col).isNotNull())
    rows = spread(rows)
    key = T.StructField("__id", df.schema[id_col].dataType)
    runs = T.StructField("runs", T.ArrayType(T.LongType()))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            columns = (b[c].astype(object).where(b[c].notna(), None) for c in ("__a", "__q", "__c"))
            got = [defect(a, q, c) for a, q, c in zip(*columns)]
            found = [x.about if isinstance(x, Question) else x for x in got]
            asked = [x.runs if isinstance(x, Question) else None for x in got]
            yield pd.DataFrame({"__id": b["__id"], "defect": pd.Series(found, index=b.index, dtype=object), "runs": pd.Series(asked, index=b.index, dtype=object)})[[x is not None for x in got]]

    judged = checkpoint(rows.mapInPandas(judge, T.StructType([key, T.StructField("defect", T.StringType()), runs])))
    sure = judged.where("runs is null").select("__id", "defect")
    asked = judged.where("runs is not null").distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r, e, m in end_counts(t for b in batches for t in b["__a"]):
            yield pd.DataFrame({"r": r, "e": e, "m": m})

    counts = rows.select("__a").where("__a is not null").mapInPandas(count, "r long, e long, m long")
    counts = counts.groupBy("r").agg(F.sum("e").alias("e"), F.sum("m").alias("m")).where(F.col("e") + F.col("m") >= LEAST)
    # a run that many answers ask for is joined in pieces
    one = asked.select("__id", "defect", "runs", F.explode("runs").alias("r")).withColumn("piece", F.pmod(F.xxhash64("__id"), F.lit(PIECES)).cast("int"))
    wanted = counts.join(one.select("r").distinct(), "r", "left_semi").withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    told = one.join(wanted, ["r", "piece"], "left").groupBy("__id", "defect", "runs").agg(F.collect_list(F.struct("r", "e", "m")).alias("counts"))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cut = [answered(Question(about, list(runs)), {c["r"]: (c["e"], c["m"]) for c in counts if c["e"] is not None}) for about, runs, counts in zip(b["defect"], b["runs"], b["counts"])]
            yield pd.DataFrame({"__id": b["__id"][cut], "defect": pd.Series("truncated", index=b.index[cut], dtype=object)})

    cut = told.mapInPandas(decide, T.StructType([key, T.StructField("defect", T.StringType())]))
    return sure.unionByName(cut).groupBy(F.col("__id").alias(id_col)).agg(F.min("defect").alias("defect"))
