"""Noise of scanned pages: finding it and repairing the text (problem 5).

Method. The lines of a text are stripped of running headers (the row's own title and chapters, in any case or letter
spacing, with misread letters allowed) and page numbers; the rest is one stream of characters without line ends.
The stream is decoded as a joint segmentation into words by a least-cost search: a word may stand as it is, be
read with letters confused, run over a space (a cut word) or over a line end (with a hyphen, a soft hyphen or no
mark), and end within a token (words run together); a compound may keep its own hyphen. Costs are those of a noisy
channel: words cost by their share of all words, unknown words more by a four-letter model, and each confusion, merge,
split and division its constant (``Lexicon``). Tokens that no other reading can beat end the stretches that are
searched, which leaves one look-up for nearly all tokens; the result is that of the search over the whole
stream, but for known words of which two with confused letters make one, and words in three pieces of which no two
neighbours make one. Paragraph boundaries are chosen by dynamic
programming over the lines.

The lexicon has every word that stands ``LEAST`` times in all texts, the chapters are those of all rows. The commonest
``MAX_WORDS`` and ``MAX_CHAPTERS`` are broadcast; where there are more, each page asks for the others by an
equi-join (``_with_rest``), with the same result. Letter groups with less than ``RARE_GROUP`` of all are left out of
the model, a share that means the same at every size and bounds it by ``1 / RARE_GROUP`` entries.

Defined cases: null and blank texts have no noise and stay as they are; rows repeated under one id give
one row a kind; null ids are left out; a null chapter or page only means that this sign is
missing, and without a title headers are told by their look (``title_like``); ``ocr_used`` is not relied on, as it may be untrue.
"""

from __future__ import annotations

import copy
import math
import re
from collections import ChainMap, Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.runtime import checkpoint, spread

#: Occurrences from which a word is known.
LEAST = 4
#: Words and chapters that are broadcast at most.
MAX_WORDS = 300_000
MAX_CHAPTERS = 100_000
#: Share of all letter groups below which a group is left out of the model.
RARE_GROUP = 3e-6

# What was read, and what stood there.
CONFUSIONS = [("c", "e"), ("@", "a"), ("ri", "n"), ("f", "t"), ("|", "i"), ("0", "o"), ("5", "s"), ("ii", "u"), ("1", "l"), ("(", "c"), ("cl", "d"), ("rn", "m"), ("b", "h"), ("9", "g"), ("6", "é"), ("6", "b"), ("I", "l"), ("a:", "ä"), ("o:", "ö"), ("u:", "ü"), ("h", "li"), ("vv", "w"), ("m", "rn"), ("8", "B"), ("¦", "i"), ("!", "l"), ("!", "i"), ("$", "s"), ("€", "e"), ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"), ("1", "i"), ("ß", "B"), ("0", "O"), ("5", "S"), ("1", "I"), ("|", "l"), ("|", "I")]
HYPHENS = "-‐‑\xad¬"

_EDGE = ".,;:!?…\"'«»„“”()[]{}<>،؛؟*•–—"
_CODE = re.compile(r"[A-Z]{1,4}[/-]?\d[\d/-]*\Z|\d[\d.,:/%°-]*[A-Za-z²³%°]{0,3}\Z|\d+-\w+\Z|\[?\d+\]?\Z")
_SIGNS = set("@|(¦!$€0123456789:")
_LETTER = re.compile(r"[^\W\d_]")
_PAGE = re.compile(r"[\W_]*(?:(?:page|pages|pg|p|seite|s|página|pagina|pág|pag|صفحة|ص)\b[\W_]*)?(?:\d{1,4}|[ivxlc]{1,7}|[IVXLC]{1,7})(?:\s*(?:/|of|de|von|sur|من)\s*\d{1,4})?[\W_]*\Z", re.I)
_ADORNED = re.compile(r"[\W_]*(?:page|pages|pg|p|seite|s|página|pagina|pág|pag|صفحة|ص)\b|\s*[\[(~–—|<=·•-]+\s*\w+\s*[\])~–—|>=·•-]+\s*\Z", re.I)
_RULED = re.compile(r"\A\d{1,4}\s*[|·]\s*|\s*[|·]\s*\d{1,4}\Z|\s{3,}\d{1,4}\Z|\A\d{1,4}\s{3,}")
_DIVIDED = re.compile(rf"\S+[{HYPHENS}][ \t\r]*\n\s*\S+")
_ITEM = re.compile(r"\s*(?:[-*•–·]|\(?\d{1,3}[.)])\s")
_HEADED = re.compile(r"\s*\d{1,3}(?:\.\d{1,3})+\.?\s")


def squeezed(text: str) -> str:
    """Letters only, case folded: headers compare equal whatever their case, spacing and page number."""
    return "".join(filter(str.isalpha, text.casefold()))


def bare(token: str) -> str:
    return token.strip(_EDGE)


def _near(a: str, b: str) -> bool:
    """Edit distance of at most one in seven letters (banded)."""
    k = max(len(a), len(b)) // 7
    if abs(len(a) - len(b)) > k:
        return False
    if k == 0 or a == b:
        return a == b
    if a[:3] != b[:3] and a[-3:] != b[-3:]:
        return False  # one end at least must be read well
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new, lo, hi = [i] + [99] * len(b), max(1, i - k), min(len(b), i + k)
        for j in range(lo, hi + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != b[j - 1]))
        if min(new[max(0, lo - 1) : hi + 1]) > k:
            return False
        row = new
    return row[-1] <= k


def roman(text: str) -> int | None:
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    total = 0
    for a, b in zip(text, text[1:] + " "):
        total += -value[a] if value[a] < value.get(b, 0) else value[a]
    ones, tens = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"], ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"]
    return total if 0 < total < 100 and tens[total // 10] + ones[total % 10] == text else None


def page_line(line: str, page: float | None) -> bool:
    """Is the line nothing but the page's number?"""
    s = line.strip()
    if len(s) > 40 or not _PAGE.match(s):
        return False
    digits = re.findall(r"\d+", s)
    if not digits:
        return roman("".join(re.findall(r"[ivxlc]+", s.lower().split()[-1] if s.split() else ""))) is not None and not s.isupper() or bool(_ADORNED.match(s))
    return page is None or page != page or int(digits[0]) == int(page) or bool(_ADORNED.match(s)) and len(s) < 24


def titles(name: str | None) -> list[str]:
    """Forms of a document's title as squeezed letters: whole, without year, without place."""
    if not name:
        return []
    parts = [p for p in re.sub(r"\.\w{1,5}\Z", "", name).split("_") if squeezed(p)]
    out = [squeezed("".join(parts))] + ([squeezed("".join(parts[:-1]))] if len(parts) > 1 else [])
    return [x for x in dict.fromkeys(out) if len(x) > 4]


def header_line(line: str, forms: list[str], chapters: Names, own: str | None) -> bool:
    """Is the line a title, a chapter, or both, with or without a page number?

    A title, the row's own chapter, and each of them within a line of both, may be misread in one letter of seven;
    any other chapter counts as it is spelt.
    """
    if _HEADED.match(line) or line.rstrip()[-1:] in ".!?؟,;:" or len(line) > 160:
        return False
    n = squeezed(line)
    if len(n) < 5:
        return False
    for word in ("page", "seite", "página", "صفحة"):
        if n.endswith(word) or n.startswith(word):
            n = n.removeprefix(word).removesuffix(word)
    if own is not None and _near(n, own) or n in chapters:
        return True
    for f in forms:
        if _near(n, f):
            return True
        if own is not None and (n[:3] == f[:3] or n[-3:] == f[-3:] or n[:3] == own[:3] or n[-3:] == own[-3:]) and (_near(n, f + own) or _near(n, own + f)):
            return True
        k = len(f) // 7
        if len(n) < len(f) - k + 5:
            continue
        for at in range(len(f) - k, min(len(f) + k, len(n) - 5) + 1):
            if n[:3] == f[:3] and n[at:] in chapters and _near(n[:at], f) or n[-3:] == f[-3:] and n[:-at] in chapters and _near(n[-at:], f):
                return True
    return False


def title_like(line: str, before: str | None, after: str | None) -> bool:
    """Does a line look like a header where no title is known?

    Written as a title (capitals, or capital initials of all longer words; scripts without case: five words at most),
    without a closing mark, and at the page's edge with a mark of headers (a rule before its page number, a dash
    between title and chapter, capitals), or cutting a sentence, or with such a mark between paragraphs.
    """
    if _HEADED.match(line) or _ITEM.match(line) or line.rstrip()[-1:] in ".!?؟,;:" or len(line) > 80:
        return False
    plain = _RULED.sub("", line.strip())
    words = [w for w in re.split(r"[\s-]+", plain) if w and w[0].isalpha()]
    long = [w for w in words if len(w) > 3] or words
    if len(words) < 2 or any(c.isdigit() for c in plain):
        return False
    cased = any(c.lower() != c.upper() for c in plain)
    if cased and not all(w[0].isupper() for w in [words[0], *long]) or not cased and len(words) > 8:
        return False
    marked = plain != line.strip() or " - " in plain or cased and plain.isupper()
    cuts = before is not None and after is not None and before[-1] not in ".!?؟:" and not after[:1].isupper()
    return marked or cuts and (cased or len(words) < 6) or after is None and before is not None and before[-1] in ".!?؟" and len(words) < 6


class Names:
    """Squeezed chapter names; those not held can be noted for a look-up in the whole table."""

    def __init__(self, held: set[str], asked: set[str] | None = None, more: frozenset[str] = frozenset()):
        self.held, self.asked, self.more = held, asked, more

    def __contains__(self, name: str) -> bool:
        if name in self.held or name in self.more:
            return True
        if self.asked is not None:
            self.asked.add(name)
        return False


class Lexicon:
    """Word frequencies, a four-letter model of words, and the noisy channel over them.

    The channel reads a stretch of the character stream as one word at the cost ``word`` gives, and a stream of
    several tokens at the least cost of all its segmentations (``least``).
    """

    #: How many times as frequent a reading must be for a known word to count as misread.
    FAR = 60
    #: A letter read for other letters, a sign read for a letter, and the same where neither reading is a known word.
    CONFUSED, SIGN, NAMED, SIGNED = math.log(FAR), 2.0, 8.0, 0.5
    #: A word cut by a space or a bare line end; two words run together; a hyphen taken for a division mark, or for a compound's own.
    MERGED, SPLIT, HYPHENED, COMPOUND = 8.0, 14.0, 1.0, 6.0
    #: A division before a capital letter; any other mark of division taken for a compound's hyphen.
    CAPITAL, NEVER = 20.0, 1000.0
    #: An unknown word beside a word seen once, before the letter model.
    UNKNOWN = 3.5
    #: A number, a code or a mark as it stands.
    FIXED = 8.0
    #: Cost of a letter from which an unknown word may be misread.
    ODD = 5.0
    #: Longest word that is sought over token boundaries.
    LONGEST = 40

    def __init__(self, words: dict[str, int], groups: dict[str, int], total: int | None = None, held_share: float = 0.0):
        self.words, self.total = words, max(2, total or sum(words.values()))
        low: dict[str, int] = defaultdict(int)
        for w, n in words.items():
            low[w.lower()] += n
        self.low = dict(low)
        self.get = self.low.get
        self.groups = groups
        heads: dict[str, int] = defaultdict(int)
        for g, n in groups.items():
            heads[g[:-1]] += n
        self.heads = dict(heads)
        self.costs: dict[str, float] = {}
        self.rules: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for seen, true in CONFUSIONS:
            self.rules[seen[0]].append((seen, true))
        self.log_total = math.log(self.total)
        #: Least cost of any word, and of a word outside the held part.
        self.cheapest = self.log_total - math.log(max(low.values(), default=1))
        self.rare = -math.log(held_share) if held_share else math.inf
        self._forget()

    def _forget(self) -> None:
        self.tokens: dict[str, tuple[bool, float, str, str]] = {}
        self.read: dict[str, tuple[float, str]] = {}
        self.islands: dict[str, tuple[str, frozenset[str]]] = {}

    def noting(self, asked: set[str]) -> Lexicon:
        """The same lexicon that notes every word it does not hold."""
        other = copy.copy(self)

        def get(w: str, default: int = 0) -> int:
            n = self.low.get(w)
            if n is None:
                asked.add(w)
                return default
            return n

        other.get = get
        other._forget()
        return other

    def with_words(self, more: list[tuple[str, int]]) -> Lexicon:
        """The same lexicon with further words."""
        other = copy.copy(self)
        low: dict[str, int] = defaultdict(int)
        for w, n in more:
            low[w.lower()] += n
        other.words = ChainMap(dict(more), self.words)
        other.low = ChainMap(dict(low), self.low)
        other.get = other.low.get
        other.rare = math.inf
        other._forget()
        return other

    def count(self, w: str) -> int:
        return self.get(w.lower(), 0)

    def group_costs(self, w: str) -> list[float]:
        """Negative log probability of each letter of a word, and of its end, under the four-letter model."""
        s = f"^^^{w.lower()}$"
        out = []
        for i in range(len(s) - 3):
            g = s[i : i + 4]
            c = self.costs.get(g)
            if c is None:
                if len(self.costs) > 1_000_000:
                    self.costs.clear()
                c = self.costs[g] = -math.log((self.groups.get(g, 0) + 0.02) / (self.heads.get(g[:3], 0) + 0.02 * 60))
            out.append(c)
        return out

    def letters(self, w: str) -> float:
        return sum(self.group_costs(w))

    def known(self, n: int) -> float:
        return self.log_total - math.log(n)

    def unknown(self, w: str) -> float:
        return self.log_total + self.UNKNOWN + self.letters(w)

    def undone(self, w: str) -> list[str]:
        """Words of which one confusion makes ``w``."""
        out = []
        for at, c in enumerate(w):
            for seen, true in self.rules.get(c, ()):
                if w.startswith(seen, at):
                    out.append(w[:at] + true + w[at + len(seen) :])
        return out

    def readings(self, w: str, most: int) -> Iterator[tuple[str, int]]:
        """Words that could have been read as ``w``, with the number of confusions, fewest first."""
        seen, layer = {w}, [w]
        for used in range(1, most + 1):
            layer = list(dict.fromkeys(v for x in layer for v in self.undone(x) if v not in seen))
            seen.update(layer)
            for v in layer:
                yield v, used

    def word(self, token: str) -> tuple[float, str]:
        """Least cost of reading a stretch as one word, and the word."""
        got = self.read.get(token)
        if got is None:
            if len(self.read) > 400_000:
                self.read.clear()
            got = self.read[token] = self._token(token)
        return got

    def _token(self, token: str) -> tuple[float, str]:
        w = token.strip(_EDGE)
        if not w or len(w) < 2 or not _LETTER.search(w):
            n = self.count(w) if w else 0
            return (self.known(n) if n else self.FIXED), token
        cost, v = self._parts(w)
        best = cost, token if v == w else token.replace(w, v, 1)
        if token.lstrip("\"'«»„“[{").startswith("(") and not token.rstrip(".,;:").endswith(")") and not self.count(w) and (n := self.count("c" + w)):
            best = min(best, (self.known(n), token.replace("(" + w, "c" + w, 1)))  # an opening bracket for the first letter
        return best

    def _parts(self, w: str) -> tuple[float, str]:
        """A word, or the word after an elided article, or a compound of words."""
        for p in ("'", "’"):
            if p in w[:-1] and len(w.split(p)[0]) <= 2:
                head, tail = w.split(p, 1)
                cost, v = self._one(tail)
                return cost + 2.0, f"{head}{p}{v}"
        if "-" in w.strip("-"):
            if n := self.count(w):
                return self.known(n), w
            got = [self._one(x) if len(x) > 1 else (self.FIXED, x) for x in w.split("-")]
            return sum(c for c, _ in got) + self.COMPOUND * (len(got) - 1), "-".join(v for _, v in got)
        return self._one(w)

    def _one(self, w: str) -> tuple[float, str]:
        n = self.count(w)
        own = self.known(n) if n else self.unknown(w)
        if len(w) < 2 or _CODE.match(w) or not _LETTER.search(w):
            return min(own, self.FIXED), w
        if n * 20 * self.FAR > self.total:
            return own, w  # nothing can be so much more frequent
        inner = 0 if w.isupper() else 1
        strange = lambda x: sum(c in _SIGNS for c in x) + inner * sum(c.isupper() for c in x[1:])
        signs, odds = sum(c in _SIGNS for c in w), strange(w)
        if not inner and not signs:
            return own, w
        digits = sum(c.isdigit() for c in w)
        if digits * 2 > len(w) or w[0].isupper() and w[1:].isdigit():
            return min(own, self.FIXED), w
        if digits and len(rest := w.lstrip("0123456789.,")) <= 2 and rest.isalpha():
            return min(own, self.FIXED), w  # a number with its unit
        fits = lambda v: not any(c.isdigit() for c in v) and (v[1:] == v[1:].lower() or v.isupper())
        odd = odds > 0 or not n and max(self.group_costs(w)) >= self.ODD
        best = own, w
        for v, used in self.readings(w, 3 if odds else 2 if odd else 1):
            if (m := self.count(v)) and fits(v):
                marks = min(used, odds - strange(v))
                best = min(best, (self.known(m) + self.SIGN * marks + self.CONFUSED * (used - marks), v))
        if best[1] != w or n or not odd or len(w) < 4 and not signs:
            return best
        # names and other words outside the lexicon: the letter model decides
        for v, used in self.readings(w, 2):
            if fits(v) and not any(c in _SIGNS for c in v):
                best = min(best, (self.unknown(v) + (self.SIGNED if odds else self.NAMED) * used, v))
        return best

    def token(self, t: str) -> tuple[bool, float, str, str]:
        """Whether a token needs the search, its own cost, and its letters if they may run on to the right, or to the left."""
        got = self.tokens.get(t)
        if got is None:
            if len(self.tokens) > 400_000:
                self.tokens.clear()
            w = t.strip(_EDGE)
            cost, v = self.word(t)
            plain = w.isalpha()
            # a split costs SPLIT and two words at least
            search = v != t or plain and (len(w) > 1 and cost > self.SPLIT + 2 * self.cheapest or not self.count(w))
            joins = plain or search and all(c.isalpha() or c in _SIGNS for c in w)
            opens, closes = (w.lower() if joins and t.endswith(w) else ""), (w.lower() if joins and t.startswith(w) else "")
            got = self.tokens[t] = search, cost, opens, closes
        return got

    def linked(self, a: tuple, b: tuple) -> bool:
        """Could two neighbouring tokens be one word that was cut?"""
        if not a[2] or not b[3]:
            return False
        both = a[1] + b[1] - self.MERGED
        if both <= self.cheapest:
            return False  # no word is frequent enough to cost less
        if a[0] and b[0]:
            return True
        return bool(self.low.get(a[2] + b[3])) if both <= self.rare else bool(self.get(a[2] + b[3], 0))

    def least(self, island: str) -> tuple[str, frozenset[str]]:
        """The least-cost reading of a stretch of the stream and the noise on its path.

        The stretch is taken as letters without spaces and line ends; a word may run over the places where they
        stood (cut words), end at them, or end within a token (words run together). A word that ran over a line
        end stands after it.
        """
        got = self.islands.get(island)
        if got is None:
            if len(self.islands) > 200_000:
                self.islands.clear()
            got = self.islands[island] = self._least(island)
        return got

    def _least(self, island: str) -> tuple[str, frozenset[str]]:
        chars, mark, places = "", {}, [0]  # mark: what stood at a boundary; places: where words may end
        tokens = re.split("([ \n])", island)
        for i in range(0, len(tokens), 2):
            t, start = tokens[i], len(chars)
            sep = tokens[i + 1] if i + 1 < len(tokens) else ""
            divided = sep == "\n" and len(t) > 1 and t[-1] in HYPHENS and t[-2].isalpha() and tokens[i + 2][:1].isalnum()
            body = t[:-1] if divided else t
            chars += body
            w = body.strip(_EDGE)
            if len(w) > 3 and w.isalpha() and self.word(body)[0] > self.SPLIT + 2 * self.cheapest:
                first = start + body.index(w)
                places += range(first + 2, first + len(w) - 1)
            mark[len(chars)] = t[-1] if divided else sep
            places.append(len(chars))
        bounds = sorted(mark)
        mark[0] = ""
        best: dict[int, tuple[float, int, str, frozenset[str]]] = {0: (0.0, 0, "", frozenset())}
        for j in places[1:]:
            for i in places:
                if i >= j:
                    break
                if i not in best:
                    continue
                inner = [b for b in bounds if i < b < j]
                if j - i > self.LONGEST and (inner or i not in mark or j not in mark):
                    continue
                for cost, text, noise in self._edge(chars, i, j, inner, mark):
                    cost += best[i][0]
                    if i not in mark:
                        cost += self.SPLIT
                    elif mark[i] not in ("", " ", "\n"):  # ends at a division mark: a compound's own hyphen
                        cost += self.COMPOUND if mark[i] == "-" else self.NEVER
                    if j not in best or cost < best[j][0]:
                        best[j] = cost, i, text, noise
        parts, noise, j = [], set(), len(chars)
        while j > 0:
            _, i, text, found = best[j]
            noise |= found
            after = mark.get(j, " ")
            parts.append(text + after if after in ("", " ", "\n") else f"\n{text}-")
            j = i
        return "".join(reversed(parts)), frozenset(noise)

    def _edge(self, chars: str, i: int, j: int, inner: list[int], mark: dict[int, str]) -> Iterator[tuple[float, str, frozenset[str]]]:
        """Readings of one stretch as one word."""
        s = chars[i:j]
        if i in mark and j in mark and not inner:
            cost, text = self.word(s)
            yield cost, text, frozenset(["misread"] if text != s else [])
            return
        w = s.strip(_EDGE)
        breaks = "\n" * sum(mark[b] != " " for b in inner)
        divided = [b for b in inner if mark[b] not in " \n"]
        if i in mark and j in mark:
            if any(not chars[b].isalpha() or not chars[b - 1].isalpha() for b in inner):
                return
            cost, text = self.word(s)
            known = cost < self.log_total + self.UNKNOWN or self.count(text.strip(_EDGE))
            if known or len(divided) == len(inner):
                price = 0.0
                for b in inner:
                    price += self.HYPHENED if b in divided else self.MERGED
                    if mark[b] == "-" and chars[b].isupper() and not chars[i:b].strip(_EDGE).isupper():
                        price += self.CAPITAL
                noise = (["misread"] if text != s else []) + (["hyphenation"] if breaks else [])
                yield cost + price, breaks + text, frozenset(noise)
            if divided and len(divided) == len(inner) and all(mark[b] == "-" for b in inner):
                kept = "-".join(chars[a:b] for a, b in zip([i, *inner], [*inner, j]))
                if n := self.count(kept.strip(_EDGE)):
                    yield self.known(n), breaks + kept, frozenset()
        elif not inner and len(w) > 1:
            # a word that begins or ends within a token stands in the lexicon as it is spelt
            n = self.count(w) and self.words.get(w, 0) if i not in mark else self.count(w)
            if n and (i in mark or w == s or s.startswith(w)) and (j in mark or s.endswith(w)):
                yield self.known(n), s, frozenset()


#: State after a token that ends in a division mark at a line end.
DIVIDED = (True, 0.0, "", "")


class Page:
    """One text cut into kept lines, with the noise that was found on the way."""

    def __init__(self, text: str, forms: list[str], own: str | None, chapters: Names, page: float | None):
        self.lines: list[str] = []
        self.blank: list[int] = []  # blank lines before each kept line; -1 where noise lines stood between
        self.noise: set[str] = set()
        raw = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        before, gap, cut = 0, False, 0
        many = sum(1 for x in raw if x.strip()) > 1
        beside = lambda i: (text_lines[i - 1] if i else None, text_lines[i + 1] if i + 1 < len(text_lines) else None)
        at = -1
        text_lines = [x.strip() for x in raw if x.strip() and not page_line(x.strip(), page)] if not forms and many else []
        for line in raw:
            s = line.strip()
            if not s:
                before += 1
                continue
            if many and page_line(s, page):
                self.noise.add("page_number")
                gap, cut = True, before if not gap else cut
                before = 0
                continue
            at += 1
            if many and (header_line(s, forms, chapters, own) or text_lines and title_like(s, *beside(at))):
                self.noise.add("running_header")
                if re.search(r"\d", s) and self._numbered(s, page, forms):
                    self.noise.add("page_number")
                gap, cut = True, before if not gap else cut
                before = 0
                continue
            if gap:
                # blank lines on both sides belong to the header; on one side only they end a paragraph
                self.blank.append(1 if (cut > 0) != (before > 0) else 0)
            else:
                self.blank.append(before)
            self.lines.append(s)
            before, gap = 0, False

    @staticmethod
    def _numbered(line: str, page: float | None, forms: list[str]) -> bool:
        numbers = re.findall(r"(?<![\w/])\d{1,4}(?!\w)", line)
        return any(page is None or page != page or int(x) == int(page) for x in numbers) or bool(re.search(r"[|]\s*\d+\s*\Z|\A\s*\d+\s*[|]|\s{3,}\d+\s*\Z", line))


def decode(page: Page, lexicon: Lexicon, repair: bool) -> str | None:
    """Least-cost segmentation of the kept lines' stream; adds the noise found to ``page`` and gives the text if ``repair``.

    Tokens that no other reading can beat end the stretches that are searched (``Lexicon.token``, ``linked``).
    """
    out: list[str] = []
    held: list[str] = []  # tokens and separators of the stretch that is not yet decoded

    def close() -> None:
        text, noise = lexicon.least("".join(held[:-1]))
        page.noise |= noise
        if repair:
            out.append(text + held[-1])
        held.clear()

    tokens, word, linked = lexicon.tokens.get, lexicon.token, lexicon.linked
    before: tuple | None = None
    pending = ""  # the token before, with its separator, if it stands for itself so far
    lines = [(x[:-1].replace("\xad", "") + x[-1] if "\xad" in x else x).split() for x in page.lines]
    for n, words in enumerate(lines):
        last = len(words) - 1
        for j, t in enumerate(words):
            sep = " " if j < last else "\n" if n + 1 < len(lines) else ""
            divided = j == last and sep and len(t) > 1 and t[-1] in HYPHENS and t[-2].isalpha() and lines[n + 1] and lines[n + 1][0][0].isalnum()
            state = tokens(t) or word(t)
            tied = before is not None and (before is DIVIDED or linked(before, state))
            if not tied:
                if held:
                    close()
                elif pending:
                    out.append(pending)
                pending = ""
            elif pending:
                held.extend((pending[:-1], pending[-1]))
                pending = ""
            if tied or divided or state[0]:
                held.extend((t, sep))
            elif repair or state[2]:
                pending = t + sep
            before = DIVIDED if divided else state
    if held:
        close()
    elif pending:
        out.append(pending)
    return paragraphs([x.split() for x in "".join(out).split("\n")], page) if repair else None


def paragraphs(rows: list[list[str]], page: Page) -> str:
    """Lines to paragraphs by dynamic programming: every boundary costs, and so does a paragraph that no sentence end closes."""
    n = len(rows)
    best, back = [0.0] + [1e9] * n, [0] * (n + 1)
    closed = [bool(r) and r[-1].rstrip("\"'»”)]")[-1:] in ".!?؟:" for r in rows]
    item = [bool(_ITEM.match(x)) or bool(_HEADED.match(x)) for x in page.lines]
    # join[i]: cost of running line i on from line i - 1; cut[i]: cost of a boundary before it
    step = [0.0] * n
    for i in range(1, n):
        gap = page.blank[i] > 0
        step[i] = (2.0 if gap and closed[i - 1] else 0.0) + (3.0 if item[i] else 0.0) - (0.0 if closed[i - 1] else 1.5)
    total = 0.0
    prefix = [0.0]
    for i in range(n):
        total += step[i] if i else 0.0
        prefix.append(total)
    low, at = 0.0, 0  # least of best[i] + 1 - prefix[i + 1] over the boundaries so far
    for j in range(1, n + 1):
        if j > 1:
            open_cost = best[j - 1] + (0.5 if closed[j - 2] else 2.0) - prefix[j]
            if open_cost < low:
                low, at = open_cost, j - 1
        elif j == 1:
            low, at = best[0] - prefix[1], 0
        best[j] = low + prefix[j]
        back[j] = at
    parts, j = [], n
    while j > 0:
        i = back[j]
        parts.append(" ".join(w for r in rows[i:j] for w in r))
        j = i
    out, parts = "", parts[::-1]
    k = 0
    starts = []
    j = n
    while j > 0:
        starts.append(back[j])
        j = back[j]
    for k, (p, s) in enumerate(zip(parts, starts[::-1])):
        out += ("" if k == 0 else "\n" if item[s] and page.blank[s] == 0 else "\n\n") + p
    return out


def corpus_words(df: DataFrame, text: str = "text") -> DataFrame:
    """``(w, n)``: the words of all texts, and those after elided articles; written once to the shared folder.

    The two parts of a word that a line end divides are no words of their own.
    """

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for t in b["t"]:
                seen.update(_DIVIDED.sub(" ", t).split())
            if len(seen) > 200_000:
                yield pd.DataFrame({"w": pd.Series(list(seen.keys()), dtype=object), "n": pd.Series(list(seen.values()), dtype="int64")})
                seen = Counter()
        yield pd.DataFrame({"w": pd.Series(list(seen.keys()), dtype=object), "n": pd.Series(list(seen.values()), dtype="int64")})

    counted = spread(df.select(F.col(text).cast("string").alias("t")).where("t is not null")).mapInPandas(tokens, "w string, n long")
    edge = "".join("\\" + c for c in _EDGE)
    stripped = counted.withColumn("w", F.regexp_replace("w", f"^[{edge}]+|[{edge}]+$", "")).where(F.col("w").rlike(r"^[\p{L}][\p{L}\p{M}'’\-]*$"))
    elided = F.regexp_extract("w", "^[^'’]{1,2}['’](.{3,})$", 1)
    both = stripped.select(F.explode(F.array_compact(F.array(F.col("w"), F.when(elided != "", elided)))).alias("w"), "n")
    return checkpoint(both.groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST))


def corpus_lexicon(words: DataFrame, most: int = MAX_WORDS) -> tuple[Lexicon, DataFrame | None]:
    """The lexicon of the ``most`` commonest words at most, and the table of all others (None if there are none)."""
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    held = words if kinds <= most else words.where(F.col("n") * most > total)
    kept = held.toPandas()
    padded = F.concat(F.lit("^^^"), F.lower("w"), F.lit("$"))
    groups = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") + 1), lambda i: F.substring(padded, i, F.lit(4)))).alias("g"), F.ceil(F.sqrt("n")).cast("long").alias("n")).groupBy("g").agg(F.sum("n").alias("n"))
    groups = checkpoint(groups)
    size = groups.agg(F.sum("n")).first()[0] or 1
    fours = groups.where(F.col("n") >= RARE_GROUP * size).toPandas()
    rest = None if kinds <= most else words.where(F.col("n") * most <= total)
    lexicon = Lexicon(dict(zip(kept["w"], kept["n"].astype(int))), dict(zip(fours["g"], fours["n"].astype(int))), total, 0.0 if rest is None else 1 / most)
    return lexicon, rest


def corpus_chapters(df: DataFrame, chapter: str = "chapter", most: int = MAX_CHAPTERS) -> tuple[set[str], DataFrame | None]:
    """Squeezed names of the commonest chapters, ``most`` at most, and the table of all others (None if there are none)."""
    counted = df.where(F.col(chapter).isNotNull()).groupBy(F.col(chapter).cast("string").alias("c")).count()

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"c": b["c"].map(squeezed).astype(object), "n": b["count"]})

    names = checkpoint(counted.mapInPandas(squeeze, "c string, n long").where(F.length("c") > 4).groupBy("c").agg(F.sum("n").alias("n")))
    total, kinds = names.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    held = names if kinds <= most else names.where(F.col("n") * most > total)
    return {r["c"] for r in held.select("c").collect()}, None if kinds <= most else names.where(F.col("n") * most <= total)


def _rows(df: DataFrame, id_col: str) -> DataFrame:
    return spread(df.select(F.col(id_col).alias("__id"), *[F.col(c).cast("string").alias(c) for c in ("text", "document_name", "chapter")], F.col("page").cast("double").alias("page")).where(F.col(id_col).isNotNull() & F.col("text").isNotNull()))


def _pages(b: pd.DataFrame, chapters: list[Names], forms: dict[str, list[str]]) -> Iterator[Page]:
    for text, name, chapter, page, names in zip(b["text"], b["document_name"], b["chapter"], b["page"], chapters):
        name = name if isinstance(name, str) else None
        if name not in forms:
            if len(forms) > 50_000:
                forms.clear()
            forms[name] = titles(name)
        yield Page(text, forms[name], squeezed(chapter) if isinstance(chapter, str) and chapter else None, names, page)


def _each(df: DataFrame, id_col: str, repair: bool, max_words: int, max_chapters: int) -> DataFrame:
    spark = df.sparkSession
    lexicon, words = corpus_lexicon(corpus_words(df), max_words)
    held, chapters = corpus_chapters(df, most=max_chapters)
    sent = spark.sparkContext.broadcast((lexicon, held))
    rows = _rows(df, id_col)
    more = words is not None or chapters is not None
    if more:
        rows = _with_rest(rows, sent, words, chapters)
    out = T.StructField("text", T.StringType()) if repair else T.StructField("noise", T.StringType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, held = sent.value
        forms: dict[str, list[str]] = {}
        for b in batches:
            ids, values = [], []
            extra = [[(x["s"], x["n"], x["name"]) for x in e] if e is not None else [] for e in b["__more"]] if more else [[]] * len(b)
            names = [Names(held, more=frozenset(s for s, _, is_name in e if is_name)) for e in extra] if more else [Names(held)] * len(b)
            for key, page, e in zip(b["__id"], _pages(b, names, forms), extra):
                new = [(s, n) for s, n, is_name in e if not is_name]
                fixed = decode(page, lexicon.with_words(new) if new else lexicon, repair)
                if repair:
                    ids.append(key)
                    values.append(fixed)
                else:
                    ids += [key] * len(page.noise)
                    values += sorted(page.noise)
            yield pd.DataFrame({id_col: pd.Series(ids, dtype=object), out.name: pd.Series(values, dtype=object)})

    return rows.mapInPandas(run, T.StructType([df.schema[id_col], out]))


def _with_rest(rows: DataFrame, sent, words: DataFrame | None, chapters: DataFrame | None) -> DataFrame:
    """``rows`` with the words and chapters outside the broadcast part that their decoding may ask for.

    Every page is decoded once by a lexicon that notes what it does not hold; what was noted meets the table of the
    other words and chapters in an equi-join, and comes back as one list a page (no longer than the page's questions).
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("__key", F.md5(F.to_json(F.struct("text", "document_name", "chapter", "page"))))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, held = sent.value
        forms: dict[str, list[str]] = {}
        for b in batches:
            keys, strings, kinds = [], [], []
            asked_words: set[str] = set()
            asked_names: set[str] = set()
            noting = lexicon.noting(asked_words)
            names = [Names(held, asked_names)] * len(b)
            for key, page in zip(b["__key"], _pages(b, names, forms)):
                noting._forget()  # what one page has asked, the next must ask too
                decode(page, noting, False)
                for found, is_name in ((asked_words, False), (asked_names, True)):
                    keys += [key] * len(found)
                    strings += found
                    kinds += [is_name] * len(found)
                    found.clear()
            yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "s": pd.Series(strings, dtype=object), "name": pd.Series(kinds, dtype=bool)})

    asked = keyed.select("__key", "text", "document_name", "chapter", "page").mapInPandas(ask, "key string, s string, name boolean").distinct()
    none = spark.createDataFrame([], "s string, whole string, n long, name boolean")
    known = none
    if words is not None:
        known = known.unionByName(words.select(F.lower("w").alias("s"), F.col("w").alias("whole"), "n", F.lit(False).alias("name")))
    if chapters is not None:
        known = known.unionByName(chapters.select(F.col("c").alias("s"), F.col("c").alias("whole"), "n", F.lit(True).alias("name")))
    answers = asked.join(known, ["s", "name"]).groupBy("key").agg(F.collect_list(F.struct(F.col("whole").alias("s"), "n", "name")).alias("__more"))
    return keyed.join(answers, F.col("__key") == F.col("key"), "left").drop("__key", "key")


def find_noise(df: DataFrame, id_col: str = "chunk_id", max_words: int = MAX_WORDS, max_chapters: int = MAX_CHAPTERS) -> DataFrame:
    """``(id_col, noise)``, one row per kind present. The bounds of what is broadcast do not change the result."""
    return _each(df, id_col, False, max_words, max_chapters).distinct()


def repair(df: DataFrame, id_col: str = "chunk_id", max_words: int = MAX_WORDS, max_chapters: int = MAX_CHAPTERS) -> DataFrame:
    """``(id_col, text)`` with the text repaired, one row per id."""
    return _each(df, id_col, True, max_words, max_chapters).groupBy(id_col).agg(F.max("text").alias("text"))
