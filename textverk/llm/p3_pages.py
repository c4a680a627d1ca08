"""Page furniture, broken words and body lines of a scanned text (one document at a time).

Candidates are lines that hold a page number of one form, lines that come back (but for
misread characters), and lines that end in a broken word. Pairs of lines, a candidate and
the next of its form, or a broken line and the next body line, have features of place,
numbers, distance and surroundings; classifiers fitted on simulated scans (``p3_simulate``)
tell from them which are furniture and which lines go on. Every text is looked at, also one
without any sign of a scan; there the lines that come back must also divide it as pages would.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cache, lru_cache
from os.path import commonprefix

_D = r"[0-9lIOoSB|]"
_NUM = rf"(?=[^\n]*[0-9])({_D}{{1,6}})"
# Lines that hold only a page number or count
PAGE = re.compile(
    rf"^\s*(?:(?P<word>s[il1]d[ao.]?\.?|page|p\.)\s*(?P<a>{_D}{{1,6}})(?:\s*(?:av|of|/)\s*{_D}{{1,6}})?|(?P<b>{_D}{{1,6}})\s*(?:\(\s*{_D}{{1,6}}\s*\)|/\s*{_D}{{1,6}}|av\s+{_D}{{1,6}})|[-–—]\s*(?P<c>{_D}{{1,6}})\s*[-–—]|\[\s*(?P<d>{_D}{{1,6}})\s*\]|(?P<e>{_D}{{1,6}})|(?P<f>[ivxlc]{{1,12}}))\s*$",
    re.IGNORECASE,
)
# First and last characters of such lines, and of lines that _LIST matches: what others need no match
_FIRST = frozenset("0123456789lIOoSsBb|pP-–—[ivxlcVXLC")
_LAST = frozenset("0123456789lLiIıİoOsSſbB|vVxXcC)-–—]")
_DIGITS = str.maketrans("lIi|OoSsBb", "1111005588")
TAIL = re.compile(r"^(?P<rest>.*\S)\s{2,}(?P<n>[0-9lIO]{1,6})$")
HEAD = re.compile(r"^(?P<n>[0-9lIO]{1,6})\s{2,}(?P<rest>\S.*)$")
_NUMERIC = "0123456789lIO"
HYPHENS = "-‐¬­"
_HYPHENS = frozenset(HYPHENS)
_LETTER = re.compile(r"[^\W\d_]")
BROKEN = re.compile(rf"[^\W\d_][^\W_]*[{HYPHENS}]$")
_ODD = re.compile(r"[0-9I](?<=[a-zåäö].)[a-zåäö]")  # a digit or I between letters, as only a scanner gives it
_SMALL = frozenset("abcdefghijklmnopqrstuvwxyzåäö")
LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_LIST = re.compile(r"^\s*(?:[•·→▪■●*–-]\s|\d+[.)]\s|\(?[^\W\d_]\)\s|\d+(?:\.\d+)+\s)")
KEEPS = {"och", "eller", "samt", "respektive", "and", "or", "und", "oder", "ja", "tai", "till"}


@dataclass
class Page:
    """What was found in a text; line numbers from 1."""

    lines: list[str]
    pageno: list[int] = field(default_factory=list)
    header: list[int] = field(default_factory=list)
    hyphen: list[tuple[int, int]] = field(default_factory=list)  # line, and the line that goes on
    scanned: bool = False


def _value(s: str) -> int | None:
    t = s.translate(_DIGITS)
    return int(t) if t.isdigit() else None


_ROMAN = re.compile(r"c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_WORTH = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def _roman(s: str) -> int | None:
    """The value of a Roman numeral in either case, if it is one."""
    t = s.lower()
    if not t or not _ROMAN.fullmatch(t):
        return None
    n = [_WORTH[c] for c in t]
    return sum(-a if a < b else a for a, b in zip(n, [*n[1:], 0], strict=True))


def _kind(m: re.Match) -> tuple[str, int | None]:
    if m["f"] is not None or m["e"] is not None and m["e"].isalpha():
        return "f", _roman(m["f"] or m["e"])
    for k in "abcde":
        if m[k] is not None:
            return k, _value(m[k])
    return "", None


@lru_cache(10_000)  # a line may have any length
def _parts(n: int, most: int = 3) -> list[tuple[int, int]]:
    """Where a line of n characters is cut into parts: within ``most`` edits all but ``most`` of
    them stay whole, shifted by no more than ``most``."""
    k = 2 * (most + 1) if n >= 28 else most + 1
    cut = [n * i // k for i in range(k + 1)]
    return list(zip(cut, cut[1:], strict=False))


@cache
def _shifts(most: int) -> dict[int, list[int]]:
    """How far a part that stayed whole may be shifted in a line longer by each number of
    characters: the edits before it and those after it add up."""
    return {d: [s for s in range(-most, most + 1) if abs(s) + abs(d - s) <= most] for d in range(-most, most + 1)}


class _Forms:
    """Forms of lines, found again by the parts that stayed whole. A line is compared with those
    forms alone that share enough parts: of few forms each is looked at, of many a look-up of the
    parts of all lengths and shifts in question gives them."""

    FEW = 64  # forms of a line's length, give or take ``most``, up to which each is looked at

    def __init__(self, most: int = 3) -> None:
        self.most, self.groups, self.by = most, [], {}
        self.whole: list[list[str] | None] = []  # the parts of each form
        self.close: dict[int, list[int]] = {}  # the forms of each length, give or take ``most``
        self.indexed = 0  # so many of the groups are in the look-up

    def add(self, key: str, places: list) -> None:
        g, n = len(self.groups), len(key)
        for m in range(n - self.most, n + self.most + 1):
            if m in self.close:
                self.close[m].append(g)
            else:
                self.close[m] = [g]
        self.groups.append((key, list(places)))
        self.whole.append(None)

    def find(self, key: str, least: int = 1) -> list | None:
        """The places of the first form that ``key`` is, but for misread characters."""
        near = self.close.get(len(key))
        if near is None:
            return None
        most = self.most
        for g in near if len(near) <= self.FEW else self._likely(key):
            whole = self.whole[g] or self._pieces(g)
            lost = 0
            for x in whole:
                if x not in key:
                    lost += 1
                    if lost > most:
                        break
            else:
                form, places = self.groups[g]
                if form == key or _near(form, key, least, most):
                    return places
        return None

    def _pieces(self, g: int) -> list[str]:
        form = self.groups[g][0]
        self.whole[g] = [form[x:y] for x, y in _parts(len(form), self.most)]
        return self.whole[g]

    def _likely(self, key: str) -> list[int]:
        for g in range(self.indexed, len(self.groups)):
            form = self.groups[g][0]
            own = self.by.setdefault(len(form), [{} for _ in _parts(len(form), self.most)])
            for at, x in zip(own, self.whole[g] or self._pieces(g), strict=True):
                at.setdefault(x, []).append(g)
        self.indexed = len(self.groups)
        likely: list[int] = []
        for d, shifts in _shifts(self.most).items():
            n = len(key) - d
            if n not in self.by:
                continue
            cut = _parts(n, self.most)
            need, shared = len(cut) - self.most, Counter()
            for k, ((x, y), at) in enumerate(zip(cut, self.by[n], strict=True)):
                if not shared and len(cut) - k < need:
                    break  # too few parts are left
                hits = [hit for s in shifts if x + s >= 0 and (hit := at.get(key[x + s : y + s]))]
                if hits:
                    shared.update(hits[0] if len(hits) == 1 else {g for hit in hits for g in hit})
            likely += [g for g, c in shared.items() if c >= need]
        return sorted(likely)


def _near(a: str, b: str, least: int = 1, most: int = 3) -> bool:
    """Whether two header lines are the same but for misread characters: three edits, or two
    if both come back, as two headers may differ in a number only."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most or min(len(a), len(b)) < 6:
        return False
    full = len(a)
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    p = len(commonprefix((a, b)))
    a, b = a[p:], b[p:]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
        if min(row) > most:
            return False
    return row[-1] <= min(most if least == 1 else 2, full // 4)


_KINDS = "abcdef"  # forms of page numbers; 0 is a line that comes back
_STOPS = ".!?:”\"»"


class Scan:
    """Candidates for furniture and joins in a text, and the features of their pairs."""

    def __init__(self, text: str, scanned: bool) -> None:
        self.lines = [x.strip() for x in text.split("\n")]
        self.full = [i for i, x in enumerate(self.lines) if x]
        self.place = {i: k for k, i in enumerate(self.full)}
        self.text = text
        self.ended = [p for p, i in enumerate(self.full) if self.lines[i][-1] in _HYPHENS]  # places, not lines
        self.likely = scanned or self._broken()
        self.by: dict[str, list[tuple[int, int | None]]] = {}
        for i in self.full:
            x = self.lines[i]
            if x[0] in _FIRST and x[-1] in _LAST and (m := PAGE.match(x)):
                k, v = _kind(m)
                if any(c.isdigit() for c in x) or k in "acd" or k == "f" and v is not None:
                    self.by.setdefault(k, []).append((i, v))

    def _broken(self) -> bool:
        """Whether a word seems to be broken at the end of a line."""
        for p in self.ended:
            x = self.lines[self.full[p]]
            if x[-1] != "-":
                if self.full[p] + 1 < len(self.lines) and x[-2:-1].isalnum() and _LETTER.match(x[-2]):
                    return True
            elif x[-2:-1] in _SMALL and p + 1 < len(self.full) and self.lines[self.full[p + 1]][0] in _SMALL:
                return True
        return False

    def signs(self) -> bool:
        """Whether the text has any sign of a scan."""
        return self.likely or "á" in self.text or bool(_ODD.search(self.text))

    def _cut(self, i: int) -> bool:
        """Whether the line stands in the middle of a sentence."""
        p = self.place[i]
        if p == 0 or p == len(self.full) - 1:
            return False
        a, b = self.lines[self.full[p - 1]], self.lines[self.full[p + 1]]
        return b[0].islower() and a[-1] not in _STOPS and bool(LATIN.search(a))

    def _beside(self, i: int, known: set[int]) -> bool:
        """Whether it stands at an end of the text or beside furniture that is known."""
        p = self.place[i]
        return p == 0 or p == len(self.full) - 1 or self.full[p - 1] in known or self.full[p + 1] in known

    def pages(self, got: list[tuple[int, int | None]]) -> tuple:
        """Features of the parts into which the places divide the text: whether they reach its
        ends, how long the parts are and how even, and how the places stand."""
        at = [self.place[i] for i, _ in got]
        gaps = [b - a for a, b in zip(at, at[1:], strict=False)]
        before, after = at[0], len(self.full) - 1 - at[-1]
        mid = sorted(gaps)[len(gaps) // 2]
        x = self.lines[got[0][0]]
        return (
            (before == 0) + (after == 0), min(len(at), 12), min(min(gaps), 60), round(min(5.0, max(gaps) / min(gaps)), 1), round(min(3.0, max(before, after) / mid), 1), round(min(3.0, min(before, after) / mid), 1),
            round(sum(self._cut(i) for i, _ in got) / len(got), 1), round(sum(self._alone(i) for i, _ in got) / len(got), 1), min(len(x), 100) // 5, x[0].islower(), any(n is not None for _, n in got),
        )

    def _alone(self, i: int) -> bool:
        return i > 0 and not self.lines[i - 1] or i + 1 < len(self.lines) and not self.lines[i + 1]

    def forms(self, good: set[int]) -> list[list[tuple[int, int | None]]]:
        """Places of the lines that come back, the page number they may hold taken off. Forms that
        come back are held against each other and every other line, and single lines at breaks
        against each other."""
        keys: dict[str, list[tuple[int, int | None]]] = {}
        for i in self.full:
            x = self.lines[i]
            if len(x) < 6 or i in good or (x[1] == ")" or not x[0].isalpha()) and _LIST.match(x):
                continue
            n = None
            if "  " in x or not x.isprintable():  # as all white space but a blank is not
                m = x[-1] in _NUMERIC and TAIL.match(x) or x[0] in _NUMERIC and HEAD.match(x)
                n = _value(m["n"]) if m else None
                x = " ".join((m["rest"] if m and n is not None else x).split())
            if n is None and x[-1] in ".!?,;…":
                continue
            keys.setdefault(x.casefold(), []).append((i, n))
        merged, single, loose = _Forms(), [], _Forms()
        for k in sorted((k for k, at in keys.items() if len(at) > 1), key=lambda k: -len(keys[k])):
            home = merged.find(k, len(keys[k]))
            if home is not None:
                home.extend(keys[k])
            else:
                merged.add(k, keys[k])
        for k, at in keys.items():
            if len(at) > 1:
                continue
            home = merged.find(k)
            if home is not None:
                home.extend(at)
            elif self._beside(at[0][0], good) or not good and (self._cut(at[0][0]) or self._alone(at[0][0])):
                single.append(k)
        for k in single:
            home = loose.find(k)
            if home is not None:
                home.extend(keys[k])
            else:
                loose.add(k, keys[k])
        return [sorted(got) for _, got in merged.groups + loose.groups if len(got) > 1]

    def candidates(self, good: set[int]) -> list[tuple[int, list[tuple[int, int | None]]]]:
        """(kind, places): of page numbers by their form, then of lines that come back."""
        return [(1 + _KINDS.index(k), got) for k, got in self.by.items()] + [(0, got) for got in self.forms(good)]

    def pairs(self, kind: int, got: list[tuple[int, int | None]], known: set[int]) -> list[tuple]:
        """(place, next place, features) for each place but the last; one alone is its own next."""
        two = list(zip(got, got[1:], strict=False)) or [(got[0], got[0])]
        steps = [b[1] is not None and a[1] is not None and b[1] - a[1] == 1 for a, b in two]
        share = round(sum(steps) / len(steps), 1)
        gaps = [b[0] - a[0] for a, b in two]
        mid = float(sorted(gaps)[len(gaps) // 2]) or 1.0
        even = round(min(3.0, max(gaps) / max(1, min(gaps))), 1)
        out = []
        paged = any(i in known for i, _ in got) or bool(known)
        for a, b, s in ((x, y, z) for (x, y), z in zip(two, steps, strict=True)):
            i, j = a[0], b[0]
            x = self.lines[i]
            out.append((a, b, (
                kind, 2 if s else 1 if a[1] is not None else 0, share, min(len(got), 12), min(j - i, 60), round(min(3.0, (j - i) / mid), 1), even,
                self._beside(i, known) + self._beside(j, known), self._cut(i) + self._cut(j), self._alone(i) + self._alone(j), paged, self.likely,
                min(len(x), 100) // 5, x[0].islower(), x[-1] in ".!?,;:…", self.place[i] == 0 or self.place[j] == len(self.full) - 1, any(k in known for k in range(i, j)),
            )))
        return out

    def joins(self, furniture: set[int]) -> list[tuple[int, int, tuple]]:
        """(line, next body line, features) of the lines whose last word is broken by its look."""
        out = []
        widest = min(120, max((len(self.lines[i]) for i in self.full), default=0)) if self.ended else 0
        for p in self.ended:
            i = self.full[p]
            x = self.lines[i]
            if i in furniture or not BROKEN.search(x):
                continue
            p += 1
            while p < len(self.full) and self.full[p] in furniture:
                p += 1
            if p == len(self.full):
                break
            j = self.full[p]
            y = self.lines[j]
            first = re.match(r"[^\W_]+", y)
            part = len(x) - len(x.rstrip(HYPHENS))
            tail = re.search(r"[^\W_]*$", x[:-part])
            word = first[0] if first else ""
            out.append((i, j, (
                HYPHENS.index(x[-1]), y[0].islower(), word in KEEPS, min(len(word), 12), min(len(tail[0]) if tail else 0, 12), min(j - i, 8), self.likely,
                round(len(x) / max(1, widest), 1), len(word) == len(y), first is None, any(k in furniture for k in range(i, j)),
            )))
        return out


def analyse(text: str, scanned: bool = False, classifiers: tuple | None = None) -> Page:
    """Furniture and broken words by the classifiers of pairs: a form is furniture if its pairs
    are on the whole; a line that is found makes its neighbours likelier, until nothing changes."""
    if classifiers is None:
        from textverk.llm.p3_simulate import models

        classifiers = models()
    furniture_odds, join_odds, page_odds = classifiers
    scan = Scan(text, scanned)
    out = Page(scan.lines)
    if not scan.full:
        return out

    def holds(kind: int, got: list, known: set[int]) -> bool:
        odds = [furniture_odds(x) for _, _, x in scan.pairs(kind, got, known)]
        return sum(odds) > 0

    good: set[int] = set()
    for _ in range(2):  # a page number that counts up speaks for those of other forms
        good = {i for k, got in scan.by.items() if holds(1 + _KINDS.index(k), got, good) for i, _ in got}
    heads: set[int] = set()
    left = scan.forms(good)
    if left and not good and not scan.signs():  # then the lines must divide the text as pages would
        left = [got for got in left if page_odds(scan.pages(got)) > 0]
    while True:
        new = [got for got in left if holds(0, got, good | heads)]
        if not new:
            break
        heads.update(i for got in new for i, _ in got)
        left = [got for got in left if got not in new]
    furniture = good | heads
    out.hyphen = [(i + 1, j + 1) for i, j, x in scan.joins(furniture) if join_odds(x) > 0]
    out.pageno = sorted(i + 1 for i in good)
    out.header = sorted(i + 1 for i in heads - good)
    out.scanned = scanned or bool(good) or bool(out.hyphen) or bool(out.header)
    return out


WORD = re.compile(r"[^\W_]+")
_LONG = re.compile(r"[^\W_]{3,}")


def page_part(line: str) -> str:
    """The first part of the word that is broken at the end of the line."""
    x = line.rstrip(HYPHENS)
    k = len(x)
    while k and (x[k - 1].isalnum()):
        k -= 1
    return x[k:]


def body_words(page: Page) -> list[tuple[int, str, int]]:
    """(line, word, line of its second part or 0) of the body; broken words are put together."""
    skip = {*page.pageno, *page.header}
    goes = dict(page.hyphen)
    joined_at = {j: i for i, j in page.hyphen}
    out: list[tuple[int, str, int]] = []
    for k, x in enumerate(page.lines, 1):
        if k in skip or not x:
            continue
        words = WORD.findall(x)
        if k in joined_at and words:
            words = words[1:]  # it was counted with the line it began on
        if k in goes and words:
            nxt = WORD.match(page.lines[goes[k] - 1])
            if nxt:
                out.append((k, words[-1] + nxt[0], goes[k]))
                words = words[:-1]
        out += [(k, w, 0) for w in words]
    return out


def long_words(page: Page) -> tuple[list[str], list[int], list[int], list[tuple[int, int, int]]]:
    """Those of the ``body_words`` that have three characters or more and are not digits only, in
    lower case; the lines they begin on and how many each has; and of each that was put together
    its index, the line of its second part and the length of its first."""
    skip = {*page.pageno, *page.header}
    goes = dict(page.hyphen)
    seconds = set(goes.values())
    words: list[str] = []
    at: list[int] = []
    count: list[int] = []
    parts: list[tuple[int, int, int]] = []
    for k, x in enumerate(page.lines, 1):
        if not x or k in skip:
            continue
        if k in goes or k in seconds:
            got = WORD.findall(x)
            if k in seconds:
                got = got[1:]  # it was counted with the line it began on
            nxt = WORD.match(page.lines[goes[k] - 1]) if k in goes and got else None
            if nxt:
                got.insert(0, got.pop() + nxt[0])
                if len(got[0]) > 2 and not got[0].isdigit():
                    parts.append((len(words), goes[k], len(page_part(x))))
            got = [w.lower() for w in got if len(w) > 2 and not w.isdigit()]
        elif x.isascii() or not ("İ" in x or "Σ" in x):  # what these become depends on more than themselves
            got = [w for w in _LONG.findall(x.lower()) if not w.isdigit()]
        else:
            got = [w.lower() for w in _LONG.findall(x) if not w.isdigit()]
        if got:
            words += got
            at.append(k)
            count.append(len(got))
    return words, at, count, parts
