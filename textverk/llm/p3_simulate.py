"""Simulated scans whose furniture and broken words are known, and the classifiers fitted on them.

Texts are random words in sentences, set in lines and pages as a scanner would give them:
headers and footers with and without numbers, page numbers of every form, words broken at
line ends; and beside them what only looks so: headings and notices that come back, numbered
lists, words that keep their own hyphen. The features tell nothing of the words, so nothing
depends on a language. Fitted once a process, on PAGES texts; and on as many again that are no
scans, some of them lists, for the lines that come back in a text without other signs of one.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np

from textverk.llm.boost import Boosted

PAGES = 500  # simulated texts that the classifiers are fitted on
ROUNDS = 30


class Quick:
    """A boosted model for one row at a time; what it gave for a row is kept."""

    def __init__(self, model: Boosted) -> None:
        self.base, self.trees, self.seen = model.base, [], {}
        for feature, cut, value in model.trees:
            at = [float(model.edges[f][c]) if f >= 0 and c < len(model.edges[f]) else float("inf") for f, c in zip(feature.tolist(), cut.tolist(), strict=True)]
            self.trees.append((feature.tolist(), at, value.tolist()))

    def __getstate__(self) -> dict:
        return {"base": self.base, "trees": self.trees, "seen": {}}

    def __call__(self, x: tuple) -> float:
        """Logarithm of the odds."""
        got = self.seen.get(x)
        if got is None:
            got = self.base
            for feature, at, value in self.trees:
                k = 0
                while feature[k] >= 0:
                    k = 2 * k + 1 if x[feature[k]] < at[k] else 2 * k + 2
                got += value[k]
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[x] = got
        return got


_SYLLABLES = "ba be bi da de du fa fo ga gå ha he ka ko kå la li lo ma me må na no nå ra re ro sa se si sta ta ti to va ve vå".split()


def _roman(n: int) -> str:
    return "x" * (n // 10) + ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")[n % 10]


_FORMS = (
    lambda n, m: f"Sida {n}", lambda n, m: f"Sida {n} av {m}", lambda n, m: f"sid. {n}/{m}", lambda n, m: f"p. {n}", lambda n, m: f"{n} ({m})", lambda n, m: f"{n}/{m}", lambda n, m: f"{n} av {m}",
    lambda n, m: f"- {n} -", lambda n, m: f"– {n} –", lambda n, m: f"[{n}]", lambda n, m: f"{n}", lambda n, m: _roman(n),
)


class _Writer:
    def __init__(self, rng: random.Random) -> None:
        self.rng = rng

    def word(self) -> str:
        return "".join(self.rng.choices(_SYLLABLES, k=self.rng.randrange(1, 6)))

    def sentence(self) -> list[str]:
        w = [self.word() for _ in range(self.rng.randrange(4, 18))]
        w = [x + "," if self.rng.random() < 0.08 else x for x in w]
        return [w[0].capitalize(), *w[1:-1], w[-1] + self.rng.choice([".", ".", ".", "!", "?"])]

    def title(self) -> str:
        t = " ".join([self.word().capitalize(), *(self.word() if self.rng.random() < 0.6 else self.word().capitalize() for _ in range(self.rng.randrange(0, 5)))])
        return t + self.rng.choice(["", "", " | ", " – "]) + self.rng.choice(["", self.word().capitalize(), str(self.rng.randrange(2006, 2025))])

    def blurred(self, s: str) -> str:
        """Up to two characters misread."""
        out = list(s)
        for _ in range(self.rng.randrange(1, 3)):
            k = int(self.rng.randrange(len(out)))
            if out[k].isalpha():
                out[k] = str(self.rng.choice(list("ceo1l5tf")))
        return "".join(out)


def text(rng: random.Random) -> tuple[list[str], list[str], dict[int, int], bool]:
    """Lines, what each is ('', header, pageno), of each broken line the one that goes on, and
    whether it is a scan."""
    w = _Writer(rng)
    scan = rng.random() < 0.7
    width, per = int(rng.randrange(45, 95)), int(rng.randrange(4, 40))
    pages = int(rng.randrange(1, 9)) if scan else 1
    hyphens = str(rng.choice(list("--¬‐­"))) if scan and rng.random() < 0.7 else ""
    rate = rng.uniform(0.05, 0.5)
    head = w.title() if scan and pages > 1 and rng.random() < 0.7 else ""
    foot = w.title() if scan and pages > 1 and rng.random() < 0.25 else ""
    numbered = bool(head) and rng.random() < 0.3
    form = rng.choice(_FORMS) if scan and rng.random() < 0.7 else None
    top, airy, start = rng.random() < 0.3, rng.random() < 0.6, int(rng.randrange(1, 60)) if rng.random() < 0.3 else 1
    again = [w.title() + rng.choice(["", "", f" {rng.randrange(2, 99)}"]) for _ in range(rng.randrange(1, 3))] if rng.random() < 0.45 else []
    inside = rng.random() < (0.2 if scan else 0.7)  # such lines stand in the text without a blank line
    table = rng.random() < 0.2
    notice = " ".join(w.sentence()) if rng.random() < 0.3 else ""
    counts = rng.random() < (0.03 if scan else 0.25)
    pool = [w.sentence() for _ in range(rng.randrange(3, 9))] if rng.random() < 0.4 else []  # a text of few phrases comes back by itself

    lines: list[str] = []
    kind: list[str] = []
    goes: dict[int, int] = {}
    waiting: list[int] = []  # a broken line whose other part is still to come

    def put(s: str, what: str = "") -> None:
        if not what and s and waiting:
            goes[waiting.pop()] = len(lines)
        lines.append(s)
        kind.append(what)

    words: list[str] = []
    body, p, left = 0, 0, int(rng.randrange(6, per * max(pages, 1) + 7))
    number = 0

    def edge(upper: bool) -> None:
        n = start + p
        items = []
        if head and upper:
            h = w.blurred(head) if rng.random() < 0.15 else head
            items.append((f"{h}   {n}" if numbered else h, "header"))
        if foot and not upper:
            items.append((foot, "header"))
        if form and upper == top:
            items.append((form(n, start + pages), "pageno"))
        if airy and items and not upper:
            put("")
        for s, what in items:
            put(s, what)
        if airy and items and upper:
            put("")

    if pages > 1 or form:
        edge(True)
    while left > 0:
        here = per if pages > 1 else left
        for _ in range(min(here, left)):
            left -= 1
            body += 1
            r = rng.random()
            if again and inside and r > 0.96 and not waiting:
                put(rng.choice(again))
                continue
            if table and r > 0.92 and not waiting:
                gap = " " * rng.randrange(2, 6)
                for _ in range(rng.randrange(3, 12)):
                    put(gap.join([w.word().capitalize() if rng.random() < 0.7 else str(rng.randrange(10, 999)), *(rng.choice(["x", "-", "hög", "låg", f"{rng.randrange(99)} %", str(rng.randrange(10, 9999))]) for _ in range(rng.randrange(1, 5)))]) + rng.choice(["", "", gap]))
                continue
            if not words and r < 0.12 and not waiting:
                put("")
                if again and rng.random() < 0.6:
                    put(str(rng.choice(again)))
                elif counts:
                    number += 1
                    put(str(number))
                elif notice and rng.random() < 0.6:
                    put(notice[:width])
                elif rng.random() < 0.3:
                    for _ in range(rng.randrange(2, 5)):
                        put(f"– {' '.join(w.sentence()[:4])}")
                    put("")
                continue
            line, size = [], 0
            while True:
                if not words:
                    words = list(rng.choice(pool)) if pool and rng.random() < 0.7 else w.sentence()
                x = words[0]
                if size + len(x) > width:
                    break
                line.append(words.pop(0))
                size += len(x) + 1
                if not words and rng.random() < 0.15:
                    break
            x = words[0] if words else ""
            if hyphens and len(x) > 5 and x.isalpha() and rng.random() < rate:
                cut = int(rng.randrange(2, len(x) - 2))
                put(" ".join([*line, x[:cut] + hyphens]))
                waiting.append(len(lines) - 1)
                words[0] = x[cut:] if hyphens == "-" or rng.random() > 0.05 else str(rng.choice(["and", "eller", "or"]))
            elif x and x.islower() and rng.random() < 0.06:
                put(" ".join([*line, w.word() + "-"]))  # a word with its own hyphen
                words.insert(0, str(rng.choice(["och", "eller", "samt", "and", "oder"])))
            else:
                put(" ".join(line))
        p += 1
        if pages > 1 or form:
            edge(False)
            if left > 0:
                edge(True)
    if waiting:
        lines[waiting[0]] = lines[waiting[0]].rstrip(hyphens)
    return lines, kind, goes, scan


def plain(rng: random.Random) -> list[str]:
    """Lines of a text of any length that is no scan: notices come back in it wherever it may be,
    or it is a list some of whose entries do."""
    w = _Writer(rng)
    if rng.random() < 0.2:
        entries = [w.title() for _ in range(rng.randrange(4, 25))]
        return [rng.choice(entries) for _ in range(rng.randrange(5, 40))]
    width, words, lines = rng.randrange(45, 95), [], []
    for _ in range(rng.choice([rng.randrange(2, 12), rng.randrange(12, 110)])):
        line: list[str] = []
        while sum(map(len, line)) + len(line) < width:
            words = words or w.sentence()
            line.append(words.pop(0))
        lines.append(" ".join(line))
        if not words and rng.random() < 0.4:
            lines.append("")
    for _ in range(rng.randrange(1, 3)):
        notice = w.title() + rng.choice(["", f" {rng.randrange(2, 99)}"])
        for _ in range(rng.randrange(2, 6)):
            lines.insert(rng.randrange(len(lines) + 1), notice)
    return lines


@cache
def models(seed: int = 3) -> tuple[Quick, Quick, Quick]:
    """(furniture, join, pages): classifiers of pairs of lines and of all places of a line."""
    from textverk.llm.p3_pages import Scan

    rng = random.Random(seed)
    fx, fy, jx, jy, px, py = [], [], [], [], [], []
    for _ in range(PAGES):
        lines, kind, goes, scanned = text(rng)
        likely = scanned if rng.random() < 0.9 else not scanned  # it is not always known
        scan = Scan("\n".join(lines), likely)
        body = {i for i, k in enumerate(kind) if not k}
        known: set[int] = set()
        for first in (True, False):  # without and with the page numbers at hand, as in the search
            for c, got in scan.candidates(known):
                for (i, _), (j, _), x in scan.pairs(c, got, known):
                    fx.append(x)
                    fy.append(float(bool(kind[i]) and bool(kind[j])))
                if c == 0 and first:
                    px.append(scan.pages(got))
                    py.append(float(sum(kind[i] == "header" for i, _ in got) > len(got) / 2))
            known = {i for i, k in enumerate(kind) if k == "pageno"}
        for i, j, x in scan.joins({i for i, k in enumerate(kind) if k}):
            jx.append(x)
            jy.append(float(i in body and goes.get(i) == j))
    others = random.Random(seed + 1)
    for _ in range(PAGES):  # a text without other signs is seldom a scan
        scan = Scan("\n".join(plain(others)), False)
        for got in scan.forms(set()):
            px.append(scan.pages(got))
            py.append(0.0)
    return tuple(Quick(Boosted(rounds=ROUNDS).fit(np.array(x, dtype=float), np.array(y))) for x, y in ((fx, fy), (jx, jy), (px, py)))
