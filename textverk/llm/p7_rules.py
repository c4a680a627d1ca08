"""Boundary rules as a finite transducer over the text of one row.

States: ENDED (what comes next begins a sentence), INSIDE (a sentence goes on), LOST (the
text before is missing), and one state for each open quotation mark. ``step`` runs the
transducer over one text from a state and gives the starts and the state after it; a row,
or a chunk of rows, is thus a function from states to states, and functions compose.
"""

from __future__ import annotations

import re
import unicodedata

ENDED, INSIDE, LOST = 0, 1, 2
OPENERS = "”»\"“„«'"  # states 3 and up: an open quotation of this kind
STATES = 3 + len(OPENERS)
CLOSERS = {"”": "”", "»": "»«", '"': '"', "“": "”", "„": "“”", "«": "»", "'": "'"}

# Abbreviations after which a sentence goes on, whatever follows: fixed values
GOES_ON = frozenset(
    "t.ex s.k f.d bl.a fr.o.m t.o.m p.g.a m.a.o dvs d.v.s inkl exkl enl resp jfr nr kl kap sid s ca c:a cirka tfn tel fig tab avd st ung ev "
    "e.g i.e cf sect no nos approx vs dr mr mrs ms prof st dept fig vol pp p ch ks esim mm klo nro ns tri z d.h u.a ggf evtl bzw vgl usw.v nr abs art str hr fr bsp inkl".split()
)
# Abbreviations that close a sentence if a new one can begin after them: fixed values
CLOSES = frozenset("m.m etc osv m.fl o.s.v o.d e.d usw jne ym yms a.m p.m tkr mkr".split())
MONTHS = frozenset(
    "januar februar märz april mai juni juli august september oktober november dezember "
    "januari februari mars maj augusti oktober december january february march may june july october".split()
)
_EVENT = re.compile(r"[.!?…]+|[。！？।؟]|[”»\"“„«']|(?<=[฀-๿A-Za-zÀ-ɏ]) +(?=[฀-๿A-Za-zÀ-ɏ])")
_THAI = re.compile(r"[฀-๿]")
_WORD_BEFORE = re.compile(r"[^\s(\[”»\"“„«]+$")
_NUMBER_START = re.compile(r"\d+(?:[.,:]\d+)*\s*(?:[,;)%”]|[^\W\d_])")


def _upper(c: str) -> bool:
    return c.isupper() or c.istitle()


def _can_start(text: str, at: int) -> bool:
    """Whether a sentence can begin with the character at ``at``."""
    c = text[at]
    if c.isalpha():
        return not c.islower()  # letters of scripts without case can
    if c.isdigit():
        return True
    if c in OPENERS or c in "‘(¿¡–—-":
        k = at + 1
        while k < len(text) and text[k] in " ”»\"“„«'‘(":
            k += 1
        return k < len(text) and _can_start(text, k) if k < len(text) else c in OPENERS
    return unicodedata.category(c)[0] == "L"


def _opens(text: str, i: int) -> bool:
    """Whether the mark at ``i`` stands where a quotation opens."""
    if i + 1 >= len(text) or text[i + 1].isspace():
        return False
    if text[i] in "„":
        return True
    before = text[i - 1] if i else " "
    return before.isspace() or before in "([：:，,。！？”“" and not (text[i] == "”" and before in "。！？，")


def _abbreviation(text: str, i: int) -> str | None:
    """'on' if the full stop at ``i`` belongs to an abbreviation that never ends a sentence,
    'close' if to one that can end it, else None."""
    m = _WORD_BEFORE.search(text, max(0, i - 24), i)
    if not m:
        return None
    w = m[0].lower()
    if w in CLOSES:
        return "close"
    if w in GOES_ON or m[0] in ("No", "Nr", "St"):
        return "on" if w not in ("no", "st", "mm", "art", "str", "ms", "hr", "fr", "tri", "ns", "ch", "p", "ev", "mr") or m[0][0].isupper() or len(w) <= 1 else None
    if len(w) == 1 and w.isalpha() and m[0].isascii():
        return "on"
    if "." in w and all(len(x) <= 2 for x in w.split(".")) and w.replace(".", "").isalpha():
        return "on"
    return None


def _ordinal(text: str, i: int) -> bool:
    """Whether the full stop at ``i`` makes a number a day of the month."""
    m = re.search(r"(\S+)\s+(\d{1,2})$", text[max(0, i - 24) : i])
    if not m:
        return False
    rest = text[i + 1 :].split(maxsplit=1)
    if rest:
        return rest[0].strip(".,").lower() in MONTHS and rest[0][0].isupper() or rest[0][0].islower()
    return m[1] in ("Am", "am", "Vom", "vom", "Bis", "bis", "Zum", "zum", "Seit", "seit", "Ab", "ab")


def step(text: str, state: int) -> tuple[list[int], int]:
    """0-based starts in the text, and the state after it."""
    starts: list[int] = []
    n = len(text)
    first = 0
    while first < n and text[first].isspace():
        first += 1
    if first == n:
        return starts, state
    quote = OPENERS[state - 3] if state >= 3 else ""
    thai = _THAI.search(text) is not None
    pos = first
    if state in (ENDED, LOST) and _can_start(text, first):
        ok = True
        if state == LOST:
            word = re.match(r"[^\s.,]+", text[first:])
            if text[first].isdigit():
                ok = _NUMBER_START.match(text, first) is None
            elif word and (word[0].lower() in MONTHS and word[0] not in ("Mai",) or word[0].startswith("S:t") or re.match(r"[A-ZÅÄÖ]\.\s", text[first:])):
                ok = False
            if ok and (q := _unmatched(text)):
                ok, quote = False, q
        elif thai and text[first].isdigit():
            ok = False
        if ok:
            starts.append(first)
    elif state == LOST and (q := _unmatched(text)):
        quote = q
    state = INSIDE
    while True:
        m = _EVENT.search(text, pos)
        if m is None:
            break
        i, e = m.start(), m.end()
        c = text[i]
        pos = e
        if quote:
            if c in OPENERS or c in "”“»«":
                if c in CLOSERS[quote] and not (c == quote and _opens(text, i) and i and text[i - 1].isspace()):
                    quote = ""
                    ended = i > 0 and (text[i - 1] in ".!?…。！？।؟")
                    nxt = e
                    while nxt < n and text[nxt].isspace():
                        nxt += 1
                    if nxt == n:
                        state = ENDED if ended else INSIDE
                        return starts, state
                    if ended and text[nxt] not in ",;:.–—-)" and _can_start(text, nxt) and (nxt > e or not text[nxt].isascii()):
                        starts.append(nxt)
                        pos = nxt + 1 if text[nxt] not in OPENERS else nxt
                elif c == quote:  # opened again: the first was never closed
                    if i and text[i - 1].isspace() and _ended_before(text, i):
                        starts.append(i)
            continue
        if c in OPENERS:
            if _opens(text, i):
                quote = c
            continue
        if c == " ":
            if thai and (_THAI.match(text[i - 1]) or _THAI.match(text[e])):
                starts.append(e)
            continue
        # a terminator; closing marks and brackets belong to the sentence
        k = e
        while k < n and text[k] in "”»\"’')]“«" and not (text[k] in OPENERS and _opens(text, k)):
            k += 1
        nxt = k
        while nxt < n and text[nxt].isspace():
            nxt += 1
        wide = c in "。！？।؟"
        if c == "." and e - i == 1:
            kind = _abbreviation(text, i)
            if kind == "on" and nxt < n and text[nxt].isupper() and text[i - 1].islower() and not (i > 1 and (text[i - 2].isalpha() or text[i - 2] == ".")) and text[nxt + 1 : nxt + 2] != ".":
                kind = None  # a unit or letter at the end of a sentence
            if kind == "on" or text[i - 1 : i].isdigit() and _ordinal(text, i):
                if nxt == n:
                    return starts, INSIDE
                continue
            if kind == "close" and nxt < n and not (text[nxt].isupper() or text[nxt] in OPENERS):
                continue
        if nxt == n:
            return starts, ENDED
        if (nxt > k or wide) and _can_start(text, nxt):
            starts.append(nxt)
            pos = nxt
    if quote:
        return starts, 3 + OPENERS.index(quote)
    return starts, ENDED if thai and not text.rstrip()[-1].isdigit() else INSIDE


def _ended_before(text: str, i: int) -> bool:
    return text[:i].rstrip()[-1:] in tuple(".!?…。！？।؟")


def _unmatched(text: str) -> str:
    """The kind of quotation that closes in the text before any opens; '' if none does."""
    for m in re.finditer(r"[”»\"“„«]", text):
        i = m.start()
        if _opens(text, i):
            return ""
        if i and not text[i - 1].isspace() and text[i] in "”»\"“":
            return {"”": "”", "»": "»", '"': '"', "“": "„"}[text[i]]
    return ""
