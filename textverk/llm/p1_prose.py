"""How much of a text stands in complete sentences, in any language or layout."""

from __future__ import annotations

import re

from textverk.llm.p4_encoding import SEVEN_BIT, Repair

END = ".!?…。！？।؟"
_TAIL = re.compile(r"[.!?…。！？।؟][”»\"’'“«)\]]*$")
_LAST_END = re.compile(r".*[.!?。！？।؟][”»\"’'“«)\]]*(?=\s|$|[一-鿿“])", re.DOTALL)
_NEXT = re.compile(r"[.!?…][”»\"’'“«)\]]*\s+(?=[A-ZÅÄÖÀ-Þ0-9”»\"“„])")
_LEADER = re.compile(r"[.…·_‥∙•-]{5,}|(?:\. ){4,}|…{2,}")
_ITEM = re.compile(r"^\s*(?:[•·→▪■●○◦*‣⁃–—>-]\s*(?=\S)|\(?\d{1,3}[.)]\s+|\(?[a-zåäö]\)\s+|o\s+(?=[A-ZÅÄÖa-zåäö])|\[[ x]\]\s*)")
_MARKS = frozenset("•·→▪■●○◦*‣⁃–—>-(0123456789abcdefghijklmnopqrstuvwxyzåäö[")
_CELLS = re.compile(r"\t|(?:^|\s)\|(?:\s|$)|\s{2,}(?=\S)|;(?=\S)")
_WORD = re.compile(r"[^\W\d_]+")
_NO_SPACE = re.compile(r"[฀-๿一-鿿぀-ヿ]")
_OTHER = re.compile(r"[\u0600-\u06ff\u0900-\u0dff\u0e00-\u0e7f\u3040-\u30ff\u4e00-\u9fff]")
_LETTER = re.compile(r"[^\W\d_]|[\u0300-\u036f\u064b-\u0652\u0900-\u0903\u093a-\u094f\u0e31-\u0e4e]")
_SEVEN = re.compile(r"[a-z][{}|][a-z]|(?<!\S)[{}|][a-z]")
_THAI = re.compile(r"[฀-๿]")
_WRONG = re.compile(r"Ã|â€|√|à¸|à¤|Ø|Ù|ã€|ï¼|‡|å[\x80-\xbf“”ˆ‰Œ]|�")
_WRONG_SIGNS = ("Ã", "√", "‡", "�", "â€", "à¸", "à¤", "Ø", "Ù", "ã€", "ï¼", "å\x8d", "å\x9c", "å“", "å”")
_LEADERS = ("…", "..", "··", "__", ". .", "--", "••", "‥", "∙∙")
_UTF = (("cp1252", "utf-8"), ("latin-1", "utf-8"), ("mac_roman", "utf-8"))


def unwrong(line: str) -> str:
    """The line with multi-byte text that was read in a one-byte encoding put right."""
    for _ in range(3):
        if not _WRONG.search(line):
            break
        best = line
        for wrong, true in _UTF:
            raw = Repair._encode(line, wrong)
            if raw is not None:
                try:
                    got = raw.decode(true)
                except UnicodeDecodeError:
                    continue
                if len(got) < len(best):
                    best = got
        if best == line:
            # bytes were lost on the way: what is left is read leniently
            raw = line.encode("cp1252", "ignore") if "√" not in line and "‡" not in line else line.encode("mac_roman", "ignore")
            got = raw.decode("utf-8", "ignore")
            return got if len(got) >= len(line) * 0.3 and len(_WORD.findall(got)) >= 1 else line
        line = best
    return line


_VOWEL = re.compile(r"[aeiouyåäöáéüæøàèõδεφ{|}šŒŠ÷?�]", re.IGNORECASE)
_HARD = re.compile(r"[bcdfghjklmnpqrstvwxz]{6}|[qxwz][bcdfghjklmnpqrstvwxz]{2}|[bcdfghjklmnpqrtvwxz][qxzwj][bcdfghjklmnpqrtvwxz]", re.IGNORECASE)
_odd: dict[str, bool] = {}


def _is_odd(w: str) -> bool:
    """Whether a Latin word can't be pronounced or has capitals inside; kept for the words seen."""
    got = _odd.get(w)
    if got is None:
        if len(_odd) > 300_000:
            _odd.clear()
        got = len(w) >= 3 and w[0] < "ɐ" and (not _VOWEL.search(w) or _HARD.search(w) is not None or w.isascii() and w[1:] != w[1:].lower() and w != w.upper())
        _odd[w] = got
    return got


def _wordy(s: str) -> bool:
    """Whether a stretch reads as words: letters prevail, words have vowels and usual lengths."""
    solid = _solid(s)
    if not solid:
        return False
    if not s.isascii() and _OTHER.search(s):  # scripts whose words are not judged by vowels
        return len(_LETTER.findall(s)) >= 0.5 * solid
    words = _WORD.findall(s)
    if len(words) < 2:
        return False
    sizes = list(map(len, words))
    if sum(sizes) + s.count("\u0308") + s.count("\u030a") + s.count("\u0301") < 0.62 * solid or sizes.count(1) > 0.5 * len(words):
        return False
    return sum(map(_is_odd, words)) <= 0.25 * (len(words) - sizes.count(1) - sizes.count(2))


def complete_chars(text: str) -> tuple[int, int]:
    """(characters in complete sentences, all characters), blanks not counted."""
    total = done = 0
    ascii_ = text.isascii()
    if not ascii_ and any(k in text for k in _WRONG_SIGNS):
        text = "\n".join(unwrong(x) for x in text.split("\n"))
    if ("{" in text or "|" in text or "}" in text) and len(_SEVEN.findall(text)) >= 0.01 * len(text):
        text = text.translate(SEVEN_BIT)
    lines = [x.strip() for x in text.split("\n")]
    block: list[str] = []
    carry = 0  # characters of a sentence that had no end before something came between

    def close() -> None:
        nonlocal done, carry
        if not block:
            return
        s = " ".join(block)
        block.clear()
        if not s.isascii() and _THAI.search(s):
            done += _solid(s) if _wordy(s) and len(s) >= 12 else 0
            return
        rest = ""
        if not _TAIL.search(s):
            m = _LAST_END.match(s)
            s, rest = (m[0], s[m.end() :]) if m else ("", s)
        if s and s[0].islower() and not carry:  # what stands before the first full sentence is none
            m = _NEXT.search(s)
            s = s[m.end() :] if m else ""
        if s and _wordy(s) and (len(_WORD.findall(s)) >= 2 or _OTHER.search(s) and len(s) >= 5):
            done += _solid(s) + (carry if s[0].islower() else 0)
        if s:
            carry = 0
        if _solid(rest) >= 15 and len(_WORD.findall(rest)) >= 3:
            carry += _solid(rest)

    widest = max((len(x) for x in lines), default=0)
    before = ""
    for x in lines:
        if not x:
            close()
            before = ""
            continue
        total += _solid(x)
        cells = len(_CELLS.findall(x)) if "  " in x or "\t" in x or "|" in x or ";" in x else 0
        if cells >= 2 and _running(x):
            x = " ".join(x.split())
            cells = 0
        if any(k in x for k in _LEADERS) and _LEADER.search(x) or x[0] in _MARKS and _ITEM.match(x) and not (_TAIL.search(x) and len(x) >= 40 and len(x.split()) >= 6) or cells >= 2 and not (_TAIL.search(x) and cells <= 3 and len(x) > 60) or cells == 1 and "\t" in x:
            close()
            before = ""
            continue
        if block and not (x[0].islower() or len(before) >= max(36, 0.55 * min(widest, 120)) or x[0] in "”»\"“„(" or x[0].isdigit() and len(before) > 30):
            close()
        elif block and _TAIL.search(before) and len(before) < 0.55 * min(widest, 120):
            close()
        block.append(x)
        before = x
    close()
    return done, total


def _running(x: str) -> bool:
    """Whether a line with wide gaps is running text that was only spaced out."""
    words = x.split()
    if len(words) < 5:
        return False
    alpha = [w for w in words if w[0].isalpha()]
    lower = sum(not w[0].isupper() for w in alpha)
    return len(alpha) >= 0.7 * len(words) and lower >= 0.5 * len(words) and sum(len(w) for w in alpha) >= 3.2 * len(alpha)


def _solid(s: str) -> int:
    return len(s) - s.count(" ") - s.count("\t") - s.count(" ")
