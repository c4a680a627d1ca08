"""Column functions on text. A null text gives null, counts of null are 0."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textverk.functions.lexicon import BOILERPLATE, NEGATIONS

# Sequences of a wrong decoding and what they were: fixed values. A key that stood twice has
# its last value.
MOJIBAKE = {
    "â€™": "’", "â€œ": "“", "â\u0080\u009d": "”", "â€\"": "—", "â€¢": "•", "â€¦": "…", "â€˜": "‘",
    "Ã¥": "å", "Ã…": "Å", "Ã¤": "ä", "Ã„": "Ä", "Ã¶": "ö", "Ã–": "Ö", "Ã©": "é", "Ã¼": "ü", "â\"‚": "", "â–ª": "",
}
# Lines left by page layout: fixed patterns
ARTIFACTS = (
    r"^\s*\d{1,3}\s*$",
    r"^_{5,}$",
    r"^-{5,}$",
    r"^={5,}$",
    r"^\s*[\x{2500}-\x{257F}]+\s*$",
    r"^\s*\.{5,}\s*$",
    r"^\s*[Rr]isk-?\s*och\s+sårbarhetsanalys\s+.*$",
    r"^\s*\d{1,3}\s*\(\d{1,3}\)\s*$",
    r"^\s*Sida?\s+\d{1,3}\s*\(\d{1,3}\)\s*$",
)
ALPHABET = "abcdefghijklmnopqrstuvwxyzåäöABCDEFGHIJKLMNOPQRSTUVWXYZÅÄÖ0123456789 .,;:!?()-/&%\n\t\"'"
CHAPTER = r"(?iU)(?:^|\n)\s*3[\.\s]\s*identifierade?\s+samhällsviktig[at]?\s+verksamhet(?:er)?(?:\s+\S+){0,6}\s+inom\s+kommunens\s+geografiska\s+område"


def without_boilerplate(text: Column) -> Column:
    for p in BOILERPLATE:
        text = F.regexp_replace(text, "(?iU)" + p, " ")
    return text


def replace_mojibake(text: Column) -> Column:
    for a, b in MOJIBAKE.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def repair_mojibake(text: Column) -> Column:
    """Known sequences replaced; what still holds a lead character goes through one round
    trip of the whole text, and stays as it is where that fails."""

    @F.pandas_udf(T.StringType())
    def trip(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return t if t is None else t.encode("latin-1").decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                return t

        return s.map(one, na_action="ignore")

    fixed = replace_mojibake(text)
    doubtful = fixed.contains("â") | fixed.contains("Ã")
    return F.coalesce(trip(F.when(doubtful, fixed)), fixed)


def mojibake_density(text: Column) -> Column:
    """Sequences per 1000 characters; 0 for ''."""
    n = sum(((F.length(text) - F.length(F.replace(text, F.lit(a), F.lit("")))) / len(a) for a in MOJIBAKE), F.lit(0.0))
    return F.coalesce(F.try_divide(n * 1000, F.length(text)), F.lit(0.0))


def artifact_counts(text: Column) -> tuple[Column, Column]:
    """The text without artifact lines, and how many were removed."""
    n = F.lit(0)
    for p in ARTIFACTS:
        pattern = "(?mUd)" + p
        n = n + F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
        text = F.regexp_replace(text, pattern, "")
    return text, n


def normal_space(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?U)[^\S\n]+", " ")
    text = F.regexp_replace(text, r" +\n", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def trim_to_chapter(text: Column, pattern: str = CHAPTER, guard: float = 0.5) -> Column:
    """struct(text, trimmed, failed): from the line before the heading on, unless the heading is
    missing or lies beyond ``guard`` of the text; a heading at the start counts as failed."""
    at = F.regexp_instr(text, F.lit(pattern))
    # the match begins with the break before the heading, so that line's start is kept too
    head = F.substring_index(F.substr(text, F.lit(1), at - 1), "\n", -1)
    start = at - 1 - F.length(head)
    ok = (at > 0) & (start <= F.length(text) * guard)
    return F.struct(F.when(ok, F.substr(text, start + 1)).otherwise(text).alias("text"), (ok & (start > 0)).alias("trimmed"), (~ok | (start == 0)).alias("failed"))


def naive_sentences(text: Column) -> Column:
    """A plain splitter at . ! ? and blanks: the stand-in for a model where one is not at hand."""
    return F.split(text, r"(?U)(?<=[.!?])\s+")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def alpha_ratio(text: Column) -> Column:
    return F.try_divide(F.length(F.regexp_replace(text, r"[^\p{L}]", "")), F.length(text))


def foreign_ratio(text: Column) -> Column:
    """Share of characters outside the Swedish alphabet and common signs; 0 for ''."""
    inside = "".join("\\" + c if c in "-/&.()?\"'" else c for c in ALPHABET)
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(text, f"[{inside}]", "")), F.length(text)), F.lit(0.0))


def quality_score(retained: Column, short: Column, mojibake: Column, foreign: Column) -> Column:
    raw = 0.4 * F.least(retained, F.lit(1.0)) + 0.2 * (1 - F.least(short, F.lit(1.0))) + 0.2 * F.greatest(1 - mojibake / 10, F.lit(0.0)) + 0.2 * (1 - F.least(foreign, F.lit(1.0)))
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def quality_flag(score: Column) -> Column:
    return F.when(score >= 0.6, "ok").when(score >= 0.3, "low_quality").when(score.isNotNull(), "very_low_quality")


_NEG = r"(?iU)\b(" + "|".join(NEGATIONS) + r")\b"


def negated(text: Column) -> Column:
    return F.coalesce(text.rlike(_NEG), F.lit(False))


def negations(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(_NEG), F.lit(1)), F.array().cast("array<string>"))
