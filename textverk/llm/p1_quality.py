"""Per-document statistics that tell prose from lists, tables and junk.

One pass gives each text's statistics. Quantile sketches (KLL, mergeable) of every statistic
are built per language and merged into one of all languages; values become percentiles and
robust z-scores against them. A text is named (``no_prose``) if its share of characters in
complete sentences lies in the lower tail and under its cut. The cut is one half, and for a
text that lies in the tails of two or more of the other statistics the upper end of the gap
that the sketch of all shares shows around one half: there, where next to no text lies, the
share alone does not tell. The sketches are a few rows whatever the size of the corpus.

Cases: null and blank texts have no row; a language that can't be told is 'und' and is only
held against all languages; equal values share a percentile; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textverk.llm.p1_prose import _TAIL, _WORD, _solid, complete_chars
from textverk.sources.tables import spread

# Common words by which a language is told: fixed values
COMMON = {
    "sv": "och att det som på är av för med till den har inte om ett han men var jag sig från vi så kan när år under också efter eller nu sin där vid mot ska skulle kommer ut får finns vara hade alla andra mycket än här då sedan över bara in blir upp även vad få två vill ha många hur mer går sverige detta nya procent skall hennes säger man i en de måste ska inom utan norr inför",
    "en": "the of and to in a is that for it as was with be by on not he i this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no because within after since",
    "fi": "ja on ei se että oli hän olla ovat mutta kun niin kuin tai mitä joka sen sitä tämä vain nyt jo myös kuka aikana jälkeen paikassa sanoi esim klo",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man wer wir",
}
_LANG = {w: k for k in ("de", "fi", "en", "sv") for w in COMMON[k].split()}
_SCRIPTS = tuple((k, re.compile(f"[{a}-{z}]+")) for k, a, z in (("ar", "؀", "ۿ"), ("hi", "ऀ", "ॿ"), ("th", "฀", "๿"), ("zh", "一", "鿿")))
_FAR = re.compile("[\u0590-\U0010ffff]")
STATS = ("n_words", "mean_word_length", "symbol_ratio", "ended_line_share", "common_word_share", "sentence_share")
TABLE = "src string, rec_id long, language string, n_chars long, " + ", ".join(f"{s} double" for s in STATS)


def statistics(text: str) -> tuple:
    words = _WORD.findall(text)
    n = len(words)
    size = sum(map(len, words))
    solid = max(1, len(text) - sum(map(text.count, " \t\n\r ")))
    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    ended = sum(1 for x in lines if x[-1] in ".!?…。！？।؟”»\"" and _TAIL.search(x))
    votes = Counter(map(_LANG.get, _WORD.findall(text.lower())))
    common = n - votes.pop(None, 0)
    lang = max(votes, key=votes.get) if votes and common >= 0.05 * n else "und"
    if not text.isascii():
        others = {k: sum(map(len, p.findall(text))) for k, p in _SCRIPTS} if _FAR.search(text) else {}
        best = max(others, key=others.get) if others else ""
        if best and others[best] >= 0.3 * solid:
            lang = best
    done, total = complete_chars(text)
    symbols = max(0, solid - size - sum(map(text.count, "0123456789")))
    return lang, len(text), float(n), size / n if n else 0.0, symbols / solid, ended / len(lines) if lines else 0.0, common / n if n else 0.0, done / total if total else 0.0


def document_statistics(df: DataFrame) -> DataFrame:
    """(src, rec_id, text) to one row of statistics for each text that is not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            keep = [k for k, t in enumerate(texts) if t and not t.isspace()]
            rows = list(zip(*(statistics(texts[k]) for k in keep), strict=True)) if keep else [()] * (2 + len(STATS))
            at = pa.array(keep, pa.int64())
            cols = [pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), *(pa.array(r, pa.float64()) for r in rows[2:])]
            yield pa.RecordBatch.from_arrays([b.column("src").take(at), b.column("rec_id").take(at), *cols], names=["src", "rec_id", "language", "n_chars", *STATS])

    return spread(df.filter(F.col("text").isNotNull()).select("src", "rec_id", "text"), "rec_id").mapInArrow(run, TABLE)


STEPS = 100  # percentiles are told to the nearest 100 / STEPS
TAIL = 2  # per cent on either side that are a tail
WIDEST = 0.75  # the gap around one half reaches no further up
HALF = 0.5  # a text with less of it in complete sentences is no prose


def profile(stats: DataFrame) -> DataFrame:
    """The quantiles 0, 1/STEPS, ..., 1 of every statistic per language, and of all as '*'.

    A KLL sketch per language is built in one aggregation; the sketches are merged into the
    one of all languages; quantiles are read from both.
    """
    per = stats.groupBy("language").agg(*(F.kll_sketch_agg_double(s).alias(s) for s in STATS))
    whole = per.agg(*(F.kll_merge_agg_double(s).alias(s) for s in STATS)).select(F.lit("*").alias("language"), *STATS)
    grid = [F.array(*(F.kll_sketch_get_quantile_double(F.col(s), F.lit(k / STEPS)) for k in range(STEPS + 1))).alias(s) for s in STATS]
    return per.unionByName(whole).select("language", *grid)


def _percentile(value: Column, sketch: Column) -> Column:
    return F.greatest(F.lit(0), F.size(F.filter(sketch, lambda q: q <= value)) - 1) * F.lit(100.0 / STEPS)


def _z(value: Column, sketch: Column) -> Column:
    """A robust z-score against the upper part of the distribution. The reference is the third
    quartile, but lies above one half; the scale is at most a third of its distance from one
    half. So a share below one half is beyond -3 however large the part of junk is."""
    q = [F.get(sketch, F.lit(round(p * STEPS))) for p in (0.75, 0.95, 0.55)]
    mid = F.greatest(q[0], F.lit(HALF + 0.06))
    scale = F.least(F.greatest((q[1] - q[2]) / F.lit(1.349), F.lit(0.02)), (mid - F.lit(HALF)) / F.lit(3.0))
    return (value - mid) / scale


def _tails(own: dict[str, Column]) -> Column:
    """How many of the other statistics lie in the tail on the side of lists, tables and junk."""
    def at(s: str, p: int) -> Column:
        return F.get(own[s], F.lit(round(p / 100 * STEPS)))

    def low(s: str) -> Column:
        return (F.col(s) <= at(s, TAIL)) & (F.col(s) < at(s, 50))

    def high(s: str) -> Column:
        return (F.col(s) >= at(s, 100 - TAIL)) & (F.col(s) > at(s, 50))

    hits = [high("symbol_ratio"), low("ended_line_share"), low("common_word_share"), low("n_words"), low("mean_word_length") | high("mean_word_length")]
    return sum((F.coalesce(h, F.lit(False)).cast("int") for h in hits), F.lit(0))


def scored(stats: DataFrame, quantiles: DataFrame) -> DataFrame:
    """Adds percentiles within the language, z-scores, the number of other tails, the flag
    ``tail``, the text's ``cut`` and ``no_prose``."""
    sketches = F.broadcast(quantiles)  # a row for each of at most ten languages
    own = sketches.select("language", *(F.col(s).alias(f"own_{s}") for s in STATS))
    every = sketches.filter("language = '*'").select(*(F.col(s).alias(f"all_{s}") for s in STATS))
    x = stats.join(own, "language", "left").crossJoin(F.broadcast(every))
    pct = [_percentile(F.col(s), F.col(f"own_{s}")).alias(f"{s}_pct") for s in STATS]
    # the second quantile above one half: up to there lie less than two per cent of all texts
    upper = F.get(F.filter("all_sentence_share", lambda q: q >= HALF), F.lit(1))
    x = x.select(
        *stats.columns, *pct, _z(F.col("sentence_share"), F.col("own_sentence_share")).alias("z_language"), _z(F.col("sentence_share"), F.col("all_sentence_share")).alias("z_all"),
        _tails({s: F.col(f"own_{s}") for s in STATS}).alias("n_tails"), F.least(F.coalesce(upper, F.lit(HALF)), F.lit(WIDEST)).alias("gap_end"),
    )
    x = x.withColumn("tail", F.least("z_language", "z_all") <= -3.0)
    x = x.withColumn("cut", F.when(F.col("n_tails") >= 2, F.col("gap_end")).otherwise(F.lit(HALF))).drop("gap_end")
    return x.withColumn("no_prose", F.col("tail") & (F.col("sentence_share") < F.col("cut")))
