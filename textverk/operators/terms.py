"""Term counts and what is added up from them.

The canonical form is long: file, actor, entity, year, wave, term, n. A wide matrix is
only a scan or a sink.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textverk.session import small

WORD = r"^(?U)\w+$"
META = ("file", "actor", "entity", "year", "wave")


def melt(wide: DataFrame, meta: tuple[str, ...] = META) -> DataFrame:
    """Every column that is no metadata is a term; ``wave`` never is one."""
    terms = [c for c in wide.columns if c not in meta]
    return wide.unpivot([c for c in meta if c in wide.columns], terms, "term", "n")


def spread_wide(long: DataFrame, terms: list[str], meta: tuple[str, ...] = META) -> DataFrame:
    return long.groupBy(*meta).pivot("term", terms).agg(F.sum("n")).na.fill(0, terms)


def whole_word(term: str) -> str:
    return r"(?U)\b\Q" + term.lower() + r"\E\b"


def count_by_pattern(text: Column, term: str) -> Column:
    """Occurrences of a term as a whole word or phrase, not overlapping, ignoring case. A plain
    search for the letters spares most texts the pattern."""
    low = F.lower(text)
    return F.when(low.contains(term.lower()), F.regexp_count(low, F.lit(whole_word(term)))).otherwise(F.lit(0)).cast("long")


def count_by_patterns(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """key, term, n > 0 by one pattern a term, all in one pass; ``count_terms`` is the plan for
    many terms, this one its check. The text is put into lower case once, and only the terms
    whose letters it holds are looked up by pattern."""
    known = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(t.lower()).alias("low"), F.lit(whole_word(t)).alias("pattern")) for t in terms))

    def hits(low: Column) -> Column:
        held = F.filter(known, lambda p: low.contains(p["low"]))
        return F.transform(held, lambda p: F.struct(p["term"].alias("term"), F.regexp_count(low, p["pattern"]).cast("long").alias("n")))

    found = F.transform(F.array(F.lower(text)), hits)[0]  # the lambda's variable is evaluated once
    return docs.filter(F.col(text).isNotNull()).select(key, F.explode(found).alias("p")).select(key, "p.term", "p.n").filter("n > 0")


def count_terms(docs: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """key, term, n > 0 for all terms of lexicon(term).

    Terms of one word are counted set-at-a-time: each text is cut into words once and joined
    with the terms, so the cost does not grow with their number. Phrases and hyphenated terms
    are looked up by pattern, all in one pass over the text.
    """
    terms = lexicon.select("term").distinct()
    phrases = [r["term"] for r in terms.filter(~F.col("term").rlike(WORD)).collect()]  # of a lexicon, not of data
    low = docs.select(key, F.lower(text).alias("_t")).filter(F.col("_t").isNotNull())
    words = low.select(key, F.explode(F.split("_t", r"[^\p{L}\p{N}_]+")).alias("_w"))
    single = small(terms.filter(F.col("term").rlike(WORD)).withColumn("_w", F.lower("term")))
    out = words.join(single, "_w").groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    if phrases:
        more = count_by_patterns(low, key, "_t", phrases)
        out = out.unionByName(more.groupBy(key, "term").agg(F.sum("n").alias("n")))
    return out


def category_sums(long: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Sums by file and category; a term in two categories counts in both."""
    keys = [c for c in META if c in long.columns]
    return long.join(small(lexicon.select("category", "term")), "term").groupBy(*keys, "category").agg(F.sum("n").alias("n"))


def wide_category_sums(wide: DataFrame, lexicon: list[tuple[str, str]]) -> DataFrame:
    """The same sums from a wide matrix: the columns of a category are added up in the row, and
    only the categories are unpivoted, so rows do not multiply by the number of terms."""
    of: dict[str, list[str]] = {}
    for category, term in lexicon:
        if term in wide.columns and term not in META:
            of.setdefault(category, []).append(term)
    keys = [c for c in META if c in wide.columns]
    sums = wide.select(*keys, *(sum((F.coalesce(F.col(f"`{t}`"), F.lit(0)) for t in ts), F.lit(0)).cast("long").alias(c) for c, ts in of.items()))
    return sums.unpivot(keys, list(of), "category", "n")


def totals(sums: DataFrame) -> DataFrame:
    """Category totals by actor and of all actors ('all') in one pass."""
    g = sums.select("actor", "category", "n").groupingSets([["actor", "category"], ["category"]], "actor", "category").agg(F.sum("n").alias("n"), F.grouping("actor").alias("g"))
    return g.select(F.when(F.col("g") == 1, "all").otherwise(F.coalesce("actor", F.lit("unknown"))).alias("actor"), "category", "n")


def sparsity(long: DataFrame) -> DataFrame:
    x = long.agg(F.countDistinct("term").alias("terms"), F.countDistinct("file").alias("files"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("nonzero"))
    return x.withColumn("sparsity", 1 - F.try_divide("nonzero", F.col("terms") * F.col("files")))


def repeated_terms(lexicon: DataFrame) -> DataFrame:
    """(term, categories) of the terms that stand in more than one category."""
    return lexicon.groupBy("term").agg(F.countDistinct("category").alias("n"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories")).filter("n > 1")


def lemmatise_lexicon(lexicon: DataFrame, lemmas: DataFrame) -> DataFrame:
    """category, lemma, ord, originals: terms replaced by lemma, in order of first sight."""
    x = lexicon.join(small(lemmas.select("surface", "lemma")), lexicon["term"] == F.col("surface"), "left").withColumn("lemma", F.coalesce("lemma", "term"))
    return x.groupBy("category", "lemma").agg(F.min("ord").alias("ord"), F.array_join(F.array_sort(F.collect_set("term")), ",").alias("originals"))


def all_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols)
