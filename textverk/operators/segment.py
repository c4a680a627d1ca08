"""Words of sentences, their lemmas and content words, and the categories they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textverk.session import small

# Word, or a run of signs: both are tokens, blanks separate them
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s\p{Z}\x{85}\x{0B}\x{1C}-\x{1F}]+"
TOKEN_SQL = TOKEN
# Swedish function words left out: fixed values
STOPWORDS = [
    "alla", "allt", "alltså", "andra", "att", "av", "blev", "bli", "blir", "blivit", "de", "dem", "den", "denna", "deras", "dess", "dessa", "det", "detta", "dig", "din",
    "dina", "ditt", "du", "där", "då", "efter", "ej", "eller", "en", "er", "era", "ert", "ett", "från", "för", "ha", "hade", "han", "hans", "har", "henne", "hennes", "hon",
    "honom", "hur", "här", "i", "icke", "ingen", "inom", "inte", "jag", "ju", "kan", "kunde", "man", "med", "mellan", "men", "mig", "min", "mina", "mitt", "mot", "mycket",
    "ni", "nu", "när", "någon", "något", "några", "och", "om", "oss", "på", "samma", "sedan", "sig", "sin", "sina", "sitt", "själv", "skulle", "som", "så", "sådan", "sådana",
    "sådant", "till", "under", "upp", "ut", "utan", "vad", "var", "vara", "varför", "varit", "varje", "vars", "vart", "vem", "vi", "vid", "vilka", "vilkas", "vilken", "vilket",
    "vår", "våra", "vårt", "än", "är", "åt", "över",
]


def tokens(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, i (from 1), surface: words and runs of signs, in order."""
    return df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))).alias("i", "surface")).withColumn("i", F.col("i") + 1)


def lemmatised(tokens_: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Adds ``lemma`` by a table (surface, lemma); a word that is not in it is its own lemma."""
    table = lemmas.select(F.lower("surface").alias("_s"), F.lower("lemma").alias("_l")).groupBy("_s").agg(F.min("_l").alias("_l"))
    return tokens_.join(small(table), F.lower("surface") == F.col("_s"), "left").withColumn("lemma", F.coalesce("_l", F.lower("surface"))).drop("_s", "_l")


def stopwords(extra: list[str] | None = None, path: str | None = None) -> list[str]:
    """The default stopwords, more of them, and those of a file with one word a line; a file
    that is missing is an error."""
    out = [*STOPWORDS, *(extra or [])]
    if path:
        with open(path, encoding="utf-8") as f:
            out += [w.strip() for w in f if w.strip()]
    return list(dict.fromkeys(w.lower() for w in out))


def punctuation(token: Column) -> Column:
    return token.rlike(r"^[^\p{L}\p{M}\p{N}_\s]+$")


def content(tokens_: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """Tokens that are no punctuation and neither whose lemma nor whose form is a stopword."""
    stop = STOPWORDS if stop is None else stop
    return tokens_.filter(~punctuation(F.col("surface")) & ~F.col("lemma").isin(stop) & ~F.lower("surface").isin(stop))


def lemma_sentences(tokens_: DataFrame, *keys: str) -> DataFrame:
    """keys, lemmas joined by blanks in order, and their number, of the content words. Rows that
    are repeated as they are count once."""
    one = content(tokens_).select(*keys, "i", "lemma").distinct()
    g = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "lemma"))).alias("a"))
    return g.select(*keys, F.array_join(F.transform("a", lambda x: x["lemma"]), " ").alias("lemmas"), F.size("a").alias("word_count"))


def sentence_terms(tokens_: DataFrame, lexicon: DataFrame, *keys: str) -> DataFrame:
    """keys, target_terms (in order, repeats kept) and categories (a sorted set) of the sentences
    that hold a term of lexicon(category, term).

    The lexicon is folded to one row a term first, so a term in two categories does not double
    the tokens; it is hash-joined to the words. Nothing but the hits is shuffled.
    """
    of = lexicon.groupBy("term").agg(F.collect_set("category").alias("cats"))
    hit = tokens_.select(*keys, "i", F.col("lemma").alias("term")).join(small(of), "term").distinct()
    g = hit.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "term"))).alias("a"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("cats")))).alias("categories"))
    return g.select(*keys, F.transform("a", lambda x: x["term"]).alias("target_terms"), "categories")


def category_pairs(sentences: DataFrame) -> DataFrame:
    """One row for every category of a sentence."""
    return sentences.withColumn("category", F.explode("categories")).drop("categories")


def unique_sentences(pairs: DataFrame, *keys: str) -> DataFrame:
    """One row a sentence again, with its categories and their number."""
    g = pairs.groupBy(*keys).agg(F.array_sort(F.collect_set("category")).alias("c"))
    return g.select(*keys, F.array_join("c", ",").alias("all_categories"), F.size("c").alias("n_categories"))
