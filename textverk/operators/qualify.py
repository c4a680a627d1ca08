"""Context windows around a concept's words and the level they are given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textverk.functions.lexicon import LEVELS, TARGETS
from textverk.functions.text import without_boilerplate


def window_pattern(targets: list[str]) -> str:
    return r"(?iU)(?:(\S+)\s+){0,4}\b(" + "|".join(targets) + r")\b(?:\s+(\S+)){0,9}"


def contexts(docs: DataFrame, key: str, text: str, concept: str) -> DataFrame:
    """key, k, target, before, middle, after: matches do not overlap, so a target within nine
    words of the last one is part of its window. The target's place is the first occurrence of
    its letters in the window."""
    p = F.lit(window_pattern(TARGETS[concept]))
    t = without_boilerplate(F.col(text))
    some = t.rlike(r"(?iU)\b(?:" + "|".join(TARGETS[concept]) + r")\b")  # spares the others the costly pattern
    x = docs.filter(F.col(text).isNotNull() & some).select(key, F.posexplode(F.regexp_extract_all(t, p, F.lit(0))).alias("k", "match"))
    x = x.withColumn("target", F.regexp_extract("match", window_pattern(TARGETS[concept]), 2))  # of the short window; the text is gone through once
    at = F.instr(F.lower("match"), F.lower("target"))
    words = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    left, right = words(F.substr("match", F.lit(1), at - 1)), words(F.substr("match", at + F.length("target")))
    n = F.size(left)
    return x.select(
        key, "k", "match", "target",
        F.array_join(F.slice(left, F.greatest(n - 3, F.lit(1)), 4), " ").alias("before"),
        F.array_join(F.slice(right, 1, 5), " ").alias("middle"),
        F.array_join(F.slice(right, 6, 4), " ").alias("after"),
    )


def _hit(section: Column, quals: list[tuple[str, str]]) -> Column:
    """The first qualifier that the section holds, as struct(qualifier, level)."""
    known = F.array(*(F.struct(F.lit(q).alias("qualifier"), F.lit(v).alias("level")) for q, v in quals))
    return F.get(F.filter(known, lambda q: section.contains(q["qualifier"])), F.lit(0))


def qualify(ctx: DataFrame, concept: str) -> DataFrame:
    """Adds qualifier and level: a stated difficulty to judge first, then the sections in order,
    the longest qualifier first within each; UNKNOWN where there is none."""
    level_of = {q: level for level, qs in LEVELS[concept].items() for q in qs}  # a later one wins
    flat = [q for qs in LEVELS[concept].values() for q in qs]
    order = sorted(dict.fromkeys(flat), key=lambda q: -len(q))
    quals = [(q, level_of[q]) for q in order]
    low = [F.lower(c) for c in ("before", "middle", "after")]
    whole = F.concat_ws(" ", *low)
    found = F.coalesce(*(_hit(s, quals) for s in low), F.struct(F.lit(None).cast("string").alias("qualifier"), F.lit("UNKNOWN").alias("level")))
    if concept != "sannolikhet":
        hard = whole.rlike(r"(?U)svår\w*") & whole.rlike(r"(?U)bedöm\w*")
        found = F.when(hard, F.struct(F.lit("svårt att bedöma").alias("qualifier"), F.lit("uncertainty").alias("level"))).otherwise(found)
    return ctx.withColumn("q", found).select("*", "q.qualifier", "q.level").drop("q")


SCALE = ["very_low", "low", "medium", "high", "very_high"]  # levels of severity, in order
OTHER = ["change", "uncertainty", "acceptability"]


def levels_of(docs: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """key, keep..., concept, level, n: how often each concept is given each level in a document."""
    src = docs.select(F.struct(key, *keep).alias("_doc"), text)
    parts = [qualify(contexts(src, "_doc", text, c), c).select("_doc", F.lit(c).alias("concept"), "level") for c in TARGETS]
    x = parts[0]
    for y in parts[1:]:
        x = x.unionByName(y)
    return x.groupBy("_doc", "concept", "level").agg(F.count(F.lit(1)).alias("n")).select("_doc.*", "concept", "level", "n")


def level_totals(levels: DataFrame) -> DataFrame:
    """Sums by concept and level, of all actors ('all') and of each."""
    g = levels.groupingSets([["actor", "concept", "level"], ["concept", "level"]], "actor", "concept", "level").agg(F.sum("n").alias("n"), F.grouping("actor").alias("g"))
    return g.select(F.when(F.col("g") == 1, "all").otherwise(F.coalesce("actor", F.lit("unknown"))).alias("actor"), "concept", "level", "n")


def severity_shares(levels: DataFrame) -> DataFrame:
    """Per cent of each of the five levels of severity within an actor and concept."""
    g = levels.filter(F.col("level").isin(SCALE)).groupBy("actor", "concept", "level").agg(F.sum("n").alias("n"))
    t = g.groupBy("actor", "concept").agg(F.sum("n").alias("t"))
    on = F.expr("a.actor <=> b.actor AND a.concept = b.concept")
    return g.alias("a").join(F.broadcast(t.alias("b")), on).select("a.actor", "a.concept", "a.level", "a.n", (100 * F.col("a.n") / F.col("b.t")).alias("share"))  # actors and three concepts


def other_rates(levels: DataFrame, docs: DataFrame) -> DataFrame:
    """Change, uncertainty and acceptability per document of an actor, documents without any included."""
    n = docs.groupBy("actor").agg(F.count(F.lit(1)).alias("docs"))
    g = levels.filter(F.col("level").isin(OTHER)).groupBy("actor", "concept", "level").agg(F.sum("n").alias("n"))
    return g.alias("a").join(F.broadcast(n.alias("b")), F.expr("a.actor <=> b.actor")).select("a.actor", "a.concept", "a.level", "a.n", "b.docs", (F.col("a.n") / F.col("b.docs")).alias("rate"))  # a row an actor
