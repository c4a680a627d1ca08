"""Persistence of terms once present."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _n(label: str):
    return F.sum(F.when(F.col("transition") == label, 1).otherwise(0))


def rates(transitions: DataFrame, *keys: str, min_entities: int = 1, low: int = 3) -> DataFrame:
    """Pairs that began present, how many stayed, and the rate, by the given keys."""
    g = transitions.filter("present_from = 1").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_entities_t0"), _n("persist").alias("n_entities_persist"), _n("dropout").alias("n_entities_dropout"))
    g = g.filter(F.col("n_entities_t0") >= min_entities)
    return g.withColumn("persistence_rate", F.col("n_entities_persist") / F.col("n_entities_t0")).withColumn("flag_low_n", F.col("n_entities_t0") < low)


def overall(transitions: DataFrame) -> DataFrame:
    """Counts and rate by actor and of all ('all')."""
    g = transitions.groupingSets([["actor"], []], "actor").agg(_n("persist").alias("persist"), _n("dropout").alias("dropout"), _n("adopt").alias("adopt"), F.count(F.lit(1)).alias("n"), F.grouping("actor").alias("g"))
    return g.select(F.when(F.col("g") == 1, "all").otherwise(F.coalesce("actor", F.lit("unknown"))).alias("actor"), "persist", "dropout", "adopt", "n", F.try_divide("persist", F.col("persist") + F.col("dropout")).alias("rate"))


def jaccard_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("jaccard").alias("mean"), F.median("jaccard").alias("median"), F.stddev_samp("jaccard").alias("std"), F.count(F.lit(1)).alias("n"))


def by_entity_then_actor(transitions: DataFrame) -> DataFrame:
    """Mean over entity pairs of their own persistence, by actor."""
    one = transitions.filter("present_from = 1").groupBy("actor", "entity", "wave_pair").agg(F.avg((F.col("transition") == "persist").cast("double")).alias("rate"))
    return one.groupBy("actor").agg(F.avg("rate").alias("mean_rate"), F.count(F.lit(1)).alias("n_pairs"))


def heatmap(transitions: DataFrame, pairs: list[str], min_cell: int = 3, min_entities: int = 10, pair: str = "wave_pair") -> DataFrame:
    """Rates by term (rows) and pair (columns); cells of too few are empty."""
    cells = rates(transitions, "term", pair, min_entities=min_cell).filter(F.col(pair).isin(*pairs))
    keep = cells.groupBy("term").agg(F.sum("n_entities_t0").alias("t")).filter(F.col("t") >= min_entities).select("term")
    wide = cells.join(keep, "term", "left_semi").groupBy("term").pivot(pair, pairs).agg(F.first("persistence_rate"))
    return wide.select("term", *(F.col(f"`{p}`").alias(p.replace("→", "_")) for p in pairs))


def ranking(transitions: DataFrame, label: str, top: int = 20) -> DataFrame:
    """Terms most often given up or taken up."""
    return transitions.filter(F.col("transition") == label).groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(top)


def ranking_by_actor(transitions: DataFrame, label: str, top: int = 20) -> DataFrame:
    """The same terms' counts by actor."""
    best = ranking(transitions, label, top).select("term")
    hits = transitions.filter(F.col("transition") == label).groupBy("term", "actor").agg(F.count(F.lit(1)).alias("n"))
    return hits.join(F.broadcast(best), "term", "left_semi")  # ``top`` rows


def direct_heatmap(cells: dict[str, DataFrame], min_cell: int = 3, min_entities: int = 10) -> DataFrame:
    """Rates by term and pair of waves that are compared directly; ``cells`` is pair to direct
    transitions."""
    x = None
    for pair, t in cells.items():
        y = t.withColumn("wave_pair", F.lit(pair))
        x = y if x is None else x.unionByName(y)
    return heatmap(x, list(cells), min_cell, min_entities)
