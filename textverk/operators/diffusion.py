"""First appearances of terms and how they spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_appearance(long: DataFrame) -> DataFrame:
    """Per entity and term the first year with the term; left-censored if that is the entity's
    first document. The actor is that of the entity's earliest document."""
    x = long.filter("year IS NOT NULL AND entity IS NOT NULL")
    ent = x.groupBy("entity").agg(F.min("year").alias("y0"), F.min_by("actor", F.struct("year", "file")).alias("actor"))
    g = x.filter("n > 0").groupBy("entity", "term").agg(F.min("year").alias("first_year"))
    return g.join(ent, "entity").select("entity", "actor", "term", "first_year", (F.col("first_year") == F.col("y0")).alias("is_left_censored"))


def _entities(long: DataFrame) -> DataFrame:
    x = long.filter("year IS NOT NULL AND entity IS NOT NULL")
    return x.groupBy("entity").agg(F.min_by("actor", F.struct("year", "file")).alias("actor"))


def adoption_curves(long: DataFrame) -> DataFrame:
    """Cumulated adopters by term and year, of all and by actor, over the slice's entities."""
    fa = first_appearance(long)
    both = fa.select("term", "first_year", F.explode(F.array(F.lit("all"), F.coalesce("actor", F.lit("unknown")))).alias("actor"))
    total = _entities(long).select(F.explode(F.array(F.lit("all"), F.coalesce("actor", F.lit("unknown")))).alias("actor")).groupBy("actor").agg(F.count(F.lit(1)).alias("total_entities"))
    years = long.filter("year IS NOT NULL").select("year").distinct()
    new = both.groupBy("actor", "term", F.col("first_year").alias("year")).agg(F.count(F.lit(1)).alias("k"))
    grid = new.select("actor", "term").distinct().crossJoin(F.broadcast(years))  # a few dozen years
    w = W.partitionBy("actor", "term").orderBy("year").rowsBetween(W.unboundedPreceding, 0)
    x = grid.join(new, ["actor", "term", "year"], "left").withColumn("cumulative_count", F.sum(F.coalesce("k", F.lit(0))).over(w))
    return x.join(total, "actor").select("term", "actor", "year", "cumulative_count", "total_entities", (F.col("cumulative_count") / F.col("total_entities")).alias("cumulative_fraction"))


def spikes(long: DataFrame, threshold: float = 0.15) -> DataFrame:
    total = _entities(long).agg(F.count(F.lit(1)).alias("total_entities"))
    g = first_appearance(long).groupBy("term", F.col("first_year").alias("year")).agg(F.count(F.lit(1)).alias("new_adopters"))
    x = g.crossJoin(F.broadcast(total)).withColumn("adoption_fraction", F.col("new_adopters") / F.col("total_entities"))
    return x.withColumn("is_spike", F.col("adoption_fraction") >= threshold)


def gini(first: DataFrame, value: str = "first_year", key: str = "term", least: int = 2) -> DataFrame:
    """Gini coefficient, mean and population standard deviation of the values of each key.

    Equal values are counted first, so a key's window has a row a distinct value, not a row an
    entity; m equal values that follow c smaller ones have the ranks c + 1 to c + m."""
    v = F.col("v").cast("double")
    per = first.groupBy(key, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("m")).filter("v IS NOT NULL")
    before = F.coalesce(F.sum("m").over(W.partitionBy(key).orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    x = per.withColumn("ranks", F.col("m") * before + F.col("m") * (F.col("m") + 1) / 2)
    g = x.groupBy(key).agg(F.sum("m").alias("n_entities"), F.sum(F.col("m") * v).alias("s"), F.sum(F.col("ranks") * v).alias("si"), F.sum(F.col("m") * v * v).alias("sq"))
    n, s = F.col("n_entities"), F.col("s")
    mean = s / n
    value_ = F.coalesce(F.try_divide(2 * F.col("si") - (n + 1) * s, n * s), F.lit(0.0))
    return g.filter(n >= least).select(key, value_.alias("gini"), "n_entities", mean.alias("mean_year"), F.sqrt(F.greatest(F.col("sq") / n - mean * mean, F.lit(0.0))).alias("std_year"))


def lead_lag(first: DataFrame, base: str = "kommun", others: tuple[tuple[str, str], ...] = (("länsstyrelse", "lansstyrelse"), ("MCF", "MCF"))) -> DataFrame:
    """Median first year by actor and the base's lag to each other actor."""
    actors = [(base, base), *others]
    aggs = [x for a, s in actors for x in (F.median(F.when(F.col("actor") == a, F.col("first_year"))).alias(f"median_{s}"), F.count(F.when(F.col("actor") == a, 1)).alias(f"n_{s}"))]
    g = first.groupBy("term").agg(*aggs)
    return g.select("*", *((F.col(f"median_{base}") - F.col(f"median_{s}")).alias(f"lag_{base}_vs_{s}") for _, s in others))


def lag_summary(ll: DataFrame, lag: str) -> DataFrame:
    x = F.col(lag)
    return ll.agg(F.avg(x).alias("mean_lag"), F.count(F.when(x > 0, 1)).alias("later"), F.count(F.when(x < 0, 1)).alias("earlier"), F.count(F.when(x == 0, 1)).alias("same"))
