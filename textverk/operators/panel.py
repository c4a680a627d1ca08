"""Entities followed over waves: the panel, transitions and set similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_per_wave(docs: DataFrame, *, last: bool = True, tie: str = "file") -> DataFrame:
    """One document per (entity, wave): the latest year. Of equal years the last file by name,
    or with ``last=False`` the first. Rows without entity or wave are left out."""
    order = [F.desc_nulls_last("year"), F.desc(tie) if last else F.asc(tie)]
    w = W.partitionBy("entity", "wave").orderBy(*order)
    return docs.filter("entity IS NOT NULL AND wave IS NOT NULL").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def build_panel(docs: DataFrame) -> DataFrame:
    """Latest documents of the entities that have at least two waves."""
    one = latest_per_wave(docs)
    keep = one.groupBy("entity").agg(F.countDistinct("wave").alias("n")).filter("n >= 2").select("entity")
    return one.join(keep, "entity", "left_semi")


def _label(a, b):
    return F.when((a == 1) & (b == 1), "persist").when((a == 1) & (b == 0), "dropout").when((a == 0) & (b == 1), "adopt").otherwise("stable_absent")


def wave_transitions(long: DataFrame) -> DataFrame:
    """Each term between consecutive waves an entity has; the long form of a panel is dense,
    so absence is a row. One window, no self-join."""
    x = long.withColumn("p", (F.col("n") > 0).cast("int"))
    w = W.partitionBy("entity", "term").orderBy("wave")
    first = F.first("actor").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    y = x.select("entity", first.alias("actor"), "term", F.col("wave").alias("wave_from"), F.lead("wave").over(w).alias("wave_to"), F.col("p").alias("present_from"), F.lead("p").over(w).alias("present_to"))
    y = y.filter("wave_to IS NOT NULL").withColumn("wave_pair", F.concat(F.lit("W"), "wave_from", F.lit("→W"), "wave_to"))
    return y.withColumn("transition", _label(F.col("present_from"), F.col("present_to")))


def direct_transitions(long: DataFrame, wave_from: int, wave_to: int) -> DataFrame:
    """Between two given waves, for the entities that have both."""
    x = long.withColumn("p", (F.col("n") > 0).cast("int"))
    a = x.filter(F.col("wave") == wave_from).select("entity", "term", "actor", F.col("p").alias("present_from"))
    b = x.filter(F.col("wave") == wave_to).select("entity", "term", F.col("p").alias("present_to"))
    return a.join(b, ["entity", "term"]).withColumn("transition", _label(F.col("present_from"), F.col("present_to")))


def year_transitions(long: DataFrame, tie: str = "file") -> DataFrame:
    """Between consecutive documents of an entity by year; several in one year are kept."""
    x = long.filter("year IS NOT NULL AND entity IS NOT NULL").withColumn("p", (F.col("n") > 0).cast("int"))
    w = W.partitionBy("entity", "term").orderBy("year", tie)
    y = x.select("entity", "actor", "term", F.col("year").alias("year_from"), F.lead("year").over(w).alias("year_to"), F.col("p").alias("present_from"), F.lead("p").over(w).alias("present_to"))
    y = y.filter("year_to IS NOT NULL").withColumn("year_pair", F.concat("year_from", F.lit("→"), "year_to"))
    return y.withColumn("transition", _label(F.col("present_from"), F.col("present_to")))


def jaccard(transitions: DataFrame) -> DataFrame:
    """Similarity of an entity's term sets in consecutive waves; 0 if both are empty."""
    a, b = F.col("present_from"), F.col("present_to")
    g = transitions.groupBy("entity", "actor", "wave_from", "wave_to", "wave_pair").agg(
        F.sum(a).alias("n_terms_t"), F.sum(b).alias("n_terms_t1"), F.sum(a * b).alias("n_intersection"), F.sum(F.greatest(a, b)).alias("n_union")
    )
    return g.withColumn("jaccard", F.coalesce(F.try_divide("n_intersection", "n_union"), F.lit(0.0)))
