"""Tests of independence and effect sizes on counted tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textverk.functions.chi2 import p_value
from textverk.session import stored


def independence(counts: DataFrame, group: str, category: str, n: str = "n") -> DataFrame:
    """Chi-square tests of every pair of groups over the categories, one row a pair.

    Categories that are empty in both groups are dropped; fewer than two left give no test.
    With one degree of freedom Yates' correction applies.
    """
    c = counts.groupBy(F.col(group).alias("g"), F.col(category).alias("c")).agg(F.sum(n).cast("double").alias("n"))
    groups = c.select("g").distinct()
    pairs = groups.select(F.col("g").alias("a")).join(groups.select(F.col("g").alias("b")), F.col("a") < F.col("b"))
    x = pairs.join(c, (F.col("g") == F.col("a")) | (F.col("g") == F.col("b")))
    grid = x.groupBy("a", "b", "c").agg(F.sum(F.when(F.col("g") == F.col("a"), F.col("n")).otherwise(0.0)).alias("x"), F.sum(F.when(F.col("g") == F.col("b"), F.col("n")).otherwise(0.0)).alias("y")).filter("x + y > 0")
    w = W.partitionBy("a", "b")
    t = grid.select("a", "b", "x", "y", F.sum("x").over(w).alias("sx"), F.sum("y").over(w).alias("sy"), F.count(F.lit(1)).over(w).alias("k")).filter("k >= 2 AND sx > 0 AND sy > 0")
    total = F.col("sx") + F.col("sy")

    def part(o: str, s: str) -> Column:
        e = (F.col("x") + F.col("y")) * F.col(s) / total
        gap = F.abs(F.col(o) - e)
        gap = F.when(F.col("k") == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        return gap * gap / e

    g = t.groupBy("a", "b").agg(F.sum(part("x", "sx") + part("y", "sy")).alias("chi2"), (F.first("k") - 1).cast("int").alias("dof"), F.first(total).alias("total"))
    m = g.agg(F.count(F.lit(1)).alias("m"))
    g = g.crossJoin(F.broadcast(m)).withColumn("p", p_value(F.col("chi2"), F.col("dof")))
    return g.select("a", "b", "chi2", "dof", "total", "p", F.least(F.col("p") * F.col("m"), F.lit(1.0)).alias("p_bonferroni"), F.sqrt(F.col("chi2") / F.col("total")).alias("cramers_v"))


def effect_label(v: Column) -> Column:
    return F.when(v < 0.1, "negligible").when(v < 0.3, "weak").when(v < 0.5, "moderate").when(v.isNotNull(), "strong")


def cooccurrence(flags: DataFrame, names: list[str]) -> DataFrame:
    """2x2 counts, Yates-corrected chi-square, Cramer's V and expected ratio of every pair of
    flags; one pass over the rows for all pairs. Degenerate tables are left out."""
    return pair_sweep(flags, list(combinations(names, 2)))


def pair_sweep(flags: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The same for the given pairs: of two effects, an effect and an actor, or two actors."""
    names = list(dict.fromkeys(x for p in pairs for x in p))
    sums = [F.sum(F.col(a).cast("long")).alias(f"s_{a}") for a in names] + [F.sum((F.col(a) & F.col(b)).cast("long")).alias(f"b_{a}_{b}") for a, b in pairs]
    one = flags.agg(F.count(F.lit(1)).alias("n"), *sums)
    rows = F.array(*(F.struct(F.lit(a).alias("concept1"), F.lit(b).alias("concept2"), F.col("n"), F.col(f"s_{a}").alias("s1"), F.col(f"s_{b}").alias("s2"), F.col(f"b_{a}_{b}").alias("n_both")) for a, b in pairs))
    x = one.select(F.explode(rows).alias("r")).select("r.*").filter("s1 > 0 AND s2 > 0 AND s1 < n AND s2 < n")
    return pair_tests(x)


def pair_tests(x: DataFrame) -> DataFrame:
    """Adds the tests to rows of n, s1, s2 (marginals) and n_both."""
    x = x.withColumn("n_c1_only", F.col("s1") - F.col("n_both")).withColumn("n_c2_only", F.col("s2") - F.col("n_both")).withColumn("n_neither", F.col("n") - F.col("s1") - F.col("s2") + F.col("n_both"))
    n, s1, s2 = (F.col(c).cast("double") for c in ("n", "s1", "s2"))
    e = s1 * s2 / n
    gap = F.abs(F.col("n_both") - e)
    gap = gap - F.least(F.lit(0.5), gap)
    chi2 = gap * gap * (1 / e + n / (s1 * (n - s2)) + n / (s2 * (n - s1)) + n / ((n - s1) * (n - s2)))
    x = x.withColumn("chi2", chi2).withColumn("cramers_v", F.sqrt(F.col("chi2") / n))
    return x.withColumn("expected_both", e).withColumn("ratio", F.try_divide("n_both", e)).withColumn("effect_strength", effect_label(F.col("cramers_v")))


def enrichment(rows: DataFrame, cluster: str, value: str, top: int = 20) -> DataFrame:
    """How much more often a value is met in a cluster than overall; noise (-1) is left out."""
    x = rows.groupBy(F.col(cluster).alias("cluster"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    c, v = W.partitionBy("cluster"), W.partitionBy("value")
    x = x.crossJoin(F.broadcast(x.agg(F.sum("n").alias("all"))))  # one row
    x = x.select("cluster", "value", "n", (F.col("n") / F.sum("n").over(c)).alias("observed"), (F.sum("n").over(v) / F.col("all")).alias("expected"))
    x = x.filter("cluster != -1").withColumn("enrichment", F.try_divide("observed", "expected"))
    return x.withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("enrichment"), "value"))).filter(F.col("r") <= top).drop("r")


BLOCK = 512  # points of a group that are compared at once


def silhouette(points: DataFrame, vector: str, label: str, group: str | None = None) -> DataFrame:
    """Mean Euclidean silhouette and number of points, of all or of each group.

    By its definition it compares all pairs of a group. The points lie in random blocks, pairs of
    blocks give each point's sum of distances to every cluster, and these are added up; so a task
    holds two blocks whatever the size of the group. Points alone in their cluster have 0.
    """
    p = points.select((F.col(group) if group else F.lit(0)).alias("g"), F.struct(F.col(label).alias("c"), F.col(vector).cast("array<double>").alias("v")).alias("p"))
    kind = p.schema["p"].dataType["c"].dataType.simpleString()
    g_kind = p.schema["g"].dataType.simpleString()
    p = stored(p, "silhouette-points")
    n = p.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    p = p.join(n, "g").select("g", "p", F.floor(F.rand(7) * F.col("blocks")).alias("b"))
    x = stored(p.groupBy("g", "b").agg(F.collect_list("p").alias("p")).select("g", "b", "p.c", "p.v"), "silhouette-blocks")
    y = x.select("g", F.col("b").alias("b2"), F.col("c").alias("d"), F.col("v").alias("w"))
    pairs = x.select("g", "b").join(y.select("g", "b2"), "g").join(x, ["g", "b"]).join(y, ["g", "b2"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                v, w, d = np.stack(r.v), np.stack(r.w), np.asarray(r.d)
                dist = np.sqrt(sum((v[:, [k]] - w[:, k]) ** 2 for k in range(v.shape[1])))
                for c in np.unique(d):
                    yield pd.DataFrame({"g": r.g, "b": r.b, "i": np.arange(len(v)), "c": r.c, "d": c, "s": dist[:, d == c].sum(axis=1)})

    sums = pairs.select("g", "b", "c", "v", "d", "w").mapInPandas(run, f"g {g_kind}, b long, i long, c {kind}, d {kind}, s double").groupBy("g", "b", "i", "c", "d").agg(F.sum("s").alias("s"))
    sizes = x.select("g", F.explode("c").alias("d")).groupBy("g", "d").agg(F.count(F.lit(1)).alias("n"))
    own = F.col("c") == F.col("d")
    m = F.try_divide(F.col("s"), F.col("n") - own.cast("int"))
    a = sums.join(sizes, ["g", "d"]).groupBy("g", "b", "i").agg(F.min(F.when(own, m)).alias("a"), F.min(F.when(~own, m)).alias("z"))
    s = F.when(F.col("a").isNull() | F.col("z").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("z") - F.col("a"), F.greatest("a", "z")), F.lit(0.0)))
    out = a.groupBy("g").agg(F.avg(s).alias("silhouette"), F.count(F.lit(1)).alias("n"))
    return out.withColumnRenamed("g", group) if group else out.drop("g")


def cluster_summary(rows: DataFrame, cluster: str, category: str, year: str, place: str, top: int = 5) -> DataFrame:
    """A row a cluster: size, share, dominant category, documents by year, trend and the top
    places; noise (-1) is left out. Ties go to the first by name. Every count is an aggregate by
    (cluster, value), so no cluster is gathered."""
    x = rows.select(F.col(cluster).alias("cluster"), F.col(category).alias("category"), F.col(year).alias("year"), F.col(place).alias("place"))
    n = x.agg(F.count(F.lit(1)).alias("all"))

    def counts(c: str) -> DataFrame:
        return x.filter(F.col(c).isNotNull()).groupBy("cluster", c).agg(F.count(F.lit(1)).alias("n"))

    size = x.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    first = lambda c: W.partitionBy("cluster").orderBy(F.desc("n"), c)
    main = counts("category").withColumn("r", F.row_number().over(first("category"))).filter("r = 1").select("cluster", F.col("category").alias("dominant"))
    y = counts("year").groupBy("cluster").agg(F.max_by("n", "year").alias("last"), F.min_by("n", "year").alias("first"), F.array_sort(F.collect_list(F.struct("year", "n"))).alias("y"))
    best = counts("place").withColumn("r", F.row_number().over(first("place"))).filter(F.col("r") <= top).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("r", "place"))).alias("p"))
    out = size.crossJoin(F.broadcast(n)).join(main, "cluster", "left").join(y, "cluster", "left").join(best, "cluster", "left").filter("cluster != -1")
    return out.select(
        "cluster", "size", (100 * F.col("size") / F.col("all")).alias("size_pct"), "dominant", F.array_join(F.transform("y", lambda s: F.concat_ws(":", s["year"], s["n"])), ",").alias("years"),
        F.when(F.col("last") > F.col("first"), "Increasing").otherwise("Decreasing").alias("trend"), F.array_join(F.transform("p", lambda s: s["place"]), ",").alias("top_places"),
    )
