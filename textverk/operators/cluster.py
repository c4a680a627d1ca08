"""Clusters of profiles: choice of k, fits, description, transitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textverk.session import small, stored


def _features(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.array(*(F.col(c).cast("double") for c in columns))))


def sweep(df: DataFrame, columns: list[str], ks: range, seeds: tuple[int, ...] = (42, 43, 44)) -> list[dict]:
    """inertia and silhouette by k, the best of several seeds each. Spark's silhouette uses the
    squared distance, so its values are not those of the Euclidean one."""
    x = _features(df, columns).select("features").persist()
    out = []
    ev = ClusteringEvaluator(featuresCol="features", distanceMeasure="squaredEuclidean")
    n = x.count()
    for k in ks:
        if k >= n:
            break
        best = min((KMeans(k=k, seed=s, maxIter=50).fit(x) for s in seeds), key=lambda m: m.summary.trainingCost)
        out.append({"k": k, "inertia": best.summary.trainingCost, "silhouette": ev.evaluate(best.transform(x))})
    x.unpersist()
    return out


def _lloyd(x: np.ndarray, k: int, seed: int) -> tuple[float, np.ndarray]:
    """Inertia and labels of one k-means run from a k-means++ start."""
    rng = np.random.default_rng(seed)
    centre = x[[rng.integers(len(x))]]
    near = ((x - centre[0]) ** 2).sum(axis=1)
    while len(centre) < k and near.sum() > 0:  # fewer than k distinct points give fewer clusters
        centre = np.vstack([centre, x[rng.choice(len(x), p=near / near.sum())]])
        near = np.minimum(near, ((x - centre[-1]) ** 2).sum(axis=1))
    label = None
    for _ in range(300):
        d = np.stack([((x - c) ** 2).sum(axis=1) for c in centre], axis=1)
        old, label = label, d.argmin(axis=1)
        if old is not None and (old == label).all():
            break
        centre = np.stack([x[label == j].mean(axis=0) if (label == j).any() else c for j, c in enumerate(centre)])
    return float(d.min(axis=1).sum()), label


def _squared_silhouette(x: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette of the squared distance, from sums by cluster."""
    names, at = np.unique(label, return_inverse=True)
    if len(names) < 2:
        return 0.0
    x = x - x.mean(axis=0)
    n = np.bincount(at).astype(float)
    mid = np.stack([x[at == j].mean(axis=0) for j in range(len(n))])
    spread = np.array([((x[at == j] - mid[j]) ** 2).sum() for j in range(len(n))])
    total = n * np.stack([((x - m) ** 2).sum(axis=1) for m in mid], axis=1) + spread
    row = np.arange(len(x))
    a = total[row, at] / np.maximum(n[at] - 1, 1)
    mean = total / n
    mean[row, at] = np.inf
    b = mean.min(axis=1)
    top = np.maximum(a, b)
    return float(np.where((n[at] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0).mean())


def _indices(x: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Calinski-Harabasz and Davies-Bouldin; nan where there are fewer than two clusters, or as
    many as points."""
    names, at = np.unique(label, return_inverse=True)
    k, n = len(names), len(x)
    if k < 2 or k >= n:
        return float("nan"), float("nan")
    size = np.bincount(at).astype(float)
    mid = np.stack([x[at == j].mean(axis=0) for j in range(k)])
    off = np.sqrt(((x - mid[at]) ** 2).sum(axis=1))
    within, between = float((off**2).sum()), float((size * ((mid - x.mean(axis=0)) ** 2).sum(axis=1)).sum())
    ch = between / (k - 1) / (within / (n - k)) if within > 0 else 1.0
    far = np.sqrt(((mid[:, None] - mid[None]) ** 2).sum(axis=2))
    spread = np.bincount(at, off) / size
    np.fill_diagonal(far, np.inf)
    far[far == 0] = np.inf
    return ch, float(((spread[:, None] + spread[None]) / far).max(axis=1).mean())


def sweep_groups(df: DataFrame, group: str, columns: list[str], ks: range, seeds: range, least: int = 2) -> DataFrame:
    """group, k, inertia, silhouette (of the squared distance), calinski_harabasz, davies_bouldin
    and best, for each k below the group's size, the best of all seeds. ``best`` marks the first
    k of the greatest silhouette. Groups of fewer than ``least`` rows are skipped. A task is one
    start on the profiles of one group."""
    kind = df.schema[group].dataType.simpleString()
    cols = [group, "k", "seed", "inertia", "silhouette", "calinski_harabasz", "davies_bouldin"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, k, seed = pdf[columns].to_numpy(dtype=float), int(pdf["k"].iloc[0]), int(pdf["seed"].iloc[0])
        if k >= len(x) or len(x) < least:
            return pd.DataFrame({c: pdf[group][:0] if c == group else [] for c in cols})
        x = x[np.lexsort(x.T)]  # runs agree whatever the order of the rows
        inertia, label = _lloyd(x, k, seed)
        return pd.DataFrame([[pdf[group].iloc[0], k, seed, inertia, _squared_silhouette(x, label), *_indices(x, label)]], columns=cols)

    starts = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("seed")) for k in ks for s in seeds))).alias("start")
    schema = f"{group} {kind}, k int, seed int, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double"
    runs = df.select(group, *columns, starts).select(group, *columns, "start.*").groupBy(group, "k", "seed").applyInPandas(run, schema)
    best = runs.groupBy(group, "k").agg(F.min(F.struct("inertia", "seed", "silhouette", "calinski_harabasz", "davies_bouldin")).alias("b"))
    out = best.select(group, "k", "b.inertia", "b.silhouette", "b.calinski_harabasz", "b.davies_bouldin")
    first = F.row_number().over(W.partitionBy(group).orderBy(F.desc("silhouette"), "k"))  # a row a k
    return out.withColumn("best", first == 1)


def indices(points: DataFrame, vector: str, label: str, group: str | None = None) -> DataFrame:
    """k, n, calinski_harabasz and davies_bouldin of all points or of each group, from sums by
    cluster and element: nothing but centroids meets in pairs. Null with fewer than two clusters."""
    g = (F.col(group) if group else F.lit(0)).alias("g")
    p = points.filter(F.col(vector).isNotNull()).select(g, F.col(label).alias("c"), F.col(vector).cast("array<double>").alias("v"))
    e = p.select("g", "c", F.posexplode("v").alias("i", "x")).groupBy("g", "c", "i").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    mid = stored(e.groupBy("g", "c").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m")), "centroids")
    gap: Column = F.aggregate(F.zip_with("v", "m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, t: s + t)
    own = p.join(small(mid), ["g", "c"]).withColumn("d", gap)
    per = own.groupBy("g", "c").agg(F.sum("d").alias("w"), F.avg(F.sqrt("d")).alias("s"))
    mid = mid.join(per, ["g", "c"])
    whole = e.groupBy("g", "i").agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("m")).groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))
    b = mid.join(whole, "g").withColumn("d", gap).groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum(F.col("n") * F.col("d")).alias("b"))
    other = mid.select("g", F.col("c").alias("c2"), F.col("m").alias("v"), F.col("s").alias("s2"))
    db = mid.join(other, "g").filter("c != c2").withColumn("r", F.try_divide(F.col("s") + F.col("s2"), F.sqrt(gap)))  # clusters, not points
    db = db.groupBy("g", "c").agg(F.max("r").alias("r")).groupBy("g").agg(F.avg("r").alias("davies_bouldin"))
    ch = F.when((F.col("k") > 1) & (F.col("n") > F.col("k")), F.coalesce(F.try_divide(F.col("b") * (F.col("n") - F.col("k")), F.col("w") * (F.col("k") - 1)), F.lit(1.0)))
    out = b.join(db, "g", "left").select("g", "k", "n", ch.alias("calinski_harabasz"), "davies_bouldin")
    return out.withColumnRenamed("g", group) if group else out.drop("g")


def fit(df: DataFrame, columns: list[str], k: int, seeds: tuple[int, ...] = (42, 43, 44)) -> DataFrame:
    """Adds ``cluster``: numbered from 0 by size, then by centroid, so runs agree."""
    x = _features(df, columns)
    best = min((KMeans(k=k, seed=s, maxIter=50).fit(x) for s in seeds), key=lambda m: m.summary.trainingCost)
    sizes = best.summary.clusterSizes
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], tuple(best.clusterCenters()[i])))
    new = F.create_map(*(v for i, old in enumerate(order) for v in (F.lit(old), F.lit(i))))
    return best.transform(x).withColumn("cluster", F.element_at(new, F.col("prediction"))).drop("features", "prediction")


def _merges(x: np.ndarray, w: np.ndarray) -> list[tuple[int, int, float, float]]:
    """Ward's merges (a, b, height, weight) of weighted points, by chains of nearest neighbours:
    time and memory grow with the square of the points. A merge's number is n plus its place
    among the heights in rising order, as in the usual linkage table."""
    n = len(x)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) * (2 * w[:, None] * w[None, :] / (w[:, None] + w[None, :]))
    np.fill_diagonal(d, np.inf)
    size, live, chain, raw = w.astype(float).copy(), np.ones(n, dtype=bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(live)[0]))
        while True:
            i = chain[-1]
            row = d[i]
            j = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[j]:
                j = chain[-2]
                break
            chain.append(j)
        del chain[-2:]
        a, b = min(i, j), max(i, j)
        raw.append((a, b, float(d[a, b])))
        s, t = size[a], size[b]
        new = ((s + size) * d[a] + (t + size) * d[b] - size * d[a, b]) / (s + t + size)
        live[b] = False
        new[~live] = np.inf
        new[a] = np.inf
        d[a], d[:, a] = new, new
        d[b], d[:, b] = np.inf, np.inf
        size[a] = s + t
    name, out = list(range(n)), []
    weight = dict(enumerate(w.astype(float)))
    for k, (a, b, h) in enumerate(sorted(raw, key=lambda r: r[2])):
        p, q = sorted((name[a], name[b]))
        name[a] = n + k
        weight[n + k] = weight[p] + weight[q]
        out.append((p, q, float(np.sqrt(max(h, 0.0))), weight[n + k]))
    return out


def _cut(merges: list[tuple[int, int, float, float]], n: int, k: int) -> np.ndarray:
    """Labels of n points after all but the last k - 1 merges."""
    top = list(range(n + len(merges)))
    for i, (a, b, _, _) in enumerate(merges[: max(0, n - k)]):
        top[a] = top[b] = n + i

    def root(i: int) -> int:
        while top[i] != i:
            i = top[i]
        return i

    return np.unique([root(i) for i in range(n)], return_inverse=True)[1]


MOST = 2048  # points that one task links; a larger group is first brought down to it in blocks


def _weighted(df: DataFrame, group: str, columns: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Points (g, id, v, w) of which no group has more than ``most``, and (g, v, id) of every
    distinct profile. Equal profiles are one point; while a group has more, its points lie in
    random blocks, a task a block, and Ward's method leaves half of each block."""
    v = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))
    kind = df.schema[group].dataType.simpleString()
    p = stored(df.groupBy(F.col(group).alias("g"), v.alias("v")).agg(F.count(F.lit(1)).cast("double").alias("w")).withColumn("id", F.xxhash64("g", "v")), "ward-points")
    of = p.select("g", "v", "id")
    while True:
        n = p.groupBy(F.col("g").alias("big")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
        if n.isEmpty():
            return p.select("g", "id", "v", "w"), of

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            if pdf["b"].iloc[0] < 0:
                return pd.DataFrame({"g": pdf["g"], "old": pdf["id"], "id": pdf["id"], "v": pdf["v"], "w": pdf["w"]})
            pdf = pdf.sort_values("id").reset_index(drop=True)
            x, w = np.stack(pdf["v"]), pdf["w"].to_numpy()
            at = _cut(_merges(x, w), len(x), max(1, len(x) // 2))
            total = np.bincount(at, w)
            mid = np.stack([np.bincount(at, w * x[:, j]) / total for j in range(x.shape[1])], axis=1)
            first = pdf["id"].to_numpy()[np.unique(at, return_index=True)[1]]
            return pd.DataFrame({"g": pdf["g"], "old": pdf["id"], "id": first[at], "v": list(mid[at]), "w": total[at]})

        cells = F.when(F.col("n").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("id", "w"), F.ceil(F.col("n") / (most // 2))))
        b = p.join(n, F.expr("g <=> big"), "left").select("g", "id", "v", "w", cells.cast("long").alias("b"))
        step = stored(b.groupBy("g", "b").applyInPandas(run, f"g {kind}, old long, id long, v array<double>, w double"), "ward-step")
        of = stored(of.withColumnRenamed("id", "old").join(step.select("old", "id"), "old").select("g", "v", "id"), "ward-of")  # an id tells the group too
        p = step.select("g", "id", "v", "w").dropDuplicates(["id"])


def linkage(df: DataFrame, group: str, columns: list[str], most: int = MOST) -> DataFrame:
    """group, step, a, b, height, size: Ward's merges in order. A point's number is its place
    among the group's distinct profiles in the order of their elements."""
    kind = df.schema[group].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, w = np.stack(pdf["v"]), pdf["w"].to_numpy()
        o = np.lexsort(x.T[::-1])
        m = _merges(x[o], w[o])
        a, b, h, n = np.array(m).reshape(-1, 4).T
        return pd.DataFrame({"g": pd.Series([pdf["g"].iloc[0]] * len(m), dtype=object), "step": np.arange(len(m)), "a": a.astype(int), "b": b.astype(int), "height": h, "size": n})

    p, _ = _weighted(df, group, columns, most)
    return p.groupBy("g").applyInPandas(run, f"g {kind}, step int, a int, b int, height double, size double").withColumnRenamed("g", group)


def ward(df: DataFrame, group: str, key: str, columns: list[str], k: int, most: int = MOST) -> DataFrame:
    """Ward linkage cut into k clusters within each group, numbered from 0 by size, then by
    centroid. Exact up to ``most`` distinct profiles; larger groups are brought down in blocks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, w = np.stack(pdf["v"]), pdf["w"].to_numpy()
        o = np.lexsort(x.T[::-1])
        x, w, ids = x[o], w[o], pdf["id"].to_numpy()[o]
        at = _cut(_merges(x, w), len(x), k)
        size = np.bincount(at, w)
        mid = [tuple(np.bincount(at, w * x[:, j])[c] / size[c] for j in range(x.shape[1])) for c in range(len(size))]
        rank = {c: r for r, c in enumerate(sorted(range(len(size)), key=lambda c: (-size[c], mid[c])))}
        return pd.DataFrame({"id": ids, "cluster": [rank[c] for c in at]})

    p, of = _weighted(df, group, columns, most)
    label = p.groupBy("g").applyInPandas(run, "id long, cluster int")
    label = of.join(label, "id").select("g", "v", "cluster")
    v = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))
    out = df.select(F.col(group).alias("_g"), F.col(key).alias("_k"), v.alias("_v"))
    return out.join(label, F.expr("_g <=> g AND _v = v")).select(F.col("_g").alias(group), F.col("_k").alias(key), "cluster")


ACTORS = ("kommun", "länsstyrelse", "MCF")


def characterise(assigned: DataFrame, columns: list[str], actors: tuple[str, ...] = ACTORS) -> DataFrame:
    """cluster, size, term, centroid, z against the corpus, the most distinctive term, and how
    many of the cluster are of each actor (n_kommun, n_lansstyrelse, n_MCF)."""
    long = assigned.unpivot(["cluster"], columns, "term", "x")
    corpus = long.groupBy("term").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    c = long.groupBy("cluster", "term").agg(F.avg("x").alias("centroid"), F.count(F.lit(1)).alias("size")).join(corpus, "term")
    c = c.withColumn("z", F.try_divide(F.col("centroid") - F.col("mean"), "std"))
    at = F.create_map(*(v for i, t in enumerate(columns) for v in (F.lit(t), F.lit(-i))))
    top = c.groupBy("cluster").agg(F.max_by("term", F.struct(F.col("z"), F.element_at(at, F.col("term")))).alias("distinctive"))  # the first on ties
    n = assigned.groupBy("cluster").agg(*(F.count(F.when(F.col("actor") == a, 1)).alias("n_" + a.replace("ä", "a")) for a in actors))
    return c.join(top, "cluster").join(n, "cluster").select("cluster", "size", "term", "centroid", "z", "distinctive", *("n_" + a.replace("ä", "a") for a in actors))


def composition(assigned: DataFrame, group: str) -> DataFrame:
    """group, cluster, actor, n: who the clusters are made of."""
    return assigned.groupBy(group, "cluster", F.coalesce("actor", F.lit("unknown")).alias("actor")).agg(F.count(F.lit(1)).alias("n"))


def transition_matrix(moves: DataFrame) -> DataFrame:
    """wave_from, wave_to, cluster_from, cluster_to, n, with margins ('All')."""
    g = moves.groupBy("wave_from", "wave_to", "cluster_from", "cluster_to").agg(F.count(F.lit(1)).alias("n"))
    names = [F.coalesce(F.col(c).cast("string"), F.lit("All")).alias(c) for c in ("cluster_from", "cluster_to")]
    sets = [["wave_from", "wave_to", "cluster_from", "cluster_to"], ["wave_from", "wave_to", "cluster_from"], ["wave_from", "wave_to", "cluster_to"], ["wave_from", "wave_to"]]
    return g.groupingSets(sets, "wave_from", "wave_to", "cluster_from", "cluster_to").agg(F.sum("n").alias("n")).select("wave_from", "wave_to", *names, "n")


def transitions(assigned: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """An entity's cluster in one wave and the next of the list."""
    spark = assigned.sparkSession
    p = F.broadcast(spark.createDataFrame(pairs, "wave_from int, wave_to int"))  # the caller's list
    a = assigned.select("entity", "actor", F.col("wave").alias("wave_from"), F.col("cluster").alias("cluster_from"))
    b = assigned.select("entity", F.col("wave").alias("wave_to"), F.col("cluster").alias("cluster_to"))
    return a.join(p, "wave_from").join(b, ["entity", "wave_to"]).withColumn("changed", F.col("cluster_from") != F.col("cluster_to"))


def project(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """Principal components of the centred columns; each axis points to its largest loading."""
    x = _features(df, columns)
    mid = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred").fit(x).transform(x)
    model = PCA(k=k, inputCol="centred", outputCol="pc").fit(mid)
    load = model.pc.toArray()
    sign = [float(np.sign(load[np.abs(load[:, j]).argmax(), j])) or 1.0 for j in range(k)]
    out = model.transform(mid).withColumn("pc", vector_to_array("pc"))
    return out.select(*df.columns, *((F.col("pc")[j] * sign[j]).alias(f"pc{j + 1}") for j in range(k)))


BLOCK = 1024  # points that are held against each other at once


def _near(cells: DataFrame, axes: int, run, schema: str) -> DataFrame:
    """Applies ``run`` to each pair of blocks in the same or adjoining cells of the grid."""
    g = [f"g{i}" for i in range(axes)]
    n = cells.groupBy(*g).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    x = cells.join(n, g).withColumn("blk", F.pmod(F.xxhash64("i"), F.col("blocks")))
    x = x.groupBy(*g, "blk").agg(F.collect_list(F.struct("i", "cell", "c", "core", "v")).alias("p"))  # BLOCK points, about
    x = stored(x, "dbscan-blocks")
    y = x.withColumnRenamed("p", "q").drop("blk")
    for c in g:
        y = y.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    return x.join(y, g).select("p.i", "p.cell", "p.core", "p.v", F.col("q.i").alias("j"), F.col("q.cell").alias("cell2"), F.col("q.c").alias("c2"), F.col("q.core").alias("core2"), F.col("q.v").alias("w")).mapInPandas(run, schema)


def neighbourhoods(df: DataFrame, key: str, columns: list[str], eps: float, least: int, axes: int = 3) -> DataFrame:
    """Density clusters (DBSCAN): core points within eps are joined; -1 is noise.

    Equal points are one point with a weight. Points meet through a grid of side eps over the
    ``axes`` columns of greatest variance, in blocks, so a crowded cell is many tasks. Points of
    a fine cell, of side eps / sqrt(d) in all columns, are all within eps of each other: the
    graph that is searched has a node a fine cell and an edge where core points of two are near,
    not a row a pair of points. Components are found by spreading the smallest label; a cluster
    is named by the smallest key of its core points.
    """
    v = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))
    var = df.agg(*(F.coalesce(F.var_pop(c), F.lit(0.0)).alias(c) for c in columns)).first()
    used = sorted(range(len(columns)), key=lambda i: (-var[columns[i]], i))[:axes]
    side = eps / len(columns) ** 0.5
    rows = df.select(F.col(key).alias("k"), v.alias("v"))
    p = rows.groupBy("v").agg(F.min("k").alias("i"), F.count(F.lit(1)).alias("c"))
    fine = F.xxhash64(F.transform("v", lambda x: F.floor(x / side)))
    p = stored(p.select("i", "c", "v", fine.alias("cell"), *(F.floor(F.col("v")[a] / eps).alias(f"g{j}") for j, a in enumerate(used))), "dbscan-points")
    kind = p.schema["i"].dataType.simpleString()

    def pairs(part: pd.DataFrame) -> Iterator[tuple]:
        for r in part.itertuples(index=False):
            a, b = np.stack(r.v), np.stack(r.w)
            yield r, sum((a[:, [k]] - b[:, k]) ** 2 for k in range(a.shape[1])) <= eps * eps

    def counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r, near in pairs(part):
                n = near @ np.asarray(r.c2)
                yield pd.DataFrame({"i": np.asarray(r.i)[n > 0], "n": n[n > 0]})

    def links(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r, near in pairs(part):
                i, j = np.nonzero(near & np.asarray(r.core2)[None, :])
                core = np.asarray(r.core)[i]
                other = np.asarray(r.cell2)[j]
                e = pd.DataFrame({"cell": np.asarray(r.cell)[i][core], "cell2": other[core]}).drop_duplicates()
                yield e.assign(i=None)[["i", "cell", "cell2"]]
                yield pd.DataFrame({"i": np.asarray(r.i)[i][~core], "cell2": other[~core]}).drop_duplicates().assign(cell=None)[["i", "cell", "cell2"]]

    p0 = p.withColumn("core", F.lit(False))
    dense = _near(p0, len(used), counts, f"i {kind}, n long").groupBy("i").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("i", F.lit(True).alias("k"))
    p1 = stored(p.join(dense, "i", "left").withColumn("core", F.coalesce("k", F.lit(False))).drop("k"), "dbscan-core")
    found = stored(_near(p1, len(used), links, f"i {kind}, cell long, cell2 long").distinct(), "dbscan-links")
    e = found.filter("cell IS NOT NULL").select("cell", "cell2")
    label = stored(p1.filter("core").groupBy("cell").agg(F.min("i").alias("label")), "dbscan-labels")
    moved = True
    while moved:
        low = e.join(label.withColumnRenamed("cell", "cell2"), "cell2").groupBy("cell").agg(F.min("label").alias("label"))
        # a label is a core point: its cell's own label is at least as small
        home = p1.filter("core").select(F.col("i").alias("label"), F.col("cell").alias("cell2"))
        jump = low.join(home, "label", "left").join(label.select(F.col("cell").alias("cell2"), F.col("label").alias("l2")), "cell2", "left").select("cell", F.least("label", "l2").alias("label"))
        new = stored(jump, "dbscan-labels")
        moved = not new.join(label.withColumnRenamed("label", "old"), "cell").filter("label != old").isEmpty()
        label = new
    border = found.filter("i IS NOT NULL").join(label.withColumnRenamed("cell", "cell2"), "cell2").groupBy("i").agg(F.min("label").alias("b"))
    at = p1.join(label, "cell", "left").join(border, "i", "left")
    at = at.select("v", F.when(F.col("core"), F.col("label")).otherwise(F.col("b")).cast("string").alias("cluster"))
    return rows.join(at, "v").select(F.col("k").alias(key), F.coalesce("cluster", F.lit("-1")).alias("cluster"))
