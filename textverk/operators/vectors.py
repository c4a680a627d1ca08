"""Embedding vectors kept in their rows: centroids, neighbours, drift."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, t: s + t)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Element-wise mean by key. Sums are taken per element, so partial sums travel, not vectors."""
    x = df.filter(F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("i", "x"))
    g = x.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return g.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


ROWS = 4096  # vectors of a block


def _blocks(df: DataFrame, key: str, vector: str) -> DataFrame:
    """ids array and the matrix of unit vectors (float64, bytes), up to ROWS a row; vectors that
    are null or zero have no direction and are left out."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                m = np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                norm = np.sqrt((m * m).sum(axis=1))
                ok = np.flatnonzero(norm > 0)
                ids = pa.array([part.column(0).take(pa.array(ok)).to_pylist()], pa.list_(part.schema.field(0).type))
                yield pa.RecordBatch.from_arrays([ids, pa.array([(m[ok] / norm[ok, None]).tobytes()])], names=["ids", "m"])

    return df.filter(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"ids array<{kind}>, m binary")


def neighbours(df: DataFrame, seeds: DataFrame, key: str, vector: str, top: int = 50) -> DataFrame:
    """The most similar rows of each seed, exact. ``seeds`` (seed, seed_vector) is a stated query
    set against all rows: blocks of both meet, each pair of blocks is one matrix product, and
    only its best rows a seed go on. Equal similarities (to 12 digits) go by the key."""
    kind, seed_kind = df.schema[key].dataType.simpleString(), seeds.schema["seed"].dataType.simpleString()
    x = _blocks(df, key, vector).withColumnRenamed("ids", "k").withColumnRenamed("m", "km")
    y = _blocks(seeds, "seed", "seed_vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, km, ids, m in zip(*(b.column(c) for c in ("k", "km", "ids", "m")), strict=True):
                names, own = np.array(k.as_py()), np.array(ids.as_py())
                if not len(names) or not len(own):
                    continue
                o = np.argsort(names, kind="stable")
                u, v = np.frombuffer(km.as_py()).reshape(len(names), -1)[o], np.frombuffer(m.as_py()).reshape(len(own), -1)
                names = names[o]
                sim = np.round(v @ u.T, 12)
                sim[own[:, None] == names[None, :]] = -np.inf
                best = np.argsort(-sim, axis=1, kind="stable")[:, :top]
                s = np.take_along_axis(sim, best, axis=1)
                i, j = np.nonzero(np.isfinite(s))
                yield pa.RecordBatch.from_arrays([pa.array(own[i], ids.type.value_type), pa.array(names[best[i, j]], k.type.value_type), pa.array(s[i, j])], names=["seed", key, "similarity"])

    got = x.crossJoin(y).mapInArrow(run, f"seed {seed_kind}, {key} {kind}, similarity double")
    w = W.partitionBy("seed").orderBy(F.desc("similarity"), key)
    return got.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def expansion(near: DataFrame, categories: DataFrame, key: str) -> DataFrame:
    """category, key, similarity: of the neighbours of a category's seeds the highest similarity
    to any of them. ``categories`` is (seed, category)."""
    return near.join(categories, "seed").groupBy("category", key).agg(F.max("similarity").alias("similarity"))


def to_centroid(df: DataFrame, key: str, group: str, vector: str, n: int = 5, *, typical: bool = True) -> DataFrame:
    """The n rows nearest to their group's centroid, or farthest."""
    c = centroids(df, group, vector)
    x = df.join(c, group).select(group, key, cosine(F.col(vector), F.col("centroid")).alias("similarity"))
    w = W.partitionBy(group).orderBy(F.desc("similarity") if typical else F.asc("similarity"), key)
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def drift(df: DataFrame, group: str, step: str, vector: str) -> DataFrame:
    """Cosine between a group's centroids at consecutive steps."""
    x = df.withColumn("_k", F.struct(group, step))
    c = centroids(x, "_k", vector).select(F.col(f"_k.{group}").alias(group), F.col(f"_k.{step}").alias(step), "centroid")
    w = W.partitionBy(group).orderBy(step)
    y = c.select(group, F.lag(step).over(w).alias("step_from"), F.col(step).alias("step_to"), F.lag("centroid").over(w).alias("before"), "centroid")
    return y.filter("before IS NOT NULL").select(group, "step_from", "step_to", cosine(F.col("before"), F.col("centroid")).alias("similarity"))


def sentence_vectors(tokens: DataFrame, words: DataFrame, key: str, how: str = "mean", least: float = 0.01) -> DataFrame:
    """key, vector, words_found, coverage from tokens(key, word) and words(word, vector); words
    whose vector is almost zero do not count; without any word the vector is null."""
    good = words.filter(F.sqrt(dot(F.col("vector"), F.col("vector"))) > least)
    n = tokens.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hit = tokens.join(good, "word").select(key, F.posexplode("vector").alias("i", "x"))
    agg = (F.avg if how == "mean" else F.sum)(F.col("x").cast("double"))
    v = hit.groupBy(key, "i").agg(agg.alias("m"), F.count(F.lit(1)).alias("k")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector"), F.max("k").alias("words_found"))
    return n.join(v, key, "left").select(key, "vector", F.coalesce("words_found", F.lit(0)).alias("words_found"), (F.coalesce("words_found", F.lit(0)) / F.col("n")).alias("coverage"))


def _npy(uri: str) -> tuple[pafs.FileSystem, str, tuple[int, int], np.dtype, int]:
    """File system, path, shape, type and where the numbers begin of a row-major .npy matrix."""
    at, path = pafs.FileSystem.from_uri(uri)
    with at.open_input_file(path) as f:
        head = io.BytesIO(f.read(4096))
        version = np.lib.format.read_magic(head)
        shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if fortran or len(shape) != 2:
        raise ValueError(f"{uri} is no row-major matrix")
    return at, path, shape, kind, head.tell()


def load_npy(spark: SparkSession, uri: str) -> DataFrame:
    """row (from 0) and vector of a dense matrix; every task reads its own range of the file. The
    rows are to be joined with their index by number at once: from then on a vector is in its row."""
    _, _, (n, width), kind, start = _npy(uri)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, path = pafs.FileSystem.from_uri(uri)
        with at.open_input_file(path) as f:
            for b in batches:
                ids = b.column(0).to_numpy()
                if len(ids):
                    lo, hi = int(ids.min()), int(ids.max()) + 1
                    m = np.frombuffer(f.read_at((hi - lo) * width * kind.itemsize, start + lo * width * kind.itemsize), kind).reshape(-1, width)[ids - lo].astype(np.float32)
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * width), pa.array(m.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), rows], names=["row", "vector"])

    return spark.range(n).withColumnRenamed("id", "row").mapInArrow(run, "row long, vector array<float>")


def save_npy(df: DataFrame, key: str, vector: str, uri: str) -> DataFrame:
    """One .npy matrix a partition under ``uri``, and the index (part, row, key) that belongs to
    them, which is to be stored beside. A repeated task writes another file; only the one that
    the index names counts."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        for b in batches:
            ids.append(b.column(0))
            rows += [np.asarray(v, dtype=np.float32) for v in b.column(1).to_numpy(zero_copy_only=False)]
        if rows:
            name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.npy"
            at, path = pafs.FileSystem.from_uri(f"{uri.rstrip('/')}/{name}")
            at.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with at.open_output_stream(path) as f:
                np.save(f, np.stack(rows))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(np.arange(len(rows))), pa.concat_arrays([c for i in ids for c in (i.chunks if isinstance(i, pa.ChunkedArray) else [i])])], names=["part", "row", key])

    return df.filter(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"part string, row long, {key} {kind}")
