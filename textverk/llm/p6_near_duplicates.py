"""Near-duplicate documents by BagMinHash, banding and exact verification.

A document is the multiset of its runs of ``k`` consecutive words. The signature is the
smallest arrival per component of Poisson processes, one process per shingle and weight
cell [0,1), [1,2), [2,4), [4,8), ...: the process of a cell runs at the rate of the cell's
length, each of its points has a level in the cell, and only points under the weight count.
Two signatures then agree in a component with the probability of the weighted Jaccard
similarity. Points come in order of time and a process ends once it is later than the
largest minimum, so few points are drawn. With ``weighted=False`` each shingle has weight 1.

Bands of components make candidates; the shingles of the candidates alone are then taken
from their texts again and every candidate is verified on them (64-bit hashes, with their
counts if weighted). Exact copies (same word sequence) are one class from the start, so a
group of copies of any size is one member in the bands; a band that many different texts
share is held against itself in blocks.

Cases: documents under ``min_words`` words or without text are no members; a document
delivered twice is one; ties do not arise, as classes are named by their fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textverk.llm.kernel import Fold, codes_of, mix, slices, span_hashes, words_of
from textverk.session import small, stored
from textverk.sources.tables import spread

U = np.uint64


def shingles(texts: list[str], fold: Fold, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text index, hash and count of each distinct shingle; words and fingerprint of each text."""
    texts = [t.replace("İ", "i̇") if "İ" in t else t for t in texts]
    codes, off = codes_of(texts)
    folded = fold(codes)
    s, e, rec = words_of(folded, off)
    h = span_hashes(folded, s, e)
    n_words = np.bincount(rec, minlength=len(texts))
    ends = np.cumsum(n_words)
    fp = mix(span_hashes(h, ends - n_words, ends) ^ n_words.astype(U))
    m = max(0, len(h) - k + 1)
    with np.errstate(over="ignore"):
        x = np.zeros(m, dtype=U)
        for j in range(k):
            x = mix(x * U(3) + h[j : j + m])
    inside = rec[k - 1 :] == rec[:m] if m else np.zeros(0, bool)
    x, r = x[inside], rec[:m][inside]
    o = np.lexsort((x, r))
    x, r = x[o], r[o]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    return r[at], x[at], np.diff(np.append(at, len(x))), n_words, fp


def bagminhash(rec: np.ndarray, item: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m signatures (bits of the smallest arrival times) of weighted sets; unset is all ones."""
    sig = np.full(n * m, np.inf)
    if not len(rec):
        return sig.view(U).reshape(n, m)
    cells = [(rec, item, np.zeros(len(rec)), np.ones(len(rec)), weight)]
    lo = 1
    while (over := weight > lo).any():  # the dyadic cells above the first
        cells.append((rec[over], mix(item[over] ^ U(lo)), np.full(over.sum(), float(lo)), np.full(over.sum(), float(lo)), weight[over]))
        lo *= 2
    r, key, low, length, w = (np.concatenate(c) for c in zip(*cells, strict=True))
    time = np.zeros(len(r))
    step = 0
    limit = np.full(n, np.inf)
    while len(r):
        step += 1
        a = mix(key + U((step * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        time = time - np.log(((a >> U(12)).astype(np.float64) + 0.5) / 2.0**52) / (m * length)
        b = mix(a)
        level = low + length * ((b >> U(32)).astype(np.float64) / 2.0**32)
        hit = (time < limit[r]) & (level < w)
        np.minimum.at(sig, r[hit] * m + ((b & U(0xFFFFFFFF)) % U(m)).astype(np.int64)[hit], time[hit])
        limit = sig.reshape(n, m).max(axis=1)
        on = time < limit[r]
        r, key, low, length, w, time = (x[on] for x in (r, key, low, length, w, time))
    return sig.view(U).reshape(n, m)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    n, m = sig.shape
    with np.errstate(over="ignore"):
        x = np.zeros((n, m // rows), dtype=U)
        for j in range(rows):
            x = mix(x * U(3) + sig[:, j::rows][:, : m // rows])
    return (x >> U(32)).astype(np.uint32).view(np.int32)


DOCS = "doc string, fp long, n_words int, mass long, bands array<long>"
SETS = "fp long, items binary, counts binary"
BLOCK = 1024  # members of a band's bucket beyond which it is joined in blocks


def documents(df: DataFrame, doc: str, text: str, k: int = 3, rows: int = 5, bands: int = 60, min_words: int = 40, weighted: bool = False) -> DataFrame:
    """Fingerprint, mass (shingles, each counted as often as its weight) and bands of each
    document with enough words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold("LN")
        for b in batches:
            docs, texts = b.column(0), b.column(1).to_pylist()
            for i, j in slices(texts):
                rec, item, count, n_words, fp = shingles(texts[i:j], fold, k)
                ok = np.flatnonzero(n_words >= max(min_words, k))
                if not len(ok):
                    continue
                new = np.full(j - i, -1)
                new[ok] = np.arange(len(ok))
                keep = new[rec] >= 0
                rec, item, count = new[rec[keep]], item[keep], count[keep]
                w = count if weighted else np.ones(len(count), dtype=np.int64)
                keys = band_keys(bagminhash(rec, item, w, len(ok), rows * bands), rows).astype(np.int64) & 0xFFFFFFFF
                keys |= np.arange(bands, dtype=np.int64) << 32  # the band is part of its key
                mass = np.bincount(rec, w, len(ok)).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ok) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([docs.slice(i, j - i).take(pa.array(ok)), pa.array(fp[ok].view(np.int64)), pa.array(n_words[ok].astype(np.int32)), pa.array(mass), lists], names=["doc", "fp", "n_words", "mass", "bands"])

    src = df.filter(F.col(text).isNotNull() & F.col(doc).isNotNull()).select(F.col(doc).cast("string"), F.col(text))
    return spread(src, doc).mapInArrow(run, DOCS)


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """fp, the sorted hashes of its shingles and their counts, from (fp, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold("LN")
        for b in batches:
            fps, ts = b.column(0), b.column(1).to_pylist()
            for i, j in slices(ts):
                rec, item, count, _, _ = shingles(ts[i:j], fold, k)
                at = np.searchsorted(rec, np.arange(j - i + 1)).tolist()
                cut = list(zip(at, at[1:], strict=False))
                yield pa.RecordBatch.from_arrays([fps.slice(i, j - i), pa.array([item[x:y].tobytes() for x, y in cut], pa.binary()), pa.array([count[x:y].astype(np.uint32).tobytes() for x, y in cut], pa.binary())], names=["fp", "items", "counts"])

    return texts.mapInArrow(run, SETS)


def _overlap(weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(k).to_pylist() for k in ("ia", "ib", "ca", "cb")]
            js = []
            for ia, ib, ca, cb in zip(*cols, strict=True):
                _, p, q = np.intersect1d(np.frombuffer(ia, U), np.frombuffer(ib, U), assume_unique=True, return_indices=True)
                if weighted:
                    u, v = np.frombuffer(ca, np.uint32).astype(np.int64), np.frombuffer(cb, np.uint32).astype(np.int64)
                    both, all_ = int(np.minimum(u[p], v[q]).sum()), int(u.sum()) + int(v.sum())
                else:
                    both, all_ = len(p), len(ia) // 8 + len(ib) // 8
                js.append(both / (all_ - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(js, pa.float64())], names=["a", "b", "jaccard"])

    return run


def links(docs: DataFrame, texts: DataFrame, doc: str, text: str, threshold: float, k: int = 3, weighted: bool = False) -> DataFrame:
    """Verified pairs a < b of class fingerprints with their similarity; ``docs`` is the stored
    table of ``documents``, ``texts`` what it was made from.

    Of two sets of masses p <= q the similarity is at most p / q, which drops most accidental
    pairs before any shingle is looked at. A bucket of more than BLOCK classes is cut into
    blocks: each member stands in one block on the left and is sent to every block on the
    right, so no task holds all pairs of a bucket.
    """
    reps = docs.groupBy("fp").agg(F.first("mass").alias("mass"), F.first("bands").alias("bands"))
    flat = reps.select("fp", "mass", F.explode("bands").alias("key"))
    hot = stored(flat.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "p6-hot")
    flat = flat.join(small(hot), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    a = flat.select(F.col("fp").alias("a"), F.col("mass").alias("na"), "key", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block"))
    b = flat.select(F.col("fp").alias("b"), F.col("mass").alias("nb"), "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    near = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold)
    pairs = stored(a.join(b, ["key", "block"]).filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct(), "p6-pairs")
    used = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    one = stored(docs.join(used, "fp", "left_semi").groupBy("fp").agg(F.min("doc").alias("d")), "p6-used")
    src = texts.filter(F.col(text).isNotNull()).select(F.col(doc).cast("string").alias("d"), F.col(text).alias("t")).join(small(one, 500_000), "d")
    # a document that is delivered twice has one text
    sets = stored(_sets(spread(src.select("fp", "t"), "fp"), k).dropDuplicates(["fp"]), "p6-sets")
    left = sets.select(F.col("fp").alias("a"), F.col("items").alias("ia"), F.col("counts").alias("ca"))
    right = sets.select(F.col("fp").alias("b"), F.col("items").alias("ib"), F.col("counts").alias("cb"))
    got = pairs.join(left, "a").join(right, "b").select("a", "b", "ia", "ib", "ca", "cb").mapInArrow(_overlap(weighted), "a long, b long, jaccard double")
    return got.filter(F.col("jaccard") >= threshold)


def document_pairs(docs: DataFrame, found: DataFrame) -> DataFrame:
    """filename_a < filename_b for all documents of linked or equal classes."""
    members = docs.select("doc", "fp").distinct()
    own = members.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    both = found.select("a", "b").unionByName(own)
    x = members.select(F.col("fp").alias("a"), F.col("doc").alias("da"))
    y = members.select(F.col("fp").alias("b"), F.col("doc").alias("db"))
    p = both.join(x, "a").join(y, "b").filter((F.col("da") != F.col("db")) & ((F.col("a") != F.col("b")) | (F.col("da") < F.col("db"))))
    return p.select(F.least("da", "db").alias("filename_a"), F.greatest("da", "db").alias("filename_b")).distinct()


def groups(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc, group_id and number of links: one row a document.

    Groups are connected components of the links. In each round every class takes the
    smallest label among its neighbours' and its label's own label, until nothing changes;
    each round's labels are a stored table.
    """
    edges = stored(found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))), "p6-edges")
    label = stored(edges.select(F.col("a").alias("fp"), F.col("a").alias("label")).distinct(), "p6-labels")
    moved = True
    while moved:
        near = edges.join(label, edges["b"] == label["fp"]).select(F.col("a").alias("fp"), "label")
        low = near.unionByName(label).groupBy("fp").agg(F.min("label").alias("label"))
        jump = low.alias("x").join(low.alias("y"), F.col("x.label") == F.col("y.fp")).select(F.col("x.fp").alias("fp"), F.least("x.label", "y.label").alias("label"))
        new = stored(jump, "p6-labels")
        moved = not new.join(label.withColumnRenamed("label", "old"), "fp").filter("label != old").isEmpty()
        label = new
    n = edges.groupBy(F.col("a").alias("fp")).agg(F.count(F.lit(1)).alias("n_links"))
    return (
        docs.select("doc", "fp").distinct().join(label, "fp", "left").join(n, "fp", "left")
        .select(F.col("doc").alias("filename"), F.coalesce("label", "fp").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
