"""Reading level of documents: n-gram surprisal mapped monotonically to graded levels.

One interpolated bigram model per level is trained on all labelled documents (counts are
hashed into tables of fixed size, so models do not grow with the data); the weights of
bigram, unigram and uniform part are estimated by expectation maximisation on text that the
counts have not seen. Every sentence of a document has a surprisal a word under each model;
the document's score is a linear form of the quantiles of these surprisals over the whole
document, and isotonic regression on the labels maps scores to levels. Labelled documents are
measured by a model that has not seen them (two folds), so neither the form nor the map is
fitted to memory; the final model uses both folds.

Cases: null labels are left out; raters that differ both count; a document with null text,
under ``min_words`` words, in another language or that is no prose has no level; without
any label every document has the level of the middle; ties in scores share a level.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textverk.llm.kernel import Fold, codes_of, mix, slices, span_hashes, words_of
from textverk.llm.p1_prose import _WORD, complete_chars
from textverk.llm.p1_quality import _LANG
from textverk.session import small, stored
from textverk.sources.tables import spread

LEVELS = (1, 2, 3, 4)
UNI, BI = 1 << 16, 1 << 18  # cells of the count tables
BINS = 600  # of the score, for the isotonic fit
START = (0.5, 0.4, 0.1)  # weights of bigram, unigram and uniform part before they are estimated
GRID = 48  # steps of a probability's logarithm in the sums that the weights are estimated from
POINTS = (0.1, 0.25, 0.5, 0.75, 0.9)  # quantiles of a document's surprisals
PAIRS = tuple(combinations(range(len(LEVELS)), 2))
WIDTH = len(LEVELS) * len(POINTS) + len(PAIRS)  # measures of a document
RIDGE = 1.0  # penalty of the linear form, in documents
U = np.uint64


def cells(texts: list[str], fold: Fold) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word: text index, sentence number, unigram cell, bigram cell. Digits count as one word."""
    codes, off = codes_of(texts)
    folded = fold(codes).copy()
    folded[(codes >= 48) & (codes <= 57)] = 48
    s, e, rec = words_of(folded, off)
    h = span_hashes(folded, s, e)
    digits = folded[s] == 48 if len(s) else np.zeros(0, bool)
    h[digits] = U(48)
    if not len(s):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z
    stop = np.isin(codes, np.array([46, 33, 63, 0x2026], dtype=np.uint32))
    stop[:-1] &= codes[1:] <= 34  # a blank, a line end or a quotation mark follows
    ends = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum(stop, out=ends[1:])
    sentence = ends[s]
    first = np.ones(len(s), dtype=bool)
    first[1:] = (rec[1:] != rec[:-1]) | (sentence[1:] != sentence[:-1])
    prev = np.roll(h, 1)
    prev[first] = U(1)
    with np.errstate(over="ignore"):
        pair = mix(prev * U(3) + h)
    return rec, np.cumsum(first) - 1, (h >> U(48)).astype(np.int64), (pair >> U(46)).astype(np.int64)


class Model:
    """Counts of one fold or of both; surprisals of words under each level."""

    def __init__(self, uni: np.ndarray, bi: np.ndarray, sentences: np.ndarray, weights: np.ndarray | None = None) -> None:
        self.uni, self.bi, self.sentences = uni.astype(np.float32), bi.astype(np.float32), sentences
        self.total = np.maximum(self.uni.sum(axis=1), 1.0)
        self.weights = np.tile(START, (len(LEVELS), 1)) if weights is None else weights

    def parts(self, k: int, u: np.ndarray, b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bigram and unigram probability of each word under level ``k``."""
        ctx = self.uni[k][np.roll(u, 1)]
        ctx[first] = self.sentences[k]
        p = self.bi[k][b] / np.maximum(ctx, 1.0)
        np.minimum(p, 1.0, out=p)
        return p, self.uni[k][u] / self.total[k]

    def surprisals(self, u: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
        """levels x words, in nats"""
        out = np.empty((len(LEVELS), len(u)), dtype=np.float32)
        for k, (x, y, z) in enumerate(self.weights.tolist()):
            p, q = self.parts(k, u, b, first)
            p *= x
            p += y * q + z / UNI
            out[k] = -np.log(p)
        return out


def estimate(seen: np.ndarray) -> np.ndarray:
    """Weights of one level from counts of held-out words by (bigram, unigram) step of GRID + 1."""
    i, j = np.nonzero(seen)
    n = seen[i, j]
    if not len(n):
        return np.array(START)
    value = lambda k: np.where(k == 0, 0.0, np.exp((k - GRID) * 20.0 / GRID))
    p = np.stack([value(i), value(j), np.full(len(n), 1.0 / UNI)], axis=1)
    w = np.array(START)
    for _ in range(50):
        share = p * w
        share /= share.sum(axis=1, keepdims=True)
        w = (share * n[:, None]).sum(axis=0) / n.sum()
    w = np.maximum(w, 1e-3)  # no part is ever left out, so no word is impossible
    return w / w.sum()


def _step(p: np.ndarray) -> np.ndarray:
    out = np.zeros(len(p), dtype=np.int64)
    ok = p > 0
    out[ok] = np.clip(np.round(np.log(p[ok]) * GRID / 20.0) + GRID, 1, GRID)
    return out


def measures(texts: list[str], fold: Fold, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Measures of the distribution of each document's surprisals over its sentences, weighted by
    their words: quantiles of each level's surprisal a word beside the mean of all levels, and for
    each pair of levels the share of the text that is less surprising under the higher one (with
    a soft step at equal surprisal). Also the mean surprisal under the level of least. Zeros
    without words."""
    rec, sent, u, b = cells(texts, fold)
    out, bits = np.zeros((len(texts), WIDTH)), np.zeros(len(texts))
    if not len(u):
        return out, bits
    first = np.ones(len(u), dtype=bool)
    first[1:] = sent[1:] != sent[:-1]
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(u))).astype(float)
    total = np.add.reduceat(model.surprisals(u, b, first), at, axis=1)
    home = rec[at]
    words = np.bincount(home, size, len(texts))
    ok = words > 0
    least = np.bincount(home, total.min(axis=0), len(texts))
    bits[ok] = least[ok] / words[ok]
    per = total / size
    per -= per.mean(axis=0)
    ends = np.cumsum(words)
    starts = ends - words
    goal = starts[ok, None] + np.array(POINTS) * words[ok, None]
    for k in range(len(LEVELS)):
        o = np.lexsort((per[k], home))
        run = np.cumsum(size[o])
        out[np.ix_(ok, range(k * len(POINTS), (k + 1) * len(POINTS)))] = per[k][o][np.searchsorted(run, goal - 1e-6)]
    for k, (i, j) in enumerate(PAIRS, len(LEVELS) * len(POINTS)):
        higher = 1 / (1 + np.exp(np.clip(total[j] - total[i], -30, 30)))
        out[ok, k] = (np.bincount(home, higher * size, len(texts)) / np.maximum(words, 1))[ok]
    return out, bits


class Form:
    """A linear form of the measures, fitted by ridge regression from sums over the documents."""

    def __init__(self, n: float, sx: np.ndarray, sxx: np.ndarray, sy: float, sxy: np.ndarray) -> None:
        if n <= 0:
            self.mean, self.base, self.w = sx * 0.0, (LEVELS[0] + LEVELS[-1]) / 2, sx * 0.0
            return
        self.mean, self.base = sx / n, sy / n
        cov = sxx - n * np.outer(self.mean, self.mean)
        scale = np.trace(cov) / len(sx) / n
        self.w = np.linalg.solve(cov + RIDGE * max(scale, 1e-9) * np.eye(len(sx)), sxy - n * self.mean * self.base)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.w + self.base


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted least-squares non-decreasing fit of y at increasing x (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, k in zip(y.tolist(), w.tolist(), strict=True):
        blocks.append([v, k, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            a[0] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1])
            a[1] += b[1]
            a[2] += b[2]
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def running_prose(text: str, min_words: int = 60) -> bool:
    """Whether a text is Swedish or English running prose of at least ``min_words`` words."""
    if len(text.split(None, min_words)) < min_words:
        return False
    words = _WORD.findall(text.lower())
    if not words:
        return False
    votes = Counter(map(_LANG.get, words))
    known = len(words) - votes.pop(None, 0)
    if not votes or max(votes, key=votes.get) not in ("sv", "en") or known < 0.05 * len(words):
        return False
    done, total = complete_chars(text)
    return done >= 0.5 * total


def _count(labelled: DataFrame) -> dict[int, Model]:
    """Models of fold 0, fold 1 and both (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold("LN")
        for b in batches:
            texts, levels, folds = (b.column(k).to_pylist() for k in ("text", "level", "fold"))
            groups: dict[tuple, list[str]] = {}
            for t, v, f in zip(texts, levels, folds, strict=True):
                groups.setdefault((f, v), []).append(t)
            for (f, v), ts in groups.items():
                for i, j in slices(ts):
                    _, sent, u, bi = cells(ts[i:j], fold)
                    for base, x in ((0, u), (UNI, bi)):
                        k, n = np.unique(x, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), f), pa.int32()), pa.array(np.full(len(k), v), pa.int32()), pa.array(k + base), pa.array(n)], names=["fold", "level", "k", "n"])
                    yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([v], pa.int32()), pa.array([UNI + BI], pa.int64()), pa.array([int(sent[-1]) + 1 if len(sent) else 0], pa.int64())], names=["fold", "level", "k", "n"])

    got = labelled.mapInArrow(run, "fold int, level int, k long, n long").groupBy("fold", "level", "k").agg(F.sum("n").alias("n")).toPandas()
    size = UNI + BI + 1
    table = np.zeros((2, len(LEVELS), size))
    for f in (0, 1):
        for v in LEVELS:
            rows = got[(got["fold"] == f) & (got["level"] == v)]
            table[f, v - 1, rows["k"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=float)
    parts = {0: table[0], 1: table[1], 2: table[0] + table[1]}
    return {k: Model(t[:, :UNI], t[:, UNI : UNI + BI], t[:, -1]) for k, t in parts.items()}


def _by_fold(b: pa.RecordBatch) -> Iterator[tuple[int, list[str], list[int]]]:
    texts, levels, folds = (b.column(k).to_pylist() for k in ("text", "level", "fold"))
    for f in (0, 1):
        mine = [k for k, x in enumerate(folds) if x == f]
        if mine:
            yield f, [texts[k] for k in mine], [levels[k] for k in mine]


def _weigh(labelled: DataFrame, models: dict[int, Model]) -> None:
    """Sets the models' weights, estimated on each fold by the other one's counts."""
    sent = labelled.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold("LN")
        for b in batches:
            for f, texts, levels in _by_fold(b):
                m = sent.value[1 - f]
                for k in sorted(set(levels)):
                    ts = [t for t, v in zip(texts, levels, strict=True) if v == k]
                    for i, j in slices(ts):
                        _, sn, u, bi = cells(ts[i:j], fold)
                        if not len(u):
                            continue
                        first = np.ones(len(u), dtype=bool)
                        first[1:] = sn[1:] != sn[:-1]
                        p, q = m.parts(LEVELS.index(k), u, bi, first)
                        at, n = np.unique(_step(p) * (GRID + 1) + _step(q), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at), pa.array(n)], names=["level", "k", "n"])

    got = labelled.mapInArrow(run, "level int, k long, n long").groupBy("level", "k").agg(F.sum("n").alias("n")).toPandas()  # (GRID + 1)^2 rows a level
    weights = []
    for v in LEVELS:
        seen = np.zeros((GRID + 1) ** 2)
        mine = got[got["level"] == v]
        seen[mine["k"].to_numpy(dtype=np.int64)] = mine["n"].to_numpy(dtype=float)
        weights.append(estimate(seen.reshape(GRID + 1, GRID + 1)))
    for m in models.values():
        m.weights = np.stack(weights)


def train(docs: DataFrame, labels: DataFrame) -> tuple[Model, Form, np.ndarray]:
    """The final model, the form of its measures, and the level of each of BINS score bins."""
    ok = labels.filter(F.col("level").isin(*LEVELS) & F.col("doc_id").isNotNull())
    # labels are two numbers each; while they are few they go to the texts, not the texts to them
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(small(ok.select("doc_id", "level"), 1_000_000), "doc_id").select("text", F.col("level").cast("int").alias("level"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold"))
    labelled = stored(rows, "p10-labelled")
    models = _count(labelled)
    _weigh(labelled, models)
    sent = docs.sparkSession.sparkContext.broadcast(models)
    width = WIDTH

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold("LN")
        for b in batches:
            for f, texts, levels in _by_fold(b):
                x, _ = measures(texts, fold, sent.value[1 - f])
                rows_ = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([rows_, pa.array([float(v) for v in levels])], names=["x", "level"])

    got = stored(labelled.mapInArrow(measured, "x array<double>, level double"), "p10-measures")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 2, width + 2))
        for b in batches:
            if b.num_rows:
                z = np.column_stack([np.ones(b.num_rows), b.column(1).to_numpy(), b.column(0).flatten().to_numpy().reshape(-1, width)])
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["k", "v"])

    t = got.mapInArrow(sums, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()  # (width + 2)^2 rows
    z = np.zeros((width + 2) ** 2)
    z[t["k"].to_numpy(dtype=np.int64)] = t["v"].to_numpy(dtype=float)
    z = z.reshape(width + 2, width + 2)
    form = Form(z[0, 0], z[0, 2:], z[2:, 2:], z[0, 1], z[1, 2:])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_bin(form(b.column(0).flatten().to_numpy().reshape(-1, width)))), b.column(1)], names=["bin", "level"])

    seen = got.mapInArrow(binned, "bin long, level double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("level").alias("s")).toPandas().sort_values("bin")
    at, n, s = (seen[c].to_numpy(dtype=float) for c in ("bin", "n", "s"))
    grid = np.arange(BINS, dtype=float)
    if not len(at):
        return models[2], form, LEVELS[0] + grid * (LEVELS[-1] - LEVELS[0]) / (BINS - 1)
    return models[2], form, np.interp(grid, at, isotonic(at, s / n, n))


def _bin(score: np.ndarray) -> np.ndarray:
    """Bins reach a level beyond both ends, as a linear form may."""
    return np.clip(((score - LEVELS[0] + 1) / (LEVELS[-1] - LEVELS[0] + 2) * (BINS - 1)).round(), 0, BINS - 1).astype(np.int64)


def levels(docs: DataFrame, labels: DataFrame, min_words: int = 60) -> DataFrame:
    """doc_id, reading_level, score and surprisal of each Swedish or English prose document."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold("LN")
        model, form, curve = sent.value
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            keep = [k for k, t in enumerate(texts) if running_prose(t, min_words)]
            ids, texts = [ids[k] for k in keep], [texts[k] for k in keep]
            for i, j in slices(texts):
                x, bits = measures(texts[i:j], fold, model)
                score = form(x)
                value = curve[_bin(score)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), pa.array(np.clip(np.floor(value + 0.5), 1, 4).astype(np.int32)), pa.array(score), pa.array(bits)], names=["doc_id", "reading_level", "score", "surprisal"])

    src = docs.filter(F.col("text").isNotNull() & (F.length("text") >= 2 * min_words - 1)).select("doc_id", "text")
    return spread(src, "doc_id").mapInArrow(run, "doc_id long, reading_level int, score double, surprisal double")
