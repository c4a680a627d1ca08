"""Faults of text from scanned pages, and the text as continuous paragraphs.

Furniture and broken words are found within each document by classifiers of pairs of lines,
trained on simulated scans (``p3_pages``, ``p3_simulate``).
Misread words: the corpus's words and their counts make a vocabulary; a rare word's
correction candidates come from an inverted join on its rarest character q-grams, which
by the prefix principle finds every word within two edits; gradient-boosted trees, trained
on simulated faults, rank the candidates and decide whether the word was misread.

Cases: null and blank texts have no fault; ties between candidates go to the commoner, then
the alphabetically first word; an empty table gives an empty result; a text of any length is
handled whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textverk.llm.boost import Boosted
from textverk.llm.kernel import slices
from textverk.llm.p3_pages import HYPHENS, analyse, long_words
from textverk.llm.p3_simulate import models
from textverk.session import stored
from textverk.sources.tables import spread

Q, EDITS = 3, 2
TOP = 4096  # most frequent words; this many are broadcast whatever the size of the corpus
OWN = 0.02  # share of its candidate's count above which a form is no fault
SAMPLE = 3000  # dictionary words from which training faults are made
# What a character or group may be misread as: fixed values
LOOKS = (
    "e:c c:e t:f f:t s:5 5:s l:i l:1 i:1 i:l o:0 0:o g:9 9:g v:y y:v ä:á ä:a ö:o ö:6 å:ä å:a ä:à å:á b:6 b:h h:b u:n n:u m:rn rn:m d:cl cl:d "
    "ti:ü li:h ii:n n:ii nn:m vv:w w:vv ri:n a:o z:2 q:g é:e é:6 ö:ó å:à l:t i:t s:8 b:8 g:q j:i 1:l 1:i"
)
PAIRS = tuple(tuple(p.split(":")) for p in LOOKS.split())
_SEEN_AS = frozenset(PAIRS)

PARTS = "src string, rec_id long, scan boolean, pageno array<int>, header array<int>, hyphen array<int>, goes_on array<int>, w_line array<int>, w_next array<int>, w_cut array<int>, words array<string>"


def parts(df: DataFrame) -> DataFrame:
    """Furniture, broken words and body words of every text of (src, rec_id, text, scanned)."""

    sent = df.sparkSession.sparkContext.broadcast(models())  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifiers = sent.value
        for b in batches:
            texts, scans = b.column("text").to_pylist(), b.column("scanned").to_pylist()
            for i, j in slices(texts):  # as the words take more memory than the texts
                rows: list[list] = [[] for _ in range(5)]
                words: list[str] = []
                at, count, sizes, joined = [], [], [0], []
                for t, s in zip(texts[i:j], scans[i:j], strict=True):
                    page = analyse(t, bool(s), classifiers)
                    one = (page.scanned, page.pageno, page.header, [k for k, _ in page.hyphen], [k for _, k in page.hyphen])
                    for c, v in zip(rows, one, strict=True):
                        c.append(v)
                    own, lines, n, two = long_words(page)
                    joined += [(len(words) + k, line, cut) for k, line, cut in two]
                    words += own
                    at += lines
                    count += n
                    sizes.append(len(words))
                w_line = np.repeat(np.array(at, dtype=np.int32), np.array(count, dtype=np.int64))
                w_next, w_cut = np.zeros(len(words), dtype=np.int32), np.zeros(len(words), dtype=np.int32)
                for k, line, cut in joined:
                    w_next[k], w_cut[k] = line, cut
                off = pa.array(sizes, pa.int32())
                lists = [pa.ListArray.from_arrays(off, pa.array(x)) for x in (w_line, w_next, w_cut)] + [pa.ListArray.from_arrays(off, pa.array(words, pa.string()))]
                kinds = [pa.bool_(), *[pa.list_(pa.int32())] * 4]
                yield pa.RecordBatch.from_arrays([b.column("src").slice(i, j - i), b.column("rec_id").slice(i, j - i), *(pa.array(c, t) for c, t in zip(rows, kinds, strict=True)), *lists], names=["src", "rec_id", "scan", "pageno", "header", "hyphen", "goes_on", "w_line", "w_next", "w_cut", "words"])

    src = df.filter(F.col("text").isNotNull() & (F.length("text") > 0))
    return spread(src, "rec_id").mapInArrow(run, PARTS)


def change(word: str, cand: str) -> tuple[str, str, int]:
    """(part of the candidate, part of the word in its place, where) by which the two differ."""
    p = 0
    while p < min(len(word), len(cand)) and word[p] == cand[p]:
        p += 1
    q = 0
    while q < min(len(word), len(cand)) - p and word[-1 - q] == cand[-1 - q]:
        q += 1
    return cand[p : len(cand) - q], word[p : len(word) - q], p


def features(word: str, cand: str, n_word: float, n_cand: float) -> list[float]:
    a, b, at = change(word, cand)
    looks = float((a, b) in _SEEN_AS)
    if not looks and len(a) == len(b) and len(a) > 1:
        parts_ = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
        looks = 0.8 if all(p in _SEEN_AS for p in parts_) else 0.0
    kind = 0.0 if len(a) == len(b) == 1 else 1.0 if len(a) == len(b) == 2 and a == b[::-1] else 2.0 if not b else 3.0 if not a else 4.0
    digit = float(any(c.isdigit() for c in b) and not any(c.isdigit() for c in cand))
    return [math.log(n_cand + 1) - math.log(n_word + 1), math.log(n_word + 1), looks, float(len(a) + len(b)), float(min(len(word), 20)), kind, digit, float(at == 0), float(len(a) - len(b))]


def train(words: list[tuple[str, int]], seed: int = 7) -> Boosted:
    """Trees fitted on faults simulated on at most SAMPLE frequent words.

    Positives: a look-alike in place of a character. Negatives: slips of the pen
    (swapped, dropped, doubled letters), other letters, and real words near each other.
    """
    rng = np.random.default_rng(seed)
    words = [w for w in words if len(w[0]) >= 4]
    floor = 0.1 * float(np.median([n for _, n in words])) if words else 0.0
    words = [w for w in words if w[1] >= floor][:SAMPLE]
    known = {w for w, _ in words}
    x, y = [], []
    letters = "abcdefghijklmnoprstuvyåäö"
    for w, n in words:
        few = float(1 + rng.poisson(max(0.5, n / 300)))
        fits = [(a, b, i) for a, b in PAIRS for i in range(len(w)) if w.startswith(a, i)]
        for a, b, i in (fits[k] for k in rng.permutation(len(fits))[:2]):
            bad = w[:i] + b + w[i + len(a) :]
            if bad not in known:
                x.append(features(bad, w, few, n))
                y.append(1.0)
        i = int(rng.integers(len(w) - 1))
        slips = [w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[:i] + letters[int(rng.integers(len(letters)))] + w[i + 1 :]]
        for k, bad in enumerate(slips):
            if bad != w and bad not in known and (k < 3 or (w[i], bad[i]) not in _SEEN_AS):
                x.append(features(bad, w, few, n))
                y.append(0.0)
    near: dict[str, list[tuple[str, int]]] = {}
    for w, n in words:
        for i in range(len(w)):
            near.setdefault(w[:i] + "*" + w[i + 1 :], []).append((w, n))
    for same in near.values():
        for (v, m), (u, k) in zip(same, same[1:], strict=False):
            a, b, _ = change(u, v) if m >= k else change(v, u)
            if max(m, k) > 10 * min(m, k) and ((a, b) in _SEEN_AS or (b, a) in _SEEN_AS):
                continue  # that may be a misread word itself
            x.append(features(u, v, min(m, k), max(m, k)))
            y.append(0.0)
    if not x or len(set(y)) < 2:
        x, y = [[0.0] * 9, [1.0] * 9], [0.0, 1.0]
    return Boosted().fit(np.array(x), np.array(y))


def misread_words(stored_parts: DataFrame, min_cand: int = 4, ratio: float = 3.0, level: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(word, correction, p) of the misread words, and the TOP most frequent words."""
    spark = stored_parts.sparkSession
    vocab = stored(stored_parts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "p3-vocabulary")
    top = vocab.orderBy(F.desc("n"), "word").limit(TOP)
    model = spark.sparkContext.broadcast(train([(r["word"], r["n"]) for r in top.filter(F.col("word").rlike(r"^\p{L}+$")).collect()]))

    padded = F.concat(F.lit("^^"), "word", F.lit("$$"))
    grams = vocab.filter((F.length("word") >= 4) | F.col("word").rlike("[0-9]")).select("word", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 2), lambda i: F.struct(i.alias("pos"), F.substr(padded, i, F.lit(Q)).alias("g")))).alias("e")).select("word", "n", "e.pos", "e.g")
    right = grams.filter((F.col("n") >= min_cand) & ~F.col("word").rlike("[0-9]"))
    df_of = right.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    rare_first = W.partitionBy("word").orderBy(F.coalesce("df", F.lit(0)), "pos")
    left = (
        grams.join(df_of, "g", "left").withColumn("rk", F.row_number().over(rare_first)).filter(F.col("rk") <= EDITS * Q + 1)
        .filter(F.col("df").isNotNull()).select(F.col("word").alias("bad"), F.col("n").alias("n_bad"), F.col("pos").alias("p1"), "g")
    )
    cand = (
        left.join(right.select(F.col("word").alias("cand"), F.col("n").alias("n_cand"), F.col("pos").alias("p2"), "g"), "g")
        .filter((F.col("bad") != F.col("cand")) & (F.abs(F.col("p1") - F.col("p2")) <= EDITS) & (F.abs(F.length("bad") - F.length("cand")) <= EDITS) & ((F.col("n_cand") >= F.col("n_bad") * ratio) | F.col("bad").rlike("[0-9]")))
        # a form that is common beside its candidate is a word of its own
        .filter((F.col("n_bad") <= 3 + F.col("n_cand") * OWN) | F.col("bad").rlike("[0-9]"))
        .select("bad", "n_bad", "cand", "n_cand").distinct().filter(F.levenshtein("bad", "cand", EDITS) >= 0)
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad, cnd = b.column("bad").to_pylist(), b.column("cand").to_pylist()
            x = [features(*r) for r in zip(bad, cnd, b.column("n_bad").to_pylist(), b.column("n_cand").to_pylist(), strict=True)]
            p = model.value.predict(np.array(x)) if x else np.zeros(0)
            at = [change(w, c)[2] for w, c in zip(bad, cnd, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("bad"), b.column("cand"), b.column("n_cand"), pa.array(p, pa.float64()), pa.array(at, pa.int32())], names=["word", "correction", "n", "p", "at"])

    ranked = cand.mapInArrow(score, "word string, correction string, n long, p double, at int").filter(F.col("p") >= level)
    best = W.partitionBy("word").orderBy(F.desc("p"), F.desc("n"), "correction")
    return ranked.withColumn("rk", F.row_number().over(best)).filter("rk = 1").select("word", "correction", "p", "at"), top


def _with_misread(stored_parts: DataFrame) -> DataFrame:
    """src, rec_id, line, word, correction, p of every misread body word."""
    bad, top = misread_words(stored_parts)
    bad = stored(bad, "p3-misread")
    common = top.join(bad, "word", "left_anti").select("word")  # at most TOP rows
    tokens = (
        stored_parts.select("src", "rec_id", "scan", F.explode(F.arrays_zip("w_line", "w_next", "w_cut", "words")).alias("t"))
        .select("src", "rec_id", "scan", F.col("t.words").alias("word"), F.col("t.w_line").alias("l1"), F.col("t.w_next").alias("l2"), F.col("t.w_cut").alias("cut"))
        .join(F.broadcast(common), "word", "left_anti")
    )
    line = F.when((F.col("l2") > 0) & (F.col("at") >= F.col("cut")), F.col("l2")).otherwise(F.col("l1"))
    hits = tokens.join(bad, "word").select("src", "rec_id", "scan", line.alias("line_no"), "word", "correction", "p")
    # in a text without any other sign of a scan, one of its words must be such a sign
    sure = F.col("word").rlike("[0-9á]") | (F.translate("word", "i", "l") == F.translate("correction", "i", "l"))
    text = W.partitionBy("src", "rec_id")
    hits = hits.withColumn("sure", F.max(sure).over(text)).withColumn("n", F.count(F.lit(1)).over(text))
    return hits.filter("scan OR sure OR n >= 4").drop("scan", "sure", "n")


def faults(df: DataFrame) -> DataFrame:
    """src, rec_id, line_no, fault of (src, rec_id, text, scanned)."""
    p = stored(parts(df), "p3-parts")
    simple = [p.select("src", "rec_id", F.explode(c).alias("line_no"), F.lit(f).alias("fault")) for c, f in (("header", "header"), ("pageno", "pageno"), ("hyphen", "hyphen"))]
    words = _with_misread(p).select("src", "rec_id", "line_no", F.lit("misread").alias("fault"))
    out = words
    for s in simple:
        out = out.unionByName(s)
    return out.distinct()


def restored(df: DataFrame) -> DataFrame:
    """src, rec_id and the text in continuous paragraphs, for every text that is not null.

    Furniture goes, broken words are joined, misread words are corrected, and the lines of a
    paragraph are put together; texts that were not scanned stay as they are.
    """
    p = stored(parts(df), "p3-parts")
    fix = _with_misread(p).groupBy("src", "rec_id").agg(F.collect_list(F.struct("line_no", "word", "correction")).alias("fix"))
    both = df.filter(F.col("text").isNotNull()).join(p.select("src", "rec_id", "pageno", "header", "hyphen", "goes_on"), ["src", "rec_id"], "left").join(fix, ["src", "rec_id"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_restore(*r) for r in zip(*(b.column(k).to_pylist() for k in ("text", "scanned", "pageno", "header", "hyphen", "goes_on", "fix")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("src"), b.column("rec_id"), pa.array(out, pa.string())], names=["src", "rec_id", "restored"])

    return both.select("src", "rec_id", "text", "scanned", "pageno", "header", "hyphen", "goes_on", "fix").mapInArrow(run, "src string, rec_id long, restored string")


def _like(word: str, correction: str) -> str:
    return correction.upper() if word.isupper() and len(word) > 1 else correction[:1].upper() + correction[1:] if word[:1].isupper() else correction


def _restore(text: str, scanned: bool, pageno: list | None, header: list | None, hyphen: list | None, goes_on: list | None, fix: list | None) -> str:
    if pageno is None or not (scanned or pageno or header or hyphen or fix):
        return text
    lines = [x.strip() for x in text.split("\n")]
    joins = dict(zip(hyphen or [], goes_on or [], strict=True))
    drop = {*(pageno or []), *(header or [])}
    for i, j in joins.items():
        m = re.match(r"\S+", lines[j - 1])
        if m:
            lines[i - 1] = lines[i - 1].rstrip(HYPHENS) + m[0]
            lines[j - 1] = lines[j - 1][m.end() :].lstrip()
    swap = {f["word"]: f["correction"] for f in fix or []}
    if swap:
        lines = [re.sub(r"[^\W_]+", lambda m: _like(m[0], swap[m[0].lower()]) if m[0].lower() in swap else m[0], x) for x in lines]
    paragraphs: list[list[str]] = [[]]
    cut = False
    for k, x in enumerate(lines, 1):
        if k in drop:
            cut = True
            continue
        if not x:
            # a blank line beside furniture does not end a paragraph whose sentence goes on
            if not cut and paragraphs[-1]:
                paragraphs.append([])
            continue
        if cut and paragraphs[-1] and paragraphs[-1][-1][-1:] in ".!?" and x[:1].isupper() and not lines[k - 2]:
            paragraphs.append([])
        cut = False
        paragraphs[-1].append(x)
    return "\n\n".join(" ".join(x) for x in paragraphs if x)
