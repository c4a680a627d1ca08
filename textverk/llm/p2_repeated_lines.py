"""Lines repeated across the documents of one source.

Each document's letters are cut into content-defined chunks: a position is cut if the rolling
hash of the letters around it is the greatest of its neighbourhood, so cuts follow the content
and not the layout, and a chunk has some forty letters. Where a line ends a chunk ends too,
since the result asked for is defined by lines. Distinct documents are counted per (source,
chunk), and chunks found in at least ``min_docs`` documents and ``min_share`` of the source's
documents are repeated.

A line of ``min_letters`` to ``max_letters`` letters all of whose chunks are repeated is a
candidate; that the line as a whole is repeated is then checked exactly, on the candidates
alone. Of longer lines (unwrapped paragraphs) each run of repeated chunks of more than
``max_letters`` letters is a case.

Cases: a null or blank text has no chunk; a document without a source is left out; repeated
deliveries of one document count once, and every delivery's lines are reported; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textverk.llm.kernel import Fold, codes_of, lines_of, mix, slices, span_hashes
from textverk.session import small, stored
from textverk.sources.tables import spread

WINDOW, REACH = 8, 20  # letters in the rolling window; letters to either side over which it must be greatest

CHUNKS = "rec_id long, doc string, line_no array<int>, l_start array<int>, l_end array<int>, l_hash array<long>, parts array<int>, line array<int>, c_start array<int>, c_end array<int>, letters array<int>, hash array<long>"


def _greatest(x: np.ndarray, reach: int) -> np.ndarray:
    """Whether each value is greater than those before it and not less than those after it
    within ``reach`` places, edges being less than any."""
    out = np.ones(len(x), dtype=bool)
    for k in range(1, reach + 1):
        if k < len(x):
            out[k:] &= x[k:] > x[:-k]
            out[:-k] &= x[:-k] >= x[k:]
    return out


def chunk_texts(texts: list[str], fold: Fold, lo: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Lines (number, start, end, hash, chunks) and chunks (place of the line in its text, start,
    end, letters, hash) of all texts, positions being characters of the text, with the number of
    lines and of chunks up to each text. Only lines of at least ``lo`` letters."""
    codes, off = codes_of(texts)
    start, end, rec, number = lines_of(codes, off) if len(codes) else (np.zeros(0, dtype=np.int64),) * 4
    at = np.flatnonzero(fold(codes)) if len(codes) else np.zeros(0, dtype=np.int64)
    letters = fold(codes)[at] if len(codes) else codes
    a, b = np.searchsorted(at, start), np.searchsorted(at, end)
    keep = b - a >= lo
    a, b, rec, number, start, end = (x[keep] for x in (a, b, rec, number, start, end))
    n = len(letters)
    cuts = np.zeros(0, dtype=np.int64)
    if n > WINDOW:
        roll = span_hashes(letters, np.arange(n - WINDOW + 1), np.arange(WINDOW, n + 1))
        # a cut lies in the middle of its window; all that decides it must be letters of one line
        cuts = np.flatnonzero(_greatest(roll, REACH)) + WINDOW // 2
        home = np.searchsorted(a, cuts, side="right") - 1
        span = WINDOW // 2 + REACH
        ok = home >= 0
        ok[ok] = (cuts[ok] - span >= a[home[ok]]) & (cuts[ok] + span <= b[home[ok]])
        cuts = cuts[ok]
    edges = np.unique(np.concatenate([a, cuts]))
    line = np.searchsorted(a, edges, side="right") - 1
    stop = np.append(edges[1:], n)
    stop = np.minimum(stop, b[line]) if len(line) else stop[:0]
    h_line = mix(span_hashes(letters, a, b) ^ (b - a).astype(np.uint64)).view(np.int64)
    h_part = mix(span_hashes(letters, edges, stop) ^ (stop - edges).astype(np.uint64)).view(np.int64)
    parts = np.bincount(line, minlength=len(a))
    n_lines = np.searchsorted(rec, np.arange(len(texts) + 1))
    n_parts = np.concatenate([[0], np.cumsum(parts)])[n_lines]
    base = off[rec] if len(rec) else off[:0]
    first = n_lines[rec][line] if len(line) else line
    return (
        [number, start - base, end - base, h_line, parts],
        [line - first, at[edges] - base[line], at[stop - 1] + 1 - base[line], stop - edges, h_part] if len(line) else [line] * 5,
        n_lines,
        n_parts,
    )


def chunks(df: DataFrame, rec: str, doc: str, text: str, min_letters: int = 8) -> DataFrame:
    """One row per record with the arrays of its lines and of its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold("L")
        i32, i64 = pa.int32(), pa.int64()
        for batch in batches:
            ids, docs, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for i, j in slices(texts):
                lines, parts, n_lines, n_parts = chunk_texts(texts[i:j], fold, min_letters)
                cols = [pa.ListArray.from_arrays(pa.array(n.astype(np.int32)), pa.array(x.astype(t.to_pandas_dtype()), type=t)) for n, xs, ts in ((n_lines, lines, (i32, i32, i32, i64, i32)), (n_parts, parts, (i32, i32, i32, i32, i64))) for x, t in zip(xs, ts, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), docs.slice(i, j - i), *cols], names=["rec_id", "doc", "line_no", "l_start", "l_end", "l_hash", "parts", "line", "c_start", "c_end", "letters", "hash"])

    src = df.filter(F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(rec).cast("long"), F.col(doc).cast("string"), F.col(text))
    return spread(src, rec).mapInArrow(run, CHUNKS)


def _hot(places: DataFrame, per_source: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """source, h, n_docs, n_source_docs of the hashes found in enough of a source's documents, from
    (source, sdoc, h). A document's copies of a hash are made one before the shuffle by (source, h)."""
    n = places.groupBy("sdoc", "source", "h").agg(F.lit(1).alias("one")).groupBy("source", "h").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    return n.join(per_source, "source").filter(F.col("n_docs") >= F.col("n_source_docs") * F.lit(min_share))


def repeated(df: DataFrame, sources: DataFrame, rec: str, doc: str, text: str, *, min_docs: int = 5, min_share: float = 0.2, min_letters: int = 8, max_letters: int = 150) -> DataFrame:
    """Every place of a repeated line or run: rec_id, doc, source, line_no, whole, c_start, c_end,
    n_docs, n_source_docs; n_docs of a run is that of its rarest chunk.

    ``sources`` has (doc, source), one row a document. The chunk table is written once. Joining
    on the document keeps a document's records together, so distinct documents are counted
    before the one shuffle by (source, chunk), and a hot source or chunk is pre-aggregated. The
    repeated chunks are hash-joined to their places by (source, chunk); a chunk that a third of
    all rows hold has one row on the other side, and its places may be split.
    """
    sources = sources.filter(F.col("source").isNotNull()).select(F.col("doc").alias("sdoc"), "source")
    recs = stored(chunks(df, rec, doc, text, min_letters), "p2-chunks")
    per_source = df.select(F.col(doc).cast("string").alias("sdoc")).distinct().join(sources, "sdoc").groupBy("source").agg(F.count(F.lit(1)).alias("n_source_docs"))
    by_doc = recs.select(F.col("doc").alias("sdoc"), "hash").join(sources.hint("merge"), "sdoc")
    hot = stored(_hot(by_doc.select("source", "sdoc", F.explode("hash").alias("h")), per_source, min_docs, min_share), "p2-chunks-hot")

    of = recs.withColumnRenamed("doc", "sdoc").join(small(sources), "sdoc")
    places = of.select("rec_id", "sdoc", "source", "line_no", "l_start", "l_end", "l_hash", "parts", F.posexplode(F.arrays_zip("line", "c_start", "c_end", "letters", "hash")).alias("k", "c"))
    at = lambda c: F.get(c, F.col("c.line"))
    places = places.select(
        "rec_id", "sdoc", "source", F.col("k"), F.col("c.line").alias("line"), F.col("c.c_start").alias("c_start"), F.col("c.c_end").alias("c_end"), F.col("c.letters").alias("letters"), F.col("c.hash").alias("h"),
        at("line_no").alias("line_no"), at("l_start").alias("l_start"), at("l_end").alias("l_end"), at("l_hash").alias("l_hash"), at("parts").alias("parts"),
    )
    hit = stored(places.join(small(hot), ["source", "h"]), "p2-hits")

    # lines all of whose chunks are repeated; then the line itself, exactly
    keys = ["rec_id", "sdoc", "source", "line", "line_no", "l_start", "l_end", "l_hash", "parts"]
    lines = hit.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("letters").alias("letters")).filter((F.col("n") == F.col("parts")) & (F.col("letters") <= max_letters))
    lines = stored(lines.withColumnRenamed("l_hash", "h"), "p2-lines")
    exact = _hot(lines.select("source", "sdoc", "h"), per_source, min_docs, min_share)
    whole = lines.join(exact, ["source", "h"]).select("rec_id", F.col("sdoc").alias("doc"), "source", "line_no", F.lit(True).alias("whole"), F.col("l_start").alias("c_start"), F.col("l_end").alias("c_end"), "n_docs", "n_source_docs")

    # runs of repeated chunks in longer lines
    order = W.partitionBy("rec_id", "line").orderBy("k")
    run = hit.filter("parts > 1").withColumn("run", F.col("k") - F.row_number().over(order))
    run = run.groupBy("rec_id", F.col("sdoc").alias("doc"), "source", "line", "line_no", "run").agg(F.min("c_start").alias("c_start"), F.max("c_end").alias("c_end"), F.sum("letters").alias("letters"), F.min("n_docs").alias("n_docs"), F.max("n_source_docs").alias("n_source_docs"))
    run = run.filter(F.col("letters") > max_letters).select("rec_id", "doc", "source", "line_no", F.lit(False).alias("whole"), "c_start", "c_end", "n_docs", "n_source_docs")
    return whole.unionByName(run)


def cut(df: DataFrame, places: DataFrame, rec: str, text: str) -> DataFrame:
    """rec_id and the text without the repeated chunks; a text of which nothing is left is ''.

    A removed whole line takes its line end with it.
    """
    spans = places.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("c_start", "c_end", "whole"))).alias("spans"))
    src = df.select(F.col(rec).cast("long").alias("rec_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, spans_ in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                at, kept = 0, []
                for s in spans_ or []:
                    kept.append(t[at : s["c_start"]])
                    at = s["c_end"]
                    if s["whole"]:
                        at = t.find("\n", at) + 1 or len(t)
                out.append(None if t is None else "".join(kept) + t[at:])
            yield pa.RecordBatch.from_arrays([b.column("rec_id"), pa.array(out, type=pa.string()), pa.array([len(x or []) for x in b.column("spans").to_pylist()], type=pa.int32())], names=["rec_id", "clean_text", "n_cut"])

    return src.join(spans, "rec_id", "left").select("rec_id", "text", "spans").mapInArrow(run, "rec_id long, clean_text string, n_cut int")
