"""Occurrences and record counts of every term, kept up to date by signed deltas.

A batch of added, changed or deleted records is a feed of signed rows: the old rows of a
record that is deleted or changed have the sign -1, the new ones of a record that is added
or changed +1. The feed becomes changes per term, which are merged into persistent counts,
partitioned by a hash of the term. ``State`` keeps the counts, and a hash of each record, in a
folder, a version a batch. ``changes`` makes the feed from two snapshots: records whose hash
is the one that is kept are neither joined nor counted.

Cases: a null text has no terms; a null record id belongs to no record and is left out; of
rows with the same (record, unit) the smallest text counts once, rows with a null unit being
one unit; a term whose occurrences fall to zero disappears; an empty feed leaves the counts
as they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textverk.llm.kernel import Fold, codes_of, slices, span_hashes, words_of
from textverk.session import small, stored

TERMS_PER_BUCKET = 1_000_000  # of the persistent counts; the number of buckets follows from it
UNITS_PER_CHUNK = 256  # units of a record counted in one place; more are split and joined again


def _normal(t: str) -> str:
    return (t if t.isascii() else unicodedata.normalize("NFC", t)).lower()


def _count(texts: list[str], group: np.ndarray, marks: Fold) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(group, term index, occurrences) of the terms of the texts, and the terms."""
    joined = [_normal(t) for t in texts]
    codes, off = codes_of(joined)
    on = marks(codes)
    s, e, rec = words_of(on, off)
    if not len(s):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, []
    h = span_hashes(codes, s, e)
    _, first, idx = np.unique(h, return_index=True, return_inverse=True)
    flat = "".join(joined)
    terms = [flat[i:j] for i, j in zip(s[first].tolist(), e[first].tolist(), strict=True)]
    pair, n = np.unique(group[rec] * len(terms) + idx, return_counts=True)
    return pair // len(terms), pair % len(terms), n, terms


class _Class(Fold):
    """Keeps code points of the wanted categories as they are."""

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        known = self.known[codes]
        if not known.all():
            for c in np.unique(codes[~known]).tolist():
                if unicodedata.category(chr(c))[0] in self.categories:
                    self.table[c] = 1
                self.known[c] = True
        return self.table[codes]


def term_deltas(records: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """term, d_occ, d_recs from records(rec string, unit long, text string, sign int).

    ``scope`` (rec) restricts the records. A record's units are counted together, 256 at a
    time, so a huge record is split over tasks; only the terms of such records are shuffled
    once more to count the record once. All others leave their task already added up.
    """
    rows = records.filter(F.col("rec").isNotNull())
    if scope is not None:
        rows = rows.join(scope.select("rec").distinct(), "rec", "left_semi")
    chunk = F.coalesce(F.floor(F.col("unit") / UNITS_PER_CHUNK), F.lit(0)).cast("long")
    no_unit = rows.filter("unit IS NULL").groupBy("rec", "sign").agg(F.min("text").alias("text")).select("rec", "sign", F.lit(None).cast("long").alias("unit"), "text")
    rows = rows.filter("unit IS NOT NULL").select("rec", "sign", "unit", "text").unionByName(no_unit).withColumn("chunk", chunk)
    # one marker a chunk that has rows; it tells whether the record lies in several
    marks = rows.groupBy("rec", "sign", "chunk").agg(F.count(F.lit(1)).alias("n"))
    many = F.count(F.lit(1)).over(W.partitionBy("rec", "sign")) > 1  # chunks of a record, a row per 256 units
    marks = marks.select("rec", "sign", "chunk", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("unit"), F.when(many, "m").alias("text"))
    body = rows.filter(F.col("text").isNotNull()).select("rec", "sign", "chunk", F.lit(1).alias("kind"), "unit", "text")
    both = marks.unionByName(body).repartition("rec", "sign", "chunk").sortWithinPartitions("rec", "sign", "chunk", "kind", "unit", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, gone = _Class("LM"), None  # gone: key of the group that is open, and its state
        live = many = False
        last: object = None

        def emit(texts: list[str], group: list[int], keys: list[tuple]) -> Iterator[pa.RecordBatch]:
            for i, j in slices_by_group(texts, group):
                g, t, n, terms = _count(texts[i:j], np.array(group[i:j], dtype=np.int64), cls)
                if not len(g):
                    continue
                sign = np.array([k[1] for k in keys], dtype=np.int64)[g]
                split = np.array([k[2] for k in keys], dtype=bool)[g]
                occ = np.bincount(t[~split], weights=(n * sign)[~split], minlength=len(terms)).astype(np.int64)
                rec = np.bincount(t[~split], weights=sign[~split], minlength=len(terms)).astype(np.int64)
                hit = np.unique(t[~split])
                names = np.array(terms, dtype=object)
                yield _batch([None] * len(hit), names[hit], occ[hit], rec[hit])
                if split.any():
                    yield _batch([keys[k][0] for k in g[split].tolist()], names[t[split]], (n * sign)[split], sign[split])

        held_t: list[str] = []
        held_g: list[int] = []
        keys: list[tuple] = []
        size = 0
        for b in batches:
            recs, signs, ch, kinds, units, texts = (b.column(k).to_pylist() for k in ("rec", "sign", "chunk", "kind", "unit", "text"))
            for r, s, c, k, u, t in zip(recs, signs, ch, kinds, units, texts, strict=True):
                if (r, s, c) != gone:
                    if size > 1_500_000:
                        yield from emit(held_t, held_g, keys)
                        held_t, held_g, keys, size = [], [], [], 0
                    gone, live, many, last = (r, s, c), False, False, ()
                if k == 0:
                    live, many = True, t is not None
                    keys.append((r, s, many))
                elif live and u != last:
                    last = u
                    held_t.append(t)
                    held_g.append(len(keys) - 1)
                    size += len(t)
        yield from emit(held_t, held_g, keys)

    got = both.mapInArrow(run, "rec string, term string, d_occ long, d_recs long")
    per = got.groupBy("rec", "term", F.signum("d_recs").alias("sg")).agg(F.sum("d_occ").alias("d_occ"), F.sum("d_recs").alias("n"), F.max("d_recs").alias("hi"), F.min("d_recs").alias("lo"))
    once = F.when(F.col("rec").isNull(), F.col("n")).when(F.col("sg") > 0, F.col("hi")).otherwise(F.col("lo"))
    return per.select("term", "d_occ", once.alias("d_recs")).groupBy("term").agg(F.sum("d_occ").alias("d_occ"), F.sum("d_recs").alias("d_recs"))


def slices_by_group(texts: list[str], group: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges that never divide a group, of some 1.5 million characters at least but for the last."""
    a = n = 0
    for i, t in enumerate(texts):
        if n > 1_500_000 and group[i] != group[i - 1]:
            yield a, i
            a, n = i, 0
        n += len(t)
    if a < len(texts):
        yield a, len(texts)


def _batch(rec: list, term: np.ndarray, occ: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rec, pa.string()), pa.array(term, pa.string()), pa.array(occ, pa.int64()), pa.array(n, pa.int64())], names=["rec", "term", "d_occ", "d_recs"])


def hashes(rows: DataFrame) -> DataFrame:
    """rec and a hash of its distinct rows (unit, text), whatever their order. What is shuffled
    is a number a row, not text."""
    one = rows.filter("rec IS NOT NULL").select("rec", "unit", F.xxhash64("text").alias("h"), F.col("text").isNull().alias("none"))
    return one.distinct().groupBy("rec").agg(F.sum(F.xxhash64("unit", "h", "none").cast("decimal(38,0)")).alias("hash"))


def changes(before: DataFrame | None, after: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Signed rows of the records that differ between two snapshots (rec, unit, text).

    ``known`` (rec, hash) are the kept hashes of ``before``; without it they are computed. Only
    hashes are joined; then both snapshots are reduced to the records that differ by semi-joins
    on their ids, so unchanged records' texts are neither shuffled for the counts nor cut into
    terms.
    """
    new = after.select("rec", "unit", "text", F.lit(1).alias("sign"))
    if before is None:
        return new
    old = before.select("rec", "unit", "text", F.lit(-1).alias("sign"))
    was = (hashes(before) if known is None else known.select("rec", "hash")).withColumnRenamed("hash", "was")
    both = was.join(hashes(after), "rec", "full_outer")
    differs = small(stored(both.filter(~F.col("was").eqNullSafe(F.col("hash"))).select("rec"), "p5-differs"))
    return old.join(differs, "rec", "left_semi").unionByName(new.join(differs, "rec", "left_semi"))


def merge(counts: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """term, occurrences, records after the changes; terms that are gone are left out."""
    add = deltas.select("term", F.col("d_occ").alias("occurrences"), F.col("d_recs").alias("records"))
    if counts is not None:
        add = counts.select("term", "occurrences", "records").unionByName(add).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return add.filter(F.col("occurrences") != 0)


class State:
    """Counts and record hashes in the folder ``path``: a version a batch, each written whole
    before ``current`` names it, so a batch that fails leaves the last version as it was."""

    TABLES = {"counts": "term string, occurrences long, records long, bucket int", "records": "rec string, hash decimal(38,0)"}

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    @property
    def version(self) -> int:
        """The last version that was written whole; 0 if there is none."""
        at, fs = self._fs("done")
        return max((int(f.getPath().getName()) for f in fs.listStatus(at)), default=0) if fs.exists(at) else 0

    def _read(self, name: str) -> DataFrame | None:
        v = self.version
        return self.spark.read.schema(self.TABLES[name]).parquet(f"{self.path}/{name}/version={v}") if v else None

    def counts(self) -> DataFrame | None:
        """term, occurrences, records, bucket."""
        return self._read("counts")

    def records(self) -> DataFrame | None:
        """rec, hash of the records that are counted."""
        return self._read("records")

    def apply(self, feed: DataFrame) -> int:
        """Counts a feed (rec, unit, text, sign) in; gives the new version."""
        v = self.version + 1
        total = stored(merge(self.counts(), term_deltas(feed)), "p5-merged")
        buckets = max(1, -(-total.count() // TERMS_PER_BUCKET))
        total = total.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        total.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/counts/version={v}")
        gone = feed.filter("sign < 0").select("rec").distinct()
        new = hashes(feed.filter("sign > 0"))
        old = self.records()
        kept = new if old is None else old.join(gone, "rec", "left_anti").unionByName(new)
        kept.write.mode("overwrite").parquet(f"{self.path}/records/version={v}")
        at, fs = self._fs(f"done/{v}")
        fs.create(at).close()
        return v


def mark(counts: DataFrame, n_records: DataFrame, min_occ: int = 4, min_recs: int = 2, max_share: float = 0.3) -> DataFrame:
    """Adds ``mark``: rare, common or null. ``n_records`` is one row with column n."""
    rare = (F.col("occurrences") < min_occ) | (F.col("records") < min_recs)
    common = F.col("records") > F.col("n") * F.lit(max_share)
    return counts.crossJoin(F.broadcast(n_records)).withColumn("mark", F.when(rare, "rare").when(common, "common")).select("term", "occurrences", "records", "mark")
