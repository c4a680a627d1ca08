"""Sentence boundaries across languages and scripts.

The rules are a finite transducer (``p7_rules``). The rows of a document are cut into chunks
of ``CHUNK`` consecutive numbers; every chunk is processed once, as a function from the state
before it to the state after it, and the functions are composed by a prefix scan over the
document's chunks, so one huge document is spread over tasks. States soon agree whatever they
came from, so only the first rows of a later chunk are run for several states.

Cases: null text has no sentence; a row number that is missing leaves the state LOST; rows
repeated as they are count once; rows without a number stand alone; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textverk.llm.p7_rules import ENDED, LOST, STATES, step
from textverk.session import stored

CHUNK = 512
ALL = -1  # a start that holds whatever the state before the chunk was
OUT = "doc string, chunk long, sid int, state int, starts array<int>, fn array<int>"


def _chunks(rows: DataFrame) -> DataFrame:
    """(doc, sid, text) to starts by row and one function a chunk."""
    # rows without a number stand alone, so they may lie anywhere
    chunk = F.coalesce(F.floor((F.col("sid") - 1) / CHUNK), F.lit(-1) - F.pmod(F.xxhash64("text"), F.lit(1 << 20))).cast("long")
    src = rows.filter(F.col("text").isNotNull()).select("doc", chunk.alias("chunk"), "sid", "text")
    src = src.repartition("doc", "chunk").sortWithinPartitions("doc", "chunk", "sid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        live: dict[int, int] = {}  # state before the chunk -> state now
        last: tuple = ()
        out: list[tuple] = []

        def close() -> None:
            if key is not None and key[1] >= 0:
                whole = last and last[0] == (key[1] + 1) * CHUNK
                fn = [live[s] if s in live else live[ALL] for s in range(STATES)]
                out.append((key[0], key[1], None, ALL, None, fn if whole else [LOST] * STATES))

        for b in batches:
            for d, c, s, t in zip(*(b.column(k).to_pylist() for k in ("doc", "chunk", "sid", "text")), strict=True):
                if (d, c) != key:
                    close()
                    key, last = (d, c), ()
                    if c > 0 and s == c * CHUNK + 1:
                        live = dict.fromkeys(range(STATES)) | {k: k for k in range(STATES)}
                    else:
                        live = {ALL: ENDED if s == 1 else LOST}
                if s is not None and last == (s, t):
                    continue  # repeated as it is
                if s is None:
                    live = {ALL: LOST}
                elif last and last[0] not in (s, s - 1):
                    live = {ALL: LOST}
                last = (s, t)
                got = {k: step(t, v) for k, v in live.items()}
                first = next(iter(got.values()))
                if all(g[0] == first[0] for g in got.values()):
                    if first[0]:
                        out.append((d, c, s, ALL, [x + 1 for x in first[0]], None))
                else:
                    out.extend((d, c, s, k, [x + 1 for x in g[0]], None) for k, g in got.items() if g[0])
                ends = {k: g[1] for k, g in got.items()}
                live = {ALL: first[1]} if len(set(ends.values())) == 1 else ends
            yield _batch(out)
            out = []
        close()
        if out:
            yield _batch(out)

    return src.mapInArrow(run, OUT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc", "chunk", "sid", "state", "starts", "fn"])


def _before(fns: DataFrame) -> DataFrame:
    """doc, chunk and the state before each chunk > 0: a prefix scan by doubling.

    After round k each chunk holds the composition of the 2**k functions up to it. Before the
    first chunk of a document the state is ENDED, and after a chunk that is wholly missing it is
    LOST: such a chunk's function is the constant that it gives there.
    """
    have = fns.select("doc", (F.col("chunk") + 1).alias("chunk"), F.lit(True).alias("follows"))
    fixed = F.get("fn", F.when(F.col("chunk") == 0, F.lit(ENDED)).otherwise(F.lit(LOST)))
    cur = fns.join(have, ["doc", "chunk"], "left").select("doc", "chunk", F.when(F.col("follows"), F.col("fn")).otherwise(F.transform("fn", lambda _: fixed)).alias("fn"))
    cur = stored(cur, "p7-scan")
    top = cur.agg(F.max("chunk")).first()[0] or 0
    gap = 1
    while gap <= top:
        prev = cur.select("doc", (F.col("chunk") + gap).alias("chunk"), F.col("fn").alias("f0"))
        both = cur.join(prev, ["doc", "chunk"], "left")
        cur = stored(both.select("doc", "chunk", F.when(F.col("f0").isNull(), F.col("fn")).otherwise(F.transform("f0", lambda s: F.get("fn", s))).alias("fn")), "p7-scan")
        gap *= 2
    return cur.select("doc", (F.col("chunk") + 1).alias("chunk"), F.get("fn", F.lit(ENDED)).alias("before"))


def starts(rows: DataFrame) -> DataFrame:
    """doc, sid, start: the position from 1 of every sentence start, rows distinct."""
    got = stored(_chunks(rows), "p7-chunks")
    sure = got.filter(F.col("fn").isNull() & (F.col("state") == ALL)).select("doc", "sid", F.explode("starts").alias("start"))
    open_ = got.filter(F.col("fn").isNull() & (F.col("state") != ALL))
    if not open_.isEmpty():
        before = _before(got.filter(F.col("fn").isNotNull()))
        more = open_.join(before, ["doc", "chunk"], "left").filter(F.col("state") == F.coalesce("before", F.lit(LOST)))
        sure = sure.unionByName(more.select("doc", "sid", F.explode("starts").alias("start")))
    return sure.distinct()


def sentences(rows: DataFrame) -> DataFrame:
    """doc, new sentence_id from 1, and the sentence's text, for all text of the rows.

    Text before a document's first start (of which the beginning is lost) has number 0.
    Numbers are counted by chunk first, so no document is numbered in one task.
    """
    text = rows.filter("text IS NOT NULL AND sid IS NOT NULL").groupBy("doc", "sid").agg(F.min("text").alias("text"))
    at = starts(rows).groupBy("doc", "sid").agg(F.array_sort(F.collect_list("start")).alias("at"))
    none = F.array().cast("array<int>")
    piece = text.join(at, ["doc", "sid"], "left").withColumn("at", F.coalesce("at", none))
    cut = F.array_distinct(F.concat(F.array(F.lit(1)), "at"))
    pieces = stored(
        piece.withColumn("cut", cut).select("doc", "sid", "text", "at", F.col("cut"), F.posexplode("cut").alias("k", "b"))
        .select("doc", "sid", F.floor((F.col("sid") - 1) / CHUNK).alias("chunk"), "k", F.substr("text", F.col("b"), F.coalesce(F.get("cut", F.col("k") + 1), F.length("text") + 1) - F.col("b")).alias("part"), F.array_contains("at", F.col("b")).cast("int").alias("new")),
        "p7-pieces",
    )
    per = pieces.groupBy("doc", "chunk").agg(F.sum("new").alias("n"))
    base = per.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("doc").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("doc", "chunk", "base")
    run = F.sum("new").over(W.partitionBy("doc", "chunk").orderBy("sid", "k"))
    numbered = pieces.withColumn("run", run).join(base, ["doc", "chunk"]).withColumn("sentence_id", (F.col("base") + F.col("run")).cast("int"))
    return (
        numbered.groupBy("doc", "sentence_id").agg(F.array_sort(F.collect_list(F.struct("sid", "k", "part"))).alias("parts"))
        .select("doc", "sentence_id", F.trim(F.concat_ws(" ", F.transform("parts", lambda p: F.trim(p["part"])))).alias("sentence"))
    )
