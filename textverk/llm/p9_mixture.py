"""Mixing sources to target shares of the tokens.

Each source first gets its part of the whole: in proportion to its target, but never more
than its texts give at their cap of repeats; what a source at its cap cannot give is taken
up by the others in proportion to their targets. ``total`` is the size of the whole: by
default every text once, which the sources with room make up by repeats; with ``EXACT`` the
largest size at which no source is at its cap, so that all targets are met.

Token masses of the cells (source, language, topic) are then raked by iterative proportional
fitting to these parts and to the language and topic shares of the corpus; no cell's weight
may exceed its source's cap, and what a cap cuts off is taken up by the source's other cells.
Documents are drawn by calibrated probabilities: weight w gives floor(w) copies and one more
with the probability of the rest, decided by a hash. Per source, sums by step of the hash
give the threshold under which the source's tokens come out right; the small gap that is
left at the threshold is filled with the next documents that fit.

Where a hash of the text is given, a unit is a text of a source, not a row: copies under other
ids are one unit, which counts once as room, has the source's cap of repeats and bears the
smallest id and that row's language and topic. A text that two sources hold is a unit of each,
under each source's own cap; ``shares`` tells its uses over all sources too.

Cases: null texts are left out, texts without tokens are never drawn; null language and topic
are values of their own; sources without a target are not used; a target whose source has no
tokens is reported with share 0 and the others keep their proportions; a source that has
tokens is never left out, though its part be smaller than its smallest text; targets are
scaled to sum to 1; ties of the hash are drawn alike; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textverk.session import stored

EXACT = -1.0  # a total at which every source reaches its target
STEPS = 4096  # steps of the hash threshold, from 0 to twice the expected one
FILL = 512  # documents of a source that are tried for the gap at its threshold


def allot(have: pd.Series, caps: pd.Series, share: pd.Series, total: float | None = None) -> pd.Series:
    """Tokens of each source in the whole: min(cap, its target's part), adding up to ``total``
    or to all that the caps give."""
    most, share = have * caps, share / share.sum()
    want = float(have.sum()) if total is None else float((most / share).min()) if total == EXACT else float(total)
    full = pd.Series(False, index=share.index)
    while True:
        rest = want - float(most[full].sum())
        part = share.where(~full, 0.0)
        got = most.where(full, part * (rest / part.sum() if part.sum() else 0.0))
        over = ~full & (got > most * (1 + 1e-12))
        if not over.any():
            return got
        full |= over


def rake(cells: pd.DataFrame, targets: pd.DataFrame, total: float | None = None, rounds: int = 200) -> tuple[pd.DataFrame, pd.Series]:
    """Adds ``weight`` (expected copies of a document) to cells(source, language, topic,
    tokens); also gives each source's tokens of the whole. Few rows: one a cell."""
    c = cells.merge(targets, on="source")
    c = c[c["tokens"] > 0].copy()
    if c.empty:
        return c.assign(weight=0.0), pd.Series(dtype=float)
    have = c.groupby("source")["tokens"].sum().astype(float)
    caps = c.groupby("source")["max_repeats"].first().astype(float)
    part = allot(have, caps, c.groupby("source")["target_share"].first(), total)
    whole = float(part.sum())
    goal = {"source": part, **{k: c.groupby(k)["tokens"].sum() / c["tokens"].sum() * whole for k in ("language", "topic")}}
    cap = c["source"].map(caps).to_numpy()
    t = c["tokens"].to_numpy(dtype=float)
    w = c["source"].map(part / have).to_numpy()
    for _ in range(rounds):
        old = w.copy()
        for k in ("language", "topic", "source"):
            now = pd.Series(w * t).groupby(c[k].to_numpy()).sum()
            w = w * (c[k].map(goal[k] / now)).fillna(0.0).to_numpy()
        for _ in range(20):  # caps, and the source totals beside them
            w = np.minimum(w, cap)
            now = pd.Series(w * t).groupby(c["source"].to_numpy()).sum()
            loose = w < cap * (1 - 1e-12)
            free = pd.Series(w * t * loose).groupby(c["source"].to_numpy()).sum()
            need = (part - now).reindex(free.index)
            up = (1 + need / free.where(free > 0)).fillna(1.0)
            w = np.where(loose, w * c["source"].map(up).to_numpy(), w)
            if float(need.abs().max()) < 1e-6 * whole:
                break
        w = np.minimum(w, cap)
        if float(np.abs(w - old).max()) < 1e-9:
            break
    return c.assign(weight=w), part


def units(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a unit of the target sources: doc_id, source, language, topic, n_tokens and, if
    ``sizes`` has it, text_hash. Stored, so texts are sized once."""
    key = ["text_hash"] if "text_hash" in sizes.columns else []
    want = F.broadcast(targets.filter("source IS NOT NULL AND target_share > 0").select("source").distinct())  # a row a target
    x = sizes.join(want, "source", "left_semi").select("doc_id", "source", F.coalesce("language", F.lit("?")).alias("language"), F.coalesce("topic", F.lit("?")).alias("topic"), "n_tokens", *key)
    if key:
        one = F.min(F.struct("doc_id", "language", "topic", "n_tokens")).alias("one")
        x = x.groupBy("source", "text_hash").agg(one).select("one.doc_id", "source", "one.language", "one.topic", "one.n_tokens", "text_hash")
    return stored(x, "p9-units")


def mixture(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """doc_id, source, n_tokens, copies: how often each document is used (0 is left out); and
    text_hash, if ``sizes`` has it.

    ``sizes`` has (doc_id, source, language, topic, n_tokens) and perhaps text_hash, without
    which every row is a text of its own. Only the sums by cell reach the driver: sources with
    a target times languages times topics, whatever the corpus.
    """
    spark = sizes.sparkSession
    key = ["text_hash"] if "text_hash" in sizes.columns else []
    want = targets.filter("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    base = units(sizes, targets).filter("n_tokens > 0")
    cells = base.groupBy("source", "language", "topic").agg(F.sum("n_tokens").alias("tokens")).toPandas()
    fitted, part = rake(cells, want.toPandas(), total)
    if fitted.empty:
        return base.select("doc_id", "source", "n_tokens", F.lit(0).alias("copies"), *key).limit(0)
    goals = F.broadcast(spark.createDataFrame([(k, float(v)) for k, v in part.items()], "source string, goal double"))  # a row a target
    weights = F.broadcast(spark.createDataFrame(fitted[["source", "language", "topic", "weight", "max_repeats"]]))  # a row a cell
    u = F.pmod(F.xxhash64("doc_id", "n_tokens", F.lit(9)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    x = base.join(weights, ["source", "language", "topic"]).withColumn("sure", F.floor(F.col("weight") + 1e-9).cast("int"))
    # rank within the draw: the hash, stretched by the probability of one more copy
    rank = u / F.greatest(F.col("weight") - F.col("sure"), F.lit(1e-9))
    more = F.col("sure") < F.col("max_repeats")
    x = x.select("doc_id", "source", "n_tokens", "sure", rank.alias("rank"), F.when(more, F.least(F.floor(rank * (STEPS // 2)), F.lit(STEPS))).alias("step"), *key)

    sums = x.groupBy("source", "step").agg(F.sum(F.col("sure") * F.col("n_tokens")).alias("sure"), F.sum("n_tokens").alias("n"))
    by = W.partitionBy("source")  # at most STEPS + 2 rows a source
    run = F.sum(F.when(F.col("step").isNotNull(), F.col("n"))).over(by.orderBy(F.asc_nulls_first("step")).rowsBetween(W.unboundedPreceding, 0))
    sums = sums.select("source", "step", F.coalesce(run, F.lit(0)).alias("run"), F.sum("sure").over(by).alias("sure")).join(goals, "source")
    fits = F.col("run") <= F.col("goal") - F.col("sure") + 0.5
    edge = sums.groupBy("source").agg(F.max(F.when(fits, F.col("step"))).alias("edge"), F.coalesce(F.max(F.when(fits, F.col("run"))), F.lit(0)).alias("drawn"), F.first("sure").alias("base"), F.first("goal").alias("goal"))
    edge = stored(edge.select("source", F.coalesce("edge", F.lit(-1)).alias("edge"), (F.col("goal") - F.col("base") - F.col("drawn")).alias("gap"), (F.col("base") + F.col("drawn") > 0).alias("some")), "p9-edge")

    y = x.join(F.broadcast(edge), "source")  # a row a target
    left = y.filter("step > edge AND (n_tokens <= gap + 0.5 OR NOT some)")
    near = W.partitionBy("source").orderBy("rank", "doc_id")
    low = W.partitionBy("source").orderBy("n_tokens", "doc_id")
    tried = left.filter("some").withColumn("i", F.row_number().over(near)).filter(F.col("i") <= FILL).drop("i")
    least = left.filter("NOT some").withColumn("i", F.row_number().over(low)).filter(F.col("i") <= FILL).drop("i")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        room, some, take = float(pdf["gap"].iloc[0]), bool(pdf["some"].iloc[0]), []
        for i, n in pdf.sort_values(["rank", "doc_id"])[["doc_id", "n_tokens"]].itertuples(index=False):
            if n <= room + 0.5:
                take.append(i)
                room -= n
        rest = pdf[~pdf["doc_id"].isin(take)].sort_values(["n_tokens", "doc_id"])
        if len(rest) and (rest["n_tokens"].iloc[0] < 2 * room or not some and not take):
            take.append(rest["doc_id"].iloc[0])  # nearer with it than without, or the source would be left out
        return pd.DataFrame({"source": pdf["source"].iloc[0], "doc_id": take, "extra": 1})

    kind = base.schema["doc_id"].dataType.simpleString()
    cols = ["source", "doc_id", "n_tokens", "rank", "gap", "some"]
    extra = tried.select(cols).unionByName(least.select(cols)).groupBy("source").applyInPandas(fill, f"source string, doc_id {kind}, extra int")
    extra = F.broadcast(stored(extra, "p9-extra"))  # FILL + 1 rows a target at most
    out = y.join(extra, ["source", "doc_id"], "left")
    copies = F.col("sure") + F.when(F.col("step") <= F.col("edge"), 1).otherwise(F.coalesce("extra", F.lit(0)))
    return out.select("doc_id", "source", "n_tokens", copies.cast("int").alias("copies"), *key).filter("copies > 0")


def shares(mix: DataFrame, targets: DataFrame, sizes: DataFrame) -> DataFrame:
    """source, target_share, actual_share, tokens, documents, most_copies, max_repeats, most_uses,
    available and held_by.

    most_copies is the most uses of a text (text_hash, else doc_id) in its source, and most_uses
    the most that a text of the source has over all sources. available are the tokens of the
    source's units; held_by tells what decided its share: 'target', 'cap' or 'no tokens'."""
    key = "text_hash" if "text_hash" in mix.columns else "doc_id"
    texts = mix.groupBy("source", F.col(key).alias("k")).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"))
    uses = texts.groupBy("k").agg(F.sum("copies").alias("uses"))
    texts = texts.join(uses, "k")
    got = texts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents"), F.max("copies").cast("int").alias("most_copies"), F.max("uses").cast("int").alias("most_uses"))
    whole = got.agg(F.sum("tokens").alias("whole"))
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    x = targets.join(F.broadcast(got), "source", "left").join(F.broadcast(have), "source", "left").crossJoin(F.broadcast(whole))  # a row a target
    none = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documents", "most_copies", "most_uses", "available")}
    held = F.when(F.coalesce("available", F.lit(0)) == 0, "no tokens").when(F.col("tokens") >= F.col("available") * F.col("max_repeats"), "cap").otherwise("target")
    return x.select("source", "target_share", F.coalesce(F.try_divide("tokens", "whole"), F.lit(0.0)).alias("actual_share"), none["tokens"], none["documents"], none["most_copies"], "max_repeats", none["most_uses"], none["available"], held.alias("held_by"))
