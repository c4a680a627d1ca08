"""Assembling, describing and previewing corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# A text with any line end, blank or missing, comes back as it was
CSV = {"header": "true", "quote": '"', "escape": '"', "quoteAll": "true", "nullValue": "\\N", "emptyValue": "", "lineSep": "\n", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def find_files(spark: SparkSession, folder: str, pattern: str = "*.{pdf,PDF}") -> DataFrame:
    """path, name and content of the files of a folder; the content is only read where it is used."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return x.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def load(spark: SparkSession, path: str, required: tuple[str, ...] = ("file", "text"), schema: str | None = None) -> DataFrame:
    """A table by its suffix: parquet, csv, json or txt (a column ``text``, a row a line). Other
    suffixes and missing columns are errors."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind == "csv":
        r = spark.read.options(**CSV).option("multiLine", True)
        df = (r.schema(schema) if schema else r).csv(path)
    elif kind in ("json", "jsonl"):
        df = (spark.read.schema(schema) if schema else spark.read).json(path)
    elif kind == "txt":
        df = spark.read.text(path).withColumnRenamed("value", "text")
    elif kind == "rds":
        raise ValueError("R data has no reader here; convert it to parquet first")
    else:
        raise ValueError(f"no reader for .{kind}")
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df


def save(df: DataFrame, path: str) -> None:
    """A sink by suffix, the counterpart of ``load``."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    w = df.write.mode("overwrite")
    if kind == "csv":
        w.options(**CSV).csv(path)
    elif kind in ("json", "jsonl"):
        w.option("ignoreNullFields", "false").json(path)
    elif kind == "txt":
        w.text(path)
    else:
        w.parquet(path)


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union by name; rows of before actors were kept are 'unknown'."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.withColumn("actor", F.coalesce("actor", F.lit("unknown"))) if "actor" in both.columns else both


def file_type(content: Column) -> Column:
    """By the first bytes: pdf, zip or unknown."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "25504446", "pdf").when(head == "504B0304", "zip").otherwise("unknown")


def cascade(tries: list[tuple[str, Column]], least: int = 500) -> Column:
    """struct(text, method): the first extraction that is long enough; 'all_failed' if none is."""
    out = F.struct(F.lit(None).cast("string").alias("text"), F.lit("all_failed").alias("method"))
    for name, t in reversed(tries):
        out = F.when(F.length(t) >= least, F.struct(t.alias("text"), F.lit(name).alias("method"))).otherwise(out)
    return out


def preview(rows: DataFrame, key: str, order: str, text: str, limit: int = 1000) -> DataFrame:
    """The beginning of each document's sentences, joined by blanks. The whole text's length
    counts, but only the sentences that reach into the preview are gathered."""
    t = F.coalesce(F.col(text), F.lit(""))
    w = W.partitionBy("id").orderBy("o", "t").rowsBetween(W.unboundedPreceding, -1)
    x = rows.select(F.col(key).alias("id"), F.col(order).alias("o"), t.alias("t")).withColumn("at", F.coalesce(F.sum(F.length("t") + 1).over(w), F.lit(0)))
    g = x.groupBy("id").agg((F.sum(F.length("t") + 1) - 1).cast("int").alias("total_chars"), F.array_sort(F.collect_list(F.when(F.col("at") <= limit, F.struct("at", "t")))).alias("a"))
    full = F.array_join(F.transform("a", lambda s: s["t"]), " ")
    return g.select("id", "total_chars", F.least("total_chars", F.lit(limit)).alias("preview_chars"), (F.col("total_chars") > limit).alias("is_truncated"), F.substr(full, F.lit(1), F.lit(limit)).alias("preview_text"))


def numbered(rows: DataFrame, *keys: str, name: str = "number") -> DataFrame:
    """Numbers from 0 in the order of the keys without a global window: the rows are ranged
    over partitions, counted by partition, and ranked inside each."""
    from textverk.session import stored

    part = stored(rows.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()), "numbered")
    base = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = base.withColumn("_b", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    rank = F.row_number().over(W.partitionBy("_p").orderBy(*keys))
    return part.join(F.broadcast(base), "_p").withColumn(name, F.col("_b") + rank - 1).drop("_p", "_b")  # a row a partition


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in the given order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows chosen by a seeded hash, the same on every run and cluster."""
    return df.orderBy(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def extraction_summary(df: DataFrame) -> DataFrame:
    """One row: totals, success rate, maps of counts by method and type, characters and time."""
    base = df.agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("success"), 1)).alias("ok"), F.sum(F.when(F.col("success"), F.col("char_count"))).alias("chars"), F.round(F.sum("processing_time"), 6).alias("seconds")
    ).withColumn("rate", F.round(100 * F.col("ok") / F.col("total"), 6))
    for c, name in (("method", "methods"), ("file_type", "types")):
        m = df.groupBy(F.coalesce(F.col(c), F.lit("none")).alias("k")).agg(F.count(F.lit(1)).alias("v"))
        base = base.crossJoin(m.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v"))))).alias(name)))
    return base


def preview_page(previews: DataFrame) -> DataFrame:
    """A line of html for each preview, its signs escaped: the rows of the html sink."""
    safe = F.replace(F.replace(F.replace(F.col("preview_text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    more = F.when(F.col("is_truncated"), F.concat(F.lit(" … ("), F.col("total_chars"), F.lit(")"))).otherwise(F.lit(""))
    return previews.select(F.concat(F.lit("<tr><td>"), F.col("id"), F.lit("</td><td>"), safe, more, F.lit("</td></tr>")).alias("text"))
