"""Places for a user's own extractor, segmenter, lemmatiser or embedder, given as pandas UDFs.

None of them is at hand here, so each is an argument; the engine gives them only the rows that
need them and puts their results together.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def extract(files: DataFrame, content: str, extractors: list[tuple[str, Callable[[Column], Column]]], least: int = 500) -> DataFrame:
    """Adds text and method: the first extractor whose text has ``least`` characters, else
    'all_failed'. An extractor gets a null content for the rows that an earlier one settled."""
    out, done = files, F.lit(False)
    for i, (_, f) in enumerate(extractors):
        out = out.withColumn(f"_t{i}", f(F.when(~done, F.col(content))))
        done = done | F.coalesce(F.length(f"_t{i}") >= least, F.lit(False))
    text, method = F.lit(None).cast("string"), F.lit("all_failed")
    for i, (name, _) in reversed(list(enumerate(extractors))):
        ok = F.coalesce(F.length(f"_t{i}") >= least, F.lit(False))
        text, method = F.when(ok, F.col(f"_t{i}")).otherwise(text), F.when(ok, F.lit(name)).otherwise(method)
    return out.withColumn("text", text).withColumn("method", method).drop(*(f"_t{i}" for i in range(len(extractors))))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("content", T.BinaryType())])))
def zip_pages(content: pd.Series) -> pd.Series:
    """The page images of zip files; what is no zip file has none."""

    def one(b: bytes | None) -> list[dict]:
        try:
            with zipfile.ZipFile(io.BytesIO(b or b"")) as z:
                return [{"name": n, "content": z.read(n)} for n in z.namelist() if n.lower().endswith((".jpg", ".jpeg", ".png"))]
        except zipfile.BadZipFile:
            return []

    return content.map(one)


def black_and_white(gray: np.ndarray, threshold: int = 150) -> np.ndarray:
    """A page as black and white; a preprocessor for the recognition hook."""
    return np.where(gray >= threshold, 255, 0).astype(np.uint8)


def recognise(pages: DataFrame, key: str, ocr: Callable[[Column], Column], *, marks: bool = False) -> DataFrame:
    """key and text of pages(key, name, content): the pages in the order of the digits in their
    names, then of the names, joined by blank lines; with ``marks`` each under its number."""
    number = F.coalesce(F.array_join(F.regexp_extract_all(F.col("name"), F.lit(r"\d+"), F.lit(0)), "").try_cast("decimal(38,0)"), F.lit(0))
    x = pages.select(key, number.alias("n"), "name", F.coalesce(ocr(F.col("content")), F.lit("")).alias("t"))
    g = x.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "name", "t"))).alias("a"))
    page = lambda s, i: F.concat(F.lit("--- Page "), i + 1, F.lit(" ---\n"), s["t"]) if marks else s["t"]
    return g.select(key, F.array_join(F.transform("a", page), "\n\n").alias("text"))


def segment(docs: DataFrame, key: str, text: str, split: Callable[[Column], Column]) -> DataFrame:
    """key, sentence_id from 1, sentence, by a UDF from text to an array of sentences."""
    return docs.select(key, F.posexplode(split(F.col(text))).alias("i", "sentence")).select(key, (F.col("i") + 1).alias("sentence_id"), "sentence")


def lemma_table(words: DataFrame, word: str, lemmatise: Callable[[Column], Column]) -> DataFrame:
    """(surface, lemma) of the distinct words: each goes through the UDF once, whatever its count."""
    return words.select(F.lower(word).alias("surface")).filter("surface IS NOT NULL").distinct().withColumn("lemma", lemmatise(F.col("surface")))


def embed(rows: DataFrame, text: str, model: Callable[[Column], Column], name: str = "vector") -> DataFrame:
    """Adds the vector that a UDF gives for the text; equal texts are embedded once."""
    one = rows.select(text).filter(F.col(text).isNotNull()).distinct().withColumn(name, model(F.col(text)))
    return rows.join(one, text, "left")
