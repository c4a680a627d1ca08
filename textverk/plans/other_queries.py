"""Queries of statistics, corpora, vectors, clusters, larger relations and streams."""

from __future__ import annotations

import uuid
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textverk.operators import cluster, corpus, diffusion, hooks, panel, persistence, stats, terms, vectors
from textverk.plans.matrix_queries import M, _un, matrix
from textverk.session import own_dir, small, stored
from textverk.sources.tables import spread, table
from textverk.streaming import windows

Q: dict = {}
SQL: dict[str, str] = {}


def q(name: str, sql: str | None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _r(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


# --- tests of independence: customers' segments over order priorities
_CNT = "c AS (SELECT c_mktsegment AS g, o_orderpriority AS c, CAST(count(*) AS DOUBLE) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"
q("j1_chi_square_pairs", f"""WITH {_CNT}, p AS (SELECT a.g AS a, b.g AS b FROM (SELECT DISTINCT g FROM c) a JOIN (SELECT DISTINCT g FROM c) b ON a.g < b.g),
x AS (SELECT a, b, c, coalesce(sum(n) FILTER (g = a), 0) AS x, coalesce(sum(n) FILTER (g = b), 0) AS y FROM p JOIN c ON g = a OR g = b GROUP BY a, b, c), t AS (SELECT *, sum(x) OVER w AS sx, sum(y) OVER w AS sy, count(*) OVER w AS k FROM x WHERE x + y > 0 WINDOW w AS (PARTITION BY a, b)),
e AS (SELECT *, (x + y) * sx / (sx + sy) AS ex, (x + y) * sy / (sx + sy) AS ey FROM t WHERE k >= 2)
SELECT a, b, round(sum((x - ex) * (x - ex) / ex + (y - ey) * (y - ey) / ey), 6) AS chi2, CAST(max(k) - 1 AS INTEGER) AS dof, round(sqrt(sum((x - ex) * (x - ex) / ex + (y - ey) * (y - ey) / ey) / max(sx + sy)), 6) AS cramers_v FROM e GROUP BY a, b""")(
    lambda s, d: _r(stats.independence(_segments(s, d), "g", "c"), "chi2", "cramers_v").select("a", "b", "chi2", "dof", "cramers_v")
)
# five categories give four degrees of freedom, for which the tail has a closed form
q("j3_p_values", f"""WITH {_CNT}, p AS (SELECT a.g AS a, b.g AS b FROM (SELECT DISTINCT g FROM c) a JOIN (SELECT DISTINCT g FROM c) b ON a.g < b.g),
x AS (SELECT a, b, c, coalesce(sum(n) FILTER (g = a), 0) AS x, coalesce(sum(n) FILTER (g = b), 0) AS y FROM p JOIN c ON g = a OR g = b GROUP BY a, b, c), t AS (SELECT *, sum(x) OVER w AS sx, sum(y) OVER w AS sy FROM x WHERE x + y > 0 WINDOW w AS (PARTITION BY a, b)),
e AS (SELECT *, (x + y) * sx / (sx + sy) AS ex, (x + y) * sy / (sx + sy) AS ey FROM t), h AS (SELECT a, b, sum((x - ex) * (x - ex) / ex + (y - ey) * (y - ey) / ey) / 2 AS h FROM e GROUP BY a, b HAVING count(*) = 5)
SELECT a, b, round(exp(-h) * (1 + h), 6) AS p, round(least(exp(-h) * (1 + h) * count(*) OVER (), 1), 6) AS p_bonferroni FROM h""")(lambda s, d: stats.independence(_segments(s, d), "g", "c").select("a", "b", F.round("p", 6).alias("p"), F.round("p_bonferroni", 6).alias("p_bonferroni")))


def _segments(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c"))
    return o.join(table(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("g")), "c_custkey").groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"))


FLAGS = ["storm", "torka", "pandemi", "virus", "sabotage", "terror", "explosion", "skred", "epidemi", "elavbrott", "brand", "smitta", "dammbrott", "skogsbrand"]
_PAIR = " UNION ALL ".join(f"SELECT '{a}' AS concept1, '{b}' AS concept2, count(*) AS n, count(*) FILTER ({a} > 0) AS s1, count(*) FILTER ({b} > 0) AS s2, count(*) FILTER ({a} > 0 AND {b} > 0) AS n_both FROM m" for i, a in enumerate(FLAGS) for b in FLAGS[i + 1 :])
_TESTED = """SELECT *, round(chi2, 6) AS c2, sqrt(chi2 / n) AS v FROM (
SELECT *, pow(abs(n_both - e) - least(0.5, abs(n_both - e)), 2) * (1 / e + n / (s1 * (n - s2)) + n / (s2 * (n - s1)) + n / ((n - s1) * (n - s2))) AS chi2 FROM (SELECT * REPLACE (CAST(n AS DOUBLE) AS n, CAST(s1 AS DOUBLE) AS s1, CAST(s2 AS DOUBLE) AS s2), s1 * s2 / CAST(n AS DOUBLE) AS e FROM pr WHERE s1 > 0 AND s2 > 0 AND s1 < n AND s2 < n))"""
_STRENGTH = "CASE WHEN v < 0.1 THEN 'negligible' WHEN v < 0.3 THEN 'weak' WHEN v < 0.5 THEN 'moderate' ELSE 'strong' END AS effect_strength"
_TEST = """SELECT concept1, concept2, n_both, s1 - n_both AS n_c1_only, s2 - n_both AS n_c2_only, n - s1 - s2 + n_both AS n_neither, round(chi2, 6) AS chi2, round(sqrt(chi2 / n), 6) AS cramers_v, round(e, 6) AS expected_both, round(n_both / e, 6) AS ratio,
CASE WHEN sqrt(chi2 / n) < 0.1 THEN 'negligible' WHEN sqrt(chi2 / n) < 0.3 THEN 'weak' WHEN sqrt(chi2 / n) < 0.5 THEN 'moderate' ELSE 'strong' END AS effect_strength FROM (
SELECT *, pow(abs(n_both - e) - least(0.5, abs(n_both - e)), 2) * (1 / e + n / (s1 * (n - s2)) + n / (s2 * (n - s1)) + n / ((n - s1) * (n - s2))) AS chi2 FROM (SELECT * REPLACE (CAST(n AS DOUBLE) AS n, CAST(s1 AS DOUBLE) AS s1, CAST(s2 AS DOUBLE) AS s2), s1 * s2 / CAST(n AS DOUBLE) AS e FROM pr WHERE s1 > 0 AND s2 > 0 AND s1 < n AND s2 < n))"""
q("e25_cooccurrence", f"WITH {M}, pr AS ({_PAIR}) {_TEST}".replace("s1 - n_both AS n_c1_only", "CAST(s1 - n_both AS BIGINT) AS n_c1_only").replace("s2 - n_both AS n_c2_only", "CAST(s2 - n_both AS BIGINT) AS n_c2_only").replace("n - s1 - s2 + n_both AS n_neither", "CAST(n - s1 - s2 + n_both AS BIGINT) AS n_neither"))(
    lambda s, d: _r(stats.cooccurrence(_flags(s, d), FLAGS), "chi2", "cramers_v", "expected_both", "ratio").select("concept1", "concept2", "n_both", "n_c1_only", "n_c2_only", "n_neither", "chi2", "cramers_v", "expected_both", "ratio", "effect_strength")
)


def _flags(s: SparkSession, d: str) -> DataFrame:
    return matrix(s, d).select("year", "actor", *((F.col(c) > 0).alias(c) for c in FLAGS))


q("e26_concept_by_period", f"WITH {M}, p AS (SELECT CASE WHEN year BETWEEN 2011 AND 2015 THEN '2011-2015' WHEN year BETWEEN 2016 AND 2019 THEN '2016-2019' WHEN year BETWEEN 2020 AND 2024 THEN '2020-2024' END AS period, brand > 0 AS f FROM m) SELECT period, count(*) FILTER (f) AS n, count(*) AS total, round(100 * count(*) FILTER (f) / count(*), 6) AS pct FROM p WHERE period IS NOT NULL GROUP BY period")(
    lambda s, d: _by_period(s, d)
)


def _by_period(s: SparkSession, d: str) -> DataFrame:
    from textverk.functions.meta import period_of

    x = _flags(s, d).withColumn("period", period_of(F.col("year"))).filter("period IS NOT NULL")
    return x.groupBy("period").agg(F.count(F.when(F.col("brand"), 1)).alias("n"), F.count(F.lit(1)).alias("total")).withColumn("pct", F.round(100 * F.col("n") / F.col("total"), 6))


q("j7_period_comparison", f"WITH {M}, pr AS (SELECT CASE WHEN year BETWEEN 2011 AND 2015 THEN '2011-2015' WHEN year BETWEEN 2016 AND 2019 THEN '2016-2019' WHEN year BETWEEN 2020 AND 2024 THEN '2020-2024' END AS period, count(*) AS n, count(*) FILTER (storm > 0) AS s1, count(*) FILTER (brand > 0) AS s2, count(*) FILTER (storm > 0 AND brand > 0) AS n_both FROM m GROUP BY 1 HAVING period IS NOT NULL) SELECT period, c2 AS chi2, round(v, 6) AS cramers_v, {_STRENGTH} FROM ({_TESTED})")(lambda s, d: _periods(s, d))


def _periods(s: SparkSession, d: str) -> DataFrame:
    from textverk.functions.meta import period_of

    x = _flags(s, d).withColumn("period", period_of(F.col("year"))).filter("period IS NOT NULL")
    g = x.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("storm"), 1)).alias("s1"), F.count(F.when(F.col("brand"), 1)).alias("s2"), F.count(F.when(F.col("storm") & F.col("brand"), 1)).alias("n_both"))
    return stats.pair_tests(g.filter("s1 > 0 AND s2 > 0 AND s1 < n AND s2 < n")).select("period", F.round("chi2", 6).alias("chi2"), F.round("cramers_v", 6).alias("cramers_v"), "effect_strength")


q("e27_enrichment", """WITH x AS (SELECT label AS cluster, CAST(vec_id % 7 AS INTEGER) AS value, count(*) AS n FROM embeddings GROUP BY ALL), y AS (SELECT *, n / sum(n) OVER (PARTITION BY cluster) AS observed, sum(n) OVER (PARTITION BY value) / sum(n) OVER () AS expected FROM x),
z AS (SELECT *, observed / expected AS enrichment, row_number() OVER (PARTITION BY cluster ORDER BY round(observed / expected, 9) DESC, value) AS r FROM y) SELECT cluster, value, n, round(observed, 6) AS observed, round(expected, 6) AS expected, round(enrichment, 6) AS enrichment FROM z WHERE r <= 20""")(
    lambda s, d: _r(stats.enrichment(table(s, d, "embeddings").withColumn("value", (F.col("vec_id") % 7).cast("int")), "label", "value"), "observed", "expected", "enrichment")
)

# --- effects and actors that are named in the same sentence: each concept by its words
EFFECTS = {
    "risk": ["risk", "risken", "risker", "riskerna", "konsekvensen"], "kostnad": ["kostnad", "kostnaden", "kostnader"], "samverkan": ["samverkan", "samverkansformer", "samverkansgrupp", "tillsammans"],
    "planering": ["plan", "planen", "planer", "planering", "övningen"], "ansvar": ["ansvar", "ansvaret", "ansvarsfördelning"],
}
ACTORS = {
    "kommun": ["kommun", "kommunen", "kommunal", "kommuner", "gatukontoret", "fastighetskontoret", "krisledningsnämnden"], "stat": ["stat", "staten", "statlig", "statliga", "trafikledningen"],
    "länsstyrelse": ["länsstyrelse", "länsstyrelsen", "länsstyrelser", "länets"], "region": ["region", "regionen", "regional", "regionala", "vårdcentralen"],
    "näringsliv": ["näringsliv", "näringslivet", "företag", "företagen", "elnätsbolaget", "vattenbolaget", "lantbrukarna"], "civilsamhälle": ["civilsamhälle", "civilsamhället", "frivillig", "frivilliga", "frivilliggruppen"],
    "förening": ["förening", "föreningen", "föreningar", "trygghetsjouren"],
}
_WHO = {**EFFECTS, **ACTORS}
_SENT = "s AS (SELECT DISTINCT doc_id, sentence_id, sentence_text AS t FROM bert_corpus WHERE sentence_text IS NOT NULL), w AS (SELECT doc_id, sentence_id, t, regexp_extract_all(lower(t), '[\\p{L}\\p{M}\\p{N}_]+') AS l FROM s), f AS (SELECT " + ", ".join("list_has_any(l, [" + ", ".join(f"'{x}'" for x in ws) + f']) AS "{k}"' for k, ws in _WHO.items()) + " FROM w)"


def _sentence_flags(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "bert_corpus").filter("sentence_text IS NOT NULL").select("doc_id", "sentence_id", "sentence_text").distinct()
    w = F.regexp_extract_all(F.lower("sentence_text"), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    return x.select(w.alias("w")).select(*(F.arrays_overlap("w", F.array(*(F.lit(x) for x in ws))).alias(k) for k, ws in _WHO.items()))


def _sweep(name: str, pairs: list[tuple[str, str]]) -> None:
    parts = " UNION ALL ".join(f"""SELECT '{a}' AS concept1, '{b}' AS concept2, count(*) AS n, count(*) FILTER ("{a}") AS s1, count(*) FILTER ("{b}") AS s2, count(*) FILTER ("{a}" AND "{b}") AS n_both FROM f""" for a, b in pairs)
    sql = f"WITH {_SENT}, pr AS ({parts}) SELECT concept1, concept2, n_both, c2 AS chi2, round(v, 6) AS cramers_v, round(n_both / e, 6) AS ratio, {_STRENGTH} FROM ({_TESTED})"
    cols = ("concept1", "concept2", "n_both", "chi2", "cramers_v", "ratio", "effect_strength")
    q(name, sql)(lambda s, d: _r(stats.pair_sweep(_sentence_flags(s, d), pairs), "chi2", "cramers_v", "ratio").select(*cols).orderBy(F.desc("chi2"), "concept1", "concept2"))


_sweep("j6_effect_effect", list(combinations(EFFECTS, 2)))
_sweep("j6_effect_actor", [(a, b) for a in EFFECTS for b in ACTORS])
_sweep("j6_actor_actor", list(combinations(ACTORS, 2)))

# --- corpora
q("a1_scan", "SELECT count(*) AS n, count(text) AS with_text, CAST(sum(length(text)) AS BIGINT) AS chars FROM extraction_full")(
    lambda s, d: table(s, d, "extraction_full").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("with_text"), F.sum(F.length("text").cast("long")).alias("chars"))
)
q("a2_csv_round_trip", "SELECT ocr_id, file, text FROM ocr_full_results")(lambda s, d: _trip(s, d, "csv"))
q("a5_json_round_trip", "SELECT ocr_id, file, text FROM ocr_full_results")(lambda s, d: _trip(s, d, "json"))
q("a12_parquet_round_trip", "SELECT ocr_id, file, text FROM ocr_full_results")(lambda s, d: _trip(s, d, "parquet"))


def _trip(s: SparkSession, d: str, kind: str) -> DataFrame:
    at = f"{own_dir(s)}/trip-{uuid.uuid4().hex}.{kind}"
    corpus.save(table(s, d, "ocr_full_results").select("ocr_id", "file", "text"), at)
    return corpus.load(s, at, schema="ocr_id long, file string, text string")


q("a12_text_lines", "WITH r AS (SELECT DISTINCT doc_id, sentence_id, replace(replace(sentence_text, chr(13), ' '), chr(10), ' ') AS t FROM bert_corpus WHERE sentence_text IS NOT NULL) SELECT t AS text, count(*) AS n FROM r GROUP BY t")(lambda s, d: _text_sink(s, d))


def _text_sink(s: SparkSession, d: str) -> DataFrame:
    at = f"{own_dir(s)}/lines-{uuid.uuid4().hex}.txt"
    x = table(s, d, "bert_corpus").filter("sentence_text IS NOT NULL").select("doc_id", "sentence_id", F.translate("sentence_text", "\r\n", "  ").alias("text")).distinct()
    corpus.save(x.select("text"), at)
    return corpus.load(s, at, required=("text",)).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


q("a4_matrix_round_trip", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS width, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total, round(CAST(embedding[1] AS DOUBLE), 5) AS first, round(CAST(embedding[64] AS DOUBLE), 5) AS last FROM embeddings")(lambda s, d: _npy_trip(s, d))


def _npy_trip(s: SparkSession, d: str) -> DataFrame:
    """Embeddings as dense matrices with an index, and back into their rows."""
    at = f"{own_dir(s)}/npy-{uuid.uuid4().hex}"
    index = stored(vectors.save_npy(table(s, d, "embeddings"), "vec_id", "embedding", at), "npy-index")
    parts = [r["part"] for r in index.select("part").distinct().collect()]  # files, one a partition
    got = None
    for p in parts:
        one = vectors.load_npy(s, f"{at}/{p}").join(index.filter(F.col("part") == p).select("row", "vec_id"), "row")
        got = one if got is None else got.unionByName(one)
    total = F.aggregate(F.transform("vector", lambda x: x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    return got.select("vec_id", F.size("vector").alias("width"), F.round(total, 4).alias("total"), F.round(F.col("vector")[0].cast("double"), 5).alias("first"), F.round(F.element_at("vector", -1).cast("double"), 5).alias("last"))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "extraction_full", "ocr_full_results", "quality", "term_document_matrix", "bert_corpus", "reading_labels", "mix_targets", "container_specs")
q("a6_glob", "SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in _TABLES) + ") v(name)")(
    lambda s, d: corpus.find_files(s, d, "*.parquet").select(F.regexp_extract("path", r"/([^/.]+)\.parquet(?:/[^/]*)?$", 1).alias("name")).filter(F.col("name").isin(*_TABLES)).distinct()
)
q("a9_pages", "SELECT ocr_id, text FROM ocr_full_results WHERE text IS NOT NULL")(lambda s, d: _recognised(s, d))


@F.pandas_udf(T.StringType())
def _decoded(content: pd.Series) -> pd.Series:
    """Stands where recognition would: the page is its text in bytes."""
    return content.map(lambda b: b.decode("utf-8"), na_action="ignore")


def _recognised(s: SparkSession, d: str) -> DataFrame:
    """Texts cut into pages at blank lines, which lie in any order, and put together again."""
    x = table(s, d, "ocr_full_results").filter("text IS NOT NULL").select("ocr_id", F.posexplode(F.split("text", "\n\n")).alias("i", "t"))
    pages = x.select("ocr_id", F.concat(F.lit("page_"), F.col("i") + 1, F.lit(".jpg")).alias("name"), F.encode("t", "utf-8").alias("content"))
    return hooks.recognise(pages, "ocr_id", _decoded)


q("m_extract", "SELECT ocr_id, CASE WHEN length(text) >= 900 THEN 'first' WHEN length(text) >= 500 THEN 'second' ELSE 'all_failed' END AS method, CASE WHEN length(text) >= 500 THEN CAST(length(text) AS INTEGER) END AS n FROM ocr_full_results")(lambda s, d: _extracted(s, d))


@F.pandas_udf(T.StringType())
def _long_only(content: pd.Series) -> pd.Series:
    return content.map(lambda b: t if len(t := b.decode("utf-8")) >= 900 else "", na_action="ignore")


def _extracted(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "ocr_full_results").select("ocr_id", F.encode("text", "utf-8").alias("content"))
    return hooks.extract(x, "content", [("first", _long_only), ("second", _decoded)]).select("ocr_id", "method", F.length("text").alias("n"))


q("m_segment", r"WITH r AS (SELECT ocr_id, unnest(string_split(text, chr(10))) AS sentence, generate_subscripts(string_split(text, chr(10)), 1) AS sentence_id FROM ocr_full_results WHERE text IS NOT NULL) SELECT ocr_id, CAST(sentence_id AS INTEGER) AS sentence_id, sentence FROM r")(
    lambda s, d: hooks.segment(spread(table(s, d, "ocr_full_results").select("ocr_id", "text"), "ocr_id"), "ocr_id", "text", _by_line)
)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _by_line(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t.split("\n"), na_action="ignore")


q("m_lemma_table", r"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(sentence_text), '\p{L}+')) AS surface FROM bert_corpus WHERE sentence_text IS NOT NULL) SELECT surface, CASE WHEN length(surface) > 4 AND suffix(surface, 'en') THEN substr(surface, 1, length(surface) - 2) ELSE surface END AS lemma FROM w")(
    lambda s, d: hooks.lemma_table(table(s, d, "bert_corpus").select(F.explode(F.regexp_extract_all(F.lower("sentence_text"), F.lit(r"\p{L}+"), F.lit(0))).alias("w")), "w", _without_article)
)


@F.pandas_udf(T.StringType())
def _without_article(word: pd.Series) -> pd.Series:
    return word.map(lambda w: w[:-2] if len(w) > 4 and w.endswith("en") else w, na_action="ignore")


q("m_embed", "SELECT DISTINCT doc_id, sentence_id, sentence_text, CAST(length(sentence_text) AS DOUBLE) AS v1, CAST(length(sentence_text) - length(replace(sentence_text, ' ', '')) AS DOUBLE) AS v2 FROM bert_corpus")(
    lambda s, d: hooks.embed(table(s, d, "bert_corpus").select("doc_id", "sentence_id", "sentence_text").distinct(), "sentence_text", _two_numbers).select("doc_id", "sentence_id", "sentence_text", F.col("vector")[0].alias("v1"), F.col("vector")[1].alias("v2"))
)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _two_numbers(text: pd.Series) -> pd.Series:
    return text.map(lambda t: np.array([float(len(t)), float(t.count(" "))]), na_action="ignore")


q("a11_append", "SELECT ocr_id AS id, file, 'unknown' AS actor FROM ocr_full_results UNION ALL SELECT extraction_id, filename, coalesce(actor, 'unknown') FROM extraction_full")(
    lambda s, d: corpus.append(table(s, d, "ocr_full_results").select(F.col("ocr_id").alias("id"), "file"), table(s, d, "extraction_full").select(F.col("extraction_id").alias("id"), F.col("filename").alias("file"), "actor"))
)
q("a7_magic_bytes", "SELECT extraction_id, CASE WHEN starts_with(text, '%PDF') THEN 'pdf' WHEN starts_with(text, 'PK' || chr(3) || chr(4)) THEN 'zip' ELSE 'unknown' END AS kind FROM extraction_full UNION ALL SELECT * FROM (VALUES (-1, 'pdf'), (-2, 'zip'), (-3, 'unknown'), (-4, 'unknown'), (-5, 'unknown')) v(extraction_id, kind)")(
    lambda s, d: table(s, d, "extraction_full").select("extraction_id", F.encode("text", "utf-8").alias("content"))
    .unionByName(s.createDataFrame([(-1, bytearray(b"%PDF-1.7 x")), (-2, bytearray(b"PK\x03\x04\x14")), (-3, bytearray(b"PK")), (-4, bytearray()), (-5, None)], "extraction_id long, content binary"))
    .select("extraction_id", corpus.file_type(F.col("content")).alias("kind"))
)
q("a8_cascade", """WITH x AS (SELECT f, max(t1) AS t1, max(t2) AS t2 FROM (SELECT filename AS f, text AS t1, NULL AS t2 FROM extraction_full WHERE filename IS NOT NULL UNION ALL SELECT file, NULL, text FROM ocr_full_results WHERE file IS NOT NULL) GROUP BY f)
SELECT f AS file, CASE WHEN length(t1) >= 500 THEN 'extracted' WHEN length(t2) >= 500 THEN 'ocr' ELSE 'all_failed' END AS method, length(CASE WHEN length(t1) >= 500 THEN t1 WHEN length(t2) >= 500 THEN t2 END) AS n FROM x""")(lambda s, d: _cascade(s, d))


def _cascade(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "extraction_full").select(F.col("filename").alias("file"), F.col("text").alias("t1"), F.lit(None).cast("string").alias("t2"))
    b = table(s, d, "ocr_full_results").select("file", F.lit(None).cast("string").alias("t1"), F.col("text").alias("t2"))
    x = a.unionByName(b).filter("file IS NOT NULL").groupBy("file").agg(F.max("t1").alias("t1"), F.max("t2").alias("t2"))
    y = x.select("file", corpus.cascade([("extracted", F.col("t1")), ("ocr", F.col("t2"))]).alias("c"))
    return y.select("file", "c.method", F.length("c.text").cast("long").alias("n"))


q("a13_preview", "WITH r AS (SELECT DISTINCT doc_id, sentence_id, sentence_text FROM bert_corpus), g AS (SELECT doc_id AS id, string_agg(coalesce(sentence_text, ''), ' ' ORDER BY sentence_id, sentence_text) AS t FROM r GROUP BY doc_id) SELECT id, CAST(length(t) AS INTEGER) AS total_chars, CAST(least(length(t), 1000) AS INTEGER) AS preview_chars, length(t) > 1000 AS is_truncated, substr(t, 1, 1000) AS preview_text FROM g")(
    lambda s, d: corpus.preview(table(s, d, "bert_corpus").select("doc_id", "sentence_id", "sentence_text").distinct(), "doc_id", "sentence_id", "sentence_text")
)
q("f9_keep_first", "SELECT filename, extraction_id FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY extracted_at, extraction_id) AS r FROM extraction_full) WHERE r = 1")(
    lambda s, d: corpus.keep_first(table(s, d, "extraction_full").select("filename", "extraction_id", "extracted_at"), ["filename"], F.asc_nulls_last("extracted_at"), F.col("extraction_id")).select("filename", "extraction_id")
)
_MAP = "(SELECT '{{' || string_agg('\"' || k || '\":' || v, ',' ORDER BY k) || '}}' FROM (SELECT coalesce({c}, 'none') AS k, count(*) AS v FROM extraction_full GROUP BY 1))"
q("e31_extraction_summary", f"SELECT count(*) AS total, count(*) FILTER (success) AS ok, CAST(sum(char_count) FILTER (success) AS BIGINT) AS chars, round(sum(processing_time), 3) AS seconds, round(100 * count(*) FILTER (success) / count(*), 6) AS rate, {_MAP.format(c='method')} AS methods, {_MAP.format(c='file_type')} AS types FROM extraction_full")(lambda s, d: corpus.extraction_summary(table(s, d, "extraction_full")).withColumn("seconds", F.round("seconds", 3)))
q("e31_methods", "SELECT method, count(*) AS n, count(*) FILTER (success) AS ok, round(100 * count(*) FILTER (success) / count(*), 6) AS rate, CAST(sum(char_count) FILTER (success) AS BIGINT) AS chars FROM extraction_full GROUP BY method")(
    lambda s, d: table(s, d, "extraction_full").groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("success"), 1)).alias("ok"), F.sum(F.when(F.col("success"), F.col("char_count"))).alias("chars")).withColumn("rate", F.round(100 * F.col("ok") / F.col("n"), 6))
)
q("e32_ocr_summary", "SELECT status, count(*) AS n, round(avg(text_length), 6) AS mean_length FROM ocr_full_results GROUP BY status")(
    lambda s, d: table(s, d, "ocr_full_results").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("text_length"), 6).alias("mean_length"))
)
q("e29_quantiles", "SELECT quantile_cont(word_count, 0.25) AS q25, quantile_cont(word_count, 0.5) AS q50, quantile_cont(word_count, 0.75) AS q75, quantile_cont(word_count, 0.95) AS q95 FROM bert_corpus")(
    lambda s, d: table(s, d, "bert_corpus").agg(*(F.percentile("word_count", F.lit(p)).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75, 0.95)))
)
q("e30_word_stats", "SELECT actor_type, round(avg(word_count), 6) AS mean, median(word_count) AS median, min(word_count) AS lo, max(word_count) AS hi FROM bert_corpus GROUP BY actor_type")(
    lambda s, d: table(s, d, "bert_corpus").groupBy("actor_type").agg(F.round(F.avg("word_count"), 6).alias("mean"), F.median("word_count").alias("median"), F.min("word_count").alias("lo"), F.max("word_count").alias("hi"))
)
q("e37_sorted_lists", "SELECT entity, string_agg(DISTINCT CAST(wave AS VARCHAR), ',' ORDER BY CAST(wave AS VARCHAR)) AS waves, count(DISTINCT wave) AS n FROM term_document_matrix WHERE entity IS NOT NULL AND wave IS NOT NULL GROUP BY entity")(
    lambda s, d: table(s, d, "term_document_matrix").filter("entity IS NOT NULL AND wave IS NOT NULL").groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set(F.col("wave").cast("string"))), ",").alias("waves"), F.countDistinct("wave").alias("n"))
)
q("f10_group_numbers", "SELECT DISTINCT doc_id, sentence_id, dense_rank() OVER (ORDER BY doc_id, sentence_id) - 1 AS gid FROM bert_corpus")(lambda s, d: _group_numbers(s, d))


def _group_numbers(s: SparkSession, d: str) -> DataFrame:
    return corpus.numbered(table(s, d, "bert_corpus").select("doc_id", "sentence_id").distinct(), "doc_id", "sentence_id", name="gid")


q("b14_sample", "SELECT doc_id, source FROM documents ORDER BY md5(doc_id || '-42'), doc_id LIMIT 50")(lambda s, d: corpus.sample(table(s, d, "documents").select("doc_id", "source"), 50, "doc_id"))
q("c26_json", "SELECT DISTINCT doc_id, CAST(to_json({'quality': {'score': CAST(round(10000 * quality_score) AS BIGINT), 'flag': quality_flag}, 'sentences': {'total': total_sentences, 'kept': sentences_after_filtering}, 'chapter': [chapter_trimmed, chapter_trim_failed]}) AS VARCHAR) AS json FROM quality")(
    lambda s, d: table(s, d, "quality").select("doc_id", F.to_json(F.struct(F.struct(F.round(10000 * F.col("quality_score")).cast("long").alias("score"), F.col("quality_flag").alias("flag")).alias("quality"), F.struct(F.col("total_sentences").alias("total"), F.col("sentences_after_filtering").alias("kept")).alias("sentences"), F.array("chapter_trimmed", "chapter_trim_failed").alias("chapter")), {"ignoreNullFields": "false"}).alias("json")).distinct()
)
q("a13_html_lines", "WITH r AS (SELECT DISTINCT doc_id, sentence_id, sentence_text FROM bert_corpus), g AS (SELECT doc_id AS id, string_agg(coalesce(sentence_text, ''), ' ' ORDER BY sentence_id, sentence_text) AS t FROM r GROUP BY doc_id) SELECT '<tr><td>' || id || '</td><td>' || replace(replace(replace(substr(t, 1, 1000), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || CASE WHEN length(t) > 1000 THEN ' … (' || length(t) || ')' ELSE '' END || '</td></tr>' AS text FROM g")(
    lambda s, d: corpus.preview_page(corpus.preview(table(s, d, "bert_corpus").select("doc_id", "sentence_id", "sentence_text").distinct(), "doc_id", "sentence_id", "sentence_text"))
)
q("k15_report_pages", f"WITH {M}, x AS (SELECT file, row_number() OVER (ORDER BY file, year NULLS LAST, actor, entity, wave NULLS LAST) AS rn FROM (SELECT DISTINCT file, year, actor, entity, wave FROM m)) SELECT CAST(floor((rn - 1) / 55) AS BIGINT) AS page, count(*) AS lines FROM x GROUP BY 1")(
    lambda s, d: corpus.numbered(matrix(s, d).select("file", "year", "actor", "entity", "wave").distinct(), "file", "year").groupBy(F.floor(F.col("number") / 55).alias("page")).agg(F.count(F.lit(1)).alias("lines"))
)
q("h8_actor_pairs", f"WITH {M}, a AS (SELECT DISTINCT actor FROM m WHERE actor IS NOT NULL) SELECT x.actor AS a, y.actor AS b FROM a x JOIN a y ON x.actor < y.actor")(
    lambda s, d: matrix(s, d).filter("actor IS NOT NULL").select(F.col("actor").alias("a")).distinct().join(matrix(s, d).filter("actor IS NOT NULL").select(F.col("actor").alias("b")).distinct(), F.col("a") < F.col("b"))
)

# --- the panel operators on larger relations: customers over years of their orders
_OM = "m AS (SELECT 'o' || o_custkey AS file, c_mktsegment AS actor, o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(year(o_orderdate) AS INTEGER) AS wave, count(*) FILTER (p_type = 'ECONOMY') AS ECONOMY, count(*) FILTER (p_type = 'SMALL') AS SMALL, count(*) FILTER (p_type = 'PROMO') AS PROMO FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)"
_OT = """t AS (SELECT *, CASE WHEN present_from = 1 AND present_to = 1 THEN 'persist' WHEN present_from = 1 THEN 'dropout' WHEN present_to = 1 THEN 'adopt' ELSE 'stable_absent' END AS transition FROM (
SELECT entity, term, wave AS wave_from, lead(wave) OVER w AS wave_to, CAST(n > 0 AS INTEGER) AS present_from, lead(CAST(n > 0 AS INTEGER)) OVER w AS present_to FROM l WINDOW w AS (PARTITION BY entity, term ORDER BY wave)) WHERE wave_to IS NOT NULL)"""


def order_matrix(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    x = table(s, d, "lineitem").select("l_orderkey", "l_partkey").join(table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    x = x.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("actor")), "o_custkey")
    types = ["ECONOMY", "SMALL", "PROMO"]
    g = x.groupBy("o_custkey", "actor", "year").agg(*(F.count(F.when(F.col("p_type") == t, 1)).alias(t) for t in types))
    return g.select(F.concat(F.lit("o"), "o_custkey").alias("file"), "actor", F.col("o_custkey").alias("entity"), "year", F.col("year").alias("wave"), *types)


q("i3_order_transitions", f"WITH {_OM}, {_un('m', 'l')}, {_OT} SELECT term, wave_from, wave_to, transition, count(*) AS n FROM t GROUP BY ALL")(
    lambda s, d: panel.wave_transitions(terms.melt(order_matrix(s, d))).groupBy("term", "wave_from", "wave_to", "transition").agg(F.count(F.lit(1)).alias("n"))
)
q("e6_order_persistence", f"WITH {_OM}, {_un('m', 'l')}, {_OT} SELECT term, count(*) AS n_entities_t0, count(*) FILTER (transition = 'persist') AS n_entities_persist, count(*) FILTER (transition = 'dropout') AS n_entities_dropout, round(count(*) FILTER (transition = 'persist') / count(*), 6) AS persistence_rate, count(*) < 3 AS flag_low_n FROM t WHERE present_from = 1 GROUP BY term")(
    lambda s, d: _r(persistence.rates(panel.wave_transitions(terms.melt(order_matrix(s, d))), "term"), "persistence_rate")
)
q("e13_order_first_year", f"WITH {_OM}, {_un('m', 'l')} SELECT term, first_year, count(*) AS n FROM (SELECT entity, term, min(year) AS first_year FROM l WHERE n > 0 GROUP BY ALL) GROUP BY ALL")(
    lambda s, d: diffusion.first_appearance(terms.melt(order_matrix(s, d))).groupBy("term", "first_year").agg(F.count(F.lit(1)).alias("n"))
)

# --- vectors
_EXP = "x AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"
q("e38_centroids", f"WITH {_EXP}, c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM x GROUP BY ALL) SELECT label, CAST(i AS INTEGER) AS i, round(m, 6) AS m FROM c")(
    lambda s, d: vectors.centroids(table(s, d, "embeddings"), "label", "embedding").select("label", F.posexplode("centroid").alias("i", "m")).select("label", (F.col("i") + 1).alias("i"), F.round("m", 6).alias("m"))
)
_COS = "list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / (sqrt(list_inner_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * sqrt(list_inner_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))))"
q("j20_neighbours", f"WITH s AS (SELECT vec_id AS seed, embedding AS sv FROM embeddings WHERE vec_id % 20 = 0), x AS (SELECT seed, vec_id, {_COS.format(a='embedding', b='sv')} AS c FROM embeddings, s WHERE seed <> vec_id), y AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY c DESC, vec_id) AS rank FROM x) SELECT seed, vec_id, round(c, 6) AS similarity FROM y WHERE rank <= 10")(
    lambda s, d: vectors.neighbours(table(s, d, "embeddings"), table(s, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("seed"), F.col("embedding").alias("seed_vector")), "vec_id", "embedding", 10).select("seed", "vec_id", F.round("similarity", 6).alias("similarity"))
)
_NN = f"s AS (SELECT vec_id AS seed, label AS category, embedding AS sv FROM embeddings WHERE vec_id % 20 = 0), x AS (SELECT seed, category, vec_id, round({_COS.format(a='embedding', b='sv')}, 12) AS c FROM embeddings, s WHERE seed <> vec_id), y AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY c DESC, vec_id) AS rank FROM x)"
q("j20_expansion", f"WITH {_NN} SELECT category, vec_id, round(max(c), 6) AS similarity FROM y WHERE rank <= 50 GROUP BY category, vec_id")(lambda s, d: _expansion(s, d))


def _expansion(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    seeds = e.filter("vec_id % 20 = 0")
    near = vectors.neighbours(e, seeds.select(F.col("vec_id").alias("seed"), F.col("embedding").alias("seed_vector")), "vec_id", "embedding", 50)
    return _r(vectors.expansion(near, seeds.select(F.col("vec_id").alias("seed"), F.col("label").alias("category")), "vec_id"), "similarity")


_CEN = f"{_EXP}, c AS (SELECT label, list(m ORDER BY i) AS cen FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM x GROUP BY ALL) GROUP BY label)"
q("j22_typical", f"WITH {_CEN}, y AS (SELECT e.label, vec_id, {_COS.format(a='embedding', b='cen')} AS s FROM embeddings e JOIN c ON e.label = c.label), z AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM y) SELECT label, vec_id, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM z WHERE rank <= 5")(
    lambda s, d: _r(vectors.to_centroid(table(s, d, "embeddings"), "vec_id", "label", "embedding"), "similarity")
)
q("j22_atypical", f"WITH {_CEN}, y AS (SELECT e.label, vec_id, {_COS.format(a='embedding', b='cen')} AS s FROM embeddings e JOIN c ON e.label = c.label), z AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s, vec_id) AS rank FROM y) SELECT label, vec_id, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM z WHERE rank <= 5")(
    lambda s, d: _r(vectors.to_centroid(table(s, d, "embeddings"), "vec_id", "label", "embedding", typical=False), "similarity")
)
q("j23_drift", f"WITH x AS (SELECT label, CAST(vec_id % 4 AS INTEGER) AS step, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, step, list(m ORDER BY i) AS cen FROM (SELECT label, step, i, avg(CAST(x AS DOUBLE)) AS m FROM x GROUP BY ALL) GROUP BY ALL), y AS (SELECT label, lag(step) OVER w AS step_from, step AS step_to, lag(cen) OVER w AS b, cen FROM c WINDOW w AS (PARTITION BY label ORDER BY step)) SELECT label, step_from, step_to, round({_COS.format(a='b', b='cen')}, 6) AS similarity FROM y WHERE b IS NOT NULL")(
    lambda s, d: _r(vectors.drift(table(s, d, "embeddings").withColumn("step", (F.col("vec_id") % 4).cast("int")), "label", "step", "embedding"), "similarity")
)
q("j10_indices", """WITH x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM x GROUP BY ALL), a AS (SELECT i, avg(x) AS m FROM x GROUP BY i),
o AS (SELECT vec_id, label, sum((x - m) * (x - m)) AS d FROM x JOIN c USING (label, i) GROUP BY ALL), p AS (SELECT label, avg(sqrt(d)) AS s FROM o GROUP BY label), k AS (SELECT count(*) AS k FROM p), n AS (SELECT count(*) AS n, sum(d) AS w FROM o), b AS (SELECT sum(c.n * (c.m - a.m) * (c.m - a.m)) AS b FROM c JOIN a USING (i)),
f AS (SELECT x.label AS l1, y.label AS l2, sqrt(sum((x.m - y.m) * (x.m - y.m))) AS f FROM c x JOIN c y ON x.i = y.i AND x.label <> y.label GROUP BY ALL), r AS (SELECT l1, max((u.s + v.s) / f) AS r FROM f JOIN p u ON u.label = l1 JOIN p v ON v.label = l2 GROUP BY l1)
SELECT k, n, round(b * (n - k) / (w * (k - 1)), 6) AS calinski_harabasz, (SELECT round(avg(r), 6) FROM r) AS davies_bouldin FROM k, n, b""")(
    lambda s, d: _r(cluster.indices(table(s, d, "embeddings"), "embedding", "label"), "calinski_harabasz", "davies_bouldin")
)

# --- clusters (labels are arbitrary, so there is no SQL; tests use separable data)
def _cols(s: SparkSession, d: str) -> list[str]:
    """Every term of the matrix: all columns that are no metadata."""
    return [c for c in table(s, d, "term_document_matrix").columns if c not in terms.META]


def profiles(s: SparkSession, d: str) -> DataFrame:
    """Shares of the terms by entity and wave, without empty profiles."""
    one, cols = panel.latest_per_wave(matrix(s, d), last=False), _cols(s, d)
    total = sum((F.col(c) for c in cols), F.lit(0))
    return one.withColumn("t", total).filter("t > 0").select("entity", "actor", "year", "wave", *((F.col(c) / F.col("t")).alias(c) for c in cols))


def _assigned(s: SparkSession, d: str) -> DataFrame:
    return stored(cluster.fit(stored(profiles(s, d), "profiles"), _cols(s, d), 3), "assigned")


_PROF = f"{M}, one AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY entity, wave ORDER BY year DESC NULLS LAST, file) AS r FROM m WHERE entity IS NOT NULL AND wave IS NOT NULL) WHERE r = 1), pf AS (SELECT entity, actor, wave FROM one WHERE " + " + ".join(FLAGS) + " > 0)"
q("j9_k_sweep", None)(lambda s, d: cluster.sweep_groups(stored(profiles(s, d), "profiles"), "wave", _cols(s, d), range(2, 11), range(42, 52), least=5))
q("j9_checks", f"WITH {_PROF}, n AS (SELECT wave, count(*) AS n FROM pf GROUP BY wave HAVING count(*) >= 5) SELECT wave, CAST(least(10, n - 1) - 1 AS BIGINT) AS n_k, 1 AS n_best, true AS falls FROM n")(lambda s, d: _sweep_checks(s, d))
q("j19_elbow", None)(lambda s, d: cluster.sweep_groups(stored(profiles(s, d), "profiles").withColumn("every", F.lit(0)), "every", _cols(s, d), range(2, 21), range(42, 44)))
q("j11_kmeans", None)(lambda s, d: _assigned(s, d).select("entity", "wave", "cluster"))
q("j11_kmeans_checks", f"WITH {_PROF} SELECT count(*) AS n, 3 AS clusters, 0 AS lost, true AS by_size FROM pf")(lambda s, d: _label_checks(_assigned(s, d)).drop("g"))
q("j11_ward", None)(lambda s, d: cluster.ward(profiles(s, d), "wave", "entity", _cols(s, d), 3))
q("j11_ward_checks", f"WITH {_PROF} SELECT wave AS g, count(*) AS n, 3 AS clusters, 0 AS lost, true AS by_size FROM pf GROUP BY wave")(lambda s, d: _label_checks(cluster.ward(profiles(s, d), "wave", "entity", _cols(s, d), 3), "wave"))
q("j11_linkage", None)(lambda s, d: cluster.linkage(profiles(s, d), "wave", _cols(s, d)))
q("j11_linkage_checks", f"WITH {_PROF} SELECT wave, CAST(count(*) AS DOUBLE) AS size, true AS rises FROM pf GROUP BY wave")(
    lambda s, d: cluster.linkage(profiles(s, d), "wave", _cols(s, d)).groupBy("wave").agg(F.max("size").alias("size"), (F.max_by("height", "step") == F.max("height")).alias("rises"))
)
q("j12_characterise", None)(lambda s, d: cluster.characterise(_assigned(s, d), _cols(s, d)))
q("j12_checks", f"WITH {_PROF} SELECT count(*) AS n, count(*) FILTER (actor = 'kommun') AS n_kommun, count(*) FILTER (actor = 'länsstyrelse') AS n_lansstyrelse, count(*) FILTER (actor = 'MCF') AS \"n_MCF\", CAST(1 AS DOUBLE) AS shares FROM pf")(lambda s, d: _characterise_checks(s, d))
q("k_cluster_composition", f"WITH {_PROF} SELECT wave, coalesce(actor, 'unknown') AS actor, CAST(count(*) AS BIGINT) AS n FROM pf GROUP BY ALL")(lambda s, d: cluster.composition(_assigned(s, d), "wave").groupBy("wave", "actor").agg(F.sum("n").alias("n")))
q("i7_cluster_transitions", None)(lambda s, d: cluster.transitions(_assigned(s, d), [(0, 1), (1, 2), (2, 3)]))
q("k_transition_totals", f"WITH {_PROF} SELECT a.wave AS wave_from, b.wave AS wave_to, count(*) AS n FROM pf a JOIN pf b ON a.entity = b.entity AND b.wave = a.wave + 1 GROUP BY ALL")(
    lambda s, d: cluster.transition_matrix(cluster.transitions(_assigned(s, d), [(0, 1), (1, 2), (2, 3)])).filter("cluster_from = 'All' AND cluster_to = 'All'").select("wave_from", "wave_to", "n")
)
q("k_transition_matrix", None)(lambda s, d: cluster.transition_matrix(cluster.transitions(_assigned(s, d), [(0, 1), (1, 2), (2, 3)])))
q("j14_pca", None)(lambda s, d: cluster.project(profiles(s, d), _cols(s, d)).select("entity", "wave", "pc1", "pc2"))
q("j14_checks", f"WITH {_PROF} SELECT count(*) AS n, true AS centred, true AS uncorrelated, true AS in_order FROM pf")(
    lambda s, d: cluster.project(profiles(s, d), _cols(s, d)).agg(F.count(F.lit(1)).alias("n"), (F.abs(F.avg("pc1")) + F.abs(F.avg("pc2")) < 1e-9).alias("centred"), (F.abs(F.corr("pc1", "pc2")) < 1e-6).alias("uncorrelated"), (F.variance("pc1") >= F.variance("pc2")).alias("in_order"))
)
q("j10_silhouette", None)(lambda s, d: stats.silhouette(_assigned(s, d).select("wave", "cluster", F.array(*_cols(s, d)).alias("v")), "v", "cluster", "wave"))
q("j17_density", None)(lambda s, d: cluster.neighbourhoods(profiles(s, d).withColumn("id", F.concat_ws("|", "entity", "wave")), "id", _cols(s, d), 0.3, 10))
# a profile is core if ten lie within eps of it; every cluster has a core point, which names it
q("j17_checks", f"WITH {M}, one AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY entity, wave ORDER BY year DESC NULLS LAST, file) AS r FROM m WHERE entity IS NOT NULL AND wave IS NOT NULL) WHERE r = 1), t AS (SELECT *, {' + '.join(FLAGS)} AS t FROM one), u AS (SELECT entity || '|' || wave AS id, [" + ", ".join(f"CAST({c} AS DOUBLE) / t" for c in FLAGS) + "] AS v FROM t WHERE t > 0), c AS (SELECT a.id, count(*) AS n FROM u a JOIN u b ON list_distance(a.v, b.v) <= 0.3 GROUP BY a.id) SELECT (SELECT count(*) FROM u) AS n, (SELECT count(DISTINCT a.id) FROM u a JOIN u b ON list_distance(a.v, b.v) <= 0.3 JOIN c ON c.id = b.id AND c.n >= 10) AS inside")(
    lambda s, d: _density_checks(s, d)
)


def _sweep_checks(s: SparkSession, d: str) -> DataFrame:
    """Every k once, one of them the best, and the inertia never rises by more than a bad start may."""
    x = cluster.sweep_groups(stored(profiles(s, d), "profiles"), "wave", _cols(s, d), range(2, 11), range(42, 52), least=5)
    before = F.lag("inertia").over(W.partitionBy("wave").orderBy("k"))
    x = x.withColumn("ok", F.coalesce(F.col("inertia") <= before * 1.02, F.lit(True)))
    return x.groupBy("wave").agg(F.countDistinct("k").alias("n_k"), F.sum(F.col("best").cast("int")).cast("int").alias("n_best"), F.bool_and("ok").alias("falls"))


def _label_checks(x: DataFrame, group: str | None = None) -> DataFrame:
    """Rows, clusters, rows without one, and whether clusters are numbered by size."""
    n = x.groupBy((F.col(group) if group else F.lit(0)).alias("g"), "cluster").agg(F.count(F.lit(1)).alias("n"))
    falls = F.col("n") <= F.lag("n").over(W.partitionBy("g").orderBy("cluster"))
    return n.withColumn("ok", F.coalesce(falls, F.lit(True))).groupBy("g").agg(F.sum("n").alias("n"), F.count("cluster").cast("int").alias("clusters"), F.sum(F.when(F.col("cluster").isNull(), F.col("n")).otherwise(0)).cast("int").alias("lost"), F.bool_and("ok").alias("by_size"))


def _characterise_checks(s: SparkSession, d: str) -> DataFrame:
    x = cluster.characterise(_assigned(s, d), _cols(s, d))
    one = x.groupBy("cluster").agg(F.first("size").alias("size"), F.sum("centroid").alias("shares"), *(F.first(c).alias(c) for c in ("n_kommun", "n_lansstyrelse", "n_MCF")))
    return one.agg(F.sum("size").alias("n"), *(F.sum(c).alias(c) for c in ("n_kommun", "n_lansstyrelse", "n_MCF")), F.round(F.avg("shares"), 6).alias("shares"))


def _density_checks(s: SparkSession, d: str) -> DataFrame:
    """Profiles, and those in a cluster; the SQL finds them by comparing all pairs."""
    p = profiles(s, d).withColumn("id", F.concat_ws("|", "entity", "wave"))
    x = cluster.neighbourhoods(p, "id", _cols(s, d), 0.3, 10)
    return x.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("cluster") != "-1", 1)).alias("inside"))


q("e28_cluster_summary", """WITH r AS (SELECT DISTINCT doc_id, sentence_id, sentence_text, actor_type, year, municipality FROM bert_corpus), x AS (SELECT length(coalesce(sentence_text, '')) % 5 AS cluster, actor_type AS category, TRY_CAST(year AS INTEGER) AS year, municipality AS place FROM r),
s AS (SELECT cluster, count(*) AS size FROM x GROUP BY cluster), m AS (SELECT cluster, category FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, category) AS r FROM (SELECT cluster, category, count(*) AS n FROM x WHERE category IS NOT NULL GROUP BY cluster, category)) WHERE r = 1),
yc AS (SELECT cluster, year, count(*) AS n FROM x WHERE year IS NOT NULL GROUP BY ALL), y AS (SELECT cluster, string_agg(year || ':' || n, ',' ORDER BY year) AS years, CASE WHEN arg_max(n, year) > arg_min(n, year) THEN 'Increasing' ELSE 'Decreasing' END AS trend FROM yc GROUP BY cluster),
p AS (SELECT cluster, string_agg(place, ',' ORDER BY r) AS top_places FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, place) AS r FROM (SELECT cluster, place, count(*) AS n FROM x WHERE place IS NOT NULL GROUP BY cluster, place)) WHERE r <= 5 GROUP BY cluster)
SELECT cluster, size, round(100 * size / (SELECT count(*) FROM x), 6) AS size_pct, category AS dominant, years, trend, top_places FROM s LEFT JOIN m USING (cluster) LEFT JOIN y USING (cluster) LEFT JOIN p USING (cluster)""")(lambda s, d: _cluster_summary(s, d))


def _cluster_summary(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "bert_corpus").select("doc_id", "sentence_id", "sentence_text", "actor_type", "year", "municipality").distinct()
    x = r.select((F.length(F.coalesce("sentence_text", F.lit(""))) % 5).cast("long").alias("cluster"), "actor_type", F.col("year").try_cast("int").alias("year"), "municipality")
    return _r(stats.cluster_summary(x, "cluster", "actor_type", "year", "municipality"), "size_pct")


q("j21_sentence_vectors", """WITH t AS (SELECT l_orderkey AS o, l_partkey AS w FROM lineitem), n AS (SELECT o, count(*) AS n FROM t GROUP BY o), g AS (SELECT vec_id, embedding FROM embeddings WHERE sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) > 0.01),
h AS (SELECT o, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM t JOIN g ON w = vec_id), m AS (SELECT o, i, avg(x) AS m, count(*) AS k FROM h GROUP BY ALL)
SELECT n.o, CAST(i AS INTEGER) AS i, round(m, 6) AS x, coalesce(k, 0) AS words_found, round(coalesce(k, 0) / n, 6) AS coverage FROM n LEFT JOIN m ON n.o = m.o""")(lambda s, d: _sentence_vectors(s, d))


def _sentence_vectors(s: SparkSession, d: str) -> DataFrame:
    """Each order is a sentence of its parts, each part a word with an embedding."""
    words = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vector"))
    return vectors.sentence_vectors(table(s, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").cast("string").alias("word")), words, "o").select("o", F.posexplode_outer("vector").alias("i", "x"), "words_found", F.round("coverage", 6).alias("coverage")).select("o", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"), "words_found", "coverage")


# --- the plain relational operators
q("a6_files_found", "SELECT DISTINCT file, file IN (SELECT filename FROM extraction_full WHERE filename IS NOT NULL) AS found FROM ocr_full_results WHERE file IS NOT NULL")(
    lambda s, d: table(s, d, "ocr_full_results").filter("file IS NOT NULL").select("file").distinct()
    .join(table(s, d, "extraction_full").select(F.col("filename").alias("file"), F.lit(True).alias("f")).filter("file IS NOT NULL").distinct(), "file", "left").select("file", F.coalesce("f", F.lit(False)).alias("found"))
)
q("a10_strict_success", "SELECT ocr_id FROM ocr_full_results WHERE text_length > 500 AND status = 'success'")(lambda s, d: table(s, d, "ocr_full_results").filter("text_length > 500 AND status = 'success'").select("ocr_id"))
q("c25_formatted", "SELECT DISTINCT doc_id, format('{:.1f} %', round(100 * chars_retained_pct, 1)) AS kept FROM quality WHERE chars_retained_pct IS NOT NULL")(
    lambda s, d: table(s, d, "quality").filter("chars_retained_pct IS NOT NULL").select("doc_id", F.format_string("%.1f %%", F.round(100 * F.col("chars_retained_pct"), 1)).alias("kept")).distinct()
)
q("g1_mixed_sort", "SELECT entity, wave, year, file FROM (SELECT DISTINCT entity, wave, year, file FROM term_document_matrix WHERE entity IS NOT NULL AND year IS NOT NULL) ORDER BY entity, wave DESC, year, file")(
    lambda s, d: table(s, d, "term_document_matrix").filter("entity IS NOT NULL AND year IS NOT NULL").select("entity", "wave", "year", "file").distinct().orderBy("entity", F.desc("wave"), "year", "file")
)
q("h1_union_all", "SELECT filename AS file FROM extraction_full UNION ALL SELECT file FROM ocr_full_results")(lambda s, d: table(s, d, "extraction_full").select(F.col("filename").alias("file")).unionByName(table(s, d, "ocr_full_results").select("file")))
q("h3_first_seen", "SELECT source, min(doc_id) AS ord FROM documents GROUP BY source")(lambda s, d: table(s, d, "documents").groupBy("source").agg(F.min("doc_id").alias("ord")))
q("h7_explode_words", r"WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS word FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(*) AS n FROM w WHERE word <> '' GROUP BY doc_id".replace("\\\\", "\\"))(
    lambda s, d: table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("word")).filter("word <> ''").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
)
q("d12_range_join", "WITH p(period, lo, hi) AS (VALUES ('a', 2006, 2012), ('b', 2012, 2018), ('c', 2018, 2025)) SELECT period, count(*) AS n FROM term_document_matrix JOIN p ON year BETWEEN lo AND hi GROUP BY period")(
    lambda s, d: table(s, d, "term_document_matrix").select("year").join(F.broadcast(s.createDataFrame([("a", 2006, 2012), ("b", 2012, 2018), ("c", 2018, 2025)], "period string, lo int, hi int")), F.col("year").between(F.col("lo"), F.col("hi"))).groupBy("period").agg(F.count(F.lit(1)).alias("n"))
)

# --- events
q("l_windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")(
    lambda s, d: _r(windows.windowed_counts(table(s, d, "events"), "ts", "event_type"), "total", n=4)
)
q("l_latest_event", "SELECT user_id, max(ts) AS latest, count(*) AS n FROM events GROUP BY user_id")(lambda s, d: windows.latest_of(table(s, d, "events"), "user_id", "ts"))
q("l_stream_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")(lambda s, d: _stream(s, d))


def _stream(s: SparkSession, d: str) -> DataFrame:
    """The same counts by a streaming query that runs until its input is read."""
    import uuid

    at = f"{own_dir(s)}/stream-{uuid.uuid4().hex}"
    src = windows.replay(s, f"{d}/events.parquet*", table(s, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.windowed_counts(src, "ts", "event_type", late="400 days")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out")

    out.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return _r(s.read.parquet(f"{at}/out").withColumn("start", F.col("start").cast("timestamp_ntz")), "total", n=4)


