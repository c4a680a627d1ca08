"""The pN_ queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

import inspect
import re
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textverk.functions import lexicon
from textverk.llm import p1_quality as p1
from textverk.llm import p10_levels as p10
from textverk.llm import p2_repeated_lines as p2
from textverk.llm import p3_scans as p3
from textverk.llm import p4_encoding as p4
from textverk.llm import p5_term_counts as p5
from textverk.llm import p6_near_duplicates as p6
from textverk.llm import p7_sentences as p7
from textverk.llm import p8_containers as p8
from textverk.llm import p9_mixture as p9
from textverk.llm import tokens
from textverk.session import own_dir, stored
from textverk.sources.tables import table

WORD = re.compile(r"[^\W\d_]+")


# --- 1: texts that are no prose


def _p1_scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("rec_id"), "text")
    ext = table(spark, d, "extraction_full").filter("success").select(F.lit("extraction_full").alias("src"), F.col("extraction_id").alias("rec_id"), "text")
    stats = stored(p1.document_statistics(docs.unionByName(ext)), "p1-statistics")
    return p1.scored(stats, stored(p1.profile(stats), "p1-sketches"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1_scored(spark, d).filter("no_prose").select("src", "rec_id")


def p1_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _p1_scored(spark, d)


# --- 2: lines repeated within an entity


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extraction_full").filter("success").select("extraction_id", "filename", "text")


def _entities(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "term_document_matrix").filter("file IS NOT NULL AND entity IS NOT NULL AND entity != 'unknown'")
    return m.groupBy(F.col("file").alias("doc")).agg(F.min("entity").alias("source"))


def _p2_places(spark: SparkSession, d: str) -> DataFrame:
    return p2.repeated(_extracted(spark, d), _entities(spark, d), "extraction_id", "filename", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2_places(spark, d).filter("whole").select(F.col("rec_id").alias("extraction_id"), F.col("line_no").cast("int").alias("line_no"))


def p2_clean_text(spark: SparkSession, d: str) -> DataFrame:
    df = _extracted(spark, d)
    return p2.cut(df, _p2_places(spark, d), "extraction_id", "text").withColumnRenamed("rec_id", "extraction_id")


# --- 3: faults of scanned text


def _scans(spark: SparkSession, d: str) -> DataFrame:
    ocr = table(spark, d, "ocr_full_results").select(F.lit("ocr_full_results").alias("src"), F.col("ocr_id").alias("rec_id"), "text", F.lit(True).alias("scanned"))
    ext = table(spark, d, "extraction_full").select(F.lit("extraction_full").alias("src"), F.col("extraction_id").alias("rec_id"), "text", F.coalesce(F.col("method").rlike("ocr$") & F.col("success"), F.lit(False)).alias("scanned"))
    return ocr.unionByName(ext)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3.faults(_scans(spark, d))


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return p3.restored(_scans(spark, d))


# --- 4: lines in a wrong encoding


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4.garbled(table(spark, d, "extraction_full"), "extraction_id", "text").select(F.col("rec_id").alias("extraction_id"), "line_no")


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    return p4.garbled(table(spark, d, "extraction_full"), "extraction_id", "text").withColumnRenamed("rec_id", "extraction_id")


# --- 5: term counts


def _p5_counts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Counts that came about in two batches, and the number of records.

    The first holds, as a delivery would, a part of the records, some of them in an earlier
    version (their first half) and some that do not belong to the files. The second brings the
    whole table: records are added, changed and deleted, and only these are counted again.
    """
    rows = table(spark, d, "bert_corpus").select(F.col("doc_id").alias("rec"), F.col("sentence_id").cast("long").alias("unit"), F.col("sentence_text").alias("text"))
    files = table(spark, d, "term_document_matrix").select(F.col("file").alias("rec")).filter("rec IS NOT NULL").distinct()
    part = F.pmod(F.xxhash64("rec"), F.lit(8))  # of a record: 0 early version, 1 to 6 as it is, 7 later
    first = rows.filter((part < 7) & ((part > 0) | F.coalesce(F.col("unit") % 2 == 0, F.lit(False))))
    state = p5.State(spark, f"{own_dir(spark)}/p5-state-{uuid.uuid4().hex}")
    state.apply(p5.changes(None, first))
    inside = rows.join(files, "rec", "left_semi")
    state.apply(p5.changes(first, inside, state.records()))
    return state.counts(), state.records().agg(F.count(F.lit(1)).alias("n"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5.mark(*_p5_counts(spark, d)).filter("mark IS NOT NULL").select("term", "mark")


def p5_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return p5.mark(*_p5_counts(spark, d)).select("term", "occurrences", F.col("records").alias("files"), "mark")


# --- 6: near-duplicate files


def _p6(spark: SparkSession, d: str, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    texts = _extracted(spark, d)
    docs = stored(p6.documents(texts, "filename", "text", weighted=weighted), "p6-docs")
    return docs, p6.links(docs, texts, "filename", "text", 0.7, weighted=weighted)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Distinct runs are asked for, so every weight is 1."""
    return p6.document_pairs(*_p6(spark, d))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups by the overlap of the multisets of runs, each weighted by its number."""
    return p6.groups(*_p6(spark, d, weighted=True))


# --- 7: sentences


def _sentence_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bert_corpus").select(F.col("doc_id").alias("doc"), F.col("sentence_id").alias("sid"), F.col("sentence_text").alias("text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7.starts(_sentence_rows(spark, d)).select(F.col("doc").alias("doc_id"), F.col("sid").alias("sentence_id"), F.col("start").alias("start_char"))


def p7_sentences(spark: SparkSession, d: str) -> DataFrame:
    return p7.sentences(_sentence_rows(spark, d)).withColumnRenamed("doc", "doc_id")


# --- 8: containers


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    size = tokens.sizes(table(spark, d, "documents").select("doc_id", "text"), "text")
    return p8.containers(size, table(spark, d, "container_specs"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return p8.report(p8_containers(spark, d))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold, a row a capacity: no container over it, a text in as few pieces as can be,
    the tokens of all texts, and little space left (90 % used, or one container alone)."""
    placed = stored(p8_containers(spark, d), "p8-placed")
    pieces = placed.groupBy("spec_id", "capacity", "doc_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    docs = pieces.groupBy("spec_id").agg(F.bool_and(F.col("n") == F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity")))).alias("undivided"), F.count(F.lit(1)).alias("texts"))
    x = p8.report(placed).join(docs, "spec_id")
    return x.select("spec_id", "texts", (F.col("fullest") <= F.col("capacity")).alias("within"), "undivided", ((F.col("fill") > 0.9) | (F.col("containers") == 1)).alias("filled"))


# --- 9: mixture of sources


def _topics() -> Callable[[str], str]:
    """The risk category whose words of one part are most frequent in a text, or 'none'."""
    of: dict[str, list[str]] = {}
    for c, t, _ in lexicon.rows():
        of.setdefault(t.lower(), []).append(c)

    def topic(text: str) -> str:
        n = Counter(c for w in WORD.findall(text.lower()) for c in of.get(w, ()))
        return min(n, key=lambda c: (-n[c], c)) if n else "none"

    return topic


def _p9(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The units, the mix and the targets."""
    tag = F.lower(F.split("lang", "[-_]")[0])
    lang = F.when(tag.rlike("^[a-z]{2,3}$"), tag)  # a language tag; what is none counts as missing
    docs = table(spark, d, "documents").select("doc_id", "source", lang.alias("language"), F.md5("text").alias("text_hash"), "text")
    targets = table(spark, d, "mix_targets")
    docs = docs.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")  # a row a target
    units = p9.units(tokens.sizes(docs, "text", extra={"topic": ("string", _topics())}), targets)
    return units, p9.mixture(units, targets), targets


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d)[1].drop("text_hash")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    units, mix, targets = _p9(spark, d)
    return p9.shares(stored(mix, "p9-mix"), targets, units)


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the shares, as one row: every source with tokens is used, no text beyond
    its cap, the whole has the size of all texts, and the sources that are not at their cap are
    in proportion to their targets (within 1 % or half of the source's mean text)."""
    units, mix, targets = _p9(spark, d)
    x = p9.shares(stored(mix, "p9-mix"), targets, units).join(F.broadcast(units.groupBy("source").agg((F.avg("n_tokens") / 2).alias("one"))), "source", "left")
    free = F.col("held_by") == "target"
    x = x.crossJoin(F.broadcast(x.agg(F.sum(F.when(free, F.col("tokens"))).alias("free_tokens"), F.sum(F.when(free, F.col("target_share"))).alias("free_share"))))
    due = F.col("free_tokens") * F.col("target_share") / F.col("free_share")
    return x.agg(
        F.bool_and((F.col("tokens") > 0) | (F.col("available") == 0)).alias("all_used"),
        F.bool_and(F.col("most_copies") <= F.col("max_repeats")).alias("within_caps"),
        (F.abs(F.sum("tokens") / F.sum("available") - 1) < 0.02).alias("whole_size"),
        F.bool_and(~free | (F.abs(F.col("tokens") - due) <= F.greatest(due * 0.01, F.col("one")))).alias("in_proportion"),
    )


# --- 10: reading levels


def _p10(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "reading_labels").select("doc_id", F.col("reading_level").alias("level"))
    return p10.levels(table(spark, d, "documents").select("doc_id", "text"), labels)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _p10(spark, d).select("doc_id", "reading_level")


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return _p10(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if re.match(r"p\d+_[a-z]", k) and inspect.isfunction(v)}


def oracle_sql() -> dict[str, str]:
    """For the queries whose definition SQL can state (problems 2, 5 and 6)."""
    terms = r"""
WITH f AS (SELECT DISTINCT file FROM term_document_matrix WHERE file IS NOT NULL), r AS (SELECT doc_id, sentence_id, min(sentence_text) AS t FROM bert_corpus WHERE doc_id IN (SELECT file FROM f) GROUP BY doc_id, sentence_id),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(nfc_normalize(t)), '[\p{L}\p{M}]+')) AS term FROM r WHERE t IS NOT NULL), c AS (SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS files FROM w GROUP BY term),
k AS (SELECT count(DISTINCT doc_id) AS k FROM r), m AS (SELECT term, occurrences, files, CASE WHEN occurrences < 4 OR files < 2 THEN 'rare' WHEN files > 0.3 * k THEN 'common' END AS mark FROM c, k) """
    return {
        "p8_checks": "SELECT spec_id, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS texts, true AS within, true AS undivided, true AS filled FROM container_specs WHERE capacity_tokens > 0",
        "p9_checks": "SELECT true AS all_used, true AS within_caps, true AS whole_size, true AS in_proportion",
        "p5_term_counts": terms + "SELECT term, occurrences, files, mark FROM m",
        "p5_found": terms + "SELECT term, mark FROM m WHERE mark IS NOT NULL",
        "p6_found": r"""
WITH d AS (SELECT filename, min(text) AS text FROM extraction_full WHERE success AND text IS NOT NULL AND filename IS NOT NULL GROUP BY filename), w AS (SELECT filename, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM d),
s AS (SELECT DISTINCT filename, unnest(list_zip(w[:-3], w[2:-2], w[3:])) AS g FROM w WHERE len(w) >= 40), n AS (SELECT filename, count(*) AS n FROM s GROUP BY filename),
p AS (SELECT a.filename AS filename_a, b.filename AS filename_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.filename < b.filename GROUP BY ALL)
SELECT filename_a, filename_b FROM p JOIN n x ON x.filename = filename_a JOIN n y ON y.filename = filename_b WHERE k >= 0.7 * (x.n + y.n - k)""",
        "p2_found": r"""
WITH ent AS (SELECT file, min(entity) AS entity FROM term_document_matrix WHERE entity IS NOT NULL AND entity <> 'unknown' AND file IS NOT NULL GROUP BY file),
src AS (SELECT x.extraction_id, x.filename, e.entity, x.text FROM extraction_full x JOIN ent e ON x.filename = e.file WHERE x.success),
n AS (SELECT entity, count(DISTINCT filename) AS nd FROM src GROUP BY entity),
l AS (SELECT extraction_id, filename, entity, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM src WHERE text IS NOT NULL),
k AS (SELECT *, regexp_replace(lower(line), '[^\p{L}]', '', 'g') AS w FROM l),
hot AS (SELECT k.entity, w FROM k JOIN n ON n.entity = k.entity WHERE length(w) BETWEEN 8 AND 150 GROUP BY k.entity, w, nd HAVING count(DISTINCT filename) >= 5 AND count(DISTINCT filename) * 5 >= nd)
SELECT extraction_id, CAST(line_no AS INTEGER) AS line_no FROM k JOIN hot USING (entity, w)""",
    }
