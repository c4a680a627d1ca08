"""Queries on texts, sentences, file names and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textverk.functions import lexicon, meta, text
from textverk.operators import qualify, segment, terms
from textverk.session import small
from textverk.sources.tables import spread, table

Q: dict = {}
SQL: dict[str, str] = {}


def q(name: str, sql: str | None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def ext(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "extraction_full").filter("success AND text IS NOT NULL")


E = "e AS (SELECT * FROM extraction_full WHERE success AND text IS NOT NULL)"
D2 = r"regexp_replace(lower({c}), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')"


def _sql_count(term: str, c: str = "text") -> str:
    """Whole-word count that RE2 can do: every sign that is no word character is doubled, so
    neighbouring hits can each use one."""
    doubled = "".join(ch if ch.isalnum() or ch == "_" else ("\\" + ch if ch in "-.()" else ch) * 2 for ch in term.lower())
    return rf"CAST(len(regexp_extract_all({D2.format(c=c)}, '(?:^|[^\p{{L}}\p{{N}}_]){doubled}(?:$|[^\p{{L}}\p{{N}}_])')) AS BIGINT)"


def _sql_lit(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


ALL_TERMS = list(dict.fromkeys(t for _, t, _ in lexicon.rows()))
_COUNTS = f"WITH {E}, x AS MATERIALIZED (SELECT extraction_id, actor, lower(text) AS t, {D2.format(c='text')} AS dd FROM e), k AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT extraction_id, actor, {_sql_lit(t)} AS term, {_sql_count(t).replace(D2.format(c='text'), 'dd')} AS n FROM x WHERE contains(t, {_sql_lit(t.lower())})" for t in ALL_TERMS
) + ")"
q("c1_term_counts", f"{_COUNTS} SELECT extraction_id, term, n FROM k WHERE n > 0")(lambda s, d: terms.count_by_patterns(spread(ext(s, d).select("extraction_id", "text"), "extraction_id"), "extraction_id", "text", ALL_TERMS))
q("c2_term_counts_joined", f"{_COUNTS} SELECT extraction_id, term, n FROM k WHERE n > 0")(lambda s, d: counted(s, d).drop("actor"))
LEX_ALL_SQL = "lx AS (SELECT * FROM (VALUES " + ", ".join(f"({_sql_lit(c)}, {_sql_lit(t)}, {i})" for c, t, i in lexicon.rows()) + ") v(category, term, ord))"
q("e1_text_categories", f"{_COUNTS}, {LEX_ALL_SQL} SELECT extraction_id, category, CAST(sum(n) AS BIGINT) AS n FROM k JOIN lx USING (term) WHERE n > 0 GROUP BY extraction_id, category")(
    lambda s, d: counted(s, d).join(small(lexicon.default(s).select("category", "term")), "term").groupBy("extraction_id", "category").agg(F.sum("n").alias("n"))
)
q("e2_text_totals", f"{_COUNTS}, {LEX_ALL_SQL}, c AS (SELECT actor, category, n FROM k JOIN lx USING (term) WHERE n > 0) SELECT 'all' AS actor, category, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY category UNION ALL SELECT coalesce(actor, 'unknown') AS actor, category, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2")(
    lambda s, d: terms.totals(counted(s, d).join(small(lexicon.default(s).select("category", "term")), "term"))
)


def counted(s: SparkSession, d: str) -> DataFrame:
    """extraction_id, actor, term, n of the whole lexicon."""
    x = spread(ext(s, d).select("extraction_id", "text", "actor"), "extraction_id").withColumn("k", F.struct("extraction_id", "actor"))
    return terms.count_terms(x, "k", "text", lexicon.default(s)).select("k.extraction_id", "k.actor", "term", "n")


LEX = [("naturhot", "storm"), ("naturhot", "torka"), ("naturhot", "skred"), ("naturhot", "skogsbrand"), ("biologiska_hot", "pandemi"), ("biologiska_hot", "epidemi"), ("biologiska_hot", "smitta"), ("cyber_hot", "virus"), ("antagonistiska_hot", "sabotage"), ("antagonistiska_hot", "terror"), ("teknisk_infrastruktur", "elavbrott"), ("brand", "brand"), ("brand", "skogsbrand"), ("brand", "explosion"), ("olyckor", "dammbrott")]
LEX_SQL = "lex AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{t}', {i})" for i, (c, t) in enumerate(LEX)) + ") v(category, term, ord))"
_MAT = "m AS (SELECT DISTINCT * FROM term_document_matrix WHERE file IS NOT NULL), l AS (SELECT file, actor, entity, year, wave, term, n FROM (UNPIVOT m ON COLUMNS(* EXCLUDE (file, actor, entity, year, wave)) INTO NAME term VALUE n))"


def lex(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(c, t, i) for i, (c, t) in enumerate(LEX)], "category string, term string, ord int")


def long(s: SparkSession, d: str) -> DataFrame:
    return terms.melt(table(s, d, "term_document_matrix").filter("file IS NOT NULL").distinct())


q("e1_category_sums", f"WITH {_MAT}, {LEX_SQL} SELECT file, category, CAST(sum(n) AS BIGINT) AS n FROM l JOIN lex USING (term) GROUP BY file, actor, entity, year, wave, category")(lambda s, d: terms.category_sums(long(s, d), lex(s)).select("file", "category", "n"))
q("e2_category_totals", f"WITH {_MAT}, {LEX_SQL}, c AS (SELECT actor, category, n FROM l JOIN lex USING (term)) SELECT 'all' AS actor, category, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY category UNION ALL SELECT coalesce(actor, 'unknown') AS actor, category, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2")(
    lambda s, d: terms.totals(terms.wide_category_sums(table(s, d, "term_document_matrix").filter("file IS NOT NULL").distinct(), [(c, t) for c, t in LEX]))
)
q("e35_repeated_terms", f"WITH {LEX_ALL_SQL} SELECT term, count(DISTINCT category) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM lx GROUP BY term HAVING count(DISTINCT category) > 1")(lambda s, d: terms.repeated_terms(lexicon.default(s)))
q("d2_first_category", f"WITH {LEX_ALL_SQL} SELECT term, arg_min(category, ord) AS category FROM lx GROUP BY term")(lambda s, d: lexicon.default(s).groupBy("term").agg(F.min_by("category", "ord").alias("category")))
q("e19_category_share_by_year", f"WITH {_MAT}, {LEX_SQL}, c AS (SELECT year, category, sum(n) AS n FROM l JOIN lex USING (term) WHERE year IS NOT NULL GROUP BY ALL) SELECT year, category, round(100 * n / nullif(sum(n) OVER (PARTITION BY year), 0), 6) AS share FROM c")(lambda s, d: _year_share(s, d))


def _year_share(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    c = terms.category_sums(long(s, d), lex(s)).filter("year IS NOT NULL").groupBy("year", "category").agg(F.sum("n").alias("n"))
    return c.select("year", "category", F.round(F.try_divide(100 * F.col("n"), F.sum("n").over(W.partitionBy("year"))), 6).alias("share"))


q("e20_actor_means", f"WITH {_MAT}, {LEX_SQL}, c AS (SELECT file, actor, category, sum(n) AS n FROM l JOIN lex USING (term) GROUP BY ALL) SELECT actor, category, round(avg(n), 6) AS mean_n FROM c GROUP BY ALL")(
    lambda s, d: terms.category_sums(long(s, d), lex(s)).groupBy("actor", "category").agg(F.round(F.avg("n"), 6).alias("mean_n"))
)
q("f7_top_terms_per_category", f"WITH {_MAT}, {LEX_SQL}, c AS (SELECT category, term, sum(n) AS n FROM l JOIN lex USING (term) GROUP BY ALL) SELECT category, term, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, term) AS r FROM c) WHERE r <= 5")(lambda s, d: _top_terms(s, d))


def _top_terms(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    c = long(s, d).join(small(lex(s)), "term").groupBy("category", "term").agg(F.sum("n").alias("n"))
    return c.withColumn("r", F.row_number().over(W.partitionBy("category").orderBy(F.desc("n"), "term"))).filter("r <= 5").drop("r")


# --- file names and labels
FILES = "f AS (SELECT DISTINCT filename FROM extraction_full WHERE filename IS NOT NULL)"


def files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "extraction_full").select("filename").filter("filename IS NOT NULL").distinct()


q("b1_year", rf"WITH {FILES} SELECT filename, TRY_CAST(nullif(regexp_extract(filename, '(?:^|[^\p{{L}}\p{{N}}_])(20[0-2][0-9])(?:$|[^\p{{L}}\p{{N}}_])', 1), '') AS INTEGER) AS year FROM f")(lambda s, d: files(s, d).select("filename", meta.extract_year(F.col("filename")).alias("year")))
_S = r"'(?i)^RSA\s+(.+?)\s+(?:19|20)\d{2}(?:\s+(?:Maskad|Maskerad))?\s*\.pdf$'"
_O = r"'(?i)^[\p{L}\p{N}_]+\s+(.+?)\s+(?:19|20)\d{2}(?:\s+Maskad)?\s*\.pdf$'"
q("b2_entity", f"WITH {FILES} SELECT filename, coalesce(nullif(trim(regexp_extract(filename, {_S}, 1)), ''), nullif(trim(regexp_extract(filename, {_O}, 1)), ''), 'unknown') AS entity FROM f")(
    lambda s, d: files(s, d).select("filename", meta.extract_entity(F.col("filename")).alias("entity"))
)
_P = r"'(?i)^RSA\s+(.+?)\s+((?:19|20)\d{2})(\s+Maskad)?\s*\.pdf$'"
q("b3_parse_filename", rf"""WITH {FILES}, x AS (SELECT filename, regexp_matches(filename, {_P}) AS ok, regexp_replace(filename, '\.[^.]*$', '') AS stem FROM f), y AS (SELECT *, regexp_replace(regexp_replace(stem, '^RSA\s*', ''), '\s*[Mm]askad\s*$', '') AS base FROM x),
z AS (SELECT *, regexp_extract(base, '(?:^|[^\p{{L}}\p{{N}}_])((?:19|20)\d{{2}})(?:$|[^\p{{L}}\p{{N}}_])', 1) AS y FROM y)
SELECT filename, CASE WHEN ok THEN trim(regexp_extract(filename, {_P}, 1)) ELSE coalesce(nullif(trim(CASE WHEN y = '' THEN base ELSE replace(base, y, '') END), ''), 'unknown') END AS municipality, CASE WHEN ok THEN regexp_extract(filename, {_P}, 2) ELSE coalesce(nullif(y, ''), 'unknown') END AS year, CASE WHEN ok THEN regexp_extract(filename, {_P}, 3) <> '' ELSE contains(lower(stem), 'maskad') END AS maskad FROM z""")(
    lambda s, d: files(s, d).select("filename", meta.parse_filename(F.col("filename")).alias("p")).select("filename", "p.*")
)
q("b4_wave", "SELECT DISTINCT year, CASE WHEN year IS NULL THEN NULL WHEN year < 2015 THEN 0 WHEN year <= 2018 THEN 1 WHEN year <= 2022 THEN 2 ELSE 3 END AS wave FROM term_document_matrix")(
    lambda s, d: table(s, d, "term_document_matrix").select("year").distinct().withColumn("wave", meta.wave_of(F.col("year")))
)
_ACT = "CASE WHEN actor IS NULL OR trim(actor) = '' THEN 'unknown' WHEN lower(trim(actor)) IN ('kommun', 'kommuner') THEN 'kommun' WHEN lower(trim(actor)) IN ('länsstyrelse', 'länsstyrelsen', 'länsstyrelser', 'lansstyrelse') THEN 'lansstyrelse' WHEN lower(trim(actor)) IN ('mcf', 'msb', 'myndighet') THEN 'MCF' ELSE lower(trim(actor)) END"
q("b5_actor", f"SELECT {_ACT} AS actor_type, count(*) AS n FROM extraction_full GROUP BY 1")(lambda s, d: table(s, d, "extraction_full").groupBy(meta.normalise_actor(F.col("actor")).alias("actor_type")).agg(F.count(F.lit(1)).alias("n")))
q("b6_labels", "SELECT DISTINCT actor, CASE actor WHEN 'kommun' THEN 'Municipality' WHEN 'länsstyrelse' THEN 'Prefecture' ELSE actor END AS label FROM term_document_matrix")(
    lambda s, d: table(s, d, "term_document_matrix").select("actor").distinct().withColumn("label", meta.translate(F.col("actor"), {"kommun": "Municipality", "länsstyrelse": "Prefecture"}))
)
q("b12_numeric_year", "SELECT doc_id, sentence_id, TRY_CAST(year AS INTEGER) AS year FROM (SELECT DISTINCT doc_id, sentence_id, year FROM bert_corpus) WHERE TRY_CAST(year AS INTEGER) IS NOT NULL")(
    lambda s, d: table(s, d, "bert_corpus").select("doc_id", "sentence_id", F.col("year").try_cast("int").alias("year")).distinct().filter("year IS NOT NULL")
)
q("b13_periods", "SELECT CASE WHEN year BETWEEN 2011 AND 2015 THEN '2011-2015' WHEN year BETWEEN 2016 AND 2019 THEN '2016-2019' WHEN year BETWEEN 2020 AND 2024 THEN '2020-2024' END AS period, count(*) AS n FROM term_document_matrix WHERE year BETWEEN 2011 AND 2024 GROUP BY 1")(
    lambda s, d: table(s, d, "term_document_matrix").select(meta.period_of(F.col("year")).alias("period")).filter("period IS NOT NULL").groupBy("period").agg(F.count(F.lit(1)).alias("n"))
)
q("b10_semi_join", "SELECT DISTINCT filename FROM extraction_full WHERE filename IN (SELECT file FROM term_document_matrix WHERE entity = 'Storvrenna')")(
    lambda s, d: files(s, d).join(table(s, d, "term_document_matrix").filter("entity = 'Storvrenna'").select(F.col("file").alias("filename")), "filename", "left_semi")
)
q("d7_missing_files", "SELECT DISTINCT filename FROM extraction_full WHERE filename IS NOT NULL AND filename NOT IN (SELECT file FROM term_document_matrix WHERE file IS NOT NULL)")(
    lambda s, d: files(s, d).join(table(s, d, "term_document_matrix").select(F.col("file").alias("filename")), "filename", "left_anti")
)
q("h4_missing_terms", f"WITH {LEX_SQL} SELECT unnest(['storm', 'brand', 'lavin', 'isstorm']) AS term EXCEPT SELECT term FROM lex")(lambda s, d: s.createDataFrame([(t,) for t in ("storm", "brand", "lavin", "isstorm")], "term string").subtract(lex(s).select("term")))

# --- cleaning and quality
_ART = [p.replace(r"\s", r"[\s\p{Z}\x{85}\x{1C}-\x{1F}\x0B]").replace(r"\d", r"\p{Nd}") for p in text.ARTIFACTS]


def _sql_cleaned(src: str) -> str:
    """CTEs a0..a9: the text and the number of removed lines after each pattern in turn."""
    out = [f"a0 AS (SELECT extraction_id, text AS t, 0 AS n FROM {src})"]
    for i, p in enumerate(_ART):
        out.append(f"a{i + 1} AS MATERIALIZED (SELECT extraction_id, regexp_replace(t, '(?m){p}', '', 'g') AS t, n + len(regexp_extract_all(t, '(?m){p}')) AS n FROM a{i})")
    return ", ".join(out)


q("c9_artifact_lines", f"WITH {E}, {_sql_cleaned('e')} SELECT extraction_id, CAST(n AS INTEGER) AS n FROM a9")(lambda s, d: spread(ext(s, d).select("extraction_id", "text"), "extraction_id").select("extraction_id", text.artifact_counts(F.col("text"))[1].alias("n")))
_MOJI = "text"
for _a, _b in text.MOJIBAKE.items():
    _MOJI = f"replace({_MOJI}, {_sql_lit(_a)}, {_sql_lit(_b)})"
q("c8_replaced", f"WITH {E} SELECT extraction_id, {_MOJI} AS fixed FROM e")(lambda s, d: ext(s, d).select("extraction_id", text.replace_mojibake(F.col("text")).alias("fixed")))
q("c9_cleaned", f"WITH {E}, r AS (SELECT extraction_id, {_MOJI} AS text FROM e), {_sql_cleaned('r')} SELECT extraction_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[\\t\\x0B\\f\\r\\x{{1C}}-\\x{{1F}}\\x{{85}}\\p{{Z}}]+', ' ', 'g'), ' +\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[\\s\\p{{Z}}\\x{{85}}]+|[\\s\\p{{Z}}\\x{{85}}]+$', '', 'g') AS clean, CAST(n AS INTEGER) AS n_removed FROM a9")(lambda s, d: _cleaned(s, d))


def _cleaned(s: SparkSession, d: str) -> DataFrame:
    t, n = text.artifact_counts(text.replace_mojibake(F.col("text")))
    return spread(ext(s, d), "extraction_id").select("extraction_id", text.normal_space(t).alias("clean"), n.alias("n_removed"))


q("c8_round_trip", None)(lambda s, d: spread(ext(s, d).select("extraction_id", "text"), "extraction_id").select("extraction_id", text.repair_mojibake(F.col("text")).alias("fixed")))


q("c10_whitespace", rf"""WITH {E} SELECT extraction_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\t\x0B\f\r\x{{85}}\p{{Z}}]+', ' ', 'g'), ' +\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g') AS clean FROM e""")(
    lambda s, d: ext(s, d).select("extraction_id", text.normal_space(F.col("text")).alias("clean"))
)
_DENS = " + ".join(f"(length(text) - length(replace(text, '{a.replace(chr(39), chr(39) * 2)}', ''))) / {len(a)}" for a in text.MOJIBAKE)
q("c18_mojibake_density", f"WITH {E} SELECT extraction_id, round(coalesce(({_DENS}) * 1000 / nullif(length(text), 0), 0), 6) AS density FROM e")(
    lambda s, d: ext(s, d).select("extraction_id", F.round(text.mojibake_density(F.col("text")), 6).alias("density"))
)
q("c19_foreign_ratio", f"WITH {E} SELECT extraction_id, round(coalesce(length(regexp_replace(text, '[a-zåäöA-ZÅÄÖ0-9 .,;:!?()\\-/&%\\n\\t\"'']', '', 'g')) / nullif(length(text), 0), 0), 6) AS ratio FROM e")(
    lambda s, d: ext(s, d).select("extraction_id", F.round(text.foreign_ratio(F.col("text")), 6).alias("ratio"))
)
_SCORE = "least(greatest(0.4 * least(chars_retained_pct, 1) + 0.2 * (1 - least(short_sentence_pct, 1)) + 0.2 * greatest(1 - mojibake_density / 10, 0) + 0.2 * (1 - least(non_swedish_char_ratio, 1)), 0), 1)"
_NN = "chars_retained_pct IS NOT NULL AND short_sentence_pct IS NOT NULL AND mojibake_density IS NOT NULL AND non_swedish_char_ratio IS NOT NULL"
q("c20_quality_score", f"SELECT DISTINCT doc_id, round({_SCORE}, 4) AS score, CASE WHEN {_SCORE} >= 0.6 THEN 'ok' WHEN {_SCORE} >= 0.3 THEN 'low_quality' ELSE 'very_low_quality' END AS flag FROM quality WHERE {_NN}")(lambda s, d: _scores(s, d))


def _scores(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "quality").filter(_NN)
    score = text.quality_score(*(F.col(c) for c in ("chars_retained_pct", "short_sentence_pct", "mojibake_density", "non_swedish_char_ratio")))
    return x.select("doc_id", F.round(score, 4).alias("score"), text.quality_flag(score).alias("flag")).distinct()


q("e33_quality_summary", "SELECT count(*) AS n, round(avg(quality_score), 6) AS mean_score, count(*) FILTER (quality_flag <> 'ok') AS not_ok, count(*) FILTER (chapter_trimmed) AS trimmed, count(*) FILTER (chapter_trim_failed) AS failed FROM (SELECT DISTINCT * FROM quality)")(
    lambda s, d: table(s, d, "quality").distinct().agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality_score"), 6).alias("mean_score"), F.count(F.when(F.col("quality_flag") != "ok", 1)).alias("not_ok"), F.count(F.when(F.col("chapter_trimmed"), 1)).alias("trimmed"), F.count(F.when(F.col("chapter_trim_failed"), 1)).alias("failed"))
)
_CH = text.CHAPTER.replace("(?iU)", "(?i)").replace(r"[\.\s]", r"[.\s\p{Z}]").replace(r"\S", r"[^\s\p{Z}]").replace(r"\s*", r"[\s\p{Z}]*").replace(r"\s+", r"[\s\p{Z}]+")
q("c11_chapter_trim", f"""WITH {E}, x AS (SELECT extraction_id, text, regexp_extract(text, '{_CH}') AS h FROM e WHERE actor = 'kommun'), y AS (SELECT *, CASE WHEN h = '' THEN 0 ELSE strpos(text, h) END AS pos FROM x),
z AS (SELECT *, pos - 1 - length(regexp_extract(substr(text, 1, pos - 1), '[^\\n]*$')) AS start FROM y), w AS (SELECT *, pos > 0 AND start <= length(text) * 0.5 AS ok FROM z)
SELECT extraction_id, ok AND start > 0 AS trimmed, NOT ok OR start = 0 AS failed, CAST(CASE WHEN ok THEN length(text) - start ELSE length(text) END AS INTEGER) AS n_chars FROM w""")(
    lambda s, d: ext(s, d).filter("actor = 'kommun'").select("extraction_id", text.trim_to_chapter(F.col("text")).alias("t")).select("extraction_id", "t.trimmed", "t.failed", F.length("t.text").alias("n_chars"))
)
q("c12_sentences", rf"WITH {E}, x AS (SELECT extraction_id, string_split(regexp_replace(text, '([.!?])[\s\p{{Z}}\x{{85}}]+', '\1' || chr(1), 'g'), chr(1)) AS a FROM e) SELECT extraction_id, CAST(unnest(generate_series(1, len(a))) AS INTEGER) AS sentence_id, unnest(a) AS sentence FROM x")(
    lambda s, d: spread(ext(s, d), "extraction_id").select("extraction_id", F.posexplode(text.naive_sentences(F.col("text"))).alias("i", "sentence")).select("extraction_id", (F.col("i") + 1).alias("sentence_id"), "sentence")
)
ROWS = "r AS (SELECT DISTINCT doc_id, sentence_id, sentence_text, actor_type, doc_quality FROM bert_corpus WHERE sentence_text IS NOT NULL)"
_TOK = r"len(list_filter(regexp_split_to_array(sentence_text, '[\s\p{Z}\x{85}]+'), lambda x: x <> ''))"


def rows(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "bert_corpus").filter("sentence_text IS NOT NULL").select("doc_id", "sentence_id", "sentence_text", "actor_type", "doc_quality").distinct()


q("c21_token_counts", f"WITH {ROWS} SELECT doc_id, sentence_id, CAST({_TOK} AS INTEGER) AS n FROM r")(lambda s, d: rows(s, d).select("doc_id", "sentence_id", F.size(text.tokens(F.col("sentence_text"))).alias("n")))
q("c17_sentence_filter", rf"WITH {ROWS} SELECT doc_id, sentence_id FROM r WHERE {_TOK} BETWEEN 3 AND 300 AND (length(sentence_text) = 0 OR length(regexp_replace(sentence_text, '[^\p{{L}}]', '', 'g')) / length(sentence_text) >= 0.5)")(
    lambda s, d: rows(s, d).filter(F.size(text.tokens(F.col("sentence_text"))).between(3, 300) & (F.coalesce(text.alpha_ratio(F.col("sentence_text")), F.lit(1.0)) >= 0.5)).select("doc_id", "sentence_id")
)
_NEGS = "|".join(lexicon.NEGATIONS)
_NEG = rf"regexp_matches({D2.format(c='sentence_text')}, '(?:^|[^\p{{L}}\p{{N}}_])(?:{_NEGS})(?:$|[^\p{{L}}\p{{N}}_])')"
q("c22_negated", f"WITH {ROWS} SELECT doc_id, sentence_id FROM r WHERE {_NEG}")(lambda s, d: rows(s, d).filter(text.negated(F.col("sentence_text"))).select("doc_id", "sentence_id"))
q("c23_substring_not_word", rf"WITH {ROWS} SELECT doc_id, sentence_id FROM r WHERE contains(lower(sentence_text), 'ej') AND NOT regexp_matches({D2.format(c='sentence_text')}, '(?:^|[^\p{{L}}\p{{N}}_])ej(?:$|[^\p{{L}}\p{{N}}_])')")(
    lambda s, d: rows(s, d).filter(F.lower("sentence_text").contains("ej") & ~F.lower("sentence_text").rlike(r"(?U)\bej\b")).select("doc_id", "sentence_id")
)
q("e36_negation_by_actor", f"WITH {ROWS}, x AS (SELECT actor_type, {_NEG} AS neg FROM r) SELECT actor_type, CAST(count(*) FILTER (neg) AS BIGINT) AS negated, count(*) AS n, round(100 * count(*) FILTER (neg) / count(*), 2) AS rate, CASE WHEN 100 * count(*) FILTER (neg) / count(*) < 5 THEN 'LOW' WHEN 100 * count(*) FILTER (neg) / count(*) < 10 THEN 'MODERATE' ELSE 'HIGH' END AS level FROM x GROUP BY actor_type")(
    lambda s, d: rows(s, d).groupBy("actor_type").agg(F.count(F.when(text.negated(F.col("sentence_text")), 1)).alias("negated"), F.count(F.lit(1)).alias("n"))
    .withColumn("r", 100 * F.col("negated") / F.col("n")).select("actor_type", "negated", "n", F.round("r", 2).alias("rate"), F.when(F.col("r") < 5, "LOW").when(F.col("r") < 10, "MODERATE").otherwise("HIGH").alias("level"))
)
q("d9_quality_to_sentences", f"WITH {ROWS}, k AS (SELECT doc_id, max(quality_score) AS s FROM quality GROUP BY doc_id) SELECT r.doc_id, sentence_id, coalesce(s, 0) AS quality FROM r LEFT JOIN k ON r.doc_id = k.doc_id")(
    lambda s, d: rows(s, d).join(table(s, d, "quality").groupBy("doc_id").agg(F.max("quality_score").alias("s")), "doc_id", "left").select("doc_id", "sentence_id", F.coalesce("s", F.lit(0.0)).alias("quality"))
)
# Forms and lemmas of words in the lexicon: fixed values
LEM = [
    ("översvämningar", "översvämning"), ("värmeböljor", "värmebölja"), ("torkor", "torka"), ("stormar", "storm"), ("skogsbränder", "skogsbrand"), ("gräsbränder", "gräsbrand"),
    ("bränder", "brand"), ("epidemier", "epidemi"), ("pandemier", "pandemi"), ("zoonoser", "zoonos"), ("djursjukdomar", "djursjukdom"), ("vägolyckor", "vägolycka"),
    ("trafikolyckor", "trafikolycka"), ("tågolyckor", "tågolycka"), ("cyberattacker", "cyberattack"), ("nätattacker", "nätattack"), ("vattenläckor", "vattenläcka"),
    ("explosioner", "explosion"), ("klimatförändringar", "klimatförändring"), ("klimatförändringarna", "klimatförändring"), ("klimatförändringen", "klimatförändring"), ("kommunen", "kommun"), ("kommuner", "kommun"),
]
_LEMS = "v AS (SELECT * FROM (VALUES " + ", ".join(map(str, LEM)) + ") v(surface, lemma))"
_TOKENS = rf"w AS (SELECT doc_id, sentence_id, i, s.w AS surface, coalesce(lemma, lower(s.w)) AS lemma FROM (SELECT doc_id, sentence_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, sentence_id, regexp_extract_all(sentence_text, '{segment.TOKEN_SQL}') AS l FROM r)) s LEFT JOIN v ON lower(s.w) = v.surface)"
_KEPT = f"k AS (SELECT * FROM w WHERE NOT regexp_matches(surface, '^[^\\p{{L}}\\p{{N}}_\\p{{M}}\\s]+$') AND lemma NOT IN ({', '.join(map(_sql_lit, segment.STOPWORDS))}) AND lower(surface) NOT IN ({', '.join(map(_sql_lit, segment.STOPWORDS))}))"


def lemmas(s: SparkSession) -> DataFrame:
    return s.createDataFrame(LEM, "surface string, lemma string")


def _tokens(s: SparkSession, d: str) -> DataFrame:
    return segment.lemmatised(segment.tokens(rows(s, d), "sentence_text", "doc_id", "sentence_id"), lemmas(s))


q("c13_lemmas", f"WITH {ROWS}, {_LEMS}, {_TOKENS} SELECT lemma, count(*) AS n FROM w GROUP BY lemma")(lambda s, d: _tokens(s, d).groupBy("lemma").agg(F.count(F.lit(1)).alias("n")))
q("c15_no_punctuation", f"WITH {ROWS}, {_LEMS}, {_TOKENS} SELECT doc_id, sentence_id, count(*) FILTER (NOT regexp_matches(surface, '^[^\\p{{L}}\\p{{N}}_\\p{{M}}\\s]+$')) AS words, count(*) AS tokens FROM w GROUP BY doc_id, sentence_id")(
    lambda s, d: _tokens(s, d).groupBy("doc_id", "sentence_id").agg(F.count(F.when(~segment.punctuation(F.col("surface")), 1)).alias("words"), F.count(F.lit(1)).alias("tokens"))
)
q("c16_content_words", f"WITH {ROWS}, {_LEMS}, {_TOKENS}, {_KEPT} SELECT lemma AS word, count(*) AS n FROM k GROUP BY lemma")(lambda s, d: segment.content(_tokens(s, d)).groupBy(F.col("lemma").alias("word")).agg(F.count(F.lit(1)).alias("n")))
q("c16_sentences", f"WITH {ROWS}, {_LEMS}, {_TOKENS}, {_KEPT} SELECT doc_id, sentence_id, string_agg(lemma, ' ' ORDER BY i, lemma) AS lemmas, CAST(count(*) AS INTEGER) AS word_count FROM (SELECT DISTINCT doc_id, sentence_id, i, lemma FROM k) GROUP BY doc_id, sentence_id")(
    lambda s, d: segment.lemma_sentences(_tokens(s, d), "doc_id", "sentence_id")
)
q("c14_lexicon_lemmas", f"WITH {LEX_ALL_SQL}, {_LEMS} SELECT category, coalesce(lemma, term) AS lemma, min(ord) AS ord, string_agg(DISTINCT term, ',' ORDER BY term) AS originals FROM lx LEFT JOIN v ON term = surface GROUP BY category, coalesce(lemma, term)")(lambda s, d: terms.lemmatise_lexicon(lexicon.default(s), lemmas(s)))

# --- sentences and the categories of their words
_HIT = f"h AS (SELECT DISTINCT doc_id, sentence_id, i, lemma AS term FROM k WHERE lemma IN (SELECT term FROM lx)), sc AS (SELECT doc_id, sentence_id, list_sort(list(DISTINCT category)) AS categories FROM h JOIN lx USING (term) GROUP BY ALL), st AS (SELECT doc_id, sentence_id, string_agg(term, ', ' ORDER BY i, term) AS target_terms, CAST(count(*) AS INTEGER) AS n_terms FROM h GROUP BY ALL)"
_LL = f"WITH {ROWS}, {LEX_ALL_SQL}, {_LEMS}, {_TOKENS}, {_KEPT}, {_HIT}"
q("d8_sentence_terms", f"{_LL} SELECT doc_id, sentence_id, target_terms, n_terms, array_to_string(categories, ',') AS categories FROM st JOIN sc USING (doc_id, sentence_id)")(
    lambda s, d: _sentence_terms(s, d).select("doc_id", "sentence_id", F.array_join("target_terms", ", ").alias("target_terms"), F.size("target_terms").alias("n_terms"), F.array_join("categories", ",").alias("categories"))
)
q("d8_pairs", f"{_LL} SELECT doc_id, sentence_id, unnest(categories) AS category, target_terms FROM st JOIN sc USING (doc_id, sentence_id)")(
    lambda s, d: segment.category_pairs(_sentence_terms(s, d)).select("doc_id", "sentence_id", "category", F.array_join("target_terms", ", ").alias("target_terms"))
)
q("d10_unique_sentences", f"{_LL} SELECT doc_id, sentence_id, array_to_string(categories, ',') AS all_categories, CAST(len(categories) AS INTEGER) AS n_categories FROM sc")(
    lambda s, d: segment.unique_sentences(segment.category_pairs(_sentence_terms(s, d)), "doc_id", "sentence_id")
)
q("e36_negation_by_category", f"{_LL}, p AS (SELECT doc_id, sentence_id, unnest(categories) AS category FROM sc), g AS (SELECT doc_id, sentence_id, bool_or({_NEG}) AS neg FROM r GROUP BY ALL) SELECT category, CAST(count(*) FILTER (neg) AS BIGINT) AS negated, count(*) AS n, round(100 * count(*) FILTER (neg) / count(*), 2) AS rate FROM p JOIN g USING (doc_id, sentence_id) GROUP BY category")(lambda s, d: _negation_by_category(s, d))
q("e36_negation_words", f"WITH {ROWS}, w AS (SELECT unnest(regexp_extract_all({D2.format(c='sentence_text')}, '(?:^|[^\\p{{L}}\\p{{N}}_])({_NEGS})(?:$|[^\\p{{L}}\\p{{N}}_])', 1)) AS word FROM r) SELECT word, count(*) AS n FROM w GROUP BY word")(
    lambda s, d: rows(s, d).select(F.explode(text.negations(F.col("sentence_text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
)


def _sentence_terms(s: SparkSession, d: str) -> DataFrame:
    return segment.sentence_terms(segment.content(_tokens(s, d)), lexicon.default(s), "doc_id", "sentence_id")


def _negation_by_category(s: SparkSession, d: str) -> DataFrame:
    neg = rows(s, d).groupBy("doc_id", "sentence_id").agg(F.bool_or(text.negated(F.col("sentence_text"))).alias("neg"))
    p = segment.category_pairs(_sentence_terms(s, d)).join(neg, ["doc_id", "sentence_id"])
    return p.groupBy("category").agg(F.count(F.when(F.col("neg"), 1)).alias("negated"), F.count(F.lit(1)).alias("n")).withColumn("rate", F.round(100 * F.col("negated") / F.col("n"), 2))


# --- contexts and levels
_WIN = r"(?i)(?:(\S+)\s+){0,4}\b(risk|risken|risker|riskens)\b(?:\s+(\S+)){0,9}"
q("c5_contexts", None)(lambda s, d: qualify.contexts(spread(ext(s, d), "extraction_id"), "extraction_id", "text", "risk"))
q("c7_levels", None)(lambda s, d: qualify.qualify(qualify.contexts(spread(ext(s, d), "extraction_id"), "extraction_id", "text", "risk"), "risk").select("extraction_id", "k", "qualifier", "level"))
q("e2_level_totals", None)(lambda s, d: qualify.level_totals(_levels(s, d)))
q("e21_level_shares", None)(lambda s, d: qualify.severity_shares(_levels(s, d)))
q("e22_other_rates", None)(lambda s, d: qualify.other_rates(_levels(s, d), ext(s, d)))


def _levels(s: SparkSession, d: str) -> DataFrame:
    return qualify.levels_of(spread(ext(s, d).select("extraction_id", "actor", "text"), "extraction_id"), "extraction_id", "text", "actor")
