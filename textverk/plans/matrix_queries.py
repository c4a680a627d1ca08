"""Queries over the term-document matrix: panels, transitions, persistence, diffusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textverk.operators import diffusion, panel, persistence, terms
from textverk.sources.tables import table

# --- SQL building blocks
M = "m AS (SELECT DISTINCT * FROM term_document_matrix WHERE file IS NOT NULL)"


def _un(src: str, name: str) -> str:
    return f"{name} AS (SELECT file, actor, entity, year, wave, term, n FROM (UNPIVOT {src} ON COLUMNS(* EXCLUDE (file, actor, entity, year, wave)) INTO NAME term VALUE n))"


L = _un("m", "l")
ONE = "one AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY entity, wave ORDER BY year DESC NULLS LAST, file DESC) AS r FROM m WHERE entity IS NOT NULL AND wave IS NOT NULL) WHERE r = 1)"
PANEL = "panel AS (SELECT * FROM one WHERE entity IN (SELECT entity FROM one GROUP BY entity HAVING count(DISTINCT wave) >= 2))"
T = """t AS (SELECT *, CASE WHEN present_from = 1 AND present_to = 1 THEN 'persist' WHEN present_from = 1 THEN 'dropout' WHEN present_to = 1 THEN 'adopt' ELSE 'stable_absent' END AS transition, 'W' || wave_from || '→W' || wave_to AS wave_pair FROM (
SELECT entity, first_value(actor) OVER (PARTITION BY entity, term ORDER BY wave) AS actor, term, wave AS wave_from, lead(wave) OVER (PARTITION BY entity, term ORDER BY wave) AS wave_to, CAST(n > 0 AS INTEGER) AS present_from, lead(CAST(n > 0 AS INTEGER)) OVER (PARTITION BY entity, term ORDER BY wave) AS present_to FROM pl) WHERE wave_to IS NOT NULL)"""
TRANS = ", ".join((M, ONE, PANEL, _un("panel", "pl"), T))
JAC = """j AS (SELECT *, coalesce(CAST(n_intersection AS DOUBLE) / nullif(n_union, 0), 0) AS jaccard FROM (SELECT entity, actor, wave_from, wave_to, wave_pair, CAST(sum(present_from) AS BIGINT) AS n_terms_t, CAST(sum(present_to) AS BIGINT) AS n_terms_t1, CAST(sum(present_from * present_to) AS BIGINT) AS n_intersection, CAST(sum(greatest(present_from, present_to)) AS BIGINT) AS n_union FROM t GROUP BY ALL))"""
ENT = "ent AS (SELECT entity, min(year) AS y0, arg_min(actor, (year, file)) AS actor FROM m WHERE year IS NOT NULL AND entity IS NOT NULL GROUP BY entity)"
FA = "fa AS (SELECT l.entity, any_value(ent.actor) AS actor, term, min(year) AS first_year, min(year) = any_value(y0) AS is_left_censored FROM l JOIN ent ON l.entity = ent.entity WHERE year IS NOT NULL AND n > 0 GROUP BY l.entity, term)"
FIRST = ", ".join((M, L, ENT, FA))


def matrix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "term_document_matrix").filter("file IS NOT NULL").distinct()


def long(spark: SparkSession, d: str) -> DataFrame:
    return terms.melt(matrix(spark, d))


def transitions(spark: SparkSession, d: str) -> DataFrame:
    return panel.wave_transitions(terms.melt(panel.build_panel(matrix(spark, d))))


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


Q: dict = {}
SQL: dict[str, str] = {}


def q(name: str, sql: str):
    def add(f):
        Q[name] = f
        SQL[name] = sql
        return f

    return add


q("h5_melt_matrix", f"WITH {M}, {L} SELECT * FROM l")(lambda s, d: long(s, d))
q("h6_pivot_matrix", f"WITH {M} SELECT file, CAST(sum(storm) AS BIGINT) AS storm, CAST(sum(brand) AS BIGINT) AS brand, CAST(sum(virus) AS BIGINT) AS virus FROM m GROUP BY file, actor, entity, year, wave")(
    lambda s, d: terms.spread_wide(long(s, d).filter(F.col("term").isin("storm", "brand", "virus")), ["storm", "brand", "virus"]).select("file", "storm", "brand", "virus")
)
q("e34_sparsity", f"WITH {M}, {L} SELECT count(DISTINCT term) AS terms, count(DISTINCT file) AS files, CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS nonzero, round(1 - sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) / (count(DISTINCT term) * count(DISTINCT file)), 6) AS sparsity FROM l")(
    lambda s, d: _r(terms.sparsity(long(s, d)), "sparsity")
)
q("f1_latest_last", f"WITH {M}, {ONE} SELECT entity, wave, file, year FROM one")(lambda s, d: panel.latest_per_wave(matrix(s, d)).select("entity", "wave", "file", "year"))
q("f2_latest_first", f"WITH {M} SELECT entity, wave, file, year FROM (SELECT *, row_number() OVER (PARTITION BY entity, wave ORDER BY year DESC NULLS LAST, file) AS r FROM m WHERE entity IS NOT NULL AND wave IS NOT NULL) WHERE r = 1")(
    lambda s, d: panel.latest_per_wave(matrix(s, d), last=False).select("entity", "wave", "file", "year")
)
q("f3_waves_per_entity", f"WITH {M}, {ONE} SELECT entity, count(DISTINCT wave) AS n_waves FROM one GROUP BY entity HAVING count(DISTINCT wave) >= 2")(
    lambda s, d: panel.latest_per_wave(matrix(s, d)).groupBy("entity").agg(F.countDistinct("wave").alias("n_waves")).filter("n_waves >= 2")
)
q("i1_panel", f"WITH {M}, {ONE}, {PANEL} SELECT entity, wave, file FROM panel")(lambda s, d: panel.build_panel(matrix(s, d)).select("entity", "wave", "file"))
q("i3_transitions", f"WITH {TRANS} SELECT entity, actor, term, wave_from, wave_to, wave_pair, present_from, present_to, transition FROM t")(transitions)
q("i2_transition_counts", f"WITH {TRANS} SELECT transition, count(*) AS n FROM t GROUP BY transition")(lambda s, d: transitions(s, d).groupBy("transition").agg(F.count(F.lit(1)).alias("n")))
q("i4_direct_transitions", f"""WITH {M}, {ONE}, {_un("one", "pl")} SELECT a.entity, a.term, a.actor, CAST(a.n > 0 AS INTEGER) AS present_from, CAST(b.n > 0 AS INTEGER) AS present_to,
CASE WHEN a.n > 0 AND b.n > 0 THEN 'persist' WHEN a.n > 0 THEN 'dropout' WHEN b.n > 0 THEN 'adopt' ELSE 'stable_absent' END AS transition FROM pl a JOIN pl b ON a.entity = b.entity AND a.term = b.term AND a.wave = 1 AND b.wave = 3 WHERE a.actor = 'kommun'""")(
    lambda s, d: panel.direct_transitions(terms.melt(panel.latest_per_wave(matrix(s, d))), 1, 3).filter("actor = 'kommun'")
)
q("i5_year_transitions", f"""WITH {M}, {L}, x AS (SELECT entity, actor, term, year AS year_from, lead(year) OVER w AS year_to, CAST(n > 0 AS INTEGER) AS present_from, lead(CAST(n > 0 AS INTEGER)) OVER w AS present_to FROM l WHERE year IS NOT NULL AND entity IS NOT NULL WINDOW w AS (PARTITION BY entity, term ORDER BY year, file))
SELECT year_from || '→' || year_to AS year_pair, CASE WHEN present_from = 1 AND present_to = 1 THEN 'persist' WHEN present_from = 1 THEN 'dropout' WHEN present_to = 1 THEN 'adopt' ELSE 'stable_absent' END AS transition, count(*) AS n FROM x WHERE year_to IS NOT NULL AND actor <> 'kommun' GROUP BY ALL""")(
    lambda s, d: panel.year_transitions(long(s, d)).filter("actor <> 'kommun'").groupBy("year_pair", "transition").agg(F.count(F.lit(1)).alias("n"))
)
q("h2_jaccard", f"WITH {TRANS}, {JAC} SELECT * REPLACE (round(jaccard, 6) AS jaccard) FROM j")(lambda s, d: _r(panel.jaccard(transitions(s, d)), "jaccard"))
q("e9_jaccard_summary", f"WITH {TRANS}, {JAC} SELECT round(avg(jaccard), 6) AS mean, round(median(jaccard), 6) AS median, round(stddev_samp(jaccard), 6) AS std, count(*) AS n FROM j")(
    lambda s, d: _r(persistence.jaccard_summary(panel.jaccard(transitions(s, d))), "mean", "median", "std")
)
_RATE = "count(*) AS n_entities_t0, count(*) FILTER (transition = 'persist') AS n_entities_persist, count(*) FILTER (transition = 'dropout') AS n_entities_dropout, round(count(*) FILTER (transition = 'persist') / count(*), 6) AS persistence_rate, count(*) < 3 AS flag_low_n"
q("e6_persistence_by_term", f"WITH {TRANS} SELECT term, {_RATE} FROM t WHERE present_from = 1 GROUP BY term HAVING count(*) >= 3")(lambda s, d: _r(persistence.rates(transitions(s, d), "term", min_entities=3), "persistence_rate"))
q("e7_persistence_by_actor_pair", f"WITH {TRANS} SELECT actor, wave_pair, term, {_RATE} FROM t WHERE present_from = 1 GROUP BY ALL HAVING count(*) >= 3")(
    lambda s, d: _r(persistence.rates(transitions(s, d), "actor", "wave_pair", "term", min_entities=3), "persistence_rate")
)
_OV = "count(*) FILTER (transition = 'persist') AS persist, count(*) FILTER (transition = 'dropout') AS dropout, count(*) FILTER (transition = 'adopt') AS adopt, count(*) AS n, round(count(*) FILTER (transition = 'persist') / nullif(count(*) FILTER (present_from = 1), 0), 6) AS rate"
q("e8_persistence_overall", f"WITH {TRANS} SELECT 'all' AS actor, {_OV} FROM t UNION ALL SELECT coalesce(actor, 'unknown') AS actor, {_OV} FROM t GROUP BY 1")(lambda s, d: _r(persistence.overall(transitions(s, d)), "rate"))
q("e10_mean_persistence_by_actor", f"WITH {TRANS}, e AS (SELECT actor, entity, wave_pair, avg(CAST(transition = 'persist' AS DOUBLE)) AS rate FROM t WHERE present_from = 1 GROUP BY ALL) SELECT actor, round(avg(rate), 6) AS mean_rate, count(*) AS n_pairs FROM e GROUP BY actor")(
    lambda s, d: _r(persistence.by_entity_then_actor(transitions(s, d)), "mean_rate")
)
_PAIRS = ["W0→W1", "W1→W2", "W2→W3"]
q("e11_heatmap_waves", f"""WITH {TRANS}, c AS (SELECT term, wave_pair, count(*) AS t0, count(*) FILTER (transition = 'persist') / count(*) AS rate FROM t WHERE present_from = 1 AND wave_pair IN ('W0→W1', 'W1→W2', 'W2→W3') GROUP BY ALL HAVING count(*) >= 3)
SELECT term, round(max(rate) FILTER (wave_pair = 'W0→W1'), 6) AS "W0_W1", round(max(rate) FILTER (wave_pair = 'W1→W2'), 6) AS "W1_W2", round(max(rate) FILTER (wave_pair = 'W2→W3'), 6) AS "W2_W3" FROM c GROUP BY term HAVING sum(t0) >= 10""")(
    lambda s, d: _r(persistence.heatmap(transitions(s, d), _PAIRS), "W0_W1", "W1_W2", "W2_W3")
)
q("e12_heatmap_years", f"""WITH {M}, {L}, x AS (SELECT term, year AS y0, lead(year) OVER w AS y1, n > 0 AS a, lead(n > 0) OVER w AS b FROM l WHERE year IS NOT NULL AND entity IS NOT NULL WINDOW w AS (PARTITION BY entity, term ORDER BY year, file)),
c AS (SELECT term, y0 || '→' || y1 AS year_pair, count(*) AS n, round(count(*) FILTER (b) / count(*), 6) AS rate FROM x WHERE y1 IS NOT NULL AND a GROUP BY ALL)
SELECT * FROM c WHERE term IN (SELECT term FROM c GROUP BY term HAVING count(*) >= 2)""")(lambda s, d: _year_cells(s, d))


def _year_cells(s: SparkSession, d: str) -> DataFrame:
    c = persistence.rates(panel.year_transitions(long(s, d)), "term", "year_pair").select("term", "year_pair", F.col("n_entities_t0").alias("n"), F.round("persistence_rate", 6).alias("rate"))
    keep = c.groupBy("term").agg(F.count(F.lit(1)).alias("k")).filter("k >= 2").select("term")
    return c.join(keep, "term", "left_semi")


q("g2_dropout_ranking", f"WITH {TRANS} SELECT term, count(*) AS n FROM t WHERE transition = 'dropout' GROUP BY term ORDER BY n DESC, term LIMIT 20")(lambda s, d: persistence.ranking(transitions(s, d), "dropout"))
q("g2_adopt_ranking", f"WITH {TRANS} SELECT term, count(*) AS n FROM t WHERE transition = 'adopt' GROUP BY term ORDER BY n DESC, term LIMIT 20")(lambda s, d: persistence.ranking(transitions(s, d), "adopt"))
q("e13_first_appearance", f"WITH {FIRST} SELECT entity, actor, term, first_year, is_left_censored FROM fa")(lambda s, d: diffusion.first_appearance(long(s, d)))
q("e14_adoption_curves", f"""WITH {FIRST}, b AS (SELECT term, first_year, unnest(['all', coalesce(actor, 'unknown')]) AS actor FROM fa), tot AS (SELECT actor, count(*) AS total_entities FROM (SELECT unnest(['all', coalesce(actor, 'unknown')]) AS actor FROM ent) GROUP BY actor),
y AS (SELECT DISTINCT year FROM m WHERE year IS NOT NULL), g AS (SELECT DISTINCT actor, term, year FROM b, y)
SELECT g.term, g.actor, g.year, count(b.first_year) AS cumulative_count, any_value(total_entities) AS total_entities, round(count(b.first_year) / any_value(total_entities), 6) AS cumulative_fraction FROM g JOIN tot ON g.actor = tot.actor LEFT JOIN b ON b.actor = g.actor AND b.term = g.term AND b.first_year <= g.year GROUP BY ALL""".replace("any_value(total_entities) AS total_entities", "max(total_entities) AS total_entities").replace("/ any_value(total_entities)", "/ max(total_entities)"))(
    lambda s, d: _r(diffusion.adoption_curves(long(s, d)), "cumulative_fraction")
)
q("e15_spikes", f"WITH {FIRST}, n AS (SELECT count(*) AS total_entities FROM ent) SELECT term, first_year AS year, count(*) AS new_adopters, max(total_entities) AS total_entities, round(count(*) / max(total_entities), 6) AS adoption_fraction, count(*) / max(total_entities) >= 0.15 AS is_spike FROM fa, n GROUP BY term, first_year")(
    lambda s, d: _r(diffusion.spikes(long(s, d)), "adoption_fraction")
)
q("e16_gini", f"WITH {FIRST}, o AS (SELECT term, first_year, row_number() OVER (PARTITION BY term ORDER BY first_year) AS i FROM fa) SELECT term, round((2 * sum(i * first_year) - (count(*) + 1) * sum(first_year)) / (count(*) * sum(first_year)), 6) AS gini, count(*) AS n_entities, round(avg(first_year), 6) AS mean_year, round(stddev_pop(first_year), 6) AS std_year FROM o GROUP BY term HAVING count(*) >= 2")(
    lambda s, d: _r(diffusion.gini(diffusion.first_appearance(long(s, d))), "gini", "mean_year", "std_year")
)
LL = "ll AS (SELECT term, median(first_year) FILTER (actor = 'kommun') AS median_kommun, count(*) FILTER (actor = 'kommun') AS n_kommun, median(first_year) FILTER (actor = 'länsstyrelse') AS median_lansstyrelse, count(*) FILTER (actor = 'länsstyrelse') AS n_lansstyrelse, median(first_year) FILTER (actor = 'MCF') AS \"median_MCF\", count(*) FILTER (actor = 'MCF') AS \"n_MCF\" FROM fa GROUP BY term)"
q("e17_lead_lag", f"WITH {FIRST}, {LL} SELECT *, median_kommun - median_lansstyrelse AS lag_kommun_vs_lansstyrelse, median_kommun - \"median_MCF\" AS \"lag_kommun_vs_MCF\" FROM ll")(lambda s, d: diffusion.lead_lag(diffusion.first_appearance(long(s, d))))
q("e18_lag_summary", f"WITH {FIRST}, {LL}, x AS (SELECT median_kommun - median_lansstyrelse AS v FROM ll) SELECT round(avg(v), 6) AS mean_lag, count(*) FILTER (v > 0) AS later, count(*) FILTER (v < 0) AS earlier, count(*) FILTER (v = 0) AS same FROM x")(
    lambda s, d: _r(diffusion.lag_summary(diffusion.lead_lag(diffusion.first_appearance(long(s, d))), "lag_kommun_vs_lansstyrelse"), "mean_lag")
)
q("k_first_year_heatmap", f"WITH {FIRST}, c AS (SELECT term, first_year, count(*) AS n FROM fa GROUP BY ALL), keep AS (SELECT term, sum(n) AS s FROM c GROUP BY term HAVING sum(n) >= 3 ORDER BY s DESC, term LIMIT 40) SELECT term, first_year, n FROM c WHERE term IN (SELECT term FROM keep)")(
    lambda s, d: _first_year_cells(s, d)
)


def _first_year_cells(s: SparkSession, d: str) -> DataFrame:
    c = diffusion.first_appearance(long(s, d)).groupBy("term", "first_year").agg(F.count(F.lit(1)).alias("n"))
    keep = c.groupBy("term").agg(F.sum("n").alias("s")).filter("s >= 3").orderBy(F.desc("s"), "term").limit(40).select("term")
    return c.join(F.broadcast(keep), "term", "left_semi")  # forty rows at most


q("b9_min_entities", f"WITH {FIRST}, o AS (SELECT term, first_year, row_number() OVER (PARTITION BY term ORDER BY first_year) AS i FROM fa) SELECT term, round((2 * sum(i * first_year) - (count(*) + 1) * sum(first_year)) / (count(*) * sum(first_year)), 6) AS gini, count(*) AS n_entities FROM o GROUP BY term HAVING count(*) >= 5")(
    lambda s, d: _r(diffusion.gini(diffusion.first_appearance(long(s, d)), least=5).select("term", "gini", "n_entities"), "gini")
)
_DIR = ", ".join(f"d{a}{b} AS (SELECT a.term, 'W{a}→W{b}' AS wave_pair, a.n > 0 AS p, b.n > 0 AS q FROM pl a JOIN pl b ON a.entity = b.entity AND a.term = b.term AND a.wave = {a} AND b.wave = {b})" for a, b in ((1, 2), (2, 3), (1, 3)))
q("e12_direct_heatmap", f"""WITH {M}, {ONE}, {_un("one", "pl")}, {_DIR}, u AS (SELECT * FROM d12 UNION ALL SELECT * FROM d23 UNION ALL SELECT * FROM d13), c AS (SELECT term, wave_pair, count(*) AS t0, count(*) FILTER (q) / count(*) AS rate FROM u WHERE p GROUP BY ALL HAVING count(*) >= 3)
SELECT term, round(max(rate) FILTER (wave_pair = 'W1→W2'), 6) AS "W1_W2", round(max(rate) FILTER (wave_pair = 'W2→W3'), 6) AS "W2_W3", round(max(rate) FILTER (wave_pair = 'W1→W3'), 6) AS "W1_W3" FROM c GROUP BY term HAVING sum(t0) >= 10""")(lambda s, d: _direct_heatmap(s, d))


def _direct_heatmap(s: SparkSession, d: str) -> DataFrame:
    x = terms.melt(panel.latest_per_wave(matrix(s, d)))
    cells = {f"W{a}→W{b}": panel.direct_transitions(x, a, b) for a, b in ((1, 2), (2, 3), (1, 3))}
    return _r(persistence.direct_heatmap(cells), "W1_W2", "W2_W3", "W1_W3")


q("g2_dropout_by_actor", f"WITH {TRANS}, top AS (SELECT term FROM t WHERE transition = 'dropout' GROUP BY term ORDER BY count(*) DESC, term LIMIT 20) SELECT term, actor, count(*) AS n FROM t WHERE transition = 'dropout' AND term IN (SELECT term FROM top) GROUP BY ALL")(lambda s, d: persistence.ranking_by_actor(transitions(s, d), "dropout"))
q("e24_crosstab_rows", f"WITH {M} SELECT coalesce(actor, 'none') AS actor, coalesce(CAST(wave AS VARCHAR), 'none') AS wave, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY coalesce(actor, 'none')), 6) AS share FROM m GROUP BY 1, 2")(lambda s, d: _row_shares(s, d))


def _row_shares(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    g = matrix(s, d).groupBy(F.coalesce("actor", F.lit("none")).alias("actor"), F.coalesce(F.col("wave").cast("string"), F.lit("none")).alias("wave")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("actor", "wave", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy("actor")), 6).alias("share"))


q("b7_wave_filter", f"WITH {M} SELECT file FROM m WHERE wave = 2")(lambda s, d: matrix(s, d).filter("wave = 2").select("file"))
q("b11_zero_rows", f"WITH {M}, {L} SELECT file, CAST(sum(n) AS BIGINT) AS total FROM l GROUP BY file HAVING sum(n) = 0")(lambda s, d: long(s, d).groupBy("file").agg(F.sum("n").alias("total")).filter("total = 0"))
q("e4_entities_per_actor", f"WITH {M} SELECT actor, count(DISTINCT entity) AS n_entities FROM m GROUP BY actor")(lambda s, d: matrix(s, d).groupBy("actor").agg(F.countDistinct("entity").alias("n_entities")))
q("e5_year_range_by_wave", f"WITH {M} SELECT wave, min(year) AS lo, max(year) AS hi, count(year) AS n FROM m GROUP BY wave")(lambda s, d: matrix(s, d).groupBy("wave").agg(F.min("year").alias("lo"), F.max("year").alias("hi"), F.count("year").alias("n")))
q("e3_value_counts", f"WITH {M} SELECT wave, count(*) AS n FROM m GROUP BY wave ORDER BY n DESC, wave")(lambda s, d: matrix(s, d).groupBy("wave").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "wave"))
q("e23_documents_by_year_actor", f"WITH {M} SELECT year, count(*) FILTER (actor = 'kommun') AS kommun, count(*) FILTER (actor = 'länsstyrelse') AS lansstyrelse, count(*) FILTER (actor = 'MCF') AS \"MCF\" FROM m GROUP BY year")(
    lambda s, d: matrix(s, d).groupBy("year").agg(*(F.count(F.when(F.col("actor") == a, 1)).alias(n) for a, n in (("kommun", "kommun"), ("länsstyrelse", "lansstyrelse"), ("MCF", "MCF"))))
)
q("e24_crosstab_margins", f"WITH {M} SELECT coalesce(actor, CASE WHEN grouping(actor) = 1 THEN 'All' ELSE 'none' END) AS actor, coalesce(CAST(wave AS VARCHAR), CASE WHEN grouping(wave) = 1 THEN 'All' ELSE 'none' END) AS wave, count(*) AS n FROM m GROUP BY CUBE (actor, wave)")(
    lambda s, d: matrix(s, d).cube("actor", "wave").agg(F.count(F.lit(1)).alias("n"), F.grouping("actor").alias("ga"), F.grouping("wave").alias("gw"))
    .select(F.when(F.col("ga") == 1, "All").otherwise(F.coalesce("actor", F.lit("none"))).alias("actor"), F.when(F.col("gw") == 1, "All").otherwise(F.coalesce(F.col("wave").cast("string"), F.lit("none"))).alias("wave"), "n")
)
q("j8_row_proportions", f"WITH {M}, {ONE}, {_un('one', 'pl')}, s AS (SELECT *, sum(n) OVER (PARTITION BY file) AS t FROM pl WHERE wave = 3) SELECT file, term, round(n / t, 6) AS share FROM s WHERE t > 0")(
    lambda s, d: _proportions(s, d)
)


def _proportions(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    x = terms.melt(panel.latest_per_wave(matrix(s, d)).filter("wave = 3")).withColumn("t", F.sum("n").over(W.partitionBy("file")))
    return x.filter("t > 0").select("file", "term", F.round(F.col("n") / F.col("t"), 6).alias("share"))
