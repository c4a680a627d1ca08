import math
import random

import pytest
from pyspark.sql import functions as F

from textverk.operators import cluster, corpus, diffusion, panel, persistence, qualify, stats, terms, vectors

SCHEMA = "file string, actor string, entity string, year int, wave int, storm long, brand long"
DOCS = [
    ("a15", "kommun", "A", 2015, 1, 1, 0), ("a16", "kommun", "A", 2016, 1, 0, 2), ("a20", "kommun", "A", 2020, 2, 3, 0), ("a23", "kommun", "A", 2023, 3, 0, 0),
    ("b15", "MCF", "B", 2015, 1, 0, 1), ("b16", "MCF", "B", 2015, 1, 1, 1), ("b24", "MCF", "B", 2024, 3, 1, 1), ("c15", "kommun", "C", 2015, 1, 1, 1), ("d", None, None, None, None, 5, 5), ("e", "kommun", "E", None, None, 1, 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_latest_and_ties(docs):
    assert rows(panel.latest_per_wave(docs), "entity", "wave", "file") == [("A", 1, "a16"), ("A", 2, "a20"), ("A", 3, "a23"), ("B", 1, "b16"), ("B", 3, "b24"), ("C", 1, "c15")]
    assert ("B", 1, "b15") in rows(panel.latest_per_wave(docs, last=False), "entity", "wave", "file")


def test_panel_and_transitions(docs):
    p = panel.build_panel(docs)
    assert rows(p.select("entity").distinct(), "entity") == [("A",), ("B",)]
    t = panel.wave_transitions(terms.melt(p))
    assert rows(t, "entity", "term", "wave_pair", "transition") == sorted(
        [("A", "storm", "W1→W2", "adopt"), ("A", "storm", "W2→W3", "dropout"), ("A", "brand", "W1→W2", "dropout"), ("A", "brand", "W2→W3", "stable_absent"), ("B", "storm", "W1→W3", "persist"), ("B", "brand", "W1→W3", "persist")]
    )
    assert t.count() == 3 * 2  # pairs x terms
    j = {(r.entity, r.wave_pair): r.jaccard for r in panel.jaccard(t).collect()}
    assert j == {("A", "W1→W2"): 0.0, ("A", "W2→W3"): 0.0, ("B", "W1→W3"): 1.0}


def test_year_and_direct_transitions(docs):
    y = panel.year_transitions(terms.melt(docs))
    assert ("B", "2015→2015", "storm", "adopt") in rows(y, "entity", "year_pair", "term", "transition")
    assert rows(panel.direct_transitions(terms.melt(panel.latest_per_wave(docs)), 1, 3).select("entity").distinct(), "entity") == [("A",), ("B",)]


def test_persistence(docs):
    t = panel.wave_transitions(terms.melt(panel.build_panel(docs)))
    got = {r.term: (r.n_entities_t0, r.n_entities_persist, r.persistence_rate, r.flag_low_n) for r in persistence.rates(t, "term").collect()}
    assert got == {"storm": (2, 1, 0.5, True), "brand": (2, 1, 0.5, True)}
    assert {r.actor: r.n for r in persistence.overall(t).collect()} == {"all": 6, "kommun": 4, "MCF": 2}


def test_diffusion(docs):
    long = terms.melt(docs)
    fa = diffusion.first_appearance(long)
    assert ("A", "brand", 2016, False) in rows(fa, "entity", "term", "first_year", "is_left_censored")
    curves = diffusion.adoption_curves(long).collect()
    by = {}
    for r in curves:
        by.setdefault((r.term, r.actor), []).append((r.year, r.cumulative_fraction))
    for v in by.values():
        s = [f for _, f in sorted(v)]
        assert s == sorted(s) and 0 <= s[0] and s[-1] <= 1
    g = diffusion.gini(fa).collect()
    assert all(0 <= r.gini < 0.01 for r in g)


def test_gini_of_equal_values_is_zero(spark):
    df = spark.createDataFrame([("t", 5), ("t", 5), ("t", 5), ("one", 3)], "term string, first_year int")
    assert [(r.term, r.gini) for r in diffusion.gini(df).collect()] == [("t", 0.0)]


def test_wave_is_no_term(docs):
    assert rows(terms.melt(docs).select("term").distinct(), "term") == [("brand",), ("storm",)]


def test_categories_count_twice(spark, docs):
    lex = spark.createDataFrame([("x", "storm", 0), ("y", "storm", 1), ("y", "brand", 2)], "category string, term string, ord int")
    tot = {(r.actor, r.category): r.n for r in terms.totals(terms.category_sums(terms.melt(docs), lex)).collect()}
    assert tot["all", "x"] == 13 and tot["all", "y"] == 24 and tot["unknown", "x"] == 5
    assert rows(terms.repeated_terms(lex), "term", "categories") == [("storm", "x,y")]


def test_empty_matrix(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert panel.build_panel(e).count() == 0 and panel.wave_transitions(terms.melt(e)).count() == 0
    assert diffusion.adoption_curves(terms.melt(e)).count() == 0 and terms.sparsity(terms.melt(e)).collect()[0].sparsity is None


GOLD = {
    "antagonistiska_hot": (8011, 1196, 328), "biologiska_hot": (9943, 3845, 372), "brand": (6332, 1381, 168), "cyber_hot": (893, 226, 97), "ekonomi": (149, 36, 8),
    "miljö_klimat": (2277, 1255, 144), "naturhot": (21022, 8062, 728), "olyckor": (5103, 2164, 91), "sociala_risker": (1915, 472, 162), "teknisk_infrastruktur": (10034, 2656, 324),
}


def test_chi_square_golden(spark):
    data = [(a, c, v[i]) for c, v in GOLD.items() for i, a in enumerate(("kommun", "länsstyrelse", "MCF"))]
    df = stats.independence(spark.createDataFrame(data, "g string, c string, n long"), "g", "c")
    got = {(r.a, r.b): r for r in df.collect()}
    assert got["MCF", "kommun"].chi2 == pytest.approx(341.97494058169923, rel=1e-12)
    assert got["MCF", "länsstyrelse"].chi2 == pytest.approx(657.2172741912815, rel=1e-12)
    assert got["kommun", "länsstyrelse"].chi2 == pytest.approx(1561.8559775298856, rel=1e-12)
    assert got["MCF", "kommun"].dof == 9 and got["MCF", "kommun"].p == pytest.approx(3.1604167875921594e-68, rel=1e-8)


def test_yates_and_degenerate(spark):
    f = spark.createDataFrame([(True, True, True)] * 10 + [(True, False, True)] * 5 + [(False, True, True)] * 6 + [(False, False, True)] * 9, "a boolean, b boolean, c boolean")
    got = stats.cooccurrence(f, ["a", "b", "c"]).collect()
    assert len(got) == 1  # c is always true
    r = got[0]
    e = 15 * 16 / 30
    o = [[10, 5], [6, 9]]
    chi = sum((abs(o[i][j] - [[e, 15 - e], [16 - e, 14 - (15 - e)]][i][j]) - 0.5) ** 2 / [[e, 15 - e], [16 - e, 14 - (15 - e)]][i][j] for i in range(2) for j in range(2))
    assert r.chi2 == pytest.approx(chi) and r.n_neither == 9


def brute_contexts(text, targets):
    import re

    p = re.compile(r"(?:(\S+)\s+){0,4}\b(" + "|".join(targets) + r")\b(?:\s+(\S+)){0,9}", re.IGNORECASE)
    out = []
    for m in p.finditer(text):
        whole, t = m.group(0), m.group(2)
        at = whole.lower().index(t.lower())
        left, right = whole[:at].split(), whole[at + len(t) :].split()
        out.append((" ".join(left[-4:]), " ".join(right[:5]), " ".join(right[5:9])))
    return out


def test_contexts_equal_python(spark):
    rng = random.Random(3)
    words = ["risk", "risken", "hög", "mycket", "stor", "storm", "låg", "en", "två", "är", "asterisk", "svår", "att", "bedöma", "för"]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)] + ["", None, "risk"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in qualify.contexts(df, "id", "text", "risk").orderBy("id", "k").collect():
        got.setdefault(r.id, []).append((r.before, r.middle, r.after))
    for i, t in enumerate(texts):
        assert got.get(i, []) == brute_contexts(t or "", ["risk", "risken", "risker", "riskens"]), t


def test_levels(spark):
    cases = [("", "är mycket hög nu", "", "very_high"), ("storm", "", "", "high"), ("låg", "mycket stora", "", "low"), ("svårt att", "bedöma", "", "uncertainty"), ("en", "två", "tre", "UNKNOWN"), ("", "minskar", "stor", "change")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, before string, middle string, after string, want string")
    assert all(r.level == r.want for r in qualify.qualify(df, "risk").collect())


def test_corpus(spark, tmp_path):
    df = spark.createDataFrame([("a", 'rad "ett"\nrad två, å', "kommun"), ("b", "x", None)], "file string, text string, actor string")
    for kind in ("parquet", "csv", "json"):
        at = f"file://{tmp_path}/t.{kind}"
        corpus.save(df, at)
        assert rows(corpus.load(spark, at), "file", "text") == rows(df, "file", "text")
    with pytest.raises(ValueError):
        corpus.load(spark, "x.rds")
    with pytest.raises(ValueError):
        corpus.load(spark, f"file://{tmp_path}/t.parquet", ("file", "year"))
    assert rows(corpus.append(df.drop("actor"), df.filter("actor IS NOT NULL")), "file", "actor") == [("a", "kommun"), ("a", "unknown"), ("b", "unknown")]
    p = spark.createDataFrame([("d", 2, "bb"), ("d", 1, "aa"), ("e", 1, None)], "doc string, n int, s string")
    got = {r.id: (r.preview_text, r.is_truncated, r.total_chars) for r in corpus.preview(p, "doc", "n", "s", 4).collect()}
    assert got == {"d": ("aa b", True, 5), "e": ("", False, 0)}
    assert corpus.sample(df, 1, "file").collect() == corpus.sample(df.repartition(3), 1, "file").collect()


def test_cascade(spark):
    df = spark.createDataFrame([("x" * 500, None), ("x" * 499, "y" * 600), (None, "z")], "a string, b string")
    got = [r.c.method for r in df.select(corpus.cascade([("one", F.col("a")), ("two", F.col("b"))]).alias("c")).collect()]
    assert got == ["one", "two", "all_failed"]


def test_vectors(spark):
    df = spark.createDataFrame([(1, "a", 0, [1.0, 0.0]), (2, "a", 1, [0.0, 1.0]), (3, "b", 0, [1.0, 1.0]), (4, "b", 1, None)], "id int, g string, step int, v array<double>")
    c = {r.g: r.centroid for r in vectors.centroids(df, "g", "v").collect()}
    assert c == {"a": [0.5, 0.5], "b": [1.0, 1.0]}
    seeds = df.filter("id = 3").select(F.col("id").alias("seed"), F.col("v").alias("seed_vector"))
    n = vectors.neighbours(df.filter("v IS NOT NULL"), seeds, "id", "v", 1).collect()
    assert [(r.id, round(r.similarity, 6)) for r in n] == [(1, round(1 / math.sqrt(2), 6))]
    assert [round(r.similarity, 6) for r in vectors.drift(df.filter("g = 'a'"), "g", "step", "v").collect()] == [0.0]
    words = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0]), ("z", [0.0, 0.0])], "word string, vector array<double>")
    t = spark.createDataFrame([(1, "x"), (1, "y"), (1, "z"), (1, "q"), (2, "q")], "s int, word string")
    got = {r.s: (r.vector, r.words_found, r.coverage) for r in vectors.sentence_vectors(t, words, "s").collect()}
    assert got == {1: ([0.5, 0.5], 2, 0.5), 2: (None, 0, 0.0)}


def test_clusters_of_separable_data(spark):
    rng = random.Random(1)
    pts = [(f"e{i}", "k", 1, c * 10 + rng.random(), c * 10 + rng.random()) for i, c in enumerate([0] * 12 + [1] * 8 + [2] * 5)]
    df = spark.createDataFrame(pts, "entity string, actor string, wave int, x double, y double")
    truth = {f"e{i}": c for i, c in enumerate([0] * 12 + [1] * 8 + [2] * 5)}
    for got in (cluster.fit(df, ["x", "y"], 3), cluster.ward(df, "wave", "entity", ["x", "y"], 3)):
        assert {r.entity: r.cluster for r in got.collect()} == truth
    dens = cluster.neighbourhoods(df.select("entity", "x", "y").unionByName(spark.createDataFrame([("far", 500.0, 500.0)], "entity string, x double, y double")), "entity", ["x", "y"], 1.5, 3)
    by = {r.entity: r.cluster for r in dens.collect()}
    assert by["far"] == "-1" and len({by[f"e{i}"] for i in range(12)}) == 1 and by["e0"] != by["e15"]
    best = max(cluster.sweep(df, ["x", "y"], range(2, 6), seeds=(42,)), key=lambda r: r["silhouette"])
    assert best["k"] == 3
    s = stats.silhouette(cluster.fit(df, ["x", "y"], 3).select("cluster", F.array("x", "y").alias("v")), "v", "cluster").collect()[0]
    assert s.silhouette > 0.9 and s.n == 25
    assert cluster.project(df, ["x", "y"], 1).agg(F.avg("pc1")).collect()[0][0] == pytest.approx(0, abs=1e-9)


def test_queries_and_sql_agree_on_names():
    from textverk.plans import catalog

    assert set(catalog.oracle_sql()) <= set(catalog.queries())
