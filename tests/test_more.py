"""Sentences and categories, hooks, dense matrices, clusters against brute force, stored tables."""

import io
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textverk.operators import cluster, corpus, hooks, qualify, segment, stats, terms, vectors
from textverk.session import scope, small, stored

# --- words, lemmas and categories


def test_words_and_content(spark, tmp_path):
    df = spark.createDataFrame([(1, "Stormar, och BRÄNDER!! é"), (2, None), (3, ""), (4, "…"), (5, "och i")], "id int, text string").withColumn("i", F.lit(9))
    lem = spark.createDataFrame([("stormar", "storm"), ("Bränder", "brand"), ("bränder", "brand")], "surface string, lemma string")
    t = segment.lemmatised(segment.tokens(df, "text", "id"), lem)
    assert [(r.i, r.surface, r.lemma) for r in t.filter("id = 1").orderBy("i").collect()] == [(1, "Stormar", "storm"), (2, ",", ","), (3, "och", "och"), (4, "BRÄNDER", "brand"), (5, "!!", "!!"), (6, "é", "é")]
    assert {r.lemma for r in segment.content(t).collect()} == {"storm", "brand", "é"}
    assert {r.id: (r.lemmas, r.word_count) for r in segment.lemma_sentences(t, "id").collect()} == {1: ("storm brand é", 3)}
    # a lemma that is a stopword goes, whatever the form
    assert segment.content(t, ["storm"]).filter("lemma = 'storm'").count() == 0
    at = tmp_path / "stop.txt"
    at.write_text("Storm\n\n kust \n", encoding="utf-8")
    assert segment.stopwords(["X"], str(at))[-3:] == ["x", "storm", "kust"]
    with pytest.raises(FileNotFoundError):
        segment.stopwords(path=str(tmp_path / "none.txt"))


def test_categories_of_sentences(spark):
    lex = spark.createDataFrame([("natur", "skogsbrand"), ("brand", "skogsbrand"), ("natur", "storm"), ("brand", "brand")], "category string, term string")
    df = spark.createDataFrame([("a", 1, "storm storm brand"), ("a", 2, "ingenting"), ("b", 1, "Skogsbrand vid storm"), ("b", 1, "Skogsbrand vid storm"), ("c", 1, None)], "doc string, sid int, text string")
    t = segment.lemmatised(segment.tokens(df, "text", "doc", "sid"), spark.createDataFrame([], "surface string, lemma string"))
    got = {(r.doc, r.sid): (r.target_terms, r.categories) for r in segment.sentence_terms(t, lex, "doc", "sid").collect()}
    assert got == {("a", 1): (["storm", "storm", "brand"], ["brand", "natur"]), ("b", 1): (["skogsbrand", "storm"], ["brand", "natur"])}
    pairs = segment.category_pairs(segment.sentence_terms(t, lex, "doc", "sid"))
    assert pairs.count() == 4
    assert {(r.doc, r.all_categories, r.n_categories) for r in segment.unique_sentences(pairs, "doc", "sid").collect()} == {("a", "brand,natur", 2), ("b", "brand,natur", 2)}
    assert segment.sentence_terms(t.limit(0), lex, "doc", "sid").count() == 0


def test_wide_and_long_category_sums_agree(spark):
    wide = spark.createDataFrame([("f1", "a", "e", 2020, 2, 1, 2, None), ("f2", None, "e", 2021, 2, 0, 5, 7)], "file string, actor string, entity string, year int, wave int, storm long, brand long, skogsbrand long")
    lex = [("natur", "storm"), ("natur", "skogsbrand"), ("brand", "brand"), ("brand", "skogsbrand"), ("x", "saknas"), ("x", "wave")]
    long = terms.category_sums(terms.melt(wide), spark.createDataFrame([(c, t) for c, t in lex if t != "wave"], "category string, term string"))
    key = lambda r: (r.file, r.category)
    assert {key(r): r.n or 0 for r in long.collect()} == {key(r): r.n for r in terms.wide_category_sums(wide, lex).collect()}


def test_levels_by_actor(spark):
    docs = spark.createDataFrame([(1, "kommun", "Det finns hög risk för brand. Sannolikheten är mycket låg här."), (2, "kommun", None), (3, None, "En risk som ökar i år för alla."), (4, "MCF", "ingenting")], "id int, actor string, text string")
    x = qualify.levels_of(docs, "id", "text", "actor")
    got = {(r.id, r.concept, r.level): r.n for r in x.collect()}
    assert got[1, "risk", "high"] == 1 and got[1, "sannolikhet", "high"] == 1 and got[3, "risk", "change"] == 1  # what stands before a word comes first
    assert {(r.actor, r.concept, r.level): r.n for r in qualify.level_totals(x).collect()}["all", "risk", "high"] == 1
    assert {(r.actor, r.concept): r.share for r in qualify.severity_shares(x).collect()} == {("kommun", "risk"): 100.0, ("kommun", "sannolikhet"): 100.0}
    assert [(r.actor, r.docs, r.rate) for r in qualify.other_rates(x, docs).collect()] == [(None, 1, 1.0)]


# --- hooks


def _udf(f, kind):
    return F.pandas_udf(lambda s: s.map(f, na_action="ignore"), kind)


def test_extractors_in_turn(spark):
    seen = spark.sparkContext.accumulator(0)

    def second(b):
        seen.add(1)
        return b.decode() * 3

    rows = [(1, bytearray(b"x" * 600)), (2, bytearray(b"y" * 200)), (3, bytearray(b"z")), (4, None), (5, bytearray())]
    df = spark.createDataFrame(rows, "id int, content binary")
    got = {r.id: (r.method, len(r.text or "")) for r in hooks.extract(df, "content", [("first", _udf(lambda b: b.decode(), "string")), ("second", _udf(second, "string"))]).collect()}
    assert got == {1: ("first", 600), 2: ("second", 600), 3: ("all_failed", 0), 4: ("all_failed", 0), 5: ("all_failed", 0)}
    assert hooks.extract(df.limit(0), "content", [("first", _udf(lambda b: b.decode(), "string"))]).count() == 0


def test_pages_in_order(spark):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for n in (10, 2, 1):
            z.writestr(f"sida{n}.JPG", f"text {n}")
        z.writestr("läs.txt", "nej")
    df = spark.createDataFrame([("a", bytearray(buf.getvalue())), ("b", bytearray(b"not a zip")), ("c", None)], "file string, content binary")
    pages = df.select("file", F.explode(hooks.zip_pages("content")).alias("p")).select("file", "p.name", "p.content")
    ocr = _udf(lambda b: b.decode(), "string")
    assert [tuple(r) for r in hooks.recognise(pages, "file", ocr).collect()] == [("a", "text 1\n\ntext 2\n\ntext 10")]
    assert hooks.recognise(pages, "file", ocr, marks=True).first().text.startswith("--- Page 1 ---\ntext 1\n\n--- Page 2 ---")
    assert hooks.black_and_white(np.array([[149, 150]])).tolist() == [[0, 255]]


def test_embedding_and_lemma_hooks(spark):
    df = spark.createDataFrame([(1, "Ett hus"), (2, "Ett hus"), (3, None)], "id int, text string")
    model = F.pandas_udf(lambda s: s.map(lambda t: [float(len(t))]), T.ArrayType(T.DoubleType()))
    assert {r.id: r.vector for r in hooks.embed(df, "text", model).collect()} == {1: [7.0], 2: [7.0], 3: None}
    words = spark.createDataFrame([("Husen",), ("husen",), (None,)], "w string")
    assert [tuple(r) for r in hooks.lemma_table(words, "w", _udf(lambda w: w[:-2], "string")).collect()] == [("husen", "hus")]
    split = F.pandas_udf(lambda s: s.map(lambda t: t.split(" "), na_action="ignore"), T.ArrayType(T.StringType()))
    assert [tuple(r) for r in hooks.segment(df, "id", "text", split).filter("id = 1").collect()] == [(1, 1, "Ett"), (1, 2, "hus")]


# --- files


def test_text_of_any_kind_survives_files(spark, tmp_path):
    rows = [(1, 'a\r\nb "c", d\\'), (2, None), (3, ""), (4, "  \t "), (5, "\\N is not null; åäö\n\n"), (6, "\r")]
    df = spark.createDataFrame(rows, "id int, text string")
    for kind in ("csv", "json", "parquet"):
        corpus.save(df, f"{tmp_path}/x.{kind}")
        assert sorted(tuple(r) for r in corpus.load(spark, f"{tmp_path}/x.{kind}", ("text",), "id int, text string").collect()) == rows, kind
    (tmp_path / "in").mkdir()
    for n in ("a.pdf", "b.PDF", "c.txt"):
        (tmp_path / "in" / n).write_bytes(b"%PDF-1")
    got = corpus.find_files(spark, str(tmp_path / "in")).select("name", corpus.file_type(F.col("content")).alias("k")).collect()
    assert sorted(map(tuple, got)) == [("a.pdf", "pdf"), ("b.PDF", "pdf")]


def test_dense_matrices(spark, tmp_path):
    m = np.arange(60, dtype=np.float64).reshape(20, 3)
    np.save(tmp_path / "m.npy", m)
    got = {r.row: r.vector for r in vectors.load_npy(spark, f"file://{tmp_path}/m.npy").collect()}
    assert got == {i: m[i].tolist() for i in range(20)}
    df = spark.createDataFrame([(f"k{i}", m[i].tolist()) for i in range(20)] + [("null", None)], "key string, vector array<float>").repartition(3)
    index = stored(vectors.save_npy(df, "key", "vector", f"file://{tmp_path}/out"), "index")
    back = {}
    for p in {r.part for r in index.collect()}:
        x = np.load(tmp_path / "out" / p)
        back |= {r.key: x[r.row].tolist() for r in index.filter(F.col("part") == p).collect()}
    assert back == {f"k{i}": m[i].tolist() for i in range(20)}
    np.save(tmp_path / "one.npy", np.arange(3.0))
    with pytest.raises(ValueError):
        vectors.load_npy(spark, f"file://{tmp_path}/one.npy")


# --- vectors and clusters


def test_neighbours_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 4)).round(1)
    x[10] = x[11]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, [0.0] * 4), (201, None)]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    seeds = df.filter("id % 20 = 0").select(F.col("id").alias("seed"), F.col("v").alias("seed_vector"))
    f = x.astype(np.float32).astype(float)
    u = f / np.sqrt((f * f).sum(axis=1))[:, None]
    want = {}
    for s in range(0, 90, 20):
        sim = np.round(u @ u[s], 12)
        want[s] = [i for i in sorted(range(90), key=lambda i: (-sim[i], i)) if i != s][:7]
    for size in (4096, 8):
        monkeypatch.setattr(vectors, "ROWS", size)
        got = {}
        for r in vectors.neighbours(df, seeds, "id", "v", 7).orderBy("seed", "rank").collect():
            got.setdefault(r.seed, []).append(r.id)
        assert got == want
    assert vectors.neighbours(df.limit(0), seeds, "id", "v").count() == 0


def _old_ward(x, k):
    label, size, centre, live = np.arange(len(x)), np.ones(len(x)), x.copy(), list(range(len(x)))
    while len(live) > k:
        best = min((size[a] * size[b] / (size[a] + size[b]) * ((centre[a] - centre[b]) ** 2).sum(), a, b) for i, a in enumerate(live) for b in live[i + 1 :])
        _, a, b = best
        centre[a] = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        label[label == b] = a
        live.remove(b)
    return label


def test_ward(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(c, 1.0, (14, 2)) for c in (0, 6, 15)])
    rows = [("g", f"e{i:02d}", *v) for i, v in enumerate(x.tolist())] + [("g", "same", *x[0].tolist()), (None, "n", 1.0, 2.0), ("h", "one", 3.0, None)]
    df = spark.createDataFrame(rows, "wave string, entity string, a double, b double")
    same = lambda p: {frozenset(i for i, q in enumerate(p) if q == c) for c in set(p)}
    got = {r.entity: r.cluster for r in cluster.ward(df, "wave", "entity", ["a", "b"], 4).collect()}
    assert set(got) == {r[1] for r in rows} and got["same"] == got["e00"] and got["one"] == 0
    assert same([got[f"e{i:02d}"] for i in range(42)]) == same(_old_ward(np.vstack([x, x[0]]), 4)[:42].tolist())
    link = cluster.linkage(df, "wave", ["a", "b"]).filter("wave = 'g'").orderBy("step").collect()
    assert len(link) == 41 and link[-1]["size"] == 43 and [r.height for r in link] == sorted(r.height for r in link)
    # brought down in blocks, clearly separate groups stay what they are, of null too
    y = np.vstack([rng.normal(c, 1.0, (150, 2)) for c in (0, 30, 90)])
    big = spark.createDataFrame([(w, i, *v) for w in ("g", None) for i, v in enumerate(y.tolist())], "wave string, entity int, a double, b double")
    got = {(r.wave, r.entity): r.cluster for r in cluster.ward(big, "wave", "entity", ["a", "b"], 3, 128).collect()}
    for w in ("g", None):
        assert same([got[w, i] for i in range(450)]) == {frozenset(range(k, k + 150)) for k in (0, 150, 300)}
    assert cluster.ward(df.limit(0), "wave", "entity", ["a", "b"], 3).count() == 0


def _dbscan(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    label = np.where(core, np.arange(len(x)), -1)
    for _ in range(len(x)):
        for i in np.flatnonzero(core):
            label[i] = label[near[i] & core].min()
    return [int(label[i]) if core[i] else int(min(label[near[i] & core], default=-1)) for i in range(len(x))]


def test_density_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 0.3, (60, 4)), rng.normal(2, 0.3, (50, 4)), rng.uniform(-3, 5, (30, 4))]).round(2)
    x[5:9] = x[4]  # equal points
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(x.tolist())], "id int, a double, b double, c double, d double")
    for block, axes in ((1024, 3), (16, 1), (16, 4)):
        monkeypatch.setattr(cluster, "BLOCK", block)
        got = {r.id: int(r.cluster) for r in cluster.neighbourhoods(df, "id", ["a", "b", "c", "d"], 0.6, 6, axes).collect()}
        assert [got[i] for i in range(140)] == _dbscan(x, 0.6, 6)
    assert cluster.neighbourhoods(df.limit(0), "id", ["a", "b", "c", "d"], 0.6, 6).count() == 0


def test_cluster_indices(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)) + np.repeat([0, 3, 7], 20)[:, None]
    label = np.repeat([0, 1, 2], 20)
    df = spark.createDataFrame([("w", int(c), v) for c, v in zip(label, x.tolist(), strict=True)] + [("one", 0, [1.0, 2.0, 3.0]), ("one", 0, [1.0, 2.0, 4.0]), ("w", 1, None)], "wave string, c int, v array<double>")
    got = {r.wave: r for r in cluster.indices(df, "v", "c", "wave").collect()}
    ch, db = cluster._indices(x, label)
    assert got["w"].calinski_harabasz == pytest.approx(ch) and got["w"].davies_bouldin == pytest.approx(db) and got["w"].n == 60
    assert got["one"].calinski_harabasz is None and got["one"].davies_bouldin is None
    mid = x.reshape(3, 20, 3).mean(axis=1)
    between = 20 * ((mid - x.mean(axis=0)) ** 2).sum()
    within = ((x.reshape(3, 20, 3) - mid[:, None]) ** 2).sum()
    assert ch == pytest.approx(between / 2 / (within / 57))


def test_small_groups_are_skipped(spark):
    df = spark.createDataFrame([(1, float(i), 0.0) for i in range(12)] + [(2, float(i), 1.0) for i in range(4)], "wave int, x double, y double")
    rows = cluster.sweep_groups(df, "wave", ["x", "y"], range(2, 5), range(42, 44), least=5).collect()
    assert {r.wave for r in rows} == {1} and sum(r.best for r in rows) == 1
    assert max(rows, key=lambda r: (r.silhouette, -r.k)).best


def test_cluster_summary(spark):
    rows = [(0, "b", 2019, "X"), (0, "a", 2020, "Y"), (0, "a", 2020, "X"), (0, None, None, None), (1, "b", 2019, "Z"), (-1, "a", 2019, "X")]
    got = {r.cluster: r for r in stats.cluster_summary(spark.createDataFrame(rows, "k int, c string, y int, p string"), "k", "c", "y", "p").collect()}
    assert set(got) == {0, 1} and got[0].size_pct == pytest.approx(400 / 6)
    assert (got[0].dominant, got[0].years, got[0].trend, got[0].top_places) == ("a", "2019:1,2020:2", "Increasing", "X,Y") and got[1].trend == "Decreasing"


# --- stored tables


def test_tables_of_a_scope_are_removed(spark):
    df = spark.range(5)
    with scope(spark):
        at = stored(df, "scoped").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(at)
    assert not os.path.exists(at)
    assert os.path.exists(stored(df, "kept").inputFiles()[0].removeprefix("file://"))


def test_only_small_tables_are_broadcast(spark):
    df = spark.range(50).withColumn("x", F.lit(1))
    plan = lambda most: spark.range(9).join(small(df, most), "id")._jdf.queryExecution().logical().toString()
    assert "UnresolvedHint broadcast" in plan(50) or "broadcast" in plan(50).lower()
    assert "broadcast" not in plan(49).lower()
