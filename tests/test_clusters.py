import math
import random

import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from textverk.operators import cluster, stats
from textverk.plans import other_queries


@pytest.fixture
def folder(spark, tmp_path):
    """A matrix whose terms are not those of the test tables, some only in the last column."""
    rows = [(f"f{i}-{w}", "kommun", f"e{i}", 2012 + 4 * w, w, 4 * (i % 3 == 0) + 1, (i % 3 == 1) * 6, (i + w) % 2) for i in range(12) for w in range(4)]
    rows += [(f"g{w}", "MCF", "only", 2012 + 4 * w, w, 0, 0, 5) for w in range(4)] + [("h", "MCF", "none", 2012, 0, 0, 0, 0)]
    spark.createDataFrame(rows, "file string, actor string, entity string, year int, wave int, storm long, explosion long, epidemi long").write.parquet(f"{tmp_path}/term_document_matrix.parquet")
    return str(tmp_path)


def test_profiles_take_every_term_of_the_matrix(spark, folder):
    p = other_queries.profiles(spark, folder)
    assert p.columns == ["entity", "actor", "year", "wave", "storm", "explosion", "epidemi"]
    got = {(r.entity, r.wave): (r.storm, r.explosion, r.epidemi) for r in p.collect()}
    assert len(got) == 52 and got["only", 2] == (0, 0, 1) and got["e1", 0] == (1 / 8, 6 / 8, 1 / 8)
    for name in ("j11_ward", "j14_pca"):
        assert other_queries.Q[name](spark, folder).count() == 52
    assert {r.term for r in other_queries.Q["j12_characterise"](spark, folder).collect()} == {"storm", "explosion", "epidemi"}


def test_silhouette_of_every_wave(spark, folder, monkeypatch):
    monkeypatch.setattr(stats, "BLOCK", 5)  # several blocks in each wave
    got = {r.wave: r for r in other_queries.Q["j10_silhouette"](spark, folder).collect()}
    assert {w: r.n for w, r in got.items()} == {0: 13, 1: 13, 2: 13, 3: 13}
    rng = random.Random(5)
    pts = [(w, c, [c * 2 + rng.random() for _ in range(3)]) for w in (1, 2) for c in (0, 0, 0, 1, 1, 1, 1, 2)]
    got = {r.wave: r.silhouette for r in stats.silhouette(spark.createDataFrame(pts, "wave int, c int, v array<double>"), "v", "c", "wave").collect()}
    for w in (1, 2):
        mine, s = [p for p in pts if p[0] == w], []
        for i, (_, c, v) in enumerate(mine):
            m = {d: [math.dist(v, x) for j, (_, e, x) in enumerate(mine) if j != i and e == d] for d in (0, 1, 2)}
            a, b = sum(m[c]) / max(1, len(m[c])), min(sum(x) / len(x) for d, x in m.items() if d != c and x)
            s.append((b - a) / max(a, b) if m[c] else 0.0)
        assert got[w] == pytest.approx(sum(s) / len(s), rel=1e-9)


def test_sweep_has_every_k_of_every_wave(spark, folder):
    got = {(r.wave, r.k): r for r in other_queries.Q["j9_k_sweep"](spark, folder).collect()}
    assert set(got) == {(w, k) for w in range(4) for k in range(2, 11)}
    rng = random.Random(6)
    pts = [(1, c * 10 + rng.random(), c * 7 + rng.random()) for c in range(7) for _ in range(6)] + [(2, float(i), 0.0) for i in range(4)]
    df = spark.createDataFrame(pts, "wave int, x double, y double")
    rows = cluster.sweep_groups(df, "wave", ["x", "y"], range(2, 11), range(42, 52)).collect()
    assert {r.k for r in rows if r.wave == 2} == {2, 3}  # below the number of profiles
    mine = sorted((r.k, r.inertia, r.silhouette) for r in rows if r.wave == 1)
    assert max(mine, key=lambda r: r[2])[0] == 7 and [r[1] for r in mine] == sorted((r[1] for r in mine), reverse=True)
    one = df.filter("wave = 1").select(F.floor(F.col("x") / 10).cast("int").alias("prediction"), array_to_vector(F.array("x", "y")).alias("features"))
    assert mine[5][2] == pytest.approx(ClusteringEvaluator().evaluate(one), rel=1e-9)
