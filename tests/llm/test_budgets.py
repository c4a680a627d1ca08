"""Problems 8 and 9, and the entry module."""

import collections
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textverk.llm import p8_containers as p8
from textverk.llm import p9_mixture as p9
from textverk.llm import queries, tokens


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(50, 120))
def test_pack_is_a_partition_within_capacity(sizes, capacity):
    groups = p8.pack(sizes, capacity)
    assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in g) <= capacity for g in groups)


def test_differencing_is_near_equal():
    rng = random.Random(1)
    sizes = [rng.randint(1, 100) for _ in range(400)]
    sums = [sum(sizes[i] for i in g) for g in p8.difference(sizes, 10)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 4


def test_packing_fills_well():
    rng = random.Random(2)
    sizes = [min(2048, int(rng.lognormvariate(6.2, 0.8))) for _ in range(900)]
    groups = p8.pack(sizes, 2048)
    assert sum(sizes) / (2048 * len(groups)) > 0.96


def test_containers(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice([0, 5, 90, 250, 256, 257, 900, 5000]), 1) for i in range(300)] + [(7, 90, 1), (7, 90, 1), (None, 40, 1)]
    df = spark.createDataFrame(docs, "doc_id long, n_tokens int, size int")
    specs = spark.createDataFrame([(1, 256), (2, 1000), (3, None), (4, 0)], "spec_id int, capacity_tokens int")
    rows = p8.containers(df, specs).collect()
    for spec, cap in ((1, 256), (2, 1000)):
        mine = [r for r in rows if r.spec_id == spec]
        fill = collections.Counter()
        for r in mine:
            fill[r.container] += r.size
        assert max(fill.values()) <= cap and sum(fill.values()) == sum(n for _, n, _ in docs)
        parts = collections.defaultdict(list)
        for r in mine:
            parts[r.doc_id].append((r.token_from, r.size))
        for i, n, _ in docs[:300]:
            if i == 7:
                continue
            got = sorted(parts[i])
            assert len(got) == max(1, -(-n // cap)) and sum(x for _, x in got) == n and got[0][0] == 0
            assert all(a + b == c for (a, b), (c, _) in zip(got, got[1:], strict=False))
        assert len(parts[7]) == sum(max(1, -(-n // cap)) for i, n, _ in docs if i == 7)
    assert {r.spec_id for r in rows} == {1, 2}
    assert p8.containers(df.limit(0), specs).count() == 0
    rep = {r.spec_id: r for r in p8.report(p8.containers(df, specs)).collect()}
    assert rep[1].fill > 0.9 and rep[2].fullest <= 1000


CELLS = pd.DataFrame([(s, la, "t", n) for s, la, n in (("a", "sv", 100), ("a", "en", 100), ("b", "sv", 1000), ("b", "en", 50), ("c", "sv", 9))], columns=["source", "language", "topic", "tokens"])
TARGETS = pd.DataFrame([("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.2, 50), ("none", 0.1, 1)], columns=["source", "target_share", "max_repeats"])


def test_raking():
    got, part = p9.rake(CELLS, TARGETS, p9.EXACT)
    mass = (got["weight"] * got["tokens"]).groupby(got["source"]).sum()
    assert part.sum() == pytest.approx(800)  # a can give 400 tokens, which is half
    assert mass["a"] == pytest.approx(400) and mass["b"] == pytest.approx(240) and mass["c"] == pytest.approx(160)
    assert (got["weight"] <= got["max_repeats"] + 1e-9).all()
    assert p9.rake(CELLS.iloc[:0], TARGETS)[0].empty


def test_sources_at_their_cap_leave_the_rest_in_proportion():
    got, part = p9.rake(CELLS, TARGETS)
    mass = (got["weight"] * got["tokens"]).groupby(got["source"]).sum()
    assert part.sum() == pytest.approx(1259)  # every text once
    assert mass["a"] == pytest.approx(400)  # its cap
    assert mass["b"] == pytest.approx(859 * 0.6, rel=1e-4) and mass["c"] == pytest.approx(859 * 0.4, rel=1e-4)
    have, caps, share = pd.Series({"a": 10.0, "b": 20.0}), pd.Series({"a": 1.0, "b": 2.0}), pd.Series({"a": 0.5, "b": 0.5})
    assert p9.allot(have, caps, share, 10**6).to_dict() == {"a": 10.0, "b": 40.0}  # all that the caps give


def test_mixture(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice("aaaaaabbc"), rng.choice(["sv", "en", None]), None, rng.randint(5, 60), 9) for i in range(3000)] + [(9001, "x", "sv", "t", 50, 9), (9002, None, "sv", "t", 50, 9), (9003, "a", "sv", "t", 0, 9)]
    df = spark.createDataFrame(docs, "doc_id long, source string, language string, topic string, n_tokens int, copies int")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.35, 2), ("c", 0.25, 3), ("none", None, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    cap = {"a": 1, "b": 2, "c": 3}
    for total in (p9.EXACT, None):
        mix = p9.mixture(df, targets, total)
        rows = mix.collect()
        assert all(1 <= r.copies <= cap[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
        got = {r.source: r for r in p9.shares(mix, targets, df.filter("n_tokens > 0")).collect()}
        assert got["none"].held_by == "no tokens" and got["none"].actual_share == 0
        for k in cap:
            assert got[k].actual_share == pytest.approx(got[k].target_share, abs=0.003)
        if total is None:
            assert sum(r.tokens for r in got.values()) == pytest.approx(sum(d[4] for d in docs if d[1] in cap), rel=0.01)
    assert p9.mixture(df.limit(0), targets).count() == 0 and p9.mixture(df, targets.limit(0)).count() == 0


def test_no_source_with_tokens_is_left_out(spark):
    """One whose part is smaller than its smallest text still gives one."""
    docs = [(i, "a", "sv", "t", 10) for i in range(400)] + [(1000 + i, "b", "sv", "t", 900 + i) for i in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, source string, language string, topic string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.99, 5), ("b", 0.01, 1)], "source string, target_share double, max_repeats int")
    rows = p9.mixture(df, targets).collect()
    assert [r.doc_id for r in rows if r.source == "b"] == [1000]


def test_no_text_is_used_beyond_its_cap_through_copies(spark):
    """A third of the binding source is one text under many ids; b holds it too."""
    docs = [(i, "a", "sv", "t", 10, f"a{i}") for i in range(200)] + [(1000 + i, "a", "sv", "t", 10, "same") for i in range(100)]
    docs += [(2000 + i, "b", "sv", "t", 10, f"b{i}") for i in range(900)] + [(3000, "b", "en", "t", 10, "same")]
    df = spark.createDataFrame(docs, "doc_id long, source string, language string, topic string, n_tokens int, text_hash string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    mix = p9.mixture(df, targets, p9.EXACT)
    text, cap = {d[0]: (d[1], d[5]) for d in docs}, {"a": 2, "b": 3}
    uses = collections.Counter()
    for r in mix.collect():
        uses[text[r.doc_id]] += r.copies
    assert all(n <= cap[s] for (s, _), n in uses.items())
    assert sum(n for (s, _), n in uses.items() if s == "a") == 2 * 201  # the copies are no room
    got = {r.source: r for r in p9.shares(mix, targets, p9.units(df, targets)).collect()}
    for s in "ab":
        assert got[s].most_copies == max(n for (x, _), n in uses.items() if x == s)
        assert got[s].actual_share == pytest.approx(0.5, abs=0.003)
    assert got["a"].most_uses == max(max(n for (x, _), n in uses.items() if x == "a"), uses["a", "same"] + uses["b", "same"])
    assert p9.mixture(df.limit(0), targets).columns == mix.columns


def test_sizes(spark):
    enc = tokens.encoder()
    texts = ["Räddningstjänsten övar.", "", None, "<|endoftext|> 字 " * 9, "a" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").selectExpr("doc_id", "text", "1 AS size")
    got = {r.doc_id: r.n_tokens for r in tokens.sizes(df, "text").collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts) if t is not None}


def test_every_problem_has_its_query():
    names = queries.queries()
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 10)} <= set(names) and any(n.startswith("p8_") for n in names) and any(n.startswith("p9_") for n in names)
    assert set(queries.oracle_sql()) <= set(names)
