import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textverk.functions import lexicon, meta, text
from textverk.functions.chi2 import survival
from textverk.operators import terms


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_file_names(spark):
    names = ["RSA Skellefteå 2015.pdf", "RSA Kalmar Län 2022.pdf", "NRSB MCF 2021.pdf", "RSA Ale 2015 Maskad.pdf", "rsa ale 2015.PDF", "plan.pdf", "", None]
    assert col(spark, names, meta.extract_year) == [2015, 2022, 2021, 2015, 2015, None, None, None]
    assert col(spark, names, meta.extract_entity)[:6] == ["Skellefteå", "Kalmar Län", "MCF", "Ale", "ale", "unknown"]
    got = col(spark, names, meta.parse_filename)
    assert (got[3].municipality, got[3].year, got[3].maskad) == ("Ale", "2015", True)
    assert (got[0].municipality, got[0].maskad) == ("Skellefteå", False)
    assert (got[5].municipality, got[5].year) == ("plan", "unknown")


def test_year_is_2000_to_2029_only(spark):
    assert col(spark, ["a 1999", "a 2030", "a 2029", "x2015y"], meta.extract_year) == [None, None, 2029, None]


def test_wave_edges(spark):
    assert col(spark, [2014, 2015, 2018, 2019, 2022, 2023, None], meta.wave_of, "int") == [0, 1, 1, 2, 2, 3, None]


def test_actor_and_labels(spark):
    assert col(spark, ["Kommuner", "Länsstyrelsen", "MSB ", "Region", None, ""], meta.normalise_actor) == ["kommun", "lansstyrelse", "MCF", "region", "unknown", "unknown"]
    assert col(spark, ["a", "b", None], lambda c: meta.translate(c, {"a": "A"})) == ["A", "b", None]


def test_periods_are_closed(spark):
    assert col(spark, [2010, 2011, 2015, 2016, 2024, 2025], meta.period_of, "int") == [None, "2011-2015", "2011-2015", "2016-2019", "2020-2024", None]


WORDS = ["brand", "brandå", "åbrand", "höga flöden", "höga  flöden", "it-angrepp", "brand_", "Brand", "ö", "x", "-", " ", ".", " ", "brand brand"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=30))
def test_counts_equal_python(spark, parts):
    t = " ".join(parts) + "".join(parts)
    for term in ("brand", "höga flöden", "it-angrepp"):
        want = len(re.findall(r"\b" + re.escape(term) + r"\b", t.lower()))
        assert col(spark, [t], lambda c, term=term: terms.count_by_pattern(c, term)) == [want]


def test_joined_counts_equal_pattern_counts(spark):
    texts = ["Brand brand, höga flöden.", "it-angrepp och it-angreppet; brand", None, "", "brandå _brand brand_"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    lex = ["brand", "höga flöden", "it-angrepp", "saknas"]
    got = {(r["id"], r["term"]): r["n"] for r in terms.count_terms(df, "id", "text", spark.createDataFrame([(t,) for t in lex], "term string")).collect()}
    want = {}
    for i, t in enumerate(texts):
        for w in lex:
            n = len(re.findall(r"\b" + re.escape(w) + r"\b", (t or "").lower()))
            if n:
                want[i, w] = n
    assert got == want


def test_cleaning(spark):
    t = "Rubrik\n  12  \n_____\nText  med   blanka \n\n\n\nSlut\n3 (14)\n"
    df = spark.createDataFrame([(t,), (None,), ("",)], "x string")
    c, n = text.artifact_counts(F.col("x"))
    rows = df.select(text.normal_space(c).alias("c"), n.alias("n")).collect()
    assert rows[0]["c"] == "Rubrik\n\nText med blanka\n\nSlut" and rows[0]["n"] == 3
    assert rows[1]["c"] is None and rows[2]["c"] == ""


def test_mojibake(spark):
    got = col(spark, ["VÃ¤g â€“ nr", "helt rent å", None, "Â§ 5 och Ã¤"], text.repair_mojibake)
    assert got[0].startswith("Väg") and got[1] == "helt rent å" and got[2] is None
    assert col(spark, ["Ã¤Ã¶xx", "", None], lambda c: F.round(text.mojibake_density(c), 3)) == [333.333, 0.0, 0.0]


def test_chapter_trim(spark):
    body = "Inledning\nrad\n3. Identifierad samhällsviktig verksamhet inom kommunens geografiska område\n" + "x" * 200
    got = col(spark, [body, "utan rubrik", "y" * 500 + "\n" + body[:90], body[14:], None], text.trim_to_chapter)
    assert got[0].text.startswith("rad\n3. Ident") and got[0].trimmed and not got[0].failed
    assert got[1].text == "utan rubrik" and got[1].failed
    assert got[2].failed and got[2].text.startswith("y")
    assert got[3].failed and not got[3].trimmed  # a heading at the very start counts as failed


def test_quality(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 20.0, 1.0), (2.0, 0.5, 5.0, 0.5), (None, 0.1, 0.1, 0.1)], "a double, b double, c double, d double")
    s = text.quality_score(*(F.col(c) for c in "abcd"))
    got = df.select(F.round(s, 4).alias("s"), text.quality_flag(s).alias("f")).collect()
    assert [(r.s, r.f) for r in got[:3]] == [(1.0, "ok"), (0.0, "very_low_quality"), (0.7, "ok")]


def test_negation(spark):
    assert col(spark, ["Det är INTE så", "intet", "ej, aldrig", None], text.negated) == [True, False, True, False]
    assert col(spark, ["Ej nu, inte då", None], text.negations) == [["ej", "inte"], []]


def test_small_text_columns(spark):
    assert col(spark, ["a  b c ", "", None], lambda c: F.size(text.tokens(c))) == [3, 0, 0]
    assert col(spark, ["En. Två! Tre? fyra", None], text.naive_sentences) == [["En.", "Två!", "Tre?", "fyra"], None]
    assert col(spark, ["ab1", "", None], text.alpha_ratio) == [2 / 3, None, None]
    assert col(spark, ["aé%", "", None], text.foreign_ratio) == [1 / 3, 0.0, 0.0]


def test_chi_square_tail():
    for x, k, p in ((45.914399047952614, 7, 9.083736856863661e-08), (66.19492879899448, 6, 2.458903028937826e-12), (26.384949926896933, 7, 0.00042979830572651594)):
        assert survival(x, k) == pytest.approx(p, rel=1e-10)
    assert survival(0, 3) == 1.0 and survival(1561.8559775298856, 9) < 1e-300


def test_lexicon():
    rows = lexicon.rows()
    assert len(rows) == 213 and len({t for _, t, _ in rows}) == 209 and [r[2] for r in rows] == list(range(213))
    assert len({(c, t) for c, t, _ in rows}) == 213 and len({t.lower() for _, t, _ in rows}) == 206
    sizes = {c: len(t) for c, t in lexicon.TERMS.items()}
    assert sizes == {"naturhot": 39, "biologiska_hot": 23, "olyckor": 38, "antagonistiska_hot": 27, "cyber_hot": 14, "sociala_risker": 6, "teknisk_infrastruktur": 33, "brand": 12, "miljö_klimat": 15, "ekonomi": 6}
    two = {t for _, t, _ in rows if sum(t == u for _, u, _ in rows) > 1}
    assert two == {"klimatförändring", "skogsbrand", "skogsbränder", "gräsbrand"}
