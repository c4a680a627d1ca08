"""Problems 2, 5 and 6 against brute force, with dirty rows."""

import collections
import random
import unicodedata

import numpy as np
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from textverk.llm import p2_repeated_lines as p2
from textverk.llm import p5_term_counts as p5
from textverk.llm import p6_near_duplicates as p6
from textverk.llm.kernel import Fold, codes_of, lines_of, span_hashes, words_of
from textverk.session import stored


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n.åÅ1é́字𝔸", max_size=20), min_size=1, max_size=6))
def test_kernel_words_and_lines(texts):
    codes, off = codes_of(texts)
    if not len(codes):
        return
    s, e, r = words_of(Fold("LN")(codes), off)
    flat = "".join(texts)
    got = collections.defaultdict(list)
    for i, j, k in zip(s, e, r, strict=True):
        got[int(k)].append(flat[i:j].lower())
    for k, t in enumerate(texts):
        assert got[k] == regex.findall(r"[\p{L}\p{N}]+", t.lower())
    s, e, r, n = lines_of(codes, off)
    lines = {(int(k), int(m)): flat[i:j] for i, j, k, m in zip(s, e, r, n, strict=True)}
    assert lines == {(k, m): x for k, t in enumerate(texts) for m, x in enumerate(t.split("\n"), 1) if x}


def test_span_hash_depends_on_content_only():
    v = np.array([5, 6, 7, 5, 6, 7, 8], dtype=np.uint32)
    h = span_hashes(v, np.array([0, 3, 1, 4]), np.array([3, 6, 4, 7]))
    assert h[0] == h[1] and h[2] != h[3]


NOTICE = ["Kopiera gärna texten", "DELA sidan med en vän!", "Följ oss i våra kanaler"]


def _files():
    rng = random.Random(5)
    rows, n = [], 0
    for entity in ("Alfa", "Beta"):
        for i in range(30):
            body = [" ".join(rng.choice("vatten brand el skola väg buss torka is".split()) + str(rng.randint(0, 9)) for _ in range(9)) for _ in range(6)]
            for k, notice in enumerate(NOTICE):
                if rng.random() < (0.9, 0.3, 0.12)[k]:
                    body.insert(rng.randint(0, len(body)), notice.upper() if rng.random() < 0.5 else f"  {notice} {i}")
            body.insert(2, "kort")
            long = "Samma långa stycke " * 12 if i % 2 else "Helt annat stycke nummer " * 9 + str(i)
            text = "\n".join([*body, long])
            for _ in range(1 + (i % 7 == 0)):
                n += 1
                rows.append((n, f"{entity} {i}.pdf", text, "x"))
    rows += [(900, "Alfa 1.pdf", None, None), (901, None, "DELA sidan med en vän!", None), (902, "utan.pdf", "DELA sidan med en vän!\n" * 9, None), (903, "Alfa 2.pdf", "", None), (904, "Beta 3.pdf", "\n\n", None)]
    return rows


def test_repeated_lines_equal_brute_force(spark):
    rows = _files()
    df = spark.createDataFrame(rows, "rec int, file string, text string, source string")
    src = [(f, f.split()[0]) for f in sorted({r[1] for r in rows if r[1] and r[1] != "utan.pdf"})]
    places = p2.repeated(df, spark.createDataFrame([*src, ("utan.pdf", None)], "doc string, source string"), "rec", "file", "text")
    got = {(r.rec_id, r.line_no) for r in places.filter("whole").collect()}
    ent, files, total = dict(src), collections.defaultdict(set), collections.defaultdict(set)
    keyed = []
    for rec, f, t, _ in rows:
        if f in ent:
            total[ent[f]].add(f)
            for k, line in enumerate((t or "").split("\n"), 1):
                w = regex.sub(r"[^\p{L}]", "", line.lower())
                if 8 <= len(w) <= 150:
                    keyed.append((rec, k, ent[f], w))
                    files[ent[f], w].add(f)
    want = {(r, k) for r, k, e, w in keyed if len(files[e, w]) >= 5 and len(files[e, w]) * 5 >= len(total[e])}
    assert got == want and len(want) > 30
    # a long repeated paragraph is found by its chunks, and cut
    assert places.filter("NOT whole").count() > 0
    clean = {r.rec_id: r.clean_text for r in p2.cut(df, places, "rec", "text").collect()}
    assert clean[900] is None and clean[903] == "" and "KOPIERA" not in clean[1].upper() and "kort" in clean[1]
    assert p2.repeated(df.limit(0), spark.createDataFrame(src, "doc string, source string"), "rec", "file", "text").count() == 0


def _terms(rows, scope):
    occ, recs, seen = collections.Counter(), collections.defaultdict(set), {}
    for r, u, t in rows:
        if r in scope and t is not None:
            seen[r, u] = min(t, seen.get((r, u), t))
    for (r, _), t in seen.items():
        for w in regex.findall(r"[\p{L}\p{M}]+", unicodedata.normalize("NFC", t).lower()):
            occ[w] += 1
            recs[w].add(r)
    return {w: (n, len(recs[w])) for w, n in occ.items()}


ROWS = [("a", 1, "Brand och BRAND, åska"), ("a", 1, "Brand och BRAND, åska"), ("a", 2, "åska ҉x"), ("a", 600, "brand på slutet"), ("b", 1, None), ("b", 2, ""), ("b", None, "brand i okänd rad"), (None, 1, "brand"), ("c", 1, "utanför"), ("d", 3, "ΣΑΣ İx " + "ord " * 50)]


def _count(spark, rows, scope, prev=None, before=None):
    schema = "rec string, unit long, text string"
    df = spark.createDataFrame(rows, schema).withColumn("term", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("x"))
    old = spark.createDataFrame(before, schema) if before is not None else None
    s = spark.createDataFrame([(x,) for x in scope] * 2, "rec string")
    return p5.merge(prev, p5.term_deltas(p5.changes(old, df), s))


def _got(counts):
    return {r.term: (r.occurrences, r.records) for r in counts.collect()}


def test_term_counts_and_deltas(spark):
    scope = ["a", "b", "d"]
    first = _count(spark, ROWS, scope)
    assert _got(first) == _terms(ROWS, scope)
    later = [r for r in ROWS if r[0] != "b"] + [("e", 1, "ny brand"), ("a", 3, "ännu en rad")]
    scope2 = ["a", "b", "d", "e"]
    second = _count(spark, later, scope2, first, ROWS)
    assert _got(second) == _terms(later, scope2)
    assert _got(_count(spark, later, scope2, second, later)) == _got(second)  # nothing changed
    n = spark.createDataFrame([(3,)], "n long")
    marks = {r.term: r.mark for r in p5.mark(second, n, min_occ=2, max_share=0.5).collect()}
    assert marks["brand"] == "common" and marks["ny"] == "rare"
    assert _got(_count(spark, [], ["a"])) == {}


def test_changes_leave_equal_records_out(spark):
    a = spark.createDataFrame([("x", 1, "t"), ("x", 1, "t"), ("y", 1, "u"), ("z", None, None)], "rec string, unit long, text string")
    b = spark.createDataFrame([("x", 1, "t"), ("y", 1, "v"), ("z", None, None)], "rec string, unit long, text string")
    assert {(r.rec, r.sign) for r in p5.changes(a, b).collect()} == {("y", -1), ("y", 1)}


def _grams(t, k=3):
    w = regex.findall(r"[\p{L}\p{N}]+", t.lower())
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def _texts():
    rng = random.Random(2)
    voc = [f"ord{i}" for i in range(400)]
    out = []
    for g in range(25):
        base = [rng.choice(voc) for _ in range(rng.randint(40, 300))]
        out.append(" ".join(base))
        for _ in range(4):
            v = list(base)
            for _ in range(rng.randint(0, max(1, len(v) // 14))):
                i = rng.randrange(len(v))
                v[i : i + 1] = rng.choice([[rng.choice(voc)], [], [v[i], rng.choice(voc)]])
            out.append((" ".join(v)).upper() if rng.random() < 0.3 else ", ".join(v))
        out.append(" ".join(base))
    return out


def test_near_duplicates_equal_brute_force(spark):
    texts = _texts()
    rows = [(i, f"f{i:03d}", t, 7) for i, t in enumerate(texts)] + [(900, "f000", texts[0], 1), (901, None, texts[0], 1), (902, "tom", None, 1), (903, "kort", "tre ord bara", 1), (904, "blank", "  ", 1)]
    df = spark.createDataFrame(rows, "id int, file string, text string, fp int")
    docs = stored(p6.documents(df, "file", "text"), "t6")
    found = p6.links(docs, df, "file", "text", 0.7)
    got = {(r.filename_a, r.filename_b) for r in p6.document_pairs(docs, found).collect()}
    sets = {f: set(_grams(t)) for _, f, t, _ in rows if f and t and len(regex.findall(r"[\p{L}\p{N}]+", t)) >= 40}
    names = sorted(sets)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert got == want and len(want) > 60
    groups = {r.filename: (r.group_id, r.n_links) for r in p6.groups(docs, found).collect()}
    assert set(groups) == set(names)
    for a, b in want:
        assert groups[a][0] == groups[b][0]
    empty = stored(p6.documents(df.limit(0), "file", "text"), "t6")
    assert p6.document_pairs(empty, p6.links(empty, df, "file", "text", 0.7)).count() == 0


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(4)
    items = rng.integers(1, 2**63, 120).astype(np.uint64)
    wa, wb = rng.integers(1, 9, 120), rng.integers(1, 9, 120)
    wb[:30] = 0
    keep = wb > 0
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    m = 3000
    rec = np.concatenate([np.zeros(120, int), np.ones(keep.sum(), int)])
    sig = p6.bagminhash(rec, np.concatenate([items, items[keep]]), np.concatenate([wa, wb[keep]]), 2, m)
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * (true * (1 - true) / m) ** 0.5


def test_weighted_links(spark):
    a, b = "ett två tre fyra " * 20, "ett två tre fyra " * 16
    df = spark.createDataFrame([("a", a), ("b", b)], "file string, text string")
    docs = stored(p6.documents(df, "file", "text", weighted=True), "t6w")
    got = p6.links(docs, df, "file", "text", 0.5, weighted=True).collect()
    ca, cb = collections.Counter(_grams(a)), collections.Counter(_grams(b))
    assert len(got) == 1 and abs(got[0].jaccard - sum((ca & cb).values()) / sum((ca | cb).values())) < 1e-9


def test_a_crowded_bucket_is_joined_in_blocks(spark, monkeypatch):
    """Many different texts of one template: the same links whether buckets are cut or not."""
    base = [f"ord{i}" for i in range(120)]
    rows = [(f"f{i:03d}", " ".join([*base[:i], f"nytt{i}", *base[i:]])) for i in range(60)]
    df = spark.createDataFrame(rows, "file string, text string")
    docs = stored(p6.documents(df, "file", "text"), "t6h")
    whole = {(r.a, r.b) for r in p6.links(docs, df, "file", "text", 0.7).collect()}
    monkeypatch.setattr(p6, "BLOCK", 8)
    assert {(r.a, r.b) for r in p6.links(docs, df, "file", "text", 0.7).collect()} == whole and len(whole) == 60 * 59 // 2


def test_state_of_term_counts(spark, tmp_path):
    """Batches that are counted in one after the other give what a recount gives."""
    schema = "rec string, unit long, text string"
    df = lambda rows: spark.createDataFrame(rows, schema)
    all_ = lambda rows: {r[0] for r in rows if r[0]}
    state = p5.State(spark, f"file://{tmp_path}/counts")
    assert state.version == 0 and state.counts() is None
    state.apply(p5.changes(None, df(ROWS)))
    assert _got(state.counts()) == _terms(ROWS, all_(ROWS))
    later = [r for r in ROWS if r[0] not in ("b", "d")] + [("a", 3, "ännu en rad"), ("d", 3, "ändrad"), ("e", None, "ny brand"), ("f", 10**12, "långt bort")]
    feed = p5.changes(df(ROWS), df(later), state.records())
    assert {(r.rec, r.sign) for r in feed.collect()} == {("b", -1), ("a", -1), ("a", 1), ("d", -1), ("d", 1), ("e", 1), ("f", 1)}  # c is not read again
    state.apply(feed)
    assert state.version == 2 and _got(state.counts()) == _terms(later, all_(later))
    assert p5.changes(df(later), df(later[::-1]), state.records()).count() == 0
    state.apply(p5.changes(df(later), df([]), state.records()))
    assert _got(state.counts()) == {} and state.records().count() == 0


def test_many_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(p5, "TERMS_PER_BUCKET", 9)
    state = p5.State(spark, f"file://{tmp_path}/counts")
    state.apply(p5.changes(None, spark.createDataFrame([("a", 1, " ".join(f"ord{chr(97 + i)}" for i in range(26)))], "rec string, unit long, text string")))
    got = state.counts().collect()
    assert len(got) == 26 and len({r.bucket for r in got}) == 3


def test_cuts_follow_the_content():
    """A line has the same chunks wherever it stands, and chunks make up every line."""
    line = "Kopiera gärna texten och sprid den vidare till alla som bor i kommunen, men ange alltid källan när du gör det"
    texts = [f"Något helt annat före\n{line}\nefter", f"{line.upper()}", f"kort\n\nen rad till här\n  {line} 17\n"]
    lines, parts, n_lines, n_parts = p2.chunk_texts(texts, p2.Fold("L"), 8)
    seen = []
    for i in range(3):
        a, b = n_parts[i], n_parts[i + 1]
        of = {}
        for k in range(a, b):
            of.setdefault(int(parts[0][k]), []).append((int(parts[3][k]), int(parts[4][k])))
        assert all(len(v) == lines[4][n_lines[i] + k] for k, v in of.items())
        seen.append(max(of.values(), key=len))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 1 and sum(n for n, _ in seen[0]) == len(regex.sub(r"[^\p{L}]", "", line))
