"""Operators of record linkage: hand-computed fixtures, SQL of the catalogue, and properties of whole plans."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corefold.functions import similarity as S
from corefold.functions import tables
from corefold.functions import text as T
from corefold.operators import decide, evaluate, features, keys, model, records, retrieval, validate, vectors
from corefold.plans import catalog, linkage
from corefold.sources import files
from corefold.streaming import incremental

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    return c


def rounded(row):
    return tuple(None if v is None or v != v else round(float(v), 9) if isinstance(v, float) or hasattr(v, "as_tuple") else v for v in row)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    want = sorted(map(str, map(rounded, rel.project(", ".join(cols)).fetchall())))
    assert sorted(map(str, (rounded(r) for r in df.select(*cols).collect()))) == want


LEARNT = {"ml_train_score", "ml_ensemble", "ml_leave_one_country_out", "ev_leave_one_country_out", "link_trained", "ev_trained_holdout"}


def test_only_learners_have_no_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == LEARNT


def test_learners_run(spark):
    sf = "/root/testdata/sf0.01"
    p = catalog.Pages(spark, sf)
    true = {(r["s1_id"], r["target_id"]) for r in p.truth.collect()}
    pool = {(r["s1_id"], r["target_id"]) for r in p.found("x2").collect()}
    rows = catalog.QUERIES["ml_train_score"](spark, sf).collect()
    assert {(r["s1_id"], r["target_id"]) for r in rows} == pool
    mean = lambda xs: sum(xs) / len(xs)
    assert mean([r["prob"] for r in rows if (r["s1_id"], r["target_id"]) in true]) > 0.6 > 0.2 > mean([r["prob"] for r in rows if (r["s1_id"], r["target_id"]) not in true])
    got = catalog.QUERIES["link_trained"](spark, sf).collect()
    assert len({r["target_id"] for r in got}) == len(got) > 20
    assert sum((r["s1_id"], r["target_id"]) in true for r in got) > 0.6 * len(got)


def test_left_out_country_is_learnt_and_judged_on_all_candidates(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    p = catalog.Pages(spark, sf)
    true = {(r["s1_id"], r["target_id"]) for r in p.truth.collect()}
    pool = {(r["country"], r["s1_id"], r["target_id"]) for r in p.found("x2").collect()}
    train, score, learnt, judged = model.train, model.score, [], []

    def small(labelled, kind, **options):
        learnt.append({(r["country"], r["s1_id"], r["target_id"], r["label"]) for r in labelled.collect()})
        return train(labelled, kind, maxIter=2, maxDepth=3, **options)

    def watched(m, pairs):
        judged.append(score(m, pairs))
        return judged[-1]

    monkeypatch.setattr(model, "train", small)
    monkeypatch.setattr(model, "score", watched)
    got = {r["country"]: r for r in catalog.QUERIES["ev_leave_one_country_out"](spark, sf).collect()}
    countries = sorted({c for c, _, _ in pool})
    assert sorted(got) == countries
    assert learnt == [{(c, a, b, int((a, b) in true)) for c, a, b in pool if c != left} for left in countries]
    for left, rows in zip(countries, judged, strict=True):
        rows = sorted((-round(r["prob"], 6), r["s1_id"], r["target_id"]) for r in rows.collect())
        assert {(left, a, b) for _, a, b in rows} == {x for x in pool if x[0] == left}
        best, owner, accepted = {}, {}, {}
        for prob, a, _ in rows:
            best.setdefault(a, -prob)
        for prob, a, b in rows:
            if -prob >= got[left]["th"] and best[a] >= got[left]["mt"] and owner.setdefault(b, a) == a:
                accepted.setdefault(a, set()).add(b)
        f05 = []
        for a in [r["entity_id"] for r in p.norm.where((F.col("country") == left) & F.col("is_s1")).collect()]:
            want, have = {y for x, y in true if x == a}, accepted.get(a, set())
            hits = len(want & have)
            f05.append(1.0 if not want and not have else 1.25 * hits / (0.25 * len(want) + len(have)))
        assert got[left]["macro_f05"] == pytest.approx(sum(f05) / len(f05), abs=2e-6)


def test_second_stage_sees_all_of_the_first(spark):
    sf = "/root/testdata/sf0.01"
    p = catalog.Pages(spark, sf)
    first = {(r["s1_id"], r["target_id"]): r["rn"] for r in retrieval.top(p.idf, 1200).collect()}
    assert max(first.values()) > 40
    rows = catalog.QUERIES["tk_rescore_all"](spark, sf).collect()
    assert {r["tag"] for r in rows} == set(retrieval.VARIANTS)
    for name, got in (("rescored", rows), ("boosted", catalog.QUERIES["tk_phonetic_boost"](spark, sf).collect()), ("learnt from", p.found("x2").collect())):
        assert any(first[r["s1_id"], r["target_id"]] > 40 for r in got), name
    for tag, v in retrieval.VARIANTS.items():
        assert max(r["rn"] for r in rows if r["tag"] == tag) <= v.cap
        assert all(first[r["s1_id"], r["target_id"]] <= v.k0 for r in rows if r["tag"] == tag)


def test_entry(spark):
    assert entry.entry(spark).columns == ["country", "s1_id", "target_id", "prob"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


# text


@pytest.mark.parametrize(("raw", "want"), [("A.B. & Co., Ltd", "a b and co ltd"), ("Límited", "limited"), ("", ""), (None, ""), ("a_b  c", "a_b c"), ("Œuvre ﬁn", "oeuvre fin"), ("संख्या १२", "snkhya 12")])
def test_clean_text(raw, want):
    assert T.clean_text(raw) == want


def test_clean_equals_unicode_on_ascii(spark):
    rnd = random.Random(1)
    rows = [("".join(chr(rnd.randrange(32, 127)) for _ in range(40)),) for _ in range(200)]
    got = spark.createDataFrame(rows, "s string").select(T.clean(F.col("s")).alias("a"), T.clean_unicode("s").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got)


def test_transliteration():
    assert T.transliterate_text("राम") == "ram"
    assert T.transliterate_text("٣۴") == "3۴"
    assert T.transliterate_text("क‍्") == "k"


def test_numbers_and_pins(spark):
    toks = F.split(F.lit("no 007 12 b x01234 560001"), " ")
    assert one(spark, T.numbers(toks)) == ["12", "1234", "560001", "7"]
    assert one(spark, T.pins(T.numbers(toks))) == ["560001"]
    assert one(spark, T.pins_g1(F.split(F.lit("01234 560001 x"), " "))) == ["01234", "560001"]
    assert one(spark, T.numbers(F.split(F.lit("000"), " "))) == ["0"]


def test_abbreviations_are_not_transitive(spark):
    assert one(spark, T.expand(F.split(F.lit("r rue st x"), " "))) == ["rue", "street", "street", "x"]


@pytest.mark.parametrize(("raw", "want"), [("krishna", "krsn"), ("krushna", "krsn"), ("lakshmi", "lksm"), ("laxmi", "lxm"), ("Phool 42", "fl 42"), ("", "")])
def test_phonetic(spark, raw, want):
    assert one(spark, T.phonetic_collapse(F.lit(raw))) == want


@pytest.mark.parametrize(("word", "code"), [("thompson", "0MPSN"), ("knight", "NT"), ("phone", "FN"), ("school", "SXL"), ("church", "XRX"), ("judge", "JJ"), ("xavier", "SFR"), ("", "")])
def test_metaphone(word, code):
    assert T.metaphone_text(word) == code


def test_metaphone_in_expressions(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdeghiknpstwxyz") for _ in range(rnd.randint(0, 9))) for _ in range(1500)] + ["thompson", "knight", "judge", "dumb", "éclair", "straße", "12", None]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.metaphone(F.col("w")).alias("m")).collect()
    assert [(r["w"], r["m"]) for r in got] == [(w, T.metaphone_text(w or "")) for w in words]


def test_normalise_g1(spark):
    rows = {"A.B. & Co., Ltd": "a b and co ltd", "Límited-Ça": "limited ca", "Œuvre राम": T.normalise_g1_text("Œuvre राम"), "": "", None: "", "x\ty": "x y"}
    got = spark.createDataFrame([(k,) for k in rows], "s string").select("s", T.normalise_g1(F.col("s")).alias("v")).collect()
    assert {r["s"]: r["v"] for r in got} == rows
    assert T.normalise_g1_text("Œuvre") == "œuvre"  # not transliterated


def test_md5_bucket(spark):
    assert one(spark, T.md5_bucket(F.lit("S1-00001"))) == 93


def test_tables():
    assert len(tables.LEGAL_TOKENS) == len(set(tables.LEGAL_TOKENS))
    assert tables.ADDR_ABBREV["r"] == "rue"
    assert "r" not in tables.ADDR_ABBREV_G1
    assert len(tables.VARIANTS) == 8


# similarity


def test_kernels():
    assert S.jaro_winkler_text("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert S.jaro_winkler_text("dixon", "dicksonx") == pytest.approx(0.766667 + 0.1 * 2 * (1 - 0.766667), abs=1e-5)
    assert S.token_set_text("acme bakery", "acme bakery pune") == 1.0
    assert S.token_sort_text("b a", "a b") == 1.0
    assert S.partial_text("bakery", "the bakery of pune") == 1.0
    assert S.kernels_text("", "x") == S.kernels_text("", "") == (0.0, 0.0, 0.0, 0.0)
    assert S.kernels_text("é", "é") == (1.0, 1.0, 1.0, 1.0)


def test_lcs_by_table():
    rnd = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for c in a:
            last = row[:]
            for j, d in enumerate(b):
                row[j + 1] = last[j] + 1 if c == d else max(last[j + 1], row[j])
        assert S.lcs_length(a, b) == row[-1]


def test_partial_of_many_pairs_is_that_of_each():
    rng = random.Random(3)
    made = lambda low, high: "".join(rng.choice("abc é") for _ in range(rng.randint(low, high)))
    pairs = [(made(0, 9), made(0, 9)) for _ in range(3000)] + [(made(55, 75), made(55, 90)) for _ in range(40)] + [(made(64, 64), made(64, 64)) for _ in range(5)]
    assert S.partial_texts(pairs) == [S.partial_text(*p) for p in pairs]


def test_kernels_of_many_pairs_are_those_of_each():
    rng = random.Random(4)
    made = lambda low, high, signs="abc é": "".join(rng.choice(signs) for _ in range(rng.randint(low, high)))
    pairs = [(made(0, 9), made(0, 9)) for _ in range(2500)] + [(made(50, 80), made(50, 80)) for _ in range(60)] + [(made(0, 20, "ab c"), made(0, 64, "ab c")) for _ in range(500)]
    pairs += [(x, y) for x in ("", " ", "a", "\0a", "中 文", "x" * 64, "x" * 65) for y in ("", " ", "a", "a\0", "中文", "x" * 64, "x" * 65)]
    for one_, many in ((S.jaro_winkler_text, S.jaro_winkler_texts), (S.token_sort_text, S.token_sort_texts), (S.token_set_text, S.token_set_texts)):
        assert list(many(pairs)) == [one_(*p) for p in pairs]
        assert len(many([])) == 0


def test_gram_features_run_no_function_a_gram(spark):
    rows = [("abcdabcd", "abcde"), ("abc", "abcd"), ("", ""), ("x y z", "x y z"), (None, "abcd"), ("aéaéaé", "éaéaé")]
    df = spark.createDataFrame(rows, "a_name_norm string, b_name_norm string")
    want = S.jaccard(T.grams(F.coalesce("a_name_norm", F.lit(""))), T.grams(F.coalesce("b_name_norm", F.lit(""))))
    for r in df.select(S.gram_jaccard("a_name_norm", "b_name_norm").alias("got"), want.alias("want")).collect():
        assert r["got"] == r["want"]
    assert "transform" not in str(features.exact_features()["n_char4"])


def _texts(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(90)] + ["same text"] * 40
    rows = [(f"S{i % 3 + 1}-{i:03d}", "us" if i % 5 else "fr", i % 3 == 0, t) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc string, country string, is_s1 boolean, text string")


def test_cosines_in_blocks_are_those_of_joined_grams(spark):
    rows, docs = _texts(spark)
    unit = retrieval.tfidf(docs.select("doc", "text")).join(docs.select("doc", "country", "is_s1"), "doc")
    want = {(r["country"], r["a"], r["b"]): r["cos"] for r in retrieval.cosine(unit.where("is_s1"), unit.where("not is_s1"), ("country", "gram")).collect()}
    space = vectors.fit(docs)
    got = {(r["country"], r["a"], r["b"]): r["cos"] for r in vectors.above(space, docs, 0.0).collect()}
    assert len(got) > 500 and got == pytest.approx({k: v for k, v in want.items() if v > 0})
    best = {}
    for (_, a, b), cos in sorted(got.items(), key=lambda x: (x[0][1], -x[1], x[0][2])):
        best.setdefault(a, []).append(b)
    near = vectors.nearest(space, docs, 7).orderBy("a", "rn").collect()
    assert [(r["a"], r["b"], r["rn"]) for r in near] == [(a, b, i + 1) for a in sorted(best) for i, b in enumerate(best[a][:7])]
    text = {d: t for d, _, _, t in rows}
    pairs = spark.createDataFrame([(a, b, text[a], text[b]) for _, a, b in got], "a string, b string, x string, y string")
    each = {(r["a"], r["b"]): r["cos"] for r in pairs.select("a", "b", vectors.pair_cosine(space, "x", "y").alias("cos")).collect()}
    assert each == {(a, b): cos for (_, a, b), cos in got.items()}  # to the last bit: a bound splits pairs in one way


def test_nearest_by_a_matrix_are_those_by_terms(monkeypatch):
    rng = random.Random(8)
    words = ["http", "www", "com", *["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(30)]]
    made = lambda: " ".join(["http", "com", *rng.choices(words, k=rng.randint(0, 5))])
    space, known = vectors.Space("none", 300, (3, 4), False), {}
    texts = {f"{made()}": [f"S1-{i}"] for i in range(80)}
    others = sorted({made() for _ in range(200)})
    for t in [*texts, *others]:
        known |= dict.fromkeys(vectors.grams(t, space.sizes))
    monkeypatch.setattr(vectors, "_vocabulary", lambda _: ({g: i for i, g in enumerate(sorted(known))}, np.linspace(1, 4, len(known))))
    vectors.weigh.cache_clear()
    ids = vectors.pa.array([[f"S2-{i:03d}", f"S3-{i:03d}"] for i in range(len(others))])
    vecs = [vectors.weigh(space, t) for t in others]
    batch = (ids, np.concatenate([v[0] for v in vecs]), np.concatenate([v[1] for v in vecs]), np.cumsum([len(v[0]) for v in vecs]))
    got = []
    for dense in (0, 40):
        block = vectors._Block(space, texts, dense)
        assert len(block.head) == dense
        got.append([tuple(r.values()) for x in vectors._best(block, "us", iter([batch]), 1e-6, 7, len(known)) for r in x.to_pylist()])
    vectors.weigh.cache_clear()
    assert got[0] == got[1] and len(got[0]) == 7 * len(texts)


def test_cosines_of_pairs_join_no_grams(spark):
    for name in ("sm_tfidf_cosine", "jn_tfidf_topk"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "gram" not in plan


@pytest.mark.parametrize("score", ["idf", "hits"])
def test_ranked_lists_are_the_ranked_pairs(spark, score):
    keyed = catalog.Pages(spark, "/root/testdata/sf0.01").keyed
    want = retrieval.top(retrieval.idf_scores(retrieval.shared_keys(keyed)), 5, score)
    got = retrieval.ranked(keyed, 5, score)
    columns = ["country", "s1_id", "target_id", "idf", "hits", "rn"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_similarity_properties(spark):
    rnd = random.Random(5)
    rows = [tuple(" ".join(rnd.choice(["ab", "abc", "bcd", "x"]) for _ in range(rnd.randrange(5))) for _ in range(2)) for _ in range(150)]
    df = spark.createDataFrame(rows, "a string, b string")
    made = lambda a, b: [S.guarded(a, b, S.levenshtein(a, b)), S.jaccard(F.split(a, " "), F.split(b, " ")), S.length_ratio(a, b)]
    for r in df.select(F.array(*made(F.col("a"), F.col("b"))).alias("x"), F.array(*made(F.col("b"), F.col("a"))).alias("y")).collect():
        assert r["x"] == r["y"]
        assert all(0 <= v <= 1 for v in r["x"])
    for a, b in rows:
        assert all(-1e-9 <= v <= 1 + 1e-9 for v in S.kernels_text(a, b))
        assert S.kernels_text(a, b) == pytest.approx(S.kernels_text(b, a))


def test_kernels_in_columns(spark):
    rnd = random.Random(6)
    word = lambda: rnd.choice(["acme", "bakery", "of", "pune", "acmé", "bak", "x"])
    rows = [tuple(" ".join(word() for _ in range(rnd.randrange(5))) for _ in range(2)) for _ in range(300)] + [(None, "a"), ("a", None), ("a b", "b a")]
    made = [f("a", "b") for f in (S.jaro_winkler, S.token_sort, S.token_set, S.partial)]
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", *[m.alias(f"k{i}") for i, m in enumerate(made)]).collect():
        assert tuple(r)[2:] == pytest.approx(S.kernels_text(r["a"], r["b"])), r


def test_levenshtein(spark):
    assert one(spark, S.levenshtein(F.col("a"), F.col("b")), a="kitten", b="sitting") == pytest.approx(0.571429, abs=1e-6)


# a small world


@pytest.fixture(scope="module")
def world(spark):
    """Synthetic firms: noisy copies in two other sources, confusable siblings, singletons; truth on the side."""
    rnd = random.Random(7)
    heads, kinds = ["sharma", "lakshmi", "apex", "river", "golden", "city", "modern", "royal", "green", "united"], ["bakery", "traders", "motors", "pharmacy", "textiles", "books"]
    rows, truth = [], []
    for i in range(160):
        country = ["us", "india", "france"][i % 3]
        name, number, street = f"{rnd.choice(heads)} {rnd.choice(heads)} {rnd.choice(kinds)} {i % 40}x{rnd.randrange(1000)}", rnd.randrange(1, 999), rnd.choice(["Maple", "Station", "Temple", "Harbour", "Victoria"])
        pin = 560000 + i
        rows.append((f"S1-{i:05d}", f"{name} Pvt Ltd", f"{number}, {street} Road, {pin}", country))
        if rnd.random() < 0.65:
            for k in range(rnd.randrange(1, 3)):
                words = name.split()
                if rnd.random() < 0.3:
                    j = rnd.randrange(len(words) - 1)
                    words[j] = words[j][:2] + words[j][3:]
                tid = f"S{2 + k}-{i:05d}"
                rows.append((tid, " ".join(words) + rnd.choice([" Limited", "", " & Co."]), f"No. {number} {street} {rnd.choice(['Rd', 'road'])} {pin}", country))
                truth.append((f"S1-{i:05d}", tid))
        if rnd.random() < 0.12:
            rows.append((f"S3-9{i:04d}", " ".join(name.split()[:2]) + " hardware", f"{number + 7} Other Street {pin + 5000}", country))
    rec = spark.createDataFrame(rows, files.RECORD)
    return rec, spark.createDataFrame(truth, "s1_id string, target_id string")


def test_linkage_end_to_end(spark, world):
    rec, truth = world
    norm = records.normalise(rec, unicode=True).persist()
    found = linkage.candidates(norm, "x2").persist()
    spine = rec.where(F.startswith("entity_id", F.lit("S1-"))).select(F.col("entity_id").alias("s1_id"))
    assert evaluate.recall_at(found, truth, (40,)).first()["recall"] > 0.97
    recalls = [r["recall"] for r in evaluate.recall_at(found, truth).orderBy("cap").collect()]
    assert recalls == sorted(recalls)
    matched = linkage.link(norm, found, decide.rules_table(spark, (("us", "x2", "m1", 0.4, 0.5),)), None).persist()
    trained = model.train(model.with_weights(linkage.train_pairs(norm, found, truth)), "m1", maxIter=5, maxDepth=3)
    learnt = linkage.link(norm, found, decide.rules_table(spark), trained).persist()
    assert evaluate.macro_f05(evaluate.entity_f05(spine, learnt, truth)).first()["macro_f05"] > 0.9
    for m in (matched, learnt):
        assert m.groupBy("target_id").count().where("count > 1").count() == 0
        assert m.join(found, ["s1_id", "target_id"], "left_anti").count() == 0
    lists = files.id_lists(spine, learnt, "ids")
    assert lists.count() == spine.count()
    kept = {r["rule"]: r["n"] for r in validate.violations(lists, files.id_lists(spine, found, "ids"), spine, rec).collect()}
    assert set(kept.values()) == {0}
    again = linkage.candidates(norm.repartition(7), "x2")
    assert again.select("s1_id", "target_id", "rn").exceptAll(found.select("s1_id", "target_id", "rn")).count() == 0


def test_models(spark, world):
    rec, truth = world
    norm = records.normalise(rec)
    found = linkage.candidates(norm, "n1")
    pairs = linkage.train_pairs(norm, found, truth, add_missing=True).persist()
    fit, held = model.holdout(pairs)
    assert fit.count() + held.count() == pairs.count()
    fit = model.with_weights(fit)
    both = model.ensemble([model.train(fit, "m1", maxIter=3, maxDepth=3), model.train(fit, "m2", numTrees=5, maxDepth=3)], pairs)
    r = both.agg(F.avg(F.when(F.col("label") == 1, F.col("prob"))).alias("t"), F.avg(F.when(F.col("label") == 0, F.col("prob"))).alias("f")).first()
    assert r["t"] > 0.8 > 0.3 > r["f"]
    assert model.leave_one_country_out(pairs, "m2", numTrees=3, maxDepth=3).count() == pairs.count()


def test_pair_features(spark, world):
    rec, _ = world
    norm = records.normalise(rec)
    ids = spark.createDataFrame([("us", "S1-00000", "S1-00000")], "country string, s1_id string, target_id string")
    f = features.pair_features(ids, norm).first().asDict()
    assert {k: f[k] for k in ("n_jw", "n_set", "core_jac", "a_jac", "num_ov", "pin_match", "name_eq", "core_eq", "n_char4", "x_sort")} == dict.fromkeys(("n_jw", "n_set", "core_jac", "a_jac", "num_ov", "pin_match", "name_eq", "core_eq", "n_char4", "x_sort"), 1.0)
    assert f["pin_conflict"] == f["num_conflict"] == f["is_s2"] == 0.0
    assert len(features.NAMES) == 35


def test_idf_term(spark):
    shared = spark.createDataFrame([("us", "a", "b", "nn", "k", 1)], "country string, s1_id string, target_id string, ktype string, key string, df long")
    assert retrieval.idf_scores(shared).first()["idf"] == 2.308312


def test_overflow_cap():
    assert [retrieval.overflow_cap(n) for n in (10, 3_000_000, 9_000_000)] == [750, 899, 2000]


def test_minhash_needs_grams(spark):
    rec = spark.createDataFrame([("S1-1", "ab", "", "us"), ("S1-2", "abcdefgh ijkl", "12 road", "us")], files.RECORD)
    got = keys.make(records.normalise(rec), {"mh": keys.families()["mh"]}).groupBy("entity_id").count().collect()
    assert [(r["entity_id"], r["count"]) for r in got] == [("S1-2", 16)]


def test_minhash_estimates_overlap(spark):
    texts = ["golden river bakery of the old town 12 station road", "golden river bakery of the old town 14 station road", "something else entirely here 99 temple street"]
    norm = records.normalise(spark.createDataFrame([(f"S1-{i}", t, "x", "us") for i, t in enumerate(texts)], files.RECORD))
    got = {}
    for r in keys.make(norm, {"mh": keys.families()["mh"]}).collect():
        got.setdefault(r["entity_id"], set()).add(r["key"])
    assert len(got["S1-0"] & got["S1-1"]) > 8 > 3 > len(got["S1-0"] & got["S1-2"])


def test_union_probe(spark):
    postings = [("us", "n", f"k{j}", f"S2-{t:03d}", 3) for t in range(100) for j in range(t % 3 + 1)]
    df = spark.createDataFrame(postings, "country string, ktype string, key string, target_id string, df long")
    asked = spark.createDataFrame([("us", "n", f"k{j}", "S1-1") for j in range(3)], "country string, ktype string, key string, s1_id string")
    whole = retrieval.union_probe(asked, [df], 30).select("target_id").collect()
    halves = retrieval.union_probe(asked, [df.where("target_id < 'S2-050'"), df.where("target_id >= 'S2-040'")], 30)
    assert {r["target_id"] for r in halves.collect()} == {r["target_id"] for r in whole}
    assert {r["index"] for r in halves.where("target_id >= 'S2-040' AND target_id < 'S2-050'").collect()} == {0}  # the first index counts


def test_rules_choose_variant_and_model(spark, world):
    rec, truth = world
    norm = records.normalise(rec, unicode=True).persist()
    rules = decide.rules_table(spark, (("us", "n1", "m1", 0.4, 0.5), ("india", "x1", "m2", 0.3, 0.3)))
    pairs = model.with_weights(linkage.train_pairs(norm, linkage.candidates(norm, "x2"), truth)).persist()
    models = {"m1": model.train(pairs, "m1", maxIter=3, maxDepth=3), "m2": model.train(pairs, "m2", numTrees=5, maxDepth=3)}
    got = linkage.link_by_rules(norm, rules, models).collect()
    for country, (tag, kind) in {"us": ("n1", "m1"), "india": ("x1", "m2"), "france": ("x2", "m1")}.items():
        here = norm.where(F.col("country") == country)
        want = linkage.link(here, linkage.candidates(here, tag), rules, models[kind]).collect()
        assert sorted(map(str, want)) == sorted(str(r) for r in got if r["country"] == country)
    assert len({r["country"] for r in got}) == 3


def test_trained_on_the_rest_and_measured_on_the_holdout(spark, world, monkeypatch):
    rec, truth = world
    monkeypatch.setattr(tables, "HOLDOUT", (700, 1000))  # few records: a larger part held out
    norm = records.normalise(rec, unicode=True).persist()
    models, rules = linkage.trained(norm, truth)
    assert {r["country"] for r in rules.collect()} == {"us", "india", "france"}
    assert {(r["tag"], r["model"]) for r in rules.collect()} <= {(t, m) for t in linkage.TAGS for m in linkage.KINDS}
    got = linkage.holdout_figures(norm, truth).first()
    assert got["entities"] > 30
    assert got["macro_f05"] > 0.85
    assert got["recall_at_40"] > 0.95


def test_linked_by_scores_made_once_as_by_the_models(spark, world, monkeypatch):
    rec, truth = world
    norm = records.normalise(rec, unicode=True).persist()
    asked = []
    made = linkage.candidates
    monkeypatch.setattr(linkage, "candidates", lambda *args: asked.append(args[1]) or made(*args))
    models, rules, pairs = linkage.fitted(norm, truth)
    assert asked == ["x1"]  # one retrieval for learning, both variants and linking
    for tag in linkage.TAGS:
        want = {tuple(r) for r in made(norm, tag).select(*retrieval.PAIR, "rn").collect()}
        assert {tuple(r) for r in pairs.where(linkage._of(F.lit(tag))).select(*retrieval.PAIR, "rn").collect()} == want
    mixed = decide.rules_table(spark, (("us", "x2", "m1", 0.4, 0.5), ("india", "x1", "m2", 0.3, 0.3)))
    for r in (rules, mixed):
        assert sorted(map(str, linkage.link_scored(pairs, r).collect())) == sorted(map(str, linkage.link_by_rules(norm, r, models).collect()))


def test_token_sets_against_many_texts():
    rng = random.Random(9)
    word = lambda: rng.choice(["ab", "abc", "b", "é", "cab", "a", "zz", "中文"])
    texts = [" ".join(word() for _ in range(rng.randrange(9))) for _ in range(300)] + ["", " ", "x" * 64, "x" * 65, "ab " * 90, " ".join(map(str, range(99)))]
    sets = S.TokenSets(texts)
    for a in texts[:50] + texts[-6:]:
        at = [rng.randrange(len(texts)) for _ in range(100)]
        assert sets.of(a, np.array(at)).tolist() == [S.token_set_text(a, texts[i]) for i in at]
    assert len(S.TokenSets([]).of("a", np.zeros(0, dtype=int))) == 0


def test_no_shared_key_is_shuffled(spark):
    """Lists of targets lie in the shared folder and are read by tasks: shuffles have numbers of keys."""
    keyed = catalog.Pages(spark, SF).keyed
    plan = retrieval.ranked(keyed, 5)._jdf.queryExecution().executedPlan().toString()
    assert "__k:bigint" in plan and "targets:array" not in plan and "__n" not in plan


def test_models_survive_saving(spark, world, tmp_path):
    rec, truth = world
    norm = records.normalise(rec)
    pairs = linkage.train_pairs(norm, linkage.candidates(norm, "n1"), truth).persist()
    made = model.train(model.with_weights(pairs), "m1", maxIter=2, maxDepth=2)
    model.save(made, str(tmp_path / "m"))
    read = model.load(str(tmp_path / "m"))
    probs = lambda m: sorted((r["s1_id"], r["target_id"], r["prob"]) for r in model.score(m, pairs).collect())
    assert probs(read) == probs(made)


def test_grid_is_each_cell_by_itself(spark):
    rnd = random.Random(11)
    rows = sorted({("us", f"S1-{rnd.randrange(25)}", f"S2-{rnd.randrange(25)}") for _ in range(200)})
    pairs = scored(spark, [(*r, round(rnd.random(), 2)) for r in rows]).persist()
    truth = spark.createDataFrame([r[1:] for r in rows if rnd.random() < 0.3], "s1_id string, target_id string")
    spine = spark.createDataFrame([(f"S1-{i}",) for i in range(27)], "s1_id string")
    ths = (0.3, 0.5, 0.9)
    grid = {(r["th"], r["mt"]): r["macro_f05"] for r in evaluate.grid_one_to_one(pairs, spine, truth, ths, ths).collect()}
    plain = {(r["th"], r["mt"]): r["macro_f05"] for r in evaluate.sweep(pairs, spine, truth, ths, ths).collect()}
    raised = F.col("target_id").isin([f"S2-{i}" for i in range(8)])
    rescue = {(r["cap"], r["rescue"], r["th"], r["mt"]): r["macro_f05"] for r in evaluate.rescue_sweep(pairs, spine, truth, raised, (2, 9), ths, ths).collect()}
    ranked = retrieval.top(pairs, 100, "prob")
    for th in ths:
        for mt in ths:
            score = lambda found: evaluate.macro_f05(evaluate.entity_f05(spine, found, truth)).first()["macro_f05"]
            assert grid[th, mt] == pytest.approx(score(decide.one_to_one(decide.gate(pairs, th, mt))), abs=2e-6)
            assert plain[th, mt] == pytest.approx(score(decide.gate(pairs, th, mt)), abs=2e-6)
            if mt >= th:
                up = ranked.withColumn("prob", F.when(raised, F.greatest("prob", F.lit(th))).otherwise(F.col("prob")))
                assert rescue[2, True, th, mt] == pytest.approx(score(decide.gate(up, th, mt).where("rn <= 2")), abs=2e-6)
                assert rescue[9, False, th, mt] == pytest.approx(score(decide.gate(ranked, th, mt).where("rn <= 9")), abs=2e-6)


# decisions


def scored(spark, rows):
    return spark.createDataFrame(rows, "country string, s1_id string, target_id string, prob double")


def test_one_to_one_ties(spark):
    got = decide.one_to_one(scored(spark, [("us", "S1-2", "t", 0.9000004), ("us", "S1-1", "t", 0.9000001)])).collect()
    assert [r["s1_id"] for r in got] == ["S1-1"]


def test_gates(spark):
    rows = scored(spark, [("us", "a", "x", 0.9), ("us", "a", "y", 0.65), ("us", "b", "z", 0.7), ("us", "a", "w", 0.1)])
    assert {r["target_id"] for r in decide.gate(rows, 0.62, 0.78).collect()} == {"x", "y"}
    assert {r["target_id"] for r in decide.filter_then_gate(rows, 0.62, 0.78).collect()} == {"x", "y"}


def test_neutral_address(spark):
    c = retrieval.address_score(F.lit(0.0), F.lit(""), F.lit("x"), 0.55)
    assert one(spark, c) == 0.55
    assert one(spark, retrieval.address_score(F.lit(0.2), F.lit(""), F.lit("x"), None)) == 0.2


def test_default_rule(spark):
    got = decide.with_rules(scored(spark, [("us", "a", "x", 0.5), ("peru", "a", "x", 0.5)]), decide.rules_table(spark)).orderBy("country").collect()
    assert [(r["country"], r["th"], r["mt"]) for r in got] == [("peru", 0.62, 0.78), ("us", 0.62, 0.78)]


def test_gated_rescue(spark):
    rows = scored(spark, [("us", "a", "x", 0.2), ("us", "a", "y", 0.2)]).withColumns({"a_sort": F.lit(0.95), "pin_match": F.lit(1.0), "num_ov": F.lit(0.0), "n_sort": F.when(F.col("target_id") == "x", 0.9).otherwise(0.1)})
    assert {r["target_id"]: r["prob"] for r in decide.gated_rescue(rows, 0.62).collect()} == {"x": 0.62, "y": 0.2}


@pytest.mark.parametrize(("pred", "true", "want"), [("abc", "ac", 0.714286), ("", "", 1.0), ("a", "", 0.0), ("", "a", 0.0), ("a", "a", 1.0)])
def test_f05(spark, pred, true, want):
    edges = lambda s: spark.createDataFrame([("s", c) for c in s], "s1_id string, target_id string")
    spine = spark.createDataFrame([("s",)], "s1_id string")
    assert evaluate.entity_f05(spine, edges(pred), edges(true)).first()["f05"] == pytest.approx(want, abs=1e-6)


# files and validation


def test_tsv_round_trip(spark, tmp_path):
    path = str(tmp_path / "records.tsv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t \"Acme\" NA \t\tus\nS2-1\tB\n")
    got = files.read_tsv(spark, path).orderBy("entity_id").collect()
    assert [tuple(r) for r in got] == [("S1-1", '"Acme" NA', "", "us"), ("S2-1", "B", "", "")]
    assert files.read_tsv(spark, path, strict=False).count() == 1
    again = str(tmp_path / "again.tsv")
    with open(again, "w", encoding="utf-8") as f:
        f.write("entity_id\tbusiness_name\tbusiness_address\tcountry\r\n" * 2 + "S1-1\ta\tb\tus\r\n" + "S1-2\ta\r\n")
    assert [tuple(r) for r in files.read_tsv(spark, again, strict=False).collect()] == [("entity_id", "business_name", "business_address", "country"), ("S1-1", "a", "b", "us")]
    with open(str(tmp_path / "bad.tsv"), "w", encoding="utf-8") as f:
        f.write("entity_id\tx\n")
    with pytest.raises(ValueError, match="business_name"):
        files.read_tsv(spark, str(tmp_path / "bad.tsv"))


def test_lines_of_a_file_read_by_many_tasks(spark, tmp_path):
    want = ["id\tids", *(f"S1-{i:05d}\t{'x' * (i % 50)}" for i in range(5000))]
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "part-0.csv").write_text("\n".join(want) + "\n")
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = files.read_lines(spark, str(tmp_path / "lists"))
        assert got.rdd.getNumPartitions() > 5
        assert {r["line"]: r["value"] for r in got.collect()} == dict(enumerate(want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)


def test_lists_read_by_many_tasks_as_in_sql(spark, con):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        got = {(r["s1_id"], r["ids"], r["line"]) for r in catalog.QUERIES["io_ordered_lists"](spark, SF).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == set(con.sql(f"SELECT s1_id, ids, line FROM ({catalog.ORACLE_SQL['io_ordered_lists']})").fetchall())


def test_upper_case_sign_by_sign_as_in_sql(spark):
    signs = [chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000]
    made = spark.createDataFrame([(i, c + "aß") for i, c in enumerate(signs)], "i int, c string").select("i", T.upper("c").alias("u"))
    got = dict(made.collect())
    want = dict(duckdb.sql("SELECT i::INT, upper(chr(c::INT) || 'aß') FROM (SELECT c, row_number() OVER (ORDER BY c) - 1 AS i FROM (SELECT unnest(range(1, 69632)) AS c) WHERE c < 55296 OR c >= 57344)").fetchall())
    assert {signs[i]: x for i, x in got.items() if x != want[i]} == {}


def test_replaced_countries_as_in_sql(spark, tmp_path):
    pages = [(i, "http://a.example", f'<html lang="{c}"><title>{t}</title>') for i, (c, t) in enumerate([("fr", "straße ﬁn ŉ"), ("de", "straße"), ("fr", "été")])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = {(r["entity_id"], r["country"], r["name"]) for r in catalog.QUERIES["io_replace_countries"](spark, str(tmp_path)).collect()}
    assert got == set(c.sql(f"SELECT entity_id, country, name FROM ({catalog.ORACLE_SQL['io_replace_countries']})").fetchall())


def test_write_lists(spark, tmp_path):
    lists = spark.createDataFrame([("S1-2", ""), ("S1-1", "S2-1,S3-1")], "source1_entity_id string, matched_entity_ids string")
    files.write_tsv(lists, str(tmp_path / "out"), "source1_entity_id")
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == b"source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\n"
    assert validate.check_header(text.decode().split("\n")[0], ("source1_entity_id", "matched_entity_ids")) is None
    assert validate.check_header("a,b", ("a",)) == "no tab in the header"


def test_by_country(spark, tmp_path):
    rec = spark.createDataFrame([("S1-1", "n", "a", "us"), ("S1-2", "n", "a", "fr")], files.RECORD)
    files.write_by_country(rec, str(tmp_path / "c"))
    read = spark.read.parquet(str(tmp_path / "c")).where("country = 'us'")
    assert read.count() == 1
    assert "PartitionFilters: [isnotnull" in read._jdf.queryExecution().toString()


def test_shards_of_any_order(spark):
    rnd = random.Random(12)
    ids = [f"S{rnd.randrange(10**6):06d}" for _ in range(500)]
    df = spark.createDataFrame([(x, k) for k, x in enumerate(ids)], "id string, shard_of int")
    got = files.shard_of(df.repartition(5), "id", 7).collect()
    place = {x: i for i, x in enumerate(sorted(ids))}
    per = -(-len(ids) // 7)
    assert all(abs(r["shard"] - place[r["id"]] // per) == 0 or ids.count(r["id"]) > 1 for r in got)
    assert sorted(r["shard"] for r in got) == sorted(i // per for i in range(len(ids)))
    assert files.shard_of(df.limit(0), "id", 7).count() == 0


def test_merged_parts_are_checked(spark):
    part = lambda *ids: spark.createDataFrame([(i, "") for i in ids], "s1_id string, ids string")
    spine = part("S1-1", "S1-2", "S1-3")
    assert files.merge_parts([part("S1-1"), part("S1-3", "S1-2")], spine).count() == 3
    for parts in ([part("S1-1", "S1-2")], [part("S1-1", "S1-2", "S1-3"), part("S1-1")], [part("S1-1", "S1-2", "S1-3", "S1-4")]):
        with pytest.raises(ValueError, match="ids"):
            files.merge_parts(parts, spine)
    with pytest.raises(ValueError, match="3 rows"):
        files.replace_countries(part("a").withColumn("country", F.lit("us")), part("b", "c").withColumn("country", F.lit("fr")), ["fr"], expected=4)


def test_validator_finds_faults(spark):
    lists = spark.createDataFrame([("S1-1", "S2-1,S2-1,S1-9"), ("S1-1", ""), ("S1-7", "S2-1,X")], "s1_id string, ids string")
    cands = spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, ids string")
    spine = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1_id string")
    known = spark.createDataFrame([("S2-1",)], "entity_id string")
    got = {r["rule"]: r["n"] for r in validate.violations(lists, cands, spine, known).collect()}
    assert got == {
        "repeated record": 1, "repeated target in a list": 1, "target of the first source": 1, "unknown prefix": 2, "missing record": 1, "unknown record": 1,
        "match that is no candidate": 3, "target claimed twice": 1, "target that doesn't exist": 2,
    }


# streaming


def test_incremental_linkage(spark, world, tmp_path):
    rec, _ = world
    pool = records.normalise(rec.where(~F.startswith("entity_id", F.lit("S1-"))))
    incremental.write_pool(pool, str(tmp_path / "pool"))
    rec.where(F.startswith("entity_id", F.lit("S1-"))).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.RECORD).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.start(stream, str(tmp_path / "pool"), str(tmp_path / "out"), str(tmp_path / "cp"), th=0.4, mt=0.5)
    q.awaitTermination(120)
    q.stop()
    got = incremental.settle(spark.read.parquet(str(tmp_path / "out")))
    assert got.count() > 30
    norm = records.normalise(rec)
    found = retrieval.top(retrieval.idf_scores(retrieval.shared_keys(keys.make(norm))), retrieval.VARIANTS["x2"].k0)
    batch = decide.one_to_one(decide.gate(features.pseudo_probability(found, norm), 0.4, 0.5))
    assert got.select("target_id").exceptAll(batch.select("target_id")).count() == 0
