import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.functions.patterns import captures, translate_pattern
from termloom.operators import annotate, association, bilingual, evaluation, linguistic, vectors
from termloom.plans import queries

CAND = "candidate string, n int, measure string, value long"


def test_translate_pattern():
    assert translate_pattern("|#|NOUN") == r"([^\s]+?\|([^\s]+?)\|NOUN)"
    assert translate_pattern("#||A .*|#x|B") == r"(([^\s]+?)\|[^\s]+?\|A [^\s]+\|(x)\|B)"
    assert captures(translate_pattern("#|#|A #||B")) == 3


def tagged(spark, segments):
    rows = [([tuple(t.split("|")) for t in s.split()],) for s in segments]
    return spark.createDataFrame(rows, "tagged array<struct<form string, lemma string, pos string>>")


def test_linguistic_chain(spark, rows):
    segs = ["red|red|ADJ cells|cell|NOUN grow|grow|VERB", "red|red|ADJ cells|cell|NOUN the|the|DET cells|cell|NOUN"]
    ng = linguistic.tagged_ngrams(tagged(spark, segs), minfreq=1)
    assert ("red cells", "red|red|ADJ cells|cell|NOUN", 2, 2) in rows(ng)
    terms = spark.createDataFrame([("red cells",), ("red cells",)], "term string")
    learned = linguistic.learn_patterns(ng, terms)
    assert rows(learned) == [("|#|ADJ #||NOUN", 4)]  # repeated terms count again
    got = linguistic.match_patterns(linguistic.stopword_filter_tagged(ng, {"the"}), ["#||ADJ |#|NOUN", "#||ADJ #||NOUN"])
    assert rows(got, "candidate", "value") == [("red cell", 2)]  # the first pattern wins
    assert linguistic.match_patterns(ng, []).count() == 0


def test_missing_tag_is_unk(spark):
    df = spark.createDataFrame([([("a", "a", None)],)], "tagged array<struct<form string, lemma string, pos string>>")
    assert df.select(linguistic.packed(F.col("tagged")).alias("p")).first().p == ["a|a|UNK"]


def test_representative(spark, rows):
    p = spark.createDataFrame([("a", 50), ("b", 30), ("c", 20), ("d", 0)], "pattern string, frequency long")
    assert rows(linguistic.representative(p, 50), "pattern") == [("a",), ("b",)]
    assert linguistic.representative(p.limit(0), 50).collect() == []


def test_windows_cross_segments_and_blocks(spark):
    rng = random.Random(3)
    docs = [(i, [rng.choice("abc") for _ in range(rng.choice([0, 1, 1, 2, 5]))]) for i in rng.sample(range(60), 25)]
    df = spark.createDataFrame(docs + [(99, None)], "id long, t array<string>")
    flat = [w for _, ws in sorted(docs) for w in ws]
    for k in (2, 3, 4):
        for blocks in (1, 2, 7, 1000):
            got = Counter(tuple(r.gram) for r in association.token_stream(df, "id", "t", k, blocks=blocks).collect())
            assert got == Counter(tuple(flat[i : i + k]) for i in range(len(flat) - k + 1)), (k, blocks)
    assert association.token_stream(df.limit(0), "id", "t", 2).collect() == []
    inner = Counter(tuple(r.gram) for r in association.token_stream(df, "id", "t", 2, cross_segments=False).collect())
    assert inner == Counter(tuple(ws[i : i + 2]) for _, ws in docs for i in range(len(ws) - 1))


def test_association(spark):
    df = spark.createDataFrame([(1, "a b a b c".split())], "id long, t array<string>")
    got = {r.candidate: r.value for r in association.association(df, "id", "t", "pmi").collect()}
    assert got["a b"] == pytest.approx(math.log2(2 * 5 / (2 * 2)))
    with pytest.raises(ValueError, match="none of"):
        association.association(df, "id", "t", "luck")


def test_classic_measures_by_hand(spark):
    # total 100: (n11, n1, n2)
    df = spark.createDataFrame([("x", 8, 20, 10, 100), ("no_n12", 10, 10, 30, 100), ("none_left", 5, 40, 60, 100)], "candidate string, n_all long, n1 long, n2 long, total long")
    got = {r.candidate: r for r in df.select("candidate", *(c.alias(m) for m, c in association.bigram_measures(df).items())).collect()}
    for r in got.values():
        assert r.mi == pytest.approx(r.pmi) and r.mi2 == pytest.approx(2 * r.pmi) and r.mi3 == pytest.approx(3 * r.pmi)
    x = got["x"]
    assert x.mi == 2.0  # 8 / (20 * 10 / 100)
    assert x.z_score == pytest.approx(6 / math.sqrt(2))
    assert x.odds == pytest.approx(8 * 70 / (12 * 2))
    cells = [(8, 2), (12, 20 * 82 / 100), (2, 10 * 72 / 100), (70, 72 * 82 / 100)]
    assert x.loglikelihood == pytest.approx(2 * sum(o * math.log2(o / e) for o, e in cells))
    assert got["no_n12"].loglikelihood == 0 and got["no_n12"].odds == pytest.approx(10 * 60 / 20)
    assert got["none_left"].odds == 0 and got["none_left"].loglikelihood == 0


def test_fisher(spark):
    df = spark.createDataFrame([(2, 3, 4, 20), (1, 1, 1, 5), (0, 2, 2, 10), (40, 50, 60, 90)], "n_all long, n1 long, n2 long, total long")
    got = [r.p for r in df.select(association.fisher().alias("p")).collect()]
    for p, (o, a, b, t) in zip(got, [(2, 3, 4, 20), (1, 1, 1, 5), (0, 2, 2, 10), (40, 50, 60, 90)], strict=True):
        want = sum(math.comb(a, k) * math.comb(t - a, b - k) for k in range(o + 1) if 0 <= b - k <= t - a) / math.comb(t, b)
        assert p == pytest.approx(want)


def test_compounds_appended(spark, rows):
    segs = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, text string")
    t = spark.createDataFrame([("a b",)], "term string")
    assert rows(bilingual.compoundify(segs, t, id_col="id", text="text", append=True)) == [(1, "a b"), (1, "a▁b"), (2, "c")]
    assert rows(bilingual.segments_with_terms(segs, t, id_col="id", source="text"), "id", "term") == [(1, "a b")]


def test_terms_are_found_as_characters(spark, rows):
    texts = [
        "He had a heart attack, then slept.", "heart attacks", "A Heart Attack is bad.", "(heart attack)", "heart  attack", "sheart attack", "x" * 5000 + " a b",
        "ab de la b", "", None, " ", "a", "病気の治療 heart attack", "heart attack",
    ]
    terms = ["heart attack", "attack", "a b", "b de la", "de", "治療", "t a", " a", "a ", "heart  attack", "e de l", "", " ", None, "zz top"]
    segs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    want = sorted(((i, x) for i, s in enumerate(texts) if s for x in terms if x and x.strip() and x in s), key=repr)
    assert rows(bilingual.segments_with_terms(segs, t, id_col="id", source="text"), "id", "term") == want
    got = bilingual.compoundify(segs, t.where("term = 'heart attack'"), id_col="id", text="text", append=True)
    assert sorted(r.text for r in got.collect() if r.text and "▁" in r.text) == sorted(s.replace("heart attack", "heart▁attack") for s in texts if s and "heart attack" in s)
    assert got.count() == len(texts) + sum("heart attack" in (s or "") for s in texts)


def test_models_are_loaded_on_the_worker(spark):
    df = spark.createDataFrame([(1, ["Cells", "grow"]), (2, None), (3, [])], "id long, tokens array<string>")
    got = linguistic.tag_with(df, "tokens", lambda: linguistic.DictionaryTagger({"cells": ("cell", "NOUN")})).orderBy("id").collect()
    assert [tuple(x) for x in got[0].tagged] == [("Cells", "cell", "NOUN"), ("grow", "grow", "NOUN")]
    assert got[1].tagged is None and got[2].tagged == []
    got = annotate.predict(df, "tokens", lambda: lambda batch: [["B"] * len(t) for t in batch]).orderBy("id").collect()
    assert [r.labels for r in got] == [["B", "B"], None, []]


def test_balanced_keeps_the_share(spark):
    rows_ = [(i, ["B", "O"]) for i in range(17)] + [(100 + i, ["O"]) for i in range(50)]
    df = spark.createDataFrame(rows_, "id long, l array<string>")
    count = lambda got: (sum(r.id < 100 for r in got), sum(r.id >= 100 for r in got))
    assert count(annotate.balanced(df, "l", size=10, negatives=0.2).collect()) == (8, 2)
    assert count(annotate.balanced(df, "l", size=1000, negatives=0.15).collect()) == (17, 3)  # as many as 17 positives allow


def test_evaluation_lowest_first_with_frequencies(spark):
    cands = spark.createDataFrame(
        [("a", 1, 5, 1), ("b", 1, 1, 2), ("C", 1, 1, 9), ("d e f g", 4, 0, 1), ("x", 1, 2, 2)], "candidate string, n int, value long, frequency long"
    )
    ref = spark.createDataFrame([("c",), ("c",)], "term string")
    got = evaluation.evaluate_topk(cands, ref, 2, ignore_case=True, nmax=3, ascending=True, seeds=spark.createDataFrame([("q",)], "term string")).first()
    assert (got.precision, got.recall) == (50.0, pytest.approx(100 / 3))


def test_evaluation_is_the_mean_over_tie_breaks(spark):
    vals = [("a", 3), ("b", 2), ("c", 2), ("d", 2), ("e", 1)]
    ref = ["a", "c", "e", "z"]
    cands = spark.createDataFrame([(c, 1, "f", v) for c, v in vals], CAND)
    got = evaluation.evaluate_topk(cands, spark.createDataFrame([(r,) for r in ref], "term string"), 2).first()
    rng, hits = random.Random(1), []
    for _ in range(4000):
        best = sorted(vals, key=lambda x: (-x[1], rng.random()))[:2]
        hits.append(sum(c in ref for c, _ in best))
    assert got.precision == pytest.approx(100 * np.mean(hits) / 2, rel=0.03)
    none = evaluation.evaluate_topk(cands.limit(0), spark.createDataFrame([], "term string"), 2).first()
    assert (none.precision, none.recall, none.f1) == (0, 0, 0)


def test_term_metrics(spark):
    schema = "id long, terms array<string>"
    p = spark.createDataFrame([(1, ["a", "a", "b"]), (2, None)], schema)
    t = spark.createDataFrame([(1, ["a", "c"]), (3, ["d"])], schema)
    m = evaluation.term_metrics(p, t, id_col="id", terms="terms").first()
    assert (m.precision, m.recall) == (pytest.approx(1 / 3), pytest.approx(1 / 3))
    s = evaluation.term_metrics(p, t, id_col="id", terms="terms", as_sets=True).first()
    assert s.precision == pytest.approx(1 / 2)
    assert evaluation.term_metrics(p.limit(0), t.limit(0), id_col="id", terms="terms").first().f1 == 0


def test_bio(spark):
    df = spark.createDataFrame(
        [("a b c d e".split(), "I B I O B".split()), (["x"], ["B"]), ([], []), (None, None), (["a", "b"], ["B", "B"])],
        "t array<string>, l array<string>",
    )
    got = [r.x for r in df.select(annotate.bio_terms(F.col("t"), F.col("l")).alias("x")).collect()]
    assert got == [["b c", "e"], ["x"], [], None, ["a", "b"]]


def test_label_terms(spark):
    df = spark.createDataFrame(
        [("the red cell wall cell".split(), ["cell", "red cell wall", "the"]), (None, ["a"]), (["a"], None)], "t array<string>, w array<string>"
    )
    bio = annotate.label_terms("BIO", ["the"])
    bilou = annotate.label_terms("BILOU", ["the"])
    r = df.select(bio("t", "w").alias("b"), bilou("t", "w").alias("u")).collect()
    assert r[0].b == ["O", "B", "I", "I", "B"]
    assert r[0].u == ["O", "B", "I", "L", "U"]
    assert r[1].b is None
    assert r[2].b == ["O"]


def test_clean_predictions(spark):
    df = spark.createDataFrame([(["the cell wall of", "-", ",.", "x - y", "the", "( a )", ""],)], "t array<string>")
    got = df.select(annotate.clean_predictions(F.col("t"), ["the", "of"]).alias("x")).first().x
    assert got == ["cell wall", "x-y", "(a)"]


def test_align_labels(spark):
    df = spark.createDataFrame([(["B", "O"], [None, 0, 0, 1, None])], "l array<string>, w array<int>")
    ids = {"O": 0, "B": 1, "I": 2}
    got = df.select(annotate.align_labels(F.col("l"), F.col("w"), ids).alias("x"), annotate.align_labels(F.col("l"), F.col("w"), ids, expand=True).alias("y")).first()
    assert got.x == [-100, 1, 2, 0, -100] and got.y == [-100, 1, 1, 0, -100]


def test_parallel_terms(spark, rows):
    pairs = spark.createDataFrame(
        [(1, "the red cell.", "la célula roja"), (2, "a red cell", "una célula roja"), (3, "red", "rojo"), (4, None, "x"), (5, "red cell", None)],
        "id long, s string, t string",
    )
    terms = spark.createDataFrame([("red cell",), ("nothing here",), (" ",)], "term string")
    got = bilingual.parallel_terms(pairs, terms, id_col="id", source="s", target="t", shorter=0, longer=0, stopwords=["la", "una"], k=3)
    assert rows(got, "term", "translation", "frequency") == [("red cell", "célula roja", 2)]


def test_lists_and_compounds(spark, rows):
    ref = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "sl_term string, tl_term string")
    terms = spark.createDataFrame([("a",), ("q",)], "term string")
    assert rows(bilingual.reference_translations(ref, terms)) == [("a", "x, y"), ("q", None)]
    segs = spark.createDataFrame([(1, "red cell wall and red cell", "k"), (2, None, "k"), (3, "other", "k")], "id long, text string, term string")
    t = spark.createDataFrame([("red cell",), ("red cell wall",)], "term string")
    got = bilingual.compoundify(segs, t, id_col="id", text="text")
    assert rows(got, "id", "text") == [(1, "red▁cell▁wall and red▁cell"), (2, None), (3, "other")]


def test_knn_is_exact(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(120, 8))
    m[7] = m[8]  # a tie
    rows_ = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(500, None), (501, []), (502, [0.0] * 8)]
    df = spark.createDataFrame(rows_, "id long, v array<double>")
    got = vectors.knn_cosine(df.where("id % 50 = 0"), df, id_col="id", vector="v", k=3, block=2, at_once=70)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 50, 100):
        sims = unit @ unit[q]
        want = sorted((i for i in range(120) if i != q), key=lambda i: (-sims[i], i))[:3]
        assert [r.neighbour_id for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == want


def test_mapping_recovers_a_rotation(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(200, 6))
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    mk = lambda m, p: spark.createDataFrame([(f"{p}{i}", [float(x) for x in v]) for i, v in enumerate(m)], "word string, vector array<double>")
    seeds = spark.createDataFrame([(f"s{i}", f"t{i}") for i in range(60)], "sl_term string, tl_term string")
    s, t = vectors.supervised_mapping(mk(a, "s"), mk(a @ q, "t"), seeds)
    sv = {r.word: np.array(r.vector) for r in s.collect()}
    tv = {r.word: np.array(r.vector) for r in t.collect()}
    cos = [sv[f"s{i}"] @ tv[f"t{i}"] / np.linalg.norm(sv[f"s{i}"]) / np.linalg.norm(tv[f"t{i}"]) for i in range(60, 200)]
    assert min(cos) > 0.98
    best = vectors.comparable_translations(mk(a, "s"), mk(a @ q, "t"), seeds, spark.createDataFrame([("s99",), ("zz",)], "term string"), k=1).collect()
    assert [(r.query_id, r.neighbour_id) for r in best] == [("s99", "t99")]


def test_declension_and_upsert(spark, rows):
    df = tagged(spark, ["red|red|ADJ cells|cell|NOUN walls|wall|NOUN", "DNA|dna|NOUN", "Cells|cell|NOUN"])
    assert [r.x for r in df.select(linguistic.normalize_declension(F.col("tagged")).alias("x")).collect()] == ["red cell walls", "DNA", "cell"]
    old = spark.createDataFrame([(1, "a", "k"), (2, "b", "k")], "id long, x string, only string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id long, x string")
    assert rows(linguistic.upsert(old, new, "id"), "id", "x", "only") == [(1, "a", "k"), (2, "B", "k"), (3, "c", None)]


def test_word2vec(spark):
    df = spark.createDataFrame([("a b a b c".split(),), ([],)], "t array<string>")
    got = vectors.train_word2vec(df, "t", size=4)
    assert {r.word for r in got.collect()} == {"a", "b", "c"}
    assert all(len(r.vector) == 4 for r in got.collect())


def test_ngram_terms_of_every_length(spark, rows, tmp_path):
    texts = ["the red cell wall of the red cell", "The cell wall", "a red cell wall of the body", None, "red", "the red cell wall of the"]
    grams = ["red cell", "the red cell", "red cell wall of", "red cell wall of the", "Cell wall", "red", "not there at all", "", " ", None]
    spark.createDataFrame(enumerate(texts), "seg_id long, segment string").write.parquet(f"{tmp_path}/corpus.parquet")
    spark.createDataFrame([(g, len((g or "").split())) for g in grams], "ngram string, n int").write.parquet(f"{tmp_path}/ngrams.parquet")
    terms = [g for g in grams if g and g.strip()]
    want = sorted(((i, g) for i, t in enumerate(texts) if t for g in terms if g in t), key=repr)
    q = queries.queries()
    assert rows(q["segments_with_terms"](spark, str(tmp_path))) == want
    found = {r.term for r in q["parallel_terms"](spark, str(tmp_path)).collect()}
    assert {"red", "red cell", "the red cell"} <= found <= {g for i, g in want if i + 1 < len(texts) and texts[i + 1]}
    joined = dict(rows(q["compoundify"](spark, str(tmp_path))))
    assert joined[2] == "a red▁cell▁wall▁of▁the body" and joined[0].startswith("the▁red▁cell wall") or joined[0].startswith("the red▁cell▁wall▁of▁the")


def test_tables_of_three_and_four_words_by_hand(spark):
    docs = [(1, "a b c d a b c e a x c d".split()), (2, "b c d a b c d".split())]
    df = spark.createDataFrame(docs, "id long, t array<string>")
    flat = [w for _, ws in docs for w in ws]
    for k in (3, 4):
        # each cell counted from its edges, by brute force over the whole stream
        edge = lambda gram, places: sum(all(i + p - places[0] < len(flat) and flat[i + p - places[0]] == gram[p] for p in places) for i in range(len(flat)))  # noqa: E731, B023
        got = {r.candidate: r for r in association.table_measures(df, "id", "t", k).collect()}
        grams = {tuple(flat[i : i + k]) for i in range(len(flat) - k + 1)}
        assert set(got) == {" ".join(g) for g in grams}
        for g in grams:
            parts = [c for n in range(k + 1) for c in itertools.combinations(range(k), n)]
            edges = {c: len(flat) if not c else edge(g, c) for c in parts}
            cells = {c: sum(edges[t] * (-1) ** (len(t) - len(c)) for t in parts if set(c) <= set(t)) for c in parts}
            whole = sum(cells.values())
            chi = 0.0
            for c, o in cells.items():
                e = whole * math.prod(sum(x for t, x in cells.items() if (i in t) == (i in c)) / whole for i in range(k))
                chi += (o - e) ** 2 / e if e > 0 else 0
            assert got[" ".join(g)].chi_sq == pytest.approx(chi)
            assert got[" ".join(g)].jaccard == pytest.approx(cells[tuple(range(k))] / (whole - cells[()]))
