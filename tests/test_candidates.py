import random
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.functions import stopwords as sw
from termloom.functions.tokens import tokenize, words
from termloom.operators import candidates as ops
from termloom.operators import tsr

SCHEMA = "candidate string, n int, measure string, value long"


def table(spark, pairs):
    return spark.createDataFrame([(c, len(c.split()) if c else None, "frequency", v) for c, v in pairs], SCHEMA)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", []),
        ("10\xa0km of (TGF) a/b c:d e@f g|h i+j", ["10\xa0km", "of", "(TGF)", "a/b", "c:d", "e@f", "g|h", "i", "j"]),
        ("² ½ x", ["²", "½", "x"]),
        ("don't e.g. this, that", ["don't", "e.g", "this", "that"]),
        ("  \n\t", []),
    ],
)
def test_tokenize(spark, text, want):
    df = spark.createDataFrame([(text,), (None,)], "t string").select(tokenize(F.col("t")).alias("x"))
    got = [r.x for r in df.collect()]
    assert got == [want, None]


def test_words_split_at_no_break_blanks(spark):
    df = spark.createDataFrame([(" a\xa0b\tc ",)], "t string").select(words(F.col("t")).alias("x"))
    assert df.first().x == ["a", "b", "c"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=7), min_size=1, max_size=5))
def test_ngrams_are_all_windows(spark, segments):
    df = spark.createDataFrame([(s,) for s in segments], "tokens array<string>")
    want = Counter(" ".join(s[i : i + n]) for s in segments for n in (1, 2, 3) for i in range(len(s) - n + 1))
    got = {r.ngram: r.frequency for r in ops.ngram_counts(df, nmin=1, nmax=3, minfreq=1).collect()}
    assert got == dict(want)


def test_ngrams_least_frequency_and_nulls(spark, rows):
    df = spark.createDataFrame([(["a", "b"],), (["a", "b"],), (["b"],), ([],), (None,)], "tokens array<string>")
    assert rows(ops.ngram_counts(df)) == [("a b", 2, 2)]


def test_ngrams_by_segment(spark, rows):
    df = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (2, ["a"]), (3, None)], "id long, tokens array<string>")
    got = ops.ngrams_by_segment(df, "id", nmin=2, nmax=2)
    assert rows(got) == [(1, "a b", 2, 2), (1, "b a", 2, 1)]


def test_empty_tables(spark):
    none = table(spark, [])
    seeds = spark.createDataFrame([], "term string")
    for df in (
        ops.case_normalize(none),
        ops.case_normalize_legacy(none),
        ops.nest_normalize(none),
        ops.nest_normalize_legacy(none),
        ops.regex_exclusion(none, [".+"]),
        ops.select_unigrams(none),
        ops.stopword_filter(none, {"a"}, {"b"}),
        tsr.tsr_filter(none, seeds, "strict"),
        tsr.tsr_filter(none, seeds, "flexible"),
        tsr.tsr_filter(none, seeds, "combined"),
    ):
        assert df.collect() == []


@pytest.mark.parametrize(("nmin", "nmax"), [(1, 1), (1, 4), (2, 3), (3, 3)])
def test_windows_of_odd_arrays(spark, rows, nmin, nmax):
    given = [None, [], ["a"], ["a", "b"], ["a", None, "b"], ["a", "b", "a", "b", "c"], ["a b", "c"], ["a", "b c"], [None, None]]
    df = spark.createDataFrame(list(enumerate(given)), "id int, tokens array<string>")
    want = Counter((" ".join(x for x in w[i : i + n] if x is not None), n) for w in given if w for n in range(nmin, nmax + 1) for i in range(len(w) - n + 1))
    assert rows(ops.ngram_counts(df, nmin=nmin, nmax=nmax, minfreq=1)) == sorted(((*k, v) for k, v in want.items()), key=repr)


def test_texts_are_tokenised_once_for_counts(spark):
    texts = spark.createDataFrame([("a b c",)], "text string").select(tokenize(F.col("text")).alias("tokens"))
    plan = ops.ngram_counts(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_stopwords(spark, rows):
    t = table(spark, [("the cell", 1), ("cell the", 1), ("cell and wall", 1), ("cell of wall", 1), ("Cell Wall", 1), ("x y and", 1), (None, 1)])
    got = ops.stopword_filter(t, {"the"}, {"and"})
    assert rows(got, "candidate") == [("Cell Wall",), ("cell of wall",), ("x y and",)]
    assert ("x y and",) not in rows(ops.stopword_filter(t, {"the"}, {"and"}, legacy=True), "candidate")
    assert len(rows(ops.stopword_filter(t, (), ()))) == 6


def test_case(spark, rows):
    t = table(spark, [("Cell wall", 2), ("cell wall", 3), ("DNA", 4), ("dna", 1), (None, 9)])
    assert rows(ops.case_normalize(t), "candidate", "value") == [("DNA", 4), ("cell wall", 5), ("dna", 1)]
    assert rows(ops.case_normalize_legacy(t), "candidate", "value") == [("cell wall", 5), ("dna", 5)]


def nest_brute(pairs, percent):
    p, out = percent / 100, {}
    for a, fa in pairs:
        aw, v = a.split(), fa
        for b, fb in pairs:
            bw = b.split()
            inside = any(bw[i : i + len(aw)] == aw for i in range(len(bw) - len(aw) + 1))
            if len(bw) > len(aw) and inside and fa * (1 - p) <= fb <= fa * (1 + p):
                v -= fb
        if v > 0:
            out[a] = v
    return out


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.dictionaries(st.lists(st.sampled_from("abc"), min_size=1, max_size=4).map(" ".join), st.integers(1, 12), max_size=12),
    st.sampled_from([0, 10, 50]),
)
def test_nest_against_brute_force(spark, terms, percent):
    pairs = list(terms.items())
    got = {r.candidate: r.value for r in ops.nest_normalize(table(spark, pairs), percent).collect()}
    assert got == nest_brute(pairs, percent)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.lists(st.sampled_from(["a", "ab", "b"]), min_size=1, max_size=3).map(" ".join), st.integers(1, 40), max_size=10))
def test_nest_legacy_against_brute_force(spark, terms):
    pairs = list(terms.items())
    want = {
        a
        for a, fa in pairs
        if not any(len(b.split()) == len(a.split()) + 1 and a in b and fa * 0.9 <= fb <= fa * 1.1 for b, fb in pairs)
    }
    assert {r.candidate for r in ops.nest_normalize_legacy(table(spark, pairs)).collect()} == want


def test_regex_exclusion(spark, rows):
    t = table(spark, [("mental health", 1), ("public mental health", 1), ("health", 1), ("health care\n", 1)])
    assert rows(ops.regex_exclusion(t, [".+ health"]), "candidate") == [("health care\n",), ("health",), ("public mental health",)]
    assert rows(ops.regex_exclusion(t, ["health"], legacy=True), "candidate") == [("mental health",), ("public mental health",)]


def test_unigrams_and_lemmas(spark, rows):
    t = table(spark, [("red cells", 2), ("white cells", 3), ("cell", 1)])
    assert rows(ops.select_unigrams(t), "candidate", "value") == [("cell", 1), ("cells", 5)]
    assert rows(ops.select_unigrams(t, 1), "candidate", "value") == [("cells", 5)]
    lemmas = spark.createDataFrame([("cells", "cell")], "form string, lemma string")
    assert rows(ops.lemmatize(t, lemmas), "candidate", "value") == [("cell", 1), ("red cell", 2), ("white cell", 3)]


def test_extra_columns_and_ties(spark):
    t = table(spark, [("b", 1), ("a", 1)]).withColumn("frequency", F.lit(3)).withColumn("tokens", F.lit("x"))
    assert [r.candidate for r in ops.top(t, 5).collect()] == ["a", "b"]
    assert ops.nest_normalize(t).count() == 2
    assert ops.case_normalize(t).count() == 2


def tsr_brute(cands, seeds, kind):
    slots = {"F": set(), "M": set(), "L": set()}

    def add(t, m=True):
        w = t.lower().split()
        slots["F"].add(w[0])
        slots["L"].add(w[-1])
        if m:
            slots["M"] |= set(w[1:-1])

    for s in seeds:
        add(s)
    parts = {c: c.lower().split() for c in cands}
    middle = lambda w: len(w) > 2 and all(x in slots["M"] for x in w[1:-1])
    strict = lambda w: w[0] in slots["F"] and w[-1] in slots["L"] and (len(w) <= 2 or middle(w))
    if kind == "strict":
        return {c for c, w in parts.items() if strict(w)}
    if kind == "combined":
        first = [c for c, w in parts.items() if strict(w)]
        if not first:
            return set()
        for c in first:
            add(c)
    while True:
        got = {c for c, w in parts.items() if w[0] in slots["F"] or w[-1] in slots["L"] or middle(w)}
        before = {k: set(v) for k, v in slots.items()}
        for c in got:
            add(c, kind == "combined")
        if before == slots:
            return got


@pytest.mark.parametrize("kind", ["strict", "flexible", "combined"])
@pytest.mark.parametrize("seeds", [["mental health"], ["acute heart failure", "pain"], ["zebra"]])
def test_tsr_against_brute_force(spark, kind, seeds):
    cands = ["mental disorder", "acute disorder", "acute heart pain", "heart failure", "chronic heart failure", "Mental Health", "other thing", "pain relief", "a b c d"]
    df = table(spark, [(c, 1) for c in cands] + [(None, 1)])
    got = tsr.tsr_filter(df, spark.createDataFrame([(s,) for s in seeds] + [(None,)], "term string"), kind)
    assert {r.candidate for r in got.collect()} == tsr_brute(cands, seeds, kind)
    assert got.columns == df.columns


@pytest.mark.parametrize("kind", ["flexible", "combined"])
def test_tsr_passes_grow_with_the_logarithm_of_a_chain(spark, monkeypatch, kind):
    cands = [f"a{k} b{k}" for k in range(40)] + [f"a{k + 1} b{k}" for k in range(39)] + ["far off"]
    made = []
    monkeypatch.setattr(tsr, "checkpointed", lambda df, real=tsr.checkpointed: made.append(1) or real(df))
    got = tsr.tsr_filter(table(spark, [(c, 1) for c in cands]), spark.createDataFrame([("a0 b0",)], "term string"), kind)
    assert {r.candidate for r in got.collect()} == tsr_brute(cands, ["a0 b0"], kind) == {*cands} - {"far off"}
    assert len(made) < 20


@pytest.mark.parametrize("kind", ["flexible", "combined"])
@pytest.mark.parametrize("seed", range(4))
def test_tsr_of_long_terms_against_brute_force(spark, kind, seed):
    r = random.Random(seed)
    cands = sorted({" ".join(r.choice("abcdefghij") + str(r.randrange(9)) for _ in range(r.choice([1, 2, 3, 4, 4, 5]))) for _ in range(60)})
    seeds = [*r.sample([c for c in cands if len(c.split()) > 2], 2), "a0 b0 c0"]
    got = tsr.tsr_filter(table(spark, [(c, 1) for c in cands]), spark.createDataFrame([(s,) for s in seeds], "term string"), kind)
    assert {r.candidate for r in got.collect()} == tsr_brute(cands, seeds, kind)


def test_tsr_unknown_kind(spark):
    with pytest.raises(ValueError, match="none of"):
        tsr.tsr_filter(table(spark, []), spark.createDataFrame([], "term string"), "loose")


def test_languages():
    assert sw.language_code("English") == sw.language_code("eng") == "en"
    with pytest.raises(ValueError, match="no resources"):
        sw.outer("de")
    assert all(re.fullmatch(r"\S+", w) for w in sw.all_outer() | sw.all_inner())
