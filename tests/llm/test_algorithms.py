"""Problems 1, 2, 3, 4 and 6: brute force on small data, and the odd cases of every operator."""

import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.llm.text import fold_words
from termloom.llm import chunking, cosine_join, lossy, merkle, trie_count

QUICK = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


# 1
def test_fold_words():
    assert fold_words("Ünï-CÓDE ﬁx² x_y ½") == ["uni", "code", "fix2", "x", "y", "1", "2"]
    assert fold_words(None) == fold_words("") == fold_words(" . ") == []


def agree_brute(items):
    bags = [(i, (s or "").strip().lower(), Counter(fold_words(t))) for i, s, t in items]
    out = set()
    for i, s, a in bags:
        for j, s2, b in bags:
            if s == "train" and s2 in ("dev", "test") and a and b:
                longer = max(sum(a.values()), sum(b.values()))
                if 5 * sum((a & b).values()) >= 4 * longer:
                    out.add((min(i, j), max(i, j)))
    return out


def test_cross_split_pairs_against_brute_force(spark):
    rng = random.Random(7)
    base = [[rng.choice("abcdefghijklmnop") for _ in range(rng.choice([1, 2, 5, 6, 10, 20]))] for _ in range(25)]
    items = []
    for i in range(220):
        w = list(rng.choice(base))
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = rng.choice("abcxyz")
        if rng.random() < 0.3:
            rng.shuffle(w)
        items.append((i, rng.choice(["train", " Train", "TRAIN", "dev", "Test ", None, "other"]), " ".join(w)))
    items += [(900, "train", None), (901, "dev", ""), (902, "dev", " \xa0"), (903, "test", "?!")]
    items += [(i, "train" if i % 2 else "dev", "the very same hot text") for i in range(1000, 1060)]
    df = spark.createDataFrame([(*x, 1, "t") for x in items], "id long, split string, segment string, n int, terms string")
    got = cosine_join.cross_split_pairs(df, id_col="id", split="split", segment="segment", hot_class=7)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == agree_brute(items)
    report = cosine_join.overlap_report(df, id_col="id", split="split", segment="segment", source="terms")
    held = {j for pair in agree_brute(items) for j in pair if dict((a, (b or "").strip().lower()) for a, b, _ in items)[j] != "train"}
    assert sum(r.overlapping for r in report.collect()) == len(held)


@pytest.mark.parametrize("hot_list,most_refined", [(2, 128), (2, 12), (10_000, 128)])
def test_lists_by_two_words_miss_no_pair(spark, hot_list, most_refined):
    rng = random.Random(hot_list + most_refined)
    words = [f"w{i}" for i in range(12)]
    bags = []
    for _ in range(40):
        w = rng.choices(words, weights=range(1, 13), k=rng.choice([1, 2, 4, 9, 11, 13, 15, 30]))
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = rng.choice(words)
            bags.append(Counter(v))
    bags.append(Counter({"w1": 40, "x": 1}))
    bags.append(Counter({"w1": 41}))
    bags = list({tuple(sorted(b.items())): b for b in bags}.values())
    rows = [(i, sorted(b), [(b[w] / sum(b.values())) ** 0.5 for w in sorted(b)], sum(b.values())) for i, b in enumerate(bags)]
    df = spark.createDataFrame(rows, "id long, terms array<string>, weights array<double>, size int")
    a, b = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    got = cosine_join.weighted_cosine_join(a, b, 0.8, shared=True, hot_list=hot_list, most_refined=most_refined, cell=5).collect()
    want = {}
    for i, x in enumerate(bags):
        for j, y in enumerate(bags):
            n = sum((x & y).values())
            if i % 2 == 0 and j % 2 == 1 and 5 * n >= 4 * max(sum(x.values()), sum(y.values())):
                want[i, j] = n
    assert {(r.id_a, r.id_b): r.shared for r in got} == want and len(got) == len(want) > 20
    for r in got:
        x, y = bags[r.id_a], bags[r.id_b]
        cosine = sum((x[w] * y[w]) ** 0.5 for w in x) / (sum(x.values()) * sum(y.values())) ** 0.5
        assert abs(r.cosine - cosine) < 1e-9


def test_cross_split_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "id long, split string, segment string")
    assert cosine_join.cross_split_pairs(df, id_col="id", split="split", segment="segment").collect() == []


def test_weighted_join_against_brute_force(spark):
    rng = random.Random(1)

    def vectors(k, start):
        out = []
        for i in range(k):
            terms = rng.sample("abcdefghij", rng.randint(1, 6))
            w = [rng.random() + 0.05 for _ in terms]
            norm = sum(x * x for x in w) ** 0.5
            out.append((start + i, terms, [x / norm for x in w]))
        return [*out, (start + 500, [], [])]

    a, b = vectors(60, 0), vectors(60, 1000)
    schema = "id long, terms array<string>, weights array<double>"
    got = cosine_join.weighted_cosine_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 0.6, cell=3)
    want = {}
    for i, t, w in a:
        for j, u, v in b:
            d = dict(zip(u, v, strict=True))
            if (c := sum(x * d.get(k, 0) for k, x in zip(t, w, strict=True))) >= 0.6:
                want[i, j] = c
    res = {(r.id_a, r.id_b): r.cosine for r in got.collect()}
    assert set(res) == set(want)
    assert all(res[k] == pytest.approx(want[k]) for k in want)


# 2
RECORD = {"by": ["tbl"], "id_col": "id", "columns": ["candidate", "measure", "value"], "rules": {"measure": lambda c, kind: c}}


def test_copies(spark, rows):
    data = [
        (1, "Red-Cell", "m", 3.0), (2, "red cell", "m", 3.0), (3, "re­dcell_", "m", 3.0), (4, "red cell", "M", 3.0),
        (5, "red cell", "m", 3.5), (6, "réd cell", "m", 3.0), (7, "réd CELL", "m", 3.0), (8, None, "m", 3.0), (9, None, "m", 3.0),
        (10, "zero", None, 0.0), (11, "ZERO", None, -0.0), (12, "straße", "m", 1.0), (13, "STRASSE", "m", 1.0),
    ]
    df = spark.createDataFrame([("t", *r, "x") for r in data], "tbl string, id long, candidate string, measure string, value double, digest string")
    assert rows(merkle.copies(df, **RECORD)) == [("t", 1, 2), ("t", 1, 3), ("t", 10, 11), ("t", 12, 13), ("t", 6, 7), ("t", 8, 9)]
    classes = merkle.copy_classes(df, **RECORD)
    assert classes.agg(F.sum("copies")).first()[0] == len(data)
    assert merkle.copies(df.limit(0), **RECORD).collect() == []


def test_nested_digests(spark):
    schema = "id long, r struct<a: string, tags: array<string>, m: map<string, int>, n: struct<x: int, y: string>>"
    df = spark.createDataFrame(
        [
            (1, ("A b", ["x", "y"], {"k": 1, "l": 2}, (1, "q"))),
            (2, ("a-B", ["Y", "X"], {"l": 2, "k": 1}, (1, "Q!"))),
            (3, ("a-B", ["Y", "X"], {"l": 2, "k": 1}, (2, "Q!"))),
            (4, None),
            (5, (None, None, None, None)),
        ],
        schema,
    )
    both = lambda **o: {r.id: (r.d, r.f) for r in df.select("id", merkle.root_digest(df, ["r"], **o).alias("d"), merkle.canonical_form(df, ["r"], **o).alias("f")).collect()}
    loose, strict = both(unordered={"r.tags"}), both()
    assert loose[1] == loose[2] != loose[3]
    assert strict[1] != strict[2]
    assert len({v for v in loose.values()}) == 4
    assert loose[4] != loose[5]


def test_parsed_records(spark):
    texts = [
        '{"value": "3.50", "candidate": "a", "n": 2, "measure": "m"}', "measure=m | value=35e-1|candidate=a ", '{"candidate": "a", "measure": "m"',
        '{"candidate": "a", "value": 1}', "measure=m|value=1", "", None, '#{"candidate": "a", "measure": "m", "value": 1}', "candidate=a|measure=m|value=x",
        '{"candidate": "\\u00e9", "measure": "m", "value": 1} trailing',
    ]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "id long, record string, candidate string")
    got = {r.id: (r.candidate, r.measure, r.value) for r in merkle.parsed_records(df, "record").collect()}
    assert got[0] == ("a", "m", 3.5)
    assert got[1] == ("a ", "m", 3.5)
    assert all(got[i] == (None, None, None) for i in range(2, len(texts)))


# 3
@QUICK
@given(st.text(alphabet="ab .,\n。", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_cuts(text, limit, overlap):
    cuts = chunking.plan_cuts(len(text), chunking.text_boundaries(text), limit, overlap, text)
    assert cuts[0][0] == 0
    assert cuts[-1][1] == len(text)
    for a, b in cuts:
        assert b - a <= limit
    for (a, b), (c, d) in zip(cuts, cuts[1:], strict=False):
        assert a < b < d
        assert b - overlap <= c <= b
    whole = text[: cuts[0][1]] + "".join(text[cuts[i - 1][1] : cuts[i][1]] for i in range(1, len(cuts)))
    assert whole == text
    least = 1 if len(text) <= limit else 1 + -(-(len(text) - limit) // (limit - overlap))
    assert len(cuts) >= least


def test_cuts_are_at_the_strongest_boundary():
    text = "word " * 18 + "end. " + "word " * 16
    cuts = chunking.plan_cuts(len(text), chunking.text_boundaries(text), 100, 0, text)
    assert text[: cuts[0][1]].endswith("end. ")
    assert len(chunking.plan_cuts(5000, {}, 1000, 100)) == 6


def test_pieces(spark, rows):
    long = "x" * 2500
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "short", 9), (4, long, 9), (5, "😀" * 1001, 9)], "id long, text string, piece int")
    got = chunking.split_texts(df, id_col="id", text="text").collect()
    per = defaultdict(list)
    for r in got:
        per[r.id].append(r)
    assert sorted(per) == [2, 3, 4, 5]
    assert (per[2][0].text, per[2][0].end) == ("", 0)
    assert "".join(r.text[r.repeated :] for r in sorted(per[4], key=lambda r: r.piece)) == long
    assert all(len(r.text) <= 1000 and r.repeated <= 100 for r in got)
    assert len(per[5]) == 2
    tok = spark.createDataFrame([(1, " ".join(["a\xa0b"] * 161)), (2, " ".join(["c"] * 160)), (3, ""), (4, None)], "id long, t string")
    t = chunking.split_tokens(tok, id_col="id", tokens="t").collect()
    assert Counter(r.id for r in t) == {1: 2, 2: 1, 3: 1}
    assert all(len(r.text.split(" ")) <= 160 for r in t)
    assert chunking.split_texts(df.limit(0), id_col="id", text="text").collect() == []


# 4
@QUICK
@given(st.lists(st.tuples(st.text(alphabet="ab", min_size=1, max_size=5), st.integers(0, 5)), max_size=60), st.integers(1, 4))
def test_burst_trie(pairs, burst):
    trie = trie_count.BurstTrie(frozenset({"a", "ab"}), burst)
    want = defaultdict(lambda: [0, 0])
    for t, n in pairs:
        trie.add(t, n, 1)
        want[t][0] += n
        want[t][1] += 1
    got = list(trie.drain())
    assert {t: [o, r] for _, t, o, r in got} == dict(want)
    assert len(got) == len(want)
    for route, term, _, _ in got:
        assert term.startswith(route)
        assert route not in {"a", "ab"} or route == term
    assert trie.size == 0


TERMS = "tbl string, row_id long, batch_id long, term string, frequency long, n int"


def test_term_counts_against_brute_force(spark):
    rng = random.Random(4)
    data = [("t", i, rng.randrange(20), rng.choice(["a", "ab", "abc", "b", "B", "çx", "hot", "hot", "hot"]), rng.choice([1, 2, None])) for i in range(500)]
    data += data[:40] + [("u", 1, 1, None, 3), ("u", 2, 1, "", 3), ("u", 3, None, "x", 3), ("u", 4, 1, "x", 2)]
    df = spark.createDataFrame([(*r, 1) for r in data], TERMS)
    total, batches = Counter(), defaultdict(set)
    for t, _, b, w, f in set(data):
        if w and f is not None:
            total[t, w] += f
            batches[t, w] |= {b} - {None}
    for options in ({}, {"fan_out": 3, "burst": 1, "max_terms": 2}):
        got = {(r.tbl, r.term): (r.occurrences, r.records) for r in trie_count.term_counts(df, **options).collect()}
        assert got == {k: (total[k], len(batches[k])) for k in total}
    marks = {(r.tbl, r.term): r.mark for r in trie_count.marked_terms(df).collect()}
    assert marks["u", "x"] == "rare"
    assert marks["t", "hot"] == "common"
    assert trie_count.marked_terms(df.limit(0)).collect() == []


# 6
@QUICK
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.integers(0, 9)), max_size=80), st.integers(1, 30))
def test_lossy_counter_guarantee(pairs, width):
    c = lossy.LossyCounter(width)
    true = Counter()
    for i in range(0, len(pairs), 7):
        c.add_all(iter(pairs[i : i + 7]))
        for k, n in pairs[i : i + 7]:
            true[k] += n
    for k, n in true.items():
        low, under = c.entries.get(k, [0, c.bucket])
        assert low <= n <= low + under
    assert c.bucket <= sum(true.values()) / width


def test_heavy_items(spark):
    rng = random.Random(2)
    data = [(i, rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3), rng.randint(0, 50)) for i in range(3000)]
    data += data[:300] + [(9001, None, 5), (9002, "", 5), (9003, "a", None), (9004, "a", -1)]
    df = spark.createDataFrame([(*r, "x") for r in data], "row_id long, ngram string, frequency long, total string").repartition(6)
    true = Counter()
    for _, g, f in set(data):
        if g and f is not None and f >= 0:
            true[g] += f
    want = sorted(true.items(), key=lambda x: (-x[1], x[0]))[:10]
    for eps in (1e-6, 0.01, 0.2):  # the last can't separate the tenth at first
        got = lossy.heavy_items(df, item="ngram", weight="frequency", row_id="row_id", k=10, epsilon=eps).orderBy("rank").collect()
        assert [(r.item, r.total) for r in got] == want
        assert all(r.low <= r.total <= r.high for r in got)
    assert lossy.heavy_items(df.limit(0), item="ngram", weight="frequency", row_id="row_id").collect() == []
    few = lossy.heavy_items(df.where("ngram = 'a'"), item="ngram", weight="frequency", row_id="row_id").collect()
    assert [(r.item, r.total) for r in few] == [("a", true["a"])]


def test_lossy_summary_of_an_empty_partition():
    assert sum(b.num_rows for b in lossy._summarise(10)(iter([]))) == 1
    empty = pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.int64())], names=["item", "weight"])
    assert sum(b.num_rows for b in lossy._summarise(10)(iter([empty]))) == 1


def test_routes_burst_as_deep_as_terms_are_alike(spark):
    terms = [f"https://example.org/a/b/{c}{d}" for c in "xyz" for d in "1234"] * 3 + ["the hot term of all"] * 40 + ["q"]
    df = spark.createDataFrame([("t", x) for x in terms], "tbl string, term string")
    nodes = trie_count.routing_nodes(df, 5)["t"]
    assert "https://example.org/a/b/" in nodes and "https://example.org/a/b/x" not in nodes
    assert not any(n.startswith("the") for n in nodes)  # a single term needs no node below it
    rows = spark.createDataFrame([("t", i, i % 5, x, 2) for i, x in enumerate(terms)], "tbl string, row_id long, batch_id long, term string, frequency long")
    got = {r.term: (r.occurrences, r.records) for r in trie_count.term_counts(rows, fan_out=8).collect()}
    assert got == {x: (2 * terms.count(x), len({i % 5 for i, y in enumerate(terms) if x == y})) for x in set(terms)}
    assert trie_count.term_counts(rows.limit(0)).collect() == []


def test_heavy_items_of_a_flat_head(spark):
    df = spark.createDataFrame([(i, f"w{i % 400:03}", 1) for i in range(4000)], "row_id long, ngram string, frequency long")
    got = lossy.heavy_items(df, item="ngram", weight="frequency", row_id="row_id", k=3, epsilon=0.1, least_epsilon=0.05).orderBy("rank").collect()
    assert [(r.item, r.low, r.high, r.total) for r in got] == [(f"w{i:03}", 10, 10, 10) for i in range(3)]


def test_spellings_within_arrays_and_maps(spark):
    schema = "id long, tbl string, tags array<string>, m map<string,array<string>>"
    nfc, nfd = "café", "café"
    data = [(1, "t", [nfc, "B"], {"k": [nfc]}), (2, "t", [nfd, "b"], {"K": [nfd]}), (3, "t", ["cafe", "b"], {"k": [nfc]}), (4, "t", None, None), (5, "t", [None], {})]
    df = spark.createDataFrame(data, schema)
    got = merkle.copies(df, by=["tbl"], id_col="id", columns=["tags", "m"]).collect()
    assert [tuple(r) for r in got] == [("t", 1, 2)]


def test_deep_forms_stay_short(spark):
    df = spark.createDataFrame([(1, "abc")], "id long, x string")
    for _ in range(12):
        df = df.select("id", F.struct("x").alias("x"))
    assert df.select(F.length(merkle.canonical_form(df, ["x"])).alias("n")).first().n < 200
