import gzip
import sqlite3

import pytest
from pyspark.sql import functions as F

from termloom.plans.extractor import Extractor
from termloom.sources import readers, writers
from termloom.streaming import counts


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_line_readers(spark, rows, tmp_path):
    a = write(tmp_path / "a.txt", "one two \n\nthree\xa0\n")
    assert rows(readers.corpus(spark, a), "segment") == [("",), ("one two",), ("three",)]
    assert readers.corpus(spark, [a, a]).count() == 6
    assert rows(readers.terms(spark, a, nmin=2)) == [("one two",)]
    assert rows(readers.terms(spark, ["x", "x", " "], is_file=False, distinct=True)) == [("x",)]
    assert readers.word_set(spark, a) == {"one two", "three"}
    p = write(tmp_path / "p.txt", "pattern\tfrequency\n|#|NOUN\t3\n#||ADJ |#|NOUN\n")
    assert rows(readers.patterns(spark, p)) == [("#||ADJ |#|NOUN", None), ("|#|NOUN", 3)]
    assert "." in readers.stopwords("en", punctuation=True)[0]
    assert readers.stopword_table(spark).where("lang = 'en' and kind = 'inner'").count() == 12


def test_jsonl(spark, rows, tmp_path):
    p = write(tmp_path / "d.jsonl", '{"segment": "a b", "terms": ["a"]}\n{"segment": null}\nbroken\n')
    assert rows(readers.annotated_jsonl(spark, p)) == [("a b", ["a"]), (None, None), (None, None)]


def test_parallel(spark, rows, tmp_path):
    s, t = write(tmp_path / "s", "a\nb\n"), write(tmp_path / "t", "x\ny\n")
    assert rows(readers.parallel_moses(spark, s, t), "segment_sl", "segment_tl") == [("a", "x"), ("b", "y")]
    tab = write(tmp_path / "tab", "a\tx\nb\nc\tz\tmore\n")
    assert rows(readers.parallel_tabtxt(spark, tab, reverse=True)) == [("x", "a"), ("z", "c")]
    tmx = write(
        tmp_path / "m.tmx",
        '<?xml version="1.0"?><tmx><body>'
        '<tu><tuv xml:lang="en-GB"><seg>one</seg></tuv><tuv xml:lang="es"><seg>uno</seg></tuv></tu>'
        '<tu><tuv xml:lang="en"><seg>two</seg></tuv><tuv xml:lang="es"><seg>dos</seg></tuv></tu>'
        '<tu><tuv xml:lang="en"><seg>only</seg></tuv></tu></body></tmx>',
    )
    assert rows(readers.parallel_tmx(spark, tmx, "en", "es")) == [("one", "uno"), ("two", "dos")]
    db = tmp_path / "m.sdltm"
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE translation_units (source_segment TEXT, target_segment TEXT)")
        c.execute("INSERT INTO translation_units VALUES ('<S><Value>a\nb</Value></S>', '<S><Value>x</Value></S>'), ('<S/>', '<S/>')")
    assert rows(readers.parallel_sdltm(spark, str(db))) == [("a b", "x")]


def test_tagged(spark, tmp_path):
    flat = lambda df: sorted([[tuple(t) for t in r.tagged] for r in df.collect()])
    want = [[("a", "a", "X"), ("b", "b", "Y")], [("c", "c", "Z")]]
    assert flat(readers.tagged_corpus(spark, write(tmp_path / "1", "a|a|X b|b|Y\n\nc|c|Z\n"))) == want
    assert flat(readers.tagged_corpus(spark, write(tmp_path / "2", "a a X 1\nb b Y 1\n\nc c Z 1"), "freeling")) == want
    assert flat(readers.tagged_corpus(spark, write(tmp_path / "3", "1\ta\ta\tX\n2\tb\tb\tY\n\n1\tc\tc\tZ\n\n"), "conll")) == want


def test_term_pairs(spark, rows, tmp_path):
    tab = write(tmp_path / "t", "a b\tx\nc\n a b c d\ty\n")
    assert rows(readers.term_pairs_tabtxt(spark, tab, nmax=3)) == [("a b", "x"), ("c", "_")]
    csv = write(tmp_path / "c.csv", "1,a,x\n2,b,y\n")
    assert rows(readers.term_pairs_csv(spark, csv, source_column=2, target_column=3)) == [("a", "x"), ("b", "y")]
    tbx = write(
        tmp_path / "t.tbx",
        '<?xml version="1.0"?><tbx><text><body><conceptEntry><langSec xml:lang="en"><termSec><term>cell</term></termSec>'
        '<termSec><term>small cell</term></termSec></langSec><langSec xml:lang="es"><termSec><term>célula</term></termSec></langSec></conceptEntry>'
        '<conceptEntry><langSec xml:lang="en"><termSec><term>wall</term></termSec></langSec></conceptEntry></body></text></tbx>',
    )
    assert rows(readers.term_pairs_tbx(spark, tbx, "en", "es")) == [("cell", "célula"), ("small cell", "célula"), ("wall", "_")]


def test_phrase_table_and_embeddings(spark, rows, tmp_path):
    gz = tmp_path / "pt.gz"
    with gzip.open(gz, "wt") as f:
        f.write("a b ||| x ||| 0.1 0.2 0.5 0.5\n, a ||| x ||| 1 1 1 1\nc ||| y ||| bad\n")
    assert rows(readers.phrase_table(spark, str(gz))) == [("a b", "x", 0.25)]
    emb = readers.embeddings(spark, write(tmp_path / "e", "2 2\na 1 2.5\nb 0 -1\n"))
    assert rows(emb, "word") == [("a",), ("b",)]
    writers.save_embeddings(emb, str(tmp_path / "out"))
    assert rows(readers.embeddings(spark, str(tmp_path / "out"))) == rows(emb)


def test_sinks(spark, rows, tmp_path):
    c = spark.createDataFrame([("b", 1, "f", 1), ("a", 1, "f", 2)], "candidate string, n int, measure string, value long")
    writers.save_candidates(c, str(tmp_path / "o"))
    assert spark.read.csv(str(tmp_path / "o.txt"), sep="\t", header=True).count() == 2
    writers.save_candidates(c, str(tmp_path / "o.csv"), only_candidates=True)
    assert spark.read.csv(str(tmp_path / "o.csv"), header=True).columns == ["candidate"]
    with pytest.raises(ValueError, match="unknown kind"):
        writers.save_candidates(c, str(tmp_path / "o.doc"))
    known = spark.createDataFrame([("a",)], "term string")
    writers.save_term_list(c, str(tmp_path / "l"), limit=1, known=known)
    assert spark.read.text(str(tmp_path / "l")).count() == 0  # the limit comes before the exclusion


def test_project(spark, rows, tmp_path):
    p = writers.Project(spark, str(tmp_path / "p"))
    t = spark.createDataFrame([("a",), ("b",)], "term string")
    p.put("terms", t)
    p.put("terms", t.limit(0))  # kept
    assert p.populated("terms")
    assert rows(p.add_absent("terms", spark.createDataFrame([("b",), ("c",)], "term string"))) == [("a",), ("b",), ("c",)]
    p.delete("terms", spark.createDataFrame([("a",)], "term string"))
    assert rows(p.get("terms")) == [("b",), ("c",)]
    p.delete("terms")
    assert not p.populated("terms")


def test_extractor_chain(spark, rows):
    text = ["The red cell wall of the red cell.", "A red cell wall grows.", None, "", "Red Cell walls"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(text)], "seg_id long, segment string, tokens string")
    ex = Extractor(df, language="en").add_stopwords(["grows"]).add_inner_stopwords(["of"])
    got = ex.statistical(case_normalization=True, minfreq=1)
    assert ("red cell", 4) in rows(got.terms(None), "candidate", "value")
    assert [r.token for r in got.tokens(2).collect()] == ["cell", "red"]
    assert got.nest_normalization(50).regex_exclusion(["red .+"]).terms(None).count() > 0
    seeds = spark.createDataFrame([("red wall",)], "term string")
    assert ("red cell",) in rows(got.tsr_filter(seeds, "flexible").terms(None), "candidate")
    learned = ex.linguistic(evaluation_terms=spark.createDataFrame([("red cell",)], "term string"), minfreq=1)
    assert learned.terms(None).count() > 0
    with pytest.raises(ValueError, match="no pattern"):
        ex.linguistic(evaluation_terms=seeds, minfreq=1)
    with pytest.raises(ValueError, match="give patterns"):
        ex.linguistic()


def test_streams(spark, rows, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a b", "2020-01-01 00:10:00"), ("b", "2020-01-01 05:00:00")], "segment string, at string").select(
        "segment", F.to_timestamp("at").alias("at")
    ).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("segment string, at timestamp").parquet(str(src))
    for name, df in (("tok", counts.streaming_token_frequency(stream)), ("ng", counts.streaming_ngrams(stream)), ("win", counts.windowed_token_frequency(stream, "at"))):
        q = df.writeStream.outputMode("complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert rows(spark.table("tok")) == [("a", 1), ("b", 2)]
    assert rows(spark.table("ng")) == [("a b", 2, 1)]
    assert spark.table("win").count() == 3


def test_more_learned_patterns_than_a_thousand(spark):
    from termloom.operators import linguistic

    tag = lambda i: "T" + "".join(chr(97 + int(c)) for c in str(i))
    rows = [([(f"w{i}", f"w{i}", tag(i)), (f"v{i}", f"u{i}", tag(i + 7))],) for i in range(1300) for _ in range(2)]
    tagged = spark.createDataFrame(rows, "tagged array<struct<form string, lemma string, pos string>>")
    terms = spark.createDataFrame([(f"w{i} v{i}",) for i in range(1300)], "term string")
    ex = Extractor(spark.createDataFrame([], "segment string"))
    got = {r.candidate for r in ex.linguistic(evaluation_terms=terms, tagged=tagged).candidates.collect()}
    assert got == {f"w{i} v{i}" for i in range(1300)}
    few, ngrams = terms.limit(20), linguistic.tagged_ngrams(tagged)
    learned = linguistic.learn_patterns(ngrams, few)
    patterns = [r.pattern for r in learned.orderBy(F.desc("frequency"), "pattern").collect()]
    by_regex = linguistic.match_patterns(ngrams, patterns).collect()
    assert sorted(linguistic.match_learned(ngrams, learned).collect()) == sorted(by_regex) and len(by_regex) == 20
