"""Queries of the readers and sinks: whole tables are written in each format, read again and returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.tokens import tokenize
from termloom.operators import annotate, association, linguistic
from termloom.operators import candidates as ops
from termloom.plans import queries as core
from termloom.runtime import scratch, table
from termloom.sources import readers, writers
from termloom.streaming import counts as streams


def _line(c: str) -> Column:
    """A string as one line without control characters."""
    return F.trim(F.regexp_replace(c, r"[\x00-\x1F]+", " "))


def _xml(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _counted(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("times"))


def _lines(df: DataFrame, path: str) -> str:
    df.toDF("value").write.text(path)
    return path


def _document(df: DataFrame, path: str, head: str, tail: str) -> str:
    """One file of the lines of ``df`` within ``head`` and ``tail``."""
    edges = df.sparkSession.createDataFrame([(0, head), (2, tail)], "at int, value string")
    lines = edges.unionByName(df.toDF("value").select(F.lit(1).alias("at"), "value"))
    lines.repartition(1).sortWithinPartitions("at").select("value").write.text(path)
    return path


def corpus(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "corpus")
    segments = table(s, d, "corpus").where("segment is not null").select("seg_id", _line("segment").alias("x"))
    paths = [_lines(segments.where(F.col("seg_id") % 2 == k).select("x"), f"{at}/{k}") for k in (0, 1)]  # two files, both read
    return _counted(readers.corpus(s, paths), "segment")


def word_set(s: SparkSession, d: str) -> DataFrame:
    path = _lines(table(s, d, "candidate_terms").where("measure is not null").select("measure").distinct(), scratch(s, "words"))
    return s.createDataFrame([(w,) for w in sorted(readers.word_set(s, path))], "word string")


def patterns(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "patterns")
    writers.save_patterns(core._learned(s, d).coalesce(1), path)
    return readers.patterns(s, path)


def terms(s: SparkSession, d: str) -> DataFrame:
    path = _lines(table(s, d, "ngrams").where("ngram is not null").select(_line("ngram").alias("x")), scratch(s, "terms"))
    return readers.terms(s, path, nmin=2, nmax=3, distinct=True)


def jsonl(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "jsonl")
    table(s, d, "annotated_dataset").select("segment", "terms").write.json(path)
    return _counted(readers.annotated_jsonl(s, path).select("segment", F.array_join("terms", "|").alias("terms")), "segment", "terms")


def _two(s: SparkSession, d: str) -> DataFrame:
    pairs = core.pairs(s, d).where("segment_sl is not null and segment_tl is not null")
    return pairs.select("seg_id", _line("segment_sl").alias("segment_sl"), _line("segment_tl").alias("segment_tl"))


def moses(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "moses")
    ordered = _two(s, d).orderBy("seg_id")
    for side in ("segment_sl", "segment_tl"):
        ordered.select(side).write.text(f"{at}/{side}")
    return readers.parallel_moses(s, f"{at}/segment_sl", f"{at}/segment_tl")


def tabtxt(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "tab")
    writers.save_parallel(_two(s, d), path)
    return _counted(readers.parallel_tabtxt(s, path), "segment_sl", "segment_tl")


def tmx(s: SparkSession, d: str) -> DataFrame:
    unit = F.concat(
        F.lit('<tu><tuv xml:lang="en"><seg>'), _xml(F.col("segment_sl")), F.lit('</seg></tuv><tuv xml:lang="es"><seg>'), _xml(F.col("segment_tl")), F.lit("</seg></tuv></tu>")
    )
    pairs = _two(s, d).where("segment_sl <> '' and segment_tl <> ''")
    return _counted(readers.parallel_tmx(s, _document(pairs.select(unit), scratch(s, "tmx"), "<tmx><body>", "</body></tmx>"), "en", "es"), "segment_sl", "segment_tl")


def _tagged(s: SparkSession, d: str) -> DataFrame:
    """Tagged segments; these formats have no token with white space in it."""
    got = core.segments(s, d).where(F.size("tokens") > 0).select(linguistic.tag_tokens(F.col("tokens")).alias("tagged"))
    one = lambda t, f: F.regexp_replace(t[f], r"(?U)\s", "_").alias(f)
    return got.select(F.transform("tagged", lambda t: F.struct(one(t, "form"), one(t, "lemma"), t["pos"].alias("pos"))).alias("tagged"))


def tagged(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "tagged")
    writers.save_tagged(_tagged(s, d), path)
    return _counted(readers.tagged_corpus(s, path).select(F.size("tagged").alias("tokens")), "tokens")


def _columns(fmt: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        fields = ("form", "lemma", "pos") if fmt == "freeling" else (None, "form", "lemma", "pos")
        line = lambda t, i: F.concat_ws(" ", *[(i + 1).cast("string") if f is None else t[f] for f in fields])
        block = F.concat(F.array_join(F.transform("tagged", line), "\n"), F.lit("\n"))  # the line break after it makes an empty line
        path = _lines(_tagged(s, d).select(block), scratch(s, fmt))
        return _counted(readers.tagged_corpus(s, path, fmt).select(F.array_join(linguistic.packed(F.col("tagged")), " ").alias("line")), "line")

    return run


def _pairs(s: SparkSession, d: str) -> DataFrame:
    p = core._term_pairs(s, d).select(_line("sl_term").alias("sl_term"), _line("tl_term").alias("tl_term"))
    return p.where("sl_term <> ''")


def pairs_tabtxt(s: SparkSession, d: str) -> DataFrame:
    line = F.when(F.col("tl_term") == "", F.col("sl_term")).otherwise(F.concat_ws("\t", "sl_term", "tl_term"))
    return _counted(readers.term_pairs_tabtxt(s, _lines(_pairs(s, d).select(line), scratch(s, "pairs")), nmin=2, nmax=3), "sl_term", "tl_term")


def pairs_csv(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "csv")
    _pairs(s, d).where("tl_term <> ''").select(F.lit("x").alias("a"), "tl_term", "sl_term").write.csv(path, escape='"', quoteAll=True)
    return _counted(readers.term_pairs_csv(s, path, source_column=3, target_column=2), "sl_term", "tl_term")


def tbx(s: SparkSession, d: str) -> DataFrame:
    section = lambda lang, c: F.concat(F.lit(f'<langSec xml:lang="{lang}"><termSec><term>'), _xml(F.col(c)), F.lit("</term></termSec></langSec>"))
    entry = F.concat(F.lit("<conceptEntry>"), section("en", "sl_term"), F.when(F.col("tl_term") != "", section("es", "tl_term")).otherwise(""), F.lit("</conceptEntry>"))
    return _counted(readers.term_pairs_tbx(s, _document(_pairs(s, d).select(entry), scratch(s, "tbx"), "<tbx><text><body>", "</body></text></tbx>"), "en", "es"), "sl_term", "tl_term")


def validated(s: SparkSession, d: str) -> DataFrame:
    return readers.validated_terms(s, [("red cell", "célula roja"), ("wall", "pared")])


def phrase_table(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "phrases")
    # scores that don't parse are left out by the reader
    score = F.when(F.col("cand_id") % 7 == 0, "x y").otherwise(F.concat_ws(" ", F.lit("0.1 0.2 0.5"), F.col("value").cast("string")))
    rows = core._term_pairs(s, d).where("value is not null").select(F.concat_ws(" ||| ", _line("sl_term"), _line("tl_term"), score))
    rows.write.text(path, compression="gzip")
    return readers.phrase_table(s, path).groupBy("source", "target").agg(F.round(F.max("probability"), 6).alias("probability"))


def embeddings(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "vectors")
    writers.save_embeddings(table(s, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id")).alias("word"), F.col("embedding").alias("vector")), path)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return readers.embeddings(s, path).select("word", F.size("vector").alias("width"), F.round(total, 4).alias("total"))


def candidates_txt(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "candidates")
    writers.save_candidates(core._normal(s, d), path)
    return s.read.schema("candidate string, n int, measure string, value long").csv(f"{path}.txt", sep="\t", header=True)


def term_list(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "list")
    writers.save_term_list(core._normal(s, d), path, limit=200, known=core._ngram_terms(s, d))
    return s.read.text(path).select(F.col("value").alias("line"))


def project(s: SparkSession, d: str) -> DataFrame:
    """Tables of a project: put, kept when put again, rows added where absent, rows deleted."""
    p = writers.Project(s, scratch(s, "project"))
    grams = core._ngram_terms(s, d).withColumn("n", F.size(F.split("term", " ")))
    p.put("terms", grams.where("n <= 2"))
    p.put("terms", grams.limit(0))
    p.add_absent("terms", grams.where("n <= 3"))
    p.delete("terms", grams.where("n = 1").select("term"))
    p.put("empty", grams.limit(0))
    return p.get("terms").withColumn("populated", F.lit(p.populated("terms"))).withColumn("empty", F.lit(not p.populated("empty")))


def export_annotated(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "export")
    items = table(s, d, "annotated_dataset").where("segment is not null").select("segment", "terms")
    has = F.coalesce(F.size("terms"), F.lit(0)) > 0
    writers.save_annotated(items.where(has), items.where(~has), path, most=300)
    out = readers.annotated_jsonl(s, path)
    return out.agg(F.sum((F.coalesce(F.size("terms"), F.lit(0)) > 0).cast("long")).alias("with_terms"), F.sum((F.coalesce(F.size("terms"), F.lit(0)) <= 0).cast("long")).alias("without"))


def by_segment(s: SparkSession, d: str) -> DataFrame:
    return ops.ngrams_by_segment(core.segments(s, d), "doc_id")


def upserted(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "corpus")
    stored = table(s, d, "tokenized_corpus").where("tokenized_segment is not null").select("seg_id", F.col("tokenized_segment").alias("segment"))
    return linguistic.upsert(c.select("seg_id", "segment", "lang"), stored, "seg_id")


def scored(s: SparkSession, d: str) -> DataFrame:
    scores = association.association(core.segments(s, d), "doc_id", "tokens", "dice")
    return core._rounded(ops_scored(core._candidates(s, d), scores), "value")


def ops_scored(found: DataFrame, scores: DataFrame) -> DataFrame:
    return association.scored(found, scores)


def balance(s: SparkSession, d: str) -> DataFrame:
    """How many segments with and without labels a balanced sample has."""
    labelled = core._labelled(s, d).select("labels")
    picked = annotate.balanced(labelled, "labels", size=200, negatives=0.15)
    return picked.agg(F.count("*").alias("segments"))


def aligned(s: SparkSession, d: str) -> DataFrame:
    """Labels of the two halves of every token of the stored tokens, a label for each token by its length."""
    t = table(s, d, "tokenized_corpus").where("tokenized_segment <> ''").select("seg_id", F.split("tokenized_segment", " ").alias("t"))
    labels = F.transform("t", lambda x: F.when(F.length(x) > 6, "B").when(F.length(x) > 3, "I").otherwise("O"))
    ids = F.flatten(F.transform("t", lambda x, i: F.array(i, i)))
    got = t.select("seg_id", labels.alias("labels"), ids.alias("ids")).select(
        "seg_id", annotate.align_labels(F.col("labels"), F.col("ids"), {"O": 0, "B": 1, "I": 2}).alias("x")
    )
    return got.select("seg_id", F.array_join(F.transform("x", lambda v: v.cast("string")), " ").alias("ids"))


def tagged_by_model(s: SparkSession, d: str) -> DataFrame:
    tokens = core.segments(s, d).select("doc_id", "tokens")
    got = linguistic.tag_with(tokens, "tokens", lambda: linguistic.DictionaryTagger({"the": ("the", "DET"), "of": ("of", "ADP"), "de": ("de", "ADP")}))
    return got.select("doc_id", F.size(F.filter("tagged", lambda t: t["pos"].isin("DET", "ADP"))).alias("function_words"), F.size("tagged").alias("tokens"))


def streamed(s: SparkSession, d: str) -> DataFrame:
    """Token counts of the corpus as a stream of its files, at its end."""
    static = table(s, d, "corpus").select("segment")
    source, name = scratch(s, "stream"), f"tokens_{abs(hash(scratch(s, 'q')))}"
    static.write.parquet(source)
    run = streams.streaming_token_frequency(s.readStream.schema("segment string").parquet(source)).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    return s.table(name)


def queries() -> dict:
    return {
        "io_corpus": corpus, "io_word_set": word_set, "io_patterns": patterns, "io_terms": terms, "io_jsonl": jsonl, "io_moses": moses, "io_tabtxt": tabtxt, "io_tmx": tmx,
        "io_tagged": tagged, "io_freeling": _columns("freeling"), "io_conll": _columns("conll"), "io_pairs_tabtxt": pairs_tabtxt, "io_pairs_csv": pairs_csv, "io_tbx": tbx,
        "io_validated": validated, "io_phrase_table": phrase_table, "io_embeddings": embeddings, "io_candidates": candidates_txt, "io_term_list": term_list, "io_project": project,
        "io_export_annotated": export_annotated, "ngrams_by_segment": by_segment, "upsert": upserted, "scored": scored, "balanced": balance, "align_labels": aligned,
        "tag_with_model": tagged_by_model, "stream_tokens": streamed,
    }
