"""Queries of the core operators over the tables of TESTDATA.md.

Segments are the documents' texts, reference terms those of the annotated dataset,
parallel pairs the corpus' segments with the next id. Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import stopwords as sw
from termloom.functions.tokens import tokenize, words
from termloom.operators import annotate, association, bilingual, evaluation, linguistic, tsr, vectors
from termloom.operators import candidates as ops
from termloom.plans.extractor import Extractor
from termloom.runtime import checkpointed, table

Query = Callable[[SparkSession, str], DataFrame]

REGEXES = [".+ (corpus|lemma)", "(de|of) .+", ".+ [0-9]+ .+"]
PATTERNS = ["#||ADJ |#|NOUN", "|#|ADJ |#|NOUN", "|#|NOUN |#|NOUN", "#||NOUN .*|#|.* #||NOUN"]
K = 10


def segments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return docs.select("doc_id", tokenize(F.col("text")).alias("tokens"))


def reference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "annotated_dataset").select(F.explode("terms").alias("term")).where("trim(term) <> ''").distinct()


def pairs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "corpus")
    a = c.select("seg_id", F.col("segment").alias("segment_sl"))
    return a.join(c.select((F.col("seg_id") - 1).alias("seg_id"), F.col("segment").alias("segment_tl")), "seg_id")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    found = ops.as_candidates(ops.ngram_counts(segments(spark, d)))
    return ops.stopword_filter(found, sw.all_outer(), sw.all_inner())


def _normal(spark: SparkSession, d: str) -> DataFrame:
    return ops.case_normalize(_candidates(spark, d))


def _tagged_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return linguistic.tagged_ngrams(segments(spark, d).select(linguistic.tag_tokens(F.col("tokens")).alias("tagged")))


def _learned(spark: SparkSession, d: str) -> DataFrame:
    # terms by which patterns are learned: the n-gram table's
    return linguistic.learn_patterns(_tagged_ngrams(spark, d), table(spark, d, "ngrams").select("ngram").where("ngram <> ''").distinct(), "ngram")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Candidate terms of the English documents: tokens, n-grams, stopwords, case, best first."""
    english = table(spark, d, "documents").where(F.lower(F.trim("lang")).isin("en", *sw.NAMES["en"]))
    return Extractor(english, text="text", language="en").statistical(case_normalization=True).terms(None)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 4) for n in names})


def _association(measure: str, k: int = 2) -> Query:
    return lambda s, d: _rounded(association.association(segments(s, d), "doc_id", "tokens", measure, k=k), "value")


def _chi_sq(k: int) -> Query:
    """Doubles hold no four decimals of the largest values."""

    def run(s: SparkSession, d: str) -> DataFrame:
        found = association.association(segments(s, d), "doc_id", "tokens", "chi_sq", k=k)
        return found.withColumn("value", F.when(F.col("value") < 1e6, F.round("value", 4)).otherwise(F.round("value", 0)))

    return run


def _tsr(kind: str) -> Query:
    return lambda s, d: tsr.tsr_filter(checkpointed(_normal(s, d)), reference(s, d), kind)


def _labelled(s: SparkSession, d: str) -> DataFrame:
    udf = annotate.label_terms("BIO", sw.all_outer())
    items = table(s, d, "annotated_dataset").where("segment is not null")
    return items.select("item_id", tokenize(F.col("segment")).alias("tokens"), "terms").withColumn("labels", udf("tokens", "terms"))


def _metrics(as_sets: bool) -> Query:
    """Terms that longest-first annotation finds in each segment, against those listed there."""

    def run(s: SparkSession, d: str) -> DataFrame:
        items = table(s, d, "annotated_dataset").where("segment is not null")
        found = _labelled(s, d).select("item_id", F.transform(annotate.bio_terms(F.col("tokens"), F.col("labels")), F.lower).alias("terms"))
        true = items.select("item_id", F.transform("terms", F.lower).alias("terms"))
        return _rounded(evaluation.term_metrics(found, true, id_col="item_id", terms="terms", as_sets=as_sets), "precision", "recall", "f1")

    return run


def _split_metrics(s: SparkSession, d: str) -> DataFrame:
    """The stored tokens against those of the tokenizer, per segment, as multisets."""
    own = table(s, d, "corpus").where("segment is not null").select("seg_id", tokenize(F.col("segment")).alias("t"))
    kept = table(s, d, "tokenized_corpus").where("tokenized_segment <> ''").select("seg_id", F.split("tokenized_segment", " ").alias("t"))
    return _rounded(evaluation.term_metrics(own, kept, id_col="seg_id", terms="t"), "precision", "recall", "f1")


def _ngram_terms(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ngrams").where("trim(ngram) <> ''").select(F.col("ngram").alias("term")).distinct()


def _parallel(s: SparkSession, d: str) -> DataFrame:
    return _rounded(
        bilingual.parallel_terms(pairs(s, d), _ngram_terms(s, d), id_col="seg_id", source="segment_sl", target="segment_tl", stopwords=sw.all_outer()), "share"
    )


def _with_terms(s: SparkSession, d: str) -> DataFrame:
    corpus = table(s, d, "corpus").select("seg_id", "segment")
    return bilingual.segments_with_terms(corpus, _ngram_terms(s, d), id_col="seg_id", source="segment").select("seg_id", "term")


def _compounds(append: bool) -> Query:
    return lambda s, d: bilingual.compoundify(
        table(s, d, "corpus").select("seg_id", "segment"), _ngram_terms(s, d), id_col="seg_id", text="segment", append=append
    )


def _term_pairs(s: SparkSession, d: str) -> DataFrame:
    """Candidates of a project with the next one in it, as a list of pairs."""
    c = table(s, d, "candidate_terms").where("candidate is not null")
    a = c.select((F.col("cand_id") + 1).alias("cand_id"), F.col("candidate").alias("sl_term"))
    return a.join(c.select("cand_id", F.col("candidate").alias("tl_term"), "value"), "cand_id")


def _phrases(s: SparkSession, d: str) -> DataFrame:
    rows = _term_pairs(s, d).select(F.col("sl_term").alias("source"), F.col("tl_term").alias("target"), F.col("value").alias("probability"))
    rows = rows.where("probability is not null").groupBy("source", "target").agg(F.max("probability").alias("probability"))
    terms = table(s, d, "candidate_terms").select(F.col("candidate").alias("term"))
    return bilingual.phrase_table_translations(rows, terms)


def _knn(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings")
    return _rounded(vectors.knn_cosine(v.where("vec_id % 50 = 0"), v, id_col="vec_id", vector="embedding", k=K), "cosine").drop("rank")


def _lemmas(s: SparkSession, d: str) -> DataFrame:
    return segments(s, d).select(F.explode("tokens").alias("t")).distinct().select(F.lower("t").alias("form")).distinct().select(
        "form", linguistic.suffix_lemma(F.col("form")).alias("lemma")
    )


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "flagship": flagship,
        "tokenize": lambda s, d: segments(s, d).select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("joined")),
        "tokenize_blanks": lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", F.array_join(words(F.col("text")), " ").alias("joined")),
        "token_freq": lambda s, d: ops.token_frequency(segments(s, d)),
        "ngrams_2_3": lambda s, d: ops.ngram_counts(segments(s, d)),
        "stat_candidates": _candidates,
        "stopword_filter_legacy": lambda s, d: ops.stopword_filter(
            ops.as_candidates(ops.ngram_counts(segments(s, d))), sw.all_outer(), sw.all_inner(), legacy=True
        ),
        "case_norm": _normal,
        "case_norm_legacy": lambda s, d: ops.case_normalize_legacy(_candidates(s, d)),
        "nest_norm": lambda s, d: ops.nest_normalize(_normal(s, d)),
        "nest_norm_legacy": lambda s, d: ops.nest_normalize_legacy(_normal(s, d)),
        "regex_exclusion": lambda s, d: ops.regex_exclusion(_normal(s, d), REGEXES),
        "regex_exclusion_prefix": lambda s, d: ops.regex_exclusion(_normal(s, d), REGEXES, legacy=True),
        "exclusion_antijoin": lambda s, d: ops.exclude_known(_candidates(s, d), table(s, d, "ngrams").where("ngram is not null"), "ngram"),
        "select_unigrams": lambda s, d: ops.select_unigrams(_normal(s, d)),
        "length_bounds": lambda s, d: ops.length_between(table(s, d, "candidate_terms").select("cand_id", "candidate"), "candidate", 2, 3),
        "lemmatize": lambda s, d: ops.lemmatize(_normal(s, d), _lemmas(s, d)),
        "top_candidates": lambda s, d: ops.top(_normal(s, d), 20),
        "tsr_strict": lambda s, d: tsr.tsr_filter(_normal(s, d), reference(s, d), "strict"),
        "tsr_flexible": _tsr("flexible"),
        "tsr_combined": _tsr("combined"),
        "tagged_ngrams": _tagged_ngrams,
        "pattern_learn": _learned,
        "representativity_cut": lambda s, d: linguistic.representative(_learned(s, d), 80),
        "pattern_match": lambda s, d: linguistic.match_patterns(linguistic.stopword_filter_tagged(_tagged_ngrams(s, d), sw.all_outer()), PATTERNS),
        "evaluate_topk": lambda s, d: _rounded(
            evaluation.evaluate_topk(_normal(s, d), table(s, d, "ngrams").where("ngram <> ''").select("ngram").distinct(), 1000, column="ngram", ignore_case=True),
            "precision", "recall", "f1",
        ),
        "evaluate_topk_asc": lambda s, d: _rounded(
            evaluation.evaluate_topk(
                table(s, d, "ngrams").where("ngram <> '' and frequency is not null").groupBy(F.col("ngram").alias("candidate"), "n")
                .agg(F.count_distinct("batch_id").alias("value"), F.sum("frequency").alias("frequency")),
                reference(s, d), 500, ignore_case=True, nmax=3, ascending=True, seeds=_ngram_terms(s, d),
            ),
            "precision", "recall", "f1",
        ),
        "term_metrics_micro": _metrics(False),
        "term_metrics_sets": _metrics(True),
        "token_metrics": _split_metrics,
        "annotate_bio": lambda s, d: _labelled(s, d).select("item_id", F.array_join("labels", " ").alias("labels")),
        "bio_decode": lambda s, d: _labelled(s, d).select("item_id", F.explode(annotate.bio_terms(F.col("tokens"), F.col("labels"))).alias("term")),
        "predicted_counts": lambda s, d: annotate.predicted_counts(table(s, d, "annotated_dataset"), "terms"),
        "parallel_terms": _parallel,
        "segments_with_terms": _with_terms,
        "phrase_table": _phrases,
        "reference_translations": lambda s, d: bilingual.reference_translations(
            _term_pairs(s, d), table(s, d, "candidate_terms").where("candidate is not null"), term="candidate"
        ),
        "compoundify": _compounds(False),
        "compoundify_append": _compounds(True),
        "knn_cosine": _knn,
    }
    for m in ("raw_freq", "pmi", "student_t", "chi_sq", "phi_sq", "mi_like", "likelihood_ratio", "poisson_stirling", "jaccard", "dice",
              "loglikelihood", "mi", "mi2", "mi3", "odds", "z_score", "fisher"):
        q[f"assoc_{m}"] = _association(m)
    for k in (3, 4):
        for m in ("raw_freq", "pmi", "student_t", "mi_like", "poisson_stirling", "likelihood_ratio", "jaccard"):
            q[f"assoc{k}_{m}"] = _association(m, k)
        q[f"assoc{k}_chi_sq"] = _chi_sq(k)
    return q
