"""Queries of the nine training-data problems over the tables of TESTDATA.md."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import bpe, chunking, cosine_join, lossy, merkle, mixing, residue, sentences, trie_count
from termloom.runtime import checkpointed, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_join.cross_split_pairs(
        table(spark, sf_dir, "annotated_dataset"), id_col="item_id", split="split", segment="segment"
    )


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_join.overlap_report(
        table(spark, sf_dir, "annotated_dataset"), id_col="item_id", split="split", segment="segment", source="source"
    )


def _term_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete records of both tables: tbl, id, candidate, measure, value."""
    parts = [
        (df.withColumn("tbl", F.lit(name)).withColumnRenamed(key, "id").select("tbl", "id", "candidate", "measure", "value"))
        for name, key, df in (
            ("candidate_terms", "cand_id", table(spark, sf_dir, "candidate_terms")),
            ("candidate_raw", "raw_id", merkle.parsed_records(table(spark, sf_dir, "candidate_raw"), "record")),
        )
    ]
    both = parts[0].unionByName(parts[1]).where(F.col("candidate").isNotNull() & F.col("value").isNotNull())
    return both.where(F.col("candidate").rlike(r"[\p{L}\p{N}]"))


_RECORD = {
    "by": ["tbl"],
    "id_col": "id",
    "columns": ["candidate", "measure", "value"],
    "rules": {"measure": lambda c, kind: c},  # measures are compared as they stand
}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.copies(_term_records(spark, sf_dir), **_RECORD).select("tbl", "keep_id", "copy_id")


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record, with its number of copies."""
    return merkle.copy_classes(_term_records(spark, sf_dir), **_RECORD).select("tbl", "keep_id", "copies")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = chunking.split_texts(table(spark, sf_dir, "corpus"), id_col="seg_id", text="segment")
    tokens = chunking.split_tokens(table(spark, sf_dir, "tokenized_corpus"), id_col="seg_id", tokens="tokenized_segment")
    return texts.withColumn("tbl", F.lit("corpus")).unionByName(tokens.withColumn("tbl", F.lit("tokenized_corpus")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where((F.col("pieces") > 1) & (F.col("piece") == 0)).select("tbl", F.col("id").alias("seg_id"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).select("tbl", F.col("id").alias("seg_id"), "piece", "pieces", "start", "end", "repeated", "text")


def _term_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "tokens")
        .select(F.lit("tokens").alias("tbl"), "row_id", "batch_id", F.col("token").alias("term"), "frequency")
        .unionByName(
            table(spark, sf_dir, "ngrams").select(
                F.lit("ngrams").alias("tbl"), "row_id", "batch_id", F.col("ngram").alias("term"), "frequency"
            )
        )
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_count.marked_terms(_term_rows(spark, sf_dir)).where(F.col("mark").isNotNull()).select("tbl", "term", "mark")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_count.marked_terms(_term_rows(spark, sf_dir)).select("tbl", "term", "occurrences", "records", "mark")


def _heavy_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lossy.heavy_items(table(spark, sf_dir, "ngrams"), item="ngram", weight="frequency", row_id="row_id", k=50)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_sentences(spark, sf_dir).select("seg_id", "sent_start", "sent_end")


def p5_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "corpus"), id_col="seg_id", text="segment", lang="lang")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heavy_ngrams(spark, sf_dir).select(F.col("item").alias("ngram"))


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-grams of p6_found with exact totals; the guaranteed intervals are in heavy_items."""
    return _heavy_ngrams(spark, sf_dir).select(F.col("item").alias("ngram"), "total")


def p6_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-grams of p6_found with the intervals that counting guaranteed, and their exact totals."""
    return _heavy_ngrams(spark, sf_dir).select(F.col("item").alias("ngram"), "low", "high", "total")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), text="text", keep=["doc_id"]).select("doc_id", "ids")


def _mix(spark: SparkSession, sf_dir: str, total: int | str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("source").isNotNull() & F.col("text").isNotNull())
    sized = checkpointed(bpe.token_counts(docs, text="text", keep=["doc_id", "source", "lang"]))
    return mixing.mixed(sized, table(spark, sf_dir, "mix_targets"), total=total)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents selected, with their copies."""
    return _mix(spark, sf_dir, "fitting")


def p8_mix_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents selected, with their copies, if as many tokens are to be selected as there are."""
    return _mix(spark, sf_dir, "available")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached by p8_mix."""
    return mixing.shares(_mix(spark, sf_dir, "fitting"), table(spark, sf_dir, "mix_targets"))


def p8_shares_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached if as many tokens are to be selected as there are: short sources stay below their target."""
    return mixing.shares(_mix(spark, sf_dir, "available"), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents"), id_col="doc_id", text="text").select("doc_id")


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that stay."""
    return residue.without_residue(table(spark, sf_dir, "documents"), id_col="doc_id", text="text").select("doc_id")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}
