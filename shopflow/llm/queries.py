"""The operators over the whole of the test tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.llm import (
    angular,
    chat,
    chosen_path,
    chunk_bpe,
    edited_pairs,
    language,
    metric_tree,
    nearest,
    packing,
    phrases,
    quality,
    sql,
    token_counts,
    toxicity,
)
from shopflow.llm.common import fold_of

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TOXIC_FROM, QUALITY_FROM = 0.5, 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def learnable(column: str = "doc_id"):
    """Rows that labels may be learnt from: four of five folds."""
    return fold_of(F.col(column), 5) != 0


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.edited_token_counts(docs, VOCABULARY, token_counts.sample_edits(F.col("text")))


def op2_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.round_trip_digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op3_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repaired(table(spark, sf_dir, "conversations"))


def op4_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_block_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = nearest.nearest(rows, F.col("id") % 50 == 0, 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), learnable())
    return predicted(toxicity.score(docs, model), 5, 0, TOXIC_FROM)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs, fold_of(F.col("doc_id"), 3) != 1)
    found = language.predict(docs, model)
    return found.select("doc_id", held_out(3, 1), "lang_pred", "score")


def op8_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.similar_documents(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"), learnable())
    return predicted(quality.score(docs, model), 5, 0, QUALITY_FROM)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op11_suffix_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(table(spark, sf_dir, "documents"))


def op12_angular_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), moved.alias("label"))
    found = angular.hard_negatives(rows, F.col("id") % 50 == 0, 256)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = metric_tree.best_products(rows, F.col("id") % 100 == 0, 10, 1024)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def held_out(folds: int, fold: int):
    """Whether a row is in the fold that isn't learnt from; false for a null id."""
    return F.coalesce(fold_of(F.col("doc_id"), folds) == fold, F.lit(False)).alias("held_out")


def predicted(scores: DataFrame, folds: int, fold: int, limit: float) -> DataFrame:
    return scores.select(
        "doc_id", held_out(folds, fold), "score", (F.col("score") >= limit).cast("int").alias("predicted")
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_chunk_bpe,
        op3_chat_repair,
        op4_scaled_sketch,
        op5_block_nearest,
        op6_toxicity,
        op7_language,
        op8_chosen_path,
        op9_quality,
        op10_packing,
        op11_suffix_phrases,
        op12_angular_negatives,
        op13_metric_tree,
    )
}
ORACLES: dict[str, str] = {
    "op11_suffix_phrases": sql.PHRASES,
    "op12_angular_negatives": sql.HARD_NEGATIVES,
    "op13_metric_tree": sql.PRODUCTS,
}
