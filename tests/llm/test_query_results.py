"""What the registered queries return on the smallest tables: columns, types, folds and limits."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from shopflow.llm import queries

DIR = "/root/testdata/sf0.001"

# Columns and types that each query is to have.
COLUMNS = {
    "op2_chunk_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op4_scaled_sketch": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op5_block_nearest": "query_id bigint, rank int, vec_id bigint, score double",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op11_suffix_phrases": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op12_angular_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op13_metric_tree": "query_id bigint, rank int, vec_id bigint, score bigint",
}
FOLDS = {"op6_toxicity": (5, 0), "op7_language": (3, 1), "op9_quality": (5, 0)}
FROM = {"op6_toxicity": 0.5, "op9_quality": 0.3}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_folds_and_limits(spark, name):
    found = queries.QUERIES[name](spark, DIR)
    kinds = dict(found.dtypes)
    for column in COLUMNS[name].split(", "):
        label, kind = column.split(" ")
        assert kinds[label] == kind, label
    rows = found.collect()
    if name in FOLDS:
        docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id").collect()
        assert sorted(r.doc_id for r in rows) == sorted(d.doc_id for d in docs)
        folds, fold = FOLDS[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in rows)
        assert all(0.0 <= r.score <= 1.0 for r in rows)
    if name in FROM:
        assert all(r.predicted == int(r.score >= FROM[name]) for r in rows)
    if name == "op5_block_nearest":
        assert sorted((r.query_id, r["rank"]) for r in rows) == [(q, k) for q in range(0, 500, 50) for k in range(1, 6)]
    if name == "op13_metric_tree":
        assert sorted((r.query_id, r["rank"]) for r in rows) == [(q, k) for q in range(0, 500, 100) for k in range(1, 11)]
    if name == "op10_packing":
        lengths = found.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
        assert all(r.n <= 1024 for r in lengths)
