"""Registered queries of the training-data operators, with their SQL.

Each query gets its rows through its operator and only derives digest columns
from the operator's outputs.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwright.llm import bigru, cover, licences, lines, merkle, minmax, negatives, packing, planes, quality, quotes, sql, urls, wumanber
from tillwright.llm.common import table
from tillwright.session import checkpoint_dir


def op1_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that the sentences of each document name."""
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"),
                        F.array_join("licences", ",").alias("licences"), "n_unused")


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as mail that quotes the turns before, linked again and read without quotes."""
    found = quotes.linked(quotes.quoting(table(spark, sf_dir, "conversations")))
    return found.select(F.col("scope").alias("conv_id"), F.col("message_id").alias("turn"), F.col("parent").alias("parent_turn"),
                        F.col("root").alias("root_turn"), "depth", "n_quoted", F.md5("own").alias("own_md5"))


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as byte planes of token ids, read back from the written segments."""
    path = f"{checkpoint_dir(spark)}/llm-planes-{uuid.uuid4().hex}"
    planes.write_segments(table(spark, sf_dir, "documents"), path,
                          tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return planes.read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated 35-word windows."""
    found = cover.remove_repeats(table(spark, sf_dir, "documents"), length=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside 10-word windows of test items."""
    found = wumanber.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op6_min_max_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets are 85 % alike."""
    found = minmax.near_duplicates(table(spark, sf_dir, "documents"), width=3, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "kept", "n_links")


def packed(docs: DataFrame) -> DataFrame:
    """Packing with the production parameters, ids as a CRC."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return pieces.select(F.col("doc_id").cast("long").alias("doc_id"), "start", "length",
                         F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packed(table(spark, sf_dir, "documents"))


def op8_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines found in ten documents or more; every row is a document."""
    docs = table(spark, sf_dir, "documents")
    found = lines.with_bitmaps(docs, lines.keep_bitmaps(docs, min_docs=10, min_chars=1, each_row=True))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base features and verdict of the rule cascade for every document."""
    return quality.judged(table(spark, sf_dir, "documents"))


def op10_url_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of listed and mined rules for every page."""
    return urls.judged(table(spark, sf_dir, "pages"))


def op11_byte_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a recurrent network over its bytes."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    found = bigru.identify(docs, *bigru.fitted(docs, "lang", F.coalesce(fold != 0, F.lit(False))))
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score",
                        F.aggregate(F.map_values("labelled"), F.lit(0).cast("long"), lambda a, x: a + x).alias("n_positions"))


def op12_hilbert_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, ten for each of five positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.vectors(table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding", lambda x: F.floor(x * 256))
    return negatives.mine(rows, every=100, positives=5, negatives=10, least=30, most=90)


def op13_merkle_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of documents with a proof of every row, some of them tampered with."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    found = merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"],
                            group="source", order="doc_id", changed="text", tampered=tampered)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES = {f.__name__: f for f in (
    op1_licence_scans, op2_quotation_linking, op3_token_planes, op4_difference_cover, op5_wu_manber, op6_min_max_hashing,
    op7_vector_packing, op8_line_bitmaps, op9_quality_cascade, op10_url_associations,
    op11_byte_bigru, op12_hilbert_zones, op13_merkle_descent)}

ORACLE: dict[str, str] = sql.ORACLE
