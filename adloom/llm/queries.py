"""The registered queries of this subpackage, with the contract's parameters and columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.llm.ann import build_index, search_index, usable
from adloom.llm.bpe import bpe_round_trip
from adloom.llm.common import ship
from adloom.llm.gnat_codes import vector_codes
from adloom.llm.jaccard_join import jaccard_classes
from adloom.llm.mixing import mix_sources
from adloom.llm.pca_clusters import centroid_clusters
from adloom.llm.quality_rules import quality_rules
from adloom.llm.secrets import KINDS, secret_scan, span_text
from adloom.llm.sentence_pieces import piece_round_trip
from adloom.llm.suffix_dedup import suffix_dedup
from adloom.llm.token_store import read_store, store_folder, write_store
from adloom.llm.toxicity import held_out, score_texts, train_toxicity
from adloom.llm.url_filter import url_filter

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"),
             ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    index = build_index(vectors)
    queries = usable(vectors, "vec_id", "embedding").filter("id % 50 = 0").distinct()
    return search_index(index, queries)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("found")
    count = lambda k: F.size(F.filter(found, lambda x: x["kind"] == k)).cast("long")
    base = F.filter(found, lambda x: x["kind"] < len(KINDS))
    return secret_scan(_table(spark, sf_dir, "documents")).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(found).alias("spans"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = store_folder(spark, "token-store")
    write_store(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_store(spark, folder)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train_toxicity(docs, _table(spark, sf_dir, "labels"))
    return score_texts(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(_table(spark, sf_dir, "embeddings"))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_suffix_dedup, op3_url_filter, op4_token_store, op5_mixing, op6_byte_bpe, op7_nearest,
    op8_secret_scan, op9_jaccard_join, op10_toxicity, op11_vector_codes, op12_centroid_clusters, op13_sentence_pieces)}
