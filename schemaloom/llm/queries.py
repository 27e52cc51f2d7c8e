"""One query per operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm import (
    audit,
    collocations,
    exact_dedup,
    licenses,
    mixing,
    oracle,
    pieces,
    shared,
    simhash,
    token_counts,
    token_files,
    topk,
    toxicity,
    url_filter,
    warc,
)

MOST_TOKENS = 1024
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = shared.table(spark, folder, "documents")
    counts = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > MOST_TOKENS).alias("over_limit"))


def op2_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(shared.table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = shared.table(spark, folder, "documents"), shared.table(spark, folder, "labels")
    return toxicity.toxicity(docs, labels).withColumnRenamed("id", "doc_id")


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(shared.table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), simhash.hex_of(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicate_groups(shared.table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    check = pieces.checked(public_tokenizers.path("piece_bpe_32k.model"))
    docs = shared.table(spark, folder, "documents").select("doc_id", check(F.col("text"), with_ids=False).alias("done"))
    return docs.select("doc_id", "done.n_tokens", "done.ids_crc32", "done.decoded_chars", "done.round_trip")


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = shared.table(spark, folder, "documents")
    path = shared.shared_folder(spark, "token-files")
    token_files.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.digests(spark, path, pieces.ids_crc32).withColumnRenamed("digest", "ids_crc32")


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = shared.shared_folder(spark, "warc")
    files = warc.write_warc(warc.roles(shared.table(spark, folder, "pages")), path)
    rows = warc.read_warc(spark, path, files, payloads=False)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(shared.table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mix = mixing.mixture(shared.table(spark, folder, "documents"))
    return mix.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    failed = audit.failures(shared.table(spark, folder, "documents"))
    return audit.audit(failed, shared.table(spark, folder, "labels"))


def op12_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The tables have no outcomes of pages; the labels of the document with a page's number stand in for them."""
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    outcomes = shared.table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    rules = [url_filter.Rule.of(*r) for r in URL_RULES]
    return url_filter.judged(shared.table(spark, folder, "pages"), outcomes, rules).withColumnRenamed("id", "page_id")


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(shared.table(spark, folder, "documents")).withColumnRenamed("part", "lang")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_exact_top_k, op3_toxicity, op4_simhash, op5_exact_dedup,
        op6_sentencepiece, op7_token_files, op8_warc, op9_licenses, op10_mixing,
        op11_filter_audit, op12_url_filter, op13_collocations,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLE = oracle.SQL
