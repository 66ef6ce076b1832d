"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import (
    bytebpe,
    collocations,
    decontamination,
    filteraudit,
    language,
    linecleaning,
    packing,
    secrets,
    sharding,
    simhash,
    tokenfiles,
    toxicity,
    warc,
)
from faultline.llm.common import held_out, table

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_and_read(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.toxicity(documents, documents, labels)
    return scored.select(
        F.col("row.doc_id").alias("doc_id"),
        held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.near_duplicates(table(spark, sf_dir, "documents"), simhash.SimHash())
    return grouped.select("doc_id", "fingerprint", "component_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op7_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = linecleaning.clean_lines(table(spark, sf_dir, "documents"))
    return judged.select(F.col("row.doc_id").alias("doc_id"), "*").drop("row", "cleaned")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, path = table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)
    # File names are made up anew by each run.
    return tokenfiles.write_and_read(spark, documents, path).drop("file")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = language.identify(documents, documents)
    doc_id = F.col("row.doc_id")
    return found.select(
        doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "lang_pred", "score"
    )


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bytebpe.Vocabulary(public_tokenizers.path(RANKS))
    encoded = bytebpe.encode(table(spark, sf_dir, "documents"), vocabulary)
    # One pass of the encoder, whose ids feed the digest and the decoder.
    return bytebpe.decode(encoded, vocabulary).select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_sharding": op2_sharding,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_decontamination": op6_decontamination,
    "op7_line_cleaning": op7_line_cleaning,
    "op8_token_files": op8_token_files,
    "op9_secrets": op9_secrets,
    "op10_language": op10_language,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_filter_audit": op12_filter_audit,
    "op13_collocations": op13_collocations,
}
