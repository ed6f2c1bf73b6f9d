"""The thirteen operators as queries over whole tables, with their production parameters."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression_classifier, decontamination, fill_in_middle, license_scan, line_dedup, packing, prefix_trie, quality_rules, secrets, sharding, simhash, suffix_dedup, warc
from .common import new_path, read

SHARDS = 24
POLICY = "v2"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.rendezvous_shards(read(spark, sf_dir, "documents"), weights=[1.0] * SHARDS, grown=[1.0] * (SHARDS + 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan_secrets(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed", "top_score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(read(spark, sf_dir, "documents")).drop("removed")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.apply_policy(quality_rules.ledger(read(spark, sf_dir, "documents")), POLICY)
    base = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.mask("v1")).cast("long")) != 0
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(read(spark, sf_dir, "pages"), path)
    out = warc.read_warc(spark, path)
    # A quarantined gap is a row without a type: what has just been written must have none.
    lost = F.raise_error(F.concat_ws(" ", F.lit("damaged archive:"), "path", "start", "end")).cast("string")
    kind = F.when(F.col("record_type").isNull(), lost).otherwise(F.col("record_type"))
    return out.select("page_id", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op10_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = compression_classifier.fit(docs, read(spark, sf_dir, "labels"))
    scored = compression_classifier.score_documents(docs, model)
    held = compression_classifier.held_out(F.col("doc_id"))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.fill_in_middle(read(spark, sf_dir, "documents"))
    text = fill_in_middle.restored(F.col("output"), F.col("form"))
    digests = [F.sha2(c, 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (text, "restored_sha256"))]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests, "splits_word")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = {k: f for k, f in vars(sys.modules[__name__]).items() if k.startswith("op") and callable(f)}
    return own | {"pipeline": corpus_pipeline.run}
