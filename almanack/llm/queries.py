"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.llm import audit, bilinear, bpe, codes, extraction, neighbours, packing, sharding, simhash, suffixes, toxicity, warc, winnowing
from almanack.llm.common import table
from almanack.llm.oracles import ORACLES as ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def hex64(bits) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), digests=True)


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row",
    )


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex64("fp").alias("fingerprint"), "component_id")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.drop_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.edits(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        winnowing.fingerprint(F.col("hashes")).alias("fingerprint"),
        winnowing.fingerprint(F.col("edited_hashes")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    records = warc.read_records(manifest, data=False)
    return records.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.main_texts(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(table(spark, sf_dir, "documents"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = codes.with_label_error(codes.compress(table(spark, sf_dir, "embeddings")))
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


@query
def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilinear.score_documents(table(spark, sf_dir, "documents"))
