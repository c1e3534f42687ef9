"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anisotropic, cdc, collocations, dac, exact_dedup, filter_audit, matroska, mixing, pow2_packing, prefix_counts, quality, secrets, shingle_join, sql
from .common import new_path, stored, tune

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(matroska.media_store(table(spark, sf_dir, "documents")), "media", compression="zstd")
    return matroska.media_features(media)


def op2_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = prefix_counts.prefix_store(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return store.select("doc_id", "n_bytes", "n_tokens", "over_limit", "n_chars", "fit_chars", F.length("store").cast("long").alias("store_bytes"))


def op3_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.mix(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "source", "tokens", "epoch", "start", "block", "place", F.round("weight", 9).alias("weight"), F.round("exponent", 9).alias("exponent"), "entropy_met", "repeats_met")


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.repeats(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_anisotropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anisotropic.search(table(spark, sf_dir, "embeddings"))


def op7_dac_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = dac.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), new_path(spark, "dac"))
    return dac.document_index(dac.read_token_files(spark, path))


def op8_pow2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pow2_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = secrets.scan(table(spark, sf_dir, "documents"), "doc_id")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    base, found = secrets.listing(F.col("base")), secrets.listing(F.col("found"))
    return d.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), found.alias("spans"))


def op10_combination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.components(table(spark, sf_dir, "documents"))


def op11_perfect_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = (op1_matroska, op2_prefix_counts, op3_temperature_mix, op4_chunk_dedup, op5_quality, op6_anisotropic, op7_dac_files)
    return {f.__name__: f for f in (*first, op8_pow2_packing, op9_randomness, op10_combination_join, op11_perfect_hash, op12_collocations, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op3_temperature_mix": sql.MIX, "op10_combination_join": sql.COMPONENTS, "op11_perfect_hash": sql.EXACT, "op12_collocations": sql.COLLOCATIONS, "op13_filter_audit": sql.AUDIT}
