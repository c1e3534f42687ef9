"""Corpus pipeline: documents -> good -> one of each near-duplicate group -> masked -> mixed -> packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it to the shared folder as Parquet
and hands the next stage what it reads back. All stages but the last return the columns of documents.
Mixing draws rows again where a source is below its weight, so documents may repeat from there on; packing
packs every row it gets.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, pow2_packing, quality, secrets, shingle_join
from lodestone.llm.common import drop_stored, scratch, stored, tune


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return shingle_join.keep_one(docs)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return secrets.redact(docs)


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    pieces = pow2_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", good), ("near_duplicates", single), ("secrets", masked), ("mixing", weighted), ("packing", packed)]

#: Stages run tokenizers and trained models, which SQL cannot express; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage and the stage before it wrote is removed once its own output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark) as keep:
            done = stored(stage(spark, docs, sf_dir), name)
            keep.append(done)
        drop_stored(docs)
        docs = done
    return docs
