"""Corpus preparation end to end: manifests and checkouts to split JSON Lines and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import paths as P
from ..functions import text as T
from ..operators import corpus as C
from ..sources import code_tree, jsonl, manifest


def file_table(spark: SparkSession, sources: list[dict], roots: dict[str, str], max_bytes: int = S.MAX_FILE_BYTES) -> DataFrame:
    """Decoded code files of all checkouts, one scan: names and sizes decide before anything is read."""
    paths = lambda k: {s["id"]: list(s[k]) for s in sources if s.get(k)}
    small = F.col("language").isNotNull() & (F.col("size") <= max_bytes)
    read = code_tree.code_tree(spark, {s["id"]: roots[s["id"]] for s in sources}, paths("include_paths"), paths("exclude_paths"), small)
    return read.where(P.prep_selected("path")).select("source_id", "path", "size", "language", T.decoded("content").alias("text")).where("text IS NOT NULL")


def prepare(spark: SparkSession, manifests: dict[str, dict], roots: dict[str, str], out: str | None = None, seed: str = "corpus-v1", balance: bool = True, paths: dict[str, str] | None = None, **limits: int) -> tuple[DataFrame, dict]:
    """The prepared chunks and their summary; with out, also written there. Balanced records come by digest, others by
    source, path components and chunk. The split counts of the summary are observed on the rows as they are written. paths:
    the manifests' files, for the summary."""
    sources = manifest.sources(spark, manifests)
    flat = [s for m in manifests.values() for s in m["sources"]]
    chunks = C.records(file_table(spark, flat, roots), sources, **limits).cache()
    unique = C.deduplicated(chunks).cache()
    try:
        stats = C.dedup_stats(chunks).first()
        if balance:
            C.check_balance(unique)
            final = C.balanced(unique, seed)
        else:
            final = unique.withColumn("output_key", F.lit(None).cast("string"))
        cells = {f"{s} {n}": F.count_if((F.col("split") == s) & (F.col("label_name") == n)) for s in manifests for n in ("human", "ai")}
        if out:
            written = Observation("written")
            jsonl.write(final, str(out), ["output_key"] if balance else ["source_id", F.split("path", "/"), "chunk_index"], list(manifests), written, **cells)
            counts = written.get
        else:
            counts = final.agg(*[c.alias(n) for n, c in cells.items()]).first().asDict()
        values = (
            paths or {split: None for split in manifests}, seed, S.NORMALIZATION, {r["source_id"]: r["n"] for r in C.source_counts(chunks, sources).orderBy("source_id").collect()}, stats["kept"],
            stats["duplicate_count"], stats["conflict_count"], balance, {s: {n: counts[f"{s} {n}"] for n in ("human", "ai") if counts[f"{s} {n}"]} for s in S.SPLITS if s in manifests},
        )
        summary = dict(zip(S.SUMMARY, values, strict=True))
        if out:
            jsonl.write_summary(spark, summary, f"{out}/summary.json")
    finally:
        unique.unpersist()
        chunks.unpersist()
    return final, summary
