"""Candidate selection of a repository scan: walk order, filters in turn, the candidate cap and its counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.paths import directory_pruned, scan_reason, walk_key
from .prefix import range_buckets, running


def pruned_above(path: Column) -> Column:
    """Whether a directory above the entry is left out of the walk."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), directory_pruned)


def walked(entries: DataFrame, max_bytes: int = S.SCAN_FILE_BYTES, max_files: int = S.SCAN_MAX_FILES) -> DataFrame:
    """Entries (repo, path, is_dir, size) that the walk meets before the cap, with reason, walk_index from 1, and candidates
    so far.

    reason: 'pruned', 'unreadable' (column errored, if there) or 'directory' of directories, else extension, pattern, too_large or candidate.
    The walk is cut into ranges of its order; counts of the ranges tell where the cap is reached, and only ranges up to there are ordered."""
    seen = entries.where(~pruned_above(F.col("path")))
    name = F.element_at(F.split("path", "/"), -1)
    bad = F.col("errored") if "errored" in entries.columns else F.lit(False)
    reason = F.when(F.col("is_dir"), F.when(directory_pruned(name), "pruned").when(F.coalesce(bad, F.lit(False)), "unreadable").otherwise("directory")).otherwise(scan_reason(name, F.col("size"), max_bytes))
    r = range_buckets(seen.withColumns({"reason": reason, "_k": walk_key(F.col("path"), F.col("is_dir"))}), "repo", "_k")
    most = max(1, max_files)
    hit = F.col("reason") == "candidate"
    r = running(r, ["repo"], F.col("_range"), ["_k"], {"walk_index": F.lit(1), "candidates": F.when(hit, 1).otherwise(0)}, {"candidates": most})
    return r.where((F.col("candidates") < most) | ((F.col("candidates") == most) & hit)).drop("_k", "_range")


def candidates(entries: DataFrame, **limits: int) -> DataFrame:
    return walked(entries, **limits).where("reason = 'candidate'").select("repo", "path", F.col("candidates").cast("int").alias("candidate_index"))


def selection_stats(entries: DataFrame, max_bytes: int = S.SCAN_FILE_BYTES, max_files: int = S.SCAN_MAX_FILES) -> DataFrame:
    count = lambda *r: F.count_if(F.col("reason").isin(*r))
    files = count("extension", "pattern", "too_large", "candidate")
    return walked(entries, max_bytes, max_files).groupBy("repo").agg(
        files.alias("files_seen"), count("candidate").alias("files_selected"), count("extension").alias("files_skipped_extension"), count("pattern").alias("files_skipped_pattern"),
        count("too_large").alias("files_skipped_too_large"), count("pruned").alias("directories_pruned"), count("unreadable").alias("directories_errored"), (count("candidate") >= max(1, max_files)).alias("truncated"),
    )
