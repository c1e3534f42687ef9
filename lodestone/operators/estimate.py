"""Sequential cluster-sampling estimate of the share of AI chunks, with early stopping.

Input of trajectory(): one row a scanned step (repo, step, status, chunks, ai_chunks, probability_sum, is_ai), status
scanned, generated or errored; the latter two shrink the population. Sums run over a repository's steps, at most
the candidate cap of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..session import cut_lineage
from .prefix import running

BLOCK = 2048  # steps whose sums run in one task


@dataclass(frozen=True)
class Sampling:
    z: float = S.Z_99
    target: float = S.TARGET_HALF_WIDTH
    min_files: int = S.MIN_FILES
    max_chunks: int = S.MAX_CHUNKS


def trajectory(steps: DataFrame, z: float = S.Z_99) -> DataFrame:
    """Adds the running counters and the estimate after each step. Column _n, if there, is the number of candidates
    (else all steps are there). The variance's numerator is exact (whole numbers), so equal clusters give 0. Sums run by
    blocks of steps, so a repository with most of the steps spreads over tasks."""
    ok = F.col("status") == "scanned"
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0).cast("long")
    add = lambda c: F.when(ok, c).otherwise(0)
    m, a = F.col("chunks").cast("decimal(19,0)"), F.col("ai_chunks").cast("decimal(19,0)")
    steps = cut_lineage(steps)  # rows of numbers; what scored them runs once
    s = steps if "_n" in steps.columns else steps.join(steps.groupBy("repo").agg(F.count("*").alias("_n")), "repo")
    r = running(s, ["repo"], F.floor(F.col("step") / BLOCK), ["step"], {
        "files_scanned": one(ok), "files_generated": one(F.col("status") == "generated"), "files_errored": one(F.col("status") == "errored"), "files_ai": one(ok & F.col("is_ai")),
        "chunks_scanned": add(F.col("chunks")).cast("long"), "chunks_ai": add(F.col("ai_chunks")).cast("long"), "_p": F.when(ok, F.col("probability_sum")).otherwise(0.0),
        "_mm": add(m * m).cast("decimal(28,0)"), "_ma": add(m * a).cast("decimal(28,0)"), "_aa": add(a * a).cast("decimal(28,0)"),
    })
    r = r.withColumn("population", (F.col("_n") - F.col("files_generated") - F.col("files_errored")).cast("long"))
    n, big_n, ms, as_ = F.col("files_scanned"), F.col("population"), F.col("chunks_scanned"), F.col("chunks_ai")
    dm, da = ms.cast("decimal(12,0)"), as_.cast("decimal(12,0)")
    num = (dm * dm * F.col("_aa").cast("decimal(17,0)") - 2 * da * dm * F.col("_ma").cast("decimal(17,0)") + da * da * F.col("_mm").cast("decimal(17,0)")).cast("double")
    square = ms.cast("double") * ms
    width = z * F.sqrt(F.greatest(F.lit(0.0), (1 - n / big_n) * n * num / F.greatest(n - 1, F.lit(1)))) / square
    r = r.withColumns({"fraction": F.when(ms > 0, as_ / ms), "half_width": F.when(ms > 0, F.when(n >= big_n, F.lit(0.0)).when(n >= 2, width))})
    some = F.col("half_width").isNotNull()
    return r.withColumns({
        "fraction": F.when(some, F.col("fraction")),
        "low": F.when(some, F.greatest(F.lit(0.0), F.col("fraction") - F.col("half_width"))),
        "high": F.when(some, F.least(F.lit(1.0), F.col("fraction") + F.col("half_width"))),
        "mean_probability": F.when(ms > 0, F.col("_p") / ms),
        "files_human": n - F.col("files_ai"), "chunks_human": ms - as_,
    }).drop("_p", "_mm", "_ma", "_aa", "_n")


def stop_reason(c: Sampling):
    precise = F.coalesce((F.col("files_scanned") >= c.min_files) & (F.col("half_width") <= c.target), F.lit(False))
    return F.when(precise, "precision_reached").when(F.col("chunks_scanned") >= c.max_chunks, "chunk_budget_exhausted")


def repo_stats(steps: DataFrame, config: Sampling = Sampling()) -> DataFrame:
    """One row a repository: the first step that stops, or the last with all_files_scanned."""
    t = trajectory(steps, config.z).withColumn("_stop", stop_reason(config))
    left = [c for c in t.columns if c not in ("repo", "_stop", "status", "chunks", "ai_chunks", "probability_sum", "is_ai")]
    stopped, row = F.col("_stop").isNotNull(), F.struct(*left, F.coalesce("_stop", F.lit("all_files_scanned")).alias("stop_reason"))
    first = F.min_by(row, F.struct(F.when(stopped, 0).otherwise(1).alias("k"), F.when(stopped, F.col("step")).otherwise(-F.col("step")).alias("s")))
    return t.groupBy("repo").agg(first.alias("r")).select("repo", "r.*")


def stepwise(score, candidates: DataFrame, config: Sampling = Sampling(), block: int = 64) -> DataFrame:
    """Scores candidates in blocks of steps and stops reading a repository once its stop step is known.

    score maps candidates (repo, step, ...) to step rows. Blocks double, so a repository needs few jobs; the open
    repositories of each block are found by a join, never collected."""
    done, low, high = None, 0, block
    total = candidates.groupBy("repo").agg(F.count("*").alias("_n")).cache()
    most = total.agg(F.max("_n")).first()[0] or 0
    open_, held = total.select("repo"), [total]
    while low < most:
        fresh = score(candidates.where((F.col("step") > low) & (F.col("step") <= high)).join(open_, "repo")).cache()
        done = fresh if done is None else done.unionByName(fresh)
        t = trajectory(done.join(total, "repo"), config.z).withColumn("_stop", stop_reason(config))
        open_ = t.groupBy("repo").agg(F.count_if(F.col("_stop").isNotNull()).alias("c")).where("c = 0").select("repo").cache()
        held += [fresh, open_]
        if not open_.limit(1).count():
            break
        low, high = high, high * 2
    if done is None:
        total.unpersist()
        return candidates.limit(0)
    # the rows are numbers, one a scored file: taken once, so that no cached block has to stay
    out = cut_lineage(done.join(total, "repo"))
    for x in held:
        x.unpersist()
    return out
