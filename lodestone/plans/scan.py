"""Repository estimate end to end: list, select, shuffle, read and score in tasks by blocks, stop early."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scores, text as T
from ..operators import estimate, sampling, selection
from ..sources.frontier import entries
from ..sources.tree import Accessor, AccessError
from ..streaming.progress import advance, begin, report
from . import score as scorers

STEP = ("repo", "step", "status", "chunks", "ai_chunks", "probability_sum", "is_ai")
FIRST_BLOCK = 64  # files of the first block; blocks double


def line_chunks(text) -> Column:
    """Chunks of the stand-in scorer: the lines that are not blank."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(S.SCAN_STRIP))) > 0)


def scored_steps(files: DataFrame, score: Callable = lambda line: scores.line_score(line, S.SCAN_STRIP), threshold: float = S.CHUNK_THRESHOLD, max_chars: int = S.SCAN_READ_CHARS, file_threshold: float = 0.5) -> DataFrame:
    """Step rows of files (repo, step, text or null): chunks are scored lines; a file's label comes from their mean."""
    t = F.substring("text", 1, max_chars)
    f = files.select("repo", "step", t.alias("text"))
    f = f.withColumn("_p", F.transform(line_chunks(F.col("text")), score))
    blank = F.coalesce(F.size("_p") < 1, F.lit(True)) | F.contains(F.col("text"), F.lit("\0"))
    total = F.aggregate("_p", F.lit(0.0), lambda s, x: s + x.cast("double"))
    n = F.size("_p").cast("long")
    return step_rows(f.select("repo", "step", "text", blank.alias("blank"), n.alias("chunks"), F.size(F.filter("_p", lambda x: x >= F.lit(threshold).cast("float"))).cast("long").alias("ai_chunks"), total.alias("probability_sum")), (F.col("probability_sum") / F.greatest("chunks", F.lit(1))).cast("float") >= F.lit(file_threshold).cast("float"))


def step_rows(f: DataFrame, is_ai: Column) -> DataFrame:
    """STEP columns of rows with text, blank and the chunk sums: what cannot be scanned has a status and no sums."""
    status = F.when(F.col("text").isNull(), "errored").when(T.looks_generated("text"), "generated").when(F.col("blank"), "errored").otherwise("scanned")
    ok = F.col("status") == "scanned"
    return f.withColumn("status", status).select("repo", "step", "status", *[F.when(ok, F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("chunks", "ai_chunks", "probability_sum")], F.when(ok, is_ai).otherwise(False).alias("is_ai"))


def model_steps(tokens: Callable, make: scorers.Scorer, threshold: float = S.CHUNK_THRESHOLD, max_chars: int = S.SCAN_READ_CHARS, file_threshold: float = 0.5, how: str = "mean", length: int = S.WINDOW_TOKENS, overlap: int = S.WINDOW_OVERLAP, batch: int = 32) -> Callable[[DataFrame], DataFrame]:
    """A files-to-steps function of a model: chunks are its token windows, a file's label is its own decision."""

    def steps(files: DataFrame) -> DataFrame:
        f = files.select("repo", "step", F.substring("text", 1, max_chars).alias("text")).withColumn("file_id", F.concat_ws("\0", "repo", F.col("step").cast("string")))
        c = scorers.classify(f.select("file_id", "text"), tokens, make, file_threshold, how, length, overlap, batch)
        c = c.select("file_id", "prediction", F.size("window_probabilities").cast("long").alias("chunks"), F.size(F.filter("window_probabilities", lambda x: x >= F.lit(threshold).cast("float"))).cast("long").alias("ai_chunks"), F.aggregate("window_probabilities", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("probability_sum"))
        return step_rows(f.join(c, "file_id").withColumn("blank", F.col("prediction").isNull()), F.col("prediction") == "ai")

    return steps


def read(candidates: DataFrame, accessor: Accessor, max_chars: int = S.SCAN_READ_CHARS) -> DataFrame:
    """repo, step, text of rows (repo, step, path), read in tasks by a copy of the accessor; null where it fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 32):  # a file may have 131,072 characters
                part, texts = b.slice(i, 32), []
                for path in part.column("path").to_pylist():
                    try:
                        texts.append(accessor.read_file(path, None, max_chars))
                    except AccessError:
                        texts.append(None)
                yield pa.RecordBatch.from_arrays([part.column("repo"), part.column("step"), pa.array(texts, pa.string())], ["repo", "step", "text"])

    return candidates.select("repo", "step", "path").mapInArrow(run, "repo string, step int, text string")


@contextmanager
def interruptible(spark: SparkSession, cancelled: Callable[[], bool] | None, poll: float = 0.1) -> Iterator[None]:
    """Jobs of this thread inside the block end, with an exception, soon after cancelled() is true: they have a tag of their own,
    which a watching thread cancels (a session's interruptTag knows only tags of its own thread)."""
    sc = spark.sparkContext
    if cancelled is None:
        yield
        return
    tag, done = f"scan-{uuid.uuid4().hex}", threading.Event()

    def watch() -> None:
        while not done.wait(poll):
            if cancelled():
                sc.cancelJobsWithTag(tag)  # again at each poll: a job may have begun after the last

    watcher = threading.Thread(target=watch, daemon=True)
    sc.addJobTag(tag)
    sc.setInterruptOnCancel(True)
    watcher.start()
    try:
        yield
    finally:
        done.set()
        watcher.join()
        sc.setInterruptOnCancel(False)
        sc.removeJobTag(tag)


def analyze(spark: SparkSession, accessor: Accessor, config: estimate.Sampling = estimate.Sampling(), seed: int = 0, score: Callable[[DataFrame], DataFrame] = scored_steps, max_bytes: int = S.SCAN_FILE_BYTES, max_files: int = S.SCAN_MAX_FILES, on_progress: Callable[[dict], bool | None] | None = None, block: int = FIRST_BLOCK, cancelled: Callable[[], bool] | None = None) -> dict:
    """Statistics of one repository. Files are read and scored in tasks, in the seeded order, a block at a time; only the
    blocks' step rows (numbers) reach the driver, which goes through them file by file and stops where the estimate does.

    on_progress gets the statistics after the selection and after each file; a false return cancels there. cancelled (by
    default on_progress's attribute of that name) is asked while jobs run, and ends them: what is then known is returned."""
    cancelled = cancelled or getattr(on_progress, "cancelled", None)
    stats, s = dict(NOTHING), begin(0)
    try:
        with interruptible(spark, cancelled):
            for stats, s in walk_through(spark, accessor, config, seed, score, max_bytes, max_files, block):
                if on_progress is not None and on_progress(stats | report(s)) is False and s["stop"] is None:
                    return stats | report(s) | {"stop_reason": "cancelled"}
    except Exception:
        if cancelled is None or not cancelled():
            raise
        return stats | report(s) | {"stop_reason": "cancelled"}
    return stats | report(s) | ({} if s["total"] else {"stop_reason": "all_files_scanned"})


def walk_through(spark: SparkSession, accessor: Accessor, config: estimate.Sampling, seed: int, score: Callable[[DataFrame], DataFrame], max_bytes: int, max_files: int, block: int) -> Iterator[tuple[dict, dict]]:
    """The selection's counters and the running state, after the selection and after each file up to the stop."""
    listed = entries(spark, accessor, prune=lambda n: n.startswith(".") or n in S.SCAN_DIRECTORIES).cache()
    ordered = None
    try:
        found = selection.selection_stats(listed, max_bytes, max_files).drop("repo").first()
        stats = found.asDict() if found else dict(NOTHING)
        s = begin(stats["files_selected"])
        yield stats, s
        if not s["total"]:
            return
        ordered = sampling.sampled(selection.candidates(listed, max_bytes=max_bytes, max_files=max_files), seed).cache()
        tasks = spark.sparkContext.defaultParallelism
        low, high = 0, block
        while s["stop"] is None:
            here = ordered.where((F.col("step") > low) & (F.col("step") <= high)).repartition(tasks)
            for row in sorted(score(read(here, accessor)).select(*STEP).collect(), key=lambda r: r["step"]):  # at most max_files rows of numbers
                advance(s, row.asDict(), config)
                yield stats, s
                if s["stop"]:
                    return
            low, high = high, high * 2
    finally:
        if ordered is not None:
            ordered.unpersist()
        listed.unpersist()


NOTHING = {"files_seen": 0, "files_selected": 0, "files_skipped_extension": 0, "files_skipped_pattern": 0, "files_skipped_too_large": 0, "directories_pruned": 0, "directories_errored": 0, "truncated": False}
