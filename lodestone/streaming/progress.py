"""Live progress of repository scans: step rows stream in, running estimates stream out."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators.estimate import Sampling
from ..session import checkpoint_folder

STEP = "repo string, population int, step int, status string, chunks bigint, ai_chunks bigint, probability_sum double, is_ai boolean"
OUT = "repo string, step int, population bigint, files_scanned bigint, files_generated bigint, files_errored bigint, files_ai bigint, files_human bigint, chunks_scanned bigint, chunks_ai bigint, chunks_human bigint, fraction double, half_width double, low double, high double, mean_probability double, stop_reason string, stalled boolean"
NAMES = [x.split()[0] for x in OUT.split(", ")]


def begin(population: int) -> dict:
    """The running sums before the first step. total stays, population shrinks by what cannot be scanned."""
    return dict.fromkeys(("step", "n", "m", "a", "mm", "ma", "aa", "ai", "generated", "errored"), 0) | {"p": 0.0, "population": population, "total": population, "stop": None, "fraction": None, "width": None}


def advance(s: dict, row: dict, c: Sampling) -> None:
    """One step in running sums (whole numbers, so the order of arrival within a step is all that counts)."""
    s["step"] += 1
    if row["status"] != "scanned":
        s["population"] -= 1
        s[row["status"]] += 1
    else:
        m, a = int(row["chunks"]), int(row["ai_chunks"])
        for k, v in (("n", 1), ("m", m), ("a", a), ("mm", m * m), ("ma", m * a), ("aa", a * a), ("ai", int(bool(row["is_ai"])))):
            s[k] += v
        s["p"] += float(row["probability_sum"])
    s["fraction"], s["width"] = estimate(s, c.z)
    if s["width"] is not None and s["n"] >= c.min_files and s["width"] <= c.target:
        s["stop"] = "precision_reached"
    elif s["m"] >= c.max_chunks:
        s["stop"] = "chunk_budget_exhausted"
    elif s["step"] == s["total"]:
        s["stop"] = "all_files_scanned"


def report(s: dict) -> dict:
    """The counters and the estimate of a running state, by their public names."""
    f, w = s["fraction"], s["width"]
    return {
        "step": s["step"], "population": s["population"], "files_scanned": s["n"], "files_generated": s["generated"], "files_errored": s["errored"], "files_ai": s["ai"], "files_human": s["n"] - s["ai"],
        "chunks_scanned": s["m"], "chunks_ai": s["a"], "chunks_human": s["m"] - s["a"], "fraction": f, "half_width": w, "low": None if f is None else max(0.0, f - w), "high": None if f is None else min(1.0, f + w),
        "mean_probability": s["p"] / s["m"] if s["m"] else None, "stop_reason": s["stop"],
    }


def estimate(s: dict, z: float) -> tuple[float | None, float | None]:
    n, big, m, a = s["n"], s["population"], s["m"], s["a"]
    if not m or (n < big and n < 2):
        return None, None
    if n >= big:
        return a / m, 0.0
    num = m * m * s["aa"] - 2 * a * m * s["ma"] + a * a * s["mm"]
    return a / m, z * max(0.0, (1 - n / big) * n * num / (n - 1)) ** 0.5 / m**2


SUMS = "step long, population long, total long, n long, m long, a long, mm long, ma long, aa long, ai long, generated long, errored long, p double"
SUM_NAMES = [x.split()[0] for x in SUMS.split(", ")]
WAITING = "status string, chunks long, ai_chunks long, probability_sum double, is_ai boolean"
WAIT_NAMES = [x.split()[0] for x in WAITING.split(", ")]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Estimate(StatefulProcessor):
    """A repository's running sums as a typed value, and steps that came early as a map by step.

    Steps are taken in their order, whatever the order in which they come; at the stop both states are removed, and a mark
    drops what still comes. With stall (milliseconds) the mark expires after `keep` milliseconds, and a repository that gives no
    rows for that long while it is open reports again, with stalled true."""

    def __init__(self, config: Sampling, stall: int | None, keep: int):
        self.config, self.stall, self.keep = config, stall, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", SUMS)
        self.early = handle.getMapState("early", "step long", WAITING)
        self.done = handle.getValueState("done", "step long", ttlDurationMs=self.keep if self.stall else None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            for _ in rows:
                pass
            return
        s, fresh = self._sums(), {}
        for f in rows:
            s = s or begin(int(f["population"].iloc[0]))
            late = f["step"] > s["step"]  # a step that was taken before is a repeat
            for row in f[late].to_dict("records"):
                fresh[int(row["step"])] = (row["status"], *(int(row[k] or 0) for k in ("chunks", "ai_chunks")), float(row["probability_sum"] or 0), bool(row["is_ai"]))
        while s["stop"] is None:
            step = s["step"] + 1
            row = fresh.pop(step, None)
            if row is None:
                row = self.early.getValue((step,)) if self.early.containsKey((step,)) else None
                if row is None:
                    break
                self.early.removeKey((step,))
            advance(s, dict(zip(WAIT_NAMES, row, strict=True)), self.config)
        if self.stall:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if s["stop"]:
            self.sums.clear()
            self.early.clear()
            self.done.update((s["step"],))
        else:
            for step, row in fresh.items():
                self.early.updateValue((step,), row)
            self.sums.update(tuple(s[k] for k in SUM_NAMES))
            if self.stall:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stall)
        yield shown(key[0], s, False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._sums()
        if s:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stall)
            yield shown(key[0], s, True)

    def _sums(self) -> dict | None:
        if not self.sums.exists():
            return None
        s = begin(0) | dict(zip(SUM_NAMES, self.sums.get(), strict=True))
        s["fraction"], s["width"] = estimate(s, self.config.z)
        return s

    def close(self) -> None:
        pass


def shown(repo: str, s: dict, stalled: bool) -> pd.DataFrame:
    return pd.DataFrame([{"repo": repo} | {k: v for k, v in report(s).items() if k in NAMES} | {"stalled": stalled}])


def progress(steps: DataFrame, config: Sampling = Sampling(), stall: int | None = None, keep: int = 86_400_000) -> DataFrame:
    """A streaming frame of the newest progress of each repository, in update mode. The session's state goes to RocksDB from here on.

    With stall the stream has timers: it then runs batches without rows too, so processAllAvailable() would not return."""
    steps.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return steps.groupBy("repo").transformWithStateInPandas(Estimate(config, stall, keep), OUT, "update", "ProcessingTime" if stall else "None")


def last_progress(steps: DataFrame, config: Sampling = Sampling()) -> DataFrame:
    """The last progress of each repository of a stream that ends, as a batch frame.

    Each micro-batch is a folder of its own in the shared folder, so a batch that is run again replaces itself."""
    spark = steps.sparkSession
    folder = f"{checkpoint_folder(spark).rstrip('/')}/progress-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    q = progress(steps, config).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(sink).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.read.schema(OUT).parquet(f"{folder}/out").where("NOT stalled")
    left = [F.col(x) for x in NAMES if x != "repo"]
    return rows.groupBy("repo").agg(F.max_by(F.struct(*left), "step").alias("r")).select("repo", "r.*")


def events(steps: DataFrame, emit: Callable[[str, dict], bool | None], config: Sampling = Sampling(), checkpoint: str | None = None):
    """Starts the stream and hands events to emit(kind, data): 'progress' as they come, then one 'complete' a repository,
    or one 'error' with repo null if the stream breaks. A false return stops the stream (cancelled) after the
    micro-batch. Micro-batches are bounded by the reader (maxFilesPerTrigger): that is the backpressure."""
    holder: dict = {}

    def sink(batch: DataFrame, _: int) -> None:
        for r in batch.toLocalIterator():
            if emit("complete" if r["stop_reason"] else "progress", r.asDict()) is False:
                holder["cancelled"] = True
        if holder.get("cancelled") and "query" in holder:
            holder["query"].stop()

    def guarded(batch: DataFrame, n: int) -> None:
        try:
            sink(batch, n)
        except Exception as e:
            emit("error", {"repo": None, "message": str(e)})
            raise

    checkpoint = checkpoint or f"{checkpoint_folder(steps.sparkSession).rstrip('/')}/events-{uuid.uuid4().hex}"
    holder["query"] = progress(steps, config).writeStream.outputMode("update").foreachBatch(guarded).option("checkpointLocation", checkpoint).start()
    return holder["query"]
