"""Step rows of a scan as a stream: the format `steps` and the frames it replays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from ..session import cut_lineage
from .progress import STEP


@dataclass
class Range(D.InputPartition):
    low: int
    high: int

    def __post_init__(self):
        super().__init__(None)


class StepStream(D.DataSourceStreamReader):
    """Offsets are steps: a micro-batch takes the next `per_batch` steps up to `last`, as `tasks` partitions.

    With `most`, a micro-batch takes as many steps as all before it, `per_batch` at least and `most` at most: a long
    repository then needs few micro-batches, each of which costs a fixed time and a look through all rows.

    Spark asks for the latest offset without saying where the stream is, so the place is kept here, and for runs that go
    on from a checkpoint in the file `place` (any store that Arrow reads), which commits write. It is a batch behind
    at most, so a run that goes on first finds nothing new and then the next steps."""

    def __init__(self, last: int, per_batch: int, tasks: int, place: str | None = None, most: int | None = None):
        self.last, self.per_batch, self.tasks, self.place, self.most = last, per_batch, tasks, place, most or per_batch
        self.at: int | None = None

    def initialOffset(self) -> dict:
        return {"step": 0}

    def latestOffset(self) -> dict:
        at = self._committed() if self.at is None else self.at
        self.at = min(self.last, at + max(self.per_batch, min(at, self.most)))
        return {"step": self.at}

    def _committed(self) -> int:
        if self.place is None:
            return 0
        store, path = fs.FileSystem.from_uri(self.place)
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return 0
        with store.open_input_stream(path) as f:
            return int(f.read())

    def commit(self, end: dict) -> None:
        if self.place is not None:
            store, path = fs.FileSystem.from_uri(self.place)
            with store.open_output_stream(path) as f:
                f.write(str(end["step"]).encode())

    def partitions(self, start: dict, end: dict) -> list[Range]:
        low, high = start["step"], end["step"]
        size = max(1, -(-(high - low) // self.tasks))
        return [Range(i, min(i + size, high)) for i in range(low, high, size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for i in range(partition.low, partition.high, 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(range(i + 1, min(i + (1 << 16), partition.high) + 1), pa.int32())], ["step"])


class Steps(D.DataSource):
    """The data source `steps`: the numbers 1 to `last` as a stream, `per_batch` (64) at a time by `tasks` (1), growing up to `most` (`per_batch`), and the file `place`."""

    @classmethod
    def name(cls) -> str:
        return "steps"

    def schema(self) -> str:
        return "step int"

    def streamReader(self, schema) -> StepStream:
        o = self.options
        return StepStream(int(o["last"]), int(o.get("per_batch", "64")), int(o.get("tasks", "1")), o.get("place"), int(o["most"]) if "most" in o else None)


def replayed(steps: DataFrame, per_batch: int = 64, place: str | None = None, most: int | None = None) -> DataFrame:
    """Step rows (repo, step, status, ...) as a stream of all repositories' steps in order, per_batch steps of each a micro-batch,
    growing up to most.

    Only numbers stream; a micro-batch joins its steps with the checkpointed rows, so backpressure bounds what is taken. place is
    needed by streams that go on from a checkpoint."""
    spark: SparkSession = steps.sparkSession
    spark.dataSource.register(Steps)
    sizes = steps.groupBy("repo").agg(F.count("*").cast("int").alias("population"))
    rows = cut_lineage(steps.join(sizes, "repo").select(*[c.split()[0] for c in STEP.split(", ")]))
    last = rows.agg(F.max("step")).first()[0] or 0
    stream = spark.readStream.format("steps").option("last", str(last)).option("per_batch", str(per_batch))
    stream = stream.option("most", str(most)) if most else stream
    stream = (stream.option("place", place) if place else stream).load()
    return F.broadcast(stream).join(rows, "step").select(rows.columns)  # at most a micro-batch's numbers, so the rows stay where they are
