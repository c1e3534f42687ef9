"""Session, storage and Arrow helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text in one Arrow batch; documents can be long, so the default of 10,000 is too many.
BATCH_ROWS = 1000
#: Bytes in memory (by size_bound) up to which a side is broadcast.
BROADCAST = 32 << 20


def tune(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and, where Spark knows the setting, by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir. Only one machine by itself (local master, as in tests)
    may leave it unset and gets a temporary folder; a cluster without it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = getattr(shared_dir, "own", None)
        if root is None or not os.path.isdir(root):
            root = shared_dir.own = tempfile.mkdtemp(prefix="lodestone-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
        root = "file://" + root
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


_made: set[str] = set()  # folders that stored() of this process wrote; nothing else is ever removed
_scratch: list[list[str]] = []


#: Spark then removes an execution's shuffle files at its end, else the driver's garbage collection does some time.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what runs inside go as soon as it ends. For writes only: a frame that runs again would shuffle again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors, and leaves no
    shuffle files behind."""
    spark = df.sparkSession
    path = new_path(spark, name)
    _made.add(path.rsplit("/", 1)[1])
    if _scratch:
        _scratch[-1].append(path)
    with shuffles_removed(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def folders(df: DataFrame) -> dict[str, str]:
    """The stored() folders that a frame reads: name to path."""
    paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    return {p.rsplit("/", 1)[1]: p for p in paths if p.rsplit("/", 1)[1] in _made}


def drop_stored(df: DataFrame) -> None:
    """Removes every stored() folder that df reads; for callers that have written or consumed df."""
    for p in folders(df).values():
        delete(df.sparkSession, p)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Removes what stored() wrote inside the block, but for the folders read by the frames put into the list."""
    keep: list[DataFrame] = []
    _scratch.append([])
    try:
        yield keep
    finally:
        paths = _scratch.pop()
        held = set().union(*map(folders, keep)) if keep else set()
        for p in paths:
            if p.rsplit("/", 1)[1] not in held:
                delete(spark, p)
            elif _scratch:
                _scratch[-1].append(p)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name with as many underscores before it as keep it apart from df's columns, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the text, null text as the empty text. Other columns are never read."""
    return docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """mapInArrow with make() called once a task; the function it gives maps lists by column to lists by column."""
    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for b in batches:
            if b.num_rows:
                step = step or make()
                out = step(b.to_pydict())
                yield pa.RecordBatch.from_pydict({n: out[n] if isinstance(out[n], pa.Array) else pa.array(out[n], TYPES[t]) for n, t in zip(names, types, strict=True)})

    types = [p.split(" ", 1)[1] for p in schema.split(", ")]
    return df.mapInArrow(run, schema)


TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}


def size_bound(df: DataFrame) -> int:
    """An upper bound of the bytes that df's rows take in memory: 16 a field, and 8 a character of a row as JSON, in
    which any number, character or array element takes one at least."""
    row = F.length(F.to_json(F.struct(*map(quoted, df.columns)), {"ignoreNullFields": "false"}))
    return df.agg(F.sum(8 * row + 16 * len(df.columns)).alias("b")).first()["b"] or 0


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most: int = BROADCAST) -> DataFrame:
    """Joins a side that is usually small: written and measured first, broadcast only up to most bytes, else joined by shuffle."""
    small = stored(small, "side")
    return big.join(F.broadcast(small) if size_bound(small) <= most else small.hint("merge"), on, how)
