"""JSON Lines: checked reading, and writing with nulls, one file a split."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S


def sound(full: bool = True):
    """Whether a record may be used: a label of 0 or 1 and a language, and for training (full) a text too."""
    good = F.col("label").isin(0, 1) & (F.length("language") > 0)
    return F.coalesce(good & F.col("text").isNotNull() if full else good, F.lit(False))


def read(spark: SparkSession, path: str, schema: str = S.CHUNKS, full: bool = True) -> DataFrame:
    """Fails on malformed lines and on records that are not sound(); blank lines are skipped. problems() says where."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df.where(F.when(sound(full), True).otherwise(F.raise_error(F.concat(F.lit("bad record: "), F.to_json(F.struct("*"))).cast("string")).cast("boolean")))


def quarantine(df: DataFrame, full: bool = True) -> DataFrame:
    """The records that read() would fail on."""
    return df.where(~sound(full))


def problems(spark: SparkSession, path: str, full: bool = True) -> DataFrame:
    """path, line (from 1) and problem of every line that read() would fail on.

    Lines are numbered without a sort: lines of a file's earlier blocks, then the place within the block."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = lines.groupBy("path", "at").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = blocks.select("path", "at", "first", (F.sum("n").over(Window.partitionBy("path").orderBy("at")) - F.col("n")).alias("before"))
    record = F.from_json("value", "text string, label string, language string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    made = lines.where(F.trim("value") != "").join(before, ["path", "at"]).select("path", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), record.alias("r"))
    r = lambda c: F.col("r").getField(c)
    what = F.when(r("_bad").isNotNull(), "not JSON").when(~F.coalesce(F.length(r("language")) > 0, F.lit(False)), "language").when(~F.coalesce(r("label").isin("0", "1"), F.lit(False)), "label")
    if full:
        what = what.when(r("text").isNull(), "text")
    return made.select("path", "line", what.alias("problem")).where("problem IS NOT NULL")


def write(df: DataFrame, folder: str, order: list | None = None, splits: tuple[str, ...] | list[str] = S.SPLITS, observed: Observation | None = None, **counters: Column) -> None:
    """One file {split}.jsonl a split with compact lines in the given order, null fields too, on any file system of the session.

    All splits are sorted and written by one job, whose committer leaves no part of a lost task; the parts of a split are
    then joined in their order beside the file and renamed once, so a file is there whole or not at all. counters are
    observed on the rows as they are written."""
    spark = df.sparkSession
    parts = f"{folder.rstrip('/')}/_parts-{uuid.uuid4().hex}"
    wanted = df.where(F.col("split").isin(list(splits))).withColumn("_split", F.col("split"))
    rows = wanted.orderBy("_split", *(order or []))
    rows = rows.observe(observed, *[c.alias(n) for n, c in counters.items()]) if observed is not None else rows
    try:
        rows.select(*S.CHUNK_COLUMNS, "_split").write.partitionBy("_split").option("ignoreNullFields", "false").json(parts)
        for split in splits:
            joined(spark, f"{parts}/_split={split}", f"{folder.rstrip('/')}/{split}.jsonl")
    finally:
        path, fs = located(spark, parts)
        fs.delete(path, True)


def located(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, as the session's Hadoop configuration has them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replaced(spark: SparkSession, target: str, fill: Callable) -> None:
    """A file that fill(stream, file system) writes, under another name until it is whole."""
    path, fs = located(spark, target)
    fresh, _ = located(spark, f"{target}.{uuid.uuid4().hex}.tmp")
    try:
        stream = fs.create(fresh, True)
        try:
            fill(stream, fs)
        finally:
            stream.close()
        fs.delete(path, True)
        if not fs.rename(fresh, path):
            raise OSError(f"{target} could not be renamed into place")
    finally:
        fs.delete(fresh, False)


def joined(spark: SparkSession, parts: str, target: str) -> None:
    """The part files of a folder, in the order of their names, as one file; none or no folder give an empty file."""
    folder, fs = located(spark, parts)
    files = sorted((f.getPath() for f in fs.listStatus(folder)), key=lambda p: p.getName()) if fs.exists(folder) else []

    def fill(stream, fs) -> None:
        for f in files:
            source = fs.open(f)
            try:
                spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, 1 << 20, False)
            finally:
                source.close()

    replaced(spark, target, fill)


def write_summary(spark: SparkSession, summary: dict, path: str) -> None:
    text = json.dumps(summary, indent=2, ensure_ascii=False) + "\n"
    replaced(spark, path, lambda stream, _: stream.write(bytearray(text.encode("utf-8"))))
