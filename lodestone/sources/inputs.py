"""Texts that a command line names: code itself, files, folders or standard input."""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from pathlib import Path
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from . import code_tree


class InputError(ValueError):
    pass


def shown(path: str | Path, base: str | Path | None = None) -> str:
    """A path relative to the working folder where it lies in it, else as it is."""
    try:
        return str(Path(path).resolve().relative_to(Path(base or os.getcwd()).resolve()))
    except ValueError:
        return str(path)


def collected(spark: SparkSession, paths: list[str] = (), code: str | None = None, stdin: BinaryIO | None = None) -> DataFrame:
    """file_id (the name shown), position and normalised text of every input. Folders give their code files, listed and read
    in tasks, as are named files; position is the input's number and the path's components below it.

    An input that is missing, blank, binary or not UTF-8 is an InputError, as is no input at all, or '-' twice."""
    pipe = stdin or getattr(sys.stdin, "buffer", None)
    given: list[tuple[str, int, bytearray | None]] = []  # contents that only the driver has, else files to be read
    folders: list[tuple[str, int]] = []
    if code is not None:
        given = [("<argument>", 0, bytearray(code.encode("utf-8", "surrogatepass")))]
    elif not paths:
        if pipe is None or (hasattr(pipe, "isatty") and pipe.isatty()):
            raise InputError("a file, a folder, code or standard input is expected")
        given = [("<stdin>", 0, bytearray(pipe.read()))]
    else:
        if list(map(str, paths)).count("-") > 1:
            raise InputError("standard input may be named once only")
        for i, p in enumerate(map(str, paths)):
            if p == "-":
                given.append(("<stdin>", i, bytearray(pipe.read())))
            elif Path(p).is_dir():
                folders.append((p, i))
            elif Path(p).is_file():
                given.append((p, i, None))
            else:
                raise InputError(f"{p}: no such file")
    place = lambda i, parts: F.struct(F.lit(i).alias("input") if isinstance(i, int) else F.col(i).alias("input"), parts.alias("path"))
    made = read_in_tasks(spark.createDataFrame(given, "file_id string, i int, content binary")).select("file_id", place("i", F.array().cast("array<string>")).alias("position"), "content")
    for p, i in folders:
        found = code_tree.code_tree(spark, {"input": p}, where=F.col("language").isNotNull()).where(P.prep_selected("path"))
        made = made.unionByName(found.select(F.concat(F.lit(p.rstrip("/") + "/"), "path").alias("file_id"), place(i, F.split("path", "/")).alias("position"), "content"))
    clean = T.normalized(made.select("file_id", "position", T.decoded("content").alias("text")))
    bad = clean.where(F.coalesce(T.stripped_length("text") < 1, F.lit(True))).orderBy("position").first()
    if bad:
        raise InputError(f"{bad['file_id']}: " + ("binary or not UTF-8" if bad["text"] is None else "empty"))
    if clean.isEmpty():
        raise InputError("no code files found")
    return clean


def read_in_tasks(files: DataFrame) -> DataFrame:
    """Rows (file_id, i, content); contents that are null are read from the file of that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [code_tree.read(n) if c is None else c for n, c in zip(b.column("file_id").to_pylist(), b.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("i"), pa.array(data, pa.binary())], ["file_id", "i", "content"])

    return files.mapInArrow(run, files.schema)
