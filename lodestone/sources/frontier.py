"""Trees listed level by level: folders are a table, listed in tasks and joined with those visited before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tree import Accessor, AccessError, real_path

LISTED = "repo string, path string, is_dir boolean, size bigint, errored boolean, real string, enter boolean"
FOLDERS = "repo string, path string, real string"
NAMES = [c.split()[0] for c in LISTED.split(", ")]
KINDS = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.bool_(), pa.string(), pa.bool_()]


def listing(folders: DataFrame, accessors: dict[str, Accessor], prune: Callable[[str], bool] | None) -> DataFrame:
    """The entries of folders (repo, path, real), listed in tasks. enter marks folders to be listed next, real is what they are.
    A folder that cannot be listed gives itself, errored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for repo, at in zip(b.column("repo").to_pylist(), b.column("path").to_pylist(), strict=True):
                accessor = accessors[repo]
                try:
                    found = accessor.list_dir(at)
                except AccessError:
                    rows.append((repo, at, True, None, True, None, False))
                    continue
                for e in found:
                    path, is_dir = e["name"] if at == "." else f"{at}/{e['name']}", e["entry_type"] == "dir"
                    enter = is_dir and not (prune and prune(e["name"]))
                    rows.append((repo, path, is_dir, e["size"], False, real_path(accessor, path) if enter else None, enter))
                    if len(rows) >= 10000:
                        yield table(rows)
                        rows = []
        if rows:
            yield table(rows)

    return folders.select("repo", "path").mapInArrow(run, LISTED)


def table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)


def listed(spark: SparkSession, accessors: dict[str, Accessor], prune: Callable[[str], bool] | None = None) -> DataFrame:
    """repo, path, is_dir, size, errored of several trees. prune(name) keeps the listing out of folders, which still have a row.

    A level is one job: its folders, dealt over tasks by path, are listed and the entries checkpointed; the folders among
    them, one path a real folder (the first by name), without those of earlier levels are the next level. So a
    folder that links lead to is visited once, under its shortest path, and cycles end. Only the levels' counts reach
    the driver. A root that cannot be listed is an error."""
    level = spark.createDataFrame([(r, ".", real_path(a, ".")) for r, a in accessors.items()], FOLDERS)
    visited, out, more = level, None, True
    while more:
        rows = cut_lineage(listing(level.repartition(F.col("repo"), F.col("path")), accessors, prune))
        if out is None:
            lost = rows.where("errored").select("repo").first()  # the first level's folders are the roots
            if lost:
                accessors[lost["repo"]].list_dir(".")
                raise AccessError("io", f"{lost['repo']}: the root could not be listed in a task")
        out = rows if out is None else out.unionByName(rows)
        found = rows.where("enter").groupBy("repo", "real").agg(F.min("path").alias("path"))
        level = cut_lineage(found.join(visited, ["repo", "real"], "left_anti").select("repo", "path", "real"))
        visited = visited.unionByName(level)
        more = not level.isEmpty()
    bad = out.where("errored").select("repo", "path", F.lit(True).alias("bad"))
    every = out.where("NOT errored").drop("errored", "real", "enter").join(bad, ["repo", "path"], "left")
    return every.select("repo", "path", "is_dir", "size", F.coalesce("bad", F.lit(False)).alias("errored"))


def entries(spark: SparkSession, accessor: Accessor, repo: str = "repo", prune: Callable[[str], bool] | None = None) -> DataFrame:
    """listed() of one tree."""
    return listed(spark, {repo: accessor}, prune)
