"""Power-of-two packing: each document is cut into binary-length pieces, and equal lengths are bucketed.

A document of n ids gives floor(n / 1024) pieces of 1024 and one piece for each one-bit of the rest, the
longest first. A piece is a sequence by itself: its length is a power of two, so there is no padding and no
sequence crosses documents. Sequence ids run through the buckets, the longest bucket first: bucket bases
over all pieces, then part bases within a bucket, then a piece's place within its part. Only (part, bucket)
counts are summed; pieces are never sorted globally. Parts are those of the written piece table, so a task
that is run again gives the same ids.

Null text counts as empty (the end id alone); repeated rows are packed each by itself; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, stored, texts
from .tokens import encoder

LENGTH = 1024
PIECE = "part int, place int, doc_id long, start long, length int, ids binary, doc_tokens long"


def cut(n: int, most: int = LENGTH) -> list[int]:
    """The piece lengths of n ids: whole sequences, then the binary digits of the rest from the top."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = LENGTH) -> DataFrame:
    """The written piece table. place counts a part's pieces of the same length from 0."""
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, enc = TaskContext.get().partitionId(), {}, encoder(tokenizer)
        for b in batches:
            out: dict[str, list] = {n: [] for n in ("place", "doc_id", "start", "length", "ids", "doc_tokens")}
            for k, ids in zip(b.column("doc_id").to_pylist(), enc.ids(b.column("text").to_pylist()), strict=True):
                ids += end
                at, total = 0, len(ids) // 4
                for n in cut(total, length):
                    place = seen[n] = seen.get(n, -1) + 1
                    for name, v in zip(out, (place, k, at, n, ids[4 * at : 4 * (at + n)], total), strict=True):
                        out[name].append(v)
                    at += n
            kinds = {"place": pa.int32(), "doc_id": pa.int64(), "start": pa.int64(), "length": pa.int32(), "ids": pa.binary(), "doc_tokens": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(out["place"]), pa.int32()), *(pa.array(v, kinds[n]) for n, v in out.items())], ["part", *out])

    return stored(texts(docs, "doc_id").mapInArrow(run, PIECE), "pieces", compression="zstd")


def sequences(table: DataFrame) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: one row a piece of a piece table.

    Bases are summed over one row a part and bucket: with 100,000 parts a million rows, apart by bucket."""
    counts = table.groupBy("length", "part").agg(F.count("*").alias("n"))
    buckets = counts.groupBy("length").agg(F.sum("n").alias("total"))
    bases = buckets.select("length", (F.sum("total").over(Window.orderBy(F.col("length").desc())) - F.col("total")).alias("bucket_base"))
    parts = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("part_base"))
    starts = parts.join(bases, "length").select("length", "part", (F.col("bucket_base") + F.col("part_base")).alias("base"))
    return join_small(table, starts, ["length", "part"]).select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids", "doc_tokens", (F.col("base") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = LENGTH) -> DataFrame:
    return sequences(pieces(docs, tokenizer, end_id, length))
