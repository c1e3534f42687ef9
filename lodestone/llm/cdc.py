"""Substring dedup by content-defined chunks: a gear rolling hash cuts, digests find what repeats.

A byte is the last of a chunk where the gear hash of the 16 bytes up to it falls below a threshold, or
where a chunk reaches MOST bytes. Cuts depend on the last 16 bytes only, so an insertion shifts nothing
beyond the chunks it touches. Chunks are compared by 64-bit digest over the whole corpus: one that occurs in
two documents repeats. Chunks are short (28 bytes on average), so that a passage of 50 words holds several
whole ones; a repeat is a gapless run of repeating chunks of at least LEAST bytes in all, so that a chance
clash of digests (one expected in 6e9 chunks) must meet neighbours that repeat to show at all.

Chunks are made once for the digests and once for the places: they take three times the text's size, and
cutting again costs less than writing and reading them.

Defined results: null text counts as empty and has no chunks; rows that share a doc_id are one document, so
copies among them are no repeats, and repeated rows (same id, same text) give their passages once; a null doc_id
is no document; an exact copy of a text repeats as a whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, quoted, scratch, stored, texts

MEAN = 28
MOST = 448
LEAST = 80
WINDOW = 16


def gear_table() -> np.ndarray:
    """256 random 16-bit numbers from a 64-bit mixer of the byte."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((x ^ x >> np.uint64(31)) >> np.uint64(48)).astype(np.uint16)


GEAR = gear_table()


def rolling(raw: bytes) -> np.ndarray:
    """The gear hash at each byte: h = 2 h + GEAR[byte] in 16 bits, so 16 bytes back; by doubling, not byte by byte."""
    h = GEAR[np.frombuffer(raw, np.uint8)]
    k = 1
    while k < WINDOW:
        g = h.copy()
        g[k:] += h[:-k] << np.uint16(k)
        h, k = g, 2 * k
    return h


def cuts(raw: bytes, mean: int = MEAN, most: int = MOST) -> np.ndarray:
    """Chunk ends in a byte string, the last one its length."""
    if not raw:
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(rolling(raw) < np.uint16(65536 // mean)) + 1
    if not len(ends) or ends[-1] != len(raw):
        ends = np.append(ends, len(raw))
    starts = np.concatenate([[0], ends[:-1]])
    if (ends - starts).max() > most:
        ends = np.concatenate([np.append(np.arange(s + most, e, most), e) for s, e in zip(starts, ends, strict=True)])
    return ends


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and row, a 64-bit hash that tells the texts of one doc_id apart."""
    return texts(docs, "doc_id").withColumn("row", F.xxhash64("text"))


def chunks(docs: DataFrame, mean: int = MEAN, most: int = MOST) -> DataFrame:
    """digest, doc_id, row, place: place packs the start in the text and 9 bits of the length."""
    import xxhash

    if most > 511:
        raise ValueError("chunks have at most 511 bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            held: list[tuple] = []
            size = 0
            for k, t, row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "row")), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                ends = cuts(raw, mean, most)
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                d = np.fromiter((digest(raw[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(ends))
                held.append((d, k, row, (starts.astype(np.int64) << 9) + (ends - starts)))
                size += len(ends)
                if size > 100_000:
                    yield batch(held)
                    held, size = [], 0
            if size:
                yield batch(held)

    def batch(held: list[tuple]) -> pa.RecordBatch:
        ids, rows = (pa.concat_arrays([pa.repeat(pa.scalar(h[i], pa.int64()), len(h[0])) for h in held]) for i in (1, 2))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[0] for h in held]).view(np.int64)), ids, rows, pa.array(np.concatenate([h[3] for h in held]))], ["digest", "doc_id", "row", "place"])

    return keyed(docs).mapInArrow(run, "digest long, doc_id long, row long, place long")


def repeating(table: DataFrame) -> DataFrame:
    """digest, first_doc, last_doc of every chunk that two documents hold; combined before the shuffle."""
    return table.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc")


def passages(docs: DataFrame, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> DataFrame:
    """The rows of repeats() with row, the text's hash."""
    table = chunks(docs.where("doc_id IS NOT NULL"), mean, most)
    marked = table.join(repeating(table), "digest").select("doc_id", "row", F.expr("shiftright(place, 9)").alias("at"), F.expr("place & 511").alias("size"), "first_doc", "last_doc")
    by_doc = Window.partitionBy("doc_id", "row").orderBy("at")
    # chunks of one text lie apart, so the same start again is a repeated row
    once = marked.withColumn("again", F.lag("at").over(by_doc).eqNullSafe(F.col("at"))).where("NOT again")
    own = F.col("doc_id") == F.col("first_doc")
    fresh_ = F.when(F.lag(F.col("at") + F.col("size")).over(by_doc) == F.col("at"), 0).otherwise(1)
    turn = F.when((F.col("fresh") == 0) & F.lag("in_first").over(by_doc).eqNullSafe(F.col("in_first")), 0).otherwise(1)
    runs = once.withColumns({"fresh": fresh_, "in_first": own}).withColumn("turn", turn).withColumns({"run": F.sum("fresh").over(by_doc), "part": F.sum("turn").over(by_doc)})
    ends = (F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"), F.sum("n_chunks").alias("n_chunks"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"), F.first("in_first").alias("in_first"))
    size = F.col("end_byte") - F.col("start_byte")
    parts = runs.withColumns({"start_byte": F.col("at"), "end_byte": F.col("at") + F.col("size"), "n_chunks": F.lit(1)}).groupBy("doc_id", "row", "run", "part").agg(*ends)
    parts = parts.withColumn("in_first", F.col("in_first") | (size < least))
    by_run = Window.partitionBy("doc_id", "row", "run").orderBy("start_byte")
    turn = F.when(F.lag("in_first").over(by_run).eqNullSafe(F.col("in_first")), 0).otherwise(1)
    joined = parts.withColumn("turn", turn).withColumn("part", F.sum("turn").over(by_run)).groupBy("doc_id", "row", "run", "part").agg(*ends)
    return joined.where(size >= least).select("doc_id", "row", "start_byte", "end_byte", "n_chunks", "first_doc", "last_doc", "in_first")


def repeats(docs: DataFrame, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> DataFrame:
    """One row a repeated part of a passage: doc_id, start_byte, end_byte, n_chunks, first_doc and last_doc (documents
    that share its chunks), in_first (this is the copy to keep).

    A gapless run of repeating chunks is parted where its chunks go from those that a smaller doc_id holds to those
    that none does. Of the former a part of under `least` bytes is a phrase, and stays with what it is in; so every
    chunk stays in its own first document, and each run of `least` bytes has a part of as many."""
    return passages(docs, least, mean, most).drop("row")


def without(text: str, spans: list) -> str:
    """A text without byte spans (in order, apart), each shrunk to whole characters."""
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    inside = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    for i, j in spans:
        while i < j and inside(i):
            i += 1
        while j > i and inside(j):
            j -= 1
        out.append(raw[at:i])
        at = j
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def cut_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with the parts of passages that documents of smaller doc_id hold removed; all columns and rows stay.

    Cuts belong to a text, so rows that share a doc_id lose their own passages only. Whole characters stay or go;
    null texts and rows without a doc_id stay as they are."""
    row, spans = fresh(docs, "row", "spans")
    with scratch(docs.sparkSession) as keep:
        found = stored(passages(docs, least).where("NOT in_first").groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("start_byte", "end_byte"))).alias("spans")), "cuts")
        keep.append(found)

    @F.pandas_udf("string")
    def cut(t, s):
        import pandas as pd

        return pd.Series([without(x, [(c["start_byte"], c["end_byte"]) for c in y]) for x, y in zip(t, s, strict=True)], dtype=object)

    # only texts with cuts reach Python
    d = docs.withColumn(row, F.xxhash64(F.coalesce("text", F.lit(""))))
    x, y = d.alias("x"), found.alias("y")
    joined = x.join(y, (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col(f"x.{row}") == F.col("y.row")), "left").select("x.*", F.col("y.spans").alias(spans))
    whole = joined.where(F.col(spans).isNull()).select(*map(quoted, docs.columns))
    return whole.unionByName(joined.where(F.col(spans).isNotNull()).withColumn("text", cut("text", spans)).select(*map(quoted, docs.columns)))
