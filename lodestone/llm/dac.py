"""Token files of directly addressable codes: random access to any token without decoding a block.

Ids are split into 8-bit chunks, low chunk first. Level k holds the k-th chunk of every id that has one,
beside a bitmap that tells whether the id goes on at level k + 1, and a rank directory of the bitmap's ones
before each 512-bit block. Token i's chunk at level 0 is at i; its place at the next level is the rank of
its bit. A shard holds whole documents: their ids, the documents' first tokens and their doc_ids.

Files are Parquet shards (part, shard, documents, tokens, code) in ascending doc_id order: rows of part p
come before those of p + 1, shards within a part in turn. Parquet's committer keeps lost executors from
leaving half files, and any store that Spark writes to will do. Documents of the same doc_id stay beside
each other, by text; a null doc_id comes first; null text counts as empty (the end id alone). Parts are ranges of
doc_id, and of the text's first characters too where one doc_id has more than REPEATED rows. An empty table gives
files without rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_small, texts
from .tokens import encoder

BITS = 8
BLOCK = 512  # bits in a block of the rank directory
SHARD_TOKENS = 1 << 18
PART_BYTES = 128 << 20  # of input, in one part
PARTS_MOST = 100_000  # however large Spark's estimate
REPEATED = 10_000
SPREAD = 4  # tasks that may look up positions in one shard
HEAD = 64  # characters of a text that part the rows of one doc_id
MAGIC = b"DAC1"
SHARD = "part int, shard int, documents long, tokens long, code binary"


def pack_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, continuation bits packed from the low bit, ones before each block) of each level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunks = (rest & ((1 << BITS) - 1)).astype(np.uint8)
        more = (rest >> BITS) > 0
        padded = np.concatenate([more, np.zeros(-len(more) % BLOCK, bool)])
        ones = padded.reshape(-1, BLOCK).sum(1, dtype=np.uint32)
        levels.append((chunks, np.packbits(padded, bitorder="little"), np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.zeros(0, "<u4")))
        rest = rest[more] >> BITS
        if not len(rest):
            return levels


def encode_shard(keys: list[int | None], ids: list[bytes]) -> bytes:
    """One shard: magic, counts, doc_ids (with a mask of nulls), first tokens, then the levels."""
    sizes = np.array([len(b) // 4 for b in ids], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)]).astype("<u4")
    levels = pack_levels(np.frombuffer(b"".join(ids), "<u4"))
    out = [MAGIC, struct.pack("<II", len(ids), len(levels)), bytes(k is None for k in keys), np.array([k or 0 for k in keys], "<i8").tobytes(), first.tobytes()]
    for level in levels:
        out.append(struct.pack("<III", *(x.nbytes for x in level)))
        out += [x.tobytes() for x in level]
    return b"".join(out)


class Shard:
    """A shard's arrays, as views of its bytes."""

    def __init__(self, code: bytes):
        if code[:4] != MAGIC:
            raise ValueError("no DAC shard")
        n, levels = struct.unpack_from("<II", code, 4)
        at = 12
        nulls = code[at : at + n]
        at += n
        keys = np.frombuffer(code, "<i8", n, at).tolist()
        self.keys = [None if z else k for z, k in zip(nulls, keys, strict=True)]
        at += 8 * n
        self.first = np.frombuffer(code, "<u4", n + 1, at)
        at += 4 * (n + 1)
        self.levels = []
        for _ in range(levels):
            sizes = struct.unpack_from("<III", code, at)
            at += 12
            level = []
            for size, kind in zip(sizes, (np.uint8, np.uint8, "<u4"), strict=True):
                level.append(np.frombuffer(code, kind, size // np.dtype(kind).itemsize, at))
                at += size
            self.levels.append(tuple(level))

    def __len__(self) -> int:
        return int(self.first[-1])

    def token(self, i: int) -> int:
        """Token i alone: one chunk, one bit and one rank a level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK
            inside = int.from_bytes(bits[block * (BLOCK // 8) : (i >> 3) + 1].tobytes(), "little") & ((1 << (i - block * BLOCK)) - 1)
            i, shift = int(ranks[block]) + inside.bit_count(), shift + BITS
        raise ValueError("continuation beyond the last level")

    def ids(self) -> np.ndarray:
        """All ids, level by level from the top."""
        rest = None
        for chunks, bits, _ in reversed(self.levels):
            value = chunks.astype("<u4")
            if rest is not None:
                value[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] |= rest << BITS
            rest = value
        return rest


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a plan's bytes; for files, their size. 0 where it knows none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, partitions: int | None = None) -> str:
    """Encodes every whole text, appends end_id, and writes the shards in ascending doc_id order."""
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(PARTS_MOST, input_bytes(docs) // PART_BYTES))
    end = struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, held
            row = {"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "documents": pa.array([len(keys)], pa.int64()), "tokens": pa.array([held], pa.int64()), "code": pa.array([encode_shard(keys, ids)], pa.binary())}
            shard, held = shard + 1, 0
            keys.clear()
            ids.clear()
            return pa.RecordBatch.from_pydict(row)

        enc = encoder(tokenizer)
        for b in batches:
            for k, x in zip(b.column("doc_id").to_pylist(), enc.ids(b.column("text").to_pylist()), strict=True):
                keys.append(k)
                ids.append(x + end)
                held += len(x) // 4 + 1
                if held >= SHARD_TOKENS:
                    yield flush()
        if keys:
            yield flush()

    most = docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0
    ranges = ["doc_id"] if most <= REPEATED else ["doc_id", F.substring("text", 1, HEAD)]
    ordered = texts(docs, "doc_id").repartitionByRange(n, *ranges).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, SHARD).write.option("compression", "uncompressed").parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(path)


def document_index(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files.

    Shard starts are summed in two steps: over the parts (one row a part) and over the shards of a part."""
    by_part = files.groupBy("part").agg(F.sum("tokens").alias("size"))
    parts = by_part.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    inside = Window.partitionBy("part").orderBy("shard")
    shards = files.select("part", "shard", "tokens").select("part", "shard", (F.sum("tokens").over(inside) - F.col("tokens")).alias("within"))
    starts = shards.join(parts, "part").select("part", "shard", (F.col("before") + F.col("within")).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, shard, code in zip(b.column("part"), b.column("shard"), b.column("code"), strict=True):
                s = Shard(code.as_py())
                ids, first = s.ids().tobytes(), s.first.tolist()
                n = len(s.keys)
                crc = [zlib.crc32(ids[4 * i : 4 * j]) for i, j in zip(first, first[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part.as_py()] * n, pa.int32()), "shard": pa.array([shard.as_py()] * n, pa.int32()), "doc_id": pa.array(s.keys, pa.int64()), "first": pa.array(first[:-1], pa.int64()), "n_tokens": pa.array(np.diff(first), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    documents = files.select("part", "shard", "code").mapInArrow(decode, "part int, shard int, doc_id long, first long, n_tokens long, ids_crc32 long")
    return join_small(documents, starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def token_at(files: DataFrame, positions: DataFrame) -> DataFrame:
    """position, token: random access to single tokens by position in the whole corpus; null positions and those outside it give no
    row, repeated ones a row each. A shard is parsed once for all its positions."""
    index = files.select("part", "shard", "tokens", "code")
    by_part = index.groupBy("part").agg(F.sum("tokens").alias("size"))
    parts = by_part.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    shards = index.drop("code").join(parts, "part").select("part", "shard", "tokens", (F.col("before") + F.sum("tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("tokens")).alias("base"))
    cell = lambda c: F.floor(c / SHARD_TOKENS)
    spread = shards.withColumn("cell", F.explode(F.sequence(cell(F.col("base")), cell(F.col("base") + F.col("tokens") - 1))))
    hits = positions.select("position", cell(F.col("position")).alias("cell")).join(spread, "cell").where("position >= base AND position < base + tokens").select("part", "shard", "position", (F.col("position") - F.col("base")).alias("at"))
    wanted = index.join(hits.select("part", "shard").distinct(), ["part", "shard"], "left_semi")
    # a shard's code comes before its positions, which stream; many positions in one shard are dealt to SPREAD copies of it
    lane = F.pmod(F.xxhash64("position"), F.lit(SPREAD)).cast("int")
    codes = wanted.select("part", "shard", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("lane"), F.lit(None).cast("long").alias("position"), F.lit(None).cast("long").alias("at"), "code")
    both = codes.unionByName(hits.select("part", "shard", lane.alias("lane"), "position", "at", F.lit(None).cast("binary").alias("code")))
    dealt = both.repartition("part", "shard", "lane").sortWithinPartitions("part", "shard", "lane", F.col("position").asc_nulls_first())

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None
        for b in batches:
            code, p, at = (b.column(c) for c in ("code", "position", "at"))
            places, tokens = [], []
            for i in range(b.num_rows):
                if not p[i].is_valid:
                    here = Shard(code[i].as_py())
                else:
                    places.append(p[i].as_py())
                    tokens.append(here.token(at[i].as_py()))
            yield pa.RecordBatch.from_pydict({"position": pa.array(places, pa.int64()), "token": pa.array(tokens, pa.int64())})

    return dealt.mapInArrow(pick, "position long, token long")
