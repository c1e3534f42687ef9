"""Exact dedup by a minimal perfect hash over the distinct digests of earlier documents.

1. Rows become (doc_id, SHA-256 of the text with A-Z lower-cased) and are counted; from here on texts are not read.
2. Earlier documents' distinct digests are dealt to shards by digest. A task builds a shard's minimal perfect hash: at
   each level the keys left set a bit at their hash; a bit set by one key alone stays and the others go on to the next
   level. A key's slot is the rank of its bit, so n keys have the slots 0 to n - 1 at about 3.7 bits a key. Slots hold
   the full digest, the winner's doc_id and the number of copies.
3. New digests, distinct by an aggregation with partial sums, go to their shard as a sorted stream after its index row.
   A slot whose 32 bytes are equal is a repeat and updates the slot; any other digest is new and stays a group of its
   own. A shard with many more lookups than slots is replicated and its lookups are split by further digest bytes.
4. Groups return to the rows: those with more than HOT rows and more than 1/65,536 of all (so fewer than 65,536 groups)
   by broadcast, all others by a shuffled join.

Texts are equal when their SHA-256 are. Null text counts as empty. Of equal texts the largest doc_id stays; rows
without a doc_id come after all others, and of a row that is repeated as a whole one copy stays. keep_id is null in groups that
have no doc_id at all. An empty table gives no rows, an empty history makes all digests new; other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, texts

SLOTS = 4096  # digests a shard, on average
LOOKUPS = 4  # lookups a slot beyond which a shard is replicated
HOT, SHARE = 1000, 65536
M64 = (1 << 64) - 1
# The public splitmix constants.
GAMMA, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
INDEX = "shard long, shards long, sizes array<int>, bits binary, digests binary, winners binary, named binary, copies binary"
GROUP = "digest binary, doc_id long, n long, known boolean"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(MIX_1)
    x = (x ^ x >> np.uint64(27)) * np.uint64(MIX_2)
    return x ^ x >> np.uint64(31)


def places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each key (four 64-bit words) at a level of `size` bits. Levels take the words in turn."""
    a, b = keys[:, level % 4], keys[:, (level + 1) % 4]
    return (mix(a ^ mix(b + np.uint64((level + 1) * GAMMA & M64))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Levels of bits, one after the other; sizes are multiples of 64."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """The hash of distinct keys; a repeated key is an error."""
        if len(np.unique(keys, axis=0)) != len(keys):
            raise ValueError("keys must be distinct")
        sizes, parts = [], []
        while len(keys):
            size = -(-2 * len(keys) // 64) * 64
            at = places(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            keys = keys[~alone[at]]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, "<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; for others than the built keys any slot, or -1."""
        out, todo, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = start + places(keys[todo], level, size)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[todo[hit]] = self.before[at[hit] >> 6] + below
            todo, start = todo[~hit], start + size
        return out


def keys_of(digests: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4)


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n: rows counted. Only A-Z are lower-cased; in ASCII texts that is what lower() does."""
    t = F.col("text")
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))
    return texts(docs, "doc_id").select("doc_id", F.unhex(F.sha2(low, 256)).alias("digest")).groupBy("doc_id", "digest").agg(F.count("*").alias("n"))


def groups(rows: DataFrame) -> DataFrame:
    """digest, doc_id (the winner), n of rows (doc_id, digest, n)."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n"))


def part(digest: str, first: int, parts: int) -> Column:
    """A part by seven bytes of the digest."""
    return F.conv(F.hex(F.substring(digest, first, 7)), 16, 10).cast("long") % parts


def build_index(history: DataFrame) -> DataFrame:
    """The written index of groups (digest, doc_id, n) with distinct digests: one row a shard."""
    history = stored(history.select("digest", "doc_id", "n"), "history")
    shards = max(1, -(-history.count() // SLOTS))

    def build(t: pa.Table) -> pa.Table:
        keys = keys_of(t["digest"])
        h = PerfectHash.build(keys)
        order = np.argsort(h.slots(keys))
        doc = t["doc_id"].fill_null(0).to_numpy()
        row = [t["shard"][0].as_py(), shards, h.sizes, h.bits.tobytes(), keys[order].tobytes(), doc[order].astype("<i8").tobytes(), t["doc_id"].is_valid().to_numpy()[order].tobytes(), t["n"].to_numpy()[order].astype("<i8").tobytes()]
        names = [c.split()[0] for c in INDEX.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), *[pa.binary()] * 5]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    return stored(history.withColumn("shard", part("digest", 1, shards)).groupBy("shard").applyInArrow(build, INDEX), "index")


class Slots:
    """A shard's table in a task: lookups update winners and copies. Only its first replica counts the history itself."""

    def __init__(self, row: dict, first: bool):
        self.hash = PerfectHash(row["sizes"], np.frombuffer(row["bits"], "<u8"))
        self.keys = np.frombuffer(row["digests"], "<u8").reshape(-1, 4)
        self.doc, self.named = np.frombuffer(row["winners"], "<i8").copy(), np.frombuffer(row["named"], bool).copy()
        self.n = np.frombuffer(row["copies"], "<i8") * first
        self.out = np.full(len(self.n), first)

    def look_up(self, keys: np.ndarray, doc: pa.Array, n: np.ndarray) -> np.ndarray:
        """Which keys are members, byte for byte; they are added to their slots. Keys of one call are distinct."""
        slot = self.hash.slots(keys)
        known = (slot >= 0) & (self.keys[slot] == keys).all(axis=1)
        at, has = slot[known], doc.is_valid().to_numpy(zero_copy_only=False)[known]
        new = doc.fill_null(0).to_numpy()[known]
        self.doc[at] = np.where(has & (~self.named[at] | (new > self.doc[at])), new, self.doc[at])
        self.named[at] |= has
        self.n[at] += n[known]
        self.out[at] = True
        return known

    def rows(self) -> pa.RecordBatch:
        raw = self.keys[self.out].tobytes()
        digests = [raw[i : i + 32] for i in range(0, len(raw), 32)]
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(self.doc[self.out], mask=~self.named[self.out]), pa.array(self.n[self.out]), pa.array([True] * len(digests), pa.bool_())], ["digest", "doc_id", "n", "known"])


def merge(index: DataFrame, new: DataFrame) -> DataFrame:
    """The groups (digest, doc_id, n, known) of the history and new groups together; known: the history has the digest."""
    first = index.select("shards").first()
    if first is None:
        return new.select("digest", "doc_id", "n", F.lit(False).alias("known"))
    shards, new = first["shards"], stored(new.select("digest", "doc_id", "n"), "new")
    copies = max(1, -(-new.count() // (shards * SLOTS * LOOKUPS)))
    replica = index.withColumns({"replica": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))), "kind": F.lit(0)})
    asked = new.withColumns({"shard": part("digest", 1, shards), "replica": part("digest", 8, copies), "kind": F.lit(1)})
    stream = replica.unionByName(asked, allowMissingColumns=True).repartition("shard", "replica").sortWithinPartitions("shard", "replica", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table = None, None
        for b in batches:
            spots = np.stack([b.column("shard").to_numpy(), b.column("replica").to_numpy(), b.column("kind").to_numpy()], 1)
            cuts = [0, *(np.flatnonzero((spots[1:] != spots[:-1]).any(axis=1)) + 1).tolist(), len(spots)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                shard, copy, kind = spots[i].tolist()
                if (shard, copy) != at:
                    if table is not None:
                        yield table.rows()
                    at, table = (shard, copy), None
                if kind == 0:
                    table = Slots(b.slice(i, 1).to_pylist()[0], copy == 0)
                    continue
                digest, doc, n = (b.column(c).slice(i, j - i) for c in ("digest", "doc_id", "n"))
                known = table.look_up(keys_of(digest), doc, n.to_numpy()) if table is not None else np.zeros(j - i, bool)
                other = pa.array(~known)
                fresh = [digest.filter(other), doc.filter(other), n.filter(other)]
                yield pa.RecordBatch.from_arrays([*fresh, pa.array([False] * len(fresh[0]), pa.bool_())], ["digest", "doc_id", "n", "known"])
        if table is not None:
            yield table.rows()

    done = stream.mapInArrow(run, GROUP)
    return done if copies == 1 else done.groupBy("digest").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n"), F.max("known").alias("known"))


def dedup(docs: DataFrame, earlier: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row. earlier marks the documents that make the history
    (over doc_id); by default the lower half of the range of ids. The result does not depend on it."""
    rows = stored(digested(docs), "digests")
    ends = rows.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.sum("n").alias("n")).first()
    if earlier is None:
        earlier = F.col("doc_id") <= ((ends["a"] or 0) + (ends["b"] or 0)) // 2
    past = F.coalesce(earlier, F.lit(False))
    index = build_index(groups(rows.where(past)))
    done = stored(merge(index, groups(rows.where(~past))).select("digest", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size")), "groups")
    big = (F.col("group_size") > HOT) & (F.col("group_size") > (ends["n"] or 0) // SHARE)
    hot = F.broadcast(done.where(big))
    found = rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(done.where(~big).hint("merge"), "digest"))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
