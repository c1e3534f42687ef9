"""Phrase collocation mining with depth-limited count tries.

1. A task reads texts into blocks of a language and builds each block's count trie, at most four words deep: a node is
   (parent node, word), so a level is one sort of packed pairs. The trie is written as its sorted nodes, (path, count).
2. Tries are merged by prefix range: a range exchange over paths sorts the shards' runs together, and counts of equal
   paths add up.
3. Phrases that reach `least` hold only words and pairs that reach it, so tries grow by levels: words first, then pairs
   of such words, then phrases of three and four words whose pairs all reach it. Tasks know those words and pairs by
   a bitmap of BITS bits (4 MiB, whatever the corpus). A bitmap never misses one; those that it lets through besides
   only make more nodes. All counts are exact.
4. A walk over the merged nodes in path order keeps the ancestors on a stack: these are the left parts of every cut.
   At a range's start they may lie in an earlier range; each range writes its last path, at most four rows, for those.
   Right parts are the nodes of a path's suffixes, found by a join (the suffix links).

A path is the language and the words, joined by the byte 0, in which bytes 0 and 1 are escaped (1 1 and 1 2): the order
of bytes is the order of a walk. Null text counts as empty, null language as `und`; texts are split at bytes, so any
bytes are taken. A very long text is read in parts that overlap by three words. Repeated rows count as often as they occur; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_small, stored

DEPTH = 4
BLOCK = 8 << 20  # bytes of text a block
BITS = 1 << 25
NODE = "path binary, n long"
STOP = b"."
TO_STOP = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes.maketrans(string.ascii_uppercase.encode() + TO_STOP + b"\t", string.ascii_lowercase.encode() + STOP * len(TO_STOP) + b" ")
EDGE = re.compile(b"[ .]")
UP = np.uint64(0x9E3779B97F4A7C15)


def escaped(word: bytes) -> bytes:
    return word.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1") if b"\0" in word or b"\1" in word else word


def plain(word: bytes) -> bytes:
    return word.replace(b"\1\1", b"\0").replace(b"\1\2", b"\1") if b"\1" in word else word


def tokens(raw: bytes) -> list[bytes]:
    """Words of a translated text, with STOP at each piece's end. No word holds a STOP."""
    return raw.replace(STOP, b" . ").split()


def parts(raw: bytes, most: int) -> Iterator[bytes]:
    """A translated text in parts of about `most` bytes that end at the edge of a word."""
    at = 0
    while len(raw) - at > most:
        edge = EDGE.search(raw, at + most)
        if edge is None:
            break
        yield raw[at : edge.start()]
        at = edge.start()
    yield raw[at:]


def hashes(lang: bytes, words: list[bytes]) -> np.ndarray:
    seed = zlib.crc32(lang)
    return np.fromiter((zlib.crc32(w, seed) for w in words), np.uint64, len(words))


def spread(h: np.ndarray, bits: int) -> np.ndarray:
    """Positions below bits, a power of two."""
    return ((h + np.uint64(1)) * UP) >> np.uint64(65 - bits.bit_length())


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << np.uint64(32) | b) ^ (a * UP >> np.uint64(17))


class Bitmap:
    """Positions of 64-bit hashes."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, h: np.ndarray) -> np.ndarray:
        at = spread(h, 64 * len(self.bits))
        return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def counted(packed: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, the counts of those rows where `of`, and the node of each row."""
    keys, node = np.unique(packed, return_inverse=True)
    return keys, np.bincount(node[of], minlength=len(keys)), node


class Trie:
    """A block's trie. Phrases that lie in the first `skip` tokens are not counted: the part before has them."""

    def __init__(self, lang: bytes, enc: pa.DictionaryArray, skip: int):
        order = pc.sort_indices(enc.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        self.vocabulary = enc.dictionary.take(order)
        self.ids, self.skip, self.lang = rank[enc.indices.to_numpy()], skip, lang
        self.text = self.vocabulary.to_pylist()
        self.real = np.fromiter((w != STOP for w in self.text), bool, len(self.text))

    def paths(self, nodes: list[np.ndarray]) -> pa.Array:
        """The paths of nodes given by their words' ids."""
        names = pa.array([escaped(w) for w in self.text], pa.binary())
        columns = [names.take(pa.array(i)) for i in nodes]
        return pc.binary_join_element_wise(pa.scalar(escaped(self.lang), pa.binary()), *columns, pa.scalar(b"\0", pa.binary()))

    def words(self) -> list[tuple[pa.Array, np.ndarray]]:
        n = np.bincount(self.ids[self.skip :], minlength=len(self.text)) * self.real
        at = np.flatnonzero(n)
        return [(self.paths([at]), n[at])]

    def pairs(self, known: Bitmap) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of pairs of known words; distinct packed pairs, their counts, and the node of each start."""
        good = (self.real & known.has(hashes(self.lang, self.text)))[self.ids]
        s = np.flatnonzero(good[:-1] & good[1:])
        return s, *counted(self.ids[s] << 32 | self.ids[s + 1], s + 2 > self.skip)

    def two(self, known: Bitmap) -> list[tuple[pa.Array, np.ndarray]]:
        _, keys, n, _ = self.pairs(known)
        return [(self.paths([keys >> 32, keys & 0xFFFFFFFF]), n)]

    def deep(self, known: Bitmap, joined: Bitmap) -> list[tuple[pa.Array, np.ndarray]]:
        """Phrases of three words and more, all of whose pairs are known."""
        s, keys, _, node = self.pairs(known)
        h = hashes(self.lang, self.text)
        nodes = [keys >> 32, keys & 0xFFFFFFFF]
        kept = joined.has(pair_hash(h[nodes[0]], h[nodes[1]]))[node]
        at = np.full(len(self.ids) + DEPTH, -1, np.int64)  # node of the phrase of the present depth that starts here
        linked = np.zeros(len(at), bool)
        at[s[kept]], linked[s[kept]] = node[kept], True
        out = []
        for depth in range(3, DEPTH + 1):
            s = np.flatnonzero(at >= 0)
            s = s[linked[s + depth - 2]]
            keys, n, node = counted(at[s] << 32 | self.ids[s + depth - 1], s + depth > self.skip)
            nodes = [*(x[keys >> 32] for x in nodes), keys & 0xFFFFFFFF]
            at[:] = -1
            at[s] = node
            out.append((self.paths(nodes), n))
        return out


def encoded(words: list[bytes]) -> pa.DictionaryArray:
    return pa.array(words, pa.binary()).dictionary_encode()


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[bytes, pa.DictionaryArray, int]]:
    """(language, encoded tokens, tokens to skip); the tokens themselves are let go before the trie is built. Texts of a language are put together up to `most` bytes, of all languages up to four times as many."""
    held: dict[bytes, list[bytes]] = {}
    size: dict[bytes, int] = {}

    def out(lang: bytes) -> tuple[bytes, pa.DictionaryArray, int]:
        size.pop(lang)
        return lang, encoded(tokens(STOP.join(held.pop(lang)) + STOP)), 0

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            text = text.translate(TABLE)
            if len(text) > most:
                tail: list[bytes] = []
                for p in parts(text, most):
                    skip, words = len(tail), tail + tokens(p)
                    tail, enc = words[1 - DEPTH :], encoded(words)
                    del words
                    if len(enc):
                        yield lang, enc, skip
                continue
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text) + 1
            if size[lang] >= most:
                yield out(lang)
            elif sum(size.values()) >= 4 * most:
                yield out(max(size, key=size.get))
    for lang in sorted(held):
        yield out(lang)


def tries(docs: DataFrame, name: str, most: int, *bitmaps: Bitmap) -> DataFrame:
    """The written nodes of all blocks' tries: words, two or deep, by name."""
    spark = docs.sparkSession
    t = docs.select(F.coalesce("lang", F.lit("und")).cast("binary").alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    shared = [spark.sparkContext.broadcast(b.bits) for b in bitmaps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Bitmap(s.value) for s in shared]
        for lang, enc, skip in blocks(batches, most):
            for path, n in getattr(Trie(lang, enc, skip), name)(*known):
                rows = pa.RecordBatch.from_arrays([path, pa.array(n, pa.int64())], ["path", "n"]).filter(pa.array(n > 0))
                for i in range(0, rows.num_rows, 1 << 16):
                    yield rows.slice(i, 1 << 16)

    return stored(t.mapInArrow(run, NODE), name, compression="zstd")


def merged(nodes: DataFrame) -> DataFrame:
    """Nodes by prefix range, equal paths added."""
    return nodes.repartitionByRange("path").groupBy("path").agg(F.sum("n").alias("n"))


def fields(path: bytes) -> list[bytes]:
    return [plain(x) for x in path.split(b"\0")]


def bitmap(nodes: DataFrame, size: int = BITS) -> Bitmap:
    """The bitmap of merged words or pairs. At most size / 64 rows of two numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fields(p) for p in b.column("path").to_pylist()]
            h = np.array([[zlib.crc32(w, zlib.crc32(f[0])) for w in f[1:]] for f in found], np.uint64).reshape(len(found), -1)
            at = spread(pair_hash(h[:, 0], h[:, 1]) if h.shape[1] == 2 else h[:, 0], size) if len(found) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["slot", "bits"])

    t = nodes.select("path").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[t["slot"].to_numpy()] = t["bits"].to_numpy().view(np.uint64)
    return Bitmap(bits)


# kind 0: a cut of a phrase after k words; 1: a phrase inside a longer one of n; 2: a node of a range's last path
WALK = "kind int, path binary, lang binary, phrase binary, k int, n long, head binary, l long, rest binary"


def walked(nodes: DataFrame) -> DataFrame:
    """The written walk over merged nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in WALK.split(", ")]
        kinds = [pa.int32(), *[pa.binary()] * 3, pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        stack: list[tuple[bytes, int]] = []
        for b in batches:
            rows = []
            for path, n in zip(b.column("path").to_pylist(), b.column("n").to_pylist(), strict=True):
                while stack and not path.startswith(stack[-1][0] + b"\0"):
                    stack.pop()
                counts = dict(stack)
                lang, *words = path.split(b"\0")
                join = lambda x: b"\0".join([lang, *x])  # noqa: E731, B023
                if len(words) > 1:
                    own = fields(path)
                    for k in range(1, len(words)):
                        head = join(words[:k])
                        rows.append((0, path, own[0], b" ".join(own[1:]), k, n, head, counts.get(head), join(words[k:])))
                for size in range(2, len(words)):
                    rows.extend((1, join(words[i : i + size]), None, None, None, n, None, None, None) for i in range(len(words) - size + 1))
                stack.append((path, n))
            if rows:
                yield batch(rows)
        if stack:
            yield batch([(2, path, None, None, None, n, None, None, None) for path, n in stack])

    return stored(nodes.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(run, WALK), "walk")


def scored(nodes: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of phrases of two words and more, without those that a longer one covers."""
    walk = walked(nodes)
    ends = walk.where("kind = 2").select(F.col("path").alias("head"), F.col("n").alias("_l")).distinct()
    cuts = join_small(walk.where("kind = 0").drop("kind"), ends, ["head"], "left").withColumn("l", F.coalesce("l", "_l"))
    cuts = cuts.join(nodes.select(F.col("path").alias("rest"), F.col("n").alias("r")), "rest")
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"cast(2000000 as decimal(7, 0)) * {wide('n')} div ({wide('l')} + {wide('r')})")
    best = cuts.withColumn("score", score).groupBy("path", "lang", "phrase", F.col("n").alias("a")).agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    inside = walk.where("kind = 1").groupBy("path").agg(F.max("n").alias("longest"))
    free = F.expr(f"longest IS NULL OR 100 * {wide('longest')} < 80 * {wide('a')}")
    return best.join(inside, "path", "left").where(free).select(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), "a", "m.l", "m.r", "m.score")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of two to four words."""
    words = stored(merged(tries(docs, "words", block)), "merged-words")
    frequent = words.where(F.col("n") >= least)
    known = bitmap(frequent, bits)
    pairs = stored(merged(tries(docs, "two", block, known)).where(F.col("n") >= least), "merged-pairs")
    deep = merged(tries(docs, "deep", block, known, bitmap(pairs, bits))).where(F.col("n") >= least)
    ranked = scored(stored(frequent.unionByName(pairs).unionByName(deep), "nodes"))
    w = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    first = ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return join_small(first, totals(words), ["lang"]).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def totals(words: DataFrame) -> DataFrame:
    """lang, n: all word occurrences, from the merged words (languages with bytes 0 and 1 as they are)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = [plain(p.split(b"\0", 1)[0]) for p in b.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.binary()), b.column("n")], ["lang", "n"])

    return words.mapInArrow(run, "lang binary, n long").groupBy(F.col("lang").cast("string").alias("lang")).agg(F.sum("n").alias("n"))
