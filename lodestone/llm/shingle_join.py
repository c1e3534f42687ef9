"""N-gram Jaccard join by token-combination prefixes, to connected components.

Tokens are distinct word 5-shingles, as 64-bit hashes; documents with the same set are one node. For a set of
n tokens at most tau = n - ceil(t n) can be missing from a linked set, so two prefixes in a common order that
are long enough must share a signature:

1. A third of the token universe is counted over all documents. A node with more than tau tokens that no
   other node has cannot link and leaves. (Any part of the universe gives a valid bound.)
2. Among the nodes left all tokens are counted. Order: unique tokens, rare ones (at most RARE nodes) by
   count, frequent ones by hash. Rare tokens are signatures by themselves. Frequent tokens are dealt to m
   classes by hash and their 2-combinations within a class are signatures; the prefix is extended until
   unique + rare + sum over classes of (tokens - 1) > tau, when one whole signature must be shared. m follows
   the larger set's size, so that a class has a few tokens and combinations grow with the set, not its square.
3. Signature groups give candidate pairs, verified on whole sets by size(array_intersect). A group first
   meets its pivot only (a star, linear in the group); verified links are contracted to components; groups
   within one component are done. Rounds of stars with other pivots go on while they find links, then all
   pairs of a group that are still in different components are verified. No link can be missed: a pair is
   left out only where both are already in one component.

Words are maximal runs of other than ASCII white space after lower-casing A-Z. Fewer than five words make one
shingle of the whole sequence; no words, or null text, make an empty set that links with nothing. Sets and shingles
are compared by 64-bit hash: of 1e9 different sets 0.03 pairs are expected to clash.

Rows with a null doc_id link like others, and connect others, but have no name: a component's id is the smallest
doc_id there is, null where there is none. Repeated rows get the same answer each; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .collocations import Bitmap, spread
from .common import drop_stored, fresh, join_small, map_rows, quoted, scratch, stored, texts

WORDS = 5
PERCENT = 75
RARE = 32
UNIVERSE = 0.34  # part of the token universe that step 1 counts
STARS = 2
FIRSTS = 16
BITS = 16  # longs of a node's bitmap
SLOTS = 1 << 25  # bits of a bitmap of ids
M64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixer(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix constants)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


BYTE = mixer(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
STEPS = mixer(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)  # odd factors of the words of a shingle
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i below n, grown as needed."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.empty(size, np.uint64)
            p[0] = 1
            done = 1
            while done < size:
                step = np.uint64(pow(b, done, 1 << 64))
                p[done : 2 * done] = p[:done] * step
                done *= 2
            _powers[k] = p
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of the lower-cased text: a polynomial over its bytes, by prefix sums."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(LOWER), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    word = np.concatenate([[False], ~SPACE[raw], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, stop = edge[::2], edge[1::2]
    up, down = powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[raw] * up[:-1], dtype=np.uint64)])
    return mixer((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(n, len(w))
    k = len(w) - n + 1
    h = w[:k] * STEPS[0]
    for i in range(1, n):
        h += w[i : k + i] * STEPS[i]
    h = mixer(h + np.uint64(n))
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def node_of(s: np.ndarray) -> int:
    """A 64-bit name of a set, signed."""
    if not len(s):
        return 0
    up, _ = powers(len(s))
    return int(mixer(np.array([int((s * up).sum(dtype=np.uint64)) ^ len(s)], np.uint64)).view(np.int64)[0])


def slack(n: int, percent: int = PERCENT) -> int:
    """tau: tokens of a set of n that a linked set may lack."""
    return n - -(-n * percent // 100)


def members(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node of every document; equal sets have equal nodes."""

    def make():
        def step(x):
            sets = [shingles(t) for t in x["text"]]
            return {"doc_id": x["doc_id"], "n_shingles": [len(s) for s in sets], "node": [node_of(s) for s in sets]}

        return step

    return map_rows(texts(docs, "doc_id"), "doc_id long, n_shingles long, node long", make)


def tokens(docs: DataFrame, universe: float = 1.0) -> DataFrame:
    """token, node of the tokens in the lowest part of the universe."""
    bound = np.uint64(min(M64, int(universe * 2**64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, names = [], []
            for t in b.column("text").to_pylist():
                s = shingles(t)
                held.append(s[: np.searchsorted(s, bound, "right")])
                names.append(np.full(len(held[-1]), node_of(s), np.int64))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64)), pa.array(np.concatenate(names))], ["token", "node"])

    return texts(docs).mapInArrow(run, "token long, node long")


def alive(docs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, n, doc_id (one holder, null if all are nameless) of the nodes that may link: no more unshared tokens than
    the slack, and large enough to link with a set of one token more."""
    lonely = tokens(docs, UNIVERSE).groupBy("token").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other").groupBy("node").agg(F.count("*").alias("lonely"))
    sets = nodes.where("n_shingles > 0").groupBy("node").agg(F.first("n_shingles").alias("n"), F.min("doc_id").alias("doc_id"))
    return sets.join(lonely, "node", "left").where(F.coalesce("lonely", F.lit(0)) <= F.col("n") - F.ceil(F.col("n") * percent / 100)).where(F.lit(100) * F.col("n") >= percent * (F.col("n") + 1)).select("node", "n", "doc_id")


def bitmap(ids: DataFrame, size: int = SLOTS) -> Bitmap:
    """The bitmap of the one long column of ids, null as 0. At most size / 64 rows of two numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = spread(unsigned(b.column(0)), size)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["slot", "bits"])

    t = ids.mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[t["slot"].to_numpy()] = t["bits"].to_numpy().view(np.uint64)
    return Bitmap(bits)


def unsigned(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)


def sets_of(docs: DataFrame, kept: DataFrame, size: int = SLOTS) -> DataFrame:
    """node, tokens (sorted array) of the kept nodes, from one holder's text each.

    Texts are not shuffled: tasks know the holders' ids and the kept nodes by bitmaps, which miss none, and make the
    sets of what they let through; a join by node drops the rest."""
    spark = docs.sparkSession
    shared = [spark.sparkContext.broadcast(bitmap(kept.select(c), size).bits) for c in ("doc_id", "node")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders, nodes = (Bitmap(s.value) for s in shared)
        seen: set[int] = set()  # of rows with equal sets one is enough, whichever
        for b in batches:
            held, names = [], []
            for t in b.filter(pa.array(holders.has(unsigned(b.column("doc_id"))))).column("text").to_pylist():
                s = shingles(t)
                name = node_of(s)
                if name not in seen and nodes.has(np.array([name], np.int64).view(np.uint64))[0]:
                    seen.add(name)
                    held.append(s)
                    names.append(name)
            if held:
                ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.ListArray.from_arrays(ends, np.concatenate(held).view(np.int64))], ["node", "tokens"])

    made = texts(docs, "doc_id").mapInArrow(run, "node long, tokens array<long>")
    return made.join(kept.select("node"), "node", "left_semi").dropDuplicates(["node"])


def levels(n: int, percent: int = PERCENT) -> list[int]:
    """The size levels at which a set of n is indexed: those of the larger sets that it may link with."""
    return list(range(n.bit_length(), (n * 100 // percent).bit_length() + 1))


def signatures(unique: int, rare: list[int], frequent: list[int], n: int, level: int, percent: int = PERCENT) -> list[int]:
    """Signature hashes of one set at one level. rare and frequent are in the common order."""
    need = slack(n, percent) + 1 - unique
    out: list[int] = []
    for t in rare:
        if need <= 0:
            return out
        out.append(t * 31 + level & M64)
        need -= 1
    m = max(1, (1 << level) // 16)
    classes: dict[int, list[int]] = {}
    for t in frequent:
        if need <= 0:
            break
        seen = classes.setdefault((t >> 20 & 0xFFFFFFFF) % m, [])
        if seen:
            need -= 1
            out += [(min(t, u) * BASE + max(t, u)) * 33 + level & M64 for u in seen]
        seen.append(t)
    return out


def indexed(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """signature, node, n of every signature that at least two nodes share.

    Counts combine before the shuffle; the way back to the rows is a plain equi-join, whose skewed keys
    adaptive execution splits. A node's list is bounded by its own set."""
    rows = sets.select("node", F.explode("tokens").alias("token"))
    df = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token", F.least(F.col("df"), F.lit(RARE + 1)).cast("int").alias("df"))
    df = stored(df, "counts")  # the counting's shuffle is gone before the rows are shuffled twice
    shared = rows.join(df, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    listed = shared.select("node", F.col("shared.token").alias("shared"), F.size(F.filter("shared", lambda s: s["df"] <= RARE)).alias("rare"))
    sized = listed.join(sets.select("node", F.size("tokens").alias("n")), "node")

    def make():
        def step(x):
            out = {"signature": [], "node": [], "n": []}
            for node, n, shared, k in zip(x["node"], x["n"], x["shared"], x["rare"], strict=True):
                found: set[int] = set()
                for level in levels(n, percent):
                    found.update(signatures(n - len(shared), shared[:k], shared[k:], n, level, percent))
                out["signature"] += [s - (1 << 64) if s >> 63 else s for s in found]
                out["node"] += [node] * len(found)
                out["n"] += [n] * len(found)
            return out

        return step

    made = stored(map_rows(sized.select("node", "n", "shared", "rare"), "signature long, node long, n int", make), "signatures")
    drop_stored(df)
    twice = made.groupBy("signature").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("signature")
    return made.join(twice, "signature")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("i"), (F.size("x") + F.size("y") - both).alias("u")).where(F.lit(100) * F.col("i") >= F.lit(percent) * F.col("u")).select("a", "b")


def bitmaps(sets: DataFrame) -> DataFrame:
    """node, z0 .. z15: a bit for the hash of each token. A bit of one set that another lacks stands for a missing token."""

    def make():
        def step(x):
            out = {"node": x["node"]} | {f"z{i}": [] for i in range(BITS)}
            for t in x["tokens"]:
                bits = np.zeros(64 * BITS, np.uint8)
                bits[(np.array(t, np.int64) >> 24) & (64 * BITS - 1)] = 1
                for i, v in enumerate(np.packbits(bits).view(">i8").tolist()):
                    out[f"z{i}"].append(v)
            return out

        return step

    return map_rows(sets.select("node", "tokens"), "node long, " + ", ".join(f"z{i} long" for i in range(BITS)), make)


def bounded(n: str, m: str, percent: int = PERCENT) -> str:
    """SQL on z0.. and y0..: neither set provably lacks more of the other's tokens than sets of n and m may:
    linked sets share at least t (n + m) / (1 + t)."""
    lacks = lambda a, b: " + ".join(f"bit_count({a}{i} & ~{b}{i})" for i in range(BITS))
    least = f"(({n} + {m}) * {percent} + {99 + percent}) DIV {100 + percent}"
    return f"{lacks('z', 'y')} <= {n} - {least} AND {lacks('y', 'z')} <= {m} - {least}"


def connected(edges: DataFrame) -> DataFrame:
    """id, root (smallest id reachable) of every id in the edges (a, b): smallest labels by rounds, with pointer jumps."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        better = labels.join(near, "id").select("id", F.least("root", "near").alias("step"), "root")
        jump = better.alias("x").join(labels.select(F.col("id").alias("step"), F.col("root").alias("far")), "step", "left")
        moved = stored(jump.select("id", F.least("step", F.coalesce("far", "step")).alias("new"), F.col("root").alias("old")), "labels")
        if not moved.where("new < old").limit(1).count():
            return labels
        labels = moved.select("id", F.col("new").alias("root"))


def similar(column_a: str, column_b: str, percent: int = PERCENT) -> str:
    return f"100 * least({column_a}, {column_b}) >= {percent} * greatest({column_a}, {column_b})"


def linked_components(index: DataFrame, sets: DataFrame, percent: int = PERCENT, stars: int = STARS) -> DataFrame:
    """node, comp of every indexed node: components under all links."""
    index = stored(index, "index")
    comp = stored(index.select("node", F.col("node").alias("comp")).distinct(), "comp")
    tested: DataFrame | None = None

    def merge(candidates: DataFrame) -> bool:
        nonlocal comp, tested
        fresh = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        fresh = stored(fresh if tested is None else fresh.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = fresh if tested is None else tested.unionByName(fresh)
        links = stored(verified(fresh, sets, percent), "links")
        if not links.limit(1).count():
            return False
        own = comp.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        other = comp.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        roots = connected(links.join(own, "a").join(other, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a != b"))
        comp = stored(comp.join(roots.select(F.col("id").alias("comp"), "root"), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "comp")
        return True

    # placed: the index with each node's component; a signature within one component is done and leaves
    placed = index.withColumn("comp", F.col("node"))
    for turn in range(stars):
        pivot = F.min_by(F.struct("node", "n", "comp"), F.xxhash64("node", F.lit(turn))).alias("p")
        open_ = placed.groupBy("signature").agg(F.min("comp").alias("c"), F.max("comp").alias("d"), pivot).where("c < d").select("signature", F.col("p.node").alias("b"), F.col("p.n").alias("m"), F.col("p.comp").alias("pc"))
        found = merge(placed.join(open_, "signature").where("comp != pc AND " + similar("n", "m", percent)).select(F.col("node").alias("a"), "b"))
        now = placed.drop("comp").join(comp, "node")
        still = now.groupBy("signature").agg(F.min("comp").alias("c"), F.max("comp").alias("d")).where("c < d").select("signature")
        placed = stored(now.join(still, "signature"), "open")
        if not found:
            break
    # what is left: members outside a group's largest component against all members in other components
    closed = placed
    parts = closed.groupBy("signature", "comp").agg(F.count("*").alias("k"))
    largest = parts.groupBy("signature").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("signature", "main")
    held = closed.join(largest, "signature")
    # a pair comes once, at the first of its shared signatures; FIRSTS a node are enough to tell for nearly all pairs
    firsts = held.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("signature")), 1, FIRSTS).alias("zs"))
    placed = stored(held.join(bitmaps(sets).join(firsts, "node"), "node"), "placed")
    minor = placed.where("comp != main").select("signature", F.col("node").alias("b"), F.col("n").alias("m"), F.col("comp").alias("pc"), F.col("zs").alias("ys"), *[F.col(f"z{i}").alias(f"y{i}") for i in range(BITS)])
    once = " AND coalesce(array_min(array_intersect(zs, ys)), signature) = signature"
    merge(placed.join(minor, "signature").where("comp != pc AND " + similar("n", "m", percent) + " AND " + bounded("n", "m", percent) + once).select(F.col("node").alias("a"), "b"))
    return comp


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    component_id is the smallest doc_id reachable by links; rows without shingles stand alone."""
    with scratch(docs.sparkSession) as keep:
        nodes = stored(members(docs), "members")
        kept = stored(alive(docs, nodes, percent), "alive")  # the counting's shuffle is gone before texts are shuffled
        sets = stored(sets_of(docs, kept), "sets")
        comp = linked_components(indexed(sets, percent), sets, percent)
        named = nodes.join(comp, "node", "left").select("doc_id", "n_shingles", F.coalesce("comp", "node").alias("comp"))
        full = named.where("n_shingles > 0")
        roots = full.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        grouped = full.join(roots, "comp").select("doc_id", "n_shingles", "component_id")
        out = grouped.unionByName(named.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
        keep.append(out)
    return out


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id.

    Of rows that share the kept doc_id the first by text stays; rows whose doc_id is null all stay, as nothing names
    them. Only the ids that go or repeat meet the texts, by broadcast while they are few (bounded), else by a
    shuffled join."""
    count, stays, nth = fresh(docs, "n_rows", "stays", "nth")
    columns = [*map(quoted, docs.columns)]
    table = components(docs, percent).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias(count))
    changed = stored(table.where((F.col("doc_id") != F.col("c")) | (F.col(count) > 1)).select("doc_id", (F.col("doc_id") == F.col("c")).alias(stays)), "changed")
    rows = join_small(docs, changed, ["doc_id"], "left").where(F.col(stays).isNull() | F.col(stays))
    if not changed.where(F.col(stays)).limit(1).count():
        return rows.select(*columns)
    first = rows.where(F.col(stays)).withColumn(nth, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(nth) == 1)
    return rows.where(F.col(stays).isNull()).select(*columns).unionByName(first.select(*columns))
