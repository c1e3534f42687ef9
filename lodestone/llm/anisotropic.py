"""Maximum inner product search with score-aware (anisotropic) quantisation.

Cells come from k-means on a bounded sample; a vector's residual to its cell centre is product-quantised to
16 codes (4 bits) a block of two dimensions. Codebooks and codes minimise eta * |parallel error|^2 +
|orthogonal error|^2, the parallel direction being the vector's own: errors along it change large inner
products most. A query visits the cells whose centres promise most, scans 4-bit codes by table look-ups, and
reranks what may be near exactly in double precision on the original vectors. A cell promises its centre's
inner product and, on top, the maximum to expect from its spread.

A query's own nearest tell when it may stop. First it visits the few cells that held half of the sample's true
neighbours; its `depth`-th best score there is a floor that it need not go below. Then it visits every other cell that
can reach the floor: centre product + |q| * radius * KAPPA, the radius being the largest distance of any row of the cell
from the centre. With KAPPA 1 that bound is sound; KAPPA is the largest part of it that a true neighbour of the sample
used, and a tenth more. Clustered vectors need few cells, so work grows far slower than rows times queries; directions
without clusters need most cells, as for them no partition tells near from far. In a block the same holds of the codes: reranked
are all rows whose product by codes, and the part of the codes' error (stored by row) that the sample's neighbours used, reaches the
floor, so however many near copies share a code, none is left out.

The model is fitted on the driver from at most SAMPLE rows (those of smallest hash) and has bounded size;
every row is indexed. Cells hold about BLOCK rows; a crowded cell becomes several blocks that a query visits all.
Neighbouring blocks make a shard of about SHARD_BYTES (fewer where there would be fewer shards than cores). A query
goes once to each shard with blocks that it visits, and brings back its `depth` nearest of all of them. In a task a
shard's rows come before its queries, which stream: nothing is gathered beyond a shard (about: slices are dealt by
hash). Of rows with one and the same vector only the depth + 1 smallest ids can be
among anyone's nearest, so the others leave before the blocks; that drops no answer.

Inner products exist between vectors of the same dimension only: each dimension has a model, cells and shards of its
own, whatever its size. Dimensions go through one job together as long as their samples fit the bound, others follow in
further jobs. Rows with a null id, null or zero vectors, null
or non-finite components take no part; an empty table gives no rows; other columns are not read. Repeated rows count
once. Rows with the same id and different vectors are one candidate and one query: the nearness of two ids is the
largest inner product between their vectors (of the same dimension).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, scratch, stored

SAMPLE = 16_384
BLOCK = 2048
DEPTH = 20
WIDTH = 2  # dimensions in a quantised block
CODES = 16
THRESHOLD = 0.2  # the share of a vector's norm at which inner products start to matter; sets eta
RERANK = 192  # candidates of a block that are scored exactly before there is a floor
REACH = 0.5  # share of the sample's true neighbours that the cells visited first must have held
KAPPA = 1.1  # how much more of a cell's radius may count than the sample's neighbours used
ASKED = 512  # sample rows that serve as queries for that
CELLS_MOST = 1024
SHARD_BYTES = 16 << 20  # bytes of vectors in a shard, the blocks that one task holds at a time
TASKS = 50_000  # tasks of a scan at most; below that three for each shard, as hashing then seldom puts two into one
TOGETHER = 256  # dimensions of one job at most


def clean(table: DataFrame) -> DataFrame:
    """vec_id and v (array<double>) of the rows that take part, each pair once."""
    v = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(v, x -> x != 0)"
    )
    return rows.dropDuplicates(["vec_id", "v"])


def distinct_enough(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """At most depth + 1 rows of each vector, those of smallest id; limited in each task before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_n") <= depth + 1).drop("_n")


class Model:
    """Centres and anisotropic codebooks."""

    def __init__(self, x: np.ndarray, cells: int, seed: int = 7, rounds: int = 6):
        rng = np.random.default_rng(seed)
        n, d = x.shape
        self.d = d
        self.centres = x[rng.choice(n, min(cells, n), replace=False)].copy()
        for _ in range(rounds):
            near = self.cell(x)
            for c in range(len(self.centres)):
                if (near == c).any():
                    self.centres[c] = x[near == c].mean(0)
        near = self.cell(x)
        size = np.bincount(near, minlength=len(self.centres))
        spread = np.bincount(near, ((x - self.centres[near]) ** 2).sum(1), len(self.centres)) / np.maximum(size, 1) / d
        self.lift = np.sqrt(spread * 2 * np.log(np.maximum(size, 1)))  # what the best of a cell may add, for a query of norm 1
        self.cuts = [(i, min(i + WIDTH, d)) for i in range(0, d, WIDTH)]
        # weight of the parallel error for a threshold t: (d - 1) t^2 / (1 - t^2), at least 1
        self.eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        r = x - self.centres[near]
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.books = []
        for i, j in self.cuts:
            part = r[:, i:j]
            self.books.append(part[rng.choice(n, CODES, replace=n < CODES)].copy())
        for _ in range(rounds):
            codes = self.codes(r, unit)
            self.update(r, unit, codes)

    def cell(self, x: np.ndarray, rows: int = 1024) -> np.ndarray:
        square = (self.centres**2).sum(1)
        return np.concatenate([(square - 2 * x[i : i + rows] @ self.centres.T).argmin(1) for i in range(0, len(x), rows)]) if len(x) else np.zeros(0, np.int64)

    def promise(self, q: np.ndarray) -> np.ndarray:
        """The largest inner product to expect in each cell: the centre's, and the expected maximum of the spread around it."""
        return q @ self.centres.T + np.linalg.norm(q, axis=1, keepdims=True) * self.lift

    def calibrate(self, x: np.ndarray, share: float = REACH, depth: int = DEPTH, asked: int = ASKED) -> None:
        """Sets first, the cells to visit before there is a floor, and kappa and slack, the parts of a cell's radius and of a code's
        error that count, from the true neighbours of `asked` rows among x."""
        cells, ranks, used, missed = self.cell(x), [np.zeros(0, np.int64)], [0.0], [0.0]
        r = x - self.centres[cells]
        err = self.errors(r, self.codes(r, x / np.linalg.norm(x, axis=1, keepdims=True)))
        size = np.linalg.norm(err, axis=1)
        far = np.linalg.norm(x - self.centres[cells], axis=1)
        radius = np.zeros(len(self.centres))
        np.maximum.at(radius, cells, far)
        for i in range(0, len(x), max(1, len(x) // asked)):
            score = x @ x[i]
            score[i] = -np.inf
            near = np.argpartition(-score, min(depth, len(x) - 1) - 1)[:depth] if len(x) > 1 else np.zeros(0, np.int64)
            order = np.empty(len(self.centres), np.int64)
            order[np.argsort(-self.promise(x[i : i + 1])[0], kind="stable")] = np.arange(len(self.centres))
            ranks.append(order[cells[near]])
            room = np.linalg.norm(x[i]) * radius[cells[near]]
            over = score[near] - self.centres[cells[near]] @ x[i]
            used.append(float(np.divide(over, room, out=np.zeros(len(near)), where=room > 0).max(initial=0.0)))
            room = np.linalg.norm(x[i]) * size[near]
            missed.append(float(np.divide(err[near] @ x[i], room, out=np.zeros(len(near)), where=room > 0).max(initial=0.0)))
        ranks = np.concatenate(ranks)
        self.first = int(np.quantile(ranks, share, method="higher")) + 1 if len(ranks) else len(self.centres)
        self.kappa, self.slack = min(1.0, KAPPA * max(used)), min(1.0, KAPPA * max(missed))

    def codes(self, r: np.ndarray, unit: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss |e|^2 + (eta - 1) (e . unit)^2."""
        n, row = len(r), np.arange(len(r))
        out = np.empty((n, len(self.cuts)), np.uint8)
        along = np.zeros(n)  # parallel error of the whole vector
        square, part = [], []
        for b, (i, j) in enumerate(self.cuts):
            x, u, book = r[:, i:j], unit[:, i:j], self.books[b]
            square.append((x**2).sum(1)[:, None] - 2 * x @ book.T + (book**2).sum(1))
            part.append((x * u).sum(1)[:, None] - u @ book.T)
            out[:, b] = square[b].argmin(1)
            along += part[b][row, out[:, b]]
        for _ in range(passes):
            for b in range(len(self.cuts)):
                p = part[b]
                own = p[row, out[:, b]]
                k = (square[b] + (self.eta - 1) * ((along - own)[:, None] + p) ** 2).argmin(1)
                along += p[row, k] - own
                out[:, b] = k
        return out

    def errors(self, r: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([r[:, i:j] - self.books[b][codes[:, b]] for b, (i, j) in enumerate(self.cuts)], 1)

    def update(self, r: np.ndarray, unit: np.ndarray, codes: np.ndarray) -> None:
        """Each code's best point given the others: a linear system of WIDTH unknowns a code."""
        err = self.errors(r, codes)
        for b, (i, j) in enumerate(self.cuts):
            u = unit[:, i:j]
            rest = (err * unit).sum(1) - (err[:, i:j] * u).sum(1)  # parallel error of the other blocks
            for k in range(CODES):
                m = codes[:, b] == k
                if m.any():
                    a = m.sum() * np.eye(j - i) + (self.eta - 1) * u[m].T @ u[m]
                    y = r[m, i:j].sum(0) + (self.eta - 1) * (u[m] * (rest[m] + (r[m, i:j] * u[m]).sum(1))[:, None]).sum(0)
                    self.books[b][k] = np.linalg.solve(a, y)
            err[:, i:j] = r[:, i:j] - self.books[b][codes[:, b]]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries with every code of every block: (queries, blocks * CODES)."""
        return np.concatenate([q[:, i:j] @ self.books[b].T for b, (i, j) in enumerate(self.cuts)], 1)


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Two 4-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
    return codes[:, ::2] | codes[:, 1::2] << 4


def unpack_codes(packed: np.ndarray, blocks: int) -> np.ndarray:
    out = np.empty((len(packed), packed.shape[1] * 2), np.uint8)
    out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
    return out[:, :blocks]


def fit(rows: DataFrame, counts: dict[int, int], sample: int = SAMPLE) -> dict[int, Model]:
    """A model for each dimension from at most `sample` of its rows, those of smallest hash, with a cell for BLOCK rows up to CELLS_MOST."""
    key = F.xxhash64("vec_id", "v")
    part = F.try_element_at(F.create_map(*[F.lit(y) for d, n in counts.items() for y in (d, min(1.0, 1.25 * sample / n))]), F.size("v"))
    t = rows.where(F.pmod(key, F.lit(1 << 20)) < part * (1 << 20)).select("v", F.pmod(key, F.lit(1 << 20)).alias("h"), key.alias("k")).limit(2 * sum(min(n, sample) for n in counts.values())).toArrow()
    size, h, k, out = pc.list_value_length(t["v"]).to_numpy(), t["h"].to_numpy(), t["k"].to_numpy(), {}
    for d, n in counts.items():
        at = np.flatnonzero(size == d)
        at = at[np.lexsort((k[at], h[at]))][:sample]
        x = matrix(t["v"].take(pa.array(at)).combine_chunks())
        out[d] = Model(x, max(1, min(CELLS_MOST, len(x), n // BLOCK)))
        out[d].calibrate(x)
    return out


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(table: DataFrame, queries: str = "vec_id % 20 = 0", depth: int = DEPTH, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score of the ids that meet the SQL condition `queries`, against all rows."""
    spark = table.sparkSession
    with scratch(spark) as keep:
        rows = stored(clean(table), "vectors")
        index = stored(distinct_enough(rows, depth), "candidates")
        counts = {r["d"]: r["n"] for r in index.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()}
        hits, asked = spark.createDataFrame([], "query_id long, vec_id long, score double"), rows.where(queries)
        for own in jobs(counts, sample):
            here = F.size("v").isin(list(own))
            hits = hits.unionByName(approximate(index.where(here), asked.where(here), own, depth, rerank, sample))
        if rows.groupBy("vec_id").count().where("count > 1").limit(1).count():
            hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        out = hits.withColumn("rank", rank).where(F.col("rank") <= depth).select("query_id", "rank", "vec_id", "score")
        keep.append(out)
    return out


def jobs(counts: dict[int, int], sample: int) -> Iterator[dict[int, int]]:
    """The dimensions in groups whose samples together have the size of one."""
    held: dict[int, int] = {}
    for d, n in counts.items():
        if held and (len(held) == TOGETHER or sum(min(x, sample) for x in held.values()) + min(n, sample) > sample):
            yield held
            held = {}
        held[d] = n
    if held:
        yield held


def by_dimension(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    size = pc.list_value_length(b.column("v"))
    for d in pc.unique(size).to_pylist():
        yield d, b.filter(pc.equal(size, d))


class Layout:
    """Where a dimension's cells lie: blocks, numbered so that near cells are neighbours, `per` of them a shard from `shard` on."""

    def __init__(self, model: Model, slices: np.ndarray, radius: np.ndarray, shard: int, tasks: int):
        self.slices, self.radius, self.shard = slices, radius, shard
        self.base, blocks = block_order(model.centres, slices), int(slices.sum())
        self.per = max(1, min(SHARD_BYTES // (8 * model.d * BLOCK), -(-blocks // tasks)))
        self.shards = -(-blocks // self.per)


def approximate(index: DataFrame, asked: DataFrame, counts: dict[int, int], depth: int, rerank: int, sample: int) -> DataFrame:
    """query_id, vec_id, score: of each query and shard that it visits the nearest `depth` ids."""
    spark = index.sparkSession
    models = fit(index, counts, sample)
    shared = spark.sparkContext.broadcast(models)  # bounded: CELLS_MOST centres a sample, and the codebooks

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, own in by_dimension(b):
                m, x = shared.value[d], matrix(own.column("v"))
                cell = m.cell(x)
                r = x - m.centres[cell]
                code = m.codes(r, x / np.linalg.norm(x, axis=1, keepdims=True))
                off, code = np.linalg.norm(m.errors(r, code), axis=1), pack_codes(code)
                columns = [own.column("vec_id"), own.column("v"), pa.array([d] * len(x), pa.int32()), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(np.linalg.norm(r, axis=1)), pa.array(off)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "d", "cell", "code", "far", "off"])

    coded = stored(index.mapInArrow(assign, "vec_id long, v array<double>, d int, cell int, code binary, far double, off double"), "codes")
    slices = {d: np.zeros(len(m.centres), np.int64) for d, m in models.items()}  # blocks of each cell; bounded as the cells are
    radius = {d: np.zeros(len(m.centres)) for d, m in models.items()}
    for r in coded.groupBy("d", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("n"), F.max("far").alias("far")).collect():
        slices[r["d"]][r["cell"]], radius[r["d"]][r["cell"]] = r["n"], r["far"]
    places, shards = {}, 0
    for d, m in models.items():
        places[d] = Layout(m, slices[d], radius[d], shards, spark.sparkContext.defaultParallelism)
        shards += places[d].shards
    laid = spark.sparkContext.broadcast(places)  # three numbers a cell

    layout = spark.createDataFrame([(d, int(c), int(p.slices[c]), int(p.base[c]), p.per, p.shard) for d, p in places.items() for c in np.flatnonzero(p.slices)], "d int, cell int, slices long, base long, per long, first long")
    place = F.col("base") + F.pmod(F.xxhash64("vec_id", "v"), F.col("slices"))
    placed = join_small(coded, layout, ["d", "cell"]).select(
        (F.col("first") + F.floor(place / F.col("per"))).alias("shard"), F.lit(0).alias("kind"), place.alias("block"), "vec_id", "v", "cell", "code", F.col("off").alias("bar"), F.lit(None).cast("array<long>").alias("blocks")
    )

    def route(again: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row for each query and shard that it visits, with the blocks it visits there."""
            for b in batches:
                for d, own in by_dimension(b):
                    m, p, x = shared.value[d], laid.value[d], matrix(own.column("v"))
                    floor = own.column("floor").to_numpy(zero_copy_only=False)  # NaN: fewer than depth found
                    for i in range(0, len(x), 64):
                        q = x[i : i + 64]
                        best = np.argsort(-m.promise(q), axis=1, kind="stable")[:, : m.first]
                        reachable = ~(q @ m.centres.T + np.linalg.norm(q, axis=1, keepdims=True) * p.radius * m.kappa < floor[i : i + 64, None])
                        row, shard, listed = [], [], []
                        for k, cells in enumerate(best):
                            if again:
                                reachable[k, cells] = False
                                cells = np.flatnonzero(reachable[k])
                            seen = np.sort(np.concatenate([np.zeros(0, np.int64), *(np.arange(p.base[c], p.base[c] + p.slices[c]) for c in cells)]))
                            parts = np.split(seen, np.flatnonzero(np.diff(seen // p.per)) + 1) if len(seen) else []
                            row += [i + k] * len(parts)
                            shard += [p.shard + int(x[0] // p.per) for x in parts]
                            listed += parts
                        at = pa.array(row, pa.int64())
                        yield pa.RecordBatch.from_arrays([*(own.column(c).take(at) for c in ("vec_id", "v", "floor")), pa.array(shard, pa.int64()), pa.array(listed, pa.list_(pa.int64()))], ["vec_id", "v", "floor", "shard", "blocks"])

        return run

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, gathered, index = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            shard, kind = b.column("shard").to_numpy(), b.column("kind").to_numpy()
            edge = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
            for s, e in zip([0, *edge], [*edge, b.num_rows], strict=True):
                part = b.slice(s, e - s)
                if shard[s] != here:
                    here, gathered, index = shard[s], [], None
                x, k = matrix(part.column("v")), part.column("vec_id").to_numpy()
                if kind[s] == 0:
                    codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(k), -1)
                    gathered.append((part.column("block").to_numpy(), k, x, codes, part.column("cell").to_numpy(), part.column("bar").to_numpy()))
                    continue
                m = shared.value[x.shape[1]]  # a shard has one dimension
                if index is None:
                    index, gathered = blocks_of(gathered, len(m.cuts)), []
                lut, norm, floor, out = m.tables(x), np.linalg.norm(x, axis=1), part.column("bar").to_numpy(zero_copy_only=False), []
                for i, listed in enumerate(part.column("blocks").to_pylist()):
                    top, bar = (k[:0], x[:0, 0]), -np.inf if np.isnan(floor[i]) else floor[i]
                    for n in listed:
                        if n in index:
                            ids, vecs, flat, cell, off = index[n]
                            found = nearest(ids, vecs, flat, x[i] @ m.centres[cell], off * (norm[i] * m.slack), k[i], x[i], lut[i], depth, rerank, bar)
                            top = best_of(np.concatenate([top[0], found[0]]), np.concatenate([top[1], found[1]]), depth)
                            bar = max(bar, top[1][-1]) if len(top[0]) == depth else bar
                    out.append((np.full(len(top[0]), k[i]), *top))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    def visited(floors: DataFrame, again: bool, name: str) -> DataFrame:
        routed = floors.mapInArrow(route(again), "vec_id long, v array<double>, floor double, shard long, blocks array<long>")
        both = placed.unionByName(routed.select("shard", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("block"), "vec_id", "v", F.lit(0).alias("cell"), F.lit(b"").alias("code"), F.col("floor").alias("bar"), "blocks"))
        dealt = both.repartition(min(3 * shards, TASKS), "shard").sortWithinPartitions("shard", "kind", "block", "vec_id")
        return stored(dealt.mapInArrow(scan, "query_id long, vec_id long, score double"), name)

    hits = visited(asked.select("vec_id", "v", F.lit(None).cast("double").alias("floor")), False, "hits")
    if all(m.first >= len(m.centres) for m in models.values()):
        return hits
    # the depth-th best of a query; an id that several of its vectors found counts once
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    each = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    floors = each.withColumn("n", F.row_number().over(w)).where(F.col("n") == depth).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    return hits.unionByName(visited(join_small(asked, floors, ["vec_id"], "left").select("vec_id", "v", "floor"), True, "more"))


def block_order(centres: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """The number of each cell's first block. Cells are halved again and again at the median of their widest principal
    direction and numbered in that order, so that near cells get neighbouring blocks and share shards."""
    order, todo = [], [np.arange(len(centres))]
    while todo:
        cells = todo.pop()
        if len(cells) == 1:
            order.append(cells[0])
            continue
        x = centres[cells] - centres[cells].mean(0)
        cells = cells[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
        todo += [cells[len(cells) // 2 :], cells[: len(cells) // 2]]
    base = np.empty(len(centres), np.int64)
    base[order] = np.cumsum(slices[order]) - slices[order]
    return base


def blocks_of(parts: list[tuple], width: int) -> dict[int, tuple]:
    """By block: ids, vectors, the place in the look-up table of each code (code blocks first), the cell, and the errors of the codes."""
    if not parts:
        return {}
    block, ids, vecs, codes, cells, off = (np.concatenate(c) for c in zip(*parts, strict=True))
    offset, edge = np.arange(width) * CODES, np.flatnonzero(np.diff(block)) + 1
    return {
        int(block[s]): (ids[s:e], vecs[s:e], np.ascontiguousarray((unpack_codes(codes[s:e], width).astype(np.intp) + offset).T), int(cells[s]), off[s:e])
        for s, e in zip([0, *edge], [*edge, len(block)], strict=True)
    }


def nearest(ids: np.ndarray, vecs: np.ndarray, flat: np.ndarray, centre: float, room: np.ndarray, own: int, q: np.ndarray, lut: np.ndarray, depth: int, rerank: int, bar: float) -> tuple[np.ndarray, np.ndarray]:
    """ids and exact scores of a block's nearest, its own id aside. Scored are all rows whose product by codes, with room for
    the codes' error, reaches the bar; without a bar the `rerank` best by codes are scored first and set one."""
    # codes of a code block lie together, so each look-up is one gather and the sums run over rows
    guess = lut[flat[0]] + centre
    for f in flat[1:]:
        guess += lut[f]
    first = (ids[:0], q[:0])
    if bar == -np.inf and len(ids) > rerank:
        near = np.argpartition(-guess, rerank - 1)[:rerank]
        near = near[ids[near] != own]
        first = best_of(ids[near], (vecs[near] * q).sum(1), depth)
        bar = first[1][-1] if len(first[0]) == depth else bar
    near = np.flatnonzero(guess + room >= bar)
    near = near[ids[near] != own]
    return best_of(np.concatenate([first[0], ids[near]]), np.concatenate([first[1], (vecs[near] * q).sum(1)]), depth)


def best_of(ids: np.ndarray, score: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The `depth` largest, ties to smaller ids; an id counts once, by its best vector."""
    order = np.lexsort((ids, -score))
    order = order[np.sort(np.unique(ids[order], return_index=True)[1])][:depth]
    return ids[order], score[order]
