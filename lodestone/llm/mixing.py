"""Temperature mixing with DataFrame functions only: source weights from an exponent, realised in blocks.

Shares p of the sources' tokens (words) become weights p^a / sum p^a. The exponent a is the smallest (flattest mix)
with entropy at most `entropy` times the logarithm of the number of sources and with no source lighter than
the heaviest repeated more than `repeats` times within the budget: below 1 it flattens natural shares, above 1 it
sharpens them until the entropy is met, up to SHARPEST. There the heaviest source repeats most; where it would more
than `repeats` times, a is the largest that keeps that limit. Bisection takes STEPS halvings, five to a pass over
the shares (the 31 inner points, one row each). Aims are reported as met or not with every draw.

Each source has a quota of floor(weight * budget) tokens, filled epoch by epoch with seeded permutations of
its documents; a document is drawn while it still fits as a whole. The stream of draws is dealt to blocks,
each of which holds the same share of every source's quota, in a seeded order within the block. Positions in
a permutation are sums over hash buckets of about BUCKET documents and then within a bucket, so a source that
holds a third of all rows still spreads over tasks. The key of a document is a digest of its id and text.

Null text counts as empty; a text without words counts as one token; a null source is a source of its own,
named ''; repeated rows (id and text) stand side by side in a permutation and are drawn all or none, each with its own
place: they are one row with a count until then; an empty table gives no draws; columns not named here are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, join_small, quoted, stored, texts

WORDS = r"[^\x20\x09-\x0D]+"
ENTROPY = 0.95
REPEATS = 2.0
BUDGET = 1.0  # budget as a share of all tokens
BLOCK = 1 << 15
BUCKET = 500
STEPS = 20
SHARPEST = 16.0
SEED = 17


def fraction(key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of a hexadecimal digest."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / 4294967296.0


def words(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit(WORDS))).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    return texts(docs, "doc_id", F.coalesce("source", F.lit("")).alias("source")).select("doc_id", "source", F.md5("text").alias("digest"), words(F.col("text")).alias("tokens"))


def shares(table: DataFrame) -> DataFrame:
    return table.groupBy("source").agg(F.sum("tokens").alias("total"), F.count("*").alias("n_docs"))


def bisected(met, low: float, high: float, steps: int) -> tuple[float, float]:
    """The last points below and above where met turns from false to true, five halvings to a pass."""
    while steps > 0:
        k = min(5, steps)
        points = [low + (high - low) * i / (1 << k) for i in range(1, 1 << k)]
        ok = met(points)
        high = min((x for x in points if ok[x]), default=high)
        low, steps = max((x for x in points if x < high), default=low), steps - k
    return low, high


def temperature(sources: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = BUDGET, steps: int = STEPS) -> tuple[float, bool, bool]:
    """The exponent, whether the entropy is met, and whether the repetition limit is.

    One row of totals and 31 rows a pass reach the driver, however many sources there are."""
    whole = sources.agg(F.sum("total").alias("t"), F.count("*").alias("s")).first()
    if not whole["s"]:
        return 1.0, True, True
    aim = entropy * math.log(whole["s"])

    def at(points: list[float]) -> dict[float, tuple[bool, bool, bool]]:
        p = F.col("total") / F.lit(float(whole["t"]))
        rows = sources.select(p.alias("p"), F.explode(F.array(*map(F.lit, points))).alias("a"))
        sums = rows.groupBy("a").agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p")).alias("l"), F.min("p").alias("least"), F.max("p").alias("most"))
        times = lambda c: F.pow(F.col(c), F.col("a") - 1) / F.col("z") * budget
        found = sums.select("a", (F.log("z") - F.col("a") * F.col("l") / F.col("z")).alias("h"), times("least").alias("light"), times("most").alias("heavy")).collect()
        return {r["a"]: (r["h"] <= aim + 1e-12, r["light"] <= repeats + 1e-12, r["heavy"] <= repeats + 1e-12) for r in found}

    flat = lambda points: {a: h and light for a, (h, light, _) in at(points).items()}
    ends = flat([0.0, SHARPEST])
    a = 0.0 if ends[0.0] else bisected(flat, 0.0, SHARPEST, steps)[1] if ends[SHARPEST] else SHARPEST
    if a > 1 and not at([a])[a][2]:
        a = bisected(lambda points: {x: not m[2] for x, m in at(points).items()}, 1.0, a, steps)[0]
    h, light, heavy = at([a])[a]
    return a, h, light and heavy


def quotas(sources: DataFrame, a: float, budget: float = BUDGET, block: int = BLOCK) -> DataFrame:
    """source, total, n_docs, weight, quota, blocks: all sources share one number of blocks."""
    whole = sources.agg(F.sum("total").alias("t"), F.sum(F.pow(F.col("total").cast("double"), F.lit(a))).alias("z")).first()
    tokens = math.floor((whole["t"] or 0) * budget)
    weight = F.pow(F.col("total").cast("double"), F.lit(a)) / F.lit(whole["z"] or 1.0)
    return sources.select("source", "total", "n_docs", weight.alias("weight"), F.floor(weight * tokens).cast("long").alias("quota"), F.lit(max(1, -(-tokens // block))).alias("blocks"))


def draw_key(epoch: Column, doc_id: Column, digest: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")), digest))


def drawn(table: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows that are drawn, repeated ones as one row with `copies`, with epoch, key and start. A source's stream is
    cut where its quota is full."""
    peers = table.groupBy("source", "doc_id", "digest", "tokens").agg(F.count("*").alias("copies"))
    spread = join_small(peers, plan, ["source"]).where("quota > 0")
    epochs = spread.withColumn("epoch", F.explode(F.sequence(F.lit(0), ((F.col("quota") - 1) / F.col("total")).cast("int"))))
    key = draw_key(F.col("epoch"), F.col("doc_id"), F.col("digest"), seed)
    keyed = epochs.withColumns({"key": key, "size": F.col("tokens") * F.col("copies")}).withColumn("bucket", F.floor(fraction(F.col("key")) * F.ceil(F.col("n_docs") / BUCKET)))
    sums = keyed.groupBy("source", "epoch", "bucket").agg(F.sum("size").alias("all"))
    before = sums.select("source", "epoch", "bucket", (F.sum("all").over(Window.partitionBy("source", "epoch").orderBy("bucket")) - F.col("all")).alias("before"))
    inside = Window.partitionBy("source", "epoch", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.withColumn("within", F.sum("size").over(inside) - F.col("size")).join(before, ["source", "epoch", "bucket"])
    return placed.withColumn("start", F.col("epoch").cast("long") * F.col("total") + F.col("before") + F.col("within")).where("start + size <= quota")


def draws(table: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, tokens, epoch, start (its place in its source's stream), block, place, weight."""
    each = drawn(table, plan, seed).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("start", F.col("start") + F.col("copy") * F.col("tokens"))
    blocked = each.withColumn("block", F.expr("CAST(start * blocks DIV quota AS BIGINT)")).withColumn("mix", F.md5(F.concat_ws(":", F.lit("block"), F.col("key"))))
    place = F.row_number().over(Window.partitionBy("block").orderBy("mix", "source", "start"))
    return blocked.select("doc_id", "source", "tokens", F.col("epoch").cast("long").alias("epoch"), "start", "block", place.cast("long").alias("place"), "weight")


def mix(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = BUDGET, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The draws of a whole mix with its exponent, entropy_met and repeats_met; the texts are read once, for their sizes."""
    table = stored(sized(docs), "sizes")
    sources = stored(shares(table), "shares")
    a, level, limit = temperature(sources, entropy, repeats, budget)
    return draws(table, quotas(sources, a, budget, block), seed).withColumns({"exponent": F.lit(a), "entropy_met": F.lit(level), "repeats_met": F.lit(limit)})


def mixed(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = BUDGET, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """docs as the mix draws them: a row for each draw (a repeated document comes again), with docs' columns.

    What an epoch draws of a source is a head of its permutation, so the last key drawn of each source and epoch
    decides for every row beside its text. Rows come block by block, in the seeded order within a block; a row's
    block follows from its key's share of the permutation, which is the expected start of the draw, so that
    texts meet no table of draws and move once, to their blocks."""
    table = stored(sized(docs), "sizes")
    sources = stored(shares(table), "shares")
    plan = quotas(sources, temperature(sources, entropy, repeats, budget)[0], budget, block)
    last = drawn(table, plan, seed).groupBy("source", "epoch").agg(F.max("key").alias("cut"))
    ends = last.join(plan, "source").groupBy("source", "total", "quota", "blocks").agg(F.collect_list(F.struct("epoch", "cut")).alias("cuts"))
    name, chosen, one, at, order = fresh(docs, "source_name", "chosen", "one", "block", "order")
    side = ends.select(F.col("source").alias(name), F.struct("total", "quota", "blocks", "cuts").alias(chosen))
    body = docs.withColumn(name, F.coalesce("source", F.lit("")))
    joined = join_small(body, side, [name])
    c, digest = F.col(chosen), F.md5(F.coalesce("text", F.lit("")))
    made = F.transform(c["cuts"], lambda e: F.struct(e["epoch"].alias("epoch"), draw_key(e["epoch"], F.col("doc_id"), digest, seed).alias("key"), e["cut"].alias("cut")))
    taken = joined.withColumn(one, F.explode(F.filter(made, lambda e: e["key"] <= e["cut"])))
    start = (F.col(one)["epoch"] + fraction(F.col(one)["key"])) * c["total"] / c["quota"]
    dealt = taken.withColumns({at: F.floor(F.least(start, F.lit(1.0)) * c["blocks"]), order: F.md5(F.concat_ws(":", F.lit("block"), F.col(one)["key"]))})
    return dealt.repartition(F.col(at)).sortWithinPartitions(at, order).select(*map(quoted, docs.columns))
