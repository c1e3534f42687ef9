"""Filter interaction audit: what each filter of a chain removes, in every order, with duplicates found by sorting.

1. Duplicates: rows are range-partitioned by (fingerprint, doc_id) and sorted by (fingerprint, text, doc_id); the
   fingerprint is the text's SHA-256, so equal texts are neighbours and a text with a third of all rows spreads over
   as many partitions as its rows need. A task compares each row with its predecessor (fingerprint, then the whole
   text) and carries the smallest doc_id of the run. Boundaries: a task also writes the fingerprint and smallest
   doc_id of its last run, one row a partition; rows of a partition's first run are checked against these.
2. Failure masks: the conditions are bits 0, 1, ...; the duplicate condition is the last bit.
3. Additive counters: rows, good rows and toxic rows by (part, mask), at most 2 ^ filters a part. Every order and step
   is a sum over these; no document is read again. A filter's share over all orders needs no loop over orders: a row
   that fails m filters is removed by each of them in 1/m of the orders.

Null text counts as empty, null source as the part ''. A row is a duplicate when a smaller doc_id has the same text: of
repeated rows with the smallest doc_id none is, and a row without a doc_id neither is one nor makes one. A doc_id with several
label rows is good (toxic) if one says so; a row without a doc_id has no label. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, stored

SCANNED = "doc_id long, part string, mask int, late boolean, fingerprint binary, first long"


def words(text: str = "text") -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def conditions() -> dict[str, Column]:
    """The failure conditions A to D over text and words (its words)."""
    n = F.size("words")
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    return {"A": n < 200, "B": 100 * F.size(F.array_distinct("words")) < 50 * n, "C": 100 * capitals > 2 * F.length("text"), "D": F.col("text").rlike("[#$%&*|]")}


def scanned(docs: DataFrame, fails: dict[str, Column]) -> DataFrame:
    """The written rows (doc_id, part, mask, late: fails the duplicate condition as far as the partition tells). Rows of
    a partition's first run carry its fingerprint. Rows without part are the partitions' last runs, with first."""
    t = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("fingerprint", F.unhex(F.sha2("text", 256)))
    t = t.repartitionByRange(F.col("fingerprint"), F.col("doc_id").asc_nulls_last()).sortWithinPartitions("fingerprint", "text", F.col("doc_id").asc_nulls_last())
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails.values())), F.lit(0))
    t = t.withColumn("words", words()).select("doc_id", "part", mask.alias("mask"), "fingerprint", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, text, smallest, head = None, None, None, True
        kinds = [pa.bool_(), pa.binary(), pa.int64()]
        for b in batches:
            late, prints = [], []
            for i, (k, f) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("fingerprint").to_pylist(), strict=True)):
                whole = b.column("text")[i].as_buffer()
                if f != last or whole != text:
                    head = last is None
                    last, text, smallest = f, whole, k
                late.append(k is not None and smallest is not None and k > smallest)
                prints.append(f if head else None)
            text = pa.py_buffer(text.to_pybytes()) if text is not None else None  # of the batch only this text is held
            columns = [late, prints, [None] * len(late)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "part", "mask")), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "part", "mask", "late", "fingerprint", "first"])
        if last is not None:
            row = [None, None, 0, False, last, smallest]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, [pa.int64(), pa.string(), pa.int32(), *kinds], strict=True)], ["doc_id", "part", "mask", "late", "fingerprint", "first"])

    return stored(t.mapInArrow(run, SCANNED), "scanned")


def masks(docs: DataFrame, fails: dict[str, Column]) -> DataFrame:
    """doc_id, part, mask of every row; the duplicate condition is the bit after those of `fails`.

    The broadcast side has one row a partition at most."""
    rows = scanned(docs, fails)
    ends = rows.where("part IS NULL").groupBy("fingerprint").agg(F.min("first").alias("first"))
    x = rows.where("part IS NOT NULL").drop("first").join(F.broadcast(ends), "fingerprint", "left")
    copy = F.col("late") | F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return x.select("doc_id", "part", (F.col("mask") + F.when(copy, 1 << len(fails)).otherwise(0)).alias("mask"))


def counters(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: additive over any division of the rows."""
    flags = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("toxic"))
    x = join_small(masked, flags, ["doc_id"], "left")
    return x.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def report(counted: DataFrame, letters: str) -> DataFrame:
    """One row a part, order of the filters and step."""
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    own = f"shiftleft(1, locate(substring(filter_order, step, 1), '{letters}') - 1)"
    prior = f"aggregate(transform(split(substring(filter_order, 1, step - 1), ''), c -> if(c = '', 0, shiftleft(1, locate(c, '{letters}') - 1))), 0, (s, b) -> s + b)"
    x = steps.withColumns({"_own": F.expr(own), "_prior": F.expr(prior)})
    total = lambda of, where: F.expr(f"aggregate(filter(cells, c -> {where}), 0L, (s, c) -> s + {of})")
    here = "(c.mask & _prior) = 0 AND (c.mask & _own) != 0"
    return x.select(
        "part", "filter_order", "step", total("c.n", "(c.mask & (_prior | _own)) = 0").alias("kept"), total("c.n", here).alias("removed"), total("c.n", "(c.mask & _prior) != 0 AND (c.mask & _own) != 0").alias("redundant"),
        total("c.n", "c.mask = _own").alias("unique_fails"), total("c.good", here).alias("good_lost"), total("c.toxic", here).alias("toxic_lost"),
        total(f"c.n * {factorial(len(letters))} div bit_count(c.mask)", "(c.mask & _own) != 0").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, fails: dict[str, Column] | None = None, copy: str = "E") -> DataFrame:
    """The report over the conditions and the duplicate condition, whose letter is `copy`."""
    fails = conditions() if fails is None else fails
    return report(counters(masks(docs, fails), labels), "".join(fails) + copy)
