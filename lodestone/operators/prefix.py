"""Ordered sums that spread over tasks: within buckets of the order, plus what earlier buckets hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[Column | str], sums: dict[str, Column], until: dict[str, int] | None = None) -> DataFrame:
    """Adds, for each name, the sum of its column over the rows of the same keys up to and with this one.

    bucket must not fall along the order and should hold a bounded number of rows. Only one row a key and
    bucket meets in one task; rows themselves are ordered bucket by bucket. With until, buckets before which a sum has
    reached its value are left out, and never ordered."""
    b = df.withColumns({"_b": bucket} | {f"_v_{n}": c for n, c in sums.items()})
    totals = b.groupBy(*keys, "_b").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    over = Window.partitionBy(*keys).orderBy("_b") if keys else Window.orderBy("_b")
    before = totals.select(*keys, "_b", *[(F.sum(f"_t_{n}").over(over) - F.col(f"_t_{n}")).alias(f"_p_{n}") for n in sums])
    for n, most in (until or {}).items():
        before = before.where(F.col(f"_p_{n}") < most)
    x, y = b.alias("x"), before.alias("y")
    on = F.lit(True)
    for k in [*keys, "_b"]:
        on = on & F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    joined = x.join(y, on).select("x.*", *[f"_p_{n}" for n in sums])
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select(*df.columns, *[(F.sum(f"_v_{n}").over(inside) + F.col(f"_p_{n}")).alias(n) for n in sums])


def range_buckets(df: DataFrame, *order: str) -> DataFrame:
    """df with _range, which rises along the order: Spark's range partitions, whose splitters are sampled from the whole
    composite key, so rows of one key value apart, any prefix of it spreads over tasks. Checkpointed, as another run could cut elsewhere."""
    return cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def hex_bucket(digest: Column, rows: int, per: int = 2000) -> Column:
    """Buckets of about `per` rows along a hexadecimal digest."""
    return F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0 * max(1, -(-rows // per)))
