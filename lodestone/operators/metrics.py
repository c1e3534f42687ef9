"""Exact binary metrics of (label, score): confusion at a threshold, rank metrics with ties, weighted loss."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .prefix import running

BUCKETS = 4096


def confusion(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    yes, real = F.col("score") >= threshold, F.col("label") == 1
    c = df.agg(F.count_if(yes & real).alias("tp"), F.count_if(yes & ~real).alias("fp"), F.count_if(~yes & real).alias("fn"), F.count_if(~yes & ~real).alias("tn"))
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return c.withColumns({"precision": p, "recall": r}).withColumns(
        {"f1": 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12)), "accuracy": (F.col("tp") + F.col("tn")) / F.greatest(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), F.lit(1))}
    )


def tied(df: DataFrame) -> DataFrame:
    """Positives and negatives of each score, and both with all higher scores. Sums run by quantiles of the distinct scores."""
    g = df.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    g = quantile_buckets(cut_lineage(g), "score")
    return running(g, [], -F.col("_bucket"), [F.col("score").desc()], {"pos_to": F.col("pos"), "neg_to": F.col("neg")})


def quantile_buckets(df: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """df with _bucket, which rises with a numeric column and is null with it. Edges are quantiles of a sketch, to a quarter of a
    bucket; the sketch and the edges, all that reaches the driver, do not grow with the rows."""
    edges = sorted(set(df.approxQuantile(column, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))))
    split = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="_double", outputCol="_bucket", handleInvalid="keep") if edges else None
    wide = df.withColumn("_double", F.col(column).cast("double"))
    return (split.transform(wide) if split else wide.withColumn("_bucket", F.lit(0.0))).drop("_double")


def auroc(df: DataFrame) -> DataFrame:
    """Area under the ROC curve, ties as halves; NaN with one class."""
    t = tied(df)
    s = t.agg(F.sum(F.col("neg").cast("double") * (F.col("pos_to") - F.col("pos")) + F.col("neg") * F.col("pos") / 2).alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return s.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p").cast("double") * F.col("n"))).otherwise(F.lit(float("nan"))).alias("auroc"))


def average_precision(df: DataFrame) -> DataFrame:
    """Sum of precision times the rise of recall over distinct scores; NaN without positives."""
    s = tied(df).agg(F.sum(F.col("pos") * (F.col("pos_to") / (F.col("pos_to") + F.col("neg_to")))).alias("w"), F.sum("pos").alias("p"))
    return s.select(F.when(F.col("p") > 0, F.col("w") / F.col("p")).otherwise(F.lit(float("nan"))).alias("average_precision"))


def weighted_loss(df: DataFrame) -> DataFrame:
    """Mean of cross-entropy times weight; score is the probability of label 1."""
    p = F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score"))
    return df.agg(F.avg(-F.log(F.greatest(p, F.lit(1e-12))) * F.col("weight")).alias("loss"))
