"""Token windows of records, their weights, and record scores from window scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..session import cut_lineage
from ..functions.text import token_windows, window_count


WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Stand-in token ids of white-space words: 31 bits of each word's hash."""
    return F.transform(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int"))


def windowed(df: DataFrame, ids: str = "ids", length: int = S.WINDOW_TOKENS, overlap: int = S.WINDOW_OVERLAP) -> DataFrame:
    """One row a window, window_index from 0, ids the window's slice; records without tokens give none.

    The outer explode keeps Spark from testing the array below it, where the tokens would be made anew for each test."""
    others = [c for c in df.columns if c != ids]
    return df.withColumn("_w", token_windows(ids, length, overlap)).select(*others, F.posexplode_outer("_w").alias("window_index", ids)).where("window_index IS NOT NULL")


def window_counts(tokens: DataFrame, record: str, n: Column, length: int = S.WINDOW_TOKENS, overlap: int = S.WINDOW_OVERLAP) -> DataFrame:
    """record, n_windows from the number of tokens alone; records without tokens give no row. n is generated, as Spark would
    write a plain column's expression into the filter and each place of the formula, and count a text that often."""
    counted = tokens.select(record, F.explode(F.array(n)).alias("_n"))
    return counted.where("_n > 0").select(record, window_count(F.col("_n"), length, overlap).alias("n_windows"))


def counted_weights(counts: DataFrame, record: str = "record_id") -> DataFrame:
    """record, n_windows, sample_weight = average windows of a record / its windows. Counts are taken once; one number crosses the
    whole table."""
    counts = cut_lineage(counts.select(record, "n_windows"))
    mean = counts.agg(F.avg("n_windows").alias("m"))
    return with_mean(counts, mean).select(record, "n_windows", (F.col("m") / F.col("n_windows")).alias("sample_weight"))


def with_mean(df: DataFrame, mean: DataFrame) -> DataFrame:
    """df with the one row of mean beside every row."""
    return df.withColumn("_i", F.lit(1)).join(F.broadcast(mean.withColumn("_i", F.lit(1))), "_i").drop("_i")


def window_weights(windows: DataFrame, record: str = "record_id") -> DataFrame:
    return counted_weights(windows.groupBy(record).agg(F.count("*").alias("n_windows")), record)


def weighted_windows(tokens: DataFrame, n: Column, ids: str = "ids", length: int = S.WINDOW_TOKENS, overlap: int = S.WINDOW_OVERLAP) -> DataFrame:
    """windowed() with each record's sample_weight. n is the number of tokens, from which the mean over all records is
    taken without making them; a record's own windows are counted in its row, so windows are never joined."""
    mean = window_counts(tokens.withColumn("_r", F.lit(1)), "_r", n, length, overlap).agg(F.avg("n_windows").alias("_mean"))
    counted = with_mean(tokens.withColumn("_n", window_count(F.size(ids), length, overlap)), mean)
    return windowed(counted, ids, length, overlap).withColumn("sample_weight", F.col("_mean") / F.col("_n")).drop("_mean", "_n")


def record_scores(scores: DataFrame, record: str = "record_id", score: str = "score", how: str = "mean") -> DataFrame:
    """One score a record. A record whose column n_windows, if there, is not the number of its scores is an error."""
    if how not in ("mean", "max"):
        raise ValueError("how is mean or max")
    if "n_windows" in scores.columns:
        g = scores.groupBy(record).agg((F.avg if how == "mean" else F.max)(F.col(score).cast("double")).alias(score), F.count("*").alias("_k"), F.min("n_windows").alias("_a"), F.max("n_windows").alias("_b"))
        wrong = F.raise_error(F.concat(F.lit("scores of record "), F.col(record).cast("string"), F.lit(": not one a window"))).cast("double")
        return g.select(record, F.when((F.col("_a") == F.col("_k")) & (F.col("_b") == F.col("_k")), F.col(score)).otherwise(wrong).alias(score))
    return scores.groupBy(record).agg((F.avg if how == "mean" else F.max)(F.col(score).cast("double")).alias(score))
