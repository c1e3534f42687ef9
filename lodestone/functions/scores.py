"""Scores as columns: softmax, decisions and the deterministic scorers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax_ai(human: Column, ai: Column) -> Column:
    """Two-class softmax with the maximum taken off."""
    top = F.greatest(human, ai)
    return F.exp(ai - top) / (F.exp(ai - top) + F.exp(human - top))


def decision(p: Column, threshold: float = 0.5) -> Column:
    return F.when(p >= threshold, "ai").otherwise("human")


def hash_score(text: Column) -> Column:
    """A stand-in scorer that SQL can repeat: the first 16 bits of sha256 as a fraction, single precision."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 4), 16, 10).cast("double") / 65535.0).cast("float")


def line_score(line: Column, blanks: str) -> Column:
    """A scorer of single lines: 'ai' is 0.9, all else 0.1."""
    return F.when(F.btrim(line, F.lit(blanks)) == "ai", F.lit(0.9)).otherwise(F.lit(0.1)).cast("float")
