"""Table functions for SQL: chunk_code(text, max_chars) and token_windows(ids, length, overlap)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .text import cut_text


def number(name: str, a: AnalyzeArgument, least: int) -> int:
    """A constant whole number argument."""
    if not isinstance(a.dataType, (IntegerType, LongType)) or not a.isConstantExpression or a.value is None or a.value < least:
        raise ValueError(f"{name} must be a constant whole number of at least {least}")
    return a.value


class ChunkCode:
    """chunk_index and chunk of a text, cut at line ends to at most max_chars characters; none for a null text."""

    @staticmethod
    def analyze(text: AnalyzeArgument, max_chars: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("text must be a string")
        number("max_chars", max_chars, 1)
        return AnalyzeResult(StructType().add("chunk_index", IntegerType()).add("chunk", StringType()))

    def eval(self, text: str, max_chars: int) -> Iterator[tuple]:
        if text is not None:
            yield from enumerate(cut_text(text, max_chars))


class TokenWindows:
    """window_index and ids of the overlapping windows of an array, whatever its element type; none for no tokens."""

    @staticmethod
    def analyze(ids: AnalyzeArgument, length: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(ids.dataType, ArrayType):
            raise ValueError("ids must be an array")
        if number("overlap", overlap, 0) >= number("length", length, 1):
            raise ValueError("windows need overlap < length")
        return AnalyzeResult(StructType().add("window_index", IntegerType()).add("ids", ids.dataType))

    def eval(self, ids: list, length: int, overlap: int) -> Iterator[tuple]:
        at = 0
        while ids is not None and len(ids) and (at == 0 or at * (length - overlap) + overlap < len(ids)):
            start = at * (length - overlap)
            yield at, list(ids[start : start + length])
            at += 1


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk_code", udtf(ChunkCode))
    spark.udtf.register("token_windows", udtf(TokenWindows))
