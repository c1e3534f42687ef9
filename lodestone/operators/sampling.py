"""The seeded order of a scan: SplitMix64 draws and the exchange shuffle from the end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

M64 = (1 << 64) - 1
# The generator's increment and multipliers.
GAMMA, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def draw(seed: int, k: int) -> int:
    """The k-th output (from 1): a mix of seed + k * GAMMA, so draws need no state."""
    z = (seed + k * GAMMA) & M64
    z = ((z ^ z >> 30) * MIX_1) & M64
    z = ((z ^ z >> 27) * MIX_2) & M64
    return z ^ z >> 31


def permutation(n: int, seed: int) -> list[int]:
    """Indices 0..n-1 as the shuffle leaves them: position i from the last swaps with one of 0..i."""
    order = list(range(n))
    for k, i in enumerate(range(n - 1, 0, -1), 1):
        j = draw(seed, k) * (i + 1) >> 64
        order[i], order[j] = order[j], order[i]
    return order


def sample_steps(sizes: DataFrame, seed: int = 0) -> DataFrame:
    """repo, candidate_index (from 1), step (from 1) from rows (repo, n). One repository's permutation is one sequence of
    at most the candidate cap; repositories spread over tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for repo, n in zip(f["repo"], f["n"], strict=True):
                p = permutation(int(n), seed)
                yield pd.DataFrame({"repo": repo, "candidate_index": [i + 1 for i in p], "step": range(1, len(p) + 1)})

    return sizes.select("repo", "n").mapInPandas(run, f"repo {sizes.schema['repo'].dataType.simpleString()}, candidate_index int, step int")


def sampled(candidates: DataFrame, seed: int = 0) -> DataFrame:
    """Candidates (repo, path, candidate_index) with the step at which each comes up: the permutation joined by index."""
    sizes = candidates.groupBy("repo").agg(F.count("*").alias("n"))
    return candidates.join(sample_steps(sizes, seed), ["repo", "candidate_index"])
