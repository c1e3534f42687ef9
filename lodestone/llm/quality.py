"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of a whole text (sizes, character kinds, word repetition, line shape; no labels, language, source
or id) are made near normal by logarithms and log-odds. Class means and covariances come from moments summed
over every labelled row used for learning. Each covariance is shrunk towards the pooled one (POOL) and then
towards a scaled identity (RIDGE) in standardised units; its Cholesky factor is kept, and the score is the
logistic of the tempered difference of the two log densities, by Mahalanobis distances, plus log priors. The
temperature is the number of statistics over EVIDENCE: dependent statistics count each evidence more than once.

Null text counts as empty and has a score like any text; without labelled rows of both classes every score is
the share of class 1 (0.5 without labels). Labels that are null or not 0/1 do not count; a document labelled
twice counts twice. Repeated rows are scored each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_small, map_rows, quoted, stored, texts

POOL = 0.3
RIDGE = 0.05
EVIDENCE = 4.0
THRESHOLD = 0.7
# Names of the statistics.
STATISTICS = ("log_chars", "word_mean", "word_spread", "upper", "digit", "mark", "symbol", "repeat_words", "repeat_pairs", "top_word", "line_words", "repeat_lines", "entropy", "odd_ends")


def odds(part: float, whole: float, weight: float = 1.0) -> float:
    """Log-odds of a share, with weight pseudo-counts split between both sides."""
    return math.log((part + weight / 2) / (max(whole - part, 0) + weight / 2))


CLASS = bytearray(256)
for _i in range(256):
    _c = chr(_i)
    CLASS[_i] = 1 if 48 <= _i <= 57 else 2 if 65 <= _i <= 90 else 3 if 97 <= _i <= 122 or _i >= 128 else 4 if _c in ".,;:?'\"-()" else 5 if _i > 32 else 0
CLASS = bytes(CLASS)


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of STATISTICS."""
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(np.frombuffer(raw.translate(CLASS), np.uint8), minlength=6) if raw else np.zeros(6, int)
    words = text.split()
    n = len(words)
    lens = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    same = n - 1 - pairs if n > 1 else 0
    lines = [x for x in text.split("\n") if x]
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.ones(1)
    share = counts[counts > 0] / counts.sum()
    ends = sum(1 for w in words if not (w[-1].isalnum() or w[-1] in ".,"))
    return [
        math.log1p(len(text)),
        math.log1p(float(lens.mean())),
        math.log1p(float(lens.std())),
        odds(int(kinds[2]), int(kinds[2] + kinds[3])),
        odds(int(kinds[1]), len(raw)),
        odds(int(kinds[4]), len(raw)),
        odds(int(kinds[5]), len(raw)),
        odds(n - len(seen), n),
        odds(same, max(n - 1, 0)),
        odds(max(seen.values(), default=0), n),
        math.log1p(n / max(1, len(lines))),
        odds(len(lines) - len(set(lines)), len(lines)),
        float(-(share * np.log2(share)).sum()),
        odds(ends, n),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of every whole text."""

    def make():
        def step(x):
            return {"doc_id": x["doc_id"], "x": [statistics(t) for t in x["text"]]}

        return step

    return map_rows(texts(docs, "doc_id"), "doc_id long, x array<double>", make)


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sums and products of x by label: partial sums by task, then two rows of numbers reach the driver."""
    d = len(STATISTICS)
    names = [(i, j) for i in range(d) for j in range(i, d)]
    columns = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)] + [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i, j in names]
    out = {}
    for r in labelled.groupBy("label").agg(F.count("*").alias("n"), *columns).collect():
        second = np.zeros((d, d))
        for i, j in names:
            second[i, j] = second[j, i] = r[f"p{i}_{j}"]
        out[int(r["label"])] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(d)]), second)
    return out


class Discriminant:
    """Both classes' means and inverse Cholesky factors in standardised units."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float = POOL, ridge: float = RIDGE, evidence: float = EVIDENCE):
        n = {k: sums[k][0] for k in (0, 1) if k in sums}
        total = sum(n.values())
        self.share = n.get(1, 0.0) / total if total else 0.5
        self.ready = len(n) == 2 and min(n.values()) >= 2
        if not self.ready:
            return
        d = len(STATISTICS)
        mean = (sums[0][1] + sums[1][1]) / total
        var = np.diag(sums[0][2] + sums[1][2]) / total - mean**2
        self.mean, self.scale = mean, np.sqrt(np.maximum(var, 1e-9))
        centres, covs = {}, {}
        for k in (0, 1):
            m = sums[k][1] / n[k]
            centres[k] = (m - mean) / self.scale
            covs[k] = (sums[k][2] / n[k] - np.outer(m, m)) / np.outer(self.scale, self.scale)
        pooled = (n[0] * covs[0] + n[1] * covs[1]) / total
        self.centres, self.roots, self.logdet = centres, {}, {}
        for k in (0, 1):
            c = (1 - pool) * covs[k] + pool * pooled
            c = (1 - ridge) * c + ridge * max(np.trace(c) / d, 1e-6) * np.eye(d)
            factor = np.linalg.cholesky(c)
            self.roots[k] = np.linalg.inv(factor)
            self.logdet[k] = 2 * float(np.log(np.diag(factor)).sum())
        self.temper = evidence / d
        self.prior = math.log(n[1] / n[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.share)
        z = (x - self.mean) / self.scale
        density = {k: -0.5 * ((((z - self.centres[k]) @ self.roots[k].T) ** 2).sum(1) + self.logdet[k]) for k in (0, 1)}
        return 1 / (1 + np.exp(-np.clip(self.temper * (density[1] - density[0]) + self.prior, -60, 60)))


def learn(table: DataFrame, labels: DataFrame) -> Discriminant:
    """From features (doc_id, x) and labels (doc_id, label); a shuffle of numbers, not of texts."""
    good = labels.where("label IN (0, 1)").select("doc_id", "label")
    return Discriminant(moments(table.join(good, "doc_id")))


def scored(table: DataFrame, model: Discriminant) -> DataFrame:
    def make():
        def step(x):
            return {"doc_id": x["doc_id"], "score": model.score(np.array(x["x"], float).reshape(-1, len(STATISTICS))).tolist()}

        return step

    return map_rows(table.select("doc_id", "x"), "doc_id long, score double", make)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted. labels: doc_id, quality; held-out rows teach nothing."""
    table = stored(features(docs), "features")
    taught = labels.where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    s = scored(table, learn(table, taught))
    return s.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text scores below the threshold; all columns stay.

    The model is fitted on labelled documents only: their ids meet the texts first, by broadcast while they are few
    (bounded), so statistics of the others are made once, beside the rows they decide about."""
    taught = labels.where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    known = join_small(docs.select("doc_id", "text"), taught.where("label IN (0, 1)").select("doc_id").distinct(), ["doc_id"])
    model = learn(stored(features(known), "features"), taught)

    def score(texts_):
        import pandas as pd

        for s in texts_:
            yield pd.Series(model.score(np.array([statistics(t or "") for t in s], float).reshape(-1, len(STATISTICS))))

    from collections.abc import Iterator

    import pandas as pd

    score.__annotations__ = {"texts_": Iterator[pd.Series], "return": Iterator[pd.Series]}
    judge = F.pandas_udf(score, "double")
    (name,) = fresh(docs, "score")
    return docs.withColumn(name, judge(F.col("text"))).where(F.col(name) >= threshold).select(*map(quoted, docs.columns))
