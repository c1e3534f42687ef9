"""Orders and ranks that spread over tasks: the same results, and no bucket that holds everything."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone import schema as S
from lodestone.operators import estimate as E
from lodestone.operators import metrics as M
from lodestone.operators import prefix, selection
from lodestone.operators import windows as W


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_repository_spreads_over_ranges(spark, uncoalesced):
    e = spark.range(20000).select(F.lit("r").alias("repo"), F.format_string("d%d/e%d/f%05d.py", F.col("id") % 3, F.col("id") % 2, F.col("id")).alias("path"), F.lit(False).alias("is_dir"), F.lit(5).cast("long").alias("size"))
    paths = sorted((r["path"] for r in e.collect()), key=lambda p: [tuple(-ord(c) for c in x) for x in p.split("/")[:-1]])
    paths.sort(key=lambda p: (p.split("/")[0], p.split("/")[1]), reverse=True)
    paths = [p for d in sorted({tuple(p.split("/")[:2]) for p in paths}, reverse=True) for p in sorted(x for x in paths if tuple(x.split("/")[:2]) == d)]
    for most in (1, 777, 10_000, 30_000):
        got = selection.candidates(e, max_files=most).orderBy("candidate_index").collect()
        assert [r["path"] for r in got] == paths[:most] and [r["candidate_index"] for r in got] == list(range(1, len(got) + 1))
    cut = prefix.range_buckets(e, "repo", "path").groupBy("_range").count().collect()
    assert len(cut) == 8 and max(r["count"] for r in cut) < 2 * 20000 / 8
    w = selection.walked(e, max_files=100)
    assert w.count() == 100


def test_ranges_after_the_cap_are_not_ordered(spark, uncoalesced):
    rows = spark.range(4000).select(F.lit(1).alias("k"), "id").repartition(5)
    r = prefix.range_buckets(rows, "k", "id")
    kept = prefix.running(r, ["k"], F.col("_range"), ["id"], {"n": F.lit(1)}, {"n": 100})
    first = r.where("_range = 0").count()
    assert kept.count() == first < 1000 and kept.agg(F.max(F.col("n") - F.col("id"))).first()[0] == 1


def plain_ranks(rows):
    """AUROC by pairs, average precision by thresholds."""
    pos, neg = [s for s, x in rows if x], [s for s, x in rows if not x]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    ap = 0.0
    for s in sorted({s for s, _ in rows}, reverse=True):
        hit, all_ = sum(p >= s for p in pos), sum(x >= s for x, _ in rows)
        ap += sum(p == s for p in pos) / len(pos) * hit / all_
    return auc, ap


@pytest.mark.parametrize("kind", ["crowded", "ties", "one"])
def test_rank_metrics(spark, kind):
    rng = random.Random(kind)
    score = {"crowded": lambda: rng.random() * (1e-4 if rng.random() < 0.99 else 1), "ties": lambda: rng.choice([0.0, 0.2, 0.2000001, 1.0]), "one": lambda: 0.5}[kind]
    rows = [(score(), int(rng.random() < 0.4)) for _ in range(900)]
    df = spark.createDataFrame(rows, "score double, label int")
    auc, ap = plain_ranks(rows)
    assert M.auroc(df).first()[0] == pytest.approx(auc) and M.average_precision(df).first()[0] == pytest.approx(ap)


def test_no_bucket_of_scores_holds_more_than_twice_the_mean(spark):
    df = spark.range(200000).select(F.when(F.col("id") % 100 == 0, F.rand(1)).otherwise(F.rand(2) * 1e-4).alias("score")).distinct()
    n = df.count()
    sizes = [r["count"] for r in M.quantile_buckets(df, "score", 256).groupBy("_bucket").count().collect()]
    assert len(sizes) == 256 and max(sizes) <= 2 * n / 256
    order = M.quantile_buckets(df, "score", 256).groupBy("_bucket").agg(F.min("score").alias("a"), F.max("score").alias("b")).orderBy("_bucket").collect()
    assert all(x["b"] < y["a"] for x, y in zip(order, order[1:], strict=False))


def test_trajectory_by_blocks_equals_one_block(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(f"r{i % 3}", i // 3 + 1, rng.choice(["scanned"] * 6 + ["generated", "errored"]), rng.randint(0, 9), 0, 0.0, rng.random() < 0.5) for i in range(900)]
    rows = [(*r[:3], r[3], rng.randint(0, r[3]), r[3] * rng.random(), r[6]) for r in rows]
    steps = spark.createDataFrame(rows, "repo string, step int, status string, chunks long, ai_chunks long, probability_sum double, is_ai boolean")
    shown = lambda df: {(r["repo"], r["step"]): {k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in df.collect()}
    whole, last = shown(E.trajectory(steps)), shown(E.repo_stats(steps, E.Sampling(target=0.2)))
    monkeypatch.setattr(E, "BLOCK", 16)
    assert shown(E.trajectory(steps)) == whole and shown(E.repo_stats(steps, E.Sampling(target=0.2))) == last
    assert len(whole) == 900 and len(last) == 3
    for repo in ("r0", "r1", "r2"):
        done = sorted(s for r, s in whole if r == repo)
        end = whole[repo, done[-1]]
        assert end["files_scanned"] + end["files_generated"] + end["files_errored"] == 300 and end["population"] == end["files_scanned"]


def test_weighted_windows(spark):
    texts = ["", "a", " ".join("abcdefgh"), " ".join("x" * 25), None]
    df = spark.createDataFrame(list(enumerate(texts)), "record_id int, text string").withColumn("ids", W.words(F.col("text")))
    got = W.weighted_windows(df, F.regexp_count("text", F.lit(W.WORD)), "ids", 4, 1)
    count = lambda n: 0 if not n else 1 + max(0, -(-(n - 4) // 3))
    n = {i: count(len((t or "").split())) for i, t in enumerate(texts)}
    mean = sum(n.values()) / sum(1 for x in n.values() if x)
    assert sorted((r["record_id"], r["window_index"]) for r in got.collect()) == sorted((i, w) for i, k in n.items() for w in range(k))
    assert all(r["sample_weight"] == pytest.approx(mean / n[r["record_id"]]) for r in got.collect())
    weights = {r["record_id"]: r["sample_weight"] for r in W.counted_weights(W.window_counts(df, "record_id", F.regexp_count("text", F.lit(W.WORD)), 4, 1)).collect()}
    assert weights == {i: pytest.approx(mean / k) for i, k in n.items() if k}


def test_chunks_and_composition_in_one_scan(spark, tmp_path):
    from lodestone.functions import text as T

    rows = [(1, "café\n" * 9), (2, "plain\r\n" * 9), (3, None), (4, ""), (5, "x\0"), (6, "é" * 30)]
    spark.createDataFrame(rows, "id int, text string").write.parquet(str(tmp_path / "t"))
    made = T.chunked(T.normalized(spark.read.parquet(str(tmp_path / "t"))), 20)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    got = {}
    for r in made.orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append(r["text"])
    assert got[1] == ["café\n" * 4, "café\n" * 4, "café\n"] and got[2] == ["plain\n" * 3] * 3 and got[4] == [""] and got[6] == ["é" * 20, "é" * 10 + "\n"]
    assert set(got) == {1, 2, 4, 6} and S.MAX_CHARS > 20
