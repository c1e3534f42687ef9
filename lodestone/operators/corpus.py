"""Corpus preparation: chunk records, dedup with conflict removal, class balance, breakdowns and pair truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as T
from .prefix import hex_bucket, running


def records(files: DataFrame, sources: DataFrame, max_bytes: int = S.MAX_FILE_BYTES, max_chars: int = S.MAX_CHARS, min_chars: int = S.MIN_CHARS) -> DataFrame:
    """Chunk records of files (source_id, path, language, size, text) with their sources' attributes (a small N:1 join).

    A text below min_chars has only chunks below it, so one test, of the chunks, does."""
    fit = T.normalized(files.where((F.col("size") <= max_bytes) | F.col("size").isNull()))
    chunks = T.chunked(fit, max_chars).where(T.stripped_length("text") >= min_chars)
    s = sources.select(F.col("id").alias("source_id"), "label", "label_name", F.col("kind").alias("source_kind"), F.col("url").alias("repository_url"), "revision", "split", "source_ord")
    hashed = chunks.join(s, "source_id").withColumn("text_sha256", F.sha2("text", 256))
    return hashed.withColumn("id", T.digest("source_id", "path", "chunk_index", "text_sha256")).select(*S.CHUNK_COLUMNS, "source_ord")


def input_order(split: Column | str = "split", source: Column | str = "source_ord", path: Column | str = "path", chunk: Column | str = "chunk_index") -> Column:
    """The order in which records come: splits, manifest order, path components, chunk."""
    number = F.array_position(F.array(*map(F.lit, S.SPLITS)), T.col(split))
    return F.struct(number.alias("s"), T.col(source).alias("o"), F.split(T.col(path), "/").alias("p"), T.col(chunk).alias("c"))


def hash_groups(df: DataFrame, order: Column) -> DataFrame:
    """One row a text: n, its first record's order, and where the first record of the other label stands (null: none).

    All of it combines before the shuffle, so a text with a third of all rows is no burden."""
    g = df.groupBy("text_sha256").agg(F.count("*").alias("n"), F.min(F.when(F.col("label") == 0, order)).alias("z"), F.min(F.when(F.col("label") == 1, order)).alias("o"))
    return g.select("text_sha256", "n", F.least("z", "o").alias("first"), F.when(F.col("z").isNotNull() & F.col("o").isNotNull(), F.greatest("z", "o")).alias("breach"))


def deduplicated(df: DataFrame, order: Column | None = None) -> DataFrame:
    """The first record of each text whose records agree on the label; a text with two labels leaves altogether."""
    order = input_order() if order is None else order
    kept = hash_groups(df, order).where("breach IS NULL").select("text_sha256", F.col("first").alias("_first"))
    return df.withColumn("_order", order).join(kept, "text_sha256").where("_order = _first").select(*df.columns)


def dedup_stats(df: DataFrame, order: Column | None = None) -> DataFrame:
    """duplicate_count, conflict_count and kept: with n records of which the p-th is the first to disagree, n - 1 and 0
    without disagreement, else p - 2 and n - p + 1."""
    order = input_order() if order is None else order
    g = hash_groups(df, order)
    split = g.where("breach IS NOT NULL").select("text_sha256", "n", "breach")
    before = df.select("text_sha256", order.alias("_order")).join(split, "text_sha256").groupBy("text_sha256").agg(F.first("n").alias("n"), F.count_if(F.col("_order") < F.col("breach")).alias("before"))
    bad = before.agg(F.sum(F.col("before") - 1).alias("d"), F.sum(F.col("n") - F.col("before")).alias("c"))
    good = g.where("breach IS NULL").agg(F.sum(F.col("n") - 1).alias("g"), F.count("*").alias("k"))
    one = F.lit(1)
    return good.withColumn("i", one).join(bad.withColumn("i", one), "i").select(
        (F.coalesce("g", F.lit(0)) + F.coalesce("d", F.lit(0))).cast("long").alias("duplicate_count"), F.coalesce("c", F.lit(0)).cast("long").alias("conflict_count"), F.col("k").cast("long").alias("kept")
    )


def balanced(df: DataFrame, seed: str) -> DataFrame:
    """As many records of each label in every split and language, those of smallest seeded digest; one-label languages leave.

    Ranks come from digest buckets, so a language with most of the rows spreads over tasks."""
    keyed = df.withColumn("_seed", F.concat(F.lit(seed + "-"), F.col("split"))).withColumn("_key", T.digest("_seed", "language", "id"))
    counts = df.groupBy("split", "language").agg(F.least(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).alias("_target"))
    total = df.count()
    ranked = running(keyed, ["split", "language", "label"], hex_bucket(F.col("_key"), total), ["_key"], {"_rank": F.lit(1)})
    x, y = ranked.alias("x"), counts.alias("y")
    kept = x.join(y, F.col("x.split").eqNullSafe(F.col("y.split")) & F.col("x.language").eqNullSafe(F.col("y.language"))).where("_rank <= _target")
    return kept.select(*[F.col(f"x.{c}") for c in df.columns], T.digest("_seed", F.lit("output"), "id").alias("output_key"))


def check_balance(df: DataFrame) -> None:
    """Every split that has records must hold both labels and no other."""
    bad = df.groupBy("split").agg(F.array_sort(F.collect_set("label")).alias("l")).where("l != array(0, 1)").orderBy("split").first()
    if bad:
        raise ValueError(f"{bad['split']}: labels must be 0 and 1, got {list(bad['l'])}")


def breakdown(df: DataFrame) -> DataFrame:
    """Records by language and label, with a TOTAL row."""
    g = df.rollup("language").agg(F.count_if(F.col("label") == 0).alias("human"), F.count_if(F.col("label") == 1).alias("ai"), F.grouping("language").alias("g"))
    return g.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("language")).alias("language"), "human", "ai", (F.col("human") + F.col("ai")).alias("total"))


def merged(*breakdowns: DataFrame) -> DataFrame:
    """One breakdown of several datasets' breakdowns, their TOTAL rows made anew."""
    rows = breakdowns[0]
    for b in breakdowns[1:]:
        rows = rows.unionByName(b)
    g = rows.where("language != 'TOTAL'").rollup("language").agg(F.sum("human").alias("human"), F.sum("ai").alias("ai"), F.grouping("language").alias("g"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return g.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("language")).alias("language"), zero("human").alias("human"), zero("ai").alias("ai"), (zero("human") + zero("ai")).alias("total"))


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split", F.when(F.col("label") == 1, "ai").otherwise("human").alias("label_name")).agg(F.count("*").alias("n"))


def source_counts(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Records of every source, those without any too."""
    return sources.select(F.col("id").alias("source_id")).join(df.groupBy("source_id").agg(F.count("*").alias("n")), "source_id", "left").select("source_id", F.coalesce("n", F.lit(0)).alias("n"))


def only_language(df: DataFrame, language: str) -> DataFrame:
    """The records of a language, whatever its case; an error that lists the languages if there are none."""
    if not language:
        raise ValueError("language must not be empty")
    got = df.where(F.lower("language") == language.lower())
    if got.limit(1).count() == 0:
        raise ValueError(f"no records of {language}; languages: " + ", ".join(sorted(r[0] for r in df.select("language").distinct().collect())))
    return got


def truncated_pairs(df: DataFrame, most: int, position: str = "position", per: int = 2000) -> DataFrame:
    """At most `most` records as pairs of both labels: the i-th of one label beside the i-th of the other in each
    language, pairs in order of their later, then their earlier member."""
    if most < 2:
        raise ValueError("a balanced limit is 2 at least")
    r = running(df.select(position, "language", "label"), ["language", "label"], F.floor(F.col(position) / per), [position], {"i": F.lit(1)})
    h = r.where("label = 0").select("language", "i", F.col(position).alias("h"))
    a = r.where("label = 1").select("language", "i", F.col(position).alias("a"))
    pairs = h.join(a, ["language", "i"]).orderBy(F.greatest("h", "a"), F.least("h", "a")).limit(most // 2)
    chosen = pairs.select(F.explode(F.array("h", "a")).alias(position))
    return df.join(chosen, position)


def leaks(benchmark: DataFrame, documents: DataFrame) -> DataFrame:
    """item_id, first_doc, n_docs from distinct (item_id, h) and (doc_id, h).

    Hashes with the same items are one class, documents with the same classes one pattern with a count, and only patterns
    meet items: a line that most documents and items have makes one pattern, not a row for each pair."""
    held = benchmark.groupBy("h").agg(F.sort_array(F.collect_set("item_id")).alias("items")).withColumn("c", F.md5(F.to_json("items")))
    of_class = held.select("c", F.explode("items").alias("item_id")).distinct()
    per = documents.join(held.select("h", "c"), "h").groupBy("doc_id").agg(F.sort_array(F.collect_set("c")).alias("pattern"))
    patterns = per.groupBy("pattern").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    met = patterns.select("pattern", "n", "first_doc", F.explode("pattern").alias("c")).join(of_class, "c").select("pattern", "n", "first_doc", "item_id").distinct()
    return met.groupBy("item_id").agg(F.min("first_doc").alias("first_doc"), F.sum("n").alias("n_docs"))
