"""Registered queries of the engine's own operators and the equivalent SQL.

documents stands in for a corpus: source is the repository, lang the language, doc_id % 2 the label,
doc_id % 10 the split (0-7 train, 8 validation, 9 test)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .functions import paths as P
from .functions import scores as K
from .functions import tables
from .functions import text as T
from .operators import corpus as C
from .operators import estimate as E
from .operators import metrics as M
from .operators import sampling, selection
from .operators import windows as W
from .operators.prefix import hex_bucket, running
from .plans import scan
from .streaming import progress, replay

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SEED = "corpus-v1"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def r9(c: Column) -> Column:
    return F.round(c, 9)


# --- text ---------------------------------------------------------------------------------------------
RAW_SQL = r"""(CASE WHEN doc_id % 3 = 0 THEN chr(65279) ELSE '' END || chr(10) || replace(text, chr(10), CASE doc_id % 4 WHEN 0 THEN chr(13) || chr(10) WHEN 1 THEN ' ' || chr(9) || chr(10) WHEN 2 THEN chr(13) ELSE chr(10) END) || CASE WHEN doc_id % 5 = 0 THEN ' cafe' || chr(769) ELSE '' END || chr(8232) || 'x ' || chr(9) || chr(10) || chr(10))"""
NORM_SQL = rf"""SELECT doc_id, lang, source, CASE WHEN t = '' THEN t ELSE t || chr(10) END AS text FROM (
  SELECT doc_id, lang, source, trim(regexp_replace(regexp_replace(nfc_normalize(CASE WHEN starts_with(r, chr(65279)) THEN substr(r, 2) ELSE r END), '\r\n?', chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), chr(10)) AS t FROM (SELECT doc_id, lang, source, {RAW_SQL} AS r FROM documents))"""


def messy(d: DataFrame) -> DataFrame:
    """documents with a leading mark, mixed line ends, trailing blanks, an uncomposed accent and an odd line break."""
    k = F.col("doc_id")
    end = F.when(k % 4 == 0, "\r\n").when(k % 4 == 1, " \t\n").when(k % 4 == 2, "\r").otherwise("\n")
    mark, accent = F.when(k % 3 == 0, "﻿").otherwise(""), F.when(k % 5 == 0, " café").otherwise("")
    return d.select("doc_id", "lang", "source", F.concat(mark, F.lit("\n"), F.replace("text", F.lit("\n"), end), accent, F.lit(" x \t\n\n")).alias("text"))


@query(f"SELECT doc_id, sha256(text) AS digest, length(text) AS n FROM ({NORM_SQL})")
def normalize_text(spark, sf):
    return T.normalized(messy(documents(spark, sf))).select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("n"))


BLANKS_SQL = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)"
MARK_SQL = " OR ".join(f"contains(lower(substr(t, 1, 4096)), '{m}')" for m in S.GENERATED_MARKERS)


@query(f"""SELECT doc_id, length(trim(t, {BLANKS_SQL})) >= 40 AS long_enough, (length(t) > 4096 AND NOT contains(substr(t, 1, 4096), chr(10))) OR {MARK_SQL} AS generated, length(substr(t, 1, 131072)) AS read_chars
FROM (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN replace(text, chr(10), ' ') WHEN 1 THEN '// Code generated by x. DO NOT EDIT.' || text WHEN 2 THEN repeat(text, 40) ELSE text END AS t FROM documents)""")
def quality_filter(spark, sf):
    k, t = F.col("doc_id") % 7, F.col("text")
    made = F.when(k == 0, F.replace(t, F.lit("\n"), F.lit(" "))).when(k == 1, F.concat(F.lit("// Code generated by x. DO NOT EDIT."), t)).when(k == 2, F.repeat(t, 40)).otherwise(t)
    d = documents(spark, sf).select("doc_id", made.alias("t"))
    return d.select("doc_id", (T.stripped_length("t") >= S.MIN_CHARS).alias("long_enough"), T.looks_generated("t").alias("generated"), F.length(T.sliced("t", 0, S.SCAN_READ_CHARS)).cast("long").alias("read_chars"))


def chunk_cte(most: int, table: str, breaks: tuple[int, ...] = ()) -> str:
    """c(doc_id, i, chunk, ...): the chunks of a table's texts, which may also end at other breaks than line ends."""
    text = f"translate(rest, {'||'.join(f'chr({b})' for b in breaks)}, repeat(chr(10), {len(breaks)}))" if breaks else "rest"
    p = f"({most} - strpos(reverse(substr({text}, 1, {most})), chr(10)) + 1)"
    line = f"(CASE WHEN strpos(substr({text}, {most} + 1), chr(10)) = 0 THEN length(rest) ELSE {most} + strpos(substr({text}, {most} + 1), chr(10)) END)"
    has = f"strpos(substr({text}, 1, {most}), chr(10)) > 0"
    size = f"CASE WHEN room > 0 THEN least({most}, room) WHEN length(rest) <= {most} THEN length(rest) WHEN {has} THEN {p} ELSE {most} END"
    left = f"CASE WHEN room > 0 THEN room - least({most}, room) WHEN length(rest) <= {most} OR {has} THEN 0 ELSE {line} - {most} END"
    return f"""WITH RECURSIVE c(doc_id, i, chunk, rest, room) AS (
  SELECT doc_id, CAST(-1 AS BIGINT), CAST(NULL AS VARCHAR), text, CAST(0 AS BIGINT) FROM {table}
  UNION ALL SELECT doc_id, i + 1, substr(rest, 1, n), substr(rest, n + 1), CAST(m AS BIGINT) FROM (SELECT *, {size} AS n, {left} AS m FROM c WHERE length(rest) > 0 OR i < 0))"""


def chunk_sql(most: int) -> str:
    return f"""{chunk_cte(most, "documents")}
SELECT doc_id, i AS chunk_index, sha256(chunk) AS text_sha256, sha256('docs' || chr(0) || doc_id || '.txt' || chr(0) || i || chr(0) || sha256(chunk)) AS id, length(chunk) AS n FROM c WHERE i >= 0 AND length(trim(chunk, {BLANKS_SQL})) >= 40"""


def chunk_rows(spark, sf, most):
    c = T.chunked(documents(spark, sf).select("doc_id", "text"), most).where(T.stripped_length("text") >= S.MIN_CHARS).withColumn("text_sha256", F.sha2("text", 256))
    path = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text_sha256", T.digest(F.lit("docs"), path, "chunk_index", "text_sha256").alias("id"), F.length("text").cast("long").alias("n"))


@query(chunk_sql(S.MAX_CHARS))
def chunk_documents(spark, sf):
    return chunk_rows(spark, sf, S.MAX_CHARS)


@query(chunk_sql(700))
def chunk_documents_short(spark, sf):
    return chunk_rows(spark, sf, 700)


@query(SQL["chunk_documents_short"])
def chunk_code_sql(spark, sf):
    """The chunks of chunk_documents_short by SQL text over the table function chunk_code."""
    tables.register(spark)
    documents(spark, sf).createOrReplaceTempView("lodestone_documents")
    c = spark.sql("SELECT doc_id, chunk_index, chunk AS text, sha2(chunk, 256) AS text_sha256 FROM lodestone_documents, LATERAL chunk_code(text, 700)").where(T.stripped_length("text") >= S.MIN_CHARS)
    path = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text_sha256", T.digest(F.lit("docs"), path, "chunk_index", "text_sha256").alias("id"), F.length("text").cast("long").alias("n"))


BROKEN_SQL = "(SELECT doc_id, replace(text, '. ', '.' || chr(CASE doc_id % 5 WHEN 0 THEN 12 WHEN 1 THEN 133 WHEN 2 THEN 8232 WHEN 3 THEN 11 ELSE 10 END)) AS text FROM documents)"


@query(f"""{chunk_cte(700, BROKEN_SQL, (11, 12, 133, 8232))} SELECT doc_id, i AS chunk_index, sha256(chunk) AS digest FROM c WHERE i >= 0""")
def chunk_other_breaks(spark, sf):
    """Chunks of texts with form feeds and other breaks, at which they are cut as well."""
    k = F.col("doc_id") % 5
    mark = F.when(k == 0, "\f").when(k == 1, "\x85").when(k == 2, "\u2028").when(k == 3, "\v").otherwise("\n")
    d = documents(spark, sf).select("doc_id", F.replace("text", F.lit(". "), F.concat(F.lit("."), mark)).alias("text"))
    return T.chunked(d, 700).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.sha2("text", 256).alias("digest"))


@query(f"""{chunk_cte(700, f"(SELECT * FROM ({NORM_SQL}) WHERE length(trim(text, {BLANKS_SQL}||chr(8232))) >= 40)", (8232,))}, s AS (SELECT source AS id, min(doc_id) % 2 AS label, min(doc_id) % 3 AS m FROM documents GROUP BY 1)
SELECT doc_id || '.txt' AS path, i AS chunk_index, source AS source_id, label, 'https://example.org/' || source AS repository_url, CASE m WHEN 0 THEN 'validation' ELSE 'train' END AS split, lang AS language,
  sha256(source || chr(0) || doc_id || '.txt' || chr(0) || i || chr(0) || sha256(chunk)) AS id FROM c JOIN (SELECT doc_id, source, lang FROM documents) USING (doc_id) JOIN s ON s.id = source WHERE i >= 0 AND length(trim(chunk, {BLANKS_SQL}||chr(8232))) >= 40""")
def chunk_records(spark, sf):
    """Chunk records: normalised, cut, joined with their sources' attributes."""
    files = messy(documents(spark, sf)).select(F.col("source").alias("source_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("lang").alias("language"), F.lit(None).cast("long").alias("size"), "text")
    first = documents(spark, sf).groupBy("source").agg(F.min("doc_id").alias("k"))
    label, split = F.col("k") % 2, F.when(F.col("k") % 3 == 0, "validation").otherwise("train")
    sources = first.select(F.col("source").alias("id"), label.alias("label"), F.when(label == 1, "ai").otherwise("human").alias("label_name"), F.lit("git").alias("kind"), F.concat(F.lit("https://example.org/"), "source").alias("url"), F.lit("").alias("revision"), split.alias("split"), F.col("k").alias("source_ord"))
    return C.records(files, sources, max_chars=700).select("path", F.col("chunk_index").cast("long").alias("chunk_index"), "source_id", "label", "repository_url", "split", "language", "id")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN NULL ELSE sha256(text) END AS digest FROM documents")
def decoded_content(spark, sf):
    """Texts of file contents; every fifth is not UTF-8 and every seventh holds a NUL."""
    k, raw = F.col("doc_id"), F.encode("text", "UTF-8")
    content = F.when(k % 5 == 0, F.concat(F.unhex(F.lit("C3")), F.lit(b"("), raw)).when(k % 7 == 0, F.concat(raw, F.lit(b"\0"))).otherwise(raw)
    return documents(spark, sf).select("doc_id", F.sha2(T.decoded(content), 256).alias("digest"))


# --- corpus -------------------------------------------------------------------------------------------
RECORDS_SQL = """SELECT doc_id, text, sha256(text) AS text_sha256, CAST(doc_id % 2 AS INTEGER) AS label, lang AS language, source AS source_id, 'd' || (doc_id % 7) || '/' || doc_id || '.txt' AS path, 0 AS chunk_index,
  CASE doc_id % 10 WHEN 8 THEN 'validation' WHEN 9 THEN 'test' ELSE 'train' END AS split, CAST(doc_id AS VARCHAR) AS id FROM documents"""
ORDER_SQL = "CASE split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END, source_id, string_split(path, '/'), chunk_index"
DEDUP_SQL = f"""r AS ({RECORDS_SQL}), o AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY text_sha256) AS n, first_value(label) OVER w AS l0 FROM r WINDOW w AS (PARTITION BY text_sha256 ORDER BY {ORDER_SQL})),
 g AS (SELECT *, min(CASE WHEN label <> l0 THEN rn END) OVER (PARTITION BY text_sha256) AS p FROM o)"""


def doc_records(spark, sf):
    k = F.col("doc_id")
    split = F.when(k % 10 == 8, "validation").when(k % 10 == 9, "test").otherwise("train")
    path = F.concat(F.lit("d"), (k % 7).cast("string"), F.lit("/"), k.cast("string"), F.lit(".txt"))
    return documents(spark, sf).select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"), (k % 2).cast("int").alias("label"), F.col("lang").alias("language"), F.col("source").alias("source_id"), path.alias("path"), F.lit(0).alias("chunk_index"), split.alias("split"), k.cast("string").alias("id"))


def order():
    return C.input_order(source="source_id")


@query(f"WITH {DEDUP_SQL} SELECT doc_id, split, source_id, path, label, text_sha256 FROM g WHERE p IS NULL AND rn = 1")
def dedup_corpus(spark, sf):
    return C.deduplicated(doc_records(spark, sf).drop("text"), order()).select("doc_id", "split", "source_id", "path", "label", "text_sha256")


@query(f"""WITH {DEDUP_SQL} SELECT CAST(sum(CASE WHEN p IS NULL THEN n - 1 ELSE p - 2 END) AS BIGINT) AS duplicate_count, CAST(sum(CASE WHEN p IS NULL THEN 0 ELSE n - p + 1 END) AS BIGINT) AS conflict_count, CAST(count_if(p IS NULL) AS BIGINT) AS kept FROM g WHERE rn = 1""")
def dedup_stats(spark, sf):
    return C.dedup_stats(doc_records(spark, sf).drop("text"), order())


@query(f"""WITH {DEDUP_SQL}, u AS (SELECT * FROM g WHERE p IS NULL AND rn = 1),
 k AS (SELECT *, row_number() OVER (PARTITION BY split, language, label ORDER BY sha256('{SEED}-' || split || chr(0) || language || chr(0) || id)) AS i, least(count_if(label = 0) OVER s, count_if(label = 1) OVER s) AS target FROM u WINDOW s AS (PARTITION BY split, language))
SELECT doc_id, split, language, label, sha256('{SEED}-' || split || chr(0) || 'output' || chr(0) || id) AS output_key FROM k WHERE i <= target""")
def balance_by_language(spark, sf):
    u = C.deduplicated(doc_records(spark, sf).drop("text"), order())
    return C.balanced(u, SEED).select("doc_id", "split", "language", "label", "output_key")


@query("""SELECT CASE WHEN grouping(lang) = 1 THEN 'TOTAL' ELSE lang END AS language, count_if(doc_id % 2 = 0)::BIGINT AS human, count_if(doc_id % 2 = 1)::BIGINT AS ai, count(*) AS total FROM documents GROUP BY ROLLUP (lang)""")
def language_breakdown(spark, sf):
    return C.breakdown(documents(spark, sf).select(F.col("lang").alias("language"), (F.col("doc_id") % 2).alias("label")))


@query("""SELECT CASE WHEN grouping(lang) = 1 THEN 'TOTAL' ELSE lang END AS language, count_if(doc_id % 2 = 0)::BIGINT AS human, count_if(doc_id % 2 = 1)::BIGINT AS ai, count(*) AS total FROM documents GROUP BY ROLLUP (lang)""")
def merged_breakdown(spark, sf):
    """The breakdowns of train and of the other splits, as two datasets, merged."""
    d = documents(spark, sf).select(F.col("lang").alias("language"), (F.col("doc_id") % 2).alias("label"), F.col("doc_id") % 10 < 8)
    d = d.toDF("language", "label", "train")
    return C.merged(*(C.breakdown(d.where(c).drop("train")) for c in ("train", "NOT train")))


@query(f"""SELECT split, CASE WHEN label = 1 THEN 'ai' ELSE 'human' END AS label_name, count(*) AS n FROM ({RECORDS_SQL}) GROUP BY 1, 2""")
def split_summary(spark, sf):
    return C.split_counts(doc_records(spark, sf).select("split", "label"))


@query("""SELECT s.source_id, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT source AS source_id FROM documents UNION ALL SELECT 'unused') s LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) c ON c.source = s.source_id""")
def chunks_per_source(spark, sf):
    d = documents(spark, sf)
    s = d.select(F.col("source").alias("id")).distinct().unionByName(spark.range(1).select(F.lit("unused").alias("id")))
    return C.source_counts(d.select(F.col("source").alias("source_id")), s)


@query("""WITH r AS (SELECT doc_id, lang, doc_id % 3 = 1 AS ai, row_number() OVER (PARTITION BY lang, doc_id % 3 = 1 ORDER BY doc_id) AS i FROM documents),
 p AS (SELECT h.doc_id AS h, a.doc_id AS a FROM r h JOIN r a ON h.lang = a.lang AND h.i = a.i AND NOT h.ai AND a.ai ORDER BY greatest(h.doc_id, a.doc_id), least(h.doc_id, a.doc_id) LIMIT 150)
SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT h FROM p UNION ALL SELECT a FROM p)""")
def truncate_balanced(spark, sf):
    d = documents(spark, sf).select("doc_id", "lang", F.col("lang").alias("language"), F.when(F.col("doc_id") % 3 == 1, 1).otherwise(0).alias("label"), F.col("doc_id").alias("position"))
    return C.truncated_pairs(d, 301).select("doc_id", "lang")


@query("""SELECT b.item_id, min(d.doc_id) AS first_doc, count(DISTINCT d.doc_id) AS n_docs FROM (SELECT DISTINCT item_id, sha256(unnest(string_split(text, chr(10)))) AS h FROM benchmark) b JOIN (SELECT DISTINCT doc_id, sha256(unnest(string_split(text, chr(10)))) AS h FROM documents) d USING (h) GROUP BY b.item_id""")
def exact_leaks(spark, sf):
    """Benchmark items that share a whole line with a document, by content hash."""
    line = lambda t, k: t.select(k, F.explode(F.split("text", "\n")).alias("line")).select(k, F.sha2("line", 256).alias("h")).distinct()
    b, d = line(spark.read.parquet(f"{sf}/benchmark.parquet"), "item_id"), line(documents(spark, sf), "doc_id")
    return C.leaks(b, d)


# --- windows, scores, metrics -------------------------------------------------------------------------
WORDS_SQL = r"list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
WINDOWS_SQL = f"""n AS (SELECT doc_id, len({WORDS_SQL}) AS n, {WORDS_SQL} AS ws FROM documents),
 w AS (SELECT doc_id, n, ws, unnest(range(0, 1 + greatest(0, CAST(ceil((n - 128) / 112.0) AS BIGINT)))) AS i FROM n WHERE n > 0)"""


def doc_windows(spark, sf):
    d = documents(spark, sf).select("doc_id", W.words(F.col("text")).alias("ids"))
    return W.windowed(d, "ids", 128, 16)


@query(f"""WITH {WINDOWS_SQL} SELECT doc_id, i AS window_index, md5(list_aggregate(list_transform(list_slice(ws, i * 112 + 1, i * 112 + 128), lambda x: CAST(CAST('0x' || substr(md5(x), 1, 7) AS BIGINT) AS VARCHAR)), 'string_agg', ',')) AS ids_md5 FROM w""")
def token_windows(spark, sf):
    return doc_windows(spark, sf).select("doc_id", F.col("window_index").cast("long").alias("window_index"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_md5"))


@query(SQL["token_windows"])
def token_windows_sql(spark, sf):
    """token_windows by SQL text over the table function of that name."""
    tables.register(spark)
    documents(spark, sf).select("doc_id", W.words(F.col("text")).alias("ids")).createOrReplaceTempView("lodestone_tokens")
    w = spark.sql("SELECT t.doc_id, w.window_index, w.ids FROM lodestone_tokens t, LATERAL token_windows(t.ids, 128, 16) w")
    return w.select("doc_id", F.col("window_index").cast("long").alias("window_index"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_md5"))


@query(f"""WITH {WINDOWS_SQL}, c AS (SELECT doc_id, count(*) AS n_windows FROM w GROUP BY 1) SELECT doc_id, n_windows, round((SELECT avg(n_windows) FROM c) / n_windows, 9) AS sample_weight FROM c""")
def window_weights(spark, sf):
    counts = W.window_counts(documents(spark, sf), "doc_id", F.regexp_count("text", F.lit(W.WORD)), 128, 16)
    return W.counted_weights(counts, "doc_id").select("doc_id", "n_windows", r9(F.col("sample_weight")).alias("sample_weight"))


@query(f"""WITH {WINDOWS_SQL}, c AS (SELECT doc_id, count(*) AS n_windows FROM w GROUP BY 1) SELECT w.doc_id, i AS window_index, len(list_slice(ws, i * 112 + 1, i * 112 + 128)) AS n_tokens, round((SELECT avg(n_windows) FROM c) / n_windows, 9) AS sample_weight FROM w JOIN c ON c.doc_id = w.doc_id""")
def weighted_windows(spark, sf):
    """Windows with their records' weights."""
    d = documents(spark, sf).select("doc_id", "text", W.words(F.col("text")).alias("ids"))
    w = W.weighted_windows(d, F.regexp_count("text", F.lit(W.WORD)), "ids", 128, 16)
    return w.select("doc_id", F.col("window_index").cast("long").alias("window_index"), F.size("ids").cast("long").alias("n_tokens"), r9(F.col("sample_weight")).alias("sample_weight"))


def score_sql(f: str) -> str:
    return f"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT doc_id, CAST(CAST('0x' || substr(sha256(line), 1, 4) AS BIGINT) / 65535.0 AS FLOAT) AS p FROM s WHERE trim(line) <> '')
SELECT doc_id, round(ai_probability, 6) AS ai_probability, round(1 - ai_probability, 6) AS human_probability, CASE WHEN ai_probability >= 0.5 THEN 'ai' ELSE 'human' END AS prediction FROM (SELECT doc_id, {f}(CAST(p AS DOUBLE)) AS ai_probability FROM p GROUP BY 1)"""


def file_scores(spark, sf, how):
    lines = documents(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    s = W.record_scores(lines.select("doc_id", K.hash_score(F.col("line")).alias("score")), "doc_id", "score", how)
    return s.select("doc_id", F.round("score", 6).alias("ai_probability"), F.round(1 - F.col("score"), 6).alias("human_probability"), K.decision(F.col("score")).alias("prediction"))


@query(score_sql("avg"))
def score_files_mean(spark, sf):
    return file_scores(spark, sf, "mean")


@query(score_sql("max"))
def score_files_max(spark, sf):
    return file_scores(spark, sf, "max")


@query("""SELECT event_id, round(exp(a - greatest(h, a)) / (exp(a - greatest(h, a)) + exp(h - greatest(h, a))), 9) AS ai FROM (SELECT event_id, value AS h, value * 0.5 + (event_id % 17) - 8 AS a FROM events)""")
def softmax_scores(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("value").alias("h"), (F.col("value") * 0.5 + (F.col("event_id") % 17) - 8).alias("a"))
    return e.select("event_id", r9(K.softmax_ai(F.col("h"), F.col("a"))).alias("ai"))


PRED_SQL = "p AS (SELECT CAST(event_id % 3 = 0 AS INTEGER) AS label, (hour(ts) * 7 + minute(ts) + event_id % 5) % 101 / 100.0 AS score FROM events)"


def predictions(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select((F.col("event_id") % 3 == 0).cast("int").alias("label"), ((F.hour("ts") * 7 + F.minute("ts") + F.col("event_id") % 5) % 101 / 100.0).cast("double").alias("score"))


@query(f"""WITH {PRED_SQL}, c AS (SELECT count_if(score >= 0.5 AND label = 1)::BIGINT AS tp, count_if(score >= 0.5 AND label = 0)::BIGINT AS fp, count_if(score < 0.5 AND label = 1)::BIGINT AS fn, count_if(score < 0.5 AND label = 0)::BIGINT AS tn FROM p),
 m AS (SELECT *, tp / greatest(tp + fp, 1) AS pr, tp / greatest(tp + fn, 1) AS re FROM c)
SELECT tp, fp, fn, tn, round(pr, 9) AS "precision", round(re, 9) AS recall, round(2 * pr * re / greatest(pr + re, 1e-12), 9) AS f1, round((tp + tn) / greatest(tp + fp + fn + tn, 1), 9) AS accuracy FROM m""")
def confusion_metrics(spark, sf):
    c = M.confusion(predictions(spark, sf))
    return c.select("tp", "fp", "fn", "tn", *[r9(F.col(x)).alias(x) for x in ("precision", "recall", "f1", "accuracy")])


@query(f"""WITH {PRED_SQL}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM p), s AS (SELECT sum(CASE WHEN label = 1 THEN k END) AS w, count_if(label = 1)::DOUBLE AS a, count_if(label = 0)::DOUBLE AS b FROM r) SELECT round((w - a * (a + 1) / 2) / (a * b), 9) AS auroc FROM s""")
def auroc(spark, sf):
    return M.auroc(predictions(spark, sf)).select(r9(F.col("auroc")).alias("auroc"))


@query(f"""WITH {PRED_SQL}, g AS (SELECT score, sum(label) AS pos, count(*) AS n FROM p GROUP BY 1), c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS k FROM g WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(pos * (tp / k)) / sum(pos), 9) AS average_precision FROM c""")
def average_precision(spark, sf):
    return M.average_precision(predictions(spark, sf)).select(r9(F.col("average_precision")).alias("average_precision"))


@query(f"""WITH {PRED_SQL} SELECT round(avg(-ln(greatest(CASE WHEN label = 1 THEN score ELSE 1 - score END, 1e-12)) * (1 + label)), 6) AS loss FROM p""")
def weighted_loss(spark, sf):
    return M.weighted_loss(predictions(spark, sf).withColumn("weight", 1 + F.col("label"))).select(F.round("loss", 6).alias("loss"))


# --- paths and selection ------------------------------------------------------------------------------
# names of a made tree: directories, file names by position, from doc_id alone
TREE_DIRS = ("", "src/", "src/core/", "vendor/", ".git/", "web/node_modules/", "lib-x/", "lib/", "lib/é/", "build2/")
TREE_NAMES = ("main.rs", "app.min.js", "README.md", ".config.js", "x.py", "y_pb2.py", "Makefile", "noext", "Z.PY", "a.tar.gz", "cargo.lock", "data.sql", ".py", "types.d.ts")


def values_sql(xs) -> str:
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]"


TREE_SQL = f"""tree AS (SELECT source AS repo, list_extract({values_sql(TREE_DIRS)}, CAST(doc_id // 3 % 10 + 1 AS INTEGER)) || CASE WHEN doc_id % 14 IN (3, 6, 10, 12) THEN 'o' || doc_id || '/' ELSE 'f' || doc_id || '_' END || list_extract({values_sql(TREE_NAMES)}, CAST(doc_id % 14 + 1 AS INTEGER)) AS path, n_chars * 700 AS size FROM documents)"""


def tree_files(spark, sf):
    d, k = documents(spark, sf), F.col("doc_id")
    folder = F.element_at(F.array(*map(F.lit, TREE_DIRS)), (F.floor(k / 3) % 10 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, TREE_NAMES)), (k % 14 + 1).cast("int"))
    # names that have no room for a number of their own lie in a folder of their own
    own = F.when((k % 14).isin(3, 6, 10, 12), F.format_string("o%d/", k)).otherwise(F.format_string("f%d_", k))
    return d.select(F.col("source").alias("repo"), F.concat(folder, own, name).alias("path"), (F.col("n_chars") * 700).alias("size"))


def tree_entries(spark, sf):
    """Files, the directories above them, and some directories that could not be listed."""
    f = tree_files(spark, sf)
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    up = f.where(F.size(parts) > 1).select("repo", F.explode(above).alias("path")).distinct()
    folder = lambda rows, bad: rows.select("repo", "path", F.lit(True).alias("is_dir"), F.lit(None).cast("long").alias("size"), F.lit(bad).alias("errored"))
    locked = documents(spark, sf).select(F.col("source").alias("repo"), F.concat(F.lit("locked"), (F.col("doc_id") % 3).cast("string")).alias("path")).distinct()
    return f.select("repo", "path", F.lit(False).alias("is_dir"), "size", F.lit(False).alias("errored")).unionByName(folder(up, False)).unionByName(folder(locked, True))


GEN_SQL = " OR ".join(f"ends_with(lower(name), '{s}')" for s in S.GENERATED_SUFFIXES)
SCAN_DIRS_SQL = "(" + ", ".join(f"'{d}'" for d in S.SCAN_DIRECTORIES) + ")"
EXT_SQL = "(" + ", ".join(f"'{d}'" for d in S.SCAN_EXTENSIONS) + ")"
HEX_SQL = "list_transform(parts[:-2], lambda c: translate(hex(c), '0123456789ABCDEF', 'FEDCBA9876543210') || 'G')"
WALK_SQL = f"""{TREE_SQL}, e AS (SELECT repo, path, false AS is_dir, size FROM tree UNION ALL SELECT DISTINCT repo, array_to_string(list_slice(string_split(path, '/'), 1, i), '/'), true, NULL FROM (SELECT repo, path, unnest(range(1, len(string_split(path, '/')))) AS i FROM tree) UNION ALL SELECT DISTINCT source, 'locked' || doc_id % 3, true, NULL FROM documents),
 s AS (SELECT *, string_split(path, '/') AS parts, string_split(path, '/')[-1] AS name FROM e),
 k AS (SELECT * FROM s WHERE len(list_filter(parts[:-2], lambda d: starts_with(d, '.') OR d IN {SCAN_DIRS_SQL})) = 0),
 q AS (SELECT *, CASE WHEN is_dir THEN CASE WHEN starts_with(name, '.') OR name IN {SCAN_DIRS_SQL} THEN 'pruned' WHEN starts_with(path, 'locked') THEN 'unreadable' ELSE 'directory' END WHEN regexp_extract(lower(name), '^.+[.]([^.]*)$', 1) NOT IN {EXT_SQL} THEN 'extension' WHEN starts_with(name, '.') OR {GEN_SQL} THEN 'pattern' WHEN size > 2097152 THEN 'too_large' ELSE 'candidate' END AS reason FROM k),
 w AS (SELECT *, count_if(reason = 'candidate') OVER (PARTITION BY repo ORDER BY {HEX_SQL}, name ROWS UNBOUNDED PRECEDING) AS c FROM q), z AS (SELECT * FROM w WHERE c < 10000 OR (c = 10000 AND reason = 'candidate'))"""


@query(f"""WITH {WALK_SQL} SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY {HEX_SQL}, name) AS candidate_index FROM z WHERE reason = 'candidate'""")
def select_candidates(spark, sf):
    return selection.candidates(tree_entries(spark, sf)).select("repo", "path", F.col("candidate_index").cast("long").alias("candidate_index"))


@query(f"""WITH {WALK_SQL} SELECT repo, count_if(NOT is_dir)::BIGINT AS files_seen, count_if(reason = 'candidate')::BIGINT AS files_selected, count_if(reason = 'extension')::BIGINT AS files_skipped_extension, count_if(reason = 'pattern')::BIGINT AS files_skipped_pattern, count_if(reason = 'too_large')::BIGINT AS files_skipped_too_large, count_if(reason = 'pruned')::BIGINT AS directories_pruned, count_if(reason = 'unreadable')::BIGINT AS directories_errored, count_if(reason = 'candidate') >= 10000 AS truncated FROM z GROUP BY repo""")
def selection_stats(spark, sf):
    return selection.selection_stats(tree_entries(spark, sf))


LANG_SQL = "CASE lower(name) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.NAME_LANGUAGE.items()) + " ELSE CASE regexp_extract(lower(name), '^[.]*[^.].*([.][^.]+)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.SUFFIX_LANGUAGE.items()) + " END END"
PREP_SQL = f"""({LANG_SQL}) IS NOT NULL AND len(list_filter(string_split(lower(path), '/'), lambda x: x IN ('{"', '".join(S.PREP_FILES)}'))) = 0 AND len(list_filter(string_split(lower(path), '/')[:-2], lambda x: x IN ('{"', '".join(S.PREP_DIRECTORIES)}'))) = 0"""


@query(f"""WITH {TREE_SQL} SELECT repo, path, {LANG_SQL} AS language, {PREP_SQL} AS selected FROM (SELECT *, string_split(path, '/')[-1] AS name FROM tree)""")
def language_of_path(spark, sf):
    return tree_files(spark, sf).select("repo", "path", P.language_of("path").alias("language"), P.prep_selected("path").alias("selected"))


@query(f"""WITH {TREE_SQL} SELECT repo, path FROM tree WHERE (path = 'src' OR starts_with(path, 'src/') OR starts_with(path, 'lib/')) AND NOT starts_with(path, 'src/core/')""")
def path_filter(spark, sf):
    include, exclude = F.array(F.lit("src"), F.lit("lib")), F.array(F.lit("src/core"))
    return tree_files(spark, sf).where(P.member_included(F.col("path"), include, exclude)).select("repo", "path")


ADDRESS_SQL = """CASE page_id % 8 WHEN 0 THEN 'https://github.com/o' || page_id || '/R.git/' WHEN 1 THEN 'git@github.com:o' || page_id || '/r.GIT' WHEN 2 THEN 'o' || page_id || '/r-x' WHEN 3 THEN 'GitHub.com:o/r' || page_id WHEN 4 THEN url WHEN 5 THEN 'a/..' WHEN 6 THEN ' http://GITHUB.com/o/' || page_id || '?x=1 ' ELSE 'o/r/' || page_id END"""


def addresses(spark, sf):
    k = F.col("page_id").cast("string")
    m = F.col("page_id") % 8
    a = F.when(m == 0, F.concat(F.lit("https://github.com/o"), k, F.lit("/R.git/"))).when(m == 1, F.concat(F.lit("git@github.com:o"), k, F.lit("/r.GIT"))).when(m == 2, F.concat(F.lit("o"), k, F.lit("/r-x"))).when(m == 3, F.concat(F.lit("GitHub.com:o/r"), k)).when(m == 4, F.col("url")).when(m == 5, "a/..").when(m == 6, F.concat(F.lit(" http://GITHUB.com/o/"), k, F.lit("?x=1 "))).otherwise(F.concat(F.lit("o/r/"), k))
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", a.alias("address"))


@query(f"""SELECT page_id, CASE WHEN ok THEN owner END AS owner, CASE WHEN ok THEN name END AS name FROM (SELECT page_id, owner, regexp_replace(n, '(?i)[.]git$', '') AS name, owner NOT IN ('', '.', '..') AND n NOT IN ('', '.', '..') AS ok FROM (
 SELECT page_id, coalesce(nullif(regexp_extract(v, '^(?:[^/:]*@)?(?i:github[.]com):([^/]*)/([^/]*)$', 1), ''), nullif(regexp_extract(v, '^(?i:https?)://(?i:github[.]com)/+([^/?#]+)/+([^/?#]+)/*(?:[?#].*)?$', 1), ''), CASE WHEN NOT contains(v, '://') AND NOT regexp_matches(v, '^(?:[^/:]*@)?(?i:github[.]com):') THEN regexp_extract(v, '^([^/]*)/([^/]*)$', 1) ELSE '' END) AS owner,
  coalesce(nullif(regexp_extract(v, '^(?:[^/:]*@)?(?i:github[.]com):([^/]*)/([^/]*)$', 2), ''), nullif(regexp_extract(v, '^(?i:https?)://(?i:github[.]com)/+([^/?#]+)/+([^/?#]+)/*(?:[?#].*)?$', 2), ''), CASE WHEN NOT contains(v, '://') THEN regexp_extract(v, '^([^/]*)/([^/]*)$', 2) ELSE '' END) AS n
 FROM (SELECT page_id, regexp_replace(trim({ADDRESS_SQL}), '/+$', '') AS v FROM pages)))""")
def parse_repository(spark, sf):
    r = P.repository(F.col("address"))
    return addresses(spark, sf).select("page_id", r["owner"].alias("owner"), r["name"].alias("name"))


@query(f"""SELECT page_id, owner, name FROM (SELECT page_id, regexp_extract(v, p, 1) AS owner, regexp_replace(regexp_extract(v, p, 2), '(?i)[.]git$', '') AS name FROM (SELECT page_id, regexp_replace(trim({ADDRESS_SQL}), '/+$', '') AS v, '^(?:(?i:https?)://(?i:github[.]com)/+|(?:[^/:]*@)?(?i:github[.]com):)([^/?#]+)/+([^/?#]+)/*(?:[?#].*)?$' AS p FROM pages)) WHERE owner NOT IN ('', '.', '..') AND name NOT IN ('', '.', '..')""")
def hosted_repository(spark, sf):
    """The strict form: addresses of the host alone, no bare owner/name."""
    r = P.repository(F.col("address"), bare=False)
    return addresses(spark, sf).where(r.isNotNull()).select("page_id", r["owner"].alias("owner"), r["name"].alias("name"))


@query(f"""SELECT page_id, CASE page_id % 8 WHEN 4 THEN 'host' WHEN 5 THEN 'segments' WHEN 7 THEN 'segments' END AS problem FROM pages""")
def address_problems(spark, sf):
    return addresses(spark, sf).select("page_id", P.address_problem(F.col("address")).alias("problem"))


@query(f"""WITH {TREE_SQL} SELECT repo, path, 'https://api.github.com/repos/own%20er/' || url_encode(repo) || '/contents/' || array_to_string(list_transform(string_split(path, '/'), lambda x: url_encode(x)), '/') AS url FROM tree""")
def contents_urls(spark, sf):
    return tree_files(spark, sf).select("repo", "path", P.contents_url(F.lit("https://api.github.com/"), F.lit("own er"), F.col("repo"), F.col("path")).alias("url"))


@query(f"""SELECT page_id, nullif(trim(regexp_replace(lower(regexp_replace(regexp_extract(regexp_replace(trim({ADDRESS_SQL}), '/+$', ''), '([^/:]*)$', 1), '(?i)[.]git$', '')), '[^a-z0-9]+', '-', 'g'), '-'), '') AS slug FROM pages""")
def source_slug(spark, sf):
    return addresses(spark, sf).select("page_id", P.source_slug(F.col("address")).alias("slug"))


@query("""SELECT page_id, CASE WHEN regexp_full_match(f, '[0-9A-Fa-f]{40,64}') THEN lower(f) END AS revision FROM (SELECT page_id, trim(string_split(CASE page_id % 4 WHEN 0 THEN sha256(url) || chr(10) || 'HEAD' WHEN 1 THEN ' ' || upper(substr(sha256(url), 1, 40)) WHEN 2 THEN substr(sha256(url), 1, 39) ELSE url END, chr(10))[1]) AS f FROM pages)""")
def full_revision(spark, sf):
    m, digest = F.col("page_id") % 4, F.sha2("url", 256)
    t = F.when(m == 0, F.concat(digest, F.lit("\nHEAD"))).when(m == 1, F.concat(F.lit(" "), F.upper(F.substring(digest, 1, 40)))).when(m == 2, F.substring(digest, 1, 39)).otherwise(F.col("url"))
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", P.revision_of(t).alias("revision"))


@query("""SELECT page_id, CASE WHEN NOT starts_with(p, '/') AND len(list_filter(string_split(p, '/'), lambda x: x = '..')) = 0 THEN array_to_string(list_filter(string_split(p, '/'), lambda x: x NOT IN ('', '.')), '/') END AS path FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN './src//lib.rs' WHEN 1 THEN '/abs' WHEN 2 THEN 'a/../' || page_id ELSE url END AS p FROM pages)""")
def normalize_path(spark, sf):
    m = F.col("page_id") % 4
    p = F.when(m == 0, "./src//lib.rs").when(m == 1, "/abs").when(m == 2, F.concat(F.lit("a/../"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", P.relative_path(p).alias("path"))


@query("""WITH s AS (SELECT CASE WHEN doc_id % 41 = 0 THEN 'Bad Id' ELSE source || '-' || doc_id // 2 END AS id, CASE WHEN doc_id % 13 = 0 THEN 'svn' ELSE 'git' END AS kind, CAST(doc_id % 2 + CASE WHEN doc_id % 29 = 0 THEN 5 ELSE 0 END AS INTEGER) AS label, CASE WHEN doc_id % 4 = 1 THEN 'ai' ELSE 'human' END AS label_name, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM documents)
SELECT id, split, 'id' AS rule FROM s WHERE NOT regexp_full_match(id, '[a-z0-9]+(?:[._-][a-z0-9]+)*') UNION ALL SELECT id, split, 'kind' FROM s WHERE kind NOT IN ('git', 'github', 'samples') UNION ALL SELECT id, split, 'label' FROM s WHERE label NOT IN (0, 1) UNION ALL SELECT id, split, 'label_name' FROM s WHERE label IN (0, 1) AND label_name <> CASE WHEN label = 1 THEN 'ai' ELSE 'human' END
UNION ALL SELECT id, split, 'twice' FROM s GROUP BY id, split HAVING count(*) > 1 UNION ALL SELECT id, min(split), 'two_splits' FROM s GROUP BY id HAVING count(DISTINCT split) > 1""")
def validate_manifest(spark, sf):
    from .sources.manifest import violations

    k = F.col("doc_id")
    s = documents(spark, sf).select(
        F.when(k % 41 == 0, "Bad Id").otherwise(F.concat("source", F.lit("-"), F.floor(k / 2).cast("string"))).alias("id"), F.when(k % 13 == 0, "svn").otherwise("git").alias("kind"),
        (k % 2 + F.when(k % 29 == 0, 5).otherwise(0)).cast("int").alias("label"), F.when(k % 4 == 1, "ai").otherwise("human").alias("label_name"), F.when(k % 10 < 8, "train").otherwise("test").alias("split"),
    )
    return violations(s)


# --- estimate -----------------------------------------------------------------------------------------
TRIM_SQL = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)"
STEPS_SQL = f"""d AS (SELECT source AS repo, doc_id, CASE WHEN doc_id % 11 = 0 THEN '  ' || chr(10) WHEN doc_id % 17 = 0 THEN '@generated ' || text ELSE text END AS text, row_number() OVER (PARTITION BY source ORDER BY sha256('step' || chr(0) || doc_id)) AS step, count(*) OVER (PARTITION BY source) AS candidates FROM documents),
 l AS (SELECT repo, step, text, CAST(CAST('0x' || substr(sha256(line), 1, 4) AS BIGINT) / 65535.0 AS FLOAT) AS p FROM (SELECT repo, step, text, unnest(string_split(substr(text, 1, 131072), chr(10))) AS line FROM d) WHERE trim(line, {TRIM_SQL}) <> ''),
 a AS (SELECT repo, step, count(*) AS chunks, count_if(p >= 0.5) AS ai_chunks, sum(CAST(p AS DOUBLE)) AS psum FROM l GROUP BY 1, 2),
 t AS (SELECT d.repo, d.step, d.candidates, CASE WHEN (length(d.text) > 4096 AND NOT contains(substr(d.text, 1, 4096), chr(10))) OR {MARK_SQL.replace("(t, 1", "(d.text, 1")} THEN 'generated' WHEN a.chunks IS NULL THEN 'errored' ELSE 'scanned' END AS status, a.chunks, a.ai_chunks, a.psum FROM d LEFT JOIN a ON a.repo = d.repo AND a.step = d.step),
 s AS (SELECT repo, step, (candidates - count_if(status <> 'scanned') OVER w)::BIGINT AS population, (count_if(status = 'scanned') OVER w)::BIGINT AS n, count_if(status = 'generated') OVER w AS files_generated, count_if(status = 'errored') OVER w AS files_errored,
   count_if(status = 'scanned' AND CAST(psum / chunks AS FLOAT) >= 0.5) OVER w AS files_ai, coalesce(sum(CASE WHEN status = 'scanned' THEN chunks END) OVER w, 0)::HUGEINT AS m, coalesce(sum(CASE WHEN status = 'scanned' THEN ai_chunks END) OVER w, 0)::HUGEINT AS a, sum(CASE WHEN status = 'scanned' THEN psum END) OVER w AS ps,
   coalesce(sum(CASE WHEN status = 'scanned' THEN chunks * chunks END) OVER w, 0)::HUGEINT AS mm, coalesce(sum(CASE WHEN status = 'scanned' THEN chunks * ai_chunks END) OVER w, 0)::HUGEINT AS ma, coalesce(sum(CASE WHEN status = 'scanned' THEN ai_chunks * ai_chunks END) OVER w, 0)::HUGEINT AS aa
   FROM t WINDOW w AS (PARTITION BY repo ORDER BY step ROWS UNBOUNDED PRECEDING)),
 h AS (SELECT *, CASE WHEN m = 0 THEN NULL WHEN n >= population THEN 0.0 WHEN n < 2 THEN NULL ELSE {S.Z_99} * sqrt(greatest(0.0, (1 - n / population) * n * CAST(m * m * aa - 2 * a * m * ma + a * a * mm AS DOUBLE) / (n - 1))) / (CAST(m AS DOUBLE) * CAST(m AS DOUBLE)) END AS hw FROM s),
 f AS (SELECT repo, CAST(step AS BIGINT) AS step, population, n AS files_scanned, files_generated::BIGINT AS files_generated, files_errored::BIGINT AS files_errored, files_ai::BIGINT AS files_ai, (n - files_ai)::BIGINT AS files_human, m::BIGINT AS chunks_scanned, a::BIGINT AS chunks_ai, (m - a)::BIGINT AS chunks_human, round(CASE WHEN hw IS NOT NULL THEN a / m END, 9) AS fraction, round(hw, 9) AS half_width, round(CASE WHEN hw IS NOT NULL THEN greatest(0.0, a / m - hw) END, 9) AS low, round(CASE WHEN hw IS NOT NULL THEN least(1.0, a / m + hw) END, 9) AS high, round(CASE WHEN m > 0 THEN ps / m END, 9) AS mean_probability, hw FROM h)"""
ROUNDED = ("fraction", "half_width", "low", "high", "mean_probability")
COUNTS = ("population", "files_scanned", "files_generated", "files_errored", "files_ai", "files_human", "chunks_scanned", "chunks_ai", "chunks_human")


def scan_steps(spark, sf):
    """Each source as a repository whose documents come in the order of a hash."""
    k = F.col("doc_id")
    text = F.when(k % 11 == 0, "  \n").when(k % 17 == 0, F.concat(F.lit("@generated "), F.col("text"))).otherwise(F.col("text"))
    keyed = documents(spark, sf).select("source", "doc_id", T.digest(F.lit("step"), "doc_id").alias("_key"))
    order_ = running(keyed, ["source"], hex_bucket(F.col("_key"), documents(spark, sf).count()), ["_key"], {"step": F.lit(1)}).drop("_key")
    d = documents(spark, sf).select("doc_id", text.alias("text")).join(order_, "doc_id").withColumnRenamed("source", "repo")
    return scan.scored_steps(d, lambda line: K.hash_score(line))


@query(f"WITH {STEPS_SQL} SELECT repo, step, {', '.join(COUNTS)}, {', '.join(ROUNDED)} FROM f")
def estimate_trajectory(spark, sf):
    t = E.trajectory(scan_steps(spark, sf))
    return t.select("repo", F.col("step").cast("long").alias("step"), *COUNTS, *[r9(F.col(c)).alias(c) for c in ROUNDED])


@query(f"""WITH {STEPS_SQL}, x AS (SELECT *, CASE WHEN files_scanned >= 10 AND hw <= 0.05 THEN 'precision_reached' WHEN chunks_scanned >= 50000 THEN 'chunk_budget_exhausted' END AS stop FROM f),
 y AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN stop IS NOT NULL THEN step END ASC NULLS LAST, step DESC) AS k FROM x)
SELECT repo, step, {', '.join(COUNTS)}, {', '.join(ROUNDED)}, coalesce(stop, 'all_files_scanned') AS stop_reason FROM y WHERE k = 1""")
def repo_stats(spark, sf):
    t = E.repo_stats(scan_steps(spark, sf))
    return t.select("repo", F.col("step").cast("long").alias("step"), *COUNTS, *[r9(F.col(c)).alias(c) for c in ROUNDED], "stop_reason")


@query(SQL["repo_stats"])
def progress_stream(spark, sf):
    """repo_stats by the stream: steps are replayed in micro-batches, and each repository's last progress is what remains."""
    last = progress.last_progress(replay.replayed(scan_steps(spark, sf), 128, most=1 << 16))
    return last.select("repo", F.col("step").cast("long").alias("step"), *COUNTS, *[r9(F.col(c)).alias(c) for c in ROUNDED], "stop_reason")


def shuffle_sql(sizes: str) -> str:
    """shuffled(repo, candidate_index, step) from a query of (repo, n): the swaps one by one in a recursive CTE."""
    return f"""counted AS ({sizes}),
 swaps(repo, n, i, k, l) AS (SELECT repo, n, n - 1, 1, range(1, n + 1) FROM counted UNION ALL
  SELECT repo, n, i - 1, k + 1, list_transform(l, lambda v, q: CASE WHEN q = i + 1 THEN l[j + 1] WHEN q = j + 1 THEN l[i + 1] ELSE v END) FROM (SELECT *, CAST((z2 * (i + 1)::UHUGEINT) // 18446744073709551616::UHUGEINT AS BIGINT) AS j FROM (SELECT *, xor(z1, z1 // 2147483648::UHUGEINT) AS z2 FROM (SELECT *, (xor(y1, y1 // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS z1 FROM (
   SELECT *, (xor(x, x // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS y1 FROM (SELECT *, (7::UHUGEINT + k::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS x FROM swaps WHERE i > 0)))))),
 shuffled AS (SELECT repo, CAST(l[step] AS INTEGER) AS candidate_index, CAST(step AS INTEGER) AS step FROM (SELECT repo, l, unnest(range(1, n + 1)) AS step FROM swaps WHERE i <= 0))"""


@query("SELECT doc_id, lang FROM documents WHERE lower(lang) = 'en'")
def language_records(spark, sf):
    """Records of one language, asked for in another case."""
    d = documents(spark, sf).select("doc_id", F.col("lang").alias("language"))
    return C.only_language(d, "EN").select("doc_id", F.col("language").alias("lang"))


@query(f"""WITH RECURSIVE {shuffle_sql("SELECT source AS repo, least(count(*), 10000) AS n FROM documents GROUP BY 1")} SELECT * FROM shuffled""")
def sample_order(spark, sf):
    sizes = documents(spark, sf).groupBy(F.col("source").alias("repo")).agg(F.least(F.count("*"), F.lit(S.SCAN_MAX_FILES)).alias("n"))
    return sampling.sample_steps(sizes, 7)


@query(f"""WITH RECURSIVE {WALK_SQL}, c AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY {HEX_SQL}, name) AS candidate_index FROM z WHERE reason = 'candidate'),
 {shuffle_sql("SELECT repo, count(*) AS n FROM c GROUP BY 1")} SELECT repo, path, step FROM c JOIN shuffled USING (repo, candidate_index)""")
def sampled_candidates(spark, sf):
    """Candidates of the walk with the step at which the shuffle takes them."""
    return sampling.sampled(selection.candidates(tree_entries(spark, sf)), 7).select("repo", "path", "step")
