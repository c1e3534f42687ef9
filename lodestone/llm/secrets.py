"""Secret scans with DataFrame functions only: base patterns, and a randomness battery under false-discovery control.

Base kinds (assign, access, hex) are regular expressions; positions follow from the text between matches,
in code points. The battery looks at every other run of SHORTEST or more encoding characters (kind "random"):

1. The encoding (hex, HEX, base32, lower, letters, base64) is the smallest alphabet that covers the run.
2. Three tests: chi-squared over the alphabet with the finite-sample variance, runs above and below the
   alphabet's middle, and lag-1 serial correlation. Each gives a normal deviate from independent uniform
   characters; a run that one of three Bonferroni-corrected tests rejects at ALPHA is no candidate.
3. Each statistic is also held against written language. Chi-squared is n times the pairs of equal characters up to
   constants; language has the corpus's own rate of those (the index of coincidence of all lower-case strings,
   LANGUAGE_RATE at least; in a to f alone HEX_RATE at least). Runs and serial correlation drift by a
   share of sqrt(n) in language: the corpus's means over the strings of an encoding that step 2 rejects, each within
   DRIFT. The three deviates from language are summed with the weights of their expected shifts under uniform
   characters (the best linear test), so that a test that cannot tell both apart has no say; the sum's upper tail is
   the p-value that language wrote the string.
4. Length-aware control: p-values are divided by weights in proportion to length (mean 1 over all distinct
   candidates), as in weighted Benjamini-Hochberg, at rate FDR over all candidates of the corpus. Ranks are
   cumulative counts of p-values in steps of 0.01 of their logarithm, so nothing is sorted globally.

Null text counts as empty; an empty table gives no rows. Repeated rows are scanned each by itself. The caller's
columns travel in one struct, so no name of theirs clashes with one used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, stored

# The base patterns.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
SHORTEST = 20
RUN = r"[A-Za-z0-9+/_=-]{%d,}"
KINDS = ("assign", "access", "hex", "random")
# The alphabets that a run may be written in, smallest first.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
}
LANGUAGE_RATE = 0.065
# Sum of squared shares among a to f in English text (8.17, 1.49, 2.78, 4.25, 12.70, 2.23 %); random hex has 0.0625.
HEX_RATE = 0.26
DRIFT = 0.25  # bound on the drift of runs and serial correlation that the corpus may teach
ALPHA = 0.001
FDR = 0.01
MASK = "[SECRET]"


def spans(text: Column, pattern: str, kind: str, keep: str = "true") -> Column:
    """array<struct<start, stop, kind, value>> of the pattern's matches, leftmost and apart; keep is SQL on `value`."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), F.length)
    lens = F.transform(found, F.length)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))
    placed = F.aggregate(
        F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), lens.alias("size")),
        zero,
        lambda s, x: F.struct((s["at"] + x["gap"] + x["size"]).alias("at"), F.array_append(s["out"], F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["size"]).alias("stop"))).alias("out")),
    )["out"]
    rows = F.transform(F.arrays_zip(placed.alias("at"), found.alias("value")), lambda x: F.struct(x["at"]["start"].alias("start"), x["at"]["stop"].alias("stop"), F.lit(KINDS.index(kind)).alias("kind"), x["value"].alias("value")))
    empty = F.array().cast("array<struct<start:int,stop:int,kind:int,value:string>>")
    return F.when(text.rlike(pattern), F.filter(rows, lambda x: F.expr(keep) if keep == "true" else F.length(F.regexp_extract(x["value"], pattern, 2)) >= 12)).otherwise(empty)


def listing(s: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def tail(z: Column) -> Column:
    """P(N > z) of the normal distribution, by the rational approximation 26.2.17 of Abramowitz and Stegun."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def battery(runs: DataFrame, value: str = "value") -> DataFrame:
    """Adds encoding, n, z_chi, z_runs, z_serial, p_random (corrected) and the coincidence counts of each run."""
    v = F.regexp_replace(F.col(value), "=+\\z", "")
    runs = runs.withColumn("_v", F.when(F.length(v) > 1, v).otherwise(F.col(value)))
    enc = F.lit("base64")
    for name, letters in reversed(ALPHABETS.items()):
        if name != "base64":
            enc = F.when(F.col("_v").rlike(f"^[{letters}]+\\z"), F.lit(name)).otherwise(enc)
    runs = runs.withColumn("encoding", enc).withColumn("n", F.length("_v").cast("double"))
    table = F.create_map(*[F.lit(x) for k, a in ALPHABETS.items() for x in (k, a)])
    runs = runs.withColumn("_a", F.element_at(table, F.col("encoding"))).withColumn("m", F.length("_a").cast("double"))
    squares = F.aggregate(F.split("_a", ""), F.lit(0.0), lambda s, c: s + F.when(c == "", 0.0).otherwise(F.pow((F.length("_v") - F.length(F.replace(F.col("_v"), c, F.lit("")))).cast("double"), F.lit(2.0))))
    runs = runs.withColumn("_sq", squares).withColumn("_x", F.expr("transform(filter(split(_v, ''), c -> c != ''), c -> CAST(locate(c, _a) AS DOUBLE))"))
    runs = runs.withColumn("_mean", F.aggregate("_x", F.lit(0.0), lambda s, x: s + x) / F.col("n"))
    var = F.expr("aggregate(_x, 0D, (s, x) -> s + (x - _mean) * (x - _mean))")
    cov = F.expr("aggregate(sequence(1, CAST(n AS INT) - 1), 0D, (s, i) -> s + (_x[i - 1] - _mean) * (_x[i] - _mean))")
    high = F.expr("aggregate(_x, 0D, (s, x) -> s + IF(x > m / 2, 1D, 0D))")
    turns = F.expr("aggregate(sequence(1, CAST(n AS INT) - 1), 1D, (s, i) -> s + IF((_x[i - 1] > m / 2) != (_x[i] > m / 2), 1D, 0D))")
    n, m = F.col("n"), F.col("m")
    runs = runs.withColumns({"_var": var, "_cov": cov, "_hi": high, "_turns": turns})
    low = n - F.col("_hi")
    mix = 2 * F.col("_hi") * low
    spread = mix * (mix - n) / (n * n * F.greatest(n - 1, F.lit(1.0)))
    runs = runs.withColumns({
        "z_chi": (m / n * F.col("_sq") - n - (m - 1)) / F.sqrt(2 * (m - 1) * (n - 1) / n),
        "z_runs": F.when(spread > 0, (F.col("_turns") - 1 - mix / n) / F.sqrt(spread)).otherwise(-F.sqrt(n)),
        "z_serial": F.when(F.col("_var") > 0, F.col("_cov") / F.col("_var") * F.sqrt(n)).otherwise(F.sqrt(n)),
        "pairs": n * (n - 1) / 2,
        "equal": (F.col("_sq") - n) / 2,
    })
    least = F.least(tail(F.col("z_chi")), 2 * tail(F.abs("z_runs")), 2 * tail(F.abs("z_serial")))
    return runs.withColumn("p_random", F.least(F.lit(1.0), 3 * least)).drop("_v", "_a", "_sq", "_x", "_mean", "_var", "_cov", "_hi", "_turns")


def base_scan(docs: DataFrame, kept: Column, shortest: int = SHORTEST) -> DataFrame:
    """kept, base (spans of the base kinds in order) and runs (candidates that no base span touches)."""
    t = F.col("text")
    base = F.array_sort(F.concat(spans(t, ASSIGN, "assign", "group"), spans(t, ACCESS, "access"), spans(t, HEX, "hex")))
    d = docs.select(kept.alias("kept"), F.coalesce("text", F.lit("")).alias("text")).withColumns({"base": base, "runs": spans(t, RUN % shortest, "random")}).drop("text")
    free = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["stop"]) & (r["start"] < b["stop"])))
    return d.withColumn("runs", F.when(F.size("runs") > 0, free).otherwise(F.col("runs")))


def language(tested: DataFrame) -> dict[str, tuple[float, float, float]]:
    """How language looks in each encoding: the rate of equal pairs and the drifts of runs and serial correlation, means
    of the rejected strings' shares within DRIFT. One row an encoding reaches the driver."""
    share = lambda z: F.avg(F.when(F.col("p_random") < ALPHA, F.greatest(F.lit(-DRIFT), F.least(F.lit(DRIFT), F.col(z) / F.sqrt("n"))))).alias(z)
    rows = tested.groupBy("encoding", "m").agg(F.sum("equal").alias("equal"), F.sum("pairs").alias("pairs"), share("z_runs"), share("z_serial")).collect()
    least = max([LANGUAGE_RATE, *(r["equal"] / r["pairs"] for r in rows if r["encoding"] == "lower" and r["pairs"])])
    return {r["encoding"]: (max(least, HEX_RATE) if r["m"] == 16 else least, r["z_runs"] or 0.0, r["z_serial"] or 0.0) for r in rows}


def judged(tested: DataFrame, looks: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Adds z, the battery's combined deviate from language, and p, its tail."""
    rate, runs, serial = (F.element_at(F.create_map(*[F.lit(x) for k, v in looks.items() for x in (k, v[i])]), F.col("encoding")) if looks else F.lit(0.0) for i in range(3))
    pairs, root = F.col("pairs"), F.sqrt("n")
    spread = F.sqrt(pairs * rate * (1 - rate))
    # deviates from language and their expected shifts for uniform characters; none where language is no less even
    parts = [
        ((pairs * rate - F.col("equal")) / spread, F.greatest(F.lit(0.0), pairs * (rate - 1 / F.col("m")) / spread)),
        (runs * root - F.col("z_runs"), runs * root),
        (serial * root - F.col("z_serial"), serial * root),
    ]
    top = parts[0][0] * parts[0][1] + parts[1][0] * parts[1][1] + parts[2][0] * parts[2][1]
    norm = F.sqrt(parts[0][1] * parts[0][1] + parts[1][1] * parts[1][1] + parts[2][1] * parts[2][1])
    return tested.withColumn("z", F.when(norm > 0, top / norm).otherwise(0.0)).withColumn("p", F.greatest(tail(F.col("z")), F.lit(1e-300)))


def false_discovery(tested: DataFrame, fdr: float = FDR) -> DataFrame:
    """value of each tested string that is random and significantly unlike language.

    Only sums reach the driver: one row an encoding, the mean length, and the least significant step of log p."""
    sums = tested.agg(F.count("*").alias("c"), F.avg("n").alias("n")).first()
    p = F.col("p") / (F.col("n") / F.lit(sums["n"] or 1.0))
    steps = judged(tested, language(tested)).withColumn("step", F.floor(F.least(F.lit(30000.0), F.greatest(F.lit(0.0), -100 * F.log10(p)))))
    # at most 30,001 steps: the largest p-value whose rank allows it
    ranked = steps.groupBy("step").agg(F.count("*").alias("k")).select("step", F.sum("k").over(Window.orderBy(F.col("step").desc())).alias("rank"))
    best = ranked.where(F.pow(F.lit(10.0), -F.col("step") / 100) <= fdr * F.col("rank") / F.lit(max(1, sums["c"]))).agg(F.min("step").alias("s")).first()["s"]
    found = F.lit(False) if best is None else (F.col("step") >= best) & (F.col("p_random") >= ALPHA)
    return steps.where(found).select("value")


def scanned(docs: DataFrame, kept: Column, fdr: float = FDR, shortest: int = SHORTEST) -> DataFrame:
    """kept, base and found (base and accepted runs): arrays of (start, stop, kind, value) by start, then kind.

    Texts are read once: spans are written to the shared folder with a row number that the table fixes, and
    corpus counts, decisions and the way back to the rows use that table. Each distinct string is tested once,
    and what the tests gave is written too."""
    table = stored(base_scan(docs, kept, shortest).withColumn("row", F.monotonically_increasing_id()), "spans", compression="zstd")
    runs = table.where(F.size("runs") > 0).select("row", F.explode("runs").alias("run"))
    tested = stored(battery(runs.select("run.value").distinct()).select("value", "encoding", "n", "m", "pairs", "equal", "z_runs", "z_serial", "p_random"), "tested", compression="zstd")
    accepted = false_discovery(tested, fdr)
    more = runs.withColumn("value", F.col("run.value")).join(accepted, "value").groupBy("row").agg(F.collect_list("run").alias("more"))
    plain = table.where(F.size("runs") == 0).select("kept", "base", F.col("base").alias("found"))
    rest = table.where(F.size("runs") > 0).join(more, "row", "left").select("kept", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("found"))
    return plain.unionByName(rest)


def scan(docs: DataFrame, *keep: str, fdr: float = FDR, shortest: int = SHORTEST) -> DataFrame:
    """The kept columns, then base and found as scanned() gives them; kept columns may not be called so."""
    if {"base", "found"} & {k.lower() for k in keep}:
        raise ValueError("columns named base or found cannot be kept beside the spans")
    return scanned(docs, F.struct(*map(quoted, keep)), fdr, shortest).select("kept.*", "base", "found")


def masked(text: Column, found: Column) -> Column:
    """The text with every span replaced by MASK; overlapping spans are replaced as one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s, x):
        fresh = x["start"] >= s["at"]
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), F.when(fresh, F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(MASK))).otherwise(s["out"]).alias("out"))

    done = F.aggregate(found, start, step)
    return F.when(F.size(found) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def redact(docs: DataFrame) -> DataFrame:
    """docs with the secrets in text masked; all rows and columns stay, null texts too."""
    own = lambda c: F.col("kept").getField(c)
    text = F.when(own("text").isNull(), F.lit(None)).otherwise(masked(own("text"), F.col("found")))
    return scanned(docs, F.struct(*map(quoted, docs.columns))).select(*[(text if c == "text" else own(c)).alias(c) for c in docs.columns])
