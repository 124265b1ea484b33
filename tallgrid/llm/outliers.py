"""Quality rules: texts that are outliers among those of their language and source, by the minimum covariance determinant.

Four statistics of each text (word length; symbols, repeated lines and repeated words by the word) become square roots of
ratios, each taken with a few words of prior, in whole 256ths. For each pool of texts the estimator looks for the three
quarters of its vectors whose covariance has the least determinant: concentration steps take, from the means and covariance
of one subset, the vectors nearest by Mahalanobis distance as the next. Two starts are used, the three quarters and the half of the
pool nearest to its median by quartile ranges; the one that ends with the smaller determinant stays, is made consistent at its
median distance and reweighted. A text is rejected when its squared distance is over ``CUTOFF``, the chi-square value that one
in 100,000 exceeds. ``FLOORS``, added to the covariance, keep statistics that hardly vary from rejecting harmless texts.

A step is one aggregation: rows are counted and summed by (pool, start, band of distance) in the tasks that read them, and the
bands are added up to the quantile. All sums are of whole numbers, so no order of adding changes a result.

Only DataFrame and SQL functions are used. Texts are read once; the steps read four small numbers a text.

Defined cases: a null text has no words; texts that fail the base rules (under ten words, or over a fifth of their words in
repeated five-word stretches) are not kept and teach nothing. A language and source with fewer than ``least`` texts is pooled
with others of its language, a language with fewer in such pools with others; a pool that stays below keeps all its texts. Null
languages and sources are values of their own. Repeated rows count and come back each; an empty table gives an empty result.
Repeated stretches are found by 64-bit hashes inside one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrid.llm.shared import keep, prepare

BLANKS, SYMBOLS, STRETCH, LEAST = "\t\n\x0b\x0c\r ", "#*$%&|<>", 5, 100
STEPS, BANDS, FARTHEST, SALT = 8, 32, 4096, 64
CUTOFF, MEDIAN, NEAR = 28.473, 3.357, 11.143  # of chi-square with four degrees of freedom: at 0.99999, 0.5 and 0.975
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VECTOR = {  # in 256ths: the square root of a ratio with 20 words of prior, words of five letters and without the rest
    "u1": "CAST(floor(256 * sqrt((word_chars + 100) / CAST(n_words + 20 AS DOUBLE)) + 0.5) AS BIGINT)",
    "u2": "CAST(floor(256 * sqrt(n_symbols / CAST(n_words + 20 AS DOUBLE)) + 0.5) AS BIGINT)",
    "u3": "CAST(floor(256 * sqrt(n_dup_lines / CAST(n_words + 20 AS DOUBLE)) + 0.5) AS BIGINT)",
    "u4": "CAST(floor(256 * sqrt(n_repeat_words / CAST(n_words + 20 AS DOUBLE)) + 0.5) AS BIGINT)"}
FLOORS = {"u1": 25.6, "u2": 25.6, "u3": 25.6, "u4": 25.6}
NAMES = tuple(VECTOR)
PAIRS = tuple((a, b) for i, a in enumerate(NAMES) for b in NAMES[:i + 1])
SUMS = {"n": "count(*)", **{f"s_{a}": f"CAST(sum({a}) AS BIGINT)" for a in NAMES},
        **{f"s_{a}_{b}": f"CAST(sum({a} * {b}) AS BIGINT)" for a, b in PAIRS}}
ESTIMATE = tuple(f"m_{a}" for a in NAMES) + tuple(f"l_{a}_{b}" for a, b in PAIRS)


def cholesky() -> dict[str, str]:
    """The triangular root of the covariance ``c_a_b``, as SQL expressions that build on each other."""
    out = {}
    for i, a in enumerate(NAMES):
        for b in NAMES[:i + 1]:
            rest = f"c_{a}_{b}" + "".join(f" - l_{a}_{k} * l_{b}_{k}" for k in NAMES[:NAMES.index(b)])
            out[f"l_{a}_{b}"] = f"sqrt({rest})" if a == b else f"({rest}) / l_{b}_{b}"
    return out


def estimate() -> dict[str, str]:
    """Means and triangular root from the sums of a subset."""
    means = {f"m_{a}": f"s_{a} / CAST(n AS DOUBLE)" for a in NAMES}
    moments = {f"c_{a}_{b}": f"(CAST(s_{a}_{b} AS DOUBLE) - CAST(s_{a} AS DOUBLE) * CAST(s_{b} AS DOUBLE) / n) / n"
               + (f" + {FLOORS[a]} * {FLOORS[a]}" if a == b else "") for a, b in PAIRS}
    return {**means, **moments, **cholesky()}


def start() -> dict[str, str]:
    """Median and quartile ranges (``q_a``) as a first estimate with no correlation."""
    means = {f"m_{a}": f"q_{a}[{{middle}}]" for a in NAMES}
    spread = {f"l_{a}_{b}": f"sqrt(pow2({a}) + {FLOORS[a]} * {FLOORS[a]})" if a == b else "CAST(0 AS DOUBLE)" for a, b in PAIRS}
    for a in NAMES:
        width = f"((q_{a}[{{last}}] - q_{a}[{{first}}]) * 0.7413)"
        spread[f"l_{a}_{a}"] = spread[f"l_{a}_{a}"].replace(f"pow2({a})", f"{width} * {width}")
    return {**means, **spread}


def distance() -> dict[str, str]:
    """The squared Mahalanobis distance ``d2`` by forward substitution."""
    out = {}
    for i, a in enumerate(NAMES):
        out[f"z_{a}"] = f"({a} - m_{a}" + "".join(f" - l_{a}_{k} * z_{k}" for k in NAMES[:i]) + f") / l_{a}_{a}"
    return {**out, "d2": " + ".join(f"z_{a} * z_{a}" for a in NAMES)}


BAND = f"CAST(least(floor({BANDS} * sqrt(d2)), {FARTHEST}) AS INTEGER)"
#: which bands belong to the next subset: those that begin before the quantile, or before the bound of the reweighted estimate
CONCENTRATED = "before * 4 < total * CASE WHEN start = 2 AND first THEN 2 ELSE 3 END"
SPREAD = f"greatest(1, (middle + 0.5) / {BANDS} * ((middle + 0.5) / {BANDS}) / {MEDIAN})"
REWEIGHTED = f"band / CAST({BANDS} AS DOUBLE) * (band / CAST({BANDS} AS DOUBLE)) / {SPREAD} <= {NEAR}"


def listed(expressions: dict[str, str]) -> list[str]:
    return [f"{text} AS {name}" for name, text in expressions.items()]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeated(words: Column) -> Column:
    """How many words stand in stretches that the text has twice or more."""
    size = F.size(words)
    hashed = F.transform(F.slice(words, 1, F.greatest(size - (STRETCH - 1), F.lit(0))),
                         lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, STRETCH)]))

    def counted(hashes):
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda rows: F.array_sort(F.array_compact(F.transform(rows, lambda x, j: F.when(
            (x["h"] == F.get(rows, j - 1)["h"]) | (x["h"] == F.get(rows, j + 1)["h"]), x["i"]))))
        covered = lambda at: F.aggregate(F.transform(at, lambda p, j: F.least(
            F.coalesce(F.get(at, j + 1) - p, F.lit(STRETCH)), F.lit(STRETCH))), F.lit(0).cast("long"), lambda x, y: x + y)
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(_let(ordered, twice), covered)).otherwise(0)

    return _let(hashed, counted)


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
               source_column: str = "source") -> DataFrame:
    """``_id``, ``_lang``, ``_source``, the counts of each text and ``base_failed``."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    without = lambda column, letters: F.length(F.translate(column, letters, ""))
    lines = F.filter(F.split("_text", "\n"), lambda line: without(line, BLANKS) > 0)

    def counts(words):
        return F.struct(F.size(words).cast("long").alias("n_words"), _repeated(words).alias("n_repeat_words"))

    rows = docs.select(F.col(id_column).alias("_id"), F.col(lang_column).cast("string").alias("_lang"),
                       F.col(source_column).cast("string").alias("_source"), text.alias("_text"))
    rows = rows.select(
        "_id", "_lang", "_source", without(F.col("_text"), BLANKS).cast("long").alias("word_chars"),
        (F.length("_text") - without(F.col("_text"), SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda own: F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines"),
        _let(F.filter(F.split("_text", r"[\x09-\x0D\x20]+"), lambda w: w != ""), counts).alias("_words"))
    return rows.select("_id", "_lang", "_source", "_words.n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "_words.n_repeat_words").withColumn(
        "base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))


def pools(rows: DataFrame, least: int) -> DataFrame:
    """``_lang``, ``_source`` and ``pool``: what each combination is judged among."""
    counts = rows.groupBy("_lang", "_source").agg(F.count("*").alias("n"))
    small = counts.where(F.col("n") < least).groupBy("_lang").agg(F.sum("n").alias("others")).withColumnRenamed("_lang", "_own")
    name = lambda *parts: F.concat_ws("/", *[F.coalesce(F.concat(F.length(p), F.lit(":"), p), F.lit("-")) for p in parts])
    pool = F.when(F.col("n") >= least, name(F.col("_lang"), F.col("_source"))).when(
        F.col("others") >= least, name(F.col("_lang"))).otherwise("")
    return counts.join(small, F.col("_lang").eqNullSafe(F.col("_own")), "left").select(
        F.col("_lang").alias("_in_lang"), F.col("_source").alias("_in_source"), pool.alias("pool"))


def salted(rows: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the estimates of their pool. A pool may hold most rows, so its estimate goes to ``SALT`` shares of it."""
    shares = estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.join(shares, ["pool", "salt"], how).drop("salt")


def _summed(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Sums of the rows of each (pool, start, band), with the rows in nearer bands, all rows and the median band of the pool."""
    near = salted(rows, estimates).selectExpr("pool", "start", *NAMES, *listed(distance())).selectExpr(
        "pool", "start", *NAMES, f"{BAND} AS band")
    bands = near.groupBy("pool", "start", "band").agg(*[F.expr(text).alias(name) for name, text in SUMS.items()])
    own = "PARTITION BY pool, start"
    return bands.selectExpr("*", f"sum(n) OVER ({own} ORDER BY band) - n AS before", f"sum(n) OVER ({own}) AS total").selectExpr(
        "*", f"max(CASE WHEN before * 2 < total THEN band END) OVER ({own}) AS middle")


def _estimated(bands: DataFrame, condition: str) -> DataFrame:
    chosen = bands.where(condition).groupBy("pool", "start").agg(*[F.expr(f"sum({name})").alias(name) for name in SUMS])
    return chosen.selectExpr("pool", "start", *listed(estimate())).select("pool", "start", *ESTIMATE)


def estimates(rows: DataFrame, least: int = LEAST, steps: int = STEPS) -> DataFrame:
    """``pool``, means and triangular root of the covariance of each pool of at least ``least`` vectors."""
    quartiles = [F.expr(f"percentile({a}, array(0.25, 0.5, 0.75))").alias(f"q_{a}") for a in NAMES]
    first = [text.format(first=0, middle=1, last=2) for text in listed(start())]
    at = rows.groupBy("pool").agg(F.count("*").alias("n"), *quartiles).where(F.col("n") >= least).selectExpr(
        "pool", "explode(array(1, 2)) AS start", *first)
    for step in range(steps):
        at = keep(_estimated(_summed(rows, keep(at) if step == 0 else at).withColumn("first", F.lit(step == 0)), CONCENTRATED))
    size = F.expr(" * ".join(f"l_{a}_{a}" for a in NAMES))
    best = at.groupBy("pool").agg(F.min(F.struct(size.alias("size"), "start", *ESTIMATE)).alias("best")).select(
        "pool", "best.start", *[f"best.{c}" for c in ESTIMATE])
    return keep(_estimated(_summed(rows, best), REWEIGHTED)).drop("start")


def assess(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
           source_column: str = "source", least: int = LEAST, cutoff: float = CUTOFF) -> DataFrame:
    """One row for each input row: ``_id``, the counts, ``base_failed``, ``distance`` (squared; null if not measured), ``kept``."""
    prepare(docs.sparkSession)
    rows = keep(statistics(docs, id_column, text_column, lang_column, source_column))
    passed = rows.where("NOT base_failed")
    named = pools(passed, least)
    same = F.col("_lang").eqNullSafe(F.col("_in_lang")) & F.col("_source").eqNullSafe(F.col("_in_source"))
    salt = (F.monotonically_increasing_id() % SALT).cast("int").alias("salt")
    vectors = keep(passed.join(named, same).selectExpr("pool", "_id", *COUNTS, *listed(VECTOR)).select("*", salt))
    found = salted(vectors, estimates(vectors.select("pool", "salt", *NAMES), least), "left").selectExpr(
        "_id", *COUNTS, *listed(distance()))
    judged = found.select("_id", *COUNTS, F.lit(False).alias("base_failed"), F.col("d2").alias("distance"),
                          F.coalesce(F.col("d2") <= cutoff, F.lit(True)).alias("kept"))
    failed = rows.where("base_failed").select("_id", *COUNTS, "base_failed", F.lit(None).cast("double").alias("distance"),
                                              F.lit(False).alias("kept"))
    return judged.unionByName(failed)
