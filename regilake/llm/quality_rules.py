"""Operator 1: quality rules with adaptive thresholds from mergeable quantile sketches.

Each document gets counts (words, symbols, repeated lines, repeated 3-word
windows, ASCII punctuation) and, from them, integer metrics. Per language
and source a sketch of each metric is kept as rows ``(group, bin, count)``:
bins have 32 steps to a power of two, so a quantile is off by 1/32 at most,
a sketch has a few hundred rows whatever it has seen, and sketches merge by
adding counts. Thresholds are the quartiles widened by ``FENCE`` times
their distance (at least the metric's ``spread``); they replace fixed
cut-offs. A group of fewer than ``LEAST`` documents takes the merged sketch
of its language, a language of fewer that of all documents. A join brings
the thresholds to the documents.

Only documents that pass the base rules (50 words, at most half of them in
repeated windows) are sketched and judged by the thresholds.

Edge cases: null and empty texts have no words and fail; null languages and
sources are groups of their own; equal rows are judged alike and all kept
or all dropped; an empty table gives no rows; columns of other names are
ignored, and :func:`filter_documents` returns exactly the given columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, needed, ship_package, space_words, table

FENCE, LEAST, STEPS = 3, 200, 6
#: metric -> (least distance of the quartiles, judged below, judged above)
METRICS = {
    "symbol_rate": (50, False, True),       # per 1000 words
    "duplicate_lines": (100, False, True),  # per 1000 lines, of 10 at least
    "repeated_words": (100, False, True),   # per 1000 words
    "word_length": (100, True, True),       # in hundredths
    "mark_rate": (100, False, True),        # per 1000 words
}
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_marks")


def repeated_words(words: list[bytes]) -> int:
    """Words within 3-word windows that occur twice or more in the list."""
    n = len(words)
    if n < 4:
        return 0
    number = {w: i for i, w in enumerate(set(words))}
    ids, v = np.fromiter(map(number.__getitem__, words), np.int64, n), len(number)
    pairs = ids[:-1] * v + ids[1:]
    if v > 1 << 20:
        pairs, v = np.unique(pairs, return_inverse=True)[1].astype(np.int64), len(number)
    order = np.sort(keys := pairs[:-1] * v + ids[2:])
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    again = np.isin(keys, twice)
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k:n - 2 + k] |= again
    return int(hit.sum())


def measure(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(MEASURES)
    raw, words = text.encode("utf-8", "surrogatepass"), space_words(text)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines),
            len(lines) - len(set(lines)), repeated_words(words), len(raw) - len(raw.translate(None, MARKS)))


def measures(docs: DataFrame, *carry: str) -> DataFrame:
    """One row per document: the ``carry`` columns, then MEASURES."""
    ship_package(docs.sparkSession)
    rows = needed(docs, *carry, "text")
    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"] + [T.StructField(m, T.LongType()) for m in MEASURES])

    def run(batches):
        for b in batches:
            found = [measure(t.as_py()) for t in b.column("text")]
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in carry] + columns, names=[*carry, *MEASURES])

    return rows.mapInArrow(run, schema)


def _rate(a: str, b: str, times: int, least: int = 1) -> Column:
    return F.floor(F.lit(times) * F.col(a) / F.greatest(F.col(b), F.lit(least))).cast("long")


def with_metrics(rows: DataFrame) -> DataFrame:
    """Base verdict and metrics beside the measures."""
    return rows.select(
        "*", ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        _rate("n_symbols", "n_words", 1000).alias("symbol_rate"),
        _rate("n_dup_lines", "n_lines", 1000, 10).alias("duplicate_lines"),
        _rate("n_repeat_words", "n_words", 1000).alias("repeated_words"),
        _rate("word_chars", "n_words", 100).alias("word_length"),
        _rate("n_marks", "n_words", 1000).alias("mark_rate"))


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, bin, n): counts by bin. Two sketches merge by adding ``n``."""
    long = rows.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])))
    shift = f"greatest(length(bin(v)) - {STEPS}, 0)"
    return long.groupBy(*keys, "metric", F.expr(f"shiftleft(shiftright(v, {shift}), {shift})").alias("bin")) \
               .agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seen, low_<metric>, high_<metric>) from the sketches' quartiles."""
    w = Window.partitionBy(*keys, "metric")
    rows = sketch.select("*", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("seen"))
    quart = rows.groupBy(*keys, "metric").agg(
        F.max("seen").alias("seen"),
        F.min(F.when(4 * F.col("upto") >= F.col("seen"), F.col("bin"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("seen"), F.col("bin"))).alias("q3"))
    wide = []
    for m, (spread, below, above) in METRICS.items():
        reach = FENCE * F.greatest(F.col("q3") - F.col("q1"), F.lit(spread))
        here = F.col("metric") == m
        wide += [F.max(F.when(here, F.col("q1") - reach if below else F.lit(-1))).alias(f"low_{m}"),
                 F.max(F.when(here, F.col("q3") + reach if above else F.lit(2 ** 62))).alias(f"high_{m}")]
    return quart.groupBy(*keys).agg(F.max("seen").alias("seen"), *wide)


def thresholds(rows: DataFrame) -> DataFrame:
    """Fences of every (lang, source), from the smallest group around it that has LEAST documents."""
    names = [f"{side}_{m}" for m in METRICS for side in ("low", "high")]
    fine = materialize(sketches(rows, ["lang", "source"]), "quality-sketches")
    by_lang = fine.groupBy("lang", "metric", "bin").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("metric", "bin").agg(F.sum("n").alias("n"))
    a = fences(fine, ["lang", "source"])
    b = fences(by_lang, ["lang"]).select(F.col("lang").alias("of"), F.col("seen").alias("seen_b"),
                                         *[F.col(c).alias(f"{c}_b") for c in names])
    c = fences(overall.withColumn("all", F.lit(0)), ["all"]).select(*[F.col(c).alias(f"{c}_c") for c in names])
    return a.join(b, a["lang"].eqNullSafe(b["of"])).join(c, F.lit(True)).select(  # c is one row
        F.col("lang").alias("t_lang"), F.col("source").alias("t_source"),
        *[F.when(F.col("seen") >= LEAST, F.col(x)).when(F.col("seen_b") >= LEAST, F.col(f"{x}_b"))
           .otherwise(F.col(f"{x}_c")).alias(x) for x in names])


def judge(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` (with metrics) and ``kept``."""
    within = F.lit(True)
    for m in METRICS:
        within = within & (F.col(m) >= F.col(f"low_{m}")) & (F.col(m) <= F.col(f"high_{m}"))
    judged = rows.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False)))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_metrics(materialize(measures(table(spark, sf_dir, "documents"), "doc_id", "lang", "source"), "quality-measures"))
    return judge(rows, thresholds(rows.where(~F.col("base_failed")))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with exactly its columns.

    The documents are measured twice, for the thresholds and for the
    verdicts, so that no text is written in between.
    """
    sketched = with_metrics(measures(docs, "lang", "source"))
    limits = materialize(thresholds(sketched.where(~F.col("base_failed"))), "quality-limits")
    rows = docs.select(F.struct("*").alias("row"), docs["text"], docs["lang"], docs["source"])
    return judge(with_metrics(measures(rows, "row", "lang", "source")), limits).where("kept").select("row.*")


ORACLE = r"""
WITH words AS (
    SELECT doc_id, lang, source, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM documents),
numbered AS (SELECT row_number() OVER () AS id, * FROM words),
placed AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM numbered),
windows AS (SELECT id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS tri FROM placed WINDOW o AS (PARTITION BY id ORDER BY i)),
counted AS (SELECT id, i, count(*) OVER (PARTITION BY id, tri) AS c FROM windows WHERE tri IS NOT NULL),
repeats AS (SELECT id, count(DISTINCT i + k) AS n FROM counted, (VALUES (0), (1), (2)) t(k) WHERE c >= 2 GROUP BY id),
measured AS (
    SELECT n.id, doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
           coalesce(r.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^!-/:-@\[-`{-~]', '', 'g')) AS n_marks
    FROM numbered n LEFT JOIN repeats r USING (id)),
metrics AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           [1000 * n_symbols // greatest(n_words, 1), 1000 * n_dup_lines // greatest(n_lines, 10), 1000 * n_repeat_words // greatest(n_words, 1),
            100 * word_chars // greatest(n_words, 1), 1000 * n_marks // greatest(n_words, 1)] AS vs
    FROM measured),
long AS (SELECT lang, source, unnest(vs) AS v, generate_subscripts(vs, 1) AS metric FROM metrics WHERE NOT base_failed),
binned AS (SELECT lang, source, metric, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bin FROM long),
levels AS (
    SELECT 1 AS level, lang, source, metric, bin FROM binned
    UNION ALL SELECT 2, lang, NULL, metric, bin FROM binned
    UNION ALL SELECT 3, NULL, NULL, metric, bin FROM binned),
ranked AS (SELECT *, row_number() OVER (PARTITION BY level, lang, source, metric ORDER BY bin) AS r,
                  count(*) OVER (PARTITION BY level, lang, source, metric) AS seen FROM levels),
quartiles AS (SELECT level, lang, source, metric, any_value(seen) AS seen, min(bin) FILTER (WHERE 4 * r >= seen) AS q1,
                     min(bin) FILTER (WHERE 4 * r >= 3 * seen) AS q3 FROM ranked GROUP BY ALL),
limits AS (SELECT level, lang, source, metric, seen,
                  CASE WHEN metric = 4 THEN q1 - 3 * greatest(q3 - q1, 100) ELSE -1 END AS low,
                  q3 + 3 * greatest(q3 - q1, CASE WHEN metric = 1 THEN 50 ELSE 100 END) AS high FROM quartiles),
judged AS (
    SELECT m.id, bool_and(v BETWEEN t.low AND t.high) AS fits
    FROM (SELECT id, lang, source, unnest(vs) AS v, generate_subscripts(vs, 1) AS metric FROM metrics WHERE NOT base_failed) m
    JOIN limits f ON f.level = 1 AND f.metric = m.metric AND f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source
    JOIN limits b ON b.level = 2 AND b.metric = m.metric AND b.lang IS NOT DISTINCT FROM m.lang
    JOIN limits t ON t.metric = m.metric AND t.level = CASE WHEN f.seen >= 200 THEN 1 WHEN b.seen >= 200 THEN 2 ELSE 3 END
         AND (t.level = 3 OR t.lang IS NOT DISTINCT FROM m.lang) AND (t.level > 1 OR t.source IS NOT DISTINCT FROM m.source)
    GROUP BY m.id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(fits, false) AS kept
FROM metrics LEFT JOIN judged USING (id)
"""
