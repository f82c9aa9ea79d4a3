"""Operator 11: ranked lexical search with hashed max-sketches.

A document's score for an item is the sum, over the item's terms, of weight
times impact (the formula of :func:`weight` and :func:`impact`). Steps:

1. One pass counts the documents, all terms, and the document frequencies of
   the items' terms. A bitmap of ``FILTER_BITS`` bits, whatever the number of
   items, tells the tasks which terms may be asked for.
2. A second pass folds each document's impacts into a sketch: coordinate
   ``hash(term) mod width`` holds the greatest impact of its terms, rounded up
   to one of 255 levels. The width is a power of two of at least ``SLOTS``
   times the document's distinct terms.
3. Items are asked in batches of at most ``ITEMS`` items and ``TERMS`` distinct
   terms (or one longer item). An item's weights fold into a vector over the
   coordinates, so a batch's upper bounds for a block of documents are one
   matrix product.
4. A histogram of each item's bounds is counted. Documents are scored exactly,
   from the whole texts, in descending order of their bounds: first the
   ``SLICE`` highest of each item, then slices that grow ``GROWTH``-fold. The
   k-th best score so far is the threshold, and the search ends when no bound
   left reaches it.

Equal texts have equal scores: they are scored once, and the ``k`` least
doc_ids of a text stand for all its rows. Texts are told apart by two 64-bit
hashes.

Edge cases: null and empty texts, and texts without terms, are no documents;
an item without terms has no rows; each row of the items is an item of its
own, equal ones included; repeated rows are documents of their own; a null
``doc_id`` comes after all others; equal scores stand in order of doc_id; very
long texts have wider sketches; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import alnum_words_py, materialize, mix64, needed, parts, ship_package, table

K, SLOTS, LEAST_WIDTH = 20, 8, 32
ITEMS, TERMS, SLICE, GROWTH, STEPS, BINS = 256, 8192, 256, 8, 32, 32 * 53
FILTER_BITS, PART_CHARS, CELLS, BROADCAST_PAIRS = 1 << 22, 4_000_000, 1_000_000, 400_000
#: Impacts are at most 10 ** 6; level 0 is no term, level i stands for impacts up to the i-th value.
LEVELS = np.concatenate([[0], np.ceil(10.0 ** 6 * 1.03 ** -np.arange(254, -1, -1))])


def length_factor(n: int, documents: int, terms: int) -> int:
    return 75 + 25 * n * documents // terms


def impact(tf, factor):
    """Of a term that occurs ``tf`` times, in integers (numbers or arrays)."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * factor)


def _keyed(docs: DataFrame) -> DataFrame:
    return needed(docs, "doc_id", "text").select(
        "doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")


def item_terms(items: DataFrame) -> DataFrame:
    """(qid, item_id, term, tf), written once: qid numbers the rows of ``items``."""
    def run(batches):
        for b in batches:
            counted = [Counter(alnum_words_py(t.as_py())) for t in b.column("text")]
            own = pa.array(np.repeat(np.arange(len(counted)), [len(c) for c in counted]))
            yield pa.RecordBatch.from_arrays(
                [b.column("qid").take(own), b.column("item_id").take(own), pa.array([t for c in counted for t in c], pa.binary()),
                 pa.array([n for c in counted for n in c.values()], pa.int64())], names=["qid", "item_id", "term", "tf"])

    rows = needed(items, "item_id", "text").withColumn("qid", F.monotonically_increasing_id())
    kind = items.schema["item_id"].dataType.simpleString()
    return materialize(rows.mapInArrow(run, f"qid long, item_id {kind}, term binary, tf long"), "lexical-items")


def statistics(docs: DataFrame, asked: DataFrame) -> tuple[int, int, DataFrame]:
    """Documents, terms with repeats, and (term, df) of the asked terms, over all documents."""
    place = F.crc32("term") % FILTER_BITS
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    # at most FILTER_BITS / 64 rows
    for r in asked.groupBy(F.shiftright(place, 6).alias("at")).agg(
            F.bit_or(F.expr(f"shiftleft(1L, int(crc32(term) % {FILTER_BITS} % 64))")).alias("word")).toLocalIterator():
        bits[r.at] = r.word & 0xFFFF_FFFF_FFFF_FFFF
    packed, mask = bits.tobytes(), FILTER_BITS - 1

    def run(batches):
        documents, terms, seen = 0, 0, Counter()

        def flush():
            rows = [(None, documents, terms), *[(t, n, 0) for t, n in seen.items()]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)],
                                              names=["term", "df", "n"])

        for b in batches:
            for t in b.column("text"):
                words = alnum_words_py(t.as_py())
                documents, terms = documents + bool(words), terms + len(words)
                # little-endian words: bit i of the bitmap is bit i % 8 of byte i // 8
                seen.update([w for w in set(words) if packed[(p := crc32(w) & mask) >> 3] >> (p & 7) & 1])
            if len(seen) > 500_000:
                yield flush()
                documents, terms = 0, 0
                seen.clear()
        yield flush()

    counts = needed(docs, "text").mapInArrow(run, "term binary, df long, n long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    counts = materialize(counts, "lexical-counts")
    total = counts.where(F.col("term").isNull()).first()
    return (total.df, total.n, counts.where(F.col("term").isNotNull()).select("term", "df")) if total else (0, 0, counts)


def sketches(docs: DataFrame, documents: int, terms: int) -> DataFrame:
    """(doc_id, h1, h2, sketch) of every document, written once."""
    ship_package(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for begin, end in parts(texts, PART_CHARS):
                yield fold(b.slice(begin, end - begin), texts[begin:end])

    def fold(b, texts):
        counted = [Counter(alnum_words_py(t)) for t in texts]
        kept = [i for i, c in enumerate(counted) if c]
        counted = [counted[i] for i in kept]
        size = np.array([len(c) for c in counted], np.int64)
        factor = np.array([length_factor(sum(c.values()), documents, terms) for c in counted], np.int64)
        tf = np.fromiter((n for c in counted for n in c.values()), np.int64, size.sum())
        code = np.fromiter((crc32(t) for c in counted for t in c), np.int64, size.sum())
        width = np.array([max(LEAST_WIDTH, 1 << (SLOTS * len(c) - 1).bit_length()) for c in counted], np.int64)
        level = np.searchsorted(LEVELS, impact(tf, np.repeat(factor, size))).astype(np.uint8)
        begin = np.concatenate([[0], np.cumsum(width)])
        at = np.repeat(begin[:-1], size) + (mix64(code.astype(np.uint64)).astype(np.int64) & np.repeat(width - 1, size))
        flat = np.zeros(begin[-1], np.uint8)
        np.maximum.at(flat, at, level)
        data = flat.tobytes()
        own = pa.array(kept, pa.int64())
        return pa.RecordBatch.from_arrays(
            [b.column(c).take(own) for c in ("doc_id", "h1", "h2")]
            + [pa.array([data[i:j] for i, j in zip(begin[:-1], begin[1:], strict=True)], pa.binary())], names=["doc_id", "h1", "h2", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialize(_keyed(docs).mapInArrow(run, f"doc_id {kind}, h1 long, h2 long, sketch binary"), "lexical-sketches")


class Batch:
    """A bounded number of items with their terms' weights, sent to the tasks."""

    def __init__(self, items: list[tuple[int, list[tuple[bytes, int]]]]):
        self.qids = np.array([q for q, _ in items], np.int64)
        terms = {t: i for i, t in enumerate({t for _, found in items for t, _ in found})}
        self.hashes = mix64(np.array([crc32(t) for t in terms], np.uint64)).astype(np.int64)
        self.term = np.array([terms[t] for _, found in items for t, _ in found], np.int64)
        self.item = np.array([i for i, (_, found) in enumerate(items) for _ in found], np.int64)
        self.weight = np.array([w for _, found in items for _, w in found], np.float64)
        self.weights = {q: dict(found) for q, found in items}
        self._by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def folded(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates that the items' terms fall on, and each item's weights there."""
        if width not in self._by_width:
            at, row = np.unique(self.hashes & (width - 1), return_inverse=True)
            weights = np.zeros((len(at), len(self.qids)))
            np.add.at(weights, (row[self.term], self.item), self.weight)
            self._by_width[width] = at, weights
        return self._by_width[width]

    def bounds(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (h1, h2, bounds[text, item]), a text once a block; sums are exact, whole numbers below 2 ** 53."""
        for b in batches:
            h1, h2 = b.column("h1").to_numpy(), b.column("h2").to_numpy()
            first = pd.DataFrame({"a": h1, "b": h2}).drop_duplicates().index.to_numpy()
            rows = b.column("sketch").take(pa.array(first)).to_pylist()
            widths = np.array([len(s) for s in rows], np.int64)
            for width in np.unique(widths):
                at, weights = self.folded(int(width))
                same = np.flatnonzero(widths == width)
                step = max(1, CELLS // max(len(at), len(self.qids), int(width) // 8))
                for i in range(0, len(same), step):
                    own = same[i:i + step]
                    grid = np.frombuffer(b"".join([rows[j] for j in own]), np.uint8).reshape(-1, width)
                    yield h1[first[own]], h2[first[own]], LEVELS[grid[:, at]] @ weights


def bins_of(bounds: np.ndarray) -> np.ndarray:
    """STEPS bins to a power of two; 0 for no bound at all."""
    return np.floor(STEPS * np.log2(np.maximum(bounds, 1))).astype(np.int64)


def histogram(index: DataFrame, batch: Batch) -> np.ndarray:
    """Documents by item and bin of their bound: ITEMS * BINS numbers at most (or one item's BINS)."""
    def run(batches):
        n = len(batch.qids)
        seen = np.zeros(n * BINS, np.int64)
        for _, _, u in batch.bounds(batches):
            seen += np.bincount((bins_of(u) + np.arange(n) * BINS).ravel(), minlength=n * BINS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["at", "n"])

    rows = index.select("h1", "h2", "sketch").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(len(batch.qids) * BINS, np.int64)
    seen[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return seen.reshape(-1, BINS)


def within(index: DataFrame, batch: Batch, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> DataFrame:
    """(qid, h1, h2): texts whose bound is ``least`` at least and whose bin is from ``low`` to below ``high``, by item."""
    def run(batches):
        for a, b, u in batch.bounds(batches):
            found = bins_of(u)
            row, q = np.nonzero((u >= least) & (found >= low) & (found < high))
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(batch.qids[q]), pa.array(a[row]), pa.array(b[row])], names=["qid", "h1", "h2"])

    return index.select("h1", "h2", "sketch").mapInArrow(run, "qid long, h1 long, h2 long").distinct()


def _small(rows: DataFrame, size: Column | int = 1) -> DataFrame:
    """``rows`` (a written table) with a broadcast hint, if counting shows that they are few."""
    total = rows.agg(F.sum(F.lit(size) if isinstance(size, int) else size)).first()[0] or 0
    return F.broadcast(rows) if total <= BROADCAST_PAIRS else rows


def rescored(docs: DataFrame, pairs: DataFrame, batch: Batch, documents: int, terms: int) -> DataFrame:
    """(qid, h1, h2, score): exact scores of the pairs (qid, h1, h2) from the whole texts."""
    def run(batches):
        for b in batches:
            out, seen = [], set()
            for h1, h2, text, qids in zip(*[b.column(c).to_pylist() for c in ("h1", "h2", "text", "qids")], strict=True):
                if (h1, h2) in seen:
                    continue
                seen.add((h1, h2))
                words = alnum_words_py(text)
                counted, factor = Counter(words), length_factor(len(words), documents, terms)
                for q in qids:
                    score = sum(w * impact(counted[t], factor) for t, w in batch.weights[q].items() if t in counted)
                    if score > 0:
                        out.append((q, h1, h2, score))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["qid", "h1", "h2", "score"])

    # a text is asked for by each of the batch's items once at most
    asked = materialize(pairs.groupBy("h1", "h2").agg(F.collect_set("qid").alias("qids")), "lexical-asked")
    found = _keyed(docs).select("h1", "h2", "text").join(_small(asked, F.size("qids")), ["h1", "h2"])
    return materialize(found.mapInArrow(run, "qid long, h1 long, h2 long, score long").distinct(), "lexical-scores")


def thresholds(scores: DataFrame, batch: Batch, k: int) -> np.ndarray:
    """The k-th best score of each item's texts so far; 1 where there are fewer."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"))
    rows = scores.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    found = {r.qid: r.least for r in rows.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).collect()}
    return np.array([found.get(q, 1) for q in batch.qids.tolist()], np.int64)


def best_documents(docs: DataFrame, index: DataFrame, batch: Batch, documents: int, terms: int, k: int) -> DataFrame:
    """(qid, rank, doc_id, score) of one batch of items."""
    n = len(batch.qids)
    seen = histogram(index, batch)
    at_least = np.cumsum(seen[:, ::-1], axis=1)[:, ::-1]  # documents in a bin or a higher one
    least, high, size, scores = np.ones(n, np.int64), np.full(n, BINS), SLICE, None
    while scores is None or (high > bins_of(least)).any():
        # from the highest bin that has ``size`` documents with all above it, or as far down as the threshold allows
        low = np.minimum(np.maximum((at_least >= size).sum(axis=1) - 1, bins_of(least)), high)
        if scores is None or any(seen[i, low[i]:high[i]].any() for i in range(n)):
            found = rescored(docs, within(index, batch, low, high, least), batch, documents, terms)
            scores = found if scores is None else scores.unionByName(found)
            least = thresholds(scores, batch, k)
        high, size = low, size * GROWTH
    w = Window.partitionBy("qid").orderBy(F.desc("score"))
    texts = materialize(scores.withColumn("place", F.rank().over(w)).where(F.col("place") <= k).drop("place"), "lexical-texts")
    order = F.col("doc_id").asc_nulls_last()
    rows = index.select("doc_id", "h1", "h2").join(_small(materialize(texts.select("h1", "h2").distinct(), "lexical-winners")), ["h1", "h2"])
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(order))).where(F.col("place") <= k).drop("place")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), order))
    return materialize(rows.join(texts, ["h1", "h2"]).withColumn("rank", rank).where(F.col("rank") <= k)
                       .select("qid", "rank", "doc_id", "score"), "lexical-ranked")


def batches_of(items: DataFrame) -> Iterator[Batch]:
    """Batches from rows (qid, terms), read one partition after another."""
    held, terms = [], set()
    for r in items.toLocalIterator():
        own = [(bytes(t.term), t.weight) for t in r.terms]
        if held and (len(held) == ITEMS or len(terms.union(t for t, _ in own)) > TERMS):
            yield Batch(held)
            held, terms = [], set()
        held.append((r.qid, own))
        terms.update(t for t, _ in own)
    if held:
        yield Batch(held)


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id, rank, doc_id, score``."""
    spark = docs.sparkSession
    ship_package(spark)
    asked = item_terms(items)
    documents, terms, df = statistics(docs, asked)
    weight = F.floor(1000 * F.log((2 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = materialize(asked.join(df, "term").select("qid", "term", (weight * F.col("tf")).alias("weight")).where(F.col("weight") > 0)
                          .groupBy("qid").agg(F.collect_list(F.struct("term", "weight")).alias("terms")), "lexical-weights")
    index = sketches(docs, documents, terms)
    found = [best_documents(docs, index, batch, documents, terms, k) for batch in batches_of(weighed)]
    names = asked.select("qid", "item_id").distinct()
    if not found:
        kind = docs.schema["doc_id"].dataType
        return names.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(kind).alias("doc_id"), F.lit(0).cast("long").alias("score")).where(F.lit(False))
    return reduce(DataFrame.unionByName, found).join(names, "qid").select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH words AS (
    SELECT row_number() OVER () AS row, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM words WHERE len(w) > 0),
asked AS (
    SELECT q, item_id, term, count(*) AS repeats
    FROM (SELECT row_number() OVER () AS q, item_id,
                 unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
          FROM benchmark)
    GROUP BY ALL),
found AS (
    SELECT row, doc_id, n, term, count(*) AS tf
    FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM words)
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
    FROM found, totals GROUP BY term),
scored AS (
    SELECT q, item_id, row, doc_id,
           CAST(sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN found USING (term), totals
    GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""
