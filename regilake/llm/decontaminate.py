"""Operator 9: benchmark decontamination by a distributed positional inverted index.

Test items are cut into windows of ``WINDOW`` consecutive words (an item of
fewer is one window). The corpus frequency of every test word is counted;
a window with a word that the corpus lacks can't occur. Of each other
window the ``RAREST`` rarest words are looked up: the training postings
``(word, document, position)`` of those words are stored as a table in the
shared folder, and their lists, moved by the words' places in the item, are
intersected into alignments ``(item, document, position - place)`` on
which at least two words agree. The documents with an alignment are read
again, the whole item is laid over the text there, and every run of equal
words that holds a window is an exact match; alignments where only a share
``PROXIMITY`` of the item's words agree are proximity matches.

Frequent words don't enter the index unless a window has no rarer ones,
lists are only ever joined on keys that hold the word, and no document's or
item's pairs are multiplied. Sides are broadcast by Spark's own size check.

Edge cases: null and empty texts have no words, no hits and stand in no
window; equal documents (also with one ``doc_id``) are matched once and all
marked; equal items of one id count once; null ``doc_id``s are kept apart
by their text; empty tables give no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import alnum_words, materialize, needed, table

WINDOW, RAREST, PROXIMITY = 10, 2, 0.8


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, text): ``doc`` tells documents apart by id and text."""
    return docs.select(F.struct(docs["doc_id"], F.xxhash64(docs["text"]).alias("hash")).alias("doc"), docs["text"])


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words): distinct items with a word."""
    rows = benchmark.select(benchmark["item_id"], alnum_words(benchmark["text"]).alias("words")).where(F.size("words") > 0).distinct()
    return rows.select(F.struct("item_id", F.xxhash64("words").alias("hash")).alias("item"), "item_id", "words")


def word_places(items: DataFrame) -> DataFrame:
    """(item, place, word, n): every word of every item."""
    return items.select("item", F.size("words").alias("n"), F.posexplode("words").alias("place", "word"))


def anchors(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(word, item, place): the RAREST words of each window whose words all occur in ``docs``."""
    places = word_places(items)
    vocabulary = places.select("word").distinct()
    counts = docs.select(F.explode(alnum_words(F.col("text"))).alias("word")).join(vocabulary, "word") \
                 .groupBy("word").agg(F.count("*").alias("freq"))
    known = places.join(counts, "word", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    # a word at ``place`` stands in the windows that begin at place - WINDOW + 1 to place
    begin = F.explode(F.sequence(F.greatest(F.col("place") - WINDOW + 1, F.lit(0)),
                                 F.greatest(F.least("place", F.col("n") - WINDOW), F.lit(0))))
    in_window = known.select("item", "place", "word", "freq", begin.alias("begin"))
    w = Window.partitionBy("item", "begin")
    ranked = in_window.select("*", F.min("freq").over(w).alias("least"), F.row_number().over(w.orderBy("freq", "place")).alias("rank"))
    return ranked.where((F.col("least") > 0) & (F.col("rank") <= RAREST)).select("word", "item", "place").distinct()


def postings(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(word, doc, position) of the given words."""
    return docs.select("doc", F.posexplode(alnum_words(F.col("text"))).alias("position", "word")).join(words, "word")


def alignments(anchored: DataFrame, index: DataFrame, items: DataFrame) -> DataFrame:
    """(item, doc, shift): places where the moved lists of an item's rarest words meet."""
    met = anchored.join(index, "word").groupBy("item", "doc", (F.col("position") - F.col("place")).alias("shift")) \
                  .agg(F.count_distinct("place").alias("agree"))
    sizes = items.select("item", F.least(F.size("words"), F.lit(RAREST)).alias("needed"))
    return met.join(sizes, "item").where("agree >= needed").select("item", "doc", "shift")


def _runs(equal: Column, n: Column) -> Column:
    """Ends and lengths of the runs of true values, as array of struct(end, length)."""
    start = F.struct(F.lit(0).alias("run"), F.array().cast("array<struct<end:int,length:int>>").alias("found"))
    closed = lambda acc, i: F.when(acc["run"] > 0, F.array_append(acc["found"], F.struct(i.alias("end"), acc["run"].alias("length")))) \
        .otherwise(acc["found"])
    walked = F.aggregate(F.sequence(F.lit(1), n), start, lambda acc, i: F.when(
        F.get(equal, i - 1), F.struct((acc["run"] + 1).alias("run"), acc["found"].alias("found")))
        .otherwise(F.struct(F.lit(0).alias("run"), closed(acc, i - 1).alias("found"))))
    return F.transform(F.array(walked), lambda acc: closed(acc, n))[0]


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc, item_id, shift, agree, n, exact): ``exact`` lists the (begin, end) of exact matches in the document.

    ``agree`` of the item's ``n`` words stand where the alignment puts them.
    """
    items = items_of(needed(benchmark, "item_id", "text"))
    docs = _keyed(needed(docs, "doc_id", "text"))
    anchored = materialize(anchors(items, docs), "test-anchors")
    index = materialize(postings(docs, anchored.select("word").distinct()), "test-postings")
    found = materialize(alignments(anchored, index, items), "test-alignments")
    texts = docs.join(found.select("doc").distinct(), "doc", "left_semi").dropDuplicates(["doc"]) \
                .select("doc", alnum_words(F.col("text")).alias("text_words"))
    laid = found.join(items, "item").join(texts, "doc")
    here = lambda i: F.when(F.col("shift") + i >= 0, F.get("text_words", F.col("shift") + i))
    equal = F.transform("words", lambda w, i: F.coalesce(here(i) == w, F.lit(False)))
    rows = laid.select("doc", "item_id", "shift", F.size("words").alias("n"), equal.alias("equal"))
    runs = _runs(F.col("equal"), F.col("n"))
    rows = rows.select("doc", "item_id", "shift", "n", F.size(F.filter("equal", lambda e: e)).alias("agree"), runs.alias("runs"))
    whole = F.filter("runs", lambda r: r["length"] >= F.least(F.col("n"), F.lit(WINDOW)))
    return rows.select("doc", "item_id", "shift", "n", "agree", F.transform(whole, lambda r: F.struct(
        (F.col("shift") + r["end"] - r["length"]).alias("begin"), (F.col("shift") + r["end"]).alias("end"))).alias("exact"))


def proximity(found: DataFrame, share: float = PROXIMITY) -> DataFrame:
    """Matches with ``share`` of an item's words in place, whether or not a window is whole."""
    return found.where(F.col("agree") >= share * F.col("n"))


def contaminated(docs: DataFrame, benchmark: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(doc, n_hit, items): documents with exact matches, the words inside them and the sorted item ids."""
    found = matches(docs, benchmark) if found is None else found
    spans = found.select("doc", "item_id", F.inline("exact"))
    w = Window.partitionBy("doc").orderBy("begin", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flat = spans.select("doc", "begin", "end").distinct().select("doc", "begin", "end", F.coalesce(reach, F.col("begin")).alias("reach"))
    hits = flat.groupBy("doc").agg(F.sum(F.greatest(F.col("end") - F.greatest("begin", "reach"), F.lit(0))).cast("long").alias("n_hit"))
    items = spans.groupBy("doc").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return hits.join(items, "doc")


def verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    found = contaminated(docs, benchmark)
    rows = _keyed(needed(docs, "doc_id", "text")).select("doc", F.size(alnum_words(F.col("text"))).cast("long").alias("n_words"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    joined = rows.alias("r").join(found.alias("f"), F.col("r.doc.hash").eqNullSafe(F.col("f.doc.hash"))
                                  & F.col("r.doc.doc_id").eqNullSafe(F.col("f.doc.doc_id")), "left")
    return joined.select(F.col("r.doc.doc_id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                         F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
                         F.col("n_hit").isNotNull().alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without exact matches, with exactly its columns."""
    found = materialize(contaminated(docs, benchmark).select("doc.doc_id", "doc.hash"), "contaminated")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]) & (F.xxhash64(docs["text"]) == found["hash"]), "left_anti")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH texts AS (
    SELECT row_number() OVER () AS id, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
cuts AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS b FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[b:b + n - 1], ' ') AS win FROM cuts),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT id, n, unnest(range(1, len(w) - n + 2)) AS b, w FROM texts, sizes WHERE len(w) >= n),
hits AS (SELECT p.id, p.b, p.n, v.item_id FROM (SELECT id, b, n, array_to_string(w[b:b + n - 1], ' ') AS win FROM places) p
         JOIN windows v ON v.n = p.n AND v.win = p.win),
covered AS (SELECT id, count(DISTINCT i) AS n_hit FROM (SELECT id, unnest(range(b, b + n)) AS i FROM hits) GROUP BY id),
named AS (SELECT id, string_agg(s, ',' ORDER BY s) AS items, count(*) AS n_items FROM (SELECT DISTINCT id, item_id::VARCHAR AS s FROM hits) GROUP BY id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM texts LEFT JOIN covered USING (id) LEFT JOIN named USING (id)
"""
