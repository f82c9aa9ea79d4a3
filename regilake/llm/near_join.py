"""Operator 4: n-gram Jaccard join with Bayesian candidate pruning.

Documents whose sets of word 5-grams have a Jaccard similarity of at least
``THRESHOLD`` are linked. Steps:

1. Equal sets are one class, told by a 128-bit fingerprint; its least
   (doc_id, hash) stands for it, so copies are never paired with each other.
2. Each class has ``HASHES`` MinHash values; ``ROWS`` of them make a band.
   Classes that share a band are tied to the least of that bucket (a star,
   not all pairs), and the ties' connected components hold all candidates.
3. A component is dealt in blocks of ``BLOCK`` members, and each pair of
   blocks is one small job: MinHash values are compared ``STEP`` at a time,
   a pair is dropped once the posterior probability (flat prior) that its
   similarity reaches the threshold is below ``TOLERANCE``, and what is left
   is verified on the sets themselves. A job returns its members' numbers
   of links and a spanning forest, never the pairs.
4. The forests' components are the groups.

A pair at the threshold shares no band with probability 2e-6, and pruning
drops it with less than ``HASHES / STEP * TOLERANCE``.

Words are runs without ASCII white space, A-Z lower-cased; texts of 1 to 4
words have one shingle of all of them. Shingles are compared by 64-bit hash.

Edge cases: null and empty texts have no shingles and are linked to nothing,
not even to each other; repeated rows are copies; a null ``doc_id`` is a
least id like any other; very long texts are hashed in pieces; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, materialize, mix64, needed, ship_package, table

N, THRESHOLD = 5, 0.8
HASHES, ROWS, STEP, TOLERANCE = 100, 4, 20, 1e-6
BLOCK = 128
_RANDOM = np.random.default_rng(20240607)
_A = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_PLACE = _RANDOM.integers(0, 1 << 63, N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word 5-grams."""
    import xxhash

    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(n, N)
    mixed = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        mixed += h[k:n - size + 1 + k] * _PLACE[k]
    return np.unique(mix64(mixed))


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash values (uint32) of a set of shingles."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 4096):
        np.minimum(least, (_A[:, None] * found[None, i:i + 4096] + _B[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc, f1, f2, minhash) per row; the last three are null for texts without words."""
    import xxhash

    ship_package(docs.sparkSession)

    def run(batches):
        for b in batches:
            f1, f2, sigs = [], [], []
            for t in b.column("text"):
                found = shingles(t.as_py())
                whole = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), "<i8") if len(found) else (None, None)
                f1.append(whole[0])
                f2.append(whole[1])
                sigs.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                                              pa.array(sigs, pa.binary())], names=["doc", "f1", "f2", "minhash"])

    return with_key(docs).mapInArrow(run, "doc struct<doc_id:long,hash:long>, f1 long, f2 long, minhash binary")


def with_key(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(docs["doc_id"], F.xxhash64(docs["text"]).alias("hash")).alias("doc"), docs["text"])


def ties(classes: DataFrame) -> DataFrame:
    """(a, b): each class of a bucket and the least one of it. ``classes`` has node, minhash."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1)),
                        lambda i: F.xxhash64(i, F.substring("minhash", i * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    rows = classes.select("node", F.explode(bands).alias("bucket"))
    repeated = rows.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1").select("bucket")
    shared = materialize(rows.join(repeated.hint("merge"), "bucket", "left_semi"), "near-buckets")
    hubs = shared.groupBy("bucket").agg(F.min("node").alias("hub"))
    return shared.join(hubs, "bucket").where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()


@lru_cache(maxsize=8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For 0, STEP, 2 STEP, ... compared values: the fewest matches with which a pair goes on.

    With a flat prior the similarity given m matches of n is Beta(m + 1, n - m + 1);
    that it reaches t has the probability of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(0, HASHES + 1, STEP):
        chance = [comb(n + 1, k) * threshold ** k * (1 - threshold) ** (n + 1 - k) for k in range(n + 2)]
        out.append(next(m for m in range(n + 1) if sum(chance[:m + 1]) >= tolerance))
    return tuple(out)


def surviving_pairs(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` (MinHash values) that are not pruned; each pair once if both are the same block."""
    i, j = np.nonzero(np.triu(np.ones((len(a), len(b)), bool), 1) if same else np.ones((len(a), len(b)), bool))
    matches = np.zeros(len(i), np.int32)
    for step, least in zip(range(0, HASHES, STEP), least_matches()[1:], strict=True):
        matches += (a[i, step:step + STEP] == b[j, step:step + STEP]).sum(axis=1, dtype=np.int32)
        keep = matches >= least
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def verified(i: np.ndarray, j: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose sets reach THRESHOLD; in whole numbers, so that the border itself counts."""
    if not len(i):
        return i, j
    used = np.unique(np.concatenate([i, j]))
    local = dict(zip(used.tolist(), np.split(np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True)[1],
                                             np.cumsum([len(sets[k]) for k in used])[:-1]), strict=True))
    mark = np.zeros(1 + max(int(x.max()) for x in local.values()), bool)
    common, current = np.empty(len(i), np.int64), None
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        if x != current:
            if current is not None:
                mark[local[current]] = False
            mark[local[x]] = True
            current = x
        common[k] = np.count_nonzero(mark[local[y]])
    sizes = np.array([len(s) for s in sets])
    union = sizes[i] + sizes[j] - common
    keep = 10 * common >= round(10 * THRESHOLD) * union
    return i[keep], j[keep]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of equal (component, low, high), which stand together."""
    key, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            now = (r["component"]["doc_id"], r["component"]["hash"], r["low"], r["high"])
            if now != key and rows:
                yield rows
                rows = []
            key = now
            rows.append(r)
    if rows:
        yield rows


def _linked(rows: list[dict]) -> Iterator[tuple[dict, dict | None, int]]:
    """(node, other, links) of one job: other is null for a node's number of links, links 0 for an edge of the forest."""
    low, high = rows[0]["low"], rows[0]["high"]
    left = [k for k, r in enumerate(rows) if r["block"] == low]
    right = left if low == high else [k for k, r in enumerate(rows) if r["block"] == high]
    sigs = np.array([np.frombuffer(r["minhash"], "<u4") for r in rows])
    i, j = surviving_pairs(sigs[left], sigs[right], low == high)
    i, j = np.array(left, np.int64)[i], np.array(right, np.int64)[j]
    alive = set(i.tolist()) | set(j.tolist())
    i, j = verified(i, j, [shingles(r["text"]) if k in alive else np.empty(0, np.uint64) for k, r in enumerate(rows)])
    copies = np.array([r["copies"] for r in rows])
    links = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
    for k in np.flatnonzero(links):
        yield rows[k]["node"], None, int(links[k])
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            yield rows[x]["node"], rows[y]["node"], 0


KEY = "struct<doc_id:long,hash:long>"


def links(candidates: DataFrame) -> DataFrame:
    """(node, other, links) from candidates (component, node, copies, minhash, text); see :func:`_linked`."""
    # only components of more than a block have a size: few, so that a large one's members need not meet for it
    sizes = candidates.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    dealt = candidates.join(sizes, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) \
                      .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    jobs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block",
        "node", "copies", "minhash", "text")

    def run(batches):
        for rows in _groups(batches):
            found = list(_linked(rows))
            kind = pa.struct([("doc_id", pa.int64()), ("hash", pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], kind),
                                              pa.array([f[2] for f in found], pa.int64())], names=["node", "other", "links"])

    keys = ["component", "low", "high"]
    return jobs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"node {KEY}, other {KEY}, links long")


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc, node, component, n_links) of every row of ``docs`` (doc_id, text).

    ``doc``: (doc_id, hash of the text); ``node``: the least of its copies;
    ``component``: the least of its group; ``n_links``: other rows whose
    similarity reaches the threshold. Rows without words have null node.
    """
    docs = needed(docs, "doc_id", "text")
    prints = materialize(fingerprints(docs), "near-prints")
    classes = prints.where("f1 IS NOT NULL").groupBy("f1", "f2").agg(F.min("doc").alias("node"), F.count("*").alias("copies"))
    classes = materialize(classes, "near-classes")
    nodes = classes.join(prints.select("f1", "f2", F.col("doc").alias("node"), "minhash"), ["f1", "f2", "node"]) \
                   .dropDuplicates(["node"]).select("node", "copies", "minhash")
    nodes = materialize(nodes, "near-nodes")
    tied = components(ties(nodes.select("node", "minhash")), "near-ties")
    members = nodes.join(tied, "node")
    # the candidates grow with the documents, so neither side is ever broadcast
    texts = with_key(docs).withColumnRenamed("doc", "node").join(tied.select("node").hint("merge"), "node", "left_semi") \
                          .dropDuplicates(["node"])
    found = materialize(links(members.join(texts, "node")), "near-links")
    groups = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")), "near-groups")
    counts = found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(groups, "node", "left").join(counts, "node", "left").select(
        "f1", "f2", "node", F.coalesce("component", "node").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return prints.select("doc", "f1", "f2").join(named, ["f1", "f2"], "left").select(
        "doc", "node", F.coalesce("component", "doc").alias("component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group, the least (doc_id, hash), with exactly the columns of ``docs``.

    Rows without words all stay. Of rows with equal ``doc_id`` and text one stays.
    """
    groups = near_groups(docs)
    drop = materialize(groups.where("doc != component").select("doc").distinct(), "near-drop")
    wordless = ~F.coalesce(docs["text"], F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    rows = docs.select(F.struct("*").alias("row"), wordless.alias("wordless"),
                       F.struct(docs["doc_id"], F.xxhash64(docs["text"]).alias("hash")).alias("doc"))
    kept = rows.join(drop.hint("merge"), "doc", "left_anti")
    copy = F.row_number().over(Window.partitionBy("doc").orderBy("doc"))
    return kept.withColumn("copy", copy).where("copy = 1 OR wordless").select("row.*")


def op4_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its group (the least doc_id in it), its copies' least id and its number of links."""
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("doc.doc_id").alias("doc_id"), F.col("component.doc_id").alias("class_id"),
                         F.coalesce("node.doc_id", "doc.doc_id").alias("copy_of"), "n_links")
