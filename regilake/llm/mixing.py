"""Operator 12: mixing sources to target weights.

The mix is made of blocks of ``BLOCK`` words:

1. Sources in code point order (null last) get weights, and from them word
   targets: a share of ``TOTAL`` times all words, at most ``MOST`` times the
   source's own words, the excess reshared by weight.
2. A source's documents are dealt to chunks by hash, about as many as a chunk
   has documents, and put in order within them; running sums in the chunks and over the chunks' totals give each
   document its place in the source's run of words, which is cut into blocks;
   the last one may be shorter.
3. A source takes as many slots as fill its target: whole passes over its
   blocks, then part of one. A pass goes through the full blocks in the order
   of a pseudorandom permutation of their indexes (a Feistel network keyed by
   seed, source and pass), the short block last; the last slot may be cut.
4. Slots are dealt to output shards of ``SHARD``: a shard's source counts are
   a multinomial draw limited to what is left. The draws go down a binary tree
   of shards (a node deals its sources' slots to its two halves), each node's
   generator seeded by its place, so that every task finds its shards' counts
   and the sources' slots before them by itself, and all targets are met.
5. Slots join the blocks' parts by source and block index.

The result, :func:`mix`, has a row for each part of a document in each slot;
:func:`with_text` adds the words. Equal inputs and seeds give equal mixes, on
any partitioning.

Edge cases: null and empty texts have no words and are never taken; null
sources are one source; a null ``doc_id`` is like any other; equal rows stand
beside each other in the source's order, so each is taken by itself; a long
document spans many blocks; empty tables give no rows; other columns are
ignored. More than ``SOURCES`` sources are an error, since every task holds
their counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, mix64, needed, ship_package, space_words, table

WEIGHTS, TOTAL, MOST = (5, 2, 1), 1.5, 2.0
BLOCK, SHARD, COPIES, SOURCES, SEED = 256, 4096, 10_000, 65_536, 12
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> list[float]:
    """Word targets by weight, none above ``most`` times its size; what they exceed is reshared by weight."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    left, open_, out = total * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        each = left / sum(weight[i] for i in open_)
        full = {i for i in open_ if each * weight[i] > most * sizes[i]}
        for i in full or open_:
            out[i] = most * sizes[i] if full else each * weight[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


class Plan:
    """Sizes and targets of the sources, and what follows from them; small enough for every task."""

    def __init__(self, names: list[str | None], sizes: list[int], targets: list[float], block: int, shard: int, seed: int):
        self.names, self.sizes, self.targets, self.block, self.shard, self.seed = names, sizes, targets, block, shard, seed
        size = np.array(sizes, np.int64)
        self.words = np.rint(np.array(targets)).astype(np.int64)
        self.full, self.short = size // block, size % block
        self.blocks = self.full + (self.short > 0)
        whole = np.where(size > 0, self.words // np.maximum(size, 1), 0)
        rest = self.words - whole * size
        self.slots = whole * self.blocks + -(-rest // block)
        self.total = int(self.slots.sum())
        self.shards = -(-self.total // shard)

    def counts(self, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, slots of each source, slots of each source in earlier shards) for the shards from first to below last."""
        def down(begin, end, own, before):
            if end <= first or begin >= last or begin == end:
                return
            if end - begin == 1:
                yield begin, own, before
                return
            middle = (begin + end) // 2
            left = self._half(begin, end, min(self.total, middle * self.shard) - begin * self.shard, own)
            yield from down(begin, middle, left, before)
            yield from down(middle, end, own - left, before + left)

        yield from down(0, self.shards, self.slots, np.zeros(len(self.slots), np.int64))

    def _half(self, begin: int, end: int, slots: int, own: np.ndarray) -> np.ndarray:
        """A multinomial draw of so many of ``own``; what exceeds a source's slots is drawn again from the others'."""
        rng = np.random.default_rng([self.seed, begin, end])
        drawn = np.zeros_like(own)
        while (short := slots - int(drawn.sum())) > 0:
            left = own - drawn
            drawn += np.minimum(rng.multinomial(short, left / left.sum()), left)
        return drawn

    def block_of(self, source: int, slot: np.ndarray) -> np.ndarray:
        """Block index that the source's slots take."""
        if not len(slot):
            return slot
        passes, at = np.divmod(slot, self.blocks[source])
        out = at.copy()
        for p in np.unique(passes):
            own = np.flatnonzero((passes == p) & (at < self.full[source]))
            out[own] = permuted(at[own], int(self.full[source]), (self.seed, source, int(p)))
        return out

    def length(self, source: int, slot: np.ndarray) -> np.ndarray:
        """Words that the slots take of their blocks."""
        passes, at = np.divmod(slot, max(int(self.blocks[source]), 1))
        begin = passes * self.sizes[source] + at * self.block
        return np.minimum(np.where(at < self.full[source], self.block, self.short[source]), self.words[source] - begin)


def permuted(index: np.ndarray, n: int, key: tuple[int, ...]) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n - 1 at the given indexes: a four-round Feistel network, walked until it falls below n."""
    if n < 2:
        return index
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = np.random.default_rng([*key]).integers(0, 1 << 63, 4).astype(np.uint64)
    out, open_ = index.astype(np.uint64), np.arange(len(index))
    while len(open_):
        left, right = out[open_] >> half, out[open_] & mask
        for k in keys:
            left, right = right, left ^ (mix64(right ^ k) & mask)
        out[open_] = left << half | right
        open_ = open_[out[open_] >= n]
    return out.astype(np.int64)


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, source, h1, h2, size), written once: hashes of the text and its words."""
    rows = needed(docs, "doc_id", "source", "text")
    return materialize(rows.select("doc_id", "source", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"),
                                   F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-sizes")


def plan_of(rows: DataFrame, weights=WEIGHTS, total=TOTAL, most=MOST, block=BLOCK, shard=SHARD, seed=SEED) -> Plan:
    """Sources in code point order, null last, with their sizes and targets."""
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).orderBy(F.col("source").asc_nulls_last()).limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    sizes = [r["size"] for r in found]
    return Plan([r.source for r in found], sizes, targets(sizes, weights, total, most), block, shard, seed)


def source_table(spark: SparkSession, plan: Plan) -> DataFrame:
    """(source, s, source_size, target): at most SOURCES rows."""
    return spark.createDataFrame(list(zip(plan.names, range(len(plan.names)), plan.sizes, plan.targets, strict=True)),
                                 "source string, s int, source_size long, target double")


def placed(rows: DataFrame, plan: Plan) -> DataFrame:
    """(row, s, doc_id, h1, h2, size, begin), written once: where each document's words begin in its source's run."""
    spark = rows.sparkSession
    sources = F.broadcast(source_table(spark, plan))
    known = rows.alias("d").join(sources.alias("s"), F.expr("d.source <=> s.source")).select("d.*", "s.s")
    chunks = math.isqrt(rows.count()) + 1
    # equal rows stand beside each other as one run, however many they are
    runs = known.groupBy("s", "doc_id", "h1", "h2", "size").agg(F.count("*").alias("copies"))
    runs = runs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "h1", "h2"), F.lit(chunks)).cast("int"))
    runs = runs.withColumn("all", F.col("size") * F.col("copies"))
    totals = runs.groupBy("s", "chunk").agg(F.sum("all").alias("chunk_size"))
    before = F.sum("chunk_size").over(Window.partitionBy("s").orderBy("chunk")) - F.col("chunk_size")
    totals = totals.select("s", "chunk", before.alias("chunk_begin"))
    own = Window.partitionBy("s", "chunk").orderBy("doc_id", "h1", "h2").rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("within", F.sum("all").over(own) - F.col("all")).join(totals, ["s", "chunk"])
    some = runs.withColumn("some", F.explode(F.expr(f"sequence(0L, copies - 1, {COPIES}L)"))).repartition("s", "doc_id", "h1", "some")
    out = some.withColumn("copy", F.explode(F.expr(f"sequence(some, least(some + {COPIES}, copies) - 1)")))
    return materialize(out.select(F.monotonically_increasing_id().alias("row"), "s", "doc_id", "h1", "h2", "size",
                                  (F.col("chunk_begin") + F.col("within") + F.col("copy") * F.col("size")).alias("begin")), "mix-places")


def slots(spark: SparkSession, plan: Plan) -> DataFrame:
    """(shard, slot, s, block, n): which block of which source each slot of each shard takes, and how many of its words."""
    ship_package(spark)

    def run(batches):
        for b in batches:
            for shard in b.column("id").to_pylist():
                for k, own, before in plan.counts(shard, shard + 1):
                    source = np.repeat(np.arange(len(own)), own)
                    slot = np.random.default_rng([plan.seed, 1 << 40, k]).permutation(len(source))
                    block, n = np.zeros(len(source), np.int64), np.zeros(len(source), np.int64)
                    for s in np.flatnonzero(own):
                        at = before[s] + np.arange(own[s])
                        block[source == s], n[source == s] = plan.block_of(s, at), plan.length(s, at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(source), k)), pa.array(slot.astype(np.int32)), pa.array(source.astype(np.int32)),
                                                      pa.array(block), pa.array(n)], names=["shard", "slot", "s", "block", "n"])

    return spark.range(plan.shards).mapInArrow(run, "shard long, slot int, s int, block long, n long")


def block_parts(places: DataFrame, plan: Plan) -> DataFrame:
    """(s, block, at, row, first, words): the documents' parts in each block; ``at`` is a part's place in its block, ``first`` its first word in the document."""
    size = F.lit(plan.block)
    end = F.col("begin") + F.col("size")
    cut = places.where(F.col("size") > 0).withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / size), F.floor((end - 1) / size))))
    low = F.greatest("begin", F.col("block") * size)
    return cut.select("s", "block", (low - F.col("block") * size).alias("at"), "row", (low - F.col("begin")).alias("first"),
                      (F.least(end, (F.col("block") + 1) * size) - low).alias("words"))


def mix(places: DataFrame, plan: Plan) -> DataFrame:
    """(shard, slot, at, s, block, row, first, words): the mix, a row for each part of a document in each slot."""
    # Spark takes the slots for few, since they come from a few shard numbers: they grow with the words, so never broadcast
    taken = slots(places.sparkSession, plan).hint("merge")
    parts = block_parts(places, plan).join(taken, ["s", "block"]).where(F.col("at") < F.col("n"))
    return parts.select("shard", "slot", "at", "s", "block", "row", "first", F.least("words", F.col("n") - F.col("at")).alias("words"))


def with_text(mixed: DataFrame, places: DataFrame, docs: DataFrame) -> DataFrame:
    """(shard, slot, at, doc_id, text): the mix with its words, joined by blanks; shards are written sorted by slot and place."""
    ship_package(docs.sparkSession)
    texts = needed(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    texts = texts.dropDuplicates(["doc_id", "h1", "h2"])
    named = mixed.join(places.select("row", "doc_id", "h1", "h2"), "row").groupBy("doc_id", "h1", "h2", "first", "words").agg(
        F.collect_list(F.struct("shard", "slot", "at")).alias("places"))  # a part is taken a few times
    same = F.expr("p.doc_id <=> t.doc_id AND p.h1 = t.h1 AND p.h2 = t.h2")
    rows = named.alias("p").join(texts.alias("t"), same).select("p.doc_id", "first", "words", "places", "text")

    def run(batches):
        for b in batches:
            out = []
            for t, first, n in zip(*[b.column(c).to_pylist() for c in ("text", "first", "words")], strict=True):
                out.append(b" ".join(space_words(t)[first:first + n]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("places"), pa.array(out, pa.string())], names=["doc_id", "places", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, places array<struct<shard:bigint,slot:int,at:bigint>>, text string")
    return out.select("doc_id", "text", F.inline("places")).select("shard", "slot", "at", "doc_id", "text")


def mix_documents(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame, Plan]:
    """The mix, the documents' places, and the plan."""
    rows = counted(docs)
    plan = plan_of(rows, **options)
    places = placed(rows, plan)
    return mix(places, plan), places, plan


def op12_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, places, plan = mix_documents(table(spark, sf_dir, "documents"))
    taken = mixed.groupBy("row").agg(F.sum("words").alias("taken"))
    known = places.join(F.broadcast(source_table(spark, plan)).drop("source"), "s")
    return known.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
