"""Operator 6: quality classifier by interpolated modified Kneser-Ney n-gram models.

The word model counts the word pairs of the labelled documents, without a
bound on words or pairs: words are runs of letters and digits of any script
(single letters in scripts without blanks) and runs of other characters, in
lower case, as 64-bit hashes. Documents are kept as packed blocks of some
thousand. Every distinct pair of a block is looked up in the table of seen
pairs' counts, and every distinct word in that of back-off weights and
continuation probabilities: tables and blocks send their sorted keys, packed,
to the keys' ranges, and what is known returns in the order of the keys to the
block, where the sums by document are its bits a word and its perplexity.
Pairs are counted in a few parts and documents judged in as many, one after
another, and tables and shuffle files go once they are used, so that little is
on disk at a time.

Documents are dealt to two folds by their text, and each is judged by the
models of the other fold, so that no labelled document is judged by its own
words and the trusted ones' quantiles hold for unseen documents too.

The character model (trigrams of ``CLASSES`` classes: printable ASCII one by
one, others by code point modulo ``OTHERS``) is trained on all trusted
documents (label quality 1 and not toxic). It only adds a measure that
rejects junk in which no word pair stands; its table has ``CLASSES ** 3``
entries and is broadcast.

A second word model is trained on the documents labelled as of low quality;
by how much it makes the words likelier than trusted text does is a measure
(mean). A third is trained on the toxic ones; there the worst word counts, by
its continuation probabilities, as a few insults hardly move a mean.

Verdict: of the trusted documents' values of each measure, a quantile by
language and length class (short texts scatter more); a document with more
is rejected. The character model has seen the trusted documents, so there
``MARGIN`` bits are added. Languages without enough trusted documents take
the quantile over all languages, length classes without any that over all
lengths.

Edge cases: null and empty texts have no perplexity and are kept; null
languages are a group of their own; a document is trusted if all its labels
say so; without any trusted text nothing is rejected; equal rows are judged
alike; an empty table gives no rows; other columns are ignored, and
:func:`filter_documents` returns exactly the given columns.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, mix64, needed, ship_package, table

OTHERS = 95
CLASSES = 2 + 95 + OTHERS  # a text's start, control characters, printable ASCII, others
QUANTILE, MARGIN, LEAST = 0.99, 0.5, 50
#: Characters of scripts without blanks, one word each; bytes of the texts whose words are found together; pairs of words that are sorted together.
ALONE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
PIECE_BYTES = 500_000
BATCH_WORDS = 2_000_000
#: Words of a block of documents; goes in which pairs and documents are dealt with at most, a power of two, and labelled words of one.
BLOCK_WORDS, MOST_PARTS, PART_WORDS = 700_000, 4, 200_000
#: Ranges of keys in which a fold's words or pairs are looked up are ``2 ** LEAST_BITS``, or more so that labelled words of one are no more.
LEAST_BITS, RANGE_WORDS = 7, 8_000_000
#: What is known of a word by class: after how many words it stands; as the first of pairs, their number and how many stand once, twice, more often. Of a pair: how often it stands.
WORD_VALUES = ["n0", "n1", "n2", *[f"{x}{c}" for c in (0, 1) for x in ("count", "a", "b", "c")]]
PAIR_VALUES = ["n0", "n1"]
#: What a document is judged by, with the bits added to the trusted documents' quantile.
MEASURES = {"char_bits": MARGIN, "bits": 0.0, "ratio": 0.0, "worst": 0.0}


def _class_table() -> np.ndarray:
    cp = np.arange(0x110000)
    return np.where(cp < 32, 1, np.where(cp < 127, cp - 30, np.where(cp < 160, 1, 97 + cp % OTHERS))).astype(np.uint8)


CLASS = _class_table()


def trigrams(text: str) -> np.ndarray:
    """Number of each character's trigram: its class and those of the two before."""
    c = CLASS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int32)
    c = np.concatenate([np.zeros(2, np.int32), c])
    return (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return good.where("doc_id IS NOT NULL AND q = 1 AND t = 0").select("doc_id")


def _text_columns(docs: DataFrame) -> list[str]:
    return ["zipped", "bytes"] if "zipped" in docs.columns else ["text"]


def _texts(b: pa.RecordBatch) -> list[str | None]:
    """The batch's texts, :func:`packed` or not: who reads packed ones unpacks them, as a step for that would take workers of its own."""
    if "zipped" not in b.schema.names:
        return b.column("text").to_pylist()
    return [None if z is None else pa.decompress(z, decompressed_size=n, codec="zstd", asbytes=True).decode("utf-8", "surrogatepass")
            for z, n in zip(b.column("zipped").to_pylist(), b.column("bytes").to_pylist(), strict=True)]


def _pieces(b: pa.RecordBatch):
    """Neighbouring rows whose texts together have up to PIECE_BYTES, or one longer text."""
    sizes = b.column("bytes") if "zipped" in b.schema.names else pc.fill_null(pc.binary_length(b.column("text")), 0)
    ends, begin = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PIECE_BYTES, "right")))
        yield b.slice(begin, end - begin)
        begin = end


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(w, n) over all of ``docs``."""
    ship_package(docs.sparkSession)

    def run(batches):
        n = np.zeros(CLASSES ** 3, np.int64)
        for b in batches:
            for piece in _pieces(b):
                if grams := [trigrams(t) for t in _texts(piece) if t]:
                    np.add.at(n, np.concatenate(grams), 1)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(n[seen], pa.int64())], names=["w", "n"])

    return needed(docs, *_text_columns(docs)).mapInArrow(run, "w int, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _discount_columns() -> list[Column]:
    """d1, d2, d3 of modified Kneser-Ney smoothing from the counts of counts n1 to n4."""
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def d(k: int) -> Column:  # where counts of counts are missing, absolute discounting by 0.5
        found = k - F.try_divide((k + 1) * y * F.col(f"n{k + 1}"), F.col(f"n{k}"))
        return F.coalesce(F.when((found > 0) & (found < k), found), F.lit(0.5)).alias(f"d{k}")

    return [d(1), d(2), d(3)]


def _discounts(counts: DataFrame) -> DataFrame:
    """One row: the discounts for counts ``n``."""
    t = counts.agg(*[F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    return t.select(*_discount_columns())


def _level(counts: DataFrame, lower: DataFrame, context: Column, rest: Column) -> tuple[DataFrame, DataFrame]:
    """(w, p) of the seen n-grams and (h, gamma) of their contexts, interpolated with ``lower`` (w, p)."""
    cut = counts.join(_discounts(counts), F.lit(True))  # one row
    cut = cut.select("w", "n", context.alias("h"), rest.alias("rest"),
                     F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")).alias("d"))
    heads = cut.groupBy("h").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("gamma"))
    joined = cut.join(heads, "h").join(lower.select(F.col("w").alias("rest"), F.col("p").alias("below")), "rest")
    return joined.select("w", ((F.col("n") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("below")).alias("p")), \
        heads.select("h", "gamma")


def train(docs: DataFrame) -> dict[str, np.ndarray] | None:
    """The model of ``docs``: seen n-grams with probabilities and contexts with back-off weights of each order."""
    k = CLASSES
    three = materialize(count_trigrams(docs), "kn-trigrams", free=True)
    if three.isEmpty():
        return None
    tail = lambda size: F.pmod(F.col("w"), F.lit(size))
    two = three.groupBy(tail(k * k).alias("w")).agg(F.count("*").alias("n"))  # in how many contexts an n-gram stands
    one = two.groupBy(tail(k).alias("w")).agg(F.count("*").alias("n"))
    flat = one.select(tail(1).alias("w")).distinct().withColumn("p", F.lit(1.0 / k))
    p1, _ = _level(one, flat, F.lit(0), F.lit(0))
    p1 = materialize(p1, "kn-one")
    p2, g2 = _level(two, p1, F.floor(F.col("w") / k).cast("int"), tail(k))
    p2 = materialize(p2, "kn-two")
    p3, g3 = _level(three, p2, F.floor(F.col("w") / k).cast("int"), tail(k * k))
    gamma1 = one.join(_discounts(one), F.lit(True)).agg(
        (F.sum(F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))) / F.sum("n")).alias("gamma"))
    out = {"gamma1": np.array([gamma1.first()[0]])}
    for name, df, key in (("p1", p1, "w"), ("p2", p2, "w"), ("p3", p3, "w"), ("g2", g2, "h"), ("g3", g3, "h")):
        t = df.select(F.col(key).cast("int").alias("k"), F.col(df.columns[1]).cast("double").alias("v")).toArrow()
        out[f"{name}_at"], out[name] = t.column("k").to_numpy(), t.column("v").to_numpy()
    return out


def log_table(model: dict[str, np.ndarray]) -> np.ndarray:
    """Negative log2-probability of each trigram, CLASSES ** 3 single floats."""
    k = CLASSES
    one = np.full(k, float(model["gamma1"][0]) / k)
    one[model["p1_at"]] = model["p1"]
    g2, g3 = np.ones(k), np.ones(k * k)
    g2[model["g2_at"]], g3[model["g3_at"]] = model["g2"], model["g3"]
    two = (g2[:, None] * one[None, :]).reshape(-1)
    two[model["p2_at"]] = model["p2"]
    order = np.argsort(model["p3_at"])
    at, p3 = model["p3_at"][order], model["p3"][order]
    costs = np.empty((k, k * k), np.float32)
    for c in range(k):  # by the first class, as only single floats of all trigrams are kept
        three = (g3.reshape(k, k)[c, :, None] * two.reshape(k, k)).reshape(-1)
        begin, end = np.searchsorted(at, (c * k * k, (c + 1) * k * k))
        three[at[begin:end] - c * k * k] = p3[begin:end]
        costs[c] = -np.log2(three)
    return costs.reshape(-1)


def score(docs: DataFrame, model: dict[str, np.ndarray] | None, *carry: str) -> DataFrame:
    """``carry`` columns, n_chars and char_bits (per character; null for texts without characters)."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = needed(docs, *carry, "text")
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry] + ["n_chars long", "char_bits double"])

    def run(batches):
        model, costs = shared.value, None
        for b in batches:
            if costs is None and model is not None:
                costs = log_table(model)
            n, bits = [], []
            for t in b.column("text"):
                t = t.as_py() or ""
                n.append(len(t))
                bits.append(float(costs[trigrams(t)].sum(dtype=np.float64)) / len(t) if t and costs is not None else None)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], pa.array(n, pa.int64()), pa.array(bits, pa.float64())],
                                             names=[*carry, "n_chars", "char_bits"])

    return rows.mapInArrow(run, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``hash``, which tells documents of one id apart."""
    return docs.withColumn("hash", F.xxhash64("text"))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """By code point: 0 white space, 1 other characters, 2 letters, marks and digits; those of ALONE 3, 4 if letters, marks or digits."""
    every, kind = "".join(map(chr, range(0x110000))), np.ones(0x110000, np.uint8)
    for k, pattern in ((2, r"[\p{L}\p{M}\p{N}]+"), (3, f"[{ALONE}]+"), (0, r"[ \t\n\x0b\f\r]+")):
        for m in regex.finditer(pattern, every):
            kind[m.start():m.end()] = np.where(kind[m.start():m.end()] == 2, 4, 3) if k == 3 else k
    return kind


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text and the 64-bit hashes of all words, in lower case, one after another.

    Words are the matches of ``[ALONE]|[letters, marks, digits but ALONE]+|[others]+``, the first that fits.
    """
    held = [(t or "").lower() for t in texts]
    cp = np.frombuffer("\n".join([*held, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _kinds()[cp]
    before = np.append(np.uint8(0), kind[:-1])
    start = (kind == 4) | ((kind == 2) & (before != 2)) | ((kind == 1) & (before != 1))
    if (kind == 3).any():  # a sign is a word of its own unless other characters before it have begun one
        sign = (kind & 1).astype(bool)
        others = np.cumsum(kind == 1) - (kind == 1)
        run = np.flatnonzero(sign & (before & 1 == 0))
        at = np.flatnonzero(sign)
        start[at] = others[at] == others[run][np.searchsorted(run, at, "right") - 1]
    n = np.add.reduceat(start.astype(np.int64), np.cumsum([0, *[len(t) + 1 for t in held[:-1]]])) if held else np.empty(0, np.int64)
    at = np.flatnonzero(kind)
    begin = np.flatnonzero(start[at])
    if not len(begin):
        return n, np.empty(0, np.uint64)
    nth = np.arange(len(at), dtype=np.uint64) - np.repeat(begin.astype(np.uint64), np.diff(begin, append=len(at)))
    return n, mix64(np.add.reduceat(mix64((nth << np.uint64(21) | cp[at]) + np.uint64(0x9E3779B97F4A7C15)), begin))


def _runs(batches, limit: int, keep: list[str]):
    """(rows, words of each, all words) of neighbouring rows with words that together have so many, or of a piece or row with more."""
    def whole(held: list[tuple]):
        rows, size, words = pa.Table.from_batches([x[0] for x in held]), *[np.concatenate([x[k] for x in held]) for k in (1, 2)]
        return rows.filter(pa.array(size > 0)).combine_chunks(), size[size > 0], words

    for b in batches:
        held, n = [], 0
        for piece in _pieces(b):
            size, words = word_hashes(_texts(piece))
            if n and n + len(words) > limit:
                yield whole(held)
                held, n = [], 0
            if len(words):
                held.append((piece.select(keep), size, words))
                n += len(words)
        if n:
            yield whole(held)


def _before(w: np.ndarray, size: np.ndarray, start) -> np.ndarray:
    """The word before each; ``start`` before the first of each row."""
    h = np.append(w.dtype.type(start), w[:-1])
    h[np.cumsum(size)[:-1]] = start
    return h


def _pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    g = mix64(h + np.uint64(0x9E3779B97F4A7C15)) ^ mix64(w)
    return mix64(g + h)


def word_pairs(docs: DataFrame, *carry: str) -> DataFrame:
    """(doc_id, hash, carry, f, g, h, w, n): the distinct pairs ``g`` of a word ``h`` and the next, ``w``, of each row.

    ``f`` is the document's fold. Before the first word stands 0.
    """
    return block_pairs(word_blocks(docs, *carry), *carry)


def _list(values, kind=None) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def word_blocks(docs: DataFrame, *carry: str) -> DataFrame:
    """Rows of some thousand keyed documents that have words.

    ``doc_id``, ``hash``, ``carry`` and ``size`` (in words) by document;
    ``vocab``, the distinct words' hashes, the most frequent first; ``words``,
    the places in it of all words one after another, packed (:func:`_block`).
    """
    ship_package(docs.sparkSession)
    lists = ["doc_id", "hash", *carry]
    rows = docs.select(*lists, *_text_columns(docs))
    schema = ", ".join(["block long", *[f"{c} array<{rows.schema[c].dataType.simpleString()}>" for c in lists], "size array<int>, vocab array<long>, words binary"])

    def run(batches):
        task = TaskContext.get().partitionId()
        for k, (part, size, w) in enumerate(_runs(batches, BLOCK_WORDS, lists)):
            vocab, at, n = np.unique(w, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            place = np.empty(len(order), "<u4")
            place[order] = np.arange(len(order))
            planes = place[at].view(np.uint8).reshape(-1, 4).T.tobytes()  # the bytes of one rank together pack better
            yield pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + k], pa.int64()), *[_list(part.column(c).combine_chunks()) for c in lists], _list(size, pa.int32()),
                 _list(vocab[order].view(np.int64)), pa.array([pa.compress(planes, codec="zstd", asbytes=True)], pa.binary())],
                names=["block", *lists, "size", "vocab", "words"])

    return rows.mapInArrow(run, schema)


def _block(rows: pa.RecordBatch | pa.Table, i: int, part: int = 0, parts: int = 1) -> tuple[np.ndarray, ...]:
    """Words by document, their hashes by place (0: before the first word), and by word its document's fold and number, the place of the word before and its own.

    Only words are told whose pair is in the ``part``; ``parts`` is a power of two.
    """
    size, vocab, hashes = (np.asarray(rows.column(c)[i].values) for c in ("size", "vocab", "hash"))
    size, ids = size.astype(np.int64), np.append(np.uint64(0), vocab.view(np.uint64))
    planes = pa.decompress(rows.column("words")[i].as_py(), decompressed_size=4 * int(size.sum()), codec="zstd", asbytes=True)
    w = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64) + 1
    h, row = _before(w, size, 0), np.repeat(np.arange(len(size)), size)
    if parts > 1:
        low = (ids & np.uint64(parts - 1)).astype(np.uint8)
        mine = np.flatnonzero(low[h] ^ low[w] == part)
        h, w, row = h[mine], w[mine], row[mine]
    return size, ids, (hashes & 1)[row], row, h, w


def block_pairs(blocks: DataFrame, *carry: str, part: int = 0, parts: int = 1) -> DataFrame:
    """Rows of :func:`word_pairs` of the documents in ``blocks``, those whose pair is in the part."""
    kept = ["doc_id", "hash", *carry]
    schema = ", ".join([f"{c} {blocks.schema[c].dataType.elementType.simpleString()}" for c in kept] + ["g long", "h long", "w long", "n int"])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                _, ids, _, row, h, w = _block(b, i, part, parts)
                k = len(ids)
                code, n = np.unique((row * k + h) * k + w, return_counts=True)
                h, w = ids[code // k % k], ids[code % k]
                of = pa.array(code // (k * k))
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c)[i].values.take(of) for c in kept], *[pa.array(x.view(np.int64)) for x in (_pair_keys(h, w), h, w)], pa.array(n.astype(np.int32))],
                    names=[*kept, "g", "h", "w", "n"])

    return blocks.mapInArrow(run, schema).withColumn("f", F.pmod("hash", F.lit(2)).cast("int"))


def block_counts(blocks: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """(f, h, w, n0, n1, n2): how often each block's documents of a fold have a pair, by class; ``f`` is the other fold, which they judge."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                _, ids, fold, row, h, w = _block(b, i, part, parts)
                k, cls = len(ids), np.asarray(b.column("cls")[i].values)[row]
                code, at = np.unique((fold * k + h) * k + w, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((1 - code // (k * k)).astype(np.int32)), *[pa.array(ids[x].view(np.int64)) for x in (code // k % k, code % k)],
                     *[pa.array(np.bincount(at[cls == c], minlength=len(code)).astype(np.int32)) for c in (0, 1, 2)]], names=["f", "h", "w", "n0", "n1", "n2"])

    return blocks.mapInArrow(run, "f int, h long, w long, n0 int, n1 int, n2 int")


def _sought(ids: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a fold's words: their places and 0, each once, by hash; their pairs' codes and keys, each once, and the codes' places by key."""
    k = len(ids)
    seen = np.zeros(k, bool)
    seen[w] = seen[0] = True
    places, code = np.flatnonzero(seen), np.unique(h * k + w)
    keys = _pair_keys(ids[code // k], ids[code % k])
    return places[np.argsort(ids[places])], code, keys, np.argsort(keys)


def _asked(blocks: DataFrame, pairs: bool, part: int, parts: int) -> DataFrame:
    """(block, f, key): every word of a block's documents of a fold, and the 0 before the first; or every pair. Each once, if it is in the part."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                _, ids, fold, _, h, w = _block(b, i, part if pairs else 0, parts if pairs else 1)
                for x in np.unique(fold).tolist():
                    places, _, keys, _ = _sought(ids, h[fold == x], w[fold == x])
                    if not pairs:
                        keys = ids[places][ids[places] % np.uint64(parts) == part]
                    yield pa.RecordBatch.from_arrays([pa.repeat(b.column("block")[i], len(keys)), pa.array(np.full(len(keys), x, np.int32)), pa.array(keys.view(np.int64))],
                                                     names=["block", "f", "key"])

    return blocks.mapInArrow(run, "block long, f int, key long")


def _zip(x: np.ndarray) -> bytes:
    """Whole numbers from 0, packed: their width in bytes, then the bytes of one rank together, as these pack better."""
    width = np.min_scalar_type(int(x.max(initial=0))).itemsize
    planes = x.reshape(-1).astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + pa.compress(planes, codec="zstd", asbytes=True)


def _unzip(packed: bytes, n: int) -> np.ndarray:
    width = packed[0]
    planes = pa.decompress(packed[1:], decompressed_size=width * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(f"<u{width}").reshape(-1).astype(np.uint64)


def _zip_keys(keys: np.ndarray) -> bytes:
    return _zip(np.diff(keys, prepend=np.uint64(0)))


def _unzip_keys(packed: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unzip(packed, n), dtype=np.uint64)


def _ranges(keys: np.ndarray, bits: int):
    """(range, begin, end) of sorted keys by their first bits, those with keys."""
    ends = np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(keys))
    return [(r, int(ends[r]), int(ends[r + 1])) for r in np.flatnonzero(np.diff(ends)).tolist()]


def _by_range(rows: DataFrame, names: list[str], first: int, bits: int) -> DataFrame:
    """(range, n, keys, found): ``rows`` of (f, w, names) or of (f, h, w, names), packed by ranges of the words' or the pairs' keys, many rows to one.

    The ranges of fold ``f`` follow ``first + f``, shifted by ``bits``.
    """
    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t, out = pa.Table.from_batches(held), []
        f, w, *h = (t.column(c).to_numpy() for c in ("f", "w", *[c for c in ("h",) if c in t.schema.names]))
        keys = _pair_keys(h[0].view(np.uint64), w.view(np.uint64)) if h else w.view(np.uint64)
        values = np.stack([t.column(c).to_numpy() for c in names])
        for x in (0, 1):
            of = np.flatnonzero(f == x)
            of = of[np.argsort(keys[of])]
            out += [((first + x) << bits | r, end - begin, _zip_keys(keys[of[begin:end]]), _zip(values[:, of[begin:end]])) for r, begin, end in _ranges(keys[of], bits)]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                                          names=["range", "n", "keys", "found"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= BATCH_WORDS // 2:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    return rows.mapInArrow(run, "range int, n int, keys binary, found binary")


def _rows(packed: DataFrame, key: str, names: list[str], bits: int) -> DataFrame:
    """(f, key, names) of what :func:`_by_range` has packed."""
    def run(batches):
        for b in batches:
            for r, n, keys, found in zip(*[b.column(c).to_pylist() for c in ("range", "n", "keys", "found")], strict=True):
                values = _unzip(found, n * len(names)).astype(np.int64).reshape(-1, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r >> bits & 1, np.int32)), pa.array(_unzip_keys(keys, n).view(np.int64)),
                                                  *[pa.array(v) for v in values]], names=["f", key, *names])

    return packed.mapInArrow(run, ", ".join(["f int", f"{key} long", *[f"{c} long" for c in names]]))


def _requests(blocks: DataFrame, bits: int) -> DataFrame:
    """(range, n, keys, block): the sorted keys of each block's words and pairs, by fold, packed by range."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                (_, ids, fold, _, h, w), out = _block(b, i), []
                for x in np.unique(fold).tolist():
                    places, _, keys, by_key = _sought(ids, h[fold == x], w[fold == x])
                    for group, sought in ((x, ids[places]), (2 + x, keys[by_key])):
                        out += [(group << bits | r, end - begin, _zip_keys(sought[begin:end])) for r, begin, end in _ranges(sought, bits)]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.repeat(b.column("block")[i], len(out))], names=["range", "n", "keys", "block"])

    return blocks.mapInArrow(run, "range int, n int, keys binary, block long")


def looked_up(requests: DataFrame, tables: DataFrame, bits: int) -> DataFrame:
    """(range, n, block, found): what the tables of :func:`_by_range` know of each request's keys, in their order; 0 where they have nothing."""
    known = tables.withColumn("block", F.lit(-1).cast("long"))  # before the requests of their range
    rows = known.unionByName(requests.withColumn("found", F.lit(None).cast("binary"))).repartition("range").sortWithinPartitions("range", "block")

    def run(batches):
        now, held, table = None, [], None
        for b in batches:
            out = []
            for r, n, keys, block, found in zip(*[b.column(c).to_pylist() for c in ("range", "n", "keys", "block", "found")], strict=True):
                width = len(PAIR_VALUES if r >> bits > 1 else WORD_VALUES)
                if r != now:
                    now, held, table = r, [], None
                if block < 0:
                    held.append((_unzip_keys(keys, n), _unzip(found, n * width).reshape(width, n)))
                    continue
                if table is None:
                    held.append((np.empty(0, np.uint64), np.empty((width, 0), np.uint64)))
                    own, values = np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held], axis=1)
                    order = np.argsort(own)
                    # one column more, of what is not known
                    table, held = (own[order], np.append(values[:, order], np.zeros((width, 1), np.uint64), axis=1)), []
                asked = _unzip_keys(keys, n)
                at = np.searchsorted(table[0], asked)
                at[np.append(table[0], ~asked[-1])[at] != asked] = len(table[0])
                out.append((r, n, block, _zip(table[1][:, at])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)],
                                                 names=["range", "n", "block", "found"])

    return rows.mapInArrow(run, "range int, n int, block long, found binary")


def _by_count(values: DataFrame, names: list[str]) -> dict[int, dict[str, float]]:
    """By model ``2 * cls + f``: discounts d1 to d3 of the column of its class, its sum and the sum of its discounts."""
    rows = values.groupBy("f").agg(
        *[x for c in names for x in (F.sum(c).alias(f"{c}_sum"), F.count_if(F.col(c) >= 3).alias(f"{c}_more"),
                                     *[F.count_if(F.col(c) == k).cast("double").alias(f"{c}_{k}") for k in (1, 2, 3, 4)])])
    found = {}
    for i, c in enumerate(names):
        t = rows.select("f", *[F.col(f"{c}_{x}").alias(f"n{x}") for x in ("sum", "more", 1, 2, 3, 4)])
        for r in t.select("f", "nsum", "nmore", "n1", "n2", *_discount_columns()).where("nsum > 0").collect():  # two rows at most
            found[2 * i + r.f] = {"d1": r.d1, "d2": r.d2, "d3": r.d3, "sum": r.nsum, "cut": r.n1 * r.d1 + r.n2 * r.d2 + r.nmore * r.d3}
    return found


class WordModels:
    """Tables by fold ``f`` of the documents to be judged, a column a class: of seen pairs' counts, and of words.

    ``labelled`` are keyed documents with ``cls``. Model ``2 * cls + f`` is trained on the labelled documents of the other fold.
    With ``free``, ``labelled`` is a table that goes once it is read.
    """

    def __init__(self, labelled: DataFrame, free: bool = False):
        n = [F.sum(f"n{c}").alias(f"n{c}") for c in (0, 1, 2)]
        blocks = materialize(word_blocks(labelled, "cls"), "kn-labelled", free=True)
        if free:
            discard(labelled)
        words = blocks.agg(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
        #: goes in which pairs and words are dealt with, so that only a part of them is under way at a time: a power of two
        self.parts = 1 << min(MOST_PARTS.bit_length() - 1, (words // PART_WORDS).bit_length())
        #: first bits of keys that tell a range
        self.bits = max(LEAST_BITS, (words // RANGE_WORDS).bit_length())
        by_part = [materialize(block_counts(blocks, k, self.parts).groupBy("f", "h", "w").agg(*n), "kn-pairs", free=True) for k in range(self.parts)]
        discard(blocks)
        counts = reduce(DataFrame.unionByName, by_part)
        follow = materialize(counts.groupBy("f", "w").agg(  # after how many words a word stands
            *[F.count_if(F.col(f"n{c}") > 0).alias(f"n{c}") for c in (0, 1, 2)]), "kn-words", free=True)
        size = 1 + follow.select("w").distinct().count()  # one more for words not seen
        ones, twos = _by_count(follow, ["n0", "n1", "n2"]), _by_count(counts, ["n0", "n1"])
        #: by model: probability of a word not seen, discounts of pairs by their count
        self.floor = np.array([ones[m]["cut"] / ones[m]["sum"] / size if m in ones else np.nan for m in range(6)])
        self.cuts, self.word_cuts = (np.array([[0.0, *[x[m][d] for d in ("d1", "d2", "d3")]] if m in x else [0.0] * 4 for m in range(k)]) for x, k in ((twos, 4), (ones, 6)))
        self.sums = np.array([float(ones[m]["sum"]) if m in ones else 1.0 for m in range(6)])

        def of(c: int, values: dict[int, dict[str, float]], name: str) -> Column:
            found = F.lit(None).cast("double")
            for f in (0, 1):
                if 2 * c + f in values:
                    found = F.when(F.col("f") == f, F.lit(float(values[2 * c + f][name]))).otherwise(found)
            return found

        def one(c: int) -> Column:
            k = F.col(f"n{c}")
            d = F.when(k == 1, of(c, ones, "d1")).when(k == 2, of(c, ones, "d2")).otherwise(of(c, ones, "d3"))
            floor = of(c, {m: {"floor": x} for m, x in enumerate(self.floor) if m in ones}, "floor")
            return F.when(k > 0, (k - d) / of(c, ones, "sum") + floor).alias(f"one{c}")

        def gamma(c: int) -> Column:
            cut = of(c, twos, "d1") * F.col(f"a{c}") + of(c, twos, "d2") * F.col(f"b{c}") + of(c, twos, "d3") * F.col(f"c{c}")
            return F.when(F.col(f"count{c}") > 0, cut / F.col(f"count{c}")).alias(f"gamma{c}")

        heads = counts.where("n0 + n1 > 0").groupBy("f", F.col("h").alias("w")).agg(*[x for c in (0, 1) for x in (
            F.sum(f"n{c}").alias(f"count{c}"), F.count_if(F.col(f"n{c}") == 1).alias(f"a{c}"),
            F.count_if(F.col(f"n{c}") == 2).alias(f"b{c}"), F.count_if(F.col(f"n{c}") > 2).alias(f"c{c}"))])
        #: WORD_VALUES of every word, packed by ranges
        known = follow.join(heads.hint("merge"), ["f", "w"], "full").select("f", "w", *[F.coalesce(c, F.lit(0)).alias(c) for c in WORD_VALUES])
        self.known = materialize(_by_range(known, WORD_VALUES, 0, self.bits), "kn-known", free=True)
        discard(follow)
        #: PAIR_VALUES by part of the pairs, packed by ranges
        self.by_part = []
        for own in by_part:
            seen = _by_range(own.where("n0 + n1 > 0").select("f", "h", "w", *PAIR_VALUES), PAIR_VALUES, 2, self.bits)
            self.by_part.append(materialize(seen, "kn-seen-pairs", free=True))
            discard(own)
        rows = _rows(self.known, "w", WORD_VALUES, self.bits)
        #: of a word its probability by class after others (``one``), as the first of a pair its count and back-off weight
        self.words = rows.where("n0 + n1 + n2 > 0").select("f", "w", one(0), one(1), one(2))
        self.heads = rows.where("count0 + count1 > 0").select("f", F.col("w").alias("h"), "count0", "count1", gamma(0), gamma(1))
        self.pairs = _rows(reduce(DataFrame.unionByName, self.by_part), "g", PAIR_VALUES, self.bits)

    def probabilities(self, pairs: DataFrame) -> DataFrame:
        """Rows of word_pairs with p0 and p1, the probabilities of their second word in each class, and its toxic bits ``t``."""
        rows = pairs.select("doc_id", "hash", "f", "g", "h", "w", F.col("n").cast("long").alias("n")).join(self.pairs.hint("merge"), ["f", "g"], "left") \
                    .join(self.heads.hint("merge"), ["f", "h"], "left").join(self.words.hint("merge"), ["f", "w"], "left")
        floor, cuts = self.floor, self.cuts

        def run(batches):
            for b in batches:
                values = lambda c: b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
                found = _likely(b.column("f").to_numpy(), *[[values(f"{name}{c}") for c in range(k)] for name, k in (("n", 2), ("count", 2), ("gamma", 2), ("one", 3))], floor, cuts)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "hash", "n")], *[pa.array(x, from_pandas=True) for x in found]],
                                                 names=["doc_id", "hash", "n", "p0", "p1", "t"])

        return rows.mapInArrow(run, f"doc_id {pairs.schema['doc_id'].dataType.simpleString()}, hash long, n long, p0 double, p1 double, t double")

    def replies(self, blocks: DataFrame) -> DataFrame:
        """What the models know of each block's words and pairs."""
        return looked_up(_requests(blocks, self.bits), reduce(DataFrame.unionByName, [self.known, *self.by_part]), self.bits)


def _likely(f: np.ndarray | int, n: list, total: list, gamma: list, one: list, floor: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """p0, p1 and toxic bits; a list has an array a class, NaN where a table has nothing.

    The toxic bits are those by which toxic text makes the word likelier than trusted text; pairs are too rare to tell.
    """
    alone = [np.where(np.isnan(one[c]), floor[2 * c + f], one[c]) for c in (0, 1, 2)]
    p = []
    for c in (0, 1):
        k = np.nan_to_num(n[c]).astype(np.int64)
        seen = (k - cuts[2 * c + f, np.minimum(k, 3)]) / np.where(k > 0, total[c], 1.0)
        p.append(np.where(k > 0, seen, 0.0) + np.where(np.isnan(gamma[c]), 1.0, gamma[c]) * alone[c])
    return p[0], p[1], np.log2(alone[2] / alone[0])


def _millionths(bits: np.ndarray) -> np.ndarray:
    return np.copysign(np.floor(np.abs(bits) * 1e6 + 0.5), bits)


def word_scores(docs: DataFrame, models: WordModels) -> DataFrame:
    """(doc_id, hash, bits, ratio, worst) of the keyed documents that have words.

    Bits a word among trusted text, the mean of the bits by which low-quality
    text makes a word likelier, and the most by which toxic text makes any one.
    Means are summed in whole millionths, so that no order of summing shows.
    """
    floor, cuts, word_cuts, sums, bits = models.floor, models.cuts, models.word_cuts, models.sums, models.bits

    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        out, told = [], [[] for _ in range(4)]  # words and pairs of each fold
        for r, n, found in sorted(zip(*[known.column(c).to_pylist() for c in ("range", "n", "found")], strict=True)):
            told[r >> bits].append(_unzip(found, n * len(PAIR_VALUES if r >> bits > 1 else WORD_VALUES)).astype(np.int64).reshape(-1, n))
        for i in range(block.num_rows):  # one row
            size, ids, of, _, first, second = _block(block, i)
            k, folds = len(ids), np.asarray(block.column("hash")[i].values) & 1
            for x in np.unique(of).tolist():  # the documents of a fold, as the other's models judge them
                mine = np.flatnonzero(of == x)
                places, code, _, by_key = _sought(ids, first[mine], second[mine])
                at = np.searchsorted(code, first[mine] * k + second[mine])
                h, w = code // k, code % k
                values, n = np.zeros((len(WORD_VALUES), k), np.int64), np.empty((len(PAIR_VALUES), len(code)), np.int64)
                values[:, places], n[:, by_key] = np.concatenate(told[x], axis=1), np.concatenate(told[2 + x], axis=1)
                one = [np.where(v > 0, (v - word_cuts[m, np.minimum(v, 3)]) / sums[m] + floor[m], np.nan) for m, v in zip((x, 2 + x, 4 + x), values[:3], strict=True)]
                total, gamma = [values[3], values[7]], []
                for m, (v, *seen) in ((x, values[3:7]), (2 + x, values[7:])):
                    cut = cuts[m, 1] * seen[0] + cuts[m, 2] * seen[1] + cuts[m, 3] * seen[2]
                    gamma.append(np.where(v > 0, cut / np.maximum(v, 1), np.nan))
                p0, p1, t = _likely(x, n, [v[h] for v in total], [v[h] for v in gamma], [v[w] for v in one], floor, cuts)
                row = np.flatnonzero(folds == x)
                starts = np.cumsum(size[row]) - size[row]
                mean = lambda bits: np.add.reduceat(_millionths(bits)[at], starts) / size[row] / 1e6
                worst = np.maximum.reduceat(_millionths(t)[at] / 1e6, starts)
                out.append(pa.table({c: block.column(c)[i].values.take(pa.array(row)) for c in ("doc_id", "hash")} | {
                    c: pa.array(v, pa.float64(), from_pandas=True) for c, v in (("bits", mean(-np.log2(p0))), ("ratio", mean(np.log2(p1 / p0))), ("worst", worst))}))
        return pa.concat_tables(out)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, hash long, bits double, ratio double, worst double"
    found = []
    for k in range(models.parts):  # so that the words of a part of the documents are on disk at a time
        blocks = materialize(word_blocks(docs.where(F.pmod(F.shiftright("hash", 1), F.lit(models.parts)) == k)), "kn-blocks", free=True)
        known = materialize(models.replies(blocks), "kn-replies", free=True)
        scores = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, schema)
        found.append(materialize(scores, "kn-word-scores", free=True))
        discard(blocks, known)
    discard(models.known, *models.by_part)
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "hash").agg(*[F.min(m).alias(m) for m in ("bits", "ratio", "worst")])  # equal rows are equal


def packed(texts: DataFrame, *carry: str) -> DataFrame:
    """``carry``, ``zipped`` and its ``bytes``: texts as they travel to a join."""
    rows = needed(texts, *carry, "text")

    def run(batches):
        for b in batches:
            found = [None if t is None else t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in carry], pa.array([None if t is None else pa.compress(t, codec="zstd", asbytes=True) for t in found], pa.binary()),
                 pa.array([0 if t is None else len(t) for t in found], pa.int64())], names=[*carry, "zipped", "bytes"])

    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry], "zipped binary, bytes long"]))


def label_classes(labels: DataFrame) -> DataFrame:
    """(doc_id, cls) of the labelled documents that train: 0 trusted, 1 of low quality, 2 toxic, if all labels say so.

    A document of low quality that is toxic too has both rows.
    """
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max("quality").alias("q"), F.min(F.coalesce("toxic", F.lit(0))).alias("t"))
    return trusted_ids(labels).withColumn("cls", F.lit(0)).unionByName(
        said.where("q = 0").select("doc_id", F.lit(1).alias("cls"))).unionByName(said.where("t = 1").select("doc_id", F.lit(2).alias("cls")))


def _length_class() -> Column:
    return F.least(F.floor(F.log2(F.greatest("n_chars", F.lit(1)))), F.lit(11)).cast("int")


def limits(scores: DataFrame) -> DataFrame:
    """(l_lang, l_class, found) from the scores of trusted documents, ``found`` a map from measure to limit.

    Limits are quantiles of bins of 1/100 bit.
    """
    values = F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value"), F.lit(margin).alias("margin"))
                                for m, margin in MEASURES.items()]))
    bins = scores.select("lang", _length_class().alias("class"), values).where("value IS NOT NULL") \
                 .groupBy("measure", "margin", "lang", "class", F.ceil(F.col("value") * 100).alias("bin")).agg(F.count("*").alias("n"))

    def quantile(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys)
        return rows.select(*keys, "bin", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("seen")) \
                   .where(F.col("upto") >= QUANTILE * F.col("seen")).groupBy(*keys).agg((F.min("bin") / 100).alias("q"), F.max("seen").alias("seen"))

    summed = bins.groupBy("measure", "margin", "class", "bin").agg(F.sum("n").alias("n"))
    summed = summed.unionByName(summed.groupBy("measure", "margin", "bin").agg(F.sum("n").alias("n")).withColumn("class", F.lit(-1)))  # all lengths
    own = quantile(bins, ["measure", "margin", "lang", "class"])
    overall = quantile(summed, ["measure", "margin", "class"]).select("measure", "class", "margin", F.col("q").alias("q_all"))
    rows = own.join(overall.drop("margin"), ["measure", "class"]).select(
        "measure", F.col("lang").alias("l_lang"), F.col("class").alias("l_class"),
        (F.when(F.col("seen") >= LEAST, F.col("q")).otherwise(F.greatest("q", "q_all")) + F.col("margin")).alias("limit")).unionByName(
        overall.select("measure", F.lit("\u0000any").alias("l_lang"), F.col("class").alias("l_class"), (F.col("q_all") + F.col("margin")).alias("limit")))
    return rows.groupBy("l_lang", "l_class").agg(F.map_from_entries(F.collect_list(F.struct("measure", "limit"))).alias("found"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, hash, lang, n_chars, the measures, perplexity (a word) and kept of every document."""
    docs = _keyed(needed(docs, "doc_id", "text", "lang"))
    labels = needed(labels, "doc_id", "quality", "toxic")
    labelled = packed(docs, "doc_id", "hash").join(label_classes(labels).hint("merge"), "doc_id")  # labels grow with the documents
    labelled = materialize(labelled, "kn-labelled-texts", free=True)
    chars = score(docs, train(labelled.where("cls = 0")), "doc_id", "hash", "lang")
    models = WordModels(labelled, free=True)
    words = word_scores(docs, models)
    scored = chars.alias("c").join(words.alias("s").hint("merge"), F.col("c.hash").eqNullSafe(F.col("s.hash")) & F.col("c.doc_id").eqNullSafe(F.col("s.doc_id")), "left")
    scored = materialize(scored.select("c.*", *[f"s.{m}" for m in MEASURES if m != "char_bits"]), "kn-scores", free=True)
    rows = materialize(limits(scored.join(trusted_ids(labels), "doc_id")), "kn-limits")
    by_lang = rows.where(~F.col("l_lang").eqNullSafe(F.lit("\u0000any")))
    overall = rows.where(F.col("l_lang") == "\u0000any").select(F.col("l_class").alias("a_class"), F.col("found").alias("a_found"))
    rest = overall.where("a_class = -1").select(F.col("a_found").alias("r_found"))  # one row or none
    scored = scored.withColumn("l", _length_class())
    joined = scored.join(by_lang, scored["lang"].eqNullSafe(by_lang["l_lang"]) & (scored["l"] == by_lang["l_class"]), "left") \
                   .join(overall, F.col("l") == F.col("a_class"), "left").join(rest, F.lit(True), "left")
    kept = F.lit(True)
    for m in MEASURES:
        limit = F.coalesce(*[F.try_element_at(c, F.lit(m)) for c in ("found", "a_found", "r_found")])
        kept = kept & F.coalesce(F.col(m) <= limit, F.lit(True))
    return joined.select("doc_id", "hash", "lang", "n_chars", *MEASURES, F.pow(F.lit(2.0), F.col("bits")).alias("perplexity"), kept.alias("kept"))


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with exactly its columns."""
    gone = judge(docs, labels).where(~F.col("kept")).select(F.col("doc_id").alias("id"), "hash", F.col("lang").alias("in")).distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"].eqNullSafe(gone["id"]) & (F.xxhash64(docs["text"]) == gone["hash"])
                     & docs["lang"].eqNullSafe(gone["in"]), "left_anti")


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "lang", "n_chars", F.round("perplexity", 4).alias("perplexity"), "kept")
