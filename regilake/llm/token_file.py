"""Operator 7: token-id files coded by a static range asymmetric numeral system (rANS).

``encode_documents`` turns texts into ids with the tokenizers library,
``frequency_table`` counts all ids and scales the counts to one shared
table, ``write_token_file`` stores the ids in ascending ``doc_id`` order as
blocks, and ``read_token_file`` decodes the blocks in parallel.

File format: a folder with two Parquet tables, written by Spark (a lost
task is simply run again, its block has the same bytes).

``frequencies``  one row: the scaled frequency of each id (they add up to
                 ``2**SCALE_BITS``, none is 0, so any id can be coded)
``blocks``       one row a block: ``part, block`` (order), ``n_docs``,
                 ``n_tokens``, ``before`` (ids before it in its part), ``doc_ids`` and ``doc_lengths`` (packed),
                 ``payload`` (32-bit words), ``checkpoints`` (packed lane
                 states and read position every ``CHECKPOINT_STEPS`` steps)
                 and ``crc32`` (of all other binary fields)

A block interleaves ``LANES`` coder states (no more than it has tokens), token
i belonging to lane ``i % LANES``; blocks do not depend on each other, and decoding can start
at any checkpoint. A block holds whole documents.

Edge cases: null and empty texts have only the end id; null ``doc_id`` sorts
first; equal rows keep their number, next to each other; an empty table
gives an empty file that reads back as no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, materialize, needed, part_text, parts, ship_package, spaced, table

SCALE_BITS = 20
LANES = 4096
BLOCK_TOKENS = 1 << 19
CHECKPOINT_STEPS = 64
END_ID = 0
LOW = np.uint64(1 << 31)
#: Entries of each of the two generations of a worker's memo of encoded parts, of up to so many characters.
MEMO, MEMO_CHARS = 600_000, 64

BLOCKS = ("part int, block int, n_docs int, n_tokens long, before long, doc_ids binary, doc_lengths binary, payload binary, "
          "checkpoints binary, crc32 long")


# ---------------------------------------------------------------- tokenizing
@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    begins = np.zeros(t.get_vocab_size(), bool)
    begins[[i for token, i in t.get_vocab().items() if token[0] == "Ġ"]] = True
    return t, [{}, {}], begins


def _encode_parts(tok, begins: np.ndarray, words: list[str], dtype: np.dtype) -> list[bytes]:
    """Packed ids of parts that follow a blank, many to one call.

    No part holds a blank, so each token that begins with one (``Ġ`` in the
    vocabulary's own letters) begins the next part.
    """
    groups = [words[i:i + 256] for i in range(0, len(words), 256)]
    out, size = [], dtype.itemsize
    for group, e in zip(groups, tok.encode_batch_fast(["".join([f" {w}" for w in g]) for g in groups], add_special_tokens=False),
                        strict=True):
        ids = np.array(e.ids, dtype)
        at, blob = (size * np.flatnonzero(begins[ids])).tolist(), ids.tobytes()
        if len(at) != len(group):
            raise ValueError("the vocabulary splits blanks from what follows")
        out += [blob[b:e] for b, e in zip(at, [*at[1:], len(blob)], strict=True)]
    return out


def _learn(tok, begins: np.ndarray, memo: dict[str, bytes], new: set[str], dtype: np.dtype) -> None:
    """Encode parts that the memo lacks; a stop or comma after a letter is a token of its own."""
    marks = {m: array(dtype.char, tok.encode(m, add_special_tokens=False).ids).tobytes() for m in ".,"}
    odd, ended, words = [], [], set()
    for p in new:
        if p[0] in "\t\n":
            odd.append(p)
        elif p[-1] in marks and "a" <= p[-2:-1] <= "z":
            ended.append(p)
        else:
            words.add(p)
    words = list(words.union([c for p in ended if (c := p[:-1]) not in memo]))
    memo.update(zip(words, _encode_parts(tok, begins, words, dtype), strict=True))
    memo.update([(p, memo[p[:-1]] + marks[p[-1]]) for p in ended])
    for p, e in zip(odd, tok.encode_batch_fast(list(map(part_text, odd)), add_special_tokens=False), strict=True):
        memo[p] = array(dtype.char, e.ids).tobytes()


def tokenize(texts: list[str | None], path: str, dtype: np.dtype) -> list[np.ndarray]:
    """Ids of each text. Texts are cut where tokens can't span, and equal parts are sent to the library once."""
    tok, generations, begins = _tokenizer(path)
    if len(generations[0]) > MEMO:  # the parts met lately stay; those not met since the last time go
        generations[:] = [{}, generations[0]]
    memo, older = generations
    cut = [spaced(t) if t else None for t in texts]
    own = [i for i, c in enumerate(cut) if c]
    # split, told apart and put together again by Arrow: Python meets each part once a batch
    words = pc.split_pattern(pa.array([cut[i] for i in own], pa.large_string()), " ")
    coded = words.flatten().dictionary_encode()
    met = coded.dictionary.to_pylist()
    new = {p for p in met if p not in memo}
    memo.update([(p, older[p]) for p in new if p in older])
    _learn(tok, begins, memo, {p for p in new if p not in older}, dtype)
    found = list(map(memo.__getitem__, met))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) // dtype.itemsize
    ids = pa.LargeListArray.from_arrays(pa.array(np.append(0, ends)), pa.array(np.frombuffer(b"".join(found), dtype)))
    taken = ids.take(coded.indices)
    flat, at = taken.flatten().to_numpy(), taken.offsets.to_numpy()[words.offsets.to_numpy()]
    out = [np.empty(0, dtype) if not t else None if c else np.array(tok.encode(t, add_special_tokens=False).ids, dtype)
           for t, c in zip(texts, cut, strict=True)]
    for i, b, e in zip(own, at[:-1], at[1:], strict=True):
        out[i] = flat[b:e]
    for p in new:
        if len(p) > MEMO_CHARS:
            del memo[p]
    return out


def id_type(vocabulary: int) -> np.dtype:
    """The type that ids are packed in between the steps, little-endian."""
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def vocabulary_size(tokenizer_path: str) -> int:
    return _tokenizer(tokenizer_path)[0].get_vocab_size()


#: Characters of the texts that are encoded together.
BATCH_CHARS = 6_000_000


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids, counts): a row per document, ids packed by ``id_type``, END_ID appended.

    Between them stand rows of null ids with ``counts``: how often each id
    occurs in the documents before (packed ids, then as many 64-bit numbers).
    """
    ship_package(docs.sparkSession)
    vocabulary = vocabulary_size(tokenizer_path)
    dtype = id_type(vocabulary)

    def run(batches):
        gc.disable()  # nothing here refers to itself, and the memo is large
        for b in batches:
            doc_ids, texts = b.column("doc_id"), b.column("text").to_pylist()
            for begin, end in parts(texts, BATCH_CHARS):
                ids = [np.append(x, dtype.type(END_ID)) for x in tokenize(texts[begin:end], tokenizer_path, dtype)]
                seen = np.bincount(np.concatenate(ids), minlength=vocabulary)
                found = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([doc_ids.slice(begin, end - begin), pa.nulls(1, doc_ids.type)]),
                     pa.array([*[x.tobytes() for x in ids], None], pa.binary()),
                     pa.array([*[None] * len(ids), found.astype("<u4").tobytes() + seen[found].astype("<i8").tobytes()], pa.binary())],
                    names=["doc_id", "ids", "counts"])

    return needed(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids binary, counts binary")


# ----------------------------------------------------------------- the model
def scale_frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to add up to 2**SCALE_BITS, each at least 1."""
    room, total = (1 << SCALE_BITS) - len(counts), int(counts.sum())
    if room < 0:
        raise ValueError("more ids than slots")
    freq = 1 + (counts.astype(object) * room // total if total else np.zeros(len(counts), object))
    freq = freq.astype(np.int64)
    freq[int(np.argmax(freq))] += (1 << SCALE_BITS) - int(freq.sum())
    return freq.astype(np.uint64)


def frequency_table(encoded: DataFrame, vocabulary: int) -> np.ndarray:
    """The shared table, from the counts of all ids; what reaches the driver is one row an id."""

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for x in b.column("counts").to_pylist():
                n = len(x) // 12
                total[np.frombuffer(x, "<u4", n)] += np.frombuffer(x, "<i8", n, 4 * n)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())],
                                         names=["id", "n"])

    rows = encoded.select("counts").where("counts IS NOT NULL").mapInArrow(run, "id int, n long")
    counts = np.zeros(vocabulary, np.int64)
    for r in rows.groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.id] = r.n
    return scale_frequencies(counts)


# ---------------------------------------------------------------- the coder
def rans_encode(ids: np.ndarray, freq: np.ndarray, start: np.ndarray) -> tuple[bytes, bytes]:
    """(payload, checkpoints) of one block."""
    n, bits = len(ids), np.uint64(SCALE_BITS)
    lanes = min(LANES, n)
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words, at, marks = [], 0, []
    for t in range(steps - 1, -1, -1):
        s = ids[t * lanes:(t + 1) * lanes]
        f, c, x = freq[s], start[s], state[:len(s)]
        full = x >= (f << np.uint64(63 - SCALE_BITS))
        out = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
        words.append(out)
        at += len(out)
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[:len(s)] = (q << bits) + (x - q * f) + c
        if t % CHECKPOINT_STEPS == 0:
            marks.append((at, state.copy()))
    payload = np.concatenate(words[::-1]) if words else np.empty(0, "<u4")
    return payload.tobytes(), b"".join(np.uint64(at - a).tobytes() + s.tobytes() for a, s in marks[::-1])


def rans_decode(payload: bytes, checkpoints: bytes, n: int, freq: np.ndarray, start: np.ndarray, symbol: np.ndarray,
                first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the checkpoint segments ``first`` to ``last`` (all of them by default)."""
    lanes = min(LANES, n)
    size = 8 * (lanes + 1)
    last = len(checkpoints) // size if last is None else last
    if first >= last:
        return np.empty(0, symbol.dtype)
    mark = np.frombuffer(checkpoints, np.uint64, lanes + 1, first * size)
    words, at, state = np.frombuffer(payload, "<u4"), int(mark[0]), mark[1:].copy()
    bits, mask, out = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1), []
    for t in range(first * CHECKPOINT_STEPS, min(last * CHECKPOINT_STEPS, -(-n // lanes))):
        k = min(lanes, n - t * lanes)
        x = state[:k]
        slot = x & mask
        s = symbol[slot]
        out.append(s)
        x = freq[s] * (x >> bits) + slot - start[s]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << np.uint64(32)) | words[at:at + len(low)]
        at += len(low)
        state[:k] = x
    return np.concatenate(out)


def _tables(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    return freq, start, np.repeat(np.arange(len(freq), dtype=id_type(len(freq))), freq.astype(np.int64))


def _crc(*fields: bytes) -> int:
    value = 0
    for f in fields:
        value = zlib.crc32(f, value)
    return value


class _Blocks:
    """Cuts a stream of documents into blocks of whole documents with BLOCK_TOKENS ids or more."""

    def __init__(self, part: int, freq: np.ndarray):
        self.part, self.block, self.before, (self.freq, self.start, _) = part, 0, 0, _tables(freq)
        self.clear()

    def clear(self) -> None:
        self.docs, self.ids, self.size = [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append(doc_id)
        self.ids.append(ids)
        self.size += len(ids)
        if self.size >= BLOCK_TOKENS:
            yield self.flush()

    def flush(self) -> tuple:
        ids = np.concatenate(self.ids)
        payload, marks = rans_encode(ids, self.freq, self.start)
        docs = np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.packbits([d is None for d in self.docs]).tobytes()
        lengths = np.array([len(x) for x in self.ids], "<i8").tobytes()
        row = (self.part, self.block, len(self.docs), len(ids), self.before, docs, lengths, payload, marks,
               _crc(docs, lengths, payload, marks))
        self.block, self.before = self.block + 1, self.before + len(ids)
        self.clear()
        return row


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 4 + [pa.int64()]
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=names)


# ---------------------------------------------------------------- the files
def write_token_file(encoded: DataFrame, path: str, vocabulary: int, partitions: int | None = None) -> None:
    """Write ``encoded`` (from :func:`encode_documents`, best already written out) as a token file.

    Rows go to range partitions by ``doc_id`` and a hash of the ids, so that
    many rows of one ``doc_id`` still spread; a partition's blocks follow in order.
    """
    spark = encoded.sparkSession
    freq = frequency_table(encoded, vocabulary)
    spark.createDataFrame([(freq.astype(np.int64).tolist(),)], "frequency array<long>") \
         .coalesce(1).write.mode("overwrite").parquet(f"{path}/frequencies")
    shared = spark.sparkContext.broadcast(freq)  # one number an id of the vocabulary
    dtype = id_type(vocabulary)

    def run(batches):
        blocks = _Blocks(TaskContext.get().partitionId(), shared.value)
        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                for row in blocks.add(doc_id, np.frombuffer(ids.as_buffer(), dtype)):
                    yield _batch([row])
        if blocks.ids:
            yield _batch([blocks.flush()])

    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("doc_id"), F.xxhash64("ids")]
    ordered = encoded.select("doc_id", "ids").where("ids IS NOT NULL").repartitionByRange(parts, *keys).sortWithinPartitions(*keys, "ids")
    ordered.mapInArrow(run, BLOCKS).write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")


def read_frequencies(spark: SparkSession, path: str) -> np.ndarray:
    return np.array(spark.read.parquet(f"{path}/frequencies").first()[0], np.uint64)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ``start`` counts the ids of all documents before it.

    A block knows the ids before it in its partition; the totals of the
    partitions, at most as many rows as ``write_token_file`` was given
    partitions, are added up on the driver. A block whose checksum does not
    fit its bytes raises an error.
    """
    ship_package(spark)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts, at = {}, 0
    for part, n in totals:
        starts[part], at = at, at + n
    shared = spark.sparkContext.broadcast((read_frequencies(spark, path), starts))

    def run(batches):
        freq, begins = shared.value
        tables = _tables(freq)
        for batch in batches:
            for r in batch.to_pylist():
                if _crc(r["doc_ids"], r["doc_lengths"], r["payload"], r["checkpoints"]) != r["crc32"]:
                    raise ValueError(f"block {r['part']}/{r['block']} is damaged")
                ids = rans_decode(r["payload"], r["checkpoints"], r["n_tokens"], *tables).astype("<u4")
                n = r["n_docs"]
                docs = np.frombuffer(r["doc_ids"], "<i8", n)
                nulls = np.unpackbits(np.frombuffer(r["doc_ids"], np.uint8, -1, 8 * n), count=n).astype(bool)
                lengths = np.frombuffer(r["doc_lengths"], "<i8")
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64(), mask=nulls),
                     pa.array(ends - lengths + r["before"] + begins[r["part"]], pa.int64()), pa.array(lengths, pa.int64()),
                     pa.array([ids[e - k:e].tobytes() for e, k in zip(ends, lengths, strict=True)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op7_token_file(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """All documents through the token file and back; digests of what was read."""
    import uuid

    import public_tokenizers

    path = public_tokenizers.path(tokenizer)
    encoded = materialize(encode_documents(table(spark, sf_dir, "documents"), path), "token-ids")
    file = f"{checkpoint_dir(spark).rstrip('/')}/tables/token-file-{uuid.uuid4().hex}"
    write_token_file(encoded, file, vocabulary_size(path))
    return read_token_file(spark, file).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
