"""Operator 8: byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

A text is cut into matches of the pattern; each distinct match of a batch
is encoded once. A match that is a token needs no merge (as in the tiktoken
library); the others become token-position rows of bytes in DuckDB, and a
recursive query joins neighbouring rows with the merge table and contracts
each word's minimum-rank pair, leftmost first, until no pair is left.
Occurrences of a word's minimum-rank pair that do not overlap are
contracted in the same round: in a vocabulary made by merging, contracting
one never brings forth a pair of lower rank. Ordered aggregation over the
rows joined with the vocabulary decodes.

The merge table is derived from the ranks: every cut of a token into two
tokens is a merge with the token's rank.

Edge cases: null and empty texts have no ids (digests of nothing); equal
texts and repeated rows each get their row; very long matches are encoded
by the same queries, in rounds of RECURSION so that memory stays bounded;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import needed, parts, ship_package, table

#: Words of one recursive query, their bytes together, and its rounds.
WORDS, WORD_BYTES, RECURSION = 60_000, 800_000, 12
#: Entries of a worker's memo of encoded words (some 300 bytes each); it is emptied when full.
MEMO = 1_100_000

#: Words of up to so many bytes take one contraction of a run (``aaaa``) a round, and one window pass a round.
SHORT = 200

# ``rank`` is that of the pair which a row makes with the next one, null if they don't merge; the merged token
# has the same number. All a row has to know of its neighbours lies within two rows, so one window is enough.
SHORT_ROUNDS = """
WITH RECURSIVE state(word, pos, token, rank, done) AS (
    SELECT word, pos, token, rank, false FROM rows LEFT JOIN merges USING (pair)
  UNION ALL
    SELECT word, pos, now, m.rank, least_rank IS NULL
    FROM (
        SELECT word, pos, least_rank, CASE WHEN take THEN rank ELSE token END AS now,
               CASE WHEN take THEN CASE WHEN rank_2 = least_rank AND rank_1 IS DISTINCT FROM least_rank THEN rank_2 ELSE token_2 END
                    WHEN rank_1 = least_rank AND rank IS DISTINCT FROM least_rank THEN rank_1 ELSE token_1 END AS following
        FROM (
            SELECT *, rank IS NOT DISTINCT FROM least_rank AND rank IS NOT NULL AND before_1 IS DISTINCT FROM least_rank AS take
            FROM (
                SELECT word, pos, token, rank,
                       lag(rank) OVER w AS before_1, lag(rank, 2) OVER w AS before_2,
                       lead(rank) OVER w AS rank_1, lead(rank, 2) OVER w AS rank_2,
                       lead(token) OVER w AS token_1, lead(token, 2) OVER w AS token_2,
                       min(rank) OVER (PARTITION BY word ORDER BY pos
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS least_rank
                FROM state WHERE NOT done WINDOW w AS (PARTITION BY word ORDER BY pos)
            )
            WHERE least_rank IS NULL OR before_1 IS DISTINCT FROM least_rank OR before_2 IS NOT DISTINCT FROM least_rank
        )
    ) LEFT JOIN merges m ON m.pair = now * 1048576::BIGINT + following
)
SELECT word, pos, token, false AS more FROM state WHERE done
"""

# For long words: runs are contracted whole, and after RECURSION rounds the rows reached start a new query.
LONG_ROUNDS = f"""
WITH RECURSIVE state(round, word, pos, token) AS (
    SELECT 0, word, pos, token FROM rows
  UNION ALL
    SELECT round + 1, word, pos, CASE WHEN take THEN merged ELSE token END
    FROM (
        SELECT *, lag(take, 1, false) OVER (PARTITION BY word ORDER BY pos) AS swallowed
        FROM (
            SELECT *, rank = least_rank AND (nth - coalesce(max(CASE WHEN rank = least_rank THEN NULL ELSE nth END)
                          OVER (PARTITION BY word ORDER BY pos), 0)) % 2 = 1 AS take
            FROM (
                SELECT p.*, coalesce(m.rank, {1 << 30}) AS rank, m.rank AS merged,
                       min(m.rank) OVER (PARTITION BY word) AS least_rank
                FROM (SELECT round, word, pos, token, row_number() OVER w AS nth,
                             token * 1048576::BIGINT + lead(token) OVER w AS pair
                      FROM state WINDOW w AS (PARTITION BY word ORDER BY pos)) p
                LEFT JOIN merges m ON m.pair = p.pair
            )
            WHERE least_rank IS NOT NULL
        )
    )
    WHERE NOT swallowed AND round < {RECURSION}
)
SELECT word, pos, token, last = {RECURSION} AS more
FROM (SELECT *, max(round) OVER (PARTITION BY word) AS last FROM state)
WHERE round = last
"""

RESULT = """
SELECT word, string_agg(token::VARCHAR, ',' ORDER BY pos) AS ids, unhex(string_agg(hex(bytes), '' ORDER BY pos)) AS decoded
FROM done JOIN vocabulary USING (token) GROUP BY word
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Vocabulary and merge table in an in-memory DuckDB of this worker."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        self.ranks, self.pattern, self.memo = read_ranks(path), regex.compile(pattern), {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        ranks = self.ranks
        self._load("vocabulary", token=np.array(list(ranks.values()), np.int32), bytes=pa.array(list(ranks), pa.binary()))
        merges = [(ranks[t[:k]] << 20 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t))
                  if t[:k] in ranks and t[k:] in ranks]
        self._load("merges", pair=np.array([p for p, _ in merges], np.int64),
                   rank=np.array([r for _, r in merges], np.int32))
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def _load(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def encode_words(self, words: list[bytes]) -> Iterator[tuple[int, str, bytes]]:
        """(index of the word, ids as text, decoded bytes) of each word, in any order."""
        whole = [self.ranks.get(w, -1) for w in words]
        sizes = np.array([1 if t >= 0 else len(w) for w, t in zip(words, whole, strict=True)])
        ends = np.cumsum(sizes)
        token = self.byte[np.frombuffer(b"".join([w if t < 0 else b"?" for w, t in zip(words, whole, strict=True)]), np.uint8)]
        token = np.where(np.repeat(whole, sizes) >= 0, np.repeat(whole, sizes), token).astype(np.int32)
        pair = (token.astype(np.int64) << 20) | np.append(token[1:], 0)
        pair[ends - 1] = -1
        self._load("rows", word=np.repeat(np.arange(len(words), dtype=np.int32), sizes),
                   pos=(np.arange(len(token)) - np.repeat(ends - sizes, sizes)).astype(np.int32), token=token, pair=pair)
        self.db.execute("CREATE OR REPLACE TABLE done(word INTEGER, pos INTEGER, token INTEGER)")
        query = SHORT_ROUNDS if max(map(len, words)) <= SHORT else LONG_ROUNDS
        while True:
            self.db.execute(f"CREATE OR REPLACE TABLE reached AS {query}")
            self.db.execute("INSERT INTO done SELECT word, pos, token FROM reached WHERE NOT more")
            self.db.execute("CREATE OR REPLACE TABLE rows AS SELECT word, pos, token FROM reached WHERE more")
            if not self.db.execute("SELECT count(*) FROM rows").fetchall()[0][0]:
                break
        r = self.db.sql(RESULT).to_arrow_table()
        return zip(*(r.column(c).to_pylist() for c in ("word", "ids", "decoded")), strict=True)

    def learn(self, words: set[str]) -> None:
        """Encode words that the memo lacks, short and long ones apart, in pieces of bounded size."""
        for long in (False, True):
            piece, size = [], 0
            for w in words:
                if (4 * len(w) > SHORT and len(w.encode("utf-8", "surrogatepass")) > SHORT) != long:
                    continue
                piece.append(w)
                size += len(w)
                if len(piece) >= WORDS or size >= WORD_BYTES:
                    self._learn(piece)
                    piece, size = [], 0
            if piece:
                self._learn(piece)

    def _learn(self, words: list[str]) -> None:
        for i, ids, decoded in self.encode_words([w.encode("utf-8", "surrogatepass") for w in words]):
            text = decoded.decode("utf-8", "surrogatepass")
            self.memo[words[i]] = (ids, words[i] if text == words[i] else text)  # equal texts share their memory

    def encode(self, texts: list[str | None], most: int = MEMO) -> Iterator[list[tuple[str, str]]]:
        """Per text its words' (ids, decoded text)."""
        memo = self.memo
        if len(memo) > most:
            memo.clear()
        pieces = [self.pattern.findall(t) if t else [] for t in texts]
        known = [list(map(memo.get, p)) for p in pieces]
        self.learn({w for p, k in zip(pieces, known, strict=True) if None in k for w, v in zip(p, k, strict=True) if v is None})
        for p, k in zip(pieces, known, strict=True):
            yield [memo[w] if v is None else v for w, v in zip(p, k, strict=True)] if None in k else k


@lru_cache(maxsize=1)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


#: Characters of the texts that are encoded together.
BATCH_CHARS = 4_000_000


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True, memo: int = MEMO,
                     chars: int = BATCH_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and, if asked for, ids (array) of every row.

    ``memo`` and ``chars`` bound what a worker remembers and encodes together. ``ids_sha256``: of the decimal ids joined by commas; ``decoded_sha256``: of the bytes that decoding the ids gives.
    """
    ship_package(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches):
        gc.disable()  # nothing here refers to itself, and the memo is large
        encoder = _encoder(ranks_path, pattern)
        for b in batches:
            doc_ids, texts = b.column("doc_id"), b.column("text").to_pylist()
            for begin, end in parts(texts, chars):
                n, ids, decoded, lists = [], [], [], []
                for words in encoder.encode(texts[begin:end], memo):
                    joined = ",".join([w[0] for w in words])
                    n.append(joined.count(",") + 1 if joined else 0)
                    ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256("".join([w[1] for w in words]).encode("utf-8", "surrogatepass")).hexdigest())
                    if with_ids:
                        lists.append(np.fromstring(joined, np.int32, sep=",") if joined else np.empty(0, np.int32))
                columns = [doc_ids.slice(begin, end - begin), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return needed(docs, "doc_id", "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str = ".") -> DataFrame:
    """(doc_id, text bytes) of rows (doc_id, ids): an ordered aggregation over ids joined with the vocabulary."""
    ship_package(encoded.sparkSession)

    def run(batches):
        db = _encoder(ranks_path, pattern).db
        for b in batches:
            db.register("given", pa.table({"row": pa.array(range(b.num_rows), pa.int64()), "ids": b.column("ids")}))
            r = db.execute("""
                SELECT row, unhex(coalesce(string_agg(hex(bytes), '' ORDER BY pos), '')) AS bytes
                FROM (SELECT row, unnest(ids) AS token, generate_subscripts(ids, 1) AS pos FROM given)
                JOIN vocabulary USING (token) GROUP BY row""").to_arrow_table()
            db.unregister("given")
            found = dict(zip(r.column("row").to_pylist(), r.column("bytes").to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([found.get(i, b"") for i in range(b.num_rows)], pa.binary())],
                names=["doc_id", "bytes"])

    return needed(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def op8_bpe(spark: SparkSession, sf_dir: str, ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Ids of all documents and what they decode to, as digests."""
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(ranks),
                            public_tokenizers.PATTERN, with_ids=False)
