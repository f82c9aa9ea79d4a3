"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, discard, materialize, ship_package

__all__ = ["ALNUM_SEPARATORS", "alnum_words", "alnum_words_py", "checkpoint_dir", "components", "discard",
           "materialize", "mix64", "needed", "part_text", "parts", "ship_package", "spaced", "space_words", "table"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that separate words of the form ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
ALNUM_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def needed(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: columns of other names never meet the operator's own."""
    return df.select(*[df[n] for n in names])


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes; null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def alnum_words_py(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8 bytes."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def alnum_words(text: Column) -> Column:
    """The same words as an array column, without Python."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, ALNUM_SEPARATORS), "")


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each ``u`` has one ``v`` and no ``v`` is a ``u``: then the edges are the components."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR (out = 1 AND into = 1)").isEmpty()


def components(edges: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, component)``, the least node of each.

    Alternating large-star and small-star steps; every node only needs the
    minimum of its neighbours (a partial aggregate), so no neighbourhood is
    ever collected. Each round is written to the shared folder, which cuts
    the lineage; the rounds end once every node hangs on the least of its
    component. Nodes without edges get no row.
    """
    state = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .where(F.col("u") != F.col("v")).distinct(), label)
    for _ in range(max_rounds):
        if _is_star_forest(state):
            break
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        state = materialize(small, label)
    else:
        raise RuntimeError("components did not settle")
    nodes = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (xor-shift and multiply) for arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spaced(text: str) -> str | None:
    """A non-empty ``text`` such that its parts between blanks can be encoded one by one.

    Byte-level pre-tokenisers put no token across a place where a blank or
    line feed follows another character, and what they do between two such
    places does not depend on what is around. A part stands for a blank and
    itself; one that begins with a line feed for itself; the first one,
    marked by a tab, for what follows the tab (see :func:`part_text`). None
    for texts with runs of white space or with other characters that don't
    print, white space among them: there a token may span several such
    characters, and the text has to be encoded whole.
    """
    if "  " in text or " \n" in text or "\n\n" in text or text[-1] == " " or not text.replace("\n", " ").isprintable():
        return None
    return "\t" + text.replace("\n", " \n")


def part_text(part: str) -> str:
    return part[1:] if part[:1] == "\t" else part if part[:1] == "\n" else f" {part}"


def parts(texts: list[str | None], chars: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of neighbouring texts that together have so many characters, or of one longer text."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
